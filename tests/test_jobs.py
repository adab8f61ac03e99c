"""The jobs over growing copies, run twice, from the command line, and against SQL."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import document_messages, page_catalogue, queries
from jobs.common import HERE, configuration

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_job_is_what_sql_says(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    r = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in r.description]
    want = sorted(repr(tuple(x)) for x in r.fetchall())
    out = queries.queries()[name](spark, sf)
    assert set(out.columns) == set(names) and len(want) > 0
    assert sorted(repr(tuple(x)) for x in out.select(*names).collect()) == want


def test_messages_of_a_growing_folder(spark, sf, tmp_path, caplog):
    """The second run reads what was added only; changed and removed documents get a version, equal ones don't."""
    caplog.set_level("INFO")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    config = configuration(HERE / "document_messages.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs.where("doc_id < 120").repartition(3).write.parquet(src)
    run = lambda: document_messages.run(spark, config, src, out, ck)
    run()
    first = {r["doc_id"]: r for r in document_messages.current(spark, out).collect()}
    assert set(first) == set(range(120)) and all(r["version"] == 1 for r in first.values())
    run()
    assert document_messages.result(spark, out).count() == 120 and "nothing new" in caplog.text
    more = docs.where("doc_id >= 120 and doc_id < 150")
    again = docs.where("doc_id < 10")  # equal: no change
    other = docs.where("doc_id between 10 and 14").withColumn("text", F.lit("One two 3 four. And five six 7"))
    gone = docs.where("doc_id in (20, 21)").withColumn("text", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(None, "No id at all here.", "en"), (900, "", None), (901, None, "en")], docs.schema)
    more.unionByName(again).unionByName(other).unionByName(gone).unionByName(odd).coalesce(2).write.mode("append").parquet(src)
    run()
    changes = document_messages.result(spark, out)
    assert changes.count() == 120 + 30 + 5 + 2 + 1
    now = {r["doc_id"]: r for r in document_messages.current(spark, out).collect()}
    assert set(now) == (set(range(150)) | {900}) - {20, 21}
    assert all(now[i] == first[i] for i in range(10)) and now[900]["n_messages"] == 0 and now[900]["locale"] == "und"
    assert all((now[i]["version"], now[i]["n_messages"], now[i]["n_with_variables"]) == (2, 2, 2) for i in range(10, 15))
    # one run over all gives the same state as the runs over what grew
    document_messages.run(spark, config, src, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    keys = lambda x: {r["doc_id"]: r["message_keys"] for r in x.collect()}
    assert keys(document_messages.current(spark, str(tmp_path / "out2"))) == {d: r["message_keys"] for d, r in now.items()}
    assert {p.name for p in (tmp_path / "out").glob("locale=*")} >= {"locale=en", "locale=und"}


def test_a_run_that_was_cut_off(spark, sf, tmp_path):
    """Batches of one file each; the second run is stopped before its last batch is committed, and the third ends it."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    config = configuration(HERE / "document_messages.json") | {"files_per_trigger": 1}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs.where("doc_id < 90").repartition(3).write.parquet(src)
    document_messages.run(spark, config, src, out, ck)
    docs.where("doc_id >= 90 and doc_id < 120").repartition(2).write.mode("append").parquet(src)
    document_messages.run(spark, config, src, out, ck)
    want = sorted(map(repr, document_messages.current(spark, out).collect()))
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").glob("[0-9]*"))
    assert last == 4 and len(want) == 120
    for p in (tmp_path / "ck" / "commits").glob(f"*{last}*"):  # the commit and its checksum
        p.unlink()
    document_messages.run(spark, config, src, out, ck)
    assert sorted(map(repr, document_messages.current(spark, out).collect())) == want
    assert document_messages.result(spark, out).count() == 120


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


LINK = '<a href="/{}">{}</a>'


def test_catalogue_of_pages(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    src, out = str(tmp_path / "pages"), str(tmp_path / "out")
    config = configuration(HERE / "page_catalogue.json")
    rows = [
        (3, "https://a.example/en/1", LINK.format("Home", "Start") + LINK.format("Help", "Q &amp; A")),
        (1, "https://a.example/en/2?x", LINK.format("home", "Home") + LINK.format("", "no key") + LINK.format("x", " ")),
        (2, "https://a.example/de/1", LINK.format("home", "Heim") + LINK.format("alt", "Alt")),
        (4, "https://a.example/fr", LINK.format("help", "Q &amp; A")),
        (5, "https://spam.example/de/1", LINK.format("buy", "Kauf")),
        (6, "https://a.example/", None),
        (7, None, LINK.format("lost", "Lost")),
    ]
    pages(spark, rows).write.parquet(src)
    want = {
        ("en", "home"): ("source", "Home", "Home", 1, 2, 2),
        ("en", "help"): ("source", "Q & A", "Q & A", 3, 1, 1),
        ("de", "home"): ("translated", "Heim", "Home", 2, 1, 1),
        ("de", "help"): ("missing", None, "Q & A", None, None, None),
        ("de", "alt"): ("stale", "Alt", None, 2, 1, 1),
        ("fr", "home"): ("missing", None, "Home", None, None, None),
        ("fr", "help"): ("untranslated", "Q & A", "Q & A", 4, 1, 1),
        ("und", "home"): ("missing", None, "Home", None, None, None),
        ("und", "help"): ("missing", None, "Q & A", None, None, None),
        ("und", "lost"): ("stale", "Lost", None, 7, 1, 1),
    }
    got = lambda: {(r["locale"], r["key"]): tuple(r)[2:] for r in page_catalogue.result(spark, out).collect()}
    for _ in range(2):  # the second run replaces the first with the same
        assert page_catalogue.run(spark, config, src, out) == 0
        assert got() == want
    assert "several" not in caplog.text and "`home` has 2 texts" in caplog.text
    # a locale that is gone from the pages is gone from the output
    pages(spark, [r for r in rows if r[0] != 4]).write.mode("overwrite").parquet(src)
    page_catalogue.run(spark, config, src, out)
    assert got() == {k: v for k, v in want.items() if k[0] != "fr"}
    # the gate: nothing but the messages is written
    assert page_catalogue.run(spark, config | {"stop_on_conflicts": True}, src, str(tmp_path / "gated")) == page_catalogue.CONFLICTS
    assert not (tmp_path / "gated" / "status").exists()


def test_catalogue_of_no_pages(spark, tmp_path):
    pages(spark, []).write.parquet(str(tmp_path / "none"))
    assert page_catalogue.run(spark, configuration(HERE / "page_catalogue.json"), str(tmp_path / "none"), str(tmp_path / "out")) == 0


def test_command_lines(sf, tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    for args in (
        ["jobs.page_catalogue", "--pages", f"{sf}/pages.parquet", "--out", str(tmp_path / "p")],
        ["jobs.document_messages", "--documents", f"{sf}/documents.parque[t]", "--out", str(tmp_path / "d"), "--checkpoint", str(tmp_path / "k")],
    ):
        done = subprocess.run([sys.executable, "-m", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
        assert "read" in done.stderr and "wrote" in done.stderr
    assert list((tmp_path / "p" / "status").glob("locale=en/*.parquet")) and list((tmp_path / "d").glob("locale=en/*.parquet"))


def test_jobs_stand_alone():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        text = p.read_text()
        assert "tessella" + ".llm" not in text and "corpus" + "_pipeline" not in text, p
