import os

import pytest

from tessella.plans import extract as X
from tessella.sources import files as S
from tessella.sources import fluent, python_code, tree
from tessella.sources.ignore import compiled, excluding, ignored, parsed
from tessella.sources.options import Options, find_config, load_config, sample_config


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_walk_order_and_rules(tmp_path):
    for n in ("a/b.py", "a.py", "_x.py", ".hidden/c.py", "skip/d.py", "keep/skip.py", "keep/deep/e.py", "n.txt", "skip2/f.py"):
        put(tmp_path, n, "x")
    put(tmp_path, "keep/.ignore", "*.py\n!e.py\n")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "a" / "round").symlink_to(tmp_path)
    got = ["/".join(p) for p, _ in tree.listed(str(tmp_path), ".py", ["skip/**", "!.hidden"], (".ignore",))]
    assert got == ["_x.py", "a/b.py", "a.py", "keep/deep/e.py", "link/b.py", "skip2/f.py"]
    assert tree.listed(str(tmp_path / "none"), ".py") == [] and tree.listed(str(tmp_path / "n.txt"), ".py") == []
    assert tree.listed(str(tmp_path / "a.py"), ".py") == [((), 1)]


def test_globs_and_last_match():
    import re

    assert re.fullmatch(compiled("a/**/b?.py"), "a/x/y/b1.py")
    assert re.fullmatch(compiled("*.py"), "x/y.py") and not re.fullmatch(compiled("/x/*.py"), "x/y/z.py")
    assert re.fullmatch(compiled("[!a]b"), "cb") and not re.fullmatch(compiled("[!a]b"), "ab")
    rules = parsed(["*.py", "# no", "!keep.py", "build/"])
    assert ignored("a/b.py", False, rules) and ignored("keep.py", False, rules) is False
    assert ignored("build", True, rules) and ignored("build", False, rules) is None and ignored("x.txt", False, rules) is None
    assert ignored("venv", True, excluding(["venv/**"])) and ignored("venv/x", False, excluding(["venv/**"]))


def test_typed_read_errors(spark, tmp_path):
    put(tmp_path, "ok/__init__.py", "i18n.a()")
    put(tmp_path, "bad.py", b"i18n \xff")
    put(tmp_path, "cut.py", b"i18n\n\xc3\xa9x\xe2\x82")
    put(tmp_path, "none.py", "x = 1")
    (tmp_path / "dangling.py").symlink_to(tmp_path / "nowhere")
    rows = {r["path"]: (r["text"], r["error"]) for r in tree.tree(spark, str(tmp_path), ".py", mentions=["i18n", "L"]).collect()}
    assert rows == {"ok/__init__.py": ("i18n.a()", None), "bad.py": (None, "invalid-utf8: invalid utf-8 sequence of 1 bytes from index 5 (1:6)"), "cut.py": (None, "invalid-utf8: incomplete utf-8 byte sequence from index 8 (2:3)")}
    assert tree.tree(spark, str(tmp_path / "missing"), ".py").count() == 0


def test_file_gone_after_planning(tmp_path):
    """A file that goes between planning and reading is an error of its own, not of the scan."""
    put(tmp_path, "a.py", "x")
    reader = tree.TreeReader({"path": str(tmp_path), "extension": ".py"})
    (share,) = reader.partitions()
    (tmp_path / "a.py").unlink()
    ((i, path, text, error),) = reader.read(share)
    assert (i, path, text) == (0, "a.py", None) and error.startswith("read-error")


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    for n, text in (("a/x.py", "i18n one"), ("a/y.py", "two"), ("b/x.py", "i18n three")):
        put(tmp_path, n, text)
    before = spark.conf.get(tree.PUSH)
    spark.conf.set(tree.PUSH, "true")
    try:
        df = tree.tree(spark, str(tmp_path), ".py").where("contains(text, 'i18n') and startswith(path, 'a/')")
        df.explain("formatted")
        plan = capsys.readouterr().out
        assert "StringContains(text,i18n)" in plan and "StringStartsWith(path,a/)" in plan
        assert [r["path"] for r in df.collect()] == ["a/x.py"]
    finally:
        spark.conf.set(tree.PUSH, before)


def test_many_files_make_many_shares(tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "SHARE_FILES", 3)
    for i in range(10):
        put(tmp_path, f"d{i % 4}/f{i}.py", "x")
    shares = tree.TreeReader({"path": str(tmp_path)}).partitions()
    assert len(shares) == 4 and sorted(i for s in shares for i, _ in s.files) == list(range(10))


def test_write_only_what_changed(spark, tmp_path):
    df = spark.createDataFrame([("en/a.ftl", "x\n"), ("en/b/c.ftl", "y\n")], "path string, content string")
    tree.write_tree(df, str(tmp_path))
    assert (tmp_path / "en/b/c.ftl").read_text() == "y\n"
    when = (tmp_path / "en/a.ftl").stat().st_mtime_ns
    tree.write_tree(spark.createDataFrame([("en/a.ftl", "x\n"), ("en/b/c.ftl", "z\n")], df.schema), str(tmp_path))
    assert (tmp_path / "en/a.ftl").stat().st_mtime_ns == when and (tmp_path / "en/b/c.ftl").read_text() == "z\n"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.ftl", "c.ftl"]


def test_a_failing_task_leaves_the_old_tree(spark, tmp_path):
    """One task of several fails after others have written: every byte stays, and nothing is left beside."""
    old = {f"f{i}.txt": f"old {i}" for i in range(20)}
    for n, text in old.items():
        put(tmp_path, n, text)
    new = spark.range(20).repartition(4).selectExpr("concat('f', id, '.txt') path", "if(id = 13, raise_error('no'), concat('new ', id)) content")
    with pytest.raises(Exception, match="no"):
        tree.write_tree(new, str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == old


def test_state_checksum(spark, tmp_path):
    df = spark.range(10).toDF("n")
    S.save_state(df, str(tmp_path / "s"))
    assert S.load_state(spark, str(tmp_path / "s")).count() == 10
    spark.range(9).toDF("n").write.mode("overwrite").parquet(str(tmp_path / "s/rows"))
    with pytest.raises(ValueError, match="checksum"):
        S.load_state(spark, str(tmp_path / "s"))


def test_options(tmp_path):
    put(tmp_path, "pyproject.toml", '[tool.extract]\ni18n-keys = ["t"]\nignore-kwargs = ["when"]\nignore-kwargs-append = ["x"]\nline-endings = "lf"\ncode-path = "src"\n[tool.a.b]\nlanguages = ["uk"]\n')
    (tmp_path / "a/b").mkdir(parents=True)
    found = find_config(str(tmp_path / "a/b"))
    o = Options().resolved(load_config(found), {"line-endings": "cr", "i18n-keys-append": ["u"]})
    assert o.names == {"t", "u"} and o.ignore_kwargs == {"when", "x"} and o.line_endings == "cr" and o.code_path == str(tmp_path / "src")
    assert Options().resolved(load_config(found, "a.b"), {}).locales == ("uk",) and load_config(found, "none.at.all") == {}
    with pytest.raises(ValueError):
        Options().resolved({}, {"line-endings": "no"})
    assert "[tool.extract]" in sample_config() and "i18n-keys-prefix = []" in sample_config()
    put(tmp_path, "sample.toml", sample_config())
    assert Options().resolved(load_config(tmp_path / "sample.toml"), {}).names == Options().names


CODE = """
i18n.get("hello", name=1)
i18n.a.b(_path="f", z=1, y=2)
self.i18n.a.b(**k)
i18n.set_locale("x")
i18n.get(name)
L("lit" "eral", when=1, é=2)
x[0].i18n.get("no")
i18n.outer(i=i18n.get("inner"))
i18n.get(*a)
"""


OWN = Options(prefixes=frozenset({"self"}), ignore_kwargs=frozenset({"when"}))


def test_occurrences():
    got = [(k, kw, p, star) for k, kw, p, _, _, star in python_code.occurrences_in(CODE, OWN)]
    assert got == [
        ("hello", ["name"], None, False),
        ("a-b", ["y", "z"], "f", False),
        ("a-b", [], None, True),
        ("literal", ["é"], None, False),
        ("outer", ["i"], None, False),
        ("inner", [], None, False),
    ]
    assert python_code.entry_path("f", "d.ftl") == "f/d.ftl" and python_code.entry_path("f/x.ftl", "d.ftl") == "f/x.ftl" and python_code.entry_path(None, "d.ftl") == "d.ftl"


def test_candidates_find_every_occurrence():
    spots = {(c[2], c[0]) for c in python_code.candidates_in(CODE)}
    for _, _, _, line, _, _ in python_code.occurrences_in(CODE, OWN):
        assert (line, "string") in spots or (line, "chain") in spots
    first = next(c for c in python_code.candidates_in('f(a, "x", k="y", g=h("z"))') if c[0] == "string")
    assert first[1] == '"x"' and first[4] == 1 and not first[5] and not first[6]
    assert [c[6] for c in python_code.candidates_in('f(a, g=h("z"))') if c[0] == "string"] == [True]


def test_fluent_round_trip():
    text = "# Note\nhello = Hi { $name } { -brand.case }\n    { other }\n\n-brand = B\n\n### Free\n\nother = { $x }\n"
    e = fluent.parse(text)
    assert [(x.kind, x.name) for x in e] == [("message", "hello"), ("term", "-brand"), ("comment", None), ("message", "other")]
    assert e[0].comment == "Note" and e[0].variables == ["name"] and e[0].refs == ["-brand.case", "other"]
    again = fluent.parse(fluent.serialize(e))
    assert [(x.kind, x.name, x.text, x.comment) for x in again] == [(x.kind, x.name, x.text, x.comment) for x in e]
    with pytest.raises(ValueError):
        fluent.parse("= nothing")


def test_fluent_patterns():
    text = 'a = Costs $5 { "{ $no }" } { NUMBER($n, style: "x") ->\n    [one] $plain { $one }\n   *[other] { b.title } { -t(case: $arg) }\n }\n    .hint = { $hint } { c }\n'
    (a,) = fluent.parse(text)
    assert a.variables == ["arg", "n", "one"] and a.refs == ["b.title", "-t"]
    assert a.attributes == [{"name": "hint", "variables": ["hint"], "refs": ["c"]}]
    for bad in ("a = { $x", "a = x }", "a = { $n ->\n    [one] x"):
        with pytest.raises(ValueError):
            fluent.parse(bad)


def test_variables_by_part_and_scope(spark):
    """Own attributes and variables inside terms don't count; attributes referred to do, and so do arguments given to terms."""
    text = "a = { b.title } { -t(case: $arg) } { lost }\n    .own = { $own }\nb = { $value }\n    .title = { $title } { a }\nc = { $inside }\n-t = { $case } { c }\n    .x = { $never }\nd = { c }\n"
    files = spark.createDataFrame([("en", "f.ftl", text), ("de", "f.ftl", "c = { $anders }\nd = { c }\n")], "locale string, path string, text string")
    got = {(r["locale"], r["name"]): (r["variables"], sorted(r["needed"])) for r in X.variables(fluent.entries(files)).collect()}
    assert got == {
        ("en", "a"): (["arg", "title"], ["b", "c", "lost"]),
        ("en", "b"): (["value"], []),
        ("en", "c"): (["inside"], []),
        ("en", "d"): (["inside"], ["c"]),
        ("de", "c"): (["anders"], []),
        ("de", "d"): (["anders"], ["c"]),
    }


def test_made_programs_compile_and_their_keys_have_one_candidate(spark):
    from tessella.sources import generated, python_code
    from tessella.sources.options import Options

    texts = [generated.program(i) for i in range(60)]
    assert texts == [generated.program(i) for i in range(60)] and len(set(texts)) == 60
    files = generated.corpus(spark.range(60).withColumnRenamed("id", "seed"), "seed", Options())
    found = python_code.occurrences(files, Options())
    assert found.where("error is not null").count() == 0 and found.count() > 30
    out = python_code.labelled(python_code.candidates(files, Options()), found)
    assert out.count() == found.select("file_idx", "line", "col", "key").distinct().count()


def test_tables_from_files(spark, tmp_path):
    import numpy as np

    from tessella.sources import tables

    (tmp_path / "a.tsv").write_text("id\tname\n1\tx y\n2\t\n")
    assert [(r["id"], r["name"]) for r in tables.read_tsv(spark, str(tmp_path / "a.tsv"), "id int, name string").collect()] == [(1, "x y"), (2, None)]
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": [1.5]}\n{"id": 2, "v": []}\n')
    assert [(r["id"], r["v"]) for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, v array<double>").collect()] == [(1, [1.5]), (2, [])]
    np.savez(tmp_path / "a.npz", id=np.arange(3), v=np.ones((3, 2)))
    got = tables.read_npz(spark, str(tmp_path / "a.npz"), {"id": "long", "v": "array<double>"}).orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in got] == [(i, [1.0, 1.0]) for i in range(3)]
