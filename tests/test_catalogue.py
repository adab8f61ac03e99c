"""Every query with SQL gives the rows that DuckDB gives on the same tables, however rows are dealt out."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return str(v)
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in df.collect())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    r = duck.execute(catalogue.oracle_sql()[name])
    theirs = [c[0] for c in r.description]
    expected = sorted(repr([plain(row[theirs.index(c)]) for c in sorted(theirs)]) for row in r.fetchall())
    # every part of the smallest tables has an input, so none is an orphan there
    assert expected or name == "orphans_by_type", "a query without rows proves nothing"
    names, got = rows(catalogue.queries()[name](spark, sf))
    assert names == sorted(theirs)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["occurrence_merge_winner", "reconcile_full_outer", "hashed_features_tanh", "python_occurrences"])
def test_partitions_dont_matter(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows(catalogue.queries()[name](spark, sf))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert rows(catalogue.queries()[name](spark, sf)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["occurrence_merge_winner", "merge_by_file"])
def test_of_tied_occurrences_the_first_stored_wins(spark, tmp_path, name):
    """Rows of one part with the same place, in one file and across files; the first and last of each differ."""
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    for f in range(2):
        made = [(1, part, 3 * part + 5 * f + i, 1, "RN"[part % 2], "OF"[(i + f) % 2]) for part in range(20) for i in range(3 if part % 3 else 1 + f)]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(tmp_path / f"{f}"))
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for f in range(2):
        next((tmp_path / f"{f}").glob("*.parquet")).rename(folder / f"part-{f}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view lineitem as select * from '{folder}/*.parquet'")
    r = con.execute(catalogue.oracle_sql()[name])
    theirs = [c[0] for c in r.description]
    expected = sorted(repr([plain(row[theirs.index(c)]) for c in sorted(theirs)]) for row in r.fetchall())
    assert rows(catalogue.queries()[name](spark, str(tmp_path))) == (sorted(theirs), expected)
