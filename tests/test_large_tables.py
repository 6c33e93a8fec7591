"""Queries on tables whose shape only shows at larger sizes; every test writes its own rows."""

import datetime as dt

import pytest
from compare import compare, duck

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
D0 = dt.datetime(1999, 1, 1)


def market_tables(spark, folder, lines):
    """nation, supplier and lineitem; lines are (part key, supplier key, quantity, unit price, return flag, day)."""
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put([(0, "ALGERIA", 0), (1, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    put([(0, 0), (1, 1)], "s_suppkey long, s_nationkey int", "supplier")
    put([(i, p, s, i % 7 + 1, float(q), float(q * u), f, "F" if i % 2 else "O", D0 + dt.timedelta(days=d) if d is not None else None)
         for i, (p, s, q, u, f, d) in enumerate(lines)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", "lineitem")


def duck_of(folder):
    con = duck(folder)
    for name in ("nation", "supplier", "lineitem"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("key", ["e12_thresholds_zero_aware", "e12_thresholds_quantile"])
@pytest.mark.parametrize("last", [2000, 2010, 9000])
def test_thresholds_with_few_or_no_large_ranges(spark, tmp_path, key, last):
    # 40 equal prices, then one other: no range, or up to five, differ from 0; one of 10 is below the flattening bound
    lines = [(1, 0, 2, 2000, "N", d) for d in range(40)] + [(1, 0, 2, last, "N", 40)]
    market_tables(spark, tmp_path, lines)
    assert compare(spark, duck_of(tmp_path), QUERIES[key], SQL[key], str(tmp_path)) is None


def test_commodity_of_a_file_needs_no_pattern_per_row(spark, tmp_path):
    from granary.sources import tables as S
    names = {"rice": "rice", "commodity=wheat": "wheat", "commodity=": "commodity=", "commodity": "commodity", "red gram": "red gram",
             "commodity=a=b": "a=b"}
    for folder in names:
        (tmp_path / "raw" / folder).mkdir(parents=True)
        (tmp_path / "raw" / folder / "m.csv").write_text("Variety,Market Name\nx,y\nx,\n")
    df = S.read_observations(spark, f"{tmp_path}/raw/*", "Variety string, `Market Name` string")
    pattern = df.selectExpr("commodity", "regexp_extract(_metadata.file_path, '(?:commodity=)?([^/]+)/[^/]+$', 1) AS old")
    found = [tuple(r) for r in pattern.collect()]
    assert {a.replace("%20", " ") for a, _ in found} == set(names.values()) and len(found) == 2 * len(names)
    assert all(a == b for a, b in found)
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_written_market_files_are_read_like_the_raw_rows(spark, tmp_path):
    lines = [(p, p % 2, 1 + p % 5, 100 + p, "NRA"[p % 3], p % 400) for p in range(300)]
    market_tables(spark, tmp_path, lines + lines[:50])
    key = "a01_read_observations"
    assert compare(spark, duck_of(tmp_path), QUERIES[key], SQL[key], str(tmp_path)) is None
