"""Every query of the image relations against its SQL, and a few operators against plain Python."""

import math
import random

import duckdb
import pytest

from lumenfold.jobs.queries import ALL, QUERIES
from lumenfold.operators import grid, spatial, stats
from lumenfold.streaming.rollup import hourly_shifts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted([str([value(v) for v in r]) for r in rows])


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ALL.items() if sql))
def test_query_equals_its_sql(spark, sf, duck, name):
    query, sql = ALL[name]
    df = query(spark, sf)
    names = sorted(df.columns)
    there = duck.sql(sql)
    assert names == sorted(there.columns)
    assert plain(df.select(*names).collect()) == plain(duck.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_components_equal_flood_fill(spark, tile):
    rng = random.Random(3)
    mask = {(y, x) for y in range(20) for x in range(20) if rng.random() < 0.35}
    got = {(r.y, r.x): r.label for r in grid.components(spark.createDataFrame([("a", y, x) for y, x in mask], "image string, y long, x long"), tile=tile).collect()}
    left = set(mask)
    while left:
        stack, comp = [min(left)], set()
        while stack:
            p = stack.pop()
            if p in left:
                left.discard(p)
                comp.add(p)
                stack += [(p[0] + dy, p[1] + dx) for dy, dx in grid.OFFSETS8]
        assert {got[p] for p in comp} == {min(y * (1 << 20) + x for y, x in comp)}


def test_hysteresis_keeps_components_with_a_peak(spark):
    px = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 1, 9), ("a", 5, 5, 6), ("a", 9, 9, 1)], "image string, y long, x long, v long")
    assert {(r.y, r.x) for r in grid.hysteresis(px, 5, 9).collect()} == {(0, 0), (0, 1)}


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)]
    df = spark.createDataFrame(pts, "label long, yc double, xc double")
    got = {(r.label_a, r.label_b) for r in spatial.near_pairs(df, df, 7.0).collect()}
    assert got == {(a, b) for a, ya, xa in pts for b, yb, xb in pts if (ya - yb) ** 2 + (xa - xb) ** 2 <= 49}


def test_bh_of_known_values(spark):
    df = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03), (1, 0.5), (1, None)], "f int, p double")
    got = {r.p: round(r.q, 6) for r in stats.benjamini_hochberg(df, "p", "f").collect()}
    assert got == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.5: 0.5}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = hourly_shifts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "400 days")
    q = stream.writeStream.format("memory").queryName("rollup").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r.z, str(r.hour), round(r.rs, 6), r.n) for r in rows)
    assert key(spark.table("rollup").collect()) == key(hourly_shifts(events).collect())


def test_plans_prune_columns(spark, sf):
    plan = ALL["tile_counts"][0](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in plan
