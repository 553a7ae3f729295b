"""Running totals against a plain loop, by value of a dense order and by sampled splitters of any order."""

import random

import pytest
from pyspark.sql import functions as F

from wirelens.operators.reframe import reframe
from wirelens.operators.scan import running, values_at
from wirelens.operators.verify import refresh_rate


def truth(rows):
    state, out = {}, {}
    for k, j, o, v in sorted(rows, key=lambda r: (str(r[0]), str(r[1]), r[2])):
        total, top = state.get((k, j), (0, None))
        out[k, j, o] = (total, top)
        state[k, j] = (total + (v or 0), top if v is None else v if top is None else max(top, v))
    return out


def made(seed, n, orders):
    rng = random.Random(seed)
    rows = {}
    for o in orders:
        k = rng.choice(["hot", "hot", "hot", "a", "b", None])
        j = rng.choice([1, 1, None])
        rows[k, j, o] = (k, j, o, rng.choice([None, rng.randrange(-50, 1000)]))
    return list(rows.values())


@pytest.mark.parametrize("chunk", [None, 7, 65_536])
def test_running_totals(spark, chunk):
    rows = made(4, 900, range(900))
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, j int, o long, v long, `a b` string").repartition(5)
    out = running(df, ["k", "j"], "o", {"total": ("sum", F.coalesce("v", F.lit(0))), "top": ("max", F.col("v"))}, chunk)
    assert out.columns == [*df.columns, "total", "top"]
    assert {(r.k, r.j, r.o): (r.total, r.top) for r in out.collect()} == truth(rows)
    assert running(df.limit(0), ["k", "j"], "o", {"total": ("sum", F.col("v"))}, chunk).collect() == []


def test_time_stamps_as_order_are_spread(spark):
    """Stamps in microseconds, most in one burst, one key with nearly all rows: chunks by value would be one each, or one for all."""
    rng = random.Random(8)
    orders = [1_700_000_000_000_000 + (rng.randrange(3_000) if i % 5 else rng.randrange(10**12)) * 7 + i for i in range(4000)]
    rows = made(8, 4000, sorted(set(orders)))
    df = spark.createDataFrame(rows, "k string, j int, o long, v long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = running(df, ["k", "j"], "o", {"total": ("sum", F.coalesce("v", F.lit(0))), "top": ("max", F.col("v"))}, None)
        assert {(r.k, r.j, r.o): (r.total, r.top) for r in out.collect()} == truth(rows)
        shares = [r["count"] for r in spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()}).groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(shares) == 8 and max(shares) <= 2 * len(rows) / 8


def test_operators_over_sampled_cuts(spark):
    rng = random.Random(3)
    stamps = sorted(rng.sample(range(10**9), 300))
    chunks = spark.createDataFrame([("c" if i % 3 else "d", o, bytearray(rng.randbytes(rng.randrange(0, 30)))) for i, o in enumerate(stamps)], "connection_id string, seq long, chunk binary")
    chunks = chunks.withColumn("ts", F.timestamp_millis("seq"))
    plain = lambda df: sorted((r.connection_id, r.frame_no, bytes(r.payload)) for r in df.collect())
    assert plain(reframe(chunks, 16, chunk=None)[0]) == plain(reframe(chunks, 16)[0])
    times = [(("m", i, i * 40 - rng.randrange(500)) if i != 9 else ("m", 9, 4_102_444_800_000)) for i in range(20, 400)]
    df = spark.createDataFrame(times, "message string, packet_no long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    rates = lambda **o: sorted((r.packet_no, r.refresh_hz) for r in refresh_rate(df, ("message",), exact=True, **o).collect())
    assert rates(chunk=None) == rates(chunk=32)


def test_values_at_shares_are_exact(spark):
    """As ``percentile_disc``, without a task that holds every distinct value."""
    rng = random.Random(3)
    for n, span in ((1, 5), (7, 100), (10, 10**15), (100, 50), (997, 10**13)):
        values = [rng.randrange(-span, span) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x long")
        shares = [0.0, 0.125, 0.4, 0.5, 0.875, 1.0]
        want = df.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)") for q in shares]).first()
        assert values_at(df, F.col("x"), shares) == [int(v) for v in want]
    assert values_at(spark.createDataFrame([(None,)], "x long"), F.col("x"), [0.5]) == [None]


def test_landing_steps_make_no_exact_percentile(spark, tmp_path, monkeypatch):
    """Cuts of the live queries hold no table of all distinct stamps."""
    from wirelens.plans import queries

    def refused(text):
        assert "percentile" not in text
        return expr(text)

    expr = F.expr
    monkeypatch.setattr(F, "expr", refused)
    rows = spark.range(100).select("id", F.timestamp_seconds("id").alias("ts"))
    seen = []
    queries._in_steps(spark, rows, "ts", str(tmp_path / "in"), lambda stream: seen.append(spark.read.parquet(str(tmp_path / "in")).count()))
    assert seen == [24, 49, 74, 100]


def test_exact_rates_move_rows_fewer_times(spark):
    rows = spark.range(50).select(F.lit("m").alias("message"), F.col("id").alias("packet_no"), F.timestamp_millis(F.col("id") * 7).alias("ts"))
    out = refresh_rate(rows, ("message",), exact=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 10


def test_exact_rates_of_equal_packet_numbers(spark):
    """Packets of one number count in order of time, and none is lost."""
    rows = [("m", n // 3, 1000 * n + 17 * (n % 3)) for n in range(60)]
    df = spark.createDataFrame(rows[::-1], "message string, packet_no long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = refresh_rate(df, ("message",), window_ms=5000, exact=True, chunk=4)
    want = [sum(1 for r in rows[: i + 1] if r[2] >= rows[i][2] - 5000) for i in range(60)]
    assert [r.refresh_hz for r in got.orderBy("ms").collect()] == want
