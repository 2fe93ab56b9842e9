import random

from pyspark.sql import functions as F

from leafledger.operators.running import carried, running_total
from leafledger.operators.spread import spread_join


def brute(rows):
    sums, out = {}, {}
    for group, at, value in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        sums[group] = sums.get(group, 0) + value
        out[group, at] = sums[group]
    return out


def test_hot_group_is_summed_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.randrange(100)) for i in range(2000)]
    rows += [(f"g{i % 300}", i, rng.randrange(100)) for i in range(2000)]
    rows += [(None, i, 5) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at int, v int")
    for buckets in (2, 7, 64):
        got = running_total(df, F.col("v"), ["at"], within=["g"], buckets=buckets)
        assert {(r.g, r.at): r.running for r in got.collect()} == brute(rows)


def test_global_order_over_two_columns(spark):
    rows = [(w, n) for w in ("a", "b\x00c", "b", "é") for n in range(100)]
    df = spark.createDataFrame(rows, "w string, n int")
    got = running_total(df, F.lit(1), ["w", "n"], buckets=9)
    order = [(r.w, r.n) for r in got.orderBy("running").collect()]
    assert order == sorted(rows, key=lambda r: (r[0].encode(), r[1]))
    assert got.agg(F.max("running")).first()[0] == 400


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, at int, v int")
    assert running_total(df, F.col("v"), ["at"], within=["g"]).count() == 0


def test_no_window_holds_the_whole_table(spark):
    df = spark.range(10_000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    plan = running_total(df, F.col("v"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(__bucket" in plan


def test_spread_join(spark):
    big = spark.range(1000).select(F.lit("k").alias("k"), "id")
    small = spark.createDataFrame([("k", 1), ("z", 2)], "k string, v int")
    assert spread_join(big, small, ["k"], F.col("id")).where("v = 1").count() == 1000
    assert "__salt" not in spread_join(big, small, ["k"], F.col("id")).columns


def test_values_are_carried_over_ranges_and_groups(spark):
    rng = random.Random(2)
    rows = [("hot", i, rng.choice((None,) * 30 + ("x", "y", "z"))) for i in range(1500)]
    rows += [(f"g{i % 200}", i, rng.choice((None, None, "u", "v"))) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, at int, v string").repartition(5)
    want, last = {}, {}
    for group, at, value in sorted(rows):
        want[group, at] = last.get(group)
        last[group] = value or last.get(group)
    for buckets in (1, 2, 7, 64):
        got = carried(df, F.col("v"), ["at"], within=["g"], buckets=buckets)
        assert {(r.g, r.at): r.carried for r in got.collect()} == want
    flat, last = {}, None
    for at, value in sorted((r[1], r[2]) for r in rows[:1500]):
        flat[at], last = last, value or last
    for buckets in (1, 3, 40):
        got = carried(df.where("g = 'hot'"), F.col("v"), ["at"], buckets=buckets)
        assert {r.at: r.carried for r in got.collect()} == flat


def test_nothing_runs_while_a_total_is_planned(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    spark.sparkContext.setJobGroup("planning", "planning")
    running_total(df, F.col("v"), ["id"])
    carried(df, F.col("v"), ["id"])
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(started) == 0


def test_groups_that_no_bound_falls_into_are_told_from_two_bounds(spark):
    """A row compares the bounds beside it, not all of them, and no line is asked before it is counted."""
    lines = spark.range(6000).select((F.col("id") % 300).cast("string").alias("g"), (F.col("id") % 3).alias("at"))
    counted = lines.groupBy("g", "at").agg(F.count("*").alias("v"))
    got = running_total(counted, F.col("v"), ["at"], within=["g"], buckets=150)
    assert {(r.g, r.at): r.running for r in got.collect()} == brute([(r.g, r.at, r.v) for r in counted.collect()])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(transform(__bounds" not in plan and "array_contains" not in plan
    below = plan[plan.rindex("Generate explode"):]
    assert "Filter" not in below and "Aggregate" in below
