"""Usage, feedback, A/B and quality aggregates."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def daily_usage(events: DataFrame) -> DataFrame:
    """day, queries, users, value: one partial aggregation, one shuffle by day."""
    return events.groupBy(day_of(F.col("ts")).alias("day")).agg(F.count("*").alias("queries"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


#: Ranges that a group's values are dealt into before any are put in order.
RANGES = 1024


def ranges_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, times and range: distinct values with their counts, dealt evenly between the group's extremes."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    ends = counted.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    place = F.coalesce(F.try_divide((F.col(value) - F.col("_low")) * RANGES, F.col("_high") - F.col("_low")), F.lit(0.0))
    return counted.join(ends, by).withColumn("range", F.least(F.lit(RANGES - 1), F.floor(place)).cast("int")).drop("_low", "_high")


def percentile(df: DataFrame, by: list[str], value: str, qs: dict[str, tuple[float, int]]) -> DataFrame:
    """sorted[min(int(n * q), n - 1)] by group, and 0 up to a number of values (name -> (q, number)).

    Equal values are counted, and the counts dealt into RANGES ranges; only the
    ranges that hold a wanted place are put in order. So no task orders a whole
    group, however large one is.
    """
    spread = ranges_of(df, by, value)
    sums = spread.groupBy(*by, "range").agg(F.sum("times").alias("rows"))
    w = Window.partitionBy(*by)
    sums = sums.withColumn("upto", F.sum("rows").over(w.orderBy("range"))).withColumn("n", F.sum("rows").over(w))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.lit(few).alias("few")) for name, (q, few) in qs.items()])
    asked = sums.withColumn("x", F.explode(wanted)).withColumn("place", F.least(F.floor(F.col("n") * F.col("x.q")), F.col("n") - 1))
    asked = asked.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("rows")))
    asked = asked.select(*by, "range", "x.name", "x.few", "n", (F.col("place") - F.col("upto") + F.col("rows")).alias("inside"))
    ordered = spread.join(asked, [*by, "range"]).withColumn("end", F.sum("times").over(Window.partitionBy(*by, "range", "name").orderBy(value)))
    hit = ordered.where((F.col("inside") < F.col("end")) & (F.col("inside") >= F.col("end") - F.col("times")))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.when(F.col("n") > F.col("few"), F.col(value)).otherwise(F.lit(0.0)))).alias(name) for name in qs])


def trend(current: Column, previous: Column) -> Column:
    """Change in per cent as text; a zero baseline gives +∞% or 0%."""
    change = F.round((current - previous) * 100 / previous)
    return F.when(previous == 0, F.when(current > 0, "+∞%").otherwise("0%")).otherwise(F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("long"), F.lit("%")))


def metric_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.sum(v), 4).alias("sum"))


def effect_size(df: DataFrame, variant: str, value: str, a: str, b: str) -> DataFrame:
    """Cohen's d of variant b against a, with a pooled deviation; 0 where it is not defined."""
    side = lambda name, p: [F.avg(F.when(F.col(variant) == name, F.col(value))).alias(f"m{p}"), F.var_samp(F.when(F.col(variant) == name, F.col(value))).alias(f"v{p}"), F.count_if(F.col(variant) == name).alias(f"n{p}")]
    s = df.agg(*side(a, 1), *side(b, 2))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return s.select(F.round(F.coalesce(F.try_divide(F.col("m2") - F.col("m1"), pooled), F.lit(0.0)), 6).alias("d"), "n1", "n2")


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        step = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * (f - 1)


def p_value(t: float, df: float) -> float:
    """Two-tailed chance of a t statistic."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def welch(df: DataFrame, variant: str, value: str, a: str, b: str) -> DataFrame:
    """t, df and two-tailed p of two variants; p is 1 for equal means or no spread."""
    @F.pandas_udf("double")
    def chance(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([p_value(x, y) for x, y in zip(t, d, strict=True)])

    side = lambda name, p: [F.avg(F.when(F.col(variant) == name, F.col(value))).alias(f"m{p}"), F.var_samp(F.when(F.col(variant) == name, F.col(value))).alias(f"v{p}"), F.count_if(F.col(variant) == name).alias(f"n{p}")]
    s = df.agg(*side(a, 1), *side(b, 2)).withColumn("e1", F.col("v1") / F.col("n1")).withColumn("e2", F.col("v2") / F.col("n2"))
    se = F.sqrt(F.col("e1") + F.col("e2"))
    s = s.withColumn("t", F.coalesce(F.try_divide(F.col("m1") - F.col("m2"), se), F.lit(0.0)))
    free = F.try_divide((F.col("e1") + F.col("e2")) ** 2, F.col("e1") ** 2 / (F.col("n1") - 1) + F.col("e2") ** 2 / (F.col("n2") - 1))
    s = s.withColumn("df", F.coalesce(free, F.col("n1") + F.col("n2") - 2.0))
    return s.select(F.round("t", 6).alias("t"), F.round("df", 6).alias("df"), F.round(F.when(F.col("t") == 0, 1.0).otherwise(chance("t", "df")), 6).alias("p"))


def routed(key: Column, weights: dict[str, float]) -> Column:
    """A variant for a key: its hash's place among the cumulative weights. The same key, the same variant."""
    place = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 10_000 / 10_000
    total, upto, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        upto += w / total
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return out.otherwise(list(weights)[-1])


def ranges_in_order(df: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """df with _range: rows dealt by groups and their order into ranges of like size, written once.

    A group of any size is spread over as many ranges as its rows need; all rows
    of a range come before those of the next.
    """
    dealt = df.repartitionByRange(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, *order)
    return stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """df with its keys renamed, and the condition that joins it to rows that have them, nulls included."""
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with running sums (name -> value) over each group in order, the row's own value included.

    Sums are taken inside ranges, and the totals of the ranges before are added:
    one number for each range and group, so no task sees a whole group. order
    must tell rows of a group apart.
    """
    values = {f"_{name}": value for name, value in sums.items()}
    rows = ranges_in_order(df.withColumns(values), by, order, parts)
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_sum{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_sum{v}").over(before), F.lit(0)).alias(f"_base{v}") for v in values])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_own{v}": F.sum(v).over(inside) for v in values})
    met = own.join(*keyed(totals, [*by, "_range"]))
    return met.select(*df.columns, *[(F.col(f"_own_{name}") + F.col(f"_base_{name}")).alias(name) for name in sums])


def carried(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with the last value that is not null of the rows before each row of a group, over ranges as running does."""
    rows = ranges_in_order(df.withColumn("_value", value), by, order, parts)
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    near = rows.withColumn("_near", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    near = near.withColumn("_upto", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(inside)).withColumn("_n", F.count("*").over(Window.partitionBy(*by, "_range")))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = near.where("_r = _n").select(*by, "_range", F.last("_upto", ignorenulls=True).over(before).alias("_far"))
    met = near.join(*keyed(ends, [*by, "_range"]))
    return met.select(*df.columns, F.coalesce("_near", "_far").alias(name))


def seeded_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """df with part: rows put in the order of a seeded hash of key and cut at the shares, the last part taking the rest.

    Sizes are exact (int(rows * share)) and, like the order, do not hang on how
    the rows are dealt. Rows are counted by the first four hexadecimal digits of
    their hash; only rows of the few prefixes in which a cut falls are put in
    order. Rows of one key are one after the other.
    """
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    hashed = df.withColumn("_hash", own).withColumn("_prefix", F.substring("_hash", 1, 4))
    counts = {r["_prefix"]: r["count"] for r in hashed.groupBy("_prefix").count().collect()}  # 65,536 rows at most
    total, upto, ends = sum(counts.values()), 0, []
    for share in list(shares.values())[:-1]:
        upto += int(total * share)
        ends.append(upto)
    names, cut, whole, before = list(shares), {}, [], 0
    for prefix in sorted(counts):
        part = sum(e <= before for e in ends)
        if part == sum(e < before + counts[prefix] for e in ends):
            whole.append((prefix, names[part]))
        else:
            cut[prefix] = before
        before += counts[prefix]
    spark = df.sparkSession
    told = hashed.join(F.broadcast(spark.createDataFrame(whole, "_prefix string, part string")), "_prefix").select(*df.columns, "part")
    starts = spark.createDataFrame(list(cut.items()), "_prefix string, _start long")
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash", key)) - 1
    ranked = hashed.join(F.broadcast(starts), "_prefix").withColumn("_place", place)
    part = F.lit(names[-1])
    for name, end in reversed(list(zip(names, ends, strict=False))):
        part = F.when(F.col("_place") < end, name).otherwise(part)
    return told.unionByName(ranked.withColumn("part", part).select(*df.columns, "part"))


def compared(df: DataFrame, variant: str, value: str, a: str, b: str) -> DataFrame:
    """One row: mean, std and count of both variants, two-tailed p, significant (p under 0.05) and effect (Cohen's d of b against a).

    p and effect need two values of each variant; without them they are null
    and significant is false. Values that are null do not count.
    """
    side = lambda name, p: [f(F.when(F.col(variant) == name, F.col(value))).alias(f"{n}_{p}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
    stats = df.where(F.col(value).isNotNull()).agg(*side(a, "a"), *side(b, "b"))
    kept = df.where(F.col(value).isNotNull())
    p = welch(kept, variant, value, a, b).select("p")
    d = effect_size(kept, variant, value, a, b).select(F.col("d").alias("effect"))
    enough = (F.col("count_a") >= 2) & (F.col("count_b") >= 2)
    rows = stats.crossJoin(p).crossJoin(d)  # one row each
    return rows.select(
        *[F.round(F.col(c), 6).alias(c) for c in ("mean_a", "mean_b")], *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("std_a", "std_b")], "count_a", "count_b",
        F.when(enough, F.col("p")).alias("p"), F.coalesce(enough & (F.col("p") < 0.05), F.lit(False)).alias("significant"), F.when(enough, F.col("effect")).alias("effect"),
    )


def trial_report(df: DataFrame, variant: str, metrics: list[str], weights: dict[str, float]) -> DataFrame:
    """variant, trials, total_trials, weight, metric and its count, mean, std, min and max, for each variant and metric.

    A row of df is a trial; weights names the shares of traffic, 1 where a
    variant has none. Metrics without a value in a variant have no row.
    """
    long = df.select(F.col(variant).alias("variant"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"))
    stats = metric_stats(long.select("variant", "x.*").where("value is not null"), ["variant", "metric"], "value")
    trials = df.groupBy(F.col(variant).alias("_variant")).agg(F.count("*").alias("trials"))
    total = trials.agg(F.sum("trials").alias("total_trials"))  # one row
    known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
    weight = F.coalesce(F.try_element_at(known, F.col("variant")), F.lit(1.0))
    return stats.join(trials, F.col("variant").eqNullSafe(F.col("_variant"))).crossJoin(F.broadcast(total)).select("variant", "trials", "total_trials", weight.alias("weight"), "metric", "n", "mean", "std", "min", "max")


def open_tasks(df: DataFrame, kinds: list[str], order: str) -> DataFrame:
    """status, tasks, ids: tasks (task, status, ts) whose last status by ts and order is one of kinds, the longest waiting first."""
    last = df.groupBy("task").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", order)).alias("x")).select("task", "x.*").where(F.col("status").isin(kinds))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "task"))), lambda s: s["task"].cast("string"))
    return last.groupBy("status").agg(F.count("*").alias("tasks"), F.array_join(ids, ",").alias("ids"))
