"""Roll-ups and quality gates: spreads, percentiles, verdicts, regressions, claims, set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs that a group is split into before its ranks are looked for.
BUCKETS = 200


def spread(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by.., metric, min, median, max) of several columns in one pass; NaN doesn't take part."""
    clean = {v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in values}
    aggs = [F.struct(F.lit(v).alias("metric"), F.min(clean[v]).alias("min"), F.percentile(clean[v], F.lit(0.5)).alias("median"), F.max(clean[v]).alias("max")) for v in values]
    return df.groupBy(*by).agg(F.array(*aggs).alias("_m")).select(*by, F.inline("_m"))


def order_statistics(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by.., n, r0, r1 ..): the elements of each group's sorted values at the indexes (n - 1) * share, where those are
    between two, the lower and the upper in turn: r0 and r1 for the first share, and so on. Exact.

    No group is held anywhere: equal values are counted, a sketch splits each group into about BUCKETS runs, their
    totals tell in which run an index lies, and only such runs are sorted.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    grid = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    cuts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.array_distinct(F.percentile_approx(value, grid, 10 * BUCKETS)).alias("_cuts"))
    at = [f((F.col("n") - 1) * F.lit(q)).cast("bigint") for q in shares for f in (F.floor, F.ceil)]
    same = [F.col(c) for c in by]
    placed = counts.join(cuts.withColumn("_at", F.array(*at)), by).withColumn("_run", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))) if by else counts.crossJoin(cuts.withColumn("_at", F.array(*at))).withColumn("_run", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    runs = placed.groupBy(*by, "_run").agg(F.sum("_c").alias("_m"))
    before = runs.withColumn("_before", F.sum("_m").over(Window.partitionBy(*same).orderBy("_run")) - F.col("_m"))
    wanted = placed.join(before, [*by, "_run"]).where(F.exists("_at", lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_m"))))
    last = F.col("_before") + F.sum("_c").over(Window.partitionBy(*same, "_run").orderBy("_v"))
    ends = wanted.withColumn("_last", last)
    pick = [F.max(F.when((F.get("_at", F.lit(i)) < F.col("_last")) & (F.get("_at", F.lit(i)) >= F.col("_last") - F.col("_c")), F.col("_v"))).alias(f"r{i}") for i in range(len(at))]
    return ends.groupBy(*by, "n").agg(*pick)


def percentiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by.., n, p50, p95, p50_rank, p95_rank): interpolated, and the element at the rounded index of the sorted values."""
    o = order_statistics(df, by, value, [0.5, 0.95])
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    between = lambda q, lo, hi: F.col(lo) + (F.col(hi) - F.col(lo)) * (place(q) - F.floor(place(q)))
    nearest = lambda q, lo, hi: F.when(F.rint(place(q)) == F.floor(place(q)), F.col(lo)).otherwise(F.col(hi))
    return o.select(*by, "n", between(0.5, "r0", "r1").alias("p50"), between(0.95, "r2", "r3").alias("p95"), nearest(0.5, "r0", "r1").alias("p50_rank"), nearest(0.95, "r2", "r3").alias("p95_rank"))


def rank_by_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, rank): the largest median first, ties by name; one row a name."""
    o = order_statistics(df, [by], value, [0.5]).select(by, "n", ((F.col("r0") + F.col("r1")) / 2).alias("median"))
    return o.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("median"), by)))


def regressions(df: DataFrame, key: str, anchor: dict[str, Column], higher_is_worse: dict[str, bool]) -> DataFrame:
    """(key, metric, value, anchor, delta) wherever a metric is worse than its anchor; NaN and null never are."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), anchor[m].cast("double").alias("anchor"), F.lit(up).alias("up")) for m, up in higher_is_worse.items()])
    rows = df.select(key, F.inline(cells)).where(~F.isnan("value") & ~F.isnan("anchor"))
    worse = F.when(F.col("up"), F.col("value") > F.col("anchor")).otherwise(F.col("value") < F.col("anchor"))
    return rows.where(worse).select(key, "metric", "value", "anchor", (F.col("value") - F.col("anchor")).alias("delta"))


def gate_verdicts(results: DataFrame, by: Sequence[str], subject: str, rival: str) -> DataFrame:
    """(by.., gate, passed, actual) of B1-B5 for the tool ``subject`` against ``rival``, from one row a tool."""
    of = lambda tool, col: F.max(F.when(F.col("tool_id") == tool, F.col(col)))
    others = F.coalesce(F.max(F.when(F.col("tool_id") != subject, F.col("searchable_without_decode").cast("int"))), F.lit(0))
    own = results.groupBy(*by).agg(
        of(subject, "compression_ratio").alias("r"), of(rival, "compression_ratio").alias("z"), of(subject, "bit_exact_replay").alias("exact"), of(subject, "searchable_without_decode").alias("search"),
        of(subject, "encode_time_ms_p50").alias("enc"), of(subject, "decode_time_ms_p50").alias("dec"), others.alias("others"),
    )
    gate = lambda name, ok, actual: F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), actual.cast("double").alias("actual"))
    c = F.col
    rows = [
        gate("B1", c("r") >= 20.0, c("r")),
        gate("B2", c("r") >= 3.0 * c("z"), c("r") / F.greatest(c("z"), F.lit(1e-12))),
        gate("B3", c("exact") & c("search") & (c("others") == 0), c("exact").cast("int")),
        gate("B4", c("enc") < 100.0, c("enc")),
        gate("B5", c("dec") < 100.0, c("dec")),
    ]
    return own.select(*by, F.inline(F.array(*rows)))


def issues(ratio: Column, anchor: Column, exact: Column, b3: Column) -> Column:
    """Call-outs of a dataset's benchmark, in a fixed order."""
    return F.array_compact(F.array(F.when(ratio < anchor, "ratio below anchor"), F.when(~exact, "replay not bit exact"), F.when(~b3, "B3 open")))


def sweep_status(df: DataFrame, least: int, least_families: int, by: Sequence[str] = ()) -> DataFrame:
    """(by.., datasets, families, issues, status): PASS with enough datasets of enough families, else what is wrong."""
    per = df.groupBy(*by).agg(F.count("*").alias("datasets"), F.countDistinct("family").alias("families"))
    few = F.when(F.col("datasets") < least, F.format_string("%d datasets, %d wanted", "datasets", F.lit(least)))
    alike = F.when(F.col("families") < least_families, F.format_string("%d families, %d wanted", "families", F.lit(least_families)))
    out = per.withColumn("issues", F.array_compact(F.array(few, alike)))
    return out.withColumn("status", F.when(F.size("issues") == 0, "PASS").otherwise("FAIL"))


def claims(df: DataFrame, key: str, metric: str, sense: str, threshold: str) -> DataFrame:
    """Adds ``status`` by comparing a metric with its threshold in the sense >=, <= or ==."""
    m, t, s = F.col(metric), F.col(threshold), F.col(sense)
    ok = F.when(s == ">=", m >= t).when(s == "<=", m <= t).otherwise(m == t)
    return df.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def missing(required: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.join(existing, list(keys), "left_anti")


def is_subset(part: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(missing, is_subset) in one row."""
    return part.select(*keys).distinct().join(whole.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("missing")).withColumn("is_subset", F.col("missing") == 0)


def replay_hash(df: DataFrame, by: Sequence[str], order: Sequence[str], line: Column, chunk: Column) -> DataFrame:
    """(by.., rows, sha256): hash of each group's ordered canonical lines, equal for equal content.

    ``chunk`` cuts a group into runs of the order, each small enough for one task (a key divided by a constant); a run's
    lines are hashed, and the group's hash is that of its runs' hashes in order, 64 characters a run.
    """
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))["line"]
    runs = df.groupBy(*by, chunk.alias("_run")).agg(F.count("*").alias("_n"), F.sha2(F.concat_ws("\n", lines), 256).alias("_h"))
    return runs.groupBy(*by).agg(F.sum("_n").alias("rows"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("_run", "_h")))["_h"]), 256).alias("sha256"))
