"""Queries on search, evaluation, datasets, reports, containers and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace import fixtures
from kinetrace.functions import columns
from kinetrace.functions.columns import rounded
from kinetrace.operators import anomaly, datasets, evaluation, frames, reports, search, spectral, tokens
from kinetrace.plans.motion import REC_SQL, dft_sql, events, paths, suppliers
from kinetrace.plans.registry import EVENTS_SQL, FLEET_SQL, HIST_SQL, KINETICS_SQL, PATHS_SQL, STEPS_SQL, SUPPLIER_SQL, TOKENS_SQL, query, table
from kinetrace.session import shared_dir
from kinetrace.sources import bags, datasource, files, packets
from kinetrace.streaming import monitor


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("traj_id"), "label", F.col("embedding").alias("vec"))


_VEC_SQL = "e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
_MEAN_SQL = "mu AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)"


@query(
    "shape_signature",
    f"""WITH {PATHS_SQL}, c AS (SELECT traj_id, frame, x0 - avg(x0) OVER w AS c0, x1 - avg(x1) OVER w AS c1 FROM p WINDOW w AS (PARTITION BY traj_id)),
s AS (SELECT *, greatest(sqrt(avg(c0 * c0 + c1 * c1) OVER (PARTITION BY traj_id)), 1e-12) AS size FROM c) SELECT traj_id, frame, round(c0 / size, 6) + 0.0 AS s0, round(c1 / size, 6) + 0.0 AS s1 FROM s""",
)
def shape_signature(spark: SparkSession, d: str) -> DataFrame:
    return search.signature(paths(spark, d)).select("traj_id", "frame", rounded("s0", 6).alias("s0"), rounded("s1", 6).alias("s1"))


@query(
    "cosine_topk",
    f"""WITH {_VEC_SQL}, {_MEAN_SQL},
s AS (SELECT mu.label AS query, e.vec_id AS traj_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) + 0.0 AS score FROM e JOIN mu USING (i) GROUP BY mu.label, e.vec_id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, traj_id)::INTEGER AS rank, traj_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, traj_id) <= 10""",
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    means = evaluation.centroids(v, "label", "vec").select(F.col("label").alias("query"), F.col("vec").alias("qvec"))
    return search.cosine_topk(v, means)


@query(
    "knn_precision_at_k",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings),
n AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(array_distance(a.v, b.v) ** 2 / 64, 12), b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id),
q AS (SELECT vec_id, label, count(*) FILTER (other = label) / 10 AS p FROM n WHERE r <= 10 GROUP BY vec_id, label)
SELECT label::BIGINT AS label, count(*) AS queries, round(avg(p), 6) AS precision FROM q GROUP BY label""",
)
def knn_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    near = search.nearest(v, v, 10, "vec_id", "embedding", "label")
    return evaluation.precision_at_k(near, 10, ["query_label"]).select(F.col("query_label").alias("label"), "queries", rounded("precision", 6).alias("precision"))


@query(
    "pairwise_cosine_theta",
    f"""WITH {_VEC_SQL}, {_MEAN_SQL} SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) + 0.0 AS cosine FROM mu a JOIN mu b ON a.label < b.label AND a.i = b.i GROUP BY a.label, b.label""",
)
def pairwise_cosine_theta(spark: SparkSession, d: str) -> DataFrame:
    return search.pairwise_cosine(evaluation.centroids(vectors(spark, d), "label", "vec")).withColumn("cosine", rounded("cosine", 6))


@query(
    "corpus_consistency",
    f"""WITH {_VEC_SQL}, {_MEAN_SQL}, c AS (SELECT sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS c FROM mu a JOIN mu b ON a.label < b.label AND a.i = b.i GROUP BY a.label, b.label)
SELECT count(*) AS pairs, round(avg(c), 6) + 0.0 AS consistency, CASE WHEN (SELECT count(DISTINCT label) FROM embeddings) >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
)
def corpus_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Mean pairwise cosine of the corpora's mean vectors; meaningful with two corpora at least."""
    pairs = search.pairwise_cosine(evaluation.centroids(vectors(spark, d), "label", "vec"))
    return pairs.agg(F.count("*").alias("pairs"), rounded(F.avg("cosine"), 6).alias("consistency")).withColumn("status", F.when(F.col("pairs") >= 1, "PASS").otherwise("FAIL"))


_SPLIT_SQL = """sp AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.7::DOUBLE)) AS is_train FROM embeddings)"""


@query("train_test_split", f"WITH {_SPLIT_SQL} SELECT label, is_train, count(*) AS n, min(vec_id) AS first_id FROM sp GROUP BY ALL")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.split(vectors(spark, d), "label", "traj_id").groupBy("label", "is_train").agg(F.count("*").alias("n"), F.min("traj_id").alias("first_id"))


@query(
    "centroid_accuracy",
    f"""WITH {_VEC_SQL}, {_SPLIT_SQL}, mu AS (SELECT e.label, i, avg(x) AS m FROM e JOIN sp ON sp.vec_id = e.vec_id AND is_train GROUP BY e.label, i),
s AS (SELECT e.vec_id, e.label, mu.label AS candidate, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 9) AS score FROM e JOIN sp ON sp.vec_id = e.vec_id AND NOT is_train JOIN mu USING (i) GROUP BY e.vec_id, e.label, mu.label),
b AS (SELECT vec_id, label, candidate FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) = 1)
SELECT label, count(*) AS n, count(*) FILTER (label = candidate) AS correct, round(avg((label = candidate)::INTEGER), 6) AS accuracy FROM b GROUP BY label""",
)
def centroid_accuracy(spark: SparkSession, d: str) -> DataFrame:
    v = evaluation.split(vectors(spark, d), "label", "traj_id")
    found = evaluation.classify(v.where("not is_train"), evaluation.centroids(v.where("is_train"), "label", "vec"), "traj_id", "label", "vec")
    return evaluation.accuracy(found, ["label"]).withColumn("accuracy", rounded("accuracy", 6))


def _token_text(labelled: str) -> str:
    return f"(SELECT string_agg(chr((token + 65)::INTEGER), '' ORDER BY frame) FROM {labelled})"


@query(
    "best_prefix_overlap",
    f"""WITH {PATHS_SQL}, {STEPS_SQL}, tx AS (SELECT traj_id, label, string_agg(chr(token + 65), '' ORDER BY frame) AS s FROM pt GROUP BY traj_id, label), q AS (SELECT label, min_by(s, traj_id) AS q FROM tx GROUP BY label),
st AS (SELECT traj_id, label, q, substr(s, i::INTEGER, 99) AS rest FROM (SELECT traj_id, q.label, s, q, unnest(range(1, length(s) + 1)) AS i FROM tx CROSS JOIN q)),
ov AS (SELECT traj_id, label, q, (SELECT count(*) FROM (SELECT unnest(range(1, length(q) + 1)) AS k) WHERE k <= length(rest) AND substr(rest, 1, k::INTEGER) = substr(q, 1, k::INTEGER)) AS o FROM st)
SELECT traj_id, label AS query, round(max(o) / length(any_value(q)), 6) AS overlap FROM ov GROUP BY traj_id, label""",
)
def best_prefix_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Every path against one path a label, the label's first (a side of as many rows as there are labels)."""
    text = search.features(paths(spark, d)).select("traj_id", "tokens")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("traj_id"), "label")
    asked = text.join(labels, "traj_id").groupBy(F.col("label").alias("query")).agg(F.min_by("tokens", "traj_id").alias("q"))
    return text.crossJoin(asked).select("traj_id", "query", rounded(search.prefix_overlap(F.col("tokens"), F.col("q")), 6).alias("overlap"))


def _prototype_values() -> str:
    rows = [f"({i}, {f}, {p[0]!r}::DOUBLE, {p[1]!r}::DOUBLE)" for i, label in enumerate(search.LABELS[:5]) for f, p in enumerate(np.round(search._prototype(label), 12).tolist())]
    return ", ".join(rows)


def _features_sql(src: str, x: str) -> str:
    return f"""{x}s AS (SELECT traj_id, frame, x0, x1, round(x0 - lag(x0) OVER w, 9) + 0.0::DOUBLE AS d0, round(x1 - lag(x1) OVER w, 9) + 0.0::DOUBLE AS d1 FROM {src} WINDOW w AS (PARTITION BY traj_id ORDER BY frame)),
{x}m AS (SELECT *, round(sqrt(d0 * d0 + d1 * d1), 9) + 0.0::DOUBLE AS m, floor((atan2(d1, d0) + pi()) / (2 * pi()) * 8)::INTEGER % 8 AS direction FROM {x}s WHERE frame > 0),
{x}q AS (SELECT traj_id, quantile_cont(m, 0.33::DOUBLE) AS q1, quantile_cont(m, 0.66::DOUBLE) AS q2 FROM {x}m GROUP BY traj_id),
{x}t AS (SELECT traj_id, frame, direction * 3 + (m >= q1)::INTEGER + (m >= q2)::INTEGER AS token FROM {x}m JOIN {x}q USING (traj_id)),
{x}text AS (SELECT traj_id, string_agg(chr((token + 65)::INTEGER), '' ORDER BY frame) AS s FROM {x}t GROUP BY traj_id),
{x}h AS (SELECT traj_id, token, count(*) / any_value(n) AS f FROM (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM {x}t) GROUP BY traj_id, token),
{x}c AS (SELECT traj_id, frame, x0 - avg(x0) OVER w AS c0, x1 - avg(x1) OVER w AS c1 FROM {src} WINDOW w AS (PARTITION BY traj_id))"""


_SEARCH_SQL = f"""WITH {PATHS_SQL}, n AS (SELECT traj_id, count(*) AS n FROM p GROUP BY traj_id),
pos AS (SELECT traj_id, t, t * (n - 1) / 95.0::DOUBLE AS u FROM n CROSS JOIN (SELECT unnest(range(0, 96)) AS t)),
lib AS (SELECT pos.traj_id, t AS frame, a.x0 + (u - floor(u)) * (coalesce(b.x0, a.x0) - a.x0) AS x0, a.x1 + (u - floor(u)) * (coalesce(b.x1, a.x1) - a.x1) AS x1
  FROM pos JOIN p a ON a.traj_id = pos.traj_id AND a.frame = floor(u) LEFT JOIN p b ON b.traj_id = pos.traj_id AND b.frame = floor(u) + 1),
proto(traj_id, frame, x0, x1) AS (VALUES {_prototype_values()}),
{_features_sql("lib", "l")}, {_features_sql("proto", "r")},
hc AS (SELECT a.traj_id, r.traj_id AS template, (SELECT coalesce(sum(x.f * y.f), 0) FROM lh x JOIN rh y USING (token) WHERE x.traj_id = a.traj_id AND y.traj_id = r.traj_id)
  / (SELECT sqrt(sum(f * f)) FROM lh WHERE traj_id = a.traj_id) / (SELECT sqrt(sum(f * f)) FROM rh WHERE traj_id = r.traj_id) AS hist FROM (SELECT DISTINCT traj_id FROM lh) a CROSS JOIN (SELECT DISTINCT traj_id FROM rh) r),
sc AS (SELECT a.traj_id, b.traj_id AS template, sum(a.c0 * b.c0 + a.c1 * b.c1) / (sqrt(sum(a.c0 * a.c0 + a.c1 * a.c1)) * sqrt(sum(b.c0 * b.c0 + b.c1 * b.c1))) AS shape FROM lc a JOIN rc b USING (frame) GROUP BY a.traj_id, b.traj_id),
oc AS (SELECT a.traj_id, b.traj_id AS template, len(list_filter(range(1, length(b.s) + 1), lambda k: contains(a.s, substr(b.s, 1, k::INTEGER)))) / length(b.s) AS prefix FROM ltext a CROSS JOIN rtext b),
z AS (SELECT template, traj_id, round(0.5::DOUBLE * hist + 0.35::DOUBLE * shape + 0.15::DOUBLE * prefix, 6) + 0.0 AS score FROM hc JOIN sc USING (traj_id, template) JOIN oc USING (traj_id, template))
SELECT template::BIGINT AS template, row_number() OVER (PARTITION BY template ORDER BY score DESC, traj_id)::INTEGER AS rank, traj_id, score FROM z QUALIFY row_number() OVER (PARTITION BY template ORDER BY score DESC, traj_id) <= 10"""


@query("template_search", _SEARCH_SQL)
def template_search(spark: SparkSession, d: str) -> DataFrame:
    """Paths brought to the prototypes' 96 frames, scored against the five templates."""
    index = search.features(frames.resample(paths(spark, d), search.PROTOTYPE_FRAMES))
    asked = search.features(search.prototype_frames(spark, search.LABELS[:5]))
    return search.template_search(index, asked).select("template", "rank", "traj_id", "score")


# datasets


@query(
    "sequence_check",
    """WITH p AS (SELECT l_orderkey, l_linenumber - 1 <> row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS bad FROM lineitem)
SELECT l_orderkey, count(*) AS records, count(*) FILTER (bad) AS violations FROM p GROUP BY l_orderkey""",
)
def sequence_check(spark: SparkSession, d: str) -> DataFrame:
    return frames.order_violations(table(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], F.col("l_linenumber") - 1)


@query(
    "bag_index_left_join",
    """WITH ix AS (SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_linenumber > 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1)
SELECT o_orderkey, o_custkey, coalesce(l_quantity, 1.0)::DOUBLE AS quality, coalesce(l_returnflag, 'none') AS encoding FROM orders LEFT JOIN ix ON l_orderkey = o_orderkey""",
)
def bag_index_left_join(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    index = table(spark, d, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quality"), F.col("l_returnflag").alias("encoding"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    return datasets.attach_index(messages, index, ["o_orderkey"], order, {"quality": F.lit(1.0), "encoding": F.lit("none")})


@query(
    "episode_longest",
    """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, user_id, n FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) = 1""",
)
def episode_longest(spark: SparkSession, d: str) -> DataFrame:
    return datasets.longest_series(table(spark, d, "events"), ["event_type"], "user_id")


_REPO_SQL = """r AS (SELECT p_partkey, replace(p_brand || '/' || lower(p_type), ' ', '_') AS repo_id, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size % 5 + 1 END::BIGINT AS parquet_count,
  CASE WHEN p_size % 3 = 0 THEN p_size % 9 END AS state_width, p_size % 14 AS action_width FROM part)"""
_REAL, _SIM = ("brass", "steel", "economy", "copper"), ("small", "promo")


def _repos(spark: SparkSession, d: str) -> DataFrame:
    p, size = table(spark, d, "part"), F.col("p_size")
    return p.select(
        "p_partkey", F.replace(F.concat("p_brand", F.lit("/"), F.lower("p_type")), F.lit(" "), F.lit("_")).alias("repo_id"),
        F.when(size % 10 == 0, 0).otherwise(size % 5 + 1).cast("bigint").alias("parquet_count"), F.when(size % 3 == 0, size % 9).alias("state_width"), (size % 14).alias("action_width"),
    )


@query(
    "qualify_rules",
    f"""WITH {_REPO_SQL}, f AS (SELECT *, CASE WHEN state_width >= 6 THEN 'observation.state' WHEN action_width >= 6 THEN 'action'
  WHEN coalesce(state_width, 0) > 0 AND state_width >= action_width THEN 'observation.state' WHEN action_width > 0 THEN 'action' END AS field,
  NOT (contains(lower(repo_id), 'small') OR contains(lower(repo_id), 'promo')) AND (contains(lower(repo_id), 'brass') OR contains(lower(repo_id), 'steel') OR contains(lower(repo_id), 'economy') OR contains(lower(repo_id), 'copper')) AS is_real FROM r),
w AS (SELECT *, CASE field WHEN 'observation.state' THEN state_width WHEN 'action' THEN action_width ELSE 0 END AS width FROM f),
g AS (SELECT *, CASE WHEN parquet_count = 0 THEN 'NO_DATA_PARQUET' WHEN field IS NULL OR width < 6 THEN 'INSUFFICIENT_JOINT_DIM_LT_6' WHEN NOT is_real THEN 'NOT_REAL_DATASET' ELSE 'QUALIFIED' END AS reason FROM w)
SELECT p_partkey, repo_id, parquet_count, CASE WHEN parquet_count > 0 THEN field END AS selected_field, CASE WHEN parquet_count > 0 THEN width ELSE 0 END::INTEGER AS joint_count, is_real, reason, reason = 'QUALIFIED' AS qualifies FROM g""",
)
def qualify_rules(spark: SparkSession, d: str) -> DataFrame:
    q = datasets.qualify(_repos(spark, d), 6, True, _REAL, _SIM)
    return q.select("p_partkey", "repo_id", "parquet_count", "selected_field", "joint_count", "is_real", "reason", "qualifies")


_FAMILIES = (("brass", "brass"), ("tin", "tin"), ("copper", "copper"), ("nickel", "nickel"))


@query(
    "dataset_families",
    f"""WITH {_REPO_SQL} SELECT CASE WHEN contains(lower(repo_id), 'brass') THEN 'brass' WHEN contains(lower(repo_id), 'tin') THEN 'tin' WHEN contains(lower(repo_id), 'copper') THEN 'copper' WHEN contains(lower(repo_id), 'nickel') THEN 'nickel'
  ELSE list_extract(string_split(replace(replace(lower(repo_id), '/', '__'), '-', '_'), '__'), -1) END AS family, count(*) AS datasets FROM r GROUP BY 1""",
)
def dataset_families(spark: SparkSession, d: str) -> DataFrame:
    return _repos(spark, d).groupBy(datasets.family(F.col("repo_id"), _FAMILIES).alias("family")).agg(F.count("*").alias("datasets"))


@query(
    "sweep_rollup",
    f"""WITH {_REPO_SQL}, g AS (SELECT split_part(upper(repo_id), '/', 1) AS brand, count(*) AS datasets, count(DISTINCT list_extract(string_split(replace(replace(lower(repo_id), '/', '__'), '-', '_'), '__'), -1)) AS families FROM r GROUP BY brand),
i AS (SELECT *, concat_ws('; ', CASE WHEN datasets < 84 THEN datasets || ' datasets, 84 wanted' END, CASE WHEN families < 60 THEN families || ' families, 60 wanted' END) AS issues FROM g)
SELECT *, CASE WHEN issues = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM i""",
)
def sweep_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A roll-up a brand, with what is wrong; both verdicts occur."""
    r = _repos(spark, d).select(F.split_part(F.upper("repo_id"), F.lit("/"), F.lit(1)).alias("brand"), datasets.family(F.col("repo_id"), ()).alias("family"))
    return reports.sweep_status(r, 84, 60, ["brand"]).withColumn("issues", F.concat_ws("; ", "issues"))


@query(
    "file_plan_budget",
    """WITH f AS (SELECT p_brand, p_name || '-' || p_partkey AS path, p_size::BIGINT AS size, p_partkey % 17 = 0 AS is_info FROM part),
o AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS s, coalesce(sum(CASE WHEN is_info THEN size END) OVER (PARTITION BY p_brand), 0) AS i FROM f WINDOW w AS (PARTITION BY p_brand, is_info ORDER BY size, path ROWS UNBOUNDED PRECEDING))
SELECT p_brand, path, size, is_info FROM o WHERE is_info OR (n <= 4 AND s + i <= 120)""",
)
def file_plan_budget(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select("p_brand", F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("bigint").alias("size"), (F.col("p_partkey") % 17 == 0).alias("is_info"))
    return datasets.plan_files(files, ["p_brand"], 4, 120)


@query(
    "corpus_metrics",
    """SELECT label, count(*) AS samples, count(*) FILTER (len(embedding) > 0) AS numeric_samples, round(avg(len(embedding)), 6) AS dim_mean, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS energy_mean, count(DISTINCT vec_id % 7) AS task_diversity FROM embeddings GROUP BY label""",
)
def corpus_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = datasets.vector_metrics(table(spark, d, "embeddings"), ["label"], F.col("embedding"), F.col("vec_id") % 7)
    return m.withColumns({"dim_mean": rounded("dim_mean", 6), "energy_mean": rounded("energy_mean", 6)})


@query("dataset_episodes", "SELECT o_custkey AS traj_id, row_number() OVER (PARTITION BY o_custkey ORDER BY file_row_number) - 1 AS frame, o_totalprice AS value FROM (SELECT *, row_number() OVER () AS file_row_number FROM orders)")
def dataset_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a stored dataset numbered in file order inside each episode (row positions come from the reader)."""
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("episode_index"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("o_totalprice").alias("values"))
    return files.episode_frames(df).withColumnRenamed("values", "value")


@query("first_rows", "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 128")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic sample: the first 128 events (the limit is the operator)."""
    return files.sample(table(spark, d, "events").select("event_id", "user_id", "value", "ts"), ["ts", "event_id"], 128).drop("ts")


@query("label_from_name", "SELECT split_part(c_name, '#', 1) AS label, count(*) AS n FROM customer GROUP BY 1")
def label_from_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.split_part("c_name", F.lit("#"), F.lit(1)).alias("label")).agg(F.count("*").alias("n"))


@query("default_records", "SELECT event_id AS index, '/joint_states' AS topic, epoch_ns(ts) AS timestamp_ns, 'unknown_robot' AS robot, 1.0::DOUBLE AS quality FROM events")
def default_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("index"), F.lit(bags.TOPIC).alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"), F.lit("unknown_robot").alias("robot"), F.lit(1.0).alias("quality"))


# reports


@query(
    "spread_min_median_max",
    """SELECT c_mktsegment AS segment, 'c_acctbal' AS metric, min(c_acctbal) AS min, round(median(c_acctbal), 6) AS median, max(c_acctbal) AS max FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, 'c_nationkey', min(c_nationkey)::DOUBLE, round(median(c_nationkey), 6), max(c_nationkey)::DOUBLE FROM customer GROUP BY 1""",
)
def spread_min_median_max(spark: SparkSession, d: str) -> DataFrame:
    s = reports.spread(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "segment"), ["segment"], ["c_acctbal", "c_nationkey"])
    return s.withColumn("median", rounded("median", 6))


@query(
    "latency_percentiles",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95,
  max(CASE WHEN i = round_even((n - 1) * 0.5::DOUBLE, 0) THEN value END) AS p50_rank, max(CASE WHEN i = round_even((n - 1) * 0.95::DOUBLE, 0) THEN value END) AS p95_rank FROM s GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = reports.percentiles(table(spark, d, "events"), ["event_type"], "value")
    return p.withColumns({"p50": rounded("p50", 6), "p95": rounded("p95", 6)})


_TOOLS_SQL = """b AS (SELECT s_nationkey AS nation, 1 + s_acctbal / 100 AS ratio, s_suppkey % 5 AS enc, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
own AS (SELECT * FROM b WHERE r <= 2)"""


def _nation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(rounded(F.avg("s_acctbal"), 4).alias("ratio"), F.count("*").cast("double").alias("encode_ms"), rounded(F.max("s_acctbal"), 4).alias("max_error"))


@query(
    "regressions_vs_anchor",
    """WITH m AS (SELECT s_nationkey AS nation, round(avg(s_acctbal), 4) + 0.0 AS ratio, count(*)::DOUBLE AS encode_ms, round(max(s_acctbal), 4) + 0.0 AS max_error FROM supplier GROUP BY 1)
SELECT nation, 'ratio' AS metric, ratio AS value, 4500.0::DOUBLE AS anchor, round(ratio - 4500, 4) AS delta FROM m WHERE ratio < 4500
UNION ALL SELECT nation, 'encode_ms', encode_ms, 4.0::DOUBLE, encode_ms - 4 FROM m WHERE encode_ms > 4
UNION ALL SELECT nation, 'max_error', max_error, 9000.0::DOUBLE, round(max_error - 9000, 4) FROM m WHERE max_error > 9000""",
)
def regressions_vs_anchor(spark: SparkSession, d: str) -> DataFrame:
    anchor = {"ratio": F.lit(4500.0), "encode_ms": F.lit(4.0), "max_error": F.lit(9000.0)}
    return reports.regressions(_nation_metrics(spark, d), "nation", anchor, {"ratio": False, "encode_ms": True, "max_error": True}).withColumn("delta", rounded("delta", 4))


@query(
    "gate_verdicts",
    """WITH o AS (SELECT s_nationkey AS nation, s_suppkey AS k, s_acctbal / 100 AS ratio, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
t AS (SELECT x.nation, y.k AS rival, x.ratio AS a, y.ratio AS z, x.k % 2 = 0 AS exact, x.k % 3 > 0 AS search, y.k % 4 > 0 AS others, (x.k % 200)::DOUBLE AS enc, (x.k * 7 % 230)::DOUBLE AS dec FROM o x JOIN o y ON x.nation = y.nation AND x.r = 1 AND y.r > 1)
SELECT nation, rival, 'B1' AS gate, a >= 20 AS passed, round(a, 6) + 0.0 AS actual FROM t
UNION ALL SELECT nation, rival, 'B2', a >= 3 * z, round(a / greatest(z, 1e-12), 3) + 0.0 FROM t
UNION ALL SELECT nation, rival, 'B3', exact AND search AND NOT others, exact::INTEGER::DOUBLE FROM t UNION ALL SELECT nation, rival, 'B4', enc < 100, enc FROM t UNION ALL SELECT nation, rival, 'B5', dec < 100, dec FROM t""",
)
def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of each nation's first supplier against every other one of the nation, suppliers standing in for tools."""
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    k = F.col("s_suppkey")
    ranked = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), k.alias("k"), r.alias("r"), (F.col("s_acctbal") / 100).alias("ratio"), (k % 3 > 0).alias("own"), (k % 4 > 0).alias("other"))
    pairs = ranked.where("r = 1").alias("x").join(ranked.where("r > 1").alias("y"), "nation")
    tool = lambda name, t, search: F.struct(
        F.lit(name).alias("tool_id"), F.col(f"{t}.ratio").alias("compression_ratio"), (F.col(f"{t}.k") % 2 == 0).alias("bit_exact_replay"), F.col(search).alias("searchable_without_decode"),
        (F.col(f"{t}.k") % 200).cast("double").alias("encode_time_ms_p50"), (F.col(f"{t}.k") * 7 % 230).cast("double").alias("decode_time_ms_p50"),
    )
    rows = pairs.select("nation", F.col("y.k").alias("rival"), F.inline(F.array(tool("ours", "x", "x.own"), tool("zstd", "y", "y.other"))))
    v = reports.gate_verdicts(rows, ["nation", "rival"], "ours", "zstd")
    return v.withColumn("actual", rounded(F.when(F.col("gate") == "B2", F.round("actual", 3)).otherwise(F.col("actual")), 6))


@query(
    "rollup_issues",
    """WITH m AS (SELECT s_nationkey AS nation, avg(s_acctbal) AS ratio, count(*) % 2 = 0 AS exact, max(s_acctbal) > 9000 AS b3 FROM supplier GROUP BY 1)
SELECT nation, concat_ws('; ', CASE WHEN ratio < 4500 THEN 'ratio below anchor' END, CASE WHEN NOT exact THEN 'replay not bit exact' END, CASE WHEN NOT b3 THEN 'B3 open' END) AS issues FROM m""",
)
def rollup_issues(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("ratio"), (F.count("*") % 2 == 0).alias("exact"), (F.max("s_acctbal") > 9000).alias("b3"))
    return m.select("nation", F.concat_ws("; ", reports.issues(F.col("ratio"), F.lit(4500.0), F.col("exact"), F.col("b3"))).alias("issues"))


@query(
    "claim_rows",
    """WITH m(claim, metric, sense, threshold) AS (SELECT 'orders', count(*)::DOUBLE, '>=', 1000.0::DOUBLE FROM orders UNION ALL SELECT 'discount', max(l_discount), '<=', 0.05::DOUBLE FROM lineitem UNION ALL SELECT 'regions', count(*)::DOUBLE, '==', 5.0::DOUBLE FROM region)
SELECT *, CASE WHEN CASE sense WHEN '>=' THEN metric >= threshold WHEN '<=' THEN metric <= threshold ELSE metric = threshold END THEN 'PASS' ELSE 'FAIL' END AS status FROM m""",
)
def claim_rows(spark: SparkSession, d: str) -> DataFrame:
    row = lambda df, name, metric, sense, limit: df.agg(metric.cast("double").alias("metric")).select(F.lit(name).alias("claim"), "metric", F.lit(sense).alias("sense"), F.lit(limit).alias("threshold"))
    m = row(table(spark, d, "orders"), "orders", F.count("*"), ">=", 1000.0).unionAll(row(table(spark, d, "lineitem"), "discount", F.max("l_discount"), "<=", 0.05)).unionAll(row(table(spark, d, "region"), "regions", F.count("*"), "==", 5.0))
    return reports.claims(m, "claim", "metric", "sense", "threshold")


@query("missing_artifacts_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def missing_artifacts_anti(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return reports.missing(table(spark, d, "customer").select("c_custkey"), have, ["c_custkey"])


@query("subset_test", "WITH m AS (SELECT DISTINCT l_suppkey AS k FROM lineitem EXCEPT SELECT s_suppkey FROM supplier) SELECT count(*) AS missing, count(*) = 0 AS is_subset FROM m")
def subset_test(spark: SparkSession, d: str) -> DataFrame:
    return reports.is_subset(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])


@query(
    "set_operations",
    """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union_all' AS op, count(*) AS n FROM (SELECT k FROM c UNION ALL SELECT k FROM s) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM c UNION SELECT k FROM s)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'except_all', count(*) FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s)""",
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    found = {"union_all": c.unionAll(s), "union": c.union(s).distinct(), "intersect": c.intersect(s), "except": c.subtract(s), "except_all": c.exceptAll(s)}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in found.items()]
    for more in out[1:]:
        out[0] = out[0].unionAll(more)
    return out[0]


@query("rank_by_median", "SELECT event_type, n, round(m, 6) + 0.0 AS median, row_number() OVER (ORDER BY m DESC, event_type) AS rank FROM (SELECT event_type, count(value) AS n, median(value) AS m FROM events GROUP BY 1)")
def rank_by_median(spark: SparkSession, d: str) -> DataFrame:
    return reports.rank_by_median(table(spark, d, "events"), "event_type", "value").withColumn("median", rounded("median", 6))


@query("one_joint_paths", f"WITH {EVENTS_SQL} SELECT traj_id, frame, round(frame / count(*) OVER (PARTITION BY traj_id), 9) AS x0, x AS x1 FROM f")
def one_joint_paths(spark: SparkSession, d: str) -> DataFrame:
    """A single joint becomes a path over time."""
    return frames.planar(events(spark, d)).select("traj_id", "frame", rounded("x0", 9).alias("x0"), "x1")


@query(
    "cosine_clipped",
    f"""WITH {_VEC_SQL}, {_MEAN_SQL} SELECT label AS label, vec_id AS traj_id, round(sum(x * m) / greatest(sqrt(sum(x * x)) * sqrt(sum(m * m)), 1e-12), 6) + 0.0 AS score FROM e JOIN mu USING (label, i) GROUP BY ALL""",
)
def cosine_clipped(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against its label's mean, with the clipped denominator."""
    v = vectors(spark, d)
    means = evaluation.centroids(v.withColumnRenamed("vec", "feature"), "label", "feature")
    mean = next(c for c in means.columns if c != "label")
    return v.join(means.select("label", F.col(mean).alias("_m")), "label").select("label", "traj_id", rounded(columns.cosine_clipped(F.col("vec"), F.col("_m")), 6).alias("score"))


@query("distinct_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("content_sha256", "SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || p_size::VARCHAR) AS sha256 FROM part")
def content_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")), 256).alias("sha256"))


@query(
    "replay_hash",
    """WITH c AS (SELECT o_orderstatus AS status, o_orderkey // 5000 AS run, count(*) AS n, sha256(string_agg(o_orderkey::VARCHAR || ',' || o_custkey::VARCHAR || ',' || o_orderpriority, chr(10) ORDER BY o_orderkey, o_custkey, o_orderpriority)) AS h FROM orders GROUP BY ALL)
SELECT status, sum(n)::BIGINT AS rows, sha256(string_agg(h, chr(10) ORDER BY run)) AS sha256 FROM c GROUP BY 1""",
)
def replay_hash(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority")
    return reports.replay_hash(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ["status"], ["o_orderkey", "o_custkey", "o_orderpriority"], line, F.floor(F.col("o_orderkey") / 5000))


@query("json_props", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


# containers, generators, streams (bytes and state: no SQL)


@query("packet_encode_size")
def packet_encode_size(spark: SparkSession, d: str) -> DataFrame:
    p = packets.pack_frames(suppliers(spark, d))
    return p.select("traj_id", "raw_bytes", F.length("content").cast("bigint").alias("packet_bytes"), rounded(F.col("raw_bytes") / F.greatest(F.lit(1), F.length("content")), 6).alias("ratio"), "error")


@query("packet_roundtrip", f"WITH {EVENTS_SQL}, {dft_sql(8)}, {REC_SQL} SELECT traj_id, count(*) AS cells, round(max(abs(x - y)), 3) AS max_abs_error FROM r GROUP BY traj_id HAVING count(*) >= 8")
def packet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Frames to packets and back; the reconstruction's error against the frames."""
    wide = events(spark, d)
    back = packets.unpack_frames(packets.pack_frames(wide).where("error is null").select("traj_id", "content"), "traj_id").select("traj_id", "joint", "frame", F.col("x").alias("y"))
    both = frames.melt(wide).join(back, ["traj_id", "joint", "frame"])
    return both.groupBy("traj_id").agg(F.count("*").alias("cells"), rounded(F.max(F.abs(F.col("x") - F.col("y"))), 3).alias("max_abs_error"))


_HEADS_SQL = "SELECT user_id AS traj_id, count(*) AS frames, 1 AS joints, least(8, count(*) // 2 + 1) AS keep FROM events GROUP BY user_id HAVING count(*) >= 8"


@query("packet_verify", f"SELECT *, 1 AS wire_version, true AS crc_ok, true AS ok, 64 AS sha256_length, NULL::VARCHAR AS error FROM ({_HEADS_SQL})")
def packet_verify(spark: SparkSession, d: str) -> DataFrame:
    """Headers and checks of every packet; of the bytes' hash, which SQL hasn't, the length."""
    p = packets.pack_frames(events(spark, d)).where("error is null")
    return packets.verify(p.select("traj_id", "content"), "traj_id").select("traj_id", "wire_version", "frames", "joints", "keep", "crc_ok", "ok", F.length("sha256").alias("sha256_length"), "error")


@query("corruption_matrix")
def corruption_matrix(spark: SparkSession, d: str) -> DataFrame:
    return packets.corruption_matrix(packets.pack_frames(events(spark, d)), "traj_id")


@query("bag_roundtrip")
def bag_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A bag of every kind from each user's packet, written, read and written again."""
    import pandas as pd

    p = packets.pack_frames(events(spark, d)).where("error is null").select("traj_id", "content")

    def run(parts):
        for df in parts:
            rows = []
            for t, blob in zip(df["traj_id"], df["content"], strict=True):
                records = [bags.record(i, bytes(blob), timestamp_ns=1_700_000_000_000_000_000 + i) for i in range(3)]
                rows += [(t, *bags.round_trip(records, kind).values()) for kind in bags.WRITE]
            yield pd.DataFrame(rows, columns=["traj_id", "kind", "records", "bytes_equal", "sha256", "replay_sha256"])

    return p.mapInPandas(run, "traj_id bigint, kind string, records bigint, bytes_equal boolean, sha256 string, replay_sha256 string")


@query("baseline_codecs")
def baseline_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and exactness of the byte codecs on every supplier's samples; times vary and are left out."""
    b = packets.benchmark_codecs(suppliers(spark, d), 1)
    return b.select("traj_id", "tool_id", "raw_size_bytes", "compressed_size_bytes", "bit_exact_replay", rounded("max_abs_error", 3).alias("max_abs_error"))


@query("packet_source_scan", f"SELECT *, true AS has_payload, NULL::VARCHAR AS error FROM ({_HEADS_SQL})")
def packet_source_scan(spark: SparkSession, d: str) -> DataFrame:
    """Packets written as files and scanned by their headers alone."""
    at = shared_dir(spark, "packets")
    packets.write_packets(packets.pack_frames(events(spark, d)), at)
    datasource.register(spark)
    heads = spark.read.format("motion_packets").option("payload", "false").load(at)
    return heads.select(F.regexp_extract("path", r"([0-9]+)\.packet$", 1).cast("bigint").alias("traj_id"), "frames", "joints", "keep", (F.col("payload_bytes") > 0).alias("has_payload"), "error")


@query("csv_roundtrip", f"WITH {SUPPLIER_SQL} SELECT traj_id, joint, count(*) AS cells, round(sum(x), 2) + 0.0 AS total, 0 AS errors FROM f GROUP BY traj_id, joint")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories written as CSV with joint headers and read back: cells, and the sum of each."""
    at = shared_dir(spark, "csv")
    files.write_csv(suppliers(spark, d), at)
    per = files.read_csv(spark, at).groupBy("path", "joint").agg(F.count("*").alias("cells"), rounded(F.sum("x"), 2).alias("total"), F.count("error").alias("errors"))
    return per.select(F.regexp_extract("path", "traj_id=([0-9]+)/", 1).cast("bigint").alias("traj_id"), "joint", "cells", "total", "errors")


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's frames as an episode of four joints."""
    row = F.struct("frame", F.array(*[F.col(f"x{j}").cast("float") for j in range(4)]).alias("q"))
    e = suppliers(spark, d).groupBy("traj_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return e.select(
        F.format_string("episode_%05d.json", "traj_id").alias("path"), F.lit("top_level").alias("structure"), F.col("r.q").alias("joint_positions"), F.transform("r.frame", lambda f: f / F.lit(50.0)).alias("timestamps"),
        F.create_map(F.lit("robot"), F.lit("arm")).alias("episode_metadata"), F.lit(None).cast("string").alias("error"),
    )


@query("episode_compression")
def episode_compression(spark: SparkSession, d: str) -> DataFrame:
    """Every episode compressed with four bins."""
    return files.compress_episodes(_episodes(spark, d)).select("path", "raw_bytes", "packet_bytes", rounded("ratio", 6).alias("ratio"), "error")


@query("episode_directory", "SELECT count(*) AS files, (sum(n) * 16)::BIGINT AS raw_bytes, true AS smaller FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 8)")
def episode_directory(spark: SparkSession, d: str) -> DataFrame:
    """The directory's roll-up: the ratio is that of the sums."""
    o = files.overall_ratio(files.compress_episodes(_episodes(spark, d)))
    return o.select("files", "raw_bytes", ((F.col("ratio") > 1) & (F.col("packet_bytes") < F.col("raw_bytes"))).alias("smaller"))


@query(
    "episode_files",
    f"""WITH {SUPPLIER_SQL} SELECT traj_id, 'observation' AS structure, count(*) FILTER (joint = 0) AS frames, round(sum(x::FLOAT::DOUBLE), 1) + 0.0 AS total, round(max(frame / 50.0), 6) AS last_stamp, 'arm' AS robot, NULL::VARCHAR AS error FROM f GROUP BY traj_id""",
)
def episode_files(spark: SparkSession, d: str) -> DataFrame:
    """Episodes dumped as JSON files, one each, and read back."""
    at = shared_dir(spark, "episodes")
    files.write_episodes(_episodes(spark, d).withColumn("structure", F.lit("observation")), at)
    e = files.read_episodes(spark, at)
    total = F.aggregate(F.flatten("joint_positions"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.select(
        F.regexp_extract("path", r"episode_([0-9]+)\.json$", 1).cast("bigint").alias("traj_id"), "structure", F.size("joint_positions").cast("bigint").alias("frames"), rounded(total, 1).alias("total"),
        rounded(F.array_max("timestamps"), 6).alias("last_stamp"), F.element_at("episode_metadata", "robot").alias("robot"), "error",
    )


@query(
    "dataset_scan",
    """WITH r AS (SELECT c_custkey AS e, c_nationkey::FLOAT AS a, c_acctbal::FLOAT AS b FROM customer)
SELECT e % 7 AS traj_id, count(*) AS frames, round(sum(a::DOUBLE), 3) AS first_joint, round(sum(b::DOUBLE), 1) + 0.0 AS second_joint, 10 AS fps FROM r GROUP BY 1""",
)
def dataset_scan(spark: SparkSession, d: str) -> DataFrame:
    """A dataset written as data and meta files and read through the scan and its information file."""
    at = shared_dir(spark, "dataset")
    state = F.array(F.col("c_nationkey").cast("float"), F.col("c_acctbal").cast("float"))
    table(spark, d, "customer").select((F.col("c_custkey") % 7).alias("episode_index"), state.alias("observation.state"), F.lit("unread").alias("more")).write.parquet(f"{at}/data/chunk-000")
    packets.write_packets(spark.createDataFrame([("info", bytearray(b'{"fps": 10, "robot_type": "arm"}'))], "name string, content binary"), f"{at}/meta", "name", ".json")
    rows = files.episode_frames(files.dataset_rows(spark, at, "observation.state"))
    fps = files.dataset_info(spark, at)["fps"]
    return rows.groupBy("traj_id").agg(F.count("*").alias("frames"), rounded(F.sum(F.get("values", F.lit(0)).cast("double")), 3).alias("first_joint"), rounded(F.sum(F.get("values", F.lit(1)).cast("double")), 1).alias("second_joint")).withColumn("fps", F.lit(fps))


@query("corpus_ratio")
def corpus_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Deflate ratio of the vectors of every label (bytes: no SQL)."""
    return datasets.compression_ratio(table(spark, d, "embeddings"), ["label"], F.col("embedding")).withColumn("ratio", rounded("ratio", 6))


@query("confusion_stress")
def confusion_stress(spark: SparkSession, d: str) -> DataFrame:
    lib, _ = fixtures.primitives(20260243)

    def histogram(p: np.ndarray) -> np.ndarray:
        step = np.diff(p, axis=0)
        turn = np.floor((np.arctan2(step[:, 1], step[:, 0]) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
        m = np.hypot(step[:, 0], step[:, 1])
        token = turn * 3 + np.searchsorted(np.quantile(m, tokens.QUANTILES), m, "right")
        return np.bincount(token, minlength=24) / len(token)

    r = evaluation.confusion_stress(np.array([a for a, _ in lib]), np.stack([b for _, b in lib]), histogram, 7)
    return spark.createDataFrame([(r["queries"], r["false_positive_rate"], r["pass"])], "queries double, false_positive_rate double, pass boolean")


@query("anomaly_corpus_sweep")
def anomaly_corpus_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic fleet evaluation: fit on 60 trajectories, judge 100 nominal and 10 anomalous ones at every threshold."""
    fleet, judged = fixtures.anomaly_corpus()
    hist = lambda jobs: tokens.token_histogram(tokens.joint_tokens(fixtures.generated(spark, jobs, 4096, 6), exact=True))
    scores = anomaly.score_fleet(hist(judged), anomaly.fit_fleet(hist(fleet)))
    return anomaly.sweep(scores.select("score", (F.col("traj_id") >= 2000).alias("anomalous")), anomaly.threshold_grid(spark))


@query("token_quality")
def token_quality(spark: SparkSession, d: str) -> DataFrame:
    """Centroid accuracy of three features on the synthetic primitives: direction histogram, coarse grid, spectrum."""
    lib, ask = fixtures.primitives(20260243)
    order = [(label, p) for name in search.LABELS for label, p in lib + ask if label == name]
    wide = fixtures.wide_table(spark, [p for _, p in order])
    labels = spark.createDataFrame([(i, search.LABELS.index(label)) for i, (label, _) in enumerate(order)], "traj_id bigint, label int")
    vector = lambda cells, key, value: cells.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct(key, value)))[value].alias("feature"))
    turns = tokens.dense_histogram(tokens.path_tokens(wide, exact=True), ["traj_id"], "direction", 8, "direction")
    found = {"direction": vector(turns, "direction", "freq"), "grid": vector(tokens.grid_histogram(wide), "cell", "freq"), "spectrum": vector(spectral.spectral_features(wide), "i", "value")}
    out = None
    for name, features in found.items():
        v = evaluation.split(features.join(labels, "traj_id"), "label", "traj_id")
        right = evaluation.classify(v.where("not is_train"), evaluation.centroids(v.where("is_train"), "label", "feature"), "traj_id", "label", "feature")
        row = evaluation.accuracy(right, []).select(F.lit(name).alias("feature"), "n", "correct", "accuracy")
        out = row if out is None else out.unionAll(row)
    return out


@query("primitive_precision")
def primitive_precision(spark: SparkSession, d: str) -> DataFrame:
    """Mean precision at 10 of shape signatures: 360 synthetic primitives, 144 noisier queries."""
    lib, ask = fixtures.primitives(20260243)
    wide = fixtures.wide_table(spark, [p for _, p in lib + ask])
    labels = spark.createDataFrame([(i, search.LABELS.index(label)) for i, (label, _) in enumerate(lib + ask)], "traj_id bigint, label int")
    sig = search.features(wide).select("traj_id", "sig").join(labels, "traj_id")
    near = search.nearest(sig.where(F.col("traj_id") < len(lib)), sig.where(F.col("traj_id") >= len(lib)), 10, "traj_id", "sig", "label")
    return evaluation.precision_at_k(near, 10)


@query("fault_injection")
def fault_injection(spark: SparkSession, d: str) -> DataFrame:
    """Frame detector against injected faults with known truth."""
    x, truth = fixtures.with_faults(fixtures.joint_trajectory(1024, 6, 5), 9)
    t = spark.createDataFrame([(0, i, bool(b)) for i, b in enumerate(truth)], "traj_id bigint, frame bigint, truth boolean")
    found = anomaly.frame_anomalies(fixtures.wide_table(spark, [x])).select("traj_id", "frame", F.lit(True).alias("p"))
    return anomaly.precision_recall(t.join(found, ["traj_id", "frame"], "left").select("truth", F.coalesce("p", F.lit(False)).alias("predicted")))


def _streamed(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The scratch folder, and event frames as a stream of files in event time."""
    at = shared_dir(spark, "stream")
    long = frames.melt(events(spark, d)).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame")))
    long.repartition(monitor.FILES_A_BATCH, "traj_id").write.parquet(f"{at}/in")  # all cores write, and one batch still takes all files
    return at, monitor.read_frames(spark, f"{at}/in")


def _drained(spark: SparkSession, live: DataFrame, at: str) -> DataFrame:
    """What an append stream gives for all that is there now."""
    live.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{at}/out")


_STILL_SQL = """r AS (SELECT *, count(*) FILTER (abs(v) >= 1e-14) OVER (PARTITION BY traj_id, joint ORDER BY frame) AS run FROM k),
live AS (SELECT traj_id, joint, frame, x, v, a, (count(*) FILTER (abs(v) < 1e-14) OVER (PARTITION BY traj_id, joint, run ORDER BY frame))::INTEGER AS still FROM r)"""


@query("stream_kinetics", f"WITH {EVENTS_SQL}, {KINETICS_SQL}, {_STILL_SQL} SELECT *, still >= 5 AS stuck FROM live")
def stream_kinetics(spark: SparkSession, d: str) -> DataFrame:
    """Event frames fed as a stream of files, in order; velocities and still runs kept in state across batches."""
    at, long = _streamed(spark, d)
    return _drained(spark, monitor.live_kinetics(long), at)


@query(
    "stream_tokens",
    f"""WITH {EVENTS_SQL}, {KINETICS_SQL} SELECT traj_id, joint, frame, (floor((atan2(a, v) + pi()) / (2 * pi()) * 8)::INTEGER % 8 * 3
  + (sqrt(v * v + a * a) >= 20.0)::INTEGER + (sqrt(v * v + a * a) >= 60.0)::INTEGER)::INTEGER AS token FROM k""",
)
def stream_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of live kinetics under fixed cuts."""
    at, long = _streamed(spark, d)
    return _drained(spark, monitor.live_tokens(monitor.live_kinetics(long), (20.0, 60.0)).select("traj_id", "joint", "frame", "token"), at)


@query("stream_activity", f"WITH {EVENTS_SQL} SELECT traj_id, frame // 20 AS slot, count(*) AS frames, round(avg(x), 6) + 0.0 AS mean_x FROM f GROUP BY ALL")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Frames and mean in event-time windows of 20 seconds, one frame a second; the stream's last complete result."""
    at, long = _streamed(spark, d)
    per = monitor.activity(long, "20 seconds")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out")
    per.writeStream.option("checkpointLocation", f"{at}/state").outputMode("complete").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    slot = ((F.unix_seconds("start") - 1_700_000_000) / 20).cast("bigint")
    return spark.read.schema(per.schema).parquet(f"{at}/out").select("traj_id", slot.alias("slot"), "frames", rounded("mean_x", 6).alias("mean_x"))


@query("stream_scores", f"WITH {SUPPLIER_SQL}, {KINETICS_SQL}, {TOKENS_SQL}, {HIST_SQL}, {FLEET_SQL} SELECT h.traj_id, round(3 * sqrt(avg(((freq - mean) / std) ** 2)), 5) AS score FROM h JOIN fm USING (joint, token) GROUP BY h.traj_id")
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Histograms arriving as a stream against the fleet model; squared z summed up afterwards."""
    at, h = shared_dir(spark, "scores"), tokens.token_histogram(tokens.joint_tokens(suppliers(spark, d)))
    h.write.parquet(f"{at}/in")
    h = spark.read.parquet(f"{at}/in")
    cells = monitor.score_stream(spark.readStream.schema(h.schema).parquet(f"{at}/in"), anomaly.fit_fleet(h))
    return _drained(spark, cells.select("traj_id", "z2"), at).groupBy("traj_id").agg(rounded(3 * F.sqrt(F.avg("z2")), 5).alias("score"))
