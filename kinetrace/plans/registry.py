"""Where queries and their SQL are registered, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` gives the same rows in DuckDB, or is left out where SQL can't."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# views: trajectories in the tables at hand

SUPPLIER_JOINTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

EVENTS_SQL = "f AS (SELECT user_id AS traj_id, 0 AS joint, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS x FROM events)"
SUPPLIER_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS frame FROM lineitem),
f AS (SELECT l_suppkey AS traj_id, u.joint, frame, u.x FROM n, LATERAL (VALUES (0, l_quantity), (1, l_extendedprice), (2, l_discount), (3, l_tax)) AS u(joint, x))"""
PATHS_SQL = """p AS (SELECT vec_id AS traj_id, label, i AS frame, embedding[2 * i + 1]::DOUBLE AS x0, embedding[2 * i + 2]::DOUBLE AS x1
  FROM (SELECT vec_id, label, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings))"""
KINETICS_SQL = """v AS (SELECT traj_id, joint, frame, x, coalesce(round(x - lag(x) OVER w, 9), 0) + 0.0::DOUBLE AS v FROM f WINDOW w AS (PARTITION BY traj_id, joint ORDER BY frame)),
k AS (SELECT traj_id, joint, frame, x, v, coalesce(round(v - lag(v) OVER w, 9), 0) + 0.0::DOUBLE AS a FROM v WINDOW w AS (PARTITION BY traj_id, joint ORDER BY frame))"""
TOKENS_SQL = """m AS (SELECT *, round(sqrt(v * v + a * a), 9) + 0.0::DOUBLE AS m FROM k),
q AS (SELECT traj_id, quantile_cont(m, 0.33::DOUBLE) AS q1, quantile_cont(m, 0.66::DOUBLE) AS q2 FROM m GROUP BY traj_id),
t AS (SELECT m.traj_id, joint, frame, ((floor((atan2(a, v) + pi()) / (2 * pi()) * 8)::INTEGER % 8) * 3 + (m >= q1)::INTEGER + (m >= q2)::INTEGER)::INTEGER AS token FROM m JOIN q USING (traj_id))"""
STEPS_SQL = """s AS (SELECT traj_id, label, frame, round(x0 - lag(x0) OVER w, 9) + 0.0::DOUBLE AS d0, round(x1 - lag(x1) OVER w, 9) + 0.0::DOUBLE AS d1 FROM p WINDOW w AS (PARTITION BY traj_id ORDER BY frame)),
sm AS (SELECT *, round(sqrt(d0 * d0 + d1 * d1), 9) + 0.0::DOUBLE AS m, floor((atan2(d1, d0) + pi()) / (2 * pi()) * 8)::INTEGER % 8 AS direction FROM s WHERE frame > 0),
sq AS (SELECT traj_id, quantile_cont(m, 0.33::DOUBLE) AS q1, quantile_cont(m, 0.66::DOUBLE) AS q2 FROM sm GROUP BY traj_id),
pt AS (SELECT sm.traj_id, label, frame, direction, (direction * 3 + (m >= q1)::INTEGER + (m >= q2)::INTEGER)::INTEGER AS token FROM sm JOIN sq USING (traj_id))"""
HIST_SQL = """g AS (SELECT traj_id, joint, token, count(*) AS c FROM t GROUP BY ALL),
h AS (SELECT b.traj_id, b.joint, w.token, coalesce(g.c, 0) / b.n AS freq
  FROM (SELECT traj_id, joint, count(*)::DOUBLE AS n FROM t GROUP BY ALL) b CROSS JOIN (SELECT unnest(range(0, 24))::INTEGER AS token) w
  LEFT JOIN g ON g.traj_id = b.traj_id AND g.joint = b.joint AND g.token = w.token)"""
FLEET_SQL = """fm AS (SELECT joint, token, avg(freq) AS mean, greatest(stddev_pop(freq), 1e-6) AS std FROM h GROUP BY ALL),
sc AS (SELECT h.traj_id, round(3 * sqrt(avg(((freq - mean) / std) ** 2)), 6) AS score FROM h JOIN fm USING (joint, token) GROUP BY h.traj_id)"""
