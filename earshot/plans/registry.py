"""Where query modules register themselves."""

from __future__ import annotations

from earshot.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Segments from the star schema, in SQL that both engines read.
SEGMENTS = """
SELECT l_orderkey AS file_id, l_linenumber AS seg_no, c_custkey AS speaker, n_name AS playlist, r_name AS region,
       l_linenumber * 20e0 AS start_time, l_linenumber * 20e0 + l_quantity / 5 AS end_time, l_quantity / 5 AS duration,
       l_discount * 10 AS music_prob, 1 - l_tax * 8 AS panns_speech_prob, 1 - l_tax * 5 AS speech_ratio, (l_partkey % 40) * 1e0 AS snr_db,
       l_returnflag = 'R' AS is_excluded,
       CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'mad_outlier' ELSE '' END AS exclude_reason,
       CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE c_custkey % 40 END AS global_actor,
       CASE c_custkey % 4 WHEN 0 THEN 'Tier1' WHEN 1 THEN 'Tier2' WHEN 2 THEN 'Tier3' ELSE 'reject' END AS tier,
       CASE c_custkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split,
       (c_acctbal + 1000) / 11000 AS risk, c_mktsegment AS segment_group, o_orderdate AS recorded
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def views(spark, sf_dir, *names):
    """Register the named tables as views for one query."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def segments(spark, sf_dir):
    views(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    return spark.sql(SEGMENTS)


def query(name: str, sql: str | None = None):
    """Register a query; in its SQL, {seg} stands for the segments CTE and braces of other kinds are plain text."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.replace("{seg}", f"seg AS ({SEGMENTS})")
        return fn

    return put
