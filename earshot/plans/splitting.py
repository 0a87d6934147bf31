"""Queries of the T operators. SQL repeats the draws by MD5 and, in a recursion, the greedy splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import tables
from earshot.operators import splits as T
from earshot.plans.aggregates import rounded
from earshot.plans.registry import query, segments, views
from earshot.session import table

KEY = ("file_id", "seg_no")


def keyed(spark, sf):
    return segments(spark, sf).withColumn("key", F.col("file_id") * 100 + F.col("seg_no"))


def split_rows(df, *group):
    """A row for each group and split: more than one if a group leaks."""
    return df.groupBy(*group, "split").agg(F.count("*").alias("n"))


#: Largest group first, into the split with most room; ties train, dev, test. g: (cls, grp, mass, n).
GREEDY = """r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(mass, 6) DESC, grp) AS i, sum(mass) OVER (PARTITION BY cls) AS total FROM g),
w AS (SELECT cls, 0::BIGINT AS i, NULL::BIGINT AS grp, '' AS split, 0::DOUBLE AS tr, 0::DOUBLE AS de, 0::DOUBLE AS te FROM r GROUP BY cls
UNION ALL SELECT cls, i, grp, split, tr + CASE WHEN split = 'train' THEN mass ELSE 0 END, de + CASE WHEN split = 'dev' THEN mass ELSE 0 END, te + CASE WHEN split = 'test' THEN mass ELSE 0 END
FROM (SELECT r.cls, r.i, r.grp, r.mass, w.tr, w.de, w.te, CASE WHEN round(0.8 * total - tr, 9) >= greatest(round(0.1 * total - de, 9), round(0.1 * total - te, 9)) THEN 'train' WHEN round(0.1 * total - de, 9) >= round(0.1 * total - te, 9) THEN 'dev' ELSE 'test' END AS split
FROM w JOIN r ON r.cls = w.cls AND r.i = w.i + 1))"""


@query("t01_disjoint_splits", "WITH RECURSIVE {seg}, g AS (SELECT region AS cls, speaker AS grp, count(*)::DOUBLE AS mass, count(*) AS n FROM seg GROUP BY ALL), " + GREEDY + " SELECT w.cls AS region, w.grp AS speaker, split, n FROM w JOIN g ON g.cls = w.cls AND g.grp = w.grp")
def t01(spark, sf):
    return split_rows(T.disjoint_splits(segments(spark, sf).drop("split"), "region", "speaker"), "region", "speaker")


STEPS = "WITH RECURSIVE g AS (SELECT r_name AS cls, c_custkey AS grp, round(c_acctbal + 2000)::DOUBLE AS mass, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), " + GREEDY + " SELECT cls AS region, grp AS customer, split FROM w WHERE split <> ''"


@query("u03_sequential_steps", STEPS)
def u03(spark, sf):
    """Steps that depend on the ones before, over groups that are aggregated already."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.select(F.col("r_name").alias("region"), F.col("c_custkey").alias("customer"), F.round(F.col("c_acctbal") + 2000).cast("double").alias("m"))
    return T.disjoint_splits(rows, "region", "customer", F.col("m")).select("region", "customer", "split")


@query("u03_steps_in_sql", STEPS)
def u03_sql(spark, sf):
    """The same steps by a table function: its rows come by class, largest first, and only the filled masses are kept."""
    tables.register(spark)
    views(spark, sf, "customer", "nation", "region")
    spark.sql("SELECT r_name AS region, c_custkey AS customer, sum(CAST(round(c_acctbal + 2000) AS DOUBLE)) AS mass FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL").createOrReplaceTempView("step_groups")
    return spark.sql("SELECT * FROM greedy_splits(TABLE(SELECT *, sum(mass) OVER (PARTITION BY region) AS total FROM step_groups), 'region', 'customer', 'mass', 'total')")


@query("t02_balanced_splits", "WITH RECURSIVE {seg}, c AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY md5(concat_ws(':', 1, file_id * 100 + seg_no)), duration) AS k FROM seg), g AS (SELECT region AS cls, speaker AS grp, sum(duration) AS mass, count(*) AS n FROM c WHERE k <= 20 GROUP BY ALL), " + GREEDY + " SELECT w.cls AS region, w.grp AS speaker, split, n FROM w JOIN g ON g.cls = w.cls AND g.grp = w.grp")
def t02(spark, sf):
    return split_rows(T.balanced_splits(keyed(spark, sf).drop("split"), "region", "speaker", cap=20, order=F.struct(T.draw(1, "key"), "duration")), "region", "speaker")  # keys may repeat


#: Channels with their class of most duration, as groups of GREEDY.
CHANNELS = "d AS (SELECT playlist, region, sum(duration) AS mass FROM seg GROUP BY ALL), h AS (SELECT playlist, region, row_number() OVER (PARTITION BY playlist ORDER BY mass DESC, region) AS k FROM d), o AS (SELECT playlist, sum(duration) AS mass, count(*) AS n FROM seg GROUP BY playlist), p AS (SELECT *, row_number() OVER (ORDER BY playlist) AS id FROM o), g AS (SELECT region AS cls, id AS grp, mass, n FROM p JOIN h ON h.playlist = p.playlist AND k = 1), "


def repaired(split, before, after):
    """SQL: where a class has no group in the split, the smallest group of the split with most groups (ties train, dev, test) moves there."""
    n = {x: f"count(*) FILTER (WHERE split = '{x}') OVER (PARTITION BY cls)" for x in ("train", "dev", "test")}
    donor = f"CASE WHEN {n[split]} > 0 THEN NULL WHEN {n['train']} >= greatest({n['dev']}, {n['test']}) THEN 'train' WHEN {n['dev']} >= {n['test']} THEN 'dev' ELSE 'test' END"
    return f"{after}_d AS (SELECT *, {donor} AS donor FROM {before}), {after} AS (SELECT cls, i, grp, CASE WHEN i = max(CASE WHEN split = donor THEN i END) OVER (PARTITION BY cls) THEN '{split}' ELSE split END AS split FROM {after}_d)"


@query("t03_channel_splits", "WITH RECURSIVE {seg}, " + CHANNELS + GREEDY + f", w0 AS (SELECT * FROM w WHERE i > 0), {repaired('dev', 'w0', 'w1')}, {repaired('test', 'w1', 'w2')}, z AS (SELECT *, count(*) OVER (PARTITION BY cls) AS c FROM w2)" + " SELECT playlist, CASE WHEN c = 1 THEN 'test' WHEN c = 2 THEN CASE WHEN i = 1 THEN 'train' ELSE 'test' END ELSE split END AS split, n FROM z JOIN p ON p.id = z.grp")
def t03(spark, sf):
    return split_rows(T.channel_splits(segments(spark, sf).drop("split"), "region", "playlist"), "playlist")


@query("t04_channel_greedy", "WITH RECURSIVE {seg}, " + CHANNELS + GREEDY + " SELECT playlist, split, n FROM w JOIN p ON p.id = w.grp")
def t04(spark, sf):
    return split_rows(T.channel_splits(segments(spark, sf).drop("split"), "region", "playlist", repair=False), "playlist")


@query("t05_cap", "WITH {seg}, k AS (SELECT speaker, file_id * 100 + seg_no AS key, row_number() OVER (PARTITION BY speaker ORDER BY md5(concat_ws(':', 1, file_id * 100 + seg_no))) AS r FROM seg) SELECT speaker, key FROM k WHERE r <= 12")
def t05(spark, sf):
    return T.cap_per_group(keyed(spark, sf), "speaker", 12, T.draw(1, "key")).select("speaker", "key")


SAMPLE = """c AS (SELECT *, o_orderkey % 3 AS tercile FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, tercile ORDER BY md5(concat_ws(':', 1337, o_orderkey)), o_orderkey) AS r FROM c),
s AS (SELECT o_orderkey, o_orderpriority, tercile, row_number() OVER (ORDER BY md5(concat_ws(':', 'serve1337', o_orderkey)), o_orderkey) AS serve_order FROM k WHERE r <= 10)"""


def sampled(spark, sf):
    """Ten orders of each priority and third of the keys."""
    return T.stratified(table(spark, sf, "orders").withColumn("tercile", F.col("o_orderkey") % 3), ["o_orderpriority", "tercile"], 10, "o_orderkey")


@query("t06_stratified", f"WITH {SAMPLE} SELECT *, printf('S%02d', serve_order) AS item_id FROM s")
def t06(spark, sf):
    return sampled(spark, sf).select("o_orderkey", "o_orderpriority", "tercile", "serve_order", "item_id")


@query("t07_extension", f"WITH {SAMPLE} SELECT o_orderkey, (SELECT count(*) FROM s) + row_number() OVER (ORDER BY md5(concat_ws(':', 'serve1337', o_orderkey)), o_orderkey) AS serve_order FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def t07(spark, sf):
    return T.extension(table(spark, sf, "orders"), sampled(spark, sf), "o_orderkey").select("o_orderkey", "serve_order")


@query("t08_capped_stratified", "WITH {seg}, c AS (SELECT DISTINCT region, tier FROM seg) SELECT region, tier, 23 AS n, true AS speaker_ok, true AS channel_ok FROM c")
def t08(spark, sf):
    k = keyed(spark, sf).withColumn("speaker", F.col("file_id"))  # a speaker for each recording, so that small tables fill every cell
    k = k.select("key", "region", "tier", "speaker", "playlist")
    s = T.capped_stratified(k, ["region", "tier"], 23, {"speaker": 3, "playlist": 60}, "key")
    ok = s.groupBy("speaker").count().agg((F.max("count") <= 3).alias("speaker_ok")).crossJoin(s.groupBy("playlist").count().agg((F.max("count") <= 60).alias("channel_ok")))
    return s.groupBy("region", "tier").agg(F.count("*").alias("n")).crossJoin(F.broadcast(ok))


@query("t09_not_shown", "WITH {seg}, k AS (SELECT speaker, file_id * 100 + seg_no AS key FROM seg WHERE seg_no > 2), r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY md5(concat_ws(':', 1337, key)), key) AS r FROM k) SELECT speaker, key FROM r WHERE r <= 4")
def t09(spark, sf):
    k = keyed(spark, sf)
    return T.sample_not_shown(k, k.filter("seg_no <= 2"), "key", ["speaker"], 4).select("speaker", "key")


@query("t10_clean_first_pool", """WITH {seg}, r AS (SELECT region, file_id * 100 + seg_no AS key, row_number() OVER (PARTITION BY region ORDER BY snr_db >= 15 DESC, duration DESC, file_id * 100 + seg_no) AS k FROM seg WHERE duration >= 2),
d AS (SELECT region, key, row_number() OVER (PARTITION BY region ORDER BY md5(concat_ws(':', 1337, key)), key) AS j FROM r WHERE k <= 150) SELECT region, key FROM d WHERE j <= 50""")
def t10(spark, sf):
    return T.clean_first_pool(keyed(spark, sf), "region", 50, "key", F.col("snr_db") >= 15).select("region", "key")


@query("t11_hold_out", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', 1337, vec_id)), vec_id) <= floor(0.2 * count(*) OVER (PARTITION BY label)) AS held_out FROM embeddings")
def t11(spark, sf):
    return T.hold_out(table(spark, sf, "embeddings"), "label", 0.2, "vec_id").select("vec_id", "held_out")


@query("t12_smoke_sample", "WITH {seg}, k AS (SELECT split, file_id * 100 + seg_no AS key, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws(':', 3, file_id * 100 + seg_no))) AS r FROM seg) SELECT split, key FROM k WHERE r <= 120")
def t12(spark, sf):
    return T.cap_per_group(keyed(spark, sf), "split", 120, T.draw(3, "key")).select("split", "key")


@query("t13_class_weights", """WITH c AS (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY label), w AS (SELECT 'inverse' AS mode, label, 1 / n AS w FROM c UNION ALL SELECT 'sqrt', label, 1 / sqrt(n) FROM c UNION ALL SELECT 'effective', label, 0.001 / (1 - pow(0.999, n)) FROM c UNION ALL SELECT 'none', label, 1 FROM c)
SELECT mode, label, round(w / avg(w) OVER (PARTITION BY mode), 6) AS weight FROM w""")
def t13(spark, sf):
    e = table(spark, sf, "embeddings")
    out = [T.class_weights(e, "label", m).select(F.lit(m).alias("mode"), "label", "weight") for m in ("none", "inverse", "sqrt", "effective")]
    from earshot.operators.summary import union_all

    return rounded(union_all(*out), "weight")
