"""Queries of the C operators, and J09 and J10."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from earshot.functions.vectors import mean_vectors, unit
from earshot.operators import clustering as K
from earshot.operators.components import connected_components
from earshot.plans.aggregates import rounded
from earshot.plans.registry import query
from earshot.session import stored, table

c = F.col
#: Vectors: a recording is vec_id % 25, a playlist the label, an actor vec_id % 40 inside it.
VEC = "v AS (SELECT vec_id, label, vec_id % 25 AS file_id, vec_id % 40 AS actor, embedding::DOUBLE[] AS e FROM embeddings)"
UNIT = VEC + ", u AS (SELECT *, list_transform(e, lambda x: x / CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS w FROM v)"
PAIRS = UNIT + ", p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.w, b.w) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id {on})"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", (c("vec_id") % 25).alias("file_id"), (c("vec_id") % 40).alias("actor"), c("embedding").alias("vec"))


def actors(spark, sf):
    return mean_vectors(vectors(spark, sf).withColumn("vec", unit(c("vec"))), ["label", "actor"], "vec")


def actor_pairs(spark, sf, least=-1.0):
    a = actors(spark, sf).withColumn("node", c("label") * 1000 + c("actor"))
    size = a.select("node", "n")
    p = K.similar_pairs(a, "label", "node", "centroid", least)
    return p.join(size.select(c("node").alias("a"), c("n").alias("n_a")), "a").join(size.select(c("node").alias("b"), c("n").alias("n_b")), "b").select("label", "a", "b", "sim", "n_a", "n_b")


@query("j09_similar_within", f"WITH {PAIRS.format(on='AND a.label = b.label')} SELECT label, a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.2")
def j09(spark, sf):
    return rounded(K.similar_pairs(vectors(spark, sf), "label", "vec_id", "vec", 0.2, 64), "sim")


@query("j10_similar_all", f"WITH {PAIRS.format(on='')} SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.3")
def j10(spark, sf):
    return rounded(K.similar_pairs(vectors(spark, sf), None, "vec_id", "vec", 0.3, 128), "sim")


MAD = UNIT + """, x AS (SELECT vec_id, file_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT file_id, i, median(x) AS m FROM x GROUP BY ALL), k AS (SELECT file_id, list(m ORDER BY i) AS m FROM m GROUP BY file_id),
d AS (SELECT u.file_id, vec_id, 1 - list_dot_product(w, m) / sqrt(list_dot_product(m, m)) AS d FROM u JOIN k USING (file_id)), n AS (SELECT file_id, median(d) AS md, count(*) AS n FROM d GROUP BY file_id),
a AS (SELECT file_id, median(abs(d - md)) AS mad FROM d JOIN n USING (file_id) GROUP BY file_id), z AS (SELECT file_id, vec_id, d, n <= 2 OR (d - md) / (1.4826 * greatest(mad, 1e-9)) <= 2.5 AS inlier FROM d JOIN n USING (file_id) JOIN a USING (file_id))"""


@query("c01_mad_outliers", f"WITH {MAD} SELECT file_id, vec_id, round(d, 6) AS distance, inlier FROM z")
def c01(spark, sf):
    return rounded(K.mad_outliers(vectors(spark, sf), ["file_id"], "vec_id", "vec"), "distance")


@query("c02_audit_speakers", f"WITH {MAD.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id % 10 <> 0)')} SELECT e.vec_id, e.vec_id % 10 = 0 OR NOT coalesce(inlier, true) AS is_excluded, CASE WHEN NOT coalesce(inlier, true) THEN 'mad_outlier' ELSE '' END AS exclude_reason FROM embeddings e LEFT JOIN z USING (vec_id)")
def c02(spark, sf):
    v = vectors(spark, sf).withColumns({"is_excluded": c("vec_id") % 10 == 0, "exclude_reason": F.lit("")})
    return K.audit_speakers(v, ["file_id"], "vec_id", "vec").select("vec_id", "is_excluded", "exclude_reason")


@query("c03_centroids", f"WITH {UNIT}, x AS (SELECT label, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT label, max(n) AS n, list(m ORDER BY i) AS m FROM m GROUP BY label) SELECT label, n, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, round(m[64] / sqrt(list_dot_product(m, m)), 6) AS last FROM k")
def c03(spark, sf):
    m = mean_vectors(vectors(spark, sf).withColumn("vec", unit(c("vec"))), ["label"], "vec")
    return m.select("label", "n", F.round(c("centroid")[0], 6).alias("first"), F.round(c("centroid")[63], 6).alias("last"))


@query("c04_average_linkage")
def c04(spark, sf):
    return K.average_linkage(vectors(spark, sf), "label", "vec_id", "vec", 0.8)


@query("c05_assign_actors")
def c05(spark, sf):
    v = vectors(spark, sf)
    clusters = K.average_linkage(v.filter("vec_id % 3 <> 0"), "label", "vec_id", "vec", 0.8)
    return K.assign_actors(v, clusters, "label", "vec_id").select("label", "vec_id", "global_actor")


CENTROIDS = UNIT + """, x AS (SELECT label, actor, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM u), m AS (SELECT label, actor, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT label, label * 1000 + actor AS node, max(n) AS n, list(m ORDER BY i) AS m FROM m GROUP BY label, actor),
q AS (SELECT label, node, n, list_transform(m, lambda y: y / sqrt(list_dot_product(m, m))) AS m FROM k), p AS (SELECT a.label, a.node AS a, b.node AS b, list_dot_product(a.m, b.m) AS sim, a.n AS n_a, b.n AS n_b FROM q a JOIN q b ON a.label = b.label AND a.node < b.node)"""


@query("c07_grey_zone", f"WITH {CENTROIDS}, f AS (SELECT label, median(sim) AS m, count(*) AS n FROM p GROUP BY label), d AS (SELECT label, median(abs(sim - m)) AS mad FROM p JOIN f USING (label) GROUP BY label) SELECT label, a, b, round(sim, 6) AS sim, n_a, n_b FROM p JOIN f USING (label) JOIN d USING (label) WHERE sim >= CASE WHEN n >= 10 THEN greatest(0.1, m + 1.0 * 1.4826 * mad) ELSE 0.1 END AND sim < 0.6 AND least(n_a, n_b) >= 1")
def c07(spark, sf):
    floors = K.grey_floors(actors(spark, sf).withColumn("node", c("label") * 1000 + c("actor")), "label", "node", "centroid", 0.1, 1.0)
    return rounded(K.grey_zone(actor_pairs(spark, sf, 0.1), floors, "label", 0.6, 1), "sim")


LINKED = CENTROIDS + """, r AS (SELECT a, b, sim, a % 3 AS region_a, b % 3 AS region_b, n_a, n_b FROM p), l AS (SELECT *, CASE WHEN region_a = region_b AND sim >= 0.5 THEN 'auto' WHEN least(n_a, n_b) >= 2 AND region_a = region_b AND sim >= 0.2 THEN 'review' WHEN region_a <> region_b AND sim >= 0.3 AND NOT (sim < 0.5 AND least(n_a, n_b) < 2) THEN 'cross' END AS link FROM r)"""


def linked(spark, sf):
    p = actor_pairs(spark, sf, 0.2).withColumns({"region_a": c("a") % 3, "region_b": c("b") % 3})
    return K.link_pairs(p, 0.5, 0.2, 0.3, 2)


@query("c08_link_pairs", f"WITH {LINKED} SELECT a, b, round(sim, 6) AS sim, link FROM l WHERE link IS NOT NULL")
def c08(spark, sf):
    return rounded(linked(spark, sf).select("a", "b", "sim", "link"), "sim")


#: Components of the edges s (a, b), both ways, by reaching.
REACH = "reach AS (SELECT DISTINCT a AS node, a AS r FROM s UNION SELECT reach.node, s.b FROM reach JOIN s ON s.a = reach.r), comp AS (SELECT node, min(r) AS root FROM reach GROUP BY node)"


@query("c06_merge_actors", f"""WITH RECURSIVE {CENTROIDS}, s AS (SELECT a, b FROM p WHERE sim >= 0.3 UNION SELECT b, a FROM p WHERE sim >= 0.3), {REACH}, g AS (SELECT label, node % 1000 AS actor, coalesce(root, node) AS root FROM q LEFT JOIN comp USING (node))
SELECT label, actor, dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS merged FROM g""")
def c06(spark, sf):
    return K.merge_actors(actors(spark, sf), "label", "actor", "centroid", 0.3)


@query("c09_canonical_speakers", f"""WITH RECURSIVE {LINKED}, s AS (SELECT a, b FROM l WHERE link = 'auto' UNION SELECT b, a FROM l WHERE link = 'auto'), {REACH}, g AS (SELECT node AS actor, n, coalesce(root, node) AS root FROM q LEFT JOIN comp USING (node)),
t AS (SELECT root, round(sum(n), 6) AS m FROM g GROUP BY root), o AS (SELECT root, row_number() OVER (ORDER BY m DESC, root) AS k FROM t), w AS (SELECT a, string_agg(DISTINCT b::VARCHAR, '; ' ORDER BY b::VARCHAR) AS partners FROM s GROUP BY a)
SELECT actor, printf('spk_%05d', k) AS speaker_global, coalesce(partners, '') AS partners FROM g JOIN o USING (root) LEFT JOIN w ON w.a = actor""")
def c09(spark, sf):
    a = actors(spark, sf).select((c("label") * 1000 + c("actor")).alias("actor"), c("n").cast("double").alias("minutes"))
    return K.canonical_speakers(a, stored(linked(spark, sf), "links"))


@query("c10_components", """WITH RECURSIVE e AS (SELECT o_custkey AS a, o_custkey % 97 + 100000 AS b FROM orders), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS reach FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node""")
def c10(spark, sf):
    o = table(spark, sf, "orders")
    return connected_components(o.select(c("o_custkey").alias("a"), (c("o_custkey") % 97 + 100000).alias("b")))


@query("c11_knee_tiers", """WITH s AS (SELECT l_suppkey % 5 AS playlist, (l_partkey % 60) * (l_partkey % 7) AS actor, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY n DESC, actor) AS rank, count(*) OVER (PARTITION BY playlist) AS c, max(n) OVER (PARTITION BY playlist) AS hi, min(n) OVER (PARTITION BY playlist) AS lo FROM s),
d AS (SELECT *, round(1 - (n - lo) / greatest(hi - lo, 1) - (rank - 1) / greatest(c - 1, 1), 9) AS d FROM r),
w AS (SELECT *, d >= coalesce(lag(d) OVER o, -2) AND d > coalesce(lead(d) OVER o, 2) AS top FROM d WINDOW o AS (PARTITION BY playlist ORDER BY rank)),
t AS (SELECT *, last_value(CASE WHEN top THEN d - 1 / greatest(c - 1, 1) END IGNORE NULLS) OVER o AS thr, last_value(CASE WHEN top THEN rank END IGNORE NULLS) OVER o AS peak FROM w WINDOW o AS (PARTITION BY playlist ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT playlist, arg_min(peak, rank) AS knee FROM t WHERE d < thr GROUP BY playlist), z AS (SELECT r.playlist, r.actor, rank, c, coalesce(knee, greatest(1, c // 3)) AS c1 FROM r LEFT JOIN k USING (playlist))
SELECT playlist, actor, rank, CASE WHEN rank <= c1 THEN 'Tier1' WHEN rank <= c1 + greatest(1, (c - c1) // 2) THEN 'Tier2' ELSE 'Tier3' END AS tier FROM z""")
def c11(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy((c("l_suppkey") % 5).alias("playlist"), (c("l_partkey") % 60 * (c("l_partkey") % 7)).alias("actor")).agg(F.count("*").alias("n"))
    return K.knee_tiers(sizes, "playlist", "actor")


@query("c12_cluster_chain")
def c12(spark, sf):
    """Outlier audit, average linkage, merging and tiers in turn."""
    v = vectors(spark, sf).withColumns({"is_excluded": F.lit(False), "exclude_reason": F.lit("")})
    kept = stored(K.audit_speakers(v, ["file_id"], "vec_id", "vec").filter("NOT is_excluded").select("vec_id", "label", "vec"), "kept")
    assigned = stored(K.assign_actors(kept, K.average_linkage(kept, "label", "vec_id", "vec", 0.8), "label", "vec_id"), "assigned")
    centres = mean_vectors(assigned.withColumn("vec", unit(c("vec"))), ["label", "global_actor"], "vec")
    merged = K.merge_actors(centres, "label", "global_actor", "centroid", 0.3)
    rows = assigned.join(merged, ["label", "global_actor"])
    sizes = rows.groupBy("label", "merged").agg(F.count("*").alias("n"))
    return rows.join(K.knee_tiers(sizes, "label", "merged"), ["label", "merged"]).select("vec_id", "label", "merged", "tier")


@query("c13_cohesion", f"WITH {UNIT}, x AS (SELECT label, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), k AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY label) SELECT label, count(*) AS n, round(avg(list_dot_product(w, m) / sqrt(list_dot_product(m, m))), 6) AS cohesion FROM u JOIN k USING (label) GROUP BY label")
def c13(spark, sf):
    return rounded(K.cohesion(vectors(spark, sf), ["label"], "vec"), "cohesion")


@query("c14_calibration", f"WITH {PAIRS.format(on='')} SELECT CASE WHEN a.label = b.label THEN 'within' WHEN a.label % 3 = b.label % 3 THEN 'region' ELSE 'cross' END AS kind, count(*) AS n, count(*) FILTER (WHERE sim >= 0.1) AS over_10, count(*) FILTER (WHERE sim >= 0.3) AS over_30, round(quantile_cont(sim, 0.9), 6) AS p90 FROM p JOIN v a ON p.a = a.vec_id JOIN v b ON p.b = b.vec_id GROUP BY 1")
def c14(spark, sf):
    v = vectors(spark, sf)
    kind = lambda a, b: np.where(a == b, 0, np.where(a % 3 == b % 3, 1, 2))
    out = K.calibration(v, "vec_id", "vec", "label", kind, ["within", "region", "cross"], [0.1, 0.3], block=512)
    return out.select("kind", "n", "over_10", "over_30", F.round(c("percentiles")[1], 6).alias("p90"))


PROTO = UNIT + ", x AS (SELECT label, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), k AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY label)"


@query("c15_prototypes", f"WITH {PROTO} SELECT a.label AS a, b.label AS b, round(list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m) * list_dot_product(b.m, b.m)), 6) AS sim FROM k a JOIN k b ON a.label <= b.label")
def c15(spark, sf):
    return rounded(K.prototype_matrix(vectors(spark, sf), "label", "vec"), "sim")


@query("c16_silhouette", f"""WITH {UNIT}, p AS (SELECT a.vec_id AS node, a.label AS la, b.label AS lb, avg(1 - list_dot_product(a.w, b.w)) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT node, la, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b FROM p GROUP BY ALL) SELECT node, la AS label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s""")
def c16(spark, sf):
    return rounded(K.silhouette(vectors(spark, sf), "label", "vec_id", "vec"), "silhouette")


@query("c17_discriminant")
def c17(spark, sf):
    v = vectors(spark, sf)
    axes = K.discriminant_axes(v.filter("vec_id % 5 <> 0"), "label", "vec", 64)
    return K.project(v, "vec", axes).select("vec_id", "label", F.round(c("projected")[0], 4).alias("x"), F.round(c("projected")[1], 4).alias("y"))


@query("c18_posteriors", """WITH p AS (SELECT o_custkey, avg(o_totalprice / 500000) AS p1, avg((o_custkey % 7) / 7e0) AS p2, avg(0.2e0) AS p3 FROM orders GROUP BY o_custkey), t AS (SELECT *, p1 + p2 + p3 AS t FROM p)
SELECT o_custkey, round(p1 / t, 6) AS p1, round(p2 / t, 6) AS p2, round(p3 / t, 6) AS p3, round(p2 / t + p3 / t / 2, 6) AS bary_x, round(p3 / t * sqrt(3) / 2, 6) AS bary_y FROM t""")
def c18(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", (c("o_totalprice") / 500000).alias("p1"), ((c("o_custkey") % 7) / 7).alias("p2"), F.lit(0.2).alias("p3"))
    return rounded(K.speaker_posteriors(o, "o_custkey", ["p1", "p2", "p3"]), "p1", "p2", "p3", "bary_x", "bary_y")


@query("c19_episode_matrix", f"WITH {CENTROIDS} SELECT label, a, b, round(1 - sim, 6) AS distance FROM p")
def c19(spark, sf):
    return actor_pairs(spark, sf, -2.0).select("label", "a", "b", F.round(1 - c("sim"), 6).alias("distance"))
