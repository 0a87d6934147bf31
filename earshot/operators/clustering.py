"""Outlier audit, actor clustering, merging, linking, tiers and centroid statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot import config as C
from earshot.functions.vectors import dot, mean_vectors, unit
from earshot.operators.components import connected_components
from earshot.operators.quantiles import FEW, exact_percentiles, group_sizes, spread_join
from earshot.operators.similarity import BLOCK, TILE, pair_quantiles, similar_pairs
from earshot.operators.splits import numbered
from earshot.session import forget, stored


MOST_CLASSES = 10_000


def mad_outliers(df: DataFrame, keys: list[str], row: str, vec: str, mult: float = C.MAD_MULTIPLIER, few: int = FEW) -> DataFrame:
    """(keys, row, distance, inlier): distance from the group's coordinate-wise median direction, and whether its robust z is at most mult.

    Groups of up to two rows are all inliers; a MAD of 0 counts as 1e-9. All medians are exact, and those of groups of over
    `few` rows come from refined histograms, so no task holds a group. A null key is a group; null vectors have no row in the result.
    """
    df = df.filter(F.col(vec).isNotNull())
    groups, largest = group_sizes(df, keys)
    keep = stored if largest > few else lambda t, name: t  # what several passes over large groups read

    def median(t: DataFrame, by: list[str], x: Column) -> DataFrame:
        return exact_percentiles(t, by, x, [0.5], few, largest=largest)

    med = median(df.select(*keys, F.posexplode(vec).alias("_i", "_x")), [*keys, "_i"], F.col("_x"))
    centre = med.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "q"))), lambda e: e["q"][0]).alias("_c"))
    centre = centre.withColumn("_c", unit(F.col("_c")))
    d = keep(spread_join(df.select(*keys, row, vec), centre, keys, rows=groups).select(*keys, row, (1 - dot(unit(F.col(vec)), F.col("_c"))).alias("distance")), "distances")
    mid = keep(median(d, keys, F.col("distance")).select(*keys, F.col("n").alias("_n"), F.col("q")[0].alias("_md")), "medians")
    e = spread_join(d, mid, keys, rows=groups)
    mad = median(e, keys, F.abs(F.col("distance") - F.col("_md"))).select(*keys, F.col("q")[0].alias("_mad"))
    z = (F.col("distance") - F.col("_md")) / (1.4826 * F.greatest("_mad", F.lit(1e-9)))
    return spread_join(e, mad, keys, rows=groups).select(*keys, row, "distance", ((F.col("_n") <= 2) | (z <= mult)).alias("inlier"))


def audit_speakers(df: DataFrame, keys: list[str], row: str, vec: str, mult: float = C.MAD_MULTIPLIER) -> DataFrame:
    """df with outliers among the rows that are not excluded yet excluded as mad_outlier."""
    out = mad_outliers(df.filter(~F.col("is_excluded")), keys, row, vec, mult).filter("NOT inlier").select(row, F.lit(True).alias("_out"))
    bad = F.coalesce("_out", F.lit(False))
    return df.join(out, row, "left").withColumns({"exclude_reason": F.when(bad, "mad_outlier").otherwise(F.coalesce("exclude_reason", F.lit(""))), "is_excluded": F.col("is_excluded") | bad}).drop("_out")


def average_linkage(df: DataFrame, within: str, node: str, vec: str, threshold: float = C.AHC_THRESHOLD, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """(within, node, cluster): average linkage by cosine distance, cut at the threshold; a cluster is named by its least node.

    For unit vectors the mean distance of two clusters follows from their sums and sizes. Average linkage is
    reducible: all mutual nearest neighbours merge in each round (ties: smallest name) and give the same tree, and a merged cluster is no nearer
    to a third one than its parts were. So each cluster's nearest neighbour is kept in a table, and only clusters that merged, or whose
    neighbour did, look again. A key that has come down to a block of clusters takes its other rounds in one task, as a block is one task's work
    anyhow. No table that grows is broadcast. Tables of finished rounds are deleted. report: gets (clusters that looked, comparisons) of each
    round over all tasks.
    """
    members = stored(df.select(within, F.col(node).alias("node"), F.col(node).alias("cluster")), "members")
    now = stored(df.select(within, F.col(node).alias("cluster"), unit(F.col(vec)).alias("sum"), F.lit(1).cast("long").alias("n")), "clusters")
    asking, near, all_looked = now, None, True
    while True:
        if report is not None:
            counts = asking.groupBy(within).agg(F.count("*").alias("a")).join(now.groupBy(within).agg(F.count("*").alias("b")), within)
            report.append(tuple(counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()))
        found = _nearest(asking, now, within, threshold, block)
        old, near = near, stored(found if near is None else near.unionByName(found), "near")
        both = near.alias("x").join(near.hint("merge").alias("y"), (F.col(f"x.{within}") == F.col(f"y.{within}")) & (F.col("x.cluster") == F.col("y.near")) & (F.col("x.near") == F.col("y.cluster")))
        merge = stored(both.filter("x.cluster > y.cluster").select(F.col(f"x.{within}").alias(within), F.col("x.cluster").alias("cluster"), F.col("y.cluster").alias("into")), "merge")
        if old is not None:
            forget(*old.parts)
        if not merge.limit(1).count():
            forget(near, merge)
            if all_looked:
                forget(now)
                return members
            # equal distances can leave a circle of choices that are older than a name: all look again
            asking, near, all_looked = now, None, True
            continue
        to = F.coalesce("into", "cluster")
        new_members = stored(members.join(merge.hint("merge"), [within, "cluster"], "left").select(within, "node", to.alias("cluster")), "members")
        moved = now.join(merge.hint("merge"), [within, "cluster"], "left").select(within, to.alias("cluster"), "sum", "n")
        added = moved.groupBy(within, "cluster").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("sum")).alias("s"))
        total = F.aggregate(F.slice("s", 2, 10), F.col("s")[0], lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
        new = stored(added.select(within, "cluster", total.alias("sum"), "n"), "clusters")
        forget(members, now)
        members, now = new_members, new
        sizes = stored(now.filter(F.col(within).isNotNull()).groupBy(within).agg((F.count("*") <= block).alias("small")), "sizes")
        small = sizes.filter("small").select(within)
        some, more = sizes.agg(F.count_if("small") > 0, F.count_if(~F.col("small")) > 0).first()
        if some:
            ends = stored(_finished(now.join(small, within, "left_semi"), within, threshold), "ends")
            new_members = stored(members.join(ends.hint("merge"), [within, "cluster"], "left").select(within, "node", to.alias("cluster")), "members")
            forget(members, ends)
            members = new_members
            if not more:
                forget(near, merge, sizes, now)
                return members
            left = stored(now.join(small, within, "left_anti"), "clusters")
            forget(now)
            now = left
        touched = merge.select(within, F.explode(F.array("cluster", "into")).alias("near"))
        rest = near.join(small, within, "left_anti").join(touched.withColumnRenamed("near", "cluster").hint("merge"), [within, "cluster"], "left_anti")
        names = rest.join(touched.hint("merge"), [within, "near"], "left_semi").select(within, "cluster").unionByName(merge.select(within, F.col("into").alias("cluster")))
        asking = now.join(names.hint("merge"), [within, "cluster"], "left_semi")
        kept = rest.join(touched.hint("merge"), [within, "near"], "left_anti").select(within, "cluster", "near")
        kept.parts, near, all_looked = (near, merge, sizes), kept, False


def _finished(clusters: DataFrame, within: str, threshold: float) -> DataFrame:
    """(within, cluster, into): the cluster at the end of each one, by the same rounds, a key in a task."""
    kinds = dict(clusters.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        s, n, ids = np.array(pdf["sum"].tolist(), np.float64), pdf["n"].to_numpy().copy(), pdf["cluster"].to_numpy()
        near, into = np.full(len(n), -1), np.arange(len(n))
        asking, all_looked = into.copy(), True
        while True:
            live = np.flatnonzero(into == np.arange(len(n)))
            for at in range(0, len(asking), 512):
                k = asking[at : at + 512]
                d = np.round(1 - (s[k] @ s[live].T) / np.outer(n[k], n[live]), 9)
                d[k[:, None] == live] = np.inf
                best = d.argmin(axis=1)
                near[k] = np.where(d[np.arange(len(k)), best] <= threshold, live[best], -1)
            a = live[near[live] >= 0]
            a = a[(near[near[a]] == a) & (a > near[a])]
            b = near[a]
            if not len(a):
                if all_looked:
                    break
                asking, all_looked = live, True
                continue
            s[b] += s[a]
            n[b] += n[a]
            into[a] = b
            near[a] = -1
            again = np.isin(near, np.concatenate([a, b]))
            again[b] = True
            asking, all_looked = np.flatnonzero(again), False
        for i in range(len(into)):  # a name only goes into a lesser one
            into[i] = into[into[i]]
        return pd.DataFrame({within: pdf[within].to_numpy(), "cluster": ids, "into": ids[into]})

    return clusters.groupBy(within).applyInPandas(run, f"`{within}` {kinds[within]}, cluster {kinds['cluster']}, into {kinds['cluster']}")


def _nearest(asking: DataFrame, clusters: DataFrame, within: str, threshold: float, block: int) -> DataFrame:
    """(within, cluster, near): the nearest other cluster within the threshold (ties: smallest name) of each one that asks.

    A task holds a block of a key's asking clusters and a block of all of its clusters; each gives its best partners, and the best of these counts.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(within).agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias(name))

    n = blocks(asking, "_a").join(blocks(clusters, "_c"), within)

    def dealt(df: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        mine, all_of = F.pmod(F.xxhash64("cluster"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = df.join(n, within).withColumn("_own", mine).withColumn("_all", all_of)
        return rows.select(within, F.col("_own" if asks else "_all").alias("_x"), F.col("_all" if asks else "_own").alias("_y"), F.lit(asks).alias("asks"), "cluster", "sum", "n")

    rows = dealt(asking, "_a", "_c", True).unionByName(dealt(clusters, "_c", "_a", False))
    kinds = dict(clusters.dtypes)

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        s, n, ids, asks = np.array(pdf["sum"].tolist(), np.float64), pdf["n"].to_numpy(), pdf["cluster"].to_numpy(), pdf["asks"].to_numpy()
        i, j = np.flatnonzero(asks), np.flatnonzero(~asks)
        best, least = best_of(s / n[:, None], ids, i, j)
        good = least <= threshold
        return pd.DataFrame({within: pdf[within].iloc[0], "cluster": ids[i[good]], "near": ids[j[best[good]]], "d": least[good]})

    def best_of(means, ids, i, j):
        """For each row of i the place in j of its nearest other cluster (ties: the first) and their distance, tile by tile."""
        best, least, held = np.zeros(len(i), np.int64), np.full(len(i), np.inf), np.empty(TILE[0] * TILE[1])
        own = np.searchsorted(ids[j], ids[i])  # where a row would meet itself
        own[(own == len(j)) | (ids[j[np.minimum(own, len(j) - 1)]] != ids[i])] = -1
        for x in range(0, len(i) if len(j) else 0, TILE[0]):
            at = slice(x, x + TILE[0])
            for y in range(0, len(j), TILE[1]):
                k = j[y : y + TILE[1]]
                c = np.matmul(means[i[at]], means[k].T, out=held[: len(i[at]) * len(k)].reshape(-1, len(k)))
                me = np.flatnonzero((own[at] >= y) & (own[at] < y + len(k)))
                c[me, own[at][me] - y] = -np.inf
                top = c.max(axis=1)
                d = np.round(1 - top, 9)
                # of those that round to the same distance the first counts
                r, col = np.divmod(np.flatnonzero((c >= (top - 2e-9)[:, None]) & (d < least[at])[:, None]), len(k))
                same = np.round(1 - c[r, col], 9) == d[r]
                rows, first = np.unique(r[same], return_index=True)
                best[x + rows], least[x + rows] = y + col[same][first], d[rows]
        return best, least

    found = rows.groupBy(within, "_x", "_y").applyInPandas(near, f"`{within}` {kinds[within]}, cluster {kinds['cluster']}, near {kinds['cluster']}, d double")
    return found.groupBy(within, "cluster").agg(F.min(F.struct("d", "near"))["near"].alias("near"))


def assign_actors(df: DataFrame, clusters: DataFrame, within: str, node: str) -> DataFrame:
    """df with global_actor: clusters numbered from 0 in each key by their least node; -1 where there is none."""
    dense = clusters.withColumn("global_actor", F.dense_rank().over(Window.partitionBy(within).orderBy("cluster")) - 1).select(within, F.col("node").alias(node), "global_actor")
    return df.join(dense.hint("merge"), [within, node], "left").withColumn("global_actor", F.coalesce("global_actor", F.lit(-1)))


def merge_actors(actors: DataFrame, within: str, actor: str, vec: str, auto: float = C.MERGE_AUTO_SIM) -> DataFrame:
    """(within, actor, merged): actors joined by similarity of at least auto, numbered from 0 in each key.

    actors: unit centroids, actor numbers are unique only inside a key.
    """
    uid = F.xxhash64(within, actor)
    pairs = similar_pairs(actors, within, actor, vec, auto)
    edges = pairs.select(F.xxhash64(within, "a").alias("a"), F.xxhash64(within, "b").alias("b"))
    groups = connected_components(edges)
    named = actors.select(within, actor, uid.alias("node")).join(groups, "node", "left").withColumn("_g", F.coalesce("component", "node"))
    root = F.min(actor).over(Window.partitionBy(within, "_g"))
    return named.withColumn("_root", root).select(within, actor, (F.dense_rank().over(Window.partitionBy(within).orderBy("_root")) - 1).alias("merged"))


def grey_floors(actors: DataFrame, within: str, actor: str, vec: str, review: float = C.MERGE_REVIEW_SIM, z: float = C.MERGE_REVIEW_Z, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(within, floor): the larger of `review` and median + z robust deviations of the similarities of all pairs of a key, if it has ten pairs.

    The quantiles are counted inside pairs of blocks; no pair leaves a task.
    """
    mid = stored(pair_quantiles(actors, within, actor, vec, [0.5], block=block, few=few).select("_k", "n", F.col("q")[0].alias("mid")), "mid")
    mad = pair_quantiles(actors, within, actor, vec, [0.5], centre=mid.select("_k", "mid"), block=block, few=few).select("_k", F.col("q")[0].alias("mad"))
    floor = F.when(F.col("n") >= 10, F.greatest(F.lit(review), F.col("mid") + z * 1.4826 * F.col("mad"))).otherwise(F.lit(review))
    return stored(spread_join(mid, mad, ["_k"]).select(F.col("_k").alias(within), floor.alias("floor")), "floors")


def grey_zone(pairs: DataFrame, floors: DataFrame, within: str, auto: float = C.MERGE_AUTO_SIM, least: int = C.MERGE_MIN_SEGMENTS) -> DataFrame:
    """Candidates for review among the pairs (within, a, b, sim, n_a, n_b) of a key: from its adaptive floor up to auto.

    pairs: those of at least the review similarity are enough, as no floor (grey_floors) lies below it.
    """
    out = spread_join(pairs, floors, [within])
    return out.filter((F.col("sim") >= F.col("floor")) & (F.col("sim") < auto) & (F.least("n_a", "n_b") >= least)).select(*pairs.columns)


def link_pairs(pairs: DataFrame, auto: float = C.LINK_AUTO_SIM, review: float = C.LINK_REVIEW_SIM, cross: float = C.LINK_CROSS_SIM, least: int = C.MERGE_MIN_SEGMENTS) -> DataFrame:
    """pairs (a, b, sim, region_a, region_b, n_a, n_b) with link: auto, review or cross; others are dropped."""
    same = F.col("region_a") == F.col("region_b")
    small = F.least("n_a", "n_b") < least
    kind = F.when(same & (F.col("sim") >= auto), "auto").when(~small & same & (F.col("sim") >= review), "review").when(~same & (F.col("sim") >= cross) & ~((F.col("sim") < auto) & small), "cross")
    return pairs.withColumn("link", kind).filter("link IS NOT NULL")


def canonical_speakers(actors: DataFrame, links: DataFrame) -> DataFrame:
    """(actor, speaker_global, partners): groups of auto links numbered by minutes, most first (ties: least actor). actors: (actor, minutes)."""
    groups = connected_components(links.filter("link = 'auto'"), "a", "b").withColumnRenamed("node", "actor")
    g = actors.join(groups, "actor", "left").withColumn("root", F.coalesce("component", "actor"))
    totals = g.groupBy("root").agg(F.round(F.sum("minutes"), 6).alias("m"))
    order = numbered(totals, "k", F.desc("m"), F.col("root"))
    both = links.filter("link = 'auto'").select(F.explode(F.array(F.struct(F.col("a").alias("actor"), F.col("b").alias("other")), F.struct(F.col("b").alias("actor"), F.col("a").alias("other")))).alias("e")).select("e.*")
    partners = both.groupBy("actor").agg(F.concat_ws("; ", F.sort_array(F.collect_set(F.col("other").cast("string")))).alias("partners"))
    return g.join(order, "root").join(partners, "actor", "left").select("actor", F.format_string("spk_%05d", "k").alias("speaker_global"), F.coalesce("partners", F.lit("")).alias("partners"))


def knee_tiers(sizes: DataFrame, within: str, actor: str, size: str = "n", sensitivity: float = C.KNEE_SENSITIVITY) -> DataFrame:
    """(within, actor, rank, tier): Tier1 up to the knee of the size curve, Tier2 half of the rest, Tier3.

    Knee of a convex falling curve by normalised differences: the first local maximum of (1 - y) - x after which the
    curve falls under its threshold before a higher maximum. Without one, a third of the actors.
    """
    w = Window.partitionBy(within)
    r = sizes.withColumn("rank", F.row_number().over(w.orderBy(F.desc(size), actor))).withColumns({"_n": F.count("*").over(w), "_hi": F.max(size).over(w), "_lo": F.min(size).over(w)})
    x, y = (F.col("rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)), (F.col(size) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    line = w.orderBy("rank")
    d = r.withColumn("_d", F.round(1 - y - x, 9)).withColumns({"_was": F.lag("_d").over(line), "_next": F.lead("_d").over(line)})
    top = (F.col("_d") >= F.coalesce("_was", F.lit(-2.0))) & (F.col("_d") > F.coalesce("_next", F.lit(2.0)))
    d = d.withColumn("_t", F.when(top, F.col("_d") - sensitivity / F.greatest(F.col("_n") - 1, F.lit(1))))
    last = F.last("_t", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    at = F.last(F.when(top, F.col("rank")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    knees = d.withColumns({"_thr": last, "_at": at}).filter(F.col("_d") < F.col("_thr")).groupBy(within).agg(F.min(F.struct("rank", "_at"))["_at"].alias("knee"))
    t = r.join(knees, within, "left").withColumn("_c1", F.coalesce("knee", F.greatest(F.lit(1), F.floor(F.col("_n") / 3))))
    c2 = F.col("_c1") + F.greatest(F.lit(1), F.floor((F.col("_n") - F.col("_c1")) / 2))
    return t.select(within, actor, "rank", F.when(F.col("rank") <= F.col("_c1"), "Tier1").when(F.col("rank") <= c2, "Tier2").otherwise("Tier3").alias("tier"))


def cohesion(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, n, cohesion): mean cosine of a group's vectors with its centroid."""
    centres = mean_vectors(df.withColumn(vec, unit(F.col(vec))), keys, vec)
    return df.join(centres, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(dot(unit(F.col(vec)), F.col("centroid"))).alias("cohesion"))


def prototype_matrix(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(a, b, sim) of all class prototypes. Classes are few; their table is one row for each."""
    p = mean_vectors(df.withColumn(vec, unit(F.col(vec))), [by], vec).select(by, "centroid")
    a, b = p.select(F.col(by).alias("a"), F.col("centroid").alias("x")), p.select(F.col(by).alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", dot(F.col("x"), F.col("y")).alias("sim"))


def silhouette(df: DataFrame, by: str, node: str, vec: str) -> DataFrame:
    """(node, by, silhouette): exact cosine silhouettes from class sums of unit vectors; no pair is compared.

    The sums of all classes go to every task in one row, so there may be MOST_CLASSES of them at most.
    """
    rows = df.select(F.col(by).alias("own"), F.col(node).alias("node"), unit(F.col(vec)).alias("v"))
    sums = mean_vectors(rows, ["own"], "v", normalise=False).select(F.col("own").alias("other"), "n", F.transform("centroid", lambda x: x * F.col("n")).alias("s"))
    sums = stored(sums, "sums")
    if sums.count() > MOST_CLASSES:
        raise ValueError(f"over {MOST_CLASSES} classes")
    d = rows.crossJoin(F.broadcast(sums.agg(F.collect_list(F.struct("other", "n", "s")).alias("all"))))

    def mean(c: Column, same: Column) -> Column:
        to_own = F.when(c["n"] > 1, (c["n"] - 1 - (dot(F.col("v"), c["s"]) - 1)) / (c["n"] - 1))
        return F.when(same, to_own).otherwise(1 - dot(F.col("v"), c["s"]) / c["n"])

    each = d.withColumn("m", F.transform("all", lambda c: F.struct((c["other"] == F.col("own")).alias("same"), mean(c, c["other"] == F.col("own")).alias("m"))))
    g = each.select("node", "own", F.array_max(F.transform(F.filter("m", lambda x: x["same"]), lambda x: x["m"])).alias("a"), F.array_min(F.transform(F.filter("m", lambda x: ~x["same"]), lambda x: x["m"])).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return g.select("node", F.col("own").alias(by), s.alias("silhouette"))


def calibration(df: DataFrame, node: str, vec: str, label: str, kind, kinds: list[str], marks: list[float], shares: list[float] = (0.5, 0.9, 0.99), block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(kind, n, percentiles, over_<mark> ...) of the similarities of all pairs by kind, for calibrating thresholds.

    kind(labels, labels) numbers the kinds of pairs. Labels travel with the vectors and pairs are counted where they are made.
    """
    q = pair_quantiles(df, None, node, vec, list(shares), label, kind, marks, block=block, few=few)
    name = F.element_at(F.array(*map(F.lit, kinds)), (F.col("kind") + 1).cast("int"))
    return q.select(name.alias("kind"), "n", F.col("q").alias("percentiles"), *[F.col("over")[i].alias(f"over_{int(round(100 * m))}") for i, m in enumerate(marks)])


def discriminant_axes(df: DataFrame, by: str, vec: str, dims: int, axes: int = 2) -> np.ndarray:
    """(axes, dims) linear discriminant axes. Scatter matrices (dims x dims) are summed over partitions in Spark; the driver solves one eigenproblem."""
    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for label, own in pdf.groupby(by):
                v = np.array(own[vec].tolist(), np.float64)
                a = sums.setdefault(label, [0, np.zeros(dims), np.zeros((dims, dims))])
                a[0] += len(v)
                a[1] += v.sum(axis=0)
                a[2] += v.T @ v
        for label, (n, s, q) in sums.items():
            yield pd.DataFrame({"label": [str(label)], "n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = df.select(by, vec).mapInPandas(partial, "label string, n long, s array<double>, q array<double>")
    flat = parts.select("label", F.lit(0).alias("kind"), F.posexplode("s").alias("i", "x")).unionByName(parts.select("label", F.lit(1).alias("kind"), F.posexplode("q").alias("i", "x")))
    total = flat.groupBy("label", "kind", "i").agg(F.sum("x").alias("x")).collect()  # classes x dims squared
    counts = {r.label: r.n for r in parts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    s, q = {k: np.zeros(dims) for k in counts}, np.zeros(dims * dims)
    for r in total:
        if r.kind:
            q[r.i] += r.x
        else:
            s[r.label][r.i] = r.x
    n = sum(counts.values())
    mean = sum(s.values()) / n
    between = sum(counts[k] * np.outer(s[k] / counts[k] - mean, s[k] / counts[k] - mean) for k in counts)
    inner = q.reshape(dims, dims) - sum(np.outer(s[k], s[k]) / counts[k] for k in counts) + 1e-6 * np.eye(dims)
    low = np.linalg.cholesky(inner)
    inverse = np.linalg.inv(low)
    values, vectors = np.linalg.eigh(inverse @ between @ inverse.T)
    return (inverse.T @ vectors[:, np.argsort(-values)[:axes]]).T


def project(df: DataFrame, vec: str, axes: np.ndarray) -> DataFrame:
    """df with `projected`: dot products with each axis."""
    return df.withColumn("projected", F.array(*[dot(F.col(vec), F.array(*[F.lit(float(x)) for x in a])) for a in axes]))


def speaker_posteriors(df: DataFrame, speaker: str, classes: list[str]) -> DataFrame:
    """(speaker, classes ..., bary_x, bary_y): mean posteriors of each speaker, made to add up to 1, and barycentric coordinates for three classes."""
    g = df.groupBy(speaker).agg(*[F.avg(c).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    g = g.withColumn("_t", F.when(total == 0, 1.0).otherwise(total)).select(speaker, *[(F.col(c) / F.col("_t")).alias(c) for c in classes])
    return g.withColumns({"bary_x": F.col(classes[1]) + F.col(classes[2]) / 2, "bary_y": F.col(classes[2]) * float(np.sqrt(3) / 2)}) if len(classes) == 3 else g
