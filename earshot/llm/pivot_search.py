"""Exact top-k search by inner product with a pivot table.

Components become integers. PIVOTS far rows of a bounded sample are the pivots; every candidate is stored once with its
distances to all of them, in cells by nearest pivot, cells in blocks of BLOCK rows at most. For a query q and a
candidate x, 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 and d(q, x) is at least |d(q, p) - d(x, p)| for every pivot p, so the largest of
these bounds the score from above. Each query searches a block of its own cell first. Its k-th best score there rules
out whole cells; inside the other blocks the pivot table bounds all candidates, which are evaluated in the order
of their bounds until the next one cannot reach the k-th best score.

Equal vectors are one candidate with its k + 1 least keys, equal queries one query, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.metric import distances, farthest, sample_vectors
from earshot.session import bound_batches, stored

PIVOTS, SAMPLE = 48, 2048
BLOCK = 4096
AT_ONCE = 64  # queries of which bounds are held at once
FIRST = 32  # candidates evaluated first, then four times as many each time
SALTS = 16
LARGEST = 1 << 26  # of an integer component; inner products of up to 2,048 of them fit 64 bits
EXACT = float(1 << 53)


def integers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where a component is null, not finite, or larger than LARGEST / scale."""
    fits = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST / scale, F.lit(False)))
    return F.when(fits, F.transform(vec, lambda x: F.floor(scale * x.cast("double"))))


def _matrix(column) -> np.ndarray:
    """The lists of an Arrow column, all of one length, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _with_distances(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """df (with `v`) with |v|^2, its distances to the pivots, and the nearest one."""

    def run(batches):
        for b in batches:
            v = _matrix(b.column("v")).astype(np.float64)
            d = distances(v, pivots)
            extra = [pa.array((v * v).sum(axis=1)), pa.FixedSizeListArray.from_arrays(pa.array(d.astype(np.float32).ravel()), d.shape[1]).cast(pa.list_(pa.float32())), pa.array(d.argmin(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "size2", "d", "cell"])

    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, size2 double, d array<float>, cell int")


def _spans(table: DataFrame, pivots: int) -> DataFrame:
    """(cell, n, size2, low, high): rows, largest |v|^2, and least and largest distances to each pivot in each cell."""

    def run(batches):
        n, size2 = np.zeros(pivots, np.int64), np.zeros(pivots)
        low, high = np.full((pivots, pivots), np.inf), np.zeros((pivots, pivots))
        for b in batches:
            cell, d = b.column("cell").to_numpy(), _matrix(b.column("d"))
            n += np.bincount(cell, minlength=pivots)
            np.maximum.at(size2, cell, b.column("size2").to_numpy())
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(own, pa.int32()), "n": n[own], "size2": size2[own], "low": pa.array(list(low[own]), pa.list_(pa.float64())), "high": pa.array(list(high[own]), pa.list_(pa.float64()))})

    parts = table.select("cell", "size2", "d").mapInArrow(run, "cell int, n long, size2 double, low array<double>, high array<double>")
    each = parts.select("cell", "n", "size2", F.posexplode(F.arrays_zip("low", "high")).alias("p", "x"))
    by = each.groupBy("cell", "p").agg(F.sum("n").alias("n"), F.max("size2").alias("size2"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "low", "high")))
    return by.groupBy("cell").agg(F.max("n").alias("n"), F.max("size2").alias("size2"), ordered["low"].alias("low"), ordered["high"].alias("high"))


def best_in_block(queries: dict, rows: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, row number, score) of each query's k best rows that reach its threshold, and how many were evaluated.

    queries and rows: v, size2, d; queries also `least`, the score that counts; rows also `first`, which breaks ties.
    """
    slack = 1e-6 * max(queries["d"].max(initial=0), rows["d"].max(initial=0)) + 1e-6
    whole = np.sqrt(queries["size2"].max(initial=0) * rows["size2"].max(initial=0)) < EXACT
    qv, xv = (x["v"].astype(np.float64 if whole else np.int64) for x in (queries, rows))
    out, evaluated = [], 0
    for at in range(0, len(qv), AT_ONCE):
        d = queries["d"][at : at + AT_ONCE]
        bound = np.zeros((len(d), len(xv)), np.float32)
        for p in range(d.shape[1]):
            np.maximum(bound, np.abs(d[:, p, None] - rows["d"][:, p]), out=bound)
        lower = np.maximum(bound.astype(np.float64) - slack, 0)
        upper = (queries["size2"][at : at + AT_ONCE, None] + rows["size2"] - lower * lower) / 2 + 1e-3
        upper += 1e-12 * np.abs(upper)
        for i in range(len(d)):
            least, u = queries["least"][at + i], upper[i]
            left = np.flatnonzero(u >= least)
            left = left[np.argsort(-u[left], kind="stable")]
            ids, scores, n = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST
            while len(left) and u[left[0]] >= least:
                now, left, n = left[:n], left[n:], 4 * n
                evaluated += len(now)
                ids, scores = np.concatenate([ids, now]), np.concatenate([scores, (xv[now] @ qv[at + i]).astype(np.int64)])
                order = np.lexsort((rows["first"][ids], -scores))[:k]
                ids, scores = ids[order], scores[order]
                if len(ids) == k:
                    least = max(least, float(scores[-1]))
            keep = scores >= queries["least"][at + i]
            out.append((np.full(int(keep.sum()), at + i), ids[keep], scores[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), evaluated)


def _search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(qid, score, first, ids): each query's k best rows in each block it is dealt to. Both sides have cell, sub and part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
        sides = [{"v": _matrix(t.column("v")), "d": _matrix(t.column("d")), "size2": t.column("size2").to_numpy()} for t in (left, right)]
        sides[0]["least"], sides[1]["first"] = left.column("least").to_numpy(), right.column("first").to_numpy()
        q, x, score, _ = best_in_block(*sides, k)
        return pa.table({"qid": left.column("qid").take(pa.array(q)), "score": pa.array(score, pa.int64()), "first": right.column("first").take(pa.array(x)), "ids": right.column("ids").take(pa.array(x))})

    at = ["cell", "sub", "part"]
    left = queries.select(*at, "qid", "v", "size2", "d", "least")
    right = rows.select(*at, "first", "ids", "v", "size2", "d")
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(run, "qid long, score long, first long, ids array<long>")


def _dealt(queries: DataFrame, subs: DataFrame, reach: Column) -> DataFrame:
    """queries to each block (cell, sub) of the cells that reach gives; subs: (cell, subs)."""
    return queries.drop("cell").withColumn("cell", F.explode(reach)).join(F.broadcast(subs), "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")


def top_k(df: DataFrame, asked: Column, k: int, key: str = "vec_id", vec: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each asked row's k best other rows by integer inner product, ties to the smaller key.

    asked: over the key. Rows with a null key or vector, or a component that is null, not finite or over LARGEST / scale take no part;
    shorter vectors count as ended by zeros. Rows that repeat a key count once, by their smallest vector. A query without
    other rows has no rows in the result; an empty table gives none; other columns are ignored.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), integers(F.col(vec), scale).alias("v")).filter("id is not null and v is not null")
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v"))
    rows = stored(rows, "integers")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    asked = rows.select("id", "v", "h").withColumnRenamed("id", key).filter(asked).withColumnRenamed(key, "id")
    least_ids = Window.partitionBy("h", "v").orderBy("id")
    first = rows.withColumn("r", F.row_number().over(least_ids)).filter(F.col("r") <= k + 1)
    full = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    classes = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("first"), "ids", full.alias("v"))
    kinds = asked.groupBy("h", "v").agg(F.min("id").alias("qid"))

    pivots = farthest(sample_vectors(classes, "first", "v", SAMPLE), PIVOTS)
    if not len(pivots):
        pivots = np.zeros((1, dims))
    table = stored(_with_distances(classes, pivots), "pivots")
    queries = stored(_with_distances(kinds.select("qid", full.alias("v")), pivots), "queries")

    spans = sorted(_spans(table, len(pivots)).collect(), key=lambda r: r.cell)  # at most PIVOTS rows
    subs = df.sparkSession.createDataFrame([(r.cell, -(-r.n // block)) for r in spans], "cell int, subs int")
    cells, largest = np.array([r.cell for r in spans], np.int64), np.array([r.size2 for r in spans])
    low, high = (np.array([r[f] for r in spans], np.float64).reshape(len(spans), len(pivots)) for f in ("low", "high"))
    parts = max(1, -(-queries.count() // block))
    part = F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(parts)).cast("int")
    queries = queries.withColumn("part", part)
    dealt = table.join(F.broadcast(subs), "cell").withColumn("sub", F.pmod(F.xxhash64("first"), F.col("subs")).cast("int")).drop("subs").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    # each query's own cell, one block of it: the (k + 1)-th best score there is a threshold
    home = queries.withColumn("least", F.lit(float("-inf"))).join(F.broadcast(subs), "cell").withColumn("sub", F.pmod(F.xxhash64("qid"), F.col("subs")).cast("int"))
    seen = _search(home, dealt, k + 1).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s"))
    known = stored(queries.join(seen.filter(F.col("n") == k + 1).select("qid", "s"), "qid", "left").withColumn("least", F.coalesce("s", F.lit(float("-inf")))).drop("s"), "thresholds")

    def reached(batches):
        for b in batches:
            d, size2, least = _matrix(b.column("d")).astype(np.float64), b.column("size2").to_numpy(), b.column("least").to_numpy()
            gap = np.zeros((len(d), len(cells)))
            for p in range(d.shape[1]):
                np.maximum(gap, np.maximum(d[:, p, None] - high[:, p], low[:, p] - d[:, p, None]), out=gap)
            slack = 1e-6 * max(d.max(initial=0), high.max(initial=0)) + 1e-6
            upper = (size2[:, None] + largest - np.maximum(gap - slack, 0) ** 2) / 2
            ok = upper + 1e-3 + 1e-12 * np.abs(upper) >= least[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)), pa.array(np.broadcast_to(cells, ok.shape)[ok].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "reach"])

    reach = known.mapInArrow(reached, ", ".join(f"{c} {t}" for c, t in known.dtypes) + ", reach array<int>")
    found = _search(_dealt(reach, subs, F.col("reach")).drop("reach"), dealt, k + 1)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    top = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    each = top.groupBy("qid").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"))))).alias("all"))
    best = each.select("qid", F.slice(F.array_sort("all"), 1, k + 1).alias("best")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = kinds.select("h", "v", "qid", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "v", "salt"]).select("qid", "salt", F.col("id").alias("query_id"))
    others = members.join(best, ["qid", "salt"]).select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    return others.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
