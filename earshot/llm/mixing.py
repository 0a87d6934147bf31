"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow routes each
pattern's words to its sources' quotas; the k-th repetition of a pattern costs more than the one before it,
so repetition is spread as evenly as the targets allow. The plan has one row per pattern, and documents are then selected by a seeded hash: whole bands of hashes are
taken or left, and only the band in which a pattern's words run out is ordered, so that no source's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.splits import numbered
from earshot.session import forget, stored

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
MAX_PATTERNS = 100_000
BAND_ROWS = 1_000
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def water_fill(sizes: list[int], weights: list[float], most: float = MOST, total: float | None = None) -> list[float]:
    """Shares of total (default: the sum of sizes) by weight, none above most * size; what is cut off is shared again by weight."""
    total = float(sum(sizes) if total is None else total)
    out, left = [0.0] * len(sizes), total
    free = set(range(len(sizes)))
    while free and left > 0:
        w = sum(weights[i] for i in free)
        if not w:
            break
        full = [i for i in free if left * weights[i] / w >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        free -= set(full)
        left = total - sum(out)
    return out


class Flow:
    """A flow network whose capacities may grow; augment() adds what a maximum flow still can, by blocking flows over shortest paths."""

    def __init__(self, nodes: int):
        self.to, self.left, self.out = [], [], [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: float) -> int:
        """The edge's number; number + 1 is its reverse, whose capacity is the flow."""
        self.to += [b, a]
        self.left += [capacity, 0.0]
        self.out[a].append(len(self.to) - 2)
        self.out[b].append(len(self.to) - 1)
        return len(self.to) - 2

    def _levels(self, source: int, sink: int, tiny: float) -> list[int] | None:
        level, now = [-1] * len(self.out), [source]
        level[source] = 0
        while now and level[sink] < 0:
            after = []
            for a in now:
                for e in self.out[a]:
                    b = self.to[e]
                    if self.left[e] > tiny and level[b] < 0:
                        level[b] = level[a] + 1
                        after.append(b)
            now = after
        return level if level[sink] >= 0 else None

    def augment(self, source: int, sink: int, tiny: float = 1e-6) -> None:
        to, left, out = self.to, self.left, self.out
        while (level := self._levels(source, sink, tiny)) is not None:
            tried, path, a = [0] * len(out), [], source
            while True:
                if a == sink:
                    push = min(left[e] for e in path)
                    for e in path:
                        left[e] -= push
                        left[e ^ 1] += push
                    k = next(k for k, e in enumerate(path) if left[e] <= tiny)
                    a = to[path[k] ^ 1]
                    del path[k:]
                    continue
                edges = out[a]
                while tried[a] < len(edges):
                    e = edges[tried[a]]
                    if left[e] > tiny and level[to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(edges):
                    path.append(e)
                    a = to[e]
                elif a == source:
                    break
                else:
                    level[a] = -1
                    a = to[path.pop() ^ 1]


def route(patterns: dict[tuple, int], targets: dict, most: int = MOST) -> dict[tuple, float]:
    """Words to take of each pattern: min-cost flow from patterns (most copies, the k-th at cost 2**k) to quotas.

    Only copies cost something, so every augmenting path costs what its first edge costs. Successive shortest paths therefore are
    maximum flows: with first copies alone, then with the capacity of second ones added, and so on.
    """
    some = sorted((p for p in patterns if p), key=str)
    sources = sorted({s for p in some for s in p}, key=lambda s: (s is None, str(s)))
    at = {s: 2 + len(some) + i for i, s in enumerate(sources)}
    flow = Flow(2 + len(some) + len(sources))
    copies = [flow.add(0, 2 + i, 0.0) for i in range(len(some))]
    for i, p in enumerate(some):
        for s in p:
            flow.add(2 + i, at[s], float("inf"))
    for s in sources:
        flow.add(at[s], 1, targets[s])
    for _ in range(most):
        for e, p in zip(copies, some, strict=True):
            flow.left[e] += patterns[p]
        flow.augment(0, 1)
    return {p: 0.0 for p in patterns} | {p: float(flow.left[e ^ 1]) for e, p in zip(copies, some, strict=True)}


def targets(sources: DataFrame, total: float, most: int) -> DataFrame:
    """sources (s, size, weight) with target: water_fill() by aggregation. Each round sums up what the full sources take; only sums leave Spark."""
    level, n_full = 0.0, -1
    while True:
        full = F.lit(most) * F.col("size") <= F.lit(level) * F.col("weight")
        r = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, most * F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if r[0] == n_full or not r[2] or total <= r[1]:
            return sources.withColumn("target", F.when(full, (most * F.col("size")).cast("double")).otherwise(F.lit(level) * F.col("weight")))
        n_full, level = r[0], (total - r[1]) / r[2]


def _sources(narrow: DataFrame, weights, most: int) -> DataFrame:
    """(s, size, weight, target) of each source; weights go round by code point, null last."""
    sizes = narrow.select(F.explode("_m_sources").alias("s"), "_m_size").groupBy("s").agg(F.sum("_m_size").alias("size"))
    placed = numbered(sizes, "_k", F.col("s").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_k") - 1) % len(weights) + 1).cast("int"))
    total = float(narrow.agg(F.coalesce(F.sum("_m_size"), F.lit(0))).first()[0])
    return stored(targets(stored(placed.select("s", "size", weight.alias("weight")), "sources"), total, most), "targets")


def _plan(narrow: DataFrame, weights, most: int) -> DataFrame:
    """A row for each pattern: full repeats, and the words still missing after them.

    All patterns go through the flow, in the driver, if there are MAX_PATTERNS of them at most. Beyond that only those of sources that
    documents share do (more than MAX_PATTERNS of these are an error); another source takes its target from its own documents, which is the same.
    """
    spark = narrow.sparkSession
    sources = _sources(narrow, weights, most)
    patterns = stored(narrow.groupBy("_m_p").agg(F.first("_m_sources").alias("s"), F.sum("_m_size").alias("n"), F.count("*").alias("rows")), "patterns")
    each = patterns.select("_m_p", F.explode("s").alias("s"))
    shared = each.select("s").distinct()
    if patterns.count() > MAX_PATTERNS:
        shared = patterns.filter(F.size("s") > 1).select(F.explode("s").alias("s")).distinct()
    mixed_up = each.join(shared, each["s"].eqNullSafe(shared["s"]), "left_semi").select("_m_p").distinct()
    some = patterns.join(mixed_up, "_m_p").limit(MAX_PATTERNS + 1).collect()
    if len(some) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns of shared sources")
    own = {r.s: r for r in sources.join(shared, sources["s"].eqNullSafe(shared["s"]), "left_semi").collect()} if some else {}
    taken = route({tuple(r.s): r.n for r in some}, {k: r.target for k, r in own.items()}, most)
    flowed = [(r["_m_p"], sum(own[s].size for s in r.s), float(sum(own[s].target for s in r.s)), r.n, r.rows, min(most * r.n, round(taken[tuple(r.s)]))) for r in some]
    flowed = spark.createDataFrame(flowed, "_m_p string, _m_source_size long, _m_target double, n long, rows long, f long")
    alone = patterns.join(mixed_up, "_m_p", "left_anti").withColumn("_s", F.get("s", F.lit(0)))
    alone = alone.join(sources, alone["_s"].eqNullSafe(sources["s"])).select("_m_p", sources["size"].alias("_m_source_size"), F.col("target").alias("_m_target"), "n", "rows", F.least(most * F.col("n"), F.round("target").cast("long")).alias("f"))
    plan = alone.unionByName(flowed)
    base = F.when(F.col("n") > 0, F.floor(F.col("f") / F.col("n"))).otherwise(F.lit(0))
    bands = F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.floor(F.col("rows") / BAND_ROWS)))
    plan = stored(plan.select("_m_p", "_m_source_size", "_m_target", base.alias("_m_base"), (F.col("f") - base * F.col("n")).alias("_m_rest"), bands.alias("_m_bands")), "plan")
    forget(patterns, sources)
    return plan


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= MAX_PATTERNS else df


def taken_words(docs: DataFrame, weights=WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source", cut: bool = True) -> DataFrame:
    """docs with _m_size, _m_source_size, _m_target and _m_taken added; see mix(). Only rows of edge bands are shuffled."""
    many = docs.schema[source].dataType.typeName() == "array"
    pattern = F.array_sort(F.array_distinct(F.col(source))) if many else F.array(F.col(source))
    pattern = F.coalesce(pattern, F.array(F.lit(None).cast("string")))
    name = F.to_json(F.transform(pattern, lambda s: F.struct(s.alias("s"))), {"ignoreNullFields": "false"})
    spread = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 40))
    rows = docs.withColumns({"_m_size": n_words(F.col(text)), "_m_p": name, "_m_at": spread})
    narrow = stored(rows.select("_m_size", "_m_p", "_m_at", pattern.alias("_m_sources")), "sizes")
    plan = _small(_plan(narrow, weights, most))
    band = F.floor(F.col("_m_at") * F.col("_m_bands") / float(1 << 40))
    bands = narrow.join(plan, "_m_p").filter("_m_rest > 0").groupBy("_m_p", band.alias("_m_band"), "_m_rest").agg(F.sum("_m_size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_m_p").orderBy("_m_band"))
    edge = bands.withColumn("upto", upto).filter("upto >= _m_rest AND upto - n < _m_rest").select("_m_p", F.col("_m_band").alias("_m_edge"), (F.col("_m_rest") - F.col("upto") + F.col("n")).alias("_m_need"))
    edge = stored(edge, "edges")
    forget(narrow)
    rows = rows.join(plan, "_m_p").withColumn("_m_band", band).join(_small(edge), "_m_p", "left")
    outside = rows.filter("_m_edge IS NULL OR _m_band <> _m_edge").withColumn("_m_more", F.when(F.col("_m_band") < F.col("_m_edge"), F.col("_m_size")).otherwise(F.lit(0)))
    order = Window.partitionBy("_m_p").orderBy("_m_at", key, "_m_size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.col("_m_need") - F.coalesce(F.sum("_m_size").over(order), F.lit(0)))
    inside = rows.filter("_m_band = _m_edge").withColumn("_m_room", room)
    whole = F.when(F.col("_m_room") * 2 >= F.col("_m_size"), F.col("_m_size")).otherwise(F.lit(0))
    inside = inside.withColumn("_m_more", F.least("_m_size", "_m_room") if cut else whole).drop("_m_room")
    out = outside.unionByName(inside).withColumn("_m_taken", (F.col("_m_base") * F.col("_m_size") + F.col("_m_more")).cast("long"))
    return out.drop("_m_p", "_m_at", "_m_band", "_m_bands", "_m_base", "_m_rest", "_m_edge", "_m_need", "_m_more")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source", cut: bool = True) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    source: a string column, or an array column of the sources a document belongs to (source_size and target
    are then sums over them). Sources by code point, null last, have the weights in turn. taken counts words with
    repeats, at most `most` times the size. With cut, the last document of a pattern gives only the words that are
    still missing; without it, it is taken whole if that comes nearer. Documents without words take 0. The
    choice depends on SEED and key alone; rows that repeat a key are ordered by size. An empty table gives no rows.
    """
    out = taken_words(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), weights, most, cut=cut)
    return out.select("doc_id", F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), F.col("_m_taken").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, whole, with all columns of docs.

    Rows that repeat a key are taken each for itself; documents without words are left out; an empty table gives no rows.
    """
    out = taken_words(docs, weights, most, key, text, source, cut=False).filter("_m_size > 0")
    times = F.sequence(F.lit(1).cast("long"), (F.col("_m_taken") / F.col("_m_size")).cast("long"))
    return out.filter(F.col("_m_taken") >= F.col("_m_size")).withColumn("_m_copy", F.explode(times)).select(*docs.columns)
