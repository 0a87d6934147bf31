"""Exact quantiles of groups of any size by histogram refinement.

A group's values are counted in BINS bins between its least and greatest one, with partial sums in every task. The bin that holds a
rank becomes the next interval, until FEW values or one distinct value are left; only those are sorted. No task holds more than
twice BINS bins or FEW values of a group. Groups of up to FEW values take Spark's own percentile, which gives the same bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.session import forget, stored

BINS = 1024
FEW = 1 << 15
WIDE = 16.0
BROADCAST_ROWS = 100_000
SALTS = 16


def spread_join(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """df joined to a stored or cheap table of one row for each key (null is a key): broadcast if it has BROADCAST_ROWS at
    most, else with SALTS copies of it, so that a hot key's rows are dealt over as many tasks at least. how: inner or left.
    rows: how many it has, where that is known."""
    names = [c for c in small.columns if c not in keys]
    other = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *names)
    on = [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    if (small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS:
        out = df.join(F.broadcast(other), on, how) if on else df.crossJoin(F.broadcast(other))
        return out.select(*df.columns, *names)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = other.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = [salted[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return salted.join(copies, [*on, F.col("_salt") == F.col("_other")], how).select(*df.columns, *names)


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(number of groups, rows of the largest one)."""
    r = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.count("*").alias("groups"), F.max("_n").alias("most")).first()
    return r.groups, r.most or 0


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value between lo and hi, in the order of the values; infinities and NaN have bins of their own.

    Bins are of equal width, or of equal ratio where lo and hi have one sign and hi is WIDE times lo or more. So no distribution needs many rounds.
    """

    def even(y: Column, a: Column, b: Column) -> Column:
        width = b / 2 - a / 2
        return F.when(width > 0, F.least(F.floor((y / 2 - a / 2) / width * bins), F.lit(bins - 1))).when(y > a, bins - 1).otherwise(0)

    def log(y: Column) -> Column:
        return F.ln(F.greatest(y, F.lit(5e-324)))

    ratio = F.when((lo >= 0) & (hi / WIDE > lo), even(log(x), log(lo), log(hi))).when((hi <= 0) & (lo / WIDE < hi), even(-log(-x), -log(-lo), -log(-hi)))
    finite = F.coalesce(ratio, F.when((lo < 0) & (hi > 0), F.when(x < 0, even(x, lo, F.lit(0.0)) - bins).otherwise(even(x, F.lit(0.0), hi))).otherwise(even(x, lo, hi)))
    return F.when(F.isnan(x), bins + 1).when(x == float("inf"), bins).when(x == float("-inf"), -bins - 1).otherwise(finite).cast("int")


def interpolated(n: Column, share: float, at: Callable[[Column], Column]) -> Column:
    """The quantile from the values at the two ranks around it, as Spark's percentile combines them."""
    place = (n - 1) * F.lit(float(share))
    low, high = F.floor(place), F.ceil(place)
    a, b = at(low), at(high)
    return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)


def refined(first: DataFrame, keys: list[str], shares: list[float], histogram: Callable[[DataFrame], DataFrame], values: Callable[[DataFrame], DataFrame], few: int = FEW) -> DataFrame:
    """(keys, n, q): the quantiles at all shares, from histograms alone.

    first: (keys, bin, n, lo, hi), the count, least and greatest value of each bin. histogram(state) gives the same and rank for the values
    between lo and hi of each (keys, rank, lo, hi); values(state) gives (keys, rank, x, n), how often each of them occurs.
    """
    every = Window.partitionBy(*keys)
    up_to = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(f((F.col("total") - 1) * F.lit(float(p))).cast("long")) for p in shares for f in (F.floor, F.ceil)])))
    cum = first.withColumns({"total": F.sum("n").over(every), "upto": F.sum("n").over(up_to)}).withColumn("rank", F.explode(ranks))
    picked = cum.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    state = stored(picked.select(*keys, "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi", "n", "total"), "state")
    left = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    while state.filter(left).limit(1).count():
        now = state.filter(left).select(*keys, "rank", "below", "total", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        h = histogram(now.select(*keys, "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))
        by_rank = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        c = spread_join(h.withColumn("upto", F.sum("n").over(by_rank)), now.drop("_lo", "_hi"), [*keys, "rank"]).withColumn("upto", F.col("upto") + F.col("below"))
        # of the last bin all that is left counts
        picked = c.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        before, state = state, stored(state.filter(~left).unionByName(picked.select(*keys, "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi", "n", "total")), "state")
        forget(before)
    one = F.col("lo") == F.col("hi")
    rest = state.filter(~one)
    v = values(rest.select(*keys, "rank", "lo", "hi"))
    order = Window.partitionBy(*keys, "rank").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    at = spread_join(v.withColumn("upto", F.sum("n").over(order)), rest.select(*keys, "rank", "below", "total"), [*keys, "rank"]).filter((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("n")))
    found = state.filter(one).select(*keys, "rank", "total", F.col("lo").alias("x")).unionByName(at.select(*keys, "rank", "total", "x"))
    by = found.groupBy(*keys).agg(F.max("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_at"))
    q = F.array(*[interpolated(F.col("n"), p, lambda r: F.element_at("_at", r)) for p in shares])
    return by.select(*keys, "n", q.alias("q"))


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, shares: list[float], few: int = FEW, bins: int = BINS, largest: int | None = None) -> DataFrame:
    """(keys, n, q): count and exact quantiles of each group's values (nulls are left out; a group of nulls has q null).

    Equal to percentile() with these shares, NaN is the greatest value. df is read several times when a group has over `few` values.
    largest: rows of the largest group, where that is known.
    """
    rows = df.select(*keys, value.cast("double").alias("_x"))

    def sorted_whole(r: DataFrame) -> DataFrame:
        return r.groupBy(*keys).agg(F.count("_x").alias("n"), F.percentile("_x", F.array(*[F.lit(float(p)) for p in shares])).alias("q"))

    if largest is not None and largest <= few:
        return sorted_whole(rows)
    finite = F.when(F.abs("_x") < float("inf"), F.col("_x"))
    sizes = stored(rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")), "sizes")
    large = sizes.filter(F.col("_n") > few)
    if not large.limit(1).count():
        return sorted_whole(rows)
    split = spread_join(rows, large, keys, "left")
    small = sorted_whole(split.filter("_n is null").select(*keys, "_x"))
    lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(0.0))
    whole = split.filter("_n is not null and _x is not null").withColumn("bin", bin_of(F.col("_x"), lo, hi, bins))
    counts = [F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")]

    def within(state: DataFrame) -> DataFrame:
        targets = state.groupBy(*keys).agg(F.collect_list(F.struct("rank", "lo", "hi")).alias("_t"))
        at = spread_join(rows.filter("_x is not null"), stored(targets, "targets"), keys).withColumn("_t", F.explode("_t"))
        return at.select(*keys, "_x", "_t.rank", "_t.lo", "_t.hi").filter((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")))

    def histogram(state: DataFrame) -> DataFrame:
        return within(state).withColumn("bin", bin_of(F.col("_x"), F.col("lo"), F.col("hi"), bins)).groupBy(*keys, "rank", "bin").agg(*counts)

    def values(state: DataFrame) -> DataFrame:
        return within(state).groupBy(*keys, "rank", F.col("_x").alias("x")).agg(F.count("*").alias("n"))

    out = refined(whole.groupBy(*keys, "bin").agg(*counts), keys, shares, histogram, values, few)
    return small.unionByName(out) if keys else out
