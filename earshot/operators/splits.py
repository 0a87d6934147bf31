"""Group-disjoint splits, capped and stratified samples.

Draws are by MD5 of the seed and the key, so they repeat on any partitioning and in any SQL engine. Greedy plans run per class over
aggregated groups in applyInPandas; rows never go through Python.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot import config as C
from earshot.operators.summary import dominant
from earshot.session import stored

SPLITS = tuple(C.SPLIT_TARGETS)


def draw(seed, *key: str) -> Column:
    """A repeatable random order: the MD5 of the seed and the key, parted by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *key).cast("binary"))


def exact_sum(c: Column) -> Column:
    """Sum of seconds in whole nanoseconds, so that it does not depend on the order of the rows."""
    return F.sum(c.cast("decimal(28,9)")).cast("double")


def _greedy(groups: pd.DataFrame, targets: dict[str, float], assigned: dict[str, float] | None = None) -> list[str]:
    """Largest group first, into the split with most room; ties train, dev, test."""
    total = math.fsum(groups["mass"])  # the same in any order
    have = dict.fromkeys(targets, 0.0) | (assigned or {})
    out = []
    for m in groups["mass"]:
        best = max(targets, key=lambda s: (round(targets[s] * total - have[s], 9), -list(targets).index(s)))
        have[best] += m
        out.append(best)
    return out


def disjoint_splits(df: DataFrame, by: str, group: str, mass: Column | None = None, targets=None) -> DataFrame:
    """df with `split`: all rows of a (class, group) are in one split."""
    targets = dict(targets or C.SPLIT_TARGETS)
    groups = df.groupBy(by, group).agg((F.count("*") if mass is None else exact_sum(mass)).cast("double").alias("mass"))
    kinds = dict(groups.dtypes)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_m=pdf["mass"].round(6)).sort_values(["_m", group], ascending=[False, True])
        return pdf.assign(split=_greedy(pdf, targets))[[by, group, "split"]]

    plans = groups.groupBy(by).applyInPandas(plan, f"`{by}` {kinds[by]}, `{group}` {kinds[group]}, split string")
    return df.join(plans, [by, group])


def balanced_splits(df: DataFrame, by: str, group: str, cap: int | None = None, by_duration: bool = True, targets=None, order: Column | None = None) -> DataFrame:
    if cap is not None:
        df = cap_per_group(df, group, cap, order if order is not None else draw(C.SEED, *df.columns))
    return disjoint_splits(df, by, group, F.col("duration") if by_duration else None, targets)


def channel_splits(df: DataFrame, by: str, channel: str, repair: bool = True, targets=None) -> DataFrame:
    """df with `split` by channel. A channel counts for the class of most of its duration. A class with one channel
    goes to test, with two to train and test, with more to all (repair moves the smallest channel of the largest split)."""
    targets = dict(targets or C.SPLIT_TARGETS)
    home = dominant(df, [channel], by, F.col("duration")).withColumnRenamed(by, "_home")
    groups = df.groupBy(channel).agg(exact_sum(F.col("duration")).alias("mass")).join(home, channel)
    kinds = dict(groups.dtypes)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_m=pdf["mass"].round(6)).sort_values(["_m", channel], ascending=[False, True]).reset_index(drop=True)
        n = len(pdf)
        if repair and n == 1:
            split = ["test"]
        elif repair and n == 2:
            split = ["train", "test"]
        else:
            split = _greedy(pdf, targets)
            for s in targets if repair else ():
                if s not in split:
                    counts = {k: split.count(k) for k in targets}
                    donor = max(targets, key=lambda k: (counts[k], -list(targets).index(k)))
                    split[max(i for i, x in enumerate(split) if x == donor)] = s
        return pdf.assign(split=split)[[channel, "split"]]

    plans = groups.groupBy("_home").applyInPandas(plan, f"`{channel}` {kinds[channel]}, split string")
    return df.join(plans, channel)


def cap_per_group(df: DataFrame, group: str, cap: int, order: Column) -> DataFrame:
    """At most cap rows of each group, drawn by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= cap).drop("_r")


def stratified(df: DataFrame, cells: list[str], n: int, key: str, seed=C.SEED) -> DataFrame:
    """Exactly n rows of each cell with item ids and serving order; an error if a cell is short."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(*cells).orderBy(draw(seed, key), key))).filter(F.col("_r") <= n).drop("_r")
    short = df.groupBy(*cells).count().filter(F.col("count") < n).limit(1).collect()
    if short:
        raise ValueError(f"cell {short[0]} has fewer than {n} rows")
    return served(r, key, seed)


def numbered(df: DataFrame, name: str, *order, offset: int = 0) -> DataFrame:
    """df with its rows numbered from offset + 1 in this order (which should leave no ties).

    Rows are dealt to ranges of the order and numbered inside each; only one count for each range meets in one task.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "numbered")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1 + offset).drop("_part", "_place", "_before")  # a row for each range


def served(df: DataFrame, key: str, seed=C.SEED, offset: int = 0) -> DataFrame:
    """df with serve_order, a random order that continues from offset, and item_id."""
    out = numbered(df.withColumn("_draw", draw(f"serve{seed}", key)), "serve_order", F.col("_draw"), F.col(key), offset=offset)
    return out.drop("_draw").withColumn("item_id", F.format_string("S%02d", "serve_order"))


def extension(df: DataFrame, sample: DataFrame, key: str, seed=C.SEED) -> DataFrame:
    """All rows not sampled yet, in an order that continues the sample's."""
    last = sample.agg(F.max("serve_order")).first()[0] or 0
    return served(df.join(sample.select(key), key, "left_anti"), key, seed, last)


def capped_stratified(df: DataFrame, cells: list[str], n: int, caps: dict[str, int], key: str, seed=C.SEED, most_rounds: int = 30) -> DataFrame:
    """n rows of each cell under caps on columns over all cells.

    Rounds: rows are ranked within what each cap, then each cell, still allows; accepted rows lower the room. It
    is an error if a round adds nothing while a cell is short.
    """
    left = df.withColumn("_o", draw(seed, key))
    small = stored(df.groupBy(*cells).agg(F.count("*").alias("_size")), "small")
    left = stored(left.join(F.broadcast(small), cells), "left")  # every round reads it
    taken = None
    for _ in range(most_rounds):
        now = left
        for c, cap in caps.items():
            room = F.lit(cap)
            if taken is not None:
                now = now.join(taken.groupBy(c).agg(F.count("*").alias("_t")), c, "left")
                room = room - F.coalesce("_t", F.lit(0))
            now = now.withColumn("_r", F.row_number().over(Window.partitionBy(c).orderBy("_size", "_o", key))).filter(F.col("_r") <= room).drop("_r", "_t")
        room = F.lit(n)
        if taken is not None:
            now = now.join(taken.groupBy(*cells).agg(F.count("*").alias("_t")), cells, "left")
            room = room - F.coalesce("_t", F.lit(0))
        now = now.withColumn("_r", F.row_number().over(Window.partitionBy(*cells).orderBy("_o", key))).filter(F.col("_r") <= room).drop("_r", "_t")
        now = stored(now, "drawn")
        added = now.count()
        taken = now if taken is None else taken.unionByName(now)
        full = taken.groupBy(*cells).count().filter(F.col("count") >= n)
        if full.count() == small.count():
            return taken.drop("_o", "_size")
        if not added:
            break
        left = left.join(now.select(key), key, "left_anti").join(full.select(*cells), cells, "left_anti")
    raise ValueError("the caps leave a cell short")


def sample_not_shown(df: DataFrame, shown: DataFrame, key: str, per: list[str], n: int, seed=C.SEED) -> DataFrame:
    rest = df.join(shown.select(key), key, "left_anti")
    return rest.withColumn("_r", F.row_number().over(Window.partitionBy(*per).orderBy(draw(seed, key), key))).filter(F.col("_r") <= n).drop("_r")


def clean_first_pool(df: DataFrame, by: str, k: int, key: str, clean: Column, least: float = 2.0, pool: int = 3, seed=C.SEED) -> DataFrame:
    """k random rows of each class from its pool * k best: long enough, clean first, then longest."""
    w = Window.partitionBy(by)
    best = df.filter(F.col("duration") >= least).withColumn("_r", F.row_number().over(w.orderBy(F.desc(clean), F.desc("duration"), key))).filter(F.col("_r") <= pool * k)
    return best.withColumn("_r", F.row_number().over(w.orderBy(draw(seed, key), key))).filter(F.col("_r") <= k).drop("_r")


def hold_out(df: DataFrame, by: str, share: float, key: str, seed=C.SEED) -> DataFrame:
    """df with `held_out`: floor(share * n) rows of each class."""
    w = Window.partitionBy(by)
    return df.withColumn("held_out", F.row_number().over(w.orderBy(draw(seed, key), key)) <= F.floor(F.lit(share) * F.count("*").over(w)))


def class_weights(df: DataFrame, by: str, mode: str = "inverse", classes: list | None = None, beta: float = 0.999) -> DataFrame:
    """(class, n, weight), weights of mean 1: none, inverse, sqrt or effective; a class without rows counts as one row."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    if classes is not None:
        every = df.sparkSession.createDataFrame([(c,) for c in classes], f"`{by}` {dict(df.dtypes)[by]}")
        n = every.join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    m = F.greatest("n", F.lit(1)).cast("double")
    raw = {"none": F.lit(1.0), "inverse": 1 / m, "sqrt": 1 / F.sqrt(m), "effective": (1 - beta) / (1 - F.pow(F.lit(beta), m))}[mode]
    w = n.withColumn("_w", raw)
    return w.crossJoin(F.broadcast(w.agg(F.avg("_w").alias("_mean")))).select(by, "n", (F.col("_w") / F.col("_mean")).alias("weight"))
