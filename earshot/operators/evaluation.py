"""Classifier scores, bootstrap intervals, paired tests and probes.

Bootstraps resample counts, not rows: rows are first collapsed to confusion cells (of each cluster), and each
replicate draws multiplicities of cells or clusters. Work grows with cells x replicates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import config as C

AT_ONCE = 16  # classifiers fitted side by side, each on its own stored copy of the vectors


def majority_floor(df: DataFrame, split: str, label: str) -> DataFrame:
    """df's rows outside train with pred: the commonest label of train (ties: smallest)."""
    n = df.filter(F.col(split) == "train").groupBy(label).agg(F.count("*").alias("_n"))
    best = n.agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col(label).alias("pred")))["pred"].alias("pred"))
    return df.filter(F.col(split) != "train").crossJoin(F.broadcast(best))


def per_class(df: DataFrame, true: str, pred: str, labels: list, by: list[str] | None = None) -> DataFrame:
    """(by, label, n, precision, recall, f1) over a fixed list of labels; zero denominators give 0."""
    by = by or []
    spread = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col(true) == x).alias("t"), (F.col(pred) == x).alias("p")) for x in labels]))
    g = df.select(*by, spread.alias("e")).select(*by, "e.*").groupBy(*by, "label").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(F.col("t")).alias("n"), F.count_if(F.col("p")).alias("m"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, n, m = F.col("tp"), F.col("n"), F.col("m")
    return g.select(*by, "label", "n", ratio(tp, m).alias("precision"), ratio(tp, n).alias("recall"), ratio(2 * tp, n + m).alias("f1"))


def scores(df: DataFrame, true: str, pred: str, labels: list, by: list[str] | None = None) -> DataFrame:
    """(by, n, accuracy, macro_f1)."""
    by = by or []
    f1 = per_class(df, true, pred, labels, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    acc = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))
    return acc.join(f1, by) if by else acc.crossJoin(f1)


def with_macro(df: DataFrame) -> DataFrame:
    """Per-class rows and their unweighted mean as label Macro."""
    mean = df.agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("Macro").alias("label"), "n", "precision", "recall", "f1")
    return df.withColumn("label", F.col("label").cast("string")).unionByName(mean)


def majority_vote(df: DataFrame, group: list[str], true: str, pred: str) -> DataFrame:
    """(group, true, pred): the commonest prediction (ties: smallest label) and the smallest true label of each group."""
    n = df.groupBy(*group, pred).agg(F.count("*").alias("_n"), F.min(true).alias("_t"))
    return n.groupBy(*group).agg(F.min("_t").alias(true), F.min(F.struct((-F.col("_n")).alias("k"), F.col(pred).alias("p")))["p"].alias(pred))


def macro_f1(cells: np.ndarray) -> np.ndarray:
    """Macro F1 of (..., k, k) confusion counts, true by predicted."""
    tp = np.diagonal(cells, axis1=-2, axis2=-1)
    both = cells.sum(-1) + cells.sum(-2)
    return np.where(both > 0, 2 * tp / np.maximum(both, 1e-300), 0).mean(-1)


def _replicates(spark, replicates: int, parts: int = 8) -> DataFrame:
    return spark.range(0, replicates, 1, parts)


def bootstrap(df: DataFrame, true: str, pred: str, labels: list, stratum: str | None = None, replicates: int = 1000, seed: int = C.SEED) -> DataFrame:
    """(replicate, accuracy, macro_f1, kappa) of row resamples (inside strata): multinomial draws of confusion cells."""
    s = F.lit(0) if stratum is None else F.col(stratum).cast("string")
    cells = df.groupBy(s.alias("s"), F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n")).collect()  # strata x labels squared
    at = {x: i for i, x in enumerate(labels)}
    strata: dict = {}
    for r in cells:
        strata.setdefault(r.s, []).append((at[r.t], at[r.p], r.n))
    k = len(labels)

    def run(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                m = np.zeros((k, k))
                for key in sorted(strata, key=str):
                    own = sorted(strata[key])
                    n = np.array([x[2] for x in own])
                    for (t, p, _), c in zip(own, rng.multinomial(n.sum(), n / n.sum()), strict=True):
                        m[t, p] += c
                total = m.sum()
                acc, e = np.trace(m) / total, float((m.sum(0) * m.sum(1)).sum() / total**2)
                rows.append((int(i), acc, float(macro_f1(m)), (acc - e) / (1 - e) if e < 1 else None))
            yield pd.DataFrame(rows, columns=["replicate", "accuracy", "macro_f1", "kappa"])

    return _replicates(df.sparkSession, replicates).mapInPandas(run, "replicate long, accuracy double, macro_f1 double, kappa double")


#: The chance that a Poisson(1) draw is at most 0, 1, ... 8.
POISSON = [float(x) for x in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])]


def multiplicity(seed: int, *key: str) -> Column:
    """A Poisson(1) draw for a key, by 32 bits of its MD5."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *key).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum(((u >= x).cast("long") for x in POISSON[1:]), (u >= POISSON[0]).cast("long"))


def cluster_bootstrap(df: DataFrame, unit: str, true: str, pred: str, labels: list, replicates: int = 1000, seed: int = C.SEED) -> DataFrame:
    """(replicate, accuracy, macro_f1) of resampled units. Each unit's multiplicity in a replicate is drawn by MD5 of seed,
    unit and replicate as Poisson(1), the limit of resampling with replacement, so units need not meet anywhere. A unit's
    confusion cells meet in one row, its draws are made once, and tasks add up their replicates before they shuffle."""
    cells = df.groupBy(F.col(unit).alias("u"), F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    units = cells.groupBy("u").agg(F.collect_list(F.struct("t", "p", "n")).alias("own"))  # labels squared
    drawn = units.select("own", F.col("u"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("w", multiplicity(seed, "u", "replicate")).filter("w > 0")
    per = drawn.select("replicate", "w", F.explode("own").alias("c")).groupBy("replicate", "c.t", "c.p").agg(F.sum(F.col("w") * F.col("c.n")).alias("w"))
    e = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.when((F.col("t") == x) & (F.col("p") == x), F.col("w")).otherwise(0).alias("tp"), (F.when(F.col("t") == x, F.col("w")).otherwise(0) + F.when(F.col("p") == x, F.col("w")).otherwise(0)).alias("both")) for x in labels]))
    f1 = per.select("replicate", e.alias("e")).groupBy("replicate", "e.label").agg((2 * F.sum("e.tp") / F.greatest(F.sum("e.both"), F.lit(1))).alias("f1")).groupBy("replicate").agg(F.avg("f1").alias("macro_f1"))
    acc = per.groupBy("replicate").agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("w")).otherwise(0)) / F.greatest(F.sum("w"), F.lit(1))).alias("accuracy"))
    return acc.join(f1, "replicate")


def paired_bootstrap(df: DataFrame, true: str, a: str, b: str, labels: list, replicates: int = 2000, seed: int = C.SEED) -> DataFrame:
    """(replicate, delta): macro F1 of b less that of a on the same resample, from counts of (true, a, b)."""
    at = {x: i for i, x in enumerate(labels)}
    cells = sorted((at[r[0]], at[r[1]], at[r[2]], r.n) for r in df.groupBy(true, a, b).agg(F.count("*").alias("n")).collect())  # labels cubed
    n = np.array([x[3] for x in cells])
    k = len(labels)

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                drawn = np.random.default_rng([seed, int(i)]).multinomial(n.sum(), n / n.sum())
                x, y = np.zeros((k, k)), np.zeros((k, k))
                for (t, p, q, _), c in zip(cells, drawn, strict=True):
                    x[t, p] += c
                    y[t, q] += c
                out.append((int(i), float(macro_f1(y) - macro_f1(x))))
            yield pd.DataFrame(out, columns=["replicate", "delta"])

    return _replicates(df.sparkSession, replicates).mapInPandas(run, "replicate long, delta double")


def interval(df: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """(mean, low, high): percentile interval of replicates."""
    tail = (1 - level) / 2
    return df.agg(F.avg(column).alias("mean"), F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(1 - tail)).alias("high"))


def mcnemar(df: DataFrame, true: str, a: str, b: str) -> DataFrame:
    """(b01, b10, p): exact two-sided binomial test on discordant rows. The tail is summed in SQL by log factorials."""
    g = df.agg(F.count_if((F.col(a) != F.col(true)) & (F.col(b) == F.col(true))).alias("b01"), F.count_if((F.col(a) == F.col(true)) & (F.col(b) != F.col(true))).alias("b10"))
    n, k = F.col("b01") + F.col("b10"), F.least("b01", "b10")
    steps = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), lambda i: F.log((n - i + 1) / i))
    first = F.struct((-n * math.log(2)).alias("log"), F.exp(-n * math.log(2)).alias("sum"))
    tail = F.aggregate(F.when(k > 0, steps).otherwise(F.array().cast("array<double>")), first, lambda s, x: F.struct((s["log"] + x).alias("log"), (s["sum"] + F.exp(s["log"] + x)).alias("sum")))["sum"]
    return g.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def duration_accuracy(df: DataFrame, true: str, pred: str, duration: str = "duration") -> DataFrame:
    d = F.col(duration)
    b = F.when((d >= 3) & (d < 5), "3-5").when((d >= 5) & (d < 7), "5-7").when((d >= 7) & (d < 10.01), "7-10")
    return df.withColumn("bucket", b).dropna(subset=["bucket"]).groupBy("bucket").agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list, normalise: bool = False) -> DataFrame:
    m = df.groupBy(true).pivot(pred, labels).count().na.fill(0)
    if not normalise:
        return m
    total = sum((F.col(str(x)) for x in labels[1:]), F.col(str(labels[0])))
    return m.select(true, *[F.when(total > 0, F.col(str(x)) / total).otherwise(0.0).alias(str(x)) for x in labels])


def logistic_probe(df: DataFrame, vec: str, label: str, split: str = "split", c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """df with pred from a multinomial logistic model of train rows; C counts as in 1 / (C n) of ridge."""
    rows = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double")))).withColumn("_y", F.col(label).cast("double"))
    train = rows.filter(F.col(split) == "train")
    model = LogisticRegression(featuresCol="_v", labelCol="_y", predictionCol="pred", rawPredictionCol="_raw", probabilityCol="_p", family="multinomial", regParam=1.0 / (c * max(1, train.count())), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(train)
    return model.transform(rows).withColumn("pred", F.col("pred").cast("int")).drop("_v", "_y", "_raw", "_p")


def svm_probe(df: DataFrame, vec: str, label: str, split: str = "split", max_iter: int = 30, at_once: int = AT_ONCE) -> DataFrame:
    """df with pred from one-against-rest linear support vector machines, of which at_once are fitted side by side.

    A fit is a row of some hundred short jobs, most of whose time is waiting: side by side they take little more than one of them.
    """
    rows = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double")))).withColumn("_y", F.col(label).cast("double"))
    model = OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=0.01), featuresCol="_v", labelCol="_y", predictionCol="pred", parallelism=at_once).fit(rows.filter(F.col(split) == "train"))
    return model.transform(rows).withColumn("pred", F.col("pred").cast("int")).drop("_v", "_y", "rawPrediction")


def gated_probe(df: DataFrame, vec: str, label: str, held_out: str, least: float = 0.90) -> DataFrame:
    """logistic_probe() only if its accuracy on held-out rows is at least `least`; an error otherwise."""
    out = logistic_probe(df.withColumn("split", F.when(F.col(held_out), "test").otherwise("train")), vec, label)
    acc = out.filter(held_out).agg(F.avg((F.col("pred") == F.col(label)).cast("double"))).first()[0]
    if acc is None or acc < least:
        raise ValueError(f"held-out accuracy {acc}")
    return out


def regimes(df: DataFrame, vec: str, label: str, labels: list, splits: dict[str, str]) -> DataFrame:
    """(regime, n, accuracy, macro_f1) of one probe under several split columns."""
    out = None
    for name, column in splits.items():
        pred = logistic_probe(df, vec, label, column).filter(F.col(column) == "test")
        own = scores(pred, label, "pred", labels).withColumn("regime", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def quoted_numbers(actual: DataFrame, expected: DataFrame, key: str, value: str, digits: int = 3) -> DataFrame:
    """(key, expected, actual) rows that do not reproduce to so many digits."""
    e = expected.select(key, F.col(value).alias("expected"))
    a = actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "left").filter(F.col("actual").isNull() | (F.round("expected", digits) != F.round("actual", digits)))
