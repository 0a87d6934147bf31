"""URL verdicts: host and path rules, and gradient-boosted trees on lexical features for the rest.

The labelled URLs are those a rule decides (every one of them in training, up to TRAIN_ROWS by hash). Features
are SQL expressions: lengths, depth, digit ratio, character entropy, parameter counts and smoothed block rates
of host suffixes. Spark ML trains and applies the trees.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.session import stored

#: (verdict, host and path prefix)
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
TRAIN_ROWS = 20_000
#: So many suffixes are broadcast at most; rarer ones are joined by a shuffle.
SUFFIXES = 10_000
TREES, DEPTH, FOLDS = 10, 3, 5
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "parameters", "fragment", "secure", "suffix1", "suffix2", "suffix3"]


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest fitting rule as text, or null. A rule's host fits itself and its subdomains; its path is a prefix."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules if rules is not None else RULES, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _suffix(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def lexical(df: DataFrame) -> DataFrame:
    """df with the lexical features of its url, host and path columns."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    each = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(each, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))

    def share(text: Column, pattern: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.greatest(F.length(text), F.lit(1))

    return df.withColumns(
        {
            "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": F.size(F.split(path, "/")), "labels": F.size(F.split(host, r"\.")),
            "digits": share(url, "0-9"), "host_digits": share(host, "0-9"), "hyphens": share(host, "-"), "entropy": entropy,
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "fragment": url.contains("#").cast("int"), "secure": url.startswith("https").cast("int"),
        }
    )


def _counts(labelled: DataFrame, n: int) -> DataFrame:
    """Rows and blocked rows of each host suffix of n labels in each fold."""
    grouped = labelled.groupBy(_suffix(F.col("host"), n).alias(f"_s{n}"), "_fold").agg(F.sum("label").alias("_b"), F.count("*").alias("_n"))
    return stored(grouped, "counts")


def _rates(counts: DataFrame, n: int) -> DataFrame:
    """Smoothed block rates of all host suffixes of n labels."""
    grouped = counts.groupBy(f"_s{n}").agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n"))
    return stored(grouped.select(f"_s{n}", "_n", ((F.col("_b") + 1) / (F.col("_n") + 2)).alias(f"suffix{n}")), "rates")


def _with_other_folds(sample: DataFrame, n: int, counts: DataFrame) -> DataFrame:
    """The sample with the block rates of the other folds, so that the trees do not learn from a row's own label."""
    sample = sample.withColumn(f"_s{n}", _suffix(F.col("host"), n))
    own = stored(counts.join(F.broadcast(sample.select(f"_s{n}").distinct()), f"_s{n}"), "folds")  # at most the sample's suffixes
    total = own.groupBy(f"_s{n}").agg(F.sum("_b").alias("_all_b"), F.sum("_n").alias("_all_n"))
    rate = ((F.col("_all_b") - F.col("_b") + 1) / (F.col("_all_n") - F.col("_n") + 2)).alias(f"suffix{n}")
    return sample.join(own.join(total, f"_s{n}").select(f"_s{n}", "_fold", rate), [f"_s{n}", "_fold"], "left")


def _parted(rates: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """The commonest SUFFIXES rates, and the rarer ones if there are any."""
    common = rates.orderBy(F.desc("_n"), f"_s{n}").limit(SUFFIXES)
    rare = stored(rates.join(F.broadcast(common.select(f"_s{n}")), f"_s{n}", "left_anti").drop("_n"), "rare") if rates.count() > SUFFIXES else None
    return common.drop("_n"), rare


def _with_rate(df: DataFrame, n: int, common: DataFrame, rare: DataFrame | None) -> DataFrame:
    df = df.withColumn(f"_s{n}", _suffix(F.col("host"), n)).join(F.broadcast(common), f"_s{n}", "left")
    if rare is None:
        return df
    # rows that have their rate get keys that fit nothing, so that common suffixes do not meet in one task
    spread = F.concat(F.lit("/"), F.xxhash64("url", "path").cast("string"))
    df = df.withColumn("_rare", F.when(F.col(f"suffix{n}").isNull(), F.col(f"_s{n}")).otherwise(spread))
    df = df.join(rare.select(F.col(f"_s{n}").alias("_rare"), F.col(f"suffix{n}").alias("_rate")), "_rare", "left")
    return df.withColumn(f"suffix{n}", F.coalesce(f"suffix{n}", "_rate")).drop("_rare", "_rate")


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(lexical(df).fillna(0.5, [f"suffix{n}" for n in (1, 2, 3)]))


def fit(labelled: DataFrame, decided: int):
    """Trees, and the suffix rates (common, rare) for 1 to 3 labels, of rows (page_id, url, host, path, label); `decided` is their number.

    All rows count in the rates. The trees learn from a sample of TRAIN_ROWS distinct rows by hash, in which a row has
    the rates of the folds it is not in.
    """
    labelled = labelled.withColumn("_fold", F.pmod(F.xxhash64("page_id", "url", F.lit("fold")), F.lit(FOLDS)))
    counts = {n: _counts(labelled, n) for n in (1, 2, 3)}
    share = min(1.0, TRAIN_ROWS / decided)
    sample = stored(labelled.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["page_id", "url"]), "sample")
    for n in (1, 2, 3):
        sample = _with_other_folds(sample, n, counts[n])
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False)
    return trees.fit(stored(_assembled(sample).select("features", "label"), "features")), [_parted(_rates(counts[n], n), n) for n in (1, 2, 3)]


def judge(pages: DataFrame, rules=None, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block probability of every row.

    A rule's verdict stands; elsewhere the trees decide (block at 0.5 or more). If the rules do not decide both
    ways on some rows, there is nothing to learn: the probability is the smoothed block rate of the decided rows.
    Rows that repeat a key are judged each for itself; an empty table gives no rows; a null url has empty parts and no
    rule; other columns are ignored. Urls of any length are taken whole.
    """
    rules = RULES if rules is None else rules
    blocks = [r for v, r in rules if v == "block"]
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.filter("rule IS NOT NULL").withColumn("label", F.col("rule").isin(blocks).cast("double"))
    decided, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if 0 < blocked < decided:
        model, rates = fit(labelled, decided)
        for n, r in enumerate(rates, 1):
            rows = _with_rate(rows, n, *r)
        rows = model.transform(_assembled(rows)).withColumn("block_probability", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("block_probability", F.lit((blocked + 1.0) / (decided + 2.0)))
    by_rule = F.when(F.col("rule").isin(blocks), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).otherwise(F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")
