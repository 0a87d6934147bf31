"""Queries of the E operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import tables
from earshot.functions.vectors import fuse, unit
from earshot.operators import evaluation as E
from earshot.operators.labels import wilson
from earshot.operators.splits import hold_out
from earshot.plans.aggregates import rounded
from earshot.plans.clustering import vectors
from earshot.plans.registry import query
from earshot.session import table

c = F.col
LABELS = [0, 1, 2, 3]
#: Predictions over line items: true by part, two models that are right for some.
PRED = """p AS (SELECT l_orderkey % 50 AS speaker, l_linenumber, l_quantity / 5 AS duration, l_partkey % 4 AS t, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 4 ELSE l_suppkey % 4 END AS a, CASE WHEN l_suppkey % 5 < 2 THEN l_partkey % 4 ELSE l_orderkey % 4 END AS b FROM lineitem)"""
ONE = "l AS (SELECT unnest([0, 1, 2, 3]) AS label), k AS (SELECT label, count(*) FILTER (WHERE t = label AND {p} = label) AS tp, count(*) FILTER (WHERE t = label) AS n, count(*) FILTER (WHERE {p} = label) AS m FROM {src}, l GROUP BY label), f AS (SELECT label, n, tp / m AS precision, tp / n AS recall, 2 * tp / (n + m) AS f1 FROM k)"


def predictions(spark, sf):
    i = table(spark, sf, "lineitem")
    a = F.when(c("l_suppkey") % 3 == 0, c("l_partkey") % 4).otherwise(c("l_suppkey") % 4)
    b = F.when(c("l_suppkey") % 5 < 2, c("l_partkey") % 4).otherwise(c("l_orderkey") % 4)
    return i.select((c("l_orderkey") % 50).alias("speaker"), "l_linenumber", (c("l_quantity") / 5).alias("duration"), (c("l_partkey") % 4).alias("t"), a.alias("a"), b.alias("b"))


def with_split(spark, sf):
    return vectors(spark, sf).withColumns({"split": F.when(c("vec_id") % 5 == 0, "test").otherwise("train"), "vec": unit(c("vec"))})


@query("e01_majority_floor", "WITH m AS (SELECT label FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT vec_id, (SELECT label FROM m) AS pred FROM embeddings WHERE vec_id % 5 = 0")
def e01(spark, sf):
    return E.majority_floor(with_split(spark, sf), "split", "label").select("vec_id", "pred")


@query("e02_scores", f"WITH {PRED}, {ONE.format(p='a', src='p')} SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg((t = a)::INT) FROM p), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def e02(spark, sf):
    return rounded(E.scores(predictions(spark, sf), "t", "a", LABELS), "accuracy", "macro_f1")


@query("e03_per_class", f"WITH {PRED}, {ONE.format(p='a', src='p')} SELECT label::VARCHAR AS label, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f UNION ALL SELECT 'Macro', sum(n)::BIGINT, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f")
def e03(spark, sf):
    return rounded(E.with_macro(E.per_class(predictions(spark, sf), "t", "a", LABELS)), "precision", "recall", "f1")


VOTE = "v AS (SELECT speaker, l_linenumber % 3 AS g, min(t) AS t FROM p GROUP BY ALL), w AS (SELECT speaker, l_linenumber % 3 AS g, a, row_number() OVER (PARTITION BY speaker, l_linenumber % 3 ORDER BY count(*) DESC, a) AS k FROM p GROUP BY speaker, l_linenumber % 3, a)"


@query("e04_majority_vote", f"WITH {PRED}, {VOTE} SELECT v.speaker, v.g, v.t, w.a FROM v JOIN w ON v.speaker = w.speaker AND v.g = w.g WHERE k = 1")
def e04(spark, sf):
    return E.majority_vote(predictions(spark, sf).withColumn("g", c("l_linenumber") % 3), ["speaker", "g"], "t", "a")


#: n, accuracy, macro F1 and kappa of the rows themselves.
REAL = ONE.format(p="a", src="p") + ", o AS (SELECT count(*)::DOUBLE AS n, avg((t = a)::INT) AS acc FROM p), h AS (SELECT sum((SELECT count(*) FROM p WHERE t = label) * (SELECT count(*) FROM p WHERE a = label)) AS e FROM l), q AS (SELECT n, acc, e / (n * n) AS e FROM o, h)"


@query("e05_bootstrap", f"WITH {PRED}, {REAL} SELECT n::BIGINT AS n, 400 AS replicates, round(acc, 6) AS accuracy, round((SELECT avg(f1) FROM f), 6) AS macro_f1, round((acc - e) / (1 - e), 6) AS kappa, 'accuracy kappa macro_f1' AS covered, true AS width FROM q")
def e05(spark, sf):
    """The scores, whether the intervals cover them, and whether that of accuracy is as wide as its standard error says, give or take a fifth."""
    from earshot.operators.labels import kappa

    p = predictions(spark, sf).withColumn("s", c("speaker") % 3)
    r = E.bootstrap(p, "t", "a", LABELS, "s", 400)
    names = ["accuracy", "kappa", "macro_f1"]
    both = E.scores(p, "t", "a", LABELS).crossJoin(kappa(p, "t", "a").select("kappa")).crossJoin(r.agg(F.countDistinct("replicate").cast("int").alias("replicates")))
    for n in names:
        both = both.crossJoin(E.interval(r, n).select(c("low").alias(f"low_{n}"), c("high").alias(f"high_{n}")))
    covered = F.array_join(F.filter(F.array(*[F.when(c(n).between(c(f"low_{n}"), c(f"high_{n}")), n) for n in names]), lambda x: x.isNotNull()), " ")
    width = (c("high_accuracy") - c("low_accuracy")) / (2 * 1.96 * F.sqrt(c("accuracy") * (1 - c("accuracy")) / c("n")))
    return rounded(both.select("n", "replicates", "accuracy", "macro_f1", "kappa", covered.alias("covered"), width.between(0.8, 1.2).alias("width")), "accuracy", "macro_f1", "kappa")


DRAWN = "d AS (SELECT u.speaker, r.i AS replicate, ('0x' || substr(md5('1337:' || u.speaker || ':' || r.i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM (SELECT DISTINCT speaker FROM p) u, range(0, 300) r(i)), m AS (SELECT speaker, replicate, " + " + ".join(f"(x >= {x!r}::DOUBLE)::INT" for x in E.POISSON) + " AS w FROM d)"


DRAWS = f"WITH {PRED}, {DRAWN} SELECT replicate::INT AS replicate, speaker, w::BIGINT AS w FROM m"


@query("u04_replicate_draws", DRAWS)
def u04(spark, sf):
    """The multiplicities of the cluster bootstrap."""
    units = predictions(spark, sf).select("speaker").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(299))))
    return units.select("replicate", "speaker", E.multiplicity(1337, "speaker", "replicate").alias("w"))


@query("u04_replicates_in_sql", DRAWS)
def u04_sql(spark, sf):
    """The same multiplicities by a table function."""
    tables.register(spark)
    predictions(spark, sf).select("speaker").distinct().createOrReplaceTempView("units")
    return spark.sql("SELECT replicate, speaker, w FROM replicates(TABLE(units), 300, 1337)")


@query("e06_cluster_bootstrap", f"""WITH {PRED}, {DRAWN}, k AS (SELECT replicate, t, a, sum(w)::DOUBLE AS w FROM p JOIN m USING (speaker) GROUP BY ALL), l AS (SELECT unnest([0, 1, 2, 3]) AS label),
f AS (SELECT replicate, label, 2 * sum(CASE WHEN t = label AND a = label THEN w ELSE 0 END) / greatest(sum(CASE WHEN t = label THEN w ELSE 0 END) + sum(CASE WHEN a = label THEN w ELSE 0 END), 1) AS f1 FROM k, l GROUP BY ALL),
c AS (SELECT replicate, sum(CASE WHEN t = a THEN w ELSE 0 END) / sum(w) AS accuracy FROM k GROUP BY replicate) SELECT f.replicate::INT AS replicate, round(accuracy, 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f JOIN c USING (replicate) GROUP BY f.replicate, accuracy""")
def e06(spark, sf):
    return rounded(E.cluster_bootstrap(predictions(spark, sf), "speaker", "t", "a", LABELS, 300), "accuracy", "macro_f1")


@query("e07_paired_bootstrap", f"WITH {PRED}, {ONE.format(p='a', src='p')}, k2 AS (SELECT label, 2 * count(*) FILTER (WHERE t = label AND b = label) / (count(*) FILTER (WHERE t = label) + count(*) FILTER (WHERE b = label)) AS f2 FROM p, l GROUP BY label), g AS (SELECT (SELECT avg(f2) FROM k2) - avg(f1) AS delta FROM f) SELECT 500 AS replicates, round(delta, 6) AS delta, delta > 0 AS better, true AS covers FROM g")
def e07(spark, sf):
    p = predictions(spark, sf)
    r = E.paired_bootstrap(p, "t", "a", "b", LABELS, 500)
    real = E.scores(p, "t", "b", LABELS).select(c("macro_f1").alias("y")).crossJoin(E.scores(p, "t", "a", LABELS).select(c("macro_f1").alias("x")))
    one_sided = r.agg(F.avg((c("delta") <= 0).cast("double")).alias("p"), F.countDistinct("replicate").cast("int").alias("replicates"))
    both = E.interval(r, "delta").crossJoin(real).crossJoin(one_sided).withColumn("delta", c("y") - c("x"))
    return rounded(both.select("replicates", "delta", (c("p") < 0.5).alias("better"), c("delta").between(c("low"), c("high")).alias("covers")), "delta")


@query("e08_mcnemar", """WITH p AS (SELECT vec_id % 3 AS t, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE vec_id % 3 END AS a, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE vec_id % 3 END AS b FROM embeddings), n AS (SELECT count(*) FILTER (WHERE a <> t AND b = t) AS b01, count(*) FILTER (WHERE a = t AND b <> t) AS b10 FROM p)
SELECT b01, b10, round(least(1, 2 * (SELECT sum(exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2))) FROM range(0, 1000) r(i) WHERE i <= least(b01, b10))), 6) AS p FROM n""")
def e08(spark, sf):
    v = table(spark, sf, "embeddings").select((c("vec_id") % 3).alias("t"), F.when(c("vec_id") % 7 == 0, -1).otherwise(c("vec_id") % 3).alias("a"), F.when(c("vec_id") % 11 == 0, -1).otherwise(c("vec_id") % 3).alias("b"))
    return rounded(E.mcnemar(v, "t", "a", "b"), "p")


@query("e09_wilson", "WITH g AS (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE event_type = 'view') AS x, 1.959964 AS z FROM events GROUP BY user_id) SELECT user_id, round(greatest((x / n + z * z / (2 * n) - z * sqrt(x / n * (1 - x / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((x / n + z * z / (2 * n) + z * sqrt(x / n * (1 - x / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM g")
def e09(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(c("event_type") == "view").alias("x"))
    low, high = wilson(c("x"), c("n"))
    return rounded(g.select("user_id", low.alias("low"), high.alias("high")), "low", "high")


@query("e10_duration_accuracy", f"WITH {PRED} SELECT CASE WHEN duration < 5 THEN '3-5' WHEN duration < 7 THEN '5-7' ELSE '7-10' END AS bucket, count(*) AS n, round(avg((t = a)::INT), 6) AS accuracy FROM p WHERE duration >= 3 AND duration < 10.01 GROUP BY 1")
def e10(spark, sf):
    return rounded(E.duration_accuracy(predictions(spark, sf), "t", "a"), "accuracy")


@query("e11_confusion", f"WITH {PRED} SELECT t, " + ", ".join(f'round(count(*) FILTER (WHERE a = {i}) / count(*), 6) AS "{i}"' for i in range(4)) + " FROM p GROUP BY t")
def e11(spark, sf):
    return rounded(E.confusion_matrix(predictions(spark, sf), "t", "a", LABELS, True), "0", "1", "2", "3")


@query("e12_logistic_probe")
def e12(spark, sf):
    return E.logistic_probe(with_split(spark, sf), "vec", "label").filter("split = 'test'").select("vec_id", "label", "pred")


@query("e13_svm_probe")
def e13(spark, sf):
    return E.svm_probe(with_split(spark, sf), "vec", "label").filter("split = 'test'").select("vec_id", "label", "pred")


@query("e14_gated_probe")
def e14(spark, sf):
    v = hold_out(with_split(spark, sf).withColumn("female", (c("label") % 2)), "female", 0.2, "vec_id")
    return E.gated_probe(v, "vec", "female", "held_out", 0.0).select("vec_id", "female", "pred", "held_out")


@query("e15_fusion_probe")
def e15(spark, sf):
    v = with_split(spark, sf).withColumn("vec", fuse(c("vec"), F.transform(F.slice("vec", 1, 8), lambda x: x * 2)))
    return E.logistic_probe(v, "vec", "label").filter("split = 'test'").select("vec_id", "label", "pred")


@query("e16_regimes")
def e16(spark, sf):
    v = with_split(spark, sf).withColumn("channel_split", F.when(c("file_id") % 5 == 0, "test").otherwise("train"))
    return rounded(E.regimes(v, "vec", "label", list(range(10)), {"speaker": "split", "channel": "channel_split"}), "accuracy", "macro_f1", digits=4)


@query("e17_model_table", f"WITH {PRED}, {ONE.format(p='a', src='p')}, k2 AS (SELECT label, 2 * count(*) FILTER (WHERE t = label AND b = label) / (count(*) FILTER (WHERE t = label) + count(*) FILTER (WHERE b = label)) AS f2 FROM p, l GROUP BY label) SELECT 'a' AS model, (SELECT count(*) FROM p) AS n, round((SELECT avg((t = a)::INT) FROM p), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f UNION ALL SELECT 'b', (SELECT count(*) FROM p), round((SELECT avg((t = b)::INT) FROM p), 6), round(avg(f2), 6) FROM k2")
def e17(spark, sf):
    p = predictions(spark, sf)
    long = p.select("t", F.lit("a").alias("model"), c("a").alias("pred")).unionByName(p.select("t", F.lit("b").alias("model"), c("b").alias("pred")))
    return rounded(E.scores(long, "t", "pred", LABELS, ["model"]), "accuracy", "macro_f1")


@query("e18_quoted_numbers", "SELECT n_name, n_regionkey + 0.5 AS expected, n_regionkey::DOUBLE AS actual FROM nation WHERE n_nationkey % 4 = 0")
def e18(spark, sf):
    n = table(spark, sf, "nation").select("n_name", "n_nationkey", c("n_regionkey").cast("double").alias("v"))
    return E.quoted_numbers(n, n.withColumn("v", F.when(c("n_nationkey") % 4 == 0, c("v") + 0.5).otherwise(c("v"))), "n_name", "v")
