"""Queries of the L operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import labels as L
from earshot.plans.aggregates import rounded

from earshot.plans.registry import query, segments
from earshot.session import table

c = F.col
REGIONS = ["click", "view", "purchase"]


def judged(spark, sf):
    """Events as judgements: the true region by user, Unplayable for errors."""
    e = table(spark, sf, "events")
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (c("user_id") % 3 + 1).cast("int"))
    j = F.when(c("event_type") == "error", "Unplayable").otherwise(c("event_type"))
    return e.select("event_id", "user_id", region.alias("region"), j.alias("judgement"), F.when(c("event_id") % 4 == 0, "extension").otherwise("primary").alias("tranche"), (c("user_id") % 12).alias("cell"))


J = """j AS (SELECT event_id, user_id, CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END AS region, CASE event_type WHEN 'error' THEN 'Unplayable' ELSE event_type END AS judgement, CASE WHEN event_id % 4 = 0 THEN 'extension' ELSE 'primary' END AS tranche FROM events),
s AS (SELECT *, CASE WHEN judgement IN ('click', 'view', 'purchase') THEN judgement ELSE 'Other' END AS collapsed FROM j WHERE judgement <> 'Unplayable')"""


@query("l01_freeze", """WITH {seg}, g AS (SELECT c_custkey AS actor, CASE WHEN c_custkey % 10 = 1 AND c_custkey > 1 THEN c_custkey - 1 ELSE c_custkey END AS speaker_final, CASE c_mktsegment WHEN 'BUILDING' THEN 'keep' WHEN 'MACHINERY' THEN 'reject' END AS d, CASE WHEN c_custkey % 9 = 0 THEN 'Q' ELSE '' END AS rr, c_custkey AS o FROM customer),
f AS (SELECT speaker_final, arg_min(d, o) FILTER (WHERE d IS NOT NULL) AS gd, arg_min(rr, o) FILTER (WHERE d IS NOT NULL) AS gr FROM g GROUP BY 1), p AS (SELECT actor, g.speaker_final, coalesce(d, gd) AS dec, coalesce(nullif(CASE WHEN d IS NOT NULL THEN rr ELSE gr END, ''), '') AS r FROM g JOIN f USING (speaker_final)),
x AS (SELECT speaker AS actor, speaker_final, dec, coalesce(nullif(r, ''), region) AS reg, duration, is_excluded FROM seg JOIN p ON speaker = actor), h AS (SELECT speaker_final, reg, round(sum(duration), 6) AS w FROM x GROUP BY ALL),
hr AS (SELECT speaker_final, reg FROM h QUALIFY row_number() OVER (PARTITION BY speaker_final ORDER BY w DESC, reg) = 1), ev AS (SELECT speaker_final, count(*) FILTER (WHERE NOT is_excluded) AS n, coalesce(round(sum(duration) FILTER (WHERE NOT is_excluded), 6), 0) AS sec FROM x GROUP BY 1)
SELECT x.actor, x.speaker_final, x.dec AS speaker_decision, hr.reg AS final_dialect, CASE WHEN x.dec = 'reject' THEN 'decision' WHEN n < 5 OR sec < 45 THEN 'dust' WHEN x.dec IS NULL THEN 'undecided' ELSE '' END AS exclusion_rule, count(*) AS rows FROM x JOIN hr USING (speaker_final) JOIN ev USING (speaker_final) GROUP BY ALL""")
def l01(spark, sf):
    k = table(spark, sf, "customer")
    decisions = k.select(c("c_custkey").alias("actor"), F.when(c("c_mktsegment") == "BUILDING", "keep").when(c("c_mktsegment") == "MACHINERY", "reject").alias("decision"), F.lit("").alias("reason"), F.when(c("c_custkey") % 9 == 0, "Q").otherwise("").alias("resolved_region"), c("c_custkey").alias("order"))
    same = k.filter("c_custkey % 10 = 1 AND c_custkey > 1").select(c("c_custkey").alias("a"), (c("c_custkey") - 1).alias("b"))
    out = L.freeze(segments(spark, sf).withColumnRenamed("speaker", "actor"), decisions, same)
    return out.groupBy("actor", "speaker_final", "speaker_decision", "final_dialect", "exclusion_rule").agg(F.count("*").alias("rows"))


@query("l02_latest", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def l02(spark, sf):
    return L.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("l03_eligible_pool", "SELECT o_custkey AS speaker, (o_custkey % 5)::VARCHAR AS region, max(o_totalprice) AS risk FROM orders GROUP BY o_custkey")
def l03(spark, sf):
    return L.eligible_pool(table(spark, sf, "orders").select(c("o_custkey").alias("speaker"), (c("o_custkey") % 5).cast("string").alias("region"), c("o_totalprice").alias("risk")))


@query("l04_score_decisions", f"WITH {J} SELECT region, collapsed, count(*) AS n, count(*) FILTER (WHERE judgement = region) AS agree FROM s GROUP BY ALL")
def l04(spark, sf):
    s = L.score_decisions(judged(spark, sf), REGIONS).filter("scored")
    return s.groupBy("region", "collapsed").agg(F.count("*").alias("n"), F.count_if(c("agree")).alias("agree"))


@query("l05_kappa", """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS d FROM c), e AS (SELECT sum(x * y) AS e FROM (SELECT a AS l, sum(n) AS x FROM c GROUP BY 1) JOIN (SELECT b AS l, sum(n) AS y FROM c GROUP BY 1) USING (l))
SELECT n::BIGINT AS n, round(d / n, 6) AS observed, round(e / (n * n), 6) AS expected, round((d / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t, e""")
def l05(spark, sf):
    return rounded(L.kappa(table(spark, sf, "labels"), "quality", "toxic"), "observed", "expected", "kappa")


@query("l06_judgement_table", f"WITH {J} SELECT region, count(*) FILTER (WHERE judgement = 'click') AS click, count(*) FILTER (WHERE judgement = 'view') AS view, count(*) FILTER (WHERE judgement = 'never') AS never FROM j GROUP BY region")
def l06(spark, sf):
    return L.judgement_table(judged(spark, sf), "region", "judgement", ["click", "view", "never"])


@query("l07_summarise", f"""WITH {J}, x AS (SELECT 'all' AS scope, * FROM s UNION ALL SELECT 'primary', * FROM s WHERE tranche = 'primary'), k AS (SELECT scope, region, collapsed, count(*) AS n FROM x GROUP BY ALL),
e AS (SELECT scope, sum(p * q) AS e FROM (SELECT scope, region AS l, sum(n) AS p FROM k GROUP BY ALL) JOIN (SELECT scope, collapsed AS l, sum(n) AS q FROM k GROUP BY ALL) USING (scope, l) GROUP BY scope),
t AS (SELECT scope, sum(n) AS n, sum(CASE WHEN region = collapsed THEN n ELSE 0 END) AS d FROM k GROUP BY scope) SELECT scope, n::BIGINT AS n, round(d / n, 6) AS agree, round((d / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t JOIN e USING (scope)""")
def l07(spark, sf):
    return rounded(L.summarise(judged(spark, sf), "tranche", REGIONS), "agree", "kappa")


AUDIT = "a AS (SELECT event_id, CASE user_id % 2 WHEN 0 THEN 'click' ELSE 'view' END AS region, CASE event_type WHEN 'error' THEN 'cannot_tell' WHEN 'signup' THEN 'not_dialect' ELSE event_type END AS judgement, value FROM events), f AS (SELECT *, judgement = 'cannot_tell' AS cannot_tell, judgement NOT IN ('cannot_tell', 'not_dialect') AND judgement <> region AS wrong_region FROM a)"


def audited(spark, sf):
    e = table(spark, sf, "events")
    j = F.when(c("event_type") == "error", "cannot_tell").when(c("event_type") == "signup", "not_dialect").otherwise(c("event_type"))
    return L.audit_flags(e.select("event_id", F.when(c("user_id") % 2 == 0, "click").otherwise("view").alias("region"), j.alias("judgement"), "value"))


@query("l08_audit_flags", f"WITH {AUDIT} SELECT event_id, cannot_tell, wrong_region FROM f")
def l08(spark, sf):
    return audited(spark, sf).select("event_id", "cannot_tell", "wrong_region")


@query("l09_purity_report", f"""WITH {AUDIT}, g AS (SELECT 'wrong_region' AS outcome, region, count(*) AS n, sum(wrong_region::INT)::DOUBLE AS x FROM f GROUP BY region UNION ALL SELECT 'cannot_tell', region, count(*), sum(cannot_tell::INT) FROM f GROUP BY region),
r AS (SELECT *, x / n AS p, 1.959964 AS z FROM g), w AS (SELECT *, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS lo, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS hi FROM r)
SELECT outcome, region, n, round(p, 6) AS rate, round(greatest(lo, 0), 6) AS low, round(least(hi, 1), 6) AS high FROM w UNION ALL SELECT outcome, NULL, sum(n)::BIGINT, round(sum(p * CASE region WHEN 'click' THEN 3 ELSE 1 END) / 4, 6), NULL, NULL FROM w GROUP BY outcome""")
def l09(spark, sf):
    pop = spark.createDataFrame([("click", 3), ("view", 1)], "region string, n long")
    return rounded(L.purity_report(audited(spark, sf), "region", ["wrong_region", "cannot_tell"], pop), "rate", "low", "high")


@query("l10_rates_by_band", f"WITH {AUDIT} SELECT CASE WHEN value < 30 THEN 'short' ELSE 'long' END AS band, count(*) AS n, round(avg(wrong_region::INT), 6) AS wrong FROM f GROUP BY 1")
def l10(spark, sf):
    return rounded(L.rates(audited(spark, sf).withColumn("band", F.when(c("value") < 30, "short").otherwise("long")), ["band"], wrong=c("wrong_region")), "wrong")


@query("l11_keep_rate", "WITH {seg} SELECT tier, count(*) AS n, round(avg((NOT is_excluded)::INT), 6) AS kept FROM seg GROUP BY tier")
def l11(spark, sf):
    return rounded(L.rates(segments(spark, sf), ["tier"], kept=~c("is_excluded")), "kept")


@query("l12_model_vs_human", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def l12(spark, sf):
    return L.confusion_pairs(table(spark, sf, "labels"), "quality", "toxic")


@query("l13_risk_sanity", "SELECT c_mktsegment IN ('BUILDING') AS kept, round(avg(c_acctbal), 4) AS risk, count(*) AS n FROM customer GROUP BY 1")
def l13(spark, sf):
    return table(spark, sf, "customer").groupBy((c("c_mktsegment") == "BUILDING").alias("kept")).agg(F.round(F.avg("c_acctbal"), 4).alias("risk"), F.count("*").alias("n"))


@query("l14_recall", "WITH {seg} SELECT region, split = 'test' AS on_test, count(*) AS n, round(avg((CASE WHEN seg_no % 3 = 0 THEN region ELSE 'ASIA' END = region)::INT), 6) AS recall FROM seg WHERE speaker IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL")
def l14(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 0").select(c("c_custkey").alias("speaker"))
    s = segments(spark, sf).join(rich, "speaker", "left_semi").withColumns({"pred": F.when(c("seg_no") % 3 == 0, c("region")).otherwise("ASIA"), "on_test": c("split") == "test"})
    return rounded(L.rates(s, ["region", "on_test"], recall=c("pred") == c("region")), "recall")


@query("l15_accept_decisions", """WITH b AS (SELECT event_id % 400 AS item_id, CASE WHEN user_id % 10 = 0 THEN 'stranger' ELSE 'ann' || (user_id % 2) END AS annotator, event_type AS judgement, event_id AS timestamp FROM events),
p AS (SELECT *, CASE WHEN item_id >= 300 THEN 'unknown item' WHEN annotator = 'stranger' THEN 'unknown annotator' WHEN judgement NOT IN ('click', 'view') THEN 'unknown judgement' WHEN item_id % 7 = 0 THEN 'decided before' END AS problem FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, annotator, problem IS NULL ORDER BY timestamp) AS k FROM p) SELECT timestamp, coalesce(problem, CASE WHEN k > 1 THEN 'repeated in batch' END, 'accepted') AS status FROM r""")
def l15(spark, sf):
    e = table(spark, sf, "events")
    b = e.select((c("event_id") % 400).alias("item_id"), F.when(c("user_id") % 10 == 0, "stranger").otherwise(F.concat(F.lit("ann"), (c("user_id") % 2).cast("string"))).alias("annotator"), c("event_type").alias("judgement"), c("event_id").alias("timestamp"))
    items = e.filter("event_id < 300").select(c("event_id").alias("item_id"))
    done = items.filter("item_id % 7 = 0").select("item_id", F.explode(F.array(F.lit("ann0"), F.lit("ann1"))).alias("annotator"))
    good, bad = L.accept_decisions(b, items, done, ["ann0", "ann1"], ["click", "view"])
    return good.select("timestamp", F.lit("accepted").alias("status")).unionByName(bad.select("timestamp", c("problem").alias("status")))


@query("l16_progress", """SELECT lang AS tranche, count(*) AS items, count(l.doc_id) AS judged, count(*) FILTER (WHERE l.toxic = 1) AS unplayable, count(*) - count(l.doc_id) AS "left" FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def l16(spark, sf):
    d = table(spark, sf, "labels").select(c("doc_id").alias("item_id"), F.when(c("toxic") == 1, "Unplayable").otherwise("ok").alias("judgement"))
    return L.progress(table(spark, sf, "documents").select(c("doc_id").alias("item_id"), c("lang").alias("tranche")), d, "tranche")


@query("l17_decision_records", "SELECT c_custkey AS actor, event_type AS decision, CASE WHEN event_type = 'view' THEN '' WHEN event_id % 2 = 0 THEN 'R' ELSE '' END AS resolved_region, c_name AS name FROM customer JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) e ON c_custkey = user_id".replace("event_type AS decision", "CASE event_type WHEN 'view' THEN 'different' ELSE 'same' END AS decision"))
def l17(spark, sf):
    v = table(spark, sf, "events").select(c("user_id").alias("actor"), F.when(c("event_type") == "view", "different").otherwise("same").alias("decision"), F.lit(None).cast("string").alias("reason"), F.when(c("event_id") % 2 == 0, "R").alias("resolved_region"), c("event_id").alias("timestamp"))
    return L.decision_records(v, table(spark, sf, "customer").select(c("c_custkey").alias("actor"), c("c_name").alias("name"))).select("actor", "decision", "resolved_region", "name")


@query("l18_design_record", "WITH {seg} SELECT region, count(*) AS n, round(quantile_cont(duration, 1/3), 6) AS low_cut, round(quantile_cont(duration, 2/3), 6) AS high_cut, 1337 AS seed FROM seg GROUP BY region")
def l18(spark, sf):
    return rounded(L.design_record(segments(spark, sf), "region", "duration", seed=1337), "low_cut", "high_cut")
