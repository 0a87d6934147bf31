"""Human decisions: freezing onto segments, stores, samples, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import config as C
from earshot.functions.text import blank
from earshot.operators.components import connected_components
from earshot.operators.quantiles import exact_percentiles, spread_join
from earshot.operators.summary import dominant, evidence
from earshot.operators.summary import keep_first


def freeze(segments: DataFrame, decisions: DataFrame, same: DataFrame, floor_segments: int = C.FLOOR_SEGMENTS, floor_seconds: float = C.FLOOR_SECONDS) -> DataFrame:
    """Segments with the review's outcome.

    segments: (actor, region, duration, is_excluded, ...); decisions: (actor, decision, reason, resolved_region,
    order), one row an actor, also of actors without segments; same: (a, b) actors judged the same. Adds speaker_final (least actor of the group),
    speaker_decision (own, else the group's first by order), speaker_reason, final_dialect (the speaker's region of most
    duration after corrections), evidence, exclusion_rule and verified_keep.
    """
    groups = connected_components(same).select(F.col("node").alias("actor"), "component")

    def grouped(actors: DataFrame) -> DataFrame:
        return actors.join(groups, "actor", "left").withColumn("speaker_final", F.coalesce("component", "actor")).drop("component")

    who = grouped(segments.select("actor").distinct())
    known = grouped(decisions.filter(~blank(F.col("decision"))))
    first = known.groupBy("speaker_final").agg(F.min(F.struct("order", "decision", "reason", "resolved_region")).alias("_g"))
    own = known.select("actor", F.struct("order", "decision", "reason", "resolved_region").alias("_o"))
    plan = who.join(own, "actor", "left").join(first, "speaker_final", "left").withColumn("_d", F.coalesce("_o", "_g"))
    plan = plan.select("actor", "speaker_final", F.col("_d.decision").alias("speaker_decision"), F.coalesce("_d.reason", F.lit("")).alias("speaker_reason"), F.coalesce("_d.resolved_region", F.lit("")).alias("_r"))
    out = segments.join(plan, "actor").withColumn("_region", F.coalesce(F.nullif("_r", F.lit("")), "region"))
    home = dominant(out, ["speaker_final"], "_region", F.col("duration")).withColumnRenamed("_region", "final_dialect")
    dust = evidence(out, "speaker_final", F.col("is_excluded"), floor_segments, floor_seconds)
    out = out.join(home, "speaker_final").join(dust, "speaker_final")
    reject = F.coalesce(F.col("speaker_decision") == "reject", F.lit(False))
    rule = F.when(reject, "decision").when(F.col("dust"), "dust").when(F.col("speaker_decision").isNull(), "undecided").otherwise("")
    return out.withColumn("exclusion_rule", rule).withColumn("verified_keep", F.col("exclusion_rule") == "").drop("_r", "_region", "dust")


def latest(df: DataFrame, key: list[str], time: str) -> DataFrame:
    """Last write wins."""
    return keep_first(df, key, [F.desc(time)])


def eligible_pool(actors: DataFrame) -> DataFrame:
    """(speaker, region, risk) from actors (speaker, region, risk): one region each and no risk missing, or an error."""
    g = actors.groupBy("speaker").agg(F.countDistinct("region").alias("_n"), F.min("region").alias("region"), F.max("risk").alias("risk"), F.count_if(F.col("risk").isNull()).alias("_m"))
    bad = g.filter("_n <> 1 OR _m > 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]}: several regions or a missing risk")
    return g.drop("_n", "_m")


def score_decisions(df: DataFrame, regions: list[str]) -> DataFrame:
    """df (region, judgement) with scored (not Unplayable), collapsed (other than a region: Other) and agree."""
    collapsed = F.when(F.col("judgement").isin(*regions), F.col("judgement")).otherwise("Other")
    return df.withColumns({"scored": F.col("judgement") != "Unplayable", "collapsed": collapsed, "agree": F.when(F.col("judgement") != "Unplayable", F.col("judgement") == F.col("region"))})


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, observed, expected, kappa); kappa is null without rows or where 1 is expected."""
    by = by or []
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(*by, F.col(a).alias("_l")).agg(F.sum("n").alias("_x"))
    cols = cells.groupBy(*by, F.col(b).alias("_l")).agg(F.sum("n").alias("_y"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_d"))
    chance = rows.join(cols, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("_x") * F.col("_y")).alias("_c"))
    both = total.join(chance, by, "left") if by else total.crossJoin(chance)
    e = F.coalesce("_c", F.lit(0)) / (F.col("n") * F.col("n"))
    out = both.withColumns({"observed": F.col("_d") / F.col("n"), "expected": e})
    return out.withColumn("kappa", F.when((F.col("n") > 0) & (F.round("expected", 12) != 1), (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))).drop("_d", "_c")


def judgement_table(df: DataFrame, by: str, judgement: str, labels: list[str]) -> DataFrame:
    """One count column for each judgement; 0 where none."""
    return df.groupBy(by).pivot(judgement, labels).count().na.fill(0)


def summarise(df: DataFrame, tranche: str, regions: list[str]) -> DataFrame:
    """(scope, n, agree, kappa): the primary tranche alone, then all."""
    scored = score_decisions(df, regions).filter("scored")
    scopes = scored.select(F.explode(F.when(F.col(tranche) == "primary", F.array(F.lit("primary"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("scope"), "region", "collapsed", "agree")
    k = kappa(scopes, "region", "collapsed", ["scope"]).select("scope", "kappa")
    return scopes.groupBy("scope").agg(F.count("*").alias("n"), F.avg(F.col("agree").cast("double")).alias("agree")).join(k, "scope")


def audit_flags(df: DataFrame) -> DataFrame:
    """df (judgement, region) with cannot_tell, wrong_region and not_dialect."""
    j = F.col("judgement")
    return df.withColumns({"cannot_tell": j == "cannot_tell", "wrong_region": ~j.isin("cannot_tell", "not_dialect") & (j != F.col("region")), "not_dialect": j == "not_dialect"})


def wilson(x: Column, n: Column, z: float = C.Z95) -> tuple[Column, Column]:
    """Interval of a share x / n, inside 0 to 1; null for n = 0."""
    n = n.cast("double")
    p = x / F.nullif(n, F.lit(0.0))
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    d = 1 + z * z / n
    return F.greatest((mid - half) / d, F.lit(0.0)), F.least((mid + half) / d, F.lit(1.0))


def purity_report(df: DataFrame, by: str, outcomes: list[str], population: DataFrame) -> DataFrame:
    """(outcome, by, n, rate, low, high) with Wilson intervals, and a row with a null class: rates weighted by the population's (by, n)."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("int").alias("x")) for o in outcomes])).alias("e")).select(by, "e.*")
    g = long.groupBy("outcome", by).agg(F.count("*").alias("n"), F.sum("x").alias("_x"))
    low, high = wilson(F.col("_x"), F.col("n"))
    rated = g.select("outcome", by, "n", (F.col("_x") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))
    w = rated.join(population.select(by, F.col("n").alias("_w")), by)
    pooled = w.groupBy("outcome").agg(F.sum("n").alias("n"), (F.sum(F.col("rate") * F.col("_w")) / F.sum("_w")).alias("rate"))
    return rated.unionByName(pooled.withColumn(by, F.lit(None).cast(df.schema[by].dataType)), allowMissingColumns=True)


def rates(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Shares of rows of each class for which conditions hold."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in conditions.items()])


def confusion_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def accept_decisions(batch: DataFrame, items: DataFrame, decided: DataFrame, annotators: list[str], judgements: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a problem) of a batch (item_id, annotator, judgement, timestamp): one row for each item and annotator, the first by time."""
    known = items.select("item_id").distinct().withColumn("_i", F.lit(1))
    done = decided.select("item_id", "annotator").distinct().withColumn("_d", F.lit(1))
    b = batch.join(known, "item_id", "left").join(done, ["item_id", "annotator"], "left")
    problem = F.when(F.col("_i").isNull(), "unknown item").when(~F.coalesce(F.col("annotator").isin(*annotators), F.lit(False)), "unknown annotator").when(~F.coalesce(F.col("judgement").isin(*judgements), F.lit(False)), "unknown judgement").when(F.col("_d").isNotNull(), "decided before")
    b = b.withColumn("problem", problem).drop("_i", "_d")
    good = b.filter("problem IS NULL")
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("item_id", "annotator").orderBy("timestamp", "judgement"))
    ranked = good.withColumn("_r", again)
    rejected = b.filter("problem IS NOT NULL").unionByName(ranked.filter("_r > 1").withColumn("problem", F.lit("repeated in batch")).drop("_r"))
    return ranked.filter("_r = 1").drop("_r", "problem"), rejected


def progress(sample: DataFrame, decided: DataFrame, by: str) -> DataFrame:
    """(by, items, judged, unplayable, left) of a sample (item_id, by) against decisions (item_id, judgement)."""
    d = decided.groupBy("item_id").agg(F.bool_or(F.col("judgement") == "Unplayable").alias("_u")).withColumn("_d", F.lit(1))
    return sample.join(d, "item_id", "left").groupBy(by).agg(F.count("*").alias("items"), F.count("_d").alias("judged"), F.count_if(F.coalesce("_u", F.lit(False))).alias("unplayable"), F.count_if(F.col("_d").isNull()).alias("left"))


def decision_records(verdicts: DataFrame, actors: DataFrame) -> DataFrame:
    """Decision rows from a verdict log (actor, decision, reason, resolved_region, timestamp) and actor attributes; the latest verdict counts, and a resolved region only with 'same' or 'keep'."""
    last = latest(verdicts, ["actor"], "timestamp")
    region = F.when(F.col("decision").isin("same", "keep"), F.coalesce("resolved_region", F.lit(""))).otherwise("")
    return last.withColumns({"reason": F.coalesce("reason", F.lit("")), "resolved_region": region}).join(actors, "actor")


def design_record(df: DataFrame, by: str, column: str, **facts) -> DataFrame:
    """(by, low cut, high cut, n) of a sample design with given facts as constant columns."""
    cuts = exact_percentiles(df, [by], F.col(column), [1 / 3, 2 / 3]).select(by, F.col("q").alias("_c"))
    rows = df.groupBy(by).agg(F.count("*").alias("n"))
    return spread_join(rows, cuts, [by]).select(by, "n", F.col("_c")[0].alias("low_cut"), F.col("_c")[1].alias("high_cut"), *[F.lit(v).alias(k) for k, v in facts.items()])
