"""Aggregates, rollups, rankings and set operations over segment-like tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot import config as C
from earshot.operators.quantiles import FEW, exact_percentiles, spread_join
from earshot.session import stored

HOURS = 3600.0


def hours(c: str = "duration") -> Column:
    return F.sum(c) / HOURS


def class_summary(df: DataFrame, by: list[str], distinct: dict[str, str] | None = None) -> DataFrame:
    """Segments, hours and distinct counts (name -> column) for each class."""
    return df.groupBy(*by).agg(F.count("*").alias("segments"), hours().alias("hours"), *[F.countDistinct(c).alias(n) for n, c in (distinct or {}).items()])


def per_speaker(df: DataFrame, speaker: str, label: str, order: str) -> DataFrame:
    """Segments, hours and first label (by order) of each speaker; most hours first."""
    return df.groupBy(speaker).agg(F.count("*").alias("segments"), hours().alias("hours"), F.min(F.struct(order, label))[label].alias(label)).orderBy(F.desc("hours"), speaker)


def dominant(df: DataFrame, keys: list[str], label: str, weight: Column | None = None, smallest: bool = False) -> DataFrame:
    """The label of largest total weight (default: of most rows) in each group; ties go to the smallest label.

    smallest=True takes the label of the least weight instead.
    """
    per = df.groupBy(*keys, label).agg((F.count("*") if weight is None else F.sum(weight)).alias("_w"))
    # totals are compared to six decimals, so that ties do not depend on the order of addition
    w = F.round(F.col("_w").cast("double"), 6)
    return per.groupBy(*keys).agg(F.min(F.struct((w if smallest else -w).alias("w"), label))[label].alias(label))


def top_share(df: DataFrame, by: str, part: str) -> DataFrame:
    """The part with most hours in each class, and its share of the class."""
    per = df.groupBy(by, part).agg(hours().alias("h"))
    best = F.min(F.struct((-F.round("h", 9)).alias("w"), F.col(part), F.col("h")))
    return per.groupBy(by).agg(best[part].alias(part), (best["h"] / F.sum("h")).alias("share"))


def provenance_counts(df: DataFrame, by: str, provenance: str, catalogue: str = "catalogue") -> DataFrame:
    """Episodes by provenance and the catalogue's percentage, for each class."""
    is_cat = F.col(provenance) == catalogue
    return df.groupBy(by).agg(F.count("*").alias("episodes"), F.count_if(is_cat).alias("catalogue"), (100.0 * F.count_if(is_cat) / F.count("*")).alias("catalogue_percent"))


def counts_with_share(df: DataFrame, column: str) -> DataFrame:
    """Row counts of a column's values, and their share of all rows. The total is one row, joined in."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(column, "n", (F.col("n") / F.col("_all")).alias("share"))


def leveled(df: DataFrame) -> DataFrame:
    """level: group or total, from grouping_id, of an aggregate by rollup that has it as `_gid`."""
    return df.withColumn("level", F.when(F.col("_gid") == 0, "group").otherwise("total")).drop("_gid")


def corpus_totals(df: DataFrame, by: str, distinct: dict[str, str]) -> DataFrame:
    """Counts and minutes for each class (level: group) and for the whole corpus (level: total, class null); a null class is a group."""
    # rows are first counted for each combination of the distinct columns, as the rollup repeats its input for each of them
    each = df.groupBy(by, *dict.fromkeys(distinct.values())).agg(F.count("*").alias("_n"), F.sum("duration").alias("_d"))
    return leveled(each.rollup(by).agg(F.grouping_id().alias("_gid"), F.sum("_n").alias("segments"), (F.sum("_d") / 60).alias("minutes"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()]))


def temporal_coverage(df: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """(one row: total, dated, first, last), (year, n) of YYYYMMDD texts."""
    good = F.when(F.coalesce(F.col(date).rlike("^[0-9]{8}$"), F.lit(False)), F.col(date))
    whole = df.agg(F.count("*").alias("total"), F.count(good).alias("dated"), F.min(good).alias("first"), F.max(good).alias("last"))
    years = df.select(F.substring(good, 1, 4).alias("year")).dropna().groupBy("year").agg(F.count("*").alias("n"))
    return whole, years


def resource_metadata(df: DataFrame, key: str, status: str, episode: str) -> DataFrame:
    """Per resource: segments, a map of status counts and a sorted array of (episode, segments)."""
    per_status = df.groupBy(key, F.coalesce(status, F.lit("")).alias("k")).agg(F.count("*").alias("v")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("statuses"), F.sum("v").alias("segments"))
    per_episode = df.groupBy(key, F.col(episode).alias("episode")).agg(F.count("*").alias("segments")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("episode", "segments"))).alias("episodes"))
    return per_status.join(per_episode, key)


def actor_triage(df: DataFrame, key: str) -> DataFrame:
    """Mean and frequent music, mean ratio and SNR, minutes and risk of each actor."""
    music, ratio, speech, snr = F.avg("music_prob"), F.avg("speech_ratio"), F.avg("panns_speech_prob"), F.avg("snr_db")
    g = df.groupBy(key).agg(F.count("*").alias("n"), music.alias("music_mean"), F.avg((F.col("music_prob") >= 0.5).cast("int")).alias("music_share"), ratio.alias("ratio_mean"), speech.alias("speech_mean"), snr.alias("snr_mean"), (F.sum("duration") / 60).alias("minutes"))
    half = F.lit(0.5)
    return g.withColumn("risk", F.greatest(F.coalesce("music_mean", half), F.coalesce(1 - F.col("ratio_mean"), half), F.coalesce(1 - F.col("speech_mean"), half), F.coalesce(1 - F.least(F.col("snr_mean") / 30, F.lit(1.0)), half)))


def gender_mix(actors: DataFrame, votes: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Mix, majority and n of gender votes on actors (risk_score_base keeps the risk before, so reruns agree)."""
    p = F.avg((F.col("label") == "female").cast("double"))
    mix = votes.groupBy(key).agg(F.least(p, 1 - p).alias("gender_mix"), F.when(p >= 0.5, "female").otherwise("male").alias("gender_majority"), F.count("*").alias("gender_n"))
    base = F.col("risk_score_base") if "risk_score_base" in actors.columns else F.col("risk")
    out = actors.join(mix, key, "left").withColumn("risk_score_base", base).withColumn("gender_n", F.coalesce("gender_n", F.lit(0)))
    raised = F.greatest("risk_score_base", F.least(F.lit(1.0), 2 * F.col("gender_mix")))
    return out.withColumn("risk", F.when(F.col("gender_n") >= least, raised).otherwise(F.col("risk_score_base")))


def actor_table(df: DataFrame, actor: str, group: str, labels: list[str], risks: DataFrame, segments: int = C.FLOOR_SEGMENTS, seconds: float = C.FLOOR_SECONDS) -> DataFrame:
    """Actors with modal labels, minutes, their linked group's evidence, below_floor and risk (0.5 if unknown)."""
    own = df.groupBy(actor).agg(F.min(group).alias(group), F.count("*").alias("n"), (F.sum("duration") / 60).alias("minutes"))
    for c in labels:
        own = own.join(dominant(df, [actor], c), actor, "left")
    linked = own.groupBy(group).agg(F.sum("n").alias("group_n"), F.sum("minutes").alias("group_minutes"))
    out = own.join(linked, group).join(risks, actor, "left").withColumn("risk", F.coalesce("risk", F.lit(0.5)))
    return out.withColumn("below_floor", (F.col("group_n") < segments) | (F.round(F.col("group_minutes") * 60, 6) < seconds))


def evidence(df: DataFrame, key: str, excluded: Column, segments: int = C.FLOOR_SEGMENTS, seconds: float = C.FLOOR_SECONDS) -> DataFrame:
    """Segments and seconds of each key's rows that are not excluded, and whether they are under the floor."""
    n = F.coalesce(F.count_if(~excluded), F.lit(0))
    s = F.coalesce(F.sum(F.when(~excluded, F.col("duration"))), F.lit(0.0))
    return df.groupBy(key).agg(n.alias("evidence_segments"), s.alias("evidence_seconds")).withColumn("dust", (F.col("evidence_segments") < segments) | (F.round("evidence_seconds", 6) < seconds))


def channel_table(df: DataFrame, channel: str, region: str, platform: Column, speaker: str, split: str) -> DataFrame:
    """Platform, dominant region (ties: smallest name), hours, segments, speakers and splits of each channel."""
    own = df.groupBy(channel).agg(F.min(platform).alias("platform"), hours().alias("hours"), F.count("*").alias("segments"), F.countDistinct(speaker).alias("speakers"), F.array_join(F.sort_array(F.collect_set(split)), "|").alias("splits"))
    return own.join(dominant(df, [channel], region), channel)


def pivot_counts(df: DataFrame, rows: str, columns: str, values: list, measure: str | None = None) -> DataFrame:
    """rows x columns table of counts, or sums of a measure; 0 where nothing is."""
    agg = F.count(F.lit(1)) if measure is None else F.sum(measure)
    return df.groupBy(rows).pivot(columns, values).agg(agg).na.fill(0)


def concentration(df: DataFrame, by: str, weight: str) -> DataFrame:
    """Kish effective number and coefficient of variation (population) of weights in each class."""
    w = F.col(weight)
    return df.groupBy(by).agg(F.count("*").alias("n"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"), (F.stddev_pop(w) / F.avg(w)).alias("cv"))


def channel_counts(df: DataFrame, channel: str, by: str, smallest: bool = False) -> DataFrame:
    """Channels with any row of a class, and channels whose dominant class it is (by duration); the Total row counts channels once."""
    carrier = df.groupBy(by).agg(F.countDistinct(channel).alias("carrier"))
    dom = dominant(df, [channel], by, F.col("duration"), smallest).groupBy(by).agg(F.count("*").alias("dominant"))
    total = df.agg(F.countDistinct(channel).alias("carrier")).select(F.lit("Total").alias(by), "carrier", F.col("carrier").alias("dominant"))
    return carrier.join(dom, by, "left").select(by, "carrier", F.coalesce("dominant", F.lit(0)).alias("dominant")).unionByName(total)


def distinct_speakers(df: DataFrame, by: str, speaker: str, approximate: bool = False) -> DataFrame:
    return df.groupBy(by).agg((F.approx_count_distinct(speaker) if approximate else F.countDistinct(speaker)).alias("speakers"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, level) with margins: level is cell, by_<a>, by_<b> (the other column is then 'All') or total. Null, '' and 'All' are values of their own."""
    of = F.grouping_id()
    out = df.groupBy(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b)).agg(F.count("*").alias("_n")).cube(a, b).agg(of.alias("_gid"), F.sum("_n").alias("n"))
    level = F.element_at(F.array(*map(F.lit, ("cell", f"by_{a}", f"by_{b}", "total"))), F.col("_gid").cast("int") + 1)
    return out.select(F.when(F.col("_gid") >= 2, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_gid") % 2 == 1, "All").otherwise(F.col(b)).alias(b), "n", level.alias("level"))


def funnel(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Minutes that survive each gate in turn, in one row."""
    alive, out = F.lit(True), [(F.sum("duration") / 60).alias("all")]
    for name, keep in gates.items():
        alive = alive & keep
        out.append((F.sum(F.when(alive, F.col("duration")).otherwise(F.lit(0.0))) / 60).alias(name))
    return df.agg(*out)


def value_counts(df: DataFrame, column: str, blank: str = "(none)") -> DataFrame:
    v = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(blank))
    return df.groupBy(v.alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, density) over equal bins, the last one closed; values outside are left out."""
    by, width = by or [], (high - low) / bins
    x = F.col(column)
    inside = df.filter((x >= low) & (x <= high)).withColumn("bin", F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int"))
    counts = inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_all")) if by else counts.agg(F.sum("n").alias("_all"))
    both = counts.join(F.broadcast(total), by) if by else counts.crossJoin(F.broadcast(total))
    return both.select(*by, "bin", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def bucket(x: Column, edges: list[float], names: list[str], closed: bool = True) -> Column:
    """Half-open buckets; with closed the last one holds its upper edge."""
    out = F.lit(None).cast("string")
    for k, n in enumerate(names):
        upper = x <= edges[k + 1] if closed and k == len(names) - 1 else x < edges[k + 1]
        out = F.when((x >= edges[k]) & upper, n).otherwise(out)
    return out


def bucket_minutes(df: DataFrame, closed: bool = True) -> DataFrame:
    b = bucket(F.col("duration"), [3, 5, 8, 10], ["short", "medium", "long"], closed)
    return df.withColumn("bucket", b).dropna(subset=["bucket"]).groupBy("bucket").agg((F.sum("duration") / 60).alias("minutes"))


def composition(df: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """(by, column, n) in long form, 0 included."""
    return df.groupBy(by).pivot(column, values).count().na.fill(0).unpivot([by], values, column, "n")


def stage_summary(df: DataFrame, show: str, stages: list[str]) -> DataFrame:
    """Per show: recordings at each stage, first and last valid date, first non-blank id by order."""
    date = F.when(F.coalesce(F.col("date").rlike("^[0-9]{8}$"), F.lit(False)), F.col("date"))
    pid = F.min(F.when(F.coalesce(F.trim("id"), F.lit("")) != "", F.struct("order", "id")))["id"]
    return df.groupBy(show).agg(*[F.count_if(F.col("stage") == s).alias(s) for s in stages], F.min(date).alias("first"), F.max(date).alias("last"), F.coalesce(pid, F.lit("")).alias("id"))


def coverage(df: DataFrame, by: str, good: dict[str, Column]) -> DataFrame:
    """Valid counts and percentages for each group (level: group; a null is one) and over all (level: total)."""
    return leveled(df.rollup(by).agg(F.grouping_id().alias("_gid"), F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in good.items()], *[(100.0 * F.count_if(c) / F.count("*")).alias(f"{k}_percent") for k, c in good.items()]))


def keyword_rollup(df: DataFrame, key: str) -> DataFrame:
    """Search hits (key, order, name, region, title, keyword) per channel: last non-blank name, modal region, hits, first 3 titles, keywords in first-seen order."""
    order = F.array_sort(F.collect_list(F.struct("order", "title", "keyword")))
    g = df.groupBy(key).agg(F.count("*").alias("hits"), F.max(F.when(F.coalesce(F.trim("name"), F.lit("")) != "", F.struct("order", "name")))["name"].alias("name"), order.alias("_o"))
    g = g.select(key, "hits", "name", F.array_join(F.transform(F.slice("_o", 1, 3), lambda x: x["title"]), " ; ").alias("titles"), F.array_join(F.array_distinct(F.transform("_o", lambda x: x["keyword"])), " ; ").alias("keywords"))
    return g.join(dominant(df, [key], "region"), key)


def multi_show(df: DataFrame, count: str, least: int = 8, top: int = 15) -> DataFrame:
    """Channels by the number in texts such as '500+'."""
    n = F.regexp_extract(count, "[0-9]+", 0)
    return df.withColumn("n_shows", F.when(n != "", n.cast("int"))).filter(F.col("n_shows") >= least).orderBy(F.desc("n_shows"), df.columns[0]).limit(top)


def capped(n: Column, cap: int = 500) -> Column:
    return F.when(n >= cap, F.concat(F.lit(cap).cast("string"), F.lit("+"))).when(F.coalesce(n, F.lit(0)) == 0, "").otherwise(n.cast("string"))


def run_totals(df: DataFrame, source: str, measures: list[str]) -> DataFrame:
    """Sums for each source (level: group; a null is one) and over all (level: total)."""
    return leveled(df.rollup(source).agg(F.grouping_id().alias("_gid"), *[F.sum(m).alias(m) for m in measures]))


def reviewed_report(df: DataFrame, by: str, speaker: str, kept: Column, floor: Column) -> DataFrame:
    """Kept hours before and after the floor, speakers, and rows the floor takes."""
    d, good = F.col("duration"), kept & ~floor
    return df.groupBy(by).agg(
        (F.sum(F.when(kept, d).otherwise(0.0)) / HOURS).alias("kept_hours"), (F.sum(F.when(good, d).otherwise(0.0)) / HOURS).alias("effective_hours"),
        F.countDistinct(F.when(good, F.col(speaker))).alias("speakers"), F.count_if(kept & floor).alias("floor_rows"),
    )


def review_kpis(actors: DataFrame, decision: str = "decision", hours_col: str = "hours", dust: str = "below_floor") -> DataFrame:
    """One row: coverage and hours by state of review."""
    h, d, under = F.col(hours_col), F.col(decision), F.col(dust)
    decided = d.isNotNull()

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, h)), F.lit(0.0))

    return actors.agg(
        F.count("*").alias("actors"), F.count_if(decided).alias("decided"), (F.count_if(decided) / F.count("*")).alias("coverage"),
        total((d == "keep") & ~under).alias("kept_hours"), total((d == "reject") & ~under).alias("removed_hours"), total(under).alias("dust_hours"), total(~decided & ~under).alias("pending_hours"),
        F.count_if(decided & under).alias("dust_decided"),
    )


def review_composition(actors: DataFrame, by_hours: bool = True) -> DataFrame:
    """Weight of kept and pending actors by corrected region."""
    status = F.when(F.col("decision") == "keep", "kept").when(F.col("decision").isNull(), "pending")
    region = F.coalesce(F.nullif("resolved_region", F.lit("")), F.col("region"))
    w = F.col("hours") if by_hours else F.lit(1.0)
    return actors.select(region.alias("final_region"), status.alias("status"), w.alias("w")).dropna(subset=["status"]).groupBy("final_region", "status").agg(F.sum("w").alias("weight"))


def show_index(df: DataFrame, norm: Column, order: str) -> DataFrame:
    """Shows by normalised name: episodes summed, first region and raw name kept."""
    first = F.min(F.struct(order, "region", "show"))
    return df.groupBy(norm.alias("key")).agg(F.sum("episodes").alias("episodes"), first["region"].alias("region"), first["show"].alias("show"))


# --- windows, ranks and set operations -------------------------------------------------------------------


def terciles(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """low, mid or high by rank within the group: low up to floor((n + 1) / 3), mid up to floor(2n / 3)."""
    w = Window.partitionBy(by)
    r, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return df.withColumn("tercile", F.when(r <= F.floor((n + 1) / 3), "low").when(r <= F.floor(2 * n / 3), "mid").otherwise("high"))


def quantile_bands(df: DataFrame, by: str, column: str, few: int = FEW) -> DataFrame:
    """Bands by each group's exact thirds, right-closed; a null group is one too. Groups of over `few` rows are not sorted in one task."""
    cuts = stored(exact_percentiles(df, [by], F.col(column), [1 / 3, 2 / 3], few).select(by, F.col("q").alias("_cuts")), "cuts")
    x = F.round(column, 9)
    return spread_join(df, cuts, [by]).withColumn("band", F.when(x <= F.round(F.col("_cuts")[0], 9), "short").when(x <= F.round(F.col("_cuts")[1], 9), "medium").otherwise("long")).drop("_cuts")


def timeline_spread(df: DataFrame, key: str, k: int, order: list[str], best: list[Column]) -> DataFrame:
    """One row from each of k equal slices of a key's timeline: the best in each."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    # slice j holds the rows from int(j * n / k) to int((j + 1) * n / k); fewer rows than slices: each its own
    cut = F.when(n <= k, i).otherwise(F.floor(((i + 1) * k - 1) / n))
    sliced = df.withColumn("slice", cut.cast("int"))
    return sliced.withColumn("_r", F.row_number().over(Window.partitionBy(key, "slice").orderBy(*best, *order))).filter("_r = 1").drop("_r")


def diverse_top(df: DataFrame, key: str, part: str, k: int, order: list[Column]) -> DataFrame:
    """Best k rows of each key, one for each part first, then the rest."""
    first = F.row_number().over(Window.partitionBy(key, part).orderBy(*order))
    ranked = df.withColumn("_f", (first > 1).cast("int"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_f", *order))).filter(F.col("rank") <= k).drop("_f")


def top_rows(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order. Blank keys are one key."""
    return top_rows(df, key, order, 1).drop("rank")


def ranked_sizes(df: DataFrame, by: str, item: str, label: str) -> DataFrame:
    """Items of each group by size with their rank and modal label."""
    n = df.groupBy(by, item).agg(F.count("*").alias("n")).join(dominant(df, [by, item], label), [by, item])
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), item)))


def cumulative_by_hour(df: DataFrame, ts: str) -> DataFrame:
    """Events per hour with a running total. Hours, not events, pass through the single ordered window."""
    per = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)))


def lorenz(df: DataFrame, by: str, weight: str, top: int = 10) -> DataFrame:
    """Gini coefficient and share of the top rows of each class."""
    w = Window.partitionBy(by)
    r = df.withColumns({"_i": F.row_number().over(w.orderBy(weight)), "_d": F.row_number().over(w.orderBy(F.desc(weight)))})
    x, n = F.col(weight), F.count("*")
    return r.groupBy(by).agg(n.alias("n"), (2 * F.sum(F.col("_i") * x) / (n * F.sum(x)) - (n + 1) / n).alias("gini"), (F.sum(F.when(F.col("_d") <= top, x)) / F.sum(x)).alias("top_share"))


def lorenz_curve(df: DataFrame, by: str, weight: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(weight).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    return df.withColumns({"rows_share": F.row_number().over(Window.partitionBy(by).orderBy(weight)) / F.count("*").over(whole), "weight_share": F.sum(weight).over(w) / F.sum(weight).over(whole)})


def rank_auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the curve with ties at one half, from counts per distinct score."""
    by = by or []
    per = df.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("_b", below).groupBy(*by).agg((F.sum(F.col("p") * (F.col("_b") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def disambiguate(df: DataFrame, keys: list[str], name: str, size: str, base: str) -> DataFrame:
    """Within equal names the largest keeps its name, others get __<base>."""
    r = F.row_number().over(Window.partitionBy(*keys, name).orderBy(F.desc(size), base))
    return df.withColumn("unique_name", F.when(r > 1, F.concat(F.col(name), F.lit("__"), F.col(base))).otherwise(F.col(name)))


def pair_queue(candidates: list[DataFrame], dust: DataFrame, decided: DataFrame, cross: bool | None = None) -> DataFrame:
    """Undecided candidate pairs (a, b, sim, cross) without dust actors; most similar first."""
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), candidates)
    if cross is not None:
        out = out.filter(F.col("cross") == cross)
    for side in ("a", "b"):
        out = out.join(dust.select(F.col("actor").alias(side)), side, "left_anti")
    return out.join(decided.select("a", "b"), ["a", "b"], "left_anti").orderBy(F.desc("sim"), "a", "b")


def class_order(summary: DataFrame, by: str, regions: list[str], thin: int = 2) -> DataFrame:
    """Controls by hours, then the regions by hours; classes of few channels are marked."""
    region = F.col(by).isin(*regions)
    rank = F.row_number().over(Window.orderBy(region.cast("int"), F.round("hours", 9), by))
    return summary.withColumns({"place": rank, "thin": F.col("channels") <= thin})


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; missing columns are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def leakage(df: DataFrame, key: str, split: str = "split", limit: float = 0.05) -> DataFrame:
    """One row: test keys that are also in train, their share, and whether it is over the limit."""
    test, train = (df.filter(F.col(split) == s).select(key).distinct() for s in ("test", "train"))
    n = test.join(train.withColumn("_t", F.lit(1)), key, "left").agg(F.count("*").alias("test"), F.count("_t").alias("leaked"))
    return n.withColumn("share", F.when(F.col("test") > 0, F.col("leaked") / F.col("test")).otherwise(0.0)).withColumn("over", F.col("share") > limit)


def overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that are in more than one split."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def harvest_status(df: DataFrame, seen_ids: DataFrame, seen_hashes: DataFrame, most_seconds: float) -> DataFrame:
    """New recordings (id, hash, order, seconds): dup_id, too_long, dup_audio or downloaded."""
    known = df.join(seen_ids.select("id").distinct().withColumn("_i", F.lit(1)), "id", "left").join(seen_hashes.select("hash").distinct().withColumn("_h", F.lit(1)), "hash", "left")
    again = F.row_number().over(Window.partitionBy("id").orderBy("order")) > 1
    first = known.withColumn("status", F.when(F.col("_i").isNotNull() | again, "dup_id").when(F.col("seconds") > most_seconds, "too_long"))
    same = F.row_number().over(Window.partitionBy("hash", F.col("status").isNull()).orderBy("order")) > 1
    return first.withColumn("status", F.coalesce("status", F.when(F.col("_h").isNotNull() | same, "dup_audio"), F.lit("downloaded"))).drop("_i", "_h")


def purge(df: DataFrame, ids: DataFrame | None = None, prefix: str | None = None, show: str | None = None) -> DataFrame:
    if ids is not None:
        df = df.join(ids.select("id"), "id", "left_anti")
    if prefix is not None:
        df = df.filter(~F.coalesce(F.col("path").startswith(prefix), F.lit(False)))
    if show is not None:
        df = df.filter(F.coalesce(F.col("show") != show, F.lit(True)))
    return df


def tranches(**frames: DataFrame) -> DataFrame:
    return union_all(*[f.withColumn("tranche", F.lit(k)) for k, f in frames.items()])


def channel_overlap(df: DataFrame, channel: str, speaker: str, split: str = "split") -> DataFrame:
    """One row: shares of test segments and speakers whose channel is also in train."""
    train = df.filter(F.col(split) == "train").select(channel).distinct().withColumn("_t", F.lit(1))
    test = df.filter(F.col(split) == "test").join(train, channel, "left")
    return test.agg(F.avg(F.col("_t").isNotNull().cast("double")).alias("segment_share"), (F.countDistinct(F.when(F.col("_t").isNotNull(), F.col(speaker))) / F.countDistinct(speaker)).alias("speaker_share"))


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias("place")).orderBy("place")
