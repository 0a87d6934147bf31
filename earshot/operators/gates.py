"""Filters, gates and row-level updates of the segment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import config as C
from earshot.functions.text import blank, truthy


def rule_flags(music=C.MUSIC_REJECT_PROB, speech=C.SPEECH_KEEP_PROB, ratio=C.MIN_SPEECH_RATIO, snr=C.SNR_REJECT_FLOOR_DB) -> dict[str, Column]:
    """The gates in order of priority. A missing score never excludes."""
    return {
        "music": (F.coalesce("music_prob", F.lit(0.0)) >= music) & (F.coalesce("panns_speech_prob", F.lit(1.0)) < speech),
        "low_speech": F.coalesce("speech_ratio", F.lit(1.0)) < ratio,
        "low_snr": F.coalesce("snr_db", F.lit(99.0)) < snr,
    }


def first_reason(flags: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, flag in reversed(flags.items()):
        out = F.when(flag, F.lit(name)).otherwise(out)
    return out


def content_gates(df: DataFrame, **thresholds) -> DataFrame:
    """Set is_excluded where any gate fires; blank reasons take the first that does."""
    flags = rule_flags(**thresholds)
    hit = flags["music"] | flags["low_speech"] | flags["low_snr"]
    reason = F.when(blank(F.col("exclude_reason")), first_reason(flags, F.coalesce("exclude_reason", F.lit("")))).otherwise(F.col("exclude_reason"))
    return df.withColumns({"exclude_reason": reason, "is_excluded": truthy(F.col("is_excluded")) | hit})


def fill_reasons(df: DataFrame, default: str = "mad_outlier", **thresholds) -> DataFrame:
    """Excluded rows with a blank reason get one, in the gates' order."""
    needs = truthy(F.col("is_excluded")) & blank(F.col("exclude_reason"))
    return df.withColumn("exclude_reason", F.when(needs, first_reason(rule_flags(**thresholds), F.lit(default))).otherwise(F.coalesce("exclude_reason", F.lit(""))))


def repair_reasons(df: DataFrame) -> DataFrame:
    """Kept rows never carry a reason."""
    return df.withColumn("exclude_reason", F.when(~truthy(F.col("is_excluded")), F.lit("")).otherwise(F.coalesce("exclude_reason", F.lit(""))))


def repair_ids(df: DataFrame, fixes: DataFrame, true_ids: DataFrame, key: str = "file_id") -> DataFrame:
    """Replace mangled ids (fixes: bad, good) where the good id is a true one (true_ids: key)."""
    usable = fixes.join(true_ids.select(F.col(key).alias("good")).distinct(), "good", "left_semi")
    return df.join(usable, F.col(key) == F.col("bad"), "left").withColumn(key, F.coalesce("good", key)).drop("bad", "good")


def quality_flag(snr: Column, floor: float = C.SNR_CLEAN_DB) -> Column:
    return F.when(snr >= floor, "clean").otherwise("noisy")


def empty_slices(df: DataFrame, length: Column) -> DataFrame:
    """Exclude segments that begin at or after the end of their file."""
    empty = F.coalesce(F.col("start_time") >= length, F.lit(False))
    return df.withColumns({"exclude_reason": F.when(empty, C.EOF_REASON).otherwise(F.coalesce("exclude_reason", F.lit(""))), "is_excluded": truthy(F.col("is_excluded")) | empty})


def active(df: DataFrame) -> DataFrame:
    return df.filter(~truthy(F.col("is_excluded")) & (F.col("global_actor") >= 0))


def kept(df: DataFrame, tiers=C.KEEP_TIERS) -> DataFrame:
    return active(df).filter(F.col("tier").isin(*tiers))


def reviewed(df: DataFrame) -> DataFrame:
    return df.filter(truthy(F.col("verified_keep")) & ~truthy(F.col("is_excluded")))


def controls(df: DataFrame, macro: str = "Control", renames: dict | None = None, tiers=C.KEEP_TIERS) -> DataFrame:
    return kept(df.filter(F.col("macro_class") == macro), tiers).withColumnsRenamed(renames or {})


def canonical(name: Column, aliases: dict[str, str], known: list[str], special: dict[str, str] | None = None) -> Column:
    """Alias, else a known name spelled in any case, else a special case, else title case."""
    key = F.lower(F.trim(F.translate(name, "_-", "  ")))
    out = F.initcap(key)
    for k, v in {**(special or {}), **{k.lower(): k for k in known}, **{k.lower(): v for k, v in aliases.items()}}.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def macro_class(name: Column, spellings: tuple[str, ...] = ("controls", "control", "nontarget"), inside: str = "Control", outside: str = "Target") -> Column:
    """`inside` if the letters of a folder's name are one of the spellings in any case, else `outside`."""
    return F.when(F.lower(F.regexp_replace(name, "[^A-Za-z]", "")).isin(*[x.lower() for x in spellings]), inside).otherwise(outside)


def registry_rows(df: DataFrame, region: str | None = None, only_approved: bool = False) -> DataFrame:
    """Usable registry rows: a url that is not a comment, defaults filled in, optional region and status."""
    out = df.filter(~blank(F.col("url")) & ~F.trim(F.col("url")).startswith("#"))
    if region is not None:
        out = out.filter(F.lower(F.trim("region")) == region.lower())
    if only_approved:
        out = out.filter(F.lower(F.trim("status")) == "approved")
    name, show = F.nullif(F.trim("source"), F.lit("")), F.nullif(F.trim("show"), F.lit(""))
    return out.withColumns({"source": F.coalesce(name, show), "show": F.coalesce(show, name), "lang_flag": F.coalesce(F.nullif(F.trim("lang_flag"), F.lit("")), F.lit("arabic"))})


def pick_resources(df: DataFrame, contains: str | None = None, region: str | None = None, limit: int | None = None) -> DataFrame:
    if contains:
        df = df.filter(F.lower("playlist").contains(contains.lower()))
    if region:
        df = df.filter(F.lower("region") == region.lower())
    return df.orderBy("region", "playlist").limit(limit) if limit else df


def any_of(df: DataFrame, **allowed) -> DataFrame:
    """Rows whose columns have one of the allowed values; None or empty allows all."""
    for c, values in allowed.items():
        if values:
            df = df.filter(F.col(c).isin(*values))
    return df


def text_search(df: DataFrame, pattern: str, columns: list[str], newest: str) -> DataFrame:
    """Rows in which any column contains the text, in any case; newest first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(pattern.lower()), F.lit(False))
    return df.filter(hit).orderBy(F.desc(newest))


def platform(*names: Column) -> Column:
    return F.when(F.lower(F.concat_ws(" ", *names)).contains("tiktok"), "TikTok").otherwise("YouTube")


def migrate_decisions(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Old categories become (decision, reason); unmapped ones are pending and named in the notes."""
    old = F.col("category")
    known = old.isin(*mapping)
    decision, reason = F.lit("pending"), F.lit("")
    for k, (d, r) in mapping.items():
        decision, reason = F.when(old == k, d).otherwise(decision), F.when(old == k, r).otherwise(reason)
    notes = F.when(known | blank(old), F.coalesce("notes", F.lit(""))).otherwise(F.trim(F.concat_ws(" ", F.nullif(F.col("notes"), F.lit("")), F.concat(F.lit("[was: "), old, F.lit("]")))))
    return df.withColumns({"decision": decision, "reason": reason, "notes": notes}).drop("category")


def not_junk_title(c: Column, junk=("uploads", "videos", "shorts", "live", "popular uploads", "liked videos", "favorites")) -> Column:
    """Feeds are not shows; a blank title passes."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*junk), F.lit(True))


def show_playlist(c: Column) -> Column:
    return F.coalesce(c.rlike("^(PL|OLAK5uy_)"), F.lit(False))


def probe_eligible(df: DataFrame, margin: float = 0.30) -> DataFrame:
    return df.filter(F.col("label").isin("male", "female") & (F.abs(F.col("p_female") - F.col("p_male")) >= margin))


def blind(df: DataFrame, columns: list[str], order: str = "serve_order") -> DataFrame:
    """Only columns that carry no label, in serving order."""
    return df.select(*columns).orderBy(order)


def gate_risk(music: Column, ratio: Column, speech: Column, snr: Column) -> dict[str, Column]:
    """Risk components, one less each probability (0.5 when missing), and the largest."""
    parts = {"music": F.coalesce(music, F.lit(0.5)), "ratio": F.coalesce(1 - ratio, F.lit(0.5)), "speech": F.coalesce(1 - speech, F.lit(0.5)), "snr": F.coalesce(1 - F.least(snr / 30, F.lit(1.0)), F.lit(0.5))}
    return {f"risk_{k}": v for k, v in parts.items()} | {"risk": F.greatest(*parts.values())}


def first_present(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of the names that df has as a column."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} in {df.columns}")


def speaker_column(df: DataFrame, own: str | None = None) -> str:
    return own or first_present(df, ("speaker_final", "actor_uid", "global_actor", "speaker_id", "speaker"))


def class_column(df: DataFrame, own: str | None = None) -> str:
    return own or first_present(df, ("final_dialect", "sub_cat", "region"))


def score_bands(df: DataFrame, keys: list[str], metrics: dict[str, tuple[bool, float, float]]) -> DataFrame:
    """(keys, metric, value, band): metrics are (is higher better, good from, warn from); null values have no band."""
    long = df.unpivot(keys, list(metrics), "metric", "value")
    band = F.lit(None).cast("string")
    for m, (higher, good, warn) in metrics.items():
        v = F.col("value")
        own = F.when(v >= good, "good").when(v >= warn, "warn").otherwise("bad") if higher else F.when(v <= good, "good").when(v <= warn, "warn").otherwise("bad")
        band = F.when((F.col("metric") == m) & v.isNotNull(), own).otherwise(band)
    return long.withColumn("band", band)


def needs_fill(df: DataFrame, status: str | None = None, refresh: bool = False) -> DataFrame:
    """Registry rows with blank counts: channels need both counts, playlists one; blank source names too."""
    out = df if status is None else df.filter(F.col("status") == status)
    channel = F.col("url_type") == "channel"
    missing = (channel & (blank(F.col("n_playlists")) | blank(F.col("n_videos")))) | (~channel & blank(F.col("n_videos"))) | blank(F.col("source"))
    return out if refresh else out.filter(missing)


def readiness(df: DataFrame, key: str = "playlist", flag: str = "has_turns") -> DataFrame:
    """(key, episodes, ready): are all episodes of a playlist diarised?"""
    return df.groupBy(key).agg(F.count("*").alias("episodes"), F.bool_and(F.coalesce(flag, F.lit(False))).alias("ready"))


def with_score(df: DataFrame, name: str, scorer=None, *columns: str) -> DataFrame:
    """A score column: null, or a scalar pandas scorer over the columns."""
    if scorer is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, F.pandas_udf(scorer, "double")(*columns))
