"""Scalar column functions: texts, names, paths, urls and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.config import BLANK_TEXTS, TRUE_TEXTS


def truthy(c: Column) -> Column:
    """Text or boolean to boolean; anything unknown, null included, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def blank(c: Column) -> Column:
    """Is a text null, empty or a spelling of "nothing"?"""
    return F.coalesce(F.lower(F.trim(c)).isin(*BLANK_TEXTS), F.lit(True))


def sanitize(c: Column) -> Column:
    """Safe for a pipe-delimited cell: no pipes, line breaks or doubled quotes, trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "|\n\r\t", "/   "), '"{2,}', '"'))


def normalize_name(c: Column) -> Column:
    """Lower case, Latin and Arabic letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z؀-ۿ]+", " "))


def normalize_title(c: Column) -> Column:
    """A title as file names spell it: full-width bars and underscores are spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "｜_|", "   ")), "\\s+", " "))


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal titles, 0 for nothing in common (edit distance over the longer one)."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def stable_id(c: Column) -> Column:
    """First 12 hex digits of SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


def playlist_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "[?&]list=([^&#]+)", 1), F.lit(""))


def channel_url(c: Column) -> Column:
    return F.when(c.startswith("UC"), F.concat(F.lit("https://www.youtube.com/channel/"), c)).otherwise(F.concat(F.lit("https://www.youtube.com/@"), F.regexp_replace(c, "^@+", "")))


def playlist_url(c: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/playlist?list="), c)


def stem(path: Column) -> Column:
    """File name without folders (either separator) and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def forward_slashes(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^(\\./)+", "")


def year_month(date: Column) -> Column:
    """YYYYMMDD as YYYY-MM; null when not 8 digits."""
    return F.when(valid_date(date), F.concat(F.substring(date, 1, 4), F.lit("-"), F.substring(date, 5, 2)))


def day(date: Column) -> Column:
    return F.when(valid_date(date), F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2)))


def period(first: Column, last: Column) -> Column:
    a, b = year_month(first), year_month(last)
    return F.when(a == b, a).otherwise(F.concat_ws(" → ", a, b))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), (whole % 60).cast("long"))


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{8}$"), F.lit(False))


def valid_id(c: Column) -> Column:
    return ~blank(c) & (F.lower(F.trim(c)) != "unknown")


def actor_uid(region: Column, playlist: Column, actor: Column) -> Column:
    return F.concat(region, F.lit("/"), playlist, F.lit("#"), actor.cast("string"))


def region_of_uid(uid: Column) -> Column:
    return F.split(uid, "/")[0]


def bag_folder(channel: Column, basename: Column) -> Column:
    """Key of a folder of loose files: its channel unless that is a placeholder."""
    return F.when(F.coalesce(F.lower(F.trim(channel)).isin("", "unknown", "na", "none"), F.lit(True)), basename).otherwise(channel)
