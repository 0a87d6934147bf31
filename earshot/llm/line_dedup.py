"""Line dedup by content-defined chunks and by runs of whole lines (DataFrame functions only).

A rolling hash over the hashes of two neighbouring lines ends a chunk where it is 0 modulo EVERY; lines of LONG words
or more stand alone. Boundaries so depend on nearby lines only and come back wherever a passage is repeated. Of equal
chunks (of two lines or more, or of LONG words) the first place (smallest key, then line) stays, the others go.

Chunks miss passages whose neighbours differ, so runs are compared too: for every line with words the shortest run of
whole lines from it, and the shortest run up to it, that has LONG words. A passage of LONG words or more that comes
again in whole lines is covered by such runs on all its lines, and each of them comes again; so all lines of the
later places go, whatever surrounds them. Runs that overlap the first place in its own document stay. Every line
that goes has an equal line at an earlier place, and the first stays.

Chunks and runs are spans of lines. One pass over all texts hashes lines and stores each row's spans (start, end and a
hash of the hashes of its lines); hashes that occur twice are counted from that table. Only texts with such a
span are read again, for the SHA-256 of the bytes of their spans, by which spans are compared; only texts that lose
lines are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm import blooms
from earshot.session import forget, stored

EVERY = 3
LONG = 50
LEAST_WORDS = 1
WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 64
CHUNK, RUN = 0, 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _span_hash(hashes: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.xxhash64(F.slice(hashes, start, end - start + 1), kind)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: the optimiser may put a column's expression inside the functions that use it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """Running sums, appended one by one."""
    return F.aggregate(values, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))


def _with_running(df: DataFrame, of: str, name: str) -> DataFrame:
    """df with the running sums of an array of ints, by blocks: appending costs a copy of what is there."""
    df = df.withColumn("_b", F.transform(F.sequence(F.lit(1), F.greatest(F.size(of), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(of, i, BLOCK)))
    sums = F.transform("_b", lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    before = _let(sums, lambda x: F.zip_with(_running(x), x, lambda t, own: t - own))
    each = F.zip_with("_b", before, lambda b, t: F.transform(_running(b), lambda x: x + t))
    return df.withColumn(name, F.flatten(each)).drop("_b")


def with_spans(df: DataFrame, text: str, every: int = EVERY, long: int = LONG, least_words: int = LEAST_WORDS, digest: bool = False) -> DataFrame:
    """df without `text`, with _s: array<struct<kind, start, end, h[, d]>>, the spans of its lines (numbered from 1) that count.

    d is the SHA-256 of a span's bytes. The work is in proportion to words and spans: _at has the line of every word.
    """
    own = [c for c in df.columns if c != text]
    df = df.withColumn("_lines", _lines(F.col(text))).drop(text)
    df = df.withColumns({"_h": F.transform("_lines", _line_hash), "_w": F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORDS)))})
    df = _with_running(df, "_w", "_c")
    df = df.withColumns({"_at": F.flatten(F.transform("_w", lambda w, i: F.array_repeat(i + 1, w))), "_all": F.sequence(F.lit(1), F.size("_w"))})

    def pair(start: Column, end: Column) -> Column:
        return start.cast("long") * (1 << 32) + end

    def parts(x: Column) -> tuple[Column, Column]:
        return F.floor(x / F.lit(1 << 32)).cast("int"), (x % (1 << 32)).cast("int")

    def ends(h: Column, w: Column, i: Column) -> Column:
        roll = (F.coalesce(F.get(h, i - 2), F.lit(0)) % 1_000_003 * 31 + F.get(h, i - 1) % 1_000_003) % 1_000_003
        return (roll % every == 0) | (F.get(w, i - 1) >= long) | (F.coalesce(F.get(w, i), F.lit(0)) >= long) | (i == F.size(w))

    def words(c: Column, i: Column) -> Column:
        return F.coalesce(F.get(c, i - 1), F.lit(0))

    def counts(c: Column, x: Column) -> Column:
        start, end = parts(x)
        n = words(c, end) - words(c, start - 1)
        return (n >= least_words) & ((end > start) | (n >= long))

    def span(kind: int, h: Column, lines: Column, x: Column) -> Column:
        start, end = parts(x)
        found = [F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), _span_hash(h, start, end, F.lit(kind)).alias("h")]
        if digest:
            found.append(F.unhex(F.sha2(F.array_join(F.slice(lines, start, end - start + 1), "\n").cast("binary"), 256)).alias("d"))
        return F.struct(*found)

    def spans(kind: int, pairs: Column) -> Column:
        lines = F.col("_lines") if digest else F.lit(None)
        return _let(F.col("_h"), lambda h: _let(lines, lambda x: F.transform(pairs, lambda p: span(kind, h, x, p))))

    last = _let(F.col("_h"), lambda h: _let(F.col("_w"), lambda w: F.filter("_all", lambda i: ends(h, w, i))))
    df = df.withColumn("_k", _let(last, lambda e: F.transform(e, lambda i, k: pair(F.coalesce(F.get(e, k - 1), F.lit(0)) + 1, i))))
    with_words = _let(F.col("_w"), lambda w: F.filter("_all", lambda i: F.get(w, i - 1) > 0))
    df = df.withColumns({"_k": _let(F.col("_c"), lambda c: F.filter("_k", lambda x: counts(c, x))), "_n": with_words})

    def runs(c: Column, at: Column) -> Column:
        from_each = F.transform("_n", lambda i: pair(i, F.get(at, words(c, i - 1) + long - 1)))
        up_to_each = F.transform("_n", lambda i: pair(F.get(at, words(c, i) - long), i))
        return F.array_distinct(F.filter(F.concat(from_each, up_to_each), lambda x: x.isNotNull()))

    df = df.withColumn("_r", _let(F.col("_c"), lambda c: _let(F.col("_at"), lambda at: runs(c, at))))
    return df.withColumn("_s", F.concat(spans(CHUNK, F.col("_k")), spans(RUN, F.col("_r")))).select(*own, "_s")


def _repeated(docs: DataFrame, key: str, text: str, every: int, long: int, least_words: int) -> DataFrame:
    """(_l_key, _l_spans array<struct<kind, start, end, h>>): for each key that loses lines, the spans that go."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # stored as they are: a filter or an explosion above the spans would make the optimiser compute them again and again
    spans = stored(with_spans(rows, "_text", every, long, least_words), "spans")
    each = spans.select("_key", F.explode("_s.h").alias("h"))
    again = stored(each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "again")
    blocks = blooms.n_blocks(again.count())
    bits = stored(blooms.repeated_bits(again, "h", blocks, least=1), "bits")
    keys = stored(blooms.flag_repeated(each, "h", bits, blocks, "_again").filter("_again").select(F.xxhash64("_key").alias("k")).distinct(), "keys")
    some = blooms.with_key(rows, "_key", keys, "k")
    some = stored(with_spans(some, "_text", every, long, least_words, digest=True), "digests")
    maybe = some.select("_key", F.explode("_s").alias("s")).select("_key", "s.*")
    maybe = stored(blooms.flag_repeated(maybe, "h", bits, blocks, "_again").filter("_again").drop("_again"), "maybe")
    one = F.struct("kind", "start", "end", "h")
    # of equal chunks the first place stays
    chunks = maybe.filter(F.col("kind") == CHUNK)
    stay = chunks.groupBy("d").agg(F.min(F.struct("_key", "start", "end", "h")).alias("s")).select("s.*")
    gone = chunks.filter("_key IS NOT NULL").join(stay, ["_key", "start", "end", "h"], "left_anti").select("_key", one.alias("s"))
    # of equal runs those stay that overlap the first one of the smallest key
    runs = maybe.filter(F.col("kind") == RUN)
    first = runs.groupBy("d").agg(F.min(F.struct("_key")).alias("s")).select("d", F.col("s._key").alias("_key"), F.lit(True).alias("first"))
    here = runs.filter("_key IS NOT NULL").groupBy("d", "_key").agg(F.min("start").alias("s0"), F.collect_set(one).alias("at"))
    beyond = F.filter("at", lambda x: x["start"] * 2 - x["end"] > F.col("s0"))
    gone = gone.unionByName(here.join(first, ["d", "_key"], "left").select("_key", F.explode(F.when(F.col("first"), beyond).otherwise(F.col("at"))).alias("s")))
    removed = stored(gone.groupBy("_key").agg(F.collect_set("s").alias("_l_spans")).withColumnRenamed("_key", "_l_key"), "removed")
    forget(spans, again, bits, keys, some, maybe)
    return removed


def _cut(docs: DataFrame, key: str, text: str, every: int, long: int, least_words: int) -> DataFrame:
    """docs with `text` shortened, and _l_gone (chunks) and _l_lines."""
    gone = _repeated(docs, key, text, every, long, least_words)
    rows = blooms.flag_keys(docs, key, gone, "_l_key", "_l_some")
    nothing = {"_l_gone": F.lit(0), "_l_lines": F.lit(0)}
    whole = rows.filter("not _l_some").drop("_l_some").withColumns(nothing)
    rest = rows.filter("_l_some").drop("_l_some").join(gone, F.col(key) == F.col("_l_key"), "left").drop("_l_key")
    rest = rest.withColumn("_l_text", F.when(F.col("_l_spans").isNotNull(), _lines(F.col(text)))).withColumn("_l_h", F.transform("_l_text", _line_hash))
    # rows that repeat a key may have other lines
    own = _let(F.col("_l_h"), lambda h: F.filter("_l_spans", lambda s: (s["end"] <= F.size(h)) & (_span_hash(h, s["start"], s["end"], s["kind"]) == s["h"])))
    rest = rest.withColumn("_l_spans", own)
    rest = rest.withColumn("_l_kept", F.array_except(F.sequence(F.lit(1), F.size("_l_text")), F.flatten(F.transform("_l_spans", lambda s: F.sequence(s["start"], s["end"])))))
    rest = rest.withColumns(
        {
            text: F.when(F.size("_l_spans") > 0, F.array_join(_let(F.col("_l_text"), lambda x: F.transform("_l_kept", lambda i: F.get(x, i - 1))), "\n")).otherwise(F.col(text)),
            "_l_gone": F.coalesce(F.size(F.filter("_l_spans", lambda s: s["kind"] == CHUNK)), F.lit(0)),
            "_l_lines": F.coalesce(F.size("_l_text") - F.size("_l_kept"), F.lit(0)),
        }
    )
    return whole.unionByName(rest.select(*whole.columns))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, long: int = LONG, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with `text` shortened, and removed_chunks and removed_lines (which replace columns of these names); all rows stay.

    A chunk counts if it has least_words words and two lines, or `long` words; a run of whole lines if it has `long`
    words. removed_chunks counts repeated chunks, removed_lines all lines that go, with repeated chunks or runs. Null
    text stays null. Rows with a null key keep their text; rows that repeat both key and text are cut alike. A text
    of which every line goes becomes empty. An empty table gives no rows. Long texts are taken whole; time grows faster than their lines.
    """
    out = _cut(docs, key, text, every, long, least_words).drop("removed_chunks", "removed_lines")
    return out.withColumnsRenamed({"_l_gone": "removed_chunks", "_l_lines": "removed_lines"})


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated chunks and runs cut, without the rows of which no words are left; texts that had nothing to cut stay.

    Rows with a null key keep their text; rows that repeat both key and text are cut alike; an empty table gives no rows.
    """
    out = _cut(docs, key, text, EVERY, LONG, LEAST_WORDS)
    return out.filter((F.col("_l_lines") == 0) | (F.regexp_count(F.col(text), F.lit(WORDS)) > 0)).select(*docs.columns)


ORACLE_SQL = f"""
WITH u AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
m AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM u),
b AS (SELECT *, sum(w) OVER d AS c, ((coalesce(lag(h) OVER d, 0) % 1000003 * 31 + h % 1000003) % 1000003) % {EVERY} = 0
             OR w >= {LONG} OR coalesce(lead(w) OVER d, 0) >= {LONG} OR lead(i) OVER d IS NULL AS ends
      FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM b),
chunks AS (SELECT doc_id, min(i) AS s, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS span FROM k GROUP BY doc_id, no
           HAVING sum(w) >= {LEAST_WORDS} AND (count(*) >= 2 OR sum(w) >= {LONG})),
gone_chunks AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, s) AS r FROM chunks) WHERE r > 1),
spans AS (SELECT x.doc_id, x.i AS s, y.i AS e FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.w > 0 AND y.c >= x.c - x.w + {LONG} AND y.c - y.w < x.c - x.w + {LONG}
          UNION SELECT y.doc_id, x.i, y.i FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.w > 0 AND y.c >= {LONG} AND x.c > y.c - {LONG} AND x.c - x.w <= y.c - {LONG}),
runs AS (SELECT spans.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS span FROM spans JOIN u ON u.doc_id = spans.doc_id AND i BETWEEN s AND e GROUP BY spans.doc_id, s, e),
gone_runs AS (SELECT doc_id, s, e FROM (SELECT *, min(doc_id) OVER (PARTITION BY span) AS d0, min(s) OVER (PARTITION BY span, doc_id) AS s0 FROM runs) WHERE doc_id <> d0 OR 2 * s - e > s0),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS i FROM (SELECT * FROM gone_chunks UNION ALL SELECT * FROM gone_runs)),
n AS (SELECT doc_id, count(*) AS n FROM gone_chunks GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(line, chr(10) ORDER BY u.i) FILTER (WHERE gone.i IS NULL) AS text, count(gone.i) AS lines
         FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
SELECT kept.doc_id, coalesce(text, '') AS text, coalesce(n, 0)::INT AS removed_chunks, lines::INT AS removed_lines FROM kept LEFT JOIN n USING (doc_id)
"""
