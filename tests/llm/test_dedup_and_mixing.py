import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from earshot.llm import blooms, exact_dedup, line_dedup, mixing, url_filter

CLASH = "doc_id long, text string, keep_id string, _h int, size int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], CLASH)


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (3, "a"), (8, "long " * 50_000), (9, "long " * 50_000)] + [(100 + i, "copy") for i in range(300)]
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    want = Counter((k, max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert got == want
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_bloom_never_misses_a_repeat(spark):
    h = spark.range(5000).select(F.xxhash64(F.col("id") % 4000).alias("h"))
    bits = blooms.repeated_bits(h, "h", 1)
    flagged = blooms.flag_repeated(h, "h", bits, 1, "again")
    n = flagged.groupBy("h").agg(F.count("*").alias("n"), F.bool_and("again").alias("again"))
    assert n.filter("n > 1 AND NOT again").count() == 0 and n.filter("n = 1 AND again").count() < 1500


LINE = " ".join(f"word{i}" for i in range(60))
BLOCK = "\n".join(" ".join(f"{c}{i}" for i in range(12)) for c in "abcdefgh")


def test_line_dedup(spark):
    own = ["\n".join(f"own{d} line{i} " + " ".join(f"x{d}_{i}_{j}" for j in range(8)) for i in range(6)) for d in range(6)]
    rows = [(1, own[0] + "\n" + LINE), (2, own[1] + "\n" + LINE + "\n" + own[2]), (3, own[3] + "\n" + BLOCK), (4, BLOCK + "\n" + own[4]), (5, None), (6, ""), (7, LINE), (None, LINE), (8, own[5])]
    df = spark.createDataFrame([(k, t, "r", 1) for k, t in rows], "doc_id long, text string, removed string, n_chunks int")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df.drop("n_chunks")).collect()}
    assert got[None].text == LINE and got[8].text == own[5] and got[5].text is None and got[6].text == ""
    assert sum(LINE in (got[k].text or "") for k in (1, 2, 7)) == 0  # the row without a key holds the first place
    assert got[2].text == own[1] + "\n" + own[2] and got[7].text == ""
    assert got[3].text == rows[2][1] and got[4].removed_lines >= 3 and own[4] in got[4].text
    kept = line_dedup.without_repeats(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 8, None}
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def brute_runs(docs, long=50):
    """{key: line numbers that are in a run of whole lines with `long` words which comes earlier, without overlap}."""
    seen, gone = {}, defaultdict(set)
    for k, t in sorted(docs):
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) >= long and lines[a].split() and lines[b].split():
                    k0, a0 = seen.setdefault("\n".join(lines[a : b + 1]), (k, a))
                    if (k0, a0) != (k, a) and (k0 != k or a0 + b - a < a):
                        gone[k] |= set(range(a, b + 1))
    return gone


def test_runs_of_whole_lines_go_among_other_neighbours(spark):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    docs, k = [], 0
    for lines, per in [(3, 18), (4, 15), (5, 11), (6, 10), (10, 6)]:
        for r in range(8):
            passage = "\n".join(words(f"p{lines}x{r}y{i}_", per) for i in range(lines))
            for end in "ab":
                docs.append((k := k + 1, f"{words(f'o{k}', 7)}\n{passage}\n{words(f'q{k}', 9)}\n\nlast {end} {k}"))
    docs += [(k + 1, "\n".join(["again and again"] * 60)), (k + 2, "\n".join(["one", "", "two three"] * 40))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = brute_runs(docs)
    assert len(gone) == 42
    for k, t in docs[:-2]:
        assert got[k].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])
        assert got[k].removed_lines == len(gone[k])
    for k, t in docs[-2:]:
        assert gone[k] and not {x for i, x in enumerate(t.split("\n")) if i not in gone[k]} - set(got[k].text.split("\n"))
        assert got[k].removed_lines >= len(gone[k])


def brute_spans(text, every=3, long=50, least=1):
    """{(kind, first line, last line)} by the stated rules."""
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % 1_000_003 for x in lines]
    w = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    out, start = set(), 0
    for i in range(len(lines)):
        if ((h[i - 1] if i else 0) * 31 + h[i]) % 1_000_003 % every == 0 or w[i] >= long or i + 1 == len(lines) or w[i + 1] >= long:
            words = sum(w[start : i + 1])
            if words >= least and (i > start or words >= long):
                out.add((0, start + 1, i + 1))
            start = i + 1
    for i in (i for i in range(len(lines)) if w[i]):
        out |= {(1, i + 1, j + 1) for j in range(i, len(lines)) if sum(w[i : j + 1]) >= long > sum(w[i:j])}
        out |= {(1, j + 1, i + 1) for j in range(i + 1) if sum(w[j : i + 1]) >= long > sum(w[j + 1 : i + 1])}
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["", "\n", "a\n\nb", LINE, BLOCK + "\n" + LINE + "\n\n" + BLOCK, None, " \t\n x\u00a0y z"]
    texts += ["\n".join(" ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 5, 12, 49, 50]))) for _ in range(rng.randint(1, 200))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: [(s.kind, s.start, s.end) for s in r["_s"]] for r in line_dedup.with_spans(df, "t").collect()}
    for k, t in enumerate(texts):
        assert len(got[k]) == len(set(got[k])) and set(got[k]) == brute_spans(t), k
    digests = {(r.k, s.kind, s.start, s.end): s.d for r in line_dedup.with_spans(df, "t", digest=True).collect() for s in r["_s"]}
    assert all(d == hashlib.sha256("\n".join(texts[k].split("\n")[a - 1 : b]).encode()).digest() for (k, _, a, b), d in digests.items())


def test_keys_that_repeat_are_cut_by_their_own_lines(spark):
    rows = [(1, BLOCK), (2, BLOCK + "\nend of two"), (2, "other text\nof two"), (None, "x"), (2, BLOCK + "\nend of two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in line_dedup.line_dedup(df).collect()))
    assert got == [(0, "x"), (1, BLOCK), (2, "end of two"), (2, "end of two"), (2, "other text\nof two")]


def test_rules_and_parts_of_urls(spark):
    cases = {
        "http://A.Example.com/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "https://com/en/1": ("com", "/en/1", "com/en/", "block"),
        "x://shop.net/de/8": ("shop.net", "/de/8", "net/de/", "allow"), "x://www.example.net/de/81": ("www.example.net", "/de/81", "example.net/de/8", "block"),
        "ftp://org/es/": ("org", "/es/", "org/es/", "block"), "x://forg/es/": ("forg", "/es/", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None),
        "a://b?x=/en/": ("b", "", None, None), "a://b.com#/en/": ("b.com", "", None, None),
        "http://a.com?u=http://b.com/en/x": ("a.com", "", None, None), "http://shop.com#x://evil.com/en/y": ("shop.com", "", None, None), "://com/en/": ("com", "/en/", "com/en/", "block"),
        "x://": ("", "", None, None), "": ("", "", None, None), "k://COM/en/" + "y" * 100_000: ("com", "/en/" + "y" * 100_000, "com/en/", "block"), "k://com/EN/": ("com", "/EN/", None, None),
        "x://y\nz/en/": ("y\nz", "/en/", None, None),
    }
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (u, (host, path, rule, verdict)) in enumerate(cases.items()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_trees_learn_from_ruled_urls(spark):
    rows = [(i, f"https://h{i % 9}.{'bad' if i % 2 else 'good'}.com/{'en' if i % 2 else 'en/7'}/{i}") for i in range(400)]
    rows = [(i, u.replace(".good.com/en/7", ".example.com/en/7")) for i, u in rows] + [(1000, "https://q.bad.com/fr/3")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000].rule is None and got[1000].verdict == "block" and got[1000].block_probability > 0.5


def test_rare_suffixes_keep_their_rates(spark, monkeypatch):
    rows = [(i, f"https://h{i % 7}.{'bad' if i % 2 else 'good'}{i % 5}.com/{'en' if i % 2 else 'en/7'}/{i}") for i in range(400)]
    pages = spark.createDataFrame([(i, u.replace(".com/en/7", ".example.com/en/7")) for i, u in rows], "page_id long, url string")
    want = sorted(map(tuple, url_filter.judge(pages).collect()))
    labelled = pages.select(url_filter.host_of(F.col("url")).alias("host"), (F.col("page_id") % 2).cast("double").alias("label"), (F.col("page_id") % 5).alias("_fold"))
    monkeypatch.setattr(url_filter, "SUFFIXES", 2)
    rates = url_filter._rates(url_filter._counts(labelled, 3), 3)
    assert rates.count() > 2
    common, rare = url_filter._parted(rates, 3)
    got = url_filter._with_rate(labelled.withColumns({"url": F.col("host"), "path": F.lit("")}), 3, common, rare)
    assert got.count() == 400 and not got.filter("suffix3 IS NULL OR (suffix3 > 0.5) <> (label = 1)").count()
    assert sorted(map(tuple, url_filter.judge(pages).collect())) == want


def brute_parts(url):
    """(host, path, rule) as the contract words them."""
    url = url or ""
    at = url.find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for _, rule in url_filter.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def test_parts_and_rules_of_all_pages_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    rng = random.Random(8)
    odd = [(10**6 + k, "".join(rng.choice(["://", "/", "?", "#", "com", "net", ".", "en/", "de/8", "Example", "org", "es", ":", "é", "\n", "%2F"]) for _ in range(rng.randint(0, 12)))) for k in range(1500)]
    both = pages.unionByName(spark.createDataFrame([*odd, (None, None), (5, None), (5, "x://com/en/"), (5, "x://com/en/")], "page_id long, url string"))
    got = url_filter.judge(both).collect()
    urls = {r.page_id: r.url for r in pages.collect()} | dict(odd)
    assert len(got) == both.count()
    for r in got:
        if r.page_id in urls and r.page_id != 5:
            assert (r.host, r.path, r.rule) == brute_parts(urls[r.page_id]), urls[r.page_id]
        assert r.verdict == (dict((b, a) for a, b in url_filter.RULES).get(r.rule) or ("block" if r.block_probability >= 0.5 else "allow"))


def test_water_fill():
    assert mixing.water_fill([100, 10, 1000], [1, 2, 3]) == pytest.approx([(1110 - 30) * 1 / 4, 30.0, (1110 - 30) * 3 / 4])
    assert mixing.water_fill([0, 10], [1, 2]) == [0.0, 10.0]
    assert mixing.water_fill([], []) == []


def test_flow_of_overlapping_sources_is_cheapest():
    patterns, targets = {("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 20, "b": 10}
    got = mixing.route(patterns, targets)
    cost = lambda f: sum(sum(2**k * max(0, min(n, f[p] - k * n)) for k in range(3)) for p, n in patterns.items())
    assert sum(got.values()) == pytest.approx(30) and all(got[p] <= 3 * n for p, n in patterns.items())
    best = min(cost({("a",): x, ("a", "b"): y, ("b",): 30 - x - y}) for x, y in itertools.product(range(21), range(31)) if 0 <= 30 - x - y <= 10 and x <= 20)
    assert cost(got) == pytest.approx(best)


def test_mix(spark):
    rows = [(i, "w " * (i % 7), ["s1", "s2", None, "s3"][i % 4]) for i in range(400)] + [(1000, "v " * 5000, "s0"), (1001, None, "s4"), (5, "again again", "s1"), (1002, "x" * 100_000, "s1")]
    df = spark.createDataFrame([(k, t, s, 1.0) for k, t, s in rows], "doc_id long, text string, source string, target double")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    by, want = defaultdict(int), {}
    source = {(k, len((t or "").split())): s for k, t, s in rows}
    for r in got:
        s = source[r.doc_id, r["size"]]
        by[s] += r.taken
        want[s] = r.target
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [want[s] for s in names] == pytest.approx(mixing.water_fill([sizes[s] for s in names], [[1, 2, 3][i % 3] for i in range(len(names))]))
    assert all(abs(by[s] - want[s]) <= 1 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mixed(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0
    both = df.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    assert sum(r.taken for r in mixing.mix(both).collect()) > 0


def test_targets_by_aggregation_are_those_of_water_fill(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 40):
        sizes, weights = [rng.choice([0, 1, 5, 1000, 10**6]) for _ in range(n)], [rng.choice([1.0, 2.0, 3.0]) for _ in range(n)]
        df = spark.createDataFrame(list(zip(range(n), sizes, weights, strict=True)), "s int, size long, weight double")
        got = {r.s: r.target for r in mixing.targets(df, float(sum(sizes)), 3).collect()}
        assert [got[i] for i in range(n)] == pytest.approx(mixing.water_fill(sizes, weights)), (sizes, weights)


def test_mix_of_overlapping_sources_against_all_choices(spark):
    rows = [(k, "w " * (1 + k % 3), [["a"], ["a", "b"], ["b"], ["c"], ["b", "a", "a"]][k % 5]) for k in range(15)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    size, taken = Counter(), Counter()
    for r in got:
        name = "".join(sorted(set(rows[r.doc_id][2])))
        size[name] += r["size"]
        taken[name] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    total = sum(size.values())
    want = mixing.water_fill([size["a"] + size["ab"], size["b"] + size["ab"], size["c"]], [1, 2, 3], total=total)
    assert abs(taken["c"] - want[2]) <= 1
    cost = lambda f: sum(sum(2**k * max(0, min(size[p], f[p] - k * size[p])) for k in range(3)) for p in f)
    whole = round(want[0]) + round(want[1])
    fits = [{"a": x, "b": y, "ab": whole - x - y} for x in range(round(want[0]) + 1) for y in range(round(want[1]) + 1) if 0 <= whole - x - y <= 3 * size["ab"] and x <= 3 * size["a"] and y <= 3 * size["b"]]
    assert abs(sum(taken[p] for p in ("a", "b", "ab")) - whole) <= 2
    assert abs(cost({p: taken[p] for p in ("a", "b", "ab")}) - min(map(cost, fits))) <= 8
