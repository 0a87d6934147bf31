"""Operators without a SQL twin, against brute force on small fixtures, and the self-check data sets."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions.text import stem
from earshot.operators import checks, clustering, evaluation, gates, intervals, joins, splits


def linkage(points, cut):
    """Average linkage by brute force: merge the closest two clusters while their mean cosine distance is at most cut."""
    v = points / np.linalg.norm(points, axis=1, keepdims=True)
    d = 1 - v @ v.T
    clusters = [[i] for i in range(len(v))]
    while len(clusters) > 1:
        best = min(((d[np.ix_(a, b)].mean(), min(a), min(b), x, y) for (x, a), (y, b) in itertools.combinations(enumerate(clusters), 2)))
        if best[0] > cut:
            break
        clusters[best[3]] += clusters[best[4]]
        del clusters[best[4]]
    return {i: min(c) for c in clusters for i in c}


@pytest.mark.parametrize("seed", range(2))
def test_average_linkage(spark, seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(0, i, [float(x) for x in p]) for i, p in enumerate(points)], "k int, node long, vec array<double>")
    got = {r.node: r.cluster for r in clustering.average_linkage(df, "k", "node", "vec", 0.3).collect()}
    assert got == linkage(points, 0.3)


def test_average_linkage_of_a_chain_asks_few_clusters_again(spark):
    angles = np.cumsum(0.01 * 1.3 ** np.arange(12))  # each point's nearest one is the one before it: a merge a round
    chain = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    points = dict(enumerate(chain))
    far = {100 + i: np.array([-np.cos(a), -np.sin(a)]) for i, a in enumerate(np.linspace(0, 2e-6, 10))}  # copies, but for rounding
    df = spark.createDataFrame([("k", i, v.tolist()) for i, v in (points | far).items()] + [("other", 1, [1.0, 0.0]), (None, 2, [1.0, 0.0])], "k string, node long, vec array<double>")
    report = []
    got = {(r.k, r.node): r.cluster for r in clustering.average_linkage(df, "k", "node", "vec", 0.05, block=5, report=report).collect()}
    want = linkage(chain, 0.05)
    assert {i: got["k", i] for i in points} == want and len(set(want.values())) < len(points)
    assert {got["k", i] for i in far} == {100} and got["other", 1] == 1 and got[None, 2] == 2
    assert len(report) > 5 and report[0] == (23, 22 * 22 + 1)
    assert sum(n for _, n in report[1:-1]) < (len(report) - 2) * report[0][1] / 3, report


def test_average_linkage_of_small_keys_takes_few_rounds(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i % 2, i, rng.normal(size=6).tolist()) for i in range(300)], "k int, node long, vec array<double>")
    report, rounds = [], []
    got = {r.node: r.cluster for r in clustering.average_linkage(df, "k", "node", "vec", 0.7, report=report).collect()}
    assert len(report) == 1
    assert got == {r.node: r.cluster for r in clustering.average_linkage(df, "k", "node", "vec", 0.7, block=20, report=rounds).collect()}
    assert len(rounds) > 3


def test_assign_within(spark):
    local = spark.createDataFrame([("g", 1, 600.4, "T1"), ("g", 2, 600.6, "T2"), ("g", 3, 60.0, "T1")], "g string, local long, l_dur double, l_title string")
    remote = spark.createDataFrame([("g", "aaa", 600.0, "T1"), ("g", "bbb", 601.0, "T2"), ("g", "ccc", 9999.0, "T1")], "g string, remote string, r_dur double, r_title string")
    assert {r.local: r.remote for r in joins.assign_within(local, remote, "g", 1.0).collect()} == {1: "aaa", 2: "bbb"}


def test_match_titles(spark):
    local = spark.createDataFrame([(1, "A Show", 100.0), (2, "renamed", 605.0), (3, "gone", 9999.0), (4, "Twice", 50.0)], "local long, l_title string, l_dur double")
    remote = spark.createDataFrame([("aaa", "a show", 100.0), ("bbb", "Other", 604.0), ("ccc", "z", 300.0), ("d", "twice", 50.0), ("e", "Twice", 51.0)], "remote string, r_title string, r_dur double")
    got = {r.local: (r.remote, r.status) for r in joins.match_titles(local, remote).collect()}
    assert got == {1: ("aaa", "matched"), 2: ("bbb", "matched"), 3: (None, "none"), 4: (None, "ambiguous")}


def test_recovered_ids(spark):
    df = spark.createDataFrame([("a", "x" * 11, 100.0, 100.0, 100.0, "high"), ("b", "x" * 11, 200.0, 200.0, 200.0, "high"), ("c", "short", 5.0, 5.0, 5.0, "high")], "file string, id string, csv_seconds double, measured_seconds double, remote_seconds double, confidence string")
    got = sorted((r.file, r.problem) for r in checks.id_violations(df).collect())
    assert got == [("a", "one id, different lengths"), ("b", "one id, different lengths"), ("c", "malformed id")]


def test_stems_on_both_separators(spark):
    df = spark.createDataFrame([("D:\\x\\a [1].wav",), ("/d/b.wav",), (None,)], "p string")
    assert [r[0] for r in df.select(stem(F.col("p"))).collect()] == ["a [1]", "b", None]


def test_exclusive_turns_overlapping_three_ways(spark):
    turns = [("f", "a", 0.0, 10.0), ("f", "b", 4.0, 6.0), ("f", "c", 5.0, 8.0), ("f", "a", 10.0, 12.0), ("f", "b", 12.0, 13.0)]
    got = sorted((r.speaker_id, r.start, r.end) for r in intervals.exclusive_turns(spark.createDataFrame(turns, "file_id string, speaker_id string, start double, end double")).collect())
    assert got == [("a", 0.0, 4.0), ("a", 8.0, 12.0), ("b", 12.0, 13.0)]


@pytest.mark.parametrize(("length", "pieces"), [(10.0, [10.0]), (20.0, [10.0, 10.0]), (22.0, [10.0, 10.0]), (23.0, [10.0, 10.0, 3.0]), (2.0, [])])
def test_split_fixed_edges(spark, length, pieces):
    df = spark.createDataFrame([("f", "a", 0.0, length)], "file_id string, speaker_id string, start double, end double")
    assert sorted((r.end - r.start for r in intervals.split_fixed(df).collect()), reverse=True) == pieces


def test_split_quietest(spark):
    turns = spark.createDataFrame([("f", "a", 0.0, 14.0)], "file_id string, speaker_id string, start double, end double")
    frames = spark.createDataFrame([("f", i / 20, 0.1 if 6.0 <= i / 20 < 6.3 else 1.0) for i in range(280)], "file_id string, t double, energy double")
    got = sorted((round(r.start, 2), round(r.end, 2)) for r in intervals.split_quietest(turns, frames).collect())
    assert len(got) == 2 and 6.0 <= got[0][1] <= 6.3 and got[1][1] == 14.0


def test_mad_outliers_of_small_and_equal_groups(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 0.0]), (2, 4, [1.0, 0.0]), (2, 5, [1.0, 0.0]), (2, 6, [0.0, 1.0])]
    got = {r.row: r.inlier for r in clustering.mad_outliers(spark.createDataFrame(rows, "k int, row int, vec array<double>"), ["k"], "row", "vec").collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False}


def test_knee_tiers_of_a_convex_curve(spark):
    sizes = [1000, 500, 100, 50, 40, 30, 25, 20, 15, 10]
    got = {r.actor: r.tier for r in clustering.knee_tiers(spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "k int, actor int, n long"), "k", "actor").collect()}
    assert [got[i] for i in range(10)] == ["Tier1"] * 3 + ["Tier2"] * 3 + ["Tier3"] * 4


@pytest.mark.parametrize("n", [1, 2, 3])
def test_channel_splits_of_few_channels(spark, n):
    df = spark.createDataFrame([("r", f"c{i}", 10.0 * (i + 1)) for i in range(n)], "region string, channel string, duration double")
    got = {r.split for r in splits.channel_splits(df, "region", "channel").collect()}
    assert got == [{"test"}, {"train", "test"}, {"train", "dev", "test"}][n - 1]


def test_mcnemar_against_a_direct_sum(spark):
    from math import comb

    rows = [(1, 1, 0)] * 3 + [(1, 0, 1)] * 9 + [(1, 1, 1)] * 5
    r = evaluation.mcnemar(spark.createDataFrame(rows, "t int, a int, b int"), "t", "a", "b").first()
    assert (r.b01, r.b10) == (9, 3) and abs(r.p - min(1, 2 * sum(comb(12, i) for i in range(4)) / 2**12)) < 1e-12


def test_missing_scores_never_exclude(spark):
    df = spark.createDataFrame([(None, None, None, None, False, None)], "music_prob double, panns_speech_prob double, speech_ratio double, snr_db double, is_excluded boolean, exclude_reason string")
    r = gates.content_gates(df).first()
    assert (r.is_excluded, r.exclude_reason) == (False, "")


def test_registry_keeps_what_was_there_first(spark, tmp_path):
    from earshot.sources import registry

    path = str(tmp_path / "registry")
    for shows in (["a"], ["b", 'c|"" d'], ["e"]):
        registry.write_registry(spark.createDataFrame([(x,) for x in shows], "show string"), path)
    assert {r["show"] for r in registry.read_registry(spark, path).collect()} == {"e"}
    assert {r["show"] for r in registry.read_registry(spark, path + registry.BACKUP).collect()} == {"a"}
    registry.write_registry(registry.read_registry(spark, path), path)  # a table written over itself
    assert {r["show"] for r in registry.read_registry(spark, path).collect()} == {"e"}


def test_numbers_follow_the_order_over_partitions(spark):
    from earshot.operators.splits import numbered

    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(6)
    got = [(r.k, r.id) for r in numbered(df, "n", F.col("k"), F.desc("id"), offset=5).orderBy("n").collect()]
    assert got == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (x[0], -x[1]))
    assert sorted(r.n for r in numbered(df, "n", F.col("id"), offset=5).collect()) == list(range(6, 1006))
    assert numbered(df.limit(0), "n", F.col("id")).count() == 0


def test_splits_come_near_their_targets(spark, sf):
    from earshot import config
    from earshot.operators import splits
    from earshot.plans.registry import segments

    rows = segments(spark, sf).drop("split")
    for out, mass in ((splits.disjoint_splits(rows, "region", "speaker"), F.lit(1)), (splits.balanced_splits(rows, "region", "speaker"), F.col("duration"))):
        for r in out.groupBy("region").agg(F.sum(mass).alias("all"), *[F.sum(F.when(F.col("split") == s, mass).otherwise(0)).alias(s) for s in config.SPLIT_TARGETS]).collect():
            assert all(abs(r[s] / r["all"] - share) < 0.02 for s, share in config.SPLIT_TARGETS.items())


def test_late_rows_do_not_undo_newer_ones(spark, tmp_path):
    from earshot.streaming import incremental

    merge = incremental.merge_into(str(tmp_path / "state"), "key")
    merge(spark.createDataFrame([("a", 5, "done", ""), ("b", 1, "new", "x")], "key string, order int, stage string, note string"), 0)
    merge(spark.createDataFrame([("a", 3, "late", "kept"), ("b", 2, " ", "y"), ("c", 1, None, None)], "key string, order int, stage string, note string"), 1)
    got = {tuple(r) for r in incremental.merged_state(spark, str(tmp_path / "state"), "key").collect()}
    assert got == {("a", "done", "kept"), ("b", "new", "y"), ("c", None, None)}


def test_macro_class_labels_and_spellings_are_parameters(spark):
    df = spark.createDataFrame([("Con_trols",), ("other lang",), ("OTHER-LANG",), (None,)], "n string")
    got = df.select(gates.macro_class(F.col("n"), ("otherlang",), "Away", "Home").alias("own"), gates.macro_class(F.col("n")).alias("usual")).collect()
    assert [tuple(r) for r in got] == [("Home", "Control"), ("Away", "Target"), ("Away", "Target"), ("Home", "Target")]


@pytest.mark.parametrize("tolerance", [2.0, 0.5])
def test_counts_within_a_tolerance(spark, tolerance):
    rng = np.random.default_rng(7)
    near = [float(x) for x in np.round(rng.normal(100, 1.5, 400), 1)] + [50.0] * 60  # a hot cell and a hot value
    local = [(i, d) for i, d in enumerate(near)] + [(900, None), (901, 0.0), (902, 1e5)]
    remote = [(i, float(d)) for i, d in enumerate(np.round(rng.normal(100, 4, 300), 1))] + [(800 + i, 50.0 + tolerance) for i in range(30)] + [(850, None), (851, 100.123456)]
    a = spark.createDataFrame(local, "local long, l_dur double").repartition(6)
    b = spark.createDataFrame(remote, "remote long, r_dur double").repartition(5)
    got = {r.local: (r.n, r.remote) for r in joins.within_tolerance(a, b, tolerance).collect()}
    for i, d in local:
        found = [] if d is None else [r for r, x in remote if x is not None and round(abs(d - x), 9) <= tolerance]
        assert got.get(i, (0, None)) == (len(found), min(found, default=None))
    assert joins.within_tolerance(a, b.limit(0), tolerance).count() == 0


def test_matches_of_runs_are_those_of_whole_groups(spark):
    rng = np.random.default_rng(9)
    local = [(int(g), i, float(d), f"T {i % 7}") for i, (g, d) in enumerate(zip(rng.choice([0, 0, 1, 2], 250), np.round(rng.uniform(0, 400, 250), 1), strict=True))] + [(0, 900, None, "x"), (0, 901, 7.0, None)]
    remote = [(int(g), i, float(d), f"t_{i % 7}") for i, (g, d) in enumerate(zip(rng.choice([0, 0, 1, 2], 250), np.round(rng.uniform(0, 400, 250), 1), strict=True))]
    a = spark.createDataFrame(local, "g int, local long, l_dur double, l_title string")
    b = spark.createDataFrame(remote, "g int, remote long, r_dur double, r_title string")
    sides = joins.near_durations(a, b, 0.7, ["g"]).withColumn("s", joins.title_similarity(joins.normalize_title(F.col("l_title")), joins.normalize_title(F.col("r_title")))).collect()
    want, used = set(), set()
    for r in sorted({(r.g, r.l_dur, r.local) for r in sides}):
        free = sorted((-p.s if p.s is not None else 1, round(abs(p.l_dur - p.r_dur), 9), p.remote) for p in sides if (p.g, p.local) == (r[0], r[2]) and (p.g, p.remote) not in used)
        if free:
            used.add((r[0], free[0][2]))
            want.add((r[0], r[2], free[0][2]))
    assert set(map(tuple, joins.assign_within(a, b, "g", 0.7).collect())) == want
    runs = joins.independent_runs(a.select("g", F.col("l_dur").alias("dur")), "g", 0.7)
    assert runs.groupBy("g").agg(F.max("run").alias("n")).filter("g = 0 and n > 20").count() == 1


def test_matches_in_a_dense_run_make_no_pairs(spark, monkeypatch):
    """3,000 recordings on each side within one tolerance: 9,000,000 pairs, of which none is made."""
    monkeypatch.setattr(joins, "near_durations", lambda *_: pytest.fail("pairs of recordings"))
    a = spark.range(3000).select(F.lit("g").alias("g"), F.col("id").alias("local"), (50 + F.col("id") % 7 / 10).alias("l_dur"), F.concat(F.lit("T "), F.col("id") % 3).alias("l_title"))
    b = spark.range(3000).select(F.lit("g").alias("g"), F.col("id").alias("remote"), (50 + F.col("id") % 5 / 10).alias("r_dur"), F.concat(F.lit("t_"), F.col("id") % 3).alias("r_title"))
    got = {r.local: r.remote for r in joins.assign_within(a, b, "g", 1.0).collect()}
    want, free = {}, set(range(3000))
    for i in sorted(range(3000), key=lambda i: (i % 7, i)):
        want[i] = min(free, key=lambda j: (j % 3 != i % 3, abs(i % 7 - j % 5), j))
        free.remove(want[i])
    assert got == want


def test_masses_of_splits_do_not_depend_on_the_order_of_rows(spark):
    """Forty short rows after a long one are lost in a float sum; exactly they make group 1 the larger one."""
    rows = [("x", 1, 1e9)] + [("x", 1, 5e-8)] * 40 + [("x", 2, 1e9 + 1e-6)]
    df = spark.createDataFrame(rows, "c string, g long, duration double").coalesce(1)
    got = {r.g: r.split for r in splits.disjoint_splits(df, "c", "g", F.col("duration"), {"train": 0.5, "dev": 0.5}).collect()}
    assert got == {1: "train", 2: "dev"}


def test_turns_of_a_file_are_cut_in_several_tasks(spark, monkeypatch):
    """A file's turns once met in one task; the pieces are those of the rule turn by turn."""
    r = np.random.default_rng(3)
    frames = [("f", float(t), float(e)) for t, e in zip(r.integers(0, 400, 1500) / 4, r.uniform(0, 1, 1500), strict=True)]
    turns = [("f", f"s{i % 3}", float(a), float(a + d)) for i, (a, d) in enumerate(zip(r.integers(0, 60, 90), r.integers(1, 40, 90), strict=True))]
    e = spark.createDataFrame(frames, "file_id string, t double, energy double")
    t = spark.createDataFrame(turns, "file_id string, speaker_id string, start double, end double")
    want = []
    for _, s, a, b in turns:
        while b - a > 10:
            begins, low = [], a + 2.0
            while not begins or low + 1.0 <= min(a + 10.0, b):
                begins.append(low)
                low += 0.5
            means = [[x for _, u, x in frames if at <= u < at + 1.0] for at in begins]
            means = [sum(m) / len(m) if m else np.inf for m in means]
            at = begins[int(np.argmin(means))] + 0.5 if min(means) < np.inf else a + 10.0
            want.append((s, a, at))
            a = at
        if b - a >= 2.0:
            want.append((s, a, b))
    monkeypatch.setattr(intervals, "TURNS_A_TASK", 20)
    got = intervals.split_quietest(t, e, 10.0, 2.0, 1.0)
    assert sorted((x.speaker_id, x.start, x.end) for x in got.collect()) == sorted(want)


def test_rounds_of_a_capped_draw_do_not_read_their_input_again(spark):
    """What leads to the rows (joins, draws) ran again in every round."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    rows = spark.range(300).select("id", same((F.col("id") >= 100).cast("long")).alias("cell"), (F.col("id") % 20).alias("cap"))
    reads = []
    for cap in (300, 5):  # one round; two, as the small cell takes all room of the first one
        before = seen.value
        got = splits.capped_stratified(rows, ["cell"], 30, {"cap": cap}, "id").groupBy("cell").count().collect()
        assert [r["count"] for r in got] == [30] * 2
        reads.append(seen.value - before)
    assert reads[0] == reads[1]


def test_merged_state_writes_what_a_batch_touches(spark, tmp_path):
    from earshot.streaming import incremental

    path, kind = str(tmp_path / "state"), "key string, order int, stage string"
    merge = incremental.merge_into(path, "key", 8)
    merge(spark.createDataFrame([(f"k{i}", 1, "new") for i in range(500)], kind), 0)

    def files():
        return {str(p.relative_to(path)): p.stat().st_size for p in (tmp_path / "state" / "data").rglob("*.parquet")}

    first = files()
    small = spark.createDataFrame([("k7", 2, "done")], kind)
    merge(small, 1)
    added = {p: n for p, n in files().items() if p not in first}
    assert len({p.split("/")[2] for p in added}) == 1 and sum(added.values()) < sum(first.values()) / 3
    state = sorted(map(tuple, incremental.merged_state(spark, path, "key").collect()))
    assert len(state) == 500 and ("k7", "done") in state
    merge(spark.createDataFrame([("k7", 9, "again")], kind), 1)  # a replayed batch
    assert sorted(map(tuple, incremental.merged_state(spark, path, "key").collect())) == state
    merge(spark.createDataFrame([("k7", 1, "late"), ("x", 1, "new")], kind), 2)
    merge(spark.createDataFrame([], kind), 3)
    merge(spark.createDataFrame([("k7", 3, "last")], kind), 4)
    got = {r.key: r.stage for r in incremental.merged_state(spark, path, "key").collect()}
    assert len(got) == 501 and got["k7"] == "last" and got["x"] == "new"
    assert len(list((tmp_path / "state" / "manifests").glob("n=*"))) == 2
    assert f"data/batch=1/{next(iter(added)).split('/')[2]}" not in {"/".join(p.split("/")[:3]) for p in files()}
    with pytest.raises(ValueError, match="8 buckets"):
        incremental.merge_into(path, "key", 4)(small, 5)


def test_contained_names_by_their_rarest_gram(spark):
    rng = np.random.default_rng(11)
    stem_ = "common beginning "
    left = sorted({stem_ + "".join(rng.choice(list("abcd"), rng.integers(0, 6))) for _ in range(120)} | {"abcde", "abc", "", "xyzzy"})
    right = sorted({stem_ + "".join(rng.choice(list("abcd"), rng.integers(0, 6))) for _ in range(120)} | {"zabcdez", "beginning", "abc", "n "})
    got = {r.left: r.right for r in joins.contained_match(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "name string")).collect()}
    for x in left:
        found = [(0, y) for y in right if x == y] + [(1, y) for y in right if min(len(x), len(y)) >= 5 and (x in y or y in x)]
        assert got.get(x) == (min(found)[1] if found else None)


def test_each_registry_file_has_its_own_header(spark, tmp_path):
    from earshot.sources import registry

    path = tmp_path / "registries"
    path.mkdir()
    (path / "a.psv").write_text('# made by hand\n\nshow|source|more\n"A | B"| x |1\nshow|source|more\n  # gone\n')
    (path / "b.psv").write_text("source|show\n y |C\n")
    (path / "c.psv").write_text("source|show\nz|D\n")
    (path / "d.psv").write_text("# nothing\n")
    got = registry.read_registry(spark, str(path))
    assert got.columns == [*registry.COLUMNS, "more"]
    assert {(r["source"], r["show"], r["more"], r["url"]) for r in got.collect()} == {("x", "A | B", "1", ""), ("source", "show", "more", ""), ("y", "C", "", ""), ("z", "D", "", "")}
    only = registry.read_registry(spark, str(path / "d.psv"))
    assert only.count() == 0 and only.columns == list(registry.COLUMNS)
