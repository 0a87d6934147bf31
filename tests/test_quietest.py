import math

import numpy as np

from earshot.operators import intervals


def cuts(a, b, frames, longest=10.0, shortest=3.0, window=0.2):
    """The pieces of one turn, window by window."""
    out = []
    while round(b - a, 9) > longest:
        low, high = a + shortest, min(a + longest, b)
        means = []
        for k in range(max(1, math.floor(round((high - low - window) / (window / 2), 9)) + 1)):
            begin = low + window / 2 * k
            own = [e for t, e in frames if round(begin, 9) <= t < round(begin + window, 9)]
            means.append((sum(own) / len(own) if own else math.inf, begin))
        least, begin = min(means, key=lambda m: m[0])
        at = begin + window / 2 if math.isfinite(least) else a + longest
        out.append((round(a, 6), round(at, 6)))
        a = at
    return out + ([(round(a, 6), round(b, 6))] if round(b - a, 9) >= shortest else [])


def test_equal_turns_are_cut_once_and_groups_have_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TURNS_A_TASK", 20)
    rng = np.random.default_rng(8)
    frames = [(float(t), float(e)) for t, e in zip(range(0, 200, 1), rng.integers(0, 1000, 200))]
    turns = [(k % 3, float(a), float(a) + float(n) / 10) for k, (a, n) in enumerate(rng.integers(0, 150, (100, 2)) * [1, 4])] + [(1, 7.0, 47.5)] * 300
    df = spark.createDataFrame([("f", *x) for x in turns], "file_id string, speaker_id int, start double, end double")
    e = spark.createDataFrame([("f", *x) for x in frames], "file_id string, t double, energy double")
    got = intervals.split_quietest(df, e)
    assert got.rdd.getNumPartitions() >= 6  # 100 distinct turns in groups of about 20, whatever their bytes
    want = sorted((k, *x) for k, a, b in turns for x in cuts(a, b, frames))
    assert sorted((r.speaker_id, round(r.start, 6), round(r.end, 6)) for r in got.collect()) == want
