"""Speaker turns as intervals: exclusive turns, gap merging, splitting, overlap ratios."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot import config as C
from earshot.operators.quantiles import FEW, exact_percentiles, spread_join
from earshot.session import stored

TURNS_A_TASK, MOST_TASKS = 50_000, 2_000
TURNS_AT_ONCE = 2_048
TOUCH = 1e-6


def merge_turns(turns: DataFrame, gap: float = C.GAP_TOLERANCE, keys: tuple[str, ...] = ("file_id", "speaker_id")) -> DataFrame:
    """Merge turns of a key whose start is at most gap after the latest end so far: (keys, start, end)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # gaps are compared to nine decimals, so that 0.5 s written as a difference of decimals counts as 0.5 s
    new = (before.isNull() | (F.round(F.col("start") - before, 9) > gap)).cast("int")
    runs = turns.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def exclusive_turns(turns: DataFrame, file: str = "file_id", speaker: str = "speaker_id") -> DataFrame:
    """Parts of the timeline with exactly one distinct speaker; touching parts of a speaker are one.

    A sweep over starts and ends: the number of open turns of each speaker is a running sum, and so is the number
    of speakers with open turns. No interval is joined with another.
    """
    both = turns.filter(F.col("end") > F.col("start")).select(file, speaker, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(file, speaker, "e.*")
    steps = both.groupBy(file, speaker, "t").agg(F.sum("d").alias("d"))
    own = Window.partitionBy(file, speaker).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("open", F.sum("d").over(own))
    was = F.coalesce(F.lag("open").over(Window.partitionBy(file, speaker).orderBy("t")), F.lit(0))
    change = (F.col("open") > 0).cast("int") - (was > 0).cast("int")
    moves = steps.withColumn("c", change).filter("c <> 0")
    # codes of the speakers who are open add up, so a sum over one open speaker is that speaker
    code = F.dense_rank().over(Window.partitionBy(file).orderBy(speaker)).cast("long")
    at = moves.withColumn("code", code).groupBy(file, "t").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("code")).alias("s"))
    line = Window.partitionBy(file).orderBy("t")
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    atoms = at.select(file, F.col("t").alias("start"), F.lead("t").over(line).alias("end"), F.sum("c").over(run).alias("n"), F.sum("s").over(run).alias("code"))
    names = moves.withColumn("code", code).select(file, "code", speaker).distinct()
    single = atoms.filter("n = 1").select(file, "code", "start", "end").join(names, [file, "code"])
    return merge_turns(single.select(file, speaker, "start", "end"), TOUCH, (file, speaker))


def split_fixed(turns: DataFrame, longest: float = C.MAX_DURATION, shortest: float = C.MIN_DURATION) -> DataFrame:
    """Cut turns every `longest` seconds while more than that remains, and drop pieces under `shortest`."""
    length = F.round(F.col("end") - F.col("start"), 9)
    full = F.greatest(F.ceil(length / longest) - 1, F.lit(0)).cast("int")
    k = F.explode(F.sequence(F.lit(0), full))
    pieces = turns.withColumns({"_full": full, "_end": F.col("end")}).withColumn("_k", k)
    start = F.col("start") + F.col("_k") * longest
    pieces = pieces.withColumns({"start": start, "end": F.when(F.col("_k") < F.col("_full"), start + longest).otherwise(F.col("_end"))})
    return pieces.filter(F.round(F.col("end") - F.col("start"), 9) >= shortest).drop("_full", "_end", "_k")


def split_quietest(turns: DataFrame, frames: DataFrame, longest: float = C.MAX_DURATION, shortest: float = C.MIN_DURATION, window: float = C.SPLIT_WINDOW_S, file: str = "file_id") -> DataFrame:
    """Cut long turns at the quietest point between shortest and longest after the last cut.

    frames: (file, t, energy). Windows of `window` seconds step by half of it; the cut is the centre of the one with
    the least mean energy. Cuts follow one another inside a turn only: equal turns are cut once, and a file's distinct turns are dealt
    over groups of about TURNS_A_TASK, each with the file's frames, one for each distinct time, and a task of its own.
    """
    kinds = dict(turns.dtypes)
    turns = turns.groupBy(file, "speaker_id", "start", "end").agg(F.count("*").alias("_n"))
    shares = stored(turns.groupBy(file).agg((F.count("*") / TURNS_A_TASK).cast("int").alias("_parts")), "shares")
    tasks = int(min(MOST_TASKS, 2 * (shares.agg(F.sum(F.col("_parts") + 1)).first()[0] or 1)))
    parts = spread_join(turns, shares, [file]).withColumn("_part", F.pmod(F.xxhash64("speaker_id", "start", "end"), F.col("_parts") + 1).cast("int")).drop("_parts")
    times = frames.dropna(subset=[file, "t"]).groupBy(file, "t").agg(F.sum(F.coalesce("energy", F.lit(0.0))).alias("energy"), F.count("*").alias("n"))
    copies = spread_join(times.join(shares.select(file), file, "left_semi"), shares, [file]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts")))).drop("_parts")

    def cut(key, t: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        times, energy = f["t"].to_numpy(), f["energy"].to_numpy()
        sums, counts = np.concatenate([[0.0], np.cumsum(energy)]), np.concatenate([[0], np.cumsum(f["n"].to_numpy())])
        a, b = t["start"].to_numpy(np.float64).copy(), t["end"].to_numpy(np.float64)
        of, starts, ends = [], [], []

        def piece(rows, until):
            of.append(rows)
            starts.append(a[rows])
            ends.append(until)

        left = np.flatnonzero(np.round(b - a, 9) > longest)
        while len(left):
            at = np.concatenate([quietest(times, sums, counts, a[x], b[x]) for x in np.array_split(left, len(left) // TURNS_AT_ONCE + 1)])
            piece(left, at)
            a[left] = at
            left = left[np.round(b[left] - at, 9) > longest]
        rest = np.flatnonzero(np.round(b - a, 9) >= shortest)
        piece(rest, b[rest])
        of = np.concatenate(of)
        return pd.DataFrame({file: key[0], "speaker_id": t["speaker_id"].to_numpy()[of], "start": np.concatenate(starts), "end": np.concatenate(ends), "_n": t["_n"].to_numpy()[of]})

    def quietest(times, sums, counts, a, b) -> np.ndarray:
        """Where to cut the turns from a to b next."""
        low, high = a + shortest, np.minimum(a + longest, b)
        windows = np.maximum(1, np.floor(np.round((high - low - window) / (window / 2), 9)) + 1).astype(np.int64)
        k = np.arange(windows.max())
        begin = low[:, None] + window / 2 * k
        i, j = np.searchsorted(times, np.round(begin, 9)), np.searchsorted(times, np.round(begin + window, 9))
        mean = np.where((j > i) & (k < windows[:, None]), (sums[j] - sums[i]) / np.maximum(counts[j] - counts[i], 1), np.inf)
        best = mean.argmin(axis=1)
        row = np.arange(len(a))
        return np.where(np.isfinite(mean).any(axis=1), begin[row, best] + window / 2, a + longest)

    schema = f"`{file}` {kinds[file]}, speaker_id {kinds['speaker_id']}, start double, end double, _n long"
    dealt = [x.repartition(tasks, file, "_part").groupBy(file, "_part") for x in (parts, copies)]
    pieces = dealt[0].cogroup(dealt[1]).applyInPandas(cut, schema)
    return pieces.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def segment_rows(turns: DataFrame, **constants) -> DataFrame:
    """Segment rows from turns: times to three decimals, and constant columns."""
    out = turns.withColumns({"start_time": F.round("start", 3), "end_time": F.round("end", 3), "duration": F.round(F.col("end") - F.col("start"), 3)}).drop("start", "end")
    return out.withColumns({k: F.lit(v) for k, v in constants.items()})


def segment_files(turns: DataFrame, frames: DataFrame | None = None, gap: float = C.GAP_TOLERANCE, **constants) -> DataFrame:
    """Turns of files to segment rows: exclusive, merged, split."""
    merged = merge_turns(exclusive_turns(turns), gap)
    return segment_rows(split_fixed(merged) if frames is None else split_quietest(merged, frames), **constants)


def speech_ratio(segments: DataFrame, spans: DataFrame, keys: list[str], file: str = "file_id", cell: float = 30.0) -> DataFrame:
    """(keys, speech_ratio): share of a segment that speech spans cover (spans of a file do not overlap).

    Both sides are dealt to cells of time and joined by cell; an overlap counts in the first cell that both reach.
    """
    a = segments.select(*keys, F.col("start_time").alias("a0"), F.col("end_time").alias("a1"), *([file] if file not in keys else []))
    s = spans.select(file, F.col("start").alias("b0"), F.col("end").alias("b1"))
    a = a.withColumn("_c", F.explode(F.sequence(F.floor(F.col("a0") / cell), F.floor(F.col("a1") / cell))))
    s = s.withColumn("_c", F.explode(F.sequence(F.floor(F.col("b0") / cell), F.floor(F.col("b1") / cell))))
    first = F.greatest(F.floor(F.col("a0") / cell), F.floor(F.col("b0") / cell)) == F.col("_c")
    hit = a.join(s, [file, "_c"]).filter(first & (F.col("b0") < F.col("a1")) & (F.col("b1") > F.col("a0")))
    covered = hit.groupBy(*keys).agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("_s"))
    length = F.col("end_time") - F.col("start_time")
    return segments.select(*keys, "start_time", "end_time").join(covered, keys, "left").select(*keys, F.when(length > 0, F.coalesce("_s", F.lit(0.0)) / length).otherwise(0.0).alias("speech_ratio"))


def snr_proxy(frames: DataFrame, keys: list[str], energy: str = "energy", few: int = FEW) -> DataFrame:
    """(keys, snr_db): exact 90th less 10th percentile of frame levels in dB; 0 with fewer than two frames. Frames without energy count as silent.

    Recordings of over `few` frames are not sorted in one task (quantiles.exact_percentiles).
    """
    db = 20 * F.log10(F.greatest(F.col(energy), F.lit(1e-10)))
    g = exact_percentiles(frames, keys, db, [0.1, 0.9], few)
    return g.select(*keys, F.when(F.col("n") < 2, 0.0).otherwise(F.col("q")[1] - F.col("q")[0]).alias("snr_db"))


def guarded(score: Column, length: Column, least: float = 0.1) -> Column:
    """Slices too short to score count as 0."""
    return F.when(length < least, F.lit(0.0)).otherwise(score)
