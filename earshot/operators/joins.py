"""Lookups, guarded joins, tolerance and title matching, overlays, work lists."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import blank, normalize_title, stem, title_similarity
from earshot.operators.quantiles import spread_join
from earshot.session import stored


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, fallback: Column | None = None) -> DataFrame:
    """df with mapping's value by key, or the fallback (default: the key itself)."""
    own = mapping.select(key, value).dropDuplicates([key])
    base = df.drop(value) if value in df.columns else df
    return base.join(own, key, "left").withColumn(value, F.coalesce(F.col(value), F.col(key) if fallback is None else fallback))


def millis(c: str) -> Column:
    """Seconds as whole milliseconds: the form in which times are join keys."""
    return F.round(F.col(c) * 1000).cast("long")


def match_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, misses and their percentage of a left join."""
    there = right.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return left.join(there, keys, "left").agg(F.count("*").alias("rows"), F.count_if(F.col("_hit").isNull()).alias("missing")).withColumn("percent", F.when(F.col("rows") > 0, 100.0 * F.col("missing") / F.col("rows")).otherwise(0.0))


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails when a left row has no match."""
    unknown = left.join(right, keys, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no match for {unknown[0]}")
    return left.join(right, keys)


def merge_predictions(frames: dict[str, DataFrame], key: list[str], truth: str = "true", pred: str = "pred") -> DataFrame:
    """(key, true, pred_<model> ...): fails on duplicate keys or differing labels."""
    out = None
    for name, df in frames.items():
        if df.groupBy(*key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name} repeats a key")
        own = df.select(*key, F.col(truth).alias(f"_{name}"), F.col(pred).alias(f"pred_{name}"))
        out = own if out is None else out.join(own, key)
    first = next(iter(frames))
    differ = reduce(lambda a, b: a | b, [F.col(f"_{n}") != F.col(f"_{first}") for n in frames])
    if out.filter(differ).limit(1).count():
        raise ValueError("the models' labels differ")
    return out.withColumn(truth, F.col(f"_{first}")).drop(*[f"_{n}" for n in frames])


def coalesced_lookup(df: DataFrame, by_id: DataFrame, by_name: DataFrame, value: str, key: str = "id", name: str = "name") -> DataFrame:
    a = by_id.select(key, F.col(value).alias("_a")).dropDuplicates([key])
    b = by_name.select(name, F.col(value).alias("_b")).dropDuplicates([name])
    return df.join(a, key, "left").join(b, name, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def suppress_channels(registry: DataFrame) -> DataFrame:
    """Drop channel rows whose channel has an approved playlist."""
    picked = registry.filter((F.col("url_type") == "playlist") & (F.col("status") == "approved") & ~blank(F.col("channel_id"))).select("channel_id").distinct().withColumn("_p", F.lit(True))
    return registry.join(picked, "channel_id", "left").filter((F.col("url_type") != "channel") | F.col("_p").isNull()).drop("_p")


def aligned(left: DataFrame, right: DataFrame, order_left: str, order_right: str, same: list[str]) -> DataFrame:
    """Rows joined by their place in explicit orders; fails unless the `same` columns agree. Orders are dense row numbers made by the caller."""
    r = right.select(F.col(order_right).alias(order_left), *[F.col(c).alias(f"_{c}") if c in same else F.col(c) for c in right.columns if c != order_right])
    both = left.join(r, order_left)
    differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    if both.filter(differ).limit(1).count():
        raise ValueError("rows do not line up")
    return both.drop(*[f"_{c}" for c in same])


def first_wins(*sources: DataFrame, key: str = "name", value: str = "url") -> DataFrame:
    """(key, value) of the first source that has the key; within a source the smallest value."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select(key, value, F.lit(i).alias("_p")) for i, s in enumerate(sources)])
    return every.groupBy(key).agg(F.min(F.struct("_p", value))[value].alias(value))


def attach_by_stem(df: DataFrame, index: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """index (stem, columns) joined by the file name's stem; '' where absent."""
    own = index.select(F.col("stem").alias("_stem"), *columns).dropDuplicates(["_stem"])
    out = df.withColumn("_stem", stem(F.col(path))).join(own, "_stem", "left").drop("_stem")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def borrow(df: DataFrame, via: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a missing column from another table by key."""
    own = via.select(key, F.col(column).alias("_b")).dropna().dropDuplicates([key])
    have = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.join(own, key, "left").withColumn(column, F.coalesce(have, F.col("_b"))).drop("_b")


def overlay(state: DataFrame, fresh: DataFrame, key: str, present: DataFrame | None = None) -> DataFrame:
    """Fresh non-empty values over a stored state. Rows that claim to be on disk but are not in `present` go, if it has any row."""
    columns = [c for c in state.columns if c != key]
    f = fresh.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns])
    out = state.join(f, key, "full").select(key, *[F.coalesce(F.nullif(F.col(f"_f_{c}"), F.lit("")), F.col(c)).alias(c) for c in columns])
    if present is not None and present.limit(1).count():
        seen = present.select(key).distinct().withColumn("_on", F.lit(1))
        out = out.join(seen, key, "left").filter(F.col("_on").isNotNull() | (F.col("stage") == "picked")).drop("_on")
    return out


def work_list(episodes: DataFrame, requested: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Episodes (show, has_turns, ...) still to do, and requested shows that do not exist."""
    missing = None
    if requested is not None:
        missing = requested.join(episodes, "show", "left_anti")
        episodes = episodes.join(requested, "show", "left_semi")
    return (episodes if force else episodes.filter(~F.coalesce("has_turns", F.lit(False)))), missing


def loose_uploads(uploads: DataFrame, members: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Uploads in no playlist, flagged as seen or new."""
    out = uploads.join(members.select(key), key, "left_anti").join(seen.select(key).distinct().withColumn("_s", F.lit(True)), key, "left")
    return out.withColumn("status", F.when(F.col("_s"), "seen").otherwise("new")).drop("_s")


def near_durations(local: DataFrame, remote: DataFrame, tolerance: float, by: list[str] | None = None) -> DataFrame:
    """Pairs whose durations (l_dur, r_dur) differ by at most tolerance: equal cells of the tolerance's width, and neighbours."""
    by = by or []
    cells = local.withColumn("_c", F.explode(F.array(*[F.floor(F.col("l_dur") / tolerance) + d for d in (-1, 0, 1)])))
    other = remote.withColumn("_c", F.floor(F.col("r_dur") / tolerance))
    return cells.join(other, [*by, "_c"]).filter(F.round(F.abs(F.col("l_dur") - F.col("r_dur")), 9) <= tolerance).drop("_c")


def within_tolerance(local: DataFrame, remote: DataFrame, tolerance: float) -> DataFrame:
    """(local, n, remote): how many remotes have a duration (whole nanoseconds) within the tolerance of a local's, and the smallest of them; locals without one have no row.

    local: (local, l_dur), remote: (remote, r_dur), one row for each remote. No pair is made. All windows have one width, so a window is the end
    of one cell of that width and the beginning of the next. Distinct durations are sorted over ranges; running counts and minima
    inside a range, and what other ranges of a cell add, answer both ends, so a cell that holds most rows is dealt over many tasks.
    """
    t = round(tolerance * 1e9)
    width = 2 * t + 1
    nano = lambda c: F.round(F.col(c) * 1e9).cast("long")
    points = remote.filter("r_dur is not null").groupBy(nano("r_dur").alias("_x")).agg(F.count("*").alias("n"), F.min("remote").alias("m"))
    asked = local.filter("l_dur is not null").select(nano("l_dur").alias("_d")).distinct()
    ends = asked.select("_d", F.explode(F.array(F.struct((F.col("_d") - t).alias("_x"), F.lit(1).alias("_k")), F.struct((F.col("_d") + t).alias("_x"), F.lit(2).alias("_k")))).alias("e")).select("_d", "e.*")
    rows = points.withColumn("_k", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    rows = stored(rows.repartitionByRange("_x").withColumns({"_part": F.spark_partition_id(), "_cell": F.expr(f"(_x - pmod(_x, {width})) div {width}")}), "sweep")
    here = Window.partitionBy("_part", "_cell")
    up, down = (here.orderBy(x, "_k").rowsBetween(Window.unboundedPreceding, 0) for x in (F.col("_x"), F.desc("_x")))
    sums = rows.groupBy("_part", "_cell").agg(F.sum("n").alias("_n"), F.min("m").alias("_m"))  # at most a row for each range and each cell
    parts = Window.partitionBy("_cell").orderBy("_part")
    before, after = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    others = sums.select("_part", "_cell", *[f(c).over(w).alias(c + name) for name, w in (("_before", before), ("_after", after)) for f, c in ((F.sum, "_n"), (F.min, "_m"))])
    r = rows.withColumns({"_up_n": F.sum("n").over(up), "_up_m": F.min("m").over(up), "_down_n": F.sum("n").over(down), "_down_m": F.min("m").over(down)})
    r = r.filter("_k > 0").join(others, ["_part", "_cell"])
    whole = F.pmod(F.col("_x"), F.lit(width)) == 0  # a window that is one cell: its upper end counts all
    n = F.when(F.col("_k") == 2, F.coalesce("_up_n", F.lit(0)) + F.coalesce("_n_before", F.lit(0))).when(~whole, F.coalesce("_down_n", F.lit(0)) + F.coalesce("_n_after", F.lit(0))).otherwise(0)
    m = F.when(F.col("_k") == 2, F.least("_up_m", "_m_before")).when(~whole, F.least("_down_m", "_m_after"))
    found = r.select("_d", n.alias("n"), m.alias("m")).groupBy("_d").agg(F.sum("n").alias("n"), F.min("m").alias("remote")).filter("n > 0")
    return spread_join(local.withColumn("_d", nano("l_dur")), stored(found, "found"), ["_d"]).select("local", "n", "remote")


def independent_runs(durations: DataFrame, group: str, tolerance: float) -> DataFrame:
    """(group, _cell, run): runs of durations (group, dur) in a group, numbered from 0, that a gap wider than the tolerance parts.

    Durations (whole nanoseconds) are first reduced to the ends of cells no wider than the tolerance, inside which there is no gap; only
    these are put in order, so a group's rows do not meet.
    """
    t = round(tolerance * 1e9)
    whole = durations.filter("dur is not null").withColumn("_x", F.round(F.col("dur") * 1e9).cast("long"))
    ends = whole.groupBy(group, F.expr(f"(_x - pmod(_x, {t + 1})) div {t + 1}").alias("_cell")).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    order = Window.partitionBy(group).orderBy("_cell")
    cut = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > t, F.lit(False)).cast("long")
    return ends.withColumn("_cut", cut).select(group, "_cell", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


def assign_within(local: DataFrame, remote: DataFrame, group: str, tolerance: float = 1.0) -> DataFrame:
    """Greedy one-to-one match of a group's recordings by duration (whole nanoseconds), ties by title: (group, local, remote).

    local: (group, local, l_dur, l_title), remote: (group, remote, r_dur, r_title), one row for each recording. Recordings are taken
    in order of duration; each takes the unused remote of most similar title within the tolerance. Recordings on either side of a gap wider
    than the tolerance never compete, so each run between gaps is matched for itself, in one pass over its sorted rows: no pairs of
    recordings are made, only pairs of the distinct titles of neighbouring cells, and a task holds the remotes of one window.
    """
    t = round(tolerance * 1e9)
    nano = lambda c: F.round(F.col(c) * 1e9).cast("long")
    cell = F.expr(f"(_x - pmod(_x, {t + 1})) div {t + 1}").alias("_cell")
    kind = dict(local.dtypes) | dict(remote.dtypes)
    a = local.select(group, "local", nano("l_dur").alias("_x"), normalize_title(F.col("l_title")).alias("_t")).dropna(subset=[group, "local", "_x"]).select("*", cell)
    b = remote.select(group, "remote", nano("r_dur").alias("_x"), normalize_title(F.col("r_title")).alias("_t")).dropna(subset=[group, "remote", "_x"]).select("*", cell)
    every = local.select(group, F.col("l_dur").alias("dur")).unionByName(remote.select(group, F.col("r_dur").alias("dur")))
    runs = stored(independent_runs(every.dropna(), group, tolerance), "runs")
    near = a.select(group, F.col("_t").alias("_l"), "_cell").distinct().withColumn("_c", F.explode(F.array(*[F.col("_cell") + d for d in (-1, 0, 1)])))
    near = near.join(b.select(group, F.col("_t").alias("_r"), F.col("_cell").alias("_c")).distinct(), [group, "_c"]).select(group, "_cell", "_l", "_r").distinct()
    alike = near.withColumn("_far", -F.coalesce(title_similarity(F.col("_l"), F.col("_r")), F.lit(-1.0)))
    alike = alike.groupBy(group, "_cell", F.col("_l").alias("_t")).agg(F.sort_array(F.collect_list(F.struct("_far", "_r"))).alias("_a"))
    alike = alike.select(group, "_cell", "_t", F.col("_a._far").alias("_far"), F.col("_a._r").alias("_r"), (F.col("_cell") * (t + 1)).alias("_at"), F.lit(0).alias("_k"))
    # a remote comes when the first local that may take it can, so a local finds its whole window before it
    rows = alike.unionByName(b.withColumns({"_at": F.col("_x") - t, "_k": F.lit(1)}), allowMissingColumns=True)
    rows = rows.unionByName(a.withColumns({"_at": F.col("_x"), "_k": F.lit(2)}), allowMissingColumns=True)
    rows = spread_join(rows, runs, [group, "_cell"]).select(group, "run", "_at", "_k", "local", "remote", "_x", "_t", "_far", "_r")
    rows = rows.repartition(group, "run").sortWithinPartitions(group, "run", "_at", "_k", "local", "remote")

    def take(batches):
        at, free, alike = None, {}, {}
        for batch in batches:
            out = []
            for g, run, now, k, own, other, x, title, far, titles in zip(*[c.to_pylist() for c in batch.columns]):
                if (g, run) != at:
                    at, cell, free, alike = (g, run), None, {}, {}
                if k == 0:
                    if now != cell:
                        cell, alike = now, {}
                    alike[title] = list(zip(far, titles))
                elif k == 1:
                    free.setdefault(title, []).append((x, other))
                else:
                    best = None
                    for d, name in alike.get(title, ()):
                        if best and d > best[0]:
                            break
                        found = nearest(free.get(name, []), x, x - t)
                        if found and (best is None or found < best[1:3]):
                            best = (d, *found, name)
                    if best:
                        _, away, mine, name = best
                        rest = free[name]
                        for y in (x - away, x + away):
                            i = bisect_left(rest, (y, mine))
                            if i < len(rest) and rest[i] == (y, mine):
                                del rest[i]
                                break
                        out.append((g, own, mine))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.schema.field(n).type) for i, n in enumerate((group, "local", "remote"))], [group, "local", "remote"])

    return rows.mapInArrow(take, f"`{group}` {kind[group]}, local {kind['local']}, remote {kind['remote']}")


def nearest(free: list[tuple], x: int, least: int) -> tuple | None:
    """(distance, remote) of the sorted (place, remote) nearest to x, ties to the smaller remote; places below least are dropped."""
    gone = bisect_left(free, (least,))
    if gone > 32:
        del free[:gone]
        gone = 0
    i = bisect_left(free, (x,))
    after = (free[i][0] - x, free[i][1]) if i < len(free) else None
    if i == gone:
        return after
    y = free[i - 1][0]
    before = (x - y, free[bisect_left(free, (y,))][1])
    return before if after is None else min(before, after)


def match_titles(local: DataFrame, remote: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(local, remote, status): equal titles, narrowed by duration; without a title match, duration alone (counted by a sweep, no pairs). One candidate: matched; several: ambiguous; none."""
    a = local.withColumn("_t", normalize_title(F.col("l_title")))
    b = remote.withColumn("_t", normalize_title(F.col("r_title")))
    found = [F.countDistinct("remote").alias("n"), F.min("remote").alias("remote")]
    close = near_durations(a, b, tolerance, ["_t"]).groupBy("local").agg(*found)
    titled = a.join(b.groupBy("_t").agg(*found), "_t")  # a row for each title: recordings of a common title do not all meet
    far = titled.join(close.select("local"), "local", "left_anti").select("local", "n", "remote")
    rest = within_tolerance(local.join(titled.select("local"), "local", "left_anti").select("local", "l_dur"), remote.select("remote", "r_dur"), tolerance)
    n = close.unionByName(far).unionByName(rest)
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return local.select("local").join(n, "local", "left").select("local", F.when(F.col("n") == 1, F.col("remote")).alias("remote"), status.alias("status"))


def contained_match(left: DataFrame, right: DataFrame, floor: int = 5) -> DataFrame:
    """(left, right): equal normalised names first, else one contains the other (shorter one of `floor` letters); the smallest right name of the best kind.

    left, right: (name). Names are joined by their letter n-grams of length floor: of a contained name all of them
    are in the other, so one is enough. Each name looks up the one that the fewest names of the other side hold (ties: the least one);
    a name with a gram that none of them holds is contained in none.
    """
    a, b = left.select(F.col("name").alias("left")), right.select(F.col("name").alias("right"))
    exact = a.join(b, F.col("left") == F.col("right")).select("left", "right", F.lit(0).alias("k"))

    def grams(df: DataFrame, c: str) -> DataFrame:
        x = df.filter(F.length(c) >= floor)
        at = F.explode(F.sequence(F.lit(1), F.length(c) - floor + 1))
        return x.withColumn("_i", at).select(c, F.substr(F.col(c), F.col("_i"), F.lit(floor)).alias("_g")).distinct()

    def rarest(own: DataFrame, c: str, others: DataFrame) -> DataFrame:
        held = others.groupBy("_g").agg(F.count("*").alias("_n"))
        best = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g"))
        return own.join(held, "_g", "left").groupBy(c).agg(best.alias("_b")).filter("_b.n > 0").select(c, F.col("_b._g").alias("_g"))

    of_left, of_right = grams(a, "left"), grams(b, "right")
    in_right = rarest(of_left, "left", of_right).join(of_right, "_g").filter(F.col("right").contains(F.col("left")))
    in_left = rarest(of_right, "right", of_left).join(of_left, "_g").filter(F.col("left").contains(F.col("right")))
    part = in_right.select("left", "right").unionByName(in_left.select("left", "right")).select("left", "right", F.lit(1).alias("k"))
    return exact.unionByName(part).groupBy("left").agg(F.min(F.struct("k", "right"))["right"].alias("right"))
