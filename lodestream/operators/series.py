"""Series of daily readings: packing by entity, trailing totals on segment trees, regular grids, spikes.

All operators here share one layout. ``pack_series`` reduces the input to one value per entity and day
(pre-aggregated before the shuffle, so repeated rows of one entity collapse in the map stage) and then to
one row per entity, holding its days and values as two arrays. An array is bounded by the calendar, not by
the number of rows. The kernels then work on whole Arrow batches of such rows with numpy, never per row, and on
so many series at once as have ``CELLS`` calendar days between them: a stray date of another century makes one
series long, but no task large.

Rows whose key, date or value is null are no readings. The highest of several values of a day counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the working columns; the prefix keeps them apart from columns of the caller.
DAYS, VALS = "__ls_days", "__ls_vals"
#: Series, and calendar days of all of them, handled at once by a kernel, which bounds its memory; one series at least.
CHUNK, CELLS = 1024, 1 << 21


def pack_series(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """One row per entity: ``keys``, ``__ls_days`` (days since 1970, unsorted) and ``__ls_vals`` (highest value of the day)."""
    read = df.select(*[F.col(k) for k in keys], F.unix_date(F.col(date)).alias("__ls_day"), F.col(value).alias("__ls_val"))
    read = read.dropna()
    daily = read.groupBy(*keys, "__ls_day").agg(F.max("__ls_val").alias("__ls_val"))
    pairs = F.collect_list(F.struct("__ls_day", "__ls_val"))
    packed = daily.groupBy(*keys).agg(pairs.alias("__ls_pairs"))
    return packed.select(*keys, F.col("__ls_pairs.__ls_day").alias(DAYS), F.col("__ls_pairs.__ls_val").alias(VALS))


class Packed:
    """The series of one Arrow batch, flattened: of each reading its series, day and value, in order."""

    def __init__(self, batch: pa.RecordBatch, dtype=np.int64):
        days = batch.column(DAYS)
        self.n = batch.num_rows
        lengths = np.diff(days.offsets.to_numpy())
        of = np.repeat(np.arange(self.n), lengths)
        day = days.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        val = batch.column(VALS).flatten().to_numpy(zero_copy_only=False).astype(dtype)
        order = np.lexsort((day, of))
        self.of, self.day, self.val = of[order], day[order], val[order]
        self.start = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.size = lengths
        self.first = self.day[self.start]
        self.last = self.day[self.start + lengths - 1]

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """Series and day of every cell from the first to the last reading of each series."""
        span = self.last - self.first + 1
        of = np.repeat(np.arange(self.n), span)
        ends = np.cumsum(span)
        return of, np.arange(ends[-1] if self.n else 0) - np.repeat(ends - span, span) + self.first[of]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``CHUNK`` series and about ``CELLS`` calendar days, without empty ones."""
    for b in batches:
        if not b.num_rows:
            continue
        days = b.column(DAYS)
        start = days.offsets.to_numpy()[:-1] - days.offsets.to_numpy()[0]
        flat = days.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.maximum.reduceat(flat, start) - np.minimum.reduceat(flat, start) + 1)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + CHUNK, int(np.searchsorted(ends, before + CELLS, side="right"))))
            yield b.slice(at, to - at)
            at = to


def take_keys(batch: pa.RecordBatch, keys: Sequence[str], of: np.ndarray) -> list[pa.Array]:
    """The key columns repeated for the given series."""
    at = pa.array(of)
    return [batch.column(k).take(at) for k in keys]


def fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


# --- Trailing totals -------------------------------------------------------------------------------------


class SegmentForest:
    """Segment trees of sums and counts over shards of ``shard`` days, one tree per entity and shard.

    The trees of an entity lie side by side, so level k of all trees is one array whose cells hold 2^k days.
    A range of at most ``shard`` days meets only nodes inside single trees; wider ranges go on over the
    roots, of which further levels are built.
    """

    def __init__(self, sums: np.ndarray, counts: np.ndarray, shard: int, width: int):
        self.shard, self.levels = shard, [(sums, counts)]
        self._grow(width)

    def _grow(self, width: int) -> None:
        """Levels until a node is as wide as the widest range."""
        while (1 << (len(self.levels) - 1)) < width and len(self.levels[-1][0]) > 1:
            s, c = self.levels[-1]
            if len(s) % 2:
                s, c = np.append(s, 0), np.append(c, 0)
            self.levels.append((s[0::2] + s[1::2], c[0::2] + c[1::2]))

    @classmethod
    def of_heaps(cls, sums: np.ndarray, counts: np.ndarray, shard: int, width: int) -> SegmentForest:
        """The forest over shards whose trees are there as heaps, side by side; only levels above the roots are built."""
        out = cls.__new__(cls)
        out.shard, out.levels = shard, []
        for k in range(shard.bit_length()):
            size = shard >> k
            out.levels.append((sums[:, size : 2 * size].ravel(), counts[:, size : 2 * size].ravel()))
        out._grow(width)
        return out

    def query(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count over the leaves lo to hi-1 of each query, in logarithmic many steps."""
        lo, hi = lo.copy(), hi.copy()
        total = np.zeros(len(lo), dtype=self.levels[0][0].dtype)
        count = np.zeros(len(lo), dtype=np.int64)
        for s, c in self.levels:
            left = np.flatnonzero((lo & 1) & (lo < hi))
            at = lo[left]
            total[left] += s[at]
            count[left] += c[at]
            lo[left] += 1
            right = np.flatnonzero((hi & 1) & (lo < hi))
            hi[right] -= 1
            at = hi[right]
            total[right] += s[at]
            count[right] += c[at]
            lo >>= 1
            hi >>= 1
            if not (lo < hi).any():
                break
        return total, count

    def heaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Each shard's tree as a heap: node 1 is the root, the leaves are the nodes from ``shard`` on."""
        n = len(self.levels[0][0]) // self.shard
        out = []
        for part in (0, 1):
            heap = np.zeros((n, 2 * self.shard), dtype=self.levels[0][part].dtype)
            for k in range(self.shard.bit_length()):
                width = self.shard >> k
                heap[:, width : 2 * width] = self.levels[k][part][: n * width].reshape(n, width)
            out.append(heap)
        return out[0], out[1]


def forest(p: Packed, shard: int, width: int) -> tuple[SegmentForest, np.ndarray, np.ndarray, np.ndarray]:
    """The trees of a batch; per series its first shard and first leaf, and per shard its series."""
    s0, s1 = p.first // shard, p.last // shard
    n = s1 - s0 + 1
    base = (np.cumsum(n) - n) * shard
    leaf = base[p.of] + p.day - s0[p.of] * shard
    sums = np.zeros(n.sum() * shard, dtype=p.val.dtype)
    counts = np.zeros(n.sum() * shard, dtype=np.int64)
    sums[leaf], counts[leaf] = p.val, 1
    return SegmentForest(sums, counts, shard, width), s0, base, np.repeat(np.arange(p.n), n)


def _exact(kind: T.DataType) -> tuple[T.DataType, type, pa.DataType]:
    """Integers are summed as such, all else as doubles."""
    whole = isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    return (T.LongType(), np.int64, pa.int64()) if whole else (T.DoubleType(), np.float64, pa.float64())


def trailing_totals(
    df: DataFrame, keys: Sequence[str], date: str, value: str, windows: Sequence[int] = (7, 30), shard_days: int = 64
) -> DataFrame:
    """Totals over trailing periods for every entity and calendar day from its first to its last reading.

    Columns: ``keys``, ``day`` DATE, ``value`` (null on days without a reading) and for each window w
    ``sum_w``, ``n_w`` (days with a reading) and ``avg_w`` (null where n_w is 0). The day itself is included.
    ``shard_days`` must be a power of two. An entity without a reading has no rows; an empty input gives none.
    """
    if shard_days & (shard_days - 1) or min(windows) < 1:
        raise ValueError("shard_days must be a power of two and windows positive")
    kind, dtype, arrow = _exact(df.schema[value].dataType)
    out = fields(df, keys) + [T.StructField("day", T.DateType()), T.StructField("value", kind)]
    for w in windows:
        out += [T.StructField(f"sum_{w}", kind), T.StructField(f"n_{w}", T.IntegerType())]
    keys, windows = list(keys), list(windows)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p = Packed(b, dtype)
            trees, s0, base, _ = forest(p, shard_days, max(windows))
            yield _trailing(b, keys, trees, s0, base, p.first, p.last, windows, arrow, out)

    totals = pack_series(df, keys, date, value).mapInArrow(kernel, T.StructType(out))
    return _averages(totals, windows)


def _trailing(b: pa.RecordBatch, keys, trees: SegmentForest, s0, base, first, last, windows, arrow, out) -> pa.RecordBatch:
    """The answers of every window on every calendar day of the series of a batch, by range queries on their trees."""
    span = last - first + 1
    of = np.repeat(np.arange(len(span)), span)
    day = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + first[of]
    leaf = base[of] + day - s0[of] * trees.shard
    sums, counts = trees.levels[0]
    cols = [*take_keys(b, keys, of), pa.array(day.astype(np.int32)).cast(pa.date32())]
    cols.append(pa.array(sums[leaf], mask=counts[leaf] == 0, type=arrow))
    for w in windows:
        lo = np.maximum(leaf - w + 1, base[of])
        total, n = trees.query(lo, leaf + 1)
        cols += [pa.array(total, type=arrow), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, names=[f.name for f in out])


def _averages(totals: DataFrame, windows: Sequence[int]) -> DataFrame:
    return totals.withColumns({f"avg_{w}": F.when(F.col(f"n_{w}") > 0, F.col(f"sum_{w}").cast("double") / F.col(f"n_{w}")) for w in windows})


def segment_trees(df: DataFrame, keys: Sequence[str], date: str, value: str, shard_days: int = 64) -> DataFrame:
    """The trees as a table to keep: ``keys``, ``shard`` (days since 1970 // shard_days), ``sums`` and ``counts`` as heaps."""
    kind, dtype, arrow = _exact(df.schema[value].dataType)
    out = fields(df, keys) + [
        T.StructField("shard", T.LongType()),
        T.StructField("sums", T.ArrayType(kind)),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
    keys = list(keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p = Packed(b, dtype)
            trees, s0, base, of = forest(p, shard_days, shard_days)
            sums, counts = trees.heaps()
            shard = s0[of] + np.arange(len(of)) - base[of] // shard_days
            ends = pa.array(np.arange(len(of) + 1, dtype=np.int32) * 2 * shard_days)
            heaps = [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), type=t)) for x, t in ((sums, arrow), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*take_keys(b, keys, of), pa.array(shard), *heaps], names=[f.name for f in out])

    return pack_series(df, keys, date, value).mapInArrow(kernel, T.StructType(out))


def correct_trees(trees: DataFrame, corrections: DataFrame, keys: Sequence[str], date: str, value: str, shard_days: int = 64) -> DataFrame:
    """The changed trees only, after late corrections (``keys``, date, value); a null value takes the reading of that day away.

    Only shards named by a correction are read on, and in them only the leaf and its ancestors change, log2(shard)+1
    nodes for a correction. Of several corrections of one day the highest counts, a removal last. A shard
    without a tree gets one. ``with_corrections`` puts the changed trees in the place of the old ones.
    """
    c = corrections.select(*keys, F.unix_date(F.col(date)).cast("long").alias("__ls_day"), F.col(value).alias("__ls_val"))
    c = c.dropna(subset=[*keys, "__ls_day"])
    c = c.groupBy(*keys, "__ls_day").agg(F.max("__ls_val").alias("__ls_val"))
    c = c.withColumn("shard", F.floor(F.col("__ls_day") / shard_days))
    c = c.groupBy(*keys, "shard").agg(F.collect_list((F.col("__ls_day") - F.col("shard") * shard_days).cast("int")).alias("__ls_off"), F.collect_list(F.struct("__ls_val")).alias("__ls_new"))
    both = c.join(trees, [*keys, "shard"], "left")
    _, dtype, arrow = _exact(trees.schema["sums"].dataType.elementType)
    schema, width = trees.schema, 2 * shard_days
    names = schema.names

    def dense(column: pa.ListArray, kind: type) -> np.ndarray:
        out = np.zeros((len(column), width), dtype=kind)
        there = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
        if len(there):
            out[there] = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(len(there), width)
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sums, counts = dense(b.column("sums"), dtype), dense(b.column("counts"), np.int64)
            off = b.column("__ls_off")
            row = np.repeat(np.arange(b.num_rows), np.diff(off.offsets.to_numpy()))
            new = b.column("__ls_new").flatten().field(0)
            has = ~new.is_null().to_numpy(zero_copy_only=False)
            node = shard_days + off.flatten().to_numpy().astype(np.int64)
            plus = np.where(has, new.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(dtype) - sums[row, node]
            more = has.astype(np.int64) - counts[row, node]
            while node[0]:  # all leaves are as deep
                np.add.at(sums, (row, node), plus)
                np.add.at(counts, (row, node), more)
                node >>= 1
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width)
            cols = {"sums": pa.ListArray.from_arrays(ends, pa.array(sums.ravel(), type=arrow)), "counts": pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))}
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else b.column(n) for n in names], names=names)

    return both.mapInArrow(kernel, schema)


def with_corrections(trees: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All trees, the changed ones in the place of the old; a store partitioned by shard rewrites the named partitions only."""
    return trees.join(changed.select(*keys, "shard"), [*keys, "shard"], "left_anti").unionByName(changed)


def totals_of_trees(trees: DataFrame, keys: Sequence[str], windows: Sequence[int] = (7, 30), shard_days: int = 64) -> DataFrame:
    """What trailing_totals gives, by range queries on stored trees: their nodes are used as they are, none is summed again."""
    kind, dtype, arrow = _exact(trees.schema["sums"].dataType.elementType)
    out = fields(trees, keys) + [T.StructField("day", T.DateType()), T.StructField("value", kind)]
    for w in windows:
        out += [T.StructField(f"sum_{w}", kind), T.StructField(f"n_{w}", T.IntegerType())]
    keys, windows, width = list(keys), list(windows), 2 * shard_days
    # The shards of an entity side by side. ``__ls_days`` bounds what a kernel takes at once, as for series.
    held = F.array_sort(F.collect_list(F.struct("shard", "sums", "counts")))
    packed = trees.where(F.get("counts", F.lit(1)) > 0).groupBy(*keys).agg(held.alias("t"))
    packed = packed.select(*keys, F.transform("t", lambda x: (x["shard"] * shard_days).cast("int")).alias(DAYS), F.flatten("t.sums").alias("__ls_sums"), F.flatten("t.counts").alias("__ls_counts"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            days = b.column(DAYS)
            number = np.diff(days.offsets.to_numpy())
            shard = days.flatten().to_numpy().astype(np.int64) // shard_days
            of, end = np.repeat(np.arange(b.num_rows), number), np.cumsum(number)
            s0, s1 = shard[end - number], shard[end - 1]
            n = s1 - s0 + 1
            first_slot = np.cumsum(n) - n
            slot = first_slot[of] + shard - s0[of]
            heaps = []
            for name, k in (("__ls_sums", dtype), ("__ls_counts", np.int64)):
                heap = np.zeros((n.sum(), width), dtype=k)
                heap[slot] = b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                heaps.append(heap)
            grown = SegmentForest.of_heaps(*heaps, shard_days, max(windows))
            base = first_slot * shard_days
            there = np.flatnonzero(grown.levels[0][1])
            owner = np.searchsorted(base, there, side="right") - 1
            day = there - base[owner] + s0[owner] * shard_days
            first, last = np.full(b.num_rows, np.iinfo(np.int64).max), np.full(b.num_rows, np.iinfo(np.int64).min)
            np.minimum.at(first, owner, day)
            np.maximum.at(last, owner, day)
            yield _trailing(b, keys, grown, s0, base, first, last, windows, arrow, out)

    return _averages(packed.mapInArrow(kernel, T.StructType(out)), windows)


# --- Spikes, stuck values, impossible readings -----------------------------------------------------------


def kalman_flags(
    p: Packed, threshold: float = 6.0, ratio: float = 0.5, spike_days: int = 2, stuck_run: int = 7, floor: float = 1.0, step: float = 4.0, steady: int = 2,
    longest_gap: float = 4.0, calm: int = 3, quiet: float = 0.1,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of the readings of a batch: spike, stuck, and the standardised innovation.

    A local level model per series, all series of the batch at once: level' = level + N(0, ratio*r) for each
    usual distance of its readings (``longest_gap`` of them at most, unless a return is waited for), reading =
    level + N(0, r). r comes from the
    median absolute difference of successive readings, so that neither spikes nor shifts inflate it. A reading
    whose innovation exceeds ``threshold`` standard deviations is withheld from the update. If the series is
    back within the bounds before more than ``spike_days`` days went by, the withheld readings are spikes;
    otherwise the level itself moved and the filter starts again from the newest reading. A spike also has to
    stand ``step`` times the usual difference clear of the readings at both its ends and keep one height, unlike
    a rise that builds up; and ``steady`` readings must have settled the level it leaves.
    Where the variance of the standardised innovations over the last ``calm`` readings vanishes (below ``quiet``, when
    around 1 is usual), the series may be stuck: its level has come to rest on the readings. The run of readings
    about such a place is stuck if it holds one value ``stuck_run`` times on end.
    """
    n, total = p.n, len(p.of)
    spike, stuck, z = np.zeros(total, bool), np.zeros(total, bool), np.zeros(total)
    if not total:
        return spike, stuck, z
    y = p.val.astype(np.float64)
    diff = np.abs(np.diff(y, append=np.nan))
    diff[p.start + p.size - 1] = np.nan
    # The median of |difference| per series, by sorting within the series.
    order = np.lexsort((diff, p.of))
    mid = np.maximum(p.size - 1, 1)
    a, b = diff[order[p.start + (mid - 1) // 2]], diff[order[p.start + mid // 2]]
    sd = np.maximum(1.4826 * np.nan_to_num((a + b) / 2), floor)
    r = sd**2 / (2 + ratio)
    # The usual distance of readings in days, found likewise.
    gaps = np.diff(p.day, append=0).astype(np.float64)
    gaps[p.start + p.size - 1] = np.nan
    order = np.lexsort((gaps, p.of))
    usual = np.maximum(np.nan_to_num(gaps[order[p.start + (mid - 1) // 2]]), 1)
    # Start: the median of the first five readings.
    k = np.arange(5)
    head = np.where(k < p.size[:, None], y[np.minimum(p.start[:, None] + k, total - 1)], np.nan)
    level, var = np.nanmedian(head, axis=1), r.copy()
    held, held_from, last_day = np.zeros(n, np.int64), np.zeros(n, np.int64), p.first - 1
    settled = np.full(n, steady)  # readings taken in since the filter started again
    by_length = np.argsort(-p.size, kind="stable")
    alive = np.searchsorted(-p.size[by_length], -np.arange(1, p.size.max() + 1), side="right")
    for t in range(p.size.max()):
        s = by_length[: alive[t]]
        i = p.start[s] + t
        gap = np.maximum((p.day[i] - last_day[s]) / usual[s], 1)
        pred = var[s] + ratio * r[s] * np.where(held[s] > 0, gap, np.minimum(gap, longest_gap))
        inn = y[i] - level[s]
        score = inn / np.sqrt(pred + r[s])
        z[i] = score
        out = np.abs(score) > threshold
        ok = ~out
        # Back in bounds: what was withheld before stands alone.
        back = s[ok & (held[s] > 0)]
        if len(back):
            f, e = held_from[back], p.start[back] + t
            short = p.day[e - 1] - p.day[f] < spike_days
            edge = np.maximum(f - 1, p.start[back])
            clear = (settled[back] >= steady) & (np.abs(y[f] - y[edge]) > step * sd[back]) & (np.abs(y[e] - y[e - 1]) > step * sd[back]) & (f > p.start[back])
            for width in range(1, spike_days):  # a second large step the same way is a rise that builds up
                on = y[np.minimum(f + width, total - 1)] - y[f + width - 1]
                clear &= (f + width >= e) | (on * np.sign(y[f] - y[edge]) <= step * sd[back])
            for width in range(spike_days):
                on = short & clear & (f + width < e)
                spike[f[on] + width] = True
            held[back] = 0
        settled[s] += ok
        gain = pred / (pred + r[s])
        level[s] = np.where(ok, level[s] + gain * inn, level[s])
        var[s] = np.where(ok, (1 - gain) * pred, pred)
        last_day[s] = p.day[i]
        new = s[out]
        fresh = held[new] == 0
        held_from[new[fresh]] = p.start[new[fresh]] + t
        held[new] += 1
        lasting = new[p.day[p.start[new] + t] - p.day[held_from[new]] >= spike_days]
        at = p.start[lasting] + t
        level[lasting], var[lasting], held[lasting] = y[at], r[lasting], 0
        # Withheld readings that agree have settled the new level already.
        near = np.abs(y[at] - y[np.maximum(at - 1, 0)]) <= step * sd[lasting]
        settled[lasting] = np.where(near, 1 + (np.abs(y[at] - y[np.maximum(at - 2, 0)]) <= step * sd[lasting]), 0)
    # Vanishing variance of the innovations, and the run of readings it comes to rest on.
    place = np.arange(total) - p.start[p.of]
    power = np.concatenate(([0.0], np.cumsum(z * z)))
    at = np.arange(total)
    still = (place >= calm - 1) & (power[at + 1] - power[np.maximum(at + 1 - calm, 0)] < calm * quiet)
    fresh = (place == 0) | (np.diff(y, prepend=np.nan) != 0)
    run = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    late = at - begin[run] >= stuck_run - 1  # the seventh reading of one value, or one after it
    stuck = (np.bincount(run, weights=still & late) > 0)[run]
    return spike, stuck, z


def flag_series(
    df: DataFrame, keys: Sequence[str], date: str, value: str, low: float | None = None, high: float | None = None, **model: float
) -> DataFrame:
    """One row per entity and day with a reading: ``keys``, ``day``, ``value``, ``spike``, ``stuck``, ``score``.

    Readings outside [low, high] are no readings here; ``flag_rows`` reports them. See kalman_flags for the
    model's parameters. Series of fewer than two readings get no flags.
    """
    inside = _inside(F.col(value), low, high)
    kind, dtype, arrow = _exact(df.schema[value].dataType)
    out = fields(df, keys) + [T.StructField("day", T.DateType()), T.StructField("value", kind), T.StructField("spike", T.BooleanType()), T.StructField("stuck", T.BooleanType()), T.StructField("score", T.DoubleType())]
    keys = list(keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p = Packed(b, dtype)
            spike, stuck, z = kalman_flags(p, **model)
            cols = [*take_keys(b, keys, p.of), pa.array(p.day.astype(np.int32)).cast(pa.date32()), pa.array(p.val, type=arrow), pa.array(spike), pa.array(stuck), pa.array(z)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out])

    return pack_series(df.where(inside), keys, date, value).mapInArrow(kernel, T.StructType(out))


def _inside(c: Column, low: float | None, high: float | None) -> Column:
    ok = c.isNotNull()
    if low is not None:
        ok &= c >= low
    if high is not None:
        ok &= c <= high
    return ok


def flag_rows(
    df: DataFrame, id_col: str, keys: Sequence[str], date: str, value: str, low: float | None, high: float | None, **model: float
) -> DataFrame:
    """The rows with an implausible value: ``id_col`` and ``reason`` (impossible, spike, stuck).

    Every row that holds the flagged value on the flagged day is reported; a row that is both spike and
    stuck is reported as a spike. Rows with a null key, date or value are never reported.
    """
    rows = df.dropna(subset=[*keys, date, value])
    inside = _inside(F.col(value), low, high)
    impossible = rows.where(~inside).select(id_col, F.lit("impossible").alias("reason"))
    flags = flag_series(rows, keys, date, value, low, high, **model).where("spike or stuck")
    flags = flags.select(*keys, F.col("day").alias("__ls_day"), F.col("value").alias("__ls_val"), F.when(F.col("spike"), "spike").otherwise("stuck").alias("reason"))
    held = rows.where(inside).select(id_col, *keys, F.col(date).cast("date").alias("__ls_day"), F.col(value).cast(flags.schema["__ls_val"].dataType).alias("__ls_val"))
    return impossible.unionByName(held.join(flags, [*keys, "__ls_day", "__ls_val"]).select(id_col, "reason"))


# --- Regular grids ---------------------------------------------------------------------------------------


class Block:
    """Sources of one group as rows of a matrix whose columns are the days on which the group has a reading."""

    def __init__(self, p: Packed, columns: np.ndarray):
        self.p, self.columns = p, columns
        x = np.zeros((p.n, len(columns)))
        self.m = np.zeros((p.n, len(columns)))
        at = np.searchsorted(columns, p.day)
        x[p.of, at], self.m[p.of, at] = p.val, 1.0
        count = np.maximum(self.m.sum(1), 1)
        self.mean = x.sum(1) / count
        self.c = (x - self.mean[:, None]) * self.m
        self.scale = np.sqrt((self.c * self.c).sum(1) / count)
        self.scale[self.scale == 0] = 1
        self.c /= self.scale[:, None]

    def sources(self, v: np.ndarray, ridge: float) -> np.ndarray:
        """The factors of the sources under those of the days, by ridge regressions over the cells that are seen."""
        rank = v.shape[1]
        grams = (self.m @ (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)).reshape(-1, rank, rank)
        return np.linalg.solve(grams + ridge * np.eye(rank), (self.c @ v)[:, :, None])[:, :, 0]

    def sums(self, v: np.ndarray, ridge: float) -> np.ndarray:
        """What the factors of the days are solved from: of each day the sums of u u' and of u x over these sources, side by side."""
        u = self.sources(v, ridge)
        return np.hstack([self.m.T @ (u[:, :, None] * u[:, None, :]).reshape(len(u), -1), self.c.T @ u])

    def estimates(self, v: np.ndarray, ridge: float) -> np.ndarray:
        """The low-rank matrix, and on it what it leaves of a source's readings, carried over the days between them."""
        low = self.sources(v, ridge) @ v.T
        for k in range(len(low)):
            seen = np.flatnonzero(self.m[k])
            if len(seen):
                low[k] += np.interp(self.columns, self.columns[seen], (self.c[k] - low[k])[seen])
        return self.mean[:, None] + self.scale[:, None] * low


def first_days(t: int, rank: int) -> np.ndarray:
    """Factors of the days to start from: smooth waves over the time axis, alike in every run."""
    return np.cos(np.pi * np.outer(np.arange(t) + 0.5, np.arange(1, rank + 1)) / max(t, 1))


def solved_days(sums: np.ndarray, rank: int, ridge: float) -> np.ndarray:
    """The factors of the days from their sums over all sources."""
    grams = sums[:, : rank * rank].reshape(-1, rank, rank)
    return np.linalg.solve(grams + ridge * np.eye(rank), sums[:, rank * rank :][:, :, None])[:, :, 0]


def _fills(block: Block, v: np.ndarray, seen: np.ndarray, ridge: float, min_row: int, min_column: int, low: float | None, high: float | None) -> tuple[pa.ListArray, pa.ListArray]:
    """Of each source the supported missing days between its first and last reading, and their estimates. ``seen``: readings of a day."""
    p, days = block.p, block.columns
    inside = (days >= p.first[:, None]) & (days <= p.last[:, None])
    row, at = np.nonzero(inside & (block.m == 0) & (p.size >= min_row)[:, None] & (seen >= min_column))
    est = block.estimates(v, ridge)[row, at]
    if low is not None or high is not None:
        est = np.clip(est, low, high)
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=p.n)))).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(days[at].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(est))


FILL_DAYS, FILL_VALS = "__ls_fill_days", "__ls_fill_vals"


def regular_grid(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    value: str,
    group: Sequence[str] = (),
    low: float | None = None,
    high: float | None = None,
    rank: int = 2,
    ridge: float = 10.0,
    rounds: int = 6,
    block: int = 256,
    min_row: int = 5,
    min_column: int = 2,
    shared: Callable[[DataFrame], DataFrame] = lambda x: x,
) -> DataFrame:
    """One row per entity and calendar day from its first to its last reading, missing days filled or marked.

    Columns: ``keys``, ``day``, ``value`` DOUBLE and ``status``: ``observed`` (the reading, exact), ``filled``
    (estimated by low-rank factorisation of the source-by-time matrix) or ``unsupported`` (null).

    Sources that share ``group`` form one matrix, factored by alternating least squares. A group of more than ``block``
    sources is cut into blocks, so no task holds a hot group: blocks solve their sources' factors, and the factors of the
    days are solved from sums over all blocks; the result is that of the whole matrix. A missing cell is supported if its
    source has ``min_row`` readings and its day ``min_column`` readings of other sources. Estimates are clipped to
    [low, high]; what the low-rank part leaves of a source's own readings is carried over the days between them. ``shared`` makes tables durable that are read more than once.
    """
    keys, group = list(keys), list(group)
    inside = _inside(F.col(value), low, high)
    series = shared(pack_series(df.where(inside), keys, date, value))
    own = [F.col(g).alias(f"__ls_g{k}") for k, g in enumerate(group)] or [F.lit(0).alias("__ls_g0")]
    by = [f"__ls_g{k}" for k in range(max(1, len(group)))]
    series = series.select(*keys, DAYS, VALS, *own)
    sizes = shared(series.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__ls_blocks")))
    out = fields(df, keys) + [T.StructField(DAYS, T.ArrayType(T.IntegerType())), T.StructField(VALS, series.schema[VALS].dataType), T.StructField(FILL_DAYS, T.ArrayType(T.IntegerType())), T.StructField(FILL_VALS, T.ArrayType(T.DoubleType()))]
    packed = T.StructType(out)
    limits = (ridge, min_row, min_column, low, high)

    def filled(t: pa.Table, columns: np.ndarray, seen: np.ndarray, v: np.ndarray) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        fills = _fills(Block(Packed(b, np.float64), columns), v, seen, *limits)
        return pa.Table.from_arrays([*(b.column(n) for n in (*keys, DAYS, VALS)), *fills], names=packed.names)

    def whole(t: pa.Table) -> pa.Table:
        p = Packed(t.combine_chunks().to_batches()[0], np.float64)
        columns, seen = np.unique(p.day, return_counts=True)
        matrix, v = Block(p, columns), first_days(len(columns), rank)
        for _ in range(rounds):
            v = solved_days(matrix.sums(v, ridge), rank, ridge)
        return filled(t, columns, seen, v)

    sized = series.join(sizes, by)
    done = sized.where("__ls_blocks = 1").groupBy(*by).applyInArrow(whole, packed)
    if not sizes.where("__ls_blocks > 1").isEmpty():
        large = shared(sized.where("__ls_blocks > 1").withColumn("__ls_block", F.pmod(F.xxhash64(*keys), F.col("__ls_blocks")).cast("int")).drop("__ls_blocks"))
        done = done.unionByName(_large_groups(large, by, filled, packed, rank, ridge, rounds, shared))
    return _laid_out(done, keys, fields(df, keys))


def _large_groups(series: DataFrame, by: list[str], filled: Callable, packed: T.StructType, rank: int, ridge: float, rounds: int, shared: Callable) -> DataFrame:
    """The rows of groups of several blocks: the days' factors from sums over all blocks, round by round."""
    width = rank * rank + rank
    names = [f"s{k}" for k in range(width)]
    kinds = [series.schema[c] for c in by]
    partial = T.StructType([*kinds, T.StructField("day", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    axis = series.select(*by, F.explode(DAYS).alias("day")).groupBy(*by, "day").agg(F.count(F.lit(1)).alias("seen"))
    axis = shared(axis.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("day", "seen"))).alias("a")).select(*by, F.col("a.day").alias("days"), F.col("a.seen").alias("seen")))
    blocks = shared(series.select(*by, "__ls_block").distinct())

    @F.pandas_udf("array<double>")
    def begin(days: pd.Series) -> pd.Series:
        return days.map(lambda d: first_days(len(d), rank).ravel())

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        return sums.map(lambda s: solved_days(np.array(list(s), dtype=float).reshape(-1, width), rank, ridge).ravel())

    def axis_of(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        days, seen = (np.array(right.column(c)[0].as_py(), dtype=np.int64) for c in ("days", "seen"))
        return days, seen, np.array(right.column("v")[0].as_py()).reshape(len(days), rank)

    def summed(key, left: pa.Table, right: pa.Table) -> pa.Table:
        days, _, v = axis_of(right)
        sums = Block(Packed(left.combine_chunks().to_batches()[0], np.float64), days).sums(v, ridge)
        of = [pa.array([k.as_py()] * len(days), k.type) for k in key[: len(by)]]
        return pa.Table.from_arrays([*of, pa.array(days.astype(np.int32)), *(pa.array(sums[:, k]) for k in range(width))], names=partial.names)

    def last(key, left: pa.Table, right: pa.Table) -> pa.Table:
        days, seen, v = axis_of(right)
        return filled(left, days, seen, v)

    spot = [*by, "__ls_block"]
    other = [f"__ls_o{k}" for k in range(len(spot))]  # names of their own, as both sides come from one table

    def sent(factors: DataFrame):
        return blocks.join(factors, by).select(*[F.col(c).alias(o) for c, o in zip(spot, other)], "days", "seen", "v").groupBy(*other)

    factors = axis.withColumn("v", begin("days"))
    for _ in range(rounds):
        sums = series.groupBy(*spot).cogroup(sent(factors)).applyInArrow(summed, partial)
        sums = sums.groupBy(*by, "day").agg(*(F.sum(n).alias(n) for n in names))
        lists = F.array_sort(F.collect_list(F.struct("day", F.array(*names).alias("s"))))
        each = sums.groupBy(*by).agg(lists.alias("x")).select(*by, solve(F.flatten("x.s")).alias("v"))
        factors = shared(axis.join(each, by))
    return series.groupBy(*spot).cogroup(sent(factors)).applyInArrow(last, packed)


def _laid_out(done: DataFrame, keys: list[str], kinds: list[T.StructField]) -> DataFrame:
    """The grid of packed series: observed, filled and unsupported days."""
    out = [*kinds, T.StructField("day", T.DateType()), T.StructField("value", T.DoubleType()), T.StructField("status", T.StringType())]
    names, status = [f.name for f in out], pa.array(["observed", "filled", "unsupported"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p = Packed(b, np.float64)
            of, day = p.grid()
            span = p.last - p.first + 1
            start = np.cumsum(span) - span
            kind, cells = np.full(len(of), 2), np.zeros(len(of))
            at = start[p.of] + p.day - p.first[p.of]
            kind[at], cells[at] = 0, p.val
            fills = b.column(FILL_DAYS)
            row = np.repeat(np.arange(p.n), np.diff(fills.offsets.to_numpy()))
            at = start[row] + fills.flatten().to_numpy().astype(np.int64) - p.first[row]
            kind[at], cells[at] = 1, b.column(FILL_VALS).flatten().to_numpy()
            cols = [*take_keys(b, keys, of), pa.array(day.astype(np.int32)).cast(pa.date32()), pa.array(cells, mask=kind == 2), status.take(pa.array(kind))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return done.mapInArrow(kernel, T.StructType(out))
