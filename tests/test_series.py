"""Series operators against plain Python."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.operators import series as S

D0 = dt.date(2024, 1, 1)
SCHEMA = "board string, city string, date date, aqi int, day int"


def rows_of(spec):
    return [(b, c, None if d is None else D0 + dt.timedelta(d), v, 7) for b, c, d, v in spec]


def frame(spark, spec):
    return spark.createDataFrame(rows_of(spec), SCHEMA)


def packed(series):
    """Packed from lists of (day, value)."""
    days = pa.array([[d for d, _ in s] for s in series], pa.list_(pa.int32()))
    vals = pa.array([[v for _, v in s] for s in series], pa.list_(pa.int32()))
    return S.Packed(pa.RecordBatch.from_arrays([days, vals], names=[S.DAYS, S.VALS]))


def brute_totals(spec, windows):
    best = {}
    for b, c, d, v in spec:
        if None not in (b, c, d, v):
            best.setdefault((b, c), {}).setdefault(d, []).append(v)
    out = {}
    for key, days in best.items():
        day = {d: max(v) for d, v in days.items()}
        for d in range(min(day), max(day) + 1):
            out[(*key, D0 + dt.timedelta(d))] = (day.get(d), *(x for w in windows for x in (sum(day.get(e, 0) for e in range(d - w + 1, d + 1)), sum(e in day for e in range(d - w + 1, d + 1)))))
    return out


def test_trailing_totals_match_brute_force(spark):
    rnd = random.Random(3)
    spec = [(f"b{rnd.randrange(3)}", f"c{rnd.randrange(3)}", rnd.choice([None, *range(200)]), rnd.choice([None, *range(500)])) for _ in range(700)]
    spec += [(None, "c0", 3, 9), ("b0", None, 3, 9), ("solo", "c", 5, 1)] + [("b0", "c0", 7, 499)] * 50
    got = S.trailing_totals(frame(spark, spec), ["board", "city"], "date", "aqi", (7, 30, 90)).collect()
    want = brute_totals(spec, (7, 30, 90))
    assert {(r.board, r.city, r.day): (r.value, r.sum_7, r.n_7, r.sum_30, r.n_30, r.sum_90, r.n_90) for r in got} == want
    assert all((r.avg_7 is None) == (r.n_7 == 0) for r in got)


def test_trailing_totals_of_nothing(spark):
    empty = frame(spark, [])
    assert S.trailing_totals(empty, ["board", "city"], "date", "aqi").count() == 0
    assert S.trailing_totals(frame(spark, [("b", "c", None, 1)]), ["board", "city"], "date", "aqi").count() == 0
    with pytest.raises(ValueError):
        S.trailing_totals(empty, ["board"], "date", "aqi", shard_days=48)


@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 130))
@settings(max_examples=60, deadline=None)
def test_forest_ranges(days, width):
    values = {d: d * 7 % 50 for d in days}
    p = packed([sorted(values.items())])
    trees, s0, base, _ = S.forest(p, 32, width)
    hi = np.arange(0, len(trees.levels[0][0])) + 1
    lo = np.maximum(hi - width, 0)
    total, n = trees.query(lo, hi)
    dense = np.zeros(len(hi), dtype=int)
    for d, v in values.items():
        dense[d - s0[0] * 32] = v
    assert total.tolist() == [dense[a:b].sum() for a, b in zip(lo, hi)]


def test_corrections_update_ancestors_only(spark):
    keys = ["board", "city"]
    spec = [("b", "c", d, d) for d in range(0, 150, 3)]
    trees = S.segment_trees(frame(spark, spec), keys, "date", "aqi", 32)
    late = frame(spark, [("b", "c", 3, 100), ("b", "c", 4, 50), ("b", "c", 6, None), ("new", "c", 1, 9), ("b", "c", None, 1)])
    changed = S.correct_trees(trees, late, keys, "date", "aqi", 32)
    after = S.with_corrections(trees, changed, keys)
    fresh = S.segment_trees(frame(spark, [x for x in spec if x[2] not in (3, 6)] + [("b", "c", 3, 100), ("b", "c", 4, 50), ("new", "c", 1, 9)]), keys, "date", "aqi", 32)
    as_set = lambda df: {(r.board, r.city, r.shard, tuple(r.sums), tuple(r.counts)) for r in df.collect()}
    assert as_set(after) == as_set(fresh)
    # Only the shards that a correction names are written anew, and in them only leaves and their ancestors differ.
    old = {r.shard: r for r in trees.collect()}
    new = changed.collect()
    assert {(r.board, (D0.toordinal() - 719163 + 3) // 32 == r.shard or r.board == "new") for r in new} == {("b", True), ("new", True)}
    for r in new:
        if r.board == "b":
            nodes = {(32 + (D0.toordinal() - 719163 + d) % 32) >> k for d in (3, 4, 6) for k in range(6)}
            assert all(r.sums[n] == old[r.shard].sums[n] for n in range(64) if n not in nodes)


@pytest.mark.parametrize("shard", [8, 64])
def test_totals_of_stored_trees(spark, shard):
    rnd, keys = random.Random(shard), ["board", "city"]
    spec = [(f"b{rnd.randrange(2)}", f"c{rnd.randrange(2)}", rnd.randrange(300), rnd.randrange(500)) for _ in range(200)]
    days = [(b, c, d) for b, c, d, _ in spec]
    late = [(*rnd.choice(days), rnd.choice([None, 7, 480])) for _ in range(20)] + [("b9", "c9", 5, 3), ("b0", "c0", 299, None)]
    trees = S.segment_trees(frame(spark, spec), keys, "date", "aqi", shard)
    after = S.with_corrections(trees, S.correct_trees(trees, frame(spark, late), keys, "date", "aqi", shard), keys)
    best = {}
    for b, c, d, v in spec:
        best[b, c, d] = max(v, best.get((b, c, d), -1))
    taken = {}
    for b, c, d, v in late:
        taken.setdefault((b, c, d), []).append(v)
    for k, vs in taken.items():
        best[k] = max((v for v in vs if v is not None), default=None)
    want = brute_totals([(*k, v) for k, v in best.items() if v is not None], (7, 30))
    got = {(r.board, r.city, r.day): (r.value, r.sum_7, r.n_7, r.sum_30, r.n_30) for r in S.totals_of_trees(after, keys, (7, 30), shard).collect()}
    assert got == want
    assert S.totals_of_trees(trees.where("shard < 0"), keys, (7,), shard).count() == 0


def test_a_stray_date_makes_no_task_large(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 500)
    seen = []
    whole = S.Packed
    p = [[(0, 1), (400_000, 2)], [(5, 1)], [(5, 1), (300, 2)], [(7, 3), (300, 4)], [(1, 1)]]
    days = pa.array([[d for d, _ in s] for s in p], pa.list_(pa.int32()))
    vals = pa.array([[v for _, v in s] for s in p], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([days, vals], names=[S.DAYS, S.VALS])
    for b in S.chunks(iter([batch.slice(0, 0), batch, batch.slice(2, 2)])):
        seen.append(whole(b).n)
    assert seen == [1, 2, 2, 1, 1]
    spec = [("b", "c", 0, 5), ("b", "c", 40_000, 7)] + [("b", f"d{k}", d, 5) for k in range(3) for d in range(20)]
    got = S.trailing_totals(frame(spark, spec), ["board", "city"], "date", "aqi")
    assert got.count() == 40_001 + 60
    grid = S.regular_grid(frame(spark, spec), ["board", "city"], "date", "aqi", ["board"])
    assert grid.count() == 40_001 + 60 and grid.where("status = 'filled'").count() == 0


def base_series(n=120, level=100, noise=4, seed=1):
    rnd = random.Random(seed)
    return [level + rnd.randint(-noise, noise) for _ in range(n)]


def flags(values, days=None):
    spike, stuck, _ = S.kalman_flags(packed([list(zip(days or range(len(values)), values))]))
    return np.flatnonzero(spike).tolist(), np.flatnonzero(stuck).tolist()


def test_spikes_of_one_and_two_days():
    v = base_series()
    v[40] = 400
    v[80], v[81] = 5, 8
    assert flags(v) == ([40, 80, 81], [])


def test_lasting_changes_and_ramps_are_no_spikes():
    v = base_series()
    assert flags(v[:60] + [x + 200 for x in v[60:]])[0] == []
    assert flags(v[:60] + [x + 200 for x in v[60:64]] + v[64:])[0] == []
    up = v[:60] + [130, 180, 240, 300, 240, 180, 130] + v[67:]
    assert flags(up)[0] == []


def test_stuck_runs_count_readings_not_days():
    v = base_series()
    v[30:37] = [77] * 7
    v[60:66] = [88] * 6
    days = [d + (3 if d > 33 else 0) for d in range(len(v))]
    assert flags(v, days)[1] == list(range(30, 37))


def test_short_series_have_no_flags():
    assert flags([5]) == ([], []) and flags([5, 400]) == ([], [])
    assert S.kalman_flags(packed([]))[0].tolist() == []


def test_flag_rows_reports_every_row_of_the_value(spark):
    v = base_series(60)
    v[30] = 450
    spec = [("b", "c", d, x) for d, x in enumerate(v)] + [("b", "c", 30, 450), ("b", "c", 30, 90), ("b", "c", 31, -7), ("b", None, 1, 900), ("b", "c", None, 900), ("b", "c", 2, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_of(spec))], "row_id long, " + SCHEMA)
    got = {r.row_id: r.reason for r in S.flag_rows(df, "row_id", ["board", "city"], "date", "aqi", 0, 500).collect()}
    assert got == {30: "spike", 60: "spike", 62: "impossible"}


def test_regular_grid_marks_and_fills(spark):
    rnd = random.Random(5)
    wave = [100 + 40 * np.sin(d / 9) for d in range(100)]
    full = {(f"c{k}", d): int(wave[d] * (1 + k / 4) + rnd.randint(-2, 2)) for k in range(8) for d in range(100)}
    gone = {("c3", d) for d in range(40, 46)} | {(f"c{k}", 70) for k in range(8)}
    spec = [("b", c, d, v) for (c, d), v in full.items() if (c, d) not in gone] + [("b", "lone", 5, 9), ("b", "lone", 9, 9)]
    got = S.regular_grid(frame(spark, spec), ["board", "city"], "date", "aqi", ["board"], 0, 500).collect()
    by = {(r.city, (r.day - D0).days): r for r in got}
    assert len(by) == 805 and all(by[k].status == "observed" and by[k].value == v for k, v in full.items() if k not in gone)
    assert all(by["c3", d].status == "filled" and abs(by["c3", d].value - full["c3", d]) < 0.15 * full["c3", d] for d in range(40, 46))
    assert all(by[f"c{k}", 70].status == "unsupported" and by[f"c{k}", 70].value is None for k in range(8))
    assert {by["lone", d].status for d in (6, 7, 8)} == {"unsupported"}
    assert S.regular_grid(frame(spark, []), ["board", "city"], "date", "aqi", ["board"]).count() == 0


def waves(n, seed=5):
    rnd = random.Random(seed)
    return [("b", f"c{k}", d, int(100 + 40 * np.sin(d / 6) * (1 + k % 4) + rnd.randint(-2, 2))) for k in range(n) for d in range(40) if rnd.random() > 0.25]


def test_blocks_are_one_matrix(spark):
    # The same sources as one matrix in one task, and as a matrix of many blocks.
    spec = waves(20)
    run = lambda block: {(r.city, r.day): (r.status, None if r.value is None else round(r.value, 6)) for r in S.regular_grid(frame(spark, spec), ["board", "city"], "date", "aqi", ["board"], 0, 500, rounds=3, block=block).collect()}
    assert run(256) == run(3)


def test_one_source_more_changes_no_status(spark):
    # One day is read by two sources only; sources in other blocks support it all the same.
    def run(n):
        spec = [("b", f"c{k:03d}", d, 50 + d) for k in range(n) for d in range(6) if d != 3 or k in (0, 200)]
        return {(r.city, r.day): r.status for r in S.regular_grid(frame(spark, spec), ["board", "city"], "date", "aqi", ["board"], rounds=1).collect()}

    few, many = run(256), run(257)
    assert {k: many[k] for k in few} == few and sum(v == "filled" for v in many.values()) == 255


def test_factors_fit_a_low_rank_matrix():
    rnd = np.random.default_rng(1)
    full = rnd.random((30, 2)) @ rnd.random((2, 50)) * 100
    seen = rnd.random(full.shape) > 0.3
    days = pa.array([np.flatnonzero(seen[k]).astype(np.int32).tolist() for k in range(30)], pa.list_(pa.int32()))
    vals = pa.array([full[k][seen[k]].tolist() for k in range(30)], pa.list_(pa.float64()))
    p = S.Packed(pa.RecordBatch.from_arrays([days, vals], names=[S.DAYS, S.VALS]), np.float64)
    b, v = S.Block(p, np.arange(50)), S.first_days(50, 3)
    for _ in range(30):
        v = S.solved_days(b.sums(v, 0.01), 3, 0.01)
    assert np.abs(b.estimates(v, 0.01) - full)[~seen].mean() < 0.05 * full.std()


def test_stuck_needs_vanishing_variance_and_one_value():
    v = base_series(80, noise=6, seed=3)
    v[40:47] = [v[40]] * 7
    assert flags(v)[1] == list(range(40, 47))
    near = v[:]
    near[40:47] = [v[40] + k % 2 for k in range(7)]  # quiet, but not one value
    assert flags(near)[1] == []
