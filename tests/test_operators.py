"""Operators on points, segments and logs against plain Python on small tables."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.clean import ts_to_ns
from tidemark.functions.files import base_name
from tidemark.operators import grid, incremental, intervals, late, rolling, small_files, spikes

DAY, HOUR, SEC = 86_400 * 10**9, 3_600 * 10**9, 10**9
T0 = 1_401_667_200 * SEC  # a midnight
POINT = "series string, ts long, seq long, value double, tags map<string,string>, day string, step long, block int, source string, about boolean"
CATALOG = "series string, unit string, step_ms long, lateness_s long, valid_min double, valid_max double, tenant_scope string, step long, lo double"


def points(spark, rows):
    """Points with further columns whose names the operators use inside."""
    return spark.createDataFrame([(s, t, q, v, {}, "x", 1, 2, "y", None) for s, t, q, v in rows], POINT)


def catalog(spark, rows):
    return spark.createDataFrame([(s, None, step, lat, lo, hi, None, 5, 0.0) for s, step, lat, lo, hi in rows], CATALOG)


def random_points(seed, n=400, series=("a", "b", "c"), days=50):
    rnd = random.Random(seed)
    rows = []
    for q in range(n):
        s = rnd.choice(series + ("a",) * 3)
        t = T0 + q * days * DAY // n + rnd.randrange(-3 * HOUR, 3 * HOUR)
        v = rnd.choice([rnd.uniform(-5, 5), 1.0, math.nan, math.inf, None]) if rnd.random() < 0.3 else rnd.uniform(-5, 5)
        rows.append((s, t, q, v))
    rows += rows[:20]
    rows += [(None, T0, 9001, 1.0), ("a", None, 9002, 1.0), ("z", T0, 9003, None)]
    return rows


def finite(v):
    return v is not None and math.isfinite(v)


def test_units_of_time(spark):
    t = 1_401_667_200_123_456_789
    rows = spark.createDataFrame([(t,), (t // 1000,), (t // 10**6,), (t // 10**9,), (None,)], "ts long")
    out = [r[0] for r in rows.select(ts_to_ns(rows.ts)).collect()]
    assert out == [t, t // 1000 * 1000, t // 10**6 * 10**6, t // 10**9 * 10**9, None]


def test_base_names(spark):
    same = ["segments/seg_01_l0.seg", "./segments/seg_01_l0.seg", "segments//seg_01_l0.seg", "segments\\seg_01_l0.seg", " segments/seg_01_l0.seg ", "segments/seg%5F01%5Fl0.seg", "/data/x/segments/seg_01_l0.seg", "seg_01_l0.seg"]
    rows = spark.createDataFrame([(p,) for p in [*same, "a/b+c.seg", "a/100%.seg", None]], "p string")
    out = [r[0] for r in rows.select(base_name(rows.p)).collect()]
    assert out == ["seg_01_l0.seg"] * len(same) + ["b+c.seg", "100%.seg", None]


# ---- rolling totals


def test_rolling_totals(spark):
    rows = random_points(1)
    got = {(r["series"], r["day"]): r for r in rolling.rolling_totals(points(spark, rows), (7, 30)).collect()}
    per = {}
    for s, t, q, v in set(rows):
        if s is not None and t is not None and finite(v):
            per.setdefault(s, {}).setdefault(dt.date(1970, 1, 1) + dt.timedelta(days=t // DAY), []).append(v)
    want = {}
    for s, days in per.items():
        d = min(days)
        while d <= max(days):
            want[s, d] = {w: [v for x, vs in days.items() if 0 <= (d - x).days < w for v in vs] for w in (7, 30)}
            d += dt.timedelta(days=1)
    assert set(got) == set(want)
    for k, w in want.items():
        for n in (7, 30):
            assert got[k][f"points_{n}d"] == len(w[n]) and got[k][f"total_{n}d"] == pytest.approx(sum(w[n]))
            assert got[k][f"avg_{n}d"] == (pytest.approx(sum(w[n]) / len(w[n])) if w[n] else None)


def test_inactive_days_and_gaps(spark):
    at = [0, 1, 4, 34, 65]  # gaps of 3, 30 and 31 days
    rows = [("a", T0 + d * DAY, d, 1.0) for d in at] + [("a", T0 + 2 * DAY, 99, math.nan)]
    r = rolling.rolling_totals(points(spark, rows), (7, 30))
    days = sorted((dt.date.fromisoformat(x["calendar_day"]) - dt.date(2014, 6, 2)).days for x in rolling.inactive_days(r).collect())
    assert days == [2, 3, *range(5, 34)]
    assert r.count() == 66 and r.where("points_30d = 0").count() == 1
    assert rolling.rolling_totals(points(spark, [])).count() == 0


# ---- grid


def test_grid(spark, monkeypatch):
    monkeypatch.setattr(grid, "SHARD_SLOTS", 8)
    monkeypatch.setattr(grid, "BLOCK_SHARDS", 3)
    rows = random_points(2)
    steps = {"a": 3_600_000, "b": 7_200_000}
    cat = catalog(spark, [("a", steps["a"], 0, None, None), ("a", steps["a"], 0, None, None), ("b", steps["b"], 0, None, None), ("c", None, 0, None, None), (None, 5, 0, None, None)])
    got = {(r["series"], r["slot_start"]): r for r in grid.regular_grid(points(spark, rows), cat).collect()}
    want, lost = {}, set()
    for s, ms in steps.items():
        step = ms * 10**6
        r = sorted({(t, q, v) for x, t, q, v in rows if x == s and t is not None and finite(v)})
        by = {}
        for t, q, v in r:
            by[t // step] = v
        for k in range(min(by), max(by) + 1):
            want[s, k * step] = by.get(k)
        for (t, _, _), (u, _, _) in zip(r, r[1:]):
            if u - t <= 30 * DAY:
                lost |= {(s, k * step) for k in range(t // step + 1, u // step)}
    assert {k: (r["value"] if r["state"] == "observed" else None) for k, r in got.items()} == want
    assert {(r["series"], r["slot_start"]) for r in grid.missing_slots(grid.regular_grid(points(spark, rows), cat)).collect()} == lost
    for k, r in got.items():
        if r["state"] == "missing":
            assert r["prev_ts"] < r["slot_start"] < r["next_ts"] and r["carried"] is not None


def test_grid_long_gap_and_empty(spark):
    cat = catalog(spark, [("a", 60_000, 0, None, None)])
    rows = points(spark, [("a", T0, 1, 1.0), ("a", T0 + 31 * DAY, 2, 2.0), ("a", T0 + 31 * DAY + 180 * SEC, 3, 3.0)])
    full = grid.regular_grid(rows, cat)
    assert full.count() == 31 * 1440 + 4 and grid.missing_slots(full).count() == 2
    assert grid.regular_grid(rows, cat, 30).count() == 5
    assert grid.regular_grid(points(spark, []), cat).count() == 0 and grid.regular_grid(rows, catalog(spark, [])).count() == 0


# ---- late records


def brute_late(rows, lateness):
    out, hours = set(), {}
    seen = {}
    rows = sorted({r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None}, key=lambda r: r[2])
    for s, t, q, v in rows:
        h = t // HOUR
        x = hours.setdefault((s, h), [0, 0.0, 0])
        if seen.get(s, -1) >= (h + 1) * HOUR + (lateness.get(s) or 0) * SEC:
            out.add(q)
            x[2] += 1
        elif finite(v):
            x[0] += 1
            x[1] += v
        seen[s] = max(seen.get(s, -1), t)
    return out, hours


def test_late(spark, monkeypatch):
    monkeypatch.setattr(late, "BLOCK", 16)
    monkeypatch.setattr(late, "SUPER", 3)
    rows = random_points(3)
    cat = catalog(spark, [("a", 1, 600, None, None), ("b", 1, None, None, None), ("b", 1, None, None, None), (None, 1, 1, None, None)])
    out, hours = brute_late(rows, {"a": 600})
    assert out and {r[0] for r in late.late_points(points(spark, rows), cat).collect()} == out
    views = late.LambdaHours(points(spark, rows), cat)
    views.fast(90)
    views.fast(170)
    assert {(r["series"], r["hour"]) for r in views.serve().collect()} == {(s, h) for s, h in brute_late([r for r in rows if r[2] is not None and r[2] < 170], {"a": 600})[1]}
    views.batch(150)
    views.fast(250)
    _, sofar = brute_late([r for r in rows if r[2] is not None and r[2] < 250], {"a": 600})
    assert {(r["series"], r["hour"]): (r["points"], r["left_out"]) for r in views.serve().collect()} == {k: (x[0], x[2]) for k, x in sofar.items()}
    views.batch()
    got = {(r["series"], r["hour"]): (r["points"], round(r["total"] or 0, 9), r["left_out"]) for r in views.serve().collect()}
    assert got == {k: (x[0], round(x[1], 9), x[2]) for k, x in hours.items()}
    assert late.late_points(points(spark, []), cat).count() == 0
    assert late.LambdaHours(points(spark, []), cat).serve().count() == 0


def test_late_by_both_views(spark, monkeypatch):
    from tidemark import queries

    rows = random_points(3)
    cat = catalog(spark, [("a", 1, 600, None, None)])
    upto = lambda n: brute_late([r for r in rows if r[2] is not None and r[2] < n], {"a": 600})[0]
    views = late.LambdaHours(points(spark, rows), cat, keep_late=True)
    assert views.serve_late().count() == 0
    for step, n in ((views.batch, 150), (views.fast, 250), (views.fast, 330), (views.batch, 300)):
        step(n)
        assert sorted(r[0] for r in views.serve_late().collect()) == sorted(upto(max(n, views.next_seq)))
    served = []
    both = late.LambdaHours.serve_late
    monkeypatch.setattr(late.LambdaHours, "serve_late", lambda v: served.append((v.batch_late is not None, len(v.fast_steps))) or both(v))
    monkeypatch.setattr(queries, "table", lambda spark, d, name: points(spark, rows) if name == "points" else cat)
    assert sorted(r[0] for r in queries.p7_found(spark, "").collect()) == sorted(upto(10**6))
    assert served == [(True, 2)]


def test_later_batches_read_open_hours_only(spark, monkeypatch, tmp_path):
    read = []
    inner = late.with_cutoff
    monkeypatch.setattr(late, "with_cutoff", lambda rows, *a: read.append(rows.count()) or inner(rows, *a))
    rows = random_points(5)
    points(spark, rows).write.parquet(str(tmp_path / "log"))
    views = late.LambdaHours(spark.read.parquet(str(tmp_path / "log")), catalog(spark, [("a", 1, 600, None, None)]), keep_late=True)
    for n in (100, 150, 200, 260, 400):
        views.batch(n)
        upto = [r for r in rows if r[2] is not None and r[2] < n]
        out, hours = brute_late(upto, {"a": 600})
        assert {r[0] for r in views.serve_late().collect()} == out
        got = {(r["series"], r["hour"]): (r["points"], round(r["total"] or 0, 9), r["left_out"]) for r in views.serve().collect()}
        assert got == {k: (x[0], round(x[1], 9), x[2]) for k, x in hours.items()}
    assert all(n < len([r for r in rows if r[2] is not None and r[2] < upto]) for n, upto in zip(read[1:], (150, 200, 260, 400)))


# ---- incremental runs


def test_interval_sets(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 16)
    rnd = random.Random(4)
    a, b = {rnd.randrange(-40, 100) for _ in range(60)}, {rnd.randrange(-40, 100) for _ in range(60)}
    make = lambda s: intervals.of_numbers(spark.createDataFrame([(n,) for n in [*s, *list(s)[:5]]] + [(None,)], "n long"), "n")
    back = lambda df: {n for r in df.collect() for n in range(r["lo"], r["hi"] + 1)}
    A, B = make(a), make(b)
    assert back(A) == a
    for f, want in ((intervals.union, a | b), (intervals.subtract, a - b), (intervals.intersect, a & b)):
        out = f(A, B)
        assert back(out) == want and all(r["lo"] // 16 == r["hi"] // 16 == r["block"] for r in out.collect())
    rows = spark.createDataFrame([(n, f"r{n}") for n in range(-45, 110)] + [(None, "x"), (3, "again")], "n long, name string")
    assert sorted(r["n"] for r in intervals.rows_in(rows, "n", A).collect()) == sorted([*a, *([3] if 3 in a else [])])
    assert intervals.rows_in(rows, "n", make(set())).count() == 0


WAL = "entry_no long, wal_file string, kind string, seq long, series string, ts long, value double, tags map<string,string>, block long"


def wal(spark, rows):
    return spark.createDataFrame([(e, "f", k, s, "a", 1, v, None, 7) for e, k, s, v in rows], WAL)


def test_pending(spark):
    w = wal(spark, [(1, "Insert", 1, 1.0), (2, "Insert", 2, 2.0), (2, "Insert", 2, 2.0), (3, "Insert", 1, 9.0), (4, "Flush", None, None), (5, "Insert", 4, math.nan), (6, "Insert", 5, None), (7, "Insert", 6, 6.0), (None, "Insert", 6, 5.0), (8, "Insert", None, 1.0)])
    held = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, math.nan), (6, 6.0), (77, 1.0)], "seq long, value double")
    todo, merged = incremental.pending(incremental.latest_inserts(w), held)
    assert sorted((r["seq"], r["value"]) for r in todo.collect()) == [(1, 9.0), (5, None)]
    assert {n for r in merged.collect() for n in range(r["lo"], r["hi"] + 1)} == {1, 2, 4, 5, 6}
    none = incremental.pending(incremental.latest_inserts(wal(spark, [])), held)[0]
    assert none.count() == 0


def test_ledger(spark, tmp_path):
    led = incremental.Ledger(spark, f"file://{tmp_path}/ledger")
    first = [(1, "Insert", 1, 1.0), (2, "Insert", 3, 3.0)]
    assert sorted(r["seq"] for r in led.run(wal(spark, first)).collect()) == [1, 3]
    assert led.run(wal(spark, first)).count() == 0
    more = [*first, (3, "Insert", 2, 2.0), (4, "Insert", 3, 3.5), (5, "Insert", 1, 1.0)]

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        led.run(wal(spark, more), fails)
    assert sorted((r["seq"], r["value"]) for r in led.run(wal(spark, more)).collect()) == [(2, 2.0), (3, 3.5)]
    assert led.run(wal(spark, more)).count() == 0 and led.runs() == [0, 1, 2, 3]


def test_ledger_subtracts_what_it_has_processed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE_RUNS", 3)
    led = incremental.Ledger(spark, f"file://{tmp_path}/ledger")
    log = [(k, "Insert", k, float(k)) for k in range(10)]
    assert led.run(wal(spark, log), lambda t: t.where("seq < 5").select(F.col("value") * 2)).count() == 5
    assert led.run(wal(spark, log), lambda t: t).count() == 0
    log += [(14, "Insert", 3, 33.0), (15, "Insert", 20, 1.0), (16, "Flush", None, None)]
    assert sorted(r["seq"] for r in led.run(wal(spark, log)).collect()) == [3, 20]
    # entries written late: a new record, a repeat, and one that an entry already processed has overtaken
    log += [(11, "Insert", 30, 1.0), (12, "Insert", 4, 4.0), (13, "Insert", 3, 31.0)]
    assert [r["seq"] for r in led.run(wal(spark, log)).collect()] == [30]
    log += [(17, "Insert", 3, 3.0), (18, "Insert", 4, None), (19, "Insert", 5, float("nan"))]
    assert sorted(r["seq"] for r in led.run(wal(spark, log)).collect()) == [3, 4, 5]
    log += [(20, "Insert", 4, None), (21, "Insert", 5, float("nan")), (22, "Insert", 3, 33.0)]
    rest = led.unseen(wal(spark, log))
    assert rest.count() == 3 and re.search(r"entry_no#\w+ < 0", rest._jdf.queryExecution().optimizedPlan().toString())
    assert [r["seq"] for r in led.run(wal(spark, log)).collect()] == [3]
    assert [r["lo"] for r in led.processed().orderBy("lo").collect()] == [0, 20, 30]


def test_adopted_contents(spark, tmp_path):
    led = incremental.Ledger(spark, f"file://{tmp_path}/ledger")
    led.adopt(spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 2.0)], "seq long, value double"))
    log = [(1, "Insert", 1, 5.0), (2, "Insert", 2, 3.0), (3, "Insert", 4, 4.0)]
    assert sorted(r["seq"] for r in led.run(wal(spark, log)).collect()) == [2, 4]
    with pytest.raises(ValueError):
        led.adopt(spark.createDataFrame([], "seq long, value double"))


# ---- small files


SEG = "segment_id long, run_id long, seg_level int, file_name string, retired_at timestamp, file string"
ROW = "file_name string, series string, ts long, seq long, value double, tags map<string,string>, file string, copies int"


def test_small_files(spark, tmp_path):
    old = dt.datetime(2014, 1, 1)
    segs = spark.createDataFrame([(1, None, 0, "s/a.seg", None, "x"), (1, None, 0, "s/a.seg", None, "x"), (2, 1, 0, "./s//b.seg", None, "x"), (3, 1, 1, "s/c.seg", old, "x"), (4, 1, 1, "/d/s/a%2Eseg", None, "x"), (5, 1, 1, "s/empty.seg", None, "x"), (6, 1, 1, None, None, "x")], SEG)
    r = lambda f, q, v, t=None: (f, "a", 1, q, v, {"k": "v"} if t is None else t, "y", 3)
    rows = [r("s/a.seg", 1, 1.0), r("s/a.seg", 1, 1.0), r("s/a.seg", 2, math.nan), r("s/b.seg", 2, math.nan), r("s/b.seg", 3, None), r("s/b.seg", 4, 4.0, {}), r("s/c.seg", 9, 9.0), r("s/left.tmp", 8, 8.0), r(None, 7, 7.0), r("s/b.seg", 1, 1.5), r("s/b.seg", None, 2.0), r("s/b.seg", None, 2.0)]
    df = spark.createDataFrame(rows, ROW)
    for part in df.randomSplit([0.2] * 5, 1):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    c = small_files.compact(spark, str(tmp_path / "rows"), segs, str(tmp_path / "out"))
    got = sorted(((x["seq"], x["value"]) for x in c.records.collect()), key=str)
    assert [str(g) for g in got] == sorted(str(x) for x in [(1, 1.0), (2, math.nan), (3, None), (4, 4.0), (1, 1.5), (None, 2.0)])
    assert c.files_out < c.files_in and c.rows_out == 6
    pairs = {(p[0], p[1]) for p in small_files.overlapping_segments(c.presence, segs).collect()}
    assert pairs == {(1, 2), (1, 4), (2, 4)}
    with pytest.raises(OSError):
        small_files.compact(spark, str(tmp_path / "rows"), segs, str(tmp_path / "out"))
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert small_files.compact(spark, str(tmp_path / "none"), segs, str(tmp_path / "out2")).records.count() == 0
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(small_files.OPEN_COST)


@pytest.mark.parametrize("words", [500_000, 40, 3])
def test_repeats_in_waves_without_a_shuffle_of_rows(spark, tmp_path, monkeypatch, words):
    """A third of all rows is one record; others are repeated within and between files."""
    monkeypatch.setattr(small_files, "WAVE_WORDS", words)
    rnd = random.Random(2)
    rows = [(f"f{rnd.randrange(9)}", "a", 1, 0 if rnd.random() < 0.33 else rnd.randrange(3000), 1.0, {"k": "v"}, "y", 1) for _ in range(5000)]
    spark.createDataFrame(rows, ROW).repartition(4).write.parquet(str(tmp_path / "rows x"))
    segs = spark.createDataFrame([(k, 1, 0, f"f{k}", None, "x") for k in range(7)], SEG)
    c = small_files.compact(spark, str(tmp_path / "rows x"), segs, str(tmp_path / "out"))
    live = [r for r in rows if int(r[0][1]) < 7]
    assert sorted(r["seq"] for r in c.records.collect()) == sorted({r[3] for r in live})
    want = {(r[3], r[0]) for r in live}
    assert {(r["seq"], r["file"]) for r in c.presence.collect()} == want
    assert c.files_out <= (2 if words == 500_000 else 200)


def test_failed_verification_publishes_nothing(spark, tmp_path, monkeypatch):
    segs = spark.createDataFrame([(1, None, 0, "a", None, "x")], SEG)
    spark.createDataFrame([("a", "a", 1, 1, 1.0, {}, "y", 3)], ROW).write.parquet(str(tmp_path / "rows"))
    totals = iter([(1, 0, 0), (2, 0, 0)])
    monkeypatch.setattr(small_files, "_totals", lambda df: next(totals))
    with pytest.raises(small_files.VerificationError):
        small_files.compact(spark, str(tmp_path / "rows"), segs, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and not (tmp_path / "out.open").exists()


# ---- implausible readings


def readings(seed, n=1500):
    """(rows, numbers that cannot be right): noise on a daily wave, switching with idle phases, and whole numbers."""
    rnd = random.Random(seed)
    rows, bad, q = [], set(), 0
    for s in ("wave", "power", "count"):
        on, left = False, 5
        for i in range(n):
            t = T0 + i * 900 * SEC
            if s == "wave":
                v = 50 + 8 * math.sin(i / 96 * 2 * math.pi) + rnd.gauss(0, 0.4) + (20 if i > 900 else 0)
            elif s == "power":
                left -= 1
                if not left:
                    on, left = not on, rnd.randint(12, 60)
                v = rnd.gauss(9, 0.1) if on else 0.0
            else:
                v = float(round(rnd.gauss(30, 1.2)))
            rows.append([s, t, q, v])
            q += 1
    at = {s: [r for r in rows if r[0] == s] for s in ("wave", "power", "count")}
    for s, k, size, amount in (("wave", 200, 1, 15), ("wave", 400, 3, -12), ("power", 300, 1, 30), ("power", 701, 2, 25), ("count", 250, 1, 25)):
        for r in at[s][k : k + size]:
            r[3] = 9.0 + amount if s == "power" else r[3] + amount
            bad.add(r[2])
    for s, k, size in (("wave", 600, 15), ("count", 800, 60)):
        for j, r in enumerate(at[s][k : k + size]):
            r[3] = at[s][k][3] + (1e-6 * (j % 3) if s == "wave" else 0)
            bad.add(r[2])
    for r, v in ((at["wave"][100], math.nan), (at["wave"][101], -9999.0), (at["count"][50], None), (at["power"][50], math.inf)):
        r[3] = v
        bad.add(r[2])
    return [tuple(r) for r in rows], bad


@pytest.mark.parametrize("size", [20_000, 150])
def test_spikes(spark, monkeypatch, size):
    monkeypatch.setattr(spikes, "BLOCK_ROWS", size)
    rows, bad = readings(5)
    rows += rows[:100] + [(None, T0, 90_001, 1.0), ("flat", T0, 90_002, 1.0), ("flat", T0 + 1, 90_003, 1.0), ("one", T0, 90_004, 3.0)]
    cat = catalog(spark, [("wave", 1, 1, 0.0, 200.0), ("power", 1, 1, None, math.nan), (None, 1, 1, 0.0, 1.0)])
    got = {r["seq"] for r in spikes.implausible(points(spark, rows), cat).collect()}
    assert len(bad - got) <= 1 and len(got - bad) <= 3  # the end of a stuck run may be joined by the reading after it
    every = spikes.judged(points(spark, rows), cat)
    assert every.count() == len({r[2] for r in rows if r[0] is not None})
    assert {r["reason"] for r in every.collect()} == {None, "spike", "stuck", "limit", "not_finite"}
    assert every.where("score is null or score < 0 or score > 1").count() == 0


def outages(newest_first):
    """(rows, numbers of spikes): readings of ten sources by turns; in a and b the first reading on time after an outage is a
    spike, its backlog follows it or the reading after it; the clock of a reading of c, from before a change of level, is ahead."""
    rnd, rows, bad = random.Random(11), [], set()
    held, late, t_of = {"a": [], "b": []}, {"a": 340, "b": 341}, lambda i: T0 + i * 600 * SEC

    def send(s, i, v, ahead=0):
        rows.append((s, t_of(i) + ahead * 300 * SEC, len(rows), v))

    for i in range(600):
        for s in "abcdefghij":
            v = 20 + rnd.gauss(0, 0.4) + (15 if s == "c" and i > 405 else 0)
            if s in held and 300 <= i < 340:
                held[s].append((i, v))
                continue
            if s in held and i == 340:
                v += 15
                bad.add(len(rows))
            send(s, i, v, 25 if s == "c" and i == 400 else 0)
            if s in held and i == late[s]:
                for j, w in held[s][::-1] if newest_first else held[s]:
                    send(s, j, w)
    return rows, bad


@pytest.mark.parametrize("newest_first", [True, False])
def test_spike_after_an_outage(spark, newest_first):
    import numpy as np

    rows, bad = outages(newest_first)
    got = {r["seq"] for r in spikes.implausible(points(spark, rows), catalog(spark, [])).collect()}
    assert got == bad
    for s in "abcd":
        mine = sorted(r for r in rows if r[0] == s)
        t, q, v = (np.array([r[k] for r in mine]) for k in (1, 2, 3))
        assert spikes.displaced(t, q, v, 0.4).sum() == (s == "c")


def test_spikes_of_nothing(spark):
    cat = catalog(spark, [])
    assert spikes.judged(points(spark, []), cat).count() == 0
    got = spikes.implausible(points(spark, [("a", T0, 1, math.nan), ("a", T0, 2, None), ("a", T0, None, 1.0)]), cat)
    assert sorted(r[0] for r in got.collect()) == [1, 2]


def test_forest_ranks_the_rare_first():
    import numpy as np

    codes = np.array([0, 1, 2, 32, 31 * 32**2, 31])
    s = spikes.isolation_scores(codes, np.array([500.0, 300, 200, 100, 0, 1]), 1)
    assert min(s[4], s[5]) > max(s[:4]) and (0 < s).all() and (s < 1).all()


def test_forest_decides_between_candidates(spark):
    """With heavy tails many readings pass the exact check; the forest of the source rejects some and keeps what stands out."""
    import numpy as np

    rng = np.random.default_rng(4)
    y = rng.laplace(0, 1, 6000).cumsum() * 0.02 + rng.laplace(0, 1, 6000)
    y[3000] += 60
    noise = float(np.median(np.abs(np.diff(y))))
    passes = set(np.flatnonzero(spikes.departures(y, noise) >= 1.2 * spikes.LEAST_SPIKE).tolist())
    rows = [("s", T0 + i * 60 * SEC, i, float(v)) for i, v in enumerate(y)]
    found = {r["seq"] for r in spikes.judged(points(spark, rows), catalog(spark, []), False).collect() if r["reason"] == "spike"}
    assert 3000 in found and passes - found


def test_spikes_do_not_depend_on_the_unit(spark):
    rows, bad = readings(5)
    found = []
    for scale in (1.0, 2.0**-37, 2.0**30):
        scaled = [(s, t, q, v if v is None else v * scale) for s, t, q, v in rows]
        found.append({r[0] for r in spikes.implausible(points(spark, scaled), catalog(spark, [])).collect()})
    assert found[0] == found[1] == found[2] and bad <= found[0] and len(found[0] - bad) <= 2


def test_faulty_readings_at_the_border_of_a_block(spark, monkeypatch):
    """Blocks whose outer readings are not finite or beyond the limits still get neighbours that can be used."""
    rnd = random.Random(3)
    rows = [["s", T0 + i * 60 * SEC, i, rnd.gauss(10, 1)] for i in range(1200)]
    for i in range(560, 640):
        rows[i][3] = math.nan if i % 2 else 9999.0
    rows[559][3] = rows[640][3] = 60.0
    got = []
    for size in (20_000, 600):
        monkeypatch.setattr(spikes, "BLOCK_ROWS", size)
        r = spikes.judged(points(spark, [tuple(x) for x in rows]), catalog(spark, [("s", 1, 0, None, 100.0)]), False).collect()
        got.append(sorted((x["seq"], x["reason"]) for x in r))
    assert got[0] == got[1] and len(got[0]) >= 80 and {559, 640} <= {q for q, _ in got[0]} | {559, 640}
