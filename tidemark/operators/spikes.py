"""Implausible readings of each source: spikes, stuck values, impossible values.

A reading is judged against its own source only, by four features: its distance from the local level, its departure
from the readings on both sides (difference), its distance from what is usual at that hour of the day (seasonal), and
the length of the run of equal values it belongs to against the runs the source normally has. An isolation forest per
source scores every reading, and each run by its length alone. What scores at least as much as the source's own forest gives to
a point between two reference readings (``ORDINARY`` and ``REFERENCE``) or a reference run (``FAR_LONGER`` times as long as usual) is unusual. An exact
check drops what is unusual for no reason: a spike must stand off from both sides by ``LEAST_SPIKE``, a stuck run be longer than
others by ``LEAST_LONGER``. Explicit rules flag values that are not finite or beyond the physical limits.

Scale. A source is cut into blocks of about ``BLOCK_ROWS`` readings at quantiles of its times, so a hot source is many
tasks. After the one shuffle that brings a block together it is a single row with arrays of ordered readings; all later
passes run over these rows without moving them, and only summaries are gathered per source: histograms, the ``HALO``
outermost readings that neighbours need of each other, and the runs at the ends of the blocks, from which runs that cross
borders are put together. Features are rounded to ``LEVELS`` steps each and packed into one code, so the forest of a
source is grown and evaluated on its distinct codes, weighted by how many of all its runs have them: its input stays
small however many readings there are, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.clean import NS_PER_HOUR, clean_points

BLOCK_ROWS = 20_000
MOST_BLOCKS = 10_000  #: of a source; beyond ``BLOCK_ROWS`` times this, blocks grow: 2 million readings (48 MB) for a source of 2 * 10**10
HALO = 24  #: usable readings exchanged between neighbouring blocks
BURST = 3  #: readings that a spike lasts at most
SPIKE = 5.5  #: departure beyond which a burst is taken out before longer ones are looked for, in units of the source's median change
REFERENCE = (6.0, 6.0, 1.0, 0.0)  #: level, difference, season and run length of a reference spike
ORDINARY = (3.5, 3.5, 1.0, 0.0)  #: those of a reference reading that is unusual but none
BETWEEN = 0.6  #: where between the scores of the two a reading becomes a spike
LEAST_SPIKE = 4.5  #: departure below which nothing is a spike, however it scores
SAME = 0.01  #: changes below this share of the median change are none
LEVELS = 32  #: steps of a rounded feature
SHORTEST = 6  #: readings in a stuck run at least
FAR_LONGER = 3.0  #: the reference run is so many times as long as the source's long runs
LEAST_LONGER = 2.1  #: a run below so many times that length is not stuck, however it scores
NO_CHANGE = 1e-11  #: changes of at most this share of a value are rounding
TREES, SAMPLE, DEPTH = 50, 128, 7  #: of an isolation forest; SAMPLE is drawn for each tree from all weighted codes
BROADCAST_BYTES = 32 << 20  #: summaries up to this size are sent to all executors, larger ones are joined by shuffle
BLOCKS_AT_A_TIME = 8  #: blocks in an Arrow batch

NOT_FINITE, LIMIT, JUMPS, STARTS, DISPLACED = 1, 2, 4, 8, 16  #: flags of a reading
RULED = NOT_FINITE | LIMIT | DISPLACED  #: flags of readings that the forest does not judge
AROUND = 3  #: readings on either side, in time and in arrival, that tell whether a clock ran ahead
BATCH = 4  #: arrivals of a late batch follow each other at most 1/BATCH of the source's usual distance in seq apart


def limits(catalog: DataFrame) -> DataFrame:
    """``series, lo, hi`` of the catalog; null or NaN is no limit, of several the narrowest holds."""
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return catalog.where(F.col("series").isNotNull()).groupBy("series").agg(
        F.max(real("valid_min")).alias("lo"), F.min(real("valid_max")).alias("hi")
    )


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Few rows to a batch of the Parquet reader and of Arrow while rows hold whole blocks."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(BLOCKS_AT_A_TIME))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


#: row groups of few blocks, as a reader holds at least a part of one in memory
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4"}


def _with(blocks: DataFrame, summary: DataFrame, rows: int, bytes_each: int, on: list[str]) -> DataFrame:
    """Join a staged summary to the blocks, by broadcast if ``rows`` of ``bytes_each`` are few enough."""
    return blocks.join(F.broadcast(summary) if rows * bytes_each <= BROADCAST_BYTES else summary, on)


def _cut(points: DataFrame, sources: DataFrame, largest: int) -> DataFrame:
    """``source, block, ts, seq, value, lo, hi``: readings with the number of their source and block."""
    parts = min(MOST_BLOCKS, -(-largest // BLOCK_ROWS))
    rows = points.join(sources, "series")
    if parts < 2:
        return rows.select("source", F.lit(0).alias("block"), "ts", "seq", "value", "lo", "hi")
    # only sources of more than one block need quantiles; one row for each, made from sketches that merge
    own = F.least(F.lit(parts), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")
    share = [k / parts for k in range(1, parts)]
    cuts = rows.where(F.col("n") > BLOCK_ROWS).groupBy("source", "n").agg(
        F.percentile_approx("ts", share, max(10_000, 10 * parts)).alias("q")
    )
    place = lambda k: F.greatest(F.lit(1), F.round(k * parts / own).cast("int"))
    cuts = storage.staged(
        cuts.select("source", F.array_distinct(F.transform(F.sequence(F.lit(1), own - 1), lambda k: F.element_at("q", place(k)))).alias("cuts")),
        "cuts",
    )
    block = F.aggregate("cuts", F.lit(0), lambda s, c: s + F.when(c <= F.col("ts"), 1).otherwise(0))
    return rows.join(cuts, "source", "left").select("source", F.coalesce(block, F.lit(0)).alias("block"), "ts", "seq", "value", "lo", "hi")


BLOCKS = "source int, block int, ts binary, seq binary, value binary, head binary, tail binary, changes binary, hours binary"


def _edge(ts: np.ndarray, seq: np.ndarray, value: np.ndarray, part: slice) -> bytes:
    return np.concatenate([ts[part], seq[part], value[part].view(np.int64)]).tobytes()


def _edge_arrays(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(raw or b"", np.int64).reshape(3, -1)
    return a[0], a[1], a[2].copy().view(float)


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A block in one row: its readings in order, each once, and what its source must know of it."""
    ts, value = rows["ts"].to_numpy(np.int64), rows["value"].to_numpy(float)
    seq = rows["seq"].to_numpy(np.int64)
    order = np.lexsort((value, seq, ts))
    ts, seq, value = ts[order], seq[order], value[order]
    again = np.zeros(len(ts), bool)
    again[1:] = (ts[1:] == ts[:-1]) & (seq[1:] == seq[:-1]) & ((value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1])))
    ts, seq, value = ts[~again], seq[~again], value[~again]
    finite = np.isfinite(value)
    y = value[finite]
    with np.errstate(over="ignore"):
        change = np.abs(np.diff(y))
    real = (change > NO_CHANGE * np.maximum(np.abs(y[1:]), np.abs(y[:-1]))) & np.isfinite(change)
    bins, n = np.unique(np.floor(np.log2(change[real]) * 16).astype(np.int64), return_counts=True)
    lo, hi = (float(rows[c].iloc[0]) for c in ("lo", "hi"))
    usable = np.flatnonzero(finite & ~(value < lo) & ~(value > hi))
    head, tail = (len(ts), 0) if len(usable) <= HALO else (usable[HALO - 1] + 1, usable[-HALO])
    hour, hours = (ts[finite] // NS_PER_HOUR) % 24, np.full((24, 4), np.nan)
    by_hour = np.argsort(hour, kind="stable")
    cut = np.searchsorted(hour[by_hour], np.arange(25))
    for h in range(24):
        v = y[by_hour[cut[h] : cut[h + 1]]]
        if len(v):
            hours[h] = [len(v), *np.quantile(v, [0.25, 0.5, 0.75], method="nearest")]
    row = (key[0], key[1], ts.tobytes(), seq.tobytes(), value.tobytes(), _edge(ts, seq, value, slice(0, head)), _edge(ts, seq, value, slice(tail, None)),
           np.concatenate([bins, n]).tobytes(), hours.tobytes())
    return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])


SOURCES = "source int, block int, noise double, lo double, hi double, season binary, before binary, after binary"


def _weighted_median(v: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(v)
    return float(v[order][np.searchsorted(np.cumsum(w[order]), 0.5 * w.sum())])


def _source(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of a source: the source's noise, limits and daily pattern, and the readings around the block."""
    blocks = blocks.sort_values("block", ignore_index=True)
    hist: dict[int, int] = {}
    for raw in blocks["changes"]:
        b, n = np.frombuffer(raw, np.int64).reshape(2, -1)
        for x, k in zip(b.tolist(), n.tolist()):
            hist[x] = hist.get(x, 0) + k
    noise = 0.0
    if hist:
        keys = np.array(sorted(hist))
        upto = np.cumsum([hist[k] for k in keys])
        noise = float(2.0 ** ((keys[np.searchsorted(upto, upto[-1] / 2)] + 0.5) / 16))
    hours = np.stack([np.frombuffer(raw, float).reshape(24, 4) for raw in blocks["hours"]])
    season = np.full((24, 2), np.nan)
    for h in range(24):
        known = ~np.isnan(hours[:, h, 0])
        if known.any():
            q = [_weighted_median(hours[known, h, i], hours[known, h, 0]) for i in (1, 2, 3)]
            season[h] = q[1], q[2] - q[0]
    tails, heads = [None, *blocks["tail"][:-1]], [*blocks["head"][1:], None]
    return pd.DataFrame(
        {"source": blocks["source"], "block": blocks["block"], "noise": noise, "lo": blocks["lo"], "hi": blocks["hi"], "season": season.tobytes(),
         "before": tails, "after": heads}
    )


def departures(y: np.ndarray, noise: float) -> np.ndarray:
    """For each reading, how far it and its burst (of up to ``BURST`` readings) stand off from both sides, in noise.

    Bursts of one reading are taken out before bursts of two are looked for, and so on. A reading that stands off
    only because its neighbours are spikes is close to the median around it and does not count.
    """
    n = len(y)
    best = np.zeros(n)
    middle = pd.Series(y).rolling(15, center=True, min_periods=1).median().to_numpy()
    alive = np.arange(n)
    for k in range(1, BURST + 1):
        v, m = y[alive], middle[alive]
        size = len(v) - k - 1
        if size < 1:
            break
        a, b = v[:size], v[k + 1 :]
        least, sign, good = np.full(size, np.inf), None, np.ones(size, bool)
        for j in range(1, k + 1):
            x = v[j : j + size]
            da, db = x - a, x - b
            gap = np.minimum(np.abs(da), np.abs(db))
            sign = np.sign(da) if sign is None else sign
            good &= (np.sign(da) == sign) & (np.sign(db) == sign) & (np.abs(x - m[j : j + size]) >= 0.5 * gap)
            least = np.minimum(least, gap)
        score = np.where(good, least, 0.0) / noise
        for j in range(1, k + 1):
            t = alive[j : j + size]
            best[t] = np.maximum(best[t], score)
        alive = alive[best[alive] < SPIKE]
    return best


def displaced(ts: np.ndarray, seq: np.ndarray, y: np.ndarray, noise: float) -> np.ndarray:
    """Readings of a sender whose clock ran ahead: they carry the value of another time and say nothing about this one.

    Such a reading came before its neighbours in time, and its time is beyond those of the readings of the source that
    arrived just before it and of those that arrived just after it. Late batches are left out of these: they follow each
    other closely, and the first reading on time after an outage, whose backlog comes later, is no such reading, as the
    next ones on time are beyond it. Where arrival does not tell, a reading stays; so does one that equals both neighbours.
    """
    n, far = len(seq), np.int64(1) << 62
    out = np.zeros(n, bool)
    if n <= 2 * AROUND:
        return out
    q = np.concatenate([[-far] * AROUND, seq, [far] * AROUND])
    sides = [j for j in range(2 * AROUND + 1) if j != AROUND]
    same = np.abs(np.diff(y)) <= SAME * noise
    fits = np.r_[True, same] & np.r_[same, True]
    maybe = np.flatnonzero((seq < np.minimum.reduce([q[j : j + n] for j in sides])) & ~fits)
    if not len(maybe):
        return out
    order = np.argsort(seq, kind="stable")
    gap = np.diff(seq[order])
    batch = np.cumsum(np.r_[True, gap > max(2.0, np.median(gap) / BATCH)]) - 1
    single = np.flatnonzero(np.bincount(batch)[batch] < AROUND)
    arrived = np.empty(n, np.int64)
    arrived[order] = np.arange(n)
    before, after = np.searchsorted(single, arrived[maybe], "left"), np.searchsorted(single, arrived[maybe], "right")
    known = (before >= AROUND) & (after + AROUND <= len(single))
    maybe, before, after = maybe[known], before[known], after[known]
    near = np.hstack([before[:, None] - np.arange(1, AROUND + 1), after[:, None] + np.arange(AROUND)])
    out[maybe[(ts[order[single[near]]] < ts[maybe][:, None]).all(1)]] = True
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """Four steps to a doubling of 1 + x below 4, where most readings are, and eight beyond it, where they are judged."""
    octave = np.log2(1 + x)
    return np.clip(np.floor(np.where(octave < 2, 4 * octave, 8 * octave - 8)), 0, LEVELS - 1).astype(np.int32)


FEATURES = (
    "source int, block int, ts binary, seq binary, value binary, codes binary, flags binary, held binary, pieces binary, long_runs binary, "
    "lengths binary, runs int, joins boolean"
)


def _features(b: pd.Series) -> tuple:
    """Features of the readings of a block, from its own readings and the neighbours'.

    ``codes`` packs level, jump and season; ``held`` is the length of the run in this block. ``pieces`` has first reading,
    length and value key of the first and the last run, ``long_runs`` value key, length and number of the other long runs, and
    ``lengths`` counts the other runs by length.
    """
    ts0, seq0, value0 = (np.frombuffer(b[c], t) for c, t in (("ts", np.int64), ("seq", np.int64), ("value", float)))
    before, after = _edge_arrays(b["before"]), _edge_arrays(b["after"])
    ts, seq, value = (np.concatenate([before[i], x, after[i]]) for i, x in enumerate((ts0, seq0, value0)))
    mine = slice(len(before[0]), len(before[0]) + len(ts0))
    n = len(ts)
    noise = float(b["noise"])
    lo, hi = (float(x) if x is not None and x == x else s for x, s in ((b["lo"], -np.inf), (b["hi"], np.inf)))
    finite = np.isfinite(value)
    outside = finite & ((value < lo) | (value > hi))
    flags = np.where(finite, np.where(outside, LIMIT, 0), NOT_FINITE).astype(np.uint8)
    level, jump, seasonal, held = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int32)
    pieces, long_runs, lengths, runs, joins = np.zeros((3, 0)), np.zeros((3, 0)), np.zeros(0, np.int64), 0, False
    at = np.flatnonzero(finite & ~outside)
    moved = displaced(ts[at], seq[at], value[at], noise)
    flags[at[moved]] |= DISPLACED
    at = at[~moved]
    y = value[at]
    if noise > 0 and len(at) > 2:
        # readings of one time and value, sent twice, are one reading here
        keep = np.ones(len(at), bool)
        keep[1:] = (ts[at][1:] != ts[at][:-1]) | (y[1:] != y[:-1])
        back = np.cumsum(keep) - 1
        z = y[keep]
        jump[at] = departures(z, noise)[back]
        middle = pd.Series(z).rolling(15, center=True, min_periods=1).median().to_numpy()
        level[at] = (np.abs(z - middle) / noise)[back]
        season = np.frombuffer(b["season"], float).reshape(24, 2)[(ts[at] // NS_PER_HOUR) % 24]
        seasonal[at] = np.nan_to_num(np.abs(y - season[:, 0]) / (season[:, 1] + noise))
        flags[at[jump[at] >= LEAST_SPIKE]] |= JUMPS
    own = np.flatnonzero((at >= mine.start) & (at < mine.stop))
    if len(own):
        same = np.abs(np.diff(y)) <= SAME * noise
        k = at[own]
        starts = np.r_[True, ~same[own[0] : own[-1]]]
        begin = np.flatnonzero(starts)
        size = np.diff(np.r_[begin, len(k)])
        runs, joins = len(begin), bool(own[0] > 0 and same[own[0] - 1])
        held[k] = np.repeat(size, size)
        if joins:
            starts[0] = False
        flags[k[starts]] |= STARTS
        keys = _value_key(value[k[begin]], noise)
        ends = [0] if runs == 1 else [0, runs - 1]
        pieces = np.stack([begin[ends].astype(float), size[ends].astype(float), keys[ends]])
        inner = np.arange(1, runs - 1)
        lengths = np.bincount(size[inner]) if len(inner) else lengths
        big = inner[size[inner] >= SHORTEST]
        if len(big):
            pair, count = np.unique(np.stack([keys[big], size[big].astype(float)]), axis=1, return_counts=True)
            long_runs = np.vstack([pair, count])
    codes = (_rounded(level) * LEVELS + _rounded(jump)) * LEVELS + _rounded(seasonal)
    return (b["source"], b["block"], b["ts"], b["seq"], b["value"], codes[mine].astype(np.int32).tobytes(), flags[mine].tobytes(), held[mine].tobytes(),
            pieces.tobytes(), long_runs.astype(float).tobytes(), lengths.astype(np.int64).tobytes(), runs, joins)


def _value_key(v: np.ndarray, noise: float) -> np.ndarray:
    return np.round(v / (noise * SAME * 10)) if noise > 0 else v


RUNS = "source int, block int, first_length long, last_length long, run_longest double, resting binary"


def _runs(blocks: pd.DataFrame) -> pd.DataFrame:
    """The lengths of runs that cross blocks, and from what length a run of this source is stuck.

    Values at which a source rests (three long runs or more, a twentieth of its readings) are compared with the runs at
    that value, all others with the runs that the source has elsewhere.
    """
    blocks = blocks.sort_values("block", ignore_index=True)
    chains: list[list[float]] = []  # length, value key
    place: list[tuple[int, int]] = []
    for raw, joins, runs in zip(blocks["pieces"], blocks["joins"], blocks["runs"]):
        p = np.frombuffer(raw, float).reshape(3, -1)
        if not runs:
            place.append((-1, -1))
            continue
        if joins and chains:
            chains[-1][0] += p[1, 0]
        else:
            chains.append([p[1, 0], p[2, 0]])
        first = len(chains) - 1
        if runs > 1:
            chains.append([p[1, 1], p[2, 1]])
        place.append((first, len(chains) - 1))
    by_value: dict[float, list[tuple[float, float]]] = {}
    counts: dict[int, float] = {}
    for length, key in chains:
        by_value.setdefault(key, []).append((length, 1.0))
        counts[int(length)] = counts.get(int(length), 0) + 1
    for raw, lengths in zip(blocks["long_runs"], blocks["lengths"]):
        for key, length, n in np.frombuffer(raw, float).reshape(3, -1).T:
            by_value.setdefault(key, []).append((length, n))
        for length, n in enumerate(np.frombuffer(lengths, np.int64)):
            if n:
                counts[length] = counts.get(length, 0) + n
    total = sum(length * n for length, n in counts.items())
    resting = []
    for key, runs in by_value.items():
        at = np.array([r for r in runs if r[0] >= 8]).reshape(-1, 2)
        if at[:, 1].sum() >= 3 and (at[:, 0] * at[:, 1]).sum() >= 0.05 * total:
            at = at[np.argsort(at[:, 0])]
            typical = at[min(len(at) - 1, np.searchsorted(np.cumsum(at[:, 1]), 0.9 * at[:, 1].sum())), 0]
            resting.append((key, typical * FAR_LONGER))
            for length, n in runs:
                counts[int(length)] -= n
    ordered = sorted((length, n) for length, n in counts.items() if n > 0)
    upto = np.cumsum([n for _, n in ordered])
    usual = ordered[int(np.searchsorted(upto, 0.99 * upto[-1]))][0] if ordered else 0
    length = lambda i: int(chains[i][0]) if i >= 0 else 0
    return pd.DataFrame(
        {"source": blocks["source"], "block": blocks["block"], "first_length": [length(a) for a, _ in place], "last_length": [length(b) for _, b in place],
         "run_longest": float(max(SHORTEST, usual * FAR_LONGER)), "resting": np.array(resting, float).reshape(-1, 2).tobytes()}
    )


def _full_codes(b: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with the fourth feature, flags, and the length of the run of a reading as a share of the longest that is not stuck."""
    codes, flags = np.frombuffer(b["codes"], np.int32), np.frombuffer(b["flags"], np.uint8)
    usable = np.flatnonzero((flags & RULED) == 0)
    share = np.zeros(len(codes))
    if len(usable):
        length = np.frombuffer(b["held"], np.int32)[usable].astype(float)
        pieces = np.frombuffer(b["pieces"], float).reshape(3, -1)
        length[: int(pieces[1, 0])] = b["first_length"]
        length[int(pieces[0, -1]) :] = b["last_length"]
        longest = np.full(len(usable), float(b["run_longest"]))
        rest = np.frombuffer(b["resting"], float).reshape(-1, 2)
        if len(rest):
            keys = _value_key(np.frombuffer(b["value"], float)[usable], float(b["noise"]))
            for key, limit in rest:
                longest[keys == key] = limit
        share[usable] = length / longest
    return codes * LEVELS + _rounded(share), flags, share


def _weights(b: pd.Series) -> Iterator[tuple]:
    codes, flags, _ = _full_codes(b)
    usable = (flags & RULED) == 0
    distinct, where = np.unique(codes[usable], return_inverse=True)
    first = np.bincount(where, (flags[usable] & STARTS) > 0, len(distinct)) if len(distinct) else []
    for c, w in zip(distinct.tolist(), first):
        yield (b["source"], c, float(w))


def isolation_scores(codes: np.ndarray, weights: np.ndarray, seed: int, always: np.ndarray | None = None) -> np.ndarray:
    """Score (0 to 1, higher is more unusual) of each distinct code by a forest grown on samples by weight.

    Codes at the places ``always`` are in every sample, so that every tree tells them from what is less unusual.

    All trees grow level by level at the same time; nodes are numbered as in a heap, and what is left in a leaf adds the
    mean depth of a search among so many.
    """
    x = np.stack([codes // LEVELS**k % LEVELS for k in range(4)], 1).astype(float)
    rng = np.random.default_rng(seed)
    size = int(min(SAMPLE, max(2, weights.sum())))
    total = np.cumsum(weights / weights.sum())
    drawn = np.minimum(np.searchsorted(total, rng.random((TREES, size))), len(codes) - 1)
    # the extreme of each feature is in every sample: a rare extreme that no sample holds could not be cut off
    fixed = x.argmax(0) if always is None else np.concatenate([x.argmax(0), always])
    drawn = np.hstack([drawn, np.tile(fixed, (TREES, 1))])
    size = drawn.shape[1]
    nodes = 1 << (DEPTH + 1)
    feature = np.full((TREES, nodes), -1)
    cut, count = np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    tree, s = np.repeat(np.arange(TREES), size), x[drawn.ravel()]
    node = np.ones(TREES * size, int)
    for depth in range(DEPTH + 1):
        key = tree * nodes + node
        order = np.argsort(key, kind="stable")
        tree, node, s, key = tree[order], node[order], s[order], key[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        t, v = tree[begin], node[begin]
        count[t, v] = np.diff(np.r_[begin, len(key)])
        if depth == DEPTH:
            break
        low, high = np.minimum.reduceat(s, begin), np.maximum.reduceat(s, begin)
        can = high > low
        pick = np.argmax(np.where(can, rng.random(can.shape), -1), 1)
        split = can.any(1)
        r = np.arange(len(begin))
        value = low[r, pick] + rng.random(len(begin)) * (high[r, pick] - low[r, pick])
        feature[t, v] = np.where(split, pick, -1)
        cut[t, v] = value
        mine = np.repeat(r, np.diff(np.r_[begin, len(key)]))
        go = split[mine]
        tree, s, mine, node = tree[go], s[go], mine[go], node[go]
        node = 2 * node + (s[np.arange(len(s)), pick[mine]] > value[mine])
        if not len(node):
            break
    norm = lambda m: np.where(m > 1, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1), 0.0)
    at, deep = np.ones((TREES, len(codes)), int), np.zeros((TREES, len(codes)))
    row, each = np.arange(TREES)[:, None], np.arange(len(codes))[None, :]
    for _ in range(DEPTH):
        f = feature[row, at]
        on = f >= 0
        if not on.any():
            break
        nxt = 2 * at + (x[each, np.maximum(f, 0)] > cut[row, at])
        at, deep = np.where(on, nxt, at), deep + on
    path = (deep + norm(count[row, at])).mean(0)
    return 2.0 ** (-path / max(float(norm(np.array([size]))[0]), 1e-9))


SCORES = "source int, known binary, scores binary, cutoff double, run_cutoff double"


def _code(level: float, jump: float, seasonal: float, share: float) -> int:
    a, b, c, d = _rounded(np.array([level, jump, seasonal, share])).tolist()
    return ((a * LEVELS + b) * LEVELS + c) * LEVELS + d


def _score_source(weights: pd.DataFrame) -> pd.DataFrame:
    """Scores of the codes of a source and of its runs by length alone, and what its forest gives to the references.

    The references are in the sample of every tree: a forest tells nothing apart beyond the readings it has grown on, and without
    them the most unusual reading of an ordinary source would score like a spike.
    """
    weights = weights.sort_values("code", ignore_index=True)
    seen = weights["code"].to_numpy(np.int32)
    ordinary, spike, run = _code(*ORDINARY), _code(*REFERENCE), _code(0, 0, 0, 1)
    codes = np.unique(np.concatenate([seen, seen % LEVELS, [ordinary, spike, run]])).astype(np.int32)
    w = np.zeros(len(codes))
    w[np.searchsorted(codes, seen)] = weights["weight"].to_numpy(float)
    if not w.sum() > 0:
        w[np.searchsorted(codes, seen)] = 1.0
    references = np.searchsorted(codes, [ordinary, spike, run])
    s = isolation_scores(codes, w, 7, references)
    low, high, of_run = s[references]
    return pd.DataFrame({"source": weights["source"][:1], "known": [codes.tobytes()], "scores": [s.tobytes()], "cutoff": [low + BETWEEN * (high - low)], "run_cutoff": [of_run]})


REASONS = (None, "not_finite", "limit", "spike", "stuck")
DECIDED = "source int, seq long, ts long, value double, score double, reason int"


def _decide(b: pd.Series, all_readings: bool) -> pd.DataFrame:
    codes, flags, share = _full_codes(b)
    score, reason = np.ones(len(codes)), np.zeros(len(codes), np.int32)
    usable = (flags & RULED) == 0
    if usable.any() and b["known"] is not None:
        known, scores = np.frombuffer(b["known"], np.int32), np.frombuffer(b["scores"], float)
        score[usable] = scores[np.searchsorted(known, codes[usable])]
        of_run = np.zeros(len(codes))
        of_run[usable] = scores[np.searchsorted(known, codes[usable] % LEVELS)]
        if float(b["noise"]) > 0:
            reason[usable & (of_run >= b["run_cutoff"]) & (share * FAR_LONGER >= LEAST_LONGER)] = 4
        reason[usable & (score >= b["cutoff"]) & ((flags & JUMPS) > 0)] = 3
    reason[(flags & LIMIT) > 0] = 2
    reason[(flags & NOT_FINITE) > 0] = 1
    k = np.arange(len(codes)) if all_readings else np.flatnonzero(reason)
    column = lambda c, t: np.frombuffer(b[c], t)[k]
    return pd.DataFrame({"source": b["source"], "seq": column("seq", np.int64), "ts": column("ts", np.int64), "value": column("value", float), "score": score[k], "reason": reason[k]})


def _each(f: Callable, columns: str, many: bool = False) -> Callable:
    """A function of a block as one of batches of blocks."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for _, b in batch.iterrows() for r in (f(b) if many else [f(b)])]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def judged(points: DataFrame, catalog: DataFrame, all_readings: bool = True) -> DataFrame:
    """Readings with a score, and the reason, if any, why each cannot be right.

    Columns: ``series, seq, ts, value, score, reason``; ``reason`` is ``spike``, ``stuck``, ``limit``, ``not_finite`` or
    null. All readings are scored; with ``all_readings`` false, those without a reason are left out of the result.

    Rows repeated as a whole count once. A null value is not finite. Readings that are not finite or beyond the limits are
    outside the forest (score 1) and no neighbours to others; so are readings whose arrival shows that their time is wrong
    (see ``displaced``), which have no reason unless one of these two rules gives one. A source whose readings never change has neither
    spikes nor stuck runs, as its one run is its normal state. Rows without series or ts are left out; a missing seq is given
    as -1. A source that the catalog lacks has no limits. Empty tables give an empty result; further columns are ignored.
    """
    spark = points.sparkSession
    p = clean_points(points).select("series", "ts", F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("value", F.lit(float("nan"))).alias("value"))
    numbered = p.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    numbered = numbered.join(limits(catalog), "series", "left")
    dense = F.row_number().over(Window.partitionBy("lane").orderBy("series")) - 1
    lanes = 64  # numbers are given in lanes by hash, so that no one task sees all sources
    numbered = numbered.withColumn("lane", F.pmod(F.hash("series"), F.lit(lanes))).withColumn("source", (dense * lanes + F.col("lane")).cast("int")).drop("lane")
    sources = storage.staged(numbered, "sources")
    largest, n_sources = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    named = sources.select("series", "source", "n", "lo", "hi")
    lanes = max(1, min(n_sources, 2 * spark.sparkContext.defaultParallelism))  # tasks over sources: their work is long and their rows few
    named = F.broadcast(named) if n_sources * 100 <= BROADCAST_BYTES else named
    blocks = _cut(p, named, largest).groupBy("source", "block").applyInPandas(_pack, BLOCKS)
    blocks = storage.staged(blocks, "blocks", **SMALL_GROUPS)
    about = blocks.select("source", "block", "head", "tail", "changes", "hours").join(sources.select("source", "lo", "hi"), "source")
    about = storage.staged(about.repartition(lanes, "source").groupBy("source").applyInPandas(_source, SOURCES), "about")
    n_blocks = about.count()
    with _small_batches(spark):
        whole = blocks.select("source", "block", "ts", "seq", "value")
        made = _with(whole, about, n_blocks, 2000, ["source", "block"]).mapInPandas(_each(_features, FEATURES), FEATURES)
        features = storage.staged(made, "features", **SMALL_GROUPS)
        storage.drop(blocks)
        of_source = features.select("source", "block", "pieces", "long_runs", "lengths", "runs", "joins")
        runs = storage.staged(of_source.repartition(lanes, "source").groupBy("source").applyInPandas(_runs, RUNS), "runs")
        noise = about.select("source", "block", "noise").join(runs, ["source", "block"])
        noise = storage.staged(noise, "limits")
        ready = _with(features.drop("long_runs", "lengths", "runs", "joins"), noise, n_blocks, 200, ["source", "block"])
        weights = ready.drop("ts", "seq").mapInPandas(_each(_weights, "source int, code int, weight double", True), "source int, code int, weight double")
        weights = weights.groupBy("source", "code").agg(F.sum("weight").alias("weight"))
        scores = storage.staged(weights.repartition(lanes, "source").groupBy("source").applyInPandas(_score_source, SCORES), "scores")
        # most codes of a source that can occur are few thousands; 12 bytes each
        size = scores.agg(F.coalesce(F.sum(F.length("known") * 3), F.lit(0))).first()[0]
        scored = ready.join(F.broadcast(scores) if size <= BROADCAST_BYTES else scores, "source", "left")

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, b in batch.iterrows():
                    yield _decide(b, all_readings)

        decided = storage.staged(scored.mapInPandas(decide, DECIDED), "decided")
        storage.drop(features)
    names = sources.select("source", "series")
    names = F.broadcast(names) if n_sources * 100 <= BROADCAST_BYTES else names
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("reason") + 1)
    return decided.join(names, "source").select("series", "seq", "ts", "value", "score", reason.alias("reason"))


def implausible(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """``seq`` of the readings that cannot be right, each once."""
    return judged(points, catalog, False).where(F.col("reason").isNotNull()).select("seq").distinct()
