"""Distinct counts against sets."""

import random
from itertools import product

from tidemark.llm import distinct

DAY, T0 = 86_400 * 10**9, 1_401_667_200 * 10**9
KEYS = "reg_no long, ts long, tenant_scope string, series string, tags_sorted array<struct<k:string,v:string>>, day string, bucket int, keys long"


def rows(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        tags = [("host", f"h{rnd.randrange(6)}")] + ([("region", rnd.choice("ns"))] if rnd.random() < 0.8 else [])
        tags += tags[: rnd.randrange(2)]
        rnd.shuffle(tags)
        out.append((i, T0 + rnd.randrange(3 * DAY), rnd.choice(["x", " x ", None, "", "default", "  "]), rnd.choice(["a", "a", "b", None]), tags))
    out += out[:40] + [(998, None, "x", "a", None), (999, T0, "x", "a", [])] + [(2000 + k, T0, "x", "hot", [("host", "h")]) for k in range(150)]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in data], KEYS)


def brute(data):
    sets = {}
    for _, ts, scope, series, tags in data:
        pairs = sorted(set(tags or []))
        region = next((v for k, v in pairs if k == "region"), "")
        g = (None if ts is None else (ts - T0) // DAY, (scope or "").strip() or "default", region)
        for m in product([0, 1], repeat=3):
            key = (4 * m[0] + 2 * m[1] + m[2], *[x if on else None for x, on in zip(g, m)])
            sets.setdefault(key, set()).add((series, tuple(pairs)))
    return {k: len(v) for k, v in sets.items()}


def result(df):
    import datetime as dt

    first = dt.date(2014, 6, 2)
    return {(r["grouping"], None if r["day"] is None else (r["day"] - first).days, r["scope"], r["region"]): r["keys"] for r in df.collect()}


def test_counts_of_all_combinations(spark):
    data = rows(1)
    assert result(distinct.counts(distinct.partial(table(spark, data)))) == brute(data)


def test_partials_merge(spark):
    data = rows(2)
    parts = [distinct.partial(table(spark, data[i::3])) for i in range(3)]
    whole = distinct.partial(table(spark, data))
    assert distinct.merge(*parts).count() == whole.count() and result(distinct.counts(distinct.merge(*parts, parts[0]))) == brute(data)
    assert whole.groupBy("a", "b").agg({"bucket": "min"}).count() == whole.select("a", "b", "bucket").distinct().count()


def test_empty(spark):
    assert distinct.counts(distinct.partial(table(spark, []))).count() == 0
