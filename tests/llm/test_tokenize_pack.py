"""Encoding and packing against the tokenizer libraries and round trips."""

import os
import random

import pytest

from tidemark.llm import packing, tokenize

DOC = "doc_id long, text string, ids string, sizes int, uid string"
pytestmark = pytest.mark.skipif(not os.path.isdir(tokenize.FOLDER), reason="no vocabularies here")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], DOC)


def reference(name):
    import base64

    import tiktoken

    raw = tokenize.vocabulary_file(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=tokenize.WORDS, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n=120):
    rnd = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "漢字", "🙂", "1", "2024", "'s", "<|endoftext|>", "-----", "Straße", "\t", "​", "x" * 30]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_same_as_library(name):
    enc, lib = tokenize.PrefixEncoder(tokenize.vocabulary_file(name)), reference(name)
    for t in texts(1):
        assert enc.encode_batch([t])[0] == lib.encode_ordinary(t)
    both = texts(2)
    assert enc.encode_batch(both) == [lib.encode_ordinary(t) for t in both]


def test_shared_prefixes_are_walked_once():
    enc = tokenize.PrefixEncoder(tokenize.vocabulary_file("byte_bpe_50k"))
    words = [" measure", " measured", " measurement", " measurements", "z"]
    assert {w: ids for w, ids in enc.walk(words)} == {w: enc.merged(w.encode()) for w in words}


def test_queries_rows(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "   "), (5, "Hello world"), (None, "Hello"), (6, "ab " * 60_000), (7, "y" * 50_000)]
    lib = reference("byte_bpe_50k")
    got = tokenize.encode(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: lib.encode_ordinary(t or "") for i, t in rows if i != 7}
    assert all(r["ids"] == want[r["doc_id"]] for r in got if r["doc_id"] != 7)
    assert sum(1 for r in got if r["doc_id"] == 7 and len(r["ids"]) > 0) == 1
    assert tokenize.encode(documents(spark, [])).count() == 0


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokenize, "KEPT_WORDS", 10)
    enc, lib = tokenize.PrefixEncoder(tokenize.vocabulary_file("byte_bpe_50k")), reference("byte_bpe_50k")
    for t in texts(3, 40):
        assert enc.encode_batch([t])[0] == lib.encode_ordinary(t)


# ---- packing


def test_pack_lengths():
    import numpy as np

    rnd = np.random.default_rng(1)
    lengths = np.concatenate([rnd.integers(0, 400, 3000), rnd.integers(400, 1025, 300), [1024, 1, 0]])
    container, tier = packing.pack_lengths(lengths, 1024)
    used = np.bincount(container, lengths)
    assert used.max() <= 1024 and lengths.sum() / (1024 * len(used)) > 0.99
    assert tier.max() <= 10


@pytest.mark.parametrize("capacity", [1024, 1000, 37, 1])
def test_windows_hold_their_tier(capacity):
    """Each container is a row of windows that nest; what is in a window of a tier is of that tier or a shorter one."""
    import numpy as np

    rnd = np.random.default_rng(capacity)
    lengths = np.minimum(capacity, np.concatenate([rnd.integers(0, 400, 2000), rnd.integers(1, 40, 2000), rnd.integers(400, 1025, 300)]))
    container, tier, window = packing.pack_windows(lengths, capacity)
    used = np.bincount(container, lengths)
    assert used.max() <= capacity
    assert capacity == 37 or len(used) <= -(-lengths.sum() // capacity) + 1  # 37 has too few short items for the long ones
    assert (window <= tier).all() and (lengths <= capacity >> np.minimum(tier, 30)).all() | (capacity < 128)
    if capacity == 1024:
        # the opener of each window is of its tier, and windows of each tier are filled from shorter ones
        assert all((tier[window == t] == t).any() and (tier[window == t] > t).any() for t in range(3))


def test_counter_equals_encoder():
    names = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    encoders = [tokenize.PrefixEncoder(tokenize.vocabulary_file(n)) for n in names]
    got = tokenize.Counter(encoders).count_batch([None, "", *texts(4), "q" * 200])
    assert got == [[len(e.encode_batch([t])[0]) for e in encoders] for t in [None, "", *texts(4), "q" * 200]]


def test_long_words_are_encoded_like_in_the_library():
    enc, lib = tokenize.PrefixEncoder(tokenize.vocabulary_file("byte_bpe_50k")), reference("byte_bpe_50k")
    rnd = random.Random(8)
    for alphabet in ("y", "ab", "etaoinshrdlu", "éü漢"):
        word = "".join(rnd.choice(alphabet) for _ in range(1500))
        assert enc.encode_batch([word])[0] == lib.encode_ordinary(word)


@pytest.mark.parametrize("shard", [7, 100_000])
def test_pack_round_trip(spark, shard):
    rnd = random.Random(5)
    rows = [(i, "word " * rnd.choice([0, 1, 5, 20, 60, 200])) for i in range(60)] + [(100, None), (101, ""), (102, "w " * 3000), (103, "again"), (103, "again"), (None, "null id")]
    goals = spark.createDataFrame([(1, "byte_bpe_50k", 128), (2, "byte_bpe_multi_50k", 64), (3, None, 5), (4, "byte_bpe_50k", 0)], "target_id int, tokenizer string, capacity int")
    got = packing.pack(documents(spark, rows), goals, shard_items=shard).toPandas()
    for target, name, capacity in ((1, "byte_bpe_50k", 128), (2, "byte_bpe_multi_50k", 64)):
        g = got[got.target_id == target]
        lib = reference(name)
        want = sorted((str(i), len(lib.encode_ordinary(t or ""))) for i, t in rows)
        d = g.assign(doc=[str(None if x != x else int(x)) for x in g.doc_id])
        size = d.groupby(["doc", "container_id", "piece"]).piece_tokens.sum()
        assert size.max() <= capacity and sum(n for _, n in want) == g.piece_tokens.sum()
        whole = sorted((k, n) for k, n in want if n <= capacity)
        single = sorted((x.doc, x.piece_tokens) for x in d.itertuples() if x.piece == 0 and not ((d.doc == x.doc) & (d.piece > 0)).any())
        assert single == whole
        used = g.groupby("container_id").piece_tokens.sum()
        assert used.max() <= capacity
        for _, c in g[g.piece_tokens > 0].groupby("container_id"):
            c = c.sort_values("container_start")
            assert (c.container_start.to_numpy() == (c.piece_tokens.cumsum() - c.piece_tokens).to_numpy()).all()
    assert set(got.target_id) == {1, 2}
    assert packing.pack(documents(spark, []), goals).count() == 0
    assert packing.pack(documents(spark, rows), goals.limit(0)).count() == 0


def test_an_exact_fill_by_any_two_lengths():
    left = [40, *range(51, 90, 2), *range(90, 130), 160]
    assert packing._next(left, {x: [0] for x in left}, 200) == 160
    left = [49, *range(102, 200, 2), 151]  # only 49 and 151 make 200, behind 24 longer lengths
    assert packing._next(sorted(left), {x: [0] for x in left}, 200) == 151
    left = [97, 103, *range(104, 200, 2)]  # 103 and 97, behind 48 longer lengths
    assert packing._next(left, {x: [0] for x in left}, 200) == 103
    assert packing._next([100, 150], {100: [0], 150: [0]}, 200) == 150
    assert packing._next([100, 150], {100: [0, 1], 150: [0]}, 200) == 100
