"""Nearest vectors, resampling and vector codes: brute force, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecweave.llm import collisions
from vecweave.llm.checksums import moved_over
from vecweave.llm.collisions import nearest_vectors
from vecweave.llm.importance import WordSplitter, draw, score_documents
from vecweave.llm.queries import QUERIES
from vecweave.llm.vector_codes import choose_pivots, compress, nearest_entries
from vecweave.llm.vector_codes import _distances as pivot_distances

FOLDER = "/root/testdata/sf0.001"
EXTRA = ["row", "size", "cell", "score", "rank", "label_error", "place", "buckets"]


def nearest_by_force(ids, vectors, queries, k):
    found = {}
    for q in queries:
        gap = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, gap)) if i != q][:k]
        found[ids[q]] = [(ids[i], gap[i]) for i in order]
    return found


def recall(got, want):
    hits = sum(len({v for v, _ in want[q]} & {r.vec_id for r in got if r.query_id == q}) for q in want)
    return hits / sum(map(len, want.values()))


def test_nearest_query(spark):
    got = QUERIES["op11_collisions"](spark, FOLDER).collect()
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, vectors = np.array([i for i, _ in table]), np.array([v for _, v in table], np.float64)
    want = nearest_by_force(ids, vectors, np.flatnonzero(ids % 100 == 0), 10)
    assert recall(got, want) >= 0.95
    exact = {(q, v): d for q in want for v, d in nearest_by_force(ids, vectors, [np.flatnonzero(ids == q)[0]], len(ids))[q]}
    for q in want:
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11))
        assert all(r.score == pytest.approx(exact[q, r.vec_id], rel=1e-14) for r in rows)
        assert rows == sorted(rows, key=lambda r: (r.score, r.vec_id))


def test_nearest_over_many_shards_and_slices(spark, monkeypatch):
    """Groups far apart, one of which holds a third of all rows; shards are passed over and nothing is lost."""
    monkeypatch.setattr(collisions, "SHARD_VECTORS", 64)
    monkeypatch.setattr(collisions, "SLICE_BYTES", 4000)
    monkeypatch.setattr(collisions, "SAMPLE_VECTORS", 100)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 12)) * 10
    group = np.where(np.arange(1500) % 3 == 0, 0, rng.integers(1, 20, 1500))
    vectors = centres[group] + rng.standard_normal((1500, 12)) * 0.3
    vectors[group == 0] = centres[0]  # copies
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = nearest_vectors(table.repartition(7), F.col("vec_id") % 20 == 0, 5).collect()
    want = nearest_by_force(np.arange(1500), vectors, range(0, 1500, 20), 5)
    assert len(got) == 75 * 5 and recall(got, want) >= 0.95
    copies = [i for i in range(1500) if group[i] == 0]
    for q in (0, 60):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in copies if i != q][:5]


def test_windows_grow_and_collisions_decide(monkeypatch):
    """Few of many vectors are verified, and a vector that collides too rarely is not."""
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((500, 8)) * 5
    vectors[:20] = vectors[0] + rng.standard_normal((20, 8)) * 0.01
    values, order = collisions.Shard.sort(vectors)
    shard = collisions.Shard(np.arange(500), np.arange(500), vectors, values, order)
    verified = []
    plain = collisions._distances
    monkeypatch.setattr(collisions, "_distances", lambda x, y: verified.append(len(x)) or plain(x, y))
    state = collisions.Found(np.array([0]), vectors[:1], np.array([0.2]), 10)
    shard.search(state, np.array([0]))
    assert 20 <= sum(verified) < 100 and sorted(state.ids[0]) == sorted(i for i, _ in nearest_by_force(np.arange(500), vectors, [0], 10)[0])
    monkeypatch.setattr(collisions, "COLLISIONS", collisions.PROJECTIONS + 1)
    state = collisions.Found(np.array([0]), vectors[:1], np.array([0.2]), 10)
    shard.search(state, np.array([0]))
    assert (state.found < 0).all()


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 4.0]), (100, None), (200, [0.0, 0.0]), (300, [nan, 1.0]),
        (400, [1.0, None]), (500, []), (600, [2.0]), (None, [1.0, 1.0]), (700, [inf, 0.0]), (800, [5.0, 5.0, 5.0]), (900, [4.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("x") for c in EXTRA})
    got = sorted(tuple(r) for r in nearest_vectors(table, F.col("vec_id") % 100 == 0, 3).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, None, 1.0), (600, 1, 900, 2.0), (900, 1, 600, 2.0)]
    assert nearest_vectors(table.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest_vectors(table, F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        nearest_vectors(table, F.lit(True), 0)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for i in range(len(words)) for n in (1, 2, 3) if i + n <= len(words)]


def test_checksums_of_windows():
    rng = np.random.default_rng(2)
    heads, tails = (["".join(chr(c) for c in rng.integers(33, 1200, n)).encode() for n in rng.integers(0, 700, 60)] for _ in "ab")
    crc = np.array(list(map(zlib.crc32, heads)), np.uint32)
    moved = moved_over(crc, np.array(list(map(len, tails))))
    assert [int(a) ^ zlib.crc32(t) for a, t in zip(moved, tails)] == [zlib.crc32(h + t) for h, t in zip(heads, tails)]
    texts = ["Hello, World-9 über 漢字🙂 x" + "a" * 500 + " b", None, "", "one", "one two", "a b\u0085c d e", "ÀB\x00c\x7fd  E", "w " * 70_000]
    got, words = WordSplitter().buckets(pa.array(["skipped", *texts]).slice(1))
    want = [features(t) for t in texts]
    assert list(words) == [n for n, _ in want] and list(got) == sum((f for _, f in want), [])


def test_resampling_of_odd_rows(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = {1: None, 2: "", 3: " \n,.", 4: long_text, 5: "Ab " * 20, 6: "ab " * 19, 7: "漢字 🙂 " * 30, 8: "some target words " * 10}
    rows = [*texts.items(), (8, texts[8]), (None, texts[5]), *((i, texts[5]) for i in range(100, 170))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in EXTRA})
    target = spark.createDataFrame([("some target words",), (None,), ("",)], "text string")
    scored = score_documents(docs, target)
    got = draw(scored, 10).collect()
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    t.update(features("some target words")[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    want = []
    for i, text in rows:
        n, found = features(text)
        place = (int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        weight = sum(gain[b] for b in found)
        want.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(place)))))
    ranks = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    ranked = Counter((*r, i + 1 if i < 10 * len(ranks) // 100 else None) for i, r in enumerate(ranks))
    ranked.update((*r, None) for r in want if r[1] < 20)
    assert Counter(tuple(r) for r in got) == ranked
    assert draw(score_documents(docs.filter("false"), target)).count() == 0
    assert draw(score_documents(docs, target.filter("false"))).count() == len(rows)


def test_pivots_prune_and_change_nothing():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (64, 4))
    entries[5] = entries[3]
    parts = np.concatenate([entries[rng.integers(0, 64, 3000)] + rng.integers(-30, 30, (3000, 4)), entries])
    pivots = choose_pivots(entries[None])[0]
    code, best, evaluated = nearest_entries(parts, pivot_distances(parts, pivots).astype(np.float32), entries, pivots)
    gaps = ((parts[:, None] - entries) ** 2).sum(axis=2)
    assert list(code) == list(gaps.argmin(axis=1)) and list(best) == list(gaps.min(axis=1))
    assert evaluated < 0.2 * gaps.size


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(n).tolist(), i % 3 or None) for i, n in zip(range(90), [20] * 80 + [3] * 9 + [0])]
    good += [(7, good[7][1], 1), (None, good[8][1], 2)]
    bad = [(200, None, 1), (201, [nan], 1), (202, [1.0, None], 1), (203, [-inf], 1)]
    table = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit("x") for c in EXTRA})
    got, books = compress(table)
    ints = np.zeros((len(good), 32), np.int64)
    for row, (_, v, _) in zip(ints, good):
        row[: len(v)] = np.floor(np.array(v) * 256)
    parts = ints.reshape(len(good), 16, 2)
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][1]))[:64]
    book = parts[first].transpose(1, 0, 2).copy()
    for left in (2, 1, 0):
        gaps = ((parts[:, :, None] - book) ** 2).sum(axis=3)
        code, error = gaps.argmin(axis=2), gaps.min(axis=2).sum(axis=1)
        for p, e in np.ndindex(16, 64) if left else ():
            if (code[:, p] == e).any():
                book[p, e] = parts[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
    by_label = defaultdict(int)
    for (_, _, label), e in zip(good, error.tolist()):
        by_label[label] += e
    want = Counter((i, bytes(c).hex(), int(e), by_label[label]) for (i, _, label), c, e in zip(good, code.tolist(), error))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert books.entries.tolist() == book.tolist()
    few, books = compress(table.filter("vec_id < 5"))
    assert {r.error for r in few.collect()} == {0} and books.entries.shape == (16, 5, 2)
    nothing, books = compress(table.filter("vec_id >= 200"))
    assert nothing.count() == 0 and books is None
