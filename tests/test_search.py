"""Top-k search against brute force."""

import duckdb
import numpy as np
import pytest
from compare import differences

import __spark_entry__ as spark_entry
from vecweave.operators.embedders import CallableEmbedder, HashingEmbedder, from_function
from vecweave.operators.embed import embed_rows, embedded
import vecweave.operators.search as search
from vecweave.operators.search import SearchReport, text_search, unusable_vectors, vector_topk


def brute_force(queries, vectors, k):
    def unit(v):
        v = np.asarray(v, dtype=np.float32).astype(np.float64)
        return v / (np.linalg.norm(v) or 1)

    found = set()
    for query_id, q in queries:
        scored = sorted((-round(float((unit(q) * unit(v)).sum()), 9), vec_id) for vec_id, v in vectors)
        found |= {(query_id, vec_id, -score, rank + 1) for rank, (score, vec_id) in enumerate(scored[:k])}
    return found


def frames(spark, queries, vectors, kind="int"):
    return (
        spark.createDataFrame(queries, "query_id int, embedding array<float>"),
        spark.createDataFrame(vectors, f"vec_id {kind}, embedding array<float>").repartition(5),
    )


def data(seed, copies=0):
    rng = np.random.default_rng(seed)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(300, 6)).round(2).tolist())]
    # A third of all vectors are the same, and one is zero.
    vectors += [(300 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(copies)] + [(9000, [0.0] * 6)]
    queries = [(i, v) for i, v in enumerate(rng.normal(size=(20, 6)).round(2).tolist())]
    return queries + [(20, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0])], vectors


WAYS = {"one block": {}, "blocks": {"query_bytes": 800}}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_equals_brute_force(spark, way, k):
    queries, vectors = data(k, copies=150)
    found = vector_topk(*frames(spark, queries, vectors), k, **WAYS[way])
    assert {tuple(r) for r in found.collect()} == brute_force(queries, vectors, k)


@pytest.mark.parametrize("way", WAYS)
def test_text_ids_and_nothing_to_search(spark, way):
    queries, vectors = data(5)
    vectors = [(f"id{i:05d}", v) for i, v in vectors]
    asked, stored = frames(spark, queries, vectors, "string")
    assert {tuple(r) for r in vector_topk(asked, stored, 3, **WAYS[way]).collect()} == brute_force(queries, vectors, 3)
    assert vector_topk(asked.filter("query_id < 0"), stored, 3, **WAYS[way]).collect() == []
    assert vector_topk(asked, stored.filter("vec_id = ''"), 3, **WAYS[way]).collect() == []


def test_no_pair_join_in_the_plan(spark):
    asked, stored = frames(spark, *data(1))
    for options in WAYS.values():
        plan = vector_topk(asked, stored, 3, **options)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("way", WAYS)
def test_vectors_that_cannot_be_compared_are_left_out(spark, way):
    nan, inf = float("nan"), float("inf")
    bad = [(2, [nan, 1.0]), (3, [1.0, inf]), (4, [None, 1.0]), (5, None)]
    asked, stored = frames(spark, [(0, [1.0, 1.0]), (1, [nan, 1.0]), (6, [3e30, 3e30])], [(0, [1.0, 1.0]), (1, [1.0, 0.0]), *bad])
    found = {tuple(r) for r in vector_topk(asked, stored.coalesce(1), 1, **WAYS[way]).collect()}
    assert found == {(0, 0, 1.0, 1), (6, 0, 1.0, 1)}
    assert {r["vec_id"] for r in unusable_vectors(stored).collect()} == {2, 3, 4, 5}


@pytest.mark.parametrize("way", WAYS)
def test_each_query_text_is_sent_once(spark, tmp_path, way):
    folder = str(tmp_path)

    def noting(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as file:
            file.write("\n".join(texts))
        return [[float(len(text)), 1.0] for text in texts]

    embedder = CallableEmbedder("noting", 2, call=from_function(noting))
    texts = spark.range(40).selectExpr("CAST(id AS INT) AS query_id", "concat('text ', id) AS text")
    stored = spark.createDataFrame([(0, [1.0, 1.0]), (1, [8.0, 1.0])], "vec_id int, embedding array<float>")
    assert text_search(texts, stored, embedder, 1, **WAYS[way]).count() == 40
    sent = [line for path in tmp_path.iterdir() for line in path.read_text().splitlines()]
    assert len(sent) == 40


def test_lengths_must_agree(spark):
    asked, stored = frames(spark, [(0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])])
    with pytest.raises(Exception, match="same length|mismatch"):
        vector_topk(asked, stored.coalesce(1), 3).collect()


def test_text_search_uses_one_model(spark):
    embedder = HashingEmbedder(32)
    texts = spark.createDataFrame([(0, "red apple"), (1, "green pear"), (2, "blue sky")], "vec_id int, text string")
    vectors = embedded(embed_rows(texts, embedder))
    other = vectors.selectExpr("vec_id + 100 AS vec_id", "text", "embedding", "'other' AS model", "dimension")
    asked = spark.createDataFrame([(7, "a green pear")], "query_id int, text string")
    best = text_search(asked, vectors.unionByName(other), embedder, 1).collect()
    assert [(r["query_id"], r["vec_id"]) for r in best] == [(7, 1)]


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        vector_topk(*frames(spark, *data(1)), 0)


def groups(seed, size=4000):
    """Vectors in narrow groups, a third of them in one, with copies and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    group = np.where(np.arange(size) % 3 == 0, 0, rng.integers(1, 12, size))
    rows = (centres[group] + rng.normal(size=(size, 16)) * 0.05).round(3)
    rows[5:9] = 0
    rows[20:26] = rows[20]
    return [(i, v) for i, v in enumerate(rows.tolist())]


@pytest.mark.parametrize("query_bytes", [1 << 20, 2000])
def test_rings_are_passed_over_and_nothing_is_lost(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(search, "RING", 64)
    vectors = groups(3)
    queries = [(i, v) for i, v in vectors[:60:2]] + [(100_001, [0.0] * 16), (100_002, [-x for x in vectors[3][1]])]
    report = SearchReport.of(spark)
    asked, stored = frames(spark, queries, vectors)
    found = vector_topk(asked, stored, 5, query_bytes=query_bytes, report=report).collect()
    assert {tuple(r) for r in found} == brute_force(queries, vectors, 5)
    assert report.pairs.value == len(queries) * len(vectors)
    assert report.passed_over > 0.4
    # A wrong bound is noticed: without room for the width of a ring, vectors are missed.
    monkeypatch.setattr(search, "_ANGLE_SLACK", -0.6)
    assert {tuple(r) for r in vector_topk(asked, stored, 5).collect()} != brute_force(queries, vectors, 5)


def test_queries_do_not_go_through_the_driver(spark, monkeypatch):
    kind = type(spark.range(1))
    collect, collected = kind.collect, []
    monkeypatch.setattr(kind, "collect", lambda self: collected.append(self.columns) or collect(self))
    monkeypatch.setattr(kind, "toArrow", lambda self: pytest.fail("rows on the driver"))
    found = vector_topk(*frames(spark, *data(2)), 3, query_bytes=800)
    assert collected == [["path", "bytes"]] and found.count() == 63


@pytest.mark.parametrize("name", ["text_search", "vector_topk", "vector_topk_grid"])
def test_zero_vectors_stand_where_sql_has_them(spark, tmp_path, name):
    # The words of the second text cancel: both fall into one dimension, with opposite signs.
    texts = ["red apple", "w0 w4", "green pear", "a blue sky", "the apple tree", ""] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the red apple"), (1, "w4 w0")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = [(i, [1.0, i / 7, -2.0] if i % 5 else [0.0] * 3) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = connection.execute(spark_entry.oracle_sql()[name]).fetchdf()
    got = spark_entry.queries()[name](spark, f"{tmp_path}").toPandas()
    assert want["score"].isna().any() and differences(got, want) is None


def test_halves_are_rounded_as_in_sql(spark):
    # The cosine is 1001/1024, or 0.9775390625.
    asked, stored = frames(spark, [(0, [1.0, 0.0, 0.0, 0.0, 0.0])], [(0, [1001.0, 215.0, 18.0, 1.0, 5.0])])
    assert [r["score"] for r in vector_topk(asked, stored, 1).collect()] == [0.977539063]


def test_slices_are_one_job(spark):
    queries, vectors = data(4, copies=30)
    asked, stored = frames(spark, queries, vectors)
    jobs = []
    for query_bytes in (700, 100):
        spark.sparkContext.setJobGroup(f"slices of {query_bytes}", "")
        found = vector_topk(asked, stored, 3, query_bytes=query_bytes)
        assert {tuple(r) for r in found.collect()} == brute_force(queries, vectors, 3)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"slices of {query_bytes}")))
    spark.sparkContext.setJobGroup("", "")
    # With more slices there are no more jobs.
    assert jobs[1] <= jobs[0]
