"""Versions of the vector table: what is read is what a table of all changes would give."""

import pytest
from pyspark.sql import functions as F

from vecweave.sources.vector_store import VectorStore


def vectors(spark, ids, value, models=("a", "b")):
    rows = [(i, m, [float(value), float(i)]) for i in ids for m in models]
    return spark.createDataFrame(rows, "id bigint, model string, embedding array<float>")


def keys(spark, ids, models=("a", "b")):
    return spark.createDataFrame([(i, m) for i in ids for m in models], "id bigint, model string")


def found(df):
    return {(r["model"], r["id"]): r["embedding"][0] for r in df.collect()}


def expected(*changes):
    now = {}
    for ids, value in changes:
        for i in ids:
            for m in "ab":
                if value is None:
                    now.pop((m, i), None)
                else:
                    now[m, i] = float(value)
    return now


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_changes_removals_and_compaction(spark, tmp_path, limit):
    store = VectorStore(spark, f"{tmp_path}/s", limit)
    steps = [(range(20), 1), (range(5, 10), 2), (range(8, 12), None), (range(9, 30, 3), 3), ([500], None)]
    done = []
    for ids, value in steps:
        made = store.remove(keys(spark, ids)) if value is None else store.upsert(vectors(spark, ids, value))
        done.append((ids, value))
        assert made.version == len(done) == store.versions()[-1]
        assert found(store.read()) == expected(*done)
    before = found(store.read())
    compacted = store.compact()
    assert compacted.deltas == () and compacted.base.rows == len(before) and found(store.read()) == before
    assert store.compact() == compacted
    store.remove(keys(spark, [0]))
    store.upsert(vectors(spark, [0, 1], 7, "a"))
    assert found(store.read()) == {k: v for k, v in before.items() if k != ("b", 0)} | {("a", 0): 7.0, ("a", 1): 7.0}
    assert found(store.read("b")) == {k: v for k, v in before.items() if k[0] == "b" and k[1]}
    # Earlier versions are still there, until they are forgotten.
    for version in range(1, 6):
        assert found(store.read(version=version)) == expected(*steps[:version])
    now = found(store.read())
    assert store.forget() == 7 and store.versions() == [8] and found(store.read()) == now
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("delta")]) == 2
    with pytest.raises(ValueError, match="no version 3"):
        store.read(version=3)


def test_newest_version_of_one_change_counts(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/s")
    both = vectors(spark, [1], 1).withColumn("version", F.lit(1)).union(vectors(spark, [1], 2).withColumn("version", F.lit(2)))
    store.upsert(both)
    assert found(store.read()) == {("a", 1): 2.0, ("b", 1): 2.0} and "version" in store.read().columns


def test_changes_at_the_same_time(spark, tmp_path, monkeypatch):
    one, two = VectorStore(spark, f"{tmp_path}/s"), VectorStore(spark, f"{tmp_path}/s")
    one.upsert(vectors(spark, range(4), 1))
    # The other one commits between the reading of the manifest and its replacement.
    plain, first = one.manifest, []

    def late(version=None):
        told = plain(version)
        if not first:
            first.append(two.upsert(vectors(spark, [2, 9], 5)))
        return told

    monkeypatch.setattr(one, "manifest", late)
    one.upsert(vectors(spark, [3], 6))
    assert one.versions() == [1, 2, 3] and found(two.read()) == expected((range(4), 1), ([2, 9], 5), ([3], 6))
    first.clear()

    def late_upsert(version=None):
        told = plain(version)
        if not first:
            first.append(two.upsert(vectors(spark, [0], 8)))
        return told

    monkeypatch.setattr(one, "manifest", late_upsert)
    assert len(one.compact().deltas) == 1  # what came meanwhile
    assert found(two.read()) == expected((range(4), 1), ([2, 9], 5), ([3], 6), ([0], 8))


def test_base_is_neither_ranked_nor_moved(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/s")
    store.upsert(vectors(spark, range(100), 1))
    store.compact()
    store.upsert(vectors(spark, range(3), 2))
    plan = store.read("a")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert "PartitionFilters: [isnotnull(model" in plan
    store.upsert(vectors(spark, range(2), 3))
    plan = store.read("a")._jdf.queryExecution().executedPlan().toString()
    base = plan[plan.index("BroadcastHashJoin") :].split("BroadcastExchange")[0]
    assert "Window" not in base and "hashpartitioning" not in base


def test_compaction_when_it_is_due(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read()
    with pytest.raises(ValueError):
        store.remove(keys(spark, [1]))
    store.upsert(vectors(spark, range(100), 1))
    assert store.compact_if_needed() and not store.compact_if_needed()
    store.upsert(vectors(spark, range(10), 2))
    assert not store.compact_if_needed()
    store.upsert(vectors(spark, range(90), 3))
    assert store.compact_if_needed() and found(store.read())["a", 95] == 1.0 and found(store.read())["a", 5] == 3.0
