"""Reuse of known vectors."""

import glob

import pytest

from pyspark.sql import functions as F

from vecweave.functions.text import text_key
from vecweave.operators.cache import cache_misses, count_keys, embed_with_cache, join_vectors, keyed_rows
from vecweave.operators.embedders import CallableEmbedder, HashingEmbedder, ModelCallError, from_function
from vecweave.sources.storage import materialize, shared_folder


def rows_with_copies(spark):
    """A third of the rows have the same text, and some long texts differ only beyond the model's limit."""
    return spark.range(0, 300, 1, 4).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'copy' WHEN id % 3 = 1 THEN concat(repeat('long', 2000), id) "
        "ELSE concat('text ', id) END AS text",
    )


def no_cache(spark):
    return spark.createDataFrame([], "key string, model string, embedding array<float>")


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_each_missing_text_is_sent_once(spark, tmp_path, limit):
    folder = str(tmp_path)

    def noting(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as file:
            file.write("\n".join(text[:20] for text in texts))
        if "text 2" in texts:
            raise ModelCallError(400, "refused")
        return [[float(len(text))] for text in texts]

    embedder = CallableEmbedder("noting", 1, call=from_function(noting))
    df = rows_with_copies(spark)
    # Every way to find the rows of missing keys sends the same texts.
    known, fresh = embed_with_cache(
        df, no_cache(spark), embedder, "id", on_error="batch", rows_per_split=7, max_broadcast_bytes=limit
    )
    assert fresh.count() <= 102
    done = {r["id"]: r["embedding"] for r in known.collect()}
    assert len(done) == 300
    assert {done[i] and tuple(done[i]) for i in range(0, 300, 3)} in ({(4.0,)}, {None})
    sent = [line for path in glob.glob(f"{folder}/*") for line in open(path).read().splitlines()]
    assert len(sent) == 102  # one copy, one long text, one hundred others


def test_second_run_sends_nothing(spark):
    embedder = HashingEmbedder(8)
    df = rows_with_copies(spark)
    first, fresh = embed_with_cache(df, no_cache(spark), embedder, "id")
    again, more = embed_with_cache(df, fresh, embedder, "id")
    assert more.count() == 0
    assert sorted(first.collect()) == sorted(again.collect())


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    embedder = HashingEmbedder(8)
    keyed = materialize(keyed_rows(rows_with_copies(spark), embedder, "id"))
    counted = count_keys(keyed, "id")
    vectors = counted.selectExpr("key", "array(CAST(copies AS FLOAT)) AS embedding")
    whole = join_vectors(keyed, counted, vectors, "id")
    split = join_vectors(keyed, counted, vectors, "id", rows_per_split=9)
    assert sorted(split.collect()) == sorted(whole.collect())
    assert split.count() == 300 and split.filter("embedding IS NULL").count() == 0


def test_rows_without_a_known_vector_stay(spark):
    embedder = HashingEmbedder(8)
    keyed = keyed_rows(rows_with_copies(spark), embedder, "id")
    counted = count_keys(keyed, "id")
    some = counted.filter("copies > 1").selectExpr("key", "array(1.0F) AS embedding")
    got = join_vectors(keyed, counted, some, "id", rows_per_split=5)
    assert got.count() == 300 and got.filter("embedding IS NULL").count() == 100
    assert cache_misses(counted, some).count() == 100


def test_key_follows_model_and_seen_text(spark):
    row = spark.range(1).select(
        *[
            F.expr(text_key(model, text)).alias(name)
            for name, model, text in (
                ("a", "m", "repeat('x', 8000)"),
                ("b", "m", "repeat('x', 9000)"),
                ("c", "n", "repeat('x', 9000)"),
            )
        ]
    ).first()
    assert row["a"] == row["b"] != row["c"]


@pytest.mark.parametrize("limit", [0, 6000, 1 << 20])
def test_ways_to_find_missing_texts_agree(spark, limit):
    embedder = HashingEmbedder(8)
    df = rows_with_copies(spark)
    _, some = embed_with_cache(df.filter("id < 60"), no_cache(spark), embedder, "id")
    got, fresh = embed_with_cache(df, some, embedder, "id", max_broadcast_bytes=limit)
    assert fresh.count() == 80 and got.filter("embedding IS NULL").count() == 0
    assert got.select("key").distinct().count() == 102


def test_shared_folder_is_that_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_names_of_models_do_not_run_into_texts(spark):
    one, other = text_key("m", "'n\\nx'"), text_key("m\nn", "'x'")
    row = spark.range(1).selectExpr(f"{one} AS one", f"{other} AS other").first()
    assert row["one"] != row["other"]


def test_intermediate_tables_can_be_removed(spark):
    from pathlib import Path

    from vecweave.sources.storage import remove_intermediate, run_folder

    assert materialize(spark.range(3)).count() == 3
    assert Path(run_folder(spark)).is_dir()
    assert remove_intermediate(spark) and not Path(run_folder(spark)).exists()


def entries(ids):
    return [(f"key{i}", "m", [float(i)]) for i in ids]


def test_table_of_entries_is_read_where_it_is(spark, tmp_path):
    from vecweave.sources.cache_table import CacheTable

    table = CacheTable(spark, f"{tmp_path}/it's a cache", buckets=16)
    schema = "key string, model string, embedding array<float>"
    table.append(spark.createDataFrame(entries(range(400)), schema))
    table.append(spark.createDataFrame(entries(range(400, 500)), schema))
    assert sorted(map(tuple, table.read().collect())) == sorted(entries(range(500)))
    few = spark.createDataFrame([("key3",), ("key450",), ("none",), ("key3",)], "key string")
    assert sorted(r["embedding"][0] for r in table.lookup(few).collect()) == [3.0, 450.0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(1000).selectExpr("concat('key', id * 2) AS key")
        for found in (table.lookup(many), cache_misses(count_keys(many.withColumn("id", F.lit(1)), "id"), table.read())):
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
            final = plan.split("Initial Plan")[0]
            scan = final[: final.index(table.name)].splitlines()
            # Between the join and the scan of the table nothing is exchanged.
            join = max(i for i, line in enumerate(scan) if "Join" in line)
            side = [line for line in scan[join + 1 :]]
            last_side = side[max((i for i, line in enumerate(side) if line.lstrip(" :").startswith("+-")), default=0) :]
            assert not any("Exchange" in line for line in last_side), plan
        assert table.lookup(many).count() == 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    table.forget()
    # Another session finds the same files.
    again = CacheTable(spark, f"{tmp_path}/it's a cache", buckets=16)
    assert again.read().count() == 500
    # Few keys are looked up in their own buckets: those of others may be broken.
    needed = {r[0] for r in few.select(F.pmod(F.hash("key"), F.lit(16))).collect()}
    for path in (tmp_path / "it's a cache").glob("*.parquet"):
        if int(path.name.split("_")[1].split(".")[0]) not in needed:
            path.write_bytes(b"broken")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    spark.catalog.refreshTable(table.name)
    assert again.lookup(few).count() == 2
    with pytest.raises(Exception):
        again.read().count()


def test_table_grows_by_what_was_missing(spark, tmp_path):
    from vecweave.operators.cache import embed_with_table
    from vecweave.sources.cache_table import CacheTable

    table, embedder = CacheTable(spark, f"{tmp_path}/cache", buckets=4), HashingEmbedder(8)
    df = rows_with_copies(spark)
    want, _ = embed_with_cache(df, no_cache(spark), embedder, "id")
    first = embed_with_table(df.filter("id < 150"), table, embedder, "id", rows_per_split=7)
    assert first.count() == 150
    had = table.read().count()
    got = embed_with_table(df, table, embedder, "id", rows_per_split=7)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert had < table.read().count() == table.read().select("key").distinct().count()
