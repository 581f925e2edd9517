"""How often texts go to Python, and how many files intermediate tables have."""

from pathlib import Path

import corpus_pipeline
import pytest

from vecweave.llm.components import components
from vecweave.llm.language import identify_languages
from vecweave.llm.line_dedup import new_index, shared_keys
from vecweave.llm.simhash import simhash_components
from vecweave.sources.storage import run_folder

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"),
    (2, "der schnelle braune fuchs springt über den faulen hund", "de"),
    (3, "the dog sleeps", None),
    (4, None, None),
    (5, "123 !", "en"),
    (6, "der hund schläft", None),
]


@pytest.fixture
def many_partitions(spark):
    """A shuffle of many partitions, none of which Spark puts together."""
    names = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark.sparkContext.defaultParallelism
    for name, value in before.items():
        spark.conf.set(name, value)


def tables(spark) -> dict[str, int]:
    """The files of each intermediate table so far."""
    folder = Path(run_folder(spark).removeprefix("file:"))
    return {str(one): len(list(one.glob("part-*"))) for one in folder.glob("*")}


def written(spark, before: dict[str, int]) -> list[int]:
    return [files for table, files in tables(spark).items() if table not in before]


def test_languages_are_identified_once(spark, capsys):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string")
    found = identify_languages(docs)
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert {r.doc_id: r.lang for r in found.collect()} == {1: "en", 2: "de", 3: "en", 6: "de"}


def test_rounds_write_few_files(spark, many_partitions):
    path = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    before = tables(spark)
    found = components(path, "a", "b")
    sizes = written(spark, before)
    assert len(sizes) > 5
    # The number of the first edges is not known before they are written.
    assert sorted(sizes)[-2] <= many_partitions and max(sizes) <= 48
    assert found.count() == 61 and found.filter("component <> 0").count() == 0


def test_groups_of_fingerprints_write_few_files(spark, many_partitions):
    docs = spark.range(900).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 9), i -> md5(concat(id div 3, '-', i)))) AS text")
    before = tables(spark)
    found = {r.doc_id: r.component_id for r in simhash_components(docs).collect()}
    assert max(written(spark, before)) <= many_partitions
    assert found == {i: i - i % 3 for i in range(900)}


def test_counts_of_lines_write_few_files(spark, many_partitions):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('a line that every document has\n', 'a line of a few documents: ', id div 4, '\n', md5(string(id))) AS text")
    before = tables(spark)
    index = new_index(spark).add(docs.filter("doc_id % 2 = 0"), new_ids=True).add(docs.filter("doc_id % 2 = 1"), new_ids=True)
    counts = {(r.n_docs, r.last) for r in shared_keys(index).collect()}
    assert counts == {(400, 399)} | {(4, i + 3) for i in range(0, 400, 4)}
    # All but the counts at the end, which are put together from three tables.
    assert sum(files > many_partitions for files in written(spark, before)) <= 1


def test_near_dedup_keeps_the_batches_of_the_pipeline_small(spark, monkeypatch):
    from vecweave.llm import simhash

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    fingerprints = simhash._fingerprints
    monkeypatch.setattr(simhash, "_fingerprints", lambda *a: (seen.append(spark.conf.get(name)), fingerprints(*a))[1])
    before = spark.conf.get(name)
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string")
    try:
        kept = corpus_pipeline.near_dedup(spark, docs, "")
    finally:
        spark.conf.set(name, before)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
    assert seen == [corpus_pipeline.BATCH_BYTES]
