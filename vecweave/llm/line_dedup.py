"""Removal of lines that many documents share, kept so that documents can be added and taken back.

A line's key is the line without white space at its ends, in lower case (A-Z). Keys are dealt over shards by their
hash. The state of an index is, in the shared folder,

* the exact references: a row (key, doc_id, lines) for each key of a document, written once per generation of added
  documents,
* the reference counts: a row (key, n_docs, last) for each key, with the number of documents that hold it and the largest
  of them, and
* for each shard cuckoo filters of the keys it holds.

When documents are added, their own counts are asked of the filters: a key that these do not know is new, and its count is
kept as it is. Only the others are looked up among the counts of earlier generations and added to them. A document that
is deleted goes from the references by its id; its keys are counted again, and those that lose their last reference go
from the filters. Counts are added up within tasks first, so a line that a third of all documents has is a few numbers per
task, never a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.cuckoo import CuckooFilter
from vecweave.llm.frames import WHITE_SPACE, fresh_names, split_join
from vecweave.operators.joins import broadcast_if_small
from vecweave.sources.storage import materialize

MIN_KEY_CHARS = 20
MIN_DOCUMENTS = 3
# Keys of a shard in the first generation; so many keys are in one filter at most (256 KB). Later generations have filters
# of their own.
FILTER_KEYS = 1 << 16
# In so many generations the query adds its documents.
GENERATIONS = 2
# A list of keys is sent to every task up to so many bytes.
_MAX_KEY_BYTES = 16 << 20
# A null id counts as the smallest of all.
_NO_ID = "-9223372036854775808L"
_LINES = r"split(coalesce({text}, ''), '\n', -1)"
_TRIM = r"' \t\n\u000b\u000c\r'"
_KEY = (
    "translate(trim(BOTH " + _TRIM + " FROM line), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)


def _hash(key: str) -> str:
    """128 bits of a key; the second half is of another text and so independent of the first."""
    return f"named_struct('a', xxhash64({key}), 'b', xxhash64(concat('#', {key})))"


def line_references(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_KEY_CHARS,
) -> DataFrame:
    """(key, doc_id, lines): for each key of at least ``min_chars`` code points of a document, how many lines have
    it. Spark adds up within tasks before anything moves."""
    keys = f"transform({_LINES.format(text='text')}, line -> {_KEY})"
    rows = docs.select(
        F.expr(f"coalesce(CAST(`{doc_id}` AS BIGINT), {_NO_ID})").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    return (
        rows.select("doc_id", F.explode(F.expr(f"filter({keys}, key -> char_length(key) >= {min_chars})")).alias("key"))
        .selectExpr("doc_id", f"{_hash('key')} AS key")
        .groupBy("key", "doc_id")
        .agg(F.count("*").alias("lines"))
        .select("key", "doc_id", "lines")
    )


def _python_key(line: str) -> tuple[int, int]:
    """The hash of a line's key, as Spark makes it."""
    key = line.strip(WHITE_SPACE).encode("utf-8", "surrogatepass").lower()
    halves = (xxhash.xxh64_intdigest(part, 42) for part in (key, b"#" + key))
    return tuple(half - (half >> 63 << 64) for half in halves)


def _stream(kept: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Filters and keys of a shard in one partition, the filters first: keys then pass by, never held all at once."""
    both = kept.select("shard", "filter", F.lit(None).cast("bigint").alias("hash")).unionByName(
        keys.select(F.expr(f"pmod(key.a, {shards}L) AS shard"), F.lit(None).cast("binary").alias("filter"), F.col("key.a").alias("hash"), *keys.columns),
        allowMissingColumns=True,
    )
    return both.repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the shard changes."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
            yield batch.slice(start, stop - start)


_KEY_TYPE = "struct<a: bigint, b: bigint>"


def _counted(references: DataFrame) -> DataFrame:
    """(key, n_docs, last) of references."""
    return references.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))


@dataclass(frozen=True)
class LineIndex:
    """An index of lines: exact references, reference counts and the filters of the shards (tables in the shared folder).
    The number of shards follows from the keys that are added first; it is zero before."""

    references: DataFrame  # key, doc_id, lines
    counts: DataFrame  # key, n_docs, last
    filters: DataFrame  # shard, filter
    shards: int
    min_chars: int

    def screened(self, keys: DataFrame) -> DataFrame:
        """Rows with a key, and ``known``: it is false if the key is surely not in the index."""
        names = keys.columns

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, kept = None, []
            for batch in _runs(batches):
                if batch.num_rows and batch["shard"][0] != at:
                    at, kept = batch["shard"][0], []
                given = batch.filter(batch["filter"].is_valid())
                kept += [CuckooFilter.from_bytes(one) for one in given["filter"].to_pylist()]
                asked = batch.filter(batch["filter"].is_null())
                hashes = asked["hash"].to_numpy(zero_copy_only=False)
                known = np.zeros(len(hashes), bool)
                for one in kept:
                    known |= one.find(hashes)
                yield pa.RecordBatch.from_arrays([*(asked[name] for name in names), pa.array(known)], [*names, "known"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", known boolean"
        return _stream(self.filters, keys, self.shards).mapInArrow(screen, schema)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", new_ids: bool = False) -> LineIndex:
        """The index with the lines of more documents. Of a document that it holds already only lines count that it does
        not hold for it, so adding one twice changes nothing; ``new_ids`` says that there are none and saves the look.

        Keys that the filters do not know are new without a look at the counts; only the others are looked up, so that a
        filter holds each key once and a key has one count.
        """
        refs = line_references(docs, doc_id, text, self.min_chars)
        if not new_ids and self.shards:
            refs = refs.join(self.references.select("key", "doc_id"), ["key", "doc_id"], "left_anti").select(*self.references.columns)
        refs = materialize(refs)
        n_refs = refs.count()
        counted = materialize(_counted(refs), n_refs)
        if not self.shards:
            first = replace(self, references=refs, counts=counted, shards=-(-counted.count() // FILTER_KEYS))
            return replace(first, filters=materialize(first._made(counted.select("key")))) if first.shards else self
        screened = materialize(self.screened(counted))
        unknown = screened.filter("NOT known").drop("known")
        before = self.counts.toDF("key", "n_before", "last_before")
        asked = materialize(screened.filter("known").drop("known").join(before, "key", "left"), n_refs)
        grown = asked.select("key", (F.col("n_docs") + F.coalesce("n_before", F.lit(0))).alias("n_docs"), F.greatest("last", "last_before").alias("last"))
        kept = self.counts.join(broadcast_if_small(asked.select("key"), _MAX_KEY_BYTES), "key", "left_anti").select(*self.counts.columns)
        new = unknown.select("key").union(asked.filter("n_before IS NULL").select("key"))
        return replace(
            self,
            references=self.references.unionByName(refs),
            counts=materialize(kept.unionByName(unknown).unionByName(grown)),
            filters=self.filters.unionByName(materialize(self._made(new))),
        )

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose ids are in the one column of ``ids``."""
        gone_ids = ids.select(
            F.coalesce(F.col(ids.columns[0]).cast("bigint"), F.expr(_NO_ID)).alias("doc_id")
        ).distinct()
        left = materialize(
            self.references.join(gone_ids, "doc_id", "left_anti").select(*self.references.columns)
        )
        touched = materialize(self.references.join(gone_ids, "doc_id", "left_semi").select("key").distinct())
        again = materialize(_counted(left.join(touched, "key", "left_semi").select("key", "doc_id")))
        counts = self.counts.join(touched, "key", "left_anti").select(*self.counts.columns).unionByName(again)
        gone = touched.join(again, "key", "left_anti")
        return replace(self, references=left, counts=materialize(counts), filters=materialize(self._without(gone)))

    def _made(self, keys: DataFrame) -> DataFrame:
        """New filters of ``keys``, as many as a shard needs."""

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, size = None, [], 0

            def made() -> pa.RecordBatch:
                one = CuckooFilter.of(np.concatenate(held))
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([one.to_bytes()])], ["shard", "filter"])

            for batch in _runs(batches):
                shard = batch["shard"][0].as_py()
                if size and (shard != at or size >= FILTER_KEYS):
                    yield made()
                    held, size = [], 0
                at = shard
                held.append(batch["hash"].to_numpy(zero_copy_only=False))
                size += batch.num_rows
            if size:
                yield made()

        none = self.filters.filter("false")
        return _stream(none, keys, self.shards).mapInArrow(make, "shard long, filter binary")

    def _without(self, keys: DataFrame) -> DataFrame:
        """The filters with ``keys`` removed."""

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, kept = None, []

            def rest() -> pa.RecordBatch:
                data = pa.array([one.to_bytes() for one in kept], pa.binary())
                return pa.RecordBatch.from_arrays([pa.array([at] * len(kept), pa.int64()), data], ["shard", "filter"])

            for batch in _runs(batches):
                shard = batch["shard"][0].as_py()
                if shard != at:
                    if kept:
                        yield rest()
                    at, kept = shard, []
                kept += [CuckooFilter.from_bytes(one) for one in batch["filter"].drop_null().to_pylist()]
                hashes = batch.filter(batch["filter"].is_null())["hash"].to_numpy(zero_copy_only=False)
                for one in kept:
                    here = one.find(hashes)
                    one.remove(hashes[here])
                    hashes = hashes[~here]
            if kept:
                yield rest()

        return _stream(self.filters, keys, self.shards).mapInArrow(remove, "shard long, filter binary")


def new_index(spark: SparkSession, min_chars: int = MIN_KEY_CHARS) -> LineIndex:
    """An empty index."""
    references = spark.createDataFrame([], f"key {_KEY_TYPE}, doc_id bigint, lines bigint")
    counts = spark.createDataFrame([], f"key {_KEY_TYPE}, n_docs bigint, last bigint")
    return LineIndex(references, counts, spark.createDataFrame([], "shard bigint, filter binary"), 0, min_chars)


def shared_keys(index: LineIndex, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(key, n_docs, last): keys in at least ``min_documents`` documents, and the largest id among these."""
    return index.counts.filter(F.col("n_docs") >= min_documents)


def drop_shared_lines(
    docs: DataFrame,
    index: LineIndex,
    doc_id: str = "doc_id",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with ``text`` rewritten: lines whose key is in at least ``min_documents`` documents of ``index`` go, but
    for those in the largest id that holds the key.

    All columns stay as they are, but for the text. A null text is one empty line and becomes the empty text. Rows that
    share an id are one document for counting, and each keeps or loses its own lines; rows without an id are one document
    with the smallest id. An empty table stays empty. ``counts`` names columns for the lines before and those dropped.
    """
    did, drops, done = fresh_names(docs, 3)
    shared = materialize(shared_keys(index, min_documents))
    refs = index.references.select("key", "doc_id")
    drop = (
        split_join(refs, shared, "key", "n_docs", how="inner", spread_by=F.xxhash64("doc_id"))
        .filter("doc_id < last")
        .groupBy(F.col("doc_id").alias(did))
        .agg(F.collect_list("key").alias(drops))
    )

    @F.arrow_udf("struct<text: string, dropped: bigint>")
    def rewrite(texts: pa.Array, gone: pa.Array) -> pa.Array:
        """Only documents that lose lines are given with their text."""
        values = gone.flatten()
        pairs = list(zip(values.field("a").to_pylist(), values.field("b").to_pylist()))
        ends = np.cumsum(gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        start, found, dropped = 0, [], []
        for one, end in zip(texts, ends):
            if end == start:
                found.append(None)
                dropped.append(0)
                continue
            keys, lines = set(pairs[start:end]), one.as_py().split("\n")
            kept = [line for line in lines if _python_key(line) not in keys]
            found.append("\n".join(kept))
            dropped.append(len(lines) - len(kept))
            start = end
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.string()), pa.array(dropped, pa.int64())], ["text", "dropped"]
        )

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    joined = docs.withColumn(did, F.expr(f"coalesce(CAST(`{doc_id}` AS BIGINT), {_NO_ID})")).join(drop, did, "left")
    touched = joined.withColumn(done, rewrite(F.when(F.col(drops).isNotNull(), whole), F.col(drops)))
    columns = [
        (F.when(F.col(drops).isNull(), whole).otherwise(F.col(f"{done}.text")) if c == text else F.col(f"`{c}`")).alias(c)
        for c in docs.columns
    ]
    if counts:
        lines = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
        columns += [lines.cast("bigint").alias(counts[0]), F.col(f"{done}.dropped").alias(counts[1])]
    return touched.select(*columns)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None, generations: int = GENERATIONS) -> DataFrame:
    """Index the lines of ``docs``, generation by generation, and drop those they share."""
    index, number = new_index(docs.sparkSession), F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("bigint")), F.lit(generations))
    for generation in range(generations):
        index = index.add(docs.filter(number == generation), doc_id, text, new_ids=True)
    return drop_shared_lines(docs, index, doc_id, text, counts=counts)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rewritten = dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return rewritten.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
shared AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
    SELECT k.*, s.key IS NOT NULL AND k.doc_id < s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
