"""Near-duplicate texts by SimHash.

A fingerprint is 64 bits, one per majority of the bits of the hashes of a text's word shingles. Fingerprints are found
near each other through an embedding: a fingerprint is cut into segments of four bits, and the numbers of ones in these
are its coordinates. A differing bit moves one coordinate by one, so the Manhattan distance of two embeddings is at most
the Hamming distance of the fingerprints, and a range join on the embeddings loses no pair. Pairs it finds are compared
bit by bit.

The range join: if sixteen coordinates differ by at most 4 in sum, one of their two halves differs by at most 2, and two
points of a half that are at most 2 apart have a grid point within 1 of both. So every fingerprint visits, for each half,
its own grid point and the 16 next to it, and only those that meet at a point are compared. Everything runs on different
fingerprints: copies, however many, are one. What is passed on from a group of fingerprints is enough links to join it,
not all that it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vecweave.llm.components import components, forest
from vecweave.llm.frames import fresh_names, small_batches, split_join
from vecweave.sources.storage import materialize

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
# Groups of up to so many rows are compared row by row, all at once.
SMALL_GROUP = 32
# A bucket of meetings with more rows is cut into blocks.
MEETING_ROWS = 4096
# A task thins out its links whenever it has so many.
FOREST_EDGES = 1 << 18
# Hashes of one text that are added up at a time.
_HASHES = 1 << 16
# Texts are digested one by one, so larger batches only take memory.
BATCH_BYTES = "4m"


def fingerprint_of(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text in UTF-8. No words: zero. Fewer words than a shingle: one shingle of all of them."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(lengths) - lengths
    count = max(1, len(found) - words + 1)
    last = starts[-count:] + lengths[-count:] - 1
    ones = np.zeros(64, np.int64)
    for first in range(0, count, _HASHES):
        cuts = zip(starts[first : min(count, first + _HASHES)].tolist(), last[first : first + _HASHES].tolist())
        shingles = [joined[start:end] for start, end in cuts]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


@F.arrow_udf(LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """Fingerprints of texts, as signed numbers; a null text has no words."""
    texts = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary())
    found = np.fromiter((fingerprint_of(one.as_py() or b"") for one in texts), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def _spanning(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Few links that join all fingerprints of a block which are linked directly or by way of others in it. Each finds
    its neighbours among those that none has found before."""
    edges: tuple[list[int], list[int]] = ([], [])
    left, todo = prints, []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        near = np.bitwise_count(left ^ at) <= MAX_BITS
        if near.any():
            found = left[near].tolist()
            edges[0].extend([int(at)] * len(found))
            edges[1].extend(found)
            todo.extend(left[near])
            left = left[~near]
    return edges


def _links_of_groups(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups, whose rows stand together: all of a small group, enough to join those of a large one."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
    sizes = last - first
    a, b = [], []
    # Small groups are compared all at once, each row with the first after it, then the second, and so on.
    end = np.repeat(np.where(sizes <= SMALL_GROUP, last, 0), sizes)
    row = np.arange(len(group))
    for step in range(1, SMALL_GROUP):
        row = row[row + step < end[row]]
        if not len(row):
            break
        near = row[np.bitwise_count(prints[row] ^ prints[row + step]) <= MAX_BITS]
        a.append(prints[near])
        b.append(prints[near + step])
    for at in np.flatnonzero(sizes > SMALL_GROUP).tolist():
        x, y = _spanning(prints[first[at] : last[at]])
        a.append(np.array(x, np.int64))
        b.append(np.array(y, np.int64))
    return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])


def near_fingerprints(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Links (a, b), a < b, between different fingerprints that differ in at most four bits: enough of them to join all
    that are linked directly or by way of others. ``prints`` has each once.

    Of a half that differs in at most two bits, one of three parts is equal. So what meets at a grid point has such a part
    in common, too. Those that meet are compared in a task; a bucket of meetings with more rows than ``MEETING_ROWS`` is
    cut into blocks, and every two blocks meet in a task of their own. A task passes on a forest, not all links.
    """
    # Ones in each group of four bits, kept in these four bits; one more, so that the grid has a point below zero.
    pairs = "((half & 1431655765L) + (shiftright(half, 1) & 1431655765L))"
    fours = f"(({pairs} & 858993459L) + (shiftright({pairs}, 2) & 858993459L))"
    steps = ", ".join(["0L"] + [f"{sign}{1 << 4 * i}L" for i in range(8) for sign in ("", "-")])
    # The three parts of a half, behind the number of the part.
    thirds = "array(half & 2047L, 2048L + (shiftright(half, 11) & 2047L), 4096L + shiftright(half, 22))"
    buckets = max(1, -(-prints.count() * 2 * 17 * 3 * 8 // MEETING_ROWS))
    points = (
        prints.selectExpr(
            f"{column} AS print",
            # The lower half and the upper half, which is marked by bit 40.
            f"posexplode(array({column} & 4294967295L, shiftrightunsigned({column}, 32))) AS (upper, half)",
        )
        .selectExpr("print", f"{thirds} AS thirds", f"{fours} + 286331153L + upper * 1099511627776L AS centre")
        .selectExpr("print", "thirds", f"explode(transform(array({steps}), step -> (centre + step) * 8192)) AS point")
        .selectExpr("print", "explode(transform(thirds, third -> point + third)) AS key")
        .select("print", "key", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"))
    )
    # At most (all rows / MEETING_ROWS) buckets can be that large, which bounds their list.
    large = points.groupBy("bucket").count().filter(F.col("count") > MEETING_ROWS).selectExpr("bucket", f"CAST(ceil(count / {MEETING_ROWS}) AS INT) AS blocks")
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (
        points.join(F.broadcast(large), "bucket", "left")
        .select("bucket", "key", "print", F.coalesce(block, F.lit(0)).alias("block"), other.alias("other"))
        .select("bucket", "key", "print", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]
        found: list[list[np.ndarray]] = [[], []]
        size = 0

        def compare(columns: list[np.ndarray]) -> None:
            nonlocal size
            change = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            for out, links in zip(found, _links_of_groups(np.concatenate([[0], np.cumsum(change)]), columns[3])):
                out.append(links)
            size += len(found[0][-1])

        def thinned() -> pa.RecordBatch:
            nonlocal size
            a, b = forest(np.concatenate(found[0]), np.concatenate(found[1]))
            found[0].clear(), found[1].clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [np.concatenate([h, batch[c].to_numpy().astype(np.int64)]) for h, c in zip(held, ("key", "x", "y", "print"))]
            if not len(columns[0]):
                continue
            # The last group goes on in the next batch.
            same = np.all([c == c[-1] for c in columns[:3]], axis=0)
            whole = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            held = [c[whole:] for c in columns]
            if whole:
                compare([c[:whole] for c in columns])
            if size >= FOREST_EDGES:
                yield thinned()
        if len(held[0]):
            compare(held)
        if size:
            yield thinned()

    met = dealt.repartition("bucket", "x", "y").sortWithinPartitions("key", "x", "y", "print").mapInArrow(meet, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_components(rows: DataFrame) -> DataFrame:
    """Add ``component_id`` to written rows with doc_id and fingerprint."""
    n_rows = rows.count()
    prints = materialize(
        rows.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), n_rows
    )
    found = components(near_fingerprints(prints.select("fingerprint")), "a", "b")
    rooted = materialize(
        prints.join(found, prints.fingerprint == found.vertex, "left").select(
            "fingerprint", "copies", "least", F.coalesce("component", "fingerprint").alias("root")
        ),
        n_rows,
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "copies", "root", "component_id")
    return split_join(rows, named, "fingerprint", "copies", spread_by=F.xxhash64("doc_id"))


def _fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    column = F.col(f"`{text}`")
    return docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.xxhash64(column).alias("digest"),
        simhash(column).alias("fingerprint"),
    )


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    A component is the fingerprints that are linked directly or by way of others; its id is the smallest ``doc_id`` of
    their rows, null only if none of them has one. Texts without words share the fingerprint zero. Rows that share an id
    are rows of their own. An empty table gives an empty result; other columns do not matter.
    """
    with small_batches(docs.sparkSession, BATCH_BYTES):
        rows = materialize(_fingerprints(docs, doc_id, text).drop("digest"))
    return _with_components(rows).select("doc_id", "fingerprint", "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id, where a null id comes last;
    of rows that share id and group, the one whose text has the smallest hash, and any of those that are equal."""
    with small_batches(docs.sparkSession, BATCH_BYTES):
        rows = materialize(_fingerprints(docs, doc_id, text))
    found = _with_components(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    did, digest = fresh_names(docs, 2)
    keep = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias(did), F.col("first.digest").alias(digest)
    )
    # Null ids meet as one further value, so that the join stays one of equal keys.
    key = [F.coalesce(F.col(did), F.lit(0)).alias(did), F.col(did).isNull().alias(f"{did}n"), F.col(digest)]
    marked = docs.select(
        "*",
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(0)).alias(did),
        F.col(f"`{doc_id}`").cast("bigint").isNull().alias(f"{did}n"),
        F.xxhash64(F.col(f"`{text}`")).alias(digest),
    )
    names = [did, f"{did}n", digest]
    kept = marked.join(keep.select(*key).distinct(), names, "left_semi").dropDuplicates(names)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
