"""Importance resampling of documents towards a target distribution.

Words come from the pre-tokenizer of the ``tokenizers`` library: a Split by an untrained pattern over text in which A-Z
are lower case. It gives every word with its offsets. Features are windows of one to three words, each the pair of the
offset where its first word starts and that where its last one ends, in the words joined by one space. A window's bucket
is its checksum; checksums of windows are put together from those of their words. Counts by bucket, over all documents
and over all target texts, give the gain of a bucket; a document weighs the sum of the gains of its features. A random
number that a hash of the id gives is added, and the highest scores are drawn: sampling without replacement, by weight.

Texts are cut into pieces at white space, which no word contains. Every different piece of a batch is split once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.checksums import moved_over
from vecweave.llm.frames import small_batches
from vecweave.llm.words import gather, give_back_memory, plain_strings, slices
from vecweave.sources.storage import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_WORDS = 3
BUCKETS = 10_000
# Documents with fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
# Pieces that are split at a time.
_PIECES = 1 << 18
_SPACE = zlib.crc32(b" ")


class WordSplitter:
    """The features of texts, as buckets of their checksums."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self._split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str

    def _words(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """The words of all pieces, and how many each piece has."""
        words: list[str] = []
        counts = [np.zeros(0, np.int64)]
        for start in range(0, len(pieces), _PIECES):
            part = pieces.slice(start, _PIECES)
            # One text of many pieces; a word belongs to the piece that its offset falls in.
            ends = np.cumsum(pc.utf8_length(part).to_numpy().astype(np.int64) + 1)
            found = self._split("\n".join(plain_strings(part)))
            words += [word for word, _ in found]
            offsets = np.fromiter((offset for _, (offset, _) in found), np.int64, len(found))
            counts.append(np.bincount(np.searchsorted(ends, offsets, side="right"), minlength=len(part)))
        return words, np.concatenate(counts)

    def buckets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all features, text after text, and how many words each text has. A null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        pieces = split.flatten().dictionary_encode()
        words, counts = self._words(pc.ascii_lower(pieces.dictionary))
        known = pa.array(words, pa.large_string()).dictionary_encode()
        encoded = [word.encode() for word in plain_strings(known.dictionary)]
        own = np.fromiter(map(zlib.crc32, encoded), np.uint32, len(encoded))
        behind_space = np.fromiter((zlib.crc32(word, _SPACE) for word in encoded), np.uint32, len(encoded))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        # The words of all texts, as numbers of different words.
        which = known.indices.to_numpy(zero_copy_only=False)
        order = pieces.indices.to_numpy(zero_copy_only=False)
        sequence = gather(which, (np.cumsum(counts) - counts)[order], counts[order])
        ends = np.concatenate([[0], np.cumsum(counts[order])])
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        n_words = np.diff(bounds)

        # A window is a pair of offsets into the words joined by one space: where its first word starts and its last one
        # ends. It grows by what lies between its end and the next one.
        end = np.cumsum(sizes[sequence] + 1)
        last_word = np.repeat(bounds[1:], n_words)
        found = np.zeros((len(sequence), MOST_WORDS), np.uint16)
        inside = np.zeros((len(sequence), MOST_WORDS), bool)
        first, crc = np.arange(len(sequence)), own[sequence]
        for n in range(MOST_WORDS):
            if n:
                whole = first + n < last_word[first]
                first, crc = first[whole], crc[whole]
                crc = moved_over(crc, end[first + n] - end[first + n - 1]) ^ behind_space[sequence[first + n]]
            found[first, n] = crc % np.uint32(BUCKETS)
            inside[first, n] = True
        return found[inside], n_words


def n_features(n_words: np.ndarray) -> np.ndarray:
    """How many features so many words have."""
    return sum(np.maximum(n_words - n, 0) for n in range(MOST_WORDS))


def featured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row; buckets are two bytes each, little-endian, in order."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = WordSplitter()
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                buckets, words = splitter.buckets(texts)
                features = n_features(words)
                data = buckets.astype("<u2").tobytes()
                ends = 2 * np.cumsum(features)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)), pa.array(words), pa.array(features),
                        pa.array([data[a:b] for a, b in zip((ends - 2 * features).tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["doc_id", "n_words", "n_features", "buckets"],
                )
                del buckets, data
                give_back_memory()

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(split, "doc_id long, n_words long, n_features long, buckets binary"))


def bucket_counts(features: DataFrame) -> np.ndarray:
    """How many features of all rows are in each bucket. A task counts its own; the driver gets a number per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data in batch.column(0):
                found += np.bincount(np.frombuffer(data.as_buffer(), "<u2"), minlength=BUCKETS)
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found[seen])], ["bucket", "n"])

    summed = features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(BUCKETS, np.int64)
    for row in summed.collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def score_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``, against all texts of ``target``.

    A null text, of either, has no words, and its weight is 0. Rows that share an id share its random number and are
    scored each; a null id is hashed as no text. Without target texts all buckets count as equally likely there. An
    empty table gives no rows; other columns do not matter.
    """
    features = featured(docs, doc_id, text)
    gain = gains(bucket_counts(features), bucket_counts(featured(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "id")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.frombuffer(data.as_buffer(), "<u2")].sum()) for data in batch["buckets"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(weights, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    with small_batches(docs.sparkSession):
        weighed = materialize(features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long"))
    hashed = f"CAST(conv(substring(sha2(concat('{seed}:', coalesce(CAST(doc_id AS STRING), '')), 256), 1, 8), 16, 10) AS BIGINT)"
    return weighed.withColumn("score", F.expr(f"weight + CAST(floor(-1000 * ln(-ln(({hashed} + 0.5D) / 4294967296D))) AS BIGINT)"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` to rows of :func:`score_documents`: 1, 2, 3, ... for the ``percent`` of the documents with enough words
    that score highest, null for all others. Of equal scores the smaller id is first, a missing one last; what is still
    equal then is ranked by features and weight, and may be exchanged.

    Rows are sorted by ranges over all tasks, so equal scores, however many, spread; a rank is a place in a range and the
    number of rows in the ranges before, of which the driver gets one each.
    """
    scored = scored.select("doc_id", "n_words", "n_features", "weight", "score")
    long_enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = materialize(
        scored.filter(long_enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    )
    # Places number the rows of a range in their low 33 bits and the ranges in those above.
    sizes = sorted((r["range"], r["n"]) for r in placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for number, n in sizes:
        before.append((number, at))
        at += n
    starts = placed.sparkSession.createDataFrame(before, "range long, before long")
    ranked = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(starts), "range")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = ranked.withColumn("rank", F.when(rank <= at * percent // 100, rank)).select(*scored.columns, "rank")
    return drawn.union(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("bigint")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return draw(score_documents(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 byte by byte, with the table that its polynomial gives.
IMPORTANCE_SQL = f"""
WITH crc_table AS MATERIALIZED (
    SELECT list(list_reduce(range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS steps
    FROM range(256) t(n)
),
texts AS (
    SELECT 'd' AS side, row_number() OVER (ORDER BY doc_id) AS n, doc_id, text FROM documents
    UNION ALL SELECT 't', row_number() OVER (ORDER BY item_id), NULL, text FROM benchmark
),
words AS MATERIALIZED (
    SELECT side, n, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM texts
),
windows AS MATERIALIZED (
    SELECT side, n, array_to_string(w[i : i + k], ' ') AS feature
    FROM (SELECT side, n, w, unnest(range(1, len(w) + 1)) AS i FROM words), range({MOST_WORDS}) r(k) WHERE i + k <= len(w)
),
codes AS MATERIALIZED (
    SELECT feature, xor(list_reduce(
        list_transform(range(1, octet_length(encode(feature)) + 1), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i - 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
    FROM (SELECT DISTINCT feature FROM windows), crc_table
),
features AS MATERIALIZED (SELECT side, n, bucket FROM windows JOIN codes USING (feature)),
counts AS (
    SELECT bucket, CAST(count(*) FILTER (side = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 't') AS DOUBLE) AS t
    FROM features GROUP BY bucket
),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + {BUCKETS})
        / ((s + 1) * ((SELECT sum(t) FROM counts) + {BUCKETS})))) AS BIGINT) AS gain FROM counts
),
weighed AS (SELECT n, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY n),
scored AS (
    SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
               CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM words LEFT JOIN weighed USING (n) WHERE side = 'd'
),
ranked AS (
    SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n_words >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * eligible // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (n)
"""
