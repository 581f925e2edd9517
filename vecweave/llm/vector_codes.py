"""Compression of vectors to a byte per part.

Components are integers, floor(256 x), and a vector is cut into 16 equal parts. Each position of a part has a codebook of
64 entries, which two rounds of assignment and averaging improve. The nearest entry of a part is found as LAESA does it:
the distances of every part to a few fixed pivots are computed once and kept with the vectors. In a round, the distances
of the entries to the pivots are computed; the difference of the two to the same pivot is a lower bound of the distance
between part and entry. Entries are evaluated exactly, in integers, in the order of their bounds, until the next bound
exceeds the best distance found. Pivots never change, codebooks do.

Tasks add up their own parts by entry; only sums and counts by entry are shuffled, and the driver gets one codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.frames import ROWS_PER_SPLIT, split_join
from vecweave.sources.storage import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
PIVOTS = 4
# Parts assigned at a time.
_CELLS = 1 << 15
# Components beyond this have squares whose sums leave 64 bits.
_MOST = 1 << 27
# Distances to pivots are kept in single precision; bounds leave room for that.
_SLACK = 1e-5


def _integers(column: pa.Array, size: int) -> np.ndarray:
    """Components as integers, rows of (part, place in the part); short vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(values) and np.abs(values).max() > _MOST:
        raise ValueError(f"components of vectors must be below {_MOST // SCALE}")
    out = np.zeros((len(column), size), np.int32)
    out[np.arange(size) < lengths[:, None]] = values.astype(np.int32)
    return out


def _distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of every part (n, place) to every point (k, place)."""
    gaps = parts[:, None, :].astype(np.float64) - points
    return np.sqrt((gaps * gaps).sum(axis=2))


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Pivots of each part (part, pivot, place): the first entry, and then always the one farthest from those chosen."""
    chosen = []
    for points in entries:
        at = [0]
        gaps = _distances(points, points[:1])[:, 0]
        for _ in range(count - 1):
            at.append(int(gaps.argmax()))
            gaps = np.minimum(gaps, _distances(points, points[at[-1:]])[:, 0])
        chosen.append(points[at])
    return np.stack(chosen)


def nearest_entries(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (n, place), the first of equal ones, its squared distance, and how many distances
    were evaluated. ``to_pivots`` has the distances of the parts to the pivots."""
    code, best = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    of_entries = _distances(entries, pivots)
    entries = entries.astype(np.int64)
    evaluated = 0
    for first in range(0, len(parts), _CELLS):
        part = slice(first, first + _CELLS)
        own, known = parts[part].astype(np.int64), to_pivots[part].astype(np.float64)
        bound = np.zeros((len(own), len(entries)))
        for pivot in range(pivots.shape[0]):
            gap = np.abs(known[:, pivot, None] - of_entries[None, :, pivot])
            np.maximum(bound, gap - _SLACK * (known[:, pivot, None] + 1), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        least = np.take_along_axis(bound, order, axis=1)
        least *= least
        found, at = best[part], code[part]
        open_ = np.arange(len(own))
        for step in range(len(entries)):
            # A bound that equals the best distance may hide an equal one, of a smaller number.
            open_ = open_[least[open_, step] * (1 - 1e-9) <= found[open_]]
            if not len(open_):
                break
            entry = order[open_, step]
            gap = own[open_] - entries[entry]
            exact = np.einsum("ij,ij->i", gap, gap)
            evaluated += len(open_)
            better = (exact < found[open_]) | ((exact == found[open_]) & (entry < at[open_]))
            found[open_[better]], at[open_[better]] = exact[better], entry[better]
    return code, best, evaluated


class Codebooks:
    """Entries of all parts (part, entry, place), the fixed pivots, and the assignment of vectors to entries."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots

    def to_pivots(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of parts to pivots (vector, part, pivot), in single precision."""
        cut = vectors.reshape(len(vectors), PARTS, -1)
        return np.stack([_distances(cut[:, p], self.pivots[p]) for p in range(PARTS)], axis=1).astype(np.float32)

    def assign(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances (vector, part)."""
        cut = vectors.reshape(len(vectors), PARTS, -1)
        found = [nearest_entries(cut[:, p], to_pivots[:, p], self.entries[p], self.pivots[p])[:2] for p in range(PARTS)]
        return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _cut(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers and distances to pivots of a batch of the written table."""
    ints = np.frombuffer(b"".join(batch["ints"].to_pylist()), "<i4").reshape(batch.num_rows, size)
    gaps = np.frombuffer(b"".join(batch["to_pivots"].to_pylist()), "<f4").reshape(batch.num_rows, PARTS, PIVOTS)
    return ints, gaps


def _improved(vectors: DataFrame, books: Codebooks, size: int) -> Codebooks:
    """Each entry replaced by the mean of the parts assigned to it, rounded down; unused ones stay."""
    width = size // PARTS

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS * ENTRIES, width), np.int64)
        counts = np.zeros(PARTS * ENTRIES, np.int64)
        for batch in batches:
            ints, gaps = _cut(batch, size)
            cell = (books.assign(ints, gaps)[0] + np.arange(PARTS) * ENTRIES).ravel()
            counts += np.bincount(cell, minlength=len(counts))
            np.add.at(sums, cell, ints.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": used, "n": counts[used], "sums": list(sums[used])}, schema)

    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    partial = vectors.select("ints", "to_pivots").mapInArrow(add_up, "cell long, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    entries = books.entries.copy()
    for row in partial.groupBy("cell").agg(F.sum("n").alias("n"), *added).collect():
        part, entry = divmod(row["cell"], ENTRIES)
        entries[part, entry] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return Codebooks(entries, books.pivots)


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, code, error, label_error) of every vector that can be compressed, and the codebooks.

    Vectors that are null or hold a null or a number that is not finite are dropped. Vectors of unlike lengths share
    codebooks: shorter ones, and those whose length 16 does not divide, are filled up with zeros. Codebooks begin with
    the vectors of the smallest ids, a missing id last, of equal ids the smaller vector first; with fewer vectors they
    are shorter. Rows that share an id are compressed each. A table without vectors gives no rows and no codebooks. A
    component of half a million or more is an error, as sums of squares would leave 64 bits. Other columns do not matter.
    """
    rows = table.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.to_json(F.struct(F.col(f"`{label}`").alias("label"))).alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).filter("coalesce(forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')), false)")
    nothing = "vec_id long, code string, error long, label_error long"
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return table.sparkSession.createDataFrame([], nothing), None
    size = max(PARTS, -(-longest // PARTS) * PARTS)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").toArrow()
    start = _integers(first["vector"].combine_chunks(), size)
    entries = start.reshape(len(start), PARTS, -1).transpose(1, 0, 2).astype(np.int64)
    books = Codebooks(entries, choose_pivots(entries))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _integers(batch["vector"], size)
            gaps = books.to_pivots(ints)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"], batch["label"],
                    pa.array([row.tobytes() for row in ints.astype("<i4")], pa.binary()),
                    pa.array([row.tobytes() for row in gaps.astype("<f4")], pa.binary()),
                ],
                ["vec_id", "label", "ints", "to_pivots"],
            )

    vectors = materialize(rows.mapInArrow(prepare, "vec_id long, label string, ints binary, to_pivots binary"))
    for _ in range(ROUNDS):
        books = _improved(vectors, books, size)
    final = books

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, gaps = final.assign(*_cut(batch, size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"], batch["label"],
                    pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string()),
                    pa.array(gaps.sum(axis=1)),
                ],
                ["vec_id", "label", "code", "error"],
            )

    coded = materialize(vectors.mapInArrow(encode, "vec_id long, label string, code string, error long"))
    # A label may hold a third of all rows: sums are added up within tasks, and the rows of a hot label meet its sum in
    # several tasks.
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    found = split_join(coded, by_label, "label", "rows", spread_by=F.xxhash64("vec_id", "code"), rows_per_split=ROWS_PER_SPLIT)
    return found.select("vec_id", "code", "error", "label_error"), final


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))


def _codes_sql() -> str:
    gap = "list_sum(list_transform(list_zip(t.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(number: int) -> str:
        return (
            f"near{number} AS MATERIALIZED (SELECT t.n, t.p, min({gap} * {ENTRIES} + b.e) AS best "
            f"FROM parts t JOIN book{number} b USING (p) GROUP BY t.n, t.p)"
        )

    def improved(number: int) -> str:
        return f"""{assigned(number)},
book{number + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.part, b.part) AS part
    FROM book{number} b LEFT JOIN (
        SELECT p, e, list(mean ORDER BY i) AS part FROM (
            SELECT t.p, a.best % {ENTRIES} AS e, u.i, CAST(floor(CAST(sum(t.part[u.i]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
            FROM near{number} a JOIN parts t USING (n, p), (SELECT unnest(range(1, len(part) + 1)) AS i FROM one) u
            GROUP BY ALL
        ) GROUP BY p, e
    ) m USING (p, e)
)"""

    rounds = ",\n".join(improved(number) for number in range(ROUNDS))
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
parts AS MATERIALIZED (
    SELECT n, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS part FROM kept, range({PARTS}) r(p)
),
one AS (SELECT part FROM parts LIMIT 1),
book0 AS MATERIALIZED (SELECT p, n - 1 AS e, part FROM parts WHERE n <= {ENTRIES}),
{rounds},
{assigned(ROUNDS)},
coded AS (
    SELECT n, string_agg(lower(printf('%02x', best % {ENTRIES})), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY n
),
digest AS (
    SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), digest
"""


CODES_SQL = _codes_sql()
