"""Exact search for the most similar vectors.

Scores are cosines as SQL has them: sums in the order of components, one root of the product of both squares, rounded to
nine places, halves away from zero. Ties go to the smaller id.

Neither side goes through the driver. Queries are written to files, and a task takes a slice of them of bounded size
through its own vectors, which stay where they are. If there are several slices, vectors are written to files, too, as
blocks, and the tasks of one job take slices through blocks: however many there are, the driver gets their names and what
Spark tells of some hundred tasks. Each task sorts its vectors by the pivot they are nearest to and by
their angle to it, and cuts them into blocks, which are rings around a pivot. A vector in a ring cannot be nearer to a query
than the difference of the query's angle to the pivot and those of the ring, so a query passes over every ring that this
puts behind the ``k`` best it has. Some vectors, chosen by a hash, come first and are compared with every query: so there
is a good bound from the start. Tasks pass on only their best ``k`` per query, never all pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.operators.embed import embed_rows, embedded
from vecweave.operators.embedders import Embedder
from vecweave.sources.files import NewFile, read_all
from vecweave.sources.storage import materialize, new_path

SCORE_DIGITS = 9
# Bytes of queries that a task holds at a time, with what their ids take.
QUERY_BYTES = 32 << 20
# Bytes of vectors in a block, as doubles, and how many blocks and groups of slices a core gets at most.
BLOCK_BYTES = 64 << 20
UNITS_PER_CORE = 16
# Vectors in a ring, pivots, and the share of vectors that come first: one of so many.
RING = 2048
PIVOTS = 32
FIRST_ONE_OF = 16
_SCORE_CELLS = 4_000_000
_SLACK = 1e-8
# What an angle that is found from a cosine may be off by.
_ANGLE_SLACK = 1e-7


def _rows(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles, scaled by powers of two: no square overflows, and a cosine is the same to its last
    bit."""
    count = len(vectors)
    lengths = np.unique(np.diff(vectors.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError("vectors of one search must have the same length")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(count, -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0))[1])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1
    return rows / norms


def _dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of products row by row, one component after the other."""
    return np.add.accumulate(left * right, axis=1)[:, -1]


def _rounded(scores: np.ndarray) -> np.ndarray:
    scaled = scores * 10.0**SCORE_DIGITS
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**SCORE_DIGITS


def usable_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector can be compared: not null, and every component a finite number."""
    finite = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return df.filter(f"{vector} IS NOT NULL AND {finite}")


def unusable_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The other rows: what a search leaves out."""
    finite = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return df.filter(f"NOT coalesce({vector} IS NOT NULL AND {finite}, false)")


@dataclass
class SearchReport:
    """How much a search has compared, once it has run: pairs of a query and a vector, and all that there are. Of tasks
    that were tried again, each attempt that succeeded counts."""

    compared: Accumulator
    pairs: Accumulator

    @classmethod
    def of(cls, spark: SparkSession) -> SearchReport:
        return cls(spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))

    @property
    def passed_over(self) -> float:
        """The share of all pairs that no one had to look at."""
        return 1 - self.compared.value / self.pairs.value if self.pairs.value else 0.0


def _order_of(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids."""
    return ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]


class _Best:
    """The best ``k`` vectors of each query so far."""

    def __init__(self, rows: np.ndarray, pivots: np.ndarray, k: int, zero_score: float):
        self.rows, self.queries, self.k = rows, _unit(rows), k
        # What is not a number stands before all numbers.
        self.zero_score = np.inf if np.isnan(zero_score) else zero_score
        self.zero = ~rows.any(axis=1)
        self.squares = _dot(rows, rows)
        self.angles = np.arccos(np.clip(self.queries @ pivots.T, -1, 1))
        self.scores = np.full((len(rows), k), -np.inf)
        self.ids = np.zeros((len(rows), k), object)

    def within_reach(self, cell: int, least: float, most: float) -> np.ndarray:
        """Queries to which a vector of the ring may be nearer than the last of their best."""
        if cell < 0:
            return np.arange(len(self.queries))
        angle = self.angles[:, cell]
        gap = np.maximum(np.maximum(angle - most, least - angle) - _ANGLE_SLACK, 0)
        # A zero vector has no angle to anything.
        return np.flatnonzero(self.zero | (np.cos(gap) >= self.scores[:, -1] - _SLACK))

    def compare(self, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        vectors, zero, squares = _unit(rows), ~rows.any(axis=1), _dot(rows, rows)
        step = max(1, _SCORE_CELLS // max(len(vectors), 1))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            scores = self.queries[some] @ vectors.T
            scores[:, zero] = scores[self.zero[some]] = self.zero_score
            floor = self.scores[some, -1]
            if len(ids) > self.k:
                floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            query, place = np.nonzero(scores >= floor[:, None] - _SLACK)
            query = some[query]
            # Scored again pair by pair: equal vectors then get equal scores wherever they stand in a block.
            exact = np.empty(len(query))
            pairs = max(1, _SCORE_CELLS // vectors.shape[1])
            for first in range(0, len(query), pairs):
                chosen = slice(first, first + pairs)
                one, other = query[chosen], place[chosen]
                lengths = np.sqrt(self.squares[one] * squares[other])
                cosine = np.clip(_dot(self.rows[one], rows[other]) / np.where(lengths > 0, lengths, 1), -1, 1)
                exact[chosen] = np.where(lengths > 0, _rounded(cosine), self.zero_score)
            self._add(query, ids[place], exact)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place in the order of ids, and score."""
        query, place = np.nonzero(self.scores > -np.inf)
        scores = self.scores[query, place]
        return query, place, np.where(scores < np.inf, scores, np.nan)

    def _add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        near = scores >= self.scores[query, -1]
        query, ids, scores = query[near], ids[near], scores[near]
        of = np.unique(query)
        if not len(of):
            return
        row, place = np.nonzero(self.scores[of] > -np.inf)
        query = np.concatenate([of[row], query])
        scores = np.concatenate([self.scores[of[row], place], scores])
        held = self.ids[of[row], place]
        ids = np.concatenate([held.astype(ids.dtype) if ids.dtype.kind in "iu" else held, ids])
        order = np.lexsort((_order_of(ids), -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.scores[query[kept], place[kept]] = scores[kept]
        self.ids[query[kept], place[kept]] = ids[kept]


def _write_queries(queries: DataFrame, most: int) -> list[list[str]]:
    """Write queries to files and put these into slices of about ``most`` bytes. The driver gets their names."""
    folder = new_path(queries.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get().partitionId(), []
        for batch in batches:
            step = max(1, int(batch.num_rows * most // max(1, 2 * batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)]).combine_chunks()
                file = NewFile(f"{folder}/{task}-{uuid.uuid4()}.arrow")
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_table(part)
                file.write(sink.getvalue())
                file.close()
                # Components are doubles in memory.
                out.append((file.uri, 2 * part.nbytes))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in out], "bytes": [b for _, b in out]}, pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    slices: list[list[str]] = []
    held = 0
    for path, bytes_ in materialize(queries.mapInArrow(write, "path string, bytes long")).orderBy("path").collect():
        if not slices or held + bytes_ > most:
            slices.append([])
            held = 0
        slices[-1].append(path)
        held += bytes_
    return slices


def _read_queries(paths: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a slice."""
    table = pa.concat_tables(pa.ipc.open_stream(read_all(path)).read_all() for path in paths).combine_chunks()
    return table.column(0).chunk(0), _rows(table.column(1).chunk(0))


def _pivots(path: str) -> np.ndarray:
    """Some of the queries of a file: rings around them tell near from far where it matters."""
    _, vectors = _read_queries([path])
    vectors = _unit(vectors[vectors.any(axis=1)])
    return vectors[np.unique(np.linspace(0, len(vectors) - 1, min(PIVOTS, len(vectors))).astype(int))]


def _rings(vectors: DataFrame, path: str) -> DataFrame:
    """Vectors in the order of rings, each task its own: vec_id, embedding, cell, angle. The cell -1 is that of vectors
    which are compared with every query."""
    id_type = vectors.schema[0].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots = _pivots(path) if pivots is None else pivots
            rows = _unit(_rows(batch["embedding"]))
            cell, angle = np.full(len(rows), -1, np.int32), np.zeros(len(rows))
            if len(pivots):
                near = rows @ pivots.T
                nearest = near.argmax(axis=1)
                rest = rows.any(axis=1) & ~batch["first"].to_numpy(zero_copy_only=False)
                cell[rest] = nearest[rest]
                angle[rest] = np.arccos(np.clip(near[np.arange(len(rows)), nearest], -1, 1))[rest]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(cell), pa.array(angle)], ["vec_id", "embedding", "cell", "angle"])

    first = (F.pmod(F.xxhash64("vec_id"), F.lit(FIRST_ONE_OF)) == 0).alias("first")
    type_ = vectors.schema["embedding"].dataType.simpleString()
    placed = vectors.select("vec_id", "embedding", first).mapInArrow(place, f"vec_id {id_type}, embedding {type_}, cell int, angle double")
    return placed.sortWithinPartitions("cell", "angle")


class _Scan:
    """The best ``k`` of vectors that come in the order of rings, for the queries of a slice."""

    def __init__(self, paths: list[str], pivots_of: str, k: int, zero_score: float, report: SearchReport | None):
        self.paths, self.pivots_of, self.k, self.zero_score, self.report = paths, pivots_of, k, zero_score, report
        self.best = None

    def ring(self, cell: int, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        angle = table["angle"].to_numpy()
        asked = self.best.within_reach(cell, angle.min(), angle.max())
        if self.report is not None:
            self.report.compared.add(len(asked) * len(angle))
            self.report.pairs.add(len(self.query_ids) * len(angle))
        if len(asked):
            self.best.compare(asked, _rows(table["embedding"].chunk(0)), table["vec_id"].to_numpy())

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, size = None, 0
        for batch in batches:
            cells = batch["cell"].to_numpy()
            start = 0
            while start < batch.num_rows:
                if self.best is None:
                    self.query_ids, queries = _read_queries(self.paths)
                    pivots, self.id_type = _pivots(self.pivots_of), batch["vec_id"].type
                    self.best = _Best(queries, pivots.reshape(-1, queries.shape[1]), self.k, self.zero_score)
                if held and (cells[start] != at or size == RING):
                    self.ring(at, held)
                    held, size = [], 0
                at = int(cells[start])
                other = cells[start:] != at
                take = min(int(other.argmax()) if other.any() else len(other), RING - size)
                held.append(batch.slice(start, take))
                start, size = start + take, size + take
        if held:
            self.ring(at, held)
        if self.best is not None:
            query, place, scores = self.best.found()
            yield pa.RecordBatch.from_arrays(
                [self.query_ids.take(pa.array(query)), pa.array(self.best.ids[query, place].tolist(), self.id_type), pa.array(scores)],
                ["query_id", "vec_id", "score"],
            )


def _write_blocks(rings: DataFrame) -> DataFrame:
    """Rings of each task in files of about ``BLOCK_BYTES``, in their order: a row with the name of each."""
    folder = new_path(rings.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            file = NewFile(f"{folder}/{uuid.uuid4()}.arrow")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for one in held:
                    writer.write_batch(one)
            file.write(sink.getvalue())
            file.close()
            return pa.RecordBatch.from_pydict({"block": [file.uri]})

        for batch in batches:
            step = max(1, int(batch.num_rows * BLOCK_BYTES // max(1, 2 * batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if held and size + 2 * part.nbytes > BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
                held.append(part)
                size += 2 * part.nbytes
        if held:
            yield block()

    return materialize(rings.mapInArrow(write, "block string"))


def _scan_blocks(blocks: DataFrame, slices: list[list[str]], pivots_of: str, k: int, zero_score: float, schema: str, report: SearchReport | None) -> DataFrame:
    """The best ``k`` in each block for the queries of every slice. A unit of work is a block and some of the slices; all
    of them are one job."""
    spark = blocks.sparkSession
    cores = spark.sparkContext.defaultParallelism
    count = max(1, blocks.count())
    most = UNITS_PER_CORE * cores
    groups = min(len(slices), -(-most // count))
    shared = spark.sparkContext.broadcast(slices)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, group in zip(*(column.to_pylist() for column in batch.columns)):
                block = pa.ipc.open_stream(read_all(path)).read_all().to_batches()
                for paths in shared.value[group::groups]:
                    yield from _Scan(paths, pivots_of, k, zero_score, report).run(block)

    units = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    return units.repartition(min(count * groups, most)).mapInArrow(scan, schema)


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES, report: SearchReport | None = None, zero_score: float = 0.0
) -> DataFrame:
    """The ``k`` vectors most similar to each query: query_id, vec_id, score, rank.

    ``queries`` has columns query_id, embedding; ``vectors`` has vec_id, embedding; ids are unique. Vectors and queries
    that are null or hold a null, NaN or infinity are left out, see :func:`unusable_vectors`. A zero vector has no cosine and scores ``zero_score`` with everything; as
    NaN, which it is in SQL, it stands before all others.

    Queries are taken in slices of about ``query_bytes``, and the vectors are scanned once for each slice, all in one
    job. ``report`` is told how much was compared.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    slices = _write_queries(usable_vectors(queries.select("query_id", "embedding")), query_bytes)
    vectors = usable_vectors(vectors.select("vec_id", "embedding"))
    id_types = [df.schema[0].dataType.simpleString() for df in (queries.select("query_id"), vectors)]
    schema = f"query_id {id_types[0]}, vec_id {id_types[1]}, score double"
    if not slices:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    pivots_of = slices[0][0]
    rings = _rings(vectors, pivots_of)
    if len(slices) > 1:
        found = materialize(_scan_blocks(_write_blocks(rings), slices, pivots_of, k, zero_score, schema, report))
    else:
        found = rings.mapInArrow(_Scan(slices[0], pivots_of, k, zero_score, report).run, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def text_search(
    texts: DataFrame,
    vectors: DataFrame,
    embedder: Embedder,
    k: int = 10,
    query_bytes: int = QUERY_BYTES,
    zero_score: float = 0.0,
) -> DataFrame:
    """Search by text: ``texts`` has query_id, text. If ``vectors`` has a model column, only the embedder's rows count.
    Each text is sent to the model once: the queries are written down before they are used."""
    if "model" in vectors.columns:
        vectors = vectors.filter(F.col("model") == embedder.name)
    asked = embedded(embed_rows(texts.select("query_id", "text"), embedder))
    return vector_topk(asked, vectors, k, query_bytes, zero_score=zero_score)
