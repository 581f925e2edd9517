"""Nearest vectors by counting collisions.

Each of 64 random projections has a sorted array of all vectors by their projected value. A query looks at a window
around its own value in every array. A vector inside a window collides with the query there; one that collides in
enough projections is verified, by its exact distance. Windows grow by virtual rehashing: their width is that of a radius,
and a larger radius only adds what lies beside the window so far, on both sides. A search starts at a fraction of a bound
of the distance of the k-th nearest vector and ends as soon as the radius reaches that distance, which falls with every
nearer vector that is verified.

The arrays are cut into shards of a bounded number of vectors, neighbours together, and a shard is a row of a written
table. A shard whose least and largest values leave a query fewer windows than collisions are needed is passed over.
Queries are written to files in slices of bounded size; a task reads a slice and takes it through its shards one by one,
so that what it finds in one narrows the windows in the next. It passes on its best k per query.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.llm.files import NewFile, read_all
from vecweave.llm.frames import small_batches
from vecweave.llm.words import gather
from vecweave.sources.storage import materialize, new_path

PROJECTIONS = 64
# Half a window at radius 1. A vector at the distance of the radius collides in 83 of 100 projections.
HALF_WINDOW = 1.36
# Vectors that collide in at least so many projections are verified: one at the radius does with a chance of over 0.99.
COLLISIONS = 44
# From one radius to the next, and how many steps below the bound a search starts.
GROWTH, STEPS = 1.3, 3
# Places in a shard have two bytes.
SHARD_VECTORS = 4096
# A bounded sample: it gives neighbourhoods and first bounds of distances, nothing else. Every vector is in a shard.
SAMPLE_VECTORS, SAMPLE_BYTES = 2048, 8 << 20
# Queries that a task holds at a time.
SLICE_BYTES = 16 << 20
SEED = 3
_CELLS = 2_000_000
_NO_ID = np.iinfo(np.int64).max
_SLACK = 1 + 1e-9


def projections(size: int) -> np.ndarray:
    """Directions that vectors of a length are projected on, one a column."""
    return np.random.default_rng([SEED, size]).standard_normal((size, PROJECTIONS))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, pair by pair."""
    out = np.empty(len(x))
    step = max(1, _CELLS // max(1, x.shape[1]))
    for at in range(0, len(x), step):
        gap = x[at : at + step] - y[at : at + step]
        out[at : at + step] = np.sqrt((gap * gap).sum(axis=1))
    return out


class Shard:
    """The sorted arrays of some vectors, and the search in them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, values: np.ndarray, order: np.ndarray):
        self.ids, self.rows, self.vectors, self.values, self.order = ids, rows, vectors, values, order

    @staticmethod
    def sort(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values and places of vectors in the arrays (projection, place)."""
        values = (vectors @ projections(vectors.shape[1])).T.astype(np.float32)
        order = np.argsort(values, axis=1, kind="stable")
        return np.take_along_axis(values, order, axis=1), order.astype(np.uint16)

    @staticmethod
    def _edges(centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest value in the windows of queries. Values were rounded; windows are not smaller for it."""
        half = (HALF_WINDOW * radius * _SLACK)[:, None]
        low, high = (centre - half).astype(np.float32), (centre + half).astype(np.float32)
        return np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf))

    def _window(self, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of queries start and end in each array (query, projection)."""
        low, high = self._edges(centre, radius)
        start = np.stack([np.searchsorted(v, low[:, p], side="left") for p, v in enumerate(self.values)], axis=1)
        end = np.stack([np.searchsorted(v, high[:, p], side="right") for p, v in enumerate(self.values)], axis=1)
        return start, end

    def search(self, state: Found, asked: np.ndarray) -> None:
        """Bring the queries numbered ``asked`` through this shard, a few at a time."""
        low, high = self._edges(state.centre[asked], state.reach(asked))
        met = (high >= self.values[:, 0]) & (low <= self.values[:, -1])
        asked = asked[met.sum(axis=1) >= COLLISIONS]
        few = max(1, _CELLS // (PROJECTIONS * len(self.ids)))
        for at in range(0, len(asked), few):
            self._search_few(state, asked[at : at + few])

    def _search_few(self, state: Found, asked: np.ndarray) -> None:
        count = len(self.ids)
        collided = np.zeros(len(asked) * count, np.int16)
        verified = np.zeros(len(asked) * count, bool)
        flat = self.order.ravel()
        base = (np.arange(PROJECTIONS) * count)[None, :]
        radius = state.reach(asked)
        radius = np.where(np.isfinite(radius), radius / GROWTH**STEPS, radius)
        active = np.arange(len(asked))
        middle = np.stack([np.searchsorted(v, state.centre[asked, p].astype(np.float32)) for p, v in enumerate(self.values)], axis=1)
        start, end = middle.copy(), middle.copy()
        while len(active):
            # What is new beside the windows, to the left and to the right.
            low, high = self._window(state.centre[asked[active]], radius[active])
            low, high = np.minimum(low, start[active]), np.maximum(high, end[active])
            firsts = np.concatenate([base + low, base + end[active]], axis=1)
            lengths = np.concatenate([start[active] - low, high - end[active]], axis=1)
            new = gather(flat, firsts.ravel(), lengths.ravel()) + np.repeat(active * count, lengths.sum(axis=1))
            collided += np.bincount(new, minlength=len(collided)).astype(np.int16)
            start[active], end[active] = low, high
            crossed = np.flatnonzero((collided >= COLLISIONS) & ~verified)
            verified[crossed] = True
            query, place = asked[crossed // count], crossed % count
            state.add(query, self.ids[place], self.rows[place], _distances(state.vectors[query], self.vectors[place]))
            reach = state.reach(asked[active])
            going = radius[active] < reach
            active, reach = active[going], reach[going]
            radius[active] = np.minimum(radius[active] * GROWTH, reach)


class Found:
    """The best k vectors of each query so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int):
        self.rows, self.vectors, self.bound, self.k = rows, vectors, bound, k
        self.centre = vectors @ projections(vectors.shape[1])
        self.best = np.full((len(rows), k), np.inf)
        self.ids = np.full((len(rows), k), _NO_ID)
        self.found = np.full((len(rows), k), -1)

    def reach(self, asked: np.ndarray) -> np.ndarray:
        """No vector farther than this can be among the nearest k."""
        return np.minimum(self.bound[asked], self.best[asked, -1])

    def add(self, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, distance: np.ndarray) -> None:
        near = (distance <= self.best[query, -1]) & (rows != self.rows[query])
        query, ids, rows, distance = query[near], ids[near], rows[near], distance[near]
        if not len(query):
            return
        of = np.unique(query)
        held = np.repeat(of, self.k)
        query = np.concatenate([held, query])
        distance = np.concatenate([self.best[of].ravel(), distance])
        ids = np.concatenate([self.ids[of].ravel(), ids])
        rows = np.concatenate([self.found[of].ravel(), rows])
        order = np.lexsort((rows, ids, distance, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.k]
        self.best[of], self.ids[of], self.found[of] = (x[kept].reshape(len(of), self.k) for x in (distance, ids, rows))


def _index(vectors: DataFrame, sample: dict[int, np.ndarray]) -> DataFrame:
    """A row per shard: size, n, and as bytes ids, rows, vectors, and values and order of the sorted arrays."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int64)
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                if size in sample:
                    of = np.flatnonzero(sizes == size)
                    points = sample[size]
                    rows = _rows(batch["vector"].take(pa.array(of)), size)
                    step = max(1, _CELLS // len(points))
                    for at in range(0, len(of), step):
                        part = rows[at : at + step]
                        cells[of[at : at + step]] = ((points * points).sum(axis=1) - 2 * part @ points.T).argmin(axis=1)
            yield batch.append_column("cell", pa.array(cells))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = count = 0

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = _rows(table["vector"].chunk(0), size)
            values, order = Shard.sort(vectors)
            ids = np.where(table["vec_id"].is_null().to_numpy(), _NO_ID, table["vec_id"].fill_null(0).to_numpy())
            data = [ids.astype("<i8"), table["row"].to_numpy().astype("<i8"), vectors.astype("<f8"), values.astype("<f4"), order.astype("<u2")]
            return pa.RecordBatch.from_arrays([pa.array([size]), pa.array([len(ids)]), *(pa.array([d.tobytes()], pa.binary()) for d in data)], _SHARD_NAMES)

        for batch in batches:
            sizes = batch["size"].to_numpy()
            at = 0
            while at < batch.num_rows:
                if held and (count == SHARD_VECTORS or sizes[at] != size):
                    yield shard()
                    held, count = [], 0
                size = int(sizes[at])
                alike = int(np.argmax(sizes[at:] != size)) if (sizes[at:] != size).any() else batch.num_rows - at
                take = min(alike, SHARD_VECTORS - count)
                held.append(batch.slice(at, take))
                at, count = at + take, count + take
        if held:
            yield shard()

    placed = materialize(vectors.mapInArrow(place, "row long, vec_id long, size int, vector array<double>, cell long"))
    # A crowded neighbourhood is cut into ranges by a hash, so it spreads over tasks.
    order = ["size", "cell", F.xxhash64("row")]
    return materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(build, _SHARD))


_SHARD_NAMES = ["size", "n", "ids", "rows", "vectors", "values", "order"]
_SHARD = "size long, n long, " + ", ".join(f"{name} binary" for name in _SHARD_NAMES[2:])


def _bounds(vectors: np.ndarray, rows: np.ndarray, points: np.ndarray | None, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest distance of each vector to those of the sample, itself left out: the nearest k are not farther."""
    out = np.full(len(vectors), np.inf)
    if points is None or len(points) < k + 1:
        return out
    step = max(1, _CELLS // len(points))
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        squares = (part * part).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * part @ points.T
        squares[rows[at : at + step, None] == own] = np.inf
        # What the products may be off by is added.
        scale = (part * part).sum(axis=1) + (points * points).sum(axis=1).max()
        out[at : at + step] = np.sqrt(np.maximum(np.partition(squares, k - 1, axis=1)[:, k - 1], 0) + 1e-12 * scale)
    return out


def _write_queries(queries: DataFrame, sample: dict[int, np.ndarray], sample_rows: dict[int, np.ndarray], k: int) -> list[tuple[str, int, int]]:
    """Write queries with the bounds of their distances to files; (path, size, bytes) of each."""
    folder = new_path(queries.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out: list[tuple[str, int, int]] = []
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                step = max(1, SLICE_BYTES // (8 * size + 64))
                for at in range(0, len(of), step):
                    some = batch.take(pa.array(of[at : at + step]))
                    vectors, rows = _rows(some["vector"], size), some["row"].to_numpy()
                    bound = _bounds(vectors, rows, sample.get(size), sample_rows.get(size), k)
                    data = io.BytesIO()
                    np.savez(data, rows=rows, ids=some["vec_id"].to_numpy(), vectors=vectors, bound=bound)
                    file = NewFile(f"{folder}/{task}-{uuid.uuid4()}.npz")
                    file.write(data.getvalue())
                    file.close()
                    out.append((file.uri, size, some.nbytes))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _, _ in out], "size": [s for _, s, _ in out], "bytes": [b for _, _, b in out]}, schema)

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("bytes", pa.int64())])
    written = materialize(queries.mapInArrow(write, "path string, size long, bytes long"))
    return [tuple(row) for row in written.orderBy("size", "path").collect()]


def _slices(files: list[tuple[str, int, int]]) -> list[tuple[int, list[str]]]:
    """Files of one length of vectors, put together up to the bytes that a task may hold."""
    out: list[tuple[int, list[str]]] = []
    held = 0
    for path, size, bytes_ in files:
        if out and out[-1][0] == size and held + bytes_ <= SLICE_BYTES:
            out[-1][1].append(path)
            held += bytes_
        else:
            out.append((size, [path]))
            held = bytes_
    return out


def _searched(index: DataFrame, size: int, paths: list[str], k: int) -> DataFrame:
    """The best k that each task finds for the queries of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = ids = None
        for batch in batches:
            for row in range(batch.num_rows):
                if state is None:
                    parts = [np.load(io.BytesIO(read_all(path))) for path in paths]
                    ids, rows, vectors, bound = (np.concatenate([part[name] for part in parts]) for name in ("ids", "rows", "vectors", "bound"))
                    state = Found(rows, vectors, bound, k)
                n = batch["n"][row].as_py()
                data = {name: np.frombuffer(batch[name][row].as_buffer(), kind) for name, kind in zip(_SHARD_NAMES[2:], ("<i8", "<i8", "<f8", "<f4", "<u2"))}
                shard = Shard(
                    data["ids"], data["rows"], data["vectors"].reshape(n, size), data["values"].reshape(PROJECTIONS, n), data["order"].reshape(PROJECTIONS, n)
                )
                shard.search(state, np.arange(len(ids)))
        if state is not None:
            query, place = np.nonzero(state.found >= 0)
            none = state.ids[query, place] == _NO_ID
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(state.rows[query]), pa.array(ids[query]),
                    pa.array(state.ids[query, place], mask=none), pa.array(state.found[query, place]), pa.array(state.best[query, place]),
                ],
                ["query_row", "query_id", "vec_id", "vec_row", "score"],
            )

    shards = index.filter(F.col("size") == size).select(*_SHARD_NAMES)
    return shards.mapInArrow(run, "query_row long, query_id long, vec_id long, vec_row long, score double")


def nearest_vectors(table: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``is_query`` holds for, the row
    itself left out; the score is the Euclidean distance in double precision. Ties go to the smaller id, a missing id
    counting as the largest, and then to any.

    Vectors that are null, empty or zero, or hold a null or a number that is not finite, take no part. Vectors are compared
    with those of their own length. With fewer than ``k`` others all are found. Rows that share an id are rows of their
    own, as queries, too. An empty table, or one without queries, gives no rows; other columns do not matter. A row whose
    ``is_query`` is null is none. Recall is that of the method: a vector within the distance of the k-th nearest collides
    often enough with a chance of over 0.99.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    fine = "coalesce(forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')), false) AND exists(vector, x -> x != 0)"
    given = materialize(
        table.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
            F.col(f"`{vector}`").cast("array<double>").alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ).filter(fine).select("row", "vec_id", F.size("vector").alias("size"), "vector", "asks")
    )
    vectors = given.select("row", "vec_id", "size", "vector")
    longest = given.agg(F.max("size")).first()[0]
    if longest is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = max(k + 1, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * longest)))
    chosen = vectors.orderBy(F.xxhash64("row", F.lit(SEED))).limit(count).collect()
    sample, sample_rows = {}, {}
    for size in {row["size"] for row in chosen}:
        alike = [row for row in chosen if row["size"] == size]
        points = np.array([row["vector"] for row in alike], np.float64)
        # Near ones follow each other, roughly, so that a shard of several neighbourhoods is narrow, too.
        order = np.argsort(points @ projections(size)[:, 0], kind="stable")
        sample[size], sample_rows[size] = points[order], np.array([row["row"] for row in alike])[order]
    index = _index(vectors, sample)
    files = _write_queries(given.filter("asks").select("row", "vec_id", "size", "vector"), sample, sample_rows, k)
    # A shard has some megabytes.
    with small_batches(table.sparkSession):
        found = [materialize(_searched(index, size, paths, k)) for size, paths in _slices(files)]
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", F.asc_nulls_last("vec_id"), "vec_row")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
