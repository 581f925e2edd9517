"""Near-duplicate vectors by NN-descent.

A graph gives every vector a list of the nearest ones found so far. It begins with vectors that fall on the same side of
several random planes. A round then looks at each vector and all that have it in their lists or are in its own: these
meet each other, and whoever finds a nearer one puts it in its list. Rounds go on until lists settle and a bounded sample
of vectors, compared with all others, finds the links of its own in the graph.

Lists have a fixed length. A list full of what may be links is saturated: there may be more. Its component, the vectors
that links join, is then compared with all vectors, inside and outside: cells of the component with every vector that the
angle to the middle of the cell does not rule out. Only numbers and joins of components leave the cells. If audits keep
failing, all vectors are compared in this way. Vectors are compared in one byte a component on the way; links are
verified in double precision. Equal vectors are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.components import components, forest
from vecweave.llm.frames import split_join
from vecweave.sources.storage import materialize

THRESHOLD = 0.95
LIST = 12
TREES = 6
# Vectors that a leaf of a tree should hold, and the most that are compared with each other there.
LEAF = 96
LEAF_BLOCK = 384
# A leaf with more vectors is dealt over several tasks; at most (vectors x trees / this) leaves can be.
ROWS_PER_SPLIT = 50_000
MAX_ROUNDS = 6
SETTLED = 0.01
# The audit: so many vectors at most are compared with all.
AUDIT_VECTORS = 256
MIN_RECALL = 0.97
# After a failed audit descent goes on with new planes; so many audits at most.
MAX_AUDITS = 3
# What bytes and single precision may be off by.
SLACK = 0.02
COUNT_BLOCK = 1024
# Vectors that meet a cell in one task, and bytes of middles of cells that go to every task at a time.
VISITORS = 4096
MIDDLE_BYTES = 32 << 20
_ANGLE_SLACK = 1e-6
_SCORE_CELLS = 2_000_000
SEED = 5


def _floats(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one byte a component as rows of length about one."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.int8).reshape(len(column), size).astype(np.float32) / 127


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that share ``keys``, in blocks of at most ``most``. Rows of a key must come together."""
    held, at, size = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != at:
                yield at, pa.Table.from_batches(held)
                held, size = [], 0
            at = key
            while start < stop:
                take = min(stop - start, most - size)
                held.append(batch.slice(start, take))
                start, size = start + take, size + take
                if size == most:
                    yield at, pa.Table.from_batches(held)
                    held, size = [], 0
    if held:
        yield at, pa.Table.from_batches(held)


_LISTS = "id long, near array<long>, score array<float>"


def _list_batch(ids: np.ndarray, near: np.ndarray, score: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Rows of lists; ``found`` marks the entries (a row each) that count."""
    lengths = found.sum(axis=1)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids),
            pa.ListArray.from_arrays(offsets, pa.array(near[found])),
            pa.ListArray.from_arrays(offsets, pa.array(score[found].astype(np.float32))),
        ],
        ["id", "near", "score"],
    )


def _nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each row."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _first_lists(vectors: DataFrame, size: int, count: int, round_: int) -> DataFrame:
    """Lists from the leaves of random trees; another ``round_`` has other planes."""
    bits = max(0, min(40, int(np.ceil(np.log2(max(1, count / LEAF))))))
    planes = np.random.default_rng(SEED + round_).standard_normal((size, TREES * max(1, bits))).astype(np.float32)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (_bytes(batch["bytes"], size) @ planes > 0).reshape(-1, TREES, max(1, bits)).astype(np.int64)
            leaves = (sides << np.arange(max(1, bits))).sum(axis=2) if bits else np.zeros((len(sides), TREES), np.int64)
            for tree in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves[:, tree] * TREES + tree), batch["id"], batch["bytes"]], ["leaf", "id", "bytes"]
                )

    planted = vectors.select("id", "bytes").mapInArrow(plant, "leaf long, id long, bytes binary")
    large = (
        planted.groupBy("leaf").count().filter(F.col("count") > ROWS_PER_SPLIT)
        .select("leaf", F.ceil(F.col("count") / ROWS_PER_SPLIT).alias("splits"))
    )
    dealt = planted.join(F.broadcast(large), "leaf", "left").withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit(round_)), F.coalesce("splits", F.lit(1).cast("bigint")))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _runs(batches, ["leaf", "part"], LEAF_BLOCK):
            ids = block["id"].to_numpy()
            rows = _bytes(block["bytes"].combine_chunks(), size)
            scores = rows @ rows.T
            np.fill_diagonal(scores, -2)
            at = _nearest(scores, LIST // 2)
            score = np.take_along_axis(scores, at, axis=1)
            yield _list_batch(ids, ids[at], score, score > -2)

    mixed = F.xxhash64("id", F.lit(round_))
    return (
        dealt.select("leaf", "part", "id", "bytes")
        .repartition("leaf", "part")
        .sortWithinPartitions("leaf", "part", mixed)
        .mapInArrow(compare, _LISTS)
    )


def _merged(lists: DataFrame) -> DataFrame:
    """One list per vector: the best of all it has, nearest first."""
    entry = F.expr("transform(arrays_zip(near, score), x -> struct(-x.score AS far, x.near AS near))")
    # A vector has a list for each tree and each list it is in, of bounded length; the best are kept within tasks.
    best = (
        lists.select("id", F.explode(entry).alias("x"))
        .groupBy("id", F.col("x.near").alias("near"))
        .agg(F.min("x.far").alias("far"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("far", "near"))).alias("xs"))
    )
    return best.select(
        "id",
        F.expr(f"transform(slice(xs, 1, {LIST}), x -> x.near)").alias("near"),
        F.expr(f"transform(slice(xs, 1, {LIST}), x -> CAST(-x.far AS FLOAT))").alias("score"),
    )


def _round(vectors: DataFrame, lists: DataFrame, size: int, round_: int) -> DataFrame:
    """What vectors find in the lists of those they are listed with."""
    own = lists.select(F.col("id").alias("pivot"), F.explode("near").alias("id"))
    others = own.select(F.col("id").alias("pivot"), F.col("pivot").alias("id"))
    member = own.union(others).union(lists.select(F.col("id").alias("pivot"), "id")).distinct()
    known = vectors.select("id", "bytes").join(
        lists.select("id", F.expr(f"if(size(near) < {LIST}, CAST(-2 AS FLOAT), element_at(score, -1))").alias("worst")),
        "id",
        "left",
    )
    meeting = member.join(known, "id").select("pivot", "id", "bytes", "worst")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _runs(batches, ["pivot"], LEAF_BLOCK):
            if block.num_rows < 2:
                continue
            ids = block["id"].to_numpy()
            rows = _bytes(block["bytes"].combine_chunks(), size)
            scores = rows @ rows.T
            np.fill_diagonal(scores, -2)
            at = _nearest(scores, 4)
            score = np.take_along_axis(scores, at, axis=1)
            worst = block["worst"].combine_chunks().fill_null(-2).to_numpy(zero_copy_only=False)
            better = score > worst[:, None]
            some = better.any(axis=1)
            if some.any():
                yield _list_batch(ids[some], ids[at][some], score[some], better[some])

    mixed = F.xxhash64("id", F.lit(round_))
    return meeting.repartition("pivot").sortWithinPartitions("pivot", mixed).mapInArrow(meet, _LISTS)


def _gained(before: DataFrame, after: DataFrame) -> int:
    """Entries of the lists ``after`` that the same vectors' lists ``before`` do not have."""
    both = after.select("id", "near").join(before.select("id", F.col("near").alias("old")), "id", "left")
    new = F.size(F.array_except("near", F.coalesce("old", F.array().cast("array<bigint>"))))
    return both.agg(F.sum(new)).first()[0] or 0


def _settled(vectors: DataFrame, lists: DataFrame, size: int, count: int, first: int) -> DataFrame:
    """Lists after rounds of descent, numbered from ``first``: until few entries are new, or there were ``MAX_ROUNDS``."""
    for round_ in range(first + 1, first + MAX_ROUNDS + 1):
        merged = materialize(_merged(lists.union(_round(vectors, lists, size, round_))))
        gained = _gained(lists, merged)
        lists = merged
        if gained <= SETTLED * LIST * count:
            break
    return lists


def _scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (a, b) whose cosine in double precision reaches the threshold."""
    values = vectors.select("id", "vector")
    both = pairs.join(values.toDF("a", "x"), "a").join(values.toDF("b", "y"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = (_unit(_floats(batch["x"])) * _unit(_floats(batch["y"]))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(cosine >= THRESHOLD))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _pairs(lists: DataFrame) -> DataFrame:
    near = lists.select("id", F.explode(F.arrays_zip("near", "score")).alias("x")).filter(
        F.col("x.score") >= THRESHOLD - SLACK
    )
    return near.select(F.least("id", "x.near").alias("a"), F.greatest("id", "x.near").alias("b")).distinct()


def _saturated(lists: DataFrame, links: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, root) of the vectors whose list is full of what may be links, and of all that links join them with."""
    least = f"size(near) >= {LIST} AND element_at(score, -1) >= {THRESHOLD - SLACK}D"
    degree = links.select("a").union(links.select("b")).groupBy("a").count().filter(F.col("count") >= LIST)
    full = lists.filter(least).select("id").union(degree.select("a")).distinct()
    rooted = materialize(full.join(joined.toDF("id", "root"), "id", "left"))
    inside = joined.toDF("id", "root").join(rooted.select("root").distinct(), "root", "left_semi").select("id", "root")
    return inside.union(rooted.filter("root IS NULL").select("id", F.col("id").alias("root")))


def _audit(vectors: DataFrame, links: DataFrame, saturated: DataFrame) -> float:
    """The share of its links that a bounded sample finds in the graph, compared with all vectors.

    Links of saturated vectors do not count: all of theirs are found later.
    """
    loose = vectors.join(saturated.select("id"), "id", "left_anti")
    sample = loose.orderBy(F.xxhash64("id", F.lit(SEED))).limit(AUDIT_VECTORS).select("id", "vector").collect()
    if not sample:
        return 1.0
    ids = np.array([row["id"] for row in sample])
    rows = _unit(np.array([row["vector"] for row in sample], dtype=np.float64))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, rows))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        for batch in batches:
            scores = _unit(_floats(batch["vector"])) @ rows.T
            others = batch["id"].to_numpy()
            x, y = np.nonzero((scores >= THRESHOLD) & (others[:, None] != ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(others[x], ids[y])), pa.array(np.maximum(others[x], ids[y]))], ["a", "b"])

    true = loose.select("id", "vector").mapInArrow(compare, "a long, b long").distinct()
    found = (
        true.join(links.select("a", "b", F.lit(1).alias("linked")), ["a", "b"], "left")
        .agg(F.count("*").alias("all"), F.count("linked").alias("found"))
        .first()
    )
    return found["found"] / found["all"] if found["all"] else 1.0


def _cells(members: DataFrame) -> DataFrame:
    """(id, cell) of members (id, root): a cell has about ``COUNT_BLOCK`` members of a root at most."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / COUNT_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    return members.join(sizes, "root").select("id", F.xxhash64("root", block).alias("cell"))


def _all_cells(vectors: DataFrame, count: int) -> DataFrame:
    """(id, cell) of all vectors."""
    return vectors.select("id", F.pmod(F.xxhash64("id"), F.lit(-(-count // COUNT_BLOCK))).alias("cell"))


def _visits(known: DataFrame, size: int) -> DataFrame:
    """(id, cell) of every vector and every cell in which it may have a link."""

    def middle(table: pa.Table) -> pa.Table:
        rows = _unit(_floats(table["vector"].combine_chunks()))
        centre = _unit(rows.sum(axis=0, keepdims=True))
        widest = np.arccos(np.clip(rows @ centre[0], -1, 1)).max()
        return pa.table({"cell": table["cell"][:1], "middle": [centre[0].tolist()], "widest": [widest]})

    held = known.filter("cell IS NOT NULL").select("cell", "vector")
    cells = materialize(held.groupBy("cell").applyInArrow(middle, "cell long, middle array<double>, widest double"))
    parts = -(-cells.count() * (size * 8 + 16) // MIDDLE_BYTES)
    found = []
    for part in range(parts):
        some = cells.filter(F.pmod(F.xxhash64("cell"), F.lit(parts)) == part).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        limit = np.arccos(THRESHOLD) + some["widest"].to_numpy() + _ANGLE_SLACK
        # No angle is beyond half a turn.
        least = np.where(limit < np.pi, np.cos(np.minimum(limit, np.pi)), -2)
        shared = known.sparkSession.sparkContext.broadcast((some["cell"].to_numpy(), _floats(some["middle"].combine_chunks()), least))

        def visit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cells, middles, least = shared.value
            step = max(1, _SCORE_CELLS // len(cells))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    rows = batch.slice(start, step)
                    x, y = np.nonzero(_unit(_floats(rows["vector"])) @ middles.T >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(rows["id"].to_numpy()[x]), pa.array(cells[y])], ["id", "cell"])

        found.append(materialize(known.select("id", "vector").mapInArrow(visit, "id long, cell long")))
    return reduce(DataFrame.union, found)


def _compared(vectors: DataFrame, joined: DataFrame, dealt: DataFrame, size: int) -> DataFrame:
    """All links with an end in the cells of ``dealt`` (id, cell): rows (id, n) add up to the links of members, and to
    those that other vectors have with members; rows (a, b) are roots that links join."""
    known = materialize(
        vectors.select("id", "copies", "vector")
        .join(joined.toDF("id", "root"), "id", "left")
        .join(dealt, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    visits = materialize(_visits(known, size))
    # A cell with many visitors is dealt over several tasks.
    parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).alias("parts"))
    columns = ["id", "root", "copies", "vector"]
    coming = (
        visits.join(parts, "cell")
        .select("id", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        .join(known.select(*columns, F.col("cell").isNotNull().alias("inside")), "id")
        .select("cell", "part", *columns, "inside", F.lit(False).alias("owner"))
    )
    owners = known.join(parts, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), *columns,
        F.lit(True).alias("inside"), F.lit(True).alias("owner"),
    )

    def compare(table: pa.Table) -> pa.Table:
        owner = table["owner"].to_numpy()
        counted = ~table["inside"].to_numpy()[~owner]  # members are counted in their own cells
        ids, root, copies = (table[c].to_numpy() for c in ("id", "root", "copies"))
        rows = _unit(_floats(table["vector"].combine_chunks()))
        near = rows[~owner] @ rows[owner].T >= THRESHOLD
        near &= ids[~owner][:, None] != ids[owner]
        x, y = np.nonzero(near & (root[~owner][:, None] != root[owner]))
        a, b = forest(root[~owner][x], root[owner][y])
        n = np.concatenate([near.T @ copies[~owner], near[counted] @ copies[owner]])
        of = np.concatenate([ids[owner], ids[~owner][counted]])
        return pa.table(
            {
                "id": pa.array(of.tolist() + [None] * len(a), pa.int64()), "n": pa.array(n.tolist() + [0] * len(a), pa.int64()),
                "a": pa.array([None] * len(of) + a, pa.int64()), "b": pa.array([None] * len(of) + b, pa.int64()),
            }
        )

    return materialize(coming.union(owners).groupBy("cell", "part").applyInArrow(compare, "id long, n long, a long, b long"))


def similar_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) of every row: links have a cosine of at least 0.95 in double precision.

    Vectors that are null, empty or zero, or hold a null or a number that is not finite, link with nothing and are
    components of their own. Vectors of unlike lengths do not link; those of one length are compared among themselves, one
    length after another. Equal vectors link with each other and have the same links. Rows that share an id or lack one
    are rows of their own. An empty table gives no rows; other columns do not matter.
    """
    rows = table.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    fine = "coalesce(forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')), false) AND exists(vector, x -> x != 0)"
    lengths = rows.filter(fine).groupBy(F.size("vector").alias("size")).count().filter("count > 1").orderBy(F.desc("count"), "size").collect()
    compared = [row["size"] for row in lengths]
    usable = f"({fine}) AND size(vector) IN ({', '.join(map(str, compared)) or 'NULL'})"
    given = materialize(rows.withColumn("vector", F.expr(f"CASE WHEN {usable} THEN transform(vector, x -> x + 0.0D) END")))
    alone = given.filter("vector IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return reduce(DataFrame.union, [_linked(given.filter(F.size("vector") == size), size) for size in compared], alone)


def _linked(given: DataFrame, size: int) -> DataFrame:
    """(vec_id, n_links, component_id) of rows of a written table that have a vector of ``size`` numbers."""
    # Two hashes stand for a vector: equal ones meet by them.
    halves = ["xxhash64(vector) AS key_a", "xxhash64(reverse(vector)) AS key_b"]
    different = (
        given.selectExpr("vec_id", "vector", *halves)
        .groupBy("key_a", "key_b")
        .agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("id", F.monotonically_increasing_id())
    )

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _floats(batch["vector"])
            if not len(vectors):
                continue
            unit = _unit(vectors / np.abs(vectors).max(axis=1, keepdims=True))
            small = np.rint(unit * 127).astype(np.int8)
            offsets = pa.array(np.arange(0, unit.size + 1, size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in kept),
                    pa.ListArray.from_arrays(offsets, pa.array(unit.ravel())),
                    pa.array([row.tobytes() for row in small], pa.binary()),
                ],
                [*kept, "vector", "bytes"],
            )

    kept = ["id", "key_a", "key_b", "least", "copies"]
    vectors = materialize(
        different.select(*kept, "vector").mapInArrow(
            shorten, ", ".join(f"{c} long" for c in kept) + ", vector array<double>, bytes binary"
        )
    )
    count = vectors.count()
    lists = materialize(_merged(_first_lists(vectors, size, count, 0)))
    for audit in range(MAX_AUDITS):
        if audit:
            lists = materialize(_merged(lists.union(_first_lists(vectors, size, count, audit))))
        lists = _settled(vectors, lists, size, count, audit * MAX_ROUNDS)
        links = materialize(_scored(_pairs(lists), vectors))
        joined = materialize(components(links, "a", "b"))
        saturated = materialize(_saturated(lists, links, joined))
        if _audit(vectors, links, saturated) >= MIN_RECALL:
            whole = saturated.select("id")
            dealt = None if saturated.isEmpty() else _cells(saturated)
            break
    else:
        whole = vectors.select("id")
        dealt = _all_cells(vectors, count)

    copies = vectors.select("id", "copies")
    n_links = (
        links.select("a", "b").union(links.select("b", "a")).toDF("id", "other")
        .join(whole, "id", "left_anti")
        .join(whole.toDF("other"), "other", "left_anti")
        .join(copies.toDF("other", "other_copies"), "other")
        .select("id", F.col("other_copies").alias("n"))
    )
    if dealt is not None:
        compared = _compared(vectors, joined, dealt, size)
        n_links = n_links.union(compared.filter("id IS NOT NULL").select("id", "n"))
        edges = materialize(joined.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(compared.filter("a IS NOT NULL").select("a", "b")))
        joined = materialize(components(edges, "a", "b"))
    n_links = n_links.groupBy("id").agg(F.sum("n").alias("n"))
    rooted = materialize(
        vectors.select("id", "key_a", "key_b", "least", "copies")
        .join(joined.toDF("id", "root"), "id", "left")
        .join(n_links, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
        .withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    key = F.struct("key_a", "key_b").alias("key")
    named = rooted.join(smallest, "root").select(key, "copies", "n_links", "component_id")
    keyed = given.selectExpr("vec_id", *halves).select("vec_id", key)
    linked = split_join(keyed, named, "key", "copies", spread_by=F.xxhash64("vec_id"))
    return linked.select("vec_id", "n_links", "component_id")


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
