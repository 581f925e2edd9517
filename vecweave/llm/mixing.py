"""Mixing sources to target weights by Poisson replication.

Each source has a rate: how often its documents are to be repeated on average so that the source has its share of the
whole. A document's number of copies is a Poisson number with that mean, read off at a place between 0 and 1 that a hash
of its id gives. So copies depend on the document alone, are the same in every run, and add up to the shares. The copies
are then dealt out in an order given by another hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.frames import fresh_names, split_join
from vecweave.sources.storage import materialize

SEED = 17
EPOCHS = 1.0
POWER = 0.5
# The table of rates is sent to every task up to so many bytes; a larger one is joined by a shuffle.
MAX_BROADCAST_BYTES = 16 << 20
_PLACES = 1 << 52


def _place(*parts: str) -> str:
    """SQL of a number from 0 to 1 from a hash."""
    return f"CAST(conv(substring(md5(concat_ws('|', {', '.join(parts)})), 1, 13), 16, 10) AS BIGINT) / {float(_PLACES)!r}D"


def source_rates(
    docs: DataFrame,
    weights: DataFrame | None = None,
    source: str = "source",
    text: str = "text",
    epochs: float = EPOCHS,
    power: float = POWER,
) -> DataFrame:
    """(source, rows, rate) of each source, null being one.

    The size of a source is the code points of its texts and one more for each. ``weights`` has (source, weight), not
    negative; sources it leaves out get none. Without it, a source weighs its size to the ``power``. All copies together
    have ``epochs`` times the size of the input, on average.
    """
    sizes = materialize(
        docs.groupBy(F.col(f"`{source}`").alias("source")).agg(
            F.count("*").alias("rows"),
            F.sum(F.coalesce(F.char_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("double").alias("size"),
        )
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        given = weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("named")), "left").fillna(0.0, ["weight"])
    whole = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    rates = weighed.join(F.broadcast(whole)).select(  # one row
        "source",
        "rows",
        F.expr(f"CASE WHEN all_weight > 0 THEN weight / all_weight * all_size * {epochs!r}D / size ELSE 0D END").alias("rate"),
    )
    return materialize(rates)


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = SEED,
    epochs: float = EPOCHS,
    power: float = POWER,
    names: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with each row as often as its Poisson number says, in shuffled order.

    ``names`` adds columns for the number of the copy, from 0, and for the hash that orders the copies. Null ids and
    repeated ids are hashed like any other: rows that share one get equally many copies if they share a source. Null
    texts have size one. An empty table stays empty.
    """
    rates = source_rates(docs, weights, source, text, epochs, power)
    name, rows, rate, cdf, copies, copy, order = fresh_names(docs, 7)
    # Chances of at most k copies for all k that a double can tell from never and always, as shares of their sum: so
    # large rates have no number too small to be told from zero.
    least = "greatest(0L, CAST(floor(rate - 12 * sqrt(rate)) AS BIGINT) - 20L)"
    most = "CAST(ceil(rate + 12 * sqrt(rate)) AS BIGINT) + 20L"
    following = "state.chance * rate / k"
    table = (
        f"transform(array(aggregate(sequence({least} + 1L, {most}), named_struct('chance', 1D, 'all', array(1D)), "
        f"(state, k) -> named_struct('chance', {following}, 'all', array_append(state.all, element_at(state.all, -1) + {following})), "
        "state -> state.all)), sums -> transform(sums, sum -> sum / element_at(sums, -1)))[0]"
    )
    rates = rates.select(
        F.col("source").alias(name), F.col("rows").alias(rows), F.expr(least).alias(rate), F.expr(table).alias(cdf)
    )
    key = F.col(f"`{source}`")
    bytes_ = rates.agg(F.sum(F.expr(f"coalesce(octet_length(CAST({name} AS STRING)), 0) + 8 * size({cdf}) + 32"))).first()[0]
    if (bytes_ or 0) <= MAX_BROADCAST_BYTES:
        joined = docs.join(F.broadcast(rates.drop(rows)), key.eqNullSafe(F.col(name)), "left")
    else:
        # Null gets a name of its own for the shuffle.
        (none,) = fresh_names(docs)
        keyed = docs.withColumn(none, F.to_json(F.struct(key.alias("s"))))
        by_key = rates.withColumn(none, F.to_json(F.struct(F.col(name).alias("s")))).drop(name)
        joined = split_join(keyed, by_key, none, rows).drop(none)
    identity = f"coalesce(CAST(`{doc_id}` AS STRING), '')"
    chosen = joined.withColumn(copies, F.expr(f"{rate} + size(filter({cdf}, chance -> chance <= {_place(repr(str(seed)), identity)}))"))
    copied = chosen.filter(F.col(copies) > 0).withColumn(
        copy, F.explode(F.expr(f"sequence(0L, CAST({copies} - 1 AS BIGINT))"))
    )
    ordered = copied.withColumn(
        order, F.expr(f"md5(concat_ws('|', 'order', '{seed}', {identity}, CAST({copy} AS STRING)))")
    )
    dealt = ordered.repartition(F.col(order)).sortWithinPartitions(order)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if names:
        columns += [F.col(copy).alias(names[0]), F.col(order).alias(names[1])]
    return dealt.select(*columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, names=("copy", "order_key"))


MIXING_SQL = f"""
WITH sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
),
rates AS (
    SELECT source, pow(size, {POWER}) / sum(pow(size, {POWER})) OVER () * sum(size) OVER () / size AS rate FROM sizes
),
chances AS (
    SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS chance
    FROM rates, range(0, 150) AS t(k)
),
placed AS (
    SELECT *, CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
              / {float(_PLACES)!r} AS place
    FROM documents
),
counted AS (
    SELECT p.doc_id, p.text, p.lang, p.source, p.n_chars,
           (SELECT count(*) FROM chances c WHERE c.source IS NOT DISTINCT FROM p.source AND c.chance <= p.place) AS copies
    FROM placed p
)
SELECT doc_id, text, lang, source, n_chars, copy,
       md5('order|{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy) AS order_key
FROM counted, unnest(range(0, copies)) AS t(copy)
"""
