"""Batch requests {texts, model, batch_size} and their responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.constants import DEFAULT_BATCH_SIZE
from vecweave.functions.text import column, quoted, truncate_all
from vecweave.operators.embedders import CallableEmbedder, Embedder, outcomes_by_name


def batch_plan(requests: DataFrame) -> DataFrame:
    """The model calls a request leads to: one row per batch with its number and size, order kept."""
    size = F.coalesce(F.col("batch_size"), F.lit(DEFAULT_BATCH_SIZE))
    total = F.size("texts")
    batches = F.ceil(total / F.when(size > 0, size))
    others = [column(c) for c in requests.columns if c not in ("texts", "batch_size")]
    return requests.select(
        *others,
        size.cast("bigint").alias("batch_size"),
        total.alias("_total"),
        F.explode(F.when(batches > 0, F.sequence(F.lit(0).cast("bigint"), batches - 1))).alias("batch_no"),
    ).select(
        *others,
        "batch_size",
        "batch_no",
        F.least(F.col("batch_size"), F.col("_total") - F.col("batch_no") * F.col("batch_size"))
        .cast("bigint")
        .alias("texts_in_batch"),
    )


def request_rows(requests: DataFrame) -> DataFrame:
    """One row per text with its position, for requests too large to be answered in one row: embed them with
    ``embed_rows`` and count them with :func:`request_totals`."""
    others = [column(c) for c in requests.columns if c not in ("texts", "batch_size")]
    return requests.selectExpr(*others, "posexplode(texts) AS (pos, text)")


def request_totals(rows: DataFrame, request: list[str]) -> DataFrame:
    """Vectors, failed texts and an error, if any, per request of embedded :func:`request_rows`."""
    return rows.groupBy(*request).agg(
        F.count("embedding").alias("total_texts"),
        F.count("error").alias("failed_texts"),
        F.max("error").alias("error"),
    )


def embed_requests(
    requests: DataFrame, embedders: Sequence[Embedder], strict: bool = False
) -> DataFrame:
    """Answer batch requests: one row each, vectors in the order of the texts.

    The first embedder serves requests without a model and, unless ``strict``, those naming an unknown one (the
    name is kept). One failed text fails its request: no vectors, and an ``error``. ``total_texts`` counts vectors;
    ``dimension`` is the declared one. A batch size below one is an error of the request.
    """
    default = embedders[0]
    names = [embedder.name for embedder in embedders]
    if len(set(names)) < len(names):
        raise ValueError("embedders must have different names")
    known = ", ".join(quoted(name) for name in names)
    fallback = "NULL" if strict else quoted(default.name)
    others = [column(c) for c in requests.columns if c not in ("texts", "model", "batch_size")]
    df = requests.selectExpr(
        *others,
        "coalesce(texts, CAST(array() AS ARRAY<STRING>)) AS _texts",
        f"coalesce(model, {quoted(default.name)}) AS model",
        f"coalesce(batch_size, {DEFAULT_BATCH_SIZE}) AS _size",
    ).selectExpr(
        "*",
        f"CASE WHEN _size > 0 THEN CASE WHEN model IN ({known}) THEN model ELSE {fallback} END END AS _serving",
    )
    # No row moves. Callables share one Python stage; other embedders see their own requests, the others as empty lists.
    answers, called = {}, [e for e in embedders if isinstance(e, CallableEmbedder)]
    for embedder in embedders:
        if embedder not in called:
            mine = truncate_all(f"filter(_texts, text -> _serving = {quoted(embedder.name)})", embedder.max_bytes)
            answers[f"_outcomes_{len(answers)}"] = embedder.outcomes(mine, "greatest(_size, 1)", "batch")
    if called:
        cut = " ".join(f"WHEN {quoted(e.name)} THEN {truncate_all('_texts', e.max_bytes)}" for e in called)
        answers[f"_outcomes_{len(answers)}"] = outcomes_by_name(
            called, f"CASE _serving {cut} ELSE CAST(array() AS ARRAY<STRING>) END", "greatest(_size, 1)", "_serving"
        )
    df = df.withColumns(answers)
    outcomes = ", ".join(answers)
    declared = " ".join(f"WHEN {quoted(e.name)} THEN {e.dimension}" for e in embedders)
    return (
        df.withColumn("_outcomes", F.expr(f"concat({outcomes})"))
        .withColumn(
            "error",
            F.expr(
                "CASE WHEN _size < 1 THEN 'batch_size must be at least 1' "
                "WHEN _serving IS NULL THEN 'model not found' "
                "ELSE get(filter(_outcomes.error, error -> error IS NOT NULL), 0) END"
            ),
        )
        .selectExpr(
            *others,
            "CASE WHEN error IS NULL THEN _outcomes.embedding END AS embeddings",
            "model",
            f"CASE WHEN error IS NULL THEN CAST(CASE _serving {declared} END AS BIGINT) END AS dimension",
            "CAST(aggregate(_outcomes.millis, 0D, (a, b) -> a + b) AS BIGINT) AS processing_time_ms",
            "CASE WHEN error IS NULL THEN CAST(size(_outcomes) AS BIGINT) END AS total_texts",
            "error",
        )
    )
