"""Strict decoding of JSON messages.

The text is parsed once, into a variant. Field types are read off the variant, because casting alone would accept
what the message format forbids (a number where text belongs, a negative or fractional count, a missing field).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.constants import DEFAULT_BATCH_SIZE, MAX_UINT32
from vecweave.functions.text import column, quoted

# The parser's own limit for one string is far lower; what remains is the largest size of a variant (128 MiB).
MAX_STRING_CHARS = 2_000_000_000
MAX_TEXT_BYTES = 134_000_000
# One half of an escaped surrogate pair without the other. Such a text has no UTF-8 form.
_LONE_SURROGATE = (
    r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})"
    r"|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"
)
# A counting field written as minus zero, which is no unsigned number.
_MINUS_ZERO = r'(?<!\\)"(?:retry_count|start_line|end_line)"\s*:\s*-0\s*[,}]'

# Fields and their rules: what the JSON value must be. A leading "?" lets it be absent or null.
_HEADERS = {
    "event_id": "text",
    "event_type": "text",
    "timestamp": "text",
    "source_service": "text",
    "correlation_id": "?text",
    "trace_id": "?text",
}
_METADATA = {
    "retry_count": "counter",
    "original_event_id": "?text",
    "user_id": "?text",
    "tenant_id": "?text",
}
_CHUNK = {
    "id": "text",
    "file_id": "text",
    "chunk_type": "text",
    "content": "text",
    "language": "?text",
    "start_line": "?uint32",
    "end_line": "?uint32",
    "confidence": "?number",
    "quality_score": "?number",
}
_TYPES = {"text": "string", "counter": "bigint", "uint32": "bigint", "number": "float"}


def _open(names) -> str:
    """Type of an object whose fields are still variants."""
    return "struct<" + ", ".join(f"{name}: variant" for name in names) + ">"


def _get(value: str, kind: str, path: str = "") -> str:
    return f"try_variant_get({value}, '${path}', '{kind}')"


def _kind(value: str) -> str:
    """Type name of a variant; 'ABSENT' if the field is not there, 'VOID' if it is a JSON null."""
    return f"coalesce(schema_of_variant({value}), 'ABSENT')"


def _obeys(value: str, rule: str) -> str:
    """Condition, never null."""
    kind, count = _kind(value), _get(value, "bigint")
    if rule.startswith("?"):
        return f"({kind} IN ('ABSENT', 'VOID') OR {_obeys(value, rule[1:])})"
    if rule == "text":
        return f"{kind} = 'STRING'"
    if rule == "uint32":
        return f"({kind} = 'BIGINT' AND coalesce({count} BETWEEN 0 AND {MAX_UINT32}, false))"
    if rule == "counter":
        return f"({kind} = 'ABSENT' OR {_obeys(value, 'uint32')})"
    finite = f"coalesce(abs({_get(value, 'double')}) < double('Infinity'), false)"
    return f"(({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL')) AND {finite})"


def _all_obey(struct: str, rules: dict[str, str]) -> str:
    fields = [_obeys(f"{struct}.{name}", rule) for name, rule in rules.items()]
    return " AND ".join([f"{struct} IS NOT NULL", *fields])


def _typed(struct: str, rules: dict[str, str]) -> str:
    fields = []
    for name, rule in rules.items():
        field = _get(f"{struct}.{name}", _TYPES[rule.lstrip("?")])
        fields.append(f"'{name}', " + (f"coalesce({field}, 0)" if rule == "counter" else field))
    return f"named_struct({', '.join(fields)})"


def _parsed(df: DataFrame, value: str, small_fields: list[str]) -> DataFrame:
    """Add ``_text``, ``_json``, ``_whole`` (exactly one JSON value was read) and ``_top``, the small fields as variants.
    Large fields are to be taken from ``_json`` directly, as every step in between copies them.

    The parser stops after the first value and ignores what follows. So the message is put into an array with a
    digest of itself behind it: the digest comes back as the second element only if nothing else was there.
    """
    return (
        df.withColumn("_text", F.expr(f"try_validate_utf8(CAST({value} AS STRING))"))
        .withColumn("_digest", F.expr("sha2(_text, 256)"))
        .withColumn(
            "_json",
            F.expr(
                f"CASE WHEN octet_length(_text) <= {MAX_TEXT_BYTES} THEN from_json(concat('[', _text, ',\"', _digest, "
                f"'\"]'), 'variant', map('maxStringLen', '{MAX_STRING_CHARS}')) END"
            ),
        )
        .withColumns(
            {
                "_whole": F.expr(f"coalesce({_get('_json', 'string', '[1]')} = _digest, false)"),
                "_top": F.expr(_get("_json", _open(small_fields), "[0]")),
            }
        )
    )


def _judged(
    df: DataFrame, value: str, keep: list[str], rules: list[tuple[str, str]], fields: dict[str, str]
) -> DataFrame:
    """One output row per message: kept columns, ``reject_reason``, fields. The generator keeps later filters on
    the reason above the parsing, which would otherwise be done once for the filter and again for the values."""
    rules = [
        (f"{value} IS NOT NULL", "empty payload"),
        ("_text IS NOT NULL", "not UTF-8"),
        (f"octet_length(_text) <= {MAX_TEXT_BYTES}", f"more than {MAX_TEXT_BYTES} bytes"),
        ("_whole", "not one JSON value"),
        ("_top IS NOT NULL", "not an object"),
        (f"NOT (contains(_text, r'\\u') AND _text RLIKE r'{_LONE_SURROGATE}')", "half of a surrogate pair"),
        (f"NOT (contains(_text, '-0') AND _text RLIKE r'{_MINUS_ZERO}')", "a count of minus zero"),
        *rules,
    ]
    cases = " ".join(f"WHEN NOT ({rule}) THEN {quoted(reason)}" for rule, reason in rules)
    df = df.withColumn("reject_reason", F.expr(f"CASE {cases} END"))
    values = "".join(
        f", CASE WHEN reject_reason IS NULL THEN {field} END AS {name}"
        for name, field in fields.items()
    )
    return df.selectExpr(*map(column, keep), f"inline(array(struct(reject_reason{values})))")


def decode_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Decode chunk events held as JSON text or bytes in ``value``.

    Keeps every input row and column and adds ``reject_reason`` and the event fields. A message that breaks a rule
    anywhere has a reason and no fields; see :func:`valid_events` and :func:`rejected_messages`.
    """
    opened = _parsed(df, value, ["metadata", "source_id", "repo_name", "timestamp"]).withColumns(
        {
            "_headers": F.expr(_get("_json", _open(_HEADERS), "[0].headers")),
            "_metadata": F.expr(_get("_json", _open(_METADATA), "[0].metadata")),
            "_chunks": F.expr(_get("_json", f"array<{_open(_CHUNK)}>", "[0].chunks")),
        }
    )
    rules = [
        (_all_obey("_headers", _HEADERS), "bad headers"),
        (
            f"{_kind('_top.metadata')} = 'ABSENT' OR ({_all_obey('_metadata', _METADATA)})",
            "bad metadata",
        ),
        (_obeys("_top.source_id", "text"), "bad source_id"),
        (_obeys("_top.repo_name", "?text"), "bad repo_name"),
        (
            f"_chunks IS NOT NULL AND forall(_chunks, chunk -> {_all_obey('chunk', _CHUNK)})",
            "bad chunks",
        ),
        (_obeys("_top.timestamp", "text"), "bad timestamp"),
    ]
    fields = {
        "headers": _typed("_headers", _HEADERS),
        "metadata": _typed("_metadata", _METADATA),
        "source_id": _get("_top.source_id", "string"),
        "repo_name": _get("_top.repo_name", "string"),
        "chunks": f"transform(_chunks, chunk -> {_typed('chunk', _CHUNK)})",
        "timestamp": _get("_top.timestamp", "string"),
    }
    return _judged(opened, value, df.columns, rules, fields)


def decode_requests(df: DataFrame, value: str = "value") -> DataFrame:
    """Decode batch requests {texts, model, batch_size?}; an absent batch size becomes the default."""
    opened = _parsed(df, value, ["model", "batch_size"]).withColumn(
        "_texts", F.expr(_get("_json", "array<variant>", "[0].texts"))
    )
    size, kind = _get("_top.batch_size", "bigint"), _kind("_top.batch_size")
    rules = [
        (f"_texts IS NOT NULL AND forall(_texts, text -> {_obeys('text', 'text')})", "bad texts"),
        (_obeys("_top.model", "text"), "bad model"),
        # The size is unsigned and as wide as the machine; here, whatever a bigint holds.
        (
            f"{kind} IN ('ABSENT', 'VOID') OR ({kind} = 'BIGINT' AND coalesce({size} >= 0, false))",
            "bad batch_size",
        ),
    ]
    fields = {
        "texts": f"transform(_texts, text -> {_get('text', 'string')})",
        "model": _get("_top.model", "string"),
        "batch_size": f"coalesce({size}, {DEFAULT_BATCH_SIZE})",
    }
    return _judged(opened, value, df.columns, rules, fields)


def valid_events(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_messages(decoded: DataFrame, value: str = "value") -> DataFrame:
    """Messages set aside, with the reason; ``value`` is null where the payload was."""
    return decoded.filter(F.col("reject_reason").isNotNull()).select(value, "reject_reason")
