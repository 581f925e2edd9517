"""Text and time expressions; no Python workers involved."""

from __future__ import annotations

from vecweave.constants import MAX_INPUT_BYTES

_DAY_MICROS = 86_400_000_000


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> str:
    """A column name as SQL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def truncate_utf8(text: str, max_bytes: int = MAX_INPUT_BYTES) -> str:
    """Longest prefix of ``text`` that fits ``max_bytes`` UTF-8 bytes and ends on a character boundary."""
    if max_bytes < 0:
        raise ValueError("max_bytes must not be negative")
    raw = f"CAST({text} AS BINARY)"
    # A character has at most three continuation bytes, so the boundary is at most three bytes back.
    last = max(max_bytes - 3, 0)
    cases = " ".join(
        f"WHEN hex(substring({raw}, {end + 1}, 1)) NOT BETWEEN '80' AND 'BF' THEN {end}"
        for end in range(max_bytes, last, -1)
    )
    end = f"CASE {cases} ELSE {last} END" if cases else str(last)
    cut = f"CAST(substring({raw}, 1, {end}) AS STRING)"
    return f"CASE WHEN octet_length({text}) <= {max_bytes} THEN {text} ELSE {cut} END"


def truncate_all(texts: str, max_bytes: int = MAX_INPUT_BYTES) -> str:
    """``truncate_utf8`` for every element of an array."""
    return f"transform({texts}, text -> {truncate_utf8('text', max_bytes)})"


def tokens(text: str) -> str:
    """Lower-cased runs of letters and digits, as an array; the first and last may be empty."""
    return f"split(lower({text}), r'[^\\p{{L}}\\p{{N}}]+')"


def rfc3339(moment: str) -> str:
    """UTC text of a timestamp with six fraction digits, whatever the session time zone is."""
    micros = f"unix_micros({moment})"
    second = f"(pmod({micros}, {_DAY_MICROS}) div 1000000)"
    day = f"CAST(date_from_unix_date(CAST(floor({micros} / {_DAY_MICROS}) AS INT)) AS STRING)"
    return (
        f"format_string('%sT%02d:%02d:%02d.%06d+00:00', {day}, {second} div 3600, {second} div 60 % 60, "
        f"{second} % 60, pmod({micros}, 1000000))"
    )


def text_key(model: str, text: str, max_bytes: int = MAX_INPUT_BYTES) -> str:
    """Key under which the vector of a text is reused: same model and same text as the model sees it. The length of the
    model's name comes first, so no name can run into a text."""
    head = quoted(f"{len(model)}\n{model}\n")
    return f"sha2(concat({head}, {truncate_utf8(text, max_bytes)}), 256)"
