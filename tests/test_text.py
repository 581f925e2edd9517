import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecweave.functions.headers import key_uuid
from vecweave.functions.text import quoted, rfc3339, tokens, truncate_utf8


def cut(spark, texts, limit=7500):
    df = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    rows = df.selectExpr("at", f"{truncate_utf8('text', limit)} AS cut").collect()
    return [row["cut"] for row in sorted(rows)]


def test_truncation_cases(spark):
    cases = [
        ("", 0),
        ("short", 5),
        ("a" * 7500, 7500),
        ("a" * 7499 + "é" + "b", 7499),
        ("a" * 7498 + "é" + "b", 7500),
        ("a" * 7498 + "€", 7498),
        ("a" * 7497 + "😀" + "z", 7497),
    ]
    got = cut(spark, [text for text, _ in cases])
    assert [len(text.encode()) for text in got] == [size for _, size in cases]
    assert all(text.startswith(short) for (text, _), short in zip(cases, got))
    assert cut(spark, [None]) == [None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=30), st.integers(0, 30))
def test_truncation_is_the_longest_prefix(spark, texts, limit):
    for text, short in zip(texts, cut(spark, texts, limit)):
        expected = text.encode()[:limit].decode(errors="ignore") if len(text.encode()) > limit else text
        assert short == expected


def test_truncation_rejects_negative_limit():
    with pytest.raises(ValueError):
        truncate_utf8("text", -1)


def test_time_text_does_not_depend_on_session_zone(spark):
    df = spark.range(1)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = df.selectExpr(
                rfc3339("timestamp'2024-11-03 05:30:00.000001Z'"), rfc3339("timestamp_micros(-500000)")
            ).first()
            assert tuple(row) == ("2024-11-03T05:30:00.000001+00:00", "1969-12-31T23:59:59.500000+00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_tokens_and_quoting(spark):
    row = spark.range(1).selectExpr(
        f"{tokens(quoted('Été, 12x--It\'s ½\\n'))} AS words", f"{key_uuid(quoted('k'))} AS id"
    ).first()
    assert row["words"] == ["été", "12x", "it", "s", "½", "n"]
    assert len(row["id"]) == 36 and row["id"][14] == "8"
