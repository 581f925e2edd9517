"""Quality rules: learned decision lists over statistics of texts.

Statistics are columns that Spark computes in one pass over the texts. A decision list is learned from labelled ones by
sequential covering: a rule is grown by the threshold that gains most, pruned on rows it was not grown on, kept if it is
precise there, and the rows it covers are set aside. Learning looks at counts by threshold only, which Spark adds up. The
list becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.frames import let
from vecweave.sources.storage import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
_SPACE = r"[\\x20\\x09-\\x0D]"

# Learning.
MAX_RULES = 8
MAX_CONDITIONS = 3
CUTS = 24
MIN_PRECISION = 0.9
MIN_COVERED = 3
GROW_SHARE = 2  # of three rows


def text_statistics(text: str) -> dict[str, str]:
    """SQL of the base statistics of a text column. A null text has no words, lines or characters."""
    whole = f"coalesce({text}, '')"
    words = f"filter(split({whole}, '{_SPACE}+'), word -> word != '')"
    lines = rf"filter(split({whole}, '\n', -1), line -> line RLIKE '[^\\x20\\x09-\\x0D]')"
    spaces = r"' \t\n\u000b\u000c\r'"
    return {
        "n_words": f"CAST(size({words}) AS BIGINT)",
        "word_chars": f"CAST(char_length(translate({whole}, {spaces}, '')) AS BIGINT)",
        "n_symbols": f"CAST(char_length({whole}) - char_length(translate({whole}, '{SYMBOLS}', '')) AS BIGINT)",
        "n_dup_lines": "CAST(" + let(lines, "lines", "size(lines) - size(array_distinct(lines))") + " AS BIGINT)",
        "n_repeat_words": "CAST(" + let(words, "words", _repeated("words")) + " AS BIGINT)",
        "n_distinct_words": f"CAST(size(array_distinct({words})) AS BIGINT)",
        "n_capitals": rf"CAST(char_length(regexp_replace({whole}, '[^A-Z]+', '')) AS BIGINT)",
        "n_digits": rf"CAST(char_length(regexp_replace({whole}, '[^0-9]+', '')) AS BIGINT)",
    }


def _repeated(words: str) -> str:
    """SQL of the number of words in windows that are found more than once.

    Windows are hashed and sorted with their places; equal neighbours are repeated. A window covers its words up to the
    next repeated one. Work is that of sorting, whatever a text repeats.
    """
    hashed = f"transform(slice({words}, 1, size({words}) - 2), (word, i) -> xxhash64(word, {words}[i + 1], {words}[i + 2]))"
    ordered = "array_sort(transform(hashes, (hash, i) -> struct(hash AS hash, i AS place)))"
    equal = (
        "filter(ordered, (one, k) -> (k > 0 AND ordered[k - 1].hash = one.hash) "
        "OR (k + 1 < size(ordered) AND ordered[k + 1].hash = one.hash))"
    )
    covered = (
        "aggregate(transform(places, (place, k) -> "
        f"if(k + 1 < size(places), least({WINDOW}, places[k + 1] - place), {WINDOW})), 0, (sum, n) -> sum + n)"
    )
    places = let(f"array_sort(transform({let(ordered, 'ordered', equal)}, one -> one.place))", "places", covered)
    some = let(hashed, "hashes", f"if(size(array_distinct(hashes)) = size(hashes), 0, {places})")
    return f"if(size({words}) < {WINDOW}, 0, {some})"


# Statistics that rules may look at, from the base ones.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    least: bool  # at least the cut, or below it
    cut: float

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.least else '<'} {self.cut!r}D"


Rule = tuple[Condition, ...]


def rule_sql(rule: Rule) -> str:
    return " AND ".join(f"({condition.sql()})" for condition in rule) or "true"


@dataclass(frozen=True)
class DecisionList:
    """The first rule that holds rejects a row; a row that none holds for is kept."""

    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        expression = F
        for rule in self.rules:
            expression = expression.when(F.expr(rule_sql(rule)), F.lit(False))
        return F.lit(True) if expression is F else expression.otherwise(F.lit(True))


def _cuts(labelled: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Cuts of each feature: quantiles of either class."""
    steps = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    aggregates = [F.percentile_approx(f, steps, 10_000).alias(f) for f in features]
    found: dict[str, set[float]] = {f: set() for f in features}
    for row in labelled.groupBy("bad").agg(*aggregates).collect():  # two rows
        for f in features:
            found[f] |= {v for v in row[f] or [] if v is not None}
    return {f: sorted(values) for f, values in found.items()}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(bad, good) rows of each feature between its cuts; Spark adds up, the driver gets a row per feature and cut."""
    places = [
        F.struct(
            F.lit(f).alias("feature"),
            F.expr("size(filter(array({}), cut -> {} >= cut))".format(", ".join(f"{c!r}D" for c in values), f)).alias("place"),
        )
        for f, values in cuts.items()
        if values
    ]
    summed = (
        rows.select("bad", F.explode(F.array(*places)).alias("at"))
        .groupBy("at.feature", "at.place")
        .agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.count("*").alias("all"))
        .collect()
    )
    table = {f: [(0, 0)] * (len(values) + 1) for f, values in cuts.items()}
    for row in summed:
        table[row["feature"]][row["place"]] = (row["bad"], row["all"] - row["bad"])
    return table


def _best_condition(table: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    """The condition with the largest information gain, and the (bad, good) rows it leaves."""
    best, gain = None, 0.0
    for feature, counts in table.items():
        bad, good = (sum(x) for x in zip(*counts))
        if not bad or not good:
            continue
        before = math.log2(bad / (bad + good))
        below = [0, 0]
        for cut, (b, g) in zip(cuts[feature], counts):
            below = [below[0] + b, below[1] + g]
            for least, (p, n) in ((False, below), (True, (bad - below[0], good - below[1]))):
                if p and (p, n) != (bad, good):
                    now = p * (math.log2(p / (p + n)) - before)
                    if now > gain:
                        best, gain = (Condition(feature, least, cut), p, n), now
    return best


def _pruned(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The beginning of ``rule`` that is best on ``rows``, and the (bad, good) rows it covers."""
    tried = [rule[: i + 1] for i in range(len(rule))]
    sums = [
        F.sum(F.expr(f"CAST({rule_sql(r)} AND {'bad' if b else 'NOT bad'} AS INT)")).alias(f"{i}_{b}")
        for i, r in enumerate(tried)
        for b in (0, 1)
    ]
    row = rows.agg(*sums).first()
    worth = []
    for i, r in enumerate(tried):
        p, n = row[f"{i}_1"] or 0, row[f"{i}_0"] or 0
        worth.append(((p - n) / (p + n) if p + n else -1, -i, r, p, n))
    return max(worth)[2:]


def learn_rules(
    labelled: DataFrame,
    features: list[str],
    max_rules: int = MAX_RULES,
    max_conditions: int = MAX_CONDITIONS,
    min_precision: float = MIN_PRECISION,
) -> DecisionList:
    """Learn to reject from rows with the ``features`` (double), ``bad`` (boolean) and ``fold`` (any number).

    All rows are learned from: two thirds by fold grow rules, the others prune and judge them. No rows, or rows of one
    class: an empty list, which keeps everything. Rows with null ``bad`` are left out; a null feature meets no condition.
    """
    rows = materialize(labelled.filter("bad IS NOT NULL").selectExpr(*features, "bad", f"pmod(fold, 3) < {GROW_SHARE} AS grow"))
    cuts = _cuts(rows, features)
    rules: list[Rule] = []
    if not any(cuts.values()):
        return DecisionList(())
    while len(rules) < max_rules:
        covered = " OR ".join(f"({rule_sql(r)})" for r in rules) or "false"
        rest = rows.filter(f"NOT coalesce({covered}, false)")
        grow, prune = rest.filter("grow"), rest.filter("NOT grow")
        rule: Rule = ()
        while len(rule) < max_conditions:
            found = _best_condition(_counts(grow.filter(rule_sql(rule)), cuts), cuts)
            if found is None:
                break
            rule, good = (*rule, found[0]), found[2]
            if not good:
                break
        if not rule:
            break
        rule, p, n = _pruned(rule, prune)
        if p < MIN_COVERED or p < min_precision * (p + n):
            break
        rules.append(rule)
    return DecisionList(tuple(rules))


def quality_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base statistics, ``base_failed`` and the features of every row: one pass over the texts, written."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = rows.selectExpr("doc_id", *[f"{sql} AS {name}" for name, sql in text_statistics("text").items()])
    failed = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed"
    return materialize(base).selectExpr("*", failed, *[f"{sql} AS {name}" for name, sql in FEATURES.items()])


def quality_rules(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality"
) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict ``kept`` of every row of ``docs``, with rules learned from ``labels`` (doc_id, 0 or 1).

    A null or empty text has no words and fails the base rules, as do short and repetitive ones; the learned rules judge
    the rest. Repeated rows are judged alike; labels of unknown, null or repeated ids count once for each row they meet.
    An empty table gives no rows. Other columns do not matter.
    """
    found = quality_statistics(docs, doc_id, text)
    marks = labels.select(F.col(f"`{doc_id}`").alias("label_id"), (F.col(f"`{quality}`") == 0).alias("bad"))
    labelled = found.filter("NOT base_failed").join(marks, F.col("doc_id") == F.col("label_id"))
    rules = learn_rules(labelled.withColumn("fold", F.xxhash64("doc_id")), list(FEATURES))
    return found.withColumn("kept", ~F.col("base_failed") & rules.verdict()), rules


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, _ = quality_rules(docs, labels)
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(*base, "base_failed", "kept")
