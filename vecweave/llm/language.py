"""Language identification by cross-parsing.

A language is a sample of labelled text, kept as its suffix automaton. A text is parsed from left to right into phrases:
each is the longest match that begins there with any place in the sample. The more a text is like the sample, the longer
its matches and the fewer its phrases; the language that needs the fewest per letter wins.

Many texts are parsed in step: they are laid out in rows, and one look-up in the table of the automaton moves all rows
on by a letter. A row goes on where the one before ended: rows are parsed as if a text began with them, and then again
from the true state, until both ways are in the same state; from there on they agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.llm.frames import fresh_names
from vecweave.llm.words import give_back_memory, slices

# Bounds of the sample that is learned from, per language: rows, and code points after which no further row is taken.
# Rows are taken whole. An automaton has at most twice as many states as its sample has letters.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 60_000
ROW, CHECK = 512, 64
SLICE_BYTES = 2 << 20
# A language with more letters has its edges sorted, which takes longer to look up than a table but has no empty places.
TABLE_LETTERS = 250
UNDECIDED = "und"
# The least remainder of a document's hash that is not learned from, and what it is a remainder of.
HELD_OUT, FOLDS = 2, 4


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The edges (from, symbol, to) of the automaton of all substrings of ``symbols``, and the number of states."""
    ways: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols:
        new = len(ways)
        ways.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in ways[at]:
            ways[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = ways[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(ways)
                ways.append(dict(ways[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and ways[at].get(symbol) == to:
                    ways[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    sizes = np.fromiter(map(len, ways), np.int64, len(ways))
    start = np.repeat(np.arange(len(ways), dtype=np.int32), sizes)
    symbol = np.fromiter((s for way in ways for s in way), np.int32, len(start))
    to = np.fromiter((t for way in ways for t in way.values()), np.int32, len(start))
    return start, symbol, to, len(ways)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of name, the letters of all samples, and an automaton each."""

    languages: tuple[str, ...]
    letters: str
    automata: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, int], ...]
    # Made when they are first needed.
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    # Symbols: 0 for what stands between words, then the letters, one for any other letter, one for no letter at all.
    @property
    def other(self) -> int:
        return len(self.letters) + 1

    @property
    def nothing(self) -> int:
        return len(self.letters) + 2

    @classmethod
    def of(cls, samples: dict[str, list[str]]) -> LanguageModel:
        """The model of samples of text by language."""
        texts = {name: " ".join(samples[name]).lower() for name in sorted(samples)}
        count: dict[str, int] = {}
        for text in texts.values():
            for letter in filter(str.isalpha, text):
                count[letter] = count.get(letter, 0) + 1
        letters = "".join(sorted(count, key=lambda c: (-count[c], c)))
        place = {letter: i + 1 for i, letter in enumerate(letters)}
        automata = []
        for text in texts.values():
            symbols = [place.get(c, -1) if c.isalpha() else 0 for c in text]
            symbols = [s for i, s in enumerate(symbols) if s >= 0 and (s or i and symbols[i - 1])]
            automata.append(suffix_automaton(symbols))
        return cls(tuple(texts), letters, tuple(automata))

    def _own(self, automaton) -> tuple[np.ndarray, int]:
        """Symbols of a language by those of all languages, and its symbol for no letter at all. The one before that
        is for letters that its sample lacks."""
        known = np.unique(automaton[1])
        known = known[known > 0]
        own = np.full(self.nothing + 1, len(known) + 1, np.int32)
        own[0] = 0
        own[known] = np.arange(1, len(known) + 1)
        own[self.nothing] = len(known) + 2
        return own, len(known) + 2

    def _table(self, automaton, own: np.ndarray, nothing: int) -> np.ndarray:
        """Moves by (state, symbol), as twice the place of the next state's row, plus one if a phrase ends. Where there
        is no way on, a new phrase begins with the symbol; a symbol that the sample lacks is a phrase by itself."""
        start, symbol, to, states = automaton
        width = nothing + 1
        alone = states * 2 * width  # the row after the automaton's: no way leads on
        table = np.full((states + 1, width), -1, np.int32)
        table[start, own[symbol]] = to * (2 * width)
        begin = np.where(table[0] < 0, alone, table[0])
        table = np.where(table < 0, begin + 1, table).astype(np.int32)
        table[0] = begin  # at the start of a text no phrase ends
        table[:, nothing] = 0
        return table.ravel()

    def _moves_by_table(self, automaton, own: np.ndarray, nothing: int):
        """The function from states and letters to the next states, and whether a phrase ends."""
        table = self._table(automaton, own, nothing)

        def move(state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = table[state + own[letters]]
            return found >> 1, found & 1

        return move

    def _moves_by_edges(self, automaton, own: np.ndarray, nothing: int):
        """The same, by looking for the edge among all of the automaton."""
        start, symbol, to, states = automaton
        width = nothing + 1
        keys = start.astype(np.int64) * width + own[symbol]
        order = np.argsort(keys)
        keys, to = keys[order], to[order]
        begin = np.full(width, states, np.int64)  # the state after the automaton's: no way leads on
        first = start == 0
        begin[own[symbol[first]]] = automaton[2][first]

        def move(state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            letter = own[letters]
            wanted = state.astype(np.int64) * width + letter
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            way = keys[place] == wanted
            none = letter == nothing
            ended = ~way & (state > 0) & ~none
            return np.where(none, 0, np.where(way, to[place], begin[letter])).astype(np.int32), ended

        return move

    def _moves(self, i: int):
        """How the automaton of a language moves."""
        if (i, TABLE_LETTERS) not in self._made:
            own, nothing = self._own(self.automata[i])
            moves = self._moves_by_table if nothing <= TABLE_LETTERS + 2 else self._moves_by_edges
            self._made[i, TABLE_LETTERS] = moves(self.automata[i], own, nothing)
        return self._made[i, TABLE_LETTERS]

    @staticmethod
    def _ends(move, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many phrases end in each row, and one more in the ``first`` row of a text; ``steps`` are the columns of
        the rows."""
        checks = len(steps) // CHECK
        states, counts = np.zeros((checks, len(first)), np.int32), np.zeros((checks, len(first)), np.int32)
        state, count = np.zeros(len(first), np.int32), first.astype(np.int32)
        for i, step in enumerate(steps):
            state, ended = move(state, step)
            count += ended
            if (i + 1) % CHECK == 0:
                states[i // CHECK], counts[i // CHECK] = state, count
        begun = np.zeros(len(first), np.int32)
        while True:
            true = np.where(first, 0, np.concatenate([[0], states[-1, :-1]]).astype(np.int32))
            todo = np.flatnonzero(true != begun)
            if not len(todo):
                return counts[-1]
            begun[todo] = true[todo]
            state, count = true[todo], np.zeros(len(todo), np.int32)
            for check in range(checks):
                for step in steps[check * CHECK : (check + 1) * CHECK]:
                    state, ended = move(state, step[todo])
                    count += ended
                other = state != states[check, todo]
                agreed = todo[~other]
                counts[check:, agreed] += count[~other] - counts[check, agreed]
                todo, state, count = todo[other], state[other], count[other]
                if not len(todo):
                    break
                states[check, todo], counts[check, todo] = state, count

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, with one 0 between words, how many each has, and how many of these are letters."""
        lower = [text.lower() for text in texts]
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(0x110000, np.int32)
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        place = {ord(letter): i + 1 for i, letter in enumerate(self.letters)}
        for point in np.flatnonzero(seen).tolist():
            if chr(point).isalpha():
                table[point] = place.get(point, self.other)
        symbols = table[points]
        ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))
        firsts = (ends - np.fromiter(map(len, lower), np.int64, len(lower)))
        keep = symbols > 0
        letters = np.concatenate([[0], np.cumsum(keep)])
        keep[1:] |= symbols[:-1] > 0
        inner = firsts[(firsts > 0) & (firsts < len(symbols))]
        keep[inner] = symbols[inner] > 0  # nothing is carried over from one text to the next
        kept = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], kept[ends] - kept[firsts], letters[ends] - letters[firsts]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of phrases (text by language), and letters of each text."""
        symbols, lengths, letters = self._symbols(texts)
        rows = -(-lengths // ROW)
        first_row = np.cumsum(rows) - rows
        laid = np.full((int(rows.sum()), ROW), self.nothing, np.uint16 if self.nothing < 1 << 16 else np.int32)
        begin = np.cumsum(lengths) - lengths
        laid.ravel()[np.repeat(first_row * ROW - begin, lengths) + np.arange(len(symbols))] = symbols
        steps = np.ascontiguousarray(laid.T)
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        owner = np.repeat(np.arange(len(texts)), rows)
        first = np.diff(owner, prepend=-1) > 0
        for i in range(len(self.automata)):
            found[:, i] = np.bincount(owner, self._ends(self._moves(i), steps, first), len(texts))
        return found, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1 for each text: by what share it needs fewer phrases than the next.
        Equally few: the language whose name comes first. A text without letters is undecided."""
        found, letters = self.phrases([text or "" for text in texts])
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        best = found.argmin(axis=1)
        ranked = np.sort(found, axis=1).astype(float)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if len(self.languages) > 1 else np.ones(len(texts))
        names = [self.languages[b] if n else UNDECIDED for b, n in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters > 0, score, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept for measuring. A null id is not, and is not learned from either."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % FOLDS == HELD_OUT


def learn_languages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> LanguageModel:
    """Learn every label of ``lang`` from whole documents: at most ``rows``, and no more once they have ``chars`` code
    points together.

    Documents are chosen by a hash of their id; one with more than ``chars`` code points comes after all others of its
    language. So a sample is longer than twice that only if a language has nothing but such documents. Null labels, null
    texts, null ids and held-out documents are not learned from. No labelled document: a model that leaves every text
    undecided.
    """
    labelled = docs.filter(
        F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}") & (held_out(doc_id) == F.lit(False))
    ).select(
        F.col(f"`{lang}`").alias("lang"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.lit("sample")).alias("number"),
        F.xxhash64(F.col(f"`{text}`")).alias("digest"),
        F.char_length(F.col(f"`{text}`")).cast("bigint").alias("size"),
        F.col(f"`{text}`").alias("text"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("size") > chars, "number", "digest")
    # Spark thins the rows of a language out in each task before they meet.
    ranked = labelled.drop("text").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = ranked.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < chars)
    key = ["lang", "number", "digest"]
    least = F.broadcast(chosen.groupBy(*key).agg(F.min("rank").alias("rank")))  # at most ``rows`` a language
    samples: dict[str, list[str]] = {}
    for row in labelled.join(least, key).dropDuplicates(key).select("lang", "rank", "text").collect():
        samples.setdefault(row["lang"], []).append((row["rank"], row["text"]))
    return LanguageModel.of({name: [part for _, part in sorted(parts)] for name, parts in samples.items()})


def language_of(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct<lang, score> of a column of texts."""
    # Plain values: what is broadcast must not need this package on the executors.
    shared = spark.sparkContext.broadcast((model.languages, model.letters, model.automata))

    @F.arrow_udf("struct<lang: string, score: double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LanguageModel(*shared.value)
        for texts in batches:
            names, scores = [], []
            for _, part in slices(texts, SLICE_BYTES):
                found, score = model.predict(part.to_pylist())
                names += found
                scores.append(score)
            give_back_memory()
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])
        # The worker lives on, the tables need not.
        del model
        give_back_memory()

    # Otherwise Spark runs it once for a filter on its result and again for the columns, in two workers of a task.
    return identify.asNondeterministic()(text)


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text has no language, which are null texts and texts without a letter, and with the
    predicted language in ``lang`` wherever that is null. Labels that are given stay. Repeated rows and other columns stay
    as they are; an empty table stays empty. Without a single label every row goes."""
    model = learn_languages(docs, doc_id, text, lang)
    (found,) = fresh_names(docs)
    decided = docs.withColumn(found, language_of(docs.sparkSession, model, F.col(f"`{text}`")))
    decided = decided.filter(F.col(f"{found}.lang") != UNDECIDED)
    return decided.withColumn(lang, F.coalesce(F.col(f"`{lang}`"), F.col(f"{found}.lang"))).drop(found)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_languages(docs)
    return docs.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        language_of(spark, model, F.col("text")).alias("found"),
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
