"""Encoding of many texts with a tokenizer that splits at white space.

Most words of a text are repeated. A batch of texts is cut into words by Arrow, every different word is encoded once,
and the ids of the texts are gathered from those of the words.
"""

from __future__ import annotations

import ctypes
import os
import sys
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

# Letters of Latin-1: normal form, lower case and letter class of these do not depend on their neighbours.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Marks of ASCII after them, whatever they are, are one unit.
_PLAIN = rf"^(?P<core>[{_LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]*)$"
# Texts are encoded in slices of about this many bytes.
SLICE_BYTES = 4 << 20
# Words kept with their ids as long as a Python worker lives (some 10 MB); later new words are encoded each time.
MAX_KEPT_WORDS = 400_000
# Words given to the tokenizer at a time: what it answers is much larger than the ids.
WORDS_AT_ONCE = 4096


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Slices of about ``limit`` bytes, of one text at least. A slice has 32-bit offsets."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def plain_strings(column: pa.Array) -> list:
    """The texts of a column, as ``to_pylist`` gives them, in a tenth of the time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def places_of(starts: np.ndarray, lengths: np.ndarray, beyond: int) -> np.ndarray:
    """The numbers from ``starts`` on, so many of each, one range after another; ``beyond`` is larger than all of them."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, beyond) < 2**31 else np.int64
    places = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return places


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` that begin at ``starts``, one after another."""
    return values[places_of(starts, lengths, len(values))]


def worker_memory() -> dict:
    """What a Python worker keeps from task to task. Functions arrive anew with every task, loaded modules stay."""
    return sys.modules.setdefault("_vecweave_worker", ModuleType("_vecweave_worker")).__dict__


def give_back_memory() -> None:
    """Hand memory that is free back to the system: a Python worker outlives its tasks, and what it keeps adds up with
    what Spark holds beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


class WordTokenizer:
    """A byte-pair tokenizer of the ``tokenizers`` library whose words end at white space.

    ``plain_specials`` makes the names of special tokens in a text ordinary text, so their ids never come from one.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        if TaskContext.get() is not None:  # a task has one core
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain_specials
        self.model = self.whole.model
        self.dtype = np.dtype(np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32)
        written = self.whole.pre_tokenizer.pre_tokenize_str
        # Of lower-case letters, none of which the model's own letters for bytes bring in again.
        self._bytes = {c: written(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if c.isalpha() and c == c.lower()}
        # Words of the model alone, already in its letters: a blank ends each, and the last id of a word says so.
        self._cores = Tokenizer(self.model)
        self._cores.pre_tokenizer = WhitespaceSplit()
        suffix, size = self.model.end_of_word_suffix, self.whole.get_vocab_size()
        self._is_last = np.fromiter(((self.whole.id_to_token(i) or "").endswith(suffix) for i in range(size)), bool, size)
        self._code = "H" if self.dtype == np.uint16 else "I"
        # The words that are kept, all their ids one after another, and where those of each end.
        nothing = (pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(1, np.int32))
        self._kept: dict[str, tuple] = worker_memory().setdefault(("words", path, plain_specials), {"all": nothing})

    def _encode_plain(self, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of plain letters, each of which is one unit for the model, and how many each has."""
        found = [np.zeros(0, self.dtype)]
        for first in range(0, len(cores), WORDS_AT_ONCE):
            written = " ".join(plain_strings(cores.slice(first, WORDS_AT_ONCE)))
            if not written.isascii():
                for letter, bytes_ in self._bytes.items():
                    written = written.replace(letter, bytes_)
            found.append(np.array(self._cores.encode_batch_fast([written], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(found)
        return ids, np.diff(np.flatnonzero(self._is_last[ids]) + 1, prepend=0)

    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any texts, and how many each has."""
        found, lengths = [np.zeros(0, self.dtype)], np.zeros(len(texts), np.int64)
        for first in range(0, len(texts), WORDS_AT_ONCE):
            some = self.whole.encode_batch_fast(plain_strings(texts.slice(first, WORDS_AT_ONCE)), add_special_tokens=False)
            ids = [array(self._code, one.ids) for one in some]
            lengths[first : first + len(ids)] = np.fromiter(map(len, ids), np.int64, len(ids))
            found.append(np.frombuffer(b"".join(ids), self.dtype))
        return np.concatenate(found), lengths

    def _look_up(self, cores: pa.Array, odd: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words that are kept and of new ones, and where those of each of these words, the plain ones first, start
        and how many they are. New words are kept while there is room."""
        words, values, ends = self._kept["all"]
        asked = pa.concat_arrays([cores, odd])
        places = pc.index_in(asked, words)
        missing = places.is_null()
        at = places.fill_null(0).to_numpy(zero_copy_only=False).copy()
        is_new = missing.to_numpy(zero_copy_only=False)
        at[is_new] = len(words) + np.arange(np.count_nonzero(is_new), dtype=at.dtype)
        encoded = self._encode_plain(cores.filter(missing.slice(0, len(cores)))), self._encode_whole(odd.filter(missing.slice(len(cores))))
        lengths = np.concatenate([n for _, n in encoded])
        all_values = np.concatenate([values, *(ids for ids, _ in encoded)])
        all_ends = np.concatenate([ends, ends[-1] + np.cumsum(lengths)]).astype(np.int32)
        room = min(MAX_KEPT_WORDS - len(words), len(lengths))
        if room > 0:
            words = pa.concat_arrays([words, asked.filter(missing).slice(0, room)])
            self._kept["all"] = (words, all_values[: all_ends[len(words)]].copy(), all_ends[: len(words) + 1].copy())
        return all_values, all_ends[at], all_ends[at + 1] - all_ends[at]

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all different words, and where those of each word start and how many they are."""
        parts = pc.extract_regex(words, _PLAIN)
        is_plain = parts.is_valid()
        plain = is_plain.to_numpy(zero_copy_only=False)
        cores = pc.utf8_lower(parts.field("core").filter(is_plain)).dictionary_encode()
        tails = parts.field("tail").filter(is_plain).dictionary_encode()
        values, starts, lengths = self._look_up(cores.dictionary, words.filter(pc.invert(is_plain)))
        tail_values, tail_lengths = self._encode_whole(tails.dictionary)

        # Each word is two pieces, the second of which may be empty.
        tail_ends = np.cumsum(tail_lengths) + len(values)
        values = np.concatenate([values, tail_values])
        n_looked_up, nothing = len(starts), len(starts) + len(tail_ends)
        starts = np.concatenate([starts, tail_ends - tail_lengths, [0]]).astype(np.int32)
        lengths = np.concatenate([lengths, tail_lengths, [0]]).astype(np.int32)
        first = np.full((len(words), 2), nothing, np.int32)
        first[plain, 0] = cores.indices.to_numpy(zero_copy_only=False)
        first[plain, 1] = tails.indices.to_numpy(zero_copy_only=False) + n_looked_up
        first[~plain, 0] = np.arange(len(cores.dictionary), n_looked_up)
        order = first.ravel()
        values = gather(values, starts[order], lengths[order])
        word_lengths = lengths[first].sum(axis=1, dtype=np.int32)
        return values, np.cumsum(word_lengths, dtype=np.int32) - word_lengths, word_lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them. A null text has no ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        values, starts, lengths = self._ids_of(flat.dictionary)
        index = flat.indices.to_numpy(zero_copy_only=False)
        lengths = lengths[index]
        ids = gather(values, starts[index], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        offsets = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return ids, offsets


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` after the ids of every text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
