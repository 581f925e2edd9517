"""Codes and filters inside tasks: exact round trips."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecweave.llm.cuckoo import CuckooFilter
from vecweave.llm.elias_fano import EliasFano
from vecweave.llm.settings import WORD_TOKENIZER
from vecweave.llm.words import WordTokenizer, with_end


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=700), st.integers(0, 30))
def test_elias_fano(values, shift):
    values = sorted(v >> shift for v in values)
    data = b"xx" + EliasFano.of(np.array(values, np.int64)).to_bytes()
    read, end = EliasFano.from_bytes(data, 2)
    assert end == len(data) and len(read) == len(values)
    assert read.decode().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1, 255, 256, 257}:
        if 0 <= i < len(values):
            assert read[i] == values[i]
    for start, stop in ((0, len(values)), (1, 257), (255, 600), (300, 300), (len(values) // 3, len(values) // 2)):
        if start <= stop <= len(values):
            assert read.run(start, stop).tolist() == values[start:stop]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert 8 * len(EliasFano.of(ends).to_bytes()) < 13 * len(ends)
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([2]))[1]


def test_cuckoo_filter():
    random = np.random.default_rng(0)
    keys = np.unique(random.integers(-(2**63), 2**63 - 1, 60_000))
    kept = CuckooFilter.from_bytes(CuckooFilter.of(keys).to_bytes())
    assert kept.find(keys).all()
    other = random.integers(-(2**63), 2**63 - 1, 100_000)
    assert kept.find(other).mean() < 0.001
    kept.remove(keys[:30_000])
    assert kept.find(keys[30_000:]).all() and kept.find(keys[:30_000]).mean() < 0.001
    kept.remove(keys[30_000:])
    assert not kept.table.any()
    assert not CuckooFilter(4).add(keys)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="aZéÀß'.,! \n\t12<|>")), max_size=8))
def test_words_are_encoded_as_whole_texts(texts):
    tokenizer = WordTokenizer(WORD_TOKENIZER)
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offsets = with_end(*tokenizer.encode(pa.array(texts, pa.string())), 1)
    want = [tokenizer.whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


def test_words_are_kept_apart_by_the_meaning_of_special_names():
    """Both ways in one process: the names of special tokens are tokens in one, plain text in the other."""
    from tokenizers import Tokenizer

    from vecweave.llm.settings import SPECIAL_END_ID

    texts = ["stop <|endoftext|> here", "<|startoftext|> again", "plain words", "a<|endoftext|>b"]
    for plain in (False, True, False):
        whole = Tokenizer.from_file(WORD_TOKENIZER)
        whole.encode_special_tokens = plain
        want = [one.ids for one in whole.encode_batch(texts, add_special_tokens=False)]
        ids, offsets = WordTokenizer(WORD_TOKENIZER, plain).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
        assert (SPECIAL_END_ID in ids) != plain


def test_marks_after_a_word_are_one_unit():
    """Only the marks themselves go through the whole tokenizer, and words end where the model's last units are."""
    tokenizer = WordTokenizer(WORD_TOKENIZER)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    words = [f"{word}{mark}{more}" for word in ("Straße", "heat", "ÀÉÿ", "<s") for mark in marks for more in ("", "$$$", "'", "|>")]
    given, encode = [], tokenizer._encode_whole
    tokenizer._encode_whole = lambda texts: given.extend(texts.to_pylist()) or encode(texts)
    ids, offsets = tokenizer.encode(pa.array(words))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [
        tokenizer.whole.encode(word, add_special_tokens=False).ids for word in words
    ]
    assert not [word for word in given if any(c.isalpha() for c in word) and word[0] != "<"]


def test_memory_of_many_words_is_bounded(monkeypatch):
    """A hundred thousand different words, of which some are kept: no object for each word stays, nor are there many at a time."""
    import tracemalloc

    import vecweave.llm.words as module

    monkeypatch.setattr(module, "MAX_KEPT_WORDS", 60_000)
    monkeypatch.setattr(module, "worker_memory", lambda kept={}: kept)
    random = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnoprstuvwyäéß"))
    words = ["".join(letters[random.integers(0, len(letters), 9)]) for _ in range(100_000)]
    tokenizer = module.WordTokenizer(WORD_TOKENIZER)
    texts = [" ".join(words[:50_000]), " ".join(words[50_000:]), " ".join(words[::-1])]
    tracemalloc.start()
    got = [tokenizer.encode(pa.array([text]))[0] for text in texts]
    peak = tracemalloc.get_traced_memory()[1] - sum(ids.nbytes for ids in got)
    tracemalloc.stop()
    assert peak < 24e6
    for text, ids in zip(texts, got):
        assert ids.tolist() == tokenizer.whole.encode(text, add_special_tokens=False).ids


def test_shards_are_read_by_select(spark, tmp_path, monkeypatch):
    """Blocks of boundaries come from the select structure alone: without it documents are others."""
    import vecweave.llm.token_files as module

    monkeypatch.setattr(module, "READ_DOCS", 300)
    random = np.random.default_rng(8)
    lengths = random.integers(1, 40, 1000)
    ids = random.integers(0, 1000, lengths.sum())
    writer = module.ShardWriter(f"{tmp_path}/shard", np.dtype(np.uint16))
    writer.add(ids, lengths, pa.array([None] * 310 + sorted(random.integers(0, 10**9, 690).tolist()), pa.int64()))
    writer.close()
    shard = module.ShardReader(f"{tmp_path}/shard")
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for first, block in shard.blocks():
        assert block.tolist() == edges[first : first + 301].tolist()
        assert shard.doc_id_run(first, first + len(block) - 1).to_pylist() == [shard.doc_id(i) for i in range(first, first + len(block) - 1)]
    assert shard.document(999).tolist() == ids[edges[999] :].tolist()
    manifest = spark.createDataFrame([(0, 0, f"{tmp_path}/shard", 1000, len(ids))], module.MANIFEST)
    monkeypatch.setattr(EliasFano, "decode", lambda self: pytest.fail("a table of a whole shard"))
    got = module.read_token_files(manifest).collect()
    assert [r.n_tokens for r in got] == lengths.tolist() and [r.start for r in got] == edges[:-1].tolist()
    shard.ends._places = np.zeros_like(shard.ends._places)
    with pytest.raises(ValueError):
        list(shard.blocks())
