"""Registered queries against brute force or SQL, on whole tables."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from math import exp

import duckdb
import numpy as np
import pytest
import xxhash

from vecweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchdf()


@pytest.fixture(scope="module")
def token_ids(documents):
    from tokenizers import Tokenizer

    from vecweave.llm.settings import WORD_TOKENIZER

    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    found = tokenizer.encode_batch([t or "" for t in documents.text], add_special_tokens=False)
    return {d: [*one.ids, 1] for d, one in zip(documents.doc_id, found)}


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).toPandas()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def linked(pairs, nodes):
    """Smallest node of every component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_token_files(spark, token_ids):
    got = rows(spark, "op3_token_files").sort_values("doc_id")
    assert list(got.doc_id) == sorted(token_ids)
    lengths = np.array([len(token_ids[d]) for d in got.doc_id])
    assert list(got.n_tokens) == list(lengths)
    assert list(got.start) == list(np.cumsum(lengths) - lengths)
    assert list(got.ids_crc32) == [crc(token_ids[d]) for d in got.doc_id]


def test_token_counts(spark, token_ids):
    got = rows(spark, "op5_token_counts")
    assert got.ended.all()
    assert dict(zip(got.doc_id, got.n_tokens)) == {d: len(ids) for d, ids in token_ids.items()}


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for one in shingles:
        value = xxhash.xxh64_intdigest(one, 42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def test_simhash(spark, documents):
    got = rows(spark, "op2_simhash").set_index("doc_id")
    prints = {d: fingerprint(t) for d, t in zip(documents.doc_id, documents.text)}
    assert {d: f"{p:016x}" for d, p in prints.items()} == got.fingerprint.to_dict()
    ids = list(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert linked(pairs, ids) == got.component_id.to_dict()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    from compare import connect, differences

    want = connect(FOLDER).execute(ORACLES[name]).fetchdf()
    assert len(want) > 0
    assert differences(rows(spark, name), want) is None


def test_html_text(spark):
    """Articles of the pages stand between their tags."""
    got = rows(spark, "op9_html_text").set_index("page_id")
    pages = duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, page in pages:
        article = re.search("<article>(.*)</article>", page, re.S)[1]
        text = html.unescape(re.sub(r"<(br|/?p|/?h1)>", " ", article).replace("<b>", "").replace("</b>", ""))
        assert got.text[page_id] == " ".join(text.split())
        assert got.n_chars[page_id] == len(got.text[page_id])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_rules(spark, documents):
    got = rows(spark, "op1_quality_rules").set_index("doc_id")
    assert len(got) == len(documents)
    for d, text in zip(documents.doc_id, documents.text):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in (i, i + 1, i + 2)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        want = (
            len(words),
            sum(map(len, words)),
            sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)),
            len(covered),
        )
        row = got.loc[d]
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.base_failed and row.kept)


def test_near_vectors(spark):
    got = rows(spark, "op4_near_vectors").set_index("vec_id")
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    unit = np.array([v for _, v in table])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    ids = [i for i, _ in table]
    assert got.n_links.to_dict() == dict(zip(ids, links.sum(axis=1)))
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links))]
    assert got.component_id.to_dict() == linked(pairs, ids)


def check_pieces(pieces, ids_of, copies):
    """Every id of every copy of a document lies in one piece, and sequences have no holes."""
    found, filled = defaultdict(list), defaultdict(int)
    for p in sorted(pieces.itertuples(), key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
        ids = ids_of[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
        found[p.doc_id] += range(p.start, p.start + p.length)
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())
    short = sum(n < 2048 for n in filled.values())
    for d, ids in ids_of.items():
        assert sorted(found.pop(d, [])) == sorted(list(range(len(ids))) * copies[d])
    assert not found
    return short, len(filled)


def test_packing(spark, token_ids):
    short, sequences = check_pieces(rows(spark, "op6_packing"), token_ids, dict.fromkeys(token_ids, 1))
    assert sequences > 50 and short <= 11 * 8


def test_language(spark, documents):
    got = rows(spark, "op8_language_id").merge(documents[["doc_id", "lang", "text"]], on="doc_id")
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]
    assert got.score.between(0, 1).all()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert all((p == "und") == (not any(map(str.isalpha, t or ""))) for p, t in zip(got.lang_pred, got.text))


def test_pipeline(spark, documents):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from vecweave.llm.settings import END_ID, WORD_TOKENIZER

    texts = {d: t for d, t in zip(documents.doc_id, documents.text) if any(map(str.isalpha, t or ""))}
    sources = dict(zip(documents.doc_id, documents.source))
    # Lines.
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, text in texts.items():
        for line in text.split("\n"):
            holders[key(line)].add(d)
    gone = lambda d, k: len(k) >= 20 and len(holders[k]) >= 3 and d < max(holders[k])
    texts = {d: "\n".join(x for x in t.split("\n") if not gone(d, key(x))) for d, t in texts.items()}
    # Near-duplicates.
    prints = {d: fingerprint(t) for d, t in texts.items()}
    ids = list(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
    texts = {d: texts[d] for d, root in linked(pairs, ids).items() if root == d}
    # Copies.
    size = Counter()
    for d, t in texts.items():
        size[sources[d]] += len(t) + 1
    weight = {s: n**0.5 for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / n for s, n in size.items()}
    copies = {}
    for d in texts:
        place = int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:13], 16) / 2**52
        chance, below, n = exp(-rate[sources[d]]), 0.0, 0
        while below + chance <= place:
            below, n = below + chance, n + 1
            chance *= rate[sources[d]] / n
        copies[d] = n
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    found = tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)
    token_ids = {d: [*one.ids, END_ID] for d, one in zip(texts, found)}
    check_pieces(corpus_pipeline.run(spark, FOLDER).toPandas(), token_ids, copies)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
