"""The same results in plain SQL, for DuckDB over the same tables."""

from __future__ import annotations

_NOW = "2024-01-02T03:04:05.000000+00:00"
_NOW_MS = 1_704_164_645_000


def _cut(text: str, limit: int) -> str:
    """Text cut to ``limit`` bytes at a character boundary."""
    digits = f"hex(encode({text}))"

    def inside(end: int) -> str:
        return f"substr({digits}, {2 * end + 1}, 2) BETWEEN '80' AND 'BF'"

    length = (
        f"CASE WHEN NOT {inside(limit)} THEN {limit} WHEN NOT {inside(limit - 1)} THEN {limit - 1} "
        f"WHEN NOT {inside(limit - 2)} THEN {limit - 2} ELSE {limit - 3} END"
    )
    return (
        f"CASE WHEN strlen({text}) <= {limit} THEN {text} "
        f"ELSE decode(unhex(substr({digits}, 1, 2 * ({length})))) END"
    )


def _hashed(texts: str, dimension: int = 64) -> str:
    """CTEs from ``texts`` (id, text) to ``vectors`` (id, dim, weight, value)."""
    return f"""
    tokens AS (SELECT id, unnest(regexp_split_to_array(lower({_cut('text', 7500)}), '[^\\p{{L}}\\p{{N}}]+')) AS token
               FROM ({texts})),
    cells AS (SELECT id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {dimension} AS dim,
                     CASE WHEN CAST('0x' || substr(md5(token), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign
              FROM tokens WHERE token <> ''),
    weights AS (SELECT id, dim, CAST(sum(sign) AS BIGINT) AS weight FROM cells GROUP BY id, dim),
    norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY id),
    vectors AS (SELECT t.id, d.dim, coalesce(w.weight, 0) AS weight,
                       CASE WHEN coalesce(n.norm, 0) > 0
                            THEN CAST(CAST(coalesce(w.weight, 0) / n.norm AS FLOAT) AS DOUBLE) ELSE 0.0 END AS value
                FROM ({texts}) t
                CROSS JOIN (SELECT range AS dim FROM range({dimension})) d
                LEFT JOIN norms n ON n.id = t.id
                LEFT JOIN weights w ON w.id = t.id AND w.dim = d.dim),
    marks AS (SELECT id, CAST(sum(CAST(round(value * 1000000) AS BIGINT) * (dim + 1)) AS BIGINT) AS mark
              FROM vectors GROUP BY id)"""


_DOCUMENT_TEXTS = "SELECT doc_id AS id, text FROM documents"
_HASHED_DOCUMENTS = _hashed(_DOCUMENT_TEXTS)

# Events as plans/tables.py makes them: one row per chunk with its place in the event.
_CHUNKS = """
    chunks AS (SELECT doc_id, source, lang, text, doc_id // 100 AS bucket, source || '-' || (doc_id // 100) AS event_id,
                      row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS pos
               FROM documents)"""
_REPO = "CASE WHEN regexp_matches(source, '[13579]$') THEN 'repo-' || source END"
_EVENT_MARK = "CAST(sum(mark * (pos + 1)) AS BIGINT) AS mark"

_EVENT_REPORT = f"""
    WITH {_HASHED_DOCUMENTS}, {_CHUNKS}
    SELECT event_id, 'chunks.raw' AS event_type, bucket % 3 AS retry_count, source AS source_id, {_REPO} AS repo_name,
           string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS ids, CAST(64 AS BIGINT) AS dimension,
           {_EVENT_MARK}, 'feature-hashing' AS model, '{_NOW}' AS timestamp
    FROM chunks JOIN marks ON marks.id = doc_id
    GROUP BY event_id, bucket, source"""

# What each kind of damage leads to.
_DAMAGE = """
    damage AS (SELECT *, CASE doc_id % 12
                  WHEN 1 THEN 'bad metadata' WHEN 2 THEN 'not one JSON value' WHEN 3 THEN 'bad source_id'
                  WHEN 4 THEN 'bad chunks' WHEN 5 THEN 'empty payload' WHEN 6 THEN 'bad metadata'
                  WHEN 7 THEN 'bad headers' WHEN 8 THEN 'not one JSON value' WHEN 9 THEN 'not one JSON value'
                  END AS reason FROM documents)"""

_REQUESTS = """
    requests AS (SELECT source || '-' || (doc_id // 1000) AS request_id, source, doc_id,
                        CASE WHEN regexp_matches(source, '[13579]$') THEN 20 ELSE 32 END AS batch_size,
                        row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1 AS pos
                 FROM documents)"""

_TOPK = """
    WITH pairs AS (
        SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(
                   CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
        FROM embeddings q CROSS JOIN embeddings v),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10"""

# Nulls come first; every event is there twice.
_FIRST_EVENTS = """
    SELECT md5(text) AS event_id, CASE WHEN bool_or(doc_id % 5 = 0) THEN NULL ELSE min(doc_id % 5) END AS place,
           CAST(1 AS BIGINT) AS rows
    FROM documents GROUP BY 1"""

_KEY = f"sha256('15' || chr(10) || 'feature-hashing' || chr(10) || {_cut('text', 7500)})"

_OUTCOMES = f"""
        WITH {_DAMAGE}
        SELECT CASE WHEN reason IS NULL THEN 'published' ELSE 'rejected' END AS outcome, reason AS error,
               count(*) AS messages, count(*) FILTER (reason IS NULL) AS vectors_out,
               CAST(sum(doc_id) FILTER (reason IS NULL) AS BIGINT) AS sum_of_ids
        FROM damage GROUP BY ALL"""

ORACLES: dict[str, str] = {
    "truncate_utf8": f"""
        SELECT doc_id, CAST(strlen({_cut('text', 7500)}) AS BIGINT) AS n_bytes, md5({_cut('text', 7500)}) AS digest,
               CAST(strlen({_cut('text', 101)}) AS BIGINT) AS n_bytes_101, md5({_cut('text', 101)}) AS digest_101
        FROM documents""",
    "explode_chunks": f"""
        WITH {_CHUNKS}
        SELECT event_id, pos, CAST(doc_id AS VARCHAR) AS id, nullif(lang, 'fr') AS language, md5(text) AS digest
        FROM chunks""",
    "decode_valid": f"""
        WITH {_DAMAGE}
        SELECT doc_id, 's' AS source_id, CAST(CASE WHEN doc_id % 12 = 10 THEN 0 ELSE 2 END AS BIGINT) AS retry_count,
               CAST(doc_id AS VARCHAR) AS chunk_id, CAST(1 AS BIGINT) AS start_line, md5(text) AS digest
        FROM damage WHERE reason IS NULL""",
    "decode_rejects": f"""
        WITH {_DAMAGE}
        SELECT reason AS reject_reason, count(*) AS messages,
               CAST(count(*) FILTER (reason <> 'empty payload') AS BIGINT) AS with_payload
        FROM damage WHERE reason IS NOT NULL GROUP BY reason""",
    "correlation_id": """
        SELECT DISTINCT source || '-' || (doc_id // 100) AS event_id,
               CASE WHEN (doc_id // 100) % 2 = 0 THEN 'corr-' || source
                    ELSE source || '-' || (doc_id // 100) END AS correlation_id
        FROM documents""",
    "make_headers": f"""
        WITH digests AS (SELECT *, sha256(source || '/' || doc_id) AS d FROM documents)
        SELECT doc_id,
               substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-8' || substr(d, 14, 3) || '-8' || substr(d, 18, 3)
                   || '-' || substr(d, 21, 12) AS event_id,
               'embedding.generated' AS event_type, '{_NOW}' AS timestamp, source AS source_service,
               nullif(lang, 'en') AS correlation_id, CAST(NULL AS VARCHAR) AS trace_id
        FROM digests""",
    "model_list": """
        SELECT DISTINCT 'model-' || lang AS model, CAST(1024 AS BIGINT) AS dimension,
               CAST(7500 AS BIGINT) AS max_bytes
        FROM documents""",
    "model_routing": """
        SELECT doc_id, CASE WHEN lang = 'en' THEN 'model-es' ELSE 'model-' || lang END AS model,
               lang <> 'fr' AS known, CAST(1024 AS BIGINT) AS dimension, CAST(7500 AS BIGINT) AS max_bytes
        FROM documents""",
    "batch_plan": f"""
        WITH {_REQUESTS}
        SELECT request_id, CAST(batch_size AS BIGINT) AS batch_size, CAST(pos // batch_size AS BIGINT) AS batch_no,
               count(*) AS texts_in_batch
        FROM requests GROUP BY ALL""",
    "batch_response": f"""
        WITH {_HASHED_DOCUMENTS}, {_REQUESTS}
        SELECT request_id, 'model-' || source AS model, CAST(64 AS BIGINT) AS dimension, count(*) AS total_texts,
               {_EVENT_MARK}, CAST(NULL AS VARCHAR) AS error
        FROM requests JOIN marks ON marks.id = doc_id GROUP BY request_id, source""",
    "request_totals": f"""
        WITH cut AS (SELECT source || '-' || (doc_id // 1000) AS request_id,
                            contains({_cut('text', 7500)}, '@') AS failed FROM documents)
        SELECT request_id, count(*) FILTER (NOT failed) AS total_texts, count(*) FILTER (failed) AS failed_texts,
               CASE WHEN bool_or(failed) THEN 'model returned 400: address in text' END AS error
        FROM cut GROUP BY request_id""",
    "embed_single": f"""
        WITH {_HASHED_DOCUMENTS}
        SELECT id AS doc_id, 'feature-hashing' AS model, mark, CAST(1 AS BIGINT) AS total_texts FROM marks""",
    "stream_batches": f"""
        WITH {_HASHED_DOCUMENTS}
        SELECT id // 32 AS batch_no, count(*) AS n_texts, CAST(sum(mark * (id % 32 + 1)) AS BIGINT) AS mark
        FROM marks GROUP BY id // 32""",
    "stream_batches_filled": f"""
        SELECT count(*) AS n_texts, CAST(sum(strlen({_cut('text', 7500)})) AS BIGINT) AS n_bytes,
               CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS failed_batches
        FROM documents""",
    "batch_failures": f"""
        WITH cut AS (SELECT doc_id, {_cut('text', 7500)} AS text FROM documents),
        batches AS (SELECT doc_id // 32 AS batch_no, count(*) AS n, bool_or(contains(text, '@')) AS failed
                    FROM cut GROUP BY 1)
        SELECT batch_no, CASE WHEN failed THEN 0 ELSE n END AS n_texts,
               CASE WHEN failed THEN 'model returned 400: address in text' END AS error
        FROM batches""",
    "reorder_by_index": """
        SELECT conv_id, turn // 32 AS answer_no,
               row_number() OVER (PARTITION BY conv_id, turn // 32 ORDER BY turn) - 1 AS pos,
               CAST(strlen(text) AS BIGINT) AS n_bytes, turn
        FROM conversations""",
    "embed_hash_weights": f"""
        WITH {_HASHED_DOCUMENTS}
        SELECT id AS doc_id, dim, weight FROM weights WHERE weight <> 0""",
    "embed_hash_vectors": f"""
        WITH {_HASHED_DOCUMENTS}
        SELECT id AS doc_id, dim, round(value, 6) AS value FROM vectors""",
    "embed_callable": f"""
        WITH cut AS (SELECT doc_id, {_cut('text', 7500)} AS text FROM documents)
        SELECT doc_id, 'sizes' AS model, CAST(3 AS BIGINT) AS dimension, CAST(strlen(text) AS BIGINT) AS n_bytes,
               CAST(length(text) AS BIGINT) AS n_chars,
               CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS n_spaces
        FROM cut""",
    "embedding_events": _EVENT_REPORT,
    "assemble_events": f"SELECT r.*, c.copy FROM ({_EVENT_REPORT}) r CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) c(copy)",
    "partial_failure": f"""
        WITH {_CHUNKS}
        SELECT event_id, count(*) AS chunks_in,
               string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) FILTER (lang <> 'en') AS ids,
               coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) FILTER (lang = 'en'), '') AS failed_ids,
               CASE WHEN bool_or(lang = 'en') THEN 'model returned 400: language not served' END AS error
        FROM chunks GROUP BY event_id HAVING count(*) FILTER (lang <> 'en') > 0""",
    "run_metrics": f"""
        WITH {_CHUNKS}
        SELECT source AS source_id, count(DISTINCT bucket) AS events, count(*) AS chunks_in,
               count(*) FILTER (lang <> 'en') AS vectors_out, count(*) FILTER (lang = 'en') AS chunks_failed
        FROM chunks GROUP BY source""",
    "encode_roundtrip": f"""
        WITH {_HASHED_DOCUMENTS}, {_CHUNKS}
        SELECT source AS key, {_REPO} IS NULL AS says_no_repo, false AS says_other_null, event_id,
               bucket % 3 AS retry_count, {_REPO} AS repo_name,
               string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS ids,
               string_agg(coalesce(nullif(lang, 'fr'), '-'), ',' ORDER BY pos) AS languages,
               {_EVENT_MARK}, '{_NOW}' AS timestamp
        FROM chunks JOIN marks ON marks.id = doc_id
        GROUP BY event_id, bucket, source""",
    "dlq_envelope": f"""
        SELECT source AS key, 'embedding.generated' AS failed_topic, CAST({_NOW_MS} AS BIGINT) AS failed_at,
               'too large' AS error, md5(text) AS digest
        FROM documents WHERE strlen(text) > 2000""",
    "message_outcomes": f"""
        WITH {_DAMAGE}
        SELECT CASE WHEN reason IS NULL THEN 'published' ELSE 'rejected' END AS outcome, reason AS error,
               count(*) AS messages, count(*) FILTER (reason IS NULL) AS chunks_in,
               count(*) FILTER (reason IS NULL) AS vectors_out
        FROM damage GROUP BY reason
        UNION ALL SELECT 'empty', NULL, count(*), 0, 0 FROM documents WHERE doc_id % 7 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'dead_letter', 'message of more than 10000 bytes', count(*), count(*), count(*)
        FROM documents WHERE doc_id % 11 = 0 HAVING count(*) > 0""",
    "dedup_events": _FIRST_EVENTS,
    "dedup_events_ranked": _FIRST_EVENTS,
    "vector_topk": _TOPK,
    "vector_topk_grid": _TOPK,
    "text_search": f"""
        WITH {_hashed("SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id AS id, text FROM benchmark")},
        lists AS (SELECT id, list(value ORDER BY dim) AS embedding FROM vectors GROUP BY id),
        pairs AS (SELECT -1 - q.id AS query_id, v.id AS vec_id,
                         round(list_cosine_similarity(q.embedding, v.embedding), 9) AS score
                  FROM lists q CROSS JOIN lists v WHERE q.id < 0 AND v.id >= 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10""",
    "cache_misses": f"""
        WITH keyed AS (SELECT doc_id, {_KEY} AS key FROM documents)
        SELECT key, min(doc_id) AS doc_id, count(*) AS copies FROM keyed
        WHERE key NOT IN (SELECT key FROM keyed WHERE doc_id IN (SELECT doc_id FROM labels))
        GROUP BY key""",
    "cache_reuse": f"""
        WITH {_HASHED_DOCUMENTS}
        SELECT doc_id, {_KEY} AS key, mark FROM documents JOIN marks ON marks.id = doc_id""",
    "vector_table_latest": """
        SELECT role AS model, conv_id AS id, max(turn) AS version, CAST(arg_max(strlen(text), turn) AS BIGINT) AS n_bytes
        FROM conversations GROUP BY role, conv_id""",
    "retried_calls": f"""
        SELECT doc_id, CAST(strlen({_cut('text', 7500)}) AS BIGINT) AS n_bytes,
               CAST(length({_cut('text', 7500)}) AS BIGINT) AS n_chars
        FROM documents""",
    "calls_in_flight": f"""
        SELECT doc_id, CASE WHEN text NOT LIKE 'a%' THEN CAST(strlen({_cut('text', 7500)}) AS BIGINT) END AS n_bytes,
               true AS within_limit, CASE WHEN text LIKE 'a%' THEN 'model returned 400: refused' END AS error
        FROM documents""",
    "publish_outcomes": """
        SELECT doc_id, source AS key, md5(text) AS digest,
               CASE WHEN text LIKE '%@%' THEN 'model returned 400: address in message' END AS error,
               CASE WHEN text LIKE '%@%' THEN 'embedding.generated' END AS topic,
               CAST(count(*) FILTER (text NOT LIKE '%@%') OVER () AS BIGINT) AS n_sent,
               CAST(count(*) FILTER (text LIKE '%@%') OVER () AS BIGINT) AS n_refused
        FROM documents""",
    "empty_texts": f"""
        SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS total_texts,
               CASE WHEN doc_id % 3 = 0 THEN '' ELSE '0,' || strlen({_cut('text', 7500)}) END AS n_bytes
        FROM documents""",
    "stream_unbounded": f"SELECT doc_id, CAST(strlen({_cut('text', 7500)}) AS BIGINT) AS n_bytes FROM documents",
    "stream_outcomes": _OUTCOMES,
    "stream_restarted": _OUTCOMES,
    "redriven_letters": """
        WITH letters AS (SELECT doc_id, doc_id % 4 AS tried, doc_id % 5 = 2 AND doc_id % 4 < 3 AS sent FROM documents WHERE doc_id % 5 > 1)
        SELECT doc_id, CASE WHEN sent THEN 'published' ELSE 'final' END AS outcome,
               CASE WHEN sent THEN tried + 1 ELSE 3 END AS retry_count,
               CASE WHEN tried > 0 THEN 'first-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS original_event_id,
               100 + doc_id % 5 * 2000 AS n_letters,
               CASE WHEN NOT sent THEN 'no further attempt: message of more than '
                    || CASE WHEN tried < 3 THEN 6000 ELSE 4000 END || ' bytes' END AS error
        FROM letters""",
    "stream_filled_across": f"""
        SELECT doc_id, CAST(strlen({_cut('text', 7500)}) AS BIGINT) AS n_bytes, true AS within_limit, true AS few_short
        FROM documents""",
    "event_repeats": """
        SELECT md5(text) AS event_id, CAST(1 AS BIGINT) AS passed, 2 * count(*) - 1 AS suppressed, 2 * count(*) - 1 AS last_repeat,
               CAST(1 AS BIGINT) AS first_places, 2 * count(*) AS places
        FROM documents GROUP BY 1""",
    "cache_table_reuse": f"""
        WITH {_HASHED_DOCUMENTS}, keyed AS (SELECT doc_id, {_KEY} AS key FROM documents)
        SELECT doc_id, key, mark, key IN (SELECT key FROM keyed JOIN labels USING (doc_id)) AS known_before, CAST(1 AS BIGINT) AS entries
        FROM keyed JOIN marks ON marks.id = doc_id""",
    "vector_store_versions": """
        WITH vectors AS (SELECT vec_id AS id, 'm' || (coalesce(label, 0) % 2) AS model, embedding FROM embeddings),
        kept AS (SELECT *, CASE WHEN id % 3 = 0 OR id % 10 = 0 THEN embedding ELSE list_reverse(embedding) END AS v
                 FROM vectors WHERE id % 5 > 0 OR id % 10 = 0),
        marks AS (SELECT id, model, CAST(list_sum(list_transform(range(1, len(v) + 1),
                         lambda i: CAST(round(CAST(v[i] AS DOUBLE) * 1000000) AS BIGINT) * i)) AS BIGINT) AS mark FROM kept)
        SELECT 'before' AS stage, model, id, mark FROM marks
        UNION ALL SELECT 'after', model, id, mark FROM marks WHERE id % 7 > 0
        UNION ALL SELECT 'one model', model, id, mark FROM marks WHERE id % 7 > 0 AND model = 'm1'""",
    "stored_vector_search": """
        WITH vectors AS (SELECT vec_id, embedding, label FROM embeddings),
        asked AS (SELECT vec_id AS query_id, embedding, label FROM vectors WHERE vec_id % 20 = 0),
        pairs AS (SELECT q.query_id, v.vec_id,
                         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
                  FROM asked q JOIN vectors v ON v.label % 2 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 5""",
}
