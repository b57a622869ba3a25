"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from mnemolake.functions.embed import embed
from mnemolake.plans.queries import MEMORIES, NOW, QUERY, STEMMED, VECTOR

_M = """m AS (
  SELECT md5(conv_id || ':' || turn) AS id, 'conv_' || conv_id AS identifier, text AS fact_text, role AS source, ((conv_id * 7 + turn * 3) % 11) / 10.0::DOUBLE AS importance,
         strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * conv_id, '%Y-%m-%dT%H:%M:%SZ') AS created_at, 1704067200 + conv_id * 60 AS born, CASE WHEN conv_id % 5 = 0 THEN 3600 END AS ttl,
         ['HOT', 'READY', 'PROMOTED', 'ARCHIVED'][conv_id % 4 + 1] AS promotion_state, CAST(conv_id % 3 = 0 AS INTEGER) AS promotion_candidate,
         sha256('conv_' || conv_id || ':' || coalesce(text, '')) AS content_hash, conv_id, turn, role
  FROM conversations)"""
_LIVE = f"(ttl IS NULL OR {NOW} - born < ttl)"
_D = "d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS identifier, text AS fact_text, sha256(coalesce(source, '') || ':' || coalesce(text, '')) AS content_hash FROM documents)"
_E = "e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS memory_id, 'u' || (user_id % 10) AS namespace, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, props AS payload_json FROM events)"
_VEC = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
_P = ["the", "and", "of", "then"]
_BM = f"""t AS (SELECT id, regexp_extract_all(lower(coalesce(fact_text, '')), '[a-z0-9]+') AS tokens FROM m),
f AS (SELECT id, len(tokens) AS n, {", ".join(f"len(list_filter(tokens, lambda x: starts_with(x, '{p}'))) AS f{i}" for i, p in enumerate(_P))} FROM t),
c AS (SELECT count(*) AS total, avg(n) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(4))} FROM f),
bm AS (SELECT id, -({" + ".join(f"greatest(CASE WHEN ln((total - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((total - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END, 0) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(4))}) AS bm25
       FROM f, c WHERE {" AND ".join(f"f{i} > 0" for i in range(4))})"""
_HY = f"""v AS (SELECT m.*, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}) AS cosine FROM m JOIN embeddings ON vec_id = CAST('0x' || substr(id, 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)),
vis AS (SELECT * FROM v WHERE {_LIVE} AND promotion_state <> 'ARCHIVED'),
hits AS (SELECT bm.* FROM bm JOIN vis USING (id)),
nt AS (SELECT id, CASE WHEN min(bm25) OVER () = max(bm25) OVER () THEN 1.0 ELSE 1 - (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS text_score FROM hits),
sc AS (SELECT vis.*, 0.6 * cosine + 0.2 * coalesce(text_score, 0) + 0.2 * importance AS score FROM vis LEFT JOIN nt USING (id) WHERE coalesce(fact_text, '') <> ''),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, cosine DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 20)"""
_FIRST = "SELECT doc_id, content_hash FROM d QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1"
_WARN = """d8 AS (SELECT CAST(doc_id AS VARCHAR) AS id, 8 * length(text) AS n FROM documents),
s AS (SELECT count(*) AS total, sum(n) AS chars FROM d8),
w AS (SELECT 'large_inline' AS category, 'warn' AS severity, id AS subject, CAST(n AS BIGINT) AS amount FROM d8 WHERE n > 131072
      UNION ALL SELECT 'growth', 'info', NULL, total FROM s WHERE total > 1000 UNION ALL SELECT 'growth', 'warn', NULL, CAST(chars AS BIGINT) FROM s WHERE chars > 10485760)"""
_SEEN = "g0 AS (SELECT event_id AS seq, user_id || '/' || (event_id % 3) AS id, CASE WHEN event_type = 'error' THEN '' ELSE md5((event_id % 97) || ':' || event_type) END AS content_hash FROM events)"
#: Rounds of: the first of id and hash is in, what shares either is out; more than any of the tables needs.
for _n in range(12):
    _SEEN += f""",
w{_n} AS MATERIALIZED (SELECT * FROM g{_n} QUALIFY seq = min(seq) OVER (PARTITION BY id) AND (content_hash = '' OR seq = min(seq) OVER (PARTITION BY content_hash))),
g{_n + 1} AS MATERIALIZED (SELECT * FROM g{_n} WHERE id NOT IN (SELECT id FROM w{_n}) AND (content_hash = '' OR content_hash NOT IN (SELECT content_hash FROM w{_n})))"""
_TO = "['HOT', 'READY', 'PROMOTED', 'ARCHIVED'][CAST('0x' || substr(id, 1, 8) AS BIGINT) % 4 + 1]"



def _measure(stem: str, least: int, exactly: bool = False) -> str:
    """Whether a stem has so many runs of vowels and consonants; Y is a y that is a vowel."""
    return f"regexp_full_match({stem}, '[^aeiouY]*([aeiouY]+[^aeiouY]+){{{least}{'' if exactly else ','}}}[aeiouY]*')"


def _short(stem: str) -> str:
    return f"regexp_matches({stem}, '[^aeiouY][aeiouY][^aeiouYwxy]$')"


def _suffixes(table: tuple, kept: str, drop: str = "") -> str:
    """The longest suffix of a table decides; kept is the condition on the stem before it."""
    cases = ""
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        stem = f"left(x, -{len(end)})"
        cases += f" WHEN ends_with(x, '{end}') THEN CASE WHEN {kept.format(stem=stem)}{drop.format(stem=stem) if end == 'ion' else ''} THEN {stem} || '{new}' ELSE x END"
    return f"CASE{cases} ELSE x END"


def _porter(words: str) -> str:
    """CTEs that give stems (word, stem) of a table of words, by the published steps, as regular expressions."""
    two = "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    three = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    four = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
    pairs = lambda text: tuple(tuple((x + ":").split(":")[:2]) for x in text.split())
    fixed = f"CASE WHEN regexp_matches(t, '(at|bl|iz)$') THEN t || 'e' WHEN length(t) > 1 AND lower(right(t, 1)) = lower(substr(t, -2, 1)) AND NOT regexp_matches(t, '[aeiouYlsz]$') THEN left(t, -1) WHEN {_measure('t', 1, True)} AND {_short('t')} THEN t || 'e' ELSE t END"
    cut = "CASE WHEN ends_with(x, 'eed') OR NOT (ends_with(x, 'ed') OR ends_with(x, 'ing')) THEN NULL WHEN ends_with(x, 'ed') THEN left(x, -2) ELSE left(x, -3) END"
    e = "left(x, -1)"
    steps = [
        "CASE WHEN regexp_matches(x, '(sses|ies)$') THEN left(x, -2) WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, -1) ELSE x END",
        f"CASE WHEN ends_with(x, 'eed') THEN CASE WHEN {_measure('left(x, -3)', 1)} THEN {e} ELSE x END WHEN t IS NOT NULL AND regexp_matches(t, '[aeiouY]') THEN {fixed} ELSE x END",
        f"CASE WHEN regexp_matches(x, '[yY]$') AND regexp_matches({e}, '[aeiouY]') THEN {e} || 'i' ELSE x END",
        _suffixes(pairs(two), _measure("{stem}", 1).replace("{1,}", "{{1,}}")),
        _suffixes(pairs(three), _measure("{stem}", 1).replace("{1,}", "{{1,}}")),
        _suffixes(pairs(four), _measure("{stem}", 2).replace("{2,}", "{{2,}}"), " AND regexp_matches({stem}, '[st]$')"),
        f"CASE WHEN ends_with(x, 'e') AND ({_measure(e, 2)} OR {_measure(e, 1)} AND NOT {_short(e)}) THEN {e} ELSE x END",
        f"CASE WHEN ends_with(x, 'll') AND {_measure(e, 2)} THEN {e} ELSE x END",
    ]
    out = f"p0 AS (SELECT word, regexp_replace(regexp_replace(word, '([^aeiouy])y', '\\1Y', 'g'), 'yy', 'yY', 'g') AS x FROM {words} WHERE strlen(word) BETWEEN 3 AND 64)"
    for n, step in enumerate(steps):
        out += f", p{n + 1} AS (SELECT word, {step} AS x FROM (SELECT word, x, {cut if n == 1 else 'NULL'} AS t FROM p{n}) s)"
    return out + f", stems AS (SELECT word, lower(x) AS stem FROM p{len(steps)} UNION ALL SELECT word, word FROM {words} WHERE strlen(word) NOT BETWEEN 3 AND 64)"


def _stemmed(prefixes: list[str]) -> str:
    """CTEs that end in bm (id, bm25) over stems, each of prefixes a phrase of its own."""
    idf = "CASE WHEN ln((total - n{0} + 0.5) / (n{0} + 0.5)) > 0 THEN ln((total - n{0} + 0.5) / (n{0} + 0.5)) ELSE 1e-6 END"
    each = range(len(prefixes))
    return f"""tk AS MATERIALIZED (SELECT id, unnest(regexp_extract_all(lower(strip_accents(coalesce(fact_text, ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS word FROM m),
words AS MATERIALIZED (SELECT DISTINCT word FROM tk), {_porter("words")},
f AS (SELECT m.id, count(stem) AS n, {", ".join(f"count(*) FILTER (starts_with(stem, '{p}')) AS f{i}" for i, p in enumerate(prefixes))} FROM m LEFT JOIN (tk JOIN stems USING (word)) k ON k.id = m.id GROUP BY m.id),
c AS (SELECT count(*) AS total, avg(n) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in each)} FROM f),
bm AS (SELECT id, -({" + ".join(f"{idf.format(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in each)}) AS bm25 FROM f, c WHERE {" AND ".join(f"f{i} > 0" for i in each)})"""


def _embedded(query: str, k: int) -> str:
    """CTEs that end in r: the hybrid of bm, the hash embedding of each text and importance."""
    return f"""g AS (SELECT id, md5(substr(lower(coalesce(fact_text, '')), i, 3)) AS h FROM (SELECT id, fact_text, unnest(range(1, greatest(1, length(coalesce(fact_text, '')) - 2) + 1)) AS i FROM m)),
b AS (SELECT id, ('0x' || substr(h, 31, 2))::INTEGER % 64 AS bucket, sum(1 - 2 * (('0x' || substr(h, 16, 1))::INTEGER % 2))::DOUBLE AS signed FROM g GROUP BY 1, 2),
u AS (SELECT id, bucket, CAST(CAST(signed / nullif(sqrt(sum(signed * signed) OVER (PARTITION BY id)), 0) AS FLOAT) AS DOUBLE) AS x FROM b),
cs AS (SELECT id, coalesce(sum(x * ({embed(query)}::DOUBLE[])[bucket + 1]) / nullif(sqrt(sum(x * x)) * sqrt({sum(v * v for v in embed(query))!r}::DOUBLE), 0), 0) AS cosine FROM u GROUP BY id),
vis AS (SELECT m.*, cosine FROM m JOIN cs USING (id) WHERE {_LIVE} AND promotion_state <> 'ARCHIVED'),
hits AS (SELECT bm.* FROM bm JOIN vis USING (id)),
nt AS (SELECT id, CASE WHEN min(bm25) OVER () = max(bm25) OVER () THEN 1.0 ELSE 1 - (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS text_score FROM hits),
sc AS (SELECT vis.*, 0.6 * cosine + 0.2 * coalesce(text_score, 0) + 0.2 * importance AS score FROM vis LEFT JOIN nt USING (id) WHERE coalesce(fact_text, '') <> ''),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, cosine DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= {k})"""


_PHRASED = """t AS (SELECT id, regexp_extract_all(lower(coalesce(fact_text, '')), '[a-z0-9]+') AS tokens FROM m),
f AS (SELECT id, len(tokens) AS n, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'the' AND starts_with(tokens[i + 1], 'an'))) AS f0, len(list_filter(tokens, lambda x: starts_with(x, 'of'))) AS f1 FROM t),
c AS (SELECT count(*) AS total, avg(n) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f)"""
_VERSIONS = """v AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type = 'view' THEN sha256(props) ELSE '' END AS content_hash, props AS fact_text, event_type = 'click' AS file, event_id % 100 AS bytes FROM events),
live AS (SELECT * FROM v QUALIFY event_id = max(event_id) OVER (PARTITION BY id) AND (content_hash = '' OR event_id = max(event_id) OVER (PARTITION BY content_hash)))"""
_KEPT = "k AS (SELECT * FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= (SELECT count(*) FROM events) * 7 // 10)"

ORACLE_SQL: dict[str, str] = {
    "bm25_stemmed": f"WITH {_M}, {_stemmed(['thing', 'and', 'the'])} SELECT id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_postings": f"WITH {_M}, {_BM} SELECT id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_phrase": f"WITH {_M}, {_PHRASED} SELECT id, round(-({' + '.join(f'CASE WHEN ln((total - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((total - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))' for i in range(2))}), 6) AS bm25 FROM f, c WHERE f0 > 0 AND f1 > 0",
    "hybrid_memories": f"WITH {_M}, {_stemmed(['the', 'thing', 'and', 'then'])}, {_embedded(MEMORIES, 10)} SELECT 'system' AS role, fact_text AS content, id AS memory_id, identifier, round(score, 4) AS score, created_at, rank FROM r",
    "hybrid_postings": f"WITH {_M}, {_BM}, {_embedded(QUERY, 20)} SELECT id, rank, round(score, 6) AS score FROM r",
    "store_versions": f"WITH {_VERSIONS} SELECT id, content_hash, fact_text, event_id FROM live",
    "store_stats": f"""WITH {_VERSIONS} SELECT count(*) AS total, count(*) FILTER (NOT file) AS inline_count, count(*) FILTER (file) AS file_count, CAST(coalesce(sum(length(fact_text)) FILTER (NOT file), 0) AS BIGINT) AS inline_chars,
        CAST(coalesce(sum(bytes) FILTER (file), 0) AS BIGINT) AS file_bytes, CAST(coalesce(max(length(fact_text)) FILTER (NOT file), 0) AS BIGINT) AS largest_inline FROM live""",
    "store_lookup": f"""WITH {_VERSIONS}, k AS (SELECT CAST(item_id AS VARCHAR) AS id, sha256('{{"k": ' || item_id || '}}') AS h FROM benchmark)
        SELECT id, content_hash, event_id FROM live WHERE id IN (SELECT id FROM k) OR content_hash IN (SELECT h FROM k)""",
    "event_log_trimmed": f"WITH {_KEPT} SELECT event_id, CAST(user_id AS VARCHAR) AS memory_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at FROM k WHERE event_type = 'purchase' AND strftime(ts, '%Y-%m-%dT%H:%M:%SZ') >= '2024-01-02T00:00:00Z'",
    "event_slices": f"WITH {_KEPT}, s AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // (((SELECT count(*) FROM k) + 6) // 7) AS slice FROM k) SELECT CAST(slice AS INTEGER) AS slice, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM s GROUP BY slice",
    "swap_round_trip": f"WITH {_M} SELECT id, identifier, fact_text, source, importance, content_hash, CAST(ttl AS BIGINT) AS ttl_seconds, created_at, promotion_state, 64::BIGINT AS dim, 1.0::DOUBLE AS norm FROM m",
    "payload_round_trip": f"WITH {_M}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS seq FROM m) SELECT id, identifier, importance, CAST(ttl AS BIGINT) AS ttl_seconds, promotion_candidate, 'hot' AS tier, content_hash FROM n QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1",
    "loaded_and_skipped": """WITH i AS (SELECT event_id % 3 AS batch, user_id || '-' || (event_id % 5) AS id FROM events), f AS (SELECT id, min(batch) AS batch FROM i GROUP BY id)
        SELECT CAST(batch AS INTEGER) AS batch, (SELECT count(*) FROM f WHERE f.batch = i.batch) AS loaded, count(*) - (SELECT count(*) FROM f WHERE f.batch = i.batch) AS skipped FROM i GROUP BY batch""",
    "bundle_index": """WITH r AS (SELECT n, CAST(page_id % 100 AS VARCHAR) AS path, CAST(sum(page_id) AS BIGINT) AS size_hint FROM pages, (VALUES (0), (1), (2)) AS x(n) WHERE page_id % 3 >= n GROUP BY 1, 2)
        SELECT path, 'run ' || n AS primary_file, size_hint FROM r QUALIFY n = max(n) OVER (PARTITION BY path)""",
    "hydrate_many": f"""WITH {_M}, i AS (SELECT item_id AS pos, md5((item_id % 30) || ':' || CASE WHEN item_id % 5 = 0 THEN 'none' ELSE '0' END) AS id FROM benchmark)
        SELECT pos, i.id, CASE WHEN m.id IS NOT NULL THEN sha256(coalesce(fact_text, '')) END AS h, CASE WHEN m.id IS NOT NULL THEN false END AS verified, CASE WHEN m.id IS NULL THEN 'not_found' END AS reason FROM i LEFT JOIN m ON m.id = i.id""",
    "files_of_identifier": "SELECT CAST(page_id AS VARCHAR) AS id, url AS source_uri FROM pages WHERE page_id % 3 > 0 AND page_id % 7 = 3",
    "state_counts": f"WITH {_M} SELECT CAST(position AS INTEGER) AS position, state, (SELECT count(*) FROM m WHERE promotion_state = state) AS n, next FROM (VALUES (0, 'HOT', 'READY'), (1, 'READY', 'PROMOTED'), (2, 'PROMOTED', 'ARCHIVED'), (3, 'ARCHIVED', '')) AS s(position, state, next)",
    "known_hashes": f"""WITH {_VERSIONS}, a AS (SELECT DISTINCT sha256('{{"k": ' || item_id || '}}') AS content_hash FROM benchmark) SELECT content_hash, content_hash IN (SELECT content_hash FROM live) AS known FROM a""",
    "null_hashes": """WITH d AS (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN '' WHEN event_type <> 'error' THEN md5((event_id % 97) || ':' || event_type) END AS content_hash FROM events),
        f AS (SELECT *, coalesce(content_hash, '') = '' OR row_number() OVER (PARTITION BY seq % 2, content_hash ORDER BY seq) = 1 AS kept FROM d)
        SELECT seq, content_hash FROM f WHERE kept AND (seq % 2 = 0 OR coalesce(content_hash, '') = '' OR content_hash NOT IN (SELECT content_hash FROM d WHERE seq % 2 = 0 AND content_hash IS NOT NULL))""",
    "content_hash": f"WITH {_M} SELECT id, content_hash FROM m",
    "ttl_live": f"WITH {_M} SELECT id, created_at FROM m WHERE {_LIVE}",
    "archived_filter": f"WITH {_M} SELECT id, promotion_state FROM m WHERE promotion_state <> 'ARCHIVED'",
    "by_state": f"WITH {_M} SELECT id, identifier, created_at FROM m WHERE promotion_state = 'READY'",
    "candidates": f"WITH {_M} SELECT id, identifier, promotion_state FROM m WHERE promotion_candidate = 1 AND promotion_state = 'HOT'",
    "list_by_identifier": f"WITH {_M} SELECT id, identifier, fact_text, created_at FROM m WHERE identifier = 'conv_6' AND {_LIVE} ORDER BY created_at DESC, id DESC LIMIT 3",
    "memory_count": f"WITH {_M} SELECT count(*) AS n FROM m",
    "counts_by_type": f"WITH {_M} SELECT CASE WHEN source = 'system' THEN 'file' ELSE 'fact' END AS memory_type, count(*) AS n FROM m GROUP BY 1",
    "point_lookup": f"WITH {_M} SELECT id, fact_text FROM m WHERE id = 'cfcd208495d565ef66e7dff9f98764da' UNION ALL SELECT id, fact_text FROM (SELECT * FROM m WHERE identifier = 'conv_1' AND {_LIVE} ORDER BY created_at, id LIMIT 100)",
    "content_hashes": f"WITH {_D} SELECT DISTINCT content_hash FROM d",
    "conform": "SELECT CAST(doc_id AS VARCHAR) AS id, source AS identifier, '' AS fact_text, 0.5::DOUBLE AS importance, 'hot' AS tier, 'HOT' AS promotion_state, 0::INTEGER AS promotion_candidate, '[]' AS tags, 1::INTEGER AS schema_version FROM documents",
    "hash_embedding_buckets": f"""WITH {_M}, g AS (SELECT id, md5(substr(lower(coalesce(fact_text, '')), i, 3)) AS h FROM (SELECT id, fact_text, unnest(range(1, greatest(1, length(coalesce(fact_text, '')) - 2) + 1)) AS i FROM m))
        SELECT id, CAST(('0x' || substr(h, 31, 2))::INTEGER % 64 AS INTEGER) AS bucket, CAST(sum(1 - 2 * (('0x' || substr(h, 16, 1))::INTEGER % 2)) AS BIGINT) AS signed FROM g GROUP BY 1, 2 HAVING sum(1 - 2 * (('0x' || substr(h, 16, 1))::INTEGER % 2)) <> 0""",
    "cosine_topk": f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}), 6) AS cosine FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}) DESC, vec_id LIMIT 10",
    "cosine_lists": f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}), 6) AS cosine FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}) DESC, vec_id LIMIT 10",
    "bm25_prefix": f"WITH {_M}, {_BM} SELECT id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_norm": f"WITH {_M}, {_BM} SELECT id, round(CASE WHEN min(bm25) OVER () = max(bm25) OVER () THEN 1.0 ELSE 1 - (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END, 6) AS text_score FROM bm",
    "hybrid_search": f"WITH {_M}, {_BM}, {_HY} SELECT id, identifier, rank, round(score, 6) AS score FROM r",
    "search_max_chars": f"WITH {_M}, {_BM}, {_HY}, b AS (SELECT *, 2500 - coalesce(sum(length(fact_text)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r) SELECT id, rank, substr(fact_text, 1, CAST(room AS BIGINT)) AS content FROM b WHERE room > 0",
    "context_block": f"WITH {_M}, {_BM}, {_HY} SELECT 'Relevant memories:' || chr(10) || string_agg('- ' || fact_text, chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5",
    "dedup_first": f"WITH {_D} {_FIRST}",
    "merge_dedup": f"WITH {_D}, s AS (SELECT doc_id, content_hash FROM d WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1), b AS (SELECT doc_id, content_hash FROM d WHERE doc_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1) SELECT * FROM s UNION ALL SELECT * FROM b WHERE content_hash NOT IN (SELECT content_hash FROM s)",
    "dedup_anti": f"WITH {_D} SELECT doc_id, content_hash FROM d WHERE doc_id % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM d WHERE doc_id % 2 = 0)",
    "insert_ignore": f"WITH {_SEEN} {' UNION ALL '.join(f'SELECT * FROM w{n}' for n in range(12))}",
    "event_since_offset": f"WITH {_E} SELECT seq, memory_id, occurred_at FROM e WHERE event_type = 'signup' AND occurred_at >= '2024-01-01T01:00:00Z'",
    "occurred_at_utc": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at FROM events",
    "embedding": f"""WITH {_M}, g AS (SELECT id, md5(substr(lower(coalesce(fact_text, '')), i, 3)) AS h FROM (SELECT id, fact_text, unnest(range(1, greatest(1, length(coalesce(fact_text, '')) - 2) + 1)) AS i FROM m)),
        b AS (SELECT id, ('0x' || substr(h, 31, 2))::INTEGER % 64 AS bucket, sum(1 - 2 * (('0x' || substr(h, 16, 1))::INTEGER % 2))::DOUBLE AS signed FROM g GROUP BY 1, 2)
        SELECT id, CAST(bucket AS INTEGER) AS bucket, round(CAST(CAST(signed / sqrt(sum(signed * signed) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 5) AS x FROM b WHERE signed <> 0""",
    "upsert_latest": f"WITH {_E}, l AS (SELECT seq, memory_id AS id, CASE WHEN event_type = 'view' THEN sha256(payload_json) ELSE '' END AS content_hash FROM e) SELECT seq, id, content_hash FROM l QUALIFY seq = max(seq) OVER (PARTITION BY id) AND (content_hash = '' OR seq = max(seq) OVER (PARTITION BY content_hash))",
    "event_filter": f"WITH {_E} SELECT seq, memory_id, occurred_at FROM e WHERE namespace = 'u3' AND event_type = 'purchase' AND occurred_at >= '2024-01-01T00:00:00Z' AND seq > 100",
    "event_page": f"WITH {_E} SELECT seq, memory_id, event_type FROM e WHERE seq < 700 ORDER BY seq DESC LIMIT 50",
    "event_retention": f"WITH {_E} SELECT seq, event_type FROM e ORDER BY seq DESC LIMIT 300",
    "event_trim_before": f"WITH {_E} SELECT seq, event_type FROM e WHERE seq >= 500",
    "event_replay": f"WITH {_M}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS seq FROM m) SELECT id, identifier, importance, 'HOT' AS promotion_state, content_hash FROM n QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1",
    "audit_replay": """WITH h AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS memory_id, props AS new_memory, event_type = 'error' AS dead, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'a' || user_id END AS actor FROM events),
        p AS (SELECT *, sum(CAST(dead AS INTEGER)) OVER (PARTITION BY memory_id ORDER BY created_at, id) AS epoch, sum(CAST(dead AS INTEGER)) OVER (PARTITION BY memory_id) AS final FROM h)
        SELECT memory_id, coalesce(actor, 'imported') AS identifier, new_memory AS fact_text, created_at FROM p WHERE epoch = final AND NOT dead AND trim(new_memory) <> '' QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, id DESC) = 1""",
    "snapshot_id": f"WITH {_D} SELECT sha256(string_agg(content_hash, '' ORDER BY content_hash)) AS digest FROM ({_FIRST})",
    "hygiene_stats": "SELECT count(*) AS total, count(*) AS inline_count, 0::BIGINT AS file_count, CAST(sum(length(text)) AS BIGINT) AS inline_chars, 0::BIGINT AS file_bytes, max(length(text)) AS largest_inline FROM documents",
    "hygiene_warnings": f"WITH {_WARN} SELECT * FROM w",
    "hygiene_counts": f"WITH {_WARN} SELECT severity, count(*) AS n FROM w GROUP BY 1",
    "lifecycle_validate": f"WITH {_M} SELECT id, promotion_state, {_TO} AS to_state, (promotion_state, {_TO}) IN (('HOT', 'READY'), ('READY', 'PROMOTED'), ('PROMOTED', 'ARCHIVED')) AS valid FROM m",
    "profile_compact": f"WITH {_D} SELECT id, identifier, 'fact' AS memory_type, length(fact_text) AS text_chars FROM d",
    "profile_agent": f"WITH {_D} SELECT id, CASE WHEN length(fact_text) > 4096 THEN substr(fact_text, 1, 4096) || '…' ELSE fact_text END AS content, length(fact_text) > 4096 AS truncated FROM d",
    "agent_truncate": "SELECT doc_id, md5(CASE WHEN length(text) > 4096 THEN substr(text, 1, 4096) || '…' ELSE text END) AS h FROM documents",
    "all_rows": f"WITH {_M} SELECT id, identifier, fact_text, source, promotion_candidate FROM m",
    "replay_events": f"WITH {_E} SELECT seq, memory_id, event_type, occurred_at FROM e WHERE seq > 700",
    "key_order": "SELECT key, min(event_id) AS first_line, CAST(arg_min(place, event_id) AS INTEGER) AS place, count(*) AS n FROM (SELECT event_id, unnest(json_keys(props)) AS key, unnest(range(0, len(json_keys(props)))) AS place FROM events) GROUP BY key",
    "stored_vectors": "SELECT vec_id, vec_id % 7 > 2 AND vec_id % 3 <> 0 AND vec_id % 5 <> 0 AND len(embedding) = 64 AS ok FROM embeddings",
    "hygiene_findings": """SELECT 'growth' AS category, 'info' AS severity, CAST(NULL AS VARCHAR) AS subject, count(*) AS amount FROM pages HAVING count(*) > 1000
        UNION ALL SELECT 'attachment_growth', 'info', NULL, count(*) FROM pages HAVING count(*) > 100
        UNION ALL SELECT 'missing_backing_file', CASE WHEN page_id % 2 = 1 THEN 'error' ELSE 'warn' END, CAST(page_id AS VARCHAR), NULL FROM pages WHERE page_id % 4 <> 1
        UNION ALL SELECT 'stale_bundle', 'warn', 'b/' || page_id, NULL FROM pages WHERE page_id % 6 = 0 AND page_id % 9 = 0""",
    "jsonl_inspect": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "jsonl_summary": "SELECT count(*) AS rows, count(*) FILTER (NOT json_valid(props)) AS invalid FROM events WHERE trim(props) <> ''",
    "resolve_uri": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '/data/pages/' || page_id END AS uri FROM pages",
    "file_backed_scan": "SELECT CAST(page_id AS VARCHAR) AS id, url AS source_uri, CAST(strlen(html) AS BIGINT) AS byte_length FROM pages WHERE page_id % 3 > 0",
    "missing_files": "SELECT CAST(page_id AS VARCHAR) AS id, url AS uri FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 > 0)",
    "durable_facts": r"SELECT conv_id, turn, substr(text, 1, 1000) AS fact, 0.6::DOUBLE AS importance FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) WHERE regexp_matches(text, '(?i)(^|[ .,])(the|der|que|la)([ .,]|$)')",
    "durable_cues": r"SELECT conv_id, turn, substr(text, 1, 1000) AS fact, 0.6::DOUBLE AS importance FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'From now on, ' || coalesce(text, '') ELSE text END AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) WHERE regexp_matches(text, '(?i)\b(actually|remember that|from now on|don''?t|always|never|prefer)\b')",
    "turn_rows": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, '') AS fact_text, CASE role WHEN 'user' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS importance, 'turn' AS source FROM conversations WHERE role IN ('user', 'assistant')",
    "hydrate_order": f"WITH {_M} SELECT item_id AS pos, md5(item_id || ':0') AS id, fact_text FROM benchmark LEFT JOIN m ON m.id = md5(item_id || ':0')",
    "mirrored_writes": "SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'memory' ELSE 'other' END AS target, CASE event_type WHEN 'click' THEN 0.9::DOUBLE WHEN 'view' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS importance, CASE WHEN event_type = 'error' THEN 1::BIGINT END AS ttl_seconds FROM events",
    "hydrate_inline": f"WITH {_M} SELECT id, sha256(coalesce(fact_text, '')) AS h, false AS verified FROM m",
    "file_hash": "SELECT page_id, sha256('page_' || page_id || coalesce(':' || url, '') || ':0' || coalesce(':' || strlen(html), '') || ':' || coalesce(sha256(html), '')) AS content_hash FROM pages",
    "vector_round_trip": "SELECT vec_id, len(v) AS dim, v[1] AS first, v[-1] AS last, list_min(v) AS least, list_max(v) AS most FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "lifecycle_apply": f"""WITH {_E}, v AS (SELECT memory_id AS id, min(seq) AS seq FROM e GROUP BY 1),
u AS (SELECT memory_id AS id, seq, CASE event_type WHEN 'purchase' THEN 'READY' WHEN 'signup' THEN 'PROMOTED' END AS state, CASE WHEN event_type = 'error' THEN 1 END AS candidate, occurred_at FROM e),
l AS (SELECT v.id, arg_max(state, u.seq) FILTER (state IS NOT NULL) AS state, arg_max(candidate, u.seq) FILTER (candidate IS NOT NULL) AS candidate, arg_max(occurred_at, u.seq) AS latest FROM v JOIN u ON u.id = v.id AND u.seq > v.seq GROUP BY v.id)
SELECT v.id, v.seq, coalesce(state, 'HOT') AS promotion_state, coalesce(candidate, 0) AS promotion_candidate, latest AS updated_at FROM v LEFT JOIN l ON l.id = v.id""",
}
