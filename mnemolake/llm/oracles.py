"""DuckDB SQL for the training-data queries that SQL can express, written from their contracts rather than from the operators."""

from __future__ import annotations

import hashlib
import re

from mnemolake.llm.license_texts import LONG_TEXTS, NOTICES, TEXTS

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM w),
g AS (SELECT *, cap * after <= (total - before) * weight AS filled FROM f),
t AS (SELECT *, CASE WHEN filled THEN cap ELSE weight * (total - (SELECT coalesce(sum(cap), 0) FROM g WHERE filled)) / (SELECT sum(weight) FROM g WHERE NOT filled) END AS target,
             greatest(1, least(1024, coalesce((SELECT min(source_size) // 256 FROM g WHERE source_size > 0), 1))) AS block FROM g),
q AS (SELECT rank, target, unnest(range(1, CAST(2 * ceil(source_size / block) AS BIGINT) + 1)) AS seat FROM t),
won AS (SELECT rank, seat FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, rank, seat) AS place FROM q)
        WHERE place <= (SELECT floor(max(total) / max(block)) FROM t)),
h AS (SELECT t.*, (SELECT count(*) FROM won WHERE won.rank = t.rank) AS held, CAST(ceil(source_size / block) AS BIGINT) AS blocks FROM t),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN blocks = 0 THEN 0 ELSE size * (held // blocks) + greatest(0, least(start + size, (held % blocks) * block) - start) END AS BIGINT) AS taken,
       CAST(block AS BIGINT) AS block
FROM o JOIN h ON o.source IS NOT DISTINCT FROM h.source
"""

_ESCAPED = r"replace(replace(replace(replace({}, '\', '\b'), '<turn>', '\o'), '</turn>', '\c'), '###', '\h')"
CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(6 + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + 1 + length({_ESCAPED.format("text")}) + 8) AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?ua([ut]a)*') AS valid,
       CAST(CASE WHEN length(regexp_extract(roles, '^(s?(u(a([ut]a)*[ut]?)?)?)?')) < n_turns THEN length(regexp_extract(roles, '^(s?(u(a([ut]a)*[ut]?)?)?)?')) END AS INTEGER) AS first_bad_turn
FROM g
"""

DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM p),
x AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
o AS (SELECT row, i, v.n, item FROM (SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM x) y JOIN v ON y.n = v.n AND y.words = v.words),
hit AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM o) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM o) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""


#: The rules of the canonical form for engines whose lines end at \n and that can't look behind: what is before a word is kept.
_CLAIM = r"(?m)^[-;/#* \t\r]*(copyright[: \t]*(©|\(c\)|[{\[<0-9])|\(c\)[ \t]*[{\[<0-9]|©|all rights reserved)[^\n]*$"
_WORDS = {
    "licenc": "licens", "sub-?licen[sc]": "sublicens", "non-infringement": "noninfringement", "non-commercial": "noncommercial", "organisation": "organization", "recognise": "recognize",
    "acknowledgement": "acknowledgment", "favour": "favor", "whilst": "while", "copyright owner": "copyright holder", "https:": "http:",
}


def _rules() -> list[tuple[str, str]]:
    rules = []
    for word, one in _WORDS.items():
        if word == "whilst":
            # what follows is kept too, so the next one may lack its border: once more
            rules += [(rf"(^|[^a-z0-9]){word}($|[^a-z0-9])", rf"\1{one}\2")] * 2
        else:
            rules.append((rf"(^|[^a-z0-9]){word}", rf"\1{one}"))
    return rules


def canonical(text: str) -> str:
    """The canonical form of a licence text, one string at a time."""
    text = re.sub(_CLAIM, "", text.translate({c: c + 32 for c in range(65, 91)}))
    for pattern, one in _rules():
        text = re.sub(pattern, one, text)
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))


def license_sql() -> str:
    def values(known: tuple[tuple[str, str], ...]) -> str:
        rows: dict[str, str] = {}
        for name, text in known:
            rows.setdefault(hashlib.sha256(canonical(text).encode()).hexdigest(), name)
        return ", ".join(f"('{d}', '{n}')" for d, n in rows.items())

    def form(column: str) -> str:
        out = f"regexp_replace(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLAIM}', '', 'g')"
        for pattern, one in _rules():
            out = f"regexp_replace({out}, '{pattern}', '{one}', 'g')"
        return f"sha256(array_to_string(regexp_extract_all({out}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), ' '))"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT row, name FROM (SELECT row, {form("line")} AS digest FROM l WHERE regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licen[cs]e|released under')) x
      JOIN (VALUES {values(NOTICES)}) AS k(known, name) ON digest = known),
a AS (SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(DISTINCT name) AS n_notices FROM n GROUP BY row),
e AS (SELECT row, doc_id, {form("text")} AS digest FROM d)
SELECT doc_id, digest, k.name AS license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM e LEFT JOIN a USING (row) LEFT JOIN (VALUES {values(TEXTS + LONG_TEXTS)}) AS k(known, name) ON digest = known
"""


def resampling_sql(buckets: int = 10_000) -> str:
    """crc32 of each distinct word by its table, a byte at a time."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH c AS MATERIALIZED (SELECT {table}::BIGINT[] AS crc),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
b AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
dw AS MATERIALIZED (SELECT row, unnest(w) AS word FROM d), bw AS MATERIALIZED (SELECT unnest(w) AS word FROM b),
v AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
                               lambda a, x: xor(crc[(xor(a, x) & 255) + 1], a >> 8)), 4294967295::BIGINT) % {buckets} AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw) u, c),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {buckets})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {buckets})::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY row),
y AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN x USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r USING (row)
"""


_SCALED = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, {_SCALED} AS q FROM embeddings WHERE {_FINITE}),
s AS (SELECT a.row, a.vec_id AS query_id, b.vec_id, b.row AS other, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * coalesce(b.q[i], 0))) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.row <> b.row)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) x WHERE rank <= 5
"""


def centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, {_SCALED} AS q FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {k}) x)",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT row, c, d FROM (
            SELECT row, c, d, row_number() OVER (PARTITION BY row ORDER BY d, c) AS place
            FROM (SELECT v.row, c{n}.c, CAST(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.q[i] - c{n}.q[i]) * (v.q[i] - c{n}.q[i]))) AS BIGINT) AS d FROM v, c{n}) y) z WHERE place = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(1, {dims} + 1)) AS i FROM a{n} JOIN v USING (row)) y GROUP BY c, i),
            l{n} AS (SELECT c, list((total - (total % n + n) % n) // n ORDER BY i) AS q FROM m{n} GROUP BY c),
            c{n + 1} AS MATERIALIZED (SELECT c, coalesce(l{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN l{n} USING (c))""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN c{rounds} USING (c)
"""
