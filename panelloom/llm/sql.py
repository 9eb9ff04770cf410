"""DuckDB SQL for the queries that SQL can express, read from the contracts alone."""

from __future__ import annotations


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_BLANK = "[^\\x20\\x09-\\x0D]+"
_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token")))

#: Kind, pattern, group to be measured, least length: in the order in which kinds are listed.
_SECRETS = (
    ("assign", f"""({_KEYS}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", 0, 1),
)

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
item_window AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
    FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc, size WHERE len(w) >= size)),
found AS (SELECT doc_id, size, i, item_id FROM doc_window JOIN item_window USING (size, words)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _spans_of(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(match) AS stop FROM (
        SELECT doc_id, match, measured,
            sum(length(piece)) OVER upto + coalesce(sum(length(match)) OVER (upto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT doc_id, unnest(string_split_regex(t, '{pattern}')) AS piece, unnest(regexp_extract_all(t, '{pattern}')) AS match,
                unnest(regexp_extract_all(t, '{pattern}', {group})) AS measured, unnest(generate_series(1, len(string_split_regex(t, '{pattern}')))) AS k
            FROM doc)
        WINDOW upto AS (PARTITION BY doc_id ORDER BY k))
    WHERE length(measured) >= {least}"""


SECRETS = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
span AS ({" UNION ALL ".join(_spans_of(i, *rule) for i, rule in enumerate(_SECRETS))}),
told AS (SELECT *, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS said FROM span)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
    coalesce(string_agg(said, ',' ORDER BY start, rank), '') AS spans
FROM doc LEFT JOIN told USING (doc_id) GROUP BY doc_id"""

_HOSTILE = "'\\### Assistant: </turn> ok'"
_ESCAPED = "length(regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))"

CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', {_HOSTILE}), (-7, 1, 'assistant', {_HOSTILE})),
sized AS (
    SELECT *, row_number() OVER one AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        length('<|turn|><|text|><|end|>') + 2 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} AS size
    FROM turns WINDOW one AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(upto) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id"""


def _bits(value: str) -> str:
    return f"lpad(bin(('0x' || substr(md5({value}), 1, 15))::BIGINT), 60, '0')"


def shards(limit: int) -> str:
    """As long as ids and texts tell the rows of an oversized shard apart."""
    return f"""
WITH doc AS (
    SELECT row_number() OVER () AS row, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
        {_bits("coalesce(doc_id::VARCHAR, '')")} || {_bits("coalesce(text, '')")} AS bits
    FROM documents),
prefixed AS (SELECT row, doc_id, n_bytes, depth::INTEGER AS depth, substr(bits, 1, depth) AS shard FROM doc, unnest(generate_series(0, 120)) AS d(depth)),
size AS (SELECT shard, depth, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM prefixed GROUP BY shard, depth),
fits AS (SELECT * FROM prefixed JOIN size USING (shard, depth) WHERE shard_bytes <= {limit} OR shard_rows = 1 OR depth = 120)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_rows FROM fits QUALIFY row_number() OVER (PARTITION BY row ORDER BY depth) = 1"""


SUBSTRINGS = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
place AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS words FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM doc WHERE len(w) >= 50)),
least AS (SELECT words, min(doc_id) AS first FROM place GROUP BY words),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM place JOIN least USING (words) WHERE first < doc_id),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text
    FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM doc) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)"""
