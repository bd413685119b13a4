"""Parts of the DuckDB oracles: common table expressions for views, vocabulary, greedy search and alignment."""

from __future__ import annotations

from spanloom.operators.views import LEXEMES, WORDS, cap

PATTERN = {"lexemes": LEXEMES, "words": WORDS, "cap3": cap(3), "cap5": cap(5)}


def view(name: str, pattern: str, table: str = "documents", key: str = "doc_id") -> str:
    """CTE ``name``: doc_id, pos, tok, n, byte_start, byte_end, id."""
    return f"""{name} AS (SELECT doc_id, pos, tok, n, byte_end - n AS byte_start, byte_end, CAST('0x' || substr(sha256(tok), 1, 8) AS BIGINT) & 2147483647 AS id FROM (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos, tok, CAST(strlen(tok) AS BIGINT) AS n, CAST(sum(strlen(tok)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS byte_end FROM (
    SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT {key} AS doc_id, regexp_extract_all(text, '{PATTERN[pattern]}') AS t FROM {table}))))"""


def aligned(name: str, left: str, right: str) -> str:
    """CTE ``name``: alignment rows of two views."""
    return f"""{name} AS (SELECT l.doc_id, l.pos AS left_index, l.id AS left_id, l.byte_start, l.byte_end, a.pos AS right_start, b.pos + 1 AS right_end, b.pos + 1 - a.pos AS covered,
  a.byte_start = l.byte_start AS starts_on, b.byte_end = l.byte_end AS ends_on
  FROM {left} l ASOF JOIN {right} a ON l.doc_id = a.doc_id AND l.byte_start >= a.byte_start ASOF JOIN {right} b ON l.doc_id = b.doc_id AND l.byte_end > b.byte_start)"""


def stats(prefix: str = "") -> str:
    return f"""count(*) AS {prefix}tokens, count(*) FILTER (starts_on AND ends_on) AS {prefix}exact, count(*) FILTER (NOT (starts_on AND ends_on)) AS {prefix}cross_or_cut,
  count(*) FILTER (NOT starts_on) AS {prefix}start_inside, count(*) FILTER (NOT ends_on) AS {prefix}end_inside, CAST(max(covered) AS BIGINT) AS {prefix}max_covered"""


VOCAB = f"""vocab AS (SELECT CAST(i AS BIGINT) AS id, printf('%02x', i) AS h FROM range(256) r(i)
  UNION ALL SELECT 255 + row_number() OVER (ORDER BY hex(encode(tok))) AS id, lower(hex(encode(tok))) AS h FROM (
    SELECT DISTINCT tok FROM (SELECT unnest(regexp_extract_all(text, '{LEXEMES}')) AS tok FROM benchmark) WHERE strlen(tok) BETWEEN 2 AND 6)),
sizes AS (SELECT DISTINCT length(h) // 2 AS k FROM vocab)"""


def greedy(name: str, source: str, vocab: str = "vocab", sizes: str = "sizes") -> str:
    """Recursive CTEs ``name`` (all steps) and ``name``_done (key, n, ids, off): greedy search of ``source`` (key, h)."""
    return f"""{name} AS (SELECT key, h, 0 AS off, CAST(0 AS BIGINT) AS n, '' AS ids FROM {source}
  UNION ALL SELECT key, h, CAST(off + max(k) AS INT), n + 1, ids || max_by(id, k) || ',' FROM (
    SELECT g.key, g.h, g.off, g.n, g.ids, s.k, v.id FROM {name} g, {sizes} s, {vocab} v WHERE v.h = substr(g.h, g.off * 2 + 1, s.k * 2) AND length(v.h) = s.k * 2 AND g.off * 2 < length(g.h))
  GROUP BY key, h, off, n, ids),
{name}_done AS (SELECT key, max(n) AS n, max_by(ids, n) AS ids, max(off) AS off, any_value(h) AS h FROM {name} GROUP BY key)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
