"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from readsift.llm.pii import iban_pattern

ORACLES: dict[str, str] = {}

ORACLES["op3_mixing"] = r"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN text END AS text, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM s GROUP BY source
), q AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT)
            - CAST(COALESCE(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
         CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM p
), l AS (
  SELECT *, CASE WHEN 3 * source_size * rest >= remaining * w THEN CAST(remaining AS DOUBLE) / rest END AS level FROM q
), t AS (
  SELECT source, source_size,
         CASE WHEN level IS NOT NULL THEN w * max(level) OVER () ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM l
), r AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('readsift-mix:' || COALESCE(CAST(s.doc_id AS VARCHAR), 'null:' || md5(COALESCE(s.text, '')))), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r
"""


def _pii_spans(kind: str, number: int, pattern: str, keep: str, base: float, context: str, least: float) -> str:
    """Spans of one kind: pieces between the matches and the matches alternate, so their running lengths are offsets."""
    return f"""
  SELECT r, start, {number} AS k, '{kind}' || ':' || start || ':' || (start + length(m)) AS said FROM (
    SELECT r, m, gap, after,
           CAST(sum(length(gap)) OVER (PARTITION BY r ORDER BY i) + sum(length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS BIGINT) AS start,
           CASE WHEN regexp_matches(right(gap, 40) || chr(10) || left(after, 40), '(?i)(?:^|[^a-z])(?:{context})(?:[^a-z]|$)') THEN 0.2 ELSE 0.0 END AS near
    FROM (
      SELECT r, i, found[i] AS m, gaps[i] AS gap, gaps[i + 1] AS after FROM (
        SELECT r, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM (
          SELECT r, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM d
        )
      )
    )
  ) WHERE {keep} AND {base} + near >= {least}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j:
      CASE WHEN (length({_DIGITS}) - j) % 2 = 0 THEN CAST({_DIGITS}[j] AS INT)
           WHEN CAST({_DIGITS}[j] AS INT) > 4 THEN 2 * CAST({_DIGITS}[j] AS INT) - 9
           ELSE 2 * CAST({_DIGITS}[j] AS INT) END)) % 10 = 0"""
_OCTET = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(
      string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''),
      lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda c: CAST(c AS INT))),
      lambda a, x: (a * 10 + x) % 97) = 1"""

_PII = [
    _pii_spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 1.0, "mail", 0.0),
    _pii_spans("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}')", 1.0, "ip", 0.0),
    _pii_spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END", 1.0, "card", 0.0),
    _pii_spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", 1.0, "phone", 0.0),
    _pii_spans("iban", 4, iban_pattern(), f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}", 0.8, "iban|account|bank|konto|transfer", 0.7),
    _pii_spans("ssn", 5, r"[0-9]+(?:-[0-9]+)+", r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')", 0.5, "ssn|social|security|taxpayer", 0.7),
]

ORACLES["op1_pii"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_PII)}),
g AS (
  SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(said, ',' ORDER BY start, k) FILTER (k < 4) AS base, string_agg(said, ',' ORDER BY start, k) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, COALESCE(n_email, 0) AS n_email, COALESCE(n_ip, 0) AS n_ip, COALESCE(n_card, 0) AS n_card, COALESCE(n_phone, 0) AS n_phone,
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, payload_bytes, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest, payload_bytes)
"""

ORACLES["op8_substring"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)
),
f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM win JOIN f USING (h) WHERE first < doc_id),
each AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (
  SELECT e.r, count(g.j) AS n_removed, string_agg(e.word, ' ' ORDER BY e.j) FILTER (g.j IS NULL) AS t
  FROM each e LEFT JOIN gone g ON e.r = g.r AND e.j = g.j GROUP BY e.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
