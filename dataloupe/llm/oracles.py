"""SQL for the queries of this package that SQL can express, for DuckDB."""

from __future__ import annotations

SQL: dict[str, str] = {}


def _more(state: str, cost: str, edits: str) -> str:
    """A state (seven digits of cost, then the edits so far) after further edits."""
    return f"printf('%07d', substr({state}, 1, 7)::INT + {cost}) || substr({state}, 8) || '{edits}'"


def _gone(state: str) -> str:
    return _more(state, "3", "D")


_FREE = "least(i0, i1, i3)"  # the states that a user may follow

# CRC-32 by its definition, bit by bit over the ASCII codes of "conv:turn". The repair as a recursive
# query over the turns of each conversation: for each state the least cost with its edits, in
# one text whose order is that of cost first and edits second.
SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda c: ascii(c)::BIGINT)),
      lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS hit
  FROM conversations),
damaged AS (
  SELECT conv_id, turn,
    CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) FROM hashed WHERE hit <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    left(role, 1) AS letter,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM damaged),
judged AS (
  SELECT *,
    CASE WHEN ended = '' THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
      WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(letter) OVER (PARTITION BY conv_id ORDER BY place) || letter AS pair
  FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
states AS (
  -- Seven digits of cost, then the edits so far; no state but the first before any turn.
  SELECT conv_id, 0::BIGINT AS place, '0000000' AS q0, NULL::VARCHAR AS q1, NULL::VARCHAR AS q2, NULL::VARCHAR AS q3
  FROM counted
  UNION ALL
  SELECT conv_id, place,
    {_gone("i0")},
    least({_gone("i1")}, CASE WHEN may AND letter = 's' THEN {_more("i0", "extra", "K")} END),
    least({_gone("i2")}, CASE WHEN may THEN least({_more(_FREE, "2 + extra", "R")},
      CASE WHEN letter = 'u' THEN {_more(_FREE, "extra", "K")} END) END),
    least({_gone("i3")}, CASE WHEN may THEN least({_more("i2", "2 + extra", "R")},
      CASE WHEN letter = 'a' THEN {_more("i2", "extra", "K")} END) END)
  FROM (
    SELECT s.conv_id, j.place, j.letter, j.fault IN ('-', 't') AS may, (j.fault = 't')::INT AS extra,
      s.q0 AS i0, s.q1 AS i1,
      least(s.q2, {_more("s.q0", "2", "I")}, {_more("s.q1", "2", "I")}, {_more("s.q3", "2", "I")}) AS i2,
      least(s.q3, {_more("s.q2", "2", "I")}, {_more("s.q0", "4", "II")}, {_more("s.q1", "4", "II")}) AS i3
    FROM states s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.place = s.place + 1)),
ended AS (
  SELECT c.*, least(s.q0, s.q3, {_more("s.q2", "2", "I")}, {_more("s.q1", "4", "II")}) AS best
  FROM counted c JOIN states s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.place),
edited AS (
  SELECT conv_id, step, edit,
    sum((edit <> 'I')::INT) OVER steps AS place, sum((edit <> 'D')::INT) OVER steps AS line,
    sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id) AS lines
  FROM (SELECT conv_id, unnest(range(1, length(best) - 6)) AS step, substr(best, step + 7, 1) AS edit FROM ended)
  WINDOW steps AS (PARTITION BY conv_id ORDER BY step)),
repaired AS (
  -- An odd number of lines begins with the system's; users and assistants alternate.
  SELECT e.conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN j.role WHEN (line - lines % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY step)) AS digest
  FROM edited e LEFT JOIN judged j ON e.conv_id IS NOT DISTINCT FROM j.conv_id AND e.place = j.place AND edit <> 'I'
  WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(best, 1, 7)::BIGINT, 0) AS cost,
  coalesce(substr(best, 8), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""

# ASCII letters in either case; DuckDB's own flag would also take "\u017f" for an s.
_NAME = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
# Fixed values, as in ``secret_ledger``: kind, least characters, their group, pattern.
_SECRETS = (
    ("assign", 6, 2, rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", 20, 0, r"AKIA[A-Z0-9]+"),
    ("hex", 24, 0, r"[0-9a-f]+"),
    ("pem", 1, 0, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    ("forge", 40, 0, r"gh[pousr]_[A-Za-z0-9]+"),
)


def _parts_of(rank: int, kind: str, least: int, group: int, pattern: str) -> str:
    text = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, {least} AS least, string_split_regex(text, {text}) AS gaps,
      regexp_extract_all(text, {text}) AS found, regexp_extract_all(text, {text}, {group}) AS val FROM texts"""


# Each rule's matches split a text; the lengths of the parts give the places.
SQL["op12_secret_scans"] = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, rank, kind, least, unnest(range(1, len(found) + 1)) AS k,
    unnest(found) AS found, unnest(val) AS val, unnest(gaps[:len(found)]) AS gap
  FROM ({" UNION ALL ".join(_parts_of(i, *rule) for i, rule in enumerate(_SECRETS, 1))})),
spans AS (
  SELECT r, rank, kind, ends - length(found) AS start, ends FROM (
    SELECT *, (sum(length(gap) + length(found)) OVER (PARTITION BY r, rank ORDER BY k))::BIGINT AS ends FROM parts)
  WHERE length(val) >= least),
told AS (
  SELECT r, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access,
    count(*) FILTER (rank = 3) AS n_hex,
    string_agg(kind || ':' || start || ':' || ends, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base,
    string_agg(kind || ':' || start || ':' || ends, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (r)
"""
