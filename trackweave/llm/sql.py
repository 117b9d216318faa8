"""DuckDB SQL of those queries of this folder that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII expression, bit by bit."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(ch)::BIGINT for ch in string_split({text}, '')]), lambda c, b: {step}), 4294967295)"


def _next(state: str, ahead: str, role: str, cls: str) -> str:
    """The cheapest way on from one state of a row, without an insertion before it."""
    keeps = f"s.cls = '{cls}'" if state != "start" else "s.cls IN ('s', 'u')"
    kept = f"CASE WHEN s.cls = 's' THEN b.sys ELSE b.{ahead} END" if state == "start" else f"b.{ahead}"
    way = lambda edit, cost, then, line: (
        f"{{'c': ({then}).c + {cost}, 'e': '{edit}' || ({then}).e, 't': list_concat({line}, ({then}).t)}}")
    more = "CASE WHEN s.kind = 'cut' THEN 5 ELSE 0 END"
    ways = [
        way("D", "2", f"b.{state}", "[]::VARCHAR[]"),
        f"CASE WHEN s.kind NOT IN ('blank', 'duplicate') AND {keeps} THEN {way('K', more, kept, '[s.role || chr(58) || s.text]')} END",
        f"CASE WHEN s.kind NOT IN ('blank', 'duplicate') THEN {way('R', f'1 + {more}', f'b.{ahead}', f'[{role!r} || chr(58) || s.text]')} END"]
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _inserted(state: str, ahead: str, role: str) -> str:
    """That, or an insertion first."""
    return (f"list_sort([n.{state}, {{'c': n.{ahead}.c + 5, 'e': 'I' || n.{ahead}.e, 't': list_concat([{role + ':'!r}], n.{ahead}.t)}}])[1] AS {state}")


STATES = {"start": ("usr", "user", "u"), "sys": ("usr", "user", "u"), "usr": ("ast", "assistant", "a"), "ast": ("usr", "user", "u")}
NEVER = "{'c': 1000000000::BIGINT, 'e': '', 't': []::VARCHAR[]}"
DONE = "{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}"
REPAIR = f"""
WITH RECURSIVE original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(conv_id::VARCHAR, ' ') || chr(58) || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM original WHERE fault <> 0),
numbered AS (
  SELECT *, substr(role, 1, 1) AS cls,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || chr(58) || role || text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged),
s AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'cut' ELSE 'sound' END AS kind,
         lag(cls) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank,
         count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'cut') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || cls NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM s GROUP BY conv_id),
b AS (
  SELECT conv_id, n AS i, {DONE} AS start, {NEVER} AS sys, {{'c': 5::BIGINT, 'e': 'I', 't': ['assistant:']}} AS usr, {DONE} AS ast FROM counts
  UNION ALL
  SELECT conv_id, i, {", ".join(_inserted(k, *v[:2]) for k, v in STATES.items())} FROM (
    SELECT b.conv_id, b.i - 1 AS i, {", ".join(f"{_next(k, *v)} AS {k}" for k, v in STATES.items())}
    FROM b JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i) n)
SELECT o.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
       coalesce(b.start.c, 0)::BIGINT AS cost, coalesce(b.start.e, '') AS audit, sha256(coalesce(array_to_string(b.start.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0
"""
TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'d': md5(length(coalesce(role, '')) || chr(58) || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))}}
                       ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || chr(58) || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {crc32("conv_id::VARCHAR")} % 6 AS h FROM own),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h], h.turns[h + 1:]) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
prefixes AS (
  SELECT conv_id, len(turns) AS whole, d, turns[1:d] AS key, CASE WHEN d > 0 THEN turns[1:d - 1] END AS up, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS size
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = d), '')) AS ends_sha256
  FROM prefixes GROUP BY key, d),
children AS (SELECT up AS key, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
told AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
above AS (SELECT key, d, size, n, n_children, unnest(range(d + 1)) AS upto FROM told),
sums AS (SELECT key[1:upto] AS key, sum((n - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY 1)
SELECT t.conv_id, t.d::BIGINT AS depth, u.conv_id AS parent_conv_id, t.n::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s USING (key) LEFT JOIN told u ON u.key = t.up
"""
