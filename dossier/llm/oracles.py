"""DuckDB SQL of the operators on vectors and conversations."""

from __future__ import annotations

NEAR_VECTORS = """WITH RECURSIVE
  sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
  linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reached.a, linked.b FROM reached JOIN linked ON reached.b = linked.a),
  least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY 1), counts AS (SELECT a, count(*) AS n FROM linked GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a"""

#: CTEs up to ``crc_table``: one row, the 256 entries of the CRC-32 table by the rule of its polynomial.
CRC_TABLE = """crc_bits AS (SELECT i, 0 AS k, CAST(i AS UBIGINT) AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
  crc_table AS (SELECT list(v ORDER BY i) AS entries FROM crc_bits WHERE k = 8)"""


def crc32(key: str) -> str:
    """CRC-32 of an expression of ASCII characters, where ``entries`` of ``crc_table`` is at hand."""
    codes = f"list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS UBIGINT)))"
    return f"xor(list_reduce({codes}, lambda a, x: xor(a >> 8, entries[CAST((xor(a, x) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT))"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _edit(state: str, cost: str, letter: str, line: str = "", when: str = "TRUE") -> str:
    out = f"list_append({state}.out, {line})" if line else f"{state}.out"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'out': {out}}} END"


def repaired() -> str:
    """Forward search: the least (cost, audit) with its lines in each of four states after each turn."""
    keep, retype = (lambda s, initial: _edit(s, "paid", "K", "role || ':' || text", f"NOT forced AND initial = '{initial}'")), (lambda s, role: _edit(s, "1 + paid", "R", f"'{role}:' || text", "NOT forced"))
    insert = lambda s, role: _edit(s, "5", "I", f"'{role}:'")
    read = {
        "r0": _edit("s0", "2", "D"),
        "r1": _least(_edit("s1", "2", "D"), keep("s0", "s")),
        "r2": _least(_edit("s2", "2", "D"), *(keep(f"s{q}", "u") for q in (0, 1, 3)), *(retype(f"s{q}", "user") for q in (0, 1, 3))),
        "r3": _least(_edit("s3", "2", "D"), keep("s2", "a"), retype("s2", "assistant")),
    }
    more = f"SELECT conv_id, i, r0 AS s0, r1 AS s1, i2 AS s2, {_least('r3', insert('i2', 'assistant'))} AS s3 FROM (SELECT *, {_least('r2', *(insert(f'r{q}', 'user') for q in (0, 1, 3)))} AS i2 FROM (#))"
    start = "SELECT DISTINCT conv_id, 0 AS i, {'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])} AS r0, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, out VARCHAR[])) AS r1, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, out VARCHAR[])) AS r2, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, out VARCHAR[])) AS r3 FROM turns"
    start = start.replace("'cost': 0", "'cost': CAST(0 AS BIGINT)")
    one = f"SELECT t.conv_id, t.i, {', '.join(f'{v} AS {k}' for k, v in read.items())} FROM states JOIN turns t ON t.conv_id IS NOT DISTINCT FROM states.conv_id AND t.i = states.i + 1"
    space = r"[^\x20\x09-\x0D]"
    return f"""WITH RECURSIVE {CRC_TABLE},
  named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations, crc_table),
  damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM named WHERE fault != 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
  facts AS (SELECT *, NOT regexp_matches(text, '{space}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '({space})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
  turns AS (SELECT conv_id, i, role, text, initial, blank OR again AS forced, CASE WHEN cut THEN 5 ELSE 0 END AS paid FROM facts),
  states AS ({more.replace('(#)', f'({start})')} UNION ALL {more.replace('(#)', f'({one})')}),
  ended AS (SELECT conv_id, {_least('s0', 's3')} AS best FROM states QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT again AND NOT blank) AS truncated,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM facts GROUP BY 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN ended ON c.conv_id IS NOT DISTINCT FROM ended.conv_id"""


PREFIX_TRIE = f"""WITH RECURSIVE {CRC_TABLE},
  own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  cut AS (SELECT c, turns, CAST({crc32('CAST(c AS VARCHAR)')} % 9 AS BIGINT) AS h FROM own, crc_table),
  rebuilt AS (SELECT cut.c, list_concat(coalesce(d.turns, [])[1:h], cut.turns[h + 1:]) AS turns FROM cut LEFT JOIN own d ON d.c = cut.c - cut.c % 5),
  prefixes AS (SELECT c, turns, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) t(d)),
  nodes AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(prefix[d].text) END AS n_bytes, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM prefixes GROUP BY 1, 2),
  children AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
  valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)),
  summed AS (SELECT prefix[1:a] AS prefix, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved FROM valued, unnest(range(0, d + 1)) t(a) GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM valued v JOIN summed USING (prefix) LEFT JOIN nodes p ON p.prefix = v.prefix[1:v.d - 1] AND v.d > 0"""
