"""What the conversation operators return, as SQL of first principles."""

from __future__ import annotations

#: CRC-32 of short ASCII texts: its table from the polynomial, then byte by byte.
_CRC = """bits(i, k, c) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def trie_sql(group: int = 100, heads: int = 6) -> str:
    return f"""
WITH RECURSIVE {_CRC},
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, length(text) AS size, length(role) || ':' || role || text AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS k FROM said),
conv AS (SELECT conv_id, conv_id - conv_id % {group} AS base, {_crc("CAST(conv_id AS VARCHAR)")} % {heads} AS h FROM (SELECT DISTINCT conv_id FROM said), crc_table),
turns AS (
    SELECT c.conv_id, 0 AS later, o.k, o.said, o.size FROM conv c JOIN own o ON o.conv_id = c.base AND o.k <= c.h
    UNION ALL SELECT c.conv_id, 1, o.k, o.said, o.size FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
placed AS (SELECT conv_id, size, row_number() OVER w AS depth, list(md5(said)) OVER w AS prefix FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY later, k)),
member AS (SELECT conv_id, depth, prefix, size FROM placed UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]), 0 FROM conv),
long AS (SELECT conv_id, max(depth) AS d FROM member GROUP BY conv_id),
node AS (
    SELECT prefix, any_value(m.depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE m.depth = l.d), '') AS ends
    FROM member m JOIN long l USING (conv_id) GROUP BY prefix),
below AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(b.n, 0) AS n_children FROM node n LEFT JOIN below b USING (prefix)),
tree AS (
    SELECT prefix[1:a] AS prefix, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_node) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN tree t ON t.prefix = n.prefix LEFT JOIN full_node p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]"""


def _way(state: str, cost: str, letter: str, line: str) -> str:
    """A way on from a state: its cost, audit and repaired lines."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': list_concat({state}.t, {line})}} END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _inserted(n: str) -> str:
    """After any inserts."""
    to_user = [_way(x, "5", "I", "['user:']") for x in (f"{n}.w0", f"{n}.ws", f"{n}.wa")]
    to_answer = [_way(f"{n}.wu", "5", "I", "['assistant:']"), *(_way(x, "10", "II", "['user:', 'assistant:']") for x in (f"{n}.w0", f"{n}.ws"))]
    return f"{n}.w0 AS w0, {n}.ws AS ws, {_least(f'{n}.wu', *to_user)} AS wu, {_least(f'{n}.wa', *to_answer)} AS wa"


def repair_sql() -> str:
    stays = "s.fault NOT IN ('blank', 'duplicate')"
    more = "CASE WHEN s.fault = 'truncated' THEN 5 ELSE 0 END"
    line = "[s.role || ':' || s.text]"

    def edited(before: list[str], role: str | None, name: str) -> str:
        """From the states before, by keeping or reroling the row; or by deleting it."""
        ways = [_way(f"v.{name}", "2", "D", "CAST([] AS VARCHAR[])")]
        for x in before:
            if role:
                ways.append(f"CASE WHEN {stays} THEN {_way(f'v.{x}', f'1 + {more}', 'R', f"['{role}:' || s.text]")} END")
            first = {"ws": "s", "wu": "u", "wa": "a"}[name]
            ways.append(f"CASE WHEN {stays} AND left(s.role, 1) = '{first}' THEN {_way(f'v.{x}', more, 'K', line)} END")
        return _least(*ways)

    return f"""
WITH RECURSIVE {_CRC},
read AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
harmed AS (SELECT conv_id, turn, role, text, {_crc("key")} % 20 AS harm FROM read, crc_table),
rows_after AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
    FROM harmed WHERE harm <> 0),
placed AS (
    SELECT *, row_number() OVER w AS n, left(lag(role) OVER w, 1) || left(role, 1) AS pair, lag(role) OVER w IS NOT NULL AS has_pair,
        regexp_extract(text, '[^\\x20\\x09-\\x0D]([\\x20\\x09-\\x0D]*)$') AS ending
    FROM rows_after WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
fault AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN left(ending, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
conv AS (SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
seq AS (SELECT c.id, f.* FROM fault f JOIN conv c ON c.conv_id IS NOT DISTINCT FROM f.conv_id),
scan(id, n, w0, ws, wu, wa) AS (
    SELECT id, CAST(0 AS BIGINT), w0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR[])), {_way("w0", "5", "I", "['user:']")}, {_way("w0", "10", "II", "['user:', 'assistant:']")}
    FROM (SELECT id, {{'c': CAST(0 AS INTEGER), 'a': '', 't': CAST([] AS VARCHAR[])}} AS w0 FROM conv)
    UNION ALL
    SELECT e.id, e.n, {_inserted("e")} FROM (
        SELECT v.id, s.n, {_way("v.w0", "2", "D", "CAST([] AS VARCHAR[])")} AS w0, {edited(["w0"], None, "ws")} AS ws, {edited(["w0", "ws", "wa"], "user", "wu")} AS wu, {edited(["wu"], "assistant", "wa")} AS wa
        FROM scan v JOIN seq s ON s.id = v.id AND s.n = v.n + 1) e),
stats AS (
    SELECT id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE has_pair AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM seq GROUP BY id),
best AS (SELECT v.id, {_least("v.w0", "v.wa")} AS x FROM scan v JOIN stats t ON t.id = v.id AND t.n = v.n)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
FROM conv c LEFT JOIN stats USING (id) LEFT JOIN best USING (id)"""
