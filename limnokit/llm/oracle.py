"""DuckDB SQL for the corpus queries that SQL can state, over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')" if lower else "coalesce(text, '')"
    return f"SELECT {key}, regexp_extract_all({text}, '{pattern}') AS w FROM {table}"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substring({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {letters}), lambda c, b: {byte}), 4294967295)"


_TIE = "sha256(concat(length(role), ':', role, text))"


def _edit(old: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state after one more edit; states are cost, audit and repaired lines."""
    lines = f"list_append({old}.o, {line})" if line else f"{old}.o"
    return f"{{'c': {old}.c + {cost}, 'a': {old}.a || '{letter}', 'o': {lines}}}"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


_NEVER = "{'c': 1000000, 'a': '', 'o': CAST([] AS VARCHAR[])}"


def _if(condition: str, state: str) -> str:
    return f"CASE WHEN {condition} THEN {state} ELSE {_NEVER} END"


def _taken(to: str, letter: str, role: str, states: tuple[str, ...]) -> list[str]:
    """The row kept, or its role changed, where the order wants that role."""
    kept = [_if(f"NOT gone AND role[1] = '{letter}'", _edit(s, "more", "K", "role || ':' || text")) for s in states]
    return kept + ([_if("NOT gone", _edit(s, "more + 1", "R", f"'{role}:' || text")) for s in states] if role else [])


_INSERTED = f"""
  SELECT * EXCLUDE (s2, s3), s2, {_least("s3", _edit("s2", "5", "I", "'assistant:'"))} AS s3
  FROM (SELECT * EXCLUDE (s2), {_least("s2", *[_edit(s, "5", "I", "'user:'") for s in ("s0", "s1", "s3")])} AS s2 FROM @)
"""

TURN_REPAIR = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
kinds AS (SELECT *, {_crc32("name")} % 20 AS kind FROM named),
harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TIE}, copy) AS pos,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]') AS inside
  FROM harmed),
judged AS (
  SELECT *, CASE WHEN len(inside) = 0 THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN inside[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS broken
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (broken) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}} AS s0, {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3 FROM facts
  UNION ALL
  SELECT conv_id, nr, {_edit("s0", "2", "D")}, {_least(_edit("s1", "2", "D"), *_taken("s1", "s", "", ("s0",)))},
    {_least(_edit("s2", "2", "D"), *_taken("s2", "u", "user", ("s0", "s1", "s3")))}, {_least(_edit("s3", "2", "D"), *_taken("s3", "a", "assistant", ("s2",)))}
  FROM ({_INSERTED.replace("@", "(SELECT steps.*, judged.pos AS nr, role, text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM steps JOIN judged ON judged.conv_id IS NOT DISTINCT FROM steps.conv_id AND judged.pos = steps.pos + 1)")})),
best AS (
  SELECT conv_id, {_least("s0", "s3")} AS s
  FROM ({_INSERTED.replace("@", "(SELECT steps.* FROM steps JOIN facts ON facts.conv_id IS NOT DISTINCT FROM steps.conv_id AND steps.pos = facts.n)")}))
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost,
  coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

PREFIX_TRIE = f"""
WITH named AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, {_TIE} AS id, len(regexp_extract_all(text, '{_SPACED}')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TIE}) AS pos
  FROM named),
sizes AS (SELECT conv_id, max(pos) AS n, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - (conv_id % 20 + 20) % 20 AS head FROM own GROUP BY conv_id),
plan AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS kept FROM sizes AS c LEFT JOIN sizes AS b ON b.conv_id = c.head),
turns AS (
  SELECT conv_id, pos - h + kept AS pos, id, words FROM own JOIN plan USING (conv_id) WHERE pos > h
  UNION ALL SELECT plan.conv_id, pos, id, words FROM plan JOIN own ON own.conv_id = plan.head WHERE pos <= h),
places AS (
  SELECT conv_id, pos AS depth, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path, words FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM plan),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM places GROUP BY path, depth),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (path)),
below AS (
  SELECT left(path, 64 * up) AS path, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * words) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes) GROUP BY 1),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, arg_max(path, depth) AS path FROM places GROUP BY conv_id) GROUP BY path)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.kids AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes AS v JOIN below USING (path) LEFT JOIN ends USING (path)
LEFT JOIN nodes AS p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = left(v.path, 64 * (v.depth - 1))
"""


def _discount(n: str, k: int) -> str:
    """Discount of count ``k`` from the numbers ``n1`` to ``n4`` of counts."""
    here, above = f"{n}.n{k}", f"{n}.n{k + 1}"
    share = f"(CASE WHEN {n}.n1 + {n}.n2 > 0 THEN {n}.n1 / ({n}.n1 + 2 * {n}.n2) ELSE 0.0 END)"
    value = f"(CASE WHEN {here} > 0 THEN {k} - {k + 1} * {share} * {above} / {here} ELSE 0.0 END)"
    return f"CASE WHEN {value} > 0 AND {value} <= {k} THEN {value} ELSE 0.5 END"


def _levels(table: str, count: str) -> str:
    return "SELECT " + ", ".join(f"CAST(count(*) FILTER ({count} = {k}) AS DOUBLE) AS n{k}" for k in range(1, 5)) + f" FROM {table}"


def _cut(count: str, cuts: str) -> str:
    return f"CASE least({count}, 3) WHEN 1 THEN {cuts}.d1 WHEN 2 THEN {cuts}.d2 WHEN 3 THEN {cuts}.d3 ELSE 0.0 END"


KNESER_NEY = f"""
WITH texts AS (SELECT row_number() OVER () AS row, * FROM ({_words("(SELECT *, " + _crc32("coalesce(CAST(doc_id AS VARCHAR), '')") + " % 7 = 2 AS held_out FROM documents)", "doc_id, held_out", _SPACED, True)})),
tokens AS (SELECT row, held_out, unnest(list_append(w, ' ')) AS w, unnest(list_prepend('  ', w)) AS v FROM texts),
ones AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
twos AS (SELECT v, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY v, w),
ahead AS (SELECT w, count(*) AS c FROM twos GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM ones),
two_levels AS ({_levels("twos", "c")}), one_levels AS ({_levels("ahead", "c")}),
upper AS (SELECT {", ".join(f"{_discount('two_levels', k)} AS d{k}" for k in (1, 2, 3))} FROM two_levels),
lower_ AS (SELECT {", ".join(f"{_discount('one_levels', k)} AS d{k}" for k in (1, 2, 3))} FROM one_levels),
pairs AS (SELECT count(*) AS p FROM twos),
free AS (SELECT sum({_cut("c", "lower_")}) / any_value(p) / (any_value(n.v) + 1) AS unknown FROM ahead, lower_, pairs, n),
alone AS (SELECT w, (c - {_cut("c", "lower_")}) / p + unknown AS q FROM ahead, lower_, pairs, free),
context AS (SELECT v, sum(c) AS c, sum({_cut("c", "upper")}) / sum(c) AS gamma FROM twos, upper GROUP BY v),
scored AS (
  SELECT row, coalesce(ones.c, 0) AS c, coalesce(q, unknown) AS q, context.c AS heard, gamma, coalesce(twos.c, 0) AS joint
  FROM tokens AS t LEFT JOIN ones USING (w) LEFT JOIN alone USING (w) LEFT JOIN context USING (v) LEFT JOIN twos ON twos.v = t.v AND twos.w = t.w, free),
sums AS (
  SELECT row, count(*) AS n_tokens, count(*) FILTER (s.c > 0) AS n_known, fsum(log10((s.c + 1) / CAST(n.n + n.v + 1 AS DOUBLE))) AS base,
    fsum(log10(CASE WHEN heard IS NULL THEN q ELSE (joint - {_cut("joint", "upper")}) / heard + gamma * q END)) AS own
  FROM scored AS s, n, upper GROUP BY row)
SELECT doc_id, held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(n.n AS BIGINT) AS train_tokens,
  round(base, 6) AS base_score, round(own, 6) AS score
FROM texts JOIN sums USING (row), n
"""

KNESER_NEY_TRIPLES = f"""
WITH texts AS (SELECT row_number() OVER () AS row, * FROM ({_words("(SELECT *, " + _crc32("coalesce(CAST(doc_id AS VARCHAR), '')") + " % 7 = 2 AS held_out FROM documents)", "doc_id, held_out", _SPACED, True)})),
tokens AS (SELECT row, held_out, unnest(list_append(w, ' ')) AS w, unnest(list_prepend('  ', w)) AS v, unnest(list_concat(['   ', '  '], w)[:len(w) + 1]) AS u FROM texts),
ones AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
twos AS (SELECT v, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY v, w),
threes AS (SELECT u, v, w, count(*) AS c FROM tokens WHERE NOT held_out AND v <> '  ' GROUP BY u, v, w),
ahead AS (SELECT w, count(*) AS c FROM twos GROUP BY w),
mids AS (SELECT v, w, count(*) AS c FROM threes GROUP BY v, w UNION ALL SELECT v, w, c FROM twos WHERE v = '  '),
n AS (SELECT sum(c) AS n, count(*) AS v FROM ones),
three_levels AS ({_levels("threes", "c")}), mid_levels AS ({_levels("mids", "c")}), one_levels AS ({_levels("ahead", "c")}),
upper AS (SELECT {", ".join(f"{_discount('three_levels', k)} AS d{k}" for k in (1, 2, 3))} FROM three_levels),
middle AS (SELECT {", ".join(f"{_discount('mid_levels', k)} AS d{k}" for k in (1, 2, 3))} FROM mid_levels),
lower_ AS (SELECT {", ".join(f"{_discount('one_levels', k)} AS d{k}" for k in (1, 2, 3))} FROM one_levels),
pairs AS (SELECT count(*) AS p FROM twos),
free AS (SELECT sum({_cut("c", "lower_")}) / any_value(p) / (any_value(n.v) + 1) AS unknown FROM ahead, lower_, pairs, n),
alone AS (SELECT w, (c - {_cut("c", "lower_")}) / p + unknown AS q FROM ahead, lower_, pairs, free),
after_word AS (SELECT v, sum(c) AS c, sum({_cut("c", "middle")}) / sum(c) AS gamma FROM mids, middle GROUP BY v),
after_pair AS (SELECT u, v, sum(c) AS c, sum({_cut("c", "upper")}) / sum(c) AS gamma FROM threes, upper GROUP BY u, v),
found AS (
  SELECT row, coalesce(ones.c, 0) AS c, coalesce(q, unknown) AS q, a.c AS heard, a.gamma AS gamma, coalesce(mids.c, 0) AS joint,
    b.c AS heard_pair, b.gamma AS gamma_pair, coalesce(threes.c, 0) AS joint_pair
  FROM tokens AS t LEFT JOIN ones USING (w) LEFT JOIN alone USING (w) LEFT JOIN after_word AS a USING (v) LEFT JOIN mids ON mids.v = t.v AND mids.w = t.w
    LEFT JOIN after_pair AS b ON b.u = t.u AND b.v = t.v LEFT JOIN threes ON threes.u = t.u AND threes.v = t.v AND threes.w = t.w, free),
scored AS (SELECT * REPLACE (CASE WHEN heard IS NULL THEN q ELSE (joint - {_cut("joint", "middle")}) / heard + gamma * q END AS q) FROM found, middle),
sums AS (
  SELECT row, count(*) AS n_tokens, count(*) FILTER (s.c > 0) AS n_known, fsum(log10((s.c + 1) / CAST(n.n + n.v + 1 AS DOUBLE))) AS base,
    fsum(log10(CASE WHEN heard_pair IS NULL THEN q ELSE (joint_pair - {_cut("joint_pair", "upper")}) / heard_pair + gamma_pair * q END)) AS own
  FROM scored AS s, n, upper GROUP BY row)
SELECT doc_id, held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(n.n AS BIGINT) AS train_tokens,
  round(base, 6) AS base_score, round(own, 6) AS score
FROM texts JOIN sums USING (row), n
"""

CONTAMINATION = f"""
WITH d AS ({_words("documents", "doc_id", _ALNUM, True)}),
i AS ({_words("benchmark", "item_id", _ALNUM, True)}),
iw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM (SELECT *, least(10, len(w)) AS size FROM i WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, item_id, size, p FROM dw JOIN iw USING (size, win)),
cover AS (SELECT doc_id, count(DISTINCT nr) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + size)) AS nr FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS ({_words("documents", "doc_id", _SPACED, True)}),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
           FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM low LEFT JOIN n USING (doc_id)
"""

REPEATS = f"""
WITH d AS ({_words("documents", "doc_id", _SPACED, False)}),
win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
twice AS (SELECT win FROM win GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, nr FROM (SELECT doc_id, unnest(range(p, p + 35)) AS nr FROM win JOIN twice USING (win))),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS nr FROM d WHERE len(w) > 0),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.nr) AS kept
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.nr = word.nr WHERE gone.nr IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
