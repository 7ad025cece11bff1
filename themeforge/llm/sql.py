"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from themeforge.llm.decontaminate import LOWER, UPPER, WORD_PATTERN, WINDOW_WORDS
from themeforge.llm.secrets import (
    _N_LOG, _limit, ACCESS, ALLOWED, ASSIGN, CANDIDATE, CLASSES, HEX, WINDOW,
)
from themeforge.llm.trie import WORD

ORACLES: dict[str, str] = {}


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}')"


ORACLES["op2_decontamination"] = f"""
WITH items AS (
    SELECT item_id::VARCHAR AS item, {_words('text')} AS w FROM benchmark),
starts AS (
    SELECT item, w, least(len(w), {WINDOW_WORDS}) AS n,
        unnest(range(1, greatest(len(w) - {WINDOW_WORDS} + 1, 1) + 1)) AS i
    FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
places AS (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (
    SELECT doc_id, i, p.n, item FROM (
        SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) p
    JOIN windows USING (n, win)),
hit_words AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
        SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(DISTINCT item) AS n_items,
        string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


ORACLES["op1_top_k"] = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5"""

_SAID = "length({0}) + length(regexp_replace({0}, '[^<|\\\\]', '', 'g'))"
ORACLES["op7_chat"] = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum({_SAID.format('role')} + {_SAID.format('text')} + 11)::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    formatted_chars
FROM told"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class_limit(value: str) -> str:
    cases = []
    for _, only, needs, bits in CLASSES:
        tests = " AND ".join(f"regexp_matches({value}, {_quoted(p)})" for p in (only, *needs))
        cases.append(f"WHEN {tests} THEN {_limit(bits)}")
    allowed = " OR ".join(f"regexp_matches({value}, {_quoted(p)})" for p in ALLOWED)
    return f"CASE WHEN {allowed} THEN NULL {' '.join(cases)} END"


_TERMS = "[" + ", ".join(map(str, _N_LOG[1:])) + "]"
_KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))


def _found(k: int, name: str, pattern: str) -> str:
    p = _quoted(pattern)
    return f"""m_{name} AS (
    SELECT doc_id, {k} AS k, '{name}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, pieces FROM (
        SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS pieces FROM src)),
s_{name} AS (
    SELECT doc_id, k, kind, m[i] AS value,
        (list_sum(list_transform(pieces[1:i], lambda x: length(x))) +
         coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM m_{name})"""


ORACLES["op4_secrets"] = f"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{', '.join(_found(k, *kind) for k, kind in enumerate(_KINDS))},
classed AS (SELECT *, {_class_limit('value')} AS most FROM s_entropy),
scored AS (SELECT * FROM classed WHERE most IS NOT NULL AND list_min(list_transform(
    range(1, length(value) - {WINDOW} + 2),
    lambda i: list_sum(list_transform(
        map_values(list_histogram(string_split(value[i:i + {WINDOW} - 1], ''))),
        lambda n: ({_TERMS})[n::BIGINT])))) <= most),
spans AS (
    SELECT doc_id, k, kind, start, start + length(value) AS stop FROM (
        SELECT * FROM s_assign WHERE length(regexp_extract(value, {_quoted(ASSIGN)}, 2)) >= 8
        UNION ALL SELECT * FROM s_access UNION ALL SELECT * FROM s_hex
        UNION ALL SELECT doc_id, k, kind, value, start FROM scored)),
lists AS (
    SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
        count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) FILTER (k < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
    coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans
FROM src LEFT JOIN lists USING (doc_id)"""


def _crc32(digits: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit."""
    step = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    chars = f"list_transform(string_split({digits}, ''), lambda c: ascii(c)::BIGINT)"
    return (
        f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {chars}), "
        f"lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, i: {step})))"
    )


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


_FIELDS = ("doc_id", "source", "lang", "n_chars")
_UP = """SELECT {keys}, l + 1 AS l, list_transform(range(0, (len(nodes) + 2) // 3),
        lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) AS nodes
    FROM {name} WHERE len(nodes) > 1"""
_CLIMB = """SELECT c.{key}, c.l + 1 AS l, c.p // 3 AS p,
        sha256(array_to_string(list_concat(t.nodes[3 * (c.p // 3) + 1:c.p], [c.fold], t.nodes[c.p + 2:3 * (c.p // 3) + 3]), '')) AS fold,
        array_to_string(list_concat(t.nodes[3 * (c.p // 3) + 1:c.p], t.nodes[c.p + 2:3 * (c.p // 3) + 3]), '') AS sib"""
ORACLES["op11_merkle"] = f"""
WITH RECURSIVE hashed AS (
    SELECT row_number() OVER () AS k, doc_id, source,
        sha256({' || '.join(map(_field, (*_FIELDS, 'text')))}) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 2 = 0
            THEN sha256({' || '.join(map(_field, (*_FIELDS, "replace(text, chr(10), '')")))})
            ELSE sha256({' || '.join(map(_field, (*_FIELDS, 'text')))}) END AS found
    FROM documents),
placed AS (
    SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS s,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS p FROM hashed),
lower_levels AS (
    SELECT s, 0 AS l, list(leaf ORDER BY p) AS nodes FROM placed GROUP BY s
    UNION ALL {_UP.format(keys='s', name='lower_levels')}),
subroots AS (SELECT s, nodes[1] AS subroot FROM lower_levels WHERE len(nodes) = 1),
upper_levels AS (
    SELECT 0 AS t, 0 AS l, list(subroot ORDER BY s) AS nodes FROM subroots
    UNION ALL {_UP.format(keys='t', name='upper_levels')}),
inner_climb AS (
    SELECT k, s, 0 AS l, p, found AS fold, '' AS sib FROM placed
    UNION ALL {_CLIMB.format(key='k, c.s')} FROM inner_climb c JOIN lower_levels t ON t.s = c.s AND t.l = c.l
    WHERE len(t.nodes) > 1),
outer_climb AS (
    SELECT k, 0 AS l, s AS p, arg_max(fold, l) AS fold, '' AS sib FROM inner_climb GROUP BY k, s
    UNION ALL {_CLIMB.format(key='k')} FROM outer_climb c JOIN upper_levels t ON t.l = c.l
    WHERE len(t.nodes) > 1),
proofs AS (
    SELECT k, string_agg(sib, '' ORDER BY part, l) AS proof FROM (
        SELECT k, 0 AS part, l, sib FROM inner_climb UNION ALL SELECT k, 1, l, sib FROM outer_climb) GROUP BY k),
folds AS (SELECT k, arg_max(fold, l) AS folded_root FROM outer_climb GROUP BY k),
top AS (SELECT nodes[1] AS root FROM upper_levels WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (s) JOIN proofs USING (k) JOIN folds USING (k), top"""

ORACLES["op12_prefix_trie"] = f"""
WITH own AS (
    SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, s, c - c % 20 AS base, ({_crc32('c::VARCHAR')} % 4)::BIGINT AS h FROM own),
rebuilt AS (
    SELECT h.c, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s
    FROM h LEFT JOIN own b ON b.c = h.base),
inside AS (
    SELECT c, s[1:d] AS node, d, len(s) = d AS whole
    FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT node, d, min(c) AS c, count(*) AS n,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (whole), '')) AS ends,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) *
            len(regexp_extract_all(node[d].t, '{WORD}')) END AS saved
    FROM inside GROUP BY node, d),
linked AS (
    SELECT x.*, p.c AS parent FROM nodes x LEFT JOIN nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.node = x.node[1:x.d - 1]),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT node[1:a] AS node, a AS d, sum(saved) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM (
        SELECT x.node, x.saved, k.n_children, unnest(range(0, x.d + 1)) AS a
        FROM nodes x LEFT JOIN kids k ON k.d = x.d AND k.node = x.node) GROUP BY ALL)
SELECT x.c::BIGINT AS conv_id, x.d::BIGINT AS depth, x.parent::BIGINT AS parent_conv_id, x.n::BIGINT AS n_convs,
    coalesce(k.n_children, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
    b.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM linked x LEFT JOIN kids k ON k.d = x.d AND k.node = x.node JOIN below b ON b.d = x.d AND b.node = x.node"""
