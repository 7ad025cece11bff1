"""SQL for Porter's algorithm with the usual amendments, to check stems by.

Every step is one query over distinct words (w) with their counts (n).
"""

from __future__ import annotations

from collections.abc import Mapping

from themeforge.functions.porter import _IRREGULAR_WORDS, _STEP2, _STEP3, _STEP4


def _cut(w: str, k: int) -> str:
    return f"left({w}, length({w}) - {k})"


def _shape(w: str) -> str:
    """A ``v`` per vowel and a ``c`` per consonant; y is a vowel after a consonant."""
    return (
        f"list_reduce(list_concat([''], string_split({w}, '')), lambda a, c: a || "
        "CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"
    )


def _measure(w: str) -> str:
    return f"len(regexp_extract_all({_shape(w)}, 'vc'))"


def _ends(w: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"suffix({w}, '{s}')" for s in suffixes) + ")"


def _closed(w: str) -> str:
    """Consonant, vowel, consonant at the end, the last not w, x or y; or vowel, consonant alone."""
    return (
        f"({_shape(w)} = 'vc' OR (right({_shape(w)}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y')))"
    )


def _swap(w: str, rules: Mapping[str, str]) -> str:
    cases = " ".join(
        f"WHEN {_ends(w, s)} THEN CASE WHEN {_measure(_cut(w, len(s)))} > 0 "
        f"THEN {_cut(w, len(s))} || '{rules[s]}' ELSE {w} END"
        for s in sorted(rules, key=len, reverse=True)
    )
    return f"CASE {cases} ELSE {w} END"


def stem_ctes(words: str) -> str:
    """CTEs that end in ``stems`` (stem, n), from a CTE ``words`` of (token, n)."""
    second = {**dict(_STEP2), "fulli": "ful", "bli": "ble"}
    del second["abli"]
    fourth = " ".join(
        f"WHEN {_ends('w', s)} THEN CASE WHEN {_measure(_cut('w', len(s)))} > 1"
        + (f" AND {_ends(_cut('w', 3), 's', 't')}" if s == "ion" else "")
        + f" THEN {_cut('w', len(s))} ELSE w END"
        for s in sorted(_STEP4, key=len, reverse=True)
    )
    irregular = " ".join(f"WHEN '{word}' THEN '{stem}'" for word, stem in _IRREGULAR_WORDS.items())
    undone = (
        f"CASE WHEN {_ends('s', 'at', 'bl', 'iz')} THEN s || 'e' "
        f"WHEN length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND right({_shape('s')}, 1) = 'c' "
        f"THEN CASE WHEN right(s, 1) IN ('l', 's', 'z') THEN s ELSE {_cut('s', 1)} END "
        f"WHEN {_measure('s')} = 1 AND {_closed('s')} THEN s || 'e' ELSE s END"
    )
    e = _cut("w", 1)
    return f"""p0 AS (SELECT token AS w, n, CASE token {irregular} END AS fixed FROM {words}),
ps AS (SELECT w, n FROM p0 WHERE fixed IS NULL AND length(w) > 2),
p1 AS (SELECT n, CASE WHEN suffix(w, 'ies') AND length(w) = 4 THEN {_cut('w', 1)}
  WHEN {_ends('w', 'sses', 'ies')} THEN {_cut('w', 2)}
  WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_cut('w', 1)} ELSE w END AS w FROM ps),
p2 AS (SELECT n, w, CASE WHEN {_ends('w', 'ied', 'eed')} THEN NULL
  WHEN suffix(w, 'ed') AND contains({_shape(_cut('w', 2))}, 'v') THEN {_cut('w', 2)}
  WHEN suffix(w, 'ing') AND contains({_shape(_cut('w', 3))}, 'v') THEN {_cut('w', 3)} END AS s FROM p1),
p3 AS (SELECT n, CASE WHEN suffix(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_cut('w', 1)} ELSE {_cut('w', 2)} END
  WHEN suffix(w, 'eed') THEN CASE WHEN {_measure(_cut('w', 3))} > 0 THEN {_cut('w', 1)} ELSE w END
  WHEN s IS NOT NULL THEN {undone} ELSE w END AS w FROM p2),
p4 AS (SELECT n, CASE WHEN suffix(w, 'y') AND length(w) > 2 AND right({_shape(_cut('w', 1))}, 1) = 'c'
  THEN {_cut('w', 1)} || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT n, CASE WHEN suffix(w, 'alli') AND {_measure(_cut('w', 4))} > 0 THEN {_cut('w', 2)} ELSE w END AS w FROM p4),
p6 AS (SELECT n, CASE WHEN suffix(w, 'logi') THEN CASE WHEN {_measure(_cut('w', 3))} > 0 THEN {_cut('w', 1)} ELSE w END
  ELSE {_swap('w', second)} END AS w FROM p5),
p7 AS (SELECT n, {_swap('w', dict(_STEP3))} AS w FROM p6),
p8 AS (SELECT n, CASE {fourth} ELSE w END AS w FROM p7),
p9 AS (SELECT n, CASE WHEN suffix(w, 'e') AND ({_measure(e)} > 1 OR ({_measure(e)} = 1 AND NOT {_closed(e)}))
  THEN {e} ELSE w END AS w FROM p8),
stems AS (SELECT n, CASE WHEN suffix(w, 'll') AND {_measure(e)} > 1 THEN {e} ELSE w END AS stem FROM p9
  UNION ALL SELECT n, coalesce(fixed, w) FROM p0 WHERE fixed IS NOT NULL OR length(w) <= 2)"""
