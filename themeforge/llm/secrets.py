r"""Secret scans in DataFrame functions only.

Base kinds are three patterns, leftmost and non-overlapping per kind, with a least length:
``assign`` (a key word, a separator, a value), ``access`` (AKIA...) and ``hex``.

The method adds kind ``entropy``: candidate strings, runs of 20 or more characters of
``[A-Za-z0-9+/_-]``, are assigned the narrowest character class that holds all their
characters. A window of 20 characters slides over the candidate. The window's Shannon
entropy follows from the counts of its characters, of which each step changes two:
one character leaves, one enters. A candidate whose greatest entropy reaches the
threshold of its class is a secret, unless the allow list suppresses it. Counts enter
the entropy as integers (millionths of n * log2(n)), so that it does not depend on the
order of additions.

Single-case keys with punctuation have classes of their own, whose limits are lower
because fewer characters spell them; paths and names in one case reach the same entropy,
so the allow list tells them by their segments. A key without digits is of no class (long
words and names are not secrets); one without letters is not either.

Defined cases: a null or empty text has no spans; matches of different kinds may overlap
and all stay; a repeated row is scanned each time. Positions are code points, end
exclusive. All work is linear in the text but for the list of matches, whose prefix sums
cost n to the power 1.5; masking also reads the text once for each mask. Very long texts
are scanned whole; an empty table gives no rows; columns of any name are kept by ``redact``
and not read by ``find_secrets``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in Java and RE2 spelling.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{12,}"  # greedy runs: the same matches as AKIA[A-Z0-9]+ of 16 or more
HEX = "[0-9a-f]{32,}"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
BLOCK = 256

#: Class, the characters that a candidate of the class may have, what it must have, and the
#: least entropy in bits. The first class that fits counts.
CLASSES = (
    ("hex", "^[0-9a-f]+$", ("[0-9]", "[a-f]"), 3.0),
    ("alphanumeric", "^[A-Za-z0-9]+$", ("[0-9]", "[A-Za-z]"), 3.5),
    ("lower", "^[a-z0-9+/_-]+$", ("[0-9]", "[a-z]"), 3.0),
    ("upper", "^[A-Z0-9+/_-]+$", ("[0-9]", "[A-Z]"), 3.2),
    ("base64", "^[A-Za-z0-9+/_-]+$", ("[0-9]", "[a-z]", "[A-Z]"), 3.75),
)


def _names(vowel: str, consonant: str, letter: str) -> str:
    """Paths and names: segments that are words or abbreviations with up to two digits, or
    one or two digits, padded counters, years or dates. Each text fits in one way only."""
    segment = (
        f"(({consonant}*{vowel}{letter}*|{consonant}{{1,3}})[0-9]{{0,2}}"
        "|[0-9]{1,2}|0[0-9]{2,5}|(19|20)[0-9]{2}([01][0-9][0-3][0-9])?)"
    )
    return f"^[+/_-]*{segment}([+/_-]+{segment}){{1,64}}[+/_-]*$"


#: Candidates that are no secrets: examples and placeholders, UUIDs, and paths or names.
ALLOWED = (
    "(?i)example|sample|placeholder|dummy|changeme|xxxx",
    "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    "^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$",
    "(0123456789|abcdefgh)",
    _names("[aeiouy]", "[b-df-hj-np-tv-xz]", "[a-z]"),
    _names("[AEIOUY]", "[B-DF-HJ-NP-TV-XZ]", "[A-Z]"),
)

_UNITS = 1_000_000
_N_LOG = [0] + [round(n * math.log2(n) * _UNITS) for n in range(1, WINDOW + 1)]


def starts_of(sizes: Column) -> Column:
    """For an array of numbers, the sum of those before each, in blocks."""
    last = F.greatest(F.floor((F.size(sizes) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))
    )
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    offsets = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0), lambda a, x: a + x),
    )

    def inside(block: Column, offset: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("s"), offset.alias("at"))
        step = lambda acc, x: F.struct(
            F.concat(acc["s"], F.array(acc["at"])).alias("s"), (acc["at"] + x).alias("at")
        )
        return F.aggregate(block, start, step, lambda acc: acc["s"])

    return F.flatten(F.zip_with(blocks, offsets, inside))


def _matches(df: DataFrame, name: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``<name>_m``, the non-overlapping matches, and ``<name>_p``, the pieces between them.

    There is one piece more than there are matches; pieces are null where nothing matched.
    """
    found = f"{name}_m"
    out = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return out.withColumn(f"{name}_p", F.when(F.size(found) > 0, F.split(text, pattern, -1)))


def _spans(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: array of (start, end, value) of the matches, in code points."""
    found, pieces = F.col(f"{name}_m"), F.col(f"{name}_p")
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.length(F.get(pieces, i)) + F.length(F.get(found, i)),
    )
    out = df.withColumn("_s", F.when(F.size(found) > 0, starts_of(steps)))
    spans = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.struct(
            (F.get("_s", i) + F.length(F.get(pieces, i))).alias("start"),
            (F.get("_s", i) + F.length(F.get(pieces, i)) + F.length(F.get(found, i))).alias("end"),
            F.get(found, i).alias("value"),
        ),
    )
    return out.withColumn(name, F.when(F.size(found) > 0, spans).otherwise(empty)).drop("_s")


def _long_value(match: Column) -> Column:
    """Whether an ``assign`` match has a value of 8 or more characters."""
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8


def least_n_log_n(value: Column, window: int = WINDOW) -> Column:
    """The smallest sum of n * log2(n) over the character counts of any window, in millionths.

    The entropy of a window of w characters is log2(w) - sum / w, so this window has the
    greatest. Each step changes the counts of the character that enters and of the one that
    leaves, and the sum by the difference of their terms. Null if the value is shorter.
    """
    table = F.array(*[F.lit(x).cast("bigint") for x in _N_LOG])

    def over(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            entering = F.get(codes, i)
            leaving = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            counts = F.transform(
                state["counts"],
                lambda n, j: n
                + F.when(j == entering, 1).otherwise(0) - F.when(j == leaving, 1).otherwise(0),
            )
            more, fewer = F.get(state["counts"], entering), F.get(state["counts"], leaving)
            change = F.when(entering == leaving, F.lit(0)).otherwise(
                F.get(table, more + 1) - F.get(table, more)
                + F.when(leaving >= 0, F.get(table, fewer - 1) - F.get(table, fewer)).otherwise(F.lit(0))
            )
            total = state["total"] + change
            return F.struct(
                counts.alias("counts"), total.alias("total"),
                F.when(i >= window - 1, F.least(state["least"], total)).otherwise(state["least"]).alias("least"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
            F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("least"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["least"])

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # An array of one list binds the list once for all steps.
    return F.get(F.transform(F.array(codes), over), 0)


def _limit(bits: float) -> int:
    return _N_LOG[WINDOW] - round(bits * WINDOW * _UNITS)


def _is_secret(value: Column) -> Column:
    """Whether a candidate is not allowed and reaches the entropy of its class."""
    limit = F.lit(None).cast("bigint")
    for _, only, needs, bits in reversed(CLASSES):
        fits = value.rlike(only)
        for need in needs:
            fits = fits & value.rlike(need)
        limit = F.when(fits, F.lit(_limit(bits))).otherwise(limit)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    checked = F.when(allowed | limit.isNull(), F.lit(False)).otherwise(least_n_log_n(value) <= limit)
    return F.coalesce(checked, F.lit(False))


#: Kind, pattern, and what a match must satisfy.
KINDS = (
    ("assign", ASSIGN, _long_value),
    ("access", ACCESS, None),
    ("hex", HEX, None),
    ("entropy", CANDIDATE, _is_secret),
)


def _on_value(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda span: test(span["value"])


def _ends(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"))


def _united(spans: Column) -> Column:
    """Sorted spans with those that overlap as one."""

    def step(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] <= span["start"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        )

    return F.aggregate(spans, F.array().cast("array<struct<start: int, end: int>>"), step)


def _with_masks(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span, which are apart and in order, replaced by the mask."""
    before = F.transform(spans, lambda s, i: F.struct(
        F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0)).alias("start"), s["start"].alias("end")
    ))
    kept = F.transform(before, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    rest = F.substring(text, F.try_element_at(spans, F.lit(-1))["end"] + 1, F.length(text))
    return F.concat(F.array_join(kept, mask), F.lit(mask), rest)


def _named(k: int, name: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(name).alias("name")
    )


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, assign, access, hex, entropy): arrays of (start, end, value) of each row."""
    out = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for name, pattern, _ in KINDS:
        out = _matches(out, name, pattern)
    out = out.drop("text")
    for name, _, test in KINDS:
        out = _spans(out, name).drop(f"{name}_m", f"{name}_p")
        if test:
            out = out.withColumn(name, F.filter(name, _on_value(test)))
    return out.withColumnRenamed("id", id)


def listed(*names: str) -> Column:
    """``kind:start:end`` of the spans of some kinds, by start, then kind as listed, then end."""
    rows = F.concat(*[F.transform(F.col(name), _named(k, name)) for k, name in enumerate(names)])
    return F.array_join(
        F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced by ``mask``; ``length`` is renewed.

    Spans of all kinds are found in the original text; those that overlap are one, with one
    mask, so no character of a reported span stays. Texts without secrets, null texts and
    all other columns stay as they are.
    """
    # The row travels as one value, so that no column of it can clash.
    given = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.struct(*docs.columns).alias("row"), given.alias("text"))
    for name, pattern, _ in KINDS:
        out = _matches(out, name, pattern)
    for name, _, test in KINDS:
        out = _spans(out, name).drop(f"{name}_m", f"{name}_p")
        if test:
            out = out.withColumn(name, F.filter(name, _on_value(test)))
    spans = F.flatten(F.array(*[F.transform(name, _ends) for name, _, _ in KINDS]))
    out = out.withColumn("spans", _united(F.array_sort(spans)))
    masked = F.when(F.size("spans") > 0, _with_masks(F.col("text"), F.col("spans"), mask))
    out = out.select("row", F.coalesce(masked, F.col("row")[text]).alias("now"))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("now").alias(c))
        elif c == length:
            changed = ~F.col("now").eqNullSafe(F.col("row")[text])
            renewed = F.length("now").cast(docs.schema[c].dataType)
            columns.append(F.when(changed, renewed).otherwise(F.col("row")[c]).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return out.select(*columns)
