"""Personal data by patterns, and by bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are patterns, leftmost and non-overlapping per kind,
with a test of each match. They are the seeds of the method: the words before a seed
form lexical patterns, and every identifier-shaped token that stands in the same context
becomes an instance. Spark scores the graph of patterns and instances in rounds: a
pattern is as good as the share of its weight that good instances hold, an instance as
good as its patterns together make it likely. Tokens in the context of patterns that end
above ``CONFIDENCE``, with ``SUPPORT`` different known instances, are personal data too,
of kind ``id``.

Patterns and instances are aggregated over all documents before anything is joined, and
rounds are written to the shared folder.

Defined cases: a null or empty text has no spans; base spans always stay, spans of
different kinds may overlap; repeated rows count each time; ids of any type, null too,
are carried along; a very long text is read whole, in time linear in its length; an empty
table has no rows and no patterns; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import map_batches
from themeforge.session import stage

CONFIDENCE = 0.6
SUPPORT = 3
PRIOR = 1.0
#: Rounds end when no confidence changes by more.
STILL = 0.01
KINDS = ("email", "ip", "card", "phone", "id")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A run of local characters before an @, and a dotted domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers of at most 255; runs of digits and dots are read part by part."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = [], run.start()
        for part in run.group().split("."):
            parts.append((at, at + len(part)))
            at += len(part) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            empty = [k for k, (a, b) in enumerate(four) if a == b]
            if empty:
                i += empty[-1] + 1
                continue
            values = [text[a:b].lstrip("0") for a, b in four]
            if all(len(v) <= 3 and int(v or "0") <= 255 for v in values):
                yield four[0][0], four[3][1]
            i += 4


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base spans, in order."""
    found = [
        (a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)
    ]
    return sorted(found)


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens of 5 to 64 characters with three or more digits, outside the spans taken."""
    pos, held = 0, 0
    while first := _DIGIT.search(text, pos):
        start = first.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        pos = _TOKEN.match(text, first.start()).end()
        token = text[start:pos]
        inner = token.strip(".,;:!?()[]{}<>\"'")
        a = start + token.index(inner) if inner else start
        b = a + len(inner)
        while held < len(taken) and taken[held][2] <= a:
            held += 1
        k = held
        while k < len(taken) and taken[k][0] < b and taken[k][2] <= a:
            k += 1
        free = k == len(taken) or taken[k][0] >= b
        if free and 5 <= len(inner) <= 64 and sum(c in "0123456789" for c in inner) >= 3:
            yield a, b


def contexts(text: str, starts: list[int]) -> list[str | None]:
    """The lexical pattern of each place: the two words before it, in lower case.

    One word is a pattern too where the text has no other; none is no pattern. The words
    are found once, up to the last place.
    """
    words = [m.span() for m in _WORD.finditer(text, 0, max(starts, default=0))]
    begins = [a for a, _ in words]
    out: list[str | None] = []
    for start in starts:
        k = bisect_left(begins, start)
        # A word that goes on beyond the place ends there.
        found = [text[a : min(b, start)] for a, b in words[max(0, k - 2) : k]]
        out.append(" ".join(found).lower() or None)
    return out


_SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"
_MENTION = "array<struct<start: bigint, end: bigint, pattern: string, instance: string, seed: boolean>>"


def _read(docs: DataFrame) -> DataFrame:
    """(row, id, base, mentions) of (row, id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    mention = pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()),
        ("instance", pa.string()), ("seed", pa.bool_()),
    ]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, mentions = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                base = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                places = [(a, b, True) for a, _, b in base]
                places += [(a, b, False) for a, b in identifiers(text, base)]
                rows = []
                patterns = contexts(text, [a for a, _, _ in places])
                for (a, b, seed), pattern in zip(places, patterns):
                    if pattern:
                        rows.append({
                            "start": a, "end": b, "pattern": pattern,
                            "instance": text[a:b].lower(), "seed": seed,
                        })
                mentions.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, span), pa.array(mentions, mention)],
                ["row", "id", "base", "mentions"],
            )

    return map_batches(docs, work, f"row bigint, id {kind}, base {_SPAN}, mentions {_MENTION}")


def score_patterns(edges: DataFrame, still: float = STILL) -> DataFrame:
    """(pattern, confidence, support) from (pattern, instance, n, seed), when the scores stand still.

    A pattern's confidence is the share of its mentions, weighted by the scores of their
    instances, with one doubtful mention added; its support counts the instances that are
    more likely than not. An instance that is no seed scores 1 - product(1 - confidence).
    Confidences only grow from round to round and are below 1, so the rounds end.
    """
    weight = F.col("n") * F.col("score")
    scored, before = edges.withColumn("score", F.col("seed").cast("double")), None
    while True:
        patterns = stage(
            scored.groupBy("pattern").agg(
                (F.sum(weight) / (F.sum("n") + PRIOR)).alias("confidence"),
                F.count_if(F.col("score") >= 0.5).alias("support"),
            ),
            "patterns",
        )
        if before is not None:
            change = patterns.join(before.select("pattern", F.col("confidence").alias("was")), "pattern")
            most = change.agg(F.max(F.abs(F.col("confidence") - F.col("was"))).alias("x")).first()["x"]
            if most is None or most <= still:
                return patterns
        before = patterns
        doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))
        instances = stage(
            edges.join(patterns, "pattern").groupBy("instance").agg(
                F.when(F.bool_or("seed"), 1.0).otherwise(1 - F.exp(F.sum(doubt))).alias("score")
            ),
            "instances",
        )
        scored = edges.join(instances, "instance")


def find_personal_data(
    docs: DataFrame, id: str = "doc_id", text: str = "text", still: float = STILL,
    confidence: float = CONFIDENCE, support: int = SUPPORT,
) -> DataFrame:
    """(id, base, found) of each row: spans (start, kind, end), ``kind`` an index of ``KINDS``.

    ``base`` are the spans of the patterns, ``found`` those that the method adds.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text")
    )
    read = stage(_read(numbered), "mentions")
    mentions = read.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    # Seeds and other mentions of a value are one instance.
    edges = stage(
        mentions.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed")),
        "edges",
    )
    good = score_patterns(edges, still).filter(
        (F.col("confidence") >= confidence) & (F.col("support") >= support)
    )
    added = mentions.filter(~F.col("seed")).join(good.select("pattern"), "pattern").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(
            "start", F.lit(len(KINDS) - 1).alias("kind"), "end"
        ))).alias("found")
    )
    out = read.select("row", "id", "base").join(added, "row", "left")
    none = F.array().cast(_SPAN)
    return out.select(F.col("id").alias(id), "base", F.coalesce("found", none).alias("found"))
