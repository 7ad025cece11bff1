"""Benchmark decontamination with one Aho-Corasick automaton over normalised item words.

Words are maximal runs of letters, digits and non-ASCII characters of the text with A-Z
in lower case. An item's windows are its runs of ten consecutive words, or all its words
if it has fewer. All distinct windows form one automaton over word numbers; each text is
scanned once, and every hit is mapped back to word and character offsets of the original.

Each distinct window has a number. The automaton knows windows by their number only; which
items have a window is a table that meets the numbers found in a join, so a window that
a large part of a benchmark shares is no heavier than another. The automaton is limited to
``MAX_WINDOWS`` windows. A larger benchmark is dealt by number to several automata,
which scan in turn and add to the same hits.

Defined cases: a null or empty text has no words and no hits; an item without words has no
windows; an item without an id hits words like others but is named and counted nowhere;
items that share a window are all counted; a repeated id is one item; repeated rows are
scanned each time; very long texts are scanned whole; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import broadcast_value, map_batches
from themeforge.session import stage

WINDOW_WORDS = 10
MAX_WINDOWS = 2_000_000
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Java and RE2 spelling of the same words, for windows built by Spark and for SQL.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _small(text: str) -> str:
    """A-Z in lower case; bytes know no other letters."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def item_windows(
    items: DataFrame, id: str = "item_id", text: str = "text", words: int = WINDOW_WORDS
) -> DataFrame:
    """(window, item): each window of each item, an array of words, with the item's id."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))
    listed = items.select(F.col(id).cast("string").alias("item"), found.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    return listed.select("item", "w", F.explode(starts).alias("at")).select(
        "item", F.slice("w", F.col("at"), words).alias("window")
    )


def _numbered(windows: DataFrame) -> DataFrame:
    """(window, number) of the distinct windows; staged, so that a number stays what it is."""
    distinct = windows.select("window").distinct()
    return stage(distinct.select("window", F.monotonically_increasing_id().alias("number")), "windows")


class Scanner:
    """The automaton of some (window, number) over the numbers of their words."""

    def __init__(self, windows: list[tuple[list[str], int]]):
        self.numbers: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, number in windows:
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window)
            self.automaton.add_word(key, (len(key), number))
        if windows:
            self.automaton.make_automaton()

    def scan(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first word, end, number) of every occurrence of a window."""
        if not self.numbers:
            return []
        number = self.numbers.get
        text = tuple([number(w, 0) for w in words])
        if not any(text):
            return []
        return [(end + 1 - n, end + 1, window) for end, (n, window) in self.automaton.iter(text)]


_scanners: dict[str, Scanner] = {}


def _scanner(shared) -> Scanner:
    """The automaton of a broadcast, built once in each Python worker."""
    name, windows = shared.value
    if name not in _scanners:
        _scanners.clear()
        _scanners[name] = Scanner(windows)
    return _scanners[name]


def _union(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching word ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCANNED = (
    "n_words bigint, ranges array<struct<first: bigint, end: bigint>>, "
    "spans array<struct<start: bigint, end: bigint>>, windows array<bigint>"
)


def _scan_once(docs: DataFrame, shared, first: bool) -> DataFrame:
    """One pass over ``docs`` (id, text, and after the first pass the hits so far)."""
    kind = docs.schema["id"].dataType.simpleString()
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
    types = [pa.int64(), pair("first", "end"), pair("start", "end"), pa.list_(pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                low = _small(text)
                words = WORD.findall(low)
                hits = scanner.scan(words)
                ranges = [(a, b) for a, b, _ in hits]
                found = {window for _, _, window in hits}
                if not first:
                    ranges += [(r["first"], r["end"]) for r in batch.column(3)[i].as_py()]
                    found.update(batch.column(5)[i].as_py())
                ranges = _union(ranges)
                spans = []
                if ranges:
                    place = np.array([m.span() for m in WORD.finditer(low)])
                    spans = [(int(place[a, 0]), int(place[b - 1, 1])) for a, b in ranges]
                rows.append((
                    len(words), [{"first": a, "end": b} for a, b in ranges],
                    [{"start": a, "end": b} for a, b in spans], sorted(found),
                ))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                ["id", "text", "n_words", "ranges", "spans", "windows"],
            )

    return map_batches(docs, work, f"id {kind}, text string, {SCANNED}")


def _automata(docs: DataFrame, windows: DataFrame, most: int) -> list:
    """Broadcasts of at most about ``most`` windows each; empty benchmarks give one empty list."""
    spark = docs.sparkSession
    parts = max(1, -(-windows.count() // most))
    place = F.pmod(F.xxhash64("number"), F.lit(parts))
    out = []
    for k in range(parts):
        rows = windows.filter(place == k).toArrow()
        pairs = list(zip(rows.column("window").to_pylist(), rows.column("number").to_pylist()))
        out.append(broadcast_value(spark, (uuid.uuid4().hex, pairs)))
    return out


def scan(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", words: int = WINDOW_WORDS,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """(id, n_words, ranges, spans, items) of each row.

    ``ranges`` are the hit words as (first, end), ``spans`` the same in code points of the
    original text, both merged and in order; ``items`` are the sorted ids found.
    """
    held = stage(item_windows(benchmark, item, item_text, words), "item-windows")
    windows = _numbered(held)
    out = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    for k, shared in enumerate(_automata(docs, windows, max_windows)):
        out = _scan_once(out, shared, k == 0)
    found = stage(out.drop("text").withColumn("row", F.monotonically_increasing_id()), "scanned")
    named = held.filter("item IS NOT NULL").join(windows, "window").select("number", "item").distinct()
    items = found.select("row", F.explode("windows").alias("number")).join(named, "number").groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )
    whole = found.join(items, "row", "left")
    return whole.select(
        F.col("id").alias(id), "n_words", "ranges", "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", words: int = WINDOW_WORDS, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The rows of ``docs``, unchanged, in which no window of the benchmark occurs."""
    windows = _numbered(item_windows(benchmark, item, item_text, words))
    place = docs.columns.index(text)
    out = docs
    for shared in _automata(docs, windows, max_windows):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(shared)
            for batch in batches:
                clean = [
                    not scanner.scan(WORD.findall(_small(t.as_py() or "")))
                    for t in batch.column(place)
                ]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = map_batches(out, work, docs.schema)
    return out
