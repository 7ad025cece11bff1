"""Language identification: script ranges, n-gram scores per word, Viterbi over the words.

A word is a run of letters and marks. Every position of a word gives one feature,
the hash of the character with its two neighbours (word edges count as neighbours).
Languages whose training text never uses the script of a word are no candidates for
it. A Viterbi pass over the words of a text, with a penalty for each change of
language, labels spans; the language with most letters is the prediction, its share
of all letters the score.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and no
spans; without any training text everything is ``und``; ties go to the language that
sorts first; a repeated row is labelled each time; texts of any length are read whole,
in pieces that end between words; an empty table gives no rows; columns of any name are
kept by ``keep_identified`` and not read by ``identify``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import broadcast_value, map_batches, slices, text_parts

UNDETERMINED = "und"
BUCKETS = 1 << 16
PIECE_CHARS = 1 << 19  # features are computed for so many characters at a time
GROUP_CHARS = 1 << 20  # and labels found for so many
EXCLUDED = -1e4  # score of a word in a language that does not use its script
MAX_LANGUAGES = 1000

# First and last code point of the letters of a script (Unicode blocks).
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF),
    ("burmese", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
)
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, part of a word, a letter, number of the script."""
    size = 0x110000
    lower = np.arange(size, dtype=np.uint32)
    word, letter = np.zeros(size, bool), np.zeros(size, bool)
    for cp in range(size):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            word[cp], letter[cp] = True, kind == "L"
            small = chr(cp).lower()
            if len(small) == 1:
                lower[cp] = ord(small)
    script = np.zeros(size, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return lower, word, letter, script


def _pieces(text: str, most: int = PIECE_CHARS) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text, cut only between words."""
    if len(text) <= most:
        yield 0, text
        return
    word, start = _tables()[1], 0
    while start < len(text):
        end = min(start + most, len(text))
        while end < len(text) and word[ord(text[end])]:
            end += 1
        yield start, text[start:end]
        start = end


class Words:
    """The words of several texts: features, letters, places."""

    def __init__(self, texts: list[str]):
        lower, is_word, is_letter, script = _tables()
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = is_word[chars]
        at = np.flatnonzero(inside)
        if not len(at):
            self.n = 0
            return
        first = np.concatenate(([True], np.diff(at) > 1))
        begin = np.flatnonzero(first)
        last = np.concatenate((first[1:], [True]))
        c = lower[chars[at]].astype(np.uint64)
        before = np.where(first, 0, np.concatenate(([0], c[:-1])).astype(np.uint64))
        after = np.where(last, 0, np.concatenate((c[1:], [0])).astype(np.uint64))
        mixed = (before * np.uint64(0x9E3779B1) + c) * np.uint64(0x85EBCA77) + after
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        self.features = (mixed >> np.uint64(48)).astype(np.int64)
        self.begin, self.n = begin, len(begin)
        self.size = np.diff(np.append(begin, len(at)))
        self.letters = np.add.reduceat(is_letter[chars[at]].astype(np.int64), begin)
        self.script = script[chars[at[begin]]].astype(np.int64)
        self.text = np.searchsorted(starts, at[begin], side="right") - 1
        self.start = at[begin] - starts[self.text]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Count features and scripts per language over all rows with a language.

    The counts are summed by Spark. What reaches the driver has at most
    ``BUCKETS + len(SCRIPTS)`` rows for each of at most ``MAX_LANGUAGES`` languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in text_parts(whole, 1, GROUP_CHARS)):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in dict.fromkeys(langs):
                own = [t for n, t in zip(langs, texts) if n == name]
                sums = found.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for a, b in slices(own, PIECE_CHARS):
                    pieces = own[a:b] if b - a > 1 else [p for _, p in _pieces(own[a])]
                    for group in ([pieces] if b - a > 1 else [[p] for p in pieces]):
                        words = Words(group)
                        if words.n:
                            sums[:BUCKETS] += np.bincount(words.features, minlength=BUCKETS)
                            sums[BUCKETS:] += np.bincount(
                                words.script, words.letters, len(SCRIPTS)
                            ).astype(np.int64)
        for name, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()),
                 pa.array(sums[at], pa.int64())], ["lang", "bucket", "n"],
            )

    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counts = map_batches(labelled, count, "lang string, bucket long, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model is meant for {MAX_LANGUAGES} at most")
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    rows = np.array([langs.index(x) for x in table.column("lang").to_pylist()], np.int64)
    sums[table.column("bucket").to_numpy(), rows] = table.column("n").to_numpy()
    features, scripts = sums[:BUCKETS], sums[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
    known = share >= 0.001
    known[~known.any(1)] = True  # a script that nobody was trained on excludes nobody
    smooth = 0.5
    weights = np.log((features + smooth) / (features.sum(0, keepdims=True) + smooth * BUCKETS))
    return {"langs": langs, "weights": weights.astype(np.float32), "known": known}


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; ``counts`` says how many words each text has.

    Where no other label gains more than half the penalty over the best constant label in
    any stretch, that label is optimal: k stretches of other labels gain k halves at most,
    and cost k - 1 changes at least. Such a text needs no pass.
    """
    labels = np.zeros(len(scores), np.int64)
    texts = np.flatnonzero(counts)
    sizes, n_labels = counts[texts], scores.shape[1]
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(scores, starts)
    constant = total.argmax(1)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    labels[:] = constant[text_of]
    gain = scores - scores[np.arange(len(scores)), labels][:, None]
    spread = 2 * (np.abs(gain).sum() + 1.0)
    open_texts = np.zeros(len(texts), bool)
    for k in range(n_labels):
        running = np.cumsum(gain[:, k])
        before = np.concatenate(([0.0], running[:-1]))
        lowest = np.minimum.accumulate(before - text_of * spread) + text_of * spread
        best = np.maximum.reduceat(running - lowest, starts)
        open_texts |= best > penalty / 2 - 1e-3
    todo = np.flatnonzero(open_texts)
    if not len(todo):
        return labels
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    first, length = starts[todo], sizes[todo]
    value = np.zeros((len(todo), n_labels))
    switched = np.zeros((len(scores), n_labels), bool)
    source = np.zeros(len(scores), np.int64)
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    for t in range(length[0]):
        n = active[t]
        at, now = first[:n] + t, value[:n]
        if t:
            top = now.max(1, keepdims=True)
            source[at] = now.argmax(1)
            switched[at] = now < top - penalty
            now = np.maximum(now, top - penalty) - top
        value[:n] = now + scores[at]
    current = value.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = current[:n]
        if t:
            current[:n] = np.where(switched[at, current[:n]], source[at], current[:n])
    return labels


def _scored(texts: list[str | None], weights: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
    """Scores, text numbers, letters, starts and sizes of the words, some texts or a piece at a time."""
    for a, b in slices(texts, PIECE_CHARS):
        group = [t or "" for t in texts[a:b]]
        parts = [(0, group)] if b - a > 1 else [(o, [p]) for o, p in _pieces(group[0])]
        for offset, part in parts:
            w = Words(part)
            if w.n:
                score = np.add.reduceat(weights[w.features], w.begin).astype(float)
                score = np.where(known[w.script], score, EXCLUDED)
                yield score, w.text + a, w.letters, w.start + offset, w.size


def _label(texts: list[str | None], model: dict, penalty: float, with_spans: bool):
    """(language, score, spans) of each text."""
    langs, weights, known = model["langs"], model["weights"], model["known"]
    out: list[tuple[str, float, list]] = [(UNDETERMINED, 0.0, [])] * len(texts)
    if not langs:
        return out
    for a, b in slices(texts, GROUP_CHARS):
        parts = list(_scored(texts[a:b], weights, known))
        if not parts:
            continue
        score, text, letters, start, size = (np.concatenate(column) for column in zip(*parts))
        counts = np.bincount(text, minlength=b - a)
        labels = viterbi(score, counts, penalty)
        cells = np.bincount(text * len(langs) + labels, letters, (b - a) * len(langs))
        share = cells.astype(np.int64).reshape(b - a, len(langs))
        whole = share.sum(1)
        best = share.argmax(1)
        if with_spans:
            end = start + size
            edge = np.flatnonzero(np.concatenate(
                ([True], (np.diff(text) > 0) | (np.diff(labels) != 0))
            ))
            stop = np.append(edge[1:], len(text)) - 1
        spans: list[list] = [[] for _ in range(b - a)]
        if with_spans:
            for i, j in zip(edge, stop):
                spans[text[i]].append((int(start[i]), int(end[j]), langs[labels[i]]))
        for i in np.flatnonzero(whole):
            out[a + i] = (langs[best[i]], float(share[i, best[i]] / whole[i]), spans[i])
    return out


def identify(
    docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text", penalty: float = 12.0,
    with_spans: bool = True,
) -> DataFrame:
    """(id, lang_pred, score, spans) of each row; spans are (start, end, lang) in code points."""
    shared = broadcast_value(docs.sparkSession, model)
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in (part for whole in batches for part in text_parts(whole, 1, GROUP_CHARS)):
            found = _label(batch.column(1).to_pylist(), shared.value, penalty, with_spans)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found], span),
                ],
                ["id", "lang_pred", "score", "spans"],
            )

    out = map_batches(
        slim, work,
        f"id {kind}, lang_pred string, score double, "
        "spans array<struct<start: bigint, end: bigint, lang: string>>",
    )
    return out.withColumnRenamed("id", id)


def keep_identified(
    docs: DataFrame, model: dict, min_score: float = 1 / 3, text: str = "text", penalty: float = 12.0
) -> DataFrame:
    """The rows, unchanged, whose language is known and holds ``min_score`` of their letters."""
    shared = broadcast_value(docs.sparkSession, model)
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_parts(whole, place, GROUP_CHARS)):
            found = _label(batch.column(place).to_pylist(), shared.value, penalty, False)
            keep = [lang != UNDETERMINED and score >= min_score for lang, score, _ in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, work, docs.schema)


def in_fold(key: str, fold: int = 1, folds: int = 3) -> Column:
    """Whether crc32 of the key as text falls in a fold; a null key falls in none."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
