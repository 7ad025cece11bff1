"""SentencePiece BPE by vectorised merge rounds, and decoding by the token-byte table.

A task cuts its texts into words: a run of spaces and what follows up to the next space.
No piece of the model reaches over such a cut (checked when the model is read; a model
with such a piece has whole texts as words), so words are encoded independently, each
distinct word once as long as it is remembered.

The words that are new in a group of texts are merged together. Their symbols lie in one
flat array. A word is first cut wherever two neighbouring characters follow each other in
no piece, since no merge can bridge such a place; the cuts are the segments. A round then

1. looks up the rank of every neighbouring pair of a segment,
2. takes the minimum of each segment,
3. merges all pairs of that rank, of overlapping ones the leftmost,
4. writes the merged symbols closely together and lets segments without a pair go.

The library merges one pair at a time, the leftmost of the best. That gives the same
symbols as long as no merge creates a pair as good as the one just merged. Step 3 looks
at the pairs that its merges create one after another; a segment where one of them is as
good (in practice runs of spaces) is finished pair by pair with a heap, in n log n.

Nothing is shuffled and nothing is kept per text but its ids: memory follows
``GROUP_CHARS`` and ``CACHE_WORDS``, and longer texts are taken in pieces that end between
words.

Defined cases: a null text is an empty one, which has the begin and end ids only;
characters without a piece become byte ids; strings that look like control pieces are
ordinary text; ``U+2581`` counts as a space, as in the library; very long texts and words
are encoded whole; repeated rows are encoded each time; ids of any type, null too, are
carried along; other columns, whatever their names, are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import broadcast_value, map_batches, slices, text_parts

SPACE = "▁"
GROUP_CHARS = 2_000_000
CACHE_WORDS = 500_000
NO_PAIR = np.iinfo(np.int32).max

# Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


@dataclass
class Model:
    """What encoding and decoding need, as arrays; its size is fixed by the vocabulary."""

    begin: int
    end: int
    of_char: np.ndarray  # code point -> symbol, -1 without a piece
    followers: np.ndarray  # sorted codes of the character pairs inside pieces
    pairs: np.ndarray  # sorted codes left * n + right of the pairs that merge
    ranks: np.ndarray  # by pair
    merged: np.ndarray  # by pair: the symbol it becomes
    size: int
    unsafe: np.ndarray  # by rank: some merge of this rank may create a pair as good
    byte_ids: np.ndarray
    spaces_cut: bool  # no piece has a space after another character
    table: list[bytes]  # bytes by id
    is_byte: np.ndarray
    is_shown: np.ndarray
    starts_with_space: np.ndarray


def read_model(path: str) -> Model:
    """The arrays of a BPE model with byte fallback that does not normalise characters."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as raw:
        proto.ParseFromString(raw.read())
    trainer, normal = proto.trainer_spec, proto.normalizer_spec
    kinds = np.array([p.type for p in proto.pieces])
    supported = (
        trainer.model_type == 2 and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
        and not normal.precompiled_charsmap and normal.add_dummy_prefix
        and not normal.remove_extra_whitespaces and normal.escape_whitespaces
        and not np.isin(kinds, (USER_DEFINED, UNUSED)).any()
    )
    if not supported:
        raise ValueError(f"{path}: only plain BPE models with byte fallback are supported")

    text = {i: p.piece for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    symbol = {t: i for i, t in text.items()}
    n = len(proto.pieces)
    of_char = np.full(0x110000, -1, np.int32)
    for t, i in symbol.items():
        if len(t) == 1:
            of_char[ord(t)] = i
    # Equal scores share a rank: the library then takes the leftmost.
    scores = sorted({-proto.pieces[i].score for i in text})
    place = {s: k for k, s in enumerate(scores)}
    rank_of = {i: place[-proto.pieces[i].score] for i in text}

    rows, followers = [], set()
    for i, t in text.items():
        followers.update((ord(a) << 21) | ord(b) for a, b in zip(t, t[1:]))
        for k in range(1, len(t)):
            a, b = symbol.get(t[:k]), symbol.get(t[k:])
            if a is not None and b is not None:
                rows.append((a * n + b, rank_of[i], i))
    rows.sort()
    codes, ranks, merged = (np.array(x, dtype=d) for x, d in zip(
        zip(*rows) if rows else ((), (), ()), (np.int64, np.int32, np.int32)
    ))
    unsafe = np.zeros(len(scores) + 1, bool)
    for code, rank, _ in rows:
        for part in (code // n, code % n):
            if len(text[part]) > 1 and rank <= rank_of[part]:
                unsafe[rank_of[part]] = True

    byte_ids = np.full(256, -1, np.int32)
    table, is_byte = [b""] * n, kinds == BYTE
    for i, p in enumerate(proto.pieces):
        if p.type == BYTE:
            value = int(p.piece[1:-1], 16)
            byte_ids[value], table[i] = i, bytes([value])
        elif p.type == NORMAL:
            table[i] = p.piece.replace(SPACE, " ").encode()
        elif p.type == UNKNOWN:
            table[i] = trainer.unk_surface.encode()
    return Model(
        trainer.bos_id, trainer.eos_id, of_char, np.array(sorted(followers), np.int64), codes, ranks,
        merged, n, unsafe, byte_ids, not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in text.values()),
        table, is_byte, np.array([bool(t) for t in table]), np.array([text.get(i, "").startswith(SPACE) for i in range(n)]),
    )


# ---- merge rounds --------------------------------------------------------------------------


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _ranks(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, symbol after merging) of pairs of symbols; ``NO_PAIR`` where they do not merge."""
    at, there = _find(model.pairs, left.astype(np.int64) * model.size + right)
    there &= (left >= 0) & (right >= 0)
    if not len(model.pairs):
        return np.full(len(left), NO_PAIR, np.int32), np.full(len(left), -1, np.int32)
    return np.where(there, model.ranks[at], NO_PAIR), np.where(there, model.merged[at], -1)


def _pairs(model: Model, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, symbol after merging) of each symbol with its right neighbour in the segment."""
    rank = np.full(len(symbols), NO_PAIR, np.int32)
    into = np.full(len(symbols), -1, np.int32)
    near = np.flatnonzero(segment[:-1] == segment[1:])
    rank[near], into[near] = _ranks(model, symbols[near], symbols[near + 1])
    return rank, into


def _out_of_turn(
    model: Model, symbols: np.ndarray, segment: np.ndarray, into: np.ndarray, rank: np.ndarray,
    chosen: np.ndarray,
) -> np.ndarray:
    """Segments in which a merge, taken from left to right, creates a pair as good as itself."""
    at = np.flatnonzero(chosen & model.unsafe[np.where(chosen, rank, -1)])
    n = len(symbols)
    # On the left neighbours are merged already, on the right not yet.
    before = np.where((at >= 2) & chosen[at - 2], into[at - 2], symbols[at - 1])
    after = np.minimum(at + 2, n - 1)
    has_left = (at >= 1) & (segment[at - 1] == segment[at])
    has_right = (at + 2 < n) & (segment[after] == segment[at])
    bad = has_left & (_ranks(model, before, into[at])[0] <= rank[at])
    bad |= has_right & (_ranks(model, into[at], symbols[after])[0] <= rank[at])
    return np.unique(segment[at[bad]])


def _finish(model: Model, symbols: list[int]) -> list[int]:
    """One segment pair by pair: the best rank, of equal ones the leftmost."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    codes, heap = model.pairs, []

    def offer(i: int) -> None:
        if i < 0 or after[i] >= n or symbols[i] < 0 or symbols[after[i]] < 0:
            return
        code = symbols[i] * model.size + symbols[after[i]]
        at = int(np.searchsorted(codes, code))
        if at < len(codes) and codes[at] == code:
            heapq.heappush(heap, (int(model.ranks[at]), i, code, int(model.merged[at])))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while heap:
        _, i, code, into = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or symbols[i] * model.size + symbols[j] != code:
            continue
        symbols[i], gone[j], after[i] = into, True, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [s for s, g in zip(symbols, gone) if not g]


def merge_rounds(model: Model, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, segments) after all merges; ``segment`` ascends."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank, into = _pairs(model, symbols, segment)
        starts = np.flatnonzero(np.diff(segment, prepend=segment[0] - 1))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(starts, append=len(symbols))
        ended = least == NO_PAIR
        chosen = (rank == np.repeat(least, sizes)) & ~np.repeat(ended, sizes)
        # Of neighbouring chosen pairs, which overlap, every second one counts.
        first = chosen & ~np.concatenate(([False], chosen[:-1]))
        places = np.arange(len(symbols))
        chosen &= (places - np.maximum.accumulate(np.where(first, places, 0))) % 2 == 0
        slow = np.isin(segment[starts], _out_of_turn(model, symbols, segment, into, rank, chosen))
        for k in np.flatnonzero(slow):
            a = starts[k]
            left = _finish(model, symbols[a : a + sizes[k]].tolist())
            done.append((np.array(left, np.int32), np.full(len(left), segment[a])))
        out = np.repeat(ended, sizes)
        if ended.any():
            done.append((symbols[out], segment[out]))
        going = ~np.repeat(ended | slow, sizes)
        chosen &= going
        symbols = np.where(chosen, into, symbols)
        keep = going & ~np.concatenate(([False], chosen[:-1]))
        symbols, segment = symbols[keep], segment[keep]
    if not done:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    symbols, segment = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(segment, kind="stable")
    return symbols[order], segment[order]


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, number of ids of each); spaces are written as ``SPACE``."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lens)
    # Characters without a piece are kept as -1 - code point.
    known = model.of_char[chars]
    symbols = np.where(known >= 0, known, -1 - chars).astype(np.int32)
    joins = (chars[:-1] << 21) | chars[1:]
    _, linked = _find(model.followers, joins)
    new = np.concatenate(([True] * min(len(chars), 1), (word[1:] != word[:-1]) | ~linked))
    segment = np.cumsum(new) - 1
    symbols, segment = merge_rounds(model, symbols, segment)
    word = word[np.flatnonzero(new)][segment] if len(segment) else segment

    bare = symbols < 0
    points = (-1 - symbols).astype(np.int64)
    n = np.where(bare, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
    ids = np.repeat(symbols, n)
    at = np.cumsum(n) - n
    for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        some = np.flatnonzero(bare & (n == size))
        for k in range(size):
            shifted = points[some] >> 6 * (size - 1 - k)
            value = shifted | lead if k == 0 else shifted & 0x3F | 0x80
            ids[at[some] + k] = model.byte_ids[value]
    return ids, np.bincount(word, n, len(words)).astype(np.int64) if len(words) else lens


class Encoder:
    """Ids of texts; remembers the words it has seen, ``CACHE_WORDS`` at most per group."""

    def __init__(self, model: Model):
        self.model = model
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if model.spaces_cut else "(?s:.+)")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.lens = self.starts = np.zeros(0, np.int64)

    def _numbers(self, text: str) -> np.ndarray:
        found = self.words.findall(text)
        number = self.number
        return np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))

    def _learn(self) -> None:
        """Encode the words that got a number since the last time."""
        if len(self.number) > len(self.lens):
            flat, lens = encode_words(self.model, list(islice(self.number, len(self.lens), None)))
            self.flat = np.concatenate((self.flat, flat))
            self.lens = np.concatenate((self.lens, lens))
            self.starts = np.cumsum(self.lens) - self.lens

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lens[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[numbers] - ends + n, n) + np.arange(n.sum())], n

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text without begin and end; texts have their spaces replaced."""
        if len(self.number) >= CACHE_WORDS:
            self._forget()
        numbers = [self._numbers(t) for t in texts]
        self._learn()
        ids, n = self._ids(np.concatenate(numbers) if numbers else np.zeros(0, np.int64))
        upto = np.concatenate(([0], np.cumsum(n)))
        at = 0
        for own in numbers:
            yield ids[upto[at] : upto[at + len(own)]]
            at += len(own)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts of about ``GROUP_CHARS`` that end between words."""
        start = 0
        while start < len(text):
            end = start + GROUP_CHARS
            if self.model.spaces_cut:
                end = text.find(SPACE, end)
                while 0 < end and text[end - 1] == SPACE:
                    end = text.find(SPACE, end + 1)
            yield text[start:] if end < 0 or end >= len(text) or not self.model.spaces_cut else text[start:end]
            if end < 0 or not self.model.spaces_cut:
                return
            start = end

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, begin and end included, as unsigned 32-bit numbers."""
        shown = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        for a, b in slices(shown, GROUP_CHARS):
            if b - a == 1 and len(shown[a]) > GROUP_CHARS:
                parts = [next(self._group([p])) for p in self._parts(shown[a])]
                found: Iterator[np.ndarray] = iter([np.concatenate(parts)])
            else:
                found = self._group(shown[a:b])
            for ids in found:
                whole = np.empty(len(ids) + 2, "<u4")
                whole[0], whole[1:-1], whole[-1] = self.model.begin, ids, self.model.end
                yield whole


# ---- decoding ------------------------------------------------------------------------------


def _byte_run(raw: bytes) -> str:
    """Bytes read as UTF-8; each byte that begins no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        i += n
    return "".join(out)


def decode_ids(model: Model, ids: np.ndarray) -> bytes:
    """The UTF-8 text of some ids; the space that encoding puts in front is left out."""
    listed = ids.tolist()
    raw = b"".join(map(model.table.__getitem__, listed))
    try:
        whole = model.is_shown[ids[1:-1]].all()
        raw.decode()
    except UnicodeDecodeError:
        whole = False
    if not whole:
        # Byte ids that form no character, or a control id among them: each run is read by itself.
        parts, run = [], b""
        for i in listed:
            if model.is_byte[i]:
                run += model.table[i]
            else:
                parts += [_byte_run(run).encode(), model.table[i]]
                run = b""
        raw = b"".join([*parts, _byte_run(run).encode()])
    first = next((i for i in listed if model.table[i]), None)
    return raw[1:] if first is not None and model.starts_with_space[first] else raw


# ---- over DataFrames -----------------------------------------------------------------------

Fields = tuple[tuple[str, str, pa.DataType], ...]
ID_LISTS: Fields = (("ids", "array<bigint>", pa.list_(pa.int64())),)
DIGESTS: Fields = (
    ("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()),
    ("decoded_sha256", "string", pa.string()),
)


def _listed(model: Model) -> Callable:
    return lambda ids: (ids.tolist(),)


def _digests(model: Model) -> Callable:
    def digests(ids: np.ndarray) -> tuple[int, str, str]:
        return (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
            hashlib.sha256(decode_ids(model, ids)).hexdigest(),
        )

    return digests


def encode(
    docs: DataFrame, path: str, finish: Callable[[Model], Callable] = _listed, fields: Fields = ID_LISTS,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, *fields) of each row; without further arguments, (id, ids) with begin and end ids."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # A vocabulary has a fixed size; workers get the arrays, not a path.
    shared = broadcast_value(docs.sparkSession, read_model(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoder, make = Encoder(model), finish(model)
        for batch in batches:
            for part in text_parts(batch, 1, GROUP_CHARS):
                rows = [make(ids) for ids in encoder.encode(part.column(1).to_pylist())]
                columns = [pa.array([r[k] for r in rows], f[2]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["id", *[f[0] for f in fields]]
                )

    kind = slim.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *[f"{f[0]} {f[1]}" for f in fields]])
    return map_batches(slim, work, schema).withColumnRenamed("id", id)


def encode_and_decode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    return encode(docs, path, _digests, DIGESTS, id, text)


def decode(tokens: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of each row of (id, ids); a null list is an empty text."""
    slim = tokens.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    shared = broadcast_value(tokens.sparkSession, read_model(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                decode_ids(shared.value, np.array(row.as_py() or (), np.int64)).decode() for row in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = slim.schema["id"].dataType.simpleString()
    return map_batches(slim, work, f"id {kind}, text string").withColumnRenamed("id", id)
