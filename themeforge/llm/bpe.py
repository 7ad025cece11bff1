"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Each task splits its texts into pre-tokens. It keeps one dictionary for all of them (a
   chunk) and turns each text into numbers of that dictionary, in text order: position by
   position which word stands there.
2. The dictionary's words, each once per chunk, are dealt by a hash of the word. Whoever
   receives a word encodes it once and sends its ids back to every chunk that has it.
   A very frequent word comes once per chunk, so no key grows with its occurrences.
3. Ids and texts of a chunk meet again; ids replace the numbers, position by position.
4. Decoding joins each id with the table of token bytes (fixed size) and concatenates.

Words travel as packed lists rather than as one row per occurrence, which keeps the
shuffle below the size of the texts. A chunk ends when its dictionary has
``CHUNK_WORDS`` words or its texts ``CHUNK_TOKENS`` pre-tokens, so memory is bounded
whatever the input. A chunk's rows come from one task, whose input must come in the
same order if it is run again (a scan of files does).

Defined cases: a null text is an empty text with no ids; special tokens are ordinary
text; repeated rows are encoded each time; ids of any type, null too, are carried along;
very long texts are encoded whole, one to a chunk; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import broadcast_value, map_batches

CHUNK_WORDS = 500_000
CHUNK_TOKENS = 8_000_000
GROUP_TOKENS = 65_536
LIBRARY_CHARS = 200
CACHE_WORDS = 500_000


@cache
def _classes() -> dict[str, str]:
    r"""\p{L}, \p{N} and white space as ranges for the inside of a character class."""
    kinds = {"L": [], "N": []}
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in kinds:
            ranges = kinds[kind]
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    shown = {k: "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in v) for k, v in kinds.items()}
    # The code points with the Unicode property White_Space.
    space = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return {r"\p{L}": shown["L"], r"\p{N}": shown["N"], r"\s": space}


@cache
def splitter(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes spelled out, as ``re`` runs it fast."""
    out, inside, i = [], False, 0
    classes = _classes()
    while i < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, i)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            i += len(name)
            continue
        if pattern.startswith(r"\S", i) and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out))


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the neighbouring pair of lowest rank is merged until none is left.

    A heap of pairs over linked parts keeps very long pieces at n log n.
    """
    n = len(piece)
    ends = list(range(1, n + 1))  # end of the part that begins here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and ends[i] < n:
            stop = ends[ends[i]]
            rank = ranks.get(piece[i:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != stop:
            continue
        ends[i], ends[middle] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def piece_encoder(pattern: str, ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Encodes one pre-token; long ones, which the library's pattern may not survive, by ``merge``."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ordinary = library.encode_ordinary

    def encode(piece: str) -> list[int]:
        return ordinary(piece) if len(piece) <= LIBRARY_CHARS else merge(piece.encode(), ranks)

    return encode


# ---- packing -------------------------------------------------------------------------------


def _compress(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(raw)


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") for p in parts) + b"".join(parts)


def _parts(raw: bytes, n: int) -> list[bytes]:
    out, at = [], 4 * n
    for k in range(n):
        size = int.from_bytes(raw[4 * k : 4 * k + 4], "little")
        out.append(raw[at : at + size])
        at += size
    return out


SMALL = 240


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, small ones favoured.

    A number below ``SMALL`` is one byte; of others that byte holds the uppermost part, or
    255 where this does not fit, and three lower bytes lie in streams of their own. Each
    stream is compressed by itself, close to the entropy of its bytes.
    """
    small = numbers < SMALL
    rest = (numbers[~small] - SMALL).astype("<u4")
    upper = rest >> 16
    first = np.where(small, numbers, 0).astype(np.uint8)
    first[~small] = SMALL + np.minimum(upper, 255 - SMALL)
    wide = upper >= 255 - SMALL
    lower = [rest & 0xFF, rest >> 8 & 0xFF]
    streams = [first.tobytes(), *[x.astype(np.uint8).tobytes() for x in lower], rest[wide].tobytes()]
    return _join(*map(_compress, streams))


def _unpack(blob: bytes) -> np.ndarray:
    streams = [zstandard.ZstdDecompressor().decompress(x) for x in _parts(blob, 4)]
    first, low, middle = (np.frombuffer(x, np.uint8) for x in streams[:3])
    out = first.astype(np.uint32)
    large = first >= SMALL
    rest = low.astype(np.uint32) | middle.astype(np.uint32) << 8 | (out[large] - SMALL) << 16
    rest[first[large] == 255] = np.frombuffer(streams[3], "<u4")
    out[large] = rest + SMALL
    return out


# ---- the three passes ----------------------------------------------------------------------

Fields = tuple[tuple[str, str, pa.DataType], ...]
WORDS, TEXTS = 0, 1


def _row(kind: str) -> str:
    return f"ids array<{kind}>, chunk string, bucket int, kind tinyint, payload binary"


_NAMES = ["ids", "chunk", "bucket", "kind", "payload"]


def _chunks(docs: DataFrame, pattern: str, buckets: int, kind: str) -> DataFrame:
    """Pass 1: rows of several texts as numbers, and of the words of a chunk by bucket.

    Names and buckets depend on the task's place and input alone, so that a task that runs
    again after a loss gives the same rows to the same receivers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).findall
        part = TaskContext.get().partitionId()
        words: defaultdict[str, int] = defaultdict(count().__next__)
        done = tokens = sent = 0

        def row(ids: pa.Array, bucket: int, what: int, payload: bytes) -> pa.RecordBatch:
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [listed, pa.array([f"{part}-{done}"], pa.string()), pa.array([bucket], pa.int32()),
                 pa.array([what], pa.int8()), pa.array([payload], pa.binary())], _NAMES,
            )

        def texts(ids: pa.Array, group: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sent
            sent += 1
            counts = np.fromiter(map(len, group), np.uint32, len(group))
            payload = _join(_pack(counts), _pack(np.concatenate(group)))
            return row(ids, (part * 31 + sent) % buckets, TEXTS, payload)

        def dictionary(none: pa.Array) -> Iterator[pa.RecordBatch]:
            """The words by bucket, in the order of their numbers."""
            dealt: dict[int, list[tuple[bytes, int]]] = {}
            for word, number in words.items():
                raw = word.encode()
                dealt.setdefault(zlib.crc32(raw) % buckets, []).append((raw, number))
            for bucket, own in dealt.items():
                sizes = np.fromiter((len(raw) for raw, _ in own), np.uint32, len(own))
                numbers = np.fromiter((number for _, number in own), np.uint32, len(own))
                joined = _compress(b"".join(raw for raw, _ in own))
                payload = _join(joined, _pack(sizes), _pack(np.diff(numbers, prepend=np.uint32(0))))
                yield row(none, bucket, WORDS, payload)

        none = None
        for batch in batches:
            ids, group, start, held = batch.column(0), [], 0, 0
            none = ids.slice(0, 0)
            for i, text in enumerate(batch.column(1)):
                found = find(text.as_py() or "")
                group.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                held += len(found)
                full = len(words) >= CHUNK_WORDS or tokens + held >= CHUNK_TOKENS
                if full or held >= GROUP_TOKENS or i + 1 == batch.num_rows:
                    yield texts(ids.slice(start, len(group)), group)
                    tokens, group, start, held = tokens + held, [], i + 1, 0
                if full:
                    yield from dictionary(none)
                    words = defaultdict(count().__next__)
                    done, tokens = done + 1, 0
        if words:
            yield from dictionary(none)

    return map_batches(docs, work, _row(kind))


def _encode_words(dealt: DataFrame, encoder: Callable[[], Callable], kind: str) -> DataFrame:
    """Pass 2: each word of a bucket is encoded once; texts pass through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        known: dict[bytes, bytes] = {}

        def ids_of(word: bytes) -> bytes:
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
            return ids

        for batch in batches:
            payload = []
            for what, blob in zip(batch.column(3).to_pylist(), batch.column(4)):
                raw = blob.as_py()
                if what == WORDS:
                    joined, sizes, order = _parts(raw, 3)
                    joined = zstandard.ZstdDecompressor().decompress(joined)
                    ends = np.cumsum(_unpack(sizes), dtype=np.int64).tolist()
                    found = [ids_of(joined[a:b]) for a, b in zip([0, *ends], ends)]
                    lens = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                    raw = _join(_pack(lens), _pack(np.frombuffer(b"".join(found), "<u4")), order)
                payload.append(raw)
            yield batch.set_column(4, "payload", pa.array(payload, pa.binary()))

    return map_batches(dealt, work, _row(kind))


def _assemble(met: DataFrame, finish: Callable, fields: Fields, kind: str) -> DataFrame:
    """Pass 3: ids in place of numbers; ``finish()(ids)`` gives the output columns of one text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = finish()
        chunk, parts, table = None, [], None
        for batch in batches:
            names, kinds = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i, (name, what) in enumerate(zip(names, kinds)):
                if name != chunk:
                    chunk, parts, table = name, [], None
                raw = batch.column(4)[i].as_py()
                if what == WORDS:
                    parts.append([_unpack(x) for x in _parts(raw, 3)])
                    continue
                if table is None:
                    table, parts = _by_number(parts), []
                starts, lens, flat = table
                counts, numbers = (_unpack(x) for x in _parts(raw, 2))
                n = lens[numbers]
                ends = np.cumsum(n)
                place = np.repeat(starts[numbers] - ends + n, n) + np.arange(n.sum())
                ids = flat[place]
                upto = np.concatenate(([0], ends))[np.cumsum(counts, dtype=np.int64)].tolist()
                rows = [make(ids[a:b]) for a, b in zip([0, *upto], upto)]
                own = batch.column(0).slice(i, 1).flatten()
                columns = [pa.array([r[k] for r in rows], f[2]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([own, *columns], ["id", *[f[0] for f in fields]])

    return map_batches(met, work, ", ".join([f"id {kind}", *[f"{f[0]} {f[1]}" for f in fields]]))


def _by_number(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and ids by the chunk's word numbers."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    lens = np.concatenate([p[0] for p in parts]).astype(np.int64)
    flat = np.concatenate([p[1] for p in parts])
    order = np.concatenate([np.cumsum(p[2], dtype=np.int64) for p in parts])
    starts = np.cumsum(lens) - lens
    by_start, by_len = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    by_start[order], by_len[order] = starts, lens
    return by_start, by_len, flat


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: bytes by id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for raw, rank in ranks.items():
        table[rank] = raw
    return table


def _whole() -> Callable:
    return lambda ids: (ids.tolist(),)


ID_LISTS: Fields = (("ids", "array<bigint>", pa.list_(pa.int64())),)


def encode(
    docs: DataFrame, path: str, pattern: str, finish: Callable[[], Callable] = _whole,
    fields: Fields = ID_LISTS, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, *fields) of each row of ``docs``; without further arguments, (id, ids).

    ``finish()`` is called once per task; what it returns turns a text's ids, an array of
    unsigned 32-bit numbers, into the values of ``fields``: (name, SQL type, Arrow type).
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The rank file has a fixed size; workers get its content, not a path.
    ranks = broadcast_value(spark, ranks_of(path))

    def encoder() -> Callable[[str], list[int]]:
        return piece_encoder(pattern, ranks.value)

    rows = _chunks(slim, pattern, buckets, kind)
    dealt = rows.repartition(buckets, "bucket")
    encoded = _encode_words(dealt, encoder, kind)
    met = encoded.repartition("chunk").sortWithinPartitions("chunk", "kind")
    return _assemble(met, finish, fields, kind).withColumnRenamed("id", id)


DIGESTS: Fields = (
    ("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()),
    ("decoded_sha256", "string", pa.string()),
)


def encode_and_decode(
    docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    shared = broadcast_value(docs.sparkSession, token_bytes(ranks_of(path)))

    def finish() -> Callable:
        table = shared.value.__getitem__

        def digests(ids: np.ndarray) -> tuple[int, str, str]:
            decoded = b"".join(map(table, ids.tolist()))
            return (
                len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(decoded).hexdigest(),
            )

        return digests

    return encode(docs, path, pattern, finish, DIGESTS, id, text)


def decode(tokens: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of each row of (id, ids): the bytes of the ids, joined and read as UTF-8."""
    shared = broadcast_value(tokens.sparkSession, token_bytes(ranks_of(path)))
    slim = tokens.select(F.col(id).alias("id"), F.col(ids).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.__getitem__
        for batch in batches:
            texts = [
                b"".join(map(table, row.as_py() or ())).decode("utf-8", "replace") for row in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = slim.schema["id"].dataType.simpleString()
    return map_batches(slim, work, f"id {kind}, text string").withColumnRenamed("id", id)
