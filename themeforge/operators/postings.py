"""Term counts and weights of many documents, packed.

Documents form chunks of up to ``CHUNK_DOCS`` by the hash of their id (rows of equal id share
one), tokens form buckets by the checksums of their words. Counts are kept as encoded texts: a row has the words
of some documents of a chunk (``tokens``, as lines), the ids of these documents (``docs``), how many
words each has (``lengths``) and their words in reading order as numbers (``words``), next to columns that all of them share,
such as class and part. N-grams are counted again from these numbers wherever they are asked for, which costs less than
keeping them. Between chunks and buckets travel distinct tokens only: a chunk asks the buckets for what they
know of its tokens, and a document's entries never leave its chunk. Numbers and tokens travel
compressed (``_squeezed``), tighter than shuffles would.

Defined cases: a null text has no tokens; rows that repeat an id are counted one by one and
share one norm; a document without id counts for the vocabulary, but has no weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from themeforge.functions.text import ENGLISH_STOP_WORDS
from themeforge.session import ship_package, stage, unstage

#: The more documents a chunk has, the fewer tokens it shares with others; small tables have ``CHUNKS`` chunks.
CHUNK_DOCS = 8_000
LEAST_DOCS = 2_000
CHUNKS = 24
#: Bytes of text that are encoded at a time, and words whose n-grams are counted at a time.
PART_BYTES = 16 << 20
GRAM_WORDS = 500_000
#: Chunks are scored in so many rounds at most, each with so many chunks at least.
ROUNDS = 4
ROUND_CHUNKS = 8
_CODEC = pa.Codec("zstd", 1)


def is_packed(rows: DataFrame) -> bool:
    """Whether counts or weights are packed."""
    return "piece" in rows.columns


def bucket(token: str, buckets: Column) -> Column:
    """The bucket of a token, as ``_grams`` deals them."""
    words = F.split(token, " ")
    step = lambda seen, w: (seen * 31 + F.crc32(w.cast("binary"))) % buckets
    return F.aggregate(words, F.lit(0).cast("bigint"), step).cast("int")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def term_postings(
    docs: DataFrame, by: Sequence[str] = ("class", "part"), key: str = "doc_id", text: str = "text",
    ngram_range: tuple[int, int] = (1, 1), stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(by, chunk, piece, buckets, low, high, tokens, docs, lengths, words): ``term_counts`` of mode ``replace``, packed.

    ``piece`` numbers the rows, ``buckets`` is how many there are, ``low`` and ``high`` are the range of n.
    Rows without an id have null ``docs``.
    """
    ship_package(docs.sparkSession)
    total = docs.count()
    chunks = max(1, -(-total // min(CHUNK_DOCS, max(LEAST_DOCS, -(-total // CHUNKS)))))
    chunk = F.pmod(F.hash(key), F.lit(chunks)).alias("chunk")
    rows = docs.select(*by, chunk, key, F.lower(text).alias("_text")).repartition(chunks, key)
    # Few groups for few texts, groups of bounded size for many.
    buckets = max(min(512, 4 * chunks), chunks)
    id_type = rows.schema[key].dataType
    held = "binary" if isinstance(id_type, T.IntegralType) else f"array<{id_type.simpleString()}>"
    unwanted = [w for w in stop_words if w.isalpha()]
    low, high = ngram_range

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _parts(batch):
                found = _encoded(part, unwanted, (piece, buckets, low, high))
                piece += len(found)
                if len(found):
                    yield found

    lists = f"tokens string, docs {held}, lengths binary, words binary"
    numbers = "piece bigint, buckets int, low int, high int"
    return rows.mapInArrow(work, f"{_ddl(rows.select(*by, 'chunk'))}, {numbers}, {lists}")


def postings_stats(postings: DataFrame) -> DataFrame:
    """(bucket, token, df, tf), equal to ``token_stats`` of the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _units(pa.Table.from_batches([batch])):
                grams = _grams(rows)
                number, sizes = grams.by_bucket()
                yield pa.RecordBatch.from_arrays(
                    [number, _lines(grams.names, sizes), _ints(grams.dfs, sizes), _ints(grams.tfs, sizes)],
                    names=["bucket", "tokens", "dfs", "tfs"],
                )

    def add(table: pa.Table) -> pa.Table:
        coded = _strings(table["tokens"]).dictionary_encode()
        at, n = coded.indices.to_numpy(), len(coded.dictionary)
        sums = [_summed(at, _numbers(table[c])[0], n).astype(np.int64) for c in ("dfs", "tfs")]
        number = np.full(n, table["bucket"][0].as_py(), dtype=np.int32)
        return pa.table({"bucket": number, "token": coded.dictionary, "df": sums[0], "tf": sums[1]})

    slim = postings.select("buckets", "low", "high", "tokens", "lengths", "words")
    held = slim.mapInArrow(count, "bucket int, tokens binary, dfs binary, tfs binary")
    return held.groupBy("bucket").applyInArrow(add, "bucket int, token string, df bigint, tf bigint")


def chunk_vocabularies(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk, tokens, idfs): what each chunk has of the vocabulary (bucket, token, idf), in pieces by bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.Table.from_batches([batch])
            for rows in _units(held.take(pa.array(_order(held, ["chunk"]))), "chunk"):
                grams = _grams(rows, counted=False)
                yield _asked(rows["chunk"][0], grams.names, *grams.by_bucket())

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, sizes = _strings(left["tokens"]), _line_sizes(left["tokens"])
        place = pc.index_in(tokens, value_set=right["token"].combine_chunks())
        keep = place.is_valid().to_numpy(zero_copy_only=False)
        held = np.bincount(np.repeat(np.arange(len(left)), sizes)[keep], minlength=len(left))
        idfs = right["idf"].to_numpy()[place.drop_null().to_numpy()]
        found = pa.table({
            "chunk": left["chunk"], "tokens": _lines(tokens.filter(pa.array(keep)), held), "idfs": _floats(idfs, held),
        })
        return found.filter(pa.array(held > 0))

    slim = postings.filter(F.col("docs").isNotNull()).select(
        "chunk", "piece", "buckets", "low", "high", "tokens", "lengths", "words"
    )
    asked = slim.mapInArrow(ask, "chunk int, bucket int, tokens binary")
    known = vocabulary.select("bucket", "token", "idf").groupBy("bucket")
    return asked.groupBy("bucket").cogroup(known).applyInArrow(answer, "chunk int, tokens binary, idfs binary")


def weighed_postings(postings: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """(by, chunk, piece, buckets, tokens, dealt, dfs, at, cs, idfs, docs, norms): tokens of the vocabulary only.

    ``vocabularies`` are those of the chunks. A row has posting lists: for each token its bucket, how many
    documents have it, their places in ``docs`` and their counts. A document's weights are ln(c * idf + 1),
    ``norms`` has the L2 norm of each.
    """
    counts = postings.filter(F.col("docs").isNotNull())
    own = ("piece", "buckets", "low", "high", "tokens", "docs", "lengths", "words")
    shared = [c for c in counts.columns if c not in own]

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        known, idf = _strings(right["tokens"]), _doubles(right["idfs"])
        out, sums = [], []
        for rows in _units(left.take(pa.array(_order(left, shared))), *shared):
            grams = _grams(rows)
            place = pc.index_in(grams.names, value_set=known)
            keep = place.is_valid().to_numpy(zero_copy_only=False)
            if not keep.any():
                continue
            entries, dfs = np.repeat(keep, grams.dfs), grams.dfs[keep]
            idfs, docs, cs = idf[place.drop_null().to_numpy()], grams.doc[entries], grams.cs[entries]
            ids = _ids(rows["docs"])
            weight = np.log(cs * np.repeat(idfs, dfs) + 1)
            sums.append((ids, _summed(docs, weight * weight, len(ids))))
            sizes = np.array([len(dfs)])
            out.append([
                *[rows[c].combine_chunks().slice(0, 1) for c in shared], *[rows[c].combine_chunks().slice(0, 1) for c in ("piece", "buckets")],
                _lines(grams.names.filter(pa.array(keep)), sizes), _ints(grams.dealt[keep], sizes), _ints(dfs, sizes),
                *[_ints(v, np.array([len(v)])) for v in (docs, cs)], _floats(idfs, sizes),
                _packed_ids(ids, np.array([len(ids)]), left.schema.field("docs").type),
            ])
        if not out:
            return schema.empty_table()
        # Rows of equal id share one norm, in whatever row of the chunk they are.
        coded = pa.chunked_array([ids for ids, _s in sums]).combine_chunks().dictionary_encode()
        at = coded.indices.to_numpy()
        norms = np.sqrt(_summed(at, np.concatenate([s for _ids, s in sums]), len(coded.dictionary)))[at]
        cuts = np.cumsum([len(ids) for ids, _s in sums])[:-1]
        tables = [
            pa.Table.from_arrays([*row, _floats(held, np.array([len(held)]))], schema=schema)
            for row, held in zip(out, np.split(norms, cuts))
        ]
        return pa.concat_tables(tables)

    lists = f"{_ddl(counts.select(*shared, 'piece', 'buckets'))}, tokens binary, dealt binary, dfs binary, at binary, cs binary"
    ddl = f"{lists}, idfs binary, {_ddl(counts.select('docs'))}, norms binary"
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T.DataType.fromDDL(ddl)])
    return counts.groupBy("chunk").cogroup(vocabularies.groupBy("chunk")).applyInArrow(weigh, ddl)


def token_weights(weights: DataFrame) -> DataFrame:
    """(by, token, weight, unit): sums over the documents of a row, one row per token of it.

    ``weight`` sums the documents' weights, ``unit`` the weights after each was divided by its L2 norm.
    """
    own = ("chunk", "piece", "buckets", "tokens", "dealt", "dfs", "at", "cs", "idfs", "docs", "norms")
    by = [c for c in weights.columns if c not in own]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                names, token, _doc, weight, unit = _entries(row)
                same = [pa.repeat(row[c][0], len(names)) for c in by]
                sums = [_summed(token, v, len(names)) for v in (weight, unit)]
                yield pa.RecordBatch.from_arrays([*same, names, *map(pa.array, sums)], names=[*by, "token", "weight", "unit"])

    slim = weights.select(*by, "tokens", "dfs", "at", "cs", "idfs", "norms")
    return slim.mapInArrow(work, f"{_ddl(slim.select(*by))}, token string, weight double, unit double")


def posting_dots(
    weights: DataFrame, wide: DataFrame, blocks: int, pairs: Mapping[str, str], width: int, key: str,
    id_type: T.DataType,
) -> DataFrame:
    """(key, _block, sq_<name>, _<name>_<i>): squared norms and products with each class of a block.

    ``wide`` has (token, _block, _<name>_<i>), ``pairs`` maps a name to ``weight`` or ``unit``.
    The classes' values of a token travel once to each chunk that has it; the products are summed there,
    one class at a time. A column ``copies`` says how often the documents of a row count.
    """
    arrow_id = to_arrow_type(id_type)
    cells = [(n, f"_{n}_{i}") for n in pairs for i in range(width)]
    kinds = dict(pairs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.Table.from_batches([batch])
            for rows in _same(held.take(pa.array(_order(held, ["chunk"]))), "chunk"):
                coded = _strings(rows["tokens"]).dictionary_encode()
                first = np.unique(coded.indices.to_numpy(), return_index=True)[1]
                dealt = _numbers(rows["dealt"])[0][first]
                order = np.argsort(dealt, kind="stable")
                yield _asked(rows["chunk"][0], coded.dictionary.take(pa.array(order)), *_by_bucket(dealt[order]))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, ends = _strings(left["tokens"]), np.cumsum(_line_sizes(left["tokens"]))
        out = []
        for b in range(blocks):
            here = right.filter(pc.equal(right["_block"], b))
            values = np.array([pc.fill_null(here[c], 0.0).to_numpy() for _n, c in cells])
            place = pc.fill_null(pc.index_in(tokens, value_set=here["token"].combine_chunks()), -1).to_numpy()
            for chunk, end, size in zip(left["chunk"].to_pylist(), ends, np.diff(ends, prepend=0)):
                at = place[end - size:end]
                keep = at >= 0
                held = values[:, at[keep]]
                if held.size:
                    names = _lines(tokens.slice(end - size, size).filter(pa.array(keep)), [held.shape[1]])[0]
                    some = held[held != 0]
                    out.append((chunk, b, names.as_py(), np.packbits(held != 0).tobytes(), _floats(some, [len(some)])[0].as_py()))
        columns = zip(*out) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, met.types)], schema=met)

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = pa.chunked_array([_ids(left["docs"].slice(i, 1)) for i in range(len(left))], arrow_held(left)).combine_chunks()
        coded = ids.dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        known = [_class_values(right.filter(pc.equal(right["_block"], b)), len(cells)) for b in range(blocks)]
        squares = {name: np.zeros(n) for name in kinds}
        products = [[np.zeros(n) for _c in cells] for _b in range(blocks)]
        first = 0
        for i in range(len(left)):
            row = left.slice(i, 1)
            names, token, doc, weight, unit = _entries(row)
            size = len(_doubles(row["norms"]))
            doc, first = codes[first:first + size][doc], first + size
            copies = row["copies"][0].as_py() if "copies" in row.column_names else 1
            own = {name: (weight if kind == "weight" else unit) for name, kind in kinds.items()}
            for name in kinds:
                squares[name] += copies * _summed(doc, own[name] * own[name], n)
            for (tokens, cell_values), sums in zip(known, products):
                place = pc.fill_null(pc.index_in(names, value_set=tokens), len(tokens)).to_numpy()[token]
                for c, (name, _column) in enumerate(cells):
                    at, value = cell_values[c]
                    if len(at):
                        # The last place stands for tokens that the class does not have.
                        column = np.zeros(len(tokens) + 1)
                        column[at] = value
                        sums[c] += copies * _summed(doc, own[name] * column[place], n)
        return pa.concat_tables([
            pa.table({
                key: coded.dictionary.cast(arrow_id), "_block": pa.array(np.full(n, b, dtype=np.int32)),
                **{f"sq_{name}": squares[name] for name in kinds}, **{c: s for (_n, c), s in zip(cells, sums)},
            }) for b, sums in enumerate(products)
        ])

    def arrow_held(left: pa.Table) -> pa.DataType:
        held = left.schema.field("docs").type
        return pa.int64() if pa.types.is_binary(held) else held.value_type

    # From the plan's own rows: the number of buckets of the counts.
    buckets = weights.agg(F.max("buckets")).scalar()
    columns = wide.withColumn("_buckets", buckets.cast("bigint")).select(
        bucket("token", F.col("_buckets")).alias("bucket"), "token", "_block", *[c for _n, c in cells]
    )
    ddl = "chunk int, _block int, tokens binary, mask binary, values binary"
    met = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T.DataType.fromDDL(ddl)])
    copies = [c for c in ("copies",) if c in weights.columns]
    names = [*[f"sq_{n}" for n in kinds], *[c for _n, c in cells]]
    schema = ", ".join([f"`{key}` {id_type.simpleString()}", "_block int", *[f"`{n}` double" for n in names]])

    def summed(part: DataFrame) -> DataFrame:
        asked = part.select("chunk", "piece", "tokens", "dealt").mapInArrow(ask, "chunk int, bucket int, tokens binary")
        values = asked.groupBy("bucket").cogroup(columns.groupBy("bucket")).applyInArrow(answer, ddl)
        slim = part.select("chunk", *copies, "tokens", "dfs", "at", "cs", "idfs", "docs", "norms")
        return slim.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(multiply, schema)

    # In rounds over the chunks only a part of the weights and values is shuffled at a time.
    last = weights.agg(F.max("chunk")).first()[0]
    rounds = max(1, min(ROUNDS, ((last or 0) + 1) // ROUND_CHUNKS))
    if rounds == 1:
        return summed(weights)
    columns = stage(columns, "class-values")
    parts = [stage(summed(weights.filter(F.col("chunk") % rounds == r)), "dots") for r in range(rounds)]
    unstage(columns)
    return reduce(DataFrame.unionByName, parts)


@dataclass
class _Grams:
    """N-grams in the order of their buckets (``dealt``), and the entries of each: document and count."""

    names: pa.Array
    dealt: np.ndarray
    dfs: np.ndarray | None = None
    tfs: np.ndarray | None = None
    doc: np.ndarray | None = None
    cs: np.ndarray | None = None

    def by_bucket(self) -> tuple[pa.Array, np.ndarray]:
        return _by_bucket(self.dealt)


def _grams(rows: pa.Table, counted: bool = True) -> _Grams:
    """The n-grams of encoded texts; without ``counted`` only their names and buckets."""
    low, high, buckets = (rows[c][0].as_py() for c in ("low", "high", "buckets"))
    coded = _strings(rows["tokens"]).dictionary_encode()
    names, sizes = coded.dictionary, _line_sizes(rows["tokens"])
    words, held = _numbers(rows["words"])
    codes = coded.indices.to_numpy().astype(np.int64)[words + np.repeat(np.cumsum(sizes) - sizes, held)]
    lengths, _held = _numbers(rows["lengths"])
    n_docs = len(lengths)
    text = np.repeat(np.arange(n_docs), lengths)
    sums = np.array([crc32(w) for w in names.cast(pa.binary()).to_pylist()], dtype=np.int64)
    grams, gram_names, at, dealt = codes, names, np.arange(len(codes)), sums % buckets
    found: list[_Grams] = []
    for n in range(1, high + 1):
        if n > 1:
            at = np.flatnonzero(text[n - 1:] == text[:len(text) - n + 1])
            pairs, place = np.unique(grams[at] * len(names) + codes[at + n - 1], return_inverse=True)
            left, right = np.divmod(pairs, max(1, len(names)))
            dealt = (dealt[left] * 31 + sums[right]) % buckets
            gram_names = pc.binary_join_element_wise(gram_names.take(pa.array(left)), names.take(pa.array(right)), " ")
            grams = np.zeros(len(codes), dtype=np.int64)
            grams[at] = place
        if n < low or not len(at):
            continue
        # Every name occurs, so entries by gram are the names in their order.
        order = np.argsort(dealt.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
        one = _Grams(gram_names.take(pa.array(order)), dealt[order])
        if counted:
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            entries, cs = np.unique(rank[grams[at]] * n_docs + text[at], return_counts=True)
            gram, one.doc = np.divmod(entries, n_docs)
            starts = np.searchsorted(gram, np.arange(len(order)))
            one.dfs, one.tfs, one.cs = np.diff(np.r_[starts, len(gram)]), np.add.reduceat(cs, starts), cs
        found.append(one)
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return _Grams(pa.array([], pa.string()), none, none, none, none, none)
    if len(found) == 1:
        return found[0]
    return _merged(found, counted)


def _merged(found: list[_Grams], counted: bool) -> _Grams:
    """N-grams of several n as one list in the order of the buckets."""
    dealt = np.concatenate([g.dealt for g in found])
    order = np.argsort(dealt, kind="stable")
    names = pa.chunked_array([g.names for g in found]).combine_chunks().take(pa.array(order))
    out = _Grams(names, dealt[order])
    if counted:
        dfs, tfs, doc, cs = (np.concatenate([getattr(g, c) for g in found]) for c in ("dfs", "tfs", "doc", "cs"))
        starts = (np.cumsum(dfs) - dfs)[order]
        out.dfs, out.tfs = dfs[order], tfs[order]
        run = np.repeat(starts - (np.cumsum(out.dfs) - out.dfs), out.dfs) + np.arange(len(doc))
        out.doc, out.cs = doc[run], cs[run]
    return out


def _by_bucket(dealt: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The buckets of tokens in their order, and how many tokens each has."""
    number, sizes = np.unique(dealt, return_counts=True)
    return pa.array(number.astype(np.int32)), sizes


def _asked(chunk: pa.Scalar, names: pa.Array, number: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    """One row (chunk, bucket, tokens) for each bucket."""
    return pa.RecordBatch.from_arrays(
        [pa.repeat(chunk, len(number)), number, _lines(names, sizes)], names=["chunk", "bucket", "tokens"]
    )


def _class_values(rows: pa.Table, cells: int) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The tokens of a chunk that a block of classes has; for each class their places and values."""
    tokens, sizes = _strings(rows["tokens"]), _line_sizes(rows["tokens"])
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(cells)]
    for i, (mask, first, size) in enumerate(zip(rows["mask"].to_pylist(), np.cumsum(sizes) - sizes, sizes)):
        held = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=cells * size))
        values = _doubles(rows["values"].slice(i, 1))
        cuts = np.searchsorted(held, np.arange(cells + 1) * size)
        for c, a, b in zip(range(cells), cuts, cuts[1:]):
            if b > a:
                found[c].append(((held[a:b] - c * size + first).astype(np.int32), values[a:b]))
    none = (np.zeros(0, dtype=np.int32), np.zeros(0))
    return tokens, [tuple(map(np.concatenate, zip(*parts))) if parts else none for parts in found]


def _entries(row: pa.Table):
    """Of one row of weights: its tokens; and per entry the token's and the document's place, weight and unit weight."""
    names, dfs = _strings(row["tokens"]), _numbers(row["dfs"])[0]
    token = np.repeat(np.arange(len(dfs)), dfs)
    doc, cs = _numbers(row["at"])[0], _numbers(row["cs"])[0]
    weight = np.log(cs * _doubles(row["idfs"])[token] + 1)
    size = _doubles(row["norms"])[doc]
    unit = np.divide(weight, size, out=np.zeros_like(weight), where=size > 0)
    return names, token, doc, weight, unit


def _order(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """The places of rows so that equal values are neighbours, by piece within."""
    keys = [rows["piece"].to_numpy()]
    for c in columns:
        keys.append(rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy())
    return np.lexsort(keys)


def _same(rows: pa.Table, *columns: str) -> Iterator[pa.Table]:
    """Runs of rows with equal values."""
    new = np.zeros(max(0, len(rows) - 1), dtype=bool)
    for c in columns:
        new |= np.diff(rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield rows.slice(a, b - a)


def _units(rows: pa.Table, *columns: str) -> Iterator[pa.Table]:
    """Runs of encoded texts with equal values and about ``GRAM_WORDS`` words; a longer row is one."""
    for run in _same(rows, *columns):
        place = np.cumsum([_held(w) for w in run["words"].to_pylist()]) // GRAM_WORDS
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(run)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield run.slice(a, b - a)


def _squeezed(data: bytes, wide: int, held: int) -> bytes:
    """Bytes that say how wide an element is, how many there are and how long they are, then all of them, compressed."""
    return bytes([wide]) + held.to_bytes(4, "little") + len(data).to_bytes(4, "little") + _CODEC.compress(data, asbytes=True)


def _opened(row: bytes) -> bytes:
    size = int.from_bytes(row[5:9], "little")
    return _CODEC.decompress(memoryview(row)[9:], size, asbytes=True) if size else b""


def _held(row: bytes) -> int:
    """How many elements a squeezed row has."""
    return int.from_bytes(row[1:5], "little")


def _ints(values: np.ndarray, sizes: Sequence[int]) -> pa.Array:
    """Consecutive whole numbers as squeezed rows of the given sizes.

    The lowest bytes of all numbers of a row come first, then the next ones and so on, as many
    as the largest needs.
    """
    out, values = [], np.ascontiguousarray(values, dtype="<i8")
    for end, size in zip(np.cumsum(sizes).tolist(), map(int, sizes)):
        here = values[end - size:end]
        wide = 8 if size and here.min() < 0 else max(1, (int(here.max(initial=0)).bit_length() + 7) // 8)
        out.append(_squeezed(here.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes(), wide, size))
    return pa.array(out, pa.binary())


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of rows of ``_ints``, and how many each has."""
    rows = column.to_pylist()
    sizes = np.array([_held(x) for x in rows], dtype=np.int64)
    out, end = np.zeros((sizes.sum(), 8), dtype=np.uint8), 0
    for x, size in zip(rows, sizes.tolist()):
        if size:
            out[end:end + size, :x[0]] = np.frombuffer(_opened(x), np.uint8).reshape(x[0], -1).T
        end += size
    return out.view("<i8").ravel(), sizes


def _floats(values: np.ndarray, sizes: Sequence[int]) -> pa.Array:
    """Consecutive doubles as squeezed rows of the given sizes."""
    ends = np.cumsum(sizes).tolist()
    return pa.array([_squeezed(values[e - s:e].tobytes(), 8, s) for e, s in zip(ends, map(int, sizes))], pa.binary())


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    """The doubles of rows of ``_floats``."""
    return np.frombuffer(b"".join([_opened(x) for x in column.to_pylist()]), np.float64)


def _ids(column: pa.ChunkedArray) -> pa.Array:
    """The ids of documents, row by row."""
    if pa.types.is_binary(column.type):
        return pa.array(_numbers(column)[0])
    return column.combine_chunks().flatten()


def _packed_ids(ids: pa.Array, sizes: Sequence[int], held: pa.DataType) -> pa.Array:
    return _ints(ids.to_numpy(), sizes) if pa.types.is_binary(held) else _lists(ids, sizes).cast(held)


def _strings(column: pa.ChunkedArray) -> pa.Array:
    """The lines of all rows; a row has at least one."""
    if pa.types.is_binary(column.type):
        texts = pa.array([_opened(x) for x in column.to_pylist()], pa.binary())
        column = pa.chunked_array([texts.cast(pa.string())])
    return pc.split_pattern(column, "\n").combine_chunks().flatten()


def _line_sizes(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return np.array([_held(x) for x in column.to_pylist()], dtype=np.int64)
    return pc.count_substring(column, "\n").to_numpy().astype(np.int64) + 1


def _lists(values: pa.Array, sizes: Sequence[int]) -> pa.Array:
    """Consecutive values as lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums by place; of no values at all NumPy would return integers."""
    return np.bincount(at, values, n).astype(np.float64)


def _lines(tokens: pa.Array, sizes: Sequence[int]) -> pa.Array:
    """Consecutive tokens as lines, a squeezed row for each size."""
    texts = pc.binary_join(_lists(tokens, sizes), "\n").cast(pa.binary()).to_pylist()
    return pa.array([_squeezed(text, 1, size) for text, size in zip(texts, map(int, sizes))], pa.binary())


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``PART_BYTES`` of text, the last column; a longer text is one."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(sizes, dtype=np.int64) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _encoded(batch: pa.RecordBatch, stop_words: list[str], numbers: tuple[int, int, int, int]) -> pa.RecordBatch:
    """Encoded texts of the rows (by ..., chunk, key, lower-cased text) of one batch, one row for each (by, chunk).

    Texts without words are left out; ``numbers`` are the first piece, the buckets and the range of n.
    """
    shared = batch.num_columns - 2
    group = batch.column(shared).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    for i in range(shared):
        coded = batch.column(i).dictionary_encode(null_encoding="encode")
        group = group * len(coded.dictionary) + coded.indices.to_numpy()
        group = np.unique(group, return_inverse=True)[1]
    words, text = _words(batch.column(shared + 1))
    coded = words.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy()
    wanted = ~pc.is_in(names, pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)
    keep = wanted[codes]
    codes, text = codes[keep], text[keep]
    lengths = np.bincount(text, minlength=len(batch))
    # Texts of one group are neighbours.
    order = np.argsort(group, kind="stable")
    order = order[lengths[order] > 0]
    starts, held = (np.cumsum(lengths) - lengths)[order], lengths[order]
    codes = codes[np.repeat(starts - (np.cumsum(held) - held), held) + np.arange(held.sum())]
    cuts = [0, *(np.flatnonzero(np.diff(group[order])) + 1).tolist(), len(order)]
    docs, ends = [b - a for a, b in zip(cuts, cuts[1:]) if b > a], np.cumsum(held)
    firsts, tokens, packed, end = [], [], [], 0
    for size in docs:
        firsts.append(order[end])
        own = codes[ends[end] - held[end]:ends[end + size - 1]]
        end += size
        used, place, times = np.unique(own, return_inverse=True, return_counts=True)
        # Frequent words have small numbers.
        ranked = np.argsort(-times, kind="stable")
        rank = np.empty(len(used), dtype=np.int64)
        rank[ranked] = np.arange(len(used))
        tokens.append(pc.binary_join(_lists(names.take(pa.array(used[ranked])), [len(used)]), "\n")[0].as_py())
        packed.append(_ints(rank[place], [len(own)])[0].as_py())
    ids, nameless = batch.column(shared), batch.column(shared).is_null()
    head = pa.array(np.array(firsts, dtype=np.int64))
    ids = pc.fill_null(ids, 0).cast(pa.int64()) if pa.types.is_integer(ids.type) else ids
    ids = ids.take(pa.array(order))
    ids = _packed_ids(ids, docs, pa.binary()) if pa.types.is_integer(ids.type) else _lists(ids, docs)
    first, buckets, low, high = numbers
    same = [pa.array(np.full(len(docs), v, dtype=np.int32)) for v in (buckets, low, high)]
    return pa.RecordBatch.from_arrays([
        *[batch.column(i).take(head) for i in range(shared)],
        pa.array(np.arange(first, first + len(docs), dtype=np.int64)), *same, pa.array(tokens, pa.string()),
        pc.if_else(nameless.take(head), None, ids), _ints(held, docs), pa.array(packed, pa.binary()),
    ], names=[*batch.schema.names[:shared], "piece", "buckets", "low", "high", "tokens", "docs", "lengths", "words"])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of a-z in the texts, in reading order, and the number of the text of each."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _valid, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if bounds[0] == bounds[-1]:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    letter = (data >= ord("a")) & (data <= ord("z"))
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    heads, tails = bounds[bounds < len(data)], bounds[bounds > 0] - 1
    first[heads], last[tails] = letter[heads], letter[tails]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.r_[0, np.cumsum(stops - starts)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data[letter]))
    return words, np.searchsorted(bounds, starts, "right") - 1
