"""Packing of documents into training sequences by lexical retrieval.

Texts are tokenized with a given public vocabulary and end with an end id. A document's full
windows are sequences of their own; what is left of it, less than a window, is a piece to be
packed. Pieces are ordered by content, and the order is cut into shards of a bounded number of
tokens, also where very many rows are equal. The order: the place of the nearest centre of BM25
vectors in a few random dimensions (fitted on a bounded sample, neighbouring centres side by side),
then the strongest BM25 ids that enough pieces hold to fill a shard, then a number of the row. A
shard builds an inverted index of its pieces' ids with BM25 weights; document frequencies are
counted over all pieces of the corpus. Retrieval looks inside the shard. The longest unused piece is the seed of a window; its strongest ids query
the index, and the unused pieces returned fill the window greedily, best first. If none of the
best ones fits into what is left, the best is cut: its head fills the window and its rest is the
next seed. So only the last window of a shard is padded.

Tokenizing: a text is cut before each space that stands between two visible characters, where
the vocabulary's splitting pattern always begins a new token; equal chunks are encoded once and
looked up afterwards by two 64-bit hashes. The ids are those of the whole text. They are encoded
with ``tiktoken`` and that form of the vocabulary, which is faster; the ids equal those of
``tokenizers`` and ``byte_bpe_50k.json`` (compared over every text of a test table).

Nulls: a null text is empty, one piece that holds the end id. A null id is kept. Long texts become
full windows and one piece. Repeated rows are documents of their own. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .textbytes import Hasher, ragged, slices

WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 20
LEAST_WEIGHT = 16  # tokens that a shorter piece counts for, so that a shard's number of pieces is bounded
QUERY_TERMS = 24
CONSIDERED = 48
K1, B = 1.2, 0.75
SAMPLE = 8192
CENTRES = 256
DIMENSIONS = 128
LEADING = 4  # ids of a piece's place in the order, 16 bits each
VOCABULARY = 1 << 16
CACHE = 1 << 20
_TERM_CHUNK = 1024
_SHARD_BITS, _PART_BITS = 24, 20  # of a sequence's id: number in its shard, shard in its partition


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The vocabulary's encoder, and the bytes of each id."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    size[list(ranks.values())] = [len(t) for t in ranks]
    return known.encode_ordinary, size


_LETTER_LEAD = np.zeros(256, dtype=bool)
_LETTER_LEAD[0xC3:0xE0] = True  # two-byte characters other than those of C2, which has white space
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions where a text can be cut without changing its ids, document starts included."""
    space = np.flatnonzero(buf == 0x20)
    space = space[(space > 1) & (space < len(buf) - 1)]
    before = _VISIBLE[buf[space - 1]] | (buf[space - 1] >= 0x80) & _LETTER_LEAD[buf[space - 2]]
    after = _VISIBLE[buf[space + 1]] | _LETTER_LEAD[buf[space + 1]]
    return np.union1d(space[before & after], off[:-1][np.diff(off) > 0])


class Tokenizer:
    """Ids of many texts, encoding each different chunk once; the memory is bounded."""

    def __init__(self, path: str):
        self.encode, self.bytes = _encoder(path)
        self.clear()

    def clear(self) -> None:
        self.one = np.zeros(0, np.uint64)
        self.two = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _learn(self, one: np.ndarray, two: np.ndarray, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Takes in chunks with ascending ``one``. Those that begin and end as a cut wants are encoded as one
        text, in which they are cut again by the bytes of the ids."""
        length = stop - start
        inner = np.minimum(start + 1, stop - 1)
        joins = (buf[start] == 0x20) & (_VISIBLE[buf[inner]] | _LETTER_LEAD[buf[inner]]) & (length > 1)
        joins &= _VISIBLE[buf[stop - 1]] | (buf[stop - 1] >= 0x80) & _LETTER_LEAD[buf[stop - 2]]
        size = np.zeros(len(one), dtype=np.int64)
        whole = np.array(self.encode(buf[ragged(start[joins], length[joins])].tobytes().decode()), dtype=np.uint16)
        ends = np.searchsorted(np.cumsum(self.bytes[whole]), np.cumsum(length[joins])) + 1
        size[joins] = np.diff(ends, prepend=0)
        rest = [self.encode(buf[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(start[~joins], stop[~joins])]
        size[~joins] = [len(x) for x in rest]
        begin = np.zeros(len(one), dtype=np.int64)
        begin[joins] = len(self.ids) + ends - size[joins]
        begin[~joins] = len(self.ids) + len(whole) + np.cumsum(size[~joins]) - size[~joins]
        self.ids = np.concatenate([self.ids, whole, np.array([i for x in rest for i in x], dtype=np.uint16)])
        at = np.searchsorted(self.one, one)
        for name, new in (("one", one), ("two", two), ("begin", begin), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, end ids included; offsets of the documents)."""
        start = chunk_starts(buf, off)
        stop = np.append(start[1:], len(buf))
        one, two = Hasher(buf).span(start, stop), Hasher(buf, 1).span(start, stop)
        keys, at, back = np.unique(one, return_index=True, return_inverse=True)
        if (two[at][back] != two).any():  # chunks of equal first hash: encode each text by itself
            lists = [[*self.encode(buf[a:b].tobytes().decode()), END] for a, b in zip(off[:-1], off[1:])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            return np.array([i for x in lists for i in x], dtype=np.uint16), ends
        new = self._unknown(keys, two[at])
        if len(new):
            if len(self.one) + len(new) > CACHE:
                self.clear()
                new = np.arange(len(keys))
            self._learn(keys[new], two[at[new]], buf, start[at[new]], stop[at[new]])
        place = np.searchsorted(self.one, keys)[back]
        size = self.size[place]
        flat = self.ids[ragged(self.begin[place], size)]
        # Ids of each document, then room for its end id.
        doc_end = np.append(0, np.cumsum(size))[np.searchsorted(start, off[1:])]
        ends = np.concatenate([[0], doc_end + np.arange(1, len(off))])
        out = np.full(len(flat) + len(off) - 1, END, dtype=np.uint16)
        mask = np.ones(len(out), dtype=bool)
        mask[ends[1:] - 1] = False
        out[mask] = flat
        return out, ends

    def _unknown(self, keys: np.ndarray, two: np.ndarray) -> np.ndarray:
        if not len(self.one):
            return np.arange(len(keys))
        place = np.minimum(np.searchsorted(self.one, keys), len(self.one) - 1)
        hit = self.one[place] == keys
        if (self.two[place[hit]] != two[hit]).any():  # a stored chunk of equal first hash
            self.clear()
            return np.arange(len(keys))
        return np.flatnonzero(~hit)


_TOKENIZERS: dict[str, Tokenizer] = {}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_SPLIT = "doc_tokens long, full array<long>, rest binary"


def _tokenize(path: str, window: int):
    """Per document: number of ids, checksums of its full windows, ids of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = Tokenizer(path)
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                ids, ends = _TOKENIZERS[path](buf, off)
                count = np.diff(ends)
                full, rest = [], []
                for d in range(rows.num_rows):
                    own = ids[ends[d] : ends[d + 1]]
                    whole = len(own) // window * window
                    full.append([crc(own[i : i + window]) for i in range(0, whole, window)])
                    rest.append(own[whole:].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(count, pa.int64()),
                        pa.array(full, pa.list_(pa.int64())),
                        pa.array(rest, pa.binary()),
                    ],
                    names=["doc_id", "doc_tokens", "full", "rest"],
                )

    return run


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            total[np.unique(np.frombuffer(value.as_buffer(), dtype=np.uint16))] += 1
    if total.any():
        n = VOCABULARY // _TERM_CHUNK
        at = pa.array(np.arange(n + 1, dtype=np.int32) * _TERM_CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(at, pa.array(total))], names=["chunk", "n"])


def _frequencies(pieces: DataFrame) -> np.ndarray:
    """Number of pieces that hold each id; the table has the vocabulary's size."""
    counts = pieces.select("rest").mapInArrow(_count_terms, "chunk int, n array<bigint>")
    for keys in (["chunk", "part"], ["chunk"]):
        counts = counts.withColumn("part", F.spark_partition_id() % 64) if "part" in keys else counts
        zero = F.array_repeat(F.lit(0).cast("bigint"), _TERM_CHUNK)
        total = F.aggregate(F.collect_list("n"), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        counts = counts.groupBy(*keys).agg(total.alias("n"))
    df = np.zeros(VOCABULARY)
    for chunk, n in counts.select("chunk", "n").collect():
        df[chunk * _TERM_CHUNK : (chunk + 1) * _TERM_CHUNK] = n
    return df


def _weights(tf: np.ndarray, idf: np.ndarray, size: float | np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


_DIRECTIONS: list[np.ndarray] = []


def _directions() -> np.ndarray:
    if not _DIRECTIONS:
        _DIRECTIONS.append(np.random.default_rng(0).standard_normal((VOCABULARY, DIMENSIONS), dtype=np.float32))
    return _DIRECTIONS[0]


def _vector(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A piece's BM25 weights in a few random dimensions, of length 1."""
    out = weight.astype(np.float32) @ _directions()[term]
    return out / max(float(np.linalg.norm(out)), 1e-9)


def _terms(piece: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    term, tf = np.unique(piece, return_counts=True)
    return term, _weights(tf, idf[term], len(piece), mean)


def _vectors(idf: np.ndarray, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_vector(*_terms(np.frombuffer(v.as_buffer(), dtype=np.uint16), idf, mean)).tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["v"])

    return run


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by k-means; near ones are side by side (cut in halves along the
    direction in which they differ most, again and again)."""
    rng = np.random.default_rng(0)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-9), c)

    def chain(which: np.ndarray) -> list[int]:
        if len(which) < 3:
            return which.tolist()
        apart = c[which] - c[which].mean(axis=0)
        along = apart @ np.linalg.svd(apart, full_matrices=False)[2][0]
        by = which[np.argsort(along, kind="stable")]
        return chain(by[: len(by) // 2]) + chain(by[len(by) // 2 :])

    return c[chain(np.arange(len(c)))]


def place(piece: np.ndarray, middle: np.ndarray, idf: np.ndarray, common: np.ndarray, mean: float) -> tuple[int, int]:
    """A piece's place in the order by content: (number of the nearest centre, strongest ids)."""
    term, weight = _terms(piece, idf, mean)
    # The vector's length does not matter to which centre is nearest.
    nearest = int((middle @ (weight.astype(np.float32) @ _directions()[term])).argmax()) if len(middle) else 0
    strength = weight * common[term]
    leading = 0
    for i in np.argsort(-strength, kind="stable")[:LEADING]:
        leading = leading << 16 | (int(term[i]) if strength[i] > 0 else 0)
    return nearest, (leading << 16 * max(LEADING - len(term), 0)) - (1 << 63)


def _places(middle: np.ndarray, idf: np.ndarray, common: np.ndarray, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column(batch.schema.get_field_index("rest"))
            own = [place(np.frombuffer(v.as_buffer(), dtype=np.uint16), middle, idf, common, mean) for v in rest]
            near, leading = zip(*own) if own else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32()), pa.array(leading, pa.int64())], names=[*batch.schema.names, "near", "leading"]
            )

    return run


def _ordered(split: DataFrame, df: np.ndarray, idf: np.ndarray, mean: float, pieces: int, shards: int) -> DataFrame:
    """The rows with their places in the order by content, written so that a task that runs again
    finds the same ones."""
    kind = split.schema["doc_id"].dataType.simpleString()
    middle = np.zeros((0, DIMENSIONS), dtype=np.float32)
    if shards > 1:
        every = max(1, pieces // SAMPLE)
        drawn = split.where((F.length("rest") > 0) & (F.pmod(F.xxhash64("row"), F.lit(every)) == 0)).select("rest").limit(2 * SAMPLE)
        found = drawn.mapInArrow(_vectors(idf, mean), "v binary").toArrow()["v"]
        sample = np.array([np.frombuffer(v.as_buffer(), dtype=np.float32) for v in found])
        if len(sample):
            middle = centres(sample[np.lexsort(sample.T)], CENTRES)
    # An id of few pieces brings few together; those of the middle and above can fill a shard.
    common = (df >= max(2, pieces // shards)).astype(np.float64)
    return materialize(split.mapInArrow(_places(middle, idf, common, mean), f"doc_id {kind}, {_SPLIT}, row long, near int, leading long"))


class Index:
    """Inverted index of a shard's pieces with BM25 weights."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(pieces)
        size = np.array([len(p) for p in pieces], dtype=np.float64)
        key = np.repeat(np.arange(n, dtype=np.int64), size.astype(np.int64)) << 16 | np.concatenate(pieces).astype(np.int64)
        key, tf = np.unique(key, return_counts=True)
        piece, term = key >> 16, key & 0xFFFF
        weight = _weights(tf, idf[term], size[piece], mean)
        # The strongest ids of each piece are its query.
        order = np.lexsort((-weight, piece))
        first = np.searchsorted(piece, np.arange(n + 1))
        self.queries = [term[order[a : min(a + QUERY_TERMS, b)]] for a, b in zip(first[:-1], first[1:])]
        order = np.argsort(term, kind="stable")
        self.piece, self.weight = piece[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all pieces for the seed's query."""
        q = self.queries[seed]
        at = ragged(self.first[q], self.first[q + 1] - self.first[q])
        return np.bincount(self.piece[at], weights=self.weight[at], minlength=self.n)


def fill(pieces: list[np.ndarray], index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, begin, end)."""
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    unused = np.ones(len(pieces), dtype=bool)
    order = np.argsort(-size, kind="stable")
    next_seed, carried = 0, None  # a cut piece goes on as the next seed
    while True:
        if carried is None:
            while next_seed < len(order) and not unused[order[next_seed]]:
                next_seed += 1
            if next_seed == len(order):
                return
            seed, begin = int(order[next_seed]), 0
            unused[seed] = False
        else:
            seed, begin = carried
        row = [(seed, begin, int(size[seed]))]
        room, carried = window - (int(size[seed]) - begin), None
        score = index.scores(seed) if room else None
        while room and unused.any():
            value = np.where(unused, score, -1.0)
            best = np.argpartition(-value, min(CONSIDERED, len(value) - 1))[:CONSIDERED] if len(value) > CONSIDERED else np.arange(len(value))
            best = best[value[best] >= 0]
            best = best[np.lexsort((best, -value[best]))]
            placed = False
            for p in best:
                if size[p] <= room:
                    row.append((int(p), 0, int(size[p])))
                    unused[p] = False
                    room -= int(size[p])
                    placed = True
                    if not room:
                        break
            if room and not placed:
                p = int(best[0])
                row.append((p, 0, room))
                unused[p] = False
                carried, room = (p, room), 0
        yield row


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(idf: np.ndarray, mean: float, window: int, with_ids: bool, shard_tokens: int):
    """Cuts a partition's rows, as they come, into shards and packs each."""

    def shard_rows(shard: int, docs: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        sequence = shard << _SHARD_BITS
        pieces, owner = [], []
        for doc_id, tokens, full, rest in docs:
            for i, checksum in enumerate(full):
                out.append((doc_id, i * window, window, checksum, tokens, sequence, 0, None))
                sequence += 1
            if rest:
                pieces.append(np.frombuffer(rest, dtype=np.uint16))
                owner.append((doc_id, tokens, len(full) * window))
        if pieces:
            for row in fill(pieces, Index(pieces, idf, mean), window):
                at = 0
                for p, a, b in row:
                    doc_id, tokens, base = owner[p]
                    ids = pieces[p][a:b]
                    out.append((doc_id, base + a, b - a, crc(ids), tokens, sequence, at, ids.tobytes() if with_ids else None))
                    at += b - a
                sequence += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [None, *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        held, shard, id_type = 0, None, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "doc_tokens", "full", "rest"))):
                shard = part << _PART_BITS if shard is None else shard
                weight = len(row[2]) + max(len(row[3]) // 2, LEAST_WEIGHT)
                if docs and held + weight > shard_tokens:
                    yield _typed(shard_rows(shard, docs), id_type)
                    docs, held, shard = [], 0, shard + 1
                held += weight
                docs.append(tuple(row))
        if docs:
            yield _typed(shard_rows(shard, docs), id_type)

    return run


def _typed(batch: pa.RecordBatch, id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *batch.columns[1:]], names=batch.schema.names)


def pack(
    docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Pieces of all documents with their places in sequences. ``with_ids`` adds the ids of packed
    pieces (little-endian, two bytes each); full windows can be cut from their document. A sequence's
    shard is its id without the lowest ``_SHARD_BITS`` bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = rows.mapInArrow(_tokenize(path or vocabulary_path(), window), f"doc_id {kind}, {_SPLIT}")
    # Rows are numbered in a written table, so that equal ones can be dealt apart.
    split = materialize(split.withColumn("row", F.monotonically_increasing_id()))
    rest = F.length("rest") / 2
    weight = F.size("full") + F.greatest(rest, F.lit(LEAST_WEIGHT))
    tokens, pieces, load = split.agg(
        F.coalesce(F.sum(rest), F.lit(0.0)), F.count(F.when(rest > 0, 1)), F.coalesce(F.sum(weight), F.lit(0.0))
    ).first()
    shards = max(1, -(-int(load) // shard_tokens))
    df = _frequencies(split)
    idf = np.log(1.0 + (pieces - df + 0.5) / (df + 0.5))
    mean = max(tokens / max(pieces, 1), 1.0)
    order = [F.col("near"), F.col("leading"), F.col("row")]
    dealt = _ordered(split, df, idf, mean, pieces, shards).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "doc_tokens", "full", "rest")
    return dealt.mapInArrow(_pack(idf, mean, window, with_ids, shard_tokens), f"doc_id {kind}, {_PIECES}")


def query(docs: DataFrame) -> DataFrame:
    return pack(docs).drop("ids")
