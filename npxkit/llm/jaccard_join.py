"""Similarity self-join of documents on word n-grams, exact, by prefix filtering.

A document's set holds the hashes of its distinct ``words``-word shingles (ASCII capitals in
lower case; a text of fewer words is one shingle). Documents with equal sets form a class, and
classes are joined through one representative. Two sets x, y of a class pair link when
``100 * |x & y| >= percent * |x | y|``. The join:

* *Rare first.* Shingles are ordered by document frequency, then by hash. Frequencies are counted
  over all documents: each partition reports the shingles that it holds more than once, and the
  ``HEAVY`` most frequent ones of their sums (a table of bounded size) come last in the order. Any
  common order gives a right result; this one keeps frequent shingles out of the prefixes.
* *Prefixes.* A pair that links shares a shingle of the larger set's probing prefix and the
  smaller set's (shorter) indexing prefix. Prefix shingles that only one document has are dropped.
* *Crowds.* Only components are asked for, so a group of thousands of near copies need not be
  compared pair by pair. Each document goes, with its text, to the prefix shingle that
  most documents share. The documents of a shingle are dealt into blocks of about ``CROWD_ROWS`` by hash,
  ``HUBS`` of them to all its blocks. A block's sets are built and intersected in its task; it reports one
  link per document to its component, so rows grow with the documents and not with the pairs, and the
  block, whose pairs are all settled by that.
* *Marks.* A set marks the bits that an odd number of its shingles fall on, of ``MARKS``. Two sets' marks differ in no
  more bits than the sets differ in shingles. A crowd's rows meet with their marks and without texts, and rows with
  no possible partner are dropped: frequent shingles bring unlike documents together.
* *Meetings.* Where many pairs of different blocks and components are left, two blocks that share a crowd's shingle
  meet: their documents that have a possible partner there, by their marks, are sent to one task, which compares each
  of one side with each of the other. A document is sent once for each block that it faces, and a meeting
  reports a link or two for it. All pairs that share a crowd's shingle are settled then.
* *All the rest.* Every pair that shares a prefix shingle (a crowd's only without meetings), is not yet in one component and was in no
  common block is generated, under the *length* filter; rows of one pair meet in one aggregation, so a pair is
  verified once. *Positional filter*: the shingles matched so far, and what is left behind the
  last one, must be able to reach the required overlap. *Suffix filter*: marks differ by no more
  than the pair may differ.
* *Verification.* The texts of the documents still in question meet in groups of linked pairs, once for each group, and
  their sets are intersected there.

A task holds one block of a crowd at a time, or one and a part of another, bounded in documents and in shingles. Links between
representatives are turned into components in distributed rounds.

Nulls: a null text, and a text without words, has an empty set and links with nothing; a row
with a null id gets a null component. Rows that share an id are one node with several sets.
Repeated rows fall into one class. Long texts are used whole. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import components, discard, materialize
from .textbytes import Hasher, mix, ragged, slices, words

HEAVY = 1 << 18
HUBS = 16
CROWD = 16  # documents that share a shingle, from which on they are a crowd
CROWD_ROWS = 2048
CROWD_SHINGLES = 1 << 21
FACING = 1024  # documents of a meeting's other side that are compared at a time
FEW = 1  # pairs for each row that are compared without blocks, or without meetings
MARKS = 1024  # bits
MARKED_ROWS = 4096  # of a crowd that meet with their marks at a time
GROUP_DOCS = 512  # documents of a group of pairs
_WORDS = MARKS // 64
_FILTER_BITS = 22
_U = np.uint64


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a buffer."""
    s, e, first = words(buf, off)
    h = Hasher(buf, 0, lower=True).span(s, e) if len(s) else np.zeros(0, _U)
    n = np.diff(first)
    out: list[np.ndarray] = []
    if len(h) >= k:
        grams = np.zeros(len(h) - k + 1, dtype=_U)
        for i in range(k):
            grams = mix(grams + h[i : len(h) - k + 1 + i])
    for d, count in enumerate(n):
        a = first[d]
        if count >= k:
            out.append(np.unique(grams[a : a + count - k + 1]))
        elif count:
            whole = np.array([count], dtype=_U)
            for i in range(a, a + count):
                whole = mix(whole + h[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def _local_counts(k: int):
    """Shingles that several documents of a partition share, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[np.ndarray] = []
            for _, buf, off in slices(batch, "text"):
                own += shingle_sets(buf, off, k)
            h, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, _U), np.zeros(0, np.int64))
            several = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(h[several].view(np.int64)), pa.array(n[several])], names=["h", "n"])

    return run


def _heavy(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their places in the order (1 and up)."""
    counts = docs.mapInArrow(_local_counts(k), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.col("n").desc(), "h").limit(HEAVY).toArrow()
    h = most["h"].to_numpy().view(_U)
    place = len(h) - np.arange(len(h))
    order = np.argsort(h)
    return h[order], place[order].astype(np.int64)


def _places(x: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    h, place = heavy
    if not len(h):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(h, x), len(h) - 1)
    return np.where(h[at] == x, place[at], 0)


def _sums(x: np.ndarray) -> tuple[int, int]:
    y = mix(x ^ _U(0x5851F42D4C957F2D))
    return int(y.sum(dtype=_U).view(np.int64)), int(mix(y).sum(dtype=_U).view(np.int64))


def _describe(k: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]):
    """Per document: size, hashes of the set, its marks, and its probing prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                sets = shingle_sets(buf, off, k)
                n = np.array([len(x) for x in sets], dtype=np.int32)
                take = np.where(n > 0, n - (percent * n.astype(np.int64) + 99) // 100 + 1, 0)
                prefixes, s1, s2 = [], np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                marks = np.zeros((len(n), _WORDS), dtype=np.int64)
                for i, x in enumerate(sets):
                    if not len(x):
                        continue
                    order = np.argsort(_places(x, heavy), kind="stable")
                    prefixes.append(x[order[: take[i]]])
                    s1[i], s2[i] = _sums(x)
                    # Bits other than those that order the prefix.
                    odd = np.bincount((x & _U(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
                    marks[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                at = np.zeros(len(n) + 1, dtype=np.int32)
                np.cumsum(take, out=at[1:])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, _U)
                spread = np.arange(len(n) + 1, dtype=np.int32) * _WORDS
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(n),
                        pa.array(s1),
                        pa.array(s2),
                        pa.ListArray.from_arrays(pa.array(spread), pa.array(marks.ravel())),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64))),
                    ],
                    names=["doc_id", "n", "s1", "s2", "marks", "prefix"],
                )

    return run


def _linked(k: int, percent: int):
    """Links (x, y) of each group of a partition sorted by ``g``, ``i`` and ``j``, of the pairs that its rows name: a
    document with its text and others. An id that has several sets links by any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kind = None, None
        sets: dict[object, list[np.ndarray]] = {}
        asked: dict[object, set] = {}

        def reach(x: np.ndarray, y: np.ndarray) -> bool:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        def flush() -> pa.RecordBatch:
            out = [(x, y) for x, others in asked.items() for y in others if any(reach(p, q) for p in sets[x] for q in sets.get(y, ()))]
            x, y = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(y, kind)], names=["x", "y"])

        for batch in batches:
            kind = batch.schema.field("doc").type
            for rows, buf, off in slices(batch, "text"):
                columns = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("g", "i", "j", "doc", "others"))
                for g, i, j, doc, others, x in zip(*columns, shingle_sets(buf, off, k)):
                    if (g, i, j) != here:
                        if asked:
                            yield flush()
                        here, sets, asked = (g, i, j), {}, {}
                    known = sets.setdefault(doc, [])
                    if not any(np.array_equal(x, y) for y in known):
                        known.append(x)
                    if others:
                        asked.setdefault(doc, set()).update(others)
        if asked:
            yield flush()

    return run


def _grouped(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Where the documents of pairs (x, y) go: rows (g, i, j, doc, others), each pair named by one, and the tables
    written on the way. Pairs that hang together share a group; large ones are cut by both sides."""
    label = materialize(_spread(pairs))
    cut = label.groupBy(F.col("label").alias("g")).agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_DOCS)).cast("int").alias("cut"))
    told = pairs.join(label.select(F.col("node").alias("x"), F.col("label").alias("g")), "x").join(cut, "g")
    told = told.withColumns({c: F.pmod(F.xxhash64(d, F.lit(2)), F.col("cut")).cast("int") for c, d in (("i", "x"), ("j", "y"))})
    key = ["g", "i", "j"]
    ends = told.select(*key, F.col("x").alias("doc"), F.col("y").alias("other"))
    ends = ends.unionAll(told.select(*key, F.col("y").alias("doc"), F.lit(None).cast(pairs.schema["y"].dataType).alias("other")))
    return materialize(ends.groupBy(*key, "doc").agg(F.collect_set("other").alias("others"))), [label]


def _index_length(n: Column, percent: int) -> Column:
    """Of the smaller set, a share of 2t / (1 + t) must match: its indexing prefix is shorter."""
    return n - F.ceil(n * (2 * percent) / F.lit(100 + percent)).cast("int") + 1


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by ``h`` whose ``h`` occurs more than once. One row is carried
    from batch to batch."""
    carried: pa.RecordBatch | None = None
    again = False  # the carried row's hash occurred before it
    for batch in batches:
        if not batch.num_rows:
            continue
        if carried is not None:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        h = batch.column(0).to_numpy(zero_copy_only=False)
        same = np.append(again, h[1:] == h[:-1])
        keep = same.copy()
        keep[:-1] |= same[1:]
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        carried, again = batch.slice(batch.num_rows - 1), bool(same[-1])
    if carried is not None and again:
        yield carried


def _overlaps(sets: list[np.ndarray], split: int = 0) -> np.ndarray:
    """Sizes of all intersections of a block's sets, from the shingles that several of them have; with ``split``,
    of the first ``split`` sets with the others."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((split or len(sets), len(sets) - split), dtype=np.float64)
    for at in range(0, int((times > 1).sum()), 1024):
        some = slice(*np.searchsorted(column, [at, at + 1024]))
        holds = np.zeros((len(sets), 1024), dtype=np.float32)
        holds[owner[some], column[some] - at] = 1.0
        out += holds[: split or None] @ holds[split:].T
    return out


def _merged(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Place of the first set of each set's component, by the links among them."""
    n, both = np.array([len(x) for x in sets]), _overlaps(sets)
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    label = np.arange(len(sets))
    while True:
        low = np.minimum(np.where(linked, label[None, :], len(sets)).min(axis=1), label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _crowd_links(k: int, percent: int):
    """Of each block of a partition sorted by ``h`` and ``block``: links (x, y) of connected documents, one for a
    document, and rows (x, null, met) that name the documents whose sets were all compared. Rows whose text has another set than the one asked for are other sets of a repeated id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, docs, sets, held, chunk = None, [], [], 0, 0
        kind = None

        def flush() -> pa.RecordBatch:
            label = _merged(sets, percent) if len(sets) > 1 else np.zeros(len(sets), int)
            met = int(mix(mix(np.array([here[0]]).view(_U) + _U(here[1])) + _U(chunk)).view(np.int64)[0])
            out = [(d, docs[a], None) for d, a in zip(docs, label) if d != docs[a]] + [(d, None, met) for d in set(docs)]
            x, y, z = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(y, kind), pa.array(z, pa.int64())], names=["x", "y", "met"])

        for batch in batches:
            kind = batch.schema.field("doc").type
            for rows, buf, off in slices(batch, "text"):
                columns = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("h", "block", "doc", "s1"))
                for h, block, doc, s1, x in zip(*columns, shingle_sets(buf, off, k)):
                    if not len(x) or _sums(x)[0] != s1:
                        continue
                    if (h, block) != here:
                        if len(sets) > 1:
                            yield flush()
                        here, docs, sets, held, chunk = (h, block), [], [], 0, 0
                    elif len(sets) >= 2 * CROWD_ROWS or held + len(x) > CROWD_SHINGLES:
                        yield flush()  # its first documents meet the next ones too
                        docs, sets, chunk = docs[:HUBS], sets[:HUBS], chunk + 1
                        held = sum(map(len, sets))
                        if held > CROWD_SHINGLES // 2:
                            docs, sets, held = docs[:1], sets[:1], len(sets[0])
                    docs.append(doc)
                    sets.append(x)
                    held += len(x)
        if len(sets) > 1:
            yield flush()

    return run


def _facing_links(k: int, percent: int):
    """Of each meeting of a partition sorted by ``a``, ``b`` and ``side``: links (x, y) that connect what the links between
    its sides, of unlike components, connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kind = None, None
        near: list[tuple] = []  # (document, component, set) of side 0
        far: list[tuple] = []  # of side 1, up to FACING
        held = 0

        def flush() -> pa.RecordBatch:
            docs, parts, sets = zip(*near, *far)
            n, both = np.array([len(x) for x in sets]), _overlaps(list(sets), len(near))
            part = np.unique(np.array(parts), return_inverse=True)[1]
            a, b = slice(len(near)), slice(len(near), None)
            linked = 100 * both >= percent * (n[a, None] + n[None, b] - both)
            label, across = _connected(linked & (part[a, None] != part[None, b]))
            out = [(docs[i], docs[j]) for i, j in enumerate(label) if i != j]
            out += [(docs[len(near) + i], docs[j]) for i, j in enumerate(across) if j < len(near)]
            x, y = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(y, kind)], names=["x", "y"])

        for batch in batches:
            kind = batch.schema.field("doc").type
            for rows, buf, off in slices(batch, "text"):
                columns = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "side", "doc", "component", "s1"))
                for a, b, side, doc, part, s1, x in zip(*columns, shingle_sets(buf, off, k)):
                    if not len(x) or _sums(x)[0] != s1:
                        continue
                    if (a, b) != here or len(far) >= FACING or held > CROWD_SHINGLES:
                        if near and far:
                            yield flush()
                        far, held = [], 0
                    if (a, b) != here:
                        here, near = (a, b), []
                    if side:
                        far.append((doc, part, x))
                        held += len(x)
                    else:
                        near.append((doc, part, x))
        if near and far:
            yield flush()

    return run


def _connected(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of the component of each row and of each column (or the number of rows) by the links of rows with columns."""
    n = len(linked)
    label = np.arange(n)
    while True:
        across = np.where(linked, label[:, None], n).min(axis=0)
        low = np.minimum(np.where(linked, across[None, :], n).min(axis=1), label)
        low = low[low]
        if (low == label).all():
            return label, across
        label = low


def _sent(routes: DataFrame, plain: DataFrame) -> DataFrame:
    """The routes with the texts of their documents. A bitmap of the documents' hashes, of fixed size, goes to the scan."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(1 << _FILTER_BITS)).alias("slot")
    wanted = np.zeros(1 << _FILTER_BITS, dtype=bool)
    wanted[routes.select(slot).distinct().toArrow()["slot"].to_numpy()] = True
    texts = plain.withColumnRenamed("doc_id", "doc")
    kind = texts.schema["doc"].dataType.simpleString()
    texts = texts.withColumn("slot", F.pmod(F.xxhash64("doc"), F.lit(1 << _FILTER_BITS))).mapInArrow(_marked(wanted), f"doc {kind}, text string")
    return texts.join(routes, "doc")


def _met_in_crowds(crowded: DataFrame, chosen: DataFrame, plain: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """What ``_crowd_links`` reports of documents that share a frequent prefix shingle, and the tables written on
    the way."""
    crowds = crowded.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    asked = crowded.join(crowds, "h").groupBy("doc").agg(F.max(F.struct("parts", "h")).getField("h").alias("h"))
    asked = materialize(asked)
    total = asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sent = asked.join(total, "h").select("h", "doc", "n", F.ceil(F.col("n") / F.lit(CROWD_ROWS)).cast("int").alias("blocks"))
    own = F.array(F.pmod(F.xxhash64("doc", F.lit(-1)), F.col("blocks")).cast("int"))
    hub = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("n")) < HUBS
    block = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)).alias("block")
    routes = materialize(sent.select("doc", "h", block).join(chosen.select(F.col("doc_id").alias("doc"), "s1"), "doc"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    rows = _sent(routes, plain).repartition("h", "block").sortWithinPartitions("h", "block")
    return rows.mapInArrow(_crowd_links(words, percent), f"x {kind}, y {kind}, met bigint"), [asked, routes]


def _likely(percent: int, across: bool):
    """Of each two blocks of rows of a shingle, in a partition sorted by ``h``, ``low`` and ``high``, those that the marks and
    sizes leave a partner of another component and block: rows (h, doc, n), or with ``across`` rows (doc, component,
    met, facing), one for each block that a document faces."""

    def scan(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t["n"].to_numpy().astype(np.int64)
        t = t.take(pa.array(order := np.argsort(n, kind="stable"))).combine_chunks()
        n = n[order]
        marks = t["marks"].combine_chunks().flatten().to_numpy().view(_U).reshape(-1, _WORDS)
        part, met = (np.unique(t[c].to_numpy(), return_inverse=True)[1] for c in ("component", "met"))
        side, same = t["side"].to_numpy(), t["low"][0].as_py() == t["high"][0].as_py()
        live, pairs, at = np.zeros(len(n), dtype=bool), [], np.arange(len(n))
        for begin in range(0, len(n), 128):
            a = slice(begin, begin + 128)
            b = slice(begin, int(np.searchsorted(n, n[a][-1] * 100 // percent, "right")))
            size = n[a, None] + n[None, b]
            spare = size + 2 * (-size * percent // (100 + percent))
            fits = (at[a, None] < at[None, b]) & (n[a, None] * 100 >= n[None, b] * percent)
            fits &= (part[a, None] != part[None, b]) & (met[a, None] != met[None, b])
            if not same:
                fits &= side[a, None] != side[None, b]
            apart = np.zeros(size.shape, dtype=np.int16)
            for w in range(_WORDS // 4):  # most unlike pairs differ by more in these
                apart += np.bitwise_count(marks[a, None, w] ^ marks[None, b, w])
            x, y = np.nonzero(fits & (apart <= spare))
            apart, spare = apart[x, y], spare[x, y]
            x, y = x + begin, y + begin
            for w in range(_WORDS // 4, _WORDS):
                apart += np.bitwise_count(marks[x, w] ^ marks[y, w])
            x, y = x[apart <= spare], y[apart <= spare]
            live[x] = live[y] = True
            if across:
                pairs.append(np.unique(np.concatenate([x * len(n) + met[y], y * len(n) + met[x]])))
        if not across:
            return t.select(["h", "doc", "n"]).filter(pa.array(live)).combine_chunks().to_batches() or []
        row, faced = np.divmod(np.unique(np.concatenate(pairs)), len(n))
        value = np.unique(t["met"].to_numpy())
        found = t.select(["doc", "component", "met"]).take(pa.array(row)).append_column("facing", pa.array(value[faced]))
        return found.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "low", "high")]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
            for begin, end in zip(cuts[:-1], cuts[1:]):
                here = tuple(k[begin] for k in keys)
                if parts and here != last:
                    yield from scan(parts)
                    parts = []
                last = here
                parts.append(batch.slice(begin, end - begin))
        if parts:
            yield from scan(parts)

    return run


def _with_partners(named: DataFrame, known: DataFrame, percent: int, across: bool = False) -> DataFrame:
    """What ``_likely`` reports of crowds' rows ``named`` (h, doc, n, component, met): no pairs, and a row
    at most for each block that a row faces. Marks travel, texts don't."""
    named = named.withColumn("met", F.coalesce("met", F.xxhash64("doc")))
    sizes = named.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(MARKED_ROWS)).cast("int").alias("blocks"))
    rows = named.join(sizes, "h").join(known.select(F.col("doc_id").alias("doc"), "n", "marks"), ["doc", "n"])
    rows = rows.withColumn("side", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "side", "doc", "n", "component", "met", "marks")
    rows = rows.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
    kind = named.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, component {kind}, met bigint, facing bigint" if across else f"h bigint, doc {kind}, n int"
    return rows.mapInArrow(_likely(percent, across), schema).distinct()


def _met_across(named: DataFrame, known: DataFrame, chosen: DataFrame, plain: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between documents of different blocks and components that share a shingle of ``named`` (h, doc, n,
    component, met), and the tables written on the way. A document that was in no block is one of its own."""
    faced = _with_partners(named, known, percent, across=True)
    both = faced.select(
        F.least("met", "facing").alias("a"), F.greatest("met", "facing").alias("b"), (F.col("met") > F.col("facing")).cast("int").alias("side"), "doc", "component"
    )
    routes = materialize(both.join(chosen.select(F.col("doc_id").alias("doc"), "s1"), "doc"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    rows = _sent(routes, plain).repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return rows.mapInArrow(_facing_links(words, percent), f"x {kind}, y {kind}"), [routes]


def _marked(wanted: np.ndarray):
    """Texts of the documents whose id's hash is marked in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = wanted[batch.column(batch.schema.get_field_index("slot")).to_numpy(zero_copy_only=False)]
            yield batch.filter(pa.array(marked)).select(["doc", "text"])

    return run


def _spread(found: DataFrame, steps: int = 3) -> DataFrame:
    """(node, label) of linked documents; equal labels are connected. A few steps join almost all
    of a hub's neighbours; what stays apart is compared, not lost."""
    both = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for _ in range(steps - 1):
        label = materialize(label)
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        label = label.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"))
    return label


def _cross_pairs(named: DataFrame) -> float:
    """Pairs of different components that share a shingle and were in no block together, counted once for
    each shingle."""
    named = named.withColumn("met", F.coalesce("met", F.xxhash64("doc")))
    sums = None
    for sign, keys in ((1, []), (-1, ["component"]), (-1, ["met"]), (1, ["component", "met"])):
        n = F.count(F.lit(1)).cast("double")
        part = named.groupBy("h", *keys).agg((n * n * F.lit(sign)).alias("n"))
        sums = part.select("n") if sums is None else sums.unionAll(part.select("n"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0.0)) / 2).first()[0]


def _possible(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: pairs (x, y) whose sets' marks differ by no more than the pair may."""
    size = described.select("doc_id", "n", "marks")
    pairs = pairs.join(size.select(F.col("doc_id").alias("x"), F.col("n").alias("xn"), F.col("marks").alias("xmarks")), "x")
    pairs = pairs.join(size.select(F.col("doc_id").alias("y"), F.col("n").alias("yn"), F.col("marks").alias("ymarks")), "y")
    apart = F.aggregate(F.zip_with("xmarks", "ymarks", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, d: s + d)
    return pairs.where(apart <= F.col("xn") + F.col("yn") - 2 * _needed(percent)).select("x", "y").distinct()


def _needed(percent: int) -> Column:
    return F.ceil((F.col("xn") + F.col("yn")) * percent / F.lit(100 + percent))


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different components and blocks among ``members`` (h, doc, n, pos, component, met)
    that pass the length and positional filters; y is the smaller set."""
    mixed = members.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("h")
    mixed = materialize(mixed)
    left = materialize(members.join(mixed, "h", "left_semi"))
    discard(mixed)
    probe = left.select("h", F.col("doc").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("component").alias("xc"), F.col("met").alias("xm"))
    small = left.where(F.col("pos") < _index_length(F.col("n"), percent))
    small = small.select("h", F.col("doc").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("component").alias("yc"), F.col("met").alias("ym"))
    smaller = (F.col("yn") < F.col("xn")) | ((F.col("yn") == F.col("xn")) & (F.col("y") < F.col("x")))
    in_reach = F.col("yn") * 100 >= F.col("xn") * percent
    unmet = F.coalesce(F.col("xm") != F.col("ym"), F.lit(True))
    met = probe.join(small, (probe.h == small.h) & smaller & in_reach & (F.col("xc") != F.col("yc")) & unmet)
    met = met.groupBy("x", "y", "xn", "yn").agg(F.count(F.lit(1)).alias("same"), F.max("xp").alias("xp"), F.max("yp").alias("yp"))
    behind = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp")) - 1
    out = met.where(F.col("same") + behind >= _needed(percent)).select("x", "y").distinct()
    out._reads = left  # to be discarded when the pairs are written
    return out


def links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, components)``: every row with its set's size and its class's representative, and the
    components (node, component) of linked representatives."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heavy = _heavy(plain.select("text"), words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n int, s1 bigint, s2 bigint, marks array<bigint>, prefix array<bigint>"
    described = materialize(plain.mapInArrow(_describe(words, percent, heavy), schema))
    key = ["n", "s1", "s2"]
    first = described.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    first = materialize(first)
    # The id is a key of the join, and named again it needs no second shuffle of the prefixes.
    prefixed = described.where("n > 0").join(first, key).where("doc_id = rep").dropDuplicates([*key, "doc_id"])

    members = prefixed.select(F.posexplode("prefix").alias("pos", "h"), F.col("doc_id").alias("doc"), "n").select("h", "doc", "n", "pos")
    members = members.repartition("h").sortWithinPartitions("h")
    members = materialize(members.mapInArrow(_shared, f"h bigint, doc {kind}, n int, pos int"))
    asked = members.select(F.col("doc").alias("doc_id")).distinct()
    known = materialize(described.select("doc_id", "n", "marks").join(asked, "doc_id", "left_semi").distinct())
    # From here on without the prefixes, which are the larger part.
    sized = materialize(described.select("doc_id", *key))
    discard(described)
    rows = sized.join(first, key, "left").select("doc_id", "n", "rep")
    chosen = sized.where("n > 0").join(first, key).where("doc_id = rep").dropDuplicates([*key, "doc_id"])
    none = plain.sparkSession.createDataFrame([], f"x {kind}, y {kind}")

    def verified(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The pairs that link, and the tables written on the way."""
        asked, pairs = pairs, materialize(_possible(pairs, known, percent))
        discard(asked._reads)
        routes, done = _grouped(pairs)
        texts = _sent(routes, plain).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
        return texts.mapInArrow(_linked(words, percent), f"x {kind}, y {kind}").distinct(), [pairs, routes, *done]

    found = none
    total = members.count()
    often = members.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= CROWD).select("h")
    often = materialize(often)

    def alone(rows: DataFrame) -> DataFrame:
        return rows.withColumn("component", F.col("doc")).withColumn("met", F.lit(None).cast("bigint"))

    met = alone(members.select("h", "doc", "n").join(often, "h"))
    crowded = materialize(_with_partners(met, known, percent))
    rare = members.join(often, "h", "left_anti")
    label = plain.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    blocks = plain.sparkSession.createDataFrame([], f"doc {kind}, met bigint")

    def labelled(rows: DataFrame) -> DataFrame:
        rows = rows.join(blocks, "doc", "left").join(label, F.col("doc") == F.col("node"), "left")
        return rows.withColumn("component", F.coalesce("label", "doc")).drop("node", "label")

    named = alone(crowded)
    rest = rare.unionAll(members.join(crowded, ["h", "doc", "n"], "left_semi").select(*members.columns))
    if _cross_pairs(met) > FEW * total:
        told, done = _met_in_crowds(crowded.select("h", "doc"), chosen, plain, words, percent)
        told = materialize(told)
        blocks = materialize(told.where("met is not null").groupBy(F.col("x").alias("doc")).agg(F.min("met").alias("met")))
        found = materialize(told.where("met is null").select("x", "y").distinct())
        label = materialize(_spread(found))
        discard(told, *done)
        named = materialize(labelled(crowded))
        if _cross_pairs(named) > FEW * total:
            across, done = _met_across(named, known, chosen, plain, words, percent)
            more = materialize(found.unionAll(across).distinct())
            discard(found, *done)
            found, rest = more, rare
    discard(named)
    named = materialize(labelled(rest))
    good, done = verified(candidates(named, percent))
    last = materialize(found.unionAll(good).distinct())
    discard(found, named, members, known, often, crowded, label, blocks, *done)
    found = last
    return rows, components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: its set's size and its component, named by the smallest id."""
    rows, joined = links(docs, words, percent)
    out = rows.join(joined, F.col("rep") == F.col("node"), "left")
    return out.select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    )


def query(docs: DataFrame) -> DataFrame:
    return classes(docs, words=4, percent=85)
