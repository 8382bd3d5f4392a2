"""Removal of long repeated byte strings, by a sparse suffix array over anchored buckets.

A string of ``min_bytes`` bytes that starts at two places of the corpus is a repeat. Sorting the
suffixes at every byte would shuffle the corpus many times over, so suffixes are bucketed first:

1. *Anchors.* The anchor of a string is the position of the smallest hash among its ``GRAM``-byte
   substrings (rightmost on a tie). Equal strings have anchors at the same offset with equal
   hashes, and neighbouring strings mostly share theirs: one anchor for about 170 bytes. Strings
   whose anchor's hash occurs once are unique; they are dropped by counting hashes.
2. *Whole contexts.* All strings with the same anchor together span one context. Contexts that
   occur several times are repeats at once, without moving text.
3. *Cells.* What is left are contexts that share an anchor with different ones, the edges of
   repeats. They are cut by offset into cells of ``CELL`` neighbouring strings. All strings of a
   cell contain its core, so cells are bucketed by the core's hash; a core that occurs once has
   no repeats, and equal cells are repeats at once.
4. *Enhanced suffix array.* Of the other buckets, the suffixes (the bytes left of the core, the
   core as one symbol, the bytes right of it) are sorted, their common prefixes computed, and a
   stack scan yields the tree of common-prefix intervals of at least ``min_bytes``. An interval
   is a maximal repeat of its bucket if its occurrences are preceded by different bytes; those
   in the bucket are reported, but not those of copies, which one member stands for. A bucket with more than ``BUCKET_ROWS`` different cells (a passage common to
   very many documents, with different surroundings) is not collected: its strings are counted
   by offset and content instead, which covers the same bytes by other groups.

Every group is counted by partial aggregation; hot hashes meet in joins that adaptive execution
splits. The texts are shuffled twice, once for the cells and once for the removal; everything
else is narrow.

Nulls: a null text is empty; a null id is an id of its own. Rows are told apart by id and by a
64-bit checksum of the text; rows equal in both are copies, so all their strings are repeats. Texts
shorter than ``min_bytes`` have no strings. Matches never cross documents, overlapping
occurrences in one text count, and strings are judged on the input. An empty table gives an empty
result; extra columns are ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .textbytes import Hasher, mix, ragged, slices, window_argmin

MIN_BYTES = 400
GRAM = 64
CELL = 32
BUCKET_ROWS = 2048
OUT_ROWS = 65536
_NO_ID = -(1 << 63)
_STEP = 0x9E3779B97F4A7C15  # odd, so a bucket's repeats get different groups

_ANCHORS = "_id long, _sig long, h long, f long, a int, lo int, hi int"
_CELLS = "_id long, _sig long, done boolean, k1 long, k2 long, ends long, core int, left binary, right binary"
_SPANS = "group long, _id long, _sig long, start int, stop int"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _find_anchors(min_bytes: int, gram: int):
    """Per document: its anchors, the range of starts that share each, and a hash of their
    whole context."""
    windows = min_bytes - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                n = len(buf) - min_bytes + 1
                if n <= 0:
                    continue
                grams = Hasher(buf).grams(gram)
                anchor = window_argmin(grams, windows)
                # A start is valid if its string ends in its own document.
                valid = np.zeros(n + 1, dtype=np.int32)
                begins, ends = off[:-1], off[1:] - min_bytes + 1
                long_enough = ends > begins
                np.add.at(valid, begins[long_enough], 1)
                np.add.at(valid, ends[long_enough], -1)
                starts = np.flatnonzero(np.cumsum(valid[:n]) > 0)
                if not len(starts):
                    continue
                at = anchor[starts]
                new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                lo, hi = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
                at = at[new]
                doc = np.searchsorted(off, at, side="right") - 1
                h = grams[at]
                f = mix(Hasher(buf, 1).span(lo, hi + min_bytes) ^ (at - lo).astype(np.uint64) << np.uint64(32) ^ (hi - lo).astype(np.uint64))
                base = off[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("_id").take(pa.array(doc)),
                        rows.column("_sig").take(pa.array(doc)),
                        pa.array(_signed(h)),
                        pa.array(_signed(f)),
                        *(pa.array((x - base).astype(np.int32)) for x in (at, lo, hi)),
                    ],
                    names=["_id", "_sig", "h", "f", "a", "lo", "hi"],
                )

    return run


def _binary(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    length = stop - start
    offsets = np.zeros(len(length) + 1, dtype=np.int32)
    np.cumsum(length, out=offsets[1:])
    data = np.ascontiguousarray(buf[ragged(start, length)])
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _cut_cells(min_bytes: int, cell: int):
    """Cells of the listed anchors: bucket (hashes of the core), hash of the ends, the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                listed = rows.column("anchors")
                counts = listed.value_lengths().to_numpy(zero_copy_only=False)
                fields = listed.flatten()
                h, a, lo, hi = (fields.field(k).to_numpy(zero_copy_only=False) for k in ("h", "a", "lo", "hi"))
                done = fields.field("done").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(rows.num_rows), counts)
                a, lo, hi = a.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)
                first, last = (a - hi) // cell, (a - lo) // cell
                j = ragged(first, last - first + 1)
                own = np.repeat(np.arange(len(a)), last - first + 1)
                base, core = off[doc[own]], a[own] - j * cell
                tail = core - cell + 1 + min_bytes
                begin = np.maximum(lo[own], core - cell + 1)
                end = np.minimum(hi[own], core) + min_bytes
                one, two = Hasher(buf), Hasher(buf, 1)
                tag = mix(h[own].view(np.uint64) + j.astype(np.uint64))
                k1 = mix(one.span(core + base, tail + base) ^ tag)
                k2 = mix(two.span(core + base, tail + base) + tag)
                sides = ((core - begin) * (1 << 16) + (end - tail)).astype(np.uint64)
                ends = mix(mix(two.span(begin + base, core + base) + sides) ^ two.span(tail + base, end + base))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("_id").take(pa.array(doc[own])),
                        rows.column("_sig").take(pa.array(doc[own])),
                        pa.array(done[own].astype(bool)),
                        pa.array(_signed(k1)),
                        pa.array(_signed(k2)),
                        pa.array(_signed(ends)),
                        pa.array(core.astype(np.int32)),
                        _binary(buf, begin + base, core + base),
                        _binary(buf, tail + base, end + base),
                    ],
                    names=["_id", "_sig", "done", "k1", "k2", "ends", "core", "left", "right"],
                )

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def maximal_repeats(members: list[tuple[bytes, bytes]], cell: int, core_bytes: int, min_bytes: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of one bucket: (length, occurrences as (member, bytes before the core)).

    ``members`` are the bytes left and right of the bucket's core. The enhanced suffix array
    holds the suffixes that start at or before the core and reach ``min_bytes``; the stack scan
    of their common prefixes visits the interval tree from the bottom up.
    """
    suffixes = []
    for m, (left, right) in enumerate(members):
        n = len(left)
        for t in range(cell - 1 - len(right), n + 1):
            suffixes.append((t, left[n - t :], right, m))
    suffixes.sort()

    def closed(value: int, begin: int, end: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        before = set()
        for t, _, _, m in suffixes[begin:end]:
            left = members[m][0]
            before.add(left[len(left) - t - 1] if t < len(left) else ~m)  # outside the cell: unlike any other
            if len(before) > 1:
                yield value, [(m, t) for t, _, _, m in suffixes[begin:end]]
                return

    stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
    for i in range(1, len(suffixes) + 1):
        value = 0
        if i < len(suffixes):
            s, t = suffixes[i - 1], suffixes[i]
            if s[0] == t[0] and s[1] == t[1]:
                value = s[0] + core_bytes + _common(s[2], t[2])
        if value < min_bytes:
            value = 0
        begin = i - 1
        while stack and stack[-1][0] > value:
            shared, begin = stack.pop()
            yield from closed(shared, begin, i)
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, begin))


def _scan_buckets(min_bytes: int, cell: int):
    """Suffix arrays of the buckets of a partition sorted by bucket; a bucket may go on in the
    next batch."""
    core_bytes = min_bytes - cell + 1

    def scan(bucket: list[tuple]) -> Iterable[tuple]:
        members = [(left, right) for *_, left, right in bucket]
        for i, (length, places) in enumerate(maximal_repeats(members, cell, core_bytes, min_bytes)):
            for m, t in places:
                k1, _, row, sig, core, _, _ = bucket[m]
                if row is not None:
                    # Repeats come in the order of their suffixes, so the i-th is the same at every run.
                    group = (k1 + i * _STEP + (1 << 63)) % (1 << 64) - (1 << 63)
                    yield group, row, sig, core - t, core - t + length

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["group", "_id", "_sig", "start", "stop"])

    def tables(bucket: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = iter(scan(bucket))
        while rows := list(islice(found, OUT_ROWS)):
            yield table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket and row[:2] != bucket[0][:2]:
                    yield from tables(bucket)
                    bucket = []
                bucket.append(row)
        if bucket:
            yield from tables(bucket)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)),
            "_sig": F.xxhash64(text),
            "text": text,
        }
    )


def _spans(keyed: DataFrame, min_bytes: int, gram: int, cell: int, bucket_rows: int) -> DataFrame:
    """Occurrences (group, _id, _sig, start, stop) of repeats in the keyed texts."""
    key = ["_id", "_sig"]
    anchors = materialize(keyed.select(*key, "text").mapInArrow(_find_anchors(min_bytes, gram), _ANCHORS))
    # Tables of hashes are written before rows are joined with them: a hot hash's rows can then be split.
    shared = materialize(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    kept = materialize(anchors.join(shared, "h", "left_semi"))

    me = F.xxhash64(*key, "a")
    context = kept.groupBy("h", "f").agg(F.count(F.lit(1)).alias("m"), F.min(me).alias("rep"))
    kinds = context.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    context = materialize(context.join(kinds, "h"))
    known = materialize(kept.join(context, ["h", "f"]))
    whole = known.where("m > 1").select(
        F.xxhash64("h", "f").alias("group"), *key, F.col("lo").alias("start"), (F.col("hi") + min_bytes).alias("stop")
    )

    # One of several equal contexts stands for them when others are compared with it.
    edge = known.where((F.col("kinds") > 1) & ((F.col("m") == 1) | (me == F.col("rep"))))
    # Rows equal in id and text give equal anchors: each stands once.
    listed = edge.groupBy(*key).agg(F.collect_set(F.struct("h", "a", "lo", "hi", (F.col("m") > 1).alias("done"))).alias("anchors"))
    cells = keyed.join(listed, key).select(*key, "text", "anchors").mapInArrow(_cut_cells(min_bytes, cell), _CELLS)
    cells = materialize(cells.withColumn("_n", F.monotonically_increasing_id()))
    bucket = ["k1", "k2"]
    shared = cells.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*bucket)
    cells = materialize(cells.join(materialize(shared), bucket, "left_semi"))
    # Kinds carry numbers only; the bytes of one that stands for equal ones are those of its first cell.
    kind = cells.groupBy(*bucket, "ends").agg(F.count(F.lit(1)).alias("m"), F.max("done").alias("_done"), F.min("_n").alias("_first"))
    size = kind.groupBy(*bucket).agg(F.count(F.lit(1)).alias("kinds"))
    kind = materialize(kind.join(size, bucket))
    every = cells.join(kind, [*bucket, "ends"])
    known = every.where("not done")
    t_low = F.lit(cell - 1) - F.length("right")
    equal = known.where("m > 1").select(
        F.xxhash64(*bucket, "ends").alias("group"),
        *key,
        (F.col("core") - F.length("left")).alias("start"),
        (F.col("core") - t_low + min_bytes).alias("stop"),
    )

    # Cells with other cells in their bucket: single ones to be judged, one of equal ones to compare with.
    cols = [*bucket, "_id", "_sig", "core", "left", "right"]
    single = known.where("m = 1 and kinds > 1").select(*cols, "kinds")
    none = [F.lit(None).cast("long").alias("_id"), F.lit(None).cast("long").alias("_sig"), F.lit(0).alias("core")]
    several = every.where("kinds > 1 and (m > 1 or _done) and _n = _first").select(*bucket, *none, "left", "right", "kinds")
    compared = single.unionByName(several)

    small = compared.where(F.col("kinds") <= bucket_rows).select(*cols)
    small = small.repartition(*bucket).sortWithinPartitions(*bucket)
    scanned = small.mapInArrow(_scan_buckets(min_bytes, cell), _SPANS)

    large = compared.where(F.col("kinds") > bucket_rows)
    large = large.withColumn("t", F.explode(F.sequence(t_low, F.length("left"))))
    here = [
        F.expr("substring(left, length(left) - t + 1, t)").alias("_l"),
        F.expr(f"substring(right, 1, {cell - 1} - t)").alias("_r"),
    ]
    large = large.select(*bucket, "_id", "_sig", "core", "t", F.xxhash64(*bucket, "t", *here).alias("group"), F.hash(*here).alias("_check"))
    twice = large.groupBy("group", "_check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "_check")
    counted = large.where("_id is not null").join(twice, ["group", "_check"], "left_semi")
    counted = counted.select("group", *key, (F.col("core") - F.col("t")).alias("start"), (F.col("core") - F.col("t") + min_bytes).alias("stop"))
    return whole.unionByName(equal).unionByName(scanned).unionByName(counted)


def repeats(
    docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, cell: int = CELL, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Places of repeats: (group, doc_id, start, stop) in bytes; rows of one group hold equal bytes.

    Every byte of a repeat is covered, but a group is not a maximal repeat with all its occurrences:
    repeats are cut at the ranges of their anchors and at cells, copies are reported in groups of
    their own and not in those of other texts that share a part of them, and buckets of more than
    ``bucket_rows`` kinds give strings of ``min_bytes`` bytes."""
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = _spans(keyed, min_bytes, gram, cell, bucket_rows)
    return spans.select("group", F.when(F.col("_id") != _NO_ID, F.col("_id")).alias("doc_id"), "start", "stop")


def _merged(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each row's spans: (first run of each row and of the end, starts, stops).

    Spans stay arrays of numbers: a text inside many repeats has thousands of them."""
    n = len(spans)
    row = np.repeat(np.arange(n), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) << 32
    flat = spans.flatten()
    start, stop = (row + flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop"))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    lasts = np.append(heads[1:], len(start))[: len(heads)] - 1
    low = (1 << 32) - 1
    return np.searchsorted(start[heads] >> 32, np.arange(n + 1)), start[heads] & low, reach[lasts] & low


def _cut(with_text: bool):
    """Takes the covered bytes out of each text; adds counts and the checksum of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            first, start, stop = _merged(batch.column(names.index("spans")))
            rest, removed, runs, sums = [], [], [], []
            for i, value in enumerate(batch.column(names.index("text"))):
                data = value.as_buffer().to_pybytes()
                kept, at, gone = [], 0, 0
                for k in range(first[i], first[i + 1]):
                    s, e = int(start[k]), int(stop[k])
                    kept.append(data[at:s])
                    at, gone = e, gone + e - s
                left = b"".join([*kept, data[at:]]) if kept else data
                rest.append(left.decode("utf-8", "ignore") if with_text else None)
                removed.append(gone)
                runs.append(len(kept))
                sums.append(hashlib.sha256(left).hexdigest())
            keep = [i for i, name in enumerate(names) if name not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in keep),
                    pa.array(rest, pa.string()),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(sums, pa.string()),
                ],
                names=[*(names[i] for i in keep), "rest", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _removed(keyed: DataFrame, others: list[str], with_text: bool, **limits: int) -> DataFrame:
    found = _spans(keyed, **limits).groupBy("_id", "_sig").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = keyed.join(found, ["_id", "_sig"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("_id", *others)] + ["rest string, n_removed long, n_spans long, kept_sha256 string"])
    return rows.select("_id", *others, "text", "spans").mapInArrow(_cut(with_text), schema)


def without_repeats(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    gram: int = GRAM,
    cell: int = CELL,
    bucket_rows: int = BUCKET_ROWS,
    drop_emptied: bool = False,
) -> DataFrame:
    """``docs`` without the bytes of repeats; all other columns stay (``n_chars``, if there, is
    counted anew). The other bytes of a character that a repeat cuts through go with it.
    With ``drop_emptied``, documents of which nothing but white space is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_c{i}" for i, c in enumerate(others)}
    keyed = _keyed(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    limits = {"min_bytes": min_bytes, "gram": gram, "cell": cell, "bucket_rows": bucket_rows}
    out = _removed(keyed, list(names.values()), True, **limits)
    if drop_emptied:
        out = out.where("n_removed = 0 or rest rlike '[^\\\\s]'")
    new = {"doc_id": F.when(F.col("_id") != _NO_ID, F.col("_id")), "text": F.col("rest")}
    new |= {c: F.col(n) for c, n in names.items()}
    out = out.select(*(new[c].alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs.select("doc_id", "text"))
    keyed = keyed.withColumn("_bytes", F.octet_length("text").cast("long"))
    out = _removed(keyed, ["_bytes"], False, min_bytes=MIN_BYTES, gram=GRAM, cell=CELL, bucket_rows=BUCKET_ROWS)
    doc_id = F.when(F.col("_id") != _NO_ID, F.col("_id")).alias("doc_id")
    return out.select(doc_id, F.col("_bytes").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
