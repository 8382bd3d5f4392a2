"""Groups of spelling variants: words one edit apart, and the form each one stands for.

Words are maximal runs of letters of the texts, lower-cased in A-Z, with their counts over all
documents. Two words are near if they differ by exactly one inserted, deleted or replaced code
point. Then the common prefix and the common suffix together reach the longer length less one,
so one of the two reaches half of that, rounded up: every near pair whose longer word has M code
points shares its first or its last ``ceil((M - 1) / 2)`` of them.

* Words are sorted by these halves, by Spark. A half shared by more than ``BLOCK`` words is cut
  into blocks by hash, and pairs of blocks are compared, so a task holds two blocks at most.
* Within a block, words are padded matrices of code points, one aligned left, one right. Tiles
  of rows against tiles of rows give common prefix and suffix lengths; a pair is found in the
  first half's block, or in the last half's if its prefix is shorter than the half: once.
* A tile returns per word the number of its near words and the best of them, never the pairs.

``forms`` follows: a word's form is its near word of largest count (ties: the smallest), if that
is ``RATIO`` times its own count or more; its root is reached by following forms, whose counts
grow by that factor at each step, so a chain is short and doubled links end in a few rounds.

A null text has no words; a null id counts as an empty one. Repeated rows count as often as they
stand. Words of equal count: the smaller in code-point order is the form. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .sharding import CRC_POLYNOMIAL

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DROP = 31
BLOCK = 2048
TILE = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUP = ["bucket", "low", "high"]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points and ``min_count`` occurrences.

    One run in ``drop`` (by the checksum of its document's id and itself) loses a code point.
    Only runs of ``min_length`` or more can give such a word, so shorter ones are left in the text.
    """
    lowered = F.translate(F.col("text"), _UPPER, _LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", h.alias("h"), (F.pmod("h", F.length("run")) + 1).cast("int").alias("at"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at") - 1), F.substring("run", F.col("at") + 1, F.length("run")))
    word = F.when(F.pmod("h", F.lit(drop)) == 0, cut).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def _halves(words: DataFrame) -> DataFrame:
    """Rows (bucket, m, last, size, word, n): each word under both halves, as the longer or an equally long
    word of a pair (m: its length) and as the shorter one (m: one more)."""
    size = F.length("word")
    sides = []
    for more in (0, 1):
        m = (size + more).cast("int")
        half = F.ceil((m - 1) / 2).cast("int")
        for last in (False, True):
            part = F.substring("word", size - half + 1, half) if last else F.substring("word", F.lit(1), half)
            sides.append(F.struct(F.xxhash64(m, F.lit(last), part).alias("bucket"), m.alias("m"), F.lit(last).alias("last")))
    rows = words.select(size.cast("int").alias("size"), "word", "n", F.explode(F.array(*sides)).alias("s"))
    return rows.select("s.*", "size", "word", "n")


def _points(words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded at the right and at the left, a row for each code point's place."""
    longest = max(int(size.max()), 1)
    left = np.array(words, dtype=f"U{longest}").view(np.uint32).reshape(len(words), longest)
    at = np.arange(longest)[None, :] - (longest - size)[:, None]
    right = np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), 1), 0)[:, ::-1]
    narrow = np.uint8 if left.max() < 256 else np.uint32
    return np.ascontiguousarray(left.T.astype(narrow)), np.ascontiguousarray(right.T.astype(narrow))


def _common(points: np.ndarray, rows: np.ndarray, cols: slice, shorter: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all pairs of a tile."""
    alive = np.ones((len(rows), cols.stop - cols.start), dtype=bool)
    total = np.zeros(alive.shape, dtype=np.int16)
    for place in points:
        alive &= place[rows][:, None] == place[cols][None, :]
        total += alive
    return np.minimum(total, shorter)


def _near_pairs(group: np.ndarray, m: np.ndarray, last: np.ndarray, side: np.ndarray, same: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words within groups; ``group`` ascends. Rows of a tile are words of the
    group's longer length."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    left, right = _points(words, size)
    longer = np.flatnonzero(size == m)
    begin, end = np.searchsorted(group, group, "left"), np.searchsorted(group, group, "right")
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(0, len(longer), TILE):
        rows = longer[t : t + TILE]
        for c in range(begin[rows[0]], end[rows[-1]], 4 * TILE):
            cols = slice(c, min(c + 4 * TILE, int(end[rows[-1]])))
            index = np.arange(cols.start, cols.stop)
            wanted = (group[rows][:, None] == group[cols][None, :]) & ((size[cols] < m[cols])[None, :] | (index[None, :] > rows[:, None]))
            wanted &= same[rows][:, None] | (side[rows][:, None] != side[cols][None, :])
            if not wanted.any():
                continue
            shorter = np.minimum(size[rows][:, None], size[cols][None, :])
            prefix = _common(left, rows, cols, shorter)
            suffix = _common(right, rows, cols, shorter)
            half = (m[rows] // 2)[:, None]  # ceil((m - 1) / 2)
            wanted &= prefix + suffix >= (m[rows] - 1)[:, None]
            wanted &= np.where(last[rows][:, None], (prefix < half) & (suffix >= half), prefix >= half)
            i, j = np.nonzero(wanted)
            out.append((rows[i], index[j]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*out))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the groups of a partition sorted by group; the last group of a batch may go on
    in the next one."""

    def scan(t: pa.Table) -> pa.RecordBatch | None:
        key = [t[c].to_numpy() for c in _GROUP]
        new = np.ones(len(t), dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        if not many.any():
            return None
        t, group = t.filter(pa.array(many)), group[many]
        words, n = t["word"].to_pylist(), t["n"].to_numpy()
        i, j = _near_pairs(group, *(t[c].to_numpy().astype(kind) for c, kind in (("m", np.int64), ("last", bool), ("side", np.int64), ("same", bool))), words)
        if not len(i):
            return None
        name, word = np.unique(np.array(words), return_inverse=True)  # ascending code points
        a, b = np.concatenate([word[i], word[j]]), np.concatenate([word[j], word[i]])
        count = np.zeros(len(name), np.int64)
        count[word] = n
        order = np.lexsort((b, -count[b], a))
        first = order[np.searchsorted(a[order], np.unique(a))]
        near = np.bincount(a, minlength=len(name))
        return pa.RecordBatch.from_arrays(
            [pa.array(name[a[first]].tolist(), pa.string()), pa.array(near[a[first]].astype(np.int64)), pa.array(count[b[first]]), pa.array(name[b[first]].tolist(), pa.string())],
            names=["word", "near", "other_n", "other"],
        )

    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if carry is None else pa.concat_tables([carry, t])
        keys = [t[c].to_numpy() for c in _GROUP]
        final = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        cut = int(final[-1]) + 1 if len(final) else 0
        carry = t.slice(cut)
        if cut and (found := scan(t.slice(0, cut))) is not None:
            yield found
    if carry is not None and (found := scan(carry)) is not None:
        yield found


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, other): number of near words and the best of them, for words that have one."""
    rows = _halves(words)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK)
    blocks = sizes.select("bucket", F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int").alias("blocks"))
    cut = rows.join(blocks, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("side", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # A row goes to the pair of its block with each block, itself included.
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "with"), F.greatest("side", "with")
    cut = cut.withColumns({"same": low == high, "low": low, "high": high})
    cut = cut.select(*_GROUP, "m", "last", "side", "same", "word", "n")
    cut = cut.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = cut.mapInArrow(_compare, "word string, near long, other_n long, other string")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.minus")).alias("other_n"), F.col("best.other").alias("other"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: links are doubled until none goes on."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = links.join(on, "root", "left")
        longer = materialize(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return links


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``words`` (word, n): its form, its root and counts."""
    words = materialize(words.select("word", "n"))
    near = near_words(words)
    takes = F.col("other_n") >= F.lit(ratio) * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("other")).alias("form"), F.when(takes, F.col("other_n")).alias("form_n")
    )
    rows = materialize(rows)
    roots = _roots(rows.where("form is not null"))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return forms(word_counts(docs))


def oracle_sql() -> str:
    """The same rows in DuckDB. Near words meet by patterns: a word with one code point masked
    (replaced), or a word less one code point (deleted)."""
    return f"""
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: case when c % 2 = 1 then xor(c >> 1, {CRC_POLYNOMIAL}) else c >> 1 end)) as t
), runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]{{{MIN_LENGTH},}}')) as run
  from documents
), counted as (
  select id, run, count(*) as c, hex(encode(id || ':' || run)) as h, octet_length(encode(id || ':' || run)) as bytes from runs group by id, run
), summed as (
  select run, c,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(bytes), lambda i: ('0x' || substr(h, 2 * i::bigint + 1, 2))::bigint)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint as crc
  from counted, crc_table
), spelled as (
  select c, case when crc % {DROP} = 0 then left(run, (crc % length(run))::bigint) || substr(run, (crc % length(run))::bigint + 2) else run end as word from summed
), words as materialized (
  select word, sum(c)::bigint as n from spelled where length(word) >= {MIN_LENGTH} group by word having sum(c) >= {MIN_COUNT}
), places as (
  select word, unnest(range(1, length(word) + 1)) as i from words
), masked as (
  select word, i, left(word, i - 1) || '*' || substr(word, i + 1) as pattern, left(word, i - 1) || substr(word, i + 1) as shorter from places
), pairs as (
  select a.word, b.word as other from masked a join masked b on a.pattern = b.pattern and a.i = b.i and a.word <> b.word
  union select m.word, w.word from masked m join words w on m.shorter = w.word
  union select w.word, m.word from masked m join words w on m.shorter = w.word
), best as (
  select p.word, count(*) as n_near, max(w.n) as other_n,
         first(p.other order by w.n desc, p.other) as other
  from pairs p join words w on w.word = p.other group by p.word
), formed as materialized (
  select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near,
         case when b.other_n >= {RATIO} * w.n then b.other end as form, case when b.other_n >= {RATIO} * w.n then b.other_n end::bigint as form_n
  from words w left join best b using (word)
), chain(word, place, step) as (
  select word, word, 0 from formed
  union all
  select c.word, f.form, c.step + 1 from chain c join formed f on f.word = c.place where f.form is not null
), rooted as (
  select word, arg_max(place, step) as root from chain group by word
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join rooted r using (word)
"""
