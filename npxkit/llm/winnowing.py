"""Document fingerprints by winnowing, built from SQL expressions only.

A text's tokens are its runs of other characters than space and 0x09-0x0D; in runs of more than
``WORD`` code points (text without spaces, addresses, encoded data) each code point is a token, so
an inserted one changes the grams around it and no others. Grams are the strings of ``K``
consecutive tokens, rolling by one token, hashed to 32 bits. Of each window of ``W`` consecutive
grams the smallest hash is chosen, the rightmost on a tie; the chosen hashes with their positions
(numbers of their first tokens) are the fingerprint. Two texts that share ``W + K - 1`` consecutive
tokens choose a common hash there, and its positions tell where.

Window minima come from doubling: the minima of windows of 2s grams are the smaller ones of two
windows of s grams, so a text takes log2(W) passes over its grams, inside its row.

Nulls: a null text is an empty text. A text without tokens has an empty fingerprint; a text
of fewer tokens than a gram has one gram, a text of fewer grams than a window has one window.
The likeness of two fingerprints is the Jaccard similarity of their sets of hashes (two empty
ones: 1). The cost of a text is linear in its length. Documents follow
each other by id (null first), equal ids by text; repeated rows are documents of their own. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import partitions

WORD = 32
K = 3
W = 8
_POS_BITS = 31
_POS = (1 << _POS_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lowest(packed: Column, w: int) -> Column:
    """Minima of all windows of packed grams (hash above, position counted down below, so that
    the smaller of two equal hashes is the later one)."""

    def widen(v: Column, span: int) -> Column:
        step = min(span, w - span)
        if not step:
            return F.slice(v, F.lit(1), F.greatest(F.size(v) - w + 1, F.lit(1)))
        # Past the end there is no gram, which ``least`` skips; such windows are cut off above.
        return _let(F.transform(v, lambda x, i: F.least(x, F.get(v, i + step))), lambda z: widen(z, span + step))

    return widen(packed, 1)


def tokens(text: Column) -> Column:
    one = "[^\\x20\\x09-\\x0D]"
    return F.regexp_extract_all(text, F.lit(f"(?<!{one}){one}{{1,{WORD}}}+(?!{one})|{one}"), F.lit(0))


def _chosen(text: Column, k: int, w: int) -> Column:
    """Packed chosen grams of a non-null text, in order of position, each once."""

    def gram(t: Column) -> Callable[[Column, Column], Column]:
        def packed(x: Column, i: Column) -> Column:
            h = F.xxhash64(x, *[F.get(t, i + j) for j in range(1, k)]).bitwiseAND(F.lit(0xFFFFFFFF))
            return F.shiftleft(h, _POS_BITS) + (F.lit(_POS) - i)

        return packed

    def whole(t: Column) -> Column:
        full = F.slice(F.transform(t, gram(t)), F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1)))
        chosen = _let(full, lambda packed: F.array_distinct(_lowest(packed, w)))
        return F.when(F.size(t) > 0, chosen).otherwise(F.array().cast("array<bigint>"))

    return _let(tokens(text), whole)


def packed_fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprint of a text as longs, hash above and position below, by position."""
    return _chosen(F.coalesce(text, F.lit("")), k, w)


def unpacked(packed: Column) -> Column:
    """Packed fingerprints as arrays of (hash, pos), by position."""
    return F.transform(
        packed,
        lambda s: F.struct(
            F.shiftright(s, _POS_BITS).alias("hash"), (F.lit(_POS) - s.bitwiseAND(F.lit(_POS))).cast("int").alias("pos")
        ),
    )


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprint of a text: array of (hash, pos), by position."""
    return unpacked(packed_fingerprint(text, k, w))


def hashes_of(packed: Column) -> Column:
    """The hashes of a packed fingerprint as a sorted set of ints."""
    signed = F.transform(packed, lambda s: (F.shiftright(s, _POS_BITS) - F.lit(1 << 31)).cast("int"))
    return F.sort_array(F.array_distinct(signed))


def hash_set(text: Column, k: int = K, w: int = W) -> Column:
    """The hashes of a text's fingerprint as a sorted set of ints."""
    return hashes_of(packed_fingerprint(text, k, w))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.when(union == 0, F.lit(1.0)).otherwise(union))


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``prepare(docs)`` with a struct ``_next`` of the given columns of the next document by id
    (after the last: the first). ``prepare`` adds columns row by row.

    Ids are cut into ranges, a few for each shuffle partition, and a window runs within each
    range: one shuffle. Only the first document of a range is needed by another one, and
    there are at most as many as ranges, so that table is bounded and broadcast.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("double").alias("i"))
    low, high = ids.agg(F.percentile_approx("i", [0.001, 0.999], 10000)).first()[0] or (0.0, 1.0)  # no id at all
    ranges = 8 * partitions(spark)
    width = max((high - low) / ranges, 1e-9)
    place = F.floor((F.col("doc_id").cast("double") - F.lit(low)) / F.lit(width))
    # ``least`` and ``greatest`` skip a null, so null ids get their range, the first one, here.
    place = F.when(F.col("doc_id").isNull(), F.lit(-2)).otherwise(F.greatest(F.lit(-1), F.least(F.lit(ranges), place))).cast("int")
    rows = prepare(docs).withColumn("_range", place)
    by_id = Window.partitionBy("_range").orderBy("doc_id", *columns)
    rows = rows.withColumn("_next", F.lead(F.struct(*columns)).over(by_id))

    ends = docs.select("doc_id", place.alias("_range")).groupBy("_range").agg(F.min("doc_id").alias("_first"))
    around = Window.orderBy("_range")
    after = F.lead(F.struct("_first")).over(around)
    home = F.first(F.struct("_first")).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("_range", F.coalesce(after, home)["_first"].alias("_after"))
    wanted = ends.select(F.col("_after").alias("_id")).distinct()
    heads = docs.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")))
    heads = prepare(heads).groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_head"))
    heads = ends.join(heads, F.col("_after").eqNullSafe(F.col("doc_id"))).select(F.col("_range").alias("_r"), "_head")
    # The rows are already placed by range, so only the heads move.
    rows = rows.join(heads, F.col("_range") == F.col("_r"), "left")
    return rows.withColumn("_next", F.coalesce("_next", "_head")).drop("_range", "_r", "_head")


def compare_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document's fingerprint and that of its edited text, as arrays of (hash, pos), their sets
    of hashes, the number of places that both have, and the likeness of its own to the edited text's
    and to the next document's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"))
    rows = with_next(plain, lambda d: d.withColumn("_own", packed_fingerprint(F.col("text"), k, w)), ["text", "_own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("_next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "_own", F.col("_next._own").alias("_other"), edited.alias("_edited"))
    rows = rows.withColumn("_new", packed_fingerprint(F.col("_edited"), k, w))
    sets = {c: hashes_of(F.col(p)) for c, p in (("hashes", "_own"), ("edited_hashes", "_new"), ("_others", "_other"))}
    return rows.withColumns(sets).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        unpacked(F.col("_own")).alias("places"),
        unpacked(F.col("_new")).alias("edited_places"),
        # Longs meet in a hash set; arrays of structs would be compared element by element.
        F.size(F.array_intersect("_own", "_new")).alias("unedited_places"),
        "hashes",
        "edited_hashes",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("_others")).alias("near_next"),
    )


def _digest(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes.cast("array<string>"), ",").cast("binary"))


def query(docs: DataFrame) -> DataFrame:
    """One row per document; a fingerprint's column is the md5 of its sorted set of hashes, so
    fingerprints are equal exactly where the likeness is 1. ``n_places`` counts its places and
    ``unedited_places`` those that the edited text has at the same positions."""
    return compare_edited(docs).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _digest(F.col("hashes")).alias("fingerprint"),
        _digest(F.col("edited_hashes")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("hashes").alias("n_hashes"),
        F.size("places").alias("n_places"),
        "unedited_places",
    )
