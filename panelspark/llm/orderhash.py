"""Order MinHash fingerprints of documents, by SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE, Scratch, text_of, with_row

SHINGLE = 5  # words of a k-mer
SKETCHES = 64  # hash ranges; each gives a tuple
PER_SKETCH = 2  # minimal k-mers of a tuple: a pair, or one where the range holds no second
#: Layout of a packed long: 39 bits of hash, then 24 bits of position (longer texts fold the position).
_POSITION_BITS, _HASH_BITS = 24, 39
_POSITION_MASK, _HASH_MASK = (1 << _POSITION_BITS) - 1, (1 << _HASH_BITS) - 1
_BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _pack(hash_: Column, position: Column) -> Column:
    return F.shiftleft(hash_.bitwiseAND(F.lit(_HASH_MASK)), _POSITION_BITS).bitwiseOR(position.cast("long").bitwiseAND(F.lit(_POSITION_MASK)))


def _kmers(words: Column) -> Column:
    """Packed (k-mer hash, position), in order of text; a shorter text is one k-mer."""

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))),
            lambda i: _pack(F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]), i),
        )
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(many)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _numbered(ordered: Column) -> Column:
    """From k-mers in order of (hash, position): packed (hash of k-mer and occurrence number, position)."""

    def runs(s: Column) -> Column:
        def kmer(i: Column) -> Column:
            return F.shiftrightunsigned(F.get(s, i), _POSITION_BITS)

        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (kmer(i) != kmer(i - 1)))

        def of_starts(first: Column) -> Column:
            return F.flatten(F.transform(first, lambda at, j: F.transform(
                F.slice(s, at + 1, F.coalesce(F.get(first, j + 1), F.size(s)) - at),
                lambda x, t: _pack(F.xxhash64(F.shiftrightunsigned(x, _POSITION_BITS), t), x),
            )))

        single = F.transform(s, lambda x: _pack(F.xxhash64(F.shiftrightunsigned(x, _POSITION_BITS), F.lit(0)), x))
        hashes = F.array_distinct(F.transform(s, lambda x: F.shiftrightunsigned(x, _POSITION_BITS)))
        return F.when(F.size(hashes) == F.size(s), single).otherwise(_let(starts, of_starts))

    return _let(ordered, runs)


def _tuples(ordered: Column) -> Column:
    """From occurrence-numbered k-mers in order: for each hash range the hash of its minimal k-mers in
    order of text, as ``range << 26 | hash``."""
    bits = SKETCHES.bit_length() - 1
    shift = _POSITION_BITS + _HASH_BITS - bits

    def chosen(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < PER_SKETCH) | (
            F.shiftrightunsigned(F.get(s, i - PER_SKETCH), shift) != F.shiftrightunsigned(x, shift)))

    def hashed(q: Column) -> Column:
        def sketch(x: Column) -> Column:
            return F.shiftrightunsigned(x, shift)

        heads = F.filter(F.sequence(F.lit(0), F.size(q) - 1), lambda i: (i == 0) | (sketch(F.get(q, i)) != sketch(F.get(q, i - 1))))

        def position(x: Column) -> Column:
            return x.bitwiseAND(F.lit(_POSITION_MASK))

        def value(x: Column) -> Column:
            return F.shiftrightunsigned(x, _POSITION_BITS)

        def one(i: Column) -> Column:
            a, b = F.get(q, i), F.get(q, i + 1)
            pair = F.when(position(a) < position(b), F.xxhash64(value(a), value(b))).otherwise(F.xxhash64(value(b), value(a)))
            tuple_ = F.when(sketch(a) == sketch(b), pair).otherwise(F.xxhash64(value(a)))
            return F.shiftleft(sketch(a), 26).bitwiseOR(tuple_.bitwiseAND(F.lit((1 << 26) - 1)))

        return F.when(F.size(q) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(heads, one))

    return _let(_let(ordered, chosen), hashed)


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the signature of the whole text as an array with one entry for each hash range used.

    Of the word 5-mers, numbered by occurrence, the two with the smallest hashes in each of 64 ranges
    are taken in their order in the text and hashed together. Equal texts have equal signatures;
    moving or changing words changes the tuples that hold them. A text without words has none.
    """
    steps = df.withColumn(name, F.sort_array(_kmers(_words(text_of(text)))))
    steps = steps.withColumn(name, F.when(F.size(name) == 0, F.col(name)).otherwise(_numbered(F.col(name))))
    return steps.withColumn(name, F.sort_array(name)).withColumn(name, _tuples(F.col(name)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the hash ranges that either text uses; 1 for two texts without words."""
    used = F.size(F.array_union(F.transform(a, lambda x: F.shiftrightunsigned(x, 26)), F.transform(b, lambda x: F.shiftrightunsigned(x, 26))))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def next_rows(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``__row, __next``: the row that follows in the order of the columns (after the last: the first).

    Rows are range-partitioned; only the first row of each partition meets in one task."""
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = scratch.write(ranged, "order")
    firsts = ranged.groupBy("__part").agg(F.min(F.struct(*order)).alias("__first"))
    by_part = Window.orderBy("__part")  # one row per partition
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        "__part", F.coalesce(F.lead("__first").over(by_part), F.first("__first").over(whole)).alias("__after"))
    inside = ranged.withColumn("__lead", F.lead("__row").over(Window.partitionBy("__part").orderBy(*order)))
    return inside.join(firsts, "__part").select("__row", F.coalesce("__lead", F.col("__after.__row")).alias("__next"))


def edit_and_compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id``.

    The edited text ends with the beginning of the next text, by ascending key (null first; equal
    keys in the order of their rows), in place of its last half. A single row is its own next. Null
    text is empty. Whole texts go through one shuffle by row, half a text through a second.
    """
    scratch = Scratch(docs.sparkSession, "orderhash")
    # Both joins below read the same columns by row, so that one exchange of the texts serves them.
    rows = with_row(docs.select(F.col(key).alias("__key"), text_of(text).alias("__text")), scratch)
    n = F.length("__text")
    slim = rows.select("__key", "__row", n.alias("__n"))
    links = scratch.write(next_rows(slim, ["__key", "__row"], scratch).join(slim.select("__row", "__n"), "__row"), "links")
    heads = rows.join(
        links.select(F.col("__row").alias("__before"), F.col("__next").alias("__row"), F.floor(F.col("__n") / 2).cast("int").alias("__half")),
        "__row",
    ).select(F.col("__before").alias("__row"), F.col("__key").alias("__next_key"), F.substring("__text", F.lit(1), F.col("__half")).alias("__head"))
    both = rows.join(heads, "__row").withColumn(
        "__edited", F.concat(F.substring("__text", F.lit(1), n - F.floor(n / 2).cast("int")), "__head"))
    signed = fingerprint(fingerprint(both, "__text", "__own"), "__edited", "__other").select(
        "__row", "__key", "__next_key", n.alias("__n"), F.sha2("__edited", 256).alias("edited_sha256"), "__own", "__other")
    signed = scratch.write(signed, "signed")
    following = signed.select(F.col("__row").alias("__next"), F.col("__own").alias("__following"))
    out = signed.join(links.select("__row", "__next"), "__row").join(following, "__next")
    return out.select(
        F.col("__key").alias(key), F.col("__n").cast("long").alias("n_chars"), "edited_sha256",
        as_text(F.col("__own")).alias("fingerprint"), as_text(F.col("__other")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__other")).alias("near_edited"),
        likeness(F.col("__own"), F.col("__following")).alias("near_next"),
        F.col("__next_key").alias("next_id"),
    )
