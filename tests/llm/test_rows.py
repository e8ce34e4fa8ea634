"""Rows keep their identity in any frame, under any names; draws depend on content alone."""

from __future__ import annotations

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelspark.llm import exact, mixing, neardup, orderhash, ppm, quality, substring, tokens
from panelspark.llm.common import Memory, Scratch, WordHashes, table, with_row


def _twice(spark, small):
    other = spark.createDataFrame([(1,), (2,)], "n int")
    return {
        "exploded": small.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n"),
        "joined": small.crossJoin(other).drop("n"), "united": small.unionByName(small),
    }


@pytest.fixture(scope="module")
def few(spark, sf):
    return table(spark, sf, "documents").filter("doc_id < 40")


def _rows(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("how", ["exploded", "joined", "united"])
def test_repeated_rows(spark, few, how):
    twice, scratch = _twice(spark, few)[how], Scratch(spark, "t")
    n = few.count()
    assert with_row(twice, scratch).select("__row").distinct().count() == 2 * n
    copies = exact.find_copies(twice)
    assert copies.count() == 2 * n and copies.filter("group_size >= 2").count() == 2 * n
    assert _rows(exact.drop_copies(twice)) == _rows(exact.drop_copies(few))
    assert _rows(neardup.drop_near_duplicates(twice)) == _rows(neardup.drop_near_duplicates(few))
    once = _rows(mixing.mix_rows(few, max_repeats=1.0))
    assert _rows(mixing.mix_rows(twice, max_repeats=1.0)) == collections.Counter({r: 2 * k for r, k in once.items()})
    assert orderhash.edit_and_compare(twice).count() == 2 * n
    removed = substring.remove_repeats(twice).collect()
    assert len(removed) == 2 * n and all(r.n_removed == r.n_words for r in removed if r.n_words >= 35)


def test_files_keep_their_addresses(spark, few):
    plain = few.select("doc_id", "text").filter("doc_id % 2 = 0")
    assert with_row(plain, Scratch(spark, "t")).filter("__row.file = 0").count() == 0


def test_names_of_working_columns(few):
    plain = few.select("doc_id", "text", "source")
    odd = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["__row", "__text", "__key", "__source", "c0", "c1", "kept", "__score"])])
    path = public_tokenizers.path("byte_bpe_50k.json")
    jobs = {
        "copies": lambda d: exact.find_copies(d).drop("__row"), "near": lambda d: neardup.near_duplicates(d).drop("__row", "first"),
        "order": orderhash.edit_and_compare, "repeats": substring.remove_repeats, "tokens": lambda d: tokens.token_report(d, path),
        "ppm": lambda d: ppm.score(d, quality.remainder("doc_id", 7) != 2, order=2),
    }
    for name, job in jobs.items():
        assert _rows(job(odd)) == _rows(job(plain)), name
    for job in (exact.drop_copies, neardup.drop_near_duplicates, lambda d: mixing.mix_rows(d, max_repeats=2.0)):
        out = job(odd)
        assert out.columns == odd.columns
    assert _rows(exact.drop_copies(odd).select(*plain.columns)) == _rows(exact.drop_copies(plain))
    assert sum(r.n for r in tokens.add_token_counts(odd, path, name="n").collect()) == sum(r.n for r in tokens.add_token_counts(plain, path, name="n").collect())


@pytest.mark.parametrize("kind", ["string", "long", "date", "decimal(20,2)"])
def test_keys_of_any_kind(spark, kind):
    values = {"string": ["b", "a", None, "c"], "long": [5, -(2**63), None, 7]}.get(kind, [None] * 4)
    rows = [(values[0], "same text"), (values[1], "same  text"), (values[2], "sametext"), (values[3], "other")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact.find_copies(df).collect()}
    best = values[1]  # the longest text
    assert got == {(values[0], best, 3), (values[1], best, 3), (values[2], best, 3), (values[3], values[3], 1)}
    df = spark.createDataFrame([(v, "same text") for v in values], f"doc_id {kind}, text string")
    least = min((v for v in values if v is not None), default=None)
    assert {r.keep_id for r in exact.find_copies(df).collect()} == {least}


def test_draw_depends_on_content(spark, sf):
    docs = table(spark, sf, "documents")
    scratch = Scratch(spark, "t")
    layouts = [scratch.write(docs, "a"), scratch.write(docs.repartition(7, "text"), "b"), scratch.write(docs.orderBy(F.desc("text")).coalesce(1), "c")]
    whole = [_rows(mixing.mix_rows(d, max_repeats=2.0)) for d in layouts]
    assert whole[0] == whole[1] == whole[2]
    drawn = [_rows(mixing.draw(d, entropy=1.0, block_tokens=3000)) for d in layouts[:2]]
    assert drawn[0] == drawn[1]


def test_entropy_target_is_met(spark):
    """Three sources of 10, 100 and 1,000 words: between the corpus' entropy and ln 3 every target is met."""
    import math

    df = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 100), ("c", 1000)])], "doc_id long, text string, source string")
    for target in (0.5, 0.9, 1.09):
        weights = {r.source: r.weight for r in mixing.draw(df, entropy=target, budget=3000).collect()}
        assert abs(-sum(w * math.log(w) for w in weights.values()) - target) < 1e-6
    ends = {t: {r.source: r.weight for r in mixing.draw(df, entropy=t, budget=3000).collect()} for t in (0.01, 2.0)}
    assert abs(ends[0.01]["c"] - 1000 / 1110) < 1e-9 and all(abs(w - 1 / 3) < 1e-6 for w in ends[2.0].values())


def test_memory_is_bounded():
    memory = Memory(100_000)
    for start in range(0, 50_000, 50):
        words = {f"w{i}" for i in range(start, start + 50)} | {"often"}
        new = memory.missing(words)
        memory.keep(new, [w.upper() for w in new], 100 * len(new))
        assert all(memory.known[w] == w.upper() for w in words)
        memory.make_room()
        assert len(memory.known) + len(memory._older) < 600
        assert start == 0 or "often" not in new  # what turns up again stays
    hashes = WordHashes(2_000)
    words = [b"w%d" % (i % 97) for i in range(5000)]
    assert hashes.of(words).tolist() == WordHashes().of(words).tolist()
