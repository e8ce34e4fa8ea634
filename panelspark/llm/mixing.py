"""Mixing of sources to target weights by a temperature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, content_hash, text_of, with_row

#: Exponents tried in one pass while the bracket is narrowed.
_LADDER = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass(frozen=True)
class Mixture:
    """``exponent`` of the source shares and the tokens to draw in all."""

    exponent: float
    budget: float


def _sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a: sum of p^a, and of p^a ln p, over the sources with tokens."""
    p = F.col("__share")

    def total(term: Column) -> Column:  # decimal, so that the order of the sources has no part in it
        return F.sum(term.cast("decimal(36, 20)"))

    terms = [x for a in exponents for x in (total(F.pow(p, F.lit(a))), total(F.pow(p, F.lit(a)) * F.log(p)))]
    row = [float(v) for v in sources.agg(*[t.alias(f"s{i}") for i, t in enumerate(terms)]).first()]
    return list(zip(row[0::2], row[1::2], strict=True))


def solve_exponent(sources: DataFrame, max_repeats: float | None, entropy: float | None, budget: float | None = None) -> Mixture:
    """The temperature for a table of sources with their token share ``__share`` (> 0) and ``__tokens``.

    ``entropy``: the exponent at which the weights have that entropy in nats. ``max_repeats``: the
    smallest exponent at which no source is drawn more than so many times. Exponents lie between 0
    (equal weights) and 1 (as the corpus is); a target out of reach gives the nearer end. Without
    ``budget`` the least one is taken at which every source is drawn once in full.
    """
    total, low, high = sources.agg(F.sum("__tokens"), F.min("__share"), F.max("__share")).first()

    def drawn(a: float, z: float) -> float:
        return float(budget) if budget is not None else total * z * high ** (1 - a)

    def too_flat(a: float, sums: tuple[float, float]) -> bool:
        z, zl = sums
        if entropy is not None:
            from math import log

            return log(z) - a * zl / z > entropy
        return drawn(a, z) * low ** (a - 1) / z / total > max_repeats * (1 + 1e-12)

    left, right = 0.0, 1.0  # too flat at the left end, not at the right
    first, last = _sums(sources, [left, right])
    if not too_flat(left, first):
        right = left
    elif too_flat(right, last):
        left = right
    while right - left > 1e-10:
        steps = [left + (right - left) * i / _LADDER for i in range(1, _LADDER)]
        flat = [too_flat(a, s) for a, s in zip(steps, _sums(sources, steps), strict=True)]
        i = flat.index(False) if False in flat else len(steps)
        left, right = ([left, *steps, right][i], [left, *steps, right][i + 1])
    return Mixture(right, drawn(right, _sums(sources, [right])[0][0]))


def draw(
    docs: DataFrame,
    max_repeats: float | None = None,
    entropy: float | None = None,
    budget: float | None = None,
    block_tokens: int = 4_000_000,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per draw of a row: ``row, key, source, n_tokens, weight, repeats, epoch, block,
    block_order, row_order``.

    ``row`` tells rows by what is in them (two hashes of all columns, and the number among equal rows), so
    the draw depends on the content of the table alone, not on its files or their order.

    Source shares are raised to an exponent that meets ``max_repeats`` or ``entropy`` and normalised;
    each source gets that part of the budget in tokens (words). A source's rows lie in hashed blocks
    of about ``block_tokens``; an epoch is a new permutation of its blocks, and of the rows in a block
    (sorting by ``epoch, block_order, row_order`` realises it). Whole epochs are drawn while the
    budget lasts, then blocks in their order, then rows of the last block, never beyond it.

    Null and empty source names are one unnamed source (null in the result). Rows without words cost
    nothing and come with their block; a source without words is drawn once. Repeated rows are rows of
    their own. No window or join holds more than the blocks of a source or the rows of one block.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _rows(docs, key, source, text)
    out = _draw(rows, scratch, max_repeats, entropy, budget, block_tokens, seed)
    return out.select(
        F.col("__row").alias("row"), F.col("__key").alias(key), F.nullif("__source", F.lit("")).alias(source), F.col("__tokens").alias("n_tokens"),
        F.col("__weight").alias("weight"), F.col("__repeats").alias("repeats"), F.col("__epoch").alias("epoch"),
        F.col("__block").alias("block"), "block_order", "row_order",
    )


def _same(docs: DataFrame) -> list[Column]:
    """Hashes of the whole row, the columns in the order of their names."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = sorted(docs.columns)
    return content_hash([F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(f"`{c}`") for c in names])


def _rows(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``__row, __key, __source, __tokens``: equal rows are folded before they are numbered."""
    one, two = _same(docs)
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    slim = docs.select(one.alias("__one"), two.alias("__two"), F.col(key).alias("__key"), name.alias("__source"), word_count(text_of(text)).alias("__tokens"))
    folded = slim.groupBy("__one", "__two", "__key", "__source", "__tokens").agg(F.count(F.lit(1)).alias("__n"))
    numbered = folded.withColumn("__at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return numbered.select(F.struct("__one", "__two", "__at").alias("__row"), "__key", "__source", "__tokens")


def _draw(rows, scratch, max_repeats, entropy, budget, block_tokens, seed) -> DataFrame:
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    rows = scratch.write(rows, "rows")
    per_source = rows.groupBy("__source").agg(F.sum("__tokens").alias("__tokens"))
    total = per_source.agg(F.sum("__tokens")).first()[0] or 0
    sources = per_source.withColumn("__share", F.col("__tokens") / F.lit(float(max(total, 1))))
    sources = scratch.write(sources, "sources")
    positive = sources.filter("__tokens > 0")
    mix = solve_exponent(positive, max_repeats, entropy, budget) if total else Mixture(1.0, 0.0)
    z = _sums(positive, [mix.exponent])[0][0] if total else 1.0
    weight = F.when(F.col("__tokens") > 0, F.pow("__share", F.lit(mix.exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    goal = F.when(F.col("__tokens") > 0, F.round(F.col("__weight") * F.lit(mix.budget)).cast("long"))
    plan = sources.withColumn("__weight", weight).withColumn("__goal", goal).select(
        "__source", "__weight",
        F.when(F.col("__tokens") > 0, F.floor(F.col("__goal") / F.col("__tokens"))).otherwise(F.lit(1)).cast("long").alias("__full"),
        F.when(F.col("__tokens") > 0, F.col("__goal") % F.col("__tokens")).otherwise(F.lit(0)).alias("__rest"),
        F.when(F.col("__tokens") > 0, F.col("__goal") / F.col("__tokens")).otherwise(F.lit(1.0)).alias("__repeats"),
        F.greatest(F.lit(1), F.ceil(F.col("__tokens") / F.lit(block_tokens))).cast("long").alias("__blocks"),
    )
    # One row per source name; Spark sees its size and splits a hot source of the join otherwise.
    spot = F.pmod(F.xxhash64(F.lit(seed), "__row"), F.col("__blocks"))
    rows = rows.join(plan.select("__source", "__blocks"), "__source").withColumn("__block", spot).drop("__blocks")
    rows = scratch.write(rows, "blocks")
    block_order = F.xxhash64(F.lit(seed), F.col("__epoch"), F.col("__source"), F.col("__block"))
    before = Window.partitionBy("__source").orderBy("__order", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("__source", "__block").agg(F.sum("__tokens").alias("__size"))
        .join(plan, "__source")
        .withColumn("__epoch", F.col("__full"))
        .withColumn("__order", block_order)
        .withColumn("__room", F.col("__rest") - F.coalesce(F.sum("__size").over(before), F.lit(0)))
        .select("__source", "__block", "__weight", "__full", "__repeats", "__size", "__room")
    )
    placed = scratch.write(rows.join(blocks, ["__source", "__block"]), "placed")
    row_order = F.xxhash64(F.lit(seed), F.col("__epoch"), F.col("__row"))
    border = (F.col("__room") > 0) & (F.col("__size") > F.col("__room"))
    whole = F.when((F.col("__room") > 0) & (F.col("__size") <= F.col("__room")), 1).otherwise(0)
    upto = Window.partitionBy("__source", "__block").orderBy("__row_order", "__row").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        placed.filter(border).withColumn("__epoch", F.col("__full")).withColumn("__row_order", row_order)
        .withColumn("__upto", F.sum("__tokens").over(upto))
        .withColumn("__epochs", F.col("__full") + F.when(F.col("__upto") <= F.col("__room"), 1).otherwise(0))
        .drop("__epoch", "__row_order", "__upto")
    )
    drawn = placed.filter(~border).withColumn("__epochs", F.col("__full") + whole).unionByName(inside)
    drawn = drawn.filter("__epochs > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__epochs") - 1)))
    return drawn.withColumn("block_order", block_order).withColumn("row_order", row_order)


def mix_rows(docs: DataFrame, **target) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with their columns only."""
    scratch = Scratch(docs.sparkSession, "mixing")
    settings = {"max_repeats": None, "entropy": None, "budget": None, "block_tokens": 4_000_000, "seed": 0, **target}
    names = [settings.pop(c, c if c != "key" else "doc_id") for c in ("key", "source", "text")]
    one, two = _same(docs)
    # Equal rows stand for each other: the first of them is drawn as often as all.
    hashed = docs.select(one.alias("c0"), two.alias("c1"), *[F.col(f"`{c}`").alias(f"c{i + 2}") for i, c in enumerate(docs.columns)])
    addressed = with_row(hashed, scratch)
    first = addressed.groupBy("c0", "c1").agg(F.min("__row").alias("__row"))
    drawn = _draw(_rows(docs, *names), scratch, **settings).groupBy("__row.__one", "__row.__two").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    drawn = drawn.join(first, (F.col("__one") == F.col("c0")) & (F.col("__two") == F.col("c1"))).select("__row", "__times")
    copies = F.explode(F.sequence(F.lit(1), F.col("__times")))
    wide = addressed.drop("c0", "c1").join(drawn, "__row").withColumn("__copy", copies)
    return wide.select(*[f"c{i + 2}" for i in range(len(docs.columns))]).toDF(*docs.columns)
