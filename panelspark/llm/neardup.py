"""N-gram Jaccard join: MinHash candidates pruned by their posterior, the rest verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, WordHashes, anonymous, mix64, runs_of, slices, text_of, texts, with_row
from panelspark.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    """Shingles of ``shingle`` words, linked from a Jaccard similarity of ``numerator / denominator`` on.

    ``bands`` x ``rows`` MinHash values: two texts meet as candidates if one band agrees, which at 0.8
    fails with probability (1 - 0.8^4)^32 < 1e-7. A candidate is dropped once the posterior of reaching
    the threshold is below ``tolerance`` (uniform prior), looked at after every ``step`` values.
    """

    shingle: int = 5
    numerator: int = 4
    denominator: int = 5
    bands: int = 32
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-7
    tile_members: int = 2048  # of a bucket, in a task at once
    tile_shingles: int = 2_000_000  # of a component, in a task at once

    @property
    def values(self) -> int:
        return self.bands * self.rows


def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """``(n, m)``: after n values, a pair with fewer than m equal ones is dropped.

    With a uniform prior the similarity given m of n matches is Beta(m + 1, n - m + 1), whose upper
    tail at t is the probability of at most m successes of n + 1 with chance t.
    """
    t = settings.numerator / settings.denominator
    out = []
    for n in range(settings.step, settings.values + 1, settings.step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= settings.tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def shingle_sets(values: list[str], words: WordHashes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text end to end, and their numbers. A text of fewer words is
    one shingle, one without words has none."""
    found, counts = [], []
    for value in values:
        h = words.of(value.encode("utf-8", "replace").split())
        n = max(1, len(h) - size + 1) if len(h) else 0
        s = np.zeros(n, np.uint64)
        for j in range(min(size, len(h))):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        s = np.unique(mix64(s))
        found.append(s)
        counts.append(len(s))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def signatures(flat: np.ndarray, counts: np.ndarray, settings: Settings) -> np.ndarray:
    """MinHash values (16 bits of each minimum), one row per set; sets must not be empty."""
    rng = np.random.default_rng(20240501)
    odd = rng.integers(1, 1 << 32, settings.values, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, settings.values, dtype=np.uint64).astype(np.uint32)
    base = (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), settings.values), np.uint16)
    for i in range(settings.values):
        v = base * odd[i]
        v ^= v >> np.uint32(15)
        v *= odd[i - 1]
        v += plus[i]
        least = np.minimum.reduceat(v, starts)
        out[:, i] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def _surviving(sig: np.ndarray, one: np.ndarray, others: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Which of the rows ``others`` are still candidates for the signature ``one``."""
    alive, matches, done = others, np.zeros(len(others), np.int64), 0
    for n, m in rule:
        if not len(alive):
            break
        matches = matches + (sig[alive, done:n] == one[done:n]).sum(axis=1)
        keep = matches >= m
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _join_labels(label: np.ndarray, i: int, others: np.ndarray) -> None:
    hit = np.unique(np.append(label[others], label[i]))
    if len(hit) > 1:
        label[np.isin(label, hit[1:])] = hit[0]


def _sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """``__row, __key, n, h1, h2, sig``: size, 128-bit hash and signature of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in slices(batch, "__text", 2 << 20):
                flat, counts = shingle_sets(texts(part.column("__text")), words, settings.shingle)
                some = counts > 0
                starts = (np.cumsum(counts) - counts)[some]
                h1, h2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
                sig: list[bytes | None] = [None] * len(counts)
                if some.any():
                    h1[some] = np.add.reduceat(mix64(flat), starts)
                    h2[some] = np.add.reduceat(mix64(flat ^ np.uint64(0xD6E8FEB86659FD93)), starts)
                    own = signatures(flat, counts[some], settings)
                    for i, s in zip(np.flatnonzero(some).tolist(), own, strict=True):
                        sig[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), part.column("__key"), pa.array(counts), pa.array(h1.view(np.int64)),
                     pa.array(h2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["__row", "__key", "n", "h1", "h2", "sig"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select("__row", "__key", "__text").mapInArrow(
        run, f"__row {kinds['__row']}, __key {kinds['__key']}, n long, h1 long, h2 long, sig binary")


def _candidate_edges(reps: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """Edges that connect all candidates that survive pruning: a spanning set, not every pair."""
    width = 2 * settings.rows
    banded = reps.filter("n > 0").select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(settings.bands - 1))).alias("band"))
    banded = banded.select("id", F.xxhash64("band", F.substring("sig", F.col("band") * width + 1, F.lit(width))).alias("bucket"))
    banded = scratch.write(banded, "bands")
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / settings.tile_members).cast("int")
    placed = banded.join(sizes, "bucket").withColumn("blocks", blocks)
    placed = placed.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.groupBy("bucket", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2")).agg(
        F.sort_array(F.collect_list("id")).alias("ids"))  # at most two blocks of a bucket
    cells = cells.filter(F.size("ids") > 1).select("ids").distinct().withColumn("cell", F.monotonically_increasing_id())
    cells = scratch.write(cells, "cells")
    members = cells.select("cell", F.explode("ids").alias("id")).join(reps.select("id", "sig"), "id")
    rule = least_matches(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs_of(batches, ["cell"]):
            ids = cell.column("id").to_numpy()
            sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            label = np.arange(len(ids))
            for i in range(len(ids) - 1):
                others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                near = _surviving(sig, sig[i], others, rule)
                if len(near):
                    _join_labels(label, i, near)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], ["a", "b"])

    ordered = members.repartition("cell").sortWithinPartitions("cell", "id").select("cell", "id", "sig")
    edges = scratch.write(ordered.mapInArrow(run, "a long, b long"), "candidates")
    scratch.drop(banded, cells)
    return edges


def _verify(docs: DataFrame, reps: DataFrame, components: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """``id, links, texts, a``: exact links of each representative in a tile, and the first member of
    the tile that it is connected with. Pairs never leave the task."""
    inside = components.join(reps, components["node"] == reps["id"]).select("id", "root", "n", "size", "sig", "rep")
    totals = inside.groupBy("root").agg(F.ceil(F.sum("n") / settings.tile_shingles).cast("int").alias("blocks"))
    inside = inside.join(totals, "root").withColumn("own", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("blocks")).cast("int"))
    read = docs.select(F.col("__row").alias("rep"), "__text").join(inside, "rep")
    read = read.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    read = read.withColumn("t1", F.least("own", "other")).withColumn("t2", F.greatest("own", "other"))
    rule = least_matches(settings)
    num, den = settings.numerator, settings.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for tile in runs_of(batches, ["root", "t1", "t2"]):
            ids, own = tile.column("id").to_numpy(), tile.column("own").to_numpy()
            size = tile.column("size").to_numpy()
            sig = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            flat, n = shingle_sets(texts(tile.column("__text").combine_chunks()), words, settings.shingle)
            codes = np.unique(flat, return_inverse=True)[1]
            starts = np.append(0, np.cumsum(n))
            marked = np.zeros(len(flat) + 1, bool)
            across = tile.column("t1")[0].as_py() != tile.column("t2")[0].as_py()
            links, near_texts, label = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
            for i in range(len(ids) - 1):
                rest = np.arange(i + 1, len(ids))
                fits = np.minimum(n[rest], n[i]) * den >= np.maximum(n[rest], n[i]) * num
                if across:
                    fits &= own[rest] != own[i]
                near = _surviving(sig, sig[i], rest[fits], rule)
                if not len(near):
                    continue
                mine = codes[starts[i] : starts[i + 1]]
                marked[mine] = True
                at = np.repeat(starts[near] - np.append(0, np.cumsum(n[near])[:-1]), n[near]) + np.arange(n[near].sum())
                both = np.add.reduceat(marked[codes[at]].astype(np.int64), np.append(0, np.cumsum(n[near])[:-1]))
                marked[mine] = False
                near = near[both * den >= num * (n[i] + n[near] - both)]
                if len(near):
                    links[i] += size[near].sum()
                    near_texts[i] += len(near)
                    links[near] += size[i]
                    near_texts[near] += 1
                    _join_labels(label, i, near)
            tied = np.flatnonzero(near_texts)
            if len(tied):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[tied]), pa.array(links[tied]), pa.array(near_texts[tied]), pa.array(ids[label[tied]])],
                    ["id", "links", "texts", "a"])

    ordered = read.repartition("root", "t1", "t2").sortWithinPartitions("root", "t1", "t2", "id")
    return scratch.write(
        ordered.select("root", "t1", "t2", "id", "own", "size", "sig", "__text").mapInArrow(run, "id long, links long, texts long, a long"),
        "verified")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: ``__row, key, class_id, class_size, n_links, n_linked_texts, first``.

    Rows are linked if the Jaccard similarity of their word shingles reaches the threshold;
    ``n_links`` counts a row's links, ``n_linked_texts`` those to different shingle sets, and a class
    is a connected component of links (``class_id``: its smallest key; ``first``: the row that
    stands for it, with the smallest key, null last). Null text is empty; texts without words are
    linked to nothing. Repeated rows are links. Other columns are ignored.

    Equal shingle sets are one representative. Representatives meet in MinHash buckets, where pairs
    are pruned inside the task and only a spanning set of survivors comes out; within the components
    of those, all surviving pairs are verified on their shingles. Large buckets and components are
    tiled over tasks; their work is quadratic in their different texts, their output is not.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    own = docs.select(F.col(key).alias("c0"), F.col(text).alias("c1"))
    return _near(with_row(own, scratch), scratch, "c0", "c1", settings).withColumnRenamed("c0", key)


def _near(addressed: DataFrame, scratch: Scratch, key: str, text: str, settings: Settings) -> DataFrame:
    plain = addressed.select("__row", F.col(key).alias("__key"), text_of(text).alias("__text"))
    sets = scratch.write(_sets(plain, settings), "sets")
    some = sets.filter("n > 0")
    reps = some.groupBy("n", "h1", "h2").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("__key").isNull(), "__key", "__row")).alias("least"), F.first("sig").alias("sig"))
    reps = reps.select("n", "h1", "h2", "size", "sig", F.col("least.__key").alias("least_key"), F.col("least.__row").alias("rep"))
    reps = scratch.write(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    candidates = connected_components(_candidate_edges(reps, scratch, settings), scratch)
    verified = _verify(plain, reps, candidates, scratch, settings)
    classes = connected_components(verified.select(F.col("id").alias("a"), F.col("a").alias("b")), scratch)
    links = verified.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = reps.select("n", "h1", "h2", "size", "least_key", "rep", "id").join(links, "id", "left")
    known = known.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = scratch.write(known, "known")
    heads = known.groupBy("root").agg(
        F.sum("size").alias("class_size"), F.min(F.struct(F.col("least_key").isNull(), "least_key", "rep")).alias("head"))
    told = known.join(heads, "root").select(
        "n", "h1", "h2", F.col("head.least_key").alias("class_id"), "class_size",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
        F.col("head.rep").alias("first"))
    told = scratch.write(told, "told")
    out = sets.drop("sig").join(told, ["n", "h1", "h2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "__row", F.col("__key").alias(key), F.when(alone, F.col("__key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_linked_texts", F.lit(0)).alias("n_linked_texts"),
        F.coalesce("first", "__row").alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without those that another row of their class stands for."""
    scratch = Scratch(docs.sparkSession, "neardup")
    own, names = anonymous(docs)
    addressed = with_row(own, scratch)
    gone = _near(addressed, scratch, names[key], names[text], settings).filter(F.col("first") != F.col("__row")).select("__row")
    return addressed.join(gone, "__row", "left_anti").select(*own.columns).toDF(*docs.columns)
