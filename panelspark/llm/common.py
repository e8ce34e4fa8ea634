"""Helpers that several operators share: tables, words, row addresses, scratch tables."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import shared_dir

#: White space between words, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs a re-read only.

    ``drop`` removes a table as soon as no later step reads it. What a returned (still lazy)
    DataFrame reads stays below ``spark.checkpoint.dir`` until its owner cleans that folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row(df: DataFrame, scratch: Scratch, name: str = "__row") -> DataFrame:
    """Add the row's address: the same at each reading, different for repeated rows.

    Rows that come straight from files, by way of filters and projections at most, are addressed by file and
    position; any other frame (joins, unions and explodes repeat positions) is written once with a running
    number. ``name`` must be free in ``df``: see :func:`anonymous`.
    """
    if _straight_from_files(df):
        try:
            path, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
            out = df.select("*", F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("salt"), at.alias("at")).alias(name))
            out.schema  # noqa: B018  resolves the plan
            return out
        except AnalysisException:
            pass  # a source without row positions
    number = F.monotonically_increasing_id()
    row = F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).alias("salt"), number.alias("at"))
    return scratch.write(df.withColumn(name, row), "rows")


def _straight_from_files(df: DataFrame) -> bool:
    """Whether each row of a file gives at most one row."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().head()
    return node.children().isEmpty()


def anonymous(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns numbered, so that no name of its own meets a working column, and the new name
    of each; ``toDF(*old)`` gives them back."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def content_hash(columns: list[Column]) -> list[Column]:
    """Two hashes of the columns' values, nulls told apart from the places of their neighbours."""
    marked = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(i), *marked) for i in (1, 2)]


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (a longer text is a part of its own)."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal integer ``keys``, from batches sorted by them."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[start]) for c in columns)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(batch.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts)


def spelled_out(pattern: str, plain) -> re.Pattern | None:
    """The pattern for Python's own engine, which is faster, its Unicode classes L and N spelled out as the
    characters that texts of ``plain`` can have, lower-cased or not. None if it has other classes."""
    chars = {c for i in range(0x250) if plain.fullmatch(chr(i)) for c in (chr(i), *chr(i).lower())}
    for kind in "LN":
        members = "".join(re.escape(c) for c in sorted(chars) if unicodedata.category(c)[0] == kind)
        pattern = re.sub(rf"(?<!\[)\\p\{{{kind}\}}(?=[+*?|)]|$)", lambda m: f"[{members}]", pattern)  # noqa: B023  outside of brackets
        pattern = pattern.replace(rf"\p{{{kind}}}", members)
    return None if r"\p" in pattern else re.compile(pattern)


class Memory:
    """What is known of words, bounded in bytes: once half the room is used, only words that turn up again are
    carried on."""

    def __init__(self, limit: int):
        self.known: dict = {}
        self._older: dict = {}
        self.half, self.size = limit // 2, 0

    def missing(self, words: set) -> list:
        """The words of which nothing is known; all others are in ``known`` afterwards."""
        new = words.difference(self.known)
        if new and self._older:
            again = {w: self._older[w] for w in new if w in self._older}
            self.known.update(again)
            self.size += 250 * len(again)
            new.difference_update(again)
        return list(new)

    def keep(self, words: list, values: list, size: int) -> None:
        """``size``: bytes that words and values take beside about 150 of each entry."""
        self.known.update(zip(words, values, strict=True))
        self.size += 150 * len(words) + size

    def make_room(self) -> None:
        if self.size > self.half:
            self._older, self.known, self.size = self.known, {}, 0


class WordHashes:
    """64-bit hashes of words (bytes without white space), remembered while there is room."""

    def __init__(self, limit: int = 24 << 20):
        self.memory = Memory(limit)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = self.memory.missing(set(words))
        self.memory.keep(new, list(map(xxhash.xxh3_64_intdigest, new)), sum(map(len, new)))
        out = np.fromiter(map(self.memory.known.__getitem__, words), np.uint64, len(words))
        self.memory.make_room()
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
