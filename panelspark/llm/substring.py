"""Removal of word sequences that repeat anywhere in the corpus, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, WordHashes, runs_of, slices, text_of, texts, with_row
from panelspark.llm.recompress import Anchors, Ranges, anchors

SLICE_ROWS = 512  # neighbouring rows of a file that ask and are answered together
_SLICE = ["file", "salt", "slice"]
_ASK = "file long, salt int, slice long, shard int, names binary, extents binary, counts binary"
_ANSWER = "file long, salt int, slice long, names binary, extents binary, flags binary"
WHOLE, MIXED = 1, 2  # the group itself repeats; its name does, in another group


class Slice:
    """Texts laid end to end, with walls between; texts shorter than a window are left out."""

    def __init__(self, values: list[str], words: WordHashes, window: int):
        self.split = [v.encode("utf-8", "replace").split() for v in values]
        self.counts = np.array([len(w) for w in self.split], np.int64)
        parts, wall, self.start = [], [], np.full(len(values), -1, np.int64)
        at = 0
        for i, w in enumerate(self.split):
            if len(w) >= window:
                parts += [words.of(w), np.zeros(1, np.uint64)]
                self.start[i] = at
                at += len(w) + 1
                wall.append(at - 1)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.wall = np.zeros(at, bool)
        self.wall[wall] = True
        self.ranges = Ranges(self.words) if at else None

    def anchors(self, window: int) -> Anchors:
        return anchors(self.words, self.wall, window, self.ranges)

    def covered(self, window_starts: np.ndarray, window: int) -> np.ndarray:
        """Words that the windows cover."""
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, window_starts, 1)
        np.add.at(change, window_starts + window, -1)
        return np.cumsum(change)[:-1] > 0

    def result(self, covered: np.ndarray, i: int) -> tuple[int, int, str]:
        """Words, removed words and hash of the kept words of text ``i``."""
        words = self.split[i]
        if self.start[i] >= 0:
            gone = covered[self.start[i] : self.start[i] + len(words)]
            if gone.any():
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return len(self.split[i]), len(self.split[i]) - len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def _requests(key: tuple[int, int, int], name: np.ndarray, extent: np.ndarray, shards: int) -> pa.RecordBatch:
    """The distinct (name, extent) of a slice with their numbers, packed by shard of the name."""
    order = np.lexsort((extent, name))
    name, extent = name[order], extent[order]
    new = np.append(True, (name[1:] != name[:-1]) | (extent[1:] != extent[:-1])) if len(name) else np.zeros(0, bool)
    counts = np.diff(np.append(np.flatnonzero(new), len(name)))
    name, extent = name[new], extent[new]
    shard = ((name >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    name, extent, counts, shard = name[order], extent[order], counts[order].astype(np.uint32), shard[order]
    used, at = np.unique(shard, return_index=True)
    ends = np.append(at[1:], len(shard))
    blobs = [[x[a:b].tobytes() for a, b in zip(at, ends, strict=True)] for x in (name, extent, counts)]
    n = len(used)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, key[0], np.int64)), pa.array(np.full(n, key[1], np.int32)), pa.array(np.full(n, key[2], np.int64)),
         pa.array(used.astype(np.int32)), *[pa.array(b, pa.binary()) for b in blobs]],
        ["file", "salt", "slice", "shard", "names", "extents", "counts"])


def _unpack(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    values = [np.frombuffer(v, kind) for v in column.to_pylist()]
    sizes = np.array([len(v) for v in values], np.int64)
    return (np.concatenate(values) if values else np.zeros(0, kind)), sizes


def shared_names(requests: DataFrame) -> DataFrame:
    """Answers to the requests of all slices: of what a slice asked for, the names that occur at least
    twice anywhere, flagged ``WHOLE`` where the same extent does, ``MIXED`` where the name has an
    extent that does not.

    A shard holds one part of the names; a slice asks for a name once however often it has it, so a
    name that is everywhere is one entry per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs_of(batches, ["shard"]):
            name, sizes = _unpack(shard.column("names"), np.uint64)
            extent, counts = _unpack(shard.column("extents"), np.uint64)[0], _unpack(shard.column("counts"), np.uint32)[0]
            order = np.lexsort((extent, name))
            n, e, c = name[order], extent[order], counts[order].astype(np.int64)
            new_name = np.append(True, n[1:] != n[:-1])
            new_pair = new_name | np.append(True, e[1:] != e[:-1])
            name_id, pair_id = np.cumsum(new_name) - 1, np.cumsum(new_pair) - 1
            pair_total = np.bincount(pair_id, c).astype(np.int64)
            name_total = np.bincount(name_id, c).astype(np.int64)
            lonely = np.bincount(name_id, pair_total[pair_id] == 1) > 0
            flag = np.zeros(len(n), np.uint8)
            flag[order] = np.where(name_total[name_id] < 2, 0, (pair_total[pair_id] > 1) * WHOLE + lonely[name_id] * MIXED)
            slice_at = np.append(0, np.cumsum(sizes))
            out: list[list[bytes]] = [[], [], []]
            rows = []
            for i in range(len(sizes)):
                told = slice_at[i] + np.flatnonzero(flag[slice_at[i] : slice_at[i + 1]])
                if len(told):
                    rows.append(i)
                    for k, x in enumerate((name, extent, flag)):
                        out[k].append(x[told].tobytes())
            picked = pa.array(rows, pa.int64())
            keys = [shard.column(k).combine_chunks().take(picked) for k in _SLICE]
            if rows:
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(o, pa.binary()) for o in out]], [*_SLICE, "names", "extents", "flags"])

    # One hot name is one entry a slice, so shards are even; rows of a shard meet in one task.
    ordered = requests.repartition("shard").sortWithinPartitions("shard", *_SLICE).select(*_SLICE, "shard", "names", "extents", "counts")
    return ordered.mapInArrow(run, _ANSWER)


def _with_answers(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Texts and answers of a slice in one run of rows, answers first, texts in order."""
    slim = docs.select(
        F.col("__row.file").alias("file"), F.col("__row.salt").alias("salt"), F.floor(F.col("__row.at") / SLICE_ROWS).alias("slice"),
        F.lit(1).alias("kind"), F.col("__row.at").alias("at"), "__key", "__text",
        *[F.lit(None).cast("binary").alias(c) for c in ("names", "extents", "flags")])
    key = docs.schema["__key"].dataType
    both = slim.unionByName(answers.select(
        *_SLICE, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(None).cast(key).alias("__key"),
        F.lit(None).cast("string").alias("__text"), "names", "extents", "flags"))
    return both.repartition(*_SLICE).sortWithinPartitions(*_SLICE, "kind", "at")


def _answered(run: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    n = int((run.column("kind").to_numpy() == 0).sum())
    told = run.slice(0, n)
    return (_unpack(told.column("names"), np.uint64)[0], _unpack(told.column("extents"), np.uint64)[0],
            _unpack(told.column("flags"), np.uint8)[0], run.slice(n))


def _flags(name: np.ndarray, extent: np.ndarray, names: np.ndarray, extents: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The flag of each (name, extent) among the answers, 0 if there is none."""
    if not len(names):
        return np.zeros(len(name), np.uint8)
    pair = np.dtype([("n", np.uint64), ("e", np.uint64)])
    told, asked = np.empty(len(names), pair), np.empty(len(name), pair)
    told["n"], told["e"], asked["n"], asked["e"] = names, extents, name, extent
    found, index = np.unique(told, return_index=True)
    out = np.zeros(len(name), np.uint8)
    maybe = np.flatnonzero(np.isin(name, names))
    at = np.minimum(np.searchsorted(found, asked[maybe]), len(found) - 1)
    hit = found[at] == asked[maybe]
    out[maybe[hit]] = flags[index[at[hit]]]
    return out


def remove_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", shard_names: int = 1_000_000) -> DataFrame:
    """One row per input row: ``key, n_words, n_removed, kept_sha256``.

    A window is ``window`` consecutive words of one text; all words go that are covered by a window
    whose words also start anywhere else, in the input as it is. ``kept_sha256`` is the hash of the
    kept words joined by one space. Null text has no words; repeated rows repeat each other's
    windows. Other columns are ignored.

    Each task names its texts by recompression; neighbouring windows share a name, equal windows
    always do. Spark rounds then tell which names occur twice: groups whose whole extent repeats are
    done, windows of a repeated name with other extents are compared by 128 bits of hash in a second
    round. A slice of rows asks for packed arrays, dealt by name, and gets back what is shared. Only
    texts with windows of the second kind are carried on to it.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    plain = with_row(docs.select(F.col(key).alias("__key"), text_of(text).alias("__text")), scratch)
    kind = plain.schema["__key"].dataType.simpleString()
    words = plain.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    shards = max(1, words // 40 // shard_names + 1)  # a name for about 40 bytes of text

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for run in runs_of(batches, _SLICE):
            owner = tuple(run.column(k)[0].as_py() for k in _SLICE)
            for batch in run.combine_chunks().to_batches():
                for part in slices(batch, "__text", 4 << 20):
                    own = Slice(texts(part.column("__text")), memory, window)
                    if len(own.words):
                        a = own.anchors(window)
                        yield _requests(owner, a.name, a.extent, shards)

    sliced = plain.select(
        F.col("__row.file").alias("file"), F.col("__row.salt").alias("salt"),
        F.floor(F.col("__row.at") / SLICE_ROWS).alias("slice"), "__text")
    first = scratch.write(shared_names(sliced.mapInArrow(ask, _ASK)), "answers")

    result = f"__key {kind}, n_words long, n_removed long, kept_sha256 string"
    carried = "file long, salt int, slice long, at long, __text string, gone binary"

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for run in runs_of(batches, _SLICE):
            owner = tuple(run.column(k)[0].as_py() for k in _SLICE)
            names, extents, flags, rest = _answered(run)
            for batch in rest.combine_chunks().to_batches():
                for part in slices(batch, "__text", 4 << 20):
                    yield from _decide_part(part, owner, names, extents, flags, memory)

    def _decide_part(part, owner, names, extents, flags, memory):
        own = Slice(texts(part.column("__text")), memory, window)
        n = part.num_rows
        covered, open_ = np.zeros(len(own.words), bool), np.zeros(n, bool)
        if len(own.words):
            a = own.anchors(window)
            flag = _flags(a.name, a.extent, names, extents, flags)
            whole, mixed = (flag & WHOLE) > 0, np.flatnonzero((flag & MIXED) > 0)
            group = np.flatnonzero(whole)
            covered = own.covered(_windows(a, group), window)
            if len(mixed):
                w = _windows(a, mixed)
                yield _wide(_requests(owner, own.ranges.hash(w, w + window), own.ranges.hash(w, w + window, 1), shards), part.column("__key").type)
                starts = np.where(own.start >= 0, own.start, np.iinfo(np.int64).max)
                at = np.sort(starts[own.start >= 0])
                docs_of = np.searchsorted(at, a.first[mixed], side="right") - 1
                open_ = np.isin(own.start, at[np.unique(docs_of)])
        done = np.flatnonzero(~open_)
        told = [own.result(covered, i) for i in done.tolist()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(len(done), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())],
             *[pa.nulls(len(done), t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())],
             pa.array(np.zeros(len(done), np.int32)), part.column("__key").take(pa.array(done)),
             pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int64()), pa.array([t[2] for t in told], pa.string())],
            _WIDE)
        on = np.flatnonzero(open_)
        if len(on):
            gone = [np.packbits(covered[own.start[i] : own.start[i] + own.counts[i]]).tobytes() for i in on.tolist()]
            pick = pa.array(on)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k).take(pick) for k in (*_SLICE, "at", "__text")], pa.array(gone, pa.binary()),
                 *[pa.nulls(len(on), t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())],
                 pa.array(np.ones(len(on), np.int32)), part.column("__key").take(pick),
                 *[pa.nulls(len(on), t) for t in (pa.int64(), pa.int64(), pa.string())]], _WIDE)

    wide = f"{carried}, shard int, names binary, extents binary, counts binary, what int, {result}"
    decided = scratch.write(_with_answers(plain, first).mapInArrow(decide, wide), "decided")
    settled = decided.filter("what = 0").select("__key", "n_words", "n_removed", "kept_sha256")
    second = scratch.write(shared_names(decided.filter("what = 2").select(*_SLICE, "shard", "names", "extents", "counts")), "answers")
    waiting = decided.filter("what = 1").select(
        F.struct("file", "salt", "at").alias("__row"), F.struct("__key", "gone").alias("__key"), "__text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for run in runs_of(batches, _SLICE):
            names, extents, flags, rest = _answered(run)
            for batch in rest.combine_chunks().to_batches():
                for part in slices(batch, "__text", 4 << 20):
                    own = Slice(texts(part.column("__text")), memory, window)
                    walls = np.append(0, np.cumsum(own.wall))
                    w = np.flatnonzero(walls[window:] == walls[:-window])
                    flag = _flags(own.ranges.hash(w, w + window), own.ranges.hash(w, w + window, 1), names, extents, flags)
                    covered = own.covered(w[(flag & WHOLE) > 0], window)
                    held = part.column("__key")
                    for i, bits in enumerate(held.field("gone").to_pylist()):
                        s, n = own.start[i], own.counts[i]
                        covered[s : s + n] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                    told = [own.result(covered, i) for i in range(part.num_rows)]
                    yield pa.RecordBatch.from_arrays(
                        [held.field("__key"), *[pa.array([t[k] for t in told], pa.int64()) for k in (0, 1)], pa.array([t[2] for t in told])],
                        ["__key", "n_words", "n_removed", "kept_sha256"])

    finished = _with_answers(waiting, second).mapInArrow(finish, result)
    return settled.union(finished).withColumnRenamed("__key", key)


_WIDE = ["file", "salt", "slice", "at", "__text", "gone", "shard", "names", "extents", "counts", "what", "__key", "n_words", "n_removed", "kept_sha256"]


def _windows(a: Anchors, group: np.ndarray) -> np.ndarray:
    """Starts of all windows of the groups."""
    size = a.last[group] - a.first[group] + 1
    return np.repeat(a.first[group] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _wide(requests: pa.RecordBatch, key: pa.DataType) -> pa.RecordBatch:
    n = requests.num_rows
    return pa.RecordBatch.from_arrays(
        [*[requests.column(k) for k in _SLICE], *[pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.binary())],
         *[requests.column(k) for k in ("shard", "names", "extents", "counts")], pa.array(np.full(n, 2, np.int32)),
         pa.nulls(n, key), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], _WIDE)
