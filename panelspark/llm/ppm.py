"""Language-model scores by prediction by partial matching over bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, mix64, runs_of, slices, text_of, texts, with_row

SLICE_ROWS = 4096  # neighbouring rows of a file that ask and are answered together
_SLICE = ["file", "salt", "slice"]
_PART = [*_SLICE, "part"]  # what of a slice one task has read: from the row `part` on
END = 0xFF  # stands for the end of a text, and for what is before it; no byte of UTF-8
GRAM, WORD, TOTAL = 0, 1, 2  # kinds of requests and answers
_ASK = "file long, salt int, slice long, part long, kind int, shard int, first binary, second binary, counts binary"
_ANSWER = "file long, salt int, slice long, part long, kind int, shard int, values binary"


class Lookup:
    """Integer keys (distinct) -> numbers, as an open-addressing table of NumPy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.used = np.zeros(1 << self.bits, bool)
        self.values = np.zeros(1 << self.bits, values.dtype)
        slot = self._slot(keys)
        while len(keys):
            free = ~self.used[slot]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            self.used[slot] = True
            lost = self.keys[slot] != keys
            keys, values, slot = keys[lost], values[lost], slot[lost] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float = 0) -> np.ndarray:
        slot = self._slot(keys)
        hit = (self.keys[slot] == keys) & self.used[slot]
        out = np.where(hit, self.values[slot], self.values.dtype.type(default))
        on = np.flatnonzero(~hit & self.used[slot])
        while len(on):
            slot_on = slot[on] + 1 & (1 << self.bits) - 1
            slot[on] = slot_on
            hit = (self.keys[slot_on] == keys[on]) & self.used[slot_on]
            out[on[hit]] = self.values[slot_on[hit]]
            on = on[~hit & self.used[slot_on]]
        return out


def layout(values: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with ``order`` ends before, between and after them; where each text starts,
    and how many symbols it has (its bytes and one end)."""
    gap = bytes([END]) * order
    flat = np.frombuffer(gap + b"".join(v + gap for v in values), np.uint8)
    sizes = np.array([len(v) for v in values], np.int64)
    return flat, order + np.cumsum(sizes + order) - (sizes + order), sizes + 1


def grams(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """For each symbol of each text, itself (lowest byte) and the ``order`` bytes before it."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    wide = flat.astype(np.uint64)
    code = wide.copy()
    for j in range(1, order + 1):
        code[j:] |= wide[:-j] << np.uint64(8 * j)
    return code[at]


class Trie:
    """Counts of symbols after contexts of 0 to ``order`` bytes, as sorted arrays for each order.

    Estimates are those of method D: of a context with n symbols seen, q different, one seen c times
    has (c - 1/2) / n and the escape q / 2 / n. After an escape, what the longer context has seen is
    excluded from the counts of the shorter one.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.counts = [t[0] for t in tables], [t[1].astype(np.int64) for t in tables]
        self.contexts, self.total, self.distinct, self.excluded = [], [], [], []
        for k, (gram, count) in enumerate(zip(self.grams, self.counts, strict=True)):
            context, first = np.unique(gram >> np.uint64(8), return_index=True)
            self.contexts.append(context)
            self.total.append(np.add.reduceat(count, first) if len(first) else count)
            self.distinct.append(np.diff(np.append(first, len(gram))))
            lower = self._count(k - 1, gram) if k else count
            self.excluded.append(np.add.reduceat(lower, first) if len(first) else lower)

    def _count(self, k: int, gram: np.ndarray) -> np.ndarray:
        short = gram & np.uint64((1 << 8 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(self.grams[k], short), max(0, len(self.grams[k]) - 1))
        return np.where(self.grams[k][at] == short, self.counts[k][at], 0) if len(self.grams[k]) else np.zeros(len(gram), np.int64)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of the symbol after the context, for each gram of the longest order."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        mass, kinds = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)  # excluded
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(open_) or not len(self.grams[k]):
                continue
            own = gram[open_]
            context = (own & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            there = self.contexts[k][at] == context
            total = self.total[k][at] - mass[open_]
            fresh = self.distinct[k][at] - kinds[open_]
            count = self._count(k, own)
            hit, miss = there & (count > 0), there & (count == 0)
            out[open_[hit]] += np.log10((count[hit] - 0.5) / total[hit])
            escape = miss & (fresh > 0)  # else nothing new can come here: no choice to make
            out[open_[escape]] += np.log10(0.5 * fresh[escape] / total[escape])
            left = open_[miss]
            mass[left], kinds[left] = self.excluded[k][at[miss]], self.distinct[k][at[miss]]
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(1, 256 - kinds[open_]))
        return out


def lower_orders(gram: np.ndarray, count: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tables of shorter contexts from the counts of the longest one."""
    out = []
    for k in orders:
        short, at = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        out.append((short, np.bincount(at, count, len(short)).astype(np.int64)))
    return out


def _keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """80 bits of hash of each word: two words of a corpus of 10^10 share them with chance 10^-4."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
    return raw[:, 0].astype(np.uint64), (raw[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed bytes, like bytes side by side; those that rise as differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(raw: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


class Wanted:
    """What a part of a slice asks for, in the order in which it is asked and answered."""

    def __init__(self, shard: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.order = np.lexsort((second, first, shard))
        self.first, self.second = first[self.order], second[self.order]
        self.shards, at = np.unique(shard[self.order], return_index=True)
        self.spans = list(zip(at.tolist(), [*at[1:].tolist(), len(shard)], strict=True))

    def rows(self, owner: tuple[int, ...], kind: int, counts: np.ndarray) -> pa.RecordBatch:
        counts, n = counts[self.order].astype(np.uint32), len(self.shards)
        blobs = [[squeeze(x[a:b], rising) for a, b in self.spans] for x, rising in ((self.first, True), (self.second, False), (counts, False))]
        keys = [pa.array(np.full(n, o, t)) for o, t in zip(owner, (np.int64, np.int32, np.int64, np.int64), strict=True)]
        return pa.RecordBatch.from_arrays(
            [*keys, pa.array(np.full(n, kind, np.int32)), pa.array(self.shards.astype(np.int32)), *[pa.array(b, pa.binary()) for b in blobs]],
            [*_PART, "kind", "shard", "first", "second", "counts"])


def wanted_grams(gram: np.ndarray, shards: int) -> Wanted:
    shard = (mix64(gram >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)
    return Wanted(shard, gram, np.zeros(len(gram), np.uint16))


def wanted_words(words: list[bytes], shards: int) -> Wanted:
    first, second = _keys(words)
    return Wanted((mix64(first) % np.uint64(shards)).astype(np.int64), first, second)


def _concat(column: pa.ChunkedArray, kind: type, rising: bool = False) -> tuple[np.ndarray, np.ndarray]:
    parts = [unsqueeze(v, kind, rising) for v in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def score(
    docs: DataFrame, train: Column, order: int = 5, key: str = "doc_id", text: str = "text", shard_keys: int = 500_000,
) -> DataFrame:
    """One row per input row: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the log10 probability of the whole text and its end under a byte trie of ``order``
    counted over all rows where ``train`` holds; ``base_score`` is that of a smoothed unigram model of
    its lower-cased words and the end. Null text is empty: only the end is scored. Without training
    rows every byte is equally likely. Repeated rows are counted and scored like any other; a null
    ``train`` is false. Other columns are ignored.

    A slice of rows asks for its distinct byte grams and words, with its training counts; requests
    are dealt by the last two context bytes and by word, so that a shard can build the part of the
    trie that its grams need and answer each slice with their log probabilities. Shorter contexts are two
    tables of at most 65,792 counts. Texts meet their answers slice by slice; the model itself is
    never in one place.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be between 2 and 7")
    scratch = Scratch(docs.sparkSession, "ppm")
    own = docs.select(F.col(key).alias("__key"), text_of(text).alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    plain = with_row(own, scratch).select(
        F.col("__row.file").alias("file"), F.col("__row.salt").alias("salt"), F.floor(F.col("__row.at") / SLICE_ROWS).alias("slice"),
        F.col("__row.at").alias("at"), "__key", "__text", "__train")
    size = plain.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    shards = max(1, size // 30 // shard_keys + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, _SLICE):
            owner = tuple(run.column(k)[0].as_py() for k in (*_SLICE, "at"))
            found, known, others = [], Counter(), set()
            for batch in run.combine_chunks().to_batches():
                for part in slices(batch, "__text", 1 << 20):
                    values = [t.encode("utf-8", "replace") for t in texts(part.column("__text"))]
                    learn = np.array(part.column("__train").to_pylist(), bool)
                    flat, starts, sizes = layout(values, order)
                    code = grams(flat, starts, sizes, order)
                    flag = np.repeat(learn, sizes)
                    for chosen, times in ((code[flag], 1), (code[~flag], 0)):
                        gram, count = np.unique(chosen, return_counts=True)
                        found.append((gram, count * times))
                    for v, use in zip(values, learn.tolist(), strict=True):
                        (known if use else others).update(v.lower().split())
            gram, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            count = np.bincount(at, np.concatenate([f[1] for f in found]), len(gram))
            yield wanted_grams(gram, shards).rows(owner, GRAM, count)
            words = [*known, *(others - known.keys())]
            if words:
                count = np.zeros(len(words), np.int64)
                count[: len(known)] = np.fromiter(known.values(), np.int64, len(known))
                yield wanted_words(words, shards).rows(owner, WORD, count)

    requests = scratch.write(plain.select(*_SLICE, "at", "__text", "__train").mapInArrow(ask, _ASK), "requests")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << 16, np.int64)
        for batch in batches:
            gram, count = _concat(batch.column("first"), np.uint64, True)[0], _concat(batch.column("counts"), np.uint32)[0]
            totals += np.bincount((gram & np.uint64(0xFFFF)).astype(np.int64), count, 1 << 16).astype(np.int64)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["pair", "n"])

    pairs = requests.filter(F.col("kind") == GRAM).select("first", "counts").mapInArrow(shorten, "pair long, n long")
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 65,536 rows
    pair = np.array(sorted((r[0], r[1]) for r in found), np.int64).reshape(-1, 2)
    pair_gram, pair_count = pair[:, 0].astype(np.uint64), pair[:, 1]
    small = [*lower_orders(pair_gram, pair_count, range(1)), (pair_gram, pair_count)]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs_of(batches, ["kind", "shard"]):
            kind = shard.column("kind")[0].as_py()
            first, sizes = _concat(shard.column("first"), np.uint64, True)
            second, count = _concat(shard.column("second"), np.uint16)[0], _concat(shard.column("counts"), np.uint32)[0]
            at = np.lexsort((second, first))
            new = np.append(True, (first[at][1:] != first[at][:-1]) | (second[at][1:] != second[at][:-1])) if len(at) else np.zeros(0, bool)
            group = np.empty(len(at), np.int64)
            group[at] = np.cumsum(new) - 1
            total = np.bincount(group, count).astype(np.int64)
            if kind == GRAM:
                gram = first[at][new]
                seen = total > 0
                trie = Trie([*small, *lower_orders(gram[seen], total[seen], range(2, order + 1))])
                value = trie.log10(gram).astype(np.float32)
            else:
                value = total
            value, ends = value[group], np.cumsum(sizes)
            blobs = [squeeze(value[e - n : e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[shard.column(k).combine_chunks() for k in (*_PART, "kind", "shard")], pa.array(blobs, pa.binary())],
                [*_PART, "kind", "shard", "values"])
            if kind == WORD:
                told = np.array([int((total > 0).sum()), int(total.sum())], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v], t) for v, t in ((0, pa.int64()), (0, pa.int32()), (-1, pa.int64()), (0, pa.int64()), (TOTAL, pa.int32()), (0, pa.int32()))],
                     pa.array([told], pa.binary())], [*_PART, "kind", "shard", "values"])

    dealt = requests.repartition("kind", "shard").sortWithinPartitions("kind", "shard", *_PART)
    answers = scratch.write(dealt.mapInArrow(answer, _ANSWER), "answers")
    scratch.drop(requests)
    totals = [np.frombuffer(r[0], np.int64) for r in answers.filter(F.col("kind") == TOTAL).select("values").collect()]  # one a shard
    train_docs = plain.filter("__train").count()
    n_train = int(sum(t[1] for t in totals)) + train_docs
    distinct = int(sum(t[0] for t in totals)) + (train_docs > 0)
    base = math.log10(n_train + distinct + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, _SLICE):
            kinds = run.column("kind").to_numpy()
            split = np.searchsorted(kinds, [WORD, TOTAL])
            told = {GRAM: run.slice(0, split[0]), WORD: run.slice(split[0], split[1] - split[0])}
            rows = run.slice(split[1]).combine_chunks()
            at, part_of = rows.column("at").to_numpy(), {k: t.column("part").to_numpy() for k, t in told.items()}
            starts = np.unique(part_of[GRAM])
            cuts = [*np.searchsorted(at, starts[1:]).tolist(), len(at)]
            for start, low, high in zip(starts.tolist(), [0, *cuts[:-1]], cuts, strict=True):
                own = {k: told[k].filter(pa.array(part_of[k] == start)).column("values") for k in told}
                yield from _finish_part(rows.slice(low, high - low), _concat(own[GRAM], np.float32)[0], _concat(own[WORD], np.int64)[0])

    def _finish_part(rows: pa.Table, cost: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        ready, distinct_grams, vocabulary = [], [], set()
        for batch in rows.to_batches():
            for part in slices(batch, "__text", 1 << 20):
                values = [t.encode("utf-8", "replace") for t in texts(part.column("__text"))]
                distinct_grams.append(np.unique(grams(*layout(values, order), order)))
                for v in values:
                    vocabulary.update(v.lower().split())
                ready.append((part, values))
        ask_grams = wanted_grams(np.unique(np.concatenate(distinct_grams)), shards)
        table = Lookup(ask_grams.first, cost)
        ordered = list(vocabulary)
        ask_words = wanted_words(ordered, shards) if ordered else None
        seen = {ordered[i]: c for i, c in zip(ask_words.order.tolist(), count.tolist(), strict=True)} if ordered else {}
        for part, values in ready:
            flat, starts, sizes = layout(values, order)
            model = np.add.reduceat(table.get(grams(flat, starts, sizes, order)).astype(np.float64), np.cumsum(sizes) - sizes)
            tokens, known, plain_score = [], [], []
            for v in values:
                ws = v.lower().split()
                c = np.append(np.fromiter(map(seen.__getitem__, ws), np.float64, len(ws)), train_docs)
                tokens.append(len(c))
                known.append(int((c > 0).sum()))
                plain_score.append(float(np.log10(c + 1).sum() - base * len(c)))
            learned = np.array(part.column("__train").to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [part.column("__key"), pa.array(~learned), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(np.full(len(tokens), n_train, np.int64)), pa.array(plain_score, pa.float64()), pa.array(model)],
                [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = plain.schema["__key"].dataType
    rows = plain.select(
        *_SLICE, F.lit(TOTAL).alias("kind"), F.lit(0).alias("shard"), "at", F.lit(0).cast("long").alias("part"), "__key", "__text", "__train",
        F.lit(None).cast("binary").alias("values"))
    told = answers.filter(F.col("kind") != TOTAL).select(
        *_SLICE, "kind", "shard", F.lit(0).cast("long").alias("at"), "part", F.lit(None).cast(kind).alias("__key"),
        F.lit(None).cast("string").alias("__text"), F.lit(None).cast("boolean").alias("__train"), "values")
    met = rows.union(told).repartition(*_SLICE).sortWithinPartitions(*_SLICE, "kind", "part", "shard", "at")
    return met.mapInArrow(finish, (
        f"`{key}` {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
