"""Packing of tokenized documents into sequences of fixed size by bin completion."""

from __future__ import annotations

import json
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Memory, Scratch, slices, spelled_out, text_of, texts
from panelspark.llm.tokens import byte_symbols

#: Characters on whose classes and case all libraries agree; other texts go through the tokenizer whole.
PLAIN = regex.compile(r"[\x09\x0A\x0D\x20-\x7E\xA1-ɏ]*")
WORD_BYTES = 120 << 20  # of remembered words in a worker



class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, for one tokenizer file.

    Where the file lower-cases, drops white space and splits into words that are encoded each by
    itself, words are encoded once (by the library's model alone, as they are lower-cased and split already)
    and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.split = None
        if steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"]:
            bytes_only = not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
            if splits[0]["behavior"] == "Removed" and splits[0]["invert"] and bytes_only:
                self.split = spelled_out(splits[0]["pattern"]["Regex"], PLAIN)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.model, self.symbols = self.library.model, {byte: char for char, byte in byte_symbols().items()}
        self.memory = Memory(WORD_BYTES)

    def _word(self, word: str) -> list[int]:
        """Ids of a word as the split gives it."""
        if not word.isascii():  # ASCII without white space stands for itself
            word = word.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.model.tokenize(word)]

    def _whole(self, value: str) -> bytes:
        return np.array(self.library.encode(value, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, values: list[str]) -> list[bytes]:
        plain = [self.split is not None and PLAIN.fullmatch(v) is not None and not (self.specials and self.specials.search(v)) for v in values]
        words = [self.split.findall(v.lower()) if p else None for v, p in zip(values, plain, strict=True)]
        new = self.memory.missing(set().union(*filter(None, words)))
        for start in range(0, len(new), 8192):
            some = new[start : start + 8192]
            ids = list(map(self._word, some))
            raw = np.fromiter(chain.from_iterable(ids), np.uint32).astype("<u4").tobytes()
            stops = [0, *accumulate(4 * len(i) for i in ids)]
            self.memory.keep(some, [raw[a:b] for a, b in pairwise(stops)], len(raw) + sum(map(len, some)))
        get = self.memory.known.__getitem__
        out = [b"".join(map(get, part)) if part is not None else self._whole(v) for v, part in zip(values, words, strict=True)]
        self.memory.make_room()
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32`` and the piece's number ``__nth`` among those of its length
    in the task ``__task``. A text is tokenized whole and ends with ``end_id``; only longer ones are cut.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "__text", 4 << 20):
                rows, piece, start, length, crc, nth = [], [], [], [], [], []
                for i, raw in enumerate(ids.encode(texts(part.column("__text")))):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * size)):
                        own = raw[at : at + 4 * size]
                        n = len(own) // 4
                        rows.append(i), piece.append(k), start.append(at // 4), length.append(n)
                        crc.append(zlib.crc32(own)), nth.append(seen[n])
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), task, np.int64)),
                     pa.array(nth, pa.int64())],
                    [key, "piece", "start", "length", "ids_crc32", "__task", "__nth"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, __task long, __nth long"
    return docs.select(F.col(key), text_of(text).alias("__text")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Runs of pieces of one length: those numbered from ``first`` on go to ``per_bin`` places, from
    ``offset`` on, in each of the sequences from ``bin`` on."""

    bins: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, bin, per_bin, offset


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), number of sequences


class BinCompletion:
    """Fillings of sequences of ``size`` for ``counts[length]`` pieces of each length.

    The largest piece left opens a sequence; the undominated sets of pieces that complete it are
    searched depth first, largest pieces first. A set is dominated if a piece left over fits beside
    it, or could take the place of one or two smaller ones in it. Copies of a filling are made at
    once while the counts allow. The incumbent takes the best-fitting completion at each step; what
    it fills without waste stays, and the rest is improved by branching over the completions,
    pruned by the waste that a better solution may have in all. The search is the same for any number
    of pieces; ``nodes`` bounds how many branches are tried after the first descent, ``fill_nodes`` the
    completions of one sequence. They limit how much is improved, never whether every piece is placed.
    """

    def __init__(self, counts: np.ndarray, size: int, nodes: int = 20_000, fill_nodes: int = 300):
        self.size, self.nodes, self.fill_nodes = size, nodes, fill_nodes
        self.counts = np.asarray(counts, np.int64).copy()

    def solve(self) -> list[Pattern]:
        total = int((np.arange(len(self.counts)) * self.counts).sum())
        found = self._best_fit(self.counts.copy())
        bins = sum(n for _, n in found)
        if bins > -(-total // self.size):
            tight = [p for p in found if self._sum(p[0]) == self.size]
            loose = [p for p in found if self._sum(p[0]) < self.size]
            found = tight + self._branch(loose)
        return found

    def _sum(self, filling) -> int:
        return sum(length * n for length, n in filling)

    def _best_fit(self, counts: np.ndarray) -> list[Pattern]:
        found: list[Pattern] = []
        while counts.any():
            filling = next(iter(self._fillings(counts, best_only=True)))
            times = min(int(counts[length]) // n for length, n in filling)
            for length, n in filling:
                counts[length] -= n * times
            found.append((filling, times))
        return found

    def _fillings(self, counts: np.ndarray, best_only: bool = False) -> list[tuple[tuple[int, int], ...]]:
        """Completions around the largest piece, the fullest first."""
        left = counts.copy()
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        found: dict[tuple[int, ...], int] = {}
        budget, best = [self.fill_nodes], [-1]

        def search(room: int, top: int, chosen: list[int]) -> None:
            """Add pieces of at most ``top``; ``left`` holds what is free."""
            budget[0] -= 1
            if room <= top and left[room] > 0 and room > 0:  # nothing fits better
                found[(*chosen, room)] = 0
                best[0] = self.size
                return
            options = np.flatnonzero(left[1 : min(room, top) + 1])[::-1] + 1
            if not len(options):
                found[tuple(chosen)] = room
                best[0] = max(best[0], self.size - room)
                return
            if budget[0] <= 0 and not found:  # deep in small pieces: largest first, so that none fits beside them
                for length in map(int, options):
                    n = min(int(left[length]), room // length)
                    chosen, room = [*chosen, *[length] * n], room - n * length
                found[tuple(chosen)] = room
                best[0] = self.size - room
                return
            if room - options[0] > 0:  # two pieces that fill the room exactly
                small = room - options
                fits = (small > 0) & (small <= options) & (left[np.maximum(small, 0)] > (small == options))
                if fits.any():
                    a = int(options[np.argmax(fits)])
                    found[(*chosen, a, room - a)] = 0
                    best[0] = self.size
                    if best_only:
                        return
            for length in map(int, options):
                if budget[0] <= 0 or best_only and best[0] == self.size:
                    return
                left[length] -= 1
                search(room - length, length, [*chosen, length])
                left[length] += 1

        search(self.size - largest, self.size, [])
        ranked = sorted(found, key=lambda c: (found[c], tuple(-x for x in c)))
        if best_only:
            ranked = ranked[:1]
        else:
            ranked = [c for c in ranked if not self._dominated(c, found[c], left)]
        out = []
        for c in ranked:
            sizes, n = np.unique([largest, *c], return_counts=True)
            out.append(tuple(zip(sizes.tolist()[::-1], n.tolist()[::-1], strict=True)))
        return out

    @staticmethod
    def _dominated(chosen: tuple[int, ...], waste: int, left: np.ndarray) -> bool:
        spare = left.copy()
        for c in chosen:
            spare[c] -= 1
        if spare[1 : waste + 1].any():
            return True
        times = Counter(chosen)
        return any(spare[a + 1 : a + waste + 1].any() for a in times) or any(
            spare[a + b : a + b + waste + 1].any() for a in times for b in times if a < b or a == b and times[a] > 1
        )

    def _branch(self, loose: list[Pattern]) -> list[Pattern]:
        """A solution of the pieces in ``loose`` with fewer sequences, if one is found in time."""
        counts = np.zeros_like(self.counts)
        for filling, times in loose:
            for length, n in filling:
                counts[length] += n * times
        total, best = int((np.arange(len(counts)) * counts).sum()), loose
        budget = [self.nodes]

        def choices(allowed: int) -> Iterator[tuple[tuple[tuple[int, int], ...], int, int]]:
            """Fillings with the number of copies and the waste of one, the least waste first."""
            for filling in self._fillings(counts):
                waste = self.size - self._sum(filling)
                if waste > allowed:
                    return
                most = min(int(counts[length]) // n for length, n in filling)
                if waste:  # half of the copies that may be made, so that depth grows as the logarithm of the counts
                    most = max(1, min(most, allowed // waste) // 2)
                    yield filling, most, waste
                if not waste or most > 1:
                    yield filling, 1 if waste else most, waste

        def take(filling, times: int) -> None:
            for length, n in filling:
                counts[length] -= n * times

        def dive(allowed: int, first: bool) -> list[Pattern] | None:
            """The ``first`` descent costs nothing, so that large inputs get to its end as small ones do."""
            path: list[tuple] = []
            levels = [choices(allowed)]
            while levels and counts.any():
                step = next(levels[-1], None) if first or budget[0] > 0 else None
                if step is None:
                    first = False
                    levels.pop()
                    if path:
                        filling, times, waste = path.pop()
                        take(filling, -times)
                        allowed += waste * times
                    continue
                budget[0] -= not first
                filling, times, waste = step
                take(filling, times)
                path.append(step)
                allowed -= waste * times
                levels.append(choices(allowed))
            done = [(filling, times) for filling, times, _ in path] if levels else None
            for filling, times, _ in path:
                take(filling, -times)
            return done

        first = True
        while budget[0] > 0:
            bins = sum(n for _, n in best) - 1
            allowed = bins * self.size - total
            better = dive(allowed, first) if allowed >= 0 else None
            if better is None:
                break
            best, first = better, False
        return best


def make_plan(counts: np.ndarray, size: int) -> Plan:
    plan, used = Plan(), np.zeros(size + 1, np.int64)
    for filling, times in BinCompletion(counts, size).solve():
        offset = 0
        for length, n in filling:
            plan.runs.append((length, int(used[length]), plan.bins, n, offset))
            used[length] += n * times
            offset += n * length
        plan.bins += times
    return plan


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    Which pieces of a length share a sequence does not matter, so the packing is solved on the number
    of pieces of each length, at most ``size`` counts however many documents there are. Pieces are
    numbered within their length by the task's own count and the sum of the earlier tasks' counts,
    and look their place up in the plan (at most the sum of size / length runs of 40 bytes; in
    practice some thousands). Every row is a document of its own, repeated rows and null keys too;
    null text is the end id alone. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, path, size, end_id, key, text), "pieces")
    by_task = cut.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "__task", "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    starts = scratch.write(starts, "starts")
    counts = np.zeros(size + 1, np.int64)
    for length, n in starts.groupBy("length").agg(F.sum("__n")).collect():  # at most `size` rows
        counts[length] = n
    plan = make_plan(counts, size)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        first = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("__number").to_numpy()
            run = table[np.searchsorted(first, length << 48 | number, side="right") - 1]
            within = number - run[:, 1]
            sequence = run[:, 2] + within // run[:, 3]
            offset = run[:, 4] + within % run[:, 3] * length
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names[:5], "sequence_id", "offset"])

    numbered = cut.join(starts, ["length", "__task"]).select(
        key, "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__nth")).alias("__number")
    )
    kind = docs.schema[key].dataType.simpleString()
    return numbered.mapInArrow(
        place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences that any packing needs: by the sum, and by pieces over half a sequence."""
    lengths = np.arange(len(counts))
    return max(math.ceil(int((lengths * counts).sum()) / size), int(counts[size // 2 + 1 :].sum()))
