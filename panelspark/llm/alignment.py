"""Alignment of two tokenizers over a corpus: groups with common ends, linked ids and their document counts."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Memory, Scratch, slices, spelled_out, text_of, texts
from panelspark.llm.tokens import PLAIN, SPLIT, byte_symbols

#: Bytes of words whose ids a worker remembers for a tokenizer, and of text that it works on at once.
WORD_BYTES, SLICE_BYTES = 28 << 20, 1 << 20
#: Pairs of ids that a task holds with their counts: the most frequent ones; the others are joined.
HELD_PAIRS = 1 << 20
_BITS = 20  # of a token id within a pair
_SPACE_MARK = "▁"


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class ByteLevel:
    """Tokenizer of a ``.json`` file with byte-level symbols: ids of whole texts, bytes of each id."""

    def __init__(self, path: str, words: Memory | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.loads(open(path, encoding="utf-8").read())
        byte = byte_symbols()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        vocabulary = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.bytes = [
            added[i] if i in added else bytes(byte[c] for c in vocabulary[i]) if i in vocabulary else b"" for i in range(max(vocabulary) + 1)
        ]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        plain = spec["pre_tokenizer"] or {}
        self.split = spelled_out(SPLIT, PLAIN) if plain.get("type") == "ByteLevel" and plain.get("use_regex", True) and not spec["normalizer"] else None
        if plain.get("add_prefix_space"):
            self.split = None
        self.words = words or Memory(WORD_BYTES)

    def whole(self, raw: str) -> bytes:
        return _packed(self.library.encode(raw, add_special_tokens=False).ids)

    def pieces(self, raw: str) -> list[str] | None:
        """Parts that the tokenizer treats apart, if it is known to."""
        return self.split.findall(raw) if self.split is not None and PLAIN.fullmatch(raw) else None

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]

    def spelled(self, words: list[str]) -> list[str]:
        """What the ids of the words spell."""
        return words


class Pieces:
    """Tokenizer of a ``.model`` file that puts a space before the text: ids of space + text, bytes of each id."""

    def __init__(self, path: str, words: Memory | None = None):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(names)
        ]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        plain = [p for i, p in enumerate(names) if not (self.library.is_control(i) or self.library.is_unknown(i))]
        #: No token reaches from a word into the space behind it, so words with their space are merged apart.
        self.apart = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in plain)
        self.words = words or Memory(WORD_BYTES)

    def whole(self, raw: str) -> bytes:
        return _packed(self.library.encode(raw[1:]))

    def pieces(self, raw: str) -> list[str] | None:
        """Words behind one space each; texts with several spaces in a row are read whole."""
        return raw[1:].split(" ") if self.apart and "  " not in raw and raw[-1] != " " else None

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return self.library.encode(words, num_threads=1)

    def spelled(self, words: list[str]) -> list[str]:
        return [" " + w for w in words]


def tokenizer(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def _learn(tool: ByteLevel | Pieces, words: list[str]) -> None:
    """Remember the ids of new words, or None where their bytes differ."""
    ids = tool.encode_words(words)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
    spelled = tool.spelled(words)
    joined = "".join(spelled).encode()
    stops = np.concatenate([[0], np.cumsum(sizes)])
    said = np.diff(np.concatenate([[0], np.cumsum(tool.sizes[flat])])[stops])
    whole = len(joined) == sum(map(len, spelled))  # one byte a character
    lengths = np.fromiter(map(len, spelled) if whole else (len(w.encode()) for w in spelled), np.int64, len(spelled))
    same = (said == lengths).all() and b"".join(map(tool.bytes.__getitem__, flat.tolist())) == joined
    raw, stops = flat.astype("<i4").tobytes(), (4 * stops).tolist()
    if same:
        kept = [raw[a:b] for a, b in pairwise(stops)]
    else:
        kept = [
            raw[a:b] if b"".join(map(tool.bytes.__getitem__, own)) == text.encode() else None
            for (a, b), own, text in zip(pairwise(stops), ids, spelled, strict=True)
        ]
    tool.words.keep(words, kept, 4 * len(flat) + len(joined))


def encode(tool: ByteLevel | Pieces, raws: list[str]) -> list[bytes | None]:
    """Ids of each text; None where the bytes of the ids are not those of the text."""
    parts = [tool.pieces(raw) for raw in raws]
    new = tool.words.missing(set().union(*filter(None, parts)))
    known = tool.words.known
    for start in range(0, len(new), 4096):
        _learn(tool, new[start : start + 4096])
    out: list[bytes | None] = []
    for raw, part in zip(raws, parts, strict=True):
        if part is not None:
            try:
                out.append(b"".join(map(known.__getitem__, part)))
                continue
            except TypeError:  # a word without ids
                pass
        joined = tool.whole(raw)
        same = b"".join(map(tool.bytes.__getitem__, np.frombuffer(joined, "<i4").tolist())) == raw.encode()
        out.append(joined if same else None)
    tool.words.make_room()
    return out


def identity_map(a: list[bytes], b: list[bytes], b_bytes_only: set[int] = frozenset()) -> np.ndarray:
    """For each A id the B id of the same bytes, or -1; ids that stand for a single raw byte come last."""
    at: dict[bytes, int] = {}
    for i, value in enumerate(b):
        if value and (value not in at or at[value] in b_bytes_only):
            at[value] = i
    return np.array([at.get(value, -1) if value else -1 for value in a], np.int64)


def _cells(size: int) -> np.ndarray:
    """Decimal digits of each id, padded with zero bytes, and an empty last place for the separator."""
    width = len(str(size)) + 1
    return np.frombuffer("".join(str(i).ljust(width, "\0") for i in range(size)).encode(), np.uint8).reshape(size, width).copy()


class Aligner:
    """Groups and links of the texts of a slice, all at once over their joined tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokenizer(path_a), tokenizer(path_b)
        self.len_a, self.len_b = self.a.sizes, self.b.sizes
        raw = {i for i in range(len(self.b.bytes)) if isinstance(self.b, Pieces) and self.b.library.is_byte(i)}
        self.same = identity_map(self.a.bytes, self.b.bytes, raw)
        if max(len(self.len_a), len(self.len_b)) > 1 << _BITS:
            raise ValueError("a vocabulary has more ids than a pair has room for")
        size = max(len(self.len_a), len(self.len_b))
        self.cells = _cells(size)
        self.digits = (self.cells != 0).sum(1)

    def align(self, values: list[str]) -> dict[str, object]:
        raws = [" " + v for v in values]
        ids_a, ids_b = encode(self.a, raws), encode(self.b, raws)
        usable = [bool(v) and x is not None and y is not None for v, x, y in zip(values, ids_a, ids_b, strict=True)]
        ids_a, ids_b = ([x if u else b"" for x, u in zip(ids, usable, strict=True)] for ids in (ids_a, ids_b))
        n = len(values)
        n_a, n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.frombuffer(b"".join(ids), "<i4").astype(np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # Ends of all texts on one line: a text's last end is common to both sides.
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        common = (end_a[of_a] == ends) & (end_b[of_b] == ends) if len(ends) else np.zeros(0, bool)
        text_end = np.concatenate([[0], end_a])[np.cumsum(n_a)]
        link_ends = np.searchsorted(ends, text_end, side="right")
        n_links = np.diff(link_ends, prepend=0)
        groups = np.concatenate([[0], np.cumsum(common)])
        n_groups = np.diff(groups[link_ends], prepend=0)
        sha = self._group_hashes(a, b, end_a, end_b, ends[common], n_a, n_b, usable)
        link_a, link_b = a[of_a], b[of_b]
        document = np.repeat(np.arange(n), n_links)
        same = self.same[link_a] == link_b
        out = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha}
        for name, chosen in (("same", same), ("pair", ~same)):
            key = (document[chosen] << (2 * _BITS)) | (link_a[chosen] << _BITS) | link_b[chosen]
            key, times = np.unique(key, return_counts=True)
            which, pair = key >> (2 * _BITS), key & ((1 << (2 * _BITS)) - 1)
            out[name] = pair >> _BITS if name == "same" else pair
            out[name + "_n"], out[name + "_at"] = times, np.searchsorted(which, np.arange(n + 1))
        return out

    def _group_hashes(self, a, b, end_a, end_b, common, n_a, n_b, usable) -> list[str]:
        """Hash of ``a1,a2|b1;...`` per text: digits of all ids in order of group and side."""
        side = np.concatenate([2 * np.searchsorted(common, end_a), 2 * np.searchsorted(common, end_b) + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([a, b])[order], side[order]
        cells = self.cells[ids]
        mark = np.where(side & 1, ord(";"), ord("|")).astype(np.uint8)
        mark[:-1][side[1:] == side[:-1]] = ord(",")
        stops = np.cumsum(n_a + n_b)
        mark[stops[np.flatnonzero(n_a)] - 1] = 0
        cells[:, -1] = mark
        flat = cells.reshape(-1)
        flat = flat[flat != 0].tobytes()
        at = np.concatenate([[0], np.cumsum(self.digits[ids] + (mark != 0))])[stops]
        out, start = [], 0
        for stop, use in zip(at.tolist(), usable, strict=True):
            out.append(hashlib.sha256(flat[start:stop]).hexdigest() if use else "")
            start = stop
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's own: reading the vocabularies takes longer than a small task, and what it remembers is bounded."""
    return Aligner(path_a, path_b)


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"
_LINKS = "same array<long>, same_n array<long>, pair array<long>, pair_n array<long>"


def _list(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))


def link_texts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, its counts and group hash, the A ids linked to the B id of the same bytes with
    how often, the other linked pairs (A id << 20 | B id) with how often. A last row per task (``vector`` true)
    holds the task's vector over the A ids: how many documents have the id so linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        vector, kind = np.zeros(len(tool.same), np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, "__text", SLICE_BYTES):
                found = tool.align(texts(part.column("__text")))
                vector += np.bincount(found["same"], minlength=len(vector))
                columns = [part.column(0), *(pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links"))]
                columns.append(pa.array(found["groups_sha256"], pa.string()))
                for name in ("same", "pair"):
                    columns += [_list(found[name], found[name + "_at"]), _list(found[name + "_n"], found[name + "_at"])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(part.num_rows, bool))], names)
        used = np.flatnonzero(vector)
        if len(used):
            nothing = [pa.nulls(1, pa.int64())] * 4
            at, none = np.array([0, len(used)]), _list(np.zeros(0, np.int64), np.array([0, 0]))
            columns = [pa.nulls(1, kind), *nothing, pa.nulls(1, pa.string()), _list(used, at), _list(vector[used], at), none, none, pa.array([True])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pair", "pair_n", "vector"]
    schema = f"key {docs.schema[key].dataType.simpleString()}, {_COUNTS}, groups_sha256 string, {_LINKS}, vector boolean"
    return docs.select(F.col(key).alias("key"), text_of(text).alias("__text")).mapInArrow(run, schema)


def _held(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The most frequent pairs, at most ``limit``, with their counts; and whether there are others."""
    ladder = F.length(F.bin("n")) - 1
    steps = {r.step: r.pairs for r in counts.groupBy(ladder.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).collect()}  # at most 63
    least, room = 64, limit
    for step in sorted(steps, reverse=True):
        if steps[step] > room:
            break
        room -= steps[step]
        least = step
    held = counts.filter(F.col("n") >= (1 << least) if least < 63 else F.lit(False)).toArrow()
    pair, n = (held.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    order = np.argsort(pair)
    return pair[order], n[order], sum(steps.values()) > len(pair)


def align(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", held_pairs: int = HELD_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """The documents' alignment and the corpus-wide pairs.

    First: one row per document with ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. Both
    token sequences spell space + text; where tokens of both end, groups are cut; tokens that overlap are linked.
    ``n_best`` counts links whose pair is found in as many documents as any pair of their A id, ``count_sum`` adds
    up over the links the documents that have their pair. Second: ``a_id, b_id, documents`` for every pair.

    Pairs of the same bytes, known from the vocabularies, are counted in vectors of vocabulary length, one per
    task, and never shuffled; only the others are, combined per task first. Counts go back to the documents by
    vectors of vocabulary length and the ``held_pairs`` most frequent others; what is rarer is joined on the pair.

    Null and empty texts, and texts that one of the tokenizers doesn't spell out, have no tokens: zeros and an empty
    hash. Repeated rows are documents of their own; null keys stay; extra columns are ignored. Long texts are
    tokenized whole.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    linked = scratch.write(link_texts(docs, path_a, path_b, key, text).withColumn("row", F.monotonically_increasing_id()), "linked")
    zipped = F.explode(F.arrays_zip(F.col("same").alias("id"), F.col("same_n").alias("n"))).alias("s")
    vectors = linked.filter("vector").select(zipped).groupBy(F.col("s.id").alias("id")).agg(F.sum("s.n").alias("n"))
    vectors = scratch.write(vectors, "vectors")
    counts = linked.filter("NOT vector").select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.write(counts, "pairs")
    tool_a, tool_b = tokenizer(path_a), tokenizer(path_b)
    size = len(tool_a.bytes)
    same_count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in vectors.collect():  # at most the A vocabulary
        same_count[r.id] = best[r.id] = r.n
    for r in counts.groupBy(F.shiftright("pair", _BITS).alias("id")).agg(F.max("n").alias("n")).collect():  # the same bound
        best[r.id] = max(best[r.id], r.n)
    held, held_n, more = _held(counts, held_pairs)
    shared = spark.sparkContext.broadcast((same_count, best, held, held_n))
    kind = docs.schema[key].dataType.simpleString()
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare", "rare_n"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_count, best, held, held_n = shared.value
        for batch in batches:
            rows = batch.num_rows
            lists = {n: batch.column(n) for n in ("same", "same_n", "pair", "pair_n")}
            flat = {n: c.flatten().to_numpy() for n, c in lists.items()}
            n_best, count_sum = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            owner = {n: np.repeat(np.arange(rows), lists[n].value_lengths().to_numpy()) for n in ("same", "pair")}

            def add(who: np.ndarray, ids: np.ndarray, count: np.ndarray, times: np.ndarray) -> None:
                np.add.at(count_sum, who, count * times)
                np.add.at(n_best, who, np.where(best[ids] == count, times, 0))

            add(owner["same"], flat["same"], same_count[flat["same"]], flat["same_n"])
            at = np.searchsorted(held, flat["pair"])
            known = at < len(held)
            known[known] = held[at[known]] == flat["pair"][known]
            add(owner["pair"][known], flat["pair"][known] >> _BITS, held_n[at[known]], flat["pair_n"][known])
            starts = np.searchsorted(owner["pair"][~known], np.arange(rows + 1))
            rare = [_list(flat[n][~known], starts) for n in ("pair", "pair_n")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:7]), pa.array(n_best), pa.array(count_sum), *rare], names)

    schema = f"row long, key {kind}, {_COUNTS}, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_n array<long>"
    told = scratch.write(linked.filter("NOT vector").drop("vector").mapInArrow(look_up, schema), "told")
    shared.destroy()
    if more:
        best_of = spark.createDataFrame(pa.table({"id": np.arange(size), "best": best}))
        others = told.select("row", F.explode(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_n").alias("times"))).alias("r"))
        others = others.select("row", "r.pair", "r.times").join(counts, "pair").withColumn("id", F.shiftright("pair", _BITS)).join(best_of, "id")
        sums = others.groupBy("row").agg(
            F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("n") * F.col("times")).alias("more_sum"),
        )
        told = told.join(sums, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
        told = told.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    documents = told.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    raw = {i for i in range(len(tool_b.bytes)) if isinstance(tool_b, Pieces) and tool_b.library.is_byte(i)}
    same = identity_map(tool_a.bytes, tool_b.bytes, raw)
    used = np.flatnonzero(same_count)
    alike = spark.createDataFrame(pa.table({"a_id": used, "b_id": same[used], "documents": same_count[used]}))
    others = counts.select(
        F.shiftright("pair", _BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << _BITS) - 1).alias("b_id"), F.col("n").alias("documents")
    )
    return documents, others.unionByName(alike)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    return align(docs, path_a, path_b, **options)[0]
