"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Memory, slices, text_of, texts

#: Fixed value: the split pattern of byte-level vocabularies, as published with them.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes all regular expression libraries agree; other texts are split by the tokenizer itself.
PLAIN = regex.compile(r"[\x09\x0A\x0D\x20-\x7E\xA1-ɏ]*")
_SPLIT = regex.compile(SPLIT)
WORD_BYTES = 40 << 20  # of remembered pre-tokens in a worker
_NEVER = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class MergeTable:
    """Pair of symbols -> (rank, joined symbol), as an open-addressing table of NumPy arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.joined = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NEVER, np.int64)
        keys, ranks, slot = left << 32 | right, np.arange(len(pairs)), self._slot(left << 32 | right)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.ranks[slot[free]] = keys[free], ranks[free]  # of a clash the last one stays
            lost = self.keys[slot] != keys
            keys, ranks, slot = keys[lost], ranks[lost], slot[lost] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the largest integer where it is no merge."""
        keys = left << 32 | right
        slot, out = self._slot(keys), np.full(len(keys), _NEVER)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            open_, slot = open_[on], slot[on] + 1 & (1 << self.bits) - 1
        return out


def merge_counts(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> np.ndarray:
    """How many symbols are left of each sequence when all its merges are done.

    ``symbols`` holds the sequences end to end, ``lengths`` their sizes (0 allowed). In a round every
    sequence joins all places of its own lowest-ranked pair, left to right; a sequence without a
    pair to merge is finished and leaves the arrays.
    """
    out = lengths.astype(np.int64)
    alive = np.flatnonzero(out > 1)
    owner = np.repeat(np.arange(len(out)), out)
    symbols = symbols[out[owner] > 1].astype(np.int64)
    sizes = out[alive]
    while len(alive):
        first = np.cumsum(sizes) - sizes
        seq = np.repeat(np.arange(len(alive)), sizes)
        rank = np.full(len(symbols), _NEVER)
        inside = seq[:-1] == seq[1:]
        rank[:-1][inside] = table.rank(symbols[:-1][inside], symbols[1:][inside])
        lowest = np.minimum.reduceat(rank, first)
        hit = (rank == lowest[seq]) & (rank != _NEVER)
        # Of places that overlap (a pair of equal symbols in a longer run) every second one counts.
        at = np.flatnonzero(hit)
        run_start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0)) if len(at) else at
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols[at] = table.joined[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(seq[at], minlength=len(alive))
        out[alive] = sizes
        going = (lowest != _NEVER) & (sizes > 1)
        keep &= going[seq]
        symbols, alive, sizes = symbols[keep], alive[going], sizes[going]
    return out


class Counter:
    """Counts the tokens of texts for one tokenizer file, remembering pre-tokens it has merged."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level vocabulary without normalizer is asked for")
        vocabulary, self.bytes = spec["model"]["vocab"], byte_symbols()
        self.table = MergeTable(vocabulary, spec["model"]["merges"])
        self.first = np.zeros(256, np.int64)
        for char, byte in self.bytes.items():
            self.first[byte] = vocabulary[char]
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.memory = Memory(WORD_BYTES)

    def _pretokens(self, text: str) -> list[bytes]:
        if PLAIN.fullmatch(text):
            return [p.encode() for p in _SPLIT.findall(text)]
        return [bytes(map(self.bytes.__getitem__, p)) for p, _ in self.library.pre_tokenize_str(text)]

    def count(self, values: list[str]) -> list[int]:
        """Tokens of each text; a special token's string in a text is that one token."""
        specials, parts = [], []
        for value in values:
            pieces = self.specials.split(value) if self.specials else [value]
            specials.append(len(pieces) - 1)
            parts.append([p for piece in pieces if piece for p in self._pretokens(piece)])
        new = self.memory.missing(set().union(*parts))
        if new:
            lengths = np.array([len(p) for p in new])
            counts = merge_counts(self.first[np.frombuffer(b"".join(new), np.uint8)], lengths, self.table)
            self.memory.keep(new, counts.tolist(), int(lengths.sum()))
        out = [s + sum(map(self.memory.known.__getitem__, part)) for s, part in zip(specials, parts, strict=True)]
        self.memory.make_room()
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def add_token_counts(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """Add ``name``: tokens of the whole text (null: 0), no tokens added, none cut off.

    ``path`` is a byte-level ``tokenizers`` file that every executor has. No shuffle; texts pass
    through in pieces of a few MB. An existing column ``name`` is replaced; without ``keep_text`` the text
    does not come back.
    """
    kept = [c for c in docs.columns if c != name and (keep_text or c != text)]
    own, given = [f"c{i}" for i in range(len(kept))], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part in slices(batch, "read", 4 << 20):
                n = pa.array(counts.count(texts(part.column("read"))), pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in own[:given]], n], [*own[:given], "counted"])

    read = "read" if text not in kept or docs.schema[text].dataType.simpleString() != "string" else own[kept.index(text)]
    sent = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)], *([text_of(text).alias("read")] if read == "read" else []))
    if read != "read":  # the text is among the columns
        sent = sent.withColumnRenamed(read, "read")
        own[kept.index(text)] = "read"
    schema = ", ".join([*[f"{o} {docs.schema[c].dataType.simpleString()}" for c, o in zip(kept, own, strict=True)], "counted bigint"])
    return sent.mapInArrow(run, schema).toDF(*kept, name)


def token_report(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row."""
    slim = docs.select(F.col(key).alias("key"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("raw"))
    counted = add_token_counts(slim, path, "raw", keep_text=False)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
