"""Tokenizer alignment against the libraries and a plain count of every overlapping pair."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from panelspark.llm import alignment
from panelspark.llm.common import Memory, table
from panelspark.llm.queries import QUERIES
from panelspark.llm.tokens import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _brute(rows):
    """Columns of the contract and the count of each pair, from the libraries' ids of whole texts."""
    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    byte = byte_symbols()
    said, docs = [], collections.Counter()
    for k, t in rows:
        a = b = []
        if t:
            a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
                 for i in second.encode(t) for p in [second.id_to_piece(i)]]
            want = (" " + t).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        groups, links, i, j, at_a, at_b, start = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a) or j < len(b):
            links.append((a[i][0], b[j][0]))
            end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
            if at_a == at_b:
                groups.append(",".join(str(x) for x, _ in a[start[0]:i]) + "|" + ",".join(str(x) for x, _ in b[start[1]:j]))
                start = i, j
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        said.append((k, len(a), len(b), len(groups), links, sha))
        docs.update(set(links))
    best = collections.Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = [(k, n_a, n_b, g, len(s), sum(docs[p] == best[p[0]] for p in s), sum(docs[p] for p in s), sha) for k, n_a, n_b, g, s, sha in said]
    return sorted(out, key=str), docs


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_query(spark, sf):
    got = QUERIES["op12_tokenizer_alignment"](spark, sf)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == _brute(_rows(table(spark, sf, "documents")))[0]


AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "   two  spaces \t\n\n x "), (5, "▁ mark"), (6, "a ▁b c"), (7, "<s>a</s><unk> <|endoftext|>"), (8, "日本語 текст 😀 é ﬁ"),
    (8, "日本語 текст 😀 é ﬁ"), (None, "null key"), (9, "\x00\x01 ctrl"), (10, "<0x41> byte"), (11, "It's 'll don't  1234567 aaa aaaaaaa"),
    (12, "word " * 30_000), (13, "x" * 30_000), (14, "aa a aaa aa"), (15, " nbsp　wide"), (16, "Él está aquí, weiß größer."),
]


@pytest.mark.parametrize("held", [1 << 20, 0, 30])
def test_awkward(spark, sf, held):
    rows = AWKWARD + _rows(table(spark, sf, "documents"))[:40]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row long, pair string, n_a int")
    got, pairs = alignment.align(df, A, B, held_pairs=held)
    want, counts = _brute(rows)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect()), key=str) == want
    found = pairs.collect()
    assert len(found) == len(counts) and {(r.a_id, r.b_id): r.documents for r in found} == counts


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    got, pairs = alignment.align(df, A, B)
    assert got.count() == 0 and pairs.count() == 0
    one, _ = alignment.align(spark.createDataFrame([("k", None)], df.schema), A, B)
    assert [tuple(r) for r in one.collect()] == [("k", 0, 0, 0, 0, 0, 0, "")]


def test_words_are_forgotten():
    """Ids do not depend on what is remembered."""
    texts = [f" {i} Straße w{i} don't" for i in range(300)]
    small, large = alignment.ByteLevel(A, Memory(500)), alignment.ByteLevel(A)
    assert [alignment.encode(small, [t]) for t in texts] == [alignment.encode(large, [t]) for t in texts]
    assert len(small.words.known) < len(large.words.known)


def test_identity_map():
    assert alignment.identity_map([b"a", b"b", b"", b" c"], [b"b", b"a", b"a", b""], {1}).tolist() == [2, 0, -1, -1]
