"""The training-data operators against brute force, on given tables and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelspark.llm import components, exact, mixing, neardup, orderhash, packing, ppm, quality, recompress, substring, tokens, urls
from panelspark.llm.common import Scratch, WordHashes, table
from panelspark.llm.queries import ORACLE, QUERIES
from tools.check_oracle import connect, kinds, normalize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, length string, n string, size string"
LONG = " ".join(f"w{i * i % 997}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, "x", None, "y", "z", None)


AWKWARD = [
    _row(5, None), _row(7, ""), _row(8, " \t\n"), _row(1, "a b c"), _row(2, "a  b\nc"), _row(2, "a  b\nc"), _row(None, "a b c", None, None),
    _row(3, LONG, source=None), _row(4, "Ä <|endoftext|> ñ aaaa 12345 'll x " + PASSAGE), _row(9, PASSAGE + " tail", source=""),
    _row(10, "the " * 120), _row(11, "z " + "the " * 80), _row(12, "one"), _row(13, "İstanbul ΑΣ   é \x1c x", source="b"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf):
    return table(spark, sf, "documents")


def _texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# 9: exact dedup


def _exact(rows):
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), k is None, k or 0, k))
    return sorted((str(k), str(sorted(g)[0][3]), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, _, k in g)


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact(awkward, hash_all):
    got = exact.find_copies(awkward, hash_all=hash_all).collect()
    want = _exact(_texts(awkward))
    if hash_all:
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted(w[:3] for w in want)
    assert sum(r.kept for r in got) == len({w[3] for w in want})
    kept = exact.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({w[3] for w in want})


def test_exact_nothing(nothing):
    assert exact.find_copies(nothing).count() == 0 and exact.drop_copies(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toArrow(), connect(sf).sql(ORACLE[name]).to_arrow_table()
    assert normalize(got).equals(normalize(want)) and kinds(got) == kinds(want)


# 8: token counts


def test_tokens(awkward, nothing, small):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for docs in (awkward, small):
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_report(docs, path).collect())
        want = collections.Counter()
        for k, t in _texts(docs):
            n = len(library.encode(t, add_special_tokens=False).ids)
            want[k, len(t.encode()), n, n > 512] += 1
        assert got == want
    assert tokens.token_report(nothing, path).count() == 0


def test_merge_counts_ties():
    vocabulary = {"a": 0, "b": 1, "aa": 2, "aab": 3, "aaaa": 4}
    rules = tokens.MergeTable(vocabulary, [["a", "a"], ["aa", "b"], ["aa", "aa"]])
    sequences = [[0] * 5, [0, 0, 1], [1], [], [0, 1, 0, 0, 0, 1], [0] * 8]
    got = tokens.merge_counts(np.array(sum(sequences, [])), np.array([len(s) for s in sequences]), rules)
    assert got.tolist() == [2, 1, 1, 0, 5, 2]


# 7: packing


def test_packing(awkward, nothing, small):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for docs, size in ((awkward, 4096), (awkward, 7), (small, 4096)):
        got = packing.pack(docs, path, size).collect()
        want = collections.Counter()
        for k, t in _texts(docs):
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
            for p, at in enumerate(range(0, len(ids), size)):
                part = ids[at : at + size]
                want[k, p, at, len(part), zlib.crc32(part.tobytes())] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        filled = collections.defaultdict(list)
        for r in got:
            filled[r.sequence_id].append((r.offset, r.length))
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        counts = np.bincount([r.length for r in got], minlength=size + 1)
        assert len(filled) <= packing.lower_bound(counts, size) + (1 if size > 7 else len(got) // 20)
    assert packing.pack(nothing, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_optimal_when_small(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 15, 9).tolist()
    counts = np.bincount(lengths, minlength=16)
    got = sum(n for _, n in packing.BinCompletion(counts, 15).solve())

    def least(rest, bins):
        if not rest:
            return len(bins)
        best = len(lengths)
        for i in range(len(bins)):
            if bins[i] + rest[0] <= 15:
                best = min(best, least(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]]))
        return min(best, least(rest[1:], [*bins, rest[0]]))

    assert got == least(sorted(lengths, reverse=True), [])


# 1: mixing


def test_mixing(awkward, nothing, small):
    for docs in (small, awkward):
        got = mixing.draw(docs, max_repeats=2.0, block_tokens=2000).collect()
        per = collections.defaultdict(lambda: [0, 0])
        for r in got:
            per[r.source][0] += r.n_tokens
            assert 0 <= r.repeats <= 2.001 or r.n_tokens == 0
        own = collections.Counter()
        for r in docs.select("source", "text").collect():
            own[r.source or None] += len((r.text or "").encode().split())
        rows = collections.Counter(r["row"] for r in got)
        assert len(rows) == docs.count()  # nothing is lost
        for r in got:
            if own[r.source]:
                room = max(x.n_tokens for x in got if x.source == r.source)
                assert abs(per[r.source][0] - r.repeats * own[r.source]) <= room + 1
    weights = {r.source: r.weight for r in mixing.draw(small, entropy=1.5).collect()}
    assert abs(-sum(w * math.log(w) for w in weights.values()) - 1.5) > 0  # reached only between both ends
    assert abs(sum(weights.values()) - 1) < 1e-9
    mixed = mixing.mix_rows(awkward, max_repeats=1.5)
    assert mixed.columns == awkward.columns and mixed.count() >= awkward.count()
    assert mixing.draw(nothing, max_repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.draw(small)


# 2: order-sensitive fingerprints


def test_orderhash(awkward, nothing, small):
    for docs in (small, awkward):
        rows = _texts(docs)
        got = orderhash.edit_and_compare(docs).collect()
        by_text = collections.defaultdict(set)
        assert len(got) == len(rows)
        if docs is small:
            rows = sorted(rows)
            for (k, t), (_, u), r in zip(rows, rows[1:] + rows[:1], sorted(got, key=lambda r: r.doc_id), strict=True):
                half = len(t) // 2
                edited = t[: len(t) - half] + u[:half]
                assert (r.doc_id, r.n_chars, r.edited_sha256) == (k, len(t), hashlib.sha256(edited.encode()).hexdigest())
                by_text[t].add(r.fingerprint)
            assert all(len(f) == 1 for f in by_text.values())
            assert np.mean([r.near_edited for r in got]) > 5 * np.mean([r.near_next for r in got])
        assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert orderhash.edit_and_compare(nothing).count() == 0


def test_orderhash_sees_order(spark):
    a = [f"w{i}" for i in range(400)]
    moved = a[200:] + a[:200]
    other = [f"v{i}" for i in range(400)]
    df = spark.createDataFrame([(" ".join(a), " ".join(moved), " ".join(other), " ".join(a[:390] + other[:10]))], "a string, b string, c string, d string")
    for c in "abcd":
        df = orderhash.fingerprint(df, c, f"f{c}")
    near = df.select(*[orderhash.likeness(df.fa, df[f"f{c}"]).alias(c) for c in "abcd"]).first()
    assert near.a == 1 and near.c == 0 and near.d > 0.8 and near.b < near.d


# 3: url filters and components


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300)] + rng.integers(400, 480, (40, 2)).tolist()
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df, Scratch(spark, "t")).collect()}
    parent = {n: n for e in edges for n in map(int, e)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(int(a)), find(int(b))))
        parent[y] = x
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in map(int, e)}


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def test_urls(spark):
    rows = [
        (1, "https://www.Example.com/en/1?x=1#y", None), (2, "http://a.example.com/en/2", ""), (3, "no url", None), (4, None, "<p>"),
        (5, "http://x.org/1", '<link href="http://y.net/es/9" rel=canonical>'), (6, "http://x.org/1.html?utm_source=f", "<b>"),
        (7, "http://z.org/", '<META http-equiv="refresh" content="0; url=http://www.example.com/en/5">'),
        (8, "http://z.org", '<link rel="canonical" href="//b.net/es/">'), (9, "http://lone.org?q", None), (1, "https://www.Example.com/en/1?x=1#y", None),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, RULES, spelling=True).collect()), key=str)
    assert got == sorted([
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/2", "example.com/en/", "block"),
        (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "x.org", "/1", None, "block"), (6, "x.org", "/1.html", None, "block"),
        (7, "z.org", "/", None, "allow"), (8, "z.org", "", None, "allow"), (9, "lone.org", "", None, "allow"),
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ], key=str)
    plain = {r.page_id: r.verdict for r in urls.judge(df, RULES).collect()}
    assert (plain[5], plain[6], plain[7], plain[8]) == ("block", "allow", "allow", "block")  # by links, not by spelling
    assert urls.judge(df.limit(0), RULES).count() == 0 and urls.judge(df, []).filter("verdict = 'allow'").count() == len(rows)


def test_verdicts_travel_along_redirects(spark):
    """Random redirects, canonical links and crawler edges over several hops, against a walk over the classes."""
    rng = np.random.default_rng(12)
    hosts = ["a.org", "b.net", "www.example.com", "e.org", "c.io", "d.net"]
    url = [f"http://{hosts[i % 6]}/{('en', 'es', 'fr', 'zz')[i % 4]}/{i}" for i in range(90)]
    rows, edges = [], []
    for i in range(60):  # the others are targets without a page
        j = int(rng.integers(0, 90))
        tag = [f'<link rel="canonical" href="{url[j]}">', f'<meta http-equiv="refresh" content="0; url={url[j]}">', "", ""][i % 4]
        rows.append((i, url[i], f"<html>{tag}</html>"))
        if tag:
            edges.append((i, j))
    more = [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(15)]
    label = list(range(90))
    for _ in range(90):
        for a, b in edges + more:
            label[a] = label[b] = min(label[a], label[b])
    rules = [*RULES, ("net/fr/", "block")]

    def own(u):
        host, _, path = u[7:].partition("/")
        fits = [(len(r), v) for r, v in rules if ("." + host).endswith("." + r.split("/")[0]) and f"/{path}".startswith(r[len(r.split("/")[0]):])]
        return max(fits)[1] if fits else None

    told = {}
    known = {i for i in range(60)} | {k for e in edges + more for k in e}
    for i in known:
        told.setdefault(label[i], set()).add(own(url[i]))
    want = {i: own(url[i]) or ("allow" if "allow" in told[label[i]] else "block" if "block" in told[label[i]] else "allow") for i in range(60)}
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    crawled = spark.createDataFrame([(url[a], url[b]) for a, b in more], "a string, b string")
    got = {r.page_id: r.verdict for r in urls.judge(df, rules, edges=crawled).collect()}
    assert got == want and sum(v != (own(url[i]) or "allow") for i, v in want.items()) >= 3


def test_url_rules_on_pages(spark, sf):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    pages = table(spark, sf, "pages").select("page_id", "url").collect()
    got = {r.page_id: r for r in QUERIES["op3_url_filters"](spark, sf).collect()}
    for p in pages:
        rest = p.url.partition("://")[2]
        host = rest
        for c in "/?#":
            host = host.partition(c)[0]
        path = rest[len(host):].partition("?")[0].partition("#")[0]
        host = host.lower()
        fits = [(len(r), r, v) for r, v in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[len(r.split("/")[0]):])]
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert not fits or r.verdict == max(fits)[2]


# 5: near duplicates


def _links(rows):
    sets = []
    for _, t in rows:
        w = t.encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    root = [find(i) for i in range(len(rows))]
    sizes = collections.Counter(root)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, (True, 0)), (rows[i][0] is None, rows[i][0] or 0))
    return collections.Counter((str(k), str(least[root[i]][1]) if not least[root[i]][0] else "None", sizes[root[i]], links[i]) for i, (k, _) in enumerate(rows))


TILED = neardup.Settings(tile_members=2, tile_shingles=60)


@pytest.mark.parametrize("settings", [neardup.Settings(), TILED])
def test_near_duplicates(spark, awkward, small, settings):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    near = []
    for i in range(25):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"x{i}"
        near.append((100 + i, " ".join(words)))
    for docs in (awkward, spark.createDataFrame(near, "doc_id long, text string"), *([small] if settings is not TILED else [])):
        got = collections.Counter((str(r.doc_id), str(r.class_id), r.class_size, r.n_links) for r in neardup.near_duplicates(docs, settings=settings).collect())
        assert got == _links(_texts(docs))
        kept = neardup.drop_near_duplicates(docs, settings=settings)
        assert kept.columns == docs.columns


def test_near_nothing(nothing):
    assert neardup.near_duplicates(nothing).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    rule = neardup.least_matches(neardup.Settings())
    for n, m in rule:  # a pair at the threshold is dropped with a chance near the tolerance
        lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert lost < 1e-6
    assert rule[-1][1] > 60


# 6: repeats


def _without_repeats(rows, window):
    split = [(k, t.encode().split()) for k, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = collections.Counter()
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [3, 35])
def test_repeats(awkward, small, window):
    for docs in (awkward, small):
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, window, shard_names=100).collect())
        assert got == _without_repeats(_texts(docs), window)


def test_repeats_nothing(nothing):
    assert substring.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("words", [2, 5, 200])
def test_equal_windows_get_equal_names(words):
    rng = np.random.default_rng(words)
    core = rng.integers(1, words + 1, 150).astype(np.uint64)
    parts = []
    for _ in range(20):
        s = rng.integers(0, 60)
        parts += [rng.integers(1, words + 1, rng.integers(0, 60)).astype(np.uint64), core[s : s + 80], np.zeros(1, np.uint64)]
    flat = np.concatenate(parts)
    found = recompress.anchors(flat, flat == 0, 35, recompress.Ranges(flat))
    named, windows = {}, 0
    for name, first, last in zip(found.name.tolist(), found.first.tolist(), found.last.tolist(), strict=True):
        for i in range(first, last + 1):
            windows += 1
            assert named.setdefault(flat[i : i + 35].tobytes(), name) == name
    assert windows == sum(0 not in flat[i : i + 35] for i in range(len(flat) - 34))


# 4: language-model scores


def _ppm(counts, text, order):
    """Straight from the definition: method D, exclusion, uniform at the end."""
    total = 0.0
    data = bytes([ppm.END]) * order + text + bytes([ppm.END])
    for i in range(order, len(data)):
        gone: set[int] = set()
        for k in range(order, -1, -1):
            seen = counts[k].get(data[i - k : i])
            if seen is None:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            n = sum(left.values())
            if data[i] in left:
                total += math.log10((left[data[i]] - 0.5) / n)
                break
            if left:
                total += math.log10(0.5 * len(left) / n)
            gone |= set(seen)
        else:
            total -= math.log10(max(1, 256 - len(gone)))
    return total


@pytest.mark.parametrize("order", [2, 5])
def test_ppm(awkward, small, order):
    for docs in (awkward, small.filter("length(text) < 1500")):
        rule = quality.remainder("doc_id", 7) != 2
        rows = _texts(docs)
        learn = [k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows]
        counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
        words = collections.Counter()
        for (_, t), use in zip(rows, learn, strict=True):
            if use:
                data = bytes([ppm.END]) * order + t.encode() + bytes([ppm.END])
                for i in range(order, len(data)):
                    for k in range(order + 1):
                        counts[k][data[i - k : i]][data[i]] += 1
                words.update([*t.encode().lower().split(), None])
        n, v = sum(words.values()), len(words)
        want = []
        for (k, t), use in zip(rows, learn, strict=True):
            own = [*t.encode().lower().split(), None]
            base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
            want.append((str(k), not use, len(own), sum(words[w] > 0 for w in own), n, round(base, 4), round(_ppm(counts, t.encode(), order), 2)))
        got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.score(docs, rule, order).collect()]
        for g, w in zip(sorted(got), sorted(want), strict=True):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-3 and abs(g[6] - w[6]) < 0.05 + 1e-5 * abs(w[6])


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    flat, starts, sizes = ppm.layout([rng.integers(97, 103, 400).astype(np.uint8).tobytes()], 3)
    gram, count = np.unique(ppm.grams(flat, starts, sizes, 3), return_counts=True)
    trie = ppm.Trie([*ppm.lower_orders(gram, count, range(3)), (gram, count)])
    for context in (b"abc", b"fff", b"xyz", bytes([ppm.END]) * 3):
        c = (context[0] << 24) | (context[1] << 16) | (context[2] << 8)
        assert abs((10 ** trie.log10(np.arange(256, dtype=np.uint64) | np.uint64(c))).sum() - 1) < 1e-9


def test_ppm_nothing(nothing, awkward):
    assert ppm.score(nothing, quality.remainder("doc_id", 7) != 2).count() == 0
    untrained = ppm.score(awkward, quality.remainder("doc_id", 7) == 99).collect()
    assert all(abs(r.score + math.log10(256) * (len((t or "").encode()) + 1)) < 1e-2 * abs(r.score) for r, t in [(r, dict(_texts(awkward))[r.doc_id]) for r in untrained if r.doc_id in (1, 12)])


# 10: quality


def test_quality(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    held = labels.filter(quality.remainder("doc_id", 5) == 0).select("doc_id", "quality")
    got = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.1")
    assert got.count() == docs.count()
    rows = got.join(held, "doc_id").collect()
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 9), (4, 1, 9), (9, 1, 9), (10, 0, 9), (11, 0, 9), (3, 0, 9), (None, 1, 9), (5, None, 9)], "doc_id long, quality int, score int")
    model = quality.fit(awkward, labels)
    got = quality.add_score(awkward, model)
    assert got.count() == len(AWKWARD) and all(0 <= r.score <= 1 for r in got.collect())
    assert set(got.columns) == set(awkward.columns)
    flat = quality.fit(nothing, labels.limit(0))
    assert {r.score for r in quality.add_score(awkward, flat).collect()} == {0.5} and quality.add_score(nothing, model).count() == 0


# the pipeline


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{Scratch(spark, 'test').root}/{name}"
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            ids = collections.Counter(r[0] for r in after.select("doc_id").collect())
            rows = _texts(before)
            if name == "exact_dedup":
                assert len(ids) == len({"".join(t.split()) for _, t in rows})
            elif name == "ngram_jaccard_join":
                assert set(map(str, ids)) == {c for _, c, _, _ in _links(rows)}
            elif name == "mixing_sources":
                assert set(ids) == {k for k, _ in rows} and max(ids.values()) <= 3
        else:
            drawn = collections.Counter(k for k, _ in _texts(before))
            got = collections.Counter(r[0] for r in after.filter("piece = 0").select("doc_id").collect())
            assert got == drawn
        before = after
    assert corpus_pipeline.run(spark, sf).count() == before.count()


def test_word_hashes_forget():
    words = WordHashes(limit=2)
    first = words.of([b"a", b"b", b"c"]).tolist()
    assert words.of([b"c", b"a"]).tolist() == [first[2], first[0]]


def test_packing_of_many_small_pieces():
    for small in ({1: 5000}, {1: 700, 2: 3000}, {3: 9000, 7: 1}, {5: 400, 11: 350, 4090: 3}):
        counts = np.zeros(4097, np.int64)
        for length, n in small.items():
            counts[length] = n
        found = packing.BinCompletion(counts, 4096).solve()
        placed = collections.Counter()
        for filling, times in found:
            assert sum(length * n for length, n in filling) <= 4096
            for length, n in filling:
                placed[length] += n * times
        assert placed == small
        assert sum(t for _, t in found) <= -(-sum(a * b for a, b in small.items()) // 4096) + 1


def test_packing_searches_many_loose_pieces():
    counts = np.zeros(45, np.int64)
    counts[[8, 9, 10, 12, 21, 22]] = np.array([1, 1, 1, 3, 1, 2]) * 700
    search = packing.BinCompletion(counts, 44, nodes=200)
    best_fit = sum(n for _, n in search._best_fit(counts.copy()))
    found, placed = search.solve(), np.zeros(45, np.int64)
    for filling, times in found:
        assert sum(length * n for length, n in filling) <= 44
        for length, n in filling:
            placed[length] += n * times
    assert placed.tolist() == counts.tolist() and sum(n for _, n in found) < best_fit


def test_words_are_encoded_without_normalizing_and_splitting_again():
    path = public_tokenizers.path("word_bpe_49k.json")
    chars = [chr(i) for i in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250))]
    rng = np.random.default_rng(3)
    values = ["", " ", "İI'LL don't '' x's 'S", "".join(chars), " ".join(chars), "é" * 300 + "Z" * 300]
    values += ["".join(rng.choice(chars, 40)) for _ in range(200)]
    assert all(map(packing.PLAIN.fullmatch, values))
    library, words = Tokenizer.from_file(path), packing.WordEncoder(path)
    want = [library.encode(v, add_special_tokens=False).ids for v in values]
    words.library = None  # its model alone is asked for words
    for _ in range(2):  # new, then remembered
        assert [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(values)] == want
