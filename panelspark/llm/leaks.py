"""Secret scan: fixed patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, slices, text_of, texts

#: The patterns of the base findings, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
#: Kind of the spans that the network adds; it comes after the others.
LEARNED = "learned"
_LEAST_ASSIGNED, _LEAST_ACCESS, _LEAST_HEX = 6, 20, 24

#: Candidates: runs of the characters of keys, this long at least, that hold a digit or change case within, or
#: stand behind an assignment.
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
_EDGE = "._-="
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
_BEHIND = re.compile(r"""[:=]\x20*["'`]?$""")
CONTEXT = 32

#: Findings in a shard of a fit, in the mean; contexts of which a shard makes variants, at least.
SHARD_FINDINGS, LEAST_CONTEXTS = 2048, 1500
#: A fit's rounds, after each of which the shards' weights are averaged, and passes over all findings in each.
ROUNDS, ROUND_EPOCHS = 3, 4
_UNIT = 1 << 40  # weights are added up as whole numbers of this part, so that their order plays no role
_STEPS, _MOST_ODDS = 1000, 60  # logits are counted in steps of a thousandth, between these bounds


@dataclass(frozen=True)
class Scan:
    base: list[tuple[str, int, int]]
    candidates: list[tuple[int, int]]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches per kind that are long enough, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= _LEAST_ASSIGNED]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= _LEAST_HEX]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Every run that the network judges, without the marks at its edges."""
    out = []
    for m in _RUN.finditer(text):
        value = m.group()
        start = m.start() + len(value) - len(value.lstrip(_EDGE))
        end = m.end() - (len(value) - len(value.rstrip(_EDGE)))
        if end - start >= 8 and (_MIXED.search(text, start, end) or _BEHIND.search(text, max(0, start - 8), start)):
            out.append((start, end))
    return out


# Network


#: Classes of characters: digits, hex letters and other letters by case, marks one by one, the rest by kind.
_MARKS = "+/_=.-:;,'\"`@#$%&*()[]{}<>|\\!?~^"
_CLASSES = 16 + len(_MARKS)


def _class_of(code: int) -> int:
    c = chr(code)
    if c in _MARKS:
        return 16 + _MARKS.index(c)
    if c.isdigit():
        return 1
    if c in "abcdef":
        return 2
    if c in "ABCDEF":
        return 3
    if c in "aeiouy":
        return 4
    if c in "AEIOUY":
        return 5
    if "a" <= c <= "z":
        return 6
    if "A" <= c <= "Z":
        return 7
    return 8 if c in " \t" else 9 if c in "\n\r\x0b\x0c" else 10


_LOW = np.array([_class_of(i) for i in range(128)], np.int8)
_WIDTH = 5


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes), 11, np.int8)  # beyond ASCII
    low = codes < 128
    out[low] = _LOW[codes[low]]
    return out


@dataclass
class Examples:
    """Joined characters of findings, each with padding around its parts: before, value, after."""

    classes: np.ndarray  # padded characters of all parts in a row
    letters: np.ndarray  # the characters themselves, for the second table: 27 = no letter
    starts: np.ndarray  # first character of each part, three parts a finding

    def __len__(self) -> int:
        return len(self.starts) // 3

    def joint(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of class and letter that occur, as ``32 * class + letter``, and each character's place in them."""
        pairs = self.classes.astype(np.int16) * 32 + self.letters
        there = np.flatnonzero(np.bincount(pairs, minlength=32 * _CLASSES))
        place = np.zeros(32 * _CLASSES, np.int16)
        place[there] = np.arange(len(there))
        return there, place[pairs]


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32) if text.isascii() else None
    if codes is None:
        codes = np.array([ord(c.lower()[:1]) for c in text], np.uint32)
    out = np.full(len(codes), 27, np.int8)
    out[(codes >= 97) & (codes <= 122)] = (codes[(codes >= 97) & (codes <= 122)] - 96).astype(np.int8)
    return out


def examples(findings: list[tuple[str, str, str]]) -> Examples:
    """Of ``(before, value, after)``; a part's neighbours are padding, so that parts never mix."""
    pad = "\0" * (_WIDTH // 2)
    parts, starts, at = [], [], 0
    for finding in findings:
        for part in finding:
            starts.append(at)
            parts.append(part + pad + pad)
            at += len(parts[-1])
    joined = pad + "".join(parts) + pad
    return Examples(np.where(_classes(joined) == 10, 0, _classes(joined)), _letters(joined), np.array(starts, np.int64))


class Network:
    """One convolution over characters, the greatest and the mean response in each part, one dense layer.

    A character enters by its class and, letters, by itself, so the convolution is a sum of table rows; values
    and contexts of any length are read whole.
    """

    def __init__(self, filters: int = 24, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = {
            "classes": rng.normal(0, 0.3, (_WIDTH, _CLASSES, filters)), "letters": rng.normal(0, 0.3, (_WIDTH, 28, filters)),
            "bias": np.zeros(filters), "dense": rng.normal(0, 0.1, (6 * filters + 1, hidden)), "dense_bias": np.zeros(hidden),
            "out": rng.normal(0, 0.3, hidden), "out_bias": np.zeros(1),
        }
        self.weights["classes"][:, 0] = 0
        self.weights["letters"][:, [0, 27]] = 0
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: Examples) -> dict[str, np.ndarray]:
        w, n = self.weights, len(x.classes) - _WIDTH + 1
        both, code = x.joint()
        tables = w["classes"][:, both // 32] + w["letters"][:, both % 32]  # of each pair that occurs
        h = np.repeat(w["bias"][None, :], n, 0)
        for j in range(_WIDTH):
            h += tables[j].take(code[j : j + n], 0)
        relu = np.maximum(h, 0)
        for k in range(1, _WIDTH // 2 + 1):  # these windows reach into the next part
            relu[np.append(x.starts[1:], n) - k] = 0
        most = np.maximum.reduceat(relu, x.starts, 0)
        size = np.diff(x.starts, append=n)
        mean = np.add.reduceat(relu, x.starts, 0) / size[:, None].astype(relu.dtype)
        pooled = np.concatenate([most, mean], 1).reshape(len(x), -1)
        length = (np.log1p(size[1::3, None] - _WIDTH + 1) / 4).astype(relu.dtype)
        pooled = np.concatenate([pooled, length], 1)
        dense = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
        logit = dense @ w["out"] + w["out_bias"][0]
        return {"relu": relu, "most": most, "size": size, "pooled": pooled, "dense": dense, "logit": logit}

    def _gradients(self, x: Examples, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(x)
        d_logit = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        g = {"out": f["dense"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_dense = np.outer(d_logit, w["out"]) * (f["dense"] > 0)
        g["dense"], g["dense_bias"] = f["pooled"].T @ d_dense, d_dense.sum(0)
        d_parts = (d_dense @ w["dense"].T)[:, :-1].reshape(3 * len(x), -1)
        filters = len(w["bias"])
        d_most, d_mean = d_parts[:, :filters], d_parts[:, filters:] / f["size"][:, None].astype(d_parts.dtype)
        owner = np.repeat(np.arange(3 * len(x)), f["size"])
        at_top = (f["relu"] == f["most"][owner]) & (f["relu"] > 0)
        ties = np.maximum(np.add.reduceat(at_top, x.starts, 0, dtype=d_parts.dtype), 1)
        d = (at_top * (d_most / ties)[owner] + d_mean[owner]) * (f["relu"] > 0)
        g["bias"], n = d.sum(0), len(d)
        both, code = x.joint()
        g["classes"], g["letters"] = np.zeros_like(w["classes"]), np.zeros_like(w["letters"])
        for j in range(_WIDTH):
            order = np.argsort(code[j : j + n], kind="stable")
            own, first = np.unique(code[j : j + n][order], return_index=True)
            sums = np.add.reduceat(d.take(order, 0), first, 0)
            np.add.at(g["classes"][j], both[own] // 32, sums)
            np.add.at(g["letters"][j], both[own] % 32, sums)
        g["classes"][:, 0] = 0
        g["letters"][:, [0, 27]] = 0
        return g

    def batch_gradients(self, findings: list[tuple[str, str, str]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss; worked out in parts of bounded size."""
        out: dict[str, np.ndarray] = {}
        for start, stop in _spans_of(findings):
            share = (stop - start) / len(findings)
            for k, g in self._gradients(examples(findings[start:stop]), labels[start:stop]).items():
                out[k] = out[k] + share * g if k in out else share * g
        return out

    def train(
        self, findings: list[tuple[str, str, str]], labels: np.ndarray, moments: np.ndarray | None = None, done: int = 0,
        epochs: int = ROUND_EPOCHS, of_epochs: int = ROUNDS * ROUND_EPOCHS, batch: int = 128, rate: float = 0.005, seed: int = 7,
    ) -> np.ndarray:
        """Adam on the log loss, with gradients of at most unit length and a rate that falls to zero after
        ``of_epochs``, of which ``done`` are behind. Takes and gives Adam's first moment and the root of the second, in a row."""
        rng = np.random.default_rng(seed + done)
        size = len(self.flat())
        moments = np.zeros(2 * size) if moments is None else moments
        first, second = self._named(moments[:size]), self._named(moments[size:] ** 2)
        each = -(-len(findings) // batch)
        step, steps = done * each, of_epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(findings))
            for start in range(0, len(order), batch):
                own = order[start : start + batch]
                now = rate * (1 - step / steps)
                step += 1
                gradients = self.batch_gradients([findings[i] for i in own], labels[own])
                shrink = 1 / max(1.0, np.sqrt(sum((g * g).sum() for g in gradients.values())))
                for k, g in gradients.items():
                    g = g * shrink
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return np.concatenate([*[first[k].ravel() for k in self.weights], *[np.sqrt(second[k]).ravel() for k in self.weights]])

    def flat(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def _named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        stops = np.cumsum([w.size for w in self.weights.values()])[:-1]
        return {k: part.reshape(w.shape).copy() for (k, w), part in zip(self.weights.items(), np.split(flat, stops), strict=True)}

    def set_flat(self, flat: np.ndarray) -> None:
        self.weights = self._named(flat)

    def logits(self, findings: list[tuple[str, str, str]], chars: int = 200_000) -> np.ndarray:
        out = [self._forward(examples(findings[start:stop]))["logit"] for start, stop in _spans_of(findings, chars)]
        return np.concatenate(out) if out else np.zeros(0)

    def probabilities(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(findings) + self.offset)))

    def calibrate(self, findings: list[tuple[str, str, str]], labels: np.ndarray, least_recall: float, least_precision: float = 0.999) -> None:
        """Logistic calibration on held-out findings, then the threshold: see :meth:`calibrate_counted`."""
        self.calibrate_counted(self.logits(findings), labels, np.ones(len(labels)), least_recall, least_precision)

    def calibrate_counted(self, x: np.ndarray, labels: np.ndarray, times: np.ndarray, least_recall: float, least_precision: float = 0.999) -> None:
        """Logistic calibration on the logits of held-out findings, each ``times``, then the threshold. The highest
        that keeps ``least_recall`` is an upper bound; where ``least_precision`` allows a lower one, the threshold
        lies between both (in log odds), so that either may shift a little on other texts."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            r, v = times * (p - labels), times * np.maximum(p * (1 - p), 1e-9)
            g = np.array([(r * x).sum() + 1e-3 * (a - 1), r.sum()])
            h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
            da, db = np.linalg.solve(h, g)
            a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
        self.slope, self.offset = a, b
        odds = a * x + b
        rising = np.argsort(odds, kind="stable")
        rising = rising[labels[rising] == 1]
        upto = np.cumsum(times[rising])
        highest = odds[rising][np.searchsorted(upto, np.floor((1 - least_recall) * upto[-1]), side="right")] if len(upto) else 0.0
        order = np.argsort(-odds, kind="stable")
        exact = np.cumsum((times * labels)[order]) / np.cumsum(times[order]) >= least_precision
        lowest = odds[order][np.flatnonzero(exact)[-1]] if exact.any() else highest
        self.threshold = float(1 / (1 + np.exp(-min(highest, (highest + lowest) / 2))))


def _spans_of(findings: list[tuple[str, str, str]], chars: int = 200_000) -> Iterator[tuple[int, int]]:
    """Starts and stops of parts with about so many characters (a longer finding is a part of its own)."""
    start = 0
    while start < len(findings):
        stop, size = start, 0
        while stop < len(findings) and (stop == start or size < chars):
            size += sum(map(len, findings[stop]))
            stop += 1
        yield start, stop
        start = stop


# Labelled findings


_KEY_NAMES = ("password", "secret", "token", "api_key", "auth", "pwd", "credential", "access_key", "private_key", "client_secret", "bearer", "passphrase")
_PLAIN_NAMES = ("name", "version", "file", "path", "date", "title", "author", "size", "color", "page", "phone", "mail", "id", "link")
_ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)


def variants(findings: list[tuple[str, str, str]], words: list[str], seed: int = 11) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Labelled findings in the contexts of ``findings``: random values of the common alphabets and lengths, with
    and without names before them, as positives; words, joined words, addresses, numbers, dates, versions and
    paths, with and without names before them, as negatives."""
    rng = np.random.default_rng(seed)

    def some(of):
        return of[int(rng.integers(len(of)))]

    def case(name: str) -> str:
        return some((name, name.upper(), name.capitalize(), name.replace("_", "-"), name.replace("_", "")))

    out, labels = [], []
    for before, _, after in findings:
        if rng.random() < 0.4:  # other surroundings: none, or words in another order
            before, after = (" ".join(some(words) for _ in range(int(rng.integers(0, 6)))) + some(("", " ", "\n", " (")) for _ in range(2))
        head = before[: int(rng.integers(0, len(before) + 1))]
        quote = some(("", '"', "'", '"'))
        tail = quote + some((" ", "", ";", ",", "\n")) + after[int(rng.integers(0, len(after) + 1)) :]
        sign = some((" = ", ": ", "=", ":", " := ", " "))
        value = "".join(some(_ALPHABETS[k]) for k in [int(rng.integers(len(_ALPHABETS)))] for _ in range(int(rng.choice([16, 20, 24, 32, 36, 40, 48, 64]))))
        named = rng.random() < 0.6 or len(value) < 24
        value = some(("", "", "", "sk_live_", "ghp_", "xoxb-", "eyJ")) + value
        out.append(((head + " " + (case(some(_KEY_NAMES)) + sign + quote if named else quote))[-CONTEXT:], value, tail[:CONTEXT]))
        labels.append(1)
        for _ in range(2):
            a, b, c = some(words), some(words), some(words)
            number = str(int(rng.integers(10, 10**9)))
            plain = some((
                a + b, a + "-" + b + "-" + c, a + "_" + b, a + b.capitalize() + c.capitalize(), a + "." + b, f"{a}.{number[:2]}", number + number,
                f"{number[:3]}-{number[:3]}-{number}", f"20{number[:2]}-0{number[0]}-1{number[-1]}", f"{a}/{b}/{c}.html", f"www.{a}.com", f"mail{number[0]}.{a}.com",
                f"{number[:1]}.{number[:2]}.{number[:1]}-{a}", a.upper() + b.upper(), f"{a}{number[:4]}", f"{a}.{b}{number[:2]}", f"{number}.{number[:3]}",
            ))
            name = case(some(_PLAIN_NAMES if rng.random() < 0.7 else _KEY_NAMES)) + sign + quote if rng.random() < 0.5 else some((" ", "@", "(", "//", quote))
            out.append(((head + " " + name)[-CONTEXT:], plain, tail[:CONTEXT]))
            labels.append(0)
    return out, np.array(labels, float)


def _shard(rows: pd.DataFrame, least_contexts: int, seed: int) -> tuple[list[tuple[str, str, str]], np.ndarray, np.ndarray]:
    """A shard's findings and their variants, the labels, and which third is held out."""
    own = rows[rows["known"].notna()].sort_values(["known", "order", "before", "value", "after"], ascending=[False, True, True, True, True])
    findings = list(zip(own["before"], own["value"], own["after"], strict=True))
    labels = own["known"].to_numpy(dtype=float)
    words = sorted({w.lower() for b, _, a in findings for w in re.findall(r"[A-Za-z]{4,}", b + " " + a)}) or ["word", "text", "line", "page"]
    contexts = findings or [("", "", "")]
    more, more_labels = variants((contexts * -(-least_contexts // len(contexts)))[: max(least_contexts, len(contexts))], words, 11 + int(rows["shard"].iloc[0]))
    findings, labels = findings + more, np.concatenate([labels, more_labels])
    return findings, labels, np.random.default_rng(seed).random(len(findings)) < 1 / 3


def fit(found: DataFrame, least_recall: float = 0.98, shard_findings: int = SHARD_FINDINGS, least_contexts: int = LEAST_CONTEXTS, seed: int = 7) -> Network:
    """Train on every different finding among the candidates of ``scan`` (those within a base finding are
    positives), and on ``variants`` of each; a third is held out to calibrate the probability and to set the
    threshold that keeps ``least_recall`` of the held-out positives.

    Findings are dealt by hash to shards of about ``shard_findings``. In each round every shard goes on from the
    same weights over all its findings, in a task of its own, and the weights and moments are averaged by the
    findings behind them. Held-out logits are counted in steps of a thousandth. The driver sees sums only.
    """
    spark = found.sparkSession
    scratch = Scratch(spark, "findings")
    drawn = (
        found.select(F.explode("candidates").alias("c"))
        .groupBy("c.known", "c.before", "c.value", "c.after").agg(F.count(F.lit(1)).alias("n")).drop("n")
        .withColumn("order", F.xxhash64(F.lit(seed), "before", "value", "after"))
    )
    drawn = scratch.write(drawn, "findings")
    shards = max(1, -(-drawn.count() // shard_findings))
    drawn = drawn.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.lit(shards).cast("long")))
    dealt = spark.range(shards).withColumnRenamed("id", "shard").join(drawn, "shard", "left")  # a shard without findings has a row
    dealt = dealt.repartition(shards, "shard")
    net = Network(seed=seed)
    state = np.concatenate([net.flat(), np.zeros(2 * len(net.flat()))])
    size = len(net.flat())

    def trained(state: np.ndarray, done: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            findings, labels, held = _shard(rows, least_contexts, seed)
            own = Network(seed=seed)
            start = state.astype(np.float32)  # half the memory to move
            own.set_flat(start[:size])
            moments = own.train([f for f, h in zip(findings, held, strict=True) if not h], labels[~held].astype(np.float32), start[size:], done, seed=seed)
            whole = np.rint(np.concatenate([own.flat(), moments]).astype(float) * _UNIT).astype(np.int64)
            return pd.DataFrame({"n": [int((~held).sum())], "whole": [whole]})

        return run

    for i in range(ROUNDS):
        parts = dealt.groupBy("shard").applyInPandas(trained(state, i * ROUND_EPOCHS), "n long, whole array<long>")
        sums = parts.select("n", F.posexplode("whole").alias("at", "w")).groupBy("at").agg(
            F.sum(F.col("w").cast("decimal(38, 0)") * F.col("n")).cast("decimal(38, 0)").alias("total"), F.sum("n").alias("n"))
        rows = sums.collect()  # one row per weight and moment
        state = np.zeros(len(state))
        for r in rows:
            state[r["at"]] = float(r["total"] / r["n"]) / _UNIT
    net.set_flat(state[:size])

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        findings, labels, held = _shard(rows, least_contexts, seed)
        x = np.clip(net.logits([f for f, h in zip(findings, held, strict=True) if h]), -_MOST_ODDS, _MOST_ODDS)
        return pd.DataFrame({"step": np.floor(x * _STEPS).astype(np.int64), "label": labels[held]}).groupby(["step", "label"]).size().reset_index(name="n")

    logits = dealt.groupBy("shard").applyInPandas(counted, "step long, label double, n long")
    logits = logits.groupBy("step", "label").agg(F.sum("n").alias("n")).orderBy("step", F.desc("label")).collect()  # bounded by the steps
    step, label, n = (np.array([r[i] for r in logits], float) for i in range(3))
    net.calibrate_counted(step / _STEPS, label, n, least_recall)
    return net


# Scan and judgement


_SPAN = "struct<kind:string,start:int,stop:int>"
_CANDIDATE = "struct<start:int,stop:int,before:string,value:string,after:string,known:boolean>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, base`` (spans by start, then kind) and ``candidates`` with their surroundings;
    ``known`` candidates overlap a base span. Whole texts; offsets are code points."""
    candidate = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("before", pa.string()), ("value", pa.string()), ("after", pa.string()), ("known", pa.bool_())])
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 4 << 20):
                base, candidates = [], []
                for t in texts(part.column("__text")):
                    spans = base_spans(t)
                    base.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
                    own, i = [], 0
                    covered = _merged(spans)
                    for a, b in candidate_spans(t):
                        while i < len(covered) and covered[i][1] <= a:
                            i += 1
                        known = i < len(covered) and covered[i][0] < b
                        own.append({"start": a, "stop": b, "before": t[max(0, a - CONTEXT) : a], "value": t[a:b], "after": t[b : b + CONTEXT], "known": known})
                    candidates.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, pa.list_(span)), pa.array(candidates, pa.list_(candidate))], ["key", "base", "candidates"]
                )

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), text_of(text).alias("__text"))
    return plain.mapInArrow(run, f"key {kind}, base array<{_SPAN}>, candidates array<{_CANDIDATE}>")


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for _, a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def judge(found: DataFrame, net: Network) -> DataFrame:
    """``key, base, learned``: to the scanned documents the candidates outside of base spans that the network
    takes for secrets, as spans of the kind ``learned`` with their probability."""
    learned = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("candidates").to_pylist()
            own = [(i, c) for i, row in enumerate(rows) for c in row if not c["known"]]
            out: list[list] = [[] for _ in rows]
            for (i, c), p in zip(own, net.probabilities([(c["before"], c["value"], c["after"]) for _, c in own]).tolist(), strict=True):
                if p >= net.threshold:
                    out[i].append({"start": c["start"], "stop": c["stop"], "probability": p})
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("base"), pa.array(out, pa.list_(learned))], ["key", "base", "learned"])

    kind = found.schema["key"].dataType.simpleString()
    schema = f"key {kind}, base array<{_SPAN}>, learned array<struct<start:int,stop:int,probability:double>>"
    return found.select("key", "base", "candidates").mapInArrow(run, schema)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", net: Network | None = None, least_recall: float = 0.98) -> DataFrame:
    """One row per document: ``key, base`` and ``learned`` spans. The patterns' findings stay as they are; the
    network adds the candidates that it takes for secrets. Without ``net`` one is fitted on the findings of ``docs``.

    Null text is empty; documents without findings have empty lists; repeated rows and null keys stay; other columns
    are ignored. Whole texts are read, candidates of any length are judged whole. Offsets are code points.
    """
    found = Scratch(docs.sparkSession, "leaks").write(scan(docs, key, text), "found")
    return judge(found, net or fit(found, least_recall)).withColumnRenamed("key", key)


def report(secrets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as ``kind:start:stop`` joined by commas."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")

    added = F.transform("learned", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(LEARNED).alias("kind"), s.stop.alias("stop")))
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    known = F.transform("base", lambda s: F.struct(s.start.alias("start"), place[s.kind].alias("rank"), s.kind.alias("kind"), s.stop.alias("stop")))

    def count(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return secrets.select(
        key, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat(known, added))).alias("spans")
    )
