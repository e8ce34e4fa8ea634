"""Conversation repair against brute force: every edit script, every conversation, both ways through Spark."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from panelspark.llm import dialogue, glr
from panelspark.llm.common import table
from panelspark.llm.queries import QUERIES

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _all_scripts(rows):
    """Least (cost, edits) by trying every script with at most two inserts at a place."""
    best = [(10**9, "")]

    def go(i, state, cost, audit, inserts):
        if cost > best[0][0]:
            return
        if i == len(rows) and state in ("", "a"):
            best[0] = min(best[0], (cost, audit))
        for t in "ua":
            if inserts < 2 and (state, t) in NEXT:
                go(i, NEXT[state, t], cost + 3, audit + "I", inserts + 1)
        if i == len(rows):
            return
        go(i + 1, state, cost + 4, audit + "D", 0)
        if rows[i] != "d":
            more = 3 * rows[i].isupper()
            if (state, rows[i].lower()) in NEXT:
                go(i + 1, NEXT[state, rows[i].lower()], cost + more, audit + "K", 0)
            for t in "ua":
                if (state, t) in NEXT:
                    go(i + 1, NEXT[state, t], cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def _by_row(rows):
    """Least (cost, edits, roles) row by row over the states of the role order; strings are compared whole."""
    def inserted(tops):
        for _ in range(2):
            for state, (c, a, r) in list(tops.items()):
                for t in "ua":
                    if (state, t) in NEXT:
                        n = NEXT[state, t]
                        tops[n] = min(tops.get(n, (10**9, "", "")), (c + 3, a + "I", r + t))
        return tops

    tops = {"": (0, "", "")}
    for row in rows:
        new = {}
        for state, (c, a, r) in inserted(tops).items():
            more = 3 * row.isupper()
            ways = [(state, c + 4, "D", "-")]
            if row != "d":
                ways += [(NEXT[state, t], c + more, "K", t) for t in row.lower() if (state, t) in NEXT]
                ways += [(NEXT[state, t], c + 3 + more, "R", t) for t in "ua" if (state, t) in NEXT]
            for n, cost, e, t in ways:
                new[n] = min(new.get(n, (10**9, "", "")), (cost, a + e, r + t))
        tops = new
    return min(w for s, w in inserted(tops).items() if s in ("", "a"))


def _brute(rows):
    """The contract's columns for (conv_id, turn, role, text) rows."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * ((0, 1, 1, 2, 1)[kind] if kind < 5 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        symbols, seen, counts = [], set(), collections.Counter()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols.append("d" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = {r[0] for r in own} - {None}
        cost, audit, roles = _by_row(symbols)
        lines, at = [], iter(own)
        for e, t in zip(audit, roles, strict=True):
            role, text = ("", "") if e == "I" else next(at)[1:]
            if e != "D":
                lines.append(f"{role if e == 'K' else dialogue.ROLE_OF[t]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def _got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_repair_is_the_least_script():
    tool, rng = glr.repairer(), random.Random(1)
    for size in range(5):
        for rows in itertools.product("suaoSUAd", repeat=size):
            if size < 4 or rng.random() < 0.15:
                cost, (audit, _) = tool.repair("".join(rows))
                assert (cost, audit) == _all_scripts(rows) == _by_row(rows)[:2]


def test_dropped_tops_change_nothing():
    plain, rng = glr.Repairer(), random.Random(2)
    for _ in range(60):
        rows = "".join(rng.choice("suaoSUAOd") for _ in range(rng.randint(20, 60)))
        assert glr.repairer().repair(rows) == plain.repair(rows)


def test_segments_compose():
    tool, rng = glr.repairer(), random.Random(3)
    for _ in range(100):
        rows = "".join(rng.choice("suaoUAd") for _ in range(rng.randint(1, 40)))
        cuts = [0, *sorted(rng.sample(range(len(rows) + 1), min(3, len(rows)))), len(rows)]
        tops = {tool.start: (0, 0, None)}
        for a, b in itertools.pairwise(cuts):
            tops = tool.compose(tops, {s: tool.segment([(x, 1) for x in rows[a:b]], s) for s in tool.stacks()})
        order = sorted(tops, key=lambda s: tops[s][1])
        cost, place, last = tool.finish(tuple((s, tops[s][0]) for s in order))
        link, parts = tops[order[place]][2], [last[0]]
        while link is not None:
            link, chunk = link
            parts.append(chunk[0])
        assert (cost, "".join(reversed(parts))) == (tool.repair(rows)[0], tool.repair(rows)[1][0])


def test_other_grammars():
    """A bracket grammar has stacks without bound; it is repaired too, but not cut into segments."""
    tool = glr.Repairer((("S", ()), ("S", ("S", "a", "S", "b"))), glr.Costs(targets="ab"))
    assert tool.repair("aabb") == (0, ("KKKK", "aabb"))
    assert tool.repair("aab")[0] == 3 and tool.repair("ba")[0] == 6
    with pytest.raises(ValueError):
        tool.stacks()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query(spark, scale):
    path = f"/root/testdata/{scale}"
    rows = [tuple(r) for r in table(spark, path, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert _got(QUERIES["op11_conversation_repair"](spark, path)) == _brute(rows)


def _awkward():
    rng = random.Random(4)
    texts = ["Yes.", "No?", "Then", "", " \t", None, "Yes.", "x" * 200_000 + ".", "ñ\x1c", "Why.\n"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"]
    rows = [(rng.choice([1, 2, 3, 4, None, -7, 9]), rng.choice([0, 1, 2, 3, 5, 9, None]), rng.choice(roles), rng.choice(texts)) for _ in range(220)]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"Text {t // 3}.") for t in range(300)]
    rows += [(51, 1, "user", "Same.")] * 150 + [(52, None, "assistant", None)] * 40
    rows += [(60 + i, i, "user", "Alone.") for i in range(60)]
    return [(*r, "x", 0, "y") for r in rows]


SCHEMA = "conv_id long, turn long, role string, text string, symbol string, times int, segment string"


@pytest.mark.parametrize("sizes", [{}, {"long_rows": 3}, {"long_bytes": 100_000}])
def test_awkward(spark, sizes):
    rows = _awkward()
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(dialogue.damaged_report(df, **sizes)) == _brute([r[:4] for r in rows])


@pytest.mark.parametrize("sizes", [{}, {"long_rows": 3}])
def test_messages(spark, sizes):
    df = dialogue.damage(spark.createDataFrame(_awkward(), SCHEMA))
    report = {r.conv_id: r for r in dialogue.repair_report(df).collect()}
    lines = collections.defaultdict(list)
    for r in sorted(dialogue.repair_messages(df, **sizes).collect(), key=lambda r: r.position):
        lines[r.conv_id].append(r)
    assert set(lines) == set(report)
    for conv, own in lines.items():
        assert [r.position for r in own] == list(range(len(own)))
        assert "".join(r.action for r in own) == report[conv].audit
        text = "\n".join(f"{r.role}:{r.text}" for r in own if r.action != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == report[conv].repaired_sha256


@pytest.mark.parametrize("sizes", [{}, {"long_rows": 0}])
def test_nothing(spark, sizes):
    df = spark.createDataFrame([], SCHEMA)
    assert _got(dialogue.damaged_report(df, **sizes)) == [] and dialogue.repair_messages(df, **sizes).count() == 0


def test_string_keys(spark):
    df = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "assistant", "Ho."), (None, 1, "user", "Hi.")], "who string, at int, by string, said string")
    got = {r.who: (r.cost, r.audit) for r in dialogue.repair_report(df, "who", "at", "by", "said").collect()}
    assert got == {"c": (0, "KK"), None: (3, "KI")}
