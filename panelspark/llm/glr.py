"""Repair of symbol sequences by generalised LR parsing with weighted edits."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

#: A rule is a name and what it stands for; the first rule's name is the whole sequence.
Rules = tuple[tuple[str, tuple[str, ...]], ...]
#: Conversations: ``(s?(ua)+)?`` over the initials of system, user and assistant.
ROLES: Rules = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("u", "a")), ("T", ("T", "u", "a")))
END = "$"
Stack = tuple[int, ...]


class Tables:
    """LR(0) item sets with the lookahead of each rule; a conflict simply gives several moves."""

    def __init__(self, rules: Rules):
        self.rules = (("", (rules[0][0],)), *rules)
        names = {left for left, _ in self.rules}
        self.names, self.terminals = names, {x for _, right in rules for x in right} - names
        empty: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in names} | {t: {t} for t in self.terminals}
        follow: dict[str, set[str]] = {n: set() for n in names}
        follow[""].add(END)
        while True:
            before = len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))
            for left, right in self.rules:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first[x]
                    if x not in empty:
                        break
                rest = set(follow[left])
                for x in reversed(right):
                    if x in names:
                        follow[x] |= rest
                    rest = first[x] | (rest if x in empty else set())
            if before == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                break
        self.follow = follow
        self.states = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for n, items in enumerate(self.states):  # grows while it is walked
            for symbol in sorted({self.rules[r][1][at] for r, at in items if at < len(self.rules[r][1])}):
                kernel = {(r, at + 1) for r, at in items if self.rules[r][1][at : at + 1] == (symbol,)}
                target = self._closure(kernel)
                if target not in self.states:
                    self.states.append(target)
                self.goto[n, symbol] = self.states.index(target)

    def _closure(self, items: Iterable[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        out, todo = set(items), list(items)
        while todo:
            r, at = todo.pop()
            for symbol in self.rules[r][1][at : at + 1]:
                for other, (left, _) in enumerate(self.rules):
                    if left == symbol and (other, 0) not in out:
                        out.add((other, 0))
                        todo.append((other, 0))
        return frozenset(out)

    def _reduced(self, stack: Stack, ahead: str) -> set[Stack]:
        """The stack and all that it reduces to before the symbol ``ahead``."""
        out, todo = {stack}, [stack]
        while todo:
            top = todo.pop()
            for r, at in self.states[top[-1]]:
                left, right = self.rules[r]
                if left and at == len(right) and ahead in self.follow[left]:
                    below = top[: len(top) - len(right)]
                    new = (*below, self.goto[below[-1], left])
                    if new not in out:
                        out.add(new)
                        todo.append(new)
        return out

    def _settled(self, stack: Stack) -> Stack:
        """Reductions that need no lookahead, so that stacks with one future are equal."""
        while len(self.states[stack[-1]]) == 1:
            ((r, at),) = self.states[stack[-1]]
            left, right = self.rules[r]
            if not left or at < len(right):
                break
            below = stack[: len(stack) - len(right)]
            if (below[-1], left) not in self.goto:
                break
            stack = (*below, self.goto[below[-1], left])
        return stack

    @lru_cache(maxsize=4096)  # noqa: B019  tables live as long as the process
    def shift(self, stack: Stack, symbol: str) -> tuple[Stack, ...]:
        reduced = self._reduced(stack, symbol)
        return tuple(sorted({self._settled((*s, self.goto[s[-1], symbol])) for s in reduced if (s[-1], symbol) in self.goto}))

    @lru_cache(maxsize=4096)  # noqa: B019
    def accepts(self, stack: Stack) -> bool:
        return any((0, 1) in self.states[s[-1]] for s in self._reduced(stack, END))


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  # added when a truncated row is not deleted
    targets: str = "au"  # what a row may be reroled to, and what may be inserted


#: A chunk of edits: their initials, and the symbol that each shifts ("-" for a delete).
Chunk = tuple[str, str]
Config = tuple[tuple[Stack, int], ...]
#: Symbol of a row that must be deleted, and of a row whose role is no symbol of the grammar.
GONE, OTHER = "d", "o"


class Repairer:
    """Cheapest edits, ties by the least string of initials.

    The graph-structured stack keeps, after each row, one top per different parse stack: tops with
    equal stacks are merged by the least (cost, edits). Two equally dear ways to one stack never are
    prefixes of each other, as each further edit costs something or uses up a row, so the merge by
    prefix is exact. A level is described by its stacks in the order of their edits and by their costs
    above the cheapest; equal levels move alike, so moves are remembered.

    Rows are symbols: a terminal, upper-case if the row is truncated; ``o``/``O`` for a role that only
    rerole or delete can treat; ``d`` for a row that must go.
    """

    def __init__(self, rules: Rules = ROLES, costs: Costs = Costs()):
        self.tables, self.costs = Tables(rules), costs
        self.start: Stack = (0,)
        self._behind: dict[tuple[Stack, Stack], int] = {}
        self._level: dict[Config, int] = {}
        self._configs: list[Config] = []
        self._moves: dict[tuple[int, str], tuple[int, int, tuple[tuple[int, Chunk], ...]]] = {}

    def _number(self, config: Config) -> int:
        n = self._level.setdefault(config, len(self._configs))
        if n == len(self._configs):
            self._configs.append(config)
        return n

    def _inserted(self, config: Config) -> dict[Stack, tuple[int, int, Chunk]]:
        """Stacks within reach by inserts alone: cost, place of the origin, edits."""
        reach: dict[Stack, tuple[int, int, Chunk]] = {s: (c, i, ("", "")) for i, (s, c) in enumerate(config)}
        todo = list(reach)
        while todo:
            stack = todo.pop()
            cost, origin, (initials, symbols) = reach[stack]
            if cost - config[origin][1] > self.costs.insert * 64:
                raise ValueError("the grammar needs more than 64 inserts at one place")
            for symbol in self.costs.targets:
                for new in self.tables.shift(stack, symbol):
                    way = (cost + self.costs.insert, origin, (initials + "I", symbols + symbol))
                    if len(new) <= 64 and (new not in reach or way < reach[new]):
                        reach[new] = way
                        todo.append(new)
        return reach

    def _step(self, config: Config, row: str) -> dict[Stack, tuple[int, int, Chunk]]:
        best: dict[Stack, tuple[int, int, Chunk]] = {}

        def offer(stack: Stack, way: tuple[int, int, Chunk]) -> None:
            if stack not in best or way < best[stack]:
                best[stack] = way

        costs = self.costs
        if row == GONE:  # an insert is as good after it, and then its edits come first
            for i, (stack, cost) in enumerate(config):
                offer(stack, (cost + costs.delete, i, ("D", "-")))
        else:
            extra, own = (costs.truncated if row.isupper() else 0), row.lower()
            for stack, (cost, i, (initials, symbols)) in self._inserted(config).items():
                offer(stack, (cost + costs.delete, i, (initials + "D", symbols + "-")))
                for new in self.tables.shift(stack, own) if own in self.tables.terminals else ():
                    offer(new, (cost + extra, i, (initials + "K", symbols + own)))
                for symbol in costs.targets:
                    for new in self.tables.shift(stack, symbol):
                        offer(new, (cost + costs.rerole + extra, i, (initials + "R", symbols + symbol)))
        return best

    def _move(self, level: int, row: str) -> tuple[int, int, tuple[tuple[int, Chunk], ...]]:
        best = self._step(self._configs[level], row)
        late = {x for x in best for y in best if best[y][0] + self._behind.get((x, y), best[x][0]) < best[x][0]}
        order = sorted(set(best) - late, key=lambda s: best[s][1:])
        base = min((w[0] for w in best.values()), default=0)
        out = self._number(tuple((s, best[s][0] - base) for s in order)), base, tuple(best[s][1:] for s in order)
        self._moves[level, row] = out
        return out

    def measure(self) -> None:
        """For any two stacks, how much dearer the second can come than the first whatever follows; a top that
        is dearer than another by more can never win, and is dropped. Needs few different stacks."""
        stacks, rows = self.stacks(), [*self.tables.terminals, *map(str.upper, self.tables.terminals), OTHER, OTHER.upper(), GONE]
        moves = {(s, r): {e: w[0] for e, w in self._step(((s, 0),), r).items()} for s in stacks for r in rows}
        last = {s: self.finish(((s, 0),)) for s in stacks}
        behind = {(x, y): last[y][0] - last[x][0] for x in stacks for y in stacks if last[x] and last[y]}
        if len(behind) < len(stacks) ** 2:
            return
        for _ in range(64):
            new = {
                (x, y): max(worst, *(min(d - c + behind[e, f] for f, d in moves[y, r].items()) for r in rows for e, c in moves[x, r].items()))
                for (x, y), worst in behind.items()
            }
            if new == behind:
                self._behind = behind
                return
            behind = new

    def finish(self, config: Config) -> tuple[int, int, Chunk] | None:
        """Least (cost above the cheapest, place, last inserts) of a level that is a whole sequence."""
        ways = [w for s, w in self._inserted(config).items() if self.tables.accepts(s)]
        return min(ways, default=None)

    def levels(self, rows: Iterable[tuple[str, int]], start: Stack) -> tuple[Config, int, list]:
        """Run over ``(symbol, times)``; ``times`` > 1 only for rows that must go."""
        if len(self._configs) > 20_000:  # only a grammar without bound on its stacks comes here
            self._level.clear(), self._configs.clear(), self._moves.clear()
        level, total, links, known = self._number(((start, 0),)), 0, [], self._moves
        for row, times in rows:
            move = known.get((level, row))
            level, base, back = move if move is not None else self._move(level, row)
            total += base
            if times > 1:
                total += self.costs.delete * (times - 1)
                back = tuple((i, (a + "D" * (times - 1), b + "-" * (times - 1))) for i, (a, b) in back)
            links.append(back)
        return self._configs[level], total, links

    @staticmethod
    def trace(links: list, place: int, last: Chunk = ("", "")) -> Chunk:
        parts = [last]
        for back in reversed(links):
            place, chunk = back[place]
            parts.append(chunk)
        parts.reverse()
        return "".join(p[0] for p in parts), "".join(p[1] for p in parts)

    def repair(self, rows: str) -> tuple[int, Chunk]:
        """Cost and edits for one sequence of symbols."""
        config, total, links = self.levels(((r, 1) for r in rows), self.start)
        cost, place, last = self.finish(config)
        return total + cost, self.trace(links, place, last)

    def stacks(self) -> list[Stack]:
        """Every parse stack that a sequence can lead to (left-recursive rules have few)."""
        found, todo = {self.start}, [self.start]
        while todo:
            stack = todo.pop()
            for symbol in self.tables.terminals:
                for new in self.tables.shift(stack, symbol):
                    if new not in found:
                        if len(found) >= 256:
                            raise ValueError("too many different parse stacks to cut a sequence into segments")
                        found.add(new)
                        todo.append(new)
        return sorted(found)

    def segment(self, rows: list[tuple[str, int]], start: Stack) -> list[tuple[Stack, int, int, Chunk]]:
        """From one stack at the segment's start: stack at its end, its place in the order of edits, cost, edits."""
        config, total, links = self.levels(rows, start)
        return [(s, i, total + c, self.trace(links, i)) for i, (s, c) in enumerate(config)]

    def compose(self, tops: dict[Stack, tuple[int, int, object]], ways: dict[Stack, list[tuple[Stack, int, int, object]]]):
        """Tops after one more segment; a top is its cost, its place in the order of edits, its link."""
        best: dict[Stack, tuple[tuple[int, int, int], object]] = {}
        for stack, (cost, place, link) in tops.items():
            for end, own, extra, chunk in ways[stack]:
                key = (cost + extra, place, own)
                if end not in best or key < best[end][0]:
                    best[end] = (key, (link, chunk))
        order = sorted(best, key=lambda s: best[s][0][1:])
        return {s: (best[s][0][0], i, best[s][1]) for i, s in enumerate(order)}


@lru_cache(maxsize=8)
def repairer(rules: Rules = ROLES, costs: Costs = Costs()) -> Repairer:
    out = Repairer(rules, costs)
    out.measure()
    return out
