"""Repair of damaged conversations: cheapest edits that give every conversation a legal order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelspark.llm import glr
from panelspark.llm.common import Scratch

_SPACES = " \t\n\x0b\x0c\r"
#: Initial -> the role that a rerole sets and an insert adds.
ROLE_OF = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
#: Conversations beyond either size are repaired in segments, with the same result.
LONG_ROWS, LONG_BYTES = 20_000, 16 << 20
REPORT = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "position long, action string, role string, text string"


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names, with the row's symbol as long as copies are not looked for."""
    own = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    end = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin(*sorted(glr.repairer().tables.terminals)), initial).otherwise(F.lit(glr.OTHER))
    fault = F.when(end == "", F.lit(glr.GONE)).when(~end.isin(".", "!", "?"), F.upper(symbol)).otherwise(symbol)
    return own.withColumn("symbol", fault)


class _Tally:
    """Counts of a run of rows in order: copies, faults, illegal pairs, turns; runs can be joined."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn", "first", "last")

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn: int | None, initial: str, times: int, blank: int, duplicate: int, truncated: int) -> None:
        one = _Tally()
        one.rows, one.blank, one.duplicate, one.truncated = times, blank, duplicate, truncated
        one.illegal = (times - 1) * (initial + initial not in LEGAL_PAIRS)
        one.first = one.last = initial
        if turn is not None:
            one.turns, one.low, one.high, one.first_turn, one.last_turn = 1, turn, turn, turn, turn
        self.join(one)

    def join(self, other: _Tally) -> None:
        if not other.rows:
            return
        if self.rows:
            self.illegal += self.last + other.first not in LEGAL_PAIRS
        else:
            self.first = other.first
        self.last = other.last
        for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.turns:
            if not self.turns:
                self.low, self.first_turn = other.low, other.first_turn
            self.turns += other.turns - (self.last_turn == other.first_turn)
            self.high, self.last_turn = other.high, other.last_turn

    def counts(self) -> list[int]:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def _edited(rows: list[tuple[str, str]], audit: str, symbols: str) -> Iterator[tuple[str, str, str]]:
    """Action, role and text of each edit in order, over the rows that they use up."""
    at = iter(rows)
    for action, symbol in zip(audit, symbols, strict=True):
        role, text = ("", "") if action == "I" else next(at)
        yield action, role if action in "KD" else ROLE_OF[symbol], text


class _Digest:
    """Hash of the repaired ``role:text`` lines, fed in order."""

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for action, role, text in edits:
            if action != "D":
                self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
                self.first = False


def _short(rows: DataFrame, messages: bool) -> DataFrame:
    """Conversations of bounded size, each whole in one task: its rows in order, repaired at once."""
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, {MESSAGES if messages else REPORT}"
    names = ["conv", *(x.split()[0] for x in (MESSAGES if messages else REPORT).split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = glr.repairer()
        remembered: dict[str, tuple[int, glr.Chunk]] = {}
        out: list[list] = [[] for _ in names]
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            seen, tally, own, symbols = set(), _Tally(), [], []
            for _, turn, role, text, symbol in group:
                blank, copy = symbol == glr.GONE, (role, text) in seen
                seen.add((role, text))
                copy = copy and not blank
                tally.add(turn, role[:1], 1, blank, copy, not copy and not blank and symbol.isupper())
                own.append((role, text))
                symbols.append(glr.GONE if copy else symbol)
            signature = "".join(symbols)
            found = remembered.get(signature)
            if found is None:
                found = tool.repair(signature)
                if len(remembered) < 20_000 and len(signature) <= 64:
                    remembered[signature] = found
            cost, (audit, targets) = found
            edits = _edited(own, audit, targets)
            if messages:
                for position, edit in enumerate(edits):
                    for column, value in zip(out, (conv, position, *edit), strict=True):
                        column.append(value)
            else:
                digest = _Digest()
                digest.add(edits)
                for column, value in zip(out, (conv, *tally.counts(), cost, audit, digest.hash.hexdigest()), strict=True):
                    column.append(value)
            if len(out[0]) >= 2_000:
                yield _batch(out, names, kind)
                out = [[] for _ in names]
        if out[0]:
            yield _batch(out, names, kind)

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    kind = _arrow(schema)
    return ordered.select("conv", "turn", "role", "text", "symbol").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(columns: list[list], names: list[str], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind.field(n).type) for c, n in zip(columns, names, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _long(rows: DataFrame, scratch: Scratch, messages: bool) -> DataFrame:
    """Conversations of any size. Equal rows are folded, copies found by an aggregate, the rest lies in ranges of
    (conversation, turn, role, text); each range is repaired from every parse stack that it may begin with, the
    ranges are composed per conversation, and the chosen edits go back to the rows."""
    tool = glr.repairer()
    key = ["conv", "role", "text"]
    folded = rows.groupBy("conv", "turn", "role", "text", "symbol").agg(F.count(F.lit(1)).alias("times"))
    folded = scratch.write(folded, "folded")
    first = folded.groupBy("conv", "role", F.sha2("text", 256).alias("hash")).agg(
        F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("no_turn")
    )
    same = F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.role") == F.col("r.role")) & (F.sha2("l.text", 256) == F.col("r.hash"))
    early = F.when(F.col("no_turn"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    marked = folded.alias("l").join(first.alias("r"), same).select("l.*", (~early).alias("copy"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    ranged = marked.repartitionByRange(*order).withColumn("segment", F.spark_partition_id()).sortWithinPartitions(*order)
    placed = scratch.write(ranged, "ranges")
    conv_kind = rows.schema["conv"].dataType.simpleString()
    stacks = tool.stacks()
    tally_ddl = ", ".join(f"{n} {'string' if n in ('first', 'last') else 'long'}" for n in _Tally.FIELDS)
    way_names = ["origin", "target", "place", "cost", "audit", "targets"]
    ways_ddl = "array<struct<origin:int,target:int,place:int,cost:long,audit:string,targets:string>>"
    schema = f"conv {conv_kind}, segment int, {tally_ddl}, ways {ways_ddl}"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = glr.repairer()
        for (conv, segment), group in groupby(_rows(batches), key=lambda r: r[:2]):
            tally, symbols = _Tally(), []
            for _, _, turn, role, symbol, times, copy in group:
                if symbol == glr.GONE:
                    tally.add(turn, role[:1], times, times, 0, 0)
                    symbols.append((glr.GONE, times))
                elif copy:
                    tally.add(turn, role[:1], times, 0, times, 0)
                    symbols.append((glr.GONE, times))
                else:
                    tally.add(turn, role[:1], times, 0, times - 1, int(symbol.isupper()))
                    symbols.append((symbol, 1))
                    if times > 1:
                        symbols.append((glr.GONE, times - 1))
            ways = [
                dict(zip(way_names, (i, stacks.index(end), place, cost, audit, targets), strict=True))
                for i, stack in enumerate(stacks) for end, place, cost, (audit, targets) in own.segment(symbols, stack)
            ]
            row = [conv, segment, *(getattr(tally, n) for n in _Tally.FIELDS), ways]
            yield _batch([[v] for v in row], kind.names, kind)

    kind = _arrow(schema)
    # The files keep the order of the ranges; a file that is read in parts gives more segments, in order too.
    source = placed.select("conv", "segment", "turn", "role", "symbol", "times", "copy", "text")
    ordered = source.repartition("conv", "segment").sortWithinPartitions("conv", "segment", F.asc_nulls_first("turn"), "role", "text").drop("text")
    parts = scratch.write(ordered.mapInArrow(segments, schema), "segments")
    pieces_schema = f"conv {conv_kind}, segment int, audit string, targets string, {REPORT.replace('audit string, ', 'whole string, ')}"

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = glr.repairer()
        for conv, group in groupby((r for b in batches for r in _one_by_one(b)), key=lambda r: r[0]):
            tally, tops = _Tally(), {own.start: (0, 0, None)}
            for _, segment, *fields, ways in group:
                part = _Tally()
                for name, value in zip(_Tally.FIELDS, fields, strict=True):
                    setattr(part, name, value)
                tally.join(part)
                by_stack: dict[glr.Stack, list] = {s: [] for s in stacks}
                for w in ways:
                    by_stack[stacks[w["origin"]]].append((stacks[w["target"]], w["place"], w["cost"], (segment, w["audit"], w["targets"])))
                tops = own.compose(tops, by_stack)
            ordered_tops = sorted(tops, key=lambda s: tops[s][1])
            cost, place, (audit, targets) = own.finish(tuple((s, tops[s][0]) for s in ordered_tops))
            link, chosen = tops[ordered_tops[place]][2], []
            while link is not None:
                link, piece = link
                chosen.append(piece)
            chosen.reverse()
            chosen[-1] = (chosen[-1][0], chosen[-1][1] + audit, chosen[-1][2] + targets)
            whole = "".join(p[1] for p in chosen)
            for i, (segment, a, t) in enumerate(chosen):
                total = (*tally.counts(), cost, whole) if i == 0 else (None,) * 8
                yield _batch([[v] for v in (conv, segment, a, t, *total, None)], pieces_kind.names, pieces_kind)

    pieces_kind = _arrow(pieces_schema)
    pieces = scratch.write(parts.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(compose, pieces_schema), "pieces")
    heads = pieces.select(
        "conv", "segment", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "targets", "audit", F.lit(0).cast("long").alias("times")
    )
    lines = placed.select("conv", "segment", F.lit(1).alias("kind"), "turn", F.col("role").alias("targets"), F.col("text").alias("audit"), "times")
    out_schema = f"conv {conv_kind}, {MESSAGES if messages else 'repaired_sha256 string'}"
    out_kind = _arrow(out_schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One conversation's edits and rows in order; only the edits of one segment are held."""
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            digest, position, out = _Digest(), 0, [[] for _ in out_kind.names]

            def put(edits: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
                nonlocal position, out
                if not messages:
                    digest.add(edits)
                    return
                for edit in edits:
                    for column, value in zip(out, (conv, position, *edit), strict=True):
                        column.append(value)
                    position += 1
                    if len(out[0]) >= 1_000:
                        yield _batch(out, out_kind.names, out_kind)
                        out = [[] for _ in out_kind.names]

            audit = targets = ""
            at = 0
            for _, _, is_row, _, role, text, times in group:
                if not is_row:
                    yield from put(_edited([], audit[at:], targets[at:]))
                    audit, targets, at = text, role, 0
                    continue
                for _ in range(times):
                    start = at
                    while audit[at] == "I":
                        at += 1
                    at += 1
                    yield from put(_edited([(role, text)], audit[start:at], targets[start:at]))
            yield from put(_edited([], audit[at:], targets[at:]))
            if not messages:
                out = [[conv], [digest.hash.hexdigest()]]
            if out[0]:
                yield _batch(out, out_kind.names, out_kind)

    stream = heads.unionByName(lines).repartition("conv")
    stream = stream.sortWithinPartitions("conv", "segment", "kind", F.asc_nulls_first("turn"), "targets", "audit")
    out = stream.mapInArrow(emit, out_schema)
    if messages:
        return out
    totals = pieces.filter("n_rows IS NOT NULL").withColumn("audit", F.col("whole")).drop("segment", "targets", "whole", "repaired_sha256")
    joined = totals.alias("l").join(out.alias("r"), F.col("l.conv").eqNullSafe(F.col("r.conv")))
    return joined.select("l.conv", *[x.split()[0] for x in REPORT.split(", ")])


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(batch.slice(i, 1).to_pylist()[0].values())


def _repair(rows: DataFrame, messages: bool, conv: str, turn: str, role: str, text: str, long_rows: int, long_bytes: int) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "dialogue")
    plain = _plain(rows, conv, turn, role, text)
    sizes = plain.groupBy("conv").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    sizes = scratch.write(sizes.filter((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("conv"), "long")
    if sizes.isEmpty():
        out = _short(plain, messages)
    else:
        same = F.col("l.conv").eqNullSafe(F.col("r.conv"))
        few = plain.alias("l").join(sizes.alias("r"), same, "left_anti")
        many = plain.alias("l").join(sizes.alias("r"), same, "left_semi")
        out = _short(few, messages).unionByName(_long(many, scratch, messages))
    return out.withColumnRenamed("conv", conv)


def repair_messages(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """One row per edit: ``conv, position, action, role, text`` with the action K, R, D or I; without the deleted ones, in
    the order of ``position``, these are the repaired conversation.

    A conversation is read by turn (null first), rows of one turn by role and text. A row's first fault counts:
    blank (no other character than white space), duplicate (role and text came before), truncated (its last other
    character is none of ``.!?``). Keep costs 0, rerole 3, delete 4 and is the one edit for blank and duplicate
    rows, an insert of an empty text 3; truncated rows that stay cost 3 more. The cheapest edits that give
    role initials ``(s?(ua)+)?`` are taken, of those the least string of edit initials.

    Null role or text is the empty one; null conversations are one conversation; extra columns are ignored;
    an empty table gives an empty result. A conversation beyond ``long_rows`` rows or ``long_bytes`` bytes is
    repaired in segments over many tasks and only passes through one task in order at the end.
    """
    return _repair(rows, True, conv, turn, role, text, long_rows, long_bytes)


def repair_report(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """One row per conversation: ``conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of the repair that ``repair_messages`` describes.

    ``gaps`` is the number of missing turns between the least and the greatest, ``illegal`` counts neighbours
    whose role initials are none of su, ua, au, ``audit`` the edits' initials in order, the hash that of the
    repaired ``role:text`` lines joined by newlines.
    """
    return _repair(rows, False, conv, turn, role, text, long_rows, long_bytes)


def damage(rows: DataFrame) -> DataFrame:
    """Damage conversations by the hash of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    takes out ``.!?``, 3 repeats it, 4 makes it the user's. Null ids, roles and texts become one space."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind: Column = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])) % 20
    text = F.when(F.col("__kind") == 1, F.lit("")).when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    marked = rows.select("conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), kind.alias("__kind"))
    times = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    changed = marked.filter("__kind <> 0").select(
        "conv_id", "turn", F.when(F.col("__kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "__kind"
    )
    return changed.withColumn("__copy", times).select("conv_id", "turn", "role", "text")


def damaged_report(rows: DataFrame, **sizes: int) -> DataFrame:
    """``repair_report`` of the damaged rows for every original conversation; one without rows has zeros,
    empty edits and the hash of the empty string."""
    report = repair_report(damage(rows), **sizes).drop("n_rows")
    known = rows.select(F.col("conv_id").alias("__conv")).distinct()
    joined = known.join(report, F.col("__conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    empty = hashlib.sha256(b"").hexdigest()
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("__conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
