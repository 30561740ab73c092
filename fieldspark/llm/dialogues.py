"""Conversation repair by weighted interval parsing.

The roles of a well-formed conversation are an optional system turn and one or more user-assistant
pairs, or nothing. In Chomsky normal form a nonterminal [p,q] derives the rows that lead from place
p to place q of that pattern: [p,q] -> [p,r][r,q], and each row derives what keeping, renaming or
deleting it leads to. Every cell of a span holds, for each nonterminal, the least (cost, audit),
closed under insertions on both sides. The audit has one letter per edit in order: Delete, Insert,
Keep, Rerole. Of two audits of one span and equal cost neither begins the other (they have a letter
per row, and more insertions cost more), so the least of a span is made of the least of its parts.

All splits of a span give the same cell, because the rules are those of composed paths. So cells
are combined bottom-up over spans that double in length, one split each, and a conversation of n
rows needs n - 1 of its spans. Short spans repeat and are remembered by their symbols. A
conversation is parsed where its rows lie after sorting; one that spans several tasks leaves one
cell per task, and those are combined next. Only its SHA-256 needs its texts in one stream; rows go
through that sorted, and none are gathered.

Null roles and texts are one space, null turns come first. Rows of one turn are ordered by role,
then by a hash of the text; equal rows are one after the other. A role without a letter of the
pattern at its start, the empty one included, can't be kept. Null conversation ids are one
conversation. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
# Places of the pattern, and what leads from one to another.
PLACES = 4                                  # start, after system, after user, after assistant
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ENDS = (0, 3)
REMEMBER = 8                                # rows of the spans that are remembered
Cell = dict[tuple[int, int], tuple[int, str]]


def put(cell: Cell, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in cell or value < cell[at]:
        cell[at] = value


def combine(left: Cell, right: Cell) -> Cell:
    """Cell of two adjacent spans."""
    out: Cell = {}
    for (p, r), (c, x) in left.items():
        for q in range(PLACES):
            got = right.get((r, q))
            if got is not None:
                put(out, (p, q), (c + got[0], x + got[1]))
    return out


def insertions() -> Cell:
    """Cell of the empty span: what inserted rows lead to."""
    one: Cell = {(p, p): (0, "") for p in range(PLACES)}
    for role in "ua":
        for at in STEPS[role]:
            put(one, at, (INSERT, "I"))
    while (more := combine(one, one)) != one:
        one = more
    return one


EMPTY = insertions()


@lru_cache(maxsize=4096)
def row_cell(symbol: str) -> Cell:
    """Cell of one row: its role's initial, then ``x`` (has to go), ``t`` (cut short) or ``-``."""
    role, fault = symbol
    cell: Cell = {}
    for p in range(PLACES):
        put(cell, (p, p), (DELETE, "D"))
    if fault != "x":
        more = CUT_SHORT if fault == "t" else 0
        for kept, cost, letter in ((role, 0, "K"), ("u", RENAME, "R"), ("a", RENAME, "R")):
            for at in STEPS.get(kept, ()):
                put(cell, at, (cost + more, letter))
    return combine(combine(EMPTY, cell), EMPTY)


@lru_cache(maxsize=1 << 16)
def span_cell(symbols: str) -> Cell:
    """Cell of a short span, two characters a row."""
    n = len(symbols) // 2
    if n == 1:
        return row_cell(symbols)
    half = 1 << (n - 1).bit_length() - 1
    return combine(span_cell(symbols[:2 * half]), span_cell(symbols[2 * half:]))


class Spans:
    """Cells of the spans met so far, each at least twice as long as the next, and what a span adds
    up to. Equal lengths are combined as soon as they are adjacent."""

    def __init__(self):
        self.cells: list[tuple[int, Cell]] = []
        self.symbols: list[str] = []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def row(self, role: str, fault: str) -> None:
        """``fault``: b(lank), d(uplicate), t(runcated) or -."""
        self.met(role, role, 0)
        self.rows += 1
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        self.symbols.append((role if role in STEPS else "?") + ("x" if fault in "bd" else fault))
        if len(self.symbols) == REMEMBER:
            self.flush()

    def flush(self) -> None:
        if self.symbols:
            self.add(len(self.symbols), span_cell("".join(self.symbols)))
            self.symbols.clear()

    def met(self, first: str, last: str, illegal: int) -> None:
        self.illegal += illegal + (self.last is not None and self.last + first not in ("su", "ua", "au"))
        self.first = first if self.first is None else self.first
        self.last = last

    def span(self, r: dict) -> None:
        self.met(r["first"], r["last"], r["illegal"])
        for name in ("rows", "blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + r[name])
        self.add(r["rows"], {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r["cell"]})

    def add(self, n: int, cell: Cell) -> None:
        self.cells.append((n, cell))
        while len(self.cells) > 1 and self.cells[-2][0] <= self.cells[-1][0]:
            (a, left), (b, right) = self.cells[-2:]
            self.cells[-2:] = [(a + b, combine(left, right))]

    def whole(self) -> Cell:
        self.flush()
        while len(self.cells) > 1:
            (a, left), (b, right) = self.cells[-2:]
            self.cells[-2:] = [(a + b, combine(left, right))]
        return self.cells[0][1] if self.cells else EMPTY


def best(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


SPAN = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                  ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                  ("cell", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
SPAN_DDL = ("conv string, part int, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
            "cell array<struct<p: int, q: int, cost: long, audit: string>>")
WHOLE = pa.schema([("conv", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                   ("cost", pa.int64()), ("audit", pa.string())])
WHOLE_DDL = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
HASH = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation that a task holds rows of; rows come sorted, (part, conv, role, fault, m),
    ``m`` equal ones in one."""
    def rows() -> Iterator[dict]:
        now, s, part = None, Spans(), 0

        def done() -> dict:
            cell = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in s.whole().items()]
            return {"conv": now, "part": part, "cell": cell, **{n: getattr(s, n) for n in SPAN.names[2:9]}}

        for b in batches:
            for part_, conv, role, fault, m in zip(*(c.to_pylist() for c in b.columns)):
                if s.rows and conv != now:
                    yield done()
                    s = Spans()
                now, part = conv, part_
                s.row(role, fault)
                for _ in range(m - 1):      # repeats of a blank row are blank, of any other duplicate
                    s.row(role, fault if fault == "b" else "d")
        if s.rows:
            yield done()
    return batches_of(rows(), SPAN)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation from its spans, which come in order."""
    def rows() -> Iterator[dict]:
        now, s = None, Spans()

        def done() -> dict:
            cost, audit = best(s.whole())
            return {"conv": now, "cost": cost, "audit": audit, **{n: getattr(s, n) for n in WHOLE.names[1:5]}}

        for b in batches:
            for r in b.to_pylist():
                if s.rows and r["conv"] != now:
                    yield done()
                    s = Spans()
                now = r["conv"]
                s.span(r)
        if s.rows:
            yield done()
    return batches_of(rows(), WHOLE, 200)


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation; (conv, audit, role, text, m) come sorted, the row with
    the audit first."""
    def rows() -> Iterator[dict]:
        now, audit, at, place, digest, some = None, "", 0, 0, None, False

        def line(role: str | None, text: str) -> None:
            """One row of the result; without a role it is the one that has to follow."""
            nonlocal place, some
            if role is None:
                role = "assistant" if place == 2 else "user"
            place = {"s": 1, "u": 2}.get(role[:1], 3)
            digest.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            some = True

        def inserted() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                line(None, "")
                at += 1

        for b in batches:
            for conv, letters, role, text, m in zip(*(c.to_pylist() for c in b.columns)):
                if letters is not None:
                    if digest:
                        inserted()
                        yield {"conv": now, "repaired_sha256": digest.hexdigest()}
                    now, audit, at, place, digest, some = conv, letters, 0, 0, hashlib.sha256(), False
                    continue
                for _ in range(m):
                    inserted()
                    if audit[at] != "D":
                        line(role if audit[at] == "K" else None, text)
                    at += 1
        if digest:
            inserted()
            yield {"conv": now, "repaired_sha256": digest.hexdigest()}
    return batches_of(rows(), HASH)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults of a test planted by a hash of conversation and
    turn: one in twenty each is dropped, emptied, stripped of its ends, repeated, given to the user."""
    space = F.lit(" ")
    at = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    new = F.when(at == 1, "").when(at == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(at == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), new.alias("text"), at.alias("_at"))
    return out.where("_at <> 0").withColumn("_copy", F.explode(F.expr("sequence(1, if(_at = 3, 2, 1))"))).drop("_at", "_copy")


def fault_of(text: Column) -> tuple[Column, Column]:
    """(blank, truncated)."""
    solid = F.regexp_replace(text, r"[\x20\x09-\x0D]+$", "")
    return solid == "", ~solid.rlike(r"[.!?]$")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation in ``rows`` (conv_id, turn, role, text)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = F.lit(" ")
    flat = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("decimal(20, 0)").alias("turn"),
                       F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    blank, truncated = fault_of(F.col("text"))
    tk = F.unhex(F.md5("text")).alias("tk")
    # Equal rows of a turn are one row with a count from here on.
    runs = materialise(flat.select("conv", "turn", "role", tk, blank.alias("blank"), truncated.alias("truncated"))
                       .groupBy("conv", "turn", "role", "tk", "blank", "truncated").agg(F.count(F.lit(1)).alias("m")))
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    firsts = runs.groupBy("conv", "role", "tk").agg(F.min(order).alias("o")).select("conv", "role", "tk", F.col("o.turn").alias("turn"), F.lit(True).alias("new"))
    told = null_safe_join(runs, firsts, ["conv", "role", "tk", "turn"], "left").withColumn(
        "fault", F.expr("if(blank, 'b', if(new is null, 'd', if(truncated, 't', '-')))"))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tk"]
    cells = (told.repartitionByRange(*keys).sortWithinPartitions(*keys)
             .select(F.spark_partition_id().alias("part"), "conv", F.substring("role", 1, 1).alias("role"), "fault", F.col("m").cast("int").alias("m"))
             .mapInArrow(spans, SPAN_DDL))
    order = [F.col("conv").asc_nulls_first(), "part"]
    parsed = materialise(cells.repartition("conv").sortWithinPartitions(*order).mapInArrow(joined, WHOLE_DDL))
    none = F.lit(None)
    heads = parsed.select("conv", F.lit(0).alias("kind"), none.cast("decimal(20, 0)").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("tk"), "audit",
                          none.cast("string").alias("text"))
    bodies = flat.select("conv", F.lit(1).alias("kind"), "turn", "role", tk, none.cast("string").alias("audit"), "text")
    keys = [F.col("conv").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "tk"]
    digests = (heads.union(bodies).repartition("conv").sortWithinPartitions(*keys)
               .select("conv", "audit", "role", "text", F.lit(1).alias("m")).mapInArrow(hashes, "conv string, repaired_sha256 string"))
    span = F.try_subtract(F.max("turn"), F.min("turn")) + 1 - F.count_distinct("turn")
    gaps = runs.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    out = null_safe_join(null_safe_join(parsed, digests, ["conv"]), gaps, ["conv"])
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_all(before: DataFrame, after: DataFrame) -> DataFrame:
    """``repair`` of ``after`` for every conversation of ``before``; one without rows is empty."""
    every = before.select("conv_id").distinct()
    out = null_safe_join(every, repair(after), ["conv_id"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
