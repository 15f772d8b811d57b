"""Conversation repair: the cheapest edits that give turns in order, found as one integer minimum.

Rows are kept (K), reroled (R), deleted (D) or empty turns inserted (I) until the roles read
``(s?(ua)+)?`` by their initials. A path of edits weighs one integer: its cost in the high digits,
below it one octal digit for each edit in order, zeros at the end. So the least integer is the
cheapest repair, and of equally cheap ones that whose letters come first (D, I, K, R), the
shorter first. A node of the search is a place between rows and the role before it. Of two paths
to one node that cost the same, neither's letters begin the other's, since more letters are more
inserts: what follows cannot turn their order, and one integer per node is enough.

A long conversation is cut into blocks of rows. A block's integers from each role to each role
make a matrix, matrices combine by the same minimum, and tasks take ranges of the sorted rows:
no task holds a whole conversation's rows. A conversation's letters are one value, as they are in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import NO_ID, stored, table

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping is free
LETTERS = " DIKR"  # the letter of each octal digit
BLOCK = 64  # rows whose paths are compared as one integer each

_D, _I, _K, _R = 1, 2, 3, 4
_OPEN, _S, _U, _A = range(4)  # nothing yet, or the role before
_TURN = (_U, _U, _A, _U)  # what an inserted or reroled row is there
_KEEP = ({"s": _S, "u": _U}, {"u": _U}, {"a": _A}, {"u": _U})
_ROLE = {_U: "user", _A: "assistant"}
_LEGAL = {"su", "ua", "au"}

Path = tuple[int, int, int]  # cost, octal digits, number of digits
Matrix = list[list[Path | None]]

FAULTS = ("", "blank", "duplicate", "truncated")


def least(paths: Iterable[Path | None]) -> Path | None:
    """The path of the least integer: cost high, digits low, zeros at the end."""
    real = [p for p in paths if p]
    if len(real) < 2:
        return real[0] if real else None
    width = max(n for _, _, n in real)
    return min(real, key=lambda p: p[0] << 3 * width | p[1] << 3 * (width - p[2]))


def joined(a: Path | None, b: Path | None) -> Path | None:
    return (a[0] + b[0], a[1] << 3 * b[2] | b[1], a[2] + b[2]) if a and b else None


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[least(joined(row[k], b[k][to]) for k in range(4)) for to in range(4)] for row in a]


def with_inserts(best: list[int | None], n: list[int], step) -> None:
    """Up to two inserts; a third would lead back to a role there already, at a higher cost."""
    for _ in range(2):
        for at, weight in enumerate([*best]):
            if weight is not None:
                step(best, n, at, _TURN[at], INSERT, _I)


def block_paths(rows: list[tuple[str, bool, bool]], start: int) -> list[Path | None]:
    """The least path from a role to each role through rows of (initial, must go, truncated)."""
    digits = 3 * len(rows) + 2
    unit = 3 * digits
    best: list[int | None] = [None] * 4
    length = [0] * 4
    best[start] = 0

    def step(into: list[int | None], into_n: list[int], at: int, to: int, cost: int, digit: int) -> None:
        weight = best[at] + (cost << unit) + (digit << 3 * (digits - 1 - length[at]))
        if into[to] is None or weight < into[to]:
            into[to], into_n[to] = weight, length[at] + 1

    for initial, must_go, truncated in rows:
        with_inserts(best, length, step)
        after: list[int | None] = [None] * 4
        after_n = [0] * 4
        more = TRUNCATED if truncated else 0
        for at in range(4):
            if best[at] is None:
                continue
            step(after, after_n, at, at, DELETE, _D)
            if not must_go:
                step(after, after_n, at, _TURN[at], REROLE + more, _R)
                if initial in _KEEP[at]:
                    step(after, after_n, at, _KEEP[at][initial], more, _K)
        best, length = after, after_n
    low = (1 << unit) - 1
    return [None if w is None else (w >> unit, (w & low) >> 3 * (digits - n), n) for w, n in zip(best, length)]


def block_matrix(rows: list[tuple[str, bool, bool]], starts: Iterable[int] = range(4)) -> Matrix:
    return [block_paths(rows, at) if at in starts else [None] * 4 for at in range(4)]


_NO_ROWS = block_matrix([])


def deletions(times: int) -> Matrix:
    """``times`` rows that must go, by repeated squaring."""
    out, power = _NO_ROWS, block_matrix([("", True, False)])
    while times:
        if times & 1:
            out = product(out, power)
        power, times = (product(power, power) if times > 1 else power), times >> 1
    return out


def closed(paths: list[Path | None]) -> Path:
    """The least path to an end: nothing at all, or an assistant's turn."""
    best = [*paths]
    for _ in range(2):
        for at, path in enumerate([*best]):
            best[_TURN[at]] = least([best[_TURN[at]], joined(path, (INSERT, _I, 1))])
    return least([best[_OPEN], best[_A]])


class Piece:
    """Consecutive rows of one conversation in one task."""

    def __init__(self, conv: int, first: bool):
        self.conv = conv
        self.starts = (_OPEN,) if first else range(4)
        self.matrix: Matrix | None = None
        self.rows: list[tuple[str, bool, bool]] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.initials = self.span = None  # of the first and last row; the first and last turn

    def add(self, turn: int | None, initial: str, fault: int, copies: int) -> None:
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += copies - 1
        before = self.initials[1] if self.initials else None
        self.illegal += (before is not None and before + initial not in _LEGAL) + copies - 1
        self.initials = (self.initials[0] if self.initials else initial, initial)
        if turn is not None:
            self.turns += self.span is None or self.span[1] != turn
            self.span = (self.span[0] if self.span else turn, turn)
        self.rows.append((initial, fault in (1, 2), fault == 3))
        if copies <= BLOCK:
            self.rows += [(initial, True, False)] * (copies - 1)
        else:
            self.flush()
            self.matrix = product(self.matrix, deletions(copies - 1))
        if len(self.rows) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.rows and self.matrix is not None:
            return
        if self.matrix is None:
            self.matrix = block_matrix(self.rows, self.starts)
        else:
            self.matrix = product(self.matrix, block_matrix(self.rows))
        self.rows = []

    def paths(self) -> list[list[str | None]]:
        self.flush()
        return [[p and f"{p[0]}:{p[1]:o}" if p and p[2] else p and f"{p[0]}:" for p in row] for row in self.matrix]


def _path(text: str | None) -> Path | None:
    if text is None:
        return None
    cost, _, digits = text.partition(":")
    return int(cost), int(digits or "0", 8), len(digits)


def letters(path: Path) -> str:
    return f"{path[1]:o}".translate({ord(str(d)): LETTERS[d] for d in (_D, _I, _K, _R)}) if path[2] else ""


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """conv, known, turn, role, text, copies, fault: each different row once, with its number of copies.

    ``known`` is false for a null turn, which comes first. A row's fault is that of its first
    copy: 1 blank, 2 duplicate (role and text stand at an earlier turn), 3 truncated, 0 none.
    """
    role, text = F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), turn.isNotNull().alias("known"), turn.alias("turn"), role, text
    ).groupBy("conv", "known", "turn", "role", "text").agg(F.count("*").alias("copies"))
    keys = ["conv", "role", "t1", "t2"]
    rows = stored(rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("2"), "text")}), "repair-rows")
    first = rows.groupBy(*keys).agg(F.min(F.struct("known", "turn")).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(bare == "", F.lit(1)).when(~F.col("first").eqNullSafe(F.struct("known", "turn")), F.lit(2))
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit(3)).otherwise(F.lit(0))
    )
    return rows.join(first, keys).select("conv", "known", "turn", "role", "text", "copies", fault.alias("fault"))


_ORDER = ["conv", "known", "turn", "role", "text"]
_PIECE = (
    "conv long, number int, paths array<array<string>>, blank long, duplicate long, truncated long, illegal long, turns long, "
    "opens string, closes string, first_turn long, last_turn long"
)


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each conversation in each range of the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        names = [x.split()[0] for x in _PIECE.split(", ")]
        types = {"conv": pa.int64(), "number": pa.int32(), "paths": pa.list_(pa.list_(pa.string())), "opens": pa.string(), "closes": pa.string()}
        schema = pa.schema([(name, types.get(name, pa.int64())) for name in names])

        def row(p: Piece) -> dict:
            opens, closes = p.initials
            first, last = p.span or (None, None)
            values = (p.conv, number, p.paths(), *p.faults[1:], p.illegal, p.turns, opens, closes, first, last)
            return dict(zip(names, values))

        piece, done = None, []
        for batch in batches:
            for conv, turn, initial, fault, copies in zip(*[batch[n].to_pylist() for n in ("conv", "turn", "initial", "fault", "copies")]):
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        done.append(row(piece))
                    piece = Piece(conv, piece is not None)  # what comes first in a range may have begun in the one before
                piece.add(turn, initial, fault, copies)
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if piece is not None:
            yield pa.RecordBatch.from_pylist([*done, row(piece)], schema=schema)

    placed = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return placed.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies").mapInArrow(run, _PIECE)


_REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _reports(pieces: DataFrame) -> DataFrame:
    """The pieces of each conversation combined in order."""
    names = [x.split()[0] for x in _REPORT.split(", ")]
    schema = pa.schema([(name, pa.string() if name == "audit" else pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(conv: int, paths: list[Path | None], sums: list[int], span: tuple | None) -> dict:
            path = closed(paths)
            gaps = span[1] - span[0] + 1 - sums[4] if span else 0
            return dict(zip(names, (conv, gaps, *sums[:4], path[0], letters(path))))

        now, paths, sums, span, closes = None, [], [], None, ""
        for batch in batches:
            done = []
            for x in batch.to_pylist():
                matrix = [[_path(p) for p in row] for row in x["paths"]]
                counts = [x[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
                here = None if x["first_turn"] is None else (x["first_turn"], x["last_turn"])
                if now != x["conv"]:
                    if now is not None:
                        done.append(report(now, paths, sums, span))
                    now, paths, sums, span = x["conv"], matrix[_OPEN], counts, here
                else:
                    paths = product([paths], matrix)[0]
                    sums = [a + b for a, b in zip(sums, counts)]
                    sums[3] += closes + x["opens"] not in _LEGAL
                    sums[4] -= span is not None and here is not None and span[1] == here[0]
                    span = (span[0], here[1]) if span and here else span or here
                closes = x["closes"]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([report(now, paths, sums, span)], schema=schema)

    return pieces.repartition("conv").sortWithinPartitions("conv", "number").mapInArrow(run, _REPORT)


def _edited(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv, place, role, text, edit: the rows with each conversation's letters carried out, in one pass."""
    names = ["conv", "place", "role", "text", "edit"]
    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, role, place = None, "", 0, _OPEN, 0
        done: list[tuple] = []

        def inserts() -> None:
            nonlocal at, role, place
            while at < len(audit) and audit[at] == "I":
                at, role = at + 1, _TURN[role]
                done.append((conv, place, _ROLE[role], "", "I"))
                place += 1

        for batch in batches:
            for key, letters_, said, text, copies in zip(*[batch[n].to_pylist() for n in ("conv", "audit", "role", "text", "copies")]):
                if letters_ is not None:
                    inserts()
                    conv, audit, at, role, place = key, letters_, 0, _OPEN, 0
                    continue
                for _ in range(copies):
                    inserts()
                    letter, at = audit[at], at + 1
                    if letter == "D":
                        continue
                    role = _KEEP[role][said[0]] if letter == "K" else _TURN[role]
                    done.append((conv, place, said if letter == "K" else _ROLE[role], text, letter))
                    place += 1
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))), schema=schema)
                done.clear()
        inserts()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))), schema=schema)

    none = {"known": F.lit(False), "turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "copies": F.lit(0).cast("long")}
    first = reports.select("conv", "audit").withColumns({"kind": F.lit(0), **none})
    both = first.unionByName(rows.select(*_ORDER, "copies").withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")}))
    placed = both.repartition("conv").sortWithinPartitions("conv", "kind", *_ORDER[1:])
    return placed.select("conv", "audit", "role", "text", "copies").mapInArrow(run, "conv long, place long, role string, text string, edit string")


def _conv_id() -> Column:
    return F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id")


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, and its repaired turns.

    The first has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit; the second
    conv_id, place (from 0), role, text and edit (K, R or I). Rows are in order of turn (nulls
    first), then role and text as bytes. A null conv_id is a conversation of its own; a null
    role or text is one space. An empty role has no initial and is never kept. Repeated rows
    are duplicates. No rows give no rows; other columns are not looked at.
    """
    rows = stored(conversation_rows(conversations), "repair-faults")
    reports = stored(_reports(_pieces(rows)), "repair-reports")
    turns = _edited(rows, reports)
    return reports.select(_conv_id(), *reports.columns[1:]), turns.select(_conv_id(), "place", "role", "text", "edit")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, joined by newlines.

    One pass over sorted rows, so that a conversation of any length takes no memory. A
    conversation without turns has no row here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv: int, digest) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv": pa.array([conv], pa.int64()), "sha": pa.array([digest.hexdigest()])})

        now = digest = None
        for batch in batches:
            for conv, role, text in zip(*[batch[n].to_pylist() for n in ("conv", "role", "text")]):
                if now != conv:
                    if now is not None:
                        yield out(now, digest)
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if now is not None:
            yield out(now, digest)

    keyed = turns.select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv"), "place", "role", "text")
    placed = keyed.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "role", "text")
    return placed.mapInArrow(run, "conv long, sha string").select(_conv_id(), F.col("sha").alias("sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planned faults, by a checksum of conversation and turn."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("way"))
    way = F.col("way")
    text = F.when(way == 1, F.lit("")).when(way == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(way == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.where(way != 0).select(
        "conv_id", "turn", F.when(way == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), times)).alias("_time"),
    ).drop("_time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    reports, turns = repaired(damaged(conversations))
    key = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv")
    ids = conversations.select(key).distinct()
    found = reports.select(key, *reports.columns[1:]).join(digests(turns).select(key, F.col("sha256").alias("repaired_sha256")), "conv", "left")
    empty = hashlib.sha256(b"").hexdigest()
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, "conv", "left").select(
        _conv_id(), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
