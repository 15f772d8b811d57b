import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from llm_cases import CLASHING

from trailspark.llm import repair as r

SPACES = " \t\n\x0b\x0c\r"


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", *[f"'x' AS {name}" for name in CLASHING]) if extra else df


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, turns) by trying every edit at every place."""
    found = faults(rows)
    gaps = [()] + [tuple(x) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]

    def paths(i):
        for more in gaps:
            head = [(3, "I", (role, "")) for role in more]
            if i == len(rows):
                yield head
                continue
            _, role, text = rows[i]
            extra = 3 if found[i] == "truncated" else 0
            own = [(4, "D", None)]
            if found[i] not in ("blank", "duplicate"):
                own += [(extra, "K", (role, text))] + [(3 + extra, "R", (to, text)) for to in ("user", "assistant")]
            for edit in own:
                for rest in paths(i + 1):
                    yield [*head, edit, *rest]

    best = None
    for path in paths(0):
        turns = [x for _, _, x in path if x]
        if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in turns)):
            key = (sum(c for c, _, _ in path), "".join(a for _, a, _ in path))
            if best is None or key < best[:2]:
                best = (*key, turns)
    return best


def by_rows(rows):
    """The same by a search over lists of letters, for longer conversations."""
    found = faults(rows)
    best = {"": (0, "", [])}

    def better(into, to, value):
        if to not in into or value[:2] < into[to][:2]:
            into[to] = value

    turn = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def insert(best):
        for _ in range(2):
            for at, (cost, audit, turns) in [*best.items()]:
                better(best, turn[at][0], (cost + 3, audit + "I", [*turns, (turn[at], "")]))

    for (_, role, text), fault in zip(rows, found):
        insert(best)
        after = {}
        for at, (cost, audit, turns) in best.items():
            better(after, at, (cost + 4, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                more = cost + 3 * (fault == "truncated")
                better(after, turn[at][0], (more + 3, audit + "R", [*turns, (turn[at], text)]))
                if role[:1] and at + role[:1] in ("s", "u", "su", "ua", "au"):
                    better(after, role[0], (more, audit + "K", [*turns, (role, text)]))
        best = after
    insert(best)
    return min((best[at] for at in ("", "a") if at in best), key=lambda x: x[:2])


def expected(rows, solve):
    """rows: (turn, role, text) with nulls replaced."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    found = faults(rows)
    turns = {x[0] for x in rows if x[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, kept = solve(rows)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, kept,
    )


def compare(spark, rows, solve, extra=False):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    reports, turns = r.repaired(table(spark, rows, extra).repartition(3))
    lines = defaultdict(list)
    for x in turns.orderBy("place").collect():
        lines[x.conv_id].append((x.role, x.text))
    got = {x.conv_id: (*tuple(x)[1:], lines[x.conv_id]) for x in reports.collect()}
    assert got == {conv: expected(own, solve) for conv, own in convs.items()}
    shas = {x.conv_id: x.sha256 for x in r.digests(turns).collect()}
    assert shas == {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in t).encode()).hexdigest() for c, t in lines.items() if t}


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "No!", "cut", " \t", None, "", "Why? \n", "é \U0001f600."]


def conversations(seed, many, longest):
    rng = random.Random(seed)
    for conv in range(many):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 3])
            yield (conv if conv else None, rng.choice([turn] * 9 + [None]), rng.choice(ROLES), rng.choice(TEXTS))


def test_equal_to_every_edit(spark):
    compare(spark, list(conversations(11, 60, 3)), every_repair, extra=True)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_and_ranges_make_no_difference(spark, monkeypatch, block):
    monkeypatch.setattr(r, "BLOCK", block)
    rows = [*conversations(block, 25, 12), *[(77, i % 700, ROLES[i * 7 % 5], f"{i // 9} {TEXTS[i % 8]}") for i in range(900)]]
    compare(spark, [*rows, *[(78, 5, "user", "again.")] * 200], by_rows)


def test_searches_agree():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(i, rng.choice(ROLES) or " ", rng.choice(TEXTS) or " ") for i in range(rng.randint(0, 3))]
        assert by_rows(rows) == every_repair(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(r, "BLOCK", 8)
    rows = [(1, i, ("user", "assistant")[i % 3 % 2], f"turn {i}" + ".?"[i % 2] * (i % 5 > 0)) for i in range(3000)]
    compare(spark, rows, by_rows)


def test_query_damages_and_reports_every_conversation(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    convs = {x.conv_id: [] for x in source.collect()}
    for x in source.collect():
        way = zlib.crc32(f"{x.conv_id}:{x.turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", x.text) if way == 2 else x.text
        convs[x.conv_id] += [(x.turn, "user" if way == 4 else x.role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    want = set()
    for conv, own in convs.items():
        *numbers, kept = expected(own, by_rows)
        want.add((conv, *numbers, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()))
    assert {tuple(x) for x in r.op11_conversation_repair(spark, sf_dir).collect()} == want


def test_dropped_and_odd_conversations(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, None, None, None), (5, 1, "user", "word " * 200_000 + ".")]
    table(spark, rows, extra=True).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {x.conv_id: x for x in r.op11_conversation_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert set(found) == {gone, None, 5}
    assert tuple(found[gone])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert (found[None].blank, found[None].audit, found[None].cost, found[None].repaired_sha256) == (1, "D", 4, empty)
    reports, turns = r.repaired(table(spark, []))
    assert reports.count() == 0 and turns.count() == 0 and r.digests(turns).count() == 0
