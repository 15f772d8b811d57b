from collections import defaultdict

import oracle
import pytest

from trailspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    *[(1, t, "user", f"m{t}") for t in range(2)], *[(2, t, "user", f"m{t}") for t in range(5)],  # 1 prefixes 2
    *[(3, t, "user", f"m{t}") for t in range(5)], (4, 0, "user", "m0"), (4, 1, "assistant", "m1"),  # 3 equals 2
    (5, 7, None, None), (5, None, "user", "first"), (6, 0, "user", "<|im_end|>\n<|im_start|>user\nm1"), (7, 0, "user", "m0"),
    (None, 0, "user", "lost"), (None, 0, "user", "lost"), (8, 3, "b", "tie"), (8, 3, "a", "tie"),
]


def plain(rows, part_turns):
    """{(conv_id, part): text} by comparing whole turn lists."""
    turns = defaultdict(set)
    for conv, turn, role, text in rows:
        turns[conv].add((turn is not None, turn or 0, role or "unknown", text or ""))
    lists = {conv: [(t[2], t[3]) for t in sorted(ts)] for conv, ts in turns.items()}
    out = {}
    for conv, own in lists.items():
        key = (conv is not None, conv or 0)
        longer = any(other[: len(own)] == own and len(other) > len(own) for other in lists.values())
        twin = any(other == own and (c is not None, c or 0) < key for c, other in lists.items())
        if not longer and not twin:
            for k in range(0, len(own), part_turns):
                lines = [chat.START + r + "\n" + t.replace("<|im_", "<| im_") + chat.END + "\n" for r, t in own[k : k + part_turns]]
                out[conv, k // part_turns] = "".join(lines)
    return out


@pytest.mark.parametrize("part_turns", [2, chat.PART_TURNS])
def test_equals_brute_force(spark, part_turns):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS conv", "2 AS p1").repartition(3)
    found = {(r.conv_id, r.part): r.text for r in chat.formatted(df, part_turns).collect()}
    assert found == plain(ROWS, part_turns)
    assert {c for c, _ in found} == {2, 4, 5, 6, None, 8}


def test_long_conversation_over_many_blocks(spark):
    rows = [(1, t, "user", f"m{t % 3}") for t in range(3000)] + [(2, t, "user", f"m{t % 3}") for t in range(2900)]
    found = {(r.conv_id, r.part): (r.n_turns, r.text) for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: n for k, (n, _) in found.items()} == {(1, 0): 1024, (1, 1): 1024, (1, 2): 952}
    assert {k: t for k, (_, t) in found.items()} == plain(rows, 1024)


def test_no_conversations(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    columns, rows = oracle.spark_rows(chat.op5_chat_formatting(spark, sf_dir))
    assert (columns, rows) == oracle.oracle_rows(oracle.connect(sf_dir), chat.OP5_SQL)
