import hashlib
import random
import re

from llm_cases import ODD, documents
from pyspark.sql import functions as F

from trailspark.llm import merkle as m

NATIVE = ("Python", "Pandas", "Arrow", "ExistingRDD")
ROWS = [*ODD, (20, "One two three. Four five six seven eight nine!\n\nNext part. More"), (21, "One two three. Four five six seven eight nine!\n\nNext part. More"),
        (22, "é" * 7), (20, "another text of the same id")]


def leaf_texts(line):
    if len(line) <= 24:
        return [line[i : i + 2] for i in range(len(line) - 1)] if len(line) > 1 else [x for x in [line] if x]
    return re.findall(r"(?:\S*[^\s.!?][ \t\x0B\f\r]+){0,3}\S+", line, re.ASCII)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(text):
    """root, [(section, [(paragraph, [leaves])])]"""
    sections = []
    for part in text.split("\n\n"):
        lines = part.split("\n")
        sections.append((sha(",".join(sha(x) for x in lines)), [(sha(x), leaf_texts(x)) for x in lines]))
    return sha(",".join(h for h, _ in sections)), sections


def matched(xs, ys):
    """The children of both lists left without an equal partner (by their first part)."""
    left, right = [*xs], []
    for y in ys:
        hit = next((i for i, x in enumerate(left) if x[0] == y[0]), None)
        if hit is None:
            right.append(y)
        else:
            del left[hit]
    return left, right


def nodes(t):
    return 1 + len(t[1]) + sum(len(ps) for _, ps in t[1]) + sum(len(leaves) for _, ps in t[1] for _, leaves in ps)


def brute_likeness(text_a, text_b):
    a, b = tree(text_a), tree(text_b)
    if a[0] == b[0]:
        return 1.0, 0
    x, y = matched(a[1], b[1])
    unlike = 2 + len(x) + len(y)
    x, y = matched([p for _, ps in x for p in ps], [p for _, ps in y for p in ps])
    edited, unlike = len(y), unlike + len(x) + len(y)
    x, y = matched([(w,) for _, leaves in x for w in leaves], [(w,) for _, leaves in y for w in leaves])
    return 1 - (unlike + len(x) + len(y)) / (nodes(a) + nodes(b)), edited


def brute_first(text_a, text_b):
    a, b = tree(text_a)[1], tree(text_b)[1]
    if a == b:
        return None
    s = next(i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1])
    p, q = ([h for h, _ in t[s][1]] if s < len(t) else [] for t in (a, b))
    at = next(i for i in range(max(len(p), len(q))) if p[i : i + 1] != q[i : i + 1])
    return f"{s}.{at}"


def likeness_of(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", m.fingerprint(F.col("a")).alias("x"), m.fingerprint(F.col("b")).alias("y"))
    df = m.with_first_edit(m.with_unlike(df, "x", "y", "t"), "x", "y", "first")
    return df.select("a", "b", m.likeness("x", "y", "t_unlike").alias("near"), "t_edited", "first").collect()


def test_likeness_descends_from_unequal_roots(spark):
    rng = random.Random(9)
    lines = ["a line of some words here. And", "another one that is quite long, really! yes it is", "", "x", "short line", "the last of all lines to be used. the end"]
    def text(n):
        return "".join(rng.choice(lines) + rng.choice(["\n", "\n", "\n\n"]) for _ in range(n))
    texts = [text(rng.randint(0, 14)) for _ in range(40)]
    edited = [t.replace("quite", "very", 1) for t in texts]
    pairs = [*zip(texts, edited), *zip(texts, texts[1:]), *zip(texts, texts), ("", "a"), ("ab", "abc"), ("", ""), ("\n", "\n\n"), ("a" * 65, "a" * 64)]
    seen = set()
    for row in likeness_of(spark, pairs):
        near, paragraphs = brute_likeness(row.a, row.b)
        assert abs(row.near - near) < 1e-12 and row.t_edited == paragraphs and row["first"] == brute_first(row.a, row.b)
        assert (row.near == 1.0) == (row.a == row.b)
        seen.add(round(near, 1))
    assert len(seen) > 5


def test_moves_and_counts_are_unlike(spark):
    p, q, r = "one two three four. five six seven eight", "nine ten eleven twelve thirteen. fourteen", "other words of another section entirely here"
    pairs = [
        (f"{p}\n{q}\n\n{r}", f"{q}\n{p}\n\n{r}"), (f"{p}\n\n{r}\n\n{q}", f"{r}\n\n{p}\n\n{q}"), (f"{p}\n" * 1000, f"{p}\n" * 500),
        (f"{p} {q}", f"{q} {p}"),
    ]
    swapped, moved, repeats, words = [row.near for row in likeness_of(spark, pairs)]
    assert 0.7 < swapped < 1 and 0.8 < moved < 1 and repeats < 0.7 and 0.2 < words < 1


def test_edited_texts_and_likeness(spark):
    found = m.edited_fingerprints(documents(spark, ROWS, extra=True)).collect()
    whole = sorted({(doc is not None, doc or 0, text or "") for doc, text in ROWS})
    assert len(found) == len(whole)
    same_id = [t for _, d, t in whole if d == 20]
    texts = [w for w in whole if w[1] != 20]
    by_id = {}
    for row in found:
        by_id.setdefault(row.doc_id, []).append(row)
    for i, (known, doc, text) in enumerate(texts):
        (row,) = by_id[doc if known else None]
        following = [w[2] for w in (texts[i + 1] if i + 1 < len(texts) else texts[0],)]
        if texts[(i + 1) % len(texts)][1] == 21:
            following = same_id
        half = len(text) // 2
        options = {text[: len(text) - half] + f[:half]: f for f in following}
        shas = {hashlib.sha256(e.encode()).hexdigest(): (e, f) for e, f in options.items()}
        assert row.n_chars == len(text) and row.edited_sha256 in shas
        edited, _ = shas[row.edited_sha256]
        assert row.fingerprint[:32] == tree(text)[0][:32] and row.edited_fingerprint[:32] == tree(edited)[0][:32]
        near, paragraphs = brute_likeness(text, edited)
        assert abs(row.near_edited - near) < 1e-12 and row.edited_paragraphs == paragraphs and row.first_edit == brute_first(text, edited)
        assert any(abs(row.near_next - brute_likeness(text, f)[0]) < 1e-12 for f in following)
    assert len({r.fingerprint for r in by_id[20]} | {r.fingerprint for r in by_id[21]}) == 2


def test_single_and_no_documents(spark):
    (row,) = m.edited_fingerprints(documents(spark, [(1, "a b c d")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"a b a b"[:0] + b"a b " + b"a b").hexdigest() and row.near_next == 1.0
    assert m.edited_fingerprints(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_documents_are_nearest_to_their_own_edit(spark):
    rows = m.op9_document_fingerprints(spark, "/root/testdata/sf0.01").where("n_chars > 1").collect()
    far = [r for r in rows if r.near_edited <= r.near_next < 1]
    assert len(rows) > 900 and len(far) <= len(rows) // 200


def test_edits_are_located(spark):
    before = documents(spark, [(1, "a\nb\n\nc\nd"), (2, "same\ntext"), (3, None)])
    after = documents(spark, [(1, "a\nB\n\nc\nd\ne"), (2, "same\ntext"), (3, ""), (4, "new")])
    assert sorted(tuple(r) for r in m.edits(before, after).collect()) == [(1, 0, 1), (1, 1, 2), (4, 0, 0)]


def test_plan_is_native(spark, sf_dir):
    plan = m.op9_document_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in NATIVE if w in plan]
