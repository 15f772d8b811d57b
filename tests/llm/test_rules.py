import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import oracle
from llm_cases import ODD, documents
from pyspark.sql import functions as F

import __spark_entry__ as entry

from trailspark.llm import rules as r

NATIVE = ("Python", "Pandas", "Arrow", "ExistingRDD")
SPACE = re.compile("[\x20\x09-\x0d]+")


def signals(text):
    words = [w for w in SPACE.split(text or "") if w]
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def levels(found):
    n, chars, symbols, dup, repeated, failed = found
    return None if failed else {
        rule: min(level, 1000) for rule, level in {
            "symbols": 1000 * symbols // chars, "dup_lines": 1000 * dup // n, "repeats": 1000 * repeated // n,
            "long_words": 10 * chars // n, "short_words": 1000 * n // chars,
        }.items()
    }


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def cutoffs(rows, kinds, risk, error, purity):
    """By trying every level of the grid from the top."""
    strata = {row[2] or "" for row in rows}
    out = {}
    for stratum in strata:
        halves = defaultdict(list)
        for doc, text, lang in rows:
            level = levels(signals(text))
            if (lang or "") == stratum and level and kinds.get(doc) in ("good", "low"):
                halves[hashlib.sha256(str(doc).encode()).hexdigest()[0] < "8"].append((kinds[doc], level))
        for rule in r.RULES:
            best = None
            for cutoff in range(1000, -1, -1):
                n = sum(kind == "good" for kind, _ in halves[False])
                k = sum(kind == "good" and level[rule] >= cutoff for kind, level in halves[False])
                if not halves or tail(n, k, risk / 5) > error / (5 * len(strata)):
                    break
                hit = Counter(kind for kind, level in halves[True] if level[rule] >= cutoff)
                if hit["low"] and hit["low"] >= purity * hit.total():
                    best = cutoff
            if best is not None:
                out[stratum, rule] = best
    return out


MESSY = [
    (30, "\t lead and trail \x0b\x0c words  \r\n with odd space   "), (31, "one two three four five " * 3), (32, "a a a a a a a a a a a a"),
    (33, "x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 y2 y3 y4 x1 x2 x3 x4 x5 z"), (34, "same\nsame\n same\n\n\nsame"), (35, "#*$%&|<> \U0001f600 \x1c \xa0 é"),
    (36, " ".join(str(i) for i in range(40)) + " 7 8 9 10 11 12"),
]


def test_signals(spark):
    rows = [*ODD, *MESSY]
    found = r.with_signals(documents(spark, rows, extra=True)).collect()
    got = Counter((x.doc_id, x.text, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in found)
    assert got == Counter((doc, text, *signals(text)) for doc, text in rows)


def test_tail_is_the_binomial_sum(spark):
    cases = [(0, 0), (1, 0), (1, 1), (50, 3), (700, 0), (2000, 40), (20_000, 30)]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", r.log_tail(F.col("n"), F.col("k"), 0.01).alias("tail")).collect()
    for row in rows:
        assert math.isclose(row.tail, math.log(tail(row.n, row.k, 0.01)), rel_tol=1e-9, abs_tol=1e-12)


def corpus():
    rng = random.Random(13)
    rows, kinds = [], {}
    for doc in range(900):
        low = rng.random() < 0.3
        size = rng.randint(8, 30)
        words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 9) + (6 if low and doc % 3 == 0 else 0))) for _ in range(size)]
        if low and doc % 3 == 1 or rng.random() < 0.01:
            words = [w + "#$" for w in words]
        rows.append((doc, " ".join(words), rng.choice(["en", "en", "de", None])))
        if rng.random() < 0.9:
            kinds[doc] = "low" if low else "toxic" if rng.random() < 0.05 else "good"
    return rows, kinds


def test_cutoffs_equal_brute_force_and_keep_good_documents(spark):
    rows, kinds = corpus()
    docs = documents(spark, [(doc, text, lang, "s") for doc, text, lang in rows], extra=True)
    labels = spark.createDataFrame([(d, int(k != "low"), int(k == "toxic")) for d, k in kinds.items()], "doc_id long, quality int, toxic int")
    limits = cutoffs(rows, kinds, 0.25, 0.2, 0.5)
    assert len({rule for _, rule in limits}) >= 2
    found = {x.doc_id: x for x in r.judge(docs, labels, risk=0.25, error=0.2, purity=0.5).collect()}
    for doc, text, lang in rows:
        level = levels(signals(text))
        expected = [rule for rule in r.RULES if level and level[rule] >= limits.get((lang or "", rule), 1001)]
        assert found[doc].rules == expected
        assert found[doc].kept == (level is not None and not expected)


def test_odd_labels_and_no_rows(spark):
    docs = documents(spark, [*ODD, (40, "a text of at least ten words is kept without any labels")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (40, None, None), (40, 1, None), (99, 0, 1)], none.schema)
    for labels in (none, odd):
        kept = {x.doc_id: x.kept for x in r.judge(docs, labels).collect()}
        assert kept.pop(40) and not any(kept.values()) and len(kept) == len({d for d, _ in ODD})
    assert r.judge(docs, none).count() == len(ODD) + 1
    assert r.judge(docs.limit(0), odd).count() == 0


def test_query_equals_sql(spark, sf_dir):
    duck = oracle.connect(sf_dir)
    assert oracle.spark_rows(entry.queries()["op13_quality_rules"](spark, sf_dir)) == oracle.oracle_rows(duck, entry.oracle_sql()["op13_quality_rules"])


def test_plan_is_native(spark, sf_dir):
    for df in (r.op13_quality_rules(spark, sf_dir), r.with_signals(spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in NATIVE if w in plan]
