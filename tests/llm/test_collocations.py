import random
import re
from collections import Counter, defaultdict

import oracle
import pytest
from llm_cases import ODD, documents

import __spark_entry__ as entry

from trailspark.llm import collocations as c

LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, longest, least, share, top):
    """Rows (lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, count in counts.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    inside[p[i : i + s]] = max(inside[p[i : i + s]], a)
        scored = []
        for p, a in candidates.items():
            score, k = min((1000 * a * totals[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside or 100 * inside[p] < share * a:
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def corpus(seed=12, many=120):
    rng = random.Random(seed)
    stock = ["New York city", "rock and roll band", "ha ha", "a b c d e f g", "Łódź \x1c é"]
    out = []
    for doc in range(many):
        words = []
        for _ in range(rng.randint(0, 25)):
            words += rng.choice(stock).split(" ") if rng.random() < 0.5 else [rng.choice("xyzuvw") * rng.randint(1, 2)]
            words[-1] += rng.choice(["", "", "", "", ",", ".\n", " \t", "!?"])
        out.append((doc, " ".join(words), rng.choice(["en", "en", "de", None, ""])))
    return [*out, *[(d, t, "en") for d, t in ODD], (900, "ha " * 300, "fr"), (901, "Ha ha\x0bha\x0cha\rha", "fr")]


def found(df):
    return {tuple(x) for x in df.collect()}


@pytest.mark.parametrize("share, top", [(100, 2000), (60, 7)])
def test_equal_to_counting_every_phrase(spark, share, top):
    rows = corpus()
    docs = documents(spark, [(d, t, lang, "s") for d, t, lang in rows], extra=True)
    want = brute(rows, 5, 4, share, top)
    assert len(want) > 20
    assert found(c.collocations(docs, least=4, share=share, top=top)) == want


def test_small_segments_chunks_and_counters(spark, monkeypatch):
    monkeypatch.setattr(c, "BUCKETS", 1 << 16)
    rows = [*corpus(3, 40), (950, "one two three four five six. " * 400 + "x" * 5000 + " seven eight " * 90, "en")]
    want = brute(rows, 3, 5, 100, 2000)
    cut = c.runs
    monkeypatch.setattr(c, "runs", lambda text, keep: cut(text, keep, 40))
    chunk = c.chunks
    monkeypatch.setattr(c, "chunks", lambda batches, keep: chunk(batches, keep, 50))
    docs = documents(spark, [(d, t, lang, "s") for d, t, lang in rows])
    assert found(c.collocations(docs, longest=3, least=5)) == want


def test_runs_repeat_the_last_words():
    text = ("a bb\tccc, d " * 50).encode()
    whole = [w for words, _ in c.runs(text, 2) for w in words]
    parts, start = [], 0
    for words, last in c.runs(text, 2, 30):
        parts += words if last else words[:-2]
    assert parts == whole and whole[:4] == [b"a", b"bb", b"ccc", b"."]


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**15, 10**15, 3 * 10**8, 10**8)], "a long, n long, l long, r long")
    expression = "(1000 * cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))"
    assert big.selectExpr(f"{expression} AS score").first().score == 1000 * 10**30 // (3 * 10**16)


def test_no_rows_and_rare_words(spark):
    assert c.collocations(documents(spark, ODD).limit(0)).count() == 0
    assert c.collocations(documents(spark, [(1, "a b c"), (2, None)])).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    columns, rows = oracle.spark_rows(entry.queries()["op12_phrase_collocations"](spark, sf_dir))
    assert rows and (columns, rows) == oracle.oracle_rows(oracle.connect(sf_dir), entry.oracle_sql()["op12_phrase_collocations"])
