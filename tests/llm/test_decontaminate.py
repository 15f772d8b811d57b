import random

import numpy as np
import pytest
from llm_cases import ODD, documents

from trailspark.llm import decontaminate as c


def plain_align(item, words):
    best, table = 0, [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(1)
    for _ in range(50):
        item, words = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert c.align(np.array(item, dtype=np.uint64), np.array(words, dtype=np.uint64))[0] == plain_align(item, words)


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(6)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 5 == 0:
            copy = items[i % 6][1].split()
            if i % 10 == 0:
                for at in rng.sample(range(30), 4):
                    copy[at] = "edited"
                del copy[7]
            words[10:10] = copy
        docs.append((i, " ".join(words)))
    return docs, items


@pytest.mark.parametrize("bits", [c.FILTER_BITS, 1 << 10])
def test_equals_alignment_of_everything(spark, bits):
    docs, items = corpus()
    found = c.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), filter_bits=bits)
    expected = {}
    for doc, text in docs:
        for item, wanted in items[:6]:
            score = plain_align(wanted.split(), text.split()) / (2 * 30)
            if score >= c.LEAST_SCORE:
                expected[doc, item] = score
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == pytest.approx(expected) and len(expected) >= 12


def test_span_and_stage(spark):
    item = " ".join(f"k{i}" for i in range(20))
    rows = [*ODD, (30, f"before it {item.upper()}, after"), (31, None), (32, item.replace("k7", "other"))]
    docs, items = documents(spark, rows, extra=True), spark.createDataFrame([(1, item)], "item_id int, text string")
    found = {r.doc_id: (r.score, r.start, r.end) for r in c.contaminated(docs, items).collect()}
    assert found[30] == (1.0, 2, 22) and found[32][1:] == (0, 20) and set(found) == {30, 32}
    kept = c.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert c.drop_contaminated(docs.limit(0), items).count() == 0 and c.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_seeds_common_in_the_corpus_need_company(spark):
    item = "the cat sat on a mat and then it went home to sleep for the whole long night"
    rows = [(i, f"filler{i} the cat sat on filler") for i in range(60)] + [(100 + i, item) for i in range(40)]
    found = c.contaminated(documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(100, 140))


def test_seeds_in_many_documents_make_candidates_alone(spark):
    words = [f"k{i}" for i in range(16)]
    for at in (3, 7, 12):
        words[at] = "edited"
    item = (1, " ".join(f"k{i}" for i in range(16)))
    rows = [(i, f"page {' '.join(words)} {i}") for i in range(60)] + [(100 + i, f"{i} four words in all {i}") for i in range(60)]
    found = c.contaminated(documents(spark, rows), spark.createDataFrame([item, (2, "Four words in all")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == {(i, 1 + (i >= 100)): (1.0 if i >= 100 else 23 / 32) for i in (*range(60), *range(100, 160))}


def edited(rng, words):
    """A copy with a random share of its words exchanged, left out or followed by others."""
    share, out = rng.uniform(0.1, 0.6), []
    for word in words:
        kind = rng.choice("xxdi") if rng.random() < share else ""
        out += {"": [word], "x": ["other"], "d": [], "i": [word, "more"]}[kind]
    return out


@pytest.mark.parametrize("slab_words", [c.SLAB_WORDS, 60])
def test_no_passage_above_the_limit_is_missed(spark, slab_words):
    rng = random.Random(4)
    items = [[f"i{i}k{k}" for k in range(rng.randint(4, 40))] for i in range(8)]
    docs = []
    for item in items:
        for every in (2, 3, 4):
            docs.append([w if k % every else "other" for k, w in enumerate(item, 1)])
        docs.append([w for word in item for w in (word, "more")])
        docs.append(item[: len(item) // 2])
        docs += [["before"] * rng.randint(0, 9) + edited(rng, item) for _ in range(8)]
    docs.append(["filler"] * (c.PIECE_WORDS - 7) + items[0] + ["filler"] * 5000 + items[1])
    expected = {
        (d, i): plain_align(item, words) / (2 * len(item)) for d, words in enumerate(docs) for i, item in enumerate(items) if len(words) < 1000
    }
    expected = {k: s for k, s in expected.items() if s >= c.LEAST_SCORE} | {(len(docs) - 1, i): 1.0 for i in (0, 1)}
    texts = documents(spark, [(d, " ".join(words)) for d, words in enumerate(docs)])
    found = c.contaminated(texts, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"), slab_words=slab_words)
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == pytest.approx(expected) and len(expected) > 60
    if slab_words == c.SLAB_WORDS:
        starts = {(r.doc_id, r.item_id): (r.start, r.end) for r in found.collect()}
        assert starts[len(docs) - 1, 0] == (c.PIECE_WORDS - 7, c.PIECE_WORDS - 7 + len(items[0]))
