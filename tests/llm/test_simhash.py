import random

import numpy as np
import pytest
import xxhash
from llm_cases import ODD, documents, near_pairs, union_find

from trailspark.llm import simhash as s
from trailspark.llm.common import components


def plain(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprint_follows_its_definition():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50):
        text = "\t".join(rng.choice(["Aa", "Éx", "b", "c d"]) for _ in range(n))
        assert s.simhash(text.encode()) == plain(text)


def clustered(seed, n):
    rng, codes = random.Random(seed), {(1 << 64) - 1, *range(40)}
    while len(codes) < n:
        code = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            codes.add(code)
            for _ in range(rng.randint(0, 4)):
                code ^= 1 << rng.randrange(64)
    return {code - (1 << 64) if code >> 63 else code: i for i, code in enumerate(sorted(codes))}


@pytest.mark.parametrize("limit, distance", [(s.NODE_LIMIT, 3), (20, 3), (30, 1)])
def test_index_links_equal_brute_force(spark, limit, distance):
    codes = clustered(limit, 400)
    df = spark.createDataFrame(list(codes.items()), "code long, rep long").repartition(4)
    edges = s.index_links(s.index_nodes(df, distance, limit), distance)
    found = {r.node: r.component for r in components(edges).collect()}
    unsigned = {i: code % (1 << 64) for code, i in codes.items()}
    expected = union_find(near_pairs(unsigned, distance), unsigned)
    assert {i: found.get(i, i) for i in unsigned} == expected


def test_dense_cluster_gives_a_tree(spark):
    codes = [(i, i) for i in range(512)]  # nine low bits: most pairs are near through others
    links = s.linked(np.zeros(512, dtype=np.int64), np.array([c for c, _ in codes], dtype=np.uint64), 3)
    assert set(links) == {0}
    edges = s.index_links(s.index_nodes(spark.createDataFrame(codes, "code long, rep long"), 3, 100_000), 3)
    assert edges.count() < 4 * 512


def test_odd_documents(spark):
    found = s.near_duplicates(documents(spark, ODD, extra=True)).collect()
    codes = {}
    for doc, text in ODD:
        codes.setdefault(doc, []).append(plain(text))
    assert sorted((str(r.doc_id), r.code % (1 << 64)) for r in found) == sorted((str(d), c) for d, cs in codes.items() for c in cs)
    expected = union_find(near_pairs({d: cs[0] for d, cs in codes.items() if d}, 3), [d for d in codes if d])
    assert {r.doc_id: r.component_id for r in found if r.doc_id} == expected
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert expected[2] == expected[3] == expected[4] == 2 and expected[5] == 1


def test_one_id_with_two_texts_links_both(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "q r s t u v w"), (3, "q r s t u v w")]
    found = s.near_duplicates(documents(spark, rows)).collect()
    assert {r.component_id for r in found} == {1}


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ODD, extra=True)
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 6, 7, 8, None, 9, 10]))
    assert s.keep_one(docs.limit(0)).count() == 0 and s.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(900, 900)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 181)} == {100} and {found[i] for i in range(500, 560)} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
