"""Cases the tests of the operators share."""

import itertools

CLASHING = ("component_id", "_key", "rank", "pos", "code", "bin_id", "n", "template", "keep", "key", "doc", "value")


def documents(spark, rows, extra=False):
    """(doc_id, text[, lang, source]) as the table of documents, with clashing columns if wanted."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s1"))) for r in rows]
    full = [(*r, None if r[1] is None else len(r[1])) for r in full]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.selectExpr("*", *[f"'x' AS {name}" for name in CLASHING])
    return df.repartition(3)


#: Null and empty texts, ties, repeated rows, a null id, odd white space, no words, a long text.
ODD = [
    (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, "a b c d e f"), (5, "a b c d e f"), (6, "x"), (7, "x y"),
    (8, "éÉ \U0001f600 z"), (None, "no id here at all"), (9, "tick " * 30_000), (10, "one\n\n\ntwo\n"),
]


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_pairs(codes, distance):
    """Pairs of ids whose codes differ in at most ``distance`` bits."""
    return [(a, b) for (a, x), (b, y) in itertools.combinations(codes.items(), 2) if (x ^ y).bit_count() <= distance]


def deduped_lines(rows, min_words):
    """{(doc_id, text): text left}, by comparing every line with every earlier one."""
    docs = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [text.split("\n") for _, text in docs]
    out = {}
    for i, own in enumerate(lines):
        gone = [False] * len(own)
        for j in range(len(own)):
            best = 0
            for a in range(i + 1):
                for b in range(j if a == i else len(lines[a])):
                    n = 0
                    while j + n < len(own) and b + n < len(lines[a]) and lines[a][b + n] == own[j + n]:
                        n += 1
                    best = max(best, n)
            if best and sum(len(x.split()) for x in own[j : j + best]) >= min_words:
                gone[j : j + best] = [True] * best
        out[docs[i]] = "\n".join(x for x, y in zip(own, gone) if not y)
    return out
