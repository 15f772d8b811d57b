import itertools
import math
import random

import numpy as np
from llm_cases import ODD, documents

from trailspark.llm import licenses as l

APACHE = l.TEMPLATES["Apache-2.0"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_wide_band_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        matched, start, end = l.banded(np.array(a), np.array(b), 0, 30)
        assert matched == lcs(a, b) == lcs(a, b[start:end])


def test_winnowing_finds_shared_runs():
    rng = np.random.default_rng(5)
    for _ in range(50):
        shared = rng.integers(0, 1 << 60, l.WINDOW, dtype=np.uint64)
        sides = [np.r_[rng.integers(0, 1 << 60, n, dtype=np.uint64), shared, rng.integers(0, 1 << 60, 3, dtype=np.uint64)] for n in (2, 9)]
        assert set(sides[0][l.winnowed(sides[0])]) & set(sides[1][l.winnowed(sides[1])])


def test_documents(spark):
    words = APACHE.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 12 != 5)
    rows = [
        *ODD, (20, "before it. Released under the MIT License. after it"), (21, edited), (22, " ".join(words[: len(words) // 2])),
        (23, "licensed UNDER cc by-nc 4.0\nand\nLicensed under CC BY-NC 4.0."), (24, "the License of the Version under the Apache"),
    ]
    found = sorted(tuple(r) for r in l.scan_licenses(documents(spark, rows, extra=True)).collect())
    assert [f[:2] for f in found] == [
        (20, "MIT-notice"), (21, "Apache-2.0"), (21, "Apache-2.0-notice"), (22, "Apache-2.0-notice"), (23, "CC-BY-NC-4.0-notice"), (23, "CC-BY-NC-4.0-notice"),
    ]
    assert found[0][2:] == (1.0, 5, 2, 7)
    assert l.scan_licenses(documents(spark, rows).limit(0)).count() == 0


def test_own_templates(spark):
    docs = documents(spark, [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta x gamma delta"), (4, "beta x gamma"), *ODD])
    found = {r.doc_id: r.coverage for r in l.scan_licenses(docs, {"t": "alpha beta gamma delta epsilon", "short": "omega", "none": "..."}, least=0.5).collect()}
    assert found[1] == 1.0 and set(found) == {1, 2}
    assert l.scan_licenses(docs, {}).count() == 0


def test_query_finds_every_notice(spark, sf_dir):
    found = l.op7_license_scans(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    notices = {n: t.rstrip(".") for n, t in l.TEMPLATES.items() if n.endswith("notice")}
    expected = {(d, n) for d, text in texts.items() for n, notice in notices.items() if notice in text}
    assert {(r.doc_id, r.license) for r in found} == expected


def full_scan(text, templates, least):
    """The template with the longest common subsequence that is most like the text, among those covered enough."""
    words, best = l._WORD.findall(text.lower()), None
    for name, template in templates.items():
        own = l._WORD.findall(template.lower())
        matched = lcs(own, words)
        if matched >= least * len(own):
            best = max(best or (0, ""), (2 * matched / (len(own) + len(words)), name))
    return best and best[1]


def changed(rng, words, kind):
    if kind == "random":
        return [f"other{i}" if rng.random() < 0.2 else w for i, w in enumerate(words)]
    return [f"other{i}" if i % kind == kind // 2 else w for i, w in enumerate(words)]


def test_each_license_is_itself_and_edited_copies_are_found(spark):
    rng = random.Random(7)
    rows, kinds = [], [1000, "random", "random", "random", 5, 6, 9]
    for name, template in l.TEMPLATES.items():
        for kind in kinds:
            rows.append((len(rows), " ".join(changed(rng, template.split(), kind)), "en", name))
    texts = {doc: text for doc, text, *_ in rows}
    found = {}
    for r in l.scan_licenses(documents(spark, rows, extra=True)).collect():
        found.setdefault(r.doc_id, []).append(r)
    for doc, *_, name in rows[:: len(kinds)]:  # unchanged
        assert max(found[doc], key=lambda r: r.matched_words).license == name
    expected = {doc: full_scan(text, l.TEMPLATES, l.LEAST_COVERAGE) for doc, text in texts.items()}
    wanted = [doc for doc, name in expected.items() if name]
    hit = sum(expected[doc] in {r.license for r in found.get(doc, [])} for doc in wanted)
    assert len(wanted) > 3 * len(l.TEMPLATES) and hit / len(wanted) >= 0.98
    assert not [doc for doc in found if not expected[doc]]


def test_licenses_with_common_clauses_exclude_each_other(spark):
    two, three = l.TEMPLATES["BSD-2-Clause"], l.TEMPLATES["BSD-3-Clause"]
    rows = [(1, two), (2, three), (3, f"{three}\n\n{two}"), (4, l.TEMPLATES["AGPL-3.0"]), (5, l.TEMPLATES["GPL-2.0"] + " And more. " + l.TEMPLATES["MIT"])]
    rows += [(6, two), (6, two), (7, "Released under that MIT License.")]
    found = sorted((r.doc_id, r.license) for r in l.scan_licenses(documents(spark, rows)).collect())
    assert found == [
        (1, "BSD-2-Clause"), (2, "BSD-3-Clause"), (3, "BSD-2-Clause"), (3, "BSD-3-Clause"), (4, "AGPL-3.0"), (5, "GPL-2.0"), (5, "MIT"),
        (6, "BSD-2-Clause"), (6, "BSD-2-Clause"), (7, "MIT-notice"),
    ]


def test_runs_left_whole():
    for length in range(1, 16):
        for least in (0.5, 0.8, 1.0):
            lost = length - math.ceil(length * least - 1e-9)
            worst = min(max(len(run) for run in "".join("x" if i in gone else "w" for i in range(length)).split("x"))
                        for gone in itertools.combinations(range(length), min(lost, length - 1)))
            assert l.whole_run(length, least) <= worst
