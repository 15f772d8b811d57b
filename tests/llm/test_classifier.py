import math

import numpy as np
import pytest
from llm_cases import ODD, documents
from pyspark.sql import functions as F

from trailspark.llm import classifier as q
from trailspark.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 0
    found = q.classify(docs, labels.where(~held)).select("doc_id", "keep")
    judged = found.join(q.label_kinds(labels.where(held)), "doc_id").groupBy("kind").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.kind: r.kept for r in judged}
    assert kept["good"] > 0.98 and kept["low"] < 0.05 and kept["toxic"] < 0.05


def small(spark, host="s1"):
    good = [(i, f"plain words number {'abc'[i % 3]} in a calm text of some length", "en", host) for i in range(40)]
    bad = [(100 + i, f"JUNK!! | trash{'x' * (i % 3)} | idiot !!", "en", "s2") for i in range(40)]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 0, i % 4 == 0) for i in range(0, 40, 2)]
    return good + bad, spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int")


def brute(rows):
    """[(host_rate, path_rate, p_good)] of (logit, host, path, kind), by summing over all other rows."""
    labelled = [kind for *_, kind in rows if kind]
    rate = 0.5
    for _ in range(500):
        at = math.log(rate / (1 - rate))
        rate = (labelled.count("good") + sum(1 / (1 + math.exp(-(x + at))) for x, *_, kind in rows if not kind) + 1) / (len(rows) + 2)
    at = math.log(rate / (1 - rate))
    good = [1 / (1 + math.exp(-(x + at))) if not kind else float(kind == "good") for x, *_, kind in rows]

    def strength(sites, mean):
        n = sum(len(own) for own in sites.values())
        spread = sum(len(own) * (sum(own) / len(own) - mean(site)) ** 2 for site, own in sites.items()) / n
        between = max(spread - sum(mean(s) * (1 - mean(s)) for s in sites) / n, 1e-4)
        return sum(len(own) * mean(s) * (1 - mean(s)) for s, own in sites.items()) / n / between

    def grouped(key):
        out = {}
        for row, g in zip(rows, good):
            out.setdefault(key(row), []).append(g)
        return out

    hosts, paths = grouped(lambda r: r[1]), grouped(lambda r: r[1:3])
    s = strength(hosts, lambda _: rate)
    t = strength(paths, lambda p: (sum(hosts[p[0]]) + s * rate) / (len(hosts[p[0]]) + s))
    out = []
    for (x, host, path, _), g in zip(rows, good):
        h = (sum(hosts[host]) - g + s * rate) / (len(hosts[host]) - 1 + s)
        p = (sum(paths[host, path]) - g + t * h) / (len(paths[host, path]) - 1 + t)
        odds = math.exp(x) * p / (1 - p)
        out.append((h, p, odds / (1 + odds)))
    return out


def test_rates_leave_the_document_out(spark):
    rows, labels = small(spark)
    rows += [(200, "plain words number a in a calm text of some length", "de", "s2"), (201, "", "fr", "s3"), (202, None, None, None)]
    rows += [(210 + i, f"JUNK!! | trash {'calm text words' * (i % 2)}", "de", f"s{i % 5}") for i in range(20)] + [(0, rows[0][1], "en", "s1")] * 3
    docs = documents(spark, rows)
    found = sorted(q.classify(docs, labels).join(docs.select("doc_id", "source", "lang").distinct(), "doc_id").collect(), key=lambda r: r.doc_id)
    kinds = {r.doc_id: r.kind for r in q.label_kinds(labels).collect()}
    want = brute([(math.log(r.evidence / (1 - r.evidence)), r.source or "", r.lang or "", kinds.get(r.doc_id)) for r in found])
    assert len(found) == len(rows)
    for r, (host, path, p) in zip(found, want):
        assert r.host_rate == pytest.approx(host, abs=1e-3) and r.path_rate == pytest.approx(path, abs=1e-3) and r.p_good == pytest.approx(p, abs=1e-3)
        assert r.keep == (r.p_good >= 0.5)
    # Alone on its site, a document is judged at the rate of all others.
    alone = next(r for r in found if r.doc_id == 201)
    assert alone.evidence == 0.5 and alone.p_good == pytest.approx(alone.path_rate, abs=1e-6)


@pytest.mark.parametrize("share", [0.9, 0.5, 0.1])
def test_overall_rate_finds_the_share_of_good_documents(share):
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < share
    logit = np.round(np.where(good, rng.normal(2, 2, 20_000), rng.normal(-2, 2, 20_000)), 2)  # log-odds of these two at even odds
    values, n = np.unique(logit, return_counts=True)
    assert abs(q.overall_rate(list(zip(values, n)), 0, 0) - share) < 0.02
    assert q.overall_rate([], 0, 0) == 0.5 and q.overall_rate([], 3, 4) == pytest.approx(4 / 6)


def test_stage_keeps_columns_and_whole_rows(spark):
    rows, labels = small(spark)
    docs = documents(spark, rows + [(300 + (i or 0), t) for i, t in ODD] + [(None, "plain words of a calm text")], extra=True)
    judged = {r.doc_id: r.keep for r in q.classify(docs, labels).collect()}
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id BETWEEN 100 AND 139").count() == 0
    assert kept.where("doc_id < 40").count() == 40 and kept.where("doc_id = 305").count() == 2 * judged[305]
    assert q.keep_good(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 1), (1, None, None), (None, 1, 0)]])
def test_one_sided_labels_keep_everything(spark, labels):
    docs = documents(spark, ODD)
    kept = q.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.count() == docs.count()


def test_worst_of_repeated_labels_counts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.kind) for r in q.label_kinds(labels).collect()} == {(1, "low"), (2, "good"), (4, "toxic")}


def test_features_of_odd_texts():
    for text in (None, "", " ", "!!!", "\U0001f600" * 5, "a" * 100_000):
        assert all(math.isfinite(x) for x in q.features(text, [{"a": 3.0}, {}]))
