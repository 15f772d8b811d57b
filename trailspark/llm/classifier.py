"""Quality classifier: document evidence combined with the posteriors of its site.

Evidence is a logistic model on the shape of a text and on marker words of rejected documents.
A site (host) and its parts (paths) have posterior rates of good documents: each rate is shrunk
towards the wider level by as much as the spread between siblings says (method of moments), so
that a sparse site falls back to its parent. A document's odds are its evidence, learned at even
odds, times its path's odds without the document itself. What unlabelled documents add to their
sites is their probability at the corpus's own rate of good documents, which is estimated first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import keyed, same_document, stored, table

TRAIN_ROWS = 2_000  # labelled documents of each class (good, low quality, toxic) the model is fitted on
PREFIX = 5  # words are also looked at by their first letters
LEAST_GOOD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_LEAST_WEIGHT = 2.0  # a marker is at least e^2 times as frequent in rejected documents


def words_of(text: str) -> tuple[int, set[str]]:
    """The number of words, and the distinct words with the prefixes of longer ones."""
    words = _WORD.findall(text.lower())
    found = set(words)
    found.update([w[:PREFIX] + "-" for w in found if len(w) > PREFIX])
    return len(words), found


def shape_of(text: str, n_words: int, n_distinct: int) -> list[float]:
    """Shares of letters, capitals, digits, symbols, bars and breaks; lengths; repetition."""
    data = text.encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    capitals, letters = count[65:91].sum(), count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    plain = count[[32, 33, 44, 46, 10, 124]].sum()
    symbols = n - letters - count[48:58].sum() - plain
    return [
        capitals / max(1, letters), count[48:58].sum() / n, symbols / n, count[124] / n, count[33] / n, count[10] / n,
        min(letters / max(1, n_words), 40) / 10, math.log1p(n_words) / 10, math.log1p(n_words) / math.log(2 + n_distinct),
    ]


def features(text: str | None, markers: list[dict[str, float]]) -> list[float]:
    """The shape, and for each marker list the logarithm of the weight found and the largest one."""
    n, found = words_of(text or "")
    out = shape_of(text or "", n, len(found))
    for listed in markers:
        weights = [listed[w] for w in listed.keys() & found]
        out += [math.log1p(sum(weights)), max(weights, default=0.0)]
    return out


def marker_words(bad: list[np.ndarray], good: list[np.ndarray], vocabulary: list[str]) -> dict[str, float]:
    """Words much more frequent in rejected documents, and how much (log ratio).

    Documents are arrays of the numbers of their distinct words in ``vocabulary``.
    """
    inside, outside = (
        np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *docs]), minlength=len(vocabulary)) for docs in (bad, good)
    )
    weight = np.log((inside + 0.5) / (len(bad) + 1)) - np.log((outside + 0.5) / (len(good) + 1))
    found = np.flatnonzero((inside >= max(3, len(bad) // 100)) & (weight >= _LEAST_WEIGHT))
    return {vocabulary[i]: float(weight[i]) for i in found}


class Model:
    """Marker lists, the scale of each feature and the weights of a logistic regression.

    ``fit`` gives None if the labelled rows lack one of the two outcomes.
    """

    def __init__(self, markers: list[dict[str, float]], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.markers, self.mean, self.scale, self.weights = markers, mean, scale, weights

    def logits(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows).reshape(len(rows), -1) - self.mean) / self.scale
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -15, 15)

    @classmethod
    def fit(cls, kinds: list[str], words: list[np.ndarray], vocabulary: list[str], shapes: list[list[float]]) -> Model | None:
        """Marker scores of each half come from the other half's markers, as on unseen documents."""
        good = np.array([k == "good" for k in kinds])
        if good.all() or not good.any():
            return None

        def lists(use: np.ndarray) -> list[dict[str, float]]:
            clean = [w for w, k, u in zip(words, kinds, use) if u and k == "good"]
            return [
                marker_words([w for w, k, u in zip(words, kinds, use) if u and k == kind], clean, vocabulary) for kind in ("low", "toxic")
            ]

        half = np.arange(len(kinds)) % 2 == 0
        scores = np.zeros((len(kinds), 4))
        number = {word: i for i, word in enumerate(vocabulary)}
        for use in (half, ~half):
            for column, markers in enumerate(lists(use)):
                weight = np.zeros(len(vocabulary))
                weight[[number[w] for w in markers]] = list(markers.values())
                for i in np.flatnonzero(~use):
                    own = weight[words[i]]
                    scores[i, 2 * column : 2 * column + 2] = math.log1p(own.sum()), own.max(initial=0.0)
        x = np.hstack([np.array(shapes), scores])
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(good)  # no outcome is favoured
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (good - p)) - ridge * w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(lists(np.ones(len(kinds), dtype=bool)), mean, scale, w)


def label_kinds(labels: DataFrame) -> DataFrame:
    """doc_id and kind: toxic, low or good. Of repeated labels the worst counts; null labels are none."""
    one = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return one.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").otherwise("good").alias("kind"))


def train(docs: DataFrame, kinds: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fits on at most ``rows`` labelled documents of each kind, picked by a hash of the id.

    Only their distinct words and shapes reach the driver; equal texts count once.
    """
    order = F.xxhash64("doc_id")
    picked = None
    for kind in ("good", "low", "toxic"):
        part = kinds.where(F.col("kind") == kind).orderBy(order, "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    texts = keyed(docs, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("kind", pa.string()), ("words", pa.string()), ("shape", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shapes = [], []
            for text in batch["text"].to_pylist():
                n, found = words_of(text)
                words.append(" ".join(found))
                shapes.append(shape_of(text, n, len(found)))
            columns = [batch["doc_id"], batch["_key"], batch["kind"], pa.array(words, pa.string()), pa.array(shapes, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = texts.select("doc_id", "_key", "kind", "text").mapInArrow(run, "doc_id long, _key long, kind string, words string, shape array<double>")
    vocabulary: dict[str, int] = {}
    once = {}
    for row in found.toLocalIterator():
        words = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in row["words"].split()], dtype=np.int32)
        before = once.get(row["_key"])
        if before is None or (row["doc_id"], row["kind"]) < before[:2]:
            once[row["_key"]] = (row["doc_id"], row["kind"], words, list(row["shape"]))
    sample = [once[key] for key in sorted(once, key=lambda k: (once[k][0], k))]
    return Model.fit([r[1] for r in sample], [r[2] for r in sample], list(vocabulary), [r[3] for r in sample])


def evidence(docs: DataFrame, model: Model | None, host: str, path: str) -> DataFrame:
    """doc_id, _key, host, path and the logit of being good at even odds; 0 for empty texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("logit", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            logits = np.zeros(len(texts))
            full = [i for i, text in enumerate(texts) if text]
            if model is not None and full:
                logits[full] = model.logits([features(texts[i], model.markers) for i in full])
            yield pa.RecordBatch.from_arrays([batch[n] for n in ("doc_id", "_key", "host", "path")] + [pa.array(logits)], schema=schema)

    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("host", host), ("path", path))]
    source = keyed(docs, *site, F.col("text").alias("text"))
    return source.mapInArrow(run, "doc_id long, _key long, host string, path string, logit double")


def overall_rate(bins: list[tuple[float, int]], good: int, labelled: int) -> float:
    """The share of good documents, from labels and from the evidence of unlabelled ones.

    Evidence is at even odds; each step takes it at the odds of the rate found so far (expectation
    maximisation). ``bins`` are (logit, documents). One good and one bad document count beside.
    """
    logit, n = (np.array(x, dtype=np.float64) for x in (zip(*bins) if bins else ((), ())))
    total, rate = labelled + n.sum(), 0.5
    for _ in range(200):
        expected = (n / (1 + np.exp(-(logit + math.log(rate / (1 - rate)))))).sum()
        before, rate = rate, (good + expected + 1) / (total + 2)
        if abs(rate - before) < 1e-9:
            break
    return float(rate)


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
    train_rows: int = TRAIN_ROWS, least: float = LEAST_GOOD,
) -> DataFrame:
    """doc_id, _key, evidence, host_rate, path_rate, p_good and keep of every row.

    The rates are those of the row's site without the row. Null and empty texts have no evidence
    (one half) and follow their site. Null hosts and paths are sites of their own. If the labels
    lack one of the outcomes, nothing is known and every document is kept. Repeated rows count as
    often as they come and share a result.
    """
    kinds = label_kinds(labels)
    model = train(docs, kinds, train_rows)
    scored = stored(evidence(docs, model, host, path), "classifier-evidence")
    labelled = scored.join(kinds, "doc_id", "left")
    # Logits lie between -15 and 15: at most 3,001 rows reach the driver.
    counts = labelled.groupBy(F.when(F.col("kind").isNull(), F.round("logit", 2)).alias("bin"), (F.col("kind") == "good").alias("good")).count().collect()
    overall = overall_rate(
        sorted((row["bin"], row["count"]) for row in counts if row["bin"] is not None),
        sum(row["count"] for row in counts if row["bin"] is None and row["good"]), sum(row["count"] for row in counts if row["bin"] is None),
    )
    corrected = 1 / (1 + F.exp(-(F.col("logit") + math.log(overall / (1 - overall)))))
    known = labelled.withColumn("good", F.when(F.col("kind").isNull(), corrected).otherwise((F.col("kind") == "good").cast("double")))
    known = stored(known.select("doc_id", "_key", "host", "path", "logit", "good"), "classifier-known")
    paths = stored(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("k")), "classifier-sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))

    def strength(sites: DataFrame, n: str, k: str, mean: Column) -> float:
        """Pseudo-documents of the wider level: its variance over that between the sites."""
        rate = F.col(k) / F.col(n)
        spread = F.sum(F.col(n) * (rate - mean) * (rate - mean)) / F.sum(n)
        noise = F.sum(mean * (1 - mean)) / F.sum(n)
        between = F.greatest(spread - noise, F.lit(1e-4))
        return sites.agg(F.coalesce(F.sum(F.col(n) * mean * (1 - mean)) / F.sum(n) / between, F.lit(1.0))).first()[0]

    # Two figures over all sites go through the driver.
    host_strength = strength(hosts, "host_n", "host_k", F.lit(overall))
    whole_rate = (F.col("host_k") + host_strength * overall) / (F.col("host_n") + host_strength)
    sites = paths.join(hosts, "host")
    path_strength = strength(sites.withColumn("host_rate", whole_rate), "n", "k", F.col("host_rate"))
    own = F.col("good")
    rated = known.join(sites, ["host", "path"]).withColumn(
        "host_rate", (F.col("host_k") - own + host_strength * overall) / (F.col("host_n") - 1 + host_strength)
    ).withColumn("path_rate", (F.col("k") - own + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength))
    certain = F.greatest(F.least(F.col("path_rate"), F.lit(1 - 1e-12)), F.lit(1e-12))
    shift = F.log(certain / (1 - certain))  # evidence was learned at even odds
    p_good = (1 / (1 + F.exp(-(F.col("logit") + shift)))) if model is not None else F.lit(1.0)
    return rated.select(
        "doc_id", "_key", (1 / (1 + F.exp(-F.col("logit")))).alias("evidence"), "host_rate", "path_rate", p_good.alias("p_good")
    ).withColumn("keep", F.col("p_good") >= least)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents the classifier rejects."""
    kept = classify(docs, labels).where("keep").select("doc_id", "_key").distinct()
    return same_document(docs, kept, "left_semi")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "evidence", "host_rate", "path_rate", "p_good", "keep")
