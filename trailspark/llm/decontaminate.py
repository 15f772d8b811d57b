"""Benchmark decontamination: word pairs find candidate passages, alignment scores them.

A seed is a pair of words at most two places apart, in the item and in the document. The score
limit implies how many seeds of an item a passage has on near diagonals: with m matches and
errors e between them, 2m - e reaches the limit T only if at least T / 2 - 1 of the m - 1 steps
from match to match hold at most one error. Places with that many seeds are aligned
(Smith-Waterman on words), so nothing above the limit is missed. Documents are read once for
each slab of the benchmark; all work on a document is in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import keyed, same_document, stored, table

LEAST_WORDS = 4  # shorter items are not searched
FILTER_BITS = 1 << 23
SLAB_WORDS = 1_000_000  # of the benchmark, searched in one pass
PIECE_WORDS = 4096  # of a document, searched at once; pieces overlap by the longest passage
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5  # of the score of a whole verbatim copy
_WORD = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


class WordHashes(dict):
    """Hashes of words, remembered; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str | None, memory: WordHashes) -> np.ndarray:
    return np.array([memory[w] for w in _WORD.findall((text or "").lower())], dtype=np.uint64)


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs one and two places apart, and the position of their first words."""
    left, right = words * _FACTORS[0], words * _FACTORS[1]
    left ^= left >> np.uint64(31)
    found = np.concatenate([left[:-1] + right[1:], left[:-2] + right[2:]])
    found ^= found >> np.uint64(29)
    return found, np.concatenate([np.arange(len(left[:-1])), np.arange(len(left[:-2]))])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment score and the passage position just behind it."""
    width = len(passage)
    slope = GAP * np.arange(width + 1)
    above = np.zeros(width + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        row = np.zeros(width + 1, dtype=np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - slope) + slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


class Index:
    """The items of a slab, and where in them each word pair stands."""

    def __init__(self, ids: list, items: list[np.ndarray], least_score: float, filter_bits: int) -> None:
        self.ids, self.items, self.least_score = ids, items, least_score
        length = np.array([len(i) for i in items], dtype=np.int64)
        self.needed = np.array([max(1, ceil(least_score * n - 1 - 1e-9)) for n in length], dtype=np.int64)
        # An alignment at the limit has at most 2 (1 - least_score) n gaps and (3 - 2 least_score) n words.
        self.width = np.array([max(1, ceil(2 * (1 - least_score) * n)) for n in length], dtype=np.int64)
        self.span = np.array([ceil((3 - 2 * least_score) * n) for n in length], dtype=np.int64)
        every = [pairs(i) for i in items]
        found = np.concatenate([g for g, _ in every])
        order = np.argsort(found, kind="stable")
        self.grams, self.first = np.unique(found[order], return_index=True)
        self.last = np.append(self.first[1:], len(found))
        self.item = np.repeat(np.arange(len(items)), [len(g) for g, _ in every])[order]
        self.at = np.concatenate([p for _, p in every])[order]
        self.bitmap = np.zeros(filter_bits, dtype=bool)
        self.bitmap[(found % np.uint64(filter_bits)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low, high): stretches of the words that hold every passage above the limit."""
        found, pos = pairs(words)
        hit = np.flatnonzero(self.bitmap[(found % np.uint64(len(self.bitmap))).astype(np.int64)])
        least = self.needed.min()
        if len(hit) < least:
            return []
        slot = np.minimum(np.searchsorted(self.grams, found[hit]), len(self.grams) - 1)
        same = self.grams[slot] == found[hit]
        slot, pos = slot[same], pos[hit[same]]
        count = self.last[slot] - self.first[slot]
        place = np.repeat(self.first[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, at, pos = self.item[place], self.at[place], np.repeat(pos, count)
        many = (np.bincount(item, minlength=len(self.items)) >= self.needed)[item]
        item, at, pos = item[many], at[many], pos[many]
        if not len(item):
            return []
        # The diagonals of one passage lie within the width: bins of two widths overlap by half.
        low = (pos - at) // self.width[item]
        least_low, kinds = int(low.min()), np.flatnonzero(np.bincount(item))
        numbers = int(low.max()) - least_low + 2
        key = np.searchsorted(kinds, item) * numbers + low - least_low
        key, needed, enough = np.concatenate([key, key + 1]), np.repeat(self.needed[kinds], numbers), True
        pos, at = np.tile(pos, 2), np.tile(at, 2)
        many = (np.bincount(key, minlength=len(needed)) >= needed)[key]
        key, pos, at = key[many], pos[many], at[many]
        if not len(key):
            return []
        places = len(words) + int(at.max()) + 1
        for place in (pos, at):
            once = np.unique(key * places + place) // places
            enough = enough & (np.bincount(once, minlength=len(needed)) >= needed)
        bins = np.stack([kinds[np.flatnonzero(enough) // numbers], np.flatnonzero(enough) % numbers + least_low])
        out: list[tuple[int, int, int]] = []
        for item, number in bins.T.tolist():
            start = max(0, (number - 1) * int(self.width[item]))
            end = min(len(words), (number + 1) * int(self.width[item]) + len(self.items[item]))
            if out and out[-1][0] == item and out[-1][2] >= start:
                out[-1] = (item, out[-1][1], end)
            else:
                out.append((item, start, end))
        return out

    def found(self, words: np.ndarray, memory: dict) -> Iterator[tuple[int, float, int, int]]:
        """(item, score, start, end) of the best passage of each candidate; equal stretches are aligned once."""
        overlap = int(self.span.max())
        step = max(PIECE_WORDS, 4 * overlap)
        for base in range(0, max(1, len(words) - overlap), step):
            piece = words[base : base + step + overlap]
            for item, low, high in self.candidates(piece):
                stretch = piece[low:high]
                key = (item, stretch.tobytes())
                if key not in memory:
                    if len(memory) > 20_000:
                        memory.clear()
                    memory[key] = self.best(item, stretch)
                score, start, end = memory[key]
                if score >= self.least_score:
                    yield item, score, base + low + start, base + low + end

    def best(self, item: int, stretch: np.ndarray) -> tuple[float, int, int]:
        wanted = self.items[item]
        points, end = align(wanted, stretch)
        score = points / (MATCH * len(wanted))
        if score < self.least_score:
            return score, 0, end
        near = stretch[max(0, end - int(self.span[item])) : end]
        return score, end - align(wanted[::-1], near[::-1])[1], end


def item_words(items: DataFrame) -> DataFrame:
    """item_id and words (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            words = pa.array([word_hashes(t, memory).view(np.int64) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["item_id"], words], names=["item_id", "words"])

    source = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return source.mapInArrow(run, "item_id long, words array<long>")


def passages(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, _key, item_id, score, start, end of the passages of ``docs`` that copy an item of the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, index, memory = WordHashes(), shared.value, {}
        for batch in batches:
            out = []
            for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["_key"].to_pylist(), batch["text"]):
                for item, *passage in index.found(word_hashes(text.as_py(), hashes), memory):
                    out.append((doc, key, index.ids[item], *passage))
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return keyed(docs, "text").mapInArrow(run, "doc_id long, _key long, item_id long, score double, start int, end int")


def contaminated(
    docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, n: int = LEAST_WORDS, filter_bits: int = FILTER_BITS,
    slab_words: int = SLAB_WORDS,
) -> DataFrame:
    """doc_id, _key, item_id, score, start, end: passages of documents that copy a test item.

    ``score`` is the alignment score over that of a whole copy, the best of the document and
    item; the passage has the words start to end (excluded). Every document and item whose
    alignment reaches ``least_score`` is found. Repeated rows give one result; an item of
    several rows counts with each. Null and empty texts and items under ``n`` words give none;
    a null item_id is one of its own. ``n * least_score`` has to be 2 or more: below that a
    single word would reach the limit.
    """
    if n * least_score < 2:
        raise ValueError(f"items of {n} words reach the score {least_score} with a single word")
    source = item_words(items).where(F.size("words") >= n).distinct()
    source = stored(source, "decontaminate-items")
    total = source.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    slabs = ceil(total / slab_words)
    scored = None
    for number in range(slabs):
        slab = source.where(F.pmod(F.xxhash64("words"), F.lit(slabs)) == number).toArrow()
        if not len(slab):
            continue
        words = [w.values.to_numpy().view(np.uint64) for w in slab["words"]]
        found = passages(docs, Index(slab["item_id"].to_pylist(), words, least_score, filter_bits))
        scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        scored = keyed(docs.limit(0)).selectExpr("doc_id", "_key", "0L AS item_id", "0D AS score", "0 AS start", "0 AS end")
    best = scored.groupBy("doc_id", "_key", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("b"))
    return best.select("doc_id", "_key", "item_id", "b.score", (-F.col("b.s")).alias("start"), "b.end")


def drop_contaminated(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the documents that copy a test item."""
    return same_document(docs, contaminated(docs, items, least_score).select("doc_id", "_key").distinct(), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "start", "end")
