"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

The templates are a parameter of bounded size, and so is their inverted index, which goes to
the tasks; each document is read once, where it lies, and nothing is shuffled. Short templates
are indexed by all their word sequences, of a length that the coverage limit leaves whole
somewhere. Licenses that share most of their words claim the same place: the one that is more
like the text is reported.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import table
from trailspark.llm.license_texts import TEMPLATES

GRAM = 3  # words in a fingerprint
WINDOW = 2  # of which one in so many neighbours is kept: shared runs of GRAM + WINDOW - 1 words are found
SHORT = 15  # words of a template up to which every sequence is indexed
LEAST_COVERAGE = 0.8
MAX_TEMPLATE_WORDS = 1_000_000  # of all templates together; they go to every task
_WORD = re.compile(r"[^\W_]+")

class WordNumbers(dict):
    """Hashes of words, remembered; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = (out ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15) if len(out) else out
        out ^= out >> np.uint64(29)
    return out


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The positions of the least hash (the last of equals) of every window of neighbours."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


def banded(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched template words, start, end in ``words``) of the best alignment near a diagonal.

    ``diagonal`` is where in ``words`` the template would start; insertions, deletions and
    exchanges move the alignment within ``band`` of it. A longest common subsequence, of the
    tightest span.
    """
    width = 2 * band + 1
    empty = (0, 0)  # (matched, -start): more matches first, then a later start
    above: list[tuple[int, int]] = [empty] * (width + 1)
    best = (0, 0, 0)
    for i, word in enumerate(template):
        row: list[tuple[int, int]] = []
        for k in range(width):
            j = i + diagonal - band + k
            cell = above[k + 1]
            if k and row[k - 1] > cell:
                cell = row[k - 1]
            if 0 <= j < len(words) and words[j] == word:
                matched, start = above[k]
                hit = (matched + 1, start if matched else j)
                if hit > cell:
                    cell = hit
                    if (hit[0], hit[1] - j) > (best[0], best[1] - best[2] + 1):
                        best = (hit[0], hit[1], j + 1)
            row.append(cell)
        above = [*row, empty]
    return best


def whole_run(length: int, least: float) -> int:
    """Words in a row that every copy of a template keeps which has ``least`` of its words and none put in between."""
    lost = length - max(1, math.ceil(length * least - 1e-9))
    return -(-(length - lost) // (lost + 1))


class Index:
    """The inverted indexes of the templates by sequence length: fingerprint to (template, position)."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE, gram: int = GRAM, window: int = WINDOW, short: int = SHORT):
        memory = WordNumbers()
        self.window, self.least = window, least
        self.names = sorted(templates)
        self.words = [np.array([memory[w] for w in _WORD.findall(templates[n].lower())], dtype=np.uint64) for n in self.names]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
        # (sequence length, whether winnowed) -> fingerprint -> places
        self.places: dict[tuple[int, bool], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            if not len(words):
                continue
            full = len(words) <= short
            size = min(gram, whole_run(len(words), least)) if full else gram
            hashes = grams(words, size)
            for p in range(len(hashes)) if full else winnowed(hashes, window):
                self.places[size, full][int(hashes[p])].append((t, int(p)))
        self.keys = {kind: np.array(sorted(found), dtype=np.uint64) for kind, found in self.places.items()}

    def diagonals(self, words: np.ndarray) -> dict[int, set[int]]:
        """Where in ``words`` each template may start, by the sequences they share."""
        out = defaultdict(set)
        for (size, full), keys in self.keys.items():
            hashes = grams(words, size)
            if not len(hashes):
                continue
            chosen = np.arange(len(hashes)) if full else winnowed(hashes, self.window)
            at = np.searchsorted(keys, hashes[chosen])
            for p in chosen[keys[np.minimum(at, len(keys) - 1)] == hashes[chosen]]:
                for t, q in self.places[size, full][int(hashes[p])]:
                    out[t].add(int(p) - q)
        return out

    def scan(self, text: str, memory: WordNumbers) -> list[tuple[str, int, int, int, int]]:
        """(template, matched, length, start, end) of the copies in a text, in words."""
        words = np.array([memory[w] for w in _WORD.findall(text.lower())], dtype=np.uint64)
        taken = []
        for t, starts in self.diagonals(words).items():
            template, band = self.words[t], 2 + len(self.words[t]) // 4
            reached = None
            for start in sorted(starts):
                if reached is not None and start <= reached + band:
                    continue  # the band of the diagonal before covers this one
                reached = start
                matched, low, high = banded(template, words, start, 2 * band)
                if matched >= self.least * len(template):
                    taken.append((matched, low, high, t))

        def like(copy: tuple[int, int, int, int]) -> float:
            matched, low, high, t = copy
            return 2 * matched / (len(self.words[t]) + high - low)

        # Diagonals of repeated phrases lead to the same copy: of a template's overlapping spans the best counts.
        # Of different templates, those that claim mostly the same words exclude each other.
        found: list[tuple[int, int, int, int]] = []
        for copy in sorted(set(taken), key=lambda c: (-like(c), -c[0], c[1], self.names[c[3]])):
            _, low, high, t = copy
            shared = [(min(high, b) - max(low, a), max(high - low, b - a), s == t) for _, a, b, s in found]
            if all(n <= 0 or not same and 2 * n <= longer for n, longer, same in shared):
                found.append(copy)
        return [(self.names[t], matched, len(self.words[t]), low, high) for matched, low, high, t in found]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, matched_words, start, end: copies of templates in documents.

    ``coverage`` is the share of the template's words found in order; start and end (excluded)
    count words. Of licenses that claim mostly the same words the likest is reported, of equally
    like ones that with more words found, then the first by name. Null and empty texts have none;
    repeated rows are reported as often as they come; a template without words is never found.
    """
    index = Index(TEMPLATES if templates is None else templates, least)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordNumbers()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                for name, matched, length, low, high in index.scan(text.as_py() or "", memory):
                    rows.append((doc, name, matched / length, matched, low, high))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, license string, coverage double, matched_words int, start int, end int")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
