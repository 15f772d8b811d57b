"""Phrase collocations: counts of all phrases as prefix sums over the longest windows.

Each word starts one window of up to ``LONGEST`` words, padded where its piece ends. Only these
windows are counted; ``ROLLUP`` over their columns sums them for successively shorter prefixes,
which gives the count of every phrase of every length, and of all words, from one table.

A window need not go on past a rare pair or triple: no phrase with it inside can be frequent. A
first pass adds up the pairs and triples of the whole corpus in ``BUCKETS`` hashed counters. A
counter is never below the count of a phrase in it, so cutting windows where a counter stays
under the limit loses nothing. The counters have one fixed size, as has what is broadcast of
them: a bit each. The more phrases share a counter, the fewer windows are cut; the result is the
same. A window always has its first word, so the table also holds the count of every word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.llm.common import stored, table

LONGEST = 5  # words in a phrase
LEAST_COUNT = 100
SHARE = 100  # percent: a phrase goes if a longer one with its words is as frequent as this share of it
TOP = 2000
NO_LANG = "und"
BUCKETS = 1 << 26
PART = 1 << 16  # counters in one row
DEPTH = 3  # words in the longest phrases that are looked up in the counters
TOKENS = 1 << 21  # words a task counts together
SEGMENT = 1 << 22  # bytes of a text that are split into words at once

_STOPS = b".,;:!?\n\x0b\x0c\r"
_FOLDED = bytes.maketrans(
    ascii_uppercase.encode() + _STOPS + b"\t", ascii_lowercase.encode() + b"." * len(_STOPS) + b" "
)


def runs(text: bytes | None, keep: int, segment: int = SEGMENT) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text, ``.`` between pieces, in runs; the flag is True for the last one.

    A run that is not the last comes again with its last ``keep`` words in front of the next.
    """
    data = (text or b"").translate(_FOLDED).replace(b".", b" . ")
    at, words = 0, []
    while len(data) - at > segment:
        cut = data.find(b" ", at + segment)
        if cut < 0:
            break
        words += data[at:cut].split()
        at = cut
        if len(words) > keep:
            yield words, False
            words = words[len(words) - keep :]
    yield words + data[at:].split(), True


class Counted:
    """Words of one language as numbers; 0 stands between pieces and texts."""

    def __init__(self, lang: str):
        self.lang, self.number, self.ids = lang, {b".": 0}, array("i")

    def add(self, words: list[bytes]) -> None:
        number = self.number
        self.ids.extend([number.setdefault(w, len(number)) for w in words])
        self.ids.append(0)

    def grams(self, depth: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The numbers; for 2 to ``depth`` words from each place on, whether they lie in one piece, and their counter."""
        ids = np.array(self.ids, dtype=np.int32)
        seed = xxhash.xxh32_intdigest(self.lang)
        codes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.number], dtype=np.uint64)[ids]
        inside, mixed, out = ids > 0, codes, []
        for size in range(2, depth + 1):
            n = max(0, len(ids) - size + 1)
            inside, mixed = inside[:n] & (ids[size - 1 :] > 0), mixed[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :]
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((inside, (mixed >> np.uint64(65 - BUCKETS.bit_length())).astype(np.uint32)))
        return ids, out


def chunks(batches: Iterator[pa.RecordBatch], keep: int, tokens: int = TOKENS) -> Iterator[tuple[Counted, int]]:
    """Words to count, and how many of them start a window here; the others only follow."""
    open_: dict[str, Counted] = {}
    held = 0
    for batch in batches:
        for lang, value in zip(batch["lang"].to_pylist(), batch["bytes"]):
            for words, last in runs(value.as_py(), keep):
                if not last:
                    part = Counted(lang)
                    part.add(words)
                    yield part, len(words) - keep
                    continue
                if lang not in open_:
                    open_[lang] = Counted(lang)
                open_[lang].add(words)
                held += len(words) + 1
            if held >= tokens:
                for part in open_.values():
                    yield part, len(part.ids)
                open_, held = {}, 0
    for part in open_.values():
        yield part, len(part.ids)


def frequent_bits(texts: DataFrame, least: int, depth: int = DEPTH) -> np.ndarray:
    """A bit for each counter: whether the phrases in it come ``least`` times together (255 at most)."""
    most = min(least, 255)
    schema = pa.schema([("part", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(BUCKETS, dtype=np.uint8)
        for part, starts in chunks(batches, depth - 1):
            for inside, at in part.grams(depth)[1]:
                found, n = np.unique(at[:starts][inside[:starts]], return_counts=True)
                counters[found] = np.minimum(counters[found] + n, most)
        for number in range(BUCKETS // PART):
            own = counters[number * PART : (number + 1) * PART]
            places = np.flatnonzero(own)
            if len(places):
                yield pa.RecordBatch.from_pydict(
                    {"part": [number], "places": [places.astype(np.uint16).tobytes()], "counts": [own[places].tobytes()]}, schema=schema
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, places, counts in zip(*[column.to_pylist() for column in batch.columns]):
                own = sums.setdefault(number, np.zeros(PART, dtype=np.uint16))
                places = np.frombuffer(places, dtype=np.uint16)
                own[places] = np.minimum(own[places] + np.frombuffer(counts, dtype=np.uint8), most)
        for number, own in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "bits": [np.packbits(own >= most).tobytes()]})

    bits = np.zeros((BUCKETS // PART, PART // 8), dtype=np.uint8)
    counted = texts.mapInArrow(count, "part int, places binary, counts binary").repartition("part").mapInArrow(merge, "part int, bits binary")
    for row in counted.toLocalIterator():  # BUCKETS bits at any size of the corpus
        bits[row["part"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits.reshape(-1)


def longest_windows(part: Counted, starts: int, bits: np.ndarray, longest: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The different windows (numbers of words, 0 where padded) that start here, and how often each comes."""
    ids, grams = part.grams(min(depth, longest))
    fits = []
    for inside, at in grams:
        whole = np.zeros(len(ids), dtype=bool)
        whole[: len(at)] = inside & (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        fits.append(whole)
    begin = np.flatnonzero(ids[:starts] > 0)
    goes_on = fits[0][begin]
    single = np.bincount(ids[begin[~goes_on]], minlength=1)
    words = np.flatnonzero(single)
    begin = begin[goes_on]
    columns, open_ = [ids[begin].astype(np.int64)], np.ones(len(begin), dtype=bool)
    for k in range(1, longest):
        size = min(k + 1, len(fits) + 1)
        place = np.minimum(begin + k, len(ids) - 1)  # a gram that would reach past the end does not fit
        open_ = open_ & fits[size - 2][np.minimum(begin + k + 1 - size, len(ids) - 1)]
        columns.append(np.where(open_, ids[place], 0).astype(np.int64))
    key = columns[0]
    for column in columns[1:]:
        _, key = np.unique(key * len(part.number) + column, return_inverse=True)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    alone = np.zeros((longest, len(words)), dtype=np.int64)
    alone[0] = words
    return np.hstack([alone, *([np.stack([column[first] for column in columns])] if len(begin) else [])]), np.r_[single[words], n]


def windows(texts: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """lang, w1 to w(longest), n: how often each padded longest window comes; partial counts."""
    names = [f"w{k + 1}" for k in range(longest)]
    schema = pa.schema([("lang", pa.string()), *[(name, pa.string()) for name in names], ("n", pa.int64())])
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in chunks(batches, longest - 1):
            rows, n = longest_windows(part, starts, sent.value, longest)
            words = pa.array([b"", *list(part.number)[1:]], pa.binary()).cast(pa.string())
            for k in range(0, len(n), 1 << 16):
                own = slice(k, k + (1 << 16))
                columns = [words.take(pa.array(row[own])) for row in rows]
                langs = pa.array([part.lang], pa.string()).take(pa.array(np.zeros(len(n[own]), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([langs, *columns, pa.array(n[own].astype(np.int64))], schema=schema)

    ddl = ", ".join(["lang string", *[f"{name} string" for name in names], "n long"])
    return texts.mapInArrow(count, ddl)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> DataFrame:
    """lang, size, words (a list), phrase and a, its count, of all phrases with at least ``least``.

    A row of size 0 holds the number of all words of its language. Null texts have no words, a
    null language is ``und``, repeated rows count as often as they come.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("bytes"))
    names = [f"w{k + 1}" for k in range(longest)]
    padded = windows(texts, frequent_bits(texts, least), longest).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    sums = padded.rollup("lang", *names).agg(F.sum("n").alias("a"), F.grouping_id().alias("level"))
    size = F.lit(longest).cast("long") - F.bit_count("level")
    kept = sums.where(f"a >= {least} OR level = {(1 << longest) - 1}").select("lang", size.cast("int").alias("size"), *names, "a")
    # Of a prefix that is itself padded, the words make a shorter phrase, whose count is another row's.
    whole = F.array(*names)[F.col("size") - 1] != ""
    kept = kept.where("size >= 0 AND lang IS NOT NULL").where((F.col("size") == 0) | F.when(F.col("size") > 0, whole))
    words = F.slice(F.array(*names), F.lit(1), F.col("size"))
    return kept.select("lang", "size", words.alias("words"), F.array_join(words, " ").alias("phrase"), "a")


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, share: int = SHARE, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two words and more.

    Phrases are compared as UTF-8 bytes on ties. Without a frequent phrase there are no rows.
    """
    counts = stored(frequent_phrases(docs, longest, least), "collocation-counts")
    phrases = counts.where("size > 0").select("lang", "phrase", "a")
    found = counts.where("size > 1")
    words, size, k = F.col("words"), F.col("size"), F.col("k")
    cuts = found.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(words, F.lit(1), k).alias("first"), _joined(words, k + 1, size - k).alias("rest")
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    totals = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    big = "cast({} AS decimal(19, 0))".format
    score = F.expr(f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda s: F.transform(F.sequence(F.lit(1), size - s + 1), lambda i: _joined(words, i, s))
    ))
    inside = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left_over = best.join(inside, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left_over.select("lang", "phrase", "a", "n", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY 1),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS gram
  FROM words, range(1, {LONGEST + 1}) AS sizes(k)
),
counts AS (SELECT lang, k AS size, gram, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
cuts AS (SELECT lang, size, gram, a, unnest(range(1, size)) AS k FROM counts WHERE size > 1),
scored AS (
  SELECT c.lang, c.size, c.gram, c.a, k, l.a AS l, r.a AS r, n,
    1000 * c.a::HUGEINT * n // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.gram = c.gram[1:k] JOIN counts r ON r.lang = c.lang AND r.gram = c.gram[k + 1:]
    JOIN totals t ON t.lang = c.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
parts AS (
  SELECT lang, gram, a, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM counts WHERE size > 2)
),
inside AS (SELECT lang, gram[i:i + s - 1] AS gram, max(a) AS longer FROM parts GROUP BY ALL),
ranked AS (
  SELECT b.*, array_to_string(b.gram, ' ') AS phrase, row_number() OVER (
    PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.gram, ' ')) AS rank
  FROM best b LEFT JOIN inside USING (lang, gram) WHERE longer IS NULL OR 100 * longer < {SHARE} * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {TOP}
"""
