"""SimHash near-duplicates, searched in a hierarchical index of Gray-ordered fingerprints.

Two fingerprints that differ in at most ``distance`` of 64 bits agree wholly in one of
``distance + 1`` equal segments. The top nodes of the index are therefore the masked patterns
"these bits have these values"; a fingerprint sits under one node of each mask. A node that
holds more codes than ``node_limit`` is factored further by the same argument over its free
bits, so no node grows with the data and none is cut. Below a node, the codes are sorted by
Gray rank, neighbours share patterns (bits all of them agree in), and pairs of patterns that
differ in more than ``distance`` fixed bits are dropped with all codes below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import components, keyed, same_document, stored, table

SHINGLE = 3
DISTANCE = 3
SEED = 42
NODE_LIMIT = 50_000  # codes below one node, searched in one task's memory
LEAF_BITS = 15  # a node with so few free bits holds at most 2^15 codes and is a leaf at any limit
FAN = 16
_BATCH = 150_000
_PAIRS = 1 << 12


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends[: max(0, len(words) - shingle)]]
    ends = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), 1 << 15):
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)])]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _key and ``code``, the fingerprint as a signed long. Null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("code", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([simhash(value.as_py(), shingle) for value in batch["bytes"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_key"], pa.array(codes.view(np.int64))], schema=schema)

    source = keyed(docs, F.col("text").cast("binary").alias("bytes"))
    return source.mapInArrow(run, "doc_id long, _key long, code long")


def gray_rank(code: Column) -> Column:
    """The position of a code in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def child_masks(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` equal segments of its free bits added; signed longs."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        child = mask & (1 << 64) - 1
        for bit in free[low:high]:
            child |= 1 << bit
        out.append(child - (1 << 64) if child >> 63 else child)
    return list(dict.fromkeys(out))


def index_nodes(codes: DataFrame, distance: int, node_limit: int) -> DataFrame:
    """(mask, value, code, rep): every code below its leaf nodes."""
    parts = distance + 1
    level = codes.withColumn("mask", F.explode(F.array([F.lit(m) for m in child_masks(0, parts)])))
    leaves = None
    while True:
        level = level.withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
        heavy = stored(level.groupBy("mask", "value").count().where(F.col("count") > node_limit).select("mask", "value"), "simhash-heavy")
        # Few masks at any size: each level fixes a share of the free bits, and a mask with few is a leaf.
        masks = [row["mask"] for row in heavy.select("mask").distinct().collect()]
        masks = [m for m in masks if 64 - (m % (1 << 64)).bit_count() > LEAF_BITS]
        if not masks:
            return level if leaves is None else leaves.unionByName(level)
        heavy = heavy.where(F.col("mask").isin(masks))
        light = level.join(heavy, ["mask", "value"], "left_anti")
        leaves = light if leaves is None else leaves.unionByName(light)
        pairs = [x for m in masks for x in (F.lit(m), F.array([F.lit(c) for c in child_masks(m, parts)]))]
        level = stored(level.join(heavy, ["mask", "value"], "left_semi").select("code", "rep", "mask"), "simhash-level")
        level = level.select("code", "rep", F.explode(F.create_map(*pairs)[F.col("mask")]).alias("mask"))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def linked(groups: np.ndarray, codes: np.ndarray, distance: int) -> np.ndarray:
    """For each code, the first code of its group it is linked to, directly or through others.

    ``groups`` numbers the index nodes in ascending order; codes come in Gray order in each.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(codes)]
    levels = [(codes, codes, None, None)]  # bits set in all, bits set in any, children from, to
    while np.any(ends - starts > 1):
        counts = -(-(ends - starts) // FAN)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        low = np.repeat(starts, counts) + inside * FAN
        high = np.minimum(low + FAN, np.repeat(ends, counts))
        every, some, *_ = levels[-1]
        levels.append((np.bitwise_and.reduceat(every, low), np.bitwise_or.reduceat(some, low), low, high))
        ends = np.cumsum(counts)
        starts = ends - counts
    parent = np.arange(len(codes))
    roots = np.arange(len(starts))
    stack = [(len(levels) - 1, roots, roots)] if len(levels) > 1 else []
    while stack:
        depth, a, b = stack.pop()
        if len(a) > _PAIRS:
            stack.append((depth, a[_PAIRS:], b[_PAIRS:]))
            a, b = a[:_PAIRS], b[:_PAIRS]
        _, _, low, high = levels[depth]
        na, nb = high[a] - low[a], high[b] - low[b]
        of = np.repeat(np.arange(len(a)), na * nb)
        at = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = low[a][of] + at // nb[of], low[b][of] + at % nb[of]
        keep = x < y if depth == 1 else x <= y
        x, y = x[keep], y[keep]
        every, some, *_ = levels[depth - 1]
        fixed = ~(every ^ some)
        near = np.bitwise_count((every[x] ^ every[y]) & fixed[x] & fixed[y]) <= distance
        x, y = x[near], y[near]
        if depth > 1:
            if len(x):
                stack.append((depth - 1, x, y))
            continue
        while len(x):
            parent = _roots(parent)
            x, y = parent[x], parent[y]
            differ = x != y
            x, y = x[differ], y[differ]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return _roots(parent)


def index_links(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): for each leaf node, edges that connect what is linked inside it; at most one a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: pa.Table) -> pa.RecordBatch:
            mask, value = part["mask"].to_numpy(), part["value"].to_numpy()
            codes, reps = part["code"].to_numpy().view(np.uint64), part["rep"].to_numpy()
            change = np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
            groups = np.cumsum(change)
            shared = np.bincount(groups)[groups] > 1
            codes, reps, groups = codes[shared], reps[shared], groups[shared]
            if not len(codes):
                root = np.zeros(0, dtype=np.int64)
            else:
                root = linked(groups, codes, distance)
            other = root != np.arange(len(codes))
            return pa.RecordBatch.from_pydict({"a": pa.array(reps[other]), "b": pa.array(reps[root[other]])})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < _BATCH:
                continue
            part = pa.Table.from_batches(held)
            mask, value = part["mask"].to_numpy(), part["value"].to_numpy()
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
            if not len(cut):
                continue
            at = int(cut[-1]) + 1
            yield edges(part.slice(0, at))
            held = part.slice(at).to_batches()
        if held:
            yield edges(pa.Table.from_batches(held))

    placed = nodes.repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("code")))
    return placed.select("mask", "value", "code", "rep").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, _key, code and component_id of every document.

    Documents whose fingerprints differ in at most ``distance`` bits are linked; component_id
    is the least doc_id reachable over links. Null and wordless texts have fingerprint 0 and are
    linked like any other. Repeated rows keep their number and share a component. A row without
    doc_id has a fingerprint but cannot be referred to: its component_id is null. No rows give
    no rows; other columns are not looked at.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    codes = stored(prints.where("doc_id IS NOT NULL").groupBy("code").agg(F.min("doc_id").alias("rep")), "simhash-codes")
    # An id may come with several texts: its codes are one document, linked through the id.
    known = prints.where("doc_id IS NOT NULL").select("doc_id", "code")
    several = known.groupBy("doc_id").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low <> high")
    bridges = known.join(several.select("doc_id"), "doc_id", "left_semi").join(codes, "code").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")
    )
    edges = index_links(index_nodes(codes, distance, node_limit), distance).unionByName(bridges)
    group = components(edges, "simhash").withColumnRenamed("node", "rep")
    of_code = codes.join(group, "rep", "left").select("code", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(of_code, "code", "left")
    return out.select("doc_id", "_key", "code", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each component: the least doc_id, then the least text key.

    Rows that repeat id and text become one; rows without doc_id stay.
    """
    found = near_duplicates(docs, shingle, distance)
    first = found.where("doc_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
    stay = first.select("first.doc_id", "first._key").unionByName(found.where("doc_id IS NULL").select("doc_id", "_key").distinct())
    kept = same_document(docs, stay, "left_semi")
    columns = kept.columns
    return kept.withColumn("_llm_key", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_llm_key"]).select(*columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
