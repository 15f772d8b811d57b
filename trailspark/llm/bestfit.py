"""Best-fit packing: documents are laid into bins of a fixed number of tokens.

A bin never holds two pieces of one source or of one duplicate cluster; the query takes the
clusters from the near-duplicate operator. Pieces are dealt at random
into blocks of bounded size; in a block they go by falling size to the tightest bin that fits
and does not conflict: bins are ordered by what is left in them and carry bitmaps of sources
and groups, and the search walks up from the piece's size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import simhash
from trailspark.llm.common import keyed, stored, table

CAPACITY = 2048
BLOCK_ROWS = 8192  # pieces packed together, on average

_PACKED = "doc_id long, source string, piece int, start long, n_tokens int, bin_id string, bin_offset int"


def copy_group(text: Column) -> Column:
    """Equal for texts that differ in case, spacing and punctuation only."""
    return F.xxhash64(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+", " "))


def pack(sizes: list[int], sources: list, groups: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece.

    Of bins that fit equally well the one opened first is taken. Bins with the most common
    source are kept apart, so that its pieces do not walk over them.
    """
    many_sources = [s for s, n in Counter(sources).most_common() if n > 1]
    many_groups = [g for g, n in Counter(groups).items() if n > 1]
    source_bit = {s: 1 << i for i, s in enumerate(many_sources)}
    group_bit = {g: 1 << i for i, g in enumerate(many_groups)}
    common = many_sources[0] if many_sources else object()
    used, source_bits, group_bits = [], [], []
    order: tuple[list, list] = ([], [])  # (left, bin) without and with the most common source
    placed = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, source, group = sizes[i], source_bit.get(sources[i], 0), group_bit.get(groups[i], 0)
        best = None
        for side in (0,) if sources[i] == common else (0, 1):
            bins = order[side]
            for at in range(bisect_left(bins, (size, -1)), len(bins)):
                if best is not None and bins[at] >= best[0]:
                    break
                number = bins[at][1]
                if not (source_bits[number] & source or group_bits[number] & group):
                    best = (bins[at], side, at)
                    break
        if best is None:
            number = len(used)
            used.append(0)
            source_bits.append(0)
            group_bits.append(0)
            side = 0
        else:
            (_, number), side, at = best
            del order[side][at]
        placed[i] = (number, used[number])
        used[number] += size
        source_bits[number] |= source
        group_bits[number] |= group
        if used[number] < capacity:
            insort(order[1 if sources[i] == common else side], (capacity - used[number], number))
    return placed


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, group: Column | None = None, clusters: DataFrame | None = None
) -> DataFrame:
    """doc_id, source, piece, start, n_tokens, bin_id, bin_offset of every piece of every document.

    Tokens are words between white space. A document longer than a bin is cut into full
    pieces, each a bin of its own, and a rest, which is packed. Null and empty texts have no
    piece. Rows that repeat id and text are one document; a null source is one source. Copies
    are documents of one cluster by ``clusters`` (doc_id, _key, component_id), where a document
    without a component is alone, or else by ``group``, by default texts alike but for case,
    spacing and punctuation.
    """
    group = F.lit(0).cast("long") if clusters is not None else copy_group(F.col("text")) if group is None else group
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long")
    listed = keyed(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), tokens.alias("tokens"), group.alias("copies"))
    listed = listed.where("tokens > 0").groupBy("doc_id", "_key").agg(*[F.min(c).alias(c) for c in ("source", "tokens", "copies")])
    if clusters is not None:
        known = clusters.groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_own")).agg(F.min("component_id").alias("component"))
        listed = listed.join(known, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_own")), "left")
        listed = listed.select("doc_id", "_key", "source", "tokens", F.coalesce("component", "_key").alias("copies"))
    listed = stored(listed, "bestfit-sizes")
    full = listed.where(F.col("tokens") >= capacity).select(
        "doc_id", "_key", "source", F.explode(F.sequence(F.lit(0), F.expr(f"cast(tokens div {capacity} AS int) - 1"))).alias("piece")
    ).select(
        "doc_id", "source", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).alias("n_tokens"),
        F.concat_ws("-", F.lit("full"), "doc_id", F.hex("_key"), "piece").alias("bin_id"), F.lit(0).alias("bin_offset"),
    )
    rest = listed.where(F.col("tokens") % capacity > 0).select(
        "doc_id", "_key", "source", "copies", F.expr(f"cast(tokens div {capacity} AS int)").alias("piece"),
        F.expr(f"cast(tokens % {capacity} AS int)").alias("n_tokens"), "tokens",
    )
    blocks = rest.agg(F.ceil(F.count("*") / block_rows).alias("n")).scalar()
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("_key", "doc_id"), blocks))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "_key"], ascending=[False, True, True], na_position="first")
        bins = pack(part["n_tokens"].tolist(), part["source"].tolist(), part["copies"].tolist(), capacity)
        return pd.DataFrame({
            "doc_id": part["doc_id"], "source": part["source"], "piece": part["piece"], "start": part["tokens"] - part["n_tokens"],
            "n_tokens": part["n_tokens"], "bin_id": [f"block-{b}-{number}" for b, (number, _) in zip(part["block"], bins)],
            "bin_offset": [offset for _, offset in bins],
        })

    packed = dealt.groupBy("block").applyInPandas(run, _PACKED)
    return full.unionByName(packed)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, clusters=simhash.near_duplicates(docs))
