"""Line dedup: later copies of repeated line runs are deleted, found in a suffix array of lines.

The corpus is one sequence of line ids with document ends. Suffixes are ranked by prefix
doubling: a rank is the number of smaller suffixes, and each round orders the members of a rank
by the rank 2^k lines further on. Only suffixes whose rank is still shared take part in a
round, so the work falls with the repeated part of the corpus, and rounds end at the longest
repeat. Neighbours in the array get their longest common prefix (LCP) from the ranks of all
rounds. Each suffix then gets the longest run it shares with any earlier place of the corpus,
from the LCP intervals around it; the array is cut into chunks of bounded size, and what reaches
over a chunk's edge is a short list per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.llm.common import NO_ID, same_document, smaller_before, stored, table, text_key

MIN_WORDS = 50  # a run is deleted from this many words on
CHUNK = 1 << 16  # ranks of the suffix array one task looks at
BLOCK_CHUNKS = 256  # chunks of one line that are scanned together

_AT = ["doc", "key", "pos"]


def corpus_lines(docs: DataFrame) -> DataFrame:
    """doc, key, pos, rest (lines from here to the end) and two hashes of each line of each document."""
    texts = docs.where("text <> ''").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("key"),
        F.split("text", "\n", -1).alias("lines"),
    )
    rows = texts.select("doc", "key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    return rows.select(*_AT, (F.col("n_lines") - F.col("pos")).alias("rest"), F.xxhash64("line").alias("id"), F.xxhash64(F.lit("2"), "line").alias("id2"))


def suffix_array(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the suffixes whose first line is repeated: (final, towers).

    final has (doc, key, pos, rest, rank); equal ranks are equal suffixes. towers has rest and
    ``ranks``: entry k is equal for suffixes that share 2^k lines, or all they have.
    """
    ids = stored(lines, "lines-ids")
    counts = ids.groupBy("id", "id2").agg(F.count("*").alias("n"))
    # Any order of lines serves; theirs is by hash, in 2^16 buckets of the hash range.
    first = smaller_before(
        counts.select("id", "id2", "n", F.lit(0).alias("one"), F.struct("id", "id2").alias("both")), ["one"], "both", F.shiftright("id", 48)
    ).select("id", "id2", F.col("before").alias("rank"), "n")
    document = Window.partitionBy("doc", "key")
    order = document.orderBy("pos")
    ranked = ids.join(first, ["id", "id2"]).select(
        *_AT, "rest", "rank", "n", F.lag("n").over(order).alias("n_before"), F.lag("pos").over(order).alias("pos_before")
    )
    # Repeated rows of a document are one; a rank is only ever asked for behind a repeated line.
    ranked = ranked.where("(pos_before IS NULL OR pos_before <> pos) AND (n > 1 OR n_before > 1)")
    state = stored(ranked.select(*_AT, "rest", "rank", (F.col("n") > 1).alias("active")), "lines-rank-0")
    towers = state.where("active").select(*_AT, "rest", "rank", F.lit(0).alias("level"))
    final = state.limit(0).select(*_AT, "rest", "rank")
    level = 0
    while not state.where("active").isEmpty():
        step = 1 << level
        ahead = F.max("rank").over(order.rangeBetween(step, step))
        live = F.max("active").over(document)  # the others of these documents are still asked for
        paired = state.withColumn("next", F.coalesce(ahead, F.lit(-1))).withColumn("live", live).where("live").drop("live")
        paired = stored(paired, f"lines-pair-{level}")
        active = paired.where("active")
        moved = smaller_before(
            active.groupBy("rank", "next").agg(F.count("*").alias("n")), ["rank"], "next", F.shiftright("next", 16)
        ).select("rank", "next", (F.col("rank") + F.col("before")).alias("new"), "n")
        level += 1
        now = active.join(moved, ["rank", "next"]).select(
            *_AT, "rest", F.col("new").alias("rank"), ((F.col("n") > 1) & (F.col("rest") >= (1 << level))).alias("active"), "n"
        )
        rest = paired.where("NOT active").select(*_AT, "rest", "rank", "active", F.lit(None).cast("long").alias("n"))
        both = stored(now.unionByName(rest), f"lines-rank-{level}")
        towers = towers.unionByName(both.where("n > 1").select(*_AT, "rest", "rank", F.lit(level).alias("level")))
        final = final.unionByName(both.where("n IS NOT NULL AND NOT active").select(*_AT, "rest", "rank"))
        state = both.drop("n")
    ranks = F.transform(F.sort_array(F.collect_list(F.struct("level", "rank"))), lambda x: x["rank"])
    return final, stored(towers.groupBy(*_AT).agg(F.max("rest").alias("rest"), ranks.alias("ranks")), "lines-towers")


def neighbours(final: DataFrame, chunk: int) -> DataFrame:
    """(chunk, rank, doc, key, pos, rest, p_doc, p_key, p_pos): each distinct suffix at its first
    place, with the suffix before it in the array."""
    at = F.struct(*_AT, "rest")
    classes = final.groupBy("rank").agg(F.min(at).alias("at")).withColumn("chunk", F.expr(f"rank div {chunk}"))
    classes = stored(classes, "lines-classes")
    lasts = classes.groupBy("chunk").agg(F.max_by("at", "rank").alias("last"))
    # Chunks are dealt out by range; of each range only its last row meets the others'.
    lasts = stored(lasts.repartitionByRange("chunk").withColumn("_range", F.spark_partition_id()), "lines-lasts")
    ends = lasts.groupBy("_range").agg(F.max_by("last", "chunk").alias("end"))
    ends = ends.select("_range", F.lag("end").over(Window.orderBy("_range")).alias("end"))
    lasts = lasts.withColumn("edge", F.lag("last").over(Window.partitionBy("_range").orderBy("chunk"))).join(ends, "_range").select(
        "chunk", F.coalesce("edge", "end").alias("edge")
    )
    inside = F.lag("at").over(Window.partitionBy("chunk").orderBy("rank"))
    return classes.withColumn("inside", inside).join(lasts, "chunk").select(
        "chunk", "rank", "at.*", *[F.coalesce(F.col(f"inside.{c}"), F.col(f"edge.{c}")).alias(f"p_{c}") for c in _AT]
    )


def common_prefixes(pairs: DataFrame, towers: DataFrame) -> DataFrame:
    """Adds ``lcp`` to neighbours: the lines a suffix shares with the one before it."""
    pairs = stored(pairs, "lines-pairs")
    names = ["chunk", "rank", *_AT, "rest", "p_doc", "p_key", "p_pos"]
    state = pairs.withColumn("lcp", F.lit(0))
    found, step = state.select("rank", "lcp"), 0
    mine = towers.select(*[F.col(c).alias(f"t_{c}") for c in _AT], F.col("rest").alias("t_rest"), F.col("ranks").alias("mine"))
    other = towers.select(*[F.col(c).alias(f"o_{c}") for c in _AT], F.col("ranks").alias("other"))
    while True:
        tested = state.join(
            mine, (F.col("doc") == F.col("t_doc")) & (F.col("key") == F.col("t_key")) & (F.col("pos") + F.col("lcp") == F.col("t_pos"))
        ).join(
            other, (F.col("p_doc") == F.col("o_doc")) & (F.col("p_key") == F.col("o_key")) & (F.col("p_pos") + F.col("lcp") == F.col("o_pos"))
        )
        same = F.size(F.filter(F.zip_with("mine", "other", lambda a, b: a == b), lambda e: e))
        tested = tested.withColumn("same", same).where("same > 0")
        gain = F.least(F.expr("shiftleft(1, same - 1)"), F.col("t_rest"))
        # A pair without a match here is at its end; one that reached the end of a text, too.
        tested = stored(
            tested.select(*names, (F.col("lcp") + gain).alias("lcp"), (gain < F.col("t_rest")).alias("more")), f"lines-lcp-{step}"
        )
        found = found.unionByName(tested.select("rank", "lcp"))
        state = tested.where("more").drop("more")
        step += 1
        if state.isEmpty():
            break
    return pairs.join(found.groupBy("rank").agg(F.max("lcp").alias("lcp")), "rank").select("chunk", "rank", *_AT, "rest", "lcp")


def nearest(entries: list[tuple]) -> list[tuple]:
    """Of (lcp, place) in order of distance, those no nearer entry makes useless."""
    out: list[tuple] = []
    for lcp, place in entries:
        if lcp and (not out or place < out[-1][1]):
            out.append((lcp, place))
    return out


def earlier_runs(places: list[tuple], lcps: list[int]) -> list[int]:
    """For each suffix, in array order, the lines it shares with any suffix at an earlier place."""

    def one_side(order: range, link) -> list[int]:
        best, stack = [0] * len(places), []
        for i in order:
            current = link(i)
            while stack and stack[-1][0] > places[i]:
                current = min(current, stack.pop()[1])
            best[i] = current if stack else 0
            stack.append((places[i], best[i]))
        return best

    n = len(places)
    left = one_side(range(n), lambda i: lcps[i])
    right = one_side(range(n - 1, -1, -1), lambda i: lcps[i + 1] if i + 1 < n else 0)
    return [max(a, b) for a, b in zip(left, right)]


_EDGE = "line bigint, chunk bigint, side int, least int, lcp int, doc bigint, key bigint, pos int"
_HUGE = (1 << 31) - 1


def chunk_edges(part: pd.DataFrame) -> pd.DataFrame:
    """What neighbouring chunks have to know: earliest places by LCP, from either edge (side 0
    from the left edge, 1 from the right), under the rank of the edge's first line."""
    part = part.sort_values("rank")
    places, lcps = list(zip(part["doc"], part["key"], part["pos"])), part["lcp"].tolist()
    least, lists = int(min(lcps)), ([], [])
    low = _HUGE
    for lcp, place in zip(lcps, places):
        low = min(low, lcp)
        if not low:
            break
        lists[0].append((low, place))
    low = _HUGE
    for lcp, place in zip(reversed(lcps), reversed(places)):
        lists[1].append((low, place))
        low = min(low, lcp)
        if not low:
            break
    lines = (part["line"].iloc[0], part["line"].iloc[-1])
    rows = [
        (lines[side], part["chunk"].iloc[0], side, least, lcp, *place)
        for side in (0, 1) for lcp, place in nearest(lists[side]) or [(0, (0, 0, 0))]
    ]
    return pd.DataFrame(rows, columns=["line", "chunk", "side", "least", "lcp", "doc", "key", "pos"])


def _listed(part: pd.DataFrame) -> dict[int, tuple[int, dict[int, list]]]:
    """Of edges: (least LCP, entries by side) of each chunk, or of each block of chunks."""
    seen: dict[int, tuple[int, dict[int, list]]] = {}
    for chunk, side, least, lcp, *place in part[["chunk", "side", "least", "lcp", "doc", "key", "pos"]].itertuples(index=False):
        own = seen.setdefault(chunk, (least, {0: [], 1: []}))
        if lcp:
            own[1][side].append((lcp, tuple(place)))
    return seen


def scanned(seen: dict, start: dict[int, list]) -> tuple[list[tuple], dict[int, list]]:
    """(chunk, side, lcp, place) of what lies beyond each chunk's left (0) and right (1) edge, and what lies behind them all.

    ``start`` is what lies beyond the first and the last of them.
    """
    chunks, rows, ends = sorted(seen), [], {}
    for side, order in ((0, chunks), (1, chunks[::-1])):
        context = start.get(side, [])
        for chunk in order:
            rows += [(chunk, side, lcp, *place) for lcp, place in context]
            least, lists = seen[chunk]
            own = sorted(lists[1 - side], key=lambda e: -e[0])
            context = nearest(own + [(min(lcp, least), place) for lcp, place in context])
        ends[side] = context
    return rows, ends


_CONTEXT = ["chunk", "side", "lcp", "doc", "key", "pos"]


def block_edges(part: pd.DataFrame) -> pd.DataFrame:
    """The chunks of a block as if they were one chunk."""
    seen = _listed(part)
    _, ends = scanned(seen, {})
    least, key = min(least for least, _ in seen.values()), (part["line"].iloc[0], part["block"].iloc[0])
    rows = [(*key, 1 - side, least, lcp, *place) for side in (0, 1) for lcp, place in ends[side] or [(0, (0, 0, 0))]]
    return pd.DataFrame(rows, columns=["line", "chunk", "side", "least", "lcp", "doc", "key", "pos"])


def block_contexts(part: pd.DataFrame) -> pd.DataFrame:
    """For the blocks one line's suffixes run through: what lies beyond their edges."""
    out = pd.DataFrame(scanned(_listed(part), {})[0], columns=_CONTEXT)
    out.insert(0, "line", part["line"].iloc[0])
    return out


def edge_contexts(part: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
    """For the chunks of one line and block: what lies beyond their edges, given what does beyond the block's."""
    start: dict[int, list] = {0: [], 1: []}
    for side, lcp, *place in beyond[["side", "lcp", "doc", "key", "pos"]].itertuples(index=False):
        start[side].append((lcp, tuple(place)))
    start = {side: sorted(entries, key=lambda e: -e[0]) for side, entries in start.items()}
    return pd.DataFrame(scanned(_listed(part), start)[0], columns=_CONTEXT)


def chunk_runs(part: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
    """(doc, key, pos, run) of the suffixes of a chunk that share a run with an earlier place."""
    if not len(part):
        return pd.DataFrame({"doc": [], "key": [], "pos": [], "run": []})
    part = part.sort_values("rank")
    rows = [(side, lcp, tuple(place)) for side, lcp, *place in context[["side", "lcp", "doc", "key", "pos"]].itertuples(index=False)]
    left = sorted([(lcp, place) for side, lcp, place in rows if side == 0], key=lambda e: (-e[0], e[1]))
    left = nearest(sorted(left, key=lambda e: (-e[0], [-x for x in e[1]])))
    right = nearest(sorted([(lcp, place) for side, lcp, place in rows if side == 1], key=lambda e: (-e[0], [-x for x in e[1]])))
    places, lcps = list(zip(part["doc"], part["key"], part["pos"])), part["lcp"].tolist()
    far_left = left[::-1]
    before = [place for _, place in far_left]
    links = [0] + [lcp for lcp, _ in far_left[:-1]] if far_left else []
    if far_left:
        lcps[0] = min(lcps[0], far_left[-1][0])
    else:
        lcps[0] = 0
    runs = earlier_runs(before + places + [p for _, p in right], links + lcps + [lcp for lcp, _ in right])
    runs = runs[len(before) : len(before) + len(places)]
    out = pd.DataFrame({"doc": part["doc"], "key": part["key"], "pos": part["pos"], "run": runs})
    return out[out["run"] > 0]


def repeated_runs(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc, key, pos, run): at each line, the longest run of lines that an earlier place has too."""
    final, towers = suffix_array(corpus_lines(docs))
    first_line = towers.select(*_AT, F.col("ranks")[0].alias("line"))
    array = stored(common_prefixes(neighbours(final, chunk), towers).join(first_line, _AT), "lines-array")
    edges = stored(array.groupBy("chunk").applyInPandas(chunk_edges, _EDGE), "lines-edges")
    # A chunk whose edges lie in one line's suffixes is listed once under it, with both sides. The
    # chunks of a very common line are scanned in blocks: first the blocks, then the chunks of each.
    edges = edges.withColumn("block", F.expr(f"chunk div {BLOCK_CHUNKS}"))
    by_block = edges.groupBy("line", "block")
    context = "chunk bigint, side int, lcp int, doc bigint, key bigint, pos int"
    outer = by_block.applyInPandas(block_edges, _EDGE).groupBy("line").applyInPandas(block_contexts, f"line bigint, {context}")
    outer = outer.withColumnRenamed("chunk", "block").groupBy("line", "block")
    contexts = by_block.cogroup(outer).applyInPandas(edge_contexts, context)
    runs = array.groupBy("chunk").cogroup(contexts.groupBy("chunk")).applyInPandas(chunk_runs, "doc bigint, key bigint, pos int, run int")
    # Of equal suffixes, all but the first repeat the whole of it.
    firsts = array.select("rank", F.struct(*_AT).alias("first"))
    later = final.join(firsts, "rank").where(F.struct(*_AT) > F.col("first")).select(*_AT, F.col("rest").alias("run"))
    return runs.unionByName(later)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``text`` less its repeated runs, plus ``_llm_deleted``, the lines deleted.

    A run of whole lines with at least ``min_words`` words that occurs at an earlier place
    (doc_id, text key, line number) is deleted; the first copy stays, also where copies
    overlap. Empty and null texts stay as they are. A null doc_id counts as the least. Rows
    that repeat id and text are one document and get the same text.
    """
    found = repeated_runs(docs, chunk).groupBy("doc", "key").agg(F.collect_list(F.struct("pos", "run")).alias("_llm_runs"))
    runs = found.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), F.col("key").alias("_key"), "_llm_runs")
    joined = same_document(docs, runs, "left")
    at = docs.columns.index("text")
    schema = joined.drop("_llm_runs").withColumn("_llm_deleted", F.lit(0)).schema

    def cut(text: str, found: list[dict]) -> tuple[str, int]:
        lines = text.split("\n")
        words = [0]
        for line in lines:
            words.append(words[-1] + len(line.split()))
        change = [0] * (len(lines) + 1)
        for run in found:
            start, end = run["pos"], run["pos"] + run["run"]
            if words[end] - words[start] >= min_words:
                change[start] += 1
                change[end] -= 1
        kept, covered = [], 0
        for line, delta in zip(lines, change):
            covered += delta
            if not covered:
                kept.append(line)
        return "\n".join(kept), len(lines) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            runs = columns.pop()
            texts, counts = columns[at], [0] * batch.num_rows
            if runs.null_count < len(runs):
                values = texts.to_pylist()
                for i, found in enumerate(runs.to_pylist()):
                    if found:
                        values[i], counts[i] = cut(values[i], found)
                columns[at] = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*batch.schema.names[:-1], "_llm_deleted"])

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated runs; n_chars, where there is one, follows the text.

    A document that loses its last words this way is a copy and goes.
    """
    out = without_repeats(docs, min_words).where("NOT (_llm_deleted > 0 AND trim(BOTH FROM regexp_replace(text, '\\\\s', '')) = '')").drop("_llm_deleted")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "text", F.col("_llm_deleted").alias("deleted_lines"))
