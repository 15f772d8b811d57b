"""Document fingerprints: a Merkle tree of sections (between blank lines), paragraphs (lines) and leaves.

A leaf is up to four words that end with a sentence, so that leaves do not move when a text
changes elsewhere; of short lines, whose words are few, it is two neighbouring characters. The
fingerprint is the tree as a text: the root, below it the hash of each section, below that the
hash of each paragraph and its leaves. Two fingerprints are compared from the root down: nodes of
equal hash are alike with all below them, and only nodes that differ are descended into. Equal
nodes are matched as often as they come. A node's hash holds the order of its children, so what
is moved leaves its parent unlike. Everything is built of SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.llm.common import NO_ID, keyed, stored, table

#: Up to three words without a sentence end, then one word; never over a line break.
LEAF = r"(?:\S*[^\s.!?][ \t\x0B\f\r]+){0,3}\S+"
SHORT = 24  # characters of a line up to which leaves are pairs of characters
_ROOT, _NODE, _LEAF_DIGITS = 32, 16, 8


def paragraph_hashes(section: Column) -> Column:
    return F.transform(F.split(section, "\n", -1), lambda line: F.sha2(line, 256))


def section_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.sha2(F.concat_ws(",", paragraph_hashes(s)), 256))


def root_hash(text: Column) -> Column:
    return F.sha2(F.concat_ws(",", section_hashes(text)), 256)


def leaf_digits(line: Column) -> Column:
    """The leaf hashes of a paragraph in hex, eight digits each."""
    pairs = F.when(F.char_length(line) < 2, F.filter(F.array(line), lambda x: x != "")).otherwise(
        F.transform(F.sequence(F.lit(1), F.char_length(line) - 1), lambda i: F.substring(line, i, F.lit(2)))
    )
    words = F.when(F.char_length(line) <= SHORT, pairs).otherwise(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)))
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(F.hash(w).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), _LEAF_DIGITS, "0")), "")


def fingerprint(text: Column) -> Column:
    """``root:section/section``; a section is ``hash=paragraph;paragraph``, a paragraph ``hash`` and its leaves.

    Equal for equal texts only: the root is 128 bits over everything.
    """
    def paragraph(line: Column) -> Column:
        return F.concat(F.substring(F.sha2(line, 256), 1, _NODE), leaf_digits(line))

    def section(part: Column) -> Column:
        below = F.array_join(F.transform(F.split(part, "\n", -1), paragraph), ";")
        return F.concat(F.substring(F.sha2(F.concat_ws(",", paragraph_hashes(part)), 256), 1, _NODE), F.lit("="), below)

    sections = F.array_join(F.transform(F.split(text, "\n\n", -1), section), "/")
    return F.concat(F.substring(root_hash(text), 1, _ROOT), F.lit(":"), sections)


def _sections(print_: Column) -> Column:
    return F.split(F.substring(print_, _ROOT + 2, 1 << 30), "/", -1)


def _children(nodes: Column, of) -> Column:
    """What is below the nodes; the number of a repeated node is taken off first."""
    return F.flatten(F.transform(nodes, lambda node: of(F.substring_index(node, "#", 1))))


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring(section, _NODE + 2, 1 << 30), ";", -1)


def _leaves(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.substring(paragraph, _NODE + 1, 1 << 30), F.lit(f".{{{_LEAF_DIGITS}}}"), F.lit(0))


def _begins(ordered: str) -> Column:
    """Where in a sorted column each run of equal nodes begins."""
    nodes = F.col(ordered)
    return F.filter(F.sequence(F.lit(0), F.size(nodes) - 1), lambda i: (i == 0) | (F.get(nodes, i) != F.get(nodes, i - 1)))


def _numbered(ordered: str, begins: str) -> Column:
    """The nodes of a sorted column, the second and later equal ones with their number, so that all are different."""
    nodes, starts = F.col(ordered), F.col(begins)

    def run(at: Column, k: Column) -> Column:
        copies = F.sequence(F.lit(1), F.coalesce(F.get(starts, k + 1), F.size(nodes)) - at)
        return F.transform(copies, lambda n: F.when(n == 1, F.get(nodes, at)).otherwise(F.concat(F.get(nodes, at), F.lit("#"), n.cast("string"))))

    return F.flatten(F.transform(starts, run))


def with_unlike(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``_unlike, how many nodes of both fingerprints have no equal in the other, and ``name``_edited.

    The second is the number of paragraphs of ``b`` without an equal. Descends from unequal roots;
    only a level with repeated nodes is sorted.
    """
    left, right = f"_{name}_a", f"_{name}_b"
    nodes = {left: _sections(F.col(a)), right: _sections(F.col(b))}
    unlike = F.lit(2)
    for below in (_paragraphs, _leaves, None):
        df = df.withColumns({x: F.when(F.col(a) != F.col(b), nodes[x]).otherwise(F.array().cast("array<string>")) for x in nodes})
        df = df.withColumns({f"{x}_sorted": F.when(F.size(F.array_distinct(x)) < F.size(x), F.sort_array(x)) for x in nodes})
        df = df.withColumns({f"{x}_begins": _begins(f"{x}_sorted") for x in nodes})
        df = df.withColumns({f"{x}_own": F.coalesce(_numbered(f"{x}_sorted", f"{x}_begins"), x) for x in nodes})
        df = df.withColumns({left: F.array_except(f"{left}_own", f"{right}_own"), right: F.array_except(f"{right}_own", f"{left}_own")})
        counts = {f"{name}_n": F.size(left) + F.size(right)}
        if below is _leaves:
            counts[f"{name}_edited"] = F.size(right).cast("long")
        if below:
            nodes = {x: _children(F.col(x), below) for x in nodes}
        level = {_paragraphs: "sections", _leaves: "paragraphs", None: "leaves"}[below]
        df = df.withColumns({k if k.endswith("edited") else f"{k}_{level}": v for k, v in counts.items()})
        df = df.drop(*[f"{x}_{part}" for x in nodes for part in ("sorted", "begins", "own")])
        unlike = unlike + F.col(f"{name}_n_{level}")
    df = df.withColumn(f"{name}_unlike", F.when(F.col(a) == F.col(b), F.lit(0)).otherwise(unlike).cast("long"))
    return df.drop(left, right, *[f"{name}_n_{level}" for level in ("sections", "paragraphs", "leaves")])


def n_nodes(print_: Column) -> Column:
    """Nodes of the tree: the root, sections, paragraphs and leaves; what is no mark and no hash is leaves."""
    length = F.char_length(print_)
    sections = F.size(_sections(print_))
    paragraphs = sections + length - F.char_length(F.translate(print_, ";", ""))
    # A root and its mark; a hash, "=" and, but for the first, "/" a section; a hash and, but for a section's first, ";" a paragraph.
    digits = length - (_ROOT + 1) - (sections * (_NODE + 2) - 1) - (paragraphs * (_NODE + 1) - sections)
    return (1 + sections + paragraphs + digits / _LEAF_DIGITS).cast("long")


def likeness(a: str, b: str, unlike: str) -> Column:
    """The share of both trees' nodes that are alike: 1 for equal roots only, 0 if none is."""
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(1.0 - F.col(unlike) / (n_nodes(F.col(a)) + n_nodes(F.col(b))))


def tree_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, section, paragraph, hash: a row for each paragraph, section (paragraph null) and root.

    Null texts are empty: one empty paragraph. Numbers count from 0.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    sections = base.select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("section", "part"))
    none = F.lit(None).cast("int")
    return (
        base.select("doc_id", none.alias("section"), none.alias("paragraph"), root_hash(F.col("text")).alias("hash"))
        .unionByName(sections.select("doc_id", "section", none.alias("paragraph"), F.sha2(F.concat_ws(",", paragraph_hashes(F.col("part"))), 256).alias("hash")))
        .unionByName(sections.select("doc_id", "section", F.posexplode(paragraph_hashes(F.col("part"))).alias("paragraph", "hash")))
    )


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, section, paragraph of the paragraphs of ``after`` that ``before`` lacks anywhere.

    Documents whose roots agree are not descended into; new documents count as wholly edited.
    """
    old, new = tree_nodes(before), tree_nodes(after)
    same = old.where("section IS NULL").select("doc_id", "hash")
    open_ids = new.where("section IS NULL").join(same, ["doc_id", "hash"], "left_anti").select("doc_id").distinct()
    known = old.where("paragraph IS NOT NULL").select("doc_id", "hash").distinct()
    return (
        new.where("paragraph IS NOT NULL").join(open_ids, "doc_id", "left_semi")
        .join(known, ["doc_id", "hash"], "left_anti").select("doc_id", "section", "paragraph")
    )


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, n, next_id, next_key): the next document in ascending (doc_id, _key), the first after the last.

    Ids are dealt out by range and each range finds its own neighbours; only the first id of
    each range, one row a partition, meets in one place.
    """
    ids = keyed(docs, F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).distinct()
    ranged = ids.repartitionByRange("doc_id", "_key").withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "merkle-order")
    at = F.struct("doc_id", "_key")
    firsts = ranged.groupBy("_range").agg(F.min(at).alias("first"))
    order = Window.orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        "_range", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("_after")
    )
    inside = Window.partitionBy("_range").orderBy("doc_id", "_key")
    following = ranged.withColumn("_next", F.lead(at).over(inside)).join(after, "_range")
    following = following.withColumn("_next", F.coalesce("_next", "_after"))
    return following.select("doc_id", "_key", "n", F.col("_next.doc_id").alias("next_id"), F.col("_next._key").alias("next_key"))


def with_first_edit(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds where two fingerprints first differ in order, ``section.paragraph`` from 0; null if they are equal."""
    x, y = f"_{name}_x", f"_{name}_y"

    def first_unlike() -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
        return F.get(F.filter(at, lambda i: ~F.get(F.col(x), i).eqNullSafe(F.get(F.col(y), i))), F.lit(0))

    # Lists are columns of their own: inside a lambda an expression would be worked out for every element.
    differ = F.col(a) != F.col(b)
    df = df.withColumns({side: F.when(differ, _sections(F.col(of))) for side, of in ((x, a), (y, b))})
    df = df.withColumn(f"_{name}_at", first_unlike())
    none = F.array().cast("array<string>")
    df = df.withColumns({side: F.when(differ, F.coalesce(_paragraphs(F.get(F.col(side), F.col(f"_{name}_at"))), none)) for side in (x, y)})
    df = df.withColumn(name, F.when(differ, F.concat_ws(".", f"_{name}_at", first_unlike())))
    return df.drop(x, y, f"_{name}_at")


def _compiled_apart(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions; what is above and below is generated as methods of its own.

    One method over all steps would be too large for the JVM to compile, and slow. There are never
    so many partitions that any are merged.
    """
    return df.coalesce(1 << 24)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_edit, edited_paragraphs.

    The edited text is the document with its last half replaced by the beginning of the next
    document. ``first_edit`` is the first branch that differs, ``edited_paragraphs`` how many
    paragraphs of the edited text the document has not. Null texts are empty; rows that repeat
    id and text are one document; a null doc_id counts as the least; equal ids with unequal
    texts follow each other in a fixed order. A single document is its own successor. No rows
    give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    # Ids without nulls: one exchange of the texts then serves the repeats and both joins.
    numbered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    whole = keyed(numbered, text.alias("text")).dropDuplicates(["doc_id", "_key"])
    order = successors(numbered)
    to = order.select(
        F.col("doc_id").alias("to_id"), F.col("_key").alias("to_key"), "next_id", "next_key",
        F.expr("cast(n div 2 AS int)").alias("taken"), F.expr("cast(n - n div 2 AS int)").alias("left_over"),
    )
    shipped = whole.join(to, (F.col("doc_id") == F.col("next_id")) & (F.col("_key") == F.col("next_key"))).select(
        "to_id", "to_key", "left_over", F.expr("left(text, taken)").alias("head"), fingerprint(F.col("text")).alias("next_print"),
    )
    both = whole.join(shipped, (F.col("doc_id") == F.col("to_id")) & (F.col("_key") == F.col("to_key"))).select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", F.concat(F.expr("left(text, left_over)"), F.col("head")).alias("edited"), "next_print",
    )
    prints = both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print",
    )
    compared = with_unlike(_compiled_apart(prints), "fingerprint", "edited_fingerprint", "edit")
    compared = with_unlike(_compiled_apart(compared), "fingerprint", "next_print", "next")
    compared = with_first_edit(_compiled_apart(compared), "fingerprint", "edited_fingerprint", "first_edit")
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", "edit_unlike").alias("near_edited"), likeness("fingerprint", "next_print", "next_unlike").alias("near_next"),
        "first_edit", F.col("edit_edited").alias("edited_paragraphs"),
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
