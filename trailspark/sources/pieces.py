"""Records of files that no task can hold: cut at closing braces, put together by carried state.

A file is read with ``}`` as its line end, so that any byte range of it is some task's work, even
of a file that is a single line. Whether a fragment begins inside a string, and how deep, follows
from all fragments before it. Fragments are therefore gathered, in the task that reads them, into
chunks of some thousand; quotes and brackets are summed inside each chunk, for both ways it may
begin, then over the chunks of a file (one narrow row each). With what a chunk begins in, it is
cut on its own: an array's element ends where the depth is one again outside strings; other files
are cut into lines. Only what lies before the first and behind the last cut of a chunk is put
together with that of its neighbours. Nothing of a file but its quote and bracket counts meets in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.parsing import closed, only
from trailspark.session import scratch_path

_SOURCE = ["_source_path", "_source_file", "_source_bytes"]
_FILE = ["file_path", "file_name", "file_size"]
COMPRESSED_NAME = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
_SPACE = " \t\n\x0b\f\r"  # the characters of \s
_CHUNK_BITS = 11  # 2,048 fragments to a chunk
_PART = 1024  # a longer fragment counts as several, so a chunk is never more than some megabytes


def _number_of(text: str, *characters: str) -> Column:
    bare = F.col(text)
    for character in characters:
        bare = F.replace(bare, F.lit(character), F.lit(""))
    return F.octet_length(text) - F.octet_length(bare)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _fragments(text: DataFrame) -> DataFrame:
    """One row per stretch up to a closing brace, with its counts; a long one in parts, the first with the counts.

    ``outside`` and ``inside`` are how much deeper the nesting is behind it, if it begins outside
    or inside a string. The last stretch of a file, too, gets a brace, and may lose it again.
    """
    value = F.col("value")
    # An escaped quote ends no string.
    bare = F.when(F.contains(value, F.lit("\\")), F.regexp_replace(value, r"\\[\s\S]", "")).otherwise(value)
    blank_end = F.rtrim(value, F.lit(_SPACE))
    rows = text.select(
        *[F.col(f"_metadata.{name}").alias(name) for name in _FILE], F.col("_metadata.file_block_start").alias("block"),
        bare.alias("bare"), F.concat(value, F.lit("}")).alias("part"), ((blank_end == "") | blank_end.endswith("]")).alias("open_end"),
    )
    # Columns of their own: steps used more than once would be worked out again at each use.
    strings = '"[^"]*"?'
    rows = rows.select(
        *_FILE, "block", "part", "open_end", _number_of("bare", '"').alias("quotes"), F.regexp_replace("bare", strings, "").alias("out_text"),
        F.regexp_replace(F.concat(F.lit('"'), "bare"), strings, "").alias("in_text"),
    )

    def depth(text: str, first: int) -> Column:
        closing = F.when(F.col("quotes") % 2 == first, F.lit(1)).otherwise(F.lit(0))
        return _number_of(text, "[", "{") - _number_of(text, "]") - closing

    octets = F.octet_length("part")
    parts = F.when(octets <= _PART, F.array("part")).otherwise(
        F.regexp_extract_all(F.col("part"), F.lit(rf"[\s\S]{{1,{_PART}}}"), F.lit(0))
    )
    rows = rows.select(
        *_FILE, "block", "open_end", "quotes", depth("out_text", 0).alias("outside"), depth("in_text", 1).alias("inside"),
        octets.alias("octets"), F.posexplode(parts).alias("at", "part"),
    )
    counts = [F.when(F.col("at") == 0, F.col(name)).otherwise(F.lit(0)).alias(name) for name in ("quotes", "outside", "inside", "octets")]
    return rows.select(*_FILE, "block", "part", *counts, F.col("part").endswith("}").alias("ends"), "open_end")


def _chunks(text: DataFrame) -> DataFrame:
    """Runs of fragments of one byte range, stored, each with its text in ``parts`` and its sums."""
    names = ["part", "quotes", "outside", "inside", "octets", "ends", "open_end"]
    rows = _fragments(text).withColumn("id", F.monotonically_increasing_id())
    chunk = F.shiftright("id", _CHUNK_BITS).alias("chunk")
    runs = rows.groupBy(chunk, "block", *_FILE).agg(F.sort_array(F.collect_list(F.struct("id", *names))).alias("run"))
    counts = F.transform("run", lambda x: F.struct(*[x[c].alias(c) for c in ("quotes", "outside", "inside", "ends")]))
    chunks = runs.select(
        *_FILE, "block", F.col("run")[0]["id"].alias("id"), F.transform("run", lambda x: x["part"]).alias("parts"), counts.alias("counts"),
        F.aggregate("run", F.lit(0).cast("long"), lambda n, x: n + x["octets"]).alias("octets"),
        F.element_at("run", -1)["open_end"].alias("open_end"),
    )
    zero = F.lit(0).cast("long")
    sums = F.aggregate(
        "counts", F.struct(zero.alias("quotes"), zero.alias("outside"), zero.alias("inside")),
        lambda a, x: F.struct(
            (a["quotes"] + x["quotes"]).alias("quotes"),
            (a["outside"] + F.when(a["quotes"] % 2 == 0, x["outside"]).otherwise(x["inside"])).alias("outside"),
            (a["inside"] + F.when(a["quotes"] % 2 == 0, x["inside"]).otherwise(x["outside"])).alias("inside"),
        ),
    )
    head = F.nullif(F.substring(F.ltrim(F.array_join("parts", ""), F.lit(_SPACE)), 1, 1), F.lit(""))
    return _stored(chunks.withColumns({"sums": sums, "head": head}).select(
        *_FILE, "block", "id", "parts", "counts", "sums.*", "octets", "open_end", "head"
    ), "chunks")


def _in_file():
    return Window.partitionBy("file_path").orderBy("block", "id")


def _sum_before(name: str) -> Column:
    before = _in_file().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(before), F.lit(0).cast("long"))


def _states(chunks: DataFrame) -> DataFrame:
    """Of each chunk what it begins in: ``odd`` inside a string, ``depth``; whether its file is an array; ``last``, ``braced``."""
    rows = chunks.select("file_path", "file_size", "block", "id", "quotes", "outside", "inside", "octets", "open_end", "head")
    rows = rows.withColumn("odd", _sum_before("quotes") % 2)
    rows = rows.withColumn("d", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    every = _in_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The last fragment has no brace behind it unless the bytes say so; of a compressed file they do not.
    full = F.when(F.col("file_path").rlike(COMPRESSED_NAME), ~F.last("open_end").over(every)).otherwise(
        F.sum("octets").over(every) == F.col("file_size")
    )
    last = F.lead("id").over(_in_file()).isNull()
    return rows.select(
        "id", "odd", _sum_before("d").alias("depth"), F.coalesce(F.first("head", True).over(every) == "[", F.lit(False)).alias("is_array"),
        last.alias("last"), (~last | full).alias("braced"),
    )


def _cut(chunks: DataFrame) -> DataFrame:
    """Chunks at the ends of records, stored: ``inner`` are whole records, ``first`` and ``final`` what lies around them.

    ``steps`` is the number of cuts. Without one there is only ``first``.
    """
    begin = F.struct(F.col("odd"), F.col("depth"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(a: Column, x: Column) -> Column:
        odd = (a["odd"] + x["quotes"]) % 2
        depth = a["depth"] + F.when(a["odd"] == 0, x["outside"]).otherwise(x["inside"])
        at = a["at"] + 1
        ended = x["ends"] & (odd == 0) & (depth == 1)
        return F.struct(
            odd.alias("odd"), depth.alias("depth"), at.alias("at"), F.when(ended, F.array_append(a["ends"], at)).otherwise(a["ends"]).alias("ends")
        )

    # The last fragment of a file ends nothing: what follows the last cut is judged together.
    ends = F.filter(F.aggregate("counts", begin, step, lambda a: a["ends"]), lambda e: ~F.col("last") | (e < F.size("parts")))
    bounds = F.concat(F.array(F.lit(0)), F.when(F.col("is_array"), ends).otherwise(F.array().cast("array<int>")))
    rows = chunks.drop("quotes", "outside", "inside", "octets", "open_end", "head").join(_states(chunks), "id").withColumn("bounds", bounds)
    kept = F.when(F.col("braced"), F.col("parts")).otherwise(F.concat(
        F.slice("parts", F.lit(1), F.size("parts") - 1), F.array(F.regexp_replace(F.element_at("parts", -1), r"\}\z", ""))
    ))
    rows = rows.withColumn("parts", kept)
    elements = F.transform("bounds", lambda b, i: F.array_join(
        F.slice("parts", b + 1, F.coalesce(F.get("bounds", i + 1), F.size("parts")) - b), ""
    ))
    lines = F.split(F.array_join("parts", ""), "\n", -1)
    rows = rows.withColumn("pieces", F.when(F.col("is_array"), elements).otherwise(lines)).withColumn("steps", F.size("pieces") - 1)
    return _stored(rows.select(
        *_FILE, "block", "id", "is_array", "last", "steps", F.col("pieces")[0].alias("first"),
        F.slice("pieces", F.lit(2), F.greatest(F.col("steps") - 1, F.lit(0))).alias("inner"),
        F.when(F.col("steps") > 0, F.element_at("pieces", -1)).alias("final"),
    ), "pieces")


def _elements(text: Column, last: Column) -> Column:
    """The elements in a stretch of an array from the end of one object to the end of the next."""
    body = F.regexp_replace(text, r"^\s*[\[,]", "")
    ended = body.rlike(r"\]\s*$")
    inner = F.when(~last, body).when(ended, F.regexp_replace(body, r"\]\s*$", "")).otherwise(F.concat(F.lit("["), body))
    several = only(F.from_json(closed(F.concat(F.lit("["), inner, F.lit("]"))), "array<array<string>>"))
    return (
        F.when(inner.rlike(r"^\s*$"), F.array().cast("array<string>"))
        .when(~last & inner.rlike(r"^\s*\{"), F.array(F.trim(inner)))
        .otherwise(F.coalesce(F.transform(several, lambda x: F.coalesce(x, F.lit("null"))), F.array(inner)))
    )


def _records(whole: DataFrame) -> DataFrame:
    """Records in whole stretches; a null stretch is a null record."""
    text = F.col("text")
    raws = F.when(F.col("is_array") & text.isNotNull(), _elements(text, F.col("last"))).otherwise(F.array("text"))
    return whole.select(*_FILE, F.explode(raws).alias("raw")).where(F.col("raw").isNull() | ~F.col("raw").rlike(r"^\s*$"))


def piece_records(text: DataFrame, provenance: list[Column], max_bytes: int) -> DataFrame:
    """One record per array element, or per line of files that do not open with a bracket.

    ``text`` is a file source with ``}`` as line end. Array elements that are no objects come
    out as they are. What follows the last whole element of a broken array is one record, to be
    rejected; so is, as null, a record of more than ``max_bytes``, which no row can hold. Elements
    that are no objects count to the record of the object behind them.
    """
    cut = _cut(_chunks(text))
    fits = F.octet_length("text") <= max_bytes
    inner = cut.select(*_FILE, "is_array", F.explode("inner").alias("text")).select(
        *_FILE, "is_array", F.when(fits, F.col("text")).alias("text"), F.lit(False).alias("last")
    )
    begun = cut.select("id", _sum_before("steps").alias("begun"))
    rows = cut.select(*_FILE, "block", "id", "is_array", "last", "steps", "first", "final").join(begun, "id")
    none = F.col("steps") == 0
    edge = F.struct(F.col("begun").alias("record"), F.col("first").alias("part"), (F.col("last") & none).alias("last"))
    other = F.struct((F.col("begun") + F.col("steps")).alias("record"), F.col("final").alias("part"), F.col("last"))
    parts = rows.select(*_FILE, "block", "id", "is_array", F.inline(F.when(none, F.array(edge)).otherwise(F.array(edge, other))))
    record = ["file_path", "record"]
    sizes = parts.groupBy(*record).agg(F.sum(F.octet_length("part").cast("long")).alias("size"))
    huge = sizes.where(F.col("size") > max_bytes)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "id", "part"))), lambda x: x["part"])
    joined = parts.join(huge, record, "left_anti").groupBy(*_FILE, "is_array", "record").agg(
        F.array_join(ordered, "").alias("text"), F.max("last").alias("last")
    )
    rejected = parts.join(huge, record, "left_semi").select(*_FILE, "record").distinct()
    records = _records(inner).unionByName(_records(joined)).unionByName(rejected.select(*_FILE, F.lit(None).cast("string").alias("raw")))
    return records.withColumn("_metadata", F.struct(*_FILE)).select(*provenance, "raw")
