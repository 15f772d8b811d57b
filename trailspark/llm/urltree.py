"""URL filters: explicit rules first, then a tree of path templates per host.

The tree is grown level by level from aggregated paths, never from single pages: segments that
vary (numbers, names with digits) become wildcards, siblings whose labelled share does not differ
from their node's are merged, and a template is judged by its labelled purity, smoothed towards
its host's and that towards all pages'. Levels run to the longest path whose labels are mixed.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import stored, table

#: (verdict, host, path); the longest rule that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEPTH = 6  # segments shown one by one; what follows is one wildcard but for branches that differ
FANOUT = 16  # a node with more children merges those that do not differ under {*} if they have less than 1/16 of its pages
Z_SQUARED = 4.0  # siblings within two standard errors of their node are merged
SMOOTHING = 10.0  # labelled pages the next wider level counts for
LEAST_PURITY = 0.5


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host and path; both are empty for a null url or one without ``://``."""
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumn("host", F.translate(host, ascii_uppercase, ascii_lowercase)).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def typed_path(path: Column) -> Column:
    """The path with variable segments generalised by their form."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    kinds = F.transform(
        parts,
        lambda s: F.when(s.rlike("^[0-9]+$"), F.lit("{n}")).when(s.rlike("[0-9]"), F.lit("{s}")).otherwise(s),
    )
    return F.array_join(kinds, "/")


def templates(paths: DataFrame, depth: int, fanout: int, z_squared: float) -> DataFrame:
    """(host, typed, template, labelled, good) of ``paths`` (host, typed, pages, labelled, good).

    Behind ``depth`` segments a template goes on with {**}. From there only branches whose
    labels differ are named, the end of a path ({$}) being one too; nodes whose labels all
    agree cannot part and are left.
    """
    grown = stored(paths.withColumn("template", F.lit("")), "urltree-0")
    settled = []
    keys = ["host", "template", "segment"]
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "good")]
    length = F.size(F.split("typed", "/"))
    level = 0
    while True:
        level += 1
        segment = F.get(F.split("typed", "/"), F.lit(level - 1))
        if level == depth + 1:
            grown = grown.withColumn("template", F.when((F.col("typed") != "") & (length > depth), F.concat("template", F.lit("/{**}"))).otherwise(F.col("template")))
        elif level > depth:
            segment = F.when(length == level - 1, F.lit("{$}")).otherwise(segment)
        here = grown.withColumn("segment", F.when(F.col("typed") != "", segment))
        children = here.where("segment IS NOT NULL").groupBy(*keys).agg(*sums)
        nodes = children.groupBy("host", "template").agg(
            F.count("*").alias("branches"), *[F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "good")]
        )
        gap = (F.col("good") * F.col("all_labelled") - F.col("labelled") * F.col("all_good")).cast("double")
        spread = F.lit(z_squared) * F.col("labelled") * F.col("all_good") * (F.col("all_labelled") - F.col("all_good"))
        alike = gap * gap <= spread
        if level <= depth:
            branch = (
                F.when((F.col("branches") > fanout) & (F.col("pages") * fanout < F.col("all_pages")) & alike, F.lit("{*}"))
                .when((F.col("branches") > 1) & alike, F.lit("{~}"))
                .otherwise(F.col("segment"))
            )
        else:
            branch = F.when((F.col("branches") > 1) & ~alike, F.col("segment"))
        named = children.join(nodes, ["host", "template"]).select(*keys, branch.alias("branch"))
        grown = here.join(named, keys, "left").select(
            "host", "typed", "pages", "labelled", "good",
            F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch")).alias("template"),
        )
        grown = stored(grown, f"urltree-{level}")
        if level <= depth:
            if grown.where(length > level).isEmpty():
                break
            continue
        mixed = grown.where(length >= level).groupBy("host", "template").agg(*sums[1:], F.max(length).alias("longest"))
        mixed = mixed.where(f"good > 0 AND good < labelled AND longest > {level}").select("host", "template")
        if mixed.isEmpty():
            break
        settled.append(grown.join(mixed, ["host", "template"], "left_anti"))
        grown = grown.join(mixed, ["host", "template"], "left_semi")
    for part in settled:
        grown = grown.unionByName(part)
    return grown.select("host", "typed", "template", "labelled", "good")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules=RULES, depth: int = DEPTH, fanout: int = FANOUT,
    z_squared: float = Z_SQUARED, smoothing: float = SMOOTHING, least: float = LEAST_PURITY,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page.

    ``labels`` has (page_id, good 0/1); an id labelled more than once is good only if all say
    so, null labels are none. Pages without a fitting rule get their template's verdict: block
    if its smoothed purity is under ``least``. Without any label the purity is one half, which
    allows. Repeated pages count as often as they come; a null page_id has no label.
    """
    name, verdict = rule_columns(rules)
    judged = with_host_path(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")).select(
        "page_id", "host", "path", name.alias("rule"), verdict.alias("said"), typed_path(F.col("path")).alias("typed")
    )
    known = labels.where("good IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min("good").cast("long").alias("good"))
    paths = judged.select("page_id", "host", "typed").join(known, "page_id", "left").groupBy("host", "typed").agg(
        F.count("*").alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    tree = templates(paths, depth, fanout, z_squared)

    def counts(*by: str) -> DataFrame:
        return tree.groupBy(*by).agg(F.sum("labelled").alias("l_" + by[-1]), F.sum("good").alias("g_" + by[-1]))

    overall = tree.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("p"))
    rates = counts("host", "template").join(counts("host"), "host").select(
        "host", "template", "l_template", "g_template",
        ((F.col("g_host") + smoothing * overall.scalar()) / (F.col("l_host") + smoothing)).alias("prior"),
    )
    purity = (F.col("g_template") + smoothing * F.col("prior")) / (F.col("l_template") + smoothing)
    verdicts = tree.select("host", "typed", "template").join(
        rates.select("host", "template", F.when(purity < least, F.lit("block")).otherwise(F.lit("allow")).alias("found")),
        ["host", "template"],
    )
    return judged.join(verdicts, ["host", "typed"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", "found").alias("verdict"), "template"
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("good")
    )
    return judge_urls(table(spark, sf_dir, "pages"), labels)
