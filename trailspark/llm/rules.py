"""Quality rules whose cutoffs limit how many good documents they reject, per stratum.

Each rule is a whole-number level of a document, high where it looks bad. Labelled documents are
dealt by a hash of their id into a half that proposes cutoffs and a holdout that certifies them.
A cutoff is certified if the exact binomial tail says that so few rejected good documents of the
holdout are too unlikely under a false rejection rate of ``risk`` divided by the number of rules.
The error level is divided by the number of strata and rules (Bonferroni); inside one rule of
one stratum the cutoffs are tested from the highest down and testing ends at the first failure
(a fixed sequence, which needs no further correction). With probability 1 - ``error`` all strata
then lose at most ``risk`` of the good documents that pass the base rules.

All counting is in histograms of levels, at most ``TOP`` + 1 for a rule and stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.llm.classifier import label_kinds
from trailspark.llm.common import stored, table

SPACES = " \t\n\x0b\x0c\r"
GRAM = 5  # words in a window of n_repeat_words
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
RISK = 0.02  # of the good documents of a stratum, over all rules together
ERROR = 0.05
LEAST_PURITY = 0.5  # of the labelled documents that a cutoff rejects in the proposing half so many are bad
TOP = 1000

#: (rule, level): levels are whole numbers, so that every count is exact; in thousandths but for tenths of characters.
RULES = {
    "symbols": "1000 * n_symbols div word_chars",
    "dup_lines": "1000 * n_dup_lines div n_words",
    "repeats": "1000 * n_repeat_words div n_words",
    "long_words": "10 * word_chars div n_words",
    "short_words": "1000 * n_words div word_chars",
}


def with_signals(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Columns of these names are replaced. Each text is one row's work and nothing is shuffled:
    the windows of a text are compared by sorting their 64-bit hashes, and only if two are alike
    are they sorted again with their places.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    own = ["_words", "_lines", "_hashes", "_windows", "_places", "_starts"]

    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))
    out = docs.withColumns({"_words": words, "_lines": lines}).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    window = F.transform(
        F.sequence(F.lit(0), F.size("_hashes") - GRAM),
        lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(GRAM)]),
    )
    out = out.withColumn("_windows", F.when(F.size("_hashes") > GRAM, window))
    places = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_places", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), places))
    alike = F.filter("_places", lambda x, k: (x["h"] == F.get(F.col("_places"), k - 1)["h"]) | (x["h"] == F.get(F.col("_places"), k + 1)["h"]))
    out = out.withColumn("_starts", F.sort_array(F.transform(alike, lambda x: x["i"])))
    covered = F.transform("_starts", lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get(F.col("_starts"), k + 1) - p, F.lit(GRAM))))
    repeated = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(*own)


def _levels() -> list[Column]:
    """The level of each rule. Only documents that pass the base rules have one: they have words."""
    return [F.when(~F.col("base_failed"), F.least(F.expr(level), F.lit(TOP))).alias(rule) for rule, level in RULES.items()]


def log_tail(n: Column, k: Column, p: float) -> Column:
    """The logarithm of the probability of at most ``k`` successes in ``n`` trials of chance ``p``.

    Term by term in logarithms, so that no number of trials underflows.
    """
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    first = n * F.log1p(F.lit(-p))

    def add(at: Column, i: Column) -> Column:
        term = at["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(at["total"], term), F.least(at["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add)["total"]


def certified_cutoffs(
    judged: DataFrame, kinds: DataFrame, risk: float = RISK, error: float = ERROR, purity: float = LEAST_PURITY
) -> DataFrame:
    """stratum, rule, cutoff, n, k: the lowest cutoff of each rule that is certified and pure.

    ``judged`` has doc_id, stratum, base_failed and the levels; ``kinds`` doc_id and kind, of which
    ``good`` and ``low`` count. n is the number of good documents in the stratum's holdout, k how
    many of them the cutoff rejects. A rule without such a cutoff has no row and rejects nothing.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("level")) for rule in RULES]))
    labelled = judged.where("NOT base_failed").join(kinds.where("kind IN ('good', 'low')"), "doc_id")
    half = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1) < "8"
    good = F.col("kind") == "good"
    rows = labelled.select("stratum", half.alias("proposes"), good.alias("good"), levels.alias("x")).select("stratum", "proposes", "good", "x.*")
    counts = rows.groupBy("stratum", "rule", "level").agg(
        F.expr("count_if(proposes AND good)").alias("kept_well"), F.expr("count_if(proposes AND NOT good)").alias("caught"),
        F.expr("count_if(NOT proposes AND good)").alias("lost"),
    )
    of_rule = Window.partitionBy("stratum", "rule")
    down = of_rule.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        "stratum", "rule", "level", F.sum("lost").over(of_rule).alias("n"),
        *[F.sum(c).over(down).alias(c) for c in ("kept_well", "caught", "lost")],
    )
    tests = judged.select("stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)) * len(RULES)).scalar()
    share = risk / len(RULES)
    passes = (F.col("lost") <= share * F.col("n")) & (log_tail(F.col("n"), F.col("lost"), share) <= F.log(F.lit(error) / tests))
    tested = sums.withColumn("passes", passes).withColumn("certified", F.min("passes").over(down))
    pure = (F.col("caught") > 0) & (F.col("caught") >= purity * (F.col("caught") + F.col("kept_well")))
    return tested.where(F.col("certified") & pure).groupBy("stratum", "rule").agg(
        F.min_by(F.struct("level", "n", "lost"), "level").alias("x")
    ).select("stratum", "rule", F.col("x.level").alias("cutoff"), "x.n", F.col("x.lost").alias("k"))


def judge(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR, purity: float = LEAST_PURITY
) -> DataFrame:
    """doc_id, the signals, base_failed, kept and ``rules`` (those that reject, a list) of every row.

    Null texts have no words and fail the base rules; a null stratum is one of its own. Rows
    without doc_id are judged but never labelled. Of repeated labels the worst counts. Repeated
    rows are judged, and counted if labelled, as often as they come. Without labels only the base
    rules reject. No rows give no rows.
    """
    site = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site, "text")
    signals = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = stored(with_signals(bare).select("doc_id", "stratum", *signals), "rules-signals")
    judged = found.select("*", *_levels())
    cutoffs = certified_cutoffs(judged, label_kinds(labels), risk, error, purity)
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    limits = wide.select("stratum", *[F.col(rule).alias(f"most_{rule}") for rule in RULES])
    rejecting = F.filter(
        F.array(*[F.when(F.col(rule) >= F.col(f"most_{rule}"), F.lit(rule)) for rule in RULES]), lambda rule: rule.isNotNull()
    )
    return judged.join(limits, "stratum", "left").select(
        "doc_id", *signals, (~F.col("base_failed") & (F.size(rejecting) == 0)).alias("kept"), rejecting.alias("rules")
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rules")


_TAIL = f"""exp(n * ln(1 - p)) + list_sum(list_transform(range(1, lost + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))"""
OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
),
grams AS (
  SELECT row, i, words[i:i + {GRAM - 1}] AS gram, len(words) AS n
  FROM (SELECT row, words, unnest(range(1, len(words) - {GRAM - 2})) AS i FROM split)
),
twice AS (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
repeated AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + {GRAM})) AS place FROM twice) GROUP BY row),
signals AS (
  SELECT row, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeated USING (row)
),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM signals
),
levels AS (
  {" UNION ALL ".join(f"SELECT row, doc_id, stratum, '{rule}' AS rule, least({level.replace(' div ', ' // ')}, {TOP}) AS level FROM judged WHERE NOT base_failed" for rule, level in RULES.items())}
),
kinds AS (
  SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'toxic' WHEN min(quality) = 0 THEN 'low' ELSE 'good' END AS kind FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1
),
labelled AS (
  SELECT stratum, rule, level, left(sha256(doc_id::VARCHAR), 1) < '8' AS proposes, kind = 'good' AS good
  FROM levels JOIN kinds USING (doc_id) WHERE kind IN ('good', 'low')
),
counts AS (
  SELECT stratum, rule, level, count(*) FILTER (proposes AND good) AS kept_well, count(*) FILTER (proposes AND NOT good) AS caught,
    count(*) FILTER (NOT proposes AND good) AS lost
  FROM labelled GROUP BY ALL
),
sums AS (
  SELECT stratum, rule, level, sum(lost) OVER (PARTITION BY stratum, rule)::BIGINT AS n, sum(kept_well) OVER down AS kept_well,
    sum(caught) OVER down AS caught, (sum(lost) OVER down)::BIGINT AS lost, {RISK / len(RULES)}::DOUBLE AS p
  FROM counts WINDOW down AS (PARTITION BY stratum, rule ORDER BY level DESC ROWS UNBOUNDED PRECEDING)
),
tested AS (
  SELECT *, lost <= p * n AND CASE WHEN lost <= p * n THEN {_TAIL} END
      <= {ERROR} / ({len(RULES)} * (SELECT greatest(count(DISTINCT stratum), 1) FROM docs)) AS passes FROM sums
),
certified AS (
  SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY level DESC ROWS UNBOUNDED PRECEDING) AS certified FROM tested
),
cutoffs AS (
  SELECT stratum, rule, min(level) AS cutoff FROM certified
  WHERE certified AND caught > 0 AND caught >= {LEAST_PURITY} * (caught + kept_well) GROUP BY ALL
),
rejected AS (SELECT DISTINCT row FROM levels JOIN cutoffs USING (stratum, rule) WHERE level >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND row NOT IN (SELECT row FROM rejected) AS kept
FROM judged
"""
