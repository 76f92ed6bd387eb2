"""Quality rules as a table of thresholds, compiled into one Spark projection.

A rule bounds a metric of a text from below, above or both. The metrics are column expressions over the text's words and lines (lengths, symbols, stop
words, line kinds); ``verdict`` joins the table's comparisons to one condition, so adding a rule is adding a row. No user functions run, and no
row meets another: the work is one pass without a shuffle.

``n_repeat_words`` counts the words inside three-word windows that occur twice or more in their text. The windows are sorted by hash, words and
place, so equal ones are neighbours; the words themselves are compared, the hash only orders. The places found, sorted, are summed up without
counting an overlap twice. A text without repeated windows isn't sorted.

Edge cases: a null text is an empty one. Texts without words have ratios of zero, so rules with a lower bound reject them; so does the least
number of words. Repeated rows are judged each for itself. Nothing is cut from long texts; a text needs some 150 bytes a word while it is judged.
Ids of any type, null ones too, are kept as they are; other columns are ignored. An empty table yields no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm.common import BLANKS, WORD, table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and be for have he in is it of on that the this to was with "
    "auf das der die ein eine für im ist mit nicht und von zu "
    "au avec dans de des du en est et il la le les pour que qui sur un une "
    "como con del el es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """metric must be at least ``least`` and at most ``most``; a bound that is None doesn't hold."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The table of the query.
RULES = (
    Rule("n_words", least=50),
    Rule("repeat_word_ratio", most=0.5),
    Rule("mean_word_chars", least=2, most=20),
    Rule("symbol_ratio", most=0.1),
    Rule("exclaim_ratio", most=0.5),
    Rule("stop_word_ratio", least=0.02),
    Rule("alpha_word_ratio", least=0.6),
    Rule("dup_line_ratio", most=0.3),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
)

#: Up to so many repeated hashes the places that have them are picked first, by slots of low bits; beyond it all are sorted. The result is the same.
FEW, SLOTS = 4096, 128


def _repeats(df: DataFrame, width: int = 3) -> DataFrame:
    """With n_repeat_words, from the words in column _w."""
    w, none = F.col("_w"), F.array().cast("array<bigint>")
    window = lambda i: F.struct(F.col("_h")[i].alias("h"), *[w[i + k].alias(f"w{k}") for k in range(width)], i.alias("i"))
    places = F.sequence(F.lit(0), F.size(w) - width)
    # A column that a lambda reads is used outside of it as well: so Spark keeps it in a projection of its own and computes it once a row, not once an element.
    df = df.withColumn("_h", F.when(F.size(w) > width, F.transform(places, lambda i: F.xxhash64(*[w[i + k] for k in range(width)]))).otherwise(none))
    df = df.withColumn("_o", F.sort_array("_h"))
    twice = F.zip_with("_o", F.slice("_o", 2, F.size("_o")), lambda x, y: F.when(x == y, x))
    df = df.withColumn("_d", F.array_distinct(F.filter(twice, lambda x: x.isNotNull())))
    slot = lambda h: h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda b: F.filter("_d", lambda d: slot(d) == b))
    df = df.withColumn("_b", F.when((F.size("_d") > 0) & (F.size("_d") <= FEW), slots))
    marked = F.filter(places, lambda i: F.array_contains(F.col("_b")[slot(F.col("_h")[i])], F.col("_h")[i]))
    found = F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.col("_b").isNotNull(), marked).otherwise(places)
    df = df.withColumn("_s", F.sort_array(F.transform(found, window)))
    same = lambda x, y: reduce(lambda a, b: a & b, [x[c] == y[c] for c in ("h", *[f"w{k}" for k in range(width)])])
    pairs = F.zip_with("_s", F.slice("_s", 2, F.size("_s")), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))
    df = df.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    own = F.zip_with("_p", F.slice("_p", 2, F.size("_p")), lambda x, y: F.least(F.lit(width), F.coalesce(y - x, F.lit(width))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> DataFrame:
    """doc_id and every metric of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    trimmed = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), split.alias("_w"), lines.alias("_l"))
    df = _repeats(df.withColumn("n_words", F.size("_w").cast("long")))
    count = lambda column, test: F.size(F.filter(column, test)).cast("long")
    spelled = sorted({f(w) for w in stop_words for f in (str.lower, str.capitalize, str.upper)})
    ended = lambda x: F.rtrim(x, F.lit(" \t\r")).endswith("...") | F.rtrim(x, F.lit(" \t\r")).endswith("…")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    symbols, n, n_lines = F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"), F.col("n_words"), F.size("_l").cast("long")
    chars, dup = F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \t\n\x0b\f\r", F.col("_t"))).cast("long"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")
    df = df.withColumns({"word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": n_lines})
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        share(F.col("n_repeat_words"), n).alias("repeat_word_ratio"),
        share(F.col("word_chars"), n).alias("mean_word_chars"),
        share(F.col("n_symbols"), n).alias("symbol_ratio"),
        share((F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long"), n).alias("exclaim_ratio"),
        share(count("_w", lambda x: F.rtrim(x, F.lit(",.;:")).isin(spelled)), n).alias("stop_word_ratio"),
        share(F.regexp_count("_t", F.lit(r"\p{L}[^\x20\x09-\x0D]*")).cast("long"), n).alias("alpha_word_ratio"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        share(count("_l", lambda x: x.rlike(r"^[\x20\x09]*[-*•]")), F.col("n_lines")).alias("bullet_line_ratio"),
        share(count("_l", ended), F.col("n_lines")).alias("ellipsis_line_ratio"),
    )


def broken(rule: Rule) -> Column:
    """Whether a rule's bounds are left, from the column that it names."""
    metric, bounds = F.col(rule.metric), []
    if rule.least is not None:
        bounds.append(metric < F.lit(rule.least))
    if rule.most is not None:
        bounds.append(metric > F.lit(rule.most))
    return reduce(lambda a, b: a | b, bounds, F.lit(False))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns) -> DataFrame:
    """The metrics, ``failed`` (the metrics whose rules a row breaks, in the order of the table) and ``kept`` (it breaks none)."""
    df = measured(docs, **columns)
    marks = F.array(*[F.when(broken(r), F.lit(r.metric)) for r in rules]).cast("array<string>")
    return df.withColumn("failed", F.array_compact(marks)).withColumn("kept", F.size("failed") == 0)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), F.array_join("failed", ",").alias("failed"),
    )


_STOP = ", ".join(f"'{f(w)}'" for w in STOP_WORDS for f in (str.lower, str.capitalize, str.upper))
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), p AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM d WHERE len(w) >= 3
), k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM p
), g AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM k WHERE n > 1
), a AS (
  SELECT r, CAST(sum(least(3, coalesce(j - i, 3))) AS BIGINT) AS n FROM g GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(l) AS nl, len(regexp_extract_all(t, '!')) AS ne,
    len(list_filter(w, lambda x: rtrim(x, ',.;:') IN ({_STOP}))) AS ns,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS na,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS nb,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\r]*$'))) AS nd
  FROM d LEFT JOIN a ON d.r = a.r
), f AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'n_words' END,
    CASE WHEN n_words > 0 AND n_repeat_words > 0.5::DOUBLE * n_words THEN 'repeat_word_ratio' END,
    CASE WHEN n_words = 0 OR word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 'mean_word_chars' END,
    CASE WHEN n_words > 0 AND n_symbols::DOUBLE / n_words > 0.1::DOUBLE THEN 'symbol_ratio' END,
    CASE WHEN n_words > 0 AND ne > 0.5::DOUBLE * n_words THEN 'exclaim_ratio' END,
    CASE WHEN n_words = 0 OR ns::DOUBLE / n_words < 0.02::DOUBLE THEN 'stop_word_ratio' END,
    CASE WHEN n_words = 0 OR na::DOUBLE / n_words < 0.6::DOUBLE THEN 'alpha_word_ratio' END,
    CASE WHEN nl > 0 AND n_dup_lines::DOUBLE / nl > 0.3::DOUBLE THEN 'dup_line_ratio' END,
    CASE WHEN nl > 0 AND nb::DOUBLE / nl > 0.9::DOUBLE THEN 'bullet_line_ratio' END,
    CASE WHEN nl > 0 AND nd::DOUBLE / nl > 0.3::DOUBLE THEN 'ellipsis_line_ratio' END
  ], lambda x: x IS NOT NULL) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed
FROM f
"""
