"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources, in code-point order with null last, take the weights in turn and
share the corpus's whole size by them. A target stops at ``max_repeats`` times its source's
size; the excess goes to the others by weight until none is above. That fixed point
is water filling, so it is computed in one pass over the sources sorted by cap/weight.

Curriculum: a source's weight schedule runs linearly from a start to an end rate. Its
integral, scaled to the target, is the source's cumulative token demand. The documents of
a source stand in a hashed order and are read through in up to ``max_repeats`` passes; a draw
(one document in one pass) covers an interval of that demand, and inverting the integral
at its midpoint gives the draw's training position in [0, 1]. training_order() range-sorts
draws by position.

Everything is a DataFrame expression. A source may hold any share of the corpus: its running
sums are taken in hash-range buckets, then over the buckets, so no task sees a whole source.

Edge cases: a null text has size 0 and is never drawn. Rows that repeat id, source and size are
counted before the buckets are formed, so many copies don't gather in one; each yields
its own row, numbered a part of the input at a time. A null source is a source. The draw that crosses the target counts in part, so a source's
taken words are its target rounded to a whole number; mixed_documents() takes that document whole or not at all. An empty table yields no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import WORD, materialize, table, words

WEIGHTS = (5, 2, 1)
#: Start and end rates of the schedules, dealt to the sources like the weights.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _cycle(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, max_repeats: int = 3) -> DataFrame:
    """skey, snull, source_size, target, rate0, rate1 from one row (skey, snull, source_size) per source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("snull", "skey")
    by_ratio = everything.orderBy("ratio", "snull", "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    ranked = (
        placed.withColumn("weight", _cycle(weights, F.col("place")))
        .withColumn("rate0", _cycle(tuple(a for a, _ in schedules), F.col("place")))
        .withColumn("rate1", _cycle(tuple(b for _, b in schedules), F.col("place")))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    capped = F.col("cap") * F.sum("weight").over(after) <= F.col("weight") * left
    flagged = ranked.withColumn("capped", capped)
    spare = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    level = spare.cast("double") / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return flagged.select("skey", "snull", "source_size", target.alias("target"), "rate0", "rate1")


def position(x: Column, rate0: Column, rate1: Column) -> Column:
    """When a source whose rate runs from rate0 to rate1 has met the share x of its demand."""
    total, slope = (rate0 + rate1) / 2, rate1 - rate0
    return 2 * x * total / (rate0 + F.sqrt(rate0 * rate0 + 2 * slope * x * total))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_repeats: int = 3,
    bucket_rows: int = 1_000_000,
) -> DataFrame:
    """doc_id, source, size, copy, source_size, target, taken and draws, an array of (pass, words, position).

    copy numbers the rows that share doc_id, source and size from 0.
    """
    return _mix_sized(docs.select(*_keys(id_col, text_col, source_col)), weights, schedules, max_repeats, bucket_rows)


def _keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What the mix knows of a row: doc_id, skey, snull and size."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("skey"), F.col(source_col).isNull().alias("snull"), size.alias("size")]


def _mix_sized(sized: DataFrame, weights: tuple, schedules: tuple, max_repeats: int, bucket_rows: int) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("size").cast("string")))
    units = materialize(sized.groupBy("skey", "snull", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("h", digest), "mix")
    bits = min(28, max(10, math.ceil(math.log2(max(1, units.count() / bucket_rows)))))
    units = units.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 7), 16, 10).cast("int"), 28 - bits))
    per_bucket = units.groupBy("skey", "snull", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
    targets = source_targets(per_bucket.groupBy("skey", "snull").agg(F.sum("bucket_size").alias("source_size")), weights, schedules, max_repeats)
    earlier = Window.partitionBy("skey", "snull").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(targets, ["skey", "snull"])
    running = Window.partitionBy("skey", "snull", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(running), F.lit(0))
    placed = (
        units.withColumn("within", within)
        .join(offsets.drop("bucket_size"), ["skey", "snull", "bucket"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("offset") + F.col("within") + F.col("copy") * F.col("size"))
        .withColumn("goal", F.floor(F.col("target") + 0.5))
    )

    def draw(k: int) -> Column:
        at = F.col("start") + F.col("source_size") * k
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - at))
        middle = (at + taken / 2) / F.col("goal")
        return F.struct(F.lit(k).alias("pass"), taken.alias("words"), F.when(taken > 0, position(middle, F.col("rate0"), F.col("rate1"))).alias("position"))

    draws = F.filter(F.array(*[draw(k) for k in range(max_repeats)]), lambda d: d["words"] > 0)
    return placed.withColumn("draws", draws).select(
        "doc_id",
        F.when(~F.col("snull"), F.col("skey")).alias("source"),
        "size",
        "copy",
        "source_size",
        "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"]).alias("taken"),
        "draws",
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_repeats: int = 3,
    bucket_rows: int = 1_000_000,
) -> DataFrame:
    """The rows of docs as the mix draws them, a row per draw; ``draw`` has its pass, words and position.

    The columns of docs are under ``row``. Documents stay whole: of the draw that crosses a source's target, one a source, the document is taken if the
    target has half of it or more, else it is left out, so a source's words are within half that document of its target.
    Rows are numbered once and matched to the mix without their texts, which are shuffled once, to their draws.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "rows")
    own = [F.col("rid"), F.xxhash64(F.col("row")[text_col]).alias("tie")]
    narrow = materialize(numbered.select(*_keys(f"row.`{id_col}`", f"row.`{text_col}`", f"row.`{source_col}`"), *own), "sizes")
    mix = _mix_sized(narrow.select("doc_id", "skey", "snull", "size"), weights, schedules, max_repeats, bucket_rows)
    # Rows of equal key are numbered a part of the input at a time (a row's number tells the part), then over the parts.
    same = ["doc_id", "skey", "snull", "size"]
    parts = narrow.withColumn("part", F.shiftright("rid", 33))
    inside = parts.withColumn("inside", F.row_number().over(Window.partitionBy(*same, "part").orderBy("tie", "rid")) - 1)
    earlier = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*same, "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("offset > 0")
    keyed = [F.struct(F.col("doc_id")).alias("id"), "skey", "snull", "size"]  # a struct, so that null ids meet
    copies = inside.select(*keyed, "part", "rid", "inside").join(offsets.select(*keyed, "part", "offset"), ["id", "skey", "snull", "size", "part"], "left")
    copies = copies.select("id", "skey", "snull", "size", "rid", (F.col("inside") + F.coalesce("offset", F.lit(0))).cast("long").alias("copy"))
    drawn = mix.where(F.size("draws") > 0).select(F.struct("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("skey"), F.col("source").isNull().alias("snull"), "size", "copy", "draws")
    taken = materialize(copies.join(drawn, ["id", "skey", "snull", "size", "copy"]).select("rid", "size", "draws"), "draws")
    whole = F.col("draw.words") * 2 >= F.col("size")
    joined = numbered.join(taken, "rid").select("row", "size", F.explode("draws").alias("draw")).where(whole)
    return joined.select("row", F.col("draw").withField("words", F.col("size")).alias("draw"))


def training_order(mix: DataFrame) -> DataFrame:
    """One row per draw (doc_id, source, pass, words, position), range-sorted by position."""
    draws = materialize(mix.select("doc_id", "source", F.explode("draws").alias("d")).select("doc_id", "source", "d.*"), "draws")
    return draws.orderBy("position", "doc_id", "pass")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = materialize(mix_sources(table(spark, sf_dir, "documents")), "mixed")
    first = F.round(F.element_at(F.transform("draws", lambda d: d["position"]), 1), 9)
    digest = mix.select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("draws") > 0, first).alias("first_position"))
    return digest.orderBy(F.asc_nulls_last("first_position"), "doc_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS skey, source IS NULL AS snull,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT skey, snull, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL
), p AS (
  SELECT *, row_number() OVER (ORDER BY snull, skey) - 1 AS place FROM s
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    CASE place % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS rate0,
    CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS rate1, source_size * 3 AS cap
  FROM p
), c AS (
  SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, snull, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= weight * (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, snull, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped
  FROM w
), t AS (
  SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (CAST(sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE)
      / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE)) END AS target
  FROM c
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rate0, t.rate1, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.snull, d.skey ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.skey = t.skey AND d.snull = t.snull
), k AS (
  SELECT *, greatest(0, least(size, goal - start)) AS w0, greatest(0, least(size, goal - start - source_size)) AS w1,
    greatest(0, least(size, goal - start - 2 * source_size)) AS w2
  FROM o
), x AS (
  SELECT *, (start + w0 / 2) / CAST(goal AS DOUBLE) AS middle FROM k
)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 + w2 AS BIGINT) AS taken,
  CASE WHEN w0 > 0 THEN round(2 * middle * ((rate0 + rate1) / 2) / (rate0 + sqrt(rate0 * rate0 + 2 * (rate1 - rate0) * middle * ((rate0 + rate1) / 2))), 9) END AS first_position
FROM x
"""
