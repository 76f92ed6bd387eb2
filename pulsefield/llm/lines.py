"""Line deduplication with a suffix array over line-id sequences, built by distributed prefix doubling.

1. Lines become ids: their rank in the order of their hashes. A line that occurs once can't be part of a repeated run,
   so documents fall into segments, the stretches of lines that occur more than once.
2. Prefix doubling. A suffix's rank over its first h lines is refined by the rank of the suffix s lines on, which sorts
   by the first h + s lines. Suffixes of equal rank are one interval of the suffix array whose common prefix has at
   least h lines. A rank grows by the number of suffixes of its interval whose next rank is smaller; distinct
   pairs are counted first, and large intervals are summed in order-keeping buckets, so a line that is everywhere
   fills no task.
3. From ``min_lines`` on, each interval's suffixes other than its earliest are later copies of a run of h lines.
   Segments in which no interval can be extended leave; the rest go on until none is left.
4. The copies' intervals merge into maximal runs, which are cut.

So a line goes if it lies in a run of at least ``min_lines`` lines that also stands earlier, by id and line number. With
``min_lines=1`` a repeated line is a run of its own; lone_blanks=False leaves lines of blanks that repeat on their own, so texts keep
the gaps between their paragraphs. All of it is DataFrame expressions. Lines are equal if two independent 64-bit hashes are: for n lines
about n*n / 2**129 chance matches are to be expected, below 1e-12 for 10**13 lines.

Edge cases: a null text has no lines, an empty one a single empty line. Rows that repeat an id are documents of their own, in an order
given by their texts; null ids come first. An empty table yields no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, release, table

#: Makes the second hash of a line another function than the first.
SECOND = 0x5BD1E995
#: Rows that a bucket of an order-keeping sum should hold.
BUCKET_ROWS = 1 << 17


def _repeated(lines: DataFrame) -> DataFrame:
    """h, h2 and n of each line that occurs more than once."""
    return materialize(lines.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1"), "lineids")


def _first_ranks(counts: DataFrame) -> DataFrame:
    """h, h2 and r of each repeated line; r counts the occurrences of smaller hashes."""
    bits = min(22, max(10, math.ceil(math.log2(max(1, counts.count() / BUCKET_ROWS)))))
    counts = counts.withColumn("bucket", F.shiftright("h", 64 - bits).cast("int"))
    coarse = counts.groupBy("bucket").agg(F.sum("n").alias("bn"))  # at most 2**22 rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select("bucket", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, "bucket").select("h", "h2", (F.col("offset") + F.col("inside")).alias("r"))


def _refine(rows: DataFrame, shift: int, length: int, total: int) -> DataFrame:
    """Ranks by ``length`` lines from ranks by length - shift; keeps the segments that may go on."""
    segment = Window.partitionBy("rid", "seg")
    shifted = rows.withColumn("nxt", F.coalesce(F.lead("r", shift).over(segment.orderBy("pos")), F.lit(-1).cast("long")))
    shifted = materialize(shifted, "shifted")
    where = F.struct("doc_id", "tie", "rid", "pos")
    pairs = shifted.groupBy("r", "nxt").agg(F.count("*").alias("n"), F.min(where).alias("first"))
    # So many buckets that an interval of as many pairs as there are lines fills none.
    buckets = max(256, math.ceil(total / BUCKET_ROWS))
    pairs = materialize(pairs.withColumn("bucket", F.floor((F.col("nxt") + 1) * buckets / (total + 1)).cast("int")), "pairs")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = pairs.groupBy("r", "bucket").agg(F.sum("n").alias("bn")).withColumn("offset", F.coalesce(F.sum("bn").over(before("r", "bucket")), F.lit(0)))
    named = pairs.withColumn("inside", F.coalesce(F.sum("n").over(before("r", "bucket", "nxt")), F.lit(0))).join(coarse.drop("bn"), ["r", "bucket"])
    named = materialize(named.select("r", "nxt", (F.col("r") + F.col("offset") + F.col("inside")).alias("r2"), "n", "first"), "named")
    joined = shifted.join(named, ["r", "nxt"])
    whole = F.col("seg_end") - F.col("pos") >= length
    out = joined.select(
        "doc_id", "tie", "rid", "seg", "seg_end", "pos", F.col("r2").alias("r"),
        (whole & (F.col("n") > 1)).alias("open"),
        (whole & ~((F.col("first.rid") == F.col("rid")) & (F.col("first.pos") == F.col("pos")))).alias("later"),
    )
    out = materialize(out, "ranked")
    release(shifted, pairs, named)
    return out


def repeated_runs(numbered: DataFrame, min_lines: int = 2, lone_blanks: bool = True) -> DataFrame:
    """rid, start and stop of the maximal runs of later copies, from rows (doc_id, tie, rid, text)."""
    lines = numbered.select("doc_id", "tie", "rid", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line")).where("pos is not null").select("doc_id", "tie", "rid", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(SECOND), "line").alias("h2"), F.col("line").rlike(r"^[\x20\x09-\x0D]*$").alias("blank"))
    lines = materialize(lines, "lines")
    counts, total = _repeated(lines), lines.count()
    placed = materialize(lines.join(_first_ranks(counts), ["h", "h2"]).select("doc_id", "tie", "rid", "pos", "r", "blank"), "placed")
    release(lines, counts)
    own = Window.partitionBy("rid").orderBy("pos")
    seg = Window.partitionBy("rid", "seg")
    rows = placed.withColumn("seg", F.col("pos") - F.row_number().over(own)).withColumn("seg_end", F.max("pos").over(seg) + 1)
    rows = materialize(rows.withColumn("seg_lines", F.count("*").over(seg)).where(F.col("seg_lines") >= min_lines), "segments")
    release(placed)
    if min_lines == 1:
        # A table of its own: joined to the aggregate itself, the rows of a line that is everywhere couldn't be split over tasks.
        first = materialize(rows.groupBy("r").agg(F.min(F.struct("doc_id", "tie", "rid", "pos")).alias("first")), "firsts")
        counted = rows if lone_blanks else rows.where("not blank")
        copies = [counted.join(first, "r").where("not (first.rid = rid and first.pos = pos)").select("rid", "pos", F.lit(1).alias("n"))]
    else:
        copies = []
    rows = rows.drop("blank")
    length, active = 1, rows.where("seg_lines >= 2").drop("seg_lines")
    while not active.isEmpty():
        shift = min(length, min_lines - length) if length < min_lines else length
        length += shift
        ranked = _refine(active, shift, length, total)
        if hasattr(active, "folder"):
            release(active)
        if length >= min_lines:
            copies.append(ranked.where("later").select("rid", "pos", F.lit(length).alias("n")))
        alive = F.max("open").over(seg)
        active = materialize(ranked.withColumn("alive", alive).where("alive").select("doc_id", "tie", "rid", "seg", "seg_end", "pos", "r"), "active")
    if not copies:
        return rows.select("rid", F.col("pos").alias("start"), F.col("pos").alias("stop")).limit(0)
    every = copies[0]
    for more in copies[1:]:
        every = every.unionAll(more)
    spans = every.groupBy("rid", "pos").agg((F.col("pos") + F.max("n")).alias("stop"))
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", F.coalesce((F.col("pos") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("fresh").over(own))
    return islands.groupBy("rid", "island").agg(F.min("pos").alias("start"), F.max("stop").alias("stop")).drop("island")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, lone_blanks: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed, longest (the longest maximal run cut) and kept_text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbered = materialize(rows.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("rid"), "text"), "numbered")
    runs = repeated_runs(numbered, min_lines, lone_blanks)
    cuts = runs.groupBy("rid").agg(F.max(F.col("stop") - F.col("start")).alias("longest"), F.flatten(F.collect_list(F.sequence("start", F.col("stop") - 1))).alias("gone"))
    joined = numbered.join(cuts.hint("shuffle_hash"), "rid", "left").withColumn("lines", F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op3_remove_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_lines(table(spark, sf_dir, "documents"), min_lines=1, lone_blanks=False)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS l FROM documents
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY l[i], l[i + 1] ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 2)
), o AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY l[i] ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d) WHERE NOT regexp_full_match(l[i], '[\x20\x09-\x0D]*')
), g AS (
  SELECT doc_id, list(DISTINCT j) AS gone
  FROM (SELECT doc_id, unnest([i, i + 1]) AS j FROM w WHERE k > 1 UNION ALL SELECT doc_id, i FROM o WHERE k > 1) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
