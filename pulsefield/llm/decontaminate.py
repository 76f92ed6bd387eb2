"""Benchmark decontamination: item-sized SimHash windows, a multi-index over Hamming blocks, exact verification.

Words are runs of letters and digits in lower case, shingles five words (all of a shorter item). A document holds an
item if one of its windows with as many words as the item has a weighted-shingle similarity, sum of minima over sum of maxima
of shingle counts, of at least ``threshold``.

1. Anchors. A window that similar shares all but a fifth of an item's shingles, so it holds at least one of any
   floor((1 - threshold) * n) + 1 of them. Each item's rarest so many, by the number of items that have them, are its
   anchors. Every shingle of every document meets the anchors in a hash join, in one pass over the texts for all shingle widths; no
   window without an item's anchor can hold the item. Items of equal words are one until the end.
2. Windows. Only documents that met an anchor are read again. Each anchor met opens the windows of its item's size that contain it (a
   window with several, at the first). Each gets its SimHash.
3. Multi-index. Items stand under (item, block, bits of the block) for radius + 1 blocks of the fingerprint. Fingerprints within
   ``radius`` bits agree on a block, so probing each block for the items of the window's anchors finds all of them.
4. Verification by the exact similarity. The best window of each document and item is kept.

At a similarity of 0.8 fingerprints of 64 bits differ in 10 bits on average (standard deviation 3), so a radius of 19 leaves out
about one such window in a thousand, and no copy; tests/llm measures it.

Arrays are exploded by the outer form: for the inner one the optimizer adds a filter on the array's size and inlines
the array into it, whose lambdas then tokenize the text again for every element.

All of it is DataFrame expressions. The anchor and item tables are broadcast if they have at most
``broadcast_rows`` rows, and shuffled otherwise.

Edge cases: null and empty texts and items hold nothing. Items may be repeated; each is reported. Of windows equally similar the first is. Rows repeated
with id and text are one document. An item of n words costs n windows of n shingles for each anchor met, so items of tens of thousands of words cost
the square of their length. Null ids are kept as null. Empty tables yield no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, small_enough, table

BITS = 64


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, width: int) -> Column:
    """The hash of every run of width words. Elements are taken by place: slice() would copy the whole array each time."""
    n = F.size(words) - (width - 1)
    empty = F.array().cast("array<bigint>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(words, i + d) for d in range(width)]))).otherwise(empty)


def _told_apart(hashes: Column) -> Column:
    """The array with its repeats made distinct, so set operations count them."""
    tagged = F.transform(hashes, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(hashes, 1, i), lambda x: x == h))))
    first = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), first).otherwise(tagged)


def simhash(hashes: Column) -> Column:
    """64 bits, each set if it is in over half the hashes. Counts stand in 16-bit lanes, four to a long."""
    zero, lane = F.lit(0).cast("long"), F.lit(0x0001000100010001)
    start = F.struct(*[zero.alias(f"l{k}") for k in range(16)])

    def add(a: Column, h: Column) -> Column:
        return F.struct(*[(a[f"l{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(lane)).alias(f"l{k}") for k in range(16)])

    def bit(count: Column, place: int) -> Column:
        return F.when(count * 2 > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), place)).otherwise(zero)

    def joined(counts: list[Column]) -> Column:
        bits = zero
        for place, count in enumerate(counts):
            bits = bits.bitwiseOR(bit(count, place))
        return bits

    def finish(a: Column) -> Column:
        return joined([F.shiftrightunsigned(a[f"l{place % 16}"], place // 16 * 16).bitwiseAND(F.lit(0xFFFF)) for place in range(BITS)])

    def ones(place: int) -> Column:
        return F.size(F.filter(hashes, lambda h: F.shiftrightunsigned(h, place).bitwiseAND(F.lit(1)) == 1))

    by_bit = joined([ones(place) for place in range(BITS)])
    return F.when(F.size(hashes) < 1 << 16, F.aggregate(hashes, start, add, finish)).otherwise(by_bit)


def _windows(hashes: Column, met: Column, width: int) -> Column:
    """The item-sized windows (item, size, start, hashes) that hold one of the anchors met, an array of (item, size, at)."""
    none = F.array().cast("array<int>")

    def of(m: Column) -> Column:
        span = m["size"] - width  # a window's shingles beyond the first
        last = F.greatest(F.size(hashes) - 1 - span, F.lit(0))  # a text shorter than the item is one window

        def starts(pos: Column, i: Column) -> Column:
            opened = F.when(i > 0, F.least(F.get(m["at"], i - 1), last)).otherwise(F.lit(-1))
            low, high = F.greatest(pos - span, opened + 1, F.lit(0)), F.least(pos, last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(none)

        return F.transform(F.flatten(F.transform(m["at"], starts)), lambda s: F.struct(m["item"].alias("item"), m["size"].alias("size"), s.alias("start"), F.transform(F.sequence(s, F.least(s + span, F.size(hashes) - 1)), lambda i: F.get(hashes, i)).alias("hashes")))

    return F.flatten(F.transform(met, of))


def _places(words: Column, width: int) -> Column:
    """The shingles of a width as an array of (width, pos, h)."""
    return F.transform(shingles(words, width), lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("pos"), h.alias("h")))


def _of_width(met: Column, width: int) -> Column:
    return F.filter(met, lambda m: m["width"] == width)


def _block_values(fingerprint: Column, n: int) -> list[Column]:
    edges = [BITS * i // n for i in range(n + 1)]
    return [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def _blocks(fingerprint: Column, n: int) -> Column:
    """One row per block: its number and value."""
    return F.explode_outer(F.array(*[F.struct(F.lit(j).alias("j"), v.alias("value")) for j, v in enumerate(_block_values(fingerprint, n))]))


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    radius: int = 19,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """doc_id, text_key (a hash of the text), item_id, start, n_words and similarity of each item a document holds."""
    plain = items.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("w")).withColumn("item", F.md5(F.array_join("w", " ").cast("binary")))
    named = plain.where(F.size("w") > 0).select("item", "item_id")
    sized = plain.where(F.size("w") > 0).dropDuplicates(["item"]).select("item", F.size("w").alias("size"), F.least(F.size("w"), F.lit(width)).alias("width"), "w")
    widths = [r.width for r in sized.select("width").distinct().collect()]  # at most five numbers
    if not widths:
        return _nothing(docs, items, id_col, item_col)
    hashes = F.coalesce(*[F.when(F.col("width") == k, shingles(F.col("w"), k)) for k in widths])
    held_items = sized.select("item", "size", "width", hashes.alias("hashes"))
    known = materialize(held_items.select("*", simhash(F.col("hashes")).alias("fingerprint")), "items")

    each = known.select("item", "size", "width", F.size("hashes").alias("n"), F.explode("hashes").alias("h")).groupBy("item", "size", "width", "n", "h").agg(F.count("*").alias("weight"))
    common = each.groupBy("h", "width").agg(F.count("*").alias("in_items"))
    # Repeats of a shingle count with it: anchors are taken until they weigh enough.
    rarest = Window.partitionBy("item").orderBy("in_items", "h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.join(common, ["h", "width"]).withColumn("before", F.coalesce(F.sum("weight").over(rarest), F.lit(0)))
    anchors = materialize(ranked.where(F.col("before") <= F.floor((1 - threshold) * F.col("n") + 1e-9)).select("h", "item", "size", "width"), "anchors")
    anchors_hint = F.broadcast(anchors) if small_enough(anchors, broadcast_rows) else anchors

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    split = rows.select("doc_id", "text_key", tokens(F.col("text")).alias("w"))
    places = [_places(F.col("w"), k) for k in widths]
    placed = split.select("doc_id", "text_key", F.explode_outer(places[0] if len(places) == 1 else F.concat(*places)).alias("x")).select("doc_id", "text_key", "x.*")
    met = placed.join(anchors_hint, ["h", "width"]).groupBy("doc_id", "text_key", "item", "size", "width").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    met = materialize(met.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item", "size", "width", "at")).alias("met")), "met")
    same = (rows["text_key"] == met["text_key"]) & rows["doc_id"].eqNullSafe(met["doc_id"])
    again = rows.join(met, same).select(rows["doc_id"], rows["text_key"], tokens(F.col("text")).alias("w"), "met")
    # The windows name the shingles many times, so those are columns of their own.
    again = again.select("doc_id", "text_key", "met", *[shingles(F.col("w"), k).alias(f"hashes{k}") for k in widths])
    opened = [_windows(F.col(f"hashes{k}"), _of_width(F.col("met"), k), k) for k in widths]
    windows = again.select("doc_id", "text_key", F.explode_outer(opened[0] if len(opened) == 1 else F.concat(*opened)).alias("v")).where("v is not null").select("doc_id", "text_key", "v.*")
    marked = windows.withColumn("fingerprint", simhash(F.col("hashes")))

    n = radius + 1
    index = materialize(known.select("item", F.col("hashes").alias("item_hashes"), F.col("fingerprint").alias("item_fingerprint"), _blocks(F.col("fingerprint"), n).alias("b")).select("*", "b.*").drop("b"), "index")
    index_hint = F.broadcast(index) if small_enough(index, broadcast_rows) else index
    probes = marked.select("*", _blocks(F.col("fingerprint"), n).alias("b")).select("*", "b.*").drop("b")
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    agreeing = F.coalesce(*[F.when(v == 0, F.lit(j)) for j, v in enumerate(_block_values(apart, n))])
    near = probes.join(index_hint, ["item", "j", "value"]).where((F.bit_count(apart) <= radius) & (F.col("j") == agreeing))
    shared = F.size(F.array_intersect(_told_apart(F.col("hashes")), _told_apart(F.col("item_hashes"))))
    similarity = shared / (F.size("hashes") + F.size("item_hashes") - shared)
    found = near.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = found.groupBy("doc_id", "text_key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("m"))
    return best.join(named, "item").select("doc_id", "text_key", "item_id", (-F.col("m.back")).cast("int").alias("start"), F.col("m.size").alias("n_words"), F.round("m.similarity", 6).alias("similarity"))


def _nothing(docs: DataFrame, items: DataFrame, id_col: str, item_col: str) -> DataFrame:
    kinds = dict(docs.dtypes) | {item_col: dict(items.dtypes)[item_col]}
    return docs.sparkSession.createDataFrame([], f"doc_id {kinds[id_col]}, text_key long, item_id {kinds[item_col]}, start int, n_words int, similarity double")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")
