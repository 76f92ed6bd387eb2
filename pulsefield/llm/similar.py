"""Groups of texts with a word-shingle similarity of at least 0.8, the near-duplicate stage of the pipeline.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of at least ``threshold``; groups are the
components of the links. Words are those of op4. Fewer words than a shingle make one shingle of the whole sequence.

1. Texts equal by words (a 128-bit hash) are one node. A node has the SimHash fingerprint of its shingles, and op4's index over Gray orders links those of 4
   or fewer differing bits. The links, a spanning forest, are checked by the exact similarity; their components are the first groups. Looser
   texts differ in more bits (about 10 at the threshold), so the steps below join what the index leaves apart and lose none of it.
2. A node has MINS minima of its shingle hashes under as many permutations, a band is
   ROWS of them. Nodes that share a band stand in one bucket, whose head is the node with the sketch nearest to the bucket's majority
   bits: of edited copies, the one that the others are nearest to.
3. Every node of a bucket that isn't in its head's group is compared with the head by the exact similarity, a pair once however many buckets it shares. The
   components of these links and the first are groups already.
4. Nodes of buckets that hold several groups are open. Shingles that only one group has come first in their order, then those of few
   nodes. Two sets of sizes m and n are similar only if they share at least o = threshold / (1 + threshold) * (m + n) shingles, so their first common
   one stands no later than m - o in the one and n - o in the other. Only that far a node is listed under its shingles, as number and place,
   without text. Loosely similar texts differ in more than that, so they have no entries or none in common.
5. The nodes of a shingle's list are compared with its first one, where places, sizes and sketches (a hashed bit of each minimum, RADIUS bits apart
   at most) allow it; what is still in different groups then, with each other.

Links are thus exact, and a pair is missed only if its fingerprints differ in more than 4 bits and it shares no band, by chance (1 - s**4)**16, or its sketches differ too much. Of 20,000 pairs
made at a similarity of exactly 0.8 eight shared no band and none had sketches too far apart; copies are never missed. A link through a third
text may still join a missed pair. A group costs a comparison a member and bucket, not one a pair; pairs are compared by the text
only where they could be similar as far as places and sketches tell.

Edge cases: null and blank texts are one node. Repeated rows are one node. An empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, release
from pulsefield.llm.components import connected_components
from pulsefield.llm.simhash import majority_bits, near_links, shingle_hashes

MINS, ROWS, RADIUS = 64, 4, 17
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 64, MINS, np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 64, MINS, np.uint64)


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> tuple[bytes, np.ndarray]:
    """A hash of 16 bytes of the words of a text and the distinct hashes of its shingles in order."""
    key, hashes = _hashed(text, width, seed)
    return key, np.unique(hashes)


def _hashed(text: str | None, width: int, seed: int = 42) -> tuple[bytes, np.ndarray]:
    """The key of shingle_set() and the hashes of all shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    return xxhash.xxh3_128_digest(b" ".join(found), seed), shingle_hashes(found, width, seed)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(MINS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return least


def _bands(least: np.ndarray) -> list[int]:
    whole = [xxhash.xxh64_intdigest(least[at : at + ROWS].tobytes(), at) for at in range(0, MINS, ROWS)]
    return np.array(whole, np.uint64).view(np.int64).tolist()


def _sketch(least: np.ndarray) -> int:
    # Minima have leading zeros, so they are hashed before a bit is taken.
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return int(np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(">i8")[0])


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """rid, key (of the words), n (distinct shingles), fingerprint, bands and sketch of rows (rid, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, text in zip(batch["rid"].tolist(), batch["text"], strict=True):
                key, every = _hashed(text, width)
                hashes = np.unique(every)
                least = minima(hashes)
                bits = int(np.uint64(majority_bits(every)).view(np.int64))
                out.append((rid, key, len(hashes), bits, _bands(least) if len(hashes) > 1 else [], _sketch(least)))
            yield pd.DataFrame(out, columns=["rid", "key", "n", "fingerprint", "bands", "sketch"])

    return docs.select("rid", F.col("text").cast("string").alias("text")).mapInPandas(run, "rid long, key binary, n long, fingerprint long, bands array<long>, sketch long")


def similarities(pairs: DataFrame, texts: DataFrame, width: int = 5) -> DataFrame:
    """u, v and the exact similarity of each pair (u, v) of rids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, a = None, np.array([], np.uint64)
        for batch in batches:
            found = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                if left != last:  # heads come in a row
                    last, a = left, shingle_set(left, width)[1]
                b = shingle_set(right, width)[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                found.append(both / (len(a) + len(b) - both))
            yield pd.DataFrame({"u": batch["u"], "v": batch["v"], "similarity": np.array(found, float)})

    own = texts.select("rid", F.col("text").cast("string").alias("text"))
    right = pairs.join(own.select(F.col("rid").alias("v"), F.col("text").alias("right")), "v")
    both = right.join(own.select(F.col("rid").alias("u"), F.col("text").alias("left")), "u")
    return both.select("u", "v", "left", "right").mapInPandas(run, "u long, v long, similarity double")


def _bit_sums(sketch: str) -> list[Column]:
    """How often each bit of a group's sketches is set, two counts of 32 bits to a sum, and the number of rows."""
    lanes = F.lit(0x0000000100000001)
    return [F.count("*").alias("many"), *[F.sum(F.shiftrightunsigned(sketch, i).bitwiseAND(lanes)).alias(f"s{i}") for i in range(32)]]


def _majority() -> Column:
    """The bits that more than half of a group's sketches have, from _bit_sums()."""
    out = F.lit(0).cast("long")
    for i in range(64):
        count = F.shiftrightunsigned(f"s{i % 32}", i // 32 * 32).bitwiseAND(F.lit(0xFFFFFFFF))
        out = out.bitwiseOR(F.when(count * 2 > F.col("many"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return out


def _joined(links: DataFrame, threshold: float) -> DataFrame:
    return connected_components(links.where(F.col("similarity") >= threshold).select("u", "v")).withColumnRenamed("node", "rid")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with the column component of labels (rid, component), where they have none their own rid."""
    return nodes.join(labels, "rid", "left").withColumn("component", F.coalesce("component", "rid"))


def _close(nodes: DataFrame) -> DataFrame:
    """u and v of links, a spanning forest, that join all nodes (rid, n, fingerprint) whose fingerprints are near; of one fingerprint each node with the first."""
    placed = materialize(nodes.where("n > 1").select("rid", "fingerprint"), "fingerprints")
    heads = materialize(placed.groupBy("fingerprint").agg(F.min("rid").alias("head")), "fingerheads")
    same = placed.join(heads, "fingerprint").where("rid <> head").select(F.col("head").alias("u"), F.col("rid").alias("v"))
    forest = near_links(heads.select("fingerprint")).distinct()
    found = forest.join(heads.toDF("u", "x"), "u").join(heads.toDF("v", "y"), "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    out = materialize(same.unionAll(found).distinct(), "close")
    release(placed, heads)
    return out


def _held(nodes: DataFrame) -> DataFrame:
    """rid, band and head of each node (rid, n, bands, sketch) that shares a band with another."""
    placed = materialize(nodes.select("rid", "sketch", F.explode("bands").alias("band")), "bands")
    centers = materialize(placed.groupBy("band").agg(*_bit_sums("sketch")).where("many > 1").select("band", _majority().alias("center")), "centers")
    shared = materialize(placed.join(centers, "band").select("rid", "band", F.bit_count(F.col("sketch").bitwiseXOR(F.col("center"))).alias("away")), "shared")
    heads = materialize(shared.groupBy("band").agg(F.min(F.struct("away", "rid")).alias("h")).select("band", F.col("h.rid").alias("head")), "heads")
    held = materialize(shared.drop("away").join(heads, "band"), "held")
    release(placed, centers, shared, heads)
    return held


def _shingles(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """nodes (rid, n, sketch, component) with the hashes of their shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_set(text, width)[1].view(np.int64) for text in batch["text"]]
            yield batch.drop(columns="text").assign(hashes=hashes)

    rows = nodes.join(texts.select("rid", F.col("text").cast("string").alias("text")), "rid")
    return rows.select("rid", "n", "sketch", "component", "text").mapInPandas(run, "rid long, n long, sketch long, component long, hashes array<long>")


def _listed(tokens: DataFrame, threshold: float) -> DataFrame:
    """h, rid, n, sketch, component and at, the place of shingle h among those of its node, as far as a first common one can stand."""
    each = tokens.select("rid", "component", F.explode("hashes").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high"))
    common = materialize(counts.where("low <> high").select("h", "many"), "common")
    ordered = each.select("rid", "h").join(common, "h").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("many", "h"))).alias("found"))
    own = F.col("n") - F.size("found")  # shingles of one group alone, which come first
    last = F.floor(F.col("n") * (1 - threshold) + 1e-9)
    kept = tokens.drop("hashes").join(ordered, "rid").withColumn("own", own).withColumn("found", F.slice("found", F.lit(1), F.greatest(last - own + 1, F.lit(0)).cast("int")))
    out = materialize(kept.select("rid", "n", "sketch", "component", "own", F.posexplode("found").alias("i", "f")).select("f.h", "rid", "n", "sketch", "component", (F.col("own") + F.col("i")).alias("at")), "listed")
    release(common)
    return out


def _possible(a: str, b: str, threshold: float) -> Column:
    """Whether two entries of a list can be the first common shingle of nodes that are similar and not joined yet."""
    both = (F.col(f"{a}.n") + F.col(f"{b}.n")) * (threshold / (1 + threshold)) - 1e-6
    return (
        (F.col(f"{a}.component") != F.col(f"{b}.component"))
        & (F.col(f"{a}.n") - F.col(f"{a}.at") >= both)
        & (F.col(f"{b}.n") - F.col(f"{b}.at") >= both)
        & (F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) <= RADIUS)
    )


def _compared(a: DataFrame, b: DataFrame, texts: DataFrame, width: int, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """u, v and similarity of the possible pairs of lists a and b but the known ones; in a pair of b the rid is the lesser."""
    found = a.alias("a").join(b.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("b.rid") < F.col("a.rid")) & _possible("a", "b", threshold))
    pairs = found.select(F.col("b.rid").alias("u"), F.col("a.rid").alias("v")).distinct()
    pairs = materialize(pairs.join(known, ["u", "v"], "left_anti") if known is not None else pairs, "pairs")
    out = materialize(similarities(pairs, texts, width), "compared")
    release(pairs)
    return out


def similar_components(nodes: DataFrame, texts: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """rid and component of nodes (rid, n, fingerprint, bands, sketch) that are similar to another; components are those of all similar pairs that the
    fingerprints join or that share a band."""
    close = _close(nodes)
    checked = materialize(similarities(close, texts, width), "checked")
    seeds = materialize(_joined(checked, threshold), "seeds")

    held = _held(nodes)
    ends = _labelled(held.where("head <> rid").select("rid", "head"), seeds).join(seeds.toDF("head", "other"), "head", "left")
    apart = ends.where(F.col("component") != F.coalesce("other", "head"))
    stars = materialize(apart.select(F.col("head").alias("u"), F.col("rid").alias("v")).distinct(), "starpairs")
    near = materialize(similarities(stars, texts, width), "stars")
    first = materialize(_joined(near.unionAll(checked), threshold), "first")

    placed = materialize(_labelled(held.select("rid", "band"), first), "placed")
    several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    open_ = materialize(placed.join(several, "band").select("rid").distinct(), "open")
    tokens = materialize(_shingles(_labelled(nodes.select("rid", "n", "sketch").join(open_, "rid", "left_semi"), first), texts, width), "shingles")
    lists = _listed(tokens, threshold)
    release(close, checked, seeds, held, stars, near, placed, open_, tokens)

    heads = materialize(lists.groupBy("h").agg(F.min(F.struct("rid", "n", "sketch", "component", "at")).alias("head")).select("h", "head.*"), "listheads")
    tried = _compared(lists, heads, texts, width, threshold)
    # The components of the links so far, one step deep: what is joined by them needn't be compared.
    groups = lists.select("rid", "component").distinct()
    ends = tried.where(F.col("similarity") >= threshold).select("u", "v")
    ends = ends.join(groups.toDF("u", "x"), "u").join(groups.toDF("v", "y"), "v").select(F.greatest("x", "y").alias("component"), F.least("x", "y").alias("least"))
    least = materialize(ends.groupBy("component").agg(F.min("least").alias("least")), "least")
    again = materialize(lists.join(least, "component", "left").withColumn("component", F.coalesce("least", "component")).drop("least"), "again")
    mixed = again.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    rest = materialize(again.join(mixed, "h", "left_semi"), "rest")
    last = _compared(rest, rest, texts, width, threshold, tried.select("u", "v"))

    links = tried.unionAll(last).where(F.col("similarity") >= threshold)
    merged = links.join(groups.toDF("u", "x"), "u").join(groups.toDF("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"), "similarity")
    second = materialize(_joined(merged, threshold), "second").toDF("component", "merged")
    release(lists, heads, tried, least, again, rest, last)
    # Every component that is merged is in second; one that wasn't linked before is its own node.
    whole = first.join(second, "component", "left").select("rid", F.coalesce("merged", "component").alias("component"))
    fresh = second.join(first, second["component"] == first["rid"], "left_anti").select(F.col("component").alias("rid"), F.col("merged").alias("component"))
    return whole.unionAll(fresh)


def similar_groups(texts: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """rid and component, the least rid reachable over links, of rows (rid, text); rids are distinct."""
    marked = materialize(signatures(texts, width), "signatures")
    nodes = materialize(marked.groupBy("key").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    grouped = materialize(_labelled(nodes.select("key", "rid"), similar_components(nodes, texts, width, threshold)).select("key", "component"), "grouped")
    release(nodes)
    return marked.select("rid", "key").join(grouped, "key").select("rid", "component")
