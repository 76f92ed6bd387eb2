"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Fingerprints of 64 bits come from word shingles. The bits are cut into radius + k blocks; fingerprints that differ in at most
``radius`` bits agree on k of them, so the index has an order of the fingerprints for every choice of k blocks. The bits of those
blocks are the shared masked pattern of an order's upper nodes. Below one, fingerprints are sorted by the Gray rank of their other bits, and runs of
neighbours make nodes that keep the bits all members share (mask and pattern). Two nodes whose patterns differ in more
than ``radius`` of the bits both share are pruned as whole groups; the difference grows as
bits are added from level to level, and only leaves that survive compare their members.

k is the least that leaves NODE_ROWS distinct fingerprints or fewer to an upper node on average: with radius 4 there are 5 orders of 12 bits up to a
million, 15 of 21 bits up to 500 million, then 35 of 27 and 70 of 32, so the work for a fingerprint doesn't grow with the corpus.

Work is on distinct fingerprints. Upper nodes with more than ``segment`` members, around large groups of near copies, are cut into
segments at quantiles of the Gray rank; pairs of segments that share too few bits are pruned before any row is sent, and each other pair is a task of
its own, so no task holds a large node. A task
reports a spanning forest of the links it finds, not the pairs; components are then joined over the forest,
which loses no link between groups.

Edge cases: null and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one shingle of
the whole sequence. Repeated rows are documents of their own. Ids of any type that has an order are kept. A null id is never the least; a component
of null ids only has a null component id. An empty table yields no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, release, small_enough, table
from pulsefield.llm.components import connected_components

BITS = 64
#: Members of a node of the lower levels, and how many nodes an upper one joins.
FANOUT = 16
#: Distinct fingerprints that an upper node should hold on average.
NODE_ROWS = 256
#: Quantiles at which a crowded node is cut.
CUTS = 64


def shingle_hashes(found: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """The hashes of the shingles of a sequence of words, repeats included."""
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(joined, seed)] if found else [], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - width + 1].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text: a bit is set if it is in over half the shingle hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    return majority_bits(shingle_hashes(found, width, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fingerprint, the 64 bits as a signed long, of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([simhash(t, width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": found})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.select(id_col).schema[0].dataType
    return rows.mapInPandas(run, "doc_id string, fingerprint long").withColumn("doc_id", F.col("doc_id").cast(kind))


def gray_rank(bits: Column) -> Column:
    """The place of a bit string in Gray order, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def masks(radius: int, leading: int) -> list[int]:
    """The bits that lead in each order: every choice of ``leading`` of radius + leading blocks of nearly equal width."""
    n = radius + leading
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, leading)]


def leading_blocks(n: int, radius: int, most: int = 4) -> int:
    """How many blocks lead for n distinct fingerprints."""
    fits = (k for k in range(1, most) if n <= NODE_ROWS << min(m.bit_count() for m in masks(radius, k)))
    return next(fits, most)


def index_orders(nodes: DataFrame, radius: int, leading: int) -> DataFrame:
    """fingerprint, order, head (the leading blocks) and rank (Gray rank of the other bits) for each of the index's orders."""
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    orders = F.array(*[F.struct(F.lit(j).alias("order"), F.lit(signed(m)).cast("long").alias("mask")) for j, m in enumerate(masks(radius, leading))])
    fp = F.col("fingerprint")
    placed = nodes.select("fingerprint", F.explode(orders).alias("o"))
    return placed.select("fingerprint", "o.order", fp.bitwiseAND(F.col("o.mask")).alias("head"), gray_rank(fp.bitwiseAND(F.bitwise_not("o.mask"))).alias("rank"))


class GrayIndex:
    """Nodes over fingerprints that stand in Gray order: level 0 is the leaves' members."""

    def __init__(self, sorted_bits: np.ndarray):
        self.levels = [(np.full(len(sorted_bits), ~np.uint64(0)), sorted_bits)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FANOUT)
            ones, some = np.bitwise_and.reduceat(pattern & mask, at), np.bitwise_or.reduceat(pattern & mask, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(ones ^ some)
            self.levels.append((shared, ones & shared))

    def near(self, other: GrayIndex, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions, in batches, whose bits differ in at most radius places."""
        top = max(len(self.levels), len(other.levels)) - 1
        yield from self._descend(other, radius, np.zeros(1, np.int64), np.zeros(1, np.int64), top)

    def _descend(self, other: GrayIndex, radius: int, a: np.ndarray, b: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (mask_a, bits_a), (mask_b, bits_b) = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
        if self is other:
            a, b = a[a <= b], b[a <= b]
        close = np.bitwise_count((bits_a[a] ^ bits_b[b]) & mask_a[a] & mask_b[b]) <= radius
        a, b = a[close], b[close]
        if level == 0:
            if len(a):
                yield a, b
            return
        for at in range(0, len(a), 4096):  # bounds the pairs held at a time
            children_a = _children(a[at : at + 4096], level, self)
            children_b = _children(b[at : at + 4096], level, other)
            left = np.repeat(children_a, children_b.shape[1], axis=1).ravel()
            right = np.tile(children_b, (1, children_a.shape[1])).ravel()
            real = (left >= 0) & (right >= 0)
            yield from self._descend(other, radius, left[real], right[real], level - 1)


def _children(nodes: np.ndarray, level: int, index: GrayIndex) -> np.ndarray:
    """The children of nodes of a level, a row each, -1 where there is none."""
    if level >= len(index.levels):
        return nodes[:, None]
    below = nodes[:, None] * FANOUT + np.arange(FANOUT)
    return np.where(below < len(index.levels[level - 1][0]), below, -1)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _links(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints in Gray order."""
    if len(bits) == 2:
        return [(0, 1)] if int(bits[0] ^ bits[1]).bit_count() <= radius else []
    forest, index = Forest(len(bits)), GrayIndex(bits)
    return [(x, y) for a, b in index.near(index, radius) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y and forest.join(x, y)]


def _cross_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between two segments that join groups which links within them don't."""
    forest = Forest(len(left) + len(right))
    for x, y in _links(left, radius):
        forest.join(x, y)
    for x, y in _links(right, radius):
        forest.join(len(left) + x, len(left) + y)
    return [(x, y) for a, b in GrayIndex(left).near(GrayIndex(right), radius) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, len(left) + y)]


def _segments(placed: DataFrame, radius: int, segment: int, broadcast_rows: int) -> DataFrame:
    """placed with s, t and mine: a row goes, from its own segment, to each pair (s, t) of segments of its node that isn't pruned."""
    node = ["order", "head"]
    hinted = lambda df: F.broadcast(df) if small_enough(df, broadcast_rows) else df
    large = materialize(placed.groupBy(*node).count().where(F.col("count") > segment).select(*node, F.ceil(F.col("count") / segment).cast("int").alias("n")), "large")
    if large.isEmpty():
        release(large)
        return placed.withColumns({c: F.lit(0) for c in ("s", "t", "mine")})
    # Segments follow quantiles of the Gray rank; where a node needs more than CUTS, a hash divides them further.
    ranks = F.percentile_approx("rank", [i / CUTS for i in range(1, CUTS)], 2000)
    cuts = materialize(placed.join(hinted(large), node).groupBy(*node, "n").agg(ranks.alias("cuts")), "cuts")
    known = placed.join(hinted(cuts), node, "left")
    coarse = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("rank"))) * F.least("n", F.lit(CUTS)) / CUTS)
    fine = F.ceil(F.col("n") / CUTS)
    mine = (coarse * fine + F.pmod(F.xxhash64("fingerprint"), fine)).cast("int")
    known = known.select(*placed.columns, F.coalesce(mine, F.lit(0)).alias("mine"), F.col("n").isNotNull().alias("cut"))
    parts = known.where("cut").groupBy(*node, "mine").agg(F.bit_and("fingerprint").alias("ones"), F.bit_or("fingerprint").alias("some"))
    a, b = (materialize(parts, "parts").select(*node, *[F.col(c).alias(c + x) for c in ("mine", "ones", "some")]) for x in "st")
    shared = F.bitwise_not(F.col("oness").bitwiseXOR(F.col("somes")).bitwiseOR(F.col("onest").bitwiseXOR(F.col("somet"))))
    near = F.bit_count(F.col("oness").bitwiseXOR(F.col("onest")).bitwiseAND(shared)) <= radius
    pairs = a.join(b, node).where((F.col("mines") <= F.col("minet")) & near).select(*node, F.col("mines").alias("s"), F.col("minet").alias("t"))
    sent = materialize(pairs.select(*node, "s", "t", F.explode(F.array_distinct(F.array("s", "t"))).alias("mine")), "segmentpairs")
    met = known.join(hinted(sent), [*node, "mine"], "left")
    return met.select(*placed.columns, "mine", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))


def near_links(nodes: DataFrame, radius: int = 4, segment: int = 2048, broadcast_rows: int = 200_000, leading: int | None = None) -> DataFrame:
    """A spanning forest (u, v), repeats possible, of the links between distinct fingerprints."""
    placed = index_orders(nodes, radius, leading or leading_blocks(nodes.count(), radius))
    keys = ["order", "head", "s", "t"]
    dealt = _segments(placed, radius, segment, broadcast_rows).select(*keys, "mine", "rank", "fingerprint")
    sorted_rows = dealt.repartition(*keys).sortWithinPartitions(*keys, "mine", "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            marks = batch[keys].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1)])) if len(batch) else np.zeros(0, int)
            if len(starts):
                yield find(batch, starts[:-1].tolist(), starts[1:].tolist())
                rest = batch.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield find(rest, [0], [len(rest)])

    def find(batch: pd.DataFrame, starts: list[int], ends: list[int]) -> pd.DataFrame:
        bits, out = batch["fingerprint"].to_numpy(), []
        s, t, mine = (batch[c].to_numpy() for c in ("s", "t", "mine"))
        for a, b in zip(starts, ends, strict=True):
            if b - a < 2:
                continue
            own = bits[a:b].view(np.uint64)
            if s[a] == t[a]:
                out += [(bits[a + x], bits[a + y]) for x, y in _links(own, radius)]
            else:
                m = int(np.count_nonzero(mine[a:b] == s[a]))
                out += [(bits[a + x], bits[a + m + y]) for x, y in _cross_links(own[:m], own[m:], radius) if 0 < m < b - a]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return sorted_rows.mapInPandas(run, "u long, v long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id, the least id reachable over links, of each row."""
    marked = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected_components(near_links(nodes.select("fingerprint"), radius))
    grouped = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    labelled = materialize(grouped, "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    least = materialize(least, "least")
    ids = materialize(labelled.join(least, "component").select("fingerprint", "component_id"), "ids")
    release(nodes, labelled, least)
    return marked.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
