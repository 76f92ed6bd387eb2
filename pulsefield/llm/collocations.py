"""Collocations: phrases of a language whose words occur together more often than apart, from count tries.

1. A task reads its texts into tries of depth ``most``, one a language: a node is a phrase of at most that many words that some piece holds, its
   count the number of times. A trie is closed once it has read ``shard_words`` words, so a task's memory doesn't grow with its share. It is written as blocks of
   ``block_nodes`` nodes in the order of their words (parents before children): the block's words, sorted, and the nodes' word numbers and counts.
2. The first nodes of all blocks say how the nodes are spread; evenly chosen ones of them are the bounds of ranges. Ranges hold nodes, not prefixes: a
   prefix with much below it, or one very frequent pair, spans as many ranges as it needs. Each block is cut at the bounds.
3. A range's parts, sorted runs, are merged: nodes with equal words become one, counts summed. Nodes of at least ``least`` occurrences stay. The walk over the merged
   nodes keeps the counts on the way down, which are the left parts of every node below. Where a range begins below a node, that
   node is in a range before; such nodes are at most ``most`` - 1 a range and are looked up afterwards.
4. A node's suffix link leads to the node of its words but the first, whose count is the right part of a cut after one word; that node's own right parts
   are those of the later cuts. So links are followed from short phrases to long ones, a join a length.

Counts cover all texts. Scores are floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits, exact up to counts of 10**16, beyond which they raise.

Edge cases: a null or blank text has no words; a null language is ``und``, kept apart from no other (rows that say ``und`` are counted with it). Repeated rows count each.
Pieces of one word make no phrase. Ties are ordered by count and then by the UTF-8 bytes of the phrase. A text that isn't valid Unicode isn't possible in Spark's
strings. Very long texts are read a part at a time, cut between pieces or words without losing a phrase. An empty table yields no rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, release, small_enough, table

_MAP = bytearray(range(256))
for _c in b".,;:!?\n\v\f\r":
    _MAP[_c] = 10
_MAP[9] = 32
for _c in range(65, 91):
    _MAP[_c] += 32
_MAP = bytes(_MAP)


def text_parts(text: str, most: int = 1 << 20) -> Iterator[bytes]:
    """A text with A-Z in lower case, tabs as spaces and a line break between pieces, in parts of about so many bytes that end between pieces."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_MAP), 0
    while at < len(data):
        end = data.find(b"\n", at + most)
        end = len(data) if end < 0 else end + 1
        yield data[at:end]
        at = end


def merged_nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    bits = int(keys.max()).bit_length()
    if bits * keys.shape[1] <= 63:
        packed = keys[:, 0].astype(np.int64)
        for column in keys.T[1:]:
            packed = packed << bits | column
        order = np.argsort(packed, kind="stable")  # merges the sorted runs that it finds
        change = np.diff(packed[order]) != 0
    else:
        order = np.lexsort(keys.T[::-1])
        change = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], change]))
    return keys[order[starts]], np.add.reduceat(counts[order], starts)


class Trie:
    """The counted phrases of a language in one shard."""

    def __init__(self, most: int):
        self.most, self.numbers, self.parts = most, {}, []

    def read(self, part: bytes) -> int:
        """Take in a part of a text; how many words it has."""
        tokens, numbers = part.replace(b"\n", b" \n ").split(b" "), self.numbers
        ids = np.fromiter((0 if t == b"\n" else -1 if not t else numbers.setdefault(t, len(numbers) + 1) for t in tokens), np.int32, len(tokens))
        self.parts += [ids[ids >= 0], np.zeros(1, np.int32)]
        return int((ids > 0).sum())

    def nodes(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in order; the nodes in order, a row of word numbers from 1, zeros after its words; their counts."""
        words = sorted(self.numbers)
        rank = np.zeros(len(words) + 1, np.int32)
        rank[[self.numbers[w] for w in words]] = np.arange(1, len(words) + 1)
        ids = np.concatenate([rank[np.concatenate(self.parts)], np.zeros(self.most, np.int32)])
        self.parts, self.numbers = [], {}
        at, bits, levels = np.arange(len(ids) - self.most), len(words).bit_length(), []
        narrow = bits * self.most <= 63
        for depth in range(self.most):
            at = at[ids[at + depth] > 0]  # a zero ends a piece
            if narrow:
                packed = np.zeros(len(at), np.int64)
                for d in range(self.most):
                    packed <<= bits
                    if d <= depth:
                        packed |= ids[at + d]
                levels.append(packed)
            else:
                keys = np.zeros((len(at), self.most), np.int32)
                for d in range(depth + 1):
                    keys[:, d] = ids[at + d]
                levels.append(keys)
        whole = np.concatenate(levels)
        del levels, at
        if not narrow:
            return words, *merged_nodes(whole, np.ones(len(whole), np.int64))
        whole.sort()
        starts = np.flatnonzero(np.diff(whole, prepend=-1))
        counts, whole = np.diff(starts, append=len(whole)), whole[starts]
        keys = np.empty((len(whole), self.most), np.int32)
        for d in range(self.most):
            keys[:, d] = whole >> bits * (self.most - 1 - d) & (1 << bits) - 1
        return words, keys, counts


def _planes(columns: np.ndarray) -> bytes:
    """Whole numbers, the bytes of equal weight side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(columns.view(np.uint8).reshape(len(columns), -1).T).tobytes(), 1)


def _unplaned(data: bytes, kind: str, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize * width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1, width)


def encoded(words: list[bytes], keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Nodes as bytes: the words they use, their numbers among these, and the counts."""
    used = np.unique(keys)
    used = used[used > 0]
    local = np.where(keys > 0, np.searchsorted(used, keys) + 1, 0).astype("<u4")
    text = b"\n".join([words[i - 1] for i in used.tolist()])
    return zstandard.compress(text, 1), _planes(local), _planes(counts.astype("<u8").reshape(-1, 1))


def decoded(words: bytes, nodes: bytes, counts: bytes, most: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    return zstandard.decompress(words).split(b"\n"), _unplaned(nodes, "<u4", most).astype(np.int32), _unplaned(counts, "<u8", 1)[:, 0].astype(np.int64)


def _path(words: list[bytes], key: np.ndarray) -> tuple[bytes, ...]:
    return tuple(words[i - 1] if i else b"" for i in key.tolist())


def shard_blocks(docs: DataFrame, lang: Column, text: Column, most: int, shard_words: int, block_nodes: int) -> DataFrame:
    """lang, head (the words of the first node), n, words, nodes and counts of each block of each shard's tries."""

    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def written(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
        for name, trie in tries.items():
            words, keys, counts = trie.nodes()
            for at in range(0, len(keys), block_nodes):
                block = keys[at : at + block_nodes]
                head = [w.decode("utf-8", "surrogatepass") for w in _path(words, block[0])]
                row = (name, head, len(block), *encoded(words, block, counts[at : at + block_nodes]))
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["lang", "head", "n", "words", "nodes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, held = {}, 0
        for batch in batches:
            for row in range(batch.num_rows):  # a text at a time: a batch of them as Python strings would be the most that a task holds
                name, whole = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                for part in text_parts(whole):
                    held += tries.setdefault(name, Trie(most)).read(part)
                    if held >= shard_words:
                        yield from written(tries)
                        tries, held = {}, 0
        yield from written(tries)

    rows = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, head array<string>, n long, words binary, nodes binary, counts binary")


def range_bounds(blocks: DataFrame, range_nodes: int, most_heads: int = 200_000) -> dict[str, list[tuple[bytes, ...]]]:
    """Of each language the nodes at which ranges of about so many nodes begin.

    All blocks are about equally long, so their heads, in order, are evenly spaced nodes. Beyond ``most_heads`` a share of
    them by hash is taken: bounds decide where work is done, never what is counted.
    """
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("nodes")).first()
    share = math.ceil(size.blocks / most_heads)
    heads = blocks.where(F.pmod(F.xxhash64("words", "nodes"), F.lit(share)) == 0).select("lang", "head")
    step = max(1, round(range_nodes * size.blocks / max(1, size.nodes or 0) / max(1, share)))
    of_lang: dict[str, list[tuple[bytes, ...]]] = {}
    for r in heads.toLocalIterator():
        of_lang.setdefault(r.lang, []).append(tuple(w.encode("utf-8", "surrogatepass") for w in r.head))
    return {name: sorted(set(sorted(found)[step::step])) for name, found in of_lang.items()}


def cut_blocks(blocks: DataFrame, bounds: dict[str, list[tuple[bytes, ...]]], most: int) -> DataFrame:
    """lang, range, words, nodes and counts: the blocks, those that a bound falls into in parts."""

    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def pieces(name: str, *packed: bytes) -> Iterator[tuple]:
        words, keys, counts = decoded(*packed, most)
        of_lang = bounds.get(name, [])
        first = bisect.bisect_right(of_lang, _path(words, keys[0]))
        last = bisect.bisect_right(of_lang, _path(words, keys[-1]))
        cuts = [bisect.bisect_left(range(len(keys)), b, key=lambda i: _path(words, keys[i])) for b in of_lang[first:last]]
        if not cuts:
            yield name, first, *packed
            return
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
            if a < b:
                yield name, first + i, *encoded(words, keys[a:b], counts[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = zip(*pieces(*[c[row].as_py() for c in batch.columns]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["lang", "range", "words", "nodes", "counts"])

    return blocks.select("lang", "words", "nodes", "counts").mapInArrow(run, "lang string, range int, words binary, nodes binary, counts binary")


def merged_ranges(parts: DataFrame, most: int, least: int) -> DataFrame:
    """lang, w (words), f (count) and left (the counts of the node's beginnings) of nodes with f of least or more; beside them a row a range without words, whose f is all words in it."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        runs = [decoded(*part, most) for part in zip(group["words"], group["nodes"], group["counts"], strict=True)]
        words = sorted(set().union(*[r[0] for r in runs]))
        number = {w: i for i, w in enumerate(words, 1)}
        renumbered = [np.array([0, *map(number.__getitem__, r[0])], np.int32)[r[1]] for r in runs]
        keys, counts = merged_nodes(np.concatenate(renumbered), np.concatenate([r[2] for r in runs]))
        depth, rows = (keys > 0).sum(axis=1), np.arange(len(keys))
        above = []  # of each row the count of its node's beginning of d words, or -1 if that isn't in this range
        for d in range(1, most):
            up = np.maximum.accumulate(np.where(depth == d, rows, -1))
            mine = (up >= 0) & (keys[up, :d] == keys[:, :d]).all(axis=1)
            above.append(np.where(mine, counts[up], -1))
        out = [(key[0], [], int(counts[depth == 1].sum()), [])]
        for i in np.flatnonzero(counts >= least).tolist():
            path = [w.decode("utf-8", "surrogatepass") for w in _path(words, keys[i]) if w]
            out.append((key[0], path, int(counts[i]), [None if above[d][i] < 0 else int(above[d][i]) for d in range(len(path) - 1)]))
        return pd.DataFrame(out, columns=["lang", "w", "f", "left"])

    return parts.groupBy("lang", "range").applyInPandas(run, "lang string, w array<string>, f long, left array<long>")


def _with_left(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes whose beginnings stand in a range before get their counts by a look-up."""
    unknown = F.exists("left", lambda x: x.isNull())
    known, open_ = nodes.where(~unknown), nodes.where(unknown)
    prefix = lambda d: F.slice("w", 1, d)
    for d in range(1, most):
        wanted = open_.where((F.size("w") > d) & F.get("left", F.lit(d - 1)).isNull()).select("lang", prefix(d).alias("p")).distinct()
        found = nodes.where(F.size("w") == d).select("lang", F.col("w").alias("p"), F.col("f").alias(f"_f{d}")).join(wanted, ["lang", "p"], "left_semi")
        open_ = open_.withColumn("p", prefix(d)).join(found, ["lang", "p"], "left").drop("p")
    filled = [F.when(F.size("w") > d, F.coalesce(F.get("left", F.lit(d - 1)), F.col(f"_f{d}"))) for d in range(1, most)]
    left = F.slice(F.array(*filled), F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    return known.unionByName(open_.withColumn("left", left).select(*nodes.columns))


def _with_right(nodes: DataFrame, most: int) -> DataFrame:
    """Phrases of two words or more with ``right``: the counts of what a cut after 1, 2, ... words leaves."""
    shorter = nodes.where(F.size("w") == 1).select("lang", "w", "f", F.array().cast("array<long>").alias("right"))
    out = None
    for depth in range(2, most + 1):
        link = shorter.select("lang", F.col("w").alias("tail"), F.concat(F.array("f"), F.col("right")).alias("right"))
        own = nodes.where(F.size("w") == depth).withColumn("tail", F.slice("w", 2, depth - 1))
        linked = materialize(own.join(link, ["lang", "tail"]).select("lang", "w", "f", "left", "right"), "linked")
        out, shorter = linked if out is None else out.unionByName(linked), linked.select("lang", "w", "f", "right")
    return out


#: The score of a node's weakest cut; of equally weak ones the earliest.
_WEAKEST = """array_min(transform(sequence(1, size(w) - 1), k -> named_struct(
  'score', (1000000BD * cast(f as decimal(16, 0)) * cast(f as decimal(16, 0))) div (cast(left[k - 1] as decimal(19, 0)) * cast(right[k - 1] as decimal(19, 0))),
  'k', k, 'l', left[k - 1], 'r', right[k - 1])))"""


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 3, least: int = 10, top: int = 2000, contained: int = 50,
    shard_words: int = 1_000_000, block_nodes: int = 1 << 14, range_nodes: int = 400_000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to ``most`` words that occur ``least`` times or more.

    A phrase inside a longer one that has ``contained`` per cent of its occurrences or more is left out.
    """
    blocks = materialize(shard_blocks(docs, F.col(lang_col), F.col(text_col), most, shard_words, block_nodes), "blocks")
    parts = cut_blocks(blocks, range_bounds(blocks, range_nodes), most)
    nodes = materialize(merged_ranges(parts, most, least), "nodes")
    release(blocks)
    n = nodes.where(F.size("w") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = _with_right(_with_left(nodes.where(F.size("w") > 0), most), most)
    inside = lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    longer = None
    for size in range(2, most):
        found = phrases.where(F.size("w") > size).select("lang", "f", F.explode(inside(size)).alias("w"))
        longer = found if longer is None else longer.unionByName(found)
    if longer is not None:
        cover = longer.groupBy("lang", "w").agg(F.max("f").alias("cover"))
        phrases = phrases.join(cover, ["lang", "w"], "left").where(F.coalesce(F.col("cover") * 100 < F.col("f") * contained, F.lit(True)))
    scored = phrases.select("lang", F.concat_ws(" ", "w").alias("phrase"), F.col("f").alias("a"), F.expr(_WEAKEST).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = math.ceil(nodes.count() / 200_000) or 1  # best of each share first, so that a large language isn't one task's work
    best = scored.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p
), f AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY lang, k, phrase
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 10
), t AS (
  SELECT c.lang, c.phrase, c.f, cut, array_to_string(c.w[1:cut], ' ') AS a, array_to_string(c.w[cut + 1:], ' ') AS b FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < c.k
), s AS (
  SELECT t.lang, t.phrase, t.f, t.cut, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * t.f * t.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM t JOIN f l ON l.lang = t.lang AND l.phrase = t.a JOIN f r ON r.lang = t.lang AND r.phrase = t.b
), u AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS j FROM s) WHERE j = 1
), x AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, f FROM c WHERE k = 3
), y AS (SELECT lang, phrase, max(f) AS cover FROM x GROUP BY lang, phrase
), z AS (
  SELECT u.*, row_number() OVER (PARTITION BY u.lang ORDER BY score DESC, f DESC, u.phrase) AS rank FROM u LEFT JOIN y ON y.lang = u.lang AND y.phrase = u.phrase
  WHERE NOT coalesce(100 * cover >= 50 * f, false)
)
SELECT z.lang, rank, phrase, f AS a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
