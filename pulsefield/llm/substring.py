"""Exact substring deduplication over fixed-length word windows.

1. Documents are dealt to chunks by a hash of their row's number, so copies spread. In a chunk, every window of
   ``window`` words gets two Rabin-Karp hashes with independent bases, computed for the whole chunk at once from running sums of
   word hash times base power, modulo 2**64.
2. The chunk's distinct window hashes, each with whether it occurs twice there, go to hash-range
   buckets as sorted arrays of five bytes each, the hash's leading bits after the bucket's. A window that many documents share counts once per chunk, so
   it doesn't fill a bucket. A bucket counts its hashes over all chunks and answers with one bit each.
3. The windows that may be repeated, few of all, are counted again in the same way by both whole hashes. A bucket's answer is again
   one bit each. The chunks look up the bits, merge the repeated windows into maximal intervals and cut them out.

The text crosses the network once (all uses of the chunks read one shuffle), the hashes 5 bytes each and 16 more for candidates,
the answers one bit each. Two word sequences count as equal when 128 bits of hash are: for n windows about n*n / 2**129 chance matches are to be
expected in all, below 1e-12 for 10**13 windows.

docs must give its rows in the same order when a lost task reads them again, as files do.

Edge cases: a null or blank text, or one of fewer than ``window`` words, loses nothing and gives its words joined by
spaces. Each row is a document of its own, so rows repeated under one id remove each
other's windows, and ties can't arise. Null ids and ids of any type are kept as they are. An empty table yields no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, table

#: Odd bases, so their powers have inverses modulo 2**64.
BYTE_BASES, WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Words of more bytes are hashed one by one: polynomials modulo 2**64 of thousands of symbols have known collisions in every base.
LONG = 512
#: Bytes of a hash, after its bucket, by which candidates are found.
SHORT = 5
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of values[start:end] for each pair, from one running sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values)), out=sums[1:], dtype=np.uint64)
    np.add.accumulate(sums[1:], out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(inverse(base), len(values) + 1)[starts]


class Chunk:
    """The words and window hashes of some documents, as arrays over their joined bytes."""

    def __init__(self, texts: list[str | None], window: int):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join([*raw, b""])
        buf = np.frombuffer(self.data, np.uint8)
        blank = BLANK[buf]
        edge = np.diff(blank.view(np.int8), prepend=1, append=1)
        self.starts, self.ends = np.flatnonzero(edge[:-1] == -1), np.flatnonzero(edge[1:] == 1) + 1
        bounds = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.first_word = np.searchsorted(self.starts, bounds)
        self.buf, self.window = buf, window
        doc = np.repeat(np.arange(len(raw)), np.diff(self.first_word))
        whole = np.flatnonzero(doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)
        self.windows = whole

    def hashes(self, which: int) -> np.ndarray:
        """The first or second hash of each window."""
        if not len(self.windows):
            return np.zeros(0, np.uint64)
        words = _mixed(_spans_hash(self.buf + np.uint8(1), self.starts, self.ends, BYTE_BASES[which]) + (self.ends - self.starts).astype(np.uint64))
        for i in np.flatnonzero(self.ends - self.starts > LONG):
            words[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]], which)
        return _mixed(_spans_hash(words, self.windows, self.windows + self.window, WORD_BASES[which]))

    def cut(self, repeated: np.ndarray, window: int) -> Iterator[tuple[int, int, str]]:
        """n_words, n_removed and the kept words of each document; repeated marks self.windows."""
        change = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(change, self.windows[repeated], 1)
        np.add.at(change, self.windows[repeated] + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        for a, b in zip(self.first_word[:-1], self.first_word[1:], strict=True):
            lost = int(gone[a:b].sum())
            if a == b:
                yield 0, 0, ""
            elif lost == 0:
                yield int(b - a), 0, b" ".join(self.data[self.starts[a] : self.ends[b - 1]].split()).decode("utf-8", "surrogatepass")
            else:
                kept = np.flatnonzero(~gone[a:b]) + a
                runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []
                pieces = [w for r in runs for w in self.data[self.starts[r[0]] : self.ends[r[-1]]].split()]
                yield int(b - a), lost, b" ".join(pieces).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int = 2 << 20, bucket_hashes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text without the words of repeated windows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 1
    n_chunks, n_buckets = math.ceil(size / chunk_bytes), max(1, math.ceil(size / 6 / bucket_hashes))
    # All uses of the chunks read this one shuffle. Ids are strings in Python, where they stay whole beside nulls.
    numbered = rows.select(F.col("doc_id").cast("string"), "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int").alias("chunk"))
    chunked = numbered.repartition("chunk")

    width = np.uint64(min((1 << 64) // n_buckets + 1, (1 << 64) - 1))
    shift = np.uint64(max(0, int(width).bit_length() - 8 * SHORT))

    def parts(hashes: np.ndarray) -> dict[int, slice]:
        """The part of each bucket that has some of these rising hashes."""
        bucket = hashes // width
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
        return {int(bucket[i]): slice(i, j) for i, j in zip(starts, [*starts[1:], len(bucket)], strict=False)}

    def marked(hashes: np.ndarray, answers: pd.DataFrame) -> np.ndarray:
        """The bits that the buckets answered for these rising hashes."""
        out, at = np.zeros(len(hashes), bool), parts(hashes)
        for bucket, bits in zip(answers["bucket"], answers["bits"], strict=True):
            s = at[bucket]
            out[s] = np.unpackbits(np.frombuffer(bits, np.uint8), count=s.stop - s.start)
        return out

    def send(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        distinct, counts = np.unique(Chunk(group["text"].tolist(), window).hashes(0), return_counts=True)
        out = []
        for b, s in parts(distinct).items():
            short = ((distinct[s] - np.uint64(b) * width) >> shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]
            out.append((b, key[0], short.tobytes(), np.packbits(counts[s] > 1).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "chunk", "hashes", "twice"])

    def candidates(chunk: Chunk, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that may be repeated, and their distinct hash pairs in rising order with the pair of each."""
        first = chunk.hashes(0)
        distinct, place = np.unique(first, return_inverse=True)
        at = np.flatnonzero(marked(distinct, answers)[place])
        pairs = np.empty(len(at), [("a", np.uint64), ("b", np.uint64)])
        pairs["a"], pairs["b"] = first[at], chunk.hashes(1)[at]
        return at, *np.unique(pairs, return_inverse=True)

    def send_pairs(key: tuple, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame({"bucket": [], "chunk": [], "hashes": [], "twice": []})
        _, pairs, place = candidates(Chunk(group["text"].tolist(), window), answers)
        twice = np.bincount(place, minlength=len(pairs)) > 1
        out = [(b, key[0], pairs[s].tobytes(), np.packbits(twice[s]).tobytes()) for b, s in parts(pairs["a"]).items()]
        return pd.DataFrame(out, columns=["bucket", "chunk", "hashes", "twice"])

    def counting(read):
        def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            arrays = [read(x) for x in group["hashes"]]
            shared, counts = np.unique(np.concatenate(arrays), return_counts=True)
            shared, out = shared[counts > 1], []
            for chunk, own, twice in zip(group["chunk"], arrays, group["twice"], strict=True):
                hit = shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own if len(shared) else np.zeros(len(own), bool)
                out.append((chunk, key[0], np.packbits(hit | np.unpackbits(np.frombuffer(twice, np.uint8), count=len(own)).astype(bool)).tobytes()))
            return pd.DataFrame(out, columns=["chunk", "bucket", "bits"])

        return count

    def short(data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // SHORT, 8), np.uint8)
        out[:, :SHORT] = np.frombuffer(data, np.uint8).reshape(-1, SHORT)
        return out.view("<u8").ravel()

    def cut(key: tuple, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(group["text"].tolist(), window)
        at, pairs, place = candidates(chunk, answers[answers["round"] == 1])
        repeated = np.zeros(len(chunk.windows), bool)
        repeated[at] = marked(pairs["a"], answers[answers["round"] == 2])[place]
        out = pd.DataFrame(list(chunk.cut(repeated, window)), columns=["n_words", "n_removed", "kept_text"])
        return out.assign(doc_id=group["doc_id"].to_numpy())[["doc_id", "n_words", "n_removed", "kept_text"]]

    sent, answer = "bucket int, chunk int, hashes binary, twice binary", "chunk int, bucket int, bits binary"
    first = materialize(chunked.groupBy("chunk").applyInPandas(send, sent).groupBy("bucket").applyInPandas(counting(short), answer), "maybe")
    pairs = chunked.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInPandas(send_pairs, sent)
    second = pairs.groupBy("bucket").applyInPandas(counting(lambda x: np.frombuffer(x, [("a", np.uint64), ("b", np.uint64)])), answer)
    answers = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    out = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(cut, "doc_id string, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35
), k AS (
  SELECT p.r, p.i, md5(array_to_string(w[p.i:p.i + 34], ' ')) AS h FROM p JOIN d ON p.r = d.r
), m AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM k) WHERE n > 1
), g AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM m
), a AS (
  SELECT d.r, list(g.i) AS gone FROM d JOIN g ON d.r = g.r GROUP BY d.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a ON d.r = a.r
"""
