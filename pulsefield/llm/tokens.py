"""Token-id shards with Elias-Fano document boundaries.

Documents are range-partitioned by id, or by keys that the caller gives; each task encodes its range in order and streams the ids to one shard.
A shard holds the concatenated ids (16 bits each if the vocabulary allows, else 32), then, Elias-Fano
coded, the token end of every document and the document ids, then a JSON footer. Elias-Fano keeps
the low bits of a rising sequence in a packed array and the high bits as unary gaps, about 2 + log2(u/n) bits a
value. Every 64th one bit of the high part has its place sampled, so select(i) scans a few words and there
is no table of 64-bit offsets.

The driver holds one row of the manifest per shard. Readers take the shards as tasks and find documents by
select().

Edge cases: a null or empty text is the end token alone. Null ids come first and read back as null. Rows that
repeat an id are documents of their own, ordered by a hash of their text. Texts of any
length are whole. An empty table makes no shard and reads back as no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm.common import shared_folder, table
from pulsefield.llm.files import reading, replacing

MAGIC = b"TOKEF001"
SAMPLE = 64
SHARDS, LARGEST_SHARD = 4096, 512 << 20


class EliasFano:
    """A non-decreasing sequence of whole numbers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self._low, self._high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self._samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, math.floor(math.log2(universe / n))) if n and universe > n else 0
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = ((values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> list[bytes]:
        return [self._low.tobytes(), self._high.tobytes(), self._samples.tobytes()]

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self._low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a].reshape(-1, self.low_bits)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, first: int, last: int | None = None) -> np.ndarray:
        """Values first to last - 1, one value if last is not given."""
        last = first + 1 if last is None else last
        at = int(self._samples[first // SAMPLE])
        stop = int(self._samples[(last + SAMPLE - 1) // SAMPLE]) if (last + SAMPLE - 1) // SAMPLE < len(self._samples) else len(self._high) * 8
        ones = np.flatnonzero(np.unpackbits(self._high[at // 8 : stop // 8 + 1], bitorder="little")) + at // 8 * 8
        ones = ones[ones >= at][first % SAMPLE :][: last - first]
        return ((ones - np.arange(first, last)) << self.low_bits) + self._lows(first, last)


#: Texts of these characters alone split into the tokenizer's pieces by the pattern below.
PLAIN = re.compile(r"[\t\n\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
#: Texts on which both ways must agree before pieces are used.
PROBES = ("I'll don't  it's 'S x\n\ny \t z  ", "Größe 12345 ab12 1a2b3c -- ... é È ÿ!? #$%&*()", "\n a\nb \n\n", "a" * 300 + " " * 40 + "b", "under_score 3.14e-5 <tag/> \\ ~ `q` [x]{y}", "", " ")


class PieceEncoder:
    """Encodes texts with a tokenizer and, if it is a byte-level BPE with the usual split, remembers the ids of pieces.

    Byte-level BPE never merges across the pieces its pattern splits a text into, so a text's ids are its pieces' ids in
    turn. Pieces not seen yet are encoded together, a line each. Other texts, and any that hold a
    special token's string, are encoded whole. So are all texts of a tokenizer that normalizes, splits otherwise, adds a leading blank, has no
    token of its own for a newline, or whose pieces and whole texts differ on PROBES.
    """

    def __init__(self, path: str, dtype: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.limit = Tokenizer.from_file(path), dtype, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.by_piece = self._usual_split() and self.newline is not None and self._pieces_agree()

    def _usual_split(self) -> bool:
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        return bool(usual and not made.get("normalizer") and made["model"]["type"] == "BPE")

    def _pieces_agree(self) -> bool:
        self.by_piece = True
        agree = self.encode(list(PROBES)) == self._whole(list(PROBES))
        self.ids.clear()
        return agree

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if len(self.ids) + len(pieces) > self.limit:
            self.ids.clear()
        blank = [p for p in pieces if not p.strip()]
        self.ids.update(zip(blank, self._whole(blank), strict=True))
        solid = [p for p in pieces if p.strip()]
        for at in range(0, len(solid), 4096):
            group = solid[at : at + 4096]
            data = self._whole(["\n".join(group)])[0]
            ends = np.flatnonzero(np.frombuffer(data, self.dtype) == self.newline) * np.dtype(self.dtype).itemsize
            size = np.dtype(self.dtype).itemsize
            starts = [0, *(ends + size).tolist()]
            self.ids.update((p, data[a:b]) for p, a, b in zip(group, starts, [*ends.tolist(), len(data)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if not self.by_piece:
            return self._whole(texts)
        plain = [bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        pieces = [PIECES.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        seen = set(itertools.chain.from_iterable(p for p in pieces if p))
        new = seen.difference(self.ids)
        if new:
            before = len(self.ids)
            self._learn(list(new))
            if len(self.ids) < before + len(new):  # the memory was emptied
                self._learn([p for p in seen if p not in self.ids])
        get = self.ids.__getitem__
        other = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(other) if p is None else b"".join(map(get, p)) for p in pieces]


@functools.lru_cache(1)
def _encoder(path: str, dtype: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    return PieceEncoder(path, dtype)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, wide: bool = False, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 24 << 20, order: tuple[Column, ...] | None = None) -> DataFrame:
    """Encode and write the documents by id, or by the keys in order; a row (shard, path, documents, tokens) per shard.

    order: unique sort keys of docs. Ids then don't rise, so they stand in the shard as they are.
    A shard has shard_bytes of text, and up to LARGEST_SHARD where there would be more than SHARDS, so the manifest stays small.
    """
    dtype = "<u4" if wide else "<u2"
    # The row's number lets rows of equal id and text fill more than one shard.
    by = order or (F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.monotonically_increasing_id())
    given = order is not None
    keys = [f"key{i}" for i in range(len(by))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[k.alias(name) for k, name in zip(by, keys, strict=True)])
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranged = rows.repartitionByRange(max(1, math.ceil(size / min(max(shard_bytes, size / SHARDS), max(shard_bytes, LARGEST_SHARD)))), *keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        if (batch := next(batches, None)) is None:
            return
        encoder, shard = _encoder(tokenizer, dtype), TaskContext.get().partitionId()
        uri, lengths, ids = f"{folder}/shard-{shard:06d}.tok", [], []
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        with replacing(uri) as out:
            while batch is not None:
                ids.append(batch["doc_id"])
                texts = [t if isinstance(t, str) else "" for t in batch["text"]]
                for at in range(0, len(texts), 256):
                    coded = encoder.encode(texts[at : at + 256])
                    out.write(end.join([*coded, b""]))
                    lengths += [len(x) // width + 1 for x in coded]
                batch = next(batches, None)
            ends = np.cumsum(np.array(lengths, np.int64))
            every = pd.concat(ids).to_numpy()
            nulls = sum(x is None for x in every)
            known = np.array([int(x) for x in every if x is not None], np.int64)
            base = int(known[0]) if len(known) and not given else 0
            parts = []
            for values in (ends,) if given else (ends, known - base):
                ef = EliasFano.encode(values, int(values[-1]) + 1 if len(values) else 1)
                parts.append({"n": ef.n, "low_bits": ef.low_bits, "sizes": [len(x) for x in ef.parts()]})
                out.write(b"".join(ef.parts()))
            if given:
                out.write(np.array([0 if x is None else int(x) for x in every], "<i8").tobytes() + np.array([x is None for x in every], np.uint8).tobytes())
            meta = json.dumps({"dtype": dtype, "tokens": int(ends[-1]), "nulls": nulls, "base": base, "ends": parts[0], "ids": None if given else parts[1]}).encode()
            out.write(meta + len(meta).to_bytes(4, "little") + MAGIC)
        yield pd.DataFrame({"shard": [shard], "path": [uri], "documents": [len(ends)], "tokens": [int(ends[-1])]})

    ready = ranged.select(F.col("doc_id").cast("string"), "text")  # ids as strings stay whole beside nulls
    return ready.mapInPandas(write, "shard int, path string, documents long, tokens long")


class Shard:
    """A written shard: documents by number, their ids by select()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token shard")
        length = int.from_bytes(tail[:4], "little")
        meta = json.loads(source.read_at(length, size - 12 - length))
        self.dtype, self.tokens, self.nulls, self.base = meta["dtype"], meta["tokens"], meta["nulls"], meta["base"]
        at, made = self.tokens * np.dtype(self.dtype).itemsize, []
        for part in (meta["ends"], meta["ids"]):
            if part is None:  # ids as they are, then a byte each that tells nulls
                made.append(None)
                continue
            pieces = []
            for n in part["sizes"]:
                pieces.append(source.read_at(n, at))
                at += n
            made.append(EliasFano(part["n"], part["low_bits"], *pieces))
        self.ends, self.ids = made
        self.ids_at = at

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Token offsets where documents first to last - 1 start, and where the last ends."""
        lead = self.ends.select(first - 1) if first else np.zeros(1, np.int64)
        return np.concatenate([lead, self.ends.select(first, last)])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        if self.ids is None:
            plain = np.frombuffer(self.source.read_at((last - first) * 8, self.ids_at + first * 8), "<i8").tolist()
            return [None if empty else x for x, empty in zip(plain, self.source.read_at(last - first, self.ids_at + len(self) * 8 + first), strict=True)]
        none = max(0, min(last, self.nulls) - first)
        known = self.ids.select(max(0, first - self.nulls), last - self.nulls) + self.base if last > self.nulls else []
        return [None] * none + [int(x) for x in known]

    def read(self, start: int, end: int) -> np.ndarray:
        width = np.dtype(self.dtype).itemsize
        return np.frombuffer(self.source.read_at((end - start) * width, start * width), self.dtype)


def read_shards(spark: SparkSession, manifest: list, documents: int = 1024) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document.

    manifest: the rows that write_shards() returns, one per shard. A task reads a shard, so many documents at a time.
    """
    manifest = sorted(manifest, key=lambda r: r.shard)
    bases = itertools.accumulate((r.tokens for r in manifest), initial=0)
    shards = spark.createDataFrame([(r.path, base) for r, base in zip(manifest, bases, strict=False)], "path string, base long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in batch.itertuples(index=False):
                with reading(path) as source:
                    shard = Shard(source)
                    for first in range(0, len(shard), documents):
                        last = min(first + documents, len(shard))
                        bounds = shard.bounds(first, last)
                        ids = shard.read(int(bounds[0]), int(bounds[-1])).astype("<u4")
                        own = bounds - bounds[0]
                        yield pd.DataFrame(
                            {
                                "doc_id": [None if x is None else str(x) for x in shard.doc_ids(first, last)],
                                "start": bounds[:-1] + base,
                                "n_tokens": np.diff(bounds),
                                "ids": [ids[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)],
                            }
                        )

    out = shards.repartition(max(1, len(manifest)), "path").mapInPandas(read, "doc_id string, start long, n_tokens long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, order: tuple[Column, ...] | None = None) -> DataFrame:
    """Write the documents as shards, read them back and digest each document's ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_shards(docs, shared_folder(spark, "tokens"), tokenizer, end_id, order=order).collect()  # one small row per shard
    return read_shards(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, table(spark, sf_dir, "documents"))
