"""WARC, mixing, token shards, top-k and the pipeline against brute force and round trips."""

import gzip
import hashlib
import io
import operator
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsefield.llm import common, mixing, tokens, topk, warc
from pulsefield.llm.components import connected_components
from tests.llm.helpers import WORD, documents, frame
from tests.llm.test_text_operators import components, plain_simhash

PAGES = [(1, "http://a/\r\nx", "<p>" + "é" * 200), (2, None, "<p>" + "é" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "z" * 150), (8, "u", "z" * 150), (9, "u", "\x1f\x8b\x08" * 80), (10, "u", "q" * 300_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1, "s") for p in PAGES], "page_id long, url string, html string, salt int, first_id string").repartition(2)
    written = warc.write_warc(warc.with_revisits(pages, "page_id", "url", "html"), common.shared_folder(spark, "warc")).collect()
    assert sum(r.records for r in written) == len(PAGES)
    archives = spark.createDataFrame([(r.path, r.length) for r in written], "path string, length long")
    firsts = {}
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            firsts[data] = min(page_id, firsts.get(data, page_id))
    for split in (700, 8 << 20):
        got = {r.page_id: r for r in warc.read_warc(archives, split).collect()}
        assert len(got) == len(PAGES)
        for page_id, _, html in PAGES:
            data, r = (html or "").encode(), got[page_id]
            revisit = len(data) >= 100 and firsts.get(data, page_id) != page_id
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", firsts[data] if revisit else None)
            assert revisit or bytes(r.payload) == data
    assert warc.read_warc(archives.limit(0)).count() == 0


def test_every_split_owns_each_record_once():
    records = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" + bytes(random.Random(i).randbytes(400)) + b"\x1f\x8b\x08\x00WARC/1." for i in range(20)]
    data = b"".join(gzip.compress(r) for r in records)
    for step in (50, 333, 5000):
        found = [m for a in range(0, len(data), step) for m in warc.members(io.BytesIO(data), a, min(a + step, len(data)), len(data), 64)]
        assert found == records


def _archive(spark, tmp_path, data):
    path = tmp_path / "other.warc.gz"
    path.write_bytes(data)
    return spark.createDataFrame([(f"file://{path}", len(data))], "path string, length long")


def test_archives_of_other_writers(spark, tmp_path):
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\ncontent-length: 9\r\n\r\nsoftware:\r\n\r\n"
    again = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:2>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    body = b"HTTP/1.1 200\r\n\r\n<b>hi</b>"
    page = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http;msgtype=response\r\nCONTENT-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    data = gzip.compress(info + page) + gzip.compress(again)
    got = {r.record_id: r for r in warc.read_warc(_archive(spark, tmp_path, data)).collect()}
    assert set(got) == {"<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>"} and all(r.page_id is None for r in got.values())
    assert bytes(got["<urn:uuid:1>"].payload) == b"software:" and bytes(got["<urn:uuid:2>"].payload) == b"<b>hi</b>"
    last = got["<urn:uuid:3>"]
    assert (last.record_type, last.payload_bytes, last.payload_digest, last.refers_to_id, last.payload) == ("revisit", None, "sha1:ABC", "<urn:uuid:2>", None)


@pytest.mark.parametrize("damage", ["cut", "gap", "junk", "length"])
def test_nothing_is_lost_in_silence(spark, tmp_path, damage):
    record = lambda i: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 600\r\n\r\n%s\r\n\r\n" % (i, random.Random(i).randbytes(600))
    whole = [gzip.compress(record(i)) for i in range(4)]
    data = {"cut": b"".join(whole)[:-90], "gap": whole[0] + b"\0" * 20 + b"".join(whole[1:]), "junk": b"junk" + b"".join(whole), "length": b"".join(whole) + gzip.compress(record(9)[:-300])}[damage]
    archives = _archive(spark, tmp_path, data)
    for split in (500, 8 << 20):
        with pytest.raises(Exception, match="other.warc.gz"):
            warc.read_warc(archives, split).collect()
    kept = {r.page_id for r in warc.read_warc(archives, strict=False).collect()}
    assert kept == ({0, 1, 2} if damage == "cut" else {0, 1, 2, 3})


def test_mixing_meets_targets(spark):
    rows = documents()
    got = mixing.mix_sources(frame(spark, rows), bucket_rows=3).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(names, [5, 2, 1, 5], strict=True))
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(3 * sizes[s]) for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(d["words"] for d in r.draws)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    again = mixing.mix_sources(frame(spark, rows).repartition(5), bucket_rows=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    order = mixing.training_order(mixing.mix_sources(frame(spark, rows))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and 0 <= order[0].position and order[-1].position <= 1
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_mixed_documents_stay_whole(spark):
    rows = documents()
    drawn = mixing.mixed_documents(frame(spark, rows)).select("row.*", F.col("draw.words").alias("drawn")).collect()
    known = Counter((i, t, s) for i, t, s in rows)
    assert all((r.doc_id, r.text, r.source) in known and len(WORD.findall(r.text)) == r.drawn for r in drawn)
    for source in {s for _, _, s in rows}:
        mix = [r for r in mixing.mix_sources(frame(spark, rows)).collect() if r.source == source]
        got, longest = sum(r.drawn for r in drawn if r.source == source), max(r.size for r in mix)
        assert abs(got - sum(r.taken for r in mix)) <= longest / 2
        crossing = [r for r in mix if any(d["words"] < r.size for d in r.draws)]
        assert len(crossing) <= 1
    assert set(frame(spark, rows).columns) < set(drawn[0].asDict())


@pytest.mark.parametrize("values,universe", [([], 1), ([0], 1), ([0, 0, 0, 7], 8), (list(range(300)), 300), (sorted(random.Random(1).choices(range(10**12), k=1000)), 10**12)])
def test_elias_fano(values, universe):
    ef = tokens.EliasFano.encode(np.array(values, np.int64), universe)
    again = tokens.EliasFano(ef.n, ef.low_bits, *ef.parts())
    assert [int(again.select(i)[0]) for i in range(len(values))] == values
    assert not values or again.select(0, len(values)).tolist() == values
    assert sum(map(len, ef.parts())) * 8 <= len(values) * (2.6 + np.log2(max(1, universe / max(1, len(values))))) + 64


def test_token_shards_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = [*documents(), (60, "<|endoftext|> 'll I'll  x\n\n y z  日本 ①² don't 12345", "a"), (61, "a" * 5000 + " " * 3000, "a")]
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = tokens.token_digest(spark, frame(spark, rows)).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=key):
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    assert tokens.token_digest(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["lowercase", "split", "prefix"])
def test_other_tokenizers_are_encoded_whole(tmp_path, kind):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert tokens.PieceEncoder(public.path("byte_bpe_50k.json"), "<u2").by_piece
    if kind == "lowercase":
        tokenizer.normalizer = normalizers.Lowercase()
    else:
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=kind == "prefix", use_regex=kind == "prefix")
    tokenizer.save(f"{tmp_path}/t.json")
    encoder, texts = tokens.PieceEncoder(f"{tmp_path}/t.json", "<u2"), ["Some Words, don't\nsplit them", "", "x  y"]
    assert not encoder.by_piece
    assert encoder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(230)]
    vectors += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (400, [-0.3] * 6), (229, vectors[229][1])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in vectors], "vec_id long, embedding array<float>, rank int, score string, q double")
    q = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q.setdefault(i, []).append(np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64))
    want = []
    for i in (x for x in q if x % 100 == 0):
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(q[i][0], v)), j) for j, vs in q.items() for v in vs if j != i)[:10]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    got = topk.exact_topk(df, F.col("vec_id") % 100 == 0, query_block=2, candidate_block=50)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_of_empty_and_large_vectors(spark):
    best = lambda rows: sorted(map(tuple, topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=2).collect()))
    assert best([(0, []), (100, [1.0]), (5, [-1.0]), (6, [])]) == [(0, 1, 5, 0), (0, 2, 6, 0), (100, 1, 0, 0), (100, 2, 6, 0)]
    big = 2.0**40
    # Partial sums leave 64 bits, the scores don't.
    assert best([(0, [big, big, 1.0]), (1, [big, -big, 1.0]), (2, [0.0, 0.0, 2.0])]) == [(0, 1, 2, 2 << 20), (0, 2, 1, 1 << 20)]
    for rows in ([(0, [1e300]), (1, [1.0])], [(0, [big]), (1, [big])]):
        with pytest.raises(Exception, match="too large|OverflowError"):
            best(rows)


def test_topk_rows_of_one_id_and_of_none(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [(i % 40 * 25, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(90)]  # ids in several rows, of differing vectors
    vectors += [(None, [1.0] * 6), (None, [-1.0] * 6), (None, None), (2**60 + 1, [1.0] * 6), (-100, [0.5] * 6), (7, [float("nan")] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, np.floor(1024 * np.array(v)).astype(int).tolist()) for i, v in vectors if v is not None and np.isfinite(v).all()]
    want = []
    for a, (i, q) in enumerate(rows):
        if i is not None and i % 100 == 0:
            scored = sorted((-sum(map(operator.mul, q, v)), j is None, j or 0) for b, (j, v) in enumerate(rows) if b != a)[:10]
            want += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scored, 1)]
    got = [tuple(r) for r in topk.op10_exact_topk(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want)
    assert any(r[2] is None for r in got) and any(r[0] == r[2] for r in got)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (600, 600)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(8)
    rows = [(i, f"{t or ''} " + " ".join(f"slur{rng.randrange(5)}" for _ in range(12)) if i and i % 7 == 0 and i >= 40 else t, s) for i, t, s in documents()]
    bench = " ".join(f"b{i}" for i in range(40))
    rows += [(200, f"start {bench} end", "a")] + [(300 + i, f"{' '.join(f'c{rng.randrange(90)}' for _ in range(20))} slur1 slur2 slur3", "b") for i in range(30)] + [(400 + i, " ".join(f"c{rng.randrange(90)}" for _ in range(20)), "b") for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int("slur" in (t or ""))) for i, t, _ in rows if i and i >= 40], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_shards"]
    for name, stage in c.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "token_shards":
            assert docs.columns == before.columns
    texts = {n: [r.text for r in seen[n]] for n in ("toxicity", "near_duplicates", "decontamination", "mixing")}
    assert Counter(texts["toxicity"]) == Counter(t for _, t, _ in rows if "slur" not in (t or ""))
    ids = list(range(len(texts["toxicity"])))
    groups = components(ids, [plain_simhash(t) for t in texts["toxicity"]])
    assert len(texts["near_duplicates"]) == len(set(groups))
    assert {groups[texts["toxicity"].index(t)] for t in texts["near_duplicates"]} == set(groups)
    assert Counter(texts["decontamination"]) == Counter(t for t in texts["near_duplicates"] if "b0 b1" not in (t or ""))
    words = sum(len(WORD.findall(t or "")) for t in texts["decontamination"])
    longest = max(len(WORD.findall(t or "")) for t in texts["decontamination"])
    assert abs(sum(len(WORD.findall(t)) for t in texts["mixing"]) - words) <= 2 * longest  # four sources, half a document each at most
    assert set(texts["mixing"]) <= set(texts["decontamination"])
    assert len(seen["token_shards"]) == len(texts["mixing"])
    assert c.run(spark, str(tmp_path)).count() == len(texts["mixing"])


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
