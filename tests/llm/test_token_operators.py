"""Token operators against the tokenizer library, exact round trips, and the media container."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolvent.llm import matroska, packing, range_coder, token_count, token_files
from resolvent.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return vocabulary()


@pytest.fixture(scope="module")
def encode(path):
    tok = tokenizers.Tokenizer.from_file(path)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [1 << 17, 3, 0])
def test_counts(edge_docs, no_docs, path, encode, hot):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(edge_docs, path, hot=hot).collect()), key=repr)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(encode(r.text)), len(encode(r.text)) > 2048) for r in edge_docs.select("doc_id", "text").collect()), key=repr)
    assert got == want
    assert token_count.token_counts(no_docs, path).collect() == []


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(edge_docs, no_docs, path, encode):
    got = token_files.round_trip(edge_docs, path, 2).collect()
    docs = [(r.doc_id, encode(r.text) + [2]) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((d, len(x), crc(x)) for d, x in docs), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert token_files.round_trip(no_docs, path).collect() == []


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1023, 1024, 1025, 5000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.integers(0, 3, n), np.full(n, 65535), rng.zipf(1.4, n) % 49000):
        ids = ids.astype(np.uint16)
        data = range_coder.encode(ids, group=3)
        assert (range_coder.decode(data, group=3) == ids).all()
        one = range_coder.blocks(data)[-1]  # any block decodes alone
        head = range_coder._HEAD.size
        assert (range_coder.decode(data[one[3] - head :]) == ids[len(ids) - one[0] :]).all()


def test_range_coder_keeps_its_format():
    """Files written before are read, and the same ids give the same bytes."""
    rng = np.random.default_rng(11)
    ids = np.minimum(rng.zipf(1.3, 30_000), 49_000).astype(np.uint16)
    ids[10_000:20_000] = ids[:10_000]
    data = range_coder.encode(ids)
    assert hashlib.sha256(data).hexdigest() == "92e744e2b4f0dc16861f10eb0c542bcb9f753a5dee0032b246f7e79a676ce962"
    assert (range_coder.decode(data) == ids).all() and (range_coder.decode(data, group=2) == ids).all()


def test_a_segment_is_one_group(monkeypatch):
    """All blocks of a segment take one walk over the steps, in either direction."""
    walks = []
    for name in ("_encode_group", "_decode_group"):
        of = getattr(range_coder, name)
        monkeypatch.setattr(range_coder, name, lambda *x, of=of, name=name: (walks.append(name), of(*x))[1])
    ids = (np.random.default_rng(3).zipf(1.3, 3_000 * 16) % 49_000).astype(np.uint16)  # a segment of 3,000 blocks
    data = range_coder.encode(ids, block=16)
    assert (range_coder.decode(data) == ids).all() and walks == ["_encode_group", "_decode_group"]
    assert range_coder.encode(ids, block=16, group=7) == data and token_files.SEGMENT == range_coder.BLOCK * range_coder.GROUP


def test_range_coder_words_are_those_of_plain_arithmetic():
    """Carries, and steps that write two words, against integers of any length."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 65536, 700), rng.zipf(1.2, 700) % 65536, np.zeros(700, np.int64), np.full(700, 65535)]).astype(np.uint16)
    begins, widths = range_coder._intervals(x)
    for lane, words in enumerate(range_coder._encode_group(x, 700)):
        low, size, shifts = 0, (1 << 64) - 1, 0
        for begin, width in zip(begins[lane].tolist(), widths[lane].tolist()):
            low, size = low + (size >> 32) * begin, (size >> 32) * width
            while size < 1 << 48:
                low, size, shifts = low << 16, size << 16, shifts + 1
        assert words.tolist() == [low >> 16 * k & 0xFFFF for k in range(shifts + 3, -1, -1)]


def test_range_coder_compresses_and_verifies():
    ids = np.tile(np.arange(200, dtype=np.uint16), 50)
    data = bytearray(range_coder.encode(ids))
    assert len(data) < len(ids)
    data[range_coder.blocks(bytes(data))[0][3] + 10] ^= 0x40  # in the first block's words
    with pytest.raises((ValueError, IndexError)):
        range_coder.decode(bytes(data))
    assert len(range_coder.decode(b"")) == 0


@pytest.mark.parametrize("window, shard_docs", [(2048, 8192), (64, 4), (1, 8192)])
def test_packing(edge_docs, path, encode, window, shard_docs):
    docs = edge_docs.where("doc_id not in (11, 12)").where("doc_id is not null")
    if window == 1:
        docs = docs.where("doc_id < 8")
    rows = packing.pack(docs, path, window=window, shard_docs=shard_docs, keep_ids=True).collect()
    ids = {r.doc_id: encode(r.text) + [1] for r in docs.select("doc_id", "text").collect()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids == ids[d][at : at + r.length] and r.ids_crc32 == crc(r.ids)
            at += r.length
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0


def test_packing_repeats_and_nothing(edge_docs, no_docs, path, encode):
    rows = packing.pack(edge_docs, path).collect()
    assert sum(r.length for r in rows) == sum(len(encode(r.text)) + 1 for r in edge_docs.select("text").collect())
    assert packing.pack(no_docs, path).collect() == []


def test_neighbours_are_lexical():
    """A window takes the document that shares rare terms with its seed before any other."""
    doc, term = np.array([0, 0, 1, 1, 2, 2, 3, 3]), np.array([1, 9, 2, 8, 1, 7, 2, 6])
    shard = packing.Shard(doc, term, np.ones(8), 4, np.full(4, 2), np.ones(16, np.float32), 2.0)
    first = list(packing.pack_shard(np.array([5, 5, 5, 5]), shard, 10))
    assert [sorted(d for d, _, _ in s) for s in first] == [[0, 2], [1, 3]]


def test_matroska_lacings():
    rng = random.Random(1)
    for n in (1, 3, 8, 9, 300):
        payload = rng.randbytes(576 * n)
        for lacing in ("fixed", "xiph", "ebml", "none"):
            data = matroska.mux(payload, lacing)
            media = matroska.demux(data)
            assert b"".join(data[p : p + k] for *_, p, k in media.packets) == payload
            assert [x[1] for x in media.packets] == [i * 72_000_000 for i in range(n)]
            assert media.doc_type == "matroska" and media.tracks[1]["codec"] == "A_PCM/INT/LIT"
            assert all(data[p : p + 4] == matroska.CLUSTER.to_bytes(4, "big") for _, _, p in media.cues) and media.cues


def test_matroska_unknown_sizes_groups_and_uneven_lacing():
    frames = [b"a" * 300, b"b" * 10, b"c" * 260]
    e, u = matroska.element, matroska.uint
    tracks = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, 2)))
    for lacing in ("xiph", "ebml"):
        block = matroska._block(2, 5, frames, lacing)
        body = block[1 + next(w for w in range(1, 9) if block[1] >> (8 - w)) :]
        cluster = u(matroska.TIMESTAMP, 7) + e(0xEC, b"void") + e(matroska.BLOCK_GROUP, e(matroska.BLOCK, body))
        unknown = b"\x01" + b"\xff" * 7
        data = e(matroska.EBML, e(matroska.DOC_TYPE, b"matroska")) + matroska.SEGMENT.to_bytes(4, "big") + unknown + tracks + matroska.CLUSTER.to_bytes(4, "big") + unknown + cluster + e(matroska.CLUSTER, u(matroska.TIMESTAMP, 9) + block)
        media = matroska.demux(data)
        assert [data[p : p + k] for *_, p, k in media.packets] == frames * 2
        assert [t for t, *_ in media.packets] == [2] * 6 and media.packets[0][1] == 12_000_000 and media.packets[3][1] == 14_000_000
    with pytest.raises(ValueError):
        matroska.demux(data[:-3])


def test_media_digests(edge_docs, no_docs):
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in matroska.media_digests(edge_docs).collect()), key=repr)
    want = []
    for r in edge_docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == sorted(want, key=repr)
    assert matroska.media_digests(no_docs).collect() == []
    assert matroska.packet_table(matroska.to_media(edge_docs.where("doc_id = 5"))).count() == 2


def test_packing_terms_are_exact(spark, path):
    """Every word has its own document frequency, however many words there are, and none matches another word."""
    words = ["q" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(300_000)]
    texts = [(i, " ".join(words[i::10])) for i in range(10)] * 2 + [(99, "lone")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    n_docs, mean, terms = packing.corpus_statistics(frame, path)
    term, df = packing._gathered(terms)
    assert (n_docs, mean) == (21, 600_001 / 21) and len(term) == 300_000 and (df == 2).all() and (term[1:] > term[:-1]).all()
    assert packing._looked_up(np.append(term[:2], np.uint64(5)), term, df).tolist() == [2, 2, 1]
    doc, at, tf = packing._doc_terms(np.array([5, 6, 5, 7]), np.array([0, 3, 4]))
    assert list(zip(doc, at, tf)) == [(0, 5, 2), (0, 6, 1), (1, 7, 1)]


@pytest.mark.parametrize("shard_docs", [7, 10**6])
def test_packing_is_the_same_however_many_terms_there_are(spark, path, shard_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = lambda **x: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in packing.pack(docs, path, shard_docs=shard_docs, **x).collect())
    few = packing.pack(docs, path, shard_docs=shard_docs, most_terms=10)
    assert pieces() == pieces(most_terms=10)
    per = few.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.count_distinct("offset").alias("o")).collect()
    assert all(r.k == r.o and (r.n == 2048 or r.n & (r.n - 1) == 0) for r in per)
    assert packing.pack(docs.limit(0), path, most_terms=-1).collect() == []


@pytest.mark.parametrize("dense", [1, 12, 10**9])
def test_scores_are_those_of_bm25(dense):
    """Every document's score for every seed, against the plain formula; so the neighbours are the best ones, all of them."""
    rng = np.random.default_rng(4)
    texts = [rng.zipf(1.3, rng.integers(1, 120)) % 60 for _ in range(50)]
    doc, term, tf = packing._doc_terms(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    lengths, n = np.array([len(t) for t in texts]), len(texts)
    df = np.array([sum(k in t for t in texts) for k in range(60)])
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shard = packing.Shard(doc, term, tf, n, lengths, idf, lengths.mean(), dense)
    for seed in range(n):
        want = [sum(idf[k] * (f := (t == k).sum()) * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(t) / lengths.mean())) for k in set(texts[seed].tolist()) if (t == k).any()) for t in texts]
        assert np.allclose(shard.scores(seed), want, rtol=1e-4)


def test_another_tokenizer_is_refused(path):
    from public_tokenizers import path as of

    from resolvent.llm._bpe import WordBPE

    WordBPE(path)
    with pytest.raises(ValueError):
        WordBPE(of("byte_bpe_50k.json"))


def test_broken_media_raise_and_null_media_have_no_figures(spark):
    data = matroska.mux(bytes(range(256)) * 9)
    for end in (1, 4, 5, 30, 60, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            matroska.demux(data[:end])
    rows = spark.createDataFrame([(1, 3, None), (2, 2304, data), (2, 2304, data)], "doc_id long, n_bytes long, media binary")
    got = sorted(((r.doc_id, r.payload_bytes, r.feature is None) for r in matroska.digests(rows).collect()))
    assert got == [(1, None, True), (2, 2304, False), (2, 2304, False)]
    packets = matroska.packet_table(rows).collect()
    assert len(packets) == 8 and all(data[r.offset : r.offset + r.size] == (bytes(range(256)) * 9)[576 * r.packet : 576 * r.packet + 576] for r in packets)
    assert sorted((r.packet, r.ns, r.track, r.key) for r in packets[:4]) == [(k, k * 72_000_000, 1, True) for k in range(4)]
