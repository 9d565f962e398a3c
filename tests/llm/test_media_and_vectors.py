"""FLAC round trips and damage, and recall of the vector search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import additive_ann, flac

SF = "/root/testdata/sf0.01"


def samples():
    draw = np.random.default_rng(1)
    wave = np.clip(128 + 100 * np.sin(np.arange(9000) / 20) + draw.normal(0, 2, 9000), 0, 255).astype(np.uint8)
    return [b"\0" * 64, bytes(range(256)) * 5, b"\7" * 5000, draw.integers(0, 256, 3000, dtype=np.uint8).tobytes(), wave.tobytes(), b"a" * 64 + b"b", b"x", b"ab" * 700, (b"\0" * 900 + b"\xff") * 40, b""]


def pcm(x):
    return (x.view(np.uint8) ^ 0x80).tobytes()


def test_round_trip():
    streams = flac.encode(samples())
    assert [pcm(x) for x in flac.decode(streams)] == samples()
    kinds = set()
    for m in streams:
        n, _, points, begin = flac.stream_parts(m)
        assert sum(p[2] for p in points) == n
        for _, offset, _ in points:
            head = begin + offset + 4
            while m[head] & 0xC0 == 0x80 or head == begin + offset + 4:
                head += 1
            kinds.add(m[head + 3] >> 1)
    assert 0 in kinds and 1 in kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)


def test_checksums_are_those_of_the_format():
    data = np.frombuffer(b"123456789", np.uint8)
    at = np.array([0]), np.array([9])
    assert flac.CRC8.of(data, *at)[0] == 0xF4 and flac.CRC16.of(data, *at)[0] == 0xFEE8


@pytest.mark.parametrize("where", [3, 30, 60, -3, -200, -1200])
def test_damage_is_found(where):
    whole = flac.encode([samples()[4]])[0]
    bad = bytearray(whole)
    bad[where] ^= 0x10
    (x,) = flac.decode([bytes(bad)])
    assert isinstance(x, flac.Damaged) or pcm(x) != samples()[4] or where == 30
    assert all(isinstance(x, flac.Damaged) for x in flac.decode([whole[: len(whole) // 2], b"", b"fLaC", whole[:100]]))


def test_digest_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in flac.query(spark, SF).collect():
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64) if data else bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.n_blocks, r.last_sample) == (-(-len(padded) // 4096), (len(padded) - 1) // 4096 * 4096)


def test_flac_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "long " * 50_000, 5), (4, "x" * 64, 5), (4, "x" * 64, 5)], "doc_id bigint, text string, media int")
    media = flac.with_media(df)
    rows = media.select("doc_id", flac.digest("media").alias("d")).collect()
    assert [r.d.payload_bytes for r in rows] == [64, 64, 250_048, 64, 64] and rows[0].d == rows[1].d and rows[3].d == rows[4].d
    blocks = flac.pcm_blocks(media, "doc_id").where("doc_id IS NULL").orderBy("block_no").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0") == b"long " * 50_000 and [b.first_sample for b in blocks] == [4096 * k for k in range(len(blocks))]
    hurt = flac.pcm_blocks(media.where("doc_id = 2").withColumn("media", F.lit(b"junk")), "doc_id").collect()
    assert len(hurt) == 1 and hurt[0].error == "no stream marker" and hurt[0].pcm is None
    assert flac.with_media(df.limit(0)).count() == 0


def brute(vectors, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ vectors[q]
        other = ids != q
        order = np.lexsort((ids[other], -s[other]))[:k]
        out[int(q)] = ids[other][order].tolist()
    return out


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    expected = brute(vectors, 20)
    got = {}
    for r in additive_ann.query(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-9
    hits = [len({v for _, v, _ in got[q]} & set(e)) / len(e) for q, e in expected.items()]
    assert np.mean(hits) >= 0.9
    for found in got.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:], strict=False))


def test_neighbours_beyond_the_first_list(spark):
    draw = np.random.default_rng(7)
    for n in (300, 1200, 3000):
        x = draw.normal(size=(n, 24))
        x[n // 2 : n // 2 + 40] = x[20]  # ties
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = {}
        for r in additive_ann.search(df, F.col("vec_id") % 20 == 0, k=20, reranked=20).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        expected = {}
        for q in range(0, n, 20):
            s = sum(x[:, d] * x[q, d] for d in range(24))
            order = np.lexsort((np.arange(n), -s))
            expected[q] = [int(i) for i in order if i != q][:20]
        assert got == expected


def test_search_edge_cases(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=4).tolist(), 1, 2) for i in range(60)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0], 1, 2) for i in range(100, 140)]  # one vector many times: ties go to smaller ids
    rows += [(200, None, 1, 2), (201, [], 1, 2), (220, [0.0] * 4, 1, 2), (240, [float("nan"), 1.0, 1.0, 1.0], 1, 2), (260, [1.0, None, 1.0, 1.0], 1, 2), (280, [1.0] * 5, 1, 2), (None, [1.0] * 4, 1, 2), (100, [1.0, 0.0, 0.0, 0.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, v int, rank int")
    got = {}
    for r in additive_ann.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == [0, 20, 40, 100, 120]
    vectors = {r[0]: np.array(r[1]) for r in rows[:100]}
    assert got == brute(vectors, 20)
    assert additive_ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in additive_ann.search(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4.0)]


def test_beam_search_beats_greedy():
    x = np.random.default_rng(0).normal(size=(2000, 16))
    books = additive_ann.fit_codebooks(x, books=4, words=32)
    error = {b: float(((x - additive_ann.decode(additive_ann.encode(x, books, b), books)) ** 2).sum()) for b in (1, 8)}
    assert error[8] < error[1] < float((x**2).sum())


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""
        return self

    def rice(self, value, k):
        folded = value << 1 if value >= 0 else -2 * value - 1
        return self.put(1, (folded >> k) + 1).put(folded, k)

    def done(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits or "0", 2).to_bytes(len(self.bits) // 8, "big")


def crc(data, width, poly):
    rest = 0
    for byte in data:
        rest ^= byte << (width - 8)
        for _ in range(8):
            rest = (rest << 1 ^ poly if rest >> (width - 1) else rest << 1) & ((1 << width) - 1)
    return rest


def other_encoder(x, draw, sums=True):
    """A stream of frames of changing sizes, kinds, partitions, Rice and escape codes, and no seek table."""
    at, number, frames = 0, 0, b""
    while at < len(x):
        size = min(draw.choice([16, 192, 256, 576]), len(x) - at)
        own = [int(v) for v in x[at : at + size]]
        head, extra = Writer().put(0x7FFC, 15).put(1, 1), None
        code = {192: 1, 256: 8, 576: 2}.get(size, 6 if size <= 256 else 7)
        head.put(code, 4).put(draw.choice([0, 4]), 4).put(0, 4).put(draw.choice([0, 1]), 3).put(0, 1)
        head.bits += "".join(format(b, "08b") for b in flac.utf8_number(number))
        if code in (6, 7):
            head.put(size - 1, 8 * (code - 5))
        made = head.done()
        made += bytes([crc(made, 8, 0x07)])
        body, kind = Writer(), draw.choice(["verbatim", "fixed", "fixed", "lpc"])
        if kind == "verbatim" or size < 5:
            body.put(1 << 1, 8)
            for v in own:
                body.put(v, 8)
        else:
            order = draw.randrange(0, 5) if kind == "fixed" else draw.randrange(1, 5)
            coefs, shift = (flac.FIXED[order], 0) if kind == "fixed" else ([draw.randrange(-7, 8) for _ in range(order)], 3)
            body.put((8 + order if kind == "fixed" else 31 + order) << 1, 8)
            for v in own[:order]:
                body.put(v, 8)
            if kind == "lpc":
                body.put(4, 4).put(shift, 5)
                for c in coefs:
                    body.put(c, 5)
            rest = [own[i] - (sum(c * own[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, size)]
            parts = draw.choice([p for p in (0, 1, 2, 3) if size % (1 << p) == 0 and size >> p >= order])
            wide = draw.randrange(2)
            body.put(wide, 2).put(parts, 4)
            for k in range(1 << parts):
                n = (size >> parts) - (order if k == 0 else 0)
                mine, rest = rest[:n], rest[n:]
                if draw.random() < 0.3:
                    body.put((1 << (4 + wide)) - 1, 4 + wide).put(14, 5)
                    for r in mine:
                        body.put(r, 14)
                else:
                    rice = draw.randrange(2, 8)
                    body.put(rice, 4 + wide)
                    for r in mine:
                        body.rice(r, rice)
        made += body.done()
        frames += made + crc(made, 16, 0x8005).to_bytes(2, "big")
        at, number = at + size, number + 1
    md5 = hashlib.md5(x.astype(np.int8).tobytes()).digest() if sums else bytes(16)
    info = (16).to_bytes(2, "big") + (576).to_bytes(2, "big") + bytes(6) + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + md5
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + frames


def test_streams_of_other_encoders():
    draw = random.Random(12)
    waves = [np.clip(np.cumsum([draw.randrange(-9, 10) for _ in range(n)]), -128, 127).astype(np.int8) for n in (1, 5, 300, 2000, 5000)]
    streams = [other_encoder(x, draw, sums=k % 2 == 0) for k, x in enumerate(waves) for _ in range(3)]
    for x, got in zip([x for x in waves for _ in range(3)], flac.decode(streams), strict=True):
        assert not isinstance(got, flac.Damaged), got
        assert (got == x).all()
    mixed = flac.encode([b"own stream " * 40]) + streams[-1:]
    assert [isinstance(x, flac.Damaged) for x in flac.decode(mixed)] == [False, False]
    for _ in range(40):  # any flipped bit is noticed
        bad = bytearray(streams[draw.choice([6, 9, 12])])
        bad[draw.randrange(42, len(bad))] ^= 1 << draw.randrange(8)
        assert isinstance(flac.decode([bytes(bad)])[0], flac.Damaged)
    assert isinstance(flac.decode([streams[-1][:-30]])[0], flac.Damaged)
