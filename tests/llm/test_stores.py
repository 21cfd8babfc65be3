"""Archives and the vector index."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prismata.llm import topk, warc


def pages(spark):
    big = "<p>" + "x" * 500 + "</p>"
    rows = [(3, "http://a/ b\r\nX: y", big, "k"), (1, "http://a", big, "k"), (2, None, big, "k"), (4, "u", None, "k"), (5, "u", "", "k"), (6, "u", "tiny", "k"), (7, "u", "tiny", "k"), (8, "ü", "é" * 300_000, "k"), (9, "u", "a\r\n\r\nWARC/1.1\r\n" * 30, "k"), (None, "u", big, "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, kind string")


def back(spark, files):
    return {r.name: r for r in warc.read_warc(spark, files).collect()}


def test_round_trip(spark, tmp_path):
    for compress in (True, False):
        files = warc.write_warc(pages(spark), f"file://{tmp_path}/w{compress}", segment_bytes=2000, compress=compress)
        got = back(spark, files)
        want = [r for r in pages(spark).collect() if r.page_id is not None]
        assert len(got) == len(want)
        for r in want:
            g = got[f"urn:page:{r.page_id}"]
            raw = (r.html or "").encode()
            assert g.payload_bytes == len(raw) and g.payload_digest == hashlib.sha256(raw).hexdigest()
            revisit = r.page_id in (2, 3)
            assert g.kind == ("revisit" if revisit else "response") and g.refers_to == ("urn:page:1" if revisit else None)
            assert g.url == (r.url or "") and (revisit or bytes(g.payload) == raw)
        assert warc.quarantine_log(spark, files).collect() == []


def test_nothing(spark, tmp_path):
    files = warc.write_warc(pages(spark).limit(0), f"file://{tmp_path}/none")
    assert files.collect() == [] and warc.read_warc(spark, files).collect() == []


def test_salvage_of_broken_archives():
    rng = random.Random(3)
    for gzip in (True, False):
        raws = []
        for i in range(12):
            html = rng.randbytes(rng.randrange(50, 2000))
            raws.append(warc.record(i, f"u{i}", html, hashlib.sha256(html).hexdigest(), None, len(html)))
        parts = [warc.member(r) if gzip else r for r in raws]
        whole = b"".join(parts)
        assert [r["name"] for r in warc.salvage(whole)[0]] == [f"urn:page:{i}" for i in range(12)]
        starts = np.cumsum([0, *map(len, parts)]).tolist()
        for trial in range(40):
            data, hurt = bytearray(whole), rng.randrange(12)
            kind = trial % 3
            if kind == 0:  # a flipped byte within the record's block
                data[starts[hurt + 1] - 6] ^= 0xFF
            elif kind == 1:  # bytes cut out
                del data[starts[hurt] + 20 : starts[hurt] + len(parts[hurt]) // 2]
            else:  # rubbish between records
                data[starts[hurt] : starts[hurt]] = b"\x1f\x8b\x08rubbish WARC/1.0\r\n"
            records, gaps = warc.salvage(bytes(data), gzip)
            names = [r["name"] for r in records]
            want = [f"urn:page:{i}" for i in range(12) if kind == 2 or i != hurt]
            assert names == want
            assert len(gaps) == 1 and gaps[0][0] <= starts[hurt] + 20 and sum(b - a for a, b, _ in gaps) + sum(r["end"] - r["start"] for r in records) == len(data)
        cut, log = warc.salvage(whole[: starts[7] + 10], gzip)
        assert len(cut) == 7 and log[0][:2] == (starts[7], starts[7] + 10)


def test_salvage_when_the_start_is_damaged():
    """What an archive begins with does not decide what is looked for after the damage."""
    raws = [warc.record(i, f"u{i}", b"page %d" % i, hashlib.sha256(b"page %d" % i).hexdigest(), None, 6) for i in range(6)]
    whole = b"".join(map(warc.member, raws))
    for data in (b"\0\0" + whole[2:], b"rubbish" + whole, b"WARC/1.1 rubbish" + whole, raws[0][:40] + b"".join(map(warc.member, raws[1:]))):
        records, gaps = warc.salvage(data)
        assert [r["name"] for r in records][-5:] == [f"urn:page:{i}" for i in range(1, 6)]
        assert len(gaps) == 1 and gaps[0][0] == 0 and gaps[0][1] == min(r["start"] for r in records)
    records, gaps = warc.salvage(whole + raws[0] + whole)
    assert len(records) == 13 and gaps == []


def test_records_of_other_writers():
    """Digests in other algorithms and encodings, header names in any case and spacing, several records a member."""
    payload = b"<p>other</p>"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload

    def made(name, block_digest, payload_digest, broken=b""):
        head = f"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID:   <urn:{name}>\r\nWarc-Target-Uri: http://a/\r\n b\r\ncontent-length:{len(block)}\r\nWARC-Block-Digest: {block_digest}\r\nWARC-Payload-Digest: {payload_digest}\r\n\r\n"
        return head.encode() + (block if not broken else broken + block[len(broken) :]) + b"\r\n\r\n"

    b32 = lambda name, data: f"{name}:" + base64.b32encode(hashlib.new(name, data).digest()).decode()
    good = [
        made("a", b32("sha1", block), b32("sha1", payload)),
        made("b", "sha1:" + hashlib.sha1(block).hexdigest().upper(), "md5:" + hashlib.md5(payload).hexdigest()),
        made("c", "sha-256:" + hashlib.sha256(block).hexdigest(), b32("sha256", payload).rstrip("=")),
        made("d", "blake9:abc", "blake9:abc"),
    ]
    bad = [made("x", b32("sha1", block), "", b"HTTP/1.1 404"), made("y", "", b32("sha1", payload + b"!")), made("z", "sha1:short", "")]
    for raw in (b"".join(good), b"".join(map(warc.member, good)), warc.member(b"".join(good))):
        records, gaps = warc.salvage(raw)
        assert [r["name"] for r in records] == ["urn:a", "urn:b", "urn:c", "urn:d"] and gaps == []
        assert all(r["payload"] == payload and r["kind"] == "response" and r["url"] == "http://a/ b" for r in records)
    for raw in bad:
        for data in (raw, warc.member(raw)):
            records, gaps = warc.salvage(data)
            assert records == [] and "digest differs" in gaps[0][2]
    records, gaps = warc.salvage(warc.member(good[0] + bad[0] + good[1]))
    assert [r["name"] for r in records] == ["urn:a", "urn:b"] and len(gaps) == 1


def test_top_k_of_large_components(spark):
    x = [[2.9e6, 1.0, -1e6], [1.0, 2.0, 3.0], [-2e6, 0.5, 0.25], [2e6, -1e6, 4.0], [0.0, 0.0, 1.0]]
    df = spark.createDataFrame([(100 * i if i < 2 else i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ids = [0, 100, 2, 3, 4]
    ints = [[int(np.floor(1024 * c)) for c in v] for v in x]
    want = set()
    for q in (0, 100):
        near = sorted((-sum(a * b for a, b in zip(ints[ids.index(q)], ints[ids.index(j)], strict=True)), j) for j in ids if j != q)
        want |= {(q, r, j, -s) for r, (s, j) in enumerate(near, 1)}
    assert {tuple(r) for r in topk.top_k(df, F.pmod("id", F.lit(100)) == 0).collect()} == want


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 24)) / 5
    x[300:360] = x[0]  # ties
    rows = [(i, [float(v) for v in row], "c") for i, row in enumerate(x)]
    rows += [(1000, None, "c"), (1100, [1.0, None, 2.0], "c"), (1200, [float("nan")] * 24, "c"), (1300, [float("inf")] + [0.0] * 23, "c"), (1400, [], "c"), (1500, [1.0, 2.0], "c"), (1600, [0.5, 0.5], "c"), (None, [0.1] * 24, "c"), (5, [float(v) for v in x[5]], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    ints = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for q, a in ints:
        if q % 100 == 0:
            near = sorted((-int(a @ b), j) for j, b in ints if j != q and len(a) == len(b))[:10]
            want |= {(q, r, j, -s) for r, (s, j) in enumerate(near, 1)}
    for block in (topk.BLOCK, 100):
        got = topk.top_k(df, F.pmod("id", F.lit(100)) == 0, block=block, queries=3)
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


def test_bit_sliced_sums():
    rng = np.random.default_rng(6)
    rows = rng.integers(-1024, 1025, (130, 9))
    index = topk.BitSliced(rows, dropped=0)
    for q in rng.integers(-1024, 1025, (5, 9)):
        slices, constant = index.sums(q)
        bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little")[:130] for s in slices]).astype(object)
        total = sum(b * (1 << i) for i, b in enumerate(bits)) - constant
        assert (total == ((rows - index.low) @ q)).all()
    assert Counter(map(len, [index.rows])) == {130: 1}
