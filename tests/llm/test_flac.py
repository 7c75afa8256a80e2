import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoframe.llm.flac import FIXED, Stream, decode, decode_many, encode, encode_many, feature, payload_of, pcm_blocks, round_trip, store


class Reader:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self):
        n = self.bits.index("1", self.at) - self.at
        self.at += n + 1
        return n


def crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def slow_decode(media):
    """A decoder straight from the format's description, bit by bit."""
    assert media[:4] == b"fLaC"
    at, last = 4, 0
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        if kind == 0:
            md5 = media[at + 22 : at + 38]
        at += 4 + size
    out, kinds = [], set()
    while at < len(media):
        r = Reader(media[at : at + 9000])
        assert r.take(16) == 0xFFF8
        code, _ = r.take(4), r.take(4)
        assert r.take(8) == 2
        lead = r.take(8)
        more = 0 if lead < 128 else f"{lead:08b}".index("0") - 1
        r.take(8 * more)
        n = {6: lambda: r.take(8) + 1, 7: lambda: r.take(16) + 1}.get(code, lambda: 256 << (code - 8))()
        assert crc(media[at : at + r.at // 8], 7, 8) == r.take(8)
        assert r.take(1) == 0
        kind = r.take(6)
        assert r.take(1) == 0
        kinds.add(min(kind, 32))
        if kind == 0:
            x = [r.signed(8)] * n
        elif kind == 1:
            x = [r.signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [r.signed(8) for _ in range(order)]
            coef, shift = FIXED[order] if kind < 32 else None, 0
            if kind >= 32:
                prec = r.take(4) + 1
                shift = r.signed(5)
                coef = [r.signed(prec) for _ in range(order)]
            assert r.take(2) == 0
            po = r.take(4)
            for part in range(1 << po):
                k = r.take(4)
                for _ in range((n >> po) - (order if part == 0 else 0)):
                    u = r.unary() << k | r.take(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(c * v for c, v in zip(coef, x[::-1])) >> shift))
        out += x
        end = -(-r.at // 8)
        assert crc(media[at : at + end], 0x8005, 16) == int.from_bytes(media[at + end : at + end + 2], "big")
        at += end + 2
    pcm = bytes(v & 255 for v in out)
    assert hashlib.md5(pcm).digest() == md5
    return bytes(b ^ 128 for b in pcm), kinds


def samples():
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n)).encode()
    return [b"\0" * 64, b"a", bytes(range(256)) * 3, rng.randbytes(700), text(400), text(3), b"ab" * 900, bytes(128 + int(60 * __import__("math").sin(k / 9)) for k in range(2000)), text(60000)]


def test_streams_read_alike_by_a_plain_decoder():
    seen = set()
    for options in ({}, {"block": 256, "lpc_order": 8, "partition_order": 3}, {"block": 100, "lpc_order": 0}, {"block": 4096, "lpc_order": 2, "partition_order": 1}):
        payloads = samples()[:-1]
        for p, m, (got, blocks) in zip(payloads, media := encode_many(payloads, **options), decode_many(media)):
            want, kinds = slow_decode(m) if options.get("block") != 100 else (p, set())
            seen |= kinds
            assert got == want == p
            assert [b[0] for b in blocks] == list(range(0, len(p), options.get("block", 512)))
        assert media == [encode(p, **options) for p in payloads]  # what it is coded with does not matter
    assert {0, 1, 32} <= seen and seen & {8, 9, 10}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=1500), min_size=1, max_size=5), st.sampled_from([(16, 0, 0), (256, 4, 0), (512, 4, 2)]))
def test_round_trip(payloads, options):
    block, lpc, parts = options
    media = encode_many(payloads, block=block, lpc_order=lpc, partition_order=parts)
    assert [p for p, _ in decode_many(media)] == payloads


def test_long_frame_numbers():
    p = samples()[-1]
    assert len(p) > 2100 * 128
    for block in (128, 512):
        m = encode(p, block=block)
        assert decode(m) == p
    m = encode(p[: 150 * 16], block=16, lpc_order=0)
    assert slow_decode(m)[0] == p[: 150 * 16]


def test_damage_is_found_and_seek_points_lead_to_frames():
    media = encode(samples()[4])
    s = Stream(media)
    for at in (s.frames_at + 5, s.frames_at + 60, len(media) - 1):
        with pytest.raises((ValueError, IndexError)):
            decode(media[:at] + bytes([media[at] ^ 4]) + media[at + 1 :])
    for p in s.points:
        assert media[s.frames_at + int(p["offset"])] == 0xFF
    bare = media[:4] + b"\x80" + media[5:42] + media[s.frames_at :]  # no seek table
    assert Stream(bare).points is None and decode(bare) == samples()[4]
    with pytest.raises(ValueError):
        decode(b"OggS")


def test_tables(spark):
    rows = [(None, "x"), (1, None), (2, ""), (3, "héllo " * 5000), (4, "same"), (4, "same"), (5, "a" * 64)]
    df = spark.createDataFrame([(*r, b"q") for r in rows], "doc_id long, text string, media binary")
    got = round_trip(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        p = payload_of((t or "").encode())
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert len(p) % 64 == 0 and len(p) > 0 and r["tail_crc32"] == zlib.crc32(p[-64:]) and r["feature"] == feature(p)
        m = encode(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
    blocks = pcm_blocks(store(df)).where("doc_id = 3").orderBy("first_sample").collect()
    assert bytes(b ^ 128 for r in blocks for b in r["pcm"]) == payload_of(("héllo " * 5000).encode())
    assert round_trip(df.where("false")).count() == 0
    assert pcm_blocks(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0
