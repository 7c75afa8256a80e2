"""Media columns: FLAC streams of 8-bit mono samples, coded and decoded many frames at a time.

The work runs in numpy with one lane for each frame: step t of every lane at once. Rice codewords can
only be found one after another within a frame, but a seek table tells where every frame of every
stream begins, so a batch has thousands of lanes. Reading back checks each frame's CRC-8 and CRC-16 and
each stream's MD5; PCM blocks come with the sample they start at and their byte offset, to seek by.

Format: https://www.rfc-editor.org/rfc/rfc9639 (constant, verbatim, fixed and LPC subframes; Rice
partitions; no wasted bits, no escaped partitions).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans, text_buffer

BLOCK = 512
LPC_ORDER = 4
PRECISION = 8
RATE = 8000
#: Payload bytes to work on at a time.
CHUNK = 1 << 20
PAD = 64

# Fixed values of the format: predictors of orders 0 to 4, checksum polynomials, block size codes.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{8 + k: 256 << k for k in range(8)}}


def _crc_table(poly: int, width: int) -> np.ndarray:
    out, top = [], 1 << (width - 1)
    for c in range(256):
        c <<= width - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & (2 * top - 1)
        out.append(c)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(CRC8_POLY, 8), _crc_table(CRC16_POLY, 16)


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Checksum of data[start:start+size] for every lane."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.zeros(len(start), np.int64)
    mask = (1 << width) - 1
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for t, m in enumerate(live.tolist()):
        c = crc[:m]
        crc[:m] = (c << 8 & mask) ^ table[(c >> (width - 8)) ^ data[at[:m] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


class _Bits:
    """Big-endian fields of a byte array, read at many bit positions at once."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])

    def read(self, pos: np.ndarray, width) -> np.ndarray:
        """Fields of up to 24 bits."""
        p = pos >> 3
        d = self.data
        word = d[p].astype(np.int64) << 24 | d[p + 1].astype(np.int64) << 16 | d[p + 2].astype(np.int64) << 8 | d[p + 3]
        return word >> (32 - width - (pos & 7)) & ((1 << width) - 1 if isinstance(width, int) else (np.int64(1) << width) - 1)


def _put(bits: np.ndarray, pos: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[pos + j] = value >> (width - 1 - j) & 1


def _signed(x: np.ndarray, width) -> np.ndarray:
    half = np.int64(1) << (np.asarray(width, np.int64) - 1)
    return (x ^ half) - half


def _lpc(x: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of every lane, by Levinson-Durbin on the autocorrelation."""
    # sums of integers below 2**24 (2**53) are exact in either type, so a lane's result is its own
    f = x.astype(np.float32 if x.shape[1] <= 1024 else np.float64)
    auto = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(order + 1)], axis=1).astype(np.float64)
    auto[:, 0] = auto[:, 0] * (1 + 1e-6) + 1e-3
    a = np.zeros((len(x), order))
    err = auto[:, 0].copy()
    for i in range(order):
        k = (auto[:, i + 1] - sum(a[:, q] * auto[:, i - q] for q in range(i))) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-6)
    peak = np.maximum(np.abs(a).max(axis=1), 1e-9)
    limit = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.frexp(limit / peak)[1] - 1, 0, 12).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _predicted(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals of every lane; the first ``order`` columns are not residuals."""
    order = coef.shape[1]
    pred = np.zeros((len(x), x.shape[1] - order), np.int32)
    for i in range(order):
        pred += coef[:, i : i + 1].astype(np.int32) * x[:, order - 1 - i : x.shape[1] - 1 - i]
    out = np.zeros_like(x)
    out[:, order:] = x[:, order:] - (pred >> shift[:, None].astype(np.int32))
    return out


def _frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The format's variable-length code of frame numbers: bytes [lanes, 6] and their count."""
    size = 1 + sum((n >= 1 << b).astype(np.int64) for b in (7, 11, 16, 21, 26))
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(1, 7):
        m = size == k
        if m.any():
            x = n[m]
            out[m, 0] = x if k == 1 else (0xFF << (8 - k) & 0xFF) | x >> 6 * (k - 1)
            for j in range(1, k):
                out[m, j] = 0x80 | x >> 6 * (k - 1 - j) & 0x3F
    return out, size


def encode_many(payloads: list[bytes], block: int = BLOCK, lpc_order: int = LPC_ORDER, partition_order: int = 0) -> list[bytes]:
    """FLAC streams of the payloads' bytes, each stored as the sample byte - 128. A payload has at least
    one byte; equal payloads give equal streams, whatever they are coded together with."""
    if not 16 <= block <= 4096 or not 0 <= lpc_order <= 8 or block % (1 << partition_order) or block >> partition_order <= max(lpc_order, 4):
        raise ValueError("block, order or partitions out of range")
    if any(not p for p in payloads):
        raise ValueError("an empty payload has no samples")
    out: list[bytes] = []
    offs = np.cumsum([0] + [len(p) for p in payloads])
    for i, j in spans(offs, CHUNK):
        out += _encode(payloads[i:j], block, lpc_order, partition_order)
    return out


def _encode(payloads: list[bytes], block: int, lpc_order: int, partition_order: int) -> list[bytes]:
    size = np.array([len(p) for p in payloads], np.int64)
    frames = -(-size // block)
    lanes = int(frames.sum())
    doc = np.repeat(np.arange(len(size)), frames)
    number = np.arange(lanes) - np.repeat(np.cumsum(frames) - frames, frames)
    n = np.minimum(block, size[doc] - number * block)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    first = np.repeat(np.cumsum(size) - size, frames) + number * block
    inside = np.arange(block) < n[:, None]
    x = np.zeros((lanes, block), np.int32)
    x[inside] = raw[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int32) - 128

    # the predictor with the smallest residuals; short frames take order 0
    none = np.zeros(lanes, np.int64)
    choices = [(0, np.zeros((lanes, 0), np.int64), none), (1, np.tile(np.array(FIXED[1]), (lanes, 1)), none), (2, np.tile(np.array(FIXED[2]), (lanes, 1)), none)]
    if lpc_order:
        choices.append((lpc_order, *_lpc(x, n, lpc_order)))
    best, kind, resid = None, np.zeros(lanes, np.int64), None
    for c, (order, coef, shift) in enumerate(choices):
        r = _predicted(x, coef, shift)
        r[~inside] = 0
        cost = np.abs(r).sum(axis=1, dtype=np.int64) + 64 * order
        if c == 3:
            cost += 20 * order
        cost[n <= order + 8] += 0 if not order else 1 << 40
        if best is None:
            best, resid = cost, r
        else:
            better = cost < best
            best, kind = np.where(better, cost, best), np.where(better, c, kind)
            resid[better] = r[better]
    order = np.array([c[0] for c in choices])[kind]
    fold = np.where(resid < 0, -2 * resid - 1, 2 * resid)
    coded = inside & (np.arange(block) >= order[:, None])

    # a Rice parameter for each partition, the cheapest of three about its mean
    parts = np.where(n == block, 1 << partition_order, 1)
    width = block // parts
    part = np.arange(block) // width[:, None]
    slots = int(parts.max())
    flat = np.arange(lanes)[:, None] * slots + part
    count = np.bincount(flat[coded], minlength=lanes * slots)
    total = np.bincount(flat[coded], fold[coded], minlength=lanes * slots)
    guess = np.frexp(np.maximum(total / np.maximum(count, 1) * 0.7, 1))[1].astype(np.int64) - 1
    cheapest, k = None, None
    for delta in (-1, 0, 1):
        kk = np.clip(guess + delta, 0, 14)
        bits = np.bincount(flat[coded], fold[coded] >> kk[flat[coded]], minlength=lanes * slots) + count * (kk + 1)
        if cheapest is None:
            cheapest, k = bits, kk
        else:
            k, cheapest = np.where(bits < cheapest, kk, k), np.minimum(bits, cheapest)
    rice = cheapest.reshape(lanes, slots).sum(axis=1).astype(np.int64) + 6 + 4 * parts
    is_lpc = kind == 3
    body = 8 + 8 * order + np.where(is_lpc, 9 + PRECISION * order, 0) + rice
    same = (x == x[:, :1]) | ~inside
    constant = same.all(axis=1)
    verbatim = ~constant & (body >= 8 + 8 * n)
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    code = ~constant & ~verbatim

    # frame headers
    num, num_size = _frame_number(number)
    known = {v: c for c, v in BLOCK_CODES.items()}
    full = known.get(block)
    short = (n != block) | (full is None)
    extra = np.where(short, np.where(n <= 256, 1, 2), 0)
    head = 4 + num_size + extra + 1
    frame = head + (body + 7) // 8 + 2
    begin = np.cumsum(frame) - frame
    data_bits = np.zeros(int(frame.sum()) * 8, np.uint8)
    at = begin * 8
    _put(data_bits, at, np.full(lanes, 0xFFF8), 16)
    _put(data_bits, at + 16, np.where(short, np.where(n <= 256, 6, 7), full or 0) << 4 | 4, 8)
    _put(data_bits, at + 24, np.full(lanes, 0 << 4 | 1 << 1), 8)
    for b in range(6):
        m = num_size > b
        _put(data_bits, at[m] + 32 + 8 * b, num[m, b].astype(np.int64), 8)
    for w in (1, 2):
        m = extra == w
        _put(data_bits, at[m] + 32 + 8 * num_size[m], n[m] - 1, 8 * w)

    # subframes
    sub = at + 8 * head
    _put(data_bits, sub, np.where(constant, 0, np.where(verbatim, 1, np.where(is_lpc, 31 + order, 8 + order))) << 1, 8)
    pos = sub + 8
    byte = x & 0xFF
    _put(data_bits, pos[constant], byte[constant, 0], 8)
    if verbatim.any():
        where = (pos[verbatim][:, None] + 8 * np.arange(block))[inside[verbatim]]
        _put(data_bits, where, byte[verbatim][inside[verbatim]], 8)
    for o in range(int(order.max(initial=0))):
        m = code & (order > o)
        _put(data_bits, pos[m] + 8 * o, byte[m, o], 8)
    pos = pos + 8 * order
    if lpc_order:
        m = code & is_lpc
        coef, shift = choices[3][1], choices[3][2]
        _put(data_bits, pos[m], np.full(int(m.sum()), PRECISION - 1), 4)
        _put(data_bits, pos[m] + 4, shift[m], 5)
        for o in range(lpc_order):
            _put(data_bits, pos[m] + 9 + PRECISION * o, coef[m, o] & (1 << PRECISION) - 1, PRECISION)
        pos = pos + np.where(is_lpc, 9 + PRECISION * order, 0)
    _put(data_bits, pos[code] + 2, np.where(parts[code] > 1, partition_order, 0), 4)
    pos = pos + 6
    kept = coded[code]
    u, lane_flat = fold[code][kept].astype(np.int64), flat[code][kept]
    kk = k[lane_flat]
    starts = np.concatenate([[True], np.diff(lane_flat) != 0]) if len(lane_flat) else np.zeros(0, bool)
    q = u >> kk
    length = q + 1 + kk + 4 * starts
    per_lane = kept.sum(axis=1)
    ends = np.cumsum(length)
    before = np.concatenate([[0], ends])[np.cumsum(per_lane) - per_lane] if len(per_lane) else np.zeros(0, np.int64)
    word = ends - length + np.repeat(pos[code] - before, per_lane)
    _put(data_bits, word[starts], kk[starts], 4)
    stop = word + 4 * starts + q
    data_bits[stop] = 1
    for j in range(int(kk.max(initial=0))):
        m = kk > j
        data_bits[stop[m] + kk[m] - j] = u[m] >> j & 1
    data = np.packbits(data_bits)
    data[begin + head - 1] = _crc(data, begin, head - 1, _CRC8, 8)
    crc = _crc(data, begin, frame - 2, _CRC16, 16)
    data[begin + frame - 2], data[begin + frame - 1] = crc >> 8, crc & 0xFF

    # streams: marker, STREAMINFO, SEEKTABLE, frames
    out, whole = [], data.tobytes()
    last = np.cumsum(frames)
    point = np.zeros(lanes, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    point["sample"], point["n"] = number * block, n
    point["offset"] = begin - np.repeat(begin[last - frames], frames)
    for d, payload in enumerate(payloads):
        a, z = int(last[d] - frames[d]), int(last[d])
        pcm = np.frombuffer(payload, np.uint8) ^ 0x80
        seek = point[a:z].tobytes()
        info = struct.pack(">HH", block, block) + int(frame[a:z].min()).to_bytes(3, "big") + int(frame[a:z].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(pcm.tobytes()).digest()
        out.append(b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, whole[begin[a] : begin[z - 1] + frame[z - 1]]]))
    return out


class Stream:
    """What the metadata of a stream says."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, None
        while not last:
            last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            block = media[at + 4 : at + 4 + size]
            if kind == 0:
                word = int.from_bytes(block[10:18], "big")
                self.channels, self.bits, self.samples, self.md5 = (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                got = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
                self.points = got[got["sample"] != 0xFFFFFFFFFFFFFFFF]
            at += 4 + size
        self.frames_at = at
        if self.channels != 1 or self.bits != 8:
            raise ValueError("only 8-bit mono streams are read")

    def complete(self) -> bool:
        """Whether the seek table leads to every frame."""
        p = self.points
        return p is not None and len(p) > 0 and int(p["n"].astype(np.int64).sum()) == self.samples


def _decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames that begin at ``start`` -> samples (frame after frame), samples and bytes of each frame."""
    lanes = len(start)
    io = _Bits(data)
    d = io.data
    if ((d[start].astype(int) << 8 | d[start + 1]) != 0xFFF8).any() or ((d[start + 3] & 0xFF) != 2).any():
        raise ValueError("lost the frame sync, or not a mono 8-bit frame of fixed block size")
    code = d[start + 2] >> 4
    lead = d[start + 4]
    num = 1 + sum((lead >= x).astype(np.int64) for x in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE))
    at = start + 4 + num
    n = np.array([BLOCK_CODES.get(c, 0) for c in range(16)])[code]
    n = np.where(code == 6, d[at].astype(np.int64) + 1, np.where(code == 7, (d[at].astype(np.int64) << 8 | d[at + 1]) + 1, n))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0))
    rate = d[start + 2] & 15
    at = at + np.where(rate == 12, 1, np.where(rate > 12, 2, 0))
    if (_crc(d, start, at - start, _CRC8, 8) != d[at]).any():
        raise ValueError("frame header checksum differs")
    pos = (at + 1) * 8
    kind = io.read(pos, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits are not read")
    kind >>= 1
    pos = pos + 8
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    deep = int(order.max(initial=0))
    x = np.zeros((deep + int(n.max(initial=0)), lanes), np.int32)  # row deep + t holds residual t
    coef, shift = np.zeros((deep, lanes), np.int32), np.zeros(lanes, np.int32)
    for o in range(deep):
        m = np.flatnonzero(order > o)
        x[deep - order[m] + o, m] = _signed(io.read(pos[m] + 8 * o, 8), 8)
    pos = pos + 8 * order
    for p in range(1, 5):
        m = np.flatnonzero(fixed & (order == p))
        if len(m):
            coef[:p, m] = np.array(FIXED[p])[:, None]
    m = np.flatnonzero(lpc)
    if len(m):
        prec = io.read(pos[m], 4) + 1
        shift[m] = _signed(io.read(pos[m] + 4, 5), 5)
        if (shift < 0).any():
            raise ValueError("negative predictor shift")
        for o in range(deep):
            w = order[m] > o
            coef[o, m[w]] = _signed(io.read(pos[m[w]] + 9 + prec[w] * o, prec[w]), prec[w])
        pos[m] += 9 + prec * order[m]

    m = np.flatnonzero(constant)
    if len(m):
        x[deep:, m] = _signed(io.read(pos[m], 8), 8)
        pos[m] += 8
    m = np.flatnonzero(verbatim)
    if len(m):
        t = np.minimum(np.arange(int(n.max()))[:, None], n[m] - 1)
        x[deep:, m] = (d[(pos[m] >> 3) + t] ^ 0x80).astype(np.int32) - 128
        pos[m] += 8 * n[m]

    m = np.flatnonzero(fixed | lpc)
    if len(m):
        m = m[np.argsort(-(n[m] - order[m]), kind="stable")]
        method, po = io.read(pos[m], 2), io.read(pos[m] + 2, 4)
        if (method > 1).any():
            raise ValueError("reserved residual coding")
        pw = 4 + method
        p = pos[m] + 6
        need = n[m] - order[m]
        k = io.read(p, pw)
        p += pw
        if (k == (1 << pw) - 1).any():
            raise ValueError("escaped partitions are not read")
        edges: dict[int, list] = {}
        for lane in np.flatnonzero(po > 0).tolist():
            step = int(n[m[lane]]) >> int(po[lane])
            for e in range(step - int(order[m[lane]]), int(need[lane]), step):
                edges.setdefault(e, []).append(lane)
        bits = np.unpackbits(data)
        ones = np.append(np.flatnonzero(bits), len(bits)).astype(np.int32)
        rank = np.zeros(len(bits) + 64, np.int32)
        np.cumsum(bits, out=rank[1 : len(bits) + 1])
        rank[len(bits) + 1 :] = rank[len(bits)]
        del bits
        live = np.searchsorted(-need, -np.arange(int(need[0])), "left")
        stops, quot, ks = np.zeros((int(need[0]), len(m)), np.int32), np.zeros((int(need[0]), len(m)), np.int32), None
        if edges:
            ks = np.zeros((int(need[0]), len(m)), np.int8)
        p, k = p.astype(np.int32), k.astype(np.int32)
        for t, w in enumerate(live.tolist()):
            if t in edges:
                e = np.array(edges[t])
                k[e] = io.read(p[e].astype(np.int64), pw[e])
                p[e] += pw[e].astype(np.int32)
            at_ = p[:w]
            stop = ones[rank[at_]]
            stops[t, :w] = stop
            np.subtract(stop, at_, out=quot[t, :w])
            np.add(stop, k[:w] + 1, out=at_)
            if ks is not None:
                ks[t, :w] = k[:w]
        pos[m] = p
        wide = k.astype(np.int64) if ks is None else ks.astype(np.int64)
        for t0 in range(0, len(stops), 64):
            w = wide if ks is None else wide[t0 : t0 + 64]
            low = io.read(stops[t0 : t0 + 64].astype(np.int64) + 1, w)
            u = quot[t0 : t0 + 64].astype(np.int64) << w | low
            x[deep + t0 : deep + t0 + len(u), m] = (u >> 1) ^ -(u & 1)
        if (order[m] > 0).any():
            own = np.flatnonzero(order[m] > 0)
            own = own[np.argsort(-need[own], kind="stable")]
            lane = m[own]
            y, c, s = np.ascontiguousarray(x[:, lane]), np.ascontiguousarray(coef[:, lane]), shift[lane]
            live = np.searchsorted(-need[own], -np.arange(int(need[own[0]])), "left")
            for t, w in enumerate(live.tolist()):
                pred = c[0, :w] * y[deep + t - 1, :w]
                for o in range(1, deep):
                    pred += c[o, :w] * y[deep + t - 1 - o, :w]
                pred >>= s[:w]
                y[deep + t, :w] += pred
            x[:, lane] = y
    end = (pos + 7) // 8
    want = d[end].astype(np.int64) << 8 | d[end + 1]
    if (_crc(d, start, end - start, _CRC16, 16) != want).any():
        raise ValueError("frame checksum differs")
    flat = np.repeat((deep - order) * lanes + np.arange(lanes), n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * lanes
    return x.reshape(-1)[flat], n, end + 2 - start


def decode_many(media: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Payloads of FLAC streams and their blocks as (first sample, samples, byte offset of the frame).

    Streams without a full seek table are walked frame by frame. A checksum that differs, a frame out
    of place or samples other than the stream's MD5 raise ValueError.
    """
    out: list[tuple[bytes, list[tuple[int, int, int]]]] = []
    offs = np.cumsum([0] + [len(m) for m in media])
    for i, j in spans(offs, CHUNK):
        out += _decode(media[i:j])
    return out


def _decode(media: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    streams = [Stream(m) for m in media]
    data = np.frombuffer(b"".join(media), np.uint8)
    base = np.cumsum([0] + [len(m) for m in media])
    begin, count = [], []
    for k, s in enumerate(streams):
        at = base[k] + s.frames_at
        if s.complete():
            starts = at + s.points["offset"].astype(np.int64)
        else:
            walked, seen = [], 0
            while seen < s.samples:
                walked.append(at)
                _, n, size = _decode_frames(data[at : base[k + 1]], np.zeros(1, np.int64))
                seen, at = seen + int(n[0]), at + int(size[0])
            starts = np.array(walked, np.int64)
        begin.append(starts)
        count.append(len(starts))
    start = np.concatenate(begin)
    x, n, size = _decode_frames(data, start)
    last = np.cumsum(count)
    frame_at = np.cumsum(n) - n
    out = []
    for k, s in enumerate(streams):
        a, z = int(last[k] - count[k]), int(last[k])
        if int(n[a:z].sum()) != s.samples or (start[a:z] + size[a:z] != np.append(start[a + 1 : z], base[k + 1])).any():
            raise ValueError("frames do not make up the stream")
        pcm = x[frame_at[a] : frame_at[a] + s.samples].astype(np.int8)
        if hashlib.md5(pcm.tobytes()).digest() != s.md5:
            raise ValueError("decoded samples differ from the stream's MD5")
        first = (frame_at[a:z] - frame_at[a]).tolist()
        out.append(((pcm.view(np.uint8) ^ 0x80).tobytes(), list(zip(first, n[a:z].tolist(), (start[a:z] - base[k]).tolist()))))
    return out


def encode(payload: bytes, **options) -> bytes:
    return encode_many([payload], **options)[0]


def decode(media: bytes) -> bytes:
    return decode_many([media])[0][0]


def payload_of(text: bytes) -> bytes:
    """A text's bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % PAD if text else PAD)


def feature(payload: bytes) -> str:
    """Integer features of the samples: sum, energy, peak and sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    body, offs = text_buffer(batch.column(1))
    raw, at = body.tobytes(), offs.tolist()
    return [raw[a:z] for a, z in zip(at, at[1:])]


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each row's text as a FLAC stream. Null reads as empty; ids may be null."""

    def run(batches):
        for b in batches:
            texts = _texts(b)
            media = encode_many([payload_of(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``doc_id, block, first_sample, n_samples, byte_offset, pcm``: the checked blocks of every stream.

    Null media have no blocks; anything else that is not an intact stream fails the query.
    """
    names = ["doc_id", "block", "first_sample", "n_samples", "byte_offset", "pcm"]

    def run(batches):
        for b in batches:
            have = [k for k, v in enumerate(b.column(1)) if v.is_valid]
            rows, cols = [], [[] for _ in names[1:]]
            for k, (payload, blocks) in zip(have, decode_many([b.column(1)[k].as_py() for k in have])):
                for q, (first, n, at) in enumerate(blocks):
                    rows.append(k)
                    pcm = (np.frombuffer(payload[first : first + n], np.uint8) ^ 0x80).tobytes()
                    for c, v in zip(cols, (q, first, n, at, pcm)):
                        c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, f"doc_id {kind}, block int, first_sample long, n_samples int, byte_offset long, pcm binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each row's text, read the stored bytes back and describe both:
    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_blocks``."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"]

    def run(batches):
        for b in batches:
            body, offs = text_buffer(b.column(1))
            for i, j in spans(offs, CHUNK):
                texts = [body[offs[k] : offs[k + 1]].tobytes() for k in range(i, j)]
                media = encode_many([payload_of(t) for t in texts])
                rows = []
                for text, m, (payload, blocks) in zip(texts, media, decode_many(media)):
                    rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload), len(blocks)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(c) for c in zip(*rows)]], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
