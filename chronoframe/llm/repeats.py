"""Exact substring dedup: maximal repeat groups from an enhanced suffix array.

A byte is removed when a string of ``SPAN`` bytes that covers it also starts in a document with a
smaller id. A suffix array of a whole corpus has a suffix for every byte, so suffixes are first thinned
without losing a match:

1. Every window of ``SPAN`` bytes has a smallest hashed 16-gram, its anchor; equal windows have equal
   anchors. About one byte in 18 is an anchor.
2. A task collapses anchors with equal context (34 bytes each side) to its smallest document, and the
   buckets to which anchors are dealt collapse them to the corpus's smallest: all further copies are
   removed over the whole context. So a group of copies costs a row for each task, not for each copy.
3. What is left of an anchor that has several contexts, of which two agree on 17 bytes on one side (two
   that share a window must), are fragments of at most 84 bytes. Per bucket they form an enhanced
   suffix array: suffixes in order with their common prefixes. Its intervals are scanned with a stack,
   and those whose occurrences differ in the byte before them, or begin a fragment, are maximal
   repeats, given with all occurrences. Every occurrence in a document above the group's smallest is
   removed. Windows shared by two documents extend to a maximal repeat that holds both, so
   the union over groups is exact.

Fragments are compared by their bytes. Contexts are compared by hashes: 48 bits of the gram, 30 of the near
halves, and 96 independent ones of the gram, both sides whole and their lengths. Contexts that agree on the
gram and a near half are so told apart by 96 bits at least; 10**12 different contexts of one anchor would
meet a wrong match with odds of 1 to 10**5. Windows of crowded anchors are compared by 128 bits and the key.

Contexts of a crowded anchor are dealt by the 17 bytes beside it, on each side on which others agree with them;
only those that very many agree on are cut into windows.

An anchor with very many different contexts (a licence line amid different texts) is dealt by context
instead of by key, so no task gathers it. Such keys are found in a sample of ``SAMPLED`` of all distinct
texts; the sample decides where rows are compared and never what is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEALT, Scratch, deal, free_shuffles, give_back, pack, spans, text_buffer, tidy, unpack
from .common import dealt_again as _dealt_again
from .common import fan as _fan

SPAN = 50
GRAM = 16
SIDE = SPAN - GRAM
HALF = SIDE // 2
WIDTH = SPAN + SIDE
#: Anchors that a task gathers before it collapses and deals them, and that a bucket is to get.
AT_ONCE = 900_000
BUCKET = 550_000
#: Contexts of one anchor, or of one of its near halves, that a task compares at most, and fragments that it sorts at once.
CROWD = 2_000
SORTED = 8_000
#: Share of the texts in which hot keys are looked for, and the sampled contexts that make a key hot: one of
#: about BUCKET contexts in all.
SAMPLED, HOT = 1 / 40_000, 16
#: Ids up to which a set of documents is broadcast to thin texts before they are shuffled.
FEW = 1_000_000
#: Bytes of the input to a file of a written table, two for each core at least. For each local file the JVM forks a chmod
#: where Hadoop has no native library, and until that starts the fork counts all memory of the JVM again.
EACH = 96 << 20
#: Anchors are many to a bucket, so this many times as many buckets as elsewhere are dealt at once: a second
#: dealing would hold each anchor on disk twice.
FANS = 8

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(*words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.astype(np.uint64, copy=False)) * _A
        h ^= h >> np.uint64(29)
        h *= _B
        h ^= h >> np.uint64(32)
    return h


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over every run of n."""
    size = 1
    while size * 2 <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _words(b: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word at every position but the last seven."""
    w = b.astype(np.uint64)
    for size in (1, 2, 4):
        w = w[:-size] << np.uint64(8 * size) | w[size:]
    return w


def anchors(body: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of the texts: row, pos, left and right context bytes, key (48 bits of the gram), context, far.

    The context word has 16 bits for the near half of each side (0 where a text ends earlier) and 32
    for the whole of both sides with their lengths; far has 64 more for those and the gram.
    """
    size = np.diff(offs)
    gap = SIDE + 8
    shift = offs[:-1] + gap * np.arange(1, len(size) + 1)  # where a text begins in the padded buffer
    buf = np.zeros(int(offs[-1] - offs[0]) + gap * (len(size) + 1) + 16, np.uint8)
    for a, z, s in zip(offs[:-1].tolist(), offs[1:].tolist(), shift.tolist()):
        buf[s : s + z - a] = body[a:z]
    w = _words(buf)
    h = w[:-8] * _A
    h ^= h >> np.uint64(31)
    h ^= w[8:] * _B
    h *= _A
    h ^= h >> np.uint64(30)
    h *= _B
    h |= np.uint64(1)
    low = _slide(h, SIDE + 1, np.minimum)  # of the window of SPAN bytes that starts here
    valid = np.zeros(len(low) + 1, np.int8)
    some = size >= SPAN
    np.add.at(valid, shift[some], 1)
    np.add.at(valid, (shift + size - SPAN + 1)[some], -1)
    low[np.cumsum(valid[:-1]) == 0] = 0
    high = _slide(np.concatenate([np.zeros(SIDE, np.uint64), low, np.zeros(SIDE, np.uint64)]), SIDE + 1, np.maximum)
    at = np.flatnonzero(high[: len(h)] == h[: len(high)])
    row = np.searchsorted(shift, at, "right") - 1
    left = np.minimum(at - shift[row], SIDE)
    right = np.minimum(shift[row] + size[row] - at - GRAM, SIDE)
    near_l = _mix(w[at - 8], w[at - 16], w[at - HALF])
    near_r = _mix(w[at + GRAM], w[at + GRAM + 8], w[at + GRAM + HALF - 8])
    whole = (near_l, near_r, w[at - 24], w[at - 32], w[at - SIDE], w[at + 32], w[at + 40], w[at + GRAM + SIDE - 8], left * 64 + right)
    short = _mix(*whole)
    far = _mix(w[at] ^ _B, w[at + 8], *whole[::-1])
    bits = np.uint64(0xFFFF)
    context = (short & np.uint64(0xFFFFFFFF)) | np.where(left >= HALF, (near_l & bits) | np.uint64(1), 0).astype(np.uint64) << np.uint64(48) | np.where(right >= HALF, (near_r & bits) | np.uint64(1), 0).astype(np.uint64) << np.uint64(32)
    return {"row": row, "pos": at - shift[row], "left": left, "right": right, "key": h[at] >> np.uint64(16), "context": context, "far": far}


def fan(parts: int) -> int:
    return _fan(parts, FANS)


def dealt_again(rows: DataFrame, parts: int, own: dict) -> DataFrame:
    return _dealt_again(rows, parts, own, FANS)


def _new(*cols: np.ndarray) -> np.ndarray:
    """Where any sorted column changes."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def collapse(ids: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns ``same`` and the id, and in it the smallest id of the rows that agree on them."""
    order = np.lexsort((ids, *same[::-1]))
    first = np.flatnonzero(_new(*[x[order] for x in same]))
    return order, np.repeat(ids[order][first], np.diff(np.append(first, len(order))))


def merged(ids, ths, start, end) -> tuple[np.ndarray, ...]:
    """Maximal runs of each document's spans."""
    order = np.lexsort((start, ths, ids))
    ids, ths, start, end = ids[order], ths[order], start[order], end[order]
    doc = np.cumsum(_new(ids, ths)) if len(ids) else ids
    reach = np.maximum.accumulate(end + doc * np.int64(1 << 40))
    fresh = _new(doc)
    if len(doc):
        fresh[1:] |= start[1:] + doc[1:] * np.int64(1 << 40) > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(ids)) - 1 if len(first) else first
    return ids[first], ths[first], start[first], reach[last] - doc[first] * np.int64(1 << 40)


def _windows(words: np.ndarray, key: np.ndarray, starts: int, by: np.uint64 = _A) -> np.ndarray:
    """Hash of the SPAN bytes from every start of every fragment, [fragments, starts]."""
    h = np.repeat(key[:, None], starts, axis=1)
    for k in (*range(0, SPAN - 8, 8), SPAN - 8):
        h = (h ^ words[:, k : k + starts]) * by
        h ^= h >> np.uint64(29)
    return h * _B


def maximal_repeats(frag: np.ndarray, length: np.ndarray, group: np.ndarray, least: int = SPAN) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of the fragments within each group, as (length, fragments, starts) with all
    occurrences. ``frag`` is [fragments, WIDTH] bytes of which ``length`` count. A start of a fragment
    has no byte before it and so differs from every other."""
    flat = np.zeros((len(frag), WIDTH + 8), np.uint8)
    flat[:, :WIDTH] = frag
    flat[:, :WIDTH][np.arange(WIDTH) >= length[:, None]] = 0
    w = _words(flat.reshape(-1))
    f, s = np.nonzero(np.arange(WIDTH - least + 1) <= (length - least)[:, None])
    if least == SPAN and len(f):
        grid = np.zeros(flat.size, np.uint64)
        grid[: len(w)] = w
        h = _windows(grid.reshape(flat.shape), _mix(group), WIDTH - SPAN + 1)[f, s]
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(_new(h[order]))
        before = np.where(s > 0, flat[f, np.maximum(s - 1, 0)].astype(np.int64), 256 + np.arange(len(f)))[order]
        mixed = np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)
        keep = np.sort(order[np.repeat(mixed, np.diff(np.append(first, len(order))))])
        f, s = f[keep], s[keep]
    if len(f) < 2:
        return []
    base = f * (WIDTH + 8) + s
    rest = length[f] - s
    steps = -(-WIDTH // 8)
    words = [np.where(8 * k < rest, w[np.minimum(base + 8 * k, len(w) - 1)], 0) for k in range(steps)]
    # a word may reach into the next fragment's bytes only beyond WIDTH, where all is zero
    order = np.lexsort((rest, *words[::-1], group[f]))
    f, s, rest = f[order], s[order], rest[order]
    lcp, same = np.zeros(len(f), np.int64), group[f][1:] == group[f][:-1]
    for k in range(steps):
        x = words[k][order]
        d = x[1:] ^ x[:-1]
        step = np.full(len(d), 8)
        for byte in range(8):
            step[(d >> np.uint64(8 * byte)) & np.uint64(255) > 0] = 7 - byte
        lcp[1:] += np.where(same, step, 0)
        same &= d == 0
    lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[1:], rest[:-1]))
    before = np.where(s > 0, flat[f, np.maximum(s - 1, 0)].astype(np.int64), 256 + np.arange(len(f)))
    run = np.flatnonzero((lcp[1:] >= least) & (lcp[:-1] < least)) if len(lcp) > 1 else []
    ends = np.flatnonzero((lcp >= least) & (np.append(lcp[1:], 0) < least)) + 1
    if len(run):
        cuts = np.column_stack([run, ends]).reshape(-1)
        pad = np.append(before, 0)
        low, high = np.minimum.reduceat(pad, cuts)[::2], np.maximum.reduceat(pad, cuts)[::2]
        keep = low != high
        run, ends = run[keep], ends[keep]
    out = []
    for a, z in zip(run.tolist() if len(run) else [], ends.tolist() if len(run) else []):
        out += [(n, f[i:j], s[i:j]) for n, i, j in _intervals(lcp[a + 1 : z].tolist(), a, before, least)]
    return out


def _intervals(lcp: list[int], a: int, before: np.ndarray, least: int):
    """Left-diverse common-prefix intervals (length, first, end), by a stack scan."""
    stack: list[tuple[int, int]] = []
    for k, h in enumerate([*lcp, 0]):
        first = k
        while stack and stack[-1][0] > h:
            n, first = stack.pop()
            i, j = a + first, a + k + 1
            b = before[i:j]
            if n >= least and (b != b[0]).any():
                yield n, i, j
        if h and (not stack or stack[-1][0] < h):
            stack.append((h, first))


_ANCHOR = [(np.uint8, 6), (np.uint64, 1), (np.uint64, 1), (np.uint8, 1), (np.uint8, 1), (np.uint16, 1), (np.uint32, 1), (np.int64, 1), (np.uint16, 1), (np.uint16, 1), (np.uint8, 1), (np.uint8, 1)]
_MARK = [(np.int64, 1), (np.int64, 1), (np.uint32, 1), (np.uint32, 1)]
_ASK = [(np.int64, 1), (np.int64, 1), (np.uint32, 1), (np.uint64, 1), (np.int8, 1)]
_WINDOW = [(np.uint64, 1), (np.uint64, 1), (np.uint64, 1), (np.int64, 1), (np.int64, 1), (np.uint32, 1)]
_FRAG = [(np.uint64, 1), (np.int64, 1), (np.int64, 1), (np.uint32, 1), (np.uint8, 1), (np.uint8, WIDTH)]
#: Kinds of dealt rows: anchors by key, spans by document, requests by document, fragments by key, windows of
#: crowded keys by their hash, anchors of hot keys by context.
ANCHORS, MARKS, ASKS, FRAGS, WINDOWS, SPLIT = range(6)


def _doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _key_part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)


def _hash_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _six(key: np.ndarray) -> np.ndarray:
    return key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]


def _of_six(six: np.ndarray) -> np.ndarray:
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, 2:] = six
    return eight.reshape(-1).view(">u8").astype(np.uint64)


def _cut(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids as columns of 1, 1, 2 and 4 bytes, of which all but the first hardly change among sorted ids."""
    x = ids.view(np.uint64)
    return x.astype(np.uint8), (x >> np.uint64(8)).astype(np.uint8), (x >> np.uint64(16)).astype(np.uint16), (x >> np.uint64(32)).astype(np.uint32)


def _whole(*cuts: np.ndarray) -> np.ndarray:
    return sum(x.astype(np.uint64) << np.uint64(by) for x, by in zip(cuts, (0, 8, 16, 32))).view(np.int64)


def _near_half(frag: np.ndarray, start: np.ndarray, key: np.ndarray, side: int) -> np.ndarray:
    """A name for the fragments of one key that agree on the near half that begins at ``start``."""
    near = np.zeros((len(frag), 24), np.uint8)
    near[:, :HALF] = np.take_along_axis(frag, start.astype(np.int64)[:, None] + np.arange(HALF), 1)
    return _mix(key ^ np.uint64(side << 60), *near.view(np.uint64).T)


def _owners(parts: int) -> dict:
    """For ``dealt_again``: the columns of each kind and the bucket of a row."""
    by_doc = lambda ids, *_: _doc_part(ids, parts)
    return {
        ANCHORS: (_ANCHOR, lambda six, *_: _key_part(_of_six(six), parts)),
        MARKS: (_MARK, by_doc),
        ASKS: (_ASK, by_doc),
        FRAGS: (_FRAG, lambda key, *_: _key_part(key, parts)),
        WINDOWS: (_WINDOW, lambda h, *_: _hash_part(h, parts)),
        SPLIT: (_ANCHOR, lambda six, context, far, *_: _hash_part(far, parts)),
    }


def _marks(parts: int, ids, ths, start, end):
    ids, ths, start, end = merged(ids, ths, np.asarray(start, np.int64), np.asarray(end, np.int64))
    return deal(MARKS, _doc_part(ids, parts) // fan(parts), ids, ths, start.astype(np.uint32), end.astype(np.uint32))


def hot_keys(facts: DataFrame) -> np.ndarray:
    """Keys of which the sampled texts hold ``HOT`` or more different contexts (sorted)."""

    def run(batches):
        for b in batches:
            body, offs = text_buffer(b.column(0))
            for i, j in spans(offs, 1 << 18):
                a = anchors(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([pa.array(a["key"].view(np.int64)), pa.array(_mix(a["context"], a["far"]).view(np.int64))], names=["key", "context"])

    found = facts.where("sample is not null").select("sample").mapInArrow(run, "key long, context long").distinct().groupBy("key").count().where(F.col("count") >= HOT)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64))


def _gather(parts: int, at_once: int, hot: np.ndarray):
    """Texts -> collapsed anchors by key or, of hot keys, by context, and spans that a task could settle."""

    def dealt(kind: int, part: np.ndarray, c: dict):
        return deal(kind, part // fan(parts), _six(c["key"]), c["context"], c["far"], *_cut(c["id"]), c["th"], (c["pos"] & 0xFFFF).astype(np.uint16), (c["pos"] >> 16).astype(np.uint16), c["left"].astype(np.uint8), c["right"].astype(np.uint8))

    def flush(held):
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order, least = collapse(c["id"], c["key"], c["context"], c["far"])
        c = {k: v[order] for k, v in c.items()}
        copy = c["id"] > least
        yield _marks(parts, c["id"][copy], c["th"][copy], (c["pos"] - c["left"])[copy], (c["pos"] + GRAM + c["right"])[copy])
        c = {k: v[~copy] for k, v in c.items()}
        by_doc = np.lexsort((c["pos"], c["th"], c["id"]))
        c = {k: v[by_doc] for k, v in c.items()}
        if len(hot):
            split = hot[np.minimum(np.searchsorted(hot, c["key"]), len(hot) - 1)] == c["key"]
            own = {k: v[split] for k, v in c.items()}
            yield dealt(SPLIT, _hash_part(own["far"], parts), own)
            c = {k: v[~split] for k, v in c.items()}
        yield dealt(ANCHORS, _key_part(c["key"], parts), c)

    def run(batches):
        held, n = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            ths = b.column(1).to_numpy(zero_copy_only=False)
            body, offs = text_buffer(b.column(2))
            for i, j in spans(offs, 1 << 18):
                a = anchors(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row = a.pop("row") + i
                held.append(a | {"id": ids[row], "th": ths[row]})
                n += len(row)
                if n >= at_once:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _settle(parts: int, crowd_from: int):
    """A bucket's anchors -> spans of further copies and requests for the texts about the rest."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == MARKS:
            return table
        six, context, far, *cuts, ths, lo, hi, left, right = unpack([x.as_py() for x in table.column("blob")], _ANCHOR)
        key, ids = _of_six(six), _whole(*cuts)
        del six, cuts
        pos = lo.astype(np.int64) | hi.astype(np.int64) << 16
        order, least = collapse(ids, key, context, far)
        key, context, far, ids, ths, pos, left, right = (x[order] for x in (key, context, far, ids, ths, pos, left.astype(np.int64), right.astype(np.int64)))
        copy = ids > least
        out = [_marks(parts, ids[copy], ths[copy], (pos - left)[copy], (pos + GRAM + right)[copy])]
        if kind == SPLIT:  # further contexts of the key are in other buckets: all windows are compared
            ask, how = ~copy, np.full(len(ids), 3, np.int8)
        else:
            # contexts of one key of which two agree on a near half
            first = np.flatnonzero(_new(key, context, far))
            shared, wide = np.zeros((2, len(first)), np.int8)
            for flag, bits in ((1, np.uint64(48)), (2, np.uint64(32))):
                half = context[first] >> bits & np.uint64(0xFFFF)
                o = np.lexsort((half, key[first]))
                new = np.flatnonzero(_new(key[first][o], half[o]))
                size = np.repeat(np.diff(np.append(new, len(o))), np.diff(np.append(new, len(o))))
                agree = (size > 1) & (half[o] > 0)
                shared[o] |= flag * agree.astype(np.int8)
                wide[o] |= flag * (agree & (size > crowd_from)).astype(np.int8)
            own = np.flatnonzero(_new(key[first]))
            crowd = np.repeat(np.add.reduceat(shared > 0, own, dtype=np.int64), np.diff(np.append(own, len(first)))) > crowd_from
            times = np.diff(np.append(first, len(key)))
            ask = np.repeat(shared > 0, times) & ~copy
            how = np.repeat(np.where(crowd, wide | (shared & ~wide) << 2, 0), times).astype(np.int8)
        out.append(deal(ASKS, _doc_part(ids[ask], parts) // fan(parts), ids[ask], ths[ask], pos[ask].astype(np.uint32), key[ask], how[ask]))
        return pa.Table.from_batches(out)

    return run


def _asked(table: pa.Table) -> pa.Table:
    """Requests of a document bucket -> one row for each document."""
    ids, ths, pos, key, how = unpack([x.as_py() for x in table.column("blob")], _ASK)
    order = np.lexsort((pos, ths, ids))
    ids, ths, pos, key, how = (x[order] for x in (ids, ths, pos, key, how))
    first = np.flatnonzero(_new(ids, ths))
    end = np.append(first[1:], len(ids))
    blobs = [pack(pos[a:z], key[a:z], how[a:z]) for a, z in zip(first, end)]
    return pa.table({"doc_id": ids[first], "th": ths[first], "ask": pa.array(blobs, pa.binary())})


def _fetch(parts: int):
    """Texts with their requests -> fragments by key bucket."""

    def run(batches):
        held, n = [], 0

        def flush():
            how, key, ids, ths, start, length, anchor, frag = (np.concatenate(x) for x in zip(*held))
            few, before, after = (np.flatnonzero(x) for x in (how == 0, how & 4, how & 8))
            own = np.concatenate([few, before, after])
            group = np.concatenate([key[few], _near_half(frag[before], anchor[before] - HALF, key[before], 1), _near_half(frag[after], anchor[after] + GRAM, key[after], 2)])
            yield deal(FRAGS, _key_part(group, parts) // fan(parts), group, ids[own], ths[own], start[own], length[own], frag[own])
            many = (how & 3) > 0
            if not many.any():
                return
            flat = np.zeros((int(many.sum()), WIDTH + 8), np.uint8)
            flat[:, :WIDTH] = frag[many]
            grid = np.zeros(flat.size, np.uint64)
            w = _words(flat.reshape(-1))
            grid[: len(w)] = w
            grid = grid.reshape(flat.shape)
            left = anchor[many].astype(np.int64)[:, None] - np.arange(SIDE + 1)  # context bytes before the gram
            flag = how[many][:, None]
            ok = (left >= 0) & (np.arange(SIDE + 1) + SPAN <= length[many][:, None])
            ok &= ((flag & 1) > 0) & (left >= HALF) | ((flag & 2) > 0) & (SIDE - left >= HALF)
            f, s = np.nonzero(ok)
            one, two = (_windows(grid, key[many], SIDE + 1, by)[f, s] for by in (_A, _C))
            key, ids, ths, pos = key[many][f], ids[many][f], ths[many][f], start[many][f].astype(np.int64) + s
            order, least = collapse(ids, one, two, key)
            one, two, key, ids, ths, pos = (x[order] for x in (one, two, key, ids, ths, pos))
            copy = ids > least
            yield _marks(parts, ids[copy], ths[copy], pos[copy], pos[copy] + SPAN)
            keep = ~copy
            yield deal(WINDOWS, _hash_part(one[keep], parts) // fan(parts), one[keep], two[keep], key[keep], ids[keep], ths[keep], pos[keep].astype(np.uint32))

        for b in batches:
            body, offs = text_buffer(b.column(2))
            for k in range(b.num_rows):
                pos, key, how = unpack([b.column(3)[k].as_py()], [(np.uint32, 1), (np.uint64, 1), (np.int8, 1)])
                text = np.zeros(int(offs[k + 1] - offs[k]) + 2 * WIDTH, np.uint8)
                text[: offs[k + 1] - offs[k]] = body[offs[k] : offs[k + 1]]
                start = np.maximum(pos.astype(np.int64) - SIDE, 0)
                length = np.minimum(pos.astype(np.int64) + SPAN, offs[k + 1] - offs[k]) - start
                frag = text[start[:, None] + np.arange(WIDTH)]
                ids, ths = (np.full(len(pos), b.column(c)[k].as_py(), np.int64) for c in (0, 1))
                held.append((how, key, ids, ths, start.astype(np.uint32), length.astype(np.uint8), (pos.astype(np.int64) - start).astype(np.uint8), frag))
                n += len(pos)
                if n >= 60_000:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _compare(parts: int, at_once: int):
    """A key bucket's fragments -> spans, through the maximal repeats of its keys; the windows of crowded
    keys, which are the common-prefix intervals of length SPAN, -> spans by their smallest document."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == MARKS:
            return table
        if kind == WINDOWS:
            one, two, key, ids, ths, pos = unpack([x.as_py() for x in table.column("blob")], _WINDOW)
            order, least = collapse(ids, one, two, key)
            far = ids[order] > least
            at = pos[order][far].astype(np.int64)
            return pa.Table.from_batches([_marks(parts, ids[order][far], ths[order][far], at, at + SPAN)])
        key, ids, ths, start, length, frag = unpack([x.as_py() for x in table.column("blob")], _FRAG)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(_new(key[order]))
        edge = np.append(edge, len(order))
        marks: list[tuple] = []
        a = 0
        while a < len(edge) - 1:  # whole keys, SORTED fragments at a time, CROWD more at most
            z = max(a + 1, int(np.searchsorted(edge, edge[a] + at_once, "right")) - 1)
            mine = order[edge[a] : edge[z]]
            for n, f, s in maximal_repeats(frag[mine], length[mine].astype(np.int64), key[mine]):
                doc = ids[mine[f]]
                far = doc > doc.min()
                if far.any():
                    at = start[mine[f]].astype(np.int64)[far] + s[far]
                    marks.append((doc[far], ths[mine[f]][far], at, at + n))
            a = z
        cols = [np.concatenate(c) for c in zip(*marks)] if marks else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_batches([_marks(parts, *cols)])

    return run


def _union(table: pa.Table) -> pa.Table:
    """Spans of a document bucket -> one row for each document, runs merged."""
    ids, ths, start, end = unpack([x.as_py() for x in table.column("blob")], _MARK)
    ids, ths, start, end = merged(ids, ths, start.astype(np.int64), end.astype(np.int64))
    first = np.flatnonzero(_new(ids, ths))
    last = np.append(first[1:], len(ids))
    total = np.add.reduceat(end - start, first) if len(first) else first
    blobs = [pack(start[a:z], end[a:z]) for a, z in zip(first, last)]
    return pa.table({"doc_id": ids[first], "th": ths[first], "n_removed": total.astype(np.int64), "n_spans": (last - first).astype(np.int64), "runs": pa.array(blobs, pa.binary())})


def _thinned(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted`` on (doc_id, th); where few are wanted, others are not shuffled."""
    ids = wanted.select("doc_id").distinct()
    if ids.count() <= FEW:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(wanted, ["doc_id", "th"])


def _told_apart(rows: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """``rows(doc_id, th, ...)`` with th 0 where an id has one text, so that it takes no room; ids with unlike texts
    are the ``n`` of ``repeated``. Where these are many, all rows keep th."""
    if n > FEW:
        return rows
    if not n:
        return rows.withColumn("th", F.lit(0).cast("long"))
    told = rows.join(F.broadcast(repeated.withColumn("again", F.lit(True))), "doc_id", "left")
    return told.withColumn("th", F.when(F.col("again"), F.col("th")).otherwise(F.lit(0))).select(rows.columns)


def removed_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, documents, runs): ``doc_id, th, text`` and ``doc_id, th, n_bytes, sha256`` of each row, and
    ``doc_id, th, n_removed, n_spans, runs`` of each distinct document that loses bytes (th hashes the text
    where an id has several)."""
    scratch = scratch or Scratch(df.sparkSession, "repeats", lean=True)
    scratch.sized(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), EACH)
    give_back(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sampled = F.pmod(F.xxhash64("th"), F.lit(1 << 30)) < int(SAMPLED * (1 << 30))
    facts = scratch.table(docs.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"), F.when(sampled, F.col("text")).alias("sample")))
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(4, -(-total // (BUCKET * 18)))
    repeated = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min("th").alias("a"), F.max("th").alias("z")).where("a <> z").select("doc_id")
    repeated = scratch.table(repeated)
    n = repeated.count()
    facts = _told_apart(facts, repeated, n)
    docs = _told_apart(docs.where("doc_id is not null"), repeated, n)
    own, hot = _owners(parts), hot_keys(facts)
    give_back(df.sparkSession)
    given = dealt_again(docs.mapInArrow(tidy(_gather(parts, AT_ONCE, hot)), DEALT), parts, own)
    found = scratch.table(dealt_again(given.groupBy("kind", "part").applyInArrow(_settle(parts, CROWD), DEALT), parts, own))
    del given
    free_shuffles(df.sparkSession)
    give_back(df.sparkSession)
    wanted = scratch.table(found.where(f"kind = {ASKS}").groupBy("part").applyInArrow(_asked, "doc_id long, th long, ask binary"))
    frags = dealt_again(_thinned(docs, wanted).select("doc_id", "th", "text", "ask").mapInArrow(tidy(_fetch(parts)), DEALT), parts, own)
    more = dealt_again(frags.groupBy("kind", "part").applyInArrow(_compare(parts, SORTED), DEALT), parts, own)
    runs = found.where(f"kind = {MARKS}").unionByName(more).groupBy("part").applyInArrow(_union, "doc_id long, th long, n_removed long, n_spans long, runs binary")
    runs = scratch.table(runs)
    scratch.drop(found)
    scratch.drop(wanted)
    del frags, more
    free_shuffles(df.sparkSession)
    give_back(df.sparkSession)
    return docs, facts.drop("sample"), runs


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``df``.

    Ids are integers. Null text reads as empty; rows with a null id neither lose bytes nor take any from
    others. Rows with the same id do not take bytes from each other, whether their texts are equal or not.
    """
    scratch = Scratch(df.sparkSession, "repeats", lean=True)
    docs, facts, runs = removed_runs(df, id_col, text_col, scratch)
    once = facts.select("doc_id", "th", "n_bytes").distinct()
    whole = runs.join(once, ["doc_id", "th"])
    part = scratch.table(whole.where("n_removed < n_bytes").select("doc_id", "th", "runs"))

    def run(batches):
        for b in batches:
            body, offs = text_buffer(b.column(2))
            out = []
            for k in range(b.num_rows):
                raw = body[offs[k] : offs[k + 1]].tobytes()
                start, end = unpack([b.column(3)[k].as_py()], [(np.int64, 1), (np.int64, 1)])
                keep = zip([0, *end.tolist()], [*start.tolist(), len(raw)])
                out.append(hashlib.sha256(b"".join(raw[a:z] for a, z in keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["doc_id", "th", "kept"])

    kept = _thinned(docs, part).select("doc_id", "th", "text", "runs").mapInArrow(run, "doc_id long, th long, kept string").distinct()
    lost = whole.drop("n_bytes", "runs").join(kept, ["doc_id", "th"], "left").withColumn("kept", F.coalesce("kept", F.sha2(F.lit(""), 256)))
    out = facts.join(lost, ["doc_id", "th"], "left")
    out = out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"))
    # the caller's writing may fork the executors for each file, so their joins are over and their heaps small by then
    out = scratch.table(out)
    scratch.drop(part)
    scratch.drop(runs)
    free_shuffles(df.sparkSession)
    give_back(df.sparkSession)
    return out
