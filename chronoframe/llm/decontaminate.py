"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``11011`` hashes the words under its ones and ignores those under its zeros, so a
substituted word spoils only the windows that look at it. Items and documents are hashed under every
mask; equal hashes give alignments (document word minus item word), and each aligned item is then
compared word by word around the hit. Words are the runs left after A-Z is lower-cased and ASCII
punctuation and white space are cut away.

The masks miss no item that has ``OVERLAP`` (0.8) of its words in place. Of L words at most L // 5 are then
substituted, which leaves runs with L - L // 5 words in all. The masks find any run of four words, and any
two runs of four words together with one substitution between; with every run below four and every two
neighbours below four together, s substitutions leave at most 3 * ceil((s + 1) / 2) words, fewer than there
are from L = 7 on; 5 and 6 words are checked by cases. Items of under five words allow no substitution and
are hashed whole. ``tests`` try every placement for 1 to 20 words.

A benchmark of up to ``BROADCAST`` bytes is indexed at once and sent to all tasks: one pass over the
documents, without a shuffle of texts. A larger one stays a table of seed hashes: one pass
over the documents keeps the words whose hash passes a filter of the benchmark's hashes, and those are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, Scratch, small, spans, text_buffer, tidy

MASKS = ("1111", "10111", "11011", "11101")
#: Items of fewer words than a mask's ones are hashed whole.
WHOLE = ("1", "11", "111")
OVERLAP = 0.8
#: Bytes and items of a benchmark that is indexed at once, and the most bits of the filter of a larger one.
BROADCAST, MOST_ITEMS = 16 << 20, 30_000
FILTER_BITS = 1 << 30
#: Alignments of one item at most so many words apart count together (words put in or left out).
DRIFT = 8

_CUT = WORDS.tobytes()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_CUT).split()


def _ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window under a mask."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 7919 + mask.count("1"), np.uint64)
    for k, at in enumerate(i for i, c in enumerate(mask) if c == "1"):
        out = (out ^ (ids[at : at + n] * _ODD[k % len(_ODD)])) * _ODD[(k + 3) % len(_ODD)]
        out ^= out >> np.uint64(29)
    return out


def _masks(words: int) -> tuple[str, ...]:
    """The masks under which an item of so many words is hashed."""
    return (WHOLE[words - 1],) if 0 < words <= len(WHOLE) else tuple(m for m in MASKS if len(m) <= words)


@dataclass
class Index:
    """Seed hashes of some items, sorted, with the item and word each begins at."""

    items: list
    ids: list[np.ndarray]
    masks: list[str]
    hashes: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Index:
        if len(rows) > 0x7FFF:
            raise ValueError("too many items for one index")
        items, ids, hs, own, at, masks = [], [], [], [], [], set()
        for item, text in rows:
            got = _ids(words_of((text or "").encode()))
            if not len(got):
                continue
            for mask in _masks(len(got)):
                h = _seeds(got, mask)
                hs.append(h)
                own.append(np.full(len(h), len(items), np.int32))
                at.append(np.arange(len(h), dtype=np.int32))
                masks.add(mask)
            items.append(item)
            ids.append(got)
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        size = 1 << max(16, min(27, int(len(h) * 32).bit_length()))
        bits = np.zeros(size, bool)
        bits[h & np.uint64(size - 1)] = True
        return cls(items, ids, sorted(masks), h[order], np.concatenate(own)[order] if hs else np.zeros(0, np.int32), np.concatenate(at)[order] if hs else np.zeros(0, np.int32), bits)

    def alignments(self, ids: np.ndarray, row_of=None, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, item, shift) of all equal hashes; a shift is document word minus item word.

        Hits are expanded ``at_once`` at a time, so a text of one repeated word stays small.
        """
        keys = []
        for mask in self.masks:
            h = _seeds(ids, mask)
            p = np.flatnonzero(self.bits[h & np.uint64(len(self.bits) - 1)])
            lo, hi = np.searchsorted(self.hashes, h[p], "left"), np.searchsorted(self.hashes, h[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            part = np.cumsum(n) // at_once
            for cut in np.split(np.arange(len(p)), np.flatnonzero(np.diff(part)) + 1) if len(p) else []:
                m = n[cut]
                k = np.repeat(lo[cut] - np.cumsum(m) + m, m) + np.arange(m.sum())
                pos = np.repeat(p[cut], m)
                row = row_of(pos) if row_of else np.zeros(len(pos), np.int64)
                keys.append(np.unique(row.astype(np.int64) << 44 | self.owner[k].astype(np.int64) << 29 | (pos - self.at[k] + (1 << 28))))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return key >> 44, key >> 29 & 0x7FFF, (key & (1 << 29) - 1) - (1 << 28)

    def likely(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, row: np.ndarray, own: np.ndarray, shift: np.ndarray, overlap: float, at_once: int = 1 << 22) -> np.ndarray:
        """Which alignments are of a (row, item) whose alignments together have the words for an overlap."""
        size = np.array([len(x) for x in self.ids], np.int64)
        flat, begins = np.concatenate([*self.ids, np.zeros(1, np.uint64)]), np.concatenate([[0], np.cumsum(size)])
        same = np.zeros(len(row), np.int64)
        for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(size[own]) // at_once)) + 1) if len(row) else []:
            n = size[own[cut]]
            which, step = np.repeat(np.arange(len(cut)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = shift[cut][which] + step
            inside = (at >= first[row[cut]][which]) & (at < end[row[cut]][which])
            equal = inside & (ids[np.where(inside, at, 0)] == flat[begins[own[cut]][which] + step])
            same[cut] = np.bincount(which, equal, minlength=len(cut)).astype(np.int64)
        pair = row.astype(np.int64) << 16 | own
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        total = np.add.reduceat(same, new) if len(new) else same
        return np.repeat(total >= overlap * size[own[new]] - 1e-9, np.diff(np.append(new, len(pair))))


def _overlap(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int]:
    """Most item words that equal the document's under alignments close together, and where they begin."""
    best, first = 0, 0
    recent: list[tuple[int, np.ndarray]] = []
    for s in shifts.tolist():
        a, b = max(0, -s), min(len(item), len(doc) - s)
        same = np.zeros(len(item), bool)
        if b > a:
            same[a:b] = item[a:b] == doc[s + a : s + b]
        recent = [x for x in recent if s - x[0] <= DRIFT] + [(s, same)]
        n = int(np.logical_or.reduce([x[1] for x in recent]).sum())
        if n > best:
            best, first = n, max(0, recent[0][0])
        if best == len(item):
            break
    return best, first


def _matched(ids: np.ndarray, index: Index, overlap: float, own: np.ndarray, shift: np.ndarray) -> list[tuple]:
    out = []
    for k in np.unique(own).tolist():
        item = index.ids[k]
        n, start = _overlap(ids, item, shift[own == k])
        if n >= overlap * len(item) - 1e-9:
            out.append((index.items[k], n / len(item), n, len(item), start))
    return out


def overlaps(text: bytes, index: Index, overlap: float = OVERLAP) -> list[tuple]:
    """(item, overlap, matched words, item words, first word) for each item that the text holds."""
    ids = _ids(words_of(text))
    return _matched(ids, index, overlap, *index.alignments(ids)[1:])


def _scan(texts: pa.Array, index: Index, overlap: float):
    """(row, matches) for the rows of an Arrow column that hold an item."""
    body, offs = text_buffer(texts)
    for i, j in spans(offs, 1 << 20):
        docs = [words_of(body[offs[k] : offs[k + 1]].tobytes()) for k in range(i, j)]
        ids = _ids([w for d in docs for w in d])
        ends = np.cumsum([len(d) for d in docs])
        row, own, shift = index.alignments(ids, lambda pos: np.searchsorted(ends, pos, "right"))
        begins = ends - [len(d) for d in docs]
        good = index.likely(ids, begins, ends, row, own, shift, overlap)
        row, own, shift = row[good], own[good], shift[good]
        edge = np.searchsorted(row, np.arange(len(docs) + 1))
        for r in np.unique(row).tolist():
            first, mine = int(begins[r]), slice(edge[r], edge[r + 1])
            # a window over a border gives an alignment that the comparison rejects
            if m := _matched(ids[first : ends[r]], index, overlap, own[mine], shift[mine] - first):
                yield i + r, m


_MATCH = ["overlap", "n_matched", "n_words", "first_word"]
_MATCH_TYPES = [T.StructField("overlap", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in _MATCH[1:]]]


def _searched(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")


def _small(items: DataFrame, at_once: int, most: int) -> Index | None:
    """The whole benchmark's index, where its size is within the bounds."""
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if size[0] > min(most, 0x7FFF) or size[1] > at_once:
        return None
    return Index.of([tuple(r) for r in items.collect()])


def _filter_of(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit for each ``hash`` of a table (packed), put together by pieces of 2**23 bits."""
    piece = min(bits, 1 << 23)

    def mark(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            which = (at // np.uint64(piece)).astype(np.int64)
            for k in np.unique(which).tolist():
                held.setdefault(k, np.zeros(piece, bool))[(at[which == k] % np.uint64(piece)).astype(np.int64)] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["k", "x"])

    def join(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("x")])
        return pa.table({"k": table.column("k")[:1], "x": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((bits // piece, piece // 8), np.uint8)
    few = seeds.select("hash").coalesce(16).mapInArrow(mark, "k long, x binary")
    for r in few.groupBy("k").applyInArrow(join, "k long, x binary").toLocalIterator():
        out[r["k"]] = np.frombuffer(r["x"], np.uint8)
    return out.reshape(-1)


def _by_join(docs: DataFrame, items: DataFrame, overlap: float, scratch: Scratch) -> DataFrame:
    """``docs(th, size, text)``, texts named by two hashes -> ``th, size, item_id`` and the match, for a
    benchmark that stays a table. Every text is read once for its hits and, if it has any, once more."""
    kind = items.schema["item_id"]
    items = scratch.table(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").alias("item_text")))

    def seeds_of(batches):
        for b in batches:
            body, offs = text_buffer(b.column(1))
            for k, item in enumerate(b.column(0).to_pylist()):
                got = _ids(words_of(body[offs[k] : offs[k + 1]].tobytes()))
                for mask in _masks(len(got)) if len(got) else ():
                    h = _seeds(got, mask)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)), pa.array(np.arange(len(h)))], names=["hash", "item", "at"])

    seeds = scratch.table(items.select("item", "item_text").mapInArrow(seeds_of, "hash long, item long, at long"))
    number = max(1, seeds.count())
    passing = docs.sparkSession.sparkContext.broadcast(_filter_of(seeds, 1 << max(16, min(FILTER_BITS.bit_length() - 1, (16 * number).bit_length()))))

    def hits_of(batches):
        bits = passing.value
        for b in batches:
            body, offs = text_buffer(b.column(2))
            for k, (th, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                ids = _ids(words_of(body[offs[k] : offs[k + 1]].tobytes()))
                for mask in (*WHOLE, *MASKS):
                    h = _seeds(ids, mask)
                    at = h & np.uint64(8 * len(bits) - 1)
                    p = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1)
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(h[p].view(np.int64)), pa.array(np.full(len(p), th)), pa.array(np.full(len(p), size, np.int32)), pa.array(p)], names=["hash", "th", "size", "p"])

    hits = docs.mapInArrow(hits_of, "hash long, th long, size int, p long").distinct()
    aligned = hits.join(seeds, "hash").select("th", "size", "item", (F.col("p") - F.col("at")).alias("shift")).distinct()
    aligned = scratch.table(aligned.groupBy("th", "size", "item").agg(F.array_sort(F.collect_list("shift")).alias("shifts")))
    texts = docs.join(aligned.select("th", "size").distinct(), ["th", "size"], "left_semi").dropDuplicates(["th", "size"])

    def judge(batches):
        for b in batches:
            rows, found = [], []
            for k in range(b.num_rows):
                doc, item = (_ids(words_of((b.column(c)[k].as_py() or "").encode())) for c in (3, 4))
                n, start = _overlap(doc, item, b.column(5).slice(k, 1).flatten().to_numpy())
                if n >= overlap * len(item) - 1e-9:
                    rows.append(k)
                    found.append((n / len(item), n, len(item), start))
            if rows:
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(rows)) for c in range(3)], *[pa.array(c) for c in zip(*found)]], names=["th", "size", "item_id", *_MATCH])

    schema = T.StructType([T.StructField("th", T.LongType()), T.StructField("size", T.IntegerType()), kind, *_MATCH_TYPES])
    whole = aligned.join(items, "item").join(texts, ["th", "size"]).select("th", "size", "item_id", "text", "item_text", "shifts")
    return scratch.table(whole.mapInArrow(judge, schema))


def _named(text: str) -> list:
    """Two hashes that name a text."""
    return [F.xxhash64(text).alias("th"), F.hash(text).alias("size")]


def find_overlaps(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: float = OVERLAP, at_once: int = BROADCAST, most_items: int = MOST_ITEMS) -> DataFrame:
    """``doc_id, item_id, overlap, n_matched, n_words, first_word``: one row for each row of ``df``
    and item that it holds with at least ``overlap`` (0.8 or more) of the item's words in place.

    The whole item counts: a quotation of less than ``overlap`` of it is none. Items of under five words
    must stand whole. Null and empty texts match nothing; null items and items without a word are not
    searched; equal items are reported each, repeated rows each. Empty tables give no rows. Ids may be null.
    """
    _least(overlap)
    kinds = [T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("item_id", items.schema[item_col].dataType)]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _searched(items, item_col, item_text_col)
    index = _small(items, at_once, most_items)
    if index is None:
        named = docs.where("text is not null").select("doc_id", "text", *_named("text"))
        found = _by_join(named.select("th", "size", "text"), items, overlap, Scratch(df.sparkSession, "overlaps"))
        return named.select("doc_id", "th", "size").join(found, ["th", "size"]).select("doc_id", "item_id", *_MATCH)

    def run(batches):
        for b in batches:
            rows, cols = [], [[] for _ in range(5)]
            for r, matches in _scan(b.column(1), index, overlap):
                for m in matches:
                    rows.append(r)
                    for c, v in zip(cols, m):
                        c.append(v)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *[pa.array(c) for c in cols]], names=["doc_id", "item_id", *_MATCH])

    return docs.mapInArrow(run, T.StructType([*kinds, *_MATCH_TYPES]))


def _least(overlap: float) -> None:
    if not OVERLAP <= overlap <= 1:
        raise ValueError(f"the masks find overlaps from {OVERLAP} on")


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: float = OVERLAP, at_once: int = BROADCAST, most_items: int = MOST_ITEMS) -> DataFrame:
    """The rows of ``df`` that hold no item, with all their columns (a narrow filter for a benchmark that
    is indexed at once). What an item, null texts and edge cases mean is as in ``find_overlaps``."""
    _least(overlap)
    items = _searched(items, item_col, item_text_col)
    index = _small(items, at_once, most_items)
    if index is None:
        named = df.select("*", *[c.alias(f"_{k}") for k, c in enumerate(_named(f"`{text_col}`"))])
        texts = named.select(F.col("_0").alias("th"), F.col("_1").alias("size"), F.col(f"`{text_col}`").cast("string").alias("text"))
        found = _by_join(texts.where("text is not null"), items, overlap, Scratch(df.sparkSession, "overlaps"))
        bad = found.select(F.col("th").alias("_0"), F.col("size").alias("_1")).distinct()
        return named.join(bad, ["_0", "_1"], "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    at = df.columns.index(text_col)

    def run(batches):
        for b in small(batches, at):
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, _ in _scan(b.column(at).cast(pa.string()), index, overlap)]] = False
            yield b.filter(pa.array(keep))

    return df.mapInArrow(tidy(run), df.schema)
