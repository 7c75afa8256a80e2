"""SentencePiece encoding and decoding with exact n-best segmentation.

Texts are segmented over the lattice of a given vocabulary (never trained here): an edge is a piece
that matches the text, or a character's UTF-8 bytes where no piece covers it. A forward Viterbi pass
gives the best score up to every position; the backward A* search from the end uses those scores as
its heuristic, which is exact, so hypotheses leave the queue in order of their full score.

No piece crosses from a word into the blanks that follow it, none holds a line break, and (where the
vocabulary is so made) none joins punctuation to anything else, so a text's lattice falls apart at those
places: each chunk is searched once, kept in a bounded cache, and a text's
n best segmentations are the n best sums over its chunks, merged through a queue again.

The forward pass also keeps the second best score, so the exact gap to a chunk's second best is known and
the search itself runs only for the few chunks of a text whose gaps are smallest.

A vocabulary of merge ranks has no probabilities. Its pieces are scored by the rank's Zipf law,
log(1 / ((rank + 1) * H)); a fallback byte costs more than the rarest piece.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Chunks that a worker keeps, and the longest that it keeps.
CACHE = 400_000
CACHE_CHARS = 48
#: Chunks of which a worker keeps the n best.
SEARCHED = 20_000

_SPACE = "▁"
_P, _A = re.escape(string.punctuation), "0-9A-Za-z\u00c0-\u024f"
#: Chunks end at places that no piece crosses: before blanks, about line breaks and, where the
#: vocabulary never joins Latin letters or digits to ASCII punctuation, between those. The last pattern
#: but two takes what holds other characters, up to the next blank.
_CHUNKS = re.compile(" *[^ \n]+|\n| +")
_FINE_CHUNKS = re.compile(f" *[{_A}]++(?=[ \n{_P}]|$)| *[{_P}]++(?=[ \n{_A}]|$)| *[^ \n]+|\n| +")


def _tree(ids: dict[str, int], scores: list[float]) -> dict:
    """The pieces by their characters; a node without longer pieces has None for what may follow."""
    top: dict = {}
    for piece, k in ids.items():
        node = top
        for c in piece[:-1]:
            below, w, at = node.get(c, (None, 0.0, -1))
            if below is None:
                below = {}
                node[c] = (below, w, at)
            node = below
        node[piece[-1]] = (node.get(piece[-1], (None,))[0], scores[k], k)
    return top


class _Chunks(dict):
    """Results for short chunks, made where missing and kept in two generations of ``limit`` each."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.limit = make, {}, CACHE

    def __missing__(self, text: str) -> tuple[float, bytes, float]:
        got = self.older.get(text) or self.make(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Vocabulary:
    """Pieces with their scores (the blank symbol as a plain blank), and the searches over their lattice."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int], skip: set[int]):
        special = skip | set(bytes_at)
        plain = [p.replace(_SPACE, " ") for p in pieces]
        self.ids = {p: k for k, p in enumerate(plain) if k not in special and p}
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a chunk's border")
        self.pieces, self.scores, self.bytes_at = pieces, scores, bytes_at
        #: Pieces as a tree: a character to (what may follow or None, score, id of the piece that ends here or -1).
        self.tree = _tree(self.ids, scores)
        self.byte_score = min(scores[k] for k in self.ids.values()) - 10.0
        #: What each id decodes to.
        self.raw = [b"" if k in skip else plain[k].encode() for k in range(len(pieces))]
        for b, k in enumerate(bytes_at):
            self.raw[k] = bytes([b])
        joined = any(re.search(f"[{_P}][{_A}]|[{_A}][{_P}]", p) for p in self.ids)
        self.chunks = (_CHUNKS if joined else _FINE_CHUNKS).findall
        self.cache = _Chunks(self.viterbi)
        #: n_best of the chunks that stood in for others last.
        self.searched: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(k) for k in range(n)]
        bytes_at = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = {k for k in range(n) if m.is_control(k) or m.is_unknown(k) or m.is_unused(k)}
        own = [k for k in range(n) if k not in skip and not m.is_byte(k)]
        h = math.log(sum(1 / (r + 1) for r in range(len(own))))
        scores = [0.0] * n
        for r, k in enumerate(sorted(own, key=lambda k: (-m.get_score(k), k))):
            scores[k] = -math.log(r + 1) - h
        return cls(pieces, scores, bytes_at, skip)

    def edges(self, chunk: str) -> list[tuple[int, int, float, int]]:
        """The lattice as (from, to, score, id), by where they start; id -1 stands for fallback bytes."""
        out, size = [], len(chunk)
        for i in range(size):
            single, node = False, self.tree
            for j in range(i, size):
                got = node.get(chunk[j])
                if got is None:
                    break
                node, w, k = got
                if k >= 0:
                    single |= j == i
                    out.append((i, j + 1, w, k))
                if node is None:
                    break
            if not single:
                out.append((i, i + 1, self.byte_score * len(chunk[i].encode("utf-8", "surrogatepass")), -1))
        return out

    def _spell(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_at[b] for b in char.encode("utf-8", "surrogatepass"))

    def viterbi(self, chunk: str) -> tuple[float, bytes, float]:
        """The best segmentation's score and ids, and what the second best lacks (infinite without one):
        a forward pass with the two best scores up to every position."""
        size, tree = len(chunk), self.tree
        none = -math.inf
        best, second = [0.0] + [none] * size, [none] * (size + 1)
        back, last = [0] * (size + 1), [-1] * (size + 1)
        for i in range(size):
            first, other, node = best[i], second[i], tree
            single, j = False, i
            for c in chunk[i:] if i else chunk:
                got = node.get(c)
                if got is None:
                    break
                j += 1
                node, w, k = got
                if k >= 0:
                    if j == i + 1:
                        single = True
                    v = first + w
                    if v > best[j]:
                        second[j], best[j], back[j], last[j] = best[j], v, i, k
                    elif v > second[j]:
                        second[j] = v
                    if other + w > second[j]:
                        second[j] = other + w
                if node is None:
                    break
            if not single:
                w = self.byte_score * len(chunk[i].encode("utf-8", "surrogatepass"))
                j, v = i + 1, first + w
                if v > best[j]:
                    second[j], best[j], back[j], last[j] = best[j], v, i, -1
                elif v > second[j]:
                    second[j] = v
                if other + w > second[j]:
                    second[j] = other + w
        at, ids = size, []
        while at:
            i, k = back[at], last[at]
            if k >= 0:
                ids.append(k)
            else:
                ids += self._spell(chunk[i])[::-1]
            at = i
        ids.reverse()
        return best[size], array("i", ids).tobytes(), best[size] - second[size]

    def n_best(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The chunk's n best segmentations, best first, by A* from its end: the forward Viterbi score of a
        position is exactly the best that can still come before it. Of equal priorities the furthest goes on
        first, so of many equal segmentations only as many as are asked for are followed to the end."""
        size, edges = len(chunk), self.edges(chunk)
        best = [0.0] + [-math.inf] * size
        into: list[list] = [[] for _ in range(size + 1)]
        for i, j, w, k in edges:
            into[j].append((i, w, (k,) if k >= 0 else self._spell(chunk[i])))
            if best[i] + w > best[j]:
                best[j] = best[i] + w
        out: list[tuple[float, tuple[int, ...]]] = []
        # (priority, position, serial, score behind, ids from here on as a linked list)
        queue: list[tuple] = [(-round(best[size], 9), size, 0, 0.0, None)]
        serial = 0
        while queue:
            f, at, _, behind, tail = heapq.heappop(queue)
            if len(out) >= n and -f < out[n - 1][0] - 1e-9 or len(out) >= 4 * n:
                break
            if at == 0:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((behind, tuple(ids)))
                continue
            for i, w, own in into[at]:
                serial += 1
                heapq.heappush(queue, (-round(behind + w + best[i], 9), i, serial, behind + w, (own, tail)))
        out.sort(key=lambda x: (-round(x[0], 9), x[1]))
        return [(s, array("i", p).tobytes()) for s, p in out[:n]]

    def others(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """n_best, kept for short chunks: the smallest gaps are those of the same few words in most texts."""
        got = self.searched.get((chunk, n))
        if got is None:
            got = self.n_best(chunk, n)
            if len(chunk) <= CACHE_CHARS:
                if len(self.searched) >= SEARCHED:
                    self.searched.clear()
                self.searched[chunk, n] = got
        return got


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def _encode(text: str, vocab: Vocabulary, n: int, swaps: list | None = None) -> list[tuple[float, bytes]]:
    """The n best (score, int32 ids as bytes) of a text. ``swaps`` gets the (chunk, ids) that stand in for
    the best ids of a chunk in the others."""
    chunks = vocab.chunks(" " + text) if text else []
    parts = list(map(vocab.cache.__getitem__, chunks))
    score, ids, gap = ([p[k] for p in parts] for k in range(3))
    total, best = sum(score), b"".join(ids)
    out = [(total, best)]
    if n == 1 or not parts:
        return out
    # sums of n best: only the n - 1 chunks with the smallest gaps can change
    gaps = np.array(gap)
    near = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) >= n else np.arange(len(gaps))
    near = [k for k in near[np.lexsort((near, gaps[near]))].tolist() if gaps[k] < math.inf]
    other = {k: [(score[k] - s, p) for s, p in vocab.others(chunks[k], n) if p != ids[k]][: n - 1] for k in near}
    ends, done, size = {}, 0, 0
    for k in sorted(near):
        size += sum(map(len, ids[done : k + 1]))
        ends[k], done = size, k + 1
    rank = {k: r for r, k in enumerate(near)}
    queue = [(other[k][0][0], ((k, 0),)) for k in near]
    heapq.heapify(queue)
    while queue and len(out) < n:
        g, change = heapq.heappop(queue)
        made, at = [], 0
        for k, r in sorted(change):
            made += [best[at : ends[k] - len(ids[k])], other[k][r][1]]
            at = ends[k]
            if swaps is not None:
                swaps.append((chunks[k], other[k][r][1]))
        out.append((total - g, b"".join([*made, best[at:]])))
        k, r = change[-1]
        if r + 1 < len(other[k]):  # the same chunk's next segmentation
            heapq.heappush(queue, (g - other[k][r][0] + other[k][r + 1][0], (*change[:-1], (k, r + 1))))
        for q in near[rank[k] + 1 :]:  # or one more chunk, further down the list
            heapq.heappush(queue, (g + other[q][0][0], (*change, (q, 0))))
    return out


def _ids(raw: bytes) -> array:
    out = array("i")
    out.frombytes(raw)
    return out


def encode(text: str, vocab: Vocabulary, n: int = N_BEST) -> list[tuple[float, array]]:
    """The text's n best segmentations as (score, ids), best first; fewer where fewer exist. An empty
    text has one, empty."""
    return [(s, _ids(p)) for s, p in _encode(text, vocab, n)]


def _decode(ids, vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.raw.__getitem__, ids))[1:]


def decode(ids, vocab: Vocabulary) -> str:
    """The text of a list of ids, byte pieces joined to characters; the dummy blank in front goes."""
    return _decode(ids, vocab).decode("utf-8", "replace")


def _pieces(b: pa.Array, model: str, n: int):
    vocab = vocabulary(model)
    for v in b:
        yield encode(v.as_py() or "", vocab, n)


def encode_table(df: DataFrame, text_col: str = "text", model: str = MODEL, n: int = N_BEST, out: str = "segmentations") -> DataFrame:
    """``df`` with ``out``: array<struct<score, ids>> of the n best segmentations, best first. Null and
    empty texts have one empty segmentation. An existing column of that name is replaced."""
    at = df.columns.index(text_col)
    keep = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out) + f", `{out}` array<struct<score:double,ids:array<int>>>"

    def run(batches):
        for b in batches:
            made = [[{"score": s, "ids": ids.tolist()} for s, ids in e] for e in _pieces(b.column(at), model, n)]
            kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(made, kind)], names=[*keep, out])

    return df.mapInArrow(run, schema)


def decode_table(df: DataFrame, ids_col: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of an array<int> column; null stays null."""
    keep = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out) + f", `{out}` string"

    def run(batches):
        for b in batches:
            vocab = vocabulary(model)
            texts = [None if v is None else decode(v, vocab) for v in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = N_BEST, carry: tuple[str, ...] = (), cache: int = CACHE, keep: bool = True) -> DataFrame:
    """``doc_id, ids, scores, n_pieces, n_byte_pieces, n_found, score, gap, ids_sha256, n_best_sha256, exact``
    (and columns to carry) for each row.

    ids is the best segmentation, which ``decode_table`` turns to the text again; scores are those of the n
    best (``encode_table`` has their ids as well). score is the best segmentation's, gap what the second lacks (null without one); the hashes are over
    little-endian int32 ids, of all segmentations one after another for the second; exact tells whether
    the best segmentation decodes to the text again, and each part that others have in its place to the same. Null reads as empty; ids may be null or repeated.

    A worker keeps up to twice ``cache`` chunks (about 260 bytes each), with ``keep`` also between tasks.
    """
    names = ["doc_id", *carry, "ids", "scores", "n_pieces", "n_byte_pieces", "n_found", "score", "gap", "ids_sha256", "n_best_sha256", "exact"]
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, *carry)]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(names, [*kinds, "array<int>", "array<double>", "long", "long", "int", "double", "double", "string", "string", "boolean"]))

    def run(batches):
        vocab = vocabulary(model)
        vocab.cache.limit = cache
        is_byte = np.zeros(len(vocab.pieces), bool)
        is_byte[vocab.bytes_at] = True
        for b in small(batches, -1):
            rows, best, scores = [], [], []
            for v in b.column(b.num_columns - 1):
                text = v.as_py() or ""
                swaps: list = []
                found = _encode(text, vocab, n, swaps)
                ids = np.frombuffer(found[0][1], np.int32)
                exact = _decode(ids.tolist(), vocab) == text.encode()
                exact = exact and all(b"".join(map(vocab.raw.__getitem__, _ids(p))) == c.encode() for c, p in swaps)
                gap = found[0][0] - found[1][0] if len(found) > 1 else None
                best.append(found[0][1])
                scores.append([s for s, _ in found])
                rows.append((len(ids), int(is_byte[ids].sum()), len(found), found[0][0], gap, hashlib.sha256(found[0][1]).hexdigest(), hashlib.sha256(b"".join(p for _, p in found)).hexdigest(), exact))
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in best])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(best), np.int32))), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists, *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)
        if not keep:
            vocab.cache.forget()

    docs = df.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in carry], F.col(text_col).cast("string").alias("_text"))
    return docs.mapInArrow(tidy(run), schema)
