"""Near-duplicates by the Jaccard similarity of word shingles: SimHash index, exact check, exact rest.

Each set has a SimHash fingerprint. The byte-position index of ``simhash`` tallies the postings that two
fingerprints share; pairs with ``SHARED`` or more, and sets of one fingerprint, are verified on the whole
sets and give first components. At the least similarity fingerprints differ in about ten bits, more than
any index over 64 bits can promise to find. The pairs that it missed are therefore found by a
prefix-filtered join, which leaves out those that are in one component already; so the result is exact.

Two sets of n shingles that are at least ``LEAST`` similar share one of the first n - LEAST * n + 1 of
each under any common order, so only these are listed. The order puts shingles that are common in a
sample last, which keeps lists short; it decides the work and never the result. Pairs of a list whose
sizes and places in it still allow the similarity are sifted by the sets' counts in ``CELLS`` cells of
hashes (long texts also in ``FINE`` ones), whose differences two sets differ in at least, and then
verified on the whole sets. Texts with equal sets are one node throughout.

A list with more than ``WIDE`` members (many near copies) first links its members to the one that most
wide lists hold. Only pairs of it that are in different components after that are tried one by one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, give_back, small, text_buffer, tidy
from .components import connected_components
from .simhash import candidates, majority

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
WIDE = 32
#: Postings of the byte-position index that make a pair of fingerprints a candidate: six equal bytes share three.
SHARED = 3
CELLS = 64
#: Sets from this size on are also sifted by this many cells; fewer do not tell two long texts apart.
LONG, FINE = 1_000, 1_024
#: Texts up to which a set of them is broadcast (8 bytes each).
FEW = 1_000_000
#: Bytes of texts or sets that a task works on at once.
AT_ONCE = 4 << 20
#: Texts sampled for the order of shingles, how many of them make a shingle common, and the most of these.
SAMPLE, COMMON, MOST = 10_000, 4, 200_000


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct shingles (sorted, int64); fewer words than a shingle hash whole."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    pieces = map(joined.__getitem__, map(slice, starts, stops))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n).view(np.int64))


def _node(hashes: np.ndarray) -> int:
    """The name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def _cells(hashes: np.ndarray, count: int = CELLS) -> bytes:
    """How many hashes are in each cell, 255 for more."""
    return np.minimum(np.bincount(hashes & (count - 1), minlength=count), 255).astype(np.uint8).tobytes()


def _sets(column, size: int):
    body, offs = text_buffer(column)
    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield shingles(body[i:j].tobytes(), size)


def _small(batches, k: int):
    return small(batches, k, AT_ONCE)


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample (sorted) and the number of its texts that hold each."""
    rows = texts.count()
    if rows > SAMPLE:
        texts = texts.sample(SAMPLE / rows, seed=1)

    def run(batches):
        for b in _small(batches, 0):
            got = list(_sets(b.column(0), size))
            s, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], names=["s", "n"])

    found = texts.select("text").mapInArrow(tidy(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "s").limit(MOST).collect()
    s, n = np.array([r["s"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _prints(texts: DataFrame, size: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``texts(key, h, text)`` -> ``key, h, node, fp, n, cells, fine, prefix``."""
    last, often = common

    def run(batches):
        for b in _small(batches, 2):
            names, fps, counts, cells, fine, heads = [], [], [], [], [], []
            for s in _sets(b.column(2), size):
                rank = np.zeros(len(s), np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    hit = last[at] == s
                    rank[hit] = often[at[hit]]
                n = len(s)
                heads.append(s[np.lexsort((s, rank))][: n - -(-LEAST[0] * n // LEAST[1]) + 1])
                names.append(_node(s))
                fps.append(majority(s.view(np.uint64)))
                counts.append(n)
                cells.append(_cells(s))
                fine.append(_cells(s, FINE) if n >= LONG else b"")
            at = np.cumsum([0] + [len(x) for x in heads]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(counts, pa.int32()), pa.array(cells, pa.binary()), pa.array(fine, pa.binary()), lists], names=["key", "h", "node", "fp", "n", "cells", "fine", "prefix"])

    schema = T.StructType([texts.schema["key"], T.StructField("h", T.LongType()), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("cells", T.BinaryType()), T.StructField("fine", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return texts.select("key", "h", "text").mapInArrow(tidy(run), schema)


def _fits(a: str, b: str) -> Column:
    """Whether two members of a list, by their sizes and their places in it, can be similar enough."""
    (p, q), n, m = LEAST, F.col(f"{a}.n"), F.col(f"{b}.n")
    shared = 1 + F.least(n - F.col(f"{a}.pos") - 1, m - F.col(f"{b}.pos") - 1)
    return (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * shared >= p * (n + m))


def _listed(cells: str) -> Column:
    """The counts of a node's cells as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(CELLS)), lambda k: F.conv(F.hex(F.substring(F.col(cells), k, F.lit(1))), 16, 10).cast("smallint"))


def _alike(a: str, b: str) -> Column:
    """Whether two nodes' cells still allow the similarity: two sets differ by what their cells do at least."""
    apart = F.aggregate(F.zip_with(f"{a}.cells", f"{b}.cells", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda total, x: total + x)
    return sum(LEAST) * apart <= (LEAST[1] - LEAST[0]) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """The pairs that are similar enough by their whole sets, read again from one text of each node."""

    def sift(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for k in (4, 5))
                total = b.column(2).to_numpy() + b.column(3).to_numpy()
                good = sum(LEAST) * np.abs(x - y).sum(axis=1) <= (LEAST[1] - LEAST[0]) * total
                for i, (p, q) in enumerate(zip(b.column(6).to_pylist(), b.column(7).to_pylist())):
                    if good[i] and p and q:
                        apart = np.abs(np.frombuffer(p, np.uint8).astype(np.int64) - np.frombuffer(q, np.uint8)).sum()
                        good[i] = sum(LEAST) * apart <= (LEAST[1] - LEAST[0]) * total[i]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good))

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("cells").alias(f"c{k}"), F.col("fine").alias(f"f{k}"))
    near = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "cu", "cv", "fu", "fv")
    pairs = scratch.table(near.mapInArrow(tidy(sift), "u long, v long"))
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = scratch.table(wanted.join(nodes.select("node", "h"), "node").select("h"))
    if wanted.count() <= FEW:  # texts that no pair needs are then not shuffled
        wanted = F.broadcast(wanted)

    def read(batches):
        for b in _small(batches, 0):
            got = list(_sets(b.column(0), size))
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "hashes"])

    def judge(batches):
        for b in batches:
            both = zip(*([np.frombuffer(x.as_buffer(), np.int64) for x in b.column(k)] for k in (2, 3)))  # views, not copies
            own = [(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in both]
            good = pa.array([LEAST[1] * c >= LEAST[0] * (n + m - c) for n, m, c in own], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(good)

    sets = scratch.table(texts.select("h", "text").join(wanted, "h", "left_semi").dropDuplicates(["h"]).select("text").mapInArrow(tidy(read), "node long, hashes binary"))
    full = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("hu")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("hv")), "v")
    out = scratch.table(full.select("u", "v", "hu", "hv").mapInArrow(tidy(judge), "u long, v long"))
    scratch.drop(pairs)
    scratch.drop(sets)
    give_back(scratch.spark)
    return out


def _indexed(nodes: DataFrame, scratch: Scratch, wide: int) -> DataFrame:
    """Pairs of nodes by the byte-position index of their fingerprints, each of which its smallest node stands for."""
    heads = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    met = candidates(heads.select("fp"), scratch, SHARED, wide)
    side = lambda k: heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_head"))
    met = met.join(side("u"), "u").join(side("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    return scratch.table(met.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that are not in one component yet."""
    side = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label"))
    return pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").where("u_label is null or v_label is null or u_label <> v_label").select("u", "v")


def components(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, wide: int = WIDE) -> DataFrame:
    """``key, component`` for each row of ``df``: the smallest key reachable over pairs of texts whose
    shingle sets have a Jaccard similarity of ``LEAST`` or more.

    Texts are lower-cased A-Z and cut at ASCII white space; null and blank texts are equal. Null keys
    take part but never name a component.
    """
    scratch = Scratch(df.sparkSession, "near")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.col(key_col).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    prints = scratch.table(_prints(texts, size, _common(texts, size)))
    scratch.sized(8 * (prints.agg(F.sum("n")).first()[0] or 0))
    give_back(df.sparkSession)
    nodes = scratch.table(prints.groupBy("node").agg(F.min("key").alias("least"), F.min("h").alias("h"), F.any_value("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("cells").alias("cells"), F.any_value("fine").alias("fine")))
    first = _verified(_indexed(nodes, scratch, wide), nodes, texts, size, scratch)
    known = connected_components(first, scratch)

    listed = prints.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    listed = listed.select("node", "n", F.posexplode("prefix").alias("pos", "s"))
    live = scratch.table(listed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("m > 1"))
    give_back(df.sparkSession)

    slim = live.where(F.col("m") <= wide)
    pairs = _pairs(slim.alias("a").join(slim.alias("b"), F.col("a.s") == F.col("b.s")).where(F.col("a.node") < F.col("b.node")).where(_fits("a", "b")))
    full = live.where(F.col("m") > wide)
    full = scratch.table(full.join(full.groupBy("node").agg(F.sum("m").alias("weight")), "node"))
    hubs = full.groupBy("s").agg(F.max(F.struct("weight", "node", "n", "pos")).alias("hub")).select("s", "hub.*")
    stars = _pairs(full.alias("a").join(hubs.alias("b"), F.col("a.s") == F.col("b.s")).where(F.col("a.node") != F.col("b.node")).where(_fits("a", "b")))
    rest = _open(pairs.unionByName(stars).distinct(), known)
    known = known.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))  # as good as ``first``
    edges = scratch.table(known.unionByName(_verified(rest, nodes, texts, size, scratch)))
    labels = connected_components(edges, scratch)

    if full.limit(1).count():
        full = full.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        tops = full.groupBy("s", "label").count().groupBy("s").agg(F.max(F.struct("count", "label")).alias("top"), F.count(F.lit(1)).alias("kinds"))
        mixed = full.join(tops.where("kinds > 1").select("s", F.col("top.label").alias("top")), "s")
        mixed = scratch.table(mixed.join(nodes.select("node", _listed("cells").alias("cells")), "node"))
        apart = mixed.where("label <> top").alias("a").join(mixed.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.label") != F.col("b.label")) & _fits("a", "b") & _alike("a", "b"))
        more = _verified(_pairs(apart), nodes, texts, size, scratch)
        if more.limit(1).count():
            labels = connected_components(edges.unionByName(more), scratch)

    scratch.drop(live)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("component"))
    named = scratch.table(named.select("node", "label").join(names, "label").select("node", "component"))
    for done in (nodes, full, edges):
        scratch.drop(done)
    return prints.select("key", "node").join(named, "node").select("key", "component")
