"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints at most ``BITS`` bits apart differ in
at most ``BITS`` of those bytes, so they share at least ``8 - BITS`` of them. A list on one single byte
would hold 1/256 of all rows, so its pairs would grow with the square of the corpus. The index
therefore has one posting for each block of a Steiner system S(3, 4, 8): 14 sets of four byte positions,
of which any five positions hold exactly one, six hold 3, seven hold 7. A posting of unrelated
fingerprints is 2**32 times thinner than the corpus, and the number of postings that a pair shares tells
how many positional bytes it shares. Pairs are tallied over the postings, those below the guaranteed
minimum (3 postings, that is six bytes, for two bits) are dropped, and the rest is verified by its bits.

A posting with more than ``WIDE`` members (many near copies) emits no pairs. Its members agree on
32 bits, so two that link are each within one bit of a common word in the other 32: every member is
listed under itself and its 32 one-bit neighbours, and each such list (33 members at most) links
its members to its smallest. A linked pair either shares a wide posting, and is connected through those
lists, or has all its postings tallied; so the components are the same, with 33 rows for each member.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, text_buffer
from .components import connected_components

BITS = 2
WIDE = 32

#: The blocks: four positions of which the numbers cancel out under exclusive or.
_BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Postings that a pair of so many differing bytes at most shares at least.
LEAST_SHARED = {0: 14, 1: 7, 2: 3}
#: Byte values against their bits, the highest first.
_BIT_ROWS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text (UTF-8)."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    pieces = map(joined.__getitem__, map(slice, starts, stops))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes (uint64); 0 for none."""
    n = len(hashes)
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(by_byte[:, k], minlength=256) @ _BIT_ROWS
        out = out << 8 | int(np.packbits(2 * ones > n)[0])
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``, one row for each row of ``df``; ``fp`` is the fingerprint as a signed bigint.

    Texts are lower-cased A-Z and cut at ASCII white space. Null and blank texts get fingerprint 0;
    texts of fewer words than a shingle hash whole. Ids may be null or repeated.
    """

    def run(batches):
        for b in batches:
            body, offs = text_buffer(b.column(1))
            raw = body.tobytes()
            fps = np.fromiter((fingerprint(raw[i:j], shingle, seed) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _byte(fp: str, k: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 56 - 8 * k).bitwiseAND(F.lit(255))


def _key(fp: str, block: tuple[int, ...]) -> Column:
    """The four bytes of a block as one number."""
    out = F.lit(0).cast("bigint")
    for k in block:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(fp, k))
    return out


def _verified(pairs: DataFrame, bits: int) -> DataFrame:
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)


def candidates(nodes: DataFrame, scratch: Scratch, least: int, wide: int = WIDE) -> DataFrame:
    """``nodes(fp)`` distinct -> ``(u, v)`` that share ``least`` postings of the byte-position index or more, and
    the links of the one-bit neighbours in postings of over ``wide`` members."""
    entries = [F.struct(F.lit(s).alias("slot"), _key("fp", block).alias("key")) for s, block in enumerate(_BLOCKS)]
    index = nodes.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.slot", "e.key", "fp")
    sizes = index.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    index = scratch.table(index.join(sizes, ["slot", "key"]))
    slim = index.where(F.col("n") <= wide).drop("n")
    met = slim.withColumnRenamed("fp", "u").join(slim.withColumnRenamed("fp", "v"), ["slot", "key"]).where("u < v")
    pairs = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least).select("u", "v")

    masks = [[0] + [1 << (56 - 8 * k + b) for k in range(8) if k not in block for b in range(8)] for block in _BLOCKS]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flips = F.array(*[F.array(*[F.lit(signed(m)).cast("bigint") for m in own]) for own in masks])
    full = index.where(F.col("n") > wide).select("slot", "key", F.col("fp").alias("u"), F.explode(F.element_at(flips, F.col("slot") + 1)).alias("m"))
    full = full.select("slot", "key", "u", F.col("u").bitwiseXOR(F.col("m")).alias("mid"))
    stars = full.groupBy("slot", "key", "mid").agg(F.min("u").alias("v"), F.max("u").alias("top")).where("v <> top")
    stars = full.join(stars, ["slot", "key", "mid"]).where("u <> v").select("u", "v")
    return pairs.unionByName(stars)


def links(nodes: DataFrame, scratch: Scratch, bits: int = BITS, wide: int = WIDE) -> DataFrame:
    """``nodes(fp)`` distinct -> verified ``(u, v)``, enough of them to connect every linked pair."""
    if bits not in LEAST_SHARED:
        raise ValueError("the index guarantees links of at most two differing bits")
    return scratch.table(_verified(candidates(nodes, scratch, LEAST_SHARED[bits], wide), bits).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, bits: int = BITS, wide: int = WIDE) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, fingerprint, component_id, component_rows``.

    component_id is the smallest id reachable over links of at most ``bits`` differing bits, equal
    fingerprints included; null ids take part but never name a component (a component of null ids
    only has a null name). An empty table gives an empty result. Other columns of ``df`` are ignored.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.table(fingerprints(df, id_col, text_col, shingle, seed))
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    edges = links(nodes.select("fp"), scratch, bits, wide)
    labels = connected_components(edges, scratch)
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_rows"))
    named = scratch.table(named.select("fp", "label").join(names, "label").drop("label"))
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_rows")
