"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` differing bits have a common point within half the radius of either. Every distinct
fingerprint therefore emits all its variants within half the radius (1 + 64 for radius 2), a shuffle groups equal
variants, and the members of a group are linked after their distance is verified. A group holds at most as many distinct
fingerprints as there are variants, whatever the number of documents; equal fingerprints were merged before. Instead of
all pairs a group links its members to its smallest one, and pairs of the ball that the star leaves out are within
reach through it, so the connected components are those of the full graph.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.llm import textkit as tk
from riskpanel.llm.graph import components
from riskpanel.session import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
_BIT_ROWS = 1 << 16


def _fingerprints(block: tk.Block, shingle: int) -> np.ndarray:
    low = tk.LOWER[block.data]
    s, e, wb = block.words(low)
    n = np.diff(wb)
    # one buffer in which words stand with one blank between them, so that a shingle is a slice
    length = e - s
    begin = np.zeros(len(s) + 1, np.int64)
    np.cumsum(length + 1, out=begin[1:])
    buf = np.full(int(begin[-1]), 32, np.uint8)
    if len(s):
        to = np.repeat(begin[:-1] - s, length)
        src = np.flatnonzero(~tk.SPACE[low])
        buf[src + to] = low[src]
    # shingle starts: all with shingle - 1 words after them, or a shorter text's first word
    last = np.repeat(wb[1:], n)
    idx = np.arange(len(s))
    first = np.repeat(wb[:-1], n)
    short = np.repeat(n < shingle, n)
    at = idx[(idx + shingle <= last) | (short & (idx == first))]
    to = np.minimum(at + shingle, last[at]) - 1
    doc = tk.owners(wb)[at]
    raw, digest = buf.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(block.n, np.uint64)
    count = np.bincount(doc, minlength=block.n)
    sums = np.zeros((block.n, 64), np.int64)
    a, b = begin[at], begin[to] + length[to]
    for lo in range(0, len(at), _BIT_ROWS):
        hi = min(lo + _BIT_ROWS, len(at))
        h = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True)),
                        np.uint64, hi - lo)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[lo:hi]
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        sums[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    over = (2 * sums > count[:, None]).astype(np.uint8)
    if block.n:
        out = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of every whole text as a signed long. A text without words (null, empty,
    white space only) has fingerprint 0; one with fewer words than a shingle hashes its whole word sequence."""
    return tk.add_columns(docs, "text", {name: "long"},
                          lambda block: {name: pa.array(_fingerprints(block, shingle).view(np.int64))})


def masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed longs."""
    found = [0]
    for k in range(1, radius + 1):
        found += [sum(1 << b for b in c) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links among the distinct longs of column fp that keep the components of the graph of all pairs within
    ``radius`` bits; both ends of a link are verified to be that near. The radius must be even, so that any two members
    of a group are within it of each other."""
    if radius % 2:
        raise ValueError("the radius must be even")
    # a table of fingerprints is small beside its balls: many tasks, not many bytes
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks(radius // 2)])).alias("m")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    met = balls.groupBy("variant").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    star = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def _roots(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (fp, ...), one row for each fingerprint, with root, the smallest fingerprint of its component, and linked."""
    member = components(links(nodes.select("fp"), radius))  # (node, root): only fingerprints that have a link
    found = nodes.join(member, nodes.fp == member.node, "left")
    return found.select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "fp").alias("root"), F.col("node").isNotNull().alias("linked"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id among all documents that are reachable over links of at most ``radius``
    differing bits, itself included. Rows with a null doc_id take part in the links; a component of null ids only has
    a null component_id. Repeated rows stay repeated. An empty table gives an empty result.
    """
    of = materialize(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    per_fp = _roots(materialize(of.groupBy("fp").agg(F.min("doc_id").alias("least"))), radius)
    least = per_fp.where("linked").groupBy("root").agg(F.min("least").alias("joined"))
    named = per_fp.join(least, "root", "left").select(
        "fp", F.when(F.col("linked"), F.col("joined")).otherwise(F.col("least")).alias("component_id"))
    return of.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, that of the smallest doc_id (null
    ids last; of that id's rows the one with the smallest fingerprint, then hash of all columns). All columns of ``docs``
    are returned. Rows that are equal in all columns are one."""
    names = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.withColumn("__row", F.xxhash64(*names))
    of = materialize(fingerprints(rows.select("doc_id", "text", "__row"), shingle).select("doc_id", "fp", "__row"))
    # the best row of a fingerprint before anything is joined: however many copies there are, they are one row a task
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "__row")).alias("x")
    best = _roots(materialize(of.groupBy("fp").agg(first)), radius).groupBy("root").agg(F.min("x").alias("x"))
    # equal rows have equal keys, other rows of one id and hash don't occur
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("__row").cast("string")).alias("__key")
    keep = best.select("x.*").select(key)
    return rows.withColumn("__key", key).join(keep, "__key").dropDuplicates(["__key"]).drop("__key", "__row")
