"""Exact substring deduplication over a run-length index (see ``rlbwt``).

A string of ``LENGTH`` bytes is repeated when it starts at two places of the corpus. Equal strings have the same
minimizer (the leftmost of the smallest hashes of their CORE-byte substrings) at the same offset, so places are dealt out
by minimizer:

1. every document is cut into segments, one for each minimizer, that hold all windows with that minimizer;
2. segments are counted by minimizer; one that occurs once ends here, which is most of the corpus;
3. where all segments of a minimizer are the same bytes, they are repeats as a whole. Where they differ, the distinct
   contents (equal ones were merged, with their count) are gathered into buckets of bounded size, each bucket is
   indexed, and matching statistics are streamed from the index: a window whose longest match is LENGTH or more is a
   repeat;
4. a minimizer whose distinct contents exceed HOT_BYTES (a common phrase in many contexts) would not fit one bucket. Its
   contents are cut and counted again by the next longer minimizer of CORES, and those that differ are indexed in
   buckets like the others. A minimizer as long as the window has one content only, so that ends;
5. the marked windows of each document are united and its bytes are cut.

Only 64-bit hashes pairwise with the minimizer's stand for contents in the exchange (128 bits in all).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.llm import textkit as tk
from riskpanel.llm.rlbwt import matching_statistics
from riskpanel.session import materialize

LENGTH = 200
CORES = (32, 64, 128, LENGTH)
HOT_BYTES = 1 << 22
BUCKET_BYTES = 1 << 20
_STEP = 1 << 22
_AT = np.uint64((1 << 28) - 1)


def core_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte substrings."""
    n = len(data) - k + 1
    out = np.empty(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, max(0, n), 1 << 20):
            hi = min(n, lo + (1 << 20))
            p, q = tk.powers(hi - lo + k)
            acc = np.zeros(hi - lo + k, np.uint64)
            np.cumsum(tk.CODES[data[lo: hi + k - 1]] * p[: hi - lo + k - 1], out=acc[1:])
            out[lo:hi] = tk.mix64((acc[k:] - acc[: hi - lo]) * q[: hi - lo])
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, by prefix and suffix minima of stretches of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1: n])


def segments(block: tk.Block, length: int = LENGTH, core: int = CORES[0]):
    """The segments of a block's texts: text, first window's start in the text, number of windows, and the hashes of
    the minimizer and of the whole segment."""
    found = []
    for lo in range(0, max(0, len(block.data) - length + 1), _STEP):
        data = block.data[lo: lo + _STEP + length - 1]
        h = core_hashes(data, core)
        least = _sliding_min((h & ~_AT) | np.arange(len(h), dtype=np.uint64), length - core + 1)
        at = (least & _AT).astype(np.int64)
        p = np.arange(len(at)) + lo
        doc = np.searchsorted(block.off, p, side="right") - 1
        ok = p + length <= block.off[doc + 1]
        p, doc, at = p[ok], doc[ok], at[ok]
        if not len(p):
            continue
        new = np.ones(len(p), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(p)))
        whole = tk.span_hashes(data, p[first] - lo, p[first] - lo + n - 1 + length)
        found.append((doc[first], p[first] - block.off[doc[first]], n, h[at[first]], whole))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segment_table(docs: DataFrame, length: int, core: int) -> DataFrame:
    schema = "ref bigint, at int, n int, mini bigint, whole bigint"

    def run(batches):
        for batch in batches:
            ref = batch.column(0).to_numpy(zero_copy_only=False)
            for block in tk.blocks(batch.column(1)):
                doc, at, n, mini, whole = segments(block, length, core)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ref[block.lo + doc]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(mini.view(np.int64)), pa.array(whole.view(np.int64))], names=["ref", "at", "n", "mini", "whole"])

    return docs.select("ref", "text").mapInArrow(run, schema)


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(mini, whole, times, bytes) of the wanted segments (ref, at, n, mini, whole, times), cut from their texts."""
    lists = wanted.groupBy("ref").agg(F.collect_list(F.struct("at", "n", "mini", "whole", "times")).alias("cuts"))
    rows = docs.select("ref", "text").join(lists, "ref").select("text", "cuts")

    def run(batches):
        for batch in batches:
            cuts = batch.column(1)
            flat, off = cuts.flatten(), np.asarray(cuts.offsets)
            col = {k: np.asarray(flat.field(k)) for k in ("at", "n", "mini", "whole", "times")}
            for i, text in enumerate(batch.column(0).to_pylist()):
                raw = text.encode()
                s = slice(off[i] - off[0], off[i + 1] - off[0])
                a, m = col["at"][s], col["n"][s]
                got = [raw[x: x + y - 1 + length] for x, y in zip(a.tolist(), m.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(col["mini"][s]), pa.array(col["whole"][s]),
                                                  pa.array(col["times"][s]), pa.array(got, pa.binary())],
                                                 names=["mini", "whole", "times", "bytes"])

    return rows.mapInArrow(run, "mini bigint, whole bigint, times bigint, bytes binary")


def _runs(mask: np.ndarray, bounds: np.ndarray):
    """Maximal runs of set positions inside each stretch: owner, start and end from the stretch's start."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    cut = np.zeros(len(mask) + 1, bool)
    cut[bounds[1:-1]] = True
    start = (edge == 1)
    start[:-1] |= cut[:-1] & mask
    end = (edge == -1)
    end[1:] |= cut[1:] & mask
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    own = np.searchsorted(bounds, s, side="right") - 1
    return own, s - bounds[own], e - bounds[own]


_SPANS = "mini bigint, whole bigint, lo int, hi int"


def _span_batch(mini, whole, lo, hi) -> pa.Table:
    return pa.table({"mini": pa.array(mini, pa.int64()), "whole": pa.array(whole, pa.int64()),
                     "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})


def _indexed(length: int):
    def run(table: pa.Table) -> pa.Table:
        """The repeated windows of one bucket's distinct contents."""
        mini, whole = np.asarray(table["mini"]), np.asarray(table["whole"])
        _, first = np.unique(np.stack([mini, whole], 1), axis=0, return_index=True)  # repeated rows of a document
        table = table.take(pa.array(first))
        mini, whole, times = (np.asarray(table[c]) for c in ("mini", "whole", "times"))
        raw = table["bytes"].to_pylist()
        bounds = np.cumsum([0, *map(len, raw)])
        match = matching_statistics(np.frombuffer(b"".join(raw), np.uint8), bounds)
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])
        hit = (match >= length) | (np.repeat(times > 1, np.diff(bounds)) & (left >= length))
        own, lo, hi = _runs(hit, bounds)
        return _span_batch(mini[own], whole[own], lo, hi)

    return run


def _cut_again(rows: DataFrame, length: int, core: int) -> DataFrame:
    """The contents' segments by a longer minimizer: (mini, whole, times, at, n, mini2, whole2)."""
    def run(batches):
        for batch in batches:
            for block in tk.blocks(batch.column(3)):
                doc, at, n, mini, whole = segments(block, length, core)
                of = pa.array(block.lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(of) for c in range(3)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(mini.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["mini", "whole", "times", "at", "n", "mini2", "whole2"])

    return rows.select("mini", "whole", "times", "bytes").mapInArrow(
        run, "mini bigint, whole bigint, times bigint, at int, n int, mini2 bigint, whole2 bigint")


def _cut_out(length: int):
    def run(batches):
        """The bytes of segments (at, n) of contents."""
        for batch in batches:
            raw, at, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bytes", "at", "n"))
            got = [x[a: a + m - 1 + length] for x, a, m in zip(raw, at, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("mini2", "whole2", "times")),
                                              pa.array(got, pa.binary())], names=["mini", "whole", "times", "bytes"])

    return run


def _spans(contents: DataFrame, length: int, cores: tuple[int, ...], hot: int, bucket_bytes: int) -> DataFrame:
    """(mini, whole, lo, hi): runs of repeated windows of the distinct ``contents`` (mini, whole, times, bytes)."""
    sizes = contents.groupBy("mini").agg(F.sum(F.length("bytes")).alias("size"))
    common = materialize(sizes.where(F.col("size") > hot).select("mini", F.lit(True).alias("common")))
    tagged = materialize(contents.join(common, "mini", "left"))
    total = tagged.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    index = (tagged.where("common is null").drop("common").withColumn("bucket", F.pmod(F.xxhash64("mini"), F.lit(buckets)))
             .groupBy("bucket").applyInArrow(_indexed(length), _SPANS))
    if not cores or common.head() is None:
        return index
    rows = tagged.where("common").dropDuplicates(["mini", "whole"])
    parts = materialize(_cut_again(rows, length, cores[0]))
    again = parts.groupBy("mini2").agg(F.sum("times").alias("c"), F.min("whole2").alias("x"), F.max("whole2").alias("y"))
    again = materialize(again.where("c > 1").select("mini2", (F.col("x") != F.col("y")).alias("mixed")))
    parts = materialize(parts.join(again, "mini2"))
    found = parts.where("not mixed").select("mini", "whole", F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi"))
    mixed = parts.where("mixed")
    if mixed.head() is not None:
        kinds = materialize(mixed.groupBy("mini2", "whole2").agg(
            F.sum("times").alias("times"), F.min(F.struct("mini", "whole", "at", "n")).alias("r")).select("mini2", "whole2", "times", "r.*"))
        cut = kinds.join(rows.select("mini", "whole", "bytes"), ["mini", "whole"]).mapInArrow(
            _cut_out(length), "mini bigint, whole bigint, times bigint, bytes binary")
        inner = _spans(cut, length, cores[1:], hot, bucket_bytes).groupBy(F.col("mini").alias("mini2"), F.col("whole").alias("whole2")).agg(
            F.collect_set(F.struct("lo", "hi")).alias("s"))  # at most one entry for each window of a segment
        marked = mixed.join(materialize(inner), ["mini2", "whole2"]).select("mini", "whole", "at", F.explode("s").alias("s"))
        found = found.union(marked.select("mini", "whole", F.col("at") + F.col("s.lo"), F.col("at") + F.col("s.hi")))
    return index.union(found)


def repeated_windows(docs: DataFrame, length: int = LENGTH, cores: tuple[int, ...] = CORES, hot: int = HOT_BYTES,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(ref, at, n) window runs that are repeats, from (ref, text); a run covers bytes at to at + n - 1 + length."""
    parts = materialize(_segment_table(docs, length, cores[0]))
    again = (parts.groupBy("mini").agg(F.count("*").alias("c"), F.min("whole").alias("x"), F.max("whole").alias("y"))
             .where("c > 1").select("mini", (F.col("x") != F.col("y")).alias("mixed")))
    # a table of its own: a join right on the sums would keep their partitioning, and a hot minimizer could not be split
    repeated = materialize(parts.join(materialize(again), "mini"))
    alike = repeated.where("not mixed").select("ref", "at", "n")
    mixed = repeated.where("mixed")
    kinds = (mixed.groupBy("mini", "whole").agg(F.count("*").alias("times"), F.min(F.struct("ref", "at", "n")).alias("r"))
             .select("mini", "whole", "times", "r.*"))
    index = _spans(materialize(_contents(docs, materialize(kinds), length)), length, cores[1:], hot, bucket_bytes)
    spans = index.groupBy("mini", "whole").agg(F.collect_set(F.struct("lo", "hi")).alias("s"))  # at most one for each window
    marked = (mixed.join(materialize(spans), ["mini", "whole"]).select("ref", "at", F.explode("s").alias("s"))
              .select("ref", (F.col("at") + F.col("s.lo")).alias("at"), (F.col("s.hi") - F.col("s.lo")).alias("n")))
    return alike.unionByName(marked)


def _cut(length: int):
    def one(raw: bytes, at: np.ndarray, n: np.ndarray):
        """The bytes left, how many go, and the maximal runs that go."""
        if not len(at):
            return raw, 0, []
        order = np.argsort(at, kind="stable")
        lo, hi = at[order], np.maximum.accumulate((at + n - 1 + length)[order])
        new = np.ones(len(lo), bool)
        new[1:] = lo[1:] > hi[:-1]
        first = np.flatnonzero(new)
        lo, hi = lo[first].tolist(), hi[np.append(first[1:], len(hi)) - 1].tolist()
        kept = b"".join(raw[a:b] for a, b in zip([0, *hi], [*lo, len(raw)], strict=True))
        return kept, len(raw) - len(kept), list(zip(lo, hi, strict=True))

    return one


def remove_repeats(docs: DataFrame, length: int = LENGTH, replace: bool = False, **limits) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and spans (start and end of the removed runs, in bytes).

    Every byte covered by a ``length``-byte string that also starts elsewhere (any document, the same one included;
    overlaps count) is removed, all copies alike; whole texts count as UTF-8 bytes. A null text is empty: 0 bytes,
    nothing removed. Repeated rows are copies of each other. Columns of the new names are replaced. With ``replace`` the columns of ``docs`` are returned
    instead, text holding the remaining bytes (a character that lost a part of its bytes goes as a whole; a null text
    stays null) and n_chars, if there is one, its characters.
    """
    # equal rows have equal marks, so (doc_id, text) may stand for a row; the count of each is kept in the segments
    if not replace:
        docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    keyed = docs.withColumn("__ref", F.xxhash64("doc_id", "text"))
    texts = keyed.where("text is not null").select(F.col("__ref").alias("ref"), "text")
    marks = (repeated_windows(texts, length, **limits).groupBy(F.col("ref").alias("__ref"))
             .agg(F.collect_set(F.struct("at", "n")).alias("__marks")))  # equal rows mark the same
    joined = keyed.join(marks, "__ref", "left").drop("__ref")
    own = docs.columns
    text_at, marks_at = own.index("text"), len(own)
    cut = _cut(length)
    if replace:
        schema = docs.schema
    else:
        schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + T.StructType.fromDDL(
            "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
            "spans array<struct<lo: bigint, hi: bigint>>").fields)

    def run(batches):
        for batch in batches:
            marks = batch.column(marks_at)
            flat, off = marks.flatten(), np.asarray(marks.offsets)
            at, n = (np.asarray(flat.field(c)).astype(np.int64) for c in ("at", "n"))
            out = []
            for i, text in enumerate(batch.column(text_at).to_pylist()):
                raw = (text or "").encode()
                s = slice(off[i] - off[0], off[i + 1] - off[0])
                out.append((text, raw, *cut(raw, at[s], n[s])))
            cols = {c: batch.column(k) for k, c in enumerate(own)}
            if replace:
                new = [x[0] if x[0] is None or not x[3] else x[2].decode(errors="ignore") for x in out]
                cols["text"] = pa.array(new, batch.column(text_at).type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if x is None else len(x) for x in new], cols["n_chars"].type)
            else:
                del cols["text"]
                cols |= {"n_bytes": pa.array([len(x[1]) for x in out], pa.int64()), "n_removed": pa.array([x[3] for x in out], pa.int64()),
                         "n_spans": pa.array([len(x[4]) for x in out], pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in out]),
                         "spans": pa.array([[{"lo": a, "hi": b} for a, b in x[4]] for x in out],
                                           pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return joined.mapInArrow(run, schema)
