"""Homomorphic multiset hashes of documents.

A text is the multiset of its paragraphs (lines); a long paragraph is a run of stretches that end before a word whose own
hash says so, so an edit moves no stretch but its own. Every stretch is hashed to a wide vector, and a text's fingerprint
is the sum of the vectors: ``LANES`` lanes of hashes modulo 2^64 and ``SIGNS`` lanes of +1 or -1 modulo 2^16. Sums don't
depend on the order of paragraphs, and inserting or deleting a paragraph adds or subtracts its vector, without the text.
The wide lanes tell multisets apart; the sign lanes, a sum of random signs each, estimate how much two multisets share:
the inner product of two sums is the number of equal pairs of stretches, up to noise of about 1 / sqrt(SIGNS).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.llm import textkit as tk
from riskpanel.session import materialize

LANES = 8
SIGNS = 256
CUT = 8  # one word in so many begins a stretch
BYTES = LANES * 8 + SIGNS * 2
SAMPLES = 32  # of the key order, for each bucket
_UNITS = 1 << 15
_SALT = tk.mix64(np.arange(1, LANES + SIGNS // 64 + 2, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))


def stretches(block: tk.Block, cut: int = CUT):
    """Owner, start, end and whether it ends inside its paragraph, of every stretch of the block's texts. A text has one
    paragraph more than line ends; an empty paragraph is an empty stretch."""
    s, _, wb = block.words()
    h = tk.span_hashes(block.data, s, _)
    inner = (h % np.uint64(cut)) == 0
    after_line = np.flatnonzero(block.data == 10) + 1
    text_of_line = np.searchsorted(block.off, after_line - 1, side="right") - 1
    first = np.zeros(len(block.data) + 1, bool)
    first[block.off[:-1]] = True
    first[after_line] = True
    inner &= ~first[s]
    doc = np.concatenate([np.arange(block.n), text_of_line, tk.owners(wb)[inner]])
    start = np.concatenate([block.off[:-1], after_line, s[inner]])
    kind = np.concatenate([np.zeros(block.n, np.int8), np.ones(len(after_line), np.int8), np.full(int(inner.sum()), 2, np.int8)])
    order = np.lexsort((start, doc))
    doc, start, kind = doc[order], start[order], kind[order]
    end = block.off[doc + 1]
    goes_on = np.zeros(len(doc), bool)
    same = doc[1:] == doc[:-1]
    end[:-1] = np.where(same, start[1:] - (kind[1:] == 1), end[:-1])
    goes_on[:-1] = same & (kind[1:] == 2)
    return doc, start, end, goes_on


def vectors(block: tk.Block, cut: int = CUT) -> tuple[np.ndarray, np.ndarray]:
    """The sums of every text: (texts, LANES) of 64 bits and (texts, SIGNS) of 16."""
    doc, start, end, goes_on = stretches(block, cut)
    wide, signs = np.zeros((block.n, LANES), np.uint64), np.zeros((block.n, SIGNS), np.int64)
    with np.errstate(over="ignore"):
        h = tk.span_hashes(block.data, start, end) + np.where(goes_on, _SALT[-1], np.uint64(0))
        for lo in range(0, len(h), _UNITS):
            x, d = h[lo: lo + _UNITS, None], doc[lo: lo + _UNITS]
            at = np.flatnonzero(np.diff(d, prepend=-1))
            wide[d[at]] += np.add.reduceat(tk.mix64(x ^ _SALT[:LANES]), at, axis=0)
            bits = np.unpackbits(tk.mix64(x ^ _SALT[LANES: LANES + SIGNS // 64]).astype("<u8").view(np.uint8), axis=1)
            signs[d[at]] += 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int64) - np.diff(np.append(at, len(d)))[:, None]
    return wide, signs.astype(np.int16)  # the low 16 bits


def _packed(wide: np.ndarray, signs: np.ndarray) -> np.ndarray:
    return np.concatenate([wide.astype("<u8").view(np.uint8), signs.astype("<i2").view(np.uint8)], axis=1)


def _lanes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.ascontiguousarray(raw[:, : LANES * 8]).view("<u8"), np.ascontiguousarray(raw[:, LANES * 8:]).view("<i2"))


def _binary(raw: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in raw], pa.binary())


def _unpack(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of bytes; a null is that of nothing, all zero."""
    return np.frombuffer(b"".join(x or bytes(BYTES) for x in column.to_pylist()), np.uint8).reshape(-1, BYTES)


def of_texts(texts: pa.Array, cut: int = CUT) -> np.ndarray:
    """Fingerprints (texts, BYTES) of an Arrow column of texts; a null is an empty text."""
    found = [_packed(*vectors(block, cut)) for block in tk.blocks(texts)]
    return np.concatenate(found) if found else np.zeros((0, BYTES), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much of two multisets is shared, 0 to 1, from their fingerprints: twice the inner product by the sum of the
    squares. Equal fingerprints have 1."""
    x, y = (_lanes(v)[1].astype(np.float64) for v in (a, b))
    both = (x * x).sum(1) + (y * y).sum(1)
    share = np.clip(2 * (x * y).sum(1) / np.maximum(both, 1), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, share)


def fingerprints(docs: DataFrame, name: str = "fp", cut: int = CUT) -> DataFrame:
    """``docs`` with the fingerprint of every whole text as binary. A null text is empty; repeated rows are alike; a column
    of the new name is replaced."""
    return tk.add_columns(docs, "text", {name: "binary"}, lambda block: {name: _binary(_packed(*vectors(block, cut)))})


def edited(fps: DataFrame, name: str = "fp", inserted: str = "inserted", deleted: str = "deleted", cut: int = CUT) -> DataFrame:
    """``fps`` with the fingerprint ``name`` after the paragraphs of the text column ``inserted`` came to the text and those of
    ``deleted`` left it. Nothing else of the text is read. A null in either column changes nothing; a null fingerprint is
    that of no paragraph."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in (name, inserted, deleted)}
            wide, signs = _lanes(_unpack(col[name]))
            with np.errstate(over="ignore"):
                for c, sign in ((inserted, 1), (deleted, -1)):
                    there = ~np.asarray(col[c].is_null())[:, None]
                    w, s = _lanes(of_texts(col[c], cut))
                    w, s = np.where(there, w, np.uint64(0)), np.where(there, s, np.int16(0))
                    wide, signs = (wide + w, signs + s) if sign > 0 else (wide - w, signs - s)
            at = batch.schema.get_field_index(name)
            yield batch.set_column(at, batch.schema.field(at), _binary(_packed(wide, signs)))

    return fps.mapInArrow(run, fps.schema)


def combined(fps: DataFrame, keys: list[str], name: str = "fp") -> DataFrame:
    """(keys, fp): the fingerprint of all paragraphs of a group of documents, the sum of theirs. Tasks sum before the
    shuffle, so a group of a third of all rows is one row a task."""
    import pandas as pd

    kinds = [f for f in fps.schema.fields if f.name in keys]
    schema = T.StructType([next(f for f in kinds if f.name == k) for k in keys] + [T.StructField(name, T.BinaryType())])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        raw = _unpack(pa.array(frame[name].tolist(), pa.binary()))
        w, s = _lanes(raw)
        code = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        n = int(code.max()) + 1 if len(code) else 0
        wide, signs = np.zeros((n, LANES), np.uint64), np.zeros((n, SIGNS), np.int16)
        with np.errstate(over="ignore"):
            np.add.at(wide, code, w)
            np.add.at(signs, code, s)
        out = frame.iloc[np.unique(code, return_index=True)[1]][keys].copy()
        out[name] = [x.tobytes() for x in _packed(wide, signs)]
        return out

    def partly(frames):
        have = None
        for frame in frames:
            have = total(frame if have is None else pd.concat([have, frame]))
            if len(have) > 1 << 16:  # groups beyond this go out; the shuffle adds the rest
                yield have
                have = None
        if have is not None:
            yield have

    rows = fps.select(*keys, name)
    return rows.mapInPandas(partly, schema).groupBy(*keys).applyInPandas(total, schema)


def _bucket(splits, null, ident, h):
    """Places of the keys (null last, id, hash of the text) among the sorted ``splits``."""
    keys = np.empty(len(ident), [("null", "i1"), ("id", "i8"), ("h", "i8")])
    keys["null"], keys["id"], keys["h"] = null, ident, h
    return np.searchsorted(splits, keys, side="right"), keys


def _keyed(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ident = batch.column(0)
    return np.asarray(ident.is_null()), np.asarray(ident.fill_null(0)), batch.column(1).to_numpy()


def with_next(docs: DataFrame, fn, schema: str, buckets: int | None = None) -> DataFrame:
    """``fn`` (a batch of (doc_id, text), the batch of the rows that follow them) on all neighbours in the order of doc_id;
    after the last row comes the first.

    The order is cut at sampled keys into buckets of about equal rows; the first row of every bucket also goes, as a guest,
    to the end of the one before. So neighbours meet in one shuffle of the texts. Nulls stand last; rows of one id by a
    hash of their text, so a frequent id is spread too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    keys = materialize(hashed.drop("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 8 * n
    some = max(1, keys.count() // (buckets * SAMPLES))
    drawn = keys.where(F.pmod(F.xxhash64("h", "doc_id"), F.lit(some)) == 0).distinct().toArrow()  # about SAMPLES a bucket
    kind = [("null", "i1"), ("id", "i8"), ("h", "i8")]
    points = np.empty(drawn.num_rows, kind)
    if drawn.num_rows:
        batch = drawn.combine_chunks().to_batches()[0]
        points["null"], points["id"], points["h"] = _keyed(batch)
        points.sort()
    splits = points[np.unique(np.arange(1, buckets) * len(points) // buckets)] if len(points) else points
    sent = spark.sparkContext.broadcast(splits)

    def place(batches):
        for batch in batches:
            at, _ = _bucket(sent.value, *_keyed(batch))
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["bucket", "doc_id", "h"])

    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")
    firsts = [(r.bucket, r.k) for r in keys.mapInArrow(place, "bucket bigint, doc_id bigint, h bigint")
              .groupBy("bucket").agg(F.min(key).alias("k")).orderBy("bucket").collect()]  # one row a bucket
    # by a bucket's first key: the bucket before it, the last one for the first
    before = {(k.null, k.doc_id or 0, k.h): firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    sent_before = spark.sparkContext.broadcast(before)

    def deal(batches):
        gone = set()
        for batch in batches:
            null, ident, h = _keyed(batch)
            at, _ = _bucket(sent.value, null, ident, h)
            cols = [pa.array(at), pa.array(np.zeros(len(at), bool)), *batch.columns]
            names = ["bucket", "guest", "doc_id", "h", "text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            guests = [(i, k) for i, k in enumerate(zip(null.tolist(), ident.tolist(), h.tolist(), strict=True))
                      if k in sent_before.value and k not in gone]
            if guests:
                fresh = {k: i for i, k in guests}
                gone.update(fresh)
                rows = pa.array(list(fresh.values()))
                to = pa.array([sent_before.value[k] for k in fresh], pa.int64())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(to), bool)), *(c.take(rows) for c in batch.columns)], names=names)

    dealt = (hashed.mapInArrow(deal, "bucket bigint, guest boolean, doc_id bigint, h bigint, text string")
             .repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "h"))

    def meet(batches):
        last = None  # the row whose follower has not come yet
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if last is None else pa.concat_tables([last, t])
            t = t.combine_chunks()
            bucket, guest = np.asarray(t["bucket"]), np.asarray(t["guest"])
            here = np.flatnonzero((bucket[1:] == bucket[:-1]) & ~guest[:-1])
            # guests that several tasks sent are alike; the first of them follows
            if len(here):
                two = t.select(["doc_id", "text"])
                yield from fn(two.take(pa.array(here)), two.take(pa.array(here + 1)))
            last = t.slice(t.num_rows - 1, 1)

    return dealt.mapInArrow(meet, schema)


def edit_fingerprints(docs: DataFrame, cut: int = CUT, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs``
    (doc_id, text); other columns are ignored. fingerprints are binary.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in ascending order of doc_id; after the last comes the first, so a single document follows itself. A null
    text is empty; null ids stand last; rows of one id stand in the order of a hash of their text, repeated rows beside
    each other. An empty table gives an empty result.
    """
    def run(own: pa.Table, following: pa.Table):
        text = [x or "" for x in own["text"].to_pylist()]
        after = [x or "" for x in following["text"].to_pylist()]
        new = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(text, after, strict=True)]
        mine, then, changed = (of_texts(pa.array(x, pa.string()), cut) for x in (text, after, new))
        yield pa.RecordBatch.from_arrays(
            [own["doc_id"].combine_chunks(), pa.array(list(map(len, text)), pa.int64()),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]), _binary(mine), _binary(changed),
             pa.array(likeness(mine, changed)), pa.array(likeness(mine, then))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, "
                                "edited_fingerprint binary, near_edited double, near_next double", buckets)
