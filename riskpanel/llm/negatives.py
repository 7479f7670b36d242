"""Hard-negative mining by a secondary-sort shuffle.

Every anchor is scored against all rows; an anchor's positives are its nearest rows of the same label, and each positive
opens a window of scores in which rows of another label are hard negatives. Scored pairs are packed into keys
(anchor, descending score, positives first, id) and dealt out by anchor with ``repartitionAndSortWithinPartitions``; a
streaming iterator meets an anchor's positives before the negatives of their windows, opens a window for each, and emits
negatives as they come by. It holds the windows of one anchor and none of its rows.

Anchors go out in blocks of a fixed number of numbers. A block's anchors meet the rows in two passes that move no vectors:
the first finds the positives (each task sends its best few), the second, knowing the windows, sends of each task's
negatives the first few of every window. Both are exact partial sums of the sort: what a task leaves out has as many
better rows of its own window before it as the result can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.rdd import portable_hash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
BLOCK_NUMBERS = 1 << 18  # vector components of a block of anchors
_ROWS = 2048  # rows at a time
_MOST = 1 << 55  # scores stop there, so that 100 times a score is a long

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part: none with a null id, label or vector, or a null or non-finite
    component. Of the rows of one id the one with the least label, then the least vector, counts."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(~bad)
    least = found.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x"))
    return least.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x.label").cast("long").alias("label"), "x.vec")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, shorter ones filled with zeros."""
    off = np.asarray(column.offsets)
    flat, size = np.asarray(column.flatten()), np.diff(off)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products (rows x anchors), at most ``_MOST`` either way."""
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)), np.int64)
    top = [max(abs(int(x.min())), abs(int(x.max()))) for x in (rows, anchors)]
    if top[0] * top[1] * rows.shape[1] < 1 << 53:
        return (rows.astype(np.float64) @ anchors.T.astype(np.float64)).astype(np.int64)
    wide = rows.astype(object) @ anchors.T.astype(object)  # numbers beyond those that a double holds
    return np.clip(wide, -_MOST, _MOST).astype(np.int64)


def _first(groups: tuple[np.ndarray, ...], score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Of each group the first ``most`` places by descending score, then id."""
    order = np.lexsort((ident, -score, *groups[::-1]))
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < most]


def _batches(batches, width: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            ident = part.column(0).to_numpy()
            order = np.argsort(ident, kind="stable")
            yield ident[order], part.column(1).to_numpy()[order], _matrix(part.column(2), width)[order]


def _positives(rows: DataFrame, block, width: int, most: int) -> DataFrame:
    """(anchor, id, score): the first ``most`` rows of the anchor's label, of each task."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        names, labels, vectors = sent.value
        have = [np.zeros(0, np.int64)] * 3
        for ident, label, vec in _batches(batches, width):
            row, col = np.nonzero((label[:, None] == labels) & (ident[:, None] != names))
            new = names[col], ident[row], _scores(vec, vectors)[row, col]
            have = [np.concatenate(x) for x in zip(have, new, strict=True)]
            keep = _first((have[0],), have[2], have[1], most)
            have = [x[keep] for x in have]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in have], names=["anchor", "id", "score"])

    return rows.mapInArrow(run, "anchor bigint, id bigint, score bigint")


def _negatives(rows: DataFrame, block, windows: np.ndarray, width: int, most: int, low: int, high: int) -> DataFrame:
    """(anchor, id, score): of every window (anchor's place, positive's score) the first ``most`` rows of another label, of
    each task."""
    sent = rows.sparkSession.sparkContext.broadcast((*block, windows))

    def run(batches):
        names, labels, vectors, windows = sent.value
        place, positive = windows[:, 0], windows[:, 1]
        have = [np.zeros(0, np.int64)] * 3  # window, id, score
        for ident, label, vec in _batches(batches, width):
            s = _scores(vec, vectors)
            s[(label[:, None] == labels) | (ident[:, None] == names)] = -_MOST - 1
            down = np.argsort(-s, axis=0, kind="stable")  # rows stand in order of their ids
            s = np.take_along_axis(s, down, axis=0)
            of = s[:, place]
            start = (100 * of > high * positive).sum(axis=0)
            at = start[:, None] + np.arange(most)
            real = at < len(s)
            at = np.minimum(at, len(s) - 1)
            score = of[at, np.arange(len(place))[:, None]]
            real &= (100 * score >= low * positive[:, None]) & (score >= -_MOST)
            window, k = np.nonzero(real)
            new = window, ident[down[at[window, k], place[window]]], score[window, k]
            have = [np.concatenate(x) for x in zip(have, new, strict=True)]
            keep = _first((have[0],), have[2], have[1], most)
            have = [x[keep] for x in have]
        pairs = np.unique(np.stack([place[have[0]], have[1], have[2]], 1), axis=0)  # a row may be in several windows
        yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2])],
                                         names=["anchor", "id", "score"])

    return rows.mapInArrow(run, "anchor bigint, id bigint, score bigint")


def _windows(most_positives: int, most: int, low: int, high: int):
    def run(pairs):
        """Windows open as an anchor's positives come by; the negatives after them are emitted for each that they are in."""
        anchor, opened = None, []
        for (a, down, kind, ident), _ in pairs:
            if a != anchor:
                anchor, opened = a, []
            if kind == 0:
                if len(opened) < most_positives:
                    opened.append([ident, -down, 0])
                continue
            for w in opened:
                if w[2] < most and low * w[1] <= -100 * down <= high * w[1]:
                    w[2] += 1
                    yield a, w[0], w[2], ident, w[1], -down

    return run


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, vec), vec an array of
    longs; other columns are ignored.

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are its first ``positives`` other rows
    of the same label by inner product, ties by smaller id (all, if fewer); for each of them come the first ``negatives``
    rows of another label with low <= 100 * score / positive's score <= high, ranked from 1. A score is exact up to 2^55
    and stops there. Vectors of different lengths are filled with zeros. Rows with a null id, label, vector or component
    take no part, and of repeated ids one row does (see ``usable``). An empty table, or one without anchors, gives an empty
    result. An anchor without positives, or whose positives have negative scores, has no rows.
    """
    spark = rows.sparkSession
    rows = materialize(usable(rows))
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    queries = rows.where(F.col("vec_id") % every == 0)
    count = queries.count()
    blocks = -(-count * max(1, width) // block_numbers)
    parts = []
    for k in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).orderBy("vec_id").toArrow()  # one block of anchors
        if not mine.num_rows:
            continue
        names, labels = np.asarray(mine["vec_id"]), np.asarray(mine["label"])
        block = names, labels, _matrix(mine["vec"].combine_chunks(), width)
        best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        near = materialize(_positives(rows, block, width, positives).withColumn("k", F.row_number().over(best))
                           .where(F.col("k") <= positives).drop("k"))
        found = near.toArrow()  # at most ``positives`` for each anchor of the block
        if not found.num_rows:
            continue
        windows = np.unique(np.stack([np.searchsorted(names, np.asarray(found["anchor"])), np.asarray(found["score"])], 1), axis=0)
        far = _negatives(rows, block, windows[windows[:, 1] >= 0], width, negatives, low, high)
        keyed = near.withColumn("kind", F.lit(0)).union(far.withColumn("kind", F.lit(1))).rdd.map(
            lambda r: ((r.anchor, -r.score, r.kind, r.id), None))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = keyed.repartitionAndSortWithinPartitions(n, lambda key: portable_hash(key[0]))
        parts.append(materialize(spark.createDataFrame(
            dealt.mapPartitions(_windows(positives, negatives, low, high)), RESULT)))
    out = spark.createDataFrame([], RESULT)
    for part in parts:
        out = out.union(part)
    return out
