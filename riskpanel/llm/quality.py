"""Quality rules: a hashed n-gram log-likelihood ratio with exact base rules.

Every text is a bag of hashed word unigrams and bigrams. Two multinomials over the hash buckets are estimated, one from
trusted documents and one from all documents, and a text's score is the mean over its n-grams of the log ratio of the
two. A text is kept when the base rules pass and its score reaches a fixed threshold.

The bucket counts cover every document: each task sums its rows into one histogram, so the shuffle carries at most
``buckets`` rows a task, and the table that is sent back to the tasks has ``buckets`` numbers at any corpus size.
The trusted side may be named by a bounded number of labelled ids (``trusted_ids``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm import textkit as tk

BUCKETS = 1 << 16
TRUSTED_ROWS = 1 << 16
ALPHA = 5.0
THRESHOLD = -0.06
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """Sorted ids of at most ``rows`` documents labelled quality 1, the same ones on every run (smallest crc32 of the
    id as text). Null ids and null labels name no document."""
    ids = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
           .select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
           .orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows))
    return np.sort(np.array([r[0] for r in ids.collect()], np.int64))


def _buckets(block: tk.Block, n_buckets: int):
    """Bucket and text of every n-gram, and the words of the block."""
    s, e, wb = block.words()
    h = tk.span_hashes(block.data, s, e)
    two = tk.gram_hashes(h, 2)
    ok = tk.inside(wb, 2, len(h))[: len(two)]
    doc = tk.owners(wb)
    grams = np.concatenate([h, two[ok]]) & np.uint64(n_buckets - 1)
    return grams.astype(np.int64), np.concatenate([doc, doc[: len(two)][ok]]), (s, e, wb, h)


def bucket_counts(docs: DataFrame, trusted: np.ndarray, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n_raw, n_target) over all documents."""
    def run(batches):
        raw, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.isin(ids, trusted) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for block in tk.blocks(batch.column(1)):
                g, doc, _ = _buckets(block, n_buckets)
                raw += np.bincount(g, minlength=n_buckets)
                target += np.bincount(g[known[block.lo + doc]], minlength=n_buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])],
                                         names=["bucket", "n_raw", "n_target"])

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, n_raw long, n_target long")
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: DataFrame, n_buckets: int = BUCKETS, alpha: float = ALPHA) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw) of every bucket. ``n_buckets`` numbers.

    Both sides are smoothed by ``alpha`` counts at the size of the trusted side, so that a bucket that neither side has
    seen often says nothing about a text.
    """
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in counts.collect():  # at most n_buckets rows
        raw[r.bucket], target[r.bucket] = r.n_raw, r.n_target
    raw *= target.sum() / max(1.0, raw.sum())
    return (np.log((target + alpha) / (target.sum() + alpha * n_buckets))
            - np.log((raw + alpha) / (raw.sum() + alpha * n_buckets)))


def _repeat_words(h: np.ndarray, wb: np.ndarray, n: int) -> np.ndarray:
    """Words of each text inside an n-word window that occurs at least twice in that text."""
    covered = np.zeros(len(h) + 1, np.int64)
    g = tk.gram_hashes(h, n)
    if len(g):
        at = np.flatnonzero(tk.inside(wb, n, len(h)))
        with np.errstate(over="ignore"):
            key = tk.mix64(g[at] + tk.mix64(tk.owners(wb)[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + n, -1)
    return tk.per_text((np.cumsum(covered)[:-1] > 0).astype(np.int64), wb)


def _dup_lines(block: tk.Block, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    d, off = block.data, block.off
    nl = d == 10
    start = np.zeros(len(d) + 1, bool)
    start[off[:-1]] = True
    start[1:] |= nl
    at = np.flatnonzero(start)
    # a start at a text's end is an empty line; it has no word and may be left out
    at = at[at < len(d)]
    if not len(at):
        return np.zeros(block.n, np.int64)
    end = np.append(at[1:], len(d))
    end = end - nl[end - 1]  # without the line's own \n
    has = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, at)
    at, end = at[has], end[has]
    doc = np.searchsorted(off, at, side="right") - 1
    h = tk.span_hashes(d, at, end)
    with np.errstate(over="ignore"):
        key = tk.mix64(h + tk.mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    later = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(doc[later], minlength=block.n)


def quality_rules(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words, n_grams, llr, base_failed, kept.

    One row for each input row (repeated rows each get their own); a null or empty text has zero counts, llr 0 and
    fails the base rules. Any other columns of ``docs`` pass through.
    """
    ratio = log_ratios(bucket_counts(docs, trusted_ids(labels, trusted_rows), n_buckets), n_buckets)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # n_buckets numbers

    def score(block: tk.Block) -> dict:
        g, doc, (s, e, wb, h) = _buckets(block, n_buckets)
        n_grams = np.bincount(doc, minlength=block.n)
        total = np.bincount(doc, weights=sent.value[g], minlength=block.n)
        llr = total / np.maximum(n_grams, 1)
        n_words, repeat = np.diff(wb), _repeat_words(h, wb, WINDOW)
        chars = tk.per_text((~tk.SPACE[block.data] & ~tk.CONT[block.data]).astype(np.int64), block.off)
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        return {"n_words": n_words, "word_chars": chars,
                "n_symbols": tk.per_text(_SYMBOL[block.data].astype(np.int64), block.off),
                "n_dup_lines": _dup_lines(block, s), "n_repeat_words": repeat, "n_grams": n_grams, "llr": llr,
                "base_failed": failed, "kept": ~failed & (llr >= threshold)}

    return tk.add_columns(docs, "text", {
        "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
        "n_grams": "long", "llr": "double", "base_failed": "boolean", "kept": "boolean"}, score)
