"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is the stated query set. It is taken in blocks of bounded size; each block's items are sent to the tasks,
and every document is searched for them where it lies, so no text is shuffled. A block takes two passes over the corpus:
the first counts in how many documents each n-gram of the items occurs, the second looks for the rare ones (of each item
all but the commonest quarter), aligns the words around the seeds with the item, and scores the best local alignment
against that of a perfect copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm import textkit as tk

SEED_WORDS = 3
COMMON_SHARE = 0.25
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
BLOCK_BYTES = 1 << 22  # of benchmark text at a time
_LOW = 24  # bits below a score that hold where its alignment began
_CELLS = 1 << 21
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def bare_words(block: tk.Block):
    """Hashes of the lower-cased words without punctuation at their ends, and the texts' bounds among them; words of
    punctuation only are left out."""
    low = tk.LOWER[block.data]
    s, e, wb = block.words(low)
    s, e = s.copy(), e.copy()
    for _ in range(4):
        live = e > s
        e -= live & _PUNCT[low[np.maximum(e - 1, 0)]]
        live = e > s
        s += live & _PUNCT[low[np.minimum(s, len(low) - 1)]] if len(low) else 0
    keep = e > s
    bounds = np.concatenate([[0], np.cumsum(keep)])[wb]
    return tk.span_hashes(low, s[keep], e[keep]), bounds


class Items:
    """One block of benchmark items, ready to search for."""

    def __init__(self, ids: list, words: list[np.ndarray], n: int):
        self.ids, self.words, self.n = ids, words, n
        grams, item, at = [], [], []
        for k, w in enumerate(words):
            g = tk.gram_hashes(w, n)
            grams.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        self.gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.item = np.concatenate([*item, np.zeros(0, np.int64)]).astype(np.int64)
        self.at = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        self.known = np.unique(self.gram)

    def rare(self, freq: dict[int, int], common_share: float) -> None:
        """Keep as seeds, of each item, all but its commonest grams (ties by position)."""
        f = np.array([freq.get(int(g), 0) for g in self.gram.view(np.int64)], np.int64)
        order = np.lexsort((self.at, f, self.item))
        size = np.bincount(self.item, minlength=len(self.words))
        nth = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        keep = np.sort(order[nth < np.ceil(size * (1 - common_share))[self.item[order]]])
        by = keep[np.argsort(self.gram[keep], kind="stable")]
        self.seed, self.seed_item, self.seed_at = self.gram[by], self.item[by], self.at[by]


def load_items(rows: list, n: int) -> Items:
    """Items from (item_id, text) rows; those with fewer than n words have no seed and match nothing."""
    texts = pa.array([r[1] for r in rows], pa.string())
    words = []
    for block in tk.blocks(texts):
        h, b = bare_words(block)
        words += [h[b[k]: b[k + 1]] for k in range(block.n)]
    return Items([r[0] for r in rows], words, n)


def _hits(grams: np.ndarray, ok: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Positions of the grams that are in the sorted array ``known``."""
    if not len(known) or not len(grams):
        return np.zeros(0, np.int64)
    # a small table of the hashes' high bits leaves few to look up
    table = np.zeros(1 << 20, bool)
    table[(known >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)] & ok[: len(grams)])
    g = grams[at]
    k = np.minimum(np.searchsorted(known, g), len(known) - 1)
    return at[known[k] == g]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its window (word hashes): score, and the first and one past the last
    window word. All pairs go row by row together; the start of an alignment travels in the low bits of its score."""
    b = len(items)
    m, w = max(map(len, items)), max(map(len, windows))
    it, win = np.zeros((b, m), np.uint64), np.zeros((b, w), np.uint64)
    for k in range(b):
        it[k, : len(items[k])] = items[k]
        win[k, : len(windows[k])] = windows[k]
    real, il = np.arange(w) < np.array([len(x) for x in windows])[:, None], np.array([len(x) for x in items])
    unit = 1 << _LOW
    floor = np.arange(1, w + 1, dtype=np.int64)  # score 0, alignment begins after this word
    steps = np.arange(w, dtype=np.int64) * (-GAP * unit)
    prev = np.broadcast_to(floor, (b, w)).copy()
    best, end = np.zeros(b, np.int64), np.zeros(b, np.int64)
    rows = np.arange(b)
    for i in range(m):
        same = (win == it[:, i: i + 1]) & real
        diag = np.empty_like(prev)
        diag[:, 1:] = prev[:, :-1]
        diag[:, 0] = 0
        cur = np.maximum(diag + np.where(same, MATCH * unit, MISMATCH * unit), prev + GAP * unit)
        cur = np.maximum(cur, floor)
        cur = np.maximum.accumulate(cur + steps, axis=1) - steps
        cur = np.maximum(cur, floor)
        cur[~real] = 0
        j = cur.argmax(axis=1)
        top = cur[rows, j]
        better = (top >> _LOW > best >> _LOW) & (i < il)
        best[better], end[better] = top[better], j[better] + 1
        prev = cur
    return best >> _LOW, best & (unit - 1), end


def _pairs(block: tk.Block, items: Items):
    """The passages to align: (text, item, first word, one past the last), from seeds gathered by diagonal."""
    h, bounds = bare_words(block)
    g = tk.gram_hashes(h, items.n)
    at = _hits(g, tk.inside(bounds, items.n, len(h)), np.unique(items.seed))
    if not len(at):
        return h, bounds, []
    lo, hi = np.searchsorted(items.seed, g[at], "left"), np.searchsorted(items.seed, g[at], "right")
    n = hi - lo
    pos = np.repeat(at, n)
    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, off = items.seed_item[k], items.seed_at[k]
    doc = np.searchsorted(bounds, pos, side="right") - 1
    begin = pos - off  # where the item would begin
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    length = np.array([len(w) for w in items.words])
    slack = length[item] // 2 + 4
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    a = np.maximum(begin[first] - slack[first], bounds[doc[first]])
    b = np.minimum(begin[last] + length[item[first]] + slack[first], bounds[doc[first] + 1])
    return h, bounds, list(zip(doc[first].tolist(), item[first].tolist(), a.tolist(), b.tolist(), strict=True))


def _search(block: tk.Block, items: Items, min_score: float) -> dict:
    """The best passage of each (text, item) that scores enough: (text, item) to (score, first word, last word + 1)."""
    h, bounds, pairs = _pairs(block, items)
    pairs.sort(key=lambda p: (p[3] - p[2], len(items.words[p[1]])))
    out: dict = {}
    lo = 0
    while lo < len(pairs):
        hi, widest = lo, 1
        while hi < len(pairs):
            widest = max(widest, pairs[hi][3] - pairs[hi][2])
            if hi > lo and (hi - lo + 1) * widest > _CELLS // 16:
                break
            hi += 1
        part = pairs[lo:hi]
        score, first, last = align([items.words[p[1]] for p in part], [h[p[2]: p[3]] for p in part])
        for p, s, f, e in zip(part, score.tolist(), first.tolist(), last.tolist(), strict=True):
            s /= MATCH * len(items.words[p[1]])
            if s >= min_score and s > out.get(p[:2], (0,))[0]:
                base = p[2] - int(bounds[p[0]])
                out[p[:2]] = (s, base + f, base + e)
        lo = hi
    return out


def _item_blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in blocks that each fit the driver and a broadcast."""
    b = benchmark.select("item_id", "text").where("text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]


def _ready(docs: DataFrame, rows: list, n: int, common_share: float) -> Items:
    items = load_items(rows, n)
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        known = sent.value.known
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for block in tk.blocks(batch.column(0)):
                h, bounds = bare_words(block)
                g = tk.gram_hashes(h, sent.value.n)
                at = _hits(g, tk.inside(bounds, sent.value.n, len(h)), known)
                doc = np.searchsorted(bounds, at, side="right") - 1
                k = np.searchsorted(known, g[at])
                once = np.unique(doc * len(known) + k) % max(1, len(known))
                total += np.bincount(once, minlength=len(known))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[hit].view(np.int64)), pa.array(total[hit])], names=["gram", "n"])

    freq = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    items.rare({r.gram: r.n for r in freq.collect()}, common_share)  # at most the grams of this block of items
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, min_score: float = MIN_SCORE,
                 common_share: float = COMMON_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): every document and benchmark item of which the document holds a
    passage that aligns with at least ``min_score`` of a perfect copy's score; the best passage of each pair.

    Words are lower-cased (A-Z) and bare of punctuation at their ends. Null and empty texts and items match nothing,
    nor do items of fewer than ``n`` words. Repeated rows of documents or items give repeated rows.
    """
    schema = "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint"
    out = None
    for rows in _item_blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(_ready(docs, rows, n, common_share))

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                ids = batch.column(0)
                for block in tk.blocks(batch.column(1)):
                    hit = sorted(_search(block, items, min_score).items())
                    if hit:
                        yield pa.RecordBatch.from_arrays([
                            ids.take(pa.array([block.lo + k[0] for k, _ in hit])),
                            pa.array([items.ids[k[1]] for k, _ in hit], pa.int64()),
                            *(pa.array([v[c] for _, v in hit], t) for c, t in enumerate((pa.float64(), pa.int64(), pa.int64())))],
                            names=["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, min_score: float = MIN_SCORE,
                         common_share: float = COMMON_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, judged where they lie; all columns."""
    out = docs
    for rows in _item_blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(_ready(docs, rows, n, common_share))

        def judge(block, sent=sent):
            bad = np.zeros(block.n, bool)
            for k, _ in _search(block, sent.value, min_score):
                bad[k] = True
            return {"__leak": bad}

        out = tk.add_columns(out, "text", {"__leak": "boolean"}, judge).where("not __leak").drop("__leak")
    return out
