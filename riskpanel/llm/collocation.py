"""Phrase collocations by direct-address tiling of frequency-ranked ids.

1. Texts are cut into words once; a task writes blocks of word places with the block's own word list. Words are counted
   over all blocks, the frequent ones are ranked by count, and each block gets back the ids of its words.
2. Neighbouring ids of a block are pairs (x, y). Pairs fall into tiles of ``Tiling.tile`` ids to a side. Tiles of the commonest ids are
   counted by direct address (a dense array, ``np.bincount``) where they are full enough; all others are gathered into
   bands and counted as sorted coordinate lists. A block's pairs are summed before they leave it, and tiles of common ids
   are also split by block, so no group grows with the corpus.
3. Frequent pairs are ranked by count and become the symbols of the next round: two neighbouring pairs that share their
   middle word are a pair of symbols, and so on up to the longest phrase. A place without a frequent phrase has no symbol,
   so rounds get smaller.

Ids go back to blocks by joins on tiles and blocks; no vocabulary is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm import textkit as tk
from riskpanel.operators.ranks import numbered
from riskpanel.session import discard, materialize

LEAST = 100  # occurrences of a candidate
WORDS = 5  # of a phrase at most
TOP = 2000  # phrases reported for each language
SALTS = 32


class Tiling(NamedTuple):
    """How pairs are dealt out."""

    tile: int = 1 << 10  # ids to a side
    head: int = 8  # tiles to a side that are counted on their own
    block: int = 1 << 19  # words
    group: int = 1 << 21  # pairs to a band, about
    split: int = 32  # blocks' words to a salt of a common tile

    @property
    def tiles(self) -> int:
        return self.head * self.head


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def places(block: tk.Block):
    """Starts and ends of the words, the texts' bounds among them, and which words don't follow the one before in the same
    piece of the same text."""
    low = block.data
    word = ~(_BLANK | _STOP)[low]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = block.off[1:-1]
    cut = cut[(cut > 0) & (cut < len(low))]
    first[cut] |= word[cut]
    last[cut - 1] |= word[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(s, block.off)
    stops = np.cumsum(_STOP[low]) if len(low) else np.zeros(0, np.int64)
    new = np.ones(len(s), bool)
    new[1:] = stops[s[1:]] != stops[s[:-1]]
    starts = bounds[:-1]
    new[starts[starts < len(s)]] = True
    return s, e, bounds, new


_ZSTD = pa.Codec("zstd", 1)


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed byte planes, rising ones as their steps."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else np.ascontiguousarray(x)
    return len(x).to_bytes(8, "little") + _ZSTD.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), asbytes=True)


def unpacked(raw: bytes, kind, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], n * size, asbytes=True), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(n)
    return np.cumsum(x, dtype=kind) if rising else x


class _Open:
    """Words of one language that wait for their block to be full."""

    def __init__(self):
        self.hashes, self.new, self.size, self.texts = [], [], 0, {}

    def add(self, h, new, keys, words):
        self.hashes.append(h)
        self.new.append(new)
        self.size += len(h)
        self.texts.update(zip(keys, words, strict=True))

    def row(self, bands: int):
        """The block: its places as numbers of words from 1, with a 0 before every piece, and its word lists, one for each
        band of hashes: band, number of the first word, words, and their counts."""
        keys, which, n = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        new = np.concatenate(self.new)
        band = (keys % np.uint64(bands)).astype(np.int64)
        order = np.argsort(band, kind="stable")
        number = np.empty(len(keys), np.uint32)
        number[order] = np.arange(1, len(keys) + 1)
        seq = np.zeros(len(which) + int(new.sum()), np.uint32)
        seq[np.arange(len(which)) + np.cumsum(new)] = number[which]
        keys, band, n = keys[order].tolist(), band[order], n[order].astype(np.uint32)
        cut = np.flatnonzero(np.diff(band, prepend=-1)).tolist()
        lists = []
        for lo, hi in zip(cut, [*cut[1:], len(keys)], strict=True):
            words = "\n".join([self.texts[k] for k in keys[lo:hi]]).encode()
            lists.append({"band": int(band[lo]), "k": lo, "words": packed(np.frombuffer(words, np.uint8)), "n": packed(n[lo:hi])})
        return seq, lists


_LISTS = pa.list_(pa.struct([("band", pa.int64()), ("k", pa.int64()), ("words", pa.binary()), ("n", pa.binary())]))


def _listed(raw: bytes) -> list[str]:
    return unpacked(raw, np.uint8).tobytes().decode().split("\n")


def _blocks(docs: DataFrame, lang: str, size: int, bands: int) -> DataFrame:
    """(block, lang, seq, lists) of all texts."""
    def run(batches):
        part, made, waiting = TaskContext.get().partitionId(), 0, {}

        def out(key):
            nonlocal made
            seq, lists = waiting.pop(key).row(bands)
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | made]), pa.array([key]), pa.array([packed(seq)], pa.binary()), pa.array([lists], _LISTS)],
                names=["block", "lang", "seq", "lists"])

        for batch in batches:
            langs, of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for block in tk.blocks(batch.column(1)):
                low = tk.Block(tk.LOWER[block.data], block.off, block.lo)
                s, e, bounds, new = places(low)
                if not len(s):
                    continue
                h = tk.span_hashes(low.data, s, e)
                raw = low.data.tobytes()
                word_lang = of[block.lo: block.lo + block.n][tk.owners(bounds)]
                for k in np.unique(word_lang).tolist():
                    mine = np.flatnonzero(word_lang == k)
                    keys, at = np.unique(h[mine], return_index=True)
                    some = waiting.setdefault(langs[k], _Open())
                    fresh = [i for i, x in enumerate(keys.tolist()) if x not in some.texts]
                    at = mine[at[fresh]]
                    some.add(h[mine], new[mine], keys[fresh].tolist(),
                             [raw[a:b].decode() for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
                    if some.size >= size:
                        yield out(langs[k])
                while sum(x.size for x in waiting.values()) > 4 * size:  # many languages
                    yield out(max(waiting, key=lambda key: waiting[key].size))
        for key in sorted(waiting):
            yield out(key)

    d = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, "block bigint, lang string, seq binary, "
                             "lists array<struct<band: bigint, k: bigint, words: binary, n: binary>>")


def _word_counts(lists: DataFrame, least: int) -> DataFrame:
    """(lang, band, phrase, a) of the words that occur ``least`` times or more, and a null phrase with the number of all."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}
        for batch in batches:
            for words, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for w, m in zip(_listed(words), unpacked(n, np.uint32).tolist(), strict=True):
                    count[w] = count.get(w, 0) + m
        kept = {w: m for w, m in count.items() if m >= least}
        size = len(kept) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()] * size), pa.array([key[1].as_py()] * size), pa.array([*kept, None], pa.string()),
             pa.array([*kept.values(), sum(count.values())], pa.int64())], names=["lang", "band", "phrase", "a"])

    return lists.groupBy("lang", "band").applyInArrow(run, "lang string, band bigint, phrase string, a bigint")


def _word_ids(lists: DataFrame, words: DataFrame) -> DataFrame:
    """(block, k, ids): the ids of ``words`` (lang, band, phrase, id) for the word lists of the blocks, 0 for other words."""
    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        ids = dict(zip(known["phrase"].to_pylist(), known["id"].to_pylist(), strict=True))
        found = [packed(np.array([ids.get(w, 0) for w in _listed(x)], np.uint32)) for x in t["words"].to_pylist()] if ids else []
        some = t.slice(0, len(found))
        return pa.table([some["block"], some["k"], pa.array(found, pa.binary())], names=["block", "k", "ids"])

    left = lists.select("lang", "band", "block", "k", "words").groupBy("lang", "band")
    right = words.select("lang", "band", "phrase", "id").groupBy("lang", "band")
    return left.cogroup(right).applyInArrow(run, "block bigint, k bigint, ids binary")


_SYMBOLS = "block bigint, lang string, at binary, sym binary, n_sym bigint"


def _symbol_table(rows: pa.Table, at: np.ndarray, sym: np.ndarray) -> pa.Table:
    """The symbols of the one block of ``rows``; none, if it has none."""
    some = rows.slice(0, min(1, len(at)))
    n = some.num_rows
    return pa.table([some["block"], some["lang"], pa.array([packed(at.astype(np.uint32), True)] * n, pa.binary()),
                     pa.array([packed(sym.astype(np.uint32))] * n, pa.binary()), pa.array([len(at)] * n, pa.int64())],
                    names=["block", "lang", "at", "sym", "n_sym"])


def _symbols_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return unpacked(rows["at"][0].as_py(), np.uint32, True).astype(np.int64), unpacked(rows["sym"][0].as_py(), np.uint32)


_NONE = np.zeros(0, np.uint32)


def _ranked_words(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Symbols of the first round: the words' ids at their places in the blocks."""
    def run(t: pa.Table, k: pa.Table) -> pa.Table:
        if not t.num_rows or not k.num_rows:
            return _symbol_table(t, _NONE, _NONE)
        seq = unpacked(t["seq"][0].as_py(), np.uint32)
        to = np.zeros(int(seq.max()) + 1, np.uint32)
        for first, raw in zip(k["k"].to_pylist(), k["ids"].to_pylist(), strict=True):
            x = unpacked(raw, np.uint32)
            to[first + 1: first + 1 + len(x)] = x
        sym = to[seq]
        at = np.flatnonzero(sym)
        return _symbol_table(t, at, sym[at])

    rows = blocks.select("block", "lang", "seq")
    return rows.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, _SYMBOLS)


def _neighbours(at: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next place has a symbol too, and the packed pairs there."""
    i = np.flatnonzero(at[1:] == at[:-1] + 1)
    return i, (sym[i].astype(np.uint64) << np.uint64(32)) | sym[i + 1].astype(np.uint64)


def _pairs(symbols: DataFrame, how: Tiling, bands: int, salts: int) -> DataFrame:
    """(lang, g, salt, block, pairs, n): the distinct pairs of every block by group: a tile of common ids, or a band of other
    tiles."""
    side, head, tiles = np.uint64(how.tile), np.uint64(how.head), how.tiles

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                block, lang = row["block"][0].as_py(), row["lang"][0].as_py()
                _, pair = _neighbours(*_symbols_of(row))
                if not len(pair):
                    continue
                pair, n = np.unique(pair, return_counts=True)
                tx, ty = ((pair >> np.uint64(32)) - np.uint64(1)) // side, ((pair & np.uint64(0xFFFFFFFF)) - np.uint64(1)) // side
                common = (tx < head) & (ty < head)
                band = tk.mix64((tx << np.uint64(32)) | ty) % np.uint64(bands)
                g = np.where(common, tx * head + ty, band + np.uint64(tiles)).astype(np.int64)
                order = np.argsort(g, kind="stable")
                g, pair, n = g[order], pair[order], n[order].astype(np.uint32)
                cut = np.flatnonzero(np.diff(g, prepend=-1))
                salt = int(tk.mix64(np.array([block], np.uint64))[0] % np.uint64(salts))
                spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(cut), pa.string()), pa.array(g[cut]),
                     pa.array(np.where(g[cut] < tiles, salt, 0).astype(np.int32)), pa.array(np.full(len(cut), block)),
                     pa.array([packed(pair[a:b], True) for a, b in spans], pa.binary()), pa.array([packed(n[a:b]) for a, b in spans], pa.binary())],
                    names=["lang", "g", "salt", "block", "pairs", "n"])

    return symbols.mapInArrow(run, "lang string, g bigint, salt int, block bigint, pairs binary, n binary")


class TileSums:
    """Counts of the pairs of a group ``g`` (a tile of common ids, or a band of other tiles): by direct address once a tile
    is full enough, else as a sorted list of coordinates."""

    def __init__(self, g: int, how: Tiling):
        self.side, self.dense = np.uint64(how.tile), None
        self.x0, self.y0 = np.uint64(g // how.head * how.tile + 1), np.uint64(g % how.head * how.tile + 1)
        self.cells = how.tile * how.tile
        self.room = self.cells // 16 if g < how.tiles else 1 << 62
        self.pairs, self.counts, self.size, self.merged = [], [], 0, 0

    def add(self, pair: np.ndarray, n: np.ndarray):
        self.pairs.append(pair)
        self.counts.append(n.astype(np.int64))
        self.size += len(pair)
        if self.size > max(self.room, 2 * self.merged, 1 << 16):  # what waits stays within the distinct pairs
            self._merge()

    def _merge(self):
        pair, n = np.concatenate(self.pairs), np.concatenate(self.counts)
        if self.dense is None and len(pair) >= self.room:
            self.dense = np.zeros(self.cells, np.int64)
        if self.dense is not None:
            cell = ((pair >> np.uint64(32)) - self.x0) * self.side + (pair & np.uint64(0xFFFFFFFF)) - self.y0
            self.dense += np.bincount(cell.astype(np.int64), weights=n, minlength=self.cells).astype(np.int64)  # exact below 2^53
            pair, n = pair[:0], n[:0]
        elif len(pair):
            order = np.argsort(pair, kind="stable")
            pair, n = pair[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair, n = pair[cut], np.add.reduceat(n, cut)
        self.pairs, self.counts, self.size, self.merged = [pair], [n], len(pair), len(pair)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs, in order, and their counts."""
        if not self.pairs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._merge()
        if self.dense is None:
            return self.pairs[0], self.counts[0]
        at = np.flatnonzero(self.dense).astype(np.uint64)
        return ((at // self.side + self.x0) << np.uint64(32)) | (at % self.side + self.y0), self.dense[at.astype(np.int64)]


def _frequent(pairs: DataFrame, how: Tiling, least: int, parts: int) -> DataFrame:
    """(lang, g, x, y, a) of the pairs that occur ``least`` times or more; a common tile is summed in ``parts`` parts."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, g = key[0].as_py(), key[1].as_py()
        sums = TileSums(g, how)
        for batch in batches:
            for pair, n in zip(batch.column("pairs").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums.add(unpacked(pair, np.uint64, True), unpacked(n, np.uint32))
        pair, total = sums.sums()
        if parts == 1 or g >= how.tiles:
            keep = total >= least
            pair, total = pair[keep], total[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(pair), pa.string()), pa.array(np.full(len(pair), g)), pa.array((pair >> np.uint64(32)).astype(np.int64)),
             pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(total)], names=["lang", "g", "x", "y", "a"])

    part = (F.col("salt") % parts).alias("part")
    found = pairs.select("lang", "g", part, "pairs", "n").groupBy("lang", "g", "part").applyInArrow(
        run, "lang string, g bigint, x bigint, y bigint, a bigint")
    return found if parts == 1 else found.groupBy("lang", "g", "x", "y").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _replies(pairs: DataFrame, found: DataFrame, how: Tiling, salts: int) -> DataFrame:
    """(block, pairs, ids): the ids of ``found`` (lang, g, x, y, id) among every block's pairs."""
    salt = F.explode(F.when(F.col("g") < how.tiles, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    known = found.select("lang", "g", "x", "y", "id", salt.alias("salt"))

    def run(t: pa.Table, k: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["block", "pairs", "ids"])
        if not t.num_rows or not k.num_rows:
            return empty
        key = (np.asarray(k["x"]).astype(np.uint64) << np.uint64(32)) | np.asarray(k["y"]).astype(np.uint64)
        order = np.argsort(key)
        key, ids = key[order], np.asarray(k["id"])[order].astype(np.uint32)
        rows = []
        for block, raw in zip(t["block"].to_pylist(), t["pairs"].to_pylist(), strict=True):
            pair = unpacked(raw, np.uint64, True)
            at = np.minimum(np.searchsorted(key, pair), len(key) - 1)
            hit = key[at] == pair
            if hit.any():
                rows.append((block, packed(pair[hit], True), packed(ids[at[hit]])))
        if not rows:
            return empty
        b, p, i = zip(*rows, strict=True)
        return pa.table([pa.array(b, pa.int64()), pa.array(p, pa.binary()), pa.array(i, pa.binary())], names=["block", "pairs", "ids"])

    left = pairs.select("lang", "g", "salt", "block", "pairs").groupBy("lang", "g", "salt")
    return left.cogroup(known.groupBy("lang", "g", "salt")).applyInArrow(run, "block bigint, pairs binary, ids binary")


def _next_symbols(symbols: DataFrame, replies: DataFrame) -> DataFrame:
    """The symbols of the next round: the ids of the frequent pairs, at the places of their first symbols."""
    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows or not r.num_rows:
            return _symbol_table(t, _NONE, _NONE)
        key = np.concatenate([unpacked(x, np.uint64, True) for x in r["pairs"].to_pylist()])
        ids = np.concatenate([unpacked(x, np.uint32) for x in r["ids"].to_pylist()])
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        at, sym = _symbols_of(t)
        i, pair = _neighbours(at, sym)
        k = np.minimum(np.searchsorted(key, pair), len(key) - 1)
        hit = key[k] == pair
        return _symbol_table(t, at[i[hit]], ids[k[hit]])

    return symbols.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _SYMBOLS)


def phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS, lang: str = "lang", how: Tiling = Tiling()) -> DataFrame:
    """(lang, phrase, a, size) of all words and phrases of up to ``words`` words that occur ``least`` times or more, and
    (lang, null, n, 0) with the number of all words of every language."""
    spark = docs.sparkSession
    blocks = materialize(_blocks(docs, lang, how.block, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    lists = blocks.select("block", "lang", F.explode("lists").alias("w")).select("block", "lang", "w.*")
    counts = materialize(_word_counts(lists, least))
    totals = counts.where("phrase is null").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).select("lang", "phrase", "a", F.lit(0).alias("size"))
    known = materialize(numbered(counts.where("phrase is not null"), ["lang"], [F.desc("a"), "phrase"], "id").withColumn("last", F.col("phrase")))
    out = totals.union(known.select("lang", "phrase", "a", F.lit(1)))
    symbols = materialize(_ranked_words(blocks, _word_ids(lists, known)))
    discard(blocks)
    for size in range(2, words + 1):
        n = symbols.agg(F.sum("n_sym")).first()[0]
        if not n:
            break
        salts, bands = 1 + n // (how.split * how.block), 1 + n // how.group
        pairs = materialize(_pairs(symbols, how, bands, salts))
        found = numbered(_frequent(pairs, how, least, 1 + salts // 128), ["lang"], [F.desc("a"), "x", "y"], "id")
        x = known.select("lang", F.col("id").alias("x"), F.col("phrase").alias("head"))
        y = known.select("lang", F.col("id").alias("y"), "last")
        known = materialize(found.join(x, ["lang", "x"]).join(y, ["lang", "y"])
                            .select("lang", "g", "x", "y", "a", "id", F.concat_ws(" ", "head", "last").alias("phrase"), "last"))
        out = out.union(known.select("lang", "phrase", "a", F.lit(size)))
        following = materialize(_next_symbols(symbols, _replies(pairs, known, how, salts))) if size < words else None
        discard(pairs, symbols)
        symbols = following
    return out


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among ``phrases`` that stay: none whose words lie in a longer one
    that occurs as often."""
    n = found.where("size = 0").select("lang", F.col("a").alias("n"))
    part = found.where("size > 0").select("lang", "phrase", "a")
    more = (found.where("size > 1").withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
            .select("lang", "phrase", "a", "size", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
                    F.array_join(F.expr("slice(w, k + 1, size)"), " ").alias("rest")))
    cuts = materialize(more.join(part.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
                       .join(part.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]))
    # a phrase inside a longer one of its count is also inside one that is longer by a word, with that count
    inside = (cuts.where("k = size - 1 and k > 1 and a >= l").select("lang", F.col("first").alias("phrase"))
              .union(cuts.where("k = 1 and size > 2 and a >= r").select("lang", F.col("rest").alias("phrase"))).distinct())
    # 1000 * a * n in 38 digits, which it has room for up to 10^17 words
    score = F.expr("cast(cast(cast(1000 as decimal(4,0)) * a * cast(n as decimal(19,0)) as decimal(38,0)) div "
                   "(cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    best = (cuts.join(n, "lang").withColumn("score", score).groupBy("lang", "phrase")
            .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")))
    return best.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, lang: str = "lang", how: Tiling = Tiling()) -> DataFrame:
    """The first ``top`` phrases of every language by score, then count (both descending), then phrase in byte order:
    (lang, rank, phrase, a, l, r, n, score) from (text, lang); other columns are ignored.

    Words are runs of other characters than blanks and tabs in pieces between ``.,;:!?`` and line ends, A-Z lowered. a is
    the number of a phrase's places within pieces, overlaps included, n that of all words of the language, l and r those of
    the two parts of its lowest-scoring cut (ties: the shortest first part); the score is floor(1000 * a * n / (l * r)).
    Phrases inside a longer one that occurs as often are left out. A null language is ``und``, a null text empty; repeated
    rows each count. An empty table gives an empty result. Words are told apart by 64-bit hashes within a block.
    """
    by = [F.desc("score"), F.desc("a"), F.col("phrase").cast("binary")]
    rows = scored(phrases(docs, least, words, lang, how)).withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*by))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
