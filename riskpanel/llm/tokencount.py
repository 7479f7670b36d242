"""Token counts of a unigram tokenizer by count-only Viterbi.

The vocabulary is the pieces and scores of a public sentencepiece file, read as a unigram model. An Aho-Corasick automaton
enumerates the pieces that end at each character, in one pass; the dynamic program carries only the best score and the
number of pieces up to each character. Tie rules are those of the tokenizer: candidates come by start, earliest first,
and replace the best one only if they score strictly more; a character without a piece of its own may be unknown, at the
lowest score less 10, and then counts as its UTF-8 bytes.

No piece holds a blank after another character, and most control characters are in no piece, so a best path is made of best paths of the
stretches between them, and equal stretches are solved once a task. Scores are summed exactly, stretch by stretch; the
library sums a whole text in 32 bits, which is the same as long as a sum of integer scores stays below 2**24.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm import textkit as tk

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
CACHE = 1 << 20
_BLANK = "▁"


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Ordinary pieces and their scores, blanks as spaces. Control, unknown and byte pieces match no text."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(len(p)):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)):
            out[p.id_to_piece(i).replace(_BLANK, " ")] = p.get_score(i)
    bad = [x for x in out if " " in x.lstrip(" ")]
    if bad:
        raise ValueError(f"pieces with blanks inside can't be counted by stretches: {bad[:3]}")
    return out


def stops(vocabulary: dict[str, float]) -> np.ndarray:
    """Which ASCII control bytes are in no piece; each is a stretch of its own."""
    out = np.zeros(256, bool)
    out[:32] = True
    out[[ord(c) for x in vocabulary for c in x if ord(c) < 32]] = False
    return out


class Counter:
    """Counts the pieces of one stretch."""

    def __init__(self, vocabulary: dict[str, float]):
        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.single = frozenset(x for x in vocabulary if len(x) == 1)
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY

    def count(self, text: str) -> int:
        n = len(text)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):
            # every character has a piece, so every place is reached before it is needed; at an end the matches come
            # longest first, which is earliest start first
            for end, (size, score) in self.find.iter(text):
                end += 1
                s = best[end - size] + score
                if best[end] is None or s > best[end]:
                    best[end], count[end] = s, count[end - size] + 1
            return count[n]
        ends: list = [[] for _ in range(n + 1)]
        for end, found in self.find.iter(text):
            ends[end + 1].append(found)
        for end in range(1, n + 1):
            c = text[end - 1]
            options = [(size, score, 1) for size, score in ends[end]]
            if c not in self.single:
                options.append((1, self.unknown, len(c.encode())))
            for size, score, k in options:
                if best[end - size] is not None:
                    s = best[end - size] + score
                    if best[end] is None or s > best[end]:
                        best[end], count[end] = s, count[end - size] + k
        return count[n]


def _stretches(block: tk.Block, stopping: np.ndarray):
    """Starts, ends and the texts' bounds of the stretches: blanks with what follows them, or one control character."""
    d = block.data
    if not len(d):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(block.n + 1, np.int64)
    blank, stop = d == 32, stopping[d]
    start = stop.copy()
    start[1:] |= stop[:-1] | (blank[1:] & ~blank[:-1])
    start[block.off[:-1][block.off[:-1] < len(d)]] = True
    s = np.flatnonzero(start)
    return s, np.append(s[1:], len(d)), np.searchsorted(s, block.off)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, prefix: bool = True, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of every whole text (``prefix``: as if a blank stood before it, which is the
    tokenizer's default). Null and empty texts have 0 tokens. Repeated rows are alike; other columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))  # the size of the vocabulary
    state: dict = {}

    def run(block: tk.Block) -> dict:
        if not state:
            state.update(counter=Counter(sent.value), stops=stops(sent.value), known={}, first={})
        counter, known, first = state["counter"], state["known"], state["first"]
        for cache in (known, first):
            if len(cache) > CACHE:
                cache.clear()
        raw = block.data.tobytes()
        s, e, bounds = _stretches(block, state["stops"])
        h = tk.span_hashes(block.data, s, e)
        keys, at, which = np.unique(h, return_index=True, return_inverse=True)
        counts = np.empty(len(keys), np.int64)
        a, b = s[at].tolist(), e[at].tolist()
        for k, key in enumerate(keys.tolist()):
            c = known.get(key)
            if c is None:
                c = known[key] = counter.count(raw[a[k]: b[k]].decode())
            counts[k] = c
        each = counts[which]
        total = tk.per_text(each, bounds)
        if prefix:
            for i in np.flatnonzero(np.diff(bounds) > 0).tolist():
                x = int(h[bounds[i]])  # a first stretch may be a whole text; only its hash is kept
                c = first.get(x)
                if c is None:
                    c = first[x] = counter.count(" " + raw[s[bounds[i]]: e[bounds[i]]].decode())
                total[i] += c - each[bounds[i]]
        return {name: total}

    return tk.add_columns(docs, "text", {name: "bigint"}, run)


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes and n_code_points of the text (null: 0)."""
    return (docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
            .withColumn("n_code_points", F.coalesce(F.length("text"), F.lit(0)).cast("long")))
