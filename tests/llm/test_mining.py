"""Multiset fingerprints, collocations and hard negatives against brute-force versions, with every odd input."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import lower_ascii

from riskpanel.llm import collocation, multiset, negatives


def listed(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


# ---- fingerprints

def brute_edits(rows):
    """Every row's length and the hash of its edited text; rows of one id follow each other in any order, so texts that
    share an id are compared as a set."""
    out = []
    for i, (ident, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        t = text or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((ident, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 5, 200])
def test_edit_fingerprints(spark, rows, buckets):
    texts = {}
    for r in rows:  # one text an id: their order is fixed
        if r[0] is not None:
            texts.setdefault(r[0], r[1])
    own = sorted(texts.items())
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in own], "doc_id bigint, text string, bucket string, h string").repartition(4)
    got = multiset.edit_fingerprints(df, buckets=buckets)
    assert listed(got, "doc_id", "n_chars", "edited_sha256") == brute_edits(own)
    of = {}
    for r in got.collect():
        of.setdefault(texts[r.doc_id] or "", set()).add(bytes(r.fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in of.values())
    assert len({x for v in of.values() for x in v}) == len({tuple(sorted(t.split("\n"))) for t in of})


def test_edit_fingerprints_odd_rows(spark, docs, rows, empty):
    got = multiset.edit_fingerprints(docs)
    assert listed(got, "doc_id", "n_chars") == sorted(((r[0], len(r[1] or "")) for r in rows), key=repr)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert multiset.edit_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(7, "abcdef")], "doc_id bigint, text string")
    assert listed(multiset.edit_fingerprints(one), "doc_id", "edited_sha256", "near_next") == [(7, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    same = spark.createDataFrame([(None, "xy")] * 400 + [(1, "q")], "doc_id bigint, text string").repartition(5)
    assert listed(multiset.edit_fingerprints(same, buckets=3), "doc_id", "edited_sha256") == sorted(
        [(1, hashlib.sha256(b"q").hexdigest()), (None, hashlib.sha256(b"xq").hexdigest())]
        + [(None, hashlib.sha256(b"xx").hexdigest())] * 399, key=repr)


def test_multiset_is_homomorphic(spark):
    r = random.Random(3)
    lines = [" ".join(r.choice("alpha beta gamma delta epsilon".split()) + str(r.randint(0, 99)) for _ in range(r.randint(0, 60))) for _ in range(30)]
    lines += lines[:3] + ["", "", "é ü x"]
    text = "\n".join(lines)
    other = lines[:]
    r.shuffle(other)
    fps = multiset.of_texts(pa.array([text, "\n".join(other), text + "\nmore", None, ""]))
    assert (fps[0] == fps[1]).all() and (fps[3] == fps[4]).all() and not (fps[0] == fps[2]).all()
    df = spark.createDataFrame([(bytes(fps[0]), "more", None), (bytes(fps[2]), None, "more"), (bytes(fps[0]), "a\nb", "b\na"), (None, text, None)],
                               "fp binary, inserted string, deleted string")
    got = [bytes(x.fp) for x in multiset.edited(df).collect()]
    assert got == [bytes(fps[2]), bytes(fps[0]), bytes(fps[0]), bytes(fps[0])]
    # a group's fingerprint is that of all its paragraphs
    parts = spark.createDataFrame([(i % 2, x) for i, x in enumerate(lines)] + [(None, "n")], "k int, text string").repartition(3)
    sums = {x.k: bytes(x.fp) for x in multiset.combined(multiset.fingerprints(parts), ["k"]).collect()}
    exp = multiset.of_texts(pa.array(["\n".join(lines[0::2]), "\n".join(lines[1::2]), "n"]))
    assert sums == {0: bytes(exp[0]), 1: bytes(exp[1]), None: bytes(exp[2])}


def test_multiset_likeness():
    r = random.Random(9)
    word = [f"w{i}" for i in range(3000)]
    a = [" ".join(r.choice(word) for _ in range(40)) for _ in range(80)]
    b = [" ".join(r.choice(word) for _ in range(40)) for _ in range(80)]
    fps = multiset.of_texts(pa.array(["\n".join(a), "\n".join(a[:40] + b[:40]), "\n".join(b), "\n".join(a)]))
    near = multiset.likeness(np.repeat(fps[:1], 4, axis=0), fps)
    assert near[0] == near[3] == 1 and 0.3 < near[1] < 0.7 and near[2] < 0.25


def test_stretches_cover_the_text(rows):
    from riskpanel.llm import textkit as tk
    texts = [r[1] for r in rows if r[1]]
    for block in tk.blocks(pa.array(texts)):
        doc, start, end, goes_on = multiset.stretches(block)
        for i in range(block.n):
            mine = np.flatnonzero(doc == i)
            raw = block.data.tobytes()
            glued = b"".join(raw[start[k]: end[k]] + (b"" if goes_on[k] or k == mine[-1] else b"\n") for k in mine)
            assert glued.decode() == texts[block.lo + i]


# ---- collocations

def brute_phrases(rows, least, longest):
    count, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i: i + k])
                    count[key] = count.get(key, 0) + 1
    return {k: v for k, v in count.items() if v >= least}, n


def brute_collocations(rows, least, longest, top):
    count, n = brute_phrases(rows, least, longest)
    found = {}
    for (lang, p), a in count.items():
        if len(p) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang, p] = (score, a, count[lang, p[:k]], count[lang, p[k:]])
    gone = {(lang, p[i: i + k]) for (lang, p) in found for k in range(2, len(p)) for i in range(len(p) - k + 1)
            if count[lang, p] >= count[lang, p[i: i + k]]}
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted(((-v[0], -v[1], " ".join(p).encode(), v) for (g, p), v in found.items() if g == lang and (g, p) not in gone))
        out += [(lang, i + 1, x[2].decode(), x[3][1], x[3][2], x[3][3], n[lang], x[3][0]) for i, x in enumerate(mine[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [40, 1 << 19])
def test_collocations(spark, rows, docs, empty, block):
    how = collocation.Tiling(tile=16, head=2, block=block, group=500, split=3)
    r = random.Random(4)
    extra = [(1000 + i, " ".join(r.choice(["New", "york", "city", "hall", "a", "b,", "c.", "é", "x\ty", "z;q"]) for _ in range(60)),
              r.choice(["en", "de", None, "und"]), None, None, None, None) for i in range(40)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumnRenamed("n_chars", "phrase")
    exp = brute_collocations([*rows, *extra], 4, 5, 60)
    assert {x[0] for x in exp} == {"en", "de", "und"} and any(len(x[2].split(" ")) > 3 for x in exp)
    got = collocation.collocations(df, least=4, top=60, how=how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert listed(got, *got.columns) == exp
    assert collocation.collocations(empty, least=1).count() == 0


def test_tile_sums():
    r = np.random.default_rng(1)
    how = collocation.Tiling()
    for size in (0, 1, 40, 200_000):
        x, y = r.integers(1025, 2049, size).astype(np.uint64), r.integers(2049, 3073, size).astype(np.uint64)
        pair, n = (x << np.uint64(32)) | y, r.integers(1, 9, size)
        for g in (1 * how.head + 2, 10_000):  # the tile itself; a band
            sums = collocation.TileSums(g, how)
            for lo in range(0, size, 7_000):
                sums.add(pair[lo: lo + 7_000], n[lo: lo + 7_000])
            keys, total = sums.sums()
            assert (sums.dense is not None) == (g < 100 and size > 100_000)
            exp = {}
            for k, m in zip(pair.tolist(), n.tolist(), strict=True):
                exp[k] = exp.get(k, 0) + m
            assert dict(zip(keys.tolist(), total.tolist(), strict=True)) == exp and len(keys) == len(exp)
    x = r.integers(0, 1 << 40, 1000).astype(np.uint64)
    assert (collocation.unpacked(collocation.packed(x), np.uint64) == x).all()
    x.sort()
    assert (collocation.unpacked(collocation.packed(x, True), np.uint64, True) == x).all()
    assert len(collocation.unpacked(collocation.packed(x[:0]), np.uint64)) == 0


def test_exact_scores(spark):
    """Products beyond 64 bits, and a tie of the floors, which the shorter first part wins."""
    big = 10 ** 14
    rows = [("x", None, 7 * big, 0), ("x", "p", big, 1), ("x", "q", big - 1, 1), ("x", "p q", big // 3, 2)]
    got = collocation.scored(spark.createDataFrame(rows, "lang string, phrase string, a bigint, size int")).collect()
    assert [tuple(r) for r in got] == [("x", "p q", big // 3, big, big - 1, 7 * big, 1000 * (big // 3) * 7 * big // (big * (big - 1)))]
    rows = [("x", None, 100, 0), *(("x", w, 10, 1) for w in "abc"), ("x", "a b", 5, 2), ("x", "b c", 5, 2), ("x", "a b c", 4, 3)]
    got = {r.phrase: r for r in collocation.scored(spark.createDataFrame(rows, "lang string, phrase string, a bigint, size int")).collect()}
    assert (got["a b c"].l, got["a b c"].r, got["a b c"].score) == (10, 5, 1000 * 4 * 100 // 50) and set(got) == {"a b c", "a b", "b c"}


# ---- hard negatives

def brute_negatives(rows, every, npos, nneg):
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = [(sum(x * y for x, y in zip(va, v, strict=False)), i, lab) for i, lab, v in rows if i != a]
        pos = sorted([(-s, i) for s, i, lab in scored if lab == la])[:npos]
        for p, pid in pos:
            far = sorted([(-s, i) for s, i, lab in scored if lab != la and 30 * -p <= 100 * s <= 90 * -p])[:nneg]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize("block_numbers", [24, 1 << 18])
def test_hard_negatives(spark, block_numbers):
    r = random.Random(2)
    rows = [(i, r.randint(0, 3), [r.randint(-3, 6) for _ in range(r.choice([4, 4, 3, 0]))]) for i in range(-40, 260)]
    odd = [(None, 1, [1, 2, 3, 4]), (501, None, [1, 1, 1, 1]), (502, 1, None), (503, 1, [1, None, 2, 2]), (700, 9, [0, 0, 0, 0])]
    again = [(rows[50][0], rows[50][1], rows[50][2]), (rows[60][0], 9, rows[60][2])]  # a repeated row; an id with a greater label
    df = spark.createDataFrame([(*x, "z") for x in [*rows, *odd, *again]], "vec_id bigint, label int, vec array<bigint>, score string").repartition(5)
    got = negatives.hard_negatives(df, every=20, positives=3, negatives=4, block_numbers=block_numbers)
    exp = brute_negatives([*rows, odd[-1]], 20, 3, 4)
    assert len(exp) > 40 and listed(got, *got.columns) == sorted(exp, key=repr)


def test_hard_negatives_odd_tables(spark):
    schema = "vec_id bigint, label int, vec array<bigint>"
    for rows in ([], [(1, 1, [1])], [(100, 1, [1]), (200, 2, [1])], [(100, None, None)], [(100, 1, []), (101, 1, []), (102, 2, [])]):
        got = listed(negatives.hard_negatives(spark.createDataFrame(rows, schema)), "anchor_id", "positive_id", "negative_id")
        assert got == ([(100, 101, 102)] if len(rows) == 3 else [])
    huge = [(100, 1, [1 << 62]), (101, 1, [1 << 62]), (102, 2, [3]), (103, 2, [1 << 60])]
    got = negatives.hard_negatives(spark.createDataFrame(huge, schema))
    assert listed(got, "negative_id") == [] and math.log2(negatives._MOST) == 55


def test_scores_are_exact():
    a = np.array([[1 << 40, 3, -5]], np.int64)
    b = np.array([[2, 1 << 30, 7], [1 << 13, 0, 1]], np.int64)
    assert negatives._scores(a, b).tolist() == [[(1 << 41) + 3 * (1 << 30) - 35, (1 << 53) - 5]]
