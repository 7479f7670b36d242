"""Each operator on documents against a brute-force version, with every odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import lower_ascii, words
from pyspark.sql import functions as F

from riskpanel.llm import (attention_lm, decontam, mixing, quality, rlbwt, simhash, suffix_dedup, textkit, tokencount,
                           toxicity)


def listed(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def test_quality_rules(docs, rows, labels, empty):
    got = quality.quality_rules(docs, labels)
    exp = []
    for r in rows:
        t = r[1] or ""
        w = words(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        in_repeat = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
        exp.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(in_repeat),
                    len(w) < 20 or 100 * len(in_repeat) > 30 * len(w)))
    assert listed(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(exp, key=repr)
    assert got.where("base_failed and kept").count() == 0
    assert got.where("not base_failed and kept <> (llr >= -0.06)").count() == 0
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).where("abs(llr) > 1e-9").count() == 0


def test_quality_log_ratio(docs, labels, rows):
    """The score is the mean log ratio of the two smoothed multinomials."""
    trusted = quality.trusted_ids(labels)
    assert set(trusted.tolist()) == {i for i in range(45) if i % 2}
    counts = {r.bucket: (r.n_raw, r.n_target) for r in quality.bucket_counts(docs, trusted).collect()}
    assert sum(v[0] for v in counts.values()) == sum(max(0, 2 * len(words(r[1])) - 1) for r in rows)
    assert sum(v[1] for v in counts.values()) == sum(max(0, 2 * len(words(r[1])) - 1) for r in rows if r[0] in set(trusted.tolist()))


def brute_repeats(rows, n):
    seen = Counter()
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in raws:
        seen.update(b[i:i + n] for i in range(len(b) - n + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("hot", [1 << 22, 1])
def test_substring_dedup(docs, rows, empty, hot):
    exp = brute_repeats(rows, 200)
    got = suffix_dedup.remove_repeats(docs, hot=hot, bucket_bytes=20_000)
    assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted([x[:5] for x in exp], key=repr)
    assert got.columns.count("score") == 1
    if hot > 1:
        cut = suffix_dedup.remove_repeats(docs, replace=True)
        assert cut.columns == docs.columns
        left = sorted(((x[0], None if r[1] is None else x[5].decode(errors="ignore")) for x, r in zip(exp, rows, strict=True)), key=repr)
        assert listed(cut, "doc_id", "text") == left
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_common_phrase(spark):
    """A phrase in 5,000 contexts, some of which repeat, and 500 equal rows; hot minimizers are split again."""
    r = random.Random(8)

    def noise(n):
        return "".join(r.choice("abcdefghij ") for _ in range(n))

    for length, hot in ((90, 20_000), (160, 20_000), (240, 1000)):
        phrase = noise(length)
        rows = [(i, noise(r.randint(20, 150)) + phrase + noise(r.randint(20, 150))) for i in range(1500 if length > 200 else 5000)]
        rows += [(10_000 + i, rows[i][1][15: 15 + length + 110]) for i in range(40)]
        rows += [(20_000, rows[0][1])] * 500
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
        got = suffix_dedup.remove_repeats(df, hot=hot, bucket_bytes=200_000)
        exp = brute_repeats(rows, 200)
        assert sum(x[2] for x in exp) > 0
        assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted([x[:5] for x in exp], key=repr)


def test_run_length_index():
    def brute(segs):
        out = []
        for a, s in enumerate(segs):
            for i in range(len(s)):
                best = 0
                for b, t in enumerate(segs):
                    for j in range(len(t)):
                        if (a, i) != (b, j):
                            k = 0
                            while i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
                                k += 1
                            best = max(best, k)
                out.append(best)
        return out

    for seed in range(60):
        r = random.Random(seed)
        base = bytes(r.choice(b"ab\x00\xff") for _ in range(40))
        segs = [base[a:a + r.randint(1, 20)] for a in (r.randint(0, 30) for _ in range(6))] + [b"aaaaaaaa", b"aaaaaaaa"]
        bounds = np.cumsum([0, *map(len, segs)])
        assert rlbwt.matching_statistics(np.frombuffer(b"".join(segs), np.uint8), bounds).tolist() == brute(segs), seed


def brute_simhash(text, n=3):
    import xxhash
    w = words(lower_ascii(text or ""))
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if label[b] < label[a] and bin(fps[a] ^ fps[b]).count("1") <= radius:
                    label[a], changed = label[b], True
    return label


def test_simhash(docs, rows, empty):
    fps = [brute_simhash(r[1]) for r in rows]
    label = brute_components(fps, 2)
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    exp = sorted([(r[0], f, least.get(c)) for r, f, c in zip(rows, signed, label, strict=True)], key=repr)
    assert listed(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == exp
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label))
    assert {r[0] for r in kept.select("doc_id").collect()} >= set(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_keep_one_ties(spark):
    """Of rows with equal id and fingerprint the same one stays however they are dealt out, and a row of a null id."""
    rows = [(1, f"one two three {'x' * (i % 2)}", i) for i in range(6)] + [(None, "lone words here now", 7), (None, "lone words here now", 8), (2, None, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra int")
    got = {tuple(sorted(map(repr, simhash.keep_one(d).collect()))) for d in (df, df.repartition(5), df.orderBy(F.desc("extra")))}
    assert len(got) == 1 and len(next(iter(got))) == len({brute_simhash(r[1]) for r in rows})


def test_simhash_links_chains(spark):
    """Fingerprints one and two bits apart, in chains longer than the radius, and a full ball."""
    r = random.Random(3)
    fps = []
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            fps.append(x)
            for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
                x ^= 1 << b
    fps = sorted(set(fps + [fps[0] ^ (1 << b) for b in range(64)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from riskpanel.llm.graph import components
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 2)
    root = {x.node: x.root for x in components(links).collect()}
    label = brute_components(fps, 2)
    groups = {}
    for s, c in zip(signed, label, strict=True):
        groups.setdefault(c, []).append(s)
    assert all(len({root.get(s, s) for s in g}) == 1 and root.get(g[0], g[0]) == min(g) for g in groups.values())
    assert len({root.get(s, s) for s in signed}) == len(groups)
    with pytest.raises(ValueError):
        simhash.links(links.select("a").toDF("fp"), 3)


def test_smith_waterman():
    r = random.Random(2)

    def brute(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    items = [[r.randint(1, 6) for _ in range(r.randint(1, 14))] for _ in range(40)]
    windows = [[r.randint(1, 6) for _ in range(r.randint(1, 30))] for _ in range(40)]
    score, first, last = decontam.align([np.array(x, np.uint64) for x in items], [np.array(x, np.uint64) for x in windows])
    assert score.tolist() == [brute(a, b) for a, b in zip(items, windows, strict=True)]
    for a, b, s, f, e in zip(items, windows, score, first, last, strict=True):
        assert s == 0 or brute(a, b[f:e]) == s


def test_decontamination(spark, docs, rows, empty):
    r = random.Random(9)
    vocab = ["w%d" % i for i in range(500)]
    item = [" ".join(r.choice(vocab) for _ in range(30)) for _ in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(item)] + [(50, None), (51, ""), (52, "two words"), (0, item[0])], "item_id bigint, text string")
    clean = " ".join(r.choice(vocab) for _ in range(400))

    def edited(t):
        w = t.split()
        for k in r.sample(range(len(w)), 4):
            w[k] = "new"
        return " ".join(w[:10] + ["extra"] + w[10:])

    more = [(1000 + i, clean + " " + (t.upper() + "." if i % 2 else edited(t)) + " " + clean) for i, t in enumerate(item)]
    more += [(2000, clean), (2001, " ".join(item[3].split()[::-1])), (2002, None), (2003, item[4]), (2003, item[4]), (None, item[5])]
    data = spark.createDataFrame(more, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    for block in (1 << 22, 300):
        got = decontam.contaminated(data, bench, block_bytes=block)
        found = Counter((x.doc_id, x.item_id) for x in got.collect())
        exp = Counter({(1000 + i, i): 1 for i in range(12)} | {(2003, 4): 2, (None, 5): 1})
        exp[(1000, 0)] = 2  # the item is listed twice
        assert found == exp
    left = decontam.without_contaminated(data, bench)
    assert left.count() == data.count() - 15
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(data, bench.limit(0)).count() == 0


def test_marginals_match_enumeration():
    from itertools import product
    r = np.random.default_rng(1)
    m = toxicity.Model()
    m.trans, m.first = r.normal(0, 1, (2, 2)), r.normal(0, 1, 2)
    lens = [3, 0, 1, 7, 2, 150, 0]
    bounds = np.cumsum([0, *lens])
    u = r.normal(0, 2, bounds[-1])
    p = toxicity.marginals(u, bounds, m)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if 0 < b - a < 10:
            total, on = 0.0, np.zeros(b - a)
            for path in product((0, 1), repeat=int(b - a)):
                s = m.first[path[0]] + sum(u[a + k] * y for k, y in enumerate(path)) + sum(m.trans[x, y] for x, y in zip(path, path[1:], strict=False))
                total += math.exp(s)
                on += np.array(path) * math.exp(s)
            assert np.allclose(p[a:b], on / total)
    alone = toxicity.marginals(u[bounds[5]:bounds[6]], np.array([0, 150]), m)
    assert np.allclose(p[bounds[5]:bounds[6]], alone)


def test_toxicity(spark, docs, empty, labels):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    data, lab = [], []
    for i in range(900):
        w = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["Zzrude", "zzrudest,", "qqnasty", "qqnastier"]))
        data.append((i, " ".join(w)))
        lab.append((i, 1, int(bad)))
    d, y = spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(lab, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(d, y)
    got = {x.doc_id: x for x in toxicity.score(d, model).withColumn("h", toxicity.held_out(F.col("doc_id"), 3, 1)).collect()}
    assert all(x.h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    held = [x for x in got.values() if x.h]
    right = sum((x.score >= 0.7) == (x.doc_id % 3 == 0) for x in held)
    assert right / len(held) > 0.98
    for x in held[:50]:
        raw = x.text.encode()
        assert all(re.match(rb"(zzrude|qqnast)", raw[s.lo:s.hi].lower()) for s in x.spans)
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert odd.columns.count("score") == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.without_toxic(empty, labels).count() == 0


def test_language_model(docs, rows, empty):
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10]
    c = Counter()
    for r in train:
        c.update(words(lower_ascii(r[1] or "")))
        c["\n"] += 1
    total, distinct = sum(c.values()), len(c)
    exp = []
    for r in rows:
        w = words(lower_ascii(r[1] or "")) + ["\n"]
        exp.append((r[0], r not in train, len(w), sum(c[x] > 0 for x in w), total,
                    round(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 4)))
    for head in (1 << 19, 50):
        got = [tuple(x) for x in attention_lm.score(docs, steps=20, head=head).select(
            "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
        assert sorted([(*x[:5], round(x[5], 4)) for x in got], key=repr) == sorted(exp, key=repr)
    assert attention_lm.score(empty, steps=1).count() == 0


def test_language_model_learns_from_all_rows(spark):
    """Counts and fit take every training text, however long, and nothing of the held-out ones."""
    phrase = "quartz lantern zephyr orchard mimic velvet "
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    long = [(i, phrase * 1000) for i in ids[:2]]  # 43,000 characters each
    got = attention_lm.score(spark.createDataFrame([*long, (held, phrase * 20)], "doc_id bigint, text string"), steps=1)
    r = got.where("held_out").first()
    assert r.score / r.n_pieces > -0.5


def test_corpus_piece_counts(spark, docs, rows):
    pieces = attention_lm.Pieces(attention_lm._model_bytes(attention_lm.VOCABULARY))
    exp, pairs, n_windows = Counter(), Counter(), 0
    for r in rows:
        seq = [p for w in words(lower_ascii(r[1] or "")) for p in pieces.model.encode(w)] + [pieces.size]
        if r[0] != 3:
            exp.update(seq)
            pairs.update(zip([pieces.size, *seq], seq, strict=False))
            n_windows += -(-len(seq) // attention_lm.STRIDE)
    data = docs.select("text", F.coalesce(F.col("doc_id") != 3, F.lit(True)).alias("train"))
    counts = attention_lm.corpus_counts(data, attention_lm._model_bytes(attention_lm.VOCABULARY)).cache()
    freq = attention_lm.piece_counts(counts, pieces.size + 1)
    assert {i: int(freq[i]) for i in np.flatnonzero(freq)} == dict(exp)
    assert {(r.key // (pieces.size + 1), r.key % (pieces.size + 1)): r.n for r in counts.where("kind = 1").collect()} == dict(pairs)
    assert counts.where("kind = 3").first().n == n_windows
    to_input, to_class = attention_lm.piece_tables(freq, np.arange(len(freq)) % 2 == 0, 40, 16)
    near, by_class = attention_lm.folded_pairs(counts, to_input, to_class, 16)
    assert near.sum() == by_class.sum() == sum(exp.values())
    share = np.exp(attention_lm.piece_shares(by_class, to_class))
    assert np.allclose([np.bincount(to_class, weights=x, minlength=16)[np.unique(to_class)] for x in share], 1, atol=1e-4)


def test_fit_takes_every_text_once(spark):
    """Over the rounds, the tasks' targets are all pieces of all texts."""
    texts = [("one two three " * (7 * i + 1),) for i in range(25)]
    df = spark.createDataFrame(texts, "text string").repartition(3)
    raw = attention_lm._model_bytes(attention_lm.VOCABULARY)
    pieces = attention_lm.Pieces(raw)
    freq = np.ones(pieces.size + 1)
    to_input, to_class = attention_lm.piece_tables(freq, freq > 0)
    n = int(to_input.max()) + 1
    m = attention_lm.Model(to_input, to_class, *attention_lm.pair_tables(np.ones((n, n)), to_input, to_class))
    before = {k: w.copy() for k, w in m.weights().items()}
    sent = spark.sparkContext.broadcast((raw, m))
    targets = sum(len(pieces.model.encode(w)) for t, in texts for w in t.split()) + len(texts)
    seen = []
    for nth in range(3):
        for part in attention_lm._learned(df, sent, nth, 3, 1, 96).where("slice = 0").collect():
            seen.append(part.n)
    assert sum(seen) == targets
    attention_lm.fit_attention(m, df, raw, 500, steps=1)
    assert all((before[k] != w).any() for k, w in m.weights().items())


def test_texts_are_cut_once_for_counts_and_fit(spark):
    """The ids that the counting pass writes are those of every training text, and a fit on them is that on the texts."""
    texts = [("Alpha beta, gamma " * (i % 9), i % 5 != 0) for i in range(40)] + [(None, True), ("", True), ("\u00e9\u4e2d x\n\ty", True)]
    raw = attention_lm._model_bytes(attention_lm.VOCABULARY)
    pieces = attention_lm.Pieces(raw)
    df = spark.createDataFrame(texts, "text string, train boolean").coalesce(1)
    ids = attention_lm.cut_texts(df, raw).where(f"kind = {attention_lm.TEXT}").select("ids")
    kind = np.min_scalar_type(pieces.size)
    exp = [[p for w in words(lower_ascii(t or "")) for p in pieces.model.encode(w)] + [pieces.size] for t, train in texts if train]
    assert sorted(np.frombuffer(r.ids, kind).tolist() for r in ids.collect()) == sorted(exp)
    to_input, to_class = attention_lm.piece_tables(np.ones(pieces.size + 1), np.ones(pieces.size + 1) > 0)
    n = int(to_input.max()) + 1
    got = []
    for rows in (df.where("train").select("text"), ids):
        m = attention_lm.Model(to_input, to_class, *attention_lm.pair_tables(np.ones((n, n)), to_input, to_class))
        got.append(attention_lm.fit_attention(m, rows, raw, 60, steps=1).weights())
    assert all(np.allclose(got[0][k], got[1][k], atol=1e-4) for k in got[0])


def test_attention_steps():
    """Sums of rows, gradients with exponents known to be small, and steps equal their plain forms."""
    r = np.random.default_rng(2)
    for width in (6, 7):
        index, rows = r.integers(0, 9, 500), r.normal(size=(500, width)).astype(np.float32)
        exp = np.zeros((9, width))
        np.add.at(exp, index, rows)
        assert np.allclose(attention_lm._add_rows((9, width), index, rows), exp, atol=1e-4)
    to_input, to_class = attention_lm.piece_tables(np.arange(20, 0, -1.0), np.arange(20) % 2 == 0, 18, 8)
    n = int(to_input.max()) + 1
    m = attention_lm.Model(to_input, to_class, *attention_lm.pair_tables(np.ones((n, n)), to_input, to_class, 8))
    seq = r.integers(0, 19, 300).astype(np.int32)
    tok, target, real = attention_lm.windows(to_input[seq], np.array([0, 1, 90, 300]), m.pad, to_input[-1])
    cls = to_class[seq][target]
    assert m.small()
    adam = attention_lm.Adam(m, 0.5)
    w = {k: x.astype(np.float64) for k, x in m.weights().items()}
    mean, var = {k: 0 * x for k, x in w.items()}, {k: 0 * x for k, x in w.items()}
    for step in range(1, 41):
        (loss, g), (plain, exp) = attention_lm._gradients(m, tok, cls, real, True), attention_lm._gradients(m, tok, cls, real)
        assert abs(loss - plain) < 1e-4 and all(np.allclose(g[k], exp[k], atol=1e-5) for k in g)
        adam.step(tok, cls, real)
        for k in w:
            mean[k] += 0.1 * (exp[k] - mean[k])
            var[k] += 0.02 * (exp[k].astype(np.float64) ** 2 - var[k])
            rate = {"own": 0.01, "near": 0.03}.get(k, 0.02) * 0.5 * min(1, step / 30)
            w[k] -= rate * mean[k] / (1 - 0.9 ** step) / (np.sqrt(var[k] / (1 - 0.98 ** step)) + 1e-8)
            big = np.sqrt(var[k]) > 1e-5  # where rounding does not decide the sign of a step
            assert np.allclose(m.weights()[k][big], w[k][big], atol=2e-3), k


def test_attention_exponents():
    """Tables whose norms are large while no logit is need no look at the greatest ones; logits and scores that leave the
    range of 32-bit exponentials, above or below, have the gradients and probabilities of 64 bits."""
    r = np.random.default_rng(3)
    to_input, to_class = attention_lm.piece_tables(np.arange(20, 0, -1.0), np.arange(20) % 2 == 0, 18, 8)
    n = int(to_input.max()) + 1
    seq, bounds = r.integers(0, 19, 300).astype(np.int32), np.array([0, 1, 90, 300])

    def model():
        return attention_lm.Model(to_input, to_class, *attention_lm.pair_tables(np.ones((n, n)), to_input, to_class, 8))

    m = model()
    m.v[:, 0] += 60  # the first value meets no output
    m.out[0] = 0
    m.v[:, 1:] *= 0.1
    m.out[1:] *= 30
    assert m.small()
    tok, target, real = attention_lm.windows(to_input[seq], bounds, m.pad, to_input[-1])
    cls = to_class[seq][target]
    for own, q in ((0, 1), (200, 1), (-200, 1), (0, 400)):
        m = model()
        m.own += np.float32(own)
        m.q *= np.float32(q)
        wide = model()
        for k, w in m.weights().items():
            setattr(wide, k, w.astype(np.float64))
        (loss, g), (exp_loss, exp) = attention_lm._gradients(m, tok, cls, real), attention_lm._gradients(wide, tok, cls, real)
        assert abs(loss - exp_loss) < 1e-3 and all(np.allclose(g[k], exp[k], atol=1e-4) for k in g)
        assert m.small() == (own == 0 and q == 1)
        assert np.allclose(attention_lm.log_probabilities(m, seq, bounds), attention_lm.log_probabilities(wide, seq, bounds), atol=1e-3)


def test_distinct_words():
    """As numpy.unique, without a sort of all words."""
    for n in (0, 1, 2000):
        h = np.random.default_rng(n).integers(0, 200, n).astype(np.uint64) << np.uint64(56)
        for got, exp in zip(attention_lm._distinct(h), np.unique(h, return_index=True, return_inverse=True), strict=True):
            assert got.tolist() == exp.tolist()
    raw = attention_lm._model_bytes(attention_lm.VOCABULARY)
    assert attention_lm._pieces_of(raw) is attention_lm._pieces_of(bytes(raw))


def test_word_cache_in_parts(monkeypatch):
    """Words met again, and more words than the cache holds, get their own pieces."""
    monkeypatch.setattr(attention_lm, "CACHE", 8)
    pieces = attention_lm.Pieces(attention_lm._model_bytes(attention_lm.VOCABULARY))
    for text in ("one two three two", "three four \u00e9t\u00e9 one \u4e2d\u6587", " ".join(f"word{i}" for i in range(30)), "one word3 two"):
        block = next(textkit.blocks(pa.array([text, None, text])))
        _, seq, bounds = attention_lm.sequences(block, pieces)
        exp = [p for w in text.split() for p in pieces.model.encode(w)] + [pieces.size]
        assert [seq[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [exp, [pieces.size], exp]


def test_attention_context():
    """Every target has at least half a window before it, where the text has as much."""
    bounds = np.array([0, 300])
    tok, target, real = attention_lm.windows(np.arange(300), bounds, -1, -2)
    first = tok[:, attention_lm.WINDOW - attention_lm.STRIDE]
    assert ((target[:, 0] - first) == 1)[1:].all()
    context = ((tok != -1) & (np.arange(attention_lm.WINDOW) <= attention_lm.WINDOW - attention_lm.STRIDE)).sum(1)
    assert (context[1:] > attention_lm.WINDOW // 2).all()


def test_attention_scores_each_piece_once():
    """Windows score every piece once, like a pass over each prefix window alone; gradients match differences."""
    r = np.random.default_rng(0)
    n_piece = 40
    to_input, to_class = attention_lm.piece_tables(np.arange(n_piece, 0, -1.0), np.arange(n_piece) % 2 == 0, 30, 16)
    ids = int(to_input.max()) + 1
    pairs = r.integers(0, 9, (ids, ids)).astype(float)
    logits, share = attention_lm.pair_tables(pairs, to_input, to_class, 16)
    m = attention_lm.Model(to_input, to_class, logits, share)
    lens = [1, 5, 200, 33]
    bounds = np.cumsum([0, *lens])
    seq = r.integers(0, n_piece - 1, bounds[-1]).astype(np.int32)
    seq[bounds[1:] - 1] = n_piece - 1
    lp = attention_lm.log_probabilities(m, seq, bounds)
    stride, window = attention_lm.STRIDE, attention_lm.WINDOW
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        text = np.concatenate([[n_piece - 1], seq[a:b]])
        for t in range(b - a):
            lo = t // stride * stride - (window - stride)
            ctx = text[max(0, lo): t + 1]
            x = to_input[ctx]
            s = m.q[x[-1]] @ m.k[x].T / attention_lm.KEY ** 0.5 + m.near[np.arange(len(x))[::-1]]
            w = np.exp(s - s.max())
            z = m.own[x[-1]] + (w / w.sum()) @ m.v[x] @ m.out
            exp = z[to_class[text[t + 1]]] - np.log(np.exp(z).sum()) + m.share[to_class[text[t]], to_input[text[t + 1]]]
            assert abs(lp[a + t] - exp) < 1e-3
    # the model is a distribution over pieces
    z = m.own[to_input[3]]
    p = np.exp(z) / np.exp(z).sum()
    assert abs(sum(p[to_class[k]] * np.exp(m.share[to_class[3], to_input[k]]) for k in range(n_piece)) - 1) < 1e-4


def test_attention_gradients():
    r = np.random.default_rng(1)
    to_input, to_class = attention_lm.piece_tables(np.arange(20, 0, -1.0), np.arange(20) % 2 == 0, 18, 8)
    n = int(to_input.max()) + 1
    m = attention_lm.Model(to_input, to_class, *attention_lm.pair_tables(np.ones((n, n)), to_input, to_class, 8))
    for k, w in m.weights().items():
        setattr(m, k, w.astype(np.float64))
    seq = r.integers(0, 19, 90).astype(np.int32)
    tok, target, real = attention_lm.windows(to_input[seq], np.array([0, 90]), m.pad, to_input[-1])
    cls = to_class[seq][target]
    _, g = attention_lm._gradients(m, tok, cls, real)
    for name in ("q", "k", "v", "out", "own", "near"):
        w = m.weights()[name]
        at = tuple(np.unravel_index(np.abs(g[name]).argmax(), w.shape))
        old, eps = w[at], 1e-4
        w[at] = old + eps
        up = attention_lm._gradients(m, tok, cls, real)[0]
        w[at] = old - eps
        down = attention_lm._gradients(m, tok, cls, real)[0]
        w[at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3 * max(1, abs(g[name][at]) * 50), name


def test_token_counts(docs, empty):
    """The counts of the tokenizers library's unigram model over the same pieces and scores."""
    from tokenizers import Tokenizer, models
    vocabulary = tokencount.load_vocabulary()
    lib = Tokenizer(models.Unigram([("<unk>", -1e9)] + [(k.replace(" ", "▁"), v) for k, v in vocabulary.items()]
                                   + [(f"<0x{i:02X}>", 0.0) for i in range(256)], unk_id=0, byte_fallback=True))
    for r in tokencount.with_sizes(tokencount.token_counts(docs)).collect():
        t = r.text or ""
        assert r.n_tokens == (len(lib.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), t[:60]
        assert r.n_bytes == len(t.encode()) and r.n_code_points == len(t)
    assert tokencount.token_counts(empty).count() == 0


def test_token_ties():
    """Equal scores: the earliest start, that is the longest last piece, stays; unknown characters count as bytes."""
    c = tokencount.Counter({"a": -1.0, "aa": -2.0, "aaa": -3.0, "b": -9.0})
    assert [c.count("a" * n) for n in (1, 2, 3, 4, 5)] == [1, 1, 1, 2, 2]
    assert c.count("aé") == 3 and c.count("") == 0
    assert tokencount.Counter({"ab": -1.0}).count("ab") == 1
    assert tokencount.Counter({"ab": -1.0}).count("ba") == 2


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """sizes: source to words, sources in order."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + share * w[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += share * w[s]
            break
        left = 0.0
        for s in open_:
            grown = target[s] + share * w[s]
            target[s] = min(grown, float(most * sizes[s]))
            left += grown - target[s]
        open_ -= full
    return target


def test_mixing(spark, docs, rows, empty):
    from collections import defaultdict
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    exp = brute_targets(sizes)
    got = mixing.draw(docs, keep_text=False).collect()
    assert len(got) == len(rows)
    taken, biggest = defaultdict(int), defaultdict(int)
    for x in got:
        assert abs(x.target - exp[x.source]) < 1e-6 * max(1, exp[x.source]) and x.source_size == sizes[x.source]
        assert x.taken == x["size"] * len(x.copies) and x.taken <= 3 * x["size"]
        taken[x.source] += x.taken
        biggest[x.source] = max(biggest[x.source], x["size"])
    assert all(abs(taken[s] - exp[s]) <= biggest[s] for s in exp)
    again = mixing.draw(docs.repartition(5), keep_text=False)
    assert listed(again, "doc_id", "source", "taken", "copies") == sorted([(x.doc_id, x.source, x.taken, x.copies) for x in got], key=repr)
    mixed = mixing.mix(docs)
    assert mixed.groupBy().sum("taken").first()[0] == sum(taken.values())
    assert set(docs.columns) <= set(mixed.columns)
    assert mixing.draw(empty, keep_text=False).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_keeps_columns(spark):
    """Input columns may have any name of the working columns; only the three result columns are replaced."""
    names = ["rest", "room", "epochs", "n_blocks", "cut_block", "bounds", "size", "target", "source_size", "copies", "unit", "m", "block", "words", "taken"]
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(df).collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names if n != "taken")
    assert mixing.mix(df).columns == [c for c in df.columns if c != "taken"] + ["taken", "copy", "shard"]


def test_mixing_null_ids(spark):
    """Rows without an id are drawn one by one, so their source comes near its target."""
    rows = [(None, f"w{i} " * (i % 9 + 1), "s2") for i in range(300)] + [(i, "w " * 5, "s1") for i in range(900)]
    got = mixing.draw(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=4)
    for x in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(x["sum(taken)"] - x["max(target)"]) <= 9


def test_mixing_cuts_shards_by_order(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        d = spark.createDataFrame([(i, f"w{i} x", "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string")
        parts = mixing.mix(d, shards=3).rdd.glom().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(map(len, parts)) >= 400 and sum(bool(p) for p in parts) > 3
    assert {r.shard for p in parts for r in p} == {0, 1, 2}


def test_mixing_blocks(spark):
    """Many documents: blocks are drawn, sources come near their targets, shards get equal numbers of blocks."""
    r = random.Random(8)
    data = [(i, "w " * r.randint(1, 60), "abcdef"[min(5, int(r.expovariate(0.7)))]) for i in range(6000)]
    d = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mixing.draw(d, shards=8).cache()
    for x in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(x["sum(taken)"] - x["max(target)"]) <= 3
    per = [x["count"] for x in got.select(F.explode("copies").alias("s")).groupBy("s").count().collect()]
    assert len(per) == 8 and max(per) < 1.5 * min(per)


def test_shard_bounds_are_exact(spark):
    counts = {"a": 100, "b": 7, "c": 0, "d": 1}
    b = {x["__skey"]: x.bounds for x in mixing.shard_bounds(spark.createDataFrame(list(counts.items()), "__skey string, m bigint"), 5).collect()}
    assert all(b[k][-1] == m and b[k] == sorted(b[k]) for k, m in counts.items())
    per = np.array([np.diff([0, *x]) for x in b.values()]).sum(0)
    assert per.max() - per.min() <= 3 and per.sum() == 108


@pytest.mark.parametrize("size", [64, 1000, 1 << 21])
def test_blocks_and_hashes(rows, size):
    import pyarrow as pa
    texts = [r[1] for r in rows]
    got, seen = [], {}
    for block in textkit.blocks(pa.chunked_array([pa.array(texts[:7]), pa.array(texts[7:])]), size):
        s, e, wb = block.words()
        h = textkit.span_hashes(block.data, s, e)
        raw = block.data.tobytes()
        for k in range(block.n):
            w = [raw[a:b] for a, b in zip(s[wb[k]:wb[k + 1]], e[wb[k]:wb[k + 1]], strict=True)]
            got.append([x.decode() for x in w])
            for x, y in zip(w, h[wb[k]:wb[k + 1]].tolist(), strict=True):
                assert seen.setdefault(x, y) == y
    assert got == [words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)
