"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the likelihood of the visible text under hashed byte-trigram models, the
language that the markup declares, the address suffix (top-level domain), and a prior of the host that is smoothed
towards its parent domain, which is smoothed towards all pages. Everything but the text likelihood is computed by grouped
aggregation over the pages themselves: their text-only decisions are counted by host, parent domain, suffix and declared
language (partial sums before the shuffle, so a host with a third of all pages is one row a task), and a page's own
decision is taken out of its host's and domain's counts before they judge it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.llm import textkit as tk
from riskpanel.llm.urlfilter import lower_ascii, url_host
from riskpanel.session import materialize

GRAM = 3
BUCKETS = 1 << 15
_LANGUAGES = 64  # languages at a time, where there are many
TEXT_GRAMS = 48  # a text weighs at most as much as so many independent trigrams
STRENGTH = 8.0  # pages' worth of the parent in a child's counts
_ENDS = {b"script": re.compile(rb"(?i)</script\s*>"), b"style": re.compile(rb"(?i)</style\s*>")}
_NAME = re.compile(rb"(?i)(script|style|html)\b")
_LANG = re.compile(rb"""(?i)[\s"'/](?:xml:)?lang\s*=\s*["']?([a-z]+)""")


def visible(html: bytes) -> tuple[bytes, str | None]:
    """The text of a page without tags, comments, scripts and styles (each a blank), and the language that its first
    ``html`` tag with a ``lang`` attribute declares. One scan forward; what never ends (a comment, script or style) is a tag
    up to its ``>``, and a ``<`` without a later ``>`` is text."""
    out, declared, at = [], None, 0
    open_ended = set()  # ends that don't come any more
    while True:
        i = html.find(b"<", at)
        if i < 0:
            break
        end, name = -1, _NAME.match(html, i + 1)
        kind = b"--" if html.startswith(b"!--", i + 1) else name[1].lower() if name else b""
        if kind == b"--" and kind not in open_ended:
            end = html.find(b"-->", i + 4) + 3
            end = end if end > 2 else -1
        elif kind in _ENDS and kind not in open_ended:
            found = _ENDS[kind].search(html, i + 1)
            end = found.end() if found else -1
        if end < 0:
            open_ended.add(kind)
            end = html.find(b">", i + 1) + 1
            if not end:
                break
            if kind == b"html" and declared is None:
                said = _LANG.search(html, i + 5, end)
                declared = said[1].decode().lower() if said else None
        out.append(html[at:i])
        at = end
    out.append(html[at:])
    return b" ".join(out), declared


def _grams(block: tk.Block):
    """Buckets of the byte trigrams of every text (A-Z lowered, other ASCII as blanks; not those of blanks only)."""
    folded = _FOLD[block.data]
    g = tk.gram_hashes(tk.CODES[folded], GRAM)
    ok = tk.inside(block.off, GRAM, len(folded))[: len(g)]
    seen = folded != 32
    for k in range(1, GRAM):
        seen[:-k] |= folded[k:] != 32
    ok = ok & seen[: len(g)]
    return (g[ok] & np.uint64(BUCKETS - 1)).astype(np.int64), tk.owners(block.off)[: len(g)][ok]


_FOLD = tk.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of every trigram bucket, from counts over all documents with a language; a
    language that has a single trigram is told apart."""
    def count(batches):
        total: dict = {}

        def table():
            for lang, n in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.tolist()], pa.list_(pa.int64()))], names=["lang", "n"])
            total.clear()

        for batch in batches:
            langs, of_row = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for block in tk.blocks(batch.column(1)):
                g, doc = _grams(block)
                here, of = np.unique(of_row[block.lo: block.lo + block.n], return_inverse=True)
                of = of[doc]
                for lo in range(0, len(here), _LANGUAGES):
                    some = here[lo: lo + _LANGUAGES]
                    pick = (of >= lo) & (of < lo + len(some))
                    n = np.bincount((of[pick] - lo) * BUCKETS + g[pick], minlength=len(some) * BUCKETS).reshape(-1, BUCKETS)
                    for lang, x in zip(langs[some].tolist(), n, strict=True):
                        total[lang] = total.get(lang, 0) + x
                    if len(total) > 4 * _LANGUAGES:  # what a task holds is bounded; the rest of the sums are the shuffle's
                        yield from table()
        yield from table()

    d = docs.select("lang", "text").where("lang is not null and text is not null")
    parts = d.mapInArrow(count, "lang string, n array<bigint>").select("lang", F.posexplode("n").alias("bucket", "n")).where("n > 0")
    sums = materialize(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in sums.select("lang").distinct().collect())
    counts, place = np.zeros((len(langs), BUCKETS)), {x: i for i, x in enumerate(langs)}
    for lo in range(0, len(langs), _LANGUAGES):
        t = sums.where(F.col("lang").isin(langs[lo: lo + _LANGUAGES])).toArrow()  # at most _LANGUAGES * BUCKETS rows
        code = t["lang"].combine_chunks().dictionary_encode()
        row = np.array([place[x] for x in code.dictionary.to_pylist()], np.int64)[np.asarray(code.indices)]
        counts[row, np.asarray(t["bucket"])] = np.asarray(t["n"])
    p = counts + 0.2
    return langs, np.log(p / p.sum(1, keepdims=True)) if langs else counts


def text_scores(pages: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """``pages`` with __text (log likelihood of the visible text for each language, tempered to ``TEXT_GRAMS``
    independent trigrams), __grams and declared, from the column html."""
    sent = pages.sparkSession.sparkContext.broadcast(logp.T.astype(np.float32).copy())

    def run(batches):
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html")).to_pylist()
            seen = [visible((x or "").encode()) for x in html]
            texts = pa.array([x for x, _ in seen], pa.binary())
            score, number = np.zeros((len(html), len(langs))), np.zeros(len(html), np.int64)
            for block in tk.blocks(texts):
                g, doc = _grams(block)
                n = np.bincount(doc, minlength=block.n)
                at = slice(block.lo, block.lo + block.n)
                number[at] = n
                for c in range(len(langs)):
                    score[at, c] = np.bincount(doc, weights=sent.value[g, c], minlength=block.n) / np.maximum(n, 1) * np.minimum(n, TEXT_GRAMS)
            rest = [k for k, name in enumerate(batch.schema.names) if name != "html"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in rest), pa.array(score.tolist(), pa.list_(pa.float64())), pa.array(number),
                 pa.array([x for _, x in seen], pa.string())],
                names=[*(batch.schema.names[k] for k in rest), "__text", "__grams", "declared"])

    fields = [f for f in pages.schema.fields if f.name != "html"]
    return pages.mapInArrow(run, T.StructType(fields + T.StructType.fromDDL("__text array<double>, __grams bigint, declared string").fields))


def _parent(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _counted(df: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """(key, name): pages by text-only decision, one number for each language."""
    by_lang = df.groupBy(key, "__map").agg(F.count("*").cast("double").alias("__n"))
    some = F.map_from_entries(F.collect_list(F.struct(F.col("__map").cast("int"), "__n")))
    of = by_lang.groupBy(key).agg(some.alias("__some"))
    return of.select(key, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.try_element_at("__some", c), F.lit(0.0))).alias(name))


def _smoothed(own: Column, above: Column, strength: float) -> Column:
    """Counts and a parent distribution to a distribution."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda x, p: (x + strength * p) / (total + strength))


def _less_own(counts: str) -> Column:
    return F.transform(F.col(counts), lambda x, i: F.greatest(F.lit(0.0), x - (i == F.col("__map")).cast("double")))


def identify(pages: DataFrame, documents: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """``pages`` without html, with lang, confidence (its posterior), text_lang, declared, host and n_grams.

    A page without visible text has no text evidence and no say in the counts; one without url (null, or no ``://``)
    has the empty host, which is judged by the prior of all pages. A null html declares nothing. Ties go to the first
    language in order. Repeated rows are alike and each count. Without any document that names a language, lang is
    null. Columns of the six names are replaced.
    """
    names = ("lang", "confidence", "text_lang", "declared", "host", "n_grams")
    base = pages.drop(*names)
    langs, logp = train(documents)
    known = F.array(*[F.lit(x) for x in langs]) if langs else F.array().cast("array<string>")
    p = text_scores(base.withColumn("host", url_host(F.col("url"))), langs, logp)
    if not langs:
        null = F.lit(None).cast("string")
        return p.drop("__text", "__grams").withColumns({"lang": null, "confidence": F.lit(None).cast("double"), "text_lang": null, "n_grams": F.lit(0).cast("long")})
    k = len(langs)
    p = materialize(
        p.withColumn("__map", F.when(F.col("__grams") > 0, F.array_position("__text", F.array_max("__text")) - 1).otherwise(-1))
        .withColumn("__domain", _parent(F.col("host")))
        .withColumn("__suffix", lower_ascii(F.substring_index(F.col("host"), ".", -1)))
        .withColumn("__said", F.coalesce(F.array_position(known, F.col("declared")), F.lit(0))))
    told = p.where("__map >= 0")
    total = np.zeros(k)
    for r in told.groupBy("__map").count().collect():
        total[r["__map"]] = r["count"]
    everywhere = (total + 1) / (total.sum() + k)
    world = F.array(*[F.lit(float(x)) for x in everywhere])
    none = F.array_repeat(F.lit(0.0), k)
    # what languages declare: at most (languages + 1) x languages numbers
    said = np.ones((k + 1, k))
    for r in told.groupBy("__said", "__map").count().collect():
        said[r["__said"], r["__map"]] += r["count"]
    said = said / said.sum(0)
    said_by = p.sparkSession.createDataFrame([(c, row) for c, row in enumerate(np.log(said).tolist())], "__said bigint, __l array<double>")
    hosts, domains = _counted(told, "host", k, "__h"), _counted(told, "__domain", k, "__d")
    suffixes = _counted(told, "__suffix", k, "__s")
    out = (p.join(hosts, "host", "left").join(domains, "__domain", "left").join(suffixes, "__suffix", "left")
           .join(said_by, "__said")
           .withColumns({c: F.coalesce(c, none) for c in ("__h", "__d", "__s")}))
    prior = _smoothed(_less_own("__h"), _smoothed(_less_own("__d"), world, strength), strength)
    # P(suffix | language) up to what is the same for every language
    suffix = F.zip_with(_smoothed(_less_own("__s"), world, strength), world, lambda a, b: F.log(a) - F.log(b))
    posterior = F.zip_with(F.zip_with(F.col("__text"), F.col("__l"), lambda a, b: a + b),
                           F.zip_with(F.transform(prior, lambda x: F.log(x)), suffix, lambda a, b: a + b), lambda a, b: a + b)
    best = F.array_position("__post", F.array_max("__post"))
    return (out.withColumn("__post", posterior)
            .withColumn("lang", F.element_at(known, best.cast("int")))
            .withColumn("confidence", 1 / F.aggregate(F.col("__post"), F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("__post"))))
            .withColumn("text_lang", F.when(F.col("__map") >= 0, F.element_at(known, (F.col("__map") + 1).cast("int"))))
            .withColumnRenamed("__grams", "n_grams")
            .select(*[c for c in base.columns if c != "html"], *names))
