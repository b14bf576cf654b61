"""Language identification of web pages by Bayesian evidence fusion (operator 3).

Evidence for the language of a page, multiplied as in Bayes' rule:

* *text*: log likelihoods of the page's words and word beginnings under one multinomial
  model per language, from counts over all labelled documents, tempered by length because
  words are not independent;
* *declared markup language* and *address suffix* (the host's last label, and a language-like
  first step of the path): P(value | language), from grouped sums of the text posteriors
  over all pages, smoothed;
* *host prior*: grouped sums of text posteriors per host, smoothed toward its registered
  domain, that toward its suffix, and that toward all pages.  A page's own share is
  taken out of the sums before it is judged by them.

All counts are aggregations with map-side partial sums, over all rows.  What is joined back
has one row per host, domain, suffix or value, so a hot host never gathers its pages.

Edge cases: a page without text or html is judged by its other evidence; a null url has no
host and gets the prior of all pages; without labelled documents all text likelihoods are
equal and languages are those declared; with no language at all ``lang`` is null; repeated rows give a row each;
null ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import saved, text_batches
from permgrid.llm.wordhash import WordHasher, mix, small_batches

BITS = 15
TAGS = re.compile(r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]{1,8};")


def letter_separators():
    """Bytes between words of ASCII letters and everything beyond ASCII."""
    t = np.ones(256, bool)
    for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        t[a:b] = False
    return t


class WordCells:
    """Hash cells of whole words and of their first and last three bytes, per text."""

    def __init__(self):
        self.hasher = WordHasher(letter_separators(), seed=3)

    def __call__(self, texts):
        s, e, counts, data, _, h = self.hasher.spans(texts)
        cells = [(h >> np.uint64(64 - BITS)).astype(np.int64)]
        at = np.concatenate([data, np.zeros(8, np.uint8)])
        for n, start in ((3, s), (3, np.maximum(e - 3, 0))):
            p = np.full(len(s), len(cells), np.uint64)
            for i in range(n):
                p += self.hasher.value[at[start + i]] * self.hasher.coef[i]
            cells.append(np.where(e - s > n, (mix(p) >> np.uint64(64 - BITS)).astype(np.int64), -1))
        return np.stack(cells, 1), counts


def _count_cells(langs):
    """Sums per (language, cell), one row per cell that a task has seen."""
    def run(batches):
        import pyarrow as pa
        cells, total = WordCells(), np.zeros((len(langs), 1 << BITS), np.int64)
        code = {x: i for i, x in enumerate(langs)}
        for b in small_batches(batches, 1):
            c, counts = cells(b.column(1))
            lang = np.repeat(np.array([code.get(x, -1) for x in b.column(0).to_pylist()], np.int64), counts)
            for k in range(c.shape[1]):
                ok = (c[:, k] >= 0) & (lang >= 0)
                total += np.bincount((lang[ok] << BITS) + c[ok, k], minlength=total.size).reshape(total.shape)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], names=["lang", "cell", "n"])
    return run


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text"):
    """(languages, log likelihood table languages x cells) from all labelled rows."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and lang <> ''")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())  # one row per language
    table = np.zeros((len(langs), 1 << BITS))
    if langs:
        n = rows.mapInArrow(_count_cells(langs), "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
        got = n.toPandas()  # at most languages * 2**BITS rows
        table[got.lang, got.cell] = got.n
    table += 0.5
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def page_text(html: str) -> str:
    return TAGS.sub(" ", html)


def _text_evidence(shared, power, most):
    def run(batches):
        import pyarrow as pa
        langs, table = shared.value
        cells = WordCells()
        for b in small_batches(batches, 1):
            html = [x.as_py() or "" for x in b.column(1)]
            c, counts = cells(pa.array([page_text(x) for x in html], pa.string()))
            doc = np.repeat(np.arange(len(html)), counts)
            ll = np.zeros((len(html), len(langs)))
            for k in range(c.shape[1]):
                ok = c[:, k] >= 0
                for i in range(len(langs)):
                    ll[:, i] += np.bincount(doc[ok], weights=table[i][c[ok, k]], minlength=len(html))
            ll *= (np.minimum(np.maximum(counts, 1) ** power, most) / np.maximum(counts, 1))[:, None]  # tempered
            ll -= ll.max(1, keepdims=True) if len(langs) else 0
            p = np.exp(ll)
            p /= p.sum(1, keepdims=True) if len(langs) else 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(list(ll), pa.list_(pa.float64())),
                 pa.array(list(p), pa.list_(pa.float64())), pa.array(counts)],
                names=["page", "url", "declared", "ll", "post", "n_words"])
    return run


def _shrunk(mass, kappa):
    return lambda x, p: (x + kappa * p) / (mass + kappa)


def _log_share(share, kappa):
    return lambda x, n: F.log((x + kappa * share) / (n + kappa))


def identify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             kappa: float = 4.0, power: float = 0.5, most: float = 40.0) -> DataFrame:
    """Per page: lang, probability, and the language each kind of evidence favours.

    ``kappa`` pseudo-pages carry each level's prior to the next; text evidence counts as
    min(words ** power, most) independent words.
    """
    text_batches(pages.sparkSession)
    langs, table = train(labelled)
    if not langs:
        return _declared_only(pages, id_col, html_col)
    shared = pages.sparkSession.sparkContext.broadcast((langs, table))  # languages * 2**BITS floats
    html = F.col(html_col).cast("string")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), html.alias("html"), F.col(url_col).cast("string").alias("url"), declared.alias("declared"))
    k = len(langs)
    seen = rows.mapInArrow(_text_evidence(shared, power, most), "page long, url string, declared string, ll array<double>, "
                                                                "post array<double>, n_words long")
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    step = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1))
    seen = saved(seen.withColumn("host", F.coalesce(host, F.lit("")))
                 .withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1))
                 .withColumn("tld", F.regexp_extract("host", r"([^.]*)$", 1))
                 .withColumn("suffix", F.concat_ws("/", "tld", F.coalesce(step, F.lit(""))))
                 .withColumn("declared", F.coalesce("declared", F.lit(""))))
    # pages without words say nothing about their neighbours
    votes = seen.where("n_words > 0")
    total = lambda *by: votes.groupBy(*by).agg(F.array(*(F.sum(F.col("post")[i]) for i in range(k))).alias("s"))
    own = F.when(F.col("n_words") > 0, F.col("post")).otherwise(F.array_repeat(F.lit(0.0), k))
    everything = total().first()[0]  # one number per language
    df = seen.withColumn("own", own).withColumn("s_all", F.array(*(F.lit(float(x or 0.0)) for x in everything)))
    for name in ("tld", "domain", "host", "declared", "suffix"):
        df = df.join(total(name).withColumnRenamed("s", f"s_{name}"), name, "left")
    zero = F.array_repeat(F.lit(0.0), k)
    less = lambda c: F.zip_with(F.coalesce(F.col(c), zero), F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    for name in ("all", "tld", "domain", "host", "declared", "suffix"):
        df = df.withColumn(f"o_{name}", less(f"s_{name}")).withColumn(f"m_{name}", mass(F.col(f"o_{name}")))
    df = df.withColumn("prior", F.transform("o_all", lambda x: (x + 1.0) / (F.col("m_all") + float(k))))
    for name in ("tld", "domain", "host"):
        df = df.withColumn("prior", F.zip_with(f"o_{name}", "prior", _shrunk(F.col(f"m_{name}"), kappa)))
    # P(value | language), smoothed toward the value's share among all pages
    for name in ("declared", "suffix"):
        share = (F.col(f"m_{name}") + 0.5) / (F.col("m_all") + 1.0)
        df = df.withColumn(f"l_{name}", F.when(F.col(name) == "", F.array_repeat(F.lit(0.0), k)).otherwise(
            F.zip_with(f"o_{name}", "o_all", _log_share(share, kappa))))
    z = "transform(sequence(0, %d), i -> ll[i] + ln(prior[i]) + l_declared[i] + l_suffix[i])" % (k - 1)
    df = df.withColumn("z", F.expr(z)).withColumn("top", F.array_max("z"))
    df = df.withColumn("sum", F.expr("aggregate(z, 0D, (s, x) -> s + exp(x - top))"))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(F.col(c))).cast("int"))
    return df.select(F.col("page").alias("page_id"), best("z").alias("lang"), (1.0 / F.col("sum")).alias("probability"),
                     F.when(F.col("n_words") > 0, best("ll")).alias("text_lang"),
                     F.when(F.col("declared") != "", F.col("declared")).alias("declared"),
                     F.when(F.col("suffix") != "/", best("l_suffix")).alias("suffix_lang"), best("prior").alias("host_lang"),
                     F.when(F.col("host") != "", F.col("host")).alias("host"))


def _declared_only(pages, id_col, html_col):
    declared = F.lower(F.regexp_extract(F.col(html_col).cast("string"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    declared = F.when(declared != "", declared)
    none = F.lit(None).cast("string")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), declared.alias("lang"),
                        F.when(declared.isNotNull(), 1.0).alias("probability"), none.alias("text_lang"), declared.alias("declared"),
                        none.alias("suffix_lang"), none.alias("host_lang"), none.alias("host"))
