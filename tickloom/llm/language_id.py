"""Language identification by Bayesian evidence fusion.

For each page, three kinds of evidence are multiplied: the text's likelihood under character n-gram
models, the language that the markup declares, and a prior of its host. Host priors are smoothed
towards the registered domain's, those towards the address suffix's, and those towards all pages', by grouped sums of the
text's posteriors; a page's own share is taken out, so that its text isn't counted twice.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import by_batch, cut, spread_join, table
from .html_extract import main_text

#: The models are fitted on about so many labelled texts of each language, chosen by a hash of the id; a documented bound.
FIT_TEXTS = 1500
#: Grams weigh as if a text had so many at most: neighbouring grams aren't independent.
EFFECTIVE_GRAMS = 60.0
#: How often the declared language is right.
MARKUP_TRUST = 0.9
#: Weight of the next wider level in a prior, in pages.
KAPPA = 5.0
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str | None) -> Counter:
    """Counts of the 1- to 3-letter grams of lower-cased words, with borders."""
    out: Counter = Counter()
    for word, n in Counter(LETTERS.findall((text or "").lower())).items():
        w = f" {word} "
        for k in range(len(word)):
            out[w[k + 1]] += n
            out[w[k : k + 2]] += n
            out[w[k : k + 3]] += n
        out[w[-2:]] += n
    return out


def fit(docs: DataFrame, per_language: int = FIT_TEXTS) -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """(languages, log probability of each gram by language, that of unseen grams) from (doc_id, text, lang)."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    shares = {r["lang"]: per_language / r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not shares:
        return [], {}, np.zeros(0)
    languages = sorted(shares)
    share = F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang"))
    sample = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g, n in grams(text).items():
                    counts[lang, g] += n
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "gram", "n"])

        return f

    found = by_batch(sample.select("lang", "text"), make, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    at = {x: k for k, x in enumerate(languages)}
    table_: dict[str, np.ndarray] = {}
    for r in found.toLocalIterator():  # grams of the bounded sample
        table_.setdefault(r["gram"], np.zeros(len(languages)))[at[r["lang"]]] += r["n"]
    sums = sum(table_.values(), np.zeros(len(languages)))
    below = sums + 0.5 * (len(table_) + 1)
    return languages, {g: np.log((c + 0.5) / below) for g, c in table_.items()}, np.log(0.5 / below)


def text_posterior(text: str | None, model) -> np.ndarray:
    languages, table_, unseen = model
    found = grams(text)
    n = sum(found.values())
    if not n:
        return np.full(len(languages), 1 / len(languages))
    score = np.zeros(len(languages))
    for g, k in found.items():
        score += k * table_.get(g, unseen)
    score *= min(n, EFFECTIVE_GRAMS) / n
    score = np.exp(score - score.max())
    return score / score.sum()


def address(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    return {"_host": host, "_domain": F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), 2), "."), "_suffix": F.element_at(labels, -1)}


def identify(pages: DataFrame, labelled: DataFrame, id_column: str = "page_id", per_language: int = FIT_TEXTS) -> DataFrame:
    """One row for each of ``pages`` (id, url, html): id, url, declared, text_lang, text_p, lang, p.

    ``labelled``: doc_id, text, lang. Null, blank and letterless pages have even text likelihoods, so
    that markup and address decide; a null or unparsable url has the host ''. A declared language the
    models don't know, or none, says nothing. Of equal posteriors the first language in alphabetical
    order wins. Equal pages count as often as they occur. Without labelled texts lang is null. An empty table gives an empty result; other columns are not read.
    """
    model = fit(labelled, per_language)
    languages = model[0]
    rows = pages.select(F.col(id_column), "url", "html")
    if not languages:
        return rows.select(id_column, "url", *[F.lit(None).cast(t).alias(c) for c, t in (("declared", "string"), ("text_lang", "string"), ("text_p", "double"), ("lang", "string"), ("p", "double"))])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        model = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            htmls = batch.column(2).to_pylist()
            declared = [m[1].lower() if h and (m := DECLARED.search(h)) else None for h in htmls]
            text = [text_posterior(main_text(h), model) for h in htmls]
            columns = [pa.array(np.array(x)) for x in zip(*text)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), *columns], [id_column, "url", "declared", *[f"t{k}" for k in range(len(languages))]])

        return f

    schema = rows.drop("html").schema.add("declared", "string")
    for k in range(len(languages)):
        schema = schema.add(f"t{k}", "double")
    found = by_batch(rows, make, schema)
    found = cut(found.withColumns(address(F.col("url"))))
    ts = range(len(languages))
    levels = [["_host", "_domain", "_suffix"], ["_domain", "_suffix"], ["_suffix"], []]
    sums = [found.groupBy(*keys).agg(*[F.sum(f"t{k}").alias(f"s{n}_{k}") for k in ts], F.count("*").alias(f"n{n}")) for n, keys in enumerate(levels)]
    # the levels' sums meet on the hosts, of which there are far fewer than pages
    hosts = sums[0].join(sums[1], levels[1]).join(sums[2], levels[2]).crossJoin(F.broadcast(sums[3]))  # one row
    # a host may hold a third of all pages
    out = spread_join(found, hosts, levels[0], [id_column, "url"])
    prior = [F.lit(1.0 / len(languages)) for _ in ts]
    for n in (3, 2, 1, 0):  # from all pages down to the host, without the page itself
        prior = [(F.col(f"s{n}_{k}") - F.col(f"t{k}") + KAPPA * prior[k]) / (F.col(f"n{n}") - 1 + KAPPA) for k in ts]
        out = out.withColumns({f"p{n}_{k}": F.greatest(prior[k], F.lit(1e-9)) for k in ts})
        prior = [F.col(f"p{n}_{k}") for k in ts]
    wrong = (1 - MARKUP_TRUST) / max(1, len(languages) - 1)
    says = [F.when(~F.coalesce(F.col("declared").isin(languages), F.lit(False)), 1.0).when(F.col("declared") == x, MARKUP_TRUST).otherwise(wrong) for x in languages]
    out = out.withColumns({f"f{k}": F.col(f"t{k}") * says[k] * prior[k] for k in ts})
    pick = lambda c: F.array_max(F.array(*[F.struct(F.col(f"{c}{k}").alias("p"), F.lit(-k).alias("k")) for k in ts]))
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in languages]), 1 - c)
    out = out.withColumns({"_t": pick("t"), "_f": pick("f")})
    total = sum((F.col(f"f{k}") for k in ts), F.lit(0.0))
    return out.select(id_column, "url", "declared", name(F.col("_t.k")).alias("text_lang"), F.col("_t.p").alias("text_p"), name(F.col("_f.k")).alias("lang"), (F.col("_f.p") / total).alias("p"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
