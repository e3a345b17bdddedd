"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose score exceeds a cutoff. For every stratum (language) the rules' cutoffs
are tested together on the labelled holdout, as one fixed sequence of settings from the loosest to the strictest: H0
says that more than ``risk`` of the stratum's good texts would be rejected by one rule or another, and its exact p-value
is the binomial tail P(Bin(n, risk) <= false rejections), so that H0 falls exactly when the
Clopper-Pearson upper bound is under the limit. Testing stops at the first setting that isn't
certified (fixed-sequence testing), and the strata share ``delta`` by Bonferroni. So, with
probability 1 - delta, no certified setting of any stratum rejects more than ``risk`` of its good texts, whichever is chosen
later. Of the certified settings the one with the best difference between the rejected shares of bad and good texts is used, the
loosest of equal ones. A stratum without enough labels (86 good ones, if none is rejected, for four strata at 0.05) has no certified
setting, and its texts pass.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, by_batch, cut, row_key, table

#: Rule: score as a SQL expression over the features, and its grid from the loosest to the strictest cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08]),
    "exclaims": ("n_exclaims / n_words", [2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08]),
    "upper": ("n_upper / n_words", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15]),
    "top_word": ("n_top_word / n_words", [0.9, 0.7, 0.5, 0.4, 0.35, 0.3, 0.25, 0.22, 0.2]),
    "dup_lines": ("n_dup_lines / greatest(n_word_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "repeats": ("n_repeat_words / n_words", [0.2, 0.17, 0.14, 0.12, 0.1, 0.08]),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_exclaims", "n_upper", "n_top_word"]
SYMBOLS = "#*$%&|<>"
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
#: The settings of the sequence: each rule's next cutoff, or its last.
SETTINGS = [{rule: grid[min(k, len(grid) - 1)] for rule, (_, grid) in RULES.items()} for k in range(max(len(grid) for _, grid in RULES.values()))]
#: Cutoff tables of up to so many strata are broadcast; larger ones are joined by a shuffle.
BROADCAST_STRATA = 10_000


def counts(text: str | None) -> list[int]:
    """The features of one whole text, in the order of COUNTS; null counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if len(words) >= 6:
        windows = list(zip(words, islice(words, 1, None), islice(words, 2, None), islice(words, 3, None), islice(words, 4, None)))
        found = Counter(windows)
        if len(found) < len(windows):
            end = 0
            for k, w in enumerate(windows):
                if found[w] > 1:
                    repeated += k + 5 - max(end, k)
                    end = k + 5
    top = max(Counter(words).values(), default=0)
    return [len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated, lines, text.count("!"), sum(map(str.isupper, words)), top]


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, rk, stratum`` and COUNTS for every row; ``rk`` names the row by text and stratum."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [counts(t) for t in batch.column(3).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], ["doc_id", "rk", "stratum", *COUNTS])

        return f

    rows = docs.select(F.col("doc_id").cast("long"), row_key("text", stratum).alias("rk"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    return by_batch(rows, make, "doc_id long, rk long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from logarithms."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def choose(good: int, bad: int, good_over: list[int], bad_over: list[int], limit: float, delta: float) -> int | None:
    """Index of the setting to use, or None: certified in sequence, then the best separation."""
    best, at = 0.0, None
    for k, (g, b) in enumerate(zip(good_over, bad_over)):
        if not good or binomial_tail(good, g, limit) > delta:
            break
        gain = (b / bad if bad else 0.0) - g / good
        if gain > best + 1e-12:
            best, at = gain, k
    return at


def rejects(cutoff) -> Column:
    """Whether a rule rejects a text; ``cutoff`` gives a rule's, a null one rejects nothing."""
    out = F.lit(False)
    for rule, (score, _) in RULES.items():
        out = out | F.coalesce(F.expr(score) > cutoff(rule), F.lit(False))
    return out


def cutoffs(labelled: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stratum`` and a cutoff for each rule (null: no setting is certified). ``labelled``: stratum, quality and COUNTS.

    Only texts that pass the base rule count, since the rules decide on no others.
    """
    rows = labelled.filter(f"NOT ({BASE_FAILED}) AND quality IN (0, 1)")
    is_ = lambda q: F.col("quality") == q
    sums = [F.count_if(is_(q)).alias(f"all_{q}") for q in (0, 1)]
    sums += [F.count_if(is_(q) & rejects(lambda rule: F.lit(setting[rule]))).alias(f"over_{k}_{q}") for k, setting in enumerate(SETTINGS) for q in (0, 1)]
    table_ = cut(rows.groupBy("stratum").agg(*sums))  # a row for each stratum
    share = delta / max(1, table_.count())

    def pick(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                over = [[r[f"over_{k}_{q}"] for k in range(len(SETTINGS))] for q in (1, 0)]
                at = choose(r["all_1"], r["all_0"], *over, risk, share)
                out.append({"stratum": r["stratum"]} | (dict.fromkeys(RULES) if at is None else SETTINGS[at]))
            yield pd.DataFrame(out, columns=["stratum", *RULES]).astype({r: "float64" for r in RULES})

    return table_.mapInPandas(pick, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row for each row of ``docs``: doc_id, rk, stratum, COUNTS, base_failed, the cutoffs, kept.

    ``labels`` (doc_id, quality 0/1) is the holdout; of several labels the lowest counts, others than
    0 and 1 don't. Null and empty texts have no words: base_failed. A null stratum is the stratum ''.
    A null doc_id has no label. Equal rows get equal verdicts. Without labels only the base rule
    rejects. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    found = cut(features(docs, stratum))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    limits = cut(cutoffs(found.join(known, "doc_id"), risk, delta).withColumnsRenamed({r: f"cut_{r}" for r in RULES}))
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    out = found.join(limits, "stratum", "left").withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~rejects(lambda rule: F.col(f"cut_{rule}"))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept")
