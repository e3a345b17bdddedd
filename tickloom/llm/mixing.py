"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic). Raking scales these cells in turn until their source,
language and topic marginals have the target shares. A document's expected number of copies is its
cell's raked weight over the cell's tokens; the whole part is certain and the rest is decided by a
uniform number from the hash of its doc_id, so that samples are reproducible and independent of partitioning.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, by_batch, cut, fresh, row_key, table

#: Topic: words and word groups that speak for it. A text has the topic with the most hits, the first of equal ones.
TOPICS = {
    "legal": "license|licensed|licence|copyright|agreement|warranty|contract|liability|court|law",
    "technical": "token|password|secret|key|server|http|https|api|code|software|config|email|mail|www",
    "science": "theorem|experiment|hypothesis|energy|cell|species|equation|data|research|study",
    "commerce": "price|sale|order|payment|shipping|market|bank|credit|discount|customer",
}
GENERAL = "general"
#: Target share of a category: proportional to its tokens to this power (1 keeps shares, 0 makes them equal).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Raking ends when every marginal is this close to its target (relative), or after so many sweeps with a warning.
TOLERANCE, SWEEPS = 1e-6, 50
#: A dimension's sums are broadcast up to so many categories; more are joined by a shuffle.
BROADCAST_CATEGORIES = 100_000
SALT = "mix-1"


def _pattern(words: str) -> str:
    return rf"(^|[^a-z])({words})([^a-z]|\z)"


RUN = re.compile("[a-z]+")


class Topics:
    """The topic of a text by the words that speak for it, and its number of tokens."""

    def __init__(self, topics: dict[str, str]):
        self.names = list(topics)
        # this engine writes the end of a text as \Z
        self.patterns = [re.compile(_pattern(words).replace(r"\z", r"\Z")) for words in topics.values()]
        # only texts that have one of the words are searched for the patterns
        self.mentions = frozenset(w for words in topics.values() for w in words.split("|"))
        self.plain = all(RUN.fullmatch(w) for w in self.mentions)

    def of(self, text: str | None) -> tuple[str, int]:
        text = text or ""
        low = text.lower()
        n = len(WORD.findall(text))
        if self.plain and self.mentions.isdisjoint(RUN.findall(low)):
            return GENERAL, n
        hits = [len(p.findall(low)) for p in self.patterns]
        best = max(hits, default=0)
        return (self.names[hits.index(best)] if best else GENERAL), n


def _key(topic_column: str | None) -> Column:
    return row_key("text", "source", "lang", *([topic_column] if topic_column else []))


def with_cells(docs: DataFrame, topics: dict[str, str] = TOPICS, topic_column: str | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, rk (its hash), source, lang, and the cell _source, _lang, _topic with _tokens (words).

    ``topics``: the words of each topic, joined by ``|``. With ``topic_column`` that column is the topic instead, null being ''.
    """
    words = {} if topic_column else topics

    def make():
        by = Topics(words)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, tokens = zip(*map(by.of, batch.column(5).to_pylist()))
            topic = batch.column(4) if topic_column else pa.array(found, pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns[:4], topic, pa.array(tokens, pa.int64())], ["doc_id", "rk", "source", "lang", "_topic", "_tokens"])

        return f

    own = F.coalesce(F.col(topic_column).cast("string"), F.lit("")) if topic_column else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long"), _key(topic_column).alias("rk"), F.col("source").cast("string"), F.col("lang").cast("string"), own.alias("_topic"), "text")
    found = by_batch(rows, make, "doc_id long, rk long, source string, lang string, _topic string, _tokens long")
    return found.withColumns({"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit(""))})


def goals(cells: DataFrame, d: str, power: float, wanted: dict[str, float] | None = None) -> DataFrame:
    """``(_d, goal)``: the target share of each category of dimension ``d``; the shares add up to 1."""
    share = cells.groupBy(f"_{d}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("goal"))
    if wanted:
        named = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
        share = share.withColumn("goal", F.coalesce(F.try_element_at(named, F.col(f"_{d}")), F.lit(0.0)))
    share = cut(share)
    return share.crossJoin(F.broadcast(share.agg(F.sum("goal").alias("all")))).select(f"_{d}", (F.col("goal") / F.col("all")).alias("goal"))  # one row


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (_source, _lang, _topic, tokens > 0) with the raked ``weight``, which sums to the tokens.

    A dimension's target shares are those in ``targets`` (scaled to 1 over the categories there are;
    a category that isn't named gets none), or else follow ``powers``. Sweeps end when no marginal is
    further than ``tolerance`` from its target, relatively; marginals that no weights reach together end with
    a warning after ``sweeps``, and ``shares`` tells how far they are. Cells stay distributed: a
    category's weights are summed by partial aggregates and joined back to the cells.
    """
    total = cells.agg(F.sum("tokens").alias("total"))
    out = cells.withColumn("weight", F.col("tokens").cast("double")).crossJoin(F.broadcast(total))  # one row
    few = {}
    for d, power in powers.items():
        share = cut(goals(cells, d, power, (targets or {}).get(d)))
        few[d] = share.count() <= BROADCAST_CATEGORIES
        share = share.withColumnRenamed("goal", f"goal_{d}")
        out = out.join(F.broadcast(share) if few[d] else share, f"_{d}")
    names = out.columns
    out = cut(out)
    for _ in range(sweeps):
        for d in powers:
            have = out.groupBy(f"_{d}").agg(F.sum("weight").alias("have"))
            want = F.col(f"goal_{d}") * F.col("total")
            far = F.when(want > 0, F.abs(F.col("have") / want - 1)).otherwise(F.col("have") / F.col("total"))
            scaled = F.when(F.col("have") > 0, F.col("weight") * want / F.col("have")).otherwise(0.0)
            out = out.join(F.broadcast(have) if few[d] else have, f"_{d}").withColumns({"weight": scaled, f"far_{d}": far}).drop("have")
        # a sweep reads its own start twice for each dimension, so it is written before the next
        out = cut(out)
        far = out.agg(F.max(F.greatest(F.lit(0.0), *[f"far_{d}" for d in powers]))).first()[0]
        out = out.select(*names)
        if far is None or far <= tolerance:
            break
    else:
        if sweeps:
            warnings.warn(f"marginals are {far:.3g} off their targets after {sweeps} sweeps", stacklevel=2)
    return out.select("_source", "_lang", "_topic", "tokens", "weight")


def shares(raked: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``(dimension, category, goal, share)``: the target of each marginal and what ``rake`` reached."""
    total = raked.agg(F.sum("weight").alias("all"))
    parts = []
    for d, power in powers.items():
        have = raked.groupBy(f"_{d}").agg(F.sum("weight").alias("have")).crossJoin(F.broadcast(total))  # one row
        part = have.join(goals(raked, d, power, (targets or {}).get(d)), f"_{d}")
        parts.append(part.select(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("category"), "goal", (F.col("have") / F.col("all")).alias("share")))
    return reduce(DataFrame.unionAll, parts)


def decide(docs: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, budget: float = 1.0, sweeps: int = SWEEPS, salt: str = SALT, topics: dict[str, str] = TOPICS, topic_column: str | None = None) -> DataFrame:
    """doc_id, rk, source, lang, topic, n_tokens, expected_copies and n_copies of the rows that are sampled; see ``mix``."""
    found = cut(with_cells(docs, topics, topic_column))
    cells = found.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")).filter("tokens > 0")
    raked = rake(cut(cells), powers, targets, sweeps)
    # cells by their key in the plan's own choice of join: Spark broadcasts them when their measured size is small
    raked = raked.select("_source", "_lang", "_topic", (budget * F.col("weight") / F.col("tokens")).alias("expected_copies"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    whole = F.floor("expected_copies")
    out = found.join(raked, ["_source", "_lang", "_topic"]).filter("_tokens > 0").withColumn("n_copies", (whole + (draw < F.col("expected_copies") - whole).cast("long")).cast("long"))
    return out.filter("n_copies > 0").select("doc_id", "rk", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "expected_copies", "n_copies")


ADDED = ["topic", "n_tokens", "expected_copies", "n_copies"]


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, budget: float = 1.0, sweeps: int = SWEEPS, salt: str = SALT, topics: dict[str, str] = TOPICS, topic_column: str | None = None) -> DataFrame:
    """The sampled rows of ``docs``, all columns, with topic, n_tokens, expected_copies and n_copies >= 1.

    ``budget``: tokens wanted, as a multiple of the tokens there are. ``topics`` and ``topic_column``: see ``with_cells``. Null source or language is the
    category ''. Null and empty texts have no tokens, weigh nothing and are never sampled. Equal
    rows share their fate; rows with a null doc_id all share one random number. Input columns of
    the four names that are added are replaced, others pass through. An empty table gives an empty result.
    """
    own_id, own, taken_id, key = fresh(docs, "__own_id", "__own", "__id", "__rk")
    taken = decide(docs, powers, targets, budget, sweeps, salt, topics, topic_column).select(F.col("doc_id").alias(taken_id), F.col("rk").alias(key), *ADDED).distinct()
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own: _key(topic_column)}).drop(*ADDED)
    out = keyed.join(taken, (F.col(own) == F.col(key)) & F.col(own_id).eqNullSafe(F.col(taken_id)))
    return out.select(*docs.drop(*ADDED).columns, *ADDED)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("expected_copies", 6).alias("expected_copies"), "n_copies")


def _sql() -> str:
    hits = ",\n    ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{_pattern(w)}')) AS h{k}" for k, w in enumerate(TOPICS.values()))
    best = f"greatest({', '.join(f'h{k}' for k in range(len(TOPICS)))})"
    cases = " ".join(f"WHEN h{k} = {best} THEN '{name}'" for k, name in enumerate(TOPICS))
    ctes = [
        f"h AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l,\n    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,\n    {hits} FROM documents)",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, s, l, n_tokens, CASE WHEN {best} = 0 THEN '{GENERAL}' {cases} END AS t FROM h)",
        "w0 AS MATERIALIZED (SELECT s, l, t, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "total AS MATERIALIZED (SELECT CAST(sum(tokens) AS DOUBLE) AS n FROM w0)",
    ]
    for c, d in (("s", "source"), ("l", "lang"), ("t", "topic")):
        ctes.append(f"g{c} AS MATERIALIZED (SELECT {c}, g / sum(g) OVER () AS goal FROM (SELECT {c}, pow(CAST(sum(tokens) AS DOUBLE), {POWERS[d]}) AS g FROM w0 GROUP BY {c}))")
    step = "SELECT r.*, n, gs, gl, gt FROM r JOIN (SELECT s, goal AS gs FROM gs) USING (s) JOIN (SELECT l, goal AS gl FROM gl) USING (l) JOIN (SELECT t, goal AS gt FROM gt) USING (t), total WHERE far > {tol} AND k < {most}".format(tol=TOLERANCE, most=SWEEPS)
    for c in "slt":
        step = f"SELECT * REPLACE (w * g{c} * n / have AS w), abs(have / (g{c} * n) - 1) AS far_{c} FROM (SELECT *, sum(w) OVER (PARTITION BY {c}) AS have FROM ({step}))".replace("SELECT * REPLACE", "SELECT * EXCLUDE (have) REPLACE")
    ctes.append(f"r AS (SELECT 0 AS k, s, l, t, tokens, w, CAST(1 AS DOUBLE) AS far FROM w0\n  UNION ALL SELECT k + 1, s, l, t, tokens, w, max(greatest(far_s, far_l, far_t)) OVER () FROM ({step}))")
    ctes.append("raked AS (SELECT s, l, t, tokens, w FROM r WHERE k = (SELECT max(k) FROM r))")
    ctes.append(f"p AS (SELECT doc_id, source, lang, t AS topic, n_tokens, w / tokens AS e, CAST('0x' || substr(md5('{SALT}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM d JOIN raked USING (s, l, t) WHERE n_tokens > 0)")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(e, 6) AS expected_copies, CAST(floor(e) AS BIGINT) + CASE WHEN u < e - floor(e) THEN 1 ELSE 0 END AS n_copies\nFROM p WHERE floor(e) + CASE WHEN u < e - floor(e) THEN 1 ELSE 0 END > 0"


SQL = _sql()
