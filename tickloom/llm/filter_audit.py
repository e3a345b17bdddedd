"""Audit of how filters interact in every order of application.

Each document gets a mask with a bit for each filter it fails. All orders are then evaluated from the counts of the 32 masks in each
part: a document is removed by the first filter of an order whose bit it has, whatever the other documents are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, table

BLANK = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]


def conditions(text: Column, min_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, marks: str = "[#$%&*|]") -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, BLANK), "")
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < distinct_percent * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > capital_percent * F.length(text).cast("long"),
        "D": text.rlike(marks),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, n_good, n_toxic): how many documents of each part fail just the filters in ``mask`` (A is bit 1, E bit 16)."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(conditions(text).values())), F.lit(0))
    # texts are read once; from here on a document is its digest
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce("source", F.lit("")).alias("part"), bits.cast("int").alias("bits")))
    known = rows.filter("doc_id IS NOT NULL")
    # joined by digest and doc_id, so a text with very many copies meets its minimum in many tasks
    least = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = known.join(least, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(F.col("first"), F.col("bits")).otherwise(F.col("bits") + 16).alias("mask"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    each = marked.join(marks, "doc_id", "left").select("part", "mask", "good", "bad")
    each = each.unionByName(rows.filter("doc_id IS NULL").select("part", F.col("bits").alias("mask")), allowMissingColumns=True)
    return each.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("bad").alias("n_toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (``source``), filter order and step, with the counts of documents.

    ``kept`` and ``removed`` by this step, ``redundant`` (failing its filter, but removed before), ``unique_fails`` (failing its filter only),
    ``good_lost`` and ``toxic_lost`` (removed here with the label quality = 1, toxic = 1) and ``shapley`` (removed by its filter, summed over all orders).

    Null or empty text: no words, so it fails A, and E if a smaller doc_id has such a text. A null doc_id is neither
    smaller nor larger than another: its row passes E, lets others pass it and has no labels. Rows with an equal doc_id and text are
    no duplicates of each other. A null source is the part ''. Of several labels of a doc_id any 1 counts. Texts are read whole.
    Extra columns are left out. An empty table gives an empty result.
    """
    cells = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # 32 at most
    steps = cells.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.lit([1, 2, 3, 4, 5])))
    own = sum((F.when(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)) == x, 1 << k).otherwise(0) for k, x in enumerate(LETTERS)), F.lit(0))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(LETTERS)), F.lit(0))
    steps = steps.withColumns({"own": own, "before": before})

    def total(of, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda sum_, c: sum_ + of(c))

    def seen(c):
        return c["mask"].bitwiseAND(F.col("before")) != 0

    def fails(c):
        return c["mask"].bitwiseAND(F.col("own")) != 0

    def here(c):
        return fails(c) & ~seen(c)

    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["n"], lambda c: ~fails(c) & ~seen(c)).alias("kept"),
        total(lambda c: c["n"], here).alias("removed"),
        total(lambda c: c["n"], lambda c: fails(c) & seen(c)).alias("redundant"),
        total(lambda c: c["n"], lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: c["n_good"], here).alias("good_lost"),
        total(lambda c: c["n_toxic"], here).alias("toxic_lost"),
        # of the filters that a document fails each comes first in the same number of orders
        total(lambda c: c["n"] * (len(ORDERS) / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), m AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY text
), f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > m.first THEN 'E' ELSE '' END AS fails
  FROM d JOIN m ON d.text = m.text LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM o, range(1, 6) t(step)
), r AS (
  SELECT part, filter_order, step, own, n, good, bad, contains(fails, own) AS f, fails = own AS only_,
         length(translate(fails, before, '')) < length(fails) AS seen
  FROM s, c
), g AS (
  SELECT part, filter_order, step, own,
         CAST(sum(CASE WHEN NOT f AND NOT seen THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN f AND NOT seen THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN f AND seen THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN only_ THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN f AND NOT seen THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN f AND NOT seen THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
