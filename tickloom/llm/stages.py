"""The pipeline's stages: operators applied to documents, decisions taken, columns kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from .common import fresh, row_key, table


def _without(docs: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``docs`` but those that ``gone`` (doc_id, rk) names, null doc_ids included."""
    own_id, own, gone_id, key = fresh(docs, "__id", "__key", "__gone_id", "__gone")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("rk").alias(key))
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own: row_key(*columns)})
    return keyed.join(gone, (F.col(own) == F.col(key)) & F.col(own_id).eqNullSafe(F.col(gone_id)), "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = quality_rules.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _without(docs, found.filter("NOT kept"), "text", "lang")


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat across documents; n_chars follows the text."""
    names = docs.columns
    held = {c: fresh(docs, f"__held_{c}")[0] for c in names if c.lower() in ("n_lines", "n_dropped")}  # the operator's own columns
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(held))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(held[c]).alias(c) if c in held else c for c in names])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id, and of equal rows one."""
    groups = ngram_join.jaccard_groups(docs)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("rk") == F.col("class_rk"))
    out = _without(docs, groups.filter(~first).select("doc_id", "rk"), "text")
    # a doc_id (null too) can repeat over classes, so a row's hash tells which it is; of equal rows one stays
    own_id, own, same_id, key, place = fresh(docs, "__id", "__key", "__same_id", "__same", "__place")
    same = groups.filter(first & ((F.col("n_copies") > 1) | (F.col("n_links") > 0))).groupBy(F.col("doc_id").alias(same_id), F.col("rk").alias(key)).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    keyed = out.withColumns({own_id: F.col("doc_id").cast("long"), own: row_key("text")})
    if same.isEmpty():
        return out
    on = (F.col(own) == F.col(key)) & F.col(own_id).eqNullSafe(F.col(same_id))
    one = keyed.join(same, on, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(own_id, own).orderBy(F.lit(0)))).filter(F.col(place) == 1)
    return keyed.join(same, on, "left_anti").select(*docs.columns).unionAll(one.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id", "rk").distinct(), "text")


def mixing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with topic, n_tokens, expected_copies and n_copies."""
    return mixing.mix(docs)
