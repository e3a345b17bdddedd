"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Only DataFrame functions run here. Documents come in batches, the largest doc_ids first. A run is a
Parquet table of line hashes, sorted by hash in each of its files, with the number of documents and the largest doc_id holding
each. A new batch is merge-joined with the runs there are: keys that have already reached
``min_docs`` under an owner that the batch can't change are anti-joined away, and the rest of the batch becomes a run of level
0. ``fanout`` runs of a level are merged into one of the next. At the end the runs are merged once
more, and each document's lines are joined with the keys that reached ``min_docs``. Runs outlive the session: ``LineRuns`` of the
same folder goes on with them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BLANK, NO_ID, cut, fresh, row_key, shared_folder, spread_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _merge(runs: list[DataFrame]) -> DataFrame:
    merged = reduce(DataFrame.unionByName, runs)
    return merged.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


class LineRuns:
    """Runs by level in a folder that all executors share. ``add`` takes the keys ``(id, h1, h2)`` of one batch, once for each document.

    A run's name holds its own mark and those of the runs it was merged from. So a run is there once its table is complete, and
    its parts are gone from that moment on, even if the session ends before their files are removed. One session at a time adds.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 5, fanout: int = 2):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder.rstrip("/"), min_docs, fanout
        self.levels: list[list[str]] = []
        found = self._complete()
        gone = {mark for name in found for mark in name.split("-")[3:]}
        for name in sorted(found):
            if name.split("-")[2] not in gone:
                self._level(int(name.split("-")[1])).append(name)

    def _files(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self) -> list[str]:
        fs, p = self._files("run-*/_SUCCESS")
        return [x.getPath().getParent().getName() for x in fs.globStatus(p) or []]

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _read(self, names: list[str]) -> list[DataFrame]:
        return [self.spark.read.schema("h1 long, h2 long, n_docs long, owner long").parquet(f"{self.folder}/{name}") for name in names]

    def settled(self) -> DataFrame | None:
        names = [name for level in self.levels for name in level]
        return _merge(self._read(names)).filter(F.col("n_docs") >= self.min_docs) if names else None

    def add(self, keys: DataFrame) -> None:
        """``keys`` must be of documents that no batch before had."""
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("owner"))
        known = self.settled()
        if known is not None:
            known = known.select("h1", "h2", F.col("owner").alias("held"))
            own = own.alias("own").join(known.alias("known"), (F.col("own.h1") == F.col("known.h1")) & (F.col("own.h2") == F.col("known.h2")) & (F.col("held") >= F.col("own.owner")), "left_anti")
        self._push(0, own, [])

    def _push(self, level: int, run: DataFrame, parts: list[str]) -> None:
        name = "-".join(["run", str(level), uuid.uuid4().hex[:12], *[part.split("-")[2] for part in parts]])
        run.sortWithinPartitions("h1", "h2").write.parquet(f"{self.folder}/{name}")
        for part in parts:
            fs, p = self._files(part)
            fs.delete(p, True)
        self._level(level).append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._push(level + 1, _merge(self._read(names)), names)


def line_keys(docs: DataFrame, min_length: int) -> DataFrame:
    """``(id, rk, pos, h1, h2)`` for every line whose key has ``min_length`` code points or more."""
    key = F.translate(F.trim(F.col("line"), F.lit(BLANK)), UPPER, LOWER)
    return (
        docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), row_key("text").alias("rk"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
        .filter(F.length("line") >= min_length)
        .select("id", "rk", "pos", key.alias("key"))
        .filter(F.length("key") >= min_length)
        # two independent 64-bit hashes: 128 bits keep different lines apart at any size
        .select("id", "rk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, runs: LineRuns | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` after dedup, and ``n_lines``, ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys of at
    least ``min_length`` code points found in at least ``min_docs`` documents lose all their lines
    but those in the document of the largest doc_id that holds them.

    Null or empty text: one empty line, none dropped, text ''. A null doc_id counts as one document
    that sorts before all others. Rows with an equal doc_id count as one document. Equal rows give
    equal results, one row for each. An empty table gives an empty result. Extra columns pass
    through. With ``runs`` the documents of earlier calls count too, whose doc_ids must be others and whose results must be written before, and ``min_docs`` and ``fanout`` are those of
    the runs. ``n_lines`` and ``n_dropped`` of the input are replaced. Very long texts are split
    and hashed whole.
    """
    lines = cut(line_keys(docs, min_length))
    keys = lines.select("id", "h1", "h2").distinct()
    low, high = lines.agg(F.min("id"), F.max("id")).first()
    runs = runs or LineRuns(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/line-runs-{uuid.uuid4().hex}", min_docs, fanout)
    if low is not None:
        step = (high - low) // batches + 1
        for k in reversed(range(batches)):  # the largest ids first
            lo, hi = low + k * step, low + (k + 1) * step
            runs.add(keys.filter((F.col("id") >= lo) & (F.col("id") < hi)) if batches > 1 else keys)
    known = runs.settled()
    # no hint: the number of settled keys grows with the corpus, so Spark picks by measured size; one line may make up a third of all
    drop = spread_join(lines, known.select("h1", "h2", "owner"), ["h1", "h2"], ["id", "rk", "pos"]).filter("id <> owner") if known is not None else lines.limit(0)
    own, rk, gone, parts = fresh(docs, "__id", "__rk", "__drop", "__lines")
    drop = drop.groupBy(F.col("id").alias(own), F.col("rk").alias(rk)).agg(F.collect_set("pos").alias(gone))
    # a text's own positions only: as long as the text itself at most
    base = docs.drop("n_lines", "n_dropped").withColumns({own: F.coalesce("doc_id", F.lit(NO_ID)), rk: row_key("text")})
    joined = base.join(drop, [own, rk], "left")
    out = joined.withColumn(parts, F.split(F.coalesce("text", F.lit("")), "\n")).withColumn("n_lines", F.size(parts).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda p: F.col(parts)[p]), "\n"))
    out = out.withColumn("text", text).withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return out.select(*docs.drop("n_lines", "n_dropped").columns, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), many AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, many.key IS NOT NULL AND k.doc_id <> many.owner AS gone
  FROM k LEFT JOIN many USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
