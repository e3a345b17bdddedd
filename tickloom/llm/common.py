"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import shared_folder

#: A word is a maximal run of code points other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id wherever a key is needed; it sorts before all others.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until no column of ``df`` has them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*columns: str):
    """Hash of the columns a decision depends on; with doc_id it names a row up to equal rows."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


class WordHashes(dict):
    """Word to 64-bit hash; forgets everything at ``room`` words, so its memory is bounded."""

    def __init__(self, room: int = 400_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` word hashes, in order."""
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out)


#: A key with more than 1 / HOT_PARTS of all rows is dealt over several tasks, so at most HOT_PARTS keys are.
HOT_PARTS = 1000
#: Keys that the frequent-items sketch tracks: it names every key with that share of the rows, whatever the table's size.
TRACKED = 16_384


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", keys_of: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each key at most, on ``keys``.

    A hot key's rows are dealt in parts by a hash of the columns ``by``, and its row of ``one`` is repeated for each
    part: 2 * HOT_PARTS more rows in all at most. Hot keys are found by a sketch of bounded size over ``keys_of`` (or
    ``rows``). One that is missed or named without need changes where rows meet, never the result.
    """
    key = F.xxhash64(*keys)
    top = (keys_of or rows).select(key.alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_PARTS}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    hot = {r["item"]: -(-r["count"] * HOT_PARTS // top["n"]) for r in top["top"] or [] if r["count"] * HOT_PARTS > top["n"]}
    if not hot:
        return rows.join(one, keys, how)
    [part] = fresh(rows, "__part")
    parts = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in hot.items() for x in kv]), key).cast("int")
    dealt = rows.withColumn(part, F.when(key.isin(*hot), F.pmod(F.xxhash64(*by), parts).cast("int")).otherwise(0))
    repeated = one.withColumn(part, F.explode(F.when(key.isin(*hot), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [*keys, part], how).drop(part)


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Maps Arrow batches in the tasks; ``make`` runs once in each task and returns the function for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Calls ``f`` with each group's rows. Groups meet by a shuffle and a sort; unlike
    ``applyInArrow`` there is no cost for each group but the call. Callers bound the size of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def flush():
            if held:
                out = f(pa.concat_tables(held))
                held.clear()
                if out is not None and out.num_rows:
                    return out.combine_chunks().to_batches()
            return []

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            columns = [t.column(k).to_numpy() for k in keys]
            new = np.zeros(t.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), t.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if hi <= lo:
                    continue
                key = tuple(c[lo] for c in columns)
                if key != last:
                    yield from flush()
                    last = key
                held.append(t.slice(lo, hi - lo))
        yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges ``(a, b)`` of longs: rows ``(node, root)`` with
    the smallest node of each component. Minimum labels spread along edges and by pointer jumping,
    so the rounds grow with the logarithm of a chain's length; each round is checkpointed."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        new = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        new = cut(new.join(up, "mid", "left").select("node", "old", F.least("mid", "top").alias("root")))
        labels = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            return labels
