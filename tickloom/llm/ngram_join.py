"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of 5-word shingle hashes and a MinHash signature (125 values). Texts
   with equal sets form one class, represented by its smallest doc_id and numbered, as doc_ids can repeat.
2. Representatives that agree in one of 25 bands of 5 values are candidates. A bucket is dealt in
   blocks by a hash of the id, and each pair of blocks is its own group, so a huge bucket becomes many
   bounded tasks. A pair is looked at only in the first band in which it agrees.
3. Candidates' signatures are compared 25 values at a time; with a uniform prior, a pair goes as
   soon as the posterior probability that its similarity reaches the threshold is under the tolerance.
4. Surviving pairs are verified on the shingle sets. A group gives each member's number of links and
   its root in the group, not its pairs, so the rows stay linear in the members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import NO_ID, WORD, WordHashes, by_batch, by_group, components, cut, mix, row_key, table, window_hashes

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
STEP = 25
#: A bucket's block holds about so many members, and members with about so many shingles in all.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Up to so many candidate ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _constants() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word windows; of a shorter text, one of all its words."""
    words = hashes.of(WORD.findall(text or ""))
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(width, len(words))))


def signature(sets: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = constants
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(sets), 2048):
        low = np.minimum(low, ((sets[k : k + 2048, None] * a + b) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the fewest equal ones with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m+1, n-m+1), and its tail above t is P(Bin(n+1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def features(docs: DataFrame, width: int) -> DataFrame:
    """``(id, rk, fp1, fp2, n_shingles, sig)`` of each row; texts without words have no ``sig``."""

    def make():
        hashes, constants = WordHashes(), _constants()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp1, fp2, n, sig = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width, hashes)
                d = xxhash.xxh3_128_digest(s.tobytes())
                fp1.append(int.from_bytes(d[:8], "big", signed=True))
                fp2.append(int.from_bytes(d[8:], "big", signed=True))
                n.append(len(s))
                sig.append(signature(s, constants).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["id", "rk", "fp1", "fp2", "n_shingles", "sig"])

        return f

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), row_key("text").alias("rk"), "text")
    return by_batch(rows, make, "id long, rk long, fp1 long, fp2 long, n_shingles long, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(rep, set)`` for the documents in ``ids`` (rep, id, rk): their shingle hashes as bytes."""

    def make():
        hashes = WordHashes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, width, hashes).tobytes() for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

        return f

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), row_key("text").alias("rk"), "text")
    small = ids.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(ids) if small else ids, ["id", "rk"]).select("rep", "text")
    return by_batch(rows, make, "rep long, set binary").dropDuplicates(["rep"])


def _bands(reps: DataFrame) -> DataFrame:
    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            keys = band_keys(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, HASHES))
            ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(size, BANDS))], ["key", "band", "rep", "n_shingles"])

        return f

    return by_batch(reps.select("rep", "n_shingles", "sig"), make, "key long, band int, rep long, n_shingles long")


def _prune(threshold: float, tolerance: float):
    """Of a group's rows (lo, hi, blk, band, rep, sig), those in pairs that survive, with their later partners."""
    least = least_matches(threshold, tolerance)

    def f(t: pa.Table) -> pa.Table | None:
        lo, hi, band = (t.column(c)[0].as_py() for c in ("lo", "hi", "band"))
        ids, blk = t.column("rep").to_numpy(), t.column("blk").to_numpy()
        n = len(ids)
        if n < 2:
            return None
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(n, HASHES)
        keys = band_keys(sigs)[:, :band]
        left = np.flatnonzero(blk == lo)
        right = left if lo == hi else np.flatnonzero(blk == hi)
        if not len(left) or not len(right):  # one of the blocks has no member
            return None
        firsts, seconds = [], []
        for k in range(0, len(left), 64):
            part = left[k : k + 64]
            i, j = np.repeat(part, len(right)), np.tile(right, len(part))
            if lo == hi:
                i, j = i[i < j], j[i < j]
            for b in range(band):  # a pair belongs to the first band in which it agrees
                if not len(i):
                    break
                new = keys[i, b] != keys[j, b]
                i, j = i[new], j[new]
            equal = np.zeros(len(i), np.int32)
            for m in range(0, HASHES, STEP):
                if not len(i):
                    break
                equal += (sigs[i, m : m + STEP] == sigs[j, m : m + STEP]).sum(axis=1, dtype=np.int32)
                alive = equal >= least[m + STEP]
                i, j, equal = i[alive], j[alive], equal[alive]
            firsts.append(i)
            seconds.append(j)
        i, j = np.concatenate(firsts), np.concatenate(seconds)
        if not len(i):
            return None
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        used = np.union1d(i, j)
        at = np.searchsorted(i, used), np.searchsorted(i, used, "right")
        return pa.table(
            {
                "gid": pa.array(np.full(len(used), t.column("gid")[0].as_py())),
                "key": pa.array(np.full(len(used), t.column("key")[0].as_py())),
                "rep": pa.array(ids[used]),
                "partners": pa.ListArray.from_arrays(pa.array(np.append(at[0], at[1][-1]).astype(np.int32)), pa.array(ids[j])),
            }
        )

    return f


def _verify(threshold: float, with_pairs: bool):
    """Exact similarity of the pairs of a group's rows (rep, partners, set)."""

    def f(t: pa.Table) -> pa.Table | None:
        ids = t.column("rep").to_numpy()
        order = np.argsort(ids)
        ids, n = ids[order], len(ids)
        sets = [np.frombuffer(s, np.uint64) for s in t.column("set").take(pa.array(order)).to_pylist()]
        partners = t.column("partners").take(pa.array(order)).to_pylist()
        sizes = np.array([len(s) for s in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(codes.max() + 1, np.int32)
        degree, root = np.zeros(n, np.int64), np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a in range(n):
            found.append((np.zeros(0, np.int64), np.zeros(0)))
            if not partners[a]:
                continue
            mark[codes[starts[a] : starts[a + 1]]] = 1
            with_ = np.searchsorted(ids, np.array(partners[a]))
            both = np.array([mark[codes[starts[b] : starts[b + 1]]].sum() for b in with_])
            mark[codes[starts[a] : starts[a + 1]]] = 0
            same = both / (sizes[a] + sizes[with_] - both)
            ok = same >= threshold
            found[-1] = ids[with_[ok]], same[ok]
            degree[a] += ok.sum()
            np.add.at(degree, with_[ok], 1)
            for b in with_[ok]:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        linked = np.flatnonzero(degree)
        if not len(linked):
            return None
        columns = {"rep": pa.array(ids[linked]), "links": pa.array(degree[linked]), "root": pa.array(ids[[top(x) for x in linked]])}
        if with_pairs:
            columns |= {"others": pa.array([found[x][0] for x in linked], pa.list_(pa.int64())), "similarity": pa.array([found[x][1] for x in linked], pa.list_(pa.float64()))}
        return pa.table(columns)

    return f


def _linked(docs: DataFrame, reps: DataFrame, threshold: float, tolerance: float, width: int, with_pairs: bool = False) -> DataFrame:
    bands = _bands(reps)
    full = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).filter("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int")
    members = (
        bands.join(full, "key")
        .withColumn("n_blocks", blocks)
        .withColumn("blk", F.pmod(F.xxhash64("rep"), "n_blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("key", "band", "rep", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
        .withColumn("gid", F.xxhash64("key", "lo", "hi"))
    )
    members = members.join(reps.select("rep", "sig"), "rep")
    pairs = cut(by_group(members, ["gid", "key"], _prune(threshold, tolerance), "gid long, key long, rep long, partners array<long>"))
    ids = pairs.select("rep").distinct().join(reps.select("rep", "id", "rk"), "rep")
    sets = cut(_sets(docs, ids, width))
    schema = "rep long, links long, root long" + (", others array<long>, similarity array<double>" if with_pairs else "")
    return by_group(pairs.join(sets, "rep"), ["gid", "key"], _verify(threshold, with_pairs), schema)


def _reps(found: DataFrame) -> DataFrame:
    """A row for each distinct shingle set, numbered by ``rep``. Texts without words stay apart: each is a class of its own."""
    own = found.filter("sig IS NOT NULL")
    best = F.min(F.struct("id", "rk"))
    reps = own.groupBy("fp1", "fp2").agg(best.alias("best"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = reps.select("fp1", "fp2", "best.id", "best.rk", "n_copies", "n_shingles", "sig")
    return cut(reps.withColumn("rep", F.monotonically_increasing_id()))


def similar_pairs(docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-5) -> DataFrame:
    """``(a, b, similarity)`` of every pair of classes that reaches the threshold; a, b are representatives' doc_ids."""
    reps = _reps(features(docs, width))
    linked = _linked(docs, reps, threshold, tolerance, width, with_pairs=True)
    pairs = linked.select("rep", F.explode(F.arrays_zip("others", "similarity")).alias("p"))
    pairs = pairs.select("rep", F.col("p.others").alias("other"), F.col("p.similarity").alias("similarity"))
    pairs = pairs.join(reps.select("rep", F.col("id").alias("x")), "rep").join(reps.select(F.col("rep").alias("other"), F.col("id").alias("y")), "other")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, copy_of, n_copies, n_links (and the row's hash ``rk``,
    and ``class_rk``, that of the class's first row by doc_id and hash).

    ``copy_of`` is the smallest doc_id with the same shingle set, ``n_copies`` the rows with that
    set, ``n_links`` the number of other sets whose Jaccard similarity is ``threshold`` or more, and
    ``class_id`` the smallest doc_id that links lead to. A pair of similarity 0.8 is missed with
    probability 5e-5 by the bands and about 1e-5 by a look at the signatures; higher ones with less.

    Words are runs of code points other than ASCII white space. A text of fewer than ``width`` words
    is one shingle. Null, empty and blank texts link with nothing: class_id is their own doc_id.
    Equal rows are copies of each other. A null doc_id counts as the smallest and comes back as null. Where a
    doc_id repeats with other texts, each row has its own copies and links. An empty table gives an empty
    result; other columns are not read.
    """
    found = cut(features(docs, width))
    reps = _reps(found)
    linked = cut(_linked(docs, reps, threshold, tolerance, width))
    links = linked.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    ids = reps.select("rep", "id", "rk")
    classes = roots.join(ids, "rep").groupBy("root").agg(F.min(F.struct("id", "rk")).alias("class"))
    linked_to = links.join(roots.join(classes, "root").select("rep", "class"), "rep", "left")
    copies = reps.select("fp1", "fp2", "rep", F.struct("id", "rk").alias("copy"), "n_copies")
    info = copies.join(linked_to, "rep", "left").filter("n_copies > 1 OR n_links > 0")
    out = found.select("id", "rk", "fp1", "fp2", F.col("sig").isNull().alias("blank")).join(info.withColumn("blank", F.lit(False)), ["fp1", "fp2", "blank"], "left")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(
        real(F.col("id")).alias("doc_id"),
        real(F.coalesce("class.id", "copy.id", "id")).alias("class_id"),
        real(F.coalesce("copy.id", "id")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "rk",
        F.coalesce("class.rk", "copy.rk", "rk").alias("class_rk"),
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rk", "class_rk")
