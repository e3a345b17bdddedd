"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders (a run of names is one), the rest is lower-cased
without punctuation. Windows of the template are hash-joined with the benchmark's windows. For each
document and item that share windows, the slots' values are then held together: an item's value
must always have become the same value in the document, and different values different ones (the values can differ from the
item's: that is a re-parameterised question). Windows of the lower-cased words with their values (no placeholders)
are joined too, so that copies in other case, where names can't be told, and copies dense in numbers are found. A pair is a leak if
windows that agree in one of the two ways cover at least ``share`` of the item.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BLANK, by_batch, cut, mix, row_key, table, window_hashes

WIDTH = 8
#: A window counts only if so many of its tokens are no placeholders.
LITERALS = 4
#: An item of fewer words is too short to tell a leak from chance.
LEAST_WORDS = 4
#: Benchmarks of up to so many windows (16 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Items' texts are broadcast up to so many characters in all.
BROADCAST_TEXT = 16_000_000
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb ml cl l s ms min h hr hrs sec secs second seconds minute minutes hour hours day days week weeks month months year years metre metres meter meters kilometre kilometres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters dollar dollars euro euros cent cents percent degrees mph kph km/h m/s kwh kw w v hz".split())
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
NUMBER_UNIT = re.compile(r"([$€£]?[+-]?\d[\d.,]*)([A-Za-z/]+)")
WORDLIKE, NUM, NAME, UNIT, NUM_UNIT, NOTHING = range(6)


BLANK_, WORD_, FRONT_, ALPHA_, UPPER_, LOWER_, STOP_, COLON_, CLOSE_ = (1 << k for k in range(9))
CODE_POINTS = 0x30000


@lru_cache(maxsize=1)
def _chars() -> tuple[np.ndarray, np.ndarray]:
    """(classes as bits, lower case) of the code points below 0x30000; higher ones are symbols without case."""

    def bits(c: str) -> int:
        word = c.isalnum() or c in "_%"
        kinds = ((c in BLANK, BLANK_), (word, WORD_), (word or c in "$€£", FRONT_), (c.isalpha(), ALPHA_), (c.isupper(), UPPER_), (c.islower(), LOWER_), (c in ".!?", STOP_), (c == ":", COLON_), (c in ')"', CLOSE_))
        return sum(bit for yes, bit in kinds if yes)

    every = [chr(k) for k in range(CODE_POINTS - 1)]
    return np.array([*map(bits, every), 0], np.uint16), np.array([*(ord(c.lower()[0]) for c in every), 0], np.uint32)


BASE = 0x9E3779B97F4A7C15


class Tokens:
    """Words of a text as arrays, without a Python step for each word. A word's hash is a polynomial in
    its lower-cased code points, taken from running sums by the base's inverse modulo 2^64."""

    def __init__(self):
        self.chars = _chars()
        self.powers = self.inverses = np.ones(1, np.uint64)
        self._room(1 << 14)
        self.units = np.zeros(1, np.uint64)
        self.units = np.sort(self.of(" ".join(UNITS))[0])

    def _room(self, n: int) -> None:
        if n > len(self.powers):
            k = np.full(2 * n, BASE, np.uint64), np.full(2 * n, pow(BASE, -1, 1 << 64), np.uint64)
            k[0][0] = k[1][0] = 1
            self.powers, self.inverses = np.cumprod(k[0]), np.cumprod(k[1])

    def of(self, text: str):
        """(hashes, kinds as if inside a sentence, ends a sentence, first and last place of each core)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        self._room(n + 1)
        classes, lowered = self.chars
        high = n and points.max() >= CODE_POINTS
        at = np.minimum(points, CODE_POINTS - 1) if high else points
        kind = classes[at]
        solid = np.zeros(n + 2, bool)
        np.equal(kind & BLANK_, 0, out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), starts, ends)
        fronts, backs = np.flatnonzero(kind & FRONT_), np.flatnonzero(kind & WORD_)
        lo = np.append(fronts, n)[np.searchsorted(fronts, starts)]
        hi = np.append(backs, -1)[np.searchsorted(backs, ends) - 1] + 1
        none = (lo >= hi) | (lo >= ends) | (hi <= starts)
        lo, hi = np.where(none, starts, lo), np.where(none, starts, hi)
        low = lowered[at]
        if high:
            low = np.where(points < CODE_POINTS, low, points)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(low * self.powers[:n], out=sums[1:])
        hashes = mix((sums[hi] - sums[lo]) * self.inverses[lo])
        cased = np.zeros(n + 1, np.int64)  # upper and lower counts in one sum
        np.cumsum(((kind & UPPER_) > 0) * np.int64(1 << 32) + ((kind & LOWER_) > 0), out=cased[1:])
        inner = cased[hi] - cased[np.minimum(lo + 1, hi)]
        name = ((kind[lo] & UPPER_) > 0) & (inner > 0) & (inner < 1 << 32)
        kinds = np.where(name, NAME, WORDLIKE).astype(np.int8)
        kinds[self.units[np.minimum(np.searchsorted(self.units, hashes), len(self.units) - 1)] == hashes] = UNIT
        kinds[none] = NOTHING
        for k in np.flatnonzero(~none & ((kind[lo] & ALPHA_) == 0)).tolist():  # numbers begin with a digit or a currency
            core = text[lo[k] : hi[k]]
            if NUMBER.fullmatch(core):
                kinds[k] = NUM
            elif (m := NUMBER_UNIT.fullmatch(core)) and m[2].lower() in UNITS:
                kinds[k] = NUM_UNIT
        last, before = kind[ends - 1], kind[np.maximum(ends - 2, 0)]
        done = ((last & (STOP_ | COLON_)) > 0) | (((last & CLOSE_) > 0) & ((before & STOP_) > 0) & (ends - starts > 1))
        return hashes, kinds, done, lo, hi


HOLES = {k: np.uint64(xxhash.xxh3_64_intdigest(f"<{k}>".encode())) for k in (NUM, NAME, UNIT)}


def template(text: str | None, tokens: Tokens, values: bool = False):
    """(hashes, is a placeholder) of a text's template; with ``values``, also each place's text.

    A unit is a placeholder only after a number, a name only inside a sentence; else both are words.
    """
    text = text or ""
    return _template(text, tokens.of(text), values)[:3]


def _template(text: str, found: tuple, values: bool = False):
    """Also the first and last word of each place; ``found`` is the text's ``Tokens.of``."""
    hashes, kinds, ends, lo, hi = found
    if not len(hashes):
        return hashes, np.zeros(0, bool), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = kinds.copy()
    joined = kinds == NUM_UNIT
    # line ends start sentences too, but a text may be re-wrapped: only punctuation counts
    first = np.concatenate([[True], ends[:-1]])
    kinds[(kinds == NAME) & first] = WORDLIKE
    after_number = np.concatenate([[False], kinds[:-1] == NUM])
    kinds[(kinds == UNIT) & ~after_number] = WORDLIKE
    word = np.cumsum(kinds != NOTHING) - 1
    at = np.flatnonzero(kinds != NOTHING)
    second = np.zeros(len(at), bool)
    if joined.any():  # 5kg is a number and a unit
        at = np.repeat(at, np.where(joined[at], 2, 1))
        second = np.concatenate([[False], at[1:] == at[:-1]])
    hashes, kinds = hashes[at], kinds[at]
    kinds[kinds == NUM_UNIT] = NUM
    kinds[second] = UNIT
    run = np.concatenate([[False], (kinds[1:] == NAME) & (kinds[:-1] == NAME)]) if len(kinds) else np.zeros(0, bool)
    hole = kinds != WORDLIKE
    for k, h in HOLES.items():
        hashes[kinds == k] = h
    texts: list[str] = []
    if values:
        for place, extra, same in zip(at.tolist(), second.tolist(), run.tolist()):
            core = text[lo[place] : hi[place]].lower()
            if joined[place]:
                core = NUMBER_UNIT.fullmatch(core)[2 if extra else 1]
            if same:
                texts[-1] += " " + core
            else:
                texts.append(core)
    ends_run = np.concatenate([~run[1:], [True]]) if len(run) else run
    return hashes[~run], hole[~run], texts, word[at[~run]], word[at[ends_run]]


def literals(found: tuple) -> np.ndarray:
    """Hashes of the words as they are, but for their case. Where a window has no placeholder it is that of the template."""
    return found[0][found[1] != NOTHING]


def windows(hashes: np.ndarray, holes: np.ndarray | None = None, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows that have enough literal tokens (all of them without ``holes``).

    Without a ``width`` they are an item's: a shorter text is one window.
    """
    width = width or min(WIDTH, len(hashes))
    if not width or len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # a shorter item must not meet the windows of longer ones
    found = window_hashes(hashes, width) if width == WIDTH else mix(window_hashes(hashes, width) + np.uint64(width))
    if holes is None:
        return np.arange(len(found)), found
    literal = np.concatenate([[0], np.cumsum(~holes)])
    ok = literal[width:] - literal[:-width] >= min(LITERALS, width)
    return np.flatnonzero(ok), found[ok]


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found).view(np.int64)))


def _item_rows(items: DataFrame) -> DataFrame:
    """``item_id, irk, typed, plain, widths`` of each item: its windows' hashes and their widths."""

    def make():
        tokens = Tokens()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            typed, plain, widths = [], [], []
            for text in batch.column(2).to_pylist():
                found = tokens.of(text or "")
                t, w = _template(text or "", found), literals(found)
                typed.append(windows(*t[:2])[1])
                plain.append(windows(w)[1])
                widths.append([min(WIDTH, len(t[0])), min(WIDTH, len(w))])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(typed), _lists(plain), pa.array(widths, pa.list_(pa.int32()))], ["item_id", "irk", "typed", "plain", "widths"])

        return f

    return by_batch(items.select("item_id", "irk", "text"), make, "item_id long, irk long, typed array<long>, plain array<long>, widths array<int>")


def _doc_rows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """``doc_id, rk, hashes``: the distinct windows of each text, of both kinds and all ``widths``."""

    def make():
        tokens = Tokens()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column(2).to_pylist():
                found = tokens.of(text or "")
                hashes, holes = _template(text or "", found)[:2]
                w = literals(found)
                out.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *[x for k in widths for x in (windows(hashes, holes, k)[1], windows(w, None, k)[1])]])))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out)], ["doc_id", "rk", "hashes"])

        return f

    return by_batch(docs.select(F.col("doc_id").cast("long"), row_key("text").alias("rk"), "text"), make, "doc_id long, rk long, hashes array<long>")


def _shifts(item: tuple, doc: tuple) -> dict[int, list[int]]:
    """For each shift of the item against the document, the starts of the item's windows found there."""
    wanted = set(item[1].tolist())
    where: dict[int, list[int]] = defaultdict(list)
    for s, h in zip(doc[0].tolist(), doc[1].tolist()):
        if h in wanted:
            where[h].append(s)
    shifts: dict[int, list[int]] = defaultdict(list)
    for s, h in zip(item[0].tolist(), item[1].tolist()):
        for d in where[h]:
            shifts[d - s].append(s)
    return shifts


def agreement(doc: str | None, item: str | None, tokens: Tokens) -> tuple[int, int, int, bool]:
    """(the item's windows, those in the document, those that agree in their slots or word by word, all values are the item's).

    The windows are the template's, or the words' where more of these are found.
    """
    dfound, ifound = tokens.of(doc or ""), tokens.of(item or "")
    dh, dholes, dvalues, _, _ = _template(doc or "", dfound, values=True)
    ih, iholes, ivalues, first, last = _template(item or "", ifound, values=True)
    dw, iw = literals(dfound), literals(ifound)
    typed, plain = windows(ih, iholes), windows(iw)
    width, plain_width = min(WIDTH, len(ih)), min(WIDTH, len(iw))
    # one shift of the item against the document for each copy of it; the best copy counts
    same = max(_shifts(plain, windows(dw, None, plain_width)).values(), key=len, default=[]) if plain_width else []
    held = set(same)
    literal = {s for s in typed[0].tolist() if held and all(k in held for k in range(first[s], max(first[s], last[s + width - 1] - plain_width + 1) + 1))}
    best = (len(literal), len(literal), True)
    for shift, starts in (_shifts(typed, windows(dh, dholes, width)) if width else {}).items():
        slots = sorted({p for s in starts for p in range(s, s + width) if iholes[p]})
        there, back = defaultdict(Counter), defaultdict(Counter)
        for p in slots:
            there[ivalues[p]][dvalues[p + shift]] += 1
            back[dvalues[p + shift]][ivalues[p]] += 1
        usual = lambda votes, key, value: votes[key].most_common(1)[0][0] == value
        # two values of the item must not have become one either: 3 + 5 is no 4 + 4
        bad = {p for p in slots if not (usual(there, ivalues[p], dvalues[p + shift]) and usual(back, dvalues[p + shift], ivalues[p]))}
        agree = literal.union(s for s in starts if not any(p in bad for p in range(s, s + width)))
        best = max(best, (len(agree), len(literal.union(starts)), all(ivalues[p] == dvalues[p + shift] for p in slots)))
    if len(same) * len(typed[0]) > best[0] * len(plain[0]) or not len(typed[0]):
        return len(plain[0]), len(same), len(same), True
    return len(typed[0]), best[1], best[0], best[2]


def left_out(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``item_id, text, n_words`` of the items that ``leaks`` doesn't search for: those of fewer than ``least_words`` words, empty ones too."""
    items = benchmark.select(F.col("item_id").cast("long"), row_key("text").alias("irk"), "text").distinct()
    words = _item_rows(items).select("item_id", "irk", F.coalesce(F.get("widths", F.lit(1)), F.lit(0)).alias("n_words")).filter(F.col("n_words") < least_words)
    return items.join(words.withColumnsRenamed({"item_id": "_item_id", "irk": "_irk"}), _same("item_id", "irk")).select("item_id", "text", "n_words")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, rk, item_id, n_windows, n_matched, n_agreeing, coverage, verbatim`` of every leak.

    ``benchmark``: item_id, text. Null and empty texts have no windows and leak nothing. An
    item of fewer than 8 tokens is one window, and leaks wherever that is in a document. One of fewer than ``least_words`` words stands in
    ordinary texts by chance, so it is no evidence and leaks nothing (``left_out`` lists these). Windows of mostly
    placeholders count only with the item's own values. Equal rows of a table are one. A null doc_id or item_id
    is a key like another. Empty tables give an empty result. Other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), row_key("text").alias("irk"), "text").distinct()
    own = cut(_item_rows(items).filter(F.get("widths", F.lit(1)) >= least_words))
    widths = sorted(r.w for r in own.select(F.explode("widths").alias("w")).distinct().collect() if r.w)  # 8 at most
    kind = lambda c, plain: own.select("item_id", "irk", F.size("typed").alias("n_typed"), F.size("plain").alias("n_plain"), F.explode(c).alias("hash"), F.lit(plain).alias("plain"))
    wanted = kind("typed", False).unionAll(kind("plain", True))
    wanted = cut(wanted.groupBy("item_id", "irk", "n_typed", "n_plain", "hash", "plain").agg(F.count("*").alias("times")))
    found = _doc_rows(docs, widths).select("doc_id", "rk", F.explode("hashes").alias("hash"))
    hashes = wanted.select("hash").distinct()
    small = wanted.count() <= BROADCAST_WINDOWS
    found = cut(found.join(F.broadcast(hashes) if small else hashes, "hash", "left_semi").distinct())
    count = lambda plain: F.sum(F.when(F.col("plain") == plain, F.col("times")).otherwise(0))
    shared = found.join(F.broadcast(wanted) if small else wanted, "hash").groupBy("doc_id", "rk", "item_id", "irk", "n_typed", "n_plain").agg(count(False).alias("t"), count(True).alias("p"))
    # windows can agree only where they are shared; a word starts two of the template's tokens at most (5kg)
    pairs = cut(shared.filter((F.col("t") + 2 * F.col("p") >= share * F.col("n_typed")) & (F.col("n_typed") > 0) | (F.col("p") >= share * F.col("n_plain"))).select("doc_id", "rk", "item_id", "irk"))
    texts = docs.select(F.col("doc_id").cast("long"), row_key("text").alias("rk"), "text").join(_sized(pairs.select("doc_id", "rk").distinct()), _same("doc_id", "rk"), "left_semi").distinct()
    asked = items.withColumnRenamed("text", "item")
    both = pairs.join(texts, _on(pairs, texts, "doc_id", "rk")).select(pairs["doc_id"], pairs["rk"], pairs["item_id"], pairs["irk"], "text")
    brief = (asked.agg(F.sum(F.length("item"))).first()[0] or 0) <= BROADCAST_TEXT
    both = both.join(F.broadcast(asked) if brief else asked, _on(both, asked, "item_id", "irk")).select("doc_id", both["item_id"], "rk", "text", "item")

    def make():
        tokens = Tokens()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [agreement(d, i, tokens) for d, i in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            n, matched, agree, verbatim = map(list, zip(*found))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(matched, pa.int64()), pa.array(agree, pa.int64()), pa.array(verbatim)], ["doc_id", "item_id", "rk", "n_windows", "n_matched", "n_agreeing", "verbatim"])

        return f

    out = by_batch(both, make, "doc_id long, item_id long, rk long, n_windows long, n_matched long, n_agreeing long, verbatim boolean")
    return out.withColumn("coverage", F.col("n_agreeing") / F.col("n_windows")).filter(F.col("coverage") >= share)


def _sized(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("_doc_id"), F.col("rk").alias("_rk"))
    return F.broadcast(ids) if ids.count() <= most else ids


def _same(*columns: str):
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]


def _on(a: DataFrame, b: DataFrame, *columns: str):
    return [a[c].eqNullSafe(b[c]) for c in columns]


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "n_agreeing", "coverage", "verbatim")
