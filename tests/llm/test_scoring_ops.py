"""Operators 11, 12 and 13 against brute force, held-out labels and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tickloom.llm import filter_audit, importance, toxicity

SCHEMA = "doc_id long, text string, source string"
EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "no identity at all", "b"), (None, "no identity at all", "b"), (5, "a " * 40_000, "b"), (6, "Same Text " * 20, "a"), (6, "Same Text " * 20, "a"), (7, "Same Text " * 20, None), (8, "É é Ça № x-y 10% ok", "")]


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta Iota Kappa é1 ñu".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("score", "rank", "part", "mask", "bits", "digest", "cells", "first", "step", "weight", "lexeme", "toxic", "__row", "__p", "h", "k0")})


# ---- 11


def scores(text, model=None):
    return toxicity.Scorer(model or toxicity.Model()).score(text)


def kinds(text):
    return [k for _, _, found, _ in scores(text)[1] for k in sorted(found.elements())]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("what an idiot", ["insult"]),
        ("you are such an idiot", ["targeted"]),
        ("you are not an idiot", ["negated"]),
        ("he isn't a moron", ["negated"]),
        ("she said that you are an idiot", ["reported"]),
        ("she said: you are not an idiot", ["reported"]),
        ("she said so. you idiot", ["targeted"]),
        ("not now. an idiot", ["insult"]),
        ("not a word about how much of an idiot", ["insult"]),
        ("i will kill you", ["threat"]),
        ("you, i will strangle", ["threat"]),
        ("kill the lights", []),
        ("never kill them", []),
        ("he said he would kill you", []),
        ("Du bist ein Trottel, du Trottel", ["targeted", "targeted"]),
        ("DISGUSTING### scum%%%", ["insult", "insult"]),
        ("idiotic", []),
    ],
)
def test_grammar(text, expected):
    assert kinds(text) == expected


def test_composition_equals_one_after_another():
    parts = [toxicity.reported(), toxicity.negated(), toxicity.targeted(), toxicity.threats(), toxicity.insults()]
    machine, rng = toxicity.grammar(), random.Random(5)
    for _ in range(300):
        state, states = 0, [0] * len(parts)
        for _ in range(40):
            x = y = rng.randrange(7)
            for k, part in enumerate(parts):
                states[k], y = part.arcs[states[k], y]
            state, kind = machine[state][x]
            assert kind == y


def test_clause_spans_and_order_of_weights():
    text = "Fine weather. You are an idiot! Bye"
    p, [(start, end, found, _)] = scores(text)
    assert text[start:end] == "You are an idiot" and found == Counter(targeted=1)
    order = [scores(x)[0] for x in ("you are an idiot", "see an idiot here", "she said he is an idiot", "the weather is fine")]
    assert order == sorted(order, reverse=True)
    # a chance match in a long text is no toxic text
    assert scores("idiot " + "word " * 3000)[0] < 0.1


def toxic_corpus(rng, n, toxic_share=0.25):
    """Toxic texts hold invented words of one stem with any ending; the stem is rare in clean ones."""
    plain = [f"{a}{b}" for a in ("ver", "lan", "sto", "mer", "tig", "olu", "pes", "kar", "dun", "fi") for b in ("a", "en", "ung", "isch", "lo", "tar", "e", "mu", "sk", "or")]
    ends = ["a", "en", "ung", "isch", "lo", "tar", "e", "mu", "sk", "or", "ix", "ba"]
    rows = []
    for i in range(n):
        toxic = rng.random() < toxic_share
        words = [rng.choice(plain) for _ in range(rng.randrange(40, 200))]
        for k in range(len(words)):
            if rng.random() < (0.04 if toxic else 0.0005):
                words[k] = "zwurg" + rng.choice(ends)
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_learned_lexicon_on_held_out_rows(spark):
    rows = toxic_corpus(random.Random(3), 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("held", toxicity.held_out())
    model = toxicity.fit(df.select("doc_id", "text"), df.filter("NOT held").select("doc_id", "toxic"))
    assert [x for x in model.lexemes if not x.endswith("$")] == ["zwurg"]
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    held = {r["doc_id"] for r in df.filter("held").collect()}
    assert held == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    right = Counter((t, found[i]) for i, _, t in rows if i in held)
    assert right[1, 1] / (right[1, 1] + right[0, 1]) > 0.9 and right[1, 1] / (right[1, 1] + right[1, 0]) > 0.85


def test_query_never_reads_held_out_labels(spark, tmp_path):
    rows = toxic_corpus(random.Random(4), 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for name, toxic in (("a", F.col("toxic")), ("b", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))):
        df.select("doc_id", "text").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        df.select("doc_id", toxic.alias("toxic"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    a, b = (sorted(map(tuple, toxicity.op11_toxicity(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == 400


def test_near_copies_are_no_evidence(spark):
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(400):03}x".replace("0", "o") for _ in range(300))
    copies = [(k, base + f" end{k}", 1) for k in range(30)]
    clean = [(100 + k, prose(rng, 80), 0) for k in range(60)]
    df = spark.createDataFrame(copies + clean, "doc_id long, text string, toxic int")
    sample = toxicity.fit_sample(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert sample.filter("toxic").count() <= 2 and sample.filter("NOT toxic").count() == 60


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    empty_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, empty_labels)
    assert model == toxicity.Model()
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 0), (6, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(clashing(docs), labels)
    out = toxicity.score(clashing(docs), model)
    got = out.select("doc_id", "score", "predicted").collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


# ---- 12


def brute_resample(docs, target, percent=5, min_words=20, buckets=10_000, order=3):
    def words(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def grams(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(x for _, d, _ in docs for x in grams(d)), Counter(x for d in target for x in grams(d))
    sum_s, sum_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum_s + buckets) / ((s[b] + 1) * (sum_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, d, _ in docs:
        f = grams(d)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, (r[:5] for r in rows)))


def test_resample_against_brute_force(spark):
    rng = random.Random(12)
    docs = [*EDGES, *((100 + k, prose(rng, rng.randrange(0, 90)), "s") for k in range(400)), *((700 + k, "one text for all of these rows, " * 5, "s") for k in range(60))]
    target = ["alpha beta gamma delta " * 10, None, "", prose(rng, 50)]
    goal = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    df = clashing(spark.createDataFrame(docs, SCHEMA)).repartition(7)
    for percent, min_words in ((5, 20), (40, 0)):
        got = importance.resample(df, goal, percent=percent, min_words=min_words)
        found = [[r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got.collect()]
        assert sorted(map(str, found)) == brute_resample(docs, target, percent, min_words)


def test_resample_of_empty_tables(spark):
    docs, none = spark.createDataFrame(EDGES, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, docs).count() == 0
    assert importance.resample(docs, none).count() == len(EDGES)


def test_ring_extends_running_states():
    words = [b"a", "é".encode(), b"a", b"b", b"10"]
    expected = [zlib.crc32(b" ".join(words[i - k : i + 1])) for i in range(5) for k in range(min(i, 3) + 1)]
    assert importance.ring(words, 4) == expected
    assert importance.words_of("It's A№1—b\x00C".encode()) == [w.encode() for w in ("it", "s", "a№1—b", "c")]


# ---- 13


def brute_audit(docs, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    bad = {i for i, q, t in labels if t == 1 and i is not None}
    fails = []
    for i, x, source in docs:
        text = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = set()
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        f |= {"D"} if re.search("[#$%&*|]", text) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (y or "") == text for j, y, _ in docs) else set()
        fails.append((source or "", i, f))
    rows = []
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        shapley, here = Counter(), []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                failing = sum(x in f for _, f in own)
                here.append(["".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)])
        rows += [(part, *r, shapley[r[0][r[1] - 1]]) for r in here]
    return sorted(rows)


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (7, 1, 1), (None, 1, 1), (150, 1, 0), (151, 0, 1), (999, 1, 1)]


def test_audit_against_brute_force(spark):
    rng = random.Random(13)
    texts = [prose(rng, rng.randrange(30, 80)) + rng.choice(["", "", " # ", " AAAAAAAAAAAAAAAAAAAAAAAA"]) for _ in range(25)]
    docs = [*EDGES, *((100 + k, rng.choice(texts), rng.choice(["a", "b", None])) for k in range(120))]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(clashing(spark.createDataFrame(docs, SCHEMA)), labels.withColumn("part", F.lit("x")))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == brute_audit(docs, LABELS)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame(EDGES, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit(docs, labels.limit(0)).collect())) == brute_audit(EDGES, [])


def test_audit_runs_no_python_on_executors(spark):
    docs, labels = spark.createDataFrame(EDGES, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = filter_audit.audit(docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
