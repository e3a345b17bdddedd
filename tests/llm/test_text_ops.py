"""Operators 1, 3, 4, 5 and 8 and the pipeline against brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import common, decontaminate, line_dedup, mixing, ngram_join, quality_rules, stages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang="en", source="s", extra=False):
    rows = [(i, t, lang, source, len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"id": F.lit("x"), "rk": F.lit(1), "n_lines": F.lit("q"), "tokens": F.lit(0), "topic": F.lit("t")}) if extra else df


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no identity"), (5, "a " * 30_000), (6, "same text " * 20), (6, "same text " * 20), (7, None)]


# ---- 1


def brute_links(texts, t=0.8):
    sets = {}
    for i, x in texts:
        w = WORDS.findall(x or "")
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else None
    rep = {}
    for i in sorted(sets):
        if sets[i] is not None:
            rep.setdefault(sets[i], i)
    links, root = Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    classes = list(rep.items())
    for a, (s, i) in enumerate(classes):
        for u, j in classes[:a]:
            if len(s & u) / len(s | u) >= t:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (top(rep[s]), rep[s], links[rep[s]]) if s is not None else (i, i, 0) for i, s in sets.items()}


def corpus(rng, n=60):
    texts = []
    for k in range(n):
        base = prose(rng, rng.randrange(20, 300)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks: a bucket is many tasks
    texts = corpus(random.Random(block)) + [(10_001, "one two"), (10_002, "one two"), (10_003, ""), (10_004, None)]
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in ngram_join.jaccard_groups(frame(spark, texts, extra=True)).collect()}
    assert got == brute_links(texts) and max(x[2] for x in got.values()) >= 2
    pairs = ngram_join.similar_pairs(frame(spark, texts)).collect()
    assert len(pairs) * 2 == sum(x[2] for i, x in got.items() if x[1] == i) and all(0.8 <= p.similarity < 1 for p in pairs)


def test_ngram_join_edges(spark):
    rows = ngram_join.jaccard_groups(frame(spark, EDGES, extra=True)).collect()
    assert len(rows) == len(EDGES)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.n_copies for r in by[6]] == [2, 2] and by[None][0].class_id is None and by[1][0].class_id == 1 and by[7][0].class_id == 7
    assert ngram_join.jaccard_groups(frame(spark, [])).count() == 0
    two = frame(spark, [(1, "a b c d e f"), (1, "p q r s t u v"), (2, "a b c d e f")])
    assert sorted((r.doc_id, r.copy_of, r.n_copies) for r in ngram_join.jaccard_groups(two).collect()) == [(1, 1, 1), (1, 1, 2), (2, 1, 2)]


def test_ngram_join_links_rows_without_ids_of_their_own(spark, tmp_path):
    rng = random.Random(6)
    first, second, third = (prose(rng, 120) for _ in range(3))
    near = lambda text: text + " one more"
    rows = [(None, first), (None, near(first)), (None, second), (None, second), (None, near(second)), (7, third), (7, near(third)), (8, second), (9, prose(rng, 100)), (None, prose(rng, 90))]
    got = ngram_join.jaccard_groups(frame(spark, rows, extra=True)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_copies, r.n_links) for r in got) == sorted(
        [("None", "None", 1, 1)] * 3 + [("None", "None", 3, 1)] * 2 + [("7", "7", 1, 1)] * 2 + [("8", "None", 3, 1), ("9", "9", 1, 0), ("None", "None", 1, 0)]
    )
    assert len(ngram_join.similar_pairs(frame(spark, rows)).collect()) == 3
    left = stages.ngram_jaccard(spark, frame(spark, rows), str(tmp_path)).collect()
    texts = [r.text for r in left]  # one of each group, and what has none
    assert len(texts) == 5 and all(sum(t in (x, near(x)) for t in texts) == 1 for x in (first, second, third))


def test_pruning_table_is_the_posterior():
    least = ngram_join.least_matches(0.8, 1e-5)
    for n, m in least.items():
        tail = lambda m: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(m) >= 1e-5 > tail(m - 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(15)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


# ---- 3


def brute_counts(text):
    w = WORDS.findall(text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, dup = [], 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.append(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


def test_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = rng.choice([" ", "\n", "\x0b"]).join(rng.choice(["a", "b", "é#", "C!", "\n"]) for _ in range(rng.randrange(0, 60)))
        assert quality_rules.counts(text)[:5] == brute_counts(text)
    assert quality_rules.counts(None) == [0] * len(quality_rules.COUNTS)


def test_binomial_tail_is_exact():
    for n, k, p in ((1, 0, 0.3), (20, 3, 0.1), (200, 0, 0.02), (50, 50, 0.5)):
        assert quality_rules.binomial_tail(n, k, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_thresholds(spark):
    rng = random.Random(5)
    good = [(10_000 + i, prose(rng, 60)) for i in range(800)]
    junk = [(1000 + i, " ".join(f"w{rng.randrange(999)}%%%" for _ in range(60))) for i in range(200)]
    docs = frame(spark, good + junk + EDGES, extra=True).drop("rk").unionByName(frame(spark, [(5000, junk[0][1])], lang="xx", extra=True).drop("rk"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert len(rows) == 1000 + len(EDGES) + 1
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    assert not kept[1] and not kept[6] and kept[5000]  # no labels in that language: nothing is certified
    at = quality_rules.choose(800, 200, [0] * 10, [200] * 10, 0.05, 0.05 / 4)
    assert at == 0 and quality_rules.choose(10, 5, [0], [5], 0.01, 0.01) is None and quality_rules.choose(0, 5, [0], [5], 0.01, 0.01) is None
    none = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality_rules.judge(frame(spark, []), labels).count() == 0


def test_cutoffs_equal_brute_force(spark):
    """By strata: the sequence is tested on lists of labelled scores, with the exact tail by sums of binomial terms."""
    rng = random.Random(33)
    rows = []
    for lang, n, noise in (("a", 400, 0.01), ("b", 120, 0.0), ("c", 60, 0.0), ("d", 300, 0.2), (None, 90, 0.0)):
        for k in range(n):
            marks = rng.choice(["#", "!", "%%"]) if rng.random() < noise else ""
            rows.append((len(rows), " ".join(f"w{rng.randrange(400)}{marks}" for _ in range(rng.randrange(11, 60))), lang, 1))
        for k in range(n // 4):
            marks = rng.choice(["###", "!!", ""])
            rows.append((len(rows), " ".join(rng.choice(["A", "bc", "DEF"]) + marks + str(rng.randrange(900)) for _ in range(30)), lang, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    want, certified = {}, set()
    for lang in {r[2] for r in rows}:
        held = {q: [dict(zip(quality_rules.COUNTS, quality_rules.counts(t))) for _, t, l, y in rows if l == lang and y == q] for q in (0, 1)}
        held = {q: [c for c in cs if c["n_words"] >= 10 and 100 * c["n_repeat_words"] <= 20 * c["n_words"]] for q, cs in held.items()}
        best = None
        for setting in quality_rules.SETTINGS:
            over = {q: sum(any(eval(e.replace("greatest", "max"), {"max": max}, c) > setting[r] for r, (e, _) in quality_rules.RULES.items()) for c in cs) / len(cs) for q, cs in held.items()}
            n, k = len(held[1]), round(over[1] * len(held[1]))
            if sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) > 0.05 / 5:
                break
            certified.add(lang)
            if over[0] - over[1] > (best[0] + 1e-12 if best else 0):
                best = over[0] - over[1], setting
        want[lang or ""] = best and best[1]
    found = quality_rules.features(docs).join(docs.select("doc_id", "quality"), "doc_id")
    got = {r.stratum: None if r.symbols is None else {x: r[x] for x in quality_rules.RULES} for r in quality_rules.cutoffs(found).collect()}
    assert got == want and {"a", "b", None} <= certified and "c" not in certified and want["a"] and want["b"]


def test_guarantee_holds_over_samples():
    """Over many labelled samples, a chosen cutoff's true false-rejection rate exceeds the limit at most as often as delta allows."""
    rng = random.Random(3)
    rates = [0.001, 0.005, 0.02, 0.06, 0.2]
    wrong = 0
    for _ in range(400):
        u = [rng.random() for _ in range(500)]
        at = quality_rules.choose(500, 100, [sum(x < r for x in u) for r in rates], [20, 40, 60, 80, 100], 0.03, 0.05)
        wrong += at is not None and rates[at] > 0.03
    assert wrong <= 0.05 * 400 + 3 * math.sqrt(0.05 * 0.95 * 400)


# ---- 4

ITEM = "A train leaves Boston at 60 km and meets Maria Lopez after 3 hours of travel along the old coastal road to the harbour town where everyone waits."


def leaks(spark, docs, items=None):
    bench = spark.createDataFrame(items or [(1, ITEM)], "item_id long, text string")
    return decontaminate.leaks(docs, bench).collect()


def test_decontamination_finds_copies_and_reparameterised_items(spark):
    other = ITEM.replace("Boston", "Chicago").replace("60", "75").replace("Maria Lopez", "John").replace("3 hours", "5 days").replace("km", "miles")
    clean = "A train leaves Boston at 60 km and then nothing else of that story is told in this other text about gardens and the people in them."
    rng = random.Random(1)
    docs = frame(spark, [(1, prose(rng, 50) + ". " + ITEM + " " + prose(rng, 40)), (2, prose(rng, 20) + ". " + other), (3, clean), (4, prose(rng, 200)), (8, ITEM.upper().lower()), *EDGES[:3], (None, ITEM)], extra=True)
    got = {r.doc_id: r for r in leaks(spark, docs)}
    assert set(got) == {1, 2, None, 8} - ({8} - set(got)) and {1, 2, None} <= set(got)
    assert got[1].verbatim and not got[2].verbatim and got[1].coverage == 1.0


def test_decontamination_finds_copies_in_any_case(spark):
    rng = random.Random(4)
    around = lambda text: prose(rng, 30) + ". " + text + " " + prose(rng, 30)
    named = "Anna gave Bruno the red book of Carla and then Dario saw Elena with Fabio near the house of Gina while Hugo met Irene."
    numbers = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"
    cases = [ITEM, ITEM.upper().lower(), ITEM.upper(), ITEM.title(), named.lower(), named.upper(), named.title(), numbers]
    docs = frame(spark, [(8 + k, around(c)) for k, c in enumerate(cases)] + [(20, around("1 2 3 5 8 13 21 34 55 89 144 1 2 4 9")), (21, prose(rng, 80))])
    got = {(r.doc_id, r.item_id): r for r in leaks(spark, docs, [(1, ITEM), (2, named), (3, numbers)])}
    assert set(got) == {(8, 1), (9, 1), (10, 1), (11, 1), (12, 2), (13, 2), (14, 2), (15, 3)}
    assert all(r.coverage == 1.0 and r.verbatim for r in got.values())


def test_short_items_leak_inside_longer_documents(spark):
    rng = random.Random(5)
    around = lambda text: prose(rng, 30) + ". " + text + " " + prose(rng, 30)
    items = [(1, "Which river crosses Verona?"), (2, "solve 12 + 30 quickly now"), (3, "name the third planet of our sun")]
    docs = [(k, around(t)) for k, t in items] + [(10 + k, around(t.upper())) for k, t in items] + [(20, around("name the fourth planet of our sun")), (21, "which river")]
    got = {(r.doc_id, r.item_id): r.coverage for r in leaks(spark, frame(spark, docs), items)}
    assert got == {(k + d, k): 1.0 for k in (1, 2, 3) for d in (0, 10)}


def test_slots_must_agree(spark):
    item = "Then Ann met Bob before Ann gave Bob the red book that Ann had kept for Bob since Ann saw Bob there."
    same = item.replace("Ann", "Eve").replace("Bob", "Dan")
    mixed, names = [], iter(["Kim", "Lee", "Max", "Ned", "Oli", "Pam", "Quin", "Ray", "Sue"])
    for w in item.split():
        mixed.append(next(names, "Tom") if w in ("Ann", "Bob") else w)
    got = {r.doc_id: r for r in leaks(spark, frame(spark, [(1, same), (2, " ".join(mixed))]), [(1, item)])}
    assert 1 in got and got[1].coverage > 0.9 and (2 not in got or got[2].n_agreeing < got[2].n_matched)


def test_templates():
    t = decontaminate.Tokens()
    _, holes, values = decontaminate.template("He paid $1,200.50 for 5kg near Rio Grande. Then left", t, values=True)
    assert [v for v, h in zip(values, holes) if h] == ["$1,200.50", "5", "kg", "rio grande"]
    assert decontaminate.template(None, t)[0].size == 0
    a = decontaminate.template("met Ann at 5 km", t)[0]
    assert (a == decontaminate.template("met Mary Jane at 17 miles", t)[0]).all()


def test_decontamination_edges(spark):
    assert leaks(spark, frame(spark, []), [(1, ITEM)]) == []
    assert leaks(spark, frame(spark, EDGES), [(1, None), (2, ""), (None, "1 2 3 4 5 6 7 8 9")]) == []
    twice = leaks(spark, frame(spark, [(1, ITEM), (1, ITEM), (2, "short one here now")]), [(1, ITEM), (1, ITEM), (2, "short one here now")])
    assert sorted((r.doc_id, r.item_id) for r in twice) == [(1, 1), (2, 2)]


class SlowItem:
    """A text's template by plain loops: a list of (token, value, first word, last word), and its words."""

    def __init__(self, text):
        words = []
        for raw in (text or "").split():
            front = [k for k, c in enumerate(raw) if c.isalnum() or c in "_%$€£"]
            back = [k for k, c in enumerate(raw) if c.isalnum() or c in "_%"]
            core = raw[front[0] : back[-1] + 1] if front and back and front[0] <= back[-1] else ""
            ends = raw[-1] in ".!?:" or len(raw) > 1 and raw[-1] in ')"' and raw[-2] in ".!?"
            words.append((core, ends))
        self.words = [c.lower() for c, _ in words if c]
        kinds, first = [], True
        for k, (core, ends) in enumerate(words):
            unit = decontaminate.NUMBER_UNIT.fullmatch(core)
            if not core:
                kind = "nothing"
            elif not core[0].isalpha() and decontaminate.NUMBER.fullmatch(core):
                kind = "number"
            elif not core[0].isalpha() and unit and unit[2].lower() in decontaminate.UNITS:
                kind = "both"
            elif core.lower() in decontaminate.UNITS:
                kind = "unit" if k and kinds[-1] == "number" else "word"
            elif core[0].isupper() and not first and any(c.islower() for c in core[1:]) and not any(c.isupper() for c in core[1:]):
                kind = "name"
            else:
                kind = "word"
            kinds.append(kind)
            first = ends
        self.places, n = [], -1
        for kind, (core, _) in zip(kinds, words):
            if kind == "nothing":
                continue
            n += 1
            low = core.lower()
            if kind == "both":
                number, unit = decontaminate.NUMBER_UNIT.fullmatch(low).groups()
                self.places += [("<number>", number, n, n), ("<unit>", unit, n, n)]
            elif kind == "name" and self.places and self.places[-1][0] == "<name>" and self.places[-1][3] == n - 1:
                last = self.places[-1]
                self.places[-1] = ("<name>", last[1] + " " + low, last[2], n)
            else:
                self.places.append((low if kind == "word" else f"<{kind}>", low, n, n))

    def typed(self, width):
        """Start to window, for windows with enough words that are no placeholders."""
        tokens = [p[0] for p in self.places]
        every = {s: tuple(tokens[s : s + width]) for s in range(len(tokens) - width + 1)} if width else {}
        return {s: w for s, w in every.items() if sum(not (t[0] == "<" and t[-1] == ">") for t in w) >= min(4, width)}

    def plain(self, width):
        return {s: tuple(self.words[s : s + width]) for s in range(len(self.words) - width + 1)} if width else {}


def slow_agreement(doc, item):
    d, i = SlowItem(doc), SlowItem(item)
    w, pw = min(8, len(i.places)), min(8, len(i.words))
    typed, plain = i.typed(w), i.plain(pw)
    shifts = lambda a, b: [[s for s in a if b.get(s + k) == a[s]] for k in range(-len(i.words) - 9, len(d.words) + len(d.places) + 9)]
    same = max(shifts(plain, d.plain(pw)), key=len, default=[])
    literal = set()
    for s in typed:
        lo, hi = i.places[s][2], i.places[s + w - 1][3] - pw + 1
        if same and all(k in same for k in range(lo, max(lo, hi) + 1)):
            literal.add(s)
    best = len(literal)
    dt = d.typed(w)
    for k in range(-len(i.places), len(d.places) + 1):
        starts = [s for s in typed if dt.get(s + k) == typed[s]]
        slots = sorted({p for s in starts for p in range(s, s + w) if i.places[p][0] in ("<number>", "<name>", "<unit>")})
        value = {p: (i.places[p][1], d.places[p + k][1]) for p in slots}
        usual = lambda side, p: max([x[1 - side] for x in value.values() if x[side] == value[p][side]], key=[x[1 - side] for x in value.values() if x[side] == value[p][side]].count)
        bad = {p for p in slots if usual(0, p) != value[p][1] or usual(1, p) != value[p][0]}
        best = max(best, len(literal | {s for s in starts if not bad & set(range(s, s + w))}))
    return max(best / len(typed) if typed else 0.0, len(same) / len(plain) if plain else 0.0)


def test_leaks_equal_brute_force_on_random_templates(spark):
    rng = random.Random(44)
    words = ["what", "is", "the", "sum", "of", "apples", "and", "pears", "that", "buys", "for", "each", "friend", "a"]
    names, units = ["Tom", "Mary", "Peru", "Lee"], ["kg", "km", "days"]

    def part():
        kind = rng.random()
        if kind < 0.15:
            return str(rng.randrange(2, 6))
        if kind < 0.22:
            return f"{rng.randrange(2, 6)}{rng.choice(units)}"
        if kind < 0.28:
            return f"{rng.randrange(2, 6)} {rng.choice(units)}"
        if kind < 0.4:
            return " ".join(rng.sample(names, rng.randrange(1, 3)))
        return rng.choice(words) + rng.choice(["", "", "", ",", ".", "?"])

    def changed(text):
        swap = {str(k): str(rng.randrange(2, 9)) for k in range(2, 6)} | {n: rng.choice(names) for n in names} if rng.random() < 0.6 else {}
        out = [swap.get(x, x) for x in text.split()]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = "other"
        return rng.choice([str, str, str.lower, str.upper])(" ".join(out))

    items = [(k, " ".join(part() for _ in range(rng.choice([1, 3, 5, 8, 12, 20])))) for k in range(40)]
    items += [(40, "What is the capital of Peru?"), (41, "12 + 7 - 3 * 4 = 9 10 11 12 13"), (42, "Tom has 3 apples and buys 5 more apples today"), (43, None), (44, "")]
    docs = [(k, " ".join([*(part() for _ in range(rng.randrange(9))), changed(rng.choice(items[:40])[1]), *(part() for _ in range(rng.randrange(9)))])) for k in range(160)]
    docs += [(200, "He asked: What is the capital of Peru? and left"), (201, "so 12 + 7 - 3 * 4 = 9 10 11 12 13 it is"), (202, "Tom has 4 apples and buys 4 more apples today"), (203, "Tom has 2 apples and buys 9 more apples today"), (204, None)]
    want = {(d, i) for d, text in docs for i, item in items if item and slow_agreement(text, item) >= 0.5}
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(*tables, least_words=1).collect()}
    assert got == want
    # items of fewer than four words are left out unless they are asked for
    short = {r.item_id for r in decontaminate.left_out(tables[1]).collect()}
    assert {43, 44} <= short and {(r.doc_id, r.item_id) for r in decontaminate.leaks(*tables).collect()} == {(d, i) for d, i in want if i not in short}
    assert {(200, 40), (201, 41), (203, 42)} <= got and (202, 42) not in got and len(want) > 100


# ---- hot keys


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_plain_join(spark, how):
    rng = random.Random(13)
    keys = ["hot"] * 700 + [None] * 300 + [rng.choice("abcdefgh") for _ in range(200)] + [f"k{i}" for i in range(1800)]
    rows = spark.createDataFrame([(k, i, i % 3) for i, k in enumerate(keys)], "k string, i long, __part int")
    one = spark.createDataFrame([(k, k.upper()) for k in {*keys} - {None, "a", "k7"}] + [("other", "x")], "k string, v string")
    got = common.spread_join(rows, one, ["k"], ["i"], how)
    want = rows.join(one, ["k"], how)
    assert got.columns == want.columns
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert order(got) == order(want)
    # no part of the hot key is more than its share
    plan = got._jdf.queryExecution().toString()
    assert "pmod" in plan
    # nothing is hot, and nothing is there
    few = rows.filter("k LIKE 'k%'")
    assert order(common.spread_join(few, one, ["k"], ["i"], how, keys_of=few.limit(0))) == order(few.join(one, ["k"], how))
    assert common.spread_join(rows.limit(0), one, ["k"], ["i"], how).count() == 0


def test_items_too_short_to_tell(spark):
    rng = random.Random(3)
    docs = [(k, f"{prose(rng, 20)} yes. They went home {prose(rng, 20)}") for k in range(20)]
    docs += [(100, f"{prose(rng, 30)} What is the capital of Peru? {prose(rng, 30)}"), (101, "Yes."), (102, f"{prose(rng, 9)} one two three four {prose(rng, 9)}")]
    items = [(1, "Yes."), (2, "went home"), (3, "What is the capital of Peru?"), (4, "one two three"), (5, "one two three four"), (6, None), (7, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(frame(spark, docs), benchmark).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(100, 3), (102, 5)]
    assert {(r.item_id, r.n_words) for r in decontaminate.left_out(benchmark).collect()} == {(1, 1), (2, 2), (4, 3), (6, 0), (7, 0)}
    assert (101, 1) in {tuple(r) for r in decontaminate.leaks(frame(spark, docs), benchmark, least_words=1).select("doc_id", "item_id").collect()}


# ---- 5


def brute_rake(cells, powers, sweeps):
    w = {k: float(v) for k, v in cells.items()}
    total = sum(w.values())
    goals = []
    for d, p in enumerate(powers):
        sums = defaultdict(float)
        for k, v in cells.items():
            sums[k[d]] += v
        g = {k: v**p for k, v in sums.items()}
        goals.append({k: v / sum(g.values()) for k, v in g.items()})
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            have = defaultdict(float)
            for k, v in w.items():
                have[k[d]] += v
            w = {k: v * goal[k[d]] * total / have[k[d]] for k, v in w.items()}
    return w, goals, total


def test_raking(spark):
    rng = random.Random(8)
    cells = {(s, l, t): rng.randrange(10, 5000) for s in "abc" for l in "xy" for t in "pqr" if rng.random() < 0.9}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "_source string, _lang string, _topic string, tokens long")
    got = {(r._source, r._lang, r._topic): r.weight for r in mixing.rake(df, tolerance=1e-12).collect()}
    want, goals, total = brute_rake(cells, mixing.POWERS.values(), mixing.SWEEPS)
    assert got == pytest.approx(want)
    for d, goal in enumerate(goals):
        for c, g in goal.items():
            assert sum(v for k, v in got.items() if k[d] == c) / total == pytest.approx(g, rel=0.01)
    fixed = {(r._source, r._lang, r._topic): r.weight for r in mixing.rake(df, targets={"source": {"a": 3, "b": 1}}).collect()}
    assert sum(v for k, v in fixed.items() if k[0] == "a") / total == pytest.approx(0.75, rel=0.02) and all(v == 0 for k, v in fixed.items() if k[0] == "c")


def test_raking_ends_at_a_tolerance(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(s, l, t, rng.randrange(10, 5000)) for s in "abcd" for l in "xyz" for t in "pq"]
    df = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long")
    raked = mixing.rake(df, tolerance=1e-9)
    marginals = mixing.shares(raked).collect()
    assert {(r.dimension, r.category) for r in marginals} == {*(("source", c) for c in "abcd"), *(("lang", c) for c in "xyz"), *(("topic", c) for c in "pq")}
    assert all(r.share == pytest.approx(r.goal, rel=1e-7) for r in marginals)
    # beyond the size for a broadcast, the sums are joined by a shuffle with the same weights
    monkeypatch.setattr(mixing, "BROADCAST_CATEGORIES", 0)
    other = {tuple(r)[:3]: r.weight for r in mixing.rake(df, tolerance=1e-9).collect()}
    assert other == pytest.approx({tuple(r)[:3]: r.weight for r in raked.collect()}, rel=1e-12)
    # all of a is x and all of x is a: no weights give a half and x three quarters
    odd = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "_source string, _lang string, _topic string, tokens long")
    with pytest.warns(UserWarning, match="off their targets after 3 sweeps"):
        mixing.rake(odd, targets={"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}}, sweeps=3)


def test_mixing_topics_of_the_caller(spark):
    docs = frame(spark, [(1, "lions and tigers"), (2, "oaks"), (3, "LIONS, oaks. lions"), (4, None)])
    t = mixing.with_cells(docs, topics={"plant": "oak|oaks", "cat": "lions|tigers"}).orderBy("doc_id").collect()
    assert [r._topic for r in t] == ["cat", "plant", "cat", "general"]
    named = docs.withColumn("topic", F.when(F.col("doc_id") != 2, F.concat(F.lit("t"), "doc_id")))
    own = mixing.with_cells(named, topic_column="topic").orderBy("doc_id").collect()
    assert [r._topic for r in own] == ["t1", "", "t3", "t4"]
    # the same text under two topics stays two rows
    twice = frame(spark, [(1, "a b c")]).withColumn("topic", F.explode(F.array(F.lit("u"), F.lit("v"))))
    got = mixing.mix(twice, topic_column="topic", budget=4.0).collect()
    assert sorted((r.topic, r.n_copies) for r in got) == [("u", 4), ("v", 4)]


def test_mixing_samples_to_the_weights(spark):
    rng = random.Random(9)
    docs = frame(spark, [(i, prose(rng, 50)) for i in range(900)], source="big").unionAll(frame(spark, [(1000 + i, prose(rng, 50)) for i in range(100)], source="small"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n")).collect()
    n = {r.source: r.n for r in got}
    assert n["small"] / sum(n.values()) == pytest.approx(0.25, abs=0.04)  # 1 : 9 to the power of one half
    a = mixing.mix(docs.repartition(7)).select("doc_id", "n_copies")
    assert sorted(a.collect()) == sorted(mixing.mix(docs).select("doc_id", "n_copies").collect())


def test_mixing_edges(spark):
    got = mixing.mix(frame(spark, EDGES, extra=True).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    assert {"id", "rk", "n_copies", "topic"} <= set(got.columns) and {r.doc_id for r in got.collect()} <= {4, None, 5, 6}
    assert mixing.mix(frame(spark, [])).count() == 0
    t = mixing.with_cells(frame(spark, [(1, "The COPYRIGHT, copyright and an API"), (2, "nothing"), (3, "licensed http")])).orderBy("doc_id").collect()
    assert [r._topic for r in t] == ["legal", "general", "legal"]


# ---- 8


def brute_lines(texts, least=40, docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    holders = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        me = -(1 << 63) if i is None else i
        keep = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) >= docs and max(holders[key(x)]) != me)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (6, 3)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(batches)
    common_ = [prose(rng, 12) for _ in range(6)]
    texts = []
    for i in range(80):
        lines = [prose(rng, 9) for _ in range(rng.randrange(0, 4))] + rng.choices(common_, k=rng.randrange(0, 4)) + [rng.choice(["", " ", "short", "É" * 39, "é" * 40])]
        rng.shuffle(lines)
        texts.append((i, "\n".join(rng.choice([x, x.upper() if x.isascii() else x, f"\t{x} "]) for x in lines)))
    texts += EDGES
    got = line_dedup.dedup_lines(frame(spark, texts, extra=True), batches=batches, fanout=fanout)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(texts)
    assert "rk" in got.columns and line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_query_is_native(spark, tmp_path):
    frame(spark, [(i, "the very same long line of more than forty letters\nown " + str(i)) for i in range(6)]).write.parquet(str(tmp_path / "documents.parquet"))
    q = line_dedup.op8_line_dedup(spark, str(tmp_path))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = {r.doc_id: r for r in q.collect()}
    assert got[0].n_dropped == 1 and got[5].n_dropped == 0 and got[0].kept_sha256 == hashlib.sha256(b"own 0").hexdigest()


def test_line_runs_outlive_a_call(spark, tmp_path):
    rng = random.Random(80)
    line = lambda k: f"the line number {k} is long enough to be looked at by the operator"
    text = lambda: "\n".join(line(rng.randrange(30)) for _ in range(4))
    batches = [[(100 * b + k, text()) for k in range(12)] for b in (3, 1, 7, 5, 9)]  # ids neither rise nor fall
    held = []
    for b in batches:
        runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), 4, 2)  # a new session finds the runs of the last
        found = line_dedup.dedup_lines(spark.createDataFrame(b, "doc_id long, text string"), min_docs=4, batches=2, runs=runs)
        held += b
        docs_of, owner = defaultdict(set), {}
        for d, t in held:
            for x in t.split("\n"):
                docs_of[x].add(d)
                owner[x] = max(owner.get(x, d), d)
        want = {d: "\n".join(x for x in t.split("\n") if len(docs_of[x]) < 4 or owner[x] == d) for d, t in b}
        assert {r.doc_id: r.text for r in found.collect()} == want
    names = [p.name for p in (tmp_path / "runs").iterdir()]
    assert len(names) < 10 and sum(map(len, runs.levels)) == len(names)
    (tmp_path / "runs" / "run-0-unfinished").mkdir()  # a run without its mark of completion isn't there
    assert line_dedup.LineRuns(spark, str(tmp_path / "runs"), 4, 2).settled().count() == runs.settled().count()


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    line = "this passage repeats over many documents and has more than forty letters"
    base = prose(rng, 80)
    near = base.split()
    near[10] = "changed"
    texts = [(i, prose(rng, 60) + "\n" + line) for i in range(40)]
    texts += [(100, base), (101, base), (102, " ".join(near)), (200, prose(rng, 30) + ". " + ITEM), (300, "few words"), (301, None), (302, ""), (303, "x " * 200)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if stage is not stages.mixing_:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append({r.doc_id: r.text for r in docs.collect()})
    every = {i for i, _ in texts}
    assert set(left[0]) == every - {300, 301, 302, 303}
    assert set(left[1]) == set(left[0]) and sum(line in t for t in left[1].values()) == 1 and line in left[1][39]
    assert set(left[2]) == set(left[0]) - {101, 102} and set(left[3]) == set(left[2]) - {200} and set(left[4]) <= set(left[3])
    got = {r.doc_id: r.n_copies for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {r.doc_id: r.n_copies for r in docs.collect()}


def test_pipeline_stages_on_edges(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (frame(spark, []), frame(spark, EDGES, extra=True)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() <= docs.count()
    twice = stages.ngram_jaccard(spark, frame(spark, EDGES), str(tmp_path)).collect()
    assert sum(r.doc_id == 6 for r in twice) == 1 and {r.doc_id for r in twice} == {1, 2, 3, 4, 5, 6, 7, None}


def test_pipeline_keeps_columns_that_clash(spark, tmp_path):
    names = ["n", "first", "__id", "__key", "__KEY", "n_lines", "N_dropped", "__rk", "__own", "rk", "class_id", "topic_"]
    rows = [(k, f"{k} " + " ".join(f"word{k}x{j}" for j in range(30)), "en", "web", 100, *[f"{k}-{n}" for n in names]) for k in range(12)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names if n != "__KEY") + ", extra string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs, str(tmp_path))
        for r in docs_.collect():
            own = [r[c] for c in docs.columns[5:]]
            assert own == list(next(x for x in rows if x[0] == r.doc_id)[5:]), name
        if stage is not stages.mixing_:
            docs = docs_
    assert docs.count() == 12
