"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed into one machine: reported speech, negation, target, threat and insult. Each rewrites the classes of a
clause's words: an insult after a verb of saying becomes a reported one, one in reach of a negation a negated one, one beside a
target a targeted one, and a word of violence becomes a threat only with its target. The composed machine gives each clause's matches with
their weights; words outside any match carry a small weight against toxicity, so a chance match in a long text does not make it toxic.
A document's score is the probability that the sum of its clauses' weights and the base rate stand for.

Weights are log ratios of rates in labelled texts, pulled towards stated priors. The insults are learned too: of all word
prefixes and whole words those are kept whose rate in toxic texts departs most surely from that in clean ones. A few
well-known words of four languages are the starting lexicon, so the grammar works without labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, cut, table

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
BORDERS = frozenset(".!?;\n")

#: The starting lexicon.
INSULTS = "idiot idiots moron morons loser losers stupid scum trash worthless pathetic disgusting imbecile dumbass bastard trottel dummkopf arschloch abschaum imbécile connard salaud crétin abruti imbécil estúpido estúpida idiota cabrón"
VIOLENCE = "kill murder strangle stab töten ermorden erschlagen umbringen tuer assassiner étrangler égorger matar asesinar apuñalar degollar"
TARGETS = "you your yours yourself they them these people du dich dir dein euch eure ihr tu toi vous votre ton tes vos tú te ti usted ustedes vosotros tus ellos"
NEGATIONS = "not never no nobody nor don didn isn wasn aren doesn nicht nie kein keine niemals ne pas jamais aucun ni nunca jamás tampoco"
REPORTS = "said says saying called calls claimed wrote quoted reported according sagte sagt sagten nannte behauptete schrieb laut dit dits disait appelé selon dijo dice dijeron llamó según escribió"

PLAIN, BORDER, TARGET, NEGATION, REPORT, INSULT, VIOLENT = range(7)
#: What the machine puts out for a word.
KINDS = ("insult", "targeted", "negated", "reported", "threat")
#: Priors in log odds of a kind beside the insult's own weight; a threat has no other.
KIND_PRIOR = {"insult": 0.0, "targeted": 0.7, "negated": -1.5, "reported": -1.5, "threat": 3.0}
SEED_PRIOR = 3.0
#: Matches that the kinds' priors count as.
KIND_STRENGTH = 20.0
#: Words after a negation, and between target and match, that still belong together.
REACH = 4

SHORTEST, LONGEST = 3, 9
#: A text counts a lexeme so often at most when the lexicon is learned, so one text that repeats a word decides nothing.
CAP = 8
#: Least likelihood ratio statistic, number of texts and log ratio of a learned lexeme.
LEAST_GAIN, LEAST_TEXTS, LEAST_WEIGHT = 25.0, 3, 1.5
#: The bounded sample of labelled texts that the model is fitted on, and the most lexemes it learns.
FIT_TOXIC, FIT_CLEAN, LEXEMES = 2_000, 6_000, 5_000
THRESHOLD = 0.7


# ---- transducers


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs`` has (next state, output) for each state and each of its ``symbols``; it starts in state 0."""

    symbols: tuple
    arcs: dict


def transducer(symbols, step) -> Transducer:
    """The states reached from 0 by ``step(state, symbol) -> (state, output)``."""
    arcs, open_ = {}, [0]
    names = {0: 0}
    for state in open_:
        for x in symbols:
            to, out = step(state, x)
            if to not in names:
                names[to] = len(names)
                open_.append(to)
            arcs[names[state], x] = (names[to], out)
    return Transducer(tuple(symbols), arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """``second`` reads what ``first`` writes."""

    def step(state, x):
        a, b = state or (0, 0)
        a, y = first.arcs[a, x]
        b, z = second.arcs[b, y]
        return ((a, b) if (a, b) != (0, 0) else 0), z

    return transducer(first.symbols, step)


def reported() -> Transducer:
    """After a verb of saying, matches are reported until the clause ends."""
    change = {INSULT: "insult/reported", VIOLENT: PLAIN}
    return transducer(range(7), lambda s, x: (0, x) if x == BORDER else (1, x) if x == REPORT else (s, change.get(x, x) if s else x))


def negated(reach: int = REACH) -> Transducer:
    """A match within ``reach`` words after a negation is negated."""
    change = {INSULT: "insult/negated", VIOLENT: PLAIN}

    def step(left, x):
        if x == BORDER:
            return 0, x
        if x == NEGATION:
            return reach, PLAIN
        return max(0, left - 1), change.get(x, x) if left else x

    return transducer([*range(7), "insult/reported"], step)


def targeted(reach: int = REACH) -> Transducer:
    """A match within ``reach`` words after a target is aimed at it. Targets are passed on, for threats."""

    def step(left, x):
        if x == BORDER:
            return 0, x
        if x == TARGET:
            return reach, x
        return max(0, left - 1), "insult/targeted" if left and x == INSULT else x

    return transducer([*range(7), "insult/reported", "insult/negated"], step)


def threats(reach: int = REACH) -> Transducer:
    """A word of violence and a target within ``reach`` words, in either order, is one threat, put out at the later of the two."""

    def step(state, x):
        what, left = state or ("", 0)
        left -= 1
        if left < 0:
            what, left = "", 0
        if x == BORDER:
            return 0, x
        if x in (TARGET, VIOLENT):
            if what and what != x:
                return 0, "threat"
            return (x, reach), PLAIN
        return ((what, left) if what else 0), x

    return transducer([*range(7), "insult/reported", "insult/negated", "insult/targeted"], step)


def insults() -> Transducer:
    """The kind of a match, or None."""
    kinds = {INSULT: "insult", "threat": "threat"} | {f"insult/{k}": k for k in ("targeted", "negated", "reported")}
    return transducer([*range(7), *(k for k in kinds if k != INSULT)], lambda s, x: (0, kinds.get(x)))


def grammar() -> list[list[tuple[int, str | None]]]:
    """The composed machine as a table: for each state and word class the next state and the kind of a match."""
    whole = reported()
    for part in (negated(), targeted(), threats(), insults()):
        whole = compose(whole, part)
    states = 1 + max(s for s, _ in whole.arcs)
    return [[whole.arcs[s, x] for x in whole.symbols] for s in range(states)]


# ---- scoring


def _seeds() -> dict[str, float]:
    return {f"{w}$": SEED_PRIOR for w in INSULTS.split()}


@dataclass(frozen=True)
class Model:
    """``lexemes``: weight of each prefix, or of a whole word (ending in $). ``kinds``: weight of each kind of match.
    ``plain``: weight of a word outside matches. ``prior``: log odds of a toxic document."""

    lexemes: dict[str, float] = field(default_factory=_seeds)
    kinds: dict[str, float] = field(default_factory=lambda: dict(KIND_PRIOR))
    plain: float = -0.01
    prior: float = -2.0


class Classes(dict):
    """Class of a token; insults' weights are in ``weights``. Forgets everything at ``room`` tokens."""

    def __init__(self, lexemes: dict[str, float], room: int = 400_000):
        super().__init__()
        self.lexemes, self.room, self.weights = lexemes, room, {}
        self.fixed = {w: c for names, c in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (VIOLENCE, VIOLENT)) for w in names.split()} | dict.fromkeys(BORDERS, BORDER)

    def lexeme(self, word: str) -> str | None:
        """The whole word, or else its longest prefix in the lexicon."""
        if word + "$" in self.lexemes:
            return word + "$"
        return next((word[:k] for k in range(min(len(word), LONGEST), SHORTEST - 1, -1) if word[:k] in self.lexemes), None)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:
            self.clear()
            self.weights.clear()
        found = None if word in self.fixed else self.lexeme(word)
        if found:
            self.weights[word] = self.lexemes[found]
        value = self[word] = INSULT if found else self.fixed.get(word, PLAIN)
        return value


class Scorer:
    def __init__(self, model: Model):
        self.model, self.machine, self.classes = model, grammar(), Classes(model.lexemes)

    def clauses(self, text: str) -> tuple[int, list[tuple[int, int, Counter, float]]]:
        """(number of words, clauses with a match): start and end in the text, matches by kind, and their weight."""
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        tokens = TOKEN.findall(low)
        codes = list(map(self.classes.__getitem__, tokens))
        n = len(codes) - codes.count(BORDER)
        if not codes or max(codes) < INSULT:
            return n, []
        found, state, kinds, weight, start, end = [], 0, Counter(), 0.0, None, 0
        for m in TOKEN.finditer(low):
            word = m[0]
            code = self.classes[word]
            state, kind = self.machine[state][code]
            if kind:
                kinds[kind] += 1
                weight += self.model.kinds[kind] + (self.classes.weights[word] if code == INSULT else 0.0)
            if code == BORDER:
                if kinds:
                    found.append((start, end, kinds, weight))
                kinds, weight, start = Counter(), 0.0, None
            else:
                start, end = m.start() if start is None else start, m.end()
        if kinds:
            found.append((start, end, kinds, weight))
        return n, found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, Counter, float]]]:
        """(probability, clauses with a match)."""
        n, found = self.clauses(text or "")
        z = self.model.prior + sum(c[3] for c in found) + self.model.plain * (n - sum(sum(c[2].values()) for c in found))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))), found


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All of ``docs``' columns but ``text``, with ``score``, ``predicted`` (1 from ``threshold`` on) and ``clauses``, the matched ones: start, end (code points), kinds and weight.

    Only ``text`` goes into a score. Null or empty text: the base rate, no clauses. Equal texts have equal scores; each row has
    one result. Columns of these names are replaced, others pass through. Texts are read whole; a very long one is one row's work. An
    empty table gives an empty result.
    """
    schema = "score double, predicted int, clauses array<struct<start:int,end:int,kinds:array<string>,weight:double>>"
    held = [c for c in docs.columns if c.lower() not in ("text", "score", "predicted", "clauses")]
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kinds", pa.list_(pa.string())), ("weight", pa.float64())]))

    def make():
        scorer = Scorer(model)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scorer.score(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            scores = [s for s, _ in rows]
            spans = [[{"start": a, "end": b, "kinds": sorted(k.elements()), "weight": w} for a, b, k, w in found] for _, found in rows]
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, kinds)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "score", "predicted", "clauses"])

        return f

    own = docs.select(*held, "text")
    out = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in own.schema.fields[:-1]), schema])
    return by_batch(own, make, out)


# ---- fitting


def _keys(words: list[str]) -> list[int]:
    """Smallest hash of the text's five-word shingles under three seeds: near copies share one almost always."""
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return [min(xxhash.xxh3_64_intdigest(s, seed) for s in shingles) >> 1 for seed in (1, 2, 3)]


def fit_sample(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> DataFrame:
    """Rows (toxic boolean, text): the texts of at most ``toxic`` and ``clean`` labelled documents, the smallest by a hash of doc_id,
    one of each group of near copies, so that what copies share by chance is no evidence."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    ids = marked.filter("toxic").orderBy("h").limit(toxic).unionAll(marked.filter("NOT toxic").orderBy("h").limit(clean))
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [_keys([w for w in TOKEN.findall(x.lower()) if w not in BORDERS]) for x in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("text"), batch.column("h"), *(pa.array(k, pa.int64()) for k in zip(*keys))], ["toxic", "text", "h", "k0", "k1", "k2"])

        return f

    # at most ``toxic`` + ``clean`` rows are broadcast; the aggregations combine in the tasks, so a doc_id with very many rows is one row from each
    rows = by_batch(texts.join(F.broadcast(ids), "doc_id").select("toxic", "text", "h"), make, "toxic boolean, text string, h long, k0 long, k1 long, k2 long")
    for k in ("k0", "k1", "k2"):
        rows = rows.groupBy(F.col(k).alias("key")).agg(F.min(F.struct("h", "toxic", "text", "k0", "k1", "k2")).alias("one")).select("one.*")
    return rows.select("toxic", "text")


def _rates(sample: DataFrame) -> DataFrame:
    """Rows (lexeme, toxic uses, clean uses, toxic texts); '' stands for all words and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush():
            columns = zip(*((k, *v) for k, v in held.items()))
            out = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lexeme", "t", "c", "texts"]) if held else None
            held.clear()
            return [out] if out is not None else []

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words = Counter(w for w in TOKEN.findall(text.lower()) if w not in BORDERS)
                uses = Counter()
                for w, n in words.items():
                    uses[w + "$"] += n
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        uses[w[:k]] += n
                for x, n in [*((x, min(n, CAP)) for x, n in uses.items()), ("", words.total())]:
                    row = held.setdefault(x, [0, 0, 0])
                    row[not toxic] += n
                    row[2] += toxic
                if len(held) > 300_000:
                    yield from flush()
        yield from flush()

    return sample.mapInArrow(run, "lexeme string, t long, c long, texts long").groupBy("lexeme").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("texts").alias("texts"))


def choose(rows: list, all_t: float, all_c: float) -> dict[str, tuple[int, int]]:
    """Lexemes with their uses, of rows (lexeme, t, c) in order of their gain, the surest and then the longest first: one that is a prefix of
    a chosen one, or has one as its prefix, says the same and is left out."""
    taken: dict[str, tuple[int, int]] = {}
    inner: set[str] = set()  # prefixes of the chosen ones
    for x, t, c in rows:
        prefixes = {x[:k] for k in range(SHORTEST, len(x))}
        if x not in inner and not prefixes & taken.keys():
            taken[x] = (t, c)
            inner |= prefixes
    return taken


def fit(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> Model:
    """A model of the labelled documents. Labels that are null or without a document are left out; of several of a doc_id any 1 counts.
    Without toxic or without clean labels the starting lexicon and the priors stay. At most LEXEMES rows come to the driver."""
    base = {bool(r["toxic"]): r["n"] for r in labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("toxic") > 0).agg(F.count("*").alias("n")).withColumnRenamed("(toxic > 0)", "toxic").collect()}
    start = Model()
    if len(base) < 2:
        return start
    sample = cut(fit_sample(docs, labels, toxic, clean))
    rates = cut(_rates(sample))
    whole = rates.filter("lexeme = ''").first()
    if not whole or not whole["t"] or not whole["c"]:
        return replace(start, prior=math.log(base[True] / base[False]))
    all_t, all_c = float(whole["t"]), float(whole["c"])
    t, c, both = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    share = all_t / (all_t + all_c)
    gain = 2 * (t * F.log(t / (both * share)) + F.when(c > 0, c * F.log(c / (both * (1 - share)))).otherwise(0.0))
    weight = F.log((t + 0.5) / (c + 0.5)) - math.log(all_t / all_c)
    seeds = _seeds()
    sure = rates.filter(f"lexeme <> '' AND t > 0 AND texts >= {LEAST_TEXTS}").filter((weight >= LEAST_WEIGHT) & (gain >= LEAST_GAIN))
    rows = sure.orderBy(gain.desc(), F.length("lexeme").desc(), "lexeme").limit(LEXEMES).collect()
    taken = choose([(r["lexeme"], r["t"], r["c"]) for r in rows], all_t, all_c)
    ratio = math.log(all_t / all_c)
    lexemes = {x: math.log((a + 0.5) / (b + 0.5)) - ratio for x, (a, b) in taken.items()}
    covered = Classes(lexemes)
    for r in rates.filter(F.col("lexeme").isin(*seeds)).collect():
        if covered.lexeme(r["lexeme"][:-1]) is None:
            taken[r["lexeme"]] = (r["t"], r["c"])
    for x in seeds:
        if covered.lexeme(x[:-1]) is None:
            a, b = taken.get(x, (0, 0))
            lexemes[x] = math.log((a + 0.5 * math.exp(SEED_PRIOR + ratio)) / (b + 0.5)) - ratio
    in_t, in_c = sum(a for a, _ in taken.values()), sum(b for _, b in taken.values())
    plain = math.log(1 - min(0.9, in_t / all_t)) - math.log(1 - min(0.9, (in_c + 0.5) / all_c))
    drawn = replace(start, lexemes=lexemes, plain=min(plain, 0.0), prior=math.log(base[True] / base[False]))
    return replace(drawn, kinds=_kinds(sample, drawn, all_t, all_c))


def _kinds(sample: DataFrame, model: Model, all_t: float, all_c: float) -> dict[str, float]:
    """The kinds' weights: how much likelier a match is of this kind in toxic texts than in clean ones; for threats, how much likelier one is."""

    def make():
        scorer = Scorer(model)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                for clause in scorer.clauses(text)[1]:
                    for kind, n in clause[2].items():
                        found[toxic, kind] += n
            rows = [(a, k, n) for (a, k), n in found.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), (pa.bool_(), pa.string(), pa.int64()))], ["toxic", "kind", "n"])

        return f

    counts = {(r["toxic"], r["kind"]): r["n"] for r in by_batch(sample, make, "toxic boolean, kind string, n long").groupBy("toxic", "kind").agg(F.sum("n").alias("n")).collect()}
    t, c = ({k: counts.get((x, k), 0) for k in KINDS} for x in (True, False))
    out = {"threat": math.log((t["threat"] + 0.5 * math.exp(KIND_PRIOR["threat"]) * all_t / all_c) / (c["threat"] + 0.5)) - math.log(all_t / all_c)}
    kinds = [k for k in KINDS if k != "threat"]
    sum_t, sum_c = sum(t[k] for k in kinds), sum(c[k] for k in kinds)
    for k in kinds:
        usual = KIND_STRENGTH * (t[k] + c[k] + 1) / (sum_t + sum_c + len(kinds))
        out[k] = math.log((t[k] + usual * math.exp(KIND_PRIOR[k])) / (sum_t + KIND_STRENGTH)) - math.log((c[k] + usual) / (sum_c + KIND_STRENGTH))
    return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
