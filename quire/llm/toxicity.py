"""Toxicity: weighted finite-state transducers over the words of a clause, composed into one machine that scores clauses.

Words and stems of insults come from labelled rows (and a small seed list); target, negation, threat and reported-speech words are
fixed. A lexicon turns a clause into a string of word classes. Four transducers read that string one after another: negation marks
what stands in its scope, which a pause ends; reported speech marks a clause that has a reporting word before or after; target marks
insults and threats that are aimed at somebody on either side; the last one gives each marked insult or threat, and each that follows
another closely, the name of its weight. What lies ahead is guessed and must come true, so that every clause has one accepted path
through their composition. The weights of the composed machine's arcs are fitted on labelled rows, towards stated values where those
rows say nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import session, small_side, stored, utf8

#: Labelled rows that are learned from: those whose hashed ids are the smallest, so many at most.
MAX_LABELLED = 8_000
#: Toxic texts that an entry of the lexicon needs, the least share of its texts that are toxic, and the chance that they are so by luck.
LEAST_TEXTS, LEAST_SHARE, LUCK = 3, 0.8, 1e-6
STEM_LENGTHS = (3, 4, 5, 6, 7)
#: Weight of an insult or threat that is known beforehand.
SEED_WEIGHT = 2.0

SEEDS = {
    "insult": "idiot moron scum trash stupid worthless pathetic loser disgusting imbecile idiota estúpido imbécil basura dumm dummkopf abschaum idiote stupide crétin ordure",
    "threat": "kill destroy hurt burn strangle matar matarte destruir töten umbringen vernichten tuer détruire brûler",
    "target": "you your he she they him her them these those tú usted ellos ella él du ihr sie er tu vous il elle ils elles",
    "negation": "not no never nobody isn't aren't don't nunca jamás nicht kein keine nie ne pas jamais aucun",
    "reported": "said says claims claimed reported quoted according dijo dice según sagte sagt laut dit selon",
}
#: Classes of words, one letter each: any other word, insult, threat, target, negation, reporting word, pause.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE = CLASSES = "oitgnrp"
#: Words that a negation reaches; words before an insult or threat, and behind it, in which its target may stand; words between two
#: insults or threats that make the second one follow closely.
NEGATED_WORDS, TARGET_BEFORE, TARGET_BEHIND, AGAIN_WORDS = 4, 8, 4, 5

MARKS = ("negated", "reported", "target")
#: Names of the weights: a kind with its marks, and a second one close by.
ARCS = tuple("+".join((kind, *(m for m, on in zip(MARKS, marks, strict=True) if on))) for kind in ("insult", "threat") for marks in product((0, 1), repeat=3)) + ("again",)
#: What is fitted: the arcs' weights, then those of the heaviest clause, the number of clauses with matches, and matches per hundred words.
FEATURES = (*ARCS, "heaviest", "clauses", "density")
#: Weights that the fitted ones start from and stay near where labelled rows are few, and the intercept.
BEFOREHAND = {"insult": 1.2, "insult+target": 1.6, "threat+target": 3.2, "insult+negated": 0.1, "insult+negated+target": 0.1, "insult+reported": 0.1, "insult+reported+target": 0.1, "again": 0.3, "heaviest": 0.8, "clauses": 0.4, "density": 0.2}
INTERCEPT = -3.0
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|,")
_CLAUSE = re.compile(r"[^.!?;:\n]+")

#: A symbol between the machines: a class letter, and the marks that an insult or threat has got so far.
Symbol = tuple[str, frozenset]
Arc = tuple[Hashable, Hashable, tuple[str, ...], Hashable]


@dataclass(frozen=True)
class Transducer:
    """arcs: state to (symbol read, symbol written, names of weights, next state). Paths go from ``start`` to a state in ``finals``."""

    start: Hashable
    finals: frozenset
    arcs: dict[Hashable, tuple[Arc, ...]]


def _built(start: Hashable, symbols: Iterable[Symbol], step, final) -> Transducer:
    """The states that ``step(state, symbol)``, which yields (symbol, names, next state), reaches from the start."""
    symbols, arcs, todo = list(symbols), {}, [start]
    while todo:
        now = todo.pop()
        if now not in arcs:
            arcs[now] = tuple((x, out, names, after) for x in symbols for out, names, after in step(now, x))
            todo += [a[3] for a in arcs[now]]
    return Transducer(start, frozenset(s for s in arcs if final(s)), arcs)


def _marked(*marks: str) -> list[Symbol]:
    """All symbols: classes, the insults and threats among them with any of these marks."""
    sets = [frozenset(m for m, on in zip(marks, chosen, strict=True) if on) for chosen in product((0, 1), repeat=len(marks))]
    return [(c, m) for c in CLASSES for m in (sets if c in (INSULT, THREAT) else sets[:1])]


def negation() -> Transducer:
    """Marks insults and threats up to NEGATED_WORDS words after a negation and before a pause. A state is the words left."""

    def step(left: int, x: Symbol) -> Iterator:
        c, marks = x
        out = (c, marks | {"negated"}) if c in (INSULT, THREAT) and left else x
        yield out, (), NEGATED_WORDS if c == NEGATION else 0 if c == PAUSE else max(0, left - 1)

    return _built(0, _marked(), step, lambda _: True)


def reported_speech() -> Transducer:
    """Marks the insults and threats of a clause that has a reporting word. 'direct' guesses that none will come, 'before' that one will."""

    def step(now: str, x: Symbol) -> Iterator:
        c, marks = x
        for guess in ("direct", "before") if now == "start" else (now,):
            if c == REPORT and guess == "direct":
                continue
            out = (c, marks | {"reported"}) if c in (INSULT, THREAT) and guess != "direct" else x
            yield out, (), "after" if c == REPORT else guess

    return _built("start", _marked("negated"), step, lambda s: s != "before")


def target() -> Transducer:
    """Marks insults and threats with a target up to TARGET_BEFORE words before them or TARGET_BEHIND words behind.

    A state is the words for which the last target counts, the words in which none may come (it was guessed that none does), and the
    words in which one must.
    """

    def step(now: tuple[int, int, int], x: Symbol) -> Iterator:
        (seen, none, due), (c, marks) = now, x
        if c == TARGET:
            if not none:
                yield x, (), (TARGET_BEFORE, 0, 0)
            return
        if due == 1:  # the last word in which the target could have come
            return
        after = (max(0, seen - 1), max(0, none - 1), max(0, due - 1))
        if c not in (INSULT, THREAT):
            yield x, (), after
        elif seen or due:
            # A target that is due for an earlier one comes in time for this one too.
            yield (c, marks | {"target"}), (), after
        else:
            yield x, (), (0, TARGET_BEHIND, 0)
            yield (c, marks | {"target"}), (), (0, after[1], TARGET_BEHIND)

    return _built((0, 0, 0), _marked("negated", "reported"), step, lambda s: s[2] == 0)


def patterns() -> Transducer:
    """Names the weight of each marked insult or threat, and of one that follows another by AGAIN_WORDS words or fewer."""

    def step(left: int, x: Symbol) -> Iterator:
        c, marks = x
        if c not in (INSULT, THREAT):
            yield x, (), max(0, left - 1)
            return
        name = "+".join(("insult" if c == INSULT else "threat", *(m for m in MARKS if m in marks)))
        yield x, (name, "again") if left else (name,), AGAIN_WORDS

    return _built(0, _marked(*MARKS), step, lambda _: True)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that reads what a reads and writes what b writes for it; only states that a final one can be reached from remain."""
    start = (a.start, b.start)
    arcs: dict[Hashable, list[Arc]] = {}
    todo = [start]
    while todo:
        now = todo.pop()
        if now in arcs:
            continue
        arcs[now] = [(x, out, n + m, (p, q)) for x, y, n, p in a.arcs[now[0]] for z, out, m, q in b.arcs[now[1]] if y == z]
        todo += [arc[3] for arc in arcs[now]]
    finals = {s for s in arcs if s[0] in a.finals and s[1] in b.finals}
    into: dict[Hashable, list[Hashable]] = {}
    for s, own in arcs.items():
        for arc in own:
            into.setdefault(arc[3], []).append(s)
    useful, todo = set(finals), list(finals)
    while todo:
        for s in into.get(todo.pop(), ()):
            if s not in useful:
                useful.add(s)
                todo.append(s)
    return Transducer(start, frozenset(finals), {s: tuple(x for x in own if x[3] in useful) for s, own in arcs.items() if s in useful})


@lru_cache(maxsize=1)
def grammar() -> tuple[list[dict[str, list[tuple[int, tuple[str, ...]]]]], frozenset[int]]:
    """The composed machine: by state, from 0, and class the next states with the names on the way; and the final states."""
    machine = compose(compose(compose(negation(), reported_speech()), target()), patterns())
    number = {s: i for i, s in enumerate([machine.start, *(s for s in machine.arcs if s != machine.start)])}
    table: list[dict] = [{} for _ in number]
    for s, own in machine.arcs.items():
        for (c, _), _, names, after in own:
            table[number[s]].setdefault(c, []).append((number[after], names))
    return table, frozenset(number[s] for s in machine.finals)


def accepted(classes: str) -> tuple[tuple[int, str], ...]:
    """(place of the word, name of the weight) along the accepted path of a string of classes."""
    table, finals = grammar()
    now: dict[int, tuple | None] = {0: None}  # the path so far, as links back; no two paths reach a state that both can end
    for i, c in enumerate(classes):
        now = {after: (path, i, names) if names else path for s, path in now.items() for after, names in table[s].get(c, ())}
    link, out = next(path for s, path in now.items() if s in finals), []
    while link:
        link, i, names = link
        out += [(i, n) for n in reversed(names)]
    return tuple(reversed(out))


_remembered = lru_cache(maxsize=50_000)(accepted)


class Lexicon:
    """Weights of insult words and stems, with an automaton that finds them; fixed words have a class each."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        letters = {"threat": THREAT, "target": TARGET, "negation": NEGATION, "reported": REPORT}
        self.fixed = {w: letters[k] for k, ws in SEEDS.items() if k != "insult" for w in ws.split()} | {",": PAUSE}
        self._finder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_finder": None}

    def finder(self):
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *SEEDS["threat"].split()}:
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        return self._finder

    def classify(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word, 0.0)
        for n in STEM_LENGTHS:
            if len(word) > n:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        return (INSULT, weight) if weight > 0 else (self.fixed.get(word, OTHER), SEED_WEIGHT)


def clause_emissions(clause: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """(name of the arc's weight, weight of the word) of each insult and threat of a lower-cased clause."""
    found = [lexicon.classify(m.group()) for m in _TOKENS.finditer(clause)]
    classes = "".join(c for c, _ in found)
    return [(name, found[i][1]) for i, name in (_remembered if len(classes) <= 64 else accepted)(classes)]


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of a text: sums of the words' weights by arc, the heaviest clause's, the clauses with any, and weight per hundred words."""
    low = text.lower()
    sums, heaviest, clauses, last = dict.fromkeys(ARCS, 0.0), 0.0, 0, -1
    for end, n in lexicon.finder().iter(low):
        at = end - n + 1
        if at <= last or at and low[at - 1].isalpha():
            continue
        a = max((low.rfind(c, max(last, 0), at) for c in ".!?;:\n"), default=-1) + 1
        m = _CLAUSE.match(low, a)
        last = m.end() - 1
        found = clause_emissions(m.group(), lexicon)
        for name, weight in found:
            sums[name] += weight
        if found:
            clauses += 1
            heaviest = max(heaviest, sum(w for name, w in found if name in ("insult", "insult+target", "threat+target")))
    total = sum(x for name, x in sums.items() if name not in ("again", "threat"))
    density = 100 * total / (1 + low.count(" ") + low.count("\n")) if total else 0.0
    return [math.log1p(x) for x in (*sums.values(), heaviest, clauses, density)]


def _batch(texts: pa.Array) -> Iterable[str]:
    data, at = utf8(texts)
    return (str(data[a:b], "utf-8") for a, b in zip(at[:-1], at[1:], strict=True))


@F.arrow_udf(ArrayType(StringType()))
def lexicon_entries(texts: pa.Array) -> pa.Array:
    """The distinct words of a text as =word, and their stems as stem*."""
    parts, out = [pa.array([], pa.list_(pa.string()))], []
    for t in _batch(texts):
        words = set(_WORDS.findall(t.lower()))
        out.append([f"={w}" for w in words] + list({f"{w[:n]}*" for w in words for n in STEM_LENGTHS if len(w) > n}))
        if len(out) == 64:  # as Python strings they would take several times the memory
            parts.append(pa.array(out, pa.list_(pa.string())))
            out = []
    return pa.concat_arrays([*parts, pa.array(out, pa.list_(pa.string()))])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows that are not held out, those whose hashed ids are the smallest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "labelled")
    # Copies of a text count once, or each would vouch for all its words.
    texts = docs.select("doc_id", "text").join(small_side(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return stored(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled-texts")


def _log_luck(toxic: Column, texts: Column, rate: float) -> Column:
    """A bound on the log of the chance that so many of an entry's texts or more are toxic, by the relative entropy of the rates."""
    p = toxic / texts
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    return F.when(p <= rate, 0.0).otherwise(-texts * (p * F.log(p / rate) + rest))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that toxic texts have beyond luck, with log odds as weights; the seeds where labels say nothing.

    Only entries beyond luck reach the driver; the sample's bound bounds their number.
    """
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    seeds = {w: SEED_WEIGHT for w in SEEDS["insult"].split()}
    if not 0 < totals.toxic < totals.n:
        return Lexicon(seeds, {})
    rate = totals.toxic / totals.n
    counts = sample.select("toxic", F.explode(lexicon_entries(F.col("text"))).alias("entry")).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    likely = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_SHARE * F.col("n")) & (_log_luck(F.col("toxic"), F.col("n"), rate) < math.log(LUCK)))
    good = {r.entry: (r.toxic, r.n) for r in likely.collect()}
    weight = {e: math.log((a + 0.5) / (n - a + 0.5)) - math.log(rate / (1 - rate)) for e, (a, n) in good.items()}
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    longer: dict[str, list[str]] = {}  # words and longer stems by each stem that they begin with
    for e in weight:
        own = e[1:] if e[0] == "=" else e[:-1]
        for n in STEM_LENGTHS:
            if len(own) >= n + (e[0] != "="):
                longer.setdefault(own[:n], []).append(e)
    for e in sorted((e for e in weight if e[-1] == "*"), key=lambda e: (len(e), e)):
        stem = e[:-1]
        if any(stem[:n] in stems for n in STEM_LENGTHS if n < len(stem)):
            continue
        # One word that explains nearly all of a stem's texts is the better entry, and so is a longer stem.
        if not any(good[x][0] >= 0.97 * good[e][0] for x in longer.get(stem, ())):
            stems[stem] = weight[e]
    for e in weight:
        if e[0] == "=" and not any(e[1 : 1 + n] in stems for n in STEM_LENGTHS if len(e) - 1 > n):
            words[e[1:]] = weight[e]
    return Lexicon({w: x for w, x in seeds.items()} | words, stems)


def start_weights() -> np.ndarray:
    """The weights beforehand and, last, the intercept."""
    return np.array([BEFOREHAND.get(f, 0.0) for f in FEATURES] + [INTERCEPT])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge around the weights beforehand."""
    x = np.hstack([x, np.ones((len(x), 1))])
    start = start_weights()
    w, keep = start.copy(), np.append(np.full(x.shape[1] - 1, ridge), 1e-4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep * (w - start))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights[:-1], text_features(text, self.lexicon)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    session(docs)
    sample = labelled_sample(docs, labels, limit)
    lexicon = learn_lexicon(sample)

    @F.arrow_udf(ArrayType(DoubleType()))
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([text_features(t, lexicon) for t in _batch(texts)], pa.list_(pa.float64()))

    rows = sample.select(features(F.col("text")).alias("f"), "toxic").collect()  # at most ``limit`` short rows
    if len({r.toxic for r in rows}) < 2:
        return Model(lexicon, start_weights())
    return Model(lexicon, fit_logistic(np.array([r.f for r in rows]), np.array([r.toxic for r in rows], float)))


SCORED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None, name: str = "toxicity") -> DataFrame:
    """docs with a struct column ``name`` (score, predicted). Null and empty texts get the score of a text without matches;
    repeated rows get equal scores; labels without documents, and unlabelled or empty tables, leave the seeds and fixed weights."""
    session(docs)
    model = model or train(docs, labels)

    @F.arrow_udf(SCORED)
    def scored(texts: pa.Array) -> pa.Array:
        scores = [model.score(t) for t in _batch(texts)]
        return pa.array([{"score": s, "predicted": int(s >= 0.5)} for s in scores], pa.struct([("score", pa.float64()), ("predicted", pa.int32())]))

    return docs.withColumn(name, scored("text"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts have the score of a text without matches; repeated rows repeat theirs; without usable labels the seeds and the
    weights beforehand score; texts of any length are read whole; equal texts have equal scores.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted")


def acceptable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; columns of any name stay. Null and empty texts are kept, repeated rows kept or dropped alike."""
    scored = score_documents(docs, labels, name="__toxicity")
    return scored.where("__toxicity.predicted = 0").select(*(scored[c] for c in docs.columns))
