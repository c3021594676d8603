"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned: words, and stems of 4 to 6 letters, that mark toxic rows far
beyond chance.  A word of a text hits a term exactly, through a stem, or with one edit of
either: Levenshtein automata are intersected with the trie of all terms, from its root.  An edit counts less than its term, and the
less the more clean rows of the sample hold such edits, as ordinary words can be one edit
from a weak term.  A hit counts by its term's weight and by its
context window: less inside quotation marks or beside reporting words, more beside words
of address.  A logistic curve over the summed hits, fitted on rows whose lexicon was
learned from other rows, gives the score.

Training reads a bounded sample: about ``per_class`` rows of each label, those with the
smallest hashes of their ids, equal texts once.  Every term of the sample that passes the
gates is in the lexicon.

Defined results: null and empty text have no hits and get the curve's lowest score; without
labels of both kinds the score is 0; labels that repeat an id train by the largest label;
equal texts get equal scores; an empty table gives no rows; only key, text and label are
read, so other columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

WORD = re.compile(r"\w+")
PER_CLASS = 6000
STEMS = (4, 5, 6)
#: Surprise in nats that a term needs, and the least rows that hold it.
LEAST_SURPRISE, LEAST_ROWS = 9.0, 3
#: How many times as frequent in toxic rows as in clean ones a term is, whatever the number of either.
LEAST_LIFT = 8.0
EDITED = 0.5
#: States of the automata that a worker keeps before it starts anew.
STATES = 200_000
WINDOW, QUOTED, ADDRESSED = 6, 0.3, 1.25
REMEMBERED = 400_000
# Words that report or quote, words that address, and quotation marks.
REPORTING = frozenset("said says wrote quote quoted quoting called calling term word sagte schrieb zitat wort dit écrit citation mot dijo escribió cita palabra".split())
ADDRESS = frozenset("you your youre du dich dein tu te ton vous votre usted ustedes".split())
QUOTES = "\"“”„«»‹›"


class Trie:
    """Terms by letters, and stems as nodes that accept every word that goes on from them, met by Levenshtein automata of one edit.

    Where the trie stands after some letters of a word, with no edit and with one, is a state;
    states and the letters that lead from one to the next are worked out when a word first needs
    them and kept, so that words then cost a look-up a letter, and most die after a few.
    Of several terms ``near`` gives the heaviest, then the first in letter order.
    """

    def __init__(self, terms: list[str], stems: list[str] = (), weights: dict[str, float] | None = None):
        self.below: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[float, str]] = {}
        self.opens: dict[int, tuple[float, str]] = {}
        for kept, mark, held in ((terms, "", self.ends), (stems, "*", self.opens)):
            for term in kept:
                node = 0
                for c in term:
                    if c not in self.below[node]:
                        self.below[node][c] = len(self.below)
                        self.below.append({})
                    node = self.below[node][c]
                held[node] = (-(weights or {}).get(term + mark, 0.0), term + mark)
        self._forget()

    def _forget(self) -> None:
        """Only the state of no place, which is dead, is known."""
        self.numbers: dict[tuple[int, frozenset[int]], int] = {}
        self.places: list[tuple[int, frozenset[int]]] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[float, str] | None] = []
        self.passes: list[tuple[float, str] | None] = []
        self._state(-1, frozenset())
        self.start = self._state(0, frozenset())

    def _state(self, exact: int, one: frozenset[int]) -> int:
        """The number of a state: the node reached without an edit (-1: none) and those reached with one."""
        if exact >= 0:
            one = one.union(self.below[exact].values()) - {exact}  # a letter of the term may be missing next
        key = (exact, one)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.places)
            here = [exact, *one]
            self.places.append(key)
            self.steps.append({})
            self.accepts.append(min((self.ends[n] for n in here if n in self.ends), default=None))
            self.passes.append(min((self.opens[n] for n in here if n in self.opens), default=None))
        return number

    def _step(self, state: int, letter: str) -> int:
        exact, one = self.places[state]
        on = {self.below[n][letter] for n in one if letter in self.below[n]}
        if exact >= 0:
            on.update(self.below[exact].values(), (exact,))  # another letter, or one too many
            exact = self.below[exact].get(letter, -1)
        number = self.steps[state][letter] = self._state(exact, frozenset(on))
        return number

    def near(self, word: str, same_first: bool = True) -> str | None:
        """The best term that the automaton of ``word`` accepts with at most one edit, of any letter or of any but the first."""
        if not word:
            return None
        if len(self.places) > STATES:
            self._forget()
        if same_first:
            state, word = self._state(self.below[0].get(word[0], -1), frozenset()), word[1:]
        else:
            state = self.start
        steps, passes = self.steps, self.passes
        found = passes[state]
        for c in word:
            after = steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if not state:
                break
            better = passes[state]
            if better is not None and (found is None or better < found):
                found = better
        better = self.accepts[state]
        if better is not None and (found is None or better < found):
            found = better
        return found and found[1]


@dataclass
class Lexicon:
    """Weights of words and of stems, 0 to 1, and how far an edit of a term can be trusted, 0 to 1 (1 where nothing is known)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    trust: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        terms = self.words | {s + "*": x for s, x in self.stems.items()}
        self.edited = {t: EDITED * x * self.trust.get(t, 1.0) for t, x in terms.items()}
        self.trie = Trie(list(self.words), list(self.stems), self.edited)
        self.known: dict[str, tuple[str, float] | None] = {}

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.trust)

    def look_up(self, word: str) -> tuple[str, float] | None:
        """(term, weight) of a word: itself, else its longest stem, else the heaviest term or stem one edit away."""
        found = self.exact(word)
        if found is None:
            term = self.trie.near(word, same_first=False)
            if term is not None and self.edited[term] > 0:
                found = term, self.edited[term]
        return found

    def exact(self, word: str) -> tuple[str, float] | None:
        if word in self.words:
            return word, self.words[word]
        for n in reversed(STEMS):
            if len(word) > n - 1 and word[:n] in self.stems:
                return word[:n] + "*", self.stems[word[:n]]
        return None

    def edits(self, text: str | None) -> set[str]:
        """Terms that a word of the text meets with an edit only."""
        words = set(WORD.findall((text or "").lower()))
        return {t for t in (self.trie.near(w, same_first=False) for w in words if self.exact(w) is None) if t is not None}

    def trusting(self, toxic: Counter, clean: Counter, p: int, n: int) -> Lexicon:
        """The same terms, each edit trusted as far as rows with one are toxic beyond chance; ``toxic`` and ``clean`` count these rows among ``p`` and ``n``."""
        share = lambda t: (toxic[t] + 1) / p / ((toxic[t] + 1) / p + clean[t] / n)
        return Lexicon(self.words, self.stems, {t: max(0.0, 2 * share(t) - 1) for t in self.edited})

    def hits(self, text: str | None) -> list[tuple[int, str, float]]:
        """(place in the word list, term, weight in its context) of every hit in the whole text."""
        if not text:
            return []
        lower = text.lower()
        words = WORD.findall(lower)
        distinct, known = set(words), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in distinct.difference(known):
            known[w] = self.look_up(w)
        here = {w for w in distinct if known[w] is not None}
        if not here:
            return []
        # places in the text are only needed where quotation marks can stand around a word
        spans = [m.span() for m in WORD.finditer(lower)] if any(q in lower for q in QUOTES) else None
        return [(i, known[w][0], known[w][1] * _context(lower, words, spans, i)) for i, w in enumerate(words) if w in here]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Log of the summed hits, log of the distinct terms' best hits summed, and the strongest hit."""
        found = self.hits(text)
        best: dict[str, float] = {}
        for _, term, weight in found:
            best[term] = max(weight, best.get(term, 0.0))
        return math.log1p(sum(x[2] for x in found)), math.log1p(sum(best.values())), max(best.values(), default=0.0)


def _context(text: str, words: list[str], spans: list[tuple[int, int]] | None, i: int) -> float:
    """Factor of a hit's window: quotation, address, or plain."""
    low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    near = {*words[low:i], *words[i + 1 : high]}
    if near & REPORTING:
        return QUOTED
    if spans:
        before, after = text[spans[low][0] : spans[i][0]], text[spans[i][1] : spans[high - 1][1] + 1]
        if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
            return QUOTED
    return ADDRESSED if near & ADDRESS else 1.0


@dataclass
class Model:
    lexicon: Lexicon
    curve: np.ndarray | None  #: weights of the features, bias last

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        return float(1 / (1 + np.exp(-(np.dot(self.curve[:-1], self.lexicon.features(text)) + self.curve[-1]))))


def _fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        reg = penalty * np.append(np.ones(x.shape[1] - 1), 0.01)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-6), x.T @ (y - p) - reg * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_terms(sample: DataFrame) -> DataFrame:
    """term (a word, or a stem and ``*``), and the rows of each fold and label that hold it."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            rows = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["term", "cell", "n"])

        for batch in batches:
            for text, fold, label in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = set(WORD.findall((text.as_py() or "").lower()))
                terms = words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}
                held.update((t, 2 * fold + label) for t in terms)
                if len(held) > 300_000:
                    yield flush()
        yield flush()

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(4)]
    return sample.mapInArrow(run, "term string, cell int, n long").groupBy("term").agg(*cells)


def _lifted(a, b, p: int, n: int):
    """Whether ``a`` of ``p`` toxic rows against ``b`` of ``n`` clean ones is lift enough; numbers or columns."""
    return (a + 0.01) * n >= (b + 0.01) * (LEAST_LIFT * p)


def _choose(rows: list, toxic: list[float], clean: list[float]) -> Lexicon:
    """Terms whose share of toxic rows is far beyond chance; a word that a chosen stem covers isn't kept beside it."""
    p, n = sum(toxic), sum(clean)
    if not p or not n:
        return Lexicon()
    chance = p / (p + n)
    scored = {}
    for term, a, b in rows:
        if a < LEAST_ROWS or not _lifted(a, b, p, n):
            continue
        share = (a + 0.01) / (a + b + 0.02)
        surprise = a * math.log(share / chance) + (b * math.log((1 - share) / (1 - chance)) if b else 0.0)
        if surprise >= LEAST_SURPRISE:
            scored[term] = (surprise, (math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1))), a)
    stems: dict[str, tuple] = {}
    for term in sorted((t for t in scored if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = term[:-1]
        # a stem must stand for more rows than its best word does, else the word itself is the term
        own = max((scored[w][2] for w in scored if not w.endswith("*") and w.startswith(stem)), default=0)
        if not any(stem.startswith(s) for s in stems) and scored[term][2] > 1.2 * own:
            stems[stem] = scored[term]
    words = {t: v for t, v in scored.items() if not t.endswith("*") and not any(t.startswith(s) for s in stems)}
    top = max((v[1] for v in [*words.values(), *stems.values()]), default=1.0)
    return Lexicon({t: v[1] / top for t, v in words.items()}, {t: v[1] / top for t, v in stems.items()})


def _trust_edits(sample: DataFrame, lexicons: list[Lexicon], totals: dict[tuple[int, int], int]) -> list[Lexicon]:
    """The lexicons of the sample and of its folds 0 and 1, each with the trust that its own rows give to edits."""

    shared = sample.sparkSession.sparkContext.broadcast(lexicons)  # once in a worker, which keeps what it worked out

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text, fold, label in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for k in (0, fold + 1):
                    held.update((k, t, label) for t in shared.value[k].edits(text.as_py()))
        rows = list(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int32()), pa.array([r[0][1] for r in rows], pa.string()), pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["k", "term", "label", "n"])

    # a row per lexicon, term and label at most
    counts = sample.mapInArrow(run, "k int, term string, label int, n long").groupBy("k", "term", "label").agg(F.sum("n").alias("n")).collect()
    out = []
    for k, lexicon in enumerate(lexicons):
        found = {label: Counter({r["term"]: r["n"] for r in counts if (r["k"], r["label"]) == (k, label)}) for label in (0, 1)}
        size = {label: sum(v for (fold, x), v in totals.items() if x == label and k in (0, fold + 1)) for label in (0, 1)}
        out.append(lexicon.trusting(found[1], found[0], size[1], size[0]) if size[0] and size[1] else lexicon)
    return out


def _place(order: Column) -> Column:
    return F.pmod(F.xxhash64(order), F.lit(1 << 30))


def _within(counts: dict[int, int], label: Column, place: Column, per_class: int) -> Column:
    share = {k: int(min(1.0, per_class / n) * (1 << 30)) for k, n in counts.items()}
    return place < F.when(label == 1, share.get(1, 0)).otherwise(share.get(0, 0))


def pick(marks: DataFrame, label: str, order: Column, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of a table of labels that ``train`` would take, about ``per_class`` of each label: few enough to broadcast to the texts."""
    marks = marks.where(F.col(label).isin(0, 1))
    counts = {r[label]: r["count"] for r in marks.groupBy(label).count().collect()}
    return marks.where(_within(counts, F.col(label), _place(order), per_class))


def _surprise(a: Column, b: Column, p: int, n: int) -> Column:
    share, chance = (a + 0.01) / (a + b + 0.02), p / (p + n)
    return a * F.log(share / chance) + F.when(b > 0, b * F.log((1 - share) / (1 - chance))).otherwise(0.0)


def train(rows: DataFrame, text: str, label: str, order: Column, per_class: int = PER_CLASS) -> Model:
    """Fits on about ``per_class`` rows of each label (0 or 1), those of the least ``order`` hash."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), _place(order).alias("place"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(Lexicon(), None)
    # equal texts count once, so that rows repeated without end stay one row; a text is in one fold
    picked = rows.where(_within(counts, F.col("label"), F.col("place"), per_class)).select("text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "label").distinct().repartition(16)
    scratch = Scratch(rows.sparkSession, "toxicity")
    sample = scratch.write(picked)  # read three times, so that the join before it runs once
    try:
        return _fit(sample)
    finally:
        scratch.drop(sample)


def _fit(sample: DataFrame) -> Model:
    totals = {(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    size = lambda label, folds: [totals.get((f, label), 0) for f in folds]
    p, n = sum(size(1, (0, 1))), sum(size(0, (0, 1)))
    if not p or not n:
        return Model(Lexicon(), None)
    # only terms that pass the gates in the sample or in one of its folds come back: few, as each stands for many rows of a bounded sample
    passed, gates = F.lit(False), [("c1 + c3", "c0 + c2", p, n), *((f"c{2 * f + 1}", f"c{2 * f}", *size(1, (f,)), *size(0, (f,))) for f in (0, 1))]
    for toxic, clean, pp, nn in gates:
        if pp and nn:
            x, y = F.expr(toxic), F.expr(clean)
            passed = passed | ((x >= LEAST_ROWS) & _lifted(x, y, pp, nn) & (_surprise(x, y, pp, nn) >= LEAST_SURPRISE))
    terms = _count_terms(sample).withColumn("a", F.expr("c1 + c3")).withColumn("b", F.expr("c0 + c2")).where(passed).orderBy("term").collect()
    lexicon = _choose([(r["term"], r["a"], r["b"]) for r in terms], size(1, (0, 1)), size(0, (0, 1)))
    halves = [_choose([(r["term"], r[f"c{2 * f + 1}"], r[f"c{2 * f}"]) for r in terms], size(1, (f,)), size(0, (f,))) for f in (0, 1)]

    lexicon, *halves = _trust_edits(sample, [lexicon, *halves], totals)

    shared = sample.sparkSession.sparkContext.broadcast(halves)

    def run(batches):
        halves = shared.value
        for batch in batches:
            out = [(*halves[1 - fold].features(text), label) for text, fold, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["f0", "f1", "f2", "label"])

    table = np.array([list(r) for r in sample.mapInArrow(run, "f0 double, f1 double, f2 double, label double").collect()])
    return Model(lexicon, _fit_curve(table[np.lexsort(table.T), :3], table[np.lexsort(table.T), 3]))


def scores(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, score and number of hits of every row."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample

    def run(batches):
        held = shared.value
        for batch in batches:
            found = [held.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [key, "score"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, score double")
