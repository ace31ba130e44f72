"""Toxicity by Levenshtein automata over a lexicon trie, with context windows (operator 7).

The lexicon is learnt from labelled rows: words, and stems of many words, that
occur in toxic texts far more often than chance allows for as many words as
were looked at. Its trie is intersected with Levenshtein automata (insertion,
deletion, substitution, swap): the product is made deterministic as words
arrive and its states are shared by all words, so a word that is near no term
leaves the automaton after a few letters. Spellings that clean training texts
use are not misspellings: each such word, and no other near word, is left out.
Around each hit a window of words is read: quotation marks and words of mention
make it a quotation, which counts less than abuse. A small logistic model turns
a text's hits into a score; it is fitted on hits that leave out only the clean
spellings of the other half of the texts, as for texts that were never seen.

Learning uses at most ``limit`` labelled rows in hash order of doc_id, written
once: the whole table is read for them and for the scores only. All their words
of LEAST letters or more are looked at, however long and however many. The
lexicon and the clean spellings come to the driver and go to the tasks; both are
bounded by the sample: a term's toxic texts outweigh chance over all words tried,
which takes some ten of the sample's texts each.

Null and empty texts have no hits; every row gets a score. Very long texts are
read whole. Repeated rows are scored separately; a doc_id that stands on several
texts gives its label to each. Equally near terms go by the alphabet. Without
labels of both classes every score is 0; an empty table gives an empty result.
Outputs take the place of ``keep`` columns of their names.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import discard, held_out, small_batches, training_rows, written
from logweir.llm.quality import map_texts

TRAINING_ROWS = 20_000
#: Letters of the shortest word that can be a term; below four a term is matched exactly.
LEAST = 3
THRESHOLD = 0.3
#: Least share of toxic texts among the training texts that hold a term.
PURITY = 0.9
WINDOW = 8
STEMS = range(4, 9)
CACHE_WORDS = 400_000
#: States of an automaton beyond which it is made anew.
CACHE_STATES = 200_000
WORD = re.compile(r"\w+")
#: Words of mention, fixed values.
MENTION = frozenset("said says say called calls quote quoted quotes quoting wrote writes term word words phrase mentioned meaning means cited".split())
QUOTES = '"“”«»„`'


def allowed(term: str) -> int:
    """Edits a term may be away: none below four letters, one below eight, two from there."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class TermAutomaton:
    """Deterministic product of a term trie and its Levenshtein automata, made on demand.

    A state is a set of (node, edits, owed): owed is the letter that a swap
    still has to see. Any letter may be edited, the first too. Stems match from
    the start of a word without edits.
    """

    DEAD = 0

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem, self.most = [None], [None], [0]
        for kind, words in (("term", terms), ("stem", stems)):
            for w in sorted(words):
                at, edits = 0, allowed(w) if kind == "term" else 0
                self.most[0] = max(self.most[0], edits)
                for c in w:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        for x in (self.children, self.term, self.stem, self.most):
                            x.append({} if x is self.children else 0 if x is self.most else None)
                    at = self.children[at][c]
                    self.most[at] = max(self.most[at], edits)
                getattr(self, kind)[at] = w
        self._clear()

    def _clear(self):
        self._sets, self._ids, self.steps, self.accept, self.sticky = [], {}, [], [], []
        self._state(frozenset(), None)
        self.start = self._state(self._close({(0, 0, "")}), None)

    def _close(self, items):
        todo, seen = list(items), set(items)
        while todo:
            node, e, owed = todo.pop()
            if owed or e >= self.most[node]:
                continue
            for nxt in self.children[node].values():
                item = (nxt, e + 1, "")
                if e + 1 <= self.most[nxt] and item not in seen:
                    seen.add(item)
                    todo.append(item)
        return frozenset(seen)

    def _state(self, items, sticky):
        key = items, sticky
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(items)
            self.steps.append({})
            best = min(((e, self.term[n]) for n, e, owed in items if not owed and self.term[n] and e <= allowed(self.term[n])), default=None)
            self.accept.append(best)
            self.sticky.append(sticky)
        return self._ids[key]

    def _step(self, state, c):
        out, sticky = set(), self.sticky[state]
        for node, e, owed in self._sets[state]:
            if owed:
                if c == owed:
                    out.add((node, e, ""))
                continue
            for letter, nxt in self.children[node].items():
                if letter == c:
                    out.add((nxt, e, ""))
                    if e == 0 and self.stem[nxt]:
                        sticky = self.stem[nxt]
                elif e < self.most[nxt]:
                    out.add((nxt, e + 1, ""))
                    if c in self.children[nxt]:
                        after = self.children[nxt][c]
                        if e < self.most[after]:
                            out.add((after, e + 1, letter))
            if e < self.most[node]:
                out.add((node, e + 1, ""))
        got = self._state(self._close(out), sticky)
        self.steps[state][c] = got
        return got

    def match(self, word: str):
        """(kind, term) of the nearest: 'term', 'near' or 'stem'; None if there is none."""
        state, steps = self.start, self.steps
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == self.DEAD:
                return None
        best, stem = self.accept[state], self.sticky[state]
        if best and best[0] == 0:
            return "term", best[1]
        if stem and len(word) > len(stem):
            return "stem", stem
        return ("near", best[1]) if best else None


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class ToxicModel:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    spellings: frozenset = frozenset()
    weights: np.ndarray | None = None


class Scorer:
    """Finds hits of a model in texts; words once seen are kept in a bounded table."""

    def __init__(self, model: ToxicModel, auto: TermAutomaton | None = None):
        self.model, self.auto, self.known = model, auto or TermAutomaton(model.terms, model.stems), {}

    def _trim(self):
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.auto.steps) > CACHE_STATES:
            self.auto._clear()

    def _match(self, word):
        got = self.auto.match(word)
        if got and got[0] == "near" and word in self.model.spellings:
            return None
        return got

    def hits(self, text: str | None) -> list[tuple[str, str, float]]:
        """(kind, term, quotation 0..1) of each hit."""
        words = words_of(text)
        distinct = set(words)
        for w in distinct:
            if w not in self.known:
                self.known[w] = self._match(w)
        found = [w for w in distinct if self.known[w]]
        if not found:
            self._trim()
            return []
        out, want = [], set(found)
        spans = [m.span() for m in WORD.finditer(text)]
        if len(spans) != len(words):  # lower-casing has split or joined a word
            spans = [m.span() for m in WORD.finditer(text.lower())]
        for i, w in enumerate(words):
            if w in want:
                a, b = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
                out.append((*self.known[w], quotation(text, a, *spans[i], b, words[max(0, i - WINDOW):i])))
        self._trim()
        return out

    def features(self, text: str | None) -> list[float]:
        sums = Counter()
        for kind, _, quoted in self.hits(text):
            sums[kind, quoted >= 0.5] += 1
        get = lambda k, q: sums[k, q]
        direct = [get(k, False) for k in ("term", "stem", "near")]
        return [1.0, *[float(n > 0) for n in direct], *[math.log1p(n) for n in direct], math.log1p(sum(get(k, True) for k in ("term", "stem", "near")))]


def quotation(text: str, a: int, start: int, end: int, b: int, before: list[str]) -> float:
    """How much a window reads as a quotation: marks on both sides, a quoted line, words of mention."""
    left, right = text[a:start], text[end:b]
    marks = any(q in left for q in QUOTES) and any(q in right for q in QUOTES) and sum(left.count(q) for q in QUOTES) % 2 == 1
    line = text[text.rfind("\n", 0, start) + 1:start].lstrip().startswith(">")
    mention = any(w in MENTION for w in before[-4:])
    return min(1.0, 0.7 * marks + 0.7 * line + 0.3 * mention)


def _evidence(docs: DataFrame) -> DataFrame:
    """token, n1, n0: training texts of each class that hold a word or a stem (with a *)."""

    def count(batches):
        for batch in batches:
            got = {1: Counter(), 0: Counter()}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = {w for w in words_of(text) if len(w) >= LEAST and not w.isdigit()}
                got[y].update(seen)
                got[y].update({w[:n] + "*" for w in seen for n in STEMS if len(w) > n})
            tokens = list(got[1].keys() | got[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([got[1][t] for t in tokens], pa.int64()), pa.array([got[0][t] for t in tokens], pa.int64())], ["token", "n1", "n0"])

    parts = small_batches(docs.select("y", "text")).mapInArrow(count, "token string, n1 long, n0 long")
    return parts.groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def choose_terms(rows: list[tuple[str, int, int]], base: float, tried: int) -> tuple[list[str], list[str]]:
    """Words and stems whose toxic counts chance explains with less than 5 % over all tried tokens."""

    def strong(n1, n0):
        n, rate = n1 + n0, n1 / (n1 + n0)
        gain = n1 * math.log(rate / base) + (n0 * math.log((1 - rate) / (1 - base)) if n0 else 0.0)
        return n1 >= 3 and rate >= max(PURITY, base + 0.5 * (1 - base)) and gain > math.log(max(tried, 2) / 0.05)

    good = {t: n1 for t, n1, n0 in rows if strong(n1, n0)}
    words = {t: n for t, n in good.items() if t[-1] != "*"}
    stems = {t[:-1]: n for t, n in good.items() if t[-1] == "*"}
    # A stem stands for several words: it has to be seen in far more texts than its commonest word.
    top = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                top[w[:k]] = max(top[w[:k]], n)
    stems = {s: n for s, n in stems.items() if n >= 2 * top[s]}
    # Of nested stems with nearly the same support, the longest; of those left, the shortest.
    longer = Counter()
    for s, n in stems.items():
        for k in range(min(STEMS), len(s)):
            longer[s[:k]] = max(longer[s[:k]], n)
    kept = {s for s, n in stems.items() if longer[s] < 0.9 * n}
    kept = {s for s in kept if not any(s[:k] in kept for k in range(min(STEMS), len(s)))}
    return sorted(w for w in words if not any(w[:k] in kept for k in STEMS)), sorted(kept)


def _fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.3)
    ridge[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w[1:] = np.maximum(w[1:], 0.0)  # a hit never speaks for a clean text
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> ToxicModel:
    rows = training_rows(labels, "toxic", limit)
    some = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id"), "toxic-sample")
    n = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        discard(some)
        return ToxicModel()
    base = n[1] / (n[1] + n[0])
    evidence = written(_evidence(some).filter("n1 + n0 >= 3"), "toxic-evidence")
    tried = evidence.count()
    rate = F.col("n1") / (F.col("n1") + F.col("n0"))
    # No term has less evidence than this, so the driver gets few more rows than terms.
    gain = F.col("n1") * F.log(rate / base)
    got = evidence.filter((F.col("n1") >= 3) & (rate >= PURITY) & (gain > math.log(max(tried, 2) / 0.05))).orderBy(F.col("n1").desc(), "token")
    terms, stems = choose_terms([tuple(r) for r in got.collect()], base, tried)
    discard(evidence)
    model = ToxicModel(terms, stems)

    # Spellings near a term that clean texts use are words of their own.
    def near(texts, held=[]):
        held or held.append(Scorer(model))
        rows = []
        for t in texts:
            rows.append([w for w in set(words_of(t)) if (m := held[0].auto.match(w)) and m[0] == "near"])
            held[0]._trim()
        return [pa.array(rows, pa.list_(pa.string()))]

    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    seen = map_texts(some.filter("y = 0"), near, "w array<string>", ["doc_id"]).select(F.explode("w").alias("w"), half.alias("half"))
    clean = seen.groupBy("w").agg(F.min("half").alias("lo"), F.max("half").alias("hi")).collect()
    model.spellings = frozenset(r["w"] for r in clean)
    others = [ToxicModel(terms, stems, frozenset(r["w"] for r in clean if r[side] == other)) for side, other in (("hi", 1), ("lo", 0))]

    def count(texts, held=[]):
        held or held.extend([one := Scorer(others[0]), Scorer(others[1], one.auto)])
        return [pa.array([s.features(t) for t in texts], pa.list_(pa.float64())) for s in held]

    x = map_texts(some, count, "x0 array<double>, x1 array<double>", ["doc_id", "y"]).select("y", F.when(half == 0, F.col("x0")).otherwise(F.col("x1")).alias("x"))
    x = x.groupBy("y", "x").agg(F.count("*").alias("n")).orderBy("y", "x").collect()
    discard(some)
    if {r["y"] for r in x} != {0, 1}:
        return ToxicModel()
    data = np.array([r["x"] for r in x]), np.array([r["y"] for r in x], float), np.array([r["n"] for r in x])
    model.weights = _fit_weights(np.repeat(data[0], data[2], axis=0), np.repeat(data[1], data[2]))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with score and n_hits."""

    def work(texts, held=[]):
        if model.weights is None:
            return [pa.array([0.0] * len(texts)), pa.array([0] * len(texts), pa.int64())]
        held or held.append(Scorer(model))
        x = np.array([held[0].features(t) for t in texts])
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -40, 40)))
        hits = np.rint(np.expm1(x[:, 4:8]).sum(axis=1)).astype(np.int64)
        return [pa.array(p), pa.array(hits)]

    return map_texts(docs, work, "score double, n_hits long", keep)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], limit: int = TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (doc_id among them) with held_out, score, predicted and n_hits for every row."""
    scored = score_toxicity(docs, train_toxicity(docs, labels, limit), keep)
    return scored.select(*keep, F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
