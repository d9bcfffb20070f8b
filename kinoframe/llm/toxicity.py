"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat verb, target, negation, reporting);
the insult lexicon, words and word stems with weights, is learned from
labelled texts. Transducers for negation, reported speech, targets and
threats are composed into one machine that reads a clause and says how each
matched word stands in it. A text's score is a logistic function of the
weights matched in each way; its coefficients are learned too.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.shards import (LOWER, POLY, WORD_BYTES, Block, annotate, byte_class, column_bytes, importable, written)


SAMPLE_DOCS = 20_000       # bound of the labelled sample that the model is fitted on
THRESHOLD = 0.3
MIN_SUPPORT, MIN_PRECISION = 8, 0.6
SHORT_STEM_PRECISION = 0.95   # of stems of three characters
CLAUSE_WORDS = 12          # how far a clause reaches on either side of a matched word
STEMS = (3, 4, 5, 6, 7, 8)

# Small closed word classes in the four languages of the corpus.
TARGETS = "you your yours u he she they them him her du dich dir ihr euch sie tu te toi vous eres usted ustedes tú ti".split()
NEGATIONS = "not never no isn aren don nicht kein keine nie pas jamais non nunca jamás tampoco".split()
REPORTING = ("said says wrote claimed reported called quoted sagte schrieb behauptete zitiert dit écrit affirmé "
             "dijo escribió afirmó citado").split()
THREATS = "kill hurt beat destroy stab shoot umbringen töten schlagen tuer frapper matar golpear".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED, AIMED, MENACE = range(10)
WAYS = (INSULT, NEGATED, REPORTED, AIMED, MENACE)
BREAK = byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


@dataclass(frozen=True)
class Transducer:
    """next[state][symbol] and out[state][symbol]; it starts at state 0."""

    next: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]

    def __rshift__(self, other: "Transducer") -> "Transducer":
        """The machine that gives this one's output to the other."""
        n, m = len(self.next), len(other.next)
        nxt, out = [], []
        for a, b in itertools.product(range(n), range(m)):
            mid = self.out[a]
            nxt.append(tuple(self.next[a][s] * m + other.next[b][mid[s]] for s in range(10)))
            out.append(tuple(other.out[b][mid[s]] for s in range(10)))
        return Transducer(tuple(nxt), tuple(out))

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            out.append(self.out[state][s])
            state = self.next[state][s]
        return out


def within(trigger: int, span: int | None, change: dict[int, int]) -> Transducer:
    """For ``span`` words after the trigger (None: to the clause's end)
    symbols are changed as the map says."""
    states = 2 if span is None else span + 1
    nxt, out = [], []
    for state in range(states):
        after = state if span is None else max(0, state - 1)
        nxt.append(tuple(states - 1 if s == trigger else after for s in range(10)))
        out.append(tuple(change.get(s, s) if state else s for s in range(10)))
    return Transducer(tuple(nxt), tuple(out))


GRAMMAR = (within(NEGATION, 3, {INSULT: NEGATED, THREAT: OTHER})
           >> within(REPORT, None, {INSULT: REPORTED, NEGATED: REPORTED, THREAT: OTHER})
           >> within(TARGET, 4, {INSULT: AIMED})
           >> within(THREAT, 3, {TARGET: MENACE}))


def _hash_of(words: list[str]) -> np.ndarray:
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    return np.array([int(POLY.spans(r, np.array([0]), np.array([len(r)]))[0]) for r in raw], np.uint64)


class Lookup:
    """Fingerprint -> value, for many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.low = np.zeros(1 << 16, bool)
        self.low[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def get(self, marks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(marks), self.values.dtype)
        if not len(self.keys):
            return out
        at = np.flatnonzero(self.low[(marks & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, marks[at]), len(self.keys) - 1)
        same = self.keys[k] == marks[at]
        out[at[same]] = self.values[k[same]]
        return out


@dataclass
class Model:
    """Lexicon (feature -> weight; a stem ends in '*') and coefficients."""

    lexicon: dict[str, float]
    coefficients: np.ndarray

    def __post_init__(self) -> None:
        self._tables = None

    def tables(self):
        if self._tables is None:
            forms = [w for w in self.lexicon if not w.endswith("*")]
            table = {0: Lookup(_hash_of(forms), np.array([self.lexicon[w] for w in forms], float))}
            for n in STEMS:
                stems = [w for w in self.lexicon if w.endswith("*") and len(w) == n + 1]
                table[n] = Lookup(_hash_of([w[:-1] for w in stems]), np.array([self.lexicon[w] for w in stems], float))
            classes = [(w, s) for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTING, REPORT),
                                               (THREATS, THREAT)) for w in words]
            symbols = Lookup(_hash_of([w for w, _ in classes]), np.array([s for _, s in classes], np.int64))
            self._tables = table, symbols
        return self._tables

    def __getstate__(self):
        return {"lexicon": self.lexicon, "coefficients": self.coefficients, "_tables": None}

    def features(self, block: Block) -> np.ndarray:
        """For each text the log of the weights matched in each way, and of the
        weight in a hundred words."""
        lexicon, symbols = self.tables()
        data = LOWER[block.data]
        starts, ends = block.runs(WORD_BYTES[data])
        first_word = np.searchsorted(starts, block.off)
        letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(letters, starts)
        used = [n for n in STEMS if len(lexicon[n].keys)]
        stops = [np.minimum(letters[np.minimum(first + n, len(letters) - 1)], ends) for n in used]
        marks, *stems = POLY.prefixes(data, starts, ends, stops)
        weight = lexicon[0].get(marks)
        for n, stop, stem in zip(used, stops, stems):
            longer = np.flatnonzero(stop < ends)   # a stem is followed by more
            weight[longer] = np.maximum(weight[longer], lexicon[n].get(stem[longer]))
        kinds = symbols.get(marks)
        centre = np.flatnonzero((weight > 0) | (kinds == THREAT))
        out = np.zeros((block.n, len(WAYS) + 1))
        if not len(centre):
            return out
        breaks = np.concatenate([np.flatnonzero(BREAK[data]), block.off])
        breaks.sort()
        cut = np.searchsorted(breaks, starts[centre], "right")
        lo = np.searchsorted(starts, breaks[cut - 1])
        hi = np.searchsorted(starts, breaks[np.minimum(cut, len(breaks) - 1)])
        lo, hi = np.maximum(lo, centre - CLAUSE_WORDS), np.minimum(hi, centre + CLAUSE_WORDS + 1)
        doc = np.searchsorted(first_word, centre, "right") - 1
        at = {w: k for k, w in enumerate(WAYS)}
        for c, a, b, d in zip(centre.tolist(), lo.tolist(), hi.tolist(), doc.tolist()):
            marked = [INSULT if w else k for w, k in zip(weight[a:b].tolist(), kinds[a:b].tolist())]
            # only this word counts, the clause says how it stands
            said = GRAMMAR.run([s if s != INSULT or a + j == c else OTHER for j, s in enumerate(marked)])
            if weight[c] > 0:
                out[d, at[said[c - a]]] += weight[c]
            elif MENACE in said[c - a:]:
                out[d, at[MENACE]] += 1.0
        out[:, -1] = 100 * out.sum(axis=1) / np.maximum(np.diff(first_word), 1)
        return np.log1p(out)

    def score(self, block: Block) -> np.ndarray:
        x = self.features(block) @ self.coefficients[1:] + self.coefficients[0]
        return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def held_out(id_col) -> F.Column:
    """Rows that the model must not learn from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features_of(text: str) -> list[str]:
    words = WORD.findall(text.translate(ASCII_LOWER))
    return words + [w[:n] + "*" for w in words for n in STEMS if len(w) > n]


def _texts(batches):
    for batch in batches:
        off, raw = column_bytes(batch.column("__text"))
        toxic = batch.column("__toxic").to_pylist()
        for i, t in enumerate(toxic):
            yield raw[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"), t


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    sample_docs: int) -> DataFrame:
    """About ``sample_docs`` distinct labelled texts at most, chosen by a hash
    of their id, never of the held-out fold; contradicting labels of an id
    count as toxic."""
    marked = (labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
              .groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("__toxic"))
              .where(~held_out(F.col("__id"))))
    n = marked.count()
    share = int(min(1.0, sample_docs / max(n, 1)) * 2**31)
    chosen = marked.where(F.pmod(F.xxhash64("__id"), F.lit(2**31)) < share)
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    got = texts.join(chosen, "__id").where("__text is not null")
    return got.groupBy(F.sha2("__text", 256).alias("__sha")).agg(F.first("__text").alias("__text"),
                                                                F.max("__toxic").alias("__toxic")).drop("__sha")


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """The lexicon and coefficients, from a bounded labelled sample.

    A word or stem enters if nearly all texts with it are toxic, and if it
    stands in enough distinct contexts: a passage that is copied many times
    counts once."""
    importable(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, id_col, text_col, label_col, sample_docs), "toxic-sample")

    def count(batches):
        n, k = Counter(), Counter()
        for text, toxic in _texts(batches):
            f = set(_features_of(text))
            n.update(f)
            if toxic:
                k.update(f)
        keys = list(n)
        for lo in range(0, len(keys), 50_000):
            part = keys[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([n[x] for x in part]),
                                              pa.array([k[x] for x in part])], names=["feature", "n", "k"])

    counts = (sample.mapInArrow(count, "feature string, n long, k long").groupBy("feature")
              .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
              .where((F.col("n") >= MIN_SUPPORT) & (F.col("k") >= F.col("n") * F.when(
                  F.col("feature").endswith("*") & (F.length("feature") == 4), SHORT_STEM_PRECISION)
                  .otherwise(MIN_PRECISION))))
    candidates = {r[0]: (r[1], r[2]) for r in counts.collect()}   # bounded by the sample

    def contexts(batches):
        seen: set[tuple[str, int]] = set()
        for text, toxic in _texts(batches):
            words = ["", *WORD.findall(text.translate(ASCII_LOWER)), ""]
            for a, w, b in zip(words, words[1:], words[2:]):
                for f in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
                    if f in candidates:
                        seen.add((f, a + " " + b))
        seen = sorted(seen)
        for lo in range(0, len(seen), 50_000):
            part = seen[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part]), pa.array([c for _, c in part])],
                                             names=["feature", "context"])

    support = {r[0]: r[1] for r in sample.mapInArrow(contexts, "feature string, context string").distinct()
               .groupBy("feature").count().collect()}
    row = sample.agg(F.count(F.lit(1)), F.sum("__toxic")).first()
    total, toxic = int(row[0]), int(row[1] or 0)
    lexicon = {}
    for f, (n, k) in candidates.items():
        if support.get(f, 0) >= MIN_SUPPORT:
            odds = math.log((k + 0.5) / (toxic + 1)) - math.log((n - k + 0.5) / (total - toxic + 1))
            if odds > 1:
                lexicon[f] = odds - 1
    model = Model(lexicon, np.zeros(2 + len(WAYS)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = annotate(sample, "__text", [("__x", T.ArrayType(T.DoubleType()))],
                    lambda b: {"__x": list(shared.value.features(b))}, keep=["__toxic"]).collect()
    x = np.array([r["__x"] for r in rows]).reshape(len(rows), len(WAYS) + 1)
    model.coefficients = fit_logistic(x, np.array([r["__toxic"] for r in rows], float))
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; a way of
    matching never lowers a score. Without rows the score is low throughout."""
    if not len(y):
        return np.array([-3.0] + [1.0] * x.shape[1])
    a = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    prior = np.array([0.0] + [1.0] * x.shape[1])
    w = np.array([-2.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty @ (w - prior)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", keep: list[str] | None = None, threshold: float = THRESHOLD,
                   sample_docs: int = SAMPLE_DOCS, model: Model | None = None) -> DataFrame:
    """``docs`` with held_out, score and predicted of each whole text.

    Only the text makes a score. Null and empty texts get the score of a text
    without matches; equal texts get equal scores; a null id is not held out.
    Without labels (or without toxic ones) the lexicon is empty and all
    scores are low. Result columns replace input columns of their names.
    """
    model = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col,
                  sample_docs=sample_docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)   # bounded by the sample

    def work(block: Block) -> dict:
        s = shared.value.score(block)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    clash = [c for c in docs.columns if c.lower() in ("held_out", "score", "predicted")]
    marked = docs.drop(*clash).withColumn("held_out", held_out(F.col(f"`{id_col}`")))
    return annotate(marked, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], work,
                    None if keep is None else keep + ["held_out"])
