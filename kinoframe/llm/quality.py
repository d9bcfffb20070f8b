"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample; the rules then
run in the order of rejections per cost, each only on the texts that the
ones before it let pass. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.parity_join import word_hashes
from kinoframe.llm.shards import (SOLID_BYTES, Block, Words, annotate, blocks, byte_class, importable, ngram_starts,
                                  ngrams, spread)

SAMPLE_ROWS = 2000
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
NEWLINE = 0x0A

BASE = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
        ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType())]
RESULT = BASE + [("kept", T.BooleanType()), ("failed_rule", T.StringType())]


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=s[1:])
    return s[off[1:]] - s[off[:-1]]


class Texts:
    """Measures of some texts of a block, each computed when first asked for."""

    def __init__(self, block: Block, chosen: np.ndarray | None = None):
        if chosen is not None and len(chosen) < block.n:
            size = np.diff(block.off)[chosen]
            data = block.data[spread(block.off[chosen], size)]
            block = Block(0, len(chosen), data, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        self.block, self._words = block, None

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = self.block.words(SOLID_BYTES, lower=False)
        return self._words

    def n_words(self) -> np.ndarray:
        return self.words.counts.astype(np.int64)

    def word_chars(self) -> np.ndarray:
        b = self.block
        return _sums(SOLID_BYTES[b.data] & ((b.data & 0xC0) != 0x80), b.off)

    def n_symbols(self) -> np.ndarray:
        return _sums(SYMBOLS[self.block.data], self.block.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, fingerprint and place order of the lines that hold a word."""
        b = self.block
        cut = np.flatnonzero(b.data == NEWLINE)
        starts = np.unique(np.concatenate([b.off[:-1], cut + 1]))
        starts = starts[starts < len(b.data)]
        if not len(starts):
            return starts, np.zeros(0, np.uint64), starts
        ends = np.minimum(np.append(starts[1:], len(b.data)), len(b.data))
        # a line ends before its newline; one that a text's end cuts has none
        ends = ends - (b.data[ends - 1] == NEWLINE)
        solid = np.searchsorted(self.words.starts, ends) > np.searchsorted(self.words.ends, starts, "right")
        starts, ends = starts[solid], ends[solid]
        return b.doc_of(starts), word_hashes(b.data, starts, ends), starts

    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines()[0], minlength=self.block.n)

    def n_dup_lines(self) -> np.ndarray:
        doc, mark, _ = self.lines()
        order = np.lexsort((mark, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (mark[order][1:] == mark[order][:-1])
        return np.bincount(doc[order][1:][same], minlength=self.block.n)

    def n_repeat_words(self) -> np.ndarray:
        w, docs = self.words, self.words.docs()
        at = ngram_starts(w.first, 3)
        mark = ngrams(w.hash, 3)[at] if len(at) else np.zeros(0, np.uint64)
        # a text's mark, mixed into the window's: equal ones are of one text
        own = mark ^ ((docs[at] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(w.hash) + 2, bool)
        for j in range(3):
            covered[at[twice] + j] = True
        return np.bincount(docs[covered[:len(docs)]], minlength=self.block.n) if len(docs) \
            else np.zeros(self.block.n, np.int64)

    def total(self, member: np.ndarray) -> np.ndarray:
        return _sums(member[self.block.data], self.block.off)

    def share(self, member: np.ndarray, of: np.ndarray) -> np.ndarray:
        return self.total(member) / np.maximum(self.total(of), 1)


UPPER = byte_class((0x41, 0x5A))
ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
# a character's first byte, of any; of a letter or a character beyond ASCII
FIRST = byte_class((0x00, 0x7F), (0xC2, 0xF4))
LETTER = ASCII_LETTER | byte_class((0xC2, 0xF4))
ASCII_SOLID = SOLID_BYTES & byte_class((0x00, 0x7F))
MARK = byte_class((0x21, 0x21), (0x3F, 0x3F))


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``fails`` is true."""

    name: str
    fails: Callable[[Texts], np.ndarray]


RULES = [
    Rule("few_words", lambda t: t.n_words() < MIN_WORDS),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words() > 50 * t.n_words()),
    Rule("symbols_per_word", lambda t: t.n_symbols() > 0.3 * t.n_words()),
    Rule("exclamations_per_word", lambda t: t.total(MARK) > 0.5 * t.n_words()),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines() > 5 * np.maximum(t.n_lines(), 1)),
    Rule("upper_case", lambda t: t.share(UPPER, ASCII_LETTER) > 0.7),
    Rule("few_letters", lambda t: t.share(LETTER, SOLID_BYTES & FIRST) < 0.4),
    # scripts without blanks have long words, and characters of several bytes that say more
    Rule("word_length", lambda t: (t.total(ASCII_SOLID) > 25 * t.n_words()) | (t.total(SOLID_BYTES) < 2 * t.n_words())),
]


def estimate(docs: DataFrame, text_col: str, rules: list[Rule], sample_rows: int) -> list[dict]:
    """Seconds a text and share rejected of each rule, on about
    ``sample_rows`` texts drawn from all partitions (every rule sees the
    whole sample). Tasks send two sums for each rule."""
    total = docs.count()
    sample = docs.sample(min(1.0, sample_rows / max(total, 1)), seed=5) if total > sample_rows else docs
    importable(docs.sparkSession)
    text = sample.select(F.col(f"`{text_col}`").cast("string").alias("__text"))

    def work(batches):
        import pyarrow as pa
        for batch in batches:
            for block in blocks(batch, "__text"):
                rows = []
                for rule in rules:
                    began = time.perf_counter()
                    failed = int(rule.fails(Texts(block)).sum())
                    rows.append({"rule": rule.name, "cost": time.perf_counter() - began, "failed": failed,
                                 "n": block.n})
                yield pa.RecordBatch.from_pylist(rows)

    got = text.mapInArrow(work, "rule string, cost double, failed long, n long")
    sums = {r["rule"]: r for r in got.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("failed").alias("failed"),
                                                          F.sum("n").alias("n")).collect()}
    return [{"rule": r.name, "cost": sums[r.name]["cost"] / sums[r.name]["n"],
             "rejects": sums[r.name]["failed"] / sums[r.name]["n"]} if r.name in sums
            else {"rule": r.name, "cost": 0.0, "rejects": 0.0} for r in rules]


def order_rules(rules: list[Rule], figures: list[dict]) -> list[Rule]:
    """Most rejections for the cost first; ties in the order given."""
    gain = {f["rule"]: f["rejects"] / max(f["cost"], 1e-9) for f in figures}
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(block: Block, rules: list[Rule]) -> list[str | None]:
    """The first rule in the list's order that rejects each text."""
    failed: list[str | None] = [None] * block.n
    alive = np.arange(block.n)
    for rule in rules:
        if not len(alive):
            break
        bad = rule.fails(Texts(block, alive))
        for i in alive[bad].tolist():
            failed[i] = rule.name
        alive = alive[~bad]
    return failed


def quality(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None,
            sample_rows: int = SAMPLE_ROWS, measures: bool = True) -> DataFrame:
    """``docs`` with ``kept``, ``failed_rule`` and, if ``measures``, the base
    counts of each whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``. base_failed: under 50 words, or over
    half of them in 3-word windows that occur twice. A base failure always
    rejects; the other rules only texts that pass. Null and empty texts have
    no words and fail. failed_rule names one rule that rejects (which of
    several depends on the measured order; kept does not). Equal rows get
    equal verdicts; an empty table stays empty.
    """
    rules = RULES if rules is None else rules
    ordered = order_rules(rules, estimate(docs, text_col, rules, sample_rows))

    def work(block: Block) -> dict:
        if not measures:
            failed = cascade(block, ordered)
            return {"kept": [f is None for f in failed], "failed_rule": failed}
        t = Texts(block)
        words, repeat = t.n_words(), t.n_repeat_words()
        base_failed = (words < MIN_WORDS) | (100 * repeat > 50 * words)
        # what is measured anyway decides first; the rest of the cascade sees only what is left
        alive = np.flatnonzero(~base_failed)
        failed = np.array([None] * block.n, object)
        failed[base_failed] = "base"
        if len(alive):
            rest = Texts(block, alive).block
            failed[alive] = cascade(rest, [r for r in ordered if r.name not in ("few_words", "repeated_words")])
        return {"n_words": words, "word_chars": t.word_chars(), "n_symbols": t.n_symbols(),
                "n_dup_lines": t.n_dup_lines(), "n_repeat_words": repeat, "base_failed": base_failed,
                "kept": [f is None for f in failed], "failed_rule": list(failed)}

    return annotate(docs, text_col, RESULT if measures else RESULT[-2:], work, keep)
