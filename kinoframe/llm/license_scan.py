"""Licence scan with a positional rare-token index.

The notices' words are weighted by their inverse document frequency over all
documents. Of each notice the rarest words, and of each mandatory phrase its
rarest word, are indexed with their positions. A file's indexed words are
looked up; postings that agree on where the notice would begin vote for that
place. Where enough of a notice's rare words agree, its mandatory phrase is
verified word by word; a phrase that is quoted without its notice gives no
label, unless it is a base one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.shards import POLY, Block, annotate

RARE_WORDS = 6
MIN_SHARE = 0.75    # of a notice's rare words that must stand in place

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence notices (words only), each with a phrase that must stand in the text.
NOTICES = [
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
            " hereby granted", "distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]

RESULT = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()),
          ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()),
          ("score", T.DoubleType())]


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(POLY.spans(raw, np.array([0]), np.array([len(raw)]))[0])


def document_frequency(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """In how many texts (of all) each word of a small vocabulary stands.

    A task sends one row of counts for each block: nothing grows with a word's
    frequency."""
    keys = np.array([word_hash(w) for w in vocabulary], np.uint64)
    order = np.argsort(keys)

    def work(block: Block) -> dict:
        w = block.words()
        known = np.flatnonzero(_member(w.hash, keys[order]))
        doc = np.searchsorted(w.first, known, "right") - 1
        which = order[np.searchsorted(keys[order], w.hash[known])]
        pairs = np.unique(doc * len(keys) + which)
        n = np.bincount(pairs % len(keys), minlength=len(keys))
        rows: list = [None] * block.n
        if rows:
            rows[0] = n
        return {"__n": rows}

    counts = annotate(docs.select(F.col(f"`{text_col}`").alias("__text")), "__text",
                      [("__n", T.ArrayType(T.LongType()))], work, keep=[])
    row = counts.agg(F.count(F.lit(1)), *[F.sum(F.get("__n", F.lit(k))) for k in range(len(keys))]).first()
    return row[0], {w: int(n or 0) for w, n in zip(vocabulary, row[1:])}


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is among few: a table of the low 16 bits first."""
    low = np.zeros(1 << 16, bool)
    low[ordered & np.uint64(0xFFFF)] = True
    out = low[values & np.uint64(0xFFFF)]
    at = np.flatnonzero(out)
    k = np.minimum(np.searchsorted(ordered, values[at]), len(ordered) - 1)
    out[at] = ordered[k] == values[at]
    return out


@dataclass
class Phrase:
    words: np.ndarray
    anchor: int          # place of its rarest word
    label: str
    base: bool
    notice: int          # -1: a base phrase for itself


class Index:
    """Postings of the rarest words of notices and phrases."""

    def __init__(self, idf: dict[str, float], notices=NOTICES, base=BASE, rare_words: int = RARE_WORDS,
                 found: set[str] | None = None):
        rarest = lambda words: max(range(len(words)), key=lambda k: (idf[words[k]], -k))
        hashes = lambda words: np.array([word_hash(w) for w in words], np.uint64)
        self.phrases: list[Phrase] = []
        for text, label in base.items():
            words = text.split()
            self.phrases.append(Phrase(hashes(words), rarest(words), label, True, -1))
        self.notices: list[tuple[str, int, int]] = []   # label, rare words, place of the phrase
        postings: list[tuple[int, int, int]] = []       # word, notice, place
        for n, (label, text, phrase) in enumerate(notices):
            words, must = text.split(), phrase.split()
            at = next(k for k in range(len(words)) if words[k:k + len(must)] == must)
            # a word that stands in no text can vote nowhere
            some = [k for k in range(len(words)) if found is None or words[k] in found]
            top = sorted(some, key=lambda k: (-idf[words[k]], k))[:rare_words]
            self.notices.append((label, len(top), at))
            postings += [(word_hash(words[k]), n, k) for k in top]
            self.phrases.append(Phrase(hashes(must), rarest(must), label, False, n))
        postings.sort()
        self.post_word = np.array([p[0] for p in postings], np.uint64)
        self.post_notice = np.array([p[1] for p in postings], np.int64)
        self.post_place = np.array([p[2] for p in postings], np.int64)
        anchors = [p.words[p.anchor] for p in self.phrases]
        self.looked_up = np.unique(np.concatenate([self.post_word, np.array(anchors, np.uint64)]))

    def scan(self, block: Block) -> dict:
        w = block.words()
        at = np.flatnonzero(_member(w.hash, self.looked_up))   # the files' rare licence words
        word, doc = w.hash[at], np.searchsorted(w.first, at, "right") - 1
        first, end = w.first[doc], w.first[doc + 1]
        # votes: postings that agree on where a notice begins
        lo = np.searchsorted(self.post_word, word, "left")
        n = np.searchsorted(self.post_word, word, "right") - lo
        k = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        begin = np.repeat(at, n) - self.post_place[k] + 4096   # may lie before the text
        vote, votes = np.unique(begin * len(self.notices) + self.post_notice[k], return_counts=True)
        n_base, first_at = np.zeros(block.n, np.int64), np.full(block.n, np.iinfo(np.int64).max)
        last_at = np.full(block.n, -1, np.int64)
        base: list[set[str]] = [set() for _ in range(block.n)]
        labels: list[set[str]] = [set() for _ in range(block.n)]
        score = np.zeros(block.n)
        for p in self.phrases:
            hit = word == p.words[p.anchor]
            start, stop = at[hit] - p.anchor, at[hit] - p.anchor + len(p.words)
            ok = (start >= first[hit]) & (stop <= end[hit])
            start, d = start[ok], doc[hit][ok]
            if not p.base:
                _, rare, place = self.notices[p.notice]
                key = (start - place + 4096) * len(self.notices) + p.notice
                j = np.searchsorted(vote, key)
                j[j == len(vote)] = 0
                share = np.where(vote[j] == key, votes[j], 0) / max(rare, 1) if len(vote) else np.zeros(len(start))
                np.maximum.at(score, d, share)
                agreed = share >= MIN_SHARE
                start, d = start[agreed], d[agreed]
            for j, h in enumerate(p.words):
                same = w.hash[start + j] == h
                start, d = start[same], d[same]
            if not len(start):
                continue
            if p.base:
                n_base += np.bincount(d, minlength=block.n)
                np.minimum.at(first_at, d, start - w.first[d])
                np.maximum.at(last_at, d, start - w.first[d])
                score[d] = 1.0
                for i in np.unique(d).tolist():
                    base[i].add(p.label)
                    labels[i].add(p.label)
            else:
                for i in np.unique(d).tolist():
                    labels[i].add(p.label)
        some = n_base > 0
        where = lambda a: [int(v) if s else None for v, s in zip(a, some)]
        return {"n_words": w.counts.astype(np.int64), "n_base": n_base, "first_word": where(first_at),
                "last_word": where(last_at), "base_labels": [",".join(sorted(b)) for b in base],
                "labels": [",".join(sorted(x)) for x in labels], "score": np.minimum(score, 1.0)}


def scan_licenses(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None,
                  rare_words: int = RARE_WORDS) -> DataFrame:
    """``docs`` with the licence notices of each whole text.

    Adds n_words, n_base (places where a base phrase's words stand
    consecutively), first_word and last_word (smallest and largest start of
    such a place; null without one), base_labels, labels (those of notices
    too whose rare words agree on a place and whose phrase stands there) and
    score (1 with a base phrase, else the best share of a notice's rare words
    in place). Null and empty texts have
    no words, no labels and score 0. Words of equal rarity are taken in the
    notice's order; equal rows get equal answers. An empty table has no
    frequencies and no words to look up.
    """
    vocabulary = sorted({w for _, t, _ in NOTICES for w in t.split()} | {w for t in BASE for w in t.split()})
    total, df = document_frequency(docs, text_col, vocabulary)
    index = Index({w: math.log((total + 1) / (n + 1)) for w, n in df.items()}, rare_words=rare_words,
                  found={w for w, n in df.items() if n})
    shared = docs.sparkSession.sparkContext.broadcast(index)   # bounded by the notices above
    return annotate(docs, text_col, RESULT, lambda b: shared.value.scan(b), keep)
