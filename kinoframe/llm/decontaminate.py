"""Benchmark decontamination with training suffix arrays.

Every block of training texts is a shard: its words get a suffix array
(prefix doubling, by the first 16 words), every benchmark suffix is found in
it by binary search, word by word, and each place where one of an item's
windows occurs is a verbatim match, which is then extended to its longest
form. The benchmark is the stated query set: it goes to the shards in blocks
of a bounded size, so neither its size nor that of the corpus meets a limit.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.shards import Block, annotate, blob, spread

WINDOW = 10
QUERY_BLOCK_BYTES = 16 << 20

RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()),
          ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()),
          ("longest_match", T.LongType()), ("longest_item", T.StringType()), ("longest_at", T.LongType())]


@dataclass
class Queries:
    """A block of benchmark items: words, and the windows to look up."""

    ids: list[str]
    words: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    item: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, bytes]], window: int) -> "Queries":
        words = [np.frombuffer(w, np.uint64) for _, w in rows]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        n = np.diff(first)
        windows = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        starts = spread(first[:-1], windows)
        item = np.repeat(np.arange(len(n)), windows)
        return Queries([i for i, _ in rows], np.concatenate(words) if words else np.zeros(0, np.uint64),
                       first, starts, np.minimum(n, window)[item], item)


def suffix_array(ranks: np.ndarray, pad: int, depth: int = 16) -> np.ndarray:
    """Positions by the ``depth`` words that follow them. ``ranks`` ends in
    ``pad`` zeros; a zero also ends each text, and no query holds one."""
    n = len(ranks) - pad
    rank, step, order = ranks.astype(np.int64), 1, None
    while step < depth:
        key = rank[:n] * np.int64(n + 2)
        key += np.concatenate([rank[step:n], np.zeros(min(step, n), np.int64)])
        order = np.argsort(key)
        step *= 2
        if step < depth:
            new = np.ones(n, np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
    return order


def _bound(sa, ranks, lo, hi, depth, want, right):
    """First place in [lo, hi) whose word at ``depth`` is not below (or, to
    the right, is above) the wanted one; all searches step together."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        word = ranks[sa[mid] + depth]
        below = word <= want[open_] if right else word < want[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def find(sa: np.ndarray, ranks: np.ndarray, values: np.ndarray, q: Queries):
    """(window, place) of each occurrence, and the length each extends to."""
    at = np.searchsorted(values, q.words)
    at[at == len(values)] = 0
    want = np.where(values[at] == q.words, at + 1, 0) if len(values) else np.zeros(len(q.words), np.int64)
    absent = np.concatenate([[0], np.cumsum(want == 0)])
    live = np.flatnonzero(absent[q.starts + q.sizes] == absent[q.starts])
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    for depth in range(int(q.sizes.max(initial=0))):
        go = np.flatnonzero(q.sizes[live] > depth)
        if not len(go):
            break
        w = want[q.starts[live[go]] + depth]
        left = _bound(sa, ranks, lo[go], hi[go], depth, w, False)
        hi[go] = _bound(sa, ranks, left, hi[go], depth, w, True)
        lo[go] = left
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
    place = sa[spread(lo, hi - lo)]
    window = np.repeat(live, hi - lo)
    length = q.sizes[window].copy()
    start, end = q.starts[window], q.first[q.item[window] + 1]
    grow = np.arange(len(place))
    while len(grow):
        grow = grow[start[grow] + length[grow] < end[grow]]
        nxt = want[start[grow] + length[grow]]
        same = (nxt > 0) & (ranks[np.minimum(place[grow] + length[grow], len(ranks) - 1)] == nxt)
        grow = grow[same]
        length[grow] += 1
    return window, place, length


def _answer(block: Block, sources: list, window: int) -> dict:
    words = block.words()
    counts, n_docs = words.counts, block.n
    # a zero after each text, and room for a look beyond the last one
    values, dense = np.unique(words.hash, return_inverse=True)
    where = np.arange(len(words.hash)) + words.docs()
    pad = max(window, 16) + 1
    ranks = np.zeros(len(words.hash) + n_docs + pad, np.int64)
    ranks[where] = dense + 1
    first = words.first + np.arange(n_docs + 1)
    sa = suffix_array(ranks, pad, max(16, window)) if len(where) else np.zeros(0, np.int64)
    hit = np.zeros(len(ranks) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    best: list[tuple[int, str, int]] = [(0, "", 0)] * n_docs
    for source in sources if len(where) else []:
        q = source.value
        found, place, length = find(sa, ranks, values, q)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + q.sizes[found], -1)
        doc = np.searchsorted(first, place, "right") - 1
        if len(doc):
            pairs = np.unique(doc * np.int64(len(q.ids)) + q.item[found])
            for p in pairs.tolist():
                items[p // len(q.ids)].add(q.ids[p % len(q.ids)])
            order = np.lexsort((place, -length, doc))
            for i in order[np.flatnonzero(np.diff(doc[order], prepend=-1))].tolist():
                d = int(doc[i])
                new = (-int(length[i]), q.ids[q.item[found[i]]], int(place[i] - first[d]))
                if best[d][0] == 0 or new < (-best[d][0], best[d][1], best[d][2]):
                    best[d] = (-new[0], new[1], new[2])
        del q
    covered = np.cumsum(hit)[:len(ranks)] > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    n_hit = sums[first[1:]] - sums[first[:-1]]
    return {"n_words": counts.astype(np.int64), "n_hit": n_hit.astype(np.int64),
            "n_items": np.array([len(s) for s in items], np.int64),
            "items_sha256": [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items],
            "contaminated": n_hit > 0, "longest_match": np.array([b[0] for b in best], np.int64),
            "longest_item": pa.array([b[1] if b[0] else None for b in best], pa.string()),
            "longest_at": pa.array([b[2] if b[0] else None for b in best], pa.int64())}


def query_blocks(bench: DataFrame, item_col: str, text_col: str, window: int,
                 block_bytes: int = QUERY_BLOCK_BYTES) -> list:
    """The benchmark as broadcast blocks of about ``block_bytes`` each: its
    size is measured first, and the driver holds one block at a time."""
    def hashes(block: Block) -> dict:
        w = block.words()
        return {"__words": [blob(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]}
    ids = bench.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("__item"),
                       F.col(f"`{text_col}`").alias("__text"))
    items = annotate(ids, "__text", [("__words", T.BinaryType())], hashes, keep=["__item"]).where("length(__words) > 0")
    total = ids.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / block_bytes))
    sc = bench.sparkSession.sparkContext
    out = []
    for b in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("__words"), F.lit(parts)) == b)
        rows = [(r[0], bytes(r[1])) for r in part.collect()]
        out.append(sc.broadcast(Queries.of(sorted(rows), window)))
    return out


def match_benchmark(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None,
                    query_block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """``docs`` with what each text shares with the benchmark.

    A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are
    lower-cased. A window is ``window`` consecutive words of an item, or the
    whole of a shorter one. Adds n_words, n_hit (words inside any occurrence
    of a window), n_items, items_sha256 (ids as strings, sorted,
    comma-joined), contaminated, and the longest verbatim match with its
    item and first word. Null and empty texts have no words and no matches;
    items without words match nothing; a null item id counts as ''; rows that
    repeat are answered each for itself; ties for the longest match go to the
    smallest item id, then the first place. Empty tables give no matches.
    """
    sources = query_blocks(bench, item_col, item_text_col, window, query_block_bytes)
    return annotate(docs, text_col, RESULT, lambda b: _answer(b, sources, window), keep)


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark match, columns unchanged."""
    ids = {n.lower() for n, _ in RESULT}
    names = [c for c in docs.columns if c.lower() in ids]
    free = docs.withColumnsRenamed({c: f"__kept_{c}" for c in names})
    text = options.pop("text_col", "text")
    got = match_benchmark(free, bench, text_col=f"__kept_{text}" if text in names else text, **options)
    back = {f"__kept_{c}": c for c in names}
    return (got.where(~F.col("contaminated")).select(*free.columns).withColumnsRenamed(back))
