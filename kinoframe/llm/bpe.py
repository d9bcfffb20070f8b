"""Byte-pair encoding by backtracking, and decoding by an offset table.

A pre-token's bytes are cut greedily into the longest vocabulary entries (an
Aho-Corasick automaton over the entries gives them); an entry may follow
another only if the two, merged from their bytes by rank, would stay the two
they are. That compatibility is kept in a table of pairs, filled on first
use. Where a cut cannot go on, the last entry gives way to its next shorter
prefix. Every place is tried once, so the work is linear, and the result is
the one that merging by rank gives. Decoding gathers each id's bytes from
one byte string by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinoframe.llm.shards import POLY, Block, annotate, spread

# How byte-level vocabularies split text before merging.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
LOCKSTEP_BYTES = 64
PAIR_SLOTS = 1 << 20

RESULT = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    out = np.zeros(0x110000, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start():m.end()]] = kind
    return out


def pre_tokens(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts (code points cuts[i]..cuts[i + 1]):
    what PRE_TOKEN finds, by runs of one class.

    A white-space run before something gives its last character away: a blank
    joins what follows, any other stands alone. An apostrophe that starts a
    token takes the letters of a contraction with it.
    """
    n = len(points)
    kind = point_classes()[points]
    edge = np.zeros(n + 3, bool)  # where a text starts (or all ends)
    edge[cuts] = True
    edge[n:] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind == SPACE) & start[1:n + 1] & ~edge[1:n + 1])
    blank = points[last] == 32
    start[last] = True
    start[last[blank] + 1] = False
    quote = np.flatnonzero((points == 39) & start[:n] & start[1:n + 1] & ~edge[1:n + 1])
    padded = np.append(points, np.zeros(3, points.dtype))
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~edge[quote + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
                               | (one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    return np.flatnonzero(start[:n])


class Matches:
    """Aho-Corasick automaton whose steps many strings take together."""

    def __init__(self, entries: dict[bytes, int]):
        goto: list[dict[int, int]] = [{}]
        ends, depth = [-1], [0]
        for word, i in entries.items():
            node = 0
            for c in word:
                nxt = goto[node].get(c)
                if nxt is None:
                    nxt = goto[node][c] = len(goto)
                    goto.append({})
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                node = nxt
            ends[node] = i
        fail, shorter = [0] * len(goto), [0] * len(goto)
        queue = list(goto[0].values())
        for node in queue:
            for c, child in goto[node].items():
                back = fail[node]
                while back and c not in goto[back]:
                    back = fail[back]
                fail[child] = goto[back].get(c, 0)
                queue.append(child)
            # the next shorter entry that ends where this node's string ends
            shorter[node] = fail[node] if ends[fail[node]] >= 0 else shorter[fail[node]]
        keys = np.array([n * 256 + c for n, g in enumerate(goto) for c in g], np.int32)
        to = np.array([t for g in goto for t in g.values()], np.int32)
        by = np.argsort(keys)
        self.keys, self.to = keys[by], to[by]
        self.fail, self.shorter = np.array(fail, np.int32), np.array(shorter, np.int32)
        self.ends, self.depth = np.array(ends, np.int32), np.array(depth, np.int64)

    def longest(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest entry that starts at each byte of the strings
        begin[i]..end[i], by its place in ``data``."""
        out = np.full(len(data), -1, np.int32)
        by = np.argsort(begin - end, kind="stable")  # long strings first: those that go on are a prefix
        at, left = begin[by].copy(), (end - begin)[by]
        state, step = np.zeros(len(by), np.int32), 0
        while True:
            n = int(np.searchsorted(-left, -step, "left"))
            if not n:
                return out
            here, c = state[:n], data[at[:n] + step].astype(np.int32)
            seek = np.arange(n)
            while len(seek):
                key = here[seek] * 256 + c[seek]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[k] == key
                here[seek[found]] = self.to[k[found]]
                miss = seek[~found]
                stuck = here[miss] == 0
                seek = miss[~stuck]
                here[seek] = self.fail[here[seek]]
            # entries that end here; ends ascend, so a start's longest comes last
            node = np.where(self.ends[here] >= 0, here, self.shorter[here])
            open_ = np.flatnonzero(node)
            while len(open_):
                at_node = node[open_]
                out[at[open_] + step + 1 - self.depth[at_node]] = self.ends[at_node]
                node[open_] = self.shorter[at_node]
                open_ = open_[node[open_] > 0]
            step += 1


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.special = special
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            made = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = k, made
            if self.parts[made] is None:
                self.parts[made] = vocab[a], vocab[b]
        self.order = [-1 if p is None else self.rank[p][0] for p in self.parts]
        self.single = [vocab.get(bytes([b]), -1) for b in range(256)]
        # entries that merging can reach: letters and the products of merges
        reach = [i for i in vocab.values() if len(self.bytes_of[i]) == 1 or self.parts[i]]
        self.matches = Matches({self.bytes_of[i]: i for i in reach})
        # the longest entry that is a proper prefix of each entry
        self.shorter = [-1] * size
        for i in reach:
            b = self.bytes_of[i]
            for n in range(len(b) - 1, 0, -1):
                j = vocab.get(b[:n], -1)
                if j >= 0 and (n == 1 or self.parts[j]):
                    self.shorter[i] = j
                    break
        self.lengths = [len(b) for b in self.bytes_of]
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.fits: dict[tuple[int, int], bool] = {}
        self.size, self.sizes = size, np.array(self.lengths, np.int64)
        self.shorters, self.orders = np.array(self.shorter, np.int32), np.array(self.order, np.int64)
        self.lefts = np.array([p[0] if p else -1 for p in self.parts], np.int64)
        self.rights = np.array([p[1] if p else -1 for p in self.parts], np.int64)
        keys = np.array([a * size + b for a, b in self.rank] or [-1], np.int64)
        ranks = np.array([r for r, _ in self.rank.values()] or [0], np.int64)
        by = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[by], ranks[by]
        self.pair_keys, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two entries, merged by rank, give the two:
        no merge across their border may come before those that make them."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        a, b = left, right
        limit = 1 << 60
        while True:
            across = self.rank.get((a, b))
            if across is not None and across[0] < limit:
                return False
            # undo the later of the two last merges
            ra, rb = self.order[a], self.order[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # the left entry's last merge came later: its right part bordered till then
                limit, a = ra, self.parts[a][1]
            elif rb > ra:
                # at equal rank the leftmost is merged first, hence + 1
                limit, b = rb + 1, self.parts[b][0]
            else:
                limit, b = rb + 1, self.parts[b][0]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        n = len(piece)
        if n == 1:
            return (self.single[piece[0]],)
        longest = self.matches.longest(np.frombuffer(piece, np.uint8), np.array([0]), np.array([n])).tolist()
        lengths, shorter = self.lengths, self.shorter
        dead = bytearray(n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if not dead[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                if end == n:
                    return tuple(ids)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                # nothing fits at this place after the entry before it
                dead[at] = 1
                token = ids.pop()
                at -= lengths[token]
                token = shorter[token]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        n = len(piece)
        if n == 1:
            return (self.single[piece[0]],)
        longest = self.matches.longest(np.frombuffer(piece, np.uint8), np.array([0]), np.array([n])).tolist()
        lengths, shorter = self.lengths, self.shorter
        dead = bytearray(n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if not dead[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                if end == n:
                    return tuple(ids)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                # nothing fits at this place after the entry before it
                dead[at] = 1
                token = ids.pop()
                at -= lengths[token]
                token = shorter[token]

    def _longest(self, piece: bytes) -> list[int]:
        """The longest entry that starts at each byte."""
        text = piece.decode("latin-1")
        out = [-1] * len(text)
        lengths = self.lengths
        for end, i in self.automaton.iter(text):
            size = lengths[i]
            at = end - size + 1
            if out[at] < 0 or lengths[out[at]] < size:
                out[at] = i
        return out

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs, through the table of known pairs."""
        key = left.astype(np.int64) * self.size + right
        slot = (key * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            keys, first = np.unique(key[new], return_index=True)
            found = self._fit_new(left[new[first]].astype(np.int64), right[new[first]].astype(np.int64))
            out = np.empty(len(key), bool)
            known = np.ones(len(key), bool)
            known[new] = False
            out[known] = self.pair_fits[slot[known]]
            out[new] = found[np.searchsorted(keys, key[new])]
            self.pair_keys[slot[new[first]]] = keys
            self.pair_fits[slot[new[first]]] = found
            return out
        return self.pair_fits[slot]

    def _fit_new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits = np.zeros(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 60)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            clash = (self.merge_keys[at] == key) & (self.merge_ranks[at] < limit)
            ra, rb = self.orders[a], self.orders[b]
            whole = ~clash & (ra < 0) & (rb < 0)
            fits[live[whole]] = True
            go = ~(clash | whole)
            live, a, b, ra, rb, limit = live[go], a[go], b[go], ra[go], rb[go], limit[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.rights[a], a), np.where(later, b, self.lefts[b])
        return fits

    def merge_all(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens (the bytes off[i]..off[i + 1]), and how many
        each has: the steps of ``merge``, taken by all pieces together."""
        out, n_ids = np.empty(len(data), np.int32), np.zeros(len(off) - 1, np.int64)
        long = np.diff(off) > LOCKSTEP_BYTES
        for i in np.flatnonzero(long).tolist():
            ids = self.merge(data[off[i]:off[i + 1]].tobytes())
            out[off[i]:off[i] + len(ids)] = ids
            n_ids[i] = len(ids)
        short = np.flatnonzero(~long)
        longest = self.matches.longest(data, off[short], off[short + 1])
        dead = np.zeros(len(data) + 1, bool)
        piece, base, limit = short, off[short], off[short + 1]
        at, top, token = base.copy(), base.copy(), longest[base]
        while len(piece):
            gone = token < 0
            if gone.any():
                k = np.flatnonzero(gone)
                dead[at[k]] = True
                top[k] -= 1
                before = out[top[k]]
                at[k] -= self.sizes[before]
                token[k] = self.shorters[before]
            k = np.flatnonzero(token >= 0)
            end = at[k] + self.sizes[token[k]]
            ok = (end == limit[k]) | ~dead[end]
            inner = np.flatnonzero(ok & (top[k] > base[k]))
            ok[inner] = self._fit(out[top[k[inner]] - 1], token[k[inner]])
            bad = k[~ok]
            token[bad] = self.shorters[token[bad]]
            k, end = k[ok], end[ok]
            out[top[k]] = token[k]
            top[k] += 1
            done = end == limit[k]
            n_ids[piece[k[done]]] = top[k[done]] - base[k[done]]
            at[k[~done]] = end[~done]
            token[k[~done]] = longest[end[~done]]
            if done.any():
                stay = np.ones(len(piece), bool)
                stay[k[done]] = False
                piece, base, limit, at, top, token = (x[stay] for x in (piece, base, limit, at, top, token))
        return out[spread(off[:-1], n_ids)], n_ids

    def encode_all(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many whole texts, one after the other, and where each
        text's ids begin; an added token's string becomes its id."""
        raw = data.tobytes()
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            fixed = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:])]
            raw = b"".join(fixed)
            data, text = np.frombuffer(raw, np.uint8), raw.decode("utf-8")
            off = np.concatenate([[0], np.cumsum([len(x) for x in fixed])]).astype(np.int64)
        if not raw:
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)
        cuts = np.searchsorted(at_byte, off)
        special: dict[int, int] = {}
        if self.split is not None and self.split.search(text):
            edges = set(cuts.tolist())
            for i in range(len(cuts) - 1):
                for m in self.split.finditer(text, int(cuts[i]), int(cuts[i + 1])):
                    special[m.start()] = self.special[m[0]]
                    edges |= {m.start(), m.end()}
            cuts = np.array(sorted(edges), np.int64)
        starts = pre_tokens(points, cuts)
        if special:
            inside = np.zeros(len(points) + 1, np.int8)
            for p, i in special.items():
                inside[p + 1:p + len(self.bytes_of[i].decode())] = 1
            starts = starts[inside[starts] == 0]
        begin = at_byte[starts]
        end = np.append(begin[1:], len(data))
        mark = POLY.spans(data, begin, end)
        for p, i in special.items():
            mark[np.searchsorted(starts, p)] = np.uint64(i)  # apart from a like string that is ordinary text
        _, first, piece = np.unique(mark, return_index=True, return_inverse=True)
        size = (end - begin)[first]
        piece_off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        ids, n_ids = self.merge_all(data[spread(begin[first], size)], piece_off)
        id_off = np.cumsum(n_ids) - n_ids
        for p, i in special.items():
            k = piece[np.searchsorted(starts, p)]
            ids[id_off[k]] = i
            n_ids[k] = 1
        counts = n_ids[piece]
        all_ids = ids[spread(id_off[piece], counts)].astype("<u4")
        sums = np.concatenate([[0], np.cumsum(counts)])
        return all_ids, sums[np.searchsorted(begin, off)]

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)], np.int64))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered by the offset table; bytes that are
        not UTF-8 become U+FFFD."""
        begin = self.offsets[ids]
        raw = self.pool[spread(begin, self.offsets[ids.astype(np.int64) + 1] - begin)].tobytes()
        return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_digests(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (ids as little-endian 32-bit
    integers) and decoded_sha256 (the decoded text) of each whole text.

    ``path`` names the vocabulary file, present on every executor. Null and
    empty texts have no tokens and the digest of nothing. Rows are answered
    each for itself; there is no shuffle.
    """
    def work(block: Block) -> dict:
        c = codec(path)
        ids, at = c.encode_all(block.data, block.off)
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        return {"n_tokens": np.diff(at), "ids_sha256": [hashlib.sha256(p.tobytes()).hexdigest() for p in parts],
                "decoded_sha256": [hashlib.sha256(c.decode(p)).hexdigest() for p in parts]}
    return annotate(docs, text_col, RESULT, work, keep)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text (an array column)."""
    def work(block: Block) -> dict:
        ids, at = codec(path).encode_all(block.data, block.off)
        return {ids_col: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))}
    return annotate(docs, text_col, [(ids_col, T.ArrayType(T.LongType()))], work, keep)
