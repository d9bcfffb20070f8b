"""Removal of long repeated strings: a distributed difference-cover algorithm.

Suffixes are compared by their first ``length`` bytes only, so ranks need to
tell equal from unequal prefixes, and names are fingerprints:

1. Suffixes at offsets of a difference cover modulo ``PERIOD`` are sampled.
   Any two suffixes reach sampled ones within the same number of steps, fewer
   than PERIOD. Samples are named by the bytes every such pair must share;
   names are sorted across the corpus and unique ones are discarded.
2. Recursion on names: triples of names, one period apart, are named and
   sorted in turn. A repeated triple settles all suffixes in its reach.
3. The remaining suffixes near a repeated sample are merged in: their whole
   prefixes are named and sorted, and adjacent equal ones are repeats. Settled
   suffixes take part if they reach a sample whose name a remaining one
   reaches as well; one more sort of the sampled names finds those.

Texts stay where they are, in a bucketed table of shards. A task sends, for
each sort bucket, the distinct names of its shard (a hot string counts once
a shard); the bucket answers with one bit a name.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.shards import POLY, POLY2, _mixed, blob, blocks, importable, runs
from kinoframe.session import work_path

LENGTH = 200
SHARD_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20    # of a sort bucket, and of the texts in a table bucket

# A perfect difference cover; every residue is a difference of two of them.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)


class Suffixes:
    """The suffixes of a shard, and what the rounds find out about them."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        self.data, self.off, self.length = data, off, length
        self.short = length - PERIOD + 1
        size = np.diff(off)
        self.room = np.repeat(off[1:], size) - np.arange(len(data))   # bytes up to the text's end
        rel = np.repeat(size, size) - self.room
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        self.at = np.flatnonzero(member[rel % PERIOD] & (self.room >= self.short))
        self.names = POLY.spans(data, self.at, self.at + self.short)

    def reach(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The suffixes in any [lo, hi)."""
        d = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(d, np.maximum(lo, 0), 1)
        np.add.at(d, np.minimum(hi, len(self.data)), -1)
        return np.cumsum(d)[:-1] > 0

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Round 1: 32 bits of each name suffice to discard (a chance match
        keeps a sample that later rounds refute); the rest picks the bucket."""
        return self.names & np.uint64(0xFFFFFFFF), self.names >> np.uint64(32)

    def keep_samples(self, repeated: np.ndarray) -> None:
        self.repeated = repeated

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Round 2: the samples with repeated ones a period before and after."""
        index = np.full(len(self.data) + 2 * PERIOD, -1, np.int64)
        hit = np.flatnonzero(self.repeated)
        index[self.at[hit] + PERIOD] = hit
        before, after = index[self.at[hit]], index[self.at[hit] + 2 * PERIOD]
        same_text = (self.room[np.maximum(self.at[hit] - PERIOD, 0)] - PERIOD == self.room[self.at[hit]]) \
            & (self.room[self.at[hit]] >= PERIOD + self.short)
        ok = (before >= 0) & (after >= 0) & same_text
        self.middle = self.at[hit[ok]]
        odd = np.uint64(0x9E3779B97F4A7C15)
        names = _mixed((self.names[before[ok]] * odd + self.names[hit[ok]]) * odd + self.names[after[ok]])
        return names, POLY2.spans(self.data, self.middle - PERIOD, self.middle + PERIOD + self.short)

    def keep_triples(self, repeated: np.ndarray) -> None:
        p = self.middle[repeated]
        self.settled = self.reach(p - PERIOD, p + PERIOD + self.short - self.length + 1)

    def open_samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Round 3a: the repeated samples' names again, with a flag on those
        that an unsettled suffix reaches."""
        p = self.at[self.repeated]
        fits = self.room >= self.length
        self.left = self.reach(p - PERIOD + 1, p + 1) & ~self.settled & fits
        sums = np.concatenate([[0], np.cumsum(self.left)])
        names = self.names[self.repeated]
        flags = sums[p + 1] > sums[np.maximum(p - PERIOD + 1, 0)]
        return names & np.uint64(0xFFFFFFFF), names >> np.uint64(32), flags

    def keep_open(self, asked: np.ndarray) -> None:
        p = self.at[self.repeated][asked]
        self.left |= self.reach(p - PERIOD + 1, p + 1) & self.settled
        self.left = np.flatnonzero(self.left)

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Round 3b: whole prefixes of the remaining suffixes."""
        return (POLY.spans(self.data, self.left, self.left + self.length),
                POLY2.spans(self.data, self.left, self.left + self.length))

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """The bytes inside a repeated prefix."""
        start = self.settled.copy()
        start[self.left[repeated]] = True
        p = np.flatnonzero(start)
        return self.reach(p, p + self.length)


ROUNDS = [(Suffixes.samples, Suffixes.keep_samples, "<u4"), (Suffixes.triples, Suffixes.keep_triples, "<u8"),
          (Suffixes.open_samples, Suffixes.keep_open, "<u4"), (Suffixes.rest, None, "<u8")]


def _sorted_names(asked: tuple, parts: int, kind: str):
    """Distinct (bucket, name) in order: buckets with their names, the answer
    as far as the shard knows it, flags if the round has them, and the place
    of each input."""
    names, choice, *flags = asked
    bucket = (choice % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((names, bucket))
    b, n = bucket[order], names[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    known = np.bincount(place[flags[0]] if flags else place, minlength=int(new.sum())) > (0 if flags else 1)
    b, n = b[new], n[new].astype(kind)
    heads = np.flatnonzero(np.diff(b, prepend=-1))
    return [(int(b[h]), h, e) for h, e in zip(heads, [*heads[1:], len(b)])], n, known, place, bool(flags)


def _replay(row: dict, length: int, parts: list[int], upto: int):
    """A shard's state after the answers of the first rounds; its names of
    round ``upto`` (or, after the last round, the bytes to remove)."""
    data = np.frombuffer(row["text"], np.uint8)
    s = Suffixes(data, np.frombuffer(row["off"], np.int64), length)
    for k, (ask, keep, kind) in enumerate(ROUNDS):
        groups, names, known, place, flagged = _sorted_names(ask(s), parts[k], kind)
        if k == upto:
            return s, groups, names, known if flagged else None
        answers = {a["bucket"]: a["bits"] for a in row[f"a{k}"] or []}
        for b, lo, hi in groups:
            if b in answers:
                known[lo:hi] |= np.unpackbits(np.frombuffer(answers[b], np.uint8), count=hi - lo).astype(bool)
        if keep is None:
            return s, s.covered(known[place]), None, None
        keep(s, known[place])


def _sort_bucket(table: pa.Table) -> pa.Table:
    """A bucket's names of all shards, sorted: adjacent equal names are
    repeats (or, in a round with flags, share their flags). The answer to
    each shard is a bit for each of its names."""
    kind = table.column("kind")[0].as_py()
    parts = [np.frombuffer(x, kind) for x in table.column("names").to_pylist()]
    names = np.concatenate(parts)
    order = np.argsort(names, kind="stable")
    new = np.ones(len(names), bool)
    new[1:] = names[order][1:] != names[order][:-1]
    group = np.empty(len(names), np.int64)
    group[order] = np.cumsum(new) - 1
    flags = table.column("flags").to_pylist()
    if flags[0] is None:
        yes = np.bincount(group) > 1
    else:
        flag = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(p))
                               for f, p in zip(flags, parts)]).astype(bool)
        yes = np.bincount(group[flag], minlength=int(new.sum())) > 0
    yes = yes[group]
    ends = np.cumsum([len(p) for p in parts])
    bits = [yes[e - len(p):e] for p, e in zip(parts, ends)]
    some = [i for i, b in enumerate(bits) if b.any()]
    return pa.table({"shard": pa.array([table.column("shard")[i].as_py() for i in some], pa.int64()),
                     "bucket": pa.array([table.column("bucket")[i].as_py() for i in some], pa.int64()),
                     "bits": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary())})


def shard_table(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int, buckets: int) -> DataFrame:
    """Rows (shard, ids, text bytes, offsets), as a table bucketed by shard in
    the shared folder: later rounds join answers to it without moving texts."""
    spark = docs.sparkSession
    importable(spark)
    id_type = docs.schema[id_col].dataType
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("text", T.BinaryType()), T.StructField("off", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in blocks(batch, "text", shard_bytes):
                ids = batch.column("id").slice(b.lo, b.n)
                lists = pa.ListArray.from_arrays(pa.array([0, b.n], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), lists, pa.array([blob(b.data)], pa.binary()),
                     pa.array([blob(b.off.astype(np.int64))], pa.binary())], schema=pa.schema(
                        [("shard", pa.int64()), ("ids", lists.type), ("text", pa.binary()), ("off", pa.binary())]))
                shard += 1

    return _bucketed(given.mapInArrow(run, schema), buckets, "shards")


def _bucketed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    table = f"llm_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(buckets, "shard").option("compression", "zstd")
     .option("path", work_path(df.sparkSession, name)).saveAsTable(table))
    return df.sparkSession.table(table)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   with_text: bool = False, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row a document: the id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, if asked for, the kept bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts
    elsewhere, in any text or the same one; strings are judged on the input
    and never cross texts. Null and empty texts have no bytes; a text shorter
    than ``length`` loses none; of equal texts none stays. Repeated rows are
    repeats of each other. Other columns are not used; an empty table gives
    no rows.
    """
    if length < PERIOD + 16:
        raise ValueError(f"length must be at least {PERIOD + 16}")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    buckets = max(12, math.ceil(total / bucket_bytes))
    texts = shard_table(docs, id_col, text_col, shard_bytes, buckets)
    # buckets by the most that each round may send
    share = len(COVER) / PERIOD
    parts = [max(12, math.ceil(total * x / bucket_bytes)) for x in (4 * share, 8 * share, 4 * share, 4.0)]
    state = texts
    for k, (_, _, kind) in enumerate(ROUNDS):
        def ask(batches: Iterator[pa.RecordBatch], k: int = k, kind: str = kind) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                _, groups, names, flags = _replay(row, length, parts, k)
                bits = [None if flags is None else np.packbits(flags[lo:hi]).tobytes() for _, lo, hi in groups]
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([b for b, _, _ in groups], pa.int64()),
                     "shard": pa.array([row["shard"]] * len(groups), pa.int64()),
                     "kind": pa.array([kind] * len(groups), pa.string()),
                     "names": pa.array([blob(names[lo:hi]) for _, lo, hi in groups], pa.binary()),
                     "flags": pa.array(bits, pa.binary())})
        sent = state.drop("ids").mapInArrow(ask, "bucket long, shard long, kind string, names binary, flags binary")
        found = sent.groupBy("bucket").applyInArrow(_sort_bucket, "shard long, bucket long, bits binary")
        answers = found.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"a{k}"))
        state = state.join(_bucketed(answers, buckets, f"answers{k}"), "shard", "left")

    fields = [T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("n", T.ArrayType(T.LongType())),
              T.StructField("gone", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.LongType())),
              T.StructField("sha", T.ArrayType(T.StringType()))]
    fields += [T.StructField("kept", T.ArrayType(T.BinaryType()))] if with_text else []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "ids"}
                s, gone, _, _ = _replay(row, length, parts, len(ROUNDS))
                off = s.off
                sums = np.concatenate([[0], np.cumsum(gone)])
                begin, _ = runs(gone, off)
                kept = s.data[~gone]
                cut = off - sums[off]
                pieces = [kept[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                one = lambda values, t: pa.array([values], pa.list_(t))
                cols = [batch.column("ids").slice(i, 1), one(np.diff(off), pa.int64()),
                        one(sums[off[1:]] - sums[off[:-1]], pa.int64()),
                        one(np.diff(np.searchsorted(begin, off)), pa.int64()),
                        one([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
                cols += [one(pieces, pa.binary())] if with_text else []
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    each = state.mapInArrow(finish, T.StructType(fields))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
    rows = each.select(F.explode(F.arrays_zip(*[f.name for f in fields])).alias("r"))
    return rows.select(*[F.col(f"r.{f.name}").alias(n) for f, n in zip(fields, names)])
