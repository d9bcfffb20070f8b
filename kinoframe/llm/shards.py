"""Text blocks: numpy work on the Arrow batches of a text column.

A row-wise operator walks the batches that Spark gives a task in blocks of
whole texts, a few megabytes each, and answers with columns. No row leaves
its task, so there is no shuffle and no group that could become hot.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.session import work_path

BLOCK_BYTES = 4 << 20
_SEGMENT = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Polynomial:
    """Polynomial fingerprints modulo 2**64 of byte spans, by prefix sums."""

    def __init__(self, seed: int):
        ids = np.arange(1, 258, dtype=np.uint64) + np.uint64(seed << 20)
        drawn = _mixed(ids * np.uint64(0x9E3779B97F4A7C15))
        self.values, self.base = drawn[:256], int(drawn[256]) * 8 % 2**64 + 3
        self._powers: tuple[np.ndarray, np.ndarray] | None = None

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base**i and base**-i for i below n."""
        if self._powers is None or len(self._powers[0]) < n:
            made = []
            for b in (self.base, pow(self.base, -1, 2**64)):
                p = np.full(n, b, dtype=np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            if n > 2 * _SEGMENT:
                return made[0], made[1]  # a rare long span: not kept
            self._powers = made[0], made[1]
        return self._powers

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers(len(data) + 1)[1][:len(data)], out=out[1:])
        return out

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A fingerprint of data[s:e] for each span; spans ascend, and memory
        stays at a segment of the data plus eight bytes a span."""
        return self.prefixes(data, starts, ends, [])[0]

    def prefixes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 stops: list[np.ndarray]) -> list[np.ndarray]:
        """Fingerprints of the spans, and of their parts up to each of stops."""
        out = [np.empty(len(starts), dtype=np.uint64) for _ in range(1 + len(stops))]
        at = 0
        while at < len(starts):
            lo = int(starts[at])
            upto = max(at + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
            s, e = starts[at:upto] - lo, ends[at:upto] - lo
            sums = self.sums(data[lo:lo + int(e[-1])])
            shift = self.powers(len(sums))[0][s]
            for made, stop in zip(out, [e, *(x[at:upto] - lo for x in stops)]):
                made[at:upto] = _mixed((sums[stop] - sums[s]) * shift + (stop - s).astype(np.uint64))
            at = upto
        return out


POLY = Polynomial(1)
POLY2 = Polynomial(2)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


# Bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased:
# digits, a-z and every byte of a character beyond ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
# Bytes of a word [^\x20\x09-\x0D]+.
SOLID_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """Whole texts lo..hi of a batch: their bytes one after the other."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of member bytes that do not cross a text's end."""
        return runs(member, self.off)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def words(self, member: np.ndarray = WORD_BYTES, lower: bool = True) -> "Words":
        data = LOWER[self.data] if lower else self.data
        starts, ends = self.runs(member[data])
        first = np.searchsorted(starts, self.off)
        return Words(POLY.spans(data, starts, ends), starts, ends, first)


@dataclass
class Words:
    """Word fingerprints of a block; text i has words first[i]..first[i+1]."""

    hash: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = member.copy()
    begin[1:] &= ~member[:-1]
    heads = off[:-1][off[:-1] < n]
    begin[heads] = member[heads]
    end = member.copy()
    end[:-1] &= ~member[1:]
    tails = off[1:][off[1:] > 0] - 1
    end[tails] = member[tails]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every k consecutive words (ends not regarded)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n]
    return _mixed(out)


def ngram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the k-word windows that lie within one text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return spread(first[:-1], counts)


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... (counts[i] values) for each i in turn."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(begin.astype(np.int64) - before, counts)


def per_doc(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each text's words."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.zeros(len(col) + 1, np.int64)
    if len(col):
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, raw


def blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The whole texts of a batch, about ``block_bytes`` at a time; a longer
    text makes a block of its own."""
    off, raw = column_bytes(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (a checkout on a shared path; an installed package needs nothing)."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [home])


def annotate(df: DataFrame, text_col: str, add: list[tuple[str, T.DataType]],
             work: Callable[[Block], dict[str, object]], keep: list[str] | None = None,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with the columns that ``work`` makes of each block of texts.

    ``keep`` names the input columns that stay (default: all). A kept column
    named as a result (in any case) gives way to it. No shuffle; an empty
    table gives an empty table; a null text is an empty one.
    """
    importable(df.sparkSession)
    names = {n.lower() for n, _ in add}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    fields = [df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in add]
    text = f"__text_{uuid.uuid4().hex[:8]}"
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, block_bytes):
                made = work(block)
                part = batch.slice(block.lo, block.n)
                cols = [part.column(c) for c in keep]
                cols += [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], type=arrow_type(t))
                         for n, t in add]
                yield pa.RecordBatch.from_arrays(cols, names=keep + [n for n, _ in add])

    return given.mapInArrow(run, T.StructType(fields))


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
            "boolean": pa.bool_(), "binary": pa.binary()}[t.simpleString()]


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (no lineage)."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
