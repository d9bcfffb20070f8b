"""Near duplicates by improved consistent weighted sampling.

Texts are weighted sets of five-word shingles (term frequency times smoothed
inverse document frequency, counted over all documents in 2**20 hashed
cells). Consistent weighted samples, banded by three, propose pairs, four bits
of each sample drop those that cannot be similar, and weighted Jaccard
similarity verifies the rest. Every member of a band bucket meets the
bucket's most connected member; members of buckets that still hold several
classes then meet those of other classes that share a shingle with them among
the rarest ones of each, early enough for the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.components import bucket_classes, shared_buckets, with_class
from kinoframe.llm.shards import Block, _mixed, annotate, blob, blocks, importable, ngram_starts, ngrams, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 3, 12        # a pair at 0.8 shares no band once in 5,500 cases, at 0.85 once in 92,000
SAMPLES = 60               # the bands use the first 36, the sketch all
MIN_AGREE = 34             # of 4 bits from each of 60 samples: at 0.8, 49 agree on average, under 34 once in 340,000
SKETCH = ["s0", "s1", "s2", "s3"]   # 15 samples of 4 bits each
CELLS = 1 << 20            # of the frequency table: 4 MB to each executor, at every corpus size
CHUNK = 1 << 14
BLOCK_BYTES = 1 << 18      # of texts whose samples are drawn at a time: a draw's values stay in the processor's cache
ID_BITS = 1 << 24          # of the table that tells wanted texts: up to 262,144 rows to each executor, at every corpus size
STEP = 1.05                # between the weights of one size class of texts and the next
IDF_SHARE = 0.5            # weights run from 1 (in every text) to 1.5 (in one)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, mark, count, words): text i has the distinct shingles
    first[i]..first[i + 1] with their counts. A text of fewer than five
    words, but not none, has one shingle of all its words."""
    w = block.words()
    n = w.counts
    at = ngram_starts(w.first, SHINGLE_WORDS)
    doc = np.searchsorted(w.first, at, "right") - 1
    mark = ngrams(w.hash, SHINGLE_WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE_WORDS))
    if len(short):
        whole = np.array([_sequence(w.hash[w.first[i]:w.first[i + 1]])[0] for i in short.tolist()], np.uint64)
        doc, mark = np.concatenate([doc, short]), np.concatenate([mark, whole])
    order = np.lexsort((mark, doc))
    doc, mark = doc[order], mark[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(doc)))
    return np.searchsorted(doc[heads], np.arange(block.n + 1)), mark[heads], count, w


def _sequence(hashes: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a word sequence."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        powers = np.full(len(hashes), base, np.uint64)
        powers[:1] = 1
        out.append(int(_mixed(np.array([(hashes * np.multiply.accumulate(powers)).sum() + np.uint64(len(hashes))],
                                       np.uint64))[0]))
    return out[0], out[1]


def document_frequency(texts: DataFrame) -> np.ndarray:
    """How many (text, distinct shingle) pairs fall into each cell, over all
    texts. A task sends one vector in chunks; vectors are added in two steps,
    so no task holds more than a bounded number of them."""
    importable(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for block in blocks(batch, "__text"):
                n += np.bincount((shingles(block)[1] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        part = TaskContext.get().partitionId()
        for c in range(CELLS // CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "part": pa.array([part % 1024], pa.int32()),
                                              "n": pa.array([blob(n[c * CHUNK:(c + 1) * CHUNK])], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("n"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "n": pa.array([blob(total)], pa.binary())})

    schema = "chunk int, part int, n binary"
    some = texts.select("__text").mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema)
    rows = some.groupBy("chunk").applyInArrow(add, schema).collect()   # 8 MB, whatever the corpus
    out = np.zeros(CELLS, np.int64)
    for r in rows:
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["n"], np.int64)
    return out


def weights_of(df: np.ndarray, total: int) -> np.ndarray:
    """A cell's weight: 1 + IDF_SHARE * idf, idf scaled to 0..1."""
    idf = np.log1p(total / (df + 1.0)) / np.log1p(max(total, 1))
    return (1.0 + IDF_SHARE * np.clip(idf, 0, 1)).astype(np.float32)


@cache
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """65,536 values of two gamma(2, 1) variates, from hashed counters."""
    u = (_mixed(np.arange(1, 4 * 65536 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
    u = np.maximum(u.reshape(4, 65536), 1e-12)
    return -np.log(u[0]) - np.log(u[1]), np.log(-np.log(u[2]) - np.log(u[3]))


def signatures(first: np.ndarray, mark: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each text with shingles SAMPLES values of 32 bits: the sampled
    shingle with its level, for which two texts agree with a probability of
    their weighted Jaccard similarity."""
    rate, log_c = _draws()
    log_w = np.log(weight)
    heads = first[:-1][np.diff(first) > 0]
    out = np.empty((len(heads), SAMPLES), np.uint32)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for k in range(SAMPLES):
        u = _mixed(mark + np.uint64(k + 1) * odd)
        drawn = u.view(np.uint16).reshape(-1, 4)   # the value's quarters, lowest first
        r = rate.take(drawn[:, 0])
        beta = drawn[:, 2] / 65536.0
        level = np.floor(log_w / r + beta)
        log_a = (log_c.take(drawn[:, 1]) - r * (level - beta) - r).astype(np.float32)
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        what = _mixed(mark ^ (level.astype(np.int64).view(np.uint64) * odd)) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(ordered << np.uint64(32) | what, heads) & np.uint64(0xFFFFFFFF)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of each row of samples."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r:ROWS * BANDS:ROWS])
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two texts (sorted shingles, their weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(low / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low))


def _sampled(texts: DataFrame, table) -> DataFrame:
    """(id, m1, m2, s0..s3, bands): a row for each text with words; m1 and m2
    tell equal word sequences; the sketch has four bits of each sample."""
    def work(block: Block) -> dict:
        first, mark, count, w = shingles(block)
        weight = count * table.value[(mark % np.uint64(CELLS)).astype(np.int64)]
        bands: list = [None] * block.n
        sketch = np.zeros((block.n, len(SKETCH)), np.int64)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            sig = signatures(first, mark, weight).astype(np.uint64)
            for i, k in zip(some.tolist(), band_keys(sig)):
                bands[i] = k
            bits = (sig & np.uint64(15)).reshape(len(some), len(SKETCH), -1)
            bits = bits << (4 * np.arange(bits.shape[2], dtype=np.uint64))
            sketch[some] = np.bitwise_or.reduce(bits, axis=2).view(np.int64)
        same = [_sequence(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
        both = np.array(same, np.uint64).reshape(-1, 2).view(np.int64)
        return {"m1": both[:, 0], "m2": both[:, 1], "bands": bands} | {n: sketch[:, k] for k, n in enumerate(SKETCH)}
    add = [(n, T.LongType()) for n in ("m1", "m2", *SKETCH)] + [("bands", T.ArrayType(T.LongType()))]
    return annotate(texts, "__text", add, work, keep=["id"], block_bytes=BLOCK_BYTES).where("bands is not null")


def _plausible(a: str, b: str) -> F.Column:
    """Whether enough samples of two rows agree: equal groups of four bits."""
    differ = F.lit(0)
    for n in SKETCH:
        x = F.col(a + n).bitwiseXOR(F.col(b + n))
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(
            F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(some.bitwiseAND(F.lit(0x111111111111111)))
    return F.lit(SAMPLES) - differ >= MIN_AGREE


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (id, ...) that ``wanted`` (id, ...) names, with its columns.
    Most others are left where they stand, by a table of bits of hashed ids;
    the join by the ids themselves decides."""
    cell = F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
    word, bit = F.shiftright(cell, 6), cell.bitwiseAND(F.lit(63)).cast("int")
    known = (wanted.select(word.alias("__word"), F.expr("1L").alias("__one"), bit.alias("__bit"))
             .groupBy("__word").agg(F.bit_or(F.expr("shiftleft(__one, __bit)")).alias("__bits")))
    maybe = (texts.withColumn("__at", word).withColumn("__bit", bit)
             .join(F.broadcast(known), F.col("__at") == F.col("__word"))
             .where(F.expr("shiftrightunsigned(__bits, __bit) & 1L = 1L")).select(texts.columns))
    return maybe.join(wanted, "id")


def _verified(pairs: DataFrame, texts: DataFrame, table, similarity: float) -> DataFrame:
    """The pairs of at least the wanted weighted Jaccard similarity."""
    pairs = written(pairs, "near-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def sets(block: Block) -> dict:
        first, mark, count, _ = shingles(block)
        weight = (count * table.value[(mark % np.uint64(CELLS)).astype(np.int64)]).astype(np.float32)
        keys = (mark >> np.uint64(24)).astype(np.uint64)   # 40 bits of each, still in order
        raw = keys.view(np.uint8).reshape(-1, 8)[:, :5]
        return {"keys": [blob(raw[a:b]) for a, b in zip(first[:-1], first[1:])],
                "weights": [blob(weight[a:b]) for a, b in zip(first[:-1], first[1:])]}

    vectors = written(annotate(_only(texts, ids), "__text",
                               [("keys", T.BinaryType()), ("weights", T.BinaryType())], sets, keep=["id"]), "near-sets")
    both = (pairs.join(vectors.toDF("a", "ka", "wa"), "a").join(vectors.toDF("b", "kb", "wb"), "b"))

    def of(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((len(keys) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
        k, w = wide.view(np.uint64)[:, 0], np.frombuffer(weights, np.float32)
        k, at = np.unique(k, return_index=True)
        return k, w[at]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sims = batch.column("a"), batch.column("b"), []
            for i in range(batch.num_rows):
                x = of(batch.column("ka")[i].as_py(), batch.column("wa")[i].as_py())
                y = of(batch.column("kb")[i].as_py(), batch.column("wb")[i].as_py())
                sims.append(similarity_of(x, y))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return both.mapInArrow(compare, "a long, b long, sim double").where(F.col("sim") >= similarity)


def _between(rest: DataFrame, texts: DataFrame, table, similarity: float) -> DataFrame:
    """The pairs (a > b) of ``rest`` (id, class, minor) of different classes,
    one of them minor, whose similarity may reach the threshold.

    Shingles are ordered alike in all texts, rare ones first. What two texts
    share stands at and after their first common shingle in both, so the
    weights from there on bound their similarity: a text has to show only its
    first shingles, up to a share of 1 - similarity of its weight, and a minor
    one only to those texts whose weight the rest of its own still allows. No
    pair that is similar enough is left out.
    """
    share = similarity / (1 + similarity)   # of both weights that two similar texts have in common
    slack = 1e-6

    def leading(block: Block) -> dict:
        first, mark, count, _ = shingles(block)
        cell = (mark % np.uint64(CELLS)).astype(np.int64)
        weight = (count * table.value[cell]).astype(np.float64)
        text = np.repeat(np.arange(block.n), np.diff(first))
        order = np.lexsort((mark, table.value[cell] * np.float32(-1), text))   # the rarer, the heavier
        mark, weight = mark[order].view(np.int64), weight[order]
        upto = np.concatenate([[0], np.cumsum(weight)])
        total = upto[first[1:]] - upto[first[:-1]]
        before = upto[:-1] - upto[first[:-1]][text]
        shown = before <= (1 - similarity + slack) * total[text]
        parts = [np.flatnonzero(shown[a:b]) + a for a, b in zip(first[:-1], first[1:])]
        return {"weight": total, "marks": [mark[k] for k in parts], "before": [before[k] for k in parts]}

    add = [("weight", T.DoubleType()), ("marks", T.ArrayType(T.LongType())), ("before", T.ArrayType(T.DoubleType()))]
    shown = written(annotate(_only(texts, rest), "__text", add, leading, keep=["id", "class", "minor"]), "near-leading")
    each = (shown.select("id", "class", "minor", "weight", F.explode(F.arrays_zip("marks", "before")).alias("r"))
            .select("id", "class", "minor", "weight", F.col("r.marks").alias("mark"), (F.col("weight") - F.col("r.before")).alias("left")))
    size = lambda w: F.floor(F.log(w) / float(np.log(STEP))).cast("int")
    low = F.col("weight") * (similarity - slack)
    high = F.least(F.col("weight") / similarity, F.col("left") / share - F.col("weight")) * (1 + slack)
    x = (each.where("minor").where(low <= high).withColumn("size", F.explode(F.sequence(size(low), size(high)))).alias("x"))
    y = each.withColumn("size", size(F.col("weight"))).alias("y")
    alike = F.least("x.left", "y.left") >= (share - slack) * (F.col("x.weight") + F.col("y.weight"))
    once = ~F.col("y.minor") | (F.col("x.id") > F.col("y.id"))
    return (x.join(y, (F.col("x.mark") == F.col("y.mark")) & (F.col("x.size") == F.col("y.size"))
                   & (F.col("x.class") != F.col("y.class")) & once & alike)
            .select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct())


def near_classes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class) of every text (id, __text) with words; class is the
    smallest id of its group. Texts of equal words are one from the start."""
    total = texts.count()
    table = texts.sparkSession.sparkContext.broadcast(weights_of(document_frequency(texts), total))
    rows = written(_sampled(texts, table), "signatures")
    reps = written(rows.groupBy("m1", "m2").agg(F.min("id").alias("rep")), "distinct-texts")
    member = rows.select("id", "m1", "m2").join(reps, ["m1", "m2"]).select("id", "rep")
    banded = (rows.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
              .select("id", F.explode("bands").alias("bucket")))
    members = shared_buckets(banded, "near")
    classes = bucket_classes(members, rows.select("id", *SKETCH), _plausible,
                             lambda pairs: _verified(pairs, texts, table, similarity),
                             lambda rest: _between(rest, texts, table, similarity), "near")
    return with_class(member, classes, "rep").select("id", "class")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, verdict): ``docs`` as a written table with ``__row``, and for
    each row (__row, id, class_id, class_size, kept).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are
    lower-cased. Two texts are linked at a weighted Jaccard similarity of 0.8
    of their five-word shingles; classes are what links connect; class_id is
    a class's smallest document id (ties: the first row), that row is kept.
    Null and empty texts, and those without words, are never duplicates.
    Repeated rows are one class. An empty table gives no rows.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    texts = rows.select(F.col("__row").alias("id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    classes = near_classes(texts, similarity).withColumnRenamed("id", "__row")
    ids = rows.select("__row", F.col(f"`{id_col}`").alias("__id"))
    named = ids.join(classes, "__row", "left").withColumn("class", F.coalesce("class", "__row"))
    named = written(named, "near-classes")
    first = named.groupBy("class").agg(F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"),
                                                      F.col("__row").alias("row"))).alias("f"),
                                       F.count(F.lit(1)).alias("class_size"))
    verdict = (named.join(first, "class")
               .select("__row", F.col("__id").alias("id"), F.col("f.id").alias("class_id"), "class_size",
                       (F.col("f.row") == F.col("__row")).alias("kept")))
    return rows, verdict


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, columns unchanged."""
    rows, verdict = near_duplicates(docs, **options)
    return rows.join(verdict.where("kept").select("__row"), "__row", "left_semi").select(*[f"`{c}`" for c in docs.columns])
