"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct four-word shingles. Every shingle flips one
bit of a sketch, so a bit tells the parity of the shingles that fall on it and
the Hamming distance of two sketches never exceeds the size of the sets'
symmetric difference. Two linked sets differ by at most d shingles, a number
that follows from their sizes; per size band the sketch is cut into more than
d blocks, of which at most d can differ, and texts meet where a block is
equal. A bucket's members first meet its most connected one, then those of
other components; a folded sketch drops the pairs whose Hamming distance is
too large and the sets themselves decide the rest.

Equal sets are one from the start, so copies cost one row each. No bucket is
collected: buckets are joined, large ones in salted pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.components import connected_components, with_class
from kinoframe.llm.shards import LOWER, SOLID_BYTES, Block, _mixed, annotate, blob, blocks, importable, ngram_starts, written

WORDS = 4
SIMILARITY = (85, 100)     # the share of the union that the intersection must hold
SPREAD = 3                 # blocks of a sketch for each block that is joined
MARK_BITS = 52             # of a shingle's hash
CELL_BITS = 20             # of the rarity table: 2 MB to each executor, at every corpus size
CELLS = 1 << CELL_BITS
CHUNK = 1 << 14
FOLD = [f"s{k}" for k in range(8)]   # the folded sketch, 64 bits each
PIECE = 2000               # members of a bucket that one salted piece compares with all others
BLOCK_BYTES = 1 << 20      # of texts that a task works on at a time
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: eight bytes at a time, mixed after each."""
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = _mixed(size.astype(np.uint64) * ODD + np.uint64(1))
    left_over = np.flatnonzero(size <= 128)
    at = 0
    while len(left_over):
        left = size[left_over] - at
        part = eights[starts[left_over] + at]
        cut = np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        part = (part << cut) >> cut
        out[left_over] = _mixed((out[left_over] ^ part) * ODD + np.uint64(at + 1))
        at += 8
        left_over = left_over[left > 8]
    for i in np.flatnonzero(size > 128).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_marks(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, mark) of every shingle of the block's texts; a text of fewer
    words, but not none, is one shingle."""
    data = LOWER[block.data]
    starts, ends = block.runs(SOLID_BYTES[data])
    first = np.searchsorted(starts, block.off)
    hashes = word_hashes(data, starts, ends)
    count = np.diff(first)
    at = ngram_starts(first, WORDS)
    mark = np.zeros(len(at), np.uint64)
    for j in range(WORDS):
        mark = _mixed((mark ^ hashes[at + j]) * ODD + np.uint64(j + 1))
    doc = np.repeat(np.arange(block.n), np.maximum(count - WORDS + 1, 0))
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        whole = np.full(len(short), 7, np.uint64)
        for j in range(WORDS - 1):
            has = count[short] > j
            whole[has] = _mixed((whole[has] ^ hashes[first[short[has]] + j]) * ODD + np.uint64(j + 1))
        doc, mark = np.concatenate([doc, short]), np.concatenate([mark, whole])
    return doc, mark >> np.uint64(64 - MARK_BITS)


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(first, mark): text i has the distinct shingles
    mark[first[i]:first[i + 1]], ascending."""
    doc, mark = shingle_marks(block)
    if block.n <= 1 << (64 - MARK_BITS):
        both = np.sort(doc.astype(np.uint64) << np.uint64(MARK_BITS) | mark)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        doc, mark = (both >> np.uint64(MARK_BITS)).astype(np.int64), both & np.uint64((1 << MARK_BITS) - 1)
    else:
        order = np.lexsort((mark, doc))
        doc, mark = doc[order], mark[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
        doc, mark = doc[new], mark[new]
    return np.searchsorted(doc, np.arange(block.n + 1)), mark


def most_differing(sizes, num: int, den: int):
    """The largest symmetric difference of two linked sets whose sizes sum to
    ``sizes``: intersection >= num / den * union."""
    return sizes * (den - num) // (den + num)


def band_edges(largest: int, num: int, den: int) -> np.ndarray:
    """Size bands [low[b], low[b + 1]): of two linked sets the smaller one
    decides the band, the larger one lies there or in the next."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, -(-low[-1] * den // num)))
    return np.array(low, np.int64)


def block_keys(first: np.ndarray, mark: np.ndarray, rarity: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): the keys of the sketch blocks to join of each set, in its
    own band and as a larger set in the one below.

    In a band whose links differ by at most d, SPREAD * (d + 1) blocks are cut
    by the marks' high bits. Linked sets agree in all blocks but d, so they
    also share one of the d + 1 that come first in an order common to all
    texts: those whose set bits are rarest (ties: by key). A key stands for a
    block's set bits, as the XOR of their hashes: a bit flipped twice cancels.
    """
    size = np.diff(first)
    low = band_edges(int(size.max(initial=0)), num, den)
    top = low[1:] - 1
    differ = most_differing(top + top * den // num, num, den)
    own = np.searchsorted(low, size, "right") - 1
    flips = _mixed((mark & np.uint64((1 << 44) - 1)) * ODD + np.uint64(1))
    rare = rarity[(mark & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.int64)
    sets, made = [], []
    for step in (0, 1):
        band = np.maximum(own - step, 0)
        joins = (size > 0) & (own >= step)
        joins[joins] = differ[band[joins]] > 0
        if not joins.any():
            continue
        want = np.zeros(len(size), np.int64)
        want[joins] = differ[band[joins]] + 1
        doc = np.repeat(np.arange(len(size)), size)
        used = joins[doc]
        doc, m = doc[used], (want * SPREAD).astype(np.uint64)
        place = ((mark[used] >> np.uint64(MARK_BITS - 32)) * m[doc]) >> np.uint64(32)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        heads = np.flatnonzero(new)
        word = np.bitwise_xor.reduceat(flips[used], heads)
        score = np.add.reduceat(rare[used], heads)
        doc, place = doc[heads], place[heads]
        keys = _mixed(word ^ _mixed(place * ODD + band[doc].astype(np.uint64) + np.uint64(1)))
        at = np.searchsorted(doc, np.arange(len(size) + 1))
        for i in np.flatnonzero(joins & (np.diff(at) < want)).tolist():   # empty blocks can be equal too
            void = np.setdiff1d(np.arange(int(m[i]), dtype=np.uint64), place[at[i]:at[i + 1]])
            void = np.sort(_mixed(_mixed(void * ODD + np.uint64(band[i] + 1))))[:want[i] - (at[i + 1] - at[i])]
            sets.append(np.full(len(void), i))
            made.append(void)
        order = np.lexsort((keys, -score, doc))
        first_ones = (np.arange(len(doc)) - at[doc]) < want[doc]
        sets.append(doc[first_ones])
        made.append(keys[order][first_ones])
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(made)


def set_ids(first: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets have one id."""
    sums = np.zeros((2, len(mark) + 1), np.uint64)
    for k in (0, 1):
        np.cumsum(_mixed(mark * ODD + np.uint64(17 + k)), out=sums[k, 1:])
    f = sums[:, first[1:]] - sums[:, first[:-1]]
    return _mixed(f[0] * ODD ^ _mixed(f[1] + np.diff(first).astype(np.uint64))).view(np.int64)


def folded(first: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The parity sketch of 64 * len(FOLD) bits of each set."""
    out = np.zeros((len(first) - 1) * len(FOLD) * 64, np.uint8)
    bit = (mark % np.uint64(len(FOLD) * 64)).astype(np.int64)
    at = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (len(FOLD) * 64) + bit
    out[:] = np.bincount(at, minlength=len(out)) & 1
    return np.packbits(out.reshape(-1, 64), axis=1, bitorder="little").view("<i8").reshape(-1, len(FOLD))


def rarity_table(texts: DataFrame, column: str) -> np.ndarray:
    """A score for each cell of shingles, larger for those found less often:
    16 log2(shingles of the corpus / shingles in the cell). Counted over all
    texts; only the order of blocks rests on it, never a link. A task sends
    one vector in chunks; vectors are added in two steps."""
    importable(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for block in blocks(batch, column, BLOCK_BYTES):
                n += np.bincount((shingle_marks(block)[1] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        part = TaskContext.get().partitionId() % 1024
        for c in range(CELLS // CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "part": pa.array([part], pa.int32()),
                                              "n": pa.array([blob(n[c * CHUNK:(c + 1) * CHUNK])], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("n"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "n": pa.array([blob(total)], pa.binary())})

    schema = "chunk int, part int, n binary"
    some = texts.select(column).mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema)
    cells = np.zeros(CELLS, np.int64)
    for r in some.groupBy("chunk").applyInArrow(add, schema).collect():   # 8 MB, whatever the corpus
        cells[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["n"], np.int64)
    return (16 * np.log2((cells.sum() + 2) / (cells + 1)) + 1).astype(np.uint16)


def _near(a: str, b: str, num: int, den: int) -> Column:
    """Whether the sizes and the sketches of two rows allow a link."""
    apart = F.lit(0)
    for s in FOLD:
        apart = apart + F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s)))
    sizes = F.col(a + "n") + F.col(b + "n")
    return ((F.least(a + "n", b + "n") * den >= F.greatest(a + "n", b + "n") * num)
            & (apart * (den + num) <= sizes * (den - num)))


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets that are linked."""
    ids = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    wanted = written(sketches.join(ids, "set").groupBy("set").agg(F.min("id").alias("id")), "parity-wanted")

    def sets(block: Block) -> dict:
        first, mark = shingle_sets(block)
        raw = np.ascontiguousarray(mark).view(np.uint8).reshape(-1, 8)[:, :7]   # 52 of 64 bits are used
        return {"set": set_ids(first, mark), "keys": [blob(raw[x:y]) for x, y in zip(first[:-1], first[1:])]}

    some = wanted.select(F.col("id").alias("w")).distinct()
    given = texts.join(some, F.col("id").eqNullSafe(F.col("w")), "left_semi")
    vectors = annotate(given, "__text", [("set", T.LongType()), ("keys", T.BinaryType())], sets, keep=[], block_bytes=BLOCK_BYTES)
    vectors = written(vectors.join(ids, "set", "left_semi").dropDuplicates(["set"]), "parity-sets")
    both = pairs.join(vectors.toDF("a", "ka"), "a").join(vectors.toDF("b", "kb"), "b")

    def wide(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 7, 8), np.uint8)
        out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
        return out.view(np.uint64)[:, 0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ka, kb in zip(batch.column("ka"), batch.column("kb")):
                x, y = wide(ka.as_py()), wide(kb.as_py())
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(shared * den >= (len(x) + len(y) - shared) * num)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def link_classes(texts: DataFrame, sketches: DataFrame, rarity, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(id, class) of every linked set: class is the smallest set id that
    links reach. ``sketches`` has (id, set, n, FOLD) of every text."""
    num, den = similarity

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "__text", BLOCK_BYTES):
                first, mark = shingle_sets(block)
                at, key = block_keys(first, mark, rarity.value, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(set_ids(first, mark)[at])],
                                                 names=["key", "set"])

    # one exchange of keys; a window streams a bucket's rows, however many
    spread = texts.select("__text").mapInArrow(keyed, "key long, set long")
    bucket = Window.partitionBy("key")
    spread = spread.withColumn("lo", F.min("set").over(bucket)).withColumn("hi", F.max("set").over(bucket))
    members = written(spread.where("lo < hi").select("key", "set").distinct(), "parity-members")
    info = sketches.groupBy("set").agg(F.first("n").alias("n"), *[F.first(s).alias(s) for s in FOLD])
    info = written(info.join(members.select("set").distinct(), "set", "left_semi"), "parity-info")
    ties = members.groupBy("set").agg(F.count(F.lit(1)).alias("ties"))
    members = members.join(ties, "set")
    centre = (members.groupBy("key").agg(F.max_by("set", F.struct("ties", "set")).alias("b"), F.count(F.lit(1)).alias("size")))
    members = written(members.join(centre, "key").where("set <> b"), "parity-centred")
    of = lambda c: info.select(F.col("set").alias(c), F.col("n").alias(c + "_n"), *[F.col(s).alias(f"{c}_{s}") for s in FOLD])
    star = (members.select(F.col("set").alias("a"), "b").distinct().join(of("a"), "a").join(of("b"), "b")
            .where(_near("a_", "b_", num, den)).select("a", "b"))
    links = written(_verified(written(star, "parity-stars"), sketches, texts, num, den), "parity-links")
    # members that the centre did not bring together meet those of other classes
    named = with_class(members.where("size > 2").select("key", "set", "size"), connected_components(links), "set")
    several = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    rest = (named.join(several.select("key", "low"), "key").join(info, "set")
            .withColumn("pieces", F.ceil(F.col("size") / PIECE).cast("int")))
    rest = written(rest, "parity-rest")
    x = rest.where("class <> low").withColumn("piece", F.pmod(F.hash("set"), "pieces")).alias("x")
    y = rest.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).alias("y")
    cross = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.piece") == F.col("y.piece"))
                    & (F.col("x.class") != F.col("y.class")) & _near("x.", "y.", num, den))
             .select(F.greatest("x.set", "y.set").alias("a"), F.least("x.set", "y.set").alias("b")).distinct())
    more = _verified(written(cross, "parity-cross"), sketches, texts, num, den)
    return connected_components(links.unionByName(more))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """For each row of ``docs``: ``id_col``, n_shingles, component_id and
    class_size (rows of the component).

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a document's set
    is its distinct four-word shingles (a shorter one: its whole sequence).
    Documents are linked at an intersection of 85 % of the union; component_id
    is the smallest id that links reach. Null, empty and blank texts have no
    shingle and are linked with nothing. Repeated rows and repeated ids are
    documents of their own; a null id counts only where no other is reached.
    An empty table gives no rows; other columns are not regarded. Shingles are
    compared by 52-bit hashes, equal sets by 64-bit ones.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("__text"))

    def sketch(block: Block) -> dict:
        first, mark = shingle_sets(block)
        fold = folded(first, mark)
        return {"n": np.diff(first), "set": set_ids(first, mark)} | {s: fold[:, k] for k, s in enumerate(FOLD)}

    add = [(c, T.LongType()) for c in ("n", "set", *FOLD)]
    rows = written(annotate(texts, "__text", add, sketch, keep=["id"], block_bytes=BLOCK_BYTES), "parity-sketches")
    some = rows.where("n > 0")
    rarity = docs.sparkSession.sparkContext.broadcast(rarity_table(texts, "__text"))
    classes = link_classes(texts, some, rarity, similarity)
    sets = some.groupBy("set").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    named = written(with_class(sets, classes, "set"), "parity-classes")
    least = named.groupBy("class").agg(F.min("low").alias("component_id"), F.sum("copies").alias("class_size"))
    found = named.join(least, "class").select("set", "component_id", "class_size")
    return (rows.select("id", "n", "set").join(found, "set", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("class_size")).otherwise(F.lit(1)).alias("class_size")))
