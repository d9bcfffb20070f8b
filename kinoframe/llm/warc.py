"""WARC archives as a table of chunks.

A payload becomes rows (record, chunk number, bytes) of at most a chunk's
size; each row is one archive record: the first carries the record's type,
later ones are ``continuation`` segments that name the first, as the format
provides; a revisit names the response whose payload it repeats. Spark's
text writer puts the rows into gzip files, its text reader streams them back
line by line, and a reader in each task cuts records by Content-Length,
feeding every segment to the record's digest. No task holds a whole record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.llm.shards import column_bytes, importable
from kinoframe.session import work_path

CHUNK_BYTES = 1 << 20
MIN_REVISIT_BYTES = 0
VERSION = b"WARC/1.1"
WRITTEN = "1970-01-01T00:00:00Z"  # pages carry no time of capture
END = b"\r\n\r\n"
# The format's profile of a revisit by equal payloads, and the payloads' type.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT = "text/html; charset=utf-8"

SCHEMA = ("page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
          "url string, n_chunks long")


def decisions(pages: DataFrame, id_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """page id and payload digest -> the id of the response it repeats (null
    for a response). Only ids, digests and lengths are shuffled; a payload
    that a third of the pages share is summed map-side."""
    meta = pages.select(F.col(f"`{id_col}`").alias("__id"), F.sha1(payload).alias("__sha"),
                        F.octet_length(payload).alias("__len")).where(F.col("__len") >= min_bytes)
    largest = meta.groupBy("__sha").agg(F.max("__id").alias("__max"), F.count(F.lit(1)).alias("__n"),
                                        F.count("__id").alias("__ids"))
    shared = largest.where("__n > 1").select("__sha", "__max")
    return (meta.select("__id", "__sha").distinct().join(shared, "__sha")
            .where(~F.col("__id").eqNullSafe(F.col("__max"))).select("__id", "__sha", "__max"))


def chunk_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *,
               min_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """record, chunk, n_chunks, total, url, refers_to, bytes: the chunk table.

    Of records with equal payloads of at least ``min_bytes`` bytes those with
    the largest id are responses (with their payload), the others revisits
    of it; a revisit's payload is not stored again, its chunk is empty.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    known = decisions(pages, id_col, payload, min_bytes)
    rows = pages.select(F.col(f"`{id_col}`").alias("__id"),
                        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
                        payload.alias("__payload"), F.sha1(payload).alias("__sha"),
                        F.monotonically_increasing_id().alias("__row"))
    hint = known.withColumnsRenamed({"__id": "__known", "__sha": "__known_sha"})
    # a null id cannot be joined by equality: its text form keeps it apart
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~null"))
    rows = rows.join(hint, (key("__id") == key("__known")) & (F.col("__sha") == F.col("__known_sha")), "left")
    body = F.when(F.col("__max").isNull(), F.col("__payload")).otherwise(F.lit(b""))
    rows = rows.select(F.col("__row"), F.col("__id").cast("string").alias("record"), "url", "__sha",
                       F.col("__max").cast("string").alias("refers_to"), F.octet_length("__payload").cast("long").alias("total"),
                       body.alias("__body"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("__body") / F.lit(chunk_bytes))).cast("int")
    rows = rows.withColumn("n_chunks", n)
    return (rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))).alias("chunk"))
            .select("__row", "record", "chunk", "n_chunks", "total", "url", "refers_to", F.col("__sha").alias("sha1"),
                    F.substring(F.col("__body"), (F.col("chunk") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
                    .alias("bytes")))


def _header(text: Column) -> Column:
    """A header value that cannot end its line (percent-encoded breaks)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "%", "%25"), "\r", "%0D"), "\n", "%0A")


def _base32(sha1: Column) -> Column:
    """RFC 4648 base32 of a digest in hexadecimal: ten digits are eight letters."""
    parts = [F.lpad(F.conv(F.substring(sha1, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _page_of(urn: str | None) -> str | None:
    """The page id in a record's name; a record without one goes by its row."""
    parts = (urn or "").strip("<>").split(":")
    return unquote_plus(parts[2]) if parts[:2] == ["urn", "page"] else None


def write_archives(chunks: DataFrame, path: str) -> None:
    """The chunk table as .gz archives under ``path``: chunks of a record
    follow one another in one file. gzip files are read by one task each.

    A response is named by its page id and payload digest, so that a revisit
    elsewhere can name it; rows that repeat both repeat the name too."""
    kind = (F.when(F.col("chunk") > 1, "continuation").when(F.col("refers_to").isNotNull(), "revisit")
            .otherwise("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    only = lambda when, *lines: F.when(when, F.concat(*lines)).otherwise(F.lit(""))
    digest = _base32(F.col("sha1"))
    of_page = lambda page: F.concat(F.lit("urn:page:"), F.url_encode(page), F.lit(":"), digest)
    row = F.col("__row").cast("string")
    origin = (F.when(F.col("record").isNull(), F.concat(F.lit("urn:row:"), row))
              .when(F.col("refers_to").isNotNull(), F.concat(of_page(F.col("record")), F.lit(":"), row))
              .otherwise(of_page(F.col("record"))))
    number = F.col("chunk").cast("string")
    in_angles = lambda value: F.concat(F.lit("<"), value, F.lit(">"))
    first, later, revisit = F.col("chunk") == 1, F.col("chunk") > 1, F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(VERSION.decode() + "\r\n"), line("WARC-Type", kind),
        line("WARC-Record-ID", in_angles(F.when(first, origin).otherwise(F.concat(origin, F.lit(":segment:"), number)))),
        line("WARC-Date", F.lit(WRITTEN)), line("WARC-Target-URI", _header(F.col("url"))),
        only(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))),
        only(first & ~revisit, line("Content-Type", F.lit(CONTENT))),
        # the length of a payload that is not stored again has no header of its own in the format
        only(revisit, line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", in_angles(of_page(F.col("refers_to")))),
             line("X-Payload-Length", F.col("total").cast("string"))),
        only(F.col("n_chunks") > 1, line("WARC-Segment-Number", number)),
        only(later, line("WARC-Segment-Origin-ID", in_angles(origin))),
        only(later & (F.col("chunk") == F.col("n_chunks")), line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        line("Content-Length", F.octet_length("bytes").cast("string")), F.lit("\r\n"))
    # the writer ends each row with the last byte of CR LF CR LF
    record = F.concat(head.cast("binary"), F.col("bytes"), F.lit(b"\r\n\r")).cast("string")
    # a record's chunks come from one row by an explode, hence in order and together
    chunks.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


class Reader:
    """Cuts a stream of bytes into records; holds one header or the bytes of
    one piece at a time, and the digest of the record that is open."""

    def __init__(self) -> None:
        self.head, self.left, self.skip = b"", 0, 0
        self.open: dict | None = None
        self.sha = hashlib.sha1()

    def feed(self, piece: bytes) -> Iterator[dict]:
        at, n = 0, len(piece)
        while at < n:
            if self.skip:
                step = min(self.skip, n - at)
                self.skip -= step
                at += step
            elif self.left:
                step = min(self.left, n - at)
                self.sha.update(memoryview(piece)[at:at + step])
                self.open["read"] += step
                self.left -= step
                at += step
                if not self.left:
                    self.skip = len(END)
            else:
                # the header ends at the first empty line, which may lie across pieces
                old = len(self.head)
                back = max(0, old - len(END) + 1)
                seen = self.head[back:] + piece[at:at + 65536]
                end = seen.find(END)
                if end < 0:
                    self.head += piece[at:at + 65536]
                    at = min(n, at + 65536)
                    continue
                stop = back + end + len(END)
                self.head += piece[at:at + stop - old]
                at += stop - old
                yield from self.begin(self.head)
                self.head = b""

    def begin(self, head: bytes) -> Iterator[dict]:
        lines = head[:-len(END)].decode("utf-8", "replace").split("\r\n")
        if lines[0].encode() != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        h = dict(x.split(": ", 1) for x in lines[1:])
        plain = lambda v: None if v is None else v.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
        if h["WARC-Type"] != "continuation":
            yield from self.close()
            self.sha = hashlib.sha1()
            self.open = {"page_id": _page_of(h["WARC-Record-ID"]), "record_type": h["WARC-Type"],
                         "refers_to": _page_of(h.get("WARC-Refers-To")), "url": plain(h["WARC-Target-URI"]),
                         "total": int(h.get("X-Payload-Length", h["Content-Length"])),
                         "digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "id": h["WARC-Record-ID"],
                         "read": 0, "n_chunks": 0}
        elif h["WARC-Segment-Origin-ID"] != self.open["id"]:
            raise ValueError(f"a segment of {h['WARC-Segment-Origin-ID']} after {self.open['id']}")
        if "WARC-Segment-Total-Length" in h:
            self.open["total"] = int(h["WARC-Segment-Total-Length"])
        self.open["n_chunks"] += 1
        self.left = int(h["Content-Length"])
        if not self.left:
            self.skip = len(END)

    def close(self) -> Iterator[dict]:
        """The record that is open, complete: a response's chunks must have
        the length and digest that its headers state."""
        if self.open is None:
            return
        r, self.open = self.open, None
        if r["record_type"] == "response":
            if r["read"] != r["total"]:
                raise ValueError(f"record {r['page_id']}: {r['read']} of {r['total']} bytes")
            if base64.b32encode(self.sha.digest()).decode() != r["digest"]:
                raise ValueError(f"record {r['page_id']}: its payload has another digest")
        yield {"page_id": r["page_id"], "payload_bytes": r["total"], "payload_digest": r["digest"],
               "record_type": r["record_type"],
               "refers_to": r["refers_to"], "url": r["url"], "n_chunks": r["n_chunks"]}


def read_archives(spark, path: str) -> DataFrame:
    """One row a record of the archives under ``path`` (ids as strings)."""
    importable(spark)
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file")))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file = Reader(), None
        for batch in batches:
            off, raw = column_bytes(batch.column("line"))
            files = batch.column("file").dictionary_encode()
            codes = files.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            rows: list[dict] = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                name = files.dictionary[int(codes[lo])].as_py()
                if name != file:   # a file begins
                    rows += reader.close()
                    reader, file = Reader(), name
                # put back the line ends that the reader took
                size = np.diff(off[lo:hi + 1])
                joined = np.full(int(size.sum()) + hi - lo, 0x0A, np.uint8)
                keep = np.ones(len(joined), bool)
                keep[np.cumsum(size + 1) - 1] = False
                joined[keep] = raw[off[lo]:off[hi]]
                rows += reader.feed(joined.tobytes())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)
        rows = list(reader.close())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    target = pa.schema([(n, pa.int64() if n in ("payload_bytes", "n_chunks") else pa.string()) for n in names])
    return lines.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives and read them back: one row a page.

    payload_bytes and payload_digest (bare base32 SHA-1) are those of the
    full payload. Null payloads are empty, and so equal to each other; a null
    id stays null and is never the largest. Rows that repeat an id with the
    payload of the largest id are all responses. Equal ids with different
    payloads are records of their own. Other columns are not used; an empty
    table gives an empty archive and no rows.
    """
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    write_archives(chunk_rows(pages, id_col, url_col, payload_col, min_bytes=min_bytes, chunk_bytes=chunk_bytes), path)
    kind = pages.schema[id_col].dataType
    got = read_archives(spark, path)
    return got.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast(kind).alias("refers_to"), F.col("url").alias("target_uri"), "n_chunks")
