"""Secret scan with corpus-wide ownership frequency.

Patterns give candidates; each candidate's hash is aggregated over the whole
corpus by distinct repositories and owners. A value that many owners carry,
or two of them in many repositories, is a copied example; one that stays
with its owner, in however many repositories, looks live.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.llm.shards import Block, annotate, byte_class, runs, written

EXAMPLE_OWNERS = 3     # that carry a copied example
EXAMPLE_REPOS = 8      # or two owners in so many repositories

# The base kinds in their order, then the kinds this method adds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ADDED = [
    ("key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("git", re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}")),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("url", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:([^\s/:@]{3,})@")),
]
KINDS = ["assign", "access", "hex"] + [k for k, _ in ADDED]
HINTS = {"key": b"PRIVATE KEY-----", "git": b"gh", "chat": b"xox", "jwt": b"eyJ", "url": b"://"}
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
HEX_BYTES = byte_class((0x30, 0x39), (0x61, 0x66))


def find_spans(raw: bytes, hex_run: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every candidate of a text, in order;
    offsets are code points, ends exclusive."""
    low = raw.lower()
    assign = any(h in low for h in ASSIGN_HINTS)
    access = b"AKIA" in raw
    added = [(k, p) for k, p in ADDED if HINTS[k] in raw]
    if not (assign or access or hex_run or added):
        return []
    text = raw.decode("utf-8", "replace")
    out = []
    if assign:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hex_run:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for k, p in added:
        out += [(m.start(), KINDS.index(k), m.end(), m[1] if p.groups else m[0]) for m in p.finditer(text)]
    return sorted(out)


def listed(spans: list[tuple[int, int, int, str]], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans if k < kinds)


def _scan(block: Block) -> dict:
    a, b = runs(HEX_BYTES[block.data], block.off)
    with_hex = set(np.unique(block.doc_of(a[b - a >= 24])).tolist())
    spans = [find_spans(block.text(i), i in with_hex) for i in range(block.n)]
    count = lambda kind: np.array([sum(k == kind for _, k, _, _ in s) for s in spans], np.int64)
    return {"n_assign": count(0), "n_access": count(1), "n_hex": count(2),
            "base_sha256": [hashlib.sha256(listed(s, 3).encode()).hexdigest() for s in spans],
            "spans": [listed(s) for s in spans],
            "__values": [sorted({hashlib.sha256(v.encode()).hexdigest()[:32] for *_, v in s}) for s in spans]}


RESULT = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()),
          ("base_sha256", T.StringType()), ("spans", T.StringType())]


def ownership(found: DataFrame, values_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """value, n_docs, n_repos, n_owners over all rows. A value that a third
    of the corpus carries is summed map-side per (value, repository, owner)
    first, so no task meets its rows."""
    rows = found.select(F.explode(values_col).alias("value"),
                        F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"),
                        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"))
    pairs = rows.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    repos = pairs.groupBy("value", "repo").agg(F.sum("n").alias("n")).select("value", "n", F.lit(1).alias("r"), F.lit(0).alias("o"))
    owners = pairs.groupBy("value", "owner").agg(F.lit(0).alias("n")).select("value", "n", F.lit(0).alias("r"), F.lit(1).alias("o"))
    return repos.unionByName(owners).groupBy("value").agg(F.sum("n").alias("n_docs"), F.sum("r").alias("n_repos"),
                                                          F.sum("o").alias("n_owners"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None,
                 owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS,
                 example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row a document: the id, base counts, base_sha256, all spans, and
    how many distinct values look live or are widely copied examples: with
    ``example_owners`` owners, or two of them and ``example_repos``
    repositories (without ``repo_col`` each document is one).

    Null and empty texts have no spans; a null repository or owner counts as
    one named ''. Spans that start together go by kind. Repeated rows are
    answered each for itself and count once as owner. An empty table gives
    no rows; other columns of ``docs`` are not used.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"),
                        F.col(f"`{repo_col or id_col}`").alias("__repo"), F.col(f"`{owner_col}`").alias("__owner"))
    found = annotate(given, "__text", RESULT + [("__values", T.ArrayType(T.StringType()))], _scan,
                     keep=["__id", "__repo", "__owner"])
    found = written(found.withColumn("__row", F.monotonically_increasing_id()), "secrets")
    some = found.where(F.size("__values") > 0)
    counts = ownership(some, "__values", "__repo", "__owner")
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    verdict = (some.select("__row", F.explode("__values").alias("value")).join(counts, "value")
               .groupBy("__row").agg(F.count_if(~copied).alias("n_live"), F.count_if(copied).alias("n_example"),
                                     F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos")))
    return (found.join(verdict, "__row", "left")
            .select(F.col("__id").alias(id_col), *[n for n, _ in RESULT],
                    *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                      for c in ("n_live", "n_example", "most_owners", "most_repos")]))
