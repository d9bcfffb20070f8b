"""Conversation structure repair with scalar big-integer weights.

A conversation should run ``(s?(ua)+)?`` by the first letters of its roles.
The cheapest edits that make it so are a shortest path over (row, state): a
path's weight is one integer whose high digits are its cost and whose low
digits are its audit letters, three bits each, the first letter highest and
zeros after the last. The smaller integer is the cheaper script and, among
equally cheap ones, the one whose audit is smaller in ASCII order, so a plain
minimum decides everything.

Rows move once by conversation as light rows (no text) to be decided and once
as texts to be written; both times a task streams its sorted rows, holding one
letter a row of a single conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.llm.shards import importable, written

SPACE = " \t\n\x0b\x0c\r"
DAMAGES = 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3   # costs
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}                # in ASCII order; 0 ends an audit
BITS = 3
START, SYSTEM, ASKED, ANSWERED = range(4)                 # what the rows so far end in
NEXT = {"u": {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}, "s": {START: SYSTEM}}
ROLES = {START: "user", SYSTEM: "user", ANSWERED: "user", ASKED: "assistant"}   # the role that a state waits for

VERDICT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; a row is its role's first letter,
    whether it must go, and whether it is truncated."""
    width = BITS * (3 * len(rows) + 8)     # an insertion costs 3, deleting all costs 4 a row
    low = (1 << width) - 1

    def then(letter: str, cost: int, rest: int) -> int:
        return (((rest >> width) + cost) << width) | (LETTERS[letter] << (width - BITS)) | ((rest & low) >> BITS)

    def inserted(best: list[int | None]) -> list[int | None]:
        asked, answered = best[ASKED], best[ANSWERED]
        after = lambda w: None if w is None else then("I", INSERT, w)
        least = lambda *w: min((x for x in w if x is not None), default=None)
        asked = least(asked, after(answered))
        return [least(best[START], after(asked)), least(best[SYSTEM], after(asked)), asked,
                least(answered, after(best[ASKED]))]

    best = inserted([0, None, None, 0])
    for initial, gone, cut in reversed(rows):
        made: list[int | None] = []
        for state in range(4):
            ways = [then("D", DELETE, best[state])]
            if not gone:
                more = TRUNCATED if cut else 0
                to = NEXT.get(initial, {}).get(state)
                if to is not None:
                    ways.append(then("K", KEEP + more, best[to]))
                ways.append(then("R", REROLE + more, best[NEXT[ROLES[state][0]][state]]))
            made.append(min(ways))
        best = inserted(made)
    weight, audit = best[START], []
    names = {v: k for k, v in LETTERS.items()}
    digits = weight & low
    for at in range(width - BITS, -1, -BITS):
        digit = (digits >> at) & ((1 << BITS) - 1)
        if not digit:
            break
        audit.append(names[digit])
    return weight >> width, "".join(audit)


class Judge:
    """Collects one conversation's rows in order and gives its verdict."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool]] = []
        self.count = [0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if fault:
            self.count[fault - 1] += 1
        self.rows.append((initial, fault in (1, 2), fault == 3))
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn

    def verdict(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.count, self.illegal, *cheapest(self.rows)]


class Writer:
    """The digest of a repaired conversation, row by row by its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.some = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.some else "").encode() + f"{role}:{text}".encode())
        self.some = True
        self.state = NEXT[role[0]][self.state]

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._put(ROLES[self.state], "")

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else ROLES[self.state], text)

    def close(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def damage(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): the rows after damage, decided by
    the hash of conversation and turn. A dropped row stays as a mark without
    text, so its conversation is not forgotten. Nulls count as one space."""
    c, t = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    spaced = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spaced(c), F.lit(":"), spaced(t)).cast("binary")) % DAMAGES
    text = spaced(F.col(f"`{text_col}`"))
    rows = conversations.select(
        c.alias("conv"), t.cast("long").alias("turn"), (k == 0).alias("dropped"), F.when(k == 3, 2).otherwise(1).alias("times"),
        F.when(k == 4, F.lit("user")).otherwise(spaced(F.col(f"`{role_col}`"))).alias("role"),
        F.when(k < 2, F.lit("")).when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def _by_conversation(batches: Iterator[pa.RecordBatch]):
    """The rows of sorted batches as (is new conversation, row)."""
    first, before = True, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            yield first or row[0] != before, row
            first, before = False, row[0]


def repair_conversations(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """For each conversation id: gaps, blank, duplicate, truncated, illegal,
    cost, audit and the SHA-256 of the repaired ``role:text`` rows.

    The rows are first damaged (:func:`damage`), then taken by turn, nulls
    first; rows of one turn by role and by their text's MD5. A null id is a
    conversation of its own, repeated rows are duplicates, a conversation that
    damage left without rows has zeros, an empty audit and the empty string's
    digest. An empty table gives no rows; other columns are not regarded. A
    role's first letter is that of its text as it is; a role without one fits
    nowhere. Deciding takes time in the square of one conversation's rows
    over the machine word, its memory is a letter a row.
    """
    importable(conversations.sparkSession)
    rows = damage(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    rows = rows.withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))
    ending = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.select("conv", "turn", "role", "mark", F.when(F.col("dropped"), -1).when(ending == "", 1)
                        .when(F.right(ending, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3).alias("fault"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "mark", F.col("fault") < 0).orderBy(F.asc_nulls_first("turn"))) > 1
    light = light.withColumn("fault", F.when(again & F.col("fault").isin(0, 3), 2).otherwise(F.col("fault")))
    light = (light.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "mark")
             .select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault"))
    conv_type = conversations.schema[conv_col].dataType.simpleString()
    verdict_schema = f"conv {conv_type}, {VERDICT}"
    batch_rows = 4096

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        now, conv = None, None

        def flush() -> pa.RecordBatch:
            made = [pa.array(list(c), type=pa.string() if i == 7 else None if i == 0 else pa.int64())
                    for i, c in enumerate(zip(*out))]
            made[0] = pa.array([r[0] for r in out], type=key_type)
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=["conv", *(f.split()[0] for f in VERDICT.split(", "))])

        key_type = None

        def typed():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("conv").type
                yield batch

        for new, (key, turn, initial, fault) in _by_conversation(typed()):
            if new:
                if now is not None:
                    out.append([conv, *now.verdict()])
                    if len(out) >= batch_rows:
                        yield flush()
                now, conv = Judge(), key
            if fault >= 0:
                now.add(turn, initial, fault)
        if now is not None:
            out.append([conv, *now.verdict()])
            yield flush()

    verdicts = written(light.mapInArrow(judge, verdict_schema), "repair-verdicts")
    names = [f.split()[0] for f in VERDICT.split(", ")]
    heads = verdicts.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
                            F.lit(None).cast("binary").alias("mark"), F.lit(0).alias("kind"))
    lines = rows.where("not dropped").select("conv", "turn", "role", "text", "mark", F.lit(1).alias("kind"))
    lines = (heads.unionByName(lines).repartition("conv")
             .sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "role", "mark").select("conv", "kind", "role", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, done, now, conv = None, [], None, None

        def typed():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("conv").type
                yield batch

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], type=key_type),
                                               pa.array([d for _, d in done], type=pa.string())], names=["conv", "repaired_sha256"])
            done.clear()
            return made

        for new, (key, kind, role, text) in _by_conversation(typed()):
            if new:
                if now is not None:
                    done.append((conv, now.close()))
                    if len(done) >= batch_rows:
                        yield flush()
                now, conv = Writer(text), key
            elif kind:
                now.add(role, text)
        if now is not None:
            done.append((conv, now.close()))
            yield flush()

    digests = lines.mapInArrow(write, f"conv {conv_type}, repaired_sha256 string")
    got = verdicts.alias("v").join(digests.alias("d"), F.col("v.conv").eqNullSafe(F.col("d.conv")))
    return got.select(F.col("v.conv").alias(conv_col), *names, "repaired_sha256")
