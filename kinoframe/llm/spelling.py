"""Spelling variant grouping with PartEnum signatures.

A word is the multiset of its letters, a binary vector with one dimension for
each occurrence of a letter. A replaced letter moves the vector by a Hamming
distance of two, an inserted or deleted one by one. The dimensions are
partitioned by letter into ``PARTS`` parts: of two words at distance k all
parts but k are equal, so every choice of k parts to leave out is enumerated,
and the sorted letters that stay are an exact signature. Letters alone do not
tell anagrams apart, so a signature also names the shorter word's length and
the half of the word, first or last, that the one edit leaves alone. Equal
signatures are joined and the edit distance verifies; a pair counts at the
first signature it shares only, so no pair has to be made distinct.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.llm.shards import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"
DAMAGE = 31          # a run is damaged when this divides its hash
MIN_LETTERS = 7      # of a word
MIN_COUNT = 2        # of a word, over all documents
PARTS = 3            # of the letters; one or two of them are left out in turn
MORE = 10            # times a word's count that its form must have


def damaged(run: Column, doc_id: Column) -> Column:
    """A run without the letter that the hash of document and run strikes out,
    if it strikes one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
                  ).otherwise(run)


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the damaged runs of whole texts of at least MIN_LETTERS code
    points and MIN_COUNT occurrences, counted over all documents (map-side
    first, so a frequent word costs a task one row)."""
    folded = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(folded, F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    words = runs.select(damaged(F.col("run"), F.col("id")).alias("word")).where(F.char_length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def letter_parts(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of the vocabulary in parts of about equal weight: the most
    frequent letter goes to the lightest part (90 letters at most come to the
    driver)."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count()
    found = sorted(((r["count"], r["c"]) for r in letters.collect()), key=lambda x: (-x[0], x[1]))
    made, weight = [""] * parts, [0] * parts
    for n, c in found:
        k = weight.index(min(weight))
        made[k], weight[k] = made[k] + c, weight[k] + n
    return made


def sorted_letters(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def signatures(words: DataFrame, parts: list[str]) -> DataFrame:
    """(word, n, place, signature): the signatures of each word, as 64-bit
    hashes. ``place`` names role, parts and side: pairs of equal length differ
    by two dimensions (role 0), of others the shorter (1) and the longer word
    (2) by one."""
    size = F.char_length("word")
    made = []

    def add(role: int, least: Column, half: Column, out: tuple[int, ...]) -> None:
        kept = F.translate("letters", "".join(parts[k] for k in out), "") if any(parts[k] for k in out) else F.col("letters")
        kind = min(role, 1)
        for side, end in ((0, F.substring(F.col("word"), F.lit(1), half)), (1, F.substring(F.col("word"), size - half + 1, half))):
            place = F.lit(((role * 10 + out[0]) * 10 + out[-1]) * 2 + side)
            mark = F.xxhash64(F.lit(((kind * 10 + out[0]) * 10 + out[-1]) * 2 + side), least, end, kept)
            made.append(F.struct(place.alias("place"), F.when(least >= MIN_LETTERS, mark).alias("signature")))

    for out in combinations(range(len(parts)), 2):
        add(0, size, F.floor(size / 2).cast("int"), out)
    for role, least in ((1, size), (2, size - 1)):
        for k in range(len(parts)):
            add(role, least, F.floor((least + 1) / 2).cast("int"), (k,))
    return (words.withColumn("letters", sorted_letters(F.col("word"))).select("word", "n", F.inline(F.array(*made)))
            .where("signature is not null"))


def _first_shared(parts: list[str]) -> Column:
    """Whether the signature that brought x and y together is the first that
    they share: the first half before the last, the least choice of parts."""
    place = F.col("x.place")
    role, a, b = F.floor(place / 200), F.floor(place / 20) % 10, F.floor(place / 2) % 10
    least = F.least(F.char_length("x.word"), F.char_length("y.word"))
    half = F.when(role == 0, F.floor(least / 2)).otherwise(F.floor((least + 1) / 2)).cast("int")
    head = lambda c: F.substring(F.col(c), F.lit(1), half)
    by_side = (place % 2 == 0) | (head("x.word") != head("y.word"))
    letters = F.array(*[F.lit(p) for p in parts])

    def same_but(k: Column) -> Column:
        # both letters of the edit belong to part k
        gone = F.element_at(letters, (k + 1).cast("int"))
        without = lambda c: F.call_function("translate", F.col(c), gone, F.lit(""))
        return without("x.word") == without("y.word")

    first = F.when(same_but(a), (a == 0) & (b == 1) | (a == 0) & (b == 0)).when(same_but(b), a == 0).otherwise(True)
    return by_side & ((role > 0) | first)


def near_pairs(words: DataFrame, parts: list[str]) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words at edit distance one, once; a is
    the smaller of equal lengths, else the shorter."""
    signed = signatures(words, parts)
    x, y = signed.alias("x"), signed.alias("y")
    role_x, role_y = F.floor(F.col("x.place") / 200), F.floor(F.col("y.place") / 200)
    rest = F.lit(200)
    last = lambda c: F.right(F.col(c), F.lit(1))
    but_last = lambda c: F.substring(F.col(c), F.lit(1), F.char_length(c) - 1)
    # an edit that is not the last letter's leaves that alone: a cheap test before the edit distance
    ends = (last("x.word") == last("y.word")) | (but_last("x.word") == but_last("y.word")) | (role_x == 1)
    return (x.join(y, (F.col("x.signature") == F.col("y.signature")) & (F.col("x.place") % rest == F.col("y.place") % rest)
                   & ((role_x == 0) & (role_y == 0) & (F.col("x.word") < F.col("y.word")) | (role_x == 1) & (role_y == 2))
                   & ends & (F.levenshtein("x.word", "y.word", 1) == 1) & _first_shared(parts))
            .select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")))


def group_spellings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each word (see :func:`count_words`): word, form, root, n, n_near,
    form_n.

    Near words differ by one inserted, deleted or replaced code point; a
    word's form is its near word of largest n (ties: the smallest), if that is
    MORE times the word's n or more; root follows forms to the last. Null and
    empty texts have no words, a null id counts as an empty one, every
    repeated row counts, an empty table gives no rows; other columns are not
    regarded.
    """
    words = written(count_words(docs, id_col=id_col, text_col=text_col), "spelling-words")
    pairs = near_pairs(words, letter_parts(words))
    near = lambda w, v, n: F.struct(F.col(w).alias("word"), (-F.col(n)).alias("less"), F.col(v).alias("form"))
    both = pairs.select(F.inline(F.array(near("a", "b", "b_n"), near("b", "a", "a_n"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "form")).alias("f"))
    is_form = -F.col("f.less") >= MORE * F.col("n")
    got = words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("f.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("f.less")).alias("form_n"))
    got = written(got, "spelling-forms")
    # a form has ten times the count, so chains are short; each round doubles the step
    jump = got.where("form is not null").select(F.col("word").alias("w"), F.col("form").alias("to"))
    while True:
        nxt = jump.alias("x").join(jump.alias("y"), F.col("x.to") == F.col("y.w"), "left").select(
            "x.w", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved"))
        nxt = written(nxt, "spelling-roots")
        jump = nxt.select("w", "to")
        if nxt.where("moved").isEmpty():
            break
    return (got.join(jump, F.col("word") == F.col("w"), "left")
            .select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"))
