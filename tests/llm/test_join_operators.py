"""Jaccard join, spelling variants and conversation repair against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinoframe.llm import conversation_repair, parity_join, spelling
from kinoframe.llm.shards import blocks
from tests.llm.fixtures import awkward, documents, empty, lower, prose, with_null_id


# --- Jaccard join ---

def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def joined(texts):
    """(set size, smallest linked index) of each text, all pairs compared."""
    sets, least = [shingled(t) for t in texts], list(range(len(texts)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    for a, b in itertools.combinations(range(len(texts)), 2):
        shared, total = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if total and 100 * shared >= 85 * total:
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(seed, n, words, changed):
    r = random.Random(seed)
    base = prose(seed, words, 10**6).split()
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, changed)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        yield " ".join(w)


def test_jaccard_join_against_brute_force(spark):
    passage = prose(77, 60, 10**6)
    texts = awkward() + ["one", "One two", "one TWO three", "one two three", "one two three four", "nothing else"]
    for k, (n, words, changed) in enumerate([(40, 60, 4), (40, 200, 12), (25, 7, 1), (25, 12, 2), (10, 2500, 90)]):
        texts += near_copies(100 + k, n, words, changed)
    texts += [prose(500 + k, 40, 10**6) + " " + passage for k in range(60)]   # share 60 of 100 words and no more
    got = parity_join.jaccard_components(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == joined(texts)
    sizes = collections.Counter(r["component_id"] for r in got)
    assert all(r["class_size"] == sizes[r["component_id"]] for r in got if r["n_shingles"])
    assert got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id", "class_size"}


def test_jaccard_join_null_ids_repeats_and_no_rows(spark):
    texts = [prose(1, 30), prose(1, 30), None]
    rows = with_null_id(spark, documents(spark, texts))
    twice = rows.unionByName(rows)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["class_size"])
                  for r in parity_join.jaccard_components(twice).collect()), key=str)
    assert got == sorted([(0, 27, 0, 4), (1, 27, 0, 4), (2, 0, 2, 1), (None, 2, None, 2)] * 2, key=str)
    assert parity_join.jaccard_components(empty(spark)).collect() == []


def test_sketch_blocks_are_shared_by_every_linked_pair():
    r = random.Random(5)
    rarity = np.ones(parity_join.CELLS, np.uint16)
    for _ in range(300):
        n = r.randint(1, 400)
        a = {r.getrandbits(52) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            c.discard(r.choice(sorted(c))) if r.random() < 0.5 and len(c) > 1 else c.add(r.getrandbits(52))
            if 100 * len(a & c) < 85 * len(a | c):
                break
            b = c
        marks = [np.array(sorted(x), np.uint64) for x in (a, b)]
        first = np.array([0, len(marks[0]), len(marks[0]) + len(marks[1])])
        both = np.concatenate(marks)
        fold = parity_join.folded(first, both)
        apart = sum(int(x).bit_count() for x in (fold[0] ^ fold[1]).view(np.uint64).tolist())
        assert apart <= len(a ^ b) <= parity_join.most_differing(len(a) + len(b), 85, 100)
        if a != b:
            at, key = parity_join.block_keys(first, both, rarity, 85, 100)
            assert set(key[at == 0].tolist()) & set(key[at == 1].tolist())


def test_word_hashes_tell_words_apart():
    texts = ["ab" * 70, "ab" * 64, "a", "a\x00", "é", "", "abcdefgh", "abcdefghi", "abcdefg"]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    block = next(iter(blocks(batch, "t")))
    starts, ends = block.off[:-1], block.off[1:]
    assert len(set(parity_join.word_hashes(block.data, starts, ends).tolist())) == len(texts)


# --- spelling variants ---

def spelled(rows):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:j] + b[j + 1:] == a for j in range(len(b)))
    out = {}
    for w, k in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * k else None
        out[w] = [form, w, k, len(close), words[form] if form else None]
    for w, made in out.items():
        while out[made[1]][0]:
            made[1] = out[made[1]][0]
    return {w: tuple(v) for w, v in out.items()}


def variants(seed):
    r = random.Random(seed)
    letters = "abcdeéàÿ÷"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 11))) for _ in range(14)]
    words = []
    for w in base:
        words += [w] * r.choice([2, 40, 400])
        for _ in range(12):
            at, how = r.randrange(len(w)), r.randrange(4)
            new = [w[:at] + w[at + 1:], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1:],
                   "".join(r.sample(w, len(w)))][how]
            words += [new] * r.choice([1, 2, 3, 30])
            words += [new[:1] + "b" + new[1:]] * r.choice([0, 2])
    r.shuffle(words)
    return [" ".join(words[k::9]) for k in range(9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_against_brute_force(spark, seed):
    texts = awkward() + variants(seed) + ["ABCDEFGH abcdefgh Àbcdefgh àbcdefgh"] * 3
    docs = with_null_id(spark, documents(spark, texts))
    want = spelled([*enumerate(texts), (None, "no id here at all")])
    got = spelling.group_spellings(docs).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want) and sum(r["form"] is not None for r in got) > 20


def test_spelling_chains_and_no_rows(spark):
    text = " ".join(["kitchens"] * 2 + ["kitchenz"] * 30 + ["kitchez"] * 400)
    docs = documents(spark, [text])
    got = {r["word"]: r for r in spelling.group_spellings(docs).collect()}
    assert got["kitchens"]["form"] == "kitchenz" and got["kitchens"]["root"] == "kitchez"
    assert (got["kitchez"]["root"], got["kitchez"]["form"], got["kitchez"]["n_near"]) == ("kitchez", None, 1)
    assert spelling.group_spellings(empty(spark)).collect() == []


def test_each_near_pair_is_joined_once(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(7, 8))) for _ in range(700)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r["a"], r["b"]) for r in spelling.near_pairs(table, ["a", "b", "c"]).collect()]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if distance_one(*p)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:j] + b[j + 1:] == a for j in range(len(b)))


# --- conversation repair ---

GOOD = re.compile(r"(s?(ua)+)?\Z")


def scripts(rows):
    """Every edit script as (cost, audit, repaired rows): all choices for each
    row, up to two insertions before each and at the end."""
    made = [(0, "", ())]
    inserts = [p for n in range(3) for p in itertools.product(["user", "assistant"], repeat=n)]
    for k in range(len(rows) + 1):
        made = [(c + 3 * len(p), a + "I" * len(p), t + tuple((x, "") for x in p)) for c, a, t in made for p in inserts]
        made = [m for m in made if fits(m[2])]
        if k == len(rows):
            break
        role, text, gone, cut = rows[k]
        ways = [(4, "D", ())]
        if not gone:
            more = 3 if cut else 0
            ways += [(more, "K", ((role, text),)), (3 + more, "R", (("user", text),)), (3 + more, "R", (("assistant", text),))]
        made = [(c + c2, a + a2, t + t2) for c, a, t in made for c2, a2, t2 in ways]
        made = [m for m in made if fits(m[2])]
    return [m for m in made if GOOD.match("".join(r[:1] for r, _ in m[2]))]


def fits(rows):
    return re.match(r"s?(ua)*u?\Z", "".join(r[:1] or "-" for r, _ in rows)) is not None


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def repaired(conv, rows):
    rows, seen, judged, count = damaged(conv, rows), set(), [], collections.Counter()
    for _, role, text in rows:
        last = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
        seen.add((role, text))
        count[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, kept = min(scripts(judged))
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONVERSATIONS = "conv_id long, turn long, role string, text string, cost string, Audit string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], CONVERSATIONS)


def test_conversation_repair_against_all_scripts(spark):
    r = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "USER"]
    texts = ["Yes.", "No", "a\nb? \t", "", " \n", None, "é!", "\U0001F600", "z" * 3000 + "."]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(r.randint(0, 4)):
            at = r.choice([turn, turn, turn, turn + 2, None, 0])
            usual = r.random() < 0.6
            rows.append((conv, at, roles[turn % 2] if usual else r.choice(roles), "Fine. " + str(turn) + "." if usual else r.choice(texts)))
    rows += rows[:9]
    got = conversation_repair.repair_conversations(conversations(spark, rows)).collect()
    want = collections.defaultdict(list)
    for conv, *rest in rows:
        want[conv].append(rest)
    assert len(got) == len(want)
    for g in got:
        assert tuple(g[c] for c in COLUMNS) == repaired(g["conv_id"], want[g["conv_id"]]), (g, want[g["conv_id"]])


def test_conversation_repair_without_rows(spark):
    assert conversation_repair.repair_conversations(conversations(spark, [])).collect() == []
    dropped = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = conversation_repair.repair_conversations(conversations(spark, [(*dropped, "user", "Hm.")])).collect()
    assert [tuple(g[c] for c in COLUMNS) for g in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_is_cheapest(spark):
    r = random.Random(4)
    rows = [(r.choice("uas"), r.random() < 0.1, r.random() < 0.1) for _ in range(3000)]
    cost, audit = conversation_repair.cheapest(rows)
    # the same by pairs of cost and audit, decided backwards
    best = {0: (0, ""), 3: (0, "")}

    def with_inserts(v):
        ask = min(x for x in (v.get(2), (v[3][0] + 3, "I" + v[3][1]) if 3 in v else None) if x)
        answer = min(x for x in (v.get(3), (v[2][0] + 3, "I" + v[2][1]) if 2 in v else None) if x)
        first = (ask[0] + 3, "I" + ask[1])
        return {0: min(v.get(0, first), first), 1: min(v.get(1, first), first), 2: ask, 3: answer}
    best = with_inserts(best)
    step = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}
    for initial, gone, cut in reversed(rows):
        made = {}
        for s in range(4):
            ways = [(best[s][0] + 4, "D" + best[s][1])]
            if not gone:
                more = 3 * cut
                if (initial, s) in step:
                    to = best[step[initial, s]]
                    ways.append((to[0] + more, "K" + to[1]))
                to = best[3 if s == 2 else 2]
                ways.append((to[0] + 3 + more, "R" + to[1]))
            made[s] = min(ways)
        best = with_inserts(made)
    assert (cost, audit) == best[0]
