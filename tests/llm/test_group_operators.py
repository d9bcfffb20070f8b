"""Operators that compare rows with each other, against brute force."""

import base64
import collections
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinoframe.llm import components, line_dedup, near_dup, suffix_dedup, warc
from tests.llm.fixtures import awkward, documents, empty, prose, with_null_id, words


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def without_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 22, 3000])
def test_suffix_dedup(spark, shard_bytes):
    r = random.Random(5)
    base = [prose(k, 150) for k in range(6)]
    texts = [t for t in awkward() if t is None or len(t) < 20_000] + base
    for _ in range(30):
        a, b = r.choice(base), r.choice(base)
        i, j = r.randrange(len(a)), r.randrange(len(b))
        texts.append(a[i:i + r.randrange(150, 420)] + prose(r.random(), 10) + b[j:j + r.randrange(100, 500)])
    texts += ["ab" * 400, "x" * 199, "x" * 200, "x" * 201, base[0][:200], base[0][7:207]]
    df = with_null_id(spark, documents(spark, texts)).repartition(4)
    got = by_id(suffix_dedup.remove_repeats(df, shard_bytes=shard_bytes, bucket_bytes=20_000))
    for i, e in enumerate(without_repeats(texts, 200)):
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == e, (i, texts[i])
    assert len(got) == len(texts) + 1


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    cover = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))
    got = suffix_dedup.remove_repeats(documents(spark, ["abc" * 100, None]), with_text=True).collect()
    assert {bytes(r["kept"]) for r in got} == {b""}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, n_chunks string")


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 7])
def test_warc_round_trip(spark, chunk_bytes):
    tricky = "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = ["<p>é</p>", "", None, tricky, "\n\n", "\r\n\r\n\r\n", "x" * 5000, "x" * 5000, "x" * 5000, "ends\n", "é" * 33]
    rows = [(i, f"http://a/{i}\nX: %", h, "c") for i, h in enumerate(bodies)] + [(None, None, "x" * 5000, "c"), (8, "u", "x" * 5000, "c")]
    got = collections.defaultdict(list)
    for r in warc.round_trip(pages(spark, rows).repartition(3), chunk_bytes=chunk_bytes).collect():
        got[r["page_id"]].append(r)
    largest = {}
    for i, _, h, _ in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    for i, url, h, _ in rows:
        raw, top = (h or "").encode(), largest[h or ""]
        e = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit",
             None if i == top else top)
        assert e in [(r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got[i]], i
        assert (url or "") in [r["target_uri"] for r in got[i]]
    assert sum(map(len, got.values())) == len(rows)
    assert warc.round_trip(pages(spark, []), chunk_bytes=chunk_bytes).count() == 0


def records(raw):
    """An archive's records as (headers, block), by the format's grammar."""
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        h = dict(x.split(": ", 1) for x in lines)
        n = int(h["Content-Length"])
        assert version == "WARC/1.1" and len(h) == len(lines) and rest[n:n + 4] == b"\r\n\r\n"
        out.append((h, rest[:n]))
        raw = rest[n + 4:]
    return out


def test_warc_archives_stand_by_their_standard_headers(spark, tmp_path):
    rows = [(1, "http://a/1", "x" * 50, "c"), (2, "http://a/2", "x" * 50, "c"), (3, "http://a/3", "", "c"),
            (4, "http://a/4", "a\r\n\r\nb", "c"), (None, "http://a/5", "é" * 9, "c"), (None, "http://a/6", "x" * 50, "c")]
    warc.write_archives(warc.chunk_rows(pages(spark, rows).repartition(2), chunk_bytes=16), str(tmp_path / "w"))
    found = [r for f in sorted((tmp_path / "w").glob("*.gz")) for r in records(gzip.decompress(f.read_bytes()))]
    ids = [h["WARC-Record-ID"] for h, _ in found]
    assert len(set(ids)) == len(ids) and all(h["WARC-Target-URI"].startswith("http://a/") and h["WARC-Date"] for h, _ in found)
    payload, first = collections.defaultdict(bytes), {}
    for h, block in found:
        kind = h["WARC-Type"]
        if kind == "continuation":
            assert h["WARC-Segment-Origin-ID"] in first and int(h["WARC-Segment-Number"]) > 1
            payload[h["WARC-Segment-Origin-ID"]] += block
            if "WARC-Segment-Total-Length" in h:
                assert len(payload[h["WARC-Segment-Origin-ID"]]) == int(h["WARC-Segment-Total-Length"])
            continue
        first[h["WARC-Record-ID"]] = h
        payload[h["WARC-Record-ID"]] = block
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    kinds = collections.Counter(h["WARC-Type"] for h in first.values())
    assert kinds == {"response": 4, "revisit": 2}
    for i, h in first.items():
        if h["WARC-Type"] == "revisit":
            assert h["WARC-Profile"] == warc.PROFILE and payload[i] == b""
            assert first[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
        else:
            assert h["WARC-Payload-Digest"] == digest(payload[i]) and h["Content-Type"] == warc.CONTENT


def test_a_damaged_payload_is_noticed():
    good = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7:X>\r\nWARC-Target-URI: u\r\n"
            b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()) + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    reader = warc.Reader()
    got = [*reader.feed(good), *reader.close()]
    assert [(r["page_id"], r["payload_bytes"]) for r in got] == [("7", 3)]
    reader = warc.Reader()
    with pytest.raises(ValueError):
        [*reader.feed(good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n")), *reader.close()]


def test_chunk_table_has_bounded_rows(spark):
    rows = warc.chunk_rows(pages(spark, [(1, "u", "y" * 1000, "c")]), chunk_bytes=64).orderBy("chunk").collect()
    assert [len(r["bytes"]) for r in rows] == [64] * 15 + [40] and b"".join(bytes(r["bytes"]) for r in rows) == b"y" * 1000


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    real = [x for x in links if x[0] != x[1]]
    e = groups(real, {n for x in real for n in x})
    got = {x["id"]: x["class"] for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == e


def jaccard(a, b):
    s = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (words(a), words(b))]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def near_fixture():
    r = random.Random(11)
    texts = awkward() + ["three small words", "Three, small words!"]
    for g in range(12):
        base = prose(500 + g, 400, 4000).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts + [prose(900 + k, 200, 4000) for k in range(20)]


def test_near_duplicates(spark):
    texts = near_fixture()
    df = with_null_id(spark, documents(spark, texts)).repartition(3)
    rows, verdict = near_dup.near_duplicates(df)
    got = {r["id"]: r for r in verdict.collect()}
    pairs = [(i, j, jaccard(texts[i], texts[j])) for i in range(len(texts)) for j in range(i) if words(texts[i]) and words(texts[j])]
    for i, j, s in pairs:
        if s >= 0.82:
            assert got[i]["class_id"] == got[j]["class_id"], (i, j, s)
    strict = groups([(i, j) for i, j, s in pairs if s >= 0.75], range(len(texts)))
    for i in range(len(texts)):
        assert strict[i] == strict[got[i]["class_id"]]
        assert got[i]["kept"] == (got[i]["class_id"] == i) and got[i]["class_id"] <= i
    assert all(got[i]["class_size"] == 1 for i, t in enumerate(texts) if not words(t)) and got[None]["kept"]
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert near_dup.drop_near_duplicates(empty(spark)).count() == 0


def copies_of_a_text(n, changes):
    """A text and copies of it, each with words of its own in a few places, some without others."""
    r = random.Random(41)
    base = prose(600, 200, 4000).split()
    texts = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for c in range(changes[k % len(changes)]):
            w[r.randrange(len(w))] = f"own{k}x{c}"
        if k % 3 == 0:
            del w[10 * r.randrange(20)]
        texts.append(" ".join(w))
    return texts


def test_pairs_of_a_large_group_of_copies(spark, monkeypatch):
    """Copies that resemble their group's text, but are no links, are not all compared with each other."""
    texts = copies_of_a_text(150, [6, 6, 6, 2])
    compared, verified = [], near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(documents(spark, texts).repartition(3))[1].collect()}
    assert sum(got[k] == 0 for k in got) >= 30 and len(set(got.values())) >= 90
    assert compared[-1] <= 5 * len(texts)   # the last are those between classes


def test_pairs_between_classes_leave_out_no_link(spark):
    import numpy as np
    texts = copies_of_a_text(60, [1, 2, 3, 5]) + [" ".join(prose(600, 200, 4000).split()[:n]) for n in (150, 165, 180)] \
        + ["a b c d e f g h", "a b c d e f g h a b c d e f g", "one two"]
    rows = [(k, t) for k, t in enumerate(texts)]
    weights = near_dup.weights_of(np.arange(near_dup.CELLS) % 977, 977)
    sets = []
    for t in texts:
        raw = t.encode()
        block = near_dup.Block(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        _, mark, count, _ = near_dup.shingles(block)
        sets.append((mark, count * weights[(mark % np.uint64(near_dup.CELLS)).astype(np.int64)]))
    links = {(i, j) for i in range(len(texts)) for j in range(i) if near_dup.similarity_of(sets[i], sets[j]) >= 0.8}
    rest = [(k, k // 2, k % 4 > 1) for k in range(len(texts))]
    want = {(i, j) for i, j in links if i // 2 != j // 2 and (i % 4 > 1 or j % 4 > 1)}
    got = near_dup._between(spark.createDataFrame(rest, "id long, class long, minor boolean"),
                            spark.createDataFrame(rows, "id long, __text string").repartition(3),
                            spark.sparkContext.broadcast(weights), 0.8).collect()
    assert len(want) > 100 and want <= {(r["a"], r["b"]) for r in got}
    assert all(i // 2 != j // 2 and (i % 4 > 1 or j % 4 > 1) for i, j in got) and len(got) == len(set(got))


def test_wanted_texts_cross_alone(spark, monkeypatch):
    texts = spark.range(-300, 5000).withColumn("__text", F.col("id").cast("string"))
    wanted = spark.createDataFrame([(k, k + 1) for k in range(-300, 5000, 90)] + [(9000, 1)], "id long, class long")
    for bits in (near_dup.ID_BITS, 64):   # nearly all bits of the smaller are set
        monkeypatch.setattr(near_dup, "ID_BITS", bits)
        got = near_dup._only(texts, wanted).collect()
        assert sorted((r["id"], r["__text"], r["class"]) for r in got) == [(k, str(k), k + 1) for k in range(-300, 5000, 90)]
    assert near_dup._only(texts, wanted.limit(0)).count() == 0


def test_weighted_samples_estimate_similarity():
    import numpy as np
    r = np.random.default_rng(1)
    mark = np.sort(r.integers(0, 2**63, 3000, dtype=np.uint64))
    w = 1 + r.random(3000)
    a, b = slice(0, 2400), slice(600, 3000)
    true = w[600:2400].sum() / w.sum()
    same = near_dup.signatures(np.array([0, 2400]), mark[a], w[a]) == near_dup.signatures(np.array([0, 2400]), mark[b], w[b])
    assert abs(same.mean() - true) < 0.25
    assert near_dup.similarity_of((mark[a], w[a]), (mark[b], w[b])) == pytest.approx(true)


def test_samples_do_not_depend_on_the_block():
    import numpy as np
    r = random.Random(5)
    sizes = [1, 40, 700, 3, 90]
    mark = np.array([r.getrandbits(64) for _ in range(sum(sizes))], np.uint64)
    weight = np.array([1 + r.random() for _ in mark], np.float32)
    first = np.cumsum([0] + sizes)
    whole = near_dup.signatures(first, mark, weight)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        assert (near_dup.signatures(np.array([0, b - a]), mark[a:b], weight[a:b])[0] == whole[i]).all()
    assert near_dup._draws()[0] is near_dup._draws()[0]   # made once, however small the blocks


def test_pairs_at_the_threshold_share_a_band():
    import numpy as np
    r = np.random.default_rng(4)
    n, each, both = 2000, 100, 89   # 89 of 111 shingles shared: 0.80
    mark = r.integers(0, 2**63, (n, 2 * each - both), dtype=np.uint64)
    first, weight = np.arange(n + 1) * each, np.ones(n * each)
    a, b = (near_dup.signatures(first, m.ravel(), weight).astype(np.uint64) for m in (mark[:, :each], mark[:, -each:]))
    shared = (near_dup.band_keys(a) == near_dup.band_keys(b)).any(1)
    assert (~shared).sum() <= 3
    agree = ((a & np.uint64(15)) == (b & np.uint64(15))).sum(1)
    assert (agree < near_dup.MIN_AGREE).sum() <= 1


@pytest.mark.parametrize("shard_bytes", [1 << 22, 2000])
def test_line_dedup(spark, shard_bytes):
    common, other = "This very common line stands in many texts of this small corpus.", prose(31, 40, 5000)
    near = other.replace(other[50:53], "qq", 1)
    texts = [common + "\n" + prose(1, 30, 5000), None, "", "short\nshort\nshort", prose(2, 30, 5000) + "\n" + common.upper() + "  !",
             other + "\nx", "y\n" + near + "\nz", common, common + "\n" + common, "\n\n", prose(3, 20, 5000)]
    df = with_null_id(spark, documents(spark, texts)).coalesce(1)
    rows = by_id(line_dedup.dedup_lines(df, keep=["doc_id", "lang", "row", "id"], shard_bytes=shard_bytes))
    assert len(rows) == len(texts) + 1
    assert rows[0]["kept"] == texts[0] and rows[3]["kept"] == "short" and rows[1]["kept"] == "" == rows[2]["kept"]
    assert rows[4]["kept"] == texts[4].split("\n")[0] and rows[7]["kept"] == "" and rows[8]["kept"] == ""
    assert rows[5]["kept"] == texts[5] and rows[9]["kept"] == "\n\n" and rows[10]["kept"] == texts[10]
    assert rows[6]["kept"] == "y\nz" and rows[8]["n_removed"] == 2
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_short_lines_numbers_and_odd_sequences(spark):
    texts = ["Free shipping!", "free  Shipping", "Free shopping!", "1234 5678 9012 3456 7890 1122\n9876 5432 1098 7654 3210 9988",
             "...", "...", "Free shipping!\na text of its own stands here", "é", "É", "é!"]
    rows = by_id(line_dedup.dedup_lines(documents(spark, texts).coalesce(1), keep=["doc_id"]))
    kept = {k for k in range(len(texts)) if rows[k]["kept"] == texts[k]}
    assert kept == set(range(len(texts))) - {1, 6, 9}
    assert rows[6]["kept"] == "a text of its own stands here"
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    odd = ["".join("ab"[b ^ x] for b in bits) for x in (0, 1)]   # equal by any polynomial modulo 2**64
    shards = suffix_dedup.shard_table(documents(spark, odd).select(F.struct("doc_id").alias("row"), "text"), "row", "text", 1 << 20, 4)
    assert line_dedup.line_groups(shards)[1].count() == 2


def test_equal_simhash_lines_are_verified_by_edits(spark):
    a = "one two three four five six seven eight nine ten"
    texts = [a, a.replace("ten", "tem"), prose(77, 12, 9000)]
    shards = suffix_dedup.shard_table(documents(spark, texts).select(F.struct("doc_id").alias("row"), "text"), "row", "text", 1 << 20, 4)
    _, lines, _ = line_dedup.line_groups(shards)
    pairs = lines.select(F.col("id").alias("a")).crossJoin(lines.select(F.col("id").alias("b"))).where("a < b")
    assert line_dedup._verified(pairs, lines, shards, 0.8).count() == 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed_lines():
    """Lines and later ones with some words of each changed."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 7)))
    first, later = [], []
    for n in (10, 20, 40):
        for k in range(20):
            w = [word() for _ in range(n)]
            first.append(" ".join(w))
            for _ in range(1 + k % (n // 10)):
                w[r.randrange(n)] = word()
            later.append(" ".join(w))
    return first, later


@pytest.mark.parametrize("small", [256, 1])
def test_lines_with_changed_words_are_removed(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    first, later = changed_lines()
    near = [k for k, (a, b) in enumerate(zip(first, later)) if edit_distance(a, b) <= 0.2 * max(len(a), len(b)) and a != b]
    assert len(near) >= 50
    rows = by_id(line_dedup.dedup_lines(documents(spark, first + later).coalesce(1), keep=["doc_id"]))
    for k in near:
        assert rows[k]["kept"] == first[k] and rows[len(first) + k]["kept"] == "", (first[k], later[k])
    assert not any(rows[k]["n_removed"] for k in range(len(first)))


def test_edit_distances_do_not_pass_the_bits_of_the_sketch():
    import numpy as np
    first, later = changed_lines()
    raw = [(t + "\n").encode() for t in first + later]
    lines = line_dedup.Lines(np.frombuffer(b"".join(raw), np.uint8), np.array([0, sum(map(len, raw))]))
    sim, keys = lines.sketches(np.arange(len(raw)))
    n = len(first)
    assert np.bitwise_count(sim[:n] ^ sim[n:]).sum(1).max() <= line_dedup.MAX_BITS
    alone = [lines.sketches(np.array([k])) for k in range(5)]
    assert all((a[0][0] == sim[k]).all() and (a[1][0] == keys[k]).all() for k, a in enumerate(alone))
    was, line_dedup.WINDOWS = line_dedup.WINDOWS, 64   # lines worked on in several parts
    try:
        parts = lines.sketches(np.arange(len(raw)))
    finally:
        line_dedup.WINDOWS = was
    assert (parts[0] == sim).all() and (parts[1] == keys).all()


def test_lines_that_share_no_band_are_linked(spark):
    """Pairs at the threshold without a common five-character shingle, and others far apart in their sketches."""
    r = random.Random(23)
    first = ["abcdefghijklmno"] + ["".join(r.choice("abcdefghijklmn") for _ in range(n)) for n in (20, 60, 63, 64, 65, 128, 200, 400, 900)]
    later = []
    for t in first:
        at = range(3, 12, 4) if len(t) == 15 else range(0, 5 * int(0.2 * len(t)), 5)
        later.append("".join("q" if k in at else c for k, c in enumerate(t)))
    assert all(edit_distance(a, b) <= 0.2 * max(len(a), len(b)) for a, b in zip(first, later))
    other = [prose(k, 20, 5000) for k in range(3)]
    rows = by_id(line_dedup.dedup_lines(documents(spark, first + other + later).coalesce(1), keep=["doc_id"]))
    n = len(first) + len(other)
    assert all(rows[k]["kept"] for k in range(n))
    assert [rows[n + k]["kept"] for k in range(len(later))] == [""] * len(later)


@pytest.mark.parametrize("most", [1000, 7])
def test_all_pairs_of_lines_within_the_allowed_edits(spark, most):
    from kinoframe.llm.line_pairs import links_between
    r = random.Random(29)
    lines = []
    for n in (15, 16, 40, 64, 90, 150, 300):
        for _ in range(4):
            t = "".join(r.choice("abcde ") for _ in range(n))
            lines.append(t)
            for share in (0.1, 0.2, 0.22):
                u = list(t)
                for at in sorted(r.sample(range(n), int(share * n)), reverse=True):
                    u[at:at + 1] = r.choice(["", "xy", "é", "\U0001F600"])
                lines.append("".join(u))
    rows = [(k, k if k % 5 else k - k % 2, t) for k, t in enumerate(lines)]   # some are of one class already
    got = links_between(spark.createDataFrame(rows, "id long, class long, line string").repartition(3), 0.8, most).collect()
    want = {(min(c, d), max(c, d)) for _, c, t in rows for _, d, u in rows
            if c != d and edit_distance(t, u) <= 0.2 * max(len(t), len(u)) + 1e-9}
    assert len(got) == len(want) and {(x["a"], x["b"]) for x in got} == want


def test_missing_grams_bound_the_edits():
    """The bound by places drops no pair within the allowed edits, and most of the others before their parts are compared."""
    import numpy as np
    from kinoframe.llm import line_pairs
    from kinoframe.llm.edit_distance import within
    from kinoframe.llm.shards import blob
    r = random.Random(31)
    syllables = ["an", "be", "er", "ion", "the", "ou", "ti", " ", "st", "re", "in ", "le", "qu", "a ", "o", "é", "\U0001F600"]

    def tile(lines, at):
        ids = np.arange(at, at + len(lines))
        return line_pairs.Tile(blob(ids), blob(ids), blob(np.cumsum([0] + [len(t) for t in lines])), "".join(lines))

    for n in (15, 64, 150, 300, 1100):
        first = ["".join(r.choice(syllables) for _ in range(n))[:r.randint(9 * n // 10, n)] for _ in range(12)]
        later = []
        for t in first:
            u, much = list(t), 0.2 if n < 1000 else 0.1
            start = r.randrange(len(t) // 2)   # edits everywhere, or as an inserted or lost stretch
            kind = r.randrange(3)
            if kind == 0:
                for at in sorted(r.sample(range(len(t)), int(much * len(t))), reverse=True):
                    u[at:at + 1] = r.choice(["", "z", u[at] + "z"])
            elif kind == 1:
                u[start:start] = "".join(r.choice("wxyz") for _ in range(int(0.2 * len(t))))
            else:
                del u[start:start + int(0.2 * len(t))]
            later.append("".join(u))
        first, later = sorted(first, key=len), sorted(later, key=len)
        x, y = tile(first, 0), tile(later, len(first))
        i, j = (a.ravel() for a in np.indices((len(first), len(later))))
        allowed = np.floor(0.2 * np.maximum(x.chars[i], y.chars[j]) + 1e-9).astype(np.int64)
        near = within([first[a] for a in i], [later[b] for b in j], allowed)
        assert near.sum() >= 8
        for gram in (2, 3, 4):
            x.gram, x._places = gram, None
            stay = line_pairs._by_places(x, y, i, j, allowed)
            assert stay[near].all()
            if gram == 3 and 64 <= n <= 300:
                assert stay[~near].mean() < 0.1, (n, stay[~near].mean())


def test_tiles_hold_lines_of_like_length(spark):
    """A line's places are kept as wide as its tile's longest: no line is twice as long as another of its tile."""
    import pyarrow as pa
    from kinoframe.llm import line_pairs
    lines = ["x" * n for n in (15, 20, 30, 31, 200, 390, 401, 30_000)]

    def count(batches):
        got = [len(b.column("ids")[0].as_py()) // 8 for b in line_pairs._packed(batches, 1000)]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["n"])

    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(lines)], "id long, class long, line string").coalesce(1)
    assert [r["n"] for r in rows.mapInArrow(count, "n long").collect()] == [3, 1, 2, 1, 1]


def test_texts_of_lines_keep_their_longs(spark):
    """Normal forms come with the columns that were asked for, without a join that would move them again."""
    texts = ["One line, of some words\nAnother line: of others", "A third line"]
    shards = suffix_dedup.shard_table(documents(spark, texts).coalesce(1).select(F.struct("doc_id").alias("row"), "text"), "row", "text", 1 << 20, 4)
    _, lines, _ = line_dedup.line_groups(shards)
    assert "bands" not in lines.columns   # they would pass another exchange
    asked = lines.select("id", (F.col("id") + 1).alias("class"), "shard", "place")
    got = line_dedup._texts(shards, asked).collect()
    assert sorted(r["line"] for r in got) == ["a third line", "another line of others", "one line of some words"]
    assert all(r["class"] == r["id"] + 1 for r in got)


def edited(r, t, much):
    """A text with edits everywhere, or with an inserted or lost stretch."""
    u, kind, start = list(t), r.randrange(4), r.randrange(len(t) // 2)
    if kind == 0:
        for at in sorted(r.sample(range(len(t)), int(much * len(t))), reverse=True):
            u[at:at + 1] = r.choice(["", "z", u[at] + "z"])
    elif kind == 1:
        u[start:start] = "".join(r.choice("wxyz") for _ in range(int(much * len(t))))
    elif kind == 2:
        del u[start:start + int(much * len(t))]
    else:   # at every fifth place, so that no longer gram stays
        for at in range(0, 5 * int(much * len(t)), 5):
            u[at] = "q"
    return "".join(u)


@pytest.mark.parametrize("most", [1000, 5])
def test_chosen_grams_bound_the_edits(most):
    """The count of missing grams drops no pair within the allowed edits, and nearly all others at once."""
    import numpy as np
    from kinoframe.llm import line_pairs
    from kinoframe.llm.edit_distance import within
    r = random.Random(37)
    syllables = ["an", "be", "er", "ion", "the", "ou", "ti", " ", "st", "re", "in ", "le", "qu", "a ", "o", "é", "\U0001F600"]

    def lines(texts):
        ids = np.arange(len(texts))
        off = np.cumsum([0] + [len(t) for t in texts])
        return line_pairs.Lines(ids.tobytes(), ids.tobytes(), off.tobytes(), "".join(texts), most)

    left = others = 0
    for n in (15, 64, 150, 300, 790, 1100, 2100, 4200):
        first = ["".join(r.choice(syllables) for _ in range(n))[:r.randint(9 * n // 10, n)] for _ in range(12)]
        first.append(("st " * n)[:n])   # the same grams again and again
        later = sorted([edited(r, t, r.choice([0.05, 0.15, 0.2])) for t in first] + ["".join(r.choice(syllables) for _ in range(n))[:n]], key=len)
        first.sort(key=len)
        i, j = (a.ravel() for a in np.indices((len(first), len(later))))
        allowed = np.array([int(0.2 * max(len(first[a]), len(later[b])) + 1e-9) for a, b in zip(i, j)])
        near = within([first[a] for a in i], [later[b] for b in j], allowed)
        assert near.sum() >= 8
        want = {(int(a), int(b)) for a, b in zip(i[near], j[near])}
        for u, v, there in ((first, later, want), (later, first, {(b, a) for a, b in want})):
            got = set()
            for x in lines(u).slices:
                for y in lines(v).slices:
                    a, b = line_pairs._few_missing(x, y, 0.8)
                    got |= {(int(c + x.first), int(d + y.first)) for c, d in zip(a, b)}
            assert there <= got
            left, others = left + len(got - there), others + len(u) * len(v) - len(there)
    assert left < (0.2 if most == 1000 else 0.3) * others, (left, others)   # a few lines tell less of what most lack


def test_texts_of_one_band_are_told_apart_by_parts(monkeypatch):
    """Pairs that parts rule out are not compared as wholes."""
    import numpy as np
    import pyarrow as pa
    from kinoframe.llm import line_pairs
    r, compared = random.Random(41), []
    exact = line_pairs.within
    monkeypatch.setattr(line_pairs, "within", lambda a, b, k: compared.append(len(a)) or exact(a, b, k))
    texts = ["".join(r.choice("abcdefghij ") for _ in range(r.randint(700, 800))) for _ in range(200)]
    other = [edited(r, t, 0.15) if k % 10 == 0 else texts[k - 1] for k, t in enumerate(texts)]
    allowed = [int(0.2 * max(len(a), len(b))) for a, b in zip(texts, other)]
    batch = pa.RecordBatch.from_pydict({"a": list(range(200)), "b": list(range(200)), "ta": texts, "tb": other, "allowed": pa.array(allowed, pa.int32())})
    near = [k for part in line_dedup._near(iter([batch])) for k in part.column("a").to_pylist()]
    assert near == list(np.flatnonzero(exact(texts, other, np.array(allowed)))) and len(near) == 20
    assert 20 <= sum(compared) < 60
