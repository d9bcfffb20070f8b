"""The queries opN_<name>: each dealt operator over its whole table.

Each has its method's production parameters. SQL (DuckDB) stands beside the
queries that SQL can express; the others are held against brute force or a
round trip in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm import bpe, conversation_repair, decontaminate, license_scan, line_dedup, near_dup, parity_join, quality, secret_scan, spelling, suffix_dedup, toxicity, warc
from kinoframe.llm.shards import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE["op1_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, 4096 * c AS lo, substr(h, CAST(8192 * c + 1 AS INT), 8590) AS part FROM d, unnest(range(length(h) // 8192 + 1)) u(c)),
w AS (SELECT r, lo + s AS s, hash(substr(part, CAST(2 * s + 1 AS INT), 400)) AS k
        FROM parts, unnest(range(least(4096, length(part) // 2 - 199))) u(s)),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
heads AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 0 ELSE 1 END AS head FROM again),
runs AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM (SELECT r, s, sum(head) OVER (PARTITION BY r ORDER BY s) AS run FROM heads)
          GROUP BY r, run),
ends AS (SELECT r, a, b FROM runs UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d),
kept AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS a, a AS b FROM ends),
texts AS (SELECT r, string_agg(substr(h, CAST(2 * a + 1 AS INT), CAST(2 * (b - a) AS INT)), '' ORDER BY a) AS kept
            FROM kept JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(kept)) AS kept_sha256
  FROM d JOIN texts USING (r) LEFT JOIN sums USING (r)
"""

ORACLE["op5_quality"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!?]', '', 'g')) AS marks,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS ascii_letters,
             length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters FROM t),
grams AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM m, unnest(range(1, len(w) - 1)) u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest(range(3)) v(j) GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
             marks, uppers, ascii_letters, letters, octet_length(encode(solid)) AS octets,
             length(regexp_replace(solid, '[^\x00-\x7F]', '', 'g')) AS ascii_chars FROM m LEFT JOIN again USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3::DOUBLE * n_words OR marks > 0.5::DOUBLE * n_words OR 10 * n_dup_lines > 5 * greatest(n_lines, 1)
            OR uppers / greatest(ascii_letters, 1) > 0.7::DOUBLE OR letters / greatest(word_chars, 1) < 0.4::DOUBLE
            OR ascii_chars > 25 * n_words OR octets < 2 * n_words) AS kept
  FROM b
"""

# The kinds of secrets in their order: pattern, group of the value, its least length.
_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_BLANKS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SECRETS = {
    "assign": ("(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api_?key")))
               + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24),
    "key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), "git": ("gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "url": (f"[a-z][a-z0-9+.-]{{1,20}}://[^{_BLANKS}/:@]+:([^{_BLANKS}/:@]{{3,}})@", 1, 0)}
_FOUND = " UNION ALL ".join(
    f"SELECT r, {no} AS no, '{kind}' AS kind, {least} AS least, string_split_regex(text, '{p}') AS parts,"
    f" regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM t"
    for no, (kind, (p, group, least)) in enumerate(_SECRETS.items()))
ORACLE["op6_secrets"] = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
each AS (SELECT r, no, kind, v[i] AS v, CAST(length(m[i]) AS BIGINT) AS n, least,
              CAST(list_sum(list_transform(parts[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
         FROM found, unnest(range(1, len(m) + 1)) u(i)),
spans AS (SELECT r, no, v, s, kind || ':' || s || ':' || (s + n) AS span FROM each WHERE length(v) >= least),
counts AS (SELECT r, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access,
                  count(*) FILTER (WHERE no = 2) AS n_hex, string_agg(span, ',' ORDER BY s, no) FILTER (WHERE no < 3) AS base,
                  string_agg(span, ',' ORDER BY s, no) AS spans FROM spans GROUP BY r),
owned AS (SELECT v, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS repos, count(DISTINCT coalesce(source, '')) AS owners
            FROM spans JOIN t USING (r) GROUP BY v),
verdict AS (SELECT r, count(*) FILTER (WHERE NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_example,
                   max(owners) AS most_owners, max(repos) AS most_repos
              FROM (SELECT DISTINCT r, v FROM spans) JOIN (SELECT *, owners >= 3 OR owners > 1 AND repos >= 8 AS copied FROM owned) USING (v)
             GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
  FROM t LEFT JOIN counts USING (r) LEFT JOIN verdict USING (r)
"""

ORACLE["op7_warc"] = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top, CAST(from_hex(digest) AS BIT)::VARCHAR AS bits FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
                + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT
                + substr(bits, 5 * i + 5, 1)::INT AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, coalesce(url, '') AS target_uri,
       CAST(CASE WHEN page_id = top THEN greatest(1, ceil(octet_length(body) / 1048576.0)) ELSE 1 END AS BIGINT) AS n_chunks
  FROM m
"""

ORACLE["op8_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
          FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
          FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(s)),
hit AS (SELECT DISTINCT doc_id, pos.n, s, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM hit, unnest(range(s, s + n)) AS u(i) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op11_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
class AS (SELECT component_id, count(*) AS class_size FROM least GROUP BY component_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(class_size, 1) AS class_size
  FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least l USING (doc_id) LEFT JOIN class c ON c.component_id = l.component_id
"""

# CRC-32 of a string in SQL: its bytes from the hexadecimal form, one table step each.
CRC_SQL = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
             lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text column; ``crc.t`` is the table of CRC_SQL."""
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS INT), 2))::BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295, {bytes_}),
                 lambda c, b: xor(c // 256, crc.t[CAST(xor(c % 256, b) AS INT) + 1])), 4294967295)"""


ORACLE["op12_spelling"] = f"""
WITH RECURSIVE crc AS (SELECT {CRC_SQL} AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS (SELECT doc, run, doc || ':' || run AS given, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, {crc_sql("given")} AS h FROM each, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
                     ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM words, unnest(range(length(word))) u(i)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
         UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
                 CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
          UNION SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n
  FROM forms f LEFT JOIN (SELECT s.word, arg_max(s.at, w.n) AS root FROM steps s JOIN words w ON w.word = s.at GROUP BY s.word) r USING (word)
"""


def _script_sql() -> dict[str, str]:
    """The cheapest script of each state before a row, in SQL: structs of cost
    and audit, of which the least is taken. S: nothing yet, P: after the
    system, A: an answer is due, U: a question is due or the end."""
    then = lambda letter, cost, state: f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a}}"
    least = lambda *ways: f"list_sort([{', '.join(ways)}])[1]"
    never = "{'c': 1000000000, 'a': ''}"
    keep = lambda letter, to: f"CASE WHEN NOT gone AND initial = '{letter}' THEN {then('K', 'late', to)} ELSE {never} END"
    role = lambda to: f"CASE WHEN NOT gone THEN {then('R', '3 + late', to)} ELSE {never} END"
    row = {"S": least(then("D", "4", "S"), keep("s", "P"), keep("u", "A"), role("A")),
           "P": least(then("D", "4", "P"), keep("u", "A"), role("A")),
           "A": least(then("D", "4", "A"), keep("a", "U"), role("U")),
           "U": least(then("D", "4", "U"), keep("u", "A"), role("A"))}
    due = least("a0", then("I", "3", "u0"))
    return row | {"S1": least("s0", then("I", "3", "a1")), "P1": least("p0", then("I", "3", "a1")), "A1": due,
                  "U1": least("u0", then("I", "3", "a0"))}


_STEP = _script_sql()
ORACLE["op13_conversation_repair"] = f"""
WITH RECURSIVE crc AS (SELECT {CRC_SQL} AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS given FROM conversations),
hashed AS (SELECT *, {crc_sql("g.given")} % 20 AS h FROM given g, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt),
judged AS (SELECT *, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faulty AS (SELECT *, CASE WHEN final = '' THEN 1 WHEN again THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM judged),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
                   count(*) FILTER (WHERE fault = 3) AS truncated,
                   count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
dp AS (SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS S, {{'c': 6, 'a': 'II'}} AS P, {{'c': 3, 'a': 'I'}} AS A, {{'c': 0, 'a': ''}} AS U FROM counted
       UNION ALL
       SELECT conv_id, i, {_STEP["S1"]}, {_STEP["P1"]}, a1, {_STEP["U1"]}
         FROM (SELECT *, {_STEP["A1"]} AS a1
                 FROM (SELECT dp.conv_id, dp.i - 1 AS i, {_STEP["S"]} AS s0, {_STEP["P"]} AS p0, {_STEP["A"]} AS a0, {_STEP["U"]} AS u0
                         FROM dp JOIN (SELECT conv_id, i, initial, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS late
                                         FROM faulty) r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i))),
best AS (SELECT conv_id, S.c AS cost, S.a AS audit FROM dp WHERE i = 0),
edits AS (SELECT conv_id, spot, substr(audit, CAST(spot AS INT), 1) AS edit FROM best, unnest(range(1, length(audit) + 1)) u(spot)),
numbered AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS out
               FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
kept AS (SELECT e.conv_id, e.spot, e.edit, e.out, f.role, f.text,
                max(CASE WHEN e.out = 1 AND e.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
           FROM numbered e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                     || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS whole FROM kept GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
       coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(l.whole, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs, keep=["doc_id"])


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # which of several rules rejects first depends on measured times
    return quality.quality(docs, keep=["doc_id"]).drop("failed_rule")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate.match_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.drop("longest_match", "longest_item", "longest_at")


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = line_dedup.dedup_lines(docs)
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdict = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return verdict.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@query
def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))
