"""Page elements by their range."""

import random

from pyspark.sql import functions as F

from kinoframe.session import spread_rows
from kinoframe.sources import elements
from kinoframe.sources.elements import extract_film_elements, film_page_fields, pages_of
from kinoframe.sources.pages import extract_film_page


def test_start_tags_meet_their_end_tags():
    text = "<div a='1 > 0'><div><p>x<br>y</div><!-- </div> --></div><script>'</div>'</script><div>z"
    page = pages_of(["", text, "no tags", "</div><div></div>"])[1]
    divs = list(page.find("div"))
    assert [text[slice(*page.range(i))] for i in divs] == ["<div><p>x<br>y</div><!-- </div> -->", "<p>x<br>y", "z"]
    assert page.own_text(divs[0]) == "" and page.attributes(divs[0]) == {"a": "1 > 0"}
    last = pages_of(["</div><div>q</div>"])[0]
    assert [last.own_text(i) for i in last.find("div")] == ["q"]


def test_ranges_against_a_stack():
    r = random.Random(4)
    texts = []
    for _ in range(60):
        out, stack = [], []
        for _ in range(40):
            if stack and r.random() < 0.5:
                out.append(f"</{stack.pop()}>")
            else:
                stack.append(r.choice("abi"))
                out.append(f"<{stack[-1]} n={len(out)}>")
        texts.append("".join(out + [f"</{t}>" for t in reversed(stack)]))
    for text, page in zip(texts, pages_of(texts)):
        open_, want = [], {}
        for i, begin in enumerate(page.begin):
            if text[begin + 1] == "/":
                want[open_.pop()] = i
            else:
                open_.append(i)
        assert {i: c for i, c in enumerate(page.close) if c >= 0} == want


def test_flat_pages_give_what_the_patterns_give(spark):
    pages = ["<meta itemprop='image' content='http://i/1?a=1&amp;b=2'><div class='x fi_score_div'> 7 </div>"
             "<div class=\"fi_psi_div\">n/a</div>PSI <span>55</span><div id='fi_trailer'><iframe src='https://www.youtube.com/embed/q_1'></iframe></div>"
             "<p id='fi_info_ext'><a href='http://d/tt0000012/'>d</a></p><span itemprop='ratingValue'>7.5</span><b itemprop='reviewCount'>12</b>",
             "", "<p>nothing here</p>", "<div class='fi_score_div'>none</div>"]
    df = spark.createDataFrame(list(enumerate(pages)), "crit_id int, html string")
    rows = lambda x: sorted(tuple(r[c] for c in sorted(x.columns)) for r in x.collect())
    assert rows(extract_film_elements(df)) == rows(extract_film_page(df))
    nothing = spark.createDataFrame([(1, None)], "crit_id int, html string")
    assert extract_film_elements(nothing).where(F.col("crit_votes") == 0).count() == 1


def test_a_tag_is_read_once_however_many_fields_look_at_it(monkeypatch):
    read = []
    unescape = elements.entities.unescape
    monkeypatch.setattr(elements.entities, "unescape", lambda x: read.append(x) or unescape(x))
    page = pages_of(["<i>.</i>" * 30 + "<b itemprop='ratingValue' class=q>7.5</b><p id=r>x</p>"])[0]
    assert film_page_fields(page)["crit_rating"] == "7.5"
    assert [read.count(x) for x in ("ratingValue", "q", "r")] == [1, 1, 1]
    # an absent attribute still fits a pattern of nothing
    assert [page.names[i] for i in page.find(None, title="")][-2:] == ["b", "p"] and len(list(page.find("i", title=""))) == 30


def test_a_small_file_is_dealt_over_the_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    got = spread_rows(one)
    sizes = got.rdd.glom().map(len).collect()
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(sizes) < 1000 // 4
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    assert spread_rows(got) is got
