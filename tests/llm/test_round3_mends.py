"""Short and unspaced benchmark items, list patterns with slashes, learning under one doc_id, line ends of many scripts."""

import random

from morphospark.llm import decontam, langid, quality, urls


def leaks(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.n_places) for r in decontam.find_leaks(d, b).collect()}
    kept = {r.doc_id for r in decontam.drop_leaks(d, b).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in found}
    return found


def test_short_items_are_found_whole(spark):
    docs = ["so What is two, plus? what is two plus one", "what is plus two", "two plus", "", None, "what is two"]
    got = leaks(spark, docs, ["what is two plus", "two plus", "?!", None, "zebra"])
    assert got == {(0, 0): (1, 5, 2), (0, 1): (3, 5, 2), (2, 1): (0, 2, 1)}


def test_unspaced_scripts_are_read_by_character(spark):
    item = "法国的首都是哪一个城市请回答"
    docs = [f"今天我们来看一个问题{item}谢谢", "今天天气很好我们出去走走吧", f"x{item[:6]}和{item[7:]}y", "ประเทศไทยมีเมืองหลวงคืออะไร จริงหรือ"]
    got = leaks(spark, docs, [item, "ประเทศไทยมีเมืองหลวงคืออะไร"])
    assert set(got) == {(0, 0), (2, 0), (3, 1)}


def test_patterns_with_slashes(spark):
    pages = spark.createDataFrame([(0, "http://example.com/a/b"), (1, "http://www.example.com/x"), (2, "http://other.org/"),
                                   (3, "http://dot.org/q//r"), (4, "http://example.com/ab")], "page_id long, url string")
    captures = pages.selectExpr("page_id", "url", "date'2024-06-01' fetch_day")
    entries = spark.createDataFrame([("example.com/a/",), ("WWW.example.com/",), ("dot.org.//q/r//",), ("/",), ("//x",)], "pattern string") \
        .selectExpr("pattern", "'add' action", "date'2024-01-01' day")
    got = {r.page_id: r.pattern for r in urls.judge(captures, entries).filter("blocked").collect()}
    assert got == {0: "example.com/a", 1: "www.example.com", 3: "dot.org/q/r"}


def test_languages_learnt_under_one_doc_id(spark):
    rng = random.Random(3)
    words = {"en": "the house and of with under water people never again", "de": "das haus und von mit unter wasser leute niemals wieder"}
    rows = [(1, " ".join(rng.choices(v.split(), k=12)), k) for _ in range(300) for k, v in words.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).groupBy("held_out", "lang_pred").count().collect()
    assert {r.lang_pred for r in got} == {"en", "de"} and sum(r["count"] for r in got) == 600


def test_rare_languages_are_learnt(spark):
    rows = [(k, f"common words of everyday talk number {k}", "en") for k in range(3000)]
    rows += [(10**6 + k, "täällä puhutaan aivan toista kieltä", "fi") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=1)
    assert set(model[0]) == {"en", "fi"}


def test_sentence_ends_of_many_scripts(spark):
    line = {"hi": "यह एक वाक्य है जो एक दंड से समाप्त होता है और पूरा है।", "ur": "یہ ایک جملہ ہے جو یہاں ختم ہوتا ہے اور مکمل ہے۔",
            "ar": "هل هذه جملة كاملة تنتهي بعلامة استفهام عربية واضحة هنا؟", "am": "ይህ ሙሉ ዓረፍተ ነገር ነው እዚህ ላይ የሚያበቃ ጥሩ ሐሳብ ነው።",
            "zh": "他 说 这 是 一 个 完整 的 句子 。」"}
    docs = spark.createDataFrame([(k, "\n".join([t, t[:-1] + " x" + t[-1]])) for k, t in line.items()] + [("bad", "no end here at all\n" * 8)],
                                 "doc_id string, text string")
    got = {r.doc_id: (r.n_punctuation_lines, r.base_failed) for r in quality.quality_report(docs).collect()}
    assert all(got[k][0] == 0 for k in line) and got["bad"][0] == 8


# ---------------------------------------------------------------- HTML
def text(page):
    from morphospark.llm import html_text

    return html_text.page_text(page)


def test_long_and_broken_cells_stay_in_their_columns():
    long = " ".join(["word"] * 60)
    got = text(f"<table><tr><td>a</td><td>b</td></tr><tr><td>{long}</td><td>x</td></tr><tr><td>c<br>d</td><td>e</td></tr></table>").split("\n")
    assert got[0].split() == ["a", "b"] and got[0].index("b") == got[1].index("x")
    assert " ".join(got[1:-2]).split().count("word") == 60 and max(map(len, got)) <= 90
    assert got[-2].split() == ["c", "e"] and got[-2].index("e") == got[0].index("b") and got[-1] == "d"


def test_last_column_is_not_wrapped():
    long = " ".join(["word"] * 60)
    assert text(f"<table><tr><td>a</td><td>{long}</td></tr></table>") == f"a  {long}"


def test_rowspans_keep_columns():
    got = text("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>").split("\n")
    assert got == ["a  b", "   c", "d  e"]
    got = text("<table><tr><td>a</td><td rowspan=0>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>").split("\n")
    assert got == ["a  b  c", "d     e"]
    got = text("<table><tr><td colspan=2 rowspan=2>wide cell</td><td>x</td></tr><tr><td>y</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>").split("\n")
    assert got[0].index("x") == got[1].index("y") == got[2].index("3") and got[2].split() == ["1", "2", "3"]


def test_hidden_stays_hidden_below_the_depth_limit():
    deep = "<div>" * 400
    got = text(f"{deep}seen <div style='display:none'>gone <div>too <b>x</b></div> gone</div> back<script>no()</script>")
    assert got.split() == ["seen", "back"]
    assert text("<i>" * 100_000 + "end") == "end"


def test_inputs_and_details():
    assert text("<form><input value='Anna'><input type=text value=B><input type=hidden value=h><input type=password value=p>"
                "<input type=checkbox value=c><input type=submit value=Go></form>").split() == ["Anna", "B", "Go"]
    assert text("<details><summary>More</summary><p>inside</p></details>after") == "More\nafter"
    assert text("<details open><summary>More</summary><p>inside</p></details>").split() == ["More", "inside"]


def test_very_long_pages_are_read_whole():
    page = "<table>" + "".join(f"<tr><td>{i}</td><td>{'x' * 300}</td></tr>" for i in range(5000)) + "</table>"
    got = text(page).split("\n")
    assert len(got) == 5000 and got[4999].split() == ["4999", "x" * 300]
