"""Rules around an answer by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import toolcalls
from tessera.operators import answers, conversation, prompts
from tests.test_rules import each

GOOD = "The model reaches a high accuracy on the held out part of the data set."


@pytest.mark.parametrize(
    ("text", "useful"),
    [
        (GOOD, True), (f"  {GOOD} ", True), ('"' + GOOD, True), ("(" + GOOD, True), ("the" + GOOD[3:], False), ("- " + GOOD, False), ("É" + GOOD, False), (GOOD.replace(" ", "-"), True),
        ("It holds few words.", False), (GOOD + " MMLU is one.", True), (GOOD + " MMLU and GSM8K.", False), (GOOD + " 1234567890", False), (GOOD.upper(), False), ("A b c d e f g h i j k l.", False), (None, False), ("", False),
    ],
)
def test_useful_sentences(spark, text, useful):
    assert each(spark, T.useful_sentence, [text]) == [useful]


def test_snippets(spark):
    long = "The " + "words of this sentence go on and on " * 12 + "until it ends."
    texts = [f"Short. {GOOD} not one. {GOOD}", f"{long} {GOOD}", "Nothing here.", "A hyphen-\nated word. " + GOOD.replace("accuracy", "accu-\n racy"), None]
    assert each(spark, T.snippet, texts) == [f"{GOOD} {GOOD}", long[:420].rstrip() + "...", "", GOOD, ""]
    assert each(spark, lambda c: T.first_sentence(c, 10), ["One two three four. Five.", "One. Two"]) == ["One two th...", "One."]


def test_titles(spark):
    texts = ["what is the mass of this far galaxy cluster?", '"what is it"', "***", None, "  ", "one two three four five six seven eight.", "'*hello*'", "- 5 stars!"]
    assert each(spark, T.conversation_title, texts) == ["What is the mass of this far galaxy...", "What is it", "Conversation", "Conversation", "Conversation", "One two three four five six seven eight", "Hello", "5 stars"]


def test_salience_looks_past_results(spark):
    rows = [(1, 0, "user", "spectral lines of stars"), (1, 1, "assistant", "stars show spectral lines"), (1, 2, "user", "Tool vector_search result: bananas"), (2, 0, "user", "Tool: only this"), (3, 0, "user", "  ")]
    got = {(r.conv_id, r.turn): r.salience for r in conversation.salience(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2)} and got[1, 1] > 0.7 and got[1, 2] < 0.1


def test_headers_that_end_a_result(spark):
    head = "Tool a result: x\nsecond\n"
    rows = [(1, 0, "user", head + "one"), (1, 1, "user", head + "Tool without colon"), (1, 2, "user", head + "three"), (2, 0, "user", head + "one"), (2, 1, "user", head + "Tool: two\nrest"), (2, 2, "user", "Tool: two\nrest\nlast")]
    got = {(r.conv_id, r.turn): r.text for r in prompts.dedupe_headers(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got[1, 1] == "Tool without colon" and got[1, 2] == head + "three", "what lost its header is no result to the next"
    assert got[2, 1] == "Tool: two\nrest" and got[2, 2] == "last"


def test_notices(spark):
    rows = [("vector_search", " broke ", None, None), ("vector_search", "", "no_results", " None found. "), ("vector_search", None, "ok", "x"), ("other", "broke", "no_results", "x"), (None, "broke", None, None), ("document_ids", None, "no_results", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string")
    got = [r.n for r in frame.select("i", answers.notice(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("n")).orderBy("i").collect()]
    assert got == ["The document search tool failed: broke", "None found.", "", "", "", ""]
    assert each(spark, lambda c: answers.with_notice(c, F.lit(" None found. ")), ["Well. \n", "", None, "i said NONE FOUND."]) == ["Well.\n\nNone found.", "None found.", "None found.", "i said NONE FOUND."]


def test_sources(spark):
    refs = lambda a, r: spark.range(1).select(answers.source_refs(F.lit(a), F.lit(r)).alias("x")).first().x
    assert refs('{"doc_id": "b"}', '[{"doc_id": "a"}, {"d": "c", "u": "/x/document_image/e/1"}, "text", null]') == ["[doc:a]", "[doc:b]", "[doc:c]", "[doc:e]"]
    assert refs(None, '"/x/document_image/e/1"') == ["[doc:e]"] and refs('{"doc_id": "b"}', '"/x/document_image/e/1"') == ["[doc:b]"] and refs(None, None) == [] and refs('{"doc_id": " "}', "{}") == []
    assert refs(None, "[" + ", ".join(f'{{"d": "{i:03d}"}}' for i in range(60)) + "]") == [f"[doc:{i:03d}]" for i in range(40)]
    allowed = F.array(F.lit("[doc:b]"), F.lit("[doc:a]"))
    block = "Sources:\n- [doc:a]\n- [doc:b]"
    assert each(spark, lambda c: answers.with_sources(c, allowed), ["Text \n", f"Text\n\n{block}", "Sources: x", "Sources:\n- [doc:b]\nSources: none", None]) == [f"Text\n\n{block}", f"Text\n\n{block}", "Sources: x\n- [doc:a]\n- [doc:b]", "Sources:\n- [doc:b]\nSources: none\n- [doc:a]\n- [doc:b]", f"\n\n{block}"]
    assert each(spark, answers.shown_refs, ["![a](/x/document_image/e/1) ![b](/y) ![c](/x/document_image/d/2) ![d](/x/document_image/e/3)"]) == [["[doc:d]", "[doc:e]"]]


def test_figures(spark):
    chunk = "struct<image_url:string,u:string,title:string,text:string>"
    rows = spark.createDataFrame([(1, [("/m/1", None, "A\nb", None), ("/m/1", None, "again", None), (None, "/m/2", None, "t" * 90), ("/out", None, "x", None), (None, None, "x", None)], ["/m/2", "/out/3", "/out/4"])], f"id int, chunks array<{chunk}>, links array<string>")
    lines = rows.select(answers.figure_lines(F.col("chunks"), F.col("links"), "/m/").alias("x")).first().x
    assert lines == ["![A b](/m/1)", "![" + "t" * 80 + "](/m/2)", "![Figure](/out/3)"]
    shown = F.array(F.lit("![a](/m/1)"), F.lit("![b](/m/2)"))
    assert each(spark, lambda c: answers.with_figures(c, shown), ["see /m/1 ", "![x](/m/1)", "![x](/m/1) ![y](/m/2)", ""]) == ["see /m/1\n\n![a](/m/1)\n![b](/m/2)", "![x](/m/1)\n\n![b](/m/2)", "![x](/m/1) ![y](/m/2)", "![a](/m/1)\n![b](/m/2)"]


def test_recent_images(spark):
    rows = [(1, 9, 0, "/a", "Figure 1"), (1, 9, 1, "data:image/png;base64,x", "Figure 2"), (1, 9, 2, "/b", "untitled"), (1, 8, 0, "/a", "Figure 9"), (1, 8, 1, "/c", None), (1, 7, 0, None, "Figure 3"), (1, 6, 0, "/d", "A plot\nof it"), (1, 5, 0, "/e", "Figure 5")]
    got = answers.recent_images(spark.createDataFrame(rows, "conv_id long, turn int, place int, link string, caption string")).orderBy("n").collect()
    assert [r.line for r in got] == ["![Figure 1](/a)", "![A plot of it](/d)"]


def test_pages_by_name_type_and_date(spark):
    rows = [(1, "b", "2024-01-02"), (2, "A", "bad"), (3, "c", None), (4, None, "2023-05-06 07:08:09"), (5, "a", "1969-12-31")]
    frame = spark.createDataFrame(rows, "id long, name string, at string")
    ids = lambda *a, **k: [r.id for r in answers.sorted_page(frame, *a, **k).collect()]
    assert ids("name", 1) == [4, 2, 5, 1, 3] and ids("name", 1, descending=True) == [3, 1, 2, 5, 4]
    assert ids("at", 1, kind="date") == [5, 2, 3, 4, 1] and ids("name", 99, 2) == [3] and ids("name", 0, 2) == [4, 2]
    assert answers.sorted_page(frame.where("false"), "name", 3).count() == 0


def test_retries_after_an_overflow(spark):
    cases = [(3, 500, False, False, 489), (100, 500, False, False, 384), (10, 300, False, False, 250), (10, 300, False, True, 300), (5, 100, True, False, 75), (900, 5000, True, True, 3908), (5, 50, True, False, 50), (None, 500, True, False, None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, o long, m long, t boolean, g boolean, want long")
    got = rows.select("i", "want", toolcalls.retry_tokens(F.col("o"), F.col("m"), F.col("t"), F.col("g")).alias("got")).collect()
    assert [r.got for r in sorted(got)] == [c[-1] for c in cases]
    parts = spark.createDataFrame([(1, [("text", "a"), ("image", None)]), (2, [("text", "a")]), (3, [("image", None), ("audio", None)]), (4, []), (5, None)], "i int, p array<struct<type:string,text:string>>")
    assert {r.i: r.x for r in parts.select("i", toolcalls.without_images(F.col("p")).alias("x")).collect()} == {1: "a\n[Image removed due to context limit]", 2: None, 3: None, 4: None, 5: None}
