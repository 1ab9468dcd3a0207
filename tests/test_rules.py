"""Rules by hand-made cases and against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import speech as S
from tessera.functions import text as T
from tessera.functions import toolcalls, vectors
from tessera.operators import access, anchors, citations, continuation, conversation, documents, evaluation, graph, images, memory, prompts, reranking, search
from tessera import shared, skills
from tessera.sources import arxiv, media, sinks
from tessera.streaming import events


def each(spark, make, texts):
    """``make`` of a text column over some texts, in their order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", make(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_entities_relations_and_seeds(spark):
    assert each(spark, T.entity, [" The  User ", "me", '"Alice Smith"', "the assistant", "C++ (lang)!", "the lab", None]) == ["user", "user", "alice smith", "assistant", "c++ lang", "the lab", ""]
    assert each(spark, T.relation, ["works on", "Likes", "related-to", "in  nation", " uses ", None]) == ["WORKS_ON", "PREFERS", "RELATED_TO", "IN_NATION", "USES", ""]
    assert each(spark, T.seed_terms, ["Tell me about the Dark Matter survey", "user", "v1.2 of it"]) == [["dark", "matter", "survey"], [], ["v1.2"]]
    rows = [("The User", "works on", " X "), ("me", "likes", "the assistant"), ("a", "is", "b"), ("a", "uses", "A"), ("", "uses", "b"), ("a", "uses", "b"), ("A", " Uses ", "b")]
    got = graph.normalise(spark.createDataFrame(rows, "source string, relationship string, destination string")).collect()
    assert sorted(map(tuple, got)) == [("a", "USES", "b"), ("user", "WORKS_ON", "x")]


def test_facts(spark):
    texts = ["Please remember: that I like tea", "my name is Bo. I prefer R\nand more", "remember this", "Hello", "From now on be brief. we use Spark", None, "call me Al"]
    got = each(spark, T.heuristic_facts, texts)
    assert got[0] == ["I like tea"] and set(got[1]) == {"I prefer R", "My name is Bo. I prefer R"} and got[2] == [] and got[3] == [] and got[6] == ["Call me Al"]
    assert got[4] == ["From now on be brief. we use Spark", "We use Spark"]
    kinds = ["I prefer tea", "I need a tool", "use the database", "a concise answer", "trying to learn", "hello", "they said i like tea"]
    assert each(spark, T.fact_category, kinds) == ["preference", "preference", "project", "tone", "goals", "general", "general"]
    assert each(spark, T.low_value_fact, ["That!", "keep that in mind", "I'll remember that", "tea", ""]) == [True, True, True, False, True]
    turns = spark.createDataFrame([(1, "I like tea"), (1, "i like tea"), (2, "I like tea")], "user_id long, text string")
    facts = spark.createDataFrame([(1, "I like tea", "old")], "user_id long, fact string, category string")
    assert sorted(map(tuple, memory.promote(facts, turns).collect())) == [(1, "I like tea", "old"), (2, "I like tea", "preference")]


def test_exact_terms(spark):
    queries = ['find "Dark Matter" in NGC-1275 and HST photometric data', "", "'single quoted' or 'x' information documents", "a-b " * 3 + " ".join(f"w{i}x" for i in range(20))]
    got = each(spark, T.exact_terms, queries)
    assert got[0] == ["Dark Matter", "NGC-1275", "HST", "photometric"] and got[1] == [] and got[2] == ["single quoted"]
    assert got[3] == ["a-b", *(f"w{i}x" for i in range(7))]
    assert search.exact_terms(spark, queries[0]) == got[0]


LONG = "".join(random.Random(1).choices("abcdefgh", k=900))
#: Earlier text, what follows, what it adds, and what comes between.
CONTINUED = [
    ("the quick brown fox", "quick brown fox jumps", " jumps", "\n"), ("abc", "xyz", "xyz", "\n"), ("", "xyz", "xyz", ""), ("abcdef", "\nabc", "", "\n"), ("it ends so", "so it goes", "so it goes", "\n"),
    ("x " + LONG[:650], LONG[200:], LONG[650:], "\n"), ("Shared beginning of both answers, first.", "Shared beginning of both answers, second.", "second.", "\n"),
    ("a", "b", "b", "\n"), ("a ", "b", "b", ""), ("a", ", b", ", b", ""), ("a (", "b", "b", ""), ("**a", "b", "b", ""), ("![x](y", "b", "b", ""), ("a —", "b", "b", ""), ("abc", "abc and more", " and more", "\n"), (None, None, "", ""), ("é😀x", "é😀xy", "y", "\n"),
]


def test_continuations(spark):
    """An overlap of two characters is none, one of 450 is."""
    rows = spark.createDataFrame([(i, p, f) for i, (p, f, _, _) in enumerate(CONTINUED)], "id long, previous string, following string")
    got = {r.id: (r.rest, r.separator) for r in continuation.continue_text(rows).collect()}
    assert [got[i] for i in range(len(CONTINUED))] == [c[2:] for c in CONTINUED]
    seams = spark.createDataFrame([(1, "grew by 12%", "12% in May"), (2, "one.", "Two."), (3, "it was 5% ", "5%5% more"), (4, "", "x"), (5, "x" * 100 + " 7%", " 7%7%7% and 7%")], "id long, previous string, following string")
    assert {r.id: r.merged for r in continuation.continue_text(seams).collect()} == {1: "grew by 12%\n in May", 2: "one.\nTwo.", 3: "it was 5% 5% more", 4: "x", 5: "x" * 100 + " 7%\n7%7% and 7%".replace("7%7%", "7%")}


def stops(calls, limit, limits, repeats, idle, units, weights):
    """The loop itself: rows up to the first stop."""
    used, last, spent, again, streak, before, out = {}, {}, 0, 0, 0, None, []
    for turn, tool, sig, result, failed in calls:
        same = before == sig
        again = again + 1 if same else 0
        before = sig
        if failed:
            stuck = True
        else:
            stuck = (result is not None and last.get(tool) == result) or (same and result is None)
            if result is not None:
                last[tool] = result
        streak = streak + 1 if stuck else 0
        n = used.get(tool, 0) + 1
        reason = None
        if n >= limits.get(tool, limit):
            reason = "per_tool_limit_reached"
        elif again >= repeats:
            reason = "repeat_signature_break"
        elif streak >= idle:
            reason = "no_progress_break"
        elif units is not None and spent + weights.get(tool, 1) > units:
            reason = "budget_units_exhausted"
        out.append((turn, reason))
        if reason:
            break
        spent += weights.get(tool, 1)
        used[tool] = n
    return out


def test_tool_budget_against_the_loop(spark):
    r = random.Random(7)
    rows = [(c, i, r.choice("ab"), r.choice("xyz") if r.random() < 0.6 else "x", r.choice([None, "1", "2"]), r.random() < 0.15) for c in range(60) for i in range(r.randrange(1, 12))]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, tool_name string, signature string, result string, failed boolean")
    for kw in (dict(per_tool=5), dict(per_tool=9, limits={"a": 3}, units=6, weights={"b": 2}), dict(per_tool=20, repeats=2, idle=3)):
        got = {}
        for x in conversation.tool_budget(calls, **kw).orderBy("conv_id", "turn").collect():
            got.setdefault(x.conv_id, []).append((x.turn, x.stop_reason))
        want = {c: stops([x[1:] for x in rows if x[0] == c], kw["per_tool"], kw.get("limits", {}), kw.get("repeats", 3), kw.get("idle", 2), kw.get("units"), kw.get("weights", {})) for c in range(60)}
        assert got == want
    assert {x.stop_reason for x in conversation.tool_budget(calls).collect()} >= {None, "per_tool_limit_reached"}


def test_captions_against_the_loop(spark):
    r = random.Random(3)
    rows = [(c, i, r.choice(["a", "b", None]), "t" * r.randrange(1, 9)) for c in range(20) for i in range(10)]
    want = []
    for c in range(20):
        for _, i, who, text in [x for x in rows if x[0] == c]:
            if want and want[-1][0] == c and who is not None and want[-1][3] == who and len(want[-1][4]) + 1 + len(text) <= 16:
                want[-1][2] += 1
                want[-1][4] += " " + text
            else:
                want.append([c, i, 1, who, text])
    got = conversation.coalesce_captions(spark.createDataFrame(rows, "conv_id long, turn long, speaker string, text string"), 16).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, want))


def test_headers_against_the_loop(spark):
    r = random.Random(5)
    head = ["Tool vector_search result: x", "second", "third", "fourth"]
    rows = [(c, i, r.choice(["user", "user", "assistant"]), "\n".join(head[: r.randrange(0, 5)] + [r.choice("pq") for _ in range(r.randrange(0, 25))])) for c in range(40) for i in range(5)]
    evidence = lambda role, t: role == "user" and t.lstrip()[:160].split("\n")[0].startswith("Tool ") and "result:" in t.lstrip()[:160].split("\n")[0]
    want = {}
    for c in range(40):
        texts = [list(x[2:]) for x in rows if x[0] == c]
        for i in range(len(texts) - 1):
            if evidence(*texts[i]) and evidence(*texts[i + 1]):
                a, b = texts[i][1].splitlines(), texts[i + 1][1].splitlines()
                k = 0
                while k < min(len(a), len(b), 16) and a[k] == b[k]:
                    k += 1
                if k >= 2:
                    texts[i + 1][1] = "\n".join(b[k:])
        want.update({(c, i): x[1] for i, x in enumerate(texts)})
    got = prompts.dedupe_headers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(x.conv_id, x.turn): x.text for x in got.collect()} == want


def test_what_is_shown(spark):
    texts = ["<think>hm</think>The answer is forty two.", "Searching the docs...", "I’ll search for that", "Let me explain.", "<think>still", "Tool: vector_search\n", "ok", "Short answer", None]
    assert each(spark, S.shown, texts) == ["The answer is forty two.", "", "", "Let me explain.", "", "", "", "Short answer", ""]
    assert each(spark, S.non_answer, texts[:4]) == [False, False, True, True]
    assert each(spark, S.streamed, ["Let me explain", '{"name": "x"', "The answer", "<tool_call>a"]) == ["", "", "The answer", "a"]


def test_calls_in_text(spark):
    tools = ("vector_search", "whole_document")
    texts = [
        '{"name": "vector_search", "arguments": {"q": "a}"}}', 'so ```json\n{"tool_name": "whole_document", "args": {"d": 1}}\n``` ok', '<function_call>{"vector_search": {"q": 1}}</function_call>', '<vector_search>{"q": 2}</vector_search>',
        '{"name": "other", "arguments": {}}', "none", None, 'I call {"name": "", "tool_name": "vector_search", "arguments": null, "parameters": {"q": "{"}} now {', '{"name": "vector_search", "arguments": "text"}', "<whole_document>no object</whole_document>",
        '{"vector_search": 5}', '{"name": "vector_search"', "<tool_call>{}</tool_call> ```{\"whole_document\": {\"b\": 1, \"a\": [2]}}```",
    ]
    got = [None if r is None else (r["name"], json.loads(r["arguments"])) for r in each(spark, lambda c: toolcalls.call(c, tools), texts)]
    search = lambda **a: ("vector_search", a)
    assert got == [search(q="a}"), ("whole_document", {"d": 1}), search(q=1), search(q=2), None, None, None, search(q="{"), search(), ("whole_document", {}), None, None, ("whole_document", {"a": [2], "b": 1})]
    assert toolcalls.first_object('a } {"b": "\\"}"} {') == '{"b": "\\"}"}' and toolcalls.first_object('{"a": "x}') is None and toolcalls.first_object("{ {}") is None


def test_ids(spark):
    ids = ["aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaa1", "aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaa2", "bbbbbbbb-bbbb-bbbb-bbbb-bbbbbbbb0000"]
    asked = [(1, ids[0]), (2, "<id>" + ids[1].upper() + "</id>"), (3, "aaaaaaaa-aaaa-aaaa-a"), (4, "bbbbbbbb-bbbb-bbbb-b"), (5, "bbbbbbbb"), (6, "b" * 28), (7, "c" * 32), (8, "")]
    requests, known = spark.createDataFrame(asked, "request_id int, raw string"), spark.createDataFrame([(i,) for i in ids], "doc_id string")
    got = {r.request_id: (r.doc_id, r.error) for r in documents.resolve(requests, known).collect()}
    assert got == {1: (ids[0], None), 2: (ids[1], None), 3: (None, "ambiguous"), 4: (ids[2], None), 5: (None, "invalid"), 6: (ids[2], None), 7: (None, "not_in_chat"), 8: (None, "invalid")}
    assert {r.error for r in documents.resolve(requests, known.where("false")).collect()} == {"no_documents", "invalid"}


def test_evaluation_cases(spark):
    answer = "Based on the retrieved documents, the calibration and spectral analysis methods involve flat fields."
    cases = [
        ("explicit_search", "Please search the selected documents for calibration notes.", [1], "results_found", "handled", True, ["calibration"]),
        ("collection_backed_question", "What does this paper say about spectral analysis?", [42], "results_found", "handled", True, ["spectral"]),
        ("figure_request", "Show me the figures from the calibration paper.", [1], "results_found", "handled", True, ["calibration"]),
        ("no_results", "Search the documents for dark matter candidates.", [5], "no_results", "handled", True, ["no relevant passages"]),
        ("no_collections", "Search the documents for gravitational lensing.", [], "results_found", "handled", False, ["collection"]),
        ("non_rag_message", "What is the capital of France?", [], "results_found", "skipped", False, []),
        ("wrong", "What is the capital of France?", [], "results_found", "handled", False, ["Paris"]),
    ]
    rows = spark.createDataFrame([(*c, answer) for c in cases], "id string, message string, collection_ids array<int>, status string, expect_outcome string, expect_searched boolean, expect_contains array<string>, answer string")
    got = evaluation.check(evaluation.run(rows), rows.select("id", "expect_outcome", "expect_searched", "expect_contains"))
    assert {r.id: r.failures for r in got.collect() if not r.passed} == {"wrong": ["outcome", "content missing Paris"]}
    assert tuple(evaluation.tally(got).first()) == (6, 1)


def test_highlights_and_quotes(spark):
    text = "".join(f"{i:07d}" for i in range(80_000))  # 560,000 characters
    rows = spark.createDataFrame([(text, 300_000, 301_000), (text, 100, 200), (text[:400_000], 300_000, 301_000)], "text string, s int, e int")
    got = rows.select(search.highlight(F.col("text"), F.col("s"), F.col("e")).alias("h")).collect()
    assert [(r.h.text_offset, r.h.window == w) for r, w in zip(got, (text[295_000:306_000], text[:5_200], text[:400_000]))] == [(295_000, True), (0, True), (0, True)]
    assert each(spark, lambda c: documents.quote(F.lit("spectral lines of stars"), c), ["It rains. The stars show spectral lines. Stars too.", "Nothing here."]) == ["The stars show spectral lines.", None]


def test_trees_with_cycles_and_depth(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(12)] + [(50, 51, "x"), (51, 52, "y"), (52, 50, "z")]
    up = access.ancestors(spark.createDataFrame(chain, "id long, parent_id long, name string")).collect()
    assert {(r.id, r.ancestor_id, r.depth) for r in up if r.id < 50} == {(i, j, i - j) for i in range(12) for j in range(i + 1)}
    assert {(r.id, r.ancestor_id) for r in up if r.id >= 50} == {(i, j) for i in (50, 51, 52) for j in (50, 51, 52)}


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    """A chain of 300, a cycle of 7 with a tail, a parent that is no collection."""
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(400 + i, 400 + (i + 1) % 7) for i in range(7)] + [(500, 403), (600, 999), (601, 600)]
    names = []
    monkeypatch.setattr(access, "written", lambda df, name: names.append(name) or shared.written(df, name))
    got = {(r.id, r.ancestor_id): r.depth for r in access.ancestors(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    want, up = {}, dict(rows)
    for i in up:
        at, depth = i, 0
        while at is not None and (i, at) not in want:
            want[i, at] = depth
            at, depth = up.get(at), depth + 1
    assert got == want and names.count("above") <= 11


def test_upsert(spark):
    schema = "k int, v string"
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], schema)
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1), (4, "d", 1)], schema + ", at int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], "at").collect())) == [(2, "y"), (3, None), (4, "d")]
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], "at", delete_missing=False).collect())) == [(1, "a"), (2, "y"), (3, None), (4, "d")]
    last = new.where("at = 2 OR k <> 2").drop("at")
    assert {r.k: r.change for r in sinks.changes(old, last, ["k"]).collect()} == {1: "delete", 2: "update", 3: "keep", 4: "insert"}


def test_replay_before_live(spark, tmp_path):
    schema = "key long, status string, ts timestamp"
    old = spark.sql("SELECT 1L AS key, 'processing' AS status, timestamp'2024-01-01' AS ts UNION ALL SELECT 2L, 'success', timestamp'2024-01-01'")
    spark.sql("SELECT 3L AS key, 'queued' AS status, timestamp'2024-01-02' AS ts").write.parquet(f"{tmp_path}/in")
    seen = []
    events.replay_then_live(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), old, lambda b, n: seen.append(sorted((r.key, r.live) for r in b.collect())), f"{tmp_path}/cp").awaitTermination()
    assert seen == [[(1, False), (3, True)]]


def test_rest_of_a_prompt(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", "x" * 4000), (1, 2, "user", "y" * 4000), (2, 0, "user", "a"), (2, 1, "user", "z" * 5100), (3, 0, "user", "only")]
    got = prompts.preflight(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), limit=1800, completion=400).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn) for r in got] == [(1, 0), (1, 2), (2, 0), (2, 1), (3, 0)]
    total = lambda c: 12 + sum(6 + max(1, len("user") // 4) + max(1, len(r.text) // 4) for r in got if r.conv_id == c)
    assert total(1) <= 1240 and total(2) <= 1240 and got[3].text.startswith("z")
    assert {r.max_tokens for r in got} == {400}


def test_embedding_stand_in(spark):
    import zlib

    texts = ["a b a", "", None, "É é x"]
    got = each(spark, lambda c: vectors.hashing_embedding(c, 16), texts)
    for t, v in zip(texts, got):
        want = [0.0] * 16
        for w in re.findall(r"\w+", (t or "").lower()):
            want[zlib.crc32(w.encode()) % 16] += 1
        assert list(v) == want


def test_hybrid_search_by_hand(spark):
    """All three legs on a handful of chunks, ranks in the order of the legs."""
    texts = ["alpha beta", "gamma NGC-12", "delta", "alpha NGC-12 beta", "omega"]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, chunk_number int, content string")
    near = chunks.withColumn("distance", F.when(F.col("doc_id") == 4, 0.0).otherwise(F.col("doc_id") + 1.0))
    got = search.hybrid(chunks, "alpha NGC-12", 5, vectors=near).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [4, 0, 1, 2, 3]
    assert [r.doc_id for r in search.hybrid(chunks, "alpha NGC-12", 3).orderBy("rank").collect()] == [3, 1, 0]
    with pytest.raises(ValueError):
        documents.search_one(chunks, 1, "x", 16)


def test_passages_on_pages(spark):
    """Found tight, spaced and by letters only, over pages, without an end, and not at all."""
    words = [f"word{i}" for i in range(120)]
    pages = {0: words[:40], 1: words[40:80], 2: words[80:]}
    items = [(1, p, k, w) for p, ws in pages.items() for k, w in enumerate(ws)] + [(2, 0, k, x) for k, x in enumerate(["Some “quoted”", "text – that", "runs ON here"])] + [(3, 0, 0, "hyphen-"), (3, 0, 1, "ated words are letters only!")]
    passages = [(1, 1, " ".join(words[3:9])), (2, 1, " ".join(words[5:70])), (3, 1, " ".join(words[5:110])), (4, 1, " ".join(words[5:60]) + " and an end that stands nowhere at all in this document, whatever one does to find it, as it is long enough to be an anchor"), (5, 2, 'some "quoted" text - that runs on'), (6, 3, "hyphenated words are letters only"), (7, 1, "short"), (8, 1, "nothing like this stands there")]
    got = anchors.locate(spark.createDataFrame(items, "doc_id int, page int, item int, text string"), spark.createDataFrame(passages, "passage_id long, doc_id int, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3, 8), (2, 0, 5, 39), (2, 1, 0, 29), (3, 0, 5, 39), (3, 1, 0, 39), (3, 2, 0, 29), (4, 0, 5, 39), (5, 0, 0, 2), (6, 0, 0, 1)]
    assert each(spark, anchors.normal_form, ["ﬁne—“X” \u00ad y", None]) == ['fine-"x" y', ""]


def test_citations_of_answers(spark):
    text = "Intro [doc:a chunk:1]\n  - an indented claim here\n- a claim without source\n```\n- code is no claim\n```\n# - heading is no claim\n1. a cited claim [doc:a chunk:2]\n- leads to this:\n- two words\nNo source\n  - now this one counts"
    rows = spark.createDataFrame([(1, text, ["[doc:a chunk:1]"]), (2, "All [doc:a chunk:1] fine", ["[doc:a chunk:1]"]), (3, "nothing", []), (4, "nothing", ["x"]), (5, None, ["x"])], "id int, text string, allowed array<string>")
    assert sorted((r.id, r.line) for r in citations.uncited(rows).collect()) == [(1, "- a claim without source"), (1, "- now this one counts")]
    got = {r.id: (r.invalid, r.n_uncited, r.passed) for r in citations.checked(rows).collect()}
    assert got == {1: (["[doc:a chunk:2]"], 2, False), 2: ([], 0, True), 3: ([], 0, True), 4: ([], 0, False), 5: ([], 0, False)}


def test_reranking_service(spark):
    rows = spark.createDataFrame([(k, f"c{k}", k * 10) for k in range(1, 5)], "rank int, content string, doc_id long")
    ask = lambda answer: [(r.rank, r.doc_id) for r in reranking.by_service(rows, "q", 3, lambda request: answer).orderBy("rank").collect()]
    assert ask('{"results": [{"index": 2}, {"index": 0}, {"index": 2}, {"index": 7}, {"index": 1.5}]}') == [(1, 30), (2, 10)]
    assert ask("no JSON") == ask("{}") == [(1, 10), (2, 20), (3, 30)]

    def fails(request):
        raise OSError("down")

    assert reranking.by_service(rows, "q", 9, fails).count() == 4


def test_media_and_papers(spark):
    import gzip
    import io
    import tarfile
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/media/b.png", b"2")
        z.writestr("word/media/a.jpg", b"1")
        z.writestr("word/document.xml", b"x")
    files = spark.createDataFrame([("x.docx", buf.getvalue()), ("bad.docx", b"zip?"), ("y.pdf", b"%PDF"), ("n.txt", b"t")], "path string, content binary")
    got = sorted((r.path, r.number, r.name, r.error is None) for r in media.figures(files, {".pdf": lambda c: [("p1", c)]}).collect())
    assert got == [("bad.docx", 0, None, False), ("x.docx", 1, "word/media/a.jpg", True), ("x.docx", 2, "word/media/b.png", True), ("y.pdf", 1, "p1", True)]
    small = media.smaller(spark.createDataFrame([(1, "a.png", b"x" * 9), (2, "b.png", b"y")], "id long, name string, image binary"), lambda x, most: x[:most], 4)
    assert sorted((r.id, r.name, bytes(r.image)) for r in small.collect()) == [(1, "a.png.jpg", b"xxxx"), (2, "b.png", b"y")]

    feed = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A\n B</title><summary>S</summary><author><name>X Y</name></author></entry></feed>'
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for n, c in (("b.tex", b"two"), ("a.tex", b"one"), ("c.sty", b"no")):
            info = tarfile.TarInfo(n)
            info.size = len(c)
            t.addfile(info, io.BytesIO(c))
    archives = {"1": tar.getvalue(), "2": gzip.compress(b"single"), "3": b"?"}
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    rows = {r.id: r for r in arxiv.papers(ids, lambda i: feed, lambda i: archives[i]).collect()}
    assert (rows["1"].title, rows["1"].authors, rows["1"].tex) == ("A B", "X Y", "one\n\ntwo") and rows["2"].tex == "single" and rows["3"].error and rows["3"].title == "A B"


def test_skills_and_tools(spark):
    import sys
    import types

    def hello(spark, n: int = 1):
        """Says so."""
        return spark.range(n)

    a, b = types.ModuleType("skill_a"), types.ModuleType("skill_b")
    a.tools, b.tools = lambda: [hello], lambda: [hello]
    a.system_prompt_extra, b.system_prompt_extra = lambda: " A ", lambda: "  "
    sys.modules.update(skill_a=a, skill_b=b)
    mods, failed = skills.load(["skill_a", " skill_b", "skill_a", "no_such_skill", ""])
    assert mods == [a, b] and list(failed) == ["no_such_skill"]
    assert skills.collect_prompts(mods) == "A" and list(skills.collect_tools(mods).functions) == ["hello"]
    chunks = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "gamma"), (2, 0, "delta alpha")], "doc_id long, chunk_number int, content string")
    docs = spark.createDataFrame([(1, "one", "alpha beta gamma"), (2, "two", "delta alpha")], "doc_id long, title string, text string")
    tools = skills.document_tools(chunks, docs)
    assert [r.doc_id for r in tools.call(spark, "vector_search", search_string="alpha beta", top_k=2)[0].orderBy("rank").collect()] == [1, 2]
    assert tools.call(spark, "more_context", doc_id=1, chunk_number=0)[0].first()["text"] == "alpha beta\ngamma"
    assert tools.call(spark, "whole_document", doc_id=2)[0].first()["text"] == "delta alpha" and tools.call(spark, "document_ids")[0].count() == 2
    assert tools.call(spark, "search_single_document", doc_id=1, search_string=" ")[1] == "ValueError: search_string must not be empty"
    assert each(spark, lambda c: skills.compressed(c, lambda x: F.substring(x, 1, 2)), ["abc", "a"]) == ["ab", "a"]


def test_trigram_scores_equal_the_columns(spark):
    texts = ["a", "Ab, cd-EF!", "été d’Été 12x", "", None, "x " * 50, "dark matter in NGC 1275"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, chunk_number int, content string")
    query = "Dark été ab x"
    got = search.trigram_scores(rows, query).withColumn("want", T.similarity(T.trigrams(F.coalesce("content", F.lit(""))), T.trigrams(F.lit(query)))).collect()
    assert len(got) == 7 and all(r.similarity == pytest.approx(r.want) for r in got) and len({r.similarity for r in got}) > 4


def test_text_near_figures(spark):
    boxes = [(1, 1, 100.0, 100.0, 200.0, 200.0), (1, 2, 400.0, 100.0, 500.0, 200.0), (2, 1, 0.0, 0.0, 50.0, 50.0)]
    lines = [(1, 0, 90.0, 60.0, 210.0, 70.0, "Above it stands a sentence"), (1, 1, 100.0, 205.0, 200.0, 215.0, "Figure 3 shows"), (1, 2, 100.0, 216.0, 200.0, 226.0, "all."), (1, 3, 100.0, 227.0, 200.0, 237.0, "More"), (1, 4, 390.0, 40.0, 510.0, 50.0, "Just a longer line of text"), (2, 0, 0.0, 60.0, 40.0, 70.0, "short")]
    got = images.nearby_captions(spark.createDataFrame(boxes, "page int, box_id int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(lines, "page int, line int, x0 double, y0 double, x1 double, y1 double, text string"))
    assert {(r.page, r.box_id): r.caption for r in got.collect()} == {(1, 1): "Figure 3 shows all.", (1, 2): "Just a longer line of text", (2, 1): ""}


def test_image_tools(spark):
    a = spark.range(100).selectExpr("int(id div 10) AS y", "int(id % 10) AS x", "double(CASE WHEN id = 42 THEN 1000 ELSE id % 3 END) AS v")
    tools = skills.image_tools({"a": a, "b": a.withColumn("v", F.lit(2.0)), "c": a.where("y < 5")})
    got = {(r.y, r.x): r.v for r in tools.call(spark, "subtract", image="a", sky="b")[0].collect()}
    assert got[4, 2] == 998.0 and len(got) == 100
    assert [(r.y, r.x) for r in tools.call(spark, "point_sources", image="a")[0].collect()] == [(4, 2)]
    assert tools.call(spark, "divide", image="a", flat="c")[1] == "ValueError: a and c differ in shape"
    assert tools.call(spark, "statistics", image="a")[0].first()["n"] == 99
