"""Edge cases of the column functions and small operators."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import access, chunking, conversation, evidence, graph, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 1), (1664, 1), (1665, 2), (1700, 2), (2048, 2), (2049, 2)])
def test_chunk_counts(spark, n, count):
    rows = chunking.chunk(spark.createDataFrame([(1, "a" * n)], "doc_id long, text string")).collect()
    assert len(rows) == count
    assert all(r.content == "a" * (r.end_position - r.start_position) for r in rows)


def test_last_chunk_lies_within(spark):
    rows = chunking.chunk(spark.createDataFrame([(1, "a" * 1700)], "doc_id long, text string")).orderBy("chunk_number").collect()
    assert [(r.start_position, r.end_position) for r in rows] == [(0, 1700), (1664, 1700)]


def test_image_chunk_starts_at_text_end(spark):
    docs = spark.createDataFrame([(1, "a" * 116, "  "), (2, "", "cat")], "doc_id long, text string, caption string")
    rows = {r.doc_id: r for r in chunking.image_chunks(docs.select("doc_id", "caption"), chunking.chunk(docs)).collect()}
    assert (rows[1].start_position, rows[1].content, rows[1].chunk_number) == (116, "Image chunk", 1)
    assert (rows[2].start_position, rows[2].end_position, rows[2].chunk_number) == (0, 3, 0)


def test_candidate_limits():
    assert [search.limits("x" * n, 10) for n in (48, 49, 159, 160)] == [12] * 4
    assert search.limits("x", 5) == 12
    assert search.limits("x", 15) == 17


def test_trigram_similarity(spark):
    sim = lambda a, b: one(spark, T.similarity(T.trigrams(F.lit(a)), T.trigrams(F.lit(b))))
    assert sim("word", "word") == 1.0
    assert sim("abc", "xyz") == 0.0
    assert sim("", "") == 0.0
    assert sim("word", "words") == pytest.approx(4 / 7)


def test_vectors(spark):
    arr = lambda *v: F.array(*map(F.lit, map(float, v)))
    assert one(spark, V.l2_distance(arr(0, 3), arr(4, 0))) == 5.0
    assert one(spark, V.cosine(arr(0, 0), arr(1, 0))) == -1.0
    assert one(spark, V.cosine(arr(1), arr(1, 0))) == -1.0
    assert one(spark, V.cosine(arr(1, 0), arr(2, 0))) == 1.0
    for n in (3, 1024, 2048):
        assert one(spark, F.size(V.fit_dims(F.array_repeat(F.lit(1.0).cast("float"), n)))) == 1024
    rows = spark.createDataFrame([("a b a",), (None,)], "t string").select(V.hashing_embedding(F.col("t"), 8).alias("v")).collect()
    assert [sum(r.v) for r in rows] == [3.0, 0.0]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: T.token_estimate(F.lit("")), 1),
        (lambda: T.citation_boost(F.lit("see [3], doi:10.1234/ab in 1999")), pytest.approx(0.4)),
        (lambda: T.first_sentence(F.lit("One  two. Three.")), "One two."),
        (lambda: T.first_sentence(F.lit("a" * 300)), "a" * 260 + "..."),
        (lambda: T.unhyphenate(F.lit("exam- \nple")), "example"),
        (lambda: T.cut(F.lit("x" * 1501)), "x" * 1500 + "... [truncated]"),
        (lambda: T.conversation_title(F.lit(" what is the mass of this far galaxy cluster? ")), "What is the mass of this far galaxy..."),
        (lambda: T.conversation_title(F.lit("")), "Conversation"),
        (lambda: T.visible(F.lit("<think>a\nb</think> yes ")), "yes"),
        (lambda: T.redact_images(F.lit("a data:image/png;base64,AAA= b")), "a [image] b"),
        (lambda: T.front_matter(F.lit("---\nName: x\nnote: a:b\n---\nbody")), {"name": "x", "note": "a:b"}),
        (lambda: T.number_map(F.lit("vector_search:4,invalid,search_single_document:abc,whole_document:-1,:2")), {"vector_search": 4}),
        (lambda: T.seconds(F.lit("01:02:03.5")), 3723.5),
        (lambda: T.seconds(F.lit("02:03.250")), 123.25),
        (lambda: T.seconds(F.lit("x")), None),
        (lambda: T.json_object(F.lit('```json\n{"a": 1}\n```')), '{"a": 1}'),
        (lambda: T.repair_uuid(F.lit("<b>" + "a" * 27 + "</b>")), None),
        (lambda: T.repair_uuid(F.lit("A" * 28)), "aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaa0000"),
        (lambda: T.entity(F.lit(" The User ")), "user"),
        (lambda: T.relation(F.lit("works on")), "WORKS_ON"),
        (lambda: T.fact(F.lit("Please remember that I like tea")), "I like tea"),
        (lambda: T.low_value_fact(F.lit("remember this.")), True),
        (lambda: T.fact_category(F.lit("I prefer tea")), "preference"),
        (lambda: T.fit_name(F.lit("n" * 120)), "n" * 91 + "-" + __import__("hashlib").sha1(b"n" * 120).hexdigest()[:8]),
        (lambda: T.drop_nul(F.lit("a\x00b")), "ab"),
        (lambda: T.unwrap(F.lit("a\nb\n\nc")), "a b\n\nc"),
    ],
)
def test_text(spark, column, expected):
    assert one(spark, column()) == expected


@pytest.mark.parametrize(
    ("message", "collections", "reason"),
    [
        ("try again.", True, "retry_request"),
        ("Subtract the sky from my fits file", True, "local_tool_request"),
        ("show me the figures", True, "figure_request"),
        ("Search the docs for dark matter.", False, "explicit_search"),
        ("What does this paper say?", True, "collection_backed_question"),
        ("What does this paper say?", False, "no_retrieval_needed"),
        ("hello", True, "no_retrieval_needed"),
    ],
)
def test_intent(spark, message, collections, reason):
    assert one(spark, conversation.intent(F.lit(message), collections)) == reason


def test_feedback_whitespace_passes(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, None, "", None), (3, None, " ", None), (4, 5, None, None)], "i int, rating int, feedback_text string, ts timestamp")
    assert [r.i for r in conversation.feedback(rows).orderBy("i").collect()] == [3, 4]


def test_ratings(spark):
    assert [one(spark, conversation.valid_rating(F.lit(x))) for x in ("0", "6", "x", "5")] == [None, None, None, 5]
    assert one(spark, F.length(conversation.valid_feedback(F.lit("y" * 10_001)))) == 10_000
    assert one(spark, conversation.valid_feedback(F.lit("  "))) is None


def test_interleave_and_budget(spark):
    rows = [(1, "A", i, i, "x" * 8) for i in range(1, 5)] + [(1, "B", 1, 5, "x" * 8)]
    df = spark.createDataFrame(rows, "query_id int, doc_id string, chunk_number int, rank int, content string")
    got = evidence.cap_and_interleave(df).orderBy("position").collect()
    assert [r.doc_id for r in got] == ["A", "B", "A", "A"]
    costs = spark.createDataFrame([(1, 1, "x" * 20), (1, 2, "x" * 24), (1, 3, "x" * 4)], "query_id int, position int, content string")
    assert [r.position for r in evidence.budget(costs, 10).collect()] == [1]
    assert [r.position for r in evidence.budget(costs, 2).collect()] == [1]


def test_edge_with_both_ends_counts_twice(spark):
    edges = spark.createDataFrame([(1, "R", 2)], "source_id long, relationship string, destination_id long")
    assert graph.expand(edges, spark.createDataFrame([(1,), (2,)], "id long")).count() == 2


def test_direct_and_inherited_access(spark):
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "id long, parent_id long, name string")
    grants = spark.createDataFrame([(1, 7, 1, "EDIT")], "grant_id long, user_id long, collection_id long, permission string")
    assert [r.collection_id for r in access.direct(grants, "VIEW").collect()] == [1]
    assert sorted(r.collection_id for r in access.inherited(tree, grants, "VIEW").collect()) == [1, 2]
    assert access.direct(grants, "MANAGE").count() == 0
    assert {r.id: r.path for r in access.paths(tree).collect()} == {1: "a", 2: "a/b"}


def test_captions_of_other_speakers_stay_apart(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "z"), (1, 4, None, "u"), (1, 5, None, "v")], "conv_id long, turn long, speaker string, text string")
    got = [(r.start_turn, r.text) for r in conversation.coalesce_captions(rows).orderBy("start_turn").collect()]
    assert got == [(1, "x y"), (3, "z"), (4, "u"), (5, "v")]
