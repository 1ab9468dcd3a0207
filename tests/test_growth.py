"""Work that grows no faster than the input: no expression is repeated, no group meets in all pairs."""

from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import speech as S
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import documents, graph, images, trigram_index, vector_index


def regexes(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(name) for name in ("regexp_replace(", "regexp_extract(", "split(", "lower("))


def test_texts_are_worked_through_once(spark):
    t = spark.createDataFrame([("a", "b")], "text string, other string")
    assert regexes(t.select((T.useful_sentence(F.col("text"))).alias("x"))) <= 6
    assert regexes(t.select((T.snippet(F.col("text"))).alias("x"))) <= 20
    assert regexes(t.select((documents.quote(F.col("text"), F.col("other"))).alias("x"))) <= 8
    assert regexes(t.select((S.shown(F.col("text"))).alias("x"))) <= 40


def test_normal_forms_are_worked_out_once(spark):
    rows = [("The  User", "works on", "Italy"), ("me", "is", "x"), ("A", "likes", "a"), ("B!", "likes", "c"), (None, "likes", "c"), ("user", "likes", "assistant")]
    got = graph.normalise(spark.createDataFrame(rows, "source string, relationship string, destination string"))
    assert regexes(got) <= 12
    assert sorted(map(tuple, got.collect())) == [("b", "PREFERS", "c"), ("user", "WORKS_ON", "italy")]


def test_boost_looks_at_what_stands_around(spark):
    cases = [("10.1234/a", 0.2), ("x10.1234/a", 0.0), ("a 10.1234/a", 0.2), ("_10.1234/b", 0.0), ("10.123/a", 0.0), ("DOI: x", 0.2), ("in 1999.", 0.05), ("1999", 0.05), ("x1999", 0.0), ("19999", 0.0), ("2024_", 0.0), ("12024", 0.0), ("[3] 2001", 0.2)]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, text string").orderBy("i").select(F.round(T.citation_boost(F.col("text")), 2)).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_every_node_above_the_threshold_is_found(spark):
    nodes = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(250)], "id long, embedding array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "q long, vector array<double>")
    assert graph.similar_nodes(nodes, query, 0.5, 2, limit=None).count() == 250
    assert graph.similar_nodes(nodes, query, 0.5, 2).count() == 100


def test_pairs_without_a_common_word_overlap_by_nothing(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    got = plans.QUERIES["lexical_salience_pairs"](spark, "/root/testdata/sf0.001").select("overlap").collect()
    assert len(got) == n * (n - 1) // 2 and any(r.overlap == 0 for r in got)


def test_boxes_that_lie_alike_meet_drawings_once(spark):
    boxes = spark.range(300).selectExpr("1L AS page", "id AS box_id", "10 AS x0", "10 AS y0", "20 AS x1", "20 AS y1").unionByName(spark.range(1).selectExpr("1L AS page", "999L AS box_id", "400 AS x0", "400 AS y0", "410 AS x1", "410 AS y1"))
    drawn = spark.range(300).selectExpr("1L AS page", "15 AS px0", "12 AS py0", "25 AS px1", "18 AS py1")
    got = images.refine_boxes(boxes, drawn)
    rows = got.collect()
    assert len(rows) == 301 and {tuple(r)[2:] for r in rows if r.box_id < 300} == {(15, 12, 25, 18)} and {tuple(r)[2:] for r in rows if r.box_id == 999} == {(400, 400, 410, 410)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3


def test_queries_meet_texts_without_an_index_of_these(spark, monkeypatch):
    words = ["dark", "matter", "halo", "star", "", "dust ring", "Staré město"]
    texts = spark.range(700).select(F.col("id").alias("key"), F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, words)), ((F.col("id") * p + p) % 7 + 1).cast("int")) for p in (1, 3, 5))).alias("text")).unionByName(spark.createDataFrame([(900, None), (901, "!")], "key long, text string"))
    queries = spark.createDataFrame([(i, w) for i, w in enumerate(["dark halo", "", "star dust", None, "matter", "zzz"])], "q long, text string")
    whole = lambda: sorted(map(tuple, trigram_index.top(texts, queries, 5).collect()))
    got = whole()
    assert len(got) == 15 and got == sorted(map(tuple, trigram_index.TrigramIndex.build(texts).top(queries, 5).select("q", "key", "similarity", "rank").collect()))
    monkeypatch.setattr(trigram_index, "ASKED", 1)
    assert got == sorted((r.q, r.key, r.similarity, r.rank) for r in trigram_index.top(texts, queries, 5).collect())
    assert trigram_index.top(texts, queries.where("q = 1"), 5).count() == 0


def test_queries_go_to_their_pools_in_bounded_batches(spark, monkeypatch):
    rows = spark.range(300).select("id", F.array(*(F.sin(F.col("id") * k) for k in (1, 2, 3, 5))).alias("vector"))
    pairs = lambda: {(r.q, r.id) for r in vector_index.similar(rows, rows.withColumnRenamed("id", "q"), 0.9, 4, 16).collect()}
    whole = pairs()
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    monkeypatch.setattr(vector_index, "SENT", 7)
    assert pairs() == whole and len(whole) > 300


def test_skills_beyond_the_prompt_go_before_users_meet_them(spark, monkeypatch):
    collections = spark.createDataFrame([(1, None, "a"), (2, 1, "Skills")], "id long, parent_id long, name string")
    docs = spark.range(200).select((F.col("id") % 2 + 1).alias("collection_id"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("_skill.md")).alias("title"), F.concat(F.lit("text "), "id").alias("text"), F.lit(False).alias("is_text"))
    users = spark.createDataFrame([(7, 1), (8, 2)], "user_id long, collection_id long")
    prompt = lambda most: {r.user_id: r.prompt for r in documents.skills(collections, docs, users, most).collect()}
    whole, short = prompt(10**6), prompt(90)
    assert short == {u: x[:90].rstrip() for u, x in whole.items()} and whole[7].count("text ") == 200
    assert documents.skills(collections, docs, users)._jdf.queryExecution().optimizedPlan().toString().count("deal") > 0


def test_embeddings_do_not_depend_on_the_batch(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"w{i} w{i % 3} x") for i in range(20)] + [(20, None), (21, "")], "i int, text string")
    embed = lambda: [list(r[0]) for r in texts.orderBy("i").select(V.hashing_embedding(F.col("text"), 8)).collect()]
    whole = embed()
    monkeypatch.setattr(V, "TEXTS", 3)
    assert embed() == whole and sum(whole[0]) == 3 and sum(whole[20]) == 0


def test_a_query_goes_to_a_shelf_once(spark, monkeypatch):
    """What is sent grows with the queries times a fixed number of shelves, not with the pools."""
    rows = spark.range(400).select("id", F.array(*(F.sin(F.col("id") * k) for k in (1, 2, 3, 5))).alias("vector"))
    monkeypatch.setattr(vector_index, "BLOCK", 8)
    monkeypatch.setattr(vector_index, "SHELVES", 3)
    index = vector_index.VectorIndex.build(rows, 4, 64)
    assert index.blocks.count() > 30 and index.shelf.max() < 4
    asked = rows.select(F.col("id").alias("q"), "vector", F.lit(9.0).alias("limit"))
    sent = index._sent(asked, lambda away, low, limit: low <= limit)
    assert sent.count() <= 4 * 400 and sent.select("q", F.explode("cells")).count() == 400 * int((index.count > 0).sum())
    assert index.within(rows.withColumnRenamed("id", "q"), 9.0).count() == 400 * 400
