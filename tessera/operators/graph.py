"""Entity graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import cosine
from tessera.operators.ordering import ranked
from tessera.operators.vector_index import VectorIndex, similar, unit
from tessera.shared import written
#: Most query vectors that become part of a plan.
IN_PLACE = 64


def expand(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing and incoming edges (source_id, relationship, destination_id) of the nodes (id); one with both ends among them appears twice."""
    out = edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").withColumn("direction", F.lit("out"))
    into = edges.join(nodes.select(F.col("id").alias("destination_id")), "destination_id", "left_semi").withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def similar_nodes(nodes: DataFrame, queries: DataFrame, threshold: float, width: int = 64, limit: int | None = 100) -> DataFrame:
    """For each query vector (q, vector) the ``limit`` nodes (id, embedding) of greatest cosine that reach the threshold (ties: newer first; None: all that reach it); then each node's best: id, score.

    Nodes and queries without a vector of ``width`` components, or with one of length 0, take no part. The few vectors of one question are scored at every node in place;
    more than ``IN_PLACE`` of them meet the nodes through a vector index.
    """
    few = queries.where(F.size("vector") == width).select("q", F.col("vector").cast("array<double>").alias("vector")).limit(IN_PLACE + 1).collect()
    if len(few) > IN_PLACE:
        found = similar(nodes.select("id", F.col("embedding").alias("vector")), queries, threshold, width)
    else:
        scores = F.array(*(F.struct(F.lit(r["q"]).alias("q"), cosine(F.col("embedding"), F.lit(r["vector"])).alias("similarity")) for r in few)) if few else F.array().cast("array<struct<q:long,similarity:double>>")
        found = nodes.select("id", F.explode(F.filter(scores, lambda x: x["similarity"] >= threshold)).alias("x")).select("x.q", "id", "x.similarity")
    if limit is None:
        return found.groupBy("id").agg(F.max("similarity").alias("score"))
    place = Window.partitionBy("q").orderBy(F.desc("similarity"), F.desc("id"))
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).groupBy("id").agg(F.max("similarity").alias("score"))


def seeds(nodes: DataFrame, terms: Sequence[str], limit: int = 256, exact: Sequence[str] | None = None) -> DataFrame:
    """Candidate nodes (id, name, embedding) among those with a vector: exact names (``terms`` unless given) first, then names with a term, newest first."""
    name = F.lower("name")
    exact, part = name.isin(list(terms if exact is None else exact)), F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(name, t))
    return nodes.where("embedding IS NOT NULL").where(exact | part).withColumn("seed_rank", F.when(exact, 0).otherwise(1)).orderBy("seed_rank", F.desc("id")).limit(limit)


def prepared(relations: DataFrame) -> DataFrame:
    """``relations`` (source, relationship, destination; other columns stay) in normal forms; empty names, self-loops, relations that say nothing and edges between the two speakers go."""
    said = F.struct(T.entity(F.col("source")).alias("source"), T.relation(F.col("relationship")).alias("relationship"), T.entity(F.col("destination")).alias("destination"))
    # As a generated column the normal forms are worked out once; conditions on a plain one would repeat them.
    rows = relations.withColumn("_said", F.explode_outer(F.array(said))).select(*(F.col(f"_said.{c}").alias(c) if c in ("source", "relationship", "destination") else F.col(c) for c in relations.columns))
    speakers = sorted(set(T.SPEAKERS.values()))
    keep = ~F.col("relationship").isin("", *T.WEAK_RELATIONS) & (F.col("source") != F.col("destination")) & ~(F.col("source").isin(*speakers) & F.col("destination").isin(*speakers))
    return rows.where("source <> '' AND destination <> ''").where(keep)


def normalise(relations: DataFrame) -> DataFrame:
    """``prepared`` relations, equal ones merged."""
    return prepared(relations.select("source", "relationship", "destination")).distinct()


def extracted(answers: DataFrame) -> DataFrame:
    """Entities that a model's answers (id, payload: JSON) name in their calls: id, call_no, entity_no, entity, entity_type.

    Arguments may be an object or its text; ``entities`` a list, of which objects count, or a single object. Anything else names none.
    """
    kind = lambda v, name: F.startswith(F.schema_of_variant(v), F.lit(name))
    field = lambda v, name, of: F.try_variant_get(v, f"$.{name}", of)
    calls = answers.select("id", F.posexplode(field(F.try_parse_json("payload"), "tool_calls", "array<variant>")).alias("call_no", "call"))
    given = field(F.col("call"), "arguments", "variant")
    calls = calls.where(kind(F.col("call"), "OBJECT")).select("id", "call_no", F.when(kind(given, "STRING"), F.try_parse_json(F.try_variant_get(given, "$", "string"))).otherwise(given).alias("arguments"))
    some = field(F.col("arguments"), "entities", "variant")
    listed = F.when(kind(some, "OBJECT"), F.array(some)).when(kind(some, "ARRAY"), F.filter(F.try_variant_get(some, "$", "array<variant>"), lambda x: kind(x, "OBJECT")))
    rows = calls.select("id", "call_no", F.posexplode(listed).alias("entity_no", "e"))
    return rows.select("id", "call_no", "entity_no", field(F.col("e"), "entity", "string").alias("entity"), field(F.col("e"), "entity_type", "string").alias("entity_type"))


def by_query(nodes: DataFrame, texts: Sequence[str], limit: int = 256) -> DataFrame:
    """``seeds`` of the query's entity names: those of one word as exact names, all words as parts of names; without any, or if none is found, the newest ``limit`` nodes with a vector."""
    rows = nodes.sparkSession.createDataFrame([(x,) for x in texts], "text string").select(T.seed_terms(F.col("text"))).collect()
    terms = list(dict.fromkeys(w for r in rows for w in r[0]))
    exact = [r[0][0] for r in rows if len(r[0]) == 1]
    found = seeds(nodes, terms, limit, exact) if terms else None
    return found if found is not None and not found.isEmpty() else nodes.where("embedding IS NOT NULL").withColumn("seed_rank", F.lit(1)).orderBy(F.desc("id")).limit(limit)


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, threshold: float = 0.7, limit: int = 100, width: int = 64) -> DataFrame:
    """Edges of the nodes near any query vector: direction, both ends, and the similarity of the end that was found; the most similar first.

    ``nodes`` (id, embedding): the candidates, as ``by_query`` bounds them; ``edges``
    (source_id, relationship, destination_id); ``queries`` (q, vector).
    """
    near = similar_nodes(nodes, queries, threshold, width, limit)
    rows = expand(edges, near.select("id")).withColumn("id", F.when(F.col("direction") == "out", F.col("source_id")).otherwise(F.col("destination_id")))
    return rows.join(near, "id").drop("id").orderBy(F.desc("score"), "direction", "source_id", "relationship", "destination_id").limit(limit)


def first_come(items: DataFrame, near: DataFrame) -> DataFrame:
    """Which of ``items`` (e) stand when each in turn stands unless an earlier one near it does; ``near`` (later, earlier).

    In a round all items stand that have no undecided earlier neighbour, and what is near
    them falls; every round decides at least the first item of each group, usually whole layers.
    """
    live, left, standing = written(near.select("later", "earlier"), "near"), written(items.select("e"), "items"), None
    while True:
        heads = left.join(live, left["e"] == live["later"], "left_anti")
        standing = written(heads if standing is None else heads.unionByName(standing), "standing")
        fallen = written(live.join(standing, live["earlier"] == standing["e"], "left_semi").select("later").distinct(), "fallen")
        left = written(left.join(standing, "e", "left_anti").join(fallen, left["e"] == fallen["later"], "left_anti"), "items")
        if left.isEmpty():
            return standing
        live = written(live.join(fallen, "later", "left_anti").join(fallen.withColumnRenamed("later", "earlier"), "earlier", "left_anti"), "near")


def upsert(nodes: DataFrame, edges: DataFrame, relations: DataFrame, vectors: DataFrame, threshold: float = 0.7, width: int = 64) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a batch of relations, taken in the order of ``n``.

    ``nodes`` (id, name, embedding), ``edges`` (source_id, relationship, destination_id), ``relations`` (n,
    source, relationship, destination), ``vectors`` (name, vector) of the normal forms of names. Each end of a relation is the
    node of greatest cosine, if that reaches the threshold, among those there were
    before the relation (ties: the newer one). Without one it is the node of its name, which takes the
    vector, or a new node; the two ends of one relation don't see each other. An edge that
    exists is not added again. Relations that say nothing go (``prepared``); names without a usable vector merge by name.

    The batch is not replayed row by row. One similarity join finds what reaches the threshold;
    which names become nodes is decided in rounds over the pairs (``first_come``), and then every end takes the best node older than its relation.

    Returns nodes (id, name, embedding, is_new) and edges (source_id, relationship, destination_id, is_new).
    """
    rows = written(prepared(relations.select("n", "source", "relationship", "destination")), "relations")
    ends = rows.select("n", F.col("source").alias("name"), F.lit(0).alias("end")).unionByName(rows.select("n", F.col("destination").alias("name"), F.lit(1).alias("end")))
    firsts = ends.groupBy("name").agg(F.min(F.struct("n", "end")).alias("at")).select("name", F.col("at.n").alias("first"), F.col("at.end").alias("end"))
    known = vectors.where("name IS NOT NULL").groupBy("name").agg(F.min(F.col("vector").cast("array<double>")).alias("vector"))
    names = ranked(firsts.join(known, "name", "left"), "first", "end", "name", name="e")
    names = written(names, "names")
    asked = names.select(F.col("e").alias("q"), "vector")

    # Newer nodes come first among equals, so they are found by falling ids.
    old = nodes.select(F.col("id").cast("long").alias("id"), "name", F.col("embedding").cast("array<double>").alias("embedding"))
    by_age = unit(old.select((-F.col("id")).alias("id"), F.col("embedding").alias("vector")))
    best = VectorIndex.build(by_age, width).nearest(unit(asked), 1).select(F.col("q").alias("e"), (-F.col("id")).alias("old_id"), (1 - F.col("distance") * F.col("distance") / 2).alias("old_similarity"))
    best = written(best.where(F.col("old_similarity") >= threshold), "best")
    rest = written(names.join(best, "e", "left_anti"), "rest")
    near = written(similar(rest.select(F.col("e").alias("id"), "vector"), asked, threshold, width), "near")
    first = names.select("e", "first")
    pairs = near.join(first.toDF("q", "q_first"), "q").join(first.toDF("id", "id_first"), "id")
    later = pairs.where("id_first < q_first").select(F.col("q").alias("later"), F.col("id").alias("earlier")).join(rest.select(F.col("e").alias("later")), "later", "left_semi")
    standing = first_come(rest, later)

    named = old.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("named"))
    made = names.join(standing, "e", "left_semi").join(named, "name", "left")
    top = old.agg(F.max("id")).first()[0] or 0
    fresh = ranked(made.where("named IS NULL"), "e", name="place").withColumn("id", F.col("place") + F.lit(top)).drop("place")
    made = written(fresh.unionByName(made.where("named IS NOT NULL").withColumn("id", F.col("named"))).withColumn("is_new", F.col("named").isNull()), "made")

    at = ends.select("n", "name").distinct().join(names.select("name", "e"), "name")
    older = near.withColumnRenamed("q", "e").join(made.select(F.col("e").alias("m"), F.col("id").alias("made_id"), "first"), F.col("id") == F.col("m")).select("e", "made_id", "similarity", "first")
    choice = at.join(older, "e").where("first < n").groupBy("n", "e").agg(F.max(F.struct("similarity", "made_id")).alias("made"))
    given = at.join(choice, ["n", "e"], "left").join(best, "e", "left").join(made.select("e", F.col("id").alias("own_id")), "e", "left")
    old_one = F.when(F.col("old_id").isNotNull(), F.struct(F.col("old_similarity").alias("similarity"), F.col("old_id").alias("made_id")))
    given = written(given.select("n", "name", F.coalesce(F.greatest("made", old_one)["made_id"], "own_id").alias("id")), "given")

    found = rows.join(given.select("n", F.col("name").alias("source"), F.col("id").alias("source_id")), ["n", "source"])
    found = found.join(given.select("n", F.col("name").alias("destination"), F.col("id").alias("destination_id")), ["n", "destination"])
    keys = ["source_id", "relationship", "destination_id"]
    fresh_edges = found.select(*keys).distinct().join(edges.select(*keys), keys, "left_anti").withColumn("is_new", F.lit(True))
    changed = old.join(made.where("NOT is_new").select("id", "vector"), "id", "left").select("id", "name", F.coalesce("vector", "embedding").alias("embedding"), F.lit(False).alias("is_new"))
    return changed.unionByName(made.where("is_new").select("id", "name", F.col("vector").alias("embedding"), "is_new")), edges.select(*keys, F.lit(False).alias("is_new")).unionByName(fresh_edges)
