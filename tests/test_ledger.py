"""Batches taken in once, vectors made once, texts cut until a model takes them."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as S
from tessera.streaming import ledger as L

LOG = "text string"


class Counting:
    """Writes down each text it is asked for."""

    def __init__(self, log):
        self.log = log

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.writelines(repr(t) + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]


def parse(batch):
    return batch.select(F.col("name").alias("doc_id"), "text")


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, "name string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, handle):
    like = spark.createDataFrame([], "name string, text string")
    S.on_arrival(S.files(spark, str(tmp_path / "in"), like, 1), handle, str(tmp_path / "state")).awaitTermination()


def test_a_stream_killed_between_write_and_commit_gives_the_same_tables(spark, tmp_path):
    log = tmp_path / "asked"
    ledger = L.Ledger(spark, f"file://{tmp_path}/tables")
    step = L.ingest(ledger, parse, lambda: Counting(log), size=10, overlap=2)
    arrive(spark, tmp_path, [("a", "one text here"), ("b", "one text here"), ("c", None)])
    run(spark, tmp_path, step)

    def dies_after(batch, number):
        step(batch, number)
        raise RuntimeError("killed before the stream could note it")

    def dies_amid(batch, number):
        (parse(batch).write.mode("overwrite").parquet(f"{ledger.folder}/documents/batch={number}"))
        raise RuntimeError("killed amid the writes")

    arrive(spark, tmp_path, [("d", "other words and one text here"), ("a", "changed")])
    for handle in (dies_amid, dies_after):
        with pytest.raises(Exception, match="killed"):
            run(spark, tmp_path, handle)
    run(spark, tmp_path, step)
    run(spark, tmp_path, step)
    assert ledger.batches() == [0, 1]
    assert sorted(map(tuple, ledger.read("documents", L.DOCUMENTS).collect())) == [("a", "one text here"), ("b", "one text here"), ("c", None), ("d", "other words and one text here")]
    chunks = L.with_vectors(ledger).collect()
    assert all(r.embedding[0] == len(r.content) for r in chunks) and {r.doc_id for r in chunks} == {"a", "b", "d"}
    asked = log.read_text().split("\n")[:-1]
    assert len(asked) == len(set(asked)) == len({r.content for r in chunks}), "each distinct text once over all batches"


class Narrow:
    """Takes texts of at most ``most`` characters; may say so."""

    def __init__(self, most, says=False):
        self.most, self.says = most, says

    def embed(self, texts):
        if any(len(t) > self.most for t in texts):
            raise L.TooLong(self.most if self.says else None)
        return [[len(t)] for t in texts]


@pytest.mark.parametrize(("most", "says", "length", "got"), [(500, False, 1000, 409), (500, True, 1000, 500), (50, False, 130, None), (128, False, 130, 128), (100, True, 5000, None), (1000, False, 999, 999)])
def test_texts_are_cut_until_they_fit(most, says, length, got):
    assert L.embedded(Narrow(most, says), ["x" * length, "y"]) == ([[float(got)], [1.0]] if got else [None, [1.0]])


def test_embedding_of_nulls_and_bad_input_types(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, text string")
    assert sorted((r.id, r.embedding) for r in L.embed(rows, lambda: Narrow(5)).collect()) == [(1, [2.0]), (2, None), (3, [0.0])]
    with pytest.raises(ValueError, match="input type"):
        L.embed(rows, lambda: Narrow(5), "search")


class Seeing:
    def embed_image(self, text, image):
        if image == b"bad":
            raise RuntimeError("no such image")
        return [float(len(image))]


def test_images_fall_back_on_their_caption(spark):
    rows = spark.createDataFrame([(1, "ab", bytearray(b"12345")), (2, "abc", bytearray(b"bad")), (3, "abcd", None), (4, None, None)], "id long, text string, image binary")
    assert sorted((r.id, r.embedding) for r in L.with_images(rows, lambda: Narrow(9), Seeing).collect()) == [(1, [5.0]), (2, [3.0]), (3, [4.0]), (4, None)]
    assert [r.embedding for r in L.with_images(rows.where("id = 1"), lambda: Narrow(9)).collect()] == [[2.0]]
