"""A versioned library: pages as partitions, versions as offsets, a stream that goes on."""

import json

from tessera.sources import library as L


class Shelf:
    """A service whose items lie in a file; writes down what it is asked."""

    def __init__(self, options):
        self.at, self.log = options["at"], options["at"] + ".log"

    def _changed(self, since):
        with open(self.at) as f:
            return sorted((i for i in json.load(f) if i["version"] > since), key=lambda i: (i["version"], i["key"]))

    def state(self, since):
        items = self._changed(since)
        return (max((i["version"] for i in items), default=since), len(items))

    def items(self, since, start, limit):
        with open(self.log, "a") as f:
            f.write(f"{since} {start} {limit}\n")
        return self._changed(since)[start : start + limit]


def item(n, version, title="T", deleted=False):
    return {"key": f"k{n}", "version": version, "data": {"itemType": "book", "title": f"{title}{n}"}, "deleted": deleted}


def put(path, items):
    path.write_text(json.dumps(items))


def test_a_read_takes_pages_in_partitions(spark, tmp_path):
    path = tmp_path / "shelf"
    put(path, [item(i, i) for i in range(1, 251)])
    L.source(spark, "shelf_read", Shelf)
    rows = spark.read.format("shelf_read").option("at", str(path)).load()
    assert rows.rdd.getNumPartitions() == 3
    got = rows.collect()
    assert sorted(r.version for r in got) == list(range(1, 251)) and got[0].title.startswith("T") and json.loads(got[0].data)["itemType"] == "book"
    assert spark.read.format("shelf_read").option("at", str(path)).option("since", 240).option("pages", 2).load().count() == 10
    put(path, [])
    assert spark.read.format("shelf_read").option("at", str(path)).load().count() == 0


def test_a_stream_goes_on_from_its_version(spark, tmp_path):
    path, out = tmp_path / "shelf", tmp_path / "out"
    L.source(spark, "shelf_stream", Shelf)

    def run():
        stream = spark.readStream.format("shelf_stream").option("at", str(path)).load()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.schema(stream.schema).parquet(str(out))

    put(path, [item(i, i) for i in range(1, 121)])
    assert run().count() == 120
    put(path, [item(i, i) for i in range(3, 121)] + [item(1, 121, "new"), item(2, 122, deleted=True)])
    rows = run()
    assert rows.count() == 122, "only what changed is read again"
    assert all(int(x.split()[0]) >= 120 for x in (tmp_path / "shelf.log").read_text().split("\n")[2:-1])
    now = {r.key: r.title for r in L.current(rows).collect()}
    assert len(now) == 119 and now["k1"] == "new1" and "k2" not in now
    assert run().count() == 122


def test_items_without_fields():
    assert L.row({"key": "a", "version": 3}) == ("a", 3, None, None, None, False, "{}")
    assert L.row({"data": {"deleted": 1, "parentItem": "p"}})[4:6] == ("p", True)
