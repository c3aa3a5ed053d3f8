import collections

from loomgraph.operators import facets as X
from loomgraph.sources.loads import Loads
from pyspark.sql import functions as F

ROWS = [(1, ["a.b.c", "a.b.d", "a.e", "f"], ["x"]), (1, ["a.b.c"], ["y"]), (2, ["a.b", "ab.c"], None), (3, None, ["x", "x", None]), (None, ["a.e.g"], ["x"]), (None, ["a.e.h"], ["y"]), (4, [], []), (5, ["a"], ["x", "y"])]


def by_hand(rows, chosen):
    texts = collections.defaultdict(set)
    for i, *dims in rows:
        dims = {n: [p.split(".") for p in d or [] if p is not None] for n, d in zip(("tree", "tag"), dims, strict=True)}
        if all(any(p[: len(c)] == c for p in dims[n]) for n, c in chosen.items()):
            for n, paths in dims.items():
                c = chosen.get(n, [])
                for p in paths:
                    if p[: len(c)] == c and len(p) > len(c):
                        texts[n, ".".join(p[: len(c) + 1])].add(i)
    return {(n, p, len(t)) for (n, p), t in texts.items()}


def test_drill_down(spark):
    docs = spark.createDataFrame(ROWS, "id long, tree array<string>, tag array<string>")
    dims = {"tree": F.col("tree"), "tag": F.col("tag")}
    for chosen in ({}, {"tree": "a"}, {"tree": "a.b"}, {"tree": "a", "tag": "x"}, {"tag": "none"}, {"tree": "a.b.c"}):
        got = {tuple(r) for r in X.drill_down(docs, "id", dims, chosen, None).collect()}
        assert got == by_hand(ROWS, {n: c.split(".") for n, c in chosen.items()}), chosen
    assert [tuple(r) for r in X.drill_down(docs, "id", dims, {"tree": "a"}, 1).orderBy("dim").collect()] == [("tag", "x", 3), ("tree", "a.b", 2)]
    assert [tuple(r) for r in X.drill_down(docs, "id", {"tag": F.col("tag")}, None, 1, by_value=True).collect()] == [("tag", "x", 4)]
    assert X.drill_down(docs.limit(0), "id", dims).collect() == []
    assert X.drill_down(docs, "id", dims)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def test_a_file_is_loaded_once(spark, tmp_path):
    files, table = tmp_path / "in", Loads(spark, str(tmp_path / "table"))
    files.mkdir()
    (files / "a b.txt").write_text("1\n2\n3\n")
    (files / "b.txt").write_text("4\n")
    read = lambda paths: spark.read.schema("v long").csv(paths)
    assert table.manifest().count() == 0 == table.rows("v long").count() and table.last_update() is None
    first = table.load(str(files), read, total=F.sum("v"))
    assert (first["files"], first["rows"], first["total"]) == (2, 4, 10)
    again = table.load(str(files), read)
    assert again == {"load": None, "files": 0, "rows": 0}
    (files / "copy.txt").write_text("4\n")  # known bytes
    (files / "empty.txt").write_text("")
    (files / "new.txt").write_text("7\n8\n")
    (files / "same.txt").write_text("7\n8\n")
    second = table.load(str(files), read, total=F.sum("v"))
    assert (second["files"], second["rows"], second["total"]) == (1, 2, 15)
    assert sorted(r["v"] for r in table.rows("v long").collect()) == [1, 2, 3, 4, 7, 8]
    assert {r["path"].rpartition("/")[2]: r["rows"] for r in table.manifest().collect()} == {"a b.txt": 3, "b.txt": 1, "new.txt": 2}
    spark.createDataFrame([(9, "x")], "v long, source_file string").write.parquet(f"{table.folder}/rows/broken")  # a load without a manifest
    assert table.rows("v long").count() == 6 and table.last_update() is not None
