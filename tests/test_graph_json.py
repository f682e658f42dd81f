from pyspark.sql import functions as F

from beliefmesh.sources import graph_json

GOOD = '{"format":"own","version":1,"nodes":[{"id":"a","statement":"A \\"x\\"","base":0.3,"attributes":{"k":[1,2]}},{"id":"b","stated":{"alpha":8,"beta":2},"sources":[{"document":"d"}]}],"relations":[{"id":"r","type":"supports","source":"a","target":"b","strength":{"alpha":1,"beta":3}}]}'
BAD = '{"format":"own","version":1,"nodes":[{"id":"a","base":1.5},{"id":"a"}],"relations":[{"id":"r","type":"supports","source":"a","target":"z"}]}'


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_round_trip(spark):
    docs = spark.createDataFrame([("g", GOOD)], "graph_id string, text string")
    nodes, relations, errors = graph_json.load(docs, "own")
    assert errors.count() == 0
    assert rows(nodes, "ord", "id", "kind", F.col("base.p"), F.col("stated.alpha")) == [(0, "a", "proposition", 0.3, None), (1, "b", "proposition", None, 8.0)]
    again = graph_json.load(graph_json.dump(nodes, relations, "own"), "own")
    key = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert key(again[0]) == key(nodes) and key(again[1]) == key(relations) and again[2].count() == 0


def test_errors(spark):
    docs = spark.createDataFrame([("bad", BAD), ("cut", GOOD[:50]), ("none", None), ("empty", ""), ("old", GOOD.replace('"version":1', '"version":9')), ("nan", GOOD.replace("0.3", "NaN"))], "graph_id string, text string")
    errors = graph_json.load(docs)[2]
    assert rows(errors.where("graph_id = 'bad'"), "code", "item") == [("dangling", "r"), ("duplicate-nodes", "a"), ("invalid-base", "a")]
    assert {r[0] for r in rows(errors.where("code = 'malformed'"), "graph_id")} >= {"cut", "none", "empty"}
    assert rows(errors.where("graph_id = 'old'"), "code") == [("unsupported",)]
    assert errors.where("graph_id = 'nan'").count() >= 1


def test_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(GOOD)
    nodes, relations, _ = graph_json.load(graph_json.read(spark, str(tmp_path)))
    assert nodes.count() == 2 and relations.count() == 1 and nodes.first()["graph_id"].endswith("g.json")
