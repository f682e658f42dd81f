from beliefmesh.operators import graphs
from beliefmesh.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_quotes_are_looked_up_in_the_documents_they_name(spark):
    docs = spark.createDataFrame([(1, "One  café\n here. Two."), (2, "Three."), (3, None)], "doc_id long, text string")
    cited = spark.createDataFrame([(1, "café here."), (2, "café here."), (1, " Two. "), (9, "Two."), (3, "Two."), (1, "two")], "doc_id long, quote string")
    got = sorted((r.doc_id, r.quote, r.found) for r in graphs.citations_found(cited, docs).collect())
    assert got == sorted([(1, "café here.", True), (2, "café here.", False), (1, " Two. ", True), (9, "Two.", None), (3, "Two.", None), (1, "two", False)])


def test_the_query_gives_found_and_absent_quotes(spark):
    got = catalogue.queries()["citation_in_document"](spark, SF).toPandas()
    by = {k: set(x.found) for k, x in got.groupby("kind")}
    assert by["own"] == {True} and by["altered"] == {False} and by["no document"] == {None} and False in by["benchmark"]
    assert len(got) == 604
