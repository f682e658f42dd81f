"""Chunks of documents, and the graphs of document nodes built from them.

Chunks are rows: document, ord, unit, text, locator, cites, labels, key. `chunk_graph` numbers them by document, anchors each
by its own text, and links each citation to the first entry with its key; all of it is built-in expressions but for the
normal form of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beliefmesh.functions import text
from beliefmesh.operators.compiler import ANCHORS, NODE, RELATION, canonical

# fixed values: the units of chunks, with the prefix of their ids
PREFIXES = {"sentence": "s", "footnote": "s", "caption": "s", "equation": "e", "reference": "r"}
CHUNK = "ord long, unit string, text string, locator string, cites array<string>, labels array<string>, key string"


def chunk_id(prefix: Column, number: Column, total: Column) -> Column:
    """`s-07`: the number as wide as the last one."""
    return F.concat(prefix, F.lit("-"), F.lpad(number.cast("string"), F.length(total.cast("string")), F.lit("0")))


def chunk_graph(chunks: DataFrame, initial: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and relations, graph_id being the document, and unresolved(graph_id, key, ord): keys that no entry has, with the
    place of their first citation. initial: the type that a unit's chunks start with; others are `unassigned`."""
    prefixes = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    types = F.create_map(*[F.lit(x) for kv in (initial or {"": ""}).items() for x in kv])
    own = Window.partitionBy("graph_id", "prefix")
    d = chunks.select(F.col("document").alias("graph_id"), "ord", "unit", text.normalise_text(F.col("text")).alias("statement"), "locator", "cites", "labels", "key").withColumn("prefix", prefixes[F.col("unit")])
    d = d.withColumns({"number": F.row_number().over(own.orderBy("ord")), "total": F.count(F.lit(1)).over(own)})
    d = d.withColumn("id", chunk_id(F.col("prefix"), F.col("number"), F.col("total")))
    label = F.when(F.size("labels") > 1, F.to_json("labels")).when(F.size("labels") == 1, F.expr("substring(to_json(labels), 2, length(to_json(labels)) - 2)"))
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    fields = F.concat_ws(",", F.lit('"origin":"document"'), F.concat(F.lit('"unit":'), quoted("unit")), F.concat(F.lit('"label":'), label), F.concat(F.lit('"key":'), quoted("key")))
    anchor = F.array(F.struct(F.col("graph_id").alias("document"), "locator", F.col("statement").alias("quote"), F.concat(F.lit("sha256:"), F.sha2("statement", 256)).alias("digest"))).cast(ANCHORS)
    nodes = d.select("graph_id", "ord", "id", F.coalesce(types[F.col("unit")], F.lit("unassigned")).alias("kind"), "statement", anchor.alias("sources"), F.concat(F.lit("{"), fields, F.lit("}")).alias("attributes"))
    entries = d.where("key is not null").groupBy("graph_id", "key").agg(F.min_by("id", "ord").alias("entry"))
    cited = d.select("graph_id", "ord", F.col("id").alias("source"), F.posexplode("cites").alias("place", "key"))
    met = cited.join(entries, ["graph_id", "key"], "left")
    links = met.where("entry is not null").groupBy("graph_id", "source", "entry").agg(F.min(F.struct("ord", "place")).alias("at"))
    order = Window.partitionBy("graph_id").orderBy("at.ord", "at.place")
    relations = links.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), F.concat_ws("-", "source", F.lit("cites"), "entry").alias("id"), F.lit("cites").alias("type"), "source", F.col("entry").alias("target"))
    unresolved = met.where("entry is null").groupBy("graph_id", "key").agg(F.min("ord").alias("ord"))
    return canonical(nodes, NODE), canonical(relations, RELATION), unresolved
