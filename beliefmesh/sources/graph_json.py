"""Graphs as JSON documents: one document is one graph, with nodes before relations, both in document order.

`load` turns documents into node and relation tables and a table of errors, so that one bad document doesn't stop the
others; `dump` is its inverse. A credence is a number in [0, 1] or an object of alpha and beta, both positive and
finite. All of it is built-in expressions; documents are parsed once, into a table in the shared folder, and the checks of
ids shuffle ids only. `load_strict` also applies the rules for writing, and leaves out the graphs that break any.

Defined cases: a text that isn't such a document gives no nodes and one error; a null text likewise; a missing kind is
`proposition`; a field that the format doesn't have is an error (`unknown-field`, with its place) and isn't read; attributes
and obligations are kept as JSON text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefmesh.operators import graphs, rules

VERSION = 1
ANCHOR = "struct<document:string,locator:string,quote:string,digest:string>"
NODE = f"struct<id:string,kind:string,statement:string,sources:array<{ANCHOR}>,base:string,stated:string,attributes:string>"
RELATION = "struct<id:string,type:string,source:string,target:string,strength:string,sensitivity:string,false_pass:string,attributes:string,obligation:string>"
DOCUMENT = f"struct<format:string,version:string,nodes:array<{NODE}>,relations:array<{RELATION}>>"
CREDENCES = {"nodes": ("base", "stated"), "relations": ("strength", "sensitivity", "false_pass")}


def credence_of(text: Column) -> Column:
    """Struct (p, alpha, beta) of a JSON credence; null if it isn't one or out of range."""
    p = text.try_cast("double")
    both = F.from_json(text, "alpha double, beta double", {"allowNonNumericNumbers": "false"})
    null = F.lit(None).cast("double")
    fits = [(both[k] > 0) & (both[k] < float("inf")) for k in ("alpha", "beta")]
    point = F.struct(p.alias("p"), null.alias("alpha"), null.alias("beta"))
    return F.when((p >= 0) & (p <= 1), point).when(fits[0] & fits[1], F.struct(null.alias("p"), both["alpha"].alias("alpha"), both["beta"].alias("beta")))


def json_of(credence: Column) -> Column:
    """JSON text of a credence struct; null stays null."""
    beta = F.to_json(F.struct(credence["alpha"].alias("alpha"), credence["beta"].alias("beta")))
    return F.when(credence["p"].isNotNull(), credence["p"].cast("string")).when(credence["alpha"].isNotNull(), beta)


def read(spark: SparkSession, path: str) -> DataFrame:
    """graph_id (the file's path), text of every file under path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("graph_id"), F.col("value").alias("text"))


FIELDS = {
    "document": ["format", "version", "nodes", "relations"],
    "nodes": ["id", "kind", "statement", "sources", "base", "stated", "attributes"],
    "relations": ["id", "type", "source", "target", "strength", "sensitivity", "false_pass", "attributes", "obligation"],
    "sources": ["document", "locator", "quote", "digest"],
    "credence": ["alpha", "beta"],
}


def extra(raw: Column, what: str) -> Column:
    """Keys of a JSON object that the format doesn't have; empty for what is no object."""
    return F.coalesce(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, FIELDS[what]))), F.array().cast("array<string>"))


def unknown_fields(what: str, raw: Column) -> Column:
    """Places of unknown fields in the JSON of a node or relation."""
    parts = [extra(raw, what)]
    parts += [nested(raw, c) for c in CREDENCES[what]]
    if what == "nodes":
        anchors = F.from_json(F.get_json_object(raw, "$.sources"), "array<string>")
        parts.append(F.coalesce(F.flatten(F.transform(anchors, lambda a: F.transform(extra(a, "sources"), lambda k: F.concat(F.lit("sources."), k)))), F.array().cast("array<string>")))
    return F.concat(*parts)


def nested(raw: Column, field: str) -> Column:
    return F.transform(extra(F.get_json_object(raw, f"$.{field}"), "credence"), lambda k: F.concat(F.lit(f"{field}."), k))


def listed(rows: Column, what: str) -> Column:
    return F.transform(rows, lambda x, i: F.transform(unknown_fields(what, x), lambda k: F.concat(F.lit(f"{what}["), i.cast("string"), F.lit("]."), k)))


def load(documents: DataFrame, name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, relations and errors (graph_id, code, item) of documents(graph_id, text). name: the format's name, if it
    is to be checked."""
    strict = {"allowNonNumericNumbers": "false"}
    raw = F.from_json("text", "nodes array<string>, relations array<string>", strict)
    places = [F.transform(extra(F.col("text"), "document"), lambda k: F.concat(F.lit("document."), k))]
    for what in CREDENCES:
        places.append(F.coalesce(F.flatten(listed(raw[what], what)), F.array().cast("array<string>")))
    parsed = graphs.written(documents.select("graph_id", F.from_json("text", DOCUMENT, strict).alias("d"), F.concat(*places).alias("unknown")))
    tables, errors = {}, [parsed.select("graph_id", F.lit("unknown-field").alias("code"), F.explode("unknown").alias("item"))]
    whole = F.col("d.nodes").isNotNull() & F.col("d.relations").isNotNull()
    known = F.coalesce((F.col("d.version") == str(VERSION)) & (F.lit(True) if name is None else F.col("d.format") == name), F.lit(False))
    errors.append(parsed.where(~F.coalesce(whole, F.lit(False))).select("graph_id", F.lit("malformed").alias("code"), F.lit("document").alias("item")))
    errors.append(parsed.where(whole & ~known).select("graph_id", F.lit("unsupported").alias("code"), F.lit("document").alias("item")))
    for what, fields in CREDENCES.items():
        rows = parsed.where(whole & known).select("graph_id", F.posexplode(f"d.{what}").alias("ord", "x"))
        flat = rows.select("graph_id", F.col("ord").cast("long").alias("ord"), "x.*")
        for c in fields:
            errors.append(flat.where(F.col(c).isNotNull() & credence_of(F.col(c)).isNull()).select("graph_id", F.lit(f"invalid-{c}").alias("code"), F.col("id").alias("item")))
        tables[what] = flat.withColumns({c: credence_of(F.col(c)) for c in fields})
        errors.append(flat.where("id is null or id = ''").select("graph_id", F.lit("missing-id").alias("code"), F.lit(what).alias("item")))
        errors.append(graphs.duplicate_ids(flat.where("id is not null")).select("graph_id", F.lit(f"duplicate-{what}").alias("code"), F.col("id").alias("item")))
    nodes = tables["nodes"].withColumn("kind", F.coalesce("kind", F.lit("proposition")))
    loose = graphs.dangling_endpoints(nodes, tables["relations"])
    errors.append(loose.select("graph_id", F.lit("dangling").alias("code"), F.col("relation").alias("item")).distinct())
    found = errors[0]
    for e in errors[1:]:
        found = found.unionByName(e)
    return nodes, tables["relations"], found


def load_strict(documents: DataFrame, name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As load, with the rules for writing applied to every node and relation: a graph with any error is left out of the
    nodes and relations, as a whole."""
    nodes, relations, errors = load(documents, name)
    found = graphs.written(errors.unionByName(rules.violations(nodes, relations).select("graph_id", "code", "item")).distinct())
    bad = found.select("graph_id").distinct()
    return nodes.join(bad, "graph_id", "left_anti"), relations.join(bad, "graph_id", "left_anti"), found


def json_schema(name: str) -> dict:
    """The format as a JSON Schema (2020-12). Rules between rows (unique ids, ends that exist, no cycles) are load's."""
    text, probability = {"type": "string", "minLength": 1}, {"type": "number", "minimum": 0, "maximum": 1}
    credence = {"oneOf": [probability, {"type": "object", "properties": {k: {"type": "number", "exclusiveMinimum": 0} for k in FIELDS["credence"]}, "required": FIELDS["credence"], "additionalProperties": False}]}
    maybe = lambda x: {"oneOf": [x, {"type": "null"}]}
    closed = lambda properties, required: {"type": "object", "properties": properties, "required": required, "additionalProperties": False}
    anchor = closed({k: text if k == "document" else maybe(text) for k in FIELDS["sources"]}, ["document"])
    field = {"id": text, "kind": text, "type": text, "source": text, "target": text, "statement": maybe(text), "sources": {"type": "array", "items": anchor}, "attributes": {"type": "object"}}
    kinds = {
        kind: closed({"kind": {"const": kind}, **{k: {"theorem": text, "script": {"type": "string", "pattern": r"\.py$"}, "digest": {"type": "string", "pattern": "^sha256:[0-9a-f]{64}$"}, "status": {"type": "integer"}, "value": {"type": "number"}, "tolerance": {"type": "number", "exclusiveMinimum": 0}, "anchor": anchor}[k] for k in [*needed, *more]}}, ["kind", *needed])
        for kind, (needed, more) in rules.DISCHARGES.items()
    }
    field["obligation"] = maybe(closed({"statement": text, "discharge": {"oneOf": [{"type": "null"}, *kinds.values()]}}, ["statement"]))
    of = lambda what, required: {"type": "array", "items": closed({k: field.get(k, maybe(credence)) for k in FIELDS[what]}, required)}
    whole = {"format": {"const": name}, "version": {"const": VERSION}, "nodes": of("nodes", ["id"]), "relations": of("relations", ["id", "type", "source", "target"])}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **closed(whole, FIELDS["document"])}


def write(nodes: DataFrame, relations: DataFrame, name: str, path: str) -> None:
    """Write each graph as a document under path, in one step: a folder beside it takes the files first, so that a failure
    leaves what was there."""
    spark = nodes.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    staging, final = hadoop(f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"), hadoop(path)
    fs = final.getFileSystem(conf)
    try:
        dump(nodes, relations, name).select(F.regexp_replace("text", r"\n$", "").alias("value")).write.text(staging.toString())
    except Exception:
        fs.delete(staging, True)
        raise
    fs.delete(final, True)
    if not fs.rename(staging, final):
        raise OSError(f"can't rename to {path}")


def dump(nodes: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """graph_id, text: the documents of nodes and relations as `load` gives them. A graph is one row, as it is one
    document; absent fields are left out."""
    parts = []
    for what, df in (("nodes", nodes), ("relations", relations)):
        raw = lambda c: F.parse_json(json_of(F.col(c)) if c in CREDENCES[what] else F.col(c)).alias(c)  # noqa: B023, E731
        fields = [raw(c) if c in (*CREDENCES[what], "attributes", "obligation") else F.col(c) for c in df.columns if c not in ("graph_id", "ord")]
        each = df.select("graph_id", F.struct("ord", F.to_json(F.struct(*fields)).alias("json")).alias("x"))
        parts.append(each.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["json"]), ",").alias(what)))
    head = F.concat(F.lit('{"format":'), F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(name)))) - 2), F.lit(f',"version":{VERSION},"nodes":['))
    both = parts[0].join(parts[1], "graph_id", "full")
    return both.select("graph_id", F.concat(head, F.coalesce("nodes", F.lit("")), F.lit('],"relations":['), F.coalesce("relations", F.lit("")), F.lit("]}\n")).alias("text"))
