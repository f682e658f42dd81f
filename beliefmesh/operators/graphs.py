"""Constraints and structure of graphs held as node and relation tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beliefmesh.functions import text
from beliefmesh.operators.compiler import ACYCLIC, INFERENTIAL, by_graph, cycle

#: Folders written by this driver process and not released yet.
SCRATCH: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the executors share: cuts the lineage of iterations."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "/tmp/checkpoints/beliefmesh"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the folders that `written` has made, once what reads them is no longer needed."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    while SCRATCH:
        path = hadoop(SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def dangling_endpoints(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, relation, node: endpoints without a node."""
    ends = relations.select("graph_id", F.col("id").alias("relation"), F.explode(F.array("source", "target")).alias("node"))
    return ends.join(nodes.select("graph_id", F.col("id").alias("node")), ["graph_id", "node"], "left_anti").select("graph_id", "relation", "node").distinct()


def knots(edges: dict[str, list[tuple[str, str]]]) -> list[list[str]]:
    """The sets of nodes that reach each other, of two or more nodes or with a loop: two passes depth first, the second
    against the edges in the reverse order of the first's ends."""
    back: dict[str, list[str]] = {u: [] for u in edges}
    for u, out in edges.items():
        for _, v in out:
            back[v].append(u)
    order, seen = [], set()
    for start in edges:
        stack = [(start, iter(edges[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            u, rest = stack[-1]
            v = next((w for _, w in rest if w not in seen), None)
            if v is None:
                order.append(u)
                stack.pop()
            else:
                seen.add(v)
                stack.append((v, iter(edges[v])))
    out, placed = [], set()
    for start in reversed(order):
        own, stack = [], [start] if start not in placed else []
        placed.add(start)
        while stack:
            u = stack.pop()
            own.append(u)
            for v in back[u]:
                if v not in placed:
                    placed.add(v)
                    stack.append(v)
        if len(own) > 1 or own and any(v == start for _, v in edges[start]):
            out.append(own)
    return out


def cycles(relations: DataFrame) -> DataFrame:
    """graph_id, nodes, path: each set of nodes on common cycles of requires, supports, refutes and observes, and one of the
    cycles as node, relation, node, ..., back to the first. A graph's edges meet in one row (a graph is a document); there
    are no rounds."""
    kind = {k: v for k, v in relations.dtypes}
    edges = relations.where(F.col("type").isin(*ACYCLIC)).withColumn("id", F.col("id") if "id" in kind else F.concat_ws(">", "source", "target"))
    rows = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source").cast("string").alias("u"), F.col("id").cast("string").alias("r"), F.col("target").cast("string").alias("v")))).alias("e"))

    def run(row: dict) -> list[dict]:
        out: dict[str, list[tuple[str, str]]] = {}
        for x in row["e"]:
            out.setdefault(x["u"], []).append((x["r"], x["v"]))
            out.setdefault(x["v"], [])
        found = []
        for own in knots(out):
            inside = set(own)
            path = cycle({u: [(r, v) for r, v in out[u] if v in inside] for u in own})
            found.append({"nodes": sorted(own), "path": path})
        return found

    return by_graph(rows, lambda batch: map(run, batch), "nodes array<string>, path array<string>")


def cycle_nodes(relations: DataFrame) -> DataFrame:
    """graph_id, node: the nodes that lie on a cycle, not those between two."""
    kind = dict(relations.dtypes)["source"]
    return cycles(relations).select("graph_id", F.explode("nodes").alias("node")).withColumn("node", F.col("node").cast(kind))


def components(links: DataFrame) -> DataFrame:
    """node, root for links(a, b), with graph_id where links have it: the smallest node that can be reached within the graph,
    roots left out; large-star and small-star."""
    own = ["graph_id"] if "graph_id" in links.columns else []
    edges, mark = written(links.where("a != b").select(*own, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash(*own, "u", "v").cast("long"))).first())
        if now == mark or not now[0]:
            return edges.select(*own, F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = edges.select(*own, F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(*own, "v", "u"))
        least = both.groupBy(*own, "x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, [*own, "x"]).select(*own, F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*own, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*own, "u"]).where("v != m").select(*own, F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(*own, "u", F.col("m").alias("v")))
        edges = written(small.distinct())


def numbered(df: DataFrame, group: str, key: str, out: str, slices: int = 256) -> DataFrame:
    """Add the 1-based place of each row in its group, by ascending key (a number). A group may hold most rows: it is cut at
    quantiles of the key, ranked within a cut, and a small table of counts gives each cut its first place. Rows of equal
    keys come in any order; null keys come first."""
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = sorted(set(df.select(F.percentile_approx(key, shares, F.lit(20 * slices)).alias("b")).first()["b"] or []))
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    dealt = df.withColumn("__s", F.when(F.col(key).isNull(), -1).otherwise(cut))
    counts = dealt.groupBy(F.col(group).alias("__g"), F.col("__s").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    local = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__s").orderBy(F.col(key).asc_nulls_first())))
    joined = local.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__s") == F.col("__c")))
    return joined.withColumn(out, F.col("__r") + F.col("__first")).drop("__s", "__g", "__c", "__n", "__first", "__r")


def correlated_support(supports: DataFrame, least: int = 2) -> DataFrame:
    """graph_id, target, source, supports: supports of one target that share a provenance."""
    return supports.groupBy("graph_id", "target", "source").agg(F.count(F.lit(1)).alias("supports")).where(F.col("supports") >= least)


def missing_parameters(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, what (base or strength), id."""
    observed = relations.where("type = 'observes'").select("graph_id", F.col("target").alias("id"))
    bare = nodes.where("base is null").join(observed, ["graph_id", "id"], "left_anti").select("graph_id", F.lit("base").alias("what"), "id")
    weak = relations.where(F.col("type").isin("requires", "supports", "refutes") & F.col("strength").isNull()).select("graph_id", F.lit("strength").alias("what"), "id")
    return bare.unionByName(weak)


def unanchored(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes without a source and without a relation into them."""
    into = relations.where(F.col("type").isin(*ACYCLIC)).select("graph_id", F.col("target").alias("id"))
    return nodes.where("source is null").join(into, ["graph_id", "id"], "left_anti").select("graph_id", "id")


def dependencies(relations: DataFrame, targets: DataFrame) -> DataFrame:
    """graph_id, target, relation: what each target(graph_id, target) rests on, by semi-naive fixpoint."""
    step = relations.where(F.col("type").isin(*INFERENTIAL)).select("graph_id", F.col("id").alias("relation"), F.col("source").alias("from"), F.col("target").alias("to"))
    front = written(targets.select("graph_id", "target", F.col("target").alias("node")).distinct())
    seen, found = front, None
    while True:
        used = front.join(step, (front["graph_id"] == step["graph_id"]) & (front["node"] == step["to"])).select(front["graph_id"], "target", "relation", F.col("from").alias("node"))
        used = written(used.distinct())
        found = used.drop("node") if found is None else written(found.union(used.drop("node")).distinct())
        front = written(used.select("graph_id", "target", "node").distinct().join(seen, ["graph_id", "target", "node"], "left_anti"))
        if front.isEmpty():
            return found.distinct()
        seen = written(seen.unionByName(front))


def citations_found(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations (doc_id, quote and others) with found: whether the normalised quote is in the normalised text of the
    document it names; null if there is no such document or text, as it can't be checked then."""
    texts = documents.select("doc_id", text.normalise_text(F.col("text")).alias("__text"))
    return citations.withColumn("__quote", text.normalise_text(F.col("quote"))).join(texts, "doc_id", "left").withColumn("found", F.contains("__text", "__quote")).drop("__text", "__quote")
