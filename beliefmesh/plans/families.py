"""Graph families derived from the driver's tables: one graph per order, conversation, user, language, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, k, type, p (base), s (strength): each line item is a premise of its order's claim."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.expr("case l_returnflag when 'A' then 'requires' when 'N' then 'supports' else 'refutes' end")
    return line.select(F.col("l_orderkey").alias("graph_id"), F.row_number().over(order).alias("k"), kind.alias("type"), (F.col("l_quantity").cast("double") / 51).alias("p"), (F.col("l_discount").cast("double") * 8).alias("s"), F.col("l_linenumber").alias("ln"))


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, b: the claim's base by priority."""
    base = F.expr("case substring(o_orderpriority, 1, 1) when '1' then 0.5D when '2' then 0.4D when '3' then 0.3D when '4' then 0.2D else 0.1D end")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), base.alias("b"))


def order_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, b, ps: a row per order that has premises, ps in the order of k."""
    premises = order_premises(spark, sf_dir).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("k", "type", "p", "s", "ln"))).alias("ps"))
    return premises.join(order_claims(spark, sf_dir), "graph_id")


def order_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars as networks (see operators.inference): variable 0..n-1 the premises, n the claim."""
    return order_stars(spark, sf_dir).select("graph_id", F.expr("""concat(
        transform(ps, x -> named_struct('name', concat('p', x.k), 'base', x.p, 'links', cast(array() as array<struct<parent:int,type:string,a:double,b:double>>))),
        array(named_struct('name', 'claim', 'base', b, 'links', transform(ps, (x, i) -> named_struct('parent', i, 'type', x.type, 'a', x.s, 'b', 0D)))))""").alias("vars"))


def order_beta_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stars as networks whose strengths are Betas of alpha 1 + l_linenumber and beta 2; bases are points."""
    return order_stars(spark, sf_dir).select("graph_id", F.expr("""concat(
        transform(ps, x -> named_struct('name', concat('p', x.k), 'base', x.p, 'links', cast(array() as array<struct<parent:int,type:string,a:double,b:double,a_beta:struct<alpha:double,beta:double>>>))),
        array(named_struct('name', 'claim', 'base', b, 'links', transform(ps, (x, i) -> named_struct('parent', i, 'type', x.type, 'a', x.s, 'b', 0D, 'a_beta', named_struct('alpha', 1D + x.ln, 'beta', 2D))))))""").alias("vars"))


def order_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as node and relation tables: premises p1, p2, ... under `claim`, which is stated at 0.5. Strengths are ten
    times the discount, so that some are exactly 0 or 1; premises of even suppliers name a document."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.expr("case l_returnflag when 'A' then 'requires' when 'N' then 'supports' else 'refutes' end")
    k = F.row_number().over(order)
    doc = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("d"), F.col("l_partkey") % 3))
    rows = line.select(F.col("l_orderkey").alias("graph_id"), k.alias("k"), kind.alias("type"), (F.col("l_quantity").cast("double") / 51).alias("p"), (F.col("l_discount").cast("double") * 10).alias("s"), doc.alias("doc"))
    anchor = "named_struct('document', doc, 'locator', cast(null as string), 'quote', cast(null as string), 'digest', cast(null as string))"
    premises = rows.select("graph_id", F.col("k").cast("long").alias("ord"), F.concat(F.lit("p"), "k").alias("id"), F.col("p").alias("base"), F.lit(None).cast("double").alias("stated"), F.expr(f"if(doc is null, cast(array() as array<struct<document:string,locator:string,quote:string,digest:string>>), array({anchor}))").alias("sources"))
    claims = order_claims(spark, sf_dir).join(rows.select("graph_id").distinct(), "graph_id", "left_semi")
    claims = claims.select("graph_id", F.lit(0).cast("long").alias("ord"), F.lit("claim").alias("id"), F.col("b").alias("base"), F.lit(0.5).alias("stated"), F.lit(None).cast(premises.schema["sources"].dataType).alias("sources"))
    relations = rows.select("graph_id", F.col("k").cast("long").alias("ord"), F.concat(F.lit("r"), "k").alias("id"), "type", F.concat(F.lit("p"), "k").alias("source"), F.lit("claim").alias("target"), F.col("s").alias("strength"))
    return claims.unionByName(premises), relations
