"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefmesh.functions import credence, text
from beliefmesh.operators import graphs, inference
from beliefmesh.plans import families
from beliefmesh.plans.families import table
from beliefmesh.plans.registry import QUERIES, SQL, query, r6
from beliefmesh.sources import graph_json

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# family F1: orders

STAR = """prem AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k,
  CASE l_returnflag WHEN 'A' THEN 'requires' WHEN 'N' THEN 'supports' ELSE 'refutes' END AS type,
  CAST(l_quantity AS DOUBLE) / 51 AS p, CAST(l_discount AS DOUBLE) * 8 AS s, l_linenumber AS ln FROM lineitem),
claim AS (SELECT o_orderkey AS g, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.5::DOUBLE WHEN '2' THEN 0.4::DOUBLE WHEN '3' THEN 0.3::DOUBLE WHEN '4' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS b FROM orders)"""


def gate(p: str = "p", s: str = "s") -> str:
    """SQL: P(claim) from premises grouped by claim."""
    n, o, i = (f"coalesce(product(CASE WHEN type = '{t}' THEN {f} END), 1)" for t, f in (("requires", f"1 - {s} * (1 - {p})"), ("supports", f"1 - {s} * {p}"), ("refutes", f"1 - {s} * {p}")))
    return f"{n} * (b * {o} + (1 - {o})) * {i}"


MARGINAL = f"WITH {STAR} SELECT g AS graph_id, round({gate()}, 6) AS p_claim FROM prem JOIN claim USING (g) GROUP BY g, b"


@query(MARGINAL)
def marginal_closed(spark, sf_dir):
    return families.order_stars(spark, sf_dir).select("graph_id", r6(inference.star_probability()).alias("p_claim"))


@query(MARGINAL)
def marginal_enumerated_all(spark, sf_dir):
    """The operator's own limit of variables alone decides: an order beyond it has a null."""
    got = inference.enumerate_worlds(families.order_networks(spark, sf_dir), "map('claim', true)")
    return got.select("graph_id", r6("answer").alias("p_claim"))


@query(MARGINAL)
def marginal_eliminated(spark, sf_dir):
    return inference.eliminate(families.order_networks(spark, sf_dir), {"claim": True}).select("graph_id", r6("answer").alias("p_claim"))


@query(f"WITH {STAR} SELECT g AS graph_id, round(product(p) * {gate('1')}, 6) AS p_joint FROM prem JOIN claim USING (g) GROUP BY g, b")
def joint_all_true(spark, sf_dir):
    sure = inference.star_probability("x.k", "1D")
    return families.order_stars(spark, sf_dir).select("graph_id", r6(f"aggregate(ps, 1D, (a, x) -> a * x.p) * ({sure})").alias("p_joint"))


@query(f"WITH {STAR} SELECT g AS graph_id, round(any_value(p1) * ({gate('CASE WHEN k = 1 THEN 1 ELSE p END')}) / nullif({gate()}, 0), 6) AS p_premise FROM (SELECT *, first_value(p) OVER (PARTITION BY g ORDER BY k) AS p1 FROM prem) JOIN claim USING (g) GROUP BY g, b")
def conditional_premise_given_claim(spark, sf_dir):
    return families.order_stars(spark, sf_dir).select("graph_id", r6(f"ps[0].p * ({inference.star_probability('1', '1D')}) / nullif({inference.star_probability()}, 0D)").alias("p_premise"))


@query(SQL["conditional_premise_given_claim"])
def conditional_enumerated_all(spark, sf_dir):
    """The operator's own limit of variables alone decides: an order beyond it has a null."""
    got = inference.enumerate_worlds(families.order_networks(spark, sf_dir), "map('p1', true)", "map('claim', true)")
    return got.select("graph_id", r6("answer").alias("p_premise"))


@query(f"WITH {STAR} SELECT g AS graph_id, round({gate('CASE WHEN k = 1 THEN 0 ELSE p END')}, 6) AS p_claim FROM prem JOIN claim USING (g) GROUP BY g, b")
def intervene_premise_false(spark, sf_dir):
    return inference.eliminate(families.order_networks(spark, sf_dir), {"claim": True}, do={"p1": False}).select("graph_id", r6("answer").alias("p_claim"))


EACH = f"WITH {STAR}, each AS (SELECT a.g, a.k AS kk, a.p AS own_p, a.s AS own_s, x.k, x.type, x.p, x.s, b FROM prem a JOIN prem x USING (g) JOIN claim USING (g))"


def per_premise(spark, sf_dir) -> DataFrame:
    return families.order_stars(spark, sf_dir).withColumn("own", F.explode("ps")).select("graph_id", "b", "ps", "own", F.col("own.k").alias("k"))


@query(f"{EACH} SELECT g AS graph_id, kk AS k, round({gate(s='CASE WHEN k = kk THEN 1 ELSE s END')} - {gate(s='CASE WHEN k = kk THEN 0 ELSE s END')}, 6) AS slope FROM each GROUP BY g, kk, b")
def derivative_strength(spark, sf_dir):
    one, zero = inference.star_probability("own.k", s="1D"), inference.star_probability("own.k", s="0D")
    return per_premise(spark, sf_dir).select("graph_id", F.col("k").cast("long").alias("k"), r6(f"{one} - {zero}").alias("slope"))


@query(f"{EACH} SELECT g AS graph_id, kk AS k, round({gate('CASE WHEN k = kk THEN 1 ELSE p END')} - {gate('CASE WHEN k = kk THEN 0 ELSE p END')}, 6) AS slope FROM each GROUP BY g, kk, b")
def derivative_base(spark, sf_dir):
    one, zero = inference.star_probability("own.k", "1D"), inference.star_probability("own.k", "0D")
    return per_premise(spark, sf_dir).select("graph_id", F.col("k").cast("long").alias("k"), r6(f"{one} - {zero}").alias("slope"))


FAIL = f"SELECT g, kk, {gate('CASE WHEN k = kk THEN 0 ELSE p END')} AS failed, {gate()} AS base FROM each GROUP BY g, kk, b"


@query(f"{EACH}, t AS ({FAIL}) SELECT g AS graph_id, kk AS k, round(failed, 6) AS p_if_false, round(failed / base, 6) AS ratio FROM t WHERE base > 0")
def failure_impact(spark, sf_dir):
    p = per_premise(spark, sf_dir).select("graph_id", "k", F.expr(inference.star_probability("own.k", "0D")).alias("failed"), F.expr(inference.star_probability()).alias("base"))
    return p.where("base > 0").select("graph_id", F.col("k").cast("long").alias("k"), r6("failed").alias("p_if_false"), r6("failed / base").alias("ratio"))


def bits(w: str, p: str, q: str) -> str:
    return f"CASE WHEN {w} > 0 AND {p} > 0 THEN {w} * {p} * log2({p} / {q}) ELSE 0 END"


@query(f"{EACH}, t AS (SELECT g, kk, any_value(own_p) AS y, {gate('CASE WHEN k = kk THEN 1 ELSE p END')} AS t1, {gate('CASE WHEN k = kk THEN 0 ELSE p END')} AS t0 FROM each GROUP BY g, kk, b), u AS (SELECT *, y * t1 + (1 - y) * t0 AS t FROM t) SELECT g AS graph_id, kk AS k, round(greatest(0, {bits('y', 't1', 't')} + {bits('y', '(1 - t1)', '(1 - t)')} + {bits('(1 - y)', 't0', 't')} + {bits('(1 - y)', '(1 - t0)', '(1 - t)')}), 6) AS bits FROM u")
def value_of_information(spark, sf_dir):
    p = per_premise(spark, sf_dir).select("graph_id", "k", F.col("own.p").alias("y"), F.expr(inference.star_probability("own.k", "1D")).alias("t1"), F.expr(inference.star_probability("own.k", "0D")).alias("t0"))
    return p.select("graph_id", F.col("k").cast("long").alias("k"), r6(credence.mutual_information(F.col("t1"), F.col("t0"), F.col("y"))).alias("bits"))


@query(f"WITH {STAR}, t AS (SELECT g, {gate()} AS p FROM prem JOIN claim USING (g) GROUP BY g, b) SELECT g AS graph_id, round(0.5 - p, 6) AS gap, CASE WHEN ln(1.0) - ln(p / (1 - p)) > 0 THEN 'overclaim' ELSE 'underclaim' END AS diagnostic FROM t WHERE p > 0 AND p < 1 AND abs(ln(p / (1 - p))) > 2 * ln(11 / 9::DOUBLE)")
def claims_gap(spark, sf_dir):
    p = families.order_stars(spark, sf_dir).select("graph_id", F.expr(inference.star_probability()).alias("p")).where("p > 0 and p < 1")
    gap = credence.logit_gap(F.lit(0.5), F.col("p"))
    return p.where(F.abs(gap) > F.expr("2 * ln(11D / 9D)")).select("graph_id", r6("0.5D - p").alias("gap"), F.when(gap > 0, "overclaim").otherwise("underclaim").alias("diagnostic"))


@query("SELECT l_linenumber AS alpha, round((1 + l_linenumber) / (3.0::DOUBLE + l_linenumber), 6) AS mean, round(((1 + l_linenumber) / (3.0::DOUBLE + l_linenumber)) * (2 / (3.0::DOUBLE + l_linenumber)) / (4.0::DOUBLE + l_linenumber), 6) AS variance, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def beta_moments(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("alpha")).agg(F.count(F.lit(1)).alias("n"))
    a, b = F.col("alpha") + F.lit(1.0), F.lit(2.0)
    return g.select("alpha", r6(credence.beta_mean(a, b)).alias("mean"), r6(credence.beta_variance(a, b)).alias("variance"), "n")


CRUX = """sqrt((1 + ln) / (3.0::DOUBLE + ln) * (2 / (3.0::DOUBLE + ln)) / (4.0::DOUBLE + ln))"""


@query(f"WITH {STAR}, each AS (SELECT a.g, a.k AS kk, a.ln, x.k, x.type, x.p, x.s, b FROM prem a JOIN prem x USING (g) JOIN claim USING (g)), t AS (SELECT g, kk, {CRUX} * abs({gate(s='CASE WHEN k = kk THEN 1 ELSE s END')} - {gate(s='CASE WHEN k = kk THEN 0 ELSE s END')}) AS v FROM each GROUP BY g, kk, b, ln) SELECT g AS graph_id, round(max(v), 6) AS value FROM t GROUP BY g")
def crux_rank(spark, sf_dir):
    one, zero = inference.star_probability("own.k", s="1D"), inference.star_probability("own.k", s="0D")
    a = F.col("own.ln") + F.lit(1.0)
    v = per_premise(spark, sf_dir).select("graph_id", (F.abs(F.expr(f"{one} - {zero}")) * F.sqrt(credence.beta_variance(a, F.lit(2.0)))).alias("v"))
    return v.groupBy("graph_id").agg(r6(F.max("v")).alias("value"))


HEAVY_ALL = """two AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p DESC, k) AS h FROM prem QUALIFY count(*) OVER (PARTITION BY g) >= 2)"""


PAIR = f"cases(v1, v2) AS (VALUES (0, 0), (0, 1), (1, 0)), c AS (SELECT g, v1, v2, any_value(CASE WHEN h = 1 THEN p END) AS x1, max(CASE WHEN h = 1 THEN p END) AS p1, max(CASE WHEN h = 2 THEN p END) AS p2, {gate('CASE h WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE p END')} AS pc FROM two JOIN claim USING (g), cases GROUP BY g, b, v1, v2), w AS (SELECT *, (CASE v1 WHEN 1 THEN p1 ELSE 1 - p1 END) * (CASE v2 WHEN 1 THEN p2 ELSE 1 - p2 END) AS wt FROM c) SELECT g AS graph_id, round(sum(wt * pc) / sum(wt), 6) AS p_claim FROM w GROUP BY g"


def tied_pair(nets: DataFrame) -> DataFrame:
    ranked = "array_sort(transform(slice(vars, 1, size(vars) - 1), (v, i) -> named_struct('neg', -v.base, 'i', i)))"
    link = lambda n: f"named_struct('parent', {ranked}[{n}].i, 'type', 'exclusive', 'a', 0D, 'b', 0D)"
    tied = nets.withColumn("vars", F.expr(f"concat(vars, array(named_struct('name', 'only-one', 'base', 0D, 'links', array({link(0)}, {link(1)}))))"))
    return inference.eliminate(tied, {"claim": True}).select("graph_id", r6("answer").alias("p_claim"))


@query(f"WITH {STAR}, {HEAVY_ALL}, {PAIR}")
def exclusive_pair_all(spark, sf_dir):
    return tied_pair(families.order_networks(spark, sf_dir).where("size(vars) >= 3"))


@query()
def bands(spark, sf_dir):
    return inference.bands(families.order_beta_networks(spark, sf_dir), {"claim": True})


# families F2 to F4


@query("""SELECT s_suppkey, round((1 + s_suppkey % 8) / 10.0::DOUBLE * (1 - 0.5 * (1 - 0.95::DOUBLE * (1 - 0.8 * (1 - (0.5 + 0.1 * n_regionkey)))))::DOUBLE, 6) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def tree_marginal(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    region = F.lit(0.5) + F.lit(0.1) * F.col("n_regionkey")
    nation = F.lit(0.95) * (1 - F.lit(0.8) * (1 - region))
    return s.select("s_suppkey", r6((1 + F.col("s_suppkey") % 8) / F.lit(10.0) * (1 - F.lit(0.5) * (1 - nation))).alias("p"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS p FROM conversations WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, (CASE c.role WHEN 'assistant' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) * (1 - 0.6::DOUBLE * (1 - r.p)) FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
SELECT conv_id, round(arg_max(p, turn), 6) AS p_last FROM r GROUP BY conv_id""")
def chain_marginal(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    p = "aggregate(t, cast(null as double), (q, x) -> if(x.role = 'assistant', 0.9D, 0.7D) * if(q is null, 1D, 1 - 0.6D * (1 - q)))"
    return c.select("conv_id", r6(p).alias("p_last"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, 1::DOUBLE AS t, 0::DOUBLE AS f, CASE role WHEN 'assistant' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS p0 FROM conversations WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, (CASE c.role WHEN 'assistant' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) * (1 - 0.6::DOUBLE * (1 - r.t)), (CASE c.role WHEN 'assistant' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) * (1 - 0.6::DOUBLE * (1 - r.f)), p0 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
SELECT conv_id, round(p0 * arg_max(t, turn) / (p0 * arg_max(t, turn) + (1 - p0) * arg_max(f, turn)), 6) AS p_root FROM r GROUP BY conv_id, p0""")
def chain_posterior_root(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    base = "if({}.role = 'assistant', 0.9D, 0.7D)"
    links = "if(i = 0, cast(array() as array<struct<parent:int,type:string,a:double,b:double>>), array(named_struct('parent', i - 1, 'type', 'requires', 'a', 0.6D, 'b', 0D)))"
    nets = c.select(F.col("conv_id").alias("graph_id"), F.expr(f"transform(t, (x, i) -> named_struct('name', if(i = size(t) - 1, 'last', concat('t', i)), 'base', {base.format('x')}, 'links', {links}))").alias("vars"))
    single = nets.where("size(vars) = 1").select(F.col("graph_id").alias("conv_id"), F.lit(1.0).alias("p_root"))
    more = inference.eliminate(nets.where("size(vars) > 1"), {"t0": True}, {"last": True}).select(F.col("graph_id").alias("conv_id"), r6("answer").alias("p_root"))
    return more.unionByName(single)


RATES = [("purchase", 0.7, 0.6), ("signup", 0.6, 0.55), ("click", 0.55, 0.5), ("view", 0.52, 0.5)]
OTHER = (0.4, 0.45)


def rate(i: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{r[0]}' THEN {r[1 + i]}::DOUBLE" for r in RATES) + f" ELSE {OTHER[i]}::DOUBLE END"


@query(f"WITH e AS (SELECT user_id, CASE WHEN value >= 20 THEN {rate(0)} ELSE 1 - {rate(0)} END AS h, CASE WHEN value >= 20 THEN {rate(1)} ELSE 1 - {rate(1)} END AS n FROM events) SELECT user_id, round(0.3 * exp(sum(ln(h))) / (0.3 * exp(sum(ln(h))) + 0.7 * exp(sum(ln(n)))), 6)::DOUBLE AS posterior FROM e WHERE h IS NOT NULL GROUP BY user_id")
def observes_posterior(spark, sf_dir):
    def of(i: int):
        c = F.when(F.col("event_type") == RATES[0][0], F.lit(RATES[0][1 + i]))
        for r in RATES[1:]:
            c = c.when(F.col("event_type") == r[0], F.lit(r[1 + i]))
        c = c.otherwise(F.lit(OTHER[i]))
        return F.when(F.col("value") >= 20, c).otherwise(1 - c)

    # log likelihood ratios add up: one partial aggregation, whatever the events a user has
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.log(of(0) / of(1))).alias("l"))
    return g.select("user_id", r6("1 / (1 + exp(-l) * 0.7D / 0.3D)").alias("posterior"))


# family F5, F6: documents


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')))) AS root FROM documents")
def equivalent_components(spark, sf_dir):
    d = graphs.written(table(spark, sf_dir, "documents").select("doc_id", text.text_digest(F.col("text")).alias("digest")))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("root"))
    links = d.join(first, "digest").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    roots = graphs.components(links)
    return d.select("doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


@query("SELECT doc_id, 'sha256:' || sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
def text_normalise_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_digest(F.col("text")).alias("digest"))


@query("SELECT lang AS graph_id, source, count(*) AS supports FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang, source HAVING count(*) >= 2")
def correlated_support(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    s = s.select(F.col("lang").alias("graph_id"), F.lit("claim").alias("target"), "source")
    return graphs.correlated_support(s).select("graph_id", "source", "supports")


def tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and suppliers as one graph with some defects: every 7th supplier lacks its base, every 5th a
    source; every 11th names a nation that doesn't exist."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(0.5).alias("base"), F.lit("map").alias("source"))
    nodes = r.unionByName(n.select(key("n", "n_nationkey").alias("id"), F.lit(0.95).alias("base"), F.lit(None).cast("string").alias("source")))
    nodes = nodes.unionByName(s.select(key("s", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 0, F.lit(0.1)).alias("base"), F.when(F.col("s_suppkey") % 5 != 0, F.lit("list")).alias("source")))
    up = n.select(key("e", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target"), F.lit(0.8).alias("strength"))
    down = s.select(key("f", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 11 == 0, F.lit("n-none")).otherwise(key("n", "s_nationkey")).alias("source"), key("s", "s_suppkey").alias("target"), F.when(F.col("s_suppkey") % 13 != 0, F.lit(0.5)).alias("strength"))
    g = lambda df: df.select(F.lit("all").alias("graph_id"), "*")
    return g(nodes), g(up.unionByName(down)).withColumn("type", F.lit("requires"))


@query("SELECT 'base' AS what, 's' || s_suppkey AS id FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'strength', 'f' || s_suppkey FROM supplier WHERE s_suppkey % 13 = 0")
def missing_parameters(spark, sf_dir):
    return graphs.missing_parameters(*tree(spark, sf_dir)).select("what", "id")


@query("SELECT 'f' || s_suppkey AS relation, 'n-none' AS node FROM supplier WHERE s_suppkey % 11 = 0")
def dangling_endpoints(spark, sf_dir):
    return graphs.dangling_endpoints(*tree(spark, sf_dir)).select("relation", "node")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS graph_id, CAST(l_linenumber AS VARCHAR) AS id, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("graph_id"), F.col("l_linenumber").cast("string").alias("id"))
    return graphs.duplicate_ids(n)


@query("SELECT DISTINCT n FROM (SELECT n_nationkey AS n FROM nation UNION ALL SELECT 100 + n_regionkey FROM nation WHERE n_nationkey % 3 = 0) WHERE n IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) OR n >= 100")
def cycle_nodes(spark, sf_dir):
    """Region to nation for all nations, back for every third."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), (F.col("n_regionkey") + 100).alias("r"))
    e = n.select(F.col("r").alias("source"), F.col("n").alias("target")).union(n.where("n % 3 = 0").select("n", "r"))
    return graphs.cycle_nodes(e.select(F.lit("all").alias("graph_id"), "source", "target", F.lit("requires").alias("type"))).select(F.col("node").alias("n"))


@query("SELECT 's' || s_suppkey AS target, count(*) AS relations FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 <> 0) GROUP BY s_suppkey")
def dependencies(spark, sf_dir):
    nodes, relations = tree(spark, sf_dir)
    targets = nodes.where("id like 's%'").select("graph_id", F.col("id").alias("target"))
    return graphs.dependencies(relations, targets).groupBy("target").agg(F.count(F.lit(1)).alias("relations"))


@query("SELECT l_partkey AS part, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, (min(l_quantity) >= 5 AND max(l_quantity) <= 45) AS inside FROM lineitem GROUP BY l_partkey")
def scope_containment(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.min("l_quantity").cast("double").alias("lo"), F.max("l_quantity").cast("double").alias("hi"))
    return g.withColumn("inside", text.contains_interval(F.lit(5.0), F.lit(45.0), F.col("lo"), F.col("hi")))


@query("SELECT doc_id, lang || '-' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS VARCHAR), length(CAST(count(*) OVER (PARTITION BY lang) AS VARCHAR))::INT, '0') AS chunk FROM documents")
def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    r = graphs.numbered(d, "lang", "doc_id", "r").join(n, "lang")
    return r.select("doc_id", F.expr("concat(lang, '-', lpad(cast(r as string), length(cast(n as string)), '0'))").alias("chunk"))


@query("SELECT lang, count(*) AS n, round(count(*) FILTER (quality IS NOT NULL) / count(*)::DOUBLE, 6) AS assessed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.count("quality") / F.count(F.lit(1)).cast("double")).alias("assessed"))


NORM = "trim(regexp_replace(nfc_normalize({}), '\\s+', ' ', 'g'))"


@query(f"""WITH own AS (SELECT doc_id AS id, substr(text, 1 + length(text) // 3, 120) AS quote FROM documents),
cited AS (SELECT id, id AS doc_id, 'own' AS kind, quote FROM own UNION ALL SELECT id, id, 'altered', quote || ' ~' || id || '~' FROM own
UNION ALL SELECT id, -1 - id, 'no document', quote FROM own WHERE id % 50 = 0
UNION ALL SELECT d.doc_id, d.doc_id, 'benchmark', b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT c.id, c.kind, contains({NORM.format('d.text')}, {NORM.format('c.quote')}) AS found FROM cited c LEFT JOIN documents d ON d.doc_id = c.doc_id""")
def citation_in_document(spark, sf_dir):
    """Four kinds of citations of documents: a passage of their own, the same altered, one of a document that doesn't
    exist (for every 50th) and a benchmark passage."""
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    own = d.select(F.col("doc_id").alias("id"), F.expr("substring(text, 1 + cast(length(text) div 3 as int), 120)").alias("quote"))
    cited = own.select("id", F.col("id").alias("doc_id"), F.lit("own").alias("kind"), "quote")
    cited = cited.unionByName(own.select("id", F.col("id").alias("doc_id"), F.lit("altered").alias("kind"), F.expr("concat(quote, ' ~', id, '~')").alias("quote")))
    cited = cited.unionByName(own.where("id % 50 = 0").select("id", (-1 - F.col("id")).alias("doc_id"), F.lit("no document").alias("kind"), "quote"))
    items = b.select("item_id", F.col("text").alias("quote")).crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("items"))))
    cited = cited.unionByName(d.select("doc_id").join(F.broadcast(items), F.expr("item_id = doc_id % items")).select(F.col("doc_id").alias("id"), "doc_id", F.lit("benchmark").alias("kind"), "quote"))
    return graphs.citations_found(cited, d).select("id", "kind", "found")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS graph_id, count(*) AS nodes, round(sum((1 + s_suppkey % 8) / 10.0::DOUBLE), 6) AS bases, CAST(sum(1 + s_suppkey % 5) AS DOUBLE) AS alphas, count(*) FILTER (s_suppkey % 2 = 0) AS relations FROM supplier GROUP BY s_nationkey")
def graph_json_round_trip(spark, sf_dir):
    """Suppliers of a nation as one JSON document, written and read again; even ones have a relation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("graph_id"), F.col("s_suppkey").cast("long").alias("ord"))
    null = F.lit(None).cast("double")
    point = F.struct(((1 + F.col("ord") % 8) / F.lit(10.0)).alias("p"), null.alias("alpha"), null.alias("beta"))
    beta = F.struct(null.alias("p"), (1 + F.col("ord") % 5).cast("double").alias("alpha"), F.lit(2.0).alias("beta"))
    key = F.col("ord").cast("string")
    nodes = s.select("graph_id", "ord", key.alias("id"), point.alias("base"), beta.alias("stated"))
    relations = s.where("ord % 2 = 0").select("graph_id", "ord", F.concat(F.lit("r"), key).alias("id"), F.lit("supports").alias("type"), key.alias("source"), key.alias("target"), beta.alias("strength"))
    nodes, relations, _ = graph_json.load(graph_json.dump(nodes, relations, "own"), "own")
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), r6(F.sum("base.p")).alias("bases"), F.sum("stated.alpha").alias("alphas"))
    r = relations.groupBy("graph_id").agg(F.count("strength.alpha").alias("relations"))
    return n.join(r, "graph_id", "left").fillna(0, ["relations"])


from beliefmesh.plans import document_queries, graph_queries  # noqa: E402, F401 - register their queries
