"""What a node, a relation or a graph must hold to be written: rules of single rows as built-in expressions, rules between
rows as joins and groups. Broken rules are rows (graph_id, item, code), so that one bad graph doesn't stop the others.

Credences are structs of p, alpha and beta; attributes and obligations are JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmesh.operators import graphs
from beliefmesh.operators.compiler import INFERENTIAL, NODE, RELATION, STRENGTH, canonical

# fixed values: the fields that each kind of discharge needs and may have
DISCHARGES = {
    "formal": (["theorem"], []), "symbolic": (["script"], ["digest", "status"]), "numerical": (["script", "value", "tolerance"], ["digest", "status"]),
    "citation": (["anchor"], []), "judgement": ([], []),
}
FIELDS = ["theorem", "script", "digest", "status", "value", "tolerance", "anchor"]
RAW = "statement string, discharge struct<kind:string," + ",".join(f"{k}:string" for k in FIELDS) + ">"


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_credence(c: Column) -> Column:
    """Exactly one side: a probability, or a positive finite alpha and beta."""
    point = c["alpha"].isNull() & c["beta"].isNull() & F.coalesce(c["p"].between(0, 1) & ~F.isnan(c["p"]), F.lit(False))
    beta = c["p"].isNull() & F.coalesce((c["alpha"] > 0) & (c["beta"] > 0), F.lit(False)) & finite(c["alpha"]) & finite(c["beta"])
    return point | beta


def empty(c: Column) -> Column:
    return F.coalesce(F.length(c) == 0, F.lit(True))


def is_object(c: Column) -> Column:
    """JSON text of an object; numbers beyond a double's range aren't JSON here, nor are NaN and Infinity."""
    found = F.try_parse_json(c)
    return F.coalesce(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), F.lit(False)) & ~F.coalesce(F.rlike(c, F.lit(r"[:\[,]\s*-?(NaN|Infinity)\b")), F.lit(False))


def discharge_rules(obligation: Column) -> list[tuple[Column, str]]:
    """Conditions under which an obligation breaks a rule, with the rule's code."""
    o = F.from_json(obligation, RAW)
    d = o["discharge"]
    there = obligation.isNotNull()
    keys = F.json_object_keys(F.get_json_object(obligation, "$.discharge"))
    needed = F.create_map(*[x for k, (a, _) in DISCHARGES.items() for x in (F.lit(k), F.array(*map(F.lit, a)).cast("array<string>"))])
    allowed = F.create_map(*[x for k, (a, b) in DISCHARGES.items() for x in (F.lit(k), F.array(*map(F.lit, ["kind", *a, *b])))])
    given = F.filter(F.array(*[F.when(d[k].isNotNull(), F.lit(k)) for k in FIELDS]), lambda x: x.isNotNull())
    has = keys.isNotNull()
    value, tolerance, status = d["value"].try_cast("double"), d["tolerance"].try_cast("double"), d["status"]
    quote = F.get_json_object(d["anchor"], "$.quote")
    return [
        (there & (~is_object(obligation) | empty(o["statement"])), "obligation-statement"),
        (there & (F.size(F.array_except(F.json_object_keys(obligation), F.array(F.lit("statement"), F.lit("discharge")))) > 0), "obligation-unknown-field"),
        (has & ~F.coalesce(d["kind"].isin(*DISCHARGES), F.lit(False)), "discharge-kind"),
        (has & (F.size(F.array_except(needed[d["kind"]], given)) > 0), "discharge-lacks"),
        (has & (F.size(F.array_except(F.concat(given, F.array_except(keys, F.array(*map(F.lit, FIELDS)))), allowed[d["kind"]])) > 0), "discharge-takes-no"),
        (has & (d["script"].isNotNull() & ~F.endswith(d["script"], F.lit(".py"))), "discharge-script"),
        (has & (d["digest"].isNull() != status.isNull()), "discharge-run"),
        (has & (d["digest"].isNotNull() & ~F.rlike(d["digest"], F.lit("^sha256:[0-9a-f]{64}$"))), "discharge-digest"),
        (has & (status.isNotNull() & ~F.rlike(status, F.lit(r"^-?\d+$"))), "discharge-status"),
        (has & (d["value"].isNotNull() & ~finite(value)), "discharge-value"),
        (has & (d["tolerance"].isNotNull() & ~(finite(tolerance) & F.coalesce(tolerance > 0, F.lit(False)))), "discharge-tolerance"),
        (has & (d["kind"] == "citation") & d["anchor"].isNotNull() & empty(quote), "discharge-quote"),
    ]


def broken(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules]), lambda x: x.isNotNull())


def node_rules() -> Column:
    """Codes of the rules that a node row breaks."""
    rules = [(empty(F.col("id")), "id"), (F.col("kind").isNotNull() & empty(F.col("kind")), "kind"), (F.col("statement").isNotNull() & empty(F.col("statement")), "statement")]
    rules += [(F.col(k).isNotNull() & ~is_credence(F.col(k)), k) for k in ("base", "stated")]
    rules += [(F.col("attributes").isNotNull() & ~is_object(F.col("attributes")), "attributes")]
    rules += [(F.exists("sources", lambda a: empty(a["document"])), "source-document")]
    blank = lambda k: lambda a: a[k].isNotNull() & empty(a[k])
    rules += [(F.exists("sources", blank(k)), f"source-{k}") for k in ("locator", "quote", "digest")]
    return broken(rules)


def relation_rules() -> Column:
    """Codes of the rules that a relation row breaks."""
    kind = F.col("type")
    rules = [(empty(F.col(k)), k) for k in ("id", "type", "source", "target")]
    rules += [(kind.isin(*STRENGTH) & F.col("strength").isNull(), "strength-missing"), (~kind.isin(*STRENGTH) & F.col("strength").isNotNull(), "strength-not-allowed")]
    for k in ("sensitivity", "false_pass"):
        name = k.replace("_", "-")
        rules += [((kind == "observes") & F.col(k).isNull(), f"{name}-missing"), ((kind != "observes") & F.col(k).isNotNull(), f"{name}-not-allowed")]
    rules += [(F.col(k).isNotNull() & ~is_credence(F.col(k)), f"{k.replace('_', '-')}-range") for k in ("strength", "sensitivity", "false_pass")]
    rules += [(kind.isin("equivalent", "exclusive") & (F.col("source") == F.col("target")), "self-relation")]
    rules += [(F.col("obligation").isNotNull() & ~kind.isin(*INFERENTIAL), "obligation-not-allowed"), (F.col("attributes").isNotNull() & ~is_object(F.col("attributes")), "attributes")]
    return broken(rules + discharge_rules(F.col("obligation")))


def violations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, item, code of every broken rule: of rows (`node-...`, `relation-...`), `duplicate-node`,
    `duplicate-relation`, `dangling`, and `cycle`, whose item is the cycle's nodes and relations in turn."""
    n, r = canonical(nodes, NODE), canonical(relations, RELATION)
    key = F.coalesce("id", F.lit("")).alias("item")
    out = n.select("graph_id", key, F.explode(node_rules()).alias("c")).select("graph_id", "item", F.concat(F.lit("node-"), "c").alias("code"))
    out = out.unionByName(r.select("graph_id", key, F.explode(relation_rules()).alias("c")).select("graph_id", "item", F.concat(F.lit("relation-"), "c").alias("code")))
    for df, what in ((n, "node"), (r, "relation")):
        out = out.unionByName(graphs.duplicate_ids(df).select("graph_id", F.col("id").alias("item"), F.lit(f"duplicate-{what}").alias("code")))
    out = out.unionByName(graphs.dangling_endpoints(n, r).select("graph_id", F.col("relation").alias("item"), F.lit("dangling").alias("code")).distinct())
    return out.unionByName(graphs.cycles(r).select("graph_id", F.array_join("path", " ").alias("item"), F.lit("cycle").alias("code")))
