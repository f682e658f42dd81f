"""Edits of graphs: splitting a chunk into parts, annotating a node by a rubric, adding nodes and relations.

An edit of one graph gives a new graph or raises EditError, and leaves the one it was given as it is. `edited` applies a
table of edits, in order, each graph in its own row: where one fails, the graph stays as it was and its row has the error.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.functions import text
from beliefmesh.operators import compiler, rubric as rubrics
from beliefmesh.operators.compiler import NODE, RELATION, by_graph, gathered
from beliefmesh.operators.rubric import CITES, PART_OF, Document, chars_of, form_problems

NO_RUBRIC: dict = {"types": {}, "checks": {}, "parameters": {}, "premises": None}


class EditError(ValueError):
    """An edit that would break a rule; its first argument is the code."""


def require(holds: bool, code: str, what: str) -> None:
    if not holds:
        raise EditError(code, what)


def blank(fields: dict[str, str], /, **values) -> dict:
    return {**dict.fromkeys(fields), **values}


def with_nodes(graph: dict, changed: dict[str, dict], after: str | None = None, new: list[dict] | None = None, relations: list[dict] | None = None) -> dict:
    """A graph with some nodes replaced, others put in after one, and relations added; ord numbers them anew."""
    nodes = []
    for n in graph["nodes"]:
        nodes.append(changed.get(n["id"], n))
        if n["id"] == after:
            nodes += new or []
    nodes += new or [] if after is None else []
    number = lambda rows: [{**x, "ord": i} for i, x in enumerate(rows)]
    out = {**graph, "nodes": number(nodes), "relations": number([*graph["relations"], *(relations or [])])}
    own = {r["id"] for r in graph["relations"]}
    for r in relations or ():
        require(r["id"] not in own, "duplicate-id", f"relation {r['id']} is there already")
        own.add(r["id"])
    edges: dict[str, list[tuple[str, str]]] = {n["id"]: [] for n in nodes}
    for r in out["relations"]:
        if r["type"] in compiler.ACYCLIC:
            edges[r["source"]].append((r["id"], r["target"]))
    found = compiler.cycle(edges) if relations else None
    require(found is None, "cycle", " ".join(found or ()))
    return out


def node_of(graph: dict, name: str) -> dict:
    """The node, or an error that names the closest ids."""
    for n in graph["nodes"]:
        if n["id"] == name:
            return n
    near = difflib.get_close_matches(name, [n["id"] for n in graph["nodes"]], 3)
    raise EditError("unknown-node", name + (f"; did you mean {', '.join(near)}?" if near else ""))


def split(graph: dict, name: str, clauses: list[str], fields: bool = False) -> tuple[dict, list[str]]:
    """Make a chunk a compound with a part for each clause (which its text has exactly once), or with one field child. The
    graph and the new ids: the chunk's with a, b, ..."""
    require(bool(clauses) != bool(fields), "invalid-argument", "either clauses or fields")
    node = node_of(graph, name)
    doc = Document(graph, NO_RUBRIC)
    attributes, sources = doc.attributes[name], doc.sources[name]
    require(doc.origin(node) == "document", "not-splittable", "only a chunk of the document can be split")
    require(not doc.parts(node), "not-splittable", "it is part of a compound")
    content = [k for k in ("form", "assessment") if k in attributes] + (["base"] if node["base"] is not None else [])
    require(not content, "not-splittable", f"it carries {', '.join(content)}")
    stray = [r["id"] for r in doc.into.get(name, ()) if r["type"] != PART_OF] + [r["id"] for r in doc.out.get(name, ()) if r["type"] != CITES]
    require(not stray, "not-splittable", f"it is an end of {', '.join(stray)}")
    require(len(sources) == 1 and sources[0]["locator"] is not None and node["statement"] is not None, "not-splittable", "it needs a statement and one source with a locator")
    own = {"origin": "document"} | ({"unit": attributes["unit"]} if attributes.get("unit") is not None else {})
    free = (f"{name}{x}" for x in text.suffixes() if f"{name}{x}" not in doc.nodes)
    children = []
    for clause in clauses or [None]:
        made = blank(NODE, id=next(free), kind="unassigned", attributes=json.dumps(own))
        if clause is None:
            made["sources"] = sources
        else:
            places = text.occurrences_of(node["statement"], clause)
            require(len(places) == 1, "invalid-argument", f"{clause!r} is in the text {len(places)} times, not once")
            locator = f"{sources[0]['locator']};chars={places[0]}-{places[0] + len(clause)}"
            made |= {"statement": clause, "sources": [{"document": sources[0]["document"], "locator": locator, "quote": clause, "digest": text.digest_of(clause)}]}
        children.append(made)
    parts = [blank(RELATION, id=f"{c['id']}-{PART_OF}-{name}", type=PART_OF, source=c["id"], target=name) for c in children]
    family = {name} | {r["source"] for r in doc.into.get(name, ()) if r["type"] == PART_OF}
    last = [n["id"] for n in graph["nodes"] if n["id"] in family][-1]
    return with_nodes(graph, {name: {**node, "kind": "compound"}}, last, children, parts), [c["id"] for c in children]


def annotate(graph: dict, rubric: dict, name: str, kind: str | None = None, settings: dict | None = None, rests_on: list[str] | None = None, verdict: str | None = None, reason: str | None = None) -> dict:
    """Type a node, fill in fields of its form, link it to what it rests on and assess it, in that order, each by the rubric.
    The type `unassigned` takes away type, form, assessment and base."""
    node, doc = node_of(graph, name), Document(graph, rubric)
    origin, attributes = doc.origin(node), dict(doc.attributes[name])
    require(origin is not None, "origin-invalid", name)
    require(node["kind"] != "compound", "invalid-argument", f"{name} is a compound; its parts are annotated")
    require(verdict is None or reason is None, "invalid-argument", "a verdict or a reason, not both")
    if kind == "unassigned":
        require(origin == "document", "origin-not-allowed", f"only document nodes are unassigned, {name} is {origin}")
        node = {**node, "kind": kind, "base": None}
        attributes = {k: v for k, v in attributes.items() if k not in ("form", "assessment")}
    elif kind is not None:
        require(kind in rubric["types"], "unknown-type", kind)
        require(origin in rubric["types"][kind]["origins"], "origin-not-allowed", f"{kind} for {origin}")
        node = {**node, "kind": kind, "base": node["base"] if node["base"] is not None else rubric["types"][kind]["base"]}
    own = rubric["types"].get(node["kind"])
    if settings:
        require(own is not None, "unknown-type", f"{name} has no type of the rubric")
        require(origin == "document", "form-invalid-field", "only document nodes carry a form")
        _, invalid, absent = form_problems(doc, node, settings, node["kind"])
        require(not invalid, "form-invalid-field", ", ".join(invalid))
        require(not absent, "form-not-in-text", ", ".join(absent))
        attributes["form"] = {**attributes.get("form", {}), **settings}
    if verdict is not None or reason is not None:
        require(own is not None, "unknown-type", f"{name} has no type of the rubric")
        require(reason.strip() != "" if reason is not None else verdict in rubrics.VERDICTS[:3], "invalid-argument", "a reason, or holds, fails or undetermined")
        attributes["assessment"] = {"verdict": "not_assessed", "reason": reason} if reason is not None else {"verdict": verdict}
    relations = []
    rule = (own or {}).get("rests_on")
    require(not rests_on or rule is not None, "rests-on-missing", f"{node['kind']} rests on nothing")
    for source in dict.fromkeys(rests_on or ()):
        require(node_of(graph, source)["kind"] in rule["types"], "rests-on-missing", f"{node['kind']} doesn't rest on {node_of(graph, source)['kind']}")
        relations.append(blank(RELATION, id=f"{source}-{rule['relation']}-{name}", type=rule["relation"], source=source, target=name, strength=rule["strength"]))
    return with_nodes(graph, {name: {**node, "attributes": json.dumps(attributes)}}, None, None, relations)


def add_node(graph: dict, name: str, **values) -> tuple[dict, list[str]]:
    """The graph with one more node, and ids so like its own that it may be a slip (three quarters alike or more)."""
    require(bool(name), "invalid-argument", "an id isn't empty")
    require(all(n["id"] != name for n in graph["nodes"]), "duplicate-id", name)
    near = difflib.get_close_matches(name, [n["id"] for n in graph["nodes"]], 3, 0.75)
    values = {"kind": "proposition", "attributes": None, **values}
    return with_nodes(graph, {}, None, [blank(NODE, id=name, **values)]), near


def relate(graph: dict, name: str, kind: str, source: str, target: str, **values) -> dict:
    """The graph with one more relation, by the rules of relations."""
    for end in (source, target):
        node_of(graph, end)
    wrong = relation_rules(blank(RELATION, id=name, type=kind, source=source, target=target, **values))
    require(not wrong, "invalid-argument", ", ".join(wrong))
    return with_nodes(graph, {}, None, None, [blank(RELATION, id=name, type=kind, source=source, target=target, **values)])


def relation_rules(r: dict) -> list[str]:
    """The codes of the rules that a relation breaks."""
    out = [f"empty-{k}" for k in ("id", "type", "source", "target") if not r[k]]
    if (r["strength"] is not None) != (r["type"] in compiler.STRENGTH):
        out.append("strength")
    out += [k.replace("_", "-") for k in ("sensitivity", "false_pass") if (r[k] is not None) != (r["type"] == "observes")]
    if r["type"] in ("equivalent", "exclusive") and r["source"] == r["target"]:
        out.append("self-relation")
    if r["obligation"] is not None and r["type"] not in compiler.INFERENTIAL:
        out.append("obligation")
    return out


def apply(graph: dict, rubric: dict, edit: dict) -> dict:
    """One edit as JSON data: {"do": "split" | "annotate" | "add-node" | "relate", ...the arguments}."""
    own = {k: v for k, v in edit.items() if k != "do"}
    try:
        match edit["do"]:
            case "split":
                return split(graph, **own)[0]
            case "annotate":
                return annotate(graph, rubric, **own)
            case "add-node":
                return add_node(graph, **own)[0]
            case "relate":
                return relate(graph, **own)
    except TypeError as e:
        raise EditError("invalid-argument", str(e)) from None
    raise EditError("invalid-argument", f"no edit {edit['do']!r}")


def edited(nodes: DataFrame, relations: DataFrame, edits: DataFrame, rubric: dict | None = None) -> DataFrame:
    """graph_id, nodes, relations, error: the graphs after edits(graph_id, ord, edit as JSON). See `apart` for their tables."""
    rows = gathered(nodes, relations).join(edits.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", "edit"))).alias("edits")), "graph_id", "left")

    def run(graph: dict) -> list[dict]:
        now, error = {"nodes": graph["nodes"], "relations": graph["relations"]}, None
        try:
            if wrong := compiler.defects(graph):
                raise EditError("malformed", ", ".join(wrong))
            for x in graph["edits"] or ():
                now = apply(now, rubric or NO_RUBRIC, json.loads(x["edit"]))
        except EditError as e:
            now, error = graph, ": ".join(map(str, e.args))
        return [{"nodes": now["nodes"], "relations": now["relations"], "error": error}]

    listed: Callable[[dict[str, str]], str] = lambda kind: "array<struct<" + ",".join(f"{k}:{v}" for k, v in kind.items()) + ">>"
    return by_graph(rows, lambda graphs: map(run, graphs), f"nodes {listed(NODE)}, relations {listed(RELATION)}, error string")


def apart(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and relation tables of graph rows."""
    return tuple(graphs.select("graph_id", F.explode(c).alias("x")).select("graph_id", "x.*") for c in ("nodes", "relations"))


__all__ = ["EditError", "add_node", "annotate", "apart", "chars_of", "edited", "relate", "split"]
