"""Graphs of documents checked against a rubric, graph by graph, and how far their classification has got.

Levels nest: `anchored` (sources and parts are sound), `typed` (types, forms, what a node rests on, scopes and units) and
`assessed` (verdicts with evidence; the graph compiles). `strict` adds that all credences are the rubric's. A violation is
a finding whose diagnostic is its code and whose id is `<code>:<node>` (or `<code>:<relation>`).

The rules of a graph read indexes of its relations by end, so the work is proportional to the graph.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from beliefmesh.functions import text, units
from beliefmesh.operators import compiler, diagnostics
from beliefmesh.operators.compiler import by_graph, gathered
from beliefmesh.sources.rubric_file import BUILT_IN, ORIGINS

LEVELS = ("anchored", "typed", "assessed")
# fixed values: annotation relations, verdicts and check results
PART_OF, CITES = "part-of", "cites"
VERDICTS = ("holds", "fails", "undetermined", "not_assessed")
RESULTS = {"passed": True, "failed": False, "error": None}
CODES = {
    "anchored": ("origin-invalid", "unknown-type", "origin-not-allowed", "anchor-invalid", "anchor-mismatch", "digest-mismatch", "analyst-has-source", "part-of-invalid", "span-not-in-parent", "field-child-invalid", "compound-children", "compound-has-content"),
    "typed": ("untyped", "form-missing-field", "form-invalid-field", "form-not-in-text", "rests-on-missing", "out-of-domain", "scope-exceeds-support", "unit-mismatch"),
    "assessed": ("unassessed", "no-evidence", "missing-reason", "compile-error"),
    "strict": ("credence-not-rubric", "relation-not-allowed", "check-unobserved-invalid"),
}


def chars_of(locator: str | None) -> tuple[int, int] | None:
    """The trailing `;chars=a-b` of a locator."""
    _, mark, tail = (locator or "").rpartition(";chars=")
    first, dash, last = tail.partition("-")
    whole = mark and dash and all(x.isascii() and x.isdigit() for x in (first, last))
    return (int(first), int(last)) if whole else None


def number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def interval(x) -> bool:
    return isinstance(x, list) and len(x) == 2 and all(e is None or number(e) for e in x) and not (None not in x and x[0] > x[1])


class Document:
    """A graph with its attributes read and its relations by end."""

    def __init__(self, graph: dict, rubric: dict):
        self.graph, self.rubric = graph, rubric
        self.nodes = {n["id"]: n for n in graph["nodes"]}
        self.attributes = {n["id"]: json.loads(n["attributes"]) if n["attributes"] else {} for n in graph["nodes"]}
        self.sources = {n["id"]: n["sources"] or [] for n in graph["nodes"]}
        self.into: dict[str, list[dict]] = {}
        self.out: dict[str, list[dict]] = {}
        for r in graph["relations"]:
            self.into.setdefault(r["target"], []).append(r)
            self.out.setdefault(r["source"], []).append(r)

    def origin(self, node: dict) -> str | None:
        x = self.attributes[node["id"]].get("origin")
        return x if isinstance(x, str) and x in ORIGINS else None

    def type(self, node: dict) -> dict | None:
        return self.rubric["types"].get(node["kind"])

    def parts(self, node: dict) -> list[dict]:
        return [r for r in self.out.get(node["id"], ()) if r["type"] == PART_OF]

    def parent(self, node: dict) -> dict | None:
        own = self.parts(node)
        return self.nodes[own[0]["target"]] if len(own) == 1 else None

    def span(self, node: dict) -> tuple[int, int] | None:
        own = self.sources[node["id"]]
        return chars_of(own[0]["locator"]) if len(own) == 1 else None

    def field_child(self, node: dict) -> bool:
        return bool(self.parts(node)) and self.span(node) is None

    def text(self, node: dict) -> str:
        """What a node's form restates: its statement, or its parent's for a field child."""
        owner = self.parent(node) if self.field_child(node) else node
        return (owner or {}).get("statement") or ""

    def check(self, node: dict) -> dict | None:
        """The check type of an evidence node that has the record of one."""
        fits = self.origin(node) == "evidence" and isinstance(self.attributes[node["id"]].get("check"), dict)
        return self.rubric["checks"].get(node["kind"]) if fits else None

    def counted(self, node: dict) -> list[dict]:
        """The relations that a type's edge rule counts."""
        rule = (self.type(node) or {}).get("rests_on")
        return [r for r in self.into.get(node["id"], ()) if rule and r["type"] == rule["relation"] and self.nodes[r["source"]]["kind"] in rule["types"]]

    def values(self, node: dict, kind: str) -> dict:
        """The form fields of one kind that are valid, of a document node."""
        form, own = self.attributes[node["id"]].get("form"), self.type(node)
        if own is None or self.origin(node) != "document" or not isinstance(form, dict):
            return {}
        return {k: v for k, v in form.items() if k in own["form"] and own["form"][k]["type"] == kind and valid(own["form"][k], v, self.rubric)}

    def scope(self, node: dict) -> dict[str, text.Interval]:
        """For each parameter that the node's scopes name, where they all hold."""
        out: dict[str, text.Interval] = {}
        for field in self.values(node, "scope").values():
            for k, ends in field.items():
                out[k] = text.meet(out.get(k, (None, None)), tuple(ends))
        return out


def valid(field: dict, x, rubric: dict) -> bool:
    filled = isinstance(x, str) and x != ""
    match field["type"]:
        case "verbatim" | "eqref":
            return filled
        case "number":
            return number(x)
        case "bool":
            return isinstance(x, bool)
        case "enum":
            return isinstance(x, str) and x in field["values"]
        case "quantity":
            return isinstance(x, dict) and set(x) == {"value", "unit"} and number(x["value"]) and isinstance(x["unit"], str) and x["unit"] != ""
    return isinstance(x, dict) and all(k in rubric["parameters"] and interval(v) for k, v in x.items())


def violation(code: str, node: dict, what: str, relations: list[dict] | None = None) -> dict:
    return diagnostics.finding(code, node["id"], f"{node['id']}: {what}", [node["id"]], [r["id"] for r in relations or ()])


def form_problems(doc: Document, node: dict, form, kind: str | None = None) -> tuple[list[str], list[str], list[str]]:
    """Fields that are missing, invalid, and not found in the node's text."""
    fields = doc.rubric["types"][kind or node["kind"]]["form"]
    if not isinstance(form, dict):
        return [], ["the form is no object"], []
    about = doc.text(node)
    invalid = [k for k, v in form.items() if k not in fields or not valid(fields[k], v, doc.rubric)]
    absent = {k: text.unfaithful_to(fields[k]["type"], v, about) for k, v in form.items() if k not in invalid}
    return [k for k, f in fields.items() if f["required"] and k not in form], invalid, [f"{k}: {why}" for k, why in absent.items() if why]


def anchored(doc: Document) -> list[dict]:
    out = []
    for node in doc.graph["nodes"]:
        say = lambda code, what, relations=None, node=node: out.append(violation(code, node, what, relations))
        origin, own, sources, kind = doc.origin(node), doc.type(node), doc.sources[node["id"]], node["kind"]
        if origin is None:
            say("origin-invalid", f"its origin is none of {', '.join(ORIGINS)}")
        allowed = ["document"] if kind in BUILT_IN else own["origins"] if own else None
        if allowed is None:
            say("unknown-type", f"{kind} is no type of the rubric")
        elif origin is not None and origin not in allowed:
            say("origin-not-allowed", f"{kind} is for {', '.join(allowed)} nodes")
        if origin == "document":
            if len(sources) != 1:
                say("anchor-invalid", f"it has {len(sources)} sources, not one")
            else:
                anchor = sources[0]
                lacking = [k for k in ("locator", "quote", "digest") if anchor[k] is None]
                if lacking:
                    say("anchor-invalid", f"its source lacks {', '.join(lacking)}")
                if anchor["quote"] is not None:
                    if not doc.field_child(node) and node["statement"] != anchor["quote"]:
                        say("anchor-mismatch", "its statement isn't its quote")
                    if anchor["digest"] is not None and anchor["digest"] != text.digest_of(anchor["quote"]):
                        say("digest-mismatch", "its digest isn't its quote's")
        if origin == "analyst" and sources:
            say("analyst-has-source", "an implicit premise has no source")
        if doc.parts(node):
            child(doc, node, say)
        if kind == "compound":
            into, away = doc.into.get(node["id"], []), doc.out.get(node["id"], [])
            children = [r for r in into if r["type"] == PART_OF]
            if len(children) < 2:
                say("compound-children", f"it has {len(children)} children, not two or more")
            content = [k for k in ("form", "assessment") if k in doc.attributes[node["id"]]] + (["base"] if node["base"] is not None else [])
            stray = {r["id"] for r in into if r["type"] != PART_OF} | {r["id"] for r in away if r["type"] != CITES}
            if content or stray:
                say("compound-has-content", f"it carries {', '.join([*content, *sorted(stray)])}", [r for r in doc.graph["relations"] if r["id"] in stray])
    return out


def child(doc: Document, node: dict, say) -> None:
    parts, parent = doc.parts(node), doc.parent(node)
    wrong = [what for bad, what in (
        (parent is None, f"it is part of {len(parts)} nodes"), (parent is not None and parent["kind"] != "compound", "what it is part of is no compound"),
        (node["kind"] == "compound", "a part is no compound"), (doc.origin(node) != "document", "a part is a document node"),
    ) if bad]
    if wrong:
        say("part-of-invalid", "; ".join(wrong), parts)
        return
    own, theirs = doc.sources[node["id"]], doc.sources[parent["id"]]
    if doc.field_child(node):
        wrong = [what for bad, what in (
            (node["statement"] is not None, "it has a statement"), (not isinstance(doc.attributes[node["id"]].get("form"), dict), "it has no form"), (own != theirs, "its source isn't its parent's"),
        ) if bad]
        if wrong:
            say("field-child-invalid", "; ".join(wrong), parts)
        return
    first, last = doc.span(node)
    whole = parent["statement"] or ""
    if node["statement"] is None or last > len(whole) or whole[first:last] != node["statement"]:
        say("span-not-in-parent", f"its text isn't at {first}-{last} of its parent's", parts)
    elif len(theirs) != 1 or own[0]["document"] != theirs[0]["document"] or own[0]["locator"] != f"{theirs[0]['locator']};chars={first}-{last}":
        say("span-not-in-parent", "its source isn't its parent's with that span", parts)


def typed(doc: Document) -> list[dict]:
    out = []
    for node in doc.graph["nodes"]:
        say = lambda code, what, relations=None, node=node: out.append(violation(code, node, what, relations))
        if node["kind"] == "unassigned":
            say("untyped", "it has no type yet")
        own, attributes = doc.type(node), doc.attributes[node["id"]]
        if own is None:
            continue
        if doc.origin(node) != "document":
            if "form" in attributes:
                say("form-invalid-field", "only document nodes carry a form")
        elif own["form"] or "form" in attributes:
            for code, found in zip(("form-missing-field", "form-invalid-field", "form-not-in-text"), form_problems(doc, node, attributes.get("form", {})), strict=True):
                if found:
                    say(code, ", ".join(found))
        rule, counted = own["rests_on"], doc.counted(node)
        if rule and len(counted) < rule["min"]:
            say("rests-on-missing", f"it rests on {len(counted)} by {rule['relation']}, not on {rule['min']}", counted)
        scopes(doc, node, counted, say)
    return out


def scopes(doc: Document, node: dict, counted: list[dict], say) -> None:
    """Scopes within their domains and within what the node rests on; units that agree with it."""
    mine = doc.scope(node)
    outside = [k for k, x in mine.items() if not text.holds(tuple(doc.rubric["parameters"][k]["domain"]), x)]
    if outside:
        say("out-of-domain", ", ".join(outside))
    ids = {r["id"] for r in counted}
    rests = [r for r in doc.into.get(node["id"], ()) if r["type"] == "requires" or r["id"] in ids]
    ground: dict[str, text.Interval] = {}
    scoped, clash, fields = [], {}, doc.values(node, "quantity")
    for r in rests:
        source = doc.nodes[r["source"]]
        theirs = doc.scope(source)
        scoped += [r] if theirs else []
        for k, x in theirs.items():
            ground[k] = text.meet(ground.get(k, (None, None)), x)
        for k, q in doc.values(source, "quantity").items():
            if k in fields and not units.same_kind(fields[k]["unit"], q["unit"]):
                clash.setdefault(r["id"], (r, []))[1].append(f"{k}: {fields[k]['unit']} against {q['unit']}")
    beyond = [k for k, x in mine.items() if k in ground and not text.holds(ground[k], x)]
    if beyond:
        say("scope-exceeds-support", ", ".join(beyond), scoped)
    if clash:
        say("unit-mismatch", "; ".join(w for _, what in clash.values() for w in what), [r for r, _ in clash.values()])


def assessed(doc: Document) -> list[dict]:
    out = []
    for node in doc.graph["nodes"]:
        own = doc.type(node)
        if own is None or not own["assess"]:
            continue
        x = doc.attributes[node["id"]].get("assessment")
        verdict = x.get("verdict") if isinstance(x, dict) else None
        if not isinstance(verdict, str) or verdict not in VERDICTS or set(x) - {"verdict", "reason"}:
            out.append(violation("unassessed", node, "it has no assessment" if x is None else "its assessment is no verdict"))
        elif verdict == "not_assessed":
            if not isinstance(x.get("reason"), str) or not x["reason"].strip():
                out.append(violation("missing-reason", node, "it says no reason for not being assessed"))
        else:
            evidence = any(doc.origin(doc.nodes[r["source"]]) == "evidence" for r in doc.into.get(node["id"], ()))
            checked = any(r["type"] in ("observes", "supports") and doc.check(doc.nodes[r["target"]]) for r in doc.out.get(node["id"], ()))
            if not evidence and not checked:
                out.append(violation("no-evidence", node, f"nothing backs the verdict {verdict}"))
    errors = compiler.compile_graph(doc.graph)[2]
    if errors:
        missing = [k for f in diagnostics.missing_parameters(doc.graph) for k in f["nodes"]]
        out.append(diagnostics.finding("compile-error", "graph", "; ".join(f"{e['code']} {', '.join(e['items'])}" for e in errors), missing))
    return out


def strict(doc: Document) -> list[dict]:
    """All credences are the rubric's, and only an observed check can raise one: document and analyst nodes are joined by
    `requires` alone, and by check edges to check nodes, which have no base."""
    out, rubric = [], doc.rubric
    origin = {k: doc.origin(n) for k, n in doc.nodes.items()}
    checks = {k: c for k, n in doc.nodes.items() if (c := doc.check(n)) is not None}
    plain = {k for k, o in origin.items() if o in ("document", "analyst")}
    for node in doc.graph["nodes"]:
        k, attributes = node["id"], doc.attributes[node["id"]]
        if node["base"] is not None:
            if k in checks:
                out.append(violation("credence-not-rubric", node, "a check node takes no base"))
            elif k in plain:
                implied = origin[k] == "analyst" and rubric["premises"]
                if node["base"] != (rubric["premises"]["base"] if implied else (doc.type(node) or {}).get("base")):
                    out.append(violation("credence-not-rubric", node, "its base isn't the rubric's"))
        if k in checks:
            result = attributes["check"].get("result")
            if not isinstance(result, str) or result not in RESULTS:
                out.append(violation("check-unobserved-invalid", node, "its check has no known result"))
            elif ("observed" in attributes) != (RESULTS[result] is not None) or attributes.get("observed") is not RESULTS[result]:
                out.append(violation("check-unobserved-invalid", node, f"what is observed isn't what a check that {result} gives"))
        elif "observed" in attributes:
            out.append(violation("check-unobserved-invalid", node, "only a check node is observed"))
    for r in doc.graph["relations"]:
        a, b = r["source"], r["target"]
        if r["type"] not in compiler.INFERENTIAL or not {a, b} & (plain | checks.keys()):
            continue
        code, what = None, ""
        if r["type"] == "requires" and {a, b} <= plain:
            rule = (doc.type(doc.nodes[b]) or {}).get("rests_on")
            implied = origin[a] == "analyst" and rubric["premises"]
            if r["strength"] != (rubric["premises"]["strength"] if implied else rule["strength"] if rule and rule["relation"] == "requires" else None):
                code, what = "credence-not-rubric", "its strength isn't the rubric's"
        elif r["type"] == "observes" and a in plain and b in checks:
            if (r["sensitivity"], r["false_pass"]) != (checks[b]["sensitivity"], checks[b]["false_pass"]):
                code, what = "credence-not-rubric", "its rates aren't its check's"
        else:
            code, what = "relation-not-allowed", "propositions rest on requires alone, and checks on observes"
        if code:
            out.append(diagnostics.finding(code, r["id"], f"{r['id']}: {what}", [a, b], [r["id"]]))
    return out


def check_graph(graph: dict, rubric: dict, level: str = "typed", rubric_credences: bool = False) -> list[dict]:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    if wrong := compiler.defects(graph):
        return [diagnostics.finding("error", "malformed", ", ".join(wrong), [])]
    doc = Document(graph, rubric)
    out = [f for rules in (anchored, typed, assessed)[: LEVELS.index(level) + 1] for f in rules(doc)]
    return out + (strict(doc) if rubric_credences else [])


def check(nodes: DataFrame, relations: DataFrame, rubric: dict, level: str = "typed", rubric_credences: bool = False) -> DataFrame:
    """Every violation of every graph, as findings (see diagnostics); ord is its place in the graph's report."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")

    def run(graph: dict) -> list[dict]:
        return [{**f, "target": None, "ord": i} for i, f in enumerate(check_graph(graph, rubric, level, rubric_credences))]

    return by_graph(gathered(nodes, relations), lambda graphs: map(run, graphs), diagnostics.FINDINGS)


def coverage_of(graph: dict, rubric: dict) -> dict:
    """How far classification has got. Types count document nodes, in the order in which they first appear."""
    graph = {**graph, "relations": []}
    doc = Document(graph, rubric)
    origins, kinds = dict.fromkeys(ORIGINS, 0), {}
    untyped, unexamined, reasons = [], [], {}
    for node in graph["nodes"]:
        origin, x = doc.origin(node), doc.attributes[node["id"]].get("assessment")
        if origin:
            origins[origin] += 1
        if origin == "document":
            kinds[node["kind"]] = kinds.get(node["kind"], 0) + 1
        if node["kind"] == "unassigned":
            untyped.append(node["id"])
        if (doc.type(node) or {}).get("assess") and x is None:
            unexamined.append(node["id"])
        if isinstance(x, dict) and x.get("verdict") == "not_assessed":
            reasons[node["id"]] = None if x.get("reason") is None else str(x["reason"])
    by_type = [{"type": k, "count": n, "share": n / origins["document"]} for k, n in kinds.items()]
    return {"rubric": rubric["name"], "version": rubric["version"], "n_nodes": len(graph["nodes"]), "by_origin": list(origins.items()), "by_type": by_type, "untyped": untyped, "unexamined": unexamined, "not_assessed": list(reasons.items())}


COVERAGE = "rubric string, version string, n_nodes long, by_origin map<string,long>, by_type array<struct<type:string,count:long,share:double>>, untyped array<string>, unexamined array<string>, not_assessed map<string,string>"


def coverage(nodes: DataFrame, relations: DataFrame, rubric: dict) -> DataFrame:
    """A row per graph (see COVERAGE)."""
    return by_graph(gathered(nodes, relations), lambda graphs: ([coverage_of(g, rubric)] for g in graphs), COVERAGE)
