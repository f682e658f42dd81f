"""Rubric files, checks by defect, coverage and edits, over a small document of our own."""

import copy
import json

import pytest
from test_compiler import credence, node, relation

from beliefmesh.functions import text
from beliefmesh.operators import edits, rubric
from beliefmesh.sources import rubric_file

TOML = """
[rubric]
format = 2
name = "field-notes"
version = "3"
[calibration]
status = "calibrated"
scoring = "brier"
against = "four seasons"
date = 2025-01-31
[parameters.depth]
unit = "m"
domain = [0, 500]
[parameters.year]
unit = "yr"
[initial]
sentence = "remark"
[types.remark]
[types.reading]
assess = true
base = "beta:6,2"
form.amount = { type = "quantity" }
form.count = { type = "number" }
form.words = { type = "verbatim", required = true }
form.eq = { type = "eqref" }
form.clear = { type = "bool" }
form.where = { type = "scope" }
form.sign = { type = "enum", values = ["up", "down"] }
[types.guess]
origins = ["document", "analyst"]
base = 0.4
[types.verdict]
assess = true
base = "Beta: 3, 3"
form.amount = { type = "quantity" }
form.where = { type = "scope" }
rests_on = { types = ["reading", "guess"], min = 2, relation = "requires", strength = 0.9 }
[types.seen]
origins = ["evidence"]
[checks.recount]
targets = ["reading"]
sensitivity = 0.9
false_pass = "beta:1,9"
models = []
[premises]
base = 0.25
strength = 0.75
for = ["verdict"]
max_per_conclusion = 2
[hedges]
"Perhaps  so" = 0.5
"""
RUBRIC = rubric_file.rubric_from_text(TOML)
READING = "We counted 12 reeds at 40 m, see (3)."


def chunk(name, statement, kind="remark", locator="file=a;lines=1-1", **more):
    attributes = {"origin": "document", "unit": "sentence", **more.pop("attributes", {})}
    source = [{"document": "d", "locator": locator, "quote": statement, "digest": text.digest_of(statement)}]
    return node(name, **{"kind": kind, "statement": statement, "sources": source, "attributes": json.dumps(attributes), **more})


def sound():
    form = {"words": "reeds", "count": 12, "amount": {"value": 40, "unit": "m"}, "eq": "3", "clear": True, "sign": "up", "where": {"depth": [10, 50]}}
    nodes = [
        chunk("s-1", READING, "reading", base=credence(None, 6.0, 2.0), attributes={"form": form, "assessment": {"verdict": "holds"}}),
        node("g-1", 0.25, kind="guess", attributes='{"origin": "analyst"}'),
        chunk("s-2", "Reeds grow at 40 m.", "verdict", base=credence(None, 3.0, 3.0), attributes={"form": {"where": {"depth": [20, 40]}, "amount": {"value": 40, "unit": "m"}}, "assessment": {"verdict": "not_assessed", "reason": "no time"}}),
        node("c-1", kind="recount", attributes='{"origin": "evidence", "check": {"result": "passed"}, "observed": true}'),
        chunk("s-3", "One. Two.", "compound"), chunk("s-3a", "One.", locator="file=a;lines=1-1;chars=0-4"), chunk("s-3b", "Two.", locator="file=a;lines=1-1;chars=5-9"),
    ]
    relations = [relation("r1", "requires", "s-1", "s-2", 0.9), relation("r2", "requires", "g-1", "s-2", 0.75), relation("o1", "observes", "s-1", "c-1", None, 0.9, credence(None, 1.0, 9.0)), relation("p1", "part-of", "s-3a", "s-3"), relation("p2", "part-of", "s-3b", "s-3"), relation("q", "cites", "s-3", "s-1")]
    return {"nodes": nodes, "relations": relations}


def change(name, attributes=None, drop=(), **values):
    """The sound graph with a node changed."""
    g = copy.deepcopy(sound())
    for n in g["nodes"]:
        if n["id"] == name:
            own = {k: v for k, v in json.loads(n["attributes"]).items() if k not in drop}
            n.update(attributes=json.dumps({**own, **(attributes or {})}), **values)
    return g


def form_of(name, **fields):
    g = sound()
    own = json.loads(next(n for n in g["nodes"] if n["id"] == name)["attributes"])["form"]
    return {"form": {k: v for k, v in {**own, **fields}.items() if v != "-"}}


def codes(g, level="assessed", strict=True):
    return [f["id"] for f in rubric.check_graph(g, RUBRIC, level, strict)]


def plus(*relations, nodes=(), drop=()):
    g = sound()
    return {"nodes": [*g["nodes"], *nodes], "relations": [r for r in g["relations"] if r["id"] not in drop] + list(relations)}


QUOTE = [{"document": "d", "locator": None, "quote": READING, "digest": "sha256:0"}]
DEFECTS = [
    (change("s-1", drop=["origin"]), ["origin-invalid:s-1", "part-of"]), (change("s-1", kind="nothing"), ["unknown-type:s-1"]), (change("g-1", kind="reading"), ["origin-not-allowed:g-1"]), (change("g-1", kind="unassigned"), ["origin-not-allowed:g-1"]),
    (change("s-1", sources=[]), ["anchor-invalid:s-1"]), (change("s-1", sources=QUOTE), ["anchor-invalid:s-1", "digest-mismatch:s-1"]), (change("s-2", statement="Reeds grow at 40 m"), ["anchor-mismatch:s-2"]), (change("g-1", sources=QUOTE), ["analyst-has-source:g-1"]),
    (plus(relation("p3", "part-of", "s-2", "s-1")), ["part-of-invalid:s-2"]), (plus(relation("p3", "part-of", "s-3a", "s-1")), ["part-of-invalid:s-3a"]), (change("s-3b", kind="compound"), ["part-of-invalid:s-3b", "compound-children:s-3b"]),
    (change("s-3a", statement="One"), ["anchor-mismatch:s-3a", "span-not-in-parent:s-3a"]), (change("s-3a", sources=chunk("x", "One.", locator="file=b;chars=0-4")["sources"]), ["span-not-in-parent:s-3a"]),
    (change("s-3a", sources=chunk("x", "One. Two.")["sources"], statement=None), ["field-child-invalid:s-3a"]), (change("s-3a", {"form": {}}, sources=chunk("x", "One. Two.")["sources"], statement=None), []),
    (plus(drop=["p2"]), ["compound-children:s-3"]), (change("s-3", {"form": {}}, base=credence(0.5)), ["compound-has-content:s-3"]), (plus(relation("r9", "requires", "s-1", "s-3", 0.9)), ["compound-has-content:s-3"]),
    (change("s-3a", kind="unassigned"), ["untyped:s-3a"]), (change("s-1", form_of("s-1", words="-")), ["form-missing-field:s-1"]), (change("s-1", form_of("s-1", words="weeds")), ["form-not-in-text:s-1"]), (change("s-1", form_of("s-1", count=13)), ["form-not-in-text:s-1"]),
    (change("s-1", form_of("s-1", amount={"value": 40, "unit": "km"})), ["form-not-in-text:s-1"]), (change("s-1", form_of("s-1", eq="4")), ["form-not-in-text:s-1"]), (change("s-1", form_of("s-1", sign="left")), ["form-invalid-field:s-1"]), (change("s-1", form_of("s-1", clear=1)), ["form-invalid-field:s-1"]),
    (change("s-1", form_of("s-1", other=1)), ["form-invalid-field:s-1"]), (change("s-1", form_of("s-1", where={"depth": [3, 1]})), ["form-invalid-field:s-1"]), (change("s-1", form_of("s-1", where={"height": [1, 3]})), ["form-invalid-field:s-1"]), (change("s-1", {"form": 3}), ["form-invalid-field:s-1"]), (change("g-1", {"form": {}}), ["form-invalid-field:g-1"]),
    (plus(drop=["r2"]), ["rests-on-missing:s-2"]), (change("s-1", form_of("s-1", where={"depth": [-1, 50]})), ["out-of-domain:s-1"]), (change("s-2", form_of("s-2", where={"depth": [20, 60]})), ["scope-exceeds-support:s-2"]), (change("s-2", form_of("s-2", where={"depth": [20, None]})), ["out-of-domain:s-2", "scope-exceeds-support:s-2"]), (change("s-2", form_of("s-2", where={"year": [1, 2]})), []),
    (change("s-1", form_of("s-1", amount={"value": 12, "unit": "reeds"})), ["unit-mismatch:s-2"]), (change("s-1", drop=["assessment"]), ["unassessed:s-1"]), (change("s-1", {"assessment": {"verdict": "maybe"}}), ["unassessed:s-1"]), (change("s-1", {"assessment": {"verdict": "holds", "by": "me"}}), ["unassessed:s-1"]),
    (change("s-2", {"assessment": {"verdict": "not_assessed", "reason": " "}}), ["missing-reason:s-2"]), (change("s-2", {"assessment": {"verdict": "fails"}}), ["no-evidence:s-2"]), (plus(relation("w", "seen-by", "e", "s-2"), nodes=[node("e", kind="seen", attributes='{"origin": "evidence"}')]), []),
    (change("s-2", base=None), ["compile-error:graph"]), (change("s-1", base=credence(0.75)), ["credence-not-rubric:s-1"]), (change("g-1", base=credence(0.4)), ["credence-not-rubric:g-1"]), (plus(relation("r1", "requires", "s-1", "s-2", 0.8), drop=["r1"]), ["credence-not-rubric:r1"]), (plus(relation("r2", "requires", "g-1", "s-2", 0.9), drop=["r2"]), ["credence-not-rubric:r2"]),
    (plus(relation("o1", "observes", "s-1", "c-1", None, 0.9, 0.2), drop=["o1"]), ["credence-not-rubric:o1"]), (plus(relation("r9", "supports", "s-1", "g-1", 0.5)), ["relation-not-allowed:r9"]), (change("c-1", {"check": {"result": "failed"}}), ["check-unobserved-invalid:c-1"]), (change("c-1", {"check": {"result": "odd"}}), ["check-unobserved-invalid:c-1"]),
    (change("c-1", {"check": {"result": "error"}}), ["check-unobserved-invalid:c-1"]), (change("c-1", {"check": {"result": "error"}}, drop=["observed"]), []), (change("s-1", {"observed": True}), ["check-unobserved-invalid:s-1"]),
]


def test_a_sound_graph_passes_and_each_defect_is_named():
    assert codes(sound()) == []
    seen = set()
    for i, (g, want) in enumerate(DEFECTS):
        got = codes(g)
        if want[-1:] == ["part-of"]:  # further consequences, not listed
            assert got[0] == want[0]
        else:
            assert [c for c in want if c not in got] == [] and (bool(got) == bool(want)), (i, got, want)
        seen |= {c.split(":")[0] for c in got}
    assert seen == {c for own in rubric.CODES.values() for c in own}


def test_levels_nest():
    g = change("s-1", {"assessment": {"verdict": "maybe"}, "form": {}}, sources=[])
    assert codes(g, "anchored", False) == ["anchor-invalid:s-1"]
    assert codes(g, "typed", False) == ["anchor-invalid:s-1", "form-missing-field:s-1"]
    assert codes(g, "assessed", False) == ["anchor-invalid:s-1", "form-missing-field:s-1", "unassessed:s-1"]
    with pytest.raises(ValueError):
        codes(g, "all")


@pytest.mark.parametrize(
    ("old", "new", "place"),
    [
        ("format = 2", "format = 3", "rubric.format"), ("format = 2", "format = true", "rubric.format"), ("format = 2", "format = 1", "the rubric"), ('version = "3"', "version = 3", "rubric.version"), ('status = "calibrated"', 'status = "done"', "calibration.status"),
        ("date = 2025-01-31", "date = 2025-01-31T00:00:00", "calibration.date"), ("domain = [0, 500]", "domain = [5, 0]", "parameters.depth.domain"), ("domain = [0, 500]", "domain = [nan, 0]", "parameters.depth.domain"), ('sentence = "remark"', 'sentence = "seen"', "initial.sentence"),
        ("[types.remark]", "[types.compound]", "types.compound"), ("assess = true", "assess = 1", "types.reading.assess"), ("assess = true", "asess = true", "types.reading"), ('"beta:6,2"', '"beta:6"', "types.reading.base"), ("base = 0.4", "base = 1.4", "types.guess.base"),
        ('values = ["up", "down"]', 'values = ["up", "up"]', "types.reading.form.sign.values"), ('type = "bool" }', 'type = "bool", values = ["x"] }', "types.reading.form.clear"), ('type = "bool"', 'type = "flag"', "types.reading.form.clear.type"), ('["reading", "guess"]', '["reading", "idea"]', "types.verdict.rests_on.types[1]"),
        ("min = 2", "min = 0", "types.verdict.rests_on.min"), ('relation = "requires"', 'relation = "refutes"', "types.verdict.rests_on.relation"), ("[checks.recount]", "[checks.guess]", "checks.guess"), ("sensitivity = 0.9", "sensitivity = 0.1", "checks.recount"), ("models = []", 'models = "m"', "checks.recount.models"),
        ('for = ["verdict"]', "for = []", "premises.for"), ("max_per_conclusion = 2", "max_per_conclusion = 2.5", "premises.max_per_conclusion"), ('"Perhaps  so" = 0.5', '"Perhaps  so" = 0.5\n"perhaps so" = 0.4', "hedges.perhaps so"), ('"Perhaps  so"', '"  "', "hedges.  "), ("[rubric]", "[rubric", "not TOML"), ("[hedges]", "[hedge]", "the rubric"),
    ],
)
def test_rubric_rules(old, new, place):
    assert old in TOML
    with pytest.raises(rubric_file.RubricError) as e:
        rubric_file.rubric_from_text(TOML.replace(old, new, 1))
    assert str(e.value).startswith(place)


def test_rubric_contents(spark, tmp_path):
    assert RUBRIC["parameters"]["year"]["domain"] == (None, None) and RUBRIC["types"]["verdict"]["base"] == credence(None, 3.0, 3.0) and RUBRIC["types"]["recount"]["origins"] == ["evidence"]
    assert rubric_file.hedge_credence(RUBRIC, " PERHAPS so")["p"] == 0.5 and rubric_file.hedge_credence(RUBRIC, "never") is None
    (tmp_path / "r.toml").write_text(TOML)
    assert rubric_file.read_rubric(spark, str(tmp_path / "r.toml")) == RUBRIC
    assert rubric_file.credence_from("0.3")["p"] == 0.3 and rubric_file.credence_from("nan") is None and rubric_file.credence_from("gamma:1,2") is None


def tables(spark, graphs):
    from beliefmesh.operators.compiler import NODE, RELATION

    schema = lambda kind: "graph_id long, " + ", ".join(f"{k} {v}" for k, v in kind.items())
    rows = lambda what, kind: [tuple([i] + [o if k == "ord" else x.get(k) for k in kind]) for i, g in enumerate(graphs) for o, x in enumerate(g[what])]
    return spark.createDataFrame(rows("nodes", NODE), schema(NODE)), spark.createDataFrame(rows("relations", RELATION), schema(RELATION))


def test_many_graphs_and_coverage(spark):
    broken = sound()
    broken["nodes"][0]["attributes"] = "{"
    graphs = [sound(), DEFECTS[1][0], broken, change("s-1", drop=["assessment"])]
    nodes, relations = tables(spark, graphs)
    got = {}
    for r in rubric.check(nodes, relations, RUBRIC, "assessed", True).orderBy("graph_id", "ord").collect():
        got.setdefault(r["graph_id"], []).append(r["id"])
    assert got == {1: codes(graphs[1]), 2: ["error:malformed"], 3: codes(graphs[3])}
    cover = {r["graph_id"]: r for r in rubric.coverage(*tables(spark, [sound(), graphs[3]]), RUBRIC).collect()}
    assert cover[0]["n_nodes"] == 7 and cover[0]["by_origin"] == {"document": 5, "analyst": 1, "evidence": 1} and [(x["type"], x["count"], x["share"]) for x in cover[0]["by_type"]] == [("reading", 1, 0.2), ("verdict", 1, 0.2), ("compound", 1, 0.2), ("remark", 2, 0.4)]
    assert cover[0]["not_assessed"] == {"s-2": "no time"} and cover[1]["unexamined"] == ["s-1"] and cover[0]["untyped"] == []


def fails(code, f, *args, **more):
    with pytest.raises(edits.EditError) as e:
        f(*args, **more)
    assert e.value.args[0] == code


def test_split():
    g = {"nodes": [chunk("s-1", "Rain fell. Rain rose, then fell."), chunk("s-2", "Else.")], "relations": []}
    out, new = edits.split(g, "s-1", ["Rain fell", "rose"])
    assert new == ["s-1a", "s-1b"] and [n["id"] for n in out["nodes"]] == ["s-1", "s-1a", "s-1b", "s-2"] and [r["id"] for r in out["relations"]] == ["s-1a-part-of-s-1", "s-1b-part-of-s-1"]
    assert out["nodes"][2]["sources"][0]["locator"] == "file=a;lines=1-1;chars=16-20" and g["nodes"][0]["kind"] == "remark"
    assert [f["diagnostic"] for f in rubric.check_graph(out, RUBRIC, "anchored")] == []
    more, third = edits.split(out, "s-1", [], True)
    assert third == ["s-1c"] and [n["id"] for n in more["nodes"]][:4] == ["s-1", "s-1a", "s-1b", "s-1c"]
    fails("invalid-argument", edits.split, g, "s-1", ["fell"])
    fails("invalid-argument", edits.split, g, "s-1", [""])
    fails("invalid-argument", edits.split, g, "s-1", [])
    fails("not-splittable", edits.split, out, "s-1a", ["Rain"])
    fails("not-splittable", edits.split, sound(), "s-1", ["We"])
    fails("not-splittable", edits.split, sound(), "g-1", ["We"])
    fails("unknown-node", edits.split, g, "s-9", ["We"])


def test_annotate():
    g = {"nodes": [chunk("s-1", READING), chunk("s-2", "Reeds grow."), node("g", 0.4, kind="guess", attributes='{"origin": "analyst"}'), node("n", 0.1)], "relations": []}
    out = edits.annotate(g, RUBRIC, "s-1", kind="reading", settings={"words": "reeds", "count": 12}, verdict="holds")
    first = out["nodes"][0]
    assert first["base"] == credence(None, 6.0, 2.0) and json.loads(first["attributes"])["form"] == {"words": "reeds", "count": 12} and json.loads(first["attributes"])["assessment"] == {"verdict": "holds"}
    out = edits.annotate(out, RUBRIC, "s-1", settings={"sign": "up"})
    assert set(json.loads(out["nodes"][0]["attributes"])["form"]) == {"words", "count", "sign"}
    out = edits.annotate(out, RUBRIC, "s-2", kind="verdict", rests_on=["s-1", "g", "s-1"], reason="later")
    assert [r["id"] for r in out["relations"]] == ["s-1-requires-s-2", "g-requires-s-2"] and out["relations"][0]["strength"] == credence(0.9)
    bare = edits.annotate(out, RUBRIC, "s-1", kind="unassigned")["nodes"][0]
    assert bare["base"] is None and set(json.loads(bare["attributes"])) == {"origin", "unit"}
    for code, name, more in [("unknown-type", "s-1", {"kind": "x"}), ("origin-not-allowed", "g", {"kind": "reading"}), ("origin-not-allowed", "g", {"kind": "unassigned"}), ("form-invalid-field", "s-1", {"settings": {"count": "12"}}), ("form-not-in-text", "s-1", {"settings": {"count": 13}}), ("invalid-argument", "s-1", {"verdict": "holds", "reason": "x"}), ("invalid-argument", "s-1", {"reason": " "}), ("invalid-argument", "s-1", {"verdict": "maybe"}), ("rests-on-missing", "s-1", {"rests_on": ["g"]}), ("duplicate-id", "s-2", {"rests_on": ["g"]}), ("rests-on-missing", "s-2", {"rests_on": ["s-2"]}), ("origin-invalid", "n", {"kind": "guess"}), ("unknown-node", "s-7", {})]:
        fails(code, edits.annotate, out, RUBRIC, name, **more)


def test_add_relate_and_tables_of_edits(spark):
    g = {"nodes": [node("claim-one", 0.5), node("b", 0.5)], "relations": []}
    out, near = edits.add_node(g, "claim-on", base=credence(0.3))
    assert near == ["claim-one"] and [n["id"] for n in out["nodes"]] == ["claim-one", "b", "claim-on"]
    fails("duplicate-id", edits.add_node, g, "b")
    linked = edits.relate(out, "r", "requires", "b", "claim-one", strength=credence(0.5))
    fails("cycle", edits.relate, linked, "s", "supports", "claim-one", "b", strength=credence(0.5))
    fails("invalid-argument", edits.relate, out, "r", "requires", "b", "claim-one")
    fails("invalid-argument", edits.relate, out, "r", "exclusive", "b", "b")
    fails("invalid-argument", edits.relate, out, "r", "authored_by", "b", "claim-one", strength=credence(0.5))
    fails("unknown-node", edits.relate, out, "r", "cites", "b", "zz")
    nodes, relations = tables(spark, [sound(), {"nodes": [chunk("s-1", "Rain fell. It rose.")], "relations": []}, {"nodes": [node("a", 0.5)], "relations": []}])
    todo = spark.createDataFrame([(1, 0, json.dumps({"do": "split", "name": "s-1", "clauses": ["Rain fell", "It rose"]})), (1, 1, json.dumps({"do": "annotate", "name": "s-1a", "kind": "remark"})), (2, 0, json.dumps({"do": "relate", "name": "r", "kind": "supports", "source": "a", "target": "q", "strength": credence(0.5)}))], "graph_id long, ord int, edit string")
    done = edits.edited(nodes, relations, todo, RUBRIC).cache()
    got = {r["graph_id"]: r for r in done.collect()}
    assert got[0]["error"] is None and len(got[0]["nodes"]) == 7 and got[2]["error"].startswith("unknown-node")
    assert [(n["id"], n["kind"]) for n in got[1]["nodes"]] == [("s-1", "compound"), ("s-1a", "remark"), ("s-1b", "unassigned")]
    assert rubric.check(*edits.apart(done.where("graph_id = 1")), RUBRIC, "anchored").count() == 0
