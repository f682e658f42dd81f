"""Write rules by defect; cycles, components and numbering against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_compiler import credence, graph, node, relation
from test_rubric import tables

from beliefmesh.operators import graphs, rules

FORMAL = {"kind": "formal", "theorem": "T"}
RUN = {"digest": "sha256:" + "a" * 64, "status": 0}
DISCHARGES = [
    (FORMAL, []), ({"kind": "symbolic", "script": "a.py"}, []), ({"kind": "symbolic", "script": "a.py", **RUN}, []), ({"kind": "numerical", "script": "a.py", "value": 1, "tolerance": 0.1}, []), ({"kind": "judgement"}, []), ({"kind": "citation", "anchor": {"document": "d", "quote": "q"}}, []), (None, []),
    ({"kind": "belief"}, ["discharge-kind"]), ({"kind": "formal"}, ["discharge-lacks"]), ({**FORMAL, "script": "a.py"}, ["discharge-takes-no"]), ({**FORMAL, "note": 1}, ["discharge-takes-no"]), ({"kind": "symbolic", "script": "a.sh"}, ["discharge-script"]), ({"kind": "symbolic", "script": "a.py", "status": 0}, ["discharge-run"]),
    ({"kind": "symbolic", "script": "a.py", **RUN, "digest": "sha256:A"}, ["discharge-digest"]), ({"kind": "symbolic", "script": "a.py", **RUN, "status": 1.5}, ["discharge-status"]), ({"kind": "symbolic", "script": "a.py", **RUN, "status": True}, ["discharge-status"]), ({"kind": "numerical", "script": "a.py", "value": 1, "tolerance": 0}, ["discharge-tolerance"]),
    ({"kind": "numerical", "script": "a.py", "value": True, "tolerance": 1}, ["discharge-value"]), ({"kind": "citation", "anchor": {"document": "d"}}, ["discharge-quote"]), ({"kind": "numerical", "script": "a.py", "value": 1}, ["discharge-lacks"]),
]


def found(spark, *graphs_):
    out = [[] for _ in graphs_]
    for r in rules.violations(*tables(spark, graphs_)).collect():
        out[r["graph_id"]].append((r["item"], r["code"]))
    return [sorted(x) for x in out]


def test_obligations(spark):
    base = [node("a", 0.5), node("b", 0.5)]
    cases = []
    for d, _ in DISCHARGES:
        r = relation("r", "supports", "a", "b", 0.5)
        r["obligation"] = json.dumps({"statement": "s", "discharge": d})
        cases.append(graph(base, [r]))
    for text in ('{"statement": ""}', "[]", "{", '{"statement": "s", "why": 1}'):
        cases.append(graph(base, [{**relation("r", "supports", "a", "b", 0.5), "obligation": text}]))
    got = found(spark, *cases)
    assert got[: len(DISCHARGES)] == [[("r", f"relation-{c}") for c in want] for _, want in DISCHARGES]
    assert [x[0][1] for x in got[len(DISCHARGES) :]] == ["relation-obligation-statement"] * 3 + ["relation-obligation-unknown-field"]


def test_rows_and_graphs(spark):
    a, b = node("a", 0.5), node("b", 0.5)
    one = lambda *x: graph([a, b], x)
    cases = [
        (one(relation("r", "supports", "a", "b", 0.5), relation("n", "cites", "a", "a")), []), (one(relation("r", "supports", "a", "b")), [("r", "relation-strength-missing")]), (one(relation("r", "cites", "a", "b", 0.5)), [("r", "relation-strength-not-allowed")]), (one(relation("r", "equivalent", "a", "b", 0.5)), [("r", "relation-strength-not-allowed")]),
        (one(relation("r", "observes", "a", "b", None, 0.9)), [("r", "relation-false-pass-missing")]), (one(relation("r", "supports", "a", "b", 0.5, 0.9)), [("r", "relation-sensitivity-not-allowed")]), (one(relation("r", "exclusive", "a", "a")), [("r", "relation-self-relation")]), (one(relation("r", "supports", "a", "b", 1.5)), [("r", "relation-strength-range")]),
        (one(relation("r", "supports", "a", "b", credence(None, 0.0, 1.0))), [("r", "relation-strength-range")]), (one(relation("r", "supports", "a", "b", credence(0.5, 1.0, 1.0))), [("r", "relation-strength-range")]), (one({**relation("r", "cites", "a", "b"), "obligation": '{"statement": "s"}'}), [("r", "relation-obligation-not-allowed")]),
        (one(relation("r", "supports", "a", "z", 0.5)), [("r", "dangling")]), (one(relation("r", "supports", "a", "b", 0.5), relation("r", "cites", "a", "b")), [("r", "duplicate-relation")]), (graph([a, a, b]), [("a", "duplicate-node")]), (graph([{**a, "attributes": "[1]"}]), [("a", "node-attributes")]), (graph([{**a, "attributes": '{"x": NaN}'}]), [("a", "node-attributes")]),
        (graph([{**a, "kind": ""}]), [("a", "node-kind")]), (graph([{**a, "statement": ""}]), [("a", "node-statement")]), (graph([node("", 0.5)]), [("", "node-id")]), (graph([node("a", 1.01)]), [("a", "node-base")]), (graph([{**a, "sources": [{"document": "", "locator": None, "quote": "", "digest": None}]}]), [("a", "node-source-document"), ("a", "node-source-quote")]),
        (one(relation("r", "supports", "a", "b", 0.5), relation("s", "requires", "b", "a", 0.5)), [("a r b s a", "cycle")]), (one(relation("r", "supports", "a", "a", 0.5)), [("a r a", "cycle")]), (one(relation("r", "", "a", "b")), [("r", "relation-type")]),
    ]
    assert found(spark, *(g for g, _ in cases)) == [want for _, want in cases]


def edges(spark, rows):
    return spark.createDataFrame(rows, "graph_id long, source string, target string").withColumn("type", F.lit("requires"))


def test_nodes_between_cycles_are_not_on_one(spark):
    rows = [(1, "a", "b"), (1, "b", "a"), (1, "a", "x"), (1, "x", "c"), (1, "c", "d"), (1, "d", "c"), (2, "a", "b"), (2, "b", "c"), (3, "s", "s")]
    assert {(r["graph_id"], r["node"]) for r in graphs.cycle_nodes(edges(spark, rows)).collect()} == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (3, "s")}
    paths = {r["graph_id"]: r["path"] for r in graphs.cycles(edges(spark, rows)).where("graph_id != 1").collect()}
    assert paths == {3: ["s", "s>s", "s"]}
    assert graphs.cycles(edges(spark, rows).where("false")).count() == 0
    long = edges(spark, [(1, f"n{i:05}", f"n{i + 1:05}") for i in range(3000)])
    assert graphs.cycle_nodes(long).count() == 0


def test_random_cycles_against_reachability(spark):
    rng, rows, want = random.Random(2), [], set()
    for g in range(30):
        n = rng.randint(1, 8)
        own = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 12))}
        reach = [[(i, j) in own for j in range(n)] for i in range(n)]
        for k in range(n):
            for i in range(n):
                for j in range(n):
                    reach[i][j] |= reach[i][k] and reach[k][j]
        want |= {(g, f"v{i}") for i in range(n) if reach[i][i]}
        rows += [(g, f"v{i}", f"v{j}") for i, j in own]
    assert {(r["graph_id"], r["node"]) for r in graphs.cycle_nodes(edges(spark, rows)).collect()} == want
    for r in graphs.cycles(edges(spark, rows)).collect():
        steps = r["path"][::2]
        assert steps[0] == steps[-1] and set(steps) <= set(r["nodes"]) and all((r["graph_id"], a, b) in rows for a, b in zip(steps, steps[1:], strict=False))


def test_components_stay_within_their_graph(spark):
    links = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "b", "d"), (2, "x", "x")], "graph_id long, a string, b string")
    assert {tuple(r) for r in graphs.components(links).collect()} == {(1, "b", "a"), (1, "c", "a"), (2, "d", "b")}
    assert {tuple(r) for r in graphs.components(links.drop("graph_id")).collect()} == {("b", "a"), ("c", "a"), ("d", "a")}


@pytest.mark.parametrize("slices", [2, 64])
def test_numbering(spark, slices):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice("ab"), rng.randrange(10**6)) for i in range(2000)] + [(None, 5), (None, None)]
    got = graphs.numbered(spark.createDataFrame(rows, "g string, k long"), "g", "k", "n", slices).collect()
    for g in {x[0] for x in rows}:
        own = sorted(((r["k"] if r["k"] is not None else -1, r["n"]) for r in got if r["g"] == g), key=lambda x: x[1])
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and [k for k, _ in own] == sorted(k for k, _ in own)
    graphs.release(spark)
    assert graphs.SCRATCH == []
