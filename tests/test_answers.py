"""Questions against brute force; arguments; remedies, each of them tried again."""

import json
import random

import numpy as np
import pytest
from test_compiler import credence, graph, node, random_graph, relation, worlds
from test_rubric import tables

from beliefmesh.operators import answers, compiler, diagnostics


def ask(g, kind="joint", target=None, given=None, do=None, overrides=None, observed=False, draws=0, seed=0):
    q = {"kind": kind, "target": target, "given": given, "do": do, "overrides": overrides}
    return diagnostics.lockstep([answers.question(answers.Ready(g), q, observed, draws, seed)])[0][0]


def test_random_questions():
    rng, done = random.Random(8), 0
    for _ in range(80):
        g = random_graph(rng)
        names = [k for ids in compiler.inference_sets(g).values() for k in ids]
        pick = lambda p: {k: rng.random() < 0.5 for k in names if rng.random() < p}
        target, given, do = {rng.choice(names): True}, pick(0.2), pick(0.1)
        got = ask(g, "intervene" if do else "joint", target, given, do)
        if got["code"] == "invalid-argument":
            continue
        total = worlds(g, given, do)
        if total <= 0:
            assert got["code"] == "zero-probability" and got["point"] is None
            continue
        root = {k: r for r, ids in compiler.inference_sets(g).items() for k in ids}
        clash = any(root[a] == root[b] and x != y for a, x in target.items() for b, y in given.items())
        assert got["point"] == pytest.approx(0.0 if clash else worlds(g, {**given, **target}, do) / total, rel=1e-9, abs=1e-13)
        done += 1
    assert done > 40


def chain():
    return graph([node("root", 0.9), node("mid", 0.05), node("top", 0.1, attributes="{}")], [relation("r", "requires", "root", "mid", 1.0), relation("s", "supports", "mid", "top", credence(None, 8.0, 2.0))])


def test_kinds_and_bands():
    g = chain()
    one = ask(g, "marginal", {"top": True}, draws=4000, seed=1)
    assert one["point"] == pytest.approx(0.1 + 0.9 * 0.045 * 0.8) and one["draws"] == 4000
    s = np.random.default_rng(9).beta(8, 2, 200_000)
    want = 0.1 + 0.9 * 0.045 * s
    assert [one[k] for k in ("q05", "q50", "q95", "mean_over_draws")] == pytest.approx([*np.quantile(want, [0.05, 0.5, 0.95]), want.mean()], abs=4e-4)
    assert ask(g, "conditional", {"root": True}, {"top": True})["point"] == pytest.approx(0.9 * (0.1 + 0.9 * 0.05 * 0.8) / one["point"])
    assert ask(g, "intervene", {"top": True}, None, {"root": False})["point"] == pytest.approx(0.1)
    assert ask(g, "marginal", {"root": True}, draws=50)["q05"] == pytest.approx(0.9)  # drawn, though it can't move
    assert ask(graph([node("a", 0.5)]), "marginal", {"a": True}, draws=50)["q05"] is None
    # a replaced Beta moves the point alone, a replaced point both
    moved = ask(g, "marginal", {"top": True}, overrides={"strength:s": 0.0}, draws=50)
    assert moved["point"] == pytest.approx(0.1) and moved["q05"] > 0.1
    assert ask(g, "marginal", {"top": True}, overrides={"base:mid": 0.0}, draws=50)["q95"] == pytest.approx(0.1)
    assert ask(g, "marginal", {"mid": True}, {"mid": True})["point"] == 1.0 and ask(g, "marginal", {"mid": True}, {"mid": False})["point"] == 0.0


def test_errors():
    g = chain()
    g["nodes"].append(node("note"))
    for code, kind, more in [("invalid-argument", "odds", {}), ("invalid-argument", "marginal", {"target": {"top": True, "mid": True}}), ("invalid-argument", "conditional", {}), ("invalid-argument", "intervene", {}), ("invalid-argument", "marginal", {"do": {"mid": True}}), ("unknown-node", "marginal", {"target": {"tip": True}}), ("invalid-argument", "marginal", {"target": {"note": True}}), ("invalid-argument", "intervene", {"do": {"mid": True}, "given": {"mid": False}}), ("invalid-argument", "marginal", {"overrides": {"base:zz": 0.5}}), ("invalid-argument", "marginal", {"overrides": {"base:mid": 1.5}})]:
        assert ask(g, kind, **{"target": {"top": True}, **more})["code"] == code, (kind, more)
    assert "did you mean top" in ask(g, "marginal", {"tops": True})["detail"]
    bad = ask(graph([node("a"), node("b", 0.5)], [relation("r", "supports", "a", "b", 0.5)]), "marginal", {"b": True})
    assert bad["code"] == "compile-error" and json.loads(bad["detail"])["errors"] == [{"code": "missing-base", "items": ["a"]}]
    seen = chain()
    seen["nodes"][2]["attributes"] = '{"observed": true}'
    assert ask(seen, "conditional", {"root": True}, observed=True)["point"] > 0.9 and ask(seen, "conditional", {"root": True}, {"top": False}, observed=True)["code"] == "invalid-argument"
    seen["nodes"][2]["attributes"] = '{"observed": 1}'
    assert ask(seen, "marginal", {"root": True}, observed=True)["code"] == "invalid-argument"
    twins = graph([node("a", 0.5), node("b")], [relation("e", "equivalent", "a", "b")])
    assert ask(twins, "conditional", {"a": True}, {"a": True, "b": False})["code"] == "invalid-argument"


def test_arguments():
    assert answers.parse_assignment(["a=true", "b=NO", "c=1"]) == {"a": True, "b": False, "c": True} and answers.parse_assignment(["x=y=0"]) == {"x=y": False}
    assert answers.parse_assignment(["a"], True) == {"a": True}
    for bad in (["a"], ["a=maybe"], ["=true"], ["a=true", "a=false"]):
        with pytest.raises(answers.QuestionError):
            answers.parse_assignment(bad)
    assert answers.parse_source("doi:1#x#p4")["locator"] == "p4" and answers.parse_source("doi:1")["locator"] is None
    for bad in ("", "#p", "d#"):
        with pytest.raises(answers.QuestionError):
            answers.parse_source(bad)


def test_remedies():
    # the premise is certain: that it is false can't be given
    g = graph([node("sure", 1.0), node("x", 0.5)], [relation("r", "requires", "sure", "x", 1.0)])
    found = json.loads(ask(g, "conditional", {"x": True}, {"sure": False})["detail"])
    assert found["move_any_one_of"] == ["base:sure"] and found["drop_any_one_of"] == [] and found["cause"] == ["given"]  # dropped, nothing would be given
    found = json.loads(ask(g, "joint", {"x": True}, {"sure": False})["detail"])
    assert found["drop_any_one_of"] == ["given sure=false"]
    # two of an exclusive pair
    g = graph([node("a", 0.5), node("b", 0.5), node("t", 0.5)], [relation("x", "exclusive", "a", "b"), relation("r", "supports", "a", "t", 0.5)])
    found = json.loads(ask(g, "joint", {"t": True}, {"a": True, "b": True})["detail"])
    assert found["drop_any_one_of"] == ["given a=true", "given b=true"] and found["exclusive_relation"] == "x" and found["uses_exclusive"] and found["extreme_parameters"] == []
    # two certain premises: no single move clears it, both together do
    g = graph([node("a", 1.0), node("b", 1.0), node("t", 0.5)], [relation("r", "requires", "a", "t", 0.5), relation("s", "requires", "b", "t", 0.5)])
    found = json.loads(ask(g, "joint", {"t": True}, {"a": False, "b": False})["detail"])
    assert found["move_any_one_of"] == [] and found["move_all_of"] == ["base:a", "base:b"] and found["drop_any_one_of"] == [] and found["drop_all_of"] == ["given a=false", "given b=false"] and found["tried"]["move"] == {"single": 2, "several": 1}
    # the graph itself is impossible
    g = graph([node("a", 1.0), node("b", 1.0)], [relation("x", "exclusive", "a", "b")])
    assert json.loads(ask(g, "marginal", {"a": True})["detail"]) == {"cause": "graph"}
    # a search that stops says so
    many = graph([node(f"n{i}", 1.0) for i in range(24)], [])
    found = json.loads(ask(many, "joint", {"n0": True}, {f"n{i}": False for i in range(24)})["detail"])
    assert found["truncated"] == ["drop", "move"] and found["tried"]["move"] == {"single": 24, "several": 256, "stopped_at": 2}
    # set and given fail together only
    g = graph([node("a", 0.5), node("b", 0.0)], [relation("r", "supports", "a", "b", 1.0)])
    found = json.loads(ask(g, "intervene", {"a": True}, {"b": True}, {"a": False})["detail"])
    assert found["cause"] == ["given and set"] and set(found["move_any_one_of"]) == {"base:b"} and found["drop_any_one_of"] == ["given b=true"]


def test_tables_of_questions(spark):
    nodes, relations = tables(spark, [chain(), graph([node("a", 0.25)])])
    questions = spark.createDataFrame([(0, 1, "marginal", {"top": True}, None), (0, 2, "conditional", {"root": True}, {"top": True}), (1, 1, "marginal", {"a": False}, None), (1, 2, "marginal", {"z": True}, None), (7, 1, "marginal", {"z": True}, None)], "graph_id long, question long, kind string, target map<string,boolean>, given map<string,boolean>")
    rows = {(r["graph_id"], r["question"]): r for r in answers.ask(nodes, relations, questions, draws=100).collect()}
    assert len(rows) == 5 and rows[1, 1]["point"] == 0.75 and rows[0, 1]["q05"] < rows[0, 1]["point"] < rows[0, 1]["q95"] and rows[1, 1]["q05"] is None
    assert rows[1, 2]["code"] == rows[7, 1]["code"] == "unknown-node"
    out = {(r["graph_id"], r["question"]): json.loads(r["json"]) for r in answers.answer_json(answers.ask(nodes, relations, questions, draws=100)).collect()}
    assert out[1, 1] == {"point": 0.75} and set(out[0, 1]) == {"point", "band", "mean_over_draws", "draws"}


def test_graphs_of_one_structure_are_answered_as_each_is_alone(spark, monkeypatch):
    """Also with evidence that is impossible in some of them, unknown nodes, overrides and Betas."""
    rng = random.Random(6)
    number = lambda k: rng.choice([0.0, 1.0, rng.random()]) if k % 5 == 0 else rng.random()
    beta = {"p": None, "alpha": 2.0, "beta": 3.0}
    graphs = []
    for k in range(90):
        nodes = [node(f"n{i}", number(k)) for i in range(4)] + [node("t", beta if k % 9 == 0 else number(k))]
        if k % 30 == 7:
            nodes[0]["attributes"] = json.dumps({"observed": True})
        graphs.append(graph(nodes, [relation(f"r{i}", rng.choice(["requires", "supports", "refutes"]), f"n{i}", "t", number(k)) for i in range(4)] + ([relation("x", "exclusive", "n0", "n1")] if k % 2 else [])))
    nodes, relations = tables(spark, graphs)
    asked = [("marginal", {"t": True}, {}, {}, {}), ("conditional", {"n1": True}, {"t": True, "n0": False}, {}, {}), ("intervene", {"t": True}, {}, {"n2": False}, {}), ("joint", {"n9": True, "t": True}, {}, {}, {})]
    rows = [(k, i, *q) for k in range(90) for i, q in enumerate([*asked, *([("marginal", {"t": True}, {}, {}, {"base:n0": 0.5})] if k % 10 == 3 else [])])]
    questions = spark.createDataFrame(rows, "graph_id long, question long, kind string, target map<string,boolean>, given map<string,boolean>, do map<string,boolean>, overrides map<string,double>")
    for observed in (False, True):
        got = {(r["graph_id"], r["question"]): r for r in answers.ask(nodes, relations, questions.coalesce(1), observed, draws=20).collect()}
        assert got.keys() == {r[:2] for r in rows}
        for k, i, *q in rows:
            want = ask(graphs[k], *q, observed=observed, draws=20)
            have = got[k, i].asDict()
            assert have["code"] == want["code"] and have["kind"] == q[0] and (have["detail"] or "")[:40] == (want["detail"] or "")[:40]
            for c in ("point", "q05", "q50", "q95", "mean_over_draws", "draws"):
                assert have[c] is want[c] is None or have[c] == pytest.approx(want[c], rel=1e-9, abs=1e-15)
    assert len({r["code"] for r in got.values()}) >= 3


def test_a_structure_is_asked_once(spark):
    """Before, every question of every graph was a generator of its own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    import pyarrow as pa

    schema = lambda s: to_arrow_schema(spark.createDataFrame([], f"graph_id long, {s}").schema)
    listed = lambda kind: "array<struct<" + ",".join(f"{k}:{v}" for k, v in kind.items()) + ">>"
    one = {"question": 1, "kind": "marginal", "target": [("t", True)], "given": None, "do": None, "overrides": None}
    rows = [{"graph_id": k, "questions": [one], "asked": "1", **graph([{**node("a", k / 100), "ord": 0}, {**node("t", 0.5), "ord": 1}], [{**relation("r", "requires", "a", "t", 0.5), "ord": 0}])} for k in range(100)]
    batch = pa.RecordBatch.from_pylist(rows, schema(f"questions {listed({'question': 'long', **answers.QUESTION})}, nodes {listed(compiler.NODE)}, relations {listed(compiler.RELATION)}, asked string"))
    calls = []
    found, left = answers.together(batch, lambda *x: calls.append(1) or answers.question(*x, False, 0, 0), False, schema(answers.ANSWER), schema(f"vars {compiler.VARS}, carried array<string>, errors {compiler.ERRORS}"))
    assert len(calls) == 1 and not left and [r["point"] for x in found for r in x.to_pylist()] == pytest.approx([0.5 * (1 - 0.5 * (1 - k / 100)) for k in range(100)])
