"""Obligations: which scripts can fail, what a target still rests on, re-checking."""

import hashlib
import json

import pytest
from test_compiler import credence, graph, node, relation
from test_rubric import tables

from beliefmesh.operators import diagnostics, obligations

CAN = ["assert x == 1", "raise ValueError", "import sys\nsys.exit(1)", "exit(code)", "if n > 0:\n    assert False", "assert not True", "while True:\n    raise OSError", "f(exit(2) if a else 0)", "if True:\n    assert x", "def f():\n    quit('bad')", "import os\nos._exit(3)", "try:\n    pass\nfinally:\n    assert x"]
CANNOT = ["", "print(1)", "assert True", "assert 1", "if False:\n    assert x", "if 0:\n    raise E\nelse:\n    pass", "while False:\n    raise E", "if not True:\n    assert x", "if (False if True else True):\n    assert x", "import sys\nsys.exit()", "import sys\nsys.exit(0)", "exit(None)", "assert (True if True else x)", "def (", "x = (f(exit(1)) if False else 0)", "if True:\n    pass\nelse:\n    raise E", "my.exit(1)"]


def test_can_fail(spark):
    assert all(map(obligations.source_can_fail, CAN)) and not any(map(obligations.source_can_fail, CANNOT))
    df = spark.createDataFrame([(s,) for s in CAN + CANNOT + [None]], "s string")
    assert [r["c"] for r in df.select(obligations.can_fail("s").alias("c")).collect()] == [True] * len(CAN) + [False] * len(CANNOT) + [None]


def owed(name, kind, source, target, discharge="none", strength=0.5):
    r = relation(name, kind, source, target, strength)
    if discharge != "none":
        r["obligation"] = json.dumps({"statement": f"{name} holds", "discharge": discharge})
    return r


def argument():
    nodes = [node(k, 0.5) for k in "abcdefgz"] + [node("t", 0.3)]
    script = lambda status, path="ok.py": {"kind": "symbolic", "script": path, "digest": "sha256:" + "0" * 64, "status": status}
    relations = [
        owed("ra", "supports", "a", "t", {"kind": "formal", "theorem": "T"}), owed("rb", "requires", "b", "t", {"kind": "judgement"}, 0.9), owed("rc", "supports", "c", "t", strength=0.1), owed("rd", "supports", "d", "a", None),
        owed("re", "supports", "e", "t", script(0)), owed("rf", "supports", "f", "t", script(1)), owed("rg", "supports", "g", "t", {"kind": "symbolic", "script": "ok.py"}), owed("rh", "supports", "g", "a", script(0, "gone.py")), owed("ri", "supports", "f", "a", script(0, "idle.py")),
        relation("q", "equivalent", "d", "e"), owed("rz", "supports", "t", "z"), owed("rx", "requires", "b", "z"),
    ]
    return graph(nodes, relations)


SCRIPTS = {"ok.py": "assert f()", "idle.py": "print(1)"}


def test_sorries():
    rows = diagnostics.lockstep([obligations.sorries_of(argument(), "t", SCRIPTS)])[0]
    why = {r["relation"]: r["reason"] for r in rows}
    assert why == {"rb": "judgement", "rc": "no-obligation", "rd": "undischarged", "rf": "recorded-failure", "rg": "never-run", "rh": "missing-script", "ri": "cannot-fail", "q": "no-obligation", "ra": None, "re": None}
    ranked = [abs(r["sensitivity"]) for r in rows if r["reason"] and r["sensitivity"] is not None]
    assert ranked == sorted(ranked, reverse=True) and rows[len(ranked)]["relation"] == "q" and [r["relation"] for r in rows[-2:]] == ["ra", "re"]
    assert [r["ord"] for r in rows] == list(range(len(rows))) and rows[0]["obligation"] == f"{rows[0]['relation']} holds" or rows[0]["obligation"] is None
    # an exclusive relation is a step from both of its ends, and what it touches counts as reached
    g = graph([node("t", 0.5), node("u", 0.5), node("v", 0.5)], [relation("x", "exclusive", "u", "t"), relation("r", "requires", "v", "u", 0.5)])
    assert obligations.steps_of(g, "t") == {"x", "r"} and obligations.steps_of(g, "v") == set()


def test_sorries_of_tables(spark):
    nodes, relations = tables(spark, [argument(), graph([node("t")], [relation("r", "supports", "t", "t", 0.5)])])
    targets = spark.createDataFrame([(0, "t"), (0, "z"), (0, "nobody"), (1, "t")], "graph_id long, target string")
    scripts = spark.createDataFrame([(0, k, v) for k, v in SCRIPTS.items()], "graph_id long, path string, source string")
    got = obligations.sorries(nodes, relations, targets, scripts).collect()
    assert {r["relation"] for r in got if r["target"] == "t" and r["graph_id"] == 0 and r["reason"] is None} == {"ra", "re"}
    assert {(r["graph_id"], r["target"], r["error"]) for r in got if r["error"]} == {(0, "nobody", "unknown-node"), (1, "t", "missing-base")}


def test_verify(spark, tmp_path):
    write = lambda name, source: ((tmp_path / name).write_text(source), "sha256:" + hashlib.sha256(source.encode()).hexdigest())[1]
    ok, bad, near, idle, slow = (write(n, s) for n, s in [("ok.py", "assert 1 + 1 == int('2')"), ("bad.py", "import sys\nsys.exit(int('3'))"), ("near.py", "assert int('1')\nprint('about')\nprint(2.04)"), ("idle.py", "print('x')"), ("slow.py", "import time\ntime.sleep(30)\nassert x")])
    num = {"kind": "numerical", "script": "near.py", "digest": near, "status": 0}
    script = lambda path, digest, status: {"kind": "symbolic", "script": path, "digest": digest, "status": status}
    quote = lambda q, digest=None, document="paper": {"kind": "citation", "anchor": {"document": document, "locator": None, "quote": q, "digest": digest}}
    from beliefmesh.functions import text

    cases = {
        "a": (script("ok.py", ok, 0), "passed", []), "b": (script("ok.py", bad, 0), "flagged", ["script-changed"]), "c": (script("bad.py", bad, 0), "flagged", ["contradicted"]), "d": (script("bad.py", bad, 3), "flagged", ["check-failed"]), "e": ({"kind": "symbolic", "script": "ok.py"}, "flagged", ["never-run"]),
        "f": (script("none.py", ok, 0), "flagged", ["missing-script"]), "g": ({**num, "value": 2.0, "tolerance": 0.05}, "passed", []), "h": ({**num, "value": 2.0, "tolerance": 0.01}, "flagged", ["out-of-tolerance"]), "i": ({"kind": "numerical", "script": "idle.py", "digest": idle, "status": 0, "value": 1.0, "tolerance": 1.0}, "flagged", ["cannot-fail", "result-missing"]),
        "j": (script("slow.py", slow, 0), "flagged", ["contradicted"]), "k": (quote("two  reeds"), "passed", []), "l": (quote("three reeds"), "flagged", ["quote-not-found"]), "m": (quote("two reeds", "sha256:" + "1" * 64), "flagged", ["quote-digest-mismatch"]), "n": (quote("two reeds", text.digest_of("two reeds")), "passed", []), "o": (quote("x", None, "elsewhere"), "unchecked", []),
        "p": ({"kind": "formal", "theorem": "T"}, "unchecked", []), "q": ({"kind": "judgement"}, "judgement", []),
    }
    rows = [(1, k, json.dumps({"statement": "s", "discharge": d})) for k, (d, _, _) in cases.items()] + [(1, "y", None), (1, "z", json.dumps({"statement": "s", "discharge": None}))]
    relations = spark.createDataFrame(rows, "graph_id long, id string, obligation string")
    documents = spark.createDataFrame([("paper", "There were two\n reeds.")], "document string, text string")
    got = {r["relation"]: (r["outcome"], r["findings"]) for r in obligations.verify(spark, relations, documents, str(tmp_path), 3.0).collect()}
    assert got == {k: (o, f) for k, (_, o, f) in cases.items()}
    idle_run = {r["relation"]: r["outcome"] for r in obligations.verify(spark, relations, documents).collect()}
    assert {k for k, o in idle_run.items() if o == "unchecked"} == set("abcdefghijop") and idle_run["k"] == "passed"


def test_rules_hold_for_credences():
    assert diagnostics.mean(credence(None, 1.0, 3.0)) == pytest.approx(0.25)


def test_sorries_take_what_a_target_rests_on():
    """Not all parameters of the graph for each of its targets: 1200 targets of one graph took its square, and more, in memory."""
    n = 1200
    g = graph([node("root", 0.9), *(node(f"s{i}", 0.5) for i in range(n))], [owed(f"f{i}", "requires", "root", f"s{i}", {"kind": "judgement"}, 0.5) for i in range(n)])
    owing = obligations.Owed(g, {})
    diagnostics.lockstep([owing.impossible()])
    asked = []
    for i in range(n):
        run = obligations.sorries_of(g, f"s{i}", {}, owing)
        asked.append(next(run))
    assert all(len(requests) == 6 and len(requests[0][0]) == 2 for requests in asked)
    (row,) = diagnostics.lockstep([obligations.sorries_of(g, "s7", {}, owing)])[0]
    assert (row["relation"], row["reason"]) == ("f7", "judgement") and row["sensitivity"] == pytest.approx(-0.5 * 0.1)


def test_sorries_equal_the_whole_graphs_derivatives():
    """With constraints, also in another part of the graph, and steps below what is asked for."""
    g = argument()
    g["nodes"] += [node("u", 0.4), node("v", 0.6)]
    g["relations"] += [relation("x", "exclusive", "b", "c"), relation("y", "exclusive", "u", "v"), owed("ru", "supports", "u", "v", None)]
    for target in ("t", "z", "v"):
        rows = diagnostics.lockstep([obligations.sorries_of(g, target, SCRIPTS)])[0]
        network, carried, _ = obligations.compiler.compile_graph(g)

        def slopes(target=target, network=network, carried=carried):
            view = yield from diagnostics.View(g, network, carried, {}).begin()
            return [view, (yield from diagnostics.derivatives(view, view.target(target)))]

        view, found = diagnostics.lockstep([slopes()])[0]
        want = {p[1]: x for p, x in zip(view.parameters, found, strict=True) if p[0] == "strength"}
        own = {r["relation"]: r["sensitivity"] for r in rows if r["reason"] and r["sensitivity"] is not None}
        assert own and own == pytest.approx({k: want[k] for k in own}, abs=1e-12) and all(r["relation"] in own for r in rows if r["reason"] and r["relation"] in want)
