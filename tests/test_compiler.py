"""Compiled graphs against all worlds of the graph itself; errors; wide nodes."""

import itertools
import random

import pytest

from beliefmesh.operators import compiler, inference


def credence(p=None, alpha=None, beta=None):
    return {"p": p, "alpha": alpha, "beta": beta}


def node(name, base=None, **more):
    base = credence(base) if isinstance(base, (int, float)) else base
    return {"id": name, "kind": "proposition", "statement": None, "sources": None, "base": base, "stated": None, "attributes": None, **more}


def relation(name, kind, source, target, strength=None, sensitivity=None, false_pass=None):
    c = lambda x: credence(x) if isinstance(x, (int, float)) else x
    return {"id": name, "type": kind, "source": source, "target": target, "strength": c(strength), "sensitivity": c(sensitivity), "false_pass": c(false_pass), "attributes": None, "obligation": None}


def graph(nodes, relations=()):
    return {"nodes": list(nodes), "relations": list(relations)}


def worlds(g, holds, do=None):
    """Sum over all truth assignments to the graph's nodes, straight from the meaning of the relations: equivalent nodes
    agree, exclusive ones aren't both true, and each set's probability is that of its gates. holds: what is asked."""
    do = do or {}
    sets = compiler.inference_sets(g)
    root = {k: r for r, ids in sets.items() for k in ids}
    names = list(sets)
    base = {r: next((compiler.mean(n["base"]) for n in g["nodes"] if n["id"] in ids and n["base"]), None) for r, ids in sets.items()}
    cut = {root[k]: x for k, x in do.items()}
    total = 0.0
    for bits in itertools.product((False, True), repeat=len(names)):
        w = dict(zip(names, bits, strict=True))
        if any(r["type"] == "exclusive" and w[root[r["source"]]] and w[root[r["target"]]] for r in g["relations"]):
            continue
        if any(w[root[k]] != x for k, x in holds.items()):
            continue
        p = 1.0
        for k in names:
            if k in cut:
                one = float(cut[k])
            else:
                n = s = i = 1.0
                one = None
                for r in g["relations"]:
                    if r["type"] in compiler.ACYCLIC and root[r["target"]] == k:
                        on = w[root[r["source"]]]
                        if r["type"] == "observes":
                            one = compiler.mean(r["sensitivity"] if on else r["false_pass"])
                        else:
                            a = compiler.mean(r["strength"])
                            n *= 1 - a if r["type"] == "requires" and not on else 1
                            s *= 1 - a if r["type"] == "supports" and on else 1
                            i *= 1 - a if r["type"] == "refutes" and on else 1
                if one is None:
                    one = n * (base[k] * s + 1 - s) * i
            p *= one if w[k] else 1 - one
        total += p
    return total


def random_graph(rng, betas=False):
    value = lambda: credence(None, 1 + 3 * rng.random(), 1 + 3 * rng.random()) if betas and rng.random() < 0.5 else rng.choice([0.0, 1.0]) if rng.random() < 0.1 else rng.random()
    n = rng.randint(2, 6)
    nodes, relations = [], []
    for v in range(n):
        shared = value()
        twins = [f"v{v}"] + ([f"w{v}"] if rng.random() < 0.3 else [])
        for i, name in enumerate(twins):
            nodes.append(node(name, shared if i == 0 or rng.random() < 0.5 else None))
        if len(twins) == 2:
            relations.append(relation(f"e{v}", "equivalent", *rng.sample(twins, 2)))
        for u in rng.sample(range(v), rng.randint(0, min(v, 3))):
            for t in range(rng.randint(1, 2)):
                ends = [x["id"] for x in nodes if x["id"][1:] == str(u)]
                relations.append(relation(f"r{v}-{u}-{t}", rng.choice(compiler.STRENGTH), rng.choice(ends), rng.choice(twins), value()))
    for o in range(rng.randint(0, 2)):
        nodes.append(node(f"o{o}"))
        relations.append(relation(f"ob{o}", "observes", f"v{rng.randrange(n)}", f"o{o}", None, value(), value()))
    for x in range(rng.randint(0, 2)):
        a, b = rng.sample(range(n), 2)
        relations.append(relation(f"x{x}", "exclusive", f"v{a}", f"v{b}"))
    rng.shuffle(relations)
    nodes.append(node("note"))
    relations.append(relation("n1", "authored_by", "v0", "note"))
    return graph(nodes, relations)


def test_random_graphs_against_all_worlds():
    rng = random.Random(11)
    done = 0
    for _ in range(150):
        g = random_graph(rng, betas=True)
        network, carried, errors = compiler.compile_graph(g)
        assert not errors and carried == ["note"]
        names = [k for v in network for k in v["members"]]
        target, given, do = (dict([(rng.choice(names), rng.random() < 0.5)]) if rng.random() < p else {} for p in (1, 0.6, 0.4))
        got, error = inference.answer(network, target, given, do)
        root = {k: v["name"] for v in network for k in v["members"]}
        below = worlds(g, given, do)
        if below <= 0:
            assert error == "zero-probability"
            continue
        clash = any(root[a] == root[b] and x != y for a, x in target.items() for b, y in given.items())
        want = 0.0 if clash else worlds(g, {**given, **target}, do) / below
        assert error is None and got == pytest.approx(want, rel=1e-10, abs=1e-14)
        at = {v["name"]: i for i, v in enumerate(network)}
        if not clash:  # the textbook elimination agrees
            fix = {at[root[k]]: x for k, x in do.items()}
            seen = {at[root[k]]: x for k, x in {**given, **target}.items()}
            assert inference.mass(network, seen, fix) == pytest.approx(worlds(g, {**given, **target}, do), rel=1e-10, abs=1e-14)
        done += 1
    assert done > 100


def test_names_order_and_parameters():
    g = graph([node("b", 0.2), node("c", 0.3), node("a", 0.4), node("a2", 0.4), node("o")], [relation("r2", "supports", "b", "a2", 0.5), relation("e", "equivalent", "a2", "a"), relation("r1", "requires", "a", "c", 0.7), relation("ob", "observes", "c", "o", None, 0.8, 0.1)])
    network, carried, errors = compiler.compile_graph(g)
    assert [v["name"] for v in network] == ["b", "a", "c", "o"] and network[1]["members"] == ["a", "a2"] and not carried and not errors
    assert [p[:2] for p in compiler.parameters(g, network)] == [("base", "b"), ("base", "c"), ("base", "a"), ("strength", "r2"), ("strength", "r1"), ("sensitivity", "ob"), ("false_pass", "ob")]


def codes(*args):
    return [(e["code"], e["items"]) for e in compiler.compile_graph(graph(*args))[2]]


def test_errors_name_their_items():
    assert codes([node("a"), node("b", 0.1)], [relation("r", "requires", "a", "b", 0.5)]) == [("missing-base", ["a"])]
    assert codes([node("a", 0.1), node("b", 0.2)], [relation("e", "equivalent", "a", "b")]) == [("conflicting-bases", ["a", "b"])]
    # a point and a Beta of the same mean are different credences
    assert codes([node("a", 0.5), node("b", credence(None, 1.0, 1.0))], [relation("e", "equivalent", "a", "b")]) == [("conflicting-bases", ["a", "b"])]
    assert codes([node("a", 0.1), node("o", 0.2)], [relation("s", "observes", "a", "o", None, 0.9, 0.1)]) == [("observation-has-base", ["o", "o"])]
    assert codes([node("a", 0.1), node("o")], [relation("s", "observes", "a", "o", None, 0.9, 0.1), relation("t", "supports", "a", "o", 0.5)]) == [("observation-has-parents", ["o", "s", "t"])]
    assert codes([node("a", 0.1)], [relation("r", "supports", "a", "z", 0.5)]) == [("dangling", ["r"])]
    assert codes([node("a", 0.1), node("b", 0.1)], [relation("r", "supports", "a", "b")]) == [("missing-strength", ["r"])]
    merged = [node("a", 0.1), node("b", 0.2), node("c", 0.1)], [relation("r", "requires", "a", "b", 0.5), relation("s", "requires", "b", "c", 0.5), relation("e", "equivalent", "a", "c")]
    assert codes(*merged) == [("cycle", ["a", "r", "b", "s", "a"])]


def test_cycle_is_a_cycle_and_not_what_lies_between_two():
    edges = {"a": [("ab", "b"), ("ax", "x")], "b": [("ba", "a")], "x": [], "c": [("cd", "d"), ("cx", "x")], "d": [("dc", "c")]}
    assert compiler.cycle(edges) == ["a", "ab", "b", "ba", "a"]
    assert compiler.cycle({"s": [("sa", "a")], "a": [("ab", "b")], "b": [("bc", "c"), ("ba", "a")], "c": []}) == ["a", "ab", "b", "ba", "a"]
    assert compiler.cycle({"a": [("ab", "b"), ("ac", "c")], "b": [("bd", "d")], "c": [("cd", "d")], "d": []}) is None


def test_hubs_and_wide_nodes():
    n = 100
    hub = graph([node("h", 0.3)] + [node(f"o{i}") for i in range(n)], [relation(f"r{i}", "observes", "h", f"o{i}", None, 0.6, 0.5) for i in range(n)])
    network, _, _ = compiler.compile_graph(hub)
    got, error = inference.answer(network, {"h": True}, {f"o{i}": True for i in range(n)})
    assert error is None and got == pytest.approx(1 / (1 + 0.7 / 0.3 * (0.5 / 0.6) ** n))
    wide = graph([node(f"p{i}", 0.5) for i in range(70)] + [node("c", 1e-9)], [relation(f"r{i}", "supports" if i else "requires", f"p{i}", "c", 0.01) for i in range(70)])
    network, _, _ = compiler.compile_graph(wide)
    got, error = inference.answer(network, {"c": True})
    assert error is None and got == pytest.approx((1 - 0.005) * (1 - (1 - 1e-9) * (1 - 0.005) ** 69), rel=1e-12)
    tiny = graph([node("p", 0.5), node("c", 1e-30)], [relation("r", "supports", "p", "c", 0.0)])
    assert inference.answer(compiler.compile_graph(tiny)[0], {"c": True})[0] == pytest.approx(1e-30, rel=1e-12)
    # dense: each of 30 nodes rests on all before it
    dense = graph([node(f"v{i}", 0.5) for i in range(30)], [relation(f"r{i}-{j}", "supports", f"v{j}", f"v{i}", 0.1) for i in range(30) for j in range(i)])
    assert inference.answer(compiler.compile_graph(dense)[0], {"v29": True})[1] == "too-large"


def test_bad_networks_are_error_rows(spark):
    rows = [("a", [("x", 0.5, [])]), ("b", [("x", None, [])]), ("c", []), ("d", [("x", 0.5, [(7, "supports", 0.5, 0.0)])]), ("a", [("x", 0.25, [])])]
    df = spark.createDataFrame(rows, "graph_id string, vars array<struct<name:string,base:double,links:array<struct<parent:int,type:string,a:double,b:double>>>>")
    got = sorted((r["graph_id"], r["answer"], r["error"]) for r in inference.eliminate(df, {"x": True}).collect())
    assert got == [("a", 0.25, None), ("a", 0.5, None), ("b", None, "missing-parameter 'x'"), ("c", None, "unknown-node 'x'"), ("d", None, "unknown-parent 'x'")]
    # the fold over worlds keeps rows that share an id apart too
    assert sorted(r["answer"] for r in inference.enumerate_worlds(df.where("graph_id = 'a'"), "map('x', true)").collect()) == [0.25, 0.5]


def test_tables_of_many_graphs(spark):
    nodes = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "b", 0.1), (2, 0, "a", None), (2, 1, "b", 0.1), (3, 0, "a", 0.3)], "graph_id long, ord long, id string, base double")
    relations = spark.createDataFrame([(1, 0, "r", "requires", "a", "b", 0.5), (2, 0, "r", "requires", "a", "b", 0.5)], "graph_id long, ord long, id string, type string, source string, target string, strength double")
    got = {r["graph_id"]: r for r in compiler.compiled(nodes, relations).collect()}
    assert [v["name"] for v in got[1]["vars"]] == ["a", "b"] and got[2]["vars"] is None and got[2]["errors"][0]["code"] == "missing-base" and len(got[3]["vars"]) == 1
    answers = {r["graph_id"]: (r["answer"], r["error"]) for r in inference.eliminate(compiler.compiled(nodes, relations), {"b": True}).collect()}
    assert answers[1] == (pytest.approx(0.1 * 0.75), None) and answers[2][1] == "no-network" and answers[3][1] == "unknown-node 'b'"


def test_graphs_of_one_structure_compile_as_each_does_alone(spark):
    """Betas, observations, exclusions and what can't be compiled; equivalent nodes and structures of few graphs go one by one."""
    import random

    rng = random.Random(11)
    number = lambda: {"p": rng.random(), "alpha": None, "beta": None} if rng.random() < 0.6 else {"p": None, "alpha": 1 + rng.random(), "beta": 2.0}
    shapes = []
    for _ in range(9):
        n = rng.randint(2, 6)
        links = [(rng.choice(["strength", "strength", "observes", "exclusive", "cites", "equivalent"]), a, b) for b in range(1, n) for a in rng.sample(range(b), rng.randint(0, b))]
        shapes.append((n, links, {b for k, _, b in links if k == "observes"} | ({n - 1} if rng.random() < 0.2 else set())))
    graphs = []
    for k in range(160):
        n, links, bare = shapes[k % 9] if k else (0, [], set())
        nodes = [{"id": f"n{i}", "ord": i, "base": None if i in bare else number()} for i in range(n)]
        relations = [{"id": f"r{i}", "ord": i, "type": rng.choice(["requires", "supports", "refutes"]) if t == "strength" else t, "source": f"n{a}", "target": f"n{b}", "strength": number() if t == "strength" else None, "sensitivity": number() if t == "observes" else None, "false_pass": number() if t == "observes" else None} for i, (t, a, b) in enumerate(links)]
        graphs.append((nodes, relations))
    credence = "struct<p:double,alpha:double,beta:double>"
    nodes = spark.createDataFrame([(k, n["ord"], n["id"], n["base"]) for k, (own, _) in enumerate(graphs) for n in own], f"graph_id long, ord long, id string, base {credence}")
    relations = spark.createDataFrame([(k, *(r[c] for c in ("ord", "id", "type", "source", "target", "strength", "sensitivity", "false_pass"))) for k, (_, own) in enumerate(graphs) for r in own], f"graph_id long, ord long, id string, type string, source string, target string, strength {credence}, sensitivity {credence}, false_pass {credence}")
    rows = {r["graph_id"]: r.asDict(recursive=True) for r in compiler.gathered(nodes, relations).collect()}
    got = {r["graph_id"]: r.asDict(recursive=True) for r in compiler.compiled(nodes, relations).coalesce(1).collect()}
    assert got.keys() == rows.keys() and len(got) == 159
    for k, row in rows.items():
        variables, carried, errors = compiler.compile_graph(row)
        assert got[k]["vars"] == variables and got[k]["carried"] == carried and got[k]["errors"] == errors
    assert any(r["errors"] for r in got.values()) and any(x["a_beta"] for r in got.values() for v in r["vars"] or () for x in v["links"])


def test_a_structure_is_compiled_once(spark, monkeypatch):
    import pyarrow as pa

    node = {"ord": 0, "kind": None, "statement": None, "sources": None, "stated": None, "attributes": None}
    graphs = [{"graph_id": k, "nodes": [{**node, "id": i, "base": {"p": 0.1 + k / 1000, "alpha": None, "beta": None}} for i in "ab"], "relations": [{"ord": 0, "id": "r", "type": ("requires", "supports")[k % 2], "source": "a", "target": "b", "strength": {"p": 0.5, "alpha": None, "beta": None}, "sensitivity": None, "false_pass": None, "attributes": None, "obligation": None}]} for k in range(500)]
    from pyspark.sql.pandas.types import to_arrow_schema

    listed = lambda kind: "array<struct<" + ",".join(f"{k}:{v}" for k, v in kind.items()) + ">>"
    schema = lambda s: to_arrow_schema(spark.createDataFrame([], s).schema)
    batch = pa.RecordBatch.from_pylist(graphs, schema(f"graph_id long, nodes {listed(compiler.NODE)}, relations {listed(compiler.RELATION)}"))
    calls, one = [], compiler.compile_graph
    monkeypatch.setattr(compiler, "compile_graph", lambda g: calls.append(1) or one(g))
    groups, left = compiler.structures(batch)
    (out,) = compiler.assembled(batch, groups, schema(f"graph_id long, vars {compiler.VARS}, carried array<string>, errors {compiler.ERRORS}"))
    assert len(calls) == 1 and not left and len(out) == 500
    assert [[v["base"] for v in r["vars"]] + [x["type"] for v in r["vars"] for x in v["links"]] for r in out.to_pylist()[:2]] == [[0.1, 0.1, "requires"], [0.101, 0.101, "supports"]]
