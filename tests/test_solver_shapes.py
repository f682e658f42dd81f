"""Requests solved as matrices, by structure, against elimination."""

import random

import pytest

from beliefmesh.operators import columns, compiler, solver


def test_requests_as_matrices_equal_elimination():
    """Interventions, replaced parameters, observations and exclusions, many networks of a structure at once."""
    rng = random.Random(8)
    shapes = []
    for _ in range(6):
        n = rng.randint(2, 6)
        shapes.append([(rng.random() < 0.2, rng.sample(range(i), rng.randint(0, min(i, 3)))) for i in range(n)])
    requests = []
    for _ in range(150):
        net = []
        for i, (seen, parents) in enumerate(rng.choice(shapes)):
            types = ["observes"] if seen and len(parents) == 1 else ["exclusive"] if seen and parents else ["requires", "supports", "refutes"]
            kind = rng.choice(types)
            net.append({"name": f"v{i}", "base": rng.random(), "links": [{"parent": p, "type": kind if len(types) == 1 else rng.choice(types), "a": rng.random(), "b": rng.random()} for p in parents]})
        own = [v for v, x in enumerate(net) if not any(y["type"] == "exclusive" for y in x["links"])]
        for _ in range(4):
            evidence = {v: rng.random() < 0.5 for v in rng.sample(range(len(net)), rng.randint(0, 2))}
            fixed = {v: rng.random() < 0.5 for v in rng.sample(own, rng.randint(0, 1))}
            places = [(v, -1, "base") for v in own if not net[v]["links"] or net[v]["links"][0]["type"] != "observes"] + [(v, j, f) for v in own for j, x in enumerate(net[v]["links"]) for f in ("a", "b")[: 1 + (x["type"] == "observes")]]
            requests.append((net, evidence, fixed, tuple((*p, rng.random()) for p in rng.sample(places, min(len(places), rng.randint(0, 2))))))
    assert solver.masses(requests) == pytest.approx(solver.eliminated(requests), rel=1e-12)


def test_requests_of_a_structure_are_one_operation(monkeypatch):
    """Before, each request had a row made in Python and a structure a row for each."""
    net = lambda k: [{"name": "a", "base": k / 100, "links": []}, {"name": "b", "base": 0.5, "links": [{"parent": 0, "type": ("requires", "supports")[k % 2], "a": 0.5, "b": 0.0}]}]
    calls, mass = [], columns.Group.mass
    monkeypatch.setattr(columns.Group, "mass", lambda *x: calls.append(1) or mass(*x))
    got = solver.masses([(net(k), {1: True}, {}, ()) for k in range(100)])
    assert len(calls) == 1 and got[50] == pytest.approx(0.5 * (1 - 0.5 * 0.5)) and got[51] == pytest.approx(1 - 0.5 * (1 - 0.5 * 0.51))


def test_records_are_the_batchs_rows():
    import pyarrow as pa

    rows = [{"a": 1, "b": [{"x": "u", "y": None}, None], "c": None}, {"a": None, "b": None, "c": {"z": [1.5, None]}}, {"a": 3, "b": [], "c": {"z": None}}, {"a": 4, "b": [{"x": None, "y": 2.0}], "c": {"z": []}}]
    kind = pa.struct([("a", pa.int64()), ("b", pa.list_(pa.struct([("x", pa.string()), ("y", pa.float64())]))), ("c", pa.struct([("z", pa.list_(pa.float64()))]))])
    c = pa.array([*rows, *rows], kind)
    assert compiler.records(c) == c.to_pylist() and compiler.records(c.slice(3, 4)) == c.slice(3, 4).to_pylist()
