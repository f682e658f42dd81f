"""Networks of a batch answered together, by structure, against all worlds and against the paths by rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from beliefmesh.operators import columns, inference
from test_inference import worlds

LINK = pa.struct([("parent", pa.int32()), ("type", pa.string()), ("a", pa.float64()), ("b", pa.float64())])
VARS = pa.list_(pa.struct([("name", pa.string()), ("base", pa.float64()), ("links", pa.list_(LINK))]))


def networks(rng, n, shapes):
    """n networks of a few structures, whose types and numbers differ."""
    made = []
    for _ in range(shapes):
        made.append([rng.sample(range(i), rng.randint(0, min(i, 3))) for i in range(rng.randint(2, 7))])
    out = []
    for _ in range(n):
        parents = rng.choice(made)
        out.append([{"name": f"v{i}", "base": rng.random(), "links": [{"parent": p, "type": rng.choice(["requires", "supports", "refutes"]), "a": rng.random(), "b": 0.0} for p in own]} for i, own in enumerate(parents)])
    return out


def test_networks_of_one_structure_are_one_group_whatever_their_types():
    nets = networks(random.Random(1), 200, 6)
    table = columns.table(pa.array(nets, VARS))
    assert len(table.groups) <= 6 and sum(len(g.rows) for g in table.groups) == 200 and not len(table.left)


@pytest.mark.parametrize(("given", "do"), [({}, {}), ({"v1": True}, {}), ({}, {"v0": False}), ({"v1": False}, {"v0": True})])
def test_groups_agree_with_all_worlds(given, do):
    nets = networks(random.Random(2), 120, 8)
    values, error = inference.answers_of(pa.array(nets, VARS), ({"v0" if not do else "v1": True}, given, do))
    for net, x, e in zip(nets, values, error, strict=True):
        below = worlds(net, given, do)
        want = worlds(net, {**given, "v0" if not do else "v1": True}, do) / below if given.get("v1", True) or not do else 0.0
        assert e is None and x == pytest.approx(want, rel=1e-12)


def test_defects_are_told_by_rows_and_leave_the_others_alone():
    good = [{"name": "x", "base": 0.25, "links": []}]
    nets = [good, None, [{"name": "x", "base": None, "links": []}], [{"name": "y", "base": 0.5, "links": []}], [], good]
    values, error = inference.answers_of(pa.array(nets, VARS), ({"x": True}, None, None))
    assert values[0] == values[5] == 0.25 and error[0] is None and error[5] is None
    assert error[1] == "no-network" and error[2].startswith("missing-parameter") and error[3].startswith("unknown-node") and error[4].startswith("unknown-node")


def test_constraints_observations_and_many_cuts():
    pair = lambda a, b: {"name": f"x{a}{b}", "base": 0.0, "links": [{"parent": p, "type": "exclusive", "a": 0.0, "b": 0.0} for p in (a, b)]}
    roots = [{"name": f"v{i}", "base": 0.1 + 0.05 * i, "links": []} for i in range(12)]
    claim = {"name": "claim", "base": 0.3, "links": [{"parent": i, "type": "supports", "a": 0.4, "b": 0.0} for i in range(12)]}
    few, many = [*roots, claim, pair(0, 1), pair(1, 2)], [*roots, claim, *(pair(i, i + 1) for i in range(11))]
    values, error = inference.answers_of(pa.array([few, many, few, many], VARS), ({"claim": True}, {"v5": True}, None))
    want = [inference.answer(net, {"claim": True}, {"v5": True})[0] for net in (few, many)]
    assert list(error) == [None] * 4 and values == pytest.approx([*want, *want], rel=1e-12)
    seen = [{"name": "h", "base": 0.3, "links": []}, {"name": "o", "base": 0.0, "links": [{"parent": 0, "type": "observes", "a": 0.8, "b": 0.2}]}]
    assert inference.answers_of(pa.array([seen, seen], VARS), ({"h": True}, {"o": True}, None))[0] == pytest.approx([0.24 / 0.38] * 2)


def test_a_group_weighs_a_thousand_networks_in_a_few_operations(spark, monkeypatch):
    """Before, every world of every order was folded over by itself: 56 s for sf0.1's orders."""
    star = [{"name": f"p{i}", "base": 0.5, "links": []} for i in range(5)] + [{"name": "claim", "base": 0.5, "links": [{"parent": i, "type": "supports", "a": 0.5, "b": 0.0} for i in range(5)]}]
    (group,) = columns.table(pa.array([star] * 1000, VARS)).groups
    calls = []
    one = columns.Group.one
    monkeypatch.setattr(columns.Group, "one", lambda *x: calls.append(1) or one(*x))
    below, above = group.worlds({5: True}, {}, {})
    assert len(calls) == 6 and below == pytest.approx([1.0] * 1000) and above == pytest.approx([1 - 0.5 * 0.75**5] * 1000)


def test_quantiles_are_those_of_numpy():
    x = np.random.default_rng(4).random((9, 1000))
    assert inference.quantiles(x) == pytest.approx(np.quantile(x, [0.05, 0.5, 0.95], axis=1), rel=1e-15)


def test_bands_of_a_group_equal_those_of_each_network():
    """Also where a parameter is a point in some networks of the group, or evidence is impossible; without a Beta, no band."""
    beta = lambda x, y: {"alpha": x, "beta": y}
    net = lambda b, own, s: [{"name": "p", "base": b, "base_beta": own, "links": []}, {"name": "x", "base": 0.25, "base_beta": None, "links": [{"parent": 0, "type": "supports", "a": 0.5, "b": 0.0, "a_beta": s, "b_beta": None}]}]
    nets = [net(0.5, beta(2.0, 3.0), beta(4.0, 2.0)), net(0.5, None, beta(4.0, 2.0)), net(0.0, None, beta(1.0, 2.0)), net(0.5, None, None), [*net(0.5, beta(1.0, 1.0), None)]]
    link = pa.struct([*LINK, *((f"{k}_beta", pa.struct([("alpha", pa.float64()), ("beta", pa.float64())])) for k in "ab")])
    kind = pa.list_(pa.struct([("name", pa.string()), ("base", pa.float64()), ("base_beta", link.field("a_beta").type), ("links", pa.list_(link))]))
    for asked in (({"x": True}, None, None), ({"x": True}, {"p": True}, None)):
        table, out = columns.table(pa.array(nets, kind)), np.full((4, len(nets)), np.nan)
        (group,) = table.groups
        left = inference.bands_together(table, group, pa.array(range(len(nets))), out, asked, 50, 0)
        for i, own in enumerate(nets):
            *want, error = inference.band(i, inference.plain(own), asked[0], 50, 0, asked[1])
            assert i in left if error else i not in left and out[:, i] == pytest.approx([np.nan if x is None else x for x in want], rel=1e-12, nan_ok=True)
