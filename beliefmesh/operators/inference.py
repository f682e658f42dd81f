"""Exact queries over networks of binary variables.

A network is a row: graph_id and vars, an array in topological order of (name, base, links), a link being (parent,
type, a, b): type requires, supports or refutes with strength a; observes with sensitivity a and false pass b; or
exclusive, a constraint that its parents aren't both true, observed true. `members`, where vars have it, are further
names of a variable.

P(X = 1 | parents) = N (base S + 1 - S) I with N, S, I the products of the requires, supports and refutes gates.

Physical paths that give the same answers: `star_probability`, the closed form of independent premises;
`enumerate_worlds`, which weighs every world, for networks of few variables; and `eliminate`. The last two work in numpy on
Arrow batches, where networks of one structure are matrices that are answered together (see `columns`); what that leaves
goes by rows, by variable elimination (see `solver`). None shuffles, and a bad network gives a row with an error. `mass` is the
textbook elimination over whole tables, which tests hold the others against.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.operators import columns, solver
from beliefmesh.operators.solver import MAX_FACTOR, TooLargeError, min_fill

MAX_FREE = 20
#: Links of a network that is alone of its structure, beyond which it goes by rows.
FEW_LINKS = 16
#: What goes by rows at once, in bytes of its batch.
BYTES = 1 << 20


def star_probability(at: str = "-1", p: str = "x.p", s: str = "x.s", b: str = "b") -> str:
    """SQL: P(claim) of a star in closed form: independent premises ps under one claim of base b. The premise number
    `at` takes p and s from the given expressions, the others their own."""
    own = lambda field, value: f"if(x.k = {at}, {value}, x.{field})"
    P, S = own("p", p), own("s", s)
    return f"""aggregate(ps, named_struct('n', 1D, 's', 1D, 'i', 1D), (acc, x) -> named_struct(
        'n', acc.n * if(x.type = 'requires', 1 - {S} * (1 - {P}), 1D), 's', acc.s * if(x.type = 'supports', 1 - {S} * {P}, 1D),
        'i', acc.i * if(x.type = 'refutes', 1 - {S} * {P}, 1D)), acc -> acc.n * ({b} * acc.s + (1 - acc.s)) * acc.i)"""


NONE = "cast(map() as map<string,boolean>)"


def enumerate_worlds(networks: DataFrame, target: str, given: str = NONE, do: str = NONE) -> DataFrame:
    """graph_id, answer, error. target, given, do: SQL for maps from names to values; names that a network lacks say nothing.

    Every world of a network is weighed; networks of one structure are weighed together, world by world in the rows of a
    matrix. error: `too-large` beyond MAX_FREE variables, `zero-probability` for impossible evidence.
    """
    maps = [F.to_json(F.expr(x).cast("map<string,boolean>")).alias(f"__{i}") for i, x in enumerate((target, given, do))]
    kind = dict(networks.dtypes)["graph_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [b.column(f"__{i}") for i in range(3)]
            table = columns.table(b.column("vars"), more, bare=True)
            values, error = np.full(len(b), np.nan), np.full(len(b), "zero-probability", object)
            for g in table.groups:
                if len(g.names) > MAX_FREE:
                    error[g.rows] = "too-large"
                    continue
                at = {own[0]: i for i, own in enumerate(g.names)}
                want, seen, fixed = ({at[k]: v for k, v in (json.loads(m[int(g.rows[0])].as_py() or "{}")).items() if k in at and v is not None} for m in more)
                below, above = g.worlds(want, {**seen, **g.constraints()}, fixed)
                fine = below > 0
                values[g.rows[fine]] = np.clip(above[fine] / below[fine], 0.0, 1.0)
                error[g.rows[fine]] = None
            for i in table.left.tolist():  # networks with a defect, or whose variables don't come after their parents
                network = plain(b.column("vars")[i].as_py() or ())
                if len(network) > MAX_FREE:
                    error[i] = "too-large"
                    continue
                names = {v["name"] for v in network}
                asked = tuple({k: v for k, v in json.loads(m[i].as_py() or "{}").items() if k in names and v is not None} for m in more)
                got, _ = answer(network, *asked)
                if got is not None:
                    values[i], error[i] = got, None
            yield pa.RecordBatch.from_arrays([b.column("graph_id"), pa.array(values, mask=np.isnan(values)), pa.array(error, pa.string())], ["graph_id", "answer", "error"])

    return networks.select("graph_id", "vars", *maps).mapInArrow(run, f"graph_id {kind}, answer double, error string")


# whole tables


def factor(v: int, var: dict, fixed: dict[int, bool]) -> tuple[list[int], np.ndarray]:
    """Scope and table of one variable; an intervened variable is a point mass."""
    if v in fixed:
        return [v], np.array([0.0, 1.0] if fixed[v] else [1.0, 0.0])
    links = var["links"]
    parents = sorted({x["parent"] for x in links})
    axis = {p: i for i, p in enumerate(parents)}
    k = len(parents)
    on = [np.arange(2).reshape([2 if j == i else 1 for j in range(k)]) for i in range(k)]
    full = np.ones((2,) * k)
    if any(x["type"] == "exclusive" for x in links):
        both = full.copy()
        for i in range(k):
            both = both * on[i]
        p = 1 - both
    elif any(x["type"] == "observes" for x in links):
        x = links[0]
        p = x["a"] * on[0] + x["b"] * (1 - on[0])
    else:
        need, miss, pass_ = full, full, full
        for x in links:
            bit = on[axis[x["parent"]]]
            if x["type"] == "requires":
                need = need * (1 - x["a"] * (1 - bit))
            elif x["type"] == "supports":
                miss = miss * (1 - x["a"] * bit)
            elif x["type"] == "refutes":
                pass_ = pass_ * (1 - x["a"] * bit)
        p = need * (var["base"] * miss + (1 - miss)) * pass_
    return [*parents, v], np.stack([1 - p, p], -1)


def mass(network: list[dict], evidence: dict[int, bool], fixed: dict[int, bool], limit: int = MAX_FACTOR) -> float:
    """Probability of the evidence, constraints included, under the interventions, by elimination over whole tables."""
    seen = dict(evidence)
    widest = max((len({x["parent"] for x in var["links"]}) + 1 for v, var in enumerate(network) if v not in fixed), default=0)
    if 1 << widest > limit:
        raise TooLargeError(f"a table of 2^{widest} entries exceeds {limit}")
    for v, var in enumerate(network):
        if any(x["type"] == "exclusive" for x in var["links"]):
            if seen.get(v) is False:
                return 0.0
            seen[v] = True
    tables = []
    for v, var in enumerate(network):
        scope, t = factor(v, var, fixed)
        t = t[tuple(int(seen[s]) if s in seen else slice(None) for s in scope)]
        tables.append(([s for s in scope if s not in seen], t))
    for v in min_fill([set(s) for s, _ in tables], {s for sc, _ in tables for s in sc}):
        touch = [x for x in tables if v in x[0]]
        scope = sorted({s for sc, _ in touch for s in sc})
        if 1 << len(scope) > limit:
            raise TooLargeError(f"a factor of 2^{len(scope)} entries exceeds {limit}")
        sorted_tables = [(tuple(sorted(sc)), t.transpose(np.argsort(sc))[..., None]) for sc, t in touch]
        joined = solver.product(sorted_tables, scope)[..., 0].sum(scope.index(v))
        tables = [x for x in tables if v not in x[0]] + [([s for s in scope if s != v], joined)]
    return float(np.prod([t for _, t in tables]))


# elimination over chains, by shape




def plain(network) -> list[dict]:
    return [{**v, "links": list(v["links"] if v["links"] is not None else ())} for v in network]


def resolve(network: list[dict], *assignments: dict[str, bool] | None) -> list[dict[int, bool] | None]:
    """The assignments by variable; None where two names of one variable get different values. KeyError: unknown name."""
    at = {name: i for i, v in enumerate(network) for name in (v["name"], *(v.get("members") or ()))}
    out: list[dict[int, bool] | None] = []
    for names in assignments:
        own: dict[int, bool] | None = {}
        for k, x in (names or {}).items():
            if own is not None and own.setdefault(at[k], bool(x)) != bool(x):
                own = None
        out.append(own)
    return out


def incomplete(network: list[dict]) -> str | None:
    for v in network:
        kinds = {x["type"] for x in v["links"]}
        if not kinds & {"observes", "exclusive"} and (v["base"] is None or any(x["a"] is None for x in v["links"])):
            return f"missing-parameter {v['name']!r}"
        if "observes" in kinds and (len(v["links"]) != 1 or v["links"][0]["a"] is None or v["links"][0]["b"] is None):
            return f"invalid-observation {v['name']!r}"
        if any(x["parent"] is None or not 0 <= x["parent"] < len(network) for x in v["links"]):
            return f"unknown-parent {v['name']!r}"
    return None


Asked = tuple[dict[str, bool], dict[str, bool] | None, dict[str, bool] | None]


def answers(networks: list[list[dict]], asked: list[Asked], limit: int = MAX_FACTOR) -> list[tuple[float | None, str | None]]:
    """(answer, error) of P(target | given, do) on each network, asked holding (target, given, do) by network. Evidence that
    is empty, with no constraint, costs nothing."""
    out: list[tuple[float | None, str | None]] = [(None, None)] * len(networks)
    requests: list[solver.Request] = []
    ratios: list[tuple[int, int | float, int | float]] = []  # row, numerator and denominator: numbers of requests, or values

    def ask(network: list[dict], seen: dict[int, bool], fixed: dict[int, bool]) -> int:
        requests.append((network, seen, fixed, ()))
        return len(requests) - 1

    for i, (network, (target, given, do)) in enumerate(zip(networks, asked, strict=True)):
        if error := incomplete(network):
            out[i] = None, error
            continue
        try:
            want, seen, fixed = resolve(network, target, given, do)
        except KeyError as e:
            out[i] = None, f"unknown-node {e}"
            continue
        if fixed is None:
            out[i] = None, "contradictory-intervention"
        elif seen is None or any(seen.get(v) is False for v in solver.constraints(network)):
            out[i] = None, "zero-probability"
        else:
            seen = {**seen, **solver.constraints(network)}
            below = ask(network, seen, fixed) if seen else 1.0
            if want is None or any(seen.get(k, x) != x for k, x in want.items()):
                ratios.append((i, 0.0, below))
            else:
                ratios.append((i, below if want.items() <= seen.items() else ask(network, {**seen, **want}, fixed), below))
    got = solver.masses(requests, limit)
    value = lambda x: got[x] if isinstance(x, int) else x
    for i, above, below in ratios:
        n, d = value(above), value(below)
        if n is None or d is None:
            out[i] = None, "too-large"
        else:
            out[i] = (min(1.0, max(0.0, n / d)), None) if d > 0 else (None, "zero-probability")
    return out


def answer(network: list[dict], target: dict[str, bool], given: dict[str, bool] | None = None, do: dict[str, bool] | None = None) -> tuple[float | None, str | None]:
    return answers([network], [(target, given, do)])[0]


def eliminate(networks: DataFrame, target: dict[str, bool], given: dict[str, bool] | None = None, do: dict[str, bool] | None = None, columns_too: tuple[str, ...] = ()) -> DataFrame:
    """graph_id, answer, error by variable elimination, and the columns named; a failing network gives a row with an error."""
    kinds = dict(networks.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in columns_too)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, error = answers_of(b.column("vars"), (target, given, do))
            own = [b.column(c) for c in columns_too]
            yield pa.RecordBatch.from_arrays([b.column("graph_id"), pa.array(values, mask=np.isnan(values)), pa.array(error, pa.string()), *own], ["graph_id", "answer", "error", *columns_too])

    return networks.select("graph_id", "vars", *columns_too).mapInArrow(run, f"graph_id {kinds['graph_id']}, answer double, error string{more}")


def answers_of(nets: pa.Array, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """The same as `answers` for a column of networks: those of one structure together where that can be, the others by rows.
    NaN where there is an error."""
    table = columns.table(nets)
    values, error = np.full(len(nets), np.nan), np.full(len(nets), None, object)
    left = table.left.tolist()
    for g in table.groups:
        got = together(g, asked)
        if got is None:
            left += g.rows.tolist()
            continue
        above, below = got
        fine = below > 0
        values[g.rows[fine]] = np.clip(above[fine] / below[fine], 0.0, 1.0)
        error[g.rows[~fine]] = "zero-probability"
    some = max(1, len(nets) * BYTES // max(1, nets.nbytes))
    for at in range(0, len(left), some):
        part = left[at : at + some]
        rows = [nets[i].as_py() for i in part]
        got = iter(answers(own := [plain(n) for n in rows if n is not None], [asked] * len(own)))
        for i, n in zip(part, rows, strict=True):
            x, error[i] = (None, "no-network") if n is None else next(got)
            values[i] = np.nan if x is None else x
    return values, error


def together(g: columns.Group, asked: Asked) -> tuple[np.ndarray, np.ndarray] | None:
    """Masses of the target with the evidence and of the evidence, for all networks of a group; None if they go by rows."""
    if len(g.rows) == 1 and len(g.kind) > FEW_LINKS:
        return None
    try:
        want, seen, fixed = resolve([{"name": own[0], "members": own[1:]} for own in g.names], *asked)
    except KeyError:
        return None
    if fixed is None or seen is None or any(seen.get(v) is False for v in g.constraints()):
        return None
    got = columns.ratio(g, want, {**seen, **g.constraints()}, fixed)
    return None if got is None else tuple(np.broadcast_to(x, len(g.rows)) for x in got)


# bands: the answer over draws of the Beta parameters

LOWEST, HIGHEST = float(np.finfo(float).tiny), float(np.nextafter(1.0, 0.0))


def drawn(network: list[dict], draws: int, rng: np.random.Generator) -> list[dict] | None:
    """The network with an array of draws for each Beta parameter (`base_beta` of a variable, `a_beta` and `b_beta` of a
    link, each from its own alpha and beta, null for a point); None if every parameter is a point."""
    spread = False

    def value(x: dict, field: str):
        nonlocal spread
        credence = x.get(f"{field}_beta")
        if credence is None:
            return x[field]
        spread = True
        return np.clip(rng.beta(credence["alpha"], credence["beta"], size=draws), LOWEST, HIGHEST)

    out = []
    for v in network:
        base = value(v, "base")
        out.append({**v, "base": base, "links": [{**x, "a": value(x, "a"), "b": value(x, "b")} for x in v["links"]]})
    return out if spread else None


def answers_over_draws(network: list[dict], target: dict[str, bool], draws: int, given: dict[str, bool] | None = None, do: dict[str, bool] | None = None) -> tuple[np.ndarray | None, str | None]:
    """The answer at each draw of a network from `drawn`, NaN at draws where the evidence is impossible; or an error."""
    if error := incomplete(network):
        return None, error
    try:
        want, seen, fixed = resolve(network, target, given, do)
    except KeyError as e:
        return None, f"unknown-node {e}"
    if fixed is None:
        return None, "contradictory-intervention"
    if seen is None:
        return None, "zero-probability"
    seen = {**seen, **solver.constraints(network)}
    layout = solver.Layout(network)
    rows = layout.rows()
    for v, x in fixed.items():
        for row in rows:
            layout.fix(row, v, x)
    try:
        below = np.broadcast_to(layout.mass(rows, layout.seen(seen)), draws)
        if np.all(below <= 0):
            return None, "zero-probability"
        if want is None or any(seen.get(k, x) != x for k, x in want.items()):
            above = np.zeros(draws)
        else:
            above = np.broadcast_to(layout.mass(rows, layout.seen({**seen, **want})), draws)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(below > 0, np.clip(above / below, 0.0, 1.0), np.nan), None
    except TooLargeError:
        return None, "too-large"


def band(graph_id, network: list[dict], target: dict[str, bool], draws: int, seed: int, given: dict[str, bool] | None = None, do: dict[str, bool] | None = None) -> tuple:
    """q05, q50, q95, mean_over_draws, error; all null without a Beta parameter, as the answer can't move then. As in the
    point answer, a draw that makes the evidence impossible is an error, which says how many draws did."""
    net = drawn(network, draws, np.random.default_rng([seed, zlib.crc32(str(graph_id).encode())]))
    if net is None:
        return None, None, None, None, None
    values, error = answers_over_draws(net, target, draws, given, do)
    if error is None and np.isnan(values).any():
        error = f"zero-probability in {int(np.isnan(values).sum())} of {draws} draws"
    if error:
        return None, None, None, None, error
    return *map(float, np.quantile(values, [0.05, 0.5, 0.95])), float(values.mean()), None


def bands(networks: DataFrame, target: dict[str, bool], draws: int = 1000, seed: int = 0, given: dict[str, bool] | None = None, do: dict[str, bool] | None = None) -> DataFrame:
    """graph_id, q05, q50, q95, mean_over_draws, error: quantiles of the exact answer over draws of every Beta parameter
    (see `drawn`); points keep their value. A failing network gives a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nets = b.column("graph_id"), b.column("vars")
            out, error = np.full((4, len(b)), np.nan), np.full(len(b), None, object)
            table = columns.table(nets)
            left = table.left.tolist()
            for g in table.groups:
                left += bands_together(table, g, ids, out, (target, given, do), draws, seed)
            for i in left:
                *found, error[i] = band(ids[i].as_py(), plain(nets[i].as_py() or ()), target, draws, seed, given, do)
                out[:, i] = [np.nan if x is None else x for x in found]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, mask=np.isnan(x)) for x in out), pa.array(error, pa.string())], ["graph_id", "q05", "q50", "q95", "mean_over_draws", "error"])

    kind = dict(networks.dtypes)["graph_id"]
    return networks.select("graph_id", "vars").mapInArrow(run, f"graph_id {kind}, q05 double, q50 double, q95 double, mean_over_draws double, error string")


def quantiles(values: np.ndarray) -> np.ndarray:
    """The quantiles 0.05, 0.5 and 0.95 of each row as np.quantile has them; sorting takes a fifth of its time."""
    values = np.sort(values, axis=1)
    out = []
    for q in (0.05, 0.5, 0.95):
        at = q * (values.shape[1] - 1)
        low, high = values[:, int(at)], values[:, min(int(at) + 1, values.shape[1] - 1)]
        share = at - int(at)
        out.append(low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share))
    return np.stack(out)


def bands_together(table: columns.Table, g: columns.Group, ids: pa.Array, out: np.ndarray, asked: Asked, draws: int, seed: int) -> list[int]:
    """Write q05, q50, q95 and the mean of a group's networks; the rows that are left for `band`, which draws the same."""
    spreads = {(field, link): table.spread(g, f"{field}_beta", link) for field, link in (("base", False), ("a", True), ("b", True))}
    spreads = {k: x for k, x in spreads.items() if x is not None and not np.isnan(x[0]).all()}
    if not spreads:
        return []  # points alone: the answer can't move
    try:
        want, seen, fixed = resolve([{"name": own[0], "members": own[1:]} for own in g.names], *asked)
    except KeyError:
        return g.rows.tolist()
    if fixed is None or seen is None:
        return g.rows.tolist()
    seen = {**seen, **g.constraints()}
    left: list[int] = []
    some = max(1, columns.ENTRIES // (draws * 32))
    for at in range(0, len(g.rows), some):
        rows = g.rows[at : at + some]
        numbers = {("base", False): list(g.base[:, at : at + some, None]), ("a", True): list(g.a[:, at : at + some, None]), ("b", True): list(g.b[:, at : at + some, None])}
        own = {k: (x[:, at : at + some], y[:, at : at + some]) for k, (x, y) in spreads.items()}
        for k, (alpha, _) in own.items():
            for i in np.flatnonzero(~np.isnan(alpha).all(1)):
                numbers[k][i] = np.repeat(numbers[k][i], draws, 1)
        # each network draws from its own source: by variable its base, then its links in turn
        places = [p for v in range(len(g.names)) for p in (("base", False, v), *((f, True, g.first[v] + j) for j in range(len(g.parents[v])) for f in ("a", "b"))) if p[:2] in own]
        for r, graph_id in enumerate(ids.take(pa.array(rows)).to_pylist()):
            rng = np.random.default_rng([seed, zlib.crc32(str(graph_id).encode())])
            for field, link, i in places:
                alpha, beta = own[field, link][0][i, r], own[field, link][1][i, r]
                if alpha == alpha:
                    numbers[field, link][i][r] = rng.beta(alpha, beta, size=draws)
        for k, (alpha, _) in own.items():
            for x, points in zip(numbers[k], np.isnan(alpha), strict=True):
                if x.shape[1] > 1 and (x.min() < LOWEST or x.max() > HIGHEST):
                    x[~points] = np.clip(x[~points], LOWEST, HIGHEST)
        got = columns.ratio(g, want, seen, fixed, (numbers["base", False], list(g.kind[:, at : at + some, None]), numbers["a", True], numbers["b", True]))
        still = np.ones(len(rows), bool) if got is None else np.zeros(len(rows), bool)
        if got is not None:
            above, below = (np.broadcast_to(x, (len(rows), draws)) for x in got)
            still |= (below <= 0).any(1)
            moved = np.logical_or.reduce([~np.isnan(x).all(0) for x, _ in own.values()])
            with np.errstate(divide="ignore", invalid="ignore"):
                values = np.clip(above / below, 0.0, 1.0)
            fine = ~still & moved
            out[:3, rows[fine]] = quantiles(values[fine])
            out[3, rows[fine]] = values[fine].mean(1)
        left += rows[still].tolist()
    return left
