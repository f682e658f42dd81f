"""Questions to graphs: marginal, joint, conditional and interventional probabilities with their bands, and what to change
where the evidence is impossible.

`ask` takes a table of questions and gives a row for each: the point answer at the parameters' means, the quantiles over
draws of their Beta credences, or an error code with its detail. A question that can't be answered doesn't stop the others.

For evidence of probability zero, `remedies` looks for the smallest changes after which the same question has an answer:
values to drop, parameters at exactly 0 or 1 to move, an exclusive relation to remove. Every change named has been tried;
single changes all are, sets of several up to SEARCH of each kind, and a search that stops there says so.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.functions import batches
from beliefmesh.operators import columns, compiler, diagnostics, inference, solver
from beliefmesh.operators.compiler import gathered

KINDS = ("marginal", "joint", "conditional", "intervene")
SEARCH = 256
#: Questions answered together, and draws made for each, by default.
DRAWS = 1000
QUESTION = {"kind": "string", "target": "map<string,boolean>", "given": "map<string,boolean>", "do": "map<string,boolean>", "overrides": "map<string,double>"}
ANSWER = "question long, kind string, point double, q05 double, q50 double, q95 double, mean_over_draws double, draws int, code string, detail string"


class QuestionError(ValueError):
    """Why a question has no answer: a code and a detail, a string or JSON data."""


# arguments


def parse_assignment(items: list[str], default: bool | None = None) -> dict[str, bool]:
    """`NODE=true` and `NODE=false` (also 1, 0, yes, no); a bare NODE where there is a default."""
    words = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
    out: dict[str, bool] = {}
    for item in items:
        name, sign, value = item.rpartition("=")
        if not sign:
            name, found = item, default
        else:
            found = words.get(value.strip().lower())
        if not name or found is None:
            raise QuestionError("invalid-argument", f"{item!r} isn't NODE=true|false")
        if out.setdefault(name, found) != found:
            raise QuestionError("invalid-argument", f"{name} is given both values")
    return out


def parse_source(text: str) -> dict:
    """`DOCUMENT` or `DOCUMENT#LOCATOR`, cut at the last #."""
    document, mark, locator = text.rpartition("#") if "#" in text else (text, "", "")
    if not document or mark and not locator:
        raise QuestionError("invalid-argument", f"{text!r} isn't DOCUMENT or DOCUMENT#LOCATOR")
    return {"document": document, "locator": locator or None, "quote": None, "digest": None}


def check_shape(kind: str, target: dict, given: dict, do: dict) -> None:
    """Whether targets, evidence and interventions fit the kind of question."""
    wrong = (
        f"the kind is one of {', '.join(KINDS)}" if kind not in KINDS else "a marginal has one target" if kind == "marginal" and len(target) != 1 else "a conditional needs evidence" if kind == "conditional" and not given
        else "an intervention is missing" if kind == "intervene" and not do else "only intervene sets nodes" if kind != "intervene" and do else None
    )
    if wrong:
        raise QuestionError("invalid-argument", wrong)


class Ready:
    """What all questions to a graph need, found once."""

    def __init__(self, graph: dict):
        self.graph, self.defects = graph, compiler.defects(graph)
        self.nodes = {n["id"]: None for n in graph["nodes"]}
        self.network, _, self.errors = (None, None, []) if self.defects else compiler.compile_graph(graph)
        self.used = {k for ids in compiler.inference_sets(graph).values() for k in ids}


def require_variables(ready: Ready, names: dict[str, bool]) -> None:
    """Every name is a node that takes part in inference; else an error, for an unknown one with the closest ids."""
    for name in names:
        if name not in ready.nodes:
            near = difflib.get_close_matches(name, list(ready.nodes), 3)
            raise QuestionError("unknown-node", name + (f"; did you mean {', '.join(near)}?" if near else ""))
        if name not in ready.used:
            raise QuestionError("invalid-argument", f"{name} has no base and no inferential relation")


def observed_values(graph: dict) -> dict[str, bool]:
    """What nodes say of themselves in `observed`, which must be true or false."""
    out = {}
    for n in graph["nodes"]:
        own = json.loads(n["attributes"]) if n["attributes"] else {}
        if "observed" in own:
            if not isinstance(own["observed"], bool):
                raise QuestionError("invalid-argument", f"observed of {n['id']} is neither true nor false")
            out[n["id"]] = own["observed"]
    return out


def check_consistent(network: list[dict], given: dict[str, bool], do: dict[str, bool]) -> None:
    """Values that contradict each other outright, also through merged nodes."""
    at = {k: v["name"] for v in network for k in v["members"]}
    seen: dict[str, dict[str, tuple[str, bool]]] = {"set": {}, "given": {}}
    for what, values in (("set", do), ("given", given)):
        for k, x in values.items():
            other, before = seen[what].setdefault(at[k], (k, x))
            if before != x:
                raise QuestionError("invalid-argument", f"{what}: {other} and {k} are equivalent and get different values")
    for name, (k, x) in seen["given"].items():
        other, fixed = seen["set"].get(name, (k, x))
        if fixed != x:
            raise QuestionError("invalid-argument", f"{k} is given another value than {other} is set to")


def compile_failure(graph: dict, errors: list[dict]) -> dict:
    """What to mend in a graph that doesn't compile."""
    hints = {
        "missing-base": "give each of them a base, as there is none by default", "conflicting-bases": "give equivalent nodes one base, or only one of them", "observation-has-base": "an observes relation alone sets it: remove its base",
        "observation-has-parents": "an observes relation alone sets it: remove the other relations into it", "cycle": "remove an equivalence that merges nodes of it, or one of its relations", "dangling": "add the node it names", "missing-strength": "give it a strength, or sensitivity and false pass",
    }
    return {"errors": errors, "hints": [hints[e["code"]] for e in errors], "missing": [f["id"] for f in diagnostics.missing_parameters(graph)]}


# remedies


def extremes(graph: dict) -> list[tuple[str, float]]:
    """Parameters that are points at exactly 0 or 1: `base:<node>`, `strength:<relation>`, ..."""
    out = [(f"base:{n['id']}", n["base"]["p"]) for n in graph["nodes"] if n["base"] is not None and n["base"]["p"] in (0.0, 1.0)]
    return out + [(f"{k}:{r['id']}", r[k]["p"]) for r in graph["relations"] for k in ("strength", "sensitivity", "false_pass") if r[k] is not None and r[k]["p"] in (0.0, 1.0)]


def altered(graph: dict, without: set[str] = frozenset(), moved: set[str] = frozenset()) -> list[dict] | None:
    """The network of the graph without some relations, and with some parameters at a half; None if it doesn't compile."""
    half = {"p": 0.5, "alpha": None, "beta": None}
    nodes = [{**n, "base": half} if f"base:{n['id']}" in moved else n for n in graph["nodes"]]
    relations = [{**r, **{k: half for k in ("strength", "sensitivity", "false_pass") if f"{k}:{r['id']}" in moved}} for r in graph["relations"] if r["id"] not in without]
    return compiler.compile_graph({"nodes": nodes, "relations": relations})[0]


Item = tuple[str, str, bool]


def request(network: list[dict], items: list[Item]) -> solver.Request | None:
    """What weighs the evidence among the items; None if they contradict each other."""
    given = {k: x for what, k, x in items if what != "set"}
    do = {k: x for what, k, x in items if what == "set"}
    seen, fixed = inference.resolve(network, given, do)
    if seen is None or fixed is None:
        return None
    return network, {**seen, **solver.constraints(network)}, fixed, ()


def possible(states: list[solver.Request | None]) -> diagnostics.Asking:
    """Whether each has a positive probability."""
    got = iter((yield [s for s in states if s is not None]))
    return [s is not None and next(got) > 0 for s in states]


def smallest(n: int, state) -> diagnostics.Asking:
    """(any one of, all of, tried): the single changes that clear the failure, or the first smallest set that does. state(group)
    is the request after the changes of a group, None if they make no sense."""
    cleared = yield from possible([state((i,)) for i in range(n)])
    tried = {"single": n, "several": 0}
    singles = [i for i in range(n) if cleared[i]]
    if singles:
        return [singles, [], tried]
    for size in range(2, n + 1):
        groups = combinations(range(n), size)
        while some := list(islice(groups, min(64, SEARCH - tried["several"]))):
            found = next((g for g, ok in zip(some, (yield from possible([state(g) for g in some])), strict=True) if ok), None)
            tried["several"] += len(some) if found is None else some.index(found) + 1
            if found:
                return [[], list(found), tried]
        if tried["several"] >= SEARCH:
            more = next(groups, None) is not None
            if more or size < n:
                return [[], [], {**tried, "stopped_at": size if more else size + 1}]
    return [[], [], tried]


def remedies(graph: dict, network: list[dict], kind: str, target: dict[str, bool], items: list[Item]) -> diagnostics.Asking:
    """What is behind evidence of probability zero, and what to change. items: (given, observed or set; node; value)."""
    (alone,) = yield from possible([request(network, [])])
    if not items or not alone:
        return {"cause": "graph"}
    label = lambda i: f"{items[i][0]} {items[i][1]}={'true' if items[i][2] else 'false'}"

    def dropped(group: tuple[int, ...]) -> solver.Request | None:
        kept = [x for i, x in enumerate(items) if i not in group]
        try:
            check_shape(kind, target, {k: x for w, k, x in kept if w != "set"}, {k: x for w, k, x in kept if w == "set"})
        except QuestionError:
            return None
        return request(network, kept)

    edge = extremes(graph)

    def moved(group: tuple[int, ...]) -> solver.Request | None:
        net = altered(graph, moved={edge[i][0] for i in group})
        return None if net is None else request(net, items)

    any_drop, all_drop, drops = yield from smallest(len(items), dropped)
    any_move, all_move, moves = yield from smallest(len(edge), moved)
    out = {"drop_any_one_of": list(map(label, any_drop)), "drop_all_of": list(map(label, all_drop)), "move_any_one_of": [edge[i][0] for i in any_move], "move_all_of": [edge[i][0] for i in all_move], "extreme_parameters": [edge[i] for i in any_move or all_move], "tried": {"drop": drops, "move": moves}, "truncated": [k for k, t in (("drop", drops), ("move", moves)) if "stopped_at" in t]}
    # which kinds of values fail by themselves; all of them together if none does
    kinds = list(dict.fromkeys(w for w, _, _ in items))
    own = yield from possible([request(network, [x for x in items if x[0] == w]) for w in kinds])
    failing = [w for w, ok in zip(kinds, own, strict=True) if not ok] or [" and ".join(kinds)]
    exclusive = {r["id"] for r in graph["relations"] if r["type"] == "exclusive"}
    loose = altered(graph, without=exclusive) if exclusive else None
    if loose is not None:
        named = [x for x in items if x[0] in failing or " and " in failing[0] or x[0] == "set"]
        (free,) = yield from possible([request(loose, named)])
        out["uses_exclusive"] = free
    out["cause"] = failing
    name = {k: i for i, v in enumerate(network) for k in v["members"]}
    true = {name[k] for _, k, x in items if x}
    for r in graph["relations"]:
        if r["type"] == "exclusive" and {name[r["source"]], name[r["target"]]} <= true:
            net = altered(graph, without={r["id"]})
            (ok,) = yield from possible([None if net is None else request(net, items)])
            if ok:
                out["exclusive_relation"] = r["id"]
                break
    return out


# answers


def overridden(graph: dict, network: list[dict], values: dict[str, float]) -> list[dict]:
    """The network with parameters replaced, by `base:<node>`, `strength:<relation>`, ... Credences stay, so a Beta's draws do."""
    place = {f"{kind}:{name}": (v, j, field) for kind, name, v, j, field in compiler.parameters(graph, network)}
    for k, x in values.items():
        if k not in place or x is None or not 0 <= x <= 1:
            raise QuestionError("invalid-argument", f"no parameter {k}" if k not in place else f"{k} isn't a probability")
    return compiler.with_parameters(network, {place[k]: x for k, x in values.items()})


def question(ready: Ready, q: dict, use_observed: bool, draws: int, seed: int) -> diagnostics.Asking:
    """An answer as a dict of ANSWER's fields."""
    out = dict.fromkeys(("point", "q05", "q50", "q95", "mean_over_draws", "draws", "code", "detail"))
    target, given, do, values = (dict(q[k] or {}) for k in ("target", "given", "do", "overrides"))
    try:
        graph, network = ready.graph, ready.network
        if ready.defects:
            raise QuestionError("invalid-graph", ", ".join(ready.defects))
        observed = observed_values(graph) if use_observed else {}
        for names in (target, given, observed, do):
            require_variables(ready, names)
        clash = [k for k in observed if given.get(k, observed[k]) != observed[k]]
        if clash:
            raise QuestionError("invalid-argument", f"{clash[0]} is given another value than it says of itself")
        check_shape(q["kind"], target, {**given, **observed}, do)
        if network is None:
            raise QuestionError("compile-error", json.dumps(compile_failure(graph, ready.errors)))
        network = overridden(graph, network, values) if values else network
        evidence = {**given, **observed}
        check_consistent(network, evidence, do)
        items = [("observed" if k in observed else "given", k, x) for k, x in evidence.items()] + [("set", k, x) for k, x in do.items()]
        want, seen, fixed = inference.resolve(network, target, evidence, do)
        seen = {**seen, **solver.constraints(network)}
        if want is None or any(seen.get(k, x) != x for k, x in want.items()):
            (below,) = yield [(network, seen, fixed, ())]
            above = 0.0
        else:
            below, above = yield [(network, seen, fixed, ()), (network, {**seen, **want}, fixed, ())]
        if below <= 0:
            found = yield from remedies(graph, network, q["kind"], target, items)
            raise QuestionError("zero-probability", json.dumps(found))
        out["point"] = min(1.0, above / below)
        net = inference.drawn(network, draws, np.random.default_rng(seed)) if draws else None
        if net is not None:
            answers, error = inference.answers_over_draws(net, target, draws, evidence, do)
            if error is None and np.isnan(answers).any():
                error = "zero-probability"
            if error:
                raise QuestionError("problem-too-large" if error == "too-large" else error, "over draws")
            q05, q50, q95 = map(float, np.quantile(answers, [0.05, 0.5, 0.95]))
            out |= {"q05": q05, "q50": q50, "q95": q95, "mean_over_draws": float(answers.mean()), "draws": draws}
    except QuestionError as e:
        out |= {"point": None, "code": e.args[0], "detail": e.args[1]}
    except diagnostics.DiagnosticError as e:
        out |= {"point": None, "code": "problem-too-large" if e.args[0] == "too-large" else e.args[0], "detail": " ".join(e.args[1:])}
    return [out]


def ask(nodes: DataFrame, relations: DataFrame, questions: DataFrame, use_observed: bool = False, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """A row per question (see ANSWER). questions: graph_id, question (its number), kind and the maps of QUESTION, of which
    absent ones are empty. draws 0 leaves out the band, as a graph without Beta parameters does. The seed is each
    question's own, so that its draws don't depend on others."""
    have = set(questions.columns)
    own = questions.select("graph_id", "question", *[(F.col(k) if k in have else F.lit(None)).cast(kind).alias(k) for k, kind in QUESTION.items()])
    listed = own.groupBy("graph_id").agg(F.collect_list(F.struct("question", *QUESTION)).alias("questions"))
    rows = listed.join(gathered(nodes, relations), "graph_id", "left").withColumn("asked", F.to_json("questions"))
    kind = dict(rows.dtypes)["graph_id"]
    schemas = [rows.sparkSession.createDataFrame([], f"graph_id {kind}, {x}").schema for x in (ANSWER, f"vars {compiler.VARS}, carried array<string>, errors {compiler.ERRORS}")]
    batches.limit(rows.sparkSession)

    def run(batch: list[dict]) -> list[list[dict]]:
        # maps come as lists of pairs
        asked = [(i, {**q, **{k: dict(q[k] or ()) for k in QUESTION if k != "kind"}}) for i, row in enumerate(batch) for q in row["questions"]]
        ready = [Ready(row if row["nodes"] is not None else {"nodes": [], "relations": []}) for row in batch]
        got = diagnostics.lockstep([question(ready[i], q, use_observed, draws, seed) for i, q in asked])
        return [{"graph_id": batch[i]["graph_id"], "question": q["question"], "kind": q["kind"], **found} for (i, q), (found,) in zip(asked, got, strict=True)]

    def inside(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, compiled = map(to_arrow_schema, schemas)
        for b in parts:
            found, left = together(b, lambda ready, q: question(ready, q, use_observed, draws, seed), draws > 0, out, compiled)
            yield from found
            some = max(1, min(compiler.GRAPHS, len(b) * compiler.BYTES // max(1, b.nbytes)))
            for at in range(0, len(left), some):
                yield pa.RecordBatch.from_pylist(run(compiler.records(b.take(pa.array(left[at : at + some])).to_struct_array())), out)

    return rows.mapInArrow(inside, schemas[0])


def together(b: pa.RecordBatch, question, drawn: bool, out: pa.Schema, compiled: pa.Schema) -> tuple[list[pa.RecordBatch], list[int]]:
    """The answers to graphs of one structure that are asked the same, by matrices (see `columns`), and the rows that go one by
    one: those with attributes, Betas that are drawn, overrides, or evidence of probability zero."""
    groups, left = compiler.structures(b)
    alone = set(np.flatnonzero(np.asarray(pc.is_null(b.column("nodes")))).tolist())
    for name, credences in (("nodes", ("base",)), ("relations", ("strength", "sensitivity", "false_pass"))):
        flat = b.column(name).flatten()
        odd = np.asarray(pc.is_valid(pc.struct_field(flat, "attributes")))
        for c in credences if drawn else ():
            odd = odd | compiler.credences(pc.struct_field(flat, c))[3]
        alone |= set(np.repeat(np.arange(len(b)), np.asarray(b.column(name).value_lengths().fill_null(0)))[odd].tolist())
    code = np.asarray(b.column("asked").dictionary_encode().indices)
    found: list[pa.RecordBatch] = []
    for alike in groups:
        parts: dict[int, list[int]] = {}
        for i in alike:
            if i in alone:
                left.append(i)
            else:
                parts.setdefault(int(code[i]), []).append(i)
        for rows in parts.values():
            got = None if len(rows) < compiler.ALIKE else answered(b, rows, question, compiled)
            if got is None:
                left += rows
                continue
            fine, answers = got
            left += np.array(rows)[~fine].tolist()
            ids = b.column("graph_id").take(pa.array(np.array(rows)[fine]))
            for fixed in answers:
                columns_ = [ids if f.name == "graph_id" else pa.array(fixed["point"][fine]) if f.name == "point" and isinstance(fixed["point"], np.ndarray) else pa.array([fixed[f.name]] * len(ids), f.type) for f in out]
                found.append(pa.RecordBatch.from_arrays(columns_, schema=out))
    return found, left


def answered(b: pa.RecordBatch, rows: list[int], question, compiled: pa.Schema) -> tuple[np.ndarray, list[dict]] | None:
    """Which rows have an answer to all of their questions, and a row of ANSWER for each question, whose point is an array."""
    (row,) = compiler.records(b.slice(rows[0], 1).to_struct_array())
    ready = Ready(row)
    group, fine, out = None, np.ones(len(rows), bool), []
    for q in row["questions"]:
        q = {**q, **{k: dict(q[k] or ()) for k in QUESTION if k != "kind"}}
        asking = question(ready, q)
        try:
            requests = next(asking)
        except StopIteration as end:  # what no number changes
            out.append({"question": q["question"], "kind": q["kind"], **end.value[0]})
            continue
        if any(network is not ready.network for network, *_ in requests):
            return None
        if group is None:
            (nets,) = compiler.assembled(b, [rows], compiled)
            groups = columns.table(nets.column("vars")).groups
            if len(groups) != 1 or len(groups[0].rows) != len(rows):
                return None
            group = groups[0]
        masses = [group.mass(seen, fixed) for _, seen, fixed, _ in requests]
        if any(m is None for m in masses):
            return None
        below, above = (np.broadcast_to(x, len(rows)) for x in (masses[0], masses[1] if len(masses) > 1 else 0.0))
        fine &= below > 0
        point = np.minimum(1.0, np.divide(above, below, out=np.zeros(len(rows)), where=below > 0))
        out.append({**dict.fromkeys(("q05", "q50", "q95", "mean_over_draws", "draws", "code", "detail")), "question": q["question"], "kind": q["kind"], "point": point})
    return fine, out


def answer_json(answers: DataFrame) -> DataFrame:
    """graph_id, question, json: the point, and the band only where there is one; an error's code and detail."""
    return answers.select("graph_id", "question", F.to_json(F.struct("point", F.when(F.col("q05").isNotNull(), F.struct("q05", "q50", "q95")).alias("band"), "mean_over_draws", "draws", "code", "detail")).alias("json"))
