"""Graphs as node and relation tables, gathered to a row each, and compiled into networks.

A graph is a document: it is gathered once (one shuffle by graph_id), and what follows works row by row, for any number of
graphs. Order matters: `ord` numbers nodes and relations within a graph, the earliest of merged nodes names their
variable, and ties in the topological order go by it.

A graph that can't be compiled gives a row without variables and with its errors, as (code, items): `missing-base` (all
variables without one), `conflicting-bases`, `observation-has-parents`, `observation-has-base`, `cycle` (nodes and
relations in turn), `dangling`, `missing-strength`. Other graphs aren't touched by it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmesh.functions import batches

STRENGTH = ("requires", "supports", "refutes")
ACYCLIC = (*STRENGTH, "observes")
INFERENTIAL = (*ACYCLIC, "equivalent", "exclusive")

CREDENCE = "struct<p:double,alpha:double,beta:double>"
ANCHORS = "array<struct<document:string,locator:string,quote:string,digest:string>>"
NODE = {"ord": "bigint", "id": "string", "kind": "string", "statement": "string", "sources": ANCHORS, "base": CREDENCE, "stated": CREDENCE, "attributes": "string"}
RELATION = {"ord": "bigint", "id": "string", "type": "string", "source": "string", "target": "string", "strength": CREDENCE, "sensitivity": CREDENCE, "false_pass": CREDENCE, "attributes": "string", "obligation": "string"}
BETA = "struct<alpha:double,beta:double>"
VARS = f"array<struct<name:string,members:array<string>,kind:string,base:double,base_beta:{BETA},base_id:string,links:array<struct<parent:int,type:string,a:double,b:double,a_beta:{BETA},b_beta:{BETA},relation:string>>>>"
ERRORS = "array<struct<code:string,items:array<string>>>"


def point(p: Column) -> Column:
    null = F.lit(None).cast("double")
    return F.when(p.isNotNull(), F.struct(p.cast("double").alias("p"), null.alias("alpha"), null.alias("beta")))


def canonical(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The fields of nodes or relations: absent ones are null, a number stands for a point credence."""
    kinds = dict(df.dtypes)
    out = [F.col("graph_id")]
    for name, kind in fields.items():
        c = F.col(f"`{name}`") if name in kinds else F.lit(None)
        if kind == CREDENCE and name in kinds and not kinds[name].startswith("struct"):
            c = point(c)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def gathered(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, nodes, relations: a row per graph, both in their order (ties by id). A graph without nodes has a row if it
    has relations."""

    def rows(df: DataFrame, fields: dict[str, str], name: str) -> DataFrame:
        x = F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), F.col("id"), *[F.col(c) for c in fields if c not in ("ord", "id")])
        order = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
        return canonical(df, fields).groupBy("graph_id").agg(F.array_sort(F.collect_list(x), order).alias(name))

    both = rows(nodes, NODE, "nodes").join(rows(relations, RELATION, "relations"), "graph_id", "full")
    empty = lambda name: F.coalesce(name, F.array().cast(dict(both.dtypes)[name])).alias(name)
    return both.select("graph_id", empty("nodes"), empty("relations"))


# one graph


def mean(credence: dict | None) -> float | None:
    if credence is None:
        return None
    if credence["p"] is not None:
        return credence["p"]
    a, b = credence["alpha"], credence["beta"]
    return a / (a + b) if a + b != float("inf") else (a / 2) / (a / 2 + b / 2)


def deviation(credence: dict | None) -> float:
    """Standard deviation; 0 for a point."""
    if credence is None or credence["p"] is not None:
        return 0.0
    m = mean(credence)
    return (m * (1 - m) / (credence["alpha"] + credence["beta"] + 1)) ** 0.5


def spread(credence: dict | None) -> dict | None:
    """alpha and beta of a Beta, None for a point."""
    return None if credence is None or credence["p"] is not None else {"alpha": credence["alpha"], "beta": credence["beta"]}


def defects(graph: dict) -> list[str]:
    """What keeps a graph from being read as one: `dangling:<relation>`, `duplicate:<id>`, `attributes:<id>`."""
    names = [n["id"] for n in graph["nodes"]]
    known = set(names)
    out = [f"dangling:{r['id']}" for r in graph["relations"] if r["source"] not in known or r["target"] not in known]
    seen: set[str] = set()
    for k in names:
        if k in seen:
            out.append(f"duplicate:{k}")
        seen.add(k)
    for x in (*graph["nodes"], *graph["relations"]):
        try:
            if x["attributes"] and not isinstance(json.loads(x["attributes"]), dict):
                out.append(f"attributes:{x['id']}")
        except ValueError:
            out.append(f"attributes:{x['id']}")
    return out


def inference_sets(graph: dict) -> dict[str, list[str]]:
    """The inference variables: members in order by the earliest of them. A node counts if it has a base or an inferential
    relation; nodes joined by `equivalent` are one."""
    order = [n["id"] for n in graph["nodes"]]
    near: dict[str, list[str]] = {}
    used = {n["id"] for n in graph["nodes"] if n["base"] is not None}
    for r in graph["relations"]:
        if r["type"] in INFERENTIAL:
            used |= {r["source"], r["target"]}
        if r["type"] == "equivalent":
            near.setdefault(r["source"], []).append(r["target"])
            near.setdefault(r["target"], []).append(r["source"])
    rank = {k: i for i, k in enumerate(order)}
    sets: dict[str, list[str]] = {}
    placed: set[str] = set()
    for first in order:
        if first in used and first not in placed:
            reach, stack = {first}, [first]
            while stack:
                for other in near.get(stack.pop(), ()):
                    if other not in reach and other in rank:
                        reach.add(other)
                        stack.append(other)
            placed |= reach
            sets[first] = sorted(reach, key=rank.__getitem__)
    return sets


def cycle(edges: dict[str, list[tuple[str, str]]]) -> list[str] | None:
    """A cycle of edges[u] = [(relation, v), ...] as node, relation, node, ..., back to the first; None without one. Depth
    first from the first node, in order."""
    done: set[str] = set()
    for start in edges:
        if start in done:
            continue
        path: list[str] = []  # nodes and relations in turn
        on: dict[str, int] = {start: 0}
        path.append(start)
        stack = [iter(edges[start])]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                done.add(path.pop())
                on.pop(next(reversed(on)))
                if path:
                    path.pop()
                continue
            relation, v = step
            if v in on:
                return [*path[on[v] :], relation, v]
            if v not in done:
                on[v] = len(path) + 1
                path += [relation, v]
                stack.append(iter(edges.get(v, ())))
    return None


def compile_graph(graph: dict) -> tuple[list[dict] | None, list[str], list[dict]]:
    """Variables in topological order, constraints last; ids of nodes that inference leaves out; errors."""
    sets = inference_sets(graph)
    root = {k: r for r, ids in sets.items() for k in ids}
    node = {n["id"]: n for n in graph["nodes"]}
    carried = [k for k in node if k not in root]
    errors: list[dict] = []
    fail = lambda code, *items: errors.append({"code": code, "items": list(items)})
    for r in graph["relations"]:
        if r["type"] in INFERENTIAL and (r["source"] not in node or r["target"] not in node):
            fail("dangling", r["id"])
        elif r["type"] in STRENGTH and r["strength"] is None or r["type"] == "observes" and (r["sensitivity"] is None or r["false_pass"] is None):
            fail("missing-strength", r["id"])
    if errors:
        return None, carried, errors

    into: dict[str, list[dict]] = {}
    edges: dict[str, list[tuple[str, str]]] = {r: [] for r in sets}
    for r in graph["relations"]:
        if r["type"] in ACYCLIC:
            into.setdefault(root[r["target"]], []).append(r)
            edges[root[r["source"]]].append((r["id"], root[r["target"]]))
    observations = {k for k, own in into.items() if any(r["type"] == "observes" for r in own)}
    bases: dict[str, str] = {}
    missing = []
    for first, ids in sets.items():
        own = [k for k in ids if node[k]["base"] is not None]
        if first in observations:
            if len(into[first]) > 1:
                fail("observation-has-parents", first, *(r["id"] for r in into[first]))
            if own:
                fail("observation-has-base", first, own[0])
        elif not own:
            missing.append(first)
        else:
            other = next((k for k in own if node[k]["base"] != node[own[0]]["base"]), None)
            if other is not None:
                fail("conflicting-bases", own[0], other)
            bases[first] = own[0]
    if missing:
        fail("missing-base", *missing)
    rank = {k: i for i, k in enumerate(sets)}
    waiting = {k: len(into.get(k, ())) for k in sets}
    ready = [rank[k] for k in sets if not waiting[k]]
    names, order = list(sets), []
    while ready:
        k = names[heapq.heappop(ready)]
        order.append(k)
        for _, child in edges[k]:
            waiting[child] -= 1
            if not waiting[child]:
                heapq.heappush(ready, rank[child])
    if len(order) < len(names):
        stuck = [k for k in names if waiting[k]]
        fail("cycle", *(cycle({k: [(r, c) for r, c in edges[k] if waiting[c]] for k in stuck}) or ()))
    if errors:
        return None, carried, errors

    at = {k: i for i, k in enumerate(order)}
    variables = []
    for k in order:
        base = node[bases[k]]["base"] if k in bases else None
        links = []
        for r in into.get(k, ()):
            one, two = (r["sensitivity"], r["false_pass"]) if r["type"] == "observes" else (r["strength"], None)
            links.append({"parent": at[root[r["source"]]], "type": r["type"], "a": mean(one), "b": 0.0 if two is None else mean(two), "a_beta": spread(one), "b_beta": spread(two), "relation": r["id"]})
        variables.append({"name": k, "members": sets[k], "kind": "observation" if k in observations else "proposition", "base": mean(base), "base_beta": spread(base), "base_id": bases.get(k), "links": links})
    for r in graph["relations"]:
        if r["type"] == "exclusive":
            ends = sorted({at[root[r["source"]]], at[root[r["target"]]]})
            links = [{"parent": p, "type": "exclusive", "a": 0.0, "b": 0.0, "a_beta": None, "b_beta": None, "relation": r["id"]} for p in ends]
            variables.append({"name": f"exclusive[{r['id']}]", "members": [], "kind": "constraint", "base": None, "base_beta": None, "base_id": None, "links": links})
    return variables, carried, []


def parameters(graph: dict, network: list[dict]) -> list[tuple[str, str, int, int, str]]:
    """(kind, id, variable, link, field) of every parameter: bases in the order of the graph's variables, then those of
    relations in theirs. link is -1 for a base."""
    at = {v["name"]: i for i, v in enumerate(network)}
    out = [("base", network[at[k]]["base_id"], at[k], -1, "base") for k in inference_sets(graph) if network[at[k]]["base_id"] is not None]
    place = {x["relation"]: (i, j) for i, v in enumerate(network) for j, x in enumerate(v["links"]) if x["type"] in ACYCLIC}
    for r in graph["relations"]:
        if r["type"] in STRENGTH:
            out.append(("strength", r["id"], *place[r["id"]], "a"))
        elif r["type"] == "observes":
            out += [("sensitivity", r["id"], *place[r["id"]], "a"), ("false_pass", r["id"], *place[r["id"]], "b")]
    return out


def with_parameters(network: list[dict], values: dict[tuple[int, int, str], float]) -> list[dict]:
    """A copy in which some parameters, by (variable, link, field), take other values; credences stay."""
    out = list(network)
    for (v, j, field), x in values.items():
        if j < 0:
            out[v] = {**out[v], field: x}
        else:
            links = list(out[v]["links"])
            links[j] = {**links[j], field: x}
            out[v] = {**out[v], "links": links}
    return out


# many graphs


GRAPHS = 1024  # graphs that a worker takes on at once, at most
BYTES = 1 << 20  # and how large they may be in the batch; as Python objects they take some twenty times that


def records(c: pa.Array) -> list:
    """The same as c.to_pylist(), column by column; a column of nulls costs nothing, as most fields of graphs are."""
    if not len(c) or c.null_count == len(c):
        return [None] * len(c)
    there = None if c.null_count == 0 else c.is_valid().to_pylist()
    if pa.types.is_struct(c.type):
        names = [f.name for f in c.type]
        parts = [records(c.field(i) if c.null_count == 0 else pc.struct_field(c, [i])) for i in range(len(names))]
        out = [dict(zip(names, x)) for x in zip(*parts, strict=True)] if names else [{} for _ in range(len(c))]  # noqa: B905
    elif pa.types.is_list(c.type):
        flat, at, out = records(c.flatten()), 0, []
        for n in c.value_lengths().fill_null(0).to_pylist():
            out.append(flat[at : at + n])
            at += n
    elif (pa.types.is_floating(c.type) or pa.types.is_integer(c.type)) and there is None:
        return c.to_numpy(zero_copy_only=False).tolist()
    else:
        return c.to_pylist()
    return out if there is None else [x if ok else None for x, ok in zip(out, there, strict=True)]


def by_graph(df: DataFrame, run, schema: str, *columns: str) -> DataFrame:
    """run(rows) -> for each row its results as dicts; df's rows come in lists of at most GRAPHS and about BYTES. The results
    also have the row's graph_id and columns."""
    batches.limit(df.sparkSession)
    kinds = dict(df.dtypes)
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in ("graph_id", *columns)), schema])
    target = df.sparkSession.createDataFrame([], full).schema

    def inside(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for b in parts:
            some = max(1, min(GRAPHS, len(b) * BYTES // max(1, b.nbytes)))
            for at in range(0, len(b), some):
                rows = records(b.slice(at, some).to_struct_array())
                out = [{c: row[c] for c in ("graph_id", *columns)} | x for row, found in zip(rows, run(rows), strict=True) for x in found]
                if out:
                    yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(inside, target)


def credences(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, alpha and beta of a column of credences, and which are Betas. NaN where there is none."""
    p, alpha, beta = (np.asarray(pc.cast(pc.struct_field(c, k), pa.float64()).fill_null(np.nan)) for k in ("p", "alpha", "beta"))
    beta_there = np.asarray(pc.is_valid(c)) & np.asarray(pc.is_null(pc.struct_field(c, "p")))
    with np.errstate(invalid="ignore", divide="ignore"):
        whole = np.where(np.isinf(alpha + beta), (alpha / 2) / (alpha / 2 + beta / 2), alpha / (alpha + beta))
    return np.where(beta_there, whole, p), alpha, beta, beta_there


#: Graphs of one structure from which on they are compiled together.
ALIKE = 4


def structures(b: pa.RecordBatch) -> tuple[list[list[int]], list[int]]:
    """The graphs of a batch by structure: ids, ends, types as far as compiling tells them apart, and what is there of numbers;
    and those that go one by one, as what they give also depends on the numbers (equivalent nodes) or few are alike."""
    nodes, relations = b.column("nodes"), b.column("relations")
    n, r = nodes.flatten(), relations.flatten()
    size, per = (np.asarray(pc.list_value_length(x).fill_null(0)).astype(np.int64) for x in (nodes, relations))
    at, link_at = (np.concatenate([[0], np.cumsum(x)]) for x in (size, per))
    of = lambda x, k: pc.struct_field(x, k)
    code = np.asarray(pa.concat_arrays([of(n, "id"), of(r, "source"), of(r, "target"), of(r, "id")]).dictionary_encode().indices.fill_null(-1)).astype(np.int32)
    own, source, target, name = np.split(code, np.cumsum([len(n), len(r), len(r)]))
    there = lambda x, k: np.asarray(pc.is_valid(of(x, k))).astype(np.int32)
    kind = np.asarray(pc.index_in(of(r, "type"), value_set=pa.array(INFERENTIAL)).fill_null(len(INFERENTIAL))).astype(np.int32)
    kind[kind < len(STRENGTH)] = 0
    alone = np.zeros(len(b), bool)
    of_link = np.repeat(np.arange(len(b)), per)
    alone[of_link[(kind == INFERENTIAL.index("equivalent")) | (source < 0) | (target < 0) | (name < 0)]] = True
    alone[np.repeat(np.arange(len(b)), size)[own < 0]] = True
    heads = (own << 1 | there(n, "base")).tobytes()
    tails = np.stack([name, source, target, kind << 3 | there(r, "strength") << 2 | there(r, "sensitivity") << 1 | there(r, "false_pass")], -1).tobytes()
    lo, ll = (4 * at).tolist(), (16 * link_at).tolist()
    found: dict[tuple[bytes, bytes], list[int]] = {}
    for i in np.flatnonzero(~alone).tolist():
        found.setdefault((heads[lo[i] : lo[i + 1]], tails[ll[i] : ll[i + 1]]), []).append(i)
    left = np.flatnonzero(alone).tolist()
    groups = []
    for rows in found.values():
        names = name[link_at[rows[0]] : link_at[rows[0] + 1]]
        if len(rows) < ALIKE or len(set(names.tolist())) < len(names):
            left += rows
        else:
            groups.append(rows)
    return groups, sorted(left)


def assembled(b: pa.RecordBatch, groups: list[list[int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The compiled graphs of each group: one of them is compiled, and the numbers of all are put in its place."""
    nodes, relations = b.column("nodes"), b.column("relations")
    n, r = nodes.flatten(), relations.flatten()
    at, link_at = (np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(x).fill_null(0)).astype(np.int64))]) for x in (nodes, relations))
    base = credences(pc.struct_field(n, "base"))
    strength, sensitivity, false_pass = (credences(pc.struct_field(r, k)) for k in ("strength", "sensitivity", "false_pass"))
    types = pc.struct_field(r, "type")
    kind = schema.field("vars").type
    struct, link = kind.value_type, kind.value_type.field("links").type.value_type

    def spread(alpha: np.ndarray, beta: np.ndarray, there: np.ndarray, like: pa.DataType) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(alpha), pa.array(beta)], fields=list(like), mask=pa.array(~there))

    def struct_of(columns: dict, like: pa.DataType) -> pa.Array:
        return pa.StructArray.from_arrays([columns[f.name] if columns[f.name].type == f.type else columns[f.name].cast(f.type) for f in like], fields=list(like))

    for rows in groups:
        graph = {k: b.column(k)[rows[0]].as_py() for k in ("nodes", "relations")}
        variables, carried, errors = compile_graph(graph)
        many, which = len(rows), np.array(rows)
        same = lambda x, k, many=many: pa.array([x], schema.field(k).type).take(pa.array(np.zeros(many, np.int64)))
        if variables is None:
            yield pa.RecordBatch.from_arrays([b.column("graph_id").take(pa.array(which)), pa.nulls(many, kind), same(carried, "carried"), same(errors, "errors")], schema=schema)
            continue
        place = {x["id"]: i for i, x in enumerate(graph["nodes"])}
        order = {x["id"]: i for i, x in enumerate(graph["relations"])}
        links = [x for v in variables for x in v["links"]]
        tile = pa.array(np.tile(np.arange(len(variables)), many))
        again = pa.array(np.tile(np.arange(len(links)), many))
        each = lambda k, like, some, t: pa.array([x[k] for x in some], like.field(k).type).take(t)
        own = np.array([place.get(v["base_id"], -1) for v in variables])
        index = (at[which][:, None] + own).ravel()
        none = np.tile(own < 0, many)
        index[none] = 0
        mean_, alpha, beta, there = base if len(n) else (np.zeros(1),) * 4
        i = (link_at[which][:, None] + np.array([order[x["relation"]] for x in links], np.int64)).ravel()
        seen, fixed = (np.tile(np.array([x["type"] == k for x in links], bool), many) for k in ("observes", "exclusive"))
        pick = lambda j: np.where(seen, sensitivity[j][i], strength[j][i])  # noqa: E731, B023
        flat = struct_of({
            "parent": each("parent", link, links, again), "relation": each("relation", link, links, again), "type": types.take(pa.array(i)),
            "a": pa.array(np.where(fixed, 0.0, pick(0))), "b": pa.array(np.where(seen, false_pass[0][i], 0.0)),
            "a_beta": spread(pick(1), pick(2), pick(3) & ~fixed, link.field("a_beta").type), "b_beta": spread(false_pass[1][i], false_pass[2][i], false_pass[3][i] & seen, link.field("b_beta").type),
        }, link)
        counts = np.tile(np.array([len(v["links"]) for v in variables], np.int32), many)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat, type=struct.field("links").type)
        known = struct_of({
            **{k: each(k, struct, variables, tile) for k in ("name", "members", "kind", "base_id")},
            "base": pa.array(np.where(none, np.nan, mean_[index]), mask=none), "base_beta": spread(alpha[index], beta[index], there[index].astype(bool) & ~none, struct.field("base_beta").type), "links": listed,
        }, struct)
        nets = pa.ListArray.from_arrays(pa.array((np.arange(many + 1) * len(variables)).astype(np.int32)), known, type=kind)
        yield pa.RecordBatch.from_arrays([b.column("graph_id").take(pa.array(which)), nets, same(carried, "carried"), same([], "errors")], schema=schema)


def compiled(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, vars, carried, errors: a network per graph; vars is null where there are errors. Graphs of one structure are
    compiled together."""
    df = gathered(nodes, relations)
    batches.limit(df.sparkSession)
    target = df.sparkSession.createDataFrame([], f"graph_id {dict(df.dtypes)['graph_id']}, vars {VARS}, carried array<string>, errors {ERRORS}").schema

    def inside(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for b in parts:
            groups, left = structures(b)
            yield from assembled(b, groups, arrow)
            some = max(1, min(GRAPHS, len(b) * BYTES // max(1, b.nbytes)))
            for at in range(0, len(left), some):
                out = []
                for row in records(b.take(pa.array(left[at : at + some])).to_struct_array()):
                    variables, carried, errors = compile_graph(row)
                    out.append({"graph_id": row["graph_id"], "vars": variables, "carried": carried, "errors": errors})
                yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(inside, target)
