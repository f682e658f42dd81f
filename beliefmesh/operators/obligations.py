"""Obligations of relations: whether a check can fail, what is still open, what a target rests on, and re-checking.

An obligation is JSON: a statement and a discharge of one kind: formal (theorem), symbolic (script), numerical (script,
value, tolerance), citation (anchor with a quote) or judgement; scripts may carry the digest and status of a recorded run.

Reading what is recorded (`sorries`, `can_fail`) never runs anything. `verify` compares citations with the documents by a
join, and re-runs scripts only where the caller asks for it with `run_scripts`, on the driver, in a directory of its own
choice: a graph's scripts are someone else's code.
"""

from __future__ import annotations

import ast
import json
import math
import subprocess
import sys
from collections.abc import Generator, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from beliefmesh.functions import text
from beliefmesh.operators import compiler, diagnostics, solver
from beliefmesh.operators.compiler import ACYCLIC, by_graph, gathered

SCRIPTS = ("symbolic", "numerical")
TIMEOUT = 300.0
TIMED_OUT = -1
# fixed values: calls that end a script, by module and name
EXITS = {("sys", "exit"), ("os", "_exit"), ("", "exit"), ("", "quit")}


# can a script fail


def truth(test: ast.expr) -> bool | None:
    """The value of a condition that the source fixes; None if only a run can tell."""
    while isinstance(test, ast.IfExp):
        taken = truth(test.test)
        if taken is None:
            return None
        test = test.body if taken else test.orelse
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        inner = truth(test.operand)
        return None if inner is None else not inner
    return bool(test.value) if isinstance(test, ast.Constant) else None


def reachable(node: ast.AST) -> Generator[ast.AST]:
    """The nodes of a tree that no fixed condition shuts off. An assert that always holds isn't one."""
    known = truth(node.test) if isinstance(node, (ast.If, ast.IfExp, ast.While, ast.Assert)) else None
    if isinstance(node, ast.Assert) and known:
        return
    yield node
    if known is None or isinstance(node, ast.Assert) or isinstance(node, ast.While) and known:
        for part in ast.iter_child_nodes(node):
            yield from reachable(part)
        return
    taken = node.body if known else node.orelse
    for part in taken if isinstance(taken, list) else [taken]:
        yield from reachable(part)


def fails_by(node: ast.AST) -> bool:
    if not isinstance(node, ast.Call):
        return isinstance(node, (ast.Assert, ast.Raise))
    f = node.func
    name = (f.value.id, f.attr) if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else ("", f.id) if isinstance(f, ast.Name) else None
    if name not in EXITS or not node.args:
        return False
    status = node.args[0]
    return not (isinstance(status, ast.Constant) and (status.value is None or status.value == 0))


def source_can_fail(source: str) -> bool:
    """Whether a script has a way to fail that some run may reach: an assert, a raise, or an exit with a status that isn't 0.
    One that doesn't parse has none."""
    try:
        tree = ast.parse(source)
        return any(map(fails_by, reachable(tree)))
    except (SyntaxError, ValueError, RecursionError):
        return False


@F.pandas_udf(BooleanType())
def can_fail(source: pd.Series) -> pd.Series:
    return source.map(source_can_fail, na_action="ignore").astype("boolean")


# what is open


def discharge_of(relation: dict) -> tuple[dict | None, dict | None]:
    obligation = json.loads(relation["obligation"]) if relation["obligation"] else None
    return obligation, (obligation or {}).get("discharge")


def sorry_reason(relation: dict, scripts: dict[str, str]) -> str | None:
    """Why a step rests on judgement alone, by what is recorded; None if it is discharged. scripts: sources by path."""
    obligation, discharge = discharge_of(relation)
    if discharge is None:
        return "no-obligation" if obligation is None else "undischarged"
    kind = discharge["kind"]
    if kind not in SCRIPTS:
        return "judgement" if kind == "judgement" else None
    status = discharge.get("status")
    if status is None or status != 0:
        return "never-run" if status is None else "recorded-failure"
    if discharge["script"] not in scripts:
        return "missing-script"
    return None if source_can_fail(scripts[discharge["script"]]) else "cannot-fail"


def backwards(graph: dict) -> dict[str, list[tuple[str, str]]]:
    """Of each node, the inferential relations into it and those that touch it as equivalences or exclusions, and their other end."""
    near: dict[str, list[tuple[str, str]]] = {}
    for r in graph["relations"]:
        if r["type"] in ACYCLIC or r["type"] in ("equivalent", "exclusive"):
            near.setdefault(r["target"], []).append((r["id"], r["source"]))
        if r["type"] in ("equivalent", "exclusive"):
            near.setdefault(r["source"], []).append((r["id"], r["target"]))
    return near


def steps_of(graph: dict, target: str, near: dict[str, list[tuple[str, str]]] | None = None) -> set[str]:
    """Ids of the inferential relations that a target rests on: those into what it reaches, and equivalences and exclusions
    that touch it, backwards."""
    near = backwards(graph) if near is None else near
    reach, found, stack = {target}, set(), [target]
    while stack:
        for relation, other in near.get(stack.pop(), ()):
            found.add(relation)
            if other not in reach:
                reach.add(other)
                stack.append(other)
    return found


SORRIES = "target string, ord long, relation string, type string, source string, relation_target string, reason string, obligation string, sensitivity double, error string"


class Owed:
    """What all targets of a graph need, found once, so that the work for a target is what it rests on."""

    def __init__(self, graph: dict, scripts: dict[str, str]):
        self.graph, self.scripts, self.wrong = graph, scripts, compiler.defects(graph)
        self.network, carried, self.errors = (None, [], []) if self.wrong else compiler.compile_graph(graph)
        self.carried, self.near = set(carried), backwards(graph)
        self.places: dict[str, list[int]] = {}
        for i, r in enumerate(graph["relations"]):
            self.places.setdefault(r["id"], []).append(i)
        self.reasons: dict[int, tuple[str | None, str | None]] = {}
        network = self.network or []
        self.at = {name: i for i, v in enumerate(network) for name in v["members"]}
        self.link = {x["relation"]: (i, j) for i, v in enumerate(network) for j, x in enumerate(v["links"]) if x["type"] in compiler.STRENGTH}
        # the connected part of each variable, and the constraints in it
        part = list(range(len(network)))

        def top(v: int) -> int:
            while part[v] != v:
                part[v] = v = part[part[v]]
            return v

        for i, v in enumerate(network):
            for x in v["links"]:
                part[top(x["parent"])] = top(i)
        self.part = [top(v) for v in range(len(network))]
        self.failed: str | bool | None = None
        self.constraints: dict[int, list[int]] = {}
        for v in solver.constraints(network):
            self.constraints.setdefault(self.part[v], []).append(v)

    def reason(self, i: int) -> tuple[str | None, str | None]:
        """Why the step rests on judgement, and its obligation's statement."""
        if i not in self.reasons:
            r = self.graph["relations"][i]
            self.reasons[i] = sorry_reason(r, self.scripts), (discharge_of(r)[0] or {}).get("statement")
        return self.reasons[i]

    def above(self, ends: list[int]) -> tuple[list[dict], dict[int, int]]:
        """The network of some variables and all above them, and their numbers in it."""
        keep, stack = set(), list(ends)
        while stack:
            v = stack.pop()
            if v not in keep:
                keep.add(v)
                stack += (x["parent"] for x in self.network[v]["links"])
        place = {v: i for i, v in enumerate(sorted(keep))}
        return [{**self.network[v], "links": [{**x, "parent": place[x["parent"]]} for x in self.network[v]["links"]]} for v in place], place

    def impossible(self) -> diagnostics.Asking:
        """The error if the graph's constraints can't all hold; asked once."""
        if self.failed is None:
            seen = solver.constraints(self.network or [])
            small, place = self.above(list(seen))
            try:
                (whole,) = yield [(small, {place[v]: True for v in seen}, {}, ())]
                self.failed = "zero-probability" if whole <= 0 else False
            except diagnostics.DiagnosticError as e:
                self.failed = e.args[0]
        return [self.failed]


def sorries_of(graph: dict, target: str, scripts: dict[str, str], owed: Owed | None = None) -> diagnostics.Asking:
    """The steps a target rests on, in the graph's order for discharged ones (reason null), after the sorries by how far the
    target moves with their strength, those without one last. owed: what is known of the graph already."""
    blank = {"target": target, "ord": 0, "relation": None, "type": None, "source": None, "relation_target": None, "reason": None, "obligation": None, "sensitivity": None}
    owed = owed or Owed(graph, scripts)
    if owed.wrong:
        return [{**blank, "error": ", ".join(owed.wrong)}]
    if owed.network is None:
        return [{**blank, "error": owed.errors[0]["code"]}]
    (failed,) = yield from owed.impossible()
    if failed:
        return [{**blank, "error": failed}]
    if target not in owed.at:
        return [{**blank, "error": "not-an-inference-variable" if target in owed.carried else "unknown-node"}]
    steps = sorted(i for k in steps_of(graph, target, owed.near) for i in owed.places[k])
    t = owed.at[target]
    seen = owed.constraints.get(owed.part[t], [])
    small, place = owed.above([t, *seen])
    held = {place[v]: True for v in seen}
    # only strengths of open steps are asked for; those that nothing asked for lies below have no effect
    moved = list(dict.fromkeys(k for k in (graph["relations"][i]["id"] for i in steps if owed.reason(i)[0]) if k in owed.link))
    by = dict.fromkeys(moved, 0.0)
    moved = [k for k in moved if owed.link[k][0] in place]
    asked = {**held, place[t]: True}
    requests = [(small, s, {}, ((place[owed.link[k][0]], owed.link[k][1], "a", x),)) for k in moved for x in (0.0, 1.0) for s in (asked, held)]
    try:
        n, d, *got = yield [(small, asked, {}, ()), (small, held, {}, ()), *requests]
    except diagnostics.DiagnosticError as e:
        return [{**blank, "error": e.args[0]}]
    for i, k in enumerate(moved):
        n0, d0, n1, d1 = got[4 * i : 4 * i + 4]
        by[k] = ((n1 - n0) * d - n * (d1 - d0)) / d**2
    open_, done = [], []
    for i in steps:
        r, (reason, statement) = graph["relations"][i], owed.reason(i)
        row = {"target": target, "relation": r["id"], "type": r["type"], "source": r["source"], "relation_target": r["target"], "reason": reason, "obligation": statement, "sensitivity": by.get(r["id"]) if reason else None, "error": None}
        (open_ if reason else done).append(row)
    open_.sort(key=lambda x: (x["sensitivity"] is None, -abs(x["sensitivity"] or 0.0)))
    return [{**x, "ord": i} for i, x in enumerate([*open_, *done])]


#: Targets whose requests are solved together.
TOGETHER = 256


def sorries(nodes: DataFrame, relations: DataFrame, targets: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """Rows of SORRIES by graph and target. targets: graph_id, target; scripts: graph_id, path, source."""
    rows = gathered(nodes, relations).join(targets.groupBy("graph_id").agg(F.array_sort(F.collect_set("target")).alias("targets")), "graph_id")
    if scripts is not None:
        rows = rows.join(scripts.groupBy("graph_id").agg(F.collect_list(F.struct("path", "source")).alias("scripts")), "graph_id", "left")

    def run(batch: list[dict]) -> Iterator[list[dict]]:
        for g in batch:
            own = {x["path"]: x["source"] for x in g.get("scripts") or ()}
            owed, out = Owed(g, own), []
            diagnostics.lockstep([owed.impossible()])
            for at in range(0, len(g["targets"]), TOGETHER):
                for found in diagnostics.lockstep([sorries_of(g, t, own, owed) for t in g["targets"][at : at + TOGETHER]]):
                    out += found
            yield out

    return by_graph(rows, run, SORRIES)


# re-checking

DISCHARGE = "statement string, discharge struct<kind:string,theorem:string,script:string,digest:string,status:int,value:double,tolerance:double,anchor:struct<document:string,locator:string,quote:string,digest:string>>"


def check_citations(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """graph_id, relation, outcome (passed, flagged, unchecked), findings: the quotes of citations looked for in the normalised
    text of the document they name. documents: document, text; one that isn't there leaves a citation unchecked."""
    own = relations.select("graph_id", F.col("id").alias("relation"), F.from_json("obligation", DISCHARGE).alias("o")).where("o.discharge.kind = 'citation'")
    cited = own.select("graph_id", "relation", F.col("o.discharge.anchor.document").alias("document"), F.col("o.discharge.anchor.quote").alias("quote"), F.col("o.discharge.anchor.digest").alias("digest"))
    cited = cited.withColumn("q", text.normalise_text(F.col("quote"))).withColumn("own", text.text_digest(F.col("quote")))
    texts = documents.select("document", text.normalise_text(F.col("text")).alias("t"))
    met = cited.join(texts, "document", "left")
    wrong = F.array_compact(F.array(F.when(F.col("digest") != F.col("own"), F.lit("quote-digest-mismatch")), F.when(~F.contains("t", "q"), F.lit("quote-not-found"))))
    out = met.select("graph_id", "relation", F.col("t").isNotNull().alias("there"), wrong.alias("w"))
    return out.select("graph_id", "relation", F.when(~F.col("there"), "unchecked").when(F.size("w") > 0, "flagged").otherwise("passed").alias("outcome"), F.when(F.col("there"), F.col("w")).otherwise(F.array().cast("array<string>")).alias("findings"))


def result_problem(discharge: dict, output: str) -> str | None:
    """What is wrong with the last line a numerical script printed."""
    lines = [x.strip() for x in output.splitlines() if x.strip()]
    try:
        found = float(lines[-1])
    except (IndexError, ValueError):
        return "result-missing"
    near = math.isfinite(found) and abs(found - discharge["value"]) <= discharge["tolerance"]
    return None if near else "out-of-tolerance"


def check_script(discharge: dict, directory: Path, timeout: float) -> tuple[str, list[str], int | None]:
    """outcome, findings and status of running a discharge's script now, from its own directory."""
    path = directory / discharge["script"]
    try:
        data = path.read_bytes()
    except OSError:
        return "flagged", ["missing-script"], None
    recorded = discharge.get("status")
    found = ["never-run"] if recorded is None else ["script-changed"] if discharge.get("digest") != "sha256:" + __import__("hashlib").sha256(data).hexdigest() else []
    if not source_can_fail(data.decode("utf-8", "replace")):
        found.append("cannot-fail")
    try:
        done = subprocess.run([sys.executable, str(path)], cwd=path.parent, capture_output=True, timeout=timeout, check=False)
        status, output = done.returncode, done.stdout.decode("utf-8", "replace")
    except subprocess.TimeoutExpired:
        status, output = TIMED_OUT, ""
    if recorded is not None and (status == 0) != (recorded == 0):
        found.append("contradicted")
    elif status != 0:
        found.append("check-failed")
    if status == 0 and discharge["kind"] == "numerical" and (problem := result_problem(discharge, output)):
        found.append(problem)
    return "flagged" if found else "passed", found, status


CHECKS = "graph_id string, relation string, kind string, outcome string, findings array<string>, status int, reason string"


def verify(spark: SparkSession, relations: DataFrame, documents: DataFrame, run_scripts: str | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """Every discharge re-checked: graph_id, relation, kind, outcome, findings, status, reason.

    run_scripts: a directory of the driver whose scripts may be run there, one after the other; without it, script
    discharges are unchecked. It trusts the graphs' scripts; with many graphs it is slow, as it is meant for a few."""
    own = relations.select(F.col("graph_id").cast("string").alias("graph_id"), F.col("id").alias("relation"), "obligation", F.from_json("obligation", DISCHARGE).alias("o")).where("o.discharge.kind is not null")
    kind = F.col("o.discharge.kind").alias("kind")
    none, blank = F.array().cast("array<string>").alias("findings"), F.lit(None).cast("int").alias("status")
    cited = check_citations(relations, documents)
    out = cited.select(F.col("graph_id").cast("string").alias("graph_id"), "relation", F.lit("citation").alias("kind"), "outcome", "findings", blank, F.when(F.col("outcome") == "unchecked", "no such document").alias("reason"))
    rest = own.where("o.discharge.kind in ('formal', 'judgement')")
    out = out.unionByName(rest.select("graph_id", "relation", kind, F.when(F.col("o.discharge.kind") == "formal", "unchecked").otherwise("judgement").alias("outcome"), none, blank, F.when(F.col("o.discharge.kind") == "formal", "no proof checker").alias("reason")))
    scripts = own.where(F.col("o.discharge.kind").isin(*SCRIPTS))
    if run_scripts is None:
        return out.unionByName(scripts.select("graph_id", "relation", kind, F.lit("unchecked").alias("outcome"), none, blank, F.lit("scripts are not run").alias("reason")))
    rows = []
    for r in scripts.select("graph_id", "relation", "obligation").toLocalIterator():
        d = json.loads(r["obligation"])["discharge"]
        outcome, found, status = check_script(d, Path(run_scripts), timeout)
        rows.append((r["graph_id"], r["relation"], d["kind"], outcome, found, status, None))
    return out.unionByName(spark.createDataFrame(rows, CHECKS))
