"""Commands on a graph file: make and edit it, ask it, diagnose it, check it against a rubric, re-check its obligations.

They are thin: each reads a file into node and relation tables by the strict rules, calls the operator that works on many
graphs, and prints its rows. With --json a command prints one JSON object; it ends with 1 on failure, which has one of the
codes of CODES. Files are written in one step, through a file beside them.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefmesh.operators import answers, diagnostics, edits, graphs, obligations, rubric as rubrics
from beliefmesh.operators.compiler import NODE, RELATION, gathered, inference_sets
from beliefmesh.sources import chunks, graph_json, latex, rubric_file

VERSION = "2"
FORMAT = "beliefmesh"
# fixed values: codes of failures
CODES = (
    "file-exists", "file-not-found", "io-error", "invalid-graph", "invalid-argument", "duplicate-id", "unknown-node", "cycle", "compile-error", "zero-probability",
    "problem-too-large", "invalid-rubric", "rubric-violation", "missing-extra", "verification-failed",
)


class Failure(Exception):
    """What a command reports: code, message and details."""

    def __init__(self, code: str, message: str, details: object = None):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details


def session() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"}
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()


class File:
    """A graph file: its format's name, tables and, for edits, the graph as a dict."""

    def __init__(self, path: str):
        self.path = Path(path)
        try:
            text = self.path.read_text(encoding="utf-8")
        except FileNotFoundError:
            raise Failure("file-not-found", f"no graph file {path}") from None
        except (OSError, UnicodeDecodeError) as e:
            raise Failure("io-error", f"can't read {path}: {e}") from None
        documents = session().createDataFrame([("graph", text)], "graph_id string, text string")
        nodes, relations, errors = graph_json.load_strict(documents)
        found = [f"{r['code']} {r['item']}" for r in errors.collect()]
        if found:
            raise Failure("invalid-graph", f"{path} breaks rules", sorted(found))
        # one document: its rows are at hand, so that each command reads it once
        self.nodes, self.relations = (session().createDataFrame(df.collect(), df.schema) for df in (nodes, relations))
        graphs.release(session())
        self.format = json.loads(text)["format"]

    def graph(self) -> dict:
        row = gathered(self.nodes, self.relations).first()
        return row.asDict(recursive=True) if row else {"graph_id": "graph", "nodes": [], "relations": []}


def save(graph: dict, path: Path, name: str) -> None:
    """Write a graph through a file beside it, so that a failure leaves the old one."""
    table = lambda rows, kind: session().createDataFrame([tuple(["graph", *(r.get(k) for k in kind)]) for r in rows], "graph_id string, " + ", ".join(f"{k} {v}" for k, v in kind.items()))
    rows = graph_json.dump(table(graph["nodes"], NODE), table(graph["relations"], RELATION), name).collect()
    text = rows[0]["text"] if rows else json.dumps({"format": name, "version": graph_json.VERSION, "nodes": [], "relations": []})
    clean = json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"
    try:
        handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(clean)
        Path(temporary).replace(path)
    except OSError as e:
        raise Failure("io-error", f"can't write {path}: {e}") from None


def rubric_at(path: str) -> dict:
    try:
        return rubric_file.rubric_from_text(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise Failure("file-not-found", f"no rubric file {path}") from None
    except (OSError, UnicodeDecodeError) as e:
        raise Failure("io-error", f"can't read {path}: {e}") from None
    except rubric_file.RubricError as e:
        raise Failure("invalid-rubric", str(e)) from None


def credence(text: str | None) -> dict | None:
    found = None if text is None else rubric_file.credence_from(text)
    if text is not None and found is None:
        raise Failure("invalid-argument", f"{text!r} is neither a probability nor beta:A,B")
    return found


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


Out = tuple[dict, list[str]]


def version(a) -> Out:
    return {"version": VERSION}, [VERSION]


def init(a) -> Out:
    if Path(a.path).exists() and not a.force:
        raise Failure("file-exists", f"{a.path} is there already")
    save({"nodes": [], "relations": []}, Path(a.path), FORMAT)
    return {"path": a.path}, [f"made {a.path}"]


def edited(a, change: Callable[[dict], tuple[dict, dict]]) -> Out:
    file = File(a.path)
    try:
        graph, told = change(file.graph())
    except edits.EditError as e:
        code = e.args[0] if e.args[0] in CODES else "invalid-argument"
        raise Failure(code, ": ".join(map(str, e.args))) from None
    save(graph, file.path, file.format)
    return {"path": a.path, **told}, [f"{k}: {v}" for k, v in told.items() if v]


def add_node(a) -> Out:
    sources = [answers.parse_source(s) for s in a.source]

    def change(graph: dict) -> tuple[dict, dict]:
        out, near = edits.add_node(graph, a.id, kind=a.kind, statement=a.statement, sources=sources or None, base=credence(a.base), stated=credence(a.stated))
        return out, {"id": a.id, "similar": near}

    return edited(a, change)


def relate(a) -> Out:
    name = a.id or f"{a.source}-{a.type}-{a.target}"
    values = {"strength": credence(a.strength), "sensitivity": credence(a.sensitivity), "false_pass": credence(a.false_pass)}
    return edited(a, lambda g: (edits.relate(g, name, a.type, a.source, a.target, **values), {"id": name}))


def split(a) -> Out:
    def change(graph: dict) -> tuple[dict, dict]:
        out, new = edits.split(graph, a.id, a.clause, a.fields)
        return out, {"id": a.id, "children": new}

    return edited(a, change)


def annotate(a) -> Out:
    from beliefmesh.functions import text

    own = rubric_at(a.rubric)
    settings = dict(s.split("=", 1) for s in a.set if "=" in s)
    if len(settings) < len(a.set):
        raise Failure("invalid-argument", "--set takes FIELD=VALUE")
    values = {k: text.value_of(v) for k, v in settings.items()}
    return edited(a, lambda g: (edits.annotate(g, own, a.id, a.type, values, a.rests_on, a.verdict, a.not_assessed), {"id": a.id}))


def ingest(a) -> Out:
    path = Path(a.document)
    if not path.is_file():
        raise Failure("file-not-found", f"no document {a.document}")
    if path.suffix != ".tex":
        raise Failure("missing-extra", f"no reader for {path.suffix or 'such files'}")
    if Path(a.path).exists() and not a.force:
        raise Failure("file-exists", f"{a.path} is there already")
    initial = rubric_at(a.rubric)["initial"] if a.rubric else {}
    files = [(path.stem, str(p.relative_to(path.parent)), p.read_text(encoding="utf-8")) for p in sorted(path.parent.rglob("*")) if p.suffix in (".tex", ".bbl")]
    spark = session()
    read = latex.read_latex(spark.createDataFrame(files, "document string, path string, text string"), spark.createDataFrame([(path.stem, path.name)], "document string, main string"))
    wrong = [r["error"] for r in read.where("error is not null").collect()]
    if wrong:
        raise Failure("io-error", wrong[0])
    nodes, relations, unresolved = chunks.chunk_graph(read.withColumn("document", F.lit(a.id or path.stem)), initial)
    row = gathered(nodes, relations).first()
    graph = row.asDict(recursive=True) if row else {"nodes": [], "relations": []}
    save(graph, Path(a.path), FORMAT)
    loose = [r["key"] for r in unresolved.orderBy("ord", "key").collect()]
    return {"path": a.path, "nodes": len(graph["nodes"]), "relations": len(graph["relations"]), "unresolved": loose}, [f"{len(graph['nodes'])} chunks, unresolved citations: {', '.join(loose) or 'none'}"]


def query(a) -> Out:
    file = File(a.path)
    parse = answers.parse_assignment
    target, given, do = parse(a.target, True), parse(a.given), parse(a.set)
    if a.draws < 0:
        raise Failure("invalid-argument", "--draws is 0 or more")
    row = [("graph", 0, a.kind, target, given, do)]
    asked = session().createDataFrame(row, "graph_id string, question long, kind string, target map<string,boolean>, given map<string,boolean>, do map<string,boolean>")
    found = answers.ask(file.nodes, file.relations, asked, a.observed, a.draws, a.seed).first()
    if found["code"]:
        detail = found["detail"]
        structured = json.loads(detail) if detail.startswith("{") else None
        raise Failure(found["code"] if found["code"] in CODES else "invalid-argument", found["code"] if structured else detail, structured)
    band = {k: found[k] for k in ("q05", "q50", "q95")} if found["q05"] is not None else None
    out = {"path": a.path, "kind": a.kind, "target": target, "given": given, "set": do, "point": found["point"]}
    if band:
        out |= {"band": band, "mean_over_draws": found["mean_over_draws"], "draws": found["draws"]}
    lines = [f"{found['point']:.6g}"] + ([f"band over {found['draws']} draws: {band['q05']:.6g} {band['q50']:.6g} {band['q95']:.6g}"] if band else [])
    return out, lines


def findings(rows: list[dict]) -> list[dict]:
    return [{k: r[k] for k in ("target", "id", "diagnostic", "message", "nodes", "relations", "value", "details")} for r in sorted(rows, key=lambda r: r["ord"])]


def diagnose(a) -> Out:
    file = File(a.path)
    spark = session()
    targets = None if a.targets == "stated" else spark.createDataFrame([("graph", t) for t in a.target], "graph_id string, target string")
    given = answers.parse_assignment(a.given)
    evidence = spark.createDataFrame([("graph", k, x) for k, x in given.items()], "graph_id string, node string, value boolean") if given else None
    try:
        diagnostics.check_options(a.claim_threshold, a.failure_threshold, a.min_supports)
    except ValueError as e:
        raise Failure("invalid-argument", str(e)) from None
    found = findings(rows_of(diagnostics.diagnose(file.nodes, file.relations, targets, evidence, a.observed, claim_threshold=a.claim_threshold, failure_threshold=a.failure_threshold, min_supports=a.min_supports)))
    wrong = [f for f in found if f["diagnostic"] == "error"]
    if wrong:
        names = {"unknown-node": "unknown-node", "zero-probability": "zero-probability", "too-large": "problem-too-large", "observed-target": "invalid-argument", "not-an-inference-variable": "invalid-argument"}
        raise Failure(names.get(wrong[0]["id"].split(":")[1], "compile-error"), wrong[0]["message"], wrong)
    return {"path": a.path, "findings": found}, [f["message"] for f in found]


def check(a) -> Out:
    file = File(a.path)
    if a.rubric:
        if a.level not in rubrics.LEVELS:
            raise Failure("invalid-argument", f"the level is one of {', '.join(rubrics.LEVELS)}")
        found = findings(rows_of(rubrics.check(file.nodes, file.relations, rubric_at(a.rubric), a.level, a.rubric_credences)))
        if found:
            raise Failure("rubric-violation", f"{len(found)} violations", found)
        return {"path": a.path, "level": a.level, "violations": []}, ["it passes"]
    graph = file.graph()
    from beliefmesh.operators.compiler import compile_graph

    _, _, errors = compile_graph(graph)
    if errors:
        raise Failure("compile-error", "; ".join(f"{e['code']} {', '.join(e['items'])}" for e in errors), answers.compile_failure(graph, errors))
    return {"path": a.path, "nodes": len(graph["nodes"]), "relations": len(graph["relations"]), "variables": len(inference_sets(graph))}, ["it is valid and compiles"]


def coverage(a) -> Out:
    file = File(a.path)
    found = rows_of(rubrics.coverage(file.nodes, file.relations, rubric_at(a.rubric)))
    out = found[0] if found else {}
    out.pop("graph_id", None)
    return {"path": a.path, **out}, [f"{x['type']}: {x['count']} ({x['share']:.0%})" for x in out.get("by_type", [])]


def verify(a) -> Out:
    file = File(a.path)
    folder = file.path.resolve().parent
    spark = session()
    names = {json.loads(r["obligation"])["discharge"]["anchor"]["document"] for r in file.relations.where("get_json_object(obligation, '$.discharge.kind') = 'citation'").select("obligation").collect()}
    texts = [(n, (folder / n).read_text(encoding="utf-8", errors="replace")) for n in sorted(names) if (folder / n).is_file()]
    documents = spark.createDataFrame(texts, "document string, text string")
    found = rows_of(obligations.verify(spark, file.relations, documents, str(folder) if a.run_scripts else None, a.timeout))
    found = sorted(({k: r[k] for k in ("relation", "kind", "outcome", "findings", "status", "reason")} for r in found), key=lambda r: r["relation"])
    if any(r["outcome"] == "flagged" for r in found):
        raise Failure("verification-failed", ", ".join(f"{r['relation']}: {', '.join(r['findings'])}" for r in found if r["findings"]), found)
    return {"path": a.path, "checks": found}, [f"{r['relation']}: {r['outcome']}" for r in found]


def sorries(a) -> Out:
    file = File(a.path)
    folder, spark = file.path.resolve().parent, session()
    names = {r["p"] for r in file.relations.select(F.get_json_object("obligation", "$.discharge.script").alias("p")).where("p is not null").collect()}
    scripts = spark.createDataFrame([("graph", n, (folder / n).read_text(encoding="utf-8", errors="replace")) for n in sorted(names) if (folder / n).is_file()], "graph_id string, path string, source string")
    targets = spark.createDataFrame([("graph", a.target)], "graph_id string, target string")
    found = sorted(rows_of(obligations.sorries(file.nodes, file.relations, targets, scripts)), key=lambda r: r["ord"])
    if found and found[0]["error"]:
        raise Failure({"unknown-node": "unknown-node", "zero-probability": "zero-probability"}.get(found[0]["error"], "compile-error"), found[0]["error"])
    keep = ("relation", "type", "source", "relation_target", "reason", "obligation", "sensitivity")
    open_ = [{k: r[k] for k in keep} for r in found if r["reason"]]
    return {"path": a.path, "target": a.target, "discharged": [r["relation"] for r in found if not r["reason"]], "sorries": open_}, [f"{r['relation']}: {r['reason']}" for r in open_]


def commands() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="beliefmesh")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(run, name: str, path: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--json", action="store_true")
        if path:
            p.add_argument("path")
        return p

    many = {"action": "append", "default": []}
    command(version, "version", False)
    command(init, "init").add_argument("--force", action="store_true")
    p = command(add_node, "add-node")
    p.add_argument("id")
    p.add_argument("--kind", default="proposition")
    for name in ("--statement", "--base", "--stated"):
        p.add_argument(name)
    p.add_argument("--source", **many)
    p = command(relate, "relate")
    for name in ("type", "source", "target"):
        p.add_argument(name)
    for name in ("--id", "--strength", "--sensitivity", "--false-pass"):
        p.add_argument(name)
    p = command(ingest, "ingest")
    p.add_argument("document")
    p.add_argument("--rubric")
    p.add_argument("--id")
    p.add_argument("--force", action="store_true")
    p = command(query, "query")
    p.add_argument("kind")
    p.add_argument("target", nargs="+")
    p.add_argument("--given", **many)
    p.add_argument("--set", **many)
    p.add_argument("--draws", type=int, default=answers.DRAWS)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--observed", action="store_true")
    p = command(diagnose, "diagnose")
    p.add_argument("target", nargs="*")
    p.add_argument("--targets", choices=["stated"])
    p.add_argument("--given", **many)
    p.add_argument("--observed", action="store_true")
    p.add_argument("--claim-threshold", type=float, default=diagnostics.CLAIM_THRESHOLD)
    p.add_argument("--failure-threshold", type=float, default=diagnostics.FAILURE_THRESHOLD)
    p.add_argument("--min-supports", type=int, default=diagnostics.MIN_SUPPORTS)
    p = command(check, "check")
    p.add_argument("--rubric")
    p.add_argument("--level", default="typed")
    p.add_argument("--rubric-credences", action="store_true")
    command(coverage, "coverage").add_argument("--rubric", required=True)
    p = command(split, "split")
    p.add_argument("id")
    p.add_argument("--clause", **many)
    p.add_argument("--fields", action="store_true")
    p = command(annotate, "annotate")
    p.add_argument("id")
    p.add_argument("--rubric", required=True)
    p.add_argument("--type")
    p.add_argument("--set", **many)
    p.add_argument("--rests-on", **many)
    p.add_argument("--verdict")
    p.add_argument("--not-assessed")
    p = command(verify, "verify")
    p.add_argument("--run-scripts", action="store_true", help="run the scripts that the graph names, in its folder")
    p.add_argument("--timeout", type=float, default=obligations.TIMEOUT)
    command(sorries, "sorries").add_argument("target")
    return parser


def main(argv: list[str] | None = None) -> int:
    a = commands().parse_args(argv)
    try:
        out, lines = a.run(a)
    except (Failure, answers.QuestionError) as e:
        code, message, details = (e.code, e.message, e.details) if isinstance(e, Failure) else (e.args[0], e.args[1], None)
        if a.json:
            print(json.dumps({"command": a.command, "error": {"code": code, "message": message, "details": details}}, indent=2))
        else:
            print(f"error: {message}", file=sys.stderr)
        return 1
    print(json.dumps({"command": a.command, **out}, indent=2) if a.json else "\n".join(lines))
    return 0
