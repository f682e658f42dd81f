"""Rubrics: TOML files that say what types of nodes a graph of a document may have, what their forms hold, what they rest
on, and the credences that go with them.

`read_rubric` reads one on the driver into a plain dict, a small thing that goes along with tasks. Every key is checked:
a file that breaks a rule raises RubricError with the place. A credence is a dict of p, alpha and beta.
"""

from __future__ import annotations

import datetime
import math
import tomllib
from collections.abc import Callable
from typing import Any

from beliefmesh.functions import text
from beliefmesh.operators.compiler import mean

# fixed values: names that rubric files and graphs use
ORIGINS = ("document", "analyst", "evidence")
BUILT_IN = ("unassigned", "compound")
FIELDS = ("verbatim", "number", "quantity", "eqref", "enum", "bool", "scope")
STATUSES = ("example", "calibrated")
SCORINGS = ("brier", "log")
TABLES = {1: ("rubric", "parameters", "initial", "types"), 2: ("rubric", "parameters", "initial", "types", "calibration", "checks", "premises", "hedges")}

Reader = Callable[[Any, str], Any]


class RubricError(ValueError):
    """A rubric file isn't TOML, is of an unknown format, or breaks a rule."""


def need(holds: bool, path: str, what: str) -> None:
    if not holds:
        raise RubricError(f"{path}: {what}")


def string(x: Any, path: str) -> str:
    need(isinstance(x, str) and x != "", path, "must be a non-empty string")
    return x


def flag(x: Any, path: str) -> bool:
    need(isinstance(x, bool), path, "must be true or false")
    return x


def positive(x: Any, path: str) -> int:
    need(isinstance(x, int) and not isinstance(x, bool) and x >= 1, path, "must be an integer of 1 or more")
    return x


def one_of(*allowed: str) -> Reader:
    def read(x: Any, path: str) -> str:
        need(x in allowed, path, f"must be one of {', '.join(allowed)}")
        return x

    return read


def strings(of: Reader = string, empty: bool = False) -> Reader:
    def read(x: Any, path: str) -> list[str]:
        need(isinstance(x, list) and (empty or bool(x)), path, "must be an array of strings" + ("" if empty else ", not empty"))
        out = [of(y, f"{path}[{i}]") for i, y in enumerate(x)]
        need(len(set(out)) == len(out), path, "lists a value twice")
        return out

    return read


def record(needed: dict[str, Reader], optional: dict[str, tuple[Reader, Any]] | None = None) -> Reader:
    """A table of these keys alone; an absent optional one takes its default."""
    optional = optional or {}

    def read(x: Any, path: str) -> dict:
        need(isinstance(x, dict), path, "must be a table")
        extra, lacking = sorted(set(x) - {*needed, *optional}), sorted(set(needed) - set(x))
        need(not extra, path, f"has unknown keys {extra}")
        need(not lacking, path, f"lacks {lacking}")
        out = {k: r(x[k], f"{path}.{k}") for k, r in needed.items()}
        return out | {k: r(x[k], f"{path}.{k}") if k in x else default for k, (r, default) in optional.items()}

    return read


def table_of(reader: Callable[[str, Any, str], Any]) -> Reader:
    """A table of any keys: reader(key, value, path)."""

    def read(x: Any, path: str) -> dict:
        need(isinstance(x, dict), path, "must be a table")
        return {k: reader(k, v, f"{path}.{k}") for k, v in x.items()}

    return read


def credence_from(x: str) -> dict | None:
    """`0.3` or `beta:8,2` (its name in any case); None if neither or out of range."""
    kind, colon, numbers = x.partition(":")
    try:
        if not colon:
            p = float(x)
            return {"p": p, "alpha": None, "beta": None} if 0 <= p <= 1 else None
        a, b = map(float, numbers.split(","))
    except ValueError:
        return None
    fits = kind.strip().lower() == "beta" and 0 < a < math.inf and 0 < b < math.inf
    return {"p": None, "alpha": a, "beta": b} if fits else None


def credence(x: Any, path: str) -> dict:
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    found = credence_from(repr(float(x)) if number else x) if number or isinstance(x, str) else None
    need(found is not None, path, "must be a probability, or a string such as 'beta:8,2'")
    return found


def domain(x: Any, path: str) -> tuple[float | None, float | None]:
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v)
    need(isinstance(x, list) and len(x) == 2 and all(map(number, x)), path, "must be [low, high], -inf or inf for an open end")
    need(x[0] <= x[1], path, "has its low end above its high one")
    return tuple(None if math.isinf(v) else float(v) for v in x)


def form_field(x: Any, path: str) -> dict:
    out = record({"type": one_of(*FIELDS)}, {"required": (flag, False), "values": (strings(), [])})(x, path)
    need((out["type"] == "enum") == ("values" in x), path, "an enum takes values, and nothing else does")
    return out


RESTS_ON = record({"types": strings(), "relation": one_of("requires", "supports"), "strength": credence}, {"min": (positive, 1)})
NODE_TYPE = record({}, {"description": (string, ""), "origins": (strings(one_of(*ORIGINS)), ["document"]), "assess": (flag, False), "base": (credence, None), "form": (table_of(lambda _, v, p: form_field(v, p)), {}), "rests_on": (RESTS_ON, None)})


def node_type(name: str, x: Any, path: str) -> dict:
    need(name not in BUILT_IN, path, "is built in")
    return NODE_TYPE(x, path)


def date(x: Any, path: str) -> str:
    need(type(x) is datetime.date, path, "must be a date")
    return x.isoformat()


def rubric_of(data: Any) -> dict:
    """The rubric of parsed TOML: name, version, types (with one for each check), parameters, initial, calibration, checks,
    premises, hedges (by their comparison form)."""
    need(isinstance(data, dict) and isinstance(data.get("rubric"), dict) and "types" in data, "the rubric", "needs the tables rubric and types")
    head = record({"format": lambda x, _: x, "name": string, "version": string})(data["rubric"], "rubric")
    need(type(head["format"]) is int and head["format"] in TABLES, "rubric.format", f"must be one of {list(TABLES)}")
    extra = sorted(set(data) - set(TABLES[head["format"]]))
    need(not extra, "the rubric", f"has unknown tables {extra}")
    types = table_of(node_type)(data["types"], "types")
    declared = strings(lambda x, path: (need(x in types, path, "is no declared type"), x)[1])
    for name, t in types.items():
        if t["rests_on"]:
            declared(t["rests_on"]["types"], f"types.{name}.rests_on.types")
    parameters = table_of(lambda _, v, p: record({"unit": string}, {"domain": (domain, (None, None))})(v, p))(data.get("parameters", {}), "parameters")

    def first_type(_: str, x: Any, path: str) -> str:
        need(isinstance(x, str) and x in types and "document" in types[x]["origins"], path, "is no declared type of document nodes")
        return x

    def check(name: str, x: Any, path: str) -> dict:
        need(name not in types and name not in BUILT_IN, path, "is a type already")
        out = record({"targets": declared, "sensitivity": credence, "false_pass": credence, "models": strings(empty=True)}, {"description": (string, "")})(x, path)
        need(mean(out["sensitivity"]) > mean(out["false_pass"]), path, "sensitivity must exceed false_pass in the mean")
        return out

    hedges: dict[str, dict] = {}

    def phrase(key: str, x: Any, path: str) -> None:
        form = text.hedge(key)
        need(form != "" and form not in hedges, path, "is empty, or the same phrase as another")
        hedges[form] = credence(x, path)

    initial = table_of(first_type)(data.get("initial", {}), "initial")
    checks = table_of(check)(data.get("checks", {}), "checks")
    premises = record({"base": credence, "strength": credence, "for": declared, "max_per_conclusion": positive})(data["premises"], "premises") if "premises" in data else None
    calibration = record({"status": one_of(*STATUSES), "scoring": one_of(*SCORINGS), "against": string, "date": date})(data["calibration"], "calibration") if "calibration" in data else None
    table_of(phrase)(data.get("hedges", {}), "hedges")
    for name, c in checks.items():
        types[name] = NODE_TYPE({"origins": ["evidence"]}, f"checks.{name}") | {"description": c["description"]}
    return {"name": head["name"], "version": head["version"], "types": types, "parameters": parameters, "initial": initial, "calibration": calibration, "checks": checks, "premises": premises, "hedges": hedges}


def rubric_from_text(toml: str) -> dict:
    try:
        data = tomllib.loads(toml)
    except tomllib.TOMLDecodeError as error:
        raise RubricError(f"not TOML: {error}") from None
    return rubric_of(data)


def read_rubric(spark, path: str) -> dict:
    """The rubric in a file, in any store that Spark reads."""
    return rubric_from_text(spark.read.text(path, wholetext=True).first()["value"])


def hedge_credence(rubric: dict, phrase: str) -> dict | None:
    return rubric["hedges"].get(text.hedge(phrase))
