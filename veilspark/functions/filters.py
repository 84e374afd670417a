"""Filter trees: validation, normal form and compilation to predicates."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, MAX_ARGS, MAX_VALUES, MAX_OPERAND, MAX_FIELD = 16, 1024, 32, 100, 4096, 256
_FIELD = re.compile(r"[^\W\d]\w*\Z")


def problems(node: Any) -> list[str]:
    """What is wrong with a filter tree; empty if it can be compiled."""
    found: list[str] = []
    nodes = 0

    def visit(x: Any, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            found.append("too large")
            return
        op = x.get("op") if isinstance(x, dict) else None
        if op in ("and", "or"):
            args = x.get("args")
            if set(x) != {"op", "args"} or not isinstance(args, list) or not 1 <= len(args) <= MAX_ARGS:
                found.append(f"{op}: 1 to {MAX_ARGS} args")
                return
            for a in args:
                visit(a, depth + 1)
        elif op == "not":
            if set(x) != {"op", "arg"}:
                found.append("not: one arg")
                return
            visit(x["arg"], depth + 1)
        elif op in ("eq", "ne", "in"):
            operand = "values" if op == "in" else "value"
            field = x.get("field")
            if set(x) != {"op", "field", operand} or not isinstance(field, str) or not _FIELD.match(field) or len(field.encode()) > MAX_FIELD:
                found.append(f"{op}: field and {operand}")
                return
            values = x[operand] if op == "in" else [x[operand]]
            if not isinstance(values, list) or not 1 <= len(values) <= MAX_VALUES:
                found.append(f"in: 1 to {MAX_VALUES} values")
                return
            found.extend("operand: a scalar of bounded size" for v in values if isinstance(v, (dict, list)) or len(json.dumps(v, ensure_ascii=False).encode()) > MAX_OPERAND)
        else:
            found.append("unknown op")

    visit(node, 1)
    return found


def normal_form(node: dict | None) -> dict | None:
    """Equal filters have equal normal forms: fields in lower case, arguments
    and values sorted and once."""
    if node is None:
        return None
    op = node["op"]
    dump = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
    if op in ("and", "or"):
        return {"op": op, "args": [json.loads(x) for x in sorted({dump(normal_form(a)) for a in node["args"]})]}
    if op == "not":
        return {"op": op, "arg": normal_form(node["arg"])}
    out = {**node, "field": node["field"].lower()}
    if op == "in":
        out["values"] = [json.loads(x) for x in sorted({dump(v) for v in node["values"]})]
    return out


def compile_filter(node: dict) -> Column:
    """The predicate of a valid tree, from built-in operators only, so it is
    pushed down to the scan."""
    if wrong := problems(node):
        raise ValueError("; ".join(wrong))
    op = node["op"]
    if op == "and":
        return reduce(lambda a, b: a & b, map(compile_filter, node["args"]))
    if op == "or":
        return reduce(lambda a, b: a | b, map(compile_filter, node["args"]))
    if op == "not":
        return ~compile_filter(node["arg"])
    field = F.col(node["field"])
    if op == "in":
        return field.isin(*node["values"])
    return field == F.lit(node["value"]) if op == "eq" else field != F.lit(node["value"])
