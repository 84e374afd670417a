"""Validation of policy files: what is wrong and where."""

from __future__ import annotations

import re
from typing import Any

from . import filters

MAX_PROBLEMS = 200
MAX_REASON = 500
ACTIONS = ("keep", "mask", "secret")
SELECTORS = ("source_path", "name", "type", "dictionary", "regex")
MODES = ("data-mask", "no-mask", "deny-pending-review")
_PATTERN = re.compile(r"\*|\*[^*]+\*|[^*]+", re.S)
_CATEGORY = re.compile(r"[A-Za-z0-9_]{1,32}")
_TOOL = re.compile(r"[A-Za-z0-9_.:-]{1,128}")
#: Java and RE2 differ on these; a portable rule does without them.
_UNPORTABLE = re.compile(r"\(\?[=!<]|\\[1-9]")


def _reason(x: Any) -> bool:
    return isinstance(x, str) and 0 < len(x) <= MAX_REASON and not any(ord(c) < 32 or ord(c) == 127 for c in x)


def _rule(rule: dict, path: str) -> list[tuple[str, str]]:
    out = []
    selector, value, action = rule.get("selector"), rule.get("value"), rule.get("action")
    if selector not in SELECTORS:
        out.append((f"{path}.selector", "unknown selector"))
    if action not in ACTIONS:
        out.append((f"{path}.action", "unknown action"))
    if not isinstance(rule.get("category"), str) or not _CATEGORY.fullmatch(rule["category"]):
        out.append((f"{path}.category", "bad category"))
    if not _reason(rule.get("reason")):
        out.append((f"{path}.reason", "reason missing or too long"))
    if not isinstance(value, str) or not value:
        return [*out, (f"{path}.value", "value missing")]
    if selector != "regex":
        if not _PATTERN.fullmatch(value):
            out.append((f"{path}.value", "bad pattern"))
        return out
    if _UNPORTABLE.search(value):
        return [*out, (f"{path}.value", "look-around and back-references aren't allowed")]
    try:
        compiled = re.compile(value)
    except re.error:
        return [*out, (f"{path}.value", "bad regular expression")]
    tests = rule.get("tests") or {}
    if action in ("mask", "secret") and not tests.get("match"):
        out.append((f"{path}.tests", "a positive test is needed"))
    out += [(f"{path}.tests.match[{k}]", "doesn't match") for k, t in enumerate(tests.get("match") or []) if not compiled.search(t)]
    out += [(f"{path}.tests.no_match[{k}]", "matches") for k, t in enumerate(tests.get("no_match") or []) if compiled.search(t)]
    return out


def problems(setup: dict, most: int = MAX_PROBLEMS) -> list[tuple[str, str]]:
    """(path, problem) of a policy file, ``most`` at most."""
    out: list[tuple[str, str]] = []
    seen = set()
    for k, rule in enumerate(setup.get("rules") or []):
        out += _rule(rule, f"rules[{k}]")
        key = (rule.get("selector"), rule.get("value"))
        if key in seen:
            out.append((f"rules[{k}]", "rule given twice"))
        seen.add(key)
    paths = set()
    for k, source in enumerate((setup.get("dictionary") or {}).get("sources") or []):
        at = f"dictionary.sources[{k}]"
        if not source.get("source_path"):
            out.append((f"{at}.source_path", "path missing"))
        if source.get("source_path") in paths:
            out.append((at, "source given twice"))
        paths.add(source.get("source_path"))
        if source.get("filter") is not None:
            out += [(f"{at}.filter", p) for p in filters.problems(source["filter"])]
        if not _reason(source.get("reason")):
            out.append((f"{at}.reason", "reason missing or too long"))
    for k, tool in enumerate(setup.get("tools") or []):
        if not isinstance(tool.get("tool"), str) or not _TOOL.fullmatch(tool["tool"]):
            out.append((f"tools[{k}].tool", "bad name"))
        if tool.get("mode") not in MODES:
            out.append((f"tools[{k}].mode", "unknown mode"))
    return out[:most]


#: The file's format, its keys by level, and its bounds.
SCHEMA = "masking-setup/v1"
KEYS = {
    "": ("schema", "generated_at", "generated_by", "database_hint", "dictionary", "rules", "tools"),
    "dictionary": ("mode", "sources"),
    "dictionary.sources": ("source_path", "category", "filter", "reason", "estimated_values"),
    "rules": ("selector", "value", "action", "category", "priority", "enabled", "reason", "tests"),
    "tools": ("tool", "mode", "reason"),
}
MAX_FILE, MAX_SOURCES, MAX_RULES, MAX_TOOLS = 1 << 20, 100, 1000, 500
#: Parts of problems() by the code that a file's author gets for them.
_CODES = (
    ("reason", "SETUP_REASON_MISSING"), ("rule given twice", "SETUP_DUPLICATE_RULE"), ("source given twice", "SETUP_DUPLICATE_SOURCE"), ("bad pattern", "SETUP_PATTERN_UNSUPPORTED"), ("look-around", "SETUP_REGEX_INVALID"),
    ("bad regular expression", "SETUP_REGEX_INVALID"), ("a positive test", "SETUP_REGEX_TESTS_MISSING"), ("doesn't match", "SETUP_REGEX_TEST_FAILED"), ("matches", "SETUP_REGEX_TEST_FAILED"),
)


def _unknown(x: Any, level: str, at: str) -> list[tuple[str, str]]:
    return [("SETUP_UNKNOWN_FIELD", f"{at}.{k}") for k in x if k not in KEYS[level]] if isinstance(x, dict) else [("SETUP_FIELD_INVALID", at)]


def review(body: str, most: int = MAX_PROBLEMS) -> dict[str, Any]:
    """{"issues": [(code, path)], "truncated"} of a setup file's text.

    Format, size and unknown keys of the top level come first and alone; then
    the dictionary's mode (``all`` has the one source ``*``, ``part`` none
    such), bounds of the lists, tests of rules that aren't regular
    expressions, tools given twice and all that problems() finds.
    """
    import json

    if len(body.encode()) > MAX_FILE:
        return {"issues": [("SETUP_TOO_LARGE", "$")], "truncated": False}
    try:
        file = json.loads(body)
    except ValueError:
        file = None
    if not isinstance(file, dict):
        return {"issues": [("SETUP_NOT_JSON", "$")], "truncated": False}
    if file.get("schema") != SCHEMA:
        return {"issues": [("SETUP_SCHEMA_MISSING" if not isinstance(file.get("schema"), str) else "SETUP_SCHEMA_UNSUPPORTED", "$.schema")], "truncated": False}
    issues = _unknown(file, "", "$")
    if issues:
        return {"issues": issues[:most], "truncated": len(issues) > most}
    dictionary = file.get("dictionary") or {}
    lists = {"dictionary.sources": dictionary.get("sources") if isinstance(dictionary, dict) else None, "rules": file.get("rules"), "tools": file.get("tools")}
    issues += _unknown(dictionary, "dictionary", "$.dictionary")
    for level, items in lists.items():
        bound = {"dictionary.sources": MAX_SOURCES, "rules": MAX_RULES, "tools": MAX_TOOLS}[level]
        if items is not None and (not isinstance(items, list) or len(items) > bound):
            issues.append(("SETUP_FIELD_INVALID", f"$.{level}"))
            lists[level] = items = []
        for k, item in enumerate(items or []):
            issues += _unknown(item, level, f"$.{level}[{k}]")
    clean = {k: [x for x in v or [] if isinstance(x, dict)] for k, v in lists.items()}
    stars = sum(s.get("source_path") == "*" for s in clean["dictionary.sources"])
    mode = dictionary.get("mode") if isinstance(dictionary, dict) else None
    if mode not in (None, "all", "part"):
        issues.append(("SETUP_FIELD_INVALID", "$.dictionary.mode"))
    if mode == "all" and (stars, len(clean["dictionary.sources"])) != (1, 1) or mode == "part" and stars:
        issues.append(("SETUP_DICTIONARY_MODE", "$.dictionary"))
    issues += [("SETUP_TESTS_NOT_REGEX", f"$.rules[{k}].tests") for k, r in enumerate(clean["rules"]) if r.get("tests") is not None and r.get("selector") != "regex"]
    seen: set[Any] = set()
    for k, tool in enumerate(clean["tools"]):
        if tool.get("tool") in seen:
            issues.append(("SETUP_DUPLICATE_TOOL", f"$.tools[{k}]"))
        seen.add(str(tool.get("tool")))
    found = problems({"rules": clean["rules"], "dictionary": {"sources": clean["dictionary.sources"]}, "tools": clean["tools"]}, most + 1)
    for path, what in found:
        code = "SETUP_FILTER_INVALID" if path.endswith(".filter") else next((c for part, c in _CODES if what.startswith(part)), "SETUP_FIELD_INVALID")
        issues.append((code, f"$.{path}"))
    return {"issues": issues[:most], "truncated": len(issues) > most}
