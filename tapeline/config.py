"""Settings files: a small subset of YAML, and the checks a run must pass."""

from __future__ import annotations

import re
from typing import Any

# Blocks a configuration must have and settings that must hold.
REQUIRED = ("project", "config_version", "mode", "enabled", "isolation", "storage", "run", "research", "selection", "execution", "runtime_budget")
MUST_BE_FALSE = ("direct_production_read", "production_write", "network_egress", "external_notifications", "order_execution", "auto_promotion")
MUST_BE_NULL = ("policy_version", "p_min", "expected_net_min", "total_risk_budget", "max_open_positions", "max_sector_exposure")
CAPS = {"baseline_cap_on": 2, "baseline_cap_off": 1}
BUDGETS = ("cpu_limit", "memory_limit_bytes", "max_run_seconds")
MUST_BE_TRUE = (("isolation", "dedicated_worker_required"), ("storage", "input_mount_readonly"), ("run", "single_writer"), ("run", "publish_complete_only"))
PLACES = ("input_root", "output_root", "ledger")
MODES = ("REPLAY", "SHADOW")
VERSION = 1


class ConfigError(ValueError):
    pass


#: Words that are no strings.
WORDS = {"": None, "~": None, "null": None, "true": True, "yes": True, "false": False, "no": False}

#: A scalar is of the first kind that takes all of it.
_SCALAR = re.compile(r"""(?P<quoted>(["']).*\2)|(?P<listed>\[.*\])|(?P<whole>-?\d+)|(?P<decimal>-?\d+\.\d+(?:[eE][+-]?\d+)?)|(?P<word>.*)""", re.S)
_LINE = re.compile(r"^(?P<indent> *)(?P<body>[^ \n#][^\n#]*)", re.M)
_KEY = re.compile(r"(?P<key>[\w.-]+) *:(?: +(?P<rest>.*))?", re.A)


def _listed(text: str) -> list:
    inner = text[1:-1]
    return [scalar(x) for x in inner.split(",")] if inner.strip() else []


_MAKE = {"quoted": lambda text: text[1:-1], "listed": _listed, "whole": int, "decimal": float, "word": lambda text: WORDS.get(text.lower(), text)}


def scalar(token: str) -> Any:
    """null, booleans, integers, decimals, flat lists and strings; a date stays a string."""
    found = _SCALAR.fullmatch(token.strip())
    return _MAKE[found.lastgroup](found[0])


def parse(text: str) -> Any:
    """Nested mappings and lists by indentation with spaces; # begins a comment."""
    lines = [(len(m["indent"]), m["body"].rstrip()) for m in _LINE.finditer(text) if m["body"].strip()]
    if any(body[0] == "\t" for _, body in lines):
        raise ConfigError("indent with spaces")
    value, rest = _block(lines, 0) if lines else ({}, [])
    if rest:
        raise ConfigError(f"stray line: {rest[0][1]}")
    return value


def _block(lines: list[tuple[int, str]], depth: int) -> tuple[Any, list[tuple[int, str]]]:
    """The value of the lines at this depth, and the lines that follow it."""
    if lines[0][1] == "-" or lines[0][1].startswith("- "):
        items = []
        while lines and lines[0][0] == depth and (lines[0][1] == "-" or lines[0][1].startswith("- ")):
            body = lines[0][1][1:].strip()
            if _KEY.fullmatch(body):  # a mapping whose first key shares the dash's line
                inner = depth + len(lines[0][1]) - len(body)
                value, lines = _block([(inner, body), *lines[1:]], inner)
            else:
                value, lines = scalar(body), lines[1:]
            items.append(value)
        return items, lines
    out: dict[str, Any] = {}
    while lines and lines[0][0] == depth:
        found = _KEY.fullmatch(lines[0][1])
        if not found:
            raise ConfigError(f"no key: {lines[0][1]}")
        key, rest = found["key"], found["rest"]
        if key in out:
            raise ConfigError(f"repeated key {key}")
        lines = lines[1:]
        if not rest and lines and lines[0][0] > depth:
            out[key], lines = _block(lines, lines[0][0])
        else:
            out[key] = scalar(rest or "")
    if lines and lines[0][0] > depth:
        raise ConfigError(f"indented too far: {lines[0][1]}")
    return out, lines


def problems(config: dict) -> list[str]:
    """All rules that a configuration breaks."""
    part = lambda block: config.get(block) or {}
    out = [f"{k} is missing" for k in REQUIRED if k not in config]
    if not isinstance(config.get("project"), str) or not config["project"]:
        out.append("project must have a name")
    if config.get("config_version") != VERSION:
        out.append(f"config_version must be {VERSION}")
    if config.get("mode") not in MODES:
        out.append(f"mode must be {' or '.join(MODES)}")
    out += [f"isolation.{k} must be false" for k in MUST_BE_FALSE if part("isolation").get(k) is not False]
    out += [f"{block}.{k} must be true" for block, k in MUST_BE_TRUE if part(block).get(k) is not True]
    out += [f"storage.{k} must be set" for k in PLACES if not part("storage").get(k)]
    out += [f"selection.{k} must be null" for k in MUST_BE_NULL if part("selection").get(k) is not None]
    out += [f"selection.{k} must be {v}" for k, v in CAPS.items() if part("selection").get(k, v) != v]
    return out


def schedule_problems(config: dict) -> list[str]:
    """Why a configuration may not run unattended."""
    out = [] if config.get("enabled") is True else ["enabled must be true"]
    return out + [f"runtime_budget.{k} must be set" for k in BUDGETS if (config.get("runtime_budget") or {}).get(k) is None]


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        config = parse(f.read())
    if found := problems(config):
        raise ConfigError("; ".join(found))
    return config
