"""Settings and factor weights from YAML or JSON files, with the defaults of the published contract."""

from __future__ import annotations

import json
import os

from .operators.scoring import ScoringConfig


def parse(text: str) -> dict:
    """A JSON object, or the plain subset of YAML that configuration files use: nested mappings of scalars by indentation, with comments."""
    text = text.strip("﻿")
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    for n, raw in enumerate(text.splitlines(), 1):
        line = _without_comment(raw)
        if not line.strip() or line.strip() == "---":
            continue
        indent = len(line) - len(line.lstrip(" "))
        name, colon, value = line.strip().partition(":")
        if not colon or "\t" in line[:indent] or name.startswith("- "):
            raise ValueError(f"line {n}: only nested mappings are read")
        while levels[-1][0] >= indent:
            levels.pop()
        holder = levels[-1][1]
        if value.strip():
            holder[name.strip()] = _scalar(value.strip())
        else:
            holder[name.strip()] = {}
            levels.append((indent, holder[name.strip()]))
    return root


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~", "none"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def load(path: str) -> dict:
    """A file's settings; an absent file is an error."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def scoring_config(settings: dict) -> ScoringConfig:
    """Weights and sizes from settings; what is not named keeps its default, and the weights are checked."""
    default = ScoringConfig()
    weights = {f"{k.removesuffix('_score')}_score": float(v) for k, v in (settings.get("weights") or {}).items()}
    unknown = set(weights) - set(default.weights)
    if unknown:
        raise ValueError(f"unknown weights: {', '.join(sorted(unknown))}")
    return ScoringConfig(weights or default.weights, float(settings.get("neutral", default.neutral)), settings.get("top_n", default.top_n))
