"""Recipes: named lists of steps that fold into one lazy plan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.commands import REGISTRY, CommandError, apply

#: Parameters that name columns: single ones, and lists.
SINGLE = ("column", "target_column")
LISTS = ("columns",)
NEEDS_SECRET = ("hash",)


@dataclass
class Step:
    command: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    label: str = ""


@dataclass
class Recipe:
    name: str
    steps: list[Step]
    description: str = ""
    version: str = "1.0"

    def required_columns(self) -> list[str]:
        made: set[str] = set()
        out: list[str] = []
        for s in self.steps:
            names = [s.params[k] for k in SINGLE if isinstance(s.params.get(k), str)]
            for k in LISTS:
                v = s.params.get(k, [])
                names += [x.strip() for x in v.split(",")] if isinstance(v, str) else list(v)
            names += [r["column"] for r in s.params.get("rules", [])]
            names += re.findall(r"@\[?([^\]\s()+*/,&=<>-]+)\]?", s.params.get("formula", ""))
            out += [n for n in names if n not in made and n not in out]
            made |= {s.params[k] for k in ("new_name", "output_column") if k in s.params}
        return out

    def to_json(self) -> str:
        steps = [{"id": str(i), "type": s.command, "label": s.label or s.command, "params": s.params, "enabled": s.enabled} for i, s in enumerate(self.steps)]
        return json.dumps({"name": self.name, "description": self.description, "version": self.version, "requiredColumns": self.required_columns(), "steps": steps}, indent=1)


def from_json(source: str) -> Recipe:
    """A recipe out of JSON; step types may carry a ``group:`` prefix, and a step's column may stand beside its parameters."""
    raw = json.loads(source)
    if problems := check(raw):
        raise CommandError("INVALID_RECIPE", "; ".join(problems))
    steps = []
    for s in raw["steps"]:
        params = dict(s.get("params") or {})
        if s.get("column"):
            params.setdefault("column", s["column"])
        steps.append(Step(s["type"].rpartition(":")[2], params, s.get("enabled", True), s.get("label", "")))
    return Recipe(raw["name"], steps, raw.get("description", ""), raw.get("version", "1.0"))


def check(raw: dict) -> list[str]:
    problems = [] if raw.get("name") else ["no name"]
    if not isinstance(raw.get("steps"), list) or not raw["steps"]:
        return [*problems, "no steps"]
    return problems + [f"step {i}: unknown type {s.get('type')}" for i, s in enumerate(raw["steps"]) if str(s.get("type", "")).rpartition(":")[2] not in REGISTRY]


def match_columns(wanted: list[str], available: list[str]) -> dict[str, str | None]:
    """Columns of a table for a recipe's: exact, then without case, then with blanks and dashes alike; each once."""

    def plain(x: str) -> str:
        return re.sub(r"[\s\-_]+", "_", x.lower())

    found: dict[str, str | None] = dict.fromkeys(wanted)
    free = list(available)
    for same in (lambda a, b: a == b, lambda a, b: a.lower() == b.lower(), lambda a, b: plain(a) == plain(b)):
        for w in wanted:
            if found[w] is None and (hit := next((c for c in free if same(w, c)), None)):
                found[w] = hit
                free.remove(hit)
    return found


def renamed(params: dict, names: dict[str, str | None]) -> dict:
    """Parameters with a table's own column names."""
    to = lambda c: names.get(c) or c
    out = dict(params)
    for k in SINGLE:
        if isinstance(out.get(k), str):
            out[k] = to(out[k])
    for k in LISTS:
        if k in out:
            out[k] = [to(c.strip()) for c in (out[k].split(",") if isinstance(out[k], str) else out[k])]
    if "rules" in out:
        out["rules"] = [{**r, "column": to(r["column"])} for r in out["rules"]]
    if "formula" in out:
        for a, b in names.items():
            if b and a != b:
                out["formula"] = re.sub(rf"@\[{re.escape(a)}\]|@{re.escape(a)}\b", lambda _, b=b: f"@[{b}]", out["formula"])
    return out


def requires_secret(recipe: Recipe) -> bool:
    return any(s.enabled and (s.command in NEEDS_SECRET or any(r["method"] == "hash" for r in s.params.get("rules", []))) for s in recipe.steps)


def run(df: DataFrame, recipe: Recipe, secret: str | None = None, columns: dict[str, str | None] | None = None) -> DataFrame:
    """All enabled steps in order, as one plan."""
    names = columns if columns is not None else match_columns(recipe.required_columns(), df.columns)
    for s in recipe.steps:
        if not s.enabled:
            continue
        params = renamed(s.params, names)
        if s.command == "hash" or s.command == "scrub_batch":
            params = {"secret": secret, **params} if secret else params
        df = apply(df, s.command, **params)
    return df


def preview(df: DataFrame, recipe: Recipe, sample: int = 10, **options) -> dict:
    """Columns before and after a recipe, which of them are new or gone, and its first rows."""
    after = run(df, recipe, **options)
    return {"columns": after.columns, "new": [c for c in after.columns if c not in df.columns], "gone": [c for c in df.columns if c not in after.columns], "rows": after.limit(sample).collect()}


def extract(history: list[Step], name: str) -> Recipe:
    return Recipe(name, [s for s in history if REGISTRY[s.command].in_recipes])


def is_streamable(recipe: Recipe) -> bool:
    return all(REGISTRY[s.command].stateless for s in recipe.steps if s.enabled)
