"""Datasets, models and paths of runs: registries on the driver, configuration files with environment variables."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Dataset:
    """What a run needs to know of a dataset: where it lies, its columns, and which papers belong to it."""

    name: str
    directory: str
    entity_fields: tuple[str, ...] = ("name", "identifiers", "location", "ecosystem")
    event_fields: tuple[str, ...] = ("date", "additional_details")
    keep: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    prompts: Mapping[str, str] = field(default_factory=dict)


class Registry[T]:
    """Entries by name; an unknown name is an error that lists the known ones."""

    def __init__(self, what: str, entries: Mapping[str, T] | None = None):
        self.what, self.entries = what, dict(entries or {})

    def add(self, name: str, entry: T) -> T:
        self.entries[name] = entry
        return entry

    def get(self, name: str) -> T:
        if name not in self.entries:
            raise KeyError(f"no {self.what} {name!r}; there are {', '.join(sorted(self.entries)) or 'none'}")
        return self.entries[name]


_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expanded(text: str, environment: Mapping[str, str] | None = None) -> str:
    """text with ${NAME} and ${NAME:-default} replaced; a variable that isn't set and has no default becomes empty."""
    env = os.environ if environment is None else environment
    return _VARIABLE.sub(lambda m: env.get(m.group(1)) or (m.group(2) or ""), text)


def load_config(path: str, environment: Mapping[str, str] | None = None) -> dict:
    """A configuration file of nested mappings, lists and scalars as YAML writes them, variables expanded first."""
    with open(path, encoding="utf-8") as f:
        text = expanded(f.read(), environment)
    try:
        import yaml
    except ImportError:
        return _parsed([(len(line) - len(line.lstrip()), line.strip()) for raw in text.split("\n") if (line := re.sub(r"(^|\s)#.*$", "", raw).rstrip()).strip()])
    return yaml.safe_load(text) or {}


def _scalar(text: str):
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    known = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in known:
        return known[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _parsed(lines: list[tuple[int, str]]):
    """The part of YAML that configuration files use, where no YAML library is installed."""
    if not lines:
        return {}
    indent = lines[0][0]
    heads = [i for i, (d, _) in enumerate(lines) if d == indent] + [len(lines)]
    blocks = [(lines[a][1], lines[a + 1 : b]) for a, b in zip(heads, heads[1:])]
    if blocks[0][0].startswith("- "):
        return [_parsed([(indent + 2, head[2:].strip()), *rest]) if re.match(r"- [\w.-]+:(\s|$)", head) else _scalar(head[2:].strip()) for head, rest in blocks]
    out = {}
    for head, rest in blocks:
        name, _, value = head.partition(":")
        out[_scalar(name.strip())] = _parsed(rest) if rest and not value.strip() else _scalar(value.strip())
    return out


@dataclass(frozen=True)
class Paths:
    """Folders of runs below root: dataset, stage, model and date; an ablation is a stage of its own."""

    root: str
    dataset: str

    def run(self, stage: str, model: str, date: str, ablation: str | None = None) -> str:
        return "/".join([self.root, self.dataset, f"ablation_{ablation}" if ablation else stage, model, date])

    def file(self, stage: str, model: str, date: str, name: str, ablation: str | None = None) -> str:
        return f"{self.run(stage, model, date, ablation)}/{name}"
