"""Project settings: a TOML file per folder, a JSON registry of projects."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from spindrift.functions.ids import database_key
from spindrift.functions.text import unique_label

FILE = ".spindrift.toml"


@dataclass
class Project:
    """Settings of the root folder and the narrowing ones below it, outermost first."""

    root: Path
    settings: dict
    overrides: list[tuple[str, dict]] = field(default_factory=list)

    def excludes(self) -> list[str]:
        """The root's globs, and those of the folders below with their prefix; a switched-off folder goes as a whole."""
        out = list(self.settings.get("index", {}).get("exclude", []))
        for folder, settings in self.overrides:
            index = settings.get("index")
            if index is False:
                out.append(f"{folder}/**" if folder else "**")
            elif isinstance(index, dict):
                out += [f"{folder}/{g}" if folder else g for g in index.get("exclude", [])]
        return out

    def tests_policy(self, path: str) -> str | None:
        """The nearest folder's policy for a path, else the root's."""
        policy = self.settings.get("search", {}).get("tests")
        for folder, settings in self.overrides:
            if path == folder or path.startswith(f"{folder}/"):
                policy = settings.get("search", {}).get("tests", policy)
        return policy

    def space(self, asked: str | None, stored: list[str]) -> str | None:
        """The space asked for, the default one, the only stored one, or none: lexical search alone."""
        return asked or self.settings.get("default_space") or (stored[0] if len(stored) == 1 else None)


def discover(start: str) -> Project | None:
    """Walk up: the topmost file is the root, unless one below says ``root = true``."""
    at = Path(start).absolute()
    found: list[tuple[Path, dict]] = []
    for folder in (at, *at.parents):
        if (f := folder / FILE).is_file():
            settings = tomllib.loads(f.read_text())
            found.append((folder, settings))
            if settings.get("root") is True:
                break
    if not found:
        return None
    root, settings = found.pop()
    validate(settings)
    for folder, s in found:
        if extra := set(s) - {"index", "search"}:
            raise ValueError(f"{folder / FILE} may only narrow index and search, not {', '.join(sorted(extra))}")
    return Project(root, settings, [(f.relative_to(root).as_posix(), s) for f, s in reversed(found)])


def validate(settings: dict) -> None:
    spaces = settings.get("spaces", {})
    for name, s in spaces.items():
        if not s.get("channel") or not s.get("model"):
            raise ValueError(f"the space {name} needs a channel and a model")
    if (d := settings.get("default_space")) and d not in spaces:
        raise ValueError(f"the default space {d} isn't defined")


def starter(label: str) -> str:
    return f"root = true\nlabel = {json.dumps(label)}\n\n[index]\nexclude = []\n"


class Registry:
    """Registered project roots in one JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.projects: list[dict] = json.loads(self.path.read_text()) if self.path.exists() else []

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(self.projects, indent=1))
        os.replace(part, self.path)

    def register(self, root: str, hint: str, data: str) -> dict:
        """The project of that root; a label that is taken gets a number."""
        root = str(Path(root).absolute())
        for p in self.projects:
            if p["root"] == root:
                return p
        p = {"label": unique_label(hint, {q["label"] for q in self.projects}), "root": root, "store": f"{data}/{database_key(root)}"}
        self.projects.append(p)
        return p

    def find(self, needle: str) -> dict | None:
        """By label, else the deepest root that contains the path."""
        for p in self.projects:
            if p["label"] == needle:
                return p
        path = Path(needle)
        inside = [p for p in self.projects if path.is_relative_to(p["root"])]
        return max(inside, key=lambda p: len(Path(p["root"]).parts), default=None)

    def remove(self, needle: str) -> dict:
        for p in self.projects:
            if needle in (p["label"], p["root"]):
                self.projects.remove(p)
                return p
        raise KeyError(needle)
