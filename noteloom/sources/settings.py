"""Settings from TOML: every field is checked by itself and falls back to its default."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Semantic:
    enabled: bool = False
    min_score: float = 0.5


@dataclass
class Chat:
    provider: str = "ollama"
    model: str = ""
    base_url: str = ""


@dataclass
class Telemetry:
    enabled: bool = False


@dataclass
class Settings:
    theme: str = "system"
    semantic: Semantic = field(default_factory=Semantic)
    chat: Chat = field(default_factory=Chat)
    telemetry: Telemetry = field(default_factory=Telemetry)


ALLOWED = {"theme": ("system", "light", "dark"), "provider": ("anthropic", "openai", "ollama")}


def _filled(target, values: dict):
    for f in fields(target):
        now, new = getattr(target, f.name), values.get(f.name)
        if is_dataclass(now):
            _filled(now, new if isinstance(new, dict) else {})
        elif isinstance(now, bool) or isinstance(new, bool):
            if isinstance(now, bool) and isinstance(new, bool):
                setattr(target, f.name, new)
        elif isinstance(now, float):
            if isinstance(new, int | float) and 0 <= new <= 1:
                setattr(target, f.name, float(new))
        elif isinstance(new, str) and new in ALLOWED.get(f.name, (new,)):
            setattr(target, f.name, new)
    return target


def parse(text: str) -> Settings:
    try:
        values = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        values = {}
    return _filled(Settings(), values)


def _open_after(line: str, state: tuple[int, str]) -> tuple[int, str]:
    """What is open behind a line of TOML, given what was before it: how many brackets of a value, and which string."""
    depth, quote = state
    at = 0
    if not quote and not depth:
        if line.lstrip().startswith("[") or "=" not in line:
            return state  # a table's head, or nothing
        at = line.index("=") + 1
    while at < len(line):
        if quote:
            if line.startswith(quote, at):
                at, quote = at + len(quote), ""
                continue
            at += 2 if line[at] == "\\" and quote[0] == '"' else 1
            continue
        if line[at] == "#":
            break
        if line[at] in "\"'":
            quote = line[at] * 3 if line.startswith(line[at] * 3, at) else line[at]
            at += len(quote)
            continue
        depth += (line[at] in "[{") - (line[at] in "]}")
        at += 1
    return max(0, depth), quote if len(quote) == 3 else ""  # other strings end with their line


def edited(text: str, key: str, value: str | float | bool) -> str:
    """TOML text with one key (dotted: table.key) set in place; all other lines, comments too, stay as they are.

    A value that goes over several lines, an array or a string, is one value: its lines are neither heads nor keys.
    """
    table, _, name = key.rpartition(".")
    shown = json.dumps(value) if isinstance(value, str | bool) else repr(value)
    lines, here, last = text.split("\n"), "", -1 if not table else None
    state, mine = (0, ""), None
    for i, line in enumerate(lines):
        bare, inside = line.strip(), state != (0, "")
        state = _open_after(line, state)
        if not inside and bare.startswith("["):
            here = bare.partition("]")[0].lstrip("[").strip()
            last = i if here == table else last
        elif not inside and here == table and "=" in bare and not bare.startswith("#"):
            if bare.partition("=")[0].strip().strip("\"'") == name:
                mine = i
            last = i
        elif inside and here == table:
            last = i
        if mine is not None and state == (0, ""):
            return "\n".join([*lines[:mine], f"{name} = {shown}", *lines[i + 1 :]])
    if last is None:  # no such table yet
        return text.rstrip("\n") + ("\n\n" if text.strip() else "") + f"[{table}]\n{name} = {shown}\n"
    lines.insert(last + 1, f"{name} = {shown}")
    return "\n".join(lines)


def recents(text: str, exists: Callable[[str], bool] = lambda path: True, cap: int = 10) -> list[str]:
    """The paths of a JSON list, without those that are gone; none if it can't be read."""
    try:
        values = json.loads(text)
    except ValueError:
        return []
    return [v for v in values if isinstance(v, str) and exists(v)][:cap] if isinstance(values, list) else []
