"""The configuration file: thresholds, additions to the classification, modules and rules between them.

Read on the driver by a parser of the YAML that such files use (block maps and lists, flow lists, quoted scalars,
comments); every error names file, line and column.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

from codestrata.options import Extras, Options, Thresholds

NAME = ".codestrata.yml"


class ConfigError(ValueError):
    def __init__(self, file: str, line: int, column: int, message: str):
        super().__init__(f"{file}:{line}:{column}: {message}")


@dataclass
class Node:
    """A scalar (str), a list of nodes or a list of (key node, node), and where it stands."""

    value: object
    line: int
    column: int

    @property
    def is_map(self) -> bool:
        return isinstance(self.value, dict)

    @property
    def is_list(self) -> bool:
        return isinstance(self.value, list)

    def get(self, key: str) -> Node | None:
        return self.value[key][1] if self.is_map and key in self.value else None


_SCALAR = r"\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^\s#][^#]*?"
_KEY = re.compile(r"(\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^\s\"'#\[\]{},][^#:]*?)\s*:(?=\s|$)\s*")


def _plain(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return text


def _uncommented(line: str) -> str:
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote and (quote == "'" or line[i - 1] != "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [,:-{"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


class _Parser:
    def __init__(self, text: str, file: str):
        self.file, self.at = file, 0
        self.lines = []
        for n, raw in enumerate(text.split("\n"), 1):
            line = _uncommented(raw.rstrip("\r")).rstrip()
            if "\t" in line[: len(line) - len(line.lstrip())]:
                self.fail(n, 1, "a tab cannot indent")
            if line.strip() and line.strip() != "---":
                self.lines.append((n, len(line) - len(line.lstrip()), line.strip()))

    def fail(self, line: int, column: int, message: str):
        raise ConfigError(self.file, line, column, f"YAML error: {message}")

    def flow(self, text: str, line: int, column: int) -> Node:
        if not text.startswith("["):
            if text[:1] in "{&*!|>" and text[:1]:
                self.fail(line, column, f"not supported: {text[:1]}")
            if text[:1] in "\"'" and (len(text) < 2 or text[-1] != text[0]):
                self.fail(line, column, "unclosed quote")
            return Node(_plain(text), line, column)
        if not text.endswith("]"):
            self.fail(line, column, "unclosed list")
        parts = re.findall(r"\s*(\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^,\"'\[\]]+)\s*(?:,|$)", text[1:-1])
        if re.sub(r"\s*(\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^,\"'\[\]]+)\s*(?:,|$)", "", text[1:-1]).strip():
            self.fail(line, column, "malformed list")
        return Node([Node(_plain(x), line, column) for x in parts], line, column)

    def block(self, indent: int) -> Node:
        n, own, text = self.lines[self.at]
        out = Node([] if re.match(r"-(\s|$)", text) else {}, n, own + 1)
        while self.at < len(self.lines):
            n, at, text = self.lines[self.at]
            if at < own:
                break
            if at > own:
                self.fail(n, at + 1, "unexpected indentation")
            if out.is_list:
                if not re.match(r"-(\s|$)", text):
                    break
                inner = text[1:].lstrip()
                out.value.append(self.entry(inner, n, at + len(text) - len(inner), at))
            else:
                m = _KEY.match(text)
                if not m:
                    self.fail(n, at + 1, f"expected 'key: value', got '{text}'")
                key = _plain(m[1])
                if key in out.value:
                    self.fail(n, at + 1, f"duplicate key '{key}'")
                out.value[key] = (Node(key, n, at + 1), self.entry(text[m.end() :], n, at + m.end(), at, False))
        return out

    def entry(self, text: str, n: int, column: int, indent: int, in_list: bool = True) -> Node:
        if text and in_list and (_KEY.match(text) or re.match(r"-(\s|$)", text)):
            self.lines[self.at] = (n, column, text)  # a map or list that begins behind the dash
            return self.block(column)
        self.at += 1
        if text:
            return self.flow(text, n, column + 1)
        if self.at < len(self.lines):
            _, following, first = self.lines[self.at]
            if following > indent or (following == indent and not in_list and re.match(r"-(\s|$)", first)):
                return self.block(following)
        return Node("", n, column + 1)


def parse(text: str, file: str = "<text>") -> Node:
    p = _Parser(text, file)
    if not p.lines:
        return Node("", 1, 1)
    node = p.block(0)
    if p.at < len(p.lines):
        n, at, text = p.lines[p.at]
        p.fail(n, at + 1, f"unexpected '{text}'")
    return node


@dataclass(frozen=True)
class Rule:
    """``layers`` (members in order), ``independence`` (members) or ``forbidden`` (members to targets)."""

    type: str
    name: str
    members: tuple[str, ...]
    targets: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    modules: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    options: Options = Options()


_LISTS = {"layers": ("layers",), "independence": ("modules",), "forbidden": ("from", "to")}
_LIMITS = {"chain_length": "chain_length", "god_header_fan_in": "god_header_fan_in", "diff_max_added_lines": "mass_added_lines", "diff_max_clone_scan_bytes": "duplication_max_bytes"}
_TOKENS = {"extra_vendored_dirs": "vendored_dirs", "extra_test_dirs": "test_dirs", "extra_generated_markers": "generated_markers"}


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        raise ConfigError(path, 0, 0, "cannot open config file") from None
    return read(text, path)


def read(text: str, file: str = "<text>") -> Config:
    def fail(node: Node | None, message: str):
        raise ConfigError(file, node.line if node else 1, node.column if node else 1, message)

    def names(node: Node, message: str) -> tuple[str, ...]:
        if not node.is_list or not node.value:
            fail(node, message)
        return tuple(x.value if isinstance(x.value, str) else fail(x, message) for x in node.value)

    root = parse(text, file)
    if root.get("version") is None:
        fail(None, "the top level must be a map with a 'version'")
    if root.get("version").value != "1":
        fail(root.get("version"), f"version {root.get('version').value} is not supported, only 1 is")
    known = ("version", "modules", "rules", "thresholds", "classification")
    for key, _ in root.value.values():
        if key.value not in known:
            fail(key, f"unknown key '{key.value}', expected one of {', '.join(known)}")
    for key in ("modules", "rules"):
        if root.get(key) is None:
            fail(None, f"the key '{key}' is required")

    modules: dict[str, tuple[str, ...]] = {}
    if not root.get("modules").is_map or not root.get("modules").value:
        fail(root.get("modules"), "'modules' must be a map that is not empty")
    for key, node in root.get("modules").value.values():
        if not re.fullmatch(r"[a-z0-9_-]+", key.value):
            fail(key, f"bad module name '{key.value}', expected [a-z0-9_-]+")
        if node.get("paths") is None:
            fail(node, f"module '{key.value}' needs a list 'paths'")
        modules[key.value] = names(node.get("paths"), f"'paths' of module '{key.value}' must be a list that is not empty")
        if "" in modules[key.value]:
            fail(node, f"module '{key.value}' has an empty path")

    rules: list[Rule] = []
    if not root.get("rules").is_list and root.get("rules").value:
        fail(root.get("rules"), "'rules' must be a list")
    for node in root.get("rules").value or ():
        kind, name = node.get("type"), node.get("name")
        if kind is None or name is None:
            fail(node, "a rule is a map with 'type' and 'name'")
        if kind.value not in _LISTS:
            fail(kind, f"rule '{name.value}' is of unknown type '{kind.value}', expected one of {', '.join(_LISTS)}")
        if name.value in {r.name for r in rules}:
            fail(node, f"rule name '{name.value}' occurs twice")
        lists = []
        for key in _LISTS[kind.value]:
            if node.get(key) is None:
                fail(node, f"rule '{name.value}' of type {kind.value} needs a list '{key}'")
            lists.append(names(node.get(key), f"'{key}' of rule '{name.value}' must be a list that is not empty"))
            for k, m in enumerate(lists[-1]):
                if m not in modules:
                    fail(None, f"rule '{name.value}': module '{m}' in '{key}' is unknown")
                if m in lists[-1][:k]:
                    fail(None, f"rule '{name.value}': '{m}' occurs twice in '{key}'")
        if len(lists) > 1 and set(lists[0]) & set(lists[1]):
            fail(None, f"rule '{name.value}': '{min(set(lists[0]) & set(lists[1]))}' is in both lists")
        rules.append(Rule(kind.value, name.value, *lists))

    limits, tokens = {}, {}
    for section, keys, found in (("thresholds", _LIMITS, limits), ("classification", _TOKENS, tokens)):
        node = root.get(section)
        if node is None:
            continue
        if not node.is_map:
            fail(node, f"'{section}' must be a map")
        for key, value in node.value.values():
            if key.value not in keys:
                fail(key, f"unknown key '{key.value}' in '{section}', expected one of {', '.join(keys)}")
            if section == "thresholds":
                if not isinstance(value.value, str) or not re.fullmatch(r"\d+", value.value) or not int(value.value):
                    fail(value, f"threshold '{key.value}' must be a positive integer")
                found[keys[key.value]] = int(value.value)
            else:
                found[keys[key.value]] = names(value, f"'{key.value}' must be a list that is not empty")
                if "" in found[keys[key.value]]:
                    fail(value, f"'{key.value}' has an empty entry")
    return Config(modules, tuple(rules), Options(thresholds=replace(Thresholds(), **limits), extras=replace(Extras(), **tokens)))


def find(start: str, name: str = NAME) -> str | None:
    """The configuration file in ``start`` or the nearest folder above it."""
    here = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(here, name)):
            return os.path.join(here, name)
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def discover(start: str, name: str = NAME) -> Config:
    found = find(start, name)
    return load(found) if found else Config()
