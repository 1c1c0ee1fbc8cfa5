"""Component graphs from INI files: ``[component name]`` with type, inputs and interval_ms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Component:
    name: str
    type: str = ""
    inputs: list[str] = field(default_factory=list)
    interval_ms: int = 0


#: One line: nothing but a comment, a heading, or a setting.
LINE = re.compile(r"(?P<skip>(?:[#;].*)?)|\[(?P<head>[^\]]*)\].*|(?P<key>[^=\[]*)=(?P<value>.*)", re.DOTALL)
HEAD = re.compile(r"component[ ](?P<name>.*)", re.DOTALL)


def _interval(value: str) -> int:
    if re.fullmatch("[0-9]+", value) is None:
        raise ValueError(f"bad interval '{value}', a whole number of milliseconds is wanted")
    return int(value)


#: What a component may set, and how its text is read.
SETTINGS = {"type": str, "inputs": lambda value: re.findall(r"[^,\s](?:[^,]*[^,\s])?", value), "interval_ms": _interval}


def _read(line: str, found: list[Component]) -> None:
    m = LINE.fullmatch(line)
    if m is None:
        raise ValueError(f"unrecognized text '{line}'")
    if m["head"] is not None:
        head = HEAD.fullmatch(m["head"])
        if head is None:
            raise ValueError(f"unrecognized heading '{line}'")
        if not head["name"].strip():
            raise ValueError("the component has no name")
        found.append(Component(head["name"].strip()))
    elif m["key"] is not None:
        key = m["key"].strip()
        if not found:
            raise ValueError(f"'{key}' stands outside of every component")
        if key not in SETTINGS:
            raise ValueError(f"unknown key '{key}'")
        setattr(found[-1], key, SETTINGS[key](m["value"].strip()))


def parse(text: str) -> list[Component]:
    """The components in order; ``ValueError`` names the line and what is wrong with it."""
    found: list[Component] = []
    for number, line in enumerate(text.split("\n"), 1):
        try:
            _read(line.strip(), found)
        except ValueError as e:
            raise ValueError(f"line {number}: {e}") from None
    untyped = [c.name for c in found if not c.type]
    if untyped:
        raise ValueError(f"missing type of {untyped}")
    return found


def to_flow(components: list[Component], name: str):
    """A flow of registered components; each one's output is the channel of its name."""
    from .flow import FlowBuilder

    f = FlowBuilder(name)
    for c in components:
        made = f.from_(c.type, *[f.tap(i) for i in c.inputs], interval_us=c.interval_ms * 1000, output=c.name)
        if not made:
            raise ValueError(f"no component {c.type} with {len(c.inputs)} inputs")
    return f
