"""Operators and whole flows by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

_parts: dict[str, tuple[int, Callable, tuple[str, ...]]] = {}
_flows: dict[str, Callable] = {}


def component(name: str, inputs: int, needs: Sequence[str] = ()):
    """Register a function of ``inputs`` DataFrames (a source has none and gets the session).

    ``needs`` are columns and types that each input must have, as DDL; they are checked when a flow is lowered.
    """

    def put(fn: Callable) -> Callable:
        _parts[name] = (inputs, fn, tuple(needs))
        return fn

    return put


def flow(name: str):
    """Register a function that declares a flow."""

    def put(fn: Callable) -> Callable:
        _flows[name] = fn
        return fn

    return put


def get_component(name: str, inputs: int) -> Callable | None:
    """The component, or None if it is unknown or takes another number of inputs."""
    known = _parts.get(name)
    return known[1] if known and known[0] == inputs else None


def needs_of(name: str) -> tuple[str, ...]:
    return _parts[name][2] if name in _parts else ()


def has_flow(name: str) -> bool:
    return name in _flows


def build_flow(name: str):
    if name not in _flows:
        raise KeyError(f"no flow named {name}; known are {sorted(_flows)}")
    return _flows[name]()
