"""Typed flows: nodes of registered functions whose edges carry lazy DataFrames.

A flow is validated (known functions, acyclic, ports wired with the right kinds
and roles) before anything runs; then each node's runner builds a plan, and only
the requested outputs are computed.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .roles import Dataset, FlowError


@dataclass(frozen=True)
class Port:
    name: str
    kinds: tuple[str, ...] = ("dataset",)
    roles: tuple[str, ...] = ()
    required: bool = True


@dataclass(frozen=True)
class Param:
    name: str
    default: Any = None
    required: bool = False
    kind: str = "text"

    def value(self, given: dict[str, Any]) -> Any:
        v = given.get(self.name, self.default)
        if v is None and self.required:
            raise FlowError(f"parameter {self.name} is missing")
        if self.kind == "bool" and isinstance(v, str):
            return v.strip().lower() in ("on", "true", "1", "yes")
        if self.kind == "number" and isinstance(v, str) and v.strip():
            return float(v) if "." in v else int(v)
        return v


@dataclass(frozen=True)
class Function:
    """A function with ports and a runner(inputs, params, context) -> {output port: value}."""

    name: str
    inputs: tuple[Port, ...]
    outputs: tuple[Port, ...]
    params: tuple[Param, ...]
    run: Callable[[dict[str, Any], dict[str, Any], Context], dict[str, Any]]
    provides: tuple[str, ...] = ()


@dataclass
class Node:
    id: str
    function: str
    params: dict[str, Any] = field(default_factory=dict)
    inputs: dict[str, str] = field(default_factory=dict)  # port -> "node" or "node.port"


@dataclass
class Result:
    """What a node gave; a failure is a message, not an exception."""

    ok: bool
    outputs: dict[str, Any] = field(default_factory=dict)
    error: str = ""


@dataclass
class Context:
    """What runners share: sources, models, guides, text of metrics."""

    spark: Any
    sources: dict[str, Dataset] = field(default_factory=dict)
    models: dict[str, Callable] = field(default_factory=dict)
    guides: dict[str, str] = field(default_factory=dict)
    extras: dict[str, Any] = field(default_factory=dict)


_registry: dict[str, Function] = {}


def register(f: Function) -> Function:
    _registry[f.name] = f
    return f


def function(name: str) -> Function:
    if name not in _registry:
        raise FlowError(f"unknown function: {name}")
    return _registry[name]


def names() -> list[str]:
    return list(_registry)


def load(text: str | dict) -> list[Node]:
    """Nodes of a flow, in the current shape or an older one whose nodes are named by type."""
    raw = json.loads(text) if isinstance(text, str) else copy.deepcopy(text)
    out = []
    for n in raw["nodes"]:
        kind, params = n.get("type", "function"), dict(n.get("params", {}))
        name = params.pop("function", None) if kind == "function" else kind
        inputs = {p: (w if isinstance(w, str) else f"{w['node']}.{w['port']}" if w.get("port") else w["node"]) for p, w in (n.get("inputs") or {}).items()}
        if name in ("evaluate_formula", "score_workflow_llm"):  # older flows wire the node, not its metrics
            inputs = {p: (w if "." in w or p != "metrics" else f"{w}.metrics") for p, w in inputs.items()}
        out.append(Node(str(n["id"]), str(name), params, inputs))
    return out


def order(nodes: list[Node]) -> list[Node]:
    """Upstream first; an unknown node or a cycle is an error."""
    by_id = {n.id: n for n in nodes}
    done: dict[str, bool] = {}
    out: list[Node] = []

    def visit(i: str, path: tuple[str, ...]) -> None:
        if i not in by_id:
            raise FlowError(f"unknown node: {i}")
        if i in path:
            raise FlowError(f"cycle: {' -> '.join([*path, i])}")
        if i in done:
            return
        for wire in by_id[i].inputs.values():
            visit(wire.split(".")[0], (*path, i))
        done[i] = True
        out.append(by_id[i])

    for n in nodes:
        visit(n.id, ())
    return out


def validate(nodes: list[Node], context: Context) -> list[Node]:
    """The nodes in order, if their wiring holds."""
    ordered = order(nodes)
    by_id = {n.id: n for n in ordered}
    for n in ordered:
        f = function(n.function)
        ports = {p.name: p for p in f.inputs}
        for name in n.inputs:
            if name not in ports:
                raise FlowError(f"{n.id}: no input port {name}")
        for p in f.inputs:
            if p.name not in n.inputs:
                if p.required:
                    raise FlowError(f"{n.id}: port {p.name} is not wired")
                continue
            source, _, port = n.inputs[p.name].partition(".")
            up = by_id[source]
            given = _output(function(up.function), port)
            if not set(given.kinds) & set(p.kinds):
                raise FlowError(f"{n.id}: port {p.name} takes {'/'.join(p.kinds)}, not {'/'.join(given.kinds)}")
            if p.roles:
                have = set(given.roles) or set(function(up.function).provides)
                if up.function == "datasource":
                    ref = up.params.get("source")
                    if ref not in context.sources:
                        raise FlowError(f"{up.id}: unknown source {ref}")
                    have = set(context.sources[ref].roles)
                missing = [r for r in p.roles if r not in have]
                if missing:
                    raise FlowError(f"{n.id}: port {p.name} needs {', '.join(missing)} of {source}")
        for q in f.params:
            q.value(n.params)
    return ordered


def _output(f: Function, port: str) -> Port:
    if not port:
        return f.outputs[0]
    found = next((o for o in f.outputs if o.name == port), None)
    if found is None:
        raise FlowError(f"{f.name} has no output {port}")
    return found


def run(nodes: list[Node], context: Context) -> dict[str, Result]:
    """Build every node's plan in order; nodes after a failure fail too."""
    results: dict[str, Result] = {}
    for n in validate(nodes, context):
        f = function(n.function)
        values, bad = {}, ""
        for port, wire in n.inputs.items():
            source, _, name = wire.partition(".")
            up = results[source]
            if not up.ok:
                bad = f"{source} failed: {up.error}"
                break
            values[port] = up.outputs[name or function(next(x.function for x in nodes if x.id == source)).outputs[0].name]
        if bad:
            results[n.id] = Result(False, {}, bad)
            continue
        try:
            results[n.id] = Result(True, f.run(values, {q.name: q.value(n.params) for q in f.params}, context))
        except Exception as e:  # noqa: BLE001  a stage's failure is its result
            results[n.id] = Result(False, {}, f"{type(e).__name__}: {e}")
    return results


def metric_vector(df) -> dict[str, float]:
    """A one-row metrics table as names and numbers."""
    row = df.first().asDict()
    return {k: float(v) for k, v in row.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
