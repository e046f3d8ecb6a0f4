"""User-defined operators (SQL templates over typed parameters) and saved flows of operators."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from geoloom.cluster import written
from geoloom.layer import Layer, quoted, same_crs
from geoloom.operators.attributes import transform_sql

_KINDS: dict[str, Callable[[Any], str]] = {
    "column": lambda v: quoted(str(v)),
    "columns": lambda v: ", ".join(quoted(str(c)) for c in v),
    "number": lambda v: repr(float(v)) if not float(v).is_integer() else str(int(float(v))),
    "text": lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'",
}


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    default: Any = None


def define_operator(name: str, params: Sequence[Param], steps: Sequence[tuple[str, str]], inputs: Sequence[str] = ("input",)) -> Callable[..., Layer]:
    """A function over layers from named SQL steps.

    ``{{inputs.x}}``, ``{{steps.y}}`` and ``{{params.z}}`` in a step stand for tables, earlier steps, and parameters
    written as their kind says: quoted columns, numbers or quoted text. The last step is the result.
    """
    for p in params:
        if p.kind not in _KINDS:
            raise ValueError(f"unknown kind of parameter: {p.kind}")
    if not steps:
        raise ValueError("an operator needs a step")

    def run(*layers: Layer, **given: Any) -> Layer:
        if len(layers) != len(inputs):
            raise ValueError(f"{name} takes {len(inputs)} inputs")
        unknown = set(given) - {p.name for p in params}
        if unknown:
            raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        values = {p.name: _KINDS[p.kind](given.get(p.name, p.default)) for p in params}
        main, views, call = layers[0], [], uuid.uuid4().hex
        spark = main.df.sparkSession
        try:
            tables = {}
            for key, l in zip(inputs, layers, strict=True):
                tables[f"inputs.{key}"] = view = f"geoloom_{call}_{key}"
                l.df.createOrReplaceTempView(view)
                views.append(view)
            out = main
            for key, sql in steps:
                def put(m: re.Match) -> str:
                    what = m[1].strip()
                    if what in tables:
                        return tables[what]
                    if what.startswith("params.") and what[7:] in values:
                        return values[what[7:]]
                    raise ValueError(f"{name}: nothing is called {what}")

                out = transform_sql(main, re.sub(r"\{\{(.*?)\}\}", put, sql))
                tables[f"steps.{key}"] = view = f"geoloom_{call}_step_{key}"
                out.df.createOrReplaceTempView(view)
                views.append(view)
            return out
        finally:
            for v in views:
                spark.catalog.dropTempView(v)

    run.__name__ = name
    return run


class Flow:
    """A graph of operators: nodes ``{id, operator, params}`` and edges ``{from, fromPort, to, toPort}``.

    ``operators`` maps names to functions of (inputs by port, params) that return a layer or layers by port. ``build``
    gives every port's lazy layer; a node that fails blocks those after it, and the rest stays usable.
    """

    def __init__(self, graph: dict, operators: dict[str, Callable[[dict[str, Layer], dict], Any]]):
        self.nodes = {n["id"]: n for n in graph["nodes"]}
        self.edges, self.operators = graph.get("edges", []), operators
        self.errors: dict[str, str] = {}

    @classmethod
    def from_json(cls, text: str, operators: dict[str, Callable[[dict[str, Layer], dict], Any]]) -> Flow:
        """A saved flow. What its nodes or edges refer to must be there, and every operator known."""
        graph = json.loads(text)
        flow = cls(graph, operators)
        if len(flow.nodes) != len(graph["nodes"]):
            raise ValueError("two nodes have one id")
        if unknown := {n["operator"] for n in graph["nodes"]} - set(operators):
            raise ValueError(f"unknown operators: {', '.join(sorted(unknown))}")
        if lost := {e[k] for e in flow.edges for k in ("from", "to")} - set(flow.nodes):
            raise ValueError(f"edges lead to no node: {', '.join(sorted(lost))}")
        flow.order()
        return flow

    def to_json(self) -> str:
        return json.dumps({"nodes": list(self.nodes.values()), "edges": self.edges}, sort_keys=True)

    def run(self, write: Callable[[Layer, str, str], None], outputs: Sequence[dict]) -> dict[str, str]:
        """Write the ``outputs``, each ``{from, fromPort, path, format}``, and say of each path how that went.

        A port that several outputs or nodes take is written once in the shared folder and read from there. An output
        that fails, or whose node did, doesn't keep the others from being written.
        """
        layers, said = self.build(persist=True), {}
        for o in outputs:
            port = (o["from"], o.get("fromPort", "output"))
            try:
                if port not in layers:
                    raise ValueError(self.errors.get(o["from"], f"there is no port {port[1]} of {o['from']}"))
                write(layers[port], o["path"], o.get("format", "Parquet"))
                said[o["path"]] = "written"
            except Exception as error:  # noqa: BLE001 - reported with its path
                said[o["path"]] = f"{type(error).__name__}: {error}"
        return said

    def order(self) -> list[str]:
        """Node ids, each after those it takes from; a cycle is an error."""
        waiting = {n: {e["from"] for e in self.edges if e["to"] == n} for n in self.nodes}
        out: list[str] = []
        while waiting:
            free = [n for n, before in waiting.items() if not before - set(out)]
            if not free:
                raise ValueError("the flow has a cycle")
            out += free
            for n in free:
                del waiting[n]
        return out

    def build(self, persist: bool = False) -> dict[tuple[str, str], Layer]:
        """Every port's layer. With ``persist``, ports that several nodes take are written once."""
        taken = [(e["from"], e.get("fromPort", "output")) for e in self.edges]
        done: dict[tuple[str, str], Layer] = {}
        self.errors = {}
        for n in self.order():
            into = [e for e in self.edges if e["to"] == n]
            blocked = [e["from"] for e in into if e["from"] in self.errors]
            if blocked:
                self.errors[n] = f"blocked by {', '.join(blocked)}"
                continue
            try:
                inputs = {e.get("toPort", "input"): done[e["from"], e.get("fromPort", "output")] for e in into}
                spatial = [l for l in inputs.values() if l.geometry]
                if len(spatial) > 1:
                    same_crs(*spatial)
                out = self.operators[self.nodes[n]["operator"]](inputs, self.nodes[n].get("params", {}))
            except Exception as error:  # noqa: BLE001 - whatever an operator raises belongs to its node
                self.errors[n] = f"{type(error).__name__}: {error}"
                continue
            for port, l in (out if isinstance(out, dict) else {"output": out}).items():
                done[n, port] = l.with_df(written(l.df, "port")) if persist and taken.count((n, port)) > 1 else l
        return done
