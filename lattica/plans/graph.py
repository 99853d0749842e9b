"""Block graphs: nodes with parameters, typed ports, edges; checked, then composed into lazy DataFrames.

There is no scheduler here: running a graph calls each block once, in dependency order, and blocks only compose plans. What is
computed, and when, is Spark's business.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.numeric import FNV_FACTOR, FNV_START
from ..table import Table, View

KINDS = {"DataTable": Table, "RenderedView": View, "Scalar": (int, float, str, bool)}


@dataclass(frozen=True)
class Node:
    id: str
    block: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    output: str
    target: str
    input: str


@dataclass(frozen=True)
class Block:
    """inputs and outputs: port names to kinds (an input's name ends in ? if it may be open); params: names to defaults."""

    name: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    params: dict
    apply: Callable[[dict, dict], dict] | None = None


@dataclass(frozen=True)
class Graph:
    nodes: list[Node]
    edges: list[Edge]

    def to_json(self) -> str:
        return json.dumps({"instances": [vars(n) for n in self.nodes], "connections": [vars(e) for e in self.edges]}, indent=2)

    def content_hash(self) -> str:
        """The same for graphs of equal nodes and edges, however they were made: FNV-1a over JSON with sorted keys."""
        text = json.dumps({"instances": [vars(n) for n in self.nodes], "connections": [vars(e) for e in self.edges]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        value = FNV_START
        for unit in memoryview(text.encode("utf-16-le")).cast("H"):
            value = (value ^ unit) * FNV_FACTOR & 0xFFFFFFFF
        return f"{value:08x}"

    @staticmethod
    def from_json(text: str) -> Graph:
        raw = json.loads(text)
        if not isinstance(raw, dict) or not {"instances", "connections"} <= raw.keys():
            raise ValueError("a graph has instances and connections")
        return Graph([Node(**n) for n in raw["instances"]], [Edge(**e) for e in raw["connections"]])


class Registry:
    """Blocks by name. The first registration of a name holds."""

    def __init__(self, blocks: list[Block] = ()):
        self.blocks: dict[str, Block] = {}
        for b in blocks:
            self.register(b)

    def register(self, block: Block) -> bool:
        return self.blocks.setdefault(block.name, block) is block


class GraphError(ValueError):
    """Problems of a graph, as (code, what)."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("; ".join(f"{c}: {w}" for c, w in problems))
        self.problems = problems

    @property
    def codes(self) -> list[str]:
        return [c for c, _ in self.problems]


def check_edge(graph_nodes: dict[str, Block], edge: Edge, taken: set) -> list[tuple[str, str]]:
    """What is wrong with one edge; taken: inputs that have one already."""
    what = f"{edge.source}.{edge.output} -> {edge.target}.{edge.input}"
    a, b = graph_nodes.get(edge.source), graph_nodes.get(edge.target)
    if a is None:
        return [("unknown_source_node", what)]
    if b is None:
        return [("unknown_target_node", what)]
    if edge.output not in a.outputs:
        return [("unknown_source_port", what)]
    own = edge.input if edge.input in b.inputs else f"{edge.input}?"
    if own not in b.inputs:
        return [("unknown_target_port", what)]
    if a.outputs[edge.output] != b.inputs[own]:
        return [("type_mismatch", what)]
    if (edge.target, edge.input) in taken:
        return [("duplicate_input", what)]
    return []


def compiled(graph: Graph, registry: Registry) -> list[tuple[Node, dict, dict]]:
    """Nodes in dependency order, each with its parameters over the defaults and its inputs as (node, output); raises GraphError."""
    problems: list[tuple[str, str]] = []
    known: dict[str, Block] = {}
    for n in graph.nodes:
        if n.id in known:
            problems.append(("duplicate_node", n.id))
        elif n.block not in registry.blocks:
            problems.append(("unknown_block", n.block))
        else:
            known[n.id] = registry.blocks[n.block]
    inputs: dict[str, dict[str, tuple[str, str]]] = {n.id: {} for n in graph.nodes}
    taken: set = set()
    for e in graph.edges:
        found = check_edge(known, e, taken)
        problems += found
        if not found:
            taken.add((e.target, e.input))
            inputs[e.target][e.input] = (e.source, e.output)
    for i, block in known.items():
        if block.apply is None:
            problems.append(("missing_executor", i))
        problems += [("missing_required_input", f"{i}.{p}") for p in block.inputs if not p.endswith("?") and p not in inputs[i]]
    if problems:
        raise GraphError(problems)
    order: list[tuple[Node, dict, dict]] = []
    done: set[str] = set()
    waiting = list(graph.nodes)
    while waiting:
        ready = [n for n in waiting if all(s in done for s, _ in inputs[n.id].values())]
        if not ready:
            raise GraphError([("cycle_detected", ", ".join(n.id for n in waiting))])
        order += [(n, {**known[n.id].params, **n.params}, inputs[n.id]) for n in ready]
        done |= {n.id for n in ready}
        waiting = [n for n in waiting if n.id not in done]
    return order


class Session:
    """Keeps what a graph's nodes gave, by block, parameters and what came in; a changed node composes itself and what follows it
    anew. A node that raises keeps nothing, so the next run tries it again."""

    def __init__(self, registry: Registry):
        self.registry = registry
        self.kept: dict[str, tuple[str, dict]] = {}

    def run(self, graph: Graph) -> dict[str, dict]:
        keys: dict[str, str] = {}
        out: dict[str, dict] = {}
        for node, params, inputs in compiled(graph, self.registry):
            keys[node.id] = json.dumps([node.block, params, [(p, keys[s], o) for p, (s, o) in sorted(inputs.items())]], sort_keys=True, default=str)
            known = self.kept.get(node.id)
            if known is None or known[0] != keys[node.id]:
                self.kept.pop(node.id, None)
                got = self.registry.blocks[node.block].apply({p: out[s][o] for p, (s, o) in inputs.items()}, params)
                self.kept[node.id] = (keys[node.id], got)
            out[node.id] = self.kept[node.id][1]
        return out

    def invalidate(self, node: str) -> None:
        self.kept.pop(node, None)


def run(graph: Graph, registry: Registry) -> dict[str, dict]:
    return Session(registry).run(graph)
