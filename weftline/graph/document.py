"""Workflow documents: reading, checking and writing them; all of it at plan time, on the driver."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field

from weftline.graph.kinds import Registry, built_in, config_issues, default_config, matches

VERSION = 1
SCHEMA = "workflow-schema-v1"


@dataclass
class Port:
    id: str
    label: str | None = None
    type: str | None = None


@dataclass
class Node:
    """inputs and outputs: None undeclared, [] declared as none."""

    id: str
    kind: str = ""
    config: dict = field(default_factory=dict)
    inputs: list[Port] | None = None
    outputs: list[Port] | None = None
    label: str | None = None
    description: str | None = None
    x: float = 0.0
    y: float = 0.0

    def option(self, key: str) -> object:
        """None also for a null."""
        return self.config.get(key)


@dataclass
class Edge:
    id: str
    source: str
    target: str
    source_handle: str | None = None
    target_handle: str | None = None
    label: str | None = None

    @property
    def out(self) -> str:
        return self.source_handle or "out"

    @property
    def into(self) -> str:
        return self.target_handle or "in"


@dataclass
class Graph:
    nodes: list[Node] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)

    def node(self, node_id: str) -> Node | None:
        return next((n for n in self.nodes if n.id == node_id), None)

    def incoming(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node_id]

    def order(self) -> list[Node] | None:
        """Kahn's order: seeds as in the document, successors as the edges come; None for a cycle or a doubled id."""
        by_id = {n.id: n for n in self.nodes}
        if len(by_id) < len(self.nodes):
            return None
        waits = dict.fromkeys(by_id, 0)
        follow: dict[str, list[str]] = {i: [] for i in by_id}
        for e in self.edges:
            if e.target in waits:
                waits[e.target] += 1
                if e.source in follow:
                    follow[e.source].append(e.target)
        ready, done = deque(i for i in by_id if not waits[i]), []
        while ready:
            done.append(by_id[ready.popleft()])
            for target in follow[done[-1].id]:
                waits[target] -= 1
                if not waits[target]:
                    ready.append(target)
        return done if len(done) == len(by_id) else None

    def reach(self, starts: list[str]) -> set[str]:
        seen, stack = set(), list(starts)
        follow: dict[str, list[str]] = {}
        for e in self.edges:
            follow.setdefault(e.source, []).append(e.target)
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += follow.get(n, ())
        return seen


@dataclass
class Issue:
    severity: str
    message: str
    node_id: str | None = None
    edge_id: str | None = None


@dataclass
class Imported:
    graph: Graph
    metadata: dict
    issues: list[Issue]

    @property
    def ok(self) -> bool:
        return all(i.severity != "error" for i in self.issues)


class ImportFailed(ValueError):
    """The text is no JSON."""


def _text(raw: object, key: str) -> str | None:
    value = raw.get(key) if isinstance(raw, dict) else None
    return value if isinstance(value, str) else None


def ports_from(raw: object) -> list[Port] | None:
    if not isinstance(raw, list):
        return None
    found = []
    for p in raw:
        if isinstance(p, str):
            found.append(Port(p))
        elif isinstance(p, dict) and isinstance(p.get("id"), str):
            found.append(Port(p["id"], _text(p, "label"), _text(p, "type")))
    return found


def import_json(text: str, lenient: bool = False, kinds: Registry | None = None) -> Imported:
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise ImportFailed(str(e)) from e
    return import_document(doc, lenient, kinds)


def import_document(doc: object, lenient: bool = False, kinds: Registry | None = None) -> Imported:
    """A graph and what is wrong with it. Lenient: an unknown kind or version is a warning, not an error."""
    kinds = kinds or built_in()
    graph, issues = Graph(), []
    if not isinstance(doc, dict):
        return Imported(graph, {}, [Issue("error", "Schema is not an object.")])
    meta = doc.get("metadata") if isinstance(doc.get("metadata"), dict) else {}
    version = doc.get("version")
    if version != VERSION or isinstance(version, bool):
        issues.append(Issue("warning" if lenient else "error", f"Unsupported workflow schema version: {version} (expected {VERSION})"))
        if not lenient:
            return Imported(graph, meta, issues)
    body = doc.get("graph") if isinstance(doc.get("graph"), dict) else {}
    for raw in body.get("nodes") if isinstance(body.get("nodes"), list) else []:
        node_id = _text(raw, "id")
        if node_id is None:
            issues.append(Issue("error", "A node has no id."))
            continue
        name = _text(raw, "kind") or ""
        kind = kinds.get(name)
        if kind is None:
            issues.append(Issue("warning" if lenient else "error", f'Unknown kind "{name}" - register it before importing.', node_id))
        config = raw.get("config") if isinstance(raw.get("config"), dict) else default_config(kind) if kind else {}
        issues += [Issue("warning", m, node_id) for m in (config_issues(kind, config) if kind else [])]
        at = raw.get("position") if isinstance(raw.get("position"), dict) else {}
        x, y = (v if isinstance(v := at.get(k), (int, float)) and not isinstance(v, bool) else 0.0 for k in "xy")
        label = _text(raw, "label") or (kind.label or kind.name if kind else name)
        graph.nodes.append(Node(node_id, name, dict(config), ports_from(raw.get("inputs")), ports_from(raw.get("outputs")), label, _text(raw, "description"), x, y))
    ids = {n.id for n in graph.nodes}
    for raw in body.get("edges") if isinstance(body.get("edges"), list) else []:
        e = Edge(_text(raw, "id") or "", _text(raw, "source") or "", _text(raw, "target") or "", _text(raw, "sourceHandle") or None, _text(raw, "targetHandle") or None, _text(raw, "label"))
        lost = [(what, end) for what, end in (("source", e.source), ("target", e.target)) if end not in ids]
        if lost:
            issues += [Issue("warning", f'Edge {what} "{end}" not found.', edge_id=e.id) for what, end in lost[:1]]
        else:
            graph.edges.append(e)
    issues += connectivity_issues(graph, kinds)
    return Imported(graph, meta, issues)


def is_terminal(node: Node, kinds: Registry) -> bool:
    """Whether the node publishes on no port: its own declaration goes before its kind's."""
    if node.outputs is not None:
        return not node.outputs
    kind = kinds.get(node.kind)
    return kind is not None and kind.outputs == ()


def may_float(node: Node, kinds: Registry) -> bool:
    kind = kinds.get(node.kind)
    return kind is None or matches(node.kind, "note") or kind.category in ("annotation", "layout")


def connectivity_issues(graph: Graph, kinds: Registry) -> list[Issue]:
    """Nodes tied to nothing, in graphs of more than one, and edges that leave terminal nodes."""
    found = []
    tied = {e.source for e in graph.edges} | {e.target for e in graph.edges}
    if len(graph.nodes) > 1:
        found += [Issue("error", f'Node "{n.id}" is connected to nothing.', n.id) for n in graph.nodes if n.id not in tied and not may_float(n, kinds)]
    ends = {n.id for n in graph.nodes if is_terminal(n, kinds)}
    found += [Issue("error", f'Edge "{e.id}" reads from "{e.source}", a terminal node.', e.source, e.id) for e in graph.edges if e.source in ends]
    return found


def export_document(graph: Graph, metadata: dict | None = None) -> dict:
    def port(p: Port) -> dict:
        return {"id": p.id} | ({"label": p.label} if p.label is not None else {}) | ({"type": p.type} if p.type is not None else {})

    nodes = []
    for n in graph.nodes:
        out: dict = {"id": n.id, "kind": n.kind or "custom", "position": {"x": n.x, "y": n.y}}
        out |= {k: v for k, v in (("label", n.label), ("description", n.description)) if v is not None}
        if n.config:
            out["config"] = n.config
        for key, ports in (("inputs", n.inputs), ("outputs", n.outputs)):
            if ports is not None:
                out[key] = [port(p) for p in ports]
        nodes.append(out)
    edges = []
    for e in graph.edges:
        out = {"id": e.id, "source": e.source, "target": e.target}
        out |= {k: v for k, v in (("sourceHandle", e.source_handle), ("targetHandle", e.target_handle), ("label", e.label)) if v is not None}
        edges.append(out)
    doc: dict = {"$schema": SCHEMA, "version": VERSION}
    if metadata:
        doc["metadata"] = metadata
    return doc | {"graph": {"nodes": nodes, "edges": edges}}


def export_json(graph: Graph, metadata: dict | None = None) -> str:
    return json.dumps(export_document(graph, metadata), separators=(",", ":"), ensure_ascii=False)


def possible_ports(node: Node, kinds: Registry) -> list[str]:
    """Ports that a node can publish on, as its declaration, its config or its kind has them."""
    if node.outputs is not None:
        return [p.id for p in node.outputs]
    kind = kinds.get(node.kind)
    if kind is None:
        return ["out"]
    declared = list(kind.outputs or ())
    config, ports = node.config, []
    if kind.name == "switch_case" and isinstance(config.get("cases"), dict):
        ports = [p for p in config["cases"].values() if isinstance(p, str) and p]
        ports += ["default"] if ports else []
    elif kind.name == "llm_router" and isinstance(config.get("routes"), list):
        routes = [r if isinstance(r, str) else r.get("port") if isinstance(r, dict) else None for r in config["routes"]]
        ports = [r for r in routes if isinstance(r, str) and r]
        ports += ["fallback"] if ports and config.get("fallback") is not False else []
    elif kind.name == "subflow" and config.get("mode") in ("stream", "both"):
        ports = [*(declared or ["out"]), "stream"]
    return list(dict.fromkeys(ports)) or declared


@dataclass
class Policy:
    """What a graph from elsewhere may be. The caps of the default and the trusted policy."""

    max_nodes: int = 60
    max_edges: int = 120
    max_depth: int = 12
    max_string: int = 20_000
    max_bytes: int = 256_000
    allow: frozenset[str] | None = None
    deny: frozenset[str] = frozenset()

    @classmethod
    def trusted(cls) -> Policy:
        return cls(5_000, 10_000, 32, 1_000_000, 8_000_000)

    @classmethod
    def untrusted(cls) -> Policy:
        return cls(allow=frozenset())

    def inspect(self, graph: Graph) -> list[Issue]:
        from weftline.graph.kinds import bare

        found = []
        if len(graph.nodes) > self.max_nodes:
            found.append(Issue("error", f"Graph has {len(graph.nodes)} nodes; the policy permits {self.max_nodes}."))
        if len(graph.edges) > self.max_edges:
            found.append(Issue("error", f"Graph has {len(graph.edges)} edges; the policy permits {self.max_edges}."))
        for n in graph.nodes:
            name = bare(n.kind)
            if name in self.deny or self.allow is not None and name not in self.allow:
                found.append(Issue("error", f'Kind "{n.kind}" is not permitted.', n.id))
            problem = self._config(n.config)
            if problem:
                found.append(Issue("error", problem, n.id))
        size = len(export_json(graph).encode())
        if size > self.max_bytes:
            found.append(Issue("error", f"Graph serializes to {size} bytes; the policy permits {self.max_bytes}."))
        return found

    def _config(self, config: dict) -> str | None:
        stack: list[tuple[object, int]] = [(config, 1)]
        while stack:
            value, depth = stack.pop()
            if depth > self.max_depth:
                return f"Config nests deeper than {self.max_depth} levels."
            if isinstance(value, str) and len(value.encode()) > self.max_string:
                return f"A config string is {len(value.encode())} characters; the policy permits {self.max_string}."
            if isinstance(value, dict):
                stack += [(v, depth + 1) for v in value.values()]
            elif isinstance(value, list):
                stack += [(v, depth + 1) for v in value]
        return None


def manifest_issues(manifest: object) -> list[Issue]:
    """What keeps a kind's manifest from being taken."""
    from weftline.graph.kinds import is_namespaced, namespaces

    if not isinstance(manifest, dict):
        return [Issue("error", "Manifest is not an object.")]
    found, name = [], manifest.get("name")
    if not isinstance(name, str) or not is_namespaced(name) or not name.split("/", 1)[1]:
        found.append(Issue("error", "A manifest's name must be @scope/name."))
    elif name.startswith(namespaces()[0]):
        found.append(Issue("warning", f"{namespaces()[0]} is the first party's namespace."))
    if not isinstance(manifest.get("version"), str) or not manifest["version"]:
        found.append(Issue("error", "A manifest needs a version."))
    if "aliases" in manifest and not isinstance(manifest["aliases"], list):
        found.append(Issue("error", "Aliases must be a list."))
    return found
