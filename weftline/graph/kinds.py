"""Node kinds: their ids, ports, categories and what else a graph's checks need."""

from __future__ import annotations

from dataclasses import dataclass

#: Namespaces in which a document may spell the catalogue's own kinds, the first being the one that exports write. A
#: host whose documents come from elsewhere names theirs with use_namespaces().
_namespaces = ["@weftline/", "@weft/"]


def use_namespaces(*names: str) -> None:
    """Take these for the catalogue's own namespaces from now on, each with its @ and /."""
    if not names or not all(is_namespaced(n) and n.endswith("/") for n in names):
        raise ValueError("a namespace is written @name/")
    _namespaces[:] = names


def namespaces() -> tuple[str, ...]:
    return tuple(_namespaces)


def is_namespaced(name: str) -> bool:
    return name.startswith("@") and "/" in name


def bare(name: str) -> str:
    """The name without the namespace."""
    return name.split("/", 1)[1] if is_namespaced(name) else name


def canonical(name: str) -> str:
    return name if is_namespaced(name) else _namespaces[0] + name


def variants(name: str) -> list[str]:
    """All spellings under which a kind may be asked for."""
    b = bare(name)
    return list(dict.fromkeys([name, _namespaces[0] + b, b, *(n + b for n in _namespaces[1:])]))


def matches(name: str, wanted: str) -> bool:
    """Whether name is one of the own spellings of the bare name wanted; another namespace's is not."""
    return name == wanted or name in [n + wanted for n in _namespaces]


@dataclass(frozen=True)
class Field:
    key: str
    type: str = "text"
    required: bool = False
    options: tuple[str, ...] = ()
    default: object = None
    fields: tuple[Field, ...] = ()


@dataclass(frozen=True)
class Kind:
    name: str
    category: str
    inputs: tuple[str, ...] | None = ("in",)
    outputs: tuple[str, ...] | None = ("out",)
    config: tuple[Field, ...] = ()
    aliases: tuple[str, ...] = ()
    pauses: str | None = None
    side_effects: str | None = None
    emits: str | None = None
    shape: tuple[str, ...] | str | None = None
    label: str = ""
    executes: bool = True
    defaults: tuple[tuple[str, object], ...] = ()
    about: tuple[tuple[str, str], ...] = ()  # description, icon and accent, where they are given


def _f(key: str, type: str = "text", **more) -> Field:
    return Field(key, type, **more)


#: The catalogue that documents refer to.
_BUILT_IN = (
    Kind("manual_trigger", "trigger", (), emits="inputs_merged"),
    Kind("webhook_trigger", "trigger", (), config=(_f("path"),)),
    Kind("schedule_trigger", "trigger", (), config=(_f("cron", required=True), _f("timezone", default="UTC")), emits="inputs_merged", shape=("cron", "timezone")),
    Kind("user_input", "human", pauses="input", side_effects="none", shape="dynamic"),
    Kind("human_approval", "human", outputs=("approved", "denied"), pauses="approval", emits="input"),
    Kind("notify", "human", config=(_f("channel"), _f("to"), _f("message", "textarea")), side_effects="unsafe-to-replay", shape=("sent", "channel", "to", "message")),
    Kind("branch", "logic", outputs=("true", "false"), config=(_f("condition", "expression", required=True),), emits="input"),
    Kind("switch_case", "logic", outputs=("default",), config=(_f("value", "expression", required=True), _f("cases", "json")), emits="input"),
    Kind("for_each", "logic", outputs=("item", "done"), config=(_f("source", "expression"),), shape=("items", "results", "failures", "count")),
    Kind("merge", "logic", ("a", "b"), config=(_f("mode", "select", options=("merge", "concat"), default="merge"),), shape="dynamic"),
    Kind("wait", "logic", config=(_f("mode", "select", options=("duration", "until"), default="duration"), _f("duration")), shape=("waited", "duration", "input")),
    Kind("transform", "logic", config=(_f("mode", "select", options=("fields", "expression"), default="fields"), _f("fields", "repeater", fields=(_f("key"), _f("value", "expression"))), _f("expression", "expression")), shape="dynamic"),
    Kind("subflow", "logic", config=(_f("workflow", required=True),)),
    Kind("memory_store", "data", config=(_f("operation", "select", options=("read", "write", "append"), default="read"), _f("key", required=True), _f("value", "expression")), side_effects="idempotent"),
    Kind("data_store", "data", config=(_f("operation", "select", options=("get", "set", "delete", "list", "query"), default="get"), _f("table", required=True), _f("key", "expression"), _f("value", "expression"), _f("where", "json")), side_effects="idempotent"),
    Kind("variable", "data", config=(_f("value", "expression"),), emits="expression:value"),
    Kind("llm_call", "ai", config=(_f("prompt", "textarea", required=True),), side_effects="unsafe-to-replay", shape="dynamic"),
    Kind("llm_router", "ai", outputs=("default",), config=(_f("routes", "json"),), aliases=("llm_branch",), shape=("route", "reason", "input")),
    Kind("tool_use", "ai", config=(_f("tool", required=True), _f("args", "json")), side_effects="unsafe-to-replay"),
    Kind("embed_search", "ai", config=(_f("query", "expression", required=True), _f("topK", "number", default=5)), shape=("query", "matches")),
    Kind("api_request", "io", config=(_f("method", "select", options=("GET", "POST", "PUT", "PATCH", "DELETE"), default="GET"), _f("url", "expression", required=True), _f("headers", "json"), _f("body", "expression")), side_effects="unsafe-to-replay", shape=("status", "headers", "body")),
    Kind("webhook_out", "io", config=(_f("url", "expression", required=True), _f("payload", "expression")), side_effects="unsafe-to-replay", shape=("sent", "status", "response")),
    Kind("output", "output", outputs=(), emits="input"),
    Kind("log", "output", outputs=(), config=(_f("level", "select", options=("info", "warn", "error", "debug"), default="info"), _f("message", "expression")), shape=("logged", "level")),
    Kind("note", "annotation", None, None, executes=False),
    Kind("subgraph", "structural", config=(_f("graph", "json"),)),
    Kind("agent", "ai", side_effects="unsafe-to-replay", executes=False),
)


class Registry:
    """Kinds by every id that they answer to."""

    def __init__(self, kinds: tuple[Kind, ...] | list[Kind] = ()):
        self.by_id: dict[str, Kind] = {}
        for kind in kinds:
            self.register(kind)

    def register(self, kind: Kind) -> Registry:
        for name in (kind.name, *kind.aliases):
            for spelling in variants(name):
                self.by_id[spelling] = kind
        return self

    def get(self, name: str | None) -> Kind | None:
        return next((self.by_id[v] for v in variants(name) if v in self.by_id), None) if name else None


def built_in() -> Registry:
    return Registry(_BUILT_IN)


def default_config(kind: Kind) -> dict:
    return {f.key: f.default for f in kind.config if f.default is not None} | dict(kind.defaults)


ABOUT = ("description", "icon", "accent")


def kind_of(raw: object) -> Kind | None:
    """A host's own kind from its JSON form; None without a name. Only a list declares ports, and an empty one declares none."""

    def texts(key: str) -> tuple[str, ...] | None:
        if not isinstance(raw.get(key), list):
            return None
        ids = (p.get("id") if isinstance(p, dict) else p for p in raw[key])
        return tuple(i for i in ids if isinstance(i, str))

    def text(key: str, default: str | None = None) -> str | None:
        return raw[key] if isinstance(raw.get(key), str) else default

    if not isinstance(raw, dict) or text("name") is None:
        return None
    defaults = raw.get("defaultConfig") if isinstance(raw.get("defaultConfig"), dict) else {}
    about = tuple((k, raw[k]) for k in ABOUT if text(k) is not None)
    aliases = tuple(a for a in raw["aliases"] if isinstance(a, str)) if isinstance(raw.get("aliases"), list) else ()
    return Kind(text("name"), text("category", "custom"), texts("inputs"), texts("outputs"), aliases=aliases, pauses=text("pausesForHuman"), side_effects=text("sideEffects"), label=text("label", text("name")), defaults=tuple(defaults.items()), about=about)


def kind_value(kind: Kind) -> dict:
    """The JSON form of a kind, which kind_of() reads again; what a field of its config asks for goes along."""
    out: dict = {"name": kind.name, "category": kind.category, "label": kind.label or kind.name} | dict(kind.about)
    if kind.config:
        out["configSchema"] = [{"key": f.key, "type": f.type} | ({"required": True} if f.required else {}) | ({"default": f.default} if f.default is not None else {}) for f in kind.config]
    if kind.defaults:
        out["defaultConfig"] = dict(kind.defaults)
    out |= {key: [{"id": p} for p in ports] for key, ports in (("inputs", kind.inputs), ("outputs", kind.outputs)) if ports is not None}
    named = {"aliases": list(kind.aliases), "pausesForHuman": kind.pauses, "sideEffects": kind.side_effects}
    return out | {k: v for k, v in named.items() if v}


def kind_of_manifest(manifest: object) -> Kind:
    """The kind that a package's manifest declares; ValueError with what keeps it from being taken."""
    from weftline.graph.document import manifest_issues

    bad = [i.message for i in manifest_issues(manifest) if i.severity == "error"]
    if bad:
        raise ValueError(" ".join(bad))
    return kind_of(manifest)


def config_issues(kind: Kind, config: dict) -> list[str]:
    """Required fields that are missing, repeater rows without a required cell, and texts that are no option."""
    found = []
    for f in kind.config:
        value = config.get(f.key)
        if f.required and value is None:
            found.append(f"{f.key} is required")
        elif f.type == "repeater" and isinstance(value, list):
            for i, row in enumerate(value):
                lacks = next((c.key for c in f.fields if c.required and (not isinstance(row, dict) or row.get(c.key) is None)), None)
                if lacks:
                    found.append(f"{f.key}[{i}].{lacks} is required")
                    break
        elif f.options and isinstance(value, str) and value not in f.options:
            found.append(f"{f.key} must be one of {', '.join(f.options)}")
    return found
