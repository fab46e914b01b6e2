"""Workflow graphs as DataFrame plans."""

from importlib import import_module

_WHERE = {
    "weftline.plans.compiled": ("Host", "Run", "compile_graph", "with_stored"),
    "weftline.graph.document": ("Edge", "Graph", "Imported", "Issue", "Node", "Policy", "Port", "export_document", "export_json", "import_document", "import_json", "manifest_issues", "possible_ports"),
    "weftline.graph.kinds": ("Field", "Kind", "Registry", "built_in"),
    "weftline.operators.nodes": ("OPERATORS", "Step"),
    "weftline.operators.durable": ("Coordinator", "RetryPolicy", "claimed", "dispatched", "frontier", "submitted"),
    "weftline.operators.host": ("from_pandas",),
    "weftline.operators.search": ("nearest",),
    "weftline.functions.scalars": ("decoded_pause", "encoded_pause", "is_replay_safe", "number_text", "satisfies_range", "step_key"),
    "weftline.streaming.gates": ("claim_batches", "gated", "streamed"),
}
_FROM = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_FROM)


def __getattr__(name: str):
    if name in _FROM:
        return getattr(import_module(_FROM[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
