"""Portable limits; each is inclusive."""

from __future__ import annotations

from .errors import fail

#: Fixed values.
LIMITS = {
    "array.elements": 1_000_000,
    "ast.depth": 64,
    "ast.nodes": 4_096,
    "batch.items": 1_000,
    "command.expanded_bytes": 67_108_864,
    "command.raw_bytes": 67_108_864,
    "document.canonical_bytes": 16_777_216,
    "document.depth": 100,
    "document.total_fields": 100_000,
    "dictionary.paths": 1_000_000,
    "dictionary.snapshot_bytes": 67_108_864,
    "field_name.scalars": 256,
    "field_name.utf8_bytes": 1_024,
    "id.payload_bytes": 1_024,
    "literal_list.items": 10_000,
    "object.fields": 10_000,
    "path.candidates": 1_000_000,
    "path.segments": 100,
    "path.utf8_bytes": 4_096,
    "pipeline.stages": 256,
    "projection.paths": 10_000,
    "regex.pattern_bytes": 65_536,
    "sort.keys": 64,
    "vector.dimension": 4_096,
    "vector.top_k": 10_000,
}


def check(name: str, observed: int) -> None:
    if observed > LIMITS[name]:
        fail("QUOTA_LIMIT_EXCEEDED", f"{name}: {observed} > {LIMITS[name]}", limit=name, maximum=LIMITS[name], observed=observed)


def check_tree(node: object) -> None:
    """Nodes and depth of a command."""
    count, stack = 0, [(node, 1)]
    while stack:
        x, depth = stack.pop()
        count += 1
        check("ast.depth", depth)
        if isinstance(x, dict):
            stack += [(v, depth + 1) for v in x.values()]
        elif isinstance(x, (list, tuple)):
            stack += [(v, depth + 1) for v in x]
    check("ast.nodes", count)
