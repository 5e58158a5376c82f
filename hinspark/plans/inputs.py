"""Which metapaths a model of precomputed features reads, and in what order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from ..types import Aliases, MetaGraph, Metapath, self_loop


def feature_paths(meta: MetaGraph, target: str, max_hops: int) -> list[Metapath]:
    """All metapaths of at most max_hops edges to the target; without an edge, its own features."""
    return meta.metapaths(max_hops, target)


def label_paths(meta: MetaGraph, target: str, max_hops: int) -> list[Metapath]:
    """Metapaths of one to max_hops edges from the target back to it."""
    return [p for p in meta.metapaths(max_hops, target) if p[0].src == target and len(p) > 1]


def named_paths(meta: MetaGraph, target: str, names: Iterable[str]) -> dict[str, Metapath]:
    """Metapaths of a list of short names, the target's own first; one that doesn't end at the target is an error."""
    aliases = Aliases(meta)
    found = {aliases.of[target]: (self_loop(target),)}
    for name in names:
        path = aliases.canonical(name)
        if path[-1].dst != target:
            raise ValueError(f"{name} ends at {path[-1].dst}, not at {target}")
        found[name] = path
    return found


def path_widths(paths: Mapping[str, Metapath], slots: Mapping[str, Mapping[str, int]]) -> dict[str, int]:
    """Columns of each metapath's block: those of all slots that its source has, side by side."""
    return {name: sum(slots[path[0].src].values()) for name, path in paths.items()}


def unlike(widths: Mapping[str, int], common: int | None = None) -> list[str]:
    """The metapaths whose blocks need a matrix of their own to come to the common width (the largest, if none is given)."""
    common = max(widths.values()) if common is None else common
    return [name for name, n in widths.items() if n != common]
