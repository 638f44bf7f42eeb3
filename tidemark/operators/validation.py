"""Checks of a graph's partition definitions and mappings, before anything runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from tidemark.operators.partitions import Multi, Static, TimeWindow

Definition = Static | TimeWindow | Multi | None


@dataclass(frozen=True)
class Edge:
    """``mapping``: identity, all, static, window, multi, multi_to_single, specific, for_keys or subset; None is not given."""

    downstream: str
    upstream: str
    mapping: str | None = None
    dimensions: tuple[tuple[str, str], ...] = ()
    keys: tuple[str, ...] = ()


class MappingError(ValueError):
    """An edge whose mapping can't connect the definitions at its ends."""


def compatible_grids(a: TimeWindow, b: TimeWindow) -> str | None:
    """Why two grids can't map window to window, or None."""
    if (a.every, a.cron) != (b.every, b.cron):
        return "their windows differ in length"
    if a.fmt != b.fmt:
        return "their key formats differ"
    if a.every is not None and (a.start - b.start) % a.every:
        return "their windows start at different offsets"
    return None


def check_edge(edge: Edge, down: Definition, up: Definition) -> None:
    """Raise if the mapping doesn't fit; without one, equal definitions map by identity."""

    def fail(why: str) -> None:
        raise MappingError(f"{edge.downstream} <- {edge.upstream}: {why}")

    kind = edge.mapping or "identity"
    if up is None:
        if edge.mapping is not None:
            fail("a mapping to an asset without partitions")
        return
    if down is None:
        if edge.mapping not in ("all", "specific"):
            fail("an asset without partitions must say which partitions it reads")
        return
    if kind in ("identity", "window"):
        if type(down) is not type(up):
            fail(f"{kind} between {type(down).__name__} and {type(up).__name__}")
        if isinstance(down, TimeWindow) and isinstance(up, TimeWindow) and (why := compatible_grids(down, up)):
            fail(why)
        if kind == "window" and not isinstance(down, TimeWindow):
            fail("a window offset needs time windows")
        if isinstance(down, Static) and isinstance(up, Static) and (extra := sorted(set(down.keys) - set(up.keys))):
            fail(f"keys the upstream lacks: {extra}")
        if isinstance(down, Multi) and isinstance(up, Multi) and set(down.dimensions) != set(up.dimensions):
            fail("their dimensions differ")
    elif kind == "multi":
        if not isinstance(down, Multi) or not isinstance(up, Multi):
            fail("a mapping by dimension needs dimensions on both sides")
        else:
            for a, b in edge.dimensions:
                if a not in down.dimensions or b not in up.dimensions:
                    fail(f"no dimension {a} or {b}")
                check_edge(Edge(f"{edge.downstream}.{a}", f"{edge.upstream}.{b}"), down.dimensions[a], up.dimensions[b])
    elif kind == "multi_to_single":
        whole, single = (down, up) if isinstance(down, Multi) else (up, down)
        if not isinstance(whole, Multi) or isinstance(single, Multi):
            fail("one side must have dimensions and the other none")
        elif edge.dimensions and edge.dimensions[0][0] not in whole.dimensions:
            fail(f"no dimension {edge.dimensions[0][0]}")
    elif kind == "specific" and isinstance(up, Static) and (unknown := sorted(set(edge.keys) - set(up.keys))):
        fail(f"keys the upstream lacks: {unknown}")
    elif kind not in ("all", "static", "specific", "for_keys", "subset"):
        fail(f"unknown mapping {kind!r}")


def check_graph(edges: list[Edge], definitions: Mapping[str, Definition]) -> list[str]:
    """The complaints about all edges, empty if they fit."""
    found = []
    for edge in edges:
        try:
            check_edge(edge, definitions.get(edge.downstream), definitions.get(edge.upstream))
        except MappingError as error:
            found.append(str(error))
    return found
