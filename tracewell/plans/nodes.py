"""The operators of a captured plan: numbers, tables, and which operator's rows feed which."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

from tracewell.plans.catalyst import Catalyst

#: Operators that end an annotation and begin another; the root does so too.
BARRIERS = {"Aggregate", "Join"}


@dataclass
class PlanNode:
    opid: int
    name: str
    node: Any = field(repr=False)
    columns: list[str]
    table: str = ""
    join_type: str = ""
    children: list[PlanNode] = field(default_factory=list)
    subqueries: list[PlanNode] = field(default_factory=list)
    materializes: bool = False
    sink_opid: int = -1
    source_opids: list[int] = field(default_factory=list)

    def walk(self):
        yield self
        for c in (*self.children, *self.subqueries):
            yield from c.walk()

    def leaves(self) -> list[PlanNode]:
        return [n for n in self.walk() if not n.children and n.table]

    def as_dict(self) -> dict:
        """The keys of the plan that provenance_meta() shows."""
        return {
            "opid": self.opid, "name": self.name, "sink_opid": self.sink_opid, "source_opids": self.source_opids, "table": self.table,
            "source_table": [n.table for n in self.walk() if n.opid in self.source_opids and n.table],
            "materializes": self.materializes, "children": [c.as_dict() for c in (*self.children, *self.subqueries)],
        }

    def to_json(self) -> str:
        return json.dumps(self.as_dict())


def table_name(cat: Catalyst, node) -> str:
    """A catalog table's name, a file source's folder or file, or the kind of an in-memory source."""
    kind = cat.kind(node)
    if kind == "LogicalRelation":
        if node.catalogTable().isDefined():
            return node.catalogTable().get().identifier().table()
        roots = cat.items(node.relation().location().rootPaths()) if hasattr(node.relation(), "location") else []
        if roots:
            name = os.path.basename(str(roots[0].toString()).rstrip("/"))
            return re.sub(r"\W", "_", re.sub(r"\.\w+$", "", name))
    return {"LocalRelation": "values", "Range": "range", "LogicalRDD": "rdd", "InMemoryRelation": "cached"}.get(kind, kind.lower())


def build(cat: Catalyst, root) -> PlanNode:
    """Operators numbered top-down in preorder from 0, with sinks and sources resolved: an operator's sink
    is its nearest ancestor that materializes (-1 above the root); a materializing operator's sources are,
    for each child, the first descendant that materializes, or the leaf."""
    count = 0

    def make(node) -> PlanNode:
        nonlocal count
        kind = cat.kind(node)
        children = cat.children(node)
        made = PlanNode(count, kind, node, [a.name() for a in cat.output(node)])
        count += 1
        if kind == "Join":
            made.join_type = cat.join_kind(node)
        if not children and kind not in ("OneRowRelation", "UnionLoopRef"):
            made.table = table_name(cat, node)
        made.children = [make(c) for c in children]
        made.subqueries = [make(p) for p in cat.scalar_subqueries(node)] if kind in ("Filter", "Project") else []
        made.materializes = kind in BARRIERS or made.opid == 0
        return made

    def resolve(n: PlanNode, sink: int) -> None:
        n.sink_opid = sink
        below = n.opid if n.materializes else sink
        for c in (*n.children, *n.subqueries):
            resolve(c, below)
        if n.materializes:
            n.source_opids = [source(c).opid for c in (*n.children, *n.subqueries)]

    def source(n: PlanNode) -> PlanNode:
        while not n.materializes and n.children:
            n = n.children[0]
        return n

    root_node = make(root)
    resolve(root_node, -1)
    return root_node
