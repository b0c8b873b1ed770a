"""Names and fixed values of the property graph."""

from __future__ import annotations

#: Kinds of nodes by their short form in qualified names (path::kind::name). Fixed values.
NODE_KINDS = {"fn": "function", "const": "constant"}
#: Weight of an edge kind in impact propagation. Fixed values.
EDGE_WEIGHTS = {"calls": 3.0, "references": 2.5, "extends": 2.5, "implements": 2.5, "imports": 2.0, "tests": 1.5, "contains": 1.0, "defines": 1.0, "tested_by": 1.5}
CALLABLE = ("function", "method", "test")
#: Edge kinds that count as a use of their target.
REFERENCE_KINDS = ("calls", "references", "imports", "extends", "implements")
