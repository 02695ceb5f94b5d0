"""Small gradient-boosted trees, fitted on counted patterns of whole numbers and written out as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trees, depth, learning rate, L2 on leaf values, least weight of a leaf.
TREES, DEPTH, RATE, L2, LEAF = 20, 3, 0.3, 1.0, 5.0


@dataclass(frozen=True)
class Node:
    """A split (``name < value`` goes left) or a leaf (``left`` is None)."""

    score: float = 0.0
    name: str = ""
    value: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def at(self, row: dict) -> float:
        if self.left is None:
            return self.score
        return (self.left if row[self.name] < self.value else self.right).at(row)

    def column(self) -> Column:
        if self.left is None:
            return F.lit(self.score)
        return F.when(F.col(self.name) < self.value, self.left.column()).otherwise(self.right.column())


def _tree(rows: list[dict], names: list[str], depth: int) -> Node:
    g, h = sum(r["_g"] for r in rows), sum(r["_h"] for r in rows)
    best, gain = None, 1e-6
    for name in names if depth else ():
        sums: dict[float, list[float]] = {}
        for r in rows:
            at = sums.setdefault(r[name], [0.0, 0.0, 0.0])
            at[0] += r["_g"]
            at[1] += r["_h"]
            at[2] += r["n"]
        gl = hl = nl = 0.0
        n = sum(s[2] for s in sums.values())
        values = sorted(sums)
        for low, high in zip(values, values[1:]):
            gl, hl, nl = gl + sums[low][0], hl + sums[low][1], nl + sums[low][2]
            if nl >= LEAF and n - nl >= LEAF:
                found = gl * gl / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g * g / (h + L2)
                if found > gain:
                    best, gain = (name, (low + high) / 2), found
    if best is None:
        return Node(score=-RATE * g / (h + L2))
    name, value = best
    return Node(name=name, value=value, left=_tree([r for r in rows if r[name] < value], names, depth - 1),
                right=_tree([r for r in rows if r[name] >= value], names, depth - 1))


def fit(rows: list[dict], names: list[str]) -> list[Node]:
    """Trees for patterns ``rows`` (the features, ``n`` times seen, ``y`` of them positive), by logistic loss."""
    trees: list[Node] = []
    for r in rows:
        r["_f"] = 0.0
    for _ in range(TREES if rows else 0):
        for r in rows:
            p = 1 / (1 + exp(-r["_f"]))
            r["_g"], r["_h"] = r["n"] * p - r["y"], r["n"] * p * (1 - p)
        tree = _tree(rows, names, DEPTH)
        trees.append(tree)
        for r in rows:
            r["_f"] += tree.at(r)
    return trees


def margin(trees: list[Node], row: dict) -> float:
    return sum(t.at(row) for t in trees)


def margin_column(trees: list[Node]) -> Column:
    out = F.lit(0.0)
    for tree in trees:
        out = out + tree.column()
    return out


def threshold(trees: list[Node], rows: list[dict], precision: float, least: int) -> float:
    """The lowest margin from which on ``rows`` not learned from reach a precision over at least ``least`` positives; else infinite."""
    scored = sorted(((margin(trees, r), r["n"], r["y"]) for r in rows), reverse=True)
    chosen, n, y = float("inf"), 0, 0
    for i, (at, rows_here, positive) in enumerate(scored):
        n, y = n + rows_here, y + positive
        if (i + 1 == len(scored) or scored[i + 1][0] < at) and y >= least and y >= precision * n:
            chosen = max(at - 1e-9, 0.0)  # never below an even chance; the expression may round its sum another way
    return chosen
