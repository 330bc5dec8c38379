"""A small decision tree (Gini splits), trained on a table that fits in a list."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    share: float  # of label 1
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None  # feature <= limit
    high: Node | None = None


def gini(ones: float, total: float) -> float:
    return 2 * ones * (total - ones) / total if total else 0.0


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 12) -> Node:
    """Splits until a node is pure; of equally good splits the first feature's smallest limit wins."""
    ones, n = sum(y for _, y in rows), len(rows)
    if depth == 0 or ones in (0, n):
        return Node(ones / n if n else 0.0)
    best = None
    for feature in range(len(rows[0][0])):
        values = sorted((x[feature], y) for x, y in rows)
        left = 0
        for i in range(1, n):
            left += values[i - 1][1]
            if values[i][0] > values[i - 1][0]:
                loss = gini(left, i) + gini(ones - left, n - i)
                if best is None or loss < best[0] - 1e-12:
                    best = loss, feature, (values[i][0] + values[i - 1][0]) / 2
    if best is None or best[0] >= gini(ones, n) - 1e-12:
        return Node(ones / n)
    _, feature, limit = best
    return Node(ones / n, feature, limit, grow([r for r in rows if r[0][feature] <= limit], depth - 1), grow([r for r in rows if r[0][feature] > limit], depth - 1))


def decide(node: Node, x: tuple[float, ...]) -> float:
    while node.low is not None:
        node = node.low if x[node.feature] <= node.limit else node.high
    return node.share
