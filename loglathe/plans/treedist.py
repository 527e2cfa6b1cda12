"""Edit distance between summary trees, with the edits that reach it.

Roots correspond for free; below them the distance is that of two ordered forests under insertion,
deletion and change of nodes, found by dynamic programming over key roots (Zhang and Shasha 1989).
"""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.summary import SummaryNode

# The costs of edits.
CREATE, DELETE, CLASH, SAME = 1000.0, 1000.0, 10000.0, 0.5


def change_cost(a: SummaryNode, b: SummaryNode) -> float:
    """Of nodes of one kind 0.5, of ints the distance of their means; of different kinds 10,000."""
    if a.kind != b.kind:
        return CLASH
    if a.kind == "int" and a.mean is not None and b.mean is not None:
        return abs(a.mean - b.mean)
    return SAME


@dataclass(frozen=True)
class Op:
    """TRANSFORM source to target, CREATE target or DELETE source; paths of the nodes."""

    op: str
    source: str = ""
    target: str = ""


@dataclass(frozen=True)
class Mapping:
    distance: float
    ops: tuple[Op, ...]


class _Tree:
    """A node's descendants in postorder: the nodes, their paths and their leftmost leaves."""

    def __init__(self, root: SummaryNode):
        self.nodes: list[SummaryNode] = []
        self.paths: list[str] = []
        self.left: list[int] = []

        def visit(n: SummaryNode, path: str) -> int:
            first = -1
            for c in n.matched():
                x = visit(c, f"{path}.{c.name}")
                first = x if first < 0 else first
            self.nodes.append(n)
            self.paths.append(path)
            me = len(self.nodes) - 1
            self.left.append(me if first < 0 else first)
            return self.left[-1]

        visit(root, root.name)
        last = {v: i for i, v in enumerate(self.left)}
        self.keys = sorted(last.values())


def _forests(a: _Tree, b: _Tree, i: int, j: int, tree: dict[tuple[int, int], float]) -> list[list[float]]:
    """Distances of all prefixes of the forests under i and j, given those of smaller trees."""
    li, lj = a.left[i], b.left[j]
    d = [[0.0] * (j - lj + 2) for _ in range(i - li + 2)]
    for x in range(1, len(d)):
        d[x][0] = d[x - 1][0] + DELETE
    for y in range(1, len(d[0])):
        d[0][y] = d[0][y - 1] + CREATE
    for x in range(1, len(d)):
        for y in range(1, len(d[0])):
            p, q = li + x - 1, lj + y - 1
            if a.left[p] == li and b.left[q] == lj:
                third = d[x - 1][y - 1] + _pair(a, b, p, q)
            else:
                third = d[a.left[p] - li][b.left[q] - lj] + tree[p, q]
            d[x][y] = min(d[x - 1][y] + DELETE, d[x][y - 1] + CREATE, third)
            if a.left[p] == li and b.left[q] == lj:
                tree[p, q] = d[x][y]
    return d


def _pair(a: _Tree, b: _Tree, p: int, q: int) -> float:
    """Cost of changing p to q; the roots, last in postorder, correspond for free and to each other only."""
    roots = (p == len(a.nodes) - 1) + (q == len(b.nodes) - 1)
    return 0.0 if roots == 2 else float("inf") if roots else change_cost(a.nodes[p], b.nodes[q])


def _script(a: _Tree, b: _Tree, tree: dict[tuple[int, int], float]) -> list[Op]:
    ops: list[Op] = []
    todo = [(len(a.nodes) - 1, len(b.nodes) - 1)]
    while todo:
        i, j = todo.pop()
        d = _forests(a, b, i, j, dict(tree))
        x, y = len(d) - 1, len(d[0]) - 1
        li, lj = a.left[i], b.left[j]
        while x or y:
            p, q = li + x - 1, lj + y - 1
            whole = x and y and a.left[p] == li and b.left[q] == lj
            if whole and d[x][y] == d[x - 1][y - 1] + _pair(a, b, p, q):
                ops.append(Op("TRANSFORM", a.paths[p], b.paths[q]))
                x, y = x - 1, y - 1
            elif x and y and not whole and d[x][y] == d[a.left[p] - li][b.left[q] - lj] + tree[p, q]:
                todo.append((p, q))
                x, y = a.left[p] - li, b.left[q] - lj
            elif x and d[x][y] == d[x - 1][y] + DELETE:
                ops.append(Op("DELETE", a.paths[p]))
                x -= 1
            else:
                ops.append(Op("CREATE", target=b.paths[q]))
                y -= 1
    return ops


def best_mapping(source: SummaryNode, target: SummaryNode) -> Mapping:
    a, b = _Tree(source), _Tree(target)
    tree: dict[tuple[int, int], float] = {}
    for i in a.keys:
        for j in b.keys:
            _forests(a, b, i, j, tree)
    distance = tree[len(a.nodes) - 1, len(b.nodes) - 1]
    return Mapping(distance, tuple(sorted(_script(a, b, tree), key=lambda o: (o.source or "~", o.target))))
