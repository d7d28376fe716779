"""The dynamic programs on trees, on numpy arrays. Trees are parent arrays with parents first; weights are matrices (nodes of G, nodes of H)."""

from __future__ import annotations

import numpy as np


def depths(parent: np.ndarray) -> np.ndarray:
    """Depths of the nodes of a tree or forest (roots -1), by doubling: in each round a node looks twice as far up."""
    jump = np.asarray(parent, np.int64)
    depth = (jump >= 0).astype(np.int64)
    while (inside := np.flatnonzero(jump >= 0)).size:
        far = jump[inside]
        depth[inside] += depth[far]
        after = jump.copy()
        after[inside] = jump[far]
        jump = after
    return depth


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """Node numbers by depth."""
    if not len(parent):
        return []
    depth = depths(parent)
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))


def heaviest_path(parent: np.ndarray, weight: np.ndarray) -> float:
    """The largest sum of weights (none below 0) from a root down: the path score of a tree with itself."""
    total = np.maximum(weight, 0.0)
    for level in levels(parent)[1:]:
        total[level] += total[parent[level]]
    return float(total.max(initial=0.0))


def forest(parents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Several trees as one parent array (roots -1), and where each begins."""
    starts = np.cumsum([0, *map(len, parents)])
    return np.concatenate([np.where(p >= 0, p + s, -1) for p, s in zip(parents, starts[:-1], strict=True)]), starts[:-1]


def contracted(parent: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept nodes alone, each below its nearest kept ancestor (-1: none), and their numbers. A chain over kept nodes is a chain of both trees."""
    nodes = np.flatnonzero(keep)
    near = np.append(np.where(keep, np.arange(len(parent)), parent), -1)
    while not np.array_equal(further := near[near], near):
        near = further
    number = np.full(len(parent) + 1, -1)
    number[nodes] = np.arange(len(nodes))
    return number[near[parent[nodes]]], nodes


def path_scores(g: np.ndarray, h: np.ndarray, starts: np.ndarray, weight: np.ndarray, rows: list[np.ndarray] | None = None) -> np.ndarray:
    """The best nested chain of pairs of G and each tree of the forest H: all cells of a depth of G and a depth of H at once.

    ``rows`` are the levels of H, for callers that score many trees against one forest.
    """
    table = path_table(g, h, weight, rows)
    return np.maximum.reduceat(table[:, 1:].max(axis=0), starts)


class Columns:
    """The trees that others are scored against, side by side with their nodes in order of depth: a depth is a slice of columns."""

    def __init__(self, parents: list[np.ndarray]):
        h, self.starts = forest(parents) if parents else (np.empty(0, np.int64), np.empty(0, np.int64))
        rows = levels(h)
        #: The nodes in order of depth, and where each node is.
        self.order = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.place = np.empty(len(h), np.int64)
        self.place[self.order] = np.arange(len(h))
        self.above = np.concatenate(([0], self.place + 1))[h[self.order] + 1]
        ends = np.cumsum([0, *map(len, rows)])
        self.slices = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def __len__(self) -> int:
        return len(self.order)


def forest_scores(trees: list[tuple[np.ndarray, list]], columns: Columns, weigh, cells: int = 2_000_000) -> np.ndarray:
    """Scores of ``trees`` (parents, labels) with each tree of ``columns``: (trees, trees of columns).

    ``weigh`` gives the weights of some labels with the columns, in their order. Trees are taken together, a depth of all of them and a depth of the columns at a
    time, as long as the table has at most ``cells`` cells; a tree whose own table has more is walked in parts.
    """
    out, start = np.zeros((len(trees), len(columns.starts))), 0
    while start < len(trees) and len(columns):
        end, size = start + 1, len(trees[start][0])
        while end < len(trees) and (size + len(trees[end][0])) * len(columns) <= cells:
            size += len(trees[end][0])
            end += 1
        if size * len(columns) > cells:
            row = _walked_scores(*trees[start], columns, weigh, cells)
            out[start], start = np.maximum.reduceat(row[columns.place], columns.starts), end
            continue
        g, starts = forest([p for p, _ in trees[start:end]])
        weight = weigh([t for _, labels in trees[start:end] for t in labels])
        table = np.zeros((len(g) + 1, len(columns) + 1))
        for now in levels(g):
            up = table[g[now] + 1]
            best = np.maximum(up[:, 1:], weight[now] + up[:, columns.above])
            for level in columns.slices[1:]:
                part = best[:, level]
                np.maximum(part, best[:, columns.above[level] - 1], out=part)
            table[now + 1, 1:] = best
        rows = np.maximum.reduceat(table[1:, 1:], starts, axis=0)
        out[start:end] = np.maximum.reduceat(rows[:, columns.place], columns.starts, axis=1)
        start = end
    return out


def _walked_scores(parent: np.ndarray, labels: list, columns: Columns, weigh, cells: int) -> np.ndarray:
    """The best chain that ends at or above each of the columns, for one tree that has too many nodes for a table.

    The tree is walked from the root, some siblings at a time and deepest first, so only the rows between the current nodes and the root are held.
    """
    order = np.argsort(parent, kind="stable")
    above, depth = parent[order], len(levels(parent))
    many, best = max(1, cells // (len(columns) * depth)), np.zeros(len(columns))
    roots = order[above < 0]
    waiting = [(roots, np.zeros((1, len(columns) + 1)), np.zeros(len(roots), np.int64))]
    while waiting:
        nodes, rows, at = waiting.pop()
        if len(nodes) > many:
            waiting.append((nodes[many:], rows, at[many:]))
            nodes, at = nodes[:many], at[:many]
        up = rows[at]
        now = np.zeros_like(up)
        now[:, 1:] = np.maximum(up[:, 1:], weigh([labels[u] for u in nodes]) + up[:, columns.above])
        for level in columns.slices[1:]:
            part = now[:, 1:][:, level]
            np.maximum(part, now[:, columns.above[level]], out=part)
        np.maximum(best, now[:, 1:].max(axis=0), out=best)
        first, last = np.searchsorted(above, nodes), np.searchsorted(above, nodes, side="right")
        below = np.repeat(np.arange(len(nodes)), last - first)
        if len(below):
            kids = order[np.arange(len(below)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[below]]
            waiting.append((kids, now, below))
    return best


#: The words that hold a path from a root to a leaf, a bit a node.
WORDS = ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64))


def unit_scores(g: np.ndarray, trees_g: np.ndarray, codes: np.ndarray, sets: list[np.ndarray], h: np.ndarray, trees_h: np.ndarray, nodes: np.ndarray, keys: np.ndarray, n_keys: int, shape: tuple[int, int], cells: int = 2_500_000, marked: int = 8_000_000) -> np.ndarray:
    """Path scores where nodes with a common key weigh 1 and others 0: (trees of G, trees of H), ``shape``.

    G and H are forests, ``trees_g`` and ``trees_h`` their nodes' trees in rising order; a node of G has the keys ``sets[code]``, and H has the rows (``nodes``, ``keys``), each once. No path of H may have over 64 nodes.
    Such a score is a longest common subsequence of two paths: each path of H to a leaf is a word, and a node of G takes the words of its parent on by one addition (Hyyrö's LCS), so a step covers many nodes
    of G and many paths of H. ``cells`` words are taken at a time, and ``marked`` words say where keys occur.
    """
    best = np.zeros(shape, np.uint8)
    if not len(g) or not len(h) or not n_keys:
        return best.astype(float)
    rows, rank, is_leaf = levels(g), np.empty(len(g), np.int64), np.ones(len(g), bool)
    for level in rows:
        rank[level] = np.arange(len(level))
    is_leaf[g[g >= 0]] = False
    leaves = np.concatenate(([0], np.cumsum(is_leaf)))
    own, firsts = np.unique(trees_g, return_index=True)
    edges = np.append(firsts, len(g))
    depth, ends = depths(h), np.ones(len(h), bool)
    ends[h[h >= 0]] = False
    order = np.argsort(nodes, kind="stable")
    held, first = keys[order], np.searchsorted(nodes[order], np.arange(len(h) + 1))
    longest = max(map(len, sets))
    padded = np.array([[*s, *[n_keys] * (longest - len(s))] for s in sets], np.int64).reshape(len(sets), longest)
    low = 0
    for bits, word in WORDS:
        paths = np.flatnonzero(ends & (depth >= low) & (depth < bits))
        low, many = bits, max(1, marked // max(n_keys + 1, len(sets)))
        for start in range(0, len(paths), many):
            some = paths[start : start + many]
            marks, at, now = np.zeros((n_keys + 1, len(some)), word), np.arange(len(some)), some
            while len(now):  # up all paths at once: a node's keys get its bit
                count = first[now + 1] - first[now]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[now], count)
                marks[held[place], np.repeat(at, count)] |= np.repeat(word(1) << depth[now].astype(word), count)
                on = h[now] >= 0
                at, now = at[on], h[now[on]]
            masks = marks[padded[:, 0]] if longest else np.zeros((len(sets), len(some)), word)
            for k in range(1, longest):
                masks |= marks[padded[:, k]]
            columns, cuts = np.unique(trees_h[some], return_index=True)
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + cells // len(some), "right")) - 1)
                lo, hi = edges[a], edges[b]
                counts, before, above = np.empty((leaves[hi] - leaves[lo], len(some)), np.uint8), 0, None
                for level in rows:
                    i, j = np.searchsorted(level, (lo, hi))
                    if i == j:
                        break
                    taken = level[i:j]
                    words = np.full((j - i, len(some)), ~word(0)) if above is None else above[rank[g[taken]] - before]
                    hit = masks[codes[taken]]
                    hit &= words
                    carried = words + hit
                    words ^= hit
                    words |= carried
                    done = is_leaf[taken]
                    if done.any():
                        counts[leaves[taken[done]] - leaves[lo]] = np.bitwise_count(~words[done])
                    above, before = words, i
                found = np.maximum.reduceat(np.maximum.reduceat(counts, leaves[edges[a:b]] - leaves[lo], axis=0), cuts, axis=1)
                at_best = np.ix_(own[a:b], columns)
                best[at_best] = np.maximum(best[at_best], found)
                a = b
    return best.astype(float)


def path_table(g: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: list[np.ndarray] | None = None) -> np.ndarray:
    """Best chain that ends at or above each pair of nodes; row and column 0 stand for nothing above the roots."""
    table = np.zeros((len(g) + 1, len(h) + 1))
    above, rows = h + 1, levels(h) if rows is None else rows
    for now in levels(g):
        up = table[g[now] + 1]
        best = np.concatenate([np.zeros((len(now), 1)), np.maximum(up[:, 1:], weight[now] + up[:, above])], axis=1)
        for level in rows:
            best[:, level + 1] = np.maximum(best[:, level + 1], best[:, above[level]])
        table[now + 1] = best
    return table


def path_matches(g: np.ndarray, h: np.ndarray, starts: np.ndarray, weight: np.ndarray, prefer_match: bool = True, only_positive: bool = True, rows: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores and pairs (node of G, node of the forest H) for each tree of the forest.

    The chains of all trees are traced back at once, a step at a time; a step compares a cell with the three it may come from, so no table of choices is
    kept. Ties: match, then leaving v, then leaving u; reversed unless ``prefer_match``. The end is the first best cell by u, then v.
    """
    if not len(g) or not len(starts):
        return np.zeros(len(starts)), [[] for _ in starts]
    table, ends = path_table(g, h, weight, rows), np.append(starts[1:], len(h))
    by_row = np.maximum.reduceat(table[1:, 1:], starts, axis=1)
    u, scores = by_row.argmax(axis=0), by_row.max(axis=0)
    v = np.array([s + int(table[a + 1, s + 1 : e + 1].argmax()) for a, s, e in zip(u, starts, ends, strict=True)])
    u, v, pairs, trees = u + 1, v + 1, [[] for _ in starts], np.arange(len(starts))
    while len(trees):
        up, left = g[u - 1] + 1, h[v - 1] + 1
        here, w = table[u, v], weight[u - 1, v - 1]
        match, skip_u, skip_v = w + table[up, left] == here, table[up, v] == here, table[u, left] == here
        matched = match if prefer_match else match & ~skip_u & ~skip_v
        leave_v = ~matched & (skip_v if prefer_match else skip_v & ~skip_u)
        for i in np.flatnonzero(matched & (w > 0) if only_positive else matched):
            pairs[trees[i]].append((int(u[i]) - 1, int(v[i]) - 1))
        u, v = np.where(leave_v, u, up), np.where(matched | leave_v, left, v)
        on = (u > 0) & (v > 0)
        u, v, trees = u[on], v[on], trees[on]
    return scores, [p[::-1] for p in pairs]


def path_pairs(g: np.ndarray, h: np.ndarray, weight: np.ndarray, prefer_match: bool = True, only_positive: bool = False) -> tuple[float, list[tuple[int, int]]]:
    """The score and the pairs of the best chain. Ties: match, then leaving v, then leaving u; reversed unless ``prefer_match``."""
    scores, pairs = path_matches(g, h, np.zeros(1, np.int64), weight, prefer_match, only_positive)
    return float(scores[0]), pairs[0]


def chain_over(tin_u: np.ndarray, tout_u: np.ndarray, tin_v: np.ndarray, tout_v: np.ndarray, w: np.ndarray) -> tuple[float, list[int]]:
    """The heaviest chain of the given node pairs, each strictly below the one before in both trees: its weight and the pairs' numbers.

    Pairs are taken in preorder of G. ``below`` holds, for each place of H that a pair has, the best chain that ends at a pair whose G node is above
    the current one and whose H node is above the place; a pair raises it on its own interval of places, and when the walk leaves its G node the interval gets its
    former values back. No table of all nodes is made. Ties keep the pair that comes first by (tin_u, tin_v).
    """
    usable = np.flatnonzero(w > 0)
    order = usable[np.lexsort((tin_v[usable], tin_u[usable]))]
    if not len(order):
        return 0.0, []
    places = np.unique(tin_v[order])
    at, low, high = (np.searchsorted(places, x[order], side) for x, side in ((tin_v, "left"), (tin_v, "right"), (tout_v, "left")))
    below, by = np.zeros(len(places)), np.full(len(places), -1)
    total, before = np.empty(len(order)), np.empty(len(order), np.int64)
    starts, weights, enters, leaves, open_nodes = tin_u[order], w[order], tin_u[order], tout_u[order], []
    edges = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        while open_nodes and open_nodes[-1][0] <= enters[a]:
            for lo, hi, values, owners in reversed(open_nodes.pop()[1]):
                below[lo:hi], by[lo:hi] = values, owners
        total[a:b], before[a:b] = weights[a:b] + below[at[a:b]], by[at[a:b]]
        undo = []
        for i in range(a, b):  # the pairs of one G node can't follow each other
            lo, hi = low[i], high[i]
            if lo < hi:
                better = below[lo:hi] < total[i]
                if better.any():
                    undo.append((lo, hi, below[lo:hi].copy(), by[lo:hi].copy()))
                    below[lo:hi][better], by[lo:hi][better] = total[i], i
        if undo:
            open_nodes.append((leaves[a], undo))
    end, chain = int(np.argmax(total)), []
    i = end
    while i >= 0:
        chain.append(int(order[i]))
        i = int(before[i])
    return float(total[end]), chain[::-1]


def template_repeat(g: np.ndarray, h: np.ndarray, weight: np.ndarray, penalty: float = 0.0) -> float:
    """Best score of G against a path H whose nodes may be used again, in order; each further use costs ``penalty``."""
    return template_matches(g, h, weight, penalty)[0]


def template_matches(g: np.ndarray, h: np.ndarray, weight: np.ndarray, penalty: float = 0.0) -> tuple[float, list[tuple[int, int]]]:
    """The score and the pairs of G against a path H whose nodes may be used again. Ties: a further use, then a first use, then leaving u; the end is the first best cell by u, then v."""
    if not np.array_equal(h, np.arange(-1, len(h) - 1)):
        raise ValueError("the template has to be a path")
    first, again = np.zeros((len(g) + 1, len(h) + 1)), np.full((len(g) + 1, len(h) + 1), -np.inf)
    for now in levels(g):
        up = g[now] + 1
        take = np.maximum(weight[now] + first[up, :-1], weight[now] - penalty + again[up, 1:])
        again[now + 1, 1:] = np.maximum(again[up, 1:], take)
        first[now + 1, 1:] = np.maximum.accumulate(np.maximum(first[up, 1:], again[now + 1, 1:]), axis=1)
    if not len(g) or not len(h) or first[1:, 1:].max() <= 0:
        return 0.0, []
    u, v = (int(x) + 1 for x in np.unravel_index(np.argmax(first[1:, 1:]), (len(g), len(h))))
    score, used, pairs = float(first[u, v]), False, []
    while u and v:
        up = int(g[u - 1]) + 1
        if not used:  # the best prefix of the template that ends at v or before it
            if first[u, v] == again[u, v]:
                used = True
            elif first[u, v] == first[u, v - 1]:
                v -= 1
            else:
                u = up
            continue
        w = weight[u - 1, v - 1]
        if again[u, v] == w - penalty + again[up, v]:
            pairs.append((u - 1, v - 1))
        elif again[u, v] == w + first[up, v - 1]:
            pairs.append((u - 1, v - 1))
            used, v = False, v - 1
        u = up
    return score, pairs[::-1]


def ordered_subtree(g: np.ndarray, h: np.ndarray, weight: np.ndarray) -> float:
    """Best ordered embedding from the roots: a pair's weight and the best order-preserving matching of the children, or going down on one side."""
    return float(subtree_table(g, h, weight)[0, 0]) if weight.size else 0.0


def unordered_subtree(g: np.ndarray, h: np.ndarray, weight: np.ndarray) -> float:
    """The same with the children's order ignored: a maximum-weight assignment."""
    return float(subtree_table(g, h, weight, ordered=False)[0, 0]) if weight.size else 0.0


def children(parent: np.ndarray, rank: np.ndarray | None = None) -> list[np.ndarray]:
    """Each node's children, by ``rank`` and then by number."""
    rank = np.arange(len(parent)) if rank is None else rank
    order = np.lexsort((np.arange(len(parent)), rank, parent))
    starts = np.searchsorted(parent[order], np.arange(len(parent) + 1))
    return [order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def heights(parent: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parent), np.int64)
    for level in reversed(levels(parent)):
        below = level[parent[level] >= 0]
        np.maximum.at(out, parent[below], out[below] + 1)
    return out


#: The children of the smaller side up to which their assignment goes over all subsets at once; above, by augmenting paths.
SUBSETS = 6


def subtree_table(g: np.ndarray, h: np.ndarray, weight: np.ndarray, ordered: bool = True, ranks: tuple = (None, None)) -> np.ndarray:
    """The best embeddings of all subtrees of G and H, by node and node: (n, m).

    Nodes are taken by height, and of one height those with as many children together: a block of G's nodes and a block of H's share every step. ``ranks`` order
    the children (timestamps, say); without them their numbers do.
    """
    kids, sides = [children(g, ranks[0]), children(h, ranks[1])], []
    for parent, own in zip((g, h), kids, strict=True):
        height, blocks = heights(parent), {}
        for u in range(len(parent)):
            blocks.setdefault((height[u], len(own[u])), []).append(u)
        sides.append([(np.array(nodes), np.array([own[u] for u in nodes]).reshape(len(nodes), -1)) for _, nodes in sorted(blocks.items())])
    table = np.zeros((len(g), len(h)))
    for us, below_u in sides[0]:
        deeper = table[below_u].max(axis=1) if below_u.size else np.full((len(us), len(h)), -np.inf)  # u left out
        for vs, below_v in sides[1]:
            best = weight[np.ix_(us, vs)].astype(float)
            if below_u.size and below_v.size:
                problems = table[below_u[:, None, :, None].astype(int), below_v[None, :, None, :].astype(int)]
                best = best + (_best_chains(problems) if ordered else _best_assignments(problems))
            best = np.maximum(best, deeper[:, vs])
            if below_v.size:
                best = np.maximum(best, table[us[:, None, None], below_v[None, :, :]].max(axis=2))
            table[np.ix_(us, vs)] = best
    return table


def _best_chains(problems: np.ndarray) -> np.ndarray:
    """Heaviest order-preserving matchings; problems are (..., rows, columns)."""
    row = np.zeros((*problems.shape[:-2], problems.shape[-1] + 1))
    for i in range(problems.shape[-2]):
        taken = np.concatenate([np.zeros((*row.shape[:-1], 1)), row[..., :-1] + problems[..., i, :]], axis=-1)
        row = np.maximum.accumulate(np.maximum(row, taken), axis=-1)
    return row[..., -1]


def _best_assignments(problems: np.ndarray) -> np.ndarray:
    """Heaviest matchings without order."""
    if problems.shape[-2] < problems.shape[-1]:
        problems = problems.swapaxes(-1, -2)
    long, short = problems.shape[-2:]
    if short > SUBSETS:
        flat = problems.reshape(-1, long, short)
        return np.array([assignment(p)[0] for p in flat]).reshape(problems.shape[:-2])
    masks = np.arange(1 << short)
    best = np.zeros((*problems.shape[:-2], 1 << short))
    for i in range(long):
        now = best.copy()
        for j in range(short):
            with_j = masks[masks >> j & 1 == 1]
            now[..., with_j] = np.maximum(now[..., with_j], best[..., with_j ^ (1 << j)] + problems[..., i, j, None])
        best = now
    return best[..., -1]


def _chain_pairs(table: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a heaviest order-preserving matching; ties take the pair, then leave the column."""
    n, m = table.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        best[i + 1] = np.maximum.accumulate(np.maximum(best[i], np.concatenate(([0.0], best[i, :-1] + table[i]))))
    i, j, pairs = n, m, []
    while i and j:
        if best[i, j] == best[i - 1, j - 1] + table[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i -= 1
    return pairs[::-1]


def subtree_matches(g: np.ndarray, h: np.ndarray, weight: np.ndarray, roots: list[tuple[int, int]], ordered: bool = True, ranks: tuple = (None, None)) -> list[tuple[float, list[tuple[int, int]]]]:
    """The score and the pairs for each of the ``roots`` (u, v), from one table. A pair whose children are matched belongs to the result even if it weighs
    nothing; ties: a pair at both roots, then leaving u, then leaving v."""
    if not weight.size:
        return [(0.0, []) for _ in roots]
    table, kids, out = subtree_table(g, h, weight, ordered, ranks), (children(g, ranks[0]), children(h, ranks[1])), []
    for root in roots:
        open_pairs, pairs = [root], []
        while open_pairs:
            u, v = open_pairs.pop()
            a, b = kids[0][u], kids[1][v]
            own = table[np.ix_(a, b)]
            inner = [] if not own.size else _chain_pairs(own) if ordered else assignment(own)[1]
            if np.isclose(table[u, v], weight[u, v] + sum(own[i, j] for i, j in inner), rtol=1e-12, atol=1e-9):
                pairs.append((u, v))
                open_pairs += [(int(a[i]), int(b[j])) for i, j in inner]
            elif len(a) and table[a, v].max() == table[u, v]:
                open_pairs.append((int(a[table[a, v].argmax()]), v))
            else:
                open_pairs.append((u, int(b[table[u, b].argmax()])))
        out.append((float(table[root]), sorted(pairs)))
    return out


def assignment(weight: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Maximum-weight matching of rows and columns, where staying single costs nothing (shortest augmenting paths)."""
    n, m = weight.shape
    if n > m:
        total, pairs = assignment(weight.T)
        return total, [(a, b) for b, a in pairs]
    cost = np.concatenate([-np.maximum(weight, 0), np.zeros((n, n))], axis=1)
    m += n
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m - n + 1) if match[j] and weight[match[j] - 1, j - 1] > 0]
    return float(sum(weight[a, b] for a, b in pairs)), sorted(pairs)


def weighted_reference(parent: np.ndarray, labels: list[list[tuple[object, float | None]]], reference: list, weights: list[float], combine="add", rule=None) -> float:
    """Best path of a tree against a weighted symbol list; per label only the first fitting place from j on is tried."""
    if rule is None and len(parent):  # nodes and places that fit nothing are left out first
        heads = {h for node in labels for a, _ in node for h in (a, a[:1] if isinstance(a, str) else a)}
        places = [i for i, r in enumerate(reference) if r in heads]
        reference, weights = [reference[i] for i in places], [weights[i] for i in places]
        known = set(reference)
        keep = np.array([any(a in known or (isinstance(a, str) and a[:1] in known) for a, _ in node) for node in labels], bool) | (np.asarray(parent) < 0)
        parent, nodes = contracted(np.asarray(parent), keep)
        labels = [labels[u] for u in nodes]
    return reference_matches(parent, labels, reference, weights, combine, rule)[0]


COMBINED = {"add": lambda r, w: r + w, "min": min, "multiply": lambda r, w: r * w}


def reference_matches(
    parent: np.ndarray, labels: list[list[tuple[object, float | None]]], reference: list, weights: list[float], combine="add", rule=None, every_place: bool = False
) -> tuple[float, list[tuple[int, int, int]]]:
    """The score and (node, place, label's number) along the best path from the root, skipped nodes left out.

    ``combine`` is a name or a function of both weights. With ``every_place`` a label may take any fitting place from j on and places may be left out on their own; else
    it takes the first one. Ties keep what comes first: ending, going down without a match, then labels and places in order.
    """
    rule, join = rule or (lambda a, r: a == r or (isinstance(a, str) and a[:1] == r)), COMBINED.get(combine, combine)
    k, kids = len(reference), [[] for _ in parent]
    if not k or not len(parent):
        return 0.0, []
    for u in range(1, len(parent)):
        kids[parent[u]].append(u)
    best, fits = np.zeros((len(parent), k + 1)), {}
    step: list[list] = [[None] * (k + 1) for _ in parent]  # (next node, next place, place taken, label)
    for u in range(len(parent) - 1, -1, -1):
        under = best[kids[u]] if kids[u] else np.zeros((1, k + 1))
        below, child = under.max(axis=0), [kids[u][c] for c in under.argmax(axis=0)] if kids[u] else [None] * (k + 1)
        for label, _ in labels[u]:
            if label not in fits:
                fits[label] = [i for i in range(k) if rule(label, reference[i])]
        for j in range(k - 1, -1, -1):
            top, how = 0.0, None
            if below[j] > top:
                top, how = below[j], (child[j], j, None, None)
            if every_place and best[u, j + 1] > top:
                top, how = best[u, j + 1], (u, j + 1, None, None)
            for number, (label, w) in enumerate(labels[u]):
                places = [i for i in fits[label] if i >= j]
                for i in places if every_place else places[:1]:
                    gain = join(weights[i], w or 0.0) + (below[i + 1] if kids[u] else 0.0)
                    if gain > top:
                        top, how = gain, (child[i + 1], i + 1, i, number)
            best[u, j], step[u][j] = top, how
    u, j, path = 0, 0, []
    while u is not None and j <= k and step[u][j] is not None:
        following, after, place, number = step[u][j]
        if place is not None:
            path.append((u, place, number))
        u, j = following, after
    return float(best[0, 0]), path
