"""Tree operators: kernels over parent arrays and their DataFrame forms.

A tree of N tips has nodes 0 .. 2N-2: tips first, children before parents, the root last; its
parent is -1. Kernels take one tree at a time from Arrow batches, so trees are never
shuffled; relational forms work on exploded nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "struct<parent:int,branch_length:double,num_events:float,snp_begin:int,snp_end:int>"


class Tree:
    """One tree as arrays."""

    def __init__(self, parent, length=None, ages=None):
        self.parent = np.asarray(parent, int)
        self.size = len(self.parent)
        self.n = (self.size + 1) // 2
        self.length = np.zeros(self.size) if length is None else np.asarray(length, float)
        self.ages = np.zeros(self.n) if ages is None else np.asarray(ages, float)
        self.children: list[list[int]] = [[] for _ in range(self.size)]
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                self.children[p].append(i)
        self.root = int(np.flatnonzero(self.parent < 0)[0]) if self.size else -1

    def upward(self) -> list[int]:
        """Nodes, children before parents, whatever the labels."""
        out, todo = [], [self.root] if self.size else []
        while todo:
            v = todo.pop()
            out.append(v)
            todo += self.children[v]
        return out[::-1]

    def heights(self) -> np.ndarray:
        h = np.zeros(self.size)
        h[: self.n] = self.ages
        for v in self.upward():
            for c in self.children[v]:
                h[v] = max(h[v], h[c] + self.length[c])
        return h

    def clades(self) -> list[int]:
        """The tips below each node as bits of an integer."""
        bits = [1 << i if i < self.n else 0 for i in range(self.size)]
        for v in self.upward():
            if self.parent[v] >= 0:
                bits[self.parent[v]] |= bits[v]
        return bits

    def tip_order(self) -> list[int]:
        """Tips from left to right in a drawing: smaller child labels first."""
        out, todo = [], [self.root] if self.size else []
        while todo:
            v = todo.pop()
            if v < self.n:
                out.append(v)
            todo += sorted(self.children[v], reverse=True)
        return out

    def newick(self, scale: float = 1.0, names: list[str] | None = None, notes: list[str] | None = None) -> str:
        text: dict[int, str] = {}
        for v in self.upward():
            inner = "(" + ",".join(text.pop(c) for c in sorted(self.children[v])) + ")" if self.children[v] else (names[v] if names else str(v))
            note = f"[{notes[v]}]" if notes else ""
            text[v] = inner + note + (f":{self.length[v] * scale:.5f}" if v != self.root else "")
        return text[self.root] + ";" if self.size else ";"

    def nhx(self, properties: list[str], scale: float = 1.0) -> str:
        return self.newick(scale, notes=[f"&&NHX:S={p}" for p in properties])

    def oriented(self) -> list[int]:
        """Parents counted from 1, 0 for the root."""
        return (self.parent + 1).tolist()

    def subset(self, tips: list[int], events=None) -> tuple[Tree, np.ndarray, np.ndarray]:
        """The tree of some tips, in their order; nodes with one child give their length and events to it.

        Also the events, and the old node on top of each new branch's bottom.
        """
        events = np.zeros(self.size) if events is None else np.asarray(events, float)
        where = {t: i for i, t in enumerate(tips)}
        below: dict[int, tuple[int, float, float]] = {}  # old node -> new node, length and events so far
        parent, length, count, old = [-1] * len(tips), [0.0] * len(tips), [0.0] * len(tips), list(tips)
        for v in self.upward():
            if v < self.n:
                if v in where:
                    below[v] = (where[v], 0.0, 0.0)
                continue
            kept = [c for c in self.children[v] if c in below]
            if not kept:
                continue
            for c in kept:
                new, le, ev = below[c]
                below[c] = (new, le + self.length[c], ev + events[c])
            if len(kept) == 1:
                below[v] = below[kept[0]]
                continue
            new = len(parent)
            for c in kept:
                i, le, ev = below[c]
                parent[i], length[i], count[i] = new, le, ev
            parent.append(-1)
            length.append(0.0)
            count.append(0.0)
            old.append(v)
            below[v] = (new, 0.0, 0.0)
        return Tree(parent, length, self.ages[list(tips)]), np.array(count), np.array(old)

    def relabelled(self) -> np.ndarray:
        """New label of each node: tips keep theirs, the rest by height, so that parents come after children."""
        h = self.heights()
        depth = np.zeros(self.size, int)
        for v in self.upward():
            for c in self.children[v]:
                depth[v] = max(depth[v], depth[c] + 1)
        inner = np.arange(self.n, self.size)
        label = np.arange(self.size)
        label[inner[np.lexsort((inner, depth[inner], h[inner]))]] = inner
        return label

    def pair_times(self) -> np.ndarray:
        """Height of the youngest common ancestor of each pair of tips."""
        h, out = self.heights(), np.zeros((self.n, self.n))
        first, last, order = self.stretches()
        for v in self.upward():
            upto = first[v]
            for c in sorted(self.children[v], key=lambda c: first[c]):
                if upto > first[v]:
                    a, b = order[first[v] : upto], order[first[c] : last[c]]
                    out[np.ix_(a, b)] = h[v]
                    out[np.ix_(b, a)] = h[v]
                upto = last[c]
        return out

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each node the stretch [first, last) of the tips below it in a drawing, and the tips in that order."""
        order = np.array(self.tip_order(), int)
        first, last = np.full(self.size, self.n), np.zeros(self.size, int)
        first[order] = np.arange(len(order))
        last[order] = np.arange(len(order)) + 1
        for v in self.upward():
            p = self.parent[v]
            if p >= 0:
                first[p], last[p] = min(first[p], first[v]), max(last[p], last[v])
        return first, last, order

    def segments(self) -> pd.DataFrame:
        """Drawing: a vertical line for each branch and a horizontal one for each inner node."""
        h, x = self.heights(), np.zeros(self.size)
        for i, t in enumerate(self.tip_order()):
            x[t] = i
        rows = []
        for v in self.upward():
            if self.children[v]:
                xs = [x[c] for c in self.children[v]]
                x[v] = float(np.mean(xs))
                rows.append((v, "h", min(xs), h[v], max(xs), h[v]))
        rows += [(v, "v", x[v], h[v], x[v], h[self.parent[v]]) for v in range(self.size) if self.parent[v] >= 0]
        return pd.DataFrame(rows, columns=["node", "kind", "x0", "y0", "x1", "y1"])

    def correlation(self, other: Tree) -> np.ndarray:
        """Correlation of every clade with every clade of other, 0 at least."""
        return clade_correlation(self.clades(), other.clades(), self.n)


def clade_correlation(a: list[int], b: list[int], n: int) -> np.ndarray:
    """(|A and B| - |A||B|/n) / sqrt(|A|(n-|A|)/n |B|(n-|B|)/n), 0 at least; the whole set has 1 with itself only."""
    x = np.array([[c >> i & 1 for i in range(n)] for c in a], float).reshape(len(a), n)
    y = np.array([[c >> i & 1 for i in range(n)] for c in b], float).reshape(len(b), n)
    sa, sb = x.sum(1), y.sum(1)
    spread = np.sqrt(np.outer(sa * (n - sa) / n, sb * (n - sb) / n))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(spread > 0, (x @ y.T - np.outer(sa, sb) / n) / spread, 0.0)
    same = (x @ y.T == sa[:, None]) & (sa[:, None] == sb[None, :])
    return np.where(same, 1.0, np.maximum(0.0, r))


def crossings(order: list[int], other: list[int]) -> int:
    """Pairs of tips that two drawings have in different order."""
    rank = {t: i for i, t in enumerate(other)}
    seq = [rank[t] for t in order]

    def count(x: list[int]) -> tuple[list[int], int]:
        if len(x) < 2:
            return x, 0
        a, m = count(x[: len(x) // 2])
        b, k = count(x[len(x) // 2 :])
        out, i, j, c = [], 0, 0, m + k
        while i < len(a) or j < len(b):
            if j == len(b) or i < len(a) and a[i] <= b[j]:
                out.append(a[i])
                i += 1
            else:
                out.append(b[j])
                c += len(a) - i
                j += 1
        return out, c

    return count(seq)[1]


def aligned_order(tree: Tree, reference: list[int]) -> list[int]:
    """Tips of tree from left to right, each node's children by the mean place of their tips in a reference order."""
    rank = {t: i for i, t in enumerate(reference)}
    total, number = np.zeros(tree.size), np.zeros(tree.size)
    for v in tree.upward():
        if v < tree.n:
            total[v], number[v] = rank[v], 1
        if tree.parent[v] >= 0:
            total[tree.parent[v]] += total[v]
            number[tree.parent[v]] += number[v]
    out, todo = [], [tree.root]
    while todo:
        v = todo.pop()
        if v < tree.n:
            out.append(v)
        todo += sorted(tree.children[v], key=lambda c: total[c] / number[c], reverse=True)
    return out


def from_nodes(nodes: list) -> Tree:
    return Tree([x["parent"] for x in nodes], [x["branch_length"] for x in nodes])


def map_trees(trees: DataFrame, kernel: Callable[[Tree, dict], pd.DataFrame], schema: str, keys: list[str]) -> DataFrame:
    """kernel on every tree, its rows with the tree's keys in front. No shuffle: a tree is a row. A row is a dict."""
    types = dict(trees.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, rows = [], 0
            columns = {c: batch[c].tolist() for c in batch.columns}
            for k in range(len(batch)):
                row = {c: x[k] for c, x in columns.items()}
                one = kernel(from_nodes(row["nodes"]), row)
                for i, c in enumerate(keys):
                    one.insert(i, c, row[c])
                made.append(one)
                rows += len(one)
                if rows > 1 << 16:  # few frames for small trees, bounded ones for large
                    yield pd.concat(made, ignore_index=True)
                    made, rows = [], 0
            if made:
                yield pd.concat(made, ignore_index=True)

    return trees.mapInPandas(run, f"{head}, {schema}")


def exploded(trees: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """One row for each node."""
    return trees.select(*keys, F.posexplode("nodes").alias("node", "x")).select(*keys, "node", "x.*")


def packed(nodes: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """Exploded nodes as one row for each tree; a tree is bounded by its tips."""
    fields = ["parent", "branch_length", "num_events", "snp_begin", "snp_end"]
    rows = F.sort_array(F.collect_list(F.struct("node", *fields)))
    return nodes.groupBy(*keys).agg(F.transform(rows, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("nodes"))


def with_heights(trees: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """Every node with height, number of tips below and number of children."""

    def kernel(t: Tree, row: dict) -> pd.DataFrame:
        return pd.DataFrame({"node": np.arange(t.size), "parent": t.parent, "branch_length": t.length, "height": t.heights(), "n_tips": [c.bit_count() for c in t.clades()], "n_children": [len(c) for c in t.children]})

    return map_trees(trees, kernel, "node int, parent int, branch_length double, height double, n_tips int, n_children int", keys)


def clade_rows(trees: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(node, tips): the sorted tips below every node."""

    def kernel(t: Tree, row: dict) -> pd.DataFrame:
        return pd.DataFrame({"node": np.arange(t.size), "tips": [[i for i in range(t.n) if c >> i & 1] for c in t.clades()]})

    return map_trees(trees, kernel, "node int, tips array<int>", keys)


def subtrees(trees: DataFrame, tips: list[int], keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """Nodes of each tree's restriction to some tips."""

    def kernel(t: Tree, row: dict) -> pd.DataFrame:
        s, events, old = t.subset(tips, [x["num_events"] for x in row["nodes"]])
        return pd.DataFrame({"node": np.arange(s.size), "parent": s.parent, "branch_length": s.length, "num_events": events, "old_node": old})

    return map_trees(trees, kernel, "node int, parent int, branch_length double, num_events double, old_node int", keys)


def pair_times(trees: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(i, j, tmrca) of all pairs of tips of each tree."""

    def kernel(t: Tree, row: dict) -> pd.DataFrame:
        i, j = np.triu_indices(t.n, 1)
        return pd.DataFrame({"i": i, "j": j, "tmrca": t.pair_times()[i, j]})

    return map_trees(trees, kernel, "i int, j int, tmrca double", keys)


def merged_tips(a: Column, b: Column) -> Column:
    """Two sorted lists of tips as one."""
    return F.array_sort(F.array_union(a, b))


def clade_sizes(heights: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """(keys, n_tips, branches): the sorted branches of each size, among which one that carries so many is looked for."""
    return heights.groupBy(*keys, "n_tips").agg(F.sort_array(F.collect_list("node")).alias("branches"))


def drawing(trees: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    return map_trees(trees, lambda t, row: t.segments(), "node int, kind string, x0 double, y0 double, x1 double, y1 double", keys)


def newicks(trees: DataFrame, scale: float = 1.0, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    return map_trees(trees, lambda t, row: pd.DataFrame({"newick": [t.newick(scale)]}), "newick string", keys)


def mutation_ages(muts: DataFrame, heights: DataFrame, keys: list[str] = ["tree_id"], branch: str = "branch") -> DataFrame:  # noqa: B006
    """muts with age_begin and age_end: heights of the bottom and top of their branch; the root's branch has no length."""
    low = heights.select(*keys, F.col("node").alias(branch), F.col("height").alias("age_begin"), "parent")
    top = heights.select(*keys, F.col("node").alias("parent"), F.col("height").alias("__top"))
    return muts.join(low, [*keys, branch]).join(top, [*keys, "parent"], "left").withColumn("age_end", F.coalesce("__top", "age_begin")).drop("__top", "parent")


def total_lengths(nodes: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    return nodes.where("parent >= 0").groupBy(*keys).agg(F.sum("branch_length").alias("total_length"))


def tmrca(heights: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    return heights.where("parent < 0").select(*keys, F.col("height").alias("tmrca"))


def _adjacent(rows: DataFrame, columns: list[str]) -> DataFrame:
    w = Window.partitionBy("chrom").orderBy("tree_id")
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in ["tree_id", *columns]}).where("next_tree_id is not null")


def compare_adjacent(trees: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Each tree against the next of its chromosome: correlation distance, partition metric, branch score, ancestor times.

    correlation: mean over inner clades of 1 less the best squared correlation in the other tree; partitions: clades of
    one tree without a match of `threshold` in the other, both ways; branch_score: root of summed squared differences
    of the lengths above equal clades, those of one tree only against zero; ancestor_time: the same for the times in
    which k ancestors exist, weighted by nothing, over tips - 1.
    """
    pairs = _adjacent(trees.select("chrom", "tree_id", "nodes"), ["nodes"])

    def kernel(t: Tree, row: dict) -> pd.DataFrame:
        u = from_nodes(row["next_nodes"])
        a, b = t.clades(), u.clades()
        r = clade_correlation(a, b, t.n)
        inner = slice(t.n, t.size - 1)
        best = r[inner].max(axis=1) if t.size > t.n + 1 else np.ones(1)
        parts = int((r[inner].max(axis=1) < threshold).sum() + (r[:, inner].max(axis=0) < threshold).sum())
        la = {c: le for c, le in zip(a, t.length, strict=True)}
        lb = {c: le for c, le in zip(b, u.length, strict=True)}
        score = sum((la.get(c, 0.0) - lb.get(c, 0.0)) ** 2 for c in {*la, *lb})
        ta, tb = (np.diff(np.concatenate([[0.0], np.sort(x.heights()[x.n :])])) for x in (t, u))
        return pd.DataFrame({"next_tree_id": [row["next_tree_id"]], "correlation": [float(np.mean(1 - best**2))], "partitions": [parts], "branch_score": [float(np.sqrt(score))], "ancestor_time": [float(np.sqrt(((ta - tb) ** 2).sum()) / (t.n - 1))]})

    return map_trees(pairs, kernel, "next_tree_id int, correlation double, partitions int, branch_score double, ancestor_time double", ["chrom", "tree_id"])


def path_to_root(nodes: DataFrame, tip: int, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """Nodes that hold a tip, from exploded clades (node, tips)."""
    return nodes.where(F.array_contains("tips", tip)).drop("tips")


def below(clades: DataFrame, tree_key: Column, node: int) -> DataFrame:
    """Nodes of a tree whose tips are all below a node."""
    top = clades.where(tree_key & (F.col("node") == node)).select(F.col("tips").alias("__all"))
    return clades.where(tree_key).join(F.broadcast(top), F.size(F.array_except("tips", "__all")) == 0).drop("__all")


def ancient_to_modern(nodes: DataFrame, ages: DataFrame, keys: list[str] = ["chrom", "tree_id"]) -> DataFrame:  # noqa: B006
    """Tip branches longer by the age of their sample. ages(node, age) has one row for a tip."""
    return nodes.join(ages, "node", "left").withColumn("branch_length", F.col("branch_length") + F.coalesce("age", F.lit(0.0))).drop("age")
