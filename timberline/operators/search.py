"""Best-first branch and bound over boxes of trees. A round takes several open boxes, and each kind of bound is one Spark
job for all their halves. What the groups came to lies in tables in the shared folder; the driver sees sums."""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.prep import NO_GAP, cells, min_gaps
from timberline.operators import bounds
from timberline.operators.box import Box, branch, free, widest_threshold
from timberline.operators.greedy import cart
from timberline.operators.groups import bootstrap, deal, group_count, leaf_deal
from timberline.operators.pull import tuned
from timberline.operators.tree import Tree, costs, leaf_counts, majority_labels, merged
from timberline.sources.tables import scratch

GAP = 1e-2
LOG = "iter long, open_nodes long, level int, lb double, ub double, gap double"
def next_variable(box: Box, seed: int) -> tuple[str, object] | None:
    """What to branch on: open splits, then features and labels unless a wide threshold is preferred, then thresholds."""
    open_ = box.undetermined()
    if open_["d"]:
        return "d", open_["d"][0]
    wide = widest_threshold(box)
    width = max([hi - lo for lo, hi in box.threshold.values()], default=0.0)
    if (open_["a"] or open_["c"]) and np.random.default_rng(seed).random() <= 1 - 0.5 * width or wide is None:
        if open_["a"]:
            return "a", open_["a"][0]
        if open_["c"]:
            return "c", open_["c"][0]
    if wide is not None:
        return "b", wide
    return ("a", open_["a"][0]) if open_["a"] else ("c", open_["c"][0]) if open_["c"] else None


def _closed(lb: float, ub: float, gap: float) -> bool:
    return ub - lb <= gap or ub - lb <= gap * min(abs(ub), abs(lb))


#: Trees that one pass scores, and nodes after which small groups are drawn anew.
SCORED, DRAWN = 1 << 16, 16
#: Groups that one task solves, where there are more than cores.
SOLVED = 256


@dataclass(frozen=True)
class Node:
    """An open box: its bound, level, the box, and where the results of the groups in it lie."""

    lb: float
    level: int
    box: Box
    number: int = 0
    path: str | None = None


class Search:
    """State of one search. ``points``: ``row_id``, features within [0, 1], and ``y`` from 1.

    ``grouping``: rows are dealt over groups by ``class``, or by ``leaf`` of the first incumbent and k-means within.
    ``rounds``: how often multipliers are moved at the top box, which then hold in all boxes (``pull``); depths 1 and 2.
    """

    def __init__(self, points: DataFrame, features: list[str], depth: int, alpha: float = 0.05, share: float | None = None, gap: float = GAP, methods: str = "CF+MILP+SG", seed: int = 1, grouping: str = "class", rounds: int = 0) -> None:
        self.methods = methods.split("+")
        if "CF" not in self.methods:
            raise ValueError("the closed-form bound is needed by all others: add CF")
        if grouping not in ("class", "leaf"):
            raise ValueError(f"no grouping by {grouping}")
        if rounds and not 1 <= depth <= 2:
            raise ValueError("multipliers are for trees of depth 1 or 2")
        self.grouping, self.greedy, self.rounds, self.pulls = grouping, {}, rounds, None
        self.features, self.depth, self.alpha, self.gap, self.seed = features, depth, alpha, gap, seed
        self.cells = cells(points, features).persist()
        counts = {r.y: r.n for r in self.cells.groupBy("y").agg(F.sum("n").alias("n")).collect()}
        self.n, self.k = sum(counts.values()), max(counts)
        self.share = share or max(counts.values()) / self.n
        self.eps = np.full(len(features), NO_GAP)
        for r in min_gaps(self.cells, features).collect():
            self.eps[r.f - 1] = r.gap
        self.numbers = self.solved = self.jobs = 0
        self.n_groups = n_groups = min(self.n, group_count(self.n, len(features), self.k, depth))
        self.groups = self.kept(deal(points.select("row_id", *features, "y"), "y", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(104729)), "row_id", n_groups=n_groups, carry=True))
        self.tree, self.ub = Tree(depth), float("inf")
        self.log: list[tuple] = []

    def kept(self, groups: DataFrame) -> DataFrame:
        """``groups`` in memory, each whole in one part, so that no node of the search shuffles them.

        The number of parts is stated: the rows are few bytes and much work, which Spark would put into one task.
        """
        return groups.repartition(self.parts(), "group_id").persist()

    def parts(self) -> int:
        cores = self.cells.sparkSession.sparkContext.defaultParallelism
        return max(1, min(self.n_groups, max(2 * cores, self.n_groups // SOLVED)))

    def offer(self, trees: list[Tree]) -> None:
        """Score all candidates on all rows, with majority labels where theirs are worse, and keep the best.

        One pass over the cells scores ``SCORED`` trees. Labels are looked at where there is a new incumbent.
        """
        trees, before = [t for t in trees if t is not None], self.tree
        for low in range(0, len(trees), SCORED):
            some = trees[low : low + SCORED]
            for tree, cost in zip(some, costs(self.cells, some, self.features, self.share, self.alpha, "n"), strict=True):
                if cost < self.ub - 1e-12:
                    self.tree, self.ub = tree, cost
        if self.tree is before:
            return
        labels = {r.leaf: r.label for r in majority_labels(leaf_counts(self.cells, self.tree, self.features, F.col("n"))).collect()}
        if labels != self.tree.label:
            better = replace(self.tree, label=labels)
            cost = costs(self.cells, [better], self.features, self.share, self.alpha, "n")[0]
            if cost <= self.ub:
                self.tree, self.ub = better, cost

    def drawn(self, box: Box, tree: Tree, n: int = 8) -> list[Tree]:
        """``tree`` with its thresholds drawn anew from the box, by a seed."""
        random = np.random.default_rng(self.seed)
        return [replace(tree, split={t: (f, float(random.uniform(*box.threshold[t]))) for t, (f, _) in tree.split.items()}) for _ in range(n)]

    def bootstrap(self, points: DataFrame | None = None, n_groups: int = 6, size: int = 50, round_: int = 0) -> None:
        """Offer the best trees of small groups drawn with repetition, whatever their box."""
        order = F.pmod(F.xxhash64("row_id", F.lit(self.seed)), F.lit(104729))
        points = self.groups if points is None else points
        drawn = bootstrap(points.select("row_id", *self.features, "y"), order, "row_id", n=self.n, n_groups=n_groups, size=size, round_=round_)
        rows = bounds.group_bounds(drawn, free(self.depth, len(self.features), self.k), self.features, self.share, self.alpha, self.n, self.eps)
        self.offer([bounds.tree_of(r, self.depth) for r in rows.collect()])

    def propose(self, method: str, trees: list[Tree] = (), box: Box | None = None) -> None:
        """Offer an incumbent: ``heur`` grows a greedy tree from the box's features, ``merg`` joins trees into one, ``slt`` takes the best.

        A greedy tree is grown once for each set of features.
        """
        if method == "heur":
            box = box or free(self.depth, len(self.features), self.k)
            allowed = tuple(sorted(frozenset().union(*box.features.values())))
            if allowed and allowed not in self.greedy:
                found = cart(self.cells, [self.features[f - 1] for f in allowed], self.depth, weight="n")
                self.greedy[allowed] = replace(found, split={t: (allowed[f - 1], b) for t, (f, b) in found.split.items()})
                self.offer([self.greedy[allowed]])
        elif method == "merg":
            self.offer([merged(list(trees))] if trees else [])
        elif method == "slt":
            self.offer(list(trees))
        else:
            raise ValueError(f"no way {method} to an incumbent")

    def regroup(self) -> None:
        """Deal the rows anew by leaf of the incumbent."""
        old = self.groups
        self.groups = self.kept(leaf_deal(old.drop("group_id"), self.tree, self.features, "row_id", self.n_groups).select(*old.columns))
        self.groups.count()
        old.unpersist()

    def bound(self, nodes: list[Node]) -> list[Node]:
        """Nodes with the best bounds of their boxes, each level of bounds only for those that the one before leaves open.

        ``path`` and ``number`` of a node name its parent's results of groups; those returned name its own.
        """
        out = dict(enumerate(nodes))
        open_ = lambda: {i: n for i, n in out.items() if not _closed(n.lb, self.ub, self.gap)}
        if "MILP" in self.methods:
            boxes = {i: n.box for i, n in open_().items() if any(len(lab) > 1 for lab in n.box.labels.values())}
            self.jobs += bool(boxes)
            for i, counts in bounds.cover_counts_of(self.cells, boxes, self.features, F.col("n")).items():
                out[i] = replace(out[i], lb=max(out[i].lb, bounds.label_cover(counts, out[i].box, self.share, self.alpha)))
        if "SG" in self.methods and (left := open_()):
            out |= self._by_groups(left)
        if "SG" not in self.methods:
            for n in open_().values():
                self.propose("heur", box=n.box)
        for n in nodes:
            variables = n.box.undetermined()
            if not (variables["d"] or variables["a"] or variables["c"]):
                self.offer(self.drawn(n.box, self.tree))
        return list(out.values())

    def _by_groups(self, nodes: dict[int, Node]) -> dict[int, Node]:
        """The bounds of the groups in each box, summed up. A group whose best tree in the parent's box still lies in the
        box keeps it and its bound; the others are solved, all boxes at once, and offer their trees."""
        spark = self.groups.sparkSession
        boxes = {self.numbers + 1 + j: n for j, n in enumerate(nodes.values())}
        self.numbers += len(boxes)
        rows = spark.createDataFrame(bounds.box_rows({i: (n.number, n.box) for i, n in boxes.items()}), bounds.BOXES)
        paths = sorted({n.path for n in boxes.values() if n.path})
        asked = self.groups.select("group_id").distinct().withColumn("boxes", F.lit(list(boxes)).cast("array<int>"))
        still = None
        if paths:
            known = spark.read.schema(bounds.SOLVED).parquet(*paths).withColumnRenamed("box", "parent")
            still = known.where(F.col("bound") < float("inf")).join(F.broadcast(rows), "parent").where(bounds.holds())  # a row for each box of the round
            still = still.select(*[c.split()[0] for c in bounds.SOLVED.split(", ")])
            have = still.groupBy("group_id").agg(F.collect_set("box").alias("_have"))
            asked = asked.join(have, "group_id", "left").withColumn("boxes", F.array_except("boxes", F.coalesce("_have", F.array().cast("array<int>")))).drop("_have")
        if self.pulls is not None:
            asked = asked.join(self.pulls, "group_id")
        solved = scratch(spark, "groups")
        found = bounds.groups_in_boxes(self.groups, asked.where(F.size("boxes") > 0), {i: n.box for i, n in boxes.items()}, self.features, self.share, self.alpha, self.n, self.eps, self.k)
        found.write.parquet(solved)
        new = spark.read.schema(bounds.SOLVED).parquet(solved)
        where = solved
        if still is not None:
            where = scratch(spark, "results")
            still.unionByName(new).write.parquet(where)
        none = F.col("bound") == float("inf")
        sums = {r.box: r for r in spark.read.schema(bounds.SOLVED).parquet(where).groupBy("box").agg(F.sum(F.when(~none, bounds.cut(F.col("bound")))).alias("s"), F.max(none).alias("none")).collect()}
        self._offer_table(new.where(~none))
        self.jobs += 4
        out = {}
        for key, (i, n) in zip(nodes, boxes.items(), strict=True):
            value = float("inf") if sums[i].none else float(sums[i].s)
            out[key] = replace(n, lb=max(n.lb, value), number=i, path=where)
        return out

    def _offer_table(self, solved: DataFrame) -> None:
        """Offer the distinct trees of a table, ``SCORED`` on the driver at a time."""
        trees = solved.select("feature", "threshold", "label").distinct()
        n = trees.count()
        self.solved += n
        pages = -(-n // SCORED)
        for page in range(pages):
            some = trees if pages == 1 else trees.where(F.pmod(F.xxhash64("feature", "threshold", "label"), F.lit(pages)) == page)
            self.offer(sorted([bounds.decoded(r, self.depth) for r in some.collect()], key=repr))

    def run(self, max_nodes: int = 1000, seconds: float = 14_400, start: Tree | None = None, shape: int = 0, batch: int = 1) -> tuple[Tree, float, float]:
        """Search until the gap is closed, nodes or time run out: the tree, its cost, and the bound certified for it.

        A round branches ``batch`` boxes, the most promising ones, and bounds all their halves together; the log has a
        line a round. Where group bounds are on and the gap is open, small groups drawn anew offer their best trees as
        well, at the start and after every ``DRAWN`` nodes. The persisted rows and cells go at the end.
        """
        began = time.monotonic()
        self.offer([start, Tree(self.depth)])
        if start is None:
            self.propose("heur")
        if self.grouping == "leaf" and "SG" in self.methods:
            self.regroup()
        top = Node(0.0, 1, free(self.depth, len(self.features), self.k, shape))
        if self.rounds and "SG" in self.methods:
            self.pulls, _ = tuned(self.groups, top.box, self.features, self.share, self.alpha, self.n, self.eps, self.k, self.ub, self.rounds, self.parts())
        heap, given_up, seq, done, drawn = [], float("inf"), 0, 0, 0
        for n in self._bounded([top]):
            heapq.heappush(heap, (n.lb, 0, n))
        while True:
            if "SG" in self.methods and done >= DRAWN * drawn and heap and not _closed(heap[0][0], self.ub, self.gap):
                self.bootstrap(round_=drawn)
                drawn += 1
            while heap and _closed(heap[0][0], self.ub, self.gap):
                given_up = min(given_up, heapq.heappop(heap)[0])
            least = min([given_up, self.ub, *[h[0] for h in heap[:1]]])
            self.log.append((done, len(heap), heap[0][2].level if heap else None, float(least), float(self.ub), (self.ub - least) / abs(least) if least else None))
            if not heap or done >= max_nodes or time.monotonic() - began > seconds:
                break
            halves = []
            for _ in range(min(batch, max_nodes - done, len(heap))):
                lb, _, node = heapq.heappop(heap)
                variable = next_variable(node.box, self.seed + done)
                done += 1
                if variable is None:
                    given_up = min(given_up, lb)
                else:
                    halves += [replace(node, level=node.level + 1, box=b) for b in branch(node.box, *variable)]
            for n in self._bounded(halves):
                seq += 1
                heapq.heappush(heap, (n.lb, -seq, n))
        least = min([given_up, self.ub, *[h[0] for h in heap]])
        self.cells.unpersist()
        self.groups.unpersist()
        return self.tree, self.ub, float(least)

    def _bounded(self, nodes: list[Node]) -> list[Node]:
        """Those of the nodes whose boxes have a tree, with their bounds."""
        self.jobs += bool(nodes)
        first = bounds.closed_and_feasible(self.cells, [n.box for n in nodes], self.features, self.share, self.alpha, F.col("n"))
        return self.bound([replace(n, lb=max(n.lb, value)) for n, value in zip(nodes, first, strict=True) if value < float("inf")])

    def bound_log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG)
