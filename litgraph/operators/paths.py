"""Graph search by hops and by weight: distances, shortest paths, nearby nodes. Edges are written down once, each step's new nodes make a
table of their own, and no step writes again what an earlier one found."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop, scratch
from .ordering import top_per_group


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def hop_distances(edges: DataFrame, source: str, most: int | None = None, kind: str | None = None, enough: int = 0) -> DataFrame:
    """node and d, its hops from source, for all nodes within `most` hops, or for all that can be reached. With `kind`, the search ends
    after the step that brings the nodes of this type to `enough`. Each hop is a join of the frontier with the edges."""
    edges = scratch(edges.select("src", "dst"))
    levels = [scratch(edges.sparkSession.createDataFrame([(source, 0)], "node string, d int"))]
    found = 0
    while (most is None or len(levels) <= most) and (kind is None or found < enough):
        reached = edges.join(levels[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = scratch(reached.join(_all(levels).select("node"), "node", "left_anti").withColumn("d", F.lit(len(levels))))
        if new.isEmpty():
            break
        levels.append(new)
        if kind is not None:
            found += new.filter(F.substring("node", 1, 1) == kind).count()
    drop(edges)
    return _all(levels)


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> list[str] | None:
    """A path of fewest hops between two nodes, the first by name among equals, or None where none connects them. Both sides' frontiers grow
    in turn until they meet; only the path itself comes to the driver. With `most`, a search that ends before it knows is an error."""
    if source == target:
        return [source]
    edges = scratch(edges.select("src", "dst"))
    one = lambda n: scratch(edges.sparkSession.createDataFrame([(n, None)], "node string, via string"))
    sides = [[one(source)], [one(target)]]
    step = 0
    while most is None or step < most:
        side, other = sides[step % 2], sides[1 - step % 2]
        new = edges.join(side[-1].select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        side.append(scratch(new.join(_all(side).select("node"), "node", "left_anti")))
        meet = side[-1].join(other[-1].select("node"), "node").agg(F.min("node")).first()[0]
        if meet is not None:
            parts = []
            for levels in sides:
                walk, node = [], meet
                for level in reversed(levels):
                    walk.append(node)
                    node = level.filter(F.col("node") == node).first().via
                parts.append(walk)
            drop(edges, *sides[0], *sides[1])
            return parts[0][::-1] + parts[1][1:]
        if side[-1].isEmpty():
            drop(edges, *sides[0], *sides[1])
            return None
        step += 1
    raise LookupError(f"no path of at most {most} steps; a longer one may exist")


def edge_weights(edges: DataFrame) -> DataFrame:
    """log2 of one plus the smaller degree of both ends: an edge costs more between busier nodes, never nothing."""
    degree = scratch(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))  # a table, so that the joins can split a busy node
    both = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    return both.select("src", "dst", F.log2(F.lit(1.0) + F.least("n", "m")).alias("weight"))


def pair_weights(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs (a, b) with the weight that `edge_weights` gives the edge between them in either direction, where no node is on both sides.
    Pairs are written once, and each side's degrees are tables, so that the joins can split a busy node."""
    pairs = scratch(pairs.select(a, b))
    degree = lambda end, n: scratch(pairs.groupBy(end).agg(F.count(F.lit(1)).alias(n)))
    both = pairs.join(degree(a, "_n"), a).join(degree(b, "_m"), b)
    return both.select(a, b, F.log2(F.lit(1.0) + F.least("_n", "_m")).alias("weight"))


#: Weights are added up as whole billionths, so that equal sums are equal whatever their order.
UNIT = 1e9
#: Sources whose bounds are broadcast.
FEW_SOURCES = 65_536


class Labels:
    """Distances from many sources at once, one table of (source, node, d, open). A round expands, for each source, the open labels within
    `delta` of its nearest open one, so that far labels wait until they are final or nearly so; old and new labels meet in one aggregate,
    which is written, and the table before it goes."""

    def __init__(self, edges: DataFrame, starts: DataFrame, delta: int) -> None:
        """edges: node, to and w in whole units; starts: source and node."""
        self.edges, self.delta, self.expanded = edges, delta, 0
        self.table = scratch(starts.select("source", "node", F.lit(0).cast("long").alias("d"), F.lit(True).alias("open"), F.lit(False).alias("went")).distinct())
        self.few = self.table.select("source").distinct().count() <= FEW_SOURCES
        #: The least open distance: labels below it are final. None where nothing is open.
        self.radius: int | None = 0

    def known(self) -> DataFrame:
        return self.table.select("source", "node", "d")

    def advance(self, limits: DataFrame | None = None) -> int:
        """One round; how many labels it expanded. Labels at a source's limit (source, limit) or beyond stay open."""
        bounds = self.table.filter("open").groupBy("source").agg(F.min("d").alias("low"))
        bounds = bounds.withColumn("limit", F.lit(None).cast("long")) if limits is None else bounds.join(limits, "source", "left")
        marked = self.table.drop("went").join(F.broadcast(bounds) if self.few else bounds, "source", "left")
        go = F.col("open") & (F.col("d") <= F.col("low") + self.delta) & (F.col("limit").isNull() | (F.col("d") < F.col("limit")))
        marked = marked.select("source", "node", "d", "open", go.alias("went"))
        steps = marked.filter("went").join(self.edges, "node").groupBy("source", F.col("to").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
        none = lambda kind: F.lit(None).cast(kind)
        both = marked.withColumn("new", none("long")).unionByName(steps.select("source", "node", none("long").alias("d"), none("boolean").alias("open"), none("boolean").alias("went"), "new"))
        met = both.groupBy("source", "node").agg(F.min("d").alias("old"), F.min("new").alias("new"), F.max(F.col("open") & ~F.col("went")).alias("waits"), F.max("went").alias("went"))
        better = F.col("old").isNull() | F.coalesce(F.col("new") < F.col("old"), F.lit(False))
        table = scratch(met.select("source", "node", F.least("old", "new").alias("d"), (better | F.coalesce("waits", F.lit(False))).alias("open"), F.coalesce("went", F.lit(False)).alias("went")))
        drop(self.table)
        self.table = table
        n, self.radius = table.agg(F.count_if("went"), F.min(F.when(F.col("open"), F.col("d")))).first()
        self.expanded += n
        return n

    def close(self) -> None:
        drop(self.table)


def _stored(edges: DataFrame) -> tuple[DataFrame, int]:
    """src, dst and w in whole units, written once, by ranges of src so that a busy node is many parts; and the mean weight."""
    table = scratch(edges.select("src", "dst", F.round(F.col("weight") * UNIT).cast("long").alias("w")).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"))
    low, mean = table.agg(F.min("w"), F.avg("w")).first()
    if low is not None and low <= 0:
        raise ValueError("weights must be positive")
    return table, int(mean or 0)


def distances_from(edges: DataFrame, sources: DataFrame, kind: str | None = None, enough: int = 0, within: float | None = None) -> DataFrame:
    """source, node and d, the least sum of weights, for all sources (a table with `source`) in one search over one table of edges (src, dst,
    positive weight). With `enough`, a source's search ends when its `enough` nearest other nodes (of type `kind`, if given) are known; with
    `within`, beyond that distance. Distances up to there are least ones; greater ones are upper bounds."""
    table, mean = _stored(edges)
    labels = Labels(table.select(F.col("src").alias("node"), F.col("dst").alias("to"), "w"), sources.select("source", F.col("source").alias("node")), mean)
    far = None if within is None else int(round(within * UNIT))
    while True:
        limits = None
        if enough:
            near = labels.known().filter("node <> source")
            near = near if kind is None else near.filter(F.substring("node", 1, 1) == kind)
            limits = top_per_group(near, ["source"], [F.col("d"), F.col("node")], enough).filter(F.col("rank") == enough).select("source", F.col("d").alias("limit"))
        if far is not None:
            limits = sources.select("source").distinct().join(limits, "source", "left") if limits is not None else sources.select("source", F.lit(None).cast("long").alias("limit")).distinct()
            limits = limits.withColumn("limit", F.least("limit", F.lit(far)))
        if labels.radius is None or not labels.advance(limits):
            break
    found = scratch(labels.known())
    labels.close()
    drop(table)
    return found.select("source", "node", (F.col("d") / UNIT).alias("d"))


def weighted_distances(edges: DataFrame, source: str) -> DataFrame:
    """node and d by the least sum of weights from source, for all nodes that can be reached."""
    return distances_from(edges, _sources(edges, [source])).select("node", "d")


def _sources(edges: DataFrame, names: list[str]) -> DataFrame:
    return edges.sparkSession.createDataFrame([(n,) for n in names], "source string")


@dataclass
class ShortestPaths:
    """distance: the least sum of weights. edges: src, dst and d (of src from the source) of all edges on paths of that sum. path: the first of
    these paths by names. expanded: labels that the search expanded."""

    distance: float
    edges: DataFrame
    path: list[str]
    expanded: int


def shortest_paths(edges: DataFrame, source: str, target: str) -> ShortestPaths | None:
    """All paths of the least sum of weights between two nodes, or None where no path connects them. Edges have src, dst and a positive weight.

    Labels grow from both ends, always on the side with the smaller radius, until both radii together reach the best meeting; no label
    is expanded that can't be part of a better one. An edge between a label of either side is on a shortest path if it is tight: label,
    weight and label add up to the least sum. From these, tight edges are followed to both ends, with one join for each level."""
    if source == target:
        empty = edges.sparkSession.createDataFrame([], "src string, dst string, d double")
        return ShortestPaths(0.0, empty, [source], 0)
    table, mean = _stored(edges)
    sides = [Labels(table.select(F.col(a).alias("node"), F.col(b).alias("to"), "w"), _sources(edges, [start]).select("source", F.col("source").alias("node")), mean) for a, b, start in (("src", "dst", source), ("dst", "src", target))]
    least = None
    while None not in (sides[0].radius, sides[1].radius) and (least is None or sides[0].radius + sides[1].radius < least):
        near, far = sorted(sides, key=lambda side: side.radius)
        near.advance(None if least is None else near.table.select("source").distinct().withColumn("limit", F.lit(least - far.radius).cast("long")))
        here, there = (s.known().select("node", F.col("d").alias(n)) for s, n in zip(sides, "ab"))
        least = here.join(there, "node").agg(F.min(F.col("a") + F.col("b"))).first()[0]
    found = None
    if least is not None:
        found = _recovered(table, [scratch(s.known().select("node", "d")) for s in sides], source, target, least, sum(s.expanded for s in sides))
    for s in sides:
        s.close()
    drop(table)
    return found


def _recovered(table: DataFrame, labels: list[DataFrame], source: str, target: str, least: int, expanded: int) -> ShortestPaths:
    here, there = (k.select(F.col("node").alias(end), F.col("d").alias(name)) for k, end, name in zip(labels, ("src", "dst"), "ab"))
    tight = [scratch(table.join(here, "src").join(there, "dst").filter(F.col("a") + F.col("w") + F.col("b") == least).select("src", "dst", F.col("a").alias("d")))]
    for side, (end, other) in enumerate((("src", "dst"), ("dst", "src"))):  # towards the source, towards the target
        own = labels[side].select(F.col("node").alias(end), F.col("d").alias("near"))
        at = labels[side].select(F.col("node").alias(other), F.col("d").alias("at"))
        level, seen = tight[0].select(F.col(end).alias(other)).distinct(), []
        while True:
            seen.append(level)
            new = table.join(level.join(at, other), other).join(own, end).filter(F.col("near") + F.col("w") == F.col("at"))
            tight.append(scratch(new.select("src", "dst", (F.col("near") if side == 0 else F.lit(least) - F.col("at")).alias("d"))))
            if tight[-1].isEmpty():
                break
            level = tight[-1].select(F.col(end).alias(other)).distinct().join(_all(seen), other, "left_anti")
    edges = scratch(_all([t.select("src", "dst", "d") for t in tight]).distinct())
    drop(*tight, *labels)
    walks = scratch(edges.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>"))
    ends, done, n = [], [walks], 1
    while n:  # the first path to each node, level by level
        step = walks.filter(F.col("node") != target).join(edges.withColumnRenamed("src", "node"), "node").groupBy("dst").agg(F.min("path").alias("path"))
        walks = scratch(step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        done.append(walks)
        n, end = walks.agg(F.count(F.lit(1)), F.min(F.when(F.col("node") == target, F.col("path")))).first()
        ends += [end] if end else []
    drop(*done)
    return ShortestPaths(least / UNIT, edges.withColumn("d", F.col("d") / UNIT), min(ends), expanded)


def weighted_path(edges: DataFrame, source: str, target: str) -> tuple[float, list[str]] | None:
    """The least sum of weights and the first of its paths by names, or None where no path connects the two."""
    found = shortest_paths(edges, source, target)
    return found and (found.distance, found.path)


def nearby_nodes(edges: DataFrame, source: str, kind: str | None, most: int, hops: int | None = None) -> DataFrame:
    """Up to `most` nodes of a type (of any, if None), nearest first by hops, then by name: node and d. The search widens until it has them."""
    found = hop_distances(edges, source, hops, kind, most).filter(F.col("node") != source)
    if kind is not None:
        found = found.filter(F.substring("node", 1, 1) == kind)
    return found.orderBy("d", "node").limit(most)


def nearest_of_each(edges: DataFrame, sources: DataFrame, kind: str | None, most: int, within: float | None = None) -> DataFrame:
    """source, node, d and rank: up to `most` other nodes of a type for each source, nearest first by weight, then by name. All sources are
    searched for at once."""
    found = distances_from(edges, sources, kind, most, within).filter("node <> source")
    if kind is not None:
        found = found.filter(F.substring("node", 1, 1) == kind)
    if within is not None:
        found = found.filter(F.col("d") <= within)
    return top_per_group(found, ["source"], [F.col("d"), F.col("node")], most)


def nearby_by_weight(edges: DataFrame, source: str, kind: str, most: int, max_degree: int | None = None) -> DataFrame:
    """Up to `most` nodes of a type, nearest first by weight: node and d. With max_degree, a node has no more edges than that, picked by hash."""
    from .edges import cap_degree

    if max_degree is not None:
        edges = cap_degree(edges, max_degree)
    return nearest_of_each(edges, _sources(edges, [source]), kind, most).select("node", "d").orderBy("d", "node")


def near_path(edges: DataFrame, path: list[str], kind: str, most: int, hops: int | None = None) -> DataFrame:
    """The distinct nodes of a type near any node of a path, up to `most` for each: node. One search serves the whole path, and the edges are
    written once, whatever its length."""
    return nearest_of_each(edges.select("src", "dst", F.lit(1.0).alias("weight")), _sources(edges, path), kind, most, hops).select("node").distinct()


def reset(nodes: DataFrame, column: str, value=None) -> DataFrame:
    """An attribute of all nodes gets a value again, or goes."""
    return nodes.drop(column) if value is None else nodes.withColumn(column, F.lit(value))
