"""Communities of a weighted graph by the Leiden method, as joins and groupings.

Each level has three steps. Local moving: a node goes to the community around it that raises
modularity most, by w(to) - w(from) - resolution * k * (tot(to) - tot(from) + k) / 2m; the least name wins a tie.
Refinement: inside each community nodes begin alone again, and one that is well connected to its community
joins a neighbouring part if that raises modularity, so parts are connected. Aggregation: parts become the
nodes of a smaller graph, which begins with the communities found. When every community is one node, the nodes of
the first graph are moved once more, and what is left unconnected is split.

Nodes move at once, not one by one. In a round half of them may, by a hash of name and round; if that
didn't raise modularity it is taken back, and in the next round each community takes part in one
move at most, the best: then all gains are exact. So modularity never falls, and a result depends on nothing but
names, weights and resolution. Refinement lets the one half of the nodes join parts of the other. A hub's
edges are only summed by community, never gathered; each round is written to the shared folder. Tables are joined by
sorting both sides: a broadcast would send one through the driver in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from .components import connected_components
from .joins import sorted_join

EPS = 1e-9


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, weight) in both directions, of parallel edges the heaviest; edges of a node to itself are left out."""
    both = edges.select("subject", "object", "weight").union(edges.select("object", "subject", "weight")).filter("subject <> object")
    return both.groupBy("subject", "object").agg(F.max("weight").cast("double").alias("weight")).toDF("node", "other", "weight")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Of a graph (subject, object, weight) and its (node, community)."""
    both = undirected(edges)
    inside = sorted_join(sorted_join(both, communities, "node"), communities.toDF("other", "other_community"), "other").agg(F.sum("weight"), F.sum(F.when(F.col("community") == F.col("other_community"), F.col("weight")).otherwise(0.0))).first()
    if not inside[0]:
        return 0.0
    squares = both.groupBy("node").agg(F.sum("weight").alias("k")).join(communities, "node").groupBy("community").agg(F.sum("k").alias("tot")).agg(F.sum(F.col("tot") * F.col("tot"))).first()[0]
    return inside[1] / inside[0] - resolution * squares / inside[0] ** 2


def _turn(name: Column, round_: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(round_)), F.lit(2)) == 0


def _votes(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(node, label, w): each node's weight to each community around it."""
    return sorted_join(edges, part.select(F.col("node").alias("other"), F.col("community").alias("label")), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))


class _Graph:
    """A level's graph: edges in both directions, nodes (node, k: degree), weight inside nodes, twice the total weight."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, inside: float, twice: float, resolution: float):
        self.edges, self.nodes, self.inside, self.twice, self.resolution = edges, nodes, inside, twice, resolution

    def totals(self, part: DataFrame) -> DataFrame:
        return sorted_join(part, self.nodes, "node").groupBy("community").agg(F.sum("k").alias("tot"))

    def quality(self, votes: DataFrame, part: DataFrame, totals: DataFrame) -> float:
        own = sorted_join(votes, part, "node").filter("label = community").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("own"))
        own, squares = own.crossJoin(totals.agg(F.sum(F.col("tot") * F.col("tot")))).first()  # two sums
        return (own + self.inside) / self.twice - self.resolution * squares / self.twice**2

    def moves(self, votes: DataFrame, part: DataFrame, totals: DataFrame) -> DataFrame:
        """(node, community, to, gain) of the nodes that would gain by going elsewhere, and where they would most."""
        rate = F.col("k") * self.resolution / self.twice
        state = sorted_join(sorted_join(part, self.nodes, "node"), totals, "community")
        every = sorted_join(sorted_join(votes, state, "node"), totals.toDF("label", "to_tot"), "label")
        own = F.max(F.when(F.col("label") == F.col("community"), F.col("w")))
        best = F.min(F.when(F.col("label") != F.col("community"), F.struct((rate * F.col("to_tot") - F.col("w")).alias("cost"), "label")))
        found = every.groupBy("node", "community", "k", "tot").agg(F.coalesce(own, F.lit(0.0)).alias("own"), best.alias("best")).filter("best is not null")
        gain = -F.col("best.cost") - F.col("own") + rate * (F.col("tot") - F.col("k"))
        return found.select("node", "community", F.col("best.label").alias("to"), gain.alias("gain")).filter(F.col("gain") > EPS)


def _matched(moves: DataFrame) -> DataFrame:
    """Of the moves that touch a community only its best, and only if it is the best of both."""
    order = F.struct((-F.col("gain")).alias("g"), "node")
    touched = moves.select("node", order.alias("o"), F.explode(F.array("community", "to")).alias("c"))
    best = touched.groupBy("c").agg(F.min("o").alias("o"))
    chosen = best.groupBy(F.col("o.node").alias("node")).agg(F.count("*").alias("n")).filter("n = 2")
    return sorted_join(moves, chosen.select("node"), "node", "left_semi")


def _local(graph: _Graph, part: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """part (node, community) after local moving, and its modularity."""
    kept, highest, matching = None, None, False
    for number in range(rounds + 1):
        votes = checkpointed(_votes(graph.edges, part), "votes")
        totals = checkpointed(graph.totals(part), "totals")
        quality = graph.quality(votes, part, totals)
        if kept is None or quality > highest + 1e-12:
            kept, highest, matching = (part, votes, totals), quality, False
        else:
            part, votes, totals = kept
            if matching:  # even the exact moves of the last round brought nothing that counts
                break
            matching = True
        if number == rounds:
            break
        moves = checkpointed(graph.moves(votes, part, totals), "moves")
        if moves.isEmpty():
            break
        chosen = _matched(moves) if matching else moves.filter(_turn(F.col("node"), number))
        part = checkpointed(sorted_join(part, chosen.select("node", "to"), "node", "left").select("node", F.coalesce("to", "community").alias("community")), "part")
    return kept[0], highest


def _refined(graph: _Graph, part: DataFrame, rounds: int) -> DataFrame:
    """(node, community): connected parts of the communities of `part`, a part named by its first node."""
    ends = part.select(F.col("node").alias("other"), F.col("community").alias("other_community"))
    inner = sorted_join(sorted_join(graph.edges, part, "node"), ends, "other").filter("community = other_community").select("node", "other", "weight")
    inner = checkpointed(inner, "inner")
    rate = F.col("k") * graph.resolution / graph.twice
    placed = sorted_join(sorted_join(part, graph.nodes, "node"), graph.totals(part), "community")
    whole = sorted_join(placed, inner.groupBy("node").agg(F.sum("weight").alias("w_in")), "node")
    free = checkpointed(whole.filter(F.col("w_in") >= rate * (F.col("tot") - F.col("k"))).select("node", "k"), "free")  # well connected ones
    refined = part.select("node", F.col("node").alias("community"))
    for number in range(rounds):
        sizes = sorted_join(refined, graph.nodes, "node").groupBy("community").agg(F.count("*").alias("size"), F.sum("k").alias("tot"))
        alone = sorted_join(sorted_join(free, refined, "node"), sizes.filter("size = 1").select("community"), "community", "left_semi").select("node", "k")
        votes = _votes(sorted_join(inner, alone.select("node"), "node", "left_semi"), refined)
        votes = sorted_join(sorted_join(votes, alone, "node"), sizes.withColumnRenamed("community", "label"), "label")
        gains = votes.withColumn("cost", rate * F.col("tot") - F.col("w")).filter(F.col("cost") < -EPS)
        stays = (F.col("size") > 1) | ~_turn(F.col("label"), number)  # who joins meets nobody that leaves
        best = gains.groupBy("node").agg(F.min(F.when(_turn(F.col("node"), number) & stays, F.struct("cost", "label"))).alias("best"))
        best = checkpointed(best.select("node", F.col("best.label").alias("to")), "joins")
        if best.isEmpty():
            break
        refined = checkpointed(sorted_join(refined, best, "node", "left").select("node", F.coalesce("to", "community").alias("community")), "refined")
    return refined


def leiden(edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 40) -> DataFrame:
    """(node, community: its least node) of a graph (subject, object, weight); at most `rounds` rounds of moves in each of at most `levels` levels."""
    both = checkpointed(undirected(edges), "edges")
    nodes = checkpointed(both.groupBy("node").agg(F.sum("weight").alias("k")), "nodes")
    twice = nodes.agg(F.sum("k")).first()[0]
    if not twice:
        return nodes.select("node", F.col("node").alias("community"))
    graph = _Graph(both, nodes, 0.0, twice, resolution)
    members = nodes.select("node", F.col("node").alias("at"))
    part = nodes.select("node", F.col("node").alias("community"))
    for _ in range(levels):
        part, _ = _local(graph, part, rounds)
        count = graph.nodes.count()
        if part.agg(F.count_distinct("community")).first()[0] == count:
            break
        refined = _refined(graph, part, rounds)
        name = refined.select("node", F.col("community").alias("into"))
        mapped = sorted_join(sorted_join(graph.edges, name, "node"), name.toDF("other", "other_into"), "other")
        mapped = checkpointed(mapped.groupBy(F.col("into").alias("node"), F.col("other_into").alias("other")).agg(F.sum("weight").alias("weight")), "mapped")
        inside = graph.inside + mapped.filter("node = other").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        fewer = checkpointed(sorted_join(graph.nodes, name, "node").groupBy("into").agg(F.sum("k").alias("k")).toDF("node", "k"), "nodes")
        members = checkpointed(sorted_join(members, name.toDF("at", "into"), "at").select("node", F.col("into").alias("at")), "members")
        part = checkpointed(sorted_join(part, name, "node").groupBy("into").agg(F.min("community").alias("community")).toDF("node", "community"), "part")
        graph = _Graph(mapped.filter("node <> other"), fewer, inside, twice, resolution)
        if fewer.count() == count:
            break
    found = checkpointed(sorted_join(members, part.toDF("at", "community"), "at").select("node", "community"), "found")
    found, _ = _local(_Graph(both, nodes, 0.0, twice, resolution), found, rounds)  # single nodes that now gain elsewhere
    within = sorted_join(sorted_join(both, found, "node"), found.toDF("other", "other_community"), "other").filter("community = other_community")
    parts = connected_components(within.select(F.col("node").alias("a"), F.col("other").alias("b")))
    return sorted_join(found.select("node"), parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
