"""Edge-stream kernels: degrees, message propagation and PageRank-Delta.

An edge scan that scatters a source's value to targets is a join and a grouped aggregate.  A loop deals
its edges once by their source and its vertices by their id, in tables that keep this; a round is
then one exchange, that of the messages, which are combined by target before it.
"""

from __future__ import annotations

from collections.abc import Callable

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meshframe.plans.scratch import drop, keep, observed

BASE, DAMPING = 0.15, 0.85


def degree(vertices: DataFrame, edges: DataFrame, side: str = "src") -> DataFrame:
    """``id, degree`` of all vertices: edges that leave (``src``) or enter (``dst``) each, repeated ones too."""
    counted = edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def propagate(edges: DataFrame, values: DataFrame, message: Column, combine: Callable[[Column], Column], out: str = "message") -> DataFrame:
    """``id, out``: for each target, ``combine`` of the messages of its edges.

    ``message`` is an expression over the columns of ``values`` of an edge's source.
    """
    sent = edges.join(values, edges["src"] == values["id"]).select(F.col("dst").alias("id"), message.alias("_m"))
    return sent.groupBy("id").agg(combine(F.col("_m")).alias(out))


def active_edges(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges whose source is in the active set."""
    return edges.join(active.select(F.col("id").alias("src")), "src", "left_semi")


def initial_state(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, rank, delta, degree``: rank ``1 - 0.85``; delta the inverse out-degree, null without out-edges."""
    return degree(vertices, edges).select("id", F.lit(1 - DAMPING).alias("rank"), F.try_divide(F.lit(1.0), F.col("degree")).alias("delta"), "degree")


def pagerank_delta(vertices: DataFrame, edges: DataFrame, rounds: int, mode: str = "as_written", cut_every: int = 3) -> DataFrame:
    """``id, rank`` after ``rounds`` rounds.

    A round sums the messages that enter a vertex, ``rank = 0.15 + 0.85 * sum``.  In mode
    ``as_written`` the message of the first round is the inverse out-degree of the source, and after it
    the last sum of the source; in ``normalized`` it is the rank of the source over its out-degree.
    Vertices without in-edges have the sum 0.  No rounds give the first ranks.
    """
    if mode not in ("as_written", "normalized"):
        raise ValueError(mode)
    state = initial_state(vertices, edges)
    if rounds > 1:
        state = keep(state, "id")
        edges = keep(edges.select("src", "dst"), "src")
    degrees = state.select("id", "degree")
    for n in range(rounds):
        sums = propagate(edges, state, F.col("delta"), F.sum, "total")
        state = degrees.join(sums, "id", "left").select("id", "degree", F.coalesce("total", F.lit(0.0)).alias("total"))
        rank = BASE + DAMPING * F.col("total")
        delta = F.col("total") if mode == "as_written" else F.try_divide(rank, F.col("degree"))
        state = state.select("id", "degree", rank.alias("rank"), delta.alias("delta"))
        if n + 1 < rounds and (n + 1) % cut_every == 0:
            state = keep(state, "id")
    return state.select("id", "rank")


@dataclass
class Frontier:
    """What a loop over an active set gives: the last state, and the active vertices and their messages of each round."""

    state: DataFrame
    rounds: list[tuple[int, int]] = field(default_factory=list)


def pagerank_frontier(vertices: DataFrame, edges: DataFrame, bound: float = 1e-3, most_rounds: int = 100) -> Frontier:
    """PageRank of the normalized mode by what is still to be passed on (I1, P2, U3); the state is ``id, degree, rank, pending``.

    A vertex begins with the rank 0.15 and the same amount pending.  In a round the vertices with more than
    ``bound`` pending are active: only they send, 0.85 of it in equal shares, and what arrives adds to rank
    and pending.  Counts of active vertices and of their messages are observed while a round is
    written, and no active vertex ends the loop; vertices without out-edges never are.  A rank then lacks
    what is pending anywhere: all ranks together less than ``bound / 0.15`` a vertex.
    """
    degrees = degree(vertices, edges)
    edges = keep(edges.select("src", "dst"), "src", "frontier-edges")
    active = (F.col("pending") > bound) & (F.col("degree") > 0)

    def stored(df: DataFrame, old: DataFrame | None) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        counts = [F.count_if(active).alias("vertices"), F.sum(F.when(active, F.col("degree"))).alias("messages")]
        out = keep(df.observe(seen, *counts), "id", "frontier", instead_of=old)
        counted = observed(seen)
        return out, (counted.get("vertices", 0), counted.get("messages", 0))

    state, now = stored(degrees.select("id", "degree", F.lit(BASE).alias("rank"), F.lit(BASE).alias("pending")), None)
    found = Frontier(state)
    while now[0] and len(found.rounds) < most_rounds:
        found.rounds.append(now)
        arrived = propagate(edges, found.state.where(active), DAMPING * F.col("pending") / F.col("degree"), F.sum, "arrived")
        got = F.coalesce("arrived", F.lit(0.0))
        left = F.when(active, F.lit(0.0)).otherwise(F.col("pending")) + got
        new = found.state.join(arrived, "id", "left").select("id", "degree", (F.col("rank") + got).alias("rank"), left.alias("pending"))
        found.state, now = stored(new, found.state)
    drop(edges)
    return found
