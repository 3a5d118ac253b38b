"""Personalised rank of many queries at once, by forward push with residuals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import entities
from vellum.scratch import materialize

#: Chance of going on at each step; no rule of the reference states one.
DAMPING = 0.85
#: Largest residual that a node may be left with.
LEAST = 1e-4
#: Rounds that are planned as the first job; the next has as many as are left by the pace of the first, but at most MOST_ROUNDS.
ROUNDS, MOST_ROUNDS = 12, 24
#: Queries that share a row of the state.
WIDTH = 8
#: Queries that are numbered together.
NUMBERED = 4096
#: Links of a node that lie in one row.
CHUNK = 4096
#: Links that are sent to every task; more are joined by a shuffle.
FEW_LINKS = 8_000_000
#: Names, or slots of queries, that are sent to every task; more are joined by a shuffle.
FEW_ROWS = 1_000_000

NO_SEED, ONE_SEED = "PPR skipped: no seeds resolved", "PPR skipped: one entity only"


def seeds_of(queries: DataFrame, stems: DataFrame) -> DataFrame:
    """(query_id, node) for every stem of ``stems`` (node) that stands as whole words in a query (``queries``: query_id, query), in any case."""
    asked = queries.select("query_id", F.lower("query").alias("query"))
    named = stems.select(F.col("node").alias("entity_id"), F.lower("node").alias("surface"))
    return entities.exact_matches(asked, named, "query_id", "query").select(F.col("key").alias("query_id"), F.col("entity_id").alias("node")).distinct()


def skip_reasons(queries: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, n_seeds, reason) of every query: why it is not ranked, or null. Only queries that name ``least`` entities ask how these connect."""
    n = seeds.groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    rows = queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"))
    return rows.withColumn("reason", F.when(F.col("n_seeds") == 0, NO_SEED).when(F.col("n_seeds") < least, ONE_SEED))


def _packed(links: DataFrame) -> DataFrame:
    """(origin, weight, to): links (origin, degree, damped, to) of a node as arrays of some CHUNK each."""
    deal = F.pmod(F.xxhash64("to"), F.ceil(F.col("degree") / CHUNK))
    return links.groupBy("origin", "degree", "damped", deal.alias("deal")).agg(F.collect_list("to").alias("to")).select("origin", (F.col("damped") / F.col("degree")).alias("weight"), "to")


def _sent(packed: DataFrame) -> DataFrame:
    """Links as every task gets them, or as a shuffle joins them if they are many."""
    n = packed.agg(F.sum(F.size("to"))).first()[0] or 0
    return F.broadcast(packed) if n <= FEW_LINKS else packed.hint("merge")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows.hint("merge")


def _slots(own: DataFrame) -> tuple[DataFrame, int]:
    """(query_id, share, block, place) of each query: the mass of each of its seeds, and where its numbers stand in the state; and how many blocks there are, about."""
    from pyspark.sql import Window

    n = own.select("query_id").distinct().count()
    group = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // NUMBERED) or 1))
    rows = own.groupBy("query_id").agg((1.0 / F.count("*")).alias("share")).withColumn("group", group)
    # some NUMBERED queries at a time
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy("query_id")) - 1)
    block = F.col("group") * (1 << 24) + F.floor(F.col("k") / WIDTH)
    return materialize(rows.select("query_id", "share", block.alias("block"), (F.col("k") % WIDTH).alias("place")), "push-slots"), -(-n // WIDTH) or 1


def push_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, least: float = LEAST, within: float | None = None) -> DataFrame:
    """(query_id, node, score, bound): personalised rank over ``edges`` (src, dst) from each query's ``seeds`` (query_id, node).

    Every node of a query holds a score and a residual. In a round each node keeps
    ``1 - damping`` of its residual as score and sends the rest to its links in equal
    parts; mass of nodes without links is lost. Scores never exceed the exact ones, and
    fall short of them by no more than ``bound``, the query's residual mass. Rounds go on
    until every residual is below ``least`` and, with ``within``, no query's bound
    exceeds it; their number follows the bound, not the size of the graph. Equal seeds
    of a query count once; a query without seeds has no row.

    State is keyed by node and block of WIDTH queries, whose numbers stand side by side,
    so that a link is followed once for all of them. Links go to every task, up to
    FEW_LINKS, and the state is dealt by block, so rounds move nothing. Only nodes that
    have links or are seeds take part in them; all others get their mass in the last
    step. A written table ends the lineage of ROUNDS rounds, then of those that are left.
    """
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "push-edges")
    own = materialize(seeds.select("query_id", "node").where("node is not null").distinct(), "push-seeds")
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    known = own.select("node").distinct().join(degree, "node", "full_outer")
    nodes = materialize(known.select("node", "degree", F.monotonically_increasing_id().alias("id")), "push-nodes")
    links = edges.join(nodes.select(F.col("node").alias("src"), "degree", F.col("id").alias("origin")), "src").join(nodes.select(F.col("node").alias("dst"), "id"), "dst", "left").withColumn("damped", F.lit(damping))
    links = materialize(links.select("origin", "degree", "damped", "id", "dst"), "push-weights")
    # a link of each node to itself carries over its score
    itself = nodes.select(F.col("id").alias("origin"), F.lit(0.0).alias("weight"), F.array("id").alias("to"), F.lit(True).alias("itself"))
    inner = _packed(links.where("id is not null").select("origin", "degree", "damped", F.col("id").alias("to"))).withColumn("itself", F.lit(False))
    inner = _sent(materialize(itself.unionByName(inner), "push-links"))
    outer = _sent(materialize(_packed(links.where("id is null").select("origin", "degree", "damped", F.col("dst").alias("to"))), "push-last-links"))

    slots, blocks = _slots(own)
    score, residual = [f"s{i}" for i in range(WIDTH)], [f"r{i}" for i in range(WIDTH)]
    share = [F.sum(F.when(F.col("place") == i, F.col("share")).otherwise(0.0)).alias(r) for i, r in enumerate(residual)]
    state = own.join(slots, "query_id").join(nodes.select("node", F.col("id").alias("at")), "node").groupBy("block", "at").agg(*share)
    state = state.select("block", "at", *[F.lit(0.0).alias(s) for s in score], *residual)
    sums = [F.sum(c).alias(c) for c in score + residual]
    by_block = lambda rows: rows.repartition(2 * blocks, "block")  # noqa: E731  twice as many, since blocks are hashed
    rounds, done = ROUNDS, 0
    while True:
        state = by_block(state)
        for _ in range(rounds):
            moved = state.join(inner, F.col("at") == F.col("origin")).withColumn("at", F.explode("to"))
            kept = [F.when(F.col("itself"), F.col(s) + (1 - damping) * F.col(r)).otherwise(0.0).alias(s) for s, r in zip(score, residual, strict=True)]
            state = moved.select("block", "at", *kept, *[(F.col("weight") * F.col(r)).alias(r) for r in residual]).groupBy("block", "at").agg(*sums)
        state = materialize(state, "push-state")
        rest = state.groupBy("block").agg(*[F.sum(r).alias(r) for r in residual], F.max(F.greatest(*residual)).alias("most"))
        most, bound = (x or 0.0 for x in rest.agg(F.max("most"), F.max(F.greatest(*residual))).first())
        if most < least and (within is None or bound <= within):
            break
        done += rounds
        # a round leaves no more than this share of the mass, as far as can be told
        pace = math.log(min(damping, bound ** (1 / done)))
        left = max(math.log(most / least), math.log(bound / within) if within else 0.0, 0.0)
        rounds = min(MOST_ROUNDS, max(1, 1 + math.ceil(left / -pace)))
    slots = _few(slots)
    at_place = lambda rows, names, value: rows.withColumn("of", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias(value)) for i, c in enumerate(names)]))).select("*", "of.place", f"of.{value}")
    bounds = _few(materialize(at_place(rest, residual, "bound").join(slots, ["block", "place"]).select("block", "place", "query_id", "bound"), "push-bounds"))
    named = state.join(_few(nodes.select(F.col("id").alias("at"), "node")), "at").select("block", "node", *score)
    last = by_block(state).join(outer, F.col("at") == F.col("origin")).select("block", F.explode("to").alias("node"), *[(F.col("weight") * F.col(s)).alias(s) for s in score])
    last = last.groupBy("block", "node").agg(*[F.sum(s).alias(s) for s in score])
    return at_place(named.unionByName(last), score, "score").where("score > 0").join(bounds, ["block", "place"]).select("query_id", "node", "score", "bound")


def best(ranked: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best nodes of each query, with ``rank`` by score at six digits; ties by node. ``sure`` says that no node below could pass the next by the bound."""
    from pyspark.sql import Window

    # the nodes that one query reached
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "node")
    # one more than asked for, so that every task drops the others before they are shuffled
    rows = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)
    rows = rows.withColumn("next", F.lead("score").over(Window.partitionBy("query_id").orderBy("rank")))
    return rows.where(F.col("rank") <= k).select("query_id", "node", "score", "bound", "rank", (F.col("score") - F.coalesce("next", F.lit(0.0)) > F.col("bound")).alias("sure"))
