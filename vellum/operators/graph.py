"""Links: resolution, reachability, personalised rank, version chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.text import link_basename, wikilinks
from vellum.scratch import materialize

#: Levels of a search that are planned as one job.
HOPS = 4
#: Runs of a file name that find it in a text.
HEAD_RUNS = 3
#: File names that are sent to every task; more are joined by a shuffle.
FEW = 50_000


def links(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, position, raw_target, target) of every wikilink."""
    return notes.select(key, F.posexplode(wikilinks(F.col(text))).alias("position", "raw_target")).withColumn("target", link_basename(F.col("raw_target")))


def resolve(found: DataFrame, basenames: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``resolved``: the target itself if it is a basename, else the basename of its alias; null if neither.

    ``basenames`` (basename) and ``aliases`` (alias, basename) may repeat: the least basename wins.
    """
    known = basenames.select(F.col("basename").alias("target"), F.col("basename").alias("by_name")).distinct()
    named = aliases.groupBy(F.col("alias").alias("target")).agg(F.min("basename").alias("by_alias"))
    return found.join(known, "target", "left").join(named, "target", "left").withColumn("resolved", F.coalesce("by_name", "by_alias")).drop("by_name", "by_alias")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth) of everything reachable from ``seeds`` (node) over ``edges`` (src, dst), each at its least depth.

    A frontier loop of HOPS levels a round: each level joins the one before with the
    edges and drops what was seen; the round's levels are written together, so that
    neither the plan nor the driver grows and the number of jobs is a part of the
    depth.
    """
    spark = edges.sparkSession
    kind = seeds.schema["node"].dataType
    edges = materialize(edges.select("src", F.col("dst").cast(kind).alias("dst")).distinct(), "edges")
    written = [materialize(seeds.select("node", F.lit(0).alias("depth")).distinct(), "reached")]
    level = 0
    while depth is None or level < depth:
        seen, last = reduce(DataFrame.unionByName, written), written[-1].where(F.col("depth") == level)
        levels = []
        for _ in range(HOPS if depth is None else min(HOPS, depth - level)):
            level += 1
            step = last.select("node").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            last = step.join(reduce(DataFrame.unionByName, [seen, *levels]).select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"))
            levels.append(last)
        written.append(materialize(reduce(DataFrame.unionByName, levels), "reached"))
        if not written[-1].where(F.col("depth") == level).limit(1).count():
            break
    return reduce(DataFrame.unionByName, written)


def version_reached(notes: DataFrame, name: str = "basename") -> Column:
    """Whether a name is a version of something: its stem differs from it. So any name with a version's tail is reached through its chain."""
    return T.stem(F.concat(F.col(name), F.lit(".md"))) != F.lower(name)


def with_siblings(notes: DataFrame, name: str = "basename") -> DataFrame:
    """Add ``has_sibling``: whether a note of another name has the same stem. Names are counted by stem before they are joined to the notes."""
    stem = T.stem(F.concat(F.col(name), F.lit(".md")))
    shared = notes.select(stem.alias("own_stem"), F.lower(name).alias("n")).groupBy("own_stem").agg((F.min("n") < F.max("n")).alias("has_sibling"))
    return notes.withColumn("own_stem", stem).join(shared, "own_stem", "left").withColumn("has_sibling", F.coalesce("has_sibling", F.lit(False))).drop("own_stem")


def reach(notes: DataFrame, reached: DataFrame, bound: list[str], unbound: list[str], name: str = "basename", strict: bool = False) -> DataFrame:
    """Add ``reach``: what saves a note from being an orphan, the first of wikilink, base, allow_list and version; null for an orphan.

    ``reached`` (node) are the names that links reach, ``bound`` the types that a base
    shows, ``unbound`` those that need none. A version's tail saves a note by itself;
    with ``strict``, only where another note has the same stem.
    """
    near = reached.select(F.col("node").alias("reached_name")).distinct().withColumn("linked", F.lit(True))
    rows = (with_siblings(notes, name) if strict else notes.withColumn("has_sibling", F.lit(True))).join(near, F.col(name) == F.col("reached_name"), "left").drop("reached_name")
    how = F.when(F.col("linked"), "wikilink").when(F.col("type").isin(bound), "base").when(F.col("type").isin(unbound), "allow_list").when(version_reached(notes, name) & F.col("has_sibling"), "version")
    return rows.withColumn("reach", how).drop("linked", "has_sibling")


def candidates(notes: DataFrame, names: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, name, whole) where a text holds a name's head: its first runs of letters, digits, dashes and underscores, HEAD_RUNS at most, and what is between them.

    ``whole``: the head is all of the name, so the name is mentioned.
    """
    beside, apart = f"[{T.BESIDE}]", f"[^{T.BESIDE}]"
    core = F.regexp_replace("name", rf"^{apart}+|{apart}+\z", "")
    head = F.regexp_extract(core, f"^{beside}+(?:{apart}+{beside}+){{0,{HEAD_RUNS - 1}}}", 0)
    heads = materialize(names.where(core != "").select("name", head.alias("head"), (head == F.col("name")).alias("whole")).distinct(), "name-heads")
    # by their files' size the texts may look small enough to be sent to every task
    heads = F.broadcast(heads) if heads.limit(FEW + 1).count() <= FEW else heads.hint("merge")
    # at the start of each run, it and the next k
    windows = [F.regexp_extract_all(text, F.lit(f"(?<!{beside})(?=({beside}++(?:{apart}++{beside}++){{{k}}}))"), F.lit(1)) for k in range(HEAD_RUNS)]
    # outer, else the optimizer finds all windows twice, to leave out texts without any
    tokens = notes.select(key, F.explode_outer(F.array_distinct(F.concat(*windows))).alias("head"))
    return tokens.join(heads, "head").select(key, "name", "whole")


def mentioned(notes: DataFrame, names: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(name, key) of the notes that mention a file name (``names``: name) standing on its own.

    Names are joined by their first runs, so names that begin alike do not meet in
    every text; only those with more runs, or other characters at an end, are matched
    with the text again. So the work follows the mentions.
    """
    near = candidates(notes, names, key, text)
    longer = near.where("not whole").join(notes.select(key, text).hint("merge"), key).where(T.mentions(F.col(text), F.col("name")))
    return near.where("whole").select("name", key).unionByName(longer.select("name", key)).distinct()


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, score) after a fixed number of rounds; mass of nodes without links is lost, as no rule says where it goes."""
    edges = edges.select("src", "dst").distinct()
    weights = materialize(edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src"), "weights")
    seeds = seeds.select("node").distinct()
    start = materialize(seeds.crossJoin(seeds.agg(F.count("*").alias("n"))).select("node", (1.0 / F.col("n")).alias("seed")), "seeds")
    score = start.withColumnRenamed("seed", "score")
    for turn in range(1, rounds + 1):
        moved = score.join(weights, score["node"] == weights["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("degree")).alias("in_score"))
        score = moved.join(start, "node", "full_outer").select("node", (damping * F.coalesce("in_score", F.lit(0.0)) + (1 - damping) * F.coalesce("seed", F.lit(0.0))).alias("score"))
        if turn % 4 == 0:
            score = materialize(score, "rank")
    return score


def chain_heads(previous: DataFrame, key: str, before: str) -> DataFrame:
    """(key, head, length): the newest version that each version leads to, by doubling the links to successors.

    ``previous`` has a row (key, before) for each version; the number of rounds grows
    with the logarithm of the longest chain. A version is done when its head was, and
    goes on only as long as another looks it up: one that none has as its head has no
    predecessor at twice the distance either. So rounds shrink, and none compares states.
    """
    jump = previous.select(F.col(before).alias("node"), F.col(key).alias("next")).where("node is not null")
    nodes = previous.select(F.col(key).alias("node"))
    last = F.col("next").isNull()
    state = materialize(nodes.join(jump, "node", "left").select("node", F.coalesce("next", "node").alias("head"), F.when(last, 0).otherwise(1).alias("length"), last.alias("done")), "heads")
    written, known = [state], state
    while written[-1].where("not done").limit(1).count():
        to = known.select(F.col("node").alias("via"), F.col("head").alias("far"), F.col("length").alias("more"), "done")
        left = written[-1].where("not done").select("node", F.col("head").alias("via"), "length").join(to, "via")
        moved = materialize(left.select("node", F.col("far").alias("head"), (F.col("length") + F.col("more")).alias("length"), "done", "via", "more"), "heads")
        written.append(moved)
        known = moved.select(state.columns).unionByName(moved.where("done").select(F.col("via").alias("node"), "head", F.col("more").alias("length"), "done"))
    return reduce(DataFrame.unionByName, [x.where("done").select("node", "head", "length") for x in written])
