"""Retrieval: vector search, reranking, routing, the cascade's first hit; and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.scratch import materialize, small_batches

# Words that tell a query's temporal intent.
CURRENT = ("current", "latest", "now", "today", "most recent", "live", "as it stands")
AS_OF = ("as of", "effective", "back when", "prior to", "before")
HISTORY = ("history", "historical", "evolved", "evolution", "changed", "previous", "predecessor", "how did", "how has", "version chain", "over time", "progression")

#: Queries that go with a task at a time.
QUERY_BLOCK = 8000
#: Vectors of one part in the search for pairs, and those that are scored against a part at a time.
PART, ROWS = 8000, 256


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", dim: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): for each query its ``k`` nearest other vectors by cosine, ties by key.

    Vectors of another length are left out. A stated query set meets all vectors in
    blocks of about QUERY_BLOCK queries; every task keeps its own best ``k`` for each
    query, and only these few are ranked against each other. Where there are several
    blocks, each one's result is written before the next comes to the driver.
    """
    import numpy as np

    small_batches(vectors.sparkSession)
    rows = vectors if dim is None else vectors.where(F.size(column) == dim)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    n = -(-asked.count() // QUERY_BLOCK)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def best_of(block: pd.DataFrame):
        ids, matrix = block.id.to_numpy(), unit(np.stack(block.v.to_list()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for batch in (b.iloc[i : i + 256] for b in batches for i in range(0, len(b), 256)):
                score = np.round(matrix @ unit(np.stack(batch.v.to_list())).T, 6)
                other = batch.id.to_numpy()
                score[ids[:, None] == other[None, :]] = -np.inf
                near = np.lexsort((np.broadcast_to(other, score.shape), -score), axis=1)[:, :k]
                found = pd.DataFrame({"query_id": np.repeat(ids, near.shape[1]), "id": other[near].ravel(), "score": np.take_along_axis(score, near, 1).ravel()})
                held = found if held is None else pd.concat([held, found])
                held = held[np.isfinite(held.score)].sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if held is not None:
                yield held

        return run

    out = None
    for i in range(n):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toPandas().sort_values("id")
        if len(block):
            more = rows.mapInPandas(best_of(block), "query_id long, id long, score double")
            more = materialize(more, "nearest-of-block") if n > 1 else more
            out = more if out is None else out.unionByName(more)
    if out is None:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # k rows for each task that read vectors
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "score", "rank")


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", column: str = "embedding", part: int = PART) -> DataFrame:
    """(a, b, score) of the pairs a < b whose cosine reaches the threshold.

    Blocked: vectors fall by key into parts of about ``part``; each pair of parts meets
    in one group, within which ROWS vectors at a time are scored as a matrix product, and
    only pairs that reach the threshold come out. Vectors travel as they are stored, once
    for each part. All pairs are what is asked for, so the work grows with the square of
    the vectors, what a group holds with the parameters only.
    """
    import numpy as np

    parts = max(1, -(-vectors.count() // part))

    rows = vectors.select(F.col(key).alias("id"), F.col(column).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    meet = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    spread = rows.select("id", "v", "part", F.explode(meet).alias("m")).select("id", "v", "part", "m.i", "m.j")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches)).drop_duplicates("id")
        left, right = group[group.part == group.i], group[group.part == group.j]
        if not len(left) or not len(right):
            return
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        of = lambda g: (g.id.to_numpy(), unit(np.stack(g.v.to_list()).astype(np.float64)))
        (ids, some), (others, all_) = of(left), of(right)
        same = group.i.iloc[0] == group.j.iloc[0]
        for at in range(0, len(ids), ROWS):
            s = np.round(some[at : at + ROWS] @ all_.T, 6)
            i, j = np.nonzero(s >= threshold)
            a, b, s = ids[at + i], others[j], s[i, j]
            keep = a < b if same else a != b
            a, b, s = a[keep], b[keep], s[keep]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": s})

    return spread.groupBy("i", "j").applyInPandas(score, "a long, b long, score double")


def greedy_cap(pairs: DataFrame, cap: int, top: int | None = None) -> DataFrame:
    """Pairs taken in falling order of score while neither side has ``cap``; ties by (a, b).

    Order-dependent by definition: a pass over the ordered candidates, with the counts
    of the sides seen. What is taken from the best pairs does not depend on the rest,
    so with ``top`` only the best ones are passed over, and more of them only while
    too few are taken.
    """

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        kept = 0
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if (top is None or kept < top) and seen.get(r.a, 0) < cap and seen.get(r.b, 0) < cap:
                    seen[r.a], seen[r.b] = seen.get(r.a, 0) + 1, seen.get(r.b, 0) + 1
                    kept += 1
                    rows.append(r)
            yield pd.DataFrame(rows, columns=["a", "b", "score"]).astype({"a": "int64", "b": "int64", "score": "float64"})

    schema, order = "a long, b long, score double", [F.desc("score"), F.asc("a"), F.asc("b")]
    pairs = pairs.select("a", "b", "score")
    if top is None:
        return pairs.repartition(1).sortWithinPartitions(*order).mapInPandas(take, schema)
    pairs = materialize(pairs, "scored-pairs")
    most, n = 50 * top, pairs.count()
    while True:
        found = materialize(pairs.orderBy(*order).limit(most).coalesce(1).sortWithinPartitions(*order).mapInPandas(take, schema), "taken-pairs")
        if most >= n or found.count() >= top:
            return found
        most *= 8


def see_also(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(key, block): a note's neighbours at or above the threshold as Markdown lines, best first."""
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("other"), "score").union(pairs.select("b", "a", "score")).where(F.col("score") >= threshold)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), F.col("other").alias("other"))))
    lines = F.transform("l", lambda x: F.concat(F.lit("- [["), x["other"].cast("string"), F.lit("]] (score "), F.format_number(-x["low"], 2), F.lit(")")))
    return both.groupBy("key").agg(listed.alias("l")).select("key", F.array_join(F.concat(F.array(F.lit("<!-- pipeline:see-also -->"), F.lit("## See also"), F.lit("")), lines, F.array(F.lit("<!-- /pipeline:see-also -->"))), "\n").alias("block"))


def lexical_score(query: Column, content: Column, longest: int = 4096) -> Column:
    """Share of a query's distinct words that the first ``longest`` characters hold: the offline stand-in for a cross-encoder."""
    asked = F.array_distinct(F.transform(T.words(query), F.lower))
    held = F.array_distinct(F.transform(T.words(F.substring(content, 1, longest)), F.lower))
    return F.round(F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1)), 6)


def rerank(candidates: DataFrame, score: Column, query: str = "query_id", tie: str = "path") -> DataFrame:
    by = Window.partitionBy(query).orderBy(F.desc("rerank_score"), tie)  # the candidates of one query
    return candidates.withColumn("rerank_score", score).withColumn("rerank_rank", F.row_number().over(by))


def best_lexical(queries: DataFrame, docs: DataFrame, k: int, longest: int = 4096) -> DataFrame:
    """(query_id, path, rerank_score, rerank_rank): for each of ``queries`` (query_id, query) the best ``k`` of all ``docs`` (path, text) by lexical_score, ties by path.

    The queries meet the documents in blocks of about QUERY_BLOCK; every task keeps its
    own best ``k`` for each query, so no pair is left out and none is shuffled but these.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    asked = queries.select("query_id", F.coalesce(F.array_distinct(F.transform(T.words("query"), F.lower)), F.array()).alias("words"))
    held = F.array_distinct(F.transform(T.words(F.substring(F.coalesce("text", F.lit("")), 1, longest)), F.lower))
    rows = docs.select(F.col("path").cast("long").alias("path"), held.alias("held"))
    n = -(-asked.count() // QUERY_BLOCK)

    def best_of(ids: np.ndarray, sizes: np.ndarray, has: np.ndarray, known: pa.Array):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, path = np.zeros((0, len(ids)), np.int32), np.zeros((0, len(ids)), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    lists = part.column(1)
                    place = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                    words = np.zeros((part.num_rows, len(known)), np.float32)
                    words[row[place >= 0], place[place >= 0]] = 1
                    count = np.concatenate((count, (words @ has).astype(np.int32)))
                    path = np.concatenate((path, np.broadcast_to(part.column(0).to_numpy()[:, None], (part.num_rows, len(ids)))))
                    best = np.lexsort((path, -count), axis=0)[:k]
                    count, path = np.take_along_axis(count, best, 0), np.take_along_axis(path, best, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(count))), pa.array(np.tile(sizes, len(count))), pa.array(path.ravel()), pa.array(count.ravel())], names=["query_id", "asked", "path", "shared"])

        return run

    out = rows.limit(0).select(F.col("path").alias("query_id"), F.lit(0).alias("asked"), "path", F.lit(0).alias("shared"))
    for i in range(n):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toPandas()
        at = {w: j for j, w in enumerate(sorted({w for words in block.words for w in words}))}
        has = np.zeros((len(at), len(block)), np.float32)
        for j, words in enumerate(block.words):
            has[[at[w] for w in words], j] = 1
        found = rows.mapInArrow(best_of(block.query_id.to_numpy(np.int64), block.words.map(len).to_numpy(np.int32), has, pa.array(list(at), pa.string())), "query_id long, asked int, path long, shared int")
        out = out.unionByName(found)
    score = F.round(F.col("shared") / F.greatest("asked", F.lit(1)), 6)
    return rerank(out, score).where(F.col("rerank_rank") <= k).select("query_id", "path", "rerank_score", "rerank_rank")


def route(query: Column) -> Column:
    """A current, B as of a date, C history, D none: B and C go before A; B with C is ambiguous."""
    q = F.lower(query)
    any_of = lambda words: q.rlike(r"\b(" + "|".join(words) + r")\b")
    b = any_of(AS_OF) | q.rlike(r"\bin (\d{4}|q[1-4])\b") | q.rlike(r"\bon \d{4}-\d{2}-\d{2}\b")
    c, a = any_of(HISTORY), any_of(CURRENT)
    return F.when(b & c, "AMBIGUOUS").when(b, "B").when(c, "C").when(a, "A").otherwise("D")


def first_hits(steps: list[tuple[str, DataFrame]], query: str = "query_id") -> DataFrame:
    """Hits of the first step that answers a query: (query, step, hit). Each step is a table (query, hit)."""
    tagged = None
    for place, (name, hits) in enumerate(steps):
        more = hits.select(query, "hit", F.lit(place).alias("place"), F.lit(name).alias("step"))
        tagged = more if tagged is None else tagged.unionByName(more)
    least = tagged.groupBy(query).agg(F.min("place").alias("place"))
    return tagged.join(least, [query, "place"]).select(query, "step", "hit").distinct()


def tier(n_steps: Column) -> Column:
    return F.when(n_steps >= 2, "normal").when(n_steps == 1, "low").otherwise("refuse")


def ir_metrics(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """One row of P@1, P@5, MRR, Recall@10 and NDCG@5 over rows (query, rank, relevant 0/1)."""
    gain = F.col("relevant") / F.log2(F.col("rank") + 1)
    upto = lambda k, x: F.sum(F.when(F.col("rank") <= k, x).otherwise(0.0))
    per = ranked.groupBy(query).agg(upto(1, F.col("relevant")).alias("p1"), (upto(5, F.col("relevant")) / 5).alias("p5"), F.coalesce(1 / F.min(F.when(F.col("relevant") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"), upto(10, F.col("relevant")).alias("found"), F.sum("relevant").alias("all"), upto(5, gain).alias("dcg"))
    ideal = F.expr("aggregate(sequence(1, 5), 0D, (s, i) -> s + if(i <= `all`, 1 / log2(i + 1), 0D))")
    mean = lambda x, name: F.round(F.avg(x), 6).alias(name)
    return per.agg(mean("p1", "p_at_1"), mean("p5", "p_at_5"), mean("rr", "mrr"), mean(F.when(F.col("all") > 0, F.col("found") / F.col("all")), "recall_at_10"), mean(F.when(F.col("all") > 0, F.col("dcg") / ideal), "ndcg_at_5"), F.count("*").alias("n_queries"))


def faithfulness(judged: DataFrame, question: str = "q_id") -> DataFrame:
    """(question, score, verdict, single_judge): the mean of the judges that answered; verdicts that differ are MIXED, none is deferred."""
    value = F.when(F.col("verdict") == "YES", 1.0).when(F.col("verdict") == "PARTIAL", 0.5).when(F.col("verdict") == "NO", 0.0)
    n, kinds = F.count("verdict"), F.collect_set("verdict")
    verdict = F.when(n == 0, "deferred").when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("MIXED")
    return judged.groupBy(question).agg(F.round(F.avg(value), 6).alias("score"), verdict.alias("verdict"), (n == 1).alias("single_judge"))
