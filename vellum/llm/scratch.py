"""Size-checked joins and row filters of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.scratch import lean, materialize, scratch_dir, small_batches
from vellum.session import table

__all__ = ["documents", "filter_rows", "fresh", "keep_rows", "lean", "materialize", "scratch_dir", "sized", "small_batches"]

#: Rows of a key table that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a written table of narrow rows for broadcast if it has at most ``limit`` rows; else leave it to a shuffle."""
    limit = BROADCAST_ROWS if limit is None else limit
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df.hint("merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as set it apart from the columns of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def filter_rows(docs: DataFrame, keep, column: str = "text") -> DataFrame:
    """Rows of ``docs`` with all their columns for which ``keep(bytes, offsets)``, given a batch of texts, says so.

    Only the text goes to Python and only the decision comes back; a null counts as empty.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    from vellum.llm.textbytes import raw

    small_batches(docs.sparkSession)

    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([bool(x) for x in keep(*raw(texts))], pa.bool_())

    decide = lean(decide)
    decide.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(arrow_udf(decide, "boolean")(F.col(f"`{column}`")))


def keep_rows(docs: DataFrame, decided: DataFrame, text_key) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns.

    ``decided`` has a row (doc_id, text_key, kept) for each row of ``docs`` that was
    decided on, ``text_key`` being what the function of that name makes of a text (a
    null one as empty). Rows of equal doc_id and text stay or go together, and of
    those that stay and were decided on, one is left. Nulls match nulls; rows that
    share a doc_id with others are told apart by their text.
    """
    by_id, by_text, own = fresh(docs, "decided_id", "decided_text", "own_text")
    found = decided.groupBy(F.col("doc_id").alias(by_id), F.col("text_key").alias(by_text)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = materialize(found.where("not kept or n > 1"), "decisions")
    same_id = F.col("doc_id").eqNullSafe(F.col(by_id))
    ids = sized(materialize(found.select(by_id).distinct(), "decided-ids"))
    mixed = docs.join(ids, same_id, "left_semi").withColumn(own, text_key(F.coalesce(F.col("text"), F.lit(""))))
    same = same_id & (F.col(own) == F.col(by_text))
    stay = mixed.join(sized(materialize(found.where("not kept").select(by_id, by_text), "dropped-rows")), same, "left_anti")
    twice = materialize(found.where("kept").select(by_id, by_text), "repeated-rows")
    if twice.limit(1).count():
        twice = sized(twice)
        stay = stay.join(twice, same, "left_anti").unionByName(stay.join(twice, same, "left_semi").dropDuplicates(["doc_id", own]))
    return docs.join(ids, same_id, "left_anti").unionByName(stay.drop(own))
