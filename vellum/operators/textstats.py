"""Corpus statistics: sentences, n-grams, openers, sign-offs, phrases, entities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.scratch import lean, materialize, small_batches

#: Documents of a range whose ends one task orders.
PART = 50_000
#: Bins for n-grams, as a power of two, and how many of the fullest are counted first.
BIN_BITS, FIRST = 20, 1000


def sentence_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(key, F.explode(T.sentences(F.col(text))).alias("sentence"))
    return rows.select(key, F.size(T.words(F.col("sentence"))).alias("n_words"))


def order_statistics(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """For each name the value at place ``int(share * n)`` of the sorted values, exactly; one row.

    Only the counts of distinct values are ordered, so no task sorts the rows; their
    number is that of distinct lengths.
    """
    from pyspark.sql import Window

    counts = values.groupBy(column).agg(F.count("*").alias("c"))
    listed = counts.select(column, F.sum("c").over(Window.orderBy(column)).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    return listed.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col(column))).alias(name) for name, share in shares.items()])


def _plain(text: str) -> Column:
    """The words of a text, lower case, with one space between; one replacement for a run, as one for each character takes six times as long."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def across_documents(docs: DataFrame, n: int, key: str, text: str = "text", per_part: int = PART) -> DataFrame:
    """(t) for each document of ``docs``, in the order of ``key``, the words whose n-grams end in it and begin before it.

    These are its first n - 1 words after the n - 1 before it, so only the ends of each
    document are ordered, in ranges. A range passes its last words on to the next; one
    that has fewer passes on what came before it too. Of a range only these words
    come to the driver. Rows without words add nothing; a null key is the first.
    """
    w = n - 1
    plain = docs.select(F.col(key).alias("key"), _plain(text).alias("plain"))
    ends = plain.select("key", *[F.split(F.substring_index("plain", " ", k), " ").alias(name) for name, k in (("first", w), ("last", -w))])
    # written before they are placed, since ranges are sampled: else every text is read twice
    ends = materialize(ends, "ends").where(F.get("first", F.lit(0)) != "")
    parts = max(1, -(-ends.count() // per_part))
    placed = materialize(ends.repartitionByRange(parts, F.col("key").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "document-ends")

    def carried(words: list[str], group) -> Iterator[list[str]]:
        """What stands before each row, and in the end after the last."""
        for last in group.sort_values("key", kind="stable", na_position="first")["last"]:
            yield words
            words = [*words, *last][-w:]
        yield words

    def tail(key, group):
        import pandas as pd

        *_, words = carried([], group)
        return pd.DataFrame({"part": [key[0]], "words": [words]})

    halo, before = {}, []
    for r in sorted(placed.groupBy("part").applyInPandas(tail, "part int, words array<string>").collect()):
        halo[r.part] = before
        before = [*before, *r.words][-w:]

    def joined(key, group):
        import pandas as pd

        ordered = group.sort_values("key", kind="stable", na_position="first")
        return pd.DataFrame({"t": [[*words, *first] for words, first in zip(carried(halo[key[0]], group), ordered["first"], strict=False)]})

    return placed.groupBy("part").applyInPandas(joined, "t array<string>")


def _binned(plain, n: int):
    """Of a column of plain texts: the words that occur, the numbers of each n-gram's words in them (n, m), its bin by hash (m); none of stopwords alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pandas.util import hash_array

    lists = pc.split_pattern(plain.filter(pc.greater(pc.binary_length(plain), 0)), " ")
    words = lists.flatten().dictionary_encode()
    ids, known = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy()
    place = np.arange(len(ids))
    place = place[place + n <= np.repeat(np.cumsum(sizes), sizes)]
    grams = np.stack([ids[place + i] for i in range(n)])
    stop = pc.is_in(words.dictionary, pa.array(T.NGRAM_STOPWORDS)).to_numpy(zero_copy_only=False)
    grams = grams[:, ~stop[grams].all(axis=0)]
    word, h = hash_array(known, categorize=False), np.zeros(grams.shape[1], np.uint64)
    for row in grams:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[row]
    return known, grams, (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _bin_counts(n: int):
    """(bin, n): how many n-grams of a task's plain texts fall into each bin."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1 << BIN_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_binned(batch.column(0), n)[2], minlength=len(total))
        used = np.flatnonzero(total)
        for i in range(0, len(used), 1 << 16):
            part = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["bin", "n"])

    return lean(run)


def _spelt(n: int, wanted: bytes):
    """(ngram, n) of the n-grams of each batch of plain texts whose bin is wanted: a bit for each bin."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        want = np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)
        for batch in batches:
            known, grams, bins = _binned(batch.column(0), n)
            found = Counter(map(tuple, grams[:, want[bins]].T.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(known[list(g)]) for g in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["ngram", "n"])

    return lean(run)


def ngrams(docs: DataFrame, n: int = 3, top: int = 20, text: str = "text", across: str | None = None, first: int = FIRST) -> DataFrame:
    """Most frequent n-grams that are not all stopwords, within a document; ties by n-gram.

    ``across`` names a key by whose order the documents are one text, so that n-grams
    over their boundaries count too. No n-gram is more frequent than all of its bin, so
    the n-grams of the ``first`` fullest bins are counted by their words; the last of
    them that is asked for is a bound, and if other bins reach it, the n-grams of all that
    do are counted. A result that is short or flat counts every n-gram so.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(_plain(text).alias("plain"))
    if across and n > 1:
        rows = rows.unionByName(materialize(across_documents(docs, n, across, text).select(F.array_join("t", " ").alias("plain")), "across-documents"))
    bins = materialize(rows.mapInArrow(_bin_counts(n), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")), "ngram-bins")

    def most(chosen: DataFrame) -> DataFrame:
        """Counted n-grams of the bins; of the bins a bit each passes the driver."""
        import numpy as np

        bits = np.zeros(1 << BIN_BITS, bool)
        bits[chosen.select("bin").toPandas()["bin"].to_numpy(np.int64)] = True
        spelt = rows.mapInArrow(_spelt(n, np.packbits(bits).tobytes()), "ngram string, n long")
        return materialize(spelt.groupBy("ngram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ngram").limit(top), "ngrams")

    fullest = bins.orderBy(F.desc("n")).limit(first + 1).collect()
    found = most(bins.orderBy(F.desc("n"), "bin").limit(first))
    counts = [r.n for r in found.select("n").collect()]
    least = min(counts) if len(counts) == top else 0
    if len(fullest) > first and fullest[-1].n >= least:
        found = most(bins.where(F.col("n") >= least))
    return found.orderBy(F.desc("n"), "ngram")


def openers(docs: DataFrame, top: int = 10, text: str = "text") -> DataFrame:
    """Most frequent first five words of a document's first line that is no heading; ties by key."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    first = F.element_at(T.sentences(F.trim(F.get(lines, F.lit(0)))), 1)
    rows = docs.select(F.slice(T.words(first), 1, 5).alias("w")).where(F.size("w") >= 2)
    return rows.groupBy(F.array_join("w", " ").alias("opener")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "opener").limit(top)


def closers(docs: DataFrame, signs: list[str] = T.SIGN_OFFS, top: int = 10, text: str = "text", longest: int = 6) -> DataFrame:
    """Most frequent sign-offs: the last of a document's last five lines that opens with one of ``signs`` and is short."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    tail = F.reverse(F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), 5))
    hit = F.filter(tail, lambda x: x.rlike("(?i)^(" + "|".join(signs) + ")") & (F.size(T.words(x)) <= longest))
    return docs.select(F.get(hit, F.lit(0)).alias("closer")).where("closer is not null").groupBy("closer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "closer").limit(top)


def phrase_counts(docs: DataFrame, phrases: tuple[str, ...] = T.TELL_PHRASES, text: str = "text") -> DataFrame:
    """(phrase, n) of the phrases that occur, as they are written here, counted without overlap in any case; one pass."""
    sums = docs.select(F.lower(text).alias("x")).agg(*[F.sum(T.count_of(F.col("x"), p.lower())).alias(f"p{i}") for i, p in enumerate(phrases)])
    listed = F.array(*[F.struct(F.lit(p).alias("phrase"), F.coalesce(f"p{i}", F.lit(0)).alias("n")) for i, p in enumerate(phrases)])
    return sums.select(F.explode(listed).alias("e")).select("e.phrase", "e.n").where("n > 0")

