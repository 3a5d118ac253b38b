"""Near-duplicate join on word shingles, filtered under several global token orders.

Two sets whose Jaccard similarity reaches the threshold share a token among the first
``n - ceil(t n) + 1`` of each, whatever global order of tokens is taken. So a pair
must share such prefix tokens under every one of several orders.

The first order puts a set's own tokens first, which no set of a size that it may be
linked with has; then come tokens whose hash is below a bound, rare ones before
frequent ones; then the others by hash. Only tokens below the bound (a higher one for
small sets) are counted for it, since no prefix needs more: a set with enough tokens
of its own there has nothing else in its prefix and is linked with none, so most of a
corpus drops out with no pair made.
The postings of the other prefixes tie each set to the least one that shares a
token; the components of these ties are the blocks within which links can lie. Each
further order, by a hash of its own, keeps only the sets that share a prefix token
under it with another of their block: what is left has partners under every order. The
sets of a block meet in one task, or, beyond a number of tokens, those of every two of
its parts do. There a set's postings under one
order are intersected with the prefixes under the others, pair by pair, and what is
left is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.scratch import documents, keep_rows, lean, materialize, sized, small_batches
from vellum.llm.textbytes import U, classes, mix, raw, shingles, words

MEMBER = classes(True)
#: Tokens are counted below this many times the share of a set that may be missing from the other;
#: the bound rises by SMALL over the square root of the set's size.
COUNTED, SMALL = 1.4, 6.0
#: Bits of the filter for tokens of several sets; full, it passes all.
FILTER = 1 << 25
ORDERS = 3
#: Tokens of the sets of one part of a block; two parts meet in a task.
TASK_TOKENS = 500_000


def token_set(data: np.ndarray, k: int) -> np.ndarray:
    return shingles(words(data, MEMBER)[2], k)


def _ordered(tokens: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the tokens' hashes."""
    return (tokens ^ U(1 << 63)).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Mask of the prefix tokens under an order by hash."""
    size = prefix_size(len(tokens), percent)
    if size >= len(tokens):
        return np.ones(len(tokens), bool)
    rank = mix(tokens + U(order)) if order else tokens
    return rank <= np.partition(rank, size - 1)[size - 1]


def hash_bound(n: float | None, percent: int) -> int:
    """Tokens up to it may be a set's own if it has ``n`` tokens; without ``n``, tokens up to it are ordered by frequency."""
    share = COUNTED * (100 - percent) / 100 * (1 + (SMALL / n**0.5 if n else 0.0))
    return min((1 << 64) - 1, int(share * (1 << 64)))


def features(docs: DataFrame, id_type: str, k: int, percent: int, salt: int = 0) -> DataFrame:
    """Every document's set: doc_id, text_key, n_shingles, node (digest of the set; null if empty), proof (more of the digest),
    the bound for its own tokens, how many tokens are below it, and the counted tokens.

    Counted are those below the bound of the smallest set that it may be linked with, so
    that no set takes a token of a possible partner for its own, and a full prefix by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            size, node, proof, bounds, below, counted = [], [], [], [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                tokens = token_set(data[a:b], k)  # in the order of their hashes
                size.append(len(tokens))
                one, two = digest(tokens, salt)
                node.append(one if len(tokens) else None)
                proof.append(two if len(tokens) else None)
                n = len(tokens)
                bound = hash_bound(n, percent)
                bounds.append(bound - (1 << 63))
                below.append(int(np.searchsorted(tokens, U(bound), "right")))
                stop = int(np.searchsorted(tokens, U(hash_bound(n * percent / 100, percent)), "right")) if n else 0
                counted.append(_ordered(tokens[: max(stop, prefix_size(n, percent)) if n else 0]))
            values = np.concatenate(counted) if counted else np.zeros(0, np.int64)
            offsets = np.cumsum([0] + [len(p) for p in counted]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(proof, pa.int64()), pa.array(bounds, pa.int64()), pa.array(below, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "text_key", "n_shingles", "node", "proof", "bound", "below", "counted"])

    return docs.select("doc_id", "text", "text_key").mapInArrow(lean(run), f"doc_id {id_type}, text_key long, n_shingles long, node long, proof long, bound long, below int, counted array<long>")


def _shared_postings(found: DataFrame) -> DataFrame:
    """(token, node, df) of the counted tokens that several nodes have, each once; df is the number of nodes.

    Tokens that occur in several rows come from one aggregation; a bit filter of fixed
    size then keeps most other postings out of the exact count by nodes.
    """
    rows = found.where("node is not null")
    several = rows.select(F.explode("counted").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    words_of = several.selectExpr(f"cast((token & {FILTER - 1}) >> 5 as int) as word", "shiftleft(1L, cast(token & 31 as int)) as bit")
    bits = np.zeros(FILTER // 32, np.uint32)
    table = words_of.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER / 32 rows
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            at = tokens & (FILTER - 1)
            held = np.flatnonzero((bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1))
            nodes = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[held]), pa.array(nodes[held])], names=["token", "node"])

    passed = materialize(rows.select("node", "counted").mapInArrow(lean(run), "token long, node long").distinct(), "passed-postings")
    shared = passed.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return passed.join(shared.hint("merge"), "token")


def prefix_size_column(size: str, percent: int):
    return F.col(size) - F.floor((F.col(size) * percent + 99) / 100) + 1


def digest(tokens: np.ndarray, salt: int) -> tuple[int, int]:
    d = hashlib.sha256(bytes([salt]) + tokens.tobytes()).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def _gather(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of the groups ``which``, and where each group begins among them."""
    sizes = offsets[which + 1] - offsets[which]
    begins = np.cumsum(sizes) - sizes
    return np.repeat(offsets[which] - begins, sizes) + np.arange(int(sizes.sum())), begins


def _marked(mark: np.ndarray, flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many elements of each of the groups ``which`` (none empty) are marked."""
    if 2 * len(which) > len(offsets):  # nearly all: cheaper without gathering
        return np.add.reduceat(mark[flat].astype(np.int32), offsets[:-1])[which]
    at, begins = _gather(offsets, which)
    return np.add.reduceat(mark[flat[at]].astype(np.int32), begins)


def link(nodes: list[int], sets: list[np.ndarray], weight: list[int], side: list[int], percent: int, count: bool = True) -> list[tuple[int, int, int]]:
    """(node, least node connected with it, linked rows) of the nodes that have a link, among sets of one side or across two.

    Without ``count`` no two nodes that are already connected are compared, and the last number means nothing.
    """
    m = len(nodes)
    if m < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    rows, part = np.array(weight, np.int64), np.array(side)
    across = bool((part != part[0]).any())
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate(([0], np.cumsum(size)))
    chosen, begins = [], []
    for order in range(ORDERS):
        mask = np.concatenate([prefix(s, order, percent) for s in sets])
        chosen.append(place[mask])
        begins.append(np.concatenate(([0], np.cumsum(np.add.reduceat(mask.astype(np.int64), start[:-1])))))
    tokens = int(place.max()) + 1
    # postings of the first order: the nodes of each prefix token
    by = np.argsort(chosen[0], kind="stable")
    holder = np.repeat(np.arange(m), np.diff(begins[0]))[by]
    post = np.searchsorted(chosen[0][by], np.arange(tokens + 1))
    mark, seen = np.zeros(tokens, bool), np.zeros(m, bool)
    label, links = np.arange(m), np.zeros(m, np.int64)
    for i in range(m):
        seen[holder[_gather(post, chosen[0][begins[0][i] : begins[0][i + 1]])[0]]] = True
        near = np.flatnonzero(seen[i + 1 :]) + i + 1
        seen[:] = False
        near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
        if across:
            near = near[part[near] != part[i]]
        if not count:
            near = near[label[near] != label[i]]
        for order in range(1, ORDERS):  # the filters of all orders are intersected
            if not len(near):
                break
            own = chosen[order][begins[order][i] : begins[order][i + 1]]
            mark[own] = True
            near = near[_marked(mark, chosen[order], begins[order], near) > 0]
            mark[own] = False
        if not len(near):
            continue
        own = place[start[i] : start[i + 1]]
        mark[own] = True
        both = _marked(mark, place, start, near).astype(np.int64)
        mark[own] = False
        hit = near[100 * both >= percent * (size[near] + size[i] - both)]
        links[i] += rows[hit].sum()
        links[hit] += rows[i]
        if (label[hit] != label[i]).any():
            joined = np.unique(np.append(label[hit], label[i]))
            label[np.isin(label, joined)] = joined[0]
    linked = np.flatnonzero(links)
    least: dict[int, int] = {}
    for i in linked.tolist():
        least[int(label[i])] = min(nodes[i], least.get(int(label[i]), nodes[i]))
    return [(nodes[i], least[int(label[i])], int(links[i])) for i in linked.tolist()]


def _linker(percent: int, count: bool):
    """Rows (block, a, b, side, node, rows, tokens), those of one (block, a, b) together -> (node, root, links)."""

    def solved(found: list) -> pa.RecordBatch:
        once = {node: (side, rows, np.frombuffer(blob, U)) for side, node, rows, blob in found}
        nodes = sorted(once)
        out = link(nodes, [once[n][2] for n in nodes], [once[n][1] for n in nodes], [once[n][0] for n in nodes], percent, count)
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for block, a, b, *row in zip(*columns, strict=True):
                if key != (block, a, b):
                    if len(held) > 1:
                        yield solved(held)
                    key, held = (block, a, b), []
                held.append(row)
        if len(held) > 1:
            yield solved(held)

    return run


def _tie(rows: DataFrame) -> DataFrame:
    """(node, block): blocks of the nodes of ``rows`` (token, node) that shared tokens connect; a node without a partner has none."""
    shared = rows.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    ties = rows.join(shared.hint("merge"), "token").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    return materialize(components(ties, "ties").withColumnRenamed("root", "block"), "blocks")


def _partnered(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(node, block) of the sets that share a prefix token with another of their block under every further order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(blob, U) for blob in batch.column(1).to_pylist()]
            for order in range(1, ORDERS):
                first = [_ordered(s[prefix(s, order, percent)]) for s in held]
                nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in first])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), order), pa.int32()), pa.array(nodes, pa.int64()), pa.array(np.concatenate(first), pa.int64())], names=["order", "node", "token"])

    rows = sets.select("node", "tokens").mapInArrow(lean(run), "order int, node long, token long")
    rows = materialize(rows.join(sized(blocks), "node").select(F.struct("block", "order", "token").alias("key"), "node"), "order-prefixes")
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    held = rows.join(shared.hint("merge"), "key").select("node", F.col("key.order").alias("order")).distinct()
    whole = held.groupBy("node").agg(F.count("*").alias("orders")).where(F.col("orders") == ORDERS - 1)
    return materialize(blocks.join(whole.select("node").hint("merge"), "node"), "partnered-blocks")


def _prefixes(found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node) of the prefixes under the first order, of the sets that have one that is not all their own."""
    postings = materialize(_shared_postings(found), "shared-postings")
    common = hash_bound(None, percent) - (1 << 63)
    own = nodes.select("node", "size", "bound", "below")
    open_nodes = postings.join(own.hint("merge"), "node").groupBy("node", "size", "below").agg(F.count_if(F.col("token") <= F.col("bound")).alias("shared"))
    short = prefix_size_column("size", percent) - (F.col("below") - F.col("shared"))  # prefix tokens that are not the set's own
    open_nodes = open_nodes.select("node", short.alias("short")).where("short > 0")
    by = Window.partitionBy("node").orderBy(F.col("token") > common, F.when(F.col("token") <= common, F.col("df")), "token")  # over the tokens of one set
    ranked = postings.join(open_nodes.hint("merge"), "node").withColumn("place", F.row_number().over(by))
    return materialize(ranked.where("place <= short").select("token", "node"), "prefixes")


def _classes(docs: DataFrame, k: int, percent: int, task_tokens: int, count: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every row's set, the distinct sets, (node, root, links) of each task's linked ones, and (node, root) over all tasks."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    for salt in range(16):
        found = materialize(features(docs, id_type, k, percent, salt), "shingle-sets")
        groups = found.where("node is not null").groupBy("node").agg(F.min(row).alias("least"), F.count("*").alias("rows"), F.min("n_shingles").alias("size"), F.min("bound").alias("bound"), F.min("below").alias("below"), F.min("proof").alias("low"), F.max("proof").alias("high"))
        nodes = materialize(groups, "shingle-nodes")
        if not nodes.where("low <> high").limit(1).count():  # else two sets share a node; digest anew
            break

    blocks = _tie(_prefixes(found, nodes, percent))
    member = blocks.select("node").join(nodes.select("node", "least", "rows").hint("merge"), "node")
    member = materialize(member.select(F.col("node").alias("of"), F.col("least.doc_id").alias("least_id"), F.col("least.text_key").alias("least_key"), "rows"), "block-members")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(0))
            sets = [token_set(data[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True)]
            same = [i for i, (s, want) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if digest(s, salt)[0] == want]
            rest = [batch.column(j).take(pa.array(same, pa.int64())) for j in (1, 2)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(sets[i]) for i in same], pa.int64()), pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["node", "rows", "size", "tokens"])

    # by the text too, so that rows without a doc_id do not all meet
    texts = docs.join(sized(member), F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("least_key"))).select("text", "of", "rows")
    sets = materialize(texts.mapInArrow(lean(tokens), "node long, rows long, size long, tokens binary"), "block-sets")

    blocks = _partnered(sets, blocks, percent)
    sizes = sets.select("node", "size").distinct().join(blocks.hint("merge"), "node")
    parts = sizes.groupBy("block").agg(F.ceil(F.sum("size") / task_tokens).cast("long").alias("parts"))
    placed = materialize(blocks.join(parts.hint("merge"), "block").select(F.col("node").alias("of"), "block", "parts"), "block-parts")
    held = sets.join(sized(placed), F.col("node") == F.col("of")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long"))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("block", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "node", "rows", "tokens")
    met = met.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")
    links = materialize(met.mapInArrow(lean(_linker(percent, count)), "node long, root long, links long"), "links")
    if placed.where("parts > 1").limit(1).count():  # else each task has seen all of its nodes' links
        roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
    else:
        roots = links.select("node", "root")
    return found, nodes, links, roots


def _joined(docs: DataFrame, k: int, percent: int, task_tokens: int, count: bool) -> DataFrame:
    """doc_id, text_key, n_shingles, node, keep (the component's least row; null: alone) and links of every row."""
    found, nodes, links, roots = _classes(docs, k, percent, task_tokens, count)
    named = roots.join(nodes.select("node", "least", "rows").hint("merge"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("keep"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    linked = named.join(least.hint("merge"), "root").join(counted.hint("merge"), "node").select("node", "keep", (F.col("links") + F.col("rows") - 1).alias("links"))
    copies = nodes.where("rows > 1").join(linked.select("node").hint("merge"), "node", "left_anti").select("node", F.col("least").alias("keep"), (F.col("rows") - 1).alias("links"))
    table = sized(materialize(linked.unionByName(copies), "component-rows"))
    return found.select("doc_id", "text_key", "n_shingles", "node").join(table, "node", "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_shingles, component_id, n_links.

    Words are runs of anything but ASCII white space, A-Z taken as a-z; a set holds a
    text's distinct ``k``-word shingles, or of fewer words the whole sequence; a null
    or blank text has an empty set and is linked with nothing. Texts whose sets reach
    ``percent`` hundredths of Jaccard similarity are linked; component_id is the least
    doc_id reachable, n_links the number of other rows that a row is linked with.
    Equal sets are one node, so copies and repeated rows cost one comparison together
    and count by their number. A null doc_id is passed over as component_id if its
    component has another. Texts of any length are read whole. Other columns are
    ignored; an empty table gives an empty result.

    Every two different sets that pass the filters are compared, so a group of m near
    copies costs up to m * m / 2 comparisons, spread over tasks by two parts each.
    """
    rows = _joined(docs, k, percent, task_tokens, True)
    return rows.select("doc_id", "n_shingles", F.coalesce("keep.doc_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: of linked rows the one with the least doc_id.

    Of rows that share a doc_id each is told by its text, and of linked ones the least
    by a hash of the text stays; a null doc_id comes after all others. Null and blank
    texts are linked with nothing and all stay. An empty table stays empty; texts of
    any length and columns of any name pass through. Texts already connected are not
    compared again, so a group of near copies costs little more than its size.
    """
    rows = _joined(docs, k, percent, task_tokens, False).where("keep is not null")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_key") == F.col("keep.text_key"))
    return keep_rows(docs, rows.select("doc_id", "text_key", kept.alias("kept")), F.xxhash64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4, percent=85)
