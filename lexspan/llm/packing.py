"""Problem 8: assign texts of varying length to containers of fixed capacity.

Texts above the capacity are cut into full pieces and a rest; no other text is cut. Items are dealt
into buckets by the hash of their id and row, as many as the total size asks for, so that a bucket's size
does not depend on how sources or copies are spread. Within a bucket, items are placed largest first
by conflict-constrained best fit: containers are ordered by the space left and carry bitmaps of
the sources and of the clusters of copies they hold; the successor search goes from the tightest
container that is large enough to the next until one is compatible.

A container holds no two copies of one text while there are as many containers as copies; beyond
that copies are spread evenly. Sharing a container within a source is avoided, but never at the
price of another container. Buckets close their own containers: with the default size, one
container in a thousand may be partly empty for that.

Defined results: null and empty texts have no tokens; they are assigned too, with an empty range,
and are in no cluster. Every row is assigned, repeated rows as often as they come; null sources and
ids are ordinary values.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .tokenize import count_tokens

#: Containers that a bucket is meant to fill, and rows it may have however small they are.
BUCKET_CONTAINERS, BUCKET_ROWS = 1024, 60_000


def cut_sizes(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) in tokens of the pieces of a text of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    return [(a, min(a + capacity, n)) for a in range(0, n, capacity)]


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The container of each (size, source, cluster or None)."""
    total = sum(size for size, _, _ in items)
    least = max(1, -(-total // capacity))
    copies = Counter(c for _, _, c in items if c is not None)
    allowed = {c: -(-n // least) for c, n in copies.items() if n > 1}
    cluster_bit = {c: 1 << i for i, c in enumerate(allowed)}
    source_bit: dict[object, int] = {}
    levels: dict[int, list[int]] = {}  # space left: containers, oldest first
    ladder = 0  # bitmap of the levels in use
    sources: list[int] = []
    clusters: list[int] = []  # bitmap of the clusters a container has its full share of
    held: list[Counter] = []
    out = [0] * len(items)
    for at in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[at]
        mine = source_bit.setdefault(source, 1 << len(source_bit))
        bit = cluster_bit.get(cluster, 0) if cluster is not None else 0
        chosen = spare = -1
        space = spare_space = 0
        rest = ladder >> size
        level = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            level += step
            for k in levels[level]:
                if not clusters[k] & bit:
                    if not sources[k] & mine:
                        chosen, space = k, level
                        break
                    if spare < 0:
                        spare, spare_space = k, level
            if chosen >= 0:
                break
            rest >>= step + 1
            level += 1
        if chosen < 0 and spare >= 0:
            chosen, space = spare, spare_space
        if chosen < 0:
            chosen, space = len(sources), capacity
            sources.append(0)
            clusters.append(0)
            held.append(Counter())
        else:
            row = levels[space]
            row.remove(chosen)
            if not row:
                del levels[space]
                ladder &= ~(1 << space)
        sources[chosen] |= mine
        if bit:
            held[chosen][cluster] += 1
            if held[chosen][cluster] >= allowed[cluster]:
                clusters[chosen] |= bit
        left = space - size
        levels.setdefault(left, []).append(chosen)
        ladder |= 1 << left
        out[at] = chosen
    return out


def pack(documents: DataFrame, capacity: int, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", directory: str | None = None) -> DataFrame:
    """(container_id, id, piece_no, token_start, token_end, n_tokens, container_offset) of every piece.

    Texts are read once, to be counted; what is shuffled is an id, a source, a hash and a size of each.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("cluster"), F.col(text_col).alias("text"))
    counted = cut(count_tokens(rows, ["id", "source", "cluster"], tokenizer, "text", directory))
    tokens, n_rows = counted.agg(F.coalesce(F.sum(F.col("n_tokens").cast("bigint")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-tokens // (capacity * BUCKET_CONTAINERS)), -(-n_rows // BUCKET_ROWS))
    # the row's place spreads rows of one id, or without any, over the buckets like all others
    placed = counted.withColumn("row", F.monotonically_increasing_id())
    return pack_sized(placed, capacity, int(buckets)).withColumnRenamed("id", id_col)


def pack_sized(counted: DataFrame, capacity: int, buckets: int) -> DataFrame:
    """The packing of (id, source, cluster, n_tokens, row) rows in a given number of buckets."""
    import pyarrow as pa

    cuts = F.expr(f"sequence(0, greatest(0, int((n_tokens - 1) div {capacity})))")
    pieces = counted.select("id", "source", "cluster", "row", "n_tokens", F.explode(cuts).alias("piece")).select(
        "id", "source", "cluster", "row",
        (F.col("piece") + 1).cast("int").alias("piece_no"),
        (F.col("piece") * capacity).cast("int").alias("token_start"),
        F.least((F.col("piece") + 1) * capacity, F.col("n_tokens")).cast("int").alias("token_end"),
    )
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "row", "piece_no"), F.lit(buckets)).cast("int"))
    kind = counted.schema["id"].dataType.simpleString()
    schema = f"container_id bigint, id {kind}, piece_no int, token_start int, token_end int, n_tokens int, container_offset int"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("row", "ascending"), ("piece_no", "ascending")])
        cols = {c: table.column(c).to_pylist() for c in ("source", "cluster", "token_start", "token_end", "bucket")}
        sizes = [b - a for a, b in zip(cols["token_start"], cols["token_end"])]
        # a full piece needs a container of its own, and nothing is without tokens and in a cluster
        items = [(n, s, c if n else None) for n, s, c in zip(sizes, cols["source"], cols["cluster"])]
        where = best_fit(items, capacity)
        base = (cols["bucket"][0] if cols["bucket"] else 0) << 32
        offset: Counter = Counter()
        starts = []
        for k, n in zip(where, sizes):
            starts.append(offset[k])
            offset[k] += n
        return pa.table(
            [pa.array([base + k for k in where], pa.int64()), table.column("id"), table.column("piece_no").cast(pa.int32()), table.column("token_start").cast(pa.int32()), table.column("token_end").cast(pa.int32()), pa.array(sizes, pa.int32()), pa.array(starts, pa.int32())],
            names=["container_id", "id", "piece_no", "token_start", "token_end", "n_tokens", "container_offset"],
        )

    return pieces.groupBy("bucket").applyInArrow(one, schema)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, free space and its share."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (F.count("*") * capacity - F.sum("used")).alias("free"),
        (1 - F.sum("used") / (F.count("*") * capacity)).alias("free_share"),
    )
