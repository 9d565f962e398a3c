"""Packing documents into training sequences of several permitted lengths, by variable-capacity best fit.

Documents are dealt into shards by a hash; a shard holds a bounded number of tokens and packs its pieces in one task, largest
first. A piece goes into the open bin that it leaves with the least room. Where none has room, every length that holds the piece
is tried on the sizes still to come: the bin is filled greedily from their histogram and shrunk to what that fills, and the
length of the least cost for each token held is opened. In the end every bin shrinks to the shortest length for its contents.
Beside this joint choice a shard tries each length as the least one to open, and keeps the cheapest of these packings.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.common import Scratch, free_name

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64  # what a sequence costs besides its tokens, in tokens
ATTENTION = 16_384  # length at which attention, which grows with the square, costs as much as all else
SHARD_TOKENS = 4_000_000
CHUNK = 1000  # repeated rows that one task numbers at a time


def words(text: str = "text") -> Column:
    """Tokens of a text, counted as its words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def sequence_cost(length: int) -> float:
    """What a sequence of this length costs to train on, in tokens: fixed, linear and quadratic parts."""
    return OVERHEAD + length + length * length / ATTENTION


def packed_by(sizes: list[int], order: list[int], lengths: tuple[int, ...], opened: Callable[[int, int], int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit of the sizes in this order; opened(nth, size) gives the length to open. (bin, offset) of each piece, and each bin's shortest length."""
    rooms: list[int] = []  # distinct amounts of room of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    filled: list[int] = []
    place = [(0, 0)] * len(sizes)
    for nth, i in enumerate(order):
        n = sizes[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del rooms[at], open_bins[room]
        else:
            b, room = len(filled), opened(nth, n)
            filled.append(0)
        place[i] = (b, filled[b])
        filled[b] += n
        if left := room - n:
            if left not in open_bins:
                open_bins[left] = []
                insort(rooms, left)
            open_bins[left].append(b)
    return place, [lengths[bisect_left(lengths, f)] for f in filled]


def best_fit(sizes: Iterable[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each piece, and each bin's length. Sizes are from 1 to the longest length; of equal sizes the first comes first."""
    sizes, lengths = list(sizes), tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    each = Counter(sizes)
    distinct = sorted(each)
    price = {c: cost(c) for c in lengths}

    def jointly(nth: int, n: int) -> int:
        top = bisect_left(distinct, n)
        left = each[n] - (nth - sum_before[n]) - 1  # pieces of this size still to come; all smaller ones are
        best = None
        for c in lengths[bisect_left(lengths, n) :]:
            used, hi = n, top + 1
            while used < c:
                hi = bisect_right(distinct, c - used, 0, hi) - 1
                if hi < 0:
                    break
                used += distinct[hi] * min(left if hi == top else each[distinct[hi]], (c - used) // distinct[hi])
            found = price[lengths[bisect_left(lengths, used)]] / used, c
            best = found if best is None else min(best, found)
        return best[1]

    sum_before, before = {}, 0  # how many pieces are larger than a size
    for d in reversed(distinct):
        sum_before[d] = before
        before += each[d]
    ways = [jointly] + [lambda _, n, least=least: max(least, lengths[bisect_left(lengths, n)]) for least in lengths]
    tried = (packed_by(sizes, order, lengths, way) for way in ways)
    return min(tried, key=lambda found: sum(price[c] for c in found[1]))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokens: Column | None = None, doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, first_token, n_tokens, bin_id, bin_length, bin_offset.

    tokens counts a row's tokens (its words by default; null or negative counts as 0). A very long document is cut into pieces
    of the longest length and a rest. Documents without tokens, null and empty texts among them, get one row with null
    bin columns. Rows with equal doc_ids are packed each on their own; a null doc_id stays null. Ties of sizes go by doc_id,
    piece and copy. No token is dropped or repeated; an empty table gives an empty one. Texts are read once: the number of rows
    of each id and count is written to the shared folder, and only that is shuffled. Repeated rows are numbered, in chunks
    that are spread over tasks, and the number takes part in the choice of the shard, so that no shard grows with them. The
    input's other columns play no part.
    """
    longest = max(lengths)
    counted = docs.select(F.col(doc_id).alias("id"), F.greatest((words() if tokens is None else tokens).cast("long"), F.lit(0)).alias("n"))
    counted = Scratch(docs.sparkSession, "packing").table(counted.groupBy("id", "n").agg(F.count("*").alias("rows")), "counted")
    total = counted.agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("rows"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    zero = F.lit(0).cast("long")
    few = counted.where(F.col("rows") <= CHUNK).select("id", "n", "rows", zero.alias("chunk"))
    many = counted.where(F.col("rows") > CHUNK).select("id", "n", "rows", F.explode(F.sequence(zero, F.ceil(F.col("rows") / CHUNK) - 1)).alias("chunk")).repartition("id", "n", "chunk")
    start = F.col("chunk") * CHUNK
    rows = few.union(many).select("id", "n", F.explode(F.sequence(start, F.least(start + CHUNK, F.col("rows")) - 1)).alias("copy"))
    cut = rows.select("id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)))).alias("piece"))
    first = F.col("piece") * longest
    pieces = cut.select("id", "copy", "piece", first.alias("first_token"), F.least(F.lit(longest), F.col("n") - first).cast("long").alias("n_tokens"))
    shard = F.pmod(F.xxhash64(F.lit("pack"), "id", "piece", "n_tokens", "copy"), F.lit(shards))
    kind = pieces.schema["id"].dataType
    fields = [("id", kind), *((c, T.LongType()) for c in ("piece", "first_token", "n_tokens", "bin_id", "bin_length", "bin_offset"))]
    order = [(c, "ascending") for c in ("id", "piece", "n_tokens", "copy")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        place, length = best_fit(table["n_tokens"].to_pylist(), lengths)
        base = table["shard"][0].as_py() << 32
        columns = {c: table[c] for c in ("id", "piece", "first_token", "n_tokens")}
        more = {"bin_id": [base + b for b, _ in place], "bin_length": [length[b] for b, _ in place], "bin_offset": [o for _, o in place]}
        return pa.table(columns | {k: pa.array(v, pa.int64()) for k, v in more.items()})

    dealt = pieces.where("n_tokens > 0").withColumn("shard", shard)
    packed = dealt.groupBy("shard").applyInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_length", "bin_offset")]
    return packed.unionByName(pieces.where("n_tokens <= 0").drop("copy").select("*", *nothing)).withColumnRenamed("id", doc_id)


def sequences(docs: DataFrame, packed: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: bin_id, bin_length, n_tokens and text, with pieces in bin order; for word tokens.

    doc_ids must be unique. Documents without tokens take no part.
    """
    own = free_name(packed, "words")
    joined = packed.where(F.col("bin_id").isNotNull()).join(docs.select(doc_id, F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0)).alias(own)), doc_id)
    piece = F.array_join(F.slice(own, F.col("first_token").cast("int") + 1, F.col("n_tokens").cast("int")), " ")
    held = F.array_sort(F.collect_list(F.struct("bin_offset", piece.alias("t"))))
    return joined.groupBy("bin_id", "bin_length").agg(F.sum("n_tokens").alias("n_tokens"), F.array_join(F.transform(held, lambda x: x["t"]), " ").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
