"""Best-fit packing with several permitted sequence lengths.

A document of ``length`` tokens is cut into pieces of the largest capacity and a
rest. Pieces are dealt over shards of about ``SHARD`` pieces by a hash of their row's
number, so equal rows spread like all others; each shard
is packed on its own, longest piece first: a piece goes to the open bin with the
least room that still holds it. If none does, a bin of the capacity with the least
cost per token is opened among those that hold the piece, where the cost of a
capacity is ``cost(c)`` and counts against the tokens still to be packed. At the
end every bin is downsized to the smallest capacity that holds its contents.

A null or negative length counts as 0 and gives no piece. Repeated rows are packed
each; ties go by id and piece, and between equal rows in any order. Only the id and the length are read. At most SHARD-sized shards are held by
a task, as two arrays; the number of shards follows from a count of the pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import stored

CAPACITIES, SHARD = (512, 1024, 2048, 4096), 20_000


def cost(capacity: int) -> float:
    """Cost of a sequence: a fixed part, a part per token and the attention's square."""
    return 256 + capacity + capacity * capacity / 16384


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity of the bin) of each length, for lengths in falling order."""
    sizes = sorted(capacities)
    left = int(lengths.sum())
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for i, n in enumerate(lengths.tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / min(c, left), c))
            own = len(filled)
            filled.append(0)
            opened.append(room)
        bins[i], offsets[i] = own, filled[own]
        filled[own] += n
        left -= n
        if room > n:
            by_room.setdefault(room - n, []).append(own)
            rooms |= 1 << (room - n)
    held = np.array(sizes)[np.searchsorted(sizes, filled)] if filled else np.zeros(0, np.int64)
    return bins, offsets, held[bins] if len(bins) else held


def pack(docs: DataFrame, length: str, doc_id: str = "doc_id", capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start and n_tokens in the document; bin_id, bin_offset and capacity."""
    most = max(capacities)
    n = F.col("n")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    # Ids and lengths are written once: lengths are counted once, and the rows keep their numbers.
    d = stored(d, "packing-lengths").withColumn("row", F.monotonically_increasing_id())
    shards = max(1, -(-(d.agg(F.sum(F.ceil(n / most))).first()[0] or 0) // shard))
    d = d.filter(n > 0).select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / most) - 1)).alias("piece"))
    d = d.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), n - F.col("piece") * most).cast("long").alias("n_tokens"),
                 F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, held = best_fit(table.column("n_tokens").to_numpy(), capacities, cost)
        ids = bins + (table.column("shard").to_numpy() << 32)
        return table.select(["doc_id", "piece", "start", "n_tokens"]).append_column("bin_id", pa.array(ids)).append_column("bin_offset", pa.array(offsets)).append_column("capacity", pa.array(held.astype(np.int64)))

    return d.groupBy("shard").applyInArrow(packed, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece long, start long, n_tokens long, bin_id long, bin_offset long, capacity long")


def counted(docs: DataFrame, text: str = "text", length: str = "length") -> DataFrame:
    """The documents with ``length``: words between white space and one end token."""
    trimmed = F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return docs.withColumn(length, F.when(trimmed == "", 1).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+")) + 1))


def query(docs: DataFrame) -> DataFrame:
    return pack(counted(docs.select("doc_id", "text"), length="__length"), "__length")
