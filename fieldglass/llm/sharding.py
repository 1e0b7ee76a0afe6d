"""Weighted rendezvous sharding, with DataFrame functions only.

Every (record key, shard) pair has a fixed pseudo-random number u in (0, 1]; a
record goes to the shard with the largest weight / -ln(u).  Adding a shard
only adds one more contender, so records move into the new shard or stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import free_name

#: Rows for which a slot is counted in one piece; the number of pieces follows the table.
ROWS_PER_PIECE = 20_000
#: Pieces a shard is counted in at most, so the table of offsets stays small enough to broadcast.
MAX_PIECES = 4_096


def _draw(key: Column, shard: int) -> Column:
    """-ln(u) of one contender: u from the first 48 bits of an MD5 of key and shard number."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 1.0) / float(1 << 48))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard number for ``key`` (a string; null counts as the empty key).

    Ties of the score, which need equal 48-bit draws, go to the lower shard.
    Weights must be positive.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive and not empty")
    key = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((_draw(key, i) / float(w)).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    best = scores[0] if len(scores) == 1 else F.least(*scores)
    return best["shard"].cast("int")


def shard_records(records: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of each record, and under ``grown`` the one it would have with one more shard of mean weight.

    A narrow map: nothing is shuffled.  Rows with equal keys share a shard;
    null keys count as one key.  An existing column of the same name is
    replaced.
    """
    out = records.withColumn(shard, rendezvous(F.col(key), weights))
    if grown:
        more = [*weights, sum(weights) / len(weights)]
        extra = F.coalesce(F.col(key).cast("string"), F.lit(""))
        costs = [_draw(extra, i) / float(w) for i, w in enumerate(more)]
        kept = reduce(lambda a, i: F.when(F.col(shard) == i, costs[i]).otherwise(a), range(len(weights)), F.lit(None).cast("double"))
        out = out.withColumn(grown, F.when(costs[-1] < kept, F.lit(len(weights))).otherwise(F.col(shard)).cast("int"))
    return out


def add_slots(sharded: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is cut into pieces by a hash of the order columns; a row's slot is
    its rank in its piece plus the sizes of the pieces before.  Only the table
    of piece sizes (shards times at most ``MAX_PIECES`` rows) is broadcast and
    ranked as a whole, so no task holds a shard.  Rows equal in all order
    columns are numbered in any order.
    """
    piece, rank, before, size = (free_name(sharded, n) for n in ("_piece", "_rank", "_before", "_size"))
    shards = sharded.agg(F.count(F.lit(1)), F.max(shard)).first()
    pieces = min(MAX_PIECES, max(1, -(-shards[0] // (ROWS_PER_PIECE * (1 + (shards[1] or 0))))))
    cut = sharded.withColumn(piece, F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    sizes = cut.groupBy(shard, piece).agg(F.count(F.lit(1)).alias(size))
    running = F.sum(size).over(Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(shard, piece, F.coalesce(running, F.lit(0)).alias(before))
    inner = F.row_number().over(Window.partitionBy(shard, piece).orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    ranked = cut.withColumn(rank, inner.cast("long"))
    return ranked.join(F.broadcast(offsets), [shard, piece]).withColumn(slot, (F.col(rank) + F.col(before)).cast("long")).drop(piece, rank, before)
