"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many of a partition's rows go to each shard is drawn on the driver, partition by partition, from the
multivariate hypergeometric law: exactly the law of a uniform shuffle seen from the partitions. Rows are
permuted within their partition, dealt to shards by their place against the partition's row of the matrix,
exchanged, and permuted again within the shard.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, small

#: Rows of one block of a shard's second permutation, about.
BLOCK_ROWS = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, exact to floating point; walks out from the mode."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), lo), hi)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u = rng.random() - peak
    left, right, pl, pr = mode, mode, peak, peak
    while u >= 0:
        if left <= lo and right >= hi:
            return mode  # what rounding left over
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u < 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u < 0:
                return left
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each partition that go to each shard; rows add up to ``counts``, columns to ``sizes``."""
    rng, free, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest = [], sum(free)
        for k, room in enumerate(free):
            got = hypergeometric(rng, room, rest - room, n - sum(row)) if n > sum(row) else 0
            rest -= room
            row.append(got)
            free[k] -= got
        out.append(row)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    """Sizes that add up to ``n`` and differ by at most one, the larger first."""
    return [n // shards + (k < n % shards) for k in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 29) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0 to the shard's size - 1); law ``rows``.

    Every assignment that keeps the sizes (at most one apart) is equally likely, and so is every order
    within a shard, as far as the generators go; the seed and the partitions of ``df`` decide. Nulls,
    repeated rows and ties play no part, since rows are told apart by their place; names that ``df`` has
    already get underscores before them. An empty table stays empty. The driver holds shards numbers a
    partition, which go to the executors as one row a partition. Very long texts are moved, never looked at.
    """
    at, shard, slot = (free_name(df, c) for c in ("place", "shard", "slot"))
    part, pos = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    first = free_name(df, "first_order")
    # local permutation: a seeded random number a row; the id counts rows in the new order within each partition
    mixed = df.withColumn(first, F.rand(seed)).sortWithinPartitions(first).withColumn(at, F.monotonically_increasing_id()).drop(first)
    placed = cut(mixed)  # from here on places stand, whatever is computed again
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shard_sizes(total, shards), seed)
    # a row of the matrix for each partition, as running sums; a row's place among them tells its shard
    of, ends = free_name(df, "matrix_part"), free_name(df, "matrix_ends")
    listed = [(p, list(accumulate(row))) for p, row in zip(order, matrix, strict=True)]
    table = df.sparkSession.createDataFrame(listed, f"`{of}` long, `{ends}` array<long>")
    joined = placed.join(small(table), part == F.col(of))
    dealt = joined.withColumn(shard, F.size(F.filter(F.col(ends), lambda e: e <= pos)).cast("int")).drop(of, ends)
    # second permutation: random blocks of a shard, then a random order within the block
    blocks = 1 << max(5, math.ceil(math.log2(max(total, 1) / shards / BLOCK_ROWS + 1e-9)) if total else 5)
    block, key, before = (free_name(df, c) for c in ("block", "second_order", "block_start"))
    dealt = dealt.withColumn(key, F.xxhash64(F.lit(seed + 1), F.col(at)))
    dealt = dealt.withColumn(block, F.shiftrightunsigned(F.col(key), 64 - int(math.log2(blocks))).cast("int"))
    sizes = dealt.groupBy(shard, block).agg(F.count(F.lit(1)).alias(before))
    running = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, block, F.coalesce(F.sum(before).over(running), F.lit(0)).alias(before))
    starts = F.broadcast(starts) if shards * blocks <= 200_000 else starts  # shards * blocks rows at most
    nth = F.row_number().over(Window.partitionBy(shard, block).orderBy(key, at)) - 1
    done = dealt.join(starts, [shard, block]).withColumn(slot, (F.col(before) + nth).cast("long"))
    return done.select(*(F.col(f"`{c}`") for c in df.columns), shard, slot)


def document_shards(docs: DataFrame, shards: int = 8, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1; a null text has none and the crc32 of no bytes. The law is
    ``rows``, so ``grown_shard`` is null; equal texts are shuffled like others.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    made = shuffle_into_shards(slim, shards, seed)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
