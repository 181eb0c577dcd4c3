"""Near-duplicate groups by SimHash, with probes chosen by a generalised pigeonhole plan.

If two 64-bit fingerprints differ in at most r bits and the bits are dealt into m groups with thresholds
t_1..t_m (-1 or more) whose t_i + 1 add up to r + 1, the two differ by at most t_i bits in some group i.
Groups hold correlated bits, a dynamic program picks the thresholds (and m) that make the signatures and
the estimated candidate pairs cheapest, and every candidate is verified on all 64 bits. The plan changes
the cost only, never the links.

For near copies by a similarity of word shingles, fingerprints over distinct shingles are probed with a wider
radius, and candidates verified by a sketch that goes along: three more fingerprints and the number of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, slices, small
from tessera.llm.components import components

BITS = 64
#: Fingerprints from which the plan's candidate counts are estimated (a bound, taken by hash).
PLAN_SAMPLE = 2048
#: Members of a bucket that one step compares; larger buckets are split into pairs of blocks.
BLOCK = 4096
#: The same where candidates are verified by sketches: the wider radius has larger buckets.
SKETCH_BLOCK = 16384
#: Cost of a signature row (some microseconds) against a compared pair (some nanoseconds).
SIGNATURE_COST, PAIR_COST = 1.0, 0.0003
#: More fingerprints in a sketch, and the bits of all with the one that is probed.
MORE = ("s1", "s2", "s3")
SKETCH_BITS = BITS * (1 + len(MORE))
_SLICE = 1 << 16


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of ``text``: A-Z lower-cased, words between ASCII white space, with repeats.

    Fewer words than a shingle has: the whole sequence is the one shingle. No word: no shingle.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:e], seed) for a, e in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _SLICE):
        part = hashes[k : k + _SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of ``text`` over its shingles with repeats; 0 if it has no word."""
    return majority(shingle_hashes(text, words, seed))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """``hashes`` through the SplitMix64 finaliser, a different function for each ``k``."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketch(text: bytes, words: int = 5, seed: int = 42) -> list[int]:
    """SimHash over distinct shingles, as many more from other hashes as MORE names, and the number of shingles."""
    hashes = np.unique(shingle_hashes(text, words, seed))
    return [majority(hashes), *(majority(_mixed(hashes, k + 1)) for k in range(len(MORE))), len(hashes)]


def similar(apart: np.ndarray, a: np.ndarray | int, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether shingle sets of ``a`` and ``b`` members have the Jaccard ``similarity``, from differing sketch bits.

    Bits differ with the angle between the sets, whose cosine gives the members in common. No similarity is
    above the ratio of the sizes, so a pair that fails by size fails for certain.
    """
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    common = np.cos(np.pi * apart / SKETCH_BITS) * np.sqrt(a * b)
    return (np.minimum(a, b) >= similarity * np.maximum(a, b)) & (common >= similarity * (a + b - common))


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """The columns of ``docs`` without the text, and ``fingerprint`` (signed long). Null text: as empty."""
    name = free_name(docs, "fingerprint")
    return _printed(docs, text_col, [name], lambda text: [fingerprint(text, words, seed)])


def sketches(docs: DataFrame, text_col: str = "text", words: int = 5, seed: int = 42) -> DataFrame:
    """The columns of ``docs`` without the text, and the longs ``fingerprint, s1, s2, s3, shingles`` of ``sketch``."""
    names = [free_name(docs, c) for c in ("fingerprint", *MORE, "shingles")]
    return _printed(docs, text_col, names, lambda text: sketch(text, words, seed))


def _printed(docs: DataFrame, text_col: str, names: list[str], make: Callable[[bytes], list[int]]) -> DataFrame:
    rest = [c for c in docs.columns if c != text_col]
    slim = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").cast("binary").alias(names[0]))
    schema = slim.drop(names[0]).schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            made = np.array([make(t or b"") for t in texts], np.uint64).reshape(-1, len(names)).view(np.int64)
            own = [pa.array(made[:, k].copy()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], names=[*rest, *names])

    return slim.mapInArrow(run, schema)


@lru_cache(maxsize=64)
def flips(bits: tuple[int, ...], threshold: int) -> tuple[int, ...]:
    """The masks that change at most ``threshold`` of ``bits``."""
    return tuple(sum(1 << b for b in c) for k in range(threshold + 1) for c in combinations(bits, k))


def _ball(width: int, threshold: int) -> int:
    return sum(math.comb(width, k) for k in range(threshold + 1))


def group_bits(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """``m`` groups of bits, each grown from a free bit by the free bit most correlated with the group."""
    on = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    on -= on.mean(0)
    on /= np.maximum(np.sqrt((on**2).sum(0)), 1e-9)
    related, free, groups = np.abs(on.T @ on).round(6), list(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        group = [free.pop(0)]
        while len(group) < width:
            best = max(free, key=lambda b: (related[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(tuple(sorted(group)))
    return groups


def plan(sample: np.ndarray, n: int, radius: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Groups of bits and their thresholds for ``n`` fingerprints of which ``sample`` are some."""
    sample = np.asarray(sample, np.uint64)
    i, j = np.triu_indices(len(sample), 1)
    apart = sample[i] ^ sample[j]
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, radius + 2):
        groups = group_bits(sample, m) if len(sample) > 1 else [tuple(range(k, BITS, m)) for k in range(m)]
        costs = []
        for g in groups:
            own = np.bitwise_count(apart & np.uint64(sum(1 << b for b in g)))
            cost = {-1: 0.0}
            for t in range(min(3, radius) + 1):
                share = max(_ball(len(g), t) / 2.0 ** len(g), float((own <= t).mean()) if len(own) else 0.0)
                cost[t] = SIGNATURE_COST * n * _ball(len(g), t) + PAIR_COST * share * n * n / 2
            costs.append(cost)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, chosen) in table.items():
                for t, more in cost.items():
                    if (to := used + t + 1) <= radius + 1 and c + more < step.get(to, (math.inf,))[0]:
                        step[to] = (c + more, (*chosen, t))
            table = step
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], list(zip(groups, table[radius + 1][1], strict=True)))
    return [(g, t) for g, t in best[1] if t >= 0]


def link_bucket(rows: np.ndarray, radius: int, similarity: float | None = None) -> list[tuple[int, int]]:
    """Edges (fingerprint, root) that connect what is connected within ``radius`` in one bucket.

    ``rows`` are fingerprints, or with a ``similarity`` rows of fingerprint, more fingerprints and number of shingles,
    which then decide too. A search that removes what it reaches: a dense group costs its size times the few left
    outside. Members without a fingerprint near them are left out of it first.
    """
    rows = rows.reshape(len(rows), -1).view(np.uint64)
    rest, first = np.unique(rows[:, 0], return_index=True)
    left, step = np.zeros(len(rest), bool), max(1, (1 << 16) // len(rest))
    for k in range(0, len(rest), step):  # each pair once, a chunk against itself and what follows
        close = np.bitwise_count(rest[k : k + step, None] ^ rest[None, k:]) <= radius
        paired = close.sum(1) > 1
        if paired.any():
            left[k : k + step] |= paired
            left[k + step :] |= close[:, step:].any(0)
    rest, rows = rest[left], rows[first[left]]

    def near(u: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(rest ^ u[0])
        found = apart <= radius
        if similarity is not None and (at := np.flatnonzero(found)).size:
            more = np.bitwise_count(rows[at, 1:-1] ^ u[1:-1]).sum(1, dtype=np.int64)
            found[at] = similar(apart[at] + more, u[-1], rows[at, -1], similarity)
        return found

    edges: list[tuple[int, int]] = []
    while len(rest) > 1:
        root, todo = rest[0], [rows[0]]
        rest, rows = rest[1:], rows[1:]
        while todo and len(rest):
            found = near(todo.pop())
            if found.any():
                edges.extend((v, root) for v in rest[found])
                todo.extend(rows[found])
                rest, rows = rest[~found], rows[~found]
    return edges


def _linker(radius: int, similarity: float | None):
    def emit(edges: list) -> pa.RecordBatch:
        both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open bucket; batches come sorted by key
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
            if held is not None:
                rows = np.concatenate([held, rows])
            at = np.concatenate(([0], np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1))
            edges: list = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s > 1:
                    edges += link_bucket(np.ascontiguousarray(rows[s:e, 4:]), radius, similarity)
            held = rows[at[-1] :]
            if edges:
                yield emit(edges)
        if held is not None and (edges := link_bucket(np.ascontiguousarray(held[:, 4:]), radius, similarity)):
            yield emit(edges)

    return run


def near_links(distinct: DataFrame, radius: int = 4, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """Edges ``u, v`` that connect all fingerprints of ``distinct(fp)`` within ``radius`` bits.

    With a ``similarity``, ``distinct`` has the other columns of a sketch after ``fp``, and links have that similarity.
    Rows grow with members of buckets, not with pairs. A bucket with k > ``block`` members is dealt to
    every pair of its ceil(k / block) blocks, so that no step holds more than two blocks.
    """
    n, carried = distinct.count(), distinct.columns
    by_hash = distinct.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE)
    sample = np.array(sorted(r.fp for r in by_hash.collect()), np.int64).view(np.uint64)
    probes = [
        (k, _signed(sum(1 << b for b in bits)), _signed(flip))
        for k, (bits, t) in enumerate(plan(sample, n, radius))
        for flip in flips(bits, t)
    ]
    listed = F.array(*(F.struct(F.lit(k).alias("g"), F.lit(m).alias("mask"), F.lit(x).alias("flip")) for k, m, x in probes))
    signed = distinct.select(*carried, F.inline(listed)).select(
        "g", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key"), *carried
    )
    sizes = signed.groupBy("g", "key").count().filter(F.col("count") > block)
    hot = cut(sizes.select("g", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    if hot.isEmpty():
        dealt = signed.select("g", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), *carried)
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        dealt = (
            signed.join(small(hot), ["g", "key"], "left")
            .select("g", "key", *carried, F.coalesce("blocks", F.lit(1)).alias("blocks"))
            .select("g", "key", *carried, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("g", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *carried)
        )
    keys = ["g", "key", "x", "y"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linker(radius, similarity), "u long, v long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_groups(prints: DataFrame, by: str = "fingerprint", radius: int = 4, similarity: float | None = None) -> DataFrame:
    """``fp`` and ``root`` for each distinct fingerprint of ``prints`` that has a neighbour below its root.

    With a ``similarity``, ``prints`` are sketches; of sketches with one fingerprint the least speaks for all.
    """
    known = prints.filter(F.col(by).isNotNull())
    if similarity is None:
        links = near_links(cut(known.select(F.col(by).alias("fp")).distinct()), radius)
    else:
        least = known.groupBy(F.col(by).alias("fp")).agg(F.min(F.struct(*MORE, "shingles")).alias("least"))
        links = near_links(cut(least.select("fp", "least.*")), radius, SKETCH_BLOCK, similarity)
    return components(links).withColumnsRenamed({"node": "fp"})


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (long) and ``component_id``.

    ``component_id`` is the smallest id that links of at most ``radius`` bits reach, the row's own
    included. Repeated rows stay, null ids count only where a whole component has no other (then null),
    a null text is empty, an empty table gives an empty one, other columns are ignored.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = cut(fingerprints(keyed))
    of = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    rooted = of.join(
        small(cut(near_groups(prints, "fingerprint", radius))), F.col("fingerprint") == F.col("fp"), "left"
    ).select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    rooted = cut(rooted)
    # a fingerprint alone in its component needs no other's first id; the rest is one row a component
    sums = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    least = cut(sums.filter("n > 1").select("root", "least"))
    named = rooted.join(small(least), "root", "left").select("fingerprint", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(small(cut(named)), "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row of each component: the least by id, then by hash of the text.

    Without a ``similarity`` the links are those of ``simhash_groups``. With one, rows link whose fingerprints over
    distinct five-word shingles are within ``radius`` and whose sketches tell at least that similarity; texts without
    a word link with each other only.
    A row with a null id goes only if its component has one with an id. Columns and their order stay. Texts are
    exchanged once at most, to meet the ids that stay; of rows with equal ids and texts, which only are exchanged
    again, any one stays.
    """
    mark = free_name(docs, "text_hash")
    keyed = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    slim = keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(mark).alias("h"), F.col(f"`{text_col}`").alias("text"))
    prints = cut(fingerprints(slim) if similarity is None else sketches(slim))
    equal = prints.groupBy("fingerprint", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    of = equal.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "n")).alias("first"))
    groups = small(cut(near_groups(prints, "fingerprint", radius, similarity)))
    rooted = of.join(groups, F.col("fingerprint") == F.col("fp"), "left")
    stay = rooted.groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("first").alias("first"))
    stay_id, stay_h, stay_n = (free_name(keyed, c) for c in ("stay_id", "stay_hash", "stay_n"))
    stay = cut(stay.select(F.col("first.id").alias(stay_id), F.col("first.h").alias(stay_h), F.col("first.n").alias(stay_n)))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)) & (F.col(mark) == F.col(stay_h))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if stay.filter(F.col(stay_n) > 1).isEmpty():
        return keyed.join(small(stay), same, "left_semi").select(*own)
    once = keyed.join(small(stay.filter(F.col(stay_n) == 1)), same, "left_semi").select(*own)
    often = keyed.join(small(stay.filter(F.col(stay_n) > 1)), same, "left_semi")
    return once.unionByName(often.dropDuplicates([id_col, mark]).select(*own))
