"""Benchmark decontamination by SimHash of item-sized windows and multi-index Hamming blocks.

Text and items become lower-case words without ASCII punctuation. A window of a document has the size, in
shingles, of some item, and is cut at the text's ends. Windows are laid where the document has shingles of items:
only those with GATE of the weight of the lightest item of their size can matter. The 64-bit fingerprint of a
window over its weighted shingles is looked up in BLOCKS tables of the items' fingerprints, one for each block of
bits. Fingerprints RADIUS or fewer bits apart are RADIUS // BLOCKS or fewer apart in some block; the tables hold
each item under all keys up to some bits away, and the keys up to the rest of the bits away are probed, so every item
within the radius is found. These candidates are verified by the exact weighted Jaccard similarity, for windows of
any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, slices

SHINGLE, SIMILARITY = 5, 0.8
#: A similarity of 0.8 puts the fingerprints of an item and a window of its size about 10 bits apart (deviation 3), or
#: 13 where words were put in all over; unrelated texts are 32 apart.
RADIUS, BLOCKS = 19, 4
#: Entries of the tables of a pass, about. The more bits the items' keys are changed by, the fewer keys need probing;
#: how the bits are shared changes the cost only.
ENTRIES = 12_000_000
#: Share of an item's weight that a window of its size has in shingles of items, at least, if a window of any length
#: within a similarity of 0.8 begins or ends where it does (0.75 if all shingles weigh alike).
GATE = 0.6
#: Digits that similarities are rounded to, so that sums in another order come out alike.
DIGITS = 9
#: Windows of a document and an item that are held at once (of one start at least); windows that are probed at once;
#: shingles of a document whose windows' fingerprints are held at once.
WINDOWS, PROBED, STRETCH = 200_000, 256, 1 << 14
#: Items, and characters of items, whose index is sent to the executors at once; more items take more passes.
PASS_ITEMS, PASS_CHARS = 20_000, 16_000_000
_TO_SPACE = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_WIDTH = 64 // BLOCKS
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


@cache
def _flips(most: int) -> np.ndarray:
    """The masks that change at most ``most`` bits of a block."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(_WIDTH), k)], np.uint16)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def _shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of SHINGLE word ids; ids are odd multiples of their own, so order counts."""
    n = len(ids) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h = (h ^ ids[k : k + n]) * _MIX[k]
            h ^= h >> np.uint64(29)
    return h


def _item_hashes(text: str | None) -> np.ndarray:
    """The shingles of an item's text, repeats included."""
    ids = np.array([xxhash.xxh64_intdigest(w, 5) | 1 for w in words_of(text or "")], np.uint64)
    return _shingle_hashes(ids) if len(ids) >= SHINGLE else ids[:0]


@dataclass
class Spread:
    """The number of items with shingles, and of those that have a shingle, for each that several have, in order.

    A shingle of one item weighs as much as one of none, so that shingles of other passes need no entry.
    """

    items: int
    shingles: np.ndarray
    counts: np.ndarray

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """1 + ln(items / items that have it) for each shingle."""
        rare = 1.0 + math.log(max(self.items, 1))
        if not len(self.shingles):
            return np.full(len(hashes), rare)
        at = np.searchsorted(self.shingles, hashes).clip(max=len(self.shingles) - 1)
        return np.where(self.shingles[at] == hashes, rare - np.log(self.counts[at]), rare)


def spread_of(items: list[tuple[int, str]]) -> Spread:
    own = [np.unique(h) for _, text in items if len(h := _item_hashes(text))]
    shingles, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64),) * 2
    return Spread(len(own), shingles[counts > 1], counts[counts > 1])


class Index:
    """The items of one pass: ``(item_id, text)`` pairs.

    An item of fewer than SHINGLE words is one shingle of all its words, which only a text of the same words
    has; it isn't counted among the items that weights are made from. Other shingles weigh
    1 + ln(items / items that have it), times its repeats; ``spread`` counts the items of all passes
    (by default these are all).
    """

    def __init__(self, items: list[tuple[int, str]], spread: Spread | None = None):
        self.spread = spread_of(items) if spread is None else spread
        self.vocab: dict[bytes, int] = {}
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        made = []
        for item, text in items:
            words = words_of(text or "")
            if len(words) >= SHINGLE:
                made.append((item, _shingle_hashes(np.array([self._id(w) for w in words], np.uint64))))
            elif words:
                self.short.setdefault(tuple(words), []).append(item)
        self.known = np.unique(np.concatenate([hs for _, hs in made] or [np.zeros(0, np.uint64)]))
        self.known_weight = self.spread.weights(self.known)
        self.ids = [item for item, _ in made]
        #: For each item its distinct shingles as numbers into ``known``, in order, and their repeats.
        self.items = [np.unique(np.searchsorted(self.known, hs), return_counts=True) for _, hs in made]
        self.sizes = np.array([c @ self.known_weight[at] for at, c in self.items])
        self.prints = np.array([self._print(hs) for _, hs in made], np.uint64)
        #: The items' sizes in shingles, and the weight of the lightest item of each.
        lengths = np.array([len(hs) for _, hs in made], np.int64)
        self.lengths = np.unique(lengths)
        self.lightest = np.array([self.sizes[lengths == n].min() for n in self.lengths.tolist()])

    @property
    def item_flips(self) -> int:
        """Bits that the items' keys are changed by, of the RADIUS // BLOCKS to be borne."""
        fits = [f for f in range(RADIUS // BLOCKS + 1) if len(_flips(f)) * len(self.items) * BLOCKS <= ENTRIES]
        return max(fits, default=0)

    @cached_property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block of bits, where the items of each key begin, and the items by key; made by the worker that probes."""
        out, flips = [], _flips(self.item_flips)
        for k in range(BLOCKS):
            own = (self.prints >> np.uint64(_WIDTH * k)).astype(np.uint16)
            keys = (own[:, None] ^ flips).ravel()
            item = np.repeat(np.arange(len(own), dtype=np.int32), len(flips))
            out.append((np.append(0, np.cumsum(np.bincount(keys, minlength=1 << _WIDTH))), item[np.argsort(keys, kind="stable")]))
        return out

    def within_radius(self, prints: np.ndarray) -> np.ndarray:
        """The items whose fingerprints are RADIUS or fewer bits from one of ``prints``, by the blocks; in order."""
        found, flips = [], _flips(RADIUS // BLOCKS - self.item_flips)
        for at in range(0, len(prints), PROBED):
            part = prints[at : at + PROBED]
            for k, (first, items) in enumerate(self.blocks):
                keys = ((part >> np.uint64(_WIDTH * k)).astype(np.uint16)[:, None] ^ flips).astype(np.int64)
                begin, sizes = first[keys], first[keys + 1] - first[keys]
                window = np.repeat(np.arange(len(part)), sizes.sum(1))
                sizes, begin = sizes.ravel(), begin.ravel()
                item = items[np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)]
                found.append(np.unique(item[np.bitwise_count(part[window] ^ self.prints[item]) <= RADIUS]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def windows(self, hits: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, in shingles, of the windows to probe in a text of ``n`` shingles.

        ``hits`` are the places of shingles that items have, in order, and ``weights`` theirs. A window begins or ends
        with one, and is of an item's size or cut at the text's ends.
        """
        known, none = np.append(0, np.cumsum(weights)), np.zeros(0, np.int64)
        least = GATE * self.lightest - 1e-9
        if known[-1] < least.min():
            return none, none
        longest, out = int(self.lengths[-1]), [none]
        for before in (0, 1):  # windows that begin with a hit, then those that end with one
            reach = hits + 1 - longest if before else hits + longest
            wide = known[1:] - known[np.searchsorted(hits, reach)] if before else known[np.searchsorted(hits, reach)] - known[:-1]
            some = hits[wide >= least.min()]
            step = max(1, WINDOWS // len(least))
            for k in range(0, len(some), step):
                at = some[k : k + step, None]
                begin, end = (np.maximum(at + 1 - self.lengths, 0), at + 1) if before else (at, np.minimum(at + self.lengths, n))
                have = known[np.searchsorted(hits, end)] - known[np.searchsorted(hits, begin)]
                out.append((begin * (n + 1) + end)[have >= least])
        both = np.unique(np.concatenate(out))
        return both // (n + 1), both % (n + 1)

    def window_prints(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The fingerprints of the windows [begin, end) of a text's shingles; begins are in order."""
        out, at = np.zeros(len(begin), np.uint64), 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + STRETCH)))
            low, high = int(begin[at]), int(end[at:to].max())
            part = hashes[low:high]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            upto = np.vstack([np.zeros((1, 64)), np.cumsum(self.spread.weights(part)[:, None] * (2.0 * bits - 1.0), axis=0)])
            for k in range(at, to, 4096):
                e = min(k + 4096, to)
                signs = upto[end[k:e] - low] - upto[begin[k:e] - low] > 1e-6
                out[k:e] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64).ravel()
            at = to
        return out

    def _id(self, word: bytes) -> int:
        return self.vocab.setdefault(word, xxhash.xxh64_intdigest(word, 5) | 1)

    def _print(self, hashes: np.ndarray) -> int:
        """The fingerprint of a run of shingles: a bit is set if over half the weight sets it."""
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        signs = self.spread.weights(hashes) @ (2.0 * bits - 1.0) > 1e-6
        return int.from_bytes(np.packbits(signs, bitorder="little").tobytes(), "little")

    def matches(self, text: str, least: float) -> list[tuple[int, float, int, int]]:
        """``(item_id, similarity, first word, words)`` of the best window for each item that reaches ``least``.

        Of equal windows the first, then the shortest.
        """
        words = words_of(text)
        if len(words) < SHINGLE:
            return [(item, 1.0, 0, len(words)) for item in self.short.get(tuple(words), [])]
        if not self.items:
            return []
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        inside = ids != 0
        runs = np.flatnonzero(np.convolve(inside, np.ones(SHINGLE, np.int64), "valid") == SHINGLE)
        if not len(runs):
            return []
        part = np.stack([ids[runs + k] for k in range(SHINGLE)])
        with np.errstate(over="ignore"):
            h = np.zeros(len(runs), np.uint64)
            for k in range(SHINGLE):
                h = (h ^ part[k]) * _MIX[k]
                h ^= h >> np.uint64(29)
        at = np.searchsorted(self.known, h).clip(max=len(self.known) - 1)
        is_hit = self.known[at] == h
        hits, at = runs[is_hit], at[is_hit]
        begin, end = self.windows(hits, self.known_weight[at], len(words) - SHINGLE + 1)
        if not len(begin):
            return []
        for k in np.flatnonzero(~inside).tolist():  # words of no item still take part in shingles
            ids[k] = xxhash.xxh64_intdigest(words[k], 5) | 1
        hashes = _shingle_hashes(ids)
        every = np.append(0, np.cumsum(self.spread.weights(hashes)))
        found = []
        for k in self.within_radius(np.unique(self.window_prints(hashes, begin, end))).tolist():
            best = self._best(k, hashes, every, hits, at, least)
            if best:
                found.append((self.ids[k], *best))
        return found

    def _best(self, k: int, hashes: np.ndarray, every: np.ndarray, hits: np.ndarray, at: np.ndarray, least: float) -> tuple[float, int, int] | None:
        """Similarity, first word and words of the window most similar to item ``k``; None where none reaches ``least``.

        The best window begins and ends with a shingle of the item, since any other is weight that isn't shared.
        """
        own = self.items[k][0]
        size = self.sizes[k]
        of_item = own[np.searchsorted(own, at).clip(max=len(own) - 1)] == at
        places, shingles = hits[of_item], at[of_item]
        known = np.append(0, np.cumsum(self.known_weight[shingles]))
        begin, end = every[places], every[places + 1]
        low = np.searchsorted(end, begin + least * size - 1e-9)
        high = np.searchsorted(end, begin + size / least + 1e-9, "right")
        best: tuple[float, int, int] | None = None
        ahead = np.append(0, np.cumsum(high - low))
        i = 0
        while i < len(places):  # starts whose windows are held at once
            j = max(i + 1, int(np.searchsorted(ahead, ahead[i] + WINDOWS, "right")) - 1)
            n = (high - low)[i:j]
            s = np.repeat(np.arange(i, j), n)
            e = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + low[s]
            shared = np.minimum(known[e + 1] - known[s], size)
            bound = np.round(shared / (end[e] - begin[s] + size - shared), DIGITS)  # repeats can only lower it
            some = np.flatnonzero(bound >= (best[0] if best else least))
            for w in some[np.lexsort((e[some], s[some], -bound[some]))].tolist():
                if best and bound[w] < best[0]:
                    break
                first, words = int(places[s[w]]), int(places[e[w]] - places[s[w]]) + SHINGLE
                if best and bound[w] == best[0] and (first, words) > best[1:]:
                    continue
                window = hashes[first : first + words - SHINGLE + 1]
                score = self._similarity(k, shingles[s[w] : e[w] + 1], self.spread.weights(window).sum())
                if score >= least and (not best or (-score, first, words) < (-best[0], *best[1:])):
                    best = score, first, words
            i = j
        return best

    def _similarity(self, k: int, shingles: np.ndarray, weight: float) -> float:
        """The weighted Jaccard similarity of item ``k`` and a window of that ``weight`` with these of the item's shingles."""
        own, repeats = self.items[k]
        found, count = np.unique(shingles, return_counts=True)
        both = np.minimum(count, repeats[np.searchsorted(own, found)]) @ self.known_weight[found]
        return round(float(both / (weight + self.sizes[k] - both)), DIGITS)


def spread_over(items: DataFrame, text_col: str = "text") -> Spread:
    """The spread of the shingles of all ``items``, counted by the executors; a row each for those of several items goes to the driver."""
    schema = items.select(F.lit(None).cast("long").alias("shingle")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [np.unique(h).view(np.int64) for t in b.column(0).to_pylist() if len(h := _item_hashes(t))]
            made = pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([made, pa.nulls(len(own), pa.int64())])], names=["shingle"])  # a null for each item

    counted = items.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    got = counted.filter("n > 1 OR shingle IS NULL").toArrow()
    shingle, n = got.column(0), got.column(1).to_numpy()
    none = shingle.is_null().to_numpy()
    hashes = shingle.filter(shingle.is_valid()).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Spread(int(n[none].sum()), hashes[order], n[~none][order])


def passes(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over bounded blocks of the items, one at a time on the driver; null ids are left out.

    Shingles weigh by their spread over all blocks, so results don't depend on the bounds.
    """
    keyed = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    spread = spread_over(keyed)
    held, chars = [], 0
    for r in keyed.orderBy("item", "text").toLocalIterator():
        if held and (len(held) >= PASS_ITEMS or chars + len(r.text) > PASS_CHARS):
            yield Index(held, spread)
            held, chars = [], 0
        held.append((r.item, r.text))
        chars += len(r.text)
    if held:
        yield Index(held, spread)


def contaminations(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that some window of the document is similar to.

    Columns ``id_col, item_id, similarity, first_word, n_words`` (of the best window, the first of equals;
    item ids as long). Null and empty texts and items match nothing; repeated items each match; a null id
    stays null; other columns are ignored; empty tables give an empty one. A very long text is handled in
    stretches, whole. With more than one pass over the items, each pass's rows are written to the shared folder.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = keyed.select(F.col("id").alias(id_col)).schema
    for c, kind in (("item_id", "long"), ("similarity", "double"), ("first_word", "long"), ("n_words", "long")):
        schema = schema.add(c, kind)

    spark = docs.sparkSession

    def one(sent: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = [(k, *m) for k, t in enumerate(b.column(1).to_pylist()) for m in sent.value.matches(t, similarity)]
                at = pa.array([r[0] for r in rows], pa.int64())
                arrays = [b.column(0).take(at), *(pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64())))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        return keyed.mapInArrow(run, schema)

    made, left = None, passes(items)
    for index in left:
        after = next(left, None)
        if made is None and after is None:
            return one(spark.sparkContext.broadcast(index))
        made = made or new_path(spark, "matches")
        for part in (index, after):
            if part is not None:
                _write_pass(spark, part, one, made)
    return spark.read.schema(schema).parquet(made) if made else spark.createDataFrame([], schema)


def _write_pass(spark: SparkSession, index: Index, run: Callable[[Broadcast], DataFrame], path: str) -> None:
    """Appends one pass's rows to ``path``; its index leaves the driver and the executors."""
    sent = spark.sparkContext.broadcast(index)
    run(sent).write.mode("append").parquet(path)
    sent.destroy()


def decontaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that match an item; columns as they were, null texts stay.

    With more than one pass over the items, what each leaves is written to the shared folder.
    """
    spark = docs.sparkSession

    def kept(docs: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not (t and sent.value.matches(t, similarity)) for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    left = passes(items)
    index = next(left, None)
    while index is not None:
        after = next(left, None)
        if after is None:
            return kept(docs, spark.sparkContext.broadcast(index))
        path = new_path(spark, "left")
        _write_pass(spark, index, lambda sent, docs=docs: kept(docs, sent), path)
        docs, index = spark.read.schema(docs.schema).parquet(path), after
    return docs
