"""Quality rules on repetition within a text, by suffix arrays over its words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, slices

#: Words from which a maximal repeat counts; the most of the words that such repeats may cover, and the
#: longest one allowed (words).
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.25, 100
#: The base rules: least words, and the share in per cent of words in 5-word windows found twice.
MIN_WORDS, WINDOW, MAX_WINDOW_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def suffix_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that also begins elsewhere.

    The suffix array comes from prefix doubling, which stops once all suffixes differ; the longest
    common prefixes of neighbours come from the ranks of each doubling, longest first.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    _, rank = np.unique(ids, return_inverse=True)
    levels, width = [rank.astype(np.int64)], 1
    while True:
        rank = levels[-1]
        if int(rank.max()) == n - 1:
            break
        after = np.zeros(n, np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        levels.append(rank.astype(np.int64))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # ranks of suffixes shorter than the level's width are unique to them, so equal ranks are whole matches
        live = np.flatnonzero((a < n) & (b < n))
        live = live[levels[k][a[live]] == levels[k][b[live]]]
        step = 1 << k
        common[live] += step
        a[live] += step
        b[live] += step
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered(lengths: np.ndarray, least: int, span: int | None = None) -> int:
    """Positions in the union of [i, i + length) over those i whose length is ``least`` or more (``span``: instead of length)."""
    at = np.flatnonzero(lengths >= least)
    if not len(at):
        return 0
    ends = np.maximum.accumulate(at + (lengths[at] if span is None else span))
    return int((ends - np.maximum(at, np.append(0, ends[:-1]))).clip(0).sum())


def measure(text: bytes, least: int = MIN_REPEAT) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words covered by maximal repeats of ``least`` or more words, the longest repeat."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0, 0)
    bare = text.translate(None, _SPACE)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
    own: dict[bytes, int] = {}
    ids = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, n)
    lengths = suffix_repeats(ids) if len(own) < n else np.zeros(n, np.int64)
    return (n, chars, len(text) - len(text.translate(None, SYMBOLS)), dup, covered(lengths, WINDOW, WINDOW), covered(lengths, least), int(lengths.max()))


def verdict(n_words: np.ndarray, n_repeat: np.ndarray, cover: np.ndarray, longest: np.ndarray, max_covered: float, max_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_WINDOW_PERCENT * n_words)
    return base, ~base & (cover <= max_covered * n_words) & (longest <= max_repeat)


def quality_rules(docs: DataFrame, text_col: str = "text", least: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The columns of ``docs`` without the text, then the measures, ``base_failed`` and ``kept``.

    A null text has no words, and fails as an empty one does. Rows are judged one by one, so repeated
    rows, ties and extra columns change nothing; a measure whose name is taken gets underscores before it.
    """
    rest = [c for c in docs.columns if c != text_col]
    names = [free_name(docs, c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
    flags = [free_name(docs, c) for c in ("base_failed", "kept")]
    hidden = free_name(docs, "text_bytes")
    slim = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").cast("binary").alias(hidden))
    schema = slim.drop(hidden).schema
    for c in names:
        schema = schema.add(c, "long")
    for c in flags:
        schema = schema.add(c, "boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = np.array([measure(t or b"", least) for t in b.column(b.num_columns - 1).to_pylist()], np.int64).reshape(-1, 7)
            base, kept = verdict(made[:, 0], made[:, 4], made[:, 5], made[:, 6], max_covered, max_repeat)
            arrays = [*b.columns[:-1], *(pa.array(made[:, k].copy()) for k in range(7)), pa.array(base), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *names, *flags])

    return slim.mapInArrow(run, schema)
