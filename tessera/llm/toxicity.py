"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks.

A text becomes sentences: lower case, ASCII punctuation left out, one space between words, runs of single characters
joined. The strings are the words of a sentence and its pairs of neighbours, so a word split in two is one of them;
a space is a character like any other. The kernel counts common subsequences of 4 characters that lie within 6 and of
6 that lie within 7, at DECAY for every character skipped, and those with one character after each of the others at
SPREAD; it is normalised. A subsequence is known by its hash, whatever the script.

Labels are of documents, so sentences are labelled weakly: those of a clean document are clean, and of a toxic one
those with a string that holds a run of characters whose share of toxic documents chance can't explain. A machine of
these strings, their variants with a character put in, and clean strings then finds the clean strings that score
highest, which join for the last fit. The machine is linear in the Nyström features, so it folds into one table of
subsequence weights, and a string costs the same whatever the number of landmarks. A document scores by its WORST
strings, none overlapping.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices
from tessera.llm.quality import held_out, training_labels

DECAY, SPREAD = 0.6, 0.6
#: Strings of a document that its score is made of; the decision value from which one may do; what a string's value is
#: over the bias, at least, if it counts at all.
WORST, SURE, LEAST = 3, 0.7, 0.3
#: Bounds of what is learned from: labelled documents of each class (taken by hash of the id, up to so many
#: characters long), strings of each class, landmarks.
MAX_DOCS, MAX_CHARS, MAX_STRINGS, LANDMARKS = 2500, 20_000, 2500, 320
#: Folds of the ids that no label is learned from: crc32 of the id, modulo and remainder.
FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
#: Places of a subsequence's characters after its first, and its weight; in order of the last place.
GAPS = [(at, DECAY ** (at[-1] - n)) for n, reach in ((3, 5), (5, 6)) for at in combinations(range(1, reach + 1), n)]
GAPS += [(tuple(range(2, 2 * n + 1, 2)), SPREAD) for n in (3, 5)]
GAPS.sort(key=lambda g: g[0][-1])
_RUNS = [g for g in GAPS if g[0] in ((1, 2, 3), (1, 2, 3, 4, 5))]
REACH = GAPS[-1][0][-1]
#: Bits of a subsequence's hash.
BITS = 21
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint32)
_LONGER, _SHIFT = np.uint32(0x2C1B3C6D), np.uint32(32 - BITS)
_ENDS = (". ", "! ", "? ", ".\n", "!\n", "?\n", "\n")
_DELETE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WIDE = re.compile(r"(?<=\s)\w(?: \w){2,}(?=\s)")
#: Characters whose subsequences are looked up at once, and characters of documents that are scored at once.
_BLOCK, _BATCH = 1 << 16, 1 << 18


def sentences(text: str) -> str:
    """The sentences of a text, a space before and after each word and a new line between sentences."""
    text = text.lower()
    for end in _ENDS:
        text = text.replace(end, " \x01 ")
    words = text.encode("utf-8", "replace").translate(None, _DELETE).decode("utf-8", "replace").split()
    made = f" {' '.join(words)} "
    if sum(len(w) == 1 for w in words) > 2:
        made = _WIDE.sub(lambda m: m[0].replace(" ", ""), made)
    return made.replace("\x01", "\n")


@dataclass
class Strings:
    """Characters of several texts, and where strings begin and end, spaces around them included, and their texts."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def of(self, k: int) -> str:
        return self.points[self.begin[k] : self.end[k]].tobytes().decode("utf-32-le")


def _points(parts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(parts).encode("utf-32-le", "replace"), np.uint32)


def strings_of(texts: list[str]) -> Strings:
    """The strings of texts, sentence by sentence: words, then pairs."""
    parts = [sentences(t) for t in texts]
    points = _points(parts)
    gap = (points == 10) | (points == 32)
    begin = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 2
    pair = np.flatnonzero(end[:-1] == begin[1:] + 1)  # the space between them is the same
    begin, end = np.concatenate([begin, begin[pair]]), np.concatenate([end, end[pair + 1]])
    starts = np.append(0, np.cumsum([len(x) + 1 for x in parts])[:-1])
    return Strings(points, begin, end, np.searchsorted(starts, begin, "right") - 1)


def listed(words: list[str]) -> Strings:
    """Words, or pairs, as strings."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    return Strings(_points([f" {w} " for w in words]), begin, begin + sizes, np.arange(len(words)))


def _codes(points: np.ndarray, gaps: list = GAPS) -> Iterator[tuple[np.ndarray, float, int]]:
    """For each of ``gaps`` the hashes of the subsequences that begin at each character, their weight and last place."""
    n = len(points)
    held = np.append(points, np.zeros(REACH, np.uint32))
    parts = [held * a for a in _ODD]
    code = np.empty(n, np.uint32)
    for at, weight in gaps:
        np.add(parts[0][:n], parts[1][at[0] : at[0] + n], out=code)
        for k, place in enumerate(at[1:], 2):
            np.add(code, parts[k][place : place + n], out=code)
        if len(at) > 3:
            np.multiply(code, _LONGER, out=code)
        np.right_shift(code, _SHIFT, out=code)
        yield code, weight, at[-1]


def _sums(strings: Strings, table: np.ndarray) -> np.ndarray:
    """The sum of ``table`` over each string's subsequences."""
    points, out = strings.points, np.zeros(len(strings.begin))
    reaches = sorted({at[-1] for at, _ in GAPS})
    upto = {r: np.zeros(len(points) + 1) for r in reaches}
    for at in range(0, len(points), _BLOCK):
        part = points[at : at + _BLOCK + REACH]
        n = min(_BLOCK, len(points) - at)
        total = {r: np.zeros(len(part), np.float32) for r in reaches}
        code, got = np.empty(len(part), np.intp), np.empty(len(part), np.float32)
        for codes, weight, last in _codes(part):
            code[:] = codes
            np.take(table, code, out=got, mode="clip")
            if weight != 1.0:
                np.multiply(got, np.float32(weight), out=got)
            np.add(total[last], got, out=total[last])
        for r in reaches:
            upto[r][at + 1 : at + 1 + n] = upto[r][at] + np.cumsum(total[r][:n], dtype=np.float64)
    for r in reaches:  # those that end in the string
        out += upto[r][np.maximum(strings.end - r, strings.begin)] - upto[r][strings.begin]
    return out


def _features(strings: Strings, gaps: list = GAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the string, hash and weight of each subsequence."""
    tall = strings.end - strings.begin
    of = np.repeat(np.arange(len(tall)), tall)
    at = np.arange(len(of)) - np.repeat(np.cumsum(tall) - tall, tall) + np.repeat(strings.begin, tall)
    left = strings.end[of] - at
    numbers, hashes, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for codes, weight, last in _codes(strings.points, gaps):
        inside = np.flatnonzero(left > last)
        numbers.append(of[inside])
        hashes.append(codes[at[inside]].astype(np.int64))
        weights.append(np.full(len(inside), weight, np.float32))
    return np.concatenate(numbers), np.concatenate(hashes), np.concatenate(weights)


def norms(strings: Strings) -> np.ndarray:
    """Square roots of each string's kernel with itself (1 for strings without subsequences)."""
    of, code, weight = _features(strings)
    key, at = np.unique(of * (1 << BITS) + code, return_inverse=True)
    own = np.bincount(key >> BITS, np.bincount(at, weight) ** 2, len(strings.begin)) if len(key) else np.zeros(len(strings.begin))
    return np.where(own > 0, np.sqrt(own), 1.0)


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The normalised kernel between two lists of words or pairs."""
    marks, m = listed(others), len(others)
    of, code, weight = _features(marks)
    key, at = np.unique(code * m + of, return_inverse=True)
    value, own = np.bincount(at, weight) / norms(marks)[key % m], key % m
    known, first = np.unique(key // m, return_index=True)
    first = np.append(first, len(key))
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    out = np.zeros((len(words), m))
    for k in range(0, len(words), 500):
        part = listed(words[k : k + 500])
        of, code, weight = _features(part)
        hit = np.flatnonzero(place[code] >= 0)
        to = place[code[hit]]
        n = first[to + 1] - first[to]  # the marks that have the subsequence
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[to], n)
        cell = np.repeat(of[hit], n) * m + own[entry]
        out[k : k + 500] = np.bincount(cell, np.repeat(weight[hit], n) * value[entry], len(part.begin) * m).reshape(-1, m) / norms(part)[:, None]
    return out


def support_vectors(z: np.ndarray, y: np.ndarray, share: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss by Newton steps; rows of each class cost by their shares."""
    x = np.hstack([z, np.ones((len(z), 1))])
    cost = c * len(y) * share / (2 * np.where(y > 0, share[y > 0].sum(), share[y < 0].sum()))
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    loss = lambda v: 0.5 * v @ ridge @ v + (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(50):
        on = y * (x @ w) < 1
        part, weight = x[on], 2 * cost[on]
        step = np.linalg.solve(ridge + (part * weight[:, None]).T @ part, ridge @ w - part.T @ (weight * (y[on] - part @ w)))
        size, here = 1.0, loss(w)
        while loss(w - size * step) > here and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Weights of subsequences, the bias, and the logistic's weights of the worst strings; None: every score is ``share``."""

    table: np.ndarray | None
    bias: float = 0.0
    weights: np.ndarray | None = None
    share: float = 0.0

    def gains(self, strings: Strings) -> np.ndarray:
        """Decision values of strings over the bias; 0 for those under LEAST."""
        total = _sums(strings, self.table)
        # the kernel of a string with itself is no less than its subsequences' squared weights
        tall = strings.end - strings.begin
        own = np.zeros(int(tall.max(initial=0)) + 1)
        for at, weight in GAPS:
            own[at[-1] :] += weight**2 * np.arange(1, len(own) - at[-1] + 1)[: len(own) - at[-1]] if len(own) > at[-1] else 0.0
        least = np.sqrt(np.append(0.0, own)[tall])
        out = np.zeros(len(total))
        for k in np.array_split(up := np.flatnonzero((total > 0) & (total >= LEAST * least)), len(up) // 5000 + 1):
            if len(k):
                few = listed([strings.of(i)[1:-1] for i in k.tolist()])
                gain = total[k] / norms(few)
                out[k] = np.where(gain >= LEAST, gain, 0.0)
        return out

    def worst(self, strings: Strings, texts: int, gains: np.ndarray | None = None) -> np.ndarray:
        """A row for each text: the gains of its WORST strings, what the highest value is over SURE, and a constant.

        Of strings that share words the higher counts; values are cut at 1.2.
        """
        gains = self.gains(strings) if gains is None else gains
        out = np.zeros((texts, WORST + 2))
        out[:, -1] = 1.0
        up = np.flatnonzero(gains > 0)
        taken: dict[int, list[int]] = {}
        for k in up[np.argsort(-gains[up], kind="stable")].tolist():
            have = taken.setdefault(int(strings.text[k]), [])
            if len(have) < WORST and all(strings.end[k] - 1 <= strings.begin[j] or strings.end[j] - 1 <= strings.begin[k] for j in have):
                if strings.of(k) not in map(strings.of, have):  # a word said again counts once
                    have.append(k)
        for text, have in taken.items():
            top = np.minimum(gains[have] + self.bias, 1.2)
            out[text, : len(have)] = top - self.bias
            out[text, WORST] = max(top[0] - SURE, 0.0)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts."""
        if self.table is None:
            return np.full(len(texts), self.share)
        out, at = [np.zeros((0, WORST + 2))], 0
        while at < len(texts):  # few characters at once, unless one text has more
            to, held = at + 1, len(texts[at] or "")
            while to < len(texts) and held + len(texts[to] or "") <= _BATCH:
                held += len(texts[to] or "")
                to += 1
            out.append(self.worst(strings_of([t or "" for t in texts[at:to]]), to - at))
            at = to
        return 1.0 / (1.0 + np.exp(-(np.concatenate(out) @ self.weights).clip(-50, 50)))


def variants(word: str) -> list[str]:
    """``word`` split in two, with a letter put in, and with one after each of its characters."""
    letter = lambda k: chr(97 + xxhash.xxh64_intdigest(f"{k} {word}".encode(), 5) % 26)
    inside = range(2, len(word) - 1)
    return [*(f"{word[:k]} {word[k:]}" for k in inside), *(word[:k] + letter(k) + word[k:] for k in inside), letter(0).join(word)]


def _fit_strings(good: list[str], bad: list[str], count: Counter, purity: dict[str, float]) -> tuple[np.ndarray, float]:
    """The table and bias for strings that ``count`` documents have.

    A bad string whose runs clean documents have as well stands on both sides, by its ``purity``, so that
    its decision value shows how sure it is. Variants of the surest bad strings stand with them.
    """
    both = [w for w in bad if purity.get(w, 1.0) < 0.99]
    made = [(v, count[w] / (2 * len(word))) for w in bad[: MAX_STRINGS // 50] if purity.get(w, 1.0) > 0.95 and " " not in w and len(w) > 3 for word in [variants(w)] for v in word]
    made = [(v, n) for v, n in made if count[v] == 0]
    words = bad + [v for v, _ in made] + good + both
    ones = len(bad) + len(made)
    y = np.array([1.0] * ones + [-1.0] * (len(good) + len(both)))
    share = np.sqrt([*(max(count[w], 1) for w in bad), *(n for _, n in made), *(max(count[w], 1) for w in good + both)])
    part = np.array([purity.get(w, 1.0) for w in words])
    sides = [share[y > 0].sum(), share[ones : ones + len(good)].sum()]
    share[: len(bad)] *= part[: len(bad)]
    share[ones + len(good) :] *= (1 - part[ones + len(good) :]) * sides[1] / sides[0]
    half = LANDMARKS // 2
    marks = bad[:half] + good[:half]  # both begin with the most frequent
    value, vector = np.linalg.eigh(kernel(marks, marks))
    keep = value > 1e-4 * value.max()
    back = vector[:, keep] / np.sqrt(value[keep])
    w, bias = support_vectors(kernel(words, marks) @ back, y, share)
    of, code, weight = _features(listed(marks))
    return np.bincount(code, (back @ w / norms(listed(marks)))[of] * weight, 1 << BITS).astype(np.float32), bias


def _by_hash(words: Iterable[str]) -> list[str]:
    return sorted(words, key=lambda w: (xxhash.xxh64_intdigest(w.encode(), 3), w))


def _unlike(docs: list[tuple[str, set[str]]]) -> list[tuple[str, set[str]]]:
    """``docs`` (texts and their words) without near copies: one for each least hash of its words that few have."""
    count = Counter(w for _, s in docs for w in s)
    few = max(20, len(docs) // 50)
    seen: dict = {}
    for k, (t, s) in enumerate(docs):
        rare = [xxhash.xxh64_intdigest(w.encode(), 9) for w in s if count[w] <= few]
        seen.setdefault(min(rare) if rare else ("common", k), (t, s))
    return list(seen.values())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of the logistic fit, both classes counting alike, with smoothed targets; the last column is the constant."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    part = len(y) / np.where(y > 0, 2 * n1, 2 * n0)
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    keep = ridge * np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (part * p * (1 - p))[:, None]).T @ x + keep, x.T @ (part * (p - goal)) + keep @ w)
        w = w - step.clip(-1, 1)
        if np.abs(step).max() < 1e-9:
            break
    w[:-1] = np.maximum(w[:-1], 0.0)  # a worse string never makes a document better
    return w


def _telling(every: list[str], toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """Strings with a run of characters whose share of toxic documents is higher than chance can make it,
    and the highest such share.

    By twice the log-likelihood ratio, which must beat that of nearly all of as many runs without meaning.
    """
    number, code, _ = _features(listed(every), _RUNS)
    order = np.argsort(number, kind="stable")
    number, code = number[order], code[order]
    names, code = np.unique(code, return_inverse=True)
    parts = np.split(code, np.searchsorted(number, np.arange(1, len(every))))
    of = dict(zip(every, parts, strict=True))
    counts = []
    for docs in (toxic, clean):
        count = np.zeros(len(names))
        for s in docs:
            count[np.unique(np.concatenate([of[w] for w in s]))] += 1
        counts.append(count)
    a, b = counts
    share = len(toxic) / (len(toxic) + len(clean))
    seen = np.maximum(a + b, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(a > 0, a * np.log(a / seen / share), 0) + np.where(b > 0, b * np.log(b / seen / (1 - share)), 0))
    odd = (a / seen > min(0.9, max(3.5 * share, 0.4))) & (ratio > 1.25 * np.log(len(names) + 1))
    sure = np.where(odd, a / seen, 0.0)
    return {w: float(sure[p].max()) for w, p in of.items() if len(p) and odd[p].any()}


def fit(docs: list[tuple[str, int]]) -> Model:
    """A model of texts with labels 0 and 1.

    Without texts of both classes that have words, every score is the share of label 1 (0 without any text).
    """
    split = [(t, set(sentences(t).split()), y) for t, y in docs]
    toxic, clean = (_unlike([(t, s) for t, s, y in split if y == k and s]) for k in (1, 0))
    if not toxic or not clean:
        return Model(None, share=sum(y for _, y in docs) / len(docs) if docs else 0.0)
    in_toxic, in_clean = Counter(w for _, s in toxic for w in s), Counter(w for _, s in clean for w in s)
    every = sorted(in_toxic.keys() | in_clean.keys())
    telling = _telling(every, [s for _, s in toxic], [s for _, s in clean])
    seeds = sorted((w for w in every if w in telling and in_clean[w] == 0), key=lambda w: (-in_toxic[w], w))
    bad = seeds[:MAX_STRINGS] or sorted({max(s, key=lambda w: (in_toxic[w] / (in_clean[w] + 0.5), w)) for _, s in toxic})[:MAX_STRINGS]
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[: MAX_STRINGS // 3]]
    good = list(dict.fromkeys(common + _by_hash(in_clean)[: MAX_STRINGS // 3]))
    good = [w for w in good if w not in set(bad)]
    texts = [t for t, _ in toxic + clean]
    parts = [strings_of(texts[k : k + 64]) for k in range(0, len(texts), 64)]
    for last in (False, True):
        table, bias = _fit_strings(good, bad, in_toxic + in_clean, telling)
        model = Model(table, bias)
        gains = [model.gains(p) for p in parts]
        if not last:  # the worst strings of clean documents join the clean strings
            high: dict[str, float] = {}
            for at, (p, g) in enumerate(zip(parts, gains, strict=True)):
                for k in np.flatnonzero((g > 0) & (p.text + 64 * at >= len(toxic))).tolist():
                    high[p.of(k)[1:-1]] = float(g[k])
            hard = sorted(high.keys() - set(bad), key=lambda w: (-high[w], w))
            good = list(dict.fromkeys(good[: LANDMARKS // 4] + hard[: MAX_STRINGS // 2] + good))[: MAX_STRINGS * 3 // 2]
    best = np.concatenate([model.worst(p, min(64, len(texts) - 64 * k), gains[k]) for k, p in enumerate(parts)])
    model.weights = _logistic(best, np.array([1] * len(toxic) + [0] * len(clean)))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most MAX_DOCS labelled documents of each class, of at most MAX_CHARS characters."""
    known = training_labels(labels, "toxic", id_col, FOLDS, FOLD)
    # twice as many ids as documents are wanted, for those that are too long or lacking
    some = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(2 * MAX_DOCS) for k in (0, 1)]
    picked = F.broadcast(some[0].union(some[1]))  # at most 4 * MAX_DOCS rows
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = keyed.join(picked, "id").filter(F.length("text").between(1, MAX_CHARS)).select("id", "label", "text")
    known = cut(texts)  # at most 4 * MAX_DOCS rows
    turn = F.xxhash64("id", F.lit(11)), "id", "text"
    rows = [r for k in (0, 1) for r in known.filter(F.col("label") == k).orderBy(*turn).select("text", "label").limit(MAX_DOCS).collect()]
    return fit([(r.text, r.label) for r in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``.

    A null or empty text has the score of a text without toxic strings. Null and repeated ids stay, an id
    with several labels has the least, labels of ids that ``docs`` lacks are ignored, and so are other columns of
    ``docs``. Very long texts are scored whole, their subsequences looked up in blocks. Empty tables give empty ones.
    """
    model = train(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = sent.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    made = keyed.mapInArrow(run, keyed.select("id").schema.add("score", "double").add("predicted", "integer"))
    return made.select(F.col("id").alias(id_col), held_out("id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
