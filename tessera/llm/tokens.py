"""Token ids as Parquet list columns that allow selective reads.

Layout, one folder: part files in ascending id order (nulls first), each row with the part's number, the
row's place and first token within the part, the document's number of tokens, id and token ids, all delta
encoded. Row groups and pages are kept small and Parquet's page index gives
their bounds, so a reader can take metadata alone, or the ids of a few documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, slices

#: Parquet settings: delta encoding of all columns, small row groups and pages; the format has page indexes by itself.
LAYOUT = {
    "compression": "snappy",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
}
#: Pieces that one Python worker keeps the ids of, and the length (characters) up to which some stay when there are
#: more; results don't depend on them.
CACHE, SHORT = 700_000, 8
#: Bytes of texts that are encoded together, and pieces whose ids are put in place at a time.
TOGETHER, PLACED = 4 << 20, 1 << 17
_loaded: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts with a tokenizers file, reusing the ids of pieces between spaces.

    A byte-level pre-tokenizer never joins a character that isn't white space to a space or new line after
    it, so a text cut before these encodes to the pieces' ids in a row, as long as they stand alone (or are
    two new lines). Other texts, and tokenizers of another kind, are encoded whole. Punctuation between a
    letter or digit and a space is a piece of its own. The pieces of many texts are cut and told apart
    in Arrow's buffers, so that only different ones become Python objects.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        added = [t["content"] for t in made.get("added_tokens") or []]
        self.by_piece = (
            made.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and bool(pre.get("use_regex"))
            and not pre.get("add_prefix_space")
            and not any(set(t) & set(" \t\n\r") for t in added)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in made.get("added_tokens") or [])
            and (made.get("model") or {}).get("dropout") is None
        )
        self.added, self.kept = added, {}
        self.after_lines = [f"\n\n{t}" for t in added]  # as at a text's end, two new lines may be one token there
        # how the byte-level alphabet writes the bytes of letters up to U+024F; checked before it is relied on
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        shown = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.letters = "".join(shown.get(b, chr(b)) for b in range(256))
        for word in ("Word", "étàœß", "ÿŁőŸŐ"):
            as_shown = "\u0120" + word.encode().decode("latin-1").translate(self.letters)
            if np.array([t.id for t in self.tokenizer.model.tokenize(as_shown)], "<u4").tobytes() != self._whole(f" {word}"):
                self.letters = ""
                break
        self.tails = all(t.startswith("<|") and t.endswith("|>") for t in added)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        alone = [self._whole(x) for x in ("a\n b", "a", "\n", " b")] + [self._whole(x) for x in ("a\nb", "b", "\n\nb")]
        self.line, self.line_id = alone[2], line[0] if line else -1
        self.by_piece &= len(line) == 1 and alone[0] == b"".join(alone[1:4])
        self.by_piece &= alone[4] == alone[1] + alone[2] + alone[5] and alone[6] == 2 * alone[2] + alone[5]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, bodies: list[str], lead: str) -> list[bytes]:
        """The ids of each printable string after ``lead``; one call encodes many, a new line between them.

        A new line alone between characters other than white space, or before a space, is a token of its own.
        """
        out: list[bytes] = []
        for k in range(0, len(bodies), 500):
            text = lead + f"\n{lead}".join(bodies[k : k + 500])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_id), len(ids)) * 4
            raw, starts = ids.tobytes(), np.append(0, ends[:-1] + 4)
            out += [raw[a:e] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece: after a space or, where LINED begins it, after a new line, whose id comes first.

        Letters alone are one pre-token, which the library's model takes as it is; other pieces go through
        the whole tokenizer, many at a time.
        """
        out: dict[str, bytes] = {}
        after, plain, words, ids, ends = [], [], [], [], [0]
        tokenize, letters, line_id = self.tokenizer.model.tokenize, self.letters, self.line_id
        for p in pieces:
            if p[0] != " ":  # punctuation after a letter or digit
                out[p] = self._whole(p)
                continue
            line = p[1:2] == LINE
            body = p[2:] if line else p[1:]
            if letters and body.isalpha() and (body.isascii() or max(body) < "\u0250"):
                if not body.isascii():
                    body = body.encode().decode("latin-1").translate(letters)
                if line:
                    ids.append(line_id)
                ids += [t.id for t in tokenize(body if line else f"\u0120{body}")]
                words.append(p)
                ends.append(len(ids) * 4)
            elif body.isprintable() and body:
                (after if line else plain).append(body)
        raw = np.array(ids, "<u4").tobytes()
        out.update(zip(words, [raw[a:e] for a, e in pairwise(ends)], strict=True))
        if any(m in text for text in ("\n".join(after), "\n".join(plain)) for m in self.added):
            after, plain = [], []  # a special token's string is among them: one by one
        out.update((LINED + p, self.line + made) for p, made in zip(after, self._joined(after, ""), strict=True))
        out.update((f" {p}", made) for p, made in zip(plain, self._joined(plain, " "), strict=True))
        for p in pieces:
            if p not in out:
                out[p] = self._whole("\n" + p[2:] if p[1:2] == LINE else p)
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of the pieces, which all differ."""
        kept = self.kept
        ids = list(map(kept.get, pieces))
        if None in ids:
            extra = self._learn([p for p, have in zip(pieces, ids, strict=True) if have is None])
            ids = [extra[p] if have is None else have for p, have in zip(pieces, ids, strict=True)]
            if len(kept) + len(extra) > CACHE:  # short pieces are the likelier to come again
                short = [(p, b) for p, b in kept.items() if len(p) <= SHORT][: CACHE // 2]
                kept.clear()
                kept.update(short)
            kept.update(extra)
        return ids

    def _cut(self, raw: bytes) -> np.ndarray:
        """Where pieces begin in ``raw``: at spaces, and at punctuation from a letter or digit to a space.

        Runs of more than eight punctuation characters stay with what is before them.
        """
        text = np.frombuffer(raw, np.uint8)
        spaces = np.flatnonzero(text == 32)
        if not self.tails:
            return spaces
        at = np.flatnonzero(_IN_TAIL[text])
        one, two = text[at - 1], text[at - 2].astype(np.int32)  # raw begins with a space and LINE
        wide = (one >= 0x80) & (one < 0xC0) & (two >= 0xC2) & (two <= 0xC9)
        point = np.where(wide, (two & 0x1F) << 6 | one & 0x3F, np.where(one < 0x80, one, 0))
        at = at[_ALNUM[point]]
        after, cuts = at + 1, []
        for _ in range(8):
            ended = (after >= len(text)) | (text[np.minimum(after, len(text) - 1)] == 32)
            cuts.append(at[ended])
            at, after = at[~ended], after[~ended]
            more = _IN_TAIL[text[after]]
            at, after = at[more], after[more] + 1
        return np.sort(np.concatenate([spaces, *cuts]), kind="stable")

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one to be overwritten before each text's, and where these ones are, with the end."""
        whole, marked = {}, []
        for i, t in enumerate(texts):
            if not self.by_piece or _whole_only(t) or any(x in t for x in self.after_lines):
                whole[i] = b"\0\0\0\0" + self._whole(t)
                marked.append(LINE.encode())
            else:
                marked.append(f"{LINE}{t}".replace("\n", LINED).encode())  # a text begins as if after a new line
        sizes = np.array([len(m) + 1 for m in marked], np.int64)
        raw = b" " + b" ".join(marked)
        del marked
        cuts = self._cut(raw)
        firsts = np.searchsorted(cuts, np.cumsum(sizes) - sizes)
        made = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        del raw, cuts
        piece = made.indices.to_numpy()
        known = self._known(made.dictionary.to_numpy(zero_copy_only=False).tolist())
        if whole:
            piece = piece.copy()
            piece[firsts[list(whole)]] = len(known) + np.arange(len(whole))
            known += whole.values()
        n = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        pool, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(n) - n
        ids, at, begins = [], 0, []
        for k in range(0, len(piece), PLACED):
            part = piece[k : k + PLACED]
            lens = n[part]
            ends = np.cumsum(lens)
            ids.append(pool[np.repeat(starts[part] - ends + lens, lens) + np.arange(ends[-1])])
            lo, hi = np.searchsorted(firsts, (k, k + PLACED))
            begins.append(at + (ends - lens)[firsts[lo:hi] - k])
            at += int(ends[-1])
        return np.concatenate(ids), np.concatenate([*begins, [at]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not texts:
            return []
        ids, at = self._flat(texts)
        raw = ids.tobytes()
        return [raw[a + 4 : e] for a, e in pairwise((at * 4).tolist())]

    def ended(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, and how many ids each has with it."""
        ids, at = self._flat(texts)
        ids[at[1:-1]] = end_id  # where the next text's are begun
        return np.append(ids[1:], np.uint32(end_id)), np.diff(at)


#: Texts that are not cut: with white space before a space, or other than a new line before a new line, two new lines
#: before white space or the end, white space other than a space or new line at the start (it would join a new line
#: before it), or the character that stands for a new line in pieces.
_SPACED = re.compile(r"\A[^\S\n ]|\s |[^\S\n]\n|\n\n(?:\s|\Z)|\x00")
LINE = "\x00"
LINED = f" {LINE}"
#: Bytes of punctuation that the pre-tokenizer parts from a letter or digit before it (no apostrophe, which may begin a
#: contraction), and letters and digits up to U+024F.
_IN_TAIL = np.isin(np.arange(256), list(b".,;:!?*#$%&|)]}\""))
_ALNUM = np.array([c < 0x250 and chr(c).isalnum() for c in range(0x280)])


def _whole_only(text: str) -> bool:
    """Whether ``_SPACED`` finds something; most texts need no search."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text.endswith("\n\n"):
        return True
    return not text.replace("\n", " ").isprintable() and _SPACED.search(text) is not None


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in a row with texts of at most TOGETHER bytes in all, or one."""
    have, size = [], 0
    for b in batches:
        if have and size + b.column(1).nbytes > TOGETHER:
            yield have
            have, size = [], 0
        have.append(b)
        size += b.column(1).nbytes
    if have:
        yield have


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the token ids of every whole text, ``end_id`` after each, to a folder of Parquet files.

    ``tokenizer`` is the path of a tokenizers file that every executor can read. The texts are dealt out
    by ranges of ``id_col`` and sorted within them (rows with equal ids by hash of the text), then
    encoded; a null text is empty, so a row always has ``end_id``. Other columns are left out, whatever
    their names. An empty table gives a folder without rows. Returns the folder.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ranged = keyed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pos, start = encoder(tokenizer), 0, 0
        for together in _gathered(slices(batches)):
            ids, sizes = coder.ended([t for b in together for t in b.column(1).to_pylist()], end_id)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view("<i4")))
            part, doc = (pa.concat_arrays([b.column(k) for b in together]) for k in (2, 0))
            yield pa.RecordBatch.from_arrays(
                [part, pa.array(np.arange(pos, pos + len(sizes))), pa.array(start + ends - sizes), pa.array(sizes), doc, lists],
                names=["part", "pos", "part_start", "n_tokens", "doc_id", "ids"],
            )
            pos, start = pos + len(sizes), start + int(ends[-1])

    schema = "part int, pos long, part_start long, n_tokens long, doc_id long, ids array<int>"
    ranged.mapInArrow(run, schema).write.options(**LAYOUT).parquet(out)
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a folder by write_tokens; start counts all ids before the row.

    Column pruning leaves the ids' pages unread where only metadata is asked for.
    """
    stored = spark.read.parquet(path)
    last = F.max_by(F.struct("part_start", "n_tokens"), "pos")
    parts = stored.groupBy("part").agg(last.alias("last")).select("part", (F.col("last.part_start") + F.col("last.n_tokens")).alias("total"))
    before, at = [], 0
    for r in sorted(parts.collect()):  # one row a part file
        before.append((r.part, at))
        at += r.total
    index = spark.createDataFrame(before, "part int, before long") if before else spark.range(0).selectExpr("int(id) part", "id before")
    return stored.join(F.broadcast(index), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def crc_of_ids(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) in place of ``ids``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, **args) -> DataFrame:
    """Writes ``docs`` with write_tokens and returns, read back, each row's id, start, number and crc32 of ids."""
    return crc_of_ids(read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, **args)))
