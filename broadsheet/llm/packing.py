"""Packing token sequences: bounded-space online best-fit, then merging of what is left.

Each task keeps ``open_windows`` windows open. A document's full windows leave at once; its rest goes to the open window
that it fills best. When none can hold it, the fullest window is topped up with the head of the rest (unless fewer than
``min_cut`` ids are free there) and leaves. So memory is a few windows a task, and every window that leaves early has under
``min_cut`` ids of padding. The windows still open when a task's rows end are merged the same way, ``fan_in`` tasks at a
time, until one task is left; each round passes on at most ``open_windows`` windows a task.

Tokenizing caches ids by word in each Python worker, as the vocabulary splits at white space before merging anything. A
vocabulary that does otherwise is asked for whole texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, staged, table

WINDOW, OPEN_WINDOWS, MIN_CUT, FAN_IN = 4096, 16, 32, 32
#: Id that ends every document.
END_ID = 2
#: Characters of the words whose ids one worker keeps, some 300 bytes a word in all, and the longest word that it keeps.
CACHE_CHARS, CACHED_WORD = 4_000_000, 40
#: Characters of texts encoded at once, or one text.
SLICE = 1 << 19

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, left binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("part", pa.int32()), ("left", pa.binary())])
#: A sentence mark that stands alone for the tokenizer: after a letter or digit, before a space.
_MARK = re.compile(r"[.,](?<=[^\W_][.,])(?= )")
# How the tokenizers normalise and part texts that WordTokenizer may cut into words.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTED = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
MARKED = {"<|startoftext|>", "<|endoftext|>"}


class WordTokenizer:
    """ids of whole texts, as little-endian unsigned 32-bit bytes, equal to encoding the text at once.

    Texts are cut at spaces and line feeds, and before a sentence mark that is a word of its own to the tokenizer.
    Lower-casing beforehand only shortens the cache; it is left out where normal forms or the final sigma could make a
    difference. All this holds for tokenizers with NORMAL and PARTED, which drop white space before merging; others get
    whole texts.
    """

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_chars, self.cache = Tokenizer.from_file(path), cache_chars, {}
        self.held = self.missed = 0  # characters of cached words, and of others encoded since the cache began
        self.by_word = self._parts_words(json.loads(self.tokenizer.to_str()))
        gap = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.gap = gap[0] if len(gap) == 1 else None

    @staticmethod
    def _parts_words(said: dict) -> bool:
        normal, parts = said.get("normalizer") or {}, (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        first = parts[0]
        return (
            normal.get("normalizers") == NORMAL
            and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", PARTED, "Removed", True)
            and all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") for p in parts[1:])
            and {t["content"] for t in said.get("added_tokens") or []} <= MARKED
        )

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, found: list[str]) -> None:
        plain = [w for w in found if self.gap is not None and "\x01" not in w and "<" not in w]
        if plain:
            ids = np.array(self.tokenizer.encode(" \x01 ".join(plain), add_special_tokens=False).ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.gap) * 4).tolist(), ids.nbytes]
            if len(ends) == len(plain):
                raw, at = ids.tobytes(), 0
                for w, end in zip(plain, ends, strict=True):
                    self.cache[w], at = raw[at:end], end + 4
        for w in found:
            if w not in self.cache:
                self.cache[w] = self._ids(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._ids(text) for text in texts]
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < SLICE:
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            low = text.lower()
            if "<|" not in text and (text.isascii() or "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
                text = low
            cut.append(_MARK.sub(r" \g<0>", text.replace("\n", " ")).split(" "))
        new = list(set().union(*cut).difference(self.cache))
        self._learn(new)
        known = self.cache.__getitem__
        out = [b"".join(map(known, one)) for one in cut]
        # The words that come first are mostly the frequent ones. Once they fill the cache others are encoded each time,
        # until that has been so for long, as when the language changes; then the cache starts anew.
        for w in new:
            if len(w) > CACHED_WORD or self.held + len(w) > self.cache_chars:
                del self.cache[w]
                self.missed += len(w)
            else:
                self.held += len(w)
        if self.missed > 20 * self.cache_chars:
            self.cache.clear()
            self.held = self.missed = 0
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Windows:
    """Open windows of one task. ``done`` gets (sequence number, pieces) of windows that left."""

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.free: list[tuple[int, int]] = []  # (ids free, sequence number), ascending
        self.held: dict[int, list] = {}
        self.next, self.done = 0, []

    def _leave(self, number: int) -> None:
        self.done.append((number, self.held.pop(number)))

    def add(self, doc_id, start: int, ids: bytes, tokens: int) -> None:
        """ids: four bytes each, at most one window."""
        n = len(ids) // 4
        while n:
            at = bisect_left(self.free, (n, -1))
            if at < len(self.free):
                room, number = self.free.pop(at)
                take = n
            elif len(self.free) < self.most:
                room, number, take = self.size, self.next, min(n, self.size)
                self.next += 1
                self.held[number] = []
            else:
                room, number = self.free.pop(0)
                if room < self.min_cut:
                    self._leave(number)
                    continue
                take = room
            self.held[number].append((doc_id, start, ids[: 4 * take], tokens))
            if take == room:
                self._leave(number)
            else:
                insort(self.free, (room - take, number))
            ids, start, n = ids[4 * take :], start + take, n - take

    def rows(self, windows: Iterable, base: int, part: int, last: bool) -> list[tuple]:
        out = []
        for number, pieces in windows:
            at = 0
            for doc_id, start, ids, tokens in pieces:
                n = len(ids) // 4
                out.append((doc_id, start, n, zlib.crc32(ids), tokens, base + number, at, part, ids if last else None))
                at += n
        return out


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000], strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _packed(groups: Iterable, size: int, most: int, min_cut: int, level: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """groups: (number of the group, batches of its pieces). keep: what is left of each stays open, to be merged with the rest of others."""
    for part, batches in groups:
        base, windows = (level << 56) | (part << 28), Windows(size, most, min_cut)
        for batch in batches:
            for piece in batch:
                windows.add(*piece)
            if windows.done:
                yield from _batches(windows.rows(windows.done, base, part, False))
                windows.done = []
        yield from _batches(windows.rows(sorted(windows.held.items()), base, part, keep))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each piece of a packed sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty, and an empty text is the end id alone. Rows that repeat are packed as often as they occur; a null
    doc_id stays null. Sequence ids are unique, not gapless. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokenizer(tokenizer_path), np.array([END_ID], "<u4").tobytes()

        def pieces():
            for batch in batches:
                group = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += end
                    group += [(doc_id, i // 4, ids[i : i + 4 * window], len(ids) // 4) for i in range(0, len(ids), 4 * window)]
                yield group

        return _packed([(TaskContext.get().partitionId(), pieces())], window, open_windows, min_cut, 0, True)

    def merge(level: int, keep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = (p for batch in batches for p in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "start", "left", "doc_tokens")], strict=True))
            groups = ((part, ([p[1:]] for p in some)) for part, some in groupby(pieces, lambda p: p[0]))
            return _packed(groups, window, open_windows, min_cut, level, keep)

        return run

    out = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, SCHEMA), "packed")
    parts, done, level = (out.agg(F.max("part")).first()[0] or 0) + 1, [out.where("left is null")], 0
    while True:
        level, groups = level + 1, -(-parts // fan_in)
        rest = out.where("left is not null").withColumn("part", F.expr(f"cast(part div {fan_in} as int)"))
        # A task may hold several groups, one after the other; the order within makes a repeated task pack alike.
        rest = (rest.repartition(groups, "part") if groups > 1 else rest.coalesce(1)).sortWithinPartitions("part", "sequence_id", "offset")
        out = staged(rest.mapInArrow(merge(level, groups > 1), SCHEMA), f"merged{level}")
        done.append(out.where("left is null"))
        if groups == 1:
            break
        parts = groups
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.drop("part", "left")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
