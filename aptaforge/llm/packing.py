"""Operator 6: packing documents into token sequences, best fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aptaforge.llm.common import lean, text_batches, worker_cache

#: Pieces that a task packs together; what a task holds of them is four numbers each.
BATCH = 400_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """A segment tree over remaining capacity: leaf r holds the open windows with r tokens left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.size, dtype=np.int64)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room that still holds ``need``: (room, window)."""
        node = need + self.size
        if not self.count[node]:
            while True:  # up to the first subtree to the right that has windows, then down its left edge
                if node & 1 == 0 and self.count[node + 1]:
                    node += 1
                    break
                node >>= 1
                if node <= 1:
                    return None
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset for each length (1 to ``capacity``), and the number of windows. Longest first, ties in order."""
    windows, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, n = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < capacity else None
        if found is None:
            room, window, n = capacity, n, n + 1
        else:
            room, window = found
        windows[i], offsets[i] = window, capacity - room
        if room > need:
            tree.add(room - need, window)
    return windows, offsets, n


#: How the tokenizer at hand must cut and normalise for words to be taken apart here.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that make a part of their own at the end of a word of letters.
MARKS = frozenset("!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~")
NORMALISE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next unused from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Recent(dict):
    """Ids of words: those missing are taken from the generation before, else made, so that a whole text's words are looked up without a loop in Python."""

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]):
        self.make, self.old = make, old

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        self[w] = ids = self.make(w) if ids is None else ids
        return ids


class WordTokenizer:
    """Ids of texts by a tokenizer whose tokens never cross white space.

    Words recur, so a distinct word is tokenized once while it is kept: in two generations of up to ``most``
    words each; words met again move to the young one. Where the tokenizer normalises and cuts as
    above, new words of letters below U+0250 go part by part straight to its model; all others
    pass through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young = Recent(self.word, {})
        self.parts: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
        self.model = None
        if (
            (spec["normalizer"] or {}).get("normalizers") == NORMALISE
            and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": PARTS}
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and (steps[1]["type"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("ByteLevel", False, False)
        ):
            self.model = self.tokenizer.model
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cut, self.letters = regex.compile(PARTS), byte_letters()

    def word(self, w: str) -> bytes:
        plain = w.isascii()
        if self.model is not None and plain:
            if w.isalpha():
                w = w.lower()
                return self.parts.get(w) or self.part(w)
            head, mark = w[:-1], w[-1:]
            if head.isalpha() and mark in MARKS:
                head = head.lower()
                return (self.parts.get(head) or self.part(head)) + (self.parts.get(mark) or self.part(mark))
        if self.model is None or not w.isprintable() or not plain and max(w) >= "\u0250" or "<" in w and any([a in w for a in self.added]):
            return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        return b"".join([self.parts.get(p) or self.part(p) for p in self.cut.findall(w.lower())])

    def part(self, part: str) -> bytes:
        spelt = part if part.isascii() else "".join([self.letters[b] for b in part.encode("utf-8")])
        ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(part) < 12:
            self.parts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, joined."""
        if len(self.young) > self.most:
            self.young.old = {}
            self.young = Recent(self.word, self.young)
        if len(self.parts) > self.most:
            self.parts.clear()
        # str.split() takes four separators for white space that tokenizers do not
        words = text.split() if not SEPARATORS.search(text) else [w for w in regex.split(r"[^\S\x1c-\x1f]+", text) if w]
        return b"".join(map(self.young.__getitem__, words))


SEPARATORS = re.compile("[\x1c-\x1f]")


def packer(tokenizer: str, capacity: int, end: int):
    @lean("words")
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_cache().setdefault(("words", tokenizer), None) or WordTokenizer(tokenizer)
        worker_cache()["words", tokenizer] = tok
        base, done = TaskContext.get().partitionId() << 40, 0
        tail = np.array([end], dtype="<u4").tobytes()
        cols: list[list] = [[], [], [], [], []]

        def flush():
            nonlocal done
            lengths = np.array(cols[2], dtype=np.int64)
            windows, offsets, n = best_fit_decreasing(lengths, capacity)
            arrays = [pa.array(c, type=pa.int64()) for c in cols] + [pa.array(windows + (base + done)), pa.array(offsets)]
            done += n
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECE.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = tok.encode(text or "") + tail
                n = len(data) // 4
                for start in range(0, n, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    for c, v in zip(cols, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        c.append(v)
            if len(cols[0]) >= BATCH:
                yield flush()
        if cols[0]:
            yield flush()

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task tokenizes its documents, appends id ``end``, cuts what is longer than ``capacity``
    into full windows, and places the rest longest first, each in the open window that it fills
    best. A task leaves a few windows part-filled, so padding does not depend on the number of
    documents; nothing is shuffled. Sequences are filled up to ``capacity``, unless their length is
    a power of two. Null text is empty and has the end id alone; repeated rows are packed each;
    extra columns are ignored.
    """
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packer(tokenizer, capacity, end), PIECE)
