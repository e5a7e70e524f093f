"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once.

The pre-tokenizers used here never join characters across the start of a run of
white space, so a text is the sequence of its units (white space and the word
after it) and its ids are theirs; likewise marks after a letter, and the text
after a lone newline, start anew.  Units are encoded by the tokenizers library
(plain words by its BPE model at once, which is what its pipeline would do) and
remembered by a 64-bit hash in a cache of fixed size.

Strings of added tokens (such as ``<|endoftext|>``) are those tokens, as in a
plain call of the library: a text is cut at them before anything else.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tickloom.llm.text import KEPT, buffers, release, span_hashes

# The characters with Unicode's property White_Space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: A word of Latin letters and the ASCII marks behind it, but no apostrophe, which may begin a contraction.
_PLAIN = re.compile(f"([{_LATIN}]+)([!-&(-/:-@\\[-`{{-~]*)")
#: Texts where str.split or str.lower may differ from the tokenizer's rules, and where a space has white space after it.
_ODD = re.compile("[\x1c-\x1f]|[^\x00-\u012f\u0131-\u024f]")
_SPACED = re.compile(f" [{_WHITE}]")
#: Entries of the memory of a task, ids of a unit that it keeps (others are made anew), bytes of text encoded at a time.
SLOTS, WIDTH, SLICE = 1 << 19, 8, 1 << 20
#: Units in a dictionary of marks and of odd texts' units, which then starts anew; units over LONG characters are not kept.
MEMORY, LONG = 20_000, 64
_WHITE_HEADS = np.zeros(256, bool)  # bytes that begin a white space character, among others
_WHITE_HEADS[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ODD_BYTES = np.zeros(256, bool)  # bytes of a character that _ODD finds, among others
_ODD_BYTES[[*range(0x1C, 0x20), *range(0xC9, 256)]] = True


def _byte_letters() -> dict[int, str]:
    """Latin letters as byte-level BPE spells them: a printable byte is its own character, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*own}))}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(256) if chr(c).isalpha()}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memory(dict):
    """Ids of units made on demand."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        ids = self.make(unit)
        if len(unit) <= LONG:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = ids
        return ids


class Encoder:
    """text to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest_first)})") if self.added and plain else None
        self.bare = self._whole(" a b") == self._whole("a") + self._whole("b")  # white space is dropped
        self.lower = self.bare and self._whole("AÉ") == self._whole("aé")
        probes = ["word", "élève", "schönßü", "Zq"]
        self.plain = {x: all(self._spelt(x, p.lower() if self.lower else p) == self._whole(x + p) for p in probes) for x in ("", " ")}
        self.memory = {x: _Memory(lambda u, x=x: self._unit(x, u)) for x in ("", " ")}
        self.any = _Memory(self._whole)
        # a cache of one place for each slot: the hash of a unit, the number of its ids, the ids
        self.keys, self.counts, self.ids = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8), np.zeros((SLOTS, WIDTH), "<u4")

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _spelt(self, space: str, word: str) -> bytes:
        """A word of Latin letters through the BPE model."""
        if not word.isascii():
            word = word.translate(self.letters)
        return _packed([t.id for t in self.model.tokenize("Ġ" + word if space else word)])

    def _word(self, space: str, word: str) -> bytes:
        return self._spelt(space, word) if self.plain[space] else self._whole(space + word)

    def _unit(self, space: str, unit: str) -> bytes:
        """A unit without the space before it, where there is one."""
        if unit.isascii() and unit.isalpha():
            return self._word(space, unit)
        if m := _PLAIN.fullmatch(unit):
            word, mark = m.groups()
            return self._word(space, word) + self.any[mark] if mark else self._word(space, word)
        if not self.bare:
            left, line, right = unit.partition("\n")
            if line and left and right and left[-1] not in _WHITE and right[0] not in _WHITE:
                return self._unit(space, left) + self.any[line] + self._unit("", right)
        return self._whole(space + unit)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for token in self.added:
            if token in text:
                if not self.cut:
                    return self._whole(text)
                parts = self.cut.split(text)  # text and token by turns
                return b"".join(self._whole(x) if k % 2 else self._between(x) for k, x in enumerate(parts) if x)
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """A text without added tokens."""
        if self.bare:
            if _ODD.search(text):
                return b"".join(map(self.any.__getitem__, _UNIT.findall(text)))
            return b"".join(map(self.memory[""].__getitem__, (text.lower() if self.lower else text).split()))
        if _SPACED.search(text):
            return b"".join(map(self.any.__getitem__, _UNIT.findall(text)))
        first, *rest = text.split(" ")
        return (self.memory[""][first] if first else b"") + b"".join(map(self.memory[" "].__getitem__, rest))

    def _made(self, unit: bytes) -> bytes:
        """A unit of _known, with the space before it where there is one."""
        text = unit.decode()
        if self.bare:
            return b"".join([self._unit("", u) for u in (text.lower() if self.lower else text).split()])
        return self._unit(" ", text[1:]) if text[0] == " " else self._unit("", text)

    def _odd(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Which texts spaces alone do not cut into units, or hold an added token."""
        if self.bare:
            bad = _ODD_BYTES[raw]
            bad[:-1] |= (raw[:-1] == 0xC4) & (raw[1:] == 0xB0)
        else:
            bad = np.zeros(len(raw), bool)
            bad[:-1] = (raw[:-1] == 32) & _WHITE_HEADS[raw[1:]]
        at = [np.flatnonzero(bad)]
        whole = raw.tobytes()
        for token in self.added:
            at.append(np.array([m.start() for m in re.finditer(re.escape(token.encode()), whole)], np.int64))
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
        return odd

    def _known(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts in a row: all ids, the bounds of each text's, and which texts are odd and have none here."""
        odd = self._odd(offsets, raw)
        head = raw == 32
        head[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(raw))
        keep = ~odd[np.searchsorted(offsets, starts, "right") - 1]
        starts, ends = starts[keep], ends[keep]
        h = np.maximum(span_hashes(raw, starts, ends), np.uint64(1))
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = self.keys[slot] == h
        known = slot[hit]
        new, first, which = np.unique(h[~hit], return_index=True, return_inverse=True)
        a, b = starts[~hit][first], ends[~hit][first]
        made = [self._made(raw[i:j].tobytes()) for i, j in zip(a.tolist(), b.tolist())]
        size = np.array([len(x) // 4 for x in made], np.int64)
        fresh = np.frombuffer(b"".join(made), "<u4")
        arena = np.concatenate((self.ids[known].ravel(), fresh))
        begin, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        begin[hit], count[hit] = np.arange(len(known)) * WIDTH, self.counts[known]
        at = np.cumsum(size) - size
        begin[~hit], count[~hit] = len(known) * WIDTH + at[which], size[which]
        out = np.cumsum(count) - count
        ids = arena[np.repeat(begin - out, count) + np.arange(int(count.sum()))]
        short = np.flatnonzero(size <= WIDTH)
        place, pick = np.unique((new[short] & np.uint64(SLOTS - 1)).astype(np.int64), return_index=True)
        short = short[pick]
        self.keys[place], self.counts[place] = new[short], size[short]
        table = np.zeros((len(short), WIDTH), "<u4")
        inside = np.arange(WIDTH) < size[short][:, None]
        table[inside] = fresh[(at[short][:, None] + np.arange(WIDTH))[inside]]
        self.ids[place] = table
        return ids, np.append(out, len(ids))[np.searchsorted(starts, offsets)], odd

    def column(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column; a long text is encoded in pieces that begin with a space between words."""
        offsets, raw = buffers(column)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1, i + 1)
            bounds = offsets[i : j + 1]
            pieces = _pieces(raw[bounds[0] : bounds[1]]) + bounds[0] if j == i + 1 else bounds
            got = []
            for k in range(len(pieces) - 1) if j == i + 1 else (0,):
                part = pieces[k : k + 2] if j == i + 1 else bounds
                ids, at, odd = self._known(part - part[0], raw[part[0] : part[-1]])
                for t, (p, q) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    got.append(self.encode(raw[part[t] : part[t + 1]].tobytes().decode()) if odd[t] else ids[p:q].tobytes())
            yield from [b"".join(got)] if j == i + 1 else got
            i = j


def _pieces(raw: np.ndarray) -> np.ndarray:
    """Bounds of pieces of about SLICE bytes of one text, each but the first begun by a space between letters or digits."""
    if len(raw) <= SLICE:
        return np.array([0, len(raw)])
    word = _WORD[raw]
    at = np.flatnonzero((raw[1:-1] == 32) & word[:-2] & word[2:]) + 1
    at = at[np.unique(np.searchsorted(at, np.arange(SLICE, len(raw), SLICE)).clip(max=len(at) - 1))] if len(at) else at
    return np.concatenate(([0], at, [len(raw)]))


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.RecordBatch, int, bytes]]:
    """(batch, row, ids with the end id) of every row; the text is the last column, null counts as empty."""
    encoder, tail = KEPT.get(path), np.array([end], "<u4").tobytes()
    if encoder is None:
        release()
        encoder = KEPT[path] = Encoder(path)  # what a task has learned serves the worker's next one
    for batch in batches:
        for row, ids in enumerate(encoder.column(batch.column(batch.num_columns - 1))):
            yield batch, row, ids + tail
