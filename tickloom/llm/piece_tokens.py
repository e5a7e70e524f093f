"""SentencePiece BPE ids of whole texts, and texts of ids, by vectorised merge rounds.

A text is white-space escaped and cut into words (a run of spaces and what
follows it) that no piece of the vocabulary crosses.  The distinct words of a
slice are encoded together in flat numpy arrays: every round takes each word's
least pair rank, merges there (all leftmost non-overlapping places of it where
no piece that contains the merged one ranks before it, else the leftmost only)
and compacts, until no pair is left.  Characters without a piece become their
bytes.

Words of over LONG characters, which are rare, would take a round for nearly
every merge; they are merged by the same order with a heap.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import buffers, release, span_hashes
from tickloom.llm.workspace import bound_batches

#: Bytes of text encoded at a time, ids decoded at a time, characters of a word from which a heap merges it.
SLICE, IDS, LONG = 1 << 20, 1 << 18, 1024
SPACE = "▁"
_NONE = np.int32(2**31 - 1)
_WIDE = np.int64(1 << 21)
# Texts whose ids tell a model's rules (dummy prefix, kept white space, byte fallback, ties) from others'.
_PROBES = ["", " ", "a", "  a  b ", "Hello, world", "\t\n", "é̈ｆ​﻿", "<s>x</s><0x41>", "\x00", "▁x", "     " * 9, "aaaaaaaaaaaa", "\U0001f44d\U0010ffff"]


def _gather(bounds: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of values[bounds[i] : bounds[i + 1]] for i in at, and the lengths of its parts."""
    n = bounds[at + 1] - bounds[at]
    ends = np.cumsum(n)
    where = np.repeat(bounds[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return values[where], n


class Pieces:
    """A SentencePiece BPE model with identity normalisation, a dummy prefix and byte fallback.

    A model with other rules raises ValueError.
    """

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = sp.get_piece_size(), sp.eos_id()
        kinds = [(sp.is_unknown(i), sp.is_control(i), sp.is_byte(i)) for i in range(self.size)]
        names = [sp.id_to_piece(i) for i in range(self.size)]
        ids = {p: i for i, (p, k) in enumerate(zip(names, kinds)) if not any(k)}
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        self.rank = np.append(np.unique(-scores, return_inverse=True)[1].astype(np.int32), _NONE)  # the last one, at -1, is no piece's
        self.byte_id = np.zeros(256, np.int32)
        self.is_byte = np.array([k[2] for k in kinds])
        shown: list[bytes] = []
        for i, (p, (unknown, control, byte)) in enumerate(zip(names, kinds)):
            if byte:
                self.byte_id[int(p[3:5], 16)] = i
            shown.append(bytes([int(p[3:5], 16)]) if byte else b"" if control else b" \xe2\x81\x87 " if unknown else p.replace(SPACE, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum([len(s) for s in shown]))).astype(np.int64)
        self.spaced = np.array([p.startswith(SPACE) and not any(k) for p, k in zip(names, kinds)])
        keys, made = [], []
        first = np.full(self.size, _NONE, np.int32)  # the least rank of a longer piece that begins or ends with this one
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)  # a character without a piece stands past all ids
        inner = False
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
            inner |= SPACE in p.lstrip(SPACE)
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                for x in (a, b):
                    if x is not None:
                        first[x] = min(first[x], self.rank[i])
                if a is not None and b is not None:
                    keys.append(a * int(_WIDE) + b)
                    made.append(i)
        lone = {c for p in ids for c in p} - set(ids)
        self.alone = first > self.rank[:-1]  # all places of such a pair may be merged at once
        self.of = dict(zip(keys, made))
        self._slots(np.array(keys, np.int64), np.array(made, np.int32))
        self.char[ord(" ")] = self.char[ord(SPACE)]
        own = [self.encode(t, self.end) for t in _PROBES]
        if inner or lone or own != [sp.encode(t, add_eos=True) for t in _PROBES] or [self.decode(x) for x in own] != [sp.decode(x) for x in own]:
            raise ValueError(f"{path}: not a BPE model with identity normalisation, a dummy prefix and byte fallback")

    def _slots(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open hash table of pairs, under half full."""
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]], self.made[at[free]] = keys[free], made[free]  # of several keys for one slot the last one stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that the pairs make, -1 for none."""
        key = left * _WIDE + right
        at = self._slot(key)
        held = self.keys[at]
        out = self.made[at]
        todo = np.flatnonzero((held != key) & (held >= 0))
        out[held < 0] = -1
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[todo]]
            out[todo] = np.where(held == key[todo], self.made[at[todo]], np.int32(-1))
            todo = todo[(held != key[todo]) & (held >= 0)]
        return out

    def _merged(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words of n characters each after all merges, and the words' new lengths."""
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)
        done_sym, done_word = [], []
        piece = np.full(len(sym), -1, np.int32)  # what a symbol makes with the next one of its word
        same = np.flatnonzero(word[1:] == word[:-1])
        piece[same] = self._pairs(sym[same], sym[same + 1])
        while len(sym):
            rank = self.rank[piece]
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            many = np.diff(starts, append=len(sym))
            least = np.repeat(np.minimum.reduceat(rank, starts), many)
            over = least == _NONE
            if over.any():  # words without a pair leave
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, piece, rank, least = sym[keep], word[keep], piece[keep], rank[keep], least[keep]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            head = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))  # the leftmost place of each word
            if not head.all():
                step = np.arange(len(at))
                run = np.maximum.accumulate(np.where(head | np.concatenate(([True], np.diff(at) != 1)), step, 0))
                at = at[np.where(self.alone[piece[at]], (step - run) % 2 == 0, head)]
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            near = np.zeros(len(sym), bool)
            near[at] = True
            near[at[1:] - 1 if at[0] == 0 else at - 1] = True  # the symbol before, which may itself be the second half of a merge
            near[np.flatnonzero(near & ~keep) - 1] = True
            sym, word, piece, near = sym[keep], word[keep], piece[keep], np.flatnonzero(near[keep])
            piece[near] = -1
            near = near[near < len(sym) - 1]
            near = near[word[near] == word[near + 1]]
            piece[near] = self._pairs(sym[near], sym[near + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(n), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(n))

    def _heaped(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of one long word after all merges, in the order of rank and place."""
        made = self._pairs(sym[:-1], sym[1:])
        heap = [(int(self.rank[p]), int(i), int(p), int(i) + 1) for i, p in enumerate(made.tolist()) if p >= 0]
        heapq.heapify(heap)
        s, after, before = sym.tolist(), list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        of, wide, n = self.of, int(_WIDE), len(s)
        while heap:
            _, i, p, j = heapq.heappop(heap)
            if s[i] < 0 or after[i] != j or of.get(s[i] * wide + s[j]) != p:
                continue
            s[i], s[j] = p, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (q := of.get(s[a] * wide + s[b])) is not None:
                    heapq.heappush(heap, (int(self.rank[q]), a, q, b))
        return np.array([x for x in s if x >= 0], np.int32)

    def _words(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts (which begin at the offsets texts), where each word begins, and where its ids do."""
        space = raw == 32
        first = space & ~np.r_[False, space[:-1]]
        first[texts[texts < len(raw)]] = True
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], len(raw)]
        _, one, which = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        bounds = np.r_[starts, len(raw)]
        text, lens = _gather(bounds, raw, one)
        code = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((text & 0xC0) != 0x80)  # bytes at which a character begins
        heads = np.searchsorted(lead, np.r_[0, np.cumsum(lens)])
        n = np.diff(heads)
        sym = self.char[code]
        long = np.flatnonzero(n > LONG)
        short = np.repeat(n <= LONG, n)
        got, m = self._merged(sym[short], np.where(n <= LONG, n, 0))
        if len(long):
            parts = np.split(got, np.cumsum(m)[:-1])
            for w in long.tolist():
                parts[w] = self._heaped(sym[heads[w] : heads[w + 1]])
            m[long] = [len(parts[w]) for w in long.tolist()]
            got = np.concatenate(parts)
        odd = np.flatnonzero(got >= self.size)
        if len(odd):  # characters without a piece become their bytes
            spelt = [self.byte_id[list(chr(int(c) - self.size).encode())] for c in got[odd]]
            wide = np.ones(len(got), np.int64)
            wide[odd] = [len(x) for x in spelt]
            at = np.cumsum(wide) - wide
            out = np.repeat(got, wide)
            for i, x in zip(at[odd].tolist(), spelt):
                out[i : i + len(x)] = x
            owner = np.repeat(np.arange(len(m)), m)
            m, got = np.bincount(owner, weights=wide, minlength=len(m)).astype(np.int64), out
        ids, k = _gather(np.r_[0, np.cumsum(m)], got.astype(np.int32), which)
        return ids, starts, np.cumsum(k) - k

    def column(self, column: pa.Array, end: int | None) -> Iterator[np.ndarray]:
        """The ids (int32) of each text; a null text is an empty one.  end, if given, follows every text's ids."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        column = pc.replace_substring(column, SPACE, " ")
        column = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), column, pa.scalar("", pa.large_string()))
        offsets, raw = buffers(column)
        last = np.array([] if end is None else [end], np.int32)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = min(max(int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1, i + 1), n)
            if j == i + 1:
                parts = [self._words(raw[a:b], np.zeros(1, np.int64))[0] for a, b in _cuts(raw, int(offsets[i]), int(offsets[j]))]
                yield np.concatenate((*parts, last))
            else:
                ids, words, at = self._words(raw[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
                heads = np.r_[at, len(ids)][np.searchsorted(words, offsets[i : j + 1] - offsets[i])]
                for k in range(j - i):  # a text begins with a word
                    yield np.concatenate((ids[heads[k] : heads[k + 1]], last))
            i = j

    def encode(self, text: str | None, end: int | None = None) -> list[int]:
        return next(self.column(pa.array([text], pa.string()), end)).tolist()

    def decode(self, ids) -> str:
        """The text of ids: bytes of byte pieces, nothing for control pieces, less the dummy prefix; bytes that are no UTF-8 are U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        if ((ids < 0) | (ids >= self.size)).any():
            raise ValueError("an id is not in the vocabulary")
        seen = np.flatnonzero(self.bounds[ids + 1] > self.bounds[ids])
        parts = [_gather(self.bounds, self.shown, ids[a : a + IDS])[0].tobytes() for a in range(0, len(ids), IDS)]
        data = b"".join(parts)
        cut = int(len(seen) > 0 and self.spaced[ids[seen[0]]])
        if not len(seen) or seen[-1] - seen[0] + 1 == len(seen):  # no control piece parts two byte pieces
            try:
                return data[cut:].decode()
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.shown[self.bounds[i] : self.bounds[i + 1]].tobytes()
                continue
            out.append(_lenient(bytes(run)))
            run.clear()
            out.append(self.shown[self.bounds[i] : self.bounds[i + 1]].tobytes().decode())
        return "".join((*out, _lenient(bytes(run))))[cut:]


def _lenient(run: bytes) -> str:
    """Bytes as UTF-8, with one U+FFFD for each byte that begins no character."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        i += n
    return "".join(out)


def _cuts(raw: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of about SLICE bytes that begin where a word does; a longer word is not cut."""
    while a < b:
        end = min(a + SLICE, b)
        while end < b:
            near = raw[end - 1 : min(end + 65536, b)] == 32
            hit = np.flatnonzero(near[1:] & ~near[:-1])
            if len(hit):
                end += int(hit[0])
                break
            end = min(end + 65535, b)
        yield a, end
        a = end


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(path: str, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = pieces(path)
        for batch in batches:
            ids = list(model.column(batch.column(1), model.end if end else None))
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            lists = batch.column(1)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            texts = [None if g else model.decode(flat[a:b]) for g, a, b in zip(gone.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each whole text's ids by the SentencePiece model in the file, one row a row of docs.

    With end, the model's end id follows.  Null or empty text: no other id.
    Null or repeated ids: every row is encoded.  A text of any length is encoded
    in slices at its words.  Other columns are not read.  Empty table: no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(model, end), "doc_id long, ids array<int>")


def decode_pieces(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids): the text that the ids spell, null for null ids, empty for none."""
    bound_batches(tokens.sparkSession)
    return tokens.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(_decoded(model), "doc_id long, ids array<int>, decoded string")
