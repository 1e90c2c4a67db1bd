"""Exact, cached encoding with a public tokenizer file, many texts at a time.

A text is cut at single spaces that stand between two non-space characters.  The pre-tokenizers
of both vocabularies always start a new piece there, so the ids of a text are the ids of its
pieces, one after the other.  Pieces are looked up as arrays in an open-addressing table and
compared byte by byte: those of up to sixteen bytes as two numbers, longer ones as byte strings.
Each new one is encoded once a worker, and ids are gathered from one flat array.  Texts where the
cut doesn't hold (runs of white space next to a space, special-token strings) are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from graphloom.llm.words import BASE, FIRST_BYTES, Words, mix, words_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Slots of a worker's table (a power of two), pieces and bytes of long pieces that it keeps; beyond that it forgets the later ones.
SLOTS, MOST_PIECES, LONG_BYTES = 1 << 21, 900_000, 8 << 20
#: Bytes of text cut at once, pieces encoded at once (each holds Python objects for a while), and pieces joined to one input.
TEXT_BYTES, ENCODED, JOINED = 1 << 19, 4096, 64
#: Bytes of a piece that is compared as two numbers.
SHORT = 16
#: Pieces of printable Latin characters: composition leaves them alone, lower case is one character for one, none is white space.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+").fullmatch
BLANK = np.zeros(256, bool)
BLANK[0x20] = True
FIRST = 32  # set in the tag of a piece that begins its text


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for at least n values."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Encoder:
    """A vocabulary with the ids of all pieces seen so far."""

    def __init__(self, path: str, slots: int = SLOTS, most_pieces: int = MOST_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Does a piece keep the space before it?
        self.spaced = self.tokenizer.normalizer is None
        added = self.tokenizer.get_added_tokens_decoder().items()
        self.separator = next(((t.content, i) for i, t in sorted(added, key=lambda x: x[0]) if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word)), ("", -1))
        self.plain = self._without_normalizer(path)
        self.slots, self.most_pieces = np.empty(slots, np.int32), min(most_pieces, slots // 2)
        self.block = self.most_pieces // 2
        self._clear()

    def _without_normalizer(self, path: str):
        """The tokenizer for lower-cased plain pieces, where its normalizer does nothing else to them; else None."""
        from tokenizers import Tokenizer

        config = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        steps = [(s["type"], s.get("pattern", {}).get("Regex")) for s in config.get("normalizers", [])]
        if self.spaced or ("Lowercase", None) not in steps or not set(steps) <= {("NFC", None), ("Lowercase", None), ("Replace", r"\s+")}:
            return None
        plain = Tokenizer.from_file(path)
        plain.normalizer = None
        return plain

    def _clear(self) -> None:
        self.slots[:] = -1
        self.long: dict[tuple[bytes, bool], int] = {}
        self.count = self.used = self.long_bytes = 0
        # a piece's first and next eight bytes, its length and place in its text, where its ids are and how many (-1: can't stand alone)
        self.k0, self.k1, self.tag = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)

    def _shrink(self) -> None:
        """Keeps the third of the pieces that were learned first, which are the most frequent ones, and forgets the others."""
        keep = self.most_pieces // 3 if self.long_bytes <= LONG_BYTES else 0
        if not 0 < keep < self.count:
            self._clear()
            return
        self.used = int(self.at[keep])
        self.count = keep
        self.slots[:] = -1
        self.long = {k: n for k, n in self.long.items() if n < keep}
        self.long_bytes = sum(len(p) for p, _ in self.long)
        short = np.flatnonzero(self.tag[:keep] > 0)
        self._put(mix(self.k0[short] * np.uint64(BASE) ^ mix(self.k1[short] + self.tag[short])), short)
        self.tag[keep:] = 0

    def _encode_apart(self, inputs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each input, all ids)."""
        if not self.plain:
            return self._encode_marked(inputs, self.tokenizer)
        plain = np.fromiter((PLAIN(p) is not None for p in inputs), bool, len(inputs))
        groups = np.flatnonzero(plain), np.flatnonzero(~plain)
        parts = [self._encode_marked([inputs[i].lower() for i in groups[0].tolist()], self.plain), self._encode_marked([inputs[i] for i in groups[1].tolist()], self.tokenizer)]
        order, both, flat = np.concatenate(groups), np.concatenate([s for s, _ in parts]), np.concatenate([f for _, f in parts])
        sizes, begins = np.empty(len(inputs), np.int64), np.empty(len(inputs), np.int64)
        sizes[order], begins[order] = both, np.cumsum(both) - both
        return sizes, flat[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))]

    def _encode_marked(self, inputs: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Inputs are joined by a special token, which none of them holds and which parts the encoding."""
        sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        mark, end = self.separator
        for i in range(0, len(inputs), ENCODED):
            part = inputs[i : i + ENCODED]
            joined = [mark.join(part[j : j + JOINED]) + mark for j in range(0, len(part), JOINED)] if mark else part
            encoded = [e.ids for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(encoded), np.uint32)
            ends = np.flatnonzero(flat == end) if mark else np.cumsum([len(x) for x in encoded]) - 1
            sizes.append(np.diff(np.concatenate([[-1], ends])) - bool(mark))
            values.append(flat[flat != end] if mark else flat)
        return np.concatenate(sizes), np.concatenate(values)

    def _learn(self, pieces: list[str], first: list[bool]) -> np.ndarray:
        """Encodes new pieces; their numbers."""
        alone = [not (p[0].isspace() or p[-1].isspace() or "<|" in p) for p in pieces]
        inputs = [" " + p if self.spaced and not f else p for p, a, f in zip(pieces, alone, first, strict=True) if a]
        lengths, flat = self._encode_apart(inputs)
        n = self.count + len(pieces)
        self.k0, self.k1, self.tag, self.at, self.size = (grown(a, n) for a in (self.k0, self.k1, self.tag, self.at, self.size))
        size = np.full(len(pieces), -1, np.int32)
        size[np.array(alone, bool)] = lengths
        self.size[self.count : n] = size
        self.at[self.count : n] = self.used + np.concatenate([[0], np.cumsum(np.maximum(size, 0))[:-1]])
        self.ids = grown(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        numbers = np.arange(self.count, n)
        self.used, self.count = self.used + len(flat), n
        return numbers

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Enters distinct pieces into the table."""
        last = np.uint64(len(self.slots) - 1)
        while len(numbers):
            slot = (hashes & last).astype(np.int64)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]  # of several for one slot the last stays
            left = self.slots[slot] != numbers
            hashes, numbers = hashes[left] + np.uint64(1), numbers[left]

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of every piece data[start:end] (-1: can't stand alone), and their ids one after the other."""
        length = ends - starts
        if self.count + len(length) > self.most_pieces or self.long_bytes > LONG_BYTES:
            self._shrink()
        numbers = np.full(len(length), -1, np.int64)
        short = np.flatnonzero(length <= SHORT)
        padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(SHORT, np.uint8)]), SHORT)
        own, n = padded[starts[short]].view("<u8"), length[short]
        k0, k1 = own[:, 0] & FIRST_BYTES[np.minimum(n, 8)], own[:, 1] & FIRST_BYTES[np.clip(n - 8, 0, 8)]
        tag = (n + FIRST * first[short]).astype(np.uint8)
        hashes = mix(k0 * np.uint64(BASE) ^ mix(k1 + tag))
        found, pending, last = np.full(len(short), -1, np.int64), np.arange(len(short)), np.uint64(len(self.slots) - 1)
        step = np.uint64(0)
        while len(pending):
            s = self.slots[((hashes[pending] + step) & last).astype(np.int64)].astype(np.int64)
            same = (s >= 0) & (self.k0[s] == k0[pending]) & (self.k1[s] == k1[pending]) & (self.tag[s] == tag[pending])
            found[pending[same]] = s[same]
            pending, step = pending[(s >= 0) & ~same], step + np.uint64(1)
        fresh = np.flatnonzero(found < 0)
        raw = data.tobytes() if len(fresh) or len(short) < len(length) else b""
        if len(fresh):
            order = fresh[np.lexsort((tag[fresh], k1[fresh], k0[fresh]))]
            new = np.ones(len(order), bool)
            new[1:] = (k0[order[1:]] != k0[order[:-1]]) | (k1[order[1:]] != k1[order[:-1]]) | (tag[order[1:]] != tag[order[:-1]])
            one = order[new]
            pieces = [raw[s:e].decode() for s, e in zip(starts[short[one]].tolist(), ends[short[one]].tolist(), strict=True)]
            got = self._learn(pieces, first[short[one]].tolist())
            self.k0[got], self.k1[got], self.tag[got] = k0[one], k1[one], tag[one]
            self._put(hashes[one], got)
            found[order] = got[np.cumsum(new) - 1]
        numbers[short] = found
        long = np.flatnonzero(length > SHORT)
        if len(long):
            keys = [(raw[s:e], f) for s, e, f in zip(starts[long].tolist(), ends[long].tolist(), first[long].tolist(), strict=True)]
            unknown = list(dict.fromkeys(k for k in keys if k not in self.long))
            if unknown:
                got = self._learn([p.decode() for p, _ in unknown], [f for _, f in unknown])
                self.long.update(zip(unknown, got.tolist(), strict=True))
                self.long_bytes += sum(len(p) for p, _ in unknown)
            numbers[long] = [self.long[k] for k in keys]
        size = self.size[numbers]
        some = np.maximum(size, 0)
        total = np.concatenate([[0], np.cumsum(some)])
        return size, self.ids[np.repeat(self.at[numbers] - total[:-1], some) + np.arange(total[-1])]

    def _all_pieces(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """``_pieces`` of all words, a bounded number at a time: a text may be of any length."""
        first = np.zeros(len(w.starts), bool)
        if self.spaced:
            first[w.bounds[:-1][w.bounds[:-1] < w.bounds[1:]]] = True
        sizes, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for i in range(0, len(w.starts), self.block):
            starts, ends = w.starts[i : i + self.block], w.ends[i : i + self.block]
            size, own = self._pieces(w.data[starts[0] : ends[-1]], starts - starts[0], ends - starts[0], first[i : i + self.block])
            sizes.append(size)
            ids.append(own)
        return np.concatenate(sizes), np.concatenate(ids)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some texts one after the other, bounds of each text's ids); null texts have none."""
        for w in words_of(column, BLANK, most=TEXT_BYTES):
            n = len(w)
            size, flat = self._all_pieces(w)
            odd = np.zeros(n, bool)
            row = np.repeat(np.arange(n), np.diff(w.bounds))
            odd[row[size < 0]] = True
            wide = np.flatnonzero(w.starts[1:] - w.ends[:-1] != 1) + 1
            wide = wide[row[wide] == row[wide - 1]] if len(wide) else wide
            odd[row[wide]] = True
            # a space at either end, or nothing but spaces
            length = np.diff(w.texts)
            some = w.bounds[:-1] < w.bounds[1:]
            odd |= ~some & (length > 0)
            k = np.flatnonzero(some)
            odd[k] |= (w.starts[w.bounds[k]] != w.texts[k]) | (w.ends[w.bounds[k + 1] - 1] != w.texts[k + 1])
            bounds = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[w.bounds]
            if odd.any():
                parts, raw = [], w.data.tobytes()
                for t in range(n):
                    parts.append(self.whole(raw[w.texts[t] : w.texts[t + 1]].decode()) if odd[t] else flat[bounds[t] : bounds[t + 1]])
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                flat = np.concatenate(parts)
            yield w.row, flat, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
