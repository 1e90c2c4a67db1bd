"""URL filter rules as one bit-parallel wildcard automaton.

All glob rules (stars, ``?`` and classes anywhere) are packed into the bits of a few 64-bit words
(Shift-And with self-loops for the stars) and advanced together, one character of every URL of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_bytes, trimmed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


SPECIAL = "*?[]\\"


@dataclass(frozen=True)
class Rule:
    """``name`` is host and path, as ``example.net/en/``; it holds for the host and its subdomains.

    ``pattern``, if given, is a glob over ``.host/path`` that decides instead of the name.
    """

    name: str
    verdict: str
    pattern: str | None = None

    @property
    def glob(self) -> str:
        own = "".join("\\" + c if c in SPECIAL else c for c in self.name)
        return f"*.{own}**" if self.pattern is None else self.pattern


#: Bytes that begin a character, those that continue one, and all but the slash.
CONTINUED = frozenset(range(0x80, 0xC0))
BEGINS = frozenset(range(256)) - CONTINUED
SEGMENT = frozenset(range(256)) - {ord("/")}


def parse_class(glob: str, at: int) -> tuple[frozenset[int], int]:
    """Bytes that begin the characters of the class at ``at``, and where it ends; characters of a class are ASCII."""
    i = at + 1
    negated = glob[i : i + 1] in ("!", "^")
    i += negated
    end = glob.find("]", i + 1)
    if end < 0:
        raise ValueError(f"class without end: {glob}")
    own: set[int] = set()
    while i < end:
        ranged = glob[i + 1] == "-" and i + 2 < end
        last = glob[i + 2] if ranged else glob[i]
        if not (glob[i] <= last and last.isascii()):
            raise ValueError(f"no class of ASCII characters: {glob}")
        own |= set(range(ord(glob[i]), ord(last) + 1))
        i += 3 if ranged else 1
    return (BEGINS & SEGMENT) - own if negated else frozenset(own) - {ord("/")}, end + 1


def tokens(glob: str) -> tuple[list[tuple[frozenset[int], bool]], dict[int, frozenset[int]]]:
    """(the bytes that each position takes, with whether the rest of a character may follow; bytes that a star before position j passes over).

    ``*`` passes over anything within a part of the path or the host, ``**`` over anything at all, ``?``
    stands for one character other than a slash, ``[a-z]`` and ``[!a-z]`` for one of, or none of, some
    ASCII characters (no slash), a backslash takes the next character as it is.
    """
    taken: list[tuple[frozenset[int], bool]] = []
    stars: dict[int, frozenset[int]] = {}
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            wide = glob[i : i + 2] == "**"
            stars[len(taken)] = stars.get(len(taken), frozenset()) | (frozenset(range(256)) if wide else SEGMENT)
            i += 1 + wide
        elif c == "?":
            taken.append((BEGINS & SEGMENT, True))
            i += 1
        elif c == "[":
            own, i = parse_class(glob, i)
            taken.append((own, True))
        else:
            i += c == "\\" and i + 1 < len(glob)
            taken += [(frozenset([b]), False) for b in glob[i].encode()]
            i += 1
    return taken, stars


class GlobAutomaton:
    """Multiword Shift-And over bytes: bit j of a glob is on while its first j positions fit; stars keep a bit on."""

    def __init__(self, globs: Sequence[str]):
        parsed = [tokens(g) for g in globs]
        bits = sum(len(taken) + 1 for taken, _ in parsed)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # bits that a character lets in
        self.loop = np.zeros((256, self.words), np.uint64)  # bits that stay on at a character
        self.first = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []

        def on(table: np.ndarray, bit: int, chars: frozenset[int]) -> None:
            table[sorted(chars), bit // 64] |= np.uint64(1 << (bit % 64))

        at = 0
        for taken, stars in parsed:
            self.first[at // 64] |= np.uint64(1 << (at % 64))
            for j, (chars, continued) in enumerate(taken, 1):
                on(self.step, at + j, chars)
                if continued:
                    on(self.loop, at + j, CONTINUED)
            for j, chars in stars.items():
                on(self.loop, at + j, chars)
            self.last.append(((at + len(taken)) // 64, np.uint64(1 << ((at + len(taken)) % 64))))
            at += len(taken) + 1

    def match(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """bool[url, rule]: does the rule fit the whole text?"""
        n, length = len(offsets) - 1, np.diff(offsets)
        order = np.argsort(-length, kind="stable")  # so that those still running are a prefix
        starts, sorted_len = offsets[:-1][order], length[order]
        state = np.repeat(self.first[None, :], n, 0)
        running = n
        for j in range(int(sorted_len[0]) if n else 0):
            running = int(np.searchsorted(-sorted_len[:running], -j, "left"))
            c = data[starts[:running] + j]
            now = state[:running]
            shifted = now << np.uint64(1)
            if self.words > 1:
                shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:running] = (shifted & self.step[c]) | (now & self.loop[c])
        found = np.zeros((n, len(self.last)), bool)
        for r, (word, bit) in enumerate(self.last):
            found[order, r] = (state[:, word] & bit) != 0
        return found


def canonical(url) -> tuple:
    """(host, path) columns: the host after the first ``://`` in lower case, the path up to ``?`` or ``#``."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page: of the fitting rules the one with the longest name decides.

    A null url, or one without ``://``, has an empty host and path and gets ``default``; so does a
    url that no rule fits.  Of rules equally long the first by name decides.  Repeated rows stay
    repeated, a null page_id stays null, other columns are ignored, no pages give no rows.  No shuffle: rules travel with the task, pages are scanned.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    host, path = canonical(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))

    @trimmed
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([r.glob for r in ranked])
        names = np.array([r.name for r in ranked] + [None], object)
        verdicts = np.array([r.verdict for r in ranked] + [default], object)
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            offsets, data = text_bytes(pa.array([f".{h}{p}" for h, p in zip(hosts, paths, strict=True)], pa.string()))
            found = automaton.match(offsets, data)
            best = np.where(found.any(1), found.argmax(1), len(ranked)) if len(ranked) else np.zeros(len(hosts), int)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
