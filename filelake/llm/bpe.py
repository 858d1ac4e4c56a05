"""Byte-pair encoding read from public tokenizer files (never trained here).

``Vocabulary`` loads a ``tokenizers`` JSON file; the pieces below give the same ids as
that library with ``add_special_tokens=False``:

* ``merge_piece``: one pre-token at a time, lowest rank first, leftmost first.
* ``whole_tokens``: the offline proof of which vocabulary strings encode alone as one token.
* ``PairIndex``: all new pre-tokens of a partition at once over a pair occurrence index.

Texts are cut at single spaces into *chunks*, and the encoding of each distinct chunk (with
its leading space) is remembered. No pre-token reaches across such a cut: a space can only
begin one, and white space around a space (``JOINS``, ``byte`` rules only) sends the text whole.
Special strings inside texts become their ids, as is the library's default. A chunk with one,
or with a character that Python's Unicode tables do not know yet (``newer``), is handed to
the library itself, whose tables may differ there.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space on both sides of a space: only there can a pre-token of the ``byte`` rules reach across a single space.
JOINS = r"  |[\t-\r\x1c-\x1f\x{85}\p{Z}] [\t-\r\x1c-\x1f\x{85}\p{Z}]"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def _newer() -> tuple[re.Pattern[str], np.ndarray]:
    unknown = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    found = [m.group() for m in regex.finditer(r"[^\p{Cn}\p{Cs}]", unknown)]
    table = np.zeros(sys.maxunicode + 1, bool)
    table[[ord(c) for c in found]] = True
    return re.compile("[" + "".join(map(re.escape, found)) + "]" if found else r"(?!)"), table


def newer() -> re.Pattern[str]:
    """Characters assigned in newer Unicode tables than Python's: letter classes and case may differ between libraries."""
    return _newer()[0]


def any_newer(text: str) -> bool:
    """Does a long text hold one of those characters? One look at a table for each character."""
    return not text.isascii() and bool(_newer()[1][np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


class Vocabulary:
    """Tokens, merge ranks and text rules of one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max(*self.ids.values(), *self.special.values()) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.ids[a], self.ids[b]] = (r, self.ids[a + b])
        self.words = spec["normalizer"] is not None  # lower case, white space dropped, words end with the suffix
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self.spaced = regex.compile(WORD_PATTERN + "| ")
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.byte_ids = [self.ids[c] for c in alphabet]
        self.last_ids = [self.ids[c + self.suffix] for c in alphabet] if self.suffix else self.byte_ids
        made = {m: r for r, m in self.ranks.values()}
        #: Each merge comes after the merges that make its parts, so ranks may be applied corpus-wide in ascending order.
        self.ordered = len(made) == len(self.ranks) and all(max(made.get(a, -1), made.get(b, -1)) < r for (a, b), (r, _) in self.ranks.items())

    def normalize(self, text: str) -> str:
        if not self.words:
            return text
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    @property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, without truncation or padding."""
        if not hasattr(self, "_library"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def plain(self, text: str) -> list[int]:
        """Ids of a text whose special strings are ordinary text, by the faster of the two libraries where ids follow merge order."""
        if not hasattr(self, "_ranked"):
            made = [m for _, m in sorted(self.ranks.values())]
            self._ranked = None
            if not self.words and self.ordered and made == sorted(made):
                ranks = {bytes(map(self.byte_of.__getitem__, t)): i for t, i in self.ids.items() if t not in self.special}
                self._ranked = tiktoken.Encoding("plain", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self._ranked.encode_ordinary(text) if self._ranked else self.library.encode(text, add_special_tokens=False).ids

    @property
    def spaces(self) -> np.ndarray:
        """Which ids begin with a space (the byte alphabet's stand-in of 0x20)."""
        if not hasattr(self, "_spaces"):
            self._spaces = np.array([t.startswith("\u0120") for t in self.tokens])
        return self._spaces

    def odd(self, chunk: str) -> bool:
        """Does ``chunk`` hold a special string or a character newer than Python's Unicode tables? Then the library encodes it."""
        return "<|" in chunk and any(s in chunk for s in self.special) or not chunk.isascii() and newer().search(chunk) is not None

    def encode_odd(self, chunk: str) -> list[int]:
        return self.library.encode(chunk, add_special_tokens=False).ids

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk that is not ``odd``."""
        return self.pattern.findall(self.normalize(chunk))

    def any_odd(self, joined: str) -> bool:
        """May any chunk of a joined text be ``odd``?"""
        return "<|" in joined or any_newer(joined)

    def pieces_of(self, chunks: list[str]) -> list[str]:
        """Pre-tokens of chunks that are not ``odd``, one chunk after the other, with one " " between two chunks.

        Only where white space is dropped (``words``): a space is then never part of a pre-token.
        """
        return self.spaced.findall(self.normalize(" ".join(chunks)))

    def start(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        out = [self.byte_ids[b] for b in raw]
        if out:
            out[-1] = self.last_ids[raw[-1]]
        return out

    def merge_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token; a heap keeps very long ones near linear."""
        sym = self.start(piece)
        n = len(sym)
        ranks = self.ranks
        if n < 40:
            while n > 1:
                best, at = None, -1
                for i in range(n - 1):
                    r = ranks.get((sym[i], sym[i + 1]))
                    if r is not None and (best is None or r[0] < best[0]):
                        best, at = r, i
                if best is None:
                    break
                sym[at : at + 2] = [best[1]]
                n -= 1
            return sym
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1], sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := ranks.get((sym[x], sym[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], sym[x], sym[y]))
        return [s for s in sym if s >= 0]

    def whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings that, standing alone as a pre-token, are proved to encode as one token."""
        found = []
        for token, i in self.ids.items():
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            try:
                text = bytes(self.byte_of[c] for c in body).decode("utf-8")
            except (UnicodeDecodeError, KeyError):
                continue
            if text and self.merge_piece(text) == [i]:
                found.append(text)
        return frozenset(found)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


NONE = np.int32(1 << 30)  # rank of a pair that no rule merges


class PairIndex:
    """Encodes many pre-tokens at once over an index from pairs to all their positions.

    The pre-tokens lie behind one another in one array, each symbol linked to its neighbours. The index
    lists the positions of every active pair, in windows of ascending rank (one pair each for
    the first ranks, then ``GROWTH`` more at a time, as pairs get rarer). The lowest window that has
    positions is taken: in each pre-token its lowest rank is merged wherever it is listed (equal halves, as in
    "aaaa", left to right), and only the pairs beside a merge are looked up again and listed anew. New pairs
    have a higher rank than the merge that made them, so they fall in this window, which is then
    taken again, or in a later one. Pre-tokens over ``LONG`` bytes would take a window very often;
    ``merge_piece`` takes them one by one, in the same order, with a heap.
    Needs a vocabulary whose merges come after their parts (``ordered``).
    """

    LONG = 200
    GROWTH = 1.05

    def __init__(self, vocab: Vocabulary) -> None:
        if not vocab.ordered:
            raise ValueError("merge order does not allow corpus-wide application")
        self.vocab, self.wall = vocab, len(vocab.tokens)  # the wall stands between two pre-tokens and merges with nothing
        self.wide = self.wall + 1
        rules = sorted((r, a, b, m) for (a, b), (r, m) in vocab.ranks.items())
        self.made = np.array([m for *_, m in rules], np.int32)
        keys = np.array([a * self.wide + b for _, a, b, _ in rules], np.int64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.bytes_, self.last_ = np.array(vocab.byte_ids, np.int32), np.array(vocab.last_ids, np.int32)
        every = np.arange(256, dtype=np.int32)
        self.starting = np.stack([self._ranks(np.repeat(self.bytes_, 256), end[np.tile(every, 256)]) for end in (self.bytes_, self.last_)])
        ends, end = [], 0
        while end < len(rules):
            end = max(end + 1, int(end * self.GROWTH))
            ends.append(end)
        #: The window of each rank, and one past the last for pairs without a rule.
        self.window = np.append(np.searchsorted(ends, np.arange(len(rules)), side="right"), len(ends)).astype(np.int32)
        #: Merges done and positions looked at or looked up again, for tests.
        self.merged = self.touched = 0

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.wide + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def _list(self, lists: list[list[np.ndarray]], at: np.ndarray, rank: np.ndarray) -> None:
        """Enter positions into the lists of their windows; pairs without a rule into none."""
        window = self.window[np.minimum(rank, len(self.made))]
        order = np.argsort(window, kind="stable")
        order = order[: np.count_nonzero(window < len(lists))]
        if len(order):
            window, at = window[order], at[order]
            cut = np.flatnonzero(np.diff(window)) + 1
            begin = [0, *cut.tolist()]
            for w, x, y in zip(window[begin].tolist(), begin, [*begin[1:], len(at)], strict=True):
                lists[w].append(at[x:y])

    def encode(self, pieces: list[str]) -> list[list[int]]:
        raws, out = [p.encode("utf-8") for p in pieces], [[] for _ in pieces]
        own = [k for k, r in enumerate(raws) if 0 < len(r) <= self.LONG]
        for k, r in enumerate(raws):
            if len(r) > self.LONG:
                out[k] = self.vocab.merge_piece(pieces[k])
        if not own:
            return out
        raw = np.frombuffer(b"\0".join([b"", *[raws[k] for k in own], b""]), np.uint8)
        size = np.fromiter((len(raws[k]) for k in own), np.int64, len(own))
        walls = np.append(0, np.cumsum(size + 1))
        piece = np.repeat(np.arange(len(own), dtype=np.int32), size + 1)
        piece = np.append(piece, len(own) - 1)  # a wall counts to the pre-token after it
        sym = self.bytes_[raw]
        sym[walls[1:] - 1] = self.last_[raw[walls[1:] - 1]]
        sym[walls] = self.wall
        rank = np.full(len(raw), NONE, np.int32)
        inner = np.ones(len(raw), bool)
        inner[walls] = inner[walls[1:] - 1] = False
        inner = np.flatnonzero(inner)
        ends = np.zeros(len(raw), np.int8)
        ends[walls[1:] - 1] = 1
        rank[inner] = self.starting[ends[inner + 1], raw[inner].astype(np.int32) << 8 | raw[inner + 1]]
        after, before = np.arange(1, len(raw) + 1, dtype=np.int32), np.arange(-1, len(raw) - 1, dtype=np.int32)
        lists: list[list[np.ndarray]] = [[] for _ in range(int(self.window[-1]))]
        self._list(lists, inner.astype(np.int32), rank[inner])
        fresh = np.zeros(len(raw), bool)
        for w in range(len(lists)):
            while lists[w]:
                at = np.unique(np.concatenate(lists[w]))
                lists[w] = []
                mine = rank[at]
                at = at[self.window[np.minimum(mine, len(self.made))] == w]  # others changed since they were listed
                if not len(at):
                    break
                self.touched += len(at)
                mine, where = rank[at], piece[at]
                first = np.flatnonzero(np.diff(where, prepend=-1))
                low = np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(at))))
                if (low < mine).any():
                    lists[w].append(at[low < mine])
                at = at[low == mine]
                if len(at) > 1 and (near := after[at[:-1]] == at[1:]).any():  # runs of one symbol: every second pair
                    place = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.append(True, ~near), place, 0))
                    at = at[(place - begin) % 2 == 0]
                gone = after[at]
                follow = after[gone]
                sym[at] = self.made[rank[at]]
                sym[gone], rank[gone] = -1, NONE
                after[at], before[follow] = follow, at
                fresh[at] = True
                left = before[at]
                beside = np.concatenate([at, left[~fresh[left]]])
                fresh[at] = False
                rank[beside] = self._ranks(sym[beside], sym[after[beside]])
                self.merged += len(at)
                self.touched += len(beside)
                self._list(lists, beside, rank[beside])
        alive = (sym >= 0) & (sym != self.wall)
        bound = np.append(0, np.cumsum(alive))[walls].tolist()
        ids = sym[alive].tolist()
        for k, x, y in zip(own, bound, bound[1:], strict=False):
            out[k] = ids[x:y]
        return out
