"""Byte-pair encoding by rank, with the pre-tokens and vocabulary of a tokenizer file.

A text is cut at single spaces between two visible characters, which are always
borders of pre-tokens. What stands between two cuts is encoded once and remembered.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: Longer chunks are encoded each time, and this many chunks are remembered at most.
CHUNK, CHUNKS = 64, 500_000
NEVER = 1 << 62
_BESIDE = re.compile(r" \s|\s ")
_BORDER = re.compile(r"(?<!\s) (?!\s)")
#: Latin letters without marks of their own, and ASCII without the controls on which libraries differ.
LATIN = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017e"
PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{LATIN}]*\Z")
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Ranked merges over token ids."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in merges)
        self.size = max(vocab.values(), default=0) + 1
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank: dict[int, int] = {}
        for k, (a, b, c) in enumerate(self.parts):
            self.rank.setdefault(a * self.size + b, k)

    def apply(self, ids: list[int]) -> list[int]:
        """The ids after all merges, lowest rank first and from the left."""
        if len(ids) > 48:
            return self._apply_long(ids)
        rank, size, parts = self.rank, self.size, self.parts
        while len(ids) > 1:
            best = min([rank.get(a * size + b, NEVER) for a, b in zip(ids, ids[1:])])
            if best == NEVER:
                break
            a, b, c = parts[best]
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and ids[i] == a and ids[i + 1] == b:
                    out.append(c)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _apply_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap of pairs over a linked list."""
        n, ids = len(ids), list(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, size, parts = self.rank, self.size, self.parts
        heap = [(k, i) for i in range(n - 1) if (k := rank.get(ids[i] * size + ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            a, b, c = parts[k]
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (k := rank.get(ids[x] * size + ids[y], NEVER)) != NEVER:
                    heapq.heappush(heap, (k, x))
        return [x for x in ids if x >= 0]


class ByteLevel:
    """A byte-level BPE tokenizer file: its pre-tokens, and its merges by rank.

    Pre-tokens of plain Latin text are cut by a pattern of the same meaning; all
    other text is cut by the library itself, with its own version of Unicode.
    """

    def __init__(self, source: str):
        file = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.vocab: dict[str, int] = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges = Merges(self.vocab, file["model"]["merges"])
        self._pieces = self.library.pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.letter_ids = [self.vocab[c] for c in letters]
        # ids that rise with the rank can serve the compiled merges as ranks
        self._compiled = None
        if all(c >= 256 and (k == 0 or c > self.merges.parts[k - 1][2]) for k, (_, _, c) in enumerate(self.merges.parts)):
            ranks = {self.raw(t): i for t, i in self.vocab.items()}
            self._compiled = tiktoken.Encoding("ranks", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def raw(self, piece: str) -> bytes:
        """The bytes behind byte letters."""
        of = self.byte_of
        return bytes([of[c] for c in piece])

    def pieces(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a chunk."""
        if PLAIN.match(chunk):
            return [p.encode() for p in _PRETOKENS.findall(chunk)]
        return [self.raw(p) for p, _ in self._pieces(chunk)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if self._compiled is not None:
            return self._compiled(piece)
        return self.merges.apply([self.letter_ids[b] for b in piece])

    def chunks(self, text: str) -> list[str]:
        """Parts of the text that are encoded each on its own; special strings stand alone."""
        if self._cut is None or not any(s in text for s in self.special):
            return spaced(text)
        return [c for k, part in enumerate(self._cut.split(text)) for c in ([part] if k % 2 else spaced(part) if part else [])]


def spaced(text: str) -> list[str]:
    """The text cut before each space that stands alone between visible characters."""
    parts = _BORDER.split(text) if _BESIDE.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


class Remembered(dict):
    """A bounded memo of ``fn`` by chunk."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, chunk):
        value = self.fn(chunk)
        if len(chunk) <= CHUNK:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = value
        return value


@lru_cache(maxsize=2)
def byte_level(source: str) -> ByteLevel:
    return ByteLevel(source)
