"""BPE with word ends: encoding by backtracking, decoding by an offset table.

The automaton gives the longest token at a place. It is taken if it goes with the
token before it: the merges, undone from both sides of the border, must nowhere
prefer a merge across it. Else the next shorter prefix is tried, and if none goes,
the token before is taken back. Each place is given up at most once, so that the
time is linear and the result is that of the merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import LATIN, PLAIN, Merges, Remembered, byte_letters
from .common import map_batches, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Control characters at which str.split() cuts, though they are no white space here.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
PAIRS = 500_000
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s0-9{LATIN}]+")


class WordBPE:
    """A tokenizer file whose words end with a suffix; encodes and decodes exactly as its merges do."""

    def __init__(self, source: str):
        file = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.vocab: dict[str, int] = file["model"]["vocab"]
        self.suffix: str = file["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.merges = Merges(self.vocab, file["model"]["merges"])
        self._normal = self.library.normalizer.normalize_str
        self._pieces = self.library.pre_tokenizer.pre_tokenize_str
        self._letters = byte_letters()
        self.words = Remembered(self.encode_word)
        self._build_offsets()
        self._build_tables()

    def _build_offsets(self) -> None:
        by_id = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        strings = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.blob = "".join(strings)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).tolist()

    def _build_tables(self) -> None:
        n = self.merges.size
        self.order = list(range(n))  # when a token comes to be: letters first, then by merge
        self.split: list[tuple[int, int] | None] = [None] * n
        for k, (a, b, c) in enumerate(self.merges.parts):
            self.order[c], self.split[c] = n + k, (a, b)
        self.length, self.shorter = [0] * n, [-1] * n
        self.automaton = ahocorasick.Automaton()
        proven = {}
        for s, i in self.vocab.items():
            key = self.letters(s)
            if self.merges.apply([self.vocab[x] for x in self.symbols(s)]) == [i]:
                proven[key] = i
                self.length[i] = len(key)
                self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        self.proven = proven
        for key, i in proven.items():
            self.shorter[i] = next((proven[key[:k]] for k in range(len(key) - 1, 0, -1) if key[:k] in proven), -1)
        self.pairs: dict[int, bool] = {}

    def symbols(self, word: str) -> list[str]:
        """The word's letters in the vocabulary; the last one carries the suffix if the word does."""
        if self.suffix and word.endswith(self.suffix) and word != self.suffix:
            body = word[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(word)

    def letters(self, word: str) -> str:
        """One character for each symbol; letters with the suffix have characters of their own."""
        parts = self.symbols(word)
        return "".join(p if len(p) == 1 else chr(0xE000 + ord(p[0])) for p in parts)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between tokens a and b alone."""
        key = a * self.merges.size + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        n, limit = self.merges.size, 1 << 62
        order, split, rank = self.order, self.split, self.merges.rank
        while True:
            k = rank.get(a * n + b)
            if k is not None and n + k < limit:
                return False
            # the later made of the two tokens is undone; on a tie both are the same token, and the right one was made later
            if split[a] is None and split[b] is None:
                return True
            if order[a] > order[b]:
                limit, a = order[a], split[a][1]
            else:
                limit, b = order[b] + 1, split[b][0]

    def longest(self, word: str) -> list[int]:
        """The longest proven token from each place of the word."""
        best = [-1] * len(word)
        for end, token in self.automaton.iter(word):
            start = end - self.length[token] + 1
            if best[start] < 0 or self.length[token] > self.length[best[start]]:
                best[start] = token
        return best

    def encode_word(self, piece: str) -> list[int]:
        """The ids of one pre-token, given in byte letters."""
        word = piece[:-1] + chr(0xE000 + ord(piece[-1])) if self.suffix else piece
        whole = self.proven.get(word)
        if whole is not None:
            return [whole]
        best, n = self.longest(word), len(word)
        usable = bytearray(b"\x01") * (n + 1)
        ids, at, token = [], 0, best[0]
        while at < n:
            end = at + self.length[token]
            if usable[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                token = best[at] if at < n else -1
                continue
            token = self.shorter[token]
            while token < 0:
                usable[at] = 0
                last = ids.pop()
                at -= self.length[last]
                token = self.shorter[last]
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        if chunk in self.special:
            return [self.special[chunk]]
        if PLAIN.match(chunk):
            pieces = [p if p.isascii() and p.isprintable() else "".join([self._letters[b] for b in p.encode()]) for p in _PRETOKENS.findall(chunk.lower())]
        else:
            pieces = [p for p, _ in self._pieces(self._normal(chunk))]
        memo = self.words
        return [i for p in pieces for i in memo[p]]

    def chunks(self, text: str) -> list[str]:
        """Parts that are encoded each on its own: what white space separates, and special strings."""
        if not any(s in text for s in self.special):
            return _words(text)
        return [c for k, part in enumerate(self._cut.split(text)) for c in ([part] if k % 2 else _words(part))]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, cut out of the table by their offsets and joined by spaces."""
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[i] : at[i + 1]] for i in ids])


def _words(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


@lru_cache(maxsize=2)
def word_bpe(source: str) -> WordBPE:
    return WordBPE(source)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` of every document. A null or empty text has no ids; repeated rows give a row each, an empty table none; other columns are not read."""
    source = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = word_bpe(source.value)
        return pa.record_batch([batch.column(0), pa.array([tok.encode(t) for t in texts(batch)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


_digesters: dict = {}


def digest_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document's encoding and its decoding.

    docs: has ``doc_id`` and ``text``; other columns are not read. A null or empty
    text has no tokens and the digests of the empty string. Repeated rows give a row
    each, an empty table none.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if source.value not in _digesters:
            tok = word_bpe(source.value)

            def both(chunk: str) -> tuple[int, str, str]:
                ids = tok.encode_chunk(chunk)
                return len(ids), " ".join(map(str, ids)), tok.decode(ids)

            _digesters[source.value] = (tok, Remembered(both))
        tok, memo = _digesters[source.value]
        out: list[list] = [[], [], []]
        for text in texts(batch):
            parts = [p for c in tok.chunks(text) if (p := memo[c])[0]]
            out[0].append(sum([p[0] for p in parts]))
            out[1].append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            out[2].append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
