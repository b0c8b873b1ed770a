"""Token ids of whole texts under a public byte-level BPE vocabulary.

Byte pairs that occur inside no vocabulary token mark certain cuts: no merge can ever span them. Each piece of the
pre-tokeniser's pattern is cut there, the fragments are encoded independently, each distinct one once per worker, and
the ids are concatenated.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.session import spread

#: Folder of the public vocabulary files; a parameter of every function that needs one.
TOKENIZERS = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value of the public tokeniser: its pre-tokenisation pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which each of a worker's two caches starts anew.
CACHE_ENTRIES = 1_000_000
#: Characters of a text that are split into pieces at once.
WINDOW_CHARS = 1_000_000


class Encoder(dict):
    """Maps a piece to its ids, filling itself on first use."""

    def __init__(self, vocabulary: str) -> None:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        inside = np.zeros(1 << 16, dtype=bool)
        for token in ranks:
            raw = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            inside[raw[:-1] << 8 | raw[1:]] = True
        self.inside = inside
        self.pieces = regex.compile(PATTERN).findall
        self.ranks = ranks
        # the whole of a fragment is one piece
        self.public = tiktoken.Encoding("public", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, raw: bytes) -> list[bytes]:
        """raw, cut between the bytes of every pair that no token holds and that doesn't lie within a character."""
        if len(raw) < 2:
            return [raw]
        codes = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
        at = np.flatnonzero(~self.inside[codes[:-1] << 8 | codes[1:]] & (codes[1:] & 0xC0 != 0x80)) + 1
        if not len(at):
            return [raw]
        edges = [0, *at.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def bpe(self, raw: bytes) -> list[int]:
        """Ids of one fragment; bytes that are no text, which no text gives, are merged here."""
        try:
            return self.public(raw.decode())
        except UnicodeDecodeError:
            parts = [raw[k : k + 1] for k in range(len(raw))]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], len(self.ranks)))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            return [self.ranks[p] for p in parts]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids: list[int] = []
        for part in self.cuts(piece.encode()):
            known = self.fragments.get(part)
            if known is None:
                known = tuple(self.bpe(part))
                if len(part) <= 64:
                    if len(self.fragments) >= CACHE_ENTRIES:
                        self.fragments.clear()
                    self.fragments[part] = known
            ids += known
        found = tuple(ids)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        if len(text) <= WINDOW_CHARS:
            return list(itertools.chain.from_iterable(map(self.__getitem__, self.pieces(text))))
        ids: list[int] = []
        for part in windows(text):
            ids.extend(itertools.chain.from_iterable(map(self.__getitem__, self.pieces(part))))
        return ids


def windows(text: str, chars: int = WINDOW_CHARS) -> Iterator[str]:
    """Consecutive parts, each ending before a space that follows a letter or digit: no piece ever crosses such a place."""
    start = 0
    while start < len(text):
        end = start + chars
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                end = len(text)
            elif text[end - 1].isascii() and text[end - 1].isalnum():
                break
            else:
                end += 1
        yield text[start:end]
        start = end


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encode_texts(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids (array<int>) of text, one row for every row of documents.

    Empty and null texts both give the empty array; blank ones are encoded as they are; strings that look like special
    tokens are ordinary text. Repeated rows give repeated rows, a null doc_id stays null, other columns are ignored.
    Texts of any length are encoded whole.
    """
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = [encode(t) if t else () for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")
