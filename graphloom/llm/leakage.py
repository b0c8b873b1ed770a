"""Evaluation texts leaking into training text.

All items, as sequences of normalised words, go into one generalised suffix automaton. The words of every document are
streamed through it; the longest match at each word tells passages that are copied outright, and the matches of a few
words, gathered by item, tell where a whole item may have been copied with changes. Such places are checked exactly
by the edit distance in words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import spread

#: Consecutive words of an item that make a leak.
RUN_WORDS = 24
#: Words in the short matches that show where a changed copy may lie.
SEED_WORDS = 4
#: A copy of the whole item may differ by one edit in so many words. One exchanged word of running text may hold several words (a_b_c), so this is less than eight.
WORDS_PER_EDIT = 6
#: Words of items in one automaton (about 500 bytes each); more items are searched in several passes.
AUTOMATON_WORDS = 400_000

# Tags of any length with their attributes, whatever has no blank between angle brackets, and the targets of links.
_TAG = re.compile(
    r"</?[A-Za-z](?:[\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>`]++))?+)*+\s*+/?>|[^<>\s]*+>)|(?<=\])\([^()\s]++\)"
)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
_CHUNK = re.compile(r"[^\s、。，！？]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits without markup, in one spelling: compatibility form, case folded."""
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    return _words(text)


def located(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words as in words(), and from where to where in the text each of them stands, with what adjoins it without a blank."""
    found: list[str] = []
    places: list[tuple[int, int]] = []
    for m in _CHUNK.finditer(_TAG.sub(lambda tag: " " * len(tag[0]), text)):
        own = _words(m[0])
        found += own
        places += [m.span()] * len(own)
    return found, places


def _words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.casefold())


class Automaton:
    """Generalised suffix automaton of word sequences, with the items that hold each state's matches."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)], dtype=np.int64) for _, t in items]
        self.steps: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.size: list[int] = [0]
        marks: list[set[int]] = [set()]
        for number, item in enumerate(self.items):
            last = 0
            for w in item.tolist():
                last = self._extend(last, w, marks)
            at = 0
            for w in item.tolist():  # every prefix's state, and through the links every shorter match, is held by the item
                at = self.steps[at][w]
                marks[at].add(number)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                marks[self.link[state]] |= marks[state]
        self.seed = self._above(SEED_WORDS)
        self.run = self._above(RUN_WORDS)
        wanted = sorted({*self.seed, *self.run} - {-1})
        row = {state: k for k, state in enumerate(wanted)}
        self.seed = array("i", [row.get(s, -1) for s in self.seed])
        self.run = array("i", [row.get(s, -1) for s in self.run])
        self.start = np.cumsum([0, *(len(marks[s]) for s in wanted)])
        self.held = np.fromiter((i for s in wanted for i in sorted(marks[s])), dtype=np.int32)
        self.length = np.array([len(i) for i in self.items], dtype=np.int64)

    def _extend(self, last: int, w: int, marks: list[set[int]]) -> int:
        steps, link, size = self.steps, self.link, self.size
        if w in steps[last]:
            q = steps[last][w]
            if size[q] == size[last] + 1:
                return q
            return self._split(last, q, w, marks)
        new = len(size)
        steps.append({})
        link.append(0)
        size.append(size[last] + 1)
        marks.append(set())
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = new
            p = link[p]
        if p >= 0:
            q = steps[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, q, w, marks)
        return new

    def _split(self, p: int, q: int, w: int, marks: list[set[int]]) -> int:
        steps, link, size = self.steps, self.link, self.size
        copy = len(size)
        steps.append(dict(steps[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        marks.append(set())
        while p >= 0 and steps[p].get(w) == q:
            steps[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _above(self, length: int) -> list[int]:
        """Of each state the one on its suffix chain whose matches include those of just this length; -1 for shorter states."""
        out = [-1] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            if self.size[state] >= length:
                up = self.link[state]
                out[state] = out[up] if up >= 0 and self.size[up] >= length else state
        return out

    def stream(self, tokens: Iterable[int]) -> tuple[array, array]:
        """Of each word the row of its seed match (-1: none), and the rows of the long matches."""
        steps, link, size, seed, run = self.steps, self.link, self.size, self.seed, self.run
        seeds, runs = array("i"), array("i")
        state = length = 0
        for w in tokens:
            step = steps[state].get(w)
            if step is None:
                while True:
                    state = link[state]
                    if state < 0:
                        state = length = 0
                        break
                    step = steps[state].get(w)
                    if step is not None:
                        length = size[state] + 1
                        state = step
                        break
            else:
                state = step
                length += 1
            if length >= SEED_WORDS:
                seeds.append(seed[state])
                if length >= RUN_WORDS:
                    runs.append(run[state])
            else:
                seeds.append(-1)
        return seeds, runs

    def leaks(self, text: str) -> np.ndarray:
        """Numbers of the items that leaked into the text."""
        known = self.vocabulary
        tokens = [known.get(w, -1) for w in words(text)]
        if len(tokens) < SEED_WORDS:
            return np.zeros(0, dtype=np.int64)
        seeds, runs = self.stream(tokens)
        found = [self.held[self.start[r] : self.start[r + 1]] for r in set(runs)]
        out = set(np.concatenate(found).tolist()) if found else set()
        rows = np.frombuffer(seeds, dtype=np.int32)
        at = np.flatnonzero(rows >= 0)
        if len(at):
            rows = rows[at]
            counts = self.start[rows + 1] - self.start[rows]
            ends = np.cumsum(counts)
            item = self.held[np.repeat(self.start[rows] - ends + counts, counts) + np.arange(ends[-1])]
            hits = np.bincount(item, minlength=len(self.length))
            # each edit breaks at most SEED_WORDS short matches
            needed = np.maximum(self.length - SEED_WORDS + 1 - SEED_WORDS * (self.length // WORDS_PER_EDIT), 1)
            whole = np.flatnonzero((hits >= needed) & (self.length >= SEED_WORDS))
            if len(whole):
                place = np.repeat(at, counts)
                words_ = np.array(tokens, dtype=np.int64)
                for i in whole.tolist():
                    if i not in out and self._copied(i, place[item == i], int(needed[i]), words_):
                        out.add(i)
        return np.array(sorted(out), dtype=np.int64)

    def without_leaks(self, text: str) -> tuple[str, int]:
        """The text without the spans that leaked, and how many words those had: matches of RUN_WORDS and more, and changed copies of whole items."""
        leaked = self.leaks(text)
        if not len(leaked):
            return text, 0
        found, places = located(text)
        tokens = [self.vocabulary.get(w, -1) for w in found]
        gone = np.zeros(len(tokens) + 1, dtype=np.int64)
        words_ = np.array(tokens, dtype=np.int64)
        state = length = 0
        for at, w in enumerate(tokens):
            while state and w not in self.steps[state]:
                state = self.link[state]
                length = self.size[state]
            state = self.steps[state].get(w, 0)
            length = length + 1 if state else 0
            if length >= RUN_WORDS:
                gone[at - length + 1] += 1
                gone[at + 1] -= 1
        for i in leaked.tolist():
            for lo, hi in copies_of(self.items[i], words_):
                gone[lo] += 1
                gone[hi] -= 1
        marked = np.flatnonzero(np.cumsum(gone)[:-1] > 0)
        kept, at = [], 0
        for run in np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1):
            lo, hi = places[run[0]][0], places[run[-1]][1]
            kept.append(text[at:lo])
            at = max(at, hi)
        kept.append(text[at:])
        return "".join(kept), len(marked)

    def _copied(self, number: int, place: np.ndarray, needed: int, tokens: np.ndarray) -> bool:
        item = self.items[number]
        edits = len(item) // WORDS_PER_EDIT
        reach = len(item) + edits
        place = np.unique(place)
        first = np.searchsorted(place, place - reach)  # hits no further back than a copy is long
        dense = np.flatnonzero(np.arange(len(place)) - first + 1 >= needed)
        at = 0
        while at < len(dense):  # neighbouring windows are checked together
            to = at
            while to + 1 < len(dense) and place[first[dense[to + 1]]] <= place[dense[to]]:
                to += 1
            lo, hi = max(0, int(place[first[dense[at]]]) - SEED_WORDS - reach), int(place[dense[to]]) + 1 + reach
            if distance(item, tokens[lo:hi]) <= edits:
                return True
            at = to + 1
        return False


def copies_of(item: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int]]:
    """From where to where the tokens hold a changed copy of the item, at each end the one with the fewest edits."""
    edits = len(item) // WORDS_PER_EDIT
    if len(item) < SEED_WORDS:
        return []
    row = np.zeros(len(tokens) + 1, dtype=np.int64)
    start = np.arange(len(tokens) + 1)
    for w in item:
        changed, dropped = row[:-1] + (tokens != w), row + 1
        nxt, begin = dropped.copy(), start.copy()
        better = changed <= nxt[1:]
        nxt[1:][better], begin[1:][better] = changed[better], start[:-1][better]
        # words added: the best one before, one edit a word
        level = nxt - np.arange(len(nxt))
        best = np.maximum.accumulate(np.where(level == np.minimum.accumulate(level), np.arange(len(level)), 0))
        row, start = level[best] + np.arange(len(nxt)), begin[best]
    out = []
    for end in np.flatnonzero(row <= edits).tolist():
        if not out or row[end] < row[out[-1][1]] or start[end] >= out[-1][1]:
            if out and start[end] < out[-1][1]:
                out.pop()
            out.append((int(start[end]), end))
    return out


def distance(item: np.ndarray, tokens: np.ndarray) -> int:
    """Least number of words to exchange, drop or add that make the item a part of the tokens."""
    along = np.arange(len(tokens) + 1)
    row = np.zeros(len(tokens) + 1, dtype=np.int64)
    for w in item:
        nxt = row + 1
        np.minimum(nxt[1:], row[:-1] + (tokens != w), out=nxt[1:])
        row = np.minimum.accumulate(nxt - along) + along
    return int(row.min())


def _search(documents: DataFrame, automaton: Automaton) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = scan.leaks(text)
                docs += [doc] * len(got)
                found += scan.ids[got].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return documents.mapInArrow(run, "doc_id long, item_id long")


def automata(items: DataFrame, automaton_words: int) -> list[Automaton]:
    """The items (item_id, text) in as many automata as their words, counted beforehand, need."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(words(t)) for t in batch.column(0).to_pylist())], pa.int64())], names=["n"])

    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = items.select("text").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // automaton_words))
    mine = lambda k: items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).sort("item_id").collect()
    return [Automaton([(r.item_id, r.text) for r in mine(k)]) for k in range(passes)]


def find_leaks(documents: DataFrame, items: DataFrame, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, item_id of every document that holds RUN_WORDS consecutive words of an item, or a slightly changed copy of the whole item.

    Whole texts are streamed. Null and empty texts, and items without a word, match nothing; shorter items only match
    as a whole. Items with a null id or text take no part, repeated rows of a document give repeated rows, empty tables
    give none. The automaton is sent to all workers, so its words are counted first: above automaton_words the items
    are spread over several automata and the documents searched once with each.
    """
    texts = spread(documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text"))
    return reduce(DataFrame.unionByName, [_search(texts, a) for a in automata(items, automaton_words)])


def remove_leaks(documents: DataFrame, items: DataFrame, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, text without the spans of items that find_leaks() finds in it, and removed, the number of words taken out; one row for every row of documents.

    A span is cut at blanks, so punctuation and markup that adjoin its words go with them. Null and empty texts, and those
    without a leak, stay as they are. Of items spread over several automata one after the other is removed.
    """
    out = spread(documents.select("doc_id", "text", F.lit(0).cast("long").alias("removed")))
    for automaton in automata(items, automaton_words):
        shared = documents.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [shared.value.without_leaks(t) if t else (t, 0) for t in batch.column(1).to_pylist()]
                before = batch.column(2).to_pylist()
                columns = [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n + m for n, (_, m) in zip(before, done)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "removed"])

        out = out.mapInArrow(run, "doc_id long, text string, removed long")
    return out
