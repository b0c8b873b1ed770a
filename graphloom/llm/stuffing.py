"""Keyword-stuffed and link-list pages.

Words and neighbouring pairs of words are counted over the running text of the whole corpus. The order of running text
carries information: a pair has more pointwise mutual information than its words in reverse. A window of a page is
stuffed if the mean information of its neighbouring words, or the mean of that gain, is less than the corpus usually has,
times the share of the window's words in pairs that the page repeats, or of words that it repeats if these are nearly all
of the window: without any order (word salad) little repetition suffices, and no pair has to occur twice. It is
stuffed, too, if nearly all of it is repeated collocations, pairs of high information. Where most of a window is in
punctuated sentences, only a third of both means is asked for, so that a repeated sentence is not taken for keywords, but
salad with full stops is. Tags, and links without a description, are stuffed too. Code, tables and log lines never are.
No list of words of any language is used.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, spread

#: Share of a page's characters that must be stuffed.
MIN_SHARE = 0.5
#: Times a page has to hold a pair of neighbouring words, in either order, and the least information (nats) that makes the pair a collocation.
REPEATS = 3
MIN_PMI = 1.0
#: Neighbouring words that are judged together.
WINDOW_WORDS = 20
#: Share of a window in repeated collocations that is excessive, however usual their order.
EXCESS = 0.8
#: Share of a window in words that the page holds REPEATS times, from which it may be salad though none of its pairs is repeated.
SALAD = 0.8
#: Words, and share of distinct ones, that a segment with a full stop has at least to be a sentence; the part of the usual gain that is asked for there.
SENTENCE_WORDS, SENTENCE_DISTINCT, SENTENCE_GAIN = 8, 0.6, 1 / 3
#: Words whose hashes a worker remembers.
CACHED_WORDS = 2_000_000
#: Parts into which the pages that hold one word or pair are split for its lookup.
SALTS = 8
#: Words of prose that describe one link; fewer are its label.
WORDS_PER_LINK = 5
#: Share of a segment's words that must be stuffed for the whole segment to count.
SEGMENT_SHARE = 0.6

_WORD = re.compile(r"[^\W_]+")
# No part can run over the start of another, so that a line is read in proportion to its length.
_LINK = re.compile(r"<a\b[^<>]*+>(.*?)(?:</a>|$)|!?\[([^\[\]\n]*+)\]\([^()\s]*+\)|<?https?://[^\s<>|]+>?|\bwww\.[^\s<>|]+", re.I | re.S)
_TAGGED = re.compile(r"(?<![\w&#])#[^\W\d_][\w-]*")
_FENCE = re.compile(r"^[ \t]*(```|~~~)")
_TABLE = re.compile(r"^[ \t]*\|.*\|[ \t]*$")
_LOG = re.compile(r"^[ \t]*(?:[$>%] \S|\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d:\d\d|\d{9,13} (?:[A-Z]{3,8})\b|(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b[ :\]])")
_BREAK = re.compile(r"<br\s*/?>|</?(?:p|li|ul|ol|div|tr|td|span|h[1-6]|center|font|b|i)\b[^<>]*>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_STOPS = (".", "!", "?", "。", "…")


def plain(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


class _Hashes(dict):
    """Word to 64-bit hash, each word hashed once per worker."""

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        value = ((zlib.adler32(raw, len(raw)) << 32) ^ zlib.crc32(raw)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        value ^= value >> 29
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value


_HASHES = _Hashes()


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def unordered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of each pair of words, alike in both orders."""
    mixed = np.minimum(first, second) * np.uint64(0xD6E8FEB86659FD93) + np.maximum(first, second)
    return mixed ^ (mixed >> np.uint64(32))


@dataclass
class Line:
    """What one line adds to a page: characters, of which in links and tags, how many links, and its segments (characters, words)."""

    size: int
    linked: int
    tagged: int
    links: int
    segments: list[tuple[int, int]]


@dataclass
class Page:
    """Running text of a page: lines that may be stuffed, and their words in sequences that only code, tables and logs interrupt."""

    total: int = 0
    lines: list[Line] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    starts: list[int] = field(default_factory=list)  # of the sequences
    labels: list[list[str]] = field(default_factory=list)  # words of links, counted but not judged
    sentences: list[tuple[int, int]] = field(default_factory=list)  # words from and to

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, first and second word of the pairs of neighbours."""
        at = np.arange(max(0, len(self.codes) - 1))
        if len(self.starts) > 1:
            at = np.delete(at, np.array([k - 1 for k in self.starts if 0 < k < len(self.codes)], dtype=np.int64))
        return at, self.codes[at], self.codes[at + 1]


def _letters(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.casefold()) if not w.isdigit()]


def read_page(text: str) -> Page:
    page = Page()
    words: list[str] = []
    fenced = False
    for line in plain(text).splitlines():
        size = len(line.strip())
        page.total += size
        if ("```" in line or "~~~" in line) and _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not size or "|" in line and _TABLE.match(line) or _LOG.match(line):
            if size and (not page.starts or page.starts[-1] != len(words)):
                page.starts.append(len(words))
            continue
        rest = line
        linked = links = tagged = 0
        if "://" in line or "](" in line or "<a" in line or "<A" in line or "www." in line:
            for m in _LINK.finditer(line):
                linked += len(m[0])
                links += 1
                label = m[1] or m[2]
                if label:
                    page.labels.append(_letters(label))
            rest = _LINK.sub(" ", line)
        if "#" in rest:
            tagged = sum(len(m[0]) + 1 for m in _TAGGED.finditer(rest))
            rest = _TAGGED.sub(" ", rest)
        if "<" in rest:
            rest = _BREAK.sub(" ", rest)
        left = max(0, size - linked - tagged)
        parts = [p for p in _SENTENCE.split(rest) if p.strip()]
        weight = sum(map(len, parts)) or 1
        segments = []
        for part in parts:
            own = _letters(part)
            if len(own) >= SENTENCE_WORDS and part.rstrip(" \t*_)\"").endswith(_STOPS) and len(set(own)) >= SENTENCE_DISTINCT * len(own):
                page.sentences.append((len(words), len(words) + len(own)))
            words += own
            segments.append((left * len(part) // weight, len(own)))
        page.lines.append(Line(size, linked, tagged, links, segments))
    page.codes = hashes(words)
    return page


@dataclass
class Known:
    """Counts of words, and of pairs in ascending and descending order of their hashes, by code; totals, and usual gain and mutual information of the corpus."""

    code: np.ndarray
    up: np.ndarray
    down: np.ndarray
    words: int
    pairs: int
    usual: float
    mutual: float

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.code):
            return np.zeros(len(codes)), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        hit = self.code[at] == codes
        return np.where(hit, self.up[at], 0), np.where(hit, self.down[at], 0)

    def information(self, first: np.ndarray, second: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair its mutual information (the greater one of both orders, and the one of its own), and the gain of its order over the reverse."""
        up, down = self.of(pair)
        chance = np.log(np.maximum(self.of(first)[0], 1) / self.words) + np.log(np.maximum(self.of(second)[0], 1) / self.words)
        told, own = (np.log(np.maximum(k, 0.5) / self.pairs) - chance for k in (np.maximum(up, down), np.where(first <= second, up, down)))
        gain = np.log((up + 0.5) / (down + 0.5)) * np.sign(second.astype(np.float64) - first.astype(np.float64))
        return told, own, gain


def _windows(page: Page) -> Iterator[tuple[np.ndarray, int]]:
    """Starts and width of the windows of each sequence."""
    n = len(page.codes)
    bounds = [0, *(k for k in page.starts if 0 < k < n), n]
    for lo, hi in zip(bounds, bounds[1:]):
        width = min(WINDOW_WORDS, hi - lo)
        yield np.arange(lo, hi - width + 1), width


def _cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words are in windows that begin at starts."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:n]) > 0


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(flags)])


def _salad(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Words that the page repeats, and which of them are in whole windows of little else."""
    n = len(page.codes)
    recurring = np.zeros(n, dtype=bool)
    if n < WINDOW_WORDS:
        return recurring, recurring
    _, inverse, times = np.unique(page.codes, return_inverse=True, return_counts=True)
    recurring = times[inverse] >= REPEATS
    dense = np.zeros(n, dtype=bool)
    if np.count_nonzero(recurring) >= SALAD * WINDOW_WORDS:
        total = _sums(recurring)
        for start, width in _windows(page):
            if width == WINDOW_WORDS:
                dense |= _cover(start[total[start + width] - total[start] >= SALAD * width], width, n)
    return recurring, dense & recurring


def _marked(page: Page, known: Known | None) -> np.ndarray:
    """Which words of the page are stuffed; without counts every repeated pair is, and every word of what may be salad: no more can be."""
    n = len(page.codes)
    out = np.zeros(n, dtype=bool)
    at, first, second = page.neighbours()
    if not len(at):
        return out
    pair = unordered(first, second)
    _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
    often = times[inverse] >= REPEATS
    recurring, dense = _salad(page)
    repeated = dense.copy()
    repeated[at[often]] = True
    repeated[at[often] + 1] = True
    if known is None or not repeated.any():
        return repeated
    told, own, gain = known.information(first, second, pair)
    paired, phrases = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for flags, which in ((paired, often), (phrases, often & (told >= MIN_PMI))):
        flags[at[which]] = True
        flags[at[which] + 1] = True
    gains, infos, steps = np.zeros(n), np.zeros(n), np.zeros(n)
    gains[at], infos[at], steps[at] = gain, own, 1
    within = np.zeros(n)
    for lo, hi in page.sentences:
        within[lo:hi] = 1
    # sums up to each word; a step between two sequences counts for neither
    sum_gain, sum_info, sum_step, sum_pair, sum_phrase, sum_within, sum_recurring = map(_sums, (gains, infos, steps, paired, phrases, within, recurring))
    for start, width in _windows(page):
        share = (sum_pair[start + width] - sum_pair[start]) / width
        words = (sum_recurring[start + width] - sum_recurring[start]) / width
        share = np.where((words >= SALAD) & (width == WINDOW_WORDS), np.maximum(share, words), share)
        taken = np.maximum(sum_step[start + width - 1] - sum_step[start], 1)
        gained, informed = ((total[start + width - 1] - total[start]) / taken for total in (sum_gain, sum_info))
        in_sentences = sum_within[start + width] - sum_within[start] > 0.5 * width
        asked = share * np.where(in_sentences, SENTENCE_GAIN, 1.0)
        incoherent = (gained < known.usual * asked) | (informed < known.mutual * asked)
        excessive = ~in_sentences & (sum_phrase[start + width] - sum_phrase[start] >= EXCESS * width)
        out |= _cover(start[incoherent | excessive], width, n)
    return out & repeated


def stuffed_share(page: Page, known: Known | None = None) -> float:
    """Share of the page's characters that are stuffed. Without counts an upper bound."""
    if not page.total:
        return 0.0
    marks = np.concatenate([[0], np.cumsum(_marked(page, known))]).tolist()
    stuffed = 0
    at = 0
    for line in page.lines:
        inner = unmarked = words = 0
        for size, n in line.segments:
            hit = marks[at + n] - marks[at]
            at += n
            inner += size if n and hit >= SEGMENT_SHARE * n else int(size * hit / n) if n else 0
            unmarked += n - hit
            words += n
        if unmarked < WORDS_PER_LINK * line.links:
            # links without a description; one link with a label, and nothing else, is stuffed as a whole
            stuffed += line.size if line.links == 1 or not words else line.linked + line.tagged + inner
        else:
            stuffed += line.tagged + inner
    return min(1.0, stuffed / page.total)


_READ = "code long, up long, down long, doc_id long, text string, codes array<long>"


def read_corpus(texts: DataFrame, min_share: float) -> DataFrame:
    """One reading of all texts (doc_id, text). Rows with a code are counts of a batch: of words (down null), and of pairs in both
    orders. The others are documents that may be stuffed, with the codes of their words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, firsts, seconds, keep, own = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                page = read_page(text)
                _, first, second = page.neighbours()
                words.append(page.codes)
                firsts.append(first)
                seconds.append(second)
                for label in page.labels:
                    codes = hashes(label)
                    words.append(codes)
                    firsts.append(codes[:-1])
                    seconds.append(codes[1:])
                if stuffed_share(page) > min_share:
                    keep.append(i)
                    own.append(np.unique(np.concatenate([page.codes, unordered(first, second)])).view(np.int64))
            none = np.zeros(0, dtype=np.uint64)
            code, n = np.unique(np.concatenate(words or [none]), return_counts=True)
            first, second = np.concatenate(firsts or [none]), np.concatenate(seconds or [none])
            pair, inverse = np.unique(unordered(first, second), return_inverse=True)
            up = np.bincount(inverse, weights=first <= second, minlength=len(pair)).astype(np.int64)
            down = np.bincount(inverse, weights=first >= second, minlength=len(pair)).astype(np.int64)
            took = batch.take(pa.array(keep, pa.int64()))
            counted, kept = len(code) + len(pair), len(keep)
            gone = lambda size, kind=pa.int64(): pa.nulls(size, kind)
            columns = [
                pa.concat_arrays([pa.array(np.concatenate([code, pair]).view(np.int64)), gone(kept)]),
                pa.concat_arrays([pa.array(np.concatenate([n.astype(np.int64), up])), gone(kept)]),
                pa.concat_arrays([gone(len(code)), pa.array(down), gone(kept)]),
                pa.concat_arrays([gone(counted), took.column(0)]),
                pa.concat_arrays([gone(counted, pa.string()), took.column(1)]),
                pa.concat_arrays([gone(counted, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "up", "down", "doc_id", "text", "codes"])

    return texts.select("doc_id", "text").mapInArrow(run, _READ)


def corpus_counts(read: DataFrame) -> DataFrame:
    """Counts over all texts: code, up and down. Words have no down; a pair of equal words has the same number in both."""
    return read.filter(F.col("code").isNotNull()).groupBy("code").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def corpus_totals(counts: DataFrame) -> DataFrame:
    """One row: words and pairs of the corpus, the usual gain of a pair's order over the reverse (usual), and the mutual information of neighbours (mutual)."""
    pair = F.col("down").isNotNull()
    gain = (F.col("up") - F.col("down")) * F.log((F.col("up") + 0.5) / (F.col("down") + 0.5))
    xlogx = lambda n: F.when(n > 0, n * F.log(n)).otherwise(0.0)
    sums = counts.agg(
        F.coalesce(F.sum(F.when(~pair, F.col("up"))), F.lit(1)).alias("words"),
        F.coalesce(F.sum(F.when(pair, F.col("up") + F.col("down"))), F.lit(1)).alias("pairs"),
        F.coalesce(F.sum(F.when(pair, gain)) / F.sum(F.when(pair, F.col("up") + F.col("down"))), F.lit(0.0)).alias("usual"),
        F.coalesce(F.sum(F.when(pair, xlogx(F.col("up")) + xlogx(F.col("down")))), F.lit(0.0)).alias("pair_sum"),
        F.coalesce(F.sum(F.when(~pair, xlogx(F.col("up")))), F.lit(0.0)).alias("word_sum"),
    )
    # twice the entropy of words less that of pairs
    mutual = F.col("pair_sum") / F.col("pairs") - F.log("pairs") - 2 * (F.col("word_sum") / F.col("words") - F.log("words"))
    return sums.select("words", "pairs", "usual", mutual.alias("mutual"))


def find_stuffed(documents: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id and share of every document more than min_share of whose characters are stuffed keywords, tags or links.

    Words and pairs are counted over the running text and the link labels of all documents, that is all but code, tables,
    log lines and addresses. Documents whose share is too small even if every repeated pair, and every window of repeated
    words, is stuffed are left out before counts are looked up; that loses none. Null, empty and blank texts are no cases, rows with a null doc_id take no part,
    a doc_id is given once, with its greatest share. Texts of any length are read whole. An empty table gives no rows.
    """
    texts = spread(documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))

    read = cut_lineage(read_corpus(texts, min_share))
    counts = cut_lineage(corpus_counts(read))
    suspects = read.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", "codes", F.xxhash64("text").alias("version"))
    # only what suspects hold is looked up, each code once; a code that most of them hold is then split by salt
    asked = suspects.select(F.explode("codes").alias("code")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = counts.join(asked, "code").select("code", "up", F.coalesce("down", F.lit(0)).alias("down"), salts)
    looked_up = (
        suspects.select("doc_id", "version", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"), F.explode("codes").alias("code"))
        .distinct()
        .join(known, ["code", "salt"])
        .groupBy("doc_id", "version")
        .agg(F.collect_list(F.struct("code", "up", "down")).alias("known"))
        .select("doc_id", "version", F.col("known.code").alias("code"), F.col("known.up").alias("up"), F.col("known.down").alias("down"))
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                code, up, down = (np.asarray(batch.column(k)[i].values) if batch.column(k)[i].is_valid else np.zeros(0, dtype=np.int64) for k in (2, 3, 4))
                order = np.argsort(code.view(np.uint64))
                totals = (batch.column(k)[i].as_py() for k in (5, 6, 7, 8))
                shares.append(stuffed_share(read_page(text), Known(code.view(np.uint64)[order], up[order], down[order], *totals)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["doc_id", "share"])

    judged = (
        suspects.select("doc_id", "text", "version")
        .join(looked_up, ["doc_id", "version"], "left")
        .crossJoin(F.broadcast(corpus_totals(counts)))
        .select("doc_id", "text", "code", "up", "down", "words", "pairs", "usual", "mutual")
        .mapInArrow(judge, "doc_id long, share double")
    )
    return judged.filter(F.col("share") > min_share).groupBy("doc_id").agg(F.max("share").alias("share"))
