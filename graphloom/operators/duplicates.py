"""Duplicate and near-duplicate source texts, exactly and without all pairs of a group."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.traverse import components
from graphloom.session import cut_lineage

#: Words that keep their spelling when code is normalised. Fixed values.
KEYWORDS = "if else for while return match switch case break continue class struct enum trait impl fn func def function const let var static public private import from use package try catch except with as in not and or new this self null nil none true false"

#: Items are counted in 2 to this many cells; parts in which the cells of all tasks are summed.
CELL_BITS, CELL_PARTS = 22, 16
#: Items that the heads of two sets must share before the whole sets are compared.
SHARED_HEADS = 8
#: Texts whose tokens a worker takes apart at once.
BATCH_TEXTS = 1000
#: Keys of sets to be compared up to which they are sent to all tasks.
SENT_KEYS = 200_000

Batches = Iterator[pa.RecordBatch]


def code_tokens(text: Column) -> Column:
    """Tokens of code: words, numbers and single marks."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*|\d+|[^\s\w])"), F.lit(1))


def normalised(tokens: Column) -> Column:
    """Tokens with names as <id> and numbers as <num>; keywords and marks stay."""
    keep = F.array(*(F.lit(k) for k in KEYWORDS.split()))
    return F.transform(tokens, lambda t: F.when(t.rlike(r"^\d"), "<num>").when(t.rlike("^[A-Za-z_]") & ~F.array_contains(keep, F.lower(t)), "<id>").otherwise(t))


def exact_groups(texts: DataFrame, key: str, text: str, least_tokens: int = 6) -> DataFrame:
    """Texts that are equal once normalised: key and the hash of their group; groups of one are left out."""
    sig = texts.select(key, normalised(code_tokens(F.col(text))).alias("t")).filter(F.size("t") >= least_tokens).select(key, F.sha2(F.array_join("t", " "), 256).alias("signature"))
    groups = sig.groupBy("signature").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return sig.join(groups, "signature").select(key, "signature", "members")


def _cells(items: np.ndarray) -> np.ndarray:
    return (items.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELL_BITS)


def _each(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The items of each row; a null row has none."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return (flat[lo:hi] for lo, hi in zip([0, *ends.tolist()], ends.tolist()))


def _counted(kept: list[str]) -> Callable[[Batches], Batches]:
    """From batches with a column items the other columns, with part and cells null; at the end of a task its counts of items by cell, in parts."""

    def run(batches: Batches) -> Batches:
        cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        kinds = None
        for batch in batches:
            np.add.at(cells, _cells(batch.column("items").flatten().to_numpy(zero_copy_only=False)).astype(np.int64), np.uint32(1))
            kinds = [batch.schema.field(c).type for c in kept]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=[*kept, "part", "cells"])
        if kinds is not None:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(cells, CELL_PARTS)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(CELL_PARTS, k) for k in kinds), pa.array(range(CELL_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=[*kept, "part", "cells"])

    return run


def _cell_ranks(counted: DataFrame) -> np.ndarray:
    """Of every cell a byte that grows with its count: 0 for up to one item, eight steps for each doubling."""

    def add(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(raw), dtype=np.uint32)
                sums[part] = sums[part] + own if part in sums else own.astype(np.uint64)
        ranks = [np.minimum(np.log2(np.maximum(x, 1)) * 8, 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["part", "ranks"])

    out = np.zeros((CELL_PARTS, (1 << CELL_BITS) // CELL_PARTS), dtype=np.uint8)
    for row in counted.filter("part is not null").select("part", "cells").repartition("part").mapInArrow(add, "part int, ranks binary").collect():
        out[row["part"]] = np.frombuffer(row["ranks"], dtype=np.uint8)
    return out.reshape(-1)


def _heads(ranks, key: str, least: float) -> Callable[[Batches], Batches]:
    """From batches with key and items the number of items of each set and those of its rarest that a similar set may share."""

    def run(batches: Batches) -> Batches:
        by_cell = ranks.value
        for batch in batches:
            sizes, heads = [], []
            for items in _each(batch.column("items")):
                rank = by_cell[_cells(items)]
                first = np.lexsort((items, rank))[: len(items) - int(np.ceil(len(items) * least - 1e-9)) + SHARED_HEADS]
                heads.append(items[first][rank[first] > 0])  # what is alone in its cell is in no other set
                sizes.append(len(items))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64()))], names=["id", "n", "head"])

    return run


def _candidates(heads: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ids whose heads (id, n, head) share as many items as those of similar sets must. Sets that come more than once under an id count once."""
    # sizes that are planned from the files fall short of these rows, so the join must not be planned as a broadcast
    rows = heads.select("id", "n", F.explode("head").alias("item")).repartition("item").groupBy("item", "id").agg(F.first("n").alias("n"))
    a, b = (rows.select("item", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)
    overlap = F.ceil((F.first("na") + F.first("nb")) * (least / (1 + least)) - 1e-9)
    shared = a.hint("merge").join(b.hint("merge"), "item").filter(fits).groupBy("a", "b").agg((F.count(F.lit(1)) >= F.least(F.lit(SHARED_HEADS), overlap)).alias("enough"))
    return shared.filter("enough").select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame, key: str, least: float) -> DataFrame:
    left, right = sets.select(F.col(key).alias("a"), F.col("items").alias("ia")), sets.select(F.col(key).alias("b"), F.col("items").alias("ib"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    similarity = shared / (F.size("ia") + F.size("ib") - shared)
    return both.select("a", "b", F.round(similarity, 6).alias("similarity")).filter(F.col("similarity") >= least)


def _of_keys(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a pair."""
    keys = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys.hint("merge"), key, "left_semi")


def _least(least: float) -> float:
    """What a similarity may be before it is rounded to six places."""
    return least - 5e-7


def near_pairs(sets: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Pairs (a, b) of the sets (key, items: array<long>) with a Jaccard similarity of at least `least`, exactly.

    With any order of all items, two such sets share at least h among the first n - ceil(least n) + h of each. Items are
    put in order of their number of sets, rarest first, counted in cells of which several items may share one: that makes
    the order coarser, but loses no pair. Only these heads are joined, and whole sets compared where they share enough.
    The sets are made again for each of three readings rather than stored. No item or set is capped.
    """
    kind = sets.schema[key].dataType
    sets = sets.select(key, "items")
    ranks = sets.sparkSession.sparkContext.broadcast(_cell_ranks(sets.mapInArrow(_counted([]), "part int, cells binary")))
    heads = sets.mapInArrow(_heads(ranks, key, _least(least)), T.StructType().add("id", kind).add("n", "integer").add("head", T.ArrayType(T.LongType())))
    pairs = cut_lineage(_candidates(heads, _least(least)))
    return _compared(pairs, _of_keys(sets, pairs, key), key, least)


def _token_code(token: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((token or "").encode(), digest_size=8).digest())


def _shingled(key: str, words: int) -> Callable[[Batches], Batches]:
    """From batches of key and tokens the key, a hash of the whole set, and items: the distinct codes of runs of `words` tokens, of all tokens if there are fewer, none if there are none."""

    def runs(codes: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(codes) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + codes[k : k + len(out)]
            out ^= out >> np.uint64(32)
        return out * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Batches) -> Batches:
        for batch in (b.slice(at, BATCH_TEXTS) for b in batches for at in range(0, b.num_rows, BATCH_TEXTS)):
            lists = batch.column(1)
            told = lists.flatten().dictionary_encode(null_encoding="encode")
            known = np.array([_token_code(x) for x in told.dictionary.to_pylist()], dtype=np.uint64)
            codes = known[told.indices.to_numpy(zero_copy_only=False)]
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
            whole = runs(codes, words) if len(codes) >= words else codes[:0]
            items = []
            for lo, hi in zip([0, *ends], ends):
                own = whole[lo : hi - words + 1] if hi - lo >= words else runs(codes[lo:hi], hi - lo) if hi > lo else codes[:0]
                items.append(np.unique(own).view(np.int64))
            content = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), signed=True) for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=[key, "content", "items"])

    return run


def near_classes(texts: DataFrame, key: str, tokens: Column, words: int = 5, least: float = 0.8) -> DataFrame:
    """Each text with its class (least key of the texts that near-duplicates link to it) and the number of its links.

    Equal texts are one before pairs are sought, and get the class of their representative. Texts without tokens are one,
    too, and linked to none. Pairs are those of near_pairs; texts are tokenised for each reading, and their shingles are
    not stored.
    """
    shingled = _shingled(key, words)
    kind = texts.schema[key].dataType
    made = lambda rows, then, schema: rows.select(key, tokens.alias("t")).mapInArrow(lambda batches: then(shingled(batches)), schema)
    marks = T.StructType().add(key, kind).add("content", "long").add("part", "integer").add("cells", "binary")
    counted = cut_lineage(made(texts, _counted([key, "content"]), marks))
    ranks = texts.sparkSession.sparkContext.broadcast(_cell_ranks(counted))
    marked = counted.filter("part is null").select(key, "content")
    firsts = marked.groupBy("content").agg(F.min(key).alias("rep"))
    rep = marked.hint("merge").join(firsts.hint("merge"), "content").select(key, "rep")

    # pairs of contents, then of their representatives
    found = _candidates(made(texts, _heads(ranks, "content", _least(least)), "id long, n int, head array<long>"), _least(least))
    for side in "ab":
        found = found.join(firsts.select(F.col("content").alias(side), F.col("rep").alias(f"rep_{side}")).hint("merge"), side)
    found = cut_lineage(found.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))
    sets = made(_of_keys(texts, found, key), lambda batches: batches, T.StructType().add(key, kind).add("content", "long").add("items", T.ArrayType(T.LongType())))
    pairs = cut_lineage(_compared(found, sets, key, least))
    classes = components(pairs.select(F.col("a").alias("source"), F.col("b").alias("target"))).withColumnRenamed("qn", "rep")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return rep.join(classes.hint("merge"), "rep", "left").join(links.hint("merge"), "rep", "left").select(key, F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
