"""Items that appear together, counted by heavy-light decomposition.

Frequent items of a repository become rows of a bit matrix over its records; their pairs are counted by popcounts of
row intersections. Pairs of rare items are counted by hashing the pairs of each record. For mixed pairs the record list
of the rare item probes the bit matrix. A repository that fits into one block of records is counted in one task, with
one shuffle of its records. Larger ones are split into blocks of records after their items were counted, and the
partial counts of the blocks are summed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records in one block of a repository.
BLOCK_RECORDS = 262_144
#: An item is heavy if at least one record in so many holds it.
HEAVY_SHARE = 64
#: Pairs of rare items held before they are merged.
PAIR_BUFFER = 4_000_000
#: Words of the bit matrix that are read at once.
MATRIX_WORDS = 2_000_000
#: Large repositories whose ids may be sent to all workers; their number is checked first.
BROADCAST_REPOS = 1_000_000
#: Stands for the record itself among its items; a blank name is never an item.
_SELF = ""

COUNTS = "repo_id long, symbol_a string, symbol_b string, n_ab long, n_a long, n_b long, n_records long"


def records(sources: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """repo_id, r1, r2 (128 bits of the record's key), symbols of all sources, each given as table, record key columns and name of the symbol array.

    Symbols are trimmed of spaces and tabs; null and blank ones are dropped. A record may come in several rows and may
    have no symbol. Rows with a null repository take no part; null keys are equal to each other.
    """
    parts = []
    for tag, (df, keys, symbols) in enumerate(sources):
        key: list[Column] = [F.lit(tag)]
        for k in keys:
            key += [F.col(k).isNull(), F.col(k)]
        names = F.transform(F.coalesce(F.col(symbols), F.array().cast("array<string>")), lambda s: F.btrim(s, F.lit(" \t")))
        parts.append(
            df.filter(F.col("repo_id").isNotNull()).select(
                "repo_id",
                F.xxhash64(*key).alias("r1"),
                F.xxhash64(F.lit(17), *key).alias("r2"),
                F.array_distinct(F.filter(names, lambda s: s.isNotNull() & (s != _SELF))).alias("symbols"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _merge(buffer: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    codes = np.concatenate([c for c, _ in buffer])
    counts = np.concatenate([n for _, n in buffer])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return [(codes[first], np.add.reduceat(counts, first))]


def bit_rows(item: np.ndarray, rec: np.ndarray, dense: np.ndarray, n_item: int, n_rec: int) -> np.ndarray:
    """The records of each of the dense items as one bit each, packed into words of 64."""
    width = -(-n_rec // 64)
    row_of = np.full(n_item, -1)
    row_of[dense] = np.arange(len(dense))
    words = np.zeros(len(dense) * width, dtype=np.uint64)
    np.bitwise_or.at(words, row_of[item] * width + (rec >> 6), np.uint64(1) << (rec & 63).astype(np.uint64))
    return words.reshape(len(dense), width)


def count_block(rec: np.ndarray, item: np.ndarray, heavy: np.ndarray, pair_buffer: int = PAIR_BUFFER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of items (lower, higher code, count) in one block. rec, item: codes of distinct incidences; heavy: flag by item."""
    none = np.zeros(0, dtype=np.int64)
    if not len(rec):
        return none, none, none
    n_rec, n_item = int(rec.max()) + 1, len(heavy)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    dense = np.flatnonzero(heavy)
    is_heavy = heavy[item]
    if len(dense):
        words = bit_rows(item[is_heavy], rec[is_heavy], dense, n_item, n_rec)
        width = words.shape[1]
        step = max(1, MATRIX_WORDS // width)
        for i in range(len(dense) - 1):
            both = np.concatenate([np.bitwise_count(words[i] & words[k : k + step]).sum(axis=1, dtype=np.int64) for k in range(i + 1, len(dense), step)])
            hit = np.flatnonzero(both)
            found.append((dense[i] * n_item + dense[i + 1 :][hit], both[hit]))
        # a rare item's list of records probes the matrix
        at = np.argsort(item[~is_heavy], kind="stable")
        light, listed = item[~is_heavy][at], rec[~is_heavy][at]
        starts = np.flatnonzero(np.r_[True, light[1:] != light[:-1]]) if len(light) else none
        step = max(1, MATRIX_WORDS // len(dense))
        for s, e in zip(starts, np.r_[starts[1:], len(light)]):
            held = np.zeros(len(dense), dtype=np.int64)
            for k in range(s, e, step):
                probe = listed[k : min(e, k + step)]
                held += ((words[:, probe >> 6] >> (probe & 63).astype(np.uint64)) & np.uint64(1)).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(held)
            other = dense[hit]
            found.append((np.minimum(light[s], other) * n_item + np.maximum(light[s], other), held[hit]))
    order = np.lexsort((item[~is_heavy], rec[~is_heavy]))
    r, x = rec[~is_heavy][order], item[~is_heavy][order]
    pending, step = 0, 1
    rare: list[tuple[np.ndarray, np.ndarray]] = []
    while step < len(r):
        same = np.flatnonzero(r[step:] == r[:-step])
        if not len(same):
            break
        rare.append((x[same] * n_item + x[same + step], np.ones(len(same), dtype=np.int64)))
        pending += len(same)
        if pending > pair_buffer:
            rare = _merge(rare)
            pending = len(rare[0][0])
        step += 1
    found += rare
    if not found:
        return none, none, none
    codes, counts = _merge(found)[0]
    return codes // n_item, codes % n_item, counts


def _codes(r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Dense number of each record key."""
    order = np.lexsort((r2, r1))
    a, b = r1[order], r2[order]
    out = np.empty(len(r1), dtype=np.int64)
    out[order] = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    return out


def _names(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of strings, numbered in the order of their bytes, and the strings."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], [names[i] for i in order]


def _out(repo: int, names: list[str], lo: np.ndarray, hi: np.ndarray, both: np.ndarray, n: np.ndarray, total: int) -> pa.Table:
    table = pa.array(names, pa.string())
    fixed = lambda v: pa.array(np.full(len(lo), v, dtype=np.int64))
    return pa.table(
        [fixed(repo), table.take(pa.array(lo)), table.take(pa.array(hi)), pa.array(both), pa.array(n[lo]), pa.array(n[hi]), fixed(total)],
        names=["repo_id", "symbol_a", "symbol_b", "n_ab", "n_a", "n_b", "n_records"],
    )


def _whole(min_pairs: int, min_lift: float, heavy_share: int):
    """Everything about one repository that fits into a block: its records, item counts and pairs."""

    def run(table: pa.Table) -> pa.Table:
        rec_of_row = _codes(table["r1"].to_numpy(), table["r2"].to_numpy())
        total = int(rec_of_row.max()) + 1
        lists = table["symbols"].combine_chunks()
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        item, names = _names(pc.list_flatten(lists))
        pair = np.unique(rec_of_row[rows] * max(1, len(names)) + item)
        rec, item = pair // max(1, len(names)), pair % max(1, len(names))
        n = np.bincount(item, minlength=len(names)).astype(np.int64)
        able = (n >= min_pairs) & (n * min_lift <= total)
        keep = able[item]
        lo, hi, both = count_block(rec[keep], item[keep], able & (n * heavy_share >= total))
        held = both >= min_pairs
        return _out(table["repo_id"][0].as_py(), names, lo[held], hi[held], both[held], n, total)

    return run


def _block(table: pa.Table) -> pa.Table:
    """Partial counts of one block of a large repository, whose items were counted before."""
    rec = _codes(table["r1"].to_numpy(), table["r2"].to_numpy())
    item, names = _names(table["symbol"])
    n = np.zeros(len(names), dtype=np.int64)
    n[item] = table["n"].to_numpy()
    heavy = np.zeros(len(names), dtype=bool)
    heavy[item] = table["heavy"].to_numpy(zero_copy_only=False)
    lo, hi, both = count_block(rec, item, heavy)
    return _out(table["repo_id"][0].as_py(), names, lo, hi, both, n, table["n_records"][0].as_py())


def _in_blocks(rows: DataFrame, min_pairs: int, min_lift: float, block_records: int, heavy_share: int) -> DataFrame:
    """Counts in repositories of any size: distinct incidences, item counts, then blocks of records."""
    held = rows.select("repo_id", "r1", "r2", F.explode(F.concat("symbols", F.array(F.lit(_SELF)))).alias("symbol")).distinct()
    counts = held.groupBy("repo_id", "symbol").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.filter(F.col("symbol") == _SELF).select("repo_id", F.col("n").alias("n_records"))
    items = (
        counts.filter((F.col("symbol") != _SELF) & (F.col("n") >= min_pairs))
        .join(totals, "repo_id")
        .filter(F.col("n") * min_lift <= F.col("n_records"))
        .withColumn("heavy", F.col("n") * heavy_share >= F.col("n_records"))
        .withColumn("blocks", F.ceil(F.col("n_records") / block_records).cast("int"))
    )
    blocks = held.join(items, ["repo_id", "symbol"]).withColumn("block", F.pmod(F.hash("r1", "r2"), "blocks"))
    partial = blocks.groupBy("repo_id", "block").applyInArrow(_block, COUNTS)
    return partial.groupBy("repo_id", "symbol_a", "symbol_b", "n_a", "n_b", "n_records").agg(F.sum("n_ab").alias("n_ab"))


def pair_counts(rows: DataFrame, min_pairs: int = 1, min_lift: float = 0.0, block_records: int = BLOCK_RECORDS, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Pairs held together by at least min_pairs records of a repository and at least min_lift times as often as chance.

    rows: from records(). Gives repo_id, symbol_a < symbol_b (by byte), n_ab, n_a, n_b, n_records, lift. Items that can't reach
    either bound are left out beforehand, which loses no pair: n_ab is at most the smaller count, and the lift at most
    n_records through the larger one. Repositories with more rows than a block, repeated ones included, go through
    blocks. Empty tables give no rows.
    """
    large = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block_records).select("repo_id")
    many = large.count()
    side = F.broadcast(large) if many <= BROADCAST_REPOS else large
    small = rows.join(side, "repo_id", "left_anti") if many else rows
    total = small.groupBy("repo_id").applyInArrow(_whole(min_pairs, min_lift, heavy_share), COUNTS)
    if many:
        total = total.unionByName(_in_blocks(rows.join(side, "repo_id", "left_semi"), min_pairs, min_lift, block_records, heavy_share))
    return total.filter((F.col("n_ab") >= min_pairs) & (F.col("n_ab") * F.col("n_records") >= min_lift * F.col("n_a") * F.col("n_b"))).withColumn(
        "lift", F.col("n_ab") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b"))
    )
