"""The best N items of every group, from sorted runs that a loser tree merges.

Each input partition becomes a run ordered by group and rank key, cut to the first N items of each group; no other row
of that partition can be among the best N of all. Runs are stored by bucket of the group, merged with a loser tree,
and once a group has N items every run seeks to its next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import parts_for

GROUP = ["query_id", "kind"]
#: Buckets of groups: as many partitions as a cluster may want.
BUCKETS = 1 << 20
#: Rows that a task turns into Python objects at once.
SLICE_ROWS = 20_000
_RUN = "query_id long, kind string, score double, file_path string, qualified_name string, result_id long"


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """True where a row's group differs from the row's before; the first is True."""
    out = np.ones(batch.num_rows, dtype=bool)
    if batch.num_rows > 1:
        same = np.ones(batch.num_rows - 1, dtype=bool)
        for name in GROUP:
            column = batch.column(batch.schema.get_field_index(name))
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
            null = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            same &= equal | null
        out[1:] = ~same
    return out


def cut_runs(top: int):
    """Keeps, of rows in run order, the first row of each of a group's first `top` items. Only the group at hand is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        seen: set = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_changes(batch))
            names = batch.column(batch.schema.get_field_index("qualified_name"))
            heads = list(zip(*(batch.column(batch.schema.get_field_index(g)).take(pa.array(starts)).to_pylist() for g in GROUP)))
            ends = np.r_[starts[1:], batch.num_rows]
            keep: list[int] = []
            short = ends - starts == 1
            for k, head in enumerate(heads):
                if head != last:
                    last, seen = head, set()
                    if short[k] and k + 1 < len(heads):
                        keep.append(int(starts[k]))
                        continue
                for i in range(int(starts[k]), int(ends[k])):
                    if len(seen) >= top:
                        break
                    name = names[i].as_py()
                    if name not in seen:
                        seen.add(name)
                        keep.append(i)
            yield batch.take(pa.array(keep, type=pa.int64()))

    return run


class LoserTree:
    """Tournament of sorted runs: the root holds the run with the least head, inner nodes the losers of their matches."""

    def __init__(self, heads: list) -> None:
        self.size = len(heads)
        self.heads = heads  # None: the run is at its end
        self.tree = [-1] * max(1, self.size)
        for run in range(self.size - 1, -1, -1):
            self._enter(run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and x < y

    def _enter(self, run: int) -> None:
        node = (run + self.size) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = run
                return
            if self._less(other, run):
                self.tree[node], run = run, other
            node //= 2
        self.tree[0] = run

    @property
    def winner(self) -> int:
        return self.tree[0]

    def replace(self, head) -> None:
        """The winner's run goes on with this head."""
        run = self.tree[0]
        self.heads[run] = head
        node = (run + self.size) // 2
        while node:
            other = self.tree[node]
            if self._less(other, run):
                self.tree[node], run = run, other
            node //= 2
        self.tree[0] = run


def merge_groups(runs: list[list[tuple]], next_group: list[list[int]], top: int) -> Iterator[tuple[int, int, int]]:
    """(run, row, rank) of the output. Rows: (group, rank key, item), runs sorted by them; next_group: of each row, the row at which its run's next group begins."""
    if not runs:
        return
    at = [0] * len(runs)
    tree = LoserTree([(*r[0], i) for i, r in enumerate(runs)])
    group, seen = None, set()
    while (head := tree.heads[run := tree.winner]) is not None:
        if head[0] != group:
            group, seen = head[0], set()
        here = at[run]
        if len(seen) >= top:
            at[run] = next_group[run][here]
        else:
            item = runs[run][here][2]
            if item not in seen:
                seen.add(item)
                yield run, here, len(seen)
            at[run] = here + 1
        rows = runs[run]
        tree.replace((*rows[at[run]], run) if at[run] < len(rows) else None)


def merge_runs(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        del parts
        number = table["run"].to_numpy()
        slot = table["bucket"].to_numpy() % max(1, len(number) // SLICE_ROWS)  # parts of the partition that are merged one after another
        order = np.lexsort((np.arange(len(number)), number, slot))  # stable: a run's rows stay in their order
        table = table.take(pa.array(order)).combine_chunks()
        slot, number = slot[order], number[order]
        edges = np.flatnonzero(np.r_[True, np.diff(slot) != 0, True])
        for b0, b1 in zip(edges[:-1], edges[1:]):
            yield _merge_bucket(table.slice(b0, b1 - b0), number[b0:b1], top)

    return run


def _merge_bucket(table: pa.Table, number: np.ndarray, top: int) -> pa.RecordBatch:
    q, k, s, f, n, r = (table[c].to_pylist() for c in ("query_id", "kind", "score", "file_path", "qualified_name", "result_id"))
    rows = [
        (
            (a is not None, a or 0, b),
            (-c, d is None, d or "", e is None, e or "", g is None, g or 0),
            e,
        )
        for a, b, c, d, e, g in zip(q, k, s, f, n, r)
    ]
    # a task that reads several partitions gets a run in several sorted pieces, one after another
    runs_of = number.tolist()
    cuts = [0, *(i for i in range(1, len(rows)) if runs_of[i] != runs_of[i - 1] or rows[i] < rows[i - 1]), len(rows)]
    runs = [rows[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
    following = []
    for part in runs:
        nxt, after = [0] * len(part), len(part)
        for i in range(len(part) - 1, -1, -1):
            if i + 1 < len(part) and part[i + 1][0] != part[i][0]:
                after = i + 1
            nxt[i] = after
        following.append(nxt)
    out = [(cuts[run] + row, rank) for run, row, rank in merge_groups(runs, following, top)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([q[i] for i, _ in out], pa.int64()),
            pa.array([k[i] for i, _ in out], pa.string()),
            pa.array([rank for _, rank in out], pa.int32()),
            pa.array([r[i] for i, _ in out], pa.int64()),
        ],
        names=["query_id", "kind", "rank_no", "result_id"],
    )


def top_items(results: DataFrame, top: int = 5) -> DataFrame:
    """query_id, kind, rank_no, result_id of the best `top` items (distinct qualified_name) of each (query_id, kind).

    kind is trimmed and lower-cased. Rows with null kind, or null or NaN score, take no part. Order: score descending,
    file_path with nulls last, qualified_name, result_id; an item stands at its first row. A null query_id is a group
    of its own, a null qualified_name one item, null result_ids come last. Empty tables give no rows.
    """
    rows = results.select(
        "query_id",
        F.lower(F.btrim("kind", F.lit(" \t\r\n"))).alias("kind"),
        (F.col("score") + F.lit(0.0)).alias("score"),
        "file_path",
        "qualified_name",
        "result_id",
    ).filter(F.col("kind").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    sort = [F.col("query_id").asc(), F.col("kind").asc(), F.col("score").desc(), F.col("file_path").asc_nulls_last(), F.col("qualified_name").asc_nulls_last(), F.col("result_id").asc_nulls_last()]
    runs = rows.sortWithinPartitions(*sort).mapInArrow(cut_runs(top), _RUN)
    stored = runs.withColumn("run", F.spark_partition_id()).withColumn("bucket", F.pmod(F.hash(*GROUP), F.lit(BUCKETS)))
    parts = parts_for(results)
    stored = stored.repartition(parts, "bucket") if parts else stored.repartition("bucket")
    return stored.mapInArrow(merge_runs(top), "query_id long, kind string, rank_no int, result_id long")
