"""Filling windows of fixed capacity with texts of varying length.

Method: swap-based local search. Texts longer than a window are cut into whole windows and a rest; rests and short texts are
first put into windows in the order in which they come, then emptied windows are what the search makes: a text moves from one
underfull window to another, is exchanged for a smaller one, two texts are exchanged for one or one for two, whenever the sum of
squared fills grows, until no such step is left or the windows are as few as their tokens allow.

Scale: texts are hash-spread into blocks of about ``BLOCK`` pieces which are packed apart, in one pass over (id, size) rows; a
block wastes at most its last windows, less than one in a thousand. Nothing is gathered beyond a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.session import written

CAPACITY = 2_048
#: Pieces packed together.
BLOCK = 20_000


def in_order(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item if bins are filled in the order of arrival: the start of the search."""
    bin_of = np.empty(len(sizes), np.int64)
    b = fill = 0
    for i, size in enumerate(sizes.tolist()):
        if fill + size > capacity:
            b, fill = b + 1, 0
        bin_of[i] = b
        fill += size
    return bin_of


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item (0 <= size <= capacity), bins numbered from 0."""
    if not len(sizes):
        return np.empty(0, np.int64)
    search = Search(sizes, in_order(sizes, capacity), capacity)
    search.run()
    return np.unique(search.bin_of, return_inverse=True)[1]


class Search:
    """Items in bins, and the steps by which room gathers in few of them. Every step raises the sum of squared fills, so it ends."""

    def __init__(self, sizes: np.ndarray, bin_of: np.ndarray, capacity: int):
        self.sizes, self.bin_of, self.capacity = np.asarray(sizes, np.int64), np.asarray(bin_of, np.int64).copy(), capacity
        n = int(self.bin_of.max()) + 1
        self.items: list[list[int]] = [[] for _ in range(n)]
        for i, b in enumerate(self.bin_of.tolist()):
            self.items[b].append(i)
        self.fill = np.bincount(self.bin_of, self.sizes, n).astype(np.int64)
        #: The step that changed a bin last, and the step up to which a bin was found to have no further step.
        self.changed, self.settled = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.step = 0

    def run(self) -> None:
        """Steps from the emptiest bin on, until no bin has any."""
        least, used = -(-int(self.sizes.sum()) // self.capacity), int((self.fill > 0).sum())
        moved = True
        while used > least and moved:
            moved = False
            underfull = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            for b in underfull[np.argsort(self.fill[underfull], kind="stable")].tolist():
                moved |= self._relieve(b)
                if not self.fill[b]:
                    used -= 1
                    break  # the next emptiest first

    def _relieve(self, b: int) -> bool:
        """Steps that move room into bin ``b``, until it is empty or has none left; whether there was any."""
        any_step = False
        while self.fill[b] > 0:
            # A bin without steps that did not change since needs a look at the bins that did, only.
            since = self.settled[b] + 1 if self.settled[b] >= self.changed[b] else 0
            now = self.step
            if not self._step(b, int(since)):
                self.settled[b] = now
                break
            any_step = True
        return any_step

    def _shift(self, b: int, out: list[int], c: int, back: list[int]) -> None:
        self.step += 1
        for a, z, some in ((b, c, out), (c, b, back)):
            for i in some:
                self.items[a].remove(i)
                self.items[z].append(i)
            self.bin_of[some] = z
        gain = int(self.sizes[out].sum() - self.sizes[back].sum())
        self.fill[b] -= gain
        self.fill[c] += gain
        self.changed[[b, c]] = self.step

    def _step(self, b: int, since: int) -> bool:
        """Improving steps between ``b`` and bins changed at step ``since`` or later; False if there is none."""
        sizes, fill = self.sizes, self.fill
        own = np.array(sorted(self.items[b], key=lambda i: -sizes[i]), np.int64)
        room = np.where((fill > 0) & (self.changed >= since), self.capacity - fill, 0)
        room[b] = 0
        # Squares grow if what moves is more than what the other bin lacks.
        lack = np.maximum(fill[b] - fill, 0)
        most = int(room.max())
        if not most:
            return False
        for i in own[sizes[own] <= most].tolist():  # move into the tightest bin that takes it
            fits = np.flatnonzero((room >= sizes[i]) & (lack < sizes[i]))
            if len(fits):
                self._shift(b, [i], int(fits[np.argmin(room[fits])]), [])
                return True
        there = np.flatnonzero(room[self.bin_of] > 0) if not since else np.array([j for c in np.flatnonzero(room).tolist() for j in self.items[c]], np.int64)
        bins = self.bin_of[there]

        def gains(out: np.ndarray, back: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            gain = out[:, None] - back[None, :]
            gain[(gain > room[of]) | (gain <= lack[of])] = 0
            best = gain.argmax(1)
            return best, gain[np.arange(len(out)), best]

        # One for one: of every own item the best exchange, with different bins.
        best, gain = gains(sizes[own], sizes[there], bins)
        met: set[int] = set()
        for o in np.argsort(-gain, kind="stable").tolist():
            c = int(bins[best[o]])
            if gain[o] > 0 and c not in met and gain[o] > self.fill[b] - self.fill[c]:
                self._shift(b, [int(own[o])], c, [int(there[best[o]])])
                met.add(c)
        if met:
            return True
        x, y = np.triu_indices(len(own), 1)
        for part in range(0, len(x), 256):  # two for one
            first, second = own[x[part : part + 256]], own[y[part : part + 256]]
            best, gain = gains(sizes[first] + sizes[second], sizes[there], bins)
            o = int(gain.argmax())
            if gain[o] > 0:
                self._shift(b, [int(first[o]), int(second[o])], int(bins[best[o]]), [int(there[best[o]])])
                return True
        # One for two: all pairs of items that share a bin now, those a given distance apart together.
        there = there[np.argsort(bins, kind="stable")]
        for apart in range(1, len(there)):
            same = np.flatnonzero(self.bin_of[there[apart:]] == self.bin_of[there[:-apart]])
            if not len(same):
                break
            first, second = there[same], there[same + apart]
            best, gain = gains(sizes[own], sizes[first] + sizes[second], self.bin_of[first])
            o = int(gain.argmax())
            if gain[o] > 0:
                back = [int(first[best[o]]), int(second[best[o]])]
                self._shift(b, [int(own[o])], int(self.bin_of[back[0]]), back)
                return True
        return False


def fill_windows(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, start, n_tokens, window_id, first_window_id`` for every row of ``sizes``.

    A text of at most ``capacity`` tokens is one piece; a longer one is cut into whole windows and, if tokens are left, a rest that
    shares a window. Texts of size 0 or null take no room: one piece of 0 tokens whose window_id is null. Repeated and null keys are
    separate texts. window_id is unique and otherwise without meaning; first_window_id is the window before the local search.
    """
    n = F.coalesce(F.col(size), F.lit(0))
    sized = written(sizes.select(key, n.cast("bigint").alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    whole = F.floor(F.col("n_tokens") / capacity)
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece")
    full = sized.filter(F.col("n_tokens") >= capacity).select(key, "row", piece)
    own = F.concat_ws(".", F.lit("w"), "row", "piece")
    full = full.select(key, "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens"), own.alias("window_id"), own.alias("first_window_id"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    empty = sized.filter("n_tokens = 0").select(key, zero.alias("piece"), zero.alias("start"), "n_tokens", none.alias("window_id"), none.alias("first_window_id"))
    rest = sized.filter(F.col("n_tokens") % capacity != 0).select(key, whole.alias("piece"), (whole * capacity).alias("start"), (F.col("n_tokens") % capacity).alias("n_tokens"), "row")
    blocks = max(1, -(-rest.count() // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("row").combine_chunks()  # whatever order the rows came in
            taken = table.column("n_tokens").to_numpy()
            for name, bins in (("window_id", pack(taken, capacity)), ("first_window_id", in_order(taken, capacity))):
                table = table.append_column(name, pa.array([f"s.{task}.{done}.{b}" for b in bins.tolist()]))
            return table.drop_columns(["row"]).combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * BLOCK:
                yield packed()
                done, held, rows = done + 1, [], 0
        if rows:
            yield packed()

    spread = rest.repartition(blocks, F.xxhash64("row"))
    return full.unionByName(empty).unionByName(spread.mapInArrow(run, full.schema))


def fill_report(windows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: windows used, windows before the local search, the least possible number, tokens, and the share of room used."""
    filled = windows.filter("window_id is not null")
    used = filled.groupBy("window_id").agg(F.sum("n_tokens").alias("fill"))
    total = used.agg(F.count("*").alias("n_windows"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"), F.max("fill").alias("largest_fill"))
    before = filled.select("first_window_id").distinct().agg(F.count("*").alias("n_windows_before"))
    shares = total.select("n_windows", F.ceil(F.col("n_tokens") / capacity).alias("least_windows"), "n_tokens", "largest_fill", (F.col("n_tokens") / (F.col("n_windows") * capacity)).alias("fill_share"))
    return shares.crossJoin(F.broadcast(before))  # one row each
