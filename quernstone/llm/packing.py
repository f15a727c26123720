"""Items of varying length packed into containers of fixed capacity.

Sizes are token counts of whole texts; a text is divided only if it alone
exceeds the capacity, and then into full containers and one remainder, which
is packed like any other item.

Rows are dealt in turn into blocks of about BLOCK_ITEMS, whatever their keys,
so no block can grow hot, and every block holds a fair draw of all sizes. Only
(id, size) pairs travel. Each block is packed by bin completion: take the
largest item left, enumerate lazily the fillings of the rest of its container
that no other filling dominates, the least wasteful first, and branch on them;
branches whose waste shows that they cannot beat the best solution so far,
which is a best-fit solution at first, are pruned. The search of a block ends
with a proof, or after NODES steps with the best solution met; `gaps` tells for
each block how far that is from a lower bound. At most the last container of a
block stays open, so the waste of cutting into blocks is under one container
in a thousand.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import encode
from quernstone.session import shuffle_partitions

CAPACITY = 2048
#: Items that are packed together.
BLOCK_ITEMS = 4096
#: Steps after which the search of a block keeps the best solution found; every item is in it.
NODES = 60_000
#: From so few items on, each node is also finished by best fit.
FINISH = 256


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: total size, and items that cannot share one."""
    if not len(sizes):
        return 0
    s = np.sort(sizes)[::-1].astype(np.int64)
    best = -(-int(s.sum()) // capacity)
    total = np.concatenate([[0], np.cumsum(s)])
    asc = -s
    half = int(np.searchsorted(asc, -(capacity // 2), side="left"))  # items above one half
    for k in np.unique(s[s <= capacity // 2]):
        n1 = int(np.searchsorted(asc, -(capacity - k), side="left"))
        end = int(np.searchsorted(asc, -k, side="right"))
        n1 = min(n1, half)
        free = (half - n1) * capacity - int(total[half] - total[n1])
        need = int(total[end] - total[half]) - free
        best = max(best, half + max(0, -(-need // capacity)))
    # of items above 1/(k+1) of the capacity at most k share a container: dual feasible functions
    for k in range(1, 21):
        whole = (k + 1) * s // capacity
        worth = np.where((k + 1) * s % capacity == 0, s * k, whole * capacity)
        best = max(best, -(-int(worth.sum()) // (k * capacity)))
    return max(best, half)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in order of falling size: each item into the fullest container that still takes it."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        at = bisect_right(free, (s, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(s)
            insort(free, (room - s, b))
        else:
            bins.append([s])
            insort(free, (capacity - s, len(bins) - 1))
    return bins


class _Left:
    """The items not yet packed: how many of each size."""

    def __init__(self, sizes: list[int], capacity: int = 0):
        self.many = np.bincount(np.array(sizes, np.int64), minlength=capacity + 1).astype(np.int32)
        self.items = len(sizes)

    def take(self, s: int) -> None:
        self.many[s] -= 1
        self.items -= 1

    def put(self, s: int) -> None:
        self.many[s] += 1
        self.items += 1

    def largest(self, at_most: int | None = None) -> int:
        """The largest size left, within at_most; 0 if there is none."""
        found = np.flatnonzero(self.many if at_most is None else self.many[: at_most + 1])
        return int(found[-1]) if len(found) else 0

    def sizes(self) -> list[int]:
        return np.repeat(np.arange(len(self.many)), self.many).tolist()


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Can the items of b be put inside those of a, several into one, some left empty? Then b need not be tried."""
    items = sorted(b, reverse=True)

    def place(i: int, room: list[int]) -> bool:
        if i == len(items):
            return True
        tried = set()
        for j, r in enumerate(room):
            if items[i] <= r and r not in tried:
                tried.add(r)
                room[j] -= items[i]
                if place(i + 1, room):
                    return True
                room[j] += items[i]
        return False

    return sum(b) <= sum(a) and place(0, list(a))


def undominated(left: _Left, filling: tuple[int, ...], slack: int) -> bool:
    """Is there no item outside that may take the place of some inside (or of none), as large as they are together or larger?

    If another filling dominates this one, some single exchange of that kind
    leads towards it. Of long fillings only small subsets are tried: one that
    is dominated may pass then and be tried in vain, but none that is
    undominated is lost.
    """
    many, n = left.many, len(filling)
    outside = many.copy()
    for s in filling:
        outside[s] -= 1
    for k in range(n + 1 if n <= 8 else 3 if n <= 40 else 2):
        for t in {sum(inside) for inside in combinations(filling, k)}:
            if outside[t + (k < 2) : t + slack + 1].any():
                return False
    return True


def exact(left: _Left, target: int, k: int, even: bool = False) -> Iterator[tuple[int, ...] | None]:
    """All sets of k items of the given sum, those of unlike sizes first, or of even ones; None for each step that finds nothing.

    Lazy: it may be continued whenever `left` is as it was at first.
    """
    many = left.many
    top = len(many) - 1
    if k == 1:
        yield (target,) if target <= top and many[target] else None
        return
    least = int(np.argmax(many > 0))
    items: list[int] = []
    # each level: the sizes it may still take, falling, and the place among them
    levels: list[list] = []
    used = np.zeros_like(many)
    rest, most = target, min(target, top)
    while True:
        r = k - len(items)
        if r == 2:
            low, high = max(-(-rest // 2), rest - top), min(most, rest - least)
            found = False
            if low <= high:
                free = many - used if items else many
                pairs = np.flatnonzero((free[low : high + 1] > 0) & (free[rest - high : rest - low + 1][::-1] > 0)) + low
                for a in (pairs if even else pairs[::-1]).tolist():
                    b = rest - a
                    if a != b or free[a] > 1:
                        found = True
                        yield (*items, a, b)
            if not found:
                yield None
        else:
            # the first of r falling sizes is at least their mean, and leaves room for the others
            low, high = -(-rest // r), min(most, rest - (r - 1) * least)
            choices = (np.flatnonzero((many - used)[low : high + 1] > 0) + low).tolist() if low <= high else []
            if not even:
                choices.reverse()
            levels.append([choices, 0])
        while levels:
            level = levels[-1]
            if len(items) == len(levels):  # this level's choice is done with
                c = items.pop()
                used[c] -= 1
                rest += c
            if level[1] < len(level[0]):
                c = level[0][level[1]]
                level[1] += 1
                items.append(c)
                used[c] += 1
                rest -= c
                most = c
                break
            levels.pop()
            yield None
        else:
            return


def reachable(left: _Left, room: int) -> int:
    """Bit x is set if some of the items have the sum x, for x up to room."""
    bits, mask = 1, (1 << (room + 1)) - 1
    for s in np.flatnonzero(left.many[: room + 1]).tolist():
        for _ in range(min(int(left.many[s]), room // s)):
            bits |= (bits << s) & mask
    return bits


def fillings(left: _Left, room: int, limit: int, even: bool = False) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of the room that waste at most `limit`, the least wasteful first; None for each one passed over.

    It may be continued whenever `left` is as it was at first.
    """
    least = int(np.argmax(left.many > 0)) if left.items else room + 1
    if least > room:
        yield ()
        return
    if room < len(left.many) and left.many[room]:  # one item that fills the room dominates all
        yield (room,)
        return
    sums = reachable(left, room)
    for waste in range(min(limit, room - least) + 1):
        target = room - waste
        if not sums >> target & 1:
            continue
        for k in range(1, min(target // least, left.items) + 1):
            for f in exact(left, target, k, even):
                yield f if f is not None and undominated(left, f, waste) else None


def pack(sizes: list[int], capacity: int = CAPACITY, *, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of sizes; sizes lie between 1 and the capacity.

    Branch and bound from a best-fit incumbent, in two orders of the fillings,
    each with half of the nodes. Where these end before the search does, the
    result is the best solution met, and no proof.
    """
    best = best_fit(sizes, capacity)
    floor = lower_bound(np.array(sizes, np.int64), capacity) if sizes else 0
    for even in (False, True):
        if len(best) > floor:
            best, proven = _search(sizes, capacity, best, floor, nodes // 2, even)
            if proven:
                break
    return best


def _search(sizes: list[int], capacity: int, best: list[list[int]], floor: int, nodes: int, even: bool) -> tuple[list[list[int]], bool]:
    """The best solution met from an incumbent on, and whether the search ended before its nodes."""
    total = sum(sizes)
    left = _Left(sizes, capacity)
    #: Each level: the container's largest item, the fillings left to try, what is in it now, its waste.
    path: list[list] = []
    waste = 0
    while True:
        allowed = (len(best) - 1) * capacity - total
        deeper = False
        if not left.items:
            if len(path) < len(best):
                best = [[p[0], *p[2]] for p in path]
        elif waste <= allowed and len(path) + 1 < len(best):
            deeper = True
            if left.items <= FINISH or nodes <= 0:
                rest = best_fit(left.sizes(), capacity)
                if len(path) + len(rest) < len(best):
                    best = [[p[0], *p[2]] for p in path] + rest
                    allowed = (len(best) - 1) * capacity - total
                    deeper = waste <= allowed and len(path) + 1 < len(best)
        if len(best) == floor or nodes <= 0:
            return best, len(best) == floor
        if deeper:
            big = left.largest()
            left.take(big)
            path.append([big, fillings(left, capacity - big, allowed - waste, even), None, 0])
        # step back to the last level that has a filling left
        while path:
            level = path[-1]
            if level[2] is not None:
                for s in level[2]:
                    left.put(s)
                waste -= level[3]
                level[2] = None
            f = next(level[1], False)
            nodes -= 1
            while f is None and nodes > 0:
                nodes -= 1
                f = next(level[1], False)
            if f is None:  # out of nodes: finish from here
                f = ()
            if f is not False:
                level[2] = f
                level[3] = capacity - level[0] - sum(f)
                waste += level[3]
                for s in f:
                    left.take(s)
                break
            left.put(level[0])
            path.pop()
        if not path:
            return best, True


# -- DataFrames --------------------------------------------------------------

CONTAINERS = "container_id bigint, piece_no int, token_start int, token_end int, n_tokens int"
_SIZED = "block bigint, n_tokens int"


def sized(df: DataFrame, id_column: str, text_column: str, blocks: int, *, folder: str | None = None) -> DataFrame:
    """(id, block, n_tokens): rows dealt in turn, counted by the tokenizer, without a shuffle."""
    id_type = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode.encoder(encode.vocabulary_path(folder))
        at = None
        for b in batches:
            if at is None and b.num_rows:
                # tasks begin at different blocks
                at = int(b.column(2)[0].as_py()) * 2_654_435_761 % blocks
            for part in encode._by_size(b):
                n = [len(x) for x in encode.encode_texts(part.column(1).to_pylist(), enc)]
                block = (at + np.arange(len(n))) % blocks
                at += len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(block, pa.int64()), pa.array(n, pa.int32())], names=[id_column, "block", "n_tokens"])

    rows = df.select(id_column, F.col(text_column).cast("string"), F.spark_partition_id().alias("__task"))
    return rows.mapInArrow(run, f"`{id_column}` {id_type}, {_SIZED}")


def pack_texts(df: DataFrame, id_column: str, text_column: str, *, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, folder: str | None = None) -> DataFrame:
    """(id, container_id, piece_no, token_start, token_end, n_tokens): where each text, or piece of one, lies.

    A text of more than `capacity` tokens comes as several pieces, all others as
    one. Texts without tokens (null, empty) take no room: each is named once, in
    a container of its block. Rows of equal id are packed apart. An empty table
    gives an empty result.
    """
    blocks = max(1, -(-df.count() // block_items))
    id_type = df.select(id_column).schema[0].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return _pack_block(table, id_column, capacity)

    # the blocks are small but take time: an explicit number of partitions keeps them from being joined into a few tasks
    tasks = min(4 * blocks, max(4 * shuffle_partitions(df.sparkSession), blocks // 16))
    return sized(df, id_column, text_column, blocks, folder=folder).repartition(tasks, "block").groupBy("block").applyInArrow(run, f"`{id_column}` {id_type}, {CONTAINERS}")


def gaps(packed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(block, items, containers, bound, gap): containers of each block, the fewest that any packing needs, and the difference.

    Pieces count as items; texts without tokens do not.
    """

    def run(table: pa.Table) -> pa.Table:
        size, container = table["n_tokens"].to_numpy(), table["container_id"].to_numpy()
        used, bound = len(np.unique(container)), lower_bound(size, capacity)
        return pa.table({"block": table["block"][:1], "items": pa.array([len(size)], pa.int64()), **{n: pa.array([v], pa.int64()) for n, v in (("containers", used), ("bound", bound), ("gap", used - bound))}})

    rows = packed.where("n_tokens > 0").select(F.shiftright("container_id", 24).alias("block"), "container_id", "n_tokens")
    return rows.groupBy("block").applyInArrow(run, "block bigint, items bigint, containers bigint, bound bigint, gap bigint")


def _pack_block(table: pa.Table, id_column: str, capacity: int) -> pa.Table:
    table = table.combine_chunks()
    n = table["n_tokens"].to_numpy().astype(np.int64)
    block = int(table["block"][0].as_py())
    rows, piece, start, size, container = [], [], [], [], []
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    full = 0

    def put(row: int, no: int, at: int, length: int, into: int) -> None:
        rows.append(row), piece.append(no), start.append(at), size.append(length), container.append(into)

    for row, length in enumerate(n.tolist()):
        no = at = 0
        while length - at > capacity:
            put(row, no, at, capacity, full)
            no, at, full = no + 1, at + capacity, full + 1
        if length:
            waiting.setdefault(length - at, []).append((row, no, at))
    packed = pack([s for s, w in waiting.items() for _ in w], capacity)
    for i, content in enumerate(packed):
        for s in content:
            row, no, at = waiting[s].pop()
            put(row, no, at, s, full + i)
    for row in np.flatnonzero(n == 0).tolist():
        put(row, 0, 0, 0, 0)
    ids = table[id_column].combine_chunks().take(pa.array(rows, pa.int64()))
    start_, size_ = np.array(start, np.int32), np.array(size, np.int32)
    return pa.table({
        id_column: ids, "container_id": pa.array((block << 24) + np.array(container, np.int64), pa.int64()), "piece_no": pa.array(piece, pa.int32()),
        "token_start": pa.array(start_), "token_end": pa.array(start_ + size_), "n_tokens": pa.array(size_),
    })
