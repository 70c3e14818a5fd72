"""Packing documents into fixed sequences by cutting-stock column generation.

Documents become pieces: as many of the full capacity as fit, each a sequence of its own, and the rest.
The rests' lengths, rounded up to a grid that is fine for short ones, form a histogram (one bar per grid
step, so its size doesn't depend on the data). Over it a linear program minimises the number of sequences; its columns are
patterns, multisets of lengths that fit one sequence, priced by a knapsack dynamic program on the dual
values until none improves. The solution is rounded down, what is left goes first-fit decreasing, and
the pieces of a length, ranked by where they stand in the input, fill the patterns' places in order.

A null text counts as empty, which is one piece with the end id alone. Null ids are kept, repeated rows are
documents of their own, equal lengths are ranked by where they stand, an empty table gives no rows. Texts
are encoded whole, however long; other columns don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, pick, tidy
from ._tokens import encoder, resolve, together

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, size int, local_rank long"
#: Lengths up to a bound are rounded up to multiples of a step. Many short pieces share a sequence, and with them their rounding.
GRID = ((32, 2), (96, 4), (256, 8), (1 << 62, 16))


def rounded(length: int, grid: tuple[tuple[int, int], ...] = GRID) -> int:
    step = next(step for bound, step in grid if length <= bound)
    return -(-length // step) * step


def tokenize_pieces(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int, grid: tuple[tuple[int, int], ...], specials_as_text: bool, id_col: str, text_col: str) -> DataFrame:
    """A row per piece, with its grid size and its rank among the task's pieces of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, part = encoder(resolve(tokenizer), specials_as_text), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            for some in together(batch, 1):
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode([t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        own = ids[4 * start : 4 * (start + capacity)]
                        length = len(own) // 4
                        size = rounded(length, grid)
                        rows.append((doc, start, length, zlib.crc32(own), n, part, size, seen[size]))
                        seen[size] += 1
                cols = list(zip(*rows)) or [()] * 8
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
                names = [c.split()[0] for c in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(run), _PIECES)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, Callable[[int], list[int]]]:
    """Unbounded knapsack: the best value for every room up to the capacity, and a function from a room to the sizes' indices chosen there.

    One size after the other, for all rooms at once: with a size of s, rooms that are s apart form a column, in
    which the best number of times is a running maximum.
    """
    order = np.lexsort((-values, sizes))
    least = np.maximum.accumulate(np.concatenate([[0.0], values[order]]))[:-1]
    order = order[values[order] > least]  # a larger size that is worth no more is never needed
    best, taken = np.zeros(capacity + 1), []
    for k in order:
        s, v = int(sizes[k]), values[k]
        if s > capacity:
            break
        steps = np.arange(-(-(capacity + 1) // s))[:, None]
        column = np.full(steps.size * s, -np.inf)
        column[: capacity + 1] = best
        column = column.reshape(-1, s) - v * steps
        top = np.maximum.accumulate(column, 0)
        since = np.maximum.accumulate(np.where(column == top, steps, 0), 0)
        best = (top + v * steps).ravel()[: capacity + 1]
        taken.append((int(k), s, (steps - since).ravel()[: capacity + 1]))

    def fill(room: int) -> list[int]:
        chosen = []
        for k, s, times in reversed(taken):
            n = int(times[room])
            chosen += [k] * n
            room -= n * s
        return chosen

    return best, fill


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The best value within the capacity, and the indices of the sizes chosen."""
    best, fill = knapsack(values, sizes, capacity)
    return float(best[capacity]), fill(capacity)


#: Columns tried after each pricing, exchanges after which the basis is inverted anew, and pricings without a gain that end the search.
_COLUMNS, _ANEW, _IDLE = 24, 128, 100


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product without BLAS, whose threads can wait for ever in a process that has started another one, as drivers have."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan's steps, without BLAS as well."""
    m = len(matrix)
    work = np.concatenate([matrix, np.eye(m)], 1)
    for k in range(m):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        work -= np.multiply.outer(others, work[k])
    return work[:, m:]


def cutting_stock(demand: dict[int, int], capacity: int, *, rounds: int = 5000) -> list[tuple[dict[int, int], int]]:
    """(pattern as size -> times, number of sequences) so that each size is placed exactly as often as asked for.

    Each pricing gives several columns: the best pattern with each of the sizes that promise most. It ends when
    none improves, what is left to gain is proved to be under a quarter of a sequence (by the duals, or as no fewer
    sequences hold so many tokens), or exchanges have changed nothing for a while.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), int)
    if not len(sizes):
        return []
    if sizes[-1] > capacity:
        raise ValueError(f"size {sizes[-1]} is over the capacity {capacity}")
    unit = math.gcd(capacity, *sizes.tolist())
    cells, room = sizes // unit, capacity // unit
    d, m = np.array([demand[int(s)] for s in sizes], float), len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, since = _inverse(basis), 0
    x = _times(inverse, d)
    bound, least, idle = float((sizes * d).sum()) / capacity, float("inf"), 0
    for _ in range(rounds):
        duals = inverse.sum(0)
        best, fill = knapsack(duals, cells, room)
        value = best[room]
        bound = max(bound, x.sum() / value)
        idle = idle + 1 if x.sum() > least - 1e-6 else 0
        least = min(least, x.sum())
        if value <= 1 + 1e-7 or x.sum() - bound < 0.25 or idle >= _IDLE:
            break
        promise = duals + best[room - cells]
        tried: set[tuple[int, ...]] = set()
        for k in np.argsort(-promise, kind="stable")[:_COLUMNS]:
            if promise[k] <= 1 + 1e-7:
                break
            chosen = tuple(sorted([int(k), *fill(int(room - cells[k]))]))
            column = np.bincount(chosen, minlength=m).astype(float)
            if chosen in tried or (inverse.sum(0) * column).sum() <= 1 + 1e-7:
                continue
            tried.add(chosen)
            move = _times(inverse, column)
            up = move > 1e-9
            ratio = np.where(up, np.maximum(x, 0) / np.where(up, move, 1), np.inf)
            out = int(ratio.argmin())
            basis[:, out] = column
            since += 1
            if since % _ANEW:
                row = inverse[out] / move[out]
                inverse -= np.multiply.outer(move, row)
                inverse[out] = row
            else:
                inverse = _inverse(basis)
            x = _times(inverse, d)
    whole = np.floor(np.maximum(_times(_inverse(basis), d), 0) + 1e-6).astype(int)
    left, out = d.astype(int), []
    for k in range(m):
        column = basis[:, k].astype(int)
        n = int(min([whole[k], *(left[column > 0] // column[column > 0])]))
        if n > 0:
            out.append(({int(s): int(c) for s, c in zip(sizes, column) if c}, n))
            left -= n * column
    bins: list[list[int]] = []  # what rounding left: at most a pattern's worth per basis column
    room: list[int] = []
    for s, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        for _ in range(n):
            k = next((k for k, r in enumerate(room) if r >= s), None)
            if k is None:
                bins.append([])
                room.append(capacity)
                k = len(bins) - 1
            bins[k].append(s)
            room[k] -= s
    return out + [(dict(Counter(b)), 1) for b in bins]


def places(patterns: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """(size, first rank, end rank, times per sequence, first sequence, slot in it) rows, and the number of sequences."""
    rows, filled, seq = [], Counter(), 0
    for pattern, n in patterns:
        slot = 0
        for size, times in sorted(pattern.items(), reverse=True):
            rows.append((size, filled[size], filled[size] + n * times, times, seq, slot))
            filled[size] += n * times
            slot += times
        seq += n
    return rows, seq


def pack(docs: DataFrame, *, tokenizer: str = "public:word_bpe_49k.json", end_id: int = 1, capacity: int = 2048, grid: tuple[tuple[int, int], ...] = GRID, specials_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_pieces of the sequence.

    A null text counts as empty: one piece with the end id alone. A null doc_id is kept. Each input row
    is a document of its own, so repeated rows are packed as often as they occur. An empty table gives
    no rows. Texts are read once; what is written between is a narrow row per piece. The histogram has
    a bar per step of the grid (164 at 2048) and the table of places at most some thousand rows, whatever the
    input, so the latter is broadcast. Ranks come from counts by task and size and their prefix sums, not from a sort.
    """
    spark = docs.sparkSession
    if rounded(capacity, grid) != capacity:
        raise ValueError("capacity must be on the grid")
    pieces = materialize(tokenize_pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, grid=grid, specials_as_text=specials_as_text, id_col=id_col, text_col=text_col), "pieces")
    counts = materialize(pieces.groupBy("size", "part").agg(F.count("*").alias("n")), "piece-counts")
    demand = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # a row per step of the grid at most
    rows, _ = places(cutting_stock(demand, capacity))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("size", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["size", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    table = F.broadcast(spark.createDataFrame(rows, "at_size int, first long, end long, times int, seq long, slot int"))
    placed = ranked.join(table, (F.col("size") == F.col("at_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    k = F.col("rank") - F.col("first")
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("seq") + F.floor(k / F.col("times"))).cast("long").alias("sequence_id"), (F.col("slot") + k % F.col("times")).alias("slot"))
    own = Window.partitionBy("sequence_id")
    offset = F.coalesce(F.sum("length").over(own.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, F.count("*").over(own).alias("n_pieces"))
