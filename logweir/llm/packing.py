"""Best-fit packing over a length histogram (operator 2).

Only documents longer than a sequence are cut, into full pieces and a rest.
The plan packs counts of lengths, best fit in decreasing order: open bins are
counted by the room they have left, and each length goes into the smallest
room that holds it, a new bin opening only where none does. Bins that were
filled alike stay one run, and a length splits at most two of them, so the plan
takes time and space by the number of lengths, however many documents there
are. Pieces then take the planned slots of their length by their rank within it.

A piece is numbered within its length by the task that cuts it; the pieces of
that length in the tasks before come from counts by (length, task). Ids are
thus never shuffled: those counts are broadcast where Spark's own size check
allows it, and joined by (length, task) beyond it. A length that a third of all
rows share is spread over all tasks.

A null or empty text is one piece with only its end id. Repeated rows are
packed separately; equal lengths take slots in any order. Very long texts give
many pieces, of one task. Columns of documents other than doc_id and text are
not carried, so none can clash. An empty table gives an empty result.
"""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweir.llm.common import BATCH_ROWS, discard, small_batches, written
from logweir.llm.tokens import gathered, tokenizer, vocabulary, with_end

PIECES = "doc_id long, piece int, start long, length int, ids array<int>, ids_crc32 long, _rank long, _task int"


class Ranks:
    """Numbers a task's pieces within their lengths, batch by batch."""

    def __init__(self, capacity: int):
        self.seen, self.task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()

    def columns(self, length: np.ndarray) -> list[pa.Array]:
        """_rank and _task of the next pieces."""
        order = np.argsort(length, kind="stable")
        laid = length[order]
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(laid)) - np.searchsorted(laid, laid) + self.seen[laid]
        self.seen += np.bincount(length, minlength=len(self.seen))
        return [pa.array(rank), pa.array(np.full(len(length), self.task, np.int32))]


def tokenize_pieces(docs: DataFrame, capacity: int = 4096, vocab: str | None = None, end_id: int | None = 1) -> DataFrame:
    """doc_id, piece, start, length, ids of ``docs`` (doc_id, text), ids_crc32: unsigned, of the ids as little-endian unsigned 32-bit integers, and the numbers _rank and _task that place_pieces() goes by."""
    path = vocab or vocabulary()

    def cut(batches):
        tok, ranks = tokenizer(path), Ranks(capacity)
        for batch in gathered(batches):
            ids, ends = with_end(*tok.encode_column(batch.column(1)), end_id)
            counts = np.diff(ends)
            parts = np.maximum(1, -(-counts // capacity))
            row = np.repeat(np.arange(batch.num_rows), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            offsets = np.concatenate([[0], np.cumsum(length)])
            raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), (offsets * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            cols = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), lists, pa.array(crc, pa.int64()), *ranks.columns(length)]
            for a in range(0, len(row), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(a, BATCH_ROWS) for c in cols], ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "_rank", "_task"])

    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, items per bin), ...]), ...] by best fit over counts, longest first."""
    open_: dict[int, list] = {}  # room left: runs (bins, items), items a chain (length, items per bin, rest of the chain)
    rooms: list[int] = []

    def put(room, bins, items):
        if bins:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((bins, items))

    for length in sorted(counts, reverse=True):
        left = int(counts[length])
        if not 0 < length <= capacity or left < 0:
            raise ValueError(f"{left} items of length {length} do not fit {capacity}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, items = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, bins, items = capacity, left, None
            # Having taken one, a bin is the smallest room as long as another fits.
            each = room // length
            full = min(bins, left // each)
            put(room - each * length, full, (length, each, items))
            left -= full * each
            if full < bins and left:
                put(room - left * length, 1, (length, left, items))
                full, left = full + 1, 0
            if items or room < capacity:
                put(room, bins - full, items)
    plan = []
    for room in rooms:
        for bins, items in open_[room]:
            pattern = []
            while items:
                pattern.append(items[:2])
                items = items[2]
            plan.append((bins, pattern[::-1]))
    return plan


def slot_runs(plan) -> dict[str, np.ndarray]:
    """Runs of slots by (length, first rank): a run's ranks go to ``bins`` consecutive bins, then to these again, one length on."""
    runs, used, bin_no = [], {}, 0
    for bins, pattern in plan:
        offset = 0
        for length, k in pattern:
            first = used.get(length, 0)
            runs.append((length, first, bin_no, offset, bins))
            used[length] = first + bins * k
            offset += k * length
        bin_no += bins
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "offset", "bins"), table.T.copy()))


def number_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (length among its columns) as a table with _rank and _task, for pieces that tokenize_pieces() has not cut."""
    rows = pieces.withColumn("length", F.col("length").cast("int"))
    place = rows.columns.index("length")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("_rank long, _task int").fields])

    def number(batches):
        ranks = Ranks(capacity)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *ranks.columns(batch.column(place).to_numpy())], schema.names)

    return written(small_batches(rows).mapInArrow(number, schema), "pack-numbers")


def place_pieces(pieces: DataFrame, capacity: int = 4096, keep: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """``keep`` columns and length with sequence_id and offset, for a table of pieces with _rank and _task."""
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("length", "_task").agg(F.count("*").alias("_n")), "pack-counts")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    # A table: its size is what Spark checks before it broadcasts it.
    bases = written(counts.select("length", "_task", F.coalesce(before, F.lit(0)).alias("_base")), "pack-bases")
    # At most ``capacity`` lengths come to the driver; the plan has runs by lengths, not by documents.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    discard(counts)
    runs = spark.sparkContext.broadcast(slot_runs(plan_bins(histogram, capacity)))
    schema = StructType([*pieces.select(*keep, "length").schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])

    def take(batches):
        plan = runs.value
        keys = plan["length"] << 42 | plan["rank"]
        for batch in batches:
            length, rank, base = (batch.column(len(keep) + i).to_numpy().astype(np.int64) for i in range(3))
            at = np.searchsorted(keys, length << 42 | (rank + base), side="right") - 1
            lap, step = np.divmod(rank + base - plan["rank"][at], plan["bins"][at])
            cols = [pa.array(plan["bin"][at] + step), pa.array(plan["offset"][at] + lap * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 1], *cols], schema.names)

    based = pieces.join(bases, ["length", "_task"]).select(*keep, "length", "_rank", "_base")
    return small_batches(based).mapInArrow(take, schema)


def pack_documents(docs: DataFrame, capacity: int = 4096, vocab: str | None = None, end_id: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """(pieces with ids, placements): join them on (doc_id, piece, start) to write sequences."""
    pieces = written(tokenize_pieces(docs, capacity, vocab, end_id), "pack-pieces")
    return pieces, place_pieces(pieces, capacity)
