"""Sharding by minimax contiguous partition (operator 10, native).

Rows with equal text are one atomic group. Groups are ordered by a 64-bit hash
of their text and gathered into 2**14 cells of that order, a group that would be
an even cell by itself staying its own, so the plan is bounded however many
texts there are. The smallest feasible shard capacity is found by binary search
over the cells' prefix sums; a capacity is checked greedily. No capacity below
the widest group or an even share is feasible: where the cells' capacity is
above that, the cells in which a cut of any capacity between may fall are split
by further bits of the hash, until these cells are single groups or the bound is
met. The capacity is then the least for groups, not for cells. Cuts lie within
what that capacity allows, each as near as it can to an even share of what is
left.

Empty and null texts are groups of their own; a null text has no bytes, every
row weighs one more than its bytes. An empty table gives an empty result.
Repeated rows take separate slots; rows of one key and size are numbered in any
order. Very long texts are one row's weight. Input columns with a name of OWN
are left out: the operator's take their place.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import discard, written

OWN = ("size", "shard", "slot", "_hash", "_cell", "_part", "_base", "_n", "_bytes", "_rows", "_sum", "_in_cell", "_in_shard")
CELL_BITS = 14
#: Parts into which a cell is split at once, and bisections that find a place among all cells.
SPLIT, STEPS = 64, 20
#: A group's rows are numbered in this many parts at once, so a hot group is never one task.
PARTS = 512


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_cell(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS).cast("int")


def text_order(text: Column) -> Column:
    """The hash that orders groups; cells are its highest bits."""
    return F.xxhash64(text).bitwiseXOR(F.lit(-(1 << 63)))


def _find(bound: str) -> str:
    """Largest i with prefix[i] <= bound, by bisection; prefix[0] is 0."""
    mid = "((s.a + s.b + 1) div 2)"
    return (
        f"aggregate(sequence(1, {STEPS}), named_struct('a', 0L, 'b', n), (s, i) -> IF(element_at(prefix, CAST({mid} + 1 AS INT)) <= {bound},"
        f" named_struct('a', {mid}, 'b', s.b), named_struct('a', s.a, 'b', greatest(s.a, {mid} - 1))), s -> s.a)"
    )


def _at(i: str) -> str:
    return f"element_at(prefix, CAST({i} + 1 AS INT))"


def smallest_capacity(cells: DataFrame, shards: int) -> int:
    """Least capacity with which ``shards`` contiguous runs hold all cells; ``cells`` is the row of _prefix()."""
    feasible = f"(aggregate(sequence(1, {shards}), 0L, (p, k) -> {_find(_at('p') + ' + (r.lo + r.hi) div 2')}) = n)"
    step = f"IF(r.lo >= r.hi, r, IF({feasible}, named_struct('lo', r.lo, 'hi', (r.lo + r.hi) div 2), named_struct('lo', (r.lo + r.hi) div 2 + 1, 'hi', r.hi)))"
    search = f"aggregate(sequence(1, 63), named_struct('lo', greatest(widest, (total + {shards - 1}) div {shards}), 'hi', total), (r, j) -> {step}, r -> r.lo)"
    return cells.select(F.expr(search)).first()[0]


def cut_cells(cells: DataFrame, shards: int, capacity: int) -> list[int]:
    """The hash at which each shard but the first begins; shards that nothing is left for have none. All stay within the capacity."""
    # Earliest cut k such that what follows still fits the shards after it.
    back = f"aggregate(sequence(1, {shards}), array(n), (b, k) -> concat(array(IF({_at('b[0]')} <= {capacity}L, 0L, {_find(_at('b[0]') + f' - {capacity}L - 1')} + 1)), b))"
    share = f"({_at('p')} + (total - {_at('p')}) div ({shards + 1} - k))"
    below = _find(share)
    near = f"aggregate(array({below}), 0L, (z, c) -> IF(c < n AND {_at('c + 1')} - {share} < {share} - {_at('c')}, c + 1, c))"
    # A shard takes one cell at least, so the share of a hot group leaves none empty before it.
    pick = f"greatest(least(p + 1, n), element_at(back, k + 1), least({near}, {_find(_at('p') + f' + {capacity}L')}))"
    cuts = f"aggregate(sequence(1, {shards}), array(0L), (q, k) -> concat(q, transform(slice(q, -1, 1), p -> {pick})))"
    row = cells.withColumn("back", F.expr(back)).select(F.expr(f"transform(slice({cuts}, 2, {shards - 1}), c -> IF(c >= n, NULL, element_at(ids, CAST(c + 1 AS INT))))")).first()
    return [c for c in row[0] if c is not None]


def _cells(atoms: DataFrame, total: int) -> DataFrame:
    """lo, hi, _bytes: first and last hash and bytes of each cell; a group of an even cell's bytes is one by itself."""
    atoms = atoms.withColumn("_cell", F.shiftright("_hash", 64 - CELL_BITS))
    heavy = atoms.filter(F.col("_bytes") >= max(1, -(-total // (1 << CELL_BITS))))
    # At most 2**CELL_BITS groups are as heavy as that.
    heavy = heavy.groupBy("_cell").agg(F.array_sort(F.collect_list("_hash")).alias("_heavy"))
    place = F.expr("coalesce(aggregate(_heavy, 0, (n, h) -> n + IF(h < _hash, 2, IF(h = _hash, 1, 0))), 0)")
    laid = atoms.join(F.broadcast(heavy), "_cell", "left").groupBy("_cell", place.alias("_place"))
    return laid.agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi"), F.sum("_bytes").alias("_bytes")).select("lo", "hi", "_bytes")


def _prefix(cells: DataFrame) -> DataFrame:
    """One row: first and last hashes and prefix sums of the cells, in order."""
    running = cells.withColumn("_sum", F.sum("_bytes").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)))
    got = F.sort_array(F.collect_list(F.struct("lo", "hi", "_sum")))
    return running.agg(got.alias("all"), F.coalesce(F.max("_bytes"), F.lit(0)).alias("widest")).select(
        F.transform("all", lambda x: x["lo"]).alias("ids"),
        F.transform("all", lambda x: x["hi"]).alias("ends"),
        F.concat(F.array(F.lit(0).cast("bigint")), F.transform("all", lambda x: x["_sum"])).alias("prefix"),
        F.size("all").cast("bigint").alias("n"),
        F.coalesce(F.get(F.col("all"), F.size("all") - 1)["_sum"], F.lit(0)).alias("total"),
        F.col("widest").cast("bigint").alias("widest"),
    )


def _open_cells(row: DataFrame, shards: int, least: int, most: int) -> DataFrame:
    """lo, hi of the cells of several groups in which a cut of a capacity from ``least`` to ``most`` may fall."""
    # With ``least`` no cut lies before the greedy one over cells, with ``most`` none beyond as many times its bytes.
    first = f"aggregate(sequence(1, {shards - 1}), array(0L), (q, k) -> concat(q, array({_find(_at('element_at(q, -1)') + f' + {least}L')})))"
    row = row.withColumn("first", F.expr(first))
    last = f"least(n - 1, {_find(f'k * {most}L')})"
    reach = f"flatten(transform(sequence(1, {shards - 1}), k -> IF(element_at(first, k + 1) <= {last}, sequence(element_at(first, k + 1), {last}), CAST(array() AS ARRAY<BIGINT>))))"
    named = row.select(F.expr(f"transform(array_distinct({reach}), c -> struct(element_at(ids, CAST(c + 1 AS INT)) AS lo, element_at(ends, CAST(c + 1 AS INT)) AS hi))").alias("c"))
    return named.select(F.explode("c").alias("c")).select("c.*").filter("lo < hi")


def _split(atoms: DataFrame, cells: DataFrame, marked: DataFrame) -> DataFrame:
    """The cells, those of ``marked`` in up to SPLIT parts."""
    # Few cells of 2**CELL_BITS: those around the cuts.
    wide = marked.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.expr(f"(hi - lo) div {SPLIT} + 1").alias("_step"), F.shiftright("lo", 64 - CELL_BITS).alias("_cell"))
    inside = atoms.withColumn("_cell", F.shiftright("_hash", 64 - CELL_BITS)).join(F.broadcast(wide), "_cell").filter("_hash BETWEEN _lo AND _hi")
    parts = inside.groupBy("_lo", F.expr("(_hash - _lo) div _step").alias("_at")).agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi"), F.sum("_bytes").alias("_bytes"))
    return cells.join(F.broadcast(marked.select("lo")), "lo", "left_anti").select("lo", "hi", "_bytes").union(parts.select("lo", "hi", "_bytes"))


def plan_cuts(atoms: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, hashes at which shards begin) for ``atoms``: _hash and _bytes of each group."""
    total, widest = atoms.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.max("_bytes"), F.lit(0))).first()
    bound = max(widest, -(-total // shards))
    cells = written(_cells(atoms, total), "shard-cells")
    while True:
        row = written(_prefix(cells), "shard-prefix")
        capacity = smallest_capacity(row, shards)
        if capacity > bound and shards > 1:
            marked = written(_open_cells(row, shards, bound, capacity), "shard-marked")
            if not marked.isEmpty():
                finer = written(_split(atoms, cells, marked), "shard-cells")
                discard(cells, row, marked)
                cells = finer
                continue
            discard(marked)
        cuts = cut_cells(row, shards, capacity)
        discard(cells, row)
        return capacity, cuts


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    docs = docs.drop(*(c for c in OWN if c not in (text, key)))
    hashed = {"_hash": text_order(F.col(text)), "_cell": text_cell(F.col(text)), "_part": F.pmod(F.xxhash64(key, F.lit(10)), F.lit(PARTS)).cast("int")}
    rows = docs.withColumns({"size": text_size(F.col(text)), **hashed})
    # Narrow: the texts are read for these sums and for the result only.
    counts = written(rows.groupBy("_hash", "_cell", "_part").agg(F.count("*").alias("_rows"), F.sum("size").alias("_bytes")), "shard-counts")
    atoms = written(counts.groupBy("_hash").agg(F.sum("_bytes").alias("_bytes")), "shard-groups")
    cuts = plan_cuts(atoms, shards)[1]
    discard(atoms)
    shard = sum(((F.col("_hash") >= c).cast("int") for c in cuts), F.lit(0)).alias("shard")

    # A cut may fall within a cell, so rows are numbered by cell and shard.
    parts = counts.groupBy(shard, "_cell", "_part").agg(F.sum("_rows").alias("_rows"))
    parts = written(parts, "shard-parts")
    before = lambda window: F.coalesce(F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_cell = parts.select("shard", "_cell", "_part", before(Window.partitionBy("shard", "_cell").orderBy("_part")).alias("_in_cell"))
    totals = parts.groupBy("shard", "_cell").agg(F.sum("_rows").alias("_rows"))
    in_shard = totals.select("shard", "_cell", before(Window.partitionBy("shard").orderBy("_cell")).alias("_in_shard"))
    base = in_cell.join(in_shard, ["shard", "_cell"]).select("shard", "_cell", "_part", (F.col("_in_shard") + F.col("_in_cell")).alias("_base"))
    base = written(base, "shard-bases")
    discard(counts, parts)
    placed = rows.withColumn("shard", shard)
    number = F.row_number().over(Window.partitionBy("shard", "_cell", "_part").orderBy(key, "size")) - 1
    placed = placed.withColumn("_n", number).join(base, ["shard", "_cell", "_part"])
    return placed.withColumn("slot", F.col("_base") + F.col("_n")).drop("_hash", "_cell", "_part", "_base", "_n")
