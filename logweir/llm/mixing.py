"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 3, native).

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and
share all words; a target stops at three times its source's words and the
excess is shared again by weight (water filling, in one ordered pass).

A source's documents fall into BLOCKS hash blocks, by doc_id and text. A target
is whole passes over the source plus a part of one more pass, taken block by
block in a permuted order. The block in which the part ends is split again into
BLOCKS by further bits of the hash, and only in the one of these where it ends
are documents put in order (some rows in a million of a source); the last may be
taken in part, so a source's words meet its target to the word. All other rows
are decided by their block alone, without a shuffle. Each (pass, block) is a
draw. A tree over the output shards splits the exact number of draws of each
source: at a node, the left half's counts are drawn from the multivariate
hypergeometric law, the right half has the rest. Leaves then take disjoint runs
of each source's permuted draws. The tree and the targets are one task: they
grow with sources and shards, not with documents.

All randomness is a hash of the seed, ids and texts, so reruns agree. Null texts
and empty ones have no words and are not taken; a null source is a source; an
empty table gives an empty result; repeated rows are taken separately, but share
a block. Equal hashes are ordered by key and size. Very long texts are read
whole. Input columns with a name of OWN are left out: the operator's take their
place.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import discard, word_count, written

BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
#: Rows (sources times blocks) up to which a plan is broadcast; a larger one is joined by its keys.
PLAN_ROWS = 200_000
OWN = ("size", "source_size", "target", "taken", "draws", "passes", "rest", "_hash", "_size", "_block", "_source", "_before", "_base", "_part", "_words", "_shards", "_p_source", "_p_block", "_sub_base", "_p_sub")
WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(blocks: DataFrame) -> DataFrame:
    """source, source_size, target and idx (its place in code-point order) from per-block words."""
    sizes = blocks.groupBy("source").agg(F.sum("_words").alias("source_size"))
    idx = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("idx", idx).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "idx")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = ranked.withColumns({"_total": total, "_before": before, "_onward": onward})
    # In order of cap by weight, capped sources come first.
    marked = marked.withColumn("_capped", (F.col("_total") - F.col("_before")) * F.col("_w") >= F.col("_cap") * F.col("_onward"))
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), left * F.col("_w") / free))
    return marked.withColumn("target", target).select("source", "source_size", "target", "idx")


def _bind(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _walk(start: str, count: str, sign: str) -> str:
    """SQL of a walk from the mode m: weights w and their sum s; x is the first value at which the sum reaches the goal."""
    weight = lambda x: f"(r.k - {x}) * (r.d - {x}) / (({x} + 1) * (r.n - r.k - r.d + {x} + 1))"  # noqa: E731  that of x + 1 by that of x
    w = f"a.w * ({weight('(m + i)')})" if sign == "+" else f"a.w / ({weight('(m - i - 1)')})"
    step = f"named_struct('w', v, 's', a.s + v, 'x', IF(a.x IS NULL AND a.s + v >= a.goal, m {sign} i {sign} 1, a.x), 'goal', a.goal)"
    return f"aggregate(slice(sequence(0L, {count}), 1, CAST({count} AS INT)), {start}, (a, i) -> {_bind(w, 'v', step)})"


def _hypergeometric() -> str:
    """SQL of a draw for p, a struct of doubles n, k, d and u."""
    acc = lambda s, x, goal: f"named_struct('w', 1D, 's', {s}, 'x', CAST({x} AS DOUBLE), 'goal', {goal})"
    up = "CAST(greatest(0D, least(r.high, m + r.spread) - m) AS BIGINT)"
    down = "CAST(greatest(0D, m - greatest(r.low, m - r.spread)) AS BIGINT)"
    never = "CAST('Infinity' AS DOUBLE)"
    total = _walk(acc(_walk(acc("1D", "NULL", never), up, "+") + ".s", "NULL", never), down, "-") + ".s"
    first = _walk(acc("1D", "IF(g <= 1D, m, NULL)", "g"), up, "+")
    last = _bind(first, "z", _walk(acc("z.s", "z.x", "z.goal"), down, "-") + ".x")
    drawn = f"coalesce({_bind(f'r.u * {total}', 'g', last)}, m)"
    mode = "least(r.high, greatest(r.low, CAST(floor((r.d + 1) * (r.k + 1) / (r.n + 2)) AS DOUBLE)))"
    spread = "CAST(ceil(sqrt(greatest(0D, p.d * p.k / p.n * (1 - p.k / p.n))) * 12) AS DOUBLE) + 8"
    ranged = f"named_struct('n', p.n, 'k', p.k, 'd', p.d, 'u', p.u, 'low', greatest(0D, p.d - (p.n - p.k)), 'high', least(p.k, p.d), 'spread', {spread})"
    inner = _bind(ranged, "r", f"IF(r.low >= r.high, r.low, {_bind(mode, 'm', drawn)})")
    return f"CAST(IF(p.n <= 0 OR p.k <= 0 OR p.d <= 0, 0D, {inner}) AS BIGINT)"


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """One hypergeometric draw by inversion of ``u``, outward from the mode to 12 standard deviations."""
    given = F.struct(*(c.cast("double").alias(n) for c, n in ((population, "n"), (marked, "k"), (drawn, "d"), (u, "u"))))
    return F.call_function("transform", F.array(given), F.expr(f"p -> {_hypergeometric()}"))[0]


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, quotas): the tree's leaves. ``quotas`` is one row with an array of draw counts by source."""
    given = f"named_struct('n', CAST(acc.n AS DOUBLE), 'k', CAST(q AS DOUBLE), 'd', CAST(acc.d AS DOUBLE), 'u', CAST(pmod(xxhash64({seed}, 'split', lo, hi, size(acc.out)), {1 << 53}) AS DOUBLE) / {float(1 << 53)}D)"
    draw = _bind(_bind(given, "p", _hypergeometric()), "x", "named_struct('n', acc.n - q, 'd', acc.d - x, 'out', concat(acc.out, array(x)))")
    start = "named_struct('n', total, 'd', total * ((hi - lo) div 2) div (hi - lo), 'out', CAST(array() AS ARRAY<BIGINT>))"
    nodes = quotas.selectExpr("0 AS lo", f"{shards} AS hi", "quotas")
    for _ in range(max(1, (shards - 1).bit_length())):
        nodes = nodes.selectExpr("*", "aggregate(quotas, 0L, (a, q) -> a + q) AS total", "CAST(lo + (hi - lo) div 2 AS INT) AS mid")
        nodes = nodes.selectExpr("*", f"aggregate(quotas, {start}, (acc, q) -> {draw}, acc -> acc.out) AS left")
        halves = "array(struct(lo, mid AS hi, left AS quotas), struct(mid AS lo, hi, zip_with(quotas, left, (q, x) -> q - x) AS quotas))"
        nodes = nodes.selectExpr(f"explode(IF(hi - lo < 2, array(struct(lo, hi, quotas)), {halves})) AS x").select("x.*")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def plan_mix(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per (_p_source, _p_block): words, source_size, target, passes, the words left for the part pass, shards of its draws."""
    targets = written(source_targets(blocks), "mix-targets")
    want = F.floor("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.call_function("div", want, F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goals = targets.withColumn("passes", passes).withColumn("rest", want - F.col("passes") * F.col("source_size"))
    mixed = blocks.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "source_size", "target", "idx", "passes", "rest")
    order = Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed), F.lit("part"), "idx", "_block"), "_block")
    base = F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = mixed.withColumn("_base", base)
    has_words = F.col("_words") > 0
    count = F.when(has_words, F.col("passes") + (F.col("_base") < F.col("rest")).cast("int")).otherwise(F.lit(0))
    laid = written(laid.withColumn("_draws", count), "mix-blocks")
    per_source = laid.groupBy("idx").agg(F.sum("_draws").cast("bigint").alias("q"))
    quotas = per_source.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "q"))), lambda x: x["q"]).alias("quotas"))
    leaves = split_quotas(quotas, shards, seed).select("shard", F.posexplode("quotas").alias("idx", "q"))
    ends = leaves.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "q"))), lambda x: x["q"]).alias("by_shard"))
    ends = written(ends, "mix-leaves")
    draws = laid.filter("_draws > 0").select("idx", "_block", F.explode(F.sequence(F.lit(1), F.col("_draws"))).alias("_pass"))
    rank = F.row_number().over(Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed), F.lit("draw"), "idx", "_block", "_pass"), "_block", "_pass")) - 1
    # The leaf whose run of the source's permuted draws holds this rank.
    step = F.aggregate("by_shard", F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("at")), lambda a, q: F.struct((a["end"] + q).alias("end"), (a["at"] + (a["end"] + q <= F.col("_rank")).cast("int")).alias("at")), lambda a: a["at"])
    dealt = draws.withColumn("_rank", rank.cast("bigint")).join(ends, "idx").withColumn("shard", step)
    dealt = dealt.groupBy("idx", "_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pass", "shard"))), lambda x: x["shard"]).alias("_shards"))
    plan = written(laid.join(dealt, ["idx", "_block"], "left").drop("idx", "_draws").withColumnsRenamed({"source": "_p_source", "_block": "_p_block"}), "mix-plan")
    discard(targets, laid, ends)
    return plan


def _checked(plan: DataFrame) -> DataFrame:
    """A written plan, broadcast if its rows are few enough."""
    return F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 3, source: str = "source", text: str = "text", key: str = "doc_id", size: str | None = None, ident: str | None = None) -> DataFrame:
    """All rows and columns with size, source_size, target, taken and ``draws``, an array of (shard, words).

    ``size`` and ``ident`` name columns with word counts and hashes of key and text, where these are known already.
    """
    words = F.col(size) if size else word_count(F.col(text))
    hashed = F.col(ident) if ident else F.xxhash64(key, F.col(text).cast("string"))
    block = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_hash"), 64 - BLOCK_BITS).cast("int")
    sub = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_hash"), 64 - 2 * BLOCK_BITS).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")
    known = {"_mixed_hash": hashed, **({"_mixed_size": words} if size else {})}
    clean = docs.withColumns(known).drop(*(c for c in OWN if c not in (source, text, key)))
    rows = clean.withColumnsRenamed({"_mixed_hash": "_hash", "_mixed_size": "_size"}).withColumns({"_block": block, "_source": F.col(source)})
    measure = F.col("_size") if size else words
    sums = written(rows.groupBy(F.col("_source").alias("source"), "_block").agg(F.sum(measure).alias("_words")), "mix-words")
    plan = plan_mix(sums, shards, seed)
    # The block of each source in which its part ends, split again: one row a source.
    ends = plan.filter("_words > 0 AND _base < rest AND rest < _base + _words").select("_p_source", "_p_block", "_base", "rest")
    same = F.col("_source").eqNullSafe(F.col("_p_source")) & (F.col("_block") == F.col("_p_block"))
    inside = rows.join(_checked(ends), same).groupBy("_p_source", sub.alias("_p_sub")).agg(F.sum(measure).alias("_w"), F.first("_base").alias("_base"), F.first("rest").alias("rest"))
    order = Window.partitionBy("_p_source").orderBy("_p_sub").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_sub_base", F.col("_base") + F.coalesce(F.sum("_w").over(order), F.lit(0)))
    subs = inside.filter("_sub_base < rest AND rest <= _sub_base + _w").select("_p_source", "_p_sub", "_sub_base")
    subs = subs.withColumnRenamed("_p_source", "_s").join(plan, F.col("_s").eqNullSafe(F.col("_p_source")) & (F.col("_words") > 0) & (F.col("_base") < F.col("rest")) & (F.col("rest") < F.col("_base") + F.col("_words")), "right").drop("_s", "_words")
    plan2 = written(subs, "mix-parts")

    got = rows.join(_checked(plan2), same)
    edge = F.col("_p_sub").isNotNull() & (F.col("_p_sub") == sub)
    calm = got.filter(~edge).withColumn("size", measure)
    whole = (F.col("_base") < F.col("rest")) & (F.col("_p_sub").isNull() | (sub < F.col("_p_sub")))
    calm = calm.withColumn("_part", F.when(whole, F.col("size")).otherwise(F.lit(0)).cast("bigint"))
    ordered = got.filter(edge).withColumn("size", measure)
    within = Window.partitionBy("_source").orderBy("_hash", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    ordered = ordered.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_sub_base") - F.col("_before"))).cast("bigint")).drop("_before")
    got = calm.unionByName(ordered).withColumn("taken", F.col("passes") * F.col("size") + F.col("_part"))
    parts = F.transform("_shards", lambda s, i: F.struct(s.alias("shard"), F.when(i < F.col("passes"), F.col("size")).otherwise(F.col("_part")).alias("words")))
    draws = F.filter(F.coalesce(parts, F.array().cast("array<struct<shard:int,words:bigint>>")), lambda d: d["words"] > 0)
    discard(sums, plan)
    return got.withColumn("draws", draws).drop("_hash", "_size", "_block", "_p_block", "_p_source", "_source", "_base", "_part", "_shards", "_sub_base", "_p_sub", "passes", "rest")


def drawn_rows(mixed: DataFrame, text: str = "text", seed: int = 3, key: str = "doc_id") -> DataFrame:
    """One row per draw with ``shard`` and ``shuffle_key``; a draw in part keeps its first words, spaces as they were.

    shuffled_shards() brings the rows into their shards, in shuffled order.
    """
    each = mixed.withColumn("_draw", F.explode("draws"))
    space = "[ \\t\\n\\x0B\\f\\r]"
    pieces = F.split(F.col(text), f"(?<=[^ \\t\\n\\x0B\\f\\r])(?={space})")
    cut = F.when(F.col("_draw.words") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("_draw.words").cast("int")), "")).otherwise(F.col(text))
    out = each.withColumns({text: cut, "shard": F.col("_draw.shard"), "shuffle_key": F.xxhash64(F.lit(seed), F.col(key), "_draw")})
    return out.drop("_draw")


def shuffled_shards(drawn: DataFrame, shards: int = 16) -> DataFrame:
    """Rows of drawn_rows() in the order of shard and shuffle_key, each shard in equal ranges of shuffle_key.

    Keys are uniform, so the ranges are known and no sample of the rows is drawn to find them. A partition holds rows
    of one shard; there are at least as many as spark.sql.shuffle.partitions.
    """
    conf = drawn.sparkSession.conf
    parts = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(1, -(-parts // shards)), 1 << 16)
    # The upper half of the key, from 0 on.
    place = F.shiftright((F.shiftright("shuffle_key", 32) + F.lit(1 << 31)) * F.lit(ranges), 32)
    part = (F.col("shard") * F.lit(ranges) + place).cast("int")
    return drawn.repartitionById(shards * ranges, part).sortWithinPartitions("shard", "shuffle_key")
