"""Near-duplicate documents: SuperMinHash, banding, verification, components (operator 8).

A text's set is its distinct 5-word shingles. Texts with equal sets are one
class, by a 128-bit fingerprint of the set; only classes go on. Signatures of
BANDS * ROWS SuperMinHash values give a key per band; a pair at the similarity
limit shares none with a chance below 1 in 10,000.

Buckets of equal keys never give all their pairs. First each member is paired
with two members of its bucket (stars), pairs are verified on full sets of
whole texts, and links are joined into components. Only then, and only in
buckets that still hold several components, members of different components
are compared, in blocks that give just the pairs that pass: whatever is not
compared is already connected, so no link between components is lost; a document
gives one link to each component that it meets. Pairs are verified by blocks of
a star's members against its centre, whose text is sent once a block.

Grouping is union-find: each task joins the links that it reads, a bounded
number of nodes at a time, and alternating large-star and small-star steps, on
tables in the shared folder, join what the tasks have found. Nothing that grows
with the corpus comes to the driver. Joins with texts are merge joins by hint,
so plans are the same at every size: lists of ids grow with the corpus and are
not broadcast.

Texts without words have an empty set and are linked with nothing. Rows with a
null doc_id are linked with nothing and have a null component. Rows that repeat
a doc_id are linked by their own texts. Very long texts are read whole. Columns
other than doc_id and text are not read by near_duplicates(); keep_one() keeps
them all. An empty table gives an empty result.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import discard, small_batches, written
from logweir.llm.quality import map_texts
from logweir.llm.shingles import WORDS, band_keys, jaccard_counts, set_fingerprint, shingle_set, superminhash

ROWS = 6
BANDS = 48
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents of a block, on average, where blocks are compared.
BLOCK = 256
#: Nodes that a task joins before it passes on what it has found.
LOCAL_NODES = 400_000


def sketch(docs: DataFrame, words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (null for empty sets) and band keys of every row."""

    def work(texts):
        sets = [shingle_set(t, words) for t in texts]
        keys = band_keys(superminhash(sets, rows * bands), rows)
        fp = [set_fingerprint(s) if len(s) else (None, None) for s in sets]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in fp], pa.int64()), pa.array([b for _, b in fp], pa.int64()), lists]

    return map_texts(docs, work, "n_shingles long, fp1 long, fp2 long, bands array<long>", ["doc_id"])


def verify(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, size: int = BLOCK) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough, on their full sets; many may share an a."""

    def check(batches):
        key, centres = None, []
        for batch in batches:
            good = []
            a, block, side, b = (batch.column(i).to_numpy() for i in range(4))
            for i, text in enumerate(batch.column(4)):
                if key != (a[i], block[i]):
                    key, centres = (a[i], block[i]), []
                own = shingle_set(text.as_py(), words)
                if side[i] == 0:  # comes first in its block; a repeated doc_id has several texts
                    centres.append(own)
                elif any(100 * both >= percent * union > 0 for both, union in (jaccard_counts(own, c) for c in centres)):
                    good.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([y for _, y in good], pa.int64())], ["a", "b"])

    # Blocks of a centre's members; most centres have one. A table, so that Spark checks its size before it joins.
    many = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("n")).filter("n > 1"), "neardup-centres")
    blocks = pairs.join(many, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("n")), F.lit(0)).cast("int").alias("block"), "b")
    centres = blocks.select("a", "block").distinct().select("a", "block", F.lit(0).alias("side"), F.col("a").alias("doc_id"))
    rows = centres.union(blocks.select("a", "block", F.lit(1), "b"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    dealt = rows.hint("merge").join(texts, "doc_id").select("a", "block", "side", "doc_id", "text")
    laid = dealt.repartition("a", "block").sortWithinPartitions("a", "block", "side")
    return small_batches(laid).mapInArrow(check, "a long, b long").distinct()


def _sizes_fit(percent: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def local_components(edges: DataFrame, most: int = LOCAL_NODES) -> DataFrame:
    """(u, v): links that join the same nodes as ``edges`` (a, b), each from a node to the least one it is joined with by its task."""

    def join(batches):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def found():
            ends = [(x, find(x)) for x in list(parent)]
            ends = [(x, r) for x, r in ends if x != r]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > most:
                yield found()
        yield found()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(join, "u long, v long")


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component), component the least node, for every node of an edge (a, b)."""
    e = written(local_components(edges.filter("a <> b")).distinct(), "components")
    last = None
    for _ in range(most):
        two = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table, so that a join with a node of very many links can be split.
        low = written(two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-low")
        large = two.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = written(pairs.filter("u <> v").distinct(), "components")
        discard(e, low)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == now:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def open_blocks(shared: DataFrame, reps: DataFrame, size: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(kind, group, i, j, id, side, label), and the tables it reads: blocks of documents of different components that share a bucket.

    A bucket's main component is its most frequent one; the others' members are
    its rest. Blocks of the rest's members meet blocks of the main component
    (side 0 against side 1), and those of the rest meet each other. A block has
    about ``size`` documents, so the rows are fewer than pairs by that factor.
    """
    in_bucket = shared.join(reps, "rep")
    per = in_bucket.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", F.negate("label").alias("m"))).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    main = main.select("key", F.negate("top.m").alias("main"), "labels")
    rest = written(in_bucket.join(main, "key").filter("label <> main").select("key", "rep", "label", "main", "labels"), "neardup-rest")
    part = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
    blocks = lambda n: F.ceil(n / F.lit(size)).cast("int")

    meets = rest.select(F.col("rep").alias("x"), "label", F.col("main").alias("group")).distinct()
    sizes = meets.groupBy("group").agg(F.count("*").alias("nx")).join(reps.groupBy(F.col("label").alias("group")).agg(F.count("*").alias("nm")), "group")
    sizes = written(sizes.select("group", blocks(F.col("nx")).alias("bx"), blocks(F.col("nm")).alias("bm")), "neardup-sizes")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = meets.join(sizes, "group").select("group", part("x", F.col("bx")).alias("i"), each(F.col("bm")).alias("j"), F.col("x").alias("id"), F.lit(0).alias("side"), "label")
    right = reps.withColumnRenamed("label", "group").join(sizes, "group").select("group", each(F.col("bx")).alias("i"), part("rep", F.col("bm")).alias("j"), F.col("rep").alias("id"), F.lit(1).alias("side"), F.col("group").alias("label"))

    # More than two components: the rest's members among themselves.
    many = rest.filter("labels > 2")
    counts = many.groupBy("key").agg(blocks(F.count("*")).alias("b"))
    own = many.select("key", "rep", "label").join(counts, "key").select(F.col("key").alias("group"), "b", "label", F.col("rep").alias("id"), part("rep", F.col("b")).alias("p"))
    among = own.withColumn("q", each(F.col("b"))).select("group", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "id", F.when(F.col("p") == F.col("q"), 2).otherwise((F.col("p") > F.col("q")).cast("int")).alias("side"), "label")
    return left.union(right).withColumn("kind", F.lit(0)).unionByName(among.withColumn("kind", F.lit(1))), [rest, sizes]


def compare_blocks(blocks: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Similar pairs (a, b) between the sides of each block, on full sets; side 2 stands on both.

    Where blocks have labels, a document gives one pair with each label that is not its own.
    """

    def compare(pdf):
        found = set()
        ids, sides = pdf["id"].to_numpy(), pdf["side"].to_numpy()
        labels = pdf["label"].to_numpy() if "label" in pdf else ids
        diagonal = pdf["i"].iloc[0] == pdf["j"].iloc[0] and pdf["kind"].iloc[0] == 1
        sets = [shingle_set(t, words) for t in pdf["text"]]
        sizes = np.array([len(s) for s in sets])
        right = np.flatnonzero(sides > 0) if not diagonal else np.arange(len(ids))
        left = np.flatnonzero(sides != 1) if not diagonal else right
        if len(left) and len(right):
            all_ = np.concatenate([sets[r] for r in right])
            owner = np.repeat(right, sizes[right])
            order = np.argsort(all_, kind="stable")
            all_, owner = all_[order], owner[order]
            for x in left.tolist():
                lo, hi = np.searchsorted(all_, sets[x], "left"), np.searchsorted(all_, sets[x], "right")
                n = hi - lo
                hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[hit], minlength=len(ids))
                near = np.flatnonzero((both > 0) & (labels != labels[x]) & (100 * both >= percent * (sizes[x] + sizes - both)))
                for y in near[np.unique(labels[near], return_index=True)[1]].tolist():
                    found.add((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    needed = blocks.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(needed.hint("merge"), "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
    return blocks.join(texts, "id").groupBy("kind", "group", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(sketch(docs), "neardup-sketch")
    known = sketches.filter("fp1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "neardup-classes")
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("c1"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n")).alias("c2")).filter("members > 1")
    shared = written(keyed.join(buckets, "key"), "neardup-buckets")
    # Stars of each bucket, from its least member and from another; a pair of two stars is checked in one.
    centers = F.explode(F.array(F.struct(F.col("c1.rep").alias("rep"), F.col("c1.n").alias("n")), F.struct(F.col("c2.rep").alias("rep"), F.col("c2.n").alias("n"))))
    stars = shared.select("rep", F.col("n").alias("n_b"), centers.alias("c")).select(F.col("c.rep").alias("a"), F.col("rep").alias("b"), F.col("c.n").alias("n_a"), "n_b")
    stars = stars.filter("a <> b").filter(_sizes_fit(percent)).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    stars = written(stars.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "neardup-stars")
    links = written(verify(stars, docs, percent=percent), "neardup-links")
    discard(stars)
    first = written(connected_components(links), "neardup-first")
    discard(links)

    # Buckets that still hold several components.
    label = F.coalesce("component", "rep")
    reps = classes.select("rep").distinct().join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", label.alias("label"))
    reps = written(reps, "neardup-labels")
    blocks, tables = open_blocks(shared.select("key", "rep"), reps)
    more = written(compare_blocks(blocks, docs, percent=percent), "neardup-more")
    discard(shared, reps, *tables)
    final = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    discard(first, more)

    groups = classes.select("fp1", "fp2", "rep", "copies").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    groups = groups.select("fp1", "fp2", "copies", "rep", F.coalesce("component", "rep").alias("component")).filter("copies > 1 OR component <> rep").drop("copies", "rep")
    rows = sketches.select("doc_id", "n_shingles", "fp1", "fp2").join(groups, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` without null doc_ids, and _id: a number of doc_id and text, in the order of doc_id."""
    rows = docs.filter("doc_id IS NOT NULL").withColumn("_hash", F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit("")))
    pairs = rows.select("doc_id", "_hash").distinct().repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    ids = written(pairs.withColumn("_id", F.monotonically_increasing_id()), "neardup-ids")
    return rows.join(ids.hint("merge"), ["doc_id", "_hash"])


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns, less all but one document of each group; a row that repeats a doc_id and its text goes too.

    Where a doc_id stands on several texts, each text is a document of its own.
    """
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():  # one pass over the texts is enough
        gone = written(near_duplicates(docs, percent), "neardup-kept").filter("NOT kept").select("doc_id")
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    rows = written(_numbered(docs), "neardup-numbered")
    gone = written(near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), percent), "neardup-kept").filter("NOT kept").select(F.col("doc_id").alias("_id"))
    rest = rows.join(gone.distinct().hint("merge"), "_id", "left_anti")
    once = Window.partitionBy("_id").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    rest = rest.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return rest.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
