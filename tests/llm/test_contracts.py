"""The registered queries by their contracts, against brute force on the smallest tables."""

import glob
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logweir.llm import packing, pii, quality, sharding, toxicity
from logweir.llm.ann import nearest
from logweir.llm.mixing import MOST, mix_documents
from logweir.llm.token_output import read_token_ids, write_token_ids
from logweir.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
#: Columns and types of the queries' contracts.
CONTRACTS = {
    "op1": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6": "query_id bigint, rank int, vec_id bigint, score double",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark):
    """Rows of a registered query, whose names and types are its contract's."""
    names = {n.split("_")[0]: f for n, f in entry.queries().items() if n.startswith("op")}

    def rows(op):
        df = names[op](spark, SF)
        kinds = dict(df.dtypes)
        for part in CONTRACTS[op].split(", "):
            name, kind = part.split()
            assert kinds[name] == kind, (op, name)
        return df.collect()

    return rows


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(text):
    from tokenizers import Tokenizer

    ids_of.tok = getattr(ids_of, "tok", None) or Tokenizer.from_file(vocabulary())
    return ids_of.tok.encode(text or "", add_special_tokens=False).ids


def test_op1(run, texts):
    at, rows = 0, sorted(run("op1"), key=lambda r: r.doc_id)
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*ids_of(texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op1_files_have_indexes_and_lookups_skip(spark, tmp_path):
    """Run-length encoded integers in several stripes, with a row index and a Bloom filter that a lookup prunes by."""
    docs = spark.range(4000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") * i) for i in range(30)]).alias("text"))
    folder = str(tmp_path / "ids")
    write_token_ids(docs.coalesce(1), folder, stripe_bytes=64 << 10)
    files = [orc.ORCFile(f) for f in glob.glob(folder + "/*.orc")]
    assert sum(f.nrows for f in files) == 4000 and all(f.row_index_stride > 0 for f in files)
    ids = [f.read_stripe(i).column("doc_id").to_pylist() for f in files for i in range(f.nstripes)]
    assert all(x == sorted(x) for x in ids) and sum(map(len, ids)) == 4000
    raw = b"".join(open(f, "rb").read() for f in glob.glob(folder + "/*.orc"))
    assert raw[:3] == b"ORC"
    one = spark.read.orc(folder).filter("doc_id = 2002")
    assert "EqualTo(doc_id,2002)" in one._jdf.queryExecution().toString() and one.count() == 1
    got = read_token_ids(spark, folder).filter("doc_id = 7998").first()
    assert list(got.ids) == [*ids_of(docs.filter("doc_id = 7998").first().text), 2]


def best_fit(lengths, capacity):
    """Rooms left by best fit in decreasing order, an item at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        at = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
        rooms[at:at + 1] = [(rooms[at] if fits else capacity) - n]
    return sorted(rooms)


def test_plan_equals_best_fit():
    r = random.Random(0)
    for _ in range(200):
        capacity = r.choice([20, 64, 100])
        counts = {r.randint(1, capacity): r.randint(1, 12) for _ in range(r.randint(1, 15))}
        plan = packing.plan_bins(counts, capacity)
        rooms = sorted(capacity - sum(n * k for n, k in pattern) for bins, pattern in plan for _ in range(bins))
        assert rooms == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def test_op2(run, texts):
    rows, by, pieces = run("op2"), {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = [*ids_of(text), 1]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(i, a, len(ids[a:a + 4096]), crc(ids[a:a + 4096])) for i, a in enumerate(range(0, len(ids), 4096))]
    for parts in by.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert sorted(4096 - sum(n for _, n in p) for p in by.values()) == best_fit([r.length for r in rows], 4096)


def test_numbered_pieces_of_any_origin(spark):
    lengths = [(i, i % 7 + 1, "x") for i in range(200)]
    pieces = packing.number_pieces(spark.createDataFrame(lengths, "doc_id long, length long, score string").repartition(5), 16)
    rows = packing.place_pieces(pieces, 16, keep=("doc_id", "score")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert len(rows) == 200 and sorted(16 - sum(x) for x in by.values()) == best_fit([n for _, n, _ in lengths], 16)


def test_op3(run, texts):
    rows = run("op3")
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in rows} == words
    assert all(0 <= r.taken <= MOST * r["size"] and sum(d.words for d in r.draws) == r.taken for r in rows)
    by = {}
    for r in rows:
        by[r.source_size, r.target] = by.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(t - n) <= 1 for (_, t), n in by.items()), by


def test_mix_shards_have_their_quotas_and_disjoint_draws(spark):
    """A document is in each shard as often as its block's draws say, and shards' draws add up to the blocks'."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"))
    rows = mix_documents(docs, shards=6).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s and r["size"]]
        passes = min(len([d for d in r.draws if d.words == r["size"]]) for r in own)
        whole = [len([d for d in r.draws if d.words == r["size"]]) for r in own]
        assert set(whole) <= {passes, passes + 1}  # a draw is of the whole block, once a pass
        assert sum(0 < d.words < r["size"] for r in own for d in r.draws) <= 1  # one document ends the part
        shares = [sum(d.words for r in own for d in r.draws if d.shard == k) for k in range(6)]
        assert sum(shares) == sum(r.taken for r in own) and max(shares) <= 2 * sum(shares) / 6


def test_op4(run, texts):
    for r in run("op4"):
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature


PLANTED = {
    "email": ["anna.smith{0} (at) mail3.example.com", "bob{0} [at] corp [dot] org", "bob.jones{0} at example dot com", "eve_{0} @ example.net"],
    "ip": ["10[.]{1}[.]0[.]1", "172 dot {1} dot 3 dot 9"],
    "card": ["4111.1111.1111.1111", "5500_0000_0000_0004", "4222222222222"],
    "phone": ["(415) 555-0{2}", "415-555-0{2}", "001 415 555 0{2}", "415.555.0{2}"],
}
DECOYS = ["we met at example. Then", "on 2024-03-15 12:30", "sum 300,400,500,600", "id 4111.1111.1111.1112", "at noon. Dot", "version 10,2,3,4", "from 1990 to 2005", "hash a3a1b97e25e5c1059743005344d08a6b", "12/345/6789"]


def test_op5(run, texts, spark):
    from test_operators import brute_spans

    for r in run("op5"):
        base = brute_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {pii.joined([s]) for s in base} <= set(r.spans.split(","))


def test_pii_planted_spans(spark, texts):
    """Written-out data planted among prose is found with a precision of 0.98 and a recall of 0.95, of each kind."""
    model, r = pii.train_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), random.Random(8)
    hosts = [t[:200] for t in texts.values() if t and not re.search("[0-9@]", t[:200])]
    found, right, wanted = {k: 0 for k in PLANTED}, {k: 0 for k in PLANTED}, {k: 0 for k in PLANTED}
    for i in range(600):
        kind = r.choice(sorted(PLANTED))
        span = r.choice(PLANTED[kind]).format(i, i % 250, f"{i % 900 + 100}")
        prose = r.choice(hosts).split(" ")
        text = " ".join([*prose[:6], "xx", span, "yy", r.choice(DECOYS), *prose[6:12]])
        want = (kind, text.index(span), text.index(span) + len(span))
        wanted[kind] += 1
        for s in pii.find_spans(text, model)[1]:
            found[s[0]] += 1
            right[s[0]] += s[:3] == want
    assert sum(right.values()) >= 0.98 * sum(found.values()), (right, found)
    assert all(right[k] >= 0.95 * wanted[k] for k in wanted), (right, wanted)


def test_pii_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i % 30, f"mail a{i % 30}@b.com {'x ' * 1000}") for i in range(300)], "doc_id long, text string")
    rows = pii.training_sample(docs, 10).collect()
    assert len(rows) == 10 and all(len(r.text) > 2000 for r in rows)


def test_op6(run, spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.embedding is not None}
    exact = {(r.query_id, r["rank"]): r for r in nearest(table, table.filter("vec_id % 20 = 0"), exact=True).collect()}
    rows = run("op6")
    for q in {r.query_id for r in rows}:
        order = sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q))[:20]
        assert [(exact[q, n + 1].vec_id) for n in range(len(order))] == [i for _, i in order]
    found = {(r.query_id, r.vec_id) for r in rows}
    assert len(found) == len(rows) == len(exact) and len(found & {(r.query_id, r.vec_id) for r in exact.values()}) >= 0.9 * len(rows)
    assert all(abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9 for r in rows)


def test_nearest_of_a_repeated_vec_id(spark):
    """A vec_id that stands on two vectors is listed once, by the nearer."""
    rows = [(0, [1.0, 0.0]), (7, [0.5, 0.1]), (7, [0.9, 0.1]), (8, [0.6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 6)) for r in nearest(df, df.filter("vec_id = 0"), k=2).orderBy("rank").collect()]
    assert got == [(7, 0.9), (8, 0.6)]


@pytest.mark.parametrize("op", ["op7", "op9"])
def test_models_give_each_document_a_score(run, texts, op):
    rows = run(op)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.3 if op == "op7" else 0.7))


def test_toxicity_scores_by_hand():
    """The score is the logistic of weighted counts of hits, found by distance to each term."""
    from test_operators import edits

    model = toxicity.ToxicModel(["loser", "moron"], ["hatef"], frozenset(["lower"]), np.array([-2.0, 3, 2, 1, 0.5, 0.5, 0.5, 0.2]))
    scorer, r = toxicity.Scorer(model), random.Random(1)
    words = ["loser", "1oser", "lower", "moron", "mroon", "hateful", "window", "table", "said", "morons"]
    for _ in range(200):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        kinds = []
        for i, w in enumerate(text.split()):
            if w in ("loser", "moron"):
                kind = 0
            elif w.startswith("hatef") and w != "hatef":
                kind = 1
            elif any(edits(w, t) <= 1 for t in model.terms) and w != "lower":
                kind = 2
            else:
                continue
            kinds.append(kind)  # a word of mention alone is no quotation
        n = [kinds.count(k) for k in range(3)]
        assert np.allclose(scorer.features(text), [1, *(float(x > 0) for x in n), *np.log1p(n), 0]), text


def test_toxicity_has_no_caps(spark):
    """More terms than any earlier cap allowed, and terms of over forty letters, are all learnt."""
    r = random.Random(2)
    terms = ["".join(r.choice("bcdfghjklmnp") for _ in range(9)) for _ in range(60)] + ["z" * 45]
    rows = [(i, f"{terms[i // 2 % 61]} and so it goes" if i % 2 else "and so it goes well") for i in range(61 * 2 * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train_toxicity(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    learnt = lambda t: t in model.terms or any(t.startswith(s) for s in model.stems)
    assert all(map(learnt, terms))


def test_quadratic_equals_dense_densities():
    """Scores by cached factors equal those by inverse covariances and determinants."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 4)), rng.normal(1.0, 2.0, size=(200, 4))])
    y = np.repeat([0, 1], [300, 200])
    model = quality._densities(x, y, 0.2, 0.05)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = 0.6 * own[0] + 0.4 * own[1]
    logs = []
    for c, prior in ((0, 0.6), (1, 0.4)):
        s = 0.8 * own[c] + 0.2 * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / 4 * np.eye(4)
        d = z - z[y == c].mean(axis=0)
        logs.append(np.log(prior) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    assert np.allclose(model.difference(x), logs[1] - logs[0])


def test_op8(run, texts):
    from test_operators import brute_components

    comp, sizes = brute_components(list(texts.items()))
    rows = run("op8")
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows} == {i: (comp[i], sizes[i], comp[i] == i) for i in texts}


def smallest(sizes, shards):
    """Least capacity with which a greedy walk needs no more than ``shards`` runs."""
    lo, hi = max(sizes, default=0), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        n, room = 1, mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def test_op10(run, texts):
    rows, by = run("op10"), {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(16)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    assert len({(r.shard, texts[r.doc_id]) for r in rows}) == len(set(texts.values()))


@pytest.mark.parametrize("bits, heavy", [(4, 0), (4, 400_000), (4, 3_000_000), (14, 3_000_000)])
def test_capacity_is_the_least_for_groups(spark, monkeypatch, bits, heavy):
    """With few cells, many groups to a cell, and a hot group: as by trying groups one after another."""
    monkeypatch.setattr(sharding, "CELL_BITS", bits)
    r = random.Random(heavy)
    groups = [(r.getrandbits(64) - (1 << 63), r.randint(1, 3000)) for _ in range(3000)] + ([(5, heavy)] if heavy else [])
    capacity, cuts = sharding.plan_cuts(spark.createDataFrame(groups, "_hash long, _bytes long"), 16)
    loads = [0] * 16
    for h, n in groups:
        loads[sum(h >= c for c in cuts)] += n
    assert capacity == smallest([n for _, n in sorted(groups)], 16) >= max(loads)
    assert bits < 14 or min(loads) > 0  # with cells enough, a hot group leaves no shard empty
