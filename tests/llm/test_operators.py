import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweir.llm import avi, packing, pii, shingles, toxicity
from logweir.llm.ann import nearest
from logweir.llm.media import analyse_media, clip_rows, encode_media
from logweir.llm.mixing import MOST, WEIGHTS, drawn_rows, mix_documents, shuffled_shards
from logweir.llm.neardup import compare_blocks, connected_components, keep_one, near_duplicates, verify
from logweir.llm.quality import features, quality
from logweir.llm.sharding import shard_documents
from logweir.llm.token_output import ids_digest, token_output
from logweir.llm.tokens import WordTokenizer, gathered, vocabulary, with_end

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _cell int, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null doc_id and columns with clashing names."""
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (4, "a b c"), (5, "a b c"), (6, long), (7, long), (None, "x y"), (8, "é日本 😀 \x00 q"), (9, None)]
    return spark.createDataFrame([(i, t, None, None if i == 5 else "s", None, 1, "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def whole_ids(text):
    from tokenizers import Tokenizer

    whole_ids.tok = getattr(whole_ids, "tok", None) or Tokenizer.from_file(vocabulary())
    return whole_ids.tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# -- 1 and 2: tokens --------------------------------------------------------------------
def test_word_tokenizer_equals_whole_text():
    w, r = WordTokenizer(vocabulary()), random.Random(5)
    letters = "aAbB'sStTreVEmlLdD019²½ªº éÉñßÆœŁ.,!?-_<|>\t\n\x0b\x1c\x85\xa0 ΣσİıÅ̊́日本­\x00😀"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(2000)] + ["<|endoftext|>a <|startoftext|> b", "<|ENDOFTEXT|>", "don't we'LL"]
    for x, got in zip(texts, w.encode([x.encode() for x in texts])):
        assert got == np.array(whole_ids(x), "<u4").tobytes(), x


def test_encode_column_of_slices_and_odd_words():
    w = WordTokenizer(vocabulary())
    texts = ["skipped", None, "", " \t\n", "\u65e5\u672c \u03a3\u03c3", "word, word; " * 500, "a" * 3000, "<|endoftext|> B"]
    ids, at = w.encode_column(pa.array(texts).slice(1))
    for x, a, b in zip(texts[1:], at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == whole_ids(x), x
    ids, at = w.encode_column(pa.array(["\u65e5\u672c"]))  # no plain word at all
    assert ids.tolist() == whole_ids("\u65e5\u672c") and at.tolist() == [0, len(ids)]
    assert w.encode_column(pa.array([], pa.string()))[1].tolist() == [0]
    got, ends = with_end(np.array([7, 8, 9], np.uint32), np.array([0, 0, 2, 3]), 2)
    assert got.tolist() == [2, 7, 8, 2, 9, 2] and ends.tolist() == [0, 1, 4, 6]


def test_gathered_keeps_rows_and_order():
    texts = ["x" * n for n in (3, 5, 40, 1, 1, 0)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(texts[a:b], pa.string())], ["doc_id", "text"]) for a, b in ((0, 2), (2, 2), (2, 7))]
    got = list(gathered(iter(batches), most=10))
    assert [x.num_rows for x in got] == [2, 1, 4]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(7))
    assert list(gathered(iter([]))) == []


def test_token_output(spark, docs, odd, none):
    got = ids_digest(token_output(docs.select("doc_id", "text")), ["doc_id", "start", "n_tokens"]).orderBy("doc_id").collect()
    at = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*whole_ids(d.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.n_ids, r.ids_crc32) == (d.doc_id, at, len(ids), len(ids), crc(ids))
        at += len(ids)
    rows = token_output(odd).collect()
    assert len(rows) == odd.count() and sum(len(r.ids) == 1 for r in rows) == 4
    assert sorted((r.start, r.n_tokens) for r in rows)[-1][0] + min(r.n_tokens for r in rows if r.start == max(x.start for x in rows)) == sum(r.n_tokens for r in rows)
    assert token_output(none).count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, odd, none):
    pieces, placed = packing.pack_documents(docs.select("doc_id", "text"))
    assert all(r.ids_crc32 == crc(r.ids) and r.length == len(r.ids) for r in pieces.collect())
    rows = placed.collect()
    total = sum(r.length for r in rows)
    assert check_packed(rows, 4096) == -(-total // 4096)
    ids = {r.doc_id: [*whole_ids(r.text), 1] for r in docs.collect()}
    for r in pieces.collect():
        assert list(r.ids) == ids[r.doc_id][r.start:r.start + r.length] and r.start == 4096 * r.piece
    assert sum(map(len, ids.values())) == total
    rows = packing.pack_documents(odd, capacity=64)[1].collect()
    check_packed(rows, 64)
    assert sum(r.length == 1 for r in rows) >= 4
    assert packing.pack_documents(none)[1].count() == 0


def test_plan_is_best_fit_and_bounded():
    r = random.Random(1)
    counts = {r.randint(1, 100): r.randint(1, 10**9) for _ in range(60)}
    plan = packing.plan_bins(counts, 100)
    used = {}
    for bins, pattern in plan:
        assert sum(n * k for n, k in pattern) <= 100
        for n, k in pattern:
            used[n] = used.get(n, 0) + bins * k
    assert used == counts and len(plan) < 500
    with pytest.raises(ValueError):
        packing.plan_bins({0: 1}, 100)


# -- 3: mixing --------------------------------------------------------------------------
def targets(sizes):
    """Water filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, free = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > MOST * sizes[s]}
        if not over:
            return out | share
        out |= {s: MOST * sizes[s] for s in over}
        free -= over


def test_mixing(docs, odd, none):
    for frame in (docs, docs.withColumn("source", F.when(F.col("doc_id") % 50 == 0, "a").when(F.col("doc_id") % 3 > 0, None).otherwise("b")), odd):
        rows = mix_documents(frame, shards=5).collect()
        assert len(rows) == frame.count()
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = {}
        for r in rows:
            assert r["size"] == words(r.text) and 0 <= r.taken <= MOST * r["size"] and r.taken == sum(d.words for d in r.draws)
            sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        for s, want in targets(sizes).items():
            own = [r for r in rows if r.source == s]
            assert all(abs(r.target - want) < 1e-6 * max(1, want) and r.source_size == sizes[s] for r in own)
            assert abs(sum(r.taken for r in own) - want) <= 1
        again = mix_documents(frame.repartition(7), shards=5).collect()
        assert sorted((r.doc_id or -1, r.taken, str(r.draws)) for r in again) == sorted((r.doc_id or -1, r.taken, str(r.draws)) for r in rows)
    assert mix_documents(none).count() == 0


def test_mix_draws_and_tree_counts(spark, docs):
    mixed = mix_documents(docs, shards=4)
    drawn = drawn_rows(mixed).collect()
    assert sum(len((r.text or "").split()) for r in drawn) == sum(r.taken for r in mixed.collect())
    by = [sum(r.shard == s for r in drawn) for s in range(4)]
    assert max(by) - min(by) <= 0.5 * max(by)
    # Three ranges a shard: whole, in order over the partitions, one shard in each.
    spark.conf.set("spark.sql.shuffle.partitions", 10)
    laid = shuffled_shards(drawn_rows(mixed), shards=4).withColumn("part", F.spark_partition_id()).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = [(r.part, r.shard, r.shuffle_key) for r in laid]
    assert order == sorted(order) and [o[1:] for o in order] == sorted((r.shard, r.shuffle_key) for r in drawn)
    assert {(r.part // 3, r.shard) for r in laid} == {(s, s) for s in range(4)} and len({r.part for r in laid}) == 12


def test_hypergeometric_law(spark):
    from logweir.llm.mixing import hypergeometric

    df = spark.range(4000).select(hypergeometric(F.lit(100), F.lit(30), F.lit(40), (F.col("id") + 0.5) / 4000.0).alias("x"))
    xs = [r.x for r in df.collect()]
    assert abs(np.mean(xs) - 12) < 0.05 and abs(np.var(xs) - 40 * 0.3 * 0.7 * 60 / 99) < 0.2
    edge = spark.range(1).select(hypergeometric(F.lit(5), F.lit(5), F.lit(3), F.lit(0.5)), hypergeometric(F.lit(5), F.lit(0), F.lit(3), F.lit(0.5))).first()
    assert tuple(edge) == (3, 0)


# -- 4: media ---------------------------------------------------------------------------
@pytest.mark.parametrize("n", [64, 128, 1024, 1088, 9024])
def test_avi_round_trip_and_generic_decoder(n):
    payload = np.random.default_rng(n).integers(0, 256, n).astype("u1").tobytes()
    film = avi.payload_to_avi(payload)
    back, facts, frames = avi.avi_to_payload(film)
    assert back == payload and facts["frames"] == len(frames)
    head, scan = avi._split_scan(facts["images"][0])
    pixels = avi._tables(head).generic(scan)
    assert (pixels[::8, ::8].ravel() == frames[0]).all()


def test_shots():
    dark, light = np.zeros(64, np.uint8), np.full(64, 200, np.uint8)
    assert avi.shots([dark] * 5 + [light] * 4) == [(0, 4), (5, 8)] and avi.shots([]) == []


def test_media(docs, odd, none):
    for frame in (docs, odd):
        rows = {}
        for r in analyse_media(encode_media(frame)).collect():
            rows.setdefault(r.doc_id, []).append(r)
        for d in frame.collect():
            raw = (d.text or "").encode()
            want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            r = rows[d.doc_id][0]
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(want), zlib.crc32(want[-64:]))
    assert clip_rows(analyse_media(encode_media(docs))).filter("end_ms <= start_ms").count() == 0
    assert analyse_media(encode_media(none)).count() == 0


# -- 5: personal data -------------------------------------------------------------------
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 14 <= len(pii.digits_of(s)) <= 19 and pii.luhn(pii.digits_of(s)),
        "phone": lambda s: 10 <= len(pii.digits_of(s)) <= 15,
    }
    return [(k, *m.span()) for k, rx in BASE.items() for m in re.finditer(rx, text or "") if ok[k](m.group())]


def test_base_rules(docs):
    r = random.Random(3)
    texts = [d.text for d in docs.collect()] + ["".join(r.choice("a1@.+- ()2.9@0é_") for _ in range(r.randint(0, 30))) for _ in range(20_000)]
    for t in texts:
        assert pii.joined(brute_spans(t)) == pii.joined(pii.base_spans(t)), t


def test_pii_operator(docs, odd, none):
    model = pii.train_pii(docs)
    rows = {r.doc_id: r for r in pii.pii_digest(docs, model).collect()}
    for d in docs.collect():
        base = brute_spans(d.text)
        spans = set(rows[d.doc_id].spans.split(",")) - {""}
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= spans and rows[d.doc_id].n_phone == sum(k == "phone" for k, _, _ in base)
        assert not brute_spans(pii.redact(d.text, model))
    assert pii.pii_digest(odd, None).count() == odd.count() and pii.train_pii(none) is None
    done = pii.redact_documents(odd, None)
    assert done.columns == odd.columns and done.filter("text IS NULL").count() == 2


def test_pii_adds_written_out_address(docs):
    model = pii.train_pii(docs)
    base, added = pii.find_spans("please write to anna.smith (at) mail3.example.com today", model)
    assert base == [] and [s[:3] for s in added] == [("email", 16, 49)]


def test_pii_adds_written_out_addresses_however_common(spark, docs):
    """What the method is to add is added on the given table, and on one that is full of it."""
    probe = "please write to anna.smith (at) mail3.example.com today"
    form = F.format_string("%s write to bob.jones%d (at) mail.example.org or call 212-555-0%d, card 4111.1111.1111.1111 ", "text", "doc_id", F.col("doc_id") % 900 + 100)
    full = docs.select("doc_id", form.alias("text"))
    for table in (docs, full):
        assert [s[0] for s in pii.find_spans(probe, pii.train_pii(table))[1]] == ["email"]
    model, rows = pii.train_pii(full), full.collect()
    added = [{t.text[s[1]:s[2]] for s in pii.find_spans(t.text, model)[1]} for t in rows]
    assert sum(f"bob.jones{t.doc_id} (at) mail.example.org" in a for t, a in zip(rows, added)) >= 0.9 * len(rows)
    assert sum("4111.1111.1111.1111" in a for a in added) >= 0.9 * len(rows)


def test_pii_proposals_without_labels():
    """Proposals whose form could be personal data are no negatives; those that fail their check are."""
    for good in ("anna (at) mail.example.com", "212-555-0100", "4111.1111.1111.1111", "10[.]0[.]0[.]1"):
        assert [y for x, y in pii.training_spans(f"see {good} now") if y == 0 and x[5] + x[4] >= 12] == [], good
    for bad, kind in (("met at noon. Then", 0), ("300,400,500,600", 1), ("4111.1111.1111.1112", 2), ("12/345/6789", 3)):
        assert any(y == 0 and x[kind] and x[4] == len(bad) for x, y in pii.training_spans(f"we {bad}")), bad


# -- 6: nearest neighbours --------------------------------------------------------------
def test_nearest_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [1.0]), (1004, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    y = x.astype(float)
    found = total = 0
    for q in range(0, 600, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r.score - float(y[q] @ y[r.vec_id])) < 1e-9 for r in own)
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(s, 9)))[:20]
        found, total = found + len(set(want) & {r.vec_id for r in own}), total + 20
    assert found / total >= 0.9 and len(got) == 600
    few = nearest(df.filter("vec_id < 5"), df.filter("vec_id = 0"), k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_repeated_rows_hide_no_equal_vectors(spark):
    x = np.random.default_rng(1).normal(size=(60, 16)).astype(np.float32)
    x[1:10] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[1].tolist())] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for exact in (False, True):
        got = nearest(df, df.filter("vec_id = 1"), k=5, exact=exact).collect()
        assert sorted((r["rank"], r.vec_id) for r in got) == [(i, i + 1) for i in range(1, 6)]


# -- 7 and 9: models --------------------------------------------------------------------
def edits(a, b):
    """Restricted Damerau-Levenshtein distance."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    terms, r = ["idiot", "worthless", "scum", "moron"], random.Random(2)
    auto = toxicity.TermAutomaton(terms, ["lowei"])
    for _ in range(4000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            w[i:i + r.randint(0, 1)] = r.choice(["", "x", "i", "o"])
        w = "".join(w)
        near = [t for t in terms if edits(w, t) <= toxicity.allowed(t)]
        got = auto.match(w)
        assert bool(got) == bool(near), (w, got, near)
    assert auto.match("loweient") == ("stem", "lowei") and auto.match("lowei") is None and auto.match("idoit") == ("near", "idiot")


def test_edits_at_every_position():
    terms = ["idiot", "worthless", "scum"]
    auto = toxicity.TermAutomaton(terms, [])
    for t in terms:
        for i in range(len(t)):
            for w in {t[:i] + "1" + t[i + 1:], t[:i] + t[i + 1:], t[:i] + "x" + t[i:], t[:i] + t[i:i + 2][::-1] + t[i + 2:]} - {t}:
                assert auto.match(w) == ("near", t), w
    assert auto.match("cat") is None and auto.match("3dio7") is None


def test_common_clean_words_near_a_term(spark):
    """Clean words next to a term are no hits; its other near words are."""
    rows = [(i, f"you are such a loser and i mean it {i}" if i % 2 else f"put it on the lower shelf beside window {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert "loser" in model.terms and "lower" in model.spellings
    s = toxicity.Scorer(model)
    assert [s.hits(w) for w in ("lower", "shelf")] == [[], []]
    assert [s.hits(w)[0][:2] for w in ("lozer", "1oser", "looser", "oser")] == [("near", "loser")] * 4


def test_quotation_scores_less():
    model = toxicity.ToxicModel(["idiot"], [], weights=np.array([-3.0, 3, 1, 1, 1, 1, 1, 0.1]))
    s = toxicity.Scorer(model)
    abuse, quoted = s.features("you are an idiot today"), s.features('he said the word "an idiot here" and left')
    assert abuse[1] == 1 and quoted[1] == 0 and quoted[7] > 0


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for operator, target, least in ((quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.95)):
        rows = operator(docs, labels, ["doc_id"]).join(labels, "doc_id").filter("held_out").collect()
        assert len(rows) > 500 and np.mean([r.predicted == r[target] for r in rows]) >= least
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("operator", [quality, toxicity.toxicity])
def test_models_on_odd_rows(spark, odd, none, operator):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert operator(odd, labels, ["doc_id"]).count() == odd.count()
    assert operator(odd, labels.limit(0), ["doc_id"]).count() == odd.count()
    assert operator(none, labels, ["doc_id"]).count() == 0
    assert len(features("x" * 100_000)) == len(features(None))


# -- 8: near duplicates -----------------------------------------------------------------
def brute_components(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark, docs, odd, none):
    r = random.Random(4)
    base = [r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 99)) for _ in range(120)]
    near = []
    for i in range(150):  # a family around the limit
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 999)}"
        near.append((10_000 + i, " ".join(w)))
    rows = [(d.doc_id, d.text) for d in docs.collect()] + near
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    comp, sizes = brute_components(rows)
    assert {x.doc_id: x.component_id for x in got} == comp and {x.doc_id: x.n_shingles for x in got} == sizes
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    out = near_duplicates(odd).collect()
    assert len(out) == odd.count() and {x.component_id for x in out if x.doc_id in (1, 2, 3)} == {1, 2, 3}
    assert {x.component_id for x in out if x.doc_id in (6, 7)} == {6} and all(x.kept for x in out if x.doc_id is None)
    kept = keep_one(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]
    assert near_duplicates(none).count() == 0


def test_texts_of_a_repeated_id_are_told_apart(spark):
    """Equal id, length and opening: a pair is confirmed on its own text."""
    head = "the same opening words stand at the head of each of these texts "
    a, b = head + " ".join(f"x{i:03d}" for i in range(300)), head + " ".join(f"y{i:03d}" for i in range(300))
    assert len(a) == len(b)
    docs = spark.createDataFrame([(1, b), (1, a), (2, a)], "doc_id long, text string").coalesce(1)
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert verify(pairs, docs).count() == 1
    assert verify(pairs, docs.orderBy(F.desc("text"))).count() == 1


def test_keep_one_decides_by_text(spark):
    """A clean text stays, whichever other text its doc_id also stands on."""
    a, near, clean = (" ".join(f"{c}{i}" for i in range(60)) for c in "aac")
    near += " end"
    for copy in (a, near):
        rows = [(3, a, "s"), (5, copy, "s"), (5, clean, "t"), (5, clean, "t"), (None, a, "n"), (7, "", "e"), (7, None, "e")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, _h string")
        got = sorted(((r.doc_id or 0, r.text or "", r._h) for r in keep_one(docs).collect()))
        assert got == sorted([(0, a, "n"), (3, a, "s"), (5, clean, "t"), (7, "", "e"), (7, "", "e")])


def test_blocks_find_all_pairs(spark):
    texts = {i: f"a b c d e f g h {'x' if i % 3 else 'y'}" for i in range(12)}
    df = spark.createDataFrame([(0, 0, 0, 0, i, 2) for i in texts], "kind int, group long, i int, j int, id long, side int")
    pairs = compare_blocks(df.withColumn("kind", F.lit(1)), spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(p.a, p.b) for p in pairs} == {(a, b) for a in texts for b in texts if a < b and texts[a] == texts[b]}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_long_texts_hash_alike_in_parts(monkeypatch):
    """Slices and parts of sets change memory, not hashes or signatures; words longer than a slice stay whole."""
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcXYZé"), r.integers(1, 30))) for _ in range(700)] + ["w" * 900, "Z"]
    for text in (" ".join(words), "\n\t " * 40 + "  ".join(words) + " " * 300, "w" * 500, " " * 500, ""):
        raw = text.encode()
        whole = shingles.word_hashes(raw, 1 << 20)
        assert len(whole) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert all((shingles.word_hashes(raw, n) == whole).all() for n in (1, 7, 64, 1000))
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 0, 950, 40, 301)]
    whole = shingles.superminhash(sets, 48)
    monkeypatch.setattr(shingles, "ELEMENTS", 100)
    assert (shingles.superminhash(sets, 48) == whole).all()


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = x[:300], x[100:]
    g = shingles.superminhash([a, b, x[:0]], 288)
    both, union = shingles.jaccard_counts(a, b)
    assert abs((g[0] == g[1]).mean() - both / union) < 0.1 and (g[2] == np.iinfo(np.uint64).max).all()


# -- 10: sharding -----------------------------------------------------------------------
def smallest(sizes, shards):
    lo, hi = max(sizes, default=0), sum(sizes)
    while lo < hi:
        mid, n, room = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def test_sharding(spark, docs, odd, none):
    from logweir.llm.sharding import text_cell, text_size

    hot = spark.createDataFrame([(i, "same text") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(500)], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), hot):
        rows = shard_documents(frame).collect()
        assert len(rows) == frame.count()
        by, of = {}, {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
            assert of.setdefault(r.text, r.shard) == r.shard and r["size"] == len((r.text or "").encode()) + 1
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        cells = frame.groupBy(text_cell(F.col("text")).alias("c")).agg(F.sum(text_size(F.col("text"))).alias("b")).orderBy("c").collect()
        assert max(sum(r["size"] for r in own) for own in by.values()) <= smallest([c.b for c in cells], 16)
        assert set(by) <= set(range(16))
    out = shard_documents(odd, 3).collect()
    assert len(out) == odd.count() and len({r.shard for r in out if r.text is None}) == 1
    assert shard_documents(none).count() == 0
