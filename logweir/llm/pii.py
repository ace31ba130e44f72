"""Personal data by candidate gradient boosting (operator 5).

Base rules find e-mail addresses, IP addresses, card and phone numbers, each
leftmost and without overlap within its kind; matches that fail their check
are dropped. Generators of high recall propose further, overlapping spans of
these kinds: written-out addresses, other separators, numbers without a plus
sign. Boosted trees score a proposal by its form and its context; a calibrated
threshold selects. Base spans always stay; an added span never meets one.

There are no labels of spans, so trees learn from the rules on a bounded
sample (``limit`` documents in hash order, the first ``spans`` training spans of
each): checked base spans, and the same written in the proposals' forms, against
matches and proposals that fail their check and altered spans. Where few texts
hold base spans, made-up values of one kind, put between words of each sampled
document, stand for them. A proposal whose form could be personal data has no
label: neither it nor what fails a check and meets it is learnt from, so forms
that are common in a corpus are not shut out. Each kind has its own threshold:
the least at which proposals of documents that the trees had not learnt from
(three folds by whole documents) have a precision of 0.98.

Whole texts are read. Null and empty texts have no spans, very long ones are
scanned in linear time, repeated rows and doc_ids are rows of their own. Of
overlapping proposals the highest score stays, then the leftmost, then the
shortest. An empty table gives an empty result and no model; without a model
nothing is added. Input columns whose names clash with an output's are kept by
redact_documents() only, which adds none.
"""

import hashlib
import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import discard, written
from logweir.llm.quality import map_texts

KINDS = ("email", "ip", "card", "phone")
TRAINING_DOCS = 4_000
#: Most training spans of one document.
TRAINING_SPANS = 200
#: Values made up for a sample: one for each document at least, and up to 16 where there are few documents.
MADE_UP = 1_000
PRECISION = 0.98
SPAN = "struct<kind: string, start: int, end: int, score: double>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches of the e-mail rule: from each @ back over its local part and on over its domain."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1  # no later local part reaches over this @
        at = text.find("@", max(at + 1, last))


def ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))


def phones(text: str):
    for run in _PHONE_RUN.finditer(text):
        end = run.end()
        while text[end - 1] in " ().-":
            end -= 1
        if end - run.start() >= 4 or _PHONE.fullmatch(text, run.start(), end):
            yield run.start(), end


def rule_matches(text: str | None):
    """(kind, start, end, passes) of every match of the base rules."""
    if not text:
        return
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b, True
    for m in _IP.finditer(text):
        yield "ip", *m.span(), ip_ok(m.group())
    for m in _CARD.finditer(text):
        n = digits_of(m.group()) if m.end() - m.start() <= 40 else ""
        yield "card", *m.span(), 14 <= len(n) <= 19 and luhn(n)
    if "+" in text:
        for a, b in phones(text):
            yield "phone", a, b, 10 <= len(digits_of(text[a:b])) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k, a, b, ok in rule_matches(text) if ok]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


# -- proposals --------------------------------------------------------------------------
_WORDY_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s(?:at|AT)\s|\s@\s?|@\s", re.A)
_WORDY_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}$", re.A)
_WORDY_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>]|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,5}", re.A)
_DOMAIN_END = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z]{2,}$", re.A)
_SENTENCE_END = re.compile(r"[A-Za-z0-9]\.\s", re.A)
#: A number that is part of a longer one.
_GOES_ON = re.compile(r"[.,/_-][0-9]|\s[0-9]{3}", re.A)
_COMES_FROM = re.compile(r"(?:[0-9][.,/_-]|[0-9]{3}\s)$", re.A)
#: A sign that is spelt out or set in brackets.
_SPELT = re.compile(r"[\[({<]\s?(?:at|dot|\.)\s?[\])}>]|\sdot\s", re.A)
_WORDY_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\sdot\s|,|:)\s?[0-9]{1,3}){3}(?![0-9])", re.A)
_OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ._/-]{1,2}[0-9]{2,7}){1,5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])", re.A)
_OTHER_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,5}(?![0-9])", re.A)


def proposals(text: str | None) -> list[tuple[str, int, int]]:
    """Overlapping spans that the base rules may miss."""
    if not text:
        return []
    out = []
    for m in _WORDY_AT.finditer(text):
        left = _WORDY_LEFT.search(text, max(0, m.start() - 64), m.start())
        right = _WORDY_RIGHT.match(text, m.end())
        if left and right:
            out.append(("email", left.start(), right.end()))
    if any(c in text for c in "0123456789"):
        for kind, rx in (("ip", _WORDY_IP), ("card", _OTHER_CARD), ("phone", _OTHER_PHONE)):
            out += [(kind, *m.span()) for m in rx.finditer(text)]
    return out


def form_ok(text: str, kind: str, a: int, b: int) -> bool:
    """Whether a proposal's form could be personal data: domain, octets, check digit or number of digits."""
    s = text[a:b]
    n = digits_of(s)
    if kind != "email" and (text[a - 1:a].isalpha() or text[b:b + 1].isalpha()):
        return False  # part of a longer token
    if kind == "email":
        return bool(_DOMAIN_END.search(s)) and not _SENTENCE_END.search(s)
    if kind != "card" and (_GOES_ON.match(text, b) or _COMES_FROM.search(text, max(0, a - 4), a)):
        return False
    if kind == "ip":
        return all(int(g) <= 255 for g in re.findall(r"[0-9]+", s))
    if kind == "card":
        return 13 <= len(n) <= 19 and luhn(n)
    return 10 <= len(n) <= 15


def clear_of(text, base, spans):
    """The spans that meet no base span, and a map of the characters that base spans hold."""
    if not spans:
        return [], None
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\x01" * (b - a)
    return [s for s in spans if 1 not in taken[s[1]:s[2]]], taken


#: Ends of domain names, fixed values; besides, any two letters may be a country.
_ENDS = frozenset("com org net edu gov mil int info biz io dev app name".split())
_HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}


def span_features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Form of a span and the 24 characters on either side."""
    s, left, right = text[a:b], text[max(0, a - 24):a].lower(), text[b:b + 24].lower()
    n = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    seps = set(re.findall(r"[^A-Za-z0-9]", s))
    tail = re.split(r"[^A-Za-z]+", s)[-1].lower()
    lengths = [len(g) for g in groups]
    return [
        *[float(kind == k) for k in KINDS],
        float(len(s)),
        float(len(n)),
        float(len(groups)),
        float(len(seps)),
        float(luhn(n)) if 12 <= len(n) <= 19 else 0.0,
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(kind == "email" and (tail in _ENDS or len(tail) == 2)),
        float(sum(c.isalpha() for c in s)) / max(1, len(s)),
        float("." in s),
        float(any(c in s for c in "()[]{}<>")),
        float(max(lengths, default=0)),
        float(min(lengths, default=0)),
        float(any(h in left for h in _HINTS[kind])),
        float(bool(left) and (left[-1].isalnum() or left[-1] in "=.-_/#$")),
        float(bool(right) and (right[0].isalnum() or right[0] in "=.-_/%")),
        float(n.startswith("00") or s.startswith("+")),
        float(n[:1] in "3456" if n else False),
        float(len(set(n)) / max(1, len(n))),
        float(form_ok(text, kind, a, b)),
        float(lengths[0] if lengths else 0),
        float(lengths[-1] if lengths else 0),
        float(len(_SPELT.findall(s))),
        float(lengths[-3:] in ([3, 3, 4], [3, 4, 4], [2, 4, 4])),
    ]


N_MORE = len(span_features("", "card", 0, 0)) - len(KINDS)


# -- boosted trees ----------------------------------------------------------------------
DEPTH = 3


@dataclass
class BoostedTrees:
    """Trees of DEPTH levels on the logistic loss: each is (features, cuts) of its nodes by level, and leaf values."""

    trees: list
    prior: float
    thresholds: dict = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            out += leaves[at - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _best_splits(bins, at, nodes, g, h, cuts):
    """For each of ``nodes`` nodes the feature and cut of the largest gain of second order; an infinite cut if none gains."""
    best, feature, cut = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, np.inf)
    for f, places in enumerate(cuts):
        key = at * (len(places) + 1) + bins[f]
        above = (np.bincount(key, w, nodes * (len(places) + 1)).reshape(nodes, -1)[:, ::-1].cumsum(axis=1)[:, ::-1] for w in (g, h))
        (gs, gt), (hs, ht) = ((a[:, 1:], a[:, :1]) for a in above)
        gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
        top = gain.argmax(axis=1)
        more = gain[np.arange(nodes), top]
        won = more > best
        best[won], feature[won], cut[won] = more[won], f, places[top[won]]
    return feature, cut


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> BoostedTrees:
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = BoostedTrees([], float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 24), method="lower")) for c in x.T]
    bins = [np.searchsorted(at, c, side="left") for at, c in zip(cuts, x.T)]
    raw, row = np.full(len(x), model.prior), np.arange(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        g, h = y - p, p * (1 - p)
        feature, cut, at = np.empty(0, np.int64), np.empty(0), np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            own, where = _best_splits(bins, at, 2 ** level, g, h, cuts)
            feature, cut = np.append(feature, own), np.append(cut, where)
            at = 2 * at + (x[row, own[at]] > where[at])
        leaves = rate * np.bincount(at, g, 2 ** DEPTH) / (np.bincount(at, h, 2 ** DEPTH) + 1)
        model.trees.append((feature, cut, leaves))
        raw += leaves[at]
    return model


def calibrate(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score, 0.5 at least, from which on ``precision`` of the spans are right; over 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(p[order]) != 0, True)  # spans of one score are taken together
    good = np.flatnonzero((share >= precision) & last)
    return max(0.5, float(p[order][good[-1]])) if len(good) else 1.1


def _forms(kind: str, s: str) -> list[tuple[str, int]]:
    """A base span in the proposals' forms, with labels: rewritten is personal data, altered is not."""
    n = digits_of(s)
    if kind == "email":
        name, _, host = s.partition("@")
        first, _, rest = host.partition(".")
        good = [f"{name} (at) {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}", f"{name} @ {host}", f"{name} at {host}"]
        bad = [f"{name[:3]} at {first}. {name[:4].title()}", f"{name[:3]} at {first}.{first}", f"{name[:3]} at {rest[:3]}. {first}"]
    elif kind == "ip":
        good = [s.replace(".", "[.]"), s.replace(".", " dot "), s.replace(".", "(.)")]
        bad = [",".join(f"{int(p[-4:]) + 300}" for p in s.split(".")), s.replace(".", ","), s.replace(".", ":")]
    elif kind == "card":
        wrong = n[:-1] + str((int(n[-1]) + 3) % 10)
        four = lambda d, sep: sep.join(d[i:i + 4] for i in range(0, len(d), 4))
        good = [four(n, "."), four(n, "_"), four(n, "/"), n]
        bad = [four(wrong, "."), four(wrong, "_"), wrong, n[:-6], f"{n[:4]}-{n[4:6]}-{n[6:8]}", f"{n[:3]}-{n[3:6]}-{n[6:10]}", f"0{n[:2]} {n[2:6]} {n[6:10]}"]
    else:
        d = n[-10:]
        good = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"0{d[:2]} {d[2:6]} {d[6:]}"]
        bad = [f"{d[:2]}/{d[2:5]}/{d[5:9]}", f"{d[:4]}-{d[4:8]} {d[:3]}", f"{d[:3]}/{d[3:7]} {d[:4]}", f"{d[:3]}-{d[3:6]}-{d[6:]}-{d[:2]}", f"{d[:4]}.{d[4:8]}.{d[2:6]}"]
    return [*((f, 1) for f in good), *((f, 0) for f in bad)]


def _made_up(kind: str, seed: int) -> str:
    """A value of a kind, made from ``seed``; cards may also have 13 digits."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9)))
    if kind == "email":
        name = word() + r.choice(["", "." + word(), str(r.randint(1, 99)), "_" + word()])
        return f"{name}@{r.choice(['', word() + '.'])}{word()}{r.choice(['', str(r.randint(1, 9))])}.{r.choice(['com', 'org', 'net', 'io', 'co.uk', 'de'])}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255) if r.random() < 0.7 else r.randint(0, 9)) for _ in range(4))
    if kind == "card":
        d = r.choice("3456") + "".join(str(r.randint(0, 9)) for _ in range(r.choice([11, 13, 14, 14, 14, 17])))
        return d + next(c for c in "0123456789" if luhn(d + c))
    return f"+1{r.randint(200, 989)}{r.randint(200, 999)}{r.randint(0, 9999):04d}"


def training_spans(text: str | None, made_up: int = 0) -> list[tuple[list[float], int]]:
    """(features, label) of the spans to learn from."""
    return [(x, y) for x, y, _ in _training_spans(text, made_up)]


def _training_spans(text: str | None, made_up: int) -> list[tuple[list[float], int, bool]]:
    """(features, label, whether it is a proposal's form)."""
    out, known = [], list(rule_matches(text))
    more = clear_of(text, [m[:3] for m in known if m[3]], proposals(text))[0]
    unlabelled = [s for s in more if form_ok(text, *s)]
    failed = clear_of(text, unlabelled, [*(m[:3] for m in known if not m[3]), *(s for s in more if s not in unlabelled)])[0]

    def put(kind, value, left, right):
        # Two of its right and two of its wrong forms, by the value: all of them, over many values.
        turn = zlib.crc32(value.encode())
        for y in (1, 0):
            forms = [f for f, label in _forms(kind, value) if label == y]
            for form in {forms[turn % len(forms)], forms[(turn // 7) % len(forms)]}:
                add(form, y, kind, left, right)

    def add(form, y, kind, left, right):
        out.append((span_features(left + form + right, kind, len(left), len(left) + len(form)), y, True))

    for i in range(made_up if text else 0):
        seed = zlib.crc32(text.encode("utf-8", "surrogatepass"), i)
        kind = KINDS[seed % 4]
        at = text.find(" ", seed % len(text))
        left, right = (text[max(0, at - 23):at + 1], text[at:at + 24]) if at >= 0 else ("", "")
        put(kind, _made_up(kind, seed), left, right)
    for kind, a, b, ok in known:
        if ok:
            out.append((span_features(text, kind, a, b), 1, False))
            put(kind, text[a:b], text[max(0, a - 24):a], text[b:b + 24])
    failing = {s for s in more if s not in unlabelled}
    for s in failed:
        out.append((span_features(text, *s), 0, s in failing))
    return out


def training_sample(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, text of ``limit`` rows in hash order that hold a digit or an @: chosen by narrow ids, then joined."""
    rows = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"))
    ids = rows.select("_h", "doc_id", "_t").distinct().orderBy("_h", "doc_id", "_t").limit(limit)
    # ``limit`` rows of three numbers; copies of a sampled row are dropped before they are sent.
    some = rows.join(F.broadcast(ids.select("_h", "_t")), ["_h", "_t"], "left_semi")
    return some.groupBy("_h", "_t").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text")


def train_pii(docs: DataFrame, limit: int = TRAINING_DOCS, precision: float = PRECISION, spans: int = TRAINING_SPANS) -> BoostedTrees | None:
    """Trees and thresholds from at most ``limit`` documents that hold a digit or an @."""
    sample = written(training_sample(docs, limit), "pii-sample")
    made_up = max(1, min(16, MADE_UP // max(1, sample.count())))

    def work(texts):
        rows = [_training_spans(t, made_up)[:spans] for t in texts]
        packed = [np.array([[*x, y, p] for x, y, p in r], np.float32).tobytes() for r in rows]
        return [pa.array(packed, pa.binary())]

    got = map_texts(sample, work, "x binary", ["doc_id"]).filter("length(x) > 0").orderBy("doc_id", "x").collect()
    discard(sample)
    width = len(KINDS) + N_MORE + 2
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, width).astype(float) for r in got]
    all_ = np.concatenate([np.empty((0, width)), *parts])
    x, y, proposed = all_[:, :-2], all_[:, -2], all_[:, -1] > 0
    if len(y) < 20 or len(set(y.tolist())) < 2:
        return None
    # Whole documents are held out: every third span would be the same forms each time.
    fold = (np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if len(parts) >= 3 else np.arange(len(y))) % 3
    p = np.zeros(len(y))
    for k in range(3):
        p[fold == k] = boost(x[fold != k], y[fold != k]).score(x[fold == k])
    model = boost(x, y)
    for i, kind in enumerate(KINDS):
        own = proposed & (x[:, i] > 0)
        model.thresholds[kind] = calibrate(p[own], y[own], precision)
    return model


def find_spans(text: str | None, model: BoostedTrees | None) -> tuple[list, list]:
    """(base spans, added (kind, start, end, score)), none of which meet."""
    base = base_spans(text)
    extra, taken = clear_of(text, base, proposals(text))
    if not extra or model is None:
        return base, []
    p = model.score(np.array([span_features(text, *s) for s in extra]))
    added: list = []
    for q, s in sorted(zip(p.tolist(), extra), key=lambda z: (-z[0], z[1][1], z[1][2])):
        if q >= model.thresholds[s[0]] and 1 not in taken[s[1]:s[2]]:
            added.append((*s, q))
            taken[s[1]:s[2]] = b"\x01" * (s[2] - s[1])
    return base, added


def find_pii(docs: DataFrame, keep: list[str], model: BoostedTrees | None = None) -> DataFrame:
    """``keep`` columns with base and added spans of each whole text."""
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    row = lambda s, q: {"kind": s[0], "start": s[1], "end": s[2], "score": q}

    def work(texts):
        got = [find_spans(t, model) for t in texts]
        return [pa.array([[row(s, 1.0) for s in b] for b, _ in got], one), pa.array([[row(s, s[3]) for s in a] for _, a in got], one)]

    return map_texts(docs, work, f"base array<{SPAN}>, added array<{SPAN}>", keep)


def pii_digest(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """Counts and digests of the spans: the columns of the query."""

    def work(texts):
        cols = [[] for _ in range(6)]
        for t in texts:
            base, added = find_spans(t, model)
            for c, k in zip(cols, KINDS):
                c.append(sum(s[0] == k for s in base))
            cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[5].append(joined([*base, *(s[:3] for s in added)]))
        return [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())]

    return map_texts(docs, work, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", ["doc_id"])


def redact(text: str | None, model: BoostedTrees | None) -> str | None:
    """The text with each span as <KIND>; overlapping spans go as one, by the first kind."""
    base, added = find_spans(text, model)
    spans = sorted(((a, b, k) for k, a, b in [*base, *(s[:3] for s in added)]), key=lambda s: (s[0], -s[1]))
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: BoostedTrees | None, text: str = "text") -> DataFrame:
    """All columns, in their order, with the text redacted."""
    keep = [c for c in docs.columns if c != text]
    done = map_texts(docs, lambda t: [pa.array([redact(x, model) for x in t], pa.string())], f"`{text}` string", keep, text)
    return done.select(*docs.columns)
