"""Exact tokenisation of whole texts, a few MB at a time.

The vocabulary's normaliser and splitter never join or look across ASCII white
space, so a text's ids are those of its white-space words one after another.
The texts of a few MB are split and their distinct words found as Arrow arrays;
those words' distinct pieces are merged many at a time by the vocabulary's own
merge model, and words with characters whose normalisation is not one to one go
through the whole tokenizer. Ids then spread from distinct words to texts by
array indexing, so nothing is kept from one call to the next. The result equals
encoding each whole text at once.
"""

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken together, and so searched for distinct words; a longer text is taken by itself.
TAKEN_BYTES = 6_000_000
#: Pieces merged by one call.
CALL_WORDS = 4_000

# Characters that lower-casing and NFC map one by one, by class.
_PLAIN = [chr(c) for c in range(33, 0x130) if not 127 <= c <= 160]
_of = lambda kind: "".join(map(re.escape, (c for c in _PLAIN if unicodedata.category(c)[0] == kind)))
_OTHER = "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] not in "LN")
_WIDE = re.compile("[^\x00-\x7f]+")
_ODD = re.compile("[^\n" + "".join(map(re.escape, _PLAIN)) + "]")
#: The splitter's pattern over those characters, with the line end between words.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[{_OTHER}]+|\n")


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes in byte-level vocabularies: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _spread(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` between ``offsets`` that ``at`` names, one after another, and their offsets."""
    starts = offsets[at]
    ends = np.concatenate([[0], np.cumsum(offsets[at + 1] - starts)])
    where = np.repeat(starts - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
    return values[where], ends


def _joined(words: pa.Array, by: str) -> str:
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
    return pc.binary_join(one, by.encode())[0].as_py().decode("utf-8", "replace")


class WordTokenizer:
    """Made for the word-level byte-pair vocabularies: pieces end in a suffix, letters are bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self._path, self._whole, self._light = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        known = split and split[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        suffix = model.get("end_of_word_suffix")
        if known and suffix:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self._light = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
            self._light.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self._ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self._ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
            self._letters = _byte_letters()
            self._special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")

    def _full(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts by the whole tokenizer, loaded when something needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
        lists = [np.array(e.ids, np.uint32) for e in self._whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])

    def _merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of pieces: each ends with the only one of its tokens that has the suffix."""
        got = []
        for k in range(0, len(pieces), CALL_WORDS):
            text = _WIDE.sub(lambda m: m[0].encode().decode("latin-1").translate(self._letters), _joined(pieces.slice(k, CALL_WORDS), " "))
            got.append(np.array(self._light.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate([np.empty(0, np.uint32), *got])
        offsets = np.concatenate([[0], np.flatnonzero(self._ends[ids]) + 1])
        if len(offsets) != len(pieces) + 1:
            raise ValueError("the vocabulary does not end each piece by its suffix")
        return ids, offsets

    def _plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of words, joined by line ends, of characters that lower-casing maps one by one."""
        pieces = pa.array(_PIECES.findall(joined.lower()) + ["\n"], pa.string()).dictionary_encode()
        at, known = pieces.indices.to_numpy(), pieces.dictionary
        gap = pc.index(known, "\n").as_py()
        ids, offsets = self._merge(pa.concat_arrays([known.slice(0, gap), known.slice(gap + 1)]))
        offsets = np.insert(offsets, gap, offsets[gap])  # a line end has no ids
        values, ends = _spread(ids, offsets, at)
        return values, np.concatenate([[0], ends[np.flatnonzero(at == gap)]])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words; an empty one has none."""
        if not len(words):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        joined = _joined(words, "\n")
        if not _ODD.search(joined) and not self._special.search(joined):
            return self._plain(joined)
        texts = joined.split("\n")
        odd = np.array([bool(_ODD.search(t) or self._special.search(t)) for t in texts])
        ids, offsets = self._plain("\n".join(t for t, o in zip(texts, odd) if not o))
        if odd.all():
            ids, offsets = ids[:0], np.zeros(1, np.int64)
        more, ends = self._full([t for t, o in zip(texts, odd) if o])
        place = np.empty(len(texts), np.int64)
        place[~odd], place[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
        return _spread(np.concatenate([ids, more]), np.concatenate([offsets, ends[1:] + len(ids)]), place)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column as one array, and each text's offsets; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string(), safe=False), "")
        if self._light is None:
            return self._full([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()])
        # A-Z may go first, as the vocabulary lower-cases, but for texts that may hold special tokens.
        lower = pc.ascii_lower(texts)
        special = pc.match_substring(texts, "<|")
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower)
        lists = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(int(lists[0]), int(lists[-1] - lists[0])).dictionary_encode()
        values, ends = _spread(*self._words(words.dictionary), words.indices.to_numpy())
        return values, ends[lists - lists[0]]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_column(pa.array(texts, pa.binary()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with ``end_id`` after each text."""
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def gathered(batches, column: int = 1, most: int = TAKEN_BYTES):
    """The rows of Arrow batches in batches of about ``most`` bytes of text; a longer row is alone."""
    group, total = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in slices(sizes, most):
            n = sum(sizes[a:b])
            if group and total + n > most:
                yield pa.concat_batches(group)
                group, total = [], 0
            group.append(batch.slice(a, b - a))
            total += n
    if group:
        yield pa.concat_batches(group)


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer, made once for all its tasks."""
    if path not in _made:
        _made.clear()
        _made[path] = WordTokenizer(path)
    return _made[path]


def slices(lengths: list[int], most: int = 2_000_000):
    """(start, end) of runs of rows of about ``most`` bytes; a longer row is a run by itself."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is on this machine; a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)
