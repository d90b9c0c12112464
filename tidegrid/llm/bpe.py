"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of neighbouring base symbols that occurs inside no vocabulary token can never be joined by a merge, so the word
is certain to be cut there. Words are split at all such cuts, the fragments are merged independently (and remembered,
since fragments repeat far more than words do) and their ids are concatenated. The vocabulary is read on the driver,
where its path is a parameter, and broadcast: its size is that of one file, a few MB, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Entries that a task remembers before it starts anew: a bound on memory, without effect on results.
REMEMBERED = 400_000

#: Scripts whose classes and normal forms are the same in every Unicode version: Latin, combining marks, Cyrillic,
#: general punctuation, kana, CJK and Hangul. A text with any other character is cut into words by the tokenizers library
#: itself, whose tables are of another version than Python's.
STEADY = [(0, 0x236), (0x250, 0x36F), (0x400, 0x481), (0x2010, 0x2027), (0x2030, 0x205E), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
FAR = re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in STEADY) + "]")
#: What the library's \s is.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def class_of(kind: str) -> str:
    """The characters of STEADY whose category begins with ``kind``, as ranges for a character class."""
    ranges: list[list[int]] = []
    for c in (c for a, b in STEADY for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


def word_pattern() -> re.Pattern:
    """English contractions, runs of letters, single numbers, runs of other marks."""
    letters, numbers = class_of("L"), class_of("N")
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{letters}{numbers}]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is visible Latin-1,
    else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE file with an end-of-word suffix, as the tables that encoding needs."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.packed = {k: np.uint32(v).astype("<u4").tobytes() for k, v in self.ids.items()}
        self.tokens = {v: k for k, v in self.ids.items()} | {v: k for k, v in self.added.items()}
        self.pattern = word_pattern()
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.inside = {(a, b) for t in self.ids for s in [self.symbols(t)] for a, b in zip(s, s[1:])}
        self.byte = byte_symbols()
        self.library = Tokenizer.from_str(spec)  # only for texts that FAR finds something in

    def symbols(self, token: str) -> list[str]:
        """A token's base symbols; the last carries the suffix if the token ends a word."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def fragments(self, word: str) -> list[tuple[str, ...]]:
        """The base symbols of a word (in byte characters), split where a pair lies inside no token."""
        chars = list(word)
        chars[-1] += self.suffix
        out, begin = [], 0
        for k in range(1, len(chars)):
            if (chars[k - 1], chars[k]) not in self.inside:
                out.append(tuple(chars[begin:k]))
                begin = k
        return [*out, tuple(chars[begin:])]

    def merge(self, symbols: tuple[str, ...]) -> bytes:
        """Ids of one fragment: the lowest-ranked pair, leftmost first, is joined until none is left."""
        if len(symbols) > 24:
            return self.merge_long(symbols)
        parts, rank, none = list(symbols), self.ranks.get, len(self.ranks)
        while len(parts) > 1:
            scores = [rank(p, none) for p in zip(parts, parts[1:])]
            if (least := min(scores)) == none:
                break
            k = scores.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return b"".join([self.packed[p] for p in parts])

    def merge_long(self, symbols: tuple[str, ...]) -> bytes:
        """The same with a queue, for words of any length."""
        parts, after, before = list(symbols), [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
        queue = [(r, k) for k in range(len(parts) - 1) if (r := self.ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            n = after[k]
            if parts[k] is None or n < 0 or self.ranks.get((parts[k], parts[n])) != rank:
                continue  # one of the two has been joined meanwhile
            parts[k] += parts[n]
            parts[n] = None
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (r := self.ranks.get((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(queue, (r, left))
        return b"".join([self.packed[p] for p in parts if p is not None])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        merge, fragments, byte = vocabulary.merge, vocabulary.fragments, vocabulary.byte

        class Fragments(dict):
            def __missing__(self, key):
                if len(self) >= REMEMBERED:
                    self.clear()
                self[key] = out = merge(key)
                return out

        class Words(dict):
            def __missing__(self, key):
                if len(self) >= REMEMBERED:
                    self.clear()
                word = "".join([byte[b] for b in key.encode()]) if isinstance(key, str) else key[0]
                self[key] = out = b"".join([known[x] for x in fragments(word)])
                return out

        known = Fragments()
        self.words = Words()

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens: NFC, lower case letter by letter, words, fragments, merges."""
        low = text if text.isascii() else unicodedata.normalize("NFC", text)
        low = "".join(map(str.lower, low)) if "Σ" in low else low.lower()
        if not low.isascii() and FAR.search(low):
            words = self.v.library.pre_tokenizer.pre_tokenize_str(self.v.library.normalizer.normalize_str(text))
            return b"".join([self.words[(w,)] for w, _ in words])
        return b"".join(map(self.words.__getitem__, self.v.pattern.findall(low)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens are found before anything is normalised."""
        if self.v.special is None or not self.v.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.v.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.uint32(self.v.added[m.group()]).astype("<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, spaces between: the file names no decoder, so suffixes and byte characters stay."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))



_LAST: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """The worker's encoder: kept between tasks with what it remembers."""
    if spec not in _LAST:
        _LAST.clear()
        _LAST[spec] = Encoder(Vocabulary(spec))
    return _LAST[spec]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text, ...) to (doc_id, ids, decoded): ids as packed little-endian uint32, decoded from those bytes.

    Null text counts as empty: no ids, empty text. Repeated rows give repeated rows, other columns are ignored, an
    empty table gives no rows; a text of any length is encoded whole. No shuffle.
    """
    return _encoded(docs, path, digest=False)


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """The query's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _encoded(docs, path, digest=True)


def _encoded(docs: DataFrame, path: str, digest: bool) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            for part in _slices(batch):
                ids = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                if digest:
                    rows = [
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    rows = [pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())]
                    names = ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *rows], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in small pieces, so that what Python holds at once stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
