"""Personal data: base patterns, then contextual extraction bootstrapped from what they found.

Base entities are seeds. The words around each seed are lexical patterns; Spark scores the graph of patterns and
instances in rounds: a pattern is as good as the share of its distinct instances that are believed, an instance as good
as the patterns that bring it forward. Identifier-shaped strings that only good patterns surround are spans of kind
``context``. The graph's tables hold hashes, grow with the corpus and are grouped and joined by Spark alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone", "context")
#: A pattern needs this many different seeds or confidently believed instances, and this share of believed instances; an instance this much belief.
MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE, ROUNDS = 5, 0.8, 0.8, 3

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s]+")
_EDGE = ".,;:!?\"'()[]{}<>|*&%$#"
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; from each @ outwards, so that a long run of letters costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of dotted numbers is used up four at a time; a part over 255 drops its match."""
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    own = list(map(int, reversed(digits)))
    return (sum(own[::2]) + sum(twice[x] for x in own[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in order. Code points, end exclusive."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    return sorted((a, k, b) for k, find in enumerate(FINDERS) for a, b in find(text))


def signed(data: str, seed: int = 0) -> int:
    n = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"), seed)
    return n - (1 << 64) if n >> 63 else n


def contexts(text: str) -> Callable[[int, int], tuple[int, int]]:
    """(start, end) of a mention to its patterns: the two words before, and the word on each side; hashes, 0 for none.

    Words are whole, however long, and those of the text that the mention's own don't belong to; each place between
    words is worked out once.
    """
    words = [m.span() for m in _TOKEN.finditer(text)]
    starts = [w[0] for w in words]

    @cache
    def plain(k: int) -> str:
        word = text[slice(*words[k])].lower()
        return _DIGIT.sub("0", word.strip(_EDGE)) or word

    @cache
    def beside(i: int, j: int) -> tuple[int, int]:
        left = signed(f"{plain(i - 2)} {plain(i - 1)}", 1) if i > 1 else 0
        return left, signed(f"{plain(i - 1)}\n{plain(j)}", 2) if i and j < len(words) else 0

    return lambda start, end: beside(bisect_right(starts, start) - 1, bisect_left(starts, end))


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, int, int, int]]:
    """(start, end, is a seed, value, left pattern, surrounding pattern) of base spans and of other tokens with a digit
    and four characters."""
    places = [(a, b, True) for a, _, b in base]
    taken, k = sorted((a, b) for a, _, b in base), 0
    for d in _runs(text):
        raw = d.group()
        a = d.start() + len(raw) - len(raw.lstrip(_EDGE))
        b = a + len(raw.strip(_EDGE))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= 4 and not any(x < b and y > a for x, y in taken[k : k + 8]):
            places.append((a, b, False))
    if not places:
        return []
    around = contexts(text)
    return [(a, b, seed, signed(text[a:b], 3), *around(a, b)) for a, b, seed in places]


def _runs(text: str) -> Iterator[re.Match]:
    """Tokens with a digit, each looked at once."""
    at = 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        found = _TOKEN.match(text, start)
        yield found
        at = found.end()


FOUND = "row_id long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, mentions array<struct<start:int,end:int,seed:boolean,value:long,left:long,around:long>>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.int64()), ("left", pa.int64()), ("around", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts = part.column(2).to_pylist()
            base = [base_spans(t or "") for t in texts]
            own = [mentions(t, s) if t and (s or _DIGIT.search(t)) else [] for t, s in zip(texts, base)]
            digest = [hashlib.sha256(",".join(f"{KINDS[q]}:{a}:{b}" for a, q, b in s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1),
                    *[pa.array([sum(x[1] == q for x in s) for s in base], pa.int64()) for q in range(4)],
                    pa.array(digest, pa.string()),
                    pa.array([[dict(zip(("start", "kind", "end"), x)) for x in s] for s in base], pa.list_(_SPAN)),
                    pa.array([[dict(zip(("start", "end", "seed", "value", "left", "around"), x)) for x in s] for s in own], pa.list_(_MENTION)),
                ],
                ["row_id", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"],
            )


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Distinct (pattern, value, seed) to the values that good patterns vouch for: (value, belief).

    Every round scores each pattern by its believed share and support, keeps the good ones, and sets the belief in each
    instance from the patterns around it, 1 - product(1 - score). Sums are combined before they are shuffled and each
    round's tables are written, so a pattern with a third of all mentions is an ordinary join that can be split.
    """
    belief = None
    for k in range(rounds):
        if belief is None:
            held = edges.select("pattern", "value", F.col("seed").cast("double").alias("belief"), "seed")
        else:
            held = edges.join(belief, "value", "left").select(
                "pattern", "value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))).alias("belief"), "seed"
            )
        scored = held.groupBy("pattern").agg(F.sum("belief").alias("sum"), F.count(F.lit(1)).alias("n"), F.sum((F.col("belief") >= MIN_INSTANCE).cast("long")).alias("known"))
        good = materialize(
            scored.where((F.col("known") >= MIN_SEEDS) & (F.col("sum") / F.col("n") >= (MIN_PATTERN if k else MIN_PATTERN / 2)))
            .select("pattern", F.least(F.col("sum") / F.col("n"), F.lit(0.999)).alias("score")),
            "pii-patterns",
        )
        doubt = edges.where(~F.col("seed")).join(good, "pattern").groupBy("value").agg(F.sum(F.log1p(-F.col("score"))).alias("doubt"))
        belief = materialize(doubt.select("value", (1 - F.exp("doubt")).alias("belief")), "pii-beliefs")
    return belief.where(F.col("belief") >= MIN_INSTANCE)


def find_pii(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ...) to doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context.

    The counts and base_sha256 are of the base patterns; ``spans`` lists all spans as kind:start:end by start and then
    kind (email, ip, card, phone, context), joined by commas. Spans of kind context never overlap base ones. Null or
    empty text has no spans; repeated rows each get theirs; other columns are ignored; an empty table gives no rows.
    Whole texts are read, whatever their length.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(rows.mapInArrow(_find, FOUND), "pii-found")
    each = found.select("row_id", F.explode("mentions").alias("m")).select("row_id", "m.*")
    pairs = each.select(F.explode(F.array("left", "around")).alias("pattern"), "value", "seed").where("pattern <> 0")
    edges = materialize(pairs.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    good = bootstrap(edges)
    more = each.where(~F.col("seed")).join(good.select("value"), "value", "left_semi")
    more = more.groupBy("row_id").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
    name = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    return found.join(more, "row_id", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_context"),
    )
