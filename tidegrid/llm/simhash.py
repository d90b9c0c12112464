"""SimHash near-duplicates with BK-trees.

A BK-tree keeps each fingerprint under its parent by their Hamming distance, and a search follows only edges within the
radius of the distance it has measured. One tree over a corpus can't be shared out, so fingerprints are dealt into
shards that two linked ones are sure to share: blocks of the bits (pigeonhole), or smallest shingle hashes. Each shard's
tree is sent to the task that holds the fingerprints which can match it; shards over a fixed size are cut into several
trees, and their fingerprints visit each of those. A task never holds more than one such tree. Links are joined
to groups inside a shard before they leave it, so a group of n gives n - 1 edges, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, scratch

SEED, FULL = 42, (1 << 64) - 1
#: Most fingerprints in one tree, and most texts in one block of the exact comparison.
TREE, BLOCK = 2048, 256
#: Smallest shingle hashes that shard the search for similar sets: two sets of similarity 0.8 share none of them with
#: a probability of 0.2 ** 6. The radius for them is over 3 standard deviations above the distance expected there.
MINIMA, WIDE_RADIUS = 6, 20


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of other than space, \\t, \\n, \\x0B, \\f and \\r, which is what bytes do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of n words, repeats included; of the whole sequence if there are fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


class BKTree:
    """Children by integer distance to the parent; holds positions of fingerprints."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's node; an equal one is found again."""
        at = 0
        if self.nodes:
            while (d := (self.nodes[at] ^ value).bit_count()) and (child := self.children[at].get(d)) is not None:
                at = child
            if not d:
                return at
            self.children[at][d] = len(self.nodes)
        self.nodes.append(value)
        self.children.append({})
        return len(self.nodes) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away: only edges within the radius of the distance are followed."""
        found, stack = [], [0] if self.nodes else []
        while stack:
            at = stack.pop()
            d = (self.nodes[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            stack += [c for edge, c in self.children[at].items() if low <= edge <= high]
        return found


class Groups:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> Iterator[tuple[int, int]]:
        return ((x, r) for x in list(self.up) if (r := self.root(x)) != x)


def shard_links(rows: Iterable[tuple[bool, int, int]], radius: int) -> Iterator[tuple[int, int]]:
    """Edges among the (planted, id, fingerprint) of one shard's tree, planted ones first.

    Links between planted ones are joined to groups; a searching one gives an edge to one of its matches at once and
    joins the others' groups, so that only the tree is held.
    """
    tree, at_node, groups = BKTree(), [], Groups()
    for planted, own, value in rows:
        near = [at_node[node] for node in tree.within(value, radius)]
        if planted:
            if tree.add(value) == len(at_node):
                at_node.append(own)
            near.append(own)
        elif near:
            yield own, near[0]
        for x in near[1:]:
            groups.join(near[0], x)
    yield from groups.edges()


def sharded_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Rows (shard_key, id, fp), ids distinct, to edges (u, v) that join all ids linked within the radius in a shard.

    Shards of one row have no links and go first. A shard over TREE rows is cut by a hash of the id into trees; each
    row is planted in one and searched for in all, which keeps any link. Rows arrive sorted, so a task reads one shard
    after the other and keeps one tree at a time.
    """
    size = keyed.groupBy("shard_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = size.select(F.bitwise_not("shard_key").alias("far"), F.ceil(F.col("n") / TREE).cast("int").alias("trees"))
    own = F.pmod(F.xxhash64("id"), F.col("trees")).cast("int")
    dealt = (
        keyed.withColumn("far", F.bitwise_not("shard_key")).join(size, "far")
        .withColumn("home", own)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .select("shard_key", "tree", (F.col("tree") == F.col("home")).alias("planted"), "id", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bool, int, int]]:
            for b in batches:
                yield from zip(*[b.column(k).to_pylist() for k in range(5)])

        def links() -> Iterator[tuple[int, int]]:
            for _, own in groupby(rows(), key=lambda r: r[:2]):
                yield from shard_links(((planted, x, fp & FULL) for _, _, planted, x, fp in own), radius)

        found = links()
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)], ["u", "v"])

    return (
        dealt.repartition("shard_key", "tree")
        .sortWithinPartitions("shard_key", "tree", F.desc("planted"), "id")
        .mapInArrow(run, "u long, v long")
    )


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, text, ...) to (doc_id, fp), fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                fps = [signed(fingerprint(shingle_hashes(words_of(t), shingle))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_keys(fp, blocks: int, agree: int):
    """A key for every choice of ``agree`` of the blocks of bits: an array of longs."""
    width = 64 // blocks
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << width) - 1) << k * width for k in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed(mask)))))
    return F.array(*keys)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Rows (doc_id, text, ...) to (doc_id, fingerprint, component_id), one row for each input row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id reachable, the row's
    own included. Of ``blocks`` blocks, two linked fingerprints agree in all but ``radius``: that is the shard key, so
    no link is missed. Null or empty text has fingerprint zero and links like any other; null doc_ids take part but
    are never a component's smallest, unless there is no other (then null); repeated rows stay; other columns are
    ignored; an empty table gives no rows.

    Equal fingerprints are one node from the start, so a group of copies of any size is one row of the search.
    """
    with scratch():
        prints = materialize(fingerprints(docs, shingle), "simhash", keep=True)
        nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
        keyed = nodes.select(F.explode(block_keys(F.col("fp"), blocks, blocks - radius)).alias("shard_key"), F.col("fp").alias("id"), "fp")
        found = materialize(connected_components(sharded_links(keyed, radius), "simhash-links"), "simhash-components")
        grouped = found.join(nodes.withColumnRenamed("fp", "node"), "node")
        lows = grouped.groupBy("component").agg(F.min("low").alias("lowest"))
        linked = materialize(grouped.join(lows, "component").select(F.col("node").alias("fp"), "lowest"), "simhash-lowest")
        every = materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id")), "simhash-ids", keep=True)
    return prints.join(every, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by similarity of shingle sets ---


def _minima(hashes: np.ndarray) -> list[int]:
    """The smallest of the hashes under each of MINIMA bijections."""
    odd = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD1B54A32D192ED03 << k) & FULL | 1 for k in range(1, MINIMA + 1)], np.uint64)
    return [int(((hashes ^ hashes >> np.uint64(29)) * a).min()) for a in odd] if len(hashes) else [0] * MINIMA


def _sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, t1, t2, fp, minima): two hashes of the text, its set's fingerprint and smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                sets = [np.unique(shingle_hashes(words_of(t), shingle)) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([signed(fingerprint(s)) for s in sets], pa.int64()),
                        pa.array([[signed(m) for m in _minima(s)] for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "t1", "t2", "fp", "minima"],
                )

    return _named(docs).mapInArrow(run, "doc_id long, t1 long, t2 long, fp long, minima array<long>")


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(family, node, fp, text) to the same with the shingle set as packed sorted uint64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                packed = [np.unique(shingle_hashes(words_of(t), shingle)).tobytes() for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(packed, pa.binary())], ["family", "node", "fp", "shingles"])

    return texts.select("family", "node", "fp", "text").mapInArrow(run, "family long, node long, fp long, shingles binary")


def similar_edges(nodes: list[int], fps: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> Iterator[tuple[int, int]]:
    """Edges that join what is similar enough among a block's sets: nearest fingerprints first, and no comparison of
    two that are joined already."""
    size = np.array([len(s) for s in sets])
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    fit = np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :])
    a, b = np.nonzero(np.triu((apart <= radius) & fit, 1))
    order = np.argsort(apart[a, b], kind="stable")
    groups = Groups()
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if groups.root(nodes[x]) != groups.root(nodes[y]):
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if shared >= similarity * (len(both) - shared):
                groups.join(nodes[x], nodes[y])
    yield from groups.edges()


def _verified(sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Edges (u, v) between members of a family whose sets are similar enough.

    A family over BLOCK members is dealt into blocks by hash, and each two of its blocks meet in one task.
    """
    size = sets.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    size = size.select(F.bitwise_not("family").alias("far"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = (
        sets.withColumn("far", F.bitwise_not("family")).join(size, "far").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp", "shingles")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    yield from zip(*[c.to_pylist() for c in b.slice(k, 256).columns])

        for _, own in groupby(rows(), key=lambda r: r[:3]):
            held = list({r[3]: r for r in own}.values())
            sets = [np.frombuffer(r[5], np.uint64) for r in held]
            fps = np.array([r[4] for r in held], np.int64).view(np.uint64)
            found = list(similar_edges([r[3] for r in held], fps, sets, similarity, radius)) if len(held) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node").mapInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id; same columns.

    Documents link if the sets of their ``shingle``-word shingles (lower-cased; of a shorter text, the whole sequence)
    have a Jaccard similarity of at least ``similarity``; a group is all that links join, directly or through others.
    Candidates share one of MINIMA smallest hashes and have fingerprints within WIDE_RADIUS bits, found by that shard's
    BK-tree; similarity is then measured on the whole sets. Texts without words are one group, null text counts as
    empty, null doc_ids come last, rows that repeat doc_id and text count once, an empty table gives no rows.
    """
    with scratch():
        rows = materialize(_sketch(docs, shingle), "near-rows")
        order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id")
        nodes = rows.groupBy("t1", "t2").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("minima").alias("minima"))
        nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
        keyed = nodes.select(F.posexplode("minima").alias("k", "least"), F.col("node").alias("id"), "fp")
        keyed = keyed.select(F.xxhash64("k", "least").alias("shard_key"), "id", "fp")
        families = materialize(connected_components(sharded_links(keyed, WIDE_RADIUS), "near-links"), "near-families")
        members = nodes.join(families, "node").select("t1", "t2", "node", F.col("first.doc_id").alias("low"), "fp", F.col("component").alias("family"))
        members = materialize(members, "near-members")
        texts = _named(docs).join(members, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("low")))
        sets = materialize(_sets(texts, shingle), "near-sets")
        groups = materialize(connected_components(_verified(sets, similarity, WIDE_RADIUS), "near-verified"), "near-groups")
        named = nodes.select("t1", "t2", "first", "node").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
        best = named.groupBy("group").agg(F.min(F.struct("first", "node")).alias("best")).select(F.col("best.node").alias("node"))
        stays = nodes.join(best, "node").select(F.col("t1").alias("near_t1"), F.col("t2").alias("near_t2"), F.col("first.doc_id").alias("near_doc"))
        same = rows.groupBy("t1", "t2", "doc_id").agg(F.count(F.lit(1)).alias("near_n"))
        on = (F.col("near_t1") == F.col("t1")) & (F.col("near_t2") == F.col("t2")) & F.col("near_doc").eqNullSafe(F.col("doc_id"))
        stays = materialize(stays.join(same, on).select("near_t1", "near_t2", "near_doc", "near_n"), "near-stays", keep=True)
    text = F.coalesce(F.col("d.text"), F.lit(""))
    on = (F.xxhash64(text) == F.col("s.near_t1")) & (F.xxhash64(F.lit(7), text) == F.col("s.near_t2")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.near_doc"))
    whole = F.struct(*[F.col(f"d.`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    kept = docs.alias("d").join(stays.alias("s"), on).select(whole, "s.near_t1", "s.near_t2", "s.near_doc", "s.near_n")
    once, often = kept.where("near_n = 1").select("row"), kept.where("near_n > 1")
    return once.union(often.dropDuplicates(["near_t1", "near_t2", "near_doc"]).select("row")).select("row.*").toDF(*docs.columns)
