"""Embedding near-duplicates by hierarchical navigable small-world graphs, one a shard.

Vectors of a label are dealt into shards of bounded bytes; a graph is built over each, and every vector of the label
searches every shard. The search keeps a beam of the nearest nodes and then floods along links that stay above the
threshold. A sample of the shard's vectors is compared with brute force: while their recall is below the target the beam
is doubled, at last to the whole shard. Cosines are checked in double precision, and what is linked is joined to
components. All searches of a block move in step, as array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: Neighbours a node keeps, beam while building, first beam of the search, searches in step, vectors audited a shard,
#: recall they must reach, and bytes of single-precision vectors in a shard (65,536 of 64 components).
DEGREE, BUILD_BEAM, FIRST_BEAM, IN_STEP, AUDITED, RECALL, SHARD_BYTES = 24, 40, 24, 256, 1024, 0.995, 1 << 24
#: Shards' worth of searches that one task answers; more are dealt to tasks that each build the shard's graph.
SEARCHES = 8
#: Single precision finds, double decides: the margin by which the search goes below the threshold.
MARGIN = 1e-4


def diverse(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the row than to any chosen before; then the next best.

    ``ids`` are -1 where there is none. Returns (rows, keep) ids, -1 beyond what there is.
    """
    rows, width = ids.shape
    own = vectors[ids]
    among = np.einsum("rcd,red->rce", own, own, optimize=True)
    nearest = np.full((rows, width), -np.inf, np.float32)
    rank = np.full((rows, width), 3 * width, np.int32)
    for c in range(width):
        real = ids[:, c] >= 0
        chosen = real & (sims[:, c] > nearest[:, c])
        rank[:, c] = np.where(chosen, c, np.where(real, width + c, 3 * width))
        np.maximum(nearest, np.where(chosen[:, None], among[:, c, :], -np.inf), out=nearest)
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, axis=1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


class Layer:
    """One level's graph over positions of ``vectors``; links are -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.links = np.full((len(vectors), DEGREE), -1, np.int32)

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: (ids, cosines), best first, -1 beyond what was reached."""
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(self.vectors)), bool)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        ids[:, 0], done[:, 0] = entry, False
        sims[:, 0] = np.einsum("nd,nd->n", queries, self.vectors[entry])
        seen[rows, entry] = True
        while True:
            waiting = np.where(done, -np.inf, sims)
            at = waiting.argmax(axis=1)
            act = np.flatnonzero(waiting[rows, at] > -np.inf)
            if not len(act):
                break
            done[act, at[act]] = True
            near = self.links[ids[act, at[act]]]
            fresh = (near >= 0) & ~seen[act[:, None], near]
            r, c = np.nonzero(fresh)
            seen[act[r], near[r, c]] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("nd,nd->n", queries[act[r]], self.vectors[near[r, c]])
            all_sims = np.concatenate([sims[act], got], axis=1)
            all_ids = np.concatenate([ids[act], np.where(fresh, near, -1)], axis=1)
            all_done = np.concatenate([done[act], ~fresh], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[act] = np.take_along_axis(all_sims, top, axis=1)
            ids[act] = np.take_along_axis(all_ids, top, axis=1)
            done[act] = np.take_along_axis(all_done, top, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def insert(self, nodes: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Give the nodes links to their candidates and back; who has too many links chooses anew."""
        chosen = diverse(sims, near, self.vectors, DEGREE)
        self.links[nodes] = chosen
        r, c = np.nonzero(chosen >= 0)
        target, source = chosen[r, c], nodes[r]
        order = np.lexsort((-np.einsum("nd,nd->n", self.vectors[target], self.vectors[source]), target))
        target, source = target[order], source[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        kept = place < DEGREE  # the nearest: no more could stay anyway
        who = target[first]
        added = np.full((len(who), DEGREE), -1, np.int32)
        added[np.searchsorted(who, target[kept]), place[kept]] = source[kept]
        for k in range(0, len(who), 1024):
            own, more = who[k : k + 1024], added[k : k + 1024]
            more = np.where((more[:, :, None] == self.links[own][:, None, :]).any(axis=2), -1, more)  # linked already
            both = np.concatenate([self.links[own], more], axis=1)
            s = np.einsum("nd,ncd->nc", self.vectors[own], self.vectors[both], optimize=True)
            s[both < 0] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")
            both, s = np.take_along_axis(both, order, axis=1), np.take_along_axis(s, order, axis=1)
            self.links[own] = diverse(s, both, self.vectors, DEGREE)


class Graph:
    """Levels from the top down; a node's level is geometric in a hash of its place, so a rerun builds the same."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n = len(vectors)
        draw = ((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.layers: list[Layer] = []
        for at in range(int(level.max(initial=0)), -1, -1):
            self._build(self.order[: int((level >= at).sum())])
        # the flood follows links both ways: a crowded neighbourhood may drop all links to a node, never those from it
        one, c = np.nonzero(self.layers[-1].links >= 0)
        two = self.layers[-1].links[one, c].astype(np.int64)
        both = np.unique(np.concatenate([one * n + two, two * n + one]))
        self.around, self.starts = both % n, np.searchsorted(both // n, np.arange(n + 1))

    def _build(self, nodes: np.ndarray) -> None:
        """A layer over ``nodes``, those of the layer above first, in blocks that double."""
        layer, placed, block = Layer(self.vectors), 1, 1
        inside = np.zeros(len(self.vectors), bool)
        inside[nodes[:1]] = True
        while placed < len(nodes):
            block = min(2 * block, IN_STEP, len(nodes) - placed)
            new = nodes[placed : placed + block]
            queries = self.vectors[new]
            entry = self.enter(queries)
            entry = np.where(inside[entry], entry, nodes[0])
            ids, sims = layer.search(queries, entry, min(BUILD_BEAM, placed))
            together = queries @ queries.T  # the block's own, which aren't in the graph yet
            np.fill_diagonal(together, -np.inf)
            few = min(DEGREE, block - 1)
            if few:
                top = np.argpartition(-together, few - 1, axis=1)[:, :few]
                ids = np.concatenate([ids, new[top].astype(np.int32)], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(together, top, axis=1)], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            layer.insert(new, ids, sims)
            inside[new] = True
            placed += block
        self.layers.append(layer)

    def enter(self, queries: np.ndarray) -> np.ndarray:
        """Down the layers that there are, greedily: where to enter the next one."""
        entry = np.full(len(queries), self.order[0], np.int64)
        for layer in self.layers:
            entry = layer.search(queries, entry, 4)[0][:, 0].astype(np.int64)
        return entry

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all found with a cosine of at least ``least``: the beam's, and what links above it reach."""
        n, base = len(self.vectors), self.layers[-1]
        if beam >= n:
            q, p = np.nonzero(queries @ self.vectors.T >= least)
            return q, p
        entry = np.full(len(queries), self.order[0], np.int64)
        for layer in self.layers[:-1]:
            entry = layer.search(queries, entry, 4)[0][:, 0].astype(np.int64)
        ids, sims = base.search(queries, entry, beam)
        q, c = np.nonzero(sims >= least)
        front = np.unique(q * n + ids[q, c])
        found = front
        while len(front):
            begin = self.starts[front % n]
            many = self.starts[front % n + 1] - begin
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.unique(np.repeat(front // n, many) * n + self.around[np.repeat(begin, many) + place])
            pairs = pairs[~np.isin(pairs, found, assume_unique=True)]
            keep = [x[np.einsum("nd,nd->n", queries[x // n], self.vectors[x % n]) >= least] for x in np.array_split(pairs, len(pairs) // (1 << 16) + 1)]
            front = np.concatenate(keep)
            found = np.union1d(found, front)
        return found // n, found % n


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Shard:
    """The graph of one shard's (node, copies, vector) and a beam that has passed the audit."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, least: float):
        self.nodes, self.copies, self.least = nodes, copies, least
        self.exact = unit(vectors.astype(np.float64))
        self.graph = Graph(self.exact.astype(np.float32))
        self.group = np.arange(len(nodes))
        self.beam = FIRST_BEAM
        self.audited = False
        step = max(1, len(nodes) // AUDITED)
        self.audit(nodes[::step][:AUDITED], self.exact[::step][:AUDITED])

    def audit(self, nodes: np.ndarray, queries: np.ndarray) -> None:
        """Widens the beam until the queries find RECALL of their links, by brute force, on average.

        Each query with a link counts alike, however many it has, and none counts the link with itself.
        """
        truth = np.zeros(len(queries))
        for k in range(0, len(queries), 64):
            near = queries[k : k + 64] @ self.exact.T >= self.least
            truth[k : k + 64] = (near & (nodes[k : k + 64, None] != self.nodes)).sum(axis=1)
        asked = np.flatnonzero(truth)
        while len(asked) and self.beam < len(self.nodes):
            q, p = self.links(queries[asked])
            found = np.bincount(q[nodes[asked][q] != self.nodes[p]], minlength=len(asked))
            if np.mean(found / truth[asked]) >= RECALL:
                break
            self.beam *= 2

    def links(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in the shard) with a cosine, in double precision, of at least the threshold."""
        q, p = self.graph.within(queries.astype(np.float32), self.least - MARGIN, self.beam)
        sure = np.einsum("nd,nd->n", queries[q], self.exact[p]) >= self.least
        return q[sure], p[sure]

    def answer(self, nodes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each searching node: (node, vectors linked with, the first node linked with or itself).

        What one query links is joined in ``group``; a node's own copies are counted elsewhere.
        """
        q, p = self.links(unit(vectors.astype(np.float64)))
        other = self.nodes[p] != nodes[q]
        q, p = q[other], p[other]
        count = np.bincount(q, weights=self.copies[p], minlength=len(nodes)).astype(np.int64)
        first = np.full(len(nodes), len(self.nodes), np.int64)
        np.minimum.at(first, q, p)
        self.join(first[q], p)
        to = np.where(first < len(self.nodes), self.nodes[np.minimum(first, len(self.nodes) - 1)], nodes)
        return nodes, count, to

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.group[a], self.group[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.group, np.maximum(x, y), np.minimum(x, y))
            while (deeper := self.group[self.group]).tobytes() != self.group.tobytes():
                self.group = deeper


def _search(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            """(key, planted, lead, nodes, copies, vectors) of rows that follow each other with one key."""
            for b in batches:
                if not b.num_rows:
                    continue
                shard, planted, lead, node, copies = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
                cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (planted[1:] != planted[:-1])) + 1
                for i, j in zip([0, *cuts], [*cuts, len(shard)]):
                    flat = b.column(5).slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
                    yield int(shard[i]), bool(planted[i]), bool(lead[i]), node[i:j], copies[i:j], flat.reshape(j - i, -1)

        def rows(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "n_links", "to"])

        def asked(shard: Shard, nodes: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not shard.audited and nodes[0] not in shard.nodes:  # searches from other shards have no node to start from
                shard.audit(nodes[:IN_STEP], unit(vectors[:IN_STEP].astype(np.float64)))
                shard.audited = True
            for k in range(0, len(nodes), IN_STEP):
                yield rows(shard.answer(nodes[k : k + IN_STEP], vectors[k : k + IN_STEP]))

        def closed(shard: Shard | None) -> Iterator[pa.RecordBatch]:
            if shard is not None:
                far = np.flatnonzero(shard.group != np.arange(len(shard.group)))
                yield rows((shard.nodes[far], np.zeros(len(far), np.int64), shard.nodes[shard.group[far]]))

        def built(held: list) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
            nodes, copies, vectors = (np.concatenate([h[k] for h in held]) for k in range(3))
            yield Shard(nodes, copies, vectors, least), nodes, vectors

        def own_searches(shard: Shard, lead: bool, nodes: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
            return asked(shard, nodes, vectors) if lead else iter(())

        key, held, shard, first = None, [], None, False
        for own, planted, lead, nodes, copies, vectors in pieces():
            if own != key or (held and not planted):
                if held:
                    for shard, all_nodes, all_vectors in built(held):
                        yield from own_searches(shard, first, all_nodes, all_vectors)
                    held = []
                if own != key:
                    yield from closed(shard)
                    key, shard = own, None
            if planted:
                first = lead
                held.append((nodes, copies, vectors))
            else:
                yield from asked(shard, nodes, vectors)
        if held:
            for shard, all_nodes, all_vectors in built(held):
                yield from own_searches(shard, first, all_nodes, all_vectors)
        yield from closed(shard)

    return run


def embedding_components(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Rows (vec_id, embedding, label, ...) to (vec_id, n_links, component_id, kept), one row for each input row.

    Two rows link if their labels are equal and not null and their cosine, in double precision, is at least ``least``;
    vectors of different length never link. A null, empty or zero vector, one with a null or non-finite component, and
    a null label link with nothing: n_links 0, a component of their own. n_links counts other rows, so rows that repeat
    a vector link with each other. component_id is the smallest vec_id reachable, its own included; with a null vec_id
    it may be null. kept is vec_id = component_id, false if null. Other columns are ignored; an empty table gives no
    rows.

    Equal vectors of a label are one node from the start. A label's vectors are all searched in each of its shards, so
    the work is the label's size times its number of shards; a shard and one block of searches is what a task holds. A
    shard that over SEARCHES shards search in is planted in several tasks, which share the searches.
    """
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    key = F.when(F.coalesce(good, F.lit(False)), F.struct(F.xxhash64("label", "embedding").alias("a"), F.xxhash64("embedding", F.lit(7), "label").alias("b")))
    rows = materialize(
        vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
        .withColumn("key", key),
        "hnsw-rows",
    )
    nodes = materialize(
        rows.where("key IS NOT NULL").groupBy("key").agg(
            F.min("row").alias("node"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        ),
        "hnsw-nodes",
    )
    sized = nodes.select("node", "copies", "label", F.size("embedding").alias("dim"), "embedding")
    count = sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    count = count.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.ceil(F.col("n") * F.col("dim") * 4 / SHARD_BYTES).cast("int").alias("shards"))
    dealt = (
        sized.join(count, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
        .withColumn("home", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .withColumn("planted", F.col("part") == F.col("home"))
        .withColumn("tasks", F.ceil(F.col("shards") / SEARCHES).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tasks")).cast("int"))
        .withColumn("task", F.explode(F.when(F.col("planted"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array("own"))))
        .select(F.xxhash64("label", "dim", "part", "task").alias("shard"), "planted", (F.col("task") == 0).alias("lead"), "node", "copies", "embedding")
    )
    found = materialize(
        dealt.repartition("shard").sortWithinPartitions("shard", F.desc("planted"), "node").mapInArrow(_search(least), "node long, n_links long, to long"),
        "hnsw-links",
    )
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    groups = materialize(connected_components(found.select(F.col("node").alias("u"), F.col("to").alias("v")), "hnsw-groups"), "hnsw-components")
    lows = groups.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("lowest"))
    known = (
        nodes.select("key", "node", "low", "copies").join(links, "node", "left").join(groups, "node", "left").join(lows, "component", "left")
        .select("key", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    )
    known = materialize(known, "hnsw-known")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
