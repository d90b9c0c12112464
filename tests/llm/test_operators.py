"""Edge cases and brute-force checks of the ten operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import bpe, chat, common, hnsw, licenses, lines, matroska, mixing, pii, simhash, toxicity
from tidegrid.llm.queries import vocabulary_path


def groups_of(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 3), (4, 10), (2, 1), (None, 3)], "u long, v long")
    got = {(r.node, r.component) for r in common.connected_components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 1), (4, 4), (5, 4), (10, 4)}
    assert common.connected_components(edges.limit(0)).count() == 0
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in common.connected_components(chain).collect()} == {0}


def test_licenses(docs, spark):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.licenses for r in got if r.licenses} == {6: ["MIT"]}
    grant = next(k for k, v in licenses.SENTENCES.items() if v == "bsd-grant")
    source = next(k for k, v in licenses.SENTENCES.items() if v == "bsd-source")
    binary = next(k for k, v in licenses.SENTENCES.items() if v == "bsd-binary")
    halves = source.replace(" must ", "\nmust ")  # a sentence over two lines
    rows = spark.createDataFrame([(1, f"{grant}\n{halves} {binary} Licensed under CC BY 4.0."), (2, source)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan_licenses(rows).collect()}
    assert got == {1: (["BSD-2-Clause", "CC-BY-4.0"], []), 2: ([], ["bsd-source"])}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def brute_spans(text):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0 if digits else False
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (12 <= len(digits) <= 19 and luhn) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_licenses_know_every_sentence_and_rule(spark):
    texts = [(k, [v]) for k, v in [*licenses.SENTENCES.items(), *licenses.LAYOUTS.items()]]
    first = {v: k for k, v in reversed(licenses.SENTENCES.items())}
    texts += [("\n".join(first[x] for x in rule), list(rule)) for rule, _ in licenses.RULES if "apache-2-copy" not in rule]
    rows = spark.createDataFrame([(k, f"Before.\n{t}\n\nAfter.") for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan_licenses(rows).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: ids for k, (_, ids) in enumerate(texts)}
    assert {name for _, name in licenses.RULES} == {x for _, names in got.values() for x in names}
    apart = [(1, "This program is free software: we hope so. " + first["gpl-3-or-later"].split(": ")[1]), (2, "Version 2.0.\n\n2.0.")]
    assert all(not r.sentence_ids for r in licenses.scan_licenses(spark.createDataFrame(apart, "doc_id long, text string")).collect())


def test_pii_base(docs):
    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab@..1-+ %(256é"), rng.integers(0, 70)))
        assert pii.base_spans(text) == brute_spans(text)
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count()
    row = next(r for r in got if r.doc_id == 7)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    for r in got:
        assert r.n_context == 0
        if r.doc_id not in (None, 7):
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_learns_contexts(spark):
    rows = [(k, f"please write to user{k}@example.com soon") for k in range(20)] + [(100, "please write to user-0077 soon"), (101, "there are 1234 sheep here")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "context:16:25" and got[101] == ""


def test_pii_learns_from_texts_without_digits(spark):
    rows = [(k, f"please write to user{chr(97 + k)}@example.com soon") for k in range(20)] + [(100, "please write to user-0077 soon")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "context:16:25"


def test_pii_learns_from_discovered_instances(spark):
    rows = [(k, f"please write to user{k}@example.com soon") for k in range(20)]
    rows += [(100 + k, f"please write to user-{7000 + k} soon. The badge of user-{7000 + k} expired") for k in range(8)]
    rows += [(200, "the badge of user-8888 expired")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == "context:13:22"


def test_matroska(docs):
    for n in (0, 1, 64, 1000, 1024, 5000, 70_000, 300_000):
        payload = matroska.padded("x" * n)
        media = matroska.mux(payload)
        packets = matroska.parse(media)
        assert b"".join(media[p.start : p.start + p.size] for p in packets) == payload
        assert all(p.cued is True and p.keyframe for p in packets)
        assert [p.timestamp_ns for p in packets] == [k * matroska.FRAME_MS * 1_000_000 for k in range(len(packets))]
        for cut in range(0, len(media), max(1, len(media) // 50)):
            matroska.parse(media[:cut])
    for r in matroska.media_digest(docs).collect():
        text = next(t for i, t in texts_of(docs) if i == r.doc_id) if r.doc_id is not None else None
        if text is not None:
            raw = text.encode()
            raw += bytes(-len(raw) % 64 if raw else 64)
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    packets = matroska.demux(matroska.mux_text(docs))
    assert packets.where("doc_id = 1").agg(F.sum("size")).first()[0] == len(matroska.padded(next(t for i, t in texts_of(docs) if i == 1)))
    assert {r.lacing for r in packets.select("lacing").distinct().collect()} >= {"xiph", "ebml", "fixed", "none"}
    assert matroska.media_digest(docs.limit(0)).count() == 0


def test_matroska_by_hand():
    """Bytes written by hand: unknown sizes, a block group, EBML lacing with a falling size."""
    block = b"\x81\x00\x05\x06\x02" + b"\x83" + b"\xbe" + b"aaabbcccc"  # sizes 3, 2, 4
    group = b"\xa0" + matroska.size_vint(len(block) + 2) + b"\xa1" + matroska.size_vint(len(block)) + block
    cluster = bytes.fromhex("1f43b675") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + b"\xe7\x81\x0a" + group
    media = matroska.element(matroska.EBML, b"") + bytes.fromhex("18538067") + b"\xff" + cluster
    got = [(media[p.start : p.start + p.size], p.timestamp_ns, p.keyframe) for p in matroska.parse(media)]
    assert got == [(b"aaa", 15_000_000, False), (b"bb", 15_000_000, False), (b"cccc", 15_000_000, False)]


def test_toxicity(spark, sf):
    rng = np.random.default_rng(2)
    clean = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1200):
        bad = k % 6 == 0
        words = list(rng.choice(clean, 60)) + (["vileword", "nastything"] if bad else [])
        rows.append((k, " ".join(words)))
        labels.append((k, 1 if k % 5 else 0, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels[:1000], (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    wrong = sum(got[k].toxic != bool(labels[k][2]) for k in range(1000, 1200))
    assert wrong <= 2 and not got[5000].toxic and not got[None].toxic
    assert {r.doc_id for r in toxicity.without_toxic(docs, known).collect()} == {k for k, r in got.items() if not r.toxic}
    assert toxicity.toxicity(docs.limit(0), known).count() == 0
    assert not any(r.toxic for r in toxicity.toxicity(docs.limit(5), known.limit(0)).collect())


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "b <|im_end|>\n&lt;|"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, None, None, "x"),
        (3, 0, "us<|er\n", "<|im_start|>user\nhi<|im_end|>\n"), (4, 0, "user", "x" * 100_000), (4, 1, "assistant", ""),
    ]
    turns = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string, state string")
    got = {r.conv_id: r for r in chat.chat_digest(turns).collect()}
    assert set(got) == {1, 2, 3, 4, None, -1}
    for conv, r in got.items():
        own = [x for x in [*rows, (-1, 0, "user", chat.CONTROL_CASE), (-1, 1, "assistant", chat.CONTROL_CASE)] if x[0] == conv]
        own = sorted((t, ro or "", te or "") for _, t, ro, te in own) if conv is not None else [(None, "", "x")]
        learnt = "".join(te for _, ro, te in own if ro == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{te}\n" for _, ro, te in own).encode()).hexdigest()
        assert r.loss_chars == len(learnt) and r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, None: False, -1: True}
    assert chat.format_chats(turns.limit(0)).count() == 0


def plain_fingerprint(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tree", [2048, 3])
def test_simhash(docs, spark, sf, tree, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", tree)
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 11")
    every = docs.select("doc_id", "text").union(some)
    got = simhash.simhash_components(every).collect()
    fps = [int(r.fingerprint, 16) for r in got]
    plain = {(i, t): plain_fingerprint(t, 3) for i, t in texts_of(docs)}
    assert sorted(plain[i, t] for i, t in texts_of(docs)) == sorted(plain_fingerprint(t, 3) for _, t in texts_of(docs))
    assert sorted(fps) == sorted(plain_fingerprint(t, 3) for _, t in texts_of(every))
    root = groups_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    low = {}
    for r, k in zip(got, root):
        if r.doc_id is not None:
            low[k] = min(low.get(k, r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [low.get(k) for k in root]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_keep_one(docs, spark, sf, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 11")
    every = docs.select("doc_id", "text").union(some)
    rows = sorted(texts_of(every), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [set(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for _, t in rows]
    root = groups_of(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = simhash.keep_one(every).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(rows[k][0]) for k in set(root))
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs.limit(0)).count() == 0


def test_bpe(docs, spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    with open(vocabulary_path(), encoding="utf-8") as f:
        own = bpe.Encoder(bpe.Vocabulary(f.read()))
    rng = np.random.default_rng(1)
    texts = [t or "" for _, t in texts_of(docs)] + ["it's I'M ſ <|startoftext|>x", "áé ẛ̣", "١٢٣ Ⅷ ½ 漢字 한국어 👍🏽", "a\x85b\xa0c\x1cd", "etao" * 300]
    for _ in range(400):
        pick = rng.integers(0, 4, rng.integers(1, 30))
        texts.append("".join(chr(int(rng.integers(*((32, 127), (0, 0x300), (0x300, 0xD7FF), (0x10000, 0x1F9FF))[p]))) for p in pick))
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    got = bpe.bpe_digest(docs, vocabulary_path()).collect()
    assert len(got) == docs.count() and bpe.bpe_digest(docs.limit(0), vocabulary_path()).count() == 0
    assert bpe.encode_documents(docs, vocabulary_path()).where("doc_id = 4").first().ids == b""


@pytest.mark.parametrize("size", [1 << 24, 6000])
def test_embeddings(spark, sf, size, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", size)
    base = spark.read.parquet(f"{sf}/embeddings.parquet").limit(300)
    odd = [(None, [1.0] * 64, 1), (None, [1.0] * 64, 1), (9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] + [1.0] * 63, 1), (9004, [], 2), (9005, [1.0, 2.0], 2), (9006, [2.0, 4.0], 2), (9007, [1.0] * 64, None), (-3, [2.0] * 64, 1), (9008, [None, 1.0], 2)]
    rows = base.union(base.limit(4)).union(spark.createDataFrame(odd, base.schema)).withColumn("node", F.lit("x")).withColumn("key", F.lit("y"))
    plain = rows.collect()
    good = [r.label is not None and bool(r.embedding) and None not in r.embedding and bool(np.isfinite(r.embedding).all()) and any(r.embedding) for r in plain]
    unit = [np.array(r.embedding, float) / np.linalg.norm(r.embedding) if g else None for r, g in zip(plain, good)]
    near = lambda i, j: good[i] and good[j] and plain[i].label == plain[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93
    root = groups_of(len(plain), near)
    links = [sum(near(i, j) for j in range(len(plain)) if j != i) for i in range(len(plain))]
    low = {}
    for r, k in zip(plain, root):
        if r.vec_id is not None:
            low[k] = min(low.get(k, r.vec_id), r.vec_id)
    want = sorted((str(r.vec_id), n, str(low.get(k))) for r, k, n in zip(plain, root, links))
    for searches in (8, 1):
        monkeypatch.setattr(hnsw, "SEARCHES", searches)
        got = hnsw.embedding_components(rows).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert hnsw.embedding_components(rows.limit(0)).count() == 0


def test_embedding_graph_finds_sparse_links():
    """A graph of 6,000 vectors of which one in twenty has one link: recall by brute force, self-links aside."""
    rng = np.random.default_rng(11)
    own = hnsw.unit(rng.standard_normal((6000, 48)))
    own[5700:] = hnsw.unit(own[:300] + 0.25 / np.sqrt(48) * rng.standard_normal((300, 48)))
    shard = hnsw.Shard(np.arange(6000), np.ones(6000, np.int64), own, 0.93)
    q, p = shard.links(own)
    found = {(a, b) for a, b in zip(q.tolist(), p.tolist()) if a != b}
    truth = {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(own @ own.T >= 0.93))) if a != b}
    assert len(truth) > 300 and found <= truth and len(found) >= 0.98 * len(truth)
    foreign = hnsw.unit(own[:200] + 0.1 / np.sqrt(48) * rng.standard_normal((200, 48)))
    shard.audit(np.arange(10_000, 10_200), foreign)
    assert len(shard.links(foreign)[0]) >= 0.98 * np.count_nonzero(foreign @ own.T >= 0.93)


def test_mix_tells_rows_of_one_id_apart(spark):
    rows = [(None, f"text {k} of three", ("a", "b")[k % 2]) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.target] = taken.get(r.target, 0) + r.taken
    assert len(taken) == 2 and all(abs(n - target) <= 8 for target, n in taken.items())
    clash = docs.withColumn("mix_time", F.lit(1)).withColumn("h", F.lit(2)).withColumn("p_toxic", F.lit(3.0))
    assert mixing.mixed_documents(clash).columns == clash.columns and mixing.mixed_documents(clash).count() > 0


def test_mixing(docs, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 50))").alias("text"), F.expr("concat('s', id % 7)").alias("source"))
    rows = mixing.mix(big).collect()
    assert rows and sorted(rows) == sorted(mixing.mix(big.repartition(5)).collect())
    size, target, taken = {}, {}, {}
    for r, s in ((r, r.doc_id % 7) for r in rows):
        size[s], target[s], taken[s] = r.source_size, r.target, taken.get(s, 0) + r.taken
        assert r.size == 1 + r.doc_id % 50 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    weights = {s: (1, 2, 3)[s % 3] for s in size}
    capped, total = set(), sum(size.values())
    while True:  # the excess goes to the others until none is above
        free = total - sum(3 * size[s] for s in capped)
        level = free / sum(weights[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and level * weights[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in size:
        assert target[s] == pytest.approx(3 * size[s] if s in capped else level * weights[s])
        assert abs(taken[s] - target[s]) <= 50
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_capped_targets(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.capped_targets(totals, (1.0, 2.0, 3.0), 3).collect()}
    assert got == {"a": 960.0, "b": 30.0, "c": 30.0, None: 0.0}


def test_line_hash_majority(spark):
    rows = [(k, [xxhash.xxh64_intdigest(str((k, j)).encode()) - (1 << 63) for j in range(n)]) for k, n in enumerate((1, 2, 3, 60, 126, 127, 128, 129, 40_000))]
    got = spark.createDataFrame(rows, "k long, h array<long>").select("k", lines.simhash(F.col("h")).alias("s")).collect()
    for r in got:
        own = rows[r.k][1]
        assert r.s & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))


def test_lines(docs, spark):
    got = {}
    for r in lines.line_digest(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.n_kept for r in got[1]] == [100] and {r.n_kept for r in got[2]} == {0} and got[3][0].n_kept == 0
    assert got[11][0].removed == "1" and got[5][0].n_lines == 0 and got[4][0].n_kept == 1 and got[8][0].n_kept == 2
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[11].text == "one two three four five six" and kept[11].n_chars == 27 and kept[2].text == "" and kept[5].text is None
    assert lines.line_digest(docs.limit(0)).count() == 0
    words = [f"word{k}" for k in range(60)]
    far = [(1, " ".join(words)), (2, " ".join(words[:20] + ["other"] + words[21:])), (3, " ".join(f"x{k}" for k in range(60)))]
    assert {r.doc_id: r.n_kept for r in lines.line_digest(spark.createDataFrame(far, "doc_id long, text string")).collect()} == {1: 1, 2: 0, 3: 1}


def test_line_blocks_find_every_fingerprint_in_reach(spark):
    rng = random.Random(3)
    fps = [rng.randrange(1 << 64) for _ in range(40)]
    fps += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in fps] + [fps[0] ^ 7]
    rows = spark.createDataFrame([(k, simhash.signed(f)) for k, f in enumerate(fps)], "k long, fp long")
    keys = {r.k: set(r.keys) for r in rows.select("k", F.array(*lines.block_keys(F.col("fp"))).alias("keys")).collect()}
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            assert bool(keys[i] & keys[j]) or (a ^ b).bit_count() > lines.RADIUS


@pytest.mark.parametrize("sizes, least", [(range(4, 16), 1.0), ([*range(16, 31), 45, 60, 70, 100], 0.9)])
def test_lines_find_similar(spark, sizes, least):
    """Of the groups that brute force makes of word-level similarities of 0.8 or more, with variants of one edit up to a
    fifth of all words: every one of lines under 16 words is found, and nine in ten of the variants of longer ones."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    made = []
    for n in sizes:
        base = [words[int(300 * rng.random() ** 3)] for _ in range(n)]
        made.append(base)
        for edits in {1, n // 5}:
            line = list(base)
            for k in rng.sample(range(n), edits):
                line[k] = f"new{rng.randrange(10**9)}"
            made.append(line)
        made.append([*base[: n // 2], "put", *base[n // 2 :]])
        made.append(base[1:])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = [(i, j) for i, a in enumerate(made) for j, b in enumerate(made[:i]) if 5 * distance(a, b) <= max(len(a), len(b))]
    group = list(range(len(made)))
    for i, j in near:
        old, new = group[i], group[j]
        group = [new if g == old else g for g in group]
    docs = spark.createDataFrame([(k, " ".join(m)) for k, m in enumerate(made)], "doc_id long, text string")
    kept = sum(r.n_kept for r in lines.line_digest(docs).collect())
    right = len(set(group))
    assert right <= kept <= right + (1 - least) * (len(made) - right)


def test_lines_around_a_common_passage(spark, monkeypatch):
    """Long lines that repeat a passage and aren't similar: no table of pairs grows with the square of their number."""
    rng, passage, rows = random.Random(11), [f"p{k}" for k in range(60)], {}
    made = [[*passage, *(f"w{rng.randrange(4000)}" for _ in range(300))] for _ in range(80)]
    made.append([*made[0][:200], "edited", *made[0][201:]])
    real = lines.materialize

    def counted(df, name, *args, **named):
        out = real(df, name, *args, **named)
        if name in ("line-rest", "line-pairs"):
            rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    docs = spark.createDataFrame([(k, " ".join(m)) for k, m in enumerate(made)], "doc_id long, text string")
    assert {r.doc_id for r in lines.line_digest(docs).collect() if r.n_kept == 0} == {80}
    assert "line-rest" in rows and max(rows.values()) <= 4 * len(made)


def test_similar_lines_share_a_rare_word(spark):
    rng, made = random.Random(7), []
    for k, n in enumerate([*range(4, 40), 80, 200] * 3):
        base = [int(40 * rng.random() ** 2) if k % 2 else rng.randrange(500) for _ in range(n)]
        other = list(base)
        for at in rng.sample(range(n), n // 5):
            other[at] = -rng.randrange(10**6) if rng.random() < 0.6 else base[0]
        made += [(2 * k, n, sorted(set(base))), (2 * k + 1, n, sorted(set(other)))]
    got = {r.id: set(r.rare) for r in lines.rare_words(spark.createDataFrame(made, "id long, n int, words array<long>")).select("id", "rare").collect()}
    assert len(got) == len(made) and all(got[2 * k] & got[2 * k + 1] for k in range(len(made) // 2))


def test_line_links_are_grouped_alike_on_the_driver_and_in_spark(spark, monkeypatch):
    rng = random.Random(2)
    links = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "u long, v long").where("u <> v")
    here = {tuple(r) for r in lines._groups(links, "t").collect()}
    monkeypatch.setattr(lines, "FEW", 0)
    assert here == {tuple(r) for r in lines._groups(links, "t").collect()}
    assert lines._groups(links.limit(0), "t").count() == 0


def test_line_hash_of_few_features(spark):
    rows = [(n, [xxhash.xxh64_intdigest(str((n, j)).encode()) - (1 << 63) for j in range(n)]) for n in range(1, 2 * lines.FEATURES)]
    for r in spark.createDataFrame(rows, "k long, h array<long>").select("k", "h", lines.simhash(F.col("h")).alias("s")).collect():
        assert r.s & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))


def test_lines_are_normalised_as_their_words_are(spark):
    rng = random.Random(13)
    signs = [chr(c) for c in range(1, 128) if c != 10] + [" "] * 60 + ["\n"] * 20 + list("\u00c4\u03a3\u0130\u4e2d\U0001f600\u2028\u0085\u00a0")
    texts = ["", " ", "\n", "a\n", "\n a", "A  b . c\td", "\u03a3\u03a3\n\u03a3"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    between = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"
    words = F.transform(F.split("text", "\n", -1), lambda x: F.array_join(F.array_remove(F.split(F.lower(x), between), ""), " "))
    for r in made.select("text", F.transform(lines.norms_of(F.col("text")), lambda x: F.trim(x)).alias("got"), words.alias("right")).collect():
        assert r.got == r.right


def test_lines_alone_at_their_length_leave_their_buckets(spark):
    rng = random.Random(17)
    sizes = [*range(4, 40), 100, 126, 500, 4000, 5000, 9000]
    made = lines.with_id(spark.createDataFrame([(n,) for n in sizes], "n int").coalesce(1)).collect()
    assert len({r.id for r in made}) == len(made) and all(r.id > 0 for r in made)
    rows = [(b, r.id, r.n) for b in range(200) for r in rng.sample(made, rng.randrange(1, 5))]
    near = lambda a, b: abs(a - b) <= (min(max(a, b), lines.MOST_WORDS) + 1e-6) // 5 or min(a, b) >= lines.MOST_WORDS
    right = {(b, i) for b, i, n in rows if any(b == c and i != j and near(n, m) for c, j, m in rows)}
    got = [tuple(r) for r in lines.in_company(spark.createDataFrame(rows, "bucket long, id long, n int").select("bucket", "id")).collect()]
    assert right <= set(got) and len(got) == len(set(got))
    assert all(any(b == c and i != j and 5 * (max(n, m) - min(n, m)) <= max(n, m) + 5 for c, j, m in rows) for b, i, n in rows if (b, i) in set(got) and n < 4000)


def test_buckets_of_the_same_lines_are_one(spark, monkeypatch):
    """Similar lines share most of their features; their pair is made from one bucket, not from each of them."""
    rows, real = {}, lines.materialize

    def counted(df, name, *args, **named):
        out = real(df, name, *args, **named)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    words = [f"w{k}" for k in range(15)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:14], "other"])), (3, "one two three four five six")], "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in lines.line_digest(docs).collect()} == {1: 1, 2: 0, 3: 1}
    assert rows["line-shared"] == rows["line-told"] == 2


def test_distinct_lines_are_made_in_parts(spark, monkeypatch):
    """No shuffle holds all lines' texts: parts by hash, ids that differ, and similar lines of different parts still link."""
    made, real = {}, lines.materialize

    def kept(df, name, *args, **named):
        out = real(df, name, *args, **named)
        if name in ("line-unique", "line-candidates"):
            made.setdefault(name, []).append([r.id for r in out.select("id").collect()])
        return out

    monkeypatch.setattr(lines, "materialize", kept)
    words = [[f"w{k}x{j}" for j in range(10)] for k in range(40)]
    rows = [(2 * k, " ".join(w)) for k, w in enumerate(words)] + [(2 * k + 1, " ".join([*w[:9], "other"])) for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_kept == (r.doc_id + 1) % 2 for r in lines.line_digest(docs).collect())
    for parts in made.values():
        assert len(parts) == lines.PARTS > 1 and all(20 < len(x) < 60 for x in parts) and len({i for x in parts for i in x}) == 80


def test_lines_are_cut_with_their_number(docs, spark):
    """A row for each line and the number of a text's lines beside; null text has one row and no lines."""
    with common.scratch():
        rows = lines.cut_lines(docs).select("doc_id", "n_lines", "pos").collect()
    texts = docs.select("doc_id", "text").collect()
    right = sorted((str(r.doc_id), r.text.count("\n") + 1, k) for r in texts if r.text is not None for k in range(r.text.count("\n") + 1))
    assert sorted((str(r.doc_id), r.n_lines, r.pos) for r in rows if r.pos is not None) == right
    assert [(r.n_lines) for r in rows if r.pos is None] == [0] * sum(r.text is None for r in texts)
