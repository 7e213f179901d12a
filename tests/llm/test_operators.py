"""Operators on small tables: brute force, round trips, nulls, empty tables, repeated rows and clashing names."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate, html, language, media, near_dedup, order, packing, pii, queries, shard, substring_dedup, tokens

RNG = random.Random(11)
WORDS = {"en": "the of and that with from this have which there".split(), "de": "der die und nicht eine auch über für schön großen".split()}


def _prose(lang, n):
    return " ".join(RNG.choice(WORDS[lang]) + RNG.choice(["", "ing", "x", "er"]) + str(RNG.randint(0, 9)) for _ in range(n))


PASSAGE = _prose("en", 60)
BASE = _prose("en", 120)
TEXTS = [_prose("en", 80) for _ in range(12)] + [_prose("de", 80) for _ in range(12)]
TEXTS += [None, "", " \n\t ", "1 2 3", "short text", BASE, BASE, BASE.replace(" ", "  ", 1), BASE + " tail", "one " + BASE]
TEXTS += [_prose("en", 20) + " " + PASSAGE + " " + _prose("en", 20), PASSAGE, "mail a.b@c.org, call +49 (30) 123-4567 8 or 4111 1111 1111 1111 at 10.0.0.1 and 10.0.0.300", _prose("de", 3000)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, BASE)]
ITEM = " ".join(PASSAGE.split()[10:30])


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that clash with those of the operators."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", F.lit(1).alias("found"), F.lit(2).alias("n_words"), F.lit("x").alias("_key"), F.lit("y").alias("spans"), F.lit("z").alias("language")).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "!!"), (None, ITEM)], "item_id long, text string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_decontamination(docs, bench, none):
    got = decontaminate.find(docs, bench, "hit").select("text", "hit.*").collect()
    for r in got:
        assert (r["n_hit"] == 20 and r["item_ids"] == ["7"]) == (PASSAGE in (r["text"] or "")) and (r["n_hit"] > 0) == bool(r["item_ids"])
        for s in r["spans"]:
            assert r["text"][s["start"] : s["end"]] == ITEM
    blocks = decontaminate.find(docs, bench, "hit", block_bytes=100).select("hit.n_hit", "text").collect()
    assert sorted((r["n_hit"], r["text"] or "") for r in blocks) == sorted((r["n_hit"], r["text"] or "") for r in got)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(ROWS) and decontaminate.find(none, bench, "hit").count() == 0


def test_substring_dedup(docs, none):
    got = substring_dedup.dedup(docs.select("doc_id", "text"), window=6, gram=3, bucket_bytes=4000).collect()
    split = [re.split(r"[\x20\t-\r]+", (t or "").strip(" \t\n\v\f\r")) if (t or "").strip(" \t\n\v\f\r") else [] for _, t in ROWS]
    count = {}
    for w in split:
        for i in range(len(w) - 5):
            count[tuple(w[i : i + 6])] = count.get(tuple(w[i : i + 6]), 0) + 1
    want = []
    for (i, _), w in zip(ROWS, split):
        gone = {k for a in range(len(w) - 5) if count[tuple(w[a : a + 6])] > 1 for k in range(a, a + 6)}
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(want)
    clash = substring_dedup.dedup(docs)
    assert clash.columns == [*docs.columns, "kept_text", "n_words_", "n_removed"] and substring_dedup.dedup(none).count() == 0


def test_media(docs, none):
    index, folder = media.store(docs, shard_bytes=20_000)
    found = media.load(media.metadata(media.places(index), folder), folder)
    rows = media.described(index, found).collect()
    by_digest = {media.hashlib.sha256(media.payload((t or "").encode())).hexdigest(): (t or "").encode() for _, t in ROWS}
    assert len(rows) == len(ROWS)
    for r in rows:
        raw = by_digest[r["payload_sha256"]]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["digest"] == r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["n_bytes"] == len(raw) and r["payload_bytes"] == len(padded) and r["tail_crc32"] == zlib.crc32(padded[-64:])
        # The stored member, read and decoded without the store's own code.
        with open(f"{folder.removeprefix('file://')}/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            png = f.read(r["length"])
        assert png[:8] == b"\x89PNG\r\n\x1a\n" and r["media_sha256"] == hashlib.sha256(png).hexdigest()
        body = zlib.decompress(png[41 : 41 + int.from_bytes(png[33:37], "big")])
        assert b"".join(body[k + 1 : k + 65] for k in range(0, len(body), 65)) == padded
        columns = [sum(padded[k::64]) for k in range(64)]
        mark = sum(1 << k for k in range(64) if columns[k] * 64 > sum(columns))
        assert r["feature"] == f"64x{len(padded) // 64};min={min(padded)};max={max(padded)};sum={sum(padded)};distinct={len(set(padded))};mark={mark:016x}"
        assert (r["width"], r["height"], r["bits"]) == (64, len(padded) // 64, 8)
    assert len({(r["digest"], r["shard"], r["offset"]) for r in rows}) == len(by_digest)
    assert media.described(media.store(none)[0], found.limit(0)).count() == 0


def test_sharding(docs, none):
    rows = shard.shard(docs, 4).collect()
    assert len(rows) == len(ROWS) and sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    group = {}
    for r in rows:
        group.setdefault(r["text_key"], set()).add(r["shard"])
    assert all(len(g) == 1 for g in group.values()) and shard.shard(none).count() == 0


def test_large_group_is_dealt(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(600)] + [(1000 + i, f"t{i}" * 3) for i in range(300)], "doc_id long, text string")
    load = {r[0]: r[1] for r in shard.shard(df, 8).groupBy("shard").agg(F.sum("size")).collect()}
    assert len(load) == 8 and max(load.values()) < 1.3 * min(load.values())


def test_training_order(docs, none, tmp_path):
    folder = f"file://{tmp_path}/order"
    index = order.write_in_training_order(docs, folder, length=64, shard_bytes=64 * 2 * 7).collect()
    assert sorted(r["slot"] for r in index) == list(range(len(index)))
    encode, whole = tokens.encoder(tokens.default_path()), {}
    for r in index:
        assert (r["shard"], r["index"], r["offset"]) == (r["slot"] // r["capacity"], r["slot"] % r["capacity"], r["slot"] % r["capacity"] * r["stride"]) and r["capacity"] == 7
        raw = order.read_sequence(folder, r["shard"], r["index"], 64)
        assert zlib.crc32(raw.tobytes()) == r["ids_crc32"] and not raw[r["n_ids"] :].any()
        ids, stops = raw[: r["n_ids"]].tolist(), [*r["starts"]]
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            # A document's ids end with the end id, unless the sequence ends first.
            n = ids.index(0) + 1 if 0 in ids else len(ids)
            n = len(ids) if k == len(stops) - 1 else n
            whole.setdefault(doc, []).append((start, tuple(ids[:n])))
            ids = ids[n:]
    for doc in {i for i, _ in ROWS}:
        texts = [[*encode(t or "").tolist(), 0] for i, t in ROWS if i == doc]
        parts = sorted(whole[doc])
        if len(texts) == 1:
            assert [x for _, p in parts for x in p] == texts[0] and [a for a, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
        else:
            assert sorted(x for _, p in parts for x in p) == sorted(x for t in texts for x in t)
    assert order.write_in_training_order(none).count() == 0


def test_shards_are_shuffled_in_turns(spark, docs, tmp_path, monkeypatch):
    """No turn takes more than about a third of the sequences, and each turn's shuffle is gone when the next one starts."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = local.getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().endswith(".data"))

    seen, keep = [], order.materialise

    def watched(df, name):
        before = shuffled()
        out = keep(df, name)
        if name == "order-index":
            n, until = out.count(), time.time() + 20
            while shuffled() > before and time.time() < until:  # files are deleted in the background
                time.sleep(0.1)
            seen.append((n, shuffled() - before))
        return out

    monkeypatch.setattr(order, "materialise", watched)
    old = spark.conf.get(order.DROPPED, None)
    index = order.write_in_training_order(docs, f"file://{tmp_path}/order", length=64, shard_bytes=64 * 2 * 7).collect()
    assert sum(n for n, _ in seen) == len(index) and max(n for n, _ in seen) <= len(index) / 3 + 7
    assert all(left <= 0 for _, left in seen) and spark.conf.get(order.DROPPED, None) == old


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    encode = tokens.encoder(tokens.default_path())
    want = sorted((str(i), tuple([*encode(t or "").tolist(), 0])) for i, t in ROWS)
    whole, used = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        whole.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], ids))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (i, n), parts in whole.items():
        full = [ids for d, ids in want if d == i and len(ids) == n]
        assert sorted(x for _, p in parts for x in p) == sorted(x for ids in full for x in ids)
    for parts in used.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_near_duplicates(spark, docs, none):
    members, links = near_dedup.near_duplicates(docs)
    table = near_dedup.idf_table(*near_dedup.frequencies(docs), near_dedup.STRENGTH)
    sets = {}
    for t in {t for _, t in ROWS if t is not None}:
        _, h, tf = near_dedup.shingles([t.encode()])
        sets[t] = (h, near_dedup.weights(h, tf, table))
    parent = {t: t for t in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and near_dedup.similarity(sets[a], sets[b]) >= 0.8:
                parent[find(a)] = find(b)
    text_of = dict(ROWS)
    least = {}
    for i, t in ROWS:
        if t is not None and i is not None:
            least[find(t)] = min(i, least.get(find(t), i))
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in members.collect())
    want = sorted((str(i), str(i if t is None else least[find(t)])) for i, t in ROWS)
    assert got == want and text_of and all(r["similarity"] >= 0.8 for r in links.collect())
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, t in ROWS if t is None} | set(least.values()))
    assert near_dedup.near_duplicates(none)[0].count() == 0
    split, _ = near_dedup.near_duplicates(docs, large=2)
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in split.collect()) == want


def test_near_duplicates_beyond_the_first_pass(spark):
    """Chains of texts that share a bucket with texts under the threshold, with a first pass that finds almost nothing."""
    line = [f"w{k * 7919 % 10007}" for k in range(900)]
    starts = [0, 10, 20, 30, 65, 75, 85, 120, 130, 165, 200, 210, 245, 280, 290, 300]
    texts = [" ".join(line[a : a + 200]) for a in starts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    table = near_dedup.idf_table(*near_dedup.frequencies(docs), near_dedup.STRENGTH)
    sets = []
    for t in texts:
        _, h, tf = near_dedup.shingles([t.encode()])
        sets.append((h, near_dedup.weights(h, tf, table)))
    want = list(range(len(texts)))
    for _ in texts:
        for i in want:
            for j in want:
                if near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                    want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    got = near_dedup.near_duplicates(docs, close=0.0, links=1)[0].collect()
    assert [r["class_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == want and 1 < len(set(want)) < len(texts)


def test_copies_are_sketched_whatever_is_kept(spark, monkeypatch):
    """Copies in later chunks, with no sketch kept from one chunk to the next."""
    monkeypatch.setattr(near_dedup, "KEPT_SKETCHES", 0)
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", 300)
    line = [f"w{k * 7919 % 10007}" for k in range(60)]
    texts = [" ".join(line), *(f"other {k} text of its own {k * k}" for k in range(20)), " ".join(line), *(f"more {k} of text here {k * k}" for k in range(20)), " ".join([*line, "tail"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    run = near_dedup._sketch(type("Sent", (), {"value": near_dedup.idf_table(*near_dedup.frequencies(docs), near_dedup.STRENGTH)}), near_dedup.BANDS, near_dedup.ROWS)
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["node", "doc_id", "text"])
    found = next(run(iter([batch]))).to_pylist()
    assert all(r["bands"] for r in found) and found[0]["bands"] == found[21]["bands"]


def test_near_duplicates_that_share_one_hot_bucket_only(spark):
    """Two families in buckets above ``large``, whose members have no other band to meet in."""
    base = [" ".join(f"w{k * 7919 % 10007}" for k in range(a, a + 150)) for a in (0, 5000)]
    docs = spark.createDataFrame([(i, base[i % 2] + f" tail{i}") for i in range(24)], "doc_id long, text string").repartition(4)
    whole, parted = ({r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, bands=1, rows=1, large=n)[0].collect()} for n in (20_000, 5))
    assert whole == parted and len(set(whole.values())) < 6
    small = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, bands=1, rows=1, block_bytes=2000)[0].collect()}
    assert small == whole
    # Classes of a bucket, one over several blocks, and the pairs of members that meet.
    rows = [("a" if i < 9 else f"c{i}", f"n{i}") for i in range(16)]
    hot = spark.createDataFrame([(1, f.encode(), n.encode(), b"", 1) for f, n in rows], "bucket long, first binary, node binary, signature binary, bytes long")
    met = {}
    for r in near_dedup.blocks(hot, 3).collect():
        met.setdefault(r["bucket"], []).append((bytes(r["first"]).decode(), bytes(r["node"]).decode()))
    for x in rows:
        for y in rows:
            assert x[0] == y[0] or any(x in m and y in m for m in met.values())
    assert not any({f for f, _ in m} == {"a"} for m in met.values())


def _jobs(spark, name, run):
    """What ``run`` returns, and the jobs it took, with 40 shuffle partitions that are left apart."""
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(name, name)
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("joined", [500_000, 60, 0])
def test_components(spark, monkeypatch, joined):
    """Chains, stars and repeated edges: joined in one task, after some rounds, and by rounds alone."""
    rng = random.Random(3)
    names = [hashlib.md5(str(i).encode()).digest() for i in range(400)]
    pairs = [(i, i + 1) for i in range(0, 120)] + [(200, i) for i in range(201, 240)] + [(rng.randrange(250, 400), rng.randrange(250, 400)) for _ in range(70)]
    pairs = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in pairs if a != b] + [(0, 1)]
    root = {i: i for pair in pairs for i in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b], key=lambda i: names[i])
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a binary, b binary").repartition(5)
    monkeypatch.setattr(near_dedup, "JOINED_EDGES", joined)
    got, jobs = _jobs(spark, f"components-{joined}", lambda: near_dedup.components(edges).collect())
    assert {bytes(r["node"]): bytes(r["root"]) for r in got} == {names[i]: names[r] for i, r in root.items()} and len(got) == len(root)
    assert joined < 500_000 or jobs <= 8


def test_components_of_none(spark):
    assert near_dedup.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_small_results_take_few_jobs(spark, docs):
    """A result of some rows comes to the driver in few jobs, however many partitions a shuffle has."""
    (df, n), jobs = _jobs(spark, "frequencies", lambda: near_dedup.frequencies(docs, 1 << 16))
    assert n == len(ROWS) and df.sum() > 0 and jobs <= 20
    labelled = docs.select("text", F.when(F.col("text").contains("der"), "de").otherwise("en").alias("lang"))
    model, jobs = _jobs(spark, "fit", lambda: language.fit(labelled))
    assert model.languages == ["de", "en"] and jobs <= 12
    pieces, jobs = _jobs(spark, "pack", lambda: packing.pack(docs.select("doc_id", "text")))
    assert pieces.columns and jobs <= 20


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "<body><article><p>Some text, here.</p></article></body>", 1), (2, None, 1), (3, "", 1), (1, "<p>", 1)], "page_id long, html string, text int")
    got = sorted((r["page_id"], r["main_text"]) for r in html.extract(pages).collect())
    assert got[1] == (1, "Some text, here.") and got[2:] == [(2, ""), (3, "")] and html.extract(pages.limit(0)).count() == 0


def test_language(spark, docs, none):
    labelled = spark.createDataFrame([(_prose(x, 60), x) for x in ("en", "de") for _ in range(30)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(labelled)
    got = {r["text"]: r["l"] for r in language.identify(docs, model, "l").collect()}
    for t in TEXTS[:24]:
        assert got[t]["lang_pred"] == ("en" if t in TEXTS[:12] else "de")
    assert [got[t]["lang_pred"] for t in (None, "", "1 2 3")] == ["und"] * 3
    mixed = TEXTS[0] + " " + TEXTS[20]
    spans = language.label_texts(model, [mixed])[0]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[1]["start"] - len(TEXTS[0])) < 30
    assert language.known(docs, model).columns == docs.columns and language.identify(none, model, "l").count() == 0
    assert language.fit(labelled.limit(0)).languages == []


def test_pii(spark, docs, none):
    rows = pii.find(docs, "pii").collect()
    hit = next(r for r in rows if (r["text"] or "").startswith("mail"))
    assert [(s["kind"], s["value"]) for s in hit["pii"]] == [("email", "a.b@c.org"), ("phone", "+49 (30) 123-4567 8"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")]
    assert all(hit["text"][s["start"] : s["end"]] == s["value"] for s in hit["pii"])
    assert sum(len(r["pii"]) for r in rows) == 4 and pii.find(none, "pii").count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[TEXTS.index(hit["text"])] == "mail <EMAIL>, call <PHONE> or <CARD> at <IP> and 10.0.0.300" and clean[0] == TEXTS[0]


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _plain_spans(text):
    """The base spans by the plain patterns of the contract."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_base_spans_and_redaction_match_plain_patterns(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("a@.b-1 2+34().9%_\n5é-0😀") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("0123456789") + rng.choice(["", "", " ", "-", "."]) for _ in range(rng.randint(10, 24))) for _ in range(3000)]
    texts += [" ".join(rng.choice([f"u{i}@h.com", f"10.0.{i % 300}.1", f"w{i}é", "+49 (30) 123-456 7", "4111 1111 1111 1111"]) for i in range(3000)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    spans = pii.in_order(pii.base_spans(F.col("text")))
    for r in df.select("i", pii.listed(spans).alias("x"), pii.redacted(F.col("text"), spans).alias("clean")).collect():
        text, want = texts[r["i"]], _plain_spans(texts[r["i"]])
        assert (r["x"] or "") == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        at, out = 0, ""
        for a, _, b, k in want:
            out += text[at:a] + f"<{k.upper()}>" if a >= at else ""
            at = max(at, b)
        assert r["clean"] == (None if text is None else out + text[at:])


def test_disclosing_terms(spark):
    rows = [(i, f"{_prose('en', 5)} zorblax writes to boss@corp.org often {i}") for i in range(8)] + [(100 + i, _prose("en", 30)) for i in range(200)] + [(900, "zorblax was seen")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term" in got[900] and "term" in got[0] and not got[100]


def test_terms_of_few_texts_and_far_away(spark):
    """Entities of one and of two texts, with a term near and one beyond 80 code points."""
    far = " " + _prose("en", 40) + " "
    rows = [(0, "quixel asked"), (1, f"vandermeer{far}rare@corp.org quixel"), (2, f"wolfgramm pair@corp.org{far}"), (3, f"pair@corp.org{far}wolfgramm")]
    rows += [(100 + i, _prose("en", 30) + f" {i}") for i in range(700)] + [(900 + i, f"quixel saw {_prose('en', 3)} {i}") for i in range(20)]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {k: {r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"} for k, r in found.items()}
    assert "vandermeer" in terms[1] and "wolfgramm" in terms[2] and "wolfgramm" in terms[3]
    assert not any("quixel" in t for t in terms.values()) and not terms[100]


def test_terms_beyond_a_broadcast(spark, monkeypatch):
    """The same spans with all tables too large to broadcast: null texts, a hot text, a text with a term and no entity, a clashing name."""
    rows = [(i, "zorblax writes to boss@corp.org") for i in range(12)] + [(20 + i, None) for i in range(12)] + [(40, "zorblax was seen"), (41, ""), (42, "zorblax met boss@corp.org")]
    rows += [(1000 + i, f"{_prose('en', 2)} {i}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_n", F.lit(1)).withColumn("_terms", F.lit("x"))
    found = lambda: sorted((r["doc_id"], r["x"]) for r in pii.find(df, "x").select("doc_id", pii.listed(F.col("x")).alias("x")).collect())
    near = found()
    assert dict(near)[40] == "term:0:7" and dict(near)[0] == "term:0:7,email:18:31"
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(pii, "BROADCAST_HASHES", -1)
    assert found() == near


def test_pipeline(spark, bench, tmp_path):
    rows = [(i, t, "en" if i < 12 else "de", "s", len(t or "")) for i, t in ROWS if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    df, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.materialise(stage(spark, df, str(tmp_path)), name)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in df.collect()})
    letters = {i for i, t in ROWS if i is not None and any(c.isalpha() for c in t or "")}
    copies = {TEXTS.index(BASE) + k for k in range(1, 5)}
    leaks = {i for i, t in ROWS if PASSAGE in (t or "")}
    assert left == [letters, letters - copies, letters - copies - leaks, letters - copies - leaks]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == left[-1]


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert set(queries.queries()) >= {f"op{n}_" + q for n, q in ((1, "decontaminate"), (9, "pii"))}
    got = queries.op4_sharding(spark, sf)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    crc = {r["doc_id"]: r["text_crc32"] for r in got.collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert all(crc[r["doc_id"]] == zlib.crc32((r["text"] or "").encode()) for r in texts)
    held = queries.op8_language(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    own = [r for r in held if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in own]) > 0.9
    assert hashlib.sha256(b"").hexdigest() in {r["base_sha256"] for r in queries.op9_pii(spark, sf).collect()}
