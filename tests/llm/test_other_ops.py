"""Vectors, archives, classifier and pipeline against brute force and planted errors."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import __spark_entry__
import corpus_pipeline
from paylattice.llm import ann, queries, topk, toxicity, warc_zstd


def vectors(n: int = 400, width: int = 12) -> list[tuple]:
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (n, width)) * rng.uniform(0.1, 3, (n, 1))
    rows = [(i, [float(np.float32(v)) for v in x[i]], "s") for i in range(n)]
    rows += [(n + i, rows[7][1], "s") for i in range(60)]  # one vector many times
    rows += [(1000, None, "s"), (1001, [1.0, None, *[0.0] * (width - 2)], "s"), (1002, [float("nan")] * width, "s"), (1003, [float("inf")] * width, "s"),
             (1004, [0.0] * width, "s"), (None, rows[0][1], "s"), (1100, [1.0, 2.0], "s"), rows[3], rows[3], (1200, [], "s")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, score string").repartition(4).cache()


def usable_rows(zero: bool) -> tuple[np.ndarray, np.ndarray]:
    rows = {(i, tuple(v)) for i, v, _ in vectors() if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    rows = sorted(r for r in rows if zero or any(r[1]))
    full = np.zeros((len(rows), 12))
    for k, (_, v) in enumerate(rows):
        full[k, : len(v)] = v
    return np.array([r[0] for r in rows]), full


@pytest.mark.parametrize("block", [16_384, 60])
def test_top_k_is_exact(table, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "STEP", 16)
    ids, x = usable_rows(zero=True)
    x = np.floor(1024 * x).astype(np.int64)
    want = []
    for i in np.flatnonzero(ids % 100 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:10]
        want += [(ids[i], r + 1, ids[j], score[j]) for r, j in enumerate(order)]
    assert sorted(map(tuple, topk.every_hundredth(table).collect())) == sorted(want)


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.every_hundredth(few).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert topk.every_hundredth(few.where("false")).count() == 0
    assert ann.every_fiftieth(few.where("false")).count() == 0
    assert [(r.query_id, r.vec_id, r.score) for r in ann.every_fiftieth(few).collect()] == [(0, 1, 1.0)]


def test_neighbours_have_exact_scores_and_recall(table, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 16)
    ids, x = usable_rows(zero=False)
    got = {}
    for r in ann.every_fiftieth(table).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = ann.exact_cosines(np.repeat(x[i : i + 1], len(x), 0), x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:5]
        rows = sorted(got[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        at = {int(v): s for v, s in zip(ids, score, strict=True)}
        assert all(abs(at[r.vec_id] - r.score) < 1e-12 for r in rows)
        hits, total = hits + len({r.vec_id for r in rows} & {int(ids[j]) for j in order}), total + 5
    assert hits >= 0.9 * total


def test_graph_search_finds_the_nearest_centroids():
    x = ann.unit(np.random.default_rng(1).normal(0, 1, (500, 8)))
    graph = ann.Graph(x)
    order, _ = graph.search(x[:40], 64)
    assert (order[:, 0] == np.arange(40)).mean() > 0.95


PAGES = [(5, "http://a/\r\nX: y", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "u", ""), (8, "u", None), (1, "u", "é" * 5000), (2, "u", "é" * 5000),
         (2, "v", "é" * 5000), (None, "u", "only"), (None, "u", "only"), (None, "w", "<p>one</p>"), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (11, "u", "\x00" * 100)]


def test_pages_come_back_from_archives(spark):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, payload string")
    got = warc_zstd.page_round_trip(pages)
    first: dict = {}
    for p, _, h in PAGES:
        first.setdefault(h or "", []).append(p)
    want = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        ids = [x for x in first[h or ""] if x is not None]
        again = bool(ids) and p != min(ids)
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", min(ids) if again else None, None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert warc_zstd.page_round_trip(pages.where("false")).count() == 0


def archive(records: list[bytes], dictionary: bytes = b"WARC/1.1 Content-Length" * 50) -> bytes:
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc_zstd.dictionary_frame(dictionary) + b"".join(map(packer.compress, records))


def good(k: int = 0) -> bytes:
    payload = b"payload %d" % k * 200
    return warc_zstd.record(f"<urn:x-page:{k}>", "http://x/", payload, warc_zstd.base32_sha1(payload), None)


def test_reader_takes_one_record_of_each_frame():
    records = [good(k) for k in range(300)]
    assert list(warc_zstd.frames(io.BytesIO(archive(records)), 777)) == records
    packed = zstandard.ZstdCompressor().compress(b"dictionary content " * 40)
    plain = archive(records, b"dictionary content " * 40)
    rest = plain[8 + 19 * 40 :]
    assert list(warc_zstd.frames(io.BytesIO(warc_zstd.dictionary_frame(packed) + rest))) == records
    assert list(warc_zstd.frames(io.BytesIO(b""))) == []


@pytest.mark.parametrize("broken", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"WARC-Record-ID", b"X-Record-ID"), lambda r: r[:-1], lambda r: r + b"x",
    lambda r: r.replace(b"payload 0", b"paYload 0", 1), lambda r: r.replace(b"Content-Length: ", b"Content-Length: -", 1), lambda r: b"junk"])
def test_broken_records_are_told(broken):
    with pytest.raises(ValueError):
        warc_zstd.parse(broken(good()))


def test_broken_archives_give_an_error_row(spark, tmp_path):
    whole = archive([good(1), good(2).replace(b"payload 2", b"paYload 2", 1), good(3)])
    (tmp_path / "a.warc.zst").write_bytes(whole)
    (tmp_path / "b.warc.zst").write_bytes(whole[:-5])
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.warc.zst"),) for n in "ab"], "path string")
    rows = warc_zstd.read_archives(paths, str(tmp_path)).collect()
    assert sorted((r.archive[-10], r.record_id, r.error is None) for r in rows if r.record_id) == [
        ("a", "<urn:x-page:1>", True), ("a", "<urn:x-page:3>", True), ("b", "<urn:x-page:1>", True)]
    assert sum(r.error is not None for r in rows) == 3
    assert all(bytes(r.payload).startswith(b"payload") for r in rows if r.record_id)


def labelled() -> tuple[list, list]:
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Gremlin", "bogstench%%", "vileX" + rng.choice(words)]))
        docs.append((i, " ".join(text), "xy" if i % 2 else None, "k"))
        labels.append((i, int(toxic)))
    docs += [(2000, None, "xy", "k"), (2001, "", None, "k"), (None, "gremlin", "xy", "k"), (2002, "word " * 100_000 + "gremlin", "xy", "k"), docs[0]]
    return docs, labels + [(5000, 1), (None, 1), (3, None)]


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = labelled()
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").repartition(3).cache()
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, labels, toxicity.train(docs, labels)


def test_toxic_documents_of_unseen_labels_are_found(trained):
    docs, labels, _ = trained
    rows = toxicity.toxic_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    hits = sum(r.predicted for r in held if r.doc_id % 5 == 0)
    assert hits >= 0.9 * sum(r.doc_id % 5 == 0 for r in held)
    assert sum(r.predicted for r in held if r.doc_id % 5) <= 0.05 * len(held)
    score = {r.doc_id: r.score for r in rows}
    assert score[2000] == score[2001] < 0.3 < score[2002]


def test_scores_look_at_text_alone_and_repeat(trained):
    docs, labels, (model, cuts) = trained
    again, _ = toxicity.train(docs.repartition(5), labels)
    assert np.array_equal(model.emb, again.emb) and model.scale == again.scale
    changed = docs.selectExpr("-doc_id as doc_id", "text", "'zz' as lang")
    a = sorted(r.score for r in toxicity.score(docs, model, cuts).collect())
    assert a == sorted(r.score for r in toxicity.score(changed, model, cuts).collect())
    passed = toxicity.reject(docs, model, cuts)
    assert passed.columns == docs.columns and 0 < passed.count() < docs.count()


def test_training_without_labels(spark, trained):
    docs, labels, _ = trained
    rows = toxicity.toxic_documents(docs, labels.where("false")).collect()
    assert len(rows) == docs.count() and {r.predicted for r in rows} == {0}
    assert toxicity.toxic_documents(docs.where("false"), labels).count() == 0


def test_training_counts_every_labelled_row(spark, trained, monkeypatch):
    docs, labels, _ = trained
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 20_000)
    seen, learnt = [], toxicity.leaning
    monkeypatch.setattr(toxicity, "leaning", lambda shards: seen.append((shards.count(), learnt(shards))) or seen[-1][1])
    model, cuts = toxicity.train(docs, labels)
    again, _ = toxicity.train(docs.repartition(5), labels)
    assert np.array_equal(model.emb, again.emb) and (model.scale, model.offset) == (again.scale, again.offset)
    bucket = toxicity.features(*toxicity.flat_bytes(pa.array(["gremlin"])))[0][0, 0]
    known = {i: y for i, y in labels.where("toxic is not null").collect()}
    fitted = [(d, t) for d, t, *_ in {tuple(r) for r in docs.collect()} if d in known and zlib.crc32(str(d).encode()) % 4 in (0, 3)]
    has = [known[d] for d, t in fitted if "Gremlin" in (t or "")]
    assert seen[0][0] > 5 and (seen[0][1][0][bucket], seen[0][1][1][bucket]) == (len(has), sum(has))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model, cuts).collect()}
    assert sum(score[i] >= 0.3 for i in range(0, 900, 5)) >= 0.9 * 180
    assert sum(score[i] >= 0.3 for i in range(900) if i % 5) <= 0.05 * 720


def test_long_documents_teach(spark):
    rng = random.Random(1)
    text = lambda i: " ".join(f"w{rng.randrange(300)}" for _ in range(12_000)) + (" zorbl" * 3 if i % 2 else "")
    docs = spark.createDataFrame([(i, text(i), "xy") for i in range(80)], "doc_id long, text string, lang string").cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert docs.where("length(text) <= 50000").count() == 0
    rows = toxicity.toxic_documents(docs, labels).where("held_out").collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows) and len(rows) > 10


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, sf)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), after.schema)
        assert 0 < after.count() <= held.count()
        if name == "ngram_join":
            from paylattice.llm import ngram_join
            groups = ngram_join.similar_groups(held).select("component_id").distinct().count()
            assert after.count() == groups
        held = after
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.select("doc_id").distinct().count() == held.count()


def test_registry():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(queries.SQL) <= set(names)
