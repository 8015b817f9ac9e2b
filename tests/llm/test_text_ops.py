"""Text operators against brute force on rows with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paylattice.llm import byte_bpe, ngram_join, packing, paragraph_dedup, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, key string, bucket int, n string, component string, shard string, score string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def made_docs() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, line, passage = prose(60), prose(14), prose(55)
    texts = [prose(rng.randint(1, 90)) for _ in range(25)]
    for k in range(12):  # near copies of one text, and copies
        w = base.split()
        w[k * 4] = "changed"
        texts.append(" ".join(w))
    texts += [base, base, base.upper().replace("É", "é"), f"{prose(20)}\n{passage}\n{prose(9)}", f"{passage}\n{prose(30)}", passage]
    short = prose(8).split()
    texts += [" ".join(short), " ".join([*short, "more"]), " ".join([*short, "other", "end"]), " ".join(short)]
    texts += [f"{line}\n{prose(40)}\n\n {line}" for _ in range(5)]
    texts += ["", None, " \n\t ", "one", "One", "a" * 400, "a" * 90 + "b", "it's 'Tis don’t J̌ <|endoftext|> x\u0000y", prose(6000), "é" * 60 + " ende", "ß" + "é" * 60]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[2], rows[30], (rows[5][0], "another text of the same id " + prose(20)), (None, base), (None, None), (None, prose(12))]
    return [(*r, "k", 1, "n", "c", "s", "x") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return made_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(sets: list, linked) -> list[int]:
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if find(i) != find(j) and sets[i] and sets[j] and linked(len(sets[i] & sets[j]), len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def shingle_set(text: str | None, k: int) -> set:
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("small", [0, 9, 14, None])
def test_ngram_join_equals_brute_force(docs, rows, small, monkeypatch):
    if small is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *_: small)
    sets = [shingle_set(r[1], 4) for r in rows]
    root = groups(sets, lambda i, u: 100 * i >= 85 * u)
    least = {}
    for r, g in zip(rows, root, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], len(s), least.get(g) if s else r[0]) for r, s, g in zip(rows, sets, root, strict=True))
    got = ngram_join.similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("tasks", [1, 4])
def test_ngram_join_subsets_of_a_smaller_partner_link_no_equal_sizes(spark, tasks, monkeypatch):
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: 20)
    texts = []
    for name, n in (("a", 10), ("b", 17), ("c", 10), ("d", 17)):  # 7 and 14 shingles
        w = [f"{name}{i}" for i in range(n)]
        cut = 1 if n == 10 else 2  # two sets that differ in the last words share 6 and 12 shingles
        texts += [" ".join([*w[:-cut], *[f"{name}{x}{i}" for i in range(cut)]]) for x in "xyz"]
        if name in "cd":  # here a smaller set joins them
            texts.append(" ".join(w[:-1] if n == 10 else w[:-2]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(tasks)
    sets = [shingle_set(t, 4) for t in texts]
    assert {len(s) for s in sets} == {6, 7, 12, 14}
    root = groups(sets, lambda i, u: 100 * i >= 85 * u)
    least = {g: min(i for i, x in enumerate(root) if x == g) for g in set(root)}
    got = ngram_join.similar_groups(docs).select("doc_id", "component_id").collect()
    assert {r.doc_id: r.component_id for r in got} == {i: least[g] for i, g in enumerate(root)}
    assert [least[g] for g in root[:6]] == list(range(6)) and len(set(root[6:10])) == len(set(root[10:])) == 1


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.choice(500, rng.integers(1, 300), replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        x, y = (np.frombuffer(ngram_join.sketch_of(t), np.uint8) for t in (a, b))
        assert np.unpackbits(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert ngram_join.sketch_of(a) == ngram_join.sketch_of(a[::-1])


def test_subsets_and_sizes():
    for percent in (80, 85, 90):
        for a in range(1, 30):
            for b in range(a, 30):
                c = ngram_join.overlap_needed(a, b, percent)
                assert all((100 * i >= percent * (a + b - i)) == (i >= c) for i in range(a + 1))
    assert ngram_join.boundary(0, 85) < ngram_join.boundary(5, 85) <= ngram_join.LARGEST_SMALL


def test_one_of_each_group_stays(docs, rows):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    sets = [shingle_set(r[1], 4) for r in rows]
    root = groups(sets, lambda i, u: 100 * i >= 85 * u)
    ids = Counter(r.doc_id for r in kept.collect())
    order = lambda r: (r[0] is None, r[0] or 0)
    want = [min((r for r, g in zip(rows, root, strict=True) if g == k), key=order)[0] for k in {g for g, s in zip(root, sets, strict=True) if s}]
    want += [r[0] for r in {(r[0], r[1] or "") for r, s in zip(rows, sets, strict=True) if not s}]
    assert ids == Counter(want)


def test_pipeline_stage_takes_five_words_at_four_fifths(spark, docs):
    import corpus_pipeline
    w = [f"w{i}" for i in range(49)]
    between = [(201, " ".join(w)), (202, " ".join([*w[:24], "changed", *w[25:]]))]
    mixed = docs.unionByName(spark.createDataFrame([(*r, "k", 1, "n", "c", "s", "x") for r in between], SCHEMA))
    texts = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in mixed.select("doc_id", "text").collect()})
    sets = [shingle_set(t, 5) for *_, t in texts]
    root = groups(sets, lambda i, u: 100 * i >= 80 * u)
    first = {g: texts[i][:2] for i, g in reversed(list(enumerate(root)))}
    want = Counter(first[g] for g in first)
    got = corpus_pipeline.ngram_join_stage(spark, mixed, "").collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == want
    assert [r.doc_id for r in got if r.doc_id in (201, 202)] == [201]


def test_suffix_dedup_equals_brute_force(docs, rows):
    order = lambda d: 10**9 if d is None else d
    first: dict[bytes, int] = {}
    raw = [(r[1] or "").encode() for r in rows]
    for r, b in zip(rows, raw, strict=True):
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 10**9), order(r[0]))
    want = Counter()
    texts = Counter()
    for r, b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(r[0]):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[r[0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
        if kept or not sum(gone):
            texts[r[0], kept.decode("utf-8", "ignore") if sum(gone) else r[1]] += 1
    got = suffix_dedup.dedup(docs, ["doc_id", "key"])
    assert got.columns == ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert Counter(tuple(r)[:1] + tuple(r)[2:6] for r in got.collect()) == want
    assert any(k[2] for k in want)
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == texts


def test_strings_under_a_crowded_file_key_are_dealt_by_their_own_hashes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 20)
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(n))
    passage = prose(12)
    rows = [(i, f"{prose(rng.randint(0, 9))} {passage} {rng.choice('ab')} {prose(6)}") for i in range(150)] + [(None, f"{passage} a"), (7, f"{passage} b"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = suffix_dedup.with_key(docs).select("doc_id", F.col("__key").alias("key"), "text")
    repeated = suffix_dedup.key_bitmap(suffix_dedup.file_keys(plain), 2)
    first = suffix_dedup.store(suffix_dedup.settle_equal_runs(suffix_dedup.sent_runs(plain, repeated)), "equal-runs")
    heavy = np.array([r.key for r in first.where(F.col("bucket") == suffix_dedup.APART).collect()], np.int64)
    places = suffix_dedup.key_bitmap(first.where("bucket >= 0").select("bucket", "keys"), 1)
    sent = suffix_dedup.sent_runs(plain, repeated, places, heavy).collect()
    assert len(heavy) and any(r.bucket == suffix_dedup.APART for r in sent)
    met = Counter()
    for r in sent:
        if r.bucket >= 0:
            met.update((r.bucket << 32) | x for x in np.frombuffer(r["keys"], suffix_dedup.RUN)["file"].tolist())
    assert not set(met) & set(heavy.tolist()) and max(met.values(), default=0) <= 20
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(docs, ["doc_id"], with_kept=False).collect())
    removed = Counter()
    order = lambda d: 10**9 if d is None else d
    seen: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = min(seen.get(b[i : i + 50], 10**9), order(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = {j for i in range(len(b) - 49) if seen[b[i : i + 50]] < order(d) for j in range(i, i + 50)}
        removed[d, len(b), len(gone)] += 1
    assert got == removed and sum(k[2] > 0 for k in removed) > 100


def test_parts_of_a_bucket_are_refined_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "REFINED", 600)
    rng = np.random.default_rng(2)
    rows = np.zeros(60, suffix_dedup.RUN)
    rows["file"], rows["count"] = rng.integers(0, 12, 60), rng.integers(1, 5, 60)
    texts = [rng.integers(0, 2, n + 49).astype(np.uint8).tobytes() if i % 3 else bytes(n + 49) for i, n in enumerate(rows["count"].tolist())]
    rows["key"] = np.arange(60)
    met, sizes = {}, []
    for part, begins, name in suffix_dedup.refined(rows, np.frombuffer(b"".join(texts), np.uint8)):
        sizes.append(len(name))
        for r, a in zip(part, begins.tolist(), strict=True):
            for i in range(int(r["count"])):
                met.setdefault(int(r["file"]), set()).add((texts[r["key"]][i : i + 50], len(sizes), int(name[a + i])))
    assert len(sizes) > 3 and max(sizes) < 2 * 600 and len(met) == len(set(rows["file"].tolist()))
    for same in met.values():  # equal names, equal strings, and a key in one part
        assert len({x[0] for x in same}) == len({x[2] for x in same}) == len(same) and len({x[1] for x in same}) == 1


def test_refinement_names_equal_strings_alike():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1200] = data[:200]
    for length in (16, 23, 50):
        name = suffix_dedup.refine(data, length)
        seen: dict[bytes, int] = {}
        for i in range(len(data) - length + 1):
            assert seen.setdefault(data[i : i + length].tobytes(), int(name[i])) == name[i]
        assert len(set(seen.values())) == len(seen)


def units_of(text):
    """(number or -1, start, end, shingles) of the paragraphs of a text, word by word."""
    data = text.encode()
    out, number, at = [], 0, 0
    for line in data.split(b"\n"):
        end = min(at + len(line) + 1, len(data))
        found = WORD.findall(line)
        if len(found) >= 5:
            out.append((number, at, end, shingle_set(line.decode(), 5)))
        number += bool(found)
        at = end
    spans = [m.span() for m in WORD.finditer(data)]
    units = paragraph_dedup.Units(pa.RecordBatch.from_pydict({"text": pa.array([text])}))
    for start, end in zip(units.start[units.number < 0].tolist(), units.end[units.number < 0].tolist(), strict=True):
        assert start in [a for a, _ in spans] and end in [a for a, _ in spans]
        out.append((-1, start, end, {("passage", x) for x in shingle_set(data[start:end].decode(), 5)}))
    return out


def test_paragraphs_equal_brute_force(docs, rows):
    each = [(d, t, *u) for d, t in {(r[0], r[1] or "") for r in rows} for u in units_of(t)]
    root = groups([x[5] for x in each], lambda i, u: 100 * i >= 80 * u)
    got = paragraph_dedup.repeated_paragraphs(docs).collect()
    assert len(got) == len(rows)
    keys = {(r[0], r[1] or ""): r[2] for r in docs.selectExpr("cast(doc_id as long)", "text", "xxhash64(doc_id, coalesce(text, ''))").collect()}
    first = {}
    for x, g in zip(each, root, strict=True):
        place = (x[0] is None, x[0] or 0, keys[x[0], x[1]], x[3], x[4])
        first[g] = min(first.get(g, place), place)
    want = {k: (set(), set()) for k in keys.values()}
    for x, g in zip(each, root, strict=True):
        key, (_, _, own, start, end) = keys[x[0], x[1]], first[g]
        if key != own or x[3] >= end or x[4] <= start:
            want[key][1].add((x[3], x[4]))
            if x[2] >= 0:
                want[key][0].add(x[2])
    assert any(w[1] for w in want.values())
    for r in got:
        assert (set(r.removed), {tuple(s) for s in r.spans}) == want[r.key]
    cleaned = paragraph_dedup.clean(docs.withColumn("row_key", F.lit("mine")))
    assert cleaned.columns == [*docs.columns, "row_key"] and cleaned.count() == len(rows)


def test_a_passage_inside_other_lines_is_caught(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    many = lambda n: " ".join(word() for _ in range(n))
    rows, caught = [], 0
    for i in range(0, 120, 2):
        passage = many(55)
        rows.append((i, many(40) + " " + passage + " " + many(40) + "\n" + many(12)))
        rows.append((i + 1, many(3) + " " + passage.replace(" ", "\n", 40) + " " + many(90)))
    docs = spark.createDataFrame([*rows, (900, many(300)), (901, None), (902, "")], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in paragraph_dedup.paragraph_report(docs).collect()}
    cleaned = {r.doc_id: r.text for r in paragraph_dedup.clean(docs).collect()}
    for i in range(0, 120, 2):
        assert got[i].n_removed == 0 and cleaned[i] == rows[i][1]
        caught += got[i + 1].n_removed > 0
        assert len(cleaned[i + 1].split()) >= 93
    assert caught >= 57
    assert [got[i].n_removed for i in (900, 901, 902)] == [0, 0, 0]


def test_bands_reach_the_recall():
    n, rows = paragraph_dedup.bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** n >= 0.9999 > 1 - (1 - 0.8**rows) ** (n - 1)
    assert n * rows <= paragraph_dedup.MOST_HASHES and 1 - (1 - 0.3**rows) ** n < 0.2


def test_spans_are_cut_once():
    cut = [{"start": 1, "end": 4}, {"start": 2, "end": 3}, {"start": 6, "end": 8}]
    assert paragraph_dedup.without_spans("abcdefgh", cut) == "aef"
    assert paragraph_dedup.without_spans(None, cut) is None and paragraph_dedup.without_spans("ab", []) == "ab"


def test_packing_holds_every_token_once(docs, rows):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = Counter((r[0], tuple([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    for segments, loss in ((256, 2048), (3, 2048), (256, 700)):
        got = packing.pack_documents(docs, path, segments=segments, loss=loss).collect()
        sequences: dict[int, list] = {}
        for r in got:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
            sequences.setdefault(r.sequence_id, []).append(r)
        for pieces in sequences.values():
            pieces.sort(key=lambda r: r.offset)
            assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
            total = sum(r.length for r in pieces)
            assert total <= min(2048, loss) and len(pieces) <= segments
            assert total == 2048 or total & (total - 1) == 0 or loss < 2048
        # pieces of one id that follow each other make up its documents again
        found = Counter()
        for d in {r.doc_id for r in got}:
            open_parts: list[list[int]] = []
            for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.start):
                for part in open_parts:
                    whole = [w for w in want if w[0] == d and list(w[1][: len(part) + r.length]) == part + r.ids]
                    if len(part) == r.start and whole and len(part) < r.doc_tokens:
                        part += r.ids
                        break
                else:
                    assert r.start == 0
                    open_parts.append(list(r.ids))
            found.update((d, tuple(p)) for p in open_parts)
        assert found == want


def test_packer_respects_loss_at_the_end_of_examples():
    lengths, losses = [3000, 100, 2048, 10, 900, 1], [500, 100, 0, 0, 900, 1]
    packer = packing.Packer(2048, 4, 600, 0)
    packer.pack(lengths, losses)
    bearing: Counter = Counter()
    for i, start, n, q, _ in packer.pieces:
        bearing[q] += max(0, start + n - max(start, lengths[i] - losses[i]))
    assert max(bearing.values()) <= 600
    assert sum(n for _, _, n, _, _ in packer.pieces) == sum(lengths)


def test_sharding_law(docs, rows, spark):
    got = sharding.shard_documents(docs, [1.0] * 40).collect()
    assert len(got) == len(rows)
    shard = {}
    for r in got:
        assert shard.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.assign(docs, "doc_id", [1.0, 2.0]).columns.count("shard") == 1
    many = sharding.assign(spark.range(20000).withColumnRenamed("id", "k"), "k", [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in many}[1] - 15000) < 300
    with pytest.raises(ValueError):
        sharding.assign(docs, "doc_id", [1.0, 0.0])


def test_bpe_equals_the_library_and_comes_back(docs, rows, monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = byte_bpe.encoding(path, pattern)
    want = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(docs, path, pattern).collect())) == want
    encoded = byte_bpe.encode(docs, path, pattern)
    back = byte_bpe.decode(encoded, path, pattern)
    assert Counter((r.doc_id, bytes(r.raw)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.decode(encoded.where("false"), path, pattern).count() == 0


def test_long_texts_are_cut_where_no_match_runs():
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "é", "1", "x y", "!", "日"]) for _ in range(80))
        parts = list(byte_bpe.pieces(text, 7))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_empty_tables(empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (ngram_join.similar_groups(empty), ngram_join.one_of_each(empty), suffix_dedup.dedup(empty), suffix_dedup.cut_texts(empty),
               paragraph_dedup.paragraph_report(empty), packing.pack_documents(empty, path), sharding.shard_documents(empty, [1.0] * 3),
               byte_bpe.round_trip(empty, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)):
        assert df.count() == 0


def twin_words(letters: str) -> tuple[str, str]:
    """Two words whose polynomial hashes modulo 2^64 are equal for any odd base."""
    word = letters[0]
    for _ in range(10):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize("letters", ["ab", "ae"])
def test_words_of_equal_running_sums_stay_apart(spark, letters):
    first, second = twin_words(letters)
    docs = spark.createDataFrame([(1, first), (2, second), (3, first), (4, f"x {second} y")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {}
    for r in packing.pack_documents(docs.coalesce(1), path).orderBy("doc_id", "start").collect():
        ids.setdefault(r.doc_id, []).extend(r.ids)
    for r in docs.collect():
        assert ids[r.doc_id] == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
    spans = suffix_dedup.dedup(docs.where("doc_id < 4"), ["doc_id"], with_kept=False).collect()
    gone = brute_removed([(1, first), (2, second), (3, first)])
    assert {r.doc_id: r.n_removed for r in spans} == gone


def brute_removed(rows: list[tuple[int, str]], length: int = 50) -> dict[int, int]:
    """Bytes covered by strings that also start in a document with a smaller id."""
    seen: set[bytes] = set()
    out = {}
    for i, text in sorted(rows):
        raw = text.encode()
        strings = [raw[k : k + length] for k in range(len(raw) - length + 1)]
        gone = {k + j for k, x in enumerate(strings) if x in seen for j in range(length)}
        out[i] = len(gone)
        seen |= set(strings)
    return out


def test_pieces_are_accepted_by_their_bytes(monkeypatch):
    """Even if every piece had the same hash."""
    known = packing.PieceIds(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    monkeypatch.setattr(packing.Prefix, "ranges", lambda self, a, b: np.zeros(len(a), np.uint64))
    for text in ("one two three six", "six two one", "ten one 7 8 seven"):
        got = known.texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 1)[0].tolist()
        assert got == [*known.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_bpe_of_very_long_runs(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = byte_bpe.encoding(path, pattern)
    short = ["a" + " " * 30_000 + "b" * 90_000, "\n" * 20_000 + "x y " * 30_000, "\u4e2d\u6587\u3002" * 50_000, "f(x);'s " * 20_000 + "\t" * 15_000,
             "\u3000" * 12_000 + "\x1c" * 100_000, "don't " * 30_000, None, ""]
    long = [" " * 1_000_000, "\n" * 1_000_000 + "x", " " * 5_000_000 + "ab"]
    docs = spark.createDataFrame(list(enumerate(short + long)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, path, pattern).collect()}
    for i, text in enumerate(short + long):
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        if i < len(short):
            ids = enc.encode_ordinary(text or "")
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_frequency_classes(spark):
    from paylattice.llm import common

    keys = common.mix(np.arange(1, 2001, dtype=np.uint64))
    times = np.repeat([1, 3, 9, 100, 600], 400)
    packer = common.KeyPacker(most_alike=600)
    batches = list(packer.add(np.repeat(keys, times))) + list(packer.flush())
    rows = [r for b in batches for r in zip(b["bucket"].to_pylist(), b["keys"].to_pylist(), strict=True)]
    bitmap = common.key_bitmap(spark.createDataFrame(rows, common.PACKED), 2, classes=True)
    assert (bitmap.level(keys) >= np.repeat([0, 0, 1, 2, 3], 400)).all() and (bitmap.level(keys) == np.repeat([0, 0, 1, 2, 3], 400)).mean() > 0.99
    assert bitmap.has(keys[400:]).all() and bitmap.has(keys[:400]).mean() < 0.1


def test_a_list_whose_first_set_is_like_no_other_leaves_few_pairs(spark, monkeypatch):
    sets = {1: np.arange(1000, 1101), 2: np.arange(2000, 2101)} | {node: np.append(np.arange(100), node + 5000) for node in range(100, 200)}
    heavies = spark.createDataFrame([(np.array([7], np.int64).tobytes(), node, 101, 101) for node in sets], "keys binary, a long, n long, rest long")
    tokens = spark.createDataFrame([(node, x.astype(np.uint64).tobytes()) for node, x in sets.items()], "node long, tokens binary")
    asked, keep = [], ngram_join.store

    def watched(df, name):
        out = keep(df, name)
        asked.extend([out.count()] * (name == "candidates"))
        return out

    monkeypatch.setattr(ngram_join, "store", watched)
    none = spark.createDataFrame([], "a long, b long")
    known = ngram_join.resolve(heavies, None, [none], lambda nodes: tokens.join(nodes.distinct(), "node"), 80, ordered=False)
    assert {r.node: r.component for r in known.collect()} == dict.fromkeys(range(100, 200), 100)
    assert sum(asked) < 1000  # all pairs of the hundred are 4,950


def test_copies_of_paragraphs_send_no_sets(spark):
    from paylattice.llm import common

    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    near = words[5].split()
    docs = spark.createDataFrame([(i, words[i % 5] + "\n") for i in range(10)] + [(10, words[5]), (11, " ".join([*near[:-1], "other"]))],
                                 "doc_id long, text string").withColumn("key", F.col("doc_id")).repartition(6)
    first = paragraph_dedup.first_hashes(0.8, 2e-5)
    found = paragraph_dedup.colliding(docs, *common.mark_bitmaps(paragraph_dedup.first_keys(docs, first)), first)
    rows = found.collect()
    assert len({r.a for r in rows if r.a is not None}) == 2 and len([r for r in rows if r.a is not None]) == 2
    listed = {r.doc_id: len([x for x in r.numbers if x == 0]) for r in rows if r.a is None}
    assert listed == dict.fromkeys(range(12), 1)
    assert first == 7


def test_tasks_hold_half_a_megabyte_of_text_and_give_back():
    from paylattice.llm import common

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 50_000] * 40)})
    sizes = [sum(len(t) for t in b["text"].to_pylist()) for b in common.slices(iter([batch]))]
    assert sum(sizes) == 2_000_000 and max(sizes) <= 500_000
    common.give_back()
