"""Codebook compression, cap filters and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paylattice.llm import cap_filters, code_compression, importance

BAD = [(5000, None, "a"), (5001, [1.0, None, 0.0, 0.0], "a"), (5002, [float("nan")] * 4, "a"), (5003, [float("inf")] * 4, None)]


# ---------------------------------------------------------------- op11


def brute_codes(rows: list[tuple], parts: int, entries: int, rounds: int):
    """Plain Lloyd rounds in Python integers."""
    kept = [(i, v, s) for i, v, s in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    part = max(1, -(-width // parts))
    x = [[max(-(1 << 26), min(1 << 26, math.floor(1024 * t))) for t in v] + [0] * (part * parts - len(v)) for _, v, _ in kept]
    least = {}
    for (i, v, _), own in zip(kept, x, strict=True):
        least[i] = min(least.get(i, (v, own)), (v, own))
    first = [least[i][1] for i in sorted(least, key=lambda i: (i is None, i or 0))][:entries]
    books = [[row[p * part : (p + 1) * part] for row in first] for p in range(parts)]

    def nearest(p, own):
        d = [sum((a - b) ** 2 for a, b in zip(own[p * part : (p + 1) * part], e, strict=True)) for e in books[p]]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = defaultdict(list)
            for own in x:
                groups[nearest(p, own)[1]].append(own[p * part : (p + 1) * part])
            for j, g in groups.items():
                new[p][j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
        books = new
    out = []
    for (i, _, s), own in zip(kept, x, strict=True):
        near = [nearest(p, own) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near), s))
    label = Counter()
    for _, _, d, s in out:
        label[s] += d
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, c, d, label[s], digest) for i, c, d, s in out]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, [float(t) for t in centres[i % 12] + rng.normal(0, 0.05 if i % 3 else 0.8, 8)], [None, "a", "b"][i % 3]) for i in range(700)]
    rows += [(900 + i, [0.5, 0.5, 0.25, 0.25] * 2, "a") for i in range(300)]  # ties and a hot vector
    rows += [(7, [9.0] * 8, "b"), (None, [1.0] * 8, "b"), rows[3], rows[3], (1300, [1.0, 2.0, 3.0], "c"), (1301, [], "c"), (1302, [0.0] * 8, "c"),
             (1303, [1e300, -1e300, 1e9, 0.0, 0.0, 0.0, 0.0, -1e9], "c"), *BAD]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, code string, error int").repartition(5)
    assert order(code_compression.code_report(df).collect()) == order(brute_codes(rows, 4, 256, 4))


def test_codes_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<double>, label string"
    few = [(3, [1.0, 2.0, 3.0], None), (1, [1.0, 2.0, 3.0], "a")]
    assert order(code_compression.code_report(spark.createDataFrame(few, schema)).collect()) == order(brute_codes(few, 4, 256, 4))
    empty = code_compression.code_report(spark.createDataFrame(BAD, schema))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_save_work_and_codes_decode(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (40, 16))
    rows = [(i, [float(t) for t in centres[i % 40] + rng.normal(0, 0.05, 16)], "a") for i in range(3000)]
    codec = code_compression.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), rounds=3)
    whole = 3000 * 4 * 257
    assert codec.distances[0] == whole and codec.distances[-1] < 0.7 * whole
    got = codec.coded.orderBy("id").collect()
    x = code_compression.integers([r[1] for r in rows], 16)
    back = code_compression.decode([bytes(r.code) for r in got], codec.codebooks)
    assert [r.error for r in got] == ((x - back) ** 2).sum(axis=1).tolist()


def test_net_displacement_is_tighter_than_the_sum_of_moves():
    there = [np.array([[[0, 0], [100, 0]]]), np.array([[[30, 40], [100, 0]]]), np.array([[[3, 4], [100, 0]]])]
    books = code_compression.Codebooks(there)
    moved = books.moved(0)
    g = books.group[0][0]
    assert moved[0, g] == 5 and moved[1, g] == 45 and moved[2].max() == 0  # and not 50 + 45 since the first round


# ---------------------------------------------------------------- op12


def brute_links(rows: list[tuple], least: float):
    fine = [v is not None and i is not None and s is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, s in rows]
    width = max((len(v) for _, v, _ in rows if v), default=0)

    def unit(v):
        x = np.zeros(width)
        x[: len(v)] = v
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    at = [k for k in range(len(rows)) if fine[k]]
    x = np.array([unit(rows[k][1]) for k in at]).reshape(len(at), width)
    label = np.array([str(rows[k][2]) for k in at])
    link = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root = np.array([rows[k][0] for k in at])
    while True:
        new = np.minimum(root, np.where(link, root[None, :], 1 << 60).min(axis=1, initial=1 << 60))
        if (new == root).all():
            break
        root = new
    out = {k: (int(link[j].sum()), int(root[j])) for j, k in enumerate(at)}
    return [(i, *out.get(k, (0, i)), out[k][1] == i if k in out else True) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("part", [512, 16])
def test_near_vectors_match_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(cap_filters, "PART", part)
    rng = np.random.default_rng(3)
    rows = []
    base = rng.normal(0, 1, (30, 24))
    for i in range(600):  # chains and clusters around the boundary, of several lengths
        x = base[i % 30] + rng.normal(0, [0.02, 0.1, 0.13, 0.6][i // 30 % 4], 24)
        rows.append((i * 3 + 1, [float(t) for t in x * 10.0 ** rng.integers(-150, 150)], ["a", "b"][i % 2]))
    rows += [(10_000 + i, rows[4][1], "a") for i in range(150)]  # exact copies, and the same under another label
    rows += [(20_000 + i, [float(t) for t in base[1] + rng.normal(0, 0.01, 24)], "b") for i in range(200)]  # one dense cluster
    rows += [(30_000, rows[4][1], "b"), (30_001, [0.0] * 24, "a"), (30_002, rows[4][1], None), (None, rows[4][1], "a"), (30_003, [], "a"),
             (30_004, [1.0], "a"), (30_005, [2.0, 0.0], "a"), (1, [-5.0] * 24, "a"), *BAD]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label string, node int, cell string").repartition(6)
    got = cap_filters.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert order(got.collect()) == order(brute_links(rows, 0.98))


def test_near_vectors_of_few_and_none(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(4, [3.0], 1), (2, [5.0], 1), (3, [-5.0], 1), (1, [5.0], 2)]
    assert order(cap_filters.near_vectors(spark.createDataFrame(rows, schema)).collect()) == order(brute_links(rows, 0.98))
    assert cap_filters.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert order(cap_filters.near_vectors(spark.createDataFrame([(1, None, 1)], schema)).collect()) == [(1, 0, 1, True)]


@pytest.mark.parametrize("n, width", [(500, 3), (51_282, 64), (10_000_000, 64), (1_000_000, 384)])
def test_pairs_at_the_boundary_share_a_filter(n, width):
    filters = cap_filters.CapFilters(width, cap_filters.filters_for(n, width))
    rng = np.random.default_rng(8)
    x = cap_filters.unit_rows(rng.normal(size=(300, width)))
    away = rng.normal(size=x.shape)
    away = cap_filters.unit_rows(away - (away * x).sum(axis=1)[:, None] * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * away
    both = [len(np.intersect1d(a, b)) > 0 for a, b in zip(filters.of(x), filters.of(y), strict=True)]
    assert np.mean(both) >= 0.98


def test_list_decoding_finds_every_exceeding_direction():
    filters = cap_filters.CapFilters(12, 1_000)
    x = cap_filters.unit_rows(np.random.default_rng(1).normal(size=(20, 12)))
    parts = filters.products(x)
    whole = parts[0]
    for p in parts[1:]:
        whole = (whole[:, :, None] + p[:, None, :]).reshape(len(x), -1)
    for i in range(len(x)):
        names, _ = filters.above([p[i] for p in parts], 0.4)
        assert sorted(names.tolist()) == np.flatnonzero(whole[i] >= 0.4).tolist()


# ---------------------------------------------------------------- op13

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_draw(docs: list[tuple], target: list[str]):
    def features(text):
        w = PATTERN.findall((text or "").translate(ASCII_LOWER))
        return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for f in found for x in f[2]), Counter(x for y in target for x in features(y)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in found:
        weight, score = sum(gain[b] for b in f) // len(f) if f else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, n])
    fit = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], -r[2], r[1]))
    for place, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in rows]


def texts() -> list[tuple]:
    rng = np.random.default_rng(13)
    names = ["alpha", "Beta", "Été", "中文字", "x", "42", "w" * 70, "W" * 64, "z" * 65, "don't", "a_b"]
    docs = [(i, " ".join(rng.choice(names, rng.integers(0, 60))) + ["", "\n", "\x00 end", "　tail"][i % 4]) for i in range(300)]
    return docs + [(300, None), (301, ""), (302, " ,.;\n"), (None, docs[5][1]), (None, None), docs[7], docs[7], (7, "other words " * 15),
                   (303, "中" * 3000), (304, "one two " * 4000), (305, "Z" * 9000 + " " + "end " * 30)]


@pytest.mark.parametrize("window", [1_000_000, 50])
def test_draw_matches_brute_force(spark, window, monkeypatch):
    monkeypatch.setattr(importance, "WINDOW_BYTES", window)
    docs, target = texts(), ["alpha beta alpha", None, "", "42 x 42"]
    df = spark.createDataFrame([(*d, 1.5, "x") for d in docs], "doc_id long, text string, score double, bucket string").repartition(5)
    if window < 1000:  # patches do not reach the workers
        import pyarrow as pa

        got = [np.bincount(f, minlength=10_000) for _, _, f in importance.features_of(pa.array([t for _, t in docs]), 2, 10_000)]
        monkeypatch.undo()
        want = [np.bincount(f, minlength=10_000) for _, _, f in importance.features_of(pa.array([t for _, t in docs]), 2, 10_000)]
        assert len(got) > len(want) and (sum(got) == sum(want)).all()
        return
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(got.collect()) == order(brute_draw(docs, target))


def test_draw_from_empty_tables(spark):
    none, few = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, target).count() == 0
    assert order(importance.resample(few, target).collect()) == order(brute_draw([(1, "a b c")], []))
    one_word = importance.resample(few, target, longest=1).collect()
    assert [r.n_features for r in one_word] == [3]
