"""SimHash and embedding near-dedup, components: brute force and defined cases."""

import numpy as np
import pyarrow as pa
import xxhash
from corpus_helpers import ROWS, SMALL, edge, empty

from funnelwright.llm import embeddings, graph, simhash


def _reached(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_smallest_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (30, 20), (200, 150), (500, 499)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        assert graph.smallest(n, a, b).tolist() == _reached(n, list(zip(a.tolist(), b.tolist())))
    chain = np.arange(999)
    assert not graph.smallest(1000, chain, chain + 1).any()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (-3, 250), (9, 9)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in range(100, 161)} == {100}
    assert {got[x] for x in [7, -3, *range(200, 260)]} == {-3}
    assert 5 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text, shingle=4):
    words = bytes((text or ""), "utf8").translate(simhash._LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    values = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))


def test_fingerprints_equal_brute_force():
    texts = ["", None, "One", "one TWO three", "a b c d", "a b c d e a b c d e", "É é ü ß " * 9, " lead and\ttail \n", ROWS[6][1][:4000]]
    got = simhash.fingerprints(pa.array(texts, pa.string()), 4)
    assert [int(x) for x in got] == [_fingerprint(t) for t in texts]


def test_every_near_pair_agrees_under_a_mask():
    rng = np.random.default_rng(2)
    for rows in (10, 10**6, 10**8, 10**12):
        masks = simhash.block_masks(rows, 4)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flip & m == 0 for m in masks)


def test_pivot_tables_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), base ^ np.uint64(15)]))
    group = np.zeros(len(prints), np.int64)
    a, b = simhash.linked_pairs(prints, group, group, 4)
    want = {(i, j) for i in range(len(prints)) for j in range(i) if bin(int(prints[i] ^ prints[j])).count("1") <= 4}
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist())} == want


def test_simhash_groups_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = " ".join(f"w{x}" for x in rng.integers(0, 50, 400))
    texts = []
    for i in range(120):  # one group of near copies, larger than a group may be
        words = base.split()
        words[int(rng.integers(0, 400))] = f"new{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"o{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(60)] + [base, base, "", None]
    monkeypatch.setattr(simhash, "GROUP", 16)
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    label = _reached(len(prints), pairs)
    for i, p in enumerate(prints):
        smallest = min(1000 - j for j in range(len(prints)) if label[j] == label[i])
        assert (out[1000 - i].fingerprint, out[1000 - i].component_id) == (f"{p:016x}", smallest)


def test_simhash_on_edge_rows(edge, empty):
    out = simhash.near_duplicates(edge).collect()
    assert len(out) == len(ROWS)
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert len(zero) == 3 and {r.component_id for r in zero} == {2}
    assert [r.component_id for r in out if r.doc_id == 8] == [8, 8]
    assert simhash.near_duplicates(empty).count() == 0


def _clusters(seed, groups, size, dims=24, spread=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        center = rng.standard_normal(dims)
        rows += [center + spread * np.linalg.norm(center) / np.sqrt(dims) * rng.standard_normal(dims) * 3 for _ in range(size)]
    return np.array(rows, np.float32)


def _linked(vectors, threshold=0.95):
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 8)
    vectors = np.concatenate([_clusters(5, 6, 40), _clusters(6, 60, 2), _clusters(7, 200, 1)])
    vectors = np.concatenate([vectors, vectors[:5], vectors[:1]])
    ids = np.random.default_rng(8).permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors.tolist())), "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, window=8).collect()}
    near = _linked(vectors)
    label = _reached(len(ids), list(zip(*(x.tolist() for x in np.nonzero(near)))))
    links = near.sum(axis=1)
    found = sum(out[i].n_links for i in ids)
    assert found <= links.sum() and found >= 0.97 * links.sum()
    for at, i in enumerate(ids):
        r = out[i]
        smallest = min(ids[j] for j in range(len(ids)) if label[j] == label[at])
        assert r.kept == (r.vec_id == r.component_id) and r.n_links <= links[at] and r.component_id >= smallest


def test_odd_vectors_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0])]
    rows += [(8, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (None, None)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert all(by[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6, 9, 10))
    assert by[7] == [(3, 7, True)] and by[8] == [(3, 7, False)] * 2
    assert sorted(by[None], key=str) == [(0, None, True), (3, 7, False)]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_passes_grow_with_the_logarithm_of_the_input():
    sizes = [embeddings.passes_for(n) for n in (10, 10**4, 10**5, 10**6)]
    assert sizes == sorted(sizes) and sizes[0] >= 4
