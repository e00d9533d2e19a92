"""License scans, source divergence and whitening against brute force, on edge rows and on empty tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from corpus_helpers import DOCS, ROWS, SMALL, corpus, edge, empty, table  # noqa: F401

from funnelwright.llm import divergence, licenses, whitening
from funnelwright.llm.catalog import QUERIES

MIT = licenses.TEMPLATES["mit"][1]


def by_id(df, column="doc_id"):
    return {r[column]: r for r in df.collect()}


# License scans


def test_blocks_meet_the_threshold_and_no_pair_is_lost(spark):
    rng = random.Random(3)
    letters = [f"w{i}" for i in range(30)]
    templates = {f"t{k}": (" ".join(rng.choices(letters, k=rng.randint(1, 24))),) for k in range(12)}
    texts = [" ".join(rng.choices(letters + ["x", "y"], k=rng.choice([0, 1, 7, 40, 90]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.3, 0.8, 1.0):
        got = by_id(licenses.find_licenses(df, templates=templates, threshold=threshold))
        for i, text in enumerate(texts):
            words, want = licenses.text_words(text), []
            for r in licenses.template_rows(templates, threshold):
                step, held = r["step"], set(r["words"])
                for b in range(max(1, math.ceil(len(words) / step) - 1)):
                    part = len(held & set(words[b * step : (b + 2) * step])) / len(held)
                    if part >= threshold - 1e-9:
                        want.append((r["template"], r["label"], b * step, part))
            assert [tuple(m) for m in got[i].matches] == want, (threshold, i)


def test_notices_are_found_wherever_they_stand(spark):
    filler = " ".join(f"n{i}" for i in range(1000))
    words = MIT.split()
    worn = " ".join(w for i, w in enumerate(words) if i % 12)
    rows = [(0, f"{filler} {MIT} {filler}"), (1, f"{filler[:333]}\n{worn}\n{filler}"), (2, " ".join(words[: len(words) // 2])), (3, filler)]
    got = by_id(licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {m.label for m in got[0].matches} == {m.label for m in got[1].matches} == {"mit"}
    assert got[2].matches == got[3].matches == []
    start = min(m.start for m in got[0].matches)
    assert 1000 - 128 <= start <= 1000 and max(m.containment for m in got[0].matches) == 1.0


def test_phrases_overlap_and_separators(spark):
    rows = [(0, "CC-by cc BY; cc\nby"), (1, "All  rights, RESERVED general public license cc by"), (2, "ccby CC éby"), (3, "cc")]
    got = by_id(licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [tuple(p) for p in got[0].places] == [(0, "cc-by"), (2, "cc-by"), (4, "cc-by")]
    assert [tuple(p) for p in got[1].places] == [(0, "reserved"), (3, "gpl"), (6, "cc-by")]
    assert got[2].places == got[3].places == []


def test_licenses_on_edge_and_empty_rows(spark, edge, empty):  # noqa: F811
    out = licenses.find_licenses(edge)
    # The input has a column n_words of its own.
    assert out.columns == [*edge.columns, "_n_words", "places", "matches"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r._n_words == len(licenses.text_words(r.text or ""))
        assert r.places == [] and r.matches == []
    assert licenses.find_licenses(empty).count() == 0


def test_many_copies_of_a_licensed_text(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 0 THEN '{MIT}' ELSE concat('own ', id) END AS text")
    found = licenses.find_licenses(df).selectExpr("doc_id % 3 = 0 AS copy", "size(matches) AS n").groupBy("copy", "n").count().collect()
    assert sorted(map(tuple, found)) == [(False, 0, 2000), (True, 1, 1000)]


# Source divergence


def brute_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", [w for w in terms(text or "") if w]) for text, lang, source in rows]
    out = []
    for lang in sorted({d[0] for d in docs}):
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= min_docs]
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= min_docs) for s in {d[1] for d in own}}
        whole = sum(groups.values(), Counter())

        def p(counts, t):
            return 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts.values()) + 5 * len(kept))

        for s, counts in groups.items():
            pairs = [(-sum(abs(p(counts, t) - p(other, t)) for t in kept), o.encode()) for o, other in groups.items() if o != s]
            over = [(-(p(counts, t) - p(whole, t)), t.encode()) for t in kept if counts[t] and p(counts, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def terms(text):
    return "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text).split(" ")


def random_docs(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = " ".join(f"{rng.choice('abcdéXY')}{chr(97 + min(25, int(rng.expovariate(0.2))))}" for _ in range(rng.choice([0, 1, 30])))
        rows.append((rng.choice([text, text, text, None]), rng.choice(["en", "de", None]), rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None])))
    return rows


@pytest.mark.parametrize("held, terms_, groups", [(200_000, 128, 64), (7, 3, 2), (1, 1, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, held, terms_, groups):
    rows = random_docs(held, 150)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    # Small dictionaries and blocks: several blocks of terms and of groups meet.
    counts, joint = divergence.term_counts, divergence.joint_tables
    monkeypatch.setattr(divergence, "term_counts", lambda d, m: counts(d, m, held))
    monkeypatch.setattr(divergence, "joint_tables", lambda c: joint(c, terms_, groups))
    got = divergence.audit(df, min_docs=4, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 4, 5)


def test_joint_tables_hold_every_term_once(spark):
    rows = [("en", f"t{i}", g, n, 5, 3) for i in range(40) for g, n in ((0, i % 3), (1, i % 2 + 1), (2, 0)) if n]
    cells = spark.createDataFrame(rows, "lang string, term string, g int, n long, lang_n long, size int")
    got = sorted(tuple(r) for r in divergence.joint_tables(cells, 7, 2).collect())
    want = Counter()
    for i in range(40):
        level = {0: i % 3, 1: i % 2 + 1, 2: 0}
        for g, h in ((0, 1), (0, 2), (1, 2)):
            if level[g] or level[h]:
                want["en", g, h, level[g], level[h]] += 1
    assert got == sorted((*k, v) for k, v in want.items())


def test_audit_on_edge_and_empty_rows(spark, edge, empty):  # noqa: F811
    rows = [(r[1], r[2], r[3]) for r in ROWS]
    got = divergence.audit(edge, min_docs=1, top=50)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 1, 50)
    # No term is in 30 documents: divergences are 0, and no term is listed.
    none = divergence.audit(edge).collect()
    assert none and all(r.part == "pair" and r.value == 0 for r in none)
    assert divergence.audit(empty).count() == 0


# Whitening


def brute_whitening(vectors, k):
    x = np.floor(1024 * vectors.astype(np.float64)) + 100_000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return centred @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum(), x


def test_query_equals_brute_force(spark, corpus):  # noqa: F811
    rows = corpus.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    vectors = np.array([r[1] for r in rows])
    white, explained, x = brute_whitening(vectors, 8)
    got = QUERIES["op13_embedding_whitening"](spark, SMALL).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(r[0], c) for r in rows for c in range(1, 9)]
    found = np.array([r.whitened for r in got]).reshape(-1, 8)
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-8
    assert np.abs(np.array([r.explained for r in got]).reshape(-1, 8) / explained - 1).max() < 1e-9
    n, whole = len(x), [[int(v) for v in line] for line in x]
    sums = [sum(c) for c in zip(*whole)]
    assert [r.deviation for r in got[::8]] == [sum((n * v - s) ** 2 for v, s in zip(line, sums)) for line in whole]
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("kind", ["full", "low rank", "ties", "identity", "graded", "one", "zero"])
def test_divide_and_conquer(kind):
    rng = np.random.default_rng(7)
    d = 1 if kind == "one" else 40
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {
        "full": np.linspace(1, 50, d), "low rank": np.r_[np.zeros(30), np.ones(10) * 4 + np.arange(10)], "ties": np.repeat([9.0, 1.0], 20),
        "identity": np.ones(d), "graded": 10.0 ** np.linspace(-12, 3, d), "one": np.array([3.0]), "zero": np.zeros(d),
    }[kind]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, basis = whitening.components_of(a)
    scale = max(values.max(), 1.0)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale
    assert np.abs(basis.T @ basis - np.eye(d)).max() < 1e-13
    assert np.abs(a @ basis - basis * found).max() <= 1e-13 * scale


def test_polar_factor_is_unitary_and_projects():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u.T @ u - np.eye(30)).max() < 1e-13
    h = u.T @ a
    assert np.abs(h - h.T).max() < 1e-12 and np.linalg.eigvalsh(h).min() > -1e-12
    upper, lower = whitening.split_subspace(a, 0.5)
    assert upper.shape[1] == (np.linalg.eigvalsh(a) > 0.5).sum() and np.abs(lower.T @ a @ upper).max() < 1e-11


def test_products_are_exact():
    z = np.random.default_rng(2).integers(-(1 << 43) + 1, 1 << 43, (200, 4))
    high, low = whitening.whole_products(z)
    big = z.astype(object)
    assert ((high.astype(object) * (1 << 40) + low) == big.T @ big).all()


def test_whitening_on_edge_and_empty_rows(spark):
    schema = "vec_id long, embedding array<float>, n int, size int, id string, whitened double"
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1e30, 0.0]]
    good = [[0.0, 1.0], [0.0, 1.0], [1.0, 0.5], [0.25, 0.0], [0.0, 0.0]]
    rows = [(i if i != 7 else None, v, 0, 0, "", 0.0) for i, v in enumerate(bad + good)]
    rows += [(100 + i, [float(i), 2.0, 3.0 * i], 0, 0, "", 0.0) for i in range(4)] + [(200, [5.0], 0, 0, "", 0.0)] + [(8, [1.0, 0.5], 0, 0, "", 0.0)]
    out = whitening.whiten(spark.createDataFrame(rows, schema))
    assert out.columns == ["vec_id", "size", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert Counter(r.size for r in got) == {2: 6, 3: 4, 1: 1} and sum(r.vec_id is None for r in got) == 1
    assert all(r.n == {1: 1, 2: 6, 3: 4}[r.size] for r in got)
    white, explained, _ = brute_whitening(np.array([*good, [1.0, 0.5]]), 2)
    two = np.array([r.whitened for r in got if r.size == 2])
    assert np.allclose(np.sort(np.abs(two), axis=0), np.sort(np.abs(white), axis=0))
    # One direction of the vectors of three has variance; a single vector has none at all.
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in got if r.size == 3)
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in got if r.size == 1] == [([None], [None], 0, None)]
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0


def test_covariance_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    fits = [whitening.fit(whitening.entries(df.repartition(n), "vec_id", "embedding"))[64] for n in (1, 5)]
    assert (fits[0].covariance == fits[1].covariance).all() and (fits[0].vectors == fits[1].vectors).all()


def test_deviation_beyond_a_long_is_null():
    space = whitening.Space(1 << 31, (5,), np.eye(1), np.ones(1), np.eye(1))
    assert whitening._deviations(np.array([[1 << 20], [0]]), space) == [None, 25]
