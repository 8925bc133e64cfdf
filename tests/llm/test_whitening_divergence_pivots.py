"""Whitening, source divergence and pivot permutations against brute force, with their edge cases."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import divergence, pivots, queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, n string, cid string, d long"
BAD = [(900, None), (901, [0.0] * 6), (902, [1.0, float("nan"), 0, 0, 0, 0]), (903, [1.0, None, 0, 0, 0, 0]), (904, [float("inf")] + [0.0] * 5), (905, []), (906, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a", "b", "c", 7) for i, v in rows], SCHEMA).repartition(3)


def drawn(n, d=6, seed=3):
    return np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)


def test_whitening_by_brute_force(spark):
    x = drawn(80)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(3, x[3].tolist()), (None, x[4].tolist())]
    got = whitening.whiten(frame(spark, rows + BAD), k=4).toPandas()
    kept = [*rows, (901, [0.0] * 6)]
    g = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    n, sums = len(g), g.sum(0)
    assert len(got) == 4 * n and set(got.n) == {n} and set(got.component) == {1, 2, 3, 4}
    z = g - sums / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    w = z @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    for c in range(4):
        mine = got[got.component == c + 1]
        assert np.allclose(sorted(np.abs(mine.whitened)), sorted(np.abs(w[:, c])), atol=1e-9)
        assert np.allclose(mine.explained, values[::-1][c] / values.sum(), rtol=1e-9)
    assert Counter(got[got.component == 1].deviation) == Counter(((n * g - sums) ** 2).sum(1).tolist())
    assert got.identity_error.max() < 1e-10 and got.vec_id.isna().sum() == 4


def test_whitening_of_few_and_equal_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, BAD[:1])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1, 2, 3]), (2, [1, 2, 3])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1, 2, 3]), (2, [2, 2, 3]), (3, [4, 2, 3])])).count() == 3
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(frame(spark, [(1, [1e30, 2, 3]), (2, [1, 2, 3])])).collect()


def test_subspace_certifies_close_eigenvalues(spark):
    """Wider vectors than the first block: several passes, and a block that grows, give numpy's values."""
    x = (np.random.default_rng(5).standard_normal((400, 90)) * np.linspace(1, 0.8, 90)).astype(np.float32)
    rows = whitening.usable(frame(spark, list(enumerate(x.tolist()))), "vec_id", "embedding")
    f = whitening.fit(rows, 90, 400, 5)
    g = np.floor(64 * x.astype(float))
    z = g - g.mean(0)
    assert f.passes > 1 and f.residual <= 1e-12
    assert np.allclose(f.values, np.linalg.eigvalsh(z.T @ z / 400)[::-1][:5], rtol=1e-10)


def test_deviations_beyond_a_long():
    x = np.array([[2**45, 0], [0, 1]])
    assert whitening._deviations(x, 4, x.sum(0)).to_pylist() == [None, None]
    assert whitening._deviations(np.array([[3, 1], [1, 1]]), 2, np.array([4, 2])).to_pylist() == [4, 4]


TEXTS = [
    (1, "Apple apple pear Straße É é", "en", "s1"), (2, "apple pear plum x1y2", "en", "s2"), (3, "apple pear plum", "en", "s2"), (4, "plum APPLE fig", "en", None),
    (5, None, "en", "s3"), (5, "plum", None, "s1"), (6, "plum plum", "", "s1"), (None, "plum", None, "s2"), (7, "", "fr", "s1"), (8, "one two", "fr", "s2"), (9, "weit und breit", "de", "s1"),
    (10, "apple " * 30_000, "en", "s1"), (11, "ÄPFEL äpfel", "en", "s1"), (11, "ÄPFEL äpfel", "en", "s1"), (11, "ÄPFEL Äpfel", "en", "s1"),
]


def brute_divergence(rows, least, most):
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in terms}:
        of = [t for t in terms if t[0] == lang]
        docs = Counter(t for *_, ts in of for t in set(ts))
        kept = {t for t, n in docs.items() if n >= least}
        sources = {s: Counter(t for _, o, ts in of if o == s for t in ts if t in kept) for s in {t[1] for t in of}}
        whole = sum(sources.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s, c in sources.items():
            pair = [(o, sum((share(c, t) - share(x, t)) ** 2 // share(x, t) for t in kept)) for o, x in sources.items() if o != s]
            more = [(t, (share(c, t) - share(whole, t)) ** 2 // share(whole, t)) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in (("pair", pair), ("term", more)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked[: most if part == "term" else None], 1)]
    return Counter(out)


def test_divergence_by_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", 2, "y") for r in TEXTS], "doc_id long, text string, lang string, source string, term string, n long, s string").repartition(3)
    for least, most in ((3, 200), (1, 2)):
        assert Counter(map(tuple, divergence.audit(docs, least, most).collect())) == brute_divergence(TEXTS, least, most)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_shares_stay_exact_beyond_a_long(spark):
    big = spark.createDataFrame([(20_000_000_000, 70_000_000_000, 3), (8_999_999_999, 9_000_000_000, 7)], "c long, n long, v long")
    got = [r[0] for r in big.select(divergence.share(big.c, big.n, big.v)).collect()]
    assert got == [1 + 10**9 * 20_000_000_001 // 70_000_000_003, 1 + 10**9 * 9_000_000_000 // 9_000_000_007]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_divergence_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.queries()["op12_source_divergence"](spark, SF)
    want = con.execute(queries.OP12_SQL)
    cols = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(want.fetchall())


def brute_links(rows, least):
    use = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for k, a in use:
        for m, b in use:
            if k < m and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[k].add(m)
                links[m].add(k)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            todo += [m for m in links[todo.pop()] if m not in seen and not seen.add(m)]
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        root = min(ids, default=None)
        out.append((rows[k][0], len(links[k]), root, rows[k][0] is not None and rows[k][0] == root))
    return Counter(out)


@pytest.fixture(scope="module")
def linked():
    """Chains, a crowd of near copies, exact copies, scaled copies, equal ids, a null id."""
    x = drawn(60, seed=8)
    rng = np.random.default_rng(9)
    rows = [(100 + i, v) for i, v in enumerate(x.tolist())]
    rows += [(300 + i, (x[0] + 0.15 * rng.standard_normal(6)).astype(np.float32).tolist()) for i in range(70)]
    rows += [(500, rows[1][1]), (501, rows[1][1]), (1, rows[70][1]), (502, (2 * x[2]).tolist()), (503, x[3].tolist()), (503, (-x[3]).tolist()), (None, x[5].tolist())]
    return rows + BAD


@pytest.mark.parametrize("named", [1, 2])
@pytest.mark.parametrize("block", [2048, 16])
def test_pivots_by_brute_force(spark, linked, named, block):
    """Few dimensions and 40 pivots of which 12 are taken: every link is found, however lists are named and dealt."""
    got = pivots.near_duplicates(frame(spark, linked), pivots=40, named=named, block=block)
    assert Counter(map(tuple, got.collect())) == brute_links(linked, 0.9)


def test_pivots_of_few_rows(spark):
    assert pivots.near_duplicates(frame(spark, [])).count() == 0
    assert Counter(map(tuple, pivots.near_duplicates(frame(spark, BAD[:2])).collect())) == Counter([(900, 0, 900, True), (901, 0, 901, True)])
    two = [(2, [1, 0, 0, 0, 0, 0]), (1, [1, 0.1, 0, 0, 0, 0])]
    assert Counter(map(tuple, pivots.near_duplicates(frame(spark, two)).collect())) == brute_links(two, 0.9)


def test_each_pair_is_in_one_list():
    """Over all lists, links_of_list gives each pair with enough shared pivots once, for every number of named pivots."""
    rng = np.random.default_rng(4)
    codes = np.array([np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)])
    unit = np.ones((60, 1))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(set(codes[i]) & set(codes[j])) >= 3}
    for named in (1, 2, 3):
        names = pivots.list_names(codes, 3, named)
        found = []
        for name in np.unique(names):
            rows = np.flatnonzero((names == name).any(1))
            i, j = pivots.links_of_list(int(name), named, 3, codes[rows], unit[rows], None, 0.9)
            found += [(rows[a], rows[b]) for a, b in zip(i, j)]
        assert len(found) == len(set(found)) and set(found) == want


def test_pivots_recall_at_the_threshold(spark):
    """Pairs at a cosine of just 0.9 in 64 dimensions among as many others: at least 0.98 of them are found."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.standard_normal((400, 64))
    away -= (away * base).sum(1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    near = 0.901 * base + np.sqrt(1 - 0.901**2) * away
    rows = [(i, v) for i, v in enumerate(np.vstack([base, near, rng.standard_normal((1500, 64))]).tolist())]
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[i] for i in range(400)) >= 392 and sum(got.values()) == 2 * sum(got[i] for i in range(400))
