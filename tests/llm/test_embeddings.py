"""The operators on embeddings against brute force; null, zero, empty, ragged, repeated rows, clashing columns, no rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import hard_negatives, itq, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, node long, code binary, n long, x string, v int, comp long, table int, bucket long, block int, anchor long"
CLASH = (1, b"c", 2, "x", 3, 4, 5, 6, 7, 8)
ODD = [None, [], [None] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [1.0, 2.0]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    """Groups of near copies, one large, pairs at the threshold, far rows, repeats."""
    r = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(r.standard_normal((300, 16)))
    side = r.standard_normal((300, 16))
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    c = r.uniform(0.86, 0.96, (300, 1))
    crowd = unit(base[:1] + 0.07 * r.standard_normal((200, 16)))
    x = np.vstack([base, c * base + np.sqrt(1 - c * c) * side, crowd, crowd[:20], 3 * base[:5]])
    return x[r.permutation(len(x))]


def links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T >= 0.9


@pytest.mark.parametrize("side", [itq.SIDE, 25])
def test_near_vectors(spark, vectors, side):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(10_000 + i, v, 1) for i, v in enumerate([*ODD, [0.0] * 16])]
    got = {r.vec_id: r for r in itq.near_vectors(frame(spark, rows + odd), side=side).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    want = links(vectors)
    np.fill_diagonal(want, False)
    n = np.array([got[i].n_links for i in range(len(rows))])
    assert (n <= want.sum(1)).all() and n.sum() >= 0.95 * want.sum() > 30_000
    comp, least = np.array([got[i].component_id for i in range(len(rows))]), np.arange(len(rows))
    for _ in range(50):  # components of all links
        least = np.where(want, least[None, :], 10**9).min(1, initial=10**9, where=want).clip(max=least)
    assert (comp >= least).all() and (comp == least).mean() > 0.97
    assert all((got[i].kept is True) == (comp[i] == i) for i in range(len(rows)))


def test_sides_give_equal_rows(spark, vectors):
    df = frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(vectors)]).cache()
    a, b = (Counter(map(tuple, itq.near_vectors(df, side=s).collect())) for s in (10_000, 25))
    assert a == b


def test_near_vectors_ids_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    got = Counter(map(tuple, itq.near_vectors(frame(spark, [(5, v, 1), (5, v, 1), (None, v, 1), (3, [2.0, 4.0, 6.0], 1), (None, None, 1), (9, [-1.0, 0.0, 0.0], 1)])).collect()))
    assert got == Counter({(5, 3, 3, False): 2, (None, 3, 3, False): 1, (3, 3, 3, True): 1, (None, 0, None, False): 1, (9, 0, 9, True): 1})
    assert itq.near_vectors(frame(spark, [])).collect() == []
    assert [tuple(r) for r in itq.near_vectors(frame(spark, [(1, None, 1)])).collect()] == [(1, 0, 1, True)]


def test_threshold_is_exact():
    """A borderline cosine is decided by sums without rounding."""
    x = np.array([[3.0, 4.0], [1.0, 0.0], [0.8, 0.6], [0.9, math.sqrt(1 - 0.81)]])
    u = itq._units(x)
    a, b = np.array([0, 0, 1]), np.array([1, 2, 3])
    assert itq._linked(u, x, a, b, 0.6).tolist() == [True, True, True]
    assert itq._linked(u, x, a, b, np.nextafter(0.6, 1)).tolist() == [False, True, True]


def test_each_pair_is_decided_once():
    """Whatever the buckets, each pair within reach is given once if some substrings differ in two bits at most."""
    r = np.random.default_rng(4)
    code = r.integers(0, 64, (80, 3)).astype(np.uint32)
    code[40:60] = code[:20]
    flips = [0, *(1 << i for i in range(6))]
    rows = sorted((t, int(c[t]) ^ f, k) for k, c in enumerate(code) for t in range(3) for f in flips)
    table, bucket, k = (np.array(x) for x in zip(*rows))
    zero = np.zeros(len(rows), np.int32)
    seen = Counter()
    for a, b in itq._meeting(table, bucket.astype(np.uint32), zero, zero, zero, code[k], 7):
        seen.update(tuple(sorted(p)) for p in zip(k[a].tolist(), k[b].tolist()))
    far = lambda x, y: [int(p ^ q).bit_count() for p, q in zip(code[x].tolist(), code[y].tolist())]
    assert seen == Counter((x, y) for x in range(80) for y in range(x + 1, 80) if min(far(x, y)) <= 2 and sum(far(x, y)) <= 7)


@pytest.mark.parametrize("d", [3, 16])
def test_whitening(spark, d):
    r = np.random.default_rng(d)
    v = r.standard_normal((400, d)) @ np.diag(np.linspace(1, 3, d))
    v[300:] = v[0]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(1000 + i, x, 1) for i, x in enumerate(ODD)] + [(7, v[7].tolist(), 1), (None, v[8].tolist(), 1)]
    got = whitening.whiten(frame(spark, rows)).collect()
    k = min(d, 4)
    assert Counter(r.vec_id for r in got) == Counter([i for i, x, _ in rows if i is None or i < 1000] * k)
    x = np.floor(256 * v).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    for c in range(k):
        own = {r.vec_id: r for r in got if r.component == c + 1}
        w = np.array([own[i].whitened for i in range(400)])
        want = (x - s / n) @ u[:, c] / np.sqrt(e[c])
        assert np.allclose(w, np.sign(w @ want) * want, atol=1e-9)
        assert {own[i].deviation == int(((n * x[i] - s) ** 2).sum()) for i in range(400)} == {True}
        assert abs(own[0].explained - e[c] / np.trace(cov)) < 1e-10 and own[0].identity_error < 1e-9 and own[0].n == n


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 1)])).collect() == []
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got)] == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(frame(spark, [(i, [i / 4, i / 4], 1) for i in range(4)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True}
    with pytest.raises(Exception, match="deviation"):
        whitening.whiten(frame(spark, [(1, [1e14], 1), (2, [0.0], 1)])).collect()


@pytest.mark.parametrize(("d", "kind"), [(300, "flat"), (300, "falling"), (200, "two"), (150, "equal")])
def test_leading_pairs(d, kind):
    """Dimensions beyond the width of the search space, so that it is cut back and goes on."""
    r = np.random.default_rng(0)
    x = r.standard_normal((600, 2)) @ r.standard_normal((2, d)) if kind == "two" else r.standard_normal((600, d))
    x = x / np.arange(1, d + 1) ** 0.5 if kind == "falling" else x
    v = x.T @ x / 600
    if kind == "equal":
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        v = (q * np.r_[np.full(5, 5.0), np.ones(d - 5)]) @ q.T
    e, u, rest = whitening.leading(lambda q: v @ q, d, 4)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-10, atol=1e-9) and rest.max() <= 1e-10 * e[0]
    assert np.allclose(v @ u, u * e, atol=1e-9) and np.allclose(u.T @ u, np.eye(4), atol=1e-12)


def negatives(ids, label, x):
    out = set()
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        o = [k for k in np.lexsort((ids, -s)) if ids[k] != ids[i]]
        for p in [k for k in o if label[k] == label[i]][:5]:
            fits = [k for k in o if label[k] != label[i] and 30 * s[p] <= 100 * s[k] <= 90 * s[p]][:10]
            out |= {(int(ids[i]), int(ids[p]), n + 1, int(ids[k]), int(s[p]), int(s[k])) for n, k in enumerate(fits)}
    return out


@pytest.mark.parametrize(("block", "scale"), [(2048, 1.0), (3, 1.0), (2048, 0.02), (2048, 1e5)])
def test_hard_negatives(spark, block, scale):
    """Small blocks, few values (ties), and large whole numbers."""
    r = np.random.default_rng(9)
    x = r.standard_normal((1500, 8)) * scale
    x[1200:] = x[0] + 0.01 * scale * r.standard_normal((300, 8))
    label = r.integers(0, 4, 1500)
    label[100] = 77  # an anchor without positives
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))]
    odd = [(2000 + 100 * i, v, 1) for i, v in enumerate(ODD)] + [(None, x[3].tolist(), 1), (2700, x[4].tolist(), None), rows[200], rows[5]]
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows + odd), anchors=F.col("vec_id") % 100 == 0, block=block).collect()]
    want = negatives(np.arange(1500), label, np.floor(256 * x).astype(int))
    assert set(got) == want and len(got) == len(want) > 300


def test_hard_negatives_of_little(spark):
    f = hard_negatives.hard_negatives
    assert f(frame(spark, [])).collect() == [] and f(frame(spark, [(0, [1.0], 1)])).collect() == []
    assert f(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)])).collect() == []
    with pytest.raises(Exception, match="62 bits"):
        f(frame(spark, [(0, [1e10], 1), (1, [1e10], 1)])).collect()


def test_intervals_hold_the_product():
    r = np.random.default_rng(6)
    a, x = r.integers(-300, 300, (7, 5)), r.integers(-300, 300, (2000, 5))
    every = np.full((7, 1), hard_negatives.LEAST + 1), np.full((7, 1), 2**62), np.full((7, 1), hard_negatives.LEAST)
    i, c, score = hard_negatives.Planes(a, 9).scan(x, np.ones((7, 2000), bool), *every, 5)
    assert (score == (a @ x.T)[i, c]).all()
    for k in range(7):
        assert set(np.argsort(-(a[k] @ x.T), kind="stable")[:5]) <= set(c[i == k])
