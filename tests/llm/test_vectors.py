"""Hard negatives and whitening against brute force and on their defined edge cases."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferbatch.llm import hard_negatives as hn
from inferbatch.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, e int, v int, anchor int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def usable(row):
    return None not in row and len(row[1]) > 0 and all(c is not None and np.isfinite(c) for c in row[1])


def brute_negatives(rows, every=1, positives=5, negatives=3):
    good = [(i, [int(np.floor(256 * c)) for c in e], y) for i, e, y in filter(usable, rows)]
    out = set()
    for i, q, y in good:
        if i % every:
            continue
        scores = [(sum(a * b for a, b in zip(q, e)), j, z) for j, e, z in good if j != i and len(e) == len(q)]
        same = sorted((-s, j) for s, j, z in scores if z == y)[:positives]
        for neg, p in same:
            fit = sorted((-s, j) for s, j, z in scores if z != y and 50 * -neg <= 100 * s <= 95 * -neg)
            out |= {(i, p, k + 1, j, -neg, -s) for k, (s, j) in enumerate(fit[:negatives])}
    return out


def mined(spark, rows, every=1, **kw):
    df = rows if not isinstance(rows, list) else frame(spark, rows)
    return [tuple(r) for r in hn.hard_negatives(df, F.col("id") % every == 0, F.col("label"), **kw).collect()]


def vectors_of(kind, n=160, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    if kind == "sparse":
        e = rng.standard_normal((n, dim)) * (rng.random((n, dim)) < 0.3)
    elif kind == "spread":
        # Lengths over three powers of ten: many buckets, most of them too short to matter.
        e = rng.standard_normal((n, dim)) * 10 ** rng.uniform(-2, 1, (n, 1))
    else:
        e = rng.integers(-2, 3, (n, dim)) / 4
    return [(i, [float(c) for c in e[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("kind", ["sparse", "spread", "ties"])
@pytest.mark.parametrize("bucket_rows", [7, 2048])
def test_hard_negatives_match_brute_force(spark, kind, bucket_rows):
    rows = vectors_of(kind)
    got = mined(spark, rows, every=3, bucket_rows=bucket_rows)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, every=3)


def test_hard_negatives_in_several_waves_give_the_same(spark):
    rows = vectors_of("ties", n=90)
    assert set(mined(spark, rows, wave_bytes=4_000)) == brute_negatives(rows)


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, [0.0, 0.0], 1), (4, [-1.0, 0.0], 2)]
    rows += [(5, None, 1), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [0.9, 0.0], None), (None, [0.9, 0.0], 2)]
    rows += [(10, [], 2), (11, [0.9, 0.0, 0.0], 2), (12, [1e6, 0.0], 3)]
    got = mined(spark, rows)
    assert set(got) == brute_negatives(rows) and got
    # Beyond the bound of a component: clamped, and the score still fits a long.
    high = [(1, [1e300, 1e300], 1), (2, [1e300, 1e300], 1), (3, [1e9, 1e9], 2)]
    assert {g[1:5] for g in mined(spark, high) if g[0] == 1} <= {(2, 1, 3, 2 * int((2.0**62 / 2) ** 0.5) ** 2)}
    # Repeated rows of an id are one entry of a list.
    again = [*rows, rows[0], rows[1], rows[2], rows[2]]
    assert sorted(mined(spark, again)) == sorted(got)
    assert mined(spark, frame(spark, rows).filter("vec_id > 100")) == []
    assert mined(spark, rows, every=1000) == [g for g in got if g[0] == 0]


def test_hard_negative_buckets_prune_without_losing_rows():
    """Candidate sets hold every row that reaches the least score, and leave most others out."""
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((400, 8)) ** 3 * 200).astype(np.int64)
    bucket, anchors = hn.Bucket(np.arange(400), v), hn.Anchors.of(np.arange(50), v[:50])
    scores = v[:50] @ v.T
    least = np.sort(scores, axis=1)[:, -5]
    found = bucket.candidates(anchors, least)
    assert found[scores >= least[:, None]].all()
    assert found.mean() < 0.5
    rows, exact = bucket.scores(anchors, found)
    assert (exact == scores[:, rows]).all()


def leverrier(m):
    """Coefficients of det(x I - m), lowest first, by traces of powers in fractions."""
    n = len(m)
    m = [[Fraction(int(x)) for x in row] for row in m]
    c, step = [Fraction(0)] * n + [Fraction(1)], [[Fraction(0)] * n for _ in range(n)]
    for k in range(1, n + 1):
        step = [[sum(m[i][h] * step[h][j] for h in range(n)) + (c[n - k + 1] if i == j else 0) for j in range(n)] for i in range(n)]
        c[n - k] = -sum(m[i][h] * step[h][i] for i in range(n) for h in range(n)) / k
    return [int(x) for x in c]


def matrix_of(kind):
    rng = np.random.default_rng(2)
    if kind == "repeated":
        q = np.array([[1, 1, 0, 0, 0], [1, -1, 0, 0, 0], [0, 0, 1, 1, 0], [0, 0, 1, -1, 0], [0, 0, 0, 0, 1]])
        return q @ np.diag([5, 5, 5, 2, 0]) @ q.T
    a = rng.integers(-50, 50, (7, 4 if kind == "deficient" else 9))
    m = a @ a.T
    if kind == "holes":
        m[2], m[:, 2] = 0, 0
    return m


@pytest.mark.parametrize("kind", ["full", "deficient", "holes", "repeated"])
def test_characteristic_polynomial_roots_and_null_spaces(spark, kind):
    m = matrix_of(kind)
    poly = wh.characteristic_polynomial(spark, m.tolist())
    assert poly == leverrier(m)
    want = np.linalg.eigvalsh(m.astype(float))[::-1]
    roots = wh.largest_roots(poly, len(m))
    values = [float(wh.middle(r)) for r in roots for _ in range(r.times)]
    assert np.allclose(values, want[: len(values)], rtol=1e-12) and np.abs(want[len(values) :]).max(initial=0) < 1e-9
    v = np.array([[float(x) for x in line] for r in roots for line in wh.null_space(m.tolist(), r)])
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-15)
    assert np.allclose(m @ v.T, v.T * values, rtol=0, atol=1e-12 * want[0])


def test_primes_and_remainders():
    few = wh.primes(2**100)
    assert all(all(p % q for q in range(2, 3000)) for p in few) and len(set(few)) == len(few)
    values = [0, 1, -1, 2**98, -(2**98)]
    assert wh.remaindered([[v % p for v in values] for p in few], few) == values
    limbs = [wh._limbs(v) for v in (5, -(2**130) + 7)]
    assert [sum(x << wh.LIMB * k for k, x in enumerate(line)) for line in limbs] == [5, -(2**130) + 7]


def brute_whitening(rows, most=8):
    good = [(r[0], r[1]) for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in e] for _, e in good], object)
    n, sums = len(x), x.sum(0)
    far = [int(v) for v in ((n * x - sums) ** 2).sum(1)]
    y = (x - np.array([Fraction(int(s), n) for s in sums])).astype(float)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return [i for i, _ in good], far, e / (y * y).sum() * n, y @ v / np.sqrt(e)


def whitened(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {})[r["component"]] = r
    return out


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    e = rng.standard_normal((300, 10)) @ rng.standard_normal((10, 10)) / 4
    rows = [(i, [float(c) for c in e[i]], None) for i in range(300)]
    ids, far, shares, want = brute_whitening(rows)
    got = whitened(wh.whiten(frame(spark, rows).repartition(5)))
    assert sorted(got) == ids and {len(c) for c in got.values()} == {8}
    matrix = np.array([[got[i][k]["whitened"] for k in range(1, 9)] for i in ids])
    signs = np.sign((matrix * want).sum(0))
    assert np.allclose(matrix, want * signs, atol=1e-8)
    assert [int(got[i][1]["deviation"]) for i in ids] == far
    some = got[0]
    assert np.allclose([some[k]["explained"] for k in range(1, 9)], shares, rtol=1e-10)
    assert {r["n"] for c in got.values() for r in c.values()} == {300}
    assert max(r["identity_error"] for c in got.values() for r in c.values()) < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 0.5], 1), (2, [0.0, 1.0, 0.5], 1), (3, [0.0, 0.0, 0.5], None), (3, [0.0, 0.0, 0.5], None), (None, [0.5, 0.5, 0.5], 1)]
    bad = [(6, None, 1), (7, [], 1), (8, [1.0, None, 0.0], 1), (9, [nan, 0.0, 0.0], 1), (10, [0.0, inf, 0.0], 1), (11, [1.0, 2.0], 1)]
    rows = wh.whiten(frame(spark, good + bad)).collect()
    # The third dimension is the same everywhere: two components, for each of the five rows.
    assert sorted((str(r["id"]), r["component"]) for r in rows) == sorted((str(i), k) for i, _, _ in good for k in (1, 2))
    assert {r["n"] for r in rows} == {5} and rows[0]["identity_error"] < 1e-9
    assert wh.whiten(frame(spark, bad).filter("vec_id < 10")).count() == 0
    assert wh.whiten(frame(spark, good[:1])).count() == 0 and wh.whiten(frame(spark, good).filter("vec_id > 100")).count() == 0
    huge = [(1, [1e300, 0.0], 1), (2, [-1e300, 0.0], 1), (3, [0.0, 1e9], 1), (4, [0.0, 5.0], 1)]
    rows = wh.whiten(frame(spark, huge)).collect()
    assert len(rows) == 8 and rows[0]["identity_error"] < 1e-6
