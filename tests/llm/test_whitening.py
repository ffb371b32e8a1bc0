import math

import numpy as np
import pytest

from plumbline.llm import whitening


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, d int, digest string")


def grid(rows):
    kept = [(i, v) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    return [i for i, _ in kept], [[math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v] for _, v in kept]


def brute(rows, weigh=True):
    ids, x = grid(rows)
    fit = x if weigh else sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    covariance = centred.T @ centred / n
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    return ids, n, deviation, np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x]), *np.linalg.eigh(covariance)


def check(found, rows, components=32, weigh=True):
    ids, n, deviation, centred, values, vectors = brute(rows, weigh)
    assert len(found) == len(ids) * min(components, len(values))
    by_component = {}
    for r in found:
        by_component.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9
    assert sorted(by_component) == list(range(1, min(components, len(values)) + 1))
    for c, part in by_component.items():
        e, v = values[-c], vectors[:, -c]
        assert np.allclose([r["explained"] for r in part], e / values.sum(), rtol=1e-6)
        want = sorted(zip(map(str, ids), deviation, np.round(centred @ v / np.sqrt(e), 6), strict=True))
        got = {s: sorted((str(r["vec_id"]), r["deviation"], round(s * r["whitened"], 6)) for r in part) for s in (1, -1)}
        assert any(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(g, want, strict=True)) for g in got.values())


def some(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) * (1 + np.arange(d))).tolist()) for i in range(n)]


@pytest.mark.parametrize("weigh", [True, False])
def test_equals_brute_force(spark, weigh):
    rows = some(300, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows are one vector
    rows += [(None, rows[1][1]), (5, rows[5][1]), (5, rows[5][1]), (2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [0.0] * 6)]
    check(whitening.whiten(table(spark, rows), weigh=weigh).collect(), rows, weigh=weigh)


def test_first_components_only(spark):
    rows = some(200, 40, 2)
    found = whitening.whiten(table(spark, rows)).collect()
    check(found, rows)
    check(whitening.whiten(table(spark, rows), components=3).collect(), rows, 3)


def test_far_from_zero(spark):
    """Small differences beside large entries: products before centring would lose them."""
    rows = [(i, [1e6 + a, 1e6 - 2 * b]) for i, (a, b) in enumerate(np.random.default_rng(1).integers(0, 9, (100, 2)).astype(float).tolist())]
    check(whitening.whiten(table(spark, rows)).collect(), rows)


def test_deviation_beyond_a_long(spark):
    rows = [(0, [3e14, 1.0]), (1, [-3e14, 2.0]), (2, [1e13, 4.0])]
    _, x = grid(rows)
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    for r in whitening.whiten(table(spark, rows)).collect():
        assert int(r["deviation_exact"]) == want[r["vec_id"]] and r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None)


def test_sums_beyond_a_long():
    x = np.array([[2**61, 1], [2**61, -1], [-(2**60), 5]], np.int64)
    assert whitening.exact_sums(x, np.array([9, 9, 2])) == [18 * 2**61 - 2 * 2**60, 10]
    y, whole = whitening.centred(x, 20, [18 * 2**61 - 2 * 2**60, 10])
    assert whole.dtype == object and whole[2, 1] == 90 and abs(y[2, 1] - 4.5) < 1e-12


def test_no_variance_and_lengths(spark):
    """Equal vectors have no component; lengths are apart; an entry that never changes gives an eigenvalue of none."""
    same = whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all(r["whitened"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 and r["deviation"] == 0 for r in same)
    rows = some(50, 3)
    mixed = whitening.whiten(table(spark, rows + [(100 + i, v) for i, v in some(30, 4)])).collect()
    check([r for r in mixed if r["vec_id"] < 100], rows)
    flat = whitening.whiten(table(spark, [(i, [*v, 7.0]) for i, v in rows])).collect()
    last = [r for r in flat if r["component"] == 4]
    assert len(last) == 50 and all(r["whitened"] == 0 and r["identity_error"] < 1e-9 for r in last)


def test_empty(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
