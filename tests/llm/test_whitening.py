from fractions import Fraction

import numpy as np
import pytest

from hirelake.llm import whitening
from hirelake.llm.registry import LLM_QUERIES


def orthogonal(size, seed):
    """An orthogonal matrix in the widest type: a product of reflections."""
    draw, q = np.random.default_rng(seed), np.eye(size, dtype=np.longdouble)
    for _ in range(size):
        v = draw.normal(size=size).astype(np.longdouble)
        q -= 2 * np.outer(q @ v, v) / (v @ v)
    return q


@pytest.mark.parametrize("values", [
    np.arange(1, 41) ** 2.0,
    np.r_[np.linspace(1, 2, 20), 5 + 1e-9 * np.arange(10), np.full(10, 9.0)],  # a cluster below single precision, one value ten times
    np.r_[1e-8 * np.arange(1, 20), 3.0, 3.0 + 1e-7, 3.0 + 2e-7],
])
def test_eigenvectors_to_double_precision(values):
    size = len(values)
    q = orthogonal(size, 3)
    a = ((q * values) @ q.T).astype(float)
    a = (a + a.T) / 2
    found, x = whitening.eigenvectors(a)
    order = np.argsort(-values)
    top = values.max()
    assert np.all(np.diff(found) <= 1e-14 * top)
    assert np.abs(found - values[order]).max() < 1e-14 * top
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 1e-14 * top
    # Single precision alone is far from that.
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(rough.T @ a @ rough - np.diag(np.diagonal(rough.T @ a @ rough))).max() > 1e-9 * top
    for k, place in enumerate(order):
        gap = np.abs(np.delete(values, place) - values[place]).min()
        if gap > 1e-10 * top:  # the vector itself is defined: as good as rounding the matrix allows
            error = min(np.abs(x[:, k] - s * q[:, place].astype(float)).max() for s in (1, -1))
            assert error < 1e-14 * top / gap


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.eye(4), np.array([[2.0]]), np.zeros((0, 0))])
def test_plain_matrices(a):
    values, x = whitening.eigenvectors(a)
    assert np.allclose(a @ x, x * values, atol=1e-15) and np.allclose(x.T @ x, np.eye(len(a)), atol=1e-15)


def brute(rows, components=32):
    """(id, component) -> (n, deviation, whitened, explained) by exact sums and the solver in double precision."""
    used = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    whole = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for _, v in used], dtype=object)
    n, total = len(whole), whole.sum(axis=0)
    deviation = ((whole * n - total) ** 2).sum(axis=1)
    centred = np.array([[float(Fraction(int(x)) - Fraction(int(s), n)) for x, s in zip(r, total, strict=True)] for r in whole])
    v = centred.T @ centred / n
    values, x = np.linalg.eigh(v)
    values, x = values[::-1], x[:, ::-1]
    white = centred @ x / np.sqrt(values)
    return {(i, k + 1): (n, int(deviation[r]), white[r, k], values[k] / np.trace(v))
            for r, (i, _) in enumerate(used) for k in range(min(components, len(total)))}


def test_whitening_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    basis = draw.normal(size=(40, 40)) * np.linspace(3, 0.5, 40)
    rows = [(i, (draw.normal(size=40) @ basis + 5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 39 + [None]), (302, [float("nan")] * 40), (303, [float("inf")] + [0.0] * 39),
             (304, [1.0, 2.0]), (305, []), (None, rows[0][1]), (7, rows[0][1])]
    wanted = {}
    kept = [(k, v) for k, (i, v) in enumerate(rows) if i not in (304, 305)]
    for (k, c), found in brute(kept).items():
        wanted.setdefault((rows[k][0], c), []).append(found)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "'a' AS Vector").repartition(5)
    model = whitening.fit(frame)
    assert model.n == 302 and model.identity_error < 1e-10
    sign, seen = {}, {}
    for r in whitening.whiten(frame, model, ["vec_id", "n", "Vector"]).collect():
        assert r["n"] == 1 and r["Vector"] == "a"
        seen.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert set(seen) == set(wanted)
    for key, found in seen.items():
        found.sort(key=lambda r: r["deviation"])
        for r, (_, deviation, white, explained) in zip(found, sorted(wanted[key], key=lambda w: w[1]), strict=True):
            assert r["deviation"] == deviation and abs(r["explained"] / explained - 1) < 1e-9
            flip = sign.setdefault(key[1], 1 if abs(r["whitened"] - white) < abs(r["whitened"] + white) else -1)
            assert abs(r["whitened"] - flip * white) < 1e-8


@pytest.mark.parametrize("rows, n", [([], None), ([(1, None), (2, [])], None), ([(1, [1.0, 2.0])], 1), ([(1, [3.0]), (1, [3.0])], 2)])
def test_nothing_to_whiten(spark, rows, n):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fit(frame)
    assert (model.n if model else None) == n
    assert whitening.whiten(frame, model, ["vec_id"]).collect() == []


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.5, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitening.whiten(frame, whitening.fit(frame), ["vec_id"]).collect()
    assert {r["deviation"] for r in found if r["vec_id"] < 3} == {None} and np.isfinite([r["whitened"] for r in found]).all()


def test_query(spark):
    rows = LLM_QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    source = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    wanted, sign = brute(source), {}
    found = rows.collect()
    assert len(found) == len(wanted)
    for r in found:
        n, deviation, white, explained = wanted[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] / explained - 1) < 1e-9
        assert r["identity_error"] < 1e-9
        flip = sign.setdefault(r["component"], 1 if r["whitened"] * white > 0 else -1)
        assert abs(r["whitened"] - flip * white) < 1e-8
