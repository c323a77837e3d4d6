import numpy as np
import pytest

from textloom.llm import hilbert, topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def rows(n, dims, seed, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).round(1 if ties else 6).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a hot vector
    return [(i, [float(v) for v in x[i]], "s", i) for i in range(n)] + [(n, None, "s", 1), (n + 1, [1.0, None] + [0.0] * (dims - 2), "s", 1), (n + 2, [float("nan")] * dims, "s", 1), (n + 3, [0.0] * dims, "s", 1)]


def brute(data, every, k, cosine):
    data = [(i, np.array(v, float)) for i, v, *_ in data if v is not None and all(x is not None and np.isfinite(x) for x in v) and (not cosine or any(v))]
    out = {}
    for i, v in data:
        if i % every == 0:
            s = []
            for j, w in data:
                if j != i:
                    s.append((-((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))) if cosine else -int((np.floor(v * 1024) * np.floor(w * 1024)).sum()), j))
            out[i] = sorted(s)[:k]
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_topk_equals_brute_force(spark, ties):
    data = rows(300, 6, 1, ties)
    got = {}
    for r in topk.search(spark.createDataFrame(data, SCHEMA), lambda c: c % 20 == 0, rows_in_block=64, queries_in_block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = brute(data, 20, 10, False)
    assert {q: [(s, j) for _, s, j in sorted(v)] for q, v in got.items()} == want


def test_topk_batches_hold_few_cells(spark, monkeypatch):
    """A batch of cells, each of which may have megabytes, holds a bounded number of them, however many blocks meet."""
    import pyarrow as pa

    def sizes(heads, k):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([batch.num_rows], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["query_id", "vec_id", "score"])

        return run

    monkeypatch.setattr(topk, "_each", sizes)
    monkeypatch.setattr(topk, "CELLS", 16_000, raising=False)  # four cells
    got = topk.search(spark.createDataFrame(rows(300, 6, 1), SCHEMA), lambda c: c % 5 == 0, rows_in_block=60, queries_in_block=1).collect()
    assert 0 < max(r.score for r in got) <= 40


def test_topk_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x", 1), (1, [0.5, 0.5], "x", 1)], SCHEMA)
    assert [tuple(r) for r in topk.search(df, lambda c: c % 100 == 0).collect()] == [(0, 1, 1, 1024 * 512 + 2048 * 512)]
    assert topk.search(df.limit(0), lambda c: c % 100 == 0).count() == 0


def test_topk_repeated_queries(spark):
    data = rows(120, 6, 3)
    data += [data[0], data[20], data[20], (40, [3.0] * 6, "s", 1), (41, [2.0] * 6, "s", 1), (41, [2.0] * 6, "s", 1)]
    good = [(i, np.floor(np.array(v) * 1024)) for i, v, *_ in data if v is not None and None not in v and np.isfinite(v).all()]
    want = {}
    for q in range(0, 120, 20):
        best = {}
        for s, j in ((int((a * b).sum()), j) for i, a in good if i == q for j, b in good if j != q):
            best[j] = max(s, best.get(j, s))
        want[q] = sorted((-s, j) for j, s in best.items())[:10]
    got = {}
    for r in topk.search(spark.createDataFrame(data, SCHEMA), lambda c: c % 20 == 0, rows_in_block=32, queries_in_block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert {q: [(s, j) for _, s, j in sorted(v)] for q, v in got.items()} == want


def test_hilbert_curve_is_a_path():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    path = cells[np.argsort(hilbert.hilbert_key(cells, 3))]
    assert len(set(hilbert.hilbert_key(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_hilbert_recall(spark):
    data = rows(3000, 16, 2)
    got = {}
    for r in hilbert.search(spark.createDataFrame(data, SCHEMA), 50, block=64, steps=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(data, 50, 5, True)
    assert set(got) == set(want)
    hit = sum(s >= -want[q][-1][0] - 1e-12 for q, v in got.items() for _, s, _ in v)
    assert hit / sum(map(len, want.values())) >= 0.9
    assert all([r[0] for r in sorted(v)] == list(range(1, 6)) for v in got.values())


def test_hilbert_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x", 1), (1, [0.5, 0.5], "x", 1), (2, [0.0, 0.0], "x", 1)], SCHEMA)
    assert [tuple(r)[:3] for r in hilbert.search(df, 50).collect()] == [(0, 1, 1)]
    assert hilbert.search(df.limit(0), 50).count() == 0


def test_topk_of_components_of_any_size(spark):
    data = [(0, [1e306, 1.0]), (1, [1.0, 1.0]), (2, [-1e306, 5.0]), (3, [2.0**45, 0.25]), (4, [3.0]), (5, [])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in data], "vec_id long, embedding array<double>, score string, rank int")
    whole = {i: [int(x) * 1024 if abs(x) > 2**60 else int(np.floor(x * 1024)) for x in [*v, 0.0, 0.0][:2]] for i, v in data}
    want = {q: sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], w)))), i) for i, w in whole.items() if i != q) for q in (0, 3)}
    got = {}
    for r in topk.search(df, lambda c: c % 3 == 0, rows_in_block=2, queries_in_block=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert {q: [(s, j) for _, s, j in sorted(v)] for q, v in got.items()} == want


def test_hilbert_of_components_of_any_size(spark):
    data = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [5e-324, 0.0]), (3, [5e-324, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in data], "vec_id long, embedding array<double>, score string, rank int")
    got = {r.vec_id: r.score for r in hilbert.search(df, 50).collect()}
    assert got == {1: pytest.approx(1), 2: pytest.approx(2**-0.5), 3: pytest.approx(2**-0.5)}


def test_hilbert_repeated_ids(spark):
    """Rows that repeat a vec_id are all candidates; the best pair counts, and no vec_id stands twice."""
    data = [(50, [1.0, 0.0], "s", 1), (1, [1.0, 0.1], "s", 1), (1, [0.0, 1.0], "s", 1), (2, [0.5, 0.5], "s", 1), (50, [0.0, -1.0], "s", 1), (3, [0.0, -2.0], "s", 1)]
    data += [(4, [-1.0, k / 100], "s", 1) for k in range(40)] + [(50, [], "s", 1), (5, [], "s", 1)]
    got = [(r.vec_id, r.score) for r in sorted(hilbert.search(spark.createDataFrame(data, SCHEMA), 50).collect(), key=lambda r: r["rank"])]
    assert [v for v, _ in got] == [3, 1, 2, 4] and got[0][1] == 1.0 and got[1][1] == pytest.approx(1 / np.sqrt(1.01)) and got[2][1] == pytest.approx(np.sqrt(0.5))


def test_topk_of_empty_vectors(spark):
    data = [(0, [], "s", 1), (1, [1.0], "s", 1), (2, [], "s", 1), (20, [2.0], "s", 1)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(data, SCHEMA), lambda c: c % 20 == 0).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 20, 0), (20, 1, 1, 1024 * 2048), (20, 2, 0, 0), (20, 3, 2, 0)]
