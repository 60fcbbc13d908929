import numpy as np
import pytest

from broadsheet.llm import ann


def exact(ids, x, at, n=10):
    d = np.sqrt(((x - x[at]) ** 2).sum(1))
    d[at] = np.inf
    return [int(ids[i]) for i in np.lexsort((ids, d))[:n]], d


def test_recall_and_measure(spark):
    draw = np.random.default_rng(6)
    x = (draw.normal(size=(2000, 16)) + 3 * draw.normal(size=(20, 16)).repeat(100, 0)).astype(np.float32)
    x[500:900] = x[500]  # a fifth of all are one vector
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(2000)], "vec_id long, embedding array<float>")
    found = ann.nearest(vectors, vectors.where("vec_id % 100 = 0")).toPandas().sort_values(["query_id", "rank"])
    wide, hits = x.astype(np.float64), 0
    for q, mine in found.groupby("query_id"):
        true, d = exact(np.arange(2000), wide, q)
        hits += len(set(true) & set(mine.vec_id))
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine.score, d[mine.vec_id], rtol=1e-14)
        if 500 <= q < 900:
            assert mine.vec_id.tolist() == true
    assert hits / 200 >= 0.9 and found.query_id.nunique() == 20


def test_edges(spark):
    inf = float("inf")
    rows = [(100 * i, [1.0, 2.0, float(i % 2)], 1) for i in range(6)]
    rows += [(1, None, 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 2.0], 1), (4, [inf, 1.0, 1.0], 1), (5, [1.0, 2.0], 1), (7, [1.0, 2.0, 1.0], 1), (None, [1.0, 2.0, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    found = pytest.rows(ann.nearest(vectors, vectors.where("vec_id = 0 or vec_id = 2")), "query_id", "rank", "vec_id", "score")
    assert found == [(0, 1, 200, 0.0), (0, 2, 400, 0.0), (0, 3, 7, 1.0), (0, 4, 100, 1.0), (0, 5, 300, 1.0), (0, 6, 500, 1.0)]
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    alone = vectors.where("vec_id = 0")
    assert ann.nearest(alone, alone).count() == 0


@pytest.mark.parametrize("odd", [{7: 1e39, 1300: -3e38}, {7: 1e200, 500: 1.7e308, 501: -1.7e308}, {}])
@pytest.mark.parametrize("unit", [1.0, 1e-200])
def test_components_of_any_size(spark, odd, unit):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(1500, 16)) * unit
    for at, value in odd.items():
        x[at, at % 16] = value
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    asked = [*range(0, 1500, 50), *odd]
    found = ann.nearest(vectors, vectors.where(vectors.vec_id.isin(asked))).toPandas()
    hits = 0
    for q, mine in found.groupby("query_id"):
        d = ann.measure(x, x[q])
        d[q] = np.nan
        true = np.lexsort((np.arange(1500), d))[:10]
        hits += len(set(true) & set(mine.vec_id))
        assert (mine.score.to_numpy() == d[mine.vec_id]).all()
        if q in odd:
            assert mine.sort_values("rank").vec_id.tolist() == true.tolist()
    assert hits >= 0.95 * 10 * len(asked)


def test_distances_out_of_the_square_range():
    x = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [1e308, 0.0], [0.0, 0.0]])
    assert np.allclose(ann.measure(x, np.zeros(2)), [5e200, 5e-200, 5.0, 1e308, 0.0], rtol=1e-15)
    assert ann.measure(x, np.array([-1e308, 0.0]))[3] == np.inf and ann.measure(x, np.array([-5e307, 0.0]))[3] == 1.5e308
