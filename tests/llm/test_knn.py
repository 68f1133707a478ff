import numpy as np

from leafmill.llm import knn


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "m") for i, v in rows], "vec_id bigint, vector array<float>, id string")


def _brute(rows, k, least):
    ids = np.array([i for i, _ in rows])
    x = np.array([np.array(v, dtype=np.float32) for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    out = {}
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out[int(ids[i])] = {int(ids[j]) for j in order if s[i, j] >= least}
    return out


def test_graph_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 16))
    rows = [(i, centers[i % 40] + 0.3 * rng.normal(size=16)) for i in range(1_600)]
    rows += [(5_000 + i, rows[7][1]) for i in range(30)]  # a group of copies
    graph = knn.neighbour_graph(knn.valid_vectors(_frame(spark, rows), "vec_id", "vector", 16), 12, 16, leaf=100)
    got = {}
    for r in knn.neighbours(graph, 10, 0.8).collect():
        got.setdefault(r.id, set()).add(r.nbr)
    want = _brute(rows, 10, 0.8)
    total = sum(map(len, want.values()))
    assert sum(len(v & got.get(i, set())) for i, v in want.items()) / total > 0.99
    assert got[5_029] == want[5_029]
    asked = graph.nodes.select("id", "vec").where("id % 100 = 0")
    found = {}
    for r in knn.search(graph, asked, 10).collect():
        found.setdefault(r["query"], set()).add(r.nbr)
    near = {i: v for i, v in want.items() if i in found and v}
    assert sum(len(v & found[i]) for i, v in near.items()) / sum(map(len, near.values())) >= 0.9


def test_invalid_rows_are_left_out(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [2, 0.1]), (3, None), (4, []), (5, [1]), (6, [0, 0]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (None, [1, 1]), (9, [-0.0, 1]), (10, [1, 0])]
    valid = knn.valid_vectors(_frame(spark, rows), "vec_id", "vector", 2)
    assert sorted(r.id for r in valid.collect()) == [1, 2, 9, 10]
    got = {(r.id, r.nbr) for r in knn.neighbours(knn.neighbour_graph(valid, 4, 2), 1, 0.8).collect()}
    assert got == {(1, 10), (10, 1), (2, 1)}


def test_empty(spark):
    valid = knn.valid_vectors(_frame(spark, [(1, None)]), "vec_id", "vector", 2)
    graph = knn.neighbour_graph(valid, 3, 2)
    assert knn.neighbours(graph, 3).count() == 0 and knn.search(graph, valid, 3).count() == 0
