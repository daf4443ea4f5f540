import numpy as np
import pytest

from runlens.operators import minimise, nested
from runlens.sources import capsules


def test_leaves_profiles_and_secrets(spark):
    df = spark.createDataFrame([("a", '{"x": [[1, 2], [3, null]], "password": "p", "t": "Bearer abc", "e": {}, "b": true}'), ("b", "[[1], [2, 3]]"), ("c", "no"), ("d", None), ("e", "[[1,2],[3,4]]")], "id string, v string")
    got = {(r.case_id, r.path): (r.num, r.str, r.leaf_type) for r in nested.leaves(df, "id", "v").collect()}
    assert got[("a", "$['x'][1][0]")] == (3.0, None, "number") and got[("a", "$['e']")][2] == "empty" and ("c", "$") not in got
    assert {(r.case_id, r.elements, r.shape) for r in nested.profile(df, "id", "v").collect()} == {("a", 7, None), ("b", 3, None), ("e", 4, "2,2")}
    assert {(r.path, r.kind) for r in nested.scan_json(df, "id", "v").collect()} == {("$['password']", "secret-key"), ("$['t']", "bearer-token")}


def candidate(x):
    if x["v"] == 3:
        raise RuntimeError("no")
    return {"y": x["v"] * 2 + (0.5 if x["v"] == 2 else 0)}


def reference(x):
    if x["v"] == 4:
        raise ValueError("bad")
    return {"y": x["v"] * 2}


def test_models(spark):
    cases = spark.createDataFrame([(str(i), f'{{"v": {i}}}') for i in range(1, 5)], "case_id string, input string")
    rows, _ = nested.compare_models(cases, reference, candidate)
    assert {r.case_id: r.status for r in rows.collect()} == {"1": "pass", "2": "fail", "3": "error", "4": "inconclusive"}


def test_capsule_digest(spark, tmp_path):
    for name in ("a", "b"):
        capsules.write_capsule(str(tmp_path / f"{name}.zip"), {"run_id": "same"}, {"m": b"1"})
    capsules.register(spark)
    got = nested.capsule_digest(spark.read.format("capsule").load(str(tmp_path))).collect()
    assert len(got) == 2 and got[0].sha256 == got[1].sha256


def test_shrinkers():
    a = np.arange(24.0).reshape(4, 6)
    small = minimise.shrink_tensor(a, lambda x: (x == 9).any(), preserve_shape=False)
    assert small.tolist() == [[9.0]]
    kept = minimise.shrink_tensor(a, lambda x: x.shape == (4, 6) and x[1, 3] > 0)
    assert np.count_nonzero(kept) == 1 and kept[1, 3] == 1
    image = np.zeros((8, 8, 3))
    image[5, 6, 1] = 7
    assert minimise.shrink_image(image, lambda x: (x == 7).any()).shape == (1, 1, 1)
    assert minimise.shrink_text("a b c d e".split(), [(1, 3)], lambda t, s: "e" in t and t[s[0][0] : s[0][1]] == ["b", "c"]) == (["b", "c", "e"], [(0, 2)])
    rows = [{"a": 5, "b": "xy"}, {"a": 900, "b": "q"}]
    assert minimise.shrink_tabular(rows, lambda r: any(x.get("a", 0) > 100 for x in r), drop_columns=True) == [{"a": 450}]
    assert minimise.shrink("a b c", lambda t: "b" in t) == "b" and minimise.shrink([1, 2], lambda x: 2 in x) == [2]
    with pytest.raises(ValueError):
        minimise.shrink_tensor(a, lambda x: False)
