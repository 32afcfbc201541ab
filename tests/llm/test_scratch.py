from types import SimpleNamespace

import pytest
from tidewell.llm.components import connected_components
from tidewell.llm.scratch import Scratch


def test_no_local_folder_on_a_cluster():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        Scratch(cluster)


def test_clear(spark, scratch):
    df = scratch.cut(spark.range(3), "some")
    assert df.count() == 3
    scratch.clear()
    path, files = scratch._files("some")
    assert not files.exists(path)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 300)], [(i, 300) for i in range(300)], [(3, 9), (9, 4), (7, 8), (8, 7), (-5, 8)]])
def test_components(spark, scratch, edges):
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch)
    assert {r.node: r.root for r in got.collect()} == {n: r for n, r in root.items() if n != r}
