import random

import pytest

from leakloom.llm.components import connected_components


def plain(links):
    label = {x: x for p in links for x in p}
    while True:
        new = {x: min([label[x], *(label[b if a == x else a] for a, b in links if x in (a, b))]) for x in label}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(k, 100 - k) for k in range(40)]])
def test_shapes(spark, links):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long"), "a", "b").collect()}
    assert got == {k: v for k, v in plain([x for x in links if x[0] != x[1]]).items()}


def test_random(spark):
    g = random.Random(5)
    links = [(g.randrange(150), g.randrange(150)) for _ in range(110)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == plain([x for x in links if x[0] != x[1]])
