"""Components end with the round that makes them."""

from graphloom.llm import components


def test_stars_need_no_round(spark, monkeypatch):
    rounds = []
    step = components._stars
    monkeypatch.setattr(components, "_stars", lambda edges, large: rounds.append(large) or step(edges, large))
    stars = [(10 * i + j, 10 * i) for i in range(4) for j in range(1, 6)]
    find = lambda e: {(r.node, r.root) for r in components.connected(spark.createDataFrame(e, "a long, b long")).collect()}
    assert find([*stars, (3, 3)]) == {*stars, *((10 * i, 10 * i) for i in range(4))} and not rounds
    assert find([]) == set() and not rounds
    chain = [(i, i + 1) for i in range(9)] + [(20, 22), (21, 22)]
    assert find(chain) == {*((i, 0) for i in range(10)), *((i, 20) for i in (20, 21, 22))} and rounds
