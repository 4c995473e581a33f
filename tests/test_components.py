"""Components of long chains whose smallest node is at the far end."""

from sondage.operators import entity


def test_long_chain(spark):
    n = 300
    links = [(k, k + 1) for k in range(2, n)] + [(n, 1)]
    got = {r["node"]: r["root"] for r in entity.components(spark.createDataFrame([*links, (1000, 1000)], "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, n + 1)} | {1000: 1000}
