"""The pickers run as many restarts as the reference."""

from tessera.operators import embed


def test_hill_climb_restarts(spark):
    c = spark.createDataFrame([(1, 1, 10, [1.0, 0.0]), (1, 2, 20, [1.0, 0.1])], "doc_id long, sf long, entity long, vec array<double>")
    assert {(r["entity"], r["score"]) for r in embed.hill_climb(c).collect()} == {(10, 500.0), (20, 500.0)}
