from tidemark.operators import graph


def test_edges_of_a_task_do_not_grow_with_the_input(spark, monkeypatch):
    """Tasks are as many as the edges ask for, and Spark doesn't join them again."""
    monkeypatch.setattr(graph, "EDGES_TOGETHER", 10)
    edges = spark.createDataFrame([(f"p{i % 40}", f"s{i % 7}", "r") for i in range(300)], "src string, dst string, relation string")
    nodes = spark.createDataFrame([(f"p{i}", "claim") for i in range(39)] + [(f"s{i}", "observation") for i in range(7)], "node string, kind string")
    found = graph.edge_violations(edges, nodes)
    assert found.rdd.getNumPartitions() == 30
    got = {(r.src, r.dst): r.violations for r in found.collect()}
    assert len(got) == 280 and got["p0", "s0"] == ["repeated", "claim to observation"] and "dangling" in got["p39", "s4"]
