"""Parent links of any depth, and parent cycles of any length, against plain Python."""

from docloom.operators import checks, graph

LINKS = "page long, node long, parent long"
NODES = "page long, node long, kind string, parent long, state string, x int, y int, w int, h int, z int"


def chain(page, n):
    return [(page, i, i - 1 if i else None) for i in range(n)]


def ring(page, n, tail=0):
    """Nodes 0 to n - 1 in a cycle, and a chain of `tail` nodes that hangs from node 0."""
    return [(page, i, (i - 1) % n) for i in range(n)] + [(page, n + i, n + i - 1 if i else 0) for i in range(tail)]


def test_ancestors_have_no_depth_limit(spark):
    got = graph.ancestors(spark.createDataFrame(chain(1, 450) + chain(2, 3), LINKS)).collect()
    want = {(p, i, j, i - j) for p, n in ((1, 450), (2, 3)) for i in range(n) for j in range(i)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ancestors_end_at_the_first_repeated_node(spark):
    got = {tuple(r) for r in graph.ancestors(spark.createDataFrame(ring(1, 3, 1), LINKS)).collect()}
    cycle = {(1, i, (i - d) % 3, d) for i in range(3) for d in (1, 2, 3)}
    assert got == cycle | {(1, 3, 0, 1), (1, 3, 2, 2), (1, 3, 1, 3)}


def test_cycles_of_any_length_are_found(spark):
    links = ring(1, 1) + ring(2, 2) + ring(3, 32) + ring(4, 33, 5) + ring(5, 400, 300) + chain(6, 500)
    links += ring(7, 40) + [(7, 100 + n, 100 + p) for _, n, p in ring(7, 50)] + [(8, 1, 99)]
    nodes = spark.createDataFrame([(p, n, "text", up, "inactive", 0, 0, 5, 5, n) for p, n, up in links], NODES)
    got = [(r.page, r.node) for r in checks.graph_violations(nodes).filter("rule = 'acyclic'").collect()]
    want = [(p, i) for p, n in ((1, 1), (2, 2), (3, 32), (4, 33), (5, 400), (7, 40)) for i in range(n)] + [(7, 100 + i) for i in range(50)]
    assert sorted(got) == sorted(want)


def test_related_inactive_of_distant_targets(spark):
    pairs = spark.createDataFrame([(1, 0, 299), (1, 299, 0), (1, 100, 299)], "page long, target long, source long")
    got = {(r.target, r.source) for r in graph.related_inactive(pairs, spark.createDataFrame(chain(1, 300), LINKS)).collect()}
    assert got == {(0, 299), (100, 299)}
