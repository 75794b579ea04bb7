"""Communities by modularity, against the best of all partitions."""

import pytest

from corvane.operators import leiden as L

SCHEMA = "subject string, object string, weight double"


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Small graphs: a job's tasks cost more than its rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def partitions(items):
    """All partitions of a list."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]
        yield [[items[0]], *rest]


def plain_modularity(edges, groups, resolution=1.0):
    heaviest = {}
    for a, b, w in edges:
        if a != b:
            heaviest[frozenset((a, b))] = max(w, heaviest.get(frozenset((a, b)), 0.0))
    m = sum(heaviest.values())
    out = 0.0
    for group in groups:
        group = set(group)
        inside = sum(w for pair, w in heaviest.items() if pair <= group)
        total = sum(w * len(pair & group) for pair, w in heaviest.items())
        out += inside / m - resolution * (total / (2 * m)) ** 2
    return out


def groups_of(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.community, []).append(r.node)
    assert all(name == min(members) for name, members in out.items())
    return list(out.values())


def test_small_graph_reaches_the_best_of_all_partitions(spark):
    edges = [("a", "b", 2.0), ("b", "a", 3.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "d", 0.5), ("d", "e", 2.0), ("e", "f", 2.0), ("d", "f", 1.0), ("g", "h", 1.0), ("h", "h", 9.0)]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    df = spark.createDataFrame(edges, SCHEMA)
    found = L.leiden(df)
    got = groups_of(found)
    best = max(plain_modularity(edges, p) for p in partitions(nodes))
    assert sorted(x for g in got for x in g) == nodes
    assert plain_modularity(edges, got) == pytest.approx(best, abs=1e-9)
    assert L.modularity(df, found) == pytest.approx(best, abs=1e-9)


def test_no_round_broadcasts_a_table(spark, monkeypatch):
    """What is broadcast passes through the driver, in every round anew."""
    from corvane.operators import components

    plans = []

    def noted(df, label="step", write=L.checkpointed):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(L, "checkpointed", noted)
    monkeypatch.setattr(components, "checkpointed", noted)
    found = L.leiden(spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 0.1), ("d", "e", 1.0)], SCHEMA))
    assert sorted(map(sorted, groups_of(found))) == [["a", "b", "c"], ["d", "e"]]
    assert plans and not any("Broadcast" in p for p in plans)
