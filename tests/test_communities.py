"""Communities: planted partitions, connectivity, and sequential local moves as the bar."""

import random

import pytest

from spotlattice.operators import cluster, graph


def modularity(edges, label, gamma):
    m = sum(w for _, _, w in edges)
    k = {}
    for a, b, w in edges:
        k[a] = k.get(a, 0) + w
        k[b] = k.get(b, 0) + w
    s = {}
    for v, x in k.items():
        s[label[v]] = s.get(label[v], 0) + x
    return sum(w for a, b, w in edges if label[a] == label[b]) - gamma * sum(x * x for x in s.values()) / (4 * m)


def local_moves(edges, gamma):
    """Plain moves one node at a time, then the same on the aggregated graph, until nothing moves."""
    names = sorted({v for a, b, _ in edges for v in (a, b)})
    where, graph = {v: v for v in names}, {}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = graph.setdefault(b, {})[a] = w
    loops, m = dict.fromkeys(names, 0.0), sum(w for _, _, w in edges)
    while True:
        k = {v: sum(graph.get(v, {}).values()) + 2 * loops[v] for v in loops}
        c, s, any_moved, moved = {v: v for v in loops}, dict(k), False, True
        while moved:
            moved = False
            for v in sorted(loops):
                s[c[v]] -= k[v]
                to = {c[v]: 0.0}
                for u, w in graph.get(v, {}).items():
                    to[c[u]] = to.get(c[u], 0.0) + w
                gain = lambda x: to[x] - gamma * k[v] * s[x] / (2 * m)  # noqa: B023, E731
                best = max(sorted(to), key=gain)
                if gain(best) > gain(c[v]) + 1e-12:
                    c[v], moved, any_moved = best, True, True
                s[c[v]] += k[v]
        if not any_moved:
            return where
        where = {v: c[x] for v, x in where.items()}
        new, more = {}, dict.fromkeys(set(c.values()), 0.0)
        for v in loops:
            more[c[v]] += loops[v]
        for a, near in graph.items():
            for b, w in near.items():
                if c[a] != c[b]:
                    new.setdefault(c[a], {})[c[b]] = new.get(c[a], {}).get(c[b], 0.0) + w
                elif a < b:
                    more[c[a]] += w
        graph, loops = new, more


def planted(groups, size, inner, outer, seed):
    r, n = random.Random(seed), groups * size
    edges = []
    for a in range(n):
        for b in range(a + 1, n):
            if r.random() < (inner if a // size == b // size else outer):
                edges.append((a, b, 1.0))
    return edges


# two cliques whose only tie is a bridge node that belongs elsewhere: plain moves can leave them one community
BRIDGE = [(a, b, 1.0) for o in (0, 5) for a in range(o, o + 5) for b in range(a + 1, o + 5)] + [(0, 10, 1.2), (5, 10, 1.2)] + [(10, x, 2.0) for x in (11, 12, 13)] + [(11, 12, 2.0), (12, 13, 2.0), (11, 13, 2.0)]
FIXTURES = {"a": planted(4, 16, 0.5, 0.03, 1), "b": planted(6, 10, 0.7, 0.05, 2), "c": BRIDGE}


def pieces(edges, label):
    """Connected pieces of the edges inside communities."""
    root = {v: v for v in label}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b, _ in edges:
        if label[a] == label[b]:
            root[find(a)] = find(b)
    return len({find(v) for v in label})


@pytest.fixture(scope="module")
def found(spark):
    rows = [(s, a, b, w) for s, edges in FIXTURES.items() for a, b, w in edges] + [("line", i, i + 1, 1.0) for i in range(30)]
    e = spark.createDataFrame(rows, "sample_id string, src long, dst long, w double")
    out = {}
    for r in cluster.community_fit(e, [1.0]).collect():
        out.setdefault(r.sample_id, {})[r.spot] = r.label
    return out


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_at_least_plain_local_moves(found, name):
    edges, label = FIXTURES[name], found[name]
    assert set(label) == {v for a, b, _ in edges for v in (a, b)}
    assert set(label.values()) == set(range(len(set(label.values()))))
    assert modularity(edges, label, 1.0) >= modularity(edges, local_moves(edges, 1.0), 1.0) - 1e-9


def test_planted_partitions_are_found(found):
    for name, size in (("a", 16), ("b", 10)):
        groups = {}
        for v, x in found[name].items():
            groups.setdefault(x, set()).add(v // size)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({v // size for v in found[name]})


def test_communities_are_connected(found):
    for name, edges in [*FIXTURES.items(), ("line", [(i, i + 1, 1.0) for i in range(30)])]:
        assert pieces(edges, found[name]) == len(set(found[name].values()))


def test_components_follow_long_chains(spark):
    chain = [("s", 1.0, i, i + 1) for i in range(64)] + [("s", 1.0, 100, 101)]
    inside = spark.createDataFrame([(s, g, x, y) for s, g, a, b in chain for x, y in ((a, b), (b, a))], "sample_id string, gamma double, node long, other long")
    nodes = inside.select("sample_id", "gamma", "node").distinct()
    got = {r.node: r.part for r in graph.components(inside, nodes, ["sample_id", "gamma"]).collect()}
    assert got == {**dict.fromkeys(range(65), 0), 100: 100, 101: 100}


def test_small_groups_take_the_same_steps_in_one_task(spark, monkeypatch):
    e = spark.createDataFrame([("c", a, b, w) for a, b, w in FIXTURES["c"]], "sample_id string, src long, dst long, w double")
    rounds, move = [], cluster._move_round
    monkeypatch.setattr(cluster, "_move_round", lambda *args: rounds.append(1) or move(*args))
    label = lambda: {r.spot: r.label for r in cluster.community_fit(e, [1.0]).collect()}
    one_task = label()
    assert not rounds
    # larger ones go round by round over the tables
    monkeypatch.setattr(cluster, "_SMALL", 0)
    assert label() == one_task and rounds


def test_pieces_shrink_the_graph_instead_of_spreading_names(spark, monkeypatch):
    # a shuffled grid of 30 x 30 without one of its columns, and a chain in order
    name = random.Random(4).sample(range(900), 900)
    grid = [(i, j) for i in range(900) for j in ([i + 30] if i < 870 else []) + ([i + 1] if i % 30 not in (14, 29) else [])]
    pairs = [("g", name[a], name[b]) for a, b in grid] + [("h", i, i + 1) for i in range(40)]
    inside = spark.createDataFrame([(s, x, y) for s, a, b in pairs for x, y in ((a, b), (b, a))], "sample_id string, node long, other long")
    nodes = inside.select("sample_id", "node").distinct()
    want = {("g", name[i]): min(name[j] for j in range(900) if (j % 30 < 15) == (i % 30 < 15)) for i in range(900)} | {("h", i): 0 for i in range(41)}
    tables, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(1) or cut(df))
    part = lambda: {(r.sample_id, r.node): r.part for r in graph.components(inside, nodes, ["sample_id"]).collect()}
    assert part() == want and len(tables) <= 8
    monkeypatch.setattr(graph, "_SMALL", 0)
    assert part() == want
