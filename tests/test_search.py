"""Searches by weight, from both ends and from many sources, against Dijkstra and plain loops."""

import heapq
import random

import pytest

from litgraph.operators import paths


def dijkstra(links, source):
    best, heap = {source: 0}, [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        for m, w in links.get(n, ()) if d == best[n] else ():
            if d + w < best.get(m, 1 << 60):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return best


def random_graph(seed, nodes=60, edges=150, weights=(1, 2, 3), directed=False):
    rng = random.Random(seed)
    weight = {}
    while len(weight) < edges * (1 if directed else 2):
        a, b = (f"{rng.choice('es')}:{rng.randrange(nodes // 2)}" for _ in range(2))
        if a != b and (a, b) not in weight:
            weight[a, b] = rng.choice(weights)
            if not directed:
                weight[b, a] = weight[a, b]
    return weight


def both_ways(weight):
    links, back = {}, {}
    for (a, b), w in weight.items():
        links.setdefault(a, []).append((b, w))
        back.setdefault(b, []).append((a, w))
    return links, back


def frame(spark, weight):
    return spark.createDataFrame([(a, b, float(w)) for (a, b), w in weight.items()], "src string, dst string, weight double").repartition(3).cache()


def all_shortest(weight, source, target):
    links, back = both_ways(weight)
    here, there = dijkstra(links, source), dijkstra(back, target)
    if target not in here:
        return None
    least = here[target]
    tight = {(a, b, here[a]) for (a, b), w in weight.items() if a in here and b in there and here[a] + w + there[b] == least}

    def first(n):
        return [n] if n == target else [n, *min(first(b) for a, b, _ in tight if a == n)]

    return least, tight, first(source)


@pytest.mark.parametrize("seed, directed, weights", [(1, False, (1, 2)), (2, True, (0.25, 0.5, 2.75))])
def test_all_shortest_paths_of_random_graphs(spark, seed, directed, weights):
    """From the pair with the most shortest paths, so that ties count."""
    weight = random_graph(seed, 40, 90, weights, directed)
    df, nodes = frame(spark, weight), sorted({n for e in weight for n in e})
    rng = random.Random(seed)
    asked = [rng.sample(nodes, 2) for _ in range(30)]
    a, b = max(asked, key=lambda p: len((all_shortest(weight, *p) or (0, ()))[1]))
    got, want = paths.shortest_paths(df, a, b), all_shortest(weight, a, b)
    assert (got.distance, {tuple(r) for r in got.edges.collect()}, got.path) == want and got.edges.count() == len(want[1]) > len(got.path)


def test_both_ends_expand_less_than_one(spark):
    side = 10
    weight = {}
    for i in range(side):
        for j in range(side):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < side and b < side:
                    weight[f"n:{i}:{j}", f"n:{a}:{b}"] = weight[f"n:{a}:{b}", f"n:{i}:{j}"] = 1 + (i * 7 + j * 5 + a) % 3
    df = frame(spark, weight)
    source, target = "n:3:3", "n:6:5"
    got = paths.shortest_paths(df, source, target)
    best = dijkstra(both_ways(weight)[0], source)
    assert got.distance == best[target] and got.expanded < sum(d < best[target] for d in best.values())


def test_ends_that_are_one_missing_or_apart(spark):
    df = frame(spark, {("a", "b"): 1.5, ("b", "a"): 1.5, ("c", "d"): 1})
    one = paths.shortest_paths(df, "a", "a")
    assert (one.distance, one.path, one.edges.count()) == (0.0, ["a"], 0)
    assert paths.shortest_paths(df, "a", "c") is None and paths.shortest_paths(df, "a", "nowhere") is None and paths.shortest_paths(df, "d", "c") is None
    assert paths.weighted_path(df, "a", "b") == (1.5, ["a", "b"])
    with pytest.raises(ValueError):
        paths.shortest_paths(frame(spark, {("a", "b"): 0, ("b", "c"): 1}), "a", "c")


@pytest.mark.parametrize("enough, within, kind", [(0, None, None), (4, None, "s"), (5, 3, "e")])
def test_many_sources_at_once(spark, enough, within, kind):
    weight = random_graph(9)
    df, nodes = frame(spark, weight), sorted({n for e in weight for n in e})
    sources = nodes[::11] + ["s:nowhere"]
    asked = spark.createDataFrame([(s,) for s in sources + sources[:1]], "source string")
    links = both_ways(weight)[0]
    found = {(r.source, r.node): r.d for r in paths.distances_from(df, asked, kind, enough, within).collect()}
    for s in sources:
        best = dijkstra(links, s)
        of_kind = sorted((d, n) for n, d in best.items() if n != s and (kind is None or n[0] == kind))
        far = min([of_kind[enough - 1][0]] if enough and len(of_kind) >= enough else [1e9], default=1e9)
        far = far if within is None else min(far, within)
        assert {n: d for (t, n), d in found.items() if t == s and d <= far} == {n: d for n, d in best.items() if d <= far}
        assert all(d >= best[n] for (t, n), d in found.items() if t == s)
    near = paths.nearest_of_each(df, asked, kind, 4, within)
    for s in sources:
        want = sorted((d, n) for n, d in dijkstra(links, s).items() if n != s and (kind is None or n[0] == kind) and (within is None or d <= within))[:4]
        assert sorted((r.d, r.node) for r in near.filter(near.source == s).collect()) == want


def test_a_paths_length_adds_no_copy_of_the_graph(spark, monkeypatch):
    weight = random_graph(5, weights=(1,))
    df, nodes = frame(spark, weight), sorted({n for e in weight for n in e})
    kept, real = [], paths.scratch
    monkeypatch.setattr(paths, "scratch", lambda t: kept.append(t.columns) or real(t))
    want = set()
    for path in (nodes[:1], nodes[:9]):
        kept.clear()
        got = {r.node for r in paths.near_path(df, path, "s", 5).collect()}
        assert sum("dst" in c for c in kept) == 1
        for p in path:
            best = dijkstra(both_ways(weight)[0], p)
            want |= {n for _, n in sorted((d, n) for n, d in best.items() if n[0] == "s" and n != p)[:5]}
        assert got == want


def test_search_leaves_no_tables_but_its_result(spark, monkeypatch):
    made, gone, real, away = [], [], paths.scratch, paths.drop

    def keep(t):
        out = real(t)
        made.append(out.path_)
        return out

    monkeypatch.setattr(paths, "scratch", keep)
    monkeypatch.setattr(paths, "drop", lambda *t: gone.extend(x.path_ for x in t) or away(*t))
    df = frame(spark, random_graph(6))
    found = paths.distances_from(df, df.select(df.src.alias("source")).limit(2))
    assert found.count() > 2 and len(set(made) - set(gone)) == 1
