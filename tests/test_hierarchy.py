import random
from datetime import datetime

import pytest

from quirelight.operators import hierarchy as H
from quirelight.operators import zones as Z


def brute(nodes):
    up, out = dict(nodes), {}
    for k in up:
        seen = [k]
        while True:
            p = up[seen[-1]]
            if p is None or p not in up:
                out[k] = (seen[-1], len(seen) - 1)
                break
            if p in seen:
                out[k] = (min(seen[seen.index(p) :]), -1)
                break
            seen.append(p)
    return out


@pytest.mark.parametrize("kw", [{}, {"locality": "g", "task_rows": 5, "parts": 16, "fanin": 4}, {"locality": "g", "task_rows": 0, "parts": 3}, {"locality": "one", "node_rows": 20, "task_rows": 9}])
def test_against_brute_force(spark, kw):
    r, n = random.Random(4), 300
    nodes = [(f"n{i:03d}", None if r.random() < 0.05 else f"n{r.randrange(max(1, i - 20), i + 2) if r.random() < 0.97 else r.randrange(n + 9):03d}") for i in range(n)]
    want, up = brute(nodes), dict(nodes)
    df = spark.createDataFrame([(a, b, i // 30) for i, (a, b) in enumerate(nodes)], "id string, parent string, g int").selectExpr("*", "1 AS one")
    rows = H.hierarchy(df, with_path=True, **kw).collect()
    assert {x.id: (x.root, x.depth) for x in rows} == want
    for x in rows:
        if x.path is None:
            assert want[x.id][1] == -1
        else:
            assert x.path[0] == x.root and x.path[-1] == x.id and all(up[b] == a for a, b in zip(x.path, x.path[1:]))


def test_long_chain_over_partitions(spark):
    n = 2000
    df = spark.createDataFrame([(f"c{i:05d}", f"c{i - 1:05d}" if i else None, i) for i in range(n)], "id string, parent string, g int")
    rows = H.hierarchy(df, "g", task_rows=100, parts=8).collect()
    assert all(x.depth == int(x.id[1:]) and x.root == "c00000" for x in rows)


def test_zone_cases(make):
    late = datetime(2024, 2, 1)
    rows = [
        {"zone_id": "a", "parent_id": None, "level": 0, "saved_at": late},
        {"zone_id": "b", "parent_id": " A ", "level": 1, "saved_at": late},
        {"zone_id": "b", "parent_id": "zz", "level": 9, "saved_at": datetime(2024, 1, 1)},  # stale
        {"zone_id": "b", "parent_id": " A ", "level": 1, "saved_at": late},  # twice
        {"zone_id": "c", "parent_id": "b", "level": None, "saved_at": late},
        {"zone_id": "d", "parent_id": "gone", "level": 0, "saved_at": None},
        {"zone_id": "e", "parent_id": "", "level": 3, "saved_at": late},
        {"zone_id": "f", "parent_id": "g", "level": 1, "saved_at": late},
        {"zone_id": "g", "parent_id": "f", "level": 1, "saved_at": late},
        {"zone_id": "h", "parent_id": "g", "level": 1, "saved_at": late},
        {"zone_id": "i", "parent_id": "I", "level": 1, "saved_at": late},
        {"zone_id": None, "parent_id": "a", "level": 1, "saved_at": late},
    ]
    z = make("zones", rows).selectExpr("*", "1 AS id", "2 AS root", "'x' AS w")
    assert {tuple(r) for r in H.level_errors(z).collect()} == {("c", "a", 2), ("e", "e", 0), ("f", "f", -1), ("g", "f", -1), ("h", "f", -1), ("i", "i", -1)}
    assert {(r.zone_id, tuple(r.path)) for r in H.zone_paths(z).where("path is not null").collect()} >= {("c", ("a", "b", "c")), ("d", ("d",))}
    assert {tuple(r) for r in H.zone_descendants(z).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert H.level_errors(make("zones")).count() == 0
    left = {r.zone_id for r in Z.delete_cascade(z, z.where("zone_id = 'b'").select("zone_id")).collect()}
    assert not left & {"b", "c"} and "a" in left
    moves = z.sparkSession.createDataFrame([("a", "c"), ("e", "a")], "zone_id string, new_parent string")
    assert {(r.zone_id, r.accepted) for r in Z.set_parent(z, moves).collect()} == {("a", False), ("e", True)}


def test_clear(spark):
    from quirelight import runtime

    df = runtime.staged(spark.range(5))
    assert df.count() == 5
    runtime.clear(spark)
    assert runtime.staged(spark.range(3)).count() == 3


def test_paths_by_joins(spark):
    """Deep trees beside circles, all solved by joins: paths are whole, circles carry none."""
    from quirelight.operators.hierarchy import _by_joins

    links = [(f"a{i:04}", f"a{i - 1:04}" if i else None, 1, f"a{i - 1:04}" if i else None, [f"a{i:04}"] if i else []) for i in range(300)]
    links += [(f"r{i}", f"r{(i + 1) % 5}", 1, f"r{(i + 1) % 5}", [f"r{i}"]) for i in range(5)] + [("t", "r3", 1, "r3", ["t"]), ("u", "t", 1, "t", ["u"])]
    got = {r.id: r for r in _by_joins(spark.createDataFrame(links, "id string, parent string, w bigint, low string, seg array<string>")).collect()}
    assert len(got) == len(links)
    assert all(got[f"a{i:04}"].steps == i and got[f"a{i:04}"].exit == "a0000" and got[f"a{i:04}"].path == [f"a{k:04}" for k in range(1, i + 1)] and got[f"a{i:04}"].ring is None for i in range(300))
    assert all(got[x].ring == "r0" and got[x].steps == -1 and got[x].path == [] for x in ("r0", "r1", "r4", "t", "u"))
