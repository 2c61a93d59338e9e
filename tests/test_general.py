"""Edge cases of the orphan and hierarchy operators."""

import datetime as dt
import random

from parchline.operators.hierarchy import Hierarchy
from parchline.operators.orphans import Child, Parent, orphan_references, orphan_report

T0 = dt.datetime(2024, 3, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


P = "id string, arrived_at timestamp_ntz, deleted_at timestamp_ntz, extra int"
C = "id string, ref string, arrived_at timestamp_ntz, extra string"


def orphans(spark, parents, children):
    p = spark.createDataFrame(parents, P)
    c = spark.createDataFrame(children, C)
    return orphan_references(spark, [Parent("p", p)], [Child("c", c, "p", ("ref",))])


def test_orphan_reasons(spark):
    parents = [("a", day(0), None, 1), ("b", day(5), None, 1), ("b", day(3), None, 2), ("c", day(0), day(4), 1), ("d", None, None, 1)]
    children = [
        ("1", " A ", day(1), "x"), ("2", "b", day(2), "x"), ("3", "b", day(3), "x"), ("4", "c", day(3), "x"), ("5", "c", day(4), "x"), ("6", "zz", day(1), "x"), ("7", None, day(1), "x"),
        ("8", "  ", day(1), "x"), ("9", "zz", None, "x"), ("10", "b", day(9), "x"), ("10", "b", day(1), "again"), ("11", "d", day(1), "x"), ("6", "zz", day(1), "x"),
    ]
    got = {tuple(r) for r in orphans(spark, parents, children).collect()}
    m = "2024-03"
    assert got == {("c", "2", m, "late"), ("c", "5", m, "deleted"), ("c", "6", m, "missing"), ("c", "9", None, "missing"), ("c", "10", m, "late")}
    assert {tuple(r) for r in orphan_report(orphans(spark, parents, children)).collect()} == {("c", m, "late", 2), ("c", m, "deleted", 1), ("c", m, "missing", 1), ("c", None, "missing", 1)}


def test_orphan_hot_key_and_empty(spark):
    children = [(str(i), "gone" if i % 3 else f"k{i}", day(1), "x") for i in range(900)]
    got = orphans(spark, [("k0", day(0), None, 1)], children)
    assert got.count() == 899
    assert orphans(spark, [], children).count() == 900
    assert orphans(spark, [("a", day(0), None, 1)], []).count() == 0


def forest(spark, rows, **k):
    return Hierarchy(spark, spark.createDataFrame(rows, "tree string, id string, parent string, node_id string"), **k)


def brute(rows):
    parent = {}
    for tree, i, p, _ in rows:
        if i is not None:
            p = (p or "").strip().lower() or None
            old = parent.get((tree, i))
            parent[tree, i] = min(x for x in (p, old) if x is not None) if (p is not None or old is not None) else None
    out = {}
    for (tree, i), _ in parent.items():
        seen, at = [i], i
        while True:
            p = parent[tree, at]
            if p is None or (tree, p) not in parent:
                out[tree, i] = (at, len(seen) - 1, "/".join(reversed(seen)))
                break
            if p in seen:
                out[tree, i] = ("", -1, None)
                break
            seen.append(p)
            at = p
    return out


def check(spark, rows):
    h = forest(spark, rows)
    want = brute(rows)
    got = {(r["tree"], r["node_id"]): (r["root_id"], r["depth"]) for r in h.nodes().collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    paths = {(r["tree"], r["node_id"]): (r["path"], r["n_descendants"]) for r in h.paths().collect()}
    assert {k: v[0] for k, v in paths.items()} == {k: v[2] for k, v in want.items()}
    for k, v in want.items():
        if v[2]:
            assert paths[k][1] == sum(1 for (t, _), w in want.items() if t == k[0] and w[2] and f"/{k[1]}/" in f"/{w[2]}/") - 1
    asked = list(want)[:7]
    of = spark.createDataFrame(asked, "tree string, node_id string")
    below = {(r[0], r[1], r[2]) for r in h.descendants(of).collect()}
    assert below == {(t, n, j) for t, n in asked for (u, j), w in want.items() if t == u and w[2] and j != n and f"/{n}/" in f"/{w[2]}/" and want[t, n][2]}


def test_hierarchy_cases(spark):
    rows = [
        ("x", "a", None, "1"), ("x", "b", " A ", "1"), ("x", "c", "b", "1"), ("x", "c", "b", "1"), ("x", "d", "nowhere", "1"), ("x", "e", "e", "1"), ("x", "f", "g", "1"), ("x", "g", "f", "1"),
        ("x", "h", "f", "1"), ("x", "i", "", "1"), ("y", "a", "b", "1"), ("y", "b", None, "1"), ("x", None, "a", "1"), ("x", "j", "c", "1"), ("x", "k", "c", "1"),
    ]
    check(spark, rows)


def test_hierarchy_random(spark):
    rng = random.Random(5)
    for n, back in ((60, 1), (150, 3)):
        rows = [("t", f"n{i}", f"n{max(0, i - rng.randint(1, back))}" if i and rng.random() > 0.05 else None, "z") for i in range(n)]
        rows += [("t", f"w{i}", "n0", "z") for i in range(40)]
        rows += [("t", f"l{i}", f"l{(i + 1) % 5}", "z") for i in range(5)] + [("t", "into", "l0", "z")]
        check(spark, rows)


def test_hierarchy_empty_and_plain(spark):
    assert forest(spark, []).nodes().count() == 0
    assert [tuple(r) for r in forest(spark, [("t", "a", None, "q")], keep_segments=False).nodes().collect()] == [("t", "a", "a", 0)]


def test_descendants_of_whole_tables(spark, data):
    import __spark_entry__ as entry
    from oracle import connect
    from parchline.queries_data import _P3

    rows = entry.queries()["p3_descendants"](spark, data).collect()
    below = {}
    for r in rows:
        below.setdefault((r["tree"], r["chain_head"]), []).append((r["upto"], r["node_id"]))
    mine = sorted((r["tree"], r["node_id"], w) for r in rows if r["own"] for upto, w in below[r["tree"], r["chain_head"]] if upto >= r["upto"] + 1)
    up = _P3 + ", pairs AS (SELECT tree, id AS d, parent AS a FROM linked WHERE parent IS NOT NULL AND (tree, id) IN (SELECT (tree, id) FROM walk) UNION ALL SELECT p.tree, p.d, l.parent FROM pairs p JOIN linked l ON l.tree = p.tree AND l.id = p.a WHERE l.parent IS NOT NULL)"
    theirs = sorted(connect(data).execute(up + " SELECT tree, a, d FROM pairs").fetchall())
    assert mine == theirs and mine
    assert len([r for r in rows if r["own"]]) == connect(data).execute(_P3 + " SELECT count(*) FROM walk").fetchone()[0]


def test_hot_keys_change_nothing(spark, monkeypatch):
    from parchline.functions import partitions

    monkeypatch.setattr(partitions, "HOT_LEAST", 1)
    rng = random.Random(8)
    rows = [("t", "root", None, "z")] + [("t", f"n{i}", "root" if i % 2 else f"n{rng.randrange(max(i, 1))}", "z") for i in range(80)]
    check(spark, rows)


def test_lookup_of_hot_keys(spark):
    from parchline.functions.partitions import lookup

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i) for i in range(90)] + [(900, None, 1), (901, "none", 1)], "i int, k string, x int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), (None, 4)], "k string, v int")
    hot = spark.createDataFrame([("hot",)], "k string")
    for how in ("inner", "left"):
        assert sorted(map(str, lookup(left, right, ["k"], hot, how).collect())) == sorted(map(str, left.join(right, "k", how).select("k", "i", "x", "v").collect()))


def test_paths_over_many_blocks(spark, monkeypatch):
    from parchline.operators import hierarchy

    monkeypatch.setattr(hierarchy, "BLOCK", 4)
    rows = [("t", f"n{i:03d}", f"n{i - 1:03d}" if i else None, "z") for i in range(40)] + [("t", f"m{i}", "n017", "z") for i in range(3)] + [("t", "x", "m1", "z")]
    check(spark, rows)
