import random
from collections import deque

from conftest import rows

from lodestream.operators import hierarchy
from lodestream.operators.hierarchy import depths, hierarchies, hierarchy_rows, kind_links, large_depths


def brute(links):
    """(node, root, depth) by walking up from every node."""
    up, nodes = {}, set()
    for c, p in links:
        up.setdefault(c, set()).add(p)
        nodes |= {c, p}

    def above(n):
        seen, todo = {}, deque([(n, 0)])
        while todo:
            x, d = todo.popleft()
            for y in up.get(x, ()):
                if y not in seen:
                    seen[y] = d + 1
                    todo.append((y, d + 1))
        return seen

    far = {n: above(n) for n in nodes}
    on = {n for n in nodes if n in far[n]}
    out = []
    for n in nodes:
        if n in on or on & set(far[n]):
            out.append((n, "", -1))
        else:
            out += [(n, r, d) for r, d in {**far[n], n: 0}.items() if r not in up]
    return sorted(out)


def graph(seed, n=12, m=16):
    r = random.Random(seed)
    return {(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)}


def test_peeling_against_brute_force():
    for seed in range(200):
        links = graph(seed)
        assert sorted(r[:3] for r in hierarchy_rows(links)) == brute(links), seed


def test_paths_and_descendants():
    got = {(r[0], r[1]): r for r in hierarchy_rows([("c", "b"), ("b", "a"), ("d", "a"), ("c", "x"), ("u", "v"), ("v", "u"), ("w", "u"), ("u", "t")])}
    assert got[("c", "a")][2:] == (2, ["a", "b", "c"], 0, []) and got[("c", "x")][2] == 1
    assert got[("a", "a")][2:] == (0, ["a"], 3, ["b", "c", "d"]) and got[("w", "")][2] == -1 and got[("u", "")][2] == -1
    assert got[("t", "t")][2:] == (0, ["t"], 3, ["u", "v", "w"])


def test_rounds_equal_local(spark):
    links = [(g, a, b) for g in "pq" for a, b in graph(ord(g), 14, 16)] + [("r", f"c{k}", f"c{k + 1}") for k in range(6)]
    df = spark.createDataFrame(links, "grp string, child string, parent string")
    want = sorted((g, *x) for g in "pqr" for x in brute([(a, b) for h, a, b in links if h == g]))
    assert rows(depths(df)) == sorted(want, key=repr)
    assert rows(depths(df, local_edges=5)) == sorted(want, key=repr)
    assert rows(large_depths(df, local_edges=0)) == sorted(want, key=repr)
    assert depths(df.limit(0)).count() == 0 and hierarchies(df.limit(0)).count() == 0


def test_spellings_directions_and_names(spark):
    e = spark.createDataFrame(
        [("p", "A  b\t", "isA", "Top", "x"), ("p", "top", "parent_of", "C", "x"), ("p", "a b", "IS-A", "TOP", "x"), ("p", "", "isA", "q", "x"), ("p", None, "isA", "q", "x"), (None, "a", "isA", "b", "x"), ("p", "self", "rdfs:subClassOf", "self", "x"), ("p", "m", "USES_METHOD", "n", "x")],
        "paper_id string, source string, relation string, target string, node string",
    )
    assert rows(kind_links(e)) == sorted([("p", "a b", "top"), ("p", "c", "top"), ("p", "self", "self")])
    assert rows(depths(kind_links(e))) == sorted([("p", "a b", "top", 1), ("p", "c", "top", 1), ("p", "top", "top", 0), ("p", "self", "", -1)])
    assert hierarchy.peel([])[0] == []


def test_large_hierarchies_equal_local(spark):
    links = [(g, a, b) for g in "pq" for a, b in graph(ord(g), 14, 15)] + [("r", f"c{k}", f"c{k + 1}") for k in range(6)] + [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "d", "c"), ("s", "e", "e")]
    df = spark.createDataFrame(links, "grp string, child string, parent string")
    assert rows(hierarchies(df, local_edges=3)) == rows(hierarchies(df))
    assert rows(large_depths(df, local_edges=0)) == rows(depths(df))


def test_long_chains_and_large_groups(spark):
    deep, wide = 200_000, 300_000
    chain = spark.range(deep).selectExpr("'deep' AS grp", "concat('n', id) AS child", "concat('n', id + 1) AS parent")
    tree = spark.range(1, wide + 1).selectExpr("'wide' AS grp", "concat('m', id) AS child", "concat('m', id div 3) AS parent")
    ring = spark.createDataFrame([("wide", "x", "y"), ("wide", "y", "x"), ("wide", "z", "y"), ("wide", "z", "m0")], "grp string, child string, parent string")
    got = depths(chain.union(tree).union(ring)).cache()
    assert got.where("grp = 'deep'").selectExpr("count(*)", "min(root)", "max(root)", "count_if(depth = 200000 - cast(substr(node, 2) AS int))").first() == (deep + 1, "n200000", "n200000", deep + 1)
    assert got.where("grp = 'wide' and root = 'm0'").count() == wide + 1
    assert rows(got.where("root = ''").select("node", "depth")) == [("x", -1), ("y", -1), ("z", -1)]
    assert rows(got.where("node in ('m3', 'm300000')").select("node", "depth")) == [("m3", 2), ("m300000", 12)]
