import random
from collections import defaultdict

from pyspark.sql import functions as F

from corvane.operators import class_links
from corvane.operators.hierarchy import all_descendants, components, cycles, descendants, linearised, paths

LINKS = "scope string, child string, parent string"


def brute_cycles(links):
    out = defaultdict(set)
    for s, c, p in links:
        if c and p:
            out[s, c].add(p)

    def reach(s, x):
        seen, todo = set(), [x]
        while todo:
            for y in out.get((s, todo.pop()), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    nodes = {(s, x) for s, c, p in links for x in (c, p) if x}
    on = {n for n in nodes if n[1] in reach(*n)}
    return {(s, min(y for t, y in on if t == s and y in reach(s, x) and x in reach(s, y)), x) for s, x in on}


def random_links(seed, n=60, m=70):
    r = random.Random(seed)
    return [(f"s{r.randrange(2)}", f"n{r.randrange(n):03}", f"n{r.randrange(n):03}") for _ in range(m)]


def found(df):
    return {(r.scope, r.cycle_id, r.node) for r in df.select("scope", "cycle_id", "node").collect()}


def test_cycles_against_brute_force_in_one_block_and_in_many(spark):
    links = [*random_links(1), ("s9", "a", "a"), ("s9", "b", "c"), (None, "x", "y"), ("s9", None, "c"), ("s9", "b", None)]
    df = spark.createDataFrame(links, LINKS)
    want = brute_cycles([x for x in links if x[0]])
    assert found(cycles(df)) == want
    assert ("s9", "a", "a") in want
    # Blocks of three links force the merge of forests and the search in components no task may hold.
    assert found(cycles(df, block_links=3)) == want
    assert found(cycles(df, block_links=3, merge_links=5)) == want
    assert found(cycles(df, block_links=3, component_links=5)) == want


def test_components_give_consistent_offsets(spark):
    df = spark.createDataFrame([("s", "b", "a"), ("s", "c", "a"), ("s", "d", "b"), ("s", "d", "c"), ("s", "x", "y"), ("s", "y", "z"), ("s", "x", "z")], LINKS)
    for block, merge in ((100, 100), (2, 100), (1, 100), (1, 2)):
        every = components(df, block_links=block, merge_links=merge).select("node", "root", "off", "loop").collect()
        rows = {r.node: r for r in every}
        assert len(rows) == len(every)
        assert {rows[n].root for n in "abcd"} == {"a"} and {rows[n].root for n in "xyz"} == {"x"}
        assert [rows[n].off - rows["a"].off for n in "abcd"] == [0, 1, 1, 2]
        assert not rows["a"].loop and rows["x"].loop  # a diamond of equal arms has a potential, unequal arms don't


def test_paths_depths_and_descendants(spark):
    nodes = spark.createDataFrame([("s", x) for x in "abcdefgh"] + [("s", "a"), (None, None)], "scope string, node string")
    links = spark.createDataFrame([("s", "b", "a"), ("s", "c", "b"), ("s", "d", "c"), ("s", "e", "d"), ("s", "f", "g"), ("s", "g", "f"), ("s", "h", "f"), ("s", "c", "b")], LINKS)
    tree = {r.node: r for r in paths(nodes, links, cycles(links)).collect()}
    assert tree["e"].path == list("abcde") and tree["e"].depth == 4 and tree["e"].root == "a"
    assert tree["f"].on_cycle and tree["f"].depth == 0 and tree["h"].path == ["f", "h"] and not tree["h"].on_cycle
    below = {(r.ancestor, r.descendant, r.steps) for r in descendants(paths(nodes, links, cycles(links))).collect()}
    assert ("a", "e", 4) in below and ("f", "h", 1) in below and len(below) == 11


def test_empty_tables(spark):
    links = spark.createDataFrame([], LINKS)
    assert cycles(links).count() == 0
    nodes = spark.createDataFrame([("s", "a")], "scope string, node string")
    assert [(r.depth, r.root) for r in paths(nodes, links, cycles(links)).collect()] == [(0, "a")]


def test_base_names(spark):
    df = spark.createDataFrame([("pkg.mod.Base",), ("Base[T]",), (" Base ",), ("a.Base<String, b.C>",), ("ns::Base",), (None,), ("",)], "n string")
    assert [r.s for r in df.select(class_links.simple_name(F.col("n")).alias("s")).collect()] == ["Base"] * 5 + [None, ""]


def test_links_resolve_within_a_repository_and_ignore_extra_columns(spark):
    classes = spark.createDataFrame([("c1", "r1", "A", "x"), ("c2", "r1", "B", "x"), ("c3", "r2", "A", "x"), ("c2", "r1", "B", "x")], "chunk_id string, repo_id string, class_name string, parent string")
    refs = spark.createDataFrame([("c2", "r1", "m.A", 0), ("c2", "r1", "m.A", 0), ("c2", "r1", "object", 1), ("c2", None, "A", 2)], "chunk_id string, repo_id string, name string, position int")
    assert [(r.scope, r.child, r.parent) for r in class_links.base_links(classes, refs).collect()] == [("r1", "c2", "c1")]


def brute_below(links):
    out = defaultdict(set)
    for s, c, p in links:
        if c and p:
            out[s, p].add(c)
    pairs = set()
    for s, top in list(out):
        seen, level, steps = {top}, {top}, 0
        while level:
            level, steps = {y for x in level for y in out.get((s, x), ())} - seen, steps + 1
            seen |= level
            pairs |= {(s, top, y, steps) for y in level}
    return pairs


def test_all_descendants_follow_every_parent(spark):
    chain = [("s9", f"c{i + 1:02}", f"c{i:02}") for i in range(21)]
    links = [*random_links(1), *chain, ("s8", "d", "a"), ("s8", "d", "b"), ("s8", "e", "d"), ("s8", "d", "a"), ("s8", "a", "a"), ("s8", None, "a"), ("s8", "e", None)]
    got = [tuple(r) for r in all_descendants(spark.createDataFrame(links, LINKS)).select("scope", "ancestor", "descendant", "steps").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_below([x for x in links if x[1] != x[2]])
    assert {("s8", "b", "e", 2), ("s8", "a", "e", 2), ("s9", "c00", "c21", 21)} <= set(got)


def test_registered_descendants_take_bases_of_all_positions(spark, tmp_path):
    from corvane.plans.hierarchy import QUERIES

    classes = [(x, "r", x.upper(), "f", False, False, [x.upper()], 1) for x in "abcd"]
    spark.createDataFrame(classes, "chunk_id string, repo_id string, class_name string, file_path string, is_abstract boolean, is_mixin boolean, mro_list array<string>, extracted_at long").write.parquet(f"{tmp_path}/class_hierarchy.parquet")
    refs = [("c", "r", "A", 0), ("c", "r", "B", 1), ("d", "r", "C", 0)]
    spark.createDataFrame(refs, "chunk_id string, repo_id string, name string, position int").write.parquet(f"{tmp_path}/base_class_refs.parquet")
    rows = {(r.ancestor, r.descendant, r.steps) for r in QUERIES["p1_all_descendants"](spark, str(tmp_path)).collect()}
    assert rows == {("a", "c", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 2), ("b", "d", 2)}


def test_resolution_orders_are_those_of_python(spark):
    r = random.Random(6)
    classes, links = {}, []
    for i in range(40):
        bases = r.sample(sorted(classes), min(len(classes), r.randrange(4)))
        try:
            classes[f"n{i:02}"] = type(f"n{i:02}", tuple(classes[b] for b in bases), {})
        except TypeError:
            continue  # no linearisation
        links += [("s", f"n{i:02}", b, p) for p, b in enumerate(bases)]
    bad = [("t", "x", "a", 0), ("t", "x", "b", 1), ("t", "y", "b", 0), ("t", "y", "a", 1), ("t", "z", "x", 0), ("t", "z", "y", 1), ("t", "c", "d", 0), ("t", "d", "c", 0)]
    nodes = [("s", n) for n in classes] + [("t", n) for n in "xyzabcd"] + [("s", None)]
    got = {(x.scope, x.node): x for x in linearised(spark.createDataFrame(nodes, "scope string, node string"), spark.createDataFrame(links + bad, "scope string, child string, parent string, position int")).collect()}
    assert len(got) == len(nodes) - 1
    for n, c in classes.items():
        assert got["s", n].c3 == [k.__name__ for k in c.__mro__[:-1]]
    # A diamond whose arms name their bases in different orders has no linearisation, nor has a cycle; the depth-first order always exists.
    assert got["t", "z"].c3 is None and got["t", "z"].depth_first == ["z", "x", "a", "b", "y"]
    assert got["t", "c"].c3 is None and got["t", "c"].depth_first == ["c", "d"] and got["t", "a"].c3 == ["a"]
