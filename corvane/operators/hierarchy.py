"""Parent-child links to full hierarchies: components, cycles, roots, depths, paths and descendants.

Links are joined by weighted disjoint-set forests: every node keeps an offset to its component's root, one more than its parent's.
Forests are built in blocks of some thousand links of one scope, whatever its size, and merged by a tree: the forests of FAN_IN neighbouring
blocks become one, and only nodes that other blocks know as well go up, with their offsets to the roots. Where the nodes that blocks share
are too many for one task, roots hook to their smallest neighbour and jump pointers instead; the result is the same.

A link that closes a loop whose offsets don't add up is a conflict. The steps of a cycle add up to its length and never to 0, so every cycle
has a conflict: a component without one is free of cycles, and in the others cycles are looked for above the conflicts only.

Nodes on a cycle are cut from their parents; paths are then put together by parent traversal that doubles its reach each round.

Null nodes or parents make no link. Repeated links count once. Links to unknown nodes are kept out by the caller's join. A node without
parents is its own root at depth 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import flat_map
from ..session import cut, ship

#: Links of one block, forests merged at once, and links between shared nodes that a merge takes into one task at most.
BLOCK_LINKS, FAN_IN, MERGE_LINKS = 4_096, 8, 200_000
#: Links of a component that is searched for cycles in one task; larger ones are searched by all tasks together.
COMPONENT_LINKS = 100_000


def _forests(edges: DataFrame, block_links: int) -> DataFrame:
    """The forest of each block: scope, block, blocks, node, root, off, and the conflicts found (conflict: node and root are the link's ends)."""
    sizes = edges.groupBy("scope").count().select("scope", F.ceil(F.col("count") / block_links).cast("int").alias("blocks"))
    salted = edges.join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    return _grouped_forests(salted)


def _grouped_forests(links: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in links.schema}
    return links.groupBy("scope", "block").applyInPandas(_forest, f"scope {kinds['scope']}, block int, blocks int, node {kinds['u']}, root {kinds['u']}, off int, conflict boolean")


def placed(links: DataFrame, scope: str = "scope", child: str = "child", parent: str = "parent", block_links: int = BLOCK_LINKS, merge_links: int = MERGE_LINKS) -> tuple[DataFrame, DataFrame]:
    """(scope, node, root, off) of every node, and (scope, at): a node of each conflict."""
    ship(links.sparkSession)
    edges = cut(links.select(F.col(scope).alias("scope"), F.col(child).alias("u"), F.col(parent).alias("v")).where("u is not null and v is not null").distinct().withColumn("w", F.lit(1)))
    local = cut(_forests(edges, block_links))
    conflicts = local.where("conflict").select("scope", F.col("node").alias("at"))
    state = local.where("not conflict").select("scope", "block", "blocks", "node", "root", "off")
    whole = state.where("blocks = 1").select("scope", "node", "root", "off")
    parts = state.where("blocks > 1")
    if parts.isEmpty():
        return whole, conflicts
    shared = parts.groupBy("scope", "node").agg(F.count("*").alias("n")).where("n > 1").select("scope", "node")
    stars = cut(parts.join(shared, ["scope", "node"], "left_semi"))
    large = stars.groupBy("scope").count().where(F.col("count") > merge_links).select("scope")
    if not large.isEmpty():
        hooked, more = _merged(parts.join(large, "scope", "left_semi"))
        whole, conflicts = whole.unionByName(hooked), conflicts.unionByName(more)
        parts, stars = parts.join(large, "scope", "left_anti"), stars.join(large, "scope", "left_anti")
    while not parts.where("blocks > 1").isEmpty():
        up = [F.floor(F.col("block") / FAN_IN).cast("int").alias("block"), F.ceil(F.col("blocks") / FAN_IN).cast("int").alias("blocks")]
        links_up = stars.where("node <> root").select("scope", *up, F.col("node").alias("u"), F.col("root").alias("v"), F.col("off").alias("w"))
        merged = cut(_grouped_forests(links_up))
        conflicts = conflicts.unionByName(merged.where("conflict").select("scope", F.col("node").alias("at")))
        step = merged.where("not conflict").select("scope", "block", F.col("node").alias("root"), F.col("root").alias("r2"), F.col("off").alias("w2"))

        def moved(rows: DataFrame) -> DataFrame:
            above = rows.select("scope", *up, "node", "root", "off").join(step, ["scope", "block", "root"], "left")
            return above.select("scope", "block", "blocks", "node", F.coalesce("r2", "root").alias("root"), (F.col("off") + F.coalesce("w2", F.lit(0))).alias("off"))

        parts, stars = cut(moved(parts)), moved(stars).distinct()
    # A node of several blocks has one root; its offsets agree but in components with a conflict, where the least stands.
    return whole.unionByName(parts.groupBy("scope", "node").agg(F.min("root").alias("root"), F.min("off").alias("off"))), conflicts


def components(links: DataFrame, scope: str = "scope", child: str = "child", parent: str = "parent", block_links: int = BLOCK_LINKS, merge_links: int = MERGE_LINKS) -> DataFrame:
    """scope, node, root (the smallest node of its component), off (offset to the root), loop (whether the component holds a conflict)."""
    places, conflicts = placed(links, scope, child, parent, block_links, merge_links)
    places = cut(places)
    marked = conflicts.select("scope", F.col("at").alias("node")).distinct().join(places, ["scope", "node"]).select("scope", "root", F.lit(True).alias("m")).distinct()
    return places.join(marked, ["scope", "root"], "left").select("scope", "node", "root", "off", F.coalesce("m", F.lit(False)).alias("loop"))


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted disjoint sets of one block; the root of a set is its smallest node."""
    up: dict = {}
    off: dict = {}
    size: dict = defaultdict(lambda: 1)
    conflicts: list = []

    def find(x):
        trail = []
        while up.setdefault(x, x) != x:
            trail.append(x)
            x = up[x]
        total = 0
        for y in reversed(trail):  # offsets to the root, nearest to the root first
            total += off[y]
            up[y], off[y] = x, total
        return x

    for u, v, w in zip(pdf.u, pdf.v, pdf.w):
        a, b = find(u), find(v)
        du, dv = off.get(u, 0) if a != u else 0, off.get(v, 0) if b != v else 0
        gap = w - du + dv  # offset of a to b that this link asks for
        if a == b:
            if gap:
                conflicts.append((u, v))
        elif size[a] <= size[b]:
            up[a], off[a] = b, gap
            size[b] += size[a]
        else:
            up[b], off[b] = a, -gap
            size[a] += size[b]
    roots = {x: find(x) for x in list(up)}
    least: dict = {}
    for x, r in roots.items():
        if r not in least or x < least[r]:
            least[r] = x
    head = pdf.scope.iloc[0], pdf.block.iloc[0], pdf.blocks.iloc[0]
    rows = []
    for x, r in roots.items():
        m = least[r]
        base = off.get(m, 0) if m != r else 0
        rows.append((*head, x, m, (off.get(x, 0) if x != r else 0) - base, False))
    rows += [(*head, u, v, 0, True) for u, v in conflicts]
    return pd.DataFrame(rows, columns=["scope", "block", "blocks", "node", "root", "off", "conflict"])


def _merged(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forests of the blocks of a scope that shares too many nodes for one task, into one: node ~ root are links again, between ever fewer
    roots. Gives the places and the conflicts."""
    links = parts.where("node <> root").select("scope", F.col("node").alias("u"), F.col("root").alias("v"), F.col("off").alias("w")).distinct()
    places = cut(parts.select("scope", "node").distinct().select("scope", "node", F.col("node").alias("root"), F.lit(0).alias("off")))
    loops = parts.limit(0).select("scope", F.col("root").alias("at"))
    links = cut(links)
    while not links.isEmpty():
        both = links.unionByName(links.select("scope", F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("w")).alias("w")))
        hooks = both.where("v < u").groupBy("scope", "u").agg(F.min(F.struct("v", "w")).alias("h")).select("scope", "u", "h.v", "h.w")
        hooks = cut(hooks)
        while True:  # pointer jumping: every hook ends at a root of this round
            further = hooks.select("scope", F.col("u").alias("v"), F.col("v").alias("v2"), F.col("w").alias("w2"))
            jumped = cut(hooks.join(further, ["scope", "v"], "left").select("scope", "u", F.coalesce("v2", "v").alias("v"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.col("v2").isNotNull().alias("moved")))
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        target = hooks.select("scope", F.col("u").alias("root"), F.col("v").alias("r2"), F.col("w").alias("w2"))
        places = cut(places.join(target, ["scope", "root"], "left").select("scope", "node", F.coalesce("r2", "root").alias("root"), (F.col("off") + F.coalesce("w2", F.lit(0))).alias("off")))
        a = hooks.select("scope", F.col("u"), F.col("v").alias("ru"), F.col("w").alias("wu"))
        b = hooks.select("scope", F.col("u").alias("v"), F.col("v").alias("rv"), F.col("w").alias("wv"))
        moved = cut(
            links.join(a, ["scope", "u"], "left")
            .join(b, ["scope", "v"], "left")
            .select("scope", F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"), (F.col("w") - F.coalesce("wu", F.lit(0)) + F.coalesce("wv", F.lit(0))).alias("w"))
            .distinct()
        )
        loops = loops.unionByName(moved.where("u = v and w <> 0").select("scope", F.col("u").alias("at")))
        # Two links between the same roots that ask for different offsets disagree as well; the next round finds it.
        links = moved.where("u <> v")
    return places, loops


def cycles(links: DataFrame, scope: str = "scope", child: str = "child", parent: str = "parent", block_links: int = BLOCK_LINKS, merge_links: int = MERGE_LINKS, component_links: int = COMPONENT_LINKS) -> DataFrame:
    """scope, cycle_id (the smallest node of the cycle's strongly connected set) and node, for each node on a cycle."""
    places, conflicts = placed(links, scope, child, parent, block_links, merge_links)
    places = cut(places.select("scope", "node", "root"))
    edges = links.select(F.col(scope).alias("scope"), F.col(child).alias("u"), F.col(parent).alias("v")).where("u is not null and v is not null").distinct()
    # The conflicts of a component are its starts: a link of the block or merge that found it, or a root where forests disagreed.
    starts = conflicts.select("scope", F.col("at").alias("node")).distinct().join(places, ["scope", "node"]).select("scope", "root", F.col("node").alias("u")).distinct()
    suspects = places.join(starts.select("scope", "root").distinct(), ["scope", "root"], "left_semi").select("scope", F.col("node").alias("u"), "root")
    inside = cut(edges.join(suspects, ["scope", "u"]))
    sizes = cut(inside.groupBy("scope", "root").count())
    small, large = sizes.where(F.col("count") <= component_links).drop("count"), sizes.where(F.col("count") > component_links).drop("count")
    kinds = {f.name: f.dataType.simpleString() for f in inside.schema}
    found = inside.join(small, ["scope", "root"], "left_semi").groupBy("scope", "root").applyInPandas(_strong, f"scope {kinds['scope']}, cycle_id {kinds['u']}, node {kinds['u']}")
    if large.isEmpty():
        return found
    return found.unionByName(_strong_large(inside.join(large, ["scope", "root"], "left_semi").select("scope", "u", "v")))


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cycles of one component, read off its conflicts: nodes without a parent or a child are trimmed; the offsets of what is left are
    taken anew, and the strongly connected sets above its conflicts are searched, without recursion."""
    out = defaultdict(list)
    below: dict = defaultdict(int)
    for u, v in zip(pdf.u, pdf.v):
        out[u].append(v)
        below[v] += 1
    free = [x for x in out if not below[x]]
    while free:  # a node without a child lies on no cycle
        for v in out.pop(free.pop()):
            below[v] -= 1
            if not below[v] and v in out:
                free.append(v)
    block = pd.DataFrame([(u, v) for u, targets in out.items() for v in targets if v in out], columns=["u", "v"])
    if block.empty:
        return pd.DataFrame([], columns=["scope", "cycle_id", "node"])
    forest = _forest(block.assign(scope=pdf.scope.iloc[0], block=0, blocks=1, w=1))
    starts = list(dict.fromkeys(forest[forest.conflict].root))
    index: dict = {}
    low: dict = {}
    stack, on = [], set()
    rows = []
    for start in starts:
        if start in index:
            continue
        work = [(start, iter(out.get(start, ())))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, targets = work[-1]
            for t in targets:
                if t not in index:
                    index[t] = low[t] = len(index)
                    stack.append(t)
                    on.add(t)
                    work.append((t, iter(out.get(t, ()))))
                    break
                if t in on:
                    low[node] = min(low[node], index[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    if len(members) > 1 or node in out.get(node, ()):
                        least = min(members)
                        rows += [(pdf.scope.iloc[0], least, x) for x in members]
    return pd.DataFrame(rows, columns=["scope", "cycle_id", "node"])


def _strong_large(edges: DataFrame) -> DataFrame:
    """The same for components no task may hold: trim what lies on no cycle, then colour forwards and search backwards, round by round."""
    spark = edges.sparkSession
    found = None
    edges = cut(edges)
    while True:
        while True:  # trim nodes without a link in or out
            heads, tails = edges.select("scope", F.col("v").alias("x")).distinct(), edges.select("scope", F.col("u").alias("x")).distinct()
            both = heads.intersect(tails)
            kept = cut(edges.join(both.withColumnRenamed("x", "u"), ["scope", "u"], "left_semi").join(both.withColumnRenamed("x", "v"), ["scope", "v"], "left_semi").select("scope", "u", "v"))
            if kept.count() == edges.count():
                break
            edges = kept
        if edges.isEmpty():
            break
        # Colour: the smallest node that reaches a node.
        colour = cut(edges.select("scope", F.col("u").alias("x")).union(edges.select("scope", "v")).distinct().withColumn("c", F.col("x")))
        while True:
            step = edges.join(colour.select("scope", F.col("x").alias("u"), "c"), ["scope", "u"]).select("scope", F.col("v").alias("x"), "c")
            new = cut(colour.select("scope", "x", "c").unionByName(step).groupBy("scope", "x").agg(F.min("c").alias("c")))
            if new.join(colour, ["scope", "x", "c"], "left_anti").isEmpty():
                break
            colour = new
        # Backwards from each colour's node within the colour: exactly its strongly connected set.
        tinted = cut(edges.join(colour.select("scope", F.col("x").alias("u"), F.col("c").alias("cu")), ["scope", "u"]).join(colour.select("scope", F.col("x").alias("v"), F.col("c").alias("cv")), ["scope", "v"]).where("cu = cv").select("scope", "u", "v", F.col("cu").alias("c")))
        reach = cut(colour.where("x = c").select("scope", "x", "c"))
        while True:
            step = tinted.join(reach.select("scope", F.col("x").alias("v"), "c"), ["scope", "v", "c"]).select("scope", F.col("u").alias("x"), "c")
            new = cut(reach.unionByName(step).distinct())
            if new.count() == reach.count():
                break
            reach = new
        sets = reach.withColumn("n", F.count("*").over(Window.partitionBy("scope", "c")))
        loops = edges.where("u = v").select("scope", F.col("u").alias("x")).distinct()
        strong = sets.where("n > 1").select("scope", "c", "x").unionByName(sets.where("n = 1").join(loops, ["scope", "x"], "left_semi").select("scope", "c", "x"))
        strong = cut(strong.select("scope", F.min("x").over(Window.partitionBy("scope", "c")).alias("cycle_id"), F.col("x").alias("node")))
        found = strong if found is None else found.unionByName(strong)
        gone = reach.select("scope", "x").distinct()
        edges = cut(edges.join(gone.withColumnRenamed("x", "u"), ["scope", "u"], "left_anti").join(gone.withColumnRenamed("x", "v"), ["scope", "v"], "left_anti").select("scope", "u", "v"))
    return found if found is not None else spark.createDataFrame([], edges.select("scope", F.col("u").alias("cycle_id"), F.col("v").alias("node")).schema)


def paths(nodes: DataFrame, links: DataFrame, on_cycles: DataFrame | None = None, scope: str = "scope", node: str = "node", child: str = "child", parent: str = "parent") -> DataFrame:
    """scope, node, path (from the root to the node), depth, root, on_cycle. Of several parents the smallest is followed; nodes on a cycle
    have no parent. The traversal doubles its reach each round, so it takes as many rounds as the depth has binary digits."""
    base = nodes.select(F.col(scope).alias("scope"), F.col(node).alias("node")).where("node is not null").distinct()
    first = links.select(F.col(scope).alias("scope"), F.col(child).alias("node"), F.col(parent).alias("up")).where("node is not null and up is not null").groupBy("scope", "node").agg(F.min("up").alias("up"))
    table = base.join(first, ["scope", "node"], "left")
    if on_cycles is not None:
        marks = on_cycles.select("scope", "node", F.lit(True).alias("on_cycle")).distinct()
        table = table.join(marks, ["scope", "node"], "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))
    else:
        table = table.withColumn("on_cycle", F.lit(False))
    # path: what is known above and with the node; top: the next ancestor not yet in it.
    state = cut(table.select("scope", "node", "on_cycle", F.array("node").alias("path"), F.when(~F.col("on_cycle"), F.col("up")).alias("top")))
    while not (open_ := state.where("top is not null")).isEmpty():
        above = state.select("scope", F.col("node").alias("top"), F.col("path").alias("more"), F.col("top").alias("next"))
        done = state.where("top is null")
        grown = open_.join(above, ["scope", "top"], "left").select("scope", "node", "on_cycle", F.concat(F.coalesce("more", F.array("top")), "path").alias("path"), F.col("next").alias("top"))
        state = cut(done.unionByName(grown))
    return state.select("scope", "node", "path", (F.size("path") - 1).alias("depth"), F.element_at("path", 1).alias("root"), "on_cycle")


def descendants(tree: DataFrame) -> DataFrame:
    """scope, ancestor, descendant and the steps between them, from paths()."""
    pairs = tree.select("scope", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor"))
    return pairs.where("ancestor <> descendant").select("scope", "ancestor", "descendant", (F.col("depth") - F.col("level")).alias("steps"))


def all_descendants(links: DataFrame, scope: str = "scope", child: str = "child", parent: str = "parent") -> DataFrame:
    """scope, ancestor, descendant and the least steps between them, over every parent of a node. Nodes on a cycle are below each other; no
    node is below itself. The reach doubles each round: a pair more than `reach` steps apart has a node exactly `reach` steps below its ancestor."""
    edges = links.select(F.col(scope).alias("scope"), F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).where("ancestor is not null and descendant is not null and ancestor <> descendant").distinct()
    pairs = front = cut(edges.withColumn("steps", F.lit(1)))
    reach = 1
    while not front.isEmpty():
        left = front.where(F.col("steps") == reach).select("scope", "ancestor", F.col("descendant").alias("mid"))
        right = pairs.select("scope", F.col("ancestor").alias("mid"), "descendant", "steps")
        met = left.join(right, ["scope", "mid"]).where("ancestor <> descendant").groupBy("scope", "ancestor", "descendant").agg((F.min("steps") + reach).alias("steps"))
        front = cut(met.join(pairs, ["scope", "ancestor", "descendant"], "left_anti"))
        pairs, reach = pairs.unionByName(front), 2 * reach
    return pairs


def linearised(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """scope, node, depth_first and c3 of every node. nodes: scope, node; links: scope, child, parent, position. A node's links and those of
    all its ancestors come together in its own row, so rows are spread whatever the size of a scope.

    depth_first: the node, then each base in the order of its position with all above it, each node where it comes first; a node already being
    visited is passed over. c3: the merge of the bases' linearisations and the bases themselves; null if they contradict each other or lie on
    a cycle. A base named at several positions counts at its first; of classes of one name the smaller comes first."""
    once = links.groupBy("scope", "child", "parent").agg(F.min("position").alias("position"))
    above = all_descendants(links).select("scope", F.col("descendant").alias("node"), F.col("ancestor").alias("child"))
    every = nodes.select("scope", "node").where("node is not null").distinct()
    own = cut(above.unionByName(every.select("scope", "node", F.col("node").alias("child"))))
    gathered = own.join(once, ["scope", "child"]).groupBy("scope", "node").agg(F.array_sort(F.collect_list(F.struct("child", "position", "parent"))).alias("links"))
    kinds = {f.name: f.dataType.simpleString() for f in every.schema}

    def make():
        def row(scope, node, found):
            bases: dict = defaultdict(list)
            for x in found or ():
                bases[x["child"]].append(x["parent"])
            return [(scope, node, _depth_first(node, bases), _c3(node, bases))]

        return row

    return flat_map(every.join(gathered, ["scope", "node"], "left"), ["scope", "node", "links"], make, f"scope {kinds['scope']}, node {kinds['node']}, depth_first array<{kinds['node']}>, c3 array<{kinds['node']}>")


def _depth_first(node, bases: dict) -> list:
    seen, todo = {}, [node]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen[x] = None
            todo += reversed(bases.get(x, ()))
    return list(seen)


def _c3(node, bases: dict) -> list | None:
    done: dict = {}
    todo, open_ = [node], set()
    while todo:
        x = todo[-1]
        waiting = [b for b in bases.get(x, ()) if b not in done]
        if waiting:
            if x in open_ and any(b in open_ for b in waiting):
                return None
            open_.add(x)
            todo.append(waiting[0])
            continue
        todo.pop()
        if x in done:
            continue
        rows = [list(done[b] or ()) for b in bases.get(x, ())] + [list(bases.get(x, ()))]
        out: list | None = [x]
        if x in bases.get(x, ()) or any(done[b] is None for b in bases.get(x, ())):
            out = None
        while out is not None and any(rows):
            head = next((r[0] for r in rows if r and not any(r[0] in q[1:] for q in rows)), None)
            if head is None:
                out = None
                break
            out.append(head)
            rows = [[y for y in r if y != head] for r in rows]
        done[x] = out
    return done[node]
