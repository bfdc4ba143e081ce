"""Call-graph operators G1-G16. Every frame carries ``item_id``: one job covers all items.

Loops are semi-naive: each round joins only what the last one found, and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.store import counted, importable, large, stored


def call_subgraph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """G1: (item_id, src, edges, used): USER_DEF edges with an internal target and API edges, each sorted by (ln, dst)."""
    internal = functions.select("item_id", F.col("name").alias("callee"), F.lit(True).alias("known"))
    rows = calls.join(internal, ["item_id", "callee"], "left")
    rows = rows.where((F.col("cat") == "IMPORT_API") | ((F.col("cat") == "USER_DEF") & F.col("known")))
    edge = F.struct("ln", F.col("callee").alias("dst"), "call_type")
    pick = lambda cat: F.array_sort(F.collect_list(F.when(F.col("cat") == cat, edge)))
    return rows.groupBy("item_id", F.col("caller").alias("src")).agg(pick("USER_DEF").alias("internal_edges"), pick("IMPORT_API").alias("import_edges"))


def adjacency(sub_edges: DataFrame, reach_edges: DataFrame) -> DataFrame:
    """An item's subgraph edges, or its reachable call graph's where it has no subgraph. Edges repeat as given."""
    return sub_edges.unionByName(reach_edges.join(sub_edges.select("item_id").distinct(), "item_id", "left_anti"))


def user_graph(calls: DataFrame) -> DataFrame:
    """Distinct USER_DEF edges (item_id, src, dst)."""
    return calls.where("cat = 'USER_DEF'").select("item_id", F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """Every node of an edge."""
    return edges.select("item_id", F.col("src").alias("name")).unionByName(edges.select("item_id", F.col("dst").alias("name"))).distinct()


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(item_id, name, depth) of all nodes reachable from each item's entry, the entry included."""
    pairs = stored(edges.select("item_id", "src", "dst").distinct(), "g4-edges")
    seen = stored(entries.select("item_id", F.col("entry").alias("name"), F.lit(0).alias("depth")).distinct(), "g4-seen")
    front, depth, n = seen, 0, seen.count()
    while True:
        depth += 1
        step = counted(front, n).alias("f").join(large(pairs).alias("e"), F.expr("f.item_id = e.item_id and f.name = e.src")).select("e.item_id", F.col("e.dst").alias("name")).distinct()
        front = stored(step.join(large(seen), ["item_id", "name"], "left_anti").withColumn("depth", F.lit(depth)), "g4-front")
        if (n := front.count()) == 0:
            return seen
        seen = seen.unionByName(front)


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose two ends are both among the names."""
    keep = large(names.select("item_id", "name"))
    one = edges.join(keep.withColumnRenamed("name", "src"), ["item_id", "src"], "left_semi")
    return one.join(keep.withColumnRenamed("name", "dst"), ["item_id", "dst"], "left_semi").select("item_id", "src", "dst")


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(item_id, start, end, path) of all simple paths from the starts; with ``ends`` a path stops at its first end.

    ``starts`` and ``ends`` are (item_id, name). A start that is an end gives the path of itself alone.
    """
    pairs = stored(edges.select("item_id", "src", "dst").distinct(), "g5-edges")
    path = stored(starts.select("item_id", F.array("name").alias("path")), "g5-paths")
    out, depth = [], 1
    stop = None if ends is None else large(ends.select("item_id", F.col("name").alias("end")).distinct())
    while True:
        last = path.withColumn("end", F.element_at("path", -1))
        if stop is None:
            out.append(last)
            grow = last
        else:
            out.append(last.join(stop, ["item_id", "end"], "left_semi"))
            grow = last.join(stop, ["item_id", "end"], "left_anti")
        if max_depth is not None and depth >= max_depth:
            break
        more = grow.alias("p").join(large(pairs).alias("e"), (F.col("p.item_id") == F.col("e.item_id")) & (F.col("p.end") == F.col("e.src")) & ~F.array_contains("p.path", F.col("e.dst")))
        path = stored(more.select("p.item_id", F.concat("p.path", F.array("e.dst")).alias("path")), "g5-paths")
        depth += 1
        if path.isEmpty():
            break
    paths = out[0].select("item_id", "path")
    for o in out[1:]:
        paths = paths.unionByName(o.select("item_id", "path"))
    return paths.select("item_id", F.col("path")[0].alias("start"), F.element_at("path", -1).alias("end"), "path")


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(item_id, start, end, path): for each reachable node the shortest path from any start, the least by names among equals.

    A search by breadth that keeps one path a node; with ``ends`` it doesn't go on beyond an end, and only ends come out.
    """
    pairs = stored(edges.select("item_id", "src", "dst").distinct(), "bfs-edges")
    stop = None if ends is None else large(stored(ends.select("item_id", "name").distinct(), "bfs-ends"))
    front = stored(starts.select("item_id", "name").distinct().withColumn("path", F.array("name")), "bfs-front")
    seen = front
    while True:
        grow = front if stop is None else front.join(stop, ["item_id", "name"], "left_anti")
        step = grow.alias("f").join(large(pairs).alias("e"), F.expr("f.item_id = e.item_id and f.name = e.src")).select("e.item_id", F.col("e.dst").alias("name"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(large(seen.select("item_id", "name")), ["item_id", "name"], "left_anti").groupBy("item_id", "name").agg(F.min("path").alias("path"))
        front = stored(step, "bfs-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    got = seen if stop is None else seen.join(stop, ["item_id", "name"], "left_semi")
    return got.select("item_id", F.col("path")[0].alias("start"), F.col("name").alias("end"), "path")


def reachable_pairs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(item_id, start, end): which nodes each start reaches, itself included; nothing is enumerated but these pairs."""
    pairs = stored(edges.select("item_id", "src", "dst").distinct(), "reach-edges")
    seen = front = stored(starts.select("item_id", F.col("name").alias("start"), F.col("name").alias("end")).distinct(), "reach-front")
    n = front.count()
    while True:
        step = counted(front, n).alias("f").join(large(pairs).alias("e"), F.expr("f.item_id = e.item_id and f.end = e.src")).select("e.item_id", "start", F.col("e.dst").alias("end")).distinct()
        front = stored(step.join(large(seen), ["item_id", "start", "end"], "left_anti"), "reach-front")
        if (n := front.count()) == 0:
            return seen
        seen = seen.unionByName(front)


def first_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(item_id, start, end, path): of the simple paths that stop at their first end, the first ``most`` to each end by length,
    then names.

    Only nodes that lead to an end are walked. Where an item's edges have no cycle every path is simple, so the
    ``most`` least paths to a node decide and no more are carried; items with cycles are walked in full, but only
    until each end that can be reached has its paths.
    """
    stop = stored(ends.select("item_id", "name").distinct(), "first-ends")
    back = edges.select("item_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    useful = stored(reachable_pairs(back, stop).select("item_id", F.col("end").alias("name")).distinct(), "first-useful")
    pairs = stored(induced(edges, useful).distinct(), "first-edges")
    comps = scc(pairs)
    looped = comps.groupBy("item_id", "comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item_id").unionByName(pairs.where("src = dst").select("item_id")).distinct()
    cyclic = stored(looped.withColumn("cyclic", F.lit(True)), "first-cyclic")
    begin = starts.select("item_id", "name").distinct().join(useful, ["item_id", "name"], "left_semi")
    goal = stored(shortest_paths(pairs, begin, stop).select("item_id", F.col("end").alias("name")), "first-goal")
    front = stored(begin.withColumn("path", F.array("name")).join(cyclic, "item_id", "left"), "first-front")
    w = Window.partitionBy("item_id", "name").orderBy("path")
    found = None
    while True:
        hits = front.join(stop, ["item_id", "name"], "left_semi").select("item_id", "name", "path")
        found = stored(hits if found is None else found.unionByName(hits), "first-found")
        met = found.groupBy("item_id", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        open_ = goal.join(met, ["item_id", "name"], "left_anti").select("item_id").distinct()
        grow = front.join(stop, ["item_id", "name"], "left_anti").join(open_, "item_id", "left_semi").alias("p")
        on = (F.col("p.item_id") == F.col("e.item_id")) & (F.col("p.name") == F.col("e.src")) & ~F.array_contains("p.path", F.col("e.dst"))
        step = grow.join(pairs.alias("e"), on).select("p.item_id", F.col("e.dst").alias("name"), F.concat("p.path", F.array("e.dst")).alias("path"), "p.cyclic")
        step = step.withColumn("k", F.row_number().over(w)).where(F.col("cyclic") | (F.col("k") <= most)).drop("k")
        front = stored(step, "first-front")
        if front.isEmpty():
            break
    first = Window.partitionBy("item_id", "name").orderBy(F.size("path"), "path")
    got = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    return got.select("item_id", F.col("path")[0].alias("start"), F.col("name").alias("end"), "path")


def complete_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(item_id, path) of the simple paths from the starts that no edge to a node off the path extends."""
    paths = stored(simple_paths(edges, starts).select("item_id", "path"), "g6-paths")
    extended = paths.where(F.size("path") > 1).select("item_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"))
    return paths.join(large(extended), ["item_id", "path"], "left_anti")


def _tarjan(adj: dict) -> dict:
    """Component (least name) of each node, without recursion."""
    index, low, on, stack, comp, n = {}, {}, set(), [], {}, 0
    for root in sorted(adj):
        if root in index:
            continue
        work = [(root, iter(adj[root]))]
        index[root] = low[root] = n
        n += 1
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(adj[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    for w in members:
                        comp[w] = min(members)
    return comp


def _adj(pdf) -> dict:
    adj: dict = {}
    for s, d in zip(pdf["src"], pdf["dst"], strict=True):
        adj.setdefault(s, set())
        if d is not None:
            adj[s].add(d)
            adj.setdefault(d, set())
    return {k: sorted(v) for k, v in adj.items()}


def scc(edges: DataFrame) -> DataFrame:
    """(item_id, name, comp), comp being the least name of the node's strongly connected component.

    One group is one item's graph; a null dst stands for a node without edges.
    """
    importable(edges.sparkSession)

    def run(pdf):
        import pandas as pd

        comp = _tarjan(_adj(pdf))
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[0], "name": list(comp), "comp": list(comp.values())})

    kind = edges.schema["item_id"].dataType.simpleString()
    return edges.select("item_id", "src", "dst").distinct().groupBy("item_id").applyInPandas(run, f"item_id {kind}, name string, comp string")


def condensation(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Distinct edges between different components."""
    a = comps.select("item_id", F.col("name").alias("src"), F.col("comp").alias("ci"))
    b = comps.select("item_id", F.col("name").alias("dst"), F.col("comp").alias("cj"))
    return edges.join(large(a), ["item_id", "src"]).join(large(b), ["item_id", "dst"]).where("ci <> cj").select("item_id", "ci", "cj").distinct()


def dag_metrics(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Per item path_count, min_len, max_len, avg_len (in components) from the entry's component, leaves, n_nodes, n_edges.

    Counts are doubles, as paths grow exponentially. An entry outside the graph falls back to the least name;
    an item without edges is its entry alone.
    """
    importable(edges.sparkSession)
    rows = entries.select("item_id", "entry").join(large(edges.select("item_id", "src", "dst")), "item_id", "left")
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        entry = pdf["entry"].iloc[0]
        adj = _adj(pdf[pdf["src"].notna()])
        if not adj:
            adj = {entry: []}
        start = entry if entry in adj else min(adj)
        comp = _tarjan(adj)
        down: dict = {c: set() for c in comp.values()}
        for s, out in adj.items():
            down[comp[s]] |= {comp[d] for d in out} - {comp[s]}
        order, seen, work = [], {comp[start]}, [(comp[start], iter(sorted(down[comp[start]])))]
        while work:
            v, it = work[-1]
            for w in it:
                if w not in seen:
                    seen.add(w)
                    work.append((w, iter(sorted(down[w]))))
                    break
            else:
                order.append(v)
                work.pop()
        stat: dict = {}
        for v in order:  # children first
            kids = [stat[w] for w in down[v]]
            stat[v] = (sum(k[0] for k in kids), 1 + min(k[1] for k in kids), 1 + max(k[2] for k in kids), sum(k[3] + k[0] for k in kids)) if kids else (1.0, 1, 1, 1.0)
        count, least, most, total = stat[comp[start]]
        n_edges = int(pdf["src"].notna().sum())
        return pd.DataFrame([(pdf["item_id"].iloc[0], float(count), least, most, total / count, sum(not down[v] for v in order), len(adj), n_edges)], columns=["item_id", "path_count", "min_len", "max_len", "avg_len", "leaves", "n_nodes", "n_edges"])

    return rows.groupBy("item_id").applyInPandas(run, f"item_id {kind}, path_count double, min_len long, max_len long, avg_len double, leaves long, n_nodes long, n_edges long")


def wl_signature(edges: DataFrame, labels: DataFrame, rounds: int = 2) -> DataFrame:
    """(item_id, wl): Weisfeiler-Lehman signature of graphs with start labels (item_id, name, label).

    A round's label is md5(label|OUT:sorted labels|IN:sorted labels)[:12]; repeated edges repeat labels. The
    graph's is md5 of its sorted labels, first sixteen digits.
    """
    pairs = edges.select("item_id", "src", "dst")
    now = labels.select("item_id", "name", "label")
    for r in range(rounds):
        other = now.select("item_id", F.col("name").alias("o"), F.col("label").alias("l"))
        out = pairs.join(large(other.withColumnRenamed("o", "dst")), ["item_id", "dst"]).groupBy("item_id", F.col("src").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("outs"))
        ins = pairs.join(large(other.withColumnRenamed("o", "src")), ["item_id", "src"]).groupBy("item_id", F.col("dst").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("ins"))
        text = F.concat("label", F.lit("|OUT:"), F.coalesce("outs", F.lit("")), F.lit("|IN:"), F.coalesce("ins", F.lit("")))
        now = now.join(large(out), ["item_id", "name"], "left").join(large(ins), ["item_id", "name"], "left").select("item_id", "name", F.substring(F.md5(text), 1, 12).alias("label"))
        now = stored(now, f"g10-{r}") if r + 1 < rounds else now
    return now.groupBy("item_id").agg(F.substring(F.md5(F.array_join(F.sort_array(F.collect_list("label")), ",")), 1, 16).alias("wl"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per item max and mean out-degree over all nodes, leaves, node and edge counts; edges repeat as given."""
    out = edges.groupBy("item_id", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("d"))
    per = nodes(edges).join(large(out), ["item_id", "name"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return per.groupBy("item_id").agg(F.max("d").alias("max_out"), F.avg("d").alias("avg_out"), F.count_if(F.col("d") == 0).alias("leaves"), F.count(F.lit(1)).alias("n_nodes"), F.sum("d").alias("n_edges"))


def local_taint(assigns: DataFrame, args: DataFrame, seeds: DataFrame, passes: int = 6) -> DataFrame:
    """Tainted (item_id, func, var) after at most ``passes`` passes.

    assigns (item_id, func, lhs, rhs): taint goes from rhs to lhs. args (item_id, func, call_id, var): one tainted
    argument taints all of its call.
    """
    key = ["item_id", "func"]
    now = stored(seeds.select(*key, "var").distinct(), "g13")
    n = now.count()
    for _ in range(passes):
        by_assign = assigns.join(now.withColumnRenamed("var", "rhs"), [*key, "rhs"], "left_semi").select(*key, F.col("lhs").alias("var"))
        hot = args.join(now, [*key, "var"], "left_semi").select(*key, "call_id").distinct()
        by_call = args.join(hot, [*key, "call_id"], "left_semi").select(*key, "var")
        now = stored(now.unionByName(by_assign).unionByName(by_call).distinct(), "g13")
        if (m := now.count()) == n:
            break
        n = m
    return now


def taint_paths(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Shortest path (item_id, path) from a source to each sink over states named func:param; ties by path."""
    return shortest_paths(flows, sources, sinks).select("item_id", "path")


def table_edges(tables: DataFrame, functions: DataFrame, slots: int = 16) -> DataFrame:
    """Edges (item_id, src, dst) to the functions whose start address a function-pointer table holds."""
    rows = tables.select("item_id", "src", F.explode(F.slice("slots", 1, slots)).alias("start_ea"))
    return rows.join(functions, ["item_id", "start_ea"]).select("item_id", "src", F.col("name").alias("dst")).distinct()


def splice(prefixes: DataFrame, chains: DataFrame) -> DataFrame:
    """The shortest path that ends where a chain starts, put before it."""
    best = prefixes.groupBy("item_id", F.col("end").alias("head")).agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("prefix"))
    joined = chains.withColumn("head", F.col("path")[0]).join(best, ["item_id", "head"], "left")
    return joined.select("item_id", F.when(F.col("prefix").isNull(), F.col("path")).otherwise(F.concat(F.slice("prefix", F.lit(1), F.size("prefix") - 1), "path")).alias("path"))
