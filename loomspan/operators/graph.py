"""The property graph: nodes (id, type, name, file_path, line, exported) and edges (id, source, target, type) as tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"function": "function", "method": "method", "class": "class", "interface": "interface", "type": "type", "constant": "constant", "property": "property", "struct": "class", "trait": "interface"}
INHERITS = ("extends", "implements")


def shared_folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='loomspan-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage: a Parquet table in the shared folder, so that loops don't grow plans and lost executors don't matter."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    """What was written goes when the program ends."""
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone by then
            return


atexit.register(_forget)


def node_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    return F.when(kind == "file", F.concat(F.lit("file:"), path)).when(kind == "module", F.concat(F.lit("module:"), name)).when(kind == "placeholder", F.concat(F.lit("type:"), name)).otherwise(F.concat_ws(":", kind, path, name, line.cast("string")))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, target, kind), 256), 1, 16)


def node_type(kind: Column) -> Column:
    """Kinds without a node type of their own count as functions."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in KINDS.items() for x in item]), kind), F.lit("function"))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # --- upkeep ---

    def upsert_nodes(self, rows: DataFrame) -> Graph:
        return Graph(self.nodes.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True), self.edges)

    def upsert_edges(self, rows: DataFrame) -> Graph:
        rows = rows.withColumn("id", edge_id(F.col("source"), F.col("target"), F.col("type")))
        return Graph(self.nodes, self.edges.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def remove_node(self, node: str) -> Graph:
        return Graph(self.nodes.filter(F.col("id") != node), self.edges.filter((F.col("source") != node) & (F.col("target") != node)))

    def remove_edge(self, edge: str) -> Graph:
        return Graph(self.nodes, self.edges.filter(F.col("id") != edge))

    def clear(self) -> Graph:
        return Graph(self.nodes.limit(0), self.edges.limit(0))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    # --- lookups ---

    def find(self, kind: str | None = None, path: str | None = None, exported: bool | None = None, name: str | None = None, pattern: str | None = None) -> DataFrame:
        rows = self.nodes
        for column, value in (("type", kind), ("file_path", path), ("exported", exported)):
            if value is not None:
                rows = rows.filter(F.col(column) == value)
        if name is not None:
            rows = rows.filter(F.lower("name").contains(name.lower()))
        return rows if pattern is None else rows.filter(F.col("name").rlike(pattern))

    def node(self, node: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node)

    def edge(self, edge: str) -> DataFrame:
        return self.edges.filter(F.col("id") == edge)

    def file_symbols(self, path: str, include_private: bool = True) -> DataFrame:
        rows = self.find(path=path)
        return rows if include_private else rows.filter("exported")

    def callers(self, node: str) -> DataFrame:
        return self._other_end(F.col("target") == node, "source", ["calls"])

    def callees(self, node: str) -> DataFrame:
        return self._other_end(F.col("source") == node, "target", ["calls"])

    def _other_end(self, where: Column, end: str, kinds: list[str]) -> DataFrame:
        ids = self.edges.filter(where & F.col("type").isin(*kinds)).select(F.col(end).alias("id")).distinct()
        return self.nodes.join(ids, "id")

    def importers(self, path: str) -> DataFrame:
        """Files whose node imports a node of the file."""
        inside = self.nodes.filter((F.col("file_path") == path) | (F.col("id") == f"file:{path}")).select(F.col("id").alias("target"))
        ids = self.edges.filter(F.col("type") == "imports").join(inside, "target").select(F.col("source").alias("id")).distinct()
        return self.nodes.join(ids, "id")

    # --- traversals ---

    def related(self, start: str | DataFrame, depth: int = 3, direction: str = "both", edge_types: list[str] | None = None, node_types: list[str] | None = None) -> DataFrame:
        """(id, depth): nodes at a shortest distance of up to `depth`, the start at 0."""
        edges = self.edges if edge_types is None else self.edges.filter(F.col("type").isin(*edge_types))
        if node_types is not None:
            allowed = self.nodes.filter(F.col("type").isin(*node_types)).select(F.col("id").alias("to"))
        spark = self.edges.sparkSession
        seeds = spark.createDataFrame([(start,)], "id string") if isinstance(start, str) else start.select("id")
        pairs = _pairs(edges, direction)
        return khop(pairs if node_types is None else pairs.join(allowed, "to", "left_semi"), seeds, depth)

    def related_edges(self, reached: DataFrame) -> DataFrame:
        """Edges of which both ends are reached."""
        ids = reached.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")

    def path(self, a: str, b: str, most: int = 10, edge_types: list[str] | None = None) -> DataFrame:
        """(path): one shortest undirected path of at most `most` edges, the least by its ids; no row if there is none."""
        edges = self.edges if edge_types is None else self.edges.filter(F.col("type").isin(*edge_types))
        known = self.nodes.filter(F.col("id").isin(a, b)).select("id").distinct().count()
        spark = self.edges.sparkSession
        if known < len({a, b}):
            return spark.createDataFrame([], "path array<string>")
        return shortest_path(_pairs(edges, "both"), a, b, most)

    def inheritance(self, node: str, direction: str = "up") -> DataFrame:
        """(id, depth): what the node extends or implements, and so on (up), or what does so to it (down)."""
        pairs = _pairs(self.edges.filter(F.col("type").isin(*INHERITS)), "outgoing" if direction == "up" else "incoming")
        seed = self.edges.sparkSession.createDataFrame([(node,)], "id string")
        return khop(pairs, seed, None).filter("depth > 0")

    def has_path(self, a: str, b: str) -> bool:
        """Directed, over all types; a node reaches itself."""
        if a == b:
            return True
        seed = self.edges.sparkSession.createDataFrame([(a,)], "id string")
        return not khop(_pairs(self.edges, "outgoing"), seed, None, stop=b).filter(F.col("id") == b).isEmpty()

    def would_create_cycle(self, source: str, target: str) -> bool:
        return self.has_path(target, source)

    # --- cycles ---

    def components(self, edge_types: list[str] | None = None) -> DataFrame:
        edges = self.edges if edge_types is None else self.edges.filter(F.col("type").isin(*edge_types))
        return strong_components(edges.select("source", "target"), self.nodes.select("id"))

    def cycles(self, edge_types: list[str] | None = None) -> DataFrame:
        """(scc, members, size, edge_types, self_loop): components of two nodes or more, and nodes with an edge to themselves."""
        edges = self.edges if edge_types is None else self.edges.filter(F.col("type").isin(*edge_types))
        scc = cut(self.components(edge_types))
        sized = scc.groupBy("scc").agg(F.sort_array(F.collect_set("id")).alias("members"), F.count("*").alias("size"))
        loops = edges.filter("source = target").select(F.col("source").alias("id")).distinct().join(scc, "id").select("scc").distinct().withColumn("loop", F.lit(True))
        inside = edges.join(scc.select(F.col("id").alias("source"), "scc"), "source").join(scc.select(F.col("id").alias("target"), F.col("scc").alias("scc2")), "target").filter("scc = scc2")
        kinds = inside.groupBy("scc").agg(F.sort_array(F.collect_set("type")).alias("edge_types"))
        found = sized.join(loops, "scc", "left").filter((F.col("size") > 1) | F.col("loop")).join(kinds, "scc", "left")
        return found.select("scc", "members", "size", "edge_types", (F.col("size") == 1).alias("self_loop"))

    def cyclic_nodes(self) -> DataFrame:
        return self.cycles().select(F.explode("members").alias("id"))

    def cycle_of(self, node: str) -> DataFrame:
        return self.cycles().filter(F.array_contains("members", node))

    def minimal_cycle(self) -> DataFrame:
        return self.cycles().orderBy("size", "scc").limit(1)

    def edges_to_break(self) -> DataFrame:
        """(scc, size, source, target): one edge of each cycle, the least by id; smaller cycles first."""
        found = cut(self.cycles().select("scc", "size", "members"))
        ids = found.select("scc", "size", F.explode("members").alias("id"))
        inside = self.edges.join(ids.withColumnRenamed("id", "source"), "source").join(ids.select(F.col("scc").alias("s2"), F.col("id").alias("target")), "target").filter("scc = s2")
        first = inside.withColumn("r", F.row_number().over(Window.partitionBy("scc").orderBy("id"))).filter("r = 1")
        return first.select("scc", "size", "source", "target").orderBy("size", "scc")

    # --- statistics ---

    def stats(self) -> DataFrame:
        """(what, name, n): nodes and edges in all and by type."""
        parts = [self.nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.lit("").alias("name"), "n"), self.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit("").alias("name"), "n")]
        parts += [df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), F.col("type").alias("name"), "n") for w, df in (("node type", self.nodes), ("edge type", self.edges))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def degrees(self) -> DataFrame:
        """(id, degree): edges at each node; an edge to itself counts once."""
        ends = self.edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    def hotspots(self, least: int = 5) -> DataFrame:
        return self.edges.filter("type = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("calls")).filter(F.col("calls") >= least).orderBy(F.desc("calls"), "id")

    def orphans(self) -> DataFrame:
        """Nodes of the call graph that nothing calls."""
        calls = self.edges.filter("type = 'calls'")
        every = calls.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        return every.join(calls.select(F.col("target").alias("id")), "id", "left_anti")

    def induced(self, types: list[str] | None = None, most: int = 500) -> Graph:
        nodes = (self.nodes if types is None else self.nodes.filter(F.col("type").isin(*types))).orderBy("id").limit(most)
        return Graph(nodes, self.related_edges(nodes))

    # --- export ---

    def to_json(self) -> DataFrame:
        rows = lambda df: F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns)))), ",")
        n, e = self.nodes.agg(rows(self.nodes).alias("n")), self.edges.agg(rows(self.edges).alias("e"))
        return n.crossJoin(e).select(F.format_string('{"nodes":[%s],"edges":[%s]}', "n", "e").alias("json"))

    def to_dot(self) -> DataFrame:
        q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
        n = self.nodes.select(F.format_string("  %s [label=%s];", q(F.col("id")), q(F.col("name"))).alias("x"))
        e = self.edges.select(F.format_string("  %s -> %s [label=%s];", q(F.col("source")), q(F.col("target")), q(F.col("type"))).alias("x"))
        return _lines(n, e, "digraph G {", "}").withColumnRenamed("text", "dot")

    def to_mermaid(self) -> DataFrame:
        safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
        n = self.nodes.select(F.format_string('  %s["%s"]', safe(F.col("id")), F.regexp_replace("name", '"', "'")).alias("x"))
        e = self.edges.select(F.format_string("  %s -->|%s| %s", safe(F.col("source")), F.col("type"), safe(F.col("target"))).alias("x"))
        return _lines(n, e, "graph LR", "").withColumnRenamed("text", "mermaid")


def _lines(nodes: DataFrame, edges: DataFrame, head: str, foot: str) -> DataFrame:
    a, b = (df.agg(F.array_join(F.sort_array(F.collect_list("x")), "\n").alias(n)) for df, n in ((nodes, "a"), (edges, "b")))
    return a.crossJoin(b).select(F.concat_ws("\n", F.lit(head), F.nullif("a", F.lit("")), F.nullif("b", F.lit("")), F.nullif(F.lit(foot), F.lit(""))).alias("text"))


def _pairs(edges: DataFrame, direction: str) -> DataFrame:
    """(from, to) of each edge that may be followed."""
    out = edges.select(F.col("source").alias("from"), F.col("target").alias("to"))
    back = edges.select(F.col("target").alias("from"), F.col("source").alias("to"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


#: Hops of one job.
HOPS = 4


def khop(pairs: DataFrame, seeds: DataFrame, depth: int | None, stop: str | None = None) -> DataFrame:
    """(id, depth): breadth first from the seeds over (from, to). Each job follows HOPS edges from its frontier, keeping the
    least depth of each node, and leaves out what was reached before; what is new is written, and its deepest nodes are the
    next frontier. The plan grows by a table read for each job."""
    pairs = cut(pairs.filter(F.col("from") != F.col("to")).distinct())
    frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    reached, at = frontier, 0
    while depth is None or at < depth:
        hops = HOPS if depth is None else min(HOPS, depth - at)
        state = frontier.select("id", "depth")
        for _ in range(hops):
            here, there = F.struct("id", "depth"), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("id"), (F.col("depth") + 1).alias("depth")))
            stepped = state.join(pairs, F.col("id") == F.col("from"), "left").select(F.explode(F.array_compact(F.array(here, there))).alias("x"))
            state = stepped.groupBy("x.id").agg(F.min("x.depth").alias("depth"))
        at += hops
        new = cut(state.join(reached.select("id"), "id", "left_anti"))
        frontier = new.filter(F.col("depth") == at)
        reached = reached.unionByName(new)
        if frontier.isEmpty() or stop is not None and not new.filter(F.col("id") == stop).isEmpty():
            break
    return reached


def shortest_path(pairs: DataFrame, a: str, b: str, most: int = 10) -> DataFrame:
    spark, pairs = pairs.sparkSession, cut(pairs.filter(F.col("from") != F.col("to")).distinct())
    frontier = spark.createDataFrame([(a, [a])], "id string, path array<string>")
    reached = frontier.select("id")
    for _ in range(most + 1):
        hit = frontier.filter(F.col("id") == b)
        if not hit.isEmpty():
            return hit.orderBy("path").limit(1).select("path")
        new = pairs.join(frontier.withColumnRenamed("id", "from"), "from").select(F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        frontier = cut(new.join(reached, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.select("id"))
    return spark.createDataFrame([], "path array<string>")


#: With so many edges at most, one task finds the components.
LOCAL_EDGES = 200_000


def _tarjan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, scc) by depth-first search; each component is named by its least member."""
    following: dict[str, list[str]] = {}
    for f in frames:
        for a, b in zip(f["source"], f["target"]):
            following.setdefault(a, []).append(b)
            following.setdefault(b, [])
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(following):
        if root in index:
            continue
        path = [(root, iter(following[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while path:
            v, more = path[-1]
            for w in more:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    path.append((w, iter(following[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on.discard(members[-1])
                        if members[-1] == v:
                            break
                    out += [(m, min(members)) for m in members]
    yield pd.DataFrame(out, columns=["id", "scc"])


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, scc): strongly connected components, named by a member.

    Up to `local_edges` edges one task finds them by depth-first search. Beyond, by forward and backward colouring: in each
    round nodes without an edge in or out are taken out as components of their own; then the least id spreads forward along
    edges until nothing changes (colours); within each colour, the nodes from which its root can be reached backward are
    one component. They are taken out, and the rest goes round again.
    """
    edges = cut(edges.select("source", "target").distinct())
    if edges.limit(local_edges + 1).count() <= local_edges:
        found = edges.coalesce(1).mapInPandas(_tarjan, "id string, scc string")
        if nodes is None:
            return found
        return nodes.select("id").distinct().join(found, "id", "full_outer").select("id", F.coalesce("scc", "id").alias("scc"))
    left = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    every = left if nodes is None else left.unionByName(nodes.select("id")).distinct()
    done = None
    left = cut(left)
    while not left.isEmpty():
        while True:  # nodes without an edge in or out
            ends = edges.filter("source <> target")
            both = ends.select(F.col("source").alias("id")).intersect(ends.select(F.col("target").alias("id")))
            alone = cut(left.join(both, "id", "left_anti"))
            if alone.isEmpty():
                break
            alone_ = alone.select("id", F.col("id").alias("scc"))
            done = alone_ if done is None else done.unionByName(alone_)
            left = cut(left.join(alone, "id", "left_anti"))
            edges = cut(edges.join(left.withColumnRenamed("id", "source"), "source", "left_semi").join(left.withColumnRenamed("id", "target"), "target", "left_semi"))
        if left.isEmpty():
            break
        colours = cut(left.withColumn("colour", F.col("id")))
        while True:
            spread = edges.join(colours.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("new"))
            stepped = cut(colours.join(spread, "id", "left").select("id", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("changed")))
            colours = stepped.select("id", "colour")
            if stepped.filter("changed").isEmpty():
                break
        within = edges.join(colours.select(F.col("id").alias("source"), F.col("colour").alias("c1")), "source").join(colours.select(F.col("id").alias("target"), F.col("colour").alias("c2")), "target").filter("c1 = c2")
        roots = colours.filter("id = colour").select("id")
        found = khop(_pairs(within, "incoming"), roots, None).select("id").join(colours, "id").select("id", F.col("colour").alias("scc"))
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "id", "left_anti"))
        edges = cut(edges.join(left.withColumnRenamed("id", "source"), "source", "left_semi").join(left.withColumnRenamed("id", "target"), "target", "left_semi"))
    if done is None:
        return every.select("id", F.col("id").alias("scc"))
    return every.join(done, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def build(symbols: DataFrame, imports: DataFrame | None = None, calls: DataFrame | None = None, dependencies: DataFrame | None = None) -> Graph:
    """The graph of parse rows.

    symbols: file_path, name, kind, line, exported, parent, extends (list), implements (list). imports: file_path, source.
    calls: file_path, caller, callee. dependencies: from, to (files), giving file-to-file edges as well. Edges: a file defines
    its symbols and exports the exported ones; a parent contains its members; extends and implements, calls and references
    resolve a name first in the same file, then to the first of that name in path order, else to a placeholder.
    """
    s = symbols.withColumn("type", node_type(F.col("kind"))).withColumn("id", node_id(F.col("type"), F.col("file_path"), F.col("name"), F.col("line")))
    s = cut(s)
    files = s.select("file_path").distinct()
    if imports is not None:
        files = files.unionByName(imports.select("file_path")).distinct()
    node = lambda df, i, t, n, p, l=None, e=None: df.select(i.alias("id"), t.alias("type"), n.alias("name"), p.alias("file_path"), (F.lit(None).cast("int") if l is None else l).alias("line"), (F.lit(None).cast("boolean") if e is None else e).alias("exported"))  # noqa: E731, E741
    fid = F.concat(F.lit("file:"), F.col("file_path"))
    nodes = node(files, fid, F.lit("file"), F.col("file_path"), F.col("file_path")).unionByName(node(s, F.col("id"), F.col("type"), F.col("name"), F.col("file_path"), F.col("line").cast("int"), F.col("exported")))
    edge = lambda df, a, b, t: df.select(a.alias("source"), b.alias("target"), F.lit(t).alias("type"))
    edges = edge(s, fid, F.col("id"), "defines").unionByName(edge(s.filter("exported"), fid, F.col("id"), "exports"))
    parents = s.select("file_path", F.col("name").alias("parent"), F.col("id").alias("pid")).filter(F.col("type").isin("class", "interface"))
    edges = edges.unionByName(edge(s.filter("parent is not null").join(parents, ["file_path", "parent"]), F.col("pid"), F.col("id"), "contains"))
    wanted = []
    for kind in INHERITS:
        if kind in symbols.columns:
            wanted.append(s.select(F.col("id").alias("source"), "file_path", F.explode(kind).alias("name"), F.lit(kind).alias("type")))
    if calls is not None:
        caller = s.select("file_path", F.col("name").alias("caller"), F.col("id").alias("cid"))
        called = calls.join(caller, ["file_path", "caller"], "left").select(F.coalesce("cid", fid).alias("source"), "file_path", F.substring_index("callee", ".", -1).alias("name"), F.lit("calls").alias("type"))
        wanted.append(called)
    if wanted:
        names = wanted[0]
        for w in wanted[1:]:
            names = names.unionByName(w)
        resolved = cut(resolve(names, s))
        placeholders = resolved.filter("not known").select(F.concat(F.lit("type:"), F.col("name")).alias("id"), "name").distinct()
        nodes = nodes.unionByName(node(placeholders.withColumn("file_path", F.lit(None).cast("string")), F.col("id"), F.lit("type"), F.col("name"), F.col("file_path")))
        edges = edges.unionByName(resolved.select("source", "target", "type"))
    if imports is not None:
        mid = F.concat(F.lit("module:"), F.col("source"))
        nodes = nodes.unionByName(node(imports.select("source").distinct().withColumn("file_path", F.lit(None).cast("string")), mid, F.lit("module"), F.col("source"), F.col("file_path")))
        edges = edges.unionByName(edge(imports, fid, mid, "imports"))
    if dependencies is not None:
        edges = edges.unionByName(edge(dependencies, F.concat(F.lit("file:"), F.col("from")), F.concat(F.lit("file:"), F.col("to")), "imports"))
    edges = edges.distinct().withColumn("id", edge_id(F.col("source"), F.col("target"), F.col("type"))).select("id", "source", "target", "type")
    return Graph(nodes.dropDuplicates(["id"]), edges)


def resolve(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `target` and `known` to rows (file_path, name): the symbol of the same file, else the first of all, else a placeholder."""
    first = Window.partitionBy("file_path", "name").orderBy("line", "id")
    local = symbols.select("file_path", "name", "line", "id").withColumn("r", F.row_number().over(first)).filter("r = 1").select("file_path", "name", F.col("id").alias("near"))
    overall = Window.partitionBy("name").orderBy("file_path", "line", "id")
    anywhere = symbols.select("file_path", "name", "line", "id").withColumn("r", F.row_number().over(overall)).filter("r = 1").select("name", F.col("id").alias("far"))
    joined = names.join(local, ["file_path", "name"], "left").join(anywhere, "name", "left")
    return joined.withColumn("known", F.coalesce("near", "far").isNotNull()).withColumn("target", F.coalesce("near", "far", F.concat(F.lit("type:"), F.col("name")))).drop("near", "far")


# --- symbol tracking ---


def overrides(symbols: DataFrame) -> DataFrame:
    """(child, parent, method): a method that a class's first base has too."""
    classes = symbols.filter("kind = 'class'").select(F.col("name").alias("child"), F.try_element_at("extends", F.lit(1)).alias("parent")).filter("parent is not null")
    methods = symbols.filter("kind = 'method'").select(F.col("parent").alias("owner"), F.col("name").alias("method"))
    mine = classes.join(methods.withColumnRenamed("owner", "child"), "child")
    return mine.join(methods.withColumnRenamed("owner", "parent"), ["parent", "method"]).select("child", "parent", "method").distinct()


def instantiations(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return calls.join(symbols.filter("kind = 'class'").select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")


def base_type(c: Column) -> Column:
    """The type before its parameters."""
    return F.trim(F.substring_index(c, "<", 1))


def usage_stats(symbols: DataFrame, calls: DataFrame, type_refs: DataFrame) -> DataFrame:
    """(name, calls, type_uses, instantiations, files, dependents, dependencies): how each symbol is used. Dependents are
    symbols that call it, dependencies those that it calls. Both tables are read several times, and are written first: they
    may be made by parsing."""
    symbols, calls = cut(symbols.select("name", "kind").distinct()), cut(calls.select("file_path", "callee", "caller"))
    called = calls.select(F.substring_index("callee", ".", -1).alias("name"), "file_path", F.lit("calls").alias("w"))
    made = instantiations(calls, symbols).select(F.col("callee").alias("name"), "file_path", F.lit("instantiations").alias("w"))
    typed = type_refs.select(base_type(F.col("type_name")).alias("name"), "file_path", F.lit("type_uses").alias("w"))
    used = called.unionByName(made).unionByName(typed)
    counts = [F.count_if(F.col("w") == w).alias(w) for w in ("calls", "type_uses", "instantiations")]
    pair = calls.filter("caller is not null").select("caller", F.substring_index("callee", ".", -1).alias("callee")).filter("caller <> callee")
    into = pair.groupBy(F.col("callee").alias("name")).agg(F.countDistinct("caller").alias("dependents"))
    out = pair.groupBy(F.col("caller").alias("name")).agg(F.countDistinct("callee").alias("dependencies"))
    rows = symbols.select("name").distinct().join(used.groupBy("name").agg(*counts, F.countDistinct("file_path").alias("files")), "name", "left")
    return rows.join(into, "name", "left").join(out, "name", "left").fillna(0)


def call_graph(calls: DataFrame) -> DataFrame:
    """(name, callers, callees): by simple names."""
    pair = calls.filter("caller is not null").select("caller", F.substring_index("callee", ".", -1).alias("callee")).distinct()
    into = pair.groupBy(F.col("callee").alias("name")).agg(F.sort_array(F.collect_set("caller")).alias("callers"))
    out = pair.groupBy(F.col("caller").alias("name")).agg(F.sort_array(F.collect_set("callee")).alias("callees"))
    none = F.array().cast("array<string>")
    return into.join(out, "name", "full_outer").select("name", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def type_users(type_refs: DataFrame, name: str) -> DataFrame:
    """(file_path, line): where a type is used, its parameters left aside."""
    return type_refs.filter(base_type(F.col("type_name")) == name).select("file_path", "line").distinct()
