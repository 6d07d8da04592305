"""Graph operators: reachability, fixpoints, call graphs, alias chains, exports.

Graphs of one file are small and are walked in one call per file. Graphs of the whole corpus are
walked by frontier joins, one round a step, each round cut to the shared folder.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import cut, shuffled
from sieveflow.sources import code

from .components import strong_components, weak_components

__all__ = ["strong_components", "weak_components"]

#: Rounds after which what a walk has seen is written as one table.
ROUNDS_A_CUT = 16


# Corpus-wide


def reach(edges: DataFrame, start: DataFrame, blocked: DataFrame | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """node, depth of all nodes reached from ``start`` (node) over edges (src, dst), start included; nodes in ``blocked`` are never entered.

    With columns ``key`` in ``start``, a walk for each of their values, all in the same rounds.

    Edges may repeat: a round tells its nodes apart, so all edges are never gathered in tasks for that.
    """
    at = [*key, "node"]
    if blocked is not None:
        blocked = cut(blocked.select("node").distinct(), "blocked")
    entered = lambda nodes: nodes if blocked is None else nodes.join(blocked, "node", "left_anti")
    links = cut(edges.select("src", "dst"), "links")  # made once, not in each round
    seen = cut(entered(start.select(*at).distinct()).select(*at, F.lit(0).alias("depth")), "reach")
    frontier = seen
    for depth in itertools.count(1):
        ahead = frontier.join(links, frontier.node == links.src).select(*key, F.col("dst").alias("node")).distinct()
        frontier = cut(entered(ahead.join(seen, at, "left_anti")).select(*at, F.lit(depth).alias("depth")), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % ROUNDS_A_CUT == 0:
            seen = cut(seen, "reach")


def grow(seen: DataFrame, links: DataFrame, new: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """``seen`` (key, node), all that was reached so far, with what edges ``new`` (src, dst) add to it; ``links`` are all edges, the new ones too.

    The walk begins at the ends of new edges that leave what is seen, so it costs what it adds.
    """
    at = [*key, "node"]
    links = cut(links.select("src", "dst").distinct(), "links")
    parts, ahead = [seen.select(*at)], cut(new.select("src", "dst").distinct(), "links")
    frontier = seen
    while True:
        found = frontier.join(ahead, frontier.node == ahead.src).select(*key, F.col("dst").alias("node")).distinct()
        for p in parts:
            found = found.join(p, at, "left_anti")
        frontier = cut(found, "reach")
        if frontier.isEmpty():
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        parts.append(frontier)
        ahead = links
        if len(parts) > ROUNDS_A_CUT:
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            parts = [cut(every, "reach")]


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, made in one pass; what repeats, or has its reverse there, comes again."""
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.inline(F.array(F.struct("src", "dst"), back)))


def has_flow(call_edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> bool:
    """Whether the undirected call graph joins a source to a sink; a source that is a sink does."""
    return not reach(undirected(call_edges), sources).join(sinks.select("node"), "node", "left_semi").isEmpty()


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Least fixpoint of "src is marked if a dst of it is": the marked nodes. Callers of a tainted return return taint."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds).select("node")


def resolve_aliases(aliases: DataFrame, max_rounds: int = 64) -> DataFrame:
    """name, root of rows (name, alias_of): the end of each chain; in a cycle, the least name of it. Doubles the step each round."""
    now = cut(aliases.where("alias_of is not null").groupBy("name").agg(F.min("alias_of").alias("to")), "aliases")
    least = now.select("name", "to", F.least("name", "to").alias("low"))
    for _ in range(max_rounds):
        nxt = least.select(F.col("name").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        j = least.join(nxt, "to", "left")
        new = cut(j.select("name", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("next_low", "low")).alias("low")), "aliases")
        if new.join(least, ["name", "to"], "left_anti").isEmpty() or _ > 40:
            break
        least = new
    ends = new.select(F.col("name").alias("n"))
    # What still points at a name with an alias is in, or leads into, a cycle.
    return new.join(ends, F.col("to") == F.col("n"), "left").select("name", F.when(F.col("n").isNull(), F.col("to")).otherwise(F.col("low")).alias("root")).distinct()


def function_taints(rows: DataFrame) -> DataFrame:
    """name, tainted_args, tainted_return from rows (name, arg, ret): union of arguments, any return."""
    args = F.array_sort(F.collect_set("arg"))
    return rows.groupBy("name").agg(args.alias("tainted_args"), F.coalesce(F.bool_or("ret"), F.lit(False)).alias("tainted_return"))


def branch_merge(states: DataFrame, branches: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """A symbol after a branching: sanitised only if it is there and sanitised in all arms; two or more definitions make a merge.

    ``states``: keys, name, branch, sanitized, def. ``branches``: keys, n_branches.
    """
    g = states.groupBy(*keys, name).agg(F.bool_and("sanitized").alias("all"), F.countDistinct("branch").alias("n"), F.array_sort(F.collect_set("def")).alias("defs"))
    j = g.join(shuffled(branches), keys)
    return j.select(*keys, name, (F.col("all") & (F.col("n") == F.col("n_branches"))).alias("sanitized"), "defs", (F.size("defs") >= 2).alias("merged"))


def call_edges(ast_nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """src, dst names of all calls of the corpus; see :func:`file_call_edges`."""
    return file_call_edges(ast_nodes, lines).select("src", "dst").distinct()


def file_call_edges(ast_nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """file_path, src, dst: each call under its nearest enclosing function, the callee read from the call's line after its first ``=``."""
    from .calls import enclosing_functions

    near = enclosing_functions(ast_nodes).select("file_path", "line", F.col("caller").alias("src")).where("src is not null").distinct()
    text = F.regexp_replace("text", r"^[^=]*=(?!=)", "")
    j = near.join(shuffled(lines.select("file_path", "line", "text")), ["file_path", "line"])
    callee = F.regexp_extract(text, r"([A-Za-z_][\w.:]*)\s*\(", 1)
    return j.select("file_path", "src", callee.alias("dst")).where("src is not null and dst != ''").distinct()


def calls_in(files: DataFrame) -> DataFrame:
    """:func:`file_call_edges` of files that are parsed for it where they are: nothing is gathered or joined by file."""
    from .calls import callers, marks_of

    left, name, ends = re.compile(r"^[^=]*=(?!=)"), re.compile(r"([A-Za-z_][\w.:]*)\s*\(", re.A), re.compile(r"\r?\n")

    def rows(p: code.Program, source: str) -> list[tuple]:
        near = {(c["line"], c["caller"]) for c in callers(marks_of(p)) if c["caller"] is not None}
        lines = ends.split(source)
        told = ((caller, name.search(left.sub("", lines[line - 1]))) for line, caller in near if line <= len(lines))
        return [(p.path, *x) for x in sorted({(caller, m[1]) for caller, m in told if m})]

    return code.table_of(files, rows, "file_path string, src string, dst string", ("tree",), with_source=True)


def call_graph_analysis(edges: DataFrame) -> DataFrame:
    """name, calls, called_by, entry, leaf, depth (steps from an entry; null in what only cycles reach), in_cycle."""
    e = cut(edges.select("src", "dst").distinct(), "calls")
    names = e.select(F.col("src").alias("name")).unionByName(e.select(F.col("dst").alias("name"))).distinct()
    out = e.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    into = e.groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("called_by"))
    none = F.array().cast("array<string>")
    t = names.join(shuffled(out), "name", "left").join(shuffled(into), "name", "left").select("name", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))
    depth = reach(e, t.where("size(called_by) = 0").select(F.col("name").alias("node"))).select(F.col("node").alias("name"), "depth")
    cyclic = strong_components(e).select(F.col("node").alias("name"), F.lit(True).alias("c"))
    t = t.join(shuffled(depth), "name", "left").join(shuffled(cyclic), "name", "left")
    return t.select("name", "calls", "called_by", (F.size("called_by") == 0).alias("entry"), (F.size("calls") == 0).alias("leaf"), "depth", F.coalesce("c", F.lit(False)).alias("in_cycle"))


def complexity(analysis: DataFrame) -> DataFrame:
    """One row: functions, edges, max_depth, edges per function."""
    return analysis.agg(
        F.count("*").alias("functions"), F.sum(F.size("calls")).cast("long").alias("edges"), F.max("depth").alias("max_depth"),
        (F.sum(F.size("calls")) / F.count("*")).alias("edges_per_function"),
    )


# Of one file


def taint_path(nodes: list[dict], edges: list[tuple[int, int]], clean: set[str]) -> list[int] | None:
    """Ids along a shortest way from a definition without predecessors to a use, past no sanitised name; None if there is none."""
    by_id = {n["id"]: n for n in nodes}
    ahead: dict[int, list[int]] = {}
    entered = set()
    for a, b in edges:
        if a in by_id and b in by_id:
            ahead.setdefault(a, []).append(b)
            entered.add(b)
    starts = [n["id"] for n in nodes if n["kind"] == "Def" and n["id"] not in entered and n["name"] not in clean]
    came: dict[int, int | None] = dict.fromkeys(starts)
    queue = deque(starts)
    while queue:
        at = queue.popleft()
        if by_id[at]["kind"] == "Use" and by_id[at]["name"] not in clean:
            path = [at]
            while (at := came[at]) is not None:
                path.append(at)
            return path[::-1]
        for b in ahead.get(at, ()):
            if b not in came and by_id[b]["name"] not in clean:
                came[b] = at
                queue.append(b)
    return None


def reaches_any(nodes: list[dict], edges: list[tuple[int, int]], start: int | None, names: set[str]) -> bool:
    """Whether a node with one of the names can be reached from a definition."""
    by_id = {n["id"]: n["name"] for n in nodes}
    ahead: dict[int, list[int]] = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    seen, queue = {start}, deque([start])
    while queue:
        at = queue.popleft()
        if by_id.get(at) in names:
            return True
        for b in ahead.get(at, ()):
            if b not in seen:
                seen.add(b)
                queue.append(b)
    return False


def leads(names: dict[int, str], edges: list[tuple[int, int]], symbols: list[tuple[str, int]]) -> set[tuple[str, str]]:
    """(sym, var): the names of a file's nodes that a symbol's definition leads to."""
    ahead: dict[int, list[int]] = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    found = set()
    for sym, start in symbols:
        seen, queue = {start}, deque([start])
        while queue:
            for d in ahead.get(queue.popleft(), ()):
                if d not in seen:
                    seen.add(d)
                    queue.append(d)
        found |= {(sym.lstrip("$"), names[i].lstrip("$")) for i in seen if i in names}
    return found


def file_flows(files: DataFrame) -> DataFrame:
    """file_path, clean (sanitised names), tainted (whether it has a :func:`taint_path`), leads ((sym, var) of PHP files; see :func:`leads`).

    A file is parsed once for all of them and its graph is walked where it is, so nothing is gathered by file.
    """

    def rows(p: code.Program) -> list[tuple]:
        nodes = [{"id": i, "name": x[0], "kind": x[1]} for i, x in sorted(p.flow.items())]
        flow = sorted((a, b) for a, b, kind in p.edges if kind == "flow")
        clean = {s.name for s in p.symbols.values() if s.sanitized}
        to = sorted(leads({n["id"]: n["name"] for n in nodes}, flow, [(s.name, s.defined) for s in p.symbols.values() if s.defined is not None])) if p.language == "php" else []
        return [(p.path, sorted(clean), taint_path(nodes, flow, clean) is not None, [{"sym": a, "var": b} for a, b in to])]

    return code.table_of(files, rows, "file_path string, clean array<string>, tainted boolean, leads array<struct<sym:string,var:string>>", ("flow",))


def taint_paths(dfg_nodes: DataFrame, dfg_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, path (ids): a tainted way of each file that has one. A file's graph is gathered in one row."""
    n = dfg_nodes.groupBy("file_path").agg(F.collect_list(F.struct("id", "name", "kind")).alias("nodes"))
    e = dfg_edges.where("edge_type = 'flow'").groupBy("file_path").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    s = symbols.where("sanitized").groupBy("file_path").agg(F.collect_set("name").alias("clean"))
    g = n.join(shuffled(e), "file_path", "left").join(shuffled(s), "file_path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, nodes, edges, clean in zip(b.file_path, b.nodes, b.edges, b.clean, strict=True):
                nodes = sorted((dict(x) for x in nodes), key=lambda x: x["id"])
                pairs = sorted((x["src"], x["dst"]) for x in (edges if edges is not None else ()))
                if path := taint_path(nodes, pairs, set(clean if clean is not None else ())):
                    rows.append((file, path))
            yield pd.DataFrame(rows, columns=["file_path", "path"])

    return g.mapInPandas(run, "file_path string, path array<long>")


def flows_to_names(dfg_nodes: DataFrame, dfg_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, sym, var: the names that a symbol's definition leads to, in each file."""
    n = dfg_nodes.groupBy("file_path").agg(F.collect_list(F.struct("id", "name")).alias("nodes"))
    e = dfg_edges.where("edge_type = 'flow'").groupBy("file_path").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    s = symbols.where("def is not null").groupBy("file_path").agg(F.collect_list(F.struct("name", "def")).alias("syms"))
    g = n.join(shuffled(s), "file_path").join(shuffled(e), "file_path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, nodes, syms, edges in zip(b.file_path, b.nodes, b.syms, b.edges, strict=True):
                pairs = [(x["src"], x["dst"]) for x in edges] if edges is not None else []
                rows += [(file, *x) for x in leads({x["id"]: x["name"] for x in nodes}, pairs, [(s["name"], s["def"]) for s in syms])]
            yield pd.DataFrame(rows, columns=["file_path", "sym", "var"])

    return g.mapInPandas(run, "file_path string, sym string, var string")


def link_nodes(dfg_nodes: DataFrame, dfg_edges: DataFrame, source: str, target: str) -> DataFrame:
    """``dfg_edges`` with an edge from every node named ``source`` to every one named ``target`` of its file."""
    a = dfg_nodes.where(F.col("name") == source).select("file_path", F.col("id").alias("src"))
    b = dfg_nodes.where(F.col("name") == target).select("file_path", F.col("id").alias("dst"))
    return dfg_edges.unionByName(a.join(shuffled(b), "file_path").withColumn("edge_type", F.lit("flow"))).distinct()


def mark_sanitised(df: DataFrame, name: str) -> DataFrame:
    """Nodes or symbols with those of a name sanitised."""
    return df.withColumn("sanitized", F.when(F.col("name") == name, True).otherwise(F.col("sanitized")))


def sanitise_aliases(symbols: DataFrame) -> DataFrame:
    """``symbols`` in which what an alias chain ties to a sanitised name is sanitised."""
    q = lambda c: F.concat_ws("\0", "file_path", c)
    edges = symbols.where("alias_of is not null").select(q("alias_of").alias("src"), q("name").alias("dst"))
    clean = reach(edges, symbols.where("sanitized").select(q("name").alias("node"))).select(F.col("node").alias("k"), F.lit(True).alias("c"))
    j = symbols.withColumn("k", q("name")).join(shuffled(clean), "k", "left")
    return j.select(*[F.coalesce("c", "sanitized").alias(c) if c == "sanitized" else F.col(c) for c in symbols.columns])


# Exports


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_path, text: a digraph of each file from nodes (file_path, id, label) and edges (file_path, src, dst)."""
    quoted = F.concat(F.lit('"'), F.regexp_replace("label", r'(["\\])', r"\\$1"), F.lit('"'))
    n = nodes.select("file_path", F.struct(F.lit(0).alias("k"), F.col("id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string("  %d [label=%s];", F.col("id").cast("long"), quoted).alias("t")).alias("x"))
    e = edges.select("file_path", F.struct(F.lit(1).alias("k"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.format_string("  %d -> %d;", F.col("src").cast("long"), F.col("dst").cast("long")).alias("t")).alias("x"))
    return _joined(n.unionByName(e), "digraph {\n", "\n}")


def to_mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    label = F.regexp_replace("label", '"', "#quot;")
    n = nodes.select("file_path", F.struct(F.lit(0).alias("k"), F.col("id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string('  n%d["%s"]', F.col("id").cast("long"), label).alias("t")).alias("x"))
    e = edges.select("file_path", F.struct(F.lit(1).alias("k"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.format_string("  n%d --> n%d", F.col("src").cast("long"), F.col("dst").cast("long")).alias("t")).alias("x"))
    return _joined(n.unionByName(e), "graph TD\n", "")


def _joined(rows: DataFrame, head: str, tail: str) -> DataFrame:
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n")
    return rows.groupBy("file_path").agg(F.concat(F.lit(head), lines, F.lit(tail)).alias("text"))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_path, text: ``{"nodes": [...], "edges": [[src, dst], ...]}`` of each file."""
    n = nodes.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct(*[c for c in nodes.columns if c != "file_path"]))).alias("nodes"))
    e = edges.groupBy("file_path").agg(F.array_sort(F.collect_list(F.array(F.col("src").cast("long"), F.col("dst").cast("long")))).alias("edges"))
    return n.join(shuffled(e), "file_path", "left").select("file_path", F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast("array<array<bigint>>")).alias("edges"))).alias("text"))


def to_tree(ast_nodes: DataFrame) -> DataFrame:
    """file_path, text: an indented line for each tree node in pre-order (depth from the intervals)."""
    above = ast_nodes.select(F.col("file_path").alias("f"), F.col("lo").alias("l"), F.col("hi").alias("h"))
    on = (F.col("file_path") == F.col("f")) & (F.col("l") < F.col("lo")) & (F.col("h") >= F.col("hi"))
    deep = ast_nodes.join(shuffled(above), on, "left").groupBy("file_path", "lo", "kind", "value").agg(F.count("l").cast("int").alias("depth"))
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("kind"), F.coalesce(F.concat(F.lit(" "), F.col("value")), F.lit("")))
    rows = deep.select("file_path", F.struct("lo", text.alias("t")).alias("x"))
    return _joined(rows, "", "")
