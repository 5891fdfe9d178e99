"""Parent-child links to full hierarchies (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.bitmap import maybe_in
from ledgerline.functions.ids import heavy_keys, norm_id, skew_join
from ledgerline.operators.references import latest_jobs
from ledgerline.sources.shared import counted, discard, materialize, together

#: Taken while a round is written: nodes that it finished, nodes that go on.
COUNTS = {"finished": "count_if(fresh and pointer is null)", "active": "count(pointer)"}


def _jump(active: DataFrame, known: DataFrame, n_active: int) -> DataFrame:
    """Each active node beside what its pointer has jumped over so far; a pointer of many nodes is salted."""
    return skew_join(active, known, "pointer", "k_node", heavy_keys(active, ["pointer"], n_active), "inner")


def _round(state: DataFrame, n_active: int, n_first: int) -> DataFrame:
    """One doubling: active nodes take over the pointer, the depth and the path of the node they point at.

    state: node, pointer, depth, path, fresh. Nodes that are finished (no pointer) are kept, no longer fresh, as long
    as an active node points at them: only these can be pointed at in the next round, as a pointer is taken over from
    an active node. State shrinks with the nodes that go on. n_first sizes the filter in every round, so the plan, and
    with it the generated code, stays the same.
    """
    active = state.where("pointer is not null")
    known = maybe_in(state, "node", active, "pointer", n_first).select(*[F.col(c).alias("k_" + c) for c in ("node", "pointer", "depth", "path")])
    moved = _jump(active, known, n_active).select("node", F.col("k_pointer").alias("pointer"), (F.col("depth") + F.col("k_depth")).alias("depth"), F.concat("k_path", "path").alias("path"), F.lit(True).alias("fresh"))
    kept = known.where("k_pointer is null").select(F.col("k_node").alias("node"), F.col("k_pointer").alias("pointer"), F.col("k_depth").alias("depth"), F.col("k_path").alias("path"), F.lit(False).alias("fresh"))
    return moved.unionByName(kept)


def _resolve(state: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Pointer doubling until every node of a tree has its path; returns the rounds' tables and the last state if it never ends.

    state: a materialized table with COUNTS. A round is one join, written with its counts.
    """
    rounds, n_first = [state], counted(state)["active"]
    while counted(state)["active"]:
        new = materialize(_round(state, counted(state)["active"], n_first), **COUNTS)
        if not counted(new)["finished"]:
            discard(new)
            return rounds, state
        rounds.append(new)
        state = new
    return rounds, None


def _finished(rounds: list[DataFrame], kind: str) -> DataFrame:
    return together(rounds).where("fresh and pointer is null").select("node", F.lit(kind).alias("node_kind"), F.col("path")[0].alias("root"), F.col("depth").alias("node_depth"), "path")


def hierarchy(edges: DataFrame) -> DataFrame:
    """Path, depth, root and kind of every node: node, node_kind, root, node_depth, path (array of nodes, root first).

    edges: node, parent, one row per node; a parent that is null or no node counts as none. Pointer doubling: in each
    round every unfinished node takes over the pointer, the depth and the path of the node it points at, so after k
    rounds 2^k links are passed. A round that finishes no node shows that all others never reach a root: they are in
    or behind loops. Their pointers are doubled on, without paths, until the set pointed at stops shrinking; that set
    is the loops. The nodes behind them get their paths by a second doubling that takes loop nodes as roots.

    node_kind is `tree`, `cycle` (node is its own ancestor; its path is itself) or `below` (behind a loop; the path
    starts at the nearest loop node). Nodes may hold any text. Rows without a node are left out; an empty input gives
    no rows; extra columns are ignored. A third of all nodes may share one parent.
    """
    edges = materialize(edges.select("node", "parent").where("node is not null"), n="count(1)")
    nodes = edges.select(F.col("node").alias("p_node"))
    heavy = heavy_keys(edges.where("parent is not null"), ["parent"], counted(edges)["n"])
    return climb(skew_join(edges, nodes, "parent", "p_node", heavy, "left").select("node", F.col("p_node").alias("parent")))


def climb(links: DataFrame) -> DataFrame:
    """hierarchy() of links whose parents are all nodes; it reads the tables of its rounds, which clean_up() deletes."""
    depth = F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint")
    start = materialize(links.select("node", F.col("parent").alias("pointer"), depth.alias("depth"), F.array("node").alias("path"), F.lit(True).alias("fresh")), **COUNTS)
    rounds, stuck = _resolve(start)
    out = _finished(rounds, "tree")
    if stuck is not None:
        n, endless = counted(stuck)["active"], stuck.where("pointer is not null").select("node", "pointer")
        hops, size, before = materialize(endless), None, None
        while size is None or size != before:
            before, old = size, hops
            hops = materialize(_jump(old, old.select(F.col("node").alias("k_node"), F.col("pointer").alias("k_pointer")), n).select("node", F.col("k_pointer").alias("pointer")))
            discard(old)
            size = hops.select("pointer").distinct().count()
        loops = materialize(hops.select(F.col("pointer").alias("loop_node")).distinct())
        cycle = loops.select(F.col("loop_node").alias("node"), F.lit("cycle").alias("node_kind"), F.col("loop_node").alias("root"), F.lit(0).cast("bigint").alias("node_depth"), F.array("loop_node").alias("path"))
        left = start.join(endless.select("node"), "node", "left_semi").join(loops, F.col("node") == F.col("loop_node"), "left")
        inside = F.col("loop_node").isNotNull()
        behind, _ = _resolve(materialize(left.select("node", F.when(~inside, F.col("pointer")).alias("pointer"), F.when(inside, 0).otherwise(1).cast("bigint").alias("depth"), "path", "fresh"), **COUNTS))
        discard(hops)
        out = out.unionByName(cycle).unionByName(_finished(behind, "below").where("node_depth > 0"))
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, node, distance) pairs of hierarchy()'s `tree` and `below` nodes; as many rows as depths add up to."""
    parts = tree.where("node_kind <> 'cycle'").select("node", "node_depth", F.posexplode("path").alias("at", "ancestor"))
    return parts.where("at < node_depth").select("ancestor", "node", (F.col("node_depth") - F.col("at")).alias("distance"))


def descendant_counts(tree: DataFrame) -> DataFrame:
    """Number of descendants of every node that has any, and the depth of what is under it."""
    return descendants(tree).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


def audit_links(jobs: DataFrame) -> DataFrame:
    """node, parent of the jobs of audit_jobs; a parent that has no row or is in another case counts as none."""
    current = latest_jobs(jobs, "case_id", "parent_job_id")
    current = materialize(current.select("job_id", F.coalesce(norm_id("case_id"), F.lit("")).alias("case_key"), norm_id("parent_job_id").alias("parent")), n="count(1)")
    of = current.select(F.col("job_id").alias("o_job"), F.col("case_key").alias("o_case"))
    heavy = heavy_keys(current.where("parent is not null"), ["parent"], counted(current)["n"])
    return skew_join(current, of, "parent", "o_job", heavy, "left").select(F.col("job_id").alias("node"), F.when(F.col("o_case") == F.col("case_key"), F.col("parent")).alias("parent"))


def audit_hierarchy(jobs: DataFrame) -> DataFrame:
    """Hierarchy of the jobs of audit_jobs; the path is text, joined with `/` at the end."""
    return climb(audit_links(jobs)).select(F.col("node").alias("job_id"), "node_kind", F.col("root").alias("root_job_id"), "node_depth", F.array_join("path", "/").alias("job_path"))
