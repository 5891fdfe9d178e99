"""Asset graphs from inventory and discovery records, and bounded traversal of links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerline.sources.shared import counted, materialize

KEY = ["scope_id", "source_id", "source_record_id"]
CONTENT = ["source_kind", "locator_ref", "asset_id", "alias_id", "relationship", "ownership_evidence", "coverage_state", "existence_state", "business_relevance", "publication_approval"]


def _digest(columns: list[str]):
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def kept_records(records: DataFrame) -> DataFrame:
    """The first record of each key (by `ordinal`) and how many later ones differ from it.

    Both come from aggregations that are combined on the map side: the first record, and counts per (key, digest).
    """
    rows = records.withColumn("digest", _digest(CONTENT))
    per = rows.groupBy(*KEY, "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ordinal", *CONTENT)).alias("first"))
    return per.groupBy(*KEY).agg(F.min("first").alias("first"), F.sum("n").alias("total"), F.min_by("n", "first").alias("same")).select(*KEY, "first.*", (F.col("total") - F.col("same")).alias("conflicts"))


def nodes(kept: DataFrame) -> DataFrame:
    """One node per (scope_id, locator_ref) with its ownership, existence, relevance and approval.

    Its assets are counted; node_assets() has them as rows, as a node may have any number.
    """
    owner = (F.col("source_kind") == "owner_inventory") & F.col("ownership_evidence").isNotNull()
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return kept.groupBy("scope_id", "locator_ref").agg(
        F.when(any_(F.col("conflicts") > 0), "disputed").when(any_(owner), "evidence_linked").otherwise("ownership_pending").alias("ownership_state"),
        F.when(any_(F.col("existence_state") == "observed"), "observed").otherwise("candidate").alias("existence_state"),
        F.when(any_(F.col("business_relevance") == "related"), "related").when(any_(F.col("business_relevance") == "low"), "low").otherwise("unknown").alias("business_relevance"),
        F.when(any_(owner & (F.col("publication_approval") == "approved")), "approved").otherwise("unknown").alias("publication_approval"),
        F.count_distinct("asset_id").alias("n_assets"),
        F.count(F.lit(1)).alias("source_record_count"),
        any_(F.col("source_kind") == "public_discovery").alias("discovered"),
        any_(owner).alias("owned"),
    )


def node_assets(kept: DataFrame) -> DataFrame:
    """scope_id, locator_ref, asset_id: the assets of every node, once each."""
    return kept.where("asset_id is not null").select("scope_id", "locator_ref", "asset_id").distinct()


def links(kept: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """One link per kept record: disputed by its own key, else the node's state for evidence, else a candidate."""
    owner = (F.col("source_kind") == "owner_inventory") & F.col("ownership_evidence").isNotNull()
    state = F.when(F.col("conflicts") > 0, "disputed").when(owner, F.col("ownership_state")).otherwise("candidate_signal")
    return kept.join(graph_nodes.select("scope_id", "locator_ref", "ownership_state"), ["scope_id", "locator_ref"]).select(*KEY, "locator_ref", state.alias("link_state"))


def gaps(kept: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """Records that are not complete, and discovered nodes without evidence of an owner."""
    a = kept.where("coverage_state <> 'complete'").select("scope_id", F.concat_ws("/", "source_id", "source_record_id").alias("ref"), "coverage_state")
    return a.unionByName(graph_nodes.where("discovered and not owned").select("scope_id", F.col("locator_ref").alias("ref"), F.lit("ownership_evidence_missing").alias("coverage_state")))


def reach(edges: DataFrame, roots: DataFrame, depth: int, requests: int | None = None) -> DataFrame:
    """Nodes within `depth` links of the roots and their least distance: node, distance.

    edges: source, target, and redirect (boolean, may be missing): a redirect leads on without adding to the distance.
    roots: node. With `requests` only the first so many nodes are passed, by distance and then by node; as nodes are
    passed in this order, what comes behind the last one is never reached. Each round joins only the new frontier and
    takes out what was seen, so every node is passed once, loops included; rounds are written to the shared folder. A
    node that very many links leave or enter is no hot task: targets are made distinct with map-side combination, AQE
    splits the join.
    """
    jumps = edges.where("redirect") if "redirect" in edges.columns else None
    links = edges.where("not coalesce(redirect, false)") if jumps is not None else edges
    found: list[DataFrame] = []
    new = roots.select("node").where("node is not null").distinct()
    for step in range(depth + 1):
        here: list[DataFrame] = []
        while True:  # what redirects lead to is as far as what they come from
            if found:
                new = new.join(reduce(DataFrame.unionByName, found).select("node"), "node", "left_anti")
            level = materialize(new.withColumn("distance", F.lit(step).cast("bigint")), n="count(1)")
            found.append(level)
            here.append(level)
            if jumps is None or not counted(level)["n"]:
                break
            new = jumps.join(level, jumps["source"] == level["node"]).select(F.col("target").alias("node")).where("node is not null").distinct()
        frontier = reduce(DataFrame.unionByName, here)
        total = sum(counted(t)["n"] for t in found)
        if not sum(counted(t)["n"] for t in here) or requests is not None and total >= requests:
            break
        new = links.join(frontier, links["source"] == frontier["node"]).select(F.col("target").alias("node")).where("node is not null").distinct()
    out = reduce(DataFrame.unionByName, found)
    return out if requests is None else out.orderBy("distance", "node").limit(requests)
