"""Closure evidence on small inputs with known answers, and how many rows it makes of a hot asset."""

from datetime import datetime, timedelta, timezone

from ledgerline.operators.closure import closure_evidence

ASSET = "asset_id string, required_aliases array<string>, target_id string, policy_id string, alias_bindings map<string,string>, binding_changed_at timestamp"
FINDING = "finding_id string, asset_id string, remediation_at timestamp"
OBSERVATION = "asset_id string, alias_id string, observed_at timestamp, access string, content string, capture_complete boolean, expected_policy boolean, control_healthy boolean, evidence_ref string, policy_evidence_ref string, control_evidence_ref string, reason_code string, target_id string, policy_id string"


def at(minutes):
    return datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minutes)


def seen(asset, alias, minutes, target, access="ACCESS_DENIED_OBSERVED"):
    return asset, alias, at(minutes), access, "PUBLIC_UI", True, True, True, "e", "p", "c", None, target, "pol"


def evidence(spark, findings, assets, observations):
    return closure_evidence(spark.createDataFrame(findings, FINDING), spark.createDataFrame(assets, ASSET), spark.createDataFrame(observations, OBSERVATION))


def most_rows(df):
    """The most rows that any step of the plan gave, once df was collected."""

    def walk(p):
        inner = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan() if p.nodeName().endswith("QueryStage") else None
        below = [p.children().apply(i) for i in range(p.children().size())] if inner is None else [inner]
        own = p.metrics().apply("numOutputRows").value() if p.metrics().contains("numOutputRows") else 0
        return max([own, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_hot_asset_makes_no_pairs(spark):
    findings = [(f"f{i}", "hot", at(i)) for i in range(300)]
    df = evidence(spark, findings, [("hot", [], "t", "pol", {}, None)], [seen("hot", None, 100 + i // 2, "t") for i in range(400)])
    assert {r.finding_id: (r.required, r.observed, r.conflicting, r.proven) for r in df.collect()} == {f"f{i}": (1, int(i < 299), 0, i < 299) for i in range(300)}
    assert 300 <= most_rows(df) <= 700  # 79,800 when findings met observations


def test_latest_of_each_key_after_the_floor(spark):
    assets = [("a", ["x", None], "t", "pol", {"x": "u"}, at(5)), ("b", None, "t", "pol", None, None)]
    findings = [("early", "a", at(1)), ("bound", "a", at(6)), ("late", "a", at(20)), ("both", "a", at(1)), ("both", " B ", at(1)), (None, "b", at(1)), ("open", "b", None), ("lost", "c", at(1))]
    observations = [seen("a", None, 3, "t", "BODY_SERVED"), seen("a", None, 9, "t"), seen("a", None, 9, "t"), seen("a", "x", 9, "u"), seen("b", None, 9, "t", "NOT_FOUND_OBSERVED"), seen("a", "y", 30, "t"), seen(None, None, 30, "t")]
    got = {r.finding_id: (r.required, r.observed, r.conflicting, r.proven) for r in evidence(spark, findings, assets, observations).collect()}
    assert got == {"early": (2, 2, 0, True), "bound": (2, 2, 0, True), "late": (2, 0, 0, False), "both": (3, 2, 1, False), None: (1, 0, 0, False)}
