import pytest

from termloom.plans import flow, functions  # noqa: F401
from termloom.plans.roles import Dataset, FlowError, resolve_roles


def test_roles():
    assert resolve_roles(["sctid", "preferred_term", "ko_reference"]) == {"sctid": "sctid", "en": "preferred_term"}
    assert resolve_roles(["EN", "KO", "source"], {"en": "en_term", "target": "target_term"}) == {"en": "EN", "target": "KO"}
    assert resolve_roles(None, {"en": "x"}) == {"en": "x"}
    assert resolve_roles(["my", "ko"], {"target": "my"})["target"] == "my"


def test_thirteen_functions():
    assert len([n for n in flow.names() if n != "datasource"]) == 13


def test_order_and_errors():
    n = lambda i, **w: flow.Node(i, "x", {}, w)
    assert [x.id for x in flow.order([n("b", p="a"), n("a")])] == ["a", "b"]
    with pytest.raises(FlowError, match="cycle"):
        flow.order([n("a", p="b"), n("b", p="a")])
    with pytest.raises(FlowError, match="unknown"):
        flow.order([n("a", p="z")])


def _flow(spark, **evaluate):
    rows = spark.createDataFrame([("1", "Heart", "심장"), ("2", "Knee", "무릎")], "sctid string, en string, ko string")
    ctx = flow.Context(spark, sources={"s": Dataset(rows)}, models={"m": lambda system, user: "심장" if "Heart" in user else "x"}, guides={"g": "guide"})
    nodes = [{"id": "d", "type": "datasource", "params": {"source": "s"}}, {"id": "g", "type": "style_guide", "params": {"guide": "g"}}, {"id": "t", "type": "translate", "params": {"model_key": "m"}, "inputs": {"terms": "d", "exemplars": "d", "style_guide": "g"}}, {"id": "e", "type": "evaluate", "inputs": {"translations": "t", "reference": "d"}}, {"id": "f", "type": "evaluate_formula", "params": {"expression": "exact_match_pct * 2"}, "inputs": {"metrics": "e"}}]
    return nodes, ctx


def test_end_to_end(spark):
    nodes, ctx = _flow(spark)
    done = flow.run(flow.load({"nodes": nodes}), ctx)
    assert all(r.ok for r in done.values()), {k: r.error for k, r in done.items()}
    assert done["f"].outputs["score"] == 100.0


def test_failure_is_a_result(spark):
    nodes, ctx = _flow(spark)
    nodes[-1]["params"]["expression"] = "nope + 1"
    done = flow.run(flow.load({"nodes": nodes}), ctx)
    assert not done["f"].ok and "nope" in done["f"].error


def test_wiring_is_checked(spark):
    nodes, ctx = _flow(spark)
    nodes[3]["inputs"].pop("reference")
    with pytest.raises(FlowError, match="not wired"):
        flow.validate(flow.load({"nodes": nodes}), ctx)
    nodes, ctx = _flow(spark)
    ctx.sources["s"] = Dataset(ctx.sources["s"].df.select("en"))
    with pytest.raises(FlowError, match="needs"):
        flow.validate(flow.load({"nodes": nodes}), ctx)


def test_retrieval_flow(spark):
    rows = spark.createDataFrame([("1", "heart attack"), ("2", "broken arm"), ("3", "knee pain")], "sctid string, en string")
    ctx = flow.Context(spark, sources={"s": Dataset(rows)})
    nodes = flow.load({"nodes": [{"id": "d", "type": "datasource", "params": {"source": "s"}}, {"id": "i", "type": "build_snomed_index", "inputs": {"concepts": "d"}}, {"id": "r", "type": "snomed_retrieve", "params": {"query_col": "en"}, "inputs": {"index": "i", "queries": "d"}}, {"id": "k", "type": "rerank", "params": {"query_col": "en"}, "inputs": {"index": "i", "queries": "d"}}]})
    done = flow.run(nodes, ctx)
    assert all(r.ok for r in done.values()), {k: r.error for k, r in done.items()}
    assert done["r"].outputs["metrics"].first()["recall_at_1"] == 100
    assert done["k"].outputs["metrics"].first()["recall_at_1"] == 100


def test_config_and_overrides(spark, tmp_path):
    from termloom.plans import config

    (tmp_path / "t.csv").write_text("id,english,ko\n1,Heart,심장\n2,Knee,무릎\n")
    env = {"sources": {"s": {"kind": "csv", "path": str(tmp_path / "t.csv")}}, "guides": {"g": "x"}}
    spec = {"nodes": [{"id": "d", "type": "datasource", "params": {"source": "s"}}, {"id": "g", "type": "style_guide", "params": {"guide": "g"}}, {"id": "t", "type": "translate", "params": {"model_key": "m"}, "inputs": {"terms": "d", "exemplars": "d", "style_guide": "g"}}, {"id": "e", "type": "evaluate", "params": {"limit": None}, "inputs": {"translations": "t", "reference": "d"}}]}
    nodes, ctx = config.assemble(spark, config.override(spec, {"e.limit": "1"}), env, {"m": lambda s, u: "심장"})
    assert ctx.sources["s"].roles == {"sctid": "id", "en": "english", "target": "ko"}
    done = flow.run(nodes, ctx)
    assert done["e"].ok and done["e"].outputs["metrics"].first()["n"] == 1
    with pytest.raises(FlowError):
        config.assemble(spark, spec, {"sources": {}}, {})
    with pytest.raises(FlowError):
        config.override(spec, {"zzz": "1"})
