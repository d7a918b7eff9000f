"""Rule table, files, matching and actions."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import tags
from tidewatch.plans import actions, match, rules
from tidewatch.plans.rules import Action, Rule
from tidewatch.sources import rules as sources

T0 = datetime(2024, 1, 1)

CONTEXTS = [("u:1", 10, 5000.0, 0), ("v", 1, 10.0, 7), ("", 10, 2000.0, 9)]


def contexts(spark):
    return spark.createDataFrame(CONTEXTS, "user_id string, purchase_count long, total_amount double, login_fail_count long")


def some_rules():
    return [
        Rule("vip", "VIP", "purchase_count >= 5 and total_amount > 1000", 1,
             actions=(Action("TAG_USER", {"tags": ["vip", "rich"], "ttl": 60}),)),
        Rule("risk", "Risk", "login_fail_count > 5", 5,
             actions=(Action("TRIGGER_AUDIT", {"level": "high", "reason": "why", "metadata": {"k": 1}, "assignee": "ann"}),
                      Action("BLOCK_USER"), Action("TAG_USER", {"tags": []}), Action("TAG_USER", {"tags": ["x"], "action": "burn"}))),
        Rule("off", "Off", "True", 9, enabled=False),
        Rule("bad", "Bad", "nothing > 1", 9),
        Rule("same", "Same priority", "purchase_count > 0", 1),
    ]


def hits(spark, ids=None, rule_list=None):
    return match.match(contexts(spark), rule_list or some_rules(), ids, T0)


def test_match_order(spark):
    got = hits(spark).orderBy("user_id", "rank").collect()
    assert [(r["user_id"], r["rule_id"], r["rank"]) for r in got] == [
        ("", "risk", 0), ("", "vip", 1), ("", "same", 2), ("u:1", "vip", 0), ("u:1", "same", 1), ("v", "risk", 0), ("v", "same", 1),
    ]
    assert json.loads(got[3]["context"]) == {"user_id": "u:1", "purchase_count": 10, "total_amount": 5000.0, "login_fail_count": 0}
    assert {r["rule_id"] for r in hits(spark, ["same", "none", "off"]).collect()} == {"same"}
    assert hits(spark, []).count() == len(got)
    assert match.dry_run(contexts(spark), some_rules()).count() == len(got)
    assert "actions" not in match.dry_run(contexts(spark), some_rules()).columns
    assert match.match(contexts(spark), [], executed_at=T0).count() == 0
    # a rule registered twice counts once, in its last form
    twice = [*some_rules(), Rule("same", "Now never", "False")]
    assert "same" not in {r["rule_id"] for r in hits(spark, rule_list=twice).collect()}


def test_matching_does_not_shuffle(spark):
    plan = hits(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_validation(spark):
    checked = {r["rule_id"]: r for r in match.validate(contexts(spark), some_rules()).collect()}
    assert checked["vip"]["valid"] and checked["vip"]["error"] is None
    assert not checked["bad"]["valid"] and "undefined variable" in checked["bad"]["error"]
    ratio = match.validate(contexts(spark), [Rule("r", "r", "total_amount / login_fail_count > 1")]).first()
    assert (ratio["valid"], ratio["valid_contexts"], ratio["error"]) == (False, 2, "fails for some contexts")


def test_action_results(spark):
    got = {(r["user_id"], r["rule_id"]): r for r in actions.default_registry().results(hits(spark)).collect()}
    risk = got[("v", "risk")]
    assert [(a["action"], a["success"], a["error"]) for a in risk["actions_executed"]] == [
        ("TRIGGER_AUDIT", True, None), ("BLOCK_USER", False, "No handler registered for action type: BLOCK_USER"),
        ("TAG_USER", False, "Missing tags parameter"), ("TAG_USER", False, "Unknown action: burn"),
    ]
    assert risk["error"] == "Action execution failed: Unknown action: burn"
    assert got[("v", "same")]["actions_executed"] == [] and got[("v", "same")]["error"] is None
    nobody = got[("", "vip")]
    assert nobody["actions_executed"][0]["error"] == "Missing user_id in context"
    bare = actions.ActionRegistry().results(hits(spark)).filter("rule_id = 'vip'").first()
    assert bare["actions_executed"][0]["success"] is False and bare["error"] is None


def test_tag_and_audit_rows(spark):
    registry = actions.default_registry()
    rows = registry.run(hits(spark), "TAG_USER").collect()
    assert {(r["user_id"], r["tag_name"], r["source"], r["expire_at"]) for r in rows} == {
        ("u:1", t, "RULE", T0 + timedelta(seconds=60)) for t in ("vip", "rich")
    }
    (order,) = registry.run(hits(spark), "TRIGGER_AUDIT").collect()
    assert (order["user_id"], order["rule_id"], order["audit_level"], order["status"], order["assignee"]) == ("v", "risk", "HIGH", "pending", "ann")
    data = json.loads(order["trigger_data"])
    assert data["reason"] == "why" and data["k"] == 1 and data["context"]["login_fail_count"] == 7
    again = registry.run(hits(spark), "TRIGGER_AUDIT").first()
    assert again["id"] == order["id"]


def test_set_and_remove_tags(spark):
    held = spark.createDataFrame(
        [("u:1", "old", "1", "AUTO", 1.0, None, T0, False, None), ("u:1", "vip", "1", "AUTO", 1.0, None, T0, False, 0),
         ("v", "old", "1", "AUTO", 1.0, None, T0, False, 0)], schema.TAG_CHANGES)
    rule_list = [
        Rule("set", "Set", "user_id == 'u:1'", actions=(Action("TAG_USER", {"tags": ["vip", "new"], "action": "set"}),)),
        Rule("drop", "Drop", "user_id == 'v'", actions=(Action("TAG_USER", {"tags": ["old"], "action": "remove"}),)),
    ]
    later = hits(spark, rule_list=rule_list).withColumn("executed_at", F.lit(T0 + timedelta(days=1)).cast("timestamp"))
    changes = actions.default_registry().run(later, "TAG_USER")
    now = tags.current_tags(held.unionByName(changes)).collect()
    assert {(r["user_id"], r["tag_name"]) for r in now} == {("u:1", "vip"), ("u:1", "new")}


def test_changes_of_one_instant_by_place(spark):
    act = lambda kind, *names: Action("TAG_USER", {"tags": names, "action": kind})
    rule_list = [
        Rule("low", "Low", "user_id == 'v'", 1, actions=(act("add", "vip"), act("add", "x"), act("set", "vip", "y"))),
        Rule("high", "High", "user_id == 'v'", 2, actions=(act("remove", "vip"), act("add", "z", None))),
    ]
    changes = actions.default_registry().run(hits(spark, rule_list=rule_list), "TAG_USER")
    assert {r["tag_name"] for r in tags.current_tags(changes).collect()} == {"vip", "y"}
    log = tags.latest_changes(changes)
    assert {r["tag_name"] for r in log.filter("deleted").collect()} == {"x", "z"}


def test_metadata_takes_the_place_of_fields(spark):
    params = {"rule_id": "", "metadata": {"reason": "META", "context": [1], "rule_id": "other"}}
    rule_list = [
        Rule("a", "A", "user_id == 'v'", 2, actions=(Action("TRIGGER_AUDIT", params),)),
        Rule("b", "B", "user_id == 'v'", 1, actions=(Action("TRIGGER_AUDIT", {"rule_id": "", "reason": 'q"'}),)),
    ]
    orders = {r["rule_id"]: r["trigger_data"] for r in actions.default_registry().run(hits(spark, rule_list=rule_list), "TRIGGER_AUDIT").collect()}
    assert set(orders) == {"a", "b"}
    pairs = json.loads(orders["a"], object_pairs_hook=list)
    assert len(pairs) == len(dict(pairs)) and dict(pairs)["reason"] == "META" and dict(pairs)["context"] == [1] and dict(pairs)["rule_id"] == "other"
    assert json.loads(orders["b"])["reason"] == 'q"' and json.loads(orders["b"])["rule_id"] == "b"


def test_own_handler(spark):
    registry = actions.default_registry()
    registry.register("BLOCK_USER", actions.Handler(
        lambda user, action: F.when(user == "v", F.lit("not this one")), lambda rows: rows.select("user_id")))
    got = {r["user_id"]: r for r in registry.results(hits(spark, ["risk"])).collect()}
    assert got["v"]["actions_executed"][1]["error"] == "not this one"
    assert [r["user_id"] for r in registry.run(hits(spark, ["risk"]), "BLOCK_USER").collect()] == [""]
    assert registry.unregister("BLOCK_USER") and not registry.unregister("BLOCK_USER")


def test_batches(spark):
    rows = spark.createDataFrame([("a", ["t"]), ("", ["t"]), ("b", []), (None, ["t"])], "user_id string, tags array<string>")
    assert [r["status"] for r in actions.batch_tag_status(rows).collect()] == ["success", "error", "error", "error"]
    assert [r["user_id"] for r in actions.batch_tag_changes(rows, F.lit(T0)).collect()] == ["a"]
    assert [r["status"] for r in actions.batch_audit_status(rows).collect()] == ["success", "error", "success", "error"]
    made = actions.batch_audit_orders(rows, F.lit(T0)).collect()
    assert {r["user_id"] for r in made} == {"a", "b"} and {r["audit_level"] for r in made} == {"MEDIUM"}
    assert json.loads(made[0]["trigger_data"]) == {"reason": "Batch audit"}


YAML = """
id: one
name: One
condition: purchase_count >= 5
actions:
  - type: TAG_USER
    params: {tags: [a]}
---
---
id: two
name: Two
condition: 'True'
priority: 3
enabled: false
tags: [x, y]
created_at: '2024-01-01T00:00:00'
"""


def test_yaml_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yaml").write_text(YAML, encoding="utf-8")
    (tmp_path / "deep" / "b.yml").write_text("id: one\nname: Newer\ncondition: 'False'\n", encoding="utf-8")
    loaded = sources.yaml_rules(tmp_path)
    assert [(r.id, r.name, r.priority, r.enabled) for r in loaded] == [("one", "Newer", 0, True), ("two", "Two", 3, False)]
    first = sources.yaml_rules(tmp_path / "a.yaml")[0]
    assert first.actions[0] == Action("TAG_USER", {"tags": ["a"]}, True, 3, 1.0) and first.version == 1
    for text in ("id: [", "id: x\n", "id: x\nname: x\ncondition: x\nactions: [{type: NOPE}]\n"):
        (tmp_path / "deep" / "c.yaml").write_text(text, encoding="utf-8")
        with pytest.raises(sources.RuleFileError):
            sources.yaml_rules(tmp_path)
    with pytest.raises(sources.RuleFileError):
        sources.yaml_rules(tmp_path / "none")


def test_rule_tables(spark, tmp_path):
    table = rules.rules_frame(spark, some_rules())
    assert [r.id for r in rules.collect_rules(table)] == [r.id for r in some_rules()]
    assert rules.collect_rules(table)[1].actions[0].params["metadata"] == {"k": 1}
    table.write.parquet(str(tmp_path / "rules"))
    assert [r.id for r in sources.read_rule_table(spark, str(tmp_path / "rules"))] == ["bad", "risk", "vip", "same"]
    assert [r["id"] for r in rules.list_rules(table, limit=2, offset=1).collect()] == ["bad", "risk"]
    assert [r["id"] for r in rules.search_rules(table, "PRIO").collect()] == ["same"]
    assert rules.search_rules(table, priority=9).count() == 2
    assert tuple(rules.rule_stats(table).first()) == (5, 4, 1)
    assert dict(map(tuple, rules.rules_by_priority(table).collect())) == {1: 2, 5: 1, 9: 2}


def test_rule_upkeep(spark):
    fields = "id string, op string, ts timestamp, name string, description string, condition string, priority int, enabled boolean, actions string, tags array<string>, created_by string"
    day = timedelta(days=1)
    log = spark.createDataFrame([
        ("a", "create", T0, "A", None, "True", 1, True, None, ["t"], "me"),
        ("a", "update", T0 + day, None, None, None, 7, None, None, None, None),
        ("b", "create", T0, "B", None, "True", 1, True, None, [], None),
        ("b", "delete", T0 + day, None, None, None, None, None, None, None, None),
        ("b", "update", T0 + 2 * day, "ghost", None, None, None, None, None, None, None),
        ("c", "update", T0, "never made", None, None, None, None, None, None, None),
        ("d", "create", T0, "D1", "old", "True", 1, True, None, [], None),
        ("d", "delete", T0 + day, None, None, None, None, None, None, None, None),
        ("d", "create", T0 + 2 * day, "D2", None, "False", 2, False, None, [], None),
    ], fields)
    got = {r["id"]: r for r in rules.rule_changes_applied(log).collect()}
    assert set(got) == {"a", "d"}
    assert (got["a"]["name"], got["a"]["priority"], got["a"]["version"], got["a"]["updated_at"]) == ("A", 7, 2, T0 + day)
    assert (got["d"]["name"], got["d"]["description"], got["d"]["version"], got["d"]["created_at"]) == ("D2", None, 1, T0 + 2 * day)
