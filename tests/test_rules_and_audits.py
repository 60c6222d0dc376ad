"""Rules from files, contracts over source columns, audits that name what found an issue."""

import pytest
from loamwork.operators import audit, profile, rules
from loamwork.sources import rule_files


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "schema.json").write_text('﻿{"properties": {"age": {"type": "integer", "minimum": 0}}, "required": ["age"]}', encoding="utf-8")
    (tmp_path / "deep" / "rules.md").write_text("# Rules\n\n| field | rule |\n| --- | --- |\n| mail | e-mail |\n| age | required |\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("color allowed values: red, blue\nnothing about others", encoding="utf-8")
    (tmp_path / "picture.png").write_bytes(b"age required")
    found = rule_files.rule_documents(spark, [str(tmp_path)])
    assert sorted((r["file"].rsplit("/", 1)[-1], r["kind"]) for r in found.collect()) == [("notes.txt", "text"), ("rules.md", "text"), ("schema.json", "schema")]
    made = rule_files.read_rules(spark, [str(tmp_path)], ["mail", "age", "color"])
    assert sorted((r.field, r.op) for r in made) == [("age", "is_blank"), ("age", "lt"), ("age", "numeric_invalid"), ("color", "not_in"), ("mail", "regex_not_match")]
    with pytest.raises(ValueError):
        rule_files.read_rules(spark, [str(tmp_path)], [], most_schemas=0)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    for names, match, source, fine in (
        (["a", "b"], "source_dynamic", ["c", "d"], True), (["a"], "source_dynamic", ["c"], False), ([], "source_dynamic", [], False), (["a", "x", "b", "c"], "conditional", [], True),
        (["b", "a", "c"], "conditional", [], False), (["a", "b"], "prefix", [], True), (["a", "c"], "subset", [], True), (["a", "b"], "exact", [], False),
    ):
        spec = audit.Contract(names, match, source_columns=source)
        if fine:
            assert audit.assert_contract(df, spec) is df
        else:
            with pytest.raises(audit.ContractBroken):
                audit.assert_contract(df, spec)


def test_audit_names_rules_and_lookups(spark):
    df = spark.createDataFrame([(1, "", True, None), (2, "x", False, True)], "id int, v string, m boolean, n boolean")
    made = [rules.Rule("v needed", "v", "is_blank", reason="blank"), rules.Rule("m known", "m", "lookup_missing", reason="gone")]
    got = {r["id"]: r for r in audit.record_audit(rules.apply_rules(df, made), ["id"], made, {"first": "m", "second": "n"}, "t").collect()}
    assert tuple(got[1])[1:7] == ("t", "rule", "v needed", "first", "second", "blank")
    assert tuple(got[2])[1:7] == ("t", "lookup", "m known", "second", "first", "gone")
    plain = audit.record_audit(rules.apply_rules(df, made[:1]), ["id"]).first()
    assert (plain["rule"], plain["hit_lookups"], plain["failed_lookups"]) == ("blank", "", "")


def test_profile_issues(spark):
    df = spark.createDataFrame([(1, None, " "), (2, None, "a")], "id int, n int, s string")
    found = {(r["field"], r["issue"], r["rows"]) for r in profile.profile_issues(profile.profile(df, "t")).collect()}
    assert found == {("n", "null_values", 2), ("s", "empty_strings", 1)}
    assert profile.profile_issues(profile.profile(df.limit(0))).count() == 0
