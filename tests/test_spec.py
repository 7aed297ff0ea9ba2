import json

import pytest

from cleanframe.plans.spec import Op, PipelineSpec, RegexRule, SpecError, Step


def spec():
    return PipelineSpec(
        (Step(Op.FILL_MISSING_MEAN, "age"), Step.filter("income", ">", "50000"), Step(Op.REMOVE_DUPLICATES))
    )


def test_round_trip(tmp_path):
    path = str(tmp_path / "p.json")
    spec().save(path)
    assert PipelineSpec.load(path) == spec()
    doc = json.loads(spec().to_json())
    assert doc["schemaVersion"] == 1 and doc["steps"][1]["param"] == ">|50000"


@pytest.mark.parametrize(
    "text",
    [
        "{", "[]", "{}", '{"steps": 3}', '{"schemaVersion": 2, "steps": []}',
        '{"steps": [{"operation": "EXPLODE"}]}', '{"steps": [{}]}', '{"steps": ["x"]}',
    ],
)
def test_bad_documents(text):
    with pytest.raises(SpecError):
        PipelineSpec.from_json(text)


def test_version_may_be_absent():
    assert PipelineSpec.from_json('{"steps": []}') == PipelineSpec()


def test_column_warnings():
    assert spec().column_warnings(["age", "income"]) == []
    bad = PipelineSpec((Step(Op.FILL_MISSING_MEAN, "missing_col"),))
    assert len(bad.column_warnings(["age"])) == 1 and "missing_col" in bad.column_warnings(["age"])[0]


def test_regex_rule_codec():
    rule = RegexRule(r"^(\w+)", "$1\"")
    assert RegexRule.from_param(rule.to_param()) == rule
    for bad in (None, "", "x", "[]", "{}"):
        with pytest.raises(SpecError):
            RegexRule.from_param(bad)


@pytest.mark.parametrize(
    "step",
    [
        Step(Op.TRAIN_TEST_SPLIT, None, "1"), Step(Op.TRAIN_TEST_SPLIT, None, "0"),
        Step(Op.TRAIN_TEST_SPLIT, None, "most"), Step(Op.FILTER_ROWS, "x", "==|"),
        Step.regex("x", ""), Step.regex("x", "["),
    ],
)
def test_parameters_are_checked(spark, step):
    with pytest.raises(SpecError):
        step.validate(spark)


def test_good_parameters(spark):
    for step in (Step(Op.TRAIN_TEST_SPLIT), Step.filter("x", "==", "1"), Step.regex("x", "a+")):
        step.validate(spark)
