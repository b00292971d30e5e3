"""Missing effect ids count as ids, and only a payload's own level is searched for a caller's key."""

from tests.helpers import steps
from tenure.operators import effects, validate


def test_a_missing_id_beside_another_is_two(spark):
    seen = spark.createDataFrame([("a", True, "e"), ("a", False, None), ("b", True, "e")], "step_id string, applied boolean, effect_id string")
    store = spark.createDataFrame([("a", "e"), ("b", "e")], "step_id string, effect_id string")
    (row,) = effects.effect_consistency(seen, store).collect()
    assert row["step_id"] == "a" and row["several_ids"] and row["differs_from_store"]


def test_only_the_top_level_key_is_the_callers(spark):
    payload = '{"value":"v","delayAfterEffectMs":0,%s}'
    rows = [("n", '"meta":{"idempotencyKey":"x"}'), ("t", '"idempotencyKey":"x"'), ("z", '"idempotencyKey":null')]
    df = steps(spark, [{"step_id": i, "task_type": "idempotent_effect", "attempt_count": 1, "payload": payload % more} for i, more in rows])
    got = {r["step_id"]: r.asDict() for r in validate.validate_tasks(df).collect()}
    assert got["n"] != got["t"]
    assert [any("idempotencyKey" in str(v) for k, v in got[i].items() if k != "payload") for i in ("n", "t", "z")] == [False, True, True]
