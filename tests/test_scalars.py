from pyspark.sql import functions as F

from tenure.functions import fixed, scalars


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_backoff_doubles_and_is_bounded(spark):
    assert one(spark, [0, 1, 2, 3, 4, 5, 8], scalars.backoff_ms, "int") == [500, 500, 1000, 2000, 4000, 4000, 4000]


def test_error_excerpt_boundary(spark):
    short, long = "x" * 200, "x" * 201
    assert one(spark, [short, long, ""], scalars.error_excerpt) == [short, "x" * 199 + "…", ""]


def test_canonical_json_is_equality_of_values(spark):
    texts = ['{"a":1,"b":[1,2]}', '{ "b" : [1, 2], "a" : 1.0 }', '{"a":9,"a":1,"b":[1,2]}', '{"a":"1","b":[1,2]}', '{"a":1,"b":[2,1]}', "no"]
    a, b, c, d, e, bad = one(spark, texts, scalars.canonical_json)
    assert a == b == c
    assert len({a, d, e}) == 3
    assert bad is None


def test_uuid_and_effect_key(spark):
    good = "ABCDEF01-0000-4000-8000-00000000000a"
    values = [good, good.lower(), good + "\n", good[:-1], "", None]
    assert one(spark, values, scalars.is_uuid) == [True, True, False, False, False, False]
    key = f"step:{good.lower()}:demo_receipt"
    assert one(spark, values, scalars.effect_key) == [key, key, None, None, None, None]


def test_effect_id_is_stable_and_uuid_shaped(spark):
    a, b, c = one(spark, ["k", "k", "l"], scalars.effect_id)
    assert a == b != c
    assert one(spark, [a], scalars.is_uuid) == [True]


def test_clock_part_and_short_id(spark):
    assert one(spark, ["2024-01-01 10:11:12.123456+00", "soon"], scalars.clock_part) == ["10:11:12.123", "soon"]
    assert one(spark, ["0123456789"], scalars.short_id) == ["01234567"]


def test_paced_rate(spark):
    assert one(spark, [3277.1, 399.0, 10.0], scalars.paced_rate, "double") == [1600, 100, 100]


def test_every_pair_of_statuses(spark):
    pairs = [(a, b) for a in fixed.STATUSES for b in fixed.STATUSES]
    df = spark.createDataFrame(pairs, "a string, b string")
    legal = {(r.a, r.b) for r in df.where(scalars.is_legal_transition(F.col("a"), F.col("b"))).collect()}
    assert legal == set(fixed.LEGAL_EDGES) and len(legal) == 10
    assert not any(a in fixed.TERMINAL_STATUSES or a == b for a, b in legal)


def test_terminal_statuses(spark):
    assert one(spark, [*fixed.STATUSES, None], scalars.is_terminal) == [s in fixed.TERMINAL_STATUSES for s in fixed.STATUSES] + [False]


def test_tenth_rounds_halves_away_from_zero(spark):
    assert one(spark, [1.25, -1.25, 0.04, -3.0], scalars.tenth, "double") == [1.3, -1.3, 0.0, -3.0]
