"""Pairs made of conversations share every turn before the last reply."""

from tenure.llm import preferences


def test_replies_are_swapped_between_neighbours(spark):
    rows = [(2, 0, "user", "hi"), (2, 1, "assistant", "two"), (3, 0, "user", "hi"), (3, 1, None, "mid"), (3, 2, "assistant", "three"),
            (8, 0, "user", None), (None, 0, "user", "lost"), (5, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn int, role string, text string, side string").repartition(3)
    got = {r["pair_id"]: r for r in preferences.format_pairs(preferences.swapped_replies(df)).collect()}
    assert {k: (r["n_prompt_turns"], r["n_chosen_turns"], r["n_rejected_turns"]) for k, r in got.items()} == {
        2: (1, 1, 1), 3: (2, 1, 1), 8: (1, 0, 0), 5: (1, 0, 0), 4: (1, 0, 0), None: (0, 1, 1),
    }
    assert "two" in got[2]["chosen"] and "three" in got[2]["rejected"] and "hi" in got[2]["prompt"]
    assert "two" in got[3]["rejected"] and "mid" in got[3]["prompt"]
    assert preferences.swapped_replies(df.filter("1 = 0")).collect() == []
