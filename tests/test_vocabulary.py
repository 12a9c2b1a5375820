from pagewright.operators.vocabulary import decoded, masked, vocabulary


def test_masked_scores_and_decoding(spark):
    tokens = vocabulary(spark.createDataFrame([(1, "ab"), (2, "é"), (3, "c d"), (4, None), (9, "</s>")], "token_id int, token string"), (9,))
    assert {r.token_id: r.able for r in tokens.collect()} == {1: True, 2: False, 3: True, 4: False, 9: True}
    rows = [(1, 1, 0, 1, 0.2), (1, 1, 0, 2, 0.9), (1, 1, 1, 3, 0.5), (1, 1, 1, 1, 0.5), (1, 1, 2, 9, 0.4), (1, 1, 3, 1, 0.9), (1, 2, 0, 2, 0.9), (1, 2, 0, 77, 0.8), (1, 3, 0, 9, 1.0), (1, 4, 0, 2, 1.0), (1, 4, 1, 3, 0.0)]
    scores = spark.createDataFrame(rows, "frame_id int, word_id int, pos int, token_id int, score double")
    assert sum(r.score == float("-inf") for r in masked(scores, tokens).collect()) == 4
    assert {r.word_id: r.text for r in decoded(scores, tokens, 9).collect()} == {1: "abab", 2: "", 3: "", 4: "c d"}
    assert {r.word_id: r.text for r in decoded(scores, tokens).collect()} == {1: "abab</s>ab", 2: "", 3: "</s>", 4: "c d"}


def test_scores_are_not_shuffled_by_token(spark):
    """F10; token ids on both sides of zero and at the ends of a word of the mask."""
    ids = [-65, -64, -1, 0, 62, 63, 64, 127, 128, 1 << 40]
    tokens = spark.createDataFrame([(i, k % 2 == 0) for k, i in enumerate(ids)], "token_id long, able boolean")
    scores = spark.createDataFrame([(1, i, 0.5) for i in [*ids, 65, None]], "frame_id int, token_id long, score double")
    got = masked(scores, tokens)
    assert got.columns == ["token_id", "frame_id", "score"]
    assert {r.token_id for r in got.collect() if r.score == 0.5} == set(ids[::2])
    plan = masked(scores, tokens)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # of the mask's words
