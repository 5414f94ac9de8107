"""Quotes in other texts against a search of every text."""

import random

from tidemark.operators import quotes as Q


def test_held_elsewhere_against_brute_force(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(80))) for _ in range(40)]
    texts += [texts[3]] * 5 + ["", "é" * 300, "ab" * 40]
    quotes = [(i, t[k : k + n]) for i, t in enumerate(texts) for k, n in ((0, 12), (5, 13), (9, 30), (0, 3), (0, len(t)))] + [(1, None), (None, texts[3])]
    want = set()
    for i, q in set(quotes):
        if i is not None and q and len(q) >= Q.SHORTEST:
            want |= {(i, q, o) for o in [o for o, t in enumerate(texts) if o != i and q in t][:3]}
    held = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(90, None, ""), (None, texts[3], "")], "file_id long, content string, print string")
    got = [tuple(r) for r in Q.held_elsewhere(spark.createDataFrame(quotes, "file_id long, quote string"), held).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert Q.held_elsewhere(spark.createDataFrame([], "file_id long, quote string"), held).count() == 0


def _joined(plan):
    """Rows that come out of the joins of a plan that ran."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _joined(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _joined(plan.plan())
    rows = plan.metrics().apply("numOutputRows").value() if name.endswith("JoinExec") else 0
    children = plan.children()
    return rows + sum(_joined(children.apply(i)) for i in range(children.size()))


def test_sentences_of_the_same_phrases_are_not_candidates_of_each_other(spark):
    starts, middles, ends = ([f"{w} {'abcdefghijklmnop'[i] * 5} of the {w}" for i in range(16)] for w in ("accounts", "balances", "closings"))
    said = [f"{a}, {b}, {c}." for a in starts for b in middles for c in ends[:8]]
    texts = [(i, f"{s} {said[(i * 7 + 3) % len(said)]}") for i, s in enumerate(said)]
    quotes = spark.createDataFrame(list(enumerate(said)), "file_id long, quote string")
    found = Q.held_elsewhere(quotes, spark.createDataFrame(texts, "file_id long, content string"))
    got = {tuple(r) for r in found.collect()}
    want = {(j, said[j], i) for i in range(len(said)) if (j := (i * 7 + 3) % len(said)) != i}
    assert got == want
    # five joins; with grams shorter than a phrase, a quote meets all texts with that phrase (some 500 joined rows for each quote)
    assert len(said) < _joined(found._jdf.queryExecution().executedPlan()) < 100 * len(said)


def test_quotes_are_found_over_the_pieces_of_long_texts(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh \U0001f600é") for _ in range(3 * Q.PIECE // 2))
    lengths = [n for s, _ in Q.CLASSES for n in (s, s + 1)] + [Q.OVERLAP, 3 * Q.OVERLAP, Q.PIECE + 7]
    quotes = [(1, long[k : k + n]) for n in lengths for k in (0, Q.PIECE - n // 2, Q.PIECE - 1, Q.PIECE, len(long) - n) if 0 <= k <= len(long) - n]
    held = spark.createDataFrame([(0, long), (1, "none of it")], "file_id long, content string")
    got = {tuple(r) for r in Q.held_elsewhere(spark.createDataFrame(quotes, "file_id long, quote string"), held).collect()}
    assert got == {(1, q, 0) for _, q in quotes if q in long}


def test_no_text_or_quote_is_broadcast(spark, tmp_path):
    spark.createDataFrame([(i, f"a text of number {i} and more") for i in range(9)], "file_id long, content string").write.parquet(f"{tmp_path}/held")
    held = spark.read.parquet(f"{tmp_path}/held")
    found = Q.held_elsewhere(held.withColumnRenamed("content", "quote"), held)
    assert found.collect() == []
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
