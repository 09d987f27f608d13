"""Plan regressions: the physical properties the design relies on at scale."""

import re

import __spark_entry__ as entry
from tests.conftest import SMALL


def plan_of(spark, name):
    df = entry.queries()[name](spark, SMALL)
    df.write.format("noop").mode("overwrite").save()      # AQE final plan
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return [l for l in plan.splitlines() if re.search(r"(?<!Broadcast)(?<!Reused)Exchange ", l)]


def test_in_row_stanza_rollup_has_no_shuffle(spark):
    p = plan_of(spark, "stanza_rollup")
    assert not shuffles(p)
    assert "ArrowEvalPython" in p                           # NFKC is the only Python step


def test_lexicon_scoring_is_a_projection(spark):
    p = plan_of(spark, "lexicon_hits")
    assert not shuffles(p) and "Join" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan_of(spark, "song_fingerprint")
    m = re.search(r"ReadSchema: struct<([^>]*)>", p)
    assert m and "text" in m.group(1) and "lang" not in m.group(1) and "n_chars" not in m.group(1)


def test_topk_prunes_before_the_shuffle(spark):
    p = plan_of(spark, "similarity_topk")
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_dedupe_streams_text_without_sorting_it(spark):
    p = plan_of(spark, "keep_first_dedupe")
    assert "ShuffledHashJoin" in p and "LeftSemi" in p
    assert "SortAggregate" not in p and "SortMergeJoin" not in p


def test_no_cross_products_anywhere_in_the_flagship(spark):
    p = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert len(shuffles(p)) <= 2


def test_draws_of_the_bootstrap_are_never_broadcast(spark):
    p = plan_of(spark, "entropy_bootstrap")
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for x in lines[i + 1:]:
                if len(x) - len(x.lstrip(" :+-")) <= depth:
                    break
                below.append(x)
            assert not any("Generate" in x for x in below)


def test_scans_are_not_shuffled_unless_asked(spark):
    assert "RoundRobinPartitioning" not in plan_of(spark, "lexicon_hits")
