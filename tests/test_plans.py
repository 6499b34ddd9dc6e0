"""Plans: no joins of all pairs, pruned columns, filters at the scan."""

import re

import pytest

from lectern import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that join one row of medians or phrases to all.
ONE_ROW = {"ranked_sweep", "grade_ladder", "median_impute_score"}
#: Queries that read what they have written, whose plan at the end is not the whole.
WRITES = {"coupling_components", "reach_closure", "cycle_members"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - WRITES))
def test_no_join_of_all_pairs(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    found = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    assert len(found) <= (1 if name in ONE_ROW else 0), text
    assert not re.search(r"BatchEvalPython|ArrowEvalPython", text)


def test_scans_read_what_they_need(spark):
    text = plan(catalogue.queries()["gap_rollup"](spark, SF))
    assert re.search(r"ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>", text)
    text = plan(catalogue.queries()["ngram_phrases"](spark, SF))
    assert "EqualTo(lang,en)" in text and "n_chars" not in text.split("ReadSchema")[1].split("\n")[0]


def test_first_aggregations_combine_before_the_shuffle(spark):
    text = plan(catalogue.queries()["keyed_upsert"](spark, SF))
    assert "partial_min_by" in text


@pytest.mark.parametrize("name", ["rule_engine", "worst_severity"])
def test_records_are_grouped_where_labels_met_them(spark, name):
    assert not re.search(r"hashpartitioning\((entry_key|cast\(doc_id)", plan(catalogue.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", ["rule_engine", "worst_severity"])
def test_texts_meet_labels_once_and_unsorted(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:string", text)) == 1
    assert "SortMergeJoin" not in text and "collect_list" not in text


@pytest.mark.parametrize("name", ["rule_engine", "worst_severity"])
def test_texts_stay_at_the_scan_unless_marked(spark, name):
    text = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"THEN text#\d+ END AS text#\d+[^\n]*\n[^\n]*Join LeftOuter, \(word#", text), text


def test_alike_entries_are_checked_once(spark):
    text = plan(catalogue.queries()["worst_severity"](spark, SF))
    assert re.search(r"Generate explode.*HashAggregate\(keys=\[text#.*ShuffledHashJoin", text, re.S), text
    assert "SortAggregate" not in text
