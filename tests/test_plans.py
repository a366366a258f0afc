"""The shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

from cleargrain.operators import duplicates, profile
from cleargrain.plans import steps
from suite import agreements
from suite.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PYTHON_ALLOWED = ("p9", "v8", "v9", "v10", "v11", "c1", "c2", "g3", "g4", "g5", "g6", "g10", "g11", "s4")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# The lens queries all read the same cleaned table; two of them show its plan.
LOOKED_AT = sorted(n for n in QUERIES if n[0] not in "gl" or n in ("g5_top_duplicate_groups", "l4_owner_chart", "l8_compare_to_whole"))


@pytest.mark.parametrize("name", LOOKED_AT)
def test_no_all_pairs_join_and_python_only_for_scoring(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if not name.startswith(PYTHON_ALLOWED):
        assert "ArrowEvalPython" not in text


def test_names_are_scored_once(spark):
    text = plan(QUERIES["v8_scored_pairs"](spark, SF_DIR))
    assert text.count("ArrowEvalPython") == 1


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["v1_value_counts"](spark, SF_DIR))
    assert "o_totalprice" not in text and "o_orderdate" not in text


@pytest.mark.parametrize("name", ["d2_identifier_duplicates", "d4_probable_duplicates", "d6_duplicate_groups"])
def test_groups_combine_in_hash_maps(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, SF_DIR))


def test_lens_tests_reach_the_scan(spark):
    """Region and year are tested before names are normalised; the year of a date column is a range."""
    text = plan(QUERIES["l2_lens_filter"](spark, SF_DIR))
    normalizing = text.rindex("com.ibm.icu", 0, text.index("o_orderdate"))
    assert "PushedFilters" in text and normalizing < text.rindex("qc")


def test_year_of_a_date_column_is_pushed_down(spark, tmp_path):
    from cleargrain.operators import lens

    path = str(tmp_path / "dated")
    spark.sql("SELECT id AS _row_id, date_add(DATE'2019-06-01', CAST(id AS INT)) AS agreement_start_date FROM range(900)").write.parquet(path)
    rows = lens.lens_filter(spark.read.parquet(path), lens.Lens(year="2020"))
    pushed = plan(rows).split("PushedFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(agreement_start_date,2020-01-01)" in pushed and "LessThan(a" in pushed
    assert rows.count() == 366


def test_rows_with_copies_are_read_once(spark):
    """The rows and their copies come from one scan of the orders."""
    rows = agreements.agreements_with_copies(spark, SF_DIR)
    one = agreements.agreements(spark, SF_DIR)
    again = one.filter(F.col("_row_id") % 40 == 0).withColumn("_row_id", F.col("_row_id") + agreements.COPY_OFFSET)
    want = one.unionByName(again)
    assert rows.schema.simpleString() == want.schema.simpleString()
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    assert plan(rows).count("FileScan") == plan(one).count("FileScan") > 0


def test_overview_without_a_lens_stores_no_slice(spark, monkeypatch):
    stored, settle = [], steps.settle
    monkeypatch.setattr(steps, "settle", lambda table: stored.append(table.columns) or settle(table))
    rows = agreements.agreements_with_copies(spark, SF_DIR)
    steps.overview(rows, "agreements", lexical=True)
    assert len([c for c in stored if "recipient_legal_name_cleaned_codex" in c]) == 1


def test_only_repeated_rows_are_exchanged(spark):
    rows = agreements.agreements_with_copies(spark, SF_DIR)
    found = plan(duplicates.exact_duplicates(rows))
    joins = [line for line in found.splitlines() if "LeftSemi" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]


def test_cells_are_stripped_once(spark):
    rows = agreements.agreements(spark, SF_DIR)
    text = profile.missing_values_report(rows, lexical=True)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("trim(value") == 1
