"""A spread of registered queries beside their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
NAMES = ["agg6_valuation", "win1_merge_same_sales", "agg8_size_bands", "agg10_agg11_bracket_ladder",
         "gui3_gui4_gui5_guidance", "agg13_agg14_join11_area_table", "win4_interview_order", "run1_run_sold_stats",
         "join2_sca25_judge_claims", "src5_src6_sca13_extract_records", "udf5_focus_with_own_terms"]


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, name):
    said = check.compare(spark, con, name, FOLDER)
    assert said.startswith("ok") and "TYPES" not in said, said


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 125
