import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quietlake.functions.cells import SUPPRESSED as S
from quietlake.functions.globs import Globs
from quietlake.operators import cellscan, suppress
from quietlake.plans.policy import Policy

COUNTS = Policy.default().count_columns


def rows(df):
    return [list(r) for r in df.collect()]


def test_whole_row_and_true_zero(spark):
    """A small count takes its row's other cells along; none at all is no small count."""
    df = spark.createDataFrame([(2021, 480, "kiosk", True), (2022, 0, "kiosk", False), (2023, 7, "stand", None), (2024, 11, "stand", True)], "sale_year int, sales_count long, place string, open boolean")
    out = suppress.suppress(df, 11, suppress.count_positions(df.columns, COUNTS), [0])
    assert rows(out) == [["2021", "480", "kiosk", "true"], ["2022", "0", "kiosk", "false"], [S] * 4, ["2024", "11", "stand", "true"]]
    m = suppress.measure(out, 4, [1])
    assert (m.rows, m.rows_suppressed, m.cells_suppressed) == (4, 1, 4)


def test_total_line_goes_with_a_blanked_row(spark):
    df = spark.createDataFrame([("pears", 61), ("figs", 2), (" TOTAL", 63), ("plums", 15), (None, 78)], "fruit string, n long")
    assert rows(suppress.suppress(df, 11, [1], [0])) == [["pears", "61"], [S, S], [S, S], ["plums", "15"], [S, S]]
    df = spark.createDataFrame([("pears", 61), ("total", 61)], "fruit string, n long")
    assert rows(suppress.suppress(df, 11, [1], [0])) == [["pears", "61"], ["total", "61"]]


@pytest.mark.parametrize(("cell", "small"), [("1", True), ("10", True), ("11", False), ("0", False), ("-3", False), ("2.5", False), ("1,0", True), ("3.0", True), ("x", False), (None, False), ("NaN", False)])
def test_small_cells(spark, cell, small):
    df = spark.createDataFrame([("a", cell)], "k string, n string")
    assert (rows(suppress.suppress(df, 11, [1], [0]))[0][0] == S) is small


def test_booleans_and_nan(spark):
    df = spark.createDataFrame([(True, float("nan"))], "n boolean, cnt double")
    assert rows(suppress.suppress(df, 11, [0, 1])) == [["true", "NaN"]]


def test_refusals(spark):
    few = spark.createDataFrame([("a", 12), ("b", 3), ("c", 30)], "k string, n long")
    with pytest.raises(suppress.Refused):
        suppress.anonymize(few, 11, [1], [0])
    many = spark.createDataFrame([(str(i), 1) for i in range(20)], "k string, n long")
    with pytest.raises(suppress.Refused):
        suppress.anonymize(many, 11, [1], [0])
    half = spark.createDataFrame([(str(i), 1 if i < 5 else 50) for i in range(10)], "k string, n long")
    assert suppress.anonymize(half, 11, [1], [0])[1].share == 0.5


def test_no_counts_empty_and_equal_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows(suppress.suppress(df, 11, [])) == [[1, 2]]
    empty = spark.createDataFrame([], "k string, n long")
    assert suppress.anonymize(empty, 11, [1], [0])[1].rows == 0
    twice = spark.createDataFrame([("x", 3, "y")], "k string, n long, k2 string").toDF("k", "n", "k")
    assert rows(suppress.suppress(twice, 11, [1], [0])) == [[S, S, S]]


def test_positions():
    assert suppress.count_positions(["a", "COUNT(1)", "total_people", "n"], COUNTS, {"total_people"}, {1}) == [1, 2, 3]
    assert suppress.count_positions(["n", "x"], Globs(["n"]), (), {7}) == [0]


def test_columns(spark):
    with pytest.raises(suppress.Refused):
        suppress.check_columns(spark.createDataFrame([(1,)], "patient_name int"), Policy.default())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "all", None]), st.integers(-2, 30)), min_size=1, max_size=8))
def test_a_row_is_blanked_whole_or_not_at_all(spark, data):
    out = rows(suppress.suppress(spark.createDataFrame(data, "k string, n long"), 11, [1], [0]))
    for (k, n), r in zip(data, out, strict=True):
        assert (r == [S, S]) == (S in r)
        if 1 <= n < 11:
            assert r == [S, S]


def test_cell_scan(spark):
    df = spark.createDataFrame([("ring 541.555.0177", datetime.date(2031, 2, 9), 40), ("seen 2031-02-08", None, 1), ("", None, 2), (None, None, 3)], "t string, d date, n long")
    out, report = cellscan.scan_cells(df)
    assert rows(out)[0][0] == "ring <REDACTED:PHONE_NUMBER>"
    assert report.kinds == {"PHONE_NUMBER": 1} and report.columns == {"t": ["PHONE_NUMBER"]}
    assert report.day_precision_dates == 2 and report.alarm


def test_entities_within_a_budget(spark):
    def load():
        return lambda text: ["PERSON"] if "Quist" in text else []

    df = spark.createDataFrame([("O. Quist",), ("none",), ("x" * 50,), (None,)], "t string").coalesce(1)
    got = [r[0] for r in df.select(cellscan.entity_udf(load, budget=30)("t")).collect()]
    assert got == [["PERSON"], [], None, []]


def test_hits_and_entities_of_a_result(spark):
    def load():
        return lambda text: ["PERSON"] if "Quist" in text else []

    df = spark.createDataFrame([("ring 541.555.0177", "O. Quist"), ("12,000.5", "none"), (None, "172.20.3.8 Quist")], "t string, u string")
    _, report = cellscan.scan_cells(df, list_hits=True, recogniser=load)
    assert report.hits == [(1, "t", ["PHONE_NUMBER"]), (1, "u", ["PERSON"]), (3, "u", ["IP_ADDRESS", "PERSON"])] and report.entities == ["PERSON"] and report.alarm
    with pytest.raises(cellscan.NotLookedAt):
        cellscan.scan_cells(df, recogniser=load, budget=20)
    many = spark.createDataFrame([("172.20.3.8",)] * 80, "t string")
    assert len(cellscan.scan_cells(many, list_hits=True)[1].hits) == cellscan.MOST_HITS
