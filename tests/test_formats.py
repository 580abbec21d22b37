"""Number and date texts, as a browser would show them."""

import datetime

import pytest
from pyspark.sql import functions as F

from wavebook.functions import formats


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("x, digits, shown", [
    (1.005, 2, "1.00"), (1.45, 1, "1.4"), (8.345, 2, "8.35"), (0.125, 2, "0.13"), (-0.125, 2, "-0.13"),
    (2.5, 0, "3"), (-2.5, 0, "-3"), (0.5, 0, "1"), (-0.0001, 2, "-0.00"), (10.235, 2, "10.23"),
    (1e21, 2, "1e+21"), (1.5e22, 0, "1.5e+22"), (1234567.125, 2, "1234567.13"), (0.0, 2, "0.00"),
    (0.000001, 7, "0.0000010"),
])
def test_fixed(spark, x, digits, shown):
    assert value(spark, formats.fixed_text(F.lit(x), digits)) == shown


@pytest.mark.parametrize("x, digits, shown", [
    (123456.0, 2, "1.2e+5"), (0.000123, 2, "0.00012"), (1.2345e-7, 3, "1.23e-7"), (1.25, 2, "1.3"),
    (1.35, 2, "1.4"), (2.5, 1, "3"), (25.0, 1, "3e+1"), (99.99, 3, "100"), (99.99, 2, "1.0e+2"),
    (1.45, 2, "1.4"), (-5.0, 3, "-5.00"), (1000.0, 4, "1000"), (1e21, 3, "1.00e+21"), (1234.5, 4, "1235"),
    (12345.0, 4, "1.235e+4"), (0.0, 3, "0.00"), (0.05, 1, "0.05"), (0.0, 1, "0"),
])
def test_precision(spark, x, digits, shown):
    assert value(spark, formats.precision_text(F.lit(x), digits)) == shown


@pytest.mark.parametrize("text, interval, mark, decimal, shown", [
    ("123456666.7890", 3, ",", ".", "123,456,666.7890"), ("-1234.5", 3, ",", ".", "-1,234.5"),
    ("123", 3, ",", ".", "123"), ("1234567.1234567", 3, ".", ",", "1.234.567,1234567"),
    ("12345678", 4, " ", ".", "1234 5678"), ("1e+21", 3, ",", ".", "1e+21"), ("6.84e+4", 3, ".", ",", "6.84e+4"),
    ("1234.5", 2, "$", ".", "12$34.5"),
])
def test_grouping(spark, text, interval, mark, decimal, shown):
    assert value(spark, formats.group_digits(F.lit(text), interval, mark, decimal)) == shown


def test_cells(spark):
    missing = F.lit(None).cast("double")
    cases = [
        (formats.format_currency(F.lit(-1234.5)), "-$1,234.50"),
        (formats.format_currency(F.lit(1234.5), "€", before=False, mark=".", decimal=","), "1.234,50€"),
        (formats.format_currency(F.lit(0.0), zero="free"), "free"),
        (formats.format_percent(F.lit(0.075), 1), "7.5%"),
        (formats.format_round(F.lit("12.346"), 2), "12.35"),
        (formats.format_round(F.lit("n/a"), 2), ""),
        (formats.format_signif(F.lit(1234567.0), 9), "1,234,567.00"),
        (formats.format_round(missing, 2), ""),
        (formats.format_string(missing, "<", ">"), ""),
        (formats.format_string(F.lit("a"), "<", ">"), "<a>"),
        (formats.format_date(F.lit(datetime.date(2015, 10, 28))), "Wed Oct 28 2015"),
        (formats.format_date(F.lit(None).cast("date")), ""),
        (formats.format_date(F.lit("2024-01-01 23:30:00").cast("timestamp"), "yyyy-MM-dd HH:mm", "Asia/Tokyo"), "2024-01-02 08:30"),
    ]
    for column, shown in cases:
        assert value(spark, column) == shown
