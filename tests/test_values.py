import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.functions import values as V


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("1,360", 1360.0), ("0.12%", 0.12), (" 7 ", 7.0), ("N/A", None), ("", None), (".", None), ("too few to report", None), (None, None)])
def test_to_number(spark, text, want):
    assert one(spark, text, V.to_number("c")) == want


def test_to_number_is_strict(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "Suppressed", V.to_number("c"))
    assert one(spark, "Suppressed", V.try_number("c")) is None


@pytest.mark.parametrize("text,want", [("12.0", 12), ("1.5", 2), ("1,360", 1360)])
def test_integers_with_decimals(spark, text, want):
    assert one(spark, text, V.to_number("c", "int")) == want


def test_number_key_compares_values(spark):
    keys = {one(spark, t, V.number_key("c")) for t in ("1,360", "1360.0", " 1360 ", "1360%")}
    assert len(keys) == 1 and one(spark, "Abc", V.number_key("c")) == "abc" and one(spark, "N/A", V.number_key("c")) is None


@pytest.mark.parametrize("text,want", [("7/1/2020", (2020, 7, 1)), ("07/01/2020", (2020, 7, 1))])
def test_dates(spark, text, want):
    assert one(spark, text, V.to_date_us("c")) == datetime.date(*want)


@pytest.mark.parametrize("text,want", [("10002", "010002"), (" 01a000 ", "01A000"), ("", None), (None, None), ("1234567", "1234567")])
def test_facility_number(spark, text, want):
    assert one(spark, text, V.facility_number("c")) == want


@pytest.mark.parametrize("text,want", [("ST. LOUIS CITY", "STLOUISCITY"), ("Saint Louis County", "STLOUIS"), ("Juneau City and Borough", "JUNEAU"), ("Doña Ana County", "DONAANA"), ("De Kalb", "DEKALB"), ("Prince George’s County", "PRINCEGEORGES")])
def test_county_key(spark, text, want):
    assert one(spark, text, V.clean_county_name("c")) == want


def test_squash(spark):
    assert one(spark, "  Two   Words ", V.squash("c")) == "two words"
    assert one(spark, "Not Available", V.squash("c")) is None


def test_fold_accents(spark):
    assert one(spark, "ÀñüÉß", V.fold_accents(F.col("c"))) == "AnuEß"
