"""The star schema of readmission results, penalties, surveys, hospitals and counties, from raw releases.

Raw tables hold published text, one column per published name, with ``_release`` and ``_ingested_at``. Staging tables rename,
type and recode one source each; intermediate ones reshape and join; marts are facts and dimensions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack import checks
from lodestack.functions.values import clean_county_name, to_date_us, to_number
from lodestack.operators import relations as R
from lodestack.operators.ordering import top_share_flag
from lodestack.plans.pipeline import Pipeline

Tables = Mapping[str, DataFrame]
HOSPITAL = Pipeline()

#: Survey topics by the code in a measure's id; the last two are no longer published.
TOPICS = {
    "COMP_1": "nurse_communication",
    "COMP_2": "doctor_communication",
    "COMP_5": "medicine_communication",
    "COMP_6": "discharge_information",
    "CLEAN": "cleanliness",
    "QUIET": "quietness",
    "HSP_RATING": "overall_rating",
    "RECMND": "recommend",
}
RETIRED_TOPICS = {"COMP_3": "staff_responsiveness", "COMP_7": "care_transition"}

#: County health measures by their published id; the last four are of the social family.
CHRONIC = {
    "DIABETES": "diabetes",
    "OBESITY": "obesity",
    "COPD": "copd",
    "CHD": "heart_disease",
    "BPHIGH": "high_blood_pressure",
    "STROKE": "stroke",
    "DEPRESSION": "depression",
    "CSMOKING": "smoking",
    "LPA": "physical_inactivity",
    "GHLTH": "fair_poor_health",
    "DISABILITY": "disability",
    "ACCESS2": "uninsured_18_64",
    "CHECKUP": "routine_checkup",
}
SOCIAL = {"LACKTRPT": "lack_transportation", "FOODINSECU": "food_insecurity", "HOUSINSECU": "housing_insecurity", "LONELINESS": "loneliness"}

#: Conditions and the words for them in column names of the payment file.
CONDITIONS = {"AMI": "AMI", "COPD": "COPD", "HF": "HF", "PN": "pneumonia", "CABG": "CABG", "HIP_KNEE": "THA/TKA"}

#: Why a result has no ratio, by footnote code.
STATUS = {"1": "too_few_cases", "5": "not_available", "7": "no_cases"}

#: Fixed value: what the key of a payment file's last rows says.
FOOTERS = ("end of worksheet",)


def score_status(ratio: Column, footnote: Column) -> Column:
    return R.ladder([(ratio.isNotNull(), "scored"), *[(footnote == code, name) for code, name in STATUS.items()]], "unknown")


def yes_no(c: Column) -> Column:
    return F.when(c == "Yes", True).when(c == "No", False)


def c(df: DataFrame, *names: str) -> Column:
    return R.either(df, *names)


def _lineage(df: DataFrame) -> dict[str, Column]:
    return {"source_release": c(df, "_release"), "ingested_at": c(df, "_ingested_at").cast("timestamp")}


def _named(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.select(*[v.alias(n) for n, v in columns.items()])


def _results(df: DataFrame, measure: Column, footnote: Column, extra: Mapping[str, Column]) -> DataFrame:
    """Readmission results of any year's layout."""
    rows = _named(
        df,
        {
            "facility_id": c(df, "Facility ID", "Provider ID"),
            "facility_name": c(df, "Facility Name", "Hospital Name"),
            "state": c(df, "State"),
            "measure_id": measure,
            "condition": F.translate(F.regexp_extract(measure, "^READM-30-(.+)-HRRP$", 1), "-", "_"),
            "discharges": to_number(c(df, "Number of Discharges"), "int"),
            "readmissions": to_number(c(df, "Number of Readmissions"), "int"),
            "readmissions_suppressed": c(df, "Number of Readmissions") == "Too Few to Report",
            **{n.lower().replace(" ", "_"): to_number(c(df, n)) for n in ("Excess Readmission Ratio", "Predicted Readmission Rate", "Expected Readmission Rate")},
            "footnote_code": F.nullif(footnote, F.lit("")),
            "period_start": to_date_us(c(df, "Start Date")),
            "period_end": to_date_us(c(df, "End Date")),
            **_lineage(df),
            **extra,
        },
    )
    return rows.withColumn("score_status", score_status(F.col("excess_readmission_ratio"), F.col("footnote_code")))


@HOSPITAL.node("hrrp")
def stg_results(t: Tables) -> DataFrame:
    df = R.latest_release(t["hrrp"], "_release")
    return _results(df, c(df, "Measure Name"), c(df, "Footnote"), {})


@HOSPITAL.node("hrrp_archive")
def stg_results_history(t: Tables) -> DataFrame:
    """One snapshot per period; older codes have ``_``, older footnotes are sentences after the code."""
    df = R.latest_snapshot_per_period(t["hrrp_archive"], "_release", c(t["hrrp_archive"], "Start Date"), c(t["hrrp_archive"], "End Date"))
    extra = {n: F.col(f"_{n}") for n in ("period_first_release", "period_snapshots")}
    return _results(df, F.translate(c(df, "Measure Name"), "_", "-"), F.regexp_extract(c(df, "Footnote"), r"^\s*(\d+)", 1), extra)


@HOSPITAL.node("hrrp_supplemental")
def stg_payment_adjustments(t: Tables) -> DataFrame:
    df = R.without_footers(t["hrrp_supplemental"], "Hospital CCN", FOOTERS)
    factor, published = to_number(c(df, "Payment adjustment factor")), to_number(c(df, "Payment reduction percentage"))
    rows = _named(
        df,
        {
            "facility_id": c(df, "Hospital CCN"),
            "fiscal_year": c(df, "_release"),
            "payment_adjustment_factor": factor,
            "payment_reduction_pct": F.coalesce(published, F.round((1 - factor) * 100, 4)),
            "payment_reduction_is_derived": published.isNull(),
            "is_penalized": factor < 1,
            "dual_proportion": to_number(c(df, "Dual proportion")),
            "peer_group": to_number(c(df, "Peer group assignment"), "int"),
            "neutrality_modifier": to_number(c(df, "Neutrality modifier")),
            "ingested_at": c(df, "_ingested_at").cast("timestamp"),
        },
    )
    return R.latest_flag(rows, "fiscal_year", "is_latest_fiscal_year")


@HOSPITAL.node("hrrp_supplemental")
def stg_peer_comparisons(t: Tables) -> DataFrame:
    """Blocks of columns per condition as rows; a block that a year's file lacks has none."""
    df = R.without_footers(t["hrrp_supplemental"], "Hospital CCN", FOOTERS)
    blocks = {
        code: {
            "__cases": c(df, f"Number of eligible discharges for {word}"),
            "eligible_discharges": F.coalesce(to_number(c(df, f"Number of eligible discharges for {word}"), "int"), F.lit(0)),
            "excess_readmission_ratio": to_number(c(df, f"ERR for {word}")),
            "peer_group_median_err": to_number(c(df, f"Peer group median ERR for {word}")),
            "is_above_peer_median": c(df, f"Penalty indicator for {word}") == "Y",
            "drg_payment_ratio": to_number(c(df, f"DRG payment ratio for {word}")),
        }
        for code, word in CONDITIONS.items()
    }
    rows = df.withColumns({"facility_id": c(df, "Hospital CCN"), "fiscal_year": c(df, "_release")})
    return R.unpivoted(rows, ["facility_id", "fiscal_year"], "condition", blocks, "__cases").drop("__cases")


def _profile(df: DataFrame) -> dict[str, Column]:
    return {
        "facility_id": c(df, "Facility ID", "Provider ID"),
        "facility_name": c(df, "Facility Name", "Hospital Name"),
        "address": c(df, "Address"),
        "city": c(df, "City/Town", "City"),
        "state": c(df, "State"),
        "zip_code": c(df, "ZIP Code"),
        "county_name": c(df, "County/Parish", "County Name"),
        "hospital_type": c(df, "Hospital Type"),
        "ownership": c(df, "Hospital Ownership"),
        "has_emergency_services": yes_no(c(df, "Emergency Services")),
        "overall_star_rating": to_number(c(df, "Hospital overall rating"), "int"),
    }


@HOSPITAL.node("hospital_info")
def stg_hospitals(t: Tables) -> DataFrame:
    df = R.latest_release(t["hospital_info"], "_release")
    counts = {
        f"{prefix}_measures_{name}": to_number(c(df, text.format(word)), "int")
        for prefix, word in (("mort", "MORT"), ("safety", "Safety"), ("readm", "READM"))
        for name, text in (
            ("reported", "Count of Facility {} Measures"),
            ("better", "Count of {} Measures Better"),
            ("no_different", "Count of {} Measures No Different"),
            ("worse", "Count of {} Measures Worse"),
        )
    }
    return _named(
        df,
        {
            **_profile(df),
            "is_birthing_friendly": c(df, "Meets criteria for birthing friendly designation") == "Y",
            "overall_star_rating_footnote": F.nullif(c(df, "Hospital overall rating footnote"), F.lit("")),
            **counts,
            **_lineage(df),
        },
    )


@HOSPITAL.node("hospital_info_archive")
def stg_hospitals_history(t: Tables) -> DataFrame:
    df = t["hospital_info_archive"]
    return _named(df, {**_profile(df), "snapshot_date": c(df, "_release").cast("date"), "ingested_at": c(df, "_ingested_at").cast("timestamp")})


def _survey(df: DataFrame) -> dict[str, Column]:
    return {
        "facility_id": c(df, "Facility ID", "Provider ID"),
        "measure_id": c(df, "HCAHPS Measure ID"),
        "question": c(df, "HCAHPS Question"),
        "star_rating": to_number(c(df, "Patient Survey Star Rating"), "int"),
        "linear_mean_score": to_number(c(df, "HCAHPS Linear Mean Value"), "int"),
        "completed_surveys": to_number(c(df, "Number of Completed Surveys"), "int"),
        "response_rate_pct": to_number(c(df, "Survey Response Rate Percent"), "int"),
        "period_start": to_date_us(c(df, "Start Date", "Measure Start Date")),
        "period_end": to_date_us(c(df, "End Date", "Measure End Date")),
        **_lineage(df),
    }


@HOSPITAL.node("hcahps")
def stg_survey(t: Tables) -> DataFrame:
    df = R.latest_release(t["hcahps"], "_release")
    footnotes = {
        n: F.nullif(c(df, f"{text} Footnote"), F.lit(""))
        for n, text in (
            ("star_rating_footnote", "Patient Survey Star Rating"),
            ("answer_pct_footnote", "HCAHPS Answer Percent"),
            ("completed_surveys_footnote", "Number of Completed Surveys"),
            ("response_rate_footnote", "Survey Response Rate Percent"),
        )
    }
    return _named(df, {**_survey(df), "answer_description": c(df, "HCAHPS Answer Description"), "answer_pct": to_number(c(df, "HCAHPS Answer Percent"), "int"), **footnotes})


@HOSPITAL.node("hcahps_archive")
def stg_survey_history(t: Tables) -> DataFrame:
    """Scores and stars only, dropped to a fifth of the rows before anything is cast."""
    raw = t["hcahps_archive"]
    measure = c(raw, "HCAHPS Measure ID")
    raw = raw.where(measure.endswith("_LINEAR_SCORE") | measure.endswith("_STAR_RATING"))
    df = R.latest_snapshot_per_period(raw, "_release", c(raw, "Start Date", "Measure Start Date"), c(raw, "End Date", "Measure End Date"))
    return _named(df, {**_survey(df), **{n: F.col(f"_{n}") for n in ("period_first_release", "period_snapshots")}})


@HOSPITAL.node("footnotes")
def stg_footnotes(t: Tables) -> DataFrame:
    df = R.latest_release(t["footnotes"], "_release")
    return _named(df, {"footnote_code": c(df, "Footnote"), "footnote_text": c(df, "Footnote Text")})


@HOSPITAL.node("places_county")
def stg_county_health(t: Tables) -> DataFrame:
    df = R.latest_release(t["places_county"], "_release")
    df = df.where(c(df, "StateAbbr") != "US")
    point = c(df, "Geolocation")
    number = lambda pattern: F.nullif(F.regexp_extract(point, pattern, 1), F.lit("")).cast("double")
    return _named(
        df,
        {
            "county_fips": c(df, "LocationID"),
            "county_name": c(df, "LocationName"),
            "state": c(df, "StateAbbr"),
            "state_name": c(df, "StateDesc"),
            "data_year": to_number(c(df, "Year"), "int"),
            "category_id": c(df, "CategoryID"),
            "category": c(df, "Category"),
            "measure_id": c(df, "MeasureId"),
            "measure_name": c(df, "Measure"),
            "measure_short_name": c(df, "Short_Question_Text"),
            "value_type": c(df, "DataValueTypeID"),
            "value_pct": to_number(c(df, "Data_Value")),
            "value_pct_low": to_number(c(df, "Low_Confidence_Limit")),
            "value_pct_high": to_number(c(df, "High_Confidence_Limit")),
            "is_suppressed": c(df, "Data_Value_Footnote_Symbol") == "*",
            "total_population": to_number(c(df, "TotalPopulation"), "int"),
            "adult_population": to_number(c(df, "TotalPop18plus"), "int"),
            "longitude": number(r"POINT \(([-0-9.]+) "),
            "latitude": number(r" ([-0-9.]+)\)$"),
            **_lineage(df),
        },
    )


@HOSPITAL.node("census_zcta_county")
def stg_zip_county(t: Tables) -> DataFrame:
    df = R.latest_release(t["census_zcta_county"], "_release")
    fips = c(df, "GEOID_COUNTY_20")
    return _named(
        df,
        {
            "zcta": F.nullif(c(df, "GEOID_ZCTA5_20"), F.lit("")),
            "county_fips": fips,
            "state_fips": F.left(fips, F.lit(2)),
            "county_name": c(df, "NAMELSAD_COUNTY_20"),
            "land_area_part": to_number(c(df, "AREALAND_PART"), "bigint"),
            "water_area_part": to_number(c(df, "AREAWATER_PART"), "bigint"),
            "source_release": c(df, "_release"),
        },
    )


@HOSPITAL.node("census_ct_zcta_cousub")
def stg_zip_town(t: Tables) -> DataFrame:
    df = R.latest_release(t["census_ct_zcta_cousub"], "_release")
    fips, name = c(df, "GEOID_COUSUB_22"), c(df, "NAMELSAD_COUSUB_22")
    return _named(
        df,
        {
            "zcta": F.nullif(c(df, "GEOID_ZCTA5_20"), F.lit("")),
            "town_fips": fips,
            "town_name": name,
            "planning_region_fips": F.left(fips, F.lit(5)),
            "is_town": name != "County subdivisions not defined",
            "land_area_part": to_number(c(df, "AREALAND_PART"), "bigint"),
            "source_release": c(df, "_release"),
        },
    )


@HOSPITAL.node("stg_zip_county", "stg_zip_town", "stg_county_health", layer="intermediate", view=True)
def int_zip_county(t: Tables) -> DataFrame:
    """Land of each ZIP area by county; Connecticut's towns are added up to its planning regions."""
    cols = ["zcta", "county_fips", "county_name", "land_area_part"]
    national = t["stg_zip_county"].where(F.col("zcta").isNotNull() & ~F.col("county_fips").startswith("09")).select(cols)
    regions = t["stg_county_health"].where(F.col("state") == "CT").select("county_fips", "county_name").distinct()
    towns = t["stg_zip_town"].where(F.col("zcta").isNotNull() & F.col("is_town"))
    towns = towns.groupBy("zcta", F.col("planning_region_fips").alias("county_fips")).agg(F.sum("land_area_part").alias("land_area_part"))
    towns = towns.join(regions, "county_fips", "left").withColumn("county_name", F.concat("county_name", F.lit(" Planning Region")))
    land = national.unionByName(towns.select(cols)).where(F.col("land_area_part") > 0)
    by_zip = F.count(F.lit(1)).over(R.Window.partitionBy("zcta"))
    return land.select("zcta", "county_fips", F.left("county_fips", F.lit(2)).alias("state_fips"), "county_name", "land_area_part", R.share_of_total("land_area_part", ["zcta"]).alias("land_share"), by_zip.alias("zcta_county_count"))


def survey_columns(topics: Mapping[str, str]) -> list[Column]:
    """A score and a star rating per topic, the summary star, and what all of a hospital's rows repeat."""
    scores = R.pivoted("measure_id", "linear_mean_score", {f"H_{k}_LINEAR_SCORE": f"{v}_score" for k, v in topics.items()})
    stars = R.pivoted("measure_id", "star_rating", {**{f"H_{k}_STAR_RATING": f"{v}_stars" for k, v in topics.items()}, "H_STAR_RATING": "summary_stars"})
    return [*scores, *stars, F.max("completed_surveys").alias("completed_surveys"), F.max("response_rate_pct").alias("response_rate_pct")]


@HOSPITAL.node("stg_survey", layer="intermediate", view=True)
def int_survey_scores(t: Tables) -> DataFrame:
    last = [F.max(x).alias(x) for x in ("period_start", "period_end", "source_release")]
    return t["stg_survey"].groupBy("facility_id").agg(*survey_columns(TOPICS), *last)


@HOSPITAL.node("stg_survey_history", layer="intermediate", view=True)
def int_survey_by_window(t: Tables) -> DataFrame:
    return t["stg_survey_history"].groupBy("facility_id", "period_start", "period_end").agg(*survey_columns(TOPICS | RETIRED_TOPICS), F.max("source_release").alias("source_release"))


@HOSPITAL.node("stg_hospitals", "stg_hospitals_history", layer="intermediate", view=True)
def int_profile(t: Tables) -> DataFrame:
    """Current profiles, and the last archived one of hospitals that closed."""
    now, then = t["stg_hospitals"], t["stg_hospitals_history"]
    common = ["facility_id", "facility_name", "address", "city", "state", "zip_code", "county_name", "hospital_type", "ownership", "has_emergency_services", "is_birthing_friendly", "overall_star_rating", "profile_source", "profile_date"]
    closed = R.rows_at_max(then.join(now.select("facility_id"), "facility_id", "left_anti"), ["facility_id"], "snapshot_date")
    now = now.withColumns({"profile_source": F.lit("current"), "profile_date": F.col("source_release").cast("date")})
    closed = closed.withColumns({"is_birthing_friendly": F.lit(None).cast("boolean"), "profile_source": F.lit("archive"), "profile_date": F.col("snapshot_date")})
    return now.select(common).unionByName(closed.select(common))


@HOSPITAL.node("int_profile", "stg_county_health", "stg_zip_county", "stg_zip_town", "int_zip_county", layer="intermediate", view=True)
def int_hospital_county(t: Tables) -> DataFrame:
    """Each hospital's county by the first of several ways that gives one, with the way."""
    hospitals = t["int_profile"].select("facility_id", "state", "city", "zip_code", F.col("county_name").alias("cms_county_name"), clean_county_name("county_name").alias("name_key"))
    health = t["stg_county_health"]
    states = health.select("state", F.left("county_fips", F.lit(2)).alias("state_fips")).distinct()
    listed = health.select("county_fips").distinct()
    counties = t["stg_zip_county"].select("county_fips", "state_fips", clean_county_name("county_name").alias("name_key")).distinct().join(listed, "county_fips", "left_semi")
    placed = hospitals.join(states, "state", "left")

    zips = t["int_zip_county"].select(F.col("zcta").alias("zip_code"), F.col("county_fips").alias("zip_county_fips"), F.col("state_fips").alias("zip_state_fips"), clean_county_name("county_name").alias("zip_key"), "land_share", "zcta_county_count")
    found = placed.join(zips, "zip_code").withColumn("zip_name_matches", F.col("zip_key") == F.col("name_key"))
    order = [F.col("zip_name_matches").desc_nulls_last(), (F.col("zip_state_fips") == F.col("state_fips")).desc_nulls_last(), F.col("land_share").desc_nulls_last(), F.col("zip_county_fips")]
    best = R.top_rows(found, ["facility_id"], order).select("facility_id", "zip_county_fips", "zcta_county_count", F.col("land_share").alias("zip_land_share"), "zip_name_matches")

    towns = t["stg_zip_town"].where("is_town").select(clean_county_name(F.regexp_replace("town_name", " town$", "")).alias("town_key"), F.col("planning_region_fips").alias("ct_town_region_fips")).distinct()
    single = counties.groupBy("state_fips").agg(F.count(F.lit(1)).alias("n"), F.min("county_fips").alias("single_county_fips")).where("n = 1").drop("n")
    named = R.unique_match(placed.select("facility_id", "state_fips", "name_key"), counties, ["state_fips", "name_key"], "county_fips")
    named = named.select("facility_id", F.col("county_fips").alias("name_county_fips"))
    linked = (
        placed.withColumn("town_key", F.when(F.col("state") == "CT", clean_county_name("city")))
        .join(best, "facility_id", "left")
        .join(towns, "town_key", "left")
        .join(named, "facility_id", "left")
        .join(single, "state_fips", "left")
    )
    method = R.ladder(
        [
            (F.col("state_fips").isNull(), "no_places_data"),
            (F.col("zcta_county_count") == 1, "zip_single_county"),
            (F.col("zip_name_matches"), "zip_name_agrees"),
            (F.col("zip_county_fips").isNotNull(), "zip_largest_area"),
            (F.col("ct_town_region_fips").isNotNull(), "ct_town"),
            (F.col("name_county_fips").isNotNull(), "name_only"),
            (F.col("single_county_fips").isNotNull(), "single_county_state"),
        ],
        "unmatched",
    )
    by_method = {"ct_town": "ct_town_region_fips", "name_only": "name_county_fips", "single_county_state": "single_county_fips"}
    fips = F.when(F.col("link_method").startswith("zip_"), F.col("zip_county_fips"))
    for way, column in by_method.items():
        fips = fips.when(F.col("link_method") == way, F.col(column))
    linked = linked.withColumn("link_method", method).withColumn("county_fips", fips)
    return linked.select(
        "facility_id", "state", "zip_code", "cms_county_name", "county_fips", "link_method",
        F.col("link_method").isin("zip_single_county", "zip_name_agrees").alias("is_high_confidence"),
        "zcta_county_count", "zip_land_share", "name_county_fips",
        R.differs(F.col("name_county_fips"), F.col("county_fips")).alias("name_disagrees"),
    )


@HOSPITAL.node("stg_county_health", layer="marts")
def dim_county(t: Tables) -> DataFrame:
    health = t["stg_county_health"]
    same = ("county_name", "state", "state_name", "total_population", "adult_population", "latitude", "longitude", "source_release")
    counties = health.groupBy("county_fips").agg(*[F.any_value(x, True).alias(x) for x in same])
    values = R.pivoted("measure_id", "value_pct", {k: f"{v}_pct" for k, v in (CHRONIC | SOCIAL).items()})
    years = R.pivoted("measure_id", "data_year", {"DIABETES": "chronic_data_year", "LACKTRPT": "social_data_year"})
    adjusted = health.where(F.col("value_type") == "AgeAdjPrv").groupBy("county_fips").agg(*values, *years)
    flags = {f"has_{x}_measures": F.col(f"{x}_data_year").isNotNull() for x in ("chronic", "social")}
    return counties.join(adjusted, "county_fips", "left").withColumns(flags)


@HOSPITAL.node("int_profile", "stg_results", "stg_results_history", "stg_payment_adjustments", "int_hospital_county", layer="marts")
def dim_hospital(t: Tables) -> DataFrame:
    """Every hospital that any source knows."""
    key = "facility_id"
    named = lambda df, tag: df.groupBy(key).agg(F.any_value("facility_name", True).alias(f"{tag}_name"), F.any_value("state", True).alias(f"{tag}_state"), F.lit(True).alias(f"in_{tag}"))
    profile = t["int_profile"].withColumnsRenamed({"county_name": "cms_county_name"}).withColumn("has_hospital_profile", F.lit(True))
    paid = t["stg_payment_adjustments"]
    latest = paid.where("is_latest_fiscal_year").select(key, F.lit(True).alias("in_calculation")).distinct()
    link = t["int_hospital_county"].select(key, "county_fips", "link_method", "is_high_confidence", "name_disagrees")
    everyone = R.key_union([profile, t["stg_results"], t["stg_results_history"], paid], key)
    whole = everyone
    for side in (profile, named(t["stg_results"], "now"), named(t["stg_results_history"], "past"), latest, link):
        whole = whole.join(side, key, "left")
    has = lambda x: F.coalesce(F.col(x), F.lit(False))
    return whole.select(
        key,
        F.coalesce("facility_name", "now_name", "past_name").alias("facility_name"),
        "address", "city", F.coalesce("state", "now_state", "past_state").alias("state"), "zip_code", "cms_county_name", "county_fips",
        F.coalesce("link_method", F.lit("no_hospital_profile")).alias("county_link_method"),
        has("is_high_confidence").alias("is_county_link_high_confidence"),
        F.col("name_disagrees").alias("county_name_disagrees"),
        "hospital_type", "ownership", "has_emergency_services", "is_birthing_friendly", "overall_star_rating",
        has("has_hospital_profile").alias("has_hospital_profile"), "profile_source",
        (F.coalesce(F.col("profile_source") == "current", F.lit(False)) | has("in_now") | has("in_calculation")).alias("is_active"),
        has("in_now").alias("is_hrrp_hospital"), has("in_calculation").alias("is_in_penalty_calculation"), "profile_date",
    )


def fiscal_year_of(start: Column) -> Column:
    """A readmission period counts for the fiscal year that begins in the fourth year after its start."""
    return F.concat(F.lit("FY"), (F.year(start) + 5).cast("string"))


@HOSPITAL.node("stg_results_history", "stg_survey_history", "stg_payment_adjustments", layer="marts")
def dim_fiscal_year(t: Tables) -> DataFrame:
    """Fiscal years with their readmission period and the survey window that ends last within it."""
    periods = t["stg_results_history"].groupBy("period_start", "period_end").agg(F.any_value("period_first_release", True).cast("date").alias("readmission_results_published"))
    periods = periods.withColumnsRenamed({"period_start": "readmission_period_start", "period_end": "readmission_period_end"})
    survey = t["stg_survey_history"].select(F.col("period_start").alias("survey_period_start"), F.col("period_end").alias("survey_period_end"))
    aligned = R.asof_window(periods, survey, "readmission_period_end", "survey_period_start", "survey_period_end")
    year = F.year("readmission_period_start")
    rows = aligned.withColumns(
        {
            "fiscal_year": fiscal_year_of(F.col("readmission_period_start")),
            "fiscal_year_start": F.make_date(year + 4, F.lit(10), F.lit(1)),
            "fiscal_year_end": F.make_date(year + 5, F.lit(9), F.lit(30)),
            "survey_period_months": R.months_between_starts(F.col("survey_period_start"), F.date_add("survey_period_end", 1)),
            "survey_ends_days_before_readmissions": F.datediff("readmission_period_end", "survey_period_end"),
        }
    )
    paid = t["stg_payment_adjustments"].select("fiscal_year", F.lit(True).alias("has_payment_file")).distinct()
    rows = rows.join(paid, "fiscal_year", "left").withColumn("has_payment_file", F.coalesce("has_payment_file", F.lit(False)))
    return R.latest_flag(rows, "fiscal_year", "is_latest_fiscal_year")


@HOSPITAL.node("stg_results_history", "stg_peer_comparisons", layer="marts")
def fct_readmissions(t: Tables) -> DataFrame:
    """Results by hospital, condition and fiscal year, of the public file and the payment file."""
    keys = ["facility_id", "condition", "fiscal_year"]
    public = t["stg_results_history"].withColumn("fiscal_year", fiscal_year_of(F.col("period_start"))).select(
        *keys, "discharges", "readmissions", "readmissions_suppressed", "predicted_readmission_rate", "expected_readmission_rate", "excess_readmission_ratio", "score_status", "footnote_code"
    )
    payment = t["stg_peer_comparisons"].withColumnsRenamed({"excess_readmission_ratio": "payment_excess_readmission_ratio", "is_above_peer_median": "counts_toward_penalty"})
    both = R.outer_sources(public, payment, keys, "in_public_file", "in_payment_file")
    excess = F.col("drg_payment_ratio") * (F.col("payment_excess_readmission_ratio") - F.col("peer_group_median_err"))
    start = F.make_date(F.substring("fiscal_year", 3, 4).cast("int") - 1, F.lit(10), F.lit(1))
    return both.withColumns({"fiscal_year_start": start, "penalty_contribution": F.when(F.col("counts_toward_penalty"), excess).when(F.col("in_payment_file"), F.lit(0.0))})


@HOSPITAL.node("fct_readmissions", "dim_fiscal_year", "stg_hospitals_history", "stg_payment_adjustments", "int_survey_by_window", layer="marts")
def fct_hospital_year(t: Tables) -> DataFrame:
    """Hospital years: results rolled up, payment, the aligned survey, and the profile nearest to the period's end."""
    keys = ["fiscal_year", "facility_id"]
    rolled = t["fct_readmissions"].groupBy(*keys).agg(
        F.count("excess_readmission_ratio").alias("conditions_with_public_ratio"),
        F.count(F.when(F.col("counts_toward_penalty"), 1)).alias("conditions_counting_toward_penalty"),
        F.sum("discharges").alias("public_discharges"),
        F.sum("penalty_contribution").alias("unadjusted_penalty"),
    )
    years = t["dim_fiscal_year"].select("fiscal_year", "fiscal_year_start", "readmission_period_end", "survey_period_start", "survey_period_end")
    dated = rolled.join(years, "fiscal_year")
    profile = ["hospital_type", "ownership", "has_emergency_services"]
    history = t["stg_hospitals_history"].select("facility_id", "snapshot_date", *profile)
    dated = R.nearest_snapshot(dated, history, ["facility_id"], "readmission_period_end", "snapshot_date", profile).withColumnRenamed("snapshot_date", "profile_snapshot_date")
    paid = t["stg_payment_adjustments"].drop("is_latest_fiscal_year", "ingested_at").withColumn("in_payment_file", F.lit(True))
    survey = t["int_survey_by_window"].drop("source_release").withColumnsRenamed({"period_start": "survey_period_start", "period_end": "survey_period_end"}).withColumn("has_survey_scores", F.lit(True))
    whole = dated.join(paid, keys, "left").join(survey, ["facility_id", "survey_period_start", "survey_period_end"], "left")
    return whole.withColumns({x: F.coalesce(x, F.lit(False)) for x in ("in_payment_file", "has_survey_scores")}).drop("readmission_period_end")


#: Years between a hospital year and the earlier one that shares no patients with it.
PRIOR_YEARS = 3


@HOSPITAL.node("fct_hospital_year", "fct_readmissions", "dim_fiscal_year", "dim_hospital", "dim_county", "stg_payment_adjustments", layer="ml")
def ml_penalty_features(t: Tables) -> DataFrame:
    """Hospital years with a payment result, features known before, and a split without shared patients."""
    keys = ["facility_id", "fiscal_year"]
    later = lambda df: R.shifted(df, "fiscal_year", PRIOR_YEARS, lambda x: F.substring(x, 3, 4).cast("int"), lambda x: F.concat(F.lit("FY"), x.cast("string")))
    results, paid = t["fct_readmissions"], t["stg_payment_adjustments"]
    years = t["dim_fiscal_year"].select("fiscal_year", "readmission_period_start", "readmission_period_end")
    last = paid.agg(F.max("fiscal_year").alias("fiscal_year"))
    test = years.join(last, "fiscal_year").select(F.col("fiscal_year").alias("__test"), F.col("readmission_period_start").alias("__from"))
    cases = F.col("eligible_discharges")
    volume = results.where("in_payment_file").groupBy(*keys).agg(F.sum(cases).cast("int").alias("eligible_discharges"), F.count(F.when(cases >= 25, 1)).cast("int").alias("conditions_with_25_cases"))
    scored = results.where(F.col("excess_readmission_ratio").isNotNull() & (F.col("discharges") > 0))
    scored = scored.groupBy(*keys).agg(R.weighted_mean("excess_readmission_ratio", "discharges").alias("prior_weighted_err"), F.count("excess_readmission_ratio").cast("int").alias("prior_conditions_scored"))
    penalties = paid.select(*keys, F.col("payment_reduction_pct").alias("prior_payment_reduction_pct"))
    county = t["dim_county"].select("county_fips", F.col("total_population").alias("county_population"), *[F.col(f"{v}_pct").alias(f"county_{v}_pct") for v in (CHRONIC | SOCIAL).values()])
    home = t["dim_hospital"].select("facility_id", "county_fips")
    rows = t["fct_hospital_year"].where("in_payment_file").join(years, "fiscal_year").crossJoin(F.broadcast(test))
    split = F.when(F.col("fiscal_year") == F.col("__test"), "test").when(F.col("readmission_period_end") < F.col("__from"), "train").otherwise("overlap_unused")
    rows = rows.withColumn("split", split).join(volume, keys).join(home, "facility_id")
    rows = rows.join(county, "county_fips", "left").join(later(scored), keys, "left").join(later(penalties), keys, "left")
    rows = top_share_flag(rows, ["fiscal_year"], "payment_reduction_pct", 0.75, "is_top_quarter_penalty")
    scores = [f"{v}_score" for v in (TOPICS | RETIRED_TOPICS).values()]
    return rows.select(
        *keys, "split", "payment_reduction_pct", "is_penalized", "is_top_quarter_penalty", "eligible_discharges", "conditions_with_25_cases", "dual_proportion", "peer_group",
        "has_survey_scores", *scores, "completed_surveys", "response_rate_pct", "ownership", "has_emergency_services", "county_population",
        *[f"county_{v}_pct" for v in (CHRONIC | SOCIAL).values()], "prior_weighted_err", "prior_conditions_scored", "prior_payment_reduction_pct",
    )


#: The days that the calendar covers, the last not included.
SPINE = ("2018-01-01", "2031-01-01")


@HOSPITAL.node("hrrp", layer="marts")
def time_spine(t: Tables) -> DataFrame:
    return R.calendar(t["hrrp"].sparkSession, *SPINE)


# Checks

#: Hospitals whose county is known for certain.
GOLDEN_COUNTIES = {"210009": "24510", "260032": "29510", "490007": "51710", "490009": "51540", "070022": "09170"}

#: The smallest share of profiled hospitals with a county, and of hospital years of a year with a survey window that have scores.
LEAST_LINKED, LEAST_SURVEYED = 0.995, 0.99

_FORM = {"facility_id": "[0-9A-Z]{6}"}
_YEAR = {"fiscal_year": "FY20[0-9]{2}"}
_LINKS = ["zip_single_county", "zip_name_agrees", "zip_largest_area", "ct_town", "name_only", "single_county_state", "no_places_data", "unmatched"]
_FIPS = {"county_fips": "[0-9]{5}"}
_RESULT = {
    "key": ("facility_id", "condition", "period_start"),
    "not_null": ("facility_id", "measure_id", "condition", "period_start", "period_end", "score_status", "source_release", "ingested_at"),
    "form": _FORM,
    "accepted": {"condition": list(CONDITIONS), "score_status": ["scored", *STATUS.values()]},
    "ranges": {"excess_readmission_ratio": (0.3, 3), "predicted_readmission_rate": (0, 100), "expected_readmission_rate": (0, 100), "discharges": (0, None), "readmissions": (0, None)},
    "rules": {"ends_after_start": "period_end > period_start", "scored_has_ratio": "(score_status = 'scored') = (excess_readmission_ratio is not null)"},
}
_RATED = {"overall_star_rating": (1, 5)}
_SURVEYED = {"star_rating": (1, 5), "linear_mean_score": (0, 100), "completed_surveys": (0, None), "response_rate_pct": (0, 100)}

#: Rules by table. ``key``: unique together; ``not_null``; ``form``: a pattern for the whole value; ``accepted`` values; ``ranges`` with either end
#: open; ``parents``: column to (table, column); ``rules`` in SQL, which fail where they are false. Names in ``warn`` do not stop what follows.
RULES: dict[str, dict] = {
    "stg_results": {**_RESULT, "key": ("facility_id", "condition"), "warn": ("score_status", "excess_readmission_ratio")},
    "stg_results_history": {**_RESULT, "rules": {**_RESULT["rules"], "first_release_first": "period_first_release <= source_release"}, "warn": ("score_status", "excess_readmission_ratio")},
    "stg_payment_adjustments": {
        "key": ("facility_id", "fiscal_year"),
        "not_null": ("facility_id", "fiscal_year", "payment_adjustment_factor", "payment_reduction_pct", "is_penalized"),
        "form": _FORM | _YEAR,
        "ranges": {"payment_adjustment_factor": (0.97, 1), "payment_reduction_pct": (0, 3), "dual_proportion": (0, 1), "peer_group": (1, 5), "neutrality_modifier": (0.5, 1.5)},
        "rules": {"factor_is_reduction": "abs((1 - payment_adjustment_factor) * 100 - payment_reduction_pct) <= 0.011", "penalized_has_reduction": "is_penalized = (payment_reduction_pct > 0)"},
        "warn": ("dual_proportion", "neutrality_modifier", "penalized_has_reduction"),
    },
    "stg_peer_comparisons": {
        "key": ("facility_id", "fiscal_year", "condition"),
        "not_null": ("facility_id", "fiscal_year", "condition", "eligible_discharges"),
        "accepted": {"condition": list(CONDITIONS)},
        "parents": {"facility_id": ("stg_payment_adjustments", "facility_id")},
        "ranges": {"eligible_discharges": (0, None), "excess_readmission_ratio": (0.3, 3), "peer_group_median_err": (0.5, 1.5), "drg_payment_ratio": (0, 1)},
        "rules": {"flag_above_median": "not is_above_peer_median or excess_readmission_ratio > peer_group_median_err", "flag_has_25_cases": "not is_above_peer_median or eligible_discharges >= 25"},
        "warn": ("excess_readmission_ratio", "flag_has_25_cases"),
    },
    "stg_hospitals": {"key": ("facility_id",), "not_null": ("facility_id", "facility_name", "state", "source_release"), "form": _FORM | {"zip_code": "[0-9]{5}"}, "ranges": _RATED, "warn": ("zip_code",)},
    "stg_hospitals_history": {"key": ("facility_id", "snapshot_date"), "not_null": ("facility_id", "snapshot_date"), "form": _FORM, "ranges": _RATED, "warn": ("facility_id",)},
    "stg_survey": {"not_null": ("facility_id", "measure_id", "period_start", "period_end"), "form": _FORM | {"measure_id": "H_[A-Z0-9_]+"}, "ranges": _SURVEYED, "rules": {"ends_after_start": "period_end > period_start"}},
    "stg_survey_history": {"not_null": ("facility_id", "measure_id", "period_start", "period_end"), "form": _FORM | {"measure_id": "H_[A-Z0-9_]+_(?:LINEAR_SCORE|STAR_RATING)"}, "ranges": _SURVEYED, "rules": {"ends_after_start": "period_end > period_start"}},
    "stg_footnotes": {"key": ("footnote_code",), "not_null": ("footnote_code", "footnote_text")},
    "stg_county_health": {
        "key": ("county_fips", "measure_id", "value_type"),
        "not_null": ("county_fips", "county_name", "state", "measure_id", "value_type"),
        "form": _FIPS | {"state": "[A-Z]{2}"},
        "accepted": {"value_type": ["AgeAdjPrv", "CrdPrv"]},
        "ranges": {"value_pct": (0, 100), "total_population": (1, None), "adult_population": (0, None), "latitude": (-90, 90), "longitude": (-180, 180)},
        "rules": {"suppressed_has_no_value": "not is_suppressed or value_pct is null"},
    },
    "stg_zip_county": {"not_null": ("county_fips", "county_name"), "form": _FIPS | {"zcta": "[0-9]{5}"}, "ranges": {"land_area_part": (0, None), "water_area_part": (0, None)}},
    "stg_zip_town": {"not_null": ("town_fips", "town_name", "planning_region_fips"), "form": {"town_fips": "[0-9]{10}"}, "ranges": {"land_area_part": (0, None)}},
    "int_zip_county": {"key": ("zcta", "county_fips"), "not_null": ("zcta", "county_fips", "county_name"), "ranges": {"land_share": (0, 1.0000001), "zcta_county_count": (1, None)}},
    "int_survey_scores": {"key": ("facility_id",), "not_null": ("facility_id", "period_end")},
    "int_survey_by_window": {"key": ("facility_id", "period_start", "period_end"), "not_null": ("facility_id",)},
    "int_profile": {"key": ("facility_id",), "not_null": ("facility_id", "profile_source", "profile_date"), "accepted": {"profile_source": ["current", "archive"]}},
    "int_hospital_county": {
        "key": ("facility_id",),
        "not_null": ("facility_id", "link_method", "is_high_confidence"),
        "accepted": {"link_method": _LINKS},
        "ranges": {"zip_land_share": (0, 1.0000001)},
        "rules": {"a_way_has_a_county": "link_method in ('no_places_data', 'unmatched') or county_fips is not null", "sure_ways_only": "not is_high_confidence or link_method in ('zip_single_county', 'zip_name_agrees')"},
    },
    "dim_county": {"key": ("county_fips",), "not_null": ("county_fips", "county_name", "state", "has_chronic_measures", "has_social_measures"), "form": _FIPS, "ranges": {f"{v}_pct": (0, 100) for v in (CHRONIC | SOCIAL).values()}},
    "dim_hospital": {
        "key": ("facility_id",),
        "not_null": ("facility_id", "county_link_method", "has_hospital_profile", "is_active", "is_hrrp_hospital", "is_in_penalty_calculation"),
        "form": _FORM,
        "accepted": {"county_link_method": [*_LINKS, "no_hospital_profile"], "profile_source": ["current", "archive"]},
        "parents": {"county_fips": ("dim_county", "county_fips")},
        "ranges": _RATED,
        "rules": {"current_is_active": "coalesce(profile_source, '') <> 'current' or is_active", "profiled_has_source": "has_hospital_profile = (profile_source is not null)"},
        "warn": ("county_fips", "facility_id_form"),
    },
    "dim_fiscal_year": {
        "key": ("fiscal_year",),
        "not_null": ("fiscal_year", "fiscal_year_start", "fiscal_year_end", "readmission_period_start", "readmission_period_end", "has_payment_file", "is_latest_fiscal_year"),
        "form": _YEAR,
        "ranges": {"survey_period_months": (1, 12), "survey_ends_days_before_readmissions": (0, None)},
        "rules": {"period_before_year": "readmission_period_end < fiscal_year_start"},
        "warn": ("survey_period_months",),
    },
    "fct_readmissions": {
        "key": ("facility_id", "condition", "fiscal_year"),
        "not_null": ("facility_id", "condition", "fiscal_year", "fiscal_year_start", "in_public_file", "in_payment_file"),
        "accepted": {"condition": list(CONDITIONS), "score_status": ["scored", *STATUS.values(), "unknown"]},
        "parents": {"facility_id": ("dim_hospital", "facility_id"), "fiscal_year": ("dim_fiscal_year", "fiscal_year")},
        "rules": {
            "in_some_file": "in_public_file or in_payment_file", "public_has_status": "not in_public_file or score_status is not null", "counting_has_contribution": "not counts_toward_penalty or penalty_contribution is not null",
            "contribution_not_negative": "penalty_contribution >= 0", "same_ratio_in_both": "abs(excess_readmission_ratio - payment_excess_readmission_ratio) <= 0.0001",
        },
        "warn": ("same_ratio_in_both", "contribution_not_negative", "facility_id_parent"),
    },
    "fct_hospital_year": {
        "key": ("facility_id", "fiscal_year"),
        "not_null": ("facility_id", "fiscal_year", "in_payment_file", "has_survey_scores"),
        "parents": {"facility_id": ("dim_hospital", "facility_id"), "fiscal_year": ("dim_fiscal_year", "fiscal_year")},
        "ranges": {**{f"{v}_score": (0, 100) for v in (TOPICS | RETIRED_TOPICS).values()}, **{f"{v}_stars": (1, 5) for v in (TOPICS | RETIRED_TOPICS).values()}, "summary_stars": (1, 5), "payment_reduction_pct": (0, 3)},
        "rules": {"paid_has_reduction": "not in_payment_file or payment_reduction_pct is not null", "no_more_than_six_conditions": f"conditions_with_public_ratio <= {len(CONDITIONS)}"},
    },
    "ml_penalty_features": {
        "key": ("facility_id", "fiscal_year"),
        "not_null": ("facility_id", "fiscal_year", "split", "payment_reduction_pct", "is_penalized", "eligible_discharges", "conditions_with_25_cases"),
        "accepted": {"split": ["train", "overlap_unused", "test"]},
        "ranges": {"payment_reduction_pct": (0, 3), "dual_proportion": (0, 1), "conditions_with_25_cases": (0, len(CONDITIONS)), "prior_conditions_scored": (0, len(CONDITIONS)), "prior_payment_reduction_pct": (0, 3)},
        "warn": ("dual_proportion",),
    },
    "time_spine": {"key": ("date_day",), "not_null": ("date_day",)},
}


def _severity(table: str, name: str, column: str) -> str:
    warn = RULES[table].get("warn", ())
    return "warn" if column in warn or name in warn else "error"


def row_rules(table: str) -> dict[str, tuple[Column, str]]:
    """The rules on single rows of a table: what is wrong with a row, and the severity."""
    own, made = RULES.get(table, {}), {}
    for x in own.get("not_null", ()):
        made[f"{x}_not_null"] = (x, F.col(x).isNull())
    for x, pattern in own.get("form", {}).items():
        made[f"{x}_form"] = (x, ~F.col(x).rlike(f"^(?:{pattern})$"))
    for x, values in own.get("accepted", {}).items():
        made[f"{x}_accepted"] = (x, ~F.col(x).isin(*values))
    for x, (low, high) in own.get("ranges", {}).items():
        outside = [F.col(x) < low] * (low is not None) + [F.col(x) > high] * (high is not None)
        made[f"{x}_range"] = (x, reduce(lambda a, b: a | b, outside))
    for name, rule in own.get("rules", {}).items():
        made[name] = (name, ~F.expr(rule))
    return {f"{table}.{name}": (bad, _severity(table, name, x)) for name, (x, bad) in made.items()}


def table_rules(table: str, t: Tables) -> dict[str, tuple[DataFrame, str]]:
    """The rules on keys and parents: the rows that break each, and the severity. A rule on another table counts where that is built."""
    df, own, made = t[table], RULES.get(table, {}), {}
    if "key" in own:
        made["key"] = ("key", checks.unique(df, *own["key"]))
    for x, (parent, column) in own.get("parents", {}).items():
        if parent in t:
            made[f"{x}_parent"] = (x, checks.relationship(df, x, t[parent], column))
    return {f"{table}.{name}": (failing, _severity(table, name, x)) for name, (x, failing) in made.items()}


def survey_after_period(years: DataFrame) -> DataFrame:
    """Leakage: a survey window that ends after the readmission period does."""
    return years.where(F.col("survey_period_end") > F.col("readmission_period_end"))


def shared_patients(features: DataFrame, years: DataFrame) -> DataFrame:
    """Leakage: training rows whose readmission period is not over before that of the test year begins."""
    periods = years.select("fiscal_year", "readmission_period_start", "readmission_period_end")
    dated = features.select("facility_id", "fiscal_year", "split").join(periods, "fiscal_year")
    begins = dated.where("split = 'test'").agg(F.min("readmission_period_start").alias("__from"))
    return dated.where("split = 'train'").crossJoin(F.broadcast(begins)).where(F.col("readmission_period_end") >= F.col("__from")).drop("__from")


def prior_after_target(features: DataFrame, years: DataFrame, by: int = PRIOR_YEARS) -> DataFrame:
    """Leakage: rows with earlier results whose period is not over before the row's own begins."""
    number = F.substring("fiscal_year", 3, 4).cast("int")
    earlier = years.select(F.concat(F.lit("FY"), (number + by).cast("string")).alias("fiscal_year"), F.col("readmission_period_end").alias("prior_period_end"))
    known = features.where(F.col("prior_payment_reduction_pct").isNotNull() | F.col("prior_weighted_err").isNotNull()).select("facility_id", "fiscal_year")
    dated = known.join(earlier, "fiscal_year", "left").join(years.select("fiscal_year", "readmission_period_start"), "fiscal_year")
    return dated.where(F.col("prior_period_end").isNull() | (F.col("prior_period_end") >= F.col("readmission_period_start")))


def penalties_off(years: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Hospital years whose published reduction is not what their results give: the contributions times the modifier, at most 3 percent."""
    computed = F.least(F.col("unadjusted_penalty") * F.col("neutrality_modifier") * 100, F.lit(3.0))
    return checks.recomputes(years.where("in_payment_file"), F.col("payment_reduction_pct"), computed, tolerance)


def missing_conditions(peers: DataFrame) -> DataFrame:
    """(year, condition) that a payment file lacks; pneumonia is rightly absent from that of FY2023."""
    every = peers.select("fiscal_year").distinct().select("fiscal_year", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"))
    lost = every.join(peers.select("fiscal_year", "condition").distinct(), ["fiscal_year", "condition"], "left_anti")
    return lost.where("not (fiscal_year = 'FY2023' and condition = 'PN')")


def singular_checks(table: str, t: Tables) -> dict[str, tuple[DataFrame, str]]:
    """Checks of a table that look at more than one column or table."""
    made: dict[str, tuple[DataFrame, str]] = {}
    if table == "stg_results_history":
        history = t[table]
        periods = history.groupBy("source_release").agg(F.count_distinct("period_start", "period_end").alias("periods"))
        made["one_period_per_release"] = (periods.where("periods > 1"), "error")
        same = ["facility_id", "condition", "excess_readmission_ratio", "discharges"]
        last = history.where(F.col("period_start") == history.agg(F.max("period_start")).scalar())
        made["history_ends_as_live"] = (checks.same_rows(t["stg_results"].select(same), last.select(same)), "warn")
    if table == "stg_peer_comparisons":
        made["conditions_per_year"] = (missing_conditions(t[table]), "warn")
    if table == "dim_county":
        adjusted = t["stg_county_health"].where("value_type = 'AgeAdjPrv' and value_pct is not null")
        made["pivot_keeps_values"] = (checks.pivot_keeps_values(adjusted, "county_fips", "measure_id", "value_pct", t[table], {k: f"{v}_pct" for k, v in (CHRONIC | SOCIAL).items()}), "error")
    if table == "dim_hospital":
        df = t[table]
        made["covers_sources"] = (checks.covers(df, "facility_id", [t["stg_results"], t["stg_results_history"], t["stg_payment_adjustments"], t["int_profile"]]), "error")
        made["golden_counties"] = (checks.golden(df, "facility_id", "county_fips", GOLDEN_COUNTIES), "warn")
        made["counties_linked"] = (checks.share_at_least(df.where("has_hospital_profile"), F.col("county_fips").isNotNull(), LEAST_LINKED), "warn")
    if table == "dim_fiscal_year":
        made["no_survey_after_period"] = (survey_after_period(t[table]), "error")
    if table == "fct_readmissions":
        keys = ["facility_id", "condition", "fiscal_year"]
        public = t["stg_results_history"].select("facility_id", "condition", fiscal_year_of(F.col("period_start")).alias("fiscal_year"))
        lost = public.unionByName(t["stg_peer_comparisons"].select(keys)).join(t[table].select(keys), keys, "left_anti")
        made["covers_sources"] = (lost, "error")
    if table == "fct_hospital_year":
        made["penalty_recomputes"] = (penalties_off(t[table]), "warn")
        paid = t[table].where("in_payment_file and survey_period_end is not null").groupBy("fiscal_year").agg(F.avg(F.col("has_survey_scores").cast("int")).alias("share"))
        made["surveys_cover_year"] = (paid.where(F.col("share") < LEAST_SURVEYED), "warn")
    if table == "ml_penalty_features":
        made["no_shared_patients"] = (shared_patients(t[table], t["dim_fiscal_year"]), "error")
        made["prior_before_target"] = (prior_after_target(t[table], t["dim_fiscal_year"]), "error")
        made["covers_payments"] = (t["stg_payment_adjustments"].join(t[table], ["facility_id", "fiscal_year"], "left_anti"), "warn")
    return {f"{table}.{name}": check for name, check in made.items()}


def _checked(table: str) -> None:
    def rule(s: checks.Suite, t: Tables) -> None:
        s.add_rows(t[table], row_rules(table))
        for name, (failing, severity) in (table_rules(table, t) | singular_checks(table, t)).items():
            s.add(name, failing, severity)

    HOSPITAL.check(table)(rule)


for _table in HOSPITAL.nodes:
    _checked(_table)
