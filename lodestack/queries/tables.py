"""The test tables in the shapes that models and metrics work on, as plans and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.values import to_date_us, to_number, try_number
from lodestack.operators import relations as R
from lodestack.operators.ranking import last_row
from lodestack.session import table

NO_VALUE = "({0} is null or trim({0}) in ('', 'N/A', 'Not Available', 'Not Applicable', 'Too Few to Report', '.'))"
TOPICS = ("NURSE", "DOCTOR", "CLEAN", "QUIET", "STAFF", "LEAVE", "OVERALL")
LAYER_TOPICS = {"recommend": "STAFF", "overall_rating": "OVERALL", "care_transition": "NURSE", "discharge_information": "LEAVE"}


def number_sql(c: str, kind: str = "double") -> str:
    return f"case when not {NO_VALUE.format(c)} then cast(regexp_replace(trim({c}), '[,%]', '', 'g') as {kind}) end"


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """Survey rows with numbers and dates, each delivered row once."""
    raw = table(spark, folder, "hcahps_archive")
    return raw.select(
        "facility_id",
        F.col("hcahps_measure_id").alias("measure_id"),
        to_number("patient_survey_star_rating", "int").alias("star_rating"),
        to_number("hcahps_linear_mean_value", "int").alias("linear_mean_score"),
        to_number("number_of_completed_surveys", "int").alias("completed_surveys"),
        to_number("survey_response_rate_percent", "int").alias("response_rate_pct"),
        to_date_us("start_date").alias("period_start"),
        to_date_us("end_date").alias("period_end"),
        "source_release",
    )


SURVEY_SQL = f"""
survey as (
    select facility_id, hcahps_measure_id as measure_id, {number_sql('patient_survey_star_rating', 'int')} as star_rating,
           {number_sql('hcahps_linear_mean_value', 'int')} as linear_mean_score, {number_sql('number_of_completed_surveys', 'int')} as completed_surveys,
           {number_sql('survey_response_rate_percent', 'int')} as response_rate_pct,
           strptime(start_date, '%m/%d/%Y')::date as period_start, strptime(end_date, '%m/%d/%Y')::date as period_end, source_release
    from hcahps_archive
)"""


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """The last ingested row of each hospital year, with the reduction derived where it is not published."""
    columns = ["payment_adjustment_factor", "payment_reduction_pct", "dual_proportion", "peer_group", "neutrality_modifier"]
    rows = last_row(table(spark, folder, "payment_adjustments"), ["facility_id", "fiscal_year"], columns, ["ingested_at"])
    factor = F.col("payment_adjustment_factor")
    return rows.withColumns(
        {
            "payment_reduction_is_derived": F.col("payment_reduction_pct").isNull(),
            "payment_reduction_pct": F.coalesce("payment_reduction_pct", F.round((1 - factor) * 100, 4)),
            "is_penalized": factor < 1,
        }
    )


PAYMENTS_SQL = """
payments as (
    select facility_id, fiscal_year, payment_adjustment_factor, coalesce(payment_reduction_pct, round((1 - payment_adjustment_factor) * 100, 4)) as payment_reduction_pct,
           payment_reduction_pct is null as payment_reduction_is_derived, payment_adjustment_factor < 1 as is_penalized, dual_proportion, peer_group, neutrality_modifier
    from payment_adjustments
    qualify row_number() over (partition by facility_id, fiscal_year order by ingested_at desc, peer_group desc nulls last, payment_adjustment_factor desc) = 1
)"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fct_readmissions").distinct()


FACTS_SQL = "\nfacts as (select distinct * from fct_readmissions)"


def survey_by_window(spark: SparkSession, folder: str) -> DataFrame:
    scores = R.pivoted("measure_id", "linear_mean_score", {f"H_{t}_LINEAR_SCORE": f"{t.lower()}_score" for t in TOPICS})
    stars = R.pivoted("measure_id", "star_rating", {f"H_{t}_STAR_RATING": f"{t.lower()}_stars" for t in TOPICS})
    rest = [F.max(x).alias(x) for x in ("completed_surveys", "response_rate_pct", "source_release")]
    return survey(spark, folder).groupBy("facility_id", "period_start", "period_end").agg(*scores, *stars, *rest)


WINDOW_SQL = f"""
by_window as (
    select facility_id, period_start, period_end,
           {', '.join(f"max(linear_mean_score) filter (where measure_id = 'H_{t}_LINEAR_SCORE') as {t.lower()}_score" for t in TOPICS)},
           {', '.join(f"max(star_rating) filter (where measure_id = 'H_{t}_STAR_RATING') as {t.lower()}_stars" for t in TOPICS)},
           max(completed_surveys) as completed_surveys, max(response_rate_pct) as response_rate_pct, max(source_release) as source_release
    from survey group by all
)"""


def years(spark: SparkSession, folder: str) -> DataFrame:
    """Fiscal years with the survey window that ends last on or before the year's start."""
    own = table(spark, folder, "fct_readmissions").select("fiscal_year", "fiscal_year_start").distinct()
    windows = survey(spark, folder).select(F.col("period_start").alias("survey_start"), F.col("period_end").alias("survey_end"))
    return R.latest_flag(R.asof_window(own, windows, "fiscal_year_start", "survey_start", "survey_end"), "fiscal_year", "is_latest_fiscal_year")


YEARS_SQL = """
years as (
    select y.fiscal_year, y.fiscal_year_start, arg_max(w.period_start, (w.period_end, -epoch(w.period_start))) as survey_start, max(w.period_end) as survey_end,
           y.fiscal_year = (select max(fiscal_year) from fct_readmissions) as is_latest_fiscal_year
    from (select distinct fiscal_year, fiscal_year_start from fct_readmissions) y
    left join (select distinct period_start, period_end from survey) w on w.period_end <= y.fiscal_year_start
    group by all
)"""


def hospitals(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["facility_name", "city", "state", "hospital_type", "hospital_ownership", "emergency_services", "hospital_overall_rating", "name_county_fips"]
    rows = last_row(table(spark, folder, "hospital_info"), ["facility_id"], columns, ["ingested_at"])
    return rows.select(
        "facility_id", "facility_name", "city", "state", "hospital_type", F.col("hospital_ownership").alias("ownership"), (F.col("emergency_services") == "Yes").alias("has_emergency_services"),
        try_number("hospital_overall_rating", "int").alias("overall_star_rating"), F.col("name_county_fips").alias("county_fips"), F.lit(True).alias("is_hrrp_hospital"),
    )


HOSPITALS_SQL = f"""
hospitals as (
    select facility_id, facility_name, city, state, hospital_type, hospital_ownership as ownership, emergency_services = 'Yes' as has_emergency_services,
           {number_sql('hospital_overall_rating', 'int')} as overall_star_rating, name_county_fips as county_fips, true as is_hrrp_hospital
    from hospital_info
    qualify row_number() over (partition by facility_id order by ingested_at desc) = 1
)"""


def hospital_years(spark: SparkSession, folder: str) -> DataFrame:
    """Hospital years of either file, with payment, the aligned survey and counts of results."""
    keys = ["fiscal_year", "facility_id"]
    rolled = facts(spark, folder).groupBy(*keys).agg(F.count("excess_readmission_ratio").alias("conditions_with_ratio"), F.sum("discharges").alias("public_discharges"))
    own = rolled.join(years(spark, folder).select("fiscal_year", "survey_start", "survey_end"), "fiscal_year")
    paid = payments(spark, folder).withColumn("in_payment_file", F.lit(True))
    scores = survey_by_window(spark, folder).withColumnsRenamed({"period_start": "survey_start", "period_end": "survey_end"}).drop("source_release")
    whole = own.join(paid, keys, "left").join(scores, ["facility_id", "survey_start", "survey_end"], "left")
    return whole.withColumn("in_payment_file", F.coalesce("in_payment_file", F.lit(False))).withColumns({f"{n}_score": F.col(f"{t.lower()}_score") for n, t in LAYER_TOPICS.items()})


HOSPITAL_YEARS_SQL = f"""
hospital_years as (
    select r.fiscal_year, r.facility_id, r.conditions_with_ratio, r.public_discharges, y.survey_start, y.survey_end, p.facility_id is not null as in_payment_file,
           p.payment_adjustment_factor, p.payment_reduction_pct, p.payment_reduction_is_derived, p.is_penalized, p.dual_proportion, p.peer_group, p.neutrality_modifier,
           {', '.join(f"w.{t.lower()}_score as {n}_score" for n, t in LAYER_TOPICS.items())}
    from (select fiscal_year, facility_id, count(excess_readmission_ratio) as conditions_with_ratio, sum(discharges) as public_discharges from facts group by all) r
    join years y using (fiscal_year)
    left join payments p on p.facility_id = r.facility_id and p.fiscal_year = r.fiscal_year
    left join by_window w on w.facility_id = r.facility_id and w.period_start = y.survey_start and w.period_end = y.survey_end
)"""

MARTS_SQL = "with " + ",".join([FACTS_SQL, PAYMENTS_SQL, SURVEY_SQL, WINDOW_SQL, YEARS_SQL, HOSPITALS_SQL, HOSPITAL_YEARS_SQL])


def marts(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """The tables of the metric layer by name."""
    makes = {
        "fct_readmissions": lambda: facts(spark, folder),
        "fct_hospital_year": lambda: hospital_years(spark, folder),
        "dim_hospital": lambda: hospitals(spark, folder),
        "dim_county": lambda: table(spark, folder, "census_county").withColumn("state_name", F.col("state")),
        "dim_fiscal_year": lambda: years(spark, folder),
    }
    return lambda name: makes[name]()
