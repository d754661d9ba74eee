"""The test tables written as raw releases, all text, in the layouts that the pipeline reads: old and new column names, markers, thousands
commas, sentence footnotes, footers, older releases and snapshots that must be dropped. ``SQL`` says what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.values import facility_number
from lodestack.operators.ranking import last_row
from lodestack.plans.hospital_models import CONDITIONS
from lodestack.queries import tables as Q
from lodestack.queries.core_pipeline import _ID, _no_value
from lodestack.session import table

INGESTED = "2026-01-01T00:00:00"

#: Survey topics of the test tables by the published code. Two topics that the test tables lack get the figures of another, so
#: that their columns hold something: these figures are made up, as all of the test tables are.
CODES = {"COMP_1": "NURSE", "COMP_2": "DOCTOR", "COMP_3": "STAFF", "COMP_6": "LEAVE", "CLEAN": "CLEAN", "QUIET": "QUIET", "HSP_RATING": "OVERALL", "RECMND": "OVERALL", "COMP_7": "NURSE"}

#: County health measures of the made-up county release, with the first figure of each.
MEASURES = {"DIABETES": 5, "OBESITY": 20, "COPD": 3, "LACKTRPT": 7, "FOODINSECU": 9}


def _text(c: str, none: str = "N/A") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(none))


def _raw(df: DataFrame, release: Column, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[v.cast("string").alias(n) for n, v in columns.items()], release.alias("_release"), F.lit(INGESTED).alias("_ingested_at"))


def _results(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    names = table(spark, d, "hospital_info").groupBy("facility_id").agg(F.max("facility_name").alias("facility_name"), F.max("state").alias("state"))
    year = F.year("fiscal_year_start") + 1
    rows = Q.facts(spark, d).where("in_public_file").join(names, "facility_id", "left").withColumns({"__y": year, "__code": F.coalesce("footnote_code", F.lit(""))})
    day = lambda y, m, dd: F.date_format(F.make_date(F.col("__y") - y, F.lit(m), F.lit(dd)), "MM/dd/yyyy")

    def layout(df: DataFrame, release: Column, names: tuple[str, str], sign: str, footnote: Column) -> DataFrame:
        return _raw(
            df,
            release,
            {
                names[0]: F.col("facility_id"),
                names[1]: F.col("facility_name"),
                "State": F.col("state"),
                "Measure Name": F.concat(F.lit(f"READM{sign}30{sign}"), F.translate("condition", "_", sign), F.lit(f"{sign}HRRP")),
                "Number of Discharges": F.coalesce(F.format_number("discharges", 0), F.lit("Not Available")),
                "Number of Readmissions": F.when(F.col("readmissions_suppressed"), "Too Few to Report").otherwise(_text("readmissions")),
                "Excess Readmission Ratio": _text("excess_readmission_ratio"),
                "Predicted Readmission Rate": _text("predicted_readmission_rate", "."),
                "Expected Readmission Rate": _text("expected_readmission_rate", "Not Applicable"),
                "Footnote": footnote,
                "Start Date": day(5, 7, 1),
                "End Date": day(2, 6, 30),
            },
        )

    before = lambda n: F.date_format(F.date_sub("fiscal_year_start", n), "yyyy-MM-dd")
    sentence = F.when(F.col("__code") == "", "").otherwise(F.concat("__code", F.lit(" - What the code says.")))
    old = layout(rows, before(120), ("Provider ID", "Hospital Name"), "_", sentence)
    new = layout(rows.where(F.col("__y") % 2 == 1), before(30), ("Facility ID", "Facility Name"), "-", F.col("__code"))
    live = layout(rows, before(0), ("Facility ID", "Facility Name"), "-", F.col("__code"))
    return {"hrrp": live, "hrrp_archive": new.unionByName(old, allowMissingColumns=True)}


def _supplemental(spark: SparkSession, d: str) -> DataFrame:
    keys = ["facility_id", "fiscal_year"]
    columns = ["payment_adjustment_factor", "payment_reduction_pct", "dual_proportion", "peer_group", "neutrality_modifier"]
    paid = last_row(table(spark, d, "payment_adjustments"), keys, columns, ["ingested_at"])
    facts = Q.facts(spark, d).where("in_payment_file")
    blocks = {}
    for code, word in CONDITIONS.items():
        here = F.col("condition") == code
        blocks |= {
            f"Number of eligible discharges for {word}": F.max(F.when(here, F.format_number("eligible_discharges", 0))),
            f"ERR for {word}": F.max(F.when(here, _text("payment_excess_readmission_ratio"))),
            f"Peer group median ERR for {word}": F.max(F.when(here, _text("peer_group_median_err"))),
            f"Penalty indicator for {word}": F.max(F.when(here, F.when(F.col("counts_toward_penalty"), "Y").otherwise("N"))),
            f"DRG payment ratio for {word}": F.max(F.when(here, _text("drg_payment_ratio"))),
        }
    wide = paid.join(facts.groupBy(*keys).agg(*[v.alias(n) for n, v in blocks.items()]), keys, "left")
    own = {
        "Hospital CCN": F.col("facility_id"),
        "Payment adjustment factor": F.col("payment_adjustment_factor"),
        "Payment reduction percentage": F.concat(F.col("payment_reduction_pct").cast("string"), F.lit("%")),
        "Dual proportion": _text("dual_proportion"),
        "Peer group assignment": _text("peer_group"),
        "Neutrality modifier": _text("neutrality_modifier"),
    }
    rows = _raw(wide, F.col("fiscal_year"), {**own, **{n: F.col(f"`{n}`") for n in blocks}})
    footers = spark.createDataFrame([(x, "FY2024", INGESTED) for x in ("End of worksheet", " ")], "`Hospital CCN` string, _release string, _ingested_at string")
    return rows.unionByName(footers, allowMissingColumns=True)


#: Rows of one time are told apart by their content, in the same way by the SQL.
_TIES = ("hospital_overall_rating", "facility_name", "city", "emergency_services", "zip_code", "county_name", "hospital_type")
_LAST_SQL = ", ".join(["a.ingested_at desc", *(f"coalesce(a.{c}, '') desc" for c in _TIES)])


def _order() -> list:
    return ["ingested_at", *[F.coalesce(c, F.lit("")) for c in _TIES]]


PROFILE = ["facility_name", "city", "state", "zip_code", "county_name", "hospital_type", "hospital_ownership", "emergency_services", "hospital_overall_rating"]


def _profiles(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    more = ["address", "birthing_friendly", "hospital_overall_rating_footnote", "source_release"]
    now = last_row(table(spark, d, "hospital_info"), ["facility_id"], [*PROFILE, *more], _order())
    columns = {
        "Facility ID": "facility_id", "Facility Name": "facility_name", "Address": "address", "City/Town": "city", "State": "state", "ZIP Code": "zip_code", "County/Parish": "county_name",
        "Hospital Type": "hospital_type", "Hospital Ownership": "hospital_ownership", "Emergency Services": "emergency_services", "Hospital overall rating": "hospital_overall_rating",
        "Meets criteria for birthing friendly designation": "birthing_friendly", "Hospital overall rating footnote": "hospital_overall_rating_footnote",
    }
    cells = {n: F.col(v) for n, v in columns.items()} | {"Count of Facility MORT Measures": F.length("facility_name"), "Count of READM Measures Worse": F.lit("Not Available")}
    live = _raw(now, F.col("source_release"), cells).unionByName(_raw(now, F.lit("2001-01-01"), cells))
    old = {"Facility ID": "Provider ID", "Facility Name": "Hospital Name", "City/Town": "City", "County/Parish": "County Name"}
    archive = table(spark, d, "hospital_info_archive").withColumn("facility_id", facility_number("facility_id")).where("facility_id is not null")
    past = last_row(archive, ["facility_id", "snapshot_date"], PROFILE, _order())
    cells = {old.get(n, n): F.col(v) for n, v in columns.items() if v in ("facility_id", *PROFILE)}
    return {"hospital_info": live, "hospital_info_archive": _raw(past, F.col("snapshot_date").cast("string"), cells)}


def _surveys(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    raw = table(spark, d, "hcahps_archive")
    codes = F.map_from_arrays(F.array(*[F.lit(t) for t in sorted(set(CODES.values()))]), F.array(*[F.array(*[F.lit(c) for c, x in CODES.items() if x == t]) for t in sorted(set(CODES.values()))]))
    parts = F.regexp_extract("hcahps_measure_id", "^H_([A-Z]+)_(LINEAR_SCORE|STAR_RATING)$", 1), F.regexp_extract("hcahps_measure_id", "^H_([A-Z]+)_(LINEAR_SCORE|STAR_RATING)$", 2)
    rows = raw.withColumn("__code", F.explode(F.element_at(codes, parts[0]))).withColumn("measure", F.concat(F.lit("H_"), "__code", F.lit("_"), parts[1]))
    answers = raw.where("hcahps_measure_id = 'H_QUIET_LINEAR_SCORE'").withColumn("measure", F.lit("H_QUIET_HSP_A_P"))

    def layout(df: DataFrame, id_: str, start: str, end: str) -> DataFrame:
        columns = {
            id_: "facility_id", "HCAHPS Measure ID": "measure", "HCAHPS Question": "hcahps_question", "Patient Survey Star Rating": "patient_survey_star_rating", "HCAHPS Linear Mean Value": "hcahps_linear_mean_value",
            "Number of Completed Surveys": "number_of_completed_surveys", "Survey Response Rate Percent": "survey_response_rate_percent", start: "start_date", end: "end_date",
        }
        return _raw(df, F.col("source_release"), {n: F.col(v) for n, v in columns.items()})

    return {"hcahps": layout(rows, "Facility ID", "Start Date", "End Date"), "hcahps_archive": layout(rows.unionByName(answers, allowMissingColumns=True), "Provider ID", "Measure Start Date", "Measure End Date")}


def _places(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Counties, ZIP areas and towns, made up of the list of counties and the hospitals' addresses."""
    counties = table(spark, d, "census_county").withColumn("__n", F.col("county_fips").substr(3, 3).cast("int"))
    made = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(v).alias("v")) for m, v in MEASURES.items()])
    kinds = F.array(F.struct(F.lit("AgeAdjPrv").alias("k"), F.lit(0).alias("more")), F.struct(F.lit("CrdPrv").alias("k"), F.lit(40).alias("more")))
    cells = counties.withColumn("x", F.explode(made)).withColumn("k", F.explode(kinds)).where((F.col("x.m") != "LACKTRPT") | (F.col("__n") % 4 == 1))
    value = F.col("x.v") + F.col("k.more") + (F.col("__n") % 10) / 10
    health = _raw(
        cells,
        F.lit("2025-08-01"),
        {
            "LocationID": F.col("county_fips"), "LocationName": F.col("county_name"), "StateAbbr": F.col("state"), "StateDesc": F.concat(F.lit("State of "), "state"), "Year": F.when(F.col("x.m") == "LACKTRPT", "2022").otherwise("2023"),
            "CategoryID": F.lit("HLTH"), "Category": F.lit("Health"), "MeasureId": F.col("x.m"), "Measure": F.concat(F.lit("Share with "), "x.m"), "Short_Question_Text": F.lower("x.m"), "DataValueTypeID": F.col("k.k"),
            "Data_Value": F.when(F.col("__n") == 3, "").otherwise(F.round(value, 1).cast("string")), "Low_Confidence_Limit": F.lit("1.5"), "High_Confidence_Limit": F.lit("Not Available"),
            "Data_Value_Footnote_Symbol": F.when(F.col("__n") == 3, "*").otherwise(""), "TotalPopulation": F.format_number(F.col("__n") * 1000 + 500, 0), "TotalPop18plus": F.col("__n") * 800,
            "Geolocation": F.concat(F.lit("POINT (-"), F.col("__n"), F.lit(".25 "), F.col("__n") + 1, F.lit(".5)")),
        },
    )
    nation = spark.createDataFrame([("59", "United States", "US", "2025-08-01")], "LocationID string, LocationName string, StateAbbr string, _release string")
    older = health.withColumn("_release", F.lit("2024-08-01"))
    hospitals = last_row(table(spark, d, "hospital_info"), ["facility_id"], PROFILE, _order())
    zips = hospitals.where("zip_code is not null and state <> 'CT'").select("zip_code", "state").distinct().withColumn("__z", F.col("zip_code").cast("int"))
    parts = F.array(F.struct(F.lit(0).alias("at"), F.lit(1000).alias("land")), F.struct(F.lit(1).alias("at"), F.lit(300).alias("land")), F.struct(F.lit(2).alias("at"), F.lit(0).alias("land")))
    cells = zips.withColumn("p", F.explode(F.slice(parts, F.lit(1), F.col("__z") % 3 + 1)))
    by_state = counties.groupBy("state").agg(F.sort_array(F.collect_list(F.struct("county_fips", "county_name"))).alias("__c"))
    pick = lambda i: F.element_at("__c", (i % F.size("__c") + 1).cast("int"))
    placed = cells.join(by_state, "state").select("zip_code", "p", "__z", pick(F.col("__z") + F.col("p.at")).alias("c")).select("zip_code", "p", "__z", "c.*")
    zcta = {"GEOID_ZCTA5_20": F.col("zip_code"), "GEOID_COUNTY_20": F.col("county_fips"), "NAMELSAD_COUNTY_20": F.col("county_name"), "AREALAND_PART": F.col("p.land") + F.col("__z") % 100, "AREAWATER_PART": F.lit("5")}
    zcta |= {"AREALAND_PART": F.when(F.col("p.land") == 0, 0).otherwise(zcta["AREALAND_PART"])}
    everywhere = _raw(counties, F.lit("2020"), {"GEOID_ZCTA5_20": F.lit(""), "GEOID_COUNTY_20": F.col("county_fips"), "NAMELSAD_COUNTY_20": F.col("county_name"), "AREALAND_PART": F.lit("7"), "AREAWATER_PART": F.lit("0")})
    towns = hospitals.where("zip_code is not null and city is not null and state = 'CT'").select("zip_code", "city", "state").distinct()
    towns = towns.join(by_state, "state").select("zip_code", "city", pick(F.length("city")).getField("county_fips").alias("county_fips"))
    cousub = _raw(towns, F.lit("2022"), {"GEOID_ZCTA5_20": F.col("zip_code"), "GEOID_COUSUB_22": F.concat("county_fips", "zip_code"), "NAMELSAD_COUSUB_22": F.concat("city", F.lit(" town")), "AREALAND_PART": F.length("city") * 10})
    nowhere = spark.createDataFrame([("06001", "0700100000", "County subdivisions not defined", "4", "2022")], "GEOID_ZCTA5_20 string, GEOID_COUSUB_22 string, NAMELSAD_COUSUB_22 string, AREALAND_PART string, _release string")
    return {
        "places_county": health.unionByName(older).unionByName(nation, allowMissingColumns=True),
        "census_zcta_county": _raw(placed, F.lit("2020"), zcta).unionByName(everywhere),
        "census_ct_zcta_cousub": cousub.unionByName(nowhere, allowMissingColumns=True),
    }


def sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    codes = table(spark, d, "fct_readmissions").where("footnote_code is not null").select("footnote_code").distinct()
    footnotes = _raw(codes, F.lit("2025-11-05"), {"Footnote": F.col("footnote_code"), "Footnote Text": F.concat(F.lit("What code "), "footnote_code", F.lit(" says"))})
    return {**_results(spark, d), "hrrp_supplemental": _supplemental(spark, d), **_profiles(spark, d), **_surveys(spark, d), "footnotes": footnotes, **_places(spark, d)}


_NUMBER = "case when not {n} then cast(round(cast(regexp_replace(trim({c}), '[,%]', '', 'g') as double)) as int) end"


def _int(c: str) -> str:
    return _NUMBER.format(n=_no_value(c), c=c)


_CODES = ", ".join(f"('{c}', '{t}')" for c, t in CODES.items())
_HEALTH = ", ".join(f"('{m}', {v})" for m, v in MEASURES.items())
STAMP = "timestamp '2026-01-01 00:00:00'"
_PROFILE_SQL = f"hospital_type, hospital_ownership as ownership, case emergency_services when 'Yes' then true when 'No' then false end as has_emergency_services, {_int('hospital_overall_rating')} as overall_star_rating"

#: Staging tables by name, as common table expressions over the test tables.
SQL = {
    "_names": "select facility_id, max(facility_name) as facility_name, max(state) as state from hospital_info group by all",
    "_facts": "select distinct * from fct_readmissions",
    "_public": """select f.*, n.facility_name, n.state, year(fiscal_year_start) + 1 as y, 'READM-30-' || replace(condition, '_', '-') || '-HRRP' as measure_id, coalesce(readmissions_suppressed, false) as suppressed,
make_date(year(fiscal_year_start) - 4, 7, 1) as period_start, make_date(year(fiscal_year_start) - 1, 6, 30) as period_end,
case when excess_readmission_ratio is not null then 'scored' when footnote_code = '1' then 'too_few_cases' when footnote_code = '5' then 'not_available' when footnote_code = '7' then 'no_cases' else 'unknown' end as status
from _facts f left join _names n using (facility_id) where in_public_file""",
    "stg_results": f"""select facility_id, facility_name, state, measure_id, condition, discharges, readmissions, suppressed as readmissions_suppressed, excess_readmission_ratio, predicted_readmission_rate, expected_readmission_rate,
footnote_code, period_start, period_end, strftime(fiscal_year_start, '%Y-%m-%d') as source_release, {STAMP} as ingested_at, status as score_status from _public where fiscal_year = (select max(fiscal_year) from _public)""",
    "stg_results_history": f"""select facility_id, facility_name, state, measure_id, condition, discharges, readmissions, suppressed as readmissions_suppressed, excess_readmission_ratio, predicted_readmission_rate, expected_readmission_rate,
footnote_code, period_start, period_end, strftime(fiscal_year_start - case when y % 2 = 1 then 30 else 120 end, '%Y-%m-%d') as source_release, {STAMP} as ingested_at,
strftime(fiscal_year_start - 120, '%Y-%m-%d') as period_first_release, cast(1 + y % 2 as bigint) as period_snapshots, status as score_status from _public""",
    "stg_payment_adjustments": f"""select facility_id, fiscal_year, payment_adjustment_factor, coalesce(payment_reduction_pct, round((1 - payment_adjustment_factor) * 100, 4)) as payment_reduction_pct, payment_reduction_pct is null as payment_reduction_is_derived,
payment_adjustment_factor < 1 as is_penalized, dual_proportion, cast(peer_group as int) as peer_group, neutrality_modifier, {STAMP} as ingested_at, fiscal_year = (select max(fiscal_year) from payment_adjustments) as is_latest_fiscal_year
from payment_adjustments where facility_id is not null qualify row_number() over (partition by facility_id, fiscal_year order by payment_adjustments.ingested_at desc, peer_group desc nulls last, payment_adjustment_factor desc) = 1""",
    "stg_peer_comparisons": """select facility_id, fiscal_year, condition, eligible_discharges, payment_excess_readmission_ratio as excess_readmission_ratio, peer_group_median_err, counts_toward_penalty as is_above_peer_median, drg_payment_ratio
from _facts where in_payment_file and (facility_id, fiscal_year) in (select (facility_id, fiscal_year) from stg_payment_adjustments)""",
    "stg_hospitals": f"""select facility_id, facility_name, address, city, state, zip_code, county_name, {_PROFILE_SQL}, birthing_friendly = 'Y' as is_birthing_friendly, nullif(hospital_overall_rating_footnote, '') as overall_star_rating_footnote,
{', '.join(f"cast({'length(facility_name)' if (p, n) == ('mort', 'reported') else 'null'} as int) as {p}_measures_{n}" for p in ('mort', 'safety', 'readm') for n in ('reported', 'better', 'no_different', 'worse'))},
source_release, {STAMP} as ingested_at from hospital_info a qualify row_number() over (partition by facility_id order by {_LAST_SQL}) = 1""",
    "stg_hospitals_history": f"""select facility_id, facility_name, cast(null as varchar) as address, city, state, zip_code, county_name, {_PROFILE_SQL}, snapshot_date, {STAMP} as ingested_at
from (select * replace ({_ID} as facility_id) from hospital_info_archive) a where facility_id <> '' qualify row_number() over (partition by facility_id, snapshot_date order by {_LAST_SQL}) = 1""",
    "_survey": f"""select facility_id, 'H_' || c.code || '_' || regexp_extract(hcahps_measure_id, '^H_[A-Z]+_(LINEAR_SCORE|STAR_RATING)$', 1) as measure_id, hcahps_question as question, {_int('patient_survey_star_rating')} as star_rating, {_int('hcahps_linear_mean_value')} as linear_mean_score,
{_int('number_of_completed_surveys')} as completed_surveys, {_int('survey_response_rate_percent')} as response_rate_pct, strptime(start_date, '%m/%d/%Y')::date as period_start, strptime(end_date, '%m/%d/%Y')::date as period_end, source_release, {STAMP} as ingested_at
from hcahps_archive join (values {_CODES}) c(code, topic) on topic = regexp_extract(hcahps_measure_id, '^H_([A-Z]+)_', 1)""",
    "stg_survey": """select *, cast(null as varchar) as answer_description, cast(null as int) as answer_pct, cast(null as varchar) as star_rating_footnote, cast(null as varchar) as answer_pct_footnote, cast(null as varchar) as completed_surveys_footnote,
cast(null as varchar) as response_rate_footnote from _survey where source_release = (select max(source_release) from _survey)""",
    "stg_survey_history": """select s.*, p.first as period_first_release, p.n as period_snapshots from _survey s join (select period_start, period_end, min(source_release) as first, max(source_release) as last, count(distinct source_release) as n from _survey group by all) p
on p.period_start = s.period_start and p.period_end = s.period_end and p.last = s.source_release""",
    "stg_footnotes": "select distinct footnote_code, 'What code ' || footnote_code || ' says' as footnote_text from fct_readmissions where footnote_code is not null",
    "_counties": "select *, cast(substr(county_fips, 3, 3) as int) as n, row_number() over (partition by state order by county_fips) - 1 as i, count(*) over (partition by state) as total from census_county",
    "stg_county_health": f"""select county_fips, county_name, state, 'State of ' || state as state_name, case when m = 'LACKTRPT' then 2022 else 2023 end as data_year, 'HLTH' as category_id, 'Health' as category, m as measure_id, 'Share with ' || m as measure_name, lower(m) as measure_short_name,
k as value_type, case when n <> 3 then round(v + more + (n % 10) / 10, 1) end as value_pct, 1.5::double as value_pct_low, cast(null as double) as value_pct_high, n = 3 as is_suppressed, cast(n * 1000 + 500 as int) as total_population, cast(n * 800 as int) as adult_population,
-cast(n || '.25' as double) as longitude, cast((n + 1) || '.5' as double) as latitude, '2025-08-01' as source_release, {STAMP} as ingested_at
from _counties, (values {_HEALTH}) h(m, v), (values ('AgeAdjPrv', 0), ('CrdPrv', 40)) t(k, more) where m <> 'LACKTRPT' or n % 4 = 1""",
    "stg_zip_county": """select zip_code as zcta, c.county_fips, left(c.county_fips, 2) as state_fips, c.county_name, cast(case when land = 0 then 0 else land + z % 100 end as bigint) as land_area_part, cast(5 as bigint) as water_area_part, '2020' as source_release
from (select distinct zip_code, state, cast(zip_code as int) as z from stg_hospitals where zip_code is not null and state <> 'CT') h join (values (0, 1000), (1, 300), (2, 0)) p("at", land) on p."at" <= z % 3 join _counties c on c.state = h.state and (z + p."at") % total = i
union all select null, county_fips, left(county_fips, 2), county_name, 7, 0, '2020' from census_county""",
    "stg_zip_town": """select zip_code as zcta, county_fips || zip_code as town_fips, city || ' town' as town_name, county_fips as planning_region_fips, true as is_town, cast(length(city) * 10 as bigint) as land_area_part, '2022' as source_release
from (select distinct zip_code, city from stg_hospitals where zip_code is not null and city is not null and state = 'CT') h join _counties c on c.state = 'CT' and length(city) % total = i
union all select '06001', '0700100000', 'County subdivisions not defined', '07001', false, 4, '2022'""",
}
