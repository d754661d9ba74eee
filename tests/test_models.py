"""The star schema on a few hand-made releases."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.plans.hospital_metrics import hospital_layer
from lodestack.plans.hospital_models import CONDITIONS, HOSPITAL
from lodestack.plans.pipeline import Node, Pipeline

D = datetime.date


def raw(spark, columns, rows, release):
    names = [*columns, "_release", "_ingested_at"]
    data = [(*r, release, "2025-01-01T00:00:00") for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in names))


RESULT = ["Facility ID", "Facility Name", "State", "Measure Name", "Number of Discharges", "Number of Readmissions", "Excess Readmission Ratio", "Predicted Readmission Rate", "Expected Readmission Rate", "Footnote", "Start Date", "End Date"]


def result(i, name="Alpha", state="AL", measure="READM-30-HF-HRRP", discharges="1,360", ratio="1.10", footnote="", start="07/01/2015", end="06/30/2018"):
    return (i, name, state, measure, discharges, "Too Few to Report", ratio, "10", "9.5", footnote, start, end)


@pytest.fixture(scope="module")
def sources(spark):
    profile = ["Facility ID", "Facility Name", "Address", "City/Town", "State", "ZIP Code", "County/Parish", "Hospital Type", "Hospital Ownership", "Emergency Services", "Hospital overall rating", "Meets criteria for birthing friendly designation", "Hospital overall rating footnote"]
    old = ["Provider ID", "Hospital Name", "Address", "City", "State", "ZIP Code", "County Name", "Hospital Type", "Hospital Ownership", "Emergency Services", "Hospital overall rating"]
    paid = ["Hospital CCN", "Payment adjustment factor", "Dual proportion", "Peer group assignment", "Neutrality modifier"]
    block = lambda w: [f"Number of eligible discharges for {w}", f"ERR for {w}", f"Peer group median ERR for {w}", f"Penalty indicator for {w}", f"DRG payment ratio for {w}"]
    paid_columns = [*paid, *[x for w in CONDITIONS.values() for x in block(w)]]

    def pay(i, factor, cases, err, flag):
        values = [i, factor, "0.2", "1", "0.95"]
        for w in CONDITIONS.values():
            values += [cases, err, "1.0", flag, "0.1"] if w == "HF" else ["30", "0.9", "1.0", "N", "0.1"]
        return tuple(values)

    year_2020 = raw(spark, paid_columns, [pay("010001", "0.9900", "1,000", "1.1", "Y"), pay("End of worksheet", "", "", "", "")], "FY2020")
    year_2023 = raw(spark, [c for c in paid_columns if "pneumonia" not in c], [pay("010001", "1.0000", "N/A", "0.9", "N")[:20] + pay("010001", "1.0000", "N/A", "0.9", "N")[25:]], "FY2023").withColumn("Payment reduction percentage", F.lit("0%"))
    health = ["LocationID", "LocationName", "StateAbbr", "StateDesc", "Year", "CategoryID", "Category", "MeasureId", "Measure", "Short_Question_Text", "DataValueTypeID", "Data_Value", "Low_Confidence_Limit", "High_Confidence_Limit", "Data_Value_Footnote_Symbol", "TotalPopulation", "TotalPop18plus", "Geolocation"]

    def county(fips, name, state, measure="DIABETES", value="10.5", kind="AgeAdjPrv"):
        return (fips, name, state, "Alabama", "2022", "c", "c", measure, "m", "m", kind, value, "9", "11", "", "1,000", "800", "POINT (-86.6 32.5)")

    survey = ["Facility ID", "HCAHPS Measure ID", "HCAHPS Question", "HCAHPS Answer Description", "Patient Survey Star Rating", "HCAHPS Answer Percent", "HCAHPS Linear Mean Value", "Number of Completed Surveys", "Survey Response Rate Percent", "Start Date", "End Date"]
    score = lambda i, m, stars, value, start="01/01/2017", end="12/31/2017": (i, m, "q", "a", stars, "Not Applicable", value, "1,100", "25", start, end)
    zips = ["GEOID_ZCTA5_20", "GEOID_COUNTY_20", "NAMELSAD_COUNTY_20", "AREALAND_PART", "AREAWATER_PART"]
    return {
        "hrrp": raw(spark, RESULT, [result("010001", start="07/01/2018", end="06/30/2021")], "2025-01-01"),
        "hrrp_archive": raw(spark, RESULT, [result("010001", ratio="1.2"), result("020002", name="Beta", state="AK", ratio="N/A", footnote="5 - No result.")], "2019-10-01")
        .unionByName(raw(spark, RESULT, [result("010001", measure="READM_30_HF_HRRP"), result("020002", name="Beta", state="AK", ratio="N/A", footnote="5 - No result.")], "2020-01-01"))
        .unionByName(raw(spark, RESULT, [result("010001", measure="READM-30-HIP-KNEE-HRRP", start="07/01/2018", end="06/30/2021")], "2022-01-01")),
        "hrrp_supplemental": year_2020.unionByName(year_2023, allowMissingColumns=True),
        "hospital_info": raw(spark, profile, [("010001", "Alpha", "1 St", "Autauga", "AL", "36003", "AUTAUGA", "Acute", "State", "Yes", "4", "Y", "")], "2025-01-01"),
        "hospital_info_archive": raw(spark, old, [("010001", "Alpha", "1 St", "Autauga", "AL", "36003", "AUTAUGA", "Acute", "City", "No", "3"), ("020002", "Beta", "2 St", "Juneau", "AK", "99801", "JUNEAU", "Acute", "State", "No", "N/A")], "2018-01-01")
        .unionByName(raw(spark, old, [("010001", "Alpha", "1 St", "Autauga", "AL", "36003", "AUTAUGA", "Acute", "County", "Yes", "3")], "2018-09-01")),
        "hcahps": raw(spark, survey, [score("010001", "H_COMP_1_LINEAR_SCORE", "Not Applicable", "90")], "2025-01-01"),
        "hcahps_archive": raw(spark, survey, [score("010001", "H_COMP_1_LINEAR_SCORE", "Not Applicable", "88"), score("010001", "H_COMP_1_STAR_RATING", "4", "Not Applicable"), score("010001", "H_COMP_1_A_P", "Not Applicable", "N/A"), score("010001", "H_COMP_1_LINEAR_SCORE", "Not Applicable", "70", "04/01/2018", "03/31/2019")], "2019-01-01"),
        "footnotes": raw(spark, ["Footnote", "Footnote Text"], [("5", "No result")], "2025-01-01"),
        "places_county": raw(spark, health, [county("01001", "Autauga", "AL"), county("01001", "Autauga", "AL", "LACKTRPT", "7"), county("01001", "Autauga", "AL", "DIABETES", "99", "CrdPrv"), county("02110", "Juneau", "AK"), county("59", "US", "US"), county("09110", "Capitol", "CT")], "2025-01-01"),
        "census_zcta_county": raw(spark, zips, [("36003", "01001", "Autauga County", "900", "1"), ("36003", "01003", "Baldwin County", "100", "1"), ("99801", "02110", "Juneau City and Borough", "5", "0"), ("", "01001", "Autauga County", "5", "0"), ("06001", "09003", "Hartford County", "7", "0"), ("36099", "01001", "Autauga County", "0", "5")], "2020"),
        "census_ct_zcta_cousub": raw(spark, ["GEOID_ZCTA5_20", "GEOID_COUSUB_22", "NAMELSAD_COUSUB_22", "AREALAND_PART"], [("06001", "0911001234", "Avon town", "7"), ("06001", "0911001235", "Bloomfield town", "3")], "2022"),
    }


@pytest.fixture(scope="module")
def built(spark, sources, tmp_path_factory):
    tables, outcomes, skipped = HOSPITAL.run(spark, sources, str(tmp_path_factory.mktemp("marts")))
    return tables, outcomes, skipped


def test_all_tables_and_checks(built):
    tables, outcomes, skipped = built
    assert not skipped and all(o.passed for o in outcomes if o.severity == "error"), [o for o in outcomes if not o.passed]
    assert len(HOSPITAL.nodes) == 24 and len(outcomes) >= 250 and tables["time_spine"].count() == 4748


def test_results(built):
    rows = {(r["facility_id"], r["condition"]): r for r in built[0]["stg_results_history"].collect()}
    assert set(rows) == {("010001", "HF"), ("020002", "HF"), ("010001", "HIP_KNEE")}
    assert rows["010001", "HF"]["excess_readmission_ratio"] == 1.1 and rows["010001", "HF"]["period_snapshots"] == 2 and rows["010001", "HF"]["discharges"] == 1360
    assert rows["020002", "HF"]["score_status"] == "not_available" and rows["020002", "HF"]["readmissions_suppressed"]


def test_payments(built):
    rows = {r["fiscal_year"]: r for r in built[0]["stg_payment_adjustments"].collect()}
    assert rows["FY2020"]["payment_reduction_pct"] == 1.0 and rows["FY2020"]["payment_reduction_is_derived"] and rows["FY2020"]["is_penalized"]
    assert rows["FY2023"]["payment_reduction_pct"] == 0.0 and rows["FY2023"]["is_latest_fiscal_year"]
    peers = built[0]["stg_peer_comparisons"].groupBy("fiscal_year").count().collect()
    assert {r["fiscal_year"]: r["count"] for r in peers} == {"FY2020": 6, "FY2023": 5}
    assert built[0]["stg_peer_comparisons"].where("fiscal_year = 'FY2023' and condition = 'HF'").first()["eligible_discharges"] == 0


def test_counties(built):
    link = {r["facility_id"]: r for r in built[0]["int_hospital_county"].collect()}
    assert (link["010001"]["county_fips"], link["010001"]["link_method"]) == ("01001", "zip_name_agrees")
    assert (link["020002"]["county_fips"], link["020002"]["link_method"]) == ("02110", "zip_single_county")
    assert link["010001"]["name_disagrees"] is False and link["010001"]["is_high_confidence"]
    dim = {r["county_fips"]: r for r in built[0]["dim_county"].collect()}
    assert dim["01001"]["diabetes_pct"] == 10.5 and dim["01001"]["lack_transportation_pct"] == 7.0 and not dim["02110"]["has_social_measures"] and dim["01001"]["longitude"] == -86.6
    region = built[0]["int_zip_county"].where("county_fips = '09110'").first()
    assert region["county_name"] == "Capitol Planning Region" and region["land_area_part"] == 10 and region["land_share"] == 1.0


def test_years_and_facts(built):
    years = {r["fiscal_year"]: r for r in built[0]["dim_fiscal_year"].collect()}
    assert set(years) == {"FY2020", "FY2023"} and years["FY2020"]["survey_period_end"] == D(2017, 12, 31) and years["FY2023"]["survey_period_end"] == D(2019, 3, 31)
    assert years["FY2020"]["survey_period_months"] == 12 and years["FY2020"]["survey_ends_days_before_readmissions"] == 181 and years["FY2020"]["has_payment_file"]
    facts = {(r["fiscal_year"], r["facility_id"], r["condition"]): r for r in built[0]["fct_readmissions"].collect()}
    hf = facts["FY2020", "010001", "HF"]
    assert hf["in_public_file"] and hf["in_payment_file"] and round(hf["penalty_contribution"], 6) == 0.01 and hf["fiscal_year_start"] == D(2019, 10, 1)
    assert facts["FY2020", "020002", "HF"]["penalty_contribution"] is None and facts["FY2020", "010001", "AMI"]["penalty_contribution"] == 0.0


def test_hospital_years(built):
    rows = {(r["fiscal_year"], r["facility_id"]): r for r in built[0]["fct_hospital_year"].collect()}
    y = rows["FY2020", "010001"]
    assert y["profile_snapshot_date"] == D(2018, 9, 1) and y["ownership"] == "County" and y["nurse_communication_score"] == 88 and y["nurse_communication_stars"] == 4
    assert rows["FY2020", "020002"]["in_payment_file"] is False and rows["FY2020", "020002"]["profile_snapshot_date"] == D(2018, 1, 1)


def test_hospitals(built):
    rows = {r["facility_id"]: r for r in built[0]["dim_hospital"].collect()}
    assert rows["010001"]["profile_source"] == "current" and rows["020002"]["profile_source"] == "archive"
    assert rows["010001"]["is_active"] and not rows["020002"]["is_active"] and rows["020002"]["facility_name"] == "Beta"


def test_features(built):
    rows = {r["fiscal_year"]: r for r in built[0]["ml_penalty_features"].collect()}
    assert rows["FY2023"]["split"] == "test" and rows["FY2020"]["split"] == "train"
    assert rows["FY2023"]["prior_payment_reduction_pct"] == 1.0 and rows["FY2023"]["prior_weighted_err"] == 1.1 and rows["FY2023"]["is_top_quarter_penalty"]


def test_metrics_over_built_tables(built):
    layer = hospital_layer(lambda n: built[0][n])
    row = layer.query(["share_penalized", "scored_results", "avg_excess_readmission_ratio"], ["hospital__county__state_name"]).collect()
    assert {r[0]: (r[1], r[2]) for r in row} == {"Alabama": (0.5, 2)}


def test_guards_see_what_leaks(built):
    from lodestack.plans import hospital_models as H

    years, features = built[0]["dim_fiscal_year"], built[0]["ml_penalty_features"]
    assert H.survey_after_period(years).count() == 0 and H.shared_patients(features, years).count() == 0 and H.prior_after_target(features, years).count() == 0
    late = years.withColumn("survey_period_end", F.date_add("readmission_period_end", 1))
    assert H.survey_after_period(late).count() == 2
    assert H.shared_patients(features.withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train")), years).count() == 1
    assert H.prior_after_target(features, years, 1).count() == 1


def test_shell_over_built_tables(built, tmp_path, capsys):
    import json

    from lodestack import cli

    for name in cli.MARTS:
        built[0][name].write.parquet(f"{tmp_path}/marts/{name}")
    marts = ["--marts", f"{tmp_path}/marts"]
    assert cli.main(["query", *marts, "share_penalized", "--by", "fiscal_year"]) == 0 and cli.main(["query", *marts, "nope"]) == 2
    (tmp_path / "replies.json").write_text(json.dumps(['{"action": "query", "metrics": ["share_penalized"]}']))
    assert cli.main(["ask", *marts, "--replies", str(tmp_path / "replies.json"), "What share is penalized?"]) == 0 and "0.0%" in capsys.readouterr().out
    cases = [
        {"id": 1, "question": "q", "category": "c", "metric": "penalized_hospitals", "keys": ["fiscal_year"], "sql": "select fiscal_year, sum(case when is_penalized then 1 else 0 end) as v from fct_hospital_year group by 1", "plan": {"metrics": ["penalized_hospitals"], "group_by": ["fiscal_year"]}},
        {"id": 2, "question": "r", "category": "d", "expect": "decline", "reason": "advice"},
    ]
    (tmp_path / "cases.yaml").write_text(json.dumps(cases))
    assert cli.main(["eval", *marts, "--cases", str(tmp_path / "cases.yaml"), "--variant", "full", "--out", str(tmp_path / "eval.json")]) == 0
    assert "100% of 2 right" in capsys.readouterr().out and json.loads((tmp_path / "eval.json").read_text())["summary"]["full"]["accuracy"] == 1.0
    assert cli.main(["export", *marts, "--out", str(tmp_path / "out")]) == 0 and "metric_checks" in capsys.readouterr().out


def test_broken_table_stops_dependants(spark, tmp_path):
    p = Pipeline()
    p.add(Node("a", lambda t: spark.range(2)))
    p.add(Node("b", lambda t: t["a"], ("a",)))
    p.add(Node("c", lambda t: spark.range(1)))
    p.check("a")(lambda s, t: s.add("none", t["a"]))
    tables, outcomes, skipped = p.run(spark, {}, str(tmp_path))
    assert skipped == ["b"] and not outcomes[0].passed and set(tables) == {"a", "c"} and p.order(["b"]) == ["a", "b"]


def test_strict_casts_fail_at_their_table(spark, sources, tmp_path):
    bad = dict(sources, hrrp=raw(spark, RESULT, [result("010001", discharges="Suppressed")], "2025-01-01"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|Suppressed"):
        HOSPITAL.run(spark, bad, str(tmp_path), ["stg_results"])
