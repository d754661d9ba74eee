"""Schemas that drift between files: fingerprints, migration steps, and one consistent table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.values import clean_text, facility_number, is_marker
from lodestack.session import cut

FILE = ["source", "feed_id", "release_label"]

#: Names under which sources publish the hospital number, case and blanks aside.
ID_NAMES = ("facility id", "provider id", "provider number", "ccn", "hospital ccn")

#: A field that came carries on one that left if at least this share of shared hospitals kept their value.
KEPT = 0.5

#: Published names by concept, in lower case with letters and digits only.
CONCEPTS = {
    "facility_id": ("facilityid", "providerid", "providernumber", "ccn", "hospitalccn"),
    "facility_name": ("facilityname", "hospitalname", "nameoffacility"),
    "state": ("state", "statecode", "stateabbr"),
    "city": ("city", "citytown"),
    "zip_code": ("zip", "zipcode"),
    "county_name": ("county", "countyname", "countyparish"),
    "telephone": ("telephone", "telephonenumber", "phonenumber"),
    "measure": ("measure", "measurename", "measureid", "hcahpsmeasureid"),
    "discharges": ("discharges", "numberofdischarges"),
    "readmissions": ("readmissions", "numberofreadmissions", "readmissioncount"),
    "excess_readmission_ratio": ("excessreadmissionratio", "excessreadmratio", "err"),
    "predicted_readmission_rate": ("predictedreadmissionrate", "predictedrate"),
    "expected_readmission_rate": ("expectedreadmissionrate", "expectedrate"),
    "dual_proportion": ("dualproportion",),
    "counts_toward_penalty": ("countstowardpenalty", "penaltyindicator"),
    "footnote": ("footnote", "footnotes", "surveyfootnote"),
    "start_date": ("startdate", "measurestartdate"),
    "end_date": ("enddate", "measureenddate"),
    "linear_mean_value": ("linearmean", "linearscore", "hcahpslinearmeanvalue"),
    "star_rating": ("starrating", "patientsurveystarrating"),
    "completed_surveys": ("completedsurveys", "numberofcompletedsurveys"),
    "response_rate_pct": ("responserate", "responseratepct", "surveyresponseratepercent"),
    "answer_description": ("answerdescription", "hcahpsanswerdescription"),
    "reported_late": ("reportedlate", "lateflag"),
    "overall_rating": ("overallrating", "hospitaloverallrating"),
    "hospital_type": ("hospitaltype", "typeofhospital"),
    "hospital_ownership": ("ownership", "hospitalownership"),
    "emergency_services": ("er", "emergencyservices", "hasemergencyservices"),
    "readm_measures": ("readmmeasures", "countofreadmmeasures"),
    "wait_index": ("waitindex", "meanwaitindex"),
    "remark": ("note", "remark", "profilenote", "submissionnote"),
}

#: The type to which a concept is cast; the rest stay text.
CASTS = {
    **dict.fromkeys(("discharges", "readmissions", "completed_surveys", "star_rating", "overall_rating", "readm_measures"), "bigint"),
    **dict.fromkeys(
        ("excess_readmission_ratio", "predicted_readmission_rate", "expected_readmission_rate", "dual_proportion", "linear_mean_value", "response_rate_pct", "wait_index"),
        "double",
    ),
    **dict.fromkeys(("counts_toward_penalty", "reported_late", "emergency_services"), "boolean"),
}


#: Most versions whose fields are sent to every task; more are joined by a shuffle. Both ways give the same.
BROADCAST_STEPS = 50_000


def comparable(value: Column | str) -> Column:
    """One text for a JSON value's text however a release writes it: 97, 97.0 and "97", or Yes, "Y" and true."""
    text = F.lower(clean_text(value))
    number = F.regexp_replace(text, ",", "").try_cast("double")
    return (
        F.when(text.isin("yes", "y", "true"), "true")
        .when(text.isin("no", "n", "false"), "false")
        .otherwise(F.coalesce(number.cast("string"), text))
    )


def _json() -> Column:
    return F.from_json("payload", "map<string,variant>")


def parsed(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the file's key and ``__fields``, a map from each field of the payload to its JSON value."""
    for c in FILE:
        df = df.where(F.col(c).isNotNull())
    return df.select(*FILE, *[c for c in keep if c not in FILE], _json().alias("__fields"))


def field_profile(rows: DataFrame) -> DataFrame:
    """For each file and field: its type and what speaks for it being the hospital number. Types: text if any
    value is JSON text, else decimal, integer or boolean; null if nulls and markers are all there is."""
    cells = rows.select(*FILE, F.explode_outer("__fields").alias("field", "__v"))
    cells = cells.select(*FILE, "field", F.schema_of_variant("__v").alias("__type"), F.try_variant_get("__v", "$", "string").alias("__text"))
    kind = F.col("__type")
    rank = (
        F.when(kind == "STRING", F.when(~is_marker("__text"), 4))
        .when(kind == "BIGINT", 2)
        .when(kind == "BOOLEAN", 1)
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), 3)
        .when(kind != "VOID", 4)
    )
    cells = cells.select(*FILE, "field", rank.alias("__rank"), "__text")
    form = lambda pattern: F.avg(F.when(F.col("__rank").isNotNull(), F.col("__text").rlike(rf"(?i)^\s*{pattern}\s*$").cast("double")))
    profile = cells.groupBy(*FILE, "field").agg(F.max("__rank").alias("__rank"), form("[0-9][0-9A-Z]{5}").alias("__six"), form("[0-9][0-9A-Z]{3,5}").alias("__near"))
    named = F.lower(F.regexp_replace(F.trim("field"), r"\s+", " ")).isin(*ID_NAMES)
    score = F.struct(F.coalesce(named, F.lit(False)).alias("named"), F.coalesce("__six", F.lit(0.0)).alias("six"), F.coalesce("__near", F.lit(0.0)).alias("near"), "field")
    names = F.array(*[F.lit(k) for k in ("boolean", "integer", "decimal", "text")])
    return profile.select(*FILE, "field", F.try_element_at(names, F.col("__rank")).alias("kind"), score.alias("__id_score"))


def schema_versions(profile: DataFrame) -> DataFrame:
    """One row per file: ``__fields`` (field to type), ``fingerprint``, ``__id`` (the field with the hospital number), the same of the release
    before of its source and feed (``__prev`` and so on), and ``schema_version``, which counts the fingerprints that a feed has had."""
    entry = F.struct("field", F.coalesce("kind", F.lit("unknown")).alias("kind"))
    files = profile.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.when(F.col("field").isNotNull(), entry))).alias("__list"), F.max_by("field", "__id_score").alias("__id"))
    print_ = F.sha2(F.array_join(F.transform("__list", lambda e: F.concat_ws("\t", e["field"], e["kind"])), "\n"), 256)
    files = files.select(*FILE, "__id", F.map_from_entries("__list").alias("__fields"), print_.alias("fingerprint"))
    order = Window.partitionBy("source", "feed_id").orderBy("release_label")
    before = {f"__prev{n}": F.lag(c).over(order) for n, c in (("", "release_label"), ("_id", "__id"), ("_fields", "__fields"), ("_fingerprint", "fingerprint"))}
    files = files.withColumns(before)
    changed = F.coalesce(F.col("fingerprint") != F.col("__prev_fingerprint"), F.lit(True))
    return files.withColumn("schema_version", F.sum(changed.cast("int")).over(order).cast("int"))


def _renames(df: DataFrame, steps: DataFrame) -> DataFrame:
    """(``__step``, ``__pairs``): fields that left and came as the same one, the pairs with the largest share of kept values first,
    one to one.

    Of a hospital's values of a field the smallest and the largest hash are compared: for one value that is the value, for many it
    tells to which part the sets of values are the same, and repeated lines do not matter. So what is shuffled is
    one small row per hospital and field that left or came, and only equal pairs are counted.
    """
    side = lambda label, id_, names, n: steps.select("source", "feed_id", F.col(label).alias("release_label"), F.col(id_).alias("__id"), "__step", F.col(names).alias("__names"), F.lit(n).alias("__side"))
    wanted = side("__prev", "__prev_id", "__left", 0).unionByName(side("release_label", "__id", "__came", 1))
    wanted = F.broadcast(wanted) if steps.limit(BROADCAST_STEPS + 1).count() <= BROADCAST_STEPS else wanted
    raw = df.select(*FILE, "payload").join(wanted, FILE).select("__step", "__side", "__id", "__names", _json().alias("__fields"))
    cells = raw.select("__step", "__side", F.try_variant_get(F.try_element_at("__fields", F.col("__id")), "$", "string").alias("__number"), "__fields", F.explode("__names").alias("__name"))
    cells = cells.select("__step", "__side", "__number", "__name", F.try_variant_get(F.try_element_at("__fields", F.col("__name")), "$", "string").alias("__text"))
    cells = cells.select("__step", "__side", facility_number("__number").alias("__hospital"), "__name", F.xxhash64(comparable("__text")).alias("__hash")).where(
        F.col("__hospital").isNotNull() & ~is_marker("__text")
    )
    held = cells.groupBy("__step", "__hospital", "__side", "__name").agg(F.min("__hash").alias("lo"), F.max("__hash").alias("hi"))
    names = lambda n: F.collect_list(F.when(F.col("__side") == n, F.struct(F.col("__name").alias("name"), "lo", "hi")))
    both = held.groupBy("__step", "__hospital").agg(names(0).alias("__l"), names(1).alias("__c")).where((F.size("__l") > 0) & (F.size("__c") > 0))
    none = F.lit(None).cast("string")
    count = lambda l, c, n, kept: F.struct(l.alias("l"), c.alias("c"), F.lit(n).alias("n"), kept.cast("double").alias("kept"))  # noqa: E731, E741
    equal = lambda x, y: ((x["lo"] == y["lo"]).cast("double") + (x["hi"] == y["hi"]).cast("double")) / 2
    same = F.flatten(F.transform("__l", lambda x: F.transform(F.filter("__c", lambda y: equal(x, y) > 0), lambda y: count(x["name"], y["name"], 0, equal(x, y)))))
    alone = [F.transform("__l", lambda x: count(x["name"], none, 1, F.lit(0))), F.transform("__c", lambda y: count(none, y["name"], 1, F.lit(0)))]
    seen = both.select("__step", F.explode(F.concat(*alone, same)).alias("e"))
    sums = seen.groupBy("__step", "e.l", "e.c").agg(F.sum("e.n").alias("n"), F.sum("e.kept").alias("kept"))
    of_step = sums.groupBy("__step").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("c").isNull(), F.struct("l", "n")))).alias("__nl"),
        F.map_from_entries(F.collect_list(F.when(F.col("l").isNull(), F.struct("c", "n")))).alias("__nc"),
        F.collect_list(F.when(F.col("l").isNotNull() & F.col("c").isNotNull(), F.struct("l", "c", "kept"))).alias("__p"),
    )
    rows = lambda p: F.least(F.try_element_at("__nl", p["l"]), F.try_element_at("__nc", p["c"]))
    shares = F.transform("__p", lambda p: F.struct((p["kept"] / rows(p)).alias("share"), rows(p).alias("n"), p["l"].alias("l"), p["c"].alias("c")))
    ranked = F.sort_array(F.filter(shares, lambda p: p["share"] >= KEPT), asc=False)
    taken = F.aggregate(
        ranked,
        F.expr("cast(array() as array<struct<l:string,c:string>>)"),
        lambda done, x: F.when(F.exists(done, lambda d: (d["l"] == x["l"]) | (d["c"] == x["c"])), done).otherwise(F.concat(done, F.array(F.struct(x["l"].alias("l"), x["c"].alias("c"))))),
    )
    return of_step.select("__step", taken.alias("__pairs"))


def migration_steps(df: DataFrame, files: DataFrame) -> DataFrame:
    """(file, ``version_before``, ``schema_version``, ``fingerprint``, ``step``, ``change_kind``, ``field_before``, ``field_after``, ``type_before``,
    ``type_after``): the recorded steps that lead from the schema of the release before to the file's own, in the order
    in which they are applied: renames, then removed fields, added ones (null by default in files without them), and casts.

    Files whose fingerprint is that of the release before have no step and are not looked at further.
    """
    now, then = F.map_keys("__fields"), F.map_keys("__prev_fields")
    moved = files.where(F.col("__prev").isNotNull() & (F.col("fingerprint") != F.col("__prev_fingerprint")))
    moved = moved.select(
        *FILE, "__prev", "__id", "__prev_id", "__fields", "__prev_fields", "fingerprint", "schema_version",
        F.array_except(then, now).alias("__left"), F.array_except(now, then).alias("__came"), F.array_intersect(now, then).alias("__both"), F.monotonically_increasing_id().alias("__step"),
    )
    moved = cut(moved)
    pairs = _renames(df, moved.where((F.size("__left") > 0) & (F.size("__came") > 0)))
    known = moved.join(pairs, "__step", "left").withColumn("__pairs", F.coalesce("__pairs", F.expr("cast(array() as array<struct<l:string,c:string>>)")))
    was, is_ = (lambda f: F.try_element_at("__prev_fields", f)), (lambda f: F.try_element_at("__fields", f))
    step = lambda kind, before, after, a, b: F.struct(F.lit(kind).alias("change_kind"), before.alias("field_before"), after.alias("field_after"), a.alias("type_before"), b.alias("type_after"))
    empty, no = F.lit(""), F.lit(None).cast("string")
    gone = F.array_except("__left", F.transform("__pairs", lambda p: p["l"]))
    new = F.array_except("__came", F.transform("__pairs", lambda p: p["c"]))
    cast = F.filter("__both", lambda f: (was(f) != "unknown") & (is_(f) != "unknown") & (was(f) != is_(f)))
    steps = F.concat(
        F.transform("__pairs", lambda p: step("renamed", p["l"], p["c"], was(p["l"]), is_(p["c"]))),
        F.transform(gone, lambda f: step("removed", f, empty, was(f), no)),
        F.transform(new, lambda f: step("added", empty, f, no, is_(f))),
        F.transform(cast, lambda f: step("type_changed", f, f, was(f), is_(f))),
    )
    out = known.select(*FILE, (F.col("schema_version") - 1).alias("version_before"), "schema_version", "fingerprint", F.posexplode(steps).alias("step", "__s"))
    return out.select(*FILE, "version_before", "schema_version", "fingerprint", (F.col("step") + 1).alias("step"), "__s.*")


def recorded_steps(df: DataFrame) -> DataFrame:
    """``migration_steps`` of all files of ``df``: ``source``, ``feed_id``, ``release_label`` (together a file) and ``payload``, one JSON object."""
    return migration_steps(df, cut(schema_versions(field_profile(parsed(df, [])))))


def schema_changes(df: DataFrame) -> DataFrame:
    """(file, ``change_kind``, ``field_before``, ``field_after``) of every file against the release before of its
    source and feed: fields ``renamed``, ``added`` (before ``''``), ``removed`` (after ``''``) and
    ``type_changed``. These are the recorded migration steps between versions of the schema.

    A payload that is null or no object has no fields. Rows without source, feed or label belong to no file and are left out.
    A field with nulls and markers only has no type, so no change of type. Repeated rows change nothing.
    The first pass makes a profile of files by fields, from which come fingerprints, versions and what left, came or
    changed its type; the second reads only the files of versions that lost and got fields, and compares those by hospital.
    """
    return recorded_steps(df).select(*FILE, "change_kind", "field_before", "field_after")


def _concept(name: str) -> str | None:
    plain = "".join(ch for ch in name.lower() if ch.isalnum())
    return next((concept for concept, names in CONCEPTS.items() if plain in names), None)


def _carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source and feed: each file's fields with the concept they carry, release by release along the recorded renames.

    A field takes the concept of its own name, else that of the field it was renamed from, else keeps its name. So one row per
    file and field: the rules by which the file is read.
    """
    out, carried = [], {}
    for label, fields, renamed in sorted(zip(pdf["release_label"], pdf["__names"], pdf["__renamed"]), key=lambda x: x[0]):
        was = {r["after"]: r["before"] for r in renamed} if renamed is not None else {}
        carried = {f: _concept(f) or carried.get(was.get(f, f)) or f for f in fields}
        out += [(label, f, concept) for f, concept in carried.items()]
    first = pdf[["source", "feed_id"]].iloc[0]
    made = pd.DataFrame(out, columns=["release_label", "field", "concept"])
    return made.assign(source=first["source"], feed_id=first["feed_id"])


def migration_rules(files: DataFrame, steps: DataFrame) -> DataFrame:
    """(file, ``schema_version``, ``fingerprint``, ``__rules``: field to concept): how each file is read. A group is the
    fields of one feed's releases, never its rows."""
    renamed = steps.where(F.col("change_kind") == "renamed").groupBy(*FILE).agg(F.collect_list(F.struct(F.col("field_before").alias("before"), F.col("field_after").alias("after"))).alias("__renamed"))
    named = files.select(*FILE, F.map_keys("__fields").alias("__names")).join(renamed, FILE, "left")
    rules = named.groupBy("source", "feed_id").applyInPandas(_carried, "source string, feed_id bigint, release_label string, field string, concept string")
    by_file = rules.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("field", "concept"))).alias("__rules"))
    return files.select(*FILE, "schema_version", "fingerprint").join(by_file, FILE, "left")


def consistent_table(df: DataFrame) -> DataFrame:
    """All payloads as one table: the file, ``line_no``, the schema's version and fingerprint, one column per
    concept, and ``other_fields`` (JSON text) with fields of no known concept.

    Every file goes through its chain of renames, then defaults (a concept the file lacks is null, and so is a
    marker), then casts; a value that cannot be cast is null in its column and kept in ``other_fields``. Repeated
    lines stay. A payload that cannot be parsed gives a row with nulls.
    """
    rows = parsed(df, ["line_no"])
    files = cut(schema_versions(field_profile(rows)))
    wide = rows.join(migration_rules(files, migration_steps(df, files)), FILE, "left").select(
        *FILE,
        "line_no",
        "schema_version",
        "fingerprint",
        F.transform(F.map_entries("__fields"), lambda e: F.struct(F.try_element_at("__rules", e["key"]).alias("concept"), e["key"].alias("field"), F.try_variant_get(e["value"], "$", "string").alias("value"))).alias("__cells"),
    )
    raw = {c: F.try_element_at(F.filter("__cells", _carries(c)), F.lit(1))["value"] for c in CONCEPTS}
    wide = wide.withColumns({f"__{c}": clean_text(v) for c, v in raw.items()})
    cast = {c: facility_number(F.col(f"__{c}")) if c == "facility_id" else _cast(F.col(f"__{c}"), CASTS.get(c)) for c in CONCEPTS}
    uncast = F.map_from_entries(
        F.filter(F.array(*[F.when(F.col(f"__{c}").isNotNull() & cast[c].isNull(), F.struct(F.lit(c).alias("key"), F.col(f"__{c}").alias("value"))) for c in CASTS]), lambda e: e.isNotNull())
    )
    unknown = F.map_from_entries(
        F.transform(F.filter("__cells", lambda e: ~F.coalesce(e["concept"], F.lit("")).isin(*CONCEPTS) & ~is_marker(e["value"])), lambda e: F.struct(e["field"], e["value"]))
    )
    other = F.map_concat(F.coalesce(unknown, F.expr("cast(map() as map<string,string>)")), uncast)
    return wide.select(*FILE, "line_no", "schema_version", "fingerprint", *[v.alias(c) for c, v in cast.items()], F.when(F.size(other) > 0, F.to_json(other)).alias("other_fields"))


def _carries(concept: str):
    return lambda cell: cell["concept"] == concept


def _cast(text: Column, kind: str | None) -> Column:
    if kind is None:
        return text
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("yes", "y", "true", "1"), True).when(low.isin("no", "n", "false", "0"), False)
    number = F.regexp_replace(text, "[,%]", "").try_cast("double")
    return F.when(number == F.floor(number), number.cast("bigint")) if kind == "bigint" else number
