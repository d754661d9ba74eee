"""Queries of the core operators for drifting, broken, snapshotted and historised data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.values import clean_text, facility_number, number_key, squash
from lodestack.operators import drift, records
from lodestack.operators.history import validity_history
from lodestack.operators.snapshots import snapshot_changes
from lodestack.session import table

#: The twelve published columns of a readmission extract, and how each is typed.
EXTRACT = {
    "Facility ID": ("facility_id", "facility"),
    "Facility Name": ("facility_name", "text"),
    "State": ("state", "text"),
    "Measure Name": ("measure_name", "text"),
    "Number of Discharges": ("number_of_discharges", "count"),
    "Footnote": ("footnote", "codes"),
    "Excess Readmission Ratio": ("excess_readmission_ratio", "decimal"),
    "Predicted Readmission Rate": ("predicted_readmission_rate", "decimal"),
    "Expected Readmission Rate": ("expected_readmission_rate", "decimal"),
    "Number of Readmissions": ("number_of_readmissions", "count"),
    "Start Date": ("start_date", "date"),
    "End Date": ("end_date", "date"),
}

SNAPSHOT_VALUES = ["number_of_discharges", "footnote", "excess_readmission_ratio", "predicted_readmission_rate", "expected_readmission_rate", "number_of_readmissions"]
PROFILE = ["facility_name", "city", "hospital_type", "hospital_ownership", "emergency_services"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a column between a published file and the release before."""
    return drift.schema_changes(table(spark, folder, "release_records"))


def p1_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The recorded migration steps between schema versions, with the types before and after."""
    return drift.recorded_steps(table(spark, folder, "release_records"))


def p1_table(spark: SparkSession, folder: str) -> DataFrame:
    """All payloads of all releases as one consistent table."""
    return drift.consistent_table(table(spark, folder, "release_records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that cannot be read, with the reason."""
    return p3_rejected(spark, folder).select("line_id", "reason")


def p3_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the byte of the line at which the reason holds."""
    return records.rejected(records.read_records(table(spark, folder, "hrrp_lines"), EXTRACT, ["line_id"]), ["line_id"])


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that can be read, as typed rows."""
    return records.loaded(records.read_records(table(spark, folder, "hrrp_lines"), EXTRACT, ["line_id"]), EXTRACT, ["line_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hospital and condition added, removed or changed since the release before."""
    snapshots = table(spark, folder, "hrrp_snapshots")
    condition = F.translate(F.regexp_extract(F.upper("measure_name"), r"READM[-_]30[-_](.+)[-_]HRRP", 1), "-", "_")
    compared = {c: number_key(c) for c in SNAPSHOT_VALUES} | {"footnote": F.nullif(F.regexp_extract(F.upper(clean_text("footnote")), r"^([0-9A-Z]+)", 1), F.lit(""))}
    rows = snapshots.select(
        "source_release", facility_number("facility_id").alias("facility_id"), F.nullif(condition, F.lit("")).alias("condition"), *[v.alias(c) for c, v in compared.items()], "ingested_at"
    )
    return snapshot_changes(rows, "source_release", ["facility_id", "condition"], SNAPSHOT_VALUES, ["ingested_at"])


def _history(spark: SparkSession, folder: str) -> DataFrame:
    archive = table(spark, folder, "hospital_info_archive")
    rows = archive.select(facility_number("facility_id").alias("facility_id"), "snapshot_date", *[squash(c).alias(c) for c in PROFILE], "ingested_at")
    return validity_history(rows, "snapshot_date", "facility_id", PROFILE, ["ingested_at"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of hospital profiles with the period in which each was valid."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _history(spark, folder).select("facility_id", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("")).alias("valid_to"))


def p6_history(spark: SparkSession, folder: str) -> DataFrame:
    """The same versions with their attributes, in lower case."""
    return _history(spark, folder)


QUERIES = {f.__name__: f for f in (p1_found, p1_steps, p1_table, p3_found, p3_rejected, p3_loaded, p5_found, p6_found, p6_history)}


def _no_value(c: str) -> str:
    return f"({c} is null or lower(trim({c})) in ('', 'n/a', 'not available', 'not applicable', 'too few to report', '.'))"


def _number(c: str) -> str:
    plain = f"regexp_replace({c}, '[,%\\s]', '', 'g')"
    return f"case when not {_no_value(c)} then coalesce(cast(try_cast({plain} as decimal(38,10)) as varchar), lower({plain})) end"


_ID = "case when length(regexp_replace(facility_id, '\\s', '', 'g')) < 6 then lpad(upper(regexp_replace(facility_id, '\\s', '', 'g')), 6, '0') else upper(regexp_replace(facility_id, '\\s', '', 'g')) end"

_FIELD = '"(?:[^"]|"")*"|[^{d}"][^{d}]*|'
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_NAMES = ", ".join(f"'{n}'" for n in sorted(EXTRACT))


def _by_delimiter(sql: str) -> str:
    """An expression with ``{d}``, the delimiter of a file, as a choice between tabs and commas."""
    return f"case when tab then {sql.format(d=chr(92) + 't', c='chr(9)')} else {sql.format(d=',', c=chr(39) + ',' + chr(39))} end"


def _valid(kind: str, v: str) -> str:
    marked = f"{v} in ('', 'N/A', 'Not Available', 'Not Applicable', 'Too Few to Report', '.')"
    match = lambda pattern: f"regexp_full_match({v}, '{pattern}')"
    return {
        "count": f"({match('[0-9]+|[0-9]{{1,3}}(?:,[0-9]{{3}})+'.replace('{{', '{').replace('}}', '}'))} or {marked})",
        "decimal": f"({match('(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)%?')} or {marked})",
        "codes": f"({v} = '' or {match('[0-9]+[A-Za-z]?(?:[ ' + chr(92) + 't]*,[ ' + chr(92) + 't]*[0-9]+[A-Za-z]?)*')} or {match('(?s)[0-9]+[A-Za-z]? - [^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r].*')})",
        "date": f"({match('[0-9]{2}/[0-9]{2}/[0-9]{4}')} and try_strptime({v}, '%m/%d/%Y') is not null)",
        "facility": match("[0-9A-Z]{6}"),
        "text": "true",
    }[kind]


def _value(name: str) -> str:
    return f"trim(coalesce(fields[list_position(names, '{name}')], ''), {_BLANKS})"


#: Lines below their file's header, with their fields and the reason why they cannot be read.
_RECORDS = f"""
with raw as (select line_id, file_name, line_no, regexp_replace(coalesce(line, ''), '^' || chr(65279), '') as t, ends_with(lower(file_name), '.txt') as tab from hrrp_lines),
split_ as (
    select *, {_by_delimiter(f"not regexp_full_match(t, '(?s)(?:{_FIELD})(?:{{d}}(?:{_FIELD}))*')")} as broken,
           list_transform({_by_delimiter(f"regexp_extract_all({{c}} || t, '(?s){{d}}({_FIELD})', 1)")}, lambda f: case when starts_with(f, '"') then replace(f[2:-2], '""', '"') else f end) as fields
    from raw
), heads as (
    select file_name, arg_min(fields, line_no) as names, min(line_no) as head_no from (select file_name, line_no, list_transform(fields, lambda f: trim(f, {_BLANKS})) as fields from split_ where not broken)
    where list_sort(fields) = [{_NAMES}] group by file_name
), below as (select s.*, names from split_ s left join heads h using (file_name) where head_no is null or line_no is null or line_no > head_no),
judged as (
    select *, case when names is null or line_no is null then 'no_header' when broken then 'quoting' when len(fields) <> {len(EXTRACT)} then 'column_count'
           when not ({' and '.join(_valid(kind, _value(n)) for n, (_, kind) in EXTRACT.items())}) then 'invalid_value' end as reason
    from below
)"""


def _typed(kind: str, v: str) -> str:
    known = f"case when {v} not in ('', 'N/A', 'Not Available', 'Not Applicable', 'Too Few to Report', '.') then "
    return known + {"count": f"cast(replace({v}, ',', '') as bigint)", "decimal": f"cast(replace({v}, '%', '') as double)", "date": f"cast(strptime({v}, '%m/%d/%Y') as date)"}.get(kind, v) + " end"


SQL = {
    "p3_found": _RECORDS + " select line_id, reason from judged where reason is not null",
    "p3_loaded": _RECORDS + f" select line_id, {', '.join(f'{_typed(kind, _value(n))} as {name}' for n, (name, kind) in EXTRACT.items())} from judged where reason is null",
    "p5_found": f"""
with rows_ as (
    select source_release, {_ID} as facility_id, replace(regexp_extract(upper(measure_name), 'READM[-_]30[-_](.+)[-_]HRRP', 1), '-', '_') as condition, ingested_at,
           concat_ws('|', {', '.join(f"coalesce({_number(c)}, '~')" for c in SNAPSHOT_VALUES if c != 'footnote')},
                     case when {_no_value('footnote')} then '~' else regexp_extract(upper(trim(footnote)), '^([0-9A-Z]+)', 1) end) as content
    from hrrp_snapshots
), held as (
    select * from rows_ where facility_id <> '' and condition <> ''
    qualify row_number() over (partition by source_release, facility_id, condition order by ingested_at desc, content desc) = 1
), place as (
    select source_release, row_number() over (order by source_release) as i from (select distinct source_release from hrrp_snapshots where source_release is not null)
), placed as (select held.*, i from held join place using (source_release)),
pairs as (
    select coalesce(a.facility_id, b.facility_id) as facility_id, coalesce(a.condition, b.condition) as condition, coalesce(b.i, a.i + 1) as i,
           case when a.i is null then 'added' when b.i is null then 'removed' when a.content <> b.content then 'changed' end as change_kind
    from placed a full join placed b on a.facility_id = b.facility_id and a.condition = b.condition and a.i + 1 = b.i
)
select p.source_release, facility_id, condition, change_kind
from pairs join place p using (i) where change_kind is not null and i > 1""",
    "p6_found": f"""
with rows_ as (
    select {_ID} as facility_id, snapshot_date, ingested_at,
           {', '.join(f"case when not {_no_value(c)} then lower(trim(regexp_replace({c}, chr(92) || 's+', ' ', 'g'))) end as {c}" for c in PROFILE)}
    from hospital_info_archive
), held as (
    select * from rows_ where facility_id <> ''
    qualify row_number() over (partition by facility_id, snapshot_date order by ingested_at desc) = 1
), place as (
    select snapshot_date, row_number() over (order by snapshot_date) as i, lead(snapshot_date) over (order by snapshot_date) as next_date
    from (select distinct snapshot_date from held)
), filled as (
    select facility_id, snapshot_date, i, next_date,
           concat_ws('|', {', '.join(f"coalesce(last_value({c} ignore nulls) over w, '~')" for c in PROFILE)}) as content
    from held join place using (snapshot_date)
    window w as (partition by facility_id order by i rows between unbounded preceding and current row)
), marked as (
    select *, lag(i) over w as before_i, lag(content) over w as before_content from filled window w as (partition by facility_id order by i)
), numbered as (
    select *, sum(case when before_i = i - 1 and before_content = content then 0 else 1 end) over (partition by facility_id order by i) as version from marked
), ends as (select facility_id, version, min(snapshot_date) as valid_from, max(i) as i from numbered group by all)
select facility_id, strftime(valid_from, '%Y-%m-%d') as valid_from, coalesce(strftime(next_date, '%Y-%m-%d'), '') as valid_to
from ends join place using (i)""",
}
