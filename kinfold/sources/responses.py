"""Responses of finders: decoded from JSON and validated, with a reason where a response is refused as a whole.

Three severities: a fault of the envelope, of ownership, of a URL, a timestamp or a coverage entry refuses the whole
response; a notice without a usable name or with an unknown disposition is dropped alone; other fields of a wrong type
take a default. Bodies are parsed to VARIANT, as a typed reader would turn a number into text and pass it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U

#: Fixed values of the contract.
SCHEMA_VERSION = 1
BODY_CAP, MESSAGE_CAP = 5_242_880, 1_000
STATES = ["queued", "running", "done", "failed"]
COVERAGE_STATUSES = ["ok", "failed", "skipped"]
NOTICE_TYPES = ["obituary", "death_notice", "funeral_notice", "grave_memorial", "cemetery_record"]
DISPOSITIONS = ["burial", "cremation"]
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}(?::?\d{2})?)?\z"


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, body (the whole file). Files over the cap have a null body and are a permanent fault."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rows.withColumn("body", F.when(F.octet_length("body") <= BODY_CAP, F.col("body")))


def kind(v: Column) -> Column:
    """object, array, string, int, number, boolean or null, of a variant; null where there is none."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BIGINT", "int")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")
    )


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def string(v: Column, name: str) -> Column:
    """The field where it is a string, else null."""
    return F.when(kind(field(v, name)) == "string", F.try_variant_get(v, f"$.{name}", "string"))


def integer(v: Column, name: str) -> Column:
    return F.when(kind(field(v, name)) == "int", F.try_variant_get(v, f"$.{name}", "bigint"))


def absent(v: Column, name: str) -> Column:
    return F.coalesce(kind(field(v, name)), F.lit("null")) == "null"


def items(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def is_kind(v: Column, name: str) -> Column:
    return F.coalesce(kind(v) == name, F.lit(False))


def valid_timestamp(s: Column) -> Column:
    """Whether a whole ISO date-time of a day that exists and that its time does not leave (no hour 24, no leap second at the day's end); null is not."""
    day, hour, minute, second = F.substring(s, 1, 10), F.substring(s, 12, 2), F.substring(s, 15, 2), F.substring(s, 18, 2)
    inside = (hour <= "23") & (minute <= "59") & (second <= "60") & (F.substring(s, 12, 8) != "23:59:60")
    return F.coalesce(s.rlike(TIMESTAMP) & F.try_to_date(day, "yyyy-MM-dd").isNotNull() & inside, F.lit(False))


def notice_fault(n: Column) -> Column:
    """Why a notice refuses its response, or null."""
    return (
        F.when(~is_kind(n, "object"), "notice_not_object").when(string(n, "url").isNull(), "url_missing").when(~string(n, "url").rlike(r"^(?i)https?:"), "url_scheme")
        .when(~valid_timestamp(string(n, "fetchedAt")), "fetched_at")
    )


def notice_kept(n: Column) -> Column:
    """Whether a sound notice is of use: it has a name, and its disposition is absent or known."""
    named = F.coalesce(T.trim(string(n, "name")) != "", F.lit(False))
    return named & (absent(n, "disposition") | F.coalesce(string(n, "disposition").isin(DISPOSITIONS), F.lit(False)))


def coverage_fault(e: Column) -> Column:
    return (
        F.when(~is_kind(e, "object"), "coverage_not_object").when(F.coalesce(T.trim(string(e, "portal")), F.lit("")) == "", "coverage_portal")
        .when(~F.coalesce(string(e, "status").isin(COVERAGE_STATUSES), F.lit(False)), "coverage_status")
        .when(~absent(e, "noticeCount") & ~F.coalesce(integer(e, "noticeCount") >= 0, F.lit(False)), "coverage_count")
        .when(~absent(e, "message") & ~F.coalesce(F.length(string(e, "message")) <= MESSAGE_CAP, F.lit(False)), "coverage_message")
    )


def first_of(xs: Column, fault) -> Column:
    """The first fault of a list's members, or null."""
    return F.get(F.filter(F.transform(xs, fault), lambda f: f.isNotNull()), F.lit(0))


@dataclass(frozen=True)
class Validated:
    """jobs: all columns of the input but the body, and route, reason. notices and coverage: of accepted responses, with seq, the place in their list. found: what notices are read from by details()."""

    jobs: DataFrame
    notices: DataFrame
    coverage: DataFrame
    found: DataFrame


def _relatives(n: Column) -> Column:
    def one(r: Column) -> Column:
        number = F.when(kind(field(r, "confidence")).isin("int", "number"), F.try_variant_get(r, "$.confidence", "double"))
        return F.struct(string(r, "name").alias("name"), string(r, "relationGuess").alias("relation_guess"), number.alias("confidence"))

    whole = F.filter(F.transform(F.coalesce(F.when(is_kind(field(n, "relatives"), "array"), items(n, "relatives")), F.array().cast("array<variant>")), one), lambda r: r["name"].isNotNull() & r["relation_guess"].isNotNull() & r["confidence"].isNotNull())
    return whole


def _parsed_name(n: Column) -> Column:
    """The structured name where it holds something, else the parsed display name."""
    p = field(n, "parsedName")
    given = F.filter(F.transform(F.coalesce(F.when(is_kind(field(p, "givenNames"), "array"), items(p, "givenNames")), F.array().cast("array<variant>")), lambda g: F.when(is_kind(g, "string"), F.try_variant_get(g, "$", "string"))), lambda g: g.isNotNull())
    surname = F.coalesce(string(p, "surname"), F.lit(""))
    own = F.struct(given.alias("given_names"), surname.alias("surname"), string(p, "birthSurname").alias("birth_surname"))
    parsed = D.bind(T.parse_name(string(n, "name")), lambda x: F.struct(x["given_names"].alias("given_names"), x["surname"].alias("surname"), x["birth_surname"].alias("birth_surname")))
    return F.when(is_kind(p, "object") & ((surname != "") | (F.size(given) > 0)), own).otherwise(parsed)


def details(found: DataFrame) -> DataFrame:
    """The notices of Validated.found with their names, dates and all else, in place of n. Names and dates cost far more than the rest; where only a part of the notices is kept, that part is first told by its row_key."""
    n = F.col("n")
    type_ = F.when(string(n, "noticeType").isin(NOTICE_TYPES), string(n, "noticeType")).otherwise("obituary")
    place = lambda name: F.when(T.trim(string(n, name)) != "", string(n, name))
    own = [c for c in found.columns if c not in ("url", "row_key", "n")]
    return found.select(
        *own, type_.alias("notice_type"), string(n, "name").alias("name"), _parsed_name(n).alias("parsed_name"), *(D.parse_date(string(n, f)).alias(c) for f, c in (("birth", "birth"), ("death", "death"), ("funeralDate", "funeral_date"))),
        place("place").alias("place"), place("cemetery").alias("cemetery"), integer(n, "age").alias("age"), _relatives(n).alias("relatives"), "url", "row_key",
        F.coalesce(string(n, "source"), F.lit("")).alias("source"), string(n, "fetchedAt").alias("fetched_at"), F.coalesce(string(n, "disposition"), F.lit("burial")).alias("disposition"),
    )


def validate(responses: DataFrame, job: str = "job_id", requested: str = "requested_person_ids", body: str = "body", carry: tuple[str, ...] = (), stage: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Validated:
    """Validate one response a row.

    carry: columns of the response that its notices and coverage have, too. stage: what is done with the parsed rows before
    they are taken apart three ways, such as to persist them.

    route is completed; retry (the job is queued or running); or failed, with a reason. A null or unreadable body, one
    that is not an object, and one over the cap fail. A person who was not asked for fails the response. Row by row up to the
    lists, which are exploded after their response is accepted: no shuffle. Null job ids match nothing and fail; repeated
    rows are validated each; an empty table gives empty ones. Other columns are kept with jobs alone.
    """
    v, state = F.col("__v"), string(F.col("__v"), "state")
    results = F.try_variant_get(v, "$.results", "map<string,variant>")
    entries = F.col("__r")
    person = lambda e: (
        F.when(~F.coalesce(F.array_contains(requested, e["key"]), F.lit(False)), "person_not_requested").when(~is_kind(e["value"], "object"), "result_not_object")
        .when(~is_kind(field(e["value"], "notices"), "array"), "notices_not_list")
        .otherwise(F.coalesce(first_of(items(e["value"], "notices"), notice_fault), F.when(~is_kind(field(e["value"], "coverage"), "array"), "coverage_not_list").otherwise(first_of(items(e["value"], "coverage"), coverage_fault))))
    )
    fault = (
        F.when(F.octet_length(body) > BODY_CAP, "body_too_large").when(~is_kind(v, "object"), "body_invalid")
        .when(~F.coalesce(state.isin(STATES), F.lit(False)), "state_invalid").when(state == "failed", "finder_failed").when(state != "done", "not_done")
        .when(~F.coalesce(integer(v, "schemaVersion") == SCHEMA_VERSION, F.lit(False)), "schema_version").when(~F.coalesce(string(v, "jobId") == F.col(job), F.lit(False)), "job_id")
        .when(~(is_kind(field(v, "results"), "object") | (is_kind(field(v, "results"), "array") & (F.size(items(v, "results")) == 0))), "results_not_object")
        .otherwise(first_of(entries, person))
    )
    # Taken out of lists of one: a filter on what follows is not moved in front of them, which would parse a body anew wherever the filter names it.
    once = lambda rows, **cols: rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in cols.items())))))
    rows = once(responses, __v=F.try_parse_json(F.when(F.octet_length(body) <= BODY_CAP, F.col(body))))
    rows = rows.withColumn("__r", F.coalesce(F.map_entries(results), F.array().cast("array<struct<key:string,value:variant>>")))
    rows = once(rows, reason=fault)
    route = F.when(F.col("reason").isNull(), "completed").when(F.col("reason") == "not_done", "retry").otherwise("failed")
    rows = stage(rows.withColumn("route", route).drop("__v", body))
    jobs = rows.drop("__r")
    held = rows.where("route = 'completed'").select(F.col(job).alias("job_id"), *carry, F.explode("__r").alias("e")).select("job_id", *carry, F.col("e.key").alias("person_id"), F.col("e.value").alias("r"))
    listed = held.select("job_id", *carry, "person_id", F.posexplode(items(F.col("r"), "notices")).alias("seq", "n")).where(notice_kept(F.col("n")))
    url = string(F.col("n"), "url")
    found = listed.select("job_id", *carry, "person_id", "seq", url.alias("url"), U.row_key(url).alias("row_key"), "n")
    e = F.col("c")
    coverage = held.select("job_id", *carry, "person_id", F.posexplode(items(F.col("r"), "coverage")).alias("seq", "c")).select("job_id", *carry, "person_id", "seq", string(e, "portal").alias("portal"), string(e, "status").alias("status"), integer(e, "noticeCount").alias("notice_count"), string(e, "message").alias("message"))
    return Validated(jobs, details(found), coverage, found)
