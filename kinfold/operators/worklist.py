"""Stored matches as a reviewer sees them: lenient projection of the stored JSON, filters, orders, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from ..sources.responses import field, integer, is_kind, string
from . import ranking, stores

STATUSES = {"open": "pending", "confirmed": "confirmed", "rejected": "rejected", "uncertain": "uncertain"}
FLAGS = {"conflict": "hard", "ambiguous": "ambiguous"}
UNCERTAIN_BELOW = 0.5


def band_key(c: Column) -> Column:
    return F.when(c.isin(*(b for b, _ in ranking.BANDS)), c).otherwise("none")


def project(matches: DataFrame, match: str = "match") -> DataFrame:
    """matches with score, band, hard, ambiguous, death_date, source_host, confirmed_url, token, read from the stored JSON.

    A value of a wrong type counts as absent: score 0, band none, flags false, no date. The token `person:row key` is
    that of an undecided row. A null or unreadable account is an empty one.
    """
    v = F.try_parse_json(F.col(match))
    flag = lambda name: F.coalesce(F.when(is_kind(field(v, name), "boolean"), F.try_variant_get(v, f"$.{name}", "boolean")), F.lit(False))
    decided = F.col("status").isin(*stores.TERMINAL)
    return matches.withColumns({
        "score": F.coalesce(integer(v, "score").cast("int"), F.lit(0)), "band": band_key(string(v, "classification")), "hard": flag("hardConflict"), "ambiguous": flag("ambiguous"),
        "death_date": D.iso_to_german(string(field(v, "extractedFacts"), "deathDate")), "death_iso": string(field(v, "extractedFacts"), "deathDate"), "source_host": U.canonical_host(F.col("url")),
        "confirmed_url": F.when(F.col("status") == "confirmed", F.col("url")), "token": F.when(~decided, F.concat_ws(":", "person_id", "row_key")),
    })


def filtered(rows: DataFrame, status: str = "all", band: str = "all", flag: str = "all") -> DataFrame:
    """Projected rows of a status, band and flag; a name that is none of these filters nothing."""
    if status in STATUSES:
        rows = rows.where(F.col("status") == STATUSES[status])
    if band in dict(ranking.BANDS):
        rows = rows.where(F.col("band") == band)
    return rows.where(F.col(FLAGS[flag])) if flag in FLAGS else rows


def order(by: str = "score") -> list[Column]:
    """score (descending; also for an unknown name), name, or death (those without last); ties by person, then row."""
    first = {"name": F.asc("person_name"), "death": F.asc_nulls_last("death_iso")}.get(by, F.desc("score"))
    return [first, F.asc("person_id"), F.asc("row_key")]


def suggestions(matches: DataFrame) -> DataFrame:
    """The undecided matches."""
    return matches.where(~F.col("status").isin(*stores.TERMINAL))


def tabs(people: DataFrame, matches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """person_id, n_suggestions, outcome, shown: whether a person's tab has anything to say, a suggestion or a failed portal."""
    n = suggestions(matches).groupBy("person_id").agg(F.count("*").alias("n_suggestions"))
    rows = people.select("person_id").join(n, "person_id", "left").join(outcomes.select("person_id", "outcome"), "person_id", "left")
    rows = rows.withColumns({"n_suggestions": F.coalesce("n_suggestions", F.lit(0)), "outcome": F.coalesce("outcome", F.lit("skipped"))})
    return rows.withColumn("shown", (F.col("n_suggestions") > 0) | (F.col("outcome") == "portal_failed"))


def notice_relatives(relatives: Column) -> Column:
    """Relatives of a stored account (array of variant) for display: trimmed names, folded guesses, unsure ones marked, nameless ones left out."""

    def one(r: Column) -> Column:
        number = F.coalesce(F.try_variant_get(r, "$.confidence", "double"), F.lit(0.0))
        sure = F.when(is_kind(field(r, "confidence"), "int") | is_kind(field(r, "confidence"), "number"), number).otherwise(0.0)
        return F.struct(T.trim(string(r, "name")).alias("name"), F.coalesce(F.lower(T.trim(string(r, "relationGuess"))), F.lit("")).alias("relation"), (sure < UNCERTAIN_BELOW).alias("uncertain"))

    return F.filter(F.transform(relatives, one), lambda r: F.coalesce(r["name"] != "", F.lit(False)))


def in_tree(names: Column, members: Column) -> Column:
    """Which of some names (array of strings) name a member of the family, too: array of booleans."""
    tokens = F.transform(members, T.family_tokens)
    return F.transform(names, lambda n: D.bind(T.family_tokens(n), lambda x: F.exists(tokens, lambda m: T.family_match(x, m))))


def decoded(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows of stored JSON documents with ok and, where ok, their typed fields: person_id, url, status, reason, match, write_back, origin.

    A document that is no object, has a field of a wrong type or an unknown status is corrupt: ok is false, all else
    null. A scan leaves such rows out, a lookup of one must not.
    """
    v = F.try_parse_json(F.col(raw))
    text, kinds = lambda name: string(v, name), ["pending", "uncertain", "confirmed", "rejected"]
    maybe = lambda name, kind: F.coalesce(is_kind(field(v, name), kind), F.lit(False)) | field(v, name).isNull() | is_kind(field(v, name), "null")
    ok = is_kind(v, "object") & text("personId").isNotNull() & text("obituaryUrl").isNotNull() & F.coalesce(text("status").isin(kinds), F.lit(False)) & is_kind(field(v, "match"), "object") & maybe("reason", "string") & maybe("writeBack", "object") & maybe("originFinderId", "string")
    fields = {"person_id": text("personId"), "url": text("obituaryUrl"), "status": text("status"), "reason": text("reason"), "match": F.to_json(field(v, "match")), "write_back": F.when(is_kind(field(v, "writeBack"), "object"), F.to_json(field(v, "writeBack"))), "origin": text("originFinderId")}
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumns({k: F.when(F.col("ok"), c) for k, c in fields.items()})


def in_place(rows: DataFrame, folder: str = "folder") -> DataFrame:
    """Documents that lie in the folder named after the SHA-256 of their person; others are misfiled or foreign."""
    return rows.where(F.col(folder) == F.sha2("person_id", 256))
