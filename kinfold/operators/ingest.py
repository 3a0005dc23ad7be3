"""Notices meet the people that were asked for: scored, explained, classified, and merged into the stored matches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from . import ranking, scoring, stores

SIGNALS = ["name", "birth", "place", "plausibility", "relatives", "age", "cemetery"]


def _related(people: Column) -> Column:
    """Spouses or children with folded names, as relative_score() reads them."""
    none = F.array().cast("array<string>")
    return F.transform(people, lambda p: F.struct(p["id"].alias("id"), F.transform(F.coalesce(p["name"]["given_names"], none), T.strip).alias("given"), T.strip(p["name"]["surname"]).alias("surname")))


def candidate_keys(people: DataFrame) -> DataFrame:
    """people (person_id, name, gender, birth, birth_place, places, tree_death, spouses, children) with what scoring compares, worked out once a person."""
    rows = scoring.with_keys(people, "name", "c").withColumns({f"c_{k}": v for k, v in scoring.place_keys(F.col("places"), F.col("birth_place")).items()})
    return rows.withColumns({"spouses": _related(F.col("spouses")), "children": _related(F.col("children"))})


def notice_keys(notices: DataFrame) -> DataFrame:
    """Validated notices with what scoring compares, worked out once a notice."""
    c, none = F.col, F.array().cast("array<string>")
    name = F.struct(c("parsed_name.given_names").alias("given_names"), c("parsed_name.surname").alias("surname"), c("parsed_name.birth_surname").alias("birth_surname"), none.alias("married_surnames"))

    def relative(r: Column) -> Column:
        return D.bind(T.parse_name(r["name"]), lambda p: F.struct(F.transform(p["given_names"], T.strip).alias("given"), T.strip(p["surname"]).alias("surname"), r["confidence"].alias("confidence")))

    rows = scoring.with_keys(notices.withColumn("__name", name), "__name", "n").drop("__name")
    return rows.withColumns({"n_birth": c("birth"), "n_death": c("death"), "n_needle": T.normalize(c("place")), "n_grave": scoring.words_of(c("cemetery")), "n_age": c("age"), "n_relatives": F.transform("relatives", relative)}).drop("birth", "death")


def harvest(death: Column, cemetery: Column, funeral: Column, disposition: Column) -> Column:
    """Facts of a notice as a map: exact death and funeral dates, a cemetery, a cremation. They are results, never evidence."""
    day = lambda r: F.when(D.is_exact(r), D.iso(r["lo"]))
    found = {"deathDate": day(death), "cemetery": F.nullif(T.trim(F.coalesce(cemetery, F.lit(""))), F.lit("")), "funeralDate": day(funeral), "disposition": F.when(disposition == "cremation", disposition)}
    return F.map_filter(F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())


def explanation(signals: list[str]) -> Column:
    """The stored account of a match as a struct, for to_json(); the conflicts are a signal of negative score. It reads the columns of score()."""
    c = F.col
    conflict = F.struct((-c("conflicts.penalty")).alias("score"), F.transform("conflicts.reasons", lambda r: F.struct(r["field"].alias("field"), r["tree"].alias("treeValue"), r["notice"].alias("obituaryValue"), r["severity"].alias("severity"))).alias("reasons"))
    relatives = F.transform("relatives", lambda r: F.struct(r["name"].alias("name"), r["relation_guess"].alias("relationGuess"), r["confidence"].alias("confidence")))
    return F.struct(
        c("person_id").alias("personId"), c("url").alias("obituaryUrl"), c("total").alias("score"), c("conflicts.hard").alias("hardConflict"), F.struct(*(c(f"s_{k}").alias(k) for k in signals), conflict.alias("conflicts")).alias("signals"),
        c("facts").alias("extractedFacts"), relatives.alias("noticeRelatives"), c("band").alias("classification"), c("ambiguous").alias("ambiguous"), c("runner_up").alias("runnerUp"), F.lit(None).cast("string").alias("review"),
    )


def score(notices: DataFrame, candidates: DataFrame, cfg: scoring.ScoreConfig, key: Sequence[str] = ("person_id",)) -> DataFrame:
    """Every notice with its own person, scored and classified on its own; an equi-join by key, so that each pair is one row.

    notices: of notice_keys(); candidates: of candidate_keys(). There being no other candidate, none is ambiguous and there is no runner-up.
    """
    # A tree that grows must not be sent to all tasks on the strength of its size today.
    rows = scoring.score_pairs(notices.join(candidates.hint("merge"), list(key)), cfg)
    facts = harvest(F.col("n_death"), F.col("cemetery"), F.col("funeral_date"), F.col("disposition"))
    return rows.withColumns({"facts": facts, "band": ranking.capped_band(F.col("total"), F.col("conflicts.hard")), "ambiguous": F.lit(False), "runner_up": F.lit(None).cast("string")})


@dataclass(frozen=True)
class Ingested:
    """scored: a row a notice. matches: the stored matches with the new ones. warnings: key, kind, portal, n. counters: one row. stored_keys: key, row_key of each match that was stored, not being decided."""

    scored: DataFrame
    matches: DataFrame
    warnings: DataFrame
    counters: DataFrame
    stored_keys: DataFrame


def ingest(
    notices: DataFrame, coverage: DataFrame, people: DataFrame, stored: DataFrame, cfg: scoring.ScoreConfig | None = None, origin: Column | None = None, key: Sequence[str] = ("person_id",), order: Sequence[str] = ("seq",)
) -> Ingested:
    """Score notices against the people they are of and merge the matches into stored (key, row_key, url, status, reason, match, write_back, origin).

    key: what tells people apart; where there are several trees, (tree_id, person_id). Of a person's notices of one URL the
    last by order is kept; the match counts once. Rows that are decided stay. A person with
    notices who is not among people gives a warning, as does a failed portal of one who is: its silence is not a
    miss. No shuffle but by person, and by match for the merge. Empty tables give empty ones and zeros.
    """
    cfg, key = cfg or scoring.ScoreConfig.enriched(), list(key)
    held = people.select(*key).distinct()
    last = stores.last_wins(notices, [*key, "row_key"], list(order))
    scored = score(notice_keys(last), candidate_keys(people), cfg, key)
    signals = [k for k in SIGNALS if f"s_{k}" in scored.columns]
    none = F.lit(None).cast("string")
    account = F.to_json(explanation(signals), {"ignoreNullFields": "false"})
    new = scored.select(*key, "row_key", "url", F.lit("pending").alias("status"), none.alias("reason"), account.alias("match"), none.alias("write_back"), (none if origin is None else origin).alias("origin"))
    matches = stores.upsert_pending(stored, new, [*key, "row_key"])
    missing = notices.join(held, key, "left_anti").groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.lit("no_candidate").alias("kind"), none.alias("portal"), "n")
    failed = coverage.where("status = 'failed'").join(held, key, "left_semi").select(*key, F.lit("portal_failed").alias("kind"), "portal", F.lit(1).cast("long").alias("n"))
    warnings = missing.union(failed)
    decided = stored.where(F.col("status").isin(*stores.TERMINAL)).select(*key, "row_key")
    stored_keys = last.select(*key, "row_key").join(held, key, "left_semi").join(decided, [*key, "row_key"], "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    counters = count(notices, "notices_read")
    for df, name in ((held, "candidates_found"), (stored_keys, "matches_stored"), (warnings, "warnings")):
        counters = counters.crossJoin(count(df, name))  # one row each
    return Ingested(scored, matches, warnings, counters, stored_keys)
