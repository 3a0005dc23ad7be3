"""What a reviewer may see and do: confirm gate, retry list, bulk rejection, revert, and the filters around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from .stores import TERMINAL

#: A job id that may name a file.
SAFE_JOB_ID = r"^[A-Za-z0-9_-]{1,64}\z"
STALE_AFTER = 3_600


def exact_iso(c: Column) -> Column:
    """Whether yyyy-mm-dd of a day that exists; null is not."""
    return D.iso_to_gedcom(c).isNotNull()


def confirm_gate(hard: Column, tree_has_death: Column, iso_death: Column) -> Column:
    """Why a match must not be confirmed, the first reason that holds; null if it may. Null flags are false."""
    return F.when(F.coalesce(hard, F.lit(False)), "hard_conflict").when(F.coalesce(tree_has_death, F.lit(False)), "tree_already_has_death_date").when(~exact_iso(iso_death), "no_exact_death_date")


def in_age_window(latest_birth_year: Column, ref_year: int, min_age: int, max_age: int | None = None, include_unknown: bool = False) -> Column:
    """Whether the age by the latest birth year is in the window; an unknown one counts as include_unknown says."""
    age = F.lit(ref_year) - latest_birth_year
    return F.coalesce((age >= min_age) & (age <= max_age if max_age is not None else F.lit(True)), F.lit(include_unknown))


def searchable(name: Column) -> Column:
    """Whether any part of a name struct is not blank: given names, surname, birth surname, married surnames or aliases."""
    full = lambda c: F.coalesce(T.trim(c) != "", F.lit(False))
    many = lambda c: F.coalesce(F.exists(c, full), F.lit(False))
    return many(name["given_names"]) | full(name["surname"]) | full(name["birth_surname"]) | many(name["married_surnames"]) | many(name["aliases"])


def strict_int(c: Column, low: int, high: int, default: int) -> Column:
    """An integer of 1 to 9 digits brought into the range; anything else is the default."""
    return F.when(c.rlike(r"^[0-9]{1,9}\z"), F.greatest(F.lit(low), F.least(F.lit(high), c.try_cast("int")))).otherwise(F.lit(default))


def bulk_reject(matches: DataFrame, tokens: DataFrame, token: str = "token", person: str = "person_id", row_key: str = "row_key", status: str = "status") -> DataFrame:
    """matches with the open rows that tokens (`person:row key`) name rejected; unknown, malformed and terminal ones change nothing, repeated ones count once."""
    cut = F.split(token, ":", 2)
    named = tokens.where(F.col(token).contains(":")).select(cut[0].alias(person), cut[1].alias(row_key)).distinct().withColumn("__named", F.lit(True))
    rows = matches.join(named, [person, row_key], "left")
    hit = F.col("__named").isNotNull() & ~F.col(status).isin(*TERMINAL)
    return rows.select(*(F.when(hit, "rejected").otherwise(F.col(c)).alias(c) if c == status else F.col(c) for c in matches.columns))


def retry_list(outcomes: DataFrame, matches: DataFrame, key: str = "person_id", by: str = "name", cap: int = 50) -> DataFrame:
    """People whose search a portal failed and who have no match of any status, by name and key, as many as a view shows; total is their number before that."""
    failed = outcomes.where("outcome = 'portal_failed'").join(matches.select(key), key, "left_anti")
    total = failed.agg(F.count("*").alias("total"))
    return failed.orderBy(by, key).limit(cap).join(F.broadcast(total))


def has_many_origins(matches: DataFrame, key: list[str], origin: str) -> DataFrame:
    return matches.groupBy(*key).agg((F.count_distinct(origin) > 1).alias("many_origins"), F.array_sort(F.collect_set(origin)).alias("origins"))


def latest_change(changes: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The last pending change of each record."""
    return changes.groupBy(key).agg(F.max_by(text, order).alias(text), F.max(order).alias(order))


def revert_verdict(written: Column, existing: Column, force: Column | bool = False) -> Column:
    """reverted if all facts that were written are there still, or force is set; else facts_missing. Null arrays are empty."""
    none = F.array().cast("array<string>")
    missing = F.size(F.array_except(F.coalesce(written, none), F.coalesce(existing, none)))
    force = F.lit(force) if isinstance(force, bool) else force
    return F.when((missing == 0) | force, "reverted").otherwise("facts_missing")


def write_back(iso_death: Column, cemetery: Column, iso_funeral: Column, url: Column, cremation: Column, source: Column, tree_has_death: Column, has_event: Column, iso_today: Column) -> Column:
    """What a confirmation writes: struct reason, death, event (GEDCOM text), death_id, buri_id, crem_id (their MD5).

    reason is why nothing is written, the first that holds; null if it is. A burial needs a cemetery, a cremation does not; neither is
    written if the record has one already. A funeral date counts only with an event. Null flags are false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    clean = lambda c: F.nullif(T.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    control = lambda c: yes(c.rlike(r"[\x00-\x1F\x7F]"))
    grave, funeral, burnt = clean(cemetery), clean(iso_funeral), yes(cremation)
    dated = funeral.isNotNull() & (burnt | grave.isNotNull())
    reason = (
        F.when(~yes(url.rlike(r"^(?i)https?://")) | control(url), "url_not_clean").when(U.canonical_host(url).isNull(), "no_host").when(~exact_iso(iso_death), "no_exact_death_date")
        .when(control(grave), "cemetery_not_clean").when(dated & ~exact_iso(funeral), "no_exact_funeral_date").when(yes(tree_has_death), "death_date_present")
    )
    at = lambda c: F.replace(c, F.lit("@"), F.lit("@@"))
    cited = F.concat(F.lit("\n2 SOUR @"), source, F.lit("@\n3 PAGE "), at(url), F.lit("\n3 DATA\n4 DATE "), D.iso_to_gedcom(iso_today))
    line = lambda tag, c: F.coalesce(F.concat(F.lit(f"\n2 {tag} "), c), F.lit(""))
    death = F.concat(F.lit("1 DEAT\n2 DATE "), D.iso_to_gedcom(iso_death), cited)
    event = F.concat(F.when(burnt, "1 CREM").otherwise("1 BURI"), line("DATE", F.when(dated, D.iso_to_gedcom(funeral))), line("PLAC", at(grave)), cited)
    return D.bind(reason, lambda r: D.bind(
        F.struct(r.alias("reason"), F.when(r.isNull(), death).alias("death"), F.when(r.isNull() & (burnt | grave.isNotNull()) & ~yes(has_event), event).alias("event")),
        lambda w: F.struct(w["reason"].alias("reason"), w["death"].alias("death"), w["event"].alias("event"), F.md5(w["death"]).alias("death_id"), F.when(~burnt, F.md5(w["event"])).alias("buri_id"), F.when(burnt, F.md5(w["event"])).alias("crem_id")),
    ))


def revert_outcome(written: Column, existing: Column, force: Column) -> Column:
    """Struct outcome, deleted, target of taking back a confirmation's facts (written: array of ids, null where what was written is not known).

    Facts that are there still are deleted; without force all must be. The match goes back to pending if all were
    deleted, or with force none; else it is partial.
    """
    none = F.array().cast("array<string>")
    there = F.size(F.array_intersect(written, F.coalesce(existing, none)))
    target, force = F.size(F.array_distinct(written)), F.coalesce(force, F.lit(False))
    outcome = (
        F.when(written.isNull() | (target < 1), "invalid_write_back").when((there < target) & ~force, "refused_edited")
        .when((there == target) | (there == 0), "reverted").otherwise("partial")
    )
    deleted = F.when(outcome.isin("reverted", "partial"), there).otherwise(0)
    return F.struct(outcome.alias("outcome"), deleted.alias("deleted"), F.when(written.isNotNull(), target).otherwise(0).alias("target"))


def search_signature(given: Column, surname: Column, birth_surname: Column, birth_year: Column, places: Column, region: Column) -> Column:
    """The SHA-256, byte for byte that of the contract, of what a search depends on: equal for equal folded names, year and set of places, whatever the places' order.

    Hashed is JSON with \\/ for a slash and lower-case \\u for what is not ASCII. (Places that all look like numbers are in order of
    text here, of number there.)
    """
    fold = lambda c: T.strip(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    body = F.struct(
        F.transform(F.coalesce(given, none), fold).alias("given"), fold(surname).alias("surname"), fold(birth_surname).alias("birthSurname"), birth_year.cast("int").alias("birthYear"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce(places, none), fold))).alias("places"), fold(region).alias("region"),
    )
    text = F.replace(F.to_json(body, {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}), F.lit("/"), F.lit("\\/"))
    # Each piece after an escape (of an even number of backslashes before it) begins with its four digits.
    parts = F.split(text, r"(?<=(?<!\\)(?:\\\\){0,255})\\u")
    return F.sha2(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring(p, 1, 4)), F.substr(p, F.lit(5))))), "\\u"), 256)


def claims(jobs: DataFrame, now: int, claimed_at: str = "claimed_at") -> DataFrame:
    """jobs with state: queued, claimed, or stale (claimed so long ago that it is up for a claim again)."""
    c = F.col(claimed_at)
    return jobs.withColumn("state", F.when(c.isNull(), "queued").when(c <= now - STALE_AFTER, "stale").otherwise("claimed"))
