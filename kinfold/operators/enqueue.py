"""Whom to search for: people in order of id, without those in flight, nameless, or searched in vain of late; and what is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import review, stores

#: Fixed values of the request contract.
NAME_CHARS, NAME_ENTRIES, QUERY_CHARS, KEY_CHARS, HINTS, HOSTS, HOST_CHARS = 200, 10, 500, 200, 50, 50, 253
HOST = r"^[^\s\p{Z}\p{C}/:?#\[\]@\\*%A-Z]+\z"


def in_flight(jobs: DataFrame, tree: int) -> DataFrame:
    """person_id of all people that a job of the tree, queued or claimed, asks for."""
    return jobs.where(F.col("tree_id") == tree).select(F.explode("requested_person_ids").alias("person_id")).distinct()


def last_searches(memory: DataFrame, finder: str) -> DataFrame:
    """person_id, remembered, recorded_at: the last search in vain of each person by one finder."""
    last = stores.last_wins(memory.where(F.col("finder_id") == finder).select("person_id", "signature", "recorded_at"), ["person_id"], "recorded_at")
    return last.select("person_id", F.col("signature").alias("remembered"), "recorded_at")


def forget_found(memory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """memory without anyone, by any finder, of whom a search has found something."""
    return memory.join(outcomes.where("outcome = 'found'").select("person_id").distinct(), "person_id", "left_anti")


def open_hosts(matches: DataFrame) -> DataFrame:
    """person_id, excluded_hosts: the hosts of each person's undecided matches, in order, as far as the contract takes them."""
    rows = matches.where(~F.col("status").isin(*stores.TERMINAL)).select("person_id", U.canonical_host(F.col("url")).alias("host")).where("host is not null")
    hosts = F.array_sort(F.collect_set("host"))
    return rows.groupBy("person_id").agg(F.slice(F.filter(hosts, host_conforms), 1, HOSTS).alias("excluded_hosts"), F.count_distinct("host").alias("n_hosts"))


def host_conforms(host: Column) -> Column:
    return host.rlike(HOST) & (F.length(host) <= HOST_CHARS)


def select_eligible(people: DataFrame, flying: DataFrame, memory: DataFrame, finder: str, limit: int, now: int, ttl: int = 2_592_000) -> tuple[DataFrame, DataFrame]:
    """The first `limit` people by bytes of person_id who may be searched for, and a row with eligible, skipped, suppressed.

    people has person_id, name, signature. Someone in flight is skipped; a nameless one is left out unseen; one whose last search by
    this finder was in vain, with the same signature and less than ttl seconds ago, is suppressed. Only those before the
    last eligible one are counted, if the limit is reached. A limit under 1 takes none and counts none. No row goes to
    the driver; the limit is a top-k by id, the counts are sums.
    """
    if limit < 1:
        return people.limit(0), people.sparkSession.sql("SELECT 0L AS eligible, 0L AS skipped, 0L AS suppressed")
    rows = people.join(flying.withColumn("__flying", F.lit(True)), "person_id", "left").join(last_searches(memory, finder), "person_id", "left")
    suppressed = F.coalesce((F.col("remembered") == F.col("signature")) & (F.lit(now) - F.col("recorded_at") < ttl), F.lit(False))
    state = F.when(F.col("__flying"), "skipped").when(~review.searchable(F.col("name")), "nameless").when(suppressed, "suppressed").otherwise("eligible")
    rows = rows.withColumn("__state", state)
    taken = rows.where("__state = 'eligible'").orderBy("person_id").limit(limit)
    end = taken.agg(F.when(F.count("*") == limit, F.max("person_id")).alias("__end"))
    seen = rows.select("person_id", "__state").crossJoin(F.broadcast(end)).where("__end is null or person_id <= __end")  # one row
    counts = seen.agg(*(F.count_if(F.col("__state") == s).alias(s) for s in ("eligible", "skipped", "suppressed")))
    return taken.select(*people.columns), counts


def name_entries(name: Column) -> Column:
    """The names of a request, at most NAME_ENTRIES: primary, birth, married and alias ones, cut to NAME_CHARS, blank ones left out."""
    cut = lambda c: F.nullif(T.trim(F.substring(T.trim(F.coalesce(c, F.lit(""))), 1, NAME_CHARS)), F.lit(""))
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")

    def entry(kind: str, given: Column = null, surname: Column = null, full: Column = null) -> Column:
        return F.struct(F.lit(kind).alias("kind"), given.alias("given"), surname.alias("surname"), full.alias("full"))

    given = cut(F.array_join(F.filter(F.transform(F.coalesce(name["given_names"], none), T.trim), lambda g: g != ""), " "))
    many = lambda field: F.coalesce(name[field], none)
    entries = F.concat(
        F.array(entry("primary", given, cut(name["surname"]))), F.array(entry("birth", surname=cut(name["birth_surname"]))), F.transform(many("married_surnames"), lambda m: entry("married", surname=cut(m))), F.transform(many("aliases"), lambda a: entry("alias", full=cut(a))),
    )
    return F.slice(F.filter(entries, lambda e: e["given"].isNotNull() | e["surname"].isNotNull() | e["full"].isNotNull()), 1, NAME_ENTRIES)


def hint_entries(hints: Column) -> Column:
    """Search hints (query, priority, key) as a request has them: cut, trimmed, without blank ones, at most HINTS."""
    cut = F.transform(hints, lambda h: F.struct(T.trim(F.substring(h["query"], 1, QUERY_CHARS)).alias("query"), T.trim(F.substring(h["key"], 1, KEY_CHARS)).alias("dedupKey"), F.greatest(h["priority"], F.lit(1)).alias("priority")))
    return F.slice(F.filter(cut, lambda h: (h["query"] != "") & (h["dedupKey"] != "")), 1, HINTS)


def requests(eligible: DataFrame, matches: DataFrame) -> DataFrame:
    """person_id, request (JSON), n_hosts of each eligible person (with name, hints); hosts are left out where there are none."""
    theirs = matches.join(eligible.select("person_id"), "person_id", "left_semi")  # hosts are worked out of their matches alone
    rows = eligible.join(open_hosts(theirs), "person_id", "left")
    hosts = F.when(F.size("excluded_hosts") > 0, F.col("excluded_hosts"))
    body = F.struct(F.col("person_id").alias("personId"), name_entries(F.col("name")).alias("names"), hint_entries(F.col("hints")).alias("queryHints"), hosts.alias("excludedHosts"))
    return rows.select("person_id", F.to_json(body).alias("request"), F.coalesce("n_hosts", F.lit(0)).alias("n_hosts"))


def fan_out(summaries: DataFrame) -> DataFrame:
    """One row: sums of eligible, skipped, suppressed over finders, and the ids of the jobs that were made."""
    return summaries.agg(*(F.sum(c).alias(c) for c in ("eligible", "skipped", "suppressed")), F.array_sort(F.collect_set("job_id")).alias("job_ids"))


def job_id(at: Column, noise: Column) -> Column:
    """job-<UTC time>-<8 hex digits> of a timestamp and any string that differs from job to job."""
    return F.concat(F.lit("job-"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.md5(noise), 1, 8))
