"""A family tree's tables as people: names, dates, places, families and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D
from ..functions import text as T

#: What stands for an unknown given name and surname; the prefix of a portal's reference number.
UNKNOWN_NAMES = ["@P.N.", "@N.N."]
PORTAL = "portal:"


def _by(rows: DataFrame, others: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffles: a tree that grows must not be sent to all tasks on the strength of its size today."""
    return rows.join(others.hint("merge"), on, how)


def call_name(record: Column) -> Column:
    """The value of a record's first _RUFNAME line of any level, or null."""
    return F.nullif(T.trim(F.regexp_extract(record, r"(?m)^\d+ _RUFNAME ([^\r\n]*)", 1)), F.lit(""))


def tree_date(raw: Column, ok: Column, y1: Column, m1: Column, d1: Column, y2: Column, m2: Column, d2: Column) -> Column:
    """A range from a tree's date: its text, whether it was understood, and its first and last day (0 where there is no month or day).

    Empty text is unknown, what was not understood is invalid; bounds in the wrong order are swapped. The qualifier in front decides
    on the precision, then whether years, months and days agree.
    """
    key = lambda y, m, d, last: y * 10000 + F.when(m == 0, 12 if last else 1).otherwise(m) * 100 + F.when(d == 0, D.days_in(y, F.when(m == 0, 12).otherwise(m)) if last else 1).otherwise(d)
    swap = key(y1, m1, d1, False) > key(y2, m2, d2, True)
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    (ya, ma, da), (yb, mb, db) = (pick(y1, y2), pick(m1, m2), pick(d1, d2)), (pick(y2, y1), pick(m2, m1), pick(d2, d1))
    front = F.upper(F.regexp_extract(raw, r"^\s*(\S+)\s", 1))
    precision = (
        F.when(front.isin("ABT", "EST", "CAL"), "approximate").when(front.isin("BET", "FROM") | (ya != yb), "interval").when(ma != mb, "month")
        .when((da != 0) & (da == db), "exact").when(ma != 0, "month").otherwise("year")
    )
    none, text = F.lit(None).cast("int"), F.trim(F.regexp_replace(raw, r"\s+", " "))
    return (
        F.when(F.coalesce(T.trim(raw), F.lit("")) == "", D.date_range(none, none, "open", "unknown")).when(~F.coalesce(ok, F.lit(False)), D.date_range(none, none, "open", "invalid", text))
        .otherwise(D.date_range(key(ya, ma, da, False), key(yb, mb, db, True), precision, "known", text))
    )


def names(rows: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """person_id, name of rows person_id, seq, main, type, givn, surn: one main name; _MARNM surnames; given names of other NAMEs as aliases.

    records (person_id, record), if given, say what a person is called; one without any name has that alone.
    """
    own = lambda c: D.bind(T.trim(F.coalesce(F.col(c), F.lit(""))), lambda x: F.when(x.isin(*UNKNOWN_NAMES), "").otherwise(x))
    rows = rows.select("person_id", "seq", "main", "type", own("givn").alias("givn"), own("surn").alias("surn"))
    inside = lambda when, c: F.transform(F.array_sort(F.collect_list(F.when(when & (F.col(c) != "") & ~F.col("main"), F.struct("seq", c)))), lambda x: x[c])
    main = F.max_by(F.struct("givn", "surn"), F.when(F.col("main"), -F.col("seq")))
    got = rows.groupBy("person_id").agg(main.alias("m"), inside(F.col("type") == "_MARNM", "surn").alias("married_surnames"), inside(F.col("type") == "NAME", "givn").alias("aliases"))
    given = F.filter(F.split(F.coalesce("m.givn", F.lit("")), r"\s+"), lambda g: g != "")
    called = F.lit(None).cast("string")
    if records is not None:
        got = _by(got, records.select("person_id", call_name(F.col("record")).alias("call_name")).where("call_name is not null"), "person_id", "full_outer")
        called = F.col("call_name")
    none = F.array().cast("array<string>")
    name = F.struct(
        given.alias("given_names"), called.alias("call_name"), F.coalesce("m.surn", F.lit("")).alias("surname"), F.nullif(F.col("m.surn"), F.lit("")).alias("birth_surname"),
        F.coalesce("married_surnames", none).alias("married_surnames"), F.coalesce("aliases", none).alias("aliases"),
    )
    return got.select("person_id", name.alias("name"))


def places(facts: DataFrame) -> DataFrame:
    """person_id, places, birth_place of rows person_id, seq, tag, place: those of births and residences in order; the first is the birth place, whichever it is of."""
    none = F.array().cast("array<string>")
    rows = facts.where(F.col("tag").isin("BIRT", "RESI")).select("person_id", "seq", T.trim(F.col("place")).alias("place")).where("place <> ''")
    one = lambda p: F.struct(p.alias("name"), F.lit(None).cast("string").alias("region"), none.alias("aliases"))
    got = rows.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("seq", "place"))).alias("p")).select("person_id", F.transform("p", lambda x: one(x["place"])).alias("places"))
    return got.withColumn("birth_place", F.get("places", F.lit(0)))


def relatives(links: DataFrame, people: DataFrame) -> DataFrame:
    """person_id, member, relation, seq: spouses and children in the families where a person is a spouse, then parents in those where it is a child.

    links: family_id, person_id, role (spouse or child), seq, the place in the family; families go by id. Members who are not visible are left out; one who is several
    has the first relation; nobody is a relative of themselves. Joined by family, a family being a bounded group.
    """
    a, b = links.select("family_id", "person_id", F.col("role").alias("own")), links.select("family_id", F.col("person_id").alias("member"), "role", F.col("seq").alias("place"))
    rows = _by(a, b, "family_id").where("person_id <> member and (own = 'spouse' or role = 'spouse')")
    relation = F.when(F.col("own") == "child", "parent").otherwise(F.col("role"))
    rank = F.when(F.col("own") == "child", 2).when(F.col("role") == "spouse", 0).otherwise(1)
    at = F.struct((F.col("own") == "child").alias("late"), "family_id", rank.alias("rank"), "place")
    best = rows.select("person_id", "member", relation.alias("relation"), at.alias("seq")).groupBy("person_id", "member").agg(F.min_by("relation", "seq").alias("relation"), F.min("seq").alias("seq"))
    return _by(best, people.where("visible").select(F.col("person_id").alias("member")), "member").select("person_id", "member", "relation", "seq")


def hydrate(people: DataFrame, name_rows: DataFrame, facts: DataFrame, links: DataFrame, ids: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """The visible people (person_id, sex, visible, birth, death) as scoring takes them; ids, if given, says whose.

    records (person_id, record) say what people are called. A person without names has an empty one. Spouses and children
    carry their own names. All joins are by person; with ids only the rows of those people and their families are put together.
    """
    if ids is not None:
        ids = ids.select("person_id").distinct()
        families = links.join(ids, "person_id", "left_semi").select("family_id").distinct()
        links = links.join(families, "family_id", "left_semi")
        facts = facts.join(ids, "person_id", "left_semi")
    wanted = people if ids is None else people.join(ids, "person_id", "left_semi")
    gender = F.when(F.col("sex") == "M", "male").when(F.col("sex") == "F", "female").otherwise("unknown")
    named = names(name_rows, records)
    null, none = F.lit("").cast("string"), F.array().cast("array<string>")
    nobody = F.struct(none.alias("given_names"), F.lit(None).cast("string").alias("call_name"), null.alias("surname"), F.lit(None).cast("string").alias("birth_surname"), none.alias("married_surnames"), none.alias("aliases"))
    kin = _by(relatives(links, people).where("relation <> 'parent'"), named.withColumnsRenamed({"person_id": "member", "name": "member_name"}), "member", "left")
    member = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.struct("seq", F.col("member").alias("id"), F.col("member_name").alias("name"))))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    kin = kin.groupBy("person_id").agg(member("spouse").alias("spouses"), member("child").alias("children"))
    rows = wanted.where("visible").select("person_id", gender.alias("gender"), "birth", F.col("death").alias("tree_death"))
    rows = _by(rows, named, "person_id", "left").withColumn("name", F.coalesce("name", nobody))
    return _by(_by(rows, places(facts), "person_id", "left"), kin, "person_id", "left")


def portal_sources(accepted: DataFrame, pending: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, source of each host: an accepted source that carries its reference number and has no change pending, else a pending one that carries it, by order of id; null where one has to be made.

    accepted: source_id, record. pending: source_id, change_id, record (the last change of a record counts).
    """
    number = lambda c: F.regexp_extract(c, rf"(?m)^1 REFN {PORTAL}([^\r\n]*)", 1)
    last = pending.groupBy("source_id").agg(F.max_by("record", "change_id").alias("record"))
    rows = accepted.where(F.col("record").contains(PORTAL)).join(last.select("source_id"), "source_id", "left_anti").select(F.lit(0).alias("rank"), "source_id", number(F.col("record")).alias("host"))
    rows = rows.union(last.select(F.lit(1), "source_id", number(F.col("record"))))
    return hosts.select("host").distinct().join(rows.where("host <> ''").groupBy("host").agg(F.min(F.struct("rank", "source_id")).alias("x")), "host", "left").select("host", F.col("x.source_id").alias("source"))


def new_source(host: Column) -> Column:
    """The record of a portal's source."""
    return F.concat(F.lit("0 @@ SOUR\n1 TITL Death notice: "), host, F.lit("\n1 PUBL "), host, F.lit(f"\n1 REFN {PORTAL}"), host)


def family_view(links: DataFrame, people: DataFrame) -> DataFrame:
    """relatives() numbered in order of display."""
    return relatives(links, people).withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy("seq")))
