"""Settings, finder connections and capability documents, narrowed to what is valid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scoring import ScoreConfig
from .responses import field, integer, is_kind, items, kind, string

#: The fields of a notice that a finder may say it fills.
NOTICE_FIELDS = ["death", "birth", "place", "cemetery", "age", "funeralDate", "relatives", "disposition"]
#: Settings of the score: field, least, most. The defaults are those of the enriched configuration.
WEIGHTS = {"name": (0, 100), "birth": (0, 100), "place": (0, 100), "plausibility": (0, 100), "max_penalty": (0, 100), "ambiguity_gap": (0, 100)}


def score_config(get: Callable[[str, str], str]) -> ScoreConfig:
    """The enriched configuration with the settings that get(field, default) returns; anything but 1 to 9 digits is the default, values are brought into range."""
    base = ScoreConfig.enriched()
    read = {k: get(k, str(getattr(base, k))) for k in WEIGHTS}
    return replace(base, **{k: max(low, min(most, int(read[k]))) for k, (low, most) in WEIGHTS.items() if read[k].isascii() and read[k].isdigit() and len(read[k]) <= 9})


def base_key(url: Column) -> Column:
    """What tells finders apart: the base URL without slashes at its end."""
    return F.regexp_replace(url, r"/+\z", "")


def connectable(url: Column, token: Column) -> Column:
    """Whether a finder may be reached so: an http or https URL with a host (an IPv6 address in brackets), a port up to 65535 if any, no credentials and, like the token, no control character."""
    control = lambda c: F.coalesce(c.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))
    host = r"^(?i)https?://(?:\[[0-9a-f:.]+\]|[^/?#@\s:\[\]]+)"
    whole = url.rlike(host + r"(:\d{0,5})?([/?#]\S*)?\z")
    port = F.coalesce(F.regexp_extract(url, host + r":(\d{1,5})(?:[/?#]|\z)", 1).try_cast("int"), F.lit(0))
    return F.coalesce(whole & (port <= 65_535), F.lit(False)) & ~control(url) & ~control(token)


def finders(config: DataFrame, owner: str = "owner", base: str = "base_url", token: str = "token", more: str = "additional") -> DataFrame:
    """owner, seq, base_url, key, token: the primary finder of each owner (seq 0), then the active ones of a JSON list, each base once, the first wins.

    A list that cannot be read has none; entries that are not active, have no base URL or may not be reached are left out.
    """
    none = F.lit(None).cast("string")
    first = config.select(owner, F.lit(0).alias("seq"), F.col(base).alias("base_url"), F.nullif(F.col(token), F.lit("")).alias("token"))
    v = F.try_parse_json(F.col(more))
    listed = config.select(owner, F.posexplode(F.when(is_kind(v, "array"), F.try_variant_get(v, "$", "array<variant>"))).alias("pos", "e"))
    e, on = F.col("e"), F.when(is_kind(field(F.col("e"), "active"), "boolean"), F.try_variant_get(F.col("e"), "$.active", "boolean"))
    others = listed.where(F.coalesce(on, F.lit(False))).select(owner, (F.col("pos") + 1).alias("seq"), string(e, "baseUrl").alias("base_url"), F.nullif(F.coalesce(string(e, "token"), none), F.lit("")).alias("token"))
    rows = first.union(others).where(connectable(F.col("base_url"), F.col("token"))).withColumn("key", base_key(F.col("base_url")))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(owner, "key").orderBy("seq"))).where("__n = 1")
    return rows.select(owner, "seq", "base_url", "key", "token")


def capabilities(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """docs with capability: struct finder_id, finder_version, retention_seconds, schema_versions, portals, notice_fields, features, or null where a document is of no use.

    It needs an id, a retention of a second to a year, a schema version and a portal that are valid; notice fields may be absent, but
    not of a wrong type; other fields of a wrong type count as absent.
    """
    v = F.try_parse_json(F.col(raw))
    text = lambda x, name, most: F.when(F.length(string(x, name)) <= most, string(x, name))
    listed = lambda x, name: F.when(is_kind(field(x, name), "array"), items(x, name))
    as_int = lambda x: F.when(kind(x) == "int", F.try_variant_get(x, "$", "bigint"))
    as_text = lambda x: F.when(kind(x) == "string", F.try_variant_get(x, "$", "string"))
    versions = F.array_distinct(F.filter(F.transform(listed(v, "schemaVersions"), as_int), lambda n: n.between(1, 1000)))

    def portal(p: Column) -> Column:
        country = F.when(string(p, "country").rlike(r"^[A-Z]{2}\z"), string(p, "country"))
        regions = F.filter(F.transform(F.coalesce(listed(p, "regions"), F.array().cast("array<variant>")), as_text), lambda r: F.length(r) <= 200)
        return F.struct(F.when(string(p, "id").rlike(r"^[a-z0-9][a-z0-9_.-]{0,63}\z"), string(p, "id")).alias("id"), text(p, "name", 200).alias("name"), country.alias("country"), regions.alias("regions"))

    portals = F.filter(F.transform(listed(v, "portals"), portal), lambda p: p["id"].isNotNull())
    raw_fields, there = listed(v, "noticeFields"), field(v, "noticeFields").isNotNull()
    fields_ok = ~there | F.coalesce(F.forall(raw_fields, lambda x: F.coalesce(kind(x) == "string", F.lit(False))), F.lit(False))
    fields = F.coalesce(F.filter(F.transform(raw_fields, as_text), lambda x: x.isin(NOTICE_FIELDS)), F.array().cast("array<string>"))
    flags = F.try_variant_get(v, "$.features", "map<string,variant>")
    features = F.transform_values(F.map_filter(F.coalesce(flags, F.create_map().cast("map<string,variant>")), lambda _, x: F.coalesce(kind(x) == "boolean", F.lit(False))), lambda _, x: F.try_variant_get(x, "$", "boolean"))
    keep = integer(v, "retentionSeconds").between(1, 31_536_000)
    ok = is_kind(v, "object") & (text(v, "finderId", 128) != "") & keep & (F.size(versions) > 0) & (F.size(portals) > 0) & fields_ok
    found = F.struct(
        string(v, "finderId").alias("finder_id"), text(v, "finderVersion", 100).alias("finder_version"), integer(v, "retentionSeconds").alias("retention_seconds"), versions.alias("schema_versions"),
        portals.alias("portals"), fields.alias("notice_fields"), features.alias("features"),
    )
    return docs.withColumn("capability", F.when(F.coalesce(ok, F.lit(False)), found))
