"""Evidence signals of a person and a death notice, as struct columns score, max, reasons. Missing data scores 0, never less.

A scorer reads key columns that with_keys() works out once for each side; staged projections keep each of them a single
expression in the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T


@dataclass(frozen=True)
class ScoreConfig:
    name: int = 45
    birth: int = 30
    place: int = 15
    plausibility: int = 10
    relatives: int = 0
    age: int = 0
    cemetery: int = 0
    max_penalty: int = 50
    min_age: int = 10
    max_age: int = 120
    ambiguity_gap: int = 10

    @classmethod
    def enriched(cls) -> ScoreConfig:
        return cls(name=35, birth=25, place=10, plausibility=10, relatives=35, age=20, cemetery=10)


def signal(score: Column, most: int, *reasons: Column) -> Column:
    return F.struct(F.least(score, F.lit(most)).cast("int").alias("score"), F.lit(most).alias("max"), F.array_compact(F.array(*reasons) if reasons else F.array().cast("array<string>")).alias("reasons"))


def name_keys(name: Column) -> dict[str, Column]:
    """Normalised parts of a name struct given_names, surname, birth_surname, married_surnames."""
    norm = lambda a: F.filter(F.transform(a, T.normalize), lambda x: x != "")
    given = F.transform(F.coalesce(name["given_names"], F.array().cast("array<string>")), T.normalize)
    return {
        "given": given,
        "surname": T.normalize(name["surname"]),
        "born": T.normalize(name["birth_surname"]),
        "married": norm(F.coalesce(name["married_surnames"], F.array().cast("array<string>"))),
    }


def with_keys(df: DataFrame, name: str, prefix: str, encode: Callable[[Column], Column] = T.phonetic) -> DataFrame:
    """df with normalised name columns; computed before the join, once a row of each side. encode: the code of a surname's sound, such as registry.encoder() has."""
    df = df.withColumns({f"{prefix}_{k}": c for k, c in name_keys(F.col(name)).items()})
    own = F.when(F.col(f"{prefix}_born") != "", F.col(f"{prefix}_born")).otherwise(F.col(f"{prefix}_surname"))
    df = df.withColumn(f"{prefix}_birth_name", own)
    df = df.withColumn(f"{prefix}_clusters", F.array_compact(F.transform(F.col(f"{prefix}_given"), T.cluster)))
    return df.withColumns({f"{prefix}_code": encode(F.col(f"{prefix}_surname")), f"{prefix}_birth_code": encode(F.col(f"{prefix}_birth_name"))})


def name_score(cfg: ScoreConfig, c: str = "c", n: str = "n") -> Column:
    col = lambda side, k: F.col(f"{side}_{k}")
    exact = F.exists(col(c, "given"), lambda x: (x != "") & F.array_contains(col(n, "given"), x))
    variant = F.arrays_overlap(col(c, "clusters"), col(n, "clusters"))  # equal names are exact
    given = F.when(exact, 10).when(variant, 8).otherwise(0)
    birth, born, surname = col(c, "birth_name"), col(n, "born"), col(n, "surname")
    by_born = (born != "") & (born == birth)
    by_married = (surname != "") & F.array_contains(col(c, "married"), surname)
    by_birth = ~by_born & (surname != "") & (surname == birth)
    by_sound = ~by_born & ~by_married & ~by_birth & (surname != "") & (col(n, "code") != "") & (col(n, "code") == col(c, "birth_code"))
    family = F.when(by_born, 20).otherwise(0) + F.when(by_married, 15).when(by_birth, 10).when(by_sound, 8).otherwise(0)
    role = by_born | by_married | by_birth
    maiden = (col(c, "born") == "") | (born == "") | (col(c, "born") == born)
    full = role & maiden & (col(c, "surname") == surname) & (F.size(col(c, "given")) > 0) & (col(c, "given") == col(n, "given"))
    score = F.greatest(given + family, F.when(full, F.lit(30) + given).otherwise(0))
    return signal(
        score, cfg.name, F.when(exact, "given name exact").when(variant, "given name variant"), F.when(by_born, "birth surname matches"), F.when(by_married, "married name matches"),
        F.when(by_birth & ~by_married, "surname matches birth name"), F.when(by_sound, "surname phonetic"), F.when(~role & ~by_sound, "no surname role matched"), F.when(full, "full name exact"),
    )


def birth_score(cfg: ScoreConfig, a: Column, b: Column) -> Column:
    fine = a["precision"].isin("exact", "month") & b["precision"].isin("exact", "month")
    month = lambda r: F.floor(r["lo"] / 100)
    rules = [
        (D.is_exact(a) & D.is_exact(b), F.when(a["lo"] == b["lo"], 30).otherwise(0), F.when(a["lo"] == b["lo"], "exact birth date")),
        ((D.is_exact(b) & D.contains(a, b["lo"])) | (D.is_exact(a) & D.contains(b, a["lo"])), F.lit(25), F.lit("birth within range")),
        (fine & (month(a) == month(b)), F.lit(22), F.lit("same month and year")),
        (D.first_year(a) == D.first_year(b), F.lit(16), F.lit("same year")),
        (D.overlaps(a, b), F.lit(5), F.lit("lifespan overlap")),
    ]
    both = D.known(a) & D.known(b)
    score, reason = F.when(~both, 0), F.when(~both, F.lit(None).cast("string"))
    for when, points, why in rules:
        score, reason = score.when(F.coalesce(when, F.lit(False)), points), reason.when(F.coalesce(when, F.lit(False)), why)
    return signal(score.otherwise(0), cfg.birth, reason)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def place_keys(places: Column, birth_place: Column) -> dict[str, Column]:
    """Normalised parts of a person's places (array of struct name, region, aliases) and birth place, worked out once a person."""
    none = F.array().cast("array<string>")
    parts = lambda p: T.segments(p["name"])
    named = lambda p: F.transform(F.concat(parts(p), F.coalesce(p["aliases"], none)), T.normalize)
    every = lambda f: F.flatten(F.transform(F.coalesce(places, F.array().cast("array<struct<name:string,region:string,aliases:array<string>>>")), f))
    regions = F.transform(F.coalesce(places["region"], none), T.normalize)
    long = lambda xs: F.transform(F.filter(xs, lambda x: F.length(x) >= 4), _words)
    return {
        "homes": every(named), "regions": regions, "born_at": F.coalesce(named(birth_place), none),
        "home_words": long(every(lambda p: F.transform(parts(p), T.normalize))), "region_words": long(regions),
    }


def place_points(cfg: ScoreConfig, homes: Column, regions: Column, born_at: Column, needle: Column) -> Column:
    """The place signal from place_keys() and a notice's normalised place."""
    has = lambda xs: F.coalesce(F.array_contains(xs, needle), F.lit(False))
    points = F.when(F.coalesce(needle, F.lit("")) == "", 0).when(has(homes), 12).when(has(regions), 8).when(has(born_at), 5).otherwise(0)
    return signal(points, cfg.place, F.when(points == 12, "residence matches").when(points == 8, "region matches").when(points == 5, "birth place matches"))


def place_score(cfg: ScoreConfig, places: Column, birth_place: Column, notice_place: Column) -> Column:
    """places: array of struct name, region, aliases."""
    keys = place_keys(places, birth_place)
    return place_points(cfg, keys["homes"], keys["regions"], keys["born_at"], T.normalize(notice_place["name"]))


def plausibility_score(cfg: ScoreConfig, gender: Column, birth: Column, tree_death: Column, death: Column) -> Column:
    low, high = D.first_year(death) - D.last_year(birth), D.first_year(death) - D.first_year(birth)
    age = F.coalesce((low >= cfg.min_age) & (high <= cfg.max_age), F.lit(False))
    alive, sexed = ~D.known(tree_death), F.coalesce(gender != "unknown", F.lit(False))
    points = F.when(alive, 3).otherwise(0) + F.when(sexed, 2).otherwise(0) + F.when(age, 5).otherwise(0)
    return signal(points, cfg.plausibility, F.when(alive, "no death date in tree"), F.when(sexed, "gender consistent"), F.when(age, F.concat(F.lit("plausible age ("), low.cast("string"), F.lit(")"))))


def age_score(cfg: ScoreConfig, birth: Column, age: Column, death: Column) -> Column:
    hi = D.first_year(death) - age
    lo, a, b = hi - 1, D.first_year(birth), D.last_year(birth)
    gap = F.greatest(a - hi, lo - b, F.lit(0))
    points = F.when(gap.isNull() | a.isNull() | b.isNull() | hi.isNull(), 0).when(gap == 0, 20).when(gap <= 2, 10).otherwise(0)
    return signal(points, cfg.age, F.when(points == 20, "age matches").when(points == 10, "age is close"))


def relative_score(cfg: ScoreConfig, spouses: Column, children: Column, relatives: Column) -> Column:
    """spouses, children: array of struct id, given, surname (stripped). relatives: in order, array of struct given, surname, confidence. Each relative takes the first free spouse, else child."""
    start = F.struct(F.lit(0).alias("points"), F.array().cast("array<string>").alias("taken"), F.array().cast("array<string>").alias("reasons"))

    def step(acc: Column, r: Column) -> Column:
        sure = F.when(F.isnan(r["confidence"]) | F.abs(r["confidence"]).isin(float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["confidence"])))
        free = lambda people: F.get(F.filter(people, lambda p: ~F.array_contains(acc["taken"], p["id"]) & (p["surname"] != "") & (p["surname"] == r["surname"]) & F.arrays_overlap(F.filter(p["given"], lambda g: g != ""), r["given"])), F.lit(0))["id"]
        spouse, child = free(spouses), free(children)
        points = F.when(spouse.isNotNull(), F.round(25 * sure)).when(child.isNotNull(), F.round(12 * sure)).otherwise(0).cast("int")
        hit = F.coalesce(spouse, child)
        return F.struct(
            (acc["points"] + points).alias("points"),
            F.when(hit.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(hit))).alias("taken"),
            F.when(hit.isNull(), acc["reasons"]).otherwise(F.concat(acc["reasons"], F.array(F.when(spouse.isNotNull(), "spouse matches").otherwise("child matches")))).alias("reasons"),
        )

    done = F.aggregate(relatives, start, step)
    points = F.least(done["points"], F.lit(cfg.relatives))
    return F.struct(points.alias("score"), F.lit(cfg.relatives).alias("max"), F.when(points > 0, done["reasons"]).otherwise(F.array().cast("array<string>")).alias("reasons"))


def cemetery_points(cfg: ScoreConfig, home_words: Column, region_words: Column, tokens: Column) -> Column:
    """The cemetery signal from place_keys() and the words of a notice's normalised cemetery."""
    within = lambda xs: F.exists(xs, lambda words: F.size(F.array_except(words, tokens)) == 0)
    points = F.when(F.size(tokens) <= 0, 0).when(within(home_words), 10).when(within(region_words), 6).otherwise(0)
    return signal(points, cfg.cemetery, F.when(points == 10, "cemetery at residence").when(points == 6, "cemetery in region"))


def cemetery_score(cfg: ScoreConfig, places: Column, cemetery: Column) -> Column:
    keys = place_keys(places, F.lit(None).cast("struct<name:string,region:string,aliases:array<string>>"))
    return cemetery_points(cfg, keys["home_words"], keys["region_words"], _words(T.normalize(cemetery["name"])))


def words_of(c: Column) -> Column:
    """The words of a normalised name."""
    return _words(T.normalize(c))


def conflict_tests(cfg: ScoreConfig, birth: Column, death: Column, notice_birth: Column, notice_death: Column) -> dict[str, Column]:
    """What conflicts() asks of a pair; as columns of a stage of their own each is worked out once."""
    apart = lambda a, b: F.coalesce(D.known(a) & D.known(b) & ~D.overlaps(a, b), F.lit(False))
    odd = lambda a, b: F.coalesce((a["status"] == "invalid") | (b["status"] == "invalid"), F.lit(False))
    return {
        "births_apart": apart(birth, notice_birth), "deaths_apart": apart(death, notice_death),
        "too_young": F.coalesce(D.first_year(notice_death) - D.last_year(birth) < cfg.min_age, F.lit(False)), "too_old": F.coalesce(D.last_year(notice_death) - D.first_year(birth) > cfg.max_age, F.lit(False)),
        "odd_birth": odd(birth, notice_birth), "odd_death": odd(death, notice_death),
    }


def conflicts(cfg: ScoreConfig, birth: Column, death: Column, notice_birth: Column, notice_death: Column, tests: dict[str, Column] | None = None) -> Column:
    """Struct penalty, hard, n, reasons: what speaks against the pair. tests: of conflict_tests(), where they are columns already."""
    t = tests or conflict_tests(cfg, birth, death, notice_birth, notice_death)
    year = lambda y: F.coalesce(y.cast("string"), F.lit(""))
    births, deaths = (D.shown(birth), D.shown(notice_birth)), (D.shown(death), D.shown(notice_death))
    rules = [
        ("births_apart", "birth date", *births, 30), ("deaths_apart", "death date", *deaths, 30),
        ("too_young", "age", year(D.last_year(birth)), year(D.first_year(notice_death)), 20), ("too_old", "age", year(D.first_year(birth)), year(D.last_year(notice_death)), 20),
        ("odd_birth", "birth date", *births, 0), ("odd_death", "death date", *deaths, 0),
    ]
    penalty, hard, n, reasons = F.lit(0), F.lit(False), F.lit(0), []
    for test, field, tree, notice, points in rules:
        penalty, n = penalty + F.when(t[test], points).otherwise(0), n + t[test].cast("int")
        hard = hard | t[test] if points else hard
        reasons.append(F.when(t[test], F.struct(F.lit(field).alias("field"), tree.alias("tree"), notice.alias("notice"), F.lit("hard" if points else "soft").alias("severity"))))
    return F.struct(F.least(penalty, F.lit(cfg.max_penalty)).alias("penalty"), hard.alias("hard"), n.alias("n"), F.array_compact(F.array(*reasons)).alias("reasons"))


def total(signals: list[Column], conflict: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), sum((s["score"] for s in signals), F.lit(0)) - conflict["penalty"]))


def score_pairs(pairs: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """pairs (of with_keys() columns c_*, n_*, of place_keys() columns c_*, and birth, tree_death, gender, spouses, children of the person; n_birth, n_death, n_age, n_relatives, n_needle (normalised place), n_grave (words of the cemetery) of the notice) with signals, conflicts, total."""
    c = F.col
    parts = {
        "name": name_score(cfg), "birth": birth_score(cfg, c("birth"), c("n_birth")), "place": place_points(cfg, c("c_homes"), c("c_regions"), c("c_born_at"), c("n_needle")),
        "plausibility": plausibility_score(cfg, c("gender"), c("birth"), c("tree_death"), c("n_death")),
    }
    if cfg.relatives or cfg.age or cfg.cemetery:
        parts |= {"relatives": relative_score(cfg, c("spouses"), c("children"), c("n_relatives")), "age": age_score(cfg, c("birth"), c("n_age"), c("n_death")), "cemetery": cemetery_points(cfg, c("c_home_words"), c("c_region_words"), c("n_grave"))}
    dates = c("birth"), c("tree_death"), c("n_birth"), c("n_death")
    tests = conflict_tests(cfg, *dates)
    staged = pairs.withColumns({f"__{k}": v for k, v in tests.items()})
    out = staged.withColumns({f"s_{k}": v for k, v in parts.items()} | {"conflicts": conflicts(cfg, *dates, {k: c(f"__{k}") for k in tests})}).drop(*(f"__{k}" for k in tests))
    return out.withColumn("total", total([c(f"s_{k}") for k in parts], c("conflicts")))
