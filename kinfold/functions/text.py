"""Name and place text: normalising, phonetic codes, variants, parsing. All built-in expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to one letter, strip words, name clusters and markers.
ACCENTS = {"a": "áàâãåÁÀÂÃÅ", "e": "éèêëÉÈÊË", "i": "íìîïÍÌÎÏ", "o": "óòôõÓÒÔÕ", "u": "úùûÚÙÛ", "c": "çÇ", "n": "ñÑ"}
TITLES = ["dr.", "dr", "prof.", "prof", "ing.", "ing", "pfarrer", "dipl.", "dipl"]
AFFIXES = ["geb.", "geb", "geborene", "gebuertige", "geburtige", "verw.", "verw", "verh.", "verh", "genannt", "gen.", "gen"]
CLUSTERS = [
    ["elisabeth", "elise", "else", "lisa", "liesel", "lis", "betty"],
    ["johann", "johannes", "hans", "hannes"],
    ["margaretha", "margarethe", "margarete", "grete", "gretel", "margret", "meta"],
    ["katharina", "katarina", "kaethe", "kathrin", "kathi", "trine"],
    ["heinrich", "heinz", "heiner"],
    ["wilhelm", "willi", "willy"],
    ["friedrich", "fritz", "friedel"],
    ["wolfgang", "wolf"],
    ["gertrud", "trude", "traudel"],
    ["maria", "marie", "mia"],
]
BORN = ["geb.", "geborene", "gebürtige", "gebuertige", "geburtige", "gen.", "genannt"]
WIDOWED = ["verw.", "verw", "verh.", "verh"]
MAX_CHARS, MAX_TOKENS = 512, 65

_FROM = "".join(ACCENTS.values())
_TO = "".join(k * len(v) for k, v in ACCENTS.items())


def trim(c: Column) -> Column:
    """Without blanks, tabs, line ends, NUL and vertical tabs at both ends."""
    return F.btrim(c, F.lit(" \t\n\r\x00\x0b"))


def _tidy(folded: Column) -> Column:
    """Lower-cased tokens without strip words; of a token's dotted strip words in front one goes."""
    words = F.array(*(F.lit(w) for w in TITLES + AFFIXES))
    dotted = "|".join(w[:-1] for w in TITLES + AFFIXES if w.endswith("."))
    tokens = F.filter(F.split(F.lower(folded), r"\s+"), lambda t: (t != "") & ~F.array_contains(words, t))
    tokens = F.transform(tokens, lambda t: F.when(t.contains("."), F.regexp_replace(t, rf"^(?:{dotted})\.(?=.)", "")).otherwise(t))
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def _folded(c: Column, umlauts: dict[str, str]) -> Column:
    c = F.translate(F.substring(trim(F.coalesce(c, F.lit(""))), 1, MAX_CHARS), _FROM, _TO)
    for a, b in umlauts.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize(c: Column) -> Column:
    """Canonical form: ä to ae, accents off, lower case, titles and affixes out. Null is empty."""
    return _tidy(_folded(c, {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}))


def strip(c: Column) -> Column:
    """Coarse form: umlauts and their digraphs are one letter."""
    return F.regexp_replace(_tidy(_folded(c, {"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "Ä": "a", "Ö": "o", "Ü": "u"})), "([aou])e", "$1")


def phonetic(c: Column) -> Column:
    """Cologne phonetic code of the stripped form: h and doubles go first, then all zeros but a leading one."""
    s = F.regexp_replace(strip(c), "[^a-z]", "")
    # Letters whose code depends on a neighbour first, while the neighbours are letters still; X is an x after c, k or q.
    for pattern, code in (("p(?=h)", "3"), ("[dt](?=[csz])", "8"), ("[dt]", "2"), ("(?<=[ckq])x", "X"), ("^c(?=[ahkloqruxX])|(?<!^)(?<![sz])c(?=[ahkoquxX])", "4"), ("[cX]", "8"), ("x", "48")):
        s = F.regexp_replace(s, pattern, code)
    once = F.regexp_replace(F.translate(s, "aeijouybpfvwgkqlmnrszh", "000000011333444566788"), r"(.)\1+", "$1")
    return F.regexp_replace(once, "(?<!^)0", "")


def cluster(normal: Column) -> Column:
    """The number of a normalised given name's cluster, or null."""
    pairs = [x for k, names in enumerate(CLUSTERS) for n in names for x in (F.lit(n), F.lit(k))]
    return F.try_element_at(F.create_map(*pairs), normal)


def related(a: Column, b: Column) -> Column:
    """Whether two normalised given names are equal or variants."""
    return F.coalesce((a != "") & (b != "") & ((a == b) | (cluster(a) == cluster(b))), F.lit(False))


def segments(c: Column) -> Column:
    """Parts of a place name between commas, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim), lambda x: x != "")


def family_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(strip(c), r"\s+"), lambda t: t != ""))


def family_match(a: Column, b: Column) -> Column:
    """Whether two arrays of family_tokens name one person: two tokens shared, or both single and equal."""
    shared = F.size(F.array_intersect(a, b))
    return (shared >= 2) | ((F.size(a) == 1) & (F.size(b) == 1) & (shared == 1))


def _take_marked(tokens: Column, markers: list[str]) -> Column:
    """Struct rest, value: tokens without markers and what follows them; the value is the last such token."""
    marks = F.array(*(F.lit(m) for m in markers))
    start = F.struct(F.array().cast("array<string>").alias("rest"), F.lit("").alias("value"), F.lit(False).alias("take"))

    def step(acc: Column, t: Column) -> Column:
        mark = F.array_contains(marks, F.lower(t))
        return F.struct(
            F.when(mark | acc["take"], acc["rest"]).otherwise(F.concat(acc["rest"], F.array(t))).alias("rest"),
            F.when(~mark & acc["take"], t).otherwise(acc["value"]).alias("value"),
            mark.alias("take"),
        )

    return F.aggregate(tokens, start, step)


def parse_name(c: Column) -> Column:
    """Struct given_names, surname, birth_surname of a notice's raw name; the last token is the surname."""
    clean = F.regexp_replace(F.substring(trim(F.coalesce(c, F.lit(""))), 1, MAX_CHARS), r"[(),]+", " ")
    tokens = F.filter(F.split(F.regexp_replace(clean, r"^\s+", ""), r"\s+", MAX_TOKENS), lambda t: t != "")
    born = _take_marked(tokens, BORN)
    rest = _take_marked(born["rest"], WIDOWED)["rest"]
    n = F.size(rest)
    return F.struct(
        F.slice(rest, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("given_names"),
        F.coalesce(F.try_element_at(rest, F.when(n > 0, n).otherwise(1)), F.lit("")).alias("surname"),
        F.nullif(born["value"], F.lit("")).alias("birth_surname"),
    )


def query_hints(name: Column, year: Column, place: Column) -> Column:
    """Array of struct query, priority, key for a name struct: templates of the tiers 1 to 7, first of each stripped form, by tier."""

    def joined(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda p: trim(p) != ""), " ")

    def hint(tier: int, *parts: Column) -> Column:
        return F.struct(joined(*parts).alias("query"), F.lit(tier).alias("priority"))

    given = F.array_join(name["given_names"], " ")
    call, born, surname = (F.coalesce(name[x], F.lit("")) for x in ("call_name", "birth_surname", "surname"))
    usual = F.when(call != "", call).otherwise(given)
    married = F.flatten(F.transform(name["married_surnames"], lambda m: F.array(hint(1, given, m, year), hint(3, given, m, place))))
    rows = F.concat(married, F.array(hint(2, given, born, year), hint(4, call, surname), hint(5, given, born), hint(6, usual, surname, year), hint(7, usual, surname, place)))
    rows = F.transform(F.filter(rows, lambda r: r["query"] != ""), lambda r, i: F.struct(r["priority"].alias("priority"), i.alias("seq"), r["query"].alias("query"), strip(r["query"]).alias("key")))
    keys = F.transform(rows, lambda r: r["key"])
    first = F.filter(rows, lambda r: F.array_position(keys, r["key"]) == r["seq"] + 1)
    return F.transform(F.array_sort(first), lambda r: F.struct(r["query"].alias("query"), r["priority"].alias("priority"), r["key"].alias("key")))
