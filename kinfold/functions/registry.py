"""Encoders of names as SQL functions, chosen by name: temporary functions with a body, which the optimizer puts in place of their calls.

What a call of one becomes is the plan of its body, as if it were written out; so an encoder costs no more than the
column functions, and SQL text can use it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T


def _words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def strip_body(x: str) -> str:
    """text.strip() as SQL."""
    blank = r"[ \t\n\r\x00\x0B]+"
    folded = f"substring(regexp_replace(coalesce({x}, ''), r'^{blank}|{blank}$', ''), 1, {T.MAX_CHARS})"
    plain = "".join(k * len(v) for k, v in T.ACCENTS.items())
    folded = f"translate({folded}, '{''.join(T.ACCENTS.values())}', '{plain}')"
    for a, b in {"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "Ä": "a", "Ö": "o", "Ü": "u"}.items():
        folded = f"replace({folded}, '{a}', '{b}')"
    words = T.TITLES + T.AFFIXES
    dotted = "|".join(w[:-1] for w in words if w.endswith("."))
    tokens = f"filter(split(lower({folded}), r'\\s+'), t -> t <> '' AND NOT array_contains(array({_words(words)}), t))"
    tokens = f"filter(transform({tokens}, t -> regexp_replace(t, r'^(?:{dotted})\\.(?=.)', '')), t -> t <> '')"
    return f"regexp_replace(array_join({tokens}, ' '), r'([aou])e', '$1')"


def _cologne(x: str) -> str:
    """text.phonetic() as SQL, of a stripped form."""
    s = f"regexp_replace({x}, '[^a-z]', '')"
    for pattern, code in (("p(?=h)", "3"), ("[dt](?=[csz])", "8"), ("[dt]", "2"), ("(?<=[ckq])x", "X"), ("^c(?=[ahkloqruxX])|(?<!^)(?<![sz])c(?=[ahkoquxX])", "4"), ("[cX]", "8"), ("x", "48")):
        s = f"regexp_replace({s}, '{pattern}', '{code}')"
    s = f"regexp_replace(translate({s}, 'aeijouybpfvwgkqlmnrszh', '000000011333444566788'), r'(.)\\1+', '$1')"
    return f"regexp_replace({s}, '(?<!^)0', '')"


def _skeleton(x: str) -> str:
    """The first letter of a stripped form and the consonants after it."""
    s = f"regexp_replace({x}, '[^a-z]', '')"
    return f"concat(substring({s}, 1, 1), regexp_replace(substring({s}, 2), '[aeiouy]', ''))"


#: Encoders by name: SQL of a code, of the SQL of a stripped form.
ENCODERS: dict[str, Callable[[str], str]] = {"cologne": _cologne, "skeleton": _skeleton}


def register(spark: SparkSession, encoder: str = "cologne") -> None:
    """Make kinfold_strip(x) and kinfold_encode(x), the latter by the encoder of that name, known to the session's SQL. An unknown name raises."""
    if encoder not in ENCODERS:
        raise ValueError(f"no encoder {encoder}; there are {', '.join(sorted(ENCODERS))}")
    make = "CREATE OR REPLACE TEMPORARY FUNCTION {}(x STRING) RETURNS STRING RETURN {}"
    spark.sql(make.format("kinfold_strip", strip_body("x")))
    spark.sql(make.format(f"kinfold_encode_{encoder}", ENCODERS[encoder](strip_body("x"))))
    spark.sql(make.format("kinfold_encode", ENCODERS[encoder](strip_body("x"))))


def encoder(name: str) -> Callable[[Column], Column]:
    """A registered encoder as a column function, as scoring.with_keys() takes it."""
    return lambda c: F.call_function(f"kinfold_encode_{name}", c)
