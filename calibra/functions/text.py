"""Drawing text as columns: normalisation, tolerance fragments, dimension tokens, kinds, notes and ranges.

Everything here is a column expression, but for nfkc(), which belongs at ingestion.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The notation's characters and patterns.
MARK = "[±士亇干土]"
DIAMETER_SIGNS = "＠@ΦØ⌀Ωω"
PLUS_MINUS_SIGNS = "士土亇干"
CONTEXT = r"(?i)(?:SCALE|DATE|DWG|DRAWING|PAGE|SHEET|REV|図番|品番|尺度|日付|材質|MODEL|PART|NO\.|型式|改訂|番号|公差|以上|超え|Rz\s*max|Rzmax|Ra\s*max|Ramax|Rmax)"
EXPLICIT_TOLERANCE = r"(?i)(?:±|士|亇|干|土|\+\s*\d|[−－一-]\s*\d|上限|下限|MAX|MIN)"
LIMIT_WORDS = r"(?i)(?:以[下上内]|MAX|MIN)"
PART_NUMBER = r"(?i)(?:[A-Z]{2,}[-_/]\d)|(?:\d[-_/][A-Z])|(?:[-/][A-Z]-\w)|(?:\w+-\d+[-/])"
ROUGHNESS = r"(?i)(?:Rz\s*max|Rzmax|Ra\s*max|Ramax|Rmax|Rz|Ra)\s*"
LIMIT_CALLOUT = r"(?i)^\s*[CR]\s*\d+(?:[.,]\d+)?\s*(?:以下|以内|MAX)\s*$"
THREAD = r"(?i)^M\s*\d+(?:[.,]\d+)?\s*[X×]\s*\d+(?:[.,]\d+)?$"
ROUGHNESS_READ_AS_RANGE = r"^(?:0\.[148]|1\.[68]|3\.2|6\.3|12\.5)\+0\.0\d$"
TOKEN = r"^([φΦØ⌀CR]?)(\d{1,4}(?:[.,]\d{1,4})?)([°。]?)$"

#: (pattern, replacement), each applied to what the one before gave.
REWRITES = (
    (r"^[の劣効](?=\d)", "φ"),
    (r"^\.0(?=\d+\.\d)", ""),
    (r"^[ー・](?=\d)", ""),
    (r"^0?\)(?=\d)", "φ"),
    (r"^[$￥€£©®§]", ""),
    ("。", "°"),
    (f"[{PLUS_MINUS_SIGNS}]", "±"),
    (r"([±+\-])0(\d{1,3})(?![\d.])", "$10.$2"),
    (r"(?<=\d),(?=\d)", "."),
    (r"(?i)(?<=\d),O(?=\d)", ".0"),
    (r"(?<=\d)[、。・·](?=\d)", "."),
    (r"(?<=\d)[‐‑‒–—−－](?=\d)", "."),
    (r"(?iu)(?<=[RφM])O(?=\d)", "0"),
    (r"(?i)(?<=\d)O(?=\d)", "0"),
    (r"(?i)(?<=\d)O$", "0"),
)
AFTER_PREFIX = (
    (r"(?i)^([CR])O(?=\.)", "$10"),
    (r"(?i)^([CR])0(?=\d)", "$10."),
    (r"(?i)(?:MIN|MAX)$", ""),
)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, without white space at either end. Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip())


def _rewrite(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def let(value: Column, then) -> Column:
    """then(value), with the value computed once and its code made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalize(text: Column) -> Column:
    """Normal form of a text that is in NFKC already; null stays null."""
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    plain = _rewrite(F.translate(compact, DIAMETER_SIGNS, "φ" * len(DIAMETER_SIGNS)), REWRITES)
    zeros = lambda t: F.concat(F.left(t, F.lit(1)), F.translate(F.substring(t, 2, 1 << 30), "O", "0"))
    return F.upper(_rewrite(let(plain, lambda t: F.when(t.rlike(r"^[φΦCRcr]."), zeros(t)).otherwise(t)), AFTER_PREFIX))


def normalize_text(text: str) -> str:
    """normalize() of one text, for steps that make texts row by row; by the same rules."""
    rules = lambda t, some: reduce(lambda x, r: re.sub(r[0], re.sub(r"\$(\d)", r"\\g<\1>", r[1]), x), some, t)
    plain = rules(re.sub(r"\s+", "", text).translate(dict.fromkeys(map(ord, DIAMETER_SIGNS), "φ")), REWRITES)
    if re.match("[φΦCRcr].", plain):
        plain = plain[0] + plain[1:].replace("O", "0")
    return rules(plain, AFTER_PREFIX).upper()


def is_fragment(text: Column) -> Column:
    """Whether a normalised text is a piece of a tolerance and no dimension."""
    marked = text.rlike(MARK)
    number = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return (
        F.when(text.rlike(r"^[φΦØ⌀CR]?\d") & marked, False).when(marked, True).when(text.rlike(r"^[+\-−±]"), True)
        .when(text.rlike(r"^0\d+$") & (F.length(text) <= 2), True).when(text.rlike(r"^\.[\d.]*\d[\d.]*$"), True).when(text.rlike(r"^0+\.\d+$"), True)
        .otherwise(F.coalesce((number < 1.0) & text.contains("."), F.lit(False)))
    )


def token(text: Column) -> Column:
    """struct(normalized, prefix, number_text, degree, nominal, reference) of a text, or null if it is no dimension. text is a column in NFKC, not a call of nfkc()."""
    reference = text.rlike(r"^[（(].+[）)]$")
    inner = F.when(reference, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)

    def parts(normal: Column) -> Column:
        number = F.replace(F.regexp_extract(normal, TOKEN, 2), F.lit(","), F.lit("."))
        return F.struct(normal.alias("normalized"), F.regexp_extract(normal, TOKEN, 1).alias("prefix"), number.alias("number_text"), F.regexp_extract(normal, TOKEN, 3).alias("degree"), number.try_cast("double").alias("nominal"), reference.alias("reference"))

    whole = lambda t: F.when(t.normalized.rlike(TOKEN) & ~is_fragment(t.normalized) & (t.nominal > 0) & (t.nominal <= 4000), t)
    return let(normalize(inner), lambda normal: let(parts(normal), whole))


def kind(prefix: Column, degree: Column) -> Column:
    """angle, diameter, chamfer, radius or linear; a degree sign outweighs the prefix."""
    return F.when(degree != "", "angle").when(prefix.isin(*"φΦØ⌀"), "diameter").when(prefix.isin("C", "Ｃ"), "chamfer").when(prefix.isin("R", "Ｒ"), "radius").otherwise("linear")


def shortest(value: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


# The words of a page's notes. A note names what it is for, then, in the same line and not far off, the figure.
UNNAMED, FIGURE = "指示(?:無|な)き", r"(\d+(?:\.\d+)?)"
ANGLE_NOTE = (f"(?:{UNNAMED})?角度公差", 40)
CORNER_NOTES = {"chamfer": ("C", "面取り"), "radius": ("R", "丸み")}
CORNER_REACH, LARGEST_REACH = 24, 30
LARGEST_NOTES = {"chamfer": (f"{UNNAMED}\\s*(?:角部|角|かど)", r"C\s*"), "radius": (f"{UNNAMED}\\s*(?:隅部|隅|すみ)", r"(?:R\s*)?(?:[は:：,、]\s*)?")}
MINUTES, DEGREES = ("′", "'", "分"), ("°", "度")


def _figure(text: Column, what: str, reach: int, sign: str, unit: str = "") -> Column:
    """The first figure behind a sign within `reach` characters of what a line names; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?i){what}[^\n]{{0,{reach}}}?{sign}{FIGURE}{unit}", 1), F.lit("")).cast("double")


def notes(text: Column) -> Column:
    """struct of a page's notes that override tolerances; every field may be null. text: the page's lines, in order, NFKC.

    A tolerance of chamfers or radii is one that names them by sign, by word, or as C/R; an angle's may be in minutes.
    """
    plus_minus = r"±\s*"
    unit = lambda some: rf"\s*(?:{'|'.join(some)})"
    degrees, minutes = (_figure(text, *ANGLE_NOTE, plus_minus, unit(some)) for some in (DEGREES, MINUTES))
    # a page that has both goes by the one it has first
    at = lambda some: F.instr(text, F.regexp_extract(text, rf"{ANGLE_NOTE[0]}[^\n]{{0,{ANGLE_NOTE[1]}}}?{plus_minus}{FIGURE}{unit(some)}", 0))
    in_minutes = minutes.isNotNull() & (degrees.isNull() | (at(MINUTES) < at(DEGREES)))
    corner = {k: F.coalesce(*[_figure(text, rf"{name}\s*(?:寸法)?\s*公差", CORNER_REACH, plus_minus) for name in (*names, r"C\s*/\s*R")]) for k, names in CORNER_NOTES.items()}
    largest = {k: _figure(text, what, LARGEST_REACH, sign, r"\s*以[下内]") for k, (what, sign) in LARGEST_NOTES.items()}
    return F.struct(
        F.when(in_minutes, minutes / 60).otherwise(degrees).alias("angle_value"),
        F.when(in_minutes, F.concat(F.lit("±"), shortest(minutes), F.lit("′"))).when(degrees.isNotNull(), F.concat(F.lit("±"), shortest(degrees), F.lit("°"))).alias("angle_text"),
        corner["chamfer"].alias("chamfer_tolerance"), corner["radius"].alias("radius_tolerance"),
        largest["chamfer"].alias("unindicated_chamfer_maximum"), largest["radius"].alias("unindicated_radius_maximum"),
    )


def family_key(stem: Column) -> Column:
    """A drawing's family: the name without trailing revision groups such as _01 or -A."""
    bare = F.regexp_replace(F.upper(stem), r"(?:[#_-](?:0?\d{1,3}|[A-Z]))+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.upper(stem))


def circled(number: Column) -> Column:
    """Circled digits of 1 to 50, else the number in brackets."""
    signs = [chr(0x2460 + k) for k in range(20)] + [chr(0x3251 + k) for k in range(15)] + [chr(0x32B1 + k) for k in range(15)]
    return F.when(number.between(1, 50), F.get(F.array(*map(F.lit, signs)), number.cast("int") - 1)).otherwise(F.concat(F.lit("("), number.cast("string"), F.lit(")")))


def clamped(text: Column, default: float, low: float, high: float) -> Column:
    return F.greatest(F.least(F.coalesce(text.try_cast("double"), F.lit(default)), F.lit(high)), F.lit(low))


def color(text: Column, default: str) -> Column:
    return F.when(text.rlike("^#[0-9a-fA-F]{6}$"), F.lower(text)).otherwise(F.lit(default))


def rgb(text: Column) -> Column:
    """array(r, g, b) from 0 to 1 of a #rrggbb colour."""
    return F.array(*[F.conv(F.substring(text, k, 2), 16, 10).cast("double") / 255 for k in (2, 4, 6)])


# How the deviations of a fit are written.
FIT_DEVIATION = r"^[()（）]*(?:[+\-−－]\s*0?(?:[.,]\d+)?|0|0[.,]\d+)(?:[()（）/\s]*[+\-−－]\s*0?(?:[.,]\d+)?)*[()（）]*$"
FIT_GLYPHS = r"^[()（）]+$"
FIT_PIECE = r"^[()（）][0-9.,+\-()（）]{0,8}$"
LARGEST_FIT_DEVIATION = 0.099


def numbers(text: Column) -> Column:
    """All numbers of a text as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def is_fit_deviation(text: Column) -> Column:
    """Whether a text is the deviations of a fit alone: small signed numbers, in brackets or not."""
    return text.rlike(r"\d") & text.rlike(FIT_DEVIATION) & F.forall(numbers(text), lambda v: v < LARGEST_FIT_DEVIATION)


def in_fit_cluster(text: Column) -> Column:
    """Whether a text belongs to a fit: its deviations, their brackets, or a piece that begins with one."""
    return is_fit_deviation(text) | text.rlike(FIT_GLYPHS) | text.rlike(FIT_PIECE)


def corner_code(text: Column) -> Column:
    """struct(sign, value) of a chamfer or radius read without its decimal point (C02 is 0.2, C12 is 12); null if there is none."""
    plain = F.regexp_replace(F.translate(F.upper(text), "〇", "0"), r"[\s.,]", "")
    sign, body = F.regexp_extract(plain, r"([CR])([O0]?\d{1,3})", 1), F.translate(F.regexp_extract(plain, r"([CR])([O0]?\d{1,3})", 2), "O", "0")
    small = body.startswith("0") & (F.length(body) > 1)
    value = F.when(small, F.concat(F.lit("0."), F.substring(body, 2, 9))).otherwise(body).try_cast("double")
    return F.when(sign != "", F.struct(sign.alias("sign"), value.alias("value")))


def canonical_key(text: Column) -> Column:
    """A dimension's name for comparisons: angle:60.0, φ13.7±0.02, 5+0.1 or φ12; null for other texts."""
    plain = F.translate(F.regexp_replace(text, r"\s+", ""), "ΩΦØ⌀士土亇干。＋－", "φφφφ±±±±°+-")
    plain = F.regexp_replace(plain, r"^[^\dφCR]+", "")
    degrees = F.regexp_extract(plain, r"^(\d+(?:\.\d+)?)°$", 1)
    signed = r"^([φCR]?)(\d+(?:\.\d+)?)(±|[+\-])(\d+(?:\.\d+)?)"
    bare = r"^([φCR]?)(\d+(?:\.\d+)?)°?$"
    part = lambda pattern, k: F.regexp_extract(plain, pattern, k)
    number = lambda pattern, k: shortest(part(pattern, k).try_cast("double"))
    return (
        F.when(degrees != "", F.concat(F.lit("angle:"), degrees.cast("double").cast("string")))
        .when(plain.rlike(r"±|[+\-]\d"), F.when(plain.rlike(signed), F.concat(part(signed, 1), number(signed, 2), part(signed, 3), number(signed, 4))))
        .when(plain.rlike(bare), F.concat(part(bare, 1), number(bare, 2)))
    )
