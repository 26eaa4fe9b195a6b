"""Names of fields and datasets: normalising, matching, ordering and titles, as column expressions and small rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Misread Greek letters and what they stand for, qualifiers that say nothing about the quantity, prefixes of densities, words of fields shown last.
MISREAD = [("Ï\x81", "ρ"), ("Ï ", "ρ "), ("Î±", "α")]
QUALIFIERS = ["(condensed)", "(3d)", "(sca)", "(gba)"]
DENSITY_PREFIXES = ["ρ ", "ρ-", "rho ", "rho-"]
SECONDARY = ["curvature", "shape index", "willmore", "alpha", "α", "î±", "curvedness"]

#: Slider (lowest, highest, first, step) by part of a name, in order; those of the names v and trajectory parameter; bounds of any other range.
SLIDERS = [
    ("electron density", 0.001, 0.50, 0.05, 0.005),
    ("kinetic", 0.01, 10.0, 1.0, 0.1),
    ("modified willmore", 0.001, 1.50, 0.05, 0.01),
    ("willmore energy", 0.01, 3.50, 0.20, 0.02),
    ("shape index", 0.00, 1.00, 0.70, 0.01),
    ("curvedness", 0.05, 2.50, 0.50, 0.02),
    ("gaussian curvature", -1.00, 3.00, 0.10, 0.02),
    ("mean curvature", -0.50, 2.00, 0.30, 0.02),
]
WHOLE_NAME_SLIDER = (0.0, 1.0, 0.5, 0.01)
WIDEST = 100.0

#: Suffix of a title by part of the name, the first one that occurs.
SUFFIXES = [
    ("modified willmore energy", " (H²−K)"),
    ("willmore energy", " (H²)"),
    ("mean curvature sign change", ""),
    ("positive mean curvature", " (H⁺)"),
    ("negative mean curvature", " (H⁻)"),
    ("mean curvature", " (H)"),
    ("gaussian curvature", " (K)"),
    ("shape index", " (S)"),
    ("curvedness", " (C)"),
    ("rms curvature", ""),
    ("electron density", " (ρ)"),
    ("kinetic energy density", " (τ)"),
    ("kinetic energy", " (K)"),
    ("volume", " (V)"),
    ("trajectory parameter", " (α)"),
]

#: Names of one quantity, and words of which two names of one quantity share the first that the sought one has.
DENSITY_NAMES = ["ρ", "electron density", "density", "scf density"]
VOLUME_NAMES = ["v", "volume"]
SHARED_WORDS = ["gaussian curvature", "shape index", "curvedness", "modified willmore"]


def repaired(name: Column) -> Column:
    for wrong, right in MISREAD:
        name = F.replace(name, F.lit(wrong), F.lit(right))
    return name


def normalised(name: Column) -> Column:
    """Lower case with Greek letters repaired, without qualifiers and a density prefix; empty for null."""
    text = F.lower(F.trim(repaired(F.coalesce(name, F.lit("")))))
    for q in QUALIFIERS:
        text = F.replace(text, F.lit(q), F.lit(""))
    return F.trim(F.regexp_replace(F.trim(text), rf"^({'|'.join(DENSITY_PREFIXES)})", ""))


def matches(source: Column, target: Column) -> Column:
    """Whether two names mean one field: equal, equal when normalised, or names of one quantity; null and empty names match nothing."""
    s, t = normalised(source), normalised(target)
    has = lambda c, word: F.contains(c, F.lit(word))
    plain_mean = lambda c: has(c, "mean curvature") & ~has(c, "positive") & ~has(c, "negative") & ~has(c, "sign change")
    alias = F.when(t.isin(DENSITY_NAMES), s.isin([*DENSITY_NAMES, ""])).when(t.isin(VOLUME_NAMES), s.isin(VOLUME_NAMES)).when(has(t, "kinetic"), has(s, "kinetic"))
    alias = alias.when(has(t, "sign change"), has(s, "sign change") & (has(t, "arc fraction") == has(s, "arc fraction")))
    for sign, short in (("positive", "h+"), ("negative", "h-")):
        alias = alias.when(has(t, f"{sign} mean curvature"), has(s, f"{sign} mean curvature") | (s == short))
    alias = alias.when(plain_mean(t), plain_mean(s))
    for word in SHARED_WORDS:
        alias = alias.when(has(t, word), has(s, word))
    given = (F.length(F.coalesce(source, F.lit(""))) > 0) & (F.length(F.coalesce(target, F.lit(""))) > 0)
    same = (F.trim(source) == F.trim(target)) | ((s == t) & (s != "")) | alias.otherwise(False)
    return given & F.coalesce(same, F.lit(False))


def pattern_matches(pattern: Column, name: Column) -> Column:
    """A one-letter pattern must be all ASCII letters and digits of the name without "(condensed)"; a longer one a part of the name; an empty one matches nothing."""
    key, low = F.lower(F.trim(pattern)), F.lower(name)
    base = F.regexp_replace(F.replace(low, F.lit("(condensed)"), F.lit("")), "[^a-z0-9]", "")
    return F.when(F.length(key) == 0, False).when(F.length(key) == 1, base == key).otherwise(F.contains(low, key))


def select_fields(fields: DataFrame, patterns: list[str]) -> DataFrame:
    """(field, pattern_no) of the distinct fields that match a pattern, by the first that they match; order by (pattern_no, field)."""
    firsts = [F.when(pattern_matches(F.lit(p), F.col("field")), F.lit(i)) for i, p in enumerate(patterns)]
    return fields.select("field").distinct().withColumn("pattern_no", F.coalesce(*firsts, F.lit(None).cast("int"))).where("pattern_no is not null")


def slug(name: Column) -> Column:
    """ASCII letters and digits in lower case joined by underscores, 48 characters at most; other characters vanish."""
    text = F.regexp_replace(F.lower(F.regexp_replace(name, r"[^\x00-\x7f]", "")), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(text, "^_+|_+$", ""), 1, 48)


def is_secondary(name: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(F.lower(name), F.lit(k)) for k in SECONDARY])


def display_order(fields: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """``fields`` with ``position`` from 1 within ``key``: primary fields before secondary ones, by ``order`` within each."""
    window = Window.partitionBy(key).orderBy(F.coalesce(is_secondary(F.col(name)), F.lit(False)), order)
    return fields.withColumn("position", F.row_number().over(window))


def display_title(name: Column) -> Column:
    """Title for people: Greek repaired, no qualifier or density prefix, words capitalised, the symbol of the first quantity of SUFFIXES that occurs.

    Words that begin with a letter beyond ASCII or hold capitals after the first letter
    stay. The density alone is called Electron Density. Null gives an empty title.
    """
    words = "|".join(q.strip("()") for q in QUALIFIERS)
    clean = F.trim(F.regexp_replace(repaired(F.trim(F.coalesce(name, F.lit("")))), rf"(?i)\s*\(\s*({words})\s*\)", ""))
    low = F.lower(clean)
    clean = F.when(low.isin("ρ", "rho"), "Electron Density").otherwise(F.trim(F.regexp_replace(clean, r"(?i)^(ρ|rho) ", "")))
    cased = F.transform(
        F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 0),
        lambda w: F.when(w.rlike(r"^[^\x00-\x7f]") | F.substring(w, 2, 10_000).rlike(r"\p{Lu}"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))),
    )
    title = F.array_join(cased, " ")
    suffix = reduce(lambda c, kv: c.when(F.contains(F.lower(title), F.lit(kv[0])), kv[1]), SUFFIXES[1:], F.when(F.contains(F.lower(title), F.lit(SUFFIXES[0][0])), SUFFIXES[0][1]))
    return F.concat(title, suffix.otherwise(""))


def slider(name: Column, least: Column, most: Column) -> Column:
    """Struct (low, high, first, step) of a field's slider: by its name, else its own range within -100 and 100 in a hundred steps, (0, 1, 0.5, 0.01) without one."""
    n = F.lower(name)
    fixed = lambda v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, ("low", "high", "first", "step"), strict=True)])
    whole = (F.trim(n) == "v") | n.isin("î±", "α") | F.contains(n, F.lit("alpha")) | F.contains(n, F.lit("trajectory"))
    lo, hi = F.greatest(least, F.lit(-WIDEST)), F.least(most, F.lit(WIDEST))
    own = F.struct(*[F.round(v, 4).alias(c) for v, c in ((lo, "low"), (hi, "high"), (lo + (hi - lo) * 0.10, "first"), ((hi - lo) / 100.0, "step"))])
    rule = F.when(whole, fixed(WHOLE_NAME_SLIDER))
    for part, *v in SLIDERS:
        rule = rule.when(F.contains(n, F.lit(part)), fixed(v))
    return rule.when(most > least, own).otherwise(fixed(WHOLE_NAME_SLIDER))


def six_digits(value: Column) -> Column:
    """A number in six significant digits: plain between 1e-4 and 1e4, else in exponent form with four decimals."""
    size = F.abs(value)
    places = (5 - F.floor(F.log10(size))).cast("int")
    plain = F.regexp_replace(F.regexp_replace((F.round(value * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places)).cast("decimal(24,12)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when((size > 1e-4) & (size < 1e4), plain).otherwise(F.format_string("%.4e", value))
