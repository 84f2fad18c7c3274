"""Column expressions. NULL means unknown throughout: NaN becomes NULL on the way in, so no comparison sees it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masses in Da by which an ion differs from its neutral molecule (fixed values).
PROTON = 1.007276466812
ADDUCTS_POSITIVE = {"H": PROTON, "NH4": 18.033823, "NA": 22.989218, "K": 38.963158}
ADDUCTS_NEGATIVE = {"CL": 34.968852682, "FA_H": 44.998202837, "AC_H": 59.013852901}
ISOTOPE = 1.0033548378

#: Words by which a value scale is told (fixed values).
LOG_WORDS = ("log2", "log 2", "log10", "log 10", "log-transformed", "log transformed", "ln-transformed", "ln transformed")
NORM_WORDS = ("normalized", "normalised", "batch corrected", "batch-corrected", "loess", "quantile normalization", "quantile-normalization", "median normalization", "median-normalized", "internal standard normalized", "qc normalized")
SCALE_WORDS = ("scaled units", "autoscaled", "auto-scaled", "z-score", "z score", "pareto", "unit variance", "uv scaling", "uv-scaled")
RAW_WORDS = ("peak area", "abundance", "intensity", "counts", "ms count", "ion abundance")


def known(c: Column) -> Column:
    """A double that is a finite number, else NULL."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def micro(c: Column) -> Column:
    """Millionths, rounded half up to a whole number: what two engines can compare exactly."""
    return F.floor(c * 1e6 + 0.5).cast("long")


def intensity_log10(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log10(F.greatest(c, F.lit(0.0)) + 1e-9))


def cv_log10(c: Column) -> Column:
    return F.log10(F.when(c > 0, c).otherwise(0.0) + 1e-9)


def ppm_over_mean(x: Column, y: Column) -> Column:
    """Signed relative difference of two masses in millionths of their mean."""
    return (y - x) / F.greatest((x + y) / 2.0, F.lit(1e-12)) * 1e6


def student_constant(df: float) -> float:
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)


def student_t(resid: Column, scale: Column | float, df: float) -> Column:
    """Log density of Student's t; the constant is folded here, Spark has no lgamma."""
    s = F.lit(scale) if isinstance(scale, float) else scale
    s = F.when(s > 0, s).otherwise(1.0)
    return F.lit(student_constant(df)) - F.ln(s) - F.lit((df + 1) / 2) * F.log1p((resid / s) * (resid / s) / df)


def canonical_id(c: Column, prefix: str) -> Column:
    """``AN000123`` from any spelling that begins with the prefix or is a number; other strings in upper case."""
    up = F.upper(F.trim(c))
    digits = F.regexp_extract(up, rf"^(?:{prefix})?([0-9]+)$", 1)
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(digits == "", up).otherwise(F.concat(F.lit(prefix), F.when(F.length(bare) >= 6, bare).otherwise(F.lpad(bare, 6, "0"))))


def ion_mode(c: Column) -> Column:
    s = F.lower(F.coalesce(F.trim(c), F.lit("")))
    return F.when(s.contains("pos"), "positive").when(s.contains("neg"), "negative").otherwise("unknown")


def chromatography(c: Column) -> Column:
    s = F.lower(F.coalesce(F.trim(c), F.lit("")))
    return F.when(s == "", "unknown").when(s.contains("hilic"), "hilic").when(s.contains("reverse") | s.rlike(r"\brp\b") | s.contains("c18"), "reversed_phase").when(s.contains("gc"), "gc").otherwise("other")


def yes_no(c: Column) -> Column:
    s = F.lower(F.coalesce(F.trim(c), F.lit("")))
    return F.when(s == "", "unknown").when(s.startswith("y"), "yes").when(s.startswith("n"), "no").otherwise("other")


def rt_units(c: Column) -> Column:
    s = F.lower(F.coalesce(F.trim(c), F.lit("")))
    return F.when(s == "", "unknown").when(s.contains("sec"), "seconds").when(s.contains("min"), "minutes").otherwise("other")


def mz_semantics(c: Column) -> Column:
    s = F.lower(F.coalesce(F.trim(c), F.lit("")))
    return F.when(s == "", "unknown").when(s.contains("neutral"), "neutral_masses").when(s.startswith("y"), "yes").when(s.startswith("n"), "no").otherwise("other")


def value_scale(text: Column) -> tuple[Column, Column]:
    """(scale, hints) of a description: log before scaled before normalized before raw-like."""
    s = F.lower(F.coalesce(F.trim(text), F.lit("")))
    s = F.replace(F.replace(s, F.lit("normalized collision energy"), F.lit("collision energy")), F.lit("normalised collision energy"), F.lit("collision energy"))

    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | s.contains(w)
        return out

    log, scaled, norm = has(LOG_WORDS), has(SCALE_WORDS), has(NORM_WORDS)
    hints = F.concat_ws("|", F.when(log, F.lit("log_transformed")), F.when(scaled, F.lit("scaled")), F.when(norm, F.lit("normalized")), F.when(s.contains("imput"), F.lit("imputed")), F.when(s.contains("batch") & (s.contains("correct") | s.contains("drift")), F.lit("batch_adjusted")))
    scale = F.when(log, "log_transformed").when(scaled, "scaled").when(norm, "normalized").when(has(RAW_WORDS), "raw_like").otherwise("unknown")
    return scale, hints


def metabolite_name(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))


def facet_ion_mode(c: Column) -> Column:
    """The finder's form: blank stays blank, a mode that is neither positive nor negative stays as it is, in lower case."""
    s = F.lower(F.coalesce(F.trim(c), F.lit("")))
    return F.when(s.contains("pos"), "positive").when(s.contains("neg"), "negative").otherwise(s)


def facet_chromatography(c: Column) -> Column:
    s = F.lower(F.coalesce(F.trim(c), F.lit("")))
    return F.when(s.contains("hilic"), "hilic").when(s.contains("reverse") | s.contains("rp") | s.contains("c18"), "reversed_phase").when(s.contains("gc"), "gc").otherwise(s)


def facet_instrument(c: Column) -> Column:
    return F.upper(F.coalesce(F.trim(c), F.lit("")))


def sample_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "<missing>").when(c <= 5, "1-5").when(c <= 10, "6-10").when(c <= 20, "11-20").when(c <= 50, "21-50").when(c <= 100, "51-100").otherwise("101+")


def key_lookup(mapping: Column, name: str) -> Column:
    """A map's value by key, else by the first key that equals it without case and punctuation."""
    plain = "".join(ch for ch in name.lower() if ch.isalnum())
    same = F.filter(F.map_entries(mapping), lambda e: F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "") == plain)
    return F.coalesce(F.try_element_at(mapping, F.lit(name)), F.try_element_at(same, F.lit(1))["value"])
