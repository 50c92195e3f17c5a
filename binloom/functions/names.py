"""Names of processes, histograms and variations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Process-name fragments, tested in this order, and the production mode they mean
MODES = [
    ("GluGluH", "ggH"), ("VBFH", "vbfH"), ("HZJ", "ZH"), ("ggZH", "ggZH"), ("GluGluZH", "ggZH"),
    ("HWplusJ", "HWplus"), ("HWminusJ", "HWminus"), ("ttH", "ttH"),
]
# The same for coupling-hypothesis samples, which also carry the decay tag
HYPOTHESES = [("VBF_H0", "vbfH"), ("WH_H0", "HW"), ("ZH_H0", "ZH"), ("ttH_H0", "ttH"), ("H0", "ggH")]
DECAY_TAG = "_ToWWTo2L2Nu"


def production_mode(name: Column) -> Column:
    out = F.when(name.contains("Mlarge"), "unknown")
    for part, mode in MODES:
        out = out.when(name.contains(part), mode)
    for part, mode in HYPOTHESES:
        out = out.when(name.contains(part) & name.contains(DECAY_TAG), mode)
    return out.otherwise("unknown")


def mass_of(name: Column) -> Column:
    """The number after ``_M``; 125 for hypothesis samples, 0 for the open-ended one."""
    digits = F.regexp_extract(name, r"_M([0-9]+)", 1)
    value = F.when(digits == "", F.lit(0.0)).otherwise(digits.cast("double"))
    return (F.when(name.contains("H0") & name.contains(DECAY_TAG), F.lit(125.0))
            .when(name.contains("Mlarge"), F.lit(0.0)).otherwise(value))


def histogram_name(sample: Column, variation: Column) -> Column:
    return F.when(variation == "nominal", F.concat(F.lit("histo_"), sample)).otherwise(
        F.concat_ws("_", F.lit("histo"), sample, variation))


def variation_in(name: Column, sample: Column) -> Column:
    """Variation part of a histogram's name, ``nominal`` if there is none."""
    rest = F.substr(name, F.length(sample) + 8)
    return F.when(rest == "", F.lit("nominal")).otherwise(rest)
