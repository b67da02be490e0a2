"""Experiment metadata parsed from an image file path.

All work is in built-in expressions (regexp_extract, translate, rint), so it
stays inside whole-stage codegen and is stream-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import DOSE, q

# The path pattern of the image-analysis export, with groups
# Date, Cell, Drug, Concentration and the optional Position (named groups
# dropped; the group order is the same).
PATH_PATTERN = r"[\/\\]([\d]+)_.+_(ISO[\d]+)_([A-Za-z0-9]+)_([\d\w_-]+uM)(?:.+Position_([\d]))?"
GROUPS = {"Date": 1, "Cell": 2, "Drug": 3, "Concentration": 4, "Position": 5}
CONTROL = "Control"
DEFAULT_REPLICATE = "1"


def extract(path: Column, group: str) -> Column:
    """one regex group; a non-participating group ('' in Spark) -> null."""
    return F.nullif(F.regexp_extract(path, PATH_PATTERN, GROUPS[group]), F.lit(""))


def dose_from_text(text: Column, strict: bool = True) -> Column:
    """F3-F5: '0_041uM' -> 0.041, rounded half-even to 3 decimals.

    strict=True raises on unparsable text (ANSI cast); False yields null.
    """
    cleaned = F.replace(F.translate(text, "_-", ".."), F.lit("uM"), F.lit(""))
    number = cleaned.cast("double") if strict else cleaned.try_cast("double")
    return F.rint(number * 1000.0) / 1000.0


def control_label(drug: Column, dose: Column) -> Column:
    """Drug where the dose is not 0, else 'Control' (null dose keeps drug)."""
    return F.when(dose == 0, F.lit(CONTROL)).otherwise(drug)


_SEP = "\u0001"


def path_parts(path: Column) -> Column:
    """F1 in one regex evaluation: array(Date, Cell, Drug, Concentration,
    Position) of the first match (re.search semantics), or a 1-element
    array (the path itself) when the pattern does not match."""
    whole = "^.*?(?:" + PATH_PATTERN + ").*$"
    repl = _SEP.join(f"${i}" for i in range(1, 6))
    return F.split(F.regexp_replace(path, whole, repl), _SEP)


def add_path_metadata(df: DataFrame, path_col: str = "Metadata_FileLocation",
                      zero_is_control: bool = True, strict: bool = True) -> DataFrame:
    """Add Date, Drug, Cell, Replicate, `Conc /uM` from the path column.

    The five groups come from one regex evaluation, emitted through a
    generator (``inline``) so that later row filters on the keys (P11, P12)
    are not pushed beneath it and re-evaluate the regex once per key.
    """
    parts = path_parts(F.col(q(path_col)))
    df = df.select("*", F.inline(F.array(F.struct(parts.alias("_parts")))))
    ok = F.size("_parts") == 5

    def grp(i):
        return F.when(ok, F.nullif(F.col("_parts")[i], F.lit("")))

    # A generator again, so that filters and labels use the parsed values instead of parsing the groups anew.
    parsed = F.struct(grp(0).alias("Date"), grp(1).alias("Cell"),
                      F.coalesce(grp(4), F.lit(DEFAULT_REPLICATE)).alias("Replicate"),
                      dose_from_text(grp(3), strict).alias(DOSE), grp(2).alias("_drug"))
    names = ["Date", "Cell", "Replicate", DOSE]
    out = df.drop(*names, "Drug").select("*", F.inline(F.array(parsed)))
    drug = control_label(F.col("_drug"), F.col(q(DOSE))) if zero_is_control else F.col("_drug")
    kept = [c for c in df.columns if c not in (*names, "Drug", "_parts")]
    return out.select(*[q(c) for c in kept + names], drug.alias("Drug"))
