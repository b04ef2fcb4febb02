"""Text normal forms, shingles and set overlaps as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.binding import let


def normalize_text(c: Column) -> Column:
    """Contamination normal form: NFKC, full case folding, image markers and runs of other than word characters as one blank.

    Texts of ASCII characters alone are folded by the engine's own functions; only the others go through Python, in
    Arrow batches. A null text stays null.
    """

    def fold(value: str) -> str:
        lowered = unicodedata.normalize("NFKC", value).casefold().replace("<image>", " ")
        return re.sub(r"\W+", " ", lowered).strip(" ")

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(fold, na_action="ignore")

    wide = c.rlike(r"[^\x00-\x7F]")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.when(~wide, c)), "<image>", " "), r"[^a-z0-9_]+", " "))
    return F.coalesce(folded(F.when(wide, c)), plain)


def tokens(normalized: Column) -> Column:
    """Words of a normalised text; empty for an empty text."""
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def word_ngrams(words: Column, n: int = 5) -> Column:
    """Distinct word n-grams; empty for fewer than ``n`` words."""

    def shingles(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))

    return let(words, shingles)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Share of common elements; two empty sets give ``empty`` (1 between texts, 0 between result sets)."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("union"))
    return let(sizes, lambda x: F.when(x["union"] == 0, F.lit(empty)).otherwise(x["common"] / x["union"]))


def has_forbidden(c: Column, forbidden: list[str]) -> Column:
    """Whether one of the words stands in the text between non-alphanumeric characters."""
    return F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*[F.lit(x) for x in forbidden]))


def is_opaque_id(c: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return c.rlike(r"\A[0-9a-f]{16}\z")


def is_opaque_path(c: Column) -> Column:
    """An opaque id with the extension png."""
    return c.rlike(r"\A[0-9a-f]{16}\.png\z")


def repair_markers(problem: Column, n_images: Column, joint: str = " ") -> Column:
    """Problem text with as many image markers as images: markers are put in front where there are none.

    Any other mismatch gives null; callers decide whether that is an error.
    """
    found = F.regexp_count(problem, F.lit("<image>"))
    lead = F.repeat(F.lit("<image>"), n_images)
    return F.when(found == n_images, problem).when((found == 0) & (n_images > 0), F.concat(lead, F.lit(joint), problem))


def option_lines(options: Column) -> Column:
    """Lines ``A. text`` of the non-missing options of an array, labelled in their original places."""
    labelled = F.transform(options, lambda x, i: F.when(x.isNotNull() & (F.trim(x) != ""), F.concat(F.chr((i + 65).cast("long")), F.lit(". "), x)))
    return F.array_join(F.array_compact(labelled), "\n")


def python_list(c: Column) -> Column:
    """Text elements of a list written as a Python or JSON literal of quoted strings; null where it is none."""
    body = F.regexp_extract_all(c, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), 0)
    inner = F.transform(body, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    return F.when(c.rlike(r"(?s)\A\s*\[.*\]\s*\z"), inner)
