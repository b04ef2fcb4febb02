"""Small formulas: rates of repeated sampling, retention, distances, bins and hash splits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of ``k`` draws out of ``n`` with ``c`` successes succeeds."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)


def jeffreys(c: Column, n: Column) -> Column:
    """Posterior mean of a rate under the Jeffreys prior."""
    return (c + 0.5) / (n + 1.0)


def mixed_group(p: Column, g: int) -> Column:
    """Chance that a group of ``g`` draws has both outcomes."""
    return 1.0 - F.pow(p, F.lit(g)) - F.pow(1.0 - p, F.lit(g))


def retention(value: Column, reference: Column, chance: Column) -> Column:
    """Chance-corrected share of a reference that is kept; null where nothing lies above chance."""
    base = reference - chance
    return F.when(F.abs(base) >= 1e-12, (value - chance) / base)


def chance_level(n_choices: Column) -> Column:
    """One over the number of choices; 0 for free answers."""
    return F.when(n_choices > 0, 1.0 / n_choices).otherwise(F.lit(0.0))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes written as 16 hexadecimal digits."""

    def half(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 8), 16, 10).cast("long")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def chebyshev(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.abs(x1 - x2), F.abs(y1 - y2))


def hash_split(key: Column) -> Column:
    """Fixed 60/20/20 split of a key: the first 32 bits of its salted digest modulo 100."""
    bucket = F.conv(F.substring(F.sha2(F.concat(key, F.lit("|split-v1")), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 60, "training").when(bucket < 80, "development").otherwise("confirmatory")


def digest_seed(base: int, name: Column) -> Column:
    """Seed of a named stream: a base plus the first 32 bits of the name's digest, modulo 2^32."""
    return F.pmod(F.lit(base) + F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long"), F.lit(4294967296))


def opaque_id(salt: str, *parts: Column) -> Column:
    """Sixteen digits of a salted digest of parts joined by zero bytes."""
    joined = F.concat_ws("\0", F.lit(salt), *parts)
    return F.substring(F.sha2(joined, 256), 1, 16)


#: Bins of a pass rate, upper bound and name; rates from the last bound on are ``80_100``.
RATE_BINS = ((0.0, "missing"), (0.2, "00_20"), (0.4, "20_40"), (0.6, "40_60"), (0.8, "60_80"))
#: Topic families of questions and the words that tell them, first match first.
FAMILIES = (
    ("circle_arc_tangent", "circle|arc|chord|tangent|radius|diameter|sector|circumference"),
    ("triangle_trigonometry", "triangle|sine|sin|cosine|cos|tangent ratio|tan|hypotenuse|pythagorean"),
    ("quadrilateral_polygon", "parallelogram|quadrilateral|rectangle|rhombus|trapezoid|polygon"),
    ("coordinate_geometry", "coordinate|slope|midpoint|distance formula|ordered pair"),
    ("area_volume", "area|volume|surface area|perimeter"),
    ("angle_lines", "angle|parallel|perpendicular|supplementary|complementary|degree"),
    ("length_ratio_similarity", "length|similar|congruent|ratio|proportion|scale factor"),
)


def first_case(cases: list[tuple[Column, str]], otherwise: Column | str) -> Column:
    """Name of the first case that holds."""
    out = None
    for condition, name in cases:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def pass_rate_bin(p: Column) -> Column:
    """Half-open bin of a pass rate; negative, null and NaN rates are missing."""
    rate = F.coalesce(F.nanvl(p, F.lit(-1.0)), F.lit(-1.0))
    return first_case([(rate < high, name) for high, name in RATE_BINS], "80_100")


# Fixed values in the next four functions: bounds and names of buckets, bands and kinds.


def image_count_bucket(n: Column) -> Column:
    """Bucket of an image count: 1, 2_4, and 5_plus for all others, none included."""
    return first_case([(n == 1, "1"), (n.between(2, 4), "2_4")], "5_plus")


def difficulty_band(p: Column) -> Column:
    """Band of a success rate with its two ends apart."""
    return first_case([(p == 0, "p=0"), (p < 0.25, "0<p<0.25"), (p < 0.75, "0.25<=p<0.75"), (p < 1, "0.75<=p<1")], "p=1")


def sample_band(p: Column) -> Column:
    """Band of a sampling rate: 0, (0, .2), [.2, .8], (.8, 1), 1."""
    return first_case([(p == 0, "0"), (p < 0.2, "(0,.2)"), (p <= 0.8, "[.2,.8]"), (p < 1, "(.8,1)")], "1")


def answer_kind(answer: Column) -> Column:
    """Kind of a corpus answer, inside a box or not: multiple_choice, numeric, text_or_expression."""
    a = F.trim(answer)
    inner = F.when(a.rlike(r"(?s)\A\\boxed\{(.*)\}\z"), F.trim(F.regexp_replace(a, r"(?s)\A\\boxed\{(.*)\}\z", "$1"))).otherwise(a)
    number = r"\A[+-]?(?:\d+(?:\.\d+)?|\d+/\d+)(?:\^\\circ)?\z"
    return first_case([(inner.rlike(r"\A[A-Z]\z"), "multiple_choice"), (inner.rlike(number), "numeric")], "text_or_expression")


def geometry_answer_kind(answer: Column) -> Column:
    """Kind of a geometry answer: integer, decimal, fraction, expression_or_text, other."""
    v = F.trim(F.regexp_replace(answer, r"[,$°]|\^\\circ", ""))
    cases = [
        (v.rlike(r"\A[+-]?\d+\z"), "integer"),
        (v.rlike(r"\A[+-]?(?:\d+\.\d*|\.\d+)\z"), "decimal"),
        (v.rlike(r"\A[+-]?\d+\s*/\s*\d+\z") | v.contains("\\frac"), "fraction"),
        (v.rlike(r"[A-Za-z\\]"), "expression_or_text"),
    ]
    return first_case(cases, "other")


def derived_category(normalized: Column) -> Column:
    """First topic family whose words stand in a normalised question, else ``other``."""
    bare = (normalized.rlike(r"\Afind [abcxyz]\z"), "underspecified_visual")
    return first_case([bare] + [(normalized.rlike(rf"\b({words})\b"), name) for name, words in FAMILIES], "other")


def exact_count(share: str, rows: int) -> int:
    """Rows of an exact share such as ``1/3``; raises where the product is no whole number."""
    product = Fraction(share) * rows
    if product.denominator != 1:
        raise ValueError(f"{share} of {rows} rows is no whole number")
    return int(product)


def balanced_budget(total: int, parts: int) -> list[int]:
    """A total in parts that differ by at most one, the larger ones first."""
    base, extra = divmod(total, parts)
    return [base + (i < extra) for i in range(parts)]
