"""Answer extraction and tiered matching as column expressions, so that scoring stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.binding import let

#: Spellings of units, in order of priority, and the unit they stand for.
UNITS = (
    (r"square\s+centimeters?|cm\^?2", "cm2"),
    (r"square\s+meters?|m\^?2", "m2"),
    (r"square\s+inches?|in\^?2", "in2"),
    (r"square\s+feet|ft\^?2", "ft2"),
    (r"millimeters?|mm", "mm"),
    (r"centimeters?|cm", "cm"),
    (r"kilometers?|km", "km"),
    (r"meters?|metres?|m", "m"),
    (r"inches?|in", "in"),
    (r"feet|foot|ft", "ft"),
    (r"degrees?|deg", "degree"),
)
#: Layout of TeX that does not count, and what it becomes.
LAYOUT = (
    (r"\\(?:left|right)\s*", ""),
    (r"\^\s*\{?\s*\\circ\s*\}?", " degrees"),
    ("°", " degrees"),
    (r"\\(?:,|;|!|quad\b|qquad\b)", " "),
    (r"\\sqrt\s+([+-]?(?:\d+(?:\.\d*)?|\.\d+))\b", r"\\sqrt{$1}"),
    (r"\s+", " "),
)
TOLERANCE = 1e-4
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_NAMED = r"(?i)(?:final answer|answer)\s*[:：]"
_BOX = r"\\boxed\{"
_OPENER = r"\$|\\\(|\\\[|\\text\{"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _balanced(rest: Column) -> Column:
    """What stands before the brace that closes an open one, or null where none does.

    The text is cut behind every brace; depth and length are added up until the depth is 0.
    """

    def step(a: Column, part: Column) -> Column:
        depth = a["depth"] + F.when(part.endswith("{"), 1).otherwise(-1)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.length(part)).alias("size")))

    parts = F.regexp_extract_all(rest, F.lit(r"[^{}]*[{}]"), 0)
    end = F.aggregate(parts, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size")), step)
    return let(end, lambda e: F.when(e["depth"] == 0, F.substring(rest, F.lit(1), e["size"] - 1)))


def boxed_spans(text: Column) -> Column:
    """The contents of all boxes whose braces balance, at any depth, in the order in which the boxes open."""

    def spans(parts: Column) -> Column:
        rests = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "\\boxed{"))
        return F.array_compact(F.transform(rests, _balanced))

    return let(F.split(text, _BOX), lambda parts: F.when(F.size(parts) > 1, spans(parts)).otherwise(F.array().cast("array<string>")))


def extract_answer(response: Column) -> Column:
    """The answer of a response: ``span``, ``level`` (tag, boxed, line, lastline, fulltext), ``fallback``, ``valid``.

    The last answer tag wins, then the last boxed span, then the last line that names an answer, then the last line.
    A null response is treated as empty.
    """
    clean = F.regexp_replace(F.coalesce(response, F.lit("")), r"\A\s+|\s+\z", "")
    return let(clean, _extracted)


def _extracted(text: Column) -> Column:
    tags = F.regexp_extract_all(text, F.lit(r"(?is)<answer>\s*(.*?)\s*</answer>"), 1)
    boxes = boxed_spans(text)
    lines = F.filter(F.transform(F.split(text, _LINES), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")
    named = lambda ls: F.filter(ls, lambda x: x.rlike(_NAMED))

    def found(span: Column, level: str) -> Column:
        fallback = level in ("lastline", "fulltext")
        return F.struct(F.regexp_replace(span, r"\A\s+|\s+\z", "").alias("span"), F.lit(level).alias("level"), F.lit(fallback).alias("fallback"), F.lit(not fallback).alias("valid"))

    def by_line(ls: Column) -> Column:
        after = F.regexp_extract(F.try_element_at(named(ls), F.lit(-1)), _NAMED + r"\s*(.*)$", 1)
        return F.when(F.size(named(ls)) > 0, found(after, "line")).when(F.size(ls) > 0, found(F.try_element_at(ls, F.lit(-1)), "lastline")).otherwise(found(text, "fulltext"))

    def by_span(s: Column) -> Column:
        return F.when(F.size(s["tags"]) > 0, found(F.try_element_at(s["tags"], F.lit(-1)), "tag")).when(F.size(s["boxes"]) > 0, found(F.try_element_at(s["boxes"], F.lit(-1)), "boxed")).otherwise(let(lines, by_line))

    return let(F.struct(tags.alias("tags"), boxes.alias("boxes")), by_span)


def satisfies_contract(response: Column) -> Column:
    """Exactly one answer tag, closed, with something inside, at the very end of the response."""

    def check(text: Column) -> Column:
        one = (F.regexp_count(text, F.lit(r"(?i)<answer\b")) == 1) & (F.regexp_count(text, F.lit(r"(?i)</answer\s*>")) == 1)
        return one & text.rlike(r"(?is)\A.*<answer>\s*(\S.*?)\s*</answer>\z")

    return let(F.regexp_replace(F.coalesce(response, F.lit("")), r"\A\s+|\s+\z", ""), check)


_QUOTIENT = r"\A([+-]?\d+)\s*/\s*(\d+)\z"
_TEX_QUOTIENT = r"\A\\frac\{([^{}]+)\}\{([^{}]+)\}\z"


def _quotient(pair: Column) -> Column:
    return F.when(pair["low"] != 0, pair["top"] / pair["low"])


def plain_number(c: Column) -> Column:
    """A decimal number or a quotient of two whole numbers as a double, else null."""

    def parse(n: Column) -> Column:
        decimal = F.when(n.rlike(r"(?i)\A[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?\z"), n.try_cast("double"))
        pair = F.struct(F.regexp_extract(n, _QUOTIENT, 1).try_cast("double").alias("top"), F.regexp_extract(n, _QUOTIENT, 2).try_cast("double").alias("low"))
        return let(F.coalesce(decimal, let(pair, _quotient)), lambda v: F.when(~F.isnan(v) & (F.abs(v) < 1.7e308), v))

    return let(F.regexp_replace(F.trim(c), r"(?<=\d)_(?=\d)", ""), parse)


def numeric_value(c: Column) -> Column:
    """Value of a number, fraction, TeX fraction or percentage; commas and dollar signs do not count. Null for others."""

    def parse(s: Column) -> Column:
        n = s["n"]
        pair = F.struct(plain_number(F.regexp_extract(n, _TEX_QUOTIENT, 1)).alias("top"), plain_number(F.regexp_extract(n, _TEX_QUOTIENT, 2)).alias("low"))
        return let(F.when(n.rlike(_TEX_QUOTIENT), let(pair, _quotient)).otherwise(plain_number(n)), lambda v: F.when(s["percent"], v / 100.0).otherwise(v))

    whole = F.regexp_replace(F.lower(F.trim(c)), r"[,$]", "")
    return let(let(whole, lambda n: F.struct(F.regexp_replace(n, r"%\z", "").alias("n"), n.endswith("%").alias("percent"))), parse)


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal up to a relative and an absolute tolerance; false where either is null."""
    near = F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
    return F.coalesce(near, F.lit(False))


def _unwrapped(c: Column) -> Column:
    """Text without enclosing math delimiters and text commands.

    A step that changes more than outer white space takes away an opening delimiter or command, so as many steps as
    there are of them, and one more, reach the form that no step changes.
    """

    def once(t: Column) -> Column:
        t = _stripped(t)
        for pattern in (r"(?s)\A\$\s*(\S.*?)\s*\$\z", r"(?s)\A\\\(\s*(\S.*?)\s*\\\)\z", r"(?s)\A\\\[\s*(\S.*?)\s*\\\]\z"):
            t = F.regexp_replace(t, pattern, "$1")
        return F.regexp_replace(t, r"\\text\{([^{}]*)\}", "$1")

    return F.aggregate(F.sequence(F.lit(0), F.regexp_count(c, F.lit(_OPENER))), c, lambda t, _: once(t))


def normalize_presentation(c: Column) -> Column:
    """Text without differences of TeX layout: delimiters, spacing commands, degree signs, blanks around structure."""
    t = reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), LAYOUT, _unwrapped(F.coalesce(c, F.lit("None"))))
    return F.regexp_replace(F.trim(t), r"\s*(\\[A-Za-z]+|[{}^_])\s*", "$1")


def normalize_answer_text(c: Column) -> Column:
    """Normal form of an answer: presentation, case, blanks, outer quotes and closing punctuation do not count."""
    t = F.regexp_replace(F.trim(F.lower(normalize_presentation(c))), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(t, "^[\"'`]+|[\"'`]+$", ""), r"[.,;:!?]+$", "")


def split_unit(c: Column) -> Column:
    """``core`` and ``unit`` of an answer; the unit is null unless the core holds a digit, a fraction or a root."""

    def split(t: Column) -> Column:
        result = F.struct(t.alias("core"), F.lit(None).cast("string").alias("unit"))
        for pattern, unit in reversed(UNITS):
            core = F.trim(F.regexp_extract(t, r"(?is)\A(.+?)\s*(?:" + pattern + r")\z", 1))
            result = F.when(core.rlike(r"\d|\\(?:frac|sqrt)"), F.struct(core.alias("core"), F.lit(unit).alias("unit"))).otherwise(result)
        return result

    return let(c, split)


def _quantity(normalized: Column) -> Column:
    """Normalised answer with its core, unit and value."""
    return let(F.struct(normalized.alias("t"), split_unit(normalized).alias("s")), lambda x: F.struct(x["t"].alias("text"), x["s"]["core"].alias("core"), x["s"]["unit"].alias("unit"), numeric_value(x["s"]["core"]).alias("value"), numeric_value(x["t"]).alias("whole")))


def _equal(p: Column, g: Column) -> Column:
    """Whether two quantities are the same text or value; unequal units never are."""
    clash = F.coalesce(p["unit"] != g["unit"], F.lit(False))
    with_unit = p["unit"].isNotNull() | g["unit"].isNotNull()
    value = F.when(with_unit, close(p["value"], g["value"])).otherwise(close(p["whole"], g["whole"]))
    return (p["text"] == g["text"]) | (~clash & ((with_unit & (p["core"] == g["core"])) | value))


def answers_equal(prediction: Column, gold: Column) -> Column:
    """Whether two normalised answers are the same text or the same quantity."""
    return let(F.struct(_quantity(prediction).alias("p"), _quantity(gold).alias("g")), lambda x: _equal(x["p"], x["g"]))


def _tier(p: Column, inner: Column, g: Column) -> Column:
    """Tier of quantities: the span, what a response parser finds inside it, and the gold."""
    numbers = F.transform(F.regexp_extract_all(p["text"], F.lit(r"[-+]?\d+(?:\.\d+)?"), 0), lambda x: x.cast("double"))
    named = F.exists(numbers, lambda x: close(x, g["whole"]))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(g["text"], F.lit("\\E"), F.lit("")), F.lit(r"\E(?!\w)"))
    within = F.when(g["text"].rlike(r"(?U)\w"), F.rlike(p["text"], quoted)).otherwise(F.contains(p["text"], g["text"]))
    same = (p["text"] == g["text"]) | _equal(inner, g) | close(p["whole"], g["whole"])
    return F.when((p["text"] == "") | (g["text"] == ""), 0).when(same, 2).when(g["whole"].isNotNull(), F.when(named, 1).otherwise(0)).when(within, 1).otherwise(0)


def match_tier(span: Column, gold: Column) -> Column:
    """2 for the same answer, 1 if the answer is contained, 0 otherwise.

    A numeric gold is contained if some signed number of the span equals it; a word gold must stand between non-word
    characters; a gold of symbols may stand anywhere. Empty texts never match.
    """
    parts = F.struct(
        _quantity(normalize_answer_text(span)).alias("p"),
        _quantity(normalize_answer_text(extract_answer(span)["span"])).alias("i"),
        _quantity(normalize_answer_text(gold)).alias("g"),
    )
    return let(parts, lambda x: _tier(x["p"], x["i"], x["g"]))


def golds_equivalent(a: Column, b: Column) -> Column:
    """Whether the two golds of a pair are one answer."""
    both = F.struct(normalize_answer_text(a).alias("x"), normalize_answer_text(b).alias("y"))
    return let(both, lambda g: (g["x"] != "") & (g["y"] != "") & ((g["x"] == g["y"]) | close(numeric_value(g["x"]), numeric_value(g["y"]))))


def member_score(prediction: Column, gold: Column, other: Column, full_text: bool = False) -> Column:
    """Score of one member of a pair.

    The own gold must match at a higher tier than the other one; pairs with one shared gold need a match only. Strict
    credit also asks for the response contract. ``full_text`` adds whether the response as a whole matches both golds.
    """

    def score(x: Column) -> Column:
        right = F.when(x["same"], x["own"] > 0).otherwise((x["own"] > x["rival"]) & (x["own"] > 0))
        return F.struct(
            x["span"].alias("span"),
            x["valid"].alias("format_valid"),
            x["extracted"].alias("extractor_valid"),
            (~x["extracted"]).alias("fallback"),
            x["own"].alias("tier"),
            x["rival"].alias("other_tier"),
            (~x["same"] & (x["own"] > 0) & (x["own"] == x["rival"])).alias("ambiguous"),
            right.alias("correct"),
            (right & x["valid"]).alias("strict"),
            *([x["both"].alias("mentions_both")] if full_text else []),
        )

    def parts(found: Column) -> Column:
        span = found["span"]
        both = [((match_tier(prediction, gold) > 0) & (match_tier(prediction, other) > 0)).alias("both")] if full_text else []
        return F.struct(span.alias("span"), found["valid"].alias("extracted"), match_tier(span, gold).alias("own"), match_tier(span, other).alias("rival"), golds_equivalent(gold, other).alias("same"), satisfies_contract(prediction).alias("valid"), *both)

    return let(let(extract_answer(prediction), parts), score)


def pair_score(prediction_a: Column, prediction_b: Column, gold_a: Column, gold_b: Column, full_text: bool = False) -> Column:
    """Score of a pair: both members, both strict, and collapse (one answer given to two different golds)."""

    def score(x: Column) -> Column:
        a, b = x["a"], x["b"]
        one = normalize_answer_text(a["span"]) == normalize_answer_text(b["span"])
        return F.struct(
            a["correct"].alias("correct_a"),
            b["correct"].alias("correct_b"),
            (a["correct"] & b["correct"]).alias("pair_correct"),
            (a["strict"] & b["strict"]).alias("strict_pair_correct"),
            a["strict"].alias("strict_a"),
            b["strict"].alias("strict_b"),
            (one & (normalize_answer_text(gold_a) != normalize_answer_text(gold_b))).alias("collapsed"),
            a["format_valid"].alias("format_a"),
            b["format_valid"].alias("format_b"),
            a["extractor_valid"].alias("extractor_a"),
            b["extractor_valid"].alias("extractor_b"),
            a["fallback"].alias("fallback_a"),
            b["fallback"].alias("fallback_b"),
            (a["ambiguous"] | b["ambiguous"]).alias("ambiguous"),
            *([(a["mentions_both"] | b["mentions_both"]).alias("mentions_both")] if full_text else []),
        )

    return let(F.struct(member_score(prediction_a, gold_a, gold_b, full_text).alias("a"), member_score(prediction_b, gold_b, gold_a, full_text).alias("b")), score)


def choice_labels(span: Column, labels: Column) -> Column:
    """Labels a span names outright: the whole span, a leading option or marked label, else all labels standing alone."""

    def named(text: Column) -> Column:
        lead = F.upper(F.regexp_extract(text, r"(?i)^(?:option|answer)\s*[\[(]?([A-Z])[\])]?\s*(?:[.:,-]|$)", 1))
        marked = F.regexp_extract(text, r"^[\[(]?([A-Z])[\]).:,-]", 1)
        alone = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])([A-Z])(?![A-Za-z0-9])"), 1)))
        return (
            F.when(F.array_contains(labels, F.upper(text)), F.array(F.upper(text)))
            .when(F.array_contains(labels, lead), F.array(lead))
            .when(F.array_contains(labels, marked), F.array(marked))
            .otherwise(F.filter(alone, lambda x: F.array_contains(labels, x)))
        )

    return let(F.trim(span), named)


def choice_score(prediction: Column, gold: Column, labels: Column, options: Column) -> Column:
    """Score of a multiple-choice answer: named labels win, then the option text with the best tier.

    ``gold``: array of labels, which must be met as a set. ``options``: texts in the order of ``labels``; texts of one
    character never match. ``error`` is set where a gold label is not among the options.
    """

    def parts(span: Column) -> Column:
        tiers = F.zip_with(labels, options, lambda n, o: F.struct(F.when(F.length(F.trim(o)) > 1, match_tier(span, o)).otherwise(0).alias("t"), n.alias("l")))
        best = let(tiers, lambda ts: let(F.array_max(F.transform(ts, lambda x: x["t"])), lambda m: F.array_sort(F.transform(F.filter(ts, lambda x: (x["t"] == m) & (x["t"] > 0)), lambda x: x["l"]))))
        want = F.array_sort(F.array_distinct(F.transform(gold, lambda x: F.upper(F.trim(x)))))
        return F.struct(choice_labels(span, labels).alias("named"), best.alias("best"), want.alias("want"), satisfies_contract(prediction).alias("valid"))

    def score(x: Column) -> Column:
        winners = F.array_sort(F.when(F.size(x["named"]) > 0, x["named"]).otherwise(x["best"]))
        bad = (F.size(x["want"]) == 0) | (F.size(F.array_except(x["want"], labels)) > 0)
        right = ~bad & (winners == x["want"])
        return F.struct(
            winners.alias("winners"),
            ((F.size(winners) > 1) & ~((F.size(x["named"]) > 0) & (winners == x["want"]))).alias("ambiguous"),
            right.alias("correct"),
            (right & x["valid"]).alias("strict"),
            F.when(bad, F.lit("gold_label_missing_from_options")).alias("error"),
        )

    return let(let(extract_answer(prediction)["span"], parts), score)


def open_score(prediction: Column, gold: Column) -> Column:
    """Score of an open answer: the tier of its span against the gold. Open answers are never ambiguous."""

    def score(x: Column) -> Column:
        return F.struct(
            x["span"].alias("span"),
            x["tier"].alias("tier"),
            (x["tier"] > 0).alias("correct"),
            ((x["tier"] > 0) & x["valid"]).alias("strict"),
            x["valid"].alias("format_valid"),
            x["extracted"].alias("extractor_valid"),
            (~x["extracted"]).alias("fallback"),
            F.lit(False).alias("ambiguous"),
        )

    return let(let(extract_answer(prediction), lambda e: F.struct(e["span"].alias("span"), e["valid"].alias("extracted"), match_tier(e["span"], gold).alias("tier"), satisfies_contract(prediction).alias("valid"))), score)


#: Codes of a disagreement between two graders.
REASONS = ("none", "canonical_correct_mathruler_incorrect", "mathruler_correct_canonical_incorrect", "mathruler_error_canonical_incorrect", "mathruler_error_canonical_correct")


def disagreement(graded: Column, failed: Column, matched: Column) -> Column:
    """Code (the place in ``REASONS``) of a disagreement between a symbolic grader and the matcher.

    ``graded``: the grader's verdict, ``failed``: whether it raised, ``matched``: the matcher's verdict. A grader that
    failed has no verdict. Nulls count as false.
    """
    g, f, m = (F.coalesce(c, F.lit(False)) for c in (graded, failed, matched))
    return F.when(f, F.when(m, 4).otherwise(3)).when(m & ~g, 1).when(g & ~m, 2).otherwise(0)


def reward(accuracy: Column, format_valid: Column, weight: float = 0.1) -> Column:
    """Weighted reward of accuracy and format."""
    return accuracy.cast("double") * (1 - weight) + format_valid.cast("double") * weight
