"""Core queries over the tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import answers, measures, text
from sievewright.functions.keys import SQL_ITEM_KEY, item_key
from sievewright.operators import compare, contamination, corpus, guards, ordering, ranking, resampling, streams, validate
from sievewright.queries.base import RESPONSES, ROLLOUTS, SCENES, TRIALS, responses, rollouts, trials
from sievewright.session import table
from sievewright.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}



def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that NFKC and case folding change into one other character, and those that they change into several."""
    one, several = {}, []
    for at in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        c = chr(at)
        f = unicodedata.normalize("NFKC", c).casefold()
        if len(f) == 1 and f != c:
            one[c] = f
        elif len(f) > 1 and at in (0xDF, 0x130, 0x149, 0x1F0, *range(0xA8, 0xC0), *range(0x2070, 0x2190), *range(0xFB00, 0xFB07)):
            several.append((c, f))
    return "".join(one), "".join(one.values()), several


def _norm() -> str:
    """The contamination normal form in SQL; characters that fold into several are those of Latin texts."""
    one, into, several = _folds()
    literal = lambda s: "'" + s.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"
    t = "nfc_normalize({})"
    for c, f in several:
        t = f"replace({t}, {literal(c)}, {literal(f)})"
    t = f"nfc_normalize(lower(translate({t}, {literal(one)}, {literal(into)})))"
    return f"trim(regexp_replace(replace({t}, '<image>', ' '), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+', ' ', 'g'))"


_NORM = _norm()


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- filters, positions, unions


@query("f01_select", "select doc_id, lang, source from documents where source is not distinct from 'run_logs' and (lang in ('en', 'de') or lang is null) and revision >= 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return guards.select(table(spark, d, "documents"), source="run_logs", lang=["en", "de", None], revision=lambda c: c >= 1).select("doc_id", "lang", "source")


@query("f02_evaluation", f"with {TRIALS} select item_id, max(pair_correct::int)::boolean as pair_correct from trials where run = 'base' and seed = 0 group by item_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    one = guards.exactly_one(guards.select(trials(spark, d), run="base", seed=0), ["run", "seed"])
    return compare.last_wins(one.select("item_id", "ordinal", "pair_correct"), ["item_id"]).select("item_id", "pair_correct")


@query("f03_shard", "select ordinal, arm from mixture_profiles where ordinal % 4 = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return guards.shard(table(spark, d, "mixture_profiles"), 4, 1).select("ordinal", "arm")


@query("f04_learnable", "select ordinal, base_accuracy from mixture_profiles where base_accuracy > 0 and base_accuracy < 1 and not isnan(base_accuracy)")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = F.nanvl("base_accuracy", F.lit(None).cast("double"))
    return table(spark, d, "mixture_profiles").where((b > 0) & (b < 1)).select("ordinal", "base_accuracy")


@query("f05_roles", f"select cell, layer, count(*) as n from {SCENES} where role in ('target_stable', 'invariance') group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    return guards.select(table(spark, d, SCENES), role=["target_stable", "invariance"]).groupBy("cell", "layer").agg(F.count("*").alias("n"))


@query("f06_exclusions", "select distinct dataset, item_id from decontamination where item_id is not null and item_id not in (select item_id from decontamination where split = 'train' and item_id is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decontamination").where("item_id is not null")
    return rows.join(rows.where("split = 'train'").select("item_id").distinct(), "item_id", "left_anti").select("dataset", "item_id").distinct()




@query("o02_natural_order", "select item_id, row_number() over (order by (case when regexp_full_match(item_id, '\\d+') then 0 else 1 end), try_cast(item_id as hugeint), item_id) as place from (select distinct item_id from decontamination where item_id is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "decontamination").where("item_id is not null").select("item_id").distinct()
    return ordering.numbered(ids, *ranking.natural_order(F.col("item_id")), name="place").withColumn("place", F.col("place") + 1)


@query("o04_examples", "select source, list(doc_id order by doc_id)[1:5] as examples from documents where source is not null group by source")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, 5).alias("examples"))


@query("u01_union", "select 'scene' as kind, split as part, count(*) as n from scene_training_n8_l3_first group by all union all select 'record', split, count(*) from decontamination group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, SCENES).select(F.lit("scene").alias("kind"), F.col("split").alias("part"))
    b = table(spark, d, "decontamination").select(F.lit("record").alias("kind"), F.col("split").alias("part"))
    return a.unionByName(b).groupBy("kind", "part").agg(F.count("*").alias("n"))


@query("u02_sets", "select 'both' as op, count(*) as n from (select user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'purchase') union all select 'only_click', count(*) from (select user_id from events where event_type = 'click' except select user_id from events where event_type = 'purchase') union all select 'either', count(distinct user_id) from events where event_type in ('click', 'purchase')")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a, b = e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id")
    parts = {"both": a.intersect(b), "only_click": a.subtract(b), "either": a.union(b).distinct()}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_LAYER_KEYS = f"(select distinct mother_item_id, cell from {SCENES} where layer = '{{}}' and mother_item_id is not null and cell is not null)"


@query("u03_coverage", f"with a as {_LAYER_KEYS.format('l3')}, b as {_LAYER_KEYS.format('probe')} select coalesce(a.mother_item_id, b.mother_item_id) as mother_item_id, coalesce(a.cell, b.cell) as cell, case when b.cell is null then 'left_only' else 'right_only' end as side from a full join b using (mother_item_id, cell) where a.cell is null or b.cell is null")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Items of one layer that the other lacks."""
    s = table(spark, d, SCENES).where("mother_item_id is not null and cell is not null")
    return guards.coverage_gaps(s.where("layer = 'l3'"), s.where("layer = 'probe'"), ["mother_item_id", "cell"])


# ---- sources over the tables


@query("src08_corpus", "select qid, max(coalesce(pass_rate_7b_base, -1)) as pass_rate_7b_base, max(len(coalesce(image_paths, []))) as n_images from corpus_rows group by qid")
def _(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "corpus_rows").groupBy("qid").agg(F.first("question").alias("question"), F.first("answer").alias("answer"), F.max("image_paths").alias("image_paths"), F.max("pass_rate_7b_base").alias("pass_rate_7b_base"))
    return readers.corpus_rows(one).select("qid", "pass_rate_7b_base", F.size("image_paths").alias("n_images"))


@query("src17_content_dedupe", "select sha256(text) as digest, min(doc_id)::varchar as first_path, list(doc_id::varchar order by doc_id)[2:] as duplicate_paths from (select doc_id, text from documents where text is not null) group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("text", F.col("doc_id").alias("path"))
    out = corpus.content_dedupe(rows, "text", "path")
    return out.select("digest", F.col("first_path").cast("string").alias("first_path"), F.transform("duplicate_paths", lambda x: x.cast("string")).alias("duplicate_paths"))


@query("src18_records", "select 'mixviz40:train:' || qid || ':image' || coalesce(i - 1, 0) as record_id, (p is not null and not p like '%no\\_image.png' escape '\\') as image_applicable from (select distinct qid, p, i from (select qid, unnest(case when len(image_paths) > 0 then image_paths else [null] end) as p, generate_subscripts(case when len(image_paths) > 0 then image_paths else [null] end, 1) as i from corpus_rows))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return readers.image_records(table(spark, d, "corpus_rows"), "mixviz40", "train").select("record_id", "image_applicable").distinct()


# ---- text


@query("x01_normalize", "select doc_id, md5(" + _NORM.format("text") + ") as digest from documents where text is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))"
_QWORDS = "list_filter(string_split(" + _NORM.format("question") + ", ' '), lambda x: x <> '')"


@query("x02_shingles", f"with k as (select record_id, {_QWORDS} as w from decontamination where question is not null) select record_id, len({_SHINGLES}) as n from (select distinct * from k)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decontamination").where("question is not null")
    return rows.select("record_id", F.size(text.word_ngrams(text.tokens(text.normalize_text(F.col("question"))))).alias("n"), text.normalize_text(F.col("question")).alias("q")).distinct().select("record_id", "n")


_JWORDS = "list_distinct(" + _QWORDS + ")"
_JBOTH = "list_distinct(list_filter(string_split(" + _NORM.format("question || ' ' || answer") + ", ' '), lambda x: x <> ''))"


@query("x03_x04_jaccard", f"select record_id, case when len({_JBOTH}) = 0 then 1.0 else len(list_intersect({_JWORDS}, {_JBOTH})) / len({_JBOTH}) end as texts, case when len({_JBOTH}) = 0 then 0.0 else len(list_intersect({_JWORDS}, {_JBOTH})) / len({_JBOTH}) end as results from (select distinct record_id, question, answer from decontamination where question is not null and answer is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Words of a question against the words of the question with its answer."""
    rows = table(spark, d, "decontamination").where("question is not null and answer is not null").select("record_id", "question", "answer").distinct()
    words = lambda c: F.array_distinct(text.tokens(text.normalize_text(c)))
    both = rows.select("record_id", words(F.col("question")).alias("a"), words(F.concat_ws(" ", "question", "answer")).alias("b"))
    return both.select("record_id", text.jaccard(F.col("a"), F.col("b")).cast("double").alias("texts"), text.jaccard(F.col("a"), F.col("b"), 0.0).cast("double").alias("results"))


@query("x05_extract", f"with {RESPONSES} select record_id, case floor(('0x' || substr(md5('dress|' || record_id), 1, 13))::bigint::double / 4503599627370496.0 * 6)::int when 4 then trim(gold) || '.' when 5 then '' else trim(gold) end as span from responses")
def _(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("record_id", answers.extract_answer(F.col("prediction"))["span"].alias("span"))


@query("x06_numbers", "select record_id, case when regexp_full_match(a, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') then a::double end as value from (select distinct record_id, replace(trim(answer), ',', '') as a from decontamination where answer is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decontamination").where("answer is not null").select("record_id", "answer").distinct()
    return rows.select("record_id", answers.numeric_value(F.col("answer")).alias("value"), F.regexp_replace(F.trim("answer"), ",", "").alias("a")).distinct().select("record_id", "value")


@query("x08_answer_text", f"select record_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(answer)), '\\s+', ' ', 'g'), '^[\"''`]+|[\"''`]+$', '', 'g'), '[.,;:!?]+$', '') as answer_key from (select distinct record_id, answer from decontamination where answer is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decontamination").where("answer is not null").select("record_id", "answer").distinct()
    return rows.select("record_id", answers.normalize_answer_text(F.col("answer")).alias("answer_key"))


_WHOLE = f"(select ordinal, answer_a as a from {SCENES} where regexp_full_match(answer_a, '-?[0-9]+'))"


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Scene rows whose first answer is a whole number: ordinal, a."""
    return table(spark, d, SCENES).where(F.col("answer_a").rlike(r"\A-?[0-9]+\z")).select("ordinal", F.col("answer_a").alias("a"))


def _form(forms: list[str]) -> F.Column:
    """The answer in one of several forms, by ordinal; ``@`` stands for the answer."""
    return F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("ordinal") % len(forms) + 1).cast("int")), F.lit("@"), F.col("a"))


_UNIT_FORMS = ["@ cm", "@ centimeters", "@ square meters", "@ in", "@ degrees", "@", "@ kilometers", "@ ft^2"]


@query("x09_units", f"select ordinal, a as core, ['cm', 'cm', 'm2', 'in', 'degree', null, 'km', 'ft2'][ordinal % 8 + 1] as unit from {_WHOLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).select("ordinal", answers.split_unit(_form(_UNIT_FORMS)).alias("s")).select("ordinal", "s.core", "s.unit")


_RELATIONS = ["eq", "le", "lt", "ge", "gt", "zero", "undefined"]


@query(
    "f07_outcome",
    f"with s as (select ordinal, a::double / 8 as v, case when ordinal % 5 = 0 then null else (a::double + ordinal % 3 - 1) / 8 end as p, ['eq', 'le', 'lt', 'ge', 'gt', 'zero', 'undefined'][ordinal % 7 + 1] as r from {_WHOLE} union all select -ordinal, null, null, ['eq', 'undefined'][ordinal % 2 + 1] from {_WHOLE}) select ordinal, case when p is null and r <> 'undefined' then null when r = 'undefined' and v is null then 'matched' when v is null then 'mismatch' when (r = 'eq' and abs(v - p) <= 5e-4) or (r = 'le' and v <= p + 1e-9) or (r = 'lt' and v < p) or (r = 'ge' and v >= p - 1e-9) or (r = 'gt' and v > p) or (r = 'zero' and v = 0) then 'matched' else 'mismatch' end as outcome from s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Values made of the whole answers against printed ones beside them, by every relation, with either missing."""
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("ordinal") % n + 1).cast("int"))
    a = F.col("a").cast("double")
    told = _whole(spark, d).select("ordinal", (a / 8).alias("v"), F.when(F.col("ordinal") % 5 != 0, (a + F.col("ordinal") % 3 - 1) / 8).alias("p"), pick(_RELATIONS, 7).alias("r"))
    none = F.lit(None).cast("double")
    untold = _whole(spark, d).select((-F.col("ordinal")).alias("ordinal"), none.alias("v"), none.alias("p"), pick(["eq", "undefined"], 2).alias("r"))
    return told.unionByName(untold).select("ordinal", compare.outcome(F.col("v"), F.col("p"), F.col("r"), none).alias("outcome"))


@query("x11_tiers", f"select ordinal, [2, 2, 1, 0, 2, 0, 2, 1][ordinal % 8 + 1] as tier from {_WHOLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Answers as they are, close by, inside a phrase, with another digit, in math mode, missing, quoted, and quoted before a stop (the quote then stays)."""
    span = _form(["@", "@.00004", "x = @ m", "@7", "$@$", "", "'@'", "'@'."])
    return _whole(spark, d).select("ordinal", answers.match_tier(span, F.col("a")).alias("tier"))


@query("x13_pair_score", f"with {RESPONSES}, said as (select record_id, floor(('0x' || substr(md5('dress|' || record_id), 1, 13))::bigint::double / 4503599627370496.0 * 6)::int as u from responses where trim(gold) <> '') select record_id, u < 5 as correct, u = 0 as strict from said")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = answers.open_score(F.col("prediction"), F.col("gold"))
    return responses(spark, d).where(F.trim("gold") != "").select("record_id", s.alias("s")).select("record_id", "s.correct", "s.strict")


@query("x14_contract", f"with {RESPONSES} select record_id, regexp_full_match(trim(prediction), '.*<answer>\\s*\\S.*</answer>', 'si') and len(regexp_extract_all(prediction, '(?i)<answer\\b')) = 1 and len(regexp_extract_all(prediction, '(?i)</answer\\s*>')) = 1 as valid from responses")
def _(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("record_id", answers.satisfies_contract(F.col("prediction")).alias("valid"))


@query("x16_choices", f"select ordinal, [true, true, false, false, true, false][ordinal % 6 + 1] as correct, [true, false, false, false, false, false][ordinal % 6 + 1] as strict from {_WHOLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Labels, marked labels, two labels and option texts; the right option is the answer of the row."""
    labels, options = F.array(*[F.lit(x) for x in "ABC"]), F.array(F.lit("green"), F.concat(F.lit("value "), F.col("a")), F.lit("blue"))
    score = answers.choice_score(_form(["<answer>B</answer>", "Option (B).", "(A)", "A or B", "value @", "blue"]), F.array(F.lit("B")), labels, options)
    return _whole(spark, d).select("ordinal", score.alias("s")).select("ordinal", "s.correct", "s.strict")


@query(
    "x18_answer_kinds",
    "select kind, count(*) as n from (select case when regexp_full_match(trim(answer), '[A-Z]') then 'multiple_choice' when regexp_full_match(trim(answer), '[+-]?(\\d+(\\.\\d+)?|\\d+/\\d+)') then 'numeric' else 'text_or_expression' end as kind from decontamination where answer is not null) group by kind",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decontamination").where("answer is not null").groupBy(measures.answer_kind(F.col("answer")).alias("kind")).agg(F.count("*").alias("n"))


_FAMILIES = " ".join(f"when regexp_matches(q, '\\b({w})\\b') then '{n}'" for n, w in measures.FAMILIES)


@query("x19_categories", f"select category, count(*) as n from (select case when regexp_full_match(q, 'find [abcxyz]') then 'underspecified_visual' {_FAMILIES} else 'other' end as category from (select {_NORM.format('question')} as q from decontamination where question is not null)) group by category")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = text.normalize_text(F.col("question"))
    return table(spark, d, "decontamination").where("question is not null").groupBy(measures.derived_category(q).alias("category")).agg(F.count("*").alias("n"))


@query(
    "x20_bins",
    "select rate, images, count(*) as n from (select case when p < 0 then 'missing' when p < 0.2 then '00_20' when p < 0.4 then '20_40' when p < 0.6 then '40_60' when p < 0.8 then '60_80' else '80_100' end as rate, case when k = 1 then '1' when k between 2 and 4 then '2_4' else '5_plus' end as images from (select coalesce(pass_rate_7b_base, -1) as p, len(image_paths) as k from corpus_rows)) group by all",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_rows").groupBy(measures.pass_rate_bin(F.col("pass_rate_7b_base")).alias("rate"), measures.image_count_bucket(F.size("image_paths")).alias("images")).agg(F.count("*").alias("n"))


@query("x22_levenshtein", "select a.name as left_name, b.name as right_name, levenshtein(a.name, b.name) as distance from (select distinct source as name from documents where source is not null) a join (select distinct source as name from documents where source is not null) b on a.name < b.name")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the distinct spellings of sources, which are few however many documents there are."""
    names = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("left_name")).distinct()
    pairs = names.join(names.withColumnRenamed("left_name", "right_name"), F.col("left_name") < F.col("right_name"))
    return pairs.withColumn("distance", F.levenshtein("left_name", "right_name"))


@query("x23_forbidden", f"select ordinal, len(list_intersect(string_split_regex(lower(image_a_path), '[^a-z0-9]+'), ['side', 'answer', 'template', 'left', 'right'])) > 0 as telling from {SCENES} where image_a_path is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SCENES).where("image_a_path is not null").select("ordinal", text.has_forbidden(F.col("image_a_path"), validate.FORBIDDEN).alias("telling"))


@query("proj08_markers", "select ordinal, case when m = k then problem when m = 0 and k > 0 then repeat('<image>', k) || ' ' || problem end as problem from (select ordinal, problem, len(images) as k, (length(problem) - length(replace(problem, '<image>', ''))) // 7 as m from mixture_profiles where problem is not null and images is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mixture_profiles").where("problem is not null and images is not null")
    return rows.select("ordinal", text.repair_markers(F.col("problem"), F.size("images")).alias("problem"))


# ---- contamination

_RECORDS = f"one as (from decontamination where record_id is not null qualify row_number() over (partition by record_id order by delivered_at desc nulls last, recorded_at desc nulls last) = 1), keyed as (select *, nullif({_NORM.format('question')}, '') as q, {_NORM.format("coalesce(answer, '')")} as a, {_QWORDS} as w from one), train as (from keyed where split = 'train'), held as (from keyed where split <> 'train')"
_HALF = "('0x' || substr({}, {}, 8))::bigint"
_HAM = "(" + " + ".join(f"bit_count(xor({_HALF.format('t.{0}', at)}, {_HALF.format('h.{0}', at)}))" for at in (1, 9)) + ")"
_EXACT = "select t.record_id as train_record_id, h.record_id as eval_record_id, 'image_sha256_exact' as signal, 2 as action from train t join held h using (image_sha256) where t.image_applicable and h.image_applicable union all select t.record_id, h.record_id, 'question_answer_exact', case when len(h.w) >= 5 then 2 else 1 end from train t join held h on t.q = h.q and t.a = h.a union all select t.record_id, h.record_id, 'question_exact', 1 from train t join held h on t.q = h.q"
_HASHES = f"select t.record_id as train_record_id, h.record_id as eval_record_id, least({_HAM.format('phash64')}, {_HAM.format('dhash64')}) as distance from train t, held h where t.image_applicable and h.image_applicable and t.phash64 is not null and h.phash64 is not null and t.dhash64 is not null and h.dhash64 is not null and least({_HAM.format('phash64')}, {_HAM.format('dhash64')}) <= 10"
_SETS = f"ts as (select record_id, {_SHINGLES} as s from train), hs as (select record_id, {_SHINGLES} as s from held), te as (select record_id, unnest(s) as g from ts), he as (select record_id, unnest(s) as g from hs), inter as (select t.record_id as t, h.record_id as h, count(*) as c from te t join he h using (g) group by all)"
_JACC = "select t as train_record_id, h as eval_record_id, c / (len(ts.s) + len(hs.s) - c) as score from inter join ts on ts.record_id = t join hs on hs.record_id = h where c / (len(ts.s) + len(hs.s) - c) >= 0.7"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return contamination.sides(table(spark, d, "decontamination"))


@query("j12_exact_overlap", f"with {_RECORDS} {_EXACT}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return contamination.exact_edges(*_sides(spark, d))


@query("j13_hamming", f"with {_RECORDS} {_HASHES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return contamination.hash_edges(*_sides(spark, d)).select("train_record_id", "eval_record_id", F.col("distance").cast("long").alias("distance"))


@query("j14_jaccard", f"with {_RECORDS}, {_SETS} select train_record_id, eval_record_id, round(score, 9) as score from ({_JACC})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return contamination.text_edges(*_sides(spark, d)).select("train_record_id", "eval_record_id", F.round("score", 9).alias("score"))


_EDGES = f"""with {_RECORDS}, {_SETS}, every as (select *, null::bigint as distance, null::double as score from ({_EXACT}) union all select train_record_id, eval_record_id, 'perceptual_hash', case when distance <= 6 then 2 else 1 end, distance, null from ({_HASHES}) union all select train_record_id, eval_record_id, 'question_5gram_jaccard', case when score >= 0.8 then 2 else 1 end, null, score from ({_JACC})),
  edge as (select train_record_id, eval_record_id, bool_or(signal = 'image_sha256_exact') as image_sha256_exact, bool_or(signal = 'question_answer_exact') as question_answer_exact, bool_or(signal = 'question_exact') as question_exact, min(distance) as hash_distance, round(max(score), 9) as question_5gram_jaccard, case when max(action) = 2 then 'remove' else 'inspect' end as action from every group by all)"""


@query("decon_edges", _EDGES + " select * from edge")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = contamination.edges(table(spark, d, "decontamination"))
    return out.withColumn("hash_distance", F.col("hash_distance").cast("long"))


@query("j21_removals", _EDGES + ", items as (select distinct record_id, dataset, item_id from decontamination where item_id is not null) select i.dataset, i.item_id, case when bool_or(e.action = 'remove') then 'remove' else 'inspect' end as action from edge e join items i on i.record_id = e.train_record_id group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "decontamination")
    return contamination.removals(contamination.edges(records), records)


# ---- paired runs

_SIDE = "(select item_id, arg_max(pair_correct, ordinal) as flag from trials where run = '{}' and seed = 0 group by item_id)"
_ALIGNED = f"with {TRIALS}, aligned as (select l.item_id, l.flag as \"left\", r.flag as \"right\" from {_SIDE.format('base')} l join {_SIDE.format('tuned')} r using (item_id))"


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).where("seed = 0")
    return compare.align(t.where("run = 'base'"), t.where("run = 'tuned'"), "item_id", "pair_correct")


@query("j01_align", _ALIGNED + ' select item_id, "left", "right" from aligned')
def _(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d)


@query("j02_strict", f"with {TRIALS} select item_id, max(case when run = 'base' then pair_correct::int end)::boolean as l_pair_correct, max(case when run = 'tuned' then pair_correct::int end)::boolean as r_pair_correct from trials where seed = 0 group by item_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = compare.last_wins(trials(spark, d).where("seed = 0").select("run", "item_id", "ordinal", "pair_correct"), ["run", "item_id"])
    sides = [t.where(F.col("run") == r).select("item_id", "pair_correct") for r in ("base", "tuned")]
    return compare.strict_join(*sides, ["item_id"])


@query("j03_locks", f"with {ROLLOUTS} select r.qid, list_sum(list_transform(r.bits, lambda x: x::int))::bigint as real_hits, list_sum(list_transform(b.bits, lambda x: x::int))::bigint as blind_hits from rollouts r join rollouts b using (qid) where r.condition = 'real' and b.condition = 'blind'")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = rollouts(spark, d).withColumn("n", F.size("bits"))
    real, blind = r.where("condition = 'real'").drop("condition"), r.where("condition = 'blind'").drop("condition")
    guards.equal_locks(real, blind, ["n"])
    hits = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return compare.strict_join(real, blind, ["qid"]).select("qid", hits(F.col("l_bits")).alias("real_hits"), hits(F.col("r_bits")).alias("blind_hits"))


@query("j04_choose_key", f"with {TRIALS} select case when count(*) = count(distinct item_id) then 'item_id' when count(*) = count(distinct (item_id, ordinal)) then 'item_id,ordinal' else 'item_id,run,seed,ordinal' end as chosen from trials")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    keys = compare.choose_key(t, t, [["item_id"], ["qid"], ["item_id", "ordinal"], ["item_id", "run", "seed", "ordinal"]])
    return spark.createDataFrame([(",".join(keys),)], "chosen string")


@query("j05_quadrants", _ALIGNED + ", q(quadrant) as (values ('both'), ('left_only'), ('neither'), ('right_only')) select quadrant, coalesce(n, 0)::bigint as n from q left join (select case when \"left\" and \"right\" then 'both' when \"left\" then 'left_only' when \"right\" then 'right_only' else 'neither' end as quadrant, count(*) as n from aligned group by 1) using (quadrant)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.quadrants(_aligned(spark, d))


@query("j08_change", f"with {TRIALS}, e as (select distinct item_id, seed, run, pair_correct from trials), s as (select item_id, seed + case when run = 'tuned' then 2 else 0 end as step, pair_correct::int::double as v from e) select a.step, count(*) as n, round(avg(a.v), 9) as mean, round(avg(a.v - b.v), 9) as change from s a join s b on a.item_id = b.item_id and b.step = 0 where a.step <> 0 group by a.step")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).select("item_id", "seed", "run", "pair_correct").distinct()
    steps = t.select("item_id", (F.col("seed") + F.when(F.col("run") == "tuned", 2).otherwise(0)).alias("step"), F.col("pair_correct").cast("int").alias("v"))
    return compare.paired_change(steps, "item_id", "step", 0, "v")


@query("j16_j17_audited", "with a as (select distinct qid from corpus_rows where pass_rate_7b_base >= 0), m as (select arm, case when lower(pair_group_uid) like 'virl:%' then substr(pair_group_uid, 6) end as qid from mixture_profiles) select m.arm, count(*) as n, count(a.qid) as audited, count(distinct a.qid) as items from m left join a using (qid) group by m.arm")
def _(spark: SparkSession, d: str) -> DataFrame:
    audited, stream = _audited(spark, d)
    return streams.audited_coverage(stream, audited, "qid", ["arm"])


def _audited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    audited = table(spark, d, "corpus_rows").where("pass_rate_7b_base >= 0").select("qid")
    stream = table(spark, d, "mixture_profiles").select("arm", F.when(F.lower("pair_group_uid").startswith("virl:"), F.expr("substr(pair_group_uid, 6)")).alias("qid"))
    return audited, stream


@query("j17_drawn", "select distinct qid from corpus_rows where pass_rate_7b_base >= 0 and qid in (select substr(pair_group_uid, 6) from mixture_profiles where lower(pair_group_uid) like 'virl:%')")
def _(spark: SparkSession, d: str) -> DataFrame:
    audited, stream = _audited(spark, d)
    return streams.drawn_and_audited(stream, audited, "qid")


_LAYER = "(select k, arg_min(split, ordinal) as split, arg_min(question, ordinal) as question from (select {key} as k, ordinal, split, question from " + SCENES + " where layer = '{layer}' and mother_item_id is not null) group by k)"


@query(
    "j18_layers",
    "select a.k as mother, a.split as l3_split, b.split as probe_split from " + _LAYER.replace("{key}", SQL_ITEM_KEY.format("mother_item_id").replace("{", "{{").replace("}", "}}")).format(layer="l3") + " a join " + _LAYER.replace("{key}", SQL_ITEM_KEY.format("mother_item_id").replace("{", "{{").replace("}", "}}")).format(layer="probe") + " b on a.k = b.k where a.k is not null",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, SCENES).withColumn("mother", item_key("mother_item_id"))
    return corpus.layer_pairs(s, "mother", "layer", "l3", "probe", ["split"])


@query("j23_nearest", f"with p as (select ordinal, p.label as l, p.x as x, p.y as y from (select ordinal, unnest(scene_a) as p from {SCENES} where scene_a is not null)) select a.ordinal, a.l as label, (arg_min(b.l, struct_pack(d := (a.x - b.x) ** 2 + (a.y - b.y) ** 2, l := b.l))) as nearest from p a join p b on a.ordinal = b.ordinal and a.l <> b.l group by a.ordinal, a.l")
def _(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, SCENES).where("scene_a is not null").select("ordinal", "scene_a", F.explode("scene_a").alias("p"))
    others = F.filter("scene_a", lambda q: q["label"] != F.col("p.label"))
    near = F.array_min(F.transform(others, lambda q: F.struct((F.pow(q["x"] - F.col("p.x"), 2) + F.pow(q["y"] - F.col("p.y"), 2)).alias("d"), q["label"].alias("l"))))
    return points.select("ordinal", F.col("p.label").alias("label"), near["l"].alias("nearest")).where("nearest is not null").distinct()


# ---- rates


@query("a01_accuracy", f"with {TRIALS} select run, seed, count(*) as n, round(avg(pair_correct::int), 9) as accuracy, round(avg((correct_a::int + correct_b::int) / 2), 9) as member_accuracy from trials group by run, seed")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = guards.no_nulls(trials(spark, d), ["correct_a", "correct_b"])
    return t.groupBy("run", "seed").agg(F.count("*").alias("n"), F.round(compare.rate(F.col("pair_correct")), 9).alias("accuracy"), F.round(compare.member_rate(F.col("correct_a"), F.col("correct_b")), 9).alias("member_accuracy"))


@query("a04_by_template", f"with {TRIALS} select coalesce(layer, 'unknown') as layer, cell, count(*) as n, round(avg(pair_correct::int), 9) as accuracy from trials where run = 'tuned' group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).where("run = 'tuned'").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer"), "cell").agg(F.count("*").alias("n"), F.round(compare.rate(F.col("pair_correct")), 9).alias("accuracy"))


@query("a05_rollup", f"with {TRIALS} select cell, role, count(*) as n, round(avg(pair_correct::int), 9) as accuracy from trials group by rollup(cell, role)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).rollup("cell", "role").agg(F.count("*").alias("n"), F.round(compare.rate(F.col("pair_correct")), 9).alias("accuracy"))


@query("a06_pair_all", "select l_orderkey, bool_and(l_returnflag = 'N') as all_correct from lineitem group by l_orderkey having count(*) = 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.group_all(table(spark, d, "lineitem").withColumn("ok", F.col("l_returnflag") == "N"), "l_orderkey", "ok")


@query("a07_seed_means", f"with {TRIALS} select run, round(avg(m), 9) as mean, round(coalesce(stddev_samp(m), 0), 9) as sd, count(*) as n_seeds from (select run, seed, avg(pair_correct::int) as m from trials group by run, seed) group by run")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.seed_means(trials(spark, d), ["run"], "seed", "pair_correct")


@query("a09_counts", "select dataset, split, count(*) as n, count(distinct item_id) as items from decontamination group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decontamination").groupBy("dataset", "split").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))


@query("a10_summary", "select l_returnflag, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as fraction, round(avg(l_quantity), 9) as mean, median(l_quantity) as median, min(l_quantity) as low, max(l_quantity) as high from lineitem group by l_returnflag")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 9).alias("mean"), F.percentile("l_quantity", 0.5).alias("median"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return g.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 9))


_P = "list_sum(list_transform(bits, lambda x: x::int))"


@query("a11_bands", f"with {ROLLOUTS} select condition, case when p = 0 then '0' when p < 0.2 then '(0,.2)' when p <= 0.8 then '[.2,.8]' when p < 1 then '(.8,1)' else '1' end as band, count(*) as n from (select condition, {_P} / 16 as p from rollouts) group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.size(F.filter("bits", lambda x: x)) / 16
    return rollouts(spark, d).groupBy("condition", measures.sample_band(p).alias("band")).agg(F.count("*").alias("n"))


@query("a12_histogram", "select least(floor(l_discount * 10) + 1, 10)::bigint as bin, count(*) as n from lineitem group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(ranking.histogram01(F.col("l_discount")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_ARMS = "arms as (select arm, least(floor(base_accuracy * 10), 9)::bigint as band, base_accuracy from mixture_profiles where base_accuracy is not null and not isnan(base_accuracy))"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mixture_profiles").where("base_accuracy is not null and not isnan(base_accuracy)")
    return rows.select("arm", ranking.decile_band(F.col("base_accuracy")).alias("band"), "base_accuracy")


@query("a13_support", f"with {_ARMS}, common as (select band from arms group by band having count(distinct arm) = (select count(distinct arm) from arms)) select arm, count(*) as n, count(c.band) as n_common, round(count(c.band) / count(*), 9) as share from arms left join common c using (band) group by arm")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.common_support(_arms(spark, d), "arm", "band")


@query("a14_standardize", f"with {_ARMS}, cells as (select arm, band, count(*) as k, avg(base_accuracy) as m from arms group by all), pooled as (select band, sum(k) as w from cells group by band having count(*) = (select count(distinct arm) from arms)) select arm, round(sum(m * w) / sum(w), 9) as standardized, sum(k)::bigint as n from cells join pooled using (band) group by arm")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.standardized(_arms(spark, d), "arm", "band", "base_accuracy")


@query("a15_lattice", "select round(round_even(l_discount / 0.04, 0) * 0.04, 6) as cell, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from lineitem group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").groupBy(F.round(ranking.lattice(F.col("l_discount"), 0.04), 6).alias("cell")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 9))


@query("a16_budget", f"select cell, sum(k)::bigint as n, max(k) as most, max(k) <= greatest(1, sum(k) * 0.1) as within from (select cell, answer_a, count(*) as k from {SCENES} where answer_a is not null group by all) group by cell")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).where("answer_a is not null").withColumn("value", F.col("answer_a"))
    return ranking.boundary_shares(rows, "cell", 0.1)


@query("a20_movement", f"with {TRIALS}, e as (select cell, (max(case when run = 'tuned' then pair_correct::int end) - max(case when run = 'base' then pair_correct::int end))::double as gain from trials where seed = 0 group by item_id, cell), g as (select cell, count(*) as n, avg(gain) as m from e group by cell) select cell, n, round(m, 9) as mean, round(m * n / (select sum(m * n) from g), 9) as share from g")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).where("seed = 0")
    best = lambda r: F.max(F.when(F.col("run") == r, F.col("pair_correct").cast("int")))
    return compare.movement_share(t.groupBy("item_id", "cell").agg((best("tuned") - best("base")).cast("double").alias("gain")), "cell", "gain")


@query("a21_mass", f"with {ROLLOUTS}, gain as (select r.category, ({_P.replace('bits', 'r.bits')} - {_P.replace('bits', 'b.bits')}) / 16 as g from rollouts r join rollouts b using (qid) where r.condition = 'real' and b.condition = 'blind'), m as (select avg(g) as v from gain) select f, round(f * 0.5 + (1 - f) * v, 9) as mass from m, (values (0.0), (0.25), (0.5), (1.0)) as t(f)")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = F.size(F.filter("bits", lambda x: x)) / 16
    mean = rollouts(spark, d).agg((F.avg(F.when(F.col("condition") == "real", hits)) - F.avg(F.when(F.col("condition") == "blind", hits))).alias("v"))
    shares = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)]))
    return mean.select(shares.alias("f"), "v").select("f", F.round(F.col("f") * 0.5 + (1 - F.col("f")) * F.col("v"), 9).alias("mass"))


@query("a22_monotone", "select l_returnflag, coalesce(bool_and(m > prev), true) as monotone from (select l_returnflag, m, lag(m) over (partition by l_returnflag order by y) as prev from (select l_returnflag, year(l_shipdate) as y, sum(l_quantity) as m from lineitem group by all)) group by l_returnflag")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("m"))
    step = F.col("m") > F.lag("m").over(Window.partitionBy("l_returnflag").orderBy("y"))
    return g.withColumn("up", step).groupBy("l_returnflag").agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("monotone"))


@query("a23_argmax", "select l_linestatus, l_returnflag as best, n from (select *, row_number() over (partition by l_linestatus order by n desc, l_returnflag) as r from (select l_linestatus, l_returnflag, count(*) as n from lineitem group by all)) where r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))
    return g.groupBy("l_linestatus").agg(F.min_by("l_returnflag", F.struct(-F.col("n"), "l_returnflag")).alias("best"), F.max("n").alias("n"))


@query("a24_venn", "select region, count(*) as n from (select user_id, concat(max((event_type = 'click')::int), max((event_type = 'purchase')::int), max((event_type = 'error')::int)) as region from events where event_type in ('click', 'purchase', 'error') group by user_id) group by region")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.venn_regions(table(spark, d, "events"), "user_id", "event_type", ["click", "purchase", "error"])


# ---- ranks and rank statistics


@query("w02_avg_rank", "select o_orderkey, rank() over (partition by o_orderpriority order by v) + (count(*) over (partition by o_orderpriority, v) - 1) / 2 as avg_rank from (select o_orderkey, o_orderpriority, round(o_totalprice / 1000) as v from orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("v", F.round(F.col("o_totalprice") / 1000))
    return rows.select("o_orderkey", ranking.average_rank("v", ["o_orderpriority"]).alias("avg_rank"))


@query("w03_deciles", "with r as (select *, n % 5 as hits from (select c_custkey, c_acctbal as q, c_nationkey / 25 as gain, c_custkey as n from customer)), p as (select *, (hits > 0)::int as above, row_number() over (partition by (hits > 0)::int order by q, c_custkey) as i, count(*) over (partition by (hits > 0)::int) as m from r) select case when above = 0 then 0 else ceil(10 * i / m)::int end as decile, count(*) as n, round(min(q), 9) as q_min, round(max(q), 9) as q_max, round(avg(gain), 9) as mean_gain from p group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("q"), (F.col("c_nationkey") / 25).alias("gain"), (F.col("c_custkey") % 5).alias("hits"))
    return ranking.floor_and_deciles(rows, "hits", "q", "gain", "c_custkey")


@query("w04_top_quartile", "select c_mktsegment, c_custkey, position, m from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by v desc, c_custkey::varchar) as position, ceil(count(*) over (partition by c_mktsegment) / 4)::bigint as m from (select *, round(c_acctbal / 100) as v from customer)) where position <= m")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("v", F.round(F.col("c_acctbal") / 100))
    return ranking.quartile_edge(rows, "v", "c_custkey", ["c_mktsegment"]).select("c_mktsegment", "c_custkey", "position", "m")


@query(
    "w05_expected_retrieval",
    "with r as (select c_mktsegment as g, round(c_acctbal / 500) as v, (c_nationkey < 10)::int as hit from customer), k as (select g, v, count(*) as k, sum(hit) as h from r group by all), p as (select *, ceil(sum(k) over (partition by g) / 4) as m, sum(k) over (partition by g) as n, sum(k) over (partition by g order by v desc) as upto from k) select g as c_mktsegment, max(m)::bigint as m, round(sum(greatest(0, least(k, m - (upto - k))) / k * h) / max(m), 9) as retrieval, round(max(case when upto >= m and upto - k < m then k / n end), 9) as tie_mass from p group by g",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_mktsegment", F.round(F.col("c_acctbal") / 500).alias("v"), (F.col("c_nationkey") < 10).alias("hit"))
    return ranking.expected_retrieval(rows, "v", "hit", ["c_mktsegment"])


@query("w08_windows", "select arm, ordinal // 240 as window_no, count(*) as n, count(distinct pair_group_uid) as uids from mixture_profiles group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = corpus.count_windows(table(spark, d, "mixture_profiles"), 240)
    return w.groupBy("arm", F.col("window").alias("window_no")).agg(F.count("*").alias("n"), F.count_distinct("pair_group_uid").alias("uids"))


@query("w11_extremum", f"with p as (select ordinal, p.label as l, p.x as x from (select ordinal, unnest(scene_a) as p from {SCENES} where scene_a is not null)), r as (select *, row_number() over (partition by ordinal order by x desc, l) as r from p) select ordinal, max(case when r = 1 then l end) as target, max(case when r = 1 then x end) - max(case when r = 2 then x end) as margin from r where r <= 2 group by ordinal")
def _(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, SCENES).where("scene_a is not null").select("ordinal", F.explode("scene_a").alias("p")).select("ordinal", F.col("p.label").alias("label"), F.col("p.x").alias("x"))
    return ranking.extremum_gap(points, ["ordinal"], "x", "label")


@query("w12_first_seen", "select pair_group_uid, arg_min(arm, ordinal) as arm, min(ordinal) as ordinal from mixture_profiles where pair_group_uid is not null group by pair_group_uid")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mixture_profiles").where("pair_group_uid is not null").select("pair_group_uid", "arm", "ordinal")
    return compare.first_wins(rows, ["pair_group_uid"])


@query("w13_last_seen", "select pair_group_uid, arg_max(arm, ordinal) as arm, max(ordinal) as ordinal from mixture_profiles where pair_group_uid is not null group by pair_group_uid")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mixture_profiles").where("pair_group_uid is not null").select("pair_group_uid", "arm", "ordinal")
    return compare.last_wins(rows, ["pair_group_uid"])


@query("r09_percentiles", "select l_returnflag, quantile_cont(l_extendedprice, 0.025) as low, quantile_cont(l_extendedprice, 0.975) as high from lineitem group by l_returnflag")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.percentile("l_extendedprice", F.array(F.lit(0.025), F.lit(0.975)))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(p.alias("p")).select("l_returnflag", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


_W = f"({compare.Z95} * {compare.Z95})"


@query(
    "r10_wilson",
    f"with {TRIALS}, s as (select run, seed, sum(pair_correct::int) as k, count(*) as n from trials group by all) select run, seed, round(greatest(0, (k/n + {_W}/(2*n)) / (1 + {_W}/n) - {compare.Z95} * sqrt((k/n)*(1-k/n)/n + {_W}/(4*n*n)) / (1 + {_W}/n)), 9) as low, round(least(1, (k/n + {_W}/(2*n)) / (1 + {_W}/n) + {compare.Z95} * sqrt((k/n)*(1-k/n)/n + {_W}/(4*n*n)) / (1 + {_W}/n)), 9) as high from s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = trials(spark, d).groupBy("run", "seed").agg(F.sum(F.col("pair_correct").cast("int")).alias("k"), F.count("*").alias("n"))
    return s.withColumn("w", compare.wilson(F.col("k").cast("double"), F.col("n").cast("double"))).select("run", "seed", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query("r13_mcnemar", _ALIGNED + ', c as (select count(*) as n, sum((not "left" and "right")::int)::bigint as b01, sum(("left" and not "right")::int)::bigint as b10 from aligned) select n, b01, b10, round(case when b01 + b10 = 0 then 1 else least(1, 2 * (select sum(exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2))) from range(0, least(b01, b10) + 1) as t(i))) end, 9) as p_value from c')
def _(spark: SparkSession, d: str) -> DataFrame:
    return compare.discordant(_aligned(spark, d))


@query("r17_spearman", "with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as rx, rank() over (partition by l_returnflag order by l_discount) + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2 as ry from lineitem) select l_returnflag, count(*) as n, round(corr(rx, ry), 9) as rho from r group by l_returnflag")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])


@query("r18_auc", "with r as (select l_linestatus, (l_returnflag = 'R')::int as y, rank() over (partition by l_linestatus order by l_quantity) + (count(*) over (partition by l_linestatus, l_quantity) - 1) / 2 as r from lineitem) select l_linestatus, sum(y)::bigint as n_pos, sum(1 - y)::bigint as n_neg, case when sum(y) > 0 and sum(1 - y) > 0 then round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 9) end as auc from r group by l_linestatus")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.auc(table(spark, d, "lineitem").withColumn("y", F.col("l_returnflag") == "R"), "l_quantity", "y", ["l_linestatus"])


@query("r19_ks", "with k as (select l_linestatus as g, l_extendedprice as v, sum((l_discount > 0.05)::int) as a, sum((l_discount <= 0.05)::int) as b from lineitem group by all), c as (select g, a, b, abs(sum(a) over (partition by g order by v) / sum(a) over (partition by g) - sum(b) over (partition by g order by v) / sum(b) over (partition by g)) as gap from k) select g as l_linestatus, sum(a)::bigint as n_a, sum(b)::bigint as n_b, round(max(gap), 9) as d from c group by g")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ks_statistic(table(spark, d, "lineitem").withColumn("y", F.col("l_discount") > 0.05), "l_extendedprice", "y", ["l_linestatus"])


@query("r21_slope", "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope from lineitem group by l_returnflag")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"))


# ---- formulas


@query("m01_pass_at_k", f"with {ROLLOUTS}, c as (select qid, condition, {_P} as c from rollouts) select qid, condition, round(case when 16 - c < 5 then 1 else 1 - list_product(list_transform(range(0, 5), lambda i: (16 - c - i) / (16 - i))) end, 9) as pass_at_5, round((c + 0.5) / 17, 9) as jeffreys, round(1 - pow(c / 16, 5) - pow(1 - c / 16, 5), 9) as mixed from c")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = F.size(F.filter("bits", lambda x: x))
    return rollouts(spark, d).select("qid", "condition", F.round(measures.pass_at_k(F.lit(16), c, 5), 9).alias("pass_at_5"), F.round(measures.jeffreys(c, F.lit(16)), 9).alias("jeffreys"), F.round(measures.mixed_group(c / 16, 5), 9).alias("mixed"))


@query("m07_retention", f"with {TRIALS}, r as (select cell, avg(case when run = 'tuned' then pair_correct::int end) as v, avg(case when run = 'base' then pair_correct::int end) as b from trials group by cell) select cell, round(case when abs(b - 0.125) >= 1e-12 then (v - 0.125) / (b - 0.125) end, 9) as retention from r")
def _(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda r: F.avg(F.when(F.col("run") == r, F.col("pair_correct").cast("int")))
    r = trials(spark, d).groupBy("cell").agg(mean("tuned").alias("v"), mean("base").alias("b"))
    return r.select("cell", F.round(measures.retention(F.col("v"), F.col("b"), measures.chance_level(F.lit(8))), 9).alias("retention"))


@query("m11_opaque", f"select ordinal, substr(sha256('release' || chr(0) || pair_id), 1, 16) as opaque from {SCENES} where pair_id is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SCENES).where("pair_id is not null").select("ordinal", measures.opaque_id("release", F.col("pair_id")).alias("opaque"))


@query("m12_seed", "select distinct item_id, (17 + ('0x' || substr(sha256(item_id), 1, 8))::bigint) % 4294967296 as seed from decontamination where item_id is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decontamination").where("item_id is not null").select("item_id", measures.digest_seed(17, F.col("item_id")).alias("seed")).distinct()


@query("m13_hash_split", f"select scene_program_id, case when b < 60 then 'training' when b < 80 then 'development' else 'confirmatory' end as split from (select distinct scene_program_id, ('0x' || substr(sha256(scene_program_id || '|split-v1'), 1, 8))::bigint % 100 as b from {SCENES} where scene_program_id is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SCENES).where("scene_program_id is not null").select("scene_program_id", measures.hash_split(F.col("scene_program_id")).alias("split")).distinct()


@query("m15_distances", f"select ordinal, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) as euclid, greatest(abs(a.x - b.x), abs(a.y - b.y)) as chebyshev from (select ordinal, scene_a[1] as a, scene_a[2] as b from {SCENES} where len(scene_a) >= 2)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).where(F.size("scene_a") >= 2).select("ordinal", F.col("scene_a")[0].alias("a"), F.col("scene_a")[1].alias("b"))
    at = [F.col(c) for c in ("a.x", "a.y", "b.x", "b.y")]
    return rows.select("ordinal", F.round(measures.euclidean(*at), 9).alias("euclid"), measures.chebyshev(*at).alias("chebyshev"))


# ---- corpus building


_STRATA = "select coalesce(source, 'unknown') as source, coalesce(category, 'unknown') as category from corpus_rows"


@query(
    "d01_allocation",
    f"with g as (select source, category, count(*) as n from ({_STRATA}) group by all), t as (select sum(n) as t from g), i as (select g.*, least(80, t) * n / t as ideal, least(80, t) as size from g, t), r as (select *, floor(ideal) as base, row_number() over (order by round(ideal - floor(ideal), 12) desc, n desc, source desc, category desc) as r from i) select source, category, n, (base + (r <= size - (select sum(floor(ideal)) from i))::int)::bigint as take from r",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_rows").select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("category", F.lit("unknown")).alias("category"))
    return corpus.allocation(rows, ["source", "category"], min(80, rows.count()))


@query("d02_stratified")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = compare.first_wins(table(spark, d, "corpus_rows").select("qid", F.coalesce("source", F.lit("unknown")).alias("source"), F.lit(0).alias("ordinal")), ["qid"])
    return corpus.stratified_sample(rows, ["source"], "qid", min(80, rows.count()), 7).select("qid", "source")


@query(
    "d04_mixture",
    f"with c as (select (row_number() over (order by ordinal) - 1) as o, {SQL_ITEM_KEY.format('pair_id')} as uid from {SCENES} where pair_id is not null and split = 'training'), n as (select row_number() over (order by md5(qid)) - 1 as o, 'virl:' || qid as uid from (select distinct qid from corpus_rows)), k as (select count(*) as k from c), b as (select case when count(*) >= 160 then 240 else 24 end as b, count(*) as pool from n), s as (select b, b // 3 as c, b - b // 3 as d, greatest(1, pool // (b - b // 3)) as windows from b) select (i // s.c * s.b + i % s.c)::bigint as ordinal, 'constructed' as arm_part, c.uid from s, range(0, (select windows * c from s)) as t(i), k join c on c.o = i % k union all select (o // s.d * s.b + s.c + o % s.d)::bigint, 'natural', uid from n, s where o < s.windows * s.d",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """As many windows as the natural pool fills: of 240 rows, of 24 where it does not fill one of 240."""
    scenes = ordering.numbered(table(spark, d, SCENES).where("pair_id is not null and split = 'training'").select(F.col("ordinal").alias("at"), item_key("pair_id").alias("uid")), "at").drop("at")
    natural = table(spark, d, "corpus_rows").select("qid").distinct().select(F.concat(F.lit("virl:"), "qid").alias("uid"), F.md5("qid").alias("k"))
    pool = natural.count()
    batch = 240 if pool >= 160 else 24
    return corpus.mixture(scenes, natural, "1/3", max(1, pool // (batch - batch // 3)), batch, F.col("k"), ["uid"])


@query("d06_freeze", _EDGES + ", out as (select distinct i.dataset, i.item_id from edge e join (select distinct record_id, dataset, item_id from decontamination) i on i.record_id = e.train_record_id where e.action = 'remove') select r.dataset, count(*) as n, count(distinct r.item_id) as items from decontamination r where r.split = 'train' and not exists (select 1 from out o where o.dataset = r.dataset and o.item_id = r.item_id) group by r.dataset")
def _(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "decontamination")
    kept = contamination.without_removed(records.where("split = 'train'"), contamination.removals(contamination.edges(records), records))
    return kept.groupBy("dataset").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))


@query("d08_profiles", f"with {_ARMS} select arm, band, count(*) as n, round(avg(base_accuracy), 9) as mean from arms group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).groupBy("arm", "band").agg(F.count("*").alias("n"), F.round(F.avg("base_accuracy"), 9).alias("mean"))


@query("d09_merge", "select image_sha256, min(trim(image_path)) as image_path, count(*) as copies from decontamination where image_applicable and image_sha256 is not null group by image_sha256 having count(distinct trim(image_path)) = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decontamination").where("image_applicable and image_sha256 is not null")
    one = rows.groupBy("image_sha256").agg(F.count_distinct(F.trim("image_path")).alias("u")).where("u = 1").select("image_sha256")
    return corpus.merge_shards(rows.join(one, "image_sha256", "left_semi"), "image_sha256", "image_path")


# ---- validation


@query(
    "v02_scene_rules",
    f"""with s as (select * from {SCENES}), v as (
    select 'answers_equal' as code, ordinal::varchar as key from s where answers_equal <> (answer_a = answer_b)
    union all select 'bad_digest_a', ordinal::varchar from s where not regexp_full_match(image_a_sha256, '[0-9a-f]{{64}}')
    union all select 'bad_digest_b', ordinal::varchar from s where not regexp_full_match(image_b_sha256, '[0-9a-f]{{64}}')
    union all select 'same_images', ordinal::varchar from s where image_a_sha256 = image_b_sha256
    union all select 'no_question', ordinal::varchar from s where question is null or trim(question) = ''
    union all select 'no_scene', ordinal::varchar from s where scene_a is null or scene_b is null
    union all select 'n_points', ordinal::varchar from s where verifier_results.n_points <> len(scene_a)
    union all select 'not_exact', ordinal::varchar from s where not verifier_results.exact_by_construction
    union all select 'layer_differs', ordinal::varchar from s where verifier_results.layer <> layer
    union all select 'bad_layer', ordinal::varchar from s where layer not in ('l1', 'l2', 'l3', 'probe')
    union all select 'bad_role', ordinal::varchar from s where role not in ('target_stable', 'target_switch', 'invariance')
    union all select 'cell_size', ordinal::varchar from s where len(scene_a) <> case cell when 'n8' then 8 when 'n12' then 12 when 'n20' then 20 end
    union all select 'repeated_label_a', ordinal::varchar from s where len(list_distinct(list_transform(scene_a, lambda p: p.label))) <> len(scene_a)
    union all select 'repeated_label_b', ordinal::varchar from s where len(list_distinct(list_transform(scene_b, lambda p: p.label))) <> len(scene_b)
    union all select 'out_of_bounds', ordinal::varchar from s where len(list_filter(scene_a, lambda p: abs(p.x) > 7 or abs(p.y) > 7)) > 0
    union all select 'repeated_pair', pair_id from s where pair_id is not null group by pair_id having count(*) > 1) select * from v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return validate.scene_violations(table(spark, d, SCENES))


@query("w09_adjacency", "select block from (select ordinal // 4 as block, count(distinct pair_group_uid) as g, list(pair_member order by ordinal) as m from mixture_profiles group by 1) where g <> 1 or m <> ['l3_a', 'l3_b', 'probe_a', 'probe_b']")
def _(spark: SparkSession, d: str) -> DataFrame:
    return validate.adjacency(table(spark, d, "mixture_profiles"), "pair_group_uid", "ordinal", ["l3_a", "l3_b", "probe_a", "probe_b"], "pair_member")


# ---- resampling (Python streams: no SQL)


@query("r01_bootstrap")
def _(spark: SparkSession, d: str) -> DataFrame:
    return resampling.bootstrap_cells(trials(spark, d).withColumn("v", F.col("pair_correct").cast("double")), ["run", "seed"], "v", "ordinal")


@query("r28_schedule")
def _(spark: SparkSession, d: str) -> DataFrame:
    return resampling.rollout_stability(rollouts(spark, d).where("condition = 'real'"), ["category"], "qid", "bits", "corpus", "real")
