"""Queries of projections, captions, attacks, audits and the composite report targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import measures, text
from sievewright.functions.answers import answers_equal, close, disagreement, golds_equivalent, normalize_presentation, numeric_value, open_score, pair_score, plain_number, reward, satisfies_contract
from sievewright.functions.keys import SQL_ITEM_KEY, item_key, unit_hash
from sievewright.operators import attack, captions, compare, contamination, corpus, guards, ordering, project, ranking, release, resampling, streams, validate
from sievewright.plans import targets
from sievewright.queries.reference import _form, _whole
from sievewright.queries.base import RESPONSES, ROLLOUTS, SCENES, TRIALS, responses, rollouts, trials
from sievewright.session import table
from sievewright.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}

_P = "list_sum(list_transform({}, lambda x: x::int))"
_LAST = "(select run, seed, item_id, arg_max(pair_correct, ordinal) as pair_correct, arg_max(correct_a, ordinal) as correct_a, arg_max(correct_b, ordinal) as correct_b, arg_max(cell, ordinal) as cell, arg_max(layer, ordinal) as layer, arg_max(role, ordinal) as role from trials group by all)"
_PAIRED = f"last as (from {_LAST}), j as (select b.item_id, b.cell, b.layer, b.role, b.pair_correct as base, t.pair_correct as tuned, (b.correct_a::int + b.correct_b::int) / 2 as mb, (t.correct_a::int + t.correct_b::int) / 2 as mt from last b join last t using (item_id) where b.run = 'base' and t.run = 'tuned' and b.seed = 0 and t.seed = 0)"
_RB = f"rb as (select r.qid, r.category, {_P.format('r.bits')} as real, {_P.format('b.bits')} as blind from rollouts r join rollouts b using (qid) where r.condition = 'real' and b.condition = 'blind')"


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- projections


@query("proj01_training_rows", "select 'virl:' || qid as pair_group_uid, question as problem, answer, len(image_paths) as n_images, category from (select distinct on (qid) * from corpus_rows order by qid, question) where qid in (select qid from corpus_rows group by qid having count(distinct question) = 1 and count(distinct answer) <= 1 and count(distinct category) <= 1 and count(*) = 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_rows")
    one = rows.groupBy("qid").count().where("count = 1").select("qid")
    return project.training_rows(rows.join(one, "qid", "left_semi")).select("pair_group_uid", "problem", "answer", F.size("images").alias("n_images"), "category")


@query("proj02_scorable", f"select ordinal, answer_a as gold, coalesce(nullif(answer_b, 'none'), '') as prediction from {SCENES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).select("ordinal", F.col("answer_a").alias("gold_a"), F.col("answer_b").alias("gold_b"), F.col("answer_b").alias("prediction_a"), F.col("answer_a").alias("prediction_b"))
    return project.to_scorable(rows).select("ordinal", F.col("answer_a").alias("gold"), F.col("prediction_a").alias("prediction"))


@query("proj03_members", f"select ordinal, 'a' as side, answer_a as answer, image_a_path as image_path from {SCENES} union all select ordinal, 'b', answer_b, image_b_path from {SCENES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).withColumns({"image_path_a": F.col("image_a_path"), "image_path_b": F.col("image_b_path")})
    return project.members(rows, ["ordinal"], ["answer", "image_path"])


@query("proj04_corpus_key", "select ordinal, case when lower(pair_group_uid) like 'virl:%' then substr(pair_group_uid, 6) else pair_group_uid || ':' || coalesce(pair_member, '') end as corpus_key from mixture_profiles where pair_group_uid is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mixture_profiles").where("pair_group_uid is not null")
    return rows.select("ordinal", corpus.corpus_key(F.col("category"), F.col("pair_group_uid"), F.col("pair_member")).alias("corpus_key"))


@query("proj05_public", f"select ordinal, pair_id, question from {SCENES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).select("ordinal", "pair_id", "question", "answer_a", "answer_b")
    return project.public_part(rows, ["answer_a", "answer_b"])


@query("proj06_columns", "select name from (select unnest([struct_pack(name := 'doc_id', n := count(doc_id)), struct_pack(name := 'source', n := count(source)), struct_pack(name := 'nothing', n := 0), struct_pack(name := 'lang', n := count(lang)), struct_pack(name := 'late', n := count(case when collected_at < written_at then 1 end))], recursive := true) from documents) where n > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Columns that hold any value."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.lit(None).cast("string").alias("nothing"), "lang", F.when(F.col("collected_at") < F.col("written_at"), 1).alias("late"))
    return spark.createDataFrame([(c,) for c in project.without_empty_columns(rows).columns], "name string")


@query("proj07_conditioned", "select ordinal, case when (length(problem) - length(replace(problem, '<image>', ''))) // 7 = len(images) then trim(regexp_replace(array_to_string(list_transform(string_split(problem, '<image>'), lambda x: trim(x)), ' '), '[ \\t]+', ' ', 'g')) end as prompt from mixture_profiles where problem is not null and images is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mixture_profiles").where("problem is not null and images is not null")
    return rows.select("ordinal", project.conditioned_text(F.col("problem"), F.col("images"), "none").alias("prompt"))


@query("proj09_options", "select array_to_string(list_transform(range(1, len(image_paths) + 1), lambda i: chr((64 + i)::int) || '. ' || image_paths[i]), chr(10)) as lines, qid from (select distinct qid, image_paths from corpus_rows)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_rows").select("qid", "image_paths").distinct().select(text.option_lines(F.col("image_paths")).alias("lines"), "qid")


@query("src19_subset", f"select ordinal, split, case split when 'training' then 1 else 2 end as split_place from {SCENES} where (split = 'training' and ordinal in (select ordinal from {SCENES} where layer = 'l1')) or split = 'development'")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).select("ordinal", "split", "layer")
    out = project.ordered_subset(rows, ["training", "development"], rows.where("layer = 'l1'"), index="ordinal")
    return out.select("ordinal", "split", F.col("place.split_place").cast("int").alias("split_place"))


# ---- joins with checks

_MEMBERS = f"m as (select distinct pair_id, side, sha from (select pair_id, 'a' as side, image_a_sha256 as sha from {SCENES} where pair_id is not null union all select pair_id, 'b', image_b_sha256 from {SCENES} where pair_id is not null)), c as (select sha as image_sha256, 'caption ' || substr(sha, 1, 6) as caption from (select distinct sha from m where sha is not null) where substr(md5(sha), 1, 1) <> '0')"


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, SCENES).where("pair_id is not null").select("pair_id", F.col("image_a_sha256").alias("image_sha256_a"), F.col("image_b_sha256").alias("image_sha256_b"))
    m = project.members(rows, ["pair_id"], ["image_sha256"]).distinct()
    c = m.select("image_sha256").where("image_sha256 is not null").distinct().where(F.substring(F.md5("image_sha256"), 1, 1) != "0")
    return m, c.withColumn("caption", F.concat(F.lit("caption "), F.substring("image_sha256", 1, 6)))


@query(
    "j09_caption_problems",
    f"with {_MEMBERS}, v as (select 'bad_digest' as code, image_sha256 as key from c where not regexp_full_match(image_sha256, '[0-9a-f]{{64}}') union select 'sides', pair_id from m group by pair_id having list(side order by side) <> ['a', 'b'] union select 'shared_image', sha from m where sha is not null group by sha having count(distinct pair_id) > 1 union select 'no_image', pair_id from m where sha is null union select 'missing_caption', sha from m where sha is not null and sha not in (select image_sha256 from c)) select code, count(*) as n from v group by code",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return captions.caption_problems(*_members(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


@query("j10_caption_pairs", f"with {_MEMBERS} select * from (select pair_id, max(case when side = 'a' then caption end) as caption_a, max(case when side = 'b' then caption end) as caption_b from m join c on m.sha = c.image_sha256 group by pair_id) where caption_a is not null and caption_b is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return captions.caption_pairs(*_members(spark, d), strict=False)


@query("j11_captions_in_order", "with u as (select distinct qid, image_paths from corpus_rows where len(image_paths) > 0), one as (select qid, any_value(image_paths) as image_paths from u group by qid having count(*) = 1), c as (select distinct p, 'c:' || md5(p) as caption from (select unnest(image_paths) as p from corpus_rows) where substr(md5(p), 1, 1) <> '0') select qid, case when count(caption) = max(len(image_paths)) then list(caption order by i) end as captions from (select qid, image_paths, unnest(image_paths) as p, generate_subscripts(image_paths, 1) as i from one) e join c using (p) group by qid")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "corpus_rows").where(F.size("image_paths") > 0).select("qid", "image_paths").distinct()
    one = u.join(u.groupBy("qid").count().where("count = 1").select("qid"), "qid", "left_semi")
    c = table(spark, d, "corpus_rows").select(F.explode("image_paths").alias("p")).distinct().where(F.substring(F.md5("p"), 1, 1) != "0").withColumn("caption", F.concat(F.lit("c:"), F.md5("p")))
    return captions.captions_in_order(one, "qid", "image_paths", c, "p")


@query("j06_audit_groups", f"with {TRIALS}, s as (select distinct cell, run, item_id, pair_correct from trials where seed = 0), a as (select cell, count(*) filter (run = 'base') as x, count(*) filter (run = 'tuned') as y from s group by cell) select s.cell, s.item_id, s.pair_correct as base, t.pair_correct as tuned from s join s t on s.item_id = t.item_id and s.cell = t.cell join a on a.cell = s.cell where s.run = 'base' and t.run = 'tuned' and a.x = a.y")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = trials(spark, d).where("seed = 0").select("cell", "run", "item_id", "pair_correct").distinct()
    side = lambda r: s.where(F.col("run") == r).select("cell", "item_id", F.col("pair_correct").alias(r))
    sizes = s.groupBy("cell").agg(F.sum((F.col("run") == "base").cast("int")).alias("x"), F.sum((F.col("run") == "tuned").cast("int")).alias("y")).where("x = y").select("cell")
    return side("base").join(side("tuned"), ["cell", "item_id"]).join(sizes, "cell", "left_semi")


@query("j07_member_delta", f"with {TRIALS}, {_PAIRED} select layer, count(*) as n, round(avg(mt - mb), 9) as delta from j group by layer")
def _(spark: SparkSession, d: str) -> DataFrame:
    one = compare.last_wins(trials(spark, d).where("seed = 0"), ["run", "item_id"]).withColumn("m", (F.col("correct_a").cast("int") + F.col("correct_b").cast("int")) / 2)
    a, b = one.where("run = 'base'").select("item_id", "layer", F.col("m").alias("x")), one.where("run = 'tuned'").select("item_id", F.col("m").alias("y"))
    return a.join(b, "item_id").groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y") - F.col("x")), 9).alias("delta"))


@query("j15_files", "with f as (select source, count(*) as bytes, md5(source) as sha256 from documents where source is not null group by source), g as (select * from f where substr(md5(source), 1, 1) <> '1') select f.source, g.bytes is not null as present, coalesce(f.bytes = g.bytes and f.sha256 = g.sha256, false) as matches, case when g.bytes is null then 'absent' end as problem from f left join g using (source)")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("bytes")).withColumn("sha256", F.md5("source"))
    return validate.file_status(f, f.where(F.substring(F.md5("source"), 1, 1) != "1"), "source")


@query("j19_exact_cover", f"with {ROLLOUTS} select category, count(*) as n from rollouts where condition = 'real' group by category")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = rollouts(spark, d)
    items = table(spark, d, "corpus_rows").select("qid").distinct()
    guards.full_coverage(items, r.where("condition = 'real'"), ["qid"])
    return r.where("condition = 'real'").join(items, "qid").groupBy("category").agg(F.count("*").alias("n"))


@query("j20_overlap", "select 'train_eval' as guard, count(*) as n from (select dataset, item_id from decontamination where split = 'train' intersect select dataset, item_id from decontamination where split <> 'train')")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "decontamination").select("split", "dataset", "item_id")
    both = streams.overlap(r.where("split = 'train'"), r.where("split <> 'train'"), ["dataset", "item_id"])
    return both.agg(F.count("*").alias("n")).select(F.lit("train_eval").alias("guard"), "n")


@query("j22_siblings", "select c.qid, coalesce(c.category, s.category) as category from (select qid, source, question, category from corpus_rows where question is not null) c left join (select question, min(category) as category from corpus_rows where category is not null and question is not null group by question) s using (question)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus_rows").where("question is not null").select("qid", "question", "category")
    s = c.where("category is not null").groupBy("question").agg(F.min("category").alias("sibling"))
    return c.join(s, "question", "left").select("qid", F.coalesce("category", "sibling").alias("category"))


@query("j24_similar_label", f"with p as (select ordinal, unnest(scene_a).label as l from {SCENES} where scene_a is not null) select a.ordinal, a.l as label, arg_min(b.l, struct_pack(d := levenshtein(a.l, b.l), l := b.l)) as similar from p a join p b on a.ordinal = b.ordinal and a.l <> b.l group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).where("scene_a is not null").select("ordinal", F.transform("scene_a", lambda p: p["label"]).alias("ls")).withColumn("label", F.explode("ls"))
    others = F.filter("ls", lambda x: x != F.col("label"))
    near = F.array_min(F.transform(others, lambda x: F.struct(F.levenshtein(F.col("label"), x).alias("d"), x.alias("l"))))
    return rows.select("ordinal", "label", near["l"].alias("similar")).where("similar is not null").distinct()


@query("j25_member_table", f"select ordinal, 0 as label, x::double as n from (select ordinal, len(scene_a) as x from {SCENES}) union all select ordinal, 1, x::double from (select ordinal, len(scene_b) as x from {SCENES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return attack.member_table(table(spark, d, SCENES), "ordinal", {"n": (size("scene_a"), size("scene_b"))})


# ---- aggregates and windows


@query("a02_members", f"with {TRIALS} select run, seed, sum(correct_a::int + correct_b::int)::bigint as successes, (2 * count(*))::bigint as n, round(sum(correct_a::int + correct_b::int) / (2 * count(*)), 9) as ratio from trials group by run, seed")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.sum(F.col("correct_a").cast("int") + F.col("correct_b").cast("int"))
    return trials(spark, d).groupBy("run", "seed").agg(k.alias("successes"), (2 * F.count("*")).alias("n"), F.round(k / (2 * F.count("*")), 9).alias("ratio"))


@query("a03_pair_metrics", f"with s as (select layer, case when ordinal % 3 = 0 and answer_a <> answer_b then 1 else 0 end as wrong, (ordinal % 4 = 1)::int as bare, (answer_a <> answer_b)::int as two from {SCENES} where answer_a is not null and answer_b is not null) select layer, count(*) as n, round(avg(1 - wrong), 9) as pair_accuracy, round(avg(1 - wrong / 2), 9) as member_accuracy, round(avg((1 - bare) * (1 - wrong)), 9) as strict_pair_accuracy, round(avg((1 - bare) * (1 - wrong / 2)), 9) as strict_member_accuracy, round(avg(wrong), 9) as collapse_rate, round(avg(1 - bare), 9) as format_rate, round(avg(1 - bare), 9) as extractor_rate, round(avg(bare), 9) as fallback_rate from s group by layer")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A third of the pairs gets the second answer twice, a quarter answers without a tag."""
    scored = _scored_pairs(spark, d, False)
    rates = ["pair_accuracy", "member_accuracy", "strict_pair_accuracy", "strict_member_accuracy", "collapse_rate", "format_rate", "extractor_rate", "fallback_rate"]
    return compare.pair_rates(scored, ["layer"]).select("layer", "n", *rates)


def _scored_pairs(spark: SparkSession, d: str, full_text: bool) -> DataFrame:
    rows = table(spark, d, SCENES).where("answer_a is not null and answer_b is not null")
    first = F.when(F.col("ordinal") % 3 == 0, F.col("answer_b")).otherwise(F.col("answer_a"))
    said = lambda c: F.when(F.col("ordinal") % 4 == 1, F.lower(c)).otherwise(F.concat(F.lit("I see. <answer>"), F.lower(c), F.lit("</answer>")))
    return rows.select("layer", pair_score(said(first), said(F.col("answer_b")), F.col("answer_a"), F.col("answer_b"), full_text).alias("s")).select("layer", "s.*")


@query("a03_mentions")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The rates that need the tiers of whole responses and ambiguous answers, which SQL cannot decide."""
    return compare.pair_rates(_scored_pairs(spark, d, True), ["layer"]).select("layer", "n", "ambiguity_rate", "mentions_both_rate")


@query("a05_benchmark", f"with {RESPONSES}, u as (select split_part(record_id, ':', 1) as category, floor(('0x' || substr(md5('dress|' || record_id), 1, 13))::bigint::double / 4503599627370496.0 * 6)::int as u from responses where trim(gold) <> '') select category, count(*) as n, round(avg((u = 0)::int), 9) as acc_strict, round(avg((u < 5)::int), 9) as acc_final, round(avg((u = 0)::int), 9) as format_valid, round(avg((u <> 4)::int), 9) as extractor_valid, round(avg((u = 0)::int), 9) as contract_valid, 0.0::double as ambiguous_rate, round(avg((u = 4)::int), 9) as fallback_rate from u group by rollup(category)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a benchmark run, overall and per data set."""
    rows = responses(spark, d).where(F.trim("gold") != "").select(F.split_part("record_id", F.lit(":"), F.lit(1)).alias("category"), open_score(F.col("prediction"), F.col("gold")).alias("s"))
    return compare.benchmark_rates(rows.select("category", "s.*"), "category")


@query("a08_grouped", "select arm, list(ordinal order by ordinal)[1:3] as first_rows, count(*) as n from mixture_profiles group by arm")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.grouped_in_order(table(spark, d, "mixture_profiles"), ["arm"], "ordinal", "ordinal", 3)


@query("a17_a18_checks", f"select split, count(distinct mother_item_id) as mothers, bool_and(scene_a is not null) as all_shown, bool_or(answers_equal) as any_equal from {SCENES} group by split")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SCENES).groupBy("split").agg(F.count_distinct("mother_item_id").alias("mothers"), F.bool_and(F.col("scene_a").isNotNull()).alias("all_shown"), F.bool_or("answers_equal").alias("any_equal"))


@query("a19_replicates", "select arm, count(*) as n, sum((base_accuracy is null or isnan(base_accuracy))::int)::bigint as n_null, round(avg(case when not isnan(base_accuracy) then base_accuracy end), 9) as mean, round(stddev_samp(case when not isnan(base_accuracy) then base_accuracy end), 9) as sd from mixture_profiles group by arm")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(~F.isnan("base_accuracy"), F.col("base_accuracy"))
    rows = table(spark, d, "mixture_profiles").withColumn("v", v)
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.sum(F.col("v").isNull().cast("long")).alias("n_null"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v"), 9).alias("sd"))


@query("w01_position", "select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as place from documents where source is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source is not null").select("doc_id", "source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("place"))


@query("w07_cycled", f"with p as (select row_number() over (order by ordinal) - 1 as o, ordinal from {SCENES} where role = 'invariance' and split = 'training'), n as (select count(*) as n from p) select i as draw, p.ordinal from range(0, (select greatest(1000, 2 * count(*)) from p)) as t(i), n join p on p.o = i % n.n")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Twice the pool, and at least 1,000 draws."""
    pool = ordering.numbered(table(spark, d, SCENES).where("role = 'invariance' and split = 'training'").select("ordinal"), "ordinal", name="o")
    return corpus.cycled(pool, max(1000, 2 * pool.count()), "o").select("draw", "ordinal")


@query("w10_even_odd", "select pair, n, questions from (select ordinal // 2 as pair, count(*) as n, count(distinct problem) as questions from mixture_profiles group by 1) where questions > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.uneven_pairs(table(spark, d, "mixture_profiles"), "ordinal", "problem").withColumnRenamed("values", "questions")


@query("u04_failed", f"with {TRIALS} select run, item_id from trials group by run, item_id having not bool_or(pair_correct)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).groupBy("run", "item_id").agg(F.bool_or("pair_correct").alias("ok")).where(~F.col("ok")).select("run", "item_id")


@query("o01_sorted", "select qid, row_number() over (order by coalesce(source, '') desc, coalesce(category, '') desc, qid) as place from (select qid, max(source) as source, max(category) as category from corpus_rows group by qid)")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "corpus_rows").groupBy("qid").agg(F.max("source").alias("source"), F.max("category").alias("category"))
    placed = ordering.numbered(g, F.coalesce("source", F.lit("")).desc(), F.coalesce("category", F.lit("")).desc(), "qid", name="place")
    return placed.select("qid", (F.col("place") + 1).alias("place"))


@query("f08_forbidden", "select column_name as name from (describe select * from documents) where column_name in ('title', 'run', 'answer')")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = guards.forbidden_columns(table(spark, d, "documents"), ["Title", "run", "answer"])
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("v05_shards", f"with i as (select source as shard, min(md5(source)) as lo from documents where source is not null and revision <= 2 group by source), f as (select source as shard, case when min(doc_id) % 5 = 0 then 'x' else md5(source) end as found from documents where source is not null and revision >= 1 group by source) select coalesce(i.shard, f.shard) as shard, case when f.shard is null then 'missing' when i.shard is null then 'not indexed' when lo <> found then 'digest differs' else 'ok' end as status from i full join f using (shard)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of sources stand for shards: those of early revisions are indexed, those of later ones are there, some altered."""
    rows = table(spark, d, "documents").where("source is not null").select("doc_id", F.col("source").alias("shard"), "revision")
    there = rows.where("revision >= 1").groupBy("shard").agg(F.min("doc_id").alias("id")).select("shard", F.when(F.col("id") % 5 == 0, "x").otherwise(F.md5("shard")).alias("sha256"))
    return validate.shard_status(rows.where("revision <= 2").select("shard", F.md5("shard").alias("sha256")), there)


@query("m05_reasons", f"select ordinal, case when ordinal % 5 = 0 then case when ordinal % 3 = 0 then 4 else 3 end when ordinal % 3 = 0 and ordinal % 2 <> 0 then 1 when ordinal % 2 = 0 and ordinal % 3 <> 0 then 2 else 0 end as reason from {SCENES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ordinal")
    return table(spark, d, SCENES).select("ordinal", disagreement(o % 2 == 0, o % 5 == 0, o % 3 == 0).alias("reason"))


@query("x18_geometry_kinds", "select kind, count(*) as n from (select case when regexp_full_match(v, '[+-]?\\d+') then 'integer' when regexp_full_match(v, '[+-]?(\\d+\\.\\d*|\\.\\d+)') then 'decimal' when regexp_full_match(v, '[+-]?\\d+\\s*/\\s*\\d+') or contains(v, '\\frac') then 'fraction' when regexp_matches(v, '[A-Za-z\\\\]') then 'expression_or_text' else 'other' end as kind from (select trim(replace(regexp_replace(answer, '[,$°]', '', 'g'), '^\\circ', '')) as v from decontamination where answer is not null)) group by kind")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decontamination").where("answer is not null")
    return rows.groupBy(measures.geometry_answer_kind(F.col("answer")).alias("kind")).agg(F.count("*").alias("n"))


@query("x20_bands", "select band, sampled, count(*) as n from (select case when p = 0 then 'p=0' when p < 0.25 then '0<p<0.25' when p < 0.75 then '0.25<=p<0.75' when p < 1 then '0.75<=p<1' else 'p=1' end as band, case when p = 0 then '0' when p < 0.2 then '(0,.2)' when p <= 0.8 then '[.2,.8]' when p < 1 then '(.8,1)' else '1' end as sampled from (select base_accuracy as p from mixture_profiles where base_accuracy is not null and not isnan(base_accuracy))) group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mixture_profiles").where("base_accuracy is not null and not isnan(base_accuracy)")
    p = F.col("base_accuracy")
    return rows.groupBy(measures.difficulty_band(p).alias("band"), measures.sample_band(p).alias("sampled")).agg(F.count("*").alias("n"))


# ---- formulas


@query("m04_sampling", f"with {ROLLOUTS}, c as (select qid, condition, {_P.format('bits')} as c from rollouts), p as (select *, (c + 0.5) / 17 as p from c) select qid, condition, 16 as sample_count, c::int as sample_correct_count, c / 16 as p_sample, round(p, 9) as p_i_jeffreys, round(1 - pow(p, 5) - pow(1 - p, 5), 9) as q_i, round(case when 16 - c < 5 then 1.0 else 1 - (16 - c) / 16 * (15 - c) / 15 * (14 - c) / 14 * (13 - c) / 13 * (12 - c) / 12 end, 9) as pass_at_g, (c > 0)::int::double as pass_at_all, round(p * (1 - p), 9) as variance_proxy from p")
def _(spark: SparkSession, d: str) -> DataFrame:
    rates = streams.pilot_rates(F.col("bits"))
    return rollouts(spark, d).select("qid", "condition", *[(F.round(c, 9) if n in ("p_i_jeffreys", "q_i", "pass_at_g", "variance_proxy") else c).alias(n) for n, c in rates.items()])


@query("m06_close", "select l_orderkey, l_linenumber, abs(l_discount - l_tax) <= greatest(1e-4 * greatest(abs(l_discount), abs(l_tax)), 1e-4) as near from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", close(F.col("l_discount"), F.col("l_tax")).alias("near"))


@query("m08_item_null", "select record_id, case when gold in ('A', 'B', 'C', 'D') then 0.25 else 0.0 end::double as chance from (select record_id, max(answer) as gold from decontamination where record_id is not null group by record_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "decontamination").where("record_id is not null").groupBy("record_id").agg(F.max("answer").alias("gold"))
    missing = F.size(F.array_except(F.array("gold"), F.array(*[F.lit(x) for x in "ABCD"]))) > 0
    return g.select("record_id", F.when(missing, F.lit(0.0)).otherwise(measures.chance_level(F.lit(4))).alias("chance"))


@query("m10_digests", "select doc_id, sha256(coalesce(text, '')) as digest from documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


_WHOLE = f"(select ordinal, answer_a as a from {SCENES} where regexp_full_match(answer_a, '-?[0-9]+'))"


@query("x06_fractions", f"select ordinal, round([a::double / 4, case when a like '-%' then a::double / 4 else a::double / 4 end, a::double / 100, a::double * 1000, a::double, a::double * 10, null][ordinal % 7 + 1], 9) as value from {_WHOLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Quotients, TeX fractions, percentages, thousands, prices, powers of ten and words."""
    return _whole(spark, d).select("ordinal", F.round(numeric_value(_form(["@/4", "\\frac{@}{4}", "@%", "@,000", "$@", "@e1", "@/0"])), 9).alias("value"))


@query("x17_options", "select qid, list_filter(string_split(question, ' '), lambda x: regexp_full_match(x, '[A-D][.]')) as labels from (select distinct qid, question from corpus_rows where question is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_rows").where("question is not null").select("qid", "question").distinct()
    return rows.select("qid", F.filter(F.split("question", " "), lambda x: x.rlike(r"\A[A-D][.]\z")).alias("labels"))


@query("x21_python_list", "select qid, image_paths as parsed from (select distinct qid, image_paths from corpus_rows where image_paths is not null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lists written as Python literals, in single and double quotes, and read again."""
    rows = table(spark, d, "corpus_rows").where("image_paths is not null").select("qid", "image_paths").distinct()
    quote = F.when(F.crc32("qid") % 2 == 0, "'").otherwise('"')
    body = F.array_join(F.transform("image_paths", lambda x: F.concat(quote, F.coalesce(x, F.lit("")), quote)), ", ")
    return rows.select("qid", text.python_list(F.concat(F.lit("["), body, F.lit("]"))).alias("parsed"))


@query("x24_opaque", f"select ordinal, regexp_full_match(substr(sha256(pair_id), 1, 16), '[0-9a-f]{{16}}') as opaque, regexp_full_match(image_a_path, '[0-9a-f]{{16}}\\.png') as opaque_path from {SCENES} where pair_id is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).where("pair_id is not null")
    return rows.select("ordinal", text.is_opaque_id(F.substring(F.sha2("pair_id", 256), 1, 16)).alias("opaque"), text.is_opaque_path(F.col("image_a_path")).alias("opaque_path"))


@query("m16_m17_budget", "select * from (values ('1/3 of 240', 80::bigint), ('0.25 of 240', 60), ('first of 10 in 3', 4), ('last of 10 in 3', 3)) as t(name, n)")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = measures.balanced_budget(10, 3)
    rows = [("1/3 of 240", measures.exact_count("1/3", 240)), ("0.25 of 240", measures.exact_count("0.25", 240)), ("first of 10 in 3", parts[0]), ("last of 10 in 3", parts[-1])]
    return spark.createDataFrame(rows, "name string, n long")


# ---- corpora and validation


@query("d03_sample_stats", "select source, count(*) as n, count(distinct category) as n_distinct, sum(coalesce(len(image_paths), 0))::bigint as n_elements from corpus_rows group by source")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.sample_statistics(table(spark, d, "corpus_rows"), "source", "category", "image_paths")


@query("d10_resume", "select count(*) // 3 as n from mixture_profiles")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A third of the table is done; the operator compares it row by row with the source."""
    source = ordering.numbered(table(spark, d, "mixture_profiles").select(F.col("ordinal").alias("at"), "pair_group_uid"), "at").drop("at")
    done = source.where(F.col("ordinal") < source.count() // 3)
    return spark.createDataFrame([(corpus.resume_prefix(source, done, ["pair_group_uid"]),)], "n long")


@query("d12_attack_set", f"select ordinal, md5(pair_id) < '8' as swapped, case when md5(pair_id) < '8' then answer_b else answer_a end as first_answer, case when md5(pair_id) < '8' then answer_a else answer_b end as second_answer from {SCENES} where role <> 'invariance' and pair_id is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return streams.attack_members(table(spark, d, SCENES).where("role <> 'invariance'"), "pair_id", "answer_a", "answer_b", ["ordinal"])


_TELLING = "['side', 'answer', 'template', 'left', 'right']"
_WORDS = f"list_filter(flatten((select list(distinct string_split_regex(lower(coalesce(template_id, '')), '[^a-z0-9]+')) from {SCENES} where pair_id is not null)), lambda w: len(w) >= 4 and not regexp_full_match(w, 'v\\d+'))"
_RELEASE = f"""one as (select pair_id as name, arg_min(struct_pack(a := image_a_path, b := image_b_path, c := changed_region_mask_a, d := changed_region_mask_b), ordinal) as x from {SCENES} where pair_id is not null group by pair_id),
  told as materialized (select list_concat({_WORDS}, {_TELLING}) as telling),
  m as (select substr(sha256('r' || chr(0) || name), 1, 16) as pair_id, unnest([struct_pack(side := 'a', image := coalesce(x.a, ''), mask := coalesce(x.c, '')), struct_pack(side := 'b', image := coalesce(x.b, ''), mask := coalesce(x.d, ''))]) as y from one),
  p as (select pair_id, unnest([struct_pack(folder := 'images', path := y.image), struct_pack(folder := 'masks', path := y.mask)]) as z from m),
  q as (select *, z.path as path, list_filter(string_split(z.path, '/'), lambda s: s not in ('', '.')) as parts from p)"""


def _release(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A release of the scene pairs under opaque ids with the paths of the table, and its key."""
    paths = ["image_a_path", "image_b_path", "changed_region_mask_a", "changed_region_mask_b", "answer_a", "answer_b", "template_id"]
    one = table(spark, d, SCENES).where("pair_id is not null").groupBy("pair_id").agg(F.min_by(F.struct(*paths), "ordinal").alias("x")).select("pair_id", "x.*")
    member = lambda s: measures.opaque_id("m", F.col("pair_id"), F.lit(s))
    pair = measures.opaque_id("r", F.col("pair_id")).alias("pair_id")
    manifest = one.select(pair, F.array(*[F.struct(member(s).alias("member_id"), F.col(f"image_{s}_path").alias("image_path"), F.col(f"changed_region_mask_{s}").alias("mask_path")) for s in "ab"]).alias("members"))
    keys = one.select(pair, "template_id", F.array(*[F.struct(member(s).alias("member_id"), F.lit(s).alias("source_side"), F.col(f"answer_{s}").alias("answer")) for s in "ab"]).alias("members"))
    return manifest, keys


@query(
    "v01_release",
    f"with {_RELEASE}, codes as (select case when path like '/%' or list_contains(parts, '..') then ['unsafe_path'] else list_filter([case when len(parts) <> 2 or parts[1] <> z.folder then 'nonuniform_path' end, case when not regexp_full_match(coalesce(parts[len(parts)], ''), '[0-9a-f]{{16}}\\.png') then 'nonopaque_filename' end, case when list_has_any(string_split_regex(lower(path), '[^a-z0-9]+'), telling) then 'leaky_path' end], lambda c: c is not null) end as c from q, told), n as (select count(*) as n from one) select code, count(*) as n from (select unnest(c) as code from codes union all select 'member_order_not_randomized' from n where n >= 4) group by code",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """All codes but that of answers that match, which SQL cannot decide (v01_answers has it)."""
    return release.lint(*_release(spark, d)).where("code <> 'answers_cross_match'").groupBy("code").agg(F.count("*").alias("n"))


@query("v01_answers")
def _(spark: SparkSession, d: str) -> DataFrame:
    return release.lint(*_release(spark, d)).where("code = 'answers_cross_match'").select("code", "pair_id")


@query("v02_status", f"with hits as (select case when layer not in ('l1', 'l2', 'l3', 'probe') then 'bad_layer' end as a, case when not regexp_full_match(image_a_sha256, '[0-9a-f]{{64}}') then 'bad_digest_a' end as b, case when question is null or trim(question) = '' then 'no_question' end as c, case when scene_a is null or scene_b is null then 'no_scene' end as e, case when image_a_sha256 = image_b_sha256 then 'same_images' end as f from {SCENES}), counted as (select code, count(*) as n from (select unnest([a, b, c, e, f]) as code from hits) where code is not null group by code) select t.code, coalesce(n, 0)::bigint as n, n is null as passed from (values ('bad_layer'), ('bad_digest_a'), ('no_question'), ('no_scene'), ('same_images')) as t(code) left join counted using (code)")
def _(spark: SparkSession, d: str) -> DataFrame:
    codes = ["bad_layer", "bad_digest_a", "no_question", "no_scene", "same_images"]
    return validate.battery_status(validate.scene_violations(table(spark, d, SCENES)).where(F.col("code").isin(codes)), codes)


@query("v06_artifact", f"select ordinal, round(greatest(0, least(1, abs(x - 0.5) / 0.5)), 9) as score, x <= 0.55 and x + 0.05 <= 0.62 as passes from (select ordinal, (ordinal % 101) / 100 as x from {SCENES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Areas over the whole of [0, 1], one a scene row, with an upper bound 0.05 above."""
    rows = table(spark, d, SCENES).select("ordinal", (F.col("ordinal") % 101 / 100).alias("x"))
    return rows.select("ordinal", F.round(validate.artifact_score(F.col("x")), 9).alias("score"), validate.gate(F.col("x"), F.col("x") + 0.05).alias("passes"))


@query("r26_univariate", f"with m as (select 0 as y, len(question)::double as q, list_sum(list_transform(scene_a, lambda p: p.x))::double as sx from {SCENES} where scene_a is not null and question is not null union all select 1, len(question), list_sum(list_transform(scene_b, lambda p: p.x)) from {SCENES} where scene_b is not null and question is not null), u as (select 'q' as feature, y, q as v from m union all select 'sx', y, sx from m), r as (select feature, y, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2 as r from u) select feature, sum(y)::bigint as n_pos, sum(1 - y)::bigint as n_neg, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 9) as auc from r group by feature")
def _(spark: SparkSession, d: str) -> DataFrame:
    return attack.feature_auc(_attack_table(spark, d), ["q", "sx"])


def _attack_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).where("scene_a is not null and scene_b is not null and question is not null")
    total = lambda c, ax: F.aggregate(c, F.lit(0), lambda a, p: a + p[ax])
    return attack.member_table(rows.select(F.col("ordinal").cast("string").alias("key"), "cell", "question", "scene_a", "scene_b"), "key", {"q": (F.length("question"), F.length("question")), "sx": (total("scene_a", "x"), total("scene_b", "x")), "sy": (total("scene_a", "y"), total("scene_b", "y"))})


# ---- Python streams: no SQL


@query("r24_discriminant")
def _(spark: SparkSession, d: str) -> DataFrame:
    return attack.discriminant(_attack_table(spark, d), "key", ["sx", "sy"], draws=1_000)


def _vector_query(name: str, schema: str, run):
    """A statistic of one ordered vector per run, drawn in one task a run."""

    @query(name)
    def _(spark: SparkSession, d: str) -> DataFrame:
        lean = trials(spark, d).where("seed = 0").select("run", "ordinal", F.col("correct_a").cast("double").alias("x"), F.col("correct_b").cast("double").alias("y"), "item_id")

        def cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"run": key[0], **run(pdf.sort_values("ordinal", kind="stable"))}])

        return lean.groupBy("run").applyInPandas(cell, "run string, " + schema)


def _overlap(pdf: pd.DataFrame) -> dict:
    universe = sorted(set(pdf["item_id"]))
    place = {v: i for i, v in enumerate(universe)}
    a, b = ({place[v] for v in pdf.loc[pdf[c] == 0, "item_id"]} for c in ("x", "y"))
    return resampling.overlap_null(a, b, universe, 10_000, 1)


_vector_query("r02_r03_mean", "low double, high double", lambda p: dict(zip(("low", "high"), resampling.interval(resampling.bootstrap_means(p["x"].to_numpy(), 2_000, 20260710, 200)), strict=True)))
_vector_query("r04_truncated", "low double, high double", lambda p: dict(zip(("low", "high"), resampling.truncated_interval(p["x"].tolist(), 2_000, 0), strict=True)))
_vector_query("r05_difference", "n long, estimate double, ci_low double, ci_high double, se double", lambda p: resampling.mean_interval((p["y"] - p["x"]).to_numpy(), 2_000, 3))
_vector_query("r06_ratio", "n long, estimate double, ci_low double, ci_high double, kept long", lambda p: resampling.ratio_interval(p["x"].to_numpy(), p["y"].to_numpy(), 20_000, 3))
_vector_query("r11_r12_exact", "low double, high double", lambda p: dict(zip(("low", "high"), resampling.clopper_pearson(int(p["x"].sum()), len(p)), strict=True)))
_vector_query("r14_side_swap", "n long, observed double, null_mean double, p_value double", lambda p: resampling.side_swap_null(p["x"].to_numpy(), p["y"].to_numpy(), 1_000, 0))
_vector_query("r16_overlap_null", "n long, observed double, null_mean double, p_value double", _overlap)
_vector_query("r20_hurdle", "n long, estimate double, ci_low double, ci_high double", lambda p: resampling.hurdle(p["x"].to_numpy().astype(int), p["y"].to_numpy(), 5_000, 0))


_DOSES = {"dose_zero": 0.0, "dose_third": 1 / 3, "dose_half": 1 / 2, "dose_twothirds": 2 / 3, "dose_full": 1.0}


@query("r22_slope")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of the held-out accuracy of five arms on the mass of their rows, raw and standardised over band and learnability.

    An arm's outcomes and a row's share of success that needs the image are made by fixed hashes.
    """
    b = F.col("base_accuracy")
    kept = table(spark, d, "mixture_profiles").where(b.isNotNull() & ~F.isnan(b) & F.col("arm").isin(list(_DOSES)) & F.col("pair_group_uid").isNotNull())
    stratum = ranking.decile_band(b) * 2 + ((b > 0) & (b < 1)).cast("int")
    rows = kept.select("arm", F.lpad(F.col("ordinal").cast("string"), 20, "0").alias("key"), F.when(F.col("pair_group_uid").startswith("virl:"), F.col("pair_group_uid")).alias("natural"), stratum.cast("int").alias("stratum"), (b * unit_hash(F.col("ordinal").cast("string"), "necessity")).alias("v"))
    items = table(spark, d, SCENES).where("split <> 'training'").select(item_key("pair_id").alias("key")).where("key is not null").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), (unit_hash(F.col("key"), f"slope|{a}") < 0.4 + 0.2 * f).cast("double").alias("v")) for a, f in _DOSES.items()]))
    outcomes = items.select("key", each.alias("x")).select("x.arm", "key", F.lit(None).cast("string").alias("natural"), F.lit(None).cast("int").alias("stratum"), "x.v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        held, trained = pdf[pdf["stratum"].isna()], pdf[pdf["stratum"].notna()]
        made = trained.loc[trained["natural"].isna()].groupby("key")["v"].first().mean()
        raw, strata = [], []
        for arm, dose in _DOSES.items():
            own = trained[trained["arm"] == arm]
            natural = own[own["natural"].notna()].drop_duplicates("natural")["v"].mean() if dose < 1 else 0.0
            raw.append(dose * made + (1 - dose) * natural)
            strata.append({int(k): g.to_numpy() for k, g in own.groupby("stratum")["v"]})
        y = np.stack([held.loc[held["arm"] == arm, "v"].to_numpy() for arm in _DOSES])
        found = resampling.slope_interval(y, np.array(raw), strata)
        return pd.DataFrame([{"kind": k, "n": y.shape[1], "slope": v[0], "ci_low": v[1], "ci_high": v[2]} for k, v in found.items()])

    return rows.unionByName(outcomes).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "kind string, n long, slope double, ci_low double, ci_high double")


@query("r29_stability")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rank stability of subsampled success rates: mean Spearman with the full rates per size, over the replicates."""
    r = rollouts(spark, d).where("condition = 'real' and qid is not null").withColumn("full", F.size(F.filter("bits", lambda x: x)) / 16)
    rates = resampling.rollout_stability(r, ["full"], "qid", "bits", "corpus", "real")
    rho = ranking.spearman(rates, "rate", "full", ["k", "replicate"])
    return rho.groupBy("k").agg(F.round(F.avg("rho"), 9).alias("mean_rho"), F.round(F.min("rho"), 9).alias("low_rho"), F.count("rho").alias("n"))


_vector_query("r07_retention", "n long, estimate double, ci_low double, ci_high double, kept long", lambda p: resampling.retention_interval(p["x"].to_numpy(), p["y"].to_numpy(), np.full(len(p), 0.125), 10_000, 1))
_vector_query("r08_retention_anew", "n long, estimate double, ci_low double, ci_high double, kept long", lambda p: resampling.retention_interval(p["x"].to_numpy(), p["y"].to_numpy(), 1 / (4 + np.arange(len(p)) % 5), 10_000, 1, fixed=False))


@query("r15_key_shuffle")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).where("answer_a is not null and answer_b is not null").select("ordinal", "layer", "cell", "answer_a", "answer_b")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", kind="stable")
        gold = list(zip(pdf["answer_a"], pdf["answer_b"], strict=True))
        said = [g if o % 3 else (g[1], g[0]) for g, o in zip(gold, pdf["ordinal"], strict=True)]
        return pd.DataFrame([{"layer": key[0], **resampling.key_shuffle_null(said, gold, pdf["cell"].tolist(), 1_000, 0)}])

    return rows.groupBy("layer").applyInPandas(run, "layer string, n long, observed double, null_mean double, p_value double")


@query("m09_two_roundings")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Values printed with three decimals after rounding to four, both on the binary value."""

    def printed(batches):
        for pdf in batches:
            yield pdf.assign(printed=[f"{float(f'{v:.4f}'):.3f}" for v in pdf["v"]])

    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 7).alias("v")).distinct().mapInPandas(printed, "v double, printed string")


@query("src07_audit_rows", f"with {ROLLOUTS} select qid, condition, {_P.format('bits')} / 16 as p_sample from rollouts")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = F.size(F.filter("bits", lambda x: x))
    rows = rollouts(spark, d).select("qid", "condition", F.col("bits").alias("sample_correct"), F.lit(16).alias("sample_count"), hits.alias("sample_correct_count"), (hits / 16).alias("p_sample"))
    return readers.audit_rows(rows).select("qid", "condition", "p_sample")


@query("m05_reward", f"with {RESPONSES}, u as (select record_id, floor(('0x' || substr(md5('dress|' || record_id), 1, 13))::bigint::double / 4503599627370496.0 * 6)::int as u from responses where trim(gold) <> '') select record_id, round((u < 5)::int * 0.9 + (u = 0)::int * 0.1, 9) as reward from u")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = open_score(F.col("prediction"), F.col("gold"))
    rows = responses(spark, d).where(F.trim("gold") != "").select("record_id", "prediction", s.alias("s"))
    return rows.select("record_id", F.round(reward(F.col("s.correct"), satisfies_contract(F.col("prediction"))), 9).alias("reward"))


_MOTHER = SQL_ITEM_KEY.format("mother_item_id")


@query(
    "d05_constructed",
    f"with s as (select *, {_MOTHER} as k from {SCENES} where mother_item_id is not null), a as (select k, arg_min(split, ordinal) as sp, arg_min(answer_a, ordinal) as x, arg_min(answer_b, ordinal) as y from s where layer = 'l3' group by k), b as (select k, arg_min(split, ordinal) as sp, arg_min(answer_a, ordinal) as x, arg_min(answer_b, ordinal) as y from s where layer = 'probe' group by k), j as (select a.k, a.x as m0, a.y as m1, b.x as m2, b.y as m3, row_number() over (order by md5(a.k), a.k) - 1 as place from a join b using (k) where a.sp = 'training' and b.sp = 'training' and k is not null) select (place * 4 + i)::bigint as ordinal, k as pair_group_uid, ['l3_a', 'l3_b', 'probe_a', 'probe_b'][i + 1] as pair_member, [m0, m1, m2, m3][i + 1] as answer from j, range(0, 4) as t(i)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, SCENES).withColumn("mother", item_key("mother_item_id"))
    return corpus.constructed_rows(s, "mother", F.md5("mother"))


@query("d11_packaged", f"select distinct substr(sha256('r' || chr(0) || 'id' || chr(0) || pair_id), 1, 16) as pair_id, case when sha256('r' || chr(0) || 'side' || chr(0) || pair_id) < '8' then 'a' else 'b' end as first_side, sha256('r' || chr(0) || 'place' || chr(0) || pair_id) as place_key, pair_id as source_pair_id from {SCENES} where pair_id is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpus.packaged(table(spark, d, SCENES), "pair_id", "r")


@query("v03_captions", f"with {_MEMBERS} select 'bad_digest' as code, count(*) as n from c where not regexp_full_match(image_sha256, '[0-9a-f]{{64}}')")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = validate.violations(_members(spark, d)[1], "image_sha256", captions.caption_rules())
    return found.where("code = 'bad_digest'").agg(F.count("*").alias("n")).select(F.lit("bad_digest").alias("code"), "n")


@query("v08_metadata", f"select ordinal, coalesce(provenance.generator is not null and provenance.batch_seed >= 0 and verifier_results.n_points > 0, false) as valid from {SCENES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    valid = streams.runtime_valid(F.col("provenance.generator"), F.col("provenance.batch_seed"), F.col("verifier_results.n_points"))
    return table(spark, d, SCENES).select("ordinal", valid.alias("valid"))


@query("x07_presentation", f"select ordinal, [a, a, a, a || ' degrees', '\\frac{{' || a || '}}{{2}}', 'a ' || a][ordinal % 6 + 1] as shown from {_WHOLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).select("ordinal", normalize_presentation(_form(["$ @ $", "\\( @ \\)", "$\\text{@}$", "@^\\circ", "\\frac {@} {2}", "a   @"])).alias("shown"))


@query("x10_x12_equal", f"select ordinal, [true, true, true, false, true][ordinal % 5 + 1] as equal, [true, false, true, false, true][ordinal % 5 + 1] as one_gold from {_WHOLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same value in other digits, with a unit, with a stop after a normal form, another value, a quotient."""
    said = _form(["@.0", "@ cm", "@.", "@7", "@/1"])
    rows = _whole(spark, d).withColumn("said", said)
    return rows.select("ordinal", answers_equal(F.col("a"), F.col("said")).alias("equal"), golds_equivalent(F.col("a"), F.col("said")).alias("one_gold"))


# ---- composite targets

_TARGET_SQL = {
    "table1": f"with {TRIALS} select run, round(avg(m), 9) as value, round(coalesce(stddev_samp(m), 0), 9) as sd, count(*) as n_seeds from (select run, seed, avg(pair_correct::int) as m from trials group by run, seed) group by run",
    "tableD2": f"with {TRIALS}, g as (select cell, avg(case when run = 'base' then pair_correct::int end) as b, avg(case when run = 'tuned' then pair_correct::int end) as t from trials group by cell) select cell, round(b, 9) as base, round(t, 9) as tuned, round(round(t, 9) / nullif(round(b, 9), 0), 9) as value from g",
    "tableA1": f"with {ROLLOUTS}, {_RB}, g as (select category, avg(real / 16) as r, avg(blind / 16) as b from rb group by category) select category, round(r, 9) as real, round(b, 9) as blind, case when abs(r - 1/16) >= 1e-12 then round((b - 1/16) / (r - 1/16), 9) end as value from g",
    "appendixB": f"with {TRIALS}, e as (select run, cell, layer, avg((correct_a::int + correct_b::int) / 2) as m from trials group by all) select run, round(min(m), 9) as low, round(max(m), 9) as value, count(*) as n_cells from e group by run",
    "tableG3": f"with {TRIALS}, {_PAIRED} select cell, count(*) as n, round(avg(base::int), 9) as base, round(avg(tuned::int), 9) as tuned, round(avg(tuned::int - base::int), 9) as value from j group by cell",
    "tableE2": f"with {TRIALS}, last as (from {_LAST}), g as (select run, item_id, count(distinct seed) as k from last where not pair_correct group by all) select run, count(*) as \"either\", sum((k = 2)::int)::bigint as \"both\", round(sum((k = 2)::int) / count(*), 9) as value from g group by run",
    "appendixE": f"with {TRIALS}, {_PAIRED} select role, sum((not base and tuned)::int)::bigint as gained, sum((base and not tuned)::int)::bigint as lost, sum(tuned::int - base::int)::bigint as value from j group by role",
    "tableH1": f"with {ROLLOUTS} select category, least(floor({_P.format('bits')} / 16 * 10), 9)::bigint as band, count(*) as value from rollouts where condition = 'real' group by all",
    "figure3a": f"with {ROLLOUTS}, {_RB}, l as (select round_even(real / 16 / 0.25, 0) * 0.25 as real, round_even(blind / 16 / 0.25, 0) * 0.25 as blind, count(*) as n from rb group by all) select real, blind, n, round(n / (select sum(n) from l), 9) as value from l",
    "section5": f"with {ROLLOUTS}, {_RB} select category, count(*) as n, sum((real > 0 and real < 16)::int)::bigint as learnable, sum((real > blind)::int)::bigint as value from rb group by category",
    "tableB2": f"with {TRIALS}, {_PAIRED}, g as (select layer, count(*) as n, avg(mt - mb) as m from j group by layer) select layer, n, round(m, 9) as mean, round(m * n / (select sum(m * n) from g), 9) as value from g",
    "tableC1": f"with {TRIALS}, e as (select run, layer, round(avg(pair_correct::int), 9) as m from trials group by all) select run, arg_min(layer, struct_pack(a := -m, b := layer)) as layer, max(m) as value from e group by run",
}

_W = f"({compare.Z95} * {compare.Z95})"
_TARGET_SQL |= {
    "tableE1": f"with {TRIALS}, last as (from {_LAST}), s as (select item_id, seed + case when run = 'tuned' then 2 else 0 end as step, pair_correct::int as v from last) select a.step, count(*) as n, round(avg(a.v), 9) as mean, round(avg(a.v - b.v), 9) as change from s a join s b on a.item_id = b.item_id and b.step = 0 where a.step <> 0 group by a.step",
    "tableG1": f"with {TRIALS}, g as (select run, sum(correct_a::int + correct_b::int)::bigint as k, (2 * count(*))::bigint as n from trials group by run) select run, k, n, round(k / n, 9) as value, round(greatest(0, (k/n + {_W}/(2*n)) / (1 + {_W}/n) - {compare.Z95} * sqrt((k/n)*(1-k/n)/n + {_W}/(4*n*n)) / (1 + {_W}/n)), 9) as ci_low, round(least(1, (k/n + {_W}/(2*n)) / (1 + {_W}/n) + {compare.Z95} * sqrt((k/n)*(1-k/n)/n + {_W}/(4*n*n)) / (1 + {_W}/n)), 9) as ci_high from g",
    "figure5": f"with {ROLLOUTS}, {_RB}, r as (select qid, blind as hits, (blind + 0.5) / 17 as q, (real - blind) / 16 as gain from rb), p as (select *, (hits > 0)::int as above, row_number() over (partition by (hits > 0)::int order by q, qid) as i, count(*) over (partition by (hits > 0)::int) as m from r) select case when above = 0 then 0 else ceil(10 * i / m)::int end as decile, count(*) as n, round(min(q), 9) as q_min, round(max(q), 9) as q_max, round(avg(gain), 9) as value from p group by 1",
}
_TARGET_SQL |= {
    "figure2a": f"with {TRIALS}, e as (select run, layer, avg(pair_correct::int) as m from trials group by all) select run, round(avg(pair_correct::int), 9) as value, round(avg((correct_a <> correct_b)::int), 9) as one_right, (select round(max(m), 9) from e where e.run = t.run) as best from trials t group by run",
    "tableA2": f"with {TRIALS}, last as (from {_LAST}), j as (select b.layer, b.pair_correct::int as b, t.pair_correct::int as t, 1 / substr(b.cell, 2)::double as c from last b join last t on b.item_id = t.item_id and b.run = 'base' and t.run = 'tuned' and b.seed = 0 and t.seed = 0), g as (select layer, count(*) as n, avg(b) as b, avg(t) as t, avg(c) as c from j group by layer) select layer, n, round(c, 9) as chance, case when abs(b - c) >= 1e-12 then round((t - c) / (b - c), 9) end as value from g",
    "tableB3": f"with {TRIALS} select run, cell, layer, count(*) as n, round(avg((correct_a::int + correct_b::int) / 2), 9) as value from trials group by all",
    "tableG4": f"with {TRIALS}, last as (from {_LAST}), j as (select b.seed, b.pair_correct::int as b, t.pair_correct::int as t from last b join last t on b.item_id = t.item_id and b.seed = t.seed and b.run = 'base' and t.run = 'tuned') select seed, count(*) as n, round(avg(b), 9) as base, round(avg(t), 9) as tuned, round(avg(t - b), 9) as value from j group by seed",
    "figure2b": f"with {TRIALS}, last as (from {_LAST}), g as (select seed + case when run = 'tuned' then 2 else 0 end as step, sum(pair_correct::int)::bigint as k, count(*) as n from last group by 1) select step, n, round(k / n, 9) as value, round(greatest(0, (k/n + {_W}/(2*n)) / (1 + {_W}/n) - {compare.Z95} * sqrt((k/n)*(1-k/n)/n + {_W}/(4*n*n)) / (1 + {_W}/n)), 9) as ci_low, round(least(1, (k/n + {_W}/(2*n)) / (1 + {_W}/n) + {compare.Z95} * sqrt((k/n)*(1-k/n)/n + {_W}/(4*n*n)) / (1 + {_W}/n)), 9) as ci_high from g",
    "figure2c": f"with {TRIALS}, last as (from {_LAST}), h as (select item_id, max((run = 'base' and seed = 0)::int) as base0, max((run = 'tuned' and seed = 0)::int) as tuned0, max((run = 'tuned' and seed = 1)::int) as tuned1 from last where pair_correct and not (run = 'base' and seed = 1) group by item_id) select base0, tuned0, tuned1, count(*) as value from h group by all",
    "tableH2": f"with {ROLLOUTS}, {_RB}, j as (select category, real / 16 as m, least(floor(blind / 16 * 10), 9)::bigint as band from rb), w as (select band, count(*) as w from j group by band), c as (select category, band, avg(m) as m from j group by all) select category, count(*) as n_bands, round(sum(m * w) / sum(w), 9) as value from c join w using (band) group by category",
    "tableH3": f"with {ROLLOUTS}, {_RB}, j as (select category, blind / 16 as q, (real - blind) / 16 as gain from rb) select category, count(*) as n, case when var_pop(q) > 1e-15 then round(covar_pop(q, gain) / var_pop(q), 9) end as value from j group by category",
    "figure4": f"with {TRIALS}, {_PAIRED} select 'a' as panel, run as name, round(sum(correct_a::int + correct_b::int) / (2 * count(*)), 9) as value from trials group by run union all select 'b', cell, round(avg(tuned::int - base::int), 9) from j group by cell union all select 'c', layer, round(avg((not base and tuned)::int), 9) from j group by layer",
}


def _target_query(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return targets.run(name, trials(spark, d), rollouts(spark, d))

    QUERIES[f"target_{name}"] = run
    if name in _TARGET_SQL:
        SQL[f"target_{name}"] = _TARGET_SQL[name]


for _name in sorted(targets.TARGETS):
    _target_query(_name)


@query("v07_compared", f"with {TRIALS}, t as (select run, round(avg(m), 9) as value from (select run, seed, avg(pair_correct::int) as m from trials group by run, seed) group by run), p(run, printed, relation) as (values ('base', 0.999, 'eq'), ('tuned', 0.999, 'lt')), o as (select case when (relation = 'eq' and abs(value - printed) <= 5e-4) or (relation = 'lt' and value < printed) then 'matched' else 'mismatch' end as outcome from t join p using (run)) select outcome, count(*) as n from o group by outcome")
def _(spark: SparkSession, d: str) -> DataFrame:
    printed = spark.createDataFrame([("base", 0.999, "eq", None), ("tuned", 0.999, "lt", None)], "run string, paper_value double, relation string, tolerance double")
    return targets.summary(targets.run("table1", trials(spark, d), rollouts(spark, d), printed, ["run"]))


@query("decon_benchmark_report", "select split, count(*) as n, count(distinct item_id) as items, sum((image_applicable)::int)::bigint as with_image from decontamination group by split")
def _(spark: SparkSession, d: str) -> DataFrame:
    keyed = contamination.record_keys(table(spark, d, "decontamination"))
    return keyed.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"), F.sum(F.col("image_applicable").cast("long")).alias("with_image"))


@query("x06_plain", "select l_orderkey, l_linenumber, l_quantity::double as value from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", plain_number(F.col("l_quantity").cast("string")).alias("value"))


@query("m12_unit_hash", "select doc_id, (('0x' || substr(md5('u|' || doc_id::varchar), 1, 13))::bigint::double / 4503599627370496.0) as u from documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", unit_hash(F.col("doc_id").cast("string"), "u").alias("u"))
