"""Queries of problems 2, 3 and 4, on records, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.keys import SQL_DIGEST_KEY, SQL_ITEM_KEY, SQL_PAIR_MOTHER_KEY, SQL_UNIT_HASH, item_key, pair_mother_key
from sievewright.llm import grouped_split, split_overlap, stable_sample
from sievewright.session import table

SCENES = "scene_training_n8_l3_first"
#: Sampling rate of the queries.
RATE = 0.1


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    scenes = table(spark, d, SCENES).select(F.lit("scenes").alias("sampled"), "ordinal", "delivery", item_key("pair_id").alias("key"))
    stream = table(spark, d, "mixture_profiles").select(F.lit("stream").alias("sampled"), "ordinal", "delivery", item_key("pair_group_uid").alias("key"))
    return stable_sample.stable_sample(scenes.unionByName(stream), "key", RATE).drop("key")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample.sample_report(p2_sample(spark, d), ["sampled", "delivery"])


_P2 = f"""
  with rows as (
    select 'scenes' as sampled, ordinal, delivery, {SQL_ITEM_KEY.format("pair_id")} as sample_key from {SCENES}
    union all
    select 'stream', ordinal, delivery, {SQL_ITEM_KEY.format("pair_group_uid")} from mixture_profiles),
  hashed as (select *, {SQL_UNIT_HASH.format(f"'{stable_sample.SALT}|' || sample_key")} as sample_value from rows),
  kept as (select * from hashed where sample_value < {RATE})
"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.classes(table(spark, d, SCENES))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.overlaps(_classes(spark, d))
    return pairs.select(F.least("train_ordinal", "other_ordinal").alias("ordinal_1"), F.greatest("train_ordinal", "other_ordinal").alias("ordinal_2"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(_classes(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.class_links(_classes(spark, d))


_P3 = f"""
  with recursive named as (
    select ordinal, split, provenance.generator as source, 'm:' || {SQL_ITEM_KEY.format("mother_item_id")} as mother, 'm:' || {SQL_PAIR_MOTHER_KEY.format("pair_id")} as pair,
      {SQL_DIGEST_KEY.format("image_a_sha256")} as image_a, {SQL_DIGEST_KEY.format("image_b_sha256")} as image_b,
      list_sort(list_distinct([upper(trim(p.label)) || ',' || p.x || ',' || p.y for p in scene_a if p.label is not null and p.x is not null and p.y is not null])) as scene_a,
      list_sort(list_distinct([upper(trim(p.label)) || ',' || p.x || ',' || p.y for p in scene_b if p.label is not null and p.x is not null and p.y is not null])) as scene_b
    from {SCENES}),
  shown as (
    select *, case when len(scene_a) > 0 then 's:' || array_to_string(scene_a, ' ') end as shown_a, case when len(scene_b) > 0 then 's:' || array_to_string(scene_b, ' ') end as shown_b from named),
  rows_ as materialized (
    select ordinal, split, source, image_a, image_b, mother, pair, shown_a, shown_b, coalesce(mother, pair, shown_a, shown_b, 'd:' || image_a, 'd:' || image_b) as anchor from shown),
  scenes as materialized (
    select distinct shown_a as name, scene_a as points from shown where shown_a is not null union select shown_b, scene_b from shown where shown_b is not null),
  points as (select name, unnest(points) as t from scenes),
  weight as (select t, sqrt(1 + {split_overlap.TILT} * ln(1 + (select count(*) from scenes) / count(*)) / ln(1 + (select count(*) from scenes))) as raw from points group by t),
  vectors as materialized (select name, t, raw / sqrt(sum(raw * raw) over (partition by name)) as w from points join weight using (t)),
  near as materialized (
    select x.name as a, y.name as b from vectors x join vectors y on x.t = y.t and x.name < y.name group by x.name, y.name having sum(x.w * y.w) >= {split_overlap.AGREEMENT}),
  held as (
    select anchor, unnest([mother, pair, shown_a, shown_b]) as key from rows_),
  edge as materialized (
    select anchor as a, key as b from held where key <> anchor union select key, anchor from held where key <> anchor union select a, b from near union select b, a from near),
  reach as (select a as node, b as other from edge union select r.node, e.b from reach r join edge e on r.other = e.a),
  label as materialized (select node, least(node, min(other)) as low from reach group by node),
  first_class as materialized (
    select r.*, coalesce(l.low, r.anchor) as cls from rows_ r left join label l on r.anchor = l.node),
  sides as (
    select cls, image_a as image, (shown_a is not null)::int as n from first_class where image_a is not null union all select cls, image_b, (shown_b is not null)::int from first_class where image_b is not null),
  by_class as (select image, cls, sum(n) as n from sides group by all),
  real as (select image, min(cls) as first from by_class group by image having 2 * max(n) >= sum(n)),
  tie as materialized (
    select distinct first as a, cls as b from by_class join real using (image) where first <> cls union select cls, first from by_class join real using (image) where first <> cls),
  wide as (select a as node, b as other from tie union select r.node, e.b from wide r join tie e on r.other = e.a),
  last_label as (select node, least(node, min(other)) as low from wide group by node),
  classed as materialized (
    select f.ordinal, f.split, f.source, coalesce(l.low, f.cls) as class_name from first_class f left join last_label l on f.cls = l.node)
"""


def _tie_keys() -> list:
    return [item_key("mother_item_id"), pair_mother_key("pair_id")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SCENES).select("ordinal", *[k.alias(f"k{i}") for i, k in enumerate(_tie_keys())])
    grouped = grouped_split.tied_groups(rows, [F.col("k0"), F.col("k1")])
    return grouped_split.with_first(grouped).where("first_ordinal < ordinal").select("first_ordinal", "ordinal")


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.grouped_split(table(spark, d, SCENES), _tie_keys(), table(spark, d, "split_shares"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.split_report(p4_split(spark, d), table(spark, d, "split_shares"))


_P4 = f"""
  with recursive named as (
    select ordinal, {SQL_ITEM_KEY.format("mother_item_id")} as k0, {SQL_PAIR_MOTHER_KEY.format("pair_id")} as k1 from {SCENES}),
  edge as (
    select k0 as a, k1 as b from named where k0 <> k1 union select k1, k0 from named where k0 <> k1),
  reach as (select a as node, b as other from edge union select r.node, e.b from reach r join edge e on r.other = e.a),
  label as (select node, least(node, min(other)) as low from reach group by node),
  grouped as (
    select n.ordinal, coalesce(l.low, k0, k1) as group_key from named n left join label l on coalesce(n.k0, n.k1) = l.node),
  firsts as (
    select ordinal, group_key, case when group_key is null then ordinal else min(ordinal) over (partition by group_key) end as first_ordinal from grouped)
"""


def _sql_key(scheme: str, split: str, share: float) -> str:
    hashed = SQL_UNIT_HASH.format(f"'{grouped_split.SALT}|{scheme}|{split}|' || name")
    return f"(-ln(greatest({hashed}, 1e-300)) / {share})"


def _sql_split(scheme: str, shares: dict[str, float]) -> str:
    keys = {n: _sql_key(scheme, n, s) for n, s in shares.items()}
    least = f"least({', '.join(keys.values())})"
    cases = " ".join(f"when {k} = {least} then '{n}'" for n, k in sorted(keys.items()))
    return f"select ordinal, first_ordinal, '{scheme}' as scheme, case {cases} end as split from named_groups"


_P4_SPLIT = (
    _P4
    + ", named_groups as (select ordinal, first_ordinal, coalesce(group_key, '#' || ordinal) as name from firsts), assigned as ("
    + _sql_split("standard", {"train": 0.6, "validation": 0.2, "test": 0.2})
    + " union all "
    + _sql_split("lean", {"train": 0.9, "validation": 0.05, "test": 0.05})
    + ")"
)

QUERIES = {
    "p2_sample": p2_sample,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_split": p4_split,
    "p4_report": p4_report,
}

SQL = {
    "p2_sample": _P2 + "select sampled, ordinal, delivery, sample_key, sample_value from kept",
    "p2_report": _P2 + "select sampled, delivery, count(*) as n_rows, count(distinct sample_key) as n_keys from kept group by all",
    "p3_found": _P3
    + """select least(a.ordinal, b.ordinal) as ordinal_1, greatest(a.ordinal, b.ordinal) as ordinal_2
    from classed a join classed b on a.class_name = b.class_name and a.split = 'training' and b.split <> 'training'""",
    "p3_report": _P3
    + """, counted as (select class_name, split, source, count(*) as n from classed where class_name is not null and split is not null group by all)
    select b.split as other_split, b.source as other_source, a.source as train_source, sum(a.n * b.n)::bigint as n_pairs, sum(b.n)::bigint as n_other_rows, sum(a.n)::bigint as n_train_rows
    from counted a join counted b on a.class_name = b.class_name and a.split = 'training' and b.split <> 'training' group by all""",
    "p3_classes": _P3
    + """, sized as (select class_name, min(ordinal) as first_ordinal, count(*) filter (split = 'training') as n_train, count(*) filter (split <> 'training') as n_other from classed where class_name is not null group by all),
    linked as (select c.*, first_ordinal, coalesce(case when split = 'training' then n_other when split <> 'training' then n_train end, 0) as n_links from classed c left join sized s on c.class_name = s.class_name and n_train > 0 and n_other > 0)
    select ordinal, split, source, case when n_links > 0 then first_ordinal end as class_id, n_links from linked""",
    "p4_found": _P4 + "select first_ordinal, ordinal from firsts where first_ordinal < ordinal",
    "p4_split": _P4_SPLIT + "select * from assigned",
    "p4_report": _P4_SPLIT
    + """, counted as (select scheme, split, count(*) as n_rows, count(distinct first_ordinal) as n_groups from assigned group by all),
    total as (select scheme, sum(n_rows) as all_rows from counted group by all)
    select s.scheme, s.split, s.target_share, coalesce(c.n_rows, 0)::bigint as n_rows, coalesce(c.n_groups, 0)::bigint as n_groups, round(coalesce(c.n_rows, 0) / t.all_rows, 9) as share
    from split_shares s left join counted c using (scheme, split) left join total t using (scheme)""",
}
