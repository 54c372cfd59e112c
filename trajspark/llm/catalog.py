"""Queries of this subpackage and their checking SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import bpe, mixing, packing, percentiles, sentences, splits
from trajspark.plans.shared import cut
from trajspark.plans.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.wrong_percentiles(*(table(spark, folder, t) for t in ("frames", "stats", "modality")))


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.percentiles(*(table(spark, folder, t) for t in ("frames", "stats", "modality")))


def _sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return cut(mixing.robot_sources(table(spark, folder, "info"))), table(spark, folder, "mix_targets")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(*_sources(spark, folder)).where("not reachable").select("mix_id", "robot_type")


def p2_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(*_sources(spark, folder))


def p2_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_selection(*_sources(spark, folder), "dataset_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.broken_splits(table(spark, folder, "episodes"), table(spark, folder, "info"))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.episode_splits(table(spark, folder, "episodes"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each split really got, from stored assignments."""
    return splits.split_report(cut(p6_splits(spark, folder))).withColumn("share", F.round("share", 9))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


def _packs(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """The fixed handful of pack_limits."""
    return [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, folder, "pack_limits").where("pack_id is not null and capacity_tokens > 0").distinct().collect()]


def p9_pack(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut(bpe.lengths(table(spark, folder, "documents")))
    return packing.pack(sizes, [(p, [c]) for p, c in _packs(spark, folder)])


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_report(p9_pack(spark, folder))


def p9_joint(spark: SparkSession, folder: str) -> DataFrame:
    """All capacities permitted at once, each container downsized to its contents."""
    sizes = cut(bpe.lengths(table(spark, folder, "documents")))
    return packing.pack(sizes, [(0, [c for _, c in _packs(spark, folder)])])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p2_found, p2_mix, p2_selection, p6_found, p6_splits, p6_report, p8_ids, p9_pack, p9_report, p9_joint, p10_found)}

_ACTUAL = """
with f as (
 select dataset_id, episode_index e, frame_index f, any_value("observation.state") s, any_value(action) a
 from frames where dataset_id is not null and episode_index is not null and frame_index is not null group by all
), plain as (
 select dataset_id, 'stats' modality, 'observation.state' "key", -1 step, generate_subscripts(s, 1) - 1 dim, unnest(s)::double x from f
 union all
 select dataset_id, 'stats', 'action', -1, generate_subscripts(a, 1) - 1, unnest(a)::double from f
), asked as (
 select distinct t.dataset_id, t."key", t.step, t.dim, m."start" + t.dim si, n."start" + t.dim ai
 from stats t join modality m on m.dataset_id = t.dataset_id and m.modality = 'state' and m."key" = t."key"
 join modality n on n.dataset_id = t.dataset_id and n.modality = 'action' and n."key" = t."key"
 where t.modality = 'relative_stats'
), rel as (
 select q.dataset_id, 'relative_stats' modality, q."key", q.step, q.dim, g.a[q.ai + 1]::double - h.s[q.si + 1]::double x
 from asked q join f h on h.dataset_id = q.dataset_id join f g on g.dataset_id = h.dataset_id and g.e = h.e and g.f = h.f + q.step
), actual as (
 select dataset_id, modality, "key", step, dim, count(*) n, quantile_cont(x, 0.01) a01, quantile_cont(x, 0.99) a99
 from (select * from plain union all select * from rel) where isfinite(x) group by all
)
"""

_SUPPLY = """
with d as (
 select dataset_id, arg_max(lower(regexp_replace(robot_type, '[ -]', '_', 'g')), revision) filter (robot_type is not null and robot_type <> '') r,
  arg_max(total_frames, revision) filter (total_frames is not null and total_frames <> 0) f
 from info group by 1
), s as (select r, sum(f) f from d where r is not null and f > 0 group by 1),
w as (select distinct m.*, coalesce(s.f, 0) supply from mix_targets m left join s on s.r = lower(regexp_replace(robot_type, '[ -]', '_', 'g'))),
x as (select *, sum(supply) over (partition by mix_id) total from w)
"""

_LINKED = """
with recursive live as (select distinct dataset_id, episode_index, operator_id, session_id, object_set_id from episodes where deleted_at is null and dataset_id is not null and episode_index is not null),
ent as (
 select distinct dataset_id, episode_index, k || ':' || lower(trim(v)) v from (
  select dataset_id, episode_index, unnest(['operator_id', 'session_id', 'object_set_id']) k, unnest([operator_id, session_id, object_set_id]) v from live
 ) where v is not null and lower(trim(v)) not in ('', 'unknown')
), first_ as (select dataset_id, episode_index, min(v) v from ent group by all),
pairs as (select distinct f.v a, e.v b from first_ f join ent e using (dataset_id, episode_index) where f.v <> e.v),
arcs as (select a, b from pairs union select b, a from pairs),
reach(v, c) as (select distinct v, v from ent union select arcs.b, reach.c from reach join arcs on arcs.a = reach.v and reach.c < arcs.b),
comp as (select v, min(c) c from reach group by v),
rng as (select dataset_id, arg_max(splits.train, revision) filter (true) t, max(revision) from info group by 1),
cur as (select i.dataset_id, any_value(splits.train) t from info i join (select dataset_id, max(revision) revision from info group by 1) m on m.dataset_id = i.dataset_id and m.revision = i.revision group by 1),
parts as (select dataset_id, unnest(string_split(t, ',')) p from cur where t is not null),
bounds as (select dataset_id, try_cast(nullif(trim(string_split(p, ':')[1]), '') as bigint) lo, try_cast(nullif(trim(string_split(p, ':')[2]), '') as bigint) hi from parts),
sided as (
 select f.dataset_id, f.episode_index, c.c,
  case when (select count(*) from cur where cur.dataset_id = f.dataset_id and cur.t is not null) > 0 then exists (select 1 from bounds b where b.dataset_id = f.dataset_id and f.episode_index >= coalesce(lo, 0) and (hi is null or f.episode_index < hi)) end inside
 from first_ f join comp c on c.v = f.v
)
"""

_SPLITS = (
    _LINKED
    + """, named as (select distinct l.dataset_id, l.episode_index, coalesce(c.c, 'episode:' || l.dataset_id || ':' || l.episode_index) component
 from live l left join first_ f using (dataset_id, episode_index) left join comp c on c.v = f.v),
placed as (select *, ('0x' || substr(md5('0:' || component), 1, 13))::bigint / 4503599627370496.0::double as at_ from named),
splits as (select dataset_id, episode_index, component, case when at_ < 0.8 then 'train' when at_ < 0.9 then 'validation' else 'test' end split from placed)
"""
)

ORACLES = {
    "p6_splits": _SPLITS + "select dataset_id, episode_index, component, split from splits",
    "p6_report": _SPLITS + ", per as (select split, component, count(*) n from splits group by all) select split, sum(n)::bigint n_records, count(*) n_components, max(n) largest, round(sum(n) / (select count(*) from splits), 9) share from per group by 1",
    "p1_found": _ACTUAL
    + """select dataset_id, modality, "key", step, dim, b bound from (
 select s.dataset_id, s.modality, s."key", coalesce(s.step, -1) step, s.dim, unnest(['q01', 'q99']) b, unnest([s.q01, s.q99]) p, unnest([a01, a99]) a, a99 - a01 w
 from (select distinct * from stats) s join actual a on a.dataset_id = s.dataset_id and a.modality = s.modality and a."key" = s."key" and a.step = coalesce(s.step, -1) and a.dim = s.dim
) where p is not null and w > 0 and abs(p - a) > 0.05 * w""",
    "p2_found": _SUPPLY + "select mix_id, robot_type from x where max_repeats * supply < target_share * total",
    "p6_found": _LINKED + "select dataset_id, episode_index from sided where c in (select c from sided group by c having bool_or(inside) and bool_or(not inside))",
}
