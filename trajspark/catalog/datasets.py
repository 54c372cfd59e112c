"""Queries on data sets as wholes: merging and checking statistics, sampling, repair, conversion, sets."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions.text import hash_sql
from trajspark.operators import evaluation, maintenance, sampling, stats
from trajspark.plans.records import EPISODE, frame_records, live_episodes
from trajspark.plans.shared import cut
from trajspark.plans.sizes import small_side
from trajspark.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


E = """e as (select * from (select *, row_number() over (partition by dataset_id, episode_index order by received_at desc, "length" desc) rn from episodes where deleted_at is null) where rn = 1)"""
CURRENT = "i as (select dataset_id, any_value(lower(regexp_replace(robot_type, '[ -]', '_', 'g'))) robot, any_value(total_frames) total_frames, any_value(chunks_size) chunks_size, any_value(fps) fps, any_value(total_episodes) total_episodes from info join (select dataset_id, max(revision) revision from info where robot_type is not null and total_frames > 0 group by 1) using (dataset_id, revision) group by 1)"


def _episodes(spark: SparkSession, folder: str) -> DataFrame:
    return live_episodes(table(spark, folder, "episodes"))


def _info(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete record of each data set, its robot type in one spelling."""
    i = table(spark, folder, "info").where("robot_type is not null and total_frames > 0")
    i = i.groupBy("dataset_id").agg(F.max_by(F.struct("robot_type", "total_frames", "chunks_size", "fps", "total_episodes"), "revision").alias("i")).select("dataset_id", "i.*")
    return i.withColumn("robot", F.lower(F.regexp_replace("robot_type", "[ -]", "_"))).drop("robot_type")


# ---------------------------------------------------------------- statistics

_ROUNDED = "round(mean, 5) mean, round(std, 4) std, min, max, q01, q99"


@query(
    f"""with {CURRENT}, s as (select distinct * from stats), w as (select robot, modality, "key", coalesce(step, -1) step, dim, s.*, total_frames w from s join i using (dataset_id) where mean is not null),
m as (select robot, modality, "key", step, dim, sum(w * mean) / sum(w) mean, sum(w * (std * std + mean * mean)) / sum(w) sq, min(min) min, max(max) max, min(q01) q01, max(q99) q99 from (select robot, modality, "key", coalesce(step, -1) step, dim, mean, std, min, max, q01, q99, w from (select robot, s.*, total_frames w from s join i using (dataset_id)) where mean is not null) group by all)
select robot, modality, "key", step, dim, round(mean, 5) mean, round(sqrt(sq - mean * mean), 4) std, min, max, q01, q99 from m"""
)
def stats_merge_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Published statistics merged per robot type with the data sets' frames as weights (93)."""
    s = table(spark, folder, "stats").distinct().withColumn("step", F.coalesce("step", F.lit(-1))).join(small_side(_info(spark, folder)), "dataset_id")
    out = stats.merge_weighted(s, ["robot", "modality", "key", "step", "dim"], "total_frames")
    return out.withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 4))


@query(
    f"""with {CURRENT}, s as (select robot, s.* from (select distinct dataset_id, modality, "key", dim, mean from stats where step is null) s join i using (dataset_id)),
f as (select robot, min(dataset_id) d from s group by 1), k as (select distinct s.robot, modality, "key", dim from s join f on f.robot = s.robot and f.d = s.dataset_id)
select s.robot, s.modality, s."key", s.dim, count(*) n, round(avg(mean), 5) mean from s join k using (robot, modality, "key", dim) group by all"""
)
def stats_merge_first_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Merged over the keys that the first data set of a robot type has (94)."""
    s = table(spark, folder, "stats").where("step is null").select("dataset_id", "modality", "key", "dim", "mean").distinct().join(small_side(_info(spark, folder).select("dataset_id", "robot")), "dataset_id")
    kept = stats.of_first_source(s, ["robot"], "dataset_id", ["modality", "key", "dim"])
    return kept.groupBy("robot", "modality", "key", "dim").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 5).alias("mean"))


@query(
    """select dataset_id, modality, "key", coalesce(step, -1) step, dim, case when mean is null or std is null or min is null or max is null or q01 is null or q99 is null then 'missing'
 when not (isfinite(mean) and isfinite(std) and isfinite(min) and isfinite(max) and isfinite(q01) and isfinite(q99)) then 'not finite'
 when std < 0 or min > mean or mean > max or min > q01 or q01 > q99 or q99 > max then 'out of order' end reason from (select distinct * from stats) where reason is not null"""
)
def stats_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Published statistics that can't be right (68)."""
    return stats.problems(table(spark, folder, "stats").distinct()).select("dataset_id", "modality", "key", F.coalesce("step", F.lit(-1)).alias("step"), "dim", "reason")


@query(
    """with d as (select dataset_id, "key" k, max(dim) + 1 dims from stats where modality = 'stats' group by all)
select m.dataset_id, m.modality, m."key" as "group", m."end" as stop, dims from modality m left join d on d.dataset_id = m.dataset_id and d.k = coalesce(original_key, case modality when 'state' then 'observation.state' else 'action' end)
where modality in ('state', 'action') and m."end" is not null and (dims is null or m."end" > dims)"""
)
def stats_uncovered(spark: SparkSession, folder: str) -> DataFrame:
    """Named slices beyond the dimensions that have statistics (68, 69)."""
    return stats.uncovered(table(spark, folder, "stats"), table(spark, folder, "modality"))


@query(f"""with {CURRENT}, g as (select distinct dataset_id, modality, "key", "end" - "start" w from modality where modality in ('state', 'action')) select robot, modality, sum(case when modality = 'state' then 2 * w else w end)::bigint dims, count(distinct dataset_id) n from g join i using (dataset_id) group by all""")
def total_dims(spark: SparkSession, folder: str) -> DataFrame:
    """Dimensions after encoding, states doubled by sines and cosines (96i)."""
    g = table(spark, folder, "modality").where("modality in ('state', 'action')").select("dataset_id", "modality", "key", (F.col("end") - F.col("start")).alias("w")).distinct()
    g = g.join(small_side(_info(spark, folder).select("dataset_id", "robot")), "dataset_id")
    return g.groupBy("robot", "modality").agg(F.sum(F.when(F.col("modality") == "state", 2 * F.col("w")).otherwise(F.col("w"))).alias("dims"), F.count_distinct("dataset_id").alias("n"))


# ---------------------------------------------------------------- sampling

@query(
    f"""with {E}, s as (select dataset_id, episode_index, unnest(range(greatest(0, "length" - 7))) step from e),
h as (select *, row_number() over (partition by dataset_id, episode_index order by {hash_sql('step * 7919 + episode_index * 104729', 3)}, step) - 1 r from s)
select dataset_id, episode_index, r % 5 split, count(*) n, min(step) as first, sum(step)::bigint total from h group by all"""
)
def shuffled_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The valid steps of each episode in seeded order, dealt to five parts (56, 159, 160)."""
    from trajspark.operators.windows import usable

    lengths = _episodes(spark, folder).select(*EPISODE, usable(F.col("length"), list(range(8))).alias("n"), F.col("episode_index").alias("sequence"))
    steps = sampling.shuffled_steps(lengths, EPISODE, "n", 5, seed=3)
    return steps.groupBy(*EPISODE, "split").agg(F.count("*").alias("n"), F.min("step").alias("first"), F.sum("step").alias("total"))


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _episodes(spark, folder).select(*EPISODE, F.col("length"), F.col("episode_index").alias("sequence"))


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.assign_shards(_lengths(spark, folder), EPISODE, "length", 0.25, 1000, seed=5)


#: Parts in seeded order, each dealt to the least filled shard (ties: the lower) once every shard has one.
_SHARDS = f"""with recursive {E}, p as (
 select dataset_id, episode_index, unnest(range(least(4, "length"))) split, "length" l from e where "length" > 0
), q as (
 select dataset_id, episode_index, split, (l - split + 3) // 4 n, row_number() over (partition by dataset_id order by {hash_sql('episode_index', 5)}, episode_index, split) i,
  least(ceil(sum((l - split + 3) // 4) over (partition by dataset_id) / 1000.0), count(*) over (partition by dataset_id))::int k from p
), deal(dataset_id, i, s, loads) as (
 select dataset_id, i, 0::bigint, list_transform(range(k), lambda x: case when x = 0 then n::bigint else 0 end) from q where i = 1
 union all
 select dataset_id, i, s, list_transform(loads, lambda x, j: x + case when j = s + 1 then n::bigint else 0 end) from (
  select q.dataset_id, q.i, q.n, loads, case when q.i <= k then q.i - 1 else list_position(loads, list_min(loads)) - 1 end::bigint s
  from deal d join q on q.dataset_id = d.dataset_id and q.i = d.i + 1)
), dealt as (select q.dataset_id, q.episode_index, q.split, q.n, s shard from q join deal d on d.dataset_id = q.dataset_id and d.i = q.i)
"""


@query(_SHARDS + "select dataset_id, episode_index, split, n::bigint n_steps, shard from dealt")
def shard_assign(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every part of every episode (161, 162)."""
    return _shards(spark, folder)


@query(f"""with {CURRENT} select dataset_id, robot, round(total_frames / sum(total_frames) over (partition by robot) * (case robot when 'pivot7' then 2.0 else 1.0 end), 6) weight from i""")
def mixture_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of data sets by size within their robot type, times its ratio (163)."""
    i = _info(spark, folder).withColumn("ratio", F.when(F.col("robot") == "pivot7", 2.0).otherwise(1.0))
    return sampling.mixture_weights(i, "robot", "total_frames", "ratio").select("dataset_id", "robot", F.round("weight", 6).alias("weight"))


_SCHEDULE = f"""with {CURRENT}, w as (select dataset_id, ceil(total_frames / 1000.0)::bigint n, total_frames w from i),
c as (select *, sum(w) over (order by dataset_id) / sum(w) over () u from w),
d as (select p position, {hash_sql('p + 1', 9)} / 4294967296.0::double x from (select unnest(range(2000)) p)),
g as (select position, arg_min(dataset_id, u) dataset_id, arg_min(n, u) n from d join c on u > x group by position),
k as (select *, row_number() over (partition by dataset_id order by position) - 1 k from g),
o as (select distinct dataset_id, k // n cycle, unnest(range(n)) shard from k),
r as (select *, row_number() over (partition by dataset_id, cycle order by {hash_sql('shard * 7919 + cycle * 104729 + 1', 9)}, shard) - 1 slot from o),
s as (select position, k.dataset_id, shard from k join r on r.dataset_id = k.dataset_id and r.cycle = k.k // k.n and r.slot = k.k % k.n)
"""


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return _info(spark, folder).select("dataset_id", F.ceil(F.col("total_frames") / 1000).alias("n"), F.col("total_frames").alias("w"))


def _schedule(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.schedule(_sources(spark, folder), "dataset_id", "w", "n", 2000, seed=9)


@query(_SCHEDULE + "select position, dataset_id, shard from s")
def mixture_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """2,000 weighted draws of data sets, each one's shards in turn (164, 165, 169)."""
    return _schedule(spark, folder)


@query(_SCHEDULE + "select (position % 12) // 3 rank, position % 12 % 3 worker, count(*) n, min(position) as first, count(distinct dataset_id) sources from s group by all")
def rank_partition(spark: SparkSession, folder: str) -> DataFrame:
    """The schedule dealt to four ranks of three workers (167)."""
    rank, worker = sampling.partition_of(F.col("position"), 4, 3)
    s = _schedule(spark, folder).withColumn("rank", rank).withColumn("worker", worker)
    return s.groupBy("rank", "worker").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.count_distinct("dataset_id").alias("sources"))


@query(f"with {CURRENT}, a as (select dataset_id, unnest(range(ceil(total_frames / 1000.0)::bigint)) shard from i) select row_number() over (order by dataset_id, shard) - 1 as position, dataset_id, shard from a")
def eval_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Every shard once, in order (166)."""
    return sampling.evaluation_schedule(_sources(spark, folder), "dataset_id", "n")


@query(f"with {CURRENT} select robot, count(distinct dataset_id) n, sum(ceil(total_frames / 1000.0))::bigint shards from i group by all")
def mixture_report(spark: SparkSession, folder: str) -> DataFrame:
    """Data sets and shards per robot type (96j)."""
    s = _info(spark, folder).withColumn("n", F.ceil(F.col("total_frames") / 1000))
    return s.groupBy("robot").agg(F.count_distinct("dataset_id").alias("n"), F.sum("n").cast("bigint").alias("shards"))


@query(_SHARDS + "select dataset_id, shard, sum(n)::bigint steps, count(*) parts, count(distinct episode_index) episodes from dealt group by all")
def shard_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Steps, parts and episodes of every shard (193)."""
    return _shards(spark, folder).groupBy("dataset_id", "shard").agg(F.sum("n_steps").alias("steps"), F.count("*").alias("parts"), F.count_distinct("episode_index").alias("episodes"))


#: Steps of the episodes with their part: dealt in turn in seeded order.
_STEPS = f""", st0 as (select dataset_id, episode_index, unnest(range("length")) step from e where "length" > 0),
st as (select dataset_id, episode_index, step, (row_number() over (partition by dataset_id, episode_index order by {hash_sql('step * 7919 + episode_index * 104729', 5)}, step) - 1) % 4 split from st0),
fr as (select distinct dataset_id, episode_index, frame_index step, task_index from frames where dataset_id is not null and episode_index is not null and frame_index is not null),
po as (select dataset_id, shard, row_number() over (order by dataset_id, shard) - 1 as position from (select distinct dataset_id, shard from dealt)),
m as (select position, dataset_id, shard, st.episode_index, step, task_index from dealt join st using (dataset_id, episode_index, split) join po using (dataset_id, shard) join fr using (dataset_id, episode_index, step)),
em as (select *, row_number() over (partition by position order by {hash_sql('position * 15485863 + episode_index * 104729 + step', 6)}, dataset_id, episode_index, step) - 1 emitted from m)
"""


def _dealt(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    return sampling.dealt_steps(shards, _lengths(spark, folder), EPISODE, "length", 4, seed=5)


@query(_SHARDS + _STEPS + "select position, dataset_id, shard, episode_index, step, task_index, emitted from em")
def shard_materialize(spark: SparkSession, folder: str) -> DataFrame:
    """Scheduled shards with the frames of their dealt steps, in the order they are emitted (170, 172, 86)."""
    shards = cut(_shards(spark, folder))
    plan = sampling.evaluation_schedule(shards.groupBy("dataset_id").agg(F.count_distinct("shard").alias("n")), "dataset_id", "n")
    frames = frame_records(table(spark, folder, "frames"), "task_index")
    return sampling.materialize(plan, _dealt(spark, folder, shards), frames, EPISODE, "frame_index", seed=6)


@query(_SHARDS + _STEPS + """, nf as (select distinct dataset_id, shard, st.episode_index, greatest(0, least(step + d, "length" - 1)) frame
 from dealt join st using (dataset_id, episode_index, split) join e using (dataset_id, episode_index), (select unnest([-8, 0, 8]) d))
select dataset_id, shard, episode_index, count(*) n, sum(frame)::bigint total from nf group by all""")
def shard_needed_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames that windows at -8, 0 and 8 around each shard's steps read, clamped to the episode (59, 84)."""
    need = sampling.needed_frames(_dealt(spark, folder, cut(_shards(spark, folder))), [*EPISODE, "shard"], [-8, 0, 8], _lengths(spark, folder))
    return need.groupBy("dataset_id", "shard", "episode_index").agg(F.count("*").alias("n"), F.sum("frame").alias("total"))


# ---------------------------------------------------------------- repair and conversion

_REQUIRED = """
cur as (select dataset_id, any_value(data_path) dp, any_value(video_path) vp, any_value(chunks_size) cs from info join (select dataset_id, max(revision) revision from info where chunks_size > 0 group by 1) using (dataset_id, revision) group by 1),
cam as (select distinct dataset_id, original_key k from modality where modality = 'video' and original_key is not null),
pat as (select dataset_id, cs, dp t from cur where dp is not null union all select dataset_id, cs, replace(vp, '{video_key}', k) from cur join cam using (dataset_id) where vp is not null),
req0 as (select distinct e.dataset_id, e.episode_index, cs, t, e.episode_index // cs ch, (e.episode_index % cs) // 3 fi from e join pat using (dataset_id)),
req as (select dataset_id, episode_index, {fill} path from req0),
have as (select distinct dataset_id, regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '^(\\./)+', '') path from stored_files where deleted_at is null),
miss as (select * from req anti join have using (dataset_id, path))
"""


def _fill() -> str:
    out = "t"
    for field, value in (("episode_chunk", "ch"), ("chunk_index", "ch"), ("episode_index", "episode_index"), ("file_index", "fi")):
        for w in (3, 4, 6, 7):
            out = f"replace({out}, '{{{field}:0{w}d}}', lpad({value}::varchar, greatest({w}, length({value}::varchar))::int, '0'))"
    return out


_REPAIR = f"with {E}, {_REQUIRED.replace('{fill}', _fill())}"


def _missing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    eps = _episodes(spark, folder)
    need = maintenance.required_files(eps, table(spark, folder, "info"), table(spark, folder, "modality"))
    return eps, maintenance.missing_files(need, table(spark, folder, "stored_files"))


@query(_REPAIR + "select dataset_id, episode_index, path from miss")
def required_files_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Files that episodes need but the store lacks (61, 83, 147)."""
    return _missing(spark, folder)[1]


@query(_REPAIR + """, b as (select e.*, (dataset_id, episode_index) in (select (dataset_id, episode_index) from miss) bad from e), r as (select *, bool_and(bad) over (partition by dataset_id) refused from b) select dataset_id, refused, count(*) n, sum("length")::bigint frames from r where refused or not bad group by all""")
def repair_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes that remain after dropping those that miss a file; a data set that would be emptied is left alone (60)."""
    eps, missing = _missing(spark, folder)
    return maintenance.repaired(eps, missing).groupBy("dataset_id", "refused").agg(F.count("*").alias("n"), F.sum("length").alias("frames"))


@query(_REPAIR + ", x as (select dataset_id, episode_index, list(path order by path)[1:4] paths from miss group by all order by dataset_id, episode_index limit 20) select dataset_id, episode_index, array_to_string(paths, ' ') paths from x")
def repair_examples(spark: SparkSession, folder: str) -> DataFrame:
    """A report of at most 20 episodes and 4 of their missing paths (60, 111a)."""
    return maintenance.examples(_missing(spark, folder)[1]).withColumn("paths", F.array_join("paths", " "))


@query(
    f"""with {E}, c as (select dataset_id, count(distinct original_key) cams from modality where modality = 'video' group by 1)
select e.dataset_id, count(*) total_episodes, sum("length")::bigint total_frames, (count(*) * any_value(coalesce(cams, 0)))::bigint total_videos, count(distinct episode_index // 50) total_chunks, '0:' || count(*) train_split from e left join c using (dataset_id) group by 1"""
)
def summary_update(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of each data set from its episodes (96g)."""
    cams = table(spark, folder, "modality").where("modality = 'video'").groupBy("dataset_id").agg(F.count_distinct("original_key").alias("cams"))
    eps = _episodes(spark, folder).join(small_side(cams), "dataset_id", "left").fillna(0, ["cams"])
    return maintenance.summary(eps, 50, F.col("cams"))


@query(
    f"""with {E}, {CURRENT}, n as (select dataset_id, count(*) n, sum("length") f from e group by 1)
select dataset_id, n, total_episodes, f::bigint frames, total_frames from n full join i using (dataset_id) where n is distinct from total_episodes or f is distinct from total_frames"""
)
def cross_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Data sets whose declared totals differ from their episodes (69, 205)."""
    from trajspark.operators.joins import mismatched

    n = _episodes(spark, folder).groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum("length").alias("frames"))
    i = _info(spark, folder).select("dataset_id", "total_episodes", "total_frames")
    same = F.col("n").eqNullSafe(F.col("total_episodes")) & F.col("frames").eqNullSafe(F.col("total_frames"))
    return mismatched(n, i, ["dataset_id"], same)


@query(
    """with s as (select distinct dataset_id, modality, "key", "start" + (case when "key" = 'gripper' then 1 else 0 end) st, "end" en from modality where modality in ('state', 'action')),
w as (select *, coalesce(lag(en) over (partition by dataset_id, modality order by st, en), 0) expected from s)
select dataset_id, modality, "key", expected, st as "start", case when st > expected then 'gap' else 'overlap' end kind from w where st <> expected"""
)
def slices_contiguous(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps and overlaps between the slices of a template whose grippers begin one too late (66)."""
    s = table(spark, folder, "modality").where("modality in ('state', 'action')").select("dataset_id", "modality", "key", "start", "end").distinct()
    s = s.withColumn("start", F.col("start") + F.when(F.col("key") == "gripper", 1).otherwise(0))
    return maintenance.discontinuities(s, ["dataset_id", "modality"])


@query(
    """with p as (select p_brand m, p_name pkg, (p_size // 10)::varchar spec from part), s as (select pkg, m, string_agg(distinct spec, '|' order by spec) sig from p group by all),
d as (select pkg, count(distinct m) n_manifests, count(distinct sig) n_specs from s group by 1)
select pkg as package, case when n_manifests < (select count(distinct m) from p) then 'presence' else 'version' end kind, n_manifests, n_specs from d where n_manifests < (select count(distinct m) from p) or n_specs > 1"""
)
def manifest_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as packages, brands as manifests: missing ones and differing versions (70)."""
    p = table(spark, folder, "part").select(F.col("p_brand").alias("manifest"), F.col("p_name").alias("package"), F.expr("p_size div 10").cast("string").alias("spec"))
    return maintenance.manifest_drift(p)


@query(
    """with f as (select distinct dataset_id, episode_index, frame_index from frames)
select dataset_id, episode_index, count(*) n_rows, min(frame_index) as first, max(frame_index) as last, episode_index // 20 chunk, printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 20, episode_index) path from f group by all"""
)
def episode_repartition(spark: SparkSession, folder: str) -> DataFrame:
    """The file per episode of the older layout (26)."""
    return maintenance.episode_files(frame_records(table(spark, folder, "frames")), 20)


@query(
    f"""with {E}, {CURRENT}, x as (select e.dataset_id, e.episode_index // 3 file, e.episode_index, "length" l, fps from e join i using (dataset_id) where fps > 0),
u as (select *, sum(l) over (partition by dataset_id, file order by episode_index) u from x)
select dataset_id, file, episode_index, round((u - l) / fps, 6) start_s, round(u / fps, 6) end_s, round(l / fps, 6) duration_s from u"""
)
def segment_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Where episodes lie within files that hold three (30, 20)."""
    x = _episodes(spark, folder).join(small_side(_info(spark, folder).where("fps > 0")), "dataset_id").withColumn("file", F.expr("episode_index div 3"))
    out = maintenance.segments(x.withColumn("fps", F.col("fps").cast("double")), ["dataset_id", "file", "fps"], "episode_index", "length", F.col("fps")).drop("fps")
    return out.select("dataset_id", "file", "episode_index", *[F.round(c, 6).alias(c) for c in ("start_s", "end_s", "duration_s")])


# ---------------------------------------------------------------- sets, sorts, small aggregates


@query("""select 'state' kind, dataset_id, "key" from modality where modality = 'state' union all select 'action', dataset_id, "key" from modality where modality = 'action'""")
def union_all(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of two sources one after the other (112, 112a)."""
    m = table(spark, folder, "modality")
    part = lambda k: m.where(F.col("modality") == k).select(F.lit(k).alias("kind"), "dataset_id", "key")
    return part("state").unionByName(part("action"))


@query("""select dataset_id, array_to_string(list_sort(list(distinct "key")), ' ') all_keys, array_to_string(list_sort(coalesce(list(distinct "key") filter (modality = 'state' and "key" not in (select "key" from modality n where n.modality = 'action' and n.dataset_id = m.dataset_id)), [])), ' ') state_only from modality m where modality in ('state', 'action') group by 1""")
def key_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Union and difference of key sets (112b, 112c, 112d)."""
    of = lambda k: F.collect_set(F.when(F.col("modality") == k, F.col("key")))
    g = table(spark, folder, "modality").where("modality in ('state', 'action')").groupBy("dataset_id").agg(of("state").alias("s"), of("action").alias("a"))
    join = lambda c: F.array_join(F.sort_array(c), " ")
    return g.select("dataset_id", join(F.array_union("s", "a")).alias("all_keys"), join(F.array_except("s", "a")).alias("state_only"))


@query(f"with {E}, r as (select *, row_number() over (partition by dataset_id order by episode_index) k from e), u as (select distinct dataset_id, unnest(tasks) task from r where k <= 5) select u.dataset_id, t.task_index, u.task from u join (select distinct dataset_id, task_index, task from tasks where deleted_at is null) t on t.dataset_id = u.dataset_id and t.task = u.task")
def first_episodes_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks used by the first five episodes of each data set (72, 84, 111a)."""
    w = Window.partitionBy("dataset_id").orderBy("episode_index")
    first = _episodes(spark, folder).withColumn("k", F.row_number().over(w)).where("k <= 5").select("dataset_id", F.explode("tasks").alias("task")).distinct()
    return table(spark, folder, "tasks").where("deleted_at is null").select("dataset_id", "task_index", "task").distinct().join(first, ["dataset_id", "task"], "left_semi")


@query("select dataset_id, kind, count(distinct path) files, count(distinct regexp_extract(path, 'chunk-([0-9]+)', 1)) chunks, min(n_rows) fewest from stored_files group by all")
def distinct_files(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct files and chunks, and the smallest file (96h)."""
    f = table(spark, folder, "stored_files").withColumn("chunk", F.regexp_extract("path", "chunk-([0-9]+)", 1))
    return f.groupBy("dataset_id", "kind").agg(F.count_distinct("path").alias("files"), F.count_distinct("chunk").alias("chunks"), F.min("n_rows").alias("fewest"))


@query("with m as (select event_type, median(value) m from events group by 1) select event_type, round(m, 6) median_ms, round(1000 / m, 6) hz, round((select m from m where event_type = (select min(event_type) from events)) / m, 6) speedup from m")
def latency_median(spark: SparkSession, folder: str) -> DataFrame:
    """Median, frequency and speedup over the first kind of event (96d)."""
    e = table(spark, folder, "events")
    base = e.agg(F.min("event_type")).first()[0]
    out = evaluation.latencies(e, "event_type", "value", base)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("median_ms", "hz", "speedup")])


@query("select user_id, event_id, value from (select *, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) b from events) where b is null or value > b")
def best_event(spark: SparkSession, folder: str) -> DataFrame:
    """Events strictly better than all before (96k)."""
    e = table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return evaluation.best_so_far(e, "o", "value", ["user_id"]).select("user_id", "event_id", "value")


@query("select n_name, r_name, count(c_custkey) n from nation left join region on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by all")
def dimension_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Lookups of small dimensions, unknown keys kept (73, 74)."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("n"))
    out = n.join(small_side(r), n["n_regionkey"] == r["r_regionkey"], "left").join(c, "n_nationkey", "left")
    return out.groupBy("n_name", "r_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
