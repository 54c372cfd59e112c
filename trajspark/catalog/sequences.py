"""Queries over the ordered frame records: scans, joins, windows, errors, rollouts."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions import arrays
from trajspark.functions.text import hash_sql
from trajspark.operators import evaluation, joins, stats, windows
from trajspark.plans.records import EPISODE, FRAME, frame_records, in_order, live_episodes
from trajspark.plans.sizes import small_side
from trajspark.plans.tables import table

QUERIES, ORACLES = {}, {}

#: The frame records and current episodes in SQL.
RECORDS = """
f as (select distinct dataset_id, episode_index, frame_index, "timestamp"::double ts, task_index, "observation.state" s, action a, "next.reward"::double r, "next.done" d
 from frames where dataset_id is not null and episode_index is not null and frame_index is not null),
e as (select * from (select *, row_number() over (partition by dataset_id, episode_index order by received_at desc, "length" desc) rn from episodes where deleted_at is null) where rn = 1)
"""


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return frame_records(table(spark, folder, "frames"), *columns)


def _episodes(spark: SparkSession, folder: str) -> DataFrame:
    return live_episodes(table(spark, folder, "episodes"))


def _scalar(spark: SparkSession, folder: str) -> DataFrame:
    """(FRAME, x): the first action dimension where it is finite, for what is a single number by nature: a gripper, a flag, a metric."""
    x = F.col("action")[0].cast("double")
    return _records(spark, folder, "action").select(*FRAME, x.alias("x")).where("x is not null and not isnan(x) and abs(x) < 1e30")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(FRAME, v): the whole action vectors of the records where all of it is finite."""
    rows = _records(spark, folder, "action").select(*FRAME, F.col("action").cast("array<double>").alias("v"))
    return rows.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e30)")


SCALAR = RECORDS + ", x as (select dataset_id, episode_index, frame_index, a[1]::double x from f where a[1] is not null and isfinite(a[1]))"
VECTORS = RECORDS + ", x as (select dataset_id, episode_index, frame_index, a::double[] v from f where a is not null and len(list_filter(a, lambda z: z is null or not isfinite(z) or abs(z) >= 1e30)) = 0)"
#: Sums over a table w of (dataset_id, episode_index, frame_index, k, v), weighted to tell misplaced rows.
SUMMED = " select dataset_id, episode_index, k::int k, dim::int dim, count(*) n, round(sum(x), 2) total, round(sum(x * (frame_index % 7 + 1)), 2) weighted from (select dataset_id, episode_index, frame_index, k, unnest(range(len(v))) dim, unnest(v) x from w) group by all"
EP = "partition by dataset_id, episode_index"
ORD = f"{EP} order by frame_index"
SIX = "avg(x) mean, stddev_pop(x) std, min(x) min, max(x) max, quantile_cont(x, 0.01) q01, quantile_cont(x, 0.99) q99"


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


# ---------------------------------------------------------------- statistics


@query(
    f"""with {RECORDS}, v as (
 select dataset_id, 'state' feature, generate_subscripts(s, 1) - 1 dim, unnest(s)::double x from f union all
 select dataset_id, 'action', generate_subscripts(a, 1) - 1, unnest(a)::double from f)
select dataset_id, feature, dim, round(mean, 4) mean, round(std, 4) std, round(min, 4) min, round(max, 4) max, round(q01, 4) q01, round(q99, 4) q99
from (select dataset_id, feature, dim, {SIX} from v where isfinite(x) group by all)"""
)
def stats_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Six statistics of every state and action dimension per data set (87)."""
    rows = _records(spark, folder, "observation.state", "action")
    return _round(stats.vector_statistics(rows, ["dataset_id"], ["state", "action"]), *stats.SIX, digits=4)


@query(
    f"""select feature, 0 dim, round(mean, 4) mean, round(std, 4) std, round(min, 4) min, round(max, 4) max, round(q01, 4) q01, round(q99, 4) q99 from (
 select feature, {SIX} from (unpivot (select l_quantity, l_extendedprice, l_discount, l_tax from lineitem) on * into name feature value x) group by all)"""
)
def stats_all_features(spark: SparkSession, folder: str) -> DataFrame:
    """All float columns of a table in one scan (87, 89)."""
    t = table(spark, folder, "lineitem")
    return _round(stats.vector_statistics(t, [], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), *stats.SIX, digits=4)


@query(
    f"""with {RECORDS}, n as (select dataset_id, episode_index, count(*) n from f group by all),
c as (select x.dataset_id, h step, unnest(range(least(len(g.a), len(x.s)))) dim, unnest(list_transform(range(1, least(len(g.a), len(x.s)) + 1), lambda k: g.a[k]::double - x.s[k]::double)) x
 from (select f.*, h from f join n using (dataset_id, episode_index), (select unnest([0, 1, 2, 3]) h) where frame_index < n - 3) x
 join f g on g.dataset_id = x.dataset_id and g.episode_index = x.episode_index and g.frame_index = x.frame_index + h
 where x.a is not null and x.s is not null and g.a is not null)
select dataset_id, step, dim, round(mean, 4) mean, round(std, 4) std, round(min, 4) min, round(max, 4) max, round(q01, 4) q01, round(q99, 4) q99
from (select dataset_id, step, dim, {SIX} from c where isfinite(x) group by all)"""
)
def stats_relative_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """Per window step and dimension that both have: actions ahead less the current state, over steps with a full window (88, 57)."""
    rows = _records(spark, folder, "observation.state", "action")
    n = F.count("*").over(Window.partitionBy(*EPISODE))
    rows = rows.withColumn("n", n).withColumn("c", windows.chunk(in_order(), F.col("action"), 4)).where("frame_index < n - 3 and state is not null and action is not null")
    return _round(stats.step_statistics(rows, ["dataset_id"], "c", less="state"), *stats.SIX, digits=4)


# ---------------------------------------------------------------- projections and joins


@query(
    f"""with {RECORDS}, g as (select distinct dataset_id, key, "start" st, "end" en from modality where modality = 'state'),
u as (select f.dataset_id, key as "group", frame_index, generate_subscripts(s[st + 1:en], 1) - 1 dim, unnest(s[st + 1:en])::double x from f join g using (dataset_id) where s is not null)
select dataset_id, "group", dim::int dim, count(*) n, round(sum(x), 2) total, round(sum(x * (frame_index % 7 + 1)), 2) weighted from u where isfinite(x) and abs(x) < 1e30 group by all"""
)
def group_slice(spark: SparkSession, folder: str) -> DataFrame:
    """All named slices of the state vector of each record, summed (40)."""
    g = table(spark, folder, "modality").where("modality = 'state'").select("dataset_id", F.col("key").alias("group"), "start", F.col("end").alias("stop")).distinct()
    rows = _records(spark, folder, "observation.state").join(small_side(g), "dataset_id")
    long = rows.select("dataset_id", "frame_index", "group", F.posexplode(arrays.group_slice(F.col("state"), F.col("start"), F.col("stop"))).alias("dim", "x")).withColumn("x", F.col("x").cast("double")).where("not isnan(x) and abs(x) < 1e30")
    return long.groupBy("dataset_id", "group", "dim").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.round(F.sum(F.col("x") * (F.col("frame_index") % 7 + 1)), 2).alias("weighted"))


@query(
    """select s.dataset_id, m.key as "group", s."key" source, s.dim - m."start" dim, s.mean, s.std, s.min, s.max, s.q01, s.q99
from (select distinct * from stats) s join (select distinct dataset_id, modality, "key", "start", "end", coalesce(original_key, case modality when 'state' then 'observation.state' else 'action' end) src from modality where modality in ('state', 'action')) m
on m.dataset_id = s.dataset_id and m.src = s."key" where s.modality = 'stats' and s.dim >= m."start" and s.dim < m."end" """
)
def slice_stats_join(spark: SparkSession, folder: str) -> DataFrame:
    """Published statistics of the named slices (75)."""
    out = joins.slice_statistics(table(spark, folder, "stats").distinct(), table(spark, folder, "modality").distinct())
    return out.select("dataset_id", "group", F.col("key").alias("source"), "dim", *stats.SIX)


@query(
    f"""with {RECORDS}, t as (select dataset_id, task_index, arg_max(task, (received_at, task)) task from tasks where deleted_at is null group by all)
select f.dataset_id, f.task_index, t.task, count(*) n from f left join t on t.dataset_id = f.dataset_id and t.task_index = f.task_index group by all"""
)
def task_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with the text of their task, counted (73)."""
    return joins.task_text(_records(spark, folder, "task_index"), table(spark, folder, "tasks")).groupBy("dataset_id", "task_index", "task").agg(F.count("*").alias("n"))


@query(f"with {RECORDS} select f.dataset_id, f.episode_index, count(*) n, max(frame_index) as last from f join e using (dataset_id, episode_index) where frame_index < \"length\" group by all")
def within_length(spark: SparkSession, folder: str) -> DataFrame:
    """Frames below the nominal length of their episode (55, 74)."""
    return joins.within_length(_records(spark, folder), _episodes(spark, folder)).groupBy(*EPISODE).agg(F.count("*").alias("n"), F.max("frame_index").alias("last"))


@query(
    f"""with {RECORDS}, s as (select dataset_id, episode_index, greatest(u.start - 8, 0) lo, u."end" hi, u.text t from (select dataset_id, episode_index, unnest(sub_tasks) u from e)),
m as (select f.dataset_id, f.episode_index, f.frame_index, arg_min(t, ({hash_sql('frame_index * 7919 + lo')}, lo, hi, t)) filter (t is not null) t
 from f left join s on s.dataset_id = f.dataset_id and s.episode_index = f.episode_index and frame_index >= lo and frame_index < hi group by all)
select dataset_id, episode_index, frame_index, coalesce(t, '') as text from m"""
)
def subtask_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """The sub-task of each frame, starting half a window of 16 early (77)."""
    return joins.interval_text(_records(spark, folder), _episodes(spark, folder), 8).select(*FRAME, "text")


@query(
    f"""with {RECORDS}, n as (select dataset_id, episode_index, count(*) frames, count(s) states, count(a) actions, count(task_index) texts from f group by all)
select coalesce(n.dataset_id, e.dataset_id) dataset_id, coalesce(n.episode_index, e.episode_index) episode_index, frames, states, actions, texts, "length" as declared
from n full join e on e.dataset_id = n.dataset_id and e.episode_index = n.episode_index where not coalesce(frames = "length" and states = frames and actions = frames and texts = frames, false)"""
)
def align_modalities(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes whose state, action, text and declared length do not line up (78)."""
    n = _records(spark, folder, "observation.state", "action", "task_index").groupBy(*EPISODE).agg(F.count("*").alias("frames"), F.count("state").alias("states"), F.count("action").alias("actions"), F.count("task_index").alias("texts"))
    same = (F.col("frames") == F.col("declared")) & (F.col("states") == F.col("frames")) & (F.col("actions") == F.col("frames")) & (F.col("texts") == F.col("frames"))
    return joins.mismatched(n, _episodes(spark, folder).select(*EPISODE, F.col("length").alias("declared")), EPISODE, same)


def _grid(spark: SparkSession, folder: str, step: float) -> DataFrame:
    """Query times every `step` seconds within each episode."""
    ends = _records(spark, folder, "timestamp").groupBy(*EPISODE).agg(F.max("ts").cast("double").alias("t"))
    return ends.select(*EPISODE, F.explode(F.sequence(F.lit(0), F.floor(F.col("t") / step).cast("int"))).alias("k")).select(*EPISODE, (F.col("k") * F.lit(step)).alias("at"))


@query(
    f"""with {RECORDS}, g as (select dataset_id, episode_index, unnest(range(0, floor(max(ts) / 0.5)::bigint + 1)) * 0.5::double as at_ from f group by dataset_id, episode_index)
select g.dataset_id, g.episode_index, at_ as "at", arg_min(frame_index, (abs(ts - at_), ts, frame_index)) frame_index from g join f using (dataset_id, episode_index) group by all"""
)
def asof_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The frame nearest in time to each half second, the earlier on a tie (15, 80)."""
    return windows.nearest(_records(spark, folder, "timestamp"), EPISODE, "ts", "frame_index", _grid(spark, folder, 0.5), "at")


@query(
    f"""with {RECORDS}, i as (select dataset_id, arg_max(fps, revision) fps from info where fps > 0 group by 1)
select f.dataset_id, count(*) n, count(*) filter (abs(ts - round_even(ts * fps, 0) / fps) * fps >= 0.01) off, count(*) filter (round_even(ts * fps, 0) <> frame_index) moved from f join i using (dataset_id) group by all"""
)
def frame_snap(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamps snapped to the nearest frame, half to even, with how many are off by 1 % of a frame (14, 20)."""
    fps = table(spark, folder, "info").where("fps > 0").groupBy("dataset_id").agg(F.max_by("fps", "revision").alias("fps"))
    rows = _records(spark, folder, "timestamp").withColumn("ts", F.col("ts").cast("double")).join(small_side(fps), "dataset_id")
    k = F.bround(F.col("ts") * F.col("fps"), 0)
    return rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("ts") - k / F.col("fps")) * F.col("fps") >= 0.01).alias("off"), F.count_if(k != F.col("frame_index")).alias("moved"))


@query(
    f"""with {RECORDS}, g as (select dataset_id, episode_index, frame_index, floor((ts - 0.05) / 0.1 + 0.00001)::bigint g, ts from f),
b as (select *, coalesce(greatest(max(g) over ({EP} order by ts, frame_index rows between unbounded preceding and 1 preceding) + 1, 0), 0) s from g where g >= 0)
select dataset_id, episode_index, unnest(range(s, g + 1)) slot, frame_index from b where g >= s"""
)
def resample_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Frames on a grid of 0.1 s from 0.05 s on, gaps filled and extra frames dropped (113, 81)."""
    return windows.resample(_records(spark, folder, "timestamp"), EPISODE, "ts", "frame_index", F.lit(0.05), 0.1)


@query(
    f"""with {VECTORS}, t as (select x.*, f.ts from x join f using (dataset_id, episode_index, frame_index)),
m as (select * from (select *, lag(ts) over ({ORD}) p from t) where p is null or ts > p),
q as (select dataset_id, episode_index, min(ts) a, max(ts) b from m group by all having count(*) > 1),
g as (select dataset_id, episode_index, a + (b - a) * k / 4 as at_ from q, (select unnest([0, 1, 2, 3, 4]) k)),
j as (select g.*, arg_max(v, ts) filter (ts <= at_) v0, max(ts) filter (ts <= at_) t0, arg_min(v, ts) filter (ts >= at_) v1, min(ts) filter (ts >= at_) t1 from g join m using (dataset_id, episode_index) group by all),
u as (select *, unnest(range(1, len(v0) + 1)) d from j)
select dataset_id, episode_index, round(at_, 6) as "at", (d - 1)::int dim, round(case when t0 = t1 then v0[d] else v0[d] + (v1[d] - v0[d]) * (at_ - t0) / (t1 - t0) end, 4) as value from u"""
)
def interp_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Five evenly spaced vectors per episode by linear interpolation, after dropping stalled times (107, 62)."""
    rows = _records(spark, folder, "action", "timestamp").select(*FRAME, F.col("action").cast("array<double>").alias("v"), F.col("ts").cast("double").alias("ts"))
    rows = rows.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e30)")
    rows = windows.monotonic(rows, EPISODE, "frame_index", "ts")
    ends = rows.groupBy(*EPISODE).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).where("n > 1")
    at = ends.select(*EPISODE, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "a", "b").select(*EPISODE, (F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / 4).alias("at"))
    out = windows.interpolate(rows, EPISODE, "ts", "v", at, "at").select(*EPISODE, "at", F.posexplode("value").alias("dim", "value"))
    return _round(_round(out, "at"), "value", digits=4)


# ---------------------------------------------------------------- windows


def _summed(df: DataFrame, column: str = "chunk") -> DataFrame:
    """Per episode, place in the chunk and dimension: how many values, their sum, and one weighted by the frame."""
    long = df.select(*FRAME, F.posexplode(column).alias("k", "v")).select(*FRAME, "k", F.posexplode("v").alias("dim", "x"))
    weighted = F.sum(F.col("x") * (F.col("frame_index") % 7 + 1))
    return long.groupBy(*EPISODE, "k", "dim").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.round(weighted, 2).alias("weighted"))


@query(f"with {VECTORS}, l as (select *, lead(v, 1) over ({ORD}) v1, lead(v, 2) over ({ORD}) v2, lead(v, 3) over ({ORD}) v3 from x), w as (select dataset_id, episode_index, frame_index, unnest([0, 1, 2, 3]) k, unnest([v, v1, v2, v3]) v from l where v3 is not null)" + SUMMED)
def window_offsets_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Windows at offsets 0 to 3, only full ones (97, 56)."""
    return _summed(windows.offsets(_vectors(spark, folder), EPISODE, "frame_index", "v", [0, 1, 2, 3], "drop"))


@query(f"with {VECTORS}, l as (select *, coalesce(lag(v, 2) over ({ORD}), first_value(v) over ({ORD})) p, coalesce(lead(v, 2) over ({ORD}), last_value(v) over ({ORD} rows between unbounded preceding and unbounded following)) n from x), w as (select dataset_id, episode_index, frame_index, unnest([0, 1, 2]) k, unnest([p, v, n]) v from l)" + SUMMED)
def window_offsets_clamp(spark: SparkSession, folder: str) -> DataFrame:
    """Windows at offsets -2, 0 and 2, clamped to the episode (98)."""
    return _summed(windows.offsets(_vectors(spark, folder), EPISODE, "frame_index", "v", [-2, 0, 2], "clamp"))


@query(f"with {VECTORS}, r as (select *, row_number() over ({ORD}) - 1 i, count(*) over ({EP}) n from x), l as (select r.*, q.v p from r join r q on q.dataset_id = r.dataset_id and q.episode_index = r.episode_index and q.i = case when r.i >= 2 then r.i - 2 else r.i - 2 + r.n end), w as (select dataset_id, episode_index, frame_index, unnest([0, 1]) k, unnest([p, v]) v from l)" + SUMMED)
def window_offsets_wrap(spark: SparkSession, folder: str) -> DataFrame:
    """Windows at offsets -2 and 0, negative positions counted from the end (99)."""
    return _summed(windows.offsets(_vectors(spark, folder), EPISODE, "frame_index", "v", [-2, 0], "wrap"))


@query(f"with {VECTORS}, r as (select *, row_number() over ({ORD}) - 1 i, list(v) over ({ORD} rows between current row and 5 following) c, last_value(v) over ({ORD} rows between unbounded preceding and unbounded following) l from x), p as (select *, list_concat(c, list_transform(range(6 - len(c)), lambda z: l)) q from r where i % 4 = 0), w as (select dataset_id, episode_index, frame_index, unnest(range(6)) k, unnest(q) v from p)" + SUMMED)
def replay_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 6 at every fourth row, padded with the last value (100)."""
    return _summed(windows.replay(_vectors(spark, folder), EPISODE, "frame_index", "v", 6, 4))


_NAIVE = f"with {VECTORS}, r as (select *, row_number() over ({ORD}) - 1 i, count(*) over ({EP}) n from x), p as (select t.*, h.v p from r t join r h on h.dataset_id = t.dataset_id and h.episode_index = t.episode_index and h.i = t.i - t.i % 8), u as (select dataset_id, episode_index, unnest(v) x, unnest(p) p from p), t as (select dataset_id, episode_index, avg((x - p) * (x - p)) mse, avg(abs(x - p)) mae from u group by all)"


def _naive_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of a policy that repeats the vector seen at the start of every 8 steps."""
    rows = _vectors(spark, folder)
    planned = rows.withColumn("plan", F.array_repeat("v", 8))
    guess = windows.stitched(planned, EPISODE, "frame_index", "plan", 8, F.count("*").over(Window.partitionBy(*EPISODE)))
    truth = rows.withColumn("step", F.row_number().over(in_order()) - 1)
    pairs = truth.join(guess, [*EPISODE, "step"])
    return evaluation.trajectory_errors(pairs, EPISODE, F.col("v"), F.col("value"))


@query(_NAIVE + " select dataset_id, episode_index, round(mse, 4) mse, round(mae, 4) mae from t")
def tumbling_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of chunked prediction per episode over all steps and dimensions (101, 82, 95)."""
    return _round(_naive_errors(spark, folder), "mse", "mae", digits=4)


@query(_NAIVE + " select round(avg(mse), 3) mse, round(avg(mae), 4) mae, count(*) n from t")
def mse_mean_of_means(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of the episodes' means (95)."""
    return _round(_round(evaluation.mean_of_means(_naive_errors(spark, folder)), "mse", digits=3), "mae", digits=4)


@query(f"with {VECTORS}, w as (select dataset_id, episode_index, frame_index, unnest([0, 1, 2]) k, unnest([coalesce(lag(v, 5) over ({ORD}), first_value(v) over ({ORD})), coalesce(lag(v, 2) over ({ORD}), first_value(v) over ({ORD})), v]) v from x)" + SUMMED)
def observation_history(spark: SparkSession, folder: str) -> DataFrame:
    """Observations 5, 2 and 0 rows back, filled with the first (102)."""
    return _summed(windows.history(_vectors(spark, folder), EPISODE, "frame_index", "v", [5, 2, 0]), "history")


_CHUNK = f"with {RECORDS}, c as (select dataset_id, episode_index, frame_index, list(a::double[]) over ({ORD} rows between current row and 3 following) c, s::double[] ref from f where a is not null and s is not null)"


def _wide(v: Column, width: Column) -> Column:
    """A vector with nulls up to `width`: state and action of a data set may differ in width."""
    return F.concat(v.cast("array<double>"), F.array_repeat(F.lit(None).cast("double"), width - F.size(v)))


def _vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(FRAME, c, ref): the next four actions beside the state, all of one width."""
    rows = _records(spark, folder, "observation.state", "action").where("action is not null and state is not null")
    rows = rows.select(*FRAME, windows.chunk(in_order(), F.col("action"), 4).alias("c"), F.col("state").alias("ref"))
    rows = rows.withColumn("width", F.greatest(F.size("ref"), F.array_max(F.transform("c", F.size))))
    return rows.withColumn("c", F.transform("c", lambda v: _wide(v, F.col("width")))).withColumn("ref", _wide(F.col("ref"), F.col("width")))


def _sum_chunks(df: DataFrame) -> DataFrame:
    """Sums per episode, step and dimension of a chunk column, finite values only."""
    long = df.select(*EPISODE, F.posexplode("chunk").alias("k", "v")).select(*EPISODE, "k", F.posexplode("v").alias("dim", "x")).where("not isnan(x) and abs(x) < 1e30")
    return long.groupBy(*EPISODE, "k", "dim").agg(F.round(F.sum("x"), 2).alias("total"), F.count("*").alias("n"))


_SUMS = " select dataset_id, episode_index, k::int k, dim::int dim, round(sum(x), 2) total, count(*) n from (select dataset_id, episode_index, k, unnest(range(len(v))) dim, unnest(v) x from d) where isfinite(x) and abs(x) < 1e30 group by all"
_EACH = "select dataset_id, episode_index, generate_subscripts(c, 1) - 1 k, unnest(list_transform(c, lambda z, i: list_transform(range(1, least(len(z), len(ref)) + 1), lambda j: {0}))) v from c"


@query(_CHUNK + f", d as ({_EACH.format('z[j] - ref[j]')})" + _SUMS)
def relative_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of actions less the current state over the dimensions both have, summed (104, 117)."""
    df = _vector_chunks(spark, folder)
    return _sum_chunks(df.withColumn("chunk", windows.relative_chunk(F.col("c"), F.col("ref"))))


@query(_CHUNK + f", d as ({_EACH.format('z[j] - (case when i = 1 then ref[j] else c[i - 1][j] end)').replace('least(len(z), len(ref))', 'case when i = 1 then least(len(z), len(ref)) else least(len(z), len(c[i - 1])) end')})" + _SUMS)
def delta_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of actions less the one before (105)."""
    df = _vector_chunks(spark, folder)
    return _sum_chunks(df.withColumn("chunk", windows.delta_chunk(F.col("c"), F.col("ref"))))


@query(_CHUNK + f", d as ({_EACH.format('z[j]')} where len(list_filter(ref, lambda q: q is not null and not isfinite(q))) = 0)" + _SUMS)
def absolute_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """Relative chunks turned back, which must give the actions themselves (106)."""
    df = _vector_chunks(spark, folder).where("not exists(ref, x -> x is not null and (isnan(x) or abs(x) = double('inf')))")
    return _sum_chunks(df.withColumn("chunk", windows.absolute_chunk(windows.relative_chunk(F.col("c"), F.col("ref")), F.col("ref"))))


#: Per step and dimension the five newest plans that cover it, and the newest's gripper.
_PLANS = f"with {VECTORS}, r as (select *, row_number() over ({ORD}) - 1 i, count(*) over ({EP}) n from x), a as (select dataset_id, episode_index, i anchor, i + k step, k, v from r, (select unnest(range(8)) k) where i % {{every}} = 0 and i + k < n), o as (select *, row_number() over ({EP}, step order by anchor desc) b, count(*) over ({EP}, step) m from a), z as (select dataset_id, episode_index, step, anchor, k, unnest(range(len(v))) dim, unnest(v) * (1 + 0.1 * k) p, exp(0.005 * (least(m, 5) - b)) w from o where b <= 5), y as (select dataset_id, episode_index, step, dim, sum(w * p) / sum(w) x, arg_max(-k, anchor) gripper from z group by all) select dataset_id, episode_index, dim::int dim, count(*) n, round(sum(x), 2) total, round(sum(x * (step % 7 + 1)), 2) weighted, sum(gripper)::double gripper from y group by all"


def _plans(spark: SparkSession, folder: str) -> DataFrame:
    """A plan of 8 vectors at every row: minus the plan's step as the gripper, then the action growing."""
    return _vectors(spark, folder).withColumn("plan", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(F.array(-k.cast("double")), F.transform("v", lambda x: x * (1 + F.lit(0.1) * k)))))


def _ensembled(df: DataFrame) -> DataFrame:
    long = df.select(*EPISODE, "step", F.col("vector")[0].alias("g"), F.posexplode(F.slice("vector", 2, F.size("vector") - 1)).alias("dim", "x"))
    return long.groupBy(*EPISODE, "dim").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.round(F.sum(F.col("x") * (F.col("step") % 7 + 1)), 2).alias("weighted"), F.sum("g").alias("gripper"))


@query(_PLANS.format(every=1))
def temporal_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five overlapping plans blended, a new one at every step (177)."""
    return _ensembled(windows.ensemble(_plans(spark, folder), EPISODE, "frame_index", "plan", 8, newest=[0]))


@query(_PLANS.format(every=3))
def receding_temporal(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a new plan at every third step (176)."""
    return _ensembled(windows.ensemble(_plans(spark, folder), EPISODE, "frame_index", "plan", 8, newest=[0], every=3))


@query(f"with {VECTORS}, r as (select *, row_number() over ({ORD}) - 1 i, count(*) over ({EP}) n from x), p as (select dataset_id, episode_index, i + k step, k, v from r, (select unnest(range(5)) k) where i % 5 = 0 and i + k < n), u as (select dataset_id, episode_index, step, k, unnest(range(len(v))) dim, unnest(v) * (1 + 0.1 * k) x from p) select dataset_id, episode_index, dim::int dim, count(*) n, round(sum(x), 2) total, round(sum(x * (step % 7 + 1)), 2) weighted, count(*) filter (-k > -2.5) open_ from u group by all")
def receding_horizon(spark: SparkSession, folder: str) -> DataFrame:
    """A plan carried out for five steps, then the next; the gripper made binary (175, 175a)."""
    out = windows.receding(_plans(spark, folder), EPISODE, "frame_index", "plan", 8, 5)
    long = out.select(*EPISODE, "step", (F.col("vector")[0] > -2.5).alias("o"), F.posexplode(F.slice("vector", 2, F.size("vector") - 1)).alias("dim", "x"))
    return long.groupBy(*EPISODE, "dim").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.round(F.sum(F.col("x") * (F.col("step") % 7 + 1)), 2).alias("weighted"), F.count_if("o").alias("open_"))


#: The state machine step by step: what is held and for how many rows, after each.
LATCH = """o as (select *, row_number() over (partition by {key} order by {order}) i from x),
s as (
 select {key}, i, {at}, case when abs(1 - 2 * g) > 0.5 then 1 - 2 * g end held, case when abs(1 - 2 * g) > 0.5 then 1 else 0 end n, 1 - 2 * g latched from o where i = 1
 union all
 select {key}, i, {at}, case when n = 5 then null else h end, case when n = 5 then 0 else n end, coalesce(h, v) from (
  select {of}, o.i, 1 - 2 * g v, coalesce(s.held, case when abs(1 - 2 * g) > 0.5 then 1 - 2 * g end) h, s.n + (case when coalesce(s.held, case when abs(1 - 2 * g) > 0.5 then 1 - 2 * g end) is not null then 1 else 0 end) n
  from s join o on {same} and o.i = s.i + 1)
)"""


@query(
    f"with recursive {SCALAR.replace(', x as (', ', x0 as (')}, x as (select *, 1 / (1 + exp(-x / 10)) g from x0), "
    + LATCH.format(key="dataset_id, episode_index", order="frame_index", at="frame_index", of="o.dataset_id, o.episode_index, o.frame_index", same="o.dataset_id = s.dataset_id and o.episode_index = s.episode_index")
    + " select dataset_id, episode_index, frame_index, round(latched, 6) latched from s"
)
def sticky_latch(spark: SparkSession, folder: str) -> DataFrame:
    """The sticky gripper over the first action dimension, squeezed to [0, 1] (179)."""
    rows = _scalar(spark, folder).withColumn("g", 1 / (1 + F.exp(-F.col("x") / 10)))
    return _round(windows.latched(rows, EPISODE, "frame_index", "g", 5), "latched")


# ---------------------------------------------------------------- rollouts


@query(
    f"""with {RECORDS}, t as (select dataset_id, episode_index, coalesce(sum(d::int) over ({ORD} rows between unbounded preceding and 1 preceding), 0)::bigint run, frame_index, r, coalesce(d, false) and r > 0 ok from f)
select dataset_id, episode_index, run, count(*) as length, round(sum(r), 4) reward, bool_or(ok) success, round(arg_max(r, frame_index), 6) progress, round(max(r), 6) best, bool_and(r is not null) valid from t group by all"""
)
def rollout_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Results per run, a run ending where a frame is marked done (96, 180)."""
    rows = windows.sessions(_records(spark, folder, "next.reward", "next.done"), EPISODE, "frame_index", "done")
    rows = rows.withColumn("reward", F.col("reward").cast("double")).withColumn("ok", F.coalesce(F.col("done"), F.lit(False)) & (F.col("reward") > 0))
    out = evaluation.rollouts(rows, [*EPISODE, "run"], "frame_index", "reward", "ok")
    return _round(_round(out, "reward", digits=4), "progress", "best")


@query(
    f"""with {RECORDS}, t as (select dataset_id, episode_index, bool_or(coalesce(d, false) and r > 0) ok, bool_and(r is not null) valid from f group by all)
select dataset_id, count(*) n, round(avg(ok::int), 6) rate from t where valid group by all"""
)
def rollout_success(spark: SparkSession, folder: str) -> DataFrame:
    """Success rate over the valid episodes of a data set (96, 71)."""
    rows = _records(spark, folder, "next.reward", "next.done").withColumn("ok", F.coalesce(F.col("done"), F.lit(False)) & (F.col("reward") > 0))
    return _round(evaluation.success_rate(evaluation.rollouts(rows, EPISODE, "frame_index", "reward", "ok"), ["dataset_id"]), "rate")


@query(
    f"""with {SCALAR} select dataset_id, episode_index, bool_or(x > 10) grasp, bool_or(x < -10) other, round(min(abs(x)), 6) distance from x group by all"""
)
def episode_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Contact flags and least distances of an episode (96a)."""
    rows = _scalar(spark, folder).withColumn("grasp", F.col("x") > 10).withColumn("other", F.col("x") < -10).withColumn("distance", F.abs("x"))
    return _round(evaluation.signals(rows, EPISODE, ["grasp", "other"], ["distance"]), "distance")


@query(
    f"""with {SCALAR}, s as (select dataset_id, episode_index, bool_or(x > 10) g, bool_or(x < -10) o, max(x) > 50 ok from x group by all),
c as (select dataset_id, case when ok and g and not o then 1 when ok then 2 when g and not o then 3 when g then 4 when not o then 5 else 6 end c from s)
select dataset_id, c as "case", count(*) n, round(avg((c <= 3)::int), 6) following from c group by all"""
)
def outcome_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes by the six outcome cases (96b)."""
    rows = _scalar(spark, folder).groupBy(*EPISODE).agg(F.bool_or(F.col("x") > 10).alias("g"), F.bool_or(F.col("x") < -10).alias("o"), (F.max("x") > 50).alias("ok"))
    rows = rows.withColumn("case", evaluation.outcome(F.col("ok"), F.col("g"), F.col("o")))
    return rows.groupBy("dataset_id", "case").agg(F.count("*").alias("n"), F.round(F.avg(evaluation.follows(F.col("case")).cast("int")), 6).alias("following"))


@query(f"with {SCALAR} select dataset_id, round(max(x), 4) as max, round(min(x), 4) as min, round(avg(x), 4) as mean, round(sum(x), 2) as sum from x group by all")
def reward_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """The four ways to aggregate (96c)."""
    return _scalar(spark, folder).groupBy("dataset_id").agg(*[F.round(evaluation.collapse(m, F.col("x")), 2 if m == "sum" else 4).alias(m) for m in ("max", "min", "mean", "sum")])


@query(f"with {RECORDS}, s as (select dataset_id, episode_index, row_number() over ({ORD}) - 1 step, task_index p, lead(coalesce(task_index, -100)) over ({ORD}) l from f) select dataset_id, count(*) filter (l <> -100 and p = l) correct, count(*) filter (l <> -100) total, round(count(*) filter (l <> -100 and p = l) / greatest(count(*) filter (l <> -100), 1), 6) accuracy from s where l is not null group by all")
def masked_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Each frame's task as a prediction of the next frame's, null labels masked (96e, 109)."""
    rows = _records(spark, folder, "task_index").withColumn("label", F.coalesce("task_index", F.lit(-100)))
    per = evaluation.masked_accuracy(rows, EPISODE, "frame_index", "task_index", "label")
    correct, total = F.sum("correct"), F.sum("total")
    return per.groupBy("dataset_id").agg(correct.alias("correct"), total.alias("total"), F.round(correct / F.greatest(total, F.lit(1)), 6).alias("accuracy"))


@query(f"with {SCALAR} select dataset_id, episode_index, frame_index, x from (select *, max(x) over ({ORD} rows between unbounded preceding and 1 preceding) b from x) where b is null or x > b")
def best_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Strictly better readings than all before in their episode (96k)."""
    return evaluation.best_so_far(_scalar(spark, folder), "frame_index", "x", EPISODE)


@query(f"with {RECORDS}, n as (select dataset_id, episode_index, dense_rank() over (partition by dataset_id order by episode_index) - 1 new_episode, row_number() over (partition by dataset_id order by episode_index, frame_index) - 1 new_index from f) select dataset_id, episode_index, min(new_episode) new_episode, min(new_index) as first, max(new_index) as last from n group by all")
def renumber(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes and rows renumbered without gaps (52)."""
    from trajspark.operators.maintenance import renumbered

    rows = renumbered(_records(spark, folder), ["dataset_id"], "episode_index", "frame_index")
    return rows.groupBy(*EPISODE).agg(F.min("new_episode").alias("new_episode"), F.min("new_index").alias("first"), F.max("new_index").alias("last"))


@query(f"with {VECTORS}, r as (select *, row_number() over ({ORD}) - 1 i from x), b as (select dataset_id, episode_index, i // 32 batch, count(*) n, list(v order by i) xs from r group by all), u as (select *, unnest(range(1, len(xs[1]) + 1)) d from b) select dataset_id, episode_index, batch, (d - 1)::int dim, n, round(xs[1][d], 4) as first, round(xs[-1][d], 4) as last, round(list_sum(list_transform(xs[-3:], lambda z: z[d])), 4) tail from u")
def collate(spark: SparkSession, folder: str) -> DataFrame:
    """Rows collated to batches of 32, and the last three of each (54, 103)."""
    rows = _vectors(spark, folder).withColumn("i", F.row_number().over(in_order()) - 1)
    per = rows.groupBy(*EPISODE, F.expr("i div 32").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("b"), F.count("*").alias("n"))
    xs = F.transform("b", lambda b: b["v"])
    wide = per.select(*EPISODE, "batch", "n", xs.alias("xs")).select("*", F.posexplode(F.col("xs")[0]).alias("dim", "first"))
    tail = F.aggregate(arrays.take_last(F.col("xs"), 3), F.lit(0.0), lambda t, v: t + v[F.col("dim")])
    return wide.select(*EPISODE, "batch", "dim", "n", F.round("first", 4).alias("first"), F.round(F.element_at("xs", -1)[F.col("dim")], 4).alias("last"), F.round(tail, 4).alias("tail"))
