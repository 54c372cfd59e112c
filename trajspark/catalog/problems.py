"""Queries of the general data problems, with the SQL that checks them where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.paths import plain_path
from trajspark.operators import compaction, drift, orphans, spikes
from trajspark.plans.shared import cut, shared_folder
from trajspark.plans.sizes import by_shuffle
from trajspark.plans.tables import table

FIELDS = ["observation.state", "action"]


def _implausible(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible(table(spark, folder, "frames"), FIELDS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _implausible(spark, folder).drop("reasons")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings counted per data set, field, dimension and reason."""
    found = _implausible(spark, folder).withColumn("reason", F.explode("reasons"))
    return found.groupBy("dataset_id", "field", "dim", "reason").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, folder, t) for t in ("frames", "episodes", "tasks", "info", "modality", "stored_files")))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, folder))


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.treatment(compaction.contributions(table(spark, folder, "frames"), table(spark, folder, "stored_files")))


def _consolidated(spark: SparkSession, folder: str) -> tuple[str, DataFrame, DataFrame]:
    """The folder of the consolidated files, the files, and the account of where each small file went."""
    import uuid

    to = f"{shared_folder(spark).rstrip('/')}/compact-{uuid.uuid4().hex}"
    return to, *compaction.consolidate(table(spark, folder, "frames"), table(spark, folder, "stored_files"), to)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listed files of which the consolidation put neither a block nor a row into any output."""
    _, _, account = _consolidated(spark, folder)
    listed = compaction.listed_files(table(spark, folder, "stored_files")).select("dataset_id", F.col("file").alias("data_path"))
    used = account.where("out_path is not null").select("dataset_id", F.col("file").alias("data_path")).distinct()
    return listed.join(by_shuffle(used), ["dataset_id", "data_path"], "left_anti")


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """The frame records read back from the consolidated files, each with the plain path of the small file it came from."""
    to, _, _ = _consolidated(spark, folder)
    rows = spark.read.schema(table(spark, folder, "frames").schema).parquet(to)
    return rows.select("dataset_id", "episode_index", "frame_index", plain_path(F.col("data_path")).alias("data_path"))


def p5_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Per data set and treatment: files, rows and the frame records they contribute."""
    return _plan(spark, folder).groupBy("dataset_id", "treatment").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_new").alias("n_new"))


def p5_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The consolidated files, of 128 MB in the shared folder: every frame record exactly once, which is checked."""
    return _consolidated(spark, folder)[1].select("n_files", "n_rows", "n_blocks", "n_bytes", "ok")


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    return cut(drift.revisions(table(spark, folder, "info_files")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(_valid(spark, folder))


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    """All revisions in one layout, with the fields outside it in `other`; arrays and maps as text.

    Renames that no rule knows are taken from the changes recorded.
    """
    valid = _valid(spark, folder)
    t = drift.unified(valid, drift.RENAMES + drift.learned_renames(drift.schema_changes(valid))).withColumn("other", F.map_from_entries(F.array_sort(F.map_entries("other"))))
    return t.select(*[F.to_json(c).alias(c) if k.startswith(("array", "map")) else c for c, k in t.dtypes])


def p7_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every field of every revision under the path it has in the table, with its type and plain value."""
    rows = drift.routed(_valid(spark, folder)).select("dataset_id", "revision", F.explode("m").alias("path", "v"))
    v = F.col("v")
    kind = F.when(v == "null", "null").when(v.isin("true", "false"), "boolean").when(v.startswith('"'), "string").when(v.startswith("["), "array").otherwise("number")
    rows = rows.withColumn("type", kind)
    text = F.when(F.col("type") == "string", F.get_json_object(F.concat(F.lit('{"x":'), v, F.lit("}")), "$.x")).when(F.col("type") == "boolean", v)
    number = F.when(F.col("type") == "number", v.try_cast("double")).when(F.col("type") == "array", F.json_array_length(v).cast("double"))
    return rows.select("dataset_id", "revision", "path", "type", text.alias("text_value"), number.alias("number_value"))


def p7_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """The registry of schemas, by their paths: how many revisions and data sets have each, and its first revision."""
    t = drift.schemas(_valid(spark, folder))
    return t.select(F.array_join("paths", " ").alias("paths"), "n_revisions", "n_sources", "first_revision")


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p4_found, p4_report, p5_found, p5_plan, p5_compact, p5_records, p7_found, p7_table, p7_fields, p7_schemas)}

_PATH = "regexp_replace(regexp_replace({0}, '/{{2,}}', '/', 'g'), '^(\\./)+', '')".format


def _number(field: str, value: str) -> str:
    """SQL that fills the fields of one number into column t, for widths 1 to 9."""
    out = "t"
    for w in range(1, 10):
        out = f"replace({out}, '{{{field}:0{w}d}}', lpad({value}::varchar, greatest({w}, length({value}::varchar))::int, '0'))"
    return f"replace({out}, '{{{field}}}', {value}::varchar)"


_REFS = f"""
with fe as (select dataset_id, episode_index, task_index, min(received_at) tm from frames where dataset_id is not null and episode_index is not null group by all),
ep as (select dataset_id, episode_index k, min(received_at) filter (deleted_at is null) live from episodes group by all),
ta as (select dataset_id, task_index k, min(received_at) filter (deleted_at is null) live from tasks group by all),
fi as (select dataset_id, {_PATH('path')} k, min(received_at) filter (deleted_at is null) live from stored_files where kind = 'video' group by all),
cur as (select dataset_id, arg_max(video_path, revision) t, arg_max(chunks_size, revision) cs from info where video_path is not null and chunks_size > 0 group by 1),
v0 as (select distinct e.dataset_id, e.k, e.live tm, m.original_key, cs, replace(t, '{{video_key}}', m.original_key) t from ep e join cur using (dataset_id) join modality m on m.dataset_id = e.dataset_id and m.modality = 'video' where e.live is not null),
v1 as (select * replace ({_number('episode_chunk', '(k // cs)')} as t) from v0),
v2 as (select * replace ({_number('chunk_index', '(k // cs)')} as t) from v1),
v3 as (select * replace ({_number('episode_index', 'k')} as t) from v2),
v4 as (select * replace ({_number('file_index', '((k % cs) // 3)')} as t) from v3),
r as (
 select 'frames' src_table, 'episode_index' ref_field, fe.dataset_id, fe.episode_index, fe.episode_index::varchar target_key, min(tm) tm, any_value(e.live) live, any_value(e.k) is not null hit from fe left join ep e on e.dataset_id = fe.dataset_id and e.k = fe.episode_index group by all
 union all
 select 'frames', 'task_index', fe.dataset_id, episode_index, task_index::varchar, tm, a.live, a.k is not null from fe left join ta a on a.dataset_id = fe.dataset_id and a.k = fe.task_index where task_index is not null
 union all
 select 'episodes', 'video_path', v.dataset_id, v.k, v.t, v.tm, f.live, f.k is not null from v4 v left join fi f on f.dataset_id = v.dataset_id and f.k = {_PATH('v.t')}
),
found as (
 select src_table, ref_field, dataset_id, episode_index, target_key, case when not hit then 'missing' when live is null then 'deleted' when live > tm then 'late' end state, strftime(tm, '%Y-%m') period from r
)
"""

_OWN = f"""
with listed as (select dataset_id, {_PATH('path')} data_path, min(received_at) tm from stored_files where kind = 'data' group by all),
held as (select dataset_id, {_PATH('data_path')} data_path, episode_index, frame_index, count(*) n from frames group by all),
ranked as (select h.*, row_number() over (partition by h.dataset_id, episode_index, frame_index order by tm, data_path) = 1 own from held h join listed using (dataset_id, data_path)),
per as (select dataset_id, data_path, sum(n) n_rows, count(*) filter (own) n_new from ranked group by all),
plan as (select dataset_id, data_path, coalesce(n_rows, 0) n_rows, coalesce(n_new, 0) n_new from listed left join per using (dataset_id, data_path))
"""

_WALK = """
with recursive valid as (
 select dataset_id, revision, arg_min(body, received_at) body from info_files where json_valid(body) group by all
), walk(dataset_id, revision, path, v) as (
 select dataset_id, revision, '', body::json from valid
 union all
 select dataset_id, revision, case when path = '' then k else path || '/' || k end, v -> ('/' || replace(replace(k, '~', '~0'), '/', '~1'))
 from (select dataset_id, revision, path, v, unnest(json_keys(v)) k from walk where json_type(v) = 'OBJECT')
), f as (
 select dataset_id, revision, path, v::varchar v,
  case json_type(v) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'number' end t
 from walk where json_type(v) <> 'OBJECT'
)"""

_DRIFT = _WALK + """, steps as (select dataset_id, revision, lag(revision) over (partition by dataset_id order by revision) was from valid),
both_ as (
 select s.dataset_id, s.revision, coalesce(a.path, b.path) path, a.v av, a.t tm, b.v bv, b.t bt
 from (select s.dataset_id, s.revision, f.path, f.v, f.t from steps s join f on f.dataset_id = s.dataset_id and f.revision = s.was) a
 full join (select s.dataset_id, s.revision, f.path, f.v, f.t from steps s join f on f.dataset_id = s.dataset_id and f.revision = s.revision where s.was is not null) b
 on a.dataset_id = b.dataset_id and a.revision = b.revision and a.path = b.path
 join steps s on s.dataset_id = coalesce(a.dataset_id, b.dataset_id) and s.revision = coalesce(a.revision, b.revision)
), pairs as (
 select dataset_id, revision, min(path) filter (bt is null) gone, min(path) filter (tm is null) come
 from both_ where (bt is null and tm <> 'null') or (tm is null and bt <> 'null')
 group by dataset_id, revision, coalesce(av, bv) having count(*) filter (bt is null) = 1 and count(*) filter (tm is null) = 1
)
select x.dataset_id, x.revision, path field_path,
 case when bt is null then case when p.gone is not null then 'renamed' else 'removed' end
  when tm is null then 'added' when tm <> bt then 'retyped' else 'reshaped' end change,
 coalesce(p.come, '') new_path
from both_ x
left join pairs p on p.dataset_id = x.dataset_id and p.revision = x.revision and bt is null and p.gone = path
left join pairs q on q.dataset_id = x.dataset_id and q.revision = x.revision and tm is null and q.come = path
where (bt is null) or (tm is null and q.come is null)
 or (tm <> 'null' and bt <> 'null' and (tm <> bt or (tm = 'array' and av <> bv and path like '%/shape')))
"""



def _renamed() -> str:
    """SQL that takes the fields through the renames, one after the other, where the new path is free."""
    out = ", g0 as (select dataset_id, revision, path, v, t from f)"
    for i, (old, new) in enumerate(drift.RENAMES):
        out += f", g{i + 1} as (select g.dataset_id, g.revision, case when g.path = '{old}' and not exists (select 1 from g{i} h where h.dataset_id = g.dataset_id and h.revision = g.revision and h.path = '{new}') then '{new}' else g.path end path, g.v, g.t from g{i} g)"
    return out


ORACLES = {
    "p7_fields": _WALK
    + _renamed()
    + f""" select dataset_id, revision, path, t as "type", case t when 'string' then v::json ->> '$' when 'boolean' then v end text_value,
 case t when 'number' then v::double when 'array' then json_array_length(v::json)::double end number_value from g{len(drift.RENAMES)}""",
    "p7_schemas": _WALK
    + """, p as (select dataset_id, revision, string_agg(path || ':' || t, ' ' order by path) paths from f group by all)
select paths, count(*) n_revisions, count(distinct dataset_id) n_sources, min(revision) first_revision from p group by 1""",
    "p4_found": _REFS + "select * from found where state is not null",
    "p4_report": _REFS + "select src_table, ref_field, state, period, count(*) n from found where state is not null group by all",
    "p5_records": f"""with listed as (select dataset_id, {_PATH('path')} f, min(received_at) tm from stored_files where kind = 'data' group by all),
h as (select distinct dataset_id, coalesce({_PATH('data_path')}, '') f, episode_index, frame_index from frames where dataset_id is not null and episode_index is not null and frame_index is not null)
select dataset_id, episode_index, frame_index, nullif(f, '') data_path from (
 select h.*, row_number() over (partition by dataset_id, episode_index, frame_index order by f = '', tm is null, tm, f) r from h left join listed using (dataset_id, f)) where r = 1""",
    "p5_found": _OWN + "select dataset_id, data_path from plan where n_new = 0",
    "p5_plan": _OWN + "select dataset_id, case when n_new = 0 then 'drop' when n_new = n_rows then 'copy' else 'rewrite' end treatment, count(*) n_files, sum(n_rows)::bigint n_rows, sum(n_new)::bigint n_new from plan group by all",
    "p7_found": _DRIFT,
}
