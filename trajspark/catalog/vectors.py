"""Queries on vector columns: normalization, padding, encodings, rotations and poses, text."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions import arrays, normalize, poses, rotations, text
from trajspark.operators import stats
from trajspark.plans.ranks import numbered
from trajspark.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Quantities of an order line as a state vector of four, with its statistics beside it.
LINES = """
v as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) - 1 i, [l_quantity, l_extendedprice, l_discount, l_tax] v from lineitem),
st as (select [avg(l_quantity), avg(l_extendedprice), avg(l_discount), avg(l_tax)] mean, [stddev_pop(l_quantity), stddev_pop(l_extendedprice), stddev_pop(l_discount), stddev_pop(l_tax)] std,
 [min(l_quantity), min(l_extendedprice), min(l_discount), min(l_tax)] lo, [max(l_quantity), max(l_extendedprice), max(l_discount), max(l_tax)] hi from lineitem)
"""
_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *_COLUMNS)
    v = t.select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("i"), F.array(*_COLUMNS).alias("v"))
    of = lambda f: F.array(*[f(c) for c in _COLUMNS])
    s = t.agg(F.struct(of(F.avg).alias("mean"), of(F.stddev_pop).alias("std"), of(F.min).alias("min"), of(F.max).alias("max")))
    return v.withColumn("s", s.scalar()).select("l_orderkey", "l_linenumber", "i", "v", "s.*")


def _stats(df: DataFrame) -> dict:
    return {k: F.col(k) for k in ("mean", "std", "min", "max")}


def _sums(df: DataFrame, vector) -> DataFrame:
    """Sums per position and dimension of a vector, over all lines."""
    long = df.select("i", F.posexplode(vector).alias("dim", "x"))
    return long.groupBy("i", "dim").agg(F.round(F.sum("x"), 3).alias("total"), F.count("*").alias("n"))


def _sum_sql(vector: str, extra: str = "") -> str:
    return f"with {LINES}{extra} select i, dim, round(sum(x), 3) total, count(*) n from (select i, unnest(range(len(y))) dim, unnest(y) x from (select i, {vector} y from v, st)) group by all"


_MINMAX = "list_transform(range(1, 5), lambda k: case when abs(hi[k] - lo[k]) <= 1e-8 + 1e-5 * abs(lo[k]) then 0.0 else 2 * (v[k] - lo[k]) / (hi[k] - lo[k]) - 1 end)"
_ZSCORE = "list_transform(range(1, 5), lambda k: case when std[k] = 0 then v[k] else (v[k] - mean[k]) / std[k] end)"
_CLIP = "list_transform({0}, lambda y: greatest(-1, least(1, y)))".format


@query(_sum_sql(_MINMAX))
def norm_minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Min-max to [-1, 1] (133)."""
    df = _lines(spark, folder)
    return _sums(df, normalize.minmax(F.col("v"), F.col("min"), F.col("max")))


@query(_sum_sql("list_transform(range(1, 5), lambda k: (greatest(-1, least(1, v[k] / 50 - 1)) + 1) / 2 * (hi[k] - lo[k]) + lo[k])"))
def denorm_minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Back from [-1, 1] after clipping (134)."""
    df = _lines(spark, folder)
    return _sums(df, normalize.unminmax(F.transform("v", lambda x: x / 50 - 1), F.col("min"), F.col("max")))


@query(_sum_sql(_ZSCORE))
def norm_meanstd(spark: SparkSession, folder: str) -> DataFrame:
    """Z-scores (135)."""
    return _sums(_lines(spark, folder), normalize.meanstd(F.col("v"), F.col("mean"), F.col("std")))


@query(_sum_sql("list_transform(range(1, 5), lambda k: case when std[k] = 0 then v[k] else v[k] / 50 * std[k] + mean[k] end)"))
def denorm_meanstd(spark: SparkSession, folder: str) -> DataFrame:
    """Back from z-scores (136)."""
    return _sums(_lines(spark, folder), normalize.unmeanstd(F.transform("v", lambda x: x / 50), F.col("mean"), F.col("std")))


@query(_sum_sql(f"list_concat({_ZSCORE}, list_concat({_CLIP(_MINMAX)}, list_concat(list_transform(v, lambda x: sin(x)), list_transform(v, lambda x: cos(x)))))"))
def state_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """A state by each of its modes: z-scores unclipped, min-max clipped, sines and cosines (139)."""
    df = _lines(spark, folder)
    parts = [normalize.state(F.col("v"), mode, _stats(df)) for mode in ("meanstd", "minmax", "sincos")]
    return _sums(df, F.concat(*parts))


@query(
    f"with {LINES}, c as (select v.*, coalesce(lag(v, 1) over (partition by l_orderkey order by i), v) p from v), r as (select i, list_transform(range(1, 5), lambda k: v[k] - p[k]) v from c) select i, dim, round(sum(x), 3) total, count(*) n from (select i, unnest(range(len(y))) dim, unnest(y) x from (select i, list_concat({_CLIP(_ZSCORE)}, {_CLIP(_MINMAX)}) y from r, st)) group by all"
)
def action_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors relative to the one before, normalized, clipped in both modes (140)."""
    df = _lines(spark, folder)
    before = F.coalesce(F.lag("v").over(Window.partitionBy("l_orderkey").orderBy("i")), F.col("v"))
    df = df.withColumn("before", before)
    return _sums(df, F.concat(*[normalize.action(F.col("v"), mode, _stats(df), F.col("before")) for mode in ("meanstd", "minmax")]))


@query(_sum_sql("list_concat(v, v)"))
def pipeline_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Normalizing and back gives the vectors again, in both modes (141, 142, 123)."""
    df = _lines(spark, folder)
    return _sums(df, F.concat(*[normalize.unstate(normalize.state(F.col("v"), m, _stats(df)), m, _stats(df)) for m in ("meanstd", "minmax")]))


EMB = "x as (select vec_id, label, list_transform(embedding, lambda z: z::double) v from embeddings)"


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("v"))


def _explode(df: DataFrame, vector, digits: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(vector).alias("dim", "x")).withColumn("x", F.round("x", digits))


@query(f"with {EMB} select vec_id, unnest(range(128)) dim, round(unnest(list_concat(list_transform(v, lambda z: sin(z)), list_transform(v, lambda z: cos(z)))), 6) x from x")
def sincos_encode(spark: SparkSession, folder: str) -> DataFrame:
    """All sines, then all cosines (114)."""
    return _explode(_vectors(spark, folder), arrays.sin_cos(F.col("v")))


@query(f"with {EMB} select vec_id, unnest(range(80)) dim, unnest(list_concat(v, list_transform(range(16), lambda k: 0.0::double))) x, unnest(list_transform(range(80), lambda k: (k < 64)::int)) mask from x")
def pad_and_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors padded to 80 beside their mask (46)."""
    zipped = F.arrays_zip(arrays.pad_right(F.col("v"), 80).alias("x"), arrays.pad_mask(F.col("v"), 80).alias("mask"))
    return _vectors(spark, folder).select("vec_id", F.posexplode(zipped).alias("dim", "z")).select("vec_id", "dim", "z.x", "z.mask")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors with their place within their label."""
    return numbered(_vectors(spark, folder), ["label"], F.expr("vec_id div 1024"), ["vec_id"], "i")


@query(f"with {EMB}, r as (select *, row_number() over (partition by label order by vec_id) - 1 i from x), g as (select label, i // 5 chunk, list(v order by vec_id) c from r group by all), s as (select label, chunk, unnest(range(8)) step, c from g), u as (select label, chunk, step, (step < len(c))::int mask, coalesce(c[step + 1], list_transform(range(64), lambda k: 0.0::double)) v from s) select label, chunk, step, mask, round(list_sum(v), 4) total, round(list_sum(list_transform(v, lambda z, k: z * (k % 7))), 4) weighted from u")
def horizon_mask(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors of a label in chunks of five, padded to eight rows, with the mask of rows (46, 47)."""
    g = _ranked(spark, folder).groupBy("label", F.expr("i div 5").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("c"))
    zipped = F.arrays_zip(arrays.pad_rows(F.col("c"), 8, 64).alias("r"), arrays.pad_mask(F.col("c"), 8).alias("mask"))
    rows = g.select("label", "chunk", F.posexplode(zipped).alias("step", "z"))
    add = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda t, x: t + x), 4)
    return rows.select("label", "chunk", "step", "z.mask", add(F.col("z.r")).alias("total"), add(F.transform("z.r", lambda x, k: x * ((k + 1) % 7))).alias("weighted"))


_GROUPS = [("eef", 9), ("gripper", 1), ("joint", 7), ("rest", 47)]


@query(f"with {EMB}, g as (select * from (values ('eef', 1, 9), ('gripper', 10, 10), ('joint', 11, 17), ('rest', 18, 64)) t(\"group\", a, b)) select vec_id, \"group\", generate_subscripts(v[a:b], 1) - 1 dim, unnest(v[a:b]) x from x, g")
def split_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Groups joined to one vector and split again by their widths (44, 45)."""
    df = _vectors(spark, folder)
    parts = arrays.split_groups(F.col("v"), _GROUPS)
    again = arrays.split_groups(arrays.concat_groups(*parts.values()), _GROUPS)
    groups = F.explode(F.array(*[F.struct(F.lit(k).alias("group"), v.alias("v")) for k, v in again.items()]))
    return df.select("vec_id", groups.alias("g")).select("vec_id", "g.group", F.posexplode("g.v").alias("dim", "x"))


@query(f"with {EMB}, m as (select label, unnest(range(64)) dim, unnest(v) x from x), c as (select label, dim, avg(x) x from m group by all), p as (select b.label, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) s, sqrt(avg((a.x - b.x) * (a.x - b.x))) e from c a join c b on a.dim = b.dim and a.label = (select min(label) from c) group by all) select label, round(s, 5) cosine, round(e, 6) rmse from p")
def cosine_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine and root mean squared difference of each label's mean vector to the first label's (96f)."""
    c = _vectors(spark, folder).select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    c = c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("m"))
    pairs = c.withColumn("base", c.agg(F.min_by("m", "label")).scalar())
    diff = arrays.minus(F.col("base"), F.col("m"))
    return pairs.select("label", F.round(arrays.cosine(F.col("base"), F.col("m")), 5).alias("cosine"), F.round(F.sqrt(arrays.dot(diff, diff) / 64), 6).alias("rmse"))


_GS = f"""with {EMB}, a as (select vec_id, v[1] a1, v[2] a2, v[3] a3, v[4] b1, v[5] b2, v[6] b3, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) n from x),
b as (select vec_id, a1 / n x1, a2 / n x2, a3 / n x3, b1, b2, b3, (a1 * b1 + a2 * b2 + a3 * b3) / n d from a),
c as (select vec_id, x1, x2, x3, b1 - d * x1 y1, b2 - d * x2 y2, b3 - d * x3 y3 from b),
d as (select vec_id, x1, x2, x3, y1 / sqrt(y1 * y1 + y2 * y2 + y3 * y3) y1, y2 / sqrt(y1 * y1 + y2 * y2 + y3 * y3) y2, y3 / sqrt(y1 * y1 + y2 * y2 + y3 * y3) y3 from c),
m as (select vec_id, [x1, x2, x3, y1, y2, y3, x2 * y3 - x3 * y2, x3 * y1 - x1 * y3, x1 * y2 - x2 * y1] m from d)
"""


@query(_GS + "select vec_id, unnest(range(9)) dim, round(unnest(m), 5) x from m")
def rot6d_gram_schmidt(spark: SparkSession, folder: str) -> DataFrame:
    """Rotation matrices from six numbers (118)."""
    return _explode(_vectors(spark, folder), rotations.rot6d_to_matrix(F.col("v")), 5)


@query(_GS + "select vec_id, unnest(range(6)) dim, round(unnest(m[1:6]), 5) x from m")
def matrix_to_rot6d(spark: SparkSession, folder: str) -> DataFrame:
    """And back, which keeps the first two rows (119)."""
    return _explode(_vectors(spark, folder), rotations.matrix_to_rot6d(rotations.rot6d_to_matrix(F.col("v"))), 5)


# The rotation applied after turning Euler angles into a matrix.
CORRECTION = [0.0, 0.0, -1.0, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


@query(
    f"with {EMB}, r as (select vec_id, v, sin(v[4]) sa, cos(v[4]) ca, sin(v[5]) sb, cos(v[5]) cb, sin(v[6]) sc, cos(v[6]) cc from x) select vec_id, unnest(range(9)) dim, round(unnest([v[1], v[2], v[3], cb * sc, sb, -cb * cc, -(-sa * sb * sc + ca * cc), -sa * cb, -(sa * sb * cc + ca * sc)]), 6) x from r"
)
def euler_to_eef9d(spark: SparkSession, folder: str) -> DataFrame:
    """Six-number poses to nine numbers, with the fixed correction (125)."""
    return _explode(_vectors(spark, folder), rotations.pose6_to_pose9(F.col("v"), CORRECTION))


@query(f"with {EMB}, q as (select vec_id, list_transform(v[1:4], lambda z: z / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4])) q from x) select vec_id, unnest([0, 1, 2]) dim, round(unnest(list_transform(q[1:3], lambda z: z * 2 * acos(q[4]) / sqrt(1 - q[4] * q[4]))), 5) x from q")
def quat_axisangle(spark: SparkSession, folder: str) -> DataFrame:
    """Quaternions to axis times angle (126)."""
    df = _vectors(spark, folder).withColumn("q", F.slice("v", 1, 4))
    return _explode(df, rotations.quat_to_axis_angle(F.transform("q", lambda z: z / arrays.norm(F.col("q")))), 5)


@query(f"with {EMB} select vec_id, unnest(range(7)) dim, unnest([v[2], v[3], v[4], v[1], 1 - v[5], sign(2 * v[6] - 1), case when v[7] > 0.5 then 1.0 else -1.0 end]) x from x")
def quat_roll_gripper(spark: SparkSession, folder: str) -> DataFrame:
    """A quaternion's order changed, closedness and the gripper maps (127, 128, 51)."""
    v = F.col("v")
    out = F.concat(rotations.wxyz_to_xyzw(F.slice(v, 1, 4)), F.array(1 - v[4], rotations.gripper_sign(v[5]), rotations.gripper_threshold(v[6])))
    return _vectors(spark, folder).select("vec_id", F.posexplode(out).alias("dim", "x"))


def _poses(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector's first nine numbers as a pose, beside that of the vector before (a cycle per label)."""
    df = _vectors(spark, folder).select("vec_id", "label", F.slice("v", 1, 9).alias("p"))
    return df.withColumn("q", F.coalesce(F.lag("p").over(Window.partitionBy("label").orderBy("vec_id")), F.col("p")))


def _native_transform(c) -> object:
    return rotations.homogeneous(F.slice(c, 1, 3), rotations.rot6d_to_matrix(F.slice(c, 4, 6)))


_POSE = f"""with {EMB}, p0 as (select vec_id, label, v[1:3] t, v[4:9] r from x),
a as (select *, sqrt(r[1] * r[1] + r[2] * r[2] + r[3] * r[3]) n from p0),
b as (select vec_id, label, t, r[1] / n x1, r[2] / n x2, r[3] / n x3, r[4] b1, r[5] b2, r[6] b3, (r[1] * r[4] + r[2] * r[5] + r[3] * r[6]) / n d from a),
c as (select vec_id, label, t, x1, x2, x3, b1 - d * x1 y1, b2 - d * x2 y2, b3 - d * x3 y3 from b),
d as (select vec_id, label, t, x1, x2, x3, y1 / sqrt(y1 * y1 + y2 * y2 + y3 * y3) y1, y2 / sqrt(y1 * y1 + y2 * y2 + y3 * y3) y2, y3 / sqrt(y1 * y1 + y2 * y2 + y3 * y3) y3 from c),
m as (select vec_id, label, t, [x1, x2, x3, y1, y2, y3, x2 * y3 - x3 * y2, x3 * y1 - x1 * y3, x1 * y2 - x2 * y1] m from d),
w as (select vec_id, t, m, coalesce(lag(t) over (partition by label order by vec_id), t) t0, coalesce(lag(m) over (partition by label order by vec_id), m) m0 from m),
z as (select vec_id, unnest(range(12)) k, m, m0, t, t0 from w)
select vec_id, k dim, round(case when k % 4 < 3 then m0[1 + k // 4] * m[1 + k % 4] + m0[4 + k // 4] * m[4 + k % 4] + m0[7 + k // 4] * m[7 + k % 4]
 else m0[1 + k // 4] * (t[1] - t0[1]) + m0[4 + k // 4] * (t[2] - t0[2]) + m0[7 + k // 4] * (t[3] - t0[3]) end, 4) + 0.0 x from z
"""


@query(_POSE)
def pose_relative(spark: SparkSession, folder: str) -> DataFrame:
    """Rigid transforms relative to the one before, native (115, 116, 122)."""
    df = _poses(spark, folder)
    rel = rotations.relative_transform(_native_transform(F.col("q")), _native_transform(F.col("p")))
    return _explode(df, F.slice(rel, 1, 12), 4).withColumn("x", F.col("x") + 0.0)


@query(_POSE)
def pose_relative_arrow(spark: SparkSession, folder: str) -> DataFrame:
    """The same by NumPy kernels over Arrow batches, any format (116, 121)."""
    df = _poses(spark, folder)
    return _explode(df, F.slice(poses.relative_pose(F.col("q"), F.col("p"), "rot6d"), 1, 12), 4).withColumn("x", F.col("x") + 0.0)


def _entry(i: int, j: int) -> str:
    return f"m[{3 * i + j + 1}]"


def _euler_sql(order: str) -> str:
    """Degrees about fixed axes in the order given, from the matrix m."""
    i, j, k = ("xyz".index(c) for c in order[::-1])
    s = "" if (j - i) % 3 == 1 else "-"
    angles = [f"atan2(-({s}{_entry(j, k)}), {_entry(k, k)})", f"asin(greatest(-1, least(1, {s}{_entry(i, k)})))", f"atan2(-({s}{_entry(i, j)}), {_entry(i, i)})"]
    return "[" + ", ".join(f"degrees({a})" for a in angles[::-1]) + "]"


_QUAT = """case greatest(m[1], m[5], m[9], m[1] + m[5] + m[9]) when m[1] + m[5] + m[9] then [1 + m[1] + m[5] + m[9], m[8] - m[6], m[3] - m[7], m[4] - m[2]]
 when m[1] then [m[8] - m[6], 1 + m[1] - m[5] - m[9], m[4] + m[2], m[3] + m[7]] when m[5] then [m[3] - m[7], m[4] + m[2], 1 - m[1] + m[5] - m[9], m[8] + m[6]]
 else [m[4] - m[2], m[3] + m[7], m[8] + m[6], 1 - m[1] - m[5] + m[9]] end"""


@query(
    _GS
    + f""", q as (select vec_id, m, list_transform({_QUAT}, lambda z: z) q from m), r as (select vec_id, m, list_transform(q, lambda z: z / sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3] + q[4] * q[4])) q from q),
s as (select vec_id, m, q, sqrt(q[2] * q[2] + q[3] * q[3] + q[4] * q[4]) n, case when q[1] < 0 then -1 else 1 end g from r),
k as (select vec_id, unnest(['quat', 'rotvec', 'matrix', 'euler', {', '.join(f"'euler_{o}'" for o in poses.ORDERS)}]) kind, unnest([q, list_transform(q[2:4], lambda z: g * z / n * 2 * atan2(n, g * q[1])), m, {_euler_sql('xyz')}, {', '.join(_euler_sql(o) for o in poses.ORDERS)}]) v from s)
select vec_id, kind, unnest(range(len(v))) dim, round(unnest(v), 4) + 0.0 x from k"""
)
def rotation_conversions(spark: SparkSession, folder: str) -> DataFrame:
    """Each rotation in every encoding (120, 194)."""
    df = _vectors(spark, folder).select("vec_id", F.slice("v", 1, 6).alias("r"))
    cols = {k: poses.convert_rotation(F.col("r"), "rot6d", k) for k in poses.KINDS if k != "rot6d"}
    cols |= {f"euler_{o}": poses.convert_rotation(F.col("r"), "rot6d", "euler", target_order=o) for o in poses.ORDERS}
    long = df.select("vec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("v")) for k, c in cols.items()])).alias("z"))
    return long.select("vec_id", "z.kind", F.posexplode("z.v").alias("dim", "x")).withColumn("x", F.round("x", 4) + 0.0)


@query(
    _GS
    + f""", q as (select m.vec_id, m, x.v[7:9] t, {_QUAT} q from m join x using (vec_id))
select vec_id, 3 joints, round(t[1], 6) tx, round(t[2], 6) ty, round(t[3], 6) tz, round(q[2] / sqrt(list_dot_product(q, q)), 4) + 0.0 qx, round(q[1] / sqrt(list_dot_product(q, q)), 4) + 0.0 qw from q"""
)
def pose_accessors(spark: SparkSession, folder: str) -> DataFrame:
    """A pose's parts by name: translation, quaternion scalar last, and how many joints (124, 194)."""
    v = F.col("v")
    df = _vectors(spark, folder).select("vec_id", F.slice(v, 7, 3).alias("t"), poses.convert_rotation(F.slice(v, 1, 6), "rot6d", "quat", target_order="xyzw").alias("q"))
    named = df.withColumn("t", F.map_from_arrays(F.array(*[F.lit(k) for k in ("x", "y", "z")]), "t"))
    return named.select("vec_id", F.size("t").alias("joints"), *[F.round(F.col("t")[k], 6).alias(f"t{k}") for k in ("x", "y", "z")], (F.round(F.col("q")[0], 4) + 0.0).alias("qx"), (F.round(F.col("q")[3], 4) + 0.0).alias("qw"))


@query(
    _POSE.partition("z as (select")[0]
    + """l as (select vec_id, t, t0, m0, list_transform(range(9), lambda k: m0[1 + k // 3] * m[1 + k % 3] + m0[4 + k // 3] * m[4 + k % 3] + m0[7 + k // 3] * m[7 + k % 3]) r from w),
sk as (select *, [r[8] - r[6], r[3] - r[7], r[4] - r[2]] u from l), an as (select *, sqrt(u[1] * u[1] + u[2] * u[2] + u[3] * u[3]) / 2 s, (r[1] + r[5] + r[9] - 1) / 2 c from sk),
h as (select vec_id, t, t0, m0, f, case when s < 1e-9 then [1.0, 0.0, 0.0] else list_transform(u, lambda z: z / (2 * s)) end u, case when s < 1e-9 then 0.0 else atan2(s, c) * f end th from an, (select unnest([0.5, 0.75]) f)),
o as (select vec_id, t, t0, m0, f, [cos(th) + (1 - cos(th)) * u[1] * u[1], (1 - cos(th)) * u[1] * u[2] - sin(th) * u[3], (1 - cos(th)) * u[1] * u[3] + sin(th) * u[2],
 (1 - cos(th)) * u[1] * u[2] + sin(th) * u[3], cos(th) + (1 - cos(th)) * u[2] * u[2], (1 - cos(th)) * u[2] * u[3] - sin(th) * u[1],
 (1 - cos(th)) * u[1] * u[3] - sin(th) * u[2], (1 - cos(th)) * u[2] * u[3] + sin(th) * u[1], cos(th) + (1 - cos(th)) * u[3] * u[3]] g from h)
select vec_id, f::double as t, unnest(range(9)) dim, round(unnest(list_concat(list_transform([1, 2, 3], lambda k: t0[k] + (t[k] - t0[k]) * f), list_transform(range(6), lambda k: m0[3 * (k // 3) + 1] * g[1 + k % 3] + m0[3 * (k // 3) + 2] * g[4 + k % 3] + m0[3 * (k // 3) + 3] * g[7 + k % 3]))), 4) + 0.0 x from o"""
)
def slerp(spark: SparkSession, folder: str) -> DataFrame:
    """Poses halfway and three quarters between neighbours, along the shorter arc (108)."""
    df = _poses(spark, folder)
    halves = df.select("vec_id", "p", "q", F.explode(F.array(F.lit(0.5), F.lit(0.75))).alias("t"))
    long = halves.select("vec_id", "t", F.posexplode(poses.slerp_pose(F.col("q"), F.col("p"), F.col("t"), "rot6d")).alias("dim", "x"))
    return long.withColumn("x", F.round("x", 4) + 0.0)


@query(f"with {EMB}, w as (select unnest(range(16)) i), r as (select i, case when i < 4 then 0.0 when i >= 10 then 1.0 else (1 - exp(-6.0 * (i - 3) / 7.0)) / (1 - exp(-6.0)) end w from w), e as (select i, exp(0.005 * i) / (select sum(exp(0.005 * j)) from (select unnest(range(16)) j)) e from w) select r.i, round(w, 6) ramp, round(e, 6) ensemble from r join e on e.i = r.i")
def blend_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Ramp weights of an overlapping chunk and ensemble weights (130)."""
    one = table(spark, folder, "region").limit(1)  # any single row to hang constants on
    z = F.arrays_zip(arrays.ramp_weights(16, 4, 10, 6.0).alias("w"), arrays.exponential_weights(F.lit(16), 0.005).alias("e"))
    return one.select(F.posexplode(z).alias("i", "z")).select("i", F.round("z.w", 6).alias("ramp"), F.round("z.e", 6).alias("ensemble"))


@query(f"with {EMB}, b as (select x.vec_id, x.v, coalesce(lag(v) over (partition by label order by vec_id), v) q from x), m as (select vec_id, sum((p - t) * (p - t) * m) / (sum(m) + 1e-6) l from (select vec_id, unnest(list_transform(range(1, 65), lambda k: 0.75 * v[k] + 0.25 * q[k])) p, unnest(q) t, unnest(list_transform(range(64), lambda k: (k < 48)::double)) m from b) group by all) select vec_id, round(l, 6) loss from m")
def flow_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Masked mean squared error of a blend of noise and target (131)."""
    df = _vectors(spark, folder)
    df = df.withColumn("q", F.coalesce(F.lag("v").over(Window.partitionBy("label").orderBy("vec_id")), F.col("v")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k < 48).cast("double"))
    loss = arrays.masked_mean_square(arrays.blend(F.col("v"), F.col("q"), F.lit(0.25)), F.col("q"), mask)
    return df.select("vec_id", F.round(loss, 6).alias("loss"))


@query(f"with {EMB}, h as (select vec_id, v, {text.hash_sql('vec_id', 7)} / 4294967296.0 u from x) select vec_id, unnest(range(64)) dim, unnest(list_transform(v, lambda z: case when u < 0.3 then 0.0 else z end)) x from h")
def state_dropout(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors zeroed with a probability of 0.3, by a seeded hash (143)."""
    from trajspark.operators.sampling import excluded

    return _vectors(spark, folder).select("vec_id", F.posexplode(excluded(F.col("v"), F.col("vec_id"), 0.3, 7)).alias("dim", "x"))


@query(f"with {EMB}, q as (select vec_id, label, v[1:5] arm, v[6:6] gripper, v[7:13] joint from x) select vec_id, label, list_sum(arm) arm, list_sum(list_reverse(joint)) joint, joint[1] head, list_concat(gripper, arm)[2] next_, len(list_concat(list_concat(arm, gripper), joint)) width from q")
def nested_reshape(spark: SparkSession, folder: str) -> DataFrame:
    """Flat names to nested fields and back, named parts put together (48, 50, 196, 198, 199)."""
    v = F.col("v")
    df = _vectors(spark, folder).select("vec_id", "label", F.struct(F.slice(v, 1, 5).alias("arm"), F.slice(v, 6, 1).alias("gripper"), F.slice(v, 7, 7).alias("joint")).alias("state"))
    flat = df.select("vec_id", "label", "state.*")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    width = F.size(F.concat("arm", "gripper", "joint"))
    return flat.select("vec_id", "label", add(F.col("arm")).alias("arm"), add(F.reverse("joint")).alias("joint"), F.col("joint")[0].alias("head"), F.concat("gripper", "arm")[1].alias("next_"), width.alias("width"))


@query(f"with {EMB}, r as (select *, (row_number() over (partition by label order by vec_id) - 1) // 32 batch from x), b as (select label, batch, count(*) n, list(v order by vec_id) vs from r group by all), u as (select *, unnest(range(1, 65)) d from b) select label, batch, (d - 1)::int dim, n, round(list_sum(list_transform(vs, lambda v: v[d])), 4) total, round(vs[1][d], 6) as first, round(vs[-1][d], 6) as last from u")
def compress_dicts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of named values turned into named lists, in batches of 32 (49, 54)."""
    b = _ranked(spark, folder).groupBy("label", F.expr("i div 32").alias("batch")).agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "v"))), lambda r: r["v"]).alias("vs"))
    named = b.select("label", "batch", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: F.transform("vs", lambda v: v[d]))).alias("dim", "xs"))
    return named.select("label", "batch", "dim", "n", F.round(F.aggregate("xs", F.lit(0.0), lambda t, x: t + x), 4).alias("total"), F.round(F.col("xs")[0], 6).alias("first"), F.round(F.element_at("xs", -1), 6).alias("last"))


@query(f"with {EMB}, t as (select vec_id, unnest([0, 1, 2]) tile, v from x) select vec_id, tile, len(v) width, round(list_sum(v), 5) total, v[1] as first, v[64] as last from t")
def tile_batch(spark: SparkSession, folder: str) -> DataFrame:
    """An observation repeated along the batch (54a)."""
    rows = _vectors(spark, folder).select("vec_id", F.posexplode(F.array_repeat("v", 3)).alias("tile", "v"))
    return rows.select("vec_id", "tile", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x), 5).alias("total"), F.col("v")[0].alias("first"), F.col("v")[63].alias("last"))


@query(f"with {EMB}, u as (select label, vec_id, unnest(range(64)) dim, unnest(v) x, row_number() over (partition by label order by vec_id) - 1 i from x) select label, dim::int dim, arg_max(i, (x, -i)) argmax, arg_min(i, (x, i)) argmin from u group by all")
def arg_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of the greatest and least element of each dimension, the first on a tie (111b)."""
    long = _ranked(spark, folder).select("label", "i", F.posexplode("v").alias("dim", "x"))
    return long.groupBy("label", "dim").agg(F.max_by("i", F.struct(F.col("x"), -F.col("i"))).alias("argmax"), F.min_by("i", F.struct("x", "i")).alias("argmin"))


# ---------------------------------------------------------------- text


@query(r"select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g') as text from documents")
def language_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in lower case without punctuation (144)."""
    return table(spark, folder, "documents").select("doc_id", text.normalize_language(F.col("text")).alias("text"))


@query(f"with e as (select * from (select *, row_number() over (partition by dataset_id, episode_index order by received_at desc, \"length\" desc) rn from episodes where deleted_at is null) where rn = 1) select dataset_id, episode_index, case when len(tasks) > 0 then tasks[{text.hash_sql('episode_index', 11)} % len(tasks) + 1] end task from e")
def language_pick(spark: SparkSession, folder: str) -> DataFrame:
    """One of an episode's task texts by a seeded hash (145)."""
    from trajspark.plans.records import live_episodes

    return live_episodes(table(spark, folder, "episodes")).select("dataset_id", "episode_index", text.pick_one(F.col("tasks"), F.col("episode_index"), 11).alias("task"))


@query("select dataset_id, \"key\", replace('annotation.' || \"key\", 'annotation.', '') plain, modality || '.' || \"key\" as column_name from modality where modality = 'annotation'")
def annotation_key(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation names without their prefix, and column names (146, 41)."""
    m = table(spark, folder, "modality").where("modality = 'annotation'")
    return m.select("dataset_id", "key", text.annotation_key(F.concat(F.lit("annotation."), "key")).alias("plain"), F.concat_ws(".", "modality", "key").alias("column_name"))


#: Tags of the robot types, by name and value.
TAGS = {"LARK": "lark6_follower", "TWIN": "twin_lark", "ORRIN": "orrin_bench", "PIVOT": "pivot7", "HERON": "heron_wx", "FINCH": "finch7", "TENDER": "mobile_tender", "STILT": "stilt_walker"}


@query(
    "with t as (select * from (values "
    + ", ".join(f"('{k.lower()}', '{v}')" for k, v in TAGS.items())
    + ") t(name, val)) select i.dataset_id, i.revision, i.received_at::varchar is not null dated, coalesce((select val from t where name = lower(trim(i.robot_type))), (select val from t where val = lower(trim(i.robot_type)))) tag, coalesce((select val from t where upper(name) = split_part(i.data_path, '/', 1)), (case split_part(i.data_path, '/', 1) when 'frames' then 'lark6_follower' when 'data' then 'pivot7' end), 'unknown') env_tag from info i"
)
def tag_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Tags by name or value in any case, and by a path's first part (148, 149)."""
    i = table(spark, folder, "info")
    return i.select("dataset_id", "revision", F.col("received_at").isNotNull().alias("dated"), text.resolve_tag(F.col("robot_type"), TAGS).alias("tag"), text.tag_of_environment(F.col("data_path"), {"frames": "lark6_follower", "data": "pivot7"}, "unknown").alias("env_tag"))


@query("select dataset_id, task_index, 'user' as role, 3 parts, coalesce(task, '') as content from tasks where task_index is not null")
def chat_message(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of two images and the task's text (150)."""
    t = table(spark, folder, "tasks").where("task_index is not null")
    m = text.chat_message(F.coalesce("task", F.lit("")), 2)
    return t.select("dataset_id", "task_index", m["role"].alias("role"), F.size(m["content"]).alias("parts"), F.element_at(m["content"], -1)["value"].alias("content"))


@query("select dataset_id, \"key\" as plain, 'action.' || \"key\" as prefixed, \"start\" as value from modality where modality = 'action'")
def strip_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Map keys with a prefix added and taken off (152)."""
    m = table(spark, folder, "modality").where("modality = 'action'")
    keyed = text.add_prefix(F.create_map("key", "start"), "action.")
    both = m.select("dataset_id", F.explode(text.strip_prefix(keyed, "action.")).alias("plain", "value"), keyed.alias("k"))
    return both.select("dataset_id", "plain", F.map_keys("k")[0].alias("prefixed"), "value")


@query("select p_partkey, regexp_replace(lower(regexp_extract(trim(p_name || '_X..y==1.0'), '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1)), '[-_.]+', '-', 'g') as name, try_cast(nullif(regexp_extract('run/checkpoint-' || p_size, 'checkpoint-(\\d+)', 1), '') as int) step from part")
def names_and_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Package names in their canonical form and steps from checkpoint paths (206, 111c)."""
    p = table(spark, folder, "part")
    return p.select("p_partkey", text.canonical_name(F.concat("p_name", F.lit("_X..y==1.0"))).alias("name"), text.step_of_checkpoint(F.concat(F.lit("run/checkpoint-"), "p_size")).alias("step"))
