"""Column statistics, window-step statistics, their merging and their fingerprinted cache."""

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.operators import distribution
from trajspark.plans import files
from trajspark.plans.shared import cut

SIX = ("mean", "std", "min", "max", "q01", "q99")


PERCENTILES = {"q01": 0.01, "q99": 0.99}


def _labels(df: DataFrame, keys: list[str], *more: str) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {k: kinds[k] for k in keys} | {k: "string" if k == "feature" else "int" for k in more}


def vector_statistics(df: DataFrame, keys: list[str], vectors: list[str], exact: bool = True) -> DataFrame:
    """Six statistics per key, feature and dimension, for all features at once.

    Vectors are never exploded: see operators.distribution. Scalars are vectors of one. Nulls, NaN and
    infinities are left out; a series without values does not appear. Keys are strings or integers.
    Percentiles are exact unless `exact` is false, when they come with bounds.
    """
    kinds = dict(df.dtypes)
    column = lambda c: F.col(f"`{c}`") if kinds[c].startswith("array") else F.array(F.col(f"`{c}`").cast("double"))
    rows = df.select(*keys, *[column(c).alias(f"_v{i}") for i, c in enumerate(vectors)])
    stored = cut(rows.sortWithinPartitions(*keys) if keys else rows)
    return distribution.statistics(stored, _labels(df, keys, "feature", "dim"), distribution.vectors(len(keys), vectors), PERCENTILES, exact).drop("n")


def float_features(info: dict) -> list[str]:
    """Features whose declared type holds 'float'."""
    return [k for k, v in info.get("features", {}).items() if "float" in str(v.get("dtype", ""))]


def step_statistics(chunks: DataFrame, keys: list[str], chunk: str, exact: bool = True, less: str | None = None) -> DataFrame:
    """Six statistics per key, window step and dimension of a column of chunks (array of vectors), as vector_statistics.

    With `less` each vector of a chunk counts less the row's vector of that name.
    """
    more = [] if less is None else [F.col(less).alias("_r")]
    stored = cut(chunks.select(*keys, F.col(chunk).alias("_c"), *more).sortWithinPartitions(*keys))
    return distribution.statistics(stored, _labels(chunks, keys, "step", "dim"), distribution.chunks(len(keys), less is not None), PERCENTILES, exact).drop("n")


def merge_weighted(stats: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Statistics of a mixture: weighted mean, deviation by second moments, extremes of extremes.

    Weights are normalized within a group; rows without a mean are left out; q01 and q99 are the
    least and greatest given, not percentiles of the union. Negative variance by rounding is NaN.
    """
    rows = stats.where(F.col("mean").isNotNull() & F.col(weight).isNotNull())
    w = F.col(weight)
    moment = lambda x: F.sum(w * x) / F.sum(w)
    mean, second = moment(F.col("mean")), moment(F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))
    return rows.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(second - mean * mean).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"), F.min("q01").alias("q01"), F.max("q99").alias("q99"))


def of_first_source(stats: DataFrame, group: list[str], source: str, keys: list[str]) -> DataFrame:
    """Rows whose keys the first source of their group has."""
    first = stats.groupBy(*group).agg(F.min(source).alias("_first"))
    with_keys = stats.join(first, group).where(F.col(source) == F.col("_first")).select(*group, *keys).distinct()
    return stats.join(with_keys, [*group, *keys], "left_semi")


def problems(stats: DataFrame) -> DataFrame:
    """Rows of statistics that can't be right, with a reason each: missing, not finite, out of order."""
    num = [F.col(c) for c in SIX]
    bad = lambda c: c.isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    any_ = lambda cs: F.greatest(*[c.cast("int") for c in cs]) == 1
    m, s, lo, hi, a, b = num
    order = (s < 0) | (lo > m) | (m > hi) | (lo > a) | (a > b) | (b > hi)
    reason = F.when(any_([c.isNull() for c in num]), "missing").when(any_([bad(c) for c in num]), "not finite").when(order, "out of order")
    return stats.withColumn("reason", reason).where("reason is not null")


def uncovered(stats: DataFrame, modality: DataFrame) -> DataFrame:
    """Named slices that reach beyond the dimensions their source has statistics for."""
    dims = stats.where("modality = 'stats'").groupBy("dataset_id", "key").agg((F.max("dim") + 1).alias("dims"))
    groups = modality.where("modality in ('state', 'action') and end is not null").select("dataset_id", "modality", F.col("key").alias("group"), F.col("end").alias("stop"), F.coalesce("original_key", F.when(F.col("modality") == "state", F.lit("observation.state")).otherwise(F.lit("action"))).alias("key"))
    return groups.join(dims, ["dataset_id", "key"], "left").where("dims is null or stop > dims").select("dataset_id", "modality", "group", "stop", "dims")


# ---------------------------------------------------------------- cache

FINGERPRINTS = "__fingerprints__"


def fingerprint(spec: dict) -> str:
    """Hash of a specification, whatever the order of its keys: sha256:, then that of its compact JSON text."""
    return "sha256:" + hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def feature_spec(name: str, declared: dict) -> dict:
    """What the statistics of a stored feature depend on."""
    return {"feature": name, "dtype": declared.get("dtype"), "shape": declared.get("shape")}


#: How representations, kinds and formats of actions are named in fingerprints.
SPELLED = {"absolute": "ABSOLUTE", "delta": "DELTA", "relative": "RELATIVE", "joint": "NON_EEF", "pose": "EEF", "default": "DEFAULT", "rot6d": "XYZ_ROT6D", "rotvec": "XYZ_ROTVEC"}


def relative_specs(tag: str, action, state) -> dict[str, dict]:
    """What the statistics of each relative action key depend on, by key in sorted order.

    `action` and `state` are the modality configurations (plans.modalities); keys of other
    representations have no relative statistics.
    """
    out = {}
    for key in sorted(action.keys):
        c = action.action_of(key)
        if c.representation == "relative":
            out[key] = {"embodiment_tag": tag, "action_key": key, "action_delta_indices": list(action.deltas), "state_delta_indices": list(state.deltas), "rep": SPELLED[c.representation], "type": SPELLED[c.kind], "format": SPELLED[c.form], "state_key": c.state_key}
    return out


def write_json(path: str, data, indent: int = 4) -> None:
    """Writes a file whole or not at all (plans.files.write); what JSON can't hold is an error before anything is written."""
    files.write(path, json.dumps(data, indent=indent, allow_nan=True).encode())


def read_json(path: str) -> dict:
    """A cache file's object; {} if it is missing, empty, cut short or not an object."""
    try:
        data = json.loads(files.read(path))
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


class StatsCache:
    """Statistics per feature beside the fingerprint of what each was computed from."""

    def __init__(self, path: str):
        self.path = path

    def stale(self, specs: dict[str, dict], fields: tuple = SIX) -> list[str]:
        """Features without statistics of all fields, or whose fingerprint has changed."""
        data = read_json(self.path)
        prints = data.get(FINGERPRINTS) or {}
        return [k for k, s in specs.items() if not isinstance(data.get(k), dict) or not set(fields) <= data[k].keys() or prints.get(k) != fingerprint(s)]

    def refresh(self, specs: dict[str, dict], compute) -> list[str]:
        """Computes the stale features by compute(names) -> {name: {field: list}}; returns their names.

        Entries that only a fingerprint knows, and features no longer declared that have one, are
        dropped; keys of others stay. Nothing is written if nothing changes.
        """
        data = read_json(self.path)
        prints = dict(data.get(FINGERPRINTS) or {})
        phantom = [k for k in prints if k not in specs]
        todo = self.stale(specs)
        if not todo and not phantom:
            return []
        for k in phantom:
            prints.pop(k)
            if isinstance(data.get(k), dict):
                data.pop(k)
        for k, v in (compute(todo) if todo else {}).items():
            data[k] = v
            prints[k] = fingerprint(specs[k])
        write_json(self.path, data | {FINGERPRINTS: prints})
        return todo


def refresh_relative(path: str, specs: dict[str, dict], compute) -> list[str]:
    """Relative statistics by key, computed where the fingerprint differs; the file is always written. Returns the keys computed."""
    data = read_json(path)
    prints = dict(data.get(FINGERPRINTS) or {})
    todo = [k for k in sorted(specs) if k not in data or prints.get(k) != fingerprint(specs[k])]
    for k in todo:
        data[k], prints[k] = compute(k), fingerprint(specs[k])
    write_json(path, data | {FINGERPRINTS: prints})
    return todo


def to_tree(rows: list) -> dict:
    """{feature: {statistic: vector}} from collected rows (feature, dim, the six); as many rows as dimensions."""
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["feature"], r["dim"])):
        for s in SIX:
            out.setdefault(r["feature"], {}).setdefault(s, []).append(r[s])
    return out
