"""Schemas that drift between files: fingerprints, changes and migration by chained rules.

A file's schema is the set of (path, type) of its fields, known by its fingerprint. What lies
between two schemas, the step from one to the other, depends on the fingerprints alone: paths gone
and come, types changed, shapes to look at. It is found once a pair of fingerprints and each pair of
successive revisions is routed through it; only where the step says so are values compared. The
same way a fingerprint decides the renames that take a file to the current layout, where defaults
and casts follow. Every difference between successive valid revisions of a data set is reported.
"""

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELD = "array<struct<path:string,type:string,value:string>>"


def _refuse(text: str):
    raise ValueError(text)


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array"


def _plain(v):
    """A JSON value in one spelling: integral numbers as integers."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return int(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


def flatten(body: str | None) -> list[tuple[str, str, str]] | None:
    """The fields of a JSON text as sorted (path, type, value as JSON), or None if it isn't valid JSON.

    Objects are not fields, an empty object has none; a value at the top has the path ''.
    """
    if body is None:
        return None
    try:
        root = json.loads(body, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    out, todo = [], [("", root)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}/{k}" if path else k, x) for k, x in v.items()]
        else:
            out.append((path, _kind(v), json.dumps(_plain(v), sort_keys=True, ensure_ascii=False)))
    return sorted(out)


def fingerprint(fields: list[tuple[str, str, str]]) -> str:
    """Hash of the paths and types, without the values."""
    return hashlib.sha256("\n".join(f"{p}\t{t}" for p, t, _ in fields).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Step:
    """The way from one schema to another: what its fingerprints tell without a value.

    gone and come: (path, type) in one schema only. retyped: paths of another type on either side,
    nulls apart. shapes: arrays on both sides whose path ends in /shape.
    """

    gone: tuple[tuple[str, str], ...]
    come: tuple[tuple[str, str], ...]
    retyped: tuple[str, ...]
    shapes: tuple[str, ...]

    def changes(self, old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, str]]:
        """The changes (path, change, new path) of one file, from the values by path of its two revisions."""
        by: dict[str, tuple[list, list]] = {}
        for side, paths, of in ((0, self.gone, old), (1, self.come, new)):
            for p, t in paths:
                if t != "null":
                    by.setdefault(of[p], ([], []))[side].append(p)
        pairs = {g[0]: c[0] for g, c in by.values() if len(g) == len(c) == 1}
        taken = set(pairs.values())
        out = [(p, "renamed", pairs[p]) if p in pairs else (p, "removed", "") for p, _ in self.gone]
        out += [(p, "added", "") for p, _ in self.come if p not in taken]
        out += [(p, "retyped", "") for p in self.retyped]
        out += [(p, "reshaped", "") for p in self.shapes if old[p] != new[p]]
        return sorted(out)


def step_between(old: dict[str, str], new: dict[str, str]) -> Step:
    """The step from one schema (type by path) to another."""
    both = [p for p in old if p in new and "null" not in (old[p], new[p])]
    return Step(
        tuple((p, t) for p, t in old.items() if p not in new),
        tuple((p, t) for p, t in new.items() if p not in old),
        tuple(p for p in both if old[p] != new[p]),
        tuple(p for p in both if old[p] == new[p] == "array" and p.endswith("/shape")),
    )


def compare(old: list[tuple[str, str, str]], new: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The changes from one revision's fields to the next's."""
    step = step_between({p: t for p, t, _ in old}, {p: t for p, t, _ in new})
    return step.changes({p: v for p, _, v in old}, {p: v for p, _, v in new})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("path", pa.string()), ("type", pa.string()), ("value", pa.string())]))
    for b in batches:
        ds, rev, at, print_, fields = [], [], [], [], []
        for d, r, when, body in zip(*(b.column(i).to_pylist() for i in range(4))):
            f = flatten(body)
            if f is not None:
                ds.append(d), rev.append(r), at.append(when), print_.append(fingerprint(f))
                fields.append([{"path": p, "type": t, "value": v} for p, t, v in f])
        yield pa.RecordBatch.from_arrays([pa.array(ds, pa.string()), pa.array(rev, pa.int32()), pa.array(at, pa.int64()), pa.array(print_, pa.string()), pa.array(fields, kind)], names=["dataset_id", "revision", "at", "fingerprint", "fields"])


def revisions(files: DataFrame) -> DataFrame:
    """One row per valid revision: (dataset_id, revision, fingerprint, fields).

    A revision sent several times counts once, as first received (ties: by content). Bodies that
    are not JSON and rows without a data set or revision are left out.
    """
    rows = files.where("dataset_id is not null and revision is not null and body is not null").select("dataset_id", F.col("revision").cast("int").alias("revision"), F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)).alias("at"), "body")
    read = rows.mapInArrow(_read, f"dataset_id string, revision int, at long, fingerprint string, fields {FIELD}")
    return read.groupBy("dataset_id", "revision").agg(F.min_by(F.struct("fingerprint", "fields"), F.struct("at", F.to_json("fields"))).alias("x")).select("dataset_id", "revision", "x.*")


#: Schemas, or pairs of them, whose steps a task remembers; beyond that they are found anew.
MOST_SCHEMAS = 4096


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps: dict[tuple[str, str], Step] = {}
    types, values = lambda fields: {f["path"]: f["type"] for f in fields}, lambda fields: {f["path"]: f["value"] for f in fields}
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("dataset_id", "revision", "field_path", "change", "new_path")}
        for d, r, to_print, new, from_print, old in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (step := steps.get((from_print, to_print))) is None:
                if len(steps) >= MOST_SCHEMAS:
                    steps.clear()
                step = steps[from_print, to_print] = step_between(types(old), types(new))
            for path, change, to in step.changes(values(old), values(new)):
                for k, v in zip(out, (d, r, path, change, to)):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("dataset_id", pa.string()), ("revision", pa.int32()), ("field_path", pa.string()), ("change", pa.string()), ("new_path", pa.string())]))


def schema_changes(valid: DataFrame) -> DataFrame:
    """Every change between successive valid revisions of `revisions(...)`, given as a stored table.

    The fingerprints of a pair decide its step, which its values are routed through. Only the light
    keys are ordered per data set; the bodies are joined by revision afterwards, so that a data set
    with very many revisions does not gather its bodies in one task.
    """
    keys = valid.select("dataset_id", "revision").withColumn("was", F.lag("revision").over(Window.partitionBy("dataset_id").orderBy("revision"))).where("was is not null")
    old = valid.select("dataset_id", F.col("revision").alias("was"), F.col("fingerprint").alias("old_print"), F.col("fields").alias("old"))
    pairs = keys.join(old, ["dataset_id", "was"]).join(valid.select("dataset_id", "revision", "fingerprint", "fields"), ["dataset_id", "revision"])
    return pairs.select("dataset_id", "revision", "fingerprint", "fields", "old_print", "old").mapInArrow(_changes, "dataset_id string, revision int, field_path string, change string, new_path string")


def schemas(valid: DataFrame) -> DataFrame:
    """The registry: one row per fingerprint (fingerprint, n_revisions, n_sources, first_revision, paths)."""
    per = valid.groupBy("fingerprint").agg(F.count("*").alias("n_revisions"), F.count_distinct("dataset_id").alias("n_sources"), F.min("revision").alias("first_revision"), F.min(F.transform("fields", lambda f: F.concat(f["path"], F.lit(":"), f["type"]))).alias("paths"))
    return per


#: The current layout: column, its path, its type and what stands in where the field is absent.
LAYOUT = [
    ("codebase_version", "codebase_version", "string", None),
    ("robot_type", "robot_type", "string", None),
    ("total_episodes", "total_episodes", "bigint", None),
    ("total_frames", "total_frames", "bigint", None),
    ("total_tasks", "total_tasks", "bigint", None),
    ("total_videos", "total_videos", "bigint", None),
    ("chunks_size", "chunks_size", "bigint", "1000"),
    ("fps", "fps", "double", None),
    ("train_split", "splits/train", "string", None),
    ("data_path", "data_path", "string", None),
    ("video_path", "video_path", "string", None),
    ("mask_path", "mask_path", "string", None),
    ("action_dtype", "features/action/dtype", "string", None),
    ("action_shape", "features/action/shape", "array<int>", None),
    ("state_dtype", "features/observation.state/dtype", "string", None),
    ("state_shape", "features/observation.state/shape", "array<int>", None),
]

#: Migration steps in order, each (old path, new path): a step applies to a file that has the old
#: path and not yet the new one. Chains (a to b, b to c) are followed in this order.
RENAMES = [
    ("robot", "embodiment"),
    ("embodiment", "robot_type"),
    ("chunk_size", "chunks_size"),
    ("splits", "splits/train"),
    ("fps/state", "fps"),
    ("fps/video", "fps"),
    ("video_path_pattern", "video_path"),
    ("segmentation_path", "masks_path"),
    ("masks_path", "mask_path"),
    ("features/robot_action/dtype", "features/actions/dtype"),
    ("features/robot_action/shape", "features/actions/shape"),
    ("features/actions/dtype", "features/action/dtype"),
    ("features/actions/shape", "features/action/shape"),
]


def migration(paths: frozenset[str], renames: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The steps that files of one schema take: each (old path, new path) that applies, in order."""
    there, steps = set(paths), []
    for old, new in renames:
        if old in there and new not in there:
            there.remove(old)
            there.add(new)
            steps.append((old, new))
    return steps


def learned_renames(changes: DataFrame, layout: list[tuple] | None = None, known: list[tuple[str, str]] | None = None, least: int = 2, most: int = 10_000) -> list[tuple[str, str]]:
    """Renames for schemas no rule knows, from the changes recorded: (old path, new path), the last of a chain first.

    A rename counts if at least `least` data sets made it, its old path is neither in the layout nor in a
    known rule, it is the old path's commonest (ties: the lesser new path), and it leads to the layout, at
    once, through known rules, or through others learned. What comes to the driver are pairs of paths, not
    files; more than `most` are an error.
    """
    layout, known = LAYOUT if layout is None else layout, RENAMES if known is None else known
    made = changes.where("change = 'renamed'").groupBy("field_path", "new_path").agg(F.count_distinct("dataset_id").alias("n")).where(F.col("n") >= least)
    rows = made.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} renames were recorded")
    best: dict[str, tuple[int, str]] = {}
    for r in rows:
        best[r["field_path"]] = min(best.get(r["field_path"], (1, "")), (-r["n"], r["new_path"]))
    ends = {path for _, path, _, _ in layout} | {old for old, _ in known}
    out: list[tuple[str, str]] = []
    while more := sorted((old, new) for old, (_, new) in best.items() if old not in ends and new in ends):
        out = more + out  # farther from the layout, so earlier in the chain
        ends |= {old for old, _ in more}
    return out


def _route(renames: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        by_print: dict[str, list[tuple[str, str]]] = {}
        for b in batches:
            maps, taken = [], []
            for print_, fields in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if (steps := by_print.get(print_)) is None:
                    if len(by_print) >= MOST_SCHEMAS:
                        by_print.clear()
                    steps = by_print[print_] = migration(frozenset(f["path"] for f in fields), renames)
                m = {f["path"]: f["value"] for f in fields}
                for old, new in steps:
                    m[new] = m.pop(old)
                maps.append(list(m.items()))
                taken.append([f"{old} -> {new}" for old, new in steps])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(maps, kind), pa.array(taken, pa.list_(pa.string()))], names=["dataset_id", "revision", "fingerprint", "m", "steps"])

    return run


def routed(valid: DataFrame, renames: list[tuple[str, str]] | None = None) -> DataFrame:
    """(dataset_id, revision, fingerprint, m, steps): the fields of each revision by the paths its schema's renames lead to, as JSON texts."""
    return valid.select("dataset_id", "revision", "fingerprint", "fields").mapInArrow(
        _route(list(RENAMES if renames is None else renames)), "dataset_id string, revision int, fingerprint string, m map<string,string>, steps array<string>"
    )


def unified(valid: DataFrame, renames: list[tuple[str, str]] | None = None, layout: list[tuple] | None = None) -> DataFrame:
    """One consistent table of all revisions: the columns of the layout, all `other` fields, the steps each took.

    `layout` rows are (column, path, type, default) as in LAYOUT, `renames` pairs as in RENAMES; these are the
    defaults.

    The fingerprint of a revision decides the renames its map of fields is routed through; defaults and
    casts follow. `other` holds the fields that no column of the layout does, path to JSON text, so none is
    lost; a path renamed in a way no rule knows stays there under its own name. A value that can't be
    cast is null, named in `uncast`, and kept in `other` too. A number where the layout has an array is wrapped.
    A version that is a number is written like the others (2.1 as v2.1).
    """
    layout = LAYOUT if layout is None else layout
    routed_ = routed(valid, renames)
    cols, failed = [], []
    for name, path, kind, default in layout:
        raw = F.col("m")[path]
        raw = F.when(raw != "null", raw)
        text = F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x"), F.lit(default))
        if kind == "array<int>":
            value = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<int>")
        elif name == "codebase_version":
            value = F.when(text.rlike("^[0-9]"), F.concat(F.lit("v"), text)).otherwise(text)
        else:
            value = text.try_cast(kind)
        cols.append(value.alias(name))
        bad = value.isNull() | F.exists(value, lambda x: x.isNull()) if kind == "array<int>" else value.isNull()
        failed.append(F.when(text.isNotNull() & bad, F.lit(name)))
    uncast = F.array_compact(F.array(*failed))
    column_of = F.create_map(*[F.lit(x) for name, path, _, _ in layout for x in (path, name)])
    other = F.map_filter("m", lambda path, _: column_of[path].isNull() | F.array_contains(uncast, column_of[path]))
    return routed_.select("dataset_id", "revision", "fingerprint", *cols, other.alias("other"), "steps", uncast.alias("uncast"))
