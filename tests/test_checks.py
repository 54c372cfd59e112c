import dataclasses
import enum
import json

import numpy as np
import pytest

from trajspark.operators.inference import infer
from trajspark.operators.maintenance import deploy, template_faults
from trajspark.plans import checks, config
from trajspark.plans.checks import Spec

DDL = "id long, v array<float>, c array<array<double>>, t string, im struct<h:int,w:int,c:int,data:binary>"


def _df(spark, *rows):
    return spark.createDataFrame(rows, DDL)


GOOD = (1, [1.0, 2.0], [[1.0], [2.0]], "go", (1, 1, 3, b"abc"))
SPECS = {"v": Spec("vector", width=2), "c": Spec("chunk", horizon=2, width=1), "t": Spec("text"), "im": Spec("image", channels=3)}


def test_shapes(spark):
    assert checks.checked(_df(spark, GOOD), SPECS).count() == 1
    bad = [(2, [1.0], [[1.0], [2.0]], "go", (1, 1, 3, b"")), (3, [1.0, 2.0], [[1.0]], "go", (1, 1, 3, b"")), (4, [1.0, 2.0], [[1.0], [2.0, 3.0]], None, (1, 1, 1, b"")), (5, None, None, None, None)]
    got = {r["id"]: r["faults"] for r in checks.violations(_df(spark, GOOD, *bad), SPECS).collect()}
    assert sorted(got) == [2, 3, 4, 5] and got[2] == ["v is not 2 wide"] and got[3] == ["c has not 2 steps"] and len(got[4]) == 3
    with pytest.raises(Exception, match="not 2 wide"):
        checks.checked(_df(spark, bad[0]), SPECS).collect()
    with pytest.raises(TypeError, match="x is missing; t is string, not a vector"):
        checks.checked(_df(spark, GOOD), {"x": Spec("text"), "t": Spec("vector")})
    assert checks.strict(lambda d: d.select("t"), SPECS, {"t": Spec("text")})(_df(spark, GOOD)).count() == 1
    assert checks.with_time_axis(_df(spark, GOOD).schema, {"t": 2})["t"].dataType.simpleString() == "array<string>"
    twice = checks.repeated(_df(spark, GOOD), {"t": 2})
    assert twice.schema["t"].metadata["horizon"] == 2 and len(twice.first()["t"]) == 2
    with pytest.raises(ValueError):
        checks.with_time_axis(_df(spark, GOOD).schema, {"none": 2})
    with pytest.raises(Exception, match="wide|null|steps|channels"):  # a later choice of columns doesn't prune the checks
        checks.checked(_df(spark, bad[0]), SPECS).select("t").collect()
    assert checks.violations(_df(spark, GOOD).where("false"), SPECS).count() == 0


class Colour(enum.Enum):
    RED = "red"


@dataclasses.dataclass
class Run:
    name: str = "x"
    rate: float = 0.5
    sizes: list = dataclasses.field(default_factory=list)


def test_configurations(tmp_path):
    assert config.plain({"a": {3, 1}, Colour.RED: (np.float32(1), np.arange(2)), "r": Run()}) == {"a": [1, 3], "red": [1.0, [0, 1]], "r": {"name": "x", "rate": 0.5, "sizes": []}}
    path = str(tmp_path / "run.json")
    config.save(Run("y", 1.0, [2]), path)
    assert config.load(Run, path) == Run("y", 1.0, [2])
    json.dump({"odd": 1}, open(path, "w"))
    with pytest.raises(ValueError):
        config.load(Run, path)
    config.save_artifacts(str(tmp_path / "p"), {"k": 1}, {"s": np.zeros(1)}, {"tag": 3})
    assert config.load_artifacts(str(tmp_path / "p")) == ({"k": 1}, {"s": [0.0]}, {"tag": 3})
    with pytest.raises(FileNotFoundError):
        config.load_artifacts(str(tmp_path / "none"))
    assert config.seed_of({"SEED": "7"}) == 7 and config.seed_of({}) == 0
    with pytest.raises(ValueError):
        config.seed_of({"SEED": "x"})


def test_inference(spark):
    def _repeat():
        return lambda pdf: [np.tile(np.asarray(v, float), (3, 1)) for v in pdf["v"]]

    def _broken():
        return lambda pdf: []

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, v array<double>").repartition(3)
    got = {r["id"]: r["chunk"] for r in infer(df, ["id"], _repeat, batch=7).collect()}
    assert len(got) == 50 and got[4] == [[4.0, 1.0]] * 3
    with pytest.raises(Exception, match="chunks came back"):
        infer(df, ["id"], _broken).collect()
    assert infer(df.where("false"), ["id"], _repeat).count() == 0


def test_templates(spark, tmp_path):
    t = {"state": {"a": {"start": 0, "end": 3}}, "action": {"x": {"start": 0, "end": 1}, "y": {"start": 1, "end": 2}}, "video": {}, "annotation": {}}
    assert template_faults(t, 3, 2) == []
    assert len(template_faults({"state": t["state"], "action": {"x": {"start": 1, "end": 2}}}, 2, 3)) == 5
    for name, dims in (("a", (3, 2)), ("b", (2, 2))):
        (tmp_path / name / "meta").mkdir(parents=True)
        json.dump({"features": {"observation.state": {"shape": [dims[0]]}, "action": {"shape": [dims[1]]}}}, open(tmp_path / name / "meta" / "info.json", "w"))
    done, bad = deploy(spark, str(tmp_path), t)
    assert [d.rsplit("/", 1)[1] for d in done] == ["a"] and len(bad) == 1
    assert json.load(open(tmp_path / "a" / "meta" / "modality.json")) == t and not (tmp_path / "b" / "meta" / "modality.json").exists()
