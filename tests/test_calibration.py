import pytest

from tessera.operators import calibration


def judged(spark, pairs):
    return spark.createDataFrame([(h, j, float(c)) for h, j, c in pairs], "human boolean, judged boolean, confidence double")


@pytest.mark.parametrize(("human", "judge", "kappa"), [("TTTTFFFF", "TTTTFFFF", 1.0), ("TTTTFFFF", "FFFFTTTT", -1.0), ("TTTTFFFF", "TTFFTTFF", 0.0), ("TTTT", "TTTT", 0.0)])
def test_kappa(spark, human, judge, kappa):
    df = judged(spark, [(h == "T", j == "T", 1.0) for h, j in zip(human, judge, strict=True)])
    assert calibration.kappa(df).first()["kappa"] == pytest.approx(kappa)


@pytest.mark.parametrize(("confidence", "passed", "ece"), [(1.0, 10, 0.0), (1.0, 0, 1.0), (1.0, 7, 0.3), (0.5, 5, 0.0)])
def test_calibration_error(spark, confidence, passed, ece):
    df = judged(spark, [(i < passed, True, confidence) for i in range(10)])
    assert calibration.calibration_error(df).first()["ece"] == pytest.approx(ece)
    bins = calibration.calibration_bins(df).collect()
    assert len(bins) == 10 and sum(b["weighted_gap"] for b in bins) == pytest.approx(ece)


VOTES = "array<struct<correctness:int,completeness:int,faithfulness:int,parse_error:boolean>>"


@pytest.mark.parametrize(
    ("votes", "correct", "share"),
    [
        ([(2, 2, 2)] * 3, True, 1.0), ([(0, 0, 0)] * 3, False, 0.0), ([(2, 2, 2), (0, 0, 0), (2, 2, 2)], True, 2 / 3),
        ([(2, 2, 1)] * 3, True, 1.0), ([(2, 2, 0)] * 3, False, 0.0), ([(0, 2, 2)] * 3, False, 0.0), ([None, (2, 2, 2), (2, 2, 2)], True, 2 / 3),
    ],
)
def test_majority(spark, votes, correct, share):
    rows = [(0, 0, 0, True) if v is None else (*v, False) for v in votes]
    df = spark.createDataFrame([("t", True, rows)], f"task_id string, human boolean, votes {VOTES}")
    got = calibration.majority(df).first()
    assert got["judged"] is correct and got["confidence"] == pytest.approx(share)


def test_floors_and_dimensions(spark):
    df = spark.createDataFrame([("t", True, [(2, 1, 0, False)] * 3), ("u", False, [(2, 2, 2, True), (1, 1, 1, False), (1, 1, 1, False)])], f"task_id string, human boolean, votes {VOTES}")
    grid = {r["floor"]: r for r in calibration.floor_grid(df, [(1, 1, 1), (1, 1, 0)]).collect()}
    assert grid["1/1/1"]["agreement"] == 0.0 and grid["1/1/0"]["agreement"] == 0.5
    scores = {(r["human"], r["dim"], r["score"]): r["n"] for r in calibration.dimension_scores(df).collect()}
    assert scores[False, "correctness", 1] == 2 and scores[True, "faithfulness", 0] == 3
    assert calibration.confusion(calibration.majority(df)).first()["fp"] == 1


def test_missing_votes_are_an_error(spark):
    audit = spark.createDataFrame([("t", [(1, 1, 1, False)])], f"task_id string, votes {VOTES}")
    humans = spark.createDataFrame([("t", True), ("u", True)], "task_id string, human boolean")
    ok = spark.createDataFrame([("t",)], "task_id string")
    assert calibration.labelled(ok, humans, audit).count() == 1
    with pytest.raises(Exception, match="no votes"):
        calibration.labelled(humans.select("task_id"), humans, audit).collect()
