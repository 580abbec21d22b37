import pytest
from pyspark.sql import functions as F

from wavebook.operators import columns
from wavebook.operators.columns import Span
from wavebook.plans.country_files import EVS_QUESTIONS, WVS_QUESTIONS, narrow


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, v1 int, v2 int, `v3_r` int, country string")


def test_numbered_names_keep_the_first_mention():
    assert columns.numbered("Q", 69, range(68, 71), "9_r") == ["Q69", "Q68", "Q70", "Q9_r"]


def test_question_lists():
    wvs, evs = columns.numbered("Q", *WVS_QUESTIONS), columns.numbered("v", *EVS_QUESTIONS)
    assert len(wvs) == len(set(wvs)) and wvs.count("Q69") == 1
    assert wvs.index("Q69") < wvs.index("Q64") and "Q89" in wvs and "Q90" not in wvs
    assert "v239_r" in evs and "v261_ppp" in evs and evs[:2] == ["v6", "v9"]


def test_spans_positions_and_repeats(df):
    assert columns.pick(df, Span("v1", "v3_r"), 1, "v2").columns == ["v1", "v2", "v3_r", "a"]


def test_missing_names(df):
    with pytest.raises(ValueError, match="nope"):
        columns.pick(df, "a", "nope")
    assert columns.pick(df, "a", "nope", strict=False).columns == ["a"]


def test_awkward_names(spark):
    df = spark.createDataFrame([(1.0, 2)], "`Gini (disposable income)` double, `gdp-pc.ppp` int")
    assert columns.pick(df, "gdp-pc.ppp").columns == ["gdp-pc.ppp"]
    assert columns.pick_renamed(df, gini="Gini (disposable income)").first().gini == 1.0


def test_moving_renaming_dropping(df):
    assert columns.to_front(df, "country").columns[0] == "country"
    assert columns.rename_at(df, {2: "x"}).columns == ["a", "x", "v2", "v3_r", "country"]
    assert columns.without(df, Span("v1", "v3_r")).columns == ["a", "country"]
    assert columns.reorder(df, [5, 4, 3, 2, 1]).columns == df.columns[::-1]
    with pytest.raises(ValueError):
        columns.reorder(df, [1, 2])


def test_hiding_and_showing(df):
    assert columns.visible(df, df.columns, hide=["a"]) == ["v1", "v2", "v3_r", "country"]
    assert columns.visible(df, ["v1"], hide=["v2"], reset=True) == ["a", "v1", "v3_r", "country"]
    assert columns.visible(df, ["v1"], show=["a"]) == ["a", "v1"]
    assert columns.visible(df, ["v1"], show=["a"], reset=True) == ["a"]


def test_later_columns_see_earlier_ones(df):
    row = columns.compute(df, x=F.col("a") + 1, y=F.col("x") * 10).first()
    assert (row.x, row.y) == (2, 20)


def test_country_columns_first(df):
    assert narrow(df, ["v1", "country", "a"]).columns == ["country", "v1", "a"]
