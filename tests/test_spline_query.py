from panelforge.plans import model_queries
from panelforge.trajectories.spline import SplineClusters


def test_the_query_agglomerates_exactly_over_200_subjects(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("condensed")

    monkeypatch.setattr(SplineClusters, "_condense", refuse)
    out = model_queries.trajectories_spline(spark, "/root/testdata/sf0.01").groupBy().count().first()[0]
    assert out > 200 and SplineClusters().max_exact == 2000
