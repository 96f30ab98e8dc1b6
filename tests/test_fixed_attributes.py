"""Attributes that are fixed for a wine need no windows."""

from pricehist.operators import context, panel
from pricehist.sources import adapters as a


def test_features_are_the_same_without_the_windows(spark, small):
    s = a.series(spark, small)
    x, y = (context.window_features(panel.features(s, fixed)) for fixed in (False, True))
    assert x.columns == y.columns and x.exceptAll(y).count() == y.exceptAll(x).count() == 0 and x.count() == s.count()
    windows = [d._jdf.queryExecution().optimizedPlan().toString().count("first(") for d in (x, y)]
    assert windows[1] < windows[0]
