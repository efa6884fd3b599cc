from strandline.plans import views
from strandline.plans.queries import contamination


def test_every_sample_has_an_estimate(spark):
    d = "/root/testdata/sf0.001"
    want = {r.cell for r in views.reads(spark, d).filter("allele < 2").select("cell").distinct().collect()}
    got = [r for r in contamination(spark, d).collect()]
    assert len(got) == len(want) > 4 and {r["sample"] for r in got} == want
    assert all(0 <= r.alpha <= 0.5 for r in got)
