"""Registered queries do the reference's whole job: all observations and its default numbers of replicates."""

from skyobs.plans import catalog
from skyobs.sources import driver_tables as dt

DATA = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def test_replicates_and_observations(spark):
    power = QUERIES["pheno_power"](spark, DATA).collect()
    assert {r.n_sim for r in power} == {100}
    assert sum(r.n_acquisitions for r in power) == dt.obs(spark, DATA).count()
    scene = QUERIES["sim_scene"](spark, DATA)
    assert scene.count() == 20 * 4096
    gaps = [r.p_enough if "p_enough" in r.asDict() else list(r.asDict().values())[-1] for r in QUERIES["feasibility_gaps"](spark, DATA).collect()]
    assert any(round(p * 500, 3) % 1 for p in gaps)  # shares of 2,000 draws, not of 500
