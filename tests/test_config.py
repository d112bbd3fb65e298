"""Arguments of a run."""

import pytest

from cragline.plans.config import STAGES, RunConfig, parse

NEEDED = ["--workdir", "/w", "--austria-border", "/b", "--als-1m", "/f", "--copernicus-30m", "/c"]


def test_defaults_and_values():
    c = parse([*NEEDED, "--buffer-dist", "250.5", "--coord-fcodes", "1,2", "--ambiguity-radius", "7", "--raw-peak-candidates", "3"])
    assert (c.border, c.fine_dem, c.coarse_dem, c.region) == ("/b", "/f", "/c", "/b")
    assert (c.buffer_dist, c.coord_fcodes, c.ambiguity_pair_radius, c.raw_peak_candidates, c.near_calc_radius) == (250.5, (1, 2), 7, 3, 1000)
    assert c.folder("results") == "/w/results" and parse([*NEEDED, "--test-prefix", "t"]).folder("results") == "/w/results_t"
    assert parse([*NEEDED, "--test-region", "/r"]).region == "/r"


def test_forcing():
    assert parse([*NEEDED, "--force-step1"]).force == {"step1", "step2", "step3", "step4"}
    only = parse([*NEEDED, "--force-step1", "--only-step1"])
    assert only.force == {"step1"} and only.only == {"step1"}
    assert parse([*NEEDED, "--force-all", "--skip-step1"]).force == set(STAGES)
    assert parse([*NEEDED, "--force-step5c"]).force == {"step5c"}


@pytest.mark.parametrize("k", range(0, 8, 2))
def test_missing(k):
    with pytest.raises(ValueError, match="required"):
        parse(NEEDED[:k] + NEEDED[k + 2 :])


@pytest.mark.parametrize("more", [["--nothing", "1"], ["--force-step9"], ["--skip-step2"], ["--threads"], ["--threads", "x"], ["--buffer-dist", "-1"], ["--coord-fcodes", "a"], ["word"], ["--force", "step1"]])
def test_wrong(more):
    with pytest.raises(ValueError):
        parse([*NEEDED, *more])


def test_paths(spark, tmp_path):
    with pytest.raises(ValueError, match="test_region"):
        RunConfig(workdir="/w", border=str(tmp_path), fine_dem=str(tmp_path), coarse_dem=str(tmp_path), test_region=f"{tmp_path}/no").areas(spark)
