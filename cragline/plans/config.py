"""The arguments of a run: what is required, defaults, the region it works on, and the stages to force or leave out.

Defined results: a missing required value, an unknown argument, a value that is no number or below 0, or a path that
isn't there raises a ValueError before any job.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

#: The stages in their order, and those that a forced one forces in turn.
STAGES = ["step1", "step2", "step3", "step4", "step4b", "step5", "step5b", "step5c", "step5d"]
#: Arguments that go by another name than their field.
NAMES = {"austria_border": "border", "als_1m": "fine_dem", "copernicus_30m": "coarse_dem", "names_gpkg": "names", "bl_gpkg": "lands", "ambiguity_radius": "ambiguity_pair_radius"}
REQUIRED = ["workdir", "border", "fine_dem", "coarse_dem"]


@dataclass(frozen=True)
class RunConfig:
    workdir: str = ""
    border: str = ""
    fine_dem: str = ""
    coarse_dem: str = ""
    tmpdir: str = ""
    names: str = ""
    lands: str = ""
    test_region: str = ""
    test_prefix: str = ""
    # Distances in metres, numbers of candidates, class codes.
    threads: int = 8
    buffer_dist: float = 40000
    raw_peak_radius: float = 600
    raw_peak_candidates: int = 20
    near_calc_radius: float = 1000
    near_calc_candidates: int = 30
    db_no_peak_candidates: int = 20
    ambiguity_pair_radius: float = 800
    ambiguity_zdiff: float = 5
    ambiguity_soft_zdiff: float = 10
    ambiguity_keycol_dist: float = 40
    match_elev_link_radius: float = 250
    coord_bev_radius: float = 100
    coord_local_max_radius: float = 50
    coord_fcodes: tuple[int, ...] = (7301, 7302, 7303)
    skip: frozenset[str] = field(default_factory=frozenset)
    only: frozenset[str] = field(default_factory=frozenset)
    force: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        missing = [f"--{n.replace('_', '-')}" for n in REQUIRED if not getattr(self, n)]
        if missing:
            raise ValueError(f"required: {', '.join(missing)}")
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, (int, float)) and not (0 <= value < float("inf")):
                raise ValueError(f"{f.name} must be a number of 0 or more")
        unknown = (self.skip | self.only | self.force) - set(STAGES)
        if unknown:
            raise ValueError(f"no such stages: {', '.join(sorted(unknown))}")

    @property
    def region(self) -> str:
        """The areas that the run is cut to: those of the test region, if one is given."""
        return self.test_region or self.border

    def folder(self, kind: str) -> str:
        """A folder of the run ('intermediate', 'results'); runs with a test prefix have folders of their own."""
        return f"{self.workdir}/{kind}{'_' + self.test_prefix if self.test_prefix else ''}"

    def check(self, spark: SparkSession) -> RunConfig:
        """Raises if an input isn't there; looks at paths only."""
        paths = {n: getattr(self, n) for n in ("border", "fine_dem", "coarse_dem", "names", "lands", "test_region")}
        lacking = [f"{n} ({p})" for n, p in paths.items() if p and not _there(spark, p)]
        if lacking:
            raise ValueError(f"not found: {', '.join(lacking)}")
        return self

    def areas(self, spark: SparkSession) -> DataFrame:
        """area, rings of the region, a table of them."""
        return spark.read.parquet(self.check(spark).region)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse(arguments: list[str]) -> RunConfig:
    """The run that these arguments ask for: `--name value`, `--skip-step1`, `--only-step1`, `--force-...`, `--force-all`."""
    kinds = {f.name: f.default for f in fields(RunConfig)}
    given: dict = {"force": set(), "skip": set(), "only": set()}
    todo = list(arguments)
    while todo:
        raw = todo.pop(0)
        name = raw.removeprefix("--").replace("-", "_") if raw.startswith("--") else ""
        verb, _, stage = name.partition("_")
        if name == "force_all":
            given["force"] |= set(STAGES)
        elif verb in ("force", "skip", "only") and stage in STAGES and (verb == "force" or stage == "step1"):
            given[verb].add(stage)
        elif (name := NAMES.get(name, name)) in kinds and name not in given.keys() & {"force", "skip", "only"}:
            if not todo:
                raise ValueError(f"{raw} needs a value")
            given[name] = _value(raw, todo.pop(0), kinds[name])
        else:
            raise ValueError(f"unknown argument: {raw}")
    # what a forced first stage makes is read by the next three
    if "step1" in given["force"] and not given["only"]:
        given["force"] |= {"step2", "step3", "step4"}
    return RunConfig(**{k: frozenset(v) if isinstance(v, set) else v for k, v in given.items()})


def _value(name: str, text: str, like):
    try:
        if isinstance(like, tuple):
            return tuple(int(x) for x in text.split(","))
        return text if isinstance(like, str) else type(like)(text) if isinstance(like, int) and text.lstrip("-").isdigit() else float(text)
    except ValueError:
        raise ValueError(f"{name} {text} is no number") from None
