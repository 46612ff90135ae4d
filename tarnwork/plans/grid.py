"""A grid of configurations in one plan: each row carries the name of its configuration, and the tables are read once.

Configurations are a small relation (``CONFIG``). Findings meet those that let
them through, in one pass over the table, and are written once; budgets are
windows of (configuration, case), matching goes by (configuration, case, path)
with each configuration's own tolerance, and metrics are grouped by
configuration. So n configurations cost one scan, and the work of each beyond
it is that of the rows it lets through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank
from ..operators import experiments, matching, metrics
from ..values import SEVERITIES
from .scratch import written

#: least: the least severity that is let through; families: those let through, null all; most: findings of a case, null all.
CONFIG = "name string, tolerance int, least string, families array<string>, check_cwe boolean, most int"
#: Configurations at most: their table is broadcast.
MOST_CONFIGS = 10_000
APART = "\x1f"


class Grid(NamedTuple):
    #: name, family, tp, fp, fn, precision, recall, f2, scored
    families: DataFrame
    #: name, tp, fp, fn, precision, recall, macro_f2
    summary: DataFrame
    #: name, score, delta to the baseline's
    deltas: DataFrame


def _checked(configs: DataFrame) -> DataFrame:
    n, names, known = configs.select(F.count(F.lit(1)), F.count_distinct("name"), F.count_if(F.col("least").isNull() | F.col("least").isin(*SEVERITIES))).first()
    if n > MOST_CONFIGS:
        raise ValueError(f"{n} configurations are more than {MOST_CONFIGS}")
    if n != names or n != known:
        raise ValueError("configurations need distinct names and known severities")
    return F.broadcast(configs)


def keyed(findings: DataFrame, configs: DataFrame) -> DataFrame:
    """Each finding once for each configuration that lets it through, with name, tolerance and check_cwe.

    findings: case_id, path, finding_id, start_line, end_line, cwe, family, severity.
    """
    cut = F.coalesce(rank(F.col("least"), SEVERITIES), F.lit(len(SEVERITIES)))
    passes = (rank(F.col("severity"), SEVERITIES) <= cut) & F.coalesce(F.array_contains("families", F.col("family")), F.lit(True))
    met = findings.join(configs, passes)
    place = F.row_number().over(Window.partitionBy("name", "case_id").orderBy(rank(F.col("severity"), SEVERITIES), "path", "start_line", "finding_id"))
    kept = met.withColumn("__place", place).where(F.col("most").isNull() | (F.col("__place") <= F.col("most")))
    return kept.drop("__place", "least", "families", "most")


def run_grid(findings: DataFrame, truths: DataFrame, configs: DataFrame, baseline: str) -> Grid:
    """Metrics of every configuration over findings and truths, and their deltas to the baseline's macro F2.

    truths: case_id, path, truth, line, cwe, family, variant. A name the
    configurations do not have as baseline raises when deltas are read.
    """
    configs = _checked(configs)
    own = F.concat("name", F.lit(APART), "case_id")
    mine = written(keyed(findings, configs).withColumn("case_id", own))
    asked = written(truths.crossJoin(configs.select("name")).withColumn("case_id", own))
    pairs = matching.candidate_pairs(asked, mine, tolerance=F.col("tolerance"), check_cwe=F.col("check_cwe"))
    credited = matching.match_one_to_one(pairs)
    outcomes = matching.outcomes(asked, mine, credited).withColumn("name", F.substring_index("case_id", APART, 1))
    counts = metrics.counts_by_family(outcomes, ["name"])
    # a configuration that lets nothing through, over no truths, has no outcome and is still one of the grid
    families = written(metrics.family_metrics(counts))
    measured = metrics.overall_metrics(families, ["name"])
    none = configs.join(measured.select("name"), "name", "left_anti").select("name", *[F.lit(v).cast(dict(measured.dtypes)[c]).alias(c) for c, v in (("tp", 0), ("fp", 0), ("fn", 0), ("precision", 1.0), ("recall", 1.0), ("macro_f2", 0.0))])
    summary = written(measured.unionByName(none))
    return Grid(families, summary, experiments.deltas(summary.select("name", F.col("macro_f2").alias("score")), baseline))
