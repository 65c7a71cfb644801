"""Registered queries: multi-step plans end to end."""
from pyspark.sql import functions as F

from dawnscore.plans import chains
from dawnscore.plans.q_blend import RESCUE
from dawnscore.plans.q_metrics import auc_sql
from dawnscore.plans.q_vectors import sims5
from dawnscore.plans.registry import query


@query("p01_flagship_macro_auc", "stream:s macro:f n_classes:i", RESCUE + f""",
v AS (SELECT class, y, pa, pb, round(p0, 9) AS blend, round(p, 9) AS rescued FROM rescued),
u AS (UNPIVOT v ON pa, pb, blend, rescued INTO NAME stream VALUE p)
--
SELECT stream, avg(auc) AS macro, count(*) AS n_classes FROM {auc_sql('u', 'stream, class', 'p')} GROUP BY 1""")
def _(v):
    return chains.flagship(v.spark, v.dir)


@query("p02_fused_scores", "row_id:s class:s fused:f")
def _(v):
    return chains.fused_scores(v.scores, "pa", "pb")


@query("p03_curated_pseudo", "row_id:s class:s fused:f")
def _(v):
    return chains.curated_pseudo(v.scores, sims5(v).drop("vec_id"))
