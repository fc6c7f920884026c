"""Scores by level, ensembles, reconciliation and losses, over the baselines as ensemble members."""

from __future__ import annotations

from pyspark.sql import functions as F

from caudal.catalog.domain import MEMBERS, TEST_MONTHS, closed_panel, frame, members, written_once
from caudal.catalog.registry import cte, query, r, rounded, with_
from caudal.functions.scores import add_up, ranked, score_columns
from caudal.operators import confidence, ensembles, levels
from caudal.operators.features import BASELINES

ENSEMBLES = [f"base_{m}" for m in ensembles.METHODS]
MODELS = [*MEMBERS, *ENSEMBLES]


def window(spark, sf) -> tuple[int, int]:
    last = closed_panel(spark, sf).last_mi
    return last - TEST_MONTHS + 1, last


def combined(spark, sf):
    """The members and their ensembles, kept for the queries that score them."""
    return written_once(spark, sf, "combined", lambda: ensembles.add_ensembles(members(spark, sf), {"base": MEMBERS}, 1))


_SUMS = "count(*) as n, sum(abs(real - p)) as ae, sum(real - p) as e, sum(real) as real, sum(p) as p"
_SCORES = ", ".join(["n", r("ae / n", "mae"), r("ae / nullif(real, 0)", "wape"), r("1 - ae / nullif(real, 0)", "accuracy"), r("e / nullif(real, 0) * 100", "bias_pct")])


def level_ctes(models: list[str], source: str = "members") -> dict:
    long = " union all ".join(f"select '{m}' as modelo, planta, sku, t, y as real, p_{m} as p from {source}" for m in models)
    return {
        "long": ((source,), long),
        "bottom": (("long", "pm", "span"), f"""
select k.modelo, pm.planta, pm.mi as t, pm.y as real, coalesce(s.p, 0.0) as p
from pm cross join span cross join (select distinct modelo from long) k
     left join (select modelo, planta, t, sum(p) as p from long group by 1, 2, 3) s on s.modelo = k.modelo and s.planta = pm.planta and s.t = pm.mi
where pm.mi > span.last_mi - {TEST_MONTHS}"""),
        "leveled": (("long", "bottom"), """
select 'sku' as nivel, t, modelo, '' as planta, real, p from long
union all select 'planta', t, modelo, planta, real, p from bottom
union all select 'total', t, modelo, '', sum(real), sum(p) from bottom group by t, modelo"""),
    }


cte("ensembled", ("members", "weights"), f"""
select m.*, ({' + '.join('p_' + m for m in MEMBERS)}) / 5 as p_base_mean,
       list_sort([{', '.join('p_' + m for m in MEMBERS)}])[3] as p_base_median,
       (list_sort([{', '.join('p_' + m for m in MEMBERS)}])[2] + list_sort([{', '.join('p_' + m for m in MEMBERS)}])[3] + list_sort([{', '.join('p_' + m for m in MEMBERS)}])[4]) / 3 as p_base_trimmed,
       {' + '.join(f'p_{m} * w_{m}' for m in MEMBERS)} as p_base_weighted
from members m join weights w on w.t = m.t""")
_inv = {m: f"1 / greatest(avg(abs(h.y - h.p_{m})), 1e-9)" for m in MEMBERS}
_total = " + ".join(_inv.values())
cte("weights", ("members",), f"""
select k.t, {', '.join(f'coalesce(({_inv[m]}) / ({_total}), 1.0::double / {len(MEMBERS)}) as w_{m}' for m in MEMBERS)}
from (select distinct t from members) k left join members h on h.t <= k.t - 1 group by k.t""")


@query("scores_by_level", with_("leveled", f"""
select nivel, modelo, rank() over (partition by nivel order by round(ae / real, 10))::int as rank, {_SCORES}
from (select nivel, modelo, {_SUMS} from leveled group by 1, 2)""", **level_ctes(BASELINES, "based"), based=(("frame", "span"), f"select * from frame, span where t > last_mi - {TEST_MONTHS}")))
def scores_by_level(spark, sf):
    first, last = window(spark, sf)
    return rounded(levels.score_models_by_level(closed_panel(spark, sf), frame(spark, sf), BASELINES, first, last))


@query("scores_by_month", with_("long cal", f"""
select cal.mes, modelo, {_SCORES} from (select t, modelo, {_SUMS} from long group by 1, 2) s join cal on cal.mi = s.t""", **level_ctes(MEMBERS)))
def scores_by_month(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(levels.scores_by_month(members(spark, sf), MEMBERS).withColumn("mes", panel.label(F.col("t"))).drop("t"))


@query("accuracy_by_month_pivot", with_("long cal", f"""
select cal.mes, {', '.join(r(f"(1 - sum(abs(real - p)) filter (where modelo = '{m}') / sum(real) filter (where modelo = '{m}')) * 100", m) for m in MEMBERS)}
from long join cal on cal.mi = long.t group by cal.mes""", **level_ctes(MEMBERS)))
def accuracy_by_month_pivot(spark, sf):
    panel = closed_panel(spark, sf)
    scores = levels.scores_by_month(members(spark, sf), MEMBERS).withColumn("mes", panel.label(F.col("t")))
    return rounded(levels.accuracy_pivot(scores, "mes", MEMBERS))


@query("last_test_months", with_("members", "select distinct t::int as t from members"))
def last_test_months(spark, sf):
    return frame(spark, sf).where(levels.last_months(closed_panel(spark, sf), TEST_MONTHS)).select("t").distinct()


@query("ensemble_weights", with_("weights", f"select t::int as t, {', '.join(r('w_' + m, 'w_' + m) for m in MEMBERS)} from weights"))
def ensemble_weights(spark, sf):
    return rounded(ensembles.past_weights(members(spark, sf), MEMBERS, 1))


@query("ensemble_forecasts", with_("ensembled", f"select planta, sku, t::int as t, {', '.join(r('p_' + m, 'p_' + m) for m in ENSEMBLES)} from ensembled"))
def ensemble_forecasts(spark, sf):
    return rounded(combined(spark, sf).select("planta", "sku", "t", *[f"p_{m}" for m in ENSEMBLES]))


@query("ensemble_scores", with_("leveled", f"""
select nivel, modelo, rank() over (partition by nivel order by round(ae / real, 10))::int as rank, {_SCORES}
from (select nivel, modelo, {_SUMS} from leveled group by 1, 2)""", **level_ctes(MODELS, "ensembled")))
def ensemble_scores(spark, sf):
    first, last = window(spark, sf)
    return rounded(levels.score_models_by_level(closed_panel(spark, sf), combined(spark, sf), MODELS, first, last))


_CONTROL = """
select pm.planta, pm.mi + 1 as t,
       case when pm.mi >= 17 then coalesce(m6 * (select a.y from pm a where a.planta = pm.planta and a.mi = pm.mi - 11)
            / nullif((select avg(a.y) from pm a where a.planta = pm.planta and a.mi between pm.mi - 17 and pm.mi - 12), 0), m6) else m6 end as control
from pm join (select planta, mi, avg(y) over (partition by planta order by mi rows between 5 preceding and current row) as m6 from pm) w on w.planta = pm.planta and w.mi = pm.mi"""
cte("control", ("pm",), _CONTROL)
cte("reconciled", ("members", "control"), """
select m.*, m.p_mean3 * coalesce(c.control / nullif(sum(m.p_mean3) over (partition by m.planta, m.t), 0), 1) as p_rec
from members m left join control c on c.planta = m.planta and c.t = m.t""")


@query("reconciled_forecasts", with_("reconciled", f"select planta, sku, t::int as t, {r('p_mean3', 'p_mean3')}, {r('p_rec', 'p_rec')} from reconciled"))
def reconciled_forecasts(spark, sf):
    out = levels.reconcile(members(spark, sf), closed_panel(spark, sf), 1, "p_mean3", "p_rec")
    return rounded(out.select("planta", "sku", "t", "p_mean3", "p_rec"))


@query("reconciled_scores", with_("leveled", f"""
select nivel, modelo, rank() over (partition by nivel order by round(ae / real, 10))::int as rank, {_SCORES}
from (select nivel, modelo, {_SUMS} from leveled group by 1, 2)""", **level_ctes(["mean3", "rec"], "reconciled")))
def reconciled_scores(spark, sf):
    first, last = window(spark, sf)
    panel = closed_panel(spark, sf)
    res = levels.reconcile(members(spark, sf), panel, 1, "p_mean3", "p_rec")
    return rounded(levels.score_models_by_level(panel, res, ["mean3", "rec"], first, last))


@query("mcs_losses", with_("leveled", f"""
select nivel, t::int as t, modelo, {r('sum(abs(real - p))', 'loss')}, count(*) as n from leveled group by 1, 2, 3""", **level_ctes(MODELS, "ensembled")))
def mcs_losses(spark, sf):
    first, last = window(spark, sf)
    sums = levels.period_losses(closed_panel(spark, sf), combined(spark, sf), MODELS, first, last)
    return rounded(sums.withColumn("n", F.col("n").cast("bigint")))


@query("sku_losses", with_("long", f"select t::int as t, modelo, {r('abs(real - p)', 'loss')} from long", **level_ctes(MEMBERS)))
def sku_losses(spark, sf):
    first, last = window(spark, sf)
    return rounded(levels.losses(closed_panel(spark, sf), members(spark, sf), MEMBERS, first, last, "sku"))


@query("model_confidence_set")
def model_confidence_set(spark, sf):
    first, last = window(spark, sf)
    losses = levels.period_losses(closed_panel(spark, sf), combined(spark, sf), MODELS, first, last)
    parts = [confidence.with_sets(confidence.model_confidence_set(losses.where(F.col("nivel") == level), MODELS)).withColumn("nivel", F.lit(level)) for level in ("sku", "planta", "total")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("level_rollup", with_("panel", f"""
select case when grouping(sku) = 0 then 'sku' when grouping(planta) = 0 then 'planta' else 'total' end as nivel, planta, sku, mi, {r('sum(y)', 'y')}
from panel group by grouping sets ((planta, sku, mi), (planta, mi), (mi))"""))
def level_rollup(spark, sf):
    return rounded(levels.roll_up(closed_panel(spark, sf).dense(), ["mi"], "y"))


@query("months_won", with_("leveled", """
select nivel, modelo, count(*) as meses from (
  select nivel, t, modelo, row_number() over (partition by nivel, t order by round(ae / real, 10), modelo) as pos
  from (select nivel, t, modelo, sum(abs(real - p)) as ae, sum(real) as real from leveled group by 1, 2, 3)) where pos = 1 group by 1, 2""", **level_ctes(MEMBERS)))
def months_won(spark, sf):
    first, last = window(spark, sf)
    sums = levels.level_sums(closed_panel(spark, sf), members(spark, sf), MEMBERS, first, last)
    return levels.months_won(sums.groupBy("nivel", "t", "modelo").agg(*add_up()), ["nivel", "t"])


@query("ranking_by_accuracy", with_("leveled", """
select modelo, max(case when nivel = 'sku' then pos end)::int as sku, max(case when nivel = 'planta' then pos end)::int as planta, max(case when nivel = 'total' then pos end)::int as total,
       round(avg(pos), 6) + 0.0::double as posicion_media
from (select nivel, modelo, rank() over (partition by nivel order by round(1 - sum(abs(real - p)) / sum(real), 10) desc) as pos from leveled group by 1, 2) group by modelo""", **level_ctes(MEMBERS)))
def ranking_by_accuracy(spark, sf):
    first, last = window(spark, sf)
    sums = levels.level_sums(closed_panel(spark, sf), members(spark, sf), MEMBERS, first, last).groupBy("nivel", "modelo").agg(*add_up())
    places = ranked(sums.select("nivel", "modelo", *score_columns()), ["nivel"], by="accuracy", descending=True)
    return rounded(places.groupBy("modelo").agg(
        *[F.max(F.when(F.col("nivel") == level, F.col("rank"))).alias(level) for level in levels.LEVELS], F.avg("rank").alias("posicion_media")
    ))
