"""Queries over rollouts and tokens: advantages, objectives, importance weights, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import advantages, importance, losses, metrics, sampling
from quern.plans import views
from quern.plans.registry import query
from quern.plans.views import METRICS, ROLLOUTS, ROLLOUTS_DAY, TOKENS

R = {"r": ROLLOUTS}
D = {"r": ROLLOUTS_DAY}
T = {"t": TOKENS}
_BASE = "SELECT *, count(*) OVER g AS n, avg(score) OVER g AS mu, stddev_samp(score) OVER g AS sd FROM {r} WINDOW g AS (PARTITION BY uid)"


def _advantage(name: str, expr: str, day: bool = True, **options) -> None:
    """A response-level estimator over both kinds of groups; expr is its SQL over n, mu and sd."""
    for suffix, by, view in (("", "type", R), *((("_singletons", "day", D),) if day else ())):
        sql = f"SELECT event_id, {expr} AS advantage FROM ({_BASE})"
        query(sql, "advantage", digits=options.get("digits", 6), name=f"{name}{suffix}", **view)(lambda s, d, by=by: advantages.estimator(options.get("of", name))(views.rollouts(s, d, by), **options.get("args", {})).select("event_id", "advantage"))


_advantage("grpo", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END")
_advantage("grpo_no_std", "CASE WHEN n = 1 THEN score ELSE score - mu END", of="grpo", args={"by_std": False})
_advantage("grpo_vectorized", "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sqrt(greatest(sd * sd, 1e-6)) + 1e-6) END")
_advantage("rloo", "CASE WHEN n = 1 THEN score ELSE (score - mu) * n / (n - 1) END")
_advantage("rloo_vectorized", "CASE WHEN n = 1 THEN 0 ELSE (score - mu) * n / (n - 1) END")
_advantage("opo", "score - CASE WHEN n = 1 THEN 0 ELSE (sum(response_length * score) OVER (PARTITION BY uid)) / (sum(response_length) OVER (PARTITION BY uid)) END", day=False, digits=5)
_advantage("gpg", "(SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) FROM {r}) * CASE WHEN n = 1 THEN score ELSE score - mu END")
_advantage("grpo_passk", "CASE WHEN row_number() OVER (PARTITION BY uid ORDER BY score DESC, sample_idx) = 1 THEN (score - lead(score) OVER (PARTITION BY uid ORDER BY score DESC, sample_idx)) / (sd + 1e-6) ELSE 0 END", day=False, args={"singles": True})


@query(
    """WITH a AS (SELECT event_id, response_length AS w, score - CASE WHEN n = 1 THEN 0 ELSE mu END AS x FROM (SELECT *, count(*) OVER g AS n, avg(score) OVER g AS mu FROM {r} WINDOW g AS (PARTITION BY uid))),
 m AS (SELECT sum(w) AS n, sum(x * w) / sum(w) AS mean, sum(x * x * w) / sum(w) AS sq FROM a)
 SELECT event_id, (x - mean) / sqrt((sq - mean * mean) * n / (n - 1) + 1e-8) AS advantage FROM a, m""",
    "advantage", **D,
)
def rf_baseline(spark, d):
    return advantages.reinforce_plus_plus_baseline(views.rollouts(spark, d, "day")).select("event_id", "advantage")


_GAE = """WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM {t}), m AS (SELECT seq, max(pos) AS last FROM t GROUP BY seq),
 g AS (SELECT t.seq, t.pos, CASE WHEN mask = 1 THEN value ELSE 0.0 END AS nv, CASE WHEN mask = 1 THEN reward - value ELSE 0.0 END AS a FROM t JOIN m ON t.seq = m.seq AND t.pos = m.last
 UNION ALL SELECT t.seq, t.pos, CASE WHEN mask = 1 THEN value ELSE nv END, CASE WHEN mask = 1 THEN reward + {gamma} * nv - value + {gamma} * {lam} * a ELSE a END
 FROM g JOIN t ON t.seq = g.seq AND t.pos = g.pos - 1)
 SELECT g.seq, g.pos, a AS advantage, a + value AS ret FROM g JOIN t ON t.seq = g.seq AND t.pos = g.pos""".replace("{gamma}", "0.99").replace("{lam}", "0.95")


@query(_GAE, "advantage ret", "seq pos", **T)
def gae(spark, d):
    return advantages.gae(views.tokens(spark, d), 0.99, 0.95).select("seq", "pos", "advantage", "ret")


@query(f"SELECT seq, pos, (advantage - avg(advantage) FILTER (mask = 1) OVER ()) / sqrt(var_samp(advantage) FILTER (mask = 1) OVER () + 1e-8) AS white FROM ({_GAE.replace('SELECT g.seq, g.pos, a AS', 'SELECT mask, g.seq, g.pos, a AS')})", "white", "seq pos", **T)
def gae_whitened(spark, d):
    return advantages.masked_whiten(advantages.gae(views.tokens(spark, d), 0.99, 0.95), "advantage", "white").select("seq", "pos", "white")


@query(
    """WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM {t}), m AS (SELECT seq, max(pos) AS last FROM t GROUP BY seq),
 g AS (SELECT t.seq, t.pos, reward AS ret, CASE WHEN mask = 1 THEN reward ELSE 0.0 END AS carry FROM t JOIN m ON t.seq = m.seq AND t.pos = m.last
 UNION ALL SELECT t.seq, t.pos, reward + 0.99 * carry, CASE WHEN mask = 1 THEN reward + 0.99 * carry ELSE 0.0 END FROM g JOIN t ON t.seq = g.seq AND t.pos = g.pos - 1)
 SELECT seq, pos, ret FROM g""",
    "ret", "seq pos", **T,
)
def rf_plus_plus(spark, d):
    return advantages.reinforce_plus_plus(views.tokens(spark, d), 0.99).select("seq", "pos", "ret")


@query("SELECT seq, pos, sum(reward * mask) OVER w AS ret, sum(reward * mask) OVER w - 0.05 * mask AS advantage FROM {t} WINDOW w AS (PARTITION BY seq ORDER BY pos DESC)", "ret advantage", "seq pos", **T)
def remax(spark, d):
    return advantages.remax(views.tokens(spark, d).withColumn("baseline", F.lit(0.05))).select("seq", "pos", "ret", "advantage")


@query("SELECT seq, pos, reward - 0.1 * (old_logp - ref_logp) * mask AS penalised FROM {t}", "penalised", "seq pos", **T)
def kl_reward(spark, d):
    return advantages.kl_penalised(views.tokens(spark, d), 0.1, losses.kl("k1", "old_logp")).select("seq", "pos", "penalised")


@query("SELECT avg(k) AS current_kl FROM (SELECT sum((old_logp - ref_logp) * mask) / (sum(mask) + 1e-8) AS k FROM {t} GROUP BY seq)", "current_kl", **T)
def kl_batch(spark, d):
    return advantages.batch_kl(views.tokens(spark, d), losses.kl("k1", "old_logp"))


_WEIGHT = {"pow": "abs(score) ** 2", "max_min": "CASE WHEN score IN ((SELECT max(score) FROM {r}), (SELECT min(score) FROM {r})) THEN 1 ELSE 0 END", "max_random": "CASE WHEN score = (SELECT max(score) FROM {r}) THEN 0.4 ELSE 0.1 END"}
for _m, _w in _WEIGHT.items():
    query(f"SELECT event_id, greatest({_w} + 1e-8, 1e-8) AS weight FROM {{r}}", "weight", digits=4, name=f"pf_weights_{_m}", **R)(lambda s, d, m=_m: advantages.resampling_weights(views.rollouts(s, d), m).select("event_id", "weight"))


@query(
    "SELECT CAST(draw AS INT) AS draw, event_id, score FROM (SELECT i AS draw, CAST('0x' || substr(md5(i || ':7'), 1, 13) AS BIGINT) / 4503599627370496.0 * (SELECT sum(greatest(score * score + 1e-8, 1e-8)) FROM {r}) AS x FROM (SELECT unnest(range((SELECT count(*) FROM {r}))) AS i)) d"
    " ASOF JOIN (SELECT event_id, score, sum(w) OVER (ORDER BY event_id) - w AS lo FROM (SELECT event_id, score, greatest(score * score + 1e-8, 1e-8) AS w FROM {r})) c ON d.x >= c.lo",
    "score",
    **R,
)
def pf_resample(spark, d):
    rows = views.rollouts(spark, d).select("event_id", "score")
    return advantages.resample(rows, "event_id", rows.count(), 7).select("draw", "event_id", "score")


# --- divergences and objectives -----------------------------------------------------------------------------------

_R = "greatest(least(ref_logp - new_logp, 20), -20)"
_KL = {"k1": "new_logp - ref_logp", "abs": "abs(new_logp - ref_logp)", "k2": "0.5 * (new_logp - ref_logp) ** 2", "k3": f"greatest(least(exp({_R}) - {_R} - 1, 10), -10)"}
for _name, _sql in _KL.items():
    query(f"SELECT seq, pos, {_sql} AS kl FROM {{t}}", "kl", "seq pos", name=f"kl_{_name}", **T)(lambda s, d, n=_name: views.tokens(s, d).select("seq", "pos", losses.kl(n).alias("kl")))

_MM = "sum(({x}) * mask) / (sum(mask) + 1e-8)"
mm = lambda x: _MM.replace("{x}", x)
_D = "greatest(least(new_logp - old_logp, 20), -20)"
_PPO = f"""SELECT *, CASE WHEN adv < 0 THEN least(-adv * 3.0, greatest(p, c)) ELSE greatest(p, c) END AS loss FROM
 (SELECT *, {_D} AS dl, -adv * exp({_D}) AS p, -adv * greatest(least(exp({_D}), 1.28), 0.8) AS c FROM {{t}})"""


@query(f"SELECT {mm('loss')} AS loss, {mm('CASE WHEN c > p THEN 1 ELSE 0 END')} AS clip_fraction, {mm('-dl')} AS approx_kl, {mm('CASE WHEN greatest(p, c) > -adv * 3.0 AND adv < 0 THEN 1 ELSE 0 END')} AS clip_fraction_lower FROM ({_PPO})", "loss clip_fraction approx_kl clip_fraction_lower", **T)
def ppo_dual_clip(spark, d):
    return losses.vanilla(views.tokens(spark, d), 0.2, 0.28)


_AGG = {
    "token-mean": f"SELECT {mm('loss')} AS loss FROM ({_PPO})",
    "seq-mean-token-sum": f"SELECT avg(s) AS loss FROM (SELECT sum(loss * mask) AS s FROM ({_PPO}) GROUP BY seq)",
    "seq-mean-token-mean": f"SELECT avg(s) AS loss FROM (SELECT CASE WHEN sum(mask) = 0 THEN 0 ELSE sum(loss * mask) / sum(mask) END AS s FROM ({_PPO}) GROUP BY seq)",
    "seq-mean-token-sum-norm": f"SELECT sum(loss * mask) / (max(pos) + 1) AS loss FROM ({_PPO})",
}
for _mode, _sql in _AGG.items():
    query(_sql, "loss", name=f"loss_agg_{_mode.replace('-', '_')}", **T)(lambda s, d, m=_mode: losses.vanilla(views.tokens(s, d), 0.2, 0.28, mode=m).select("loss"))


@query(
    f"""WITH t AS (SELECT *, exp(least(sum((new_logp - old_logp) * mask) OVER s / greatest(sum(mask) OVER s, 1), 10)) AS r FROM {{t}} WINDOW s AS (PARTITION BY seq)),
 l AS (SELECT *, -adv * r AS p, -adv * greatest(least(r, 1.2), 0.8) AS c FROM t)
 SELECT (SELECT avg(x) FROM (SELECT CASE WHEN sum(mask) = 0 THEN 0 ELSE sum(greatest(p, c) * mask) / sum(mask) END AS x FROM l GROUP BY seq)) AS loss,
 {mm('CASE WHEN c > p THEN 1 ELSE 0 END')} AS clip_fraction, {mm('old_logp - new_logp')} AS approx_kl FROM l""",
    "loss clip_fraction approx_kl", **T,
)
def gspo(spark, d):
    return losses.gspo(views.tokens(spark, d))


@query(f"SELECT {mm('-new_logp * adv')} AS loss FROM {{t}}", "loss", **T)
def gpg_loss(spark, d):
    return losses.gpg(views.tokens(spark, d))


@query(
    f"""WITH t AS (SELECT * FROM {{t}}), m AS (SELECT {mm('adv')} AS ma, {mm('new_logp')} AS ml, greatest(1, CAST(floor(0.01 * sum(mask)) AS BIGINT)) AS k FROM t),
 c AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY round((adv - ma) * (new_logp - ml), 9) DESC, seq, pos) AS rn FROM t, m)
 SELECT {mm('-adv * exp(new_logp - old_logp) + CASE WHEN mask = 1 AND rn <= k THEN abs(new_logp - old_logp) ELSE 0 END')} AS loss, {mm('abs(new_logp - old_logp)')} AS abs_kl FROM c""",
    "loss abs_kl", **T,
)
def kl_cov(spark, d):
    return losses.kl_cov(views.tokens(spark, d), 0.01)


@query(
    f"""WITH t AS (SELECT *, new_logp - old_logp AS d FROM {{t}}), m AS (SELECT {mm('adv')} AS ma, {mm('new_logp')} AS ml, greatest(1, CAST(floor(0.01 * sum(mask)) AS BIGINT)) AS k FROM t),
 c AS (SELECT *, -adv * exp(d) AS p, -adv * greatest(least(exp(d), 1.2), 0.8) AS c, (adv - ma) * (new_logp - ml) AS cov FROM t, m),
 i AS (SELECT *, mask = 1 AND cov > 0.01 AND cov < 5 AND NOT c > p AS inside FROM c),
 r AS (SELECT *, inside AND row_number() OVER (PARTITION BY inside ORDER BY md5(seq || ':' || pos || ':0'), seq, pos) <= k AS picked FROM i)
 SELECT {mm('CASE WHEN picked THEN 0 ELSE greatest(p, c) END')} AS loss, {mm('CASE WHEN picked THEN 1.0 ELSE 0 END')} AS clip_fraction, {mm('-d')} AS approx_kl FROM r""",
    "loss clip_fraction approx_kl", **T,
)
def clip_cov(spark, d):
    return losses.clip_cov(views.tokens(spark, d), 0.01, bounds=(0.01, 5.0))


@query(f"SELECT seq, pos, (adv - ma) * (new_logp - ml) AS cov FROM {{t}}, (SELECT {mm('adv')} AS ma, {mm('new_logp')} AS ml FROM {{t}})", "cov", "seq pos", **T)
def covariance_terms(spark, d):
    return losses.covariance(views.tokens(spark, d)).select("seq", "pos", "cov")


@query(
    f"""WITH t AS (SELECT *, new_logp - old_logp AS dl, greatest(least(new_logp - old_logp, 0.2), -0.2) AS c FROM {{t}}),
 s AS (SELECT sum(sign(adv) * least(sign(adv) * dl, sign(adv) * c) * mask) / (sum(mask) + 1e-8) AS r, {mm('adv')} AS a FROM t GROUP BY seq)
 SELECT (SELECT avg(-a * exp(r)) FROM s) AS loss, {mm('CASE WHEN dl <> c AND adv > 0 THEN 1 ELSE 0 END')} AS clip_fraction, {mm('-dl')} AS approx_kl, {mm('CASE WHEN dl <> c AND adv < 0 THEN 1 ELSE 0 END')} AS clip_fraction_lower FROM t""",
    "loss clip_fraction approx_kl clip_fraction_lower", **T,
)
def geo_mean(spark, d):
    return losses.geo_mean(views.tokens(spark, d))


@query(
    f"""SELECT 0.5 * {mm('greatest(one, two)')} AS loss, {mm('CASE WHEN two > one THEN 1 ELSE 0 END')} AS clip_fraction FROM (SELECT mask, (v - r) ** 2 AS one, (greatest(least(v, value + 0.02), value - 0.02) - r) ** 2 AS two
 FROM (SELECT mask, value, value + adv / 10 AS v, reward AS r FROM {{t}}))""",
    "loss clip_fraction", **T,
)
def value_loss(spark, d):
    rows = views.tokens(spark, d).withColumns({"v": F.col("value") + F.col("adv") / 10, "ret": F.col("reward")})
    return losses.value_loss(rows, "v", clip=0.02)


@query("SELECT -sum(new_logp * m) / sum(m) AS loss FROM (SELECT new_logp, coalesce(lead(mask) OVER (PARTITION BY seq ORDER BY pos), 0) AS m FROM {t})", "loss", **T)
def sft_loss(spark, d):
    return losses.sft_loss(views.tokens(spark, d))


@query(f"SELECT p - 0.01 * e + 0.05 * k AS loss, p AS policy_loss, e AS entropy, k AS kl_loss FROM (SELECT {mm('loss')} AS p, {mm('abs(old_logp)')} AS e, {mm(_KL['k3'])} AS k FROM ({_PPO}))", "loss policy_loss entropy kl_loss", **T)
def composite_loss(spark, d):
    return losses.composite_loss(views.tokens(spark, d), F.abs("old_logp"), 0.01, 0.05, low=0.2, high=0.28).select("loss", "policy_loss", "entropy", "kl_loss")


# --- importance weights -------------------------------------------------------------------------------------------

_LOGR = {"token": "old_logp - rollout_logp", "sequence": "sum((old_logp - rollout_logp) * mask) OVER s", "geometric": "sum((old_logp - rollout_logp) * mask) OVER s / (sum(mask) OVER s + 1e-8)"}
_IS = """SELECT *, exp(greatest(least(lr, 20), -20)) AS w, max(CASE WHEN old_logp - rollout_logp < ln({veto}) AND mask = 1 THEN 1 ELSE 0 END) OVER s AS v,
 CASE WHEN old_logp - rollout_logp < ln({veto}) AND mask = 1 THEN 1 ELSE 0 END AS cat FROM (SELECT *, {lr} AS lr FROM {t} WINDOW s AS (PARTITION BY seq)) WINDOW s AS (PARTITION BY seq)"""
for _level, _lr in _LOGR.items():
    _src = _IS.replace("{lr}", _lr).replace("{veto}", "0.6")
    for _mode, _w in (("truncate", "least(w, 1.5)"), ("mask", "CASE WHEN w BETWEEN 1 / 1.5 AND 1.5 THEN w ELSE 0 END")):
        query(f"SELECT seq, pos, ({_w}) * (1 - v) * mask AS is_weight FROM ({_src})", "is_weight", "seq pos", name=f"is_{_level}_{_mode}", **T)(lambda s, d, a=_level, b=_mode: importance.importance_weights(views.tokens(s, d), 1.5, a, b, veto=0.6).select("seq", "pos", "is_weight"))
    _high, _low = {"token": (mm("CASE WHEN w > 1.5 THEN 1 ELSE 0 END"), mm("CASE WHEN w < 1 / 1.5 THEN 1 ELSE 0 END")), "geometric": (mm("CASE WHEN lr > ln(1.5) THEN 1 ELSE 0 END"), mm("CASE WHEN lr < ln(1 / 1.5) THEN 1 ELSE 0 END")), "sequence": ("(SELECT avg(CASE WHEN x > ln(1.5) THEN 1 ELSE 0 END) FROM s)", "(SELECT avg(CASE WHEN x < ln(1 / 1.5) THEN 1 ELSE 0 END) FROM s)")}[_level]
    _max, _min = ("max(w) FILTER (mask = 1)", "min(w) FILTER (mask = 1)") if _level == "token" else ("exp(least((SELECT max(x) FROM s), 20))", "exp((SELECT min(x) FROM s))")
    _sql = f"""WITH i AS (SELECT *, greatest(least(w, 1.5), 1 / 1.5) AS c FROM ({_src})), s AS (SELECT {mm('w')} AS w, max(v) AS v, max(lr) AS x FROM i GROUP BY seq)
 SELECT {mm('w')} AS mean, {_max} AS max, {_min} AS min, {_high} AS high, {_low} AS low, {mm('cat')} AS catastrophic, sqrt(greatest({mm('c * c')} - ({mm('c')}) ** 2, 0)) AS std,
 1 / (({mm('c * c')}) / ({mm('c')} + 1e-8) ** 2) AS ess, (SELECT avg(w) FROM s) AS seq_mean, (SELECT stddev_samp(w) FROM s) AS seq_std, (SELECT max(w) FROM s) AS seq_max, (SELECT min(w) FROM s) AS seq_min,
 (SELECT max(abs(w - 1)) FROM s) AS seq_max_deviation, (SELECT avg(CASE WHEN w > 1.5 THEN 1 ELSE 0 END) FROM s) AS seq_high, (SELECT avg(CASE WHEN w < 1 / 1.5 THEN 1 ELSE 0 END) FROM s) AS seq_low, (SELECT avg(v) FROM s) AS vetoed FROM i"""
    query(_sql, "mean max min high low catastrophic std ess seq_mean seq_std seq_max seq_min seq_max_deviation seq_high seq_low vetoed", digits=5, name=f"is_metrics_{_level}", **T)(lambda s, d, a=_level: importance.importance_metrics(views.tokens(s, d), 1.5, a, veto=0.6))


@query(
    f"""WITH i AS (SELECT *, CASE WHEN w BETWEEN 1 / 1.5 AND 1.5 THEN 0 ELSE 1 END AS o FROM ({_IS.replace('{lr}', _LOGR['token']).replace('{veto}', '0.6')}))
 SELECT {mm('o')} AS masked_fraction, (SELECT avg(CASE WHEN x > 0 THEN 1 ELSE 0 END) FROM (SELECT sum(o * mask) AS x FROM i GROUP BY seq)) AS seq_masked_fraction FROM i""",
    "masked_fraction seq_masked_fraction", **T,
)
def is_mask_metrics(spark, d):
    return importance.mask_metrics(views.tokens(spark, d), 1.5)


@query(
    f"""WITH t AS (SELECT *, old_logp - rollout_logp AS r FROM {{t}}), s AS (SELECT {mm('old_logp')} AS t, {mm('rollout_logp')} AS r FROM t GROUP BY seq)
 SELECT avg(exp(-t)) AS training_ppl, avg(-t) AS training_log_ppl, avg(exp(-r)) AS rollout_ppl, avg(-r) AS rollout_log_ppl, avg(r - t) AS log_ppl_diff, avg(abs(r - t)) AS log_ppl_abs_diff,
 max(r - t) AS log_ppl_diff_max, min(r - t) AS log_ppl_diff_min, avg(exp(r - t)) AS ppl_ratio, (SELECT {mm('-r')} FROM t) AS kl, (SELECT {mm('exp(r) - r - 1')} FROM t) AS k3_kl FROM s""",
    "training_ppl training_log_ppl rollout_ppl rollout_log_ppl log_ppl_diff log_ppl_abs_diff log_ppl_diff_max log_ppl_diff_min ppl_ratio kl k3_kl", **T,
)
def mismatch(spark, d):
    return importance.mismatch_metrics(views.tokens(spark, d))


@query("SELECT max(abs(a - b)) AS diff_max, avg(abs(a - b)) AS diff_mean, stddev_samp(abs(a - b)) AS diff_std, corr(a, b) AS pearson FROM (SELECT exp(old_logp) AS a, exp(rollout_logp) AS b FROM {t} WHERE mask = 1)", "diff_max diff_mean diff_std pearson", **T)
def debug_corr(spark, d):
    return importance.probability_metrics(views.tokens(spark, d))


@query("SELECT seq, sum(CASE WHEN floor(reward * 100) <> floor(value * 100) AND mask = 1 THEN 1 ELSE 0 END) AS differences FROM {t} GROUP BY seq", longs="seq differences", **T)
def token_diff(spark, d):
    rows = views.tokens(spark, d).withColumns({"x": F.floor(F.col("reward") * 100), "y": F.floor(F.col("value") * 100)})
    return importance.token_differences(rows, "x", "y")


# --- metrics ------------------------------------------------------------------------------------------------------


@query(
    """SELECT data_source, task_type, count(DISTINCT uid) AS n_prompts, count(DISTINCT uid) FILTER (keep) AS n_kept, avg(score) AS mean_score, avg(abs(adv)) AS mean_abs_adv FROM
 (SELECT *, count(*) OVER g = 1 OR stddev_pop(acc) OVER g > 0 AS keep, (score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END) / (CASE WHEN count(*) OVER g = 1 THEN 1 ELSE stddev_samp(score) OVER g END + 1e-6) AS adv FROM {r} WINDOW g AS (PARTITION BY uid))
 GROUP BY data_source, task_type""",
    "mean_score mean_abs_adv", "n_prompts n_kept", **R,
)
def group_report(spark, d):
    rows = sampling.informative(advantages.grpo(views.rollouts(spark, d)), "acc")
    own = rows.groupBy("data_source", "task_type", "uid").agg(F.max("keep").alias("keep"), F.sum("score").alias("s"), F.sum(F.abs("advantage")).alias("a"), F.count("*").alias("n"))
    return own.groupBy("data_source", "task_type").agg(F.count("*").alias("n_prompts"), F.count_if("keep").alias("n_kept"), (F.sum("s") / F.sum("n")).alias("mean_score"), (F.sum("a") / F.sum("n")).alias("mean_abs_adv"))


@query("SELECT data_source, avg(m) AS mean_score, count(*) AS n FROM (SELECT data_source, uid, avg(score) AS m FROM {r} GROUP BY data_source, uid) GROUP BY data_source", "mean_score", "n", **R)
def per_source_mean(spark, d):
    return metrics.per_source_mean(views.rollouts(spark, d))


@query("SELECT task_type, avg(m) AS pass_rate FROM (SELECT task_type, uid, avg(acc) AS m FROM {r} GROUP BY task_type, uid) GROUP BY task_type", "pass_rate", **R)
def pass_rate(spark, d):
    return metrics.pass_rate(views.rollouts(spark, d), ["task_type"], "uid")


@query("SELECT uid, CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END AS mean, CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END AS std, count(*) AS n FROM {r} GROUP BY uid", "mean std", "n", **D)
def group_mean_std(spark, d):
    return metrics.group_statistics(views.rollouts(spark, d, "day"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY uid) - 1 AS gid FROM {r}", longs="gid", **R)
def group_index(spark, d):
    return metrics.group_index(views.rollouts(spark, d)).select("event_id", "gid")


_ENDS = lambda x, n: f"('{n}/mean', avg({x})), ('{n}/max', max({x})), ('{n}/min', min({x}))"


def _long(parts: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({x} AS DOUBLE) AS value FROM {source}" for n, x in parts)


def _stats(x: str, n: str) -> list[tuple[str, str]]:
    return [(f"{n}/mean", f"avg({x})"), (f"{n}/max", f"max({x})"), (f"{n}/min", f"min({x})")]


_LEN = "CASE WHEN response_length > 0 THEN {} END"
_DATA = [
    *_stats(_LEN.format("score"), "critic/score"), *_stats(_LEN.format("acc"), "critic/rewards"), *_stats("response_length", "response_length"), ("response_length/clip_ratio", "avg(CASE WHEN response_length = 99 THEN 1 ELSE 0 END)"),
    *_stats(_LEN.format("response_length"), "response_length_non_aborted"), ("response_length_non_aborted/clip_ratio", "avg(CASE WHEN response_length > 0 THEN CASE WHEN response_length = 99 THEN 1 ELSE 0 END END)"),
    ("response/aborted_ratio", "avg(CASE WHEN response_length > 0 THEN 0 ELSE 1 END)"), *_stats("prompt_length", "prompt_length"), ("prompt_length/clip_ratio", "avg(CASE WHEN prompt_length = 7 THEN 1 ELSE 0 END)"),
]


@query(_long(_DATA, "{r}"), "value", **R)
def data_metrics(spark, d):
    return metrics.rollout_metrics(views.rollouts(spark, d), 99, 7)


_TOK = [*_stats("adv", "critic/advantages"), *_stats("reward", "critic/returns"), *_stats("value", "critic/values"), ("critic/vf_explained_var", "1 - var_samp(reward - value) / (var_samp(reward) + 1e-5)")]


@query(_long(_TOK, "(SELECT * FROM {t} WHERE mask = 1)"), "value", **T)
def token_metrics(spark, d):
    return metrics.token_metrics(views.tokens(spark, d), ret="reward")


@query("SELECT coalesce(nullif(t, ''), 'unknown') AS task, avg(score) AS mean, max(score) AS max, min(score) AS min, count(*) AS n, avg(acc) AS raw_mean, max(acc) AS raw_max, min(acc) AS raw_min FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN '' ELSE task_type END AS t FROM {r}) WHERE response_length > 0 GROUP BY 1", "mean max min raw_mean raw_max raw_min", "n", **R)
def per_task_metrics(spark, d):
    rows = views.rollouts(spark, d).withColumn("task_type", F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("task_type")))
    return metrics.per_task_metrics(rows)


_SECONDS = [("gen", 12.5), ("ref", 3.0), ("adv", 0.25), ("update_actor", 9.0), ("step", 30.0)]


@query(f"SELECT section, seconds, seconds * 1000 / CASE WHEN section = 'gen' THEN r WHEN section IN ('ref', 'values', 'adv', 'update_critic', 'update_actor') THEN a END AS per_token_ms FROM (VALUES {', '.join(f"('{a}', {b})" for a, b in _SECONDS)}) AS s(section, seconds), (SELECT sum(response_length) AS r, sum(response_length + prompt_length) AS a FROM {{r}})", "seconds per_token_ms", **R)
def timing_tokens(spark, d):
    return metrics.timing(spark.createDataFrame(_SECONDS, "section string, seconds double"), views.rollouts(spark, d))


@query("SELECT sum(response_length + prompt_length) AS tokens, sum(response_length + prompt_length) / (30.0 * 8) AS throughput FROM {r}", "throughput", "tokens", **R)
def throughput(spark, d):
    own = views.rollouts(spark, d).agg(F.sum(F.col("response_length") + F.col("prompt_length")).alias("tokens"))
    return own.select("tokens", metrics.throughput(F.col("tokens"), F.lit(30.0), 8).alias("throughput"))


@query("SELECT name, CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END AS value FROM {m} GROUP BY name", "value", digits=4, m=METRICS)
def reduce_metrics(spark, d):
    return metrics.reduce_named(views.metrics(spark, d))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score {o}) AS i, count(*) OVER (PARTITION BY uid) AS n FROM {r}"
for _name, _o in (("best", ""), ("worst", "DESC")):
    _sql = f"SELECT uid, size, sum(score * ((i / n) ** size - ((i - 1) / n) ** size)) AS expected FROM ({_RANKED.replace('{o}', _o)}), (SELECT unnest([2, 4, 8]) AS size) GROUP BY uid, size"
    query(_sql, "expected", "size", digits=4, name=f"{_name}_at_n", **R)(lambda s, d, w=_name == "worst": metrics.expected_extreme(views.rollouts(s, d), ["uid"], "score", [2, 4, 8], w))

_MAJ = """SELECT uid, pred, n, value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS rn FROM
 (SELECT uid, pred, count(*) AS n, min(sample_idx) AS first, min_by(acc, sample_idx) AS value FROM {r} GROUP BY uid, pred)) WHERE rn = 1"""


@query(_MAJ, "value", "pred n", **R)
def majority(spark, d):
    return metrics.majority(views.rollouts(spark, d), ["uid"], "pred", "acc", "sample_idx")


@query()
def bootstrap_at_n(spark, d):
    return metrics.bootstrap(views.rollouts(spark, d), ["uid"], "score", "sample_idx", 4)


def _report_sql() -> str:
    parts = []
    for var in ("acc", "score"):
        parts.append(f"SELECT data_source, '{var}' AS var, 'mean@' || n AS metric, m AS value FROM (SELECT data_source, uid, count(*) AS n, avg({var}) AS m FROM {{r}} GROUP BY ALL)")
        parts.append(f"SELECT data_source, '{var}', 'std@' || n, m FROM (SELECT data_source, uid, count(*) AS n, stddev_pop({var}) AS m FROM {{r}} GROUP BY ALL) WHERE n > 1")
        for name, o in (("best", ""), ("worst", "DESC")):
            ranked = f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {var} {o}, sample_idx) AS i, count(*) OVER (PARTITION BY uid) AS n FROM {{r}}"
            parts.append(f"SELECT data_source, '{var}', '{name}@' || size || '/mean', sum({var} * ((i / n) ** size - ((i - 1) / n) ** size)) FROM (SELECT *, unnest(list_distinct(list_concat(list_filter([2, 4, 8, 16, 32, 64, 128], lambda x: x < n), [n]))) AS size FROM ({ranked}) WHERE n > 1) GROUP BY data_source, uid, size")
        parts.append(f"SELECT data_source, '{var}', 'maj@' || of, value FROM (SELECT data_source, uid, of, value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY uid) AS of FROM (SELECT data_source, uid, pred, count(*) AS n, min(sample_idx) AS first, min_by({var}, sample_idx) AS value FROM {{r}} GROUP BY data_source, uid, pred)) WHERE rn = 1 AND of > 1)")
    return "SELECT data_source, var, metric, avg(value) AS value FROM (" + " UNION ALL ".join(parts) + ") GROUP BY data_source, var, metric"


@query(_report_sql(), "value", digits=8, **R)
def val_report(spark, d):
    return metrics.validation_report(views.rollouts(spark, d), ["acc", "score"])


@query(
    f"""SELECT data_source, var, metric, CASE WHEN var = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND n = max(n) OVER (PARTITION BY data_source, var) THEN 'val-core' ELSE 'val-aux' END AS section
 FROM (SELECT *, CAST(regexp_extract(metric, '@(\\d+)', 1) AS INT) AS n FROM ({_report_sql()}))""",
    **R,
)
def val_sections(spark, d):
    return metrics.sections(metrics.validation_report(views.rollouts(spark, d), ["acc", "score"])).select("data_source", "var", "metric", "section")


@query(f"SELECT {mm('reward')} AS mean, sum(reward * mask) AS total, var_samp(reward) FILTER (mask = 1) AS var FROM {{t}}", "mean total var", **T)
def masked_stats(spark, d):
    kept = F.when(F.col("mask") == 1, F.col("reward"))
    return views.tokens(spark, d).agg(losses.masked_mean(F.col("reward")).alias("mean"), F.sum(F.col("reward") * F.col("mask")).alias("total"), F.var_samp(kept).alias("var"))


@query("SELECT seq, pos, (reward - m) / sqrt(v + 1e-8) AS white FROM {t}, (SELECT avg(reward) AS m, var_samp(reward) AS v FROM {t} WHERE mask = 1)", "white", "seq pos", **T)
def masked_whiten(spark, d):
    return advantages.masked_whiten(views.tokens(spark, d), "reward", "white").select("seq", "pos", "white")


_KLSTEPS = "SELECT row_number() OVER (ORDER BY step) - 1 AS step, value / 40000 AS kl, 64 AS n FROM {m} WHERE name = 'perf/click/mean'"


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED ({_KLSTEPS}), r AS (SELECT step, 0.2 * (1 + greatest(least(kl / 0.1 - 1, 0.2), -0.2) * n / 10000) AS coefficient FROM s WHERE step = 0
 UNION ALL SELECT s.step, coefficient * (1 + greatest(least(kl / 0.1 - 1, 0.2), -0.2) * n / 10000) FROM r JOIN s ON s.step = r.step + 1) SELECT * FROM r""",
    "coefficient", "step", digits=8, m=METRICS,
)
def kl_controller(spark, d):
    rows = views.metrics(spark, d).filter("name = 'perf/click/mean'")
    rows = metrics.group_index(rows.withColumn("step", F.col("step")), "step").select(F.col("gid").alias("step"), (F.col("value") / 40000).alias("current_kl"), F.lit(64).alias("n"))
    return metrics.adaptive_coefficient(rows, 0.2, 0.1, 10000.0)


@query("SELECT min(s) AS least, max(s) AS most, max(s) - min(s) AS spread, avg(s) AS mean FROM (SELECT sum(24576 * response_length + response_length * response_length) AS s FROM {r} GROUP BY event_id % 8)", "mean", "least most spread", **R)
def seqlen_imbalance(spark, d):
    rows = views.rollouts(spark, d).select((F.col("event_id") % 8).alias("part"), (24576 * F.col("response_length").cast("long") + F.col("response_length") * F.col("response_length")).alias("cost"))
    return metrics.imbalance(rows, "part", "cost")


@query("SELECT p AS quantile, avg(CASE WHEN score > p THEN 1 ELSE 0 END) AS above, min(score) AS least, max(score) AS most FROM {r}, (SELECT quantile_cont(score, 0.9) AS p FROM {r}) GROUP BY p", "quantile above least most", **R)
def tail_ratio(spark, d):
    return metrics.tail_ratio(views.rollouts(spark, d), "score")


@query(f"SELECT sum(n) AS tokens, (sum(n) * (6.0 * {36 * (3 * 2560 * 9728 + 2560 * 128 * (2 * 32 + 2 * 8)) + 2 * 151936 * 2560}) + sum(n * n) * (12.0 * {128 * 32 * 36})) / 1e12 AS teraflops FROM (SELECT CAST(response_length AS DOUBLE) AS n FROM {{r}})", "tokens teraflops", digits=3, **R)
def mfu_dense(spark, d):
    own = metrics.dense_flops(views.rollouts(spark, d), 36, 2560, 32, 8, 128, 9728, 151936)
    return own.select("tokens", (F.col("flops") / 1e12).alias("teraflops"))


# --- dynamic sampling ---------------------------------------------------------------------------------------------


@query("SELECT event_id, uid FROM (SELECT *, count(*) OVER g = 1 OR stddev_pop(acc) OVER g > 0 AS keep FROM {r} WINDOW g AS (PARTITION BY uid)) WHERE keep", **R)
def group_filter(spark, d):
    return sampling.informative(views.rollouts(spark, d), "acc").filter("keep").select("event_id", "uid")


@query("SELECT event_id, uid FROM (SELECT *, count(*) OVER g = 1 OR stddev_pop(acc) OVER g > 0 AS keep FROM {r} WINDOW g AS (PARTITION BY uid)) WHERE keep", **D)
def group_filter_singletons(spark, d):
    return sampling.informative(views.rollouts(spark, d, "day"), "acc").filter("keep").select("event_id", "uid")


_COUNTS = "SELECT uid, min(task_type) AS task_type, min(event_id) AS first, count(*) = 1 OR stddev_pop(acc) > 0 AS keep FROM {r} GROUP BY uid"


@query(f"SELECT task_type, count(*) FILTER (NOT keep) AS filtered, count(*) FILTER (keep AND rn > 200) AS tossed, count(*) FILTER (keep AND rn <= 200) AS used FROM (SELECT *, row_number() OVER (PARTITION BY keep ORDER BY first) AS rn FROM ({_COUNTS})) GROUP BY task_type", longs="filtered tossed used", **R)
def sampling_counts(spark, d):
    return sampling.counts(views.rollouts(spark, d), "acc", 200, order="event_id")


@query(f"SELECT event_id FROM {{r}} WHERE uid IN (SELECT uid FROM (SELECT *, row_number() OVER (ORDER BY first) AS rn FROM ({_COUNTS}) WHERE keep) WHERE rn <= 200)", **R)
def batch_align(spark, d):
    return sampling.aligned(views.rollouts(spark, d), "acc", 200, order="event_id").select("event_id")


@query(f"SELECT uid FROM ({_COUNTS}) WHERE NOT keep", **R)
def filtered_uids(spark, d):
    return sampling.filtered_groups(views.rollouts(spark, d), "acc")
