"""Queries of resamplers, partitioned schemes and single filter steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import lcg
from ..operators import schemes
from ..operators.models import BenchmarkModel, RsGarch
from ..operators.resample import fixed, kept_in_place, multinomial, replicated, residual, stratified, systematic
from ..operators.filters import p
from ..operators.stats import effective_size, repeated_means, resampling_variance, weighted_mean
from .kernels import EVENTS, ROOT_10, T, WEIGHED, Y, _TO0, _TO1, _garch_rows, _garch_sql, _w, lcg_sql, mean_sql, pdf_sql

N, PARTS, U = 5000, 4, 0.37


def u_of(part):
    """The scripted uniform of a sub-filter, inside (0, 1)."""
    return lcg(part.cast("long") * 7919 + 17) * 0.98 + 0.01


def u_sql(part: str) -> str:
    return f"({lcg_sql(f'(CAST({part} AS BIGINT) * 7919 + 17)')} * 0.98::DOUBLE + 0.01::DOUBLE)"


def index_of(part, target, j):
    return lcg(part.cast("long") * 1000003 + target * 10007 + j * 31)


INDEX = lcg_sql("(CAST(part AS BIGINT) * 1000003 + target * 10007 + j * 31)")


def bounds_sql(n: str, u: str, w: str = "w") -> str:
    """Columns lo and hi of systematic resampling, where cw and tw are known."""
    at = "least({n}, greatest(0, CAST(ceil(CAST({n} AS DOUBLE) * CAST({c} AS DOUBLE) / CAST(tw AS DOUBLE) - {u}) AS BIGINT)))"
    return at.format(n=n, c=f"(cw - {w})", u=u) + " AS lo, " + at.format(n=n, c="cw", u=u) + " AS hi"


def cum_sql(source: str, keys: str = "", order: str = "id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT *, sum(w) OVER ({part}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(w) OVER ({part.strip()}) AS tw FROM {source}"


def counted(df):
    return df.where("cnt > 0").select("id", F.col("cnt").cast("long").alias("cnt"), F.round("x", 6).alias("x"))


def points(df, *more):
    """Output rows of a scheme, in a form that SQL gives too."""
    return df.select("part", (F.col("id") % (1 << 32)).alias("point"), F.round("x", 6).alias("x"), F.round("weight", 12).alias("weight"), *more)


# resamplers


def systematic_global(spark, sf_dir):
    return counted(systematic(_w(spark, sf_dir), N, U))


def systematic_by_part(spark, sf_dir):
    out = systematic(_w(spark, sf_dir), schemes.share_of(N, PARTS, F.col("part")), u_of(F.col("part")), keys=["part"])
    return counted(out)


def stratified_query(spark, sf_dir):
    return counted(stratified(_w(spark, sf_dir), N, lambda i: lcg(i)))


def multinomial_query(spark, sf_dir):
    draws = spark.range(N).select(lcg("id").alias("u"))
    return counted(multinomial(_w(spark, sf_dir), draws, 1 << 13))


def residual_query(spark, sf_dir):
    return counted(residual(_w(spark, sf_dir), N, lambda i: lcg(i), 1 << 13))


def survivors_in_place(spark, sf_dir):
    """A set resampled to its own size: survivors stay in their slots, copies take the free ones."""
    rows = _w(spark, sf_dir)
    out = kept_in_place(systematic(rows, rows.count(), U).drop("lo", "hi"))
    return out.select("id", "source", F.round("x", 6).alias("x"))


_SHARE = f"({N // PARTS} + CASE WHEN part < {N % PARTS} THEN 1 ELSE 0 END)"
_C = f"c AS ({cum_sql('p')})"
_CP = f"c AS ({cum_sql('p', 'part')})"


def _asof(draws: str, rows: str, key: str, where: str) -> str:
    return f"SELECT c.{key}, count(*) AS cnt FROM ({draws}) d ASOF JOIN (SELECT *, cw - {where} AS low FROM {rows} WHERE {where} > 0) c ON d.pt >= c.low GROUP BY c.{key}"


_STRATUM = "least({n}, CAST(floor({a}) AS BIGINT) + CASE WHEN {a} - floor({a}) > {u} THEN 1 ELSE 0 END)"


def _stratified_sql() -> str:
    def t(c):
        a = f"({N}::DOUBLE * CAST({c} AS DOUBLE) / CAST(tw AS DOUBLE))"
        return _STRATUM.format(n=N, a=a, u=lcg_sql(f"floor({a})"))

    return f"WITH {WEIGHED}, {_C}, k AS (SELECT id, x, {t('cw')} - {t('(cw - w)')} AS cnt FROM c) SELECT id, CAST(cnt AS BIGINT) AS cnt, round(x, 6) AS x FROM k WHERE cnt > 0"


_MULTINOMIAL = f"""WITH {WEIGHED}, {_C},
 d AS (SELECT CAST(floor({lcg_sql('i')} * CAST((SELECT sum(w) FROM p) AS DOUBLE)) AS BIGINT) AS pt FROM range({N}) r(i)),
 k AS ({_asof('SELECT pt FROM d', 'c', 'id', 'w')})
 SELECT k.id, k.cnt, round(p.x, 6) AS x FROM k JOIN p ON k.id = p.id"""

_IN_PLACE = f"""WITH {WEIGHED}, {_C}, k AS (SELECT id, x, hi - lo AS cnt FROM (SELECT *, {bounds_sql('(SELECT count(*) FROM p)', f'{U}::DOUBLE')} FROM c)),
 slots AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM k WHERE cnt = 0),
 extra AS (SELECT id, x, unnest(range(cnt - 1)) AS i FROM k WHERE cnt > 1),
 copies AS (SELECT id, x, row_number() OVER (ORDER BY id, i) AS rank FROM extra)
 SELECT id, id AS source, round(x, 6) AS x FROM k WHERE cnt > 0
 UNION ALL SELECT slots.id, copies.id AS source, round(copies.x, 6) AS x FROM copies JOIN slots ON copies.rank = slots.rank"""

_RESIDUAL = f"""WITH {WEIGHED}, s AS (SELECT *, CAST((SELECT sum(w) FROM p) AS BIGINT) AS tw0 FROM p),
 t AS (SELECT id, x, ({N} * w) // tw0 AS whole, CAST(floor(CAST(({N} * w) % tw0 AS DOUBLE) / CAST(tw0 AS DOUBLE) * 4294967296.0::DOUBLE) AS BIGINT) AS w FROM s),
 c AS ({cum_sql('t')}),
 d AS (SELECT CAST(floor({lcg_sql('i')} * CAST((SELECT sum(w) FROM t) AS DOUBLE)) AS BIGINT) AS pt FROM range({N}) r(i) WHERE i < {N} - (SELECT sum(whole) FROM t)),
 k AS ({_asof('SELECT pt FROM d', 'c', 'id', 'w')}),
 j AS (SELECT t.id, t.x, CAST(t.whole + coalesce(k.cnt, 0) AS BIGINT) AS cnt FROM t LEFT JOIN k ON t.id = k.id)
 SELECT id, cnt, round(x, 6) AS x FROM j WHERE cnt > 0"""


# schemes


def cen_step(spark, sf_dir):
    return schemes.central(_w(spark, sf_dir), N, lambda k: F.lit(U)).select((F.col("id") % (1 << 32)).alias("point"), F.round("x", 6).alias("x"), F.round("weight", 12).alias("weight"))


def dpf_noshuffle_step(spark, sf_dir):
    return points(schemes.local(_w(spark, sf_dir), N, PARTS, u_of))


def dpf_select_exchange(spark, sf_dir):
    return schemes.selected(_w(spark, sf_dir), PARTS, index_of).select("part", "id", "w", F.round("x", 6).alias("x"))


SIMS = 20


def selection_repeats(spark, sf_dir):
    """Selections of one set again and again: weight and mean of each sub-filter, before and after resampling."""
    u = lambda sim, part: u_of(sim * PARTS + part)
    index = lambda sim, part, target, j: lcg(sim.cast("long") * 5000011 + part * 1000003 + target * 10007 + j * 31)
    out = schemes.repeated_selection(_w(spark, sf_dir), N, PARTS, SIMS, u, index)
    return out.select("sim", "part", F.round("weight", 9).alias("weight"), F.round("mean", 6).alias("mean"), F.round("resampled", 6).alias("resampled"))


def dpf_step(spark, sf_dir):
    return points(schemes.dpf(_w(spark, sf_dir), N, PARTS, u_of, index_of))


def dist1_resample(spark, sf_dir):
    return points(schemes.dist1(_w(spark, sf_dir), N, PARTS, u_of))


def dist2_alloc(spark, sf_dir):
    return schemes.allocated(_w(spark, sf_dir), N, u_of).select("part", "w", F.col("cnt").cast("long").alias("cnt"))


def dist2_resample(spark, sf_dir):
    return points(schemes.dist2(_w(spark, sf_dir), N, u_of))


def dist3_resample(spark, sf_dir):
    return points(schemes.dist3(_w(spark, sf_dir), N, PARTS, u_of))


def decen_step(spark, sf_dir):
    return points(schemes.decentral(_w(spark, sf_dir), u_of))


def sub_step(spark, sf_dir):
    return points(schemes.subset(_w(spark, sf_dir), N, PARTS, u_of, index_of))


def hiera_step(spark, sf_dir):
    return points(schemes.hierarchical(_w(spark, sf_dir), N, u_of, lambda i: lcg(i)))


def _replicated(n: str, source: str, weight: str, u: str | None = None, more: str = "") -> str:
    """Each sub-filter of ``source`` by itself to ``n`` points."""
    return f"""c AS ({cum_sql(source, 'part')}), b AS (SELECT *, {bounds_sql(n, u or u_sql('part'))} FROM c),
      o AS (SELECT *, unnest(range(lo, hi)) AS point FROM b WHERE hi > lo)
      SELECT part, point, round(x, 6) AS x, round({weight}, 12) AS weight FROM o{more}"""


def _selected(extra: int = 0) -> str:
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS rn FROM p),
      sz AS (SELECT part, count(*) AS n FROM p GROUP BY part),
      tg AS (SELECT part, n, unnest(range({PARTS})) AS target FROM sz),
      dr AS (SELECT part, n, target, unnest(range(n // {PARTS} + {extra})) AS j FROM tg),
      pk AS (SELECT part, target, j, least(CAST(floor({INDEX} * n) AS BIGINT), n - 1) AS rn FROM dr),
      sel AS (SELECT CAST(pk.target AS INT) AS part, (CAST(pk.part AS BIGINT) * {PARTS} + pk.target) * 4294967296 + pk.j AS id, rk.w, rk.x FROM pk JOIN rk ON pk.part = rk.part AND pk.rn = rk.rn)"""


_REPEATS = f"""WITH {WEIGHED}, rk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS rn FROM p),
      sz AS (SELECT part, count(*) AS n, unnest(range({SIMS})) AS sim FROM p GROUP BY part),
      tg AS (SELECT sim, part, n, unnest(range({PARTS})) AS target FROM sz),
      dr AS (SELECT sim, part, n, target, unnest(range(n // {PARTS})) AS j FROM tg),
      pk AS (SELECT sim, part, target, j, least(CAST(floor({lcg_sql('(sim * 5000011 + CAST(part AS BIGINT) * 1000003 + target * 10007 + j * 31)')} * n) AS BIGINT), n - 1) AS rn FROM dr),
      sel AS (SELECT sim, CAST(pk.target AS INT) AS part, (CAST(pk.part AS BIGINT) * {PARTS} + pk.target) * 4294967296 + pk.j AS id, rk.w, rk.x FROM pk JOIN rk ON pk.part = rk.part AND pk.rn = rk.rn),
      c AS ({cum_sql('sel', 'sim, part')}), b AS (SELECT *, {bounds_sql(str(N // PARTS), u_sql(f'(sim * {PARTS} + part)'))} FROM c),
      s AS (SELECT sim, part, sum(w) AS w, sum(w * x) / sum(w) AS mean, sum((hi - lo) * x) / sum(hi - lo) AS resampled FROM b GROUP BY sim, part)
      SELECT CAST(sim AS INT) AS sim, part, round(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY sim) AS DOUBLE), 9) AS weight, round(mean, 6) AS mean, round(resampled, 6) AS resampled FROM s"""
_SUMS = f"ps AS (SELECT part, CAST(sum(w) AS BIGINT) AS w, count(*) AS n FROM p GROUP BY part), pc AS ({cum_sql('ps', '', 'part')})"
_ALLOC = f"al AS (SELECT part, w, lo, hi, hi - lo AS cnt FROM (SELECT *, {bounds_sql(str(N), u_sql('1000000'))} FROM pc))"
_TOTAL = "CAST((SELECT sum(w) FROM ps) AS DOUBLE)"


def _to_counts_sql(counts: str) -> str:
    return f"""j AS (SELECT p.*, {counts}.cnt AS nn FROM p JOIN {counts} ON p.part = {counts}.part), """ + _replicated("nn", "j", f"1.0::DOUBLE / {N}")


_DIST3 = f"""WITH {WEIGHED}, {_SUMS}, al AS (SELECT *, {bounds_sql(str(PARTS), u_sql('1000000'))} FROM pc),
 cp AS (SELECT part, unnest(range(lo, hi)) AS copy FROM al WHERE hi > lo),
 j AS (SELECT CAST(cp.copy AS INT) AS part, p.id, p.x, p.w FROM p JOIN cp ON p.part = cp.part), """ + _replicated(_SHARE, "j", f"1.0::DOUBLE / {N}")

_HIERA = f"""WITH {WEIGHED}, {_SUMS}, d AS (SELECT CAST(floor({lcg_sql('i')} * {_TOTAL}) AS BIGINT) AS pt FROM range({N}) r(i)),
 k AS ({_asof('SELECT pt FROM d', 'pc', 'part', 'w')}), """ + _to_counts_sql("k")


# single steps of the filters


def bootstrap_step(spark, sf_dir):
    """Move, weigh with earlier weights, effective size, and resampled counts."""
    model = BenchmarkModel()
    rows = _w(spark, sf_dir).withColumn("w", fixed(lcg(F.col("id") + 5) * model.likelihood(Y, F.col("x"))))
    out = systematic(rows, 2000, U)
    size = rows.agg(F.round(effective_size(), 3).alias("ess"))  # one row
    return out.crossJoin(F.broadcast(size)).where("cnt > 0").select("id", F.round("x", 6).alias("x"), F.col("cnt").cast("long").alias("cnt"), "ess")


def apf_step(spark, sf_dir):
    """First stage by the expected state's likelihood, move, ratio as second weight."""
    model = BenchmarkModel()
    rows = _w(spark, sf_dir).withColumn("ahead", model.likelihood(Y, model.mean(F.col("x"), F.lit(2.0))))
    first = replicated(systematic(rows.withColumn("w", fixed(F.col("ahead"))), 3000, U).withColumnRenamed("id", "parent"))
    moved = first.withColumn("x", model.propagate(F.col("x"), F.lit(2.0), 2 * lcg(F.col("id") * 3 + 1) - 1))
    return moved.select("id", "parent", F.round("x", 6).alias("x"), F.round(model.likelihood(Y, F.col("x")) / F.col("ahead"), 6).alias("w"))


def imm_first_stage(spark, sf_dir):
    """Counts of each particle for each next mode."""
    model, rows = RsGarch(), _garch_rows(spark, sf_dir)
    each = rows.withColumn("mode", F.explode(F.array(F.lit(0), F.lit(1))))
    to = F.when(F.col("mode") == 0, model.mode_probability(0, F.col("q"), F.col("vol"), p)).otherwise(model.mode_probability(1, F.col("q"), F.col("vol"), p))
    first = each.withColumn("w", F.round(model.likelihood(0.3, model.predict(p)) * to * F.col("w")).cast("long"))
    return systematic(first, 2000, U, keys=["mode"]).where("cnt > 0").select("mode", "id", F.col("cnt").cast("long").alias("cnt"))


def mc_variance(spark, sf_dir):
    """Means of repeated systematic resampling, and their spread about the mean before, by both divisors."""
    rows = _w(spark, sf_dir)
    before = rows.agg(weighted_mean("x").alias("m")).first()[0]
    means = repeated_means(rows, 1000, [lcg(F.lit(sim * 13 + 1)) for sim in range(10)])
    v = resampling_variance(means, before, 1000)
    return means.agg(v.alias("v"), F.count("*").alias("sims")).select("sims", F.round("v.by_simulations", 9).alias("by_simulations"), F.round("v.by_particles", 9).alias("by_particles"))


_MC = f"""WITH {WEIGHED}, q AS (SELECT p.*, sim FROM p, range(10) r(sim)), c AS ({cum_sql('q', 'sim')}),
 b AS (SELECT sim, x, {bounds_sql('1000', lcg_sql('(sim * 13 + 1)'))} FROM c),
 mm AS (SELECT sim, sum((hi - lo) * x) / 1000 AS mean FROM b GROUP BY sim),
 z AS (SELECT sum(w * x) / sum(w) AS before FROM p)
 SELECT count(*) AS sims, round(sum((mean - before) * (mean - before)) / count(*), 9) AS by_simulations, round(sum((mean - before) * (mean - before)) / 1000, 9) AS by_particles FROM mm, z"""

_COUNTED = "k AS (SELECT id, x, hi - lo AS cnt FROM (SELECT *, {b} FROM c)) SELECT id, CAST(cnt AS BIGINT) AS cnt, round(x, 6) AS x FROM k WHERE cnt > 0"

QUERIES = {
    "systematic_global": (systematic_global, f"WITH {WEIGHED}, {_C}, " + _COUNTED.format(b=bounds_sql(str(N), f"{U}::DOUBLE"))),
    "systematic_by_part": (systematic_by_part, f"WITH {WEIGHED}, {_CP}, " + _COUNTED.format(b=bounds_sql(_SHARE, u_sql("part")))),
    "stratified": (stratified_query, _stratified_sql()),
    "multinomial": (multinomial_query, _MULTINOMIAL),
    "residual": (residual_query, _RESIDUAL),
    "cen_step": (
        cen_step,
        f"WITH {WEIGHED}, {_C}, b AS (SELECT *, {bounds_sql(str(N), f'{U}::DOUBLE')} FROM c), o AS (SELECT *, unnest(range(lo, hi)) AS point FROM b WHERE hi > lo) SELECT point, round(x, 6) AS x, round(1.0::DOUBLE / {N}, 12) AS weight FROM o",
    ),
    "dpf_noshuffle_step": (dpf_noshuffle_step, f"WITH {WEIGHED}, " + _replicated(_SHARE, "p", f"1.0::DOUBLE / {N}")),
    "dpf_select_exchange": (dpf_select_exchange, f"WITH {WEIGHED}, {_selected()} SELECT part, id, w, round(x, 6) AS x FROM sel"),
    "dpf_step": (dpf_step, f"WITH {WEIGHED}, {_selected()}, " + _replicated(_SHARE, "sel", f"1.0::DOUBLE / {N}")),
    "dist1_resample": (dist1_resample, f"WITH {WEIGHED}, {_SUMS}, " + _replicated(_SHARE, "p", f"CAST(tw AS DOUBLE) / {_TOTAL} / {_SHARE}")),
    "dist2_alloc": (dist2_alloc, f"WITH {WEIGHED}, {_SUMS}, {_ALLOC} SELECT part, w, CAST(cnt AS BIGINT) AS cnt FROM al"),
    "dist2_resample": (dist2_resample, f"WITH {WEIGHED}, {_SUMS}, {_ALLOC}, " + _to_counts_sql("al")),
    "dist3_resample": (dist3_resample, _DIST3),
    "decen_step": (
        decen_step,
        f"WITH {WEIGHED}, {_SUMS}, j AS (SELECT p.*, ps.n AS nn FROM p JOIN ps ON p.part = ps.part), " + _replicated("nn", "j", f"CAST(tw AS DOUBLE) / nn / {_TOTAL}"),
    ),
    "sub_step": (sub_step, f"WITH {WEIGHED}, {_selected(1)}, " + _replicated(str(N // PARTS), "sel", f"1.0::DOUBLE / {N}")),
    "hiera_step": (hiera_step, _HIERA),
    "bootstrap_step": (
        bootstrap_step,
        f"""WITH {EVENTS}, m AS (SELECT id, {mean_sql()} + (2 * {lcg_sql('id')} - 1) * {ROOT_10} AS x FROM e),
        p AS (SELECT id, x, CAST(round({lcg_sql('(id + 5)')} * {pdf_sql(f'{Y}::DOUBLE', 'x * x / 20')} * 4294967296.0::DOUBLE) AS BIGINT) AS w FROM m), {_C},
        k AS (SELECT id, x, hi - lo AS cnt FROM (SELECT *, {bounds_sql('2000', f'{U}::DOUBLE')} FROM c)),
        z AS (SELECT round(sum(CAST(w AS DOUBLE)) * sum(CAST(w AS DOUBLE)) / sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)), 3) AS ess FROM p)
        SELECT id, round(x, 6) AS x, CAST(cnt AS BIGINT) AS cnt, ess FROM k, z WHERE cnt > 0""",
    ),
    "apf_step": (
        apf_step,
        f"""WITH {EVENTS}, m AS (SELECT id, {mean_sql()} + (2 * {lcg_sql('id')} - 1) * {ROOT_10} AS x FROM e),
        a AS (SELECT id, x, {mean_sql('x', '2.0::DOUBLE')} AS mu FROM m), l AS (SELECT id, x, mu, {pdf_sql(f'{Y}::DOUBLE', 'mu * mu / 20')} AS ahead FROM a),
        p AS (SELECT *, CAST(round(ahead * 4294967296.0::DOUBLE) AS BIGINT) AS w FROM l), {_C}, b AS (SELECT *, {bounds_sql('3000', f'{U}::DOUBLE')} FROM c),
        o AS (SELECT id AS parent, mu, ahead, unnest(range(lo, hi)) AS id FROM b WHERE hi > lo),
        v AS (SELECT id, parent, ahead, mu + (2 * {lcg_sql('(id * 3 + 1)')} - 1) * {ROOT_10} AS z FROM o)
        SELECT id, parent, round(z, 6) AS x, round({pdf_sql(f'{Y}::DOUBLE', 'z * z / 20')} / ahead, 6) AS w FROM v""",
    ),
    "imm_first_stage": (
        imm_first_stage,
        f"""WITH {_garch_sql()}, p AS (SELECT id, mode, CAST(round({pdf_sql('0.3::DOUBLE', 'p0')} * CASE WHEN mode = 0 THEN {_TO0} ELSE {_TO1} END * w) AS BIGINT) AS w FROM g, (VALUES (0), (1)) AS v(mode)),
        c AS ({cum_sql('p', 'mode')}), k AS (SELECT mode, id, hi - lo AS cnt FROM (SELECT *, {bounds_sql('2000', f'{U}::DOUBLE')} FROM c)) SELECT mode, id, CAST(cnt AS BIGINT) AS cnt FROM k WHERE cnt > 0""",
    ),
    "mc_variance": (mc_variance, _MC),
    "survivors_in_place": (survivors_in_place, _IN_PLACE),
    "selection_repeats": (selection_repeats, _REPEATS),
}
