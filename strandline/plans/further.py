"""More queries: subsets, nulls by permutation, composition, writes, relatedness over splits, fits.

Random choices follow MD5 of a seed and ids, so their SQL repeats them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import piecewise
from strandline.operators import alphabet, compat, fit, margins, reads, relate, scan, splits, tree, trie, validate, writes
from strandline.plans.catalogue import BIG, CHARS, COMBOS, CONSENSUS, KEYS, NODES, PAIRS, QUERIES, WR, Views, key_tree, query
from strandline.sources import fixture
from strandline.sources.shared import written


def order(seed: int, *ids: str) -> str:
    """The SQL of ``reads.hash_order``."""
    return f"md5(concat_ws('|', '{seed}', {', '.join(ids)}))"


def chance(seed: int, *ids: str) -> str:
    """The SQL of ``reads.uniform``."""
    return f"(CAST('0x' || substr({order(seed, *ids)}, 1, 13) AS BIGINT) / 4503599627370496.0)"


# Subsets.


@query("""SELECT cell, CAST(clone AS BIGINT) AS clone, sample, index FROM cells JOIN (SELECT clone, row_number() OVER (ORDER BY clone) - 1 AS index FROM (SELECT clone FROM cells GROUP BY clone HAVING count(*) >= 50)) USING (clone)""")
def q_clone_floor(v: Views) -> DataFrame:
    return splits.clone_floor(v.cells, 50).select("cell", "clone", "sample", "index")


@query(CONSENSUS + """, m AS (SELECT p.cell, p.clone, c.clone AS rival, count(*) AS n FROM prefixes p JOIN cons c ON c.tape = p.tape AND c.d = p.d AND c.prefix = p.prefix GROUP BY ALL),
  f AS (SELECT cell FROM m GROUP BY cell, clone HAVING coalesce(max(n) FILTER (rival <> clone), 0) > coalesce(max(n) FILTER (rival = clone), 0))
  SELECT cell, CAST(clone AS BIGINT) AS clone FROM cells WHERE cell NOT IN (SELECT cell FROM f)""")
def q_exclude_collisions(v: Views) -> DataFrame:
    flags = relate.collision_flags(v.prefixes, trie.consensus(v.prefixes, 20)).where("best > own")
    return splits.exclude(v.cells, flags).select("cell", "clone")


@query(f"SELECT cell, CAST(clone AS BIGINT) AS clone FROM (SELECT cell, clone, row_number() OVER (PARTITION BY clone ORDER BY {order(21, 'cell')}, cell) AS k FROM cells) WHERE k <= 5")
def q_subsample(v: Views) -> DataFrame:
    return splits.subsample(v.cells, "clone", 5, 21, "cell").select("cell", "clone")


HALVES = f"""halves AS (SELECT CAST(split AS BIGINT) AS split, tape, CASE WHEN row_number() OVER (PARTITION BY split ORDER BY {order(22, 'split', 'tape')}, tape) <= count(*) OVER (PARTITION BY split) // 2 THEN 'A' ELSE 'B' END AS half FROM ktapes CROSS JOIN range(0, 2) r(split))"""


@query(f", {HALVES} SELECT split, CAST(tape AS BIGINT) AS tape, half FROM halves")
def q_tape_halves(v: Views) -> DataFrame:
    return splits.tape_halves(v.tapes, 2, 22)


@query(f"SELECT CAST(clone AS BIGINT) AS clone, (row_number() OVER (ORDER BY {order(23, 'clone')}, clone) - 1) % 4 AS part FROM (SELECT DISTINCT clone FROM cells)")
def q_clone_splits(v: Views) -> DataFrame:
    return splits.clone_splits(v.cells, 4, 23)


@query(f"SELECT CAST(tape AS BIGINT) AS tape, count(*) FILTER ({chance(24, 'cell', 'tape')} < 0.5) AS train, count(*) AS n FROM entries GROUP BY tape")
def q_train_mask(v: Views) -> DataFrame:
    return v.entries.groupBy("tape").agg(F.count_if(splits.trains(24, 0.5, "cell", "tape")).alias("train"), F.count("*").alias("n"))


@query(f"SELECT cell, r, CASE WHEN r >= 14 THEN 0.9 WHEN r >= 10 THEN 0.5 ELSE 0.1 END AS psi, {chance(25, 'cell')} < CASE WHEN r >= 14 THEN 0.9 WHEN r >= 10 THEN 0.5 ELSE 0.1 END AS kept FROM rc")
def q_retention(v: Views) -> DataFrame:
    return splits.retained(margins.cell_margin(v.entries), "r", [(0, 0.1), (10, 0.5), (14, 0.9)], 25).select("cell", "r", "psi", "kept")


@query("SELECT sample, count(*) FILTER (r >= 8 AND r < 14) AS shelf, count(*) AS n FROM rc GROUP BY sample")
def q_shelf(v: Views) -> DataFrame:
    return margins.cell_margin(v.entries).groupBy("sample").agg(F.count_if((F.col("r") >= 8) & (F.col("r") < 14)).alias("shelf"), F.count("*").alias("n"))


@query(f"""SELECT perm, h.cell, t.cell AS source FROM (SELECT CAST(perm AS BIGINT) AS perm, sample, cell, row_number() OVER (PARTITION BY perm, sample ORDER BY cell) AS i FROM cells CROSS JOIN range(1, 4) r(perm)) h
  JOIN (SELECT CAST(perm AS BIGINT) AS perm, sample, cell, row_number() OVER (PARTITION BY perm, sample ORDER BY {order(26, 'perm', 'cell')}, cell) AS i FROM cells CROSS JOIN range(1, 4) r(perm)) t USING (perm, sample, i)""")
def q_permuted_cells(v: Views) -> DataFrame:
    return splits.permuted_cells(v.cells, 3, 26, "sample")


@query("SELECT CAST(l AS BIGINT) AS setting, CASE WHEN l = 8 THEN (SELECT count(*) FROM rc WHERE r < 8 AND cell % 7 = 0) ELSE 0 END AS broken FROM (VALUES (8), (10)) t(l)")
def q_nested_losses(v: Views) -> DataFrame:
    """Cells short of 8, 10 and 12 tapes, of which the middle setting leaves one in seven out."""
    r = margins.cell_margin(v.entries)
    lost = r.withColumn("setting", F.explode(F.array(F.lit(8), F.lit(10), F.lit(12)))).where("r < setting AND (setting <> 10 OR cell % 7 <> 0)").select("setting", "cell")
    each = v.spark.createDataFrame([(8,), (10,)], "setting int")
    return each.join(splits.not_nested(lost, "setting", "cell"), "setting", "left").select("setting", F.coalesce("broken", F.lit(0)).alias("broken"))


@query("SELECT sym, n, n >= 20 AS good FROM (SELECT sym, count(*) AS n FROM reads GROUP BY sym)")
def q_in_alphabet(v: Views) -> DataFrame:
    known = reads.frequent_symbols(v.reads, 20, fixture.DESIGN)
    return reads.in_alphabet(v.reads, known).groupBy("sym", "good").agg(F.count("*").alias("n"))


@query("SELECT CAST(node AS BIGINT) AS node, CAST(CASE WHEN t >= 2.5 THEN 2 WHEN t >= 0.5 THEN 1 WHEN t >= 0 THEN 0 ELSE -1 END AS BIGINT) AS epoch, round(least(t, 0.5) * 1.0 + greatest(least(t, 2.5) - 0.5, 0) * 2.0 + greatest(t - 2.5, 0) * 0.5, 6) AS w FROM kt".replace("SELECT", KEYS + " SELECT", 1))
def q_epoch_lookup(v: Views) -> DataFrame:
    knots, rates = [0.0, 0.5, 2.5], [1.0, 2.0, 0.5]
    w = piecewise.integral(F.col("t"), knots, rates)
    own = key_tree(v).select("node", "t", piecewise.interval_of(F.col("t"), knots).alias("epoch"), w.alias("w"))
    back = piecewise.inverse_integral(F.col("w"), knots, rates)
    return own.where(F.abs(back - F.col("t")) < 1e-9).select("node", "epoch", "w")  # the inverse leads back


# Margins.


@query("SELECT CAST(CASE WHEN r < 6 THEN 0 WHEN r < 10 THEN 1 WHEN r < 14 THEN 2 WHEN r < 18 THEN 3 ELSE 4 END AS BIGINT) AS band, count(*) AS n, round(avg(CASE WHEN clone % 6 = 0 THEN 1.0 ELSE 0 END), 6) AS share FROM rc GROUP BY band")
def q_band_profile(v: Views) -> DataFrame:
    own = margins.cell_margin(v.entries).withColumn("none", F.col("clone") % 6 == 0)
    return margins.band_profile(own, "r", "none", [0, 6, 10, 14, 18, 21])


@query(", ref AS (SELECT tape FROM rt ORDER BY r DESC, tape LIMIT 8) SELECT cell, count(*) AS n, round(avg(depth), 6) AS mean_depth FROM tapes WHERE depth > 0 AND tape IN (SELECT tape FROM ref) GROUP BY cell HAVING count(*) >= 3")
def q_reference_depths(v: Views) -> DataFrame:
    return margins.reference_depths(v.tapes, v.entries, 8, 3)


def _three(unit: str) -> str:
    return f""", u AS (SELECT CAST(sum(1 - missing) AS DOUBLE) AS r, CAST(count(*) AS DOUBLE) AS m FROM entries GROUP BY {unit}),
  a AS (SELECT var_samp(r) AS vr, var_samp(r / m) AS vm, avg(m) AS m, sum(r) / sum(m) AS p, sum(r * (r - 1)) / sum(m * (m - 1)) AS rr, sum((m - r) * (m - r - 1)) / sum((m - r) * (m - 1)) AS pmm FROM u),
  b AS (SELECT *, vr / (m * p * (1 - p)) AS vif FROM a)
  SELECT round(m, 6) AS m, round(p, 6) AS p, round(vif, 6) AS vif, round((vif - 1) / (m - 1), 6) AS rho_variance, round((rr - p * p) / (p * (1 - p)), 6) AS rho_pairs, round(greatest(vm - p * (1 - p) / m, 0) / (p * (1 - p)), 6) AS rho_anova, round(pmm, 6) AS p_missing_given_missing, round(1 - p + (vif - 1) / (m - 1) * p, 6) AS p_predicted FROM b"""


@query(_three("cell"))
def q_rho_cells(v: Views) -> DataFrame:
    return margins.rho_three_ways(v.entries, "cell")


@query(_three("tape"))
def q_rho_tapes(v: Views) -> DataFrame:
    return margins.rho_three_ways(v.entries, "tape")


@query(""", d AS (SELECT tape, avg(depth) AS d FROM tapes WHERE depth > 0 GROUP BY tape), x AS (SELECT tape, 1 - p AS rate, d FROM rt JOIN d USING (tape)),
  k AS (SELECT rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0 AS a, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS b FROM x WHERE rate >= 0.6)
  SELECT count(*) FILTER (rate < 0.6) AS n_below, round(avg(d) FILTER (rate < 0.6), 6) AS mean_below, count(*) FILTER (rate >= 0.6) AS n_above, round(avg(d) FILTER (rate >= 0.6), 6) AS mean_above, round((SELECT corr(a, b) FROM k), 6) AS rho_above FROM x""")
def q_threshold_split(v: Views) -> DataFrame:
    depth = v.tapes.where("depth > 0").groupBy("tape").agg(F.avg("depth").alias("depth"))
    points = margins.tape_margin(v.entries).select("tape", (1 - F.col("p")).alias("rate")).join(depth, "tape")
    return margins.threshold_split(points, "rate", "depth", 0.6)


FAMILY = {
    "missing": "SELECT cell, clone, sample, tape, CAST(missing AS DOUBLE) AS x, 1.0 AS w FROM entries",
    "depth": "SELECT cell, clone, sample, tape, CASE WHEN depth >= 2 THEN 1.0 ELSE 0 END AS x, CASE WHEN depth < 2 AND term = 2 THEN 0.0 ELSE 1 END AS w FROM tapes",
}


def _standard(family: str) -> str:
    return f""", fa AS ({FAMILY[family]}), fp AS (SELECT tape, greatest(least(sum(x * w) / greatest(sum(w), 1), 1 - 1e-6), 1e-6) AS p FROM fa GROUP BY tape),
  va AS (SELECT cell, clone, sample, tape, CASE WHEN w > 0 THEN x - p ELSE 0 END AS r, CASE WHEN w > 0 THEN p * (1 - p) ELSE 0 END AS v FROM fa JOIN fp USING (tape))"""


def _rho(family: str) -> str:
    return _standard(family) + """, c AS (SELECT tape, sum(n) AS n, sum(d) AS d FROM (SELECT tape, pow(sum(r), 2) - sum(r * r) AS n, pow(sum(sqrt(v)), 2) - sum(v) AS d FROM va GROUP BY tape, clone) GROUP BY tape),
  s AS (SELECT tape, sum(n) AS n, sum(d) AS d FROM (SELECT tape, pow(sum(r), 2) - sum(r * r) AS n, pow(sum(sqrt(v)), 2) - sum(v) AS d FROM va GROUP BY tape, sample) GROUP BY tape)
  SELECT CAST(tape AS BIGINT) AS tape, round(CASE WHEN c.d > 0 THEN c.n / c.d END, 6) AS rho_within, round(CASE WHEN s.d - c.d > 0 THEN (s.n - c.n) / (s.d - c.d) END, 6) AS rho_between FROM c JOIN s USING (tape)"""


def _missing_family(v: Views) -> DataFrame:
    return v.entries.select("cell", "clone", "sample", "tape", F.col("missing").cast("double").alias("x"), F.lit(1.0).alias("w"))


@query(_rho("missing"))
def q_rho_missing(v: Views) -> DataFrame:
    return margins.rho_in_clones_and_samples(margins.with_tape_mean(_missing_family(v)))


@query(_rho("depth"))
def q_rho_depth(v: Views) -> DataFrame:
    return margins.rho_in_clones_and_samples(margins.with_tape_mean(margins.depth_family(v.tapes, 2)))


MOVES = f"""mv AS (SELECT perm, h.cell, t.cell AS source FROM (SELECT perm, sample, cell, row_number() OVER (PARTITION BY perm, sample ORDER BY cell) AS i FROM cells CROSS JOIN range(1, 21) r(perm)) h
  JOIN (SELECT perm, sample, cell, row_number() OVER (PARTITION BY perm, sample ORDER BY {order(27, 'perm', 'cell')}, cell) AS i FROM cells CROSS JOIN range(1, 21) r(perm)) t USING (perm, sample, i))"""


TAPE_NULL = _standard("missing") + f""", {MOVES},
  ob AS (SELECT tape, round(sum(n) / sum(d), 9) AS observed FROM (SELECT tape, pow(sum(r), 2) - sum(r * r) AS n, pow(sum(sqrt(v)), 2) - sum(v) AS d FROM va GROUP BY tape, clone) GROUP BY tape),
  nu AS (SELECT perm, tape, round(sum(n) / sum(d), 9) AS rho FROM (SELECT perm, tape, pow(sum(r), 2) - sum(r * r) AS n, pow(sum(sqrt(v)), 2) - sum(v) AS d FROM mv JOIN cells h ON h.cell = mv.cell JOIN va ON va.cell = mv.source GROUP BY perm, tape, h.clone) GROUP BY perm, tape),
  st AS (SELECT tape, max(observed) AS observed, avg(rho) AS mean, stddev_samp(rho) AS sd, count(*) FILTER (rho >= observed) AS up, count(*) FILTER (rho <= observed) AS down, count(*) AS b FROM nu JOIN ob USING (tape) GROUP BY tape)"""


@query(TAPE_NULL + """ SELECT CAST(tape AS BIGINT) AS tape, round(observed, 6) AS observed, round(st.mean, 6) AS mean, round(st.sd, 6) AS sd, round((observed - st.mean) / st.sd, 4) AS z, round((1 + up) / (1 + b), 6) AS p_up, round((1 + down) / (1 + b), 6) AS p_down FROM st""")
def q_tape_null(v: Views) -> DataFrame:
    moves = splits.permuted_cells(v.cells, 20, 27, "sample")
    out = margins.tape_null(margins.with_tape_mean(_missing_family(v)), moves)
    return out.select("tape", "observed", "mean", "sd", F.round("z", 4).alias("z"), "p_up", "p_down")


LOSS = """, lo AS (SELECT m.clone, anchor, d, prefix, e.tape, count(*) AS m, CAST(sum(missing) AS BIGINT) AS k, exp(sum(ln(p))) AS em, exp(sum(ln(1 - p))) AS ep FROM mem m JOIN pe e ON e.cell = m.cell AND e.tape <> anchor WHERE cm >= 4 GROUP BY ALL),
  wh AS (SELECT clone, tape, min(missing) = 1 AS inherited FROM entries GROUP BY ALL)"""


@query(COMBOS + LOSS + """ SELECT CAST(d AS BIGINT) AS d, CAST(CASE WHEN m < 6 THEN 0 WHEN m < 10 THEN 1 WHEN m < 20 THEN 2 WHEN m < 50 THEN 3 WHEN m < 200 THEN 4 ELSE 5 END AS BIGINT) AS stratum, count(*) AS tests, count(*) FILTER (k = m AND NOT inherited) AS all_missing, count(*) FILTER (k = m AND inherited) AS inherited, count(*) FILTER (k = 0) AS all_present,
  round(sum(em) FILTER (NOT inherited), 6) AS e_missing, round(sum(ep), 6) AS e_present FROM lo JOIN wh USING (clone, tape) GROUP BY ALL""")
def q_clade_loss(v: Views) -> DataFrame:
    e = scan.with_rates(v.entries)
    own = scan.loss_expectations(scan.statistics(scan.tape_combos(v.tapes, e)), scan.clade_members(v.prefixes), e)
    fresh = ~F.col("inherited")
    return own.groupBy("d", "stratum").agg(F.count("*").alias("tests"), F.sum(F.when(fresh, F.col("all_missing")).otherwise(0)).alias("all_missing"), F.sum(F.when(~fresh, F.col("all_missing")).otherwise(0)).alias("inherited"), F.sum("all_present").alias("all_present"), F.sum(F.when(fresh, F.col("e_missing"))).alias("e_missing"), F.sum("e_present").alias("e_present"))


# The event scan against permutations of whole rows within clones.


B, HOLD, SEED = 12, 3, 101


def _null_combos(b: int = B) -> str:
    """SQL of the scan over permuted entries: nu has perm and the columns of st."""
    return COMBOS + f""", pm AS (SELECT perm, h.cell, t.cell AS source FROM (SELECT perm, clone, cell, row_number() OVER (PARTITION BY perm, clone ORDER BY cell) AS i FROM cells CROSS JOIN range(1, {b + 1}) r(perm)) h
  JOIN (SELECT perm, clone, cell, row_number() OVER (PARTITION BY perm, clone ORDER BY {order(SEED, 'perm', 'cell')}, cell) AS i FROM cells CROSS JOIN range(1, {b + 1}) r(perm)) t USING (perm, clone, i)),
  nc AS (SELECT perm, m.clone, anchor, d, prefix, e.tape, count(*) AS m, CAST(sum(missing) AS BIGINT) AS k, sum(p) AS e, sum(CASE WHEN missing = 1 THEN ln(p) ELSE ln(1 - p) END) AS u
         FROM mem m JOIN pm ON pm.cell = m.cell JOIN pe e ON e.cell = pm.source AND e.tape <> anchor WHERE cm >= 4 GROUP BY ALL),
  nu AS (SELECT *, CASE WHEN k > e THEN CASE WHEN k = 0 THEN 0 ELSE k * ln(k / m) END + CASE WHEN m = k THEN 0 ELSE (m - k) * ln((m - k) / m) END - u ELSE 0 END AS soft,
         CASE WHEN m < 6 THEN 0 WHEN m < 10 THEN 1 WHEN m < 20 THEN 2 WHEN m < 50 THEN 3 WHEN m < 200 THEN 4 ELSE 5 END AS stratum FROM nc)"""


def _counted(v: Views, b: int = B) -> tuple[DataFrame, DataFrame]:
    """The scan as observed, and over permuted entries, both from one table of counts."""
    all_ = scan.counted_combos(scan.clade_counts(v.prefixes, scan.with_rates(v.entries), b, SEED))
    return all_.where("perm = 0").drop("perm"), all_.where("perm > 0")


def _seen(v: Views) -> DataFrame:
    return scan.statistics(scan.tape_combos(v.tapes, scan.with_rates(v.entries)))


def _tallied(v: Views) -> tuple[DataFrame, DataFrame]:
    """The scores of both, a row for all tests that score equally."""
    all_ = scan.statistics(scan.tallied_combos(scan.clade_counts(v.prefixes, scan.with_rates(v.entries), B, SEED)))
    return all_.where("perm = 0"), all_.where("perm > 0")


def _scored(v: Views) -> tuple[DataFrame, DataFrame]:
    seen, null = _counted(v)
    return scan.statistics(seen), scan.statistics(null)


@query(_null_combos() + f""" SELECT {BIG('clone', 'anchor', 'd')}, prefix, CAST(tape AS BIGINT) AS tape, count(*) FILTER (round(n.soft, 9) >= round(o.soft, 9)) AS n_ge, round(max(n.soft), 4) AS max_null, round(avg(n.soft), 4) AS mean_null, round((1 + count(*) FILTER (round(n.soft, 9) >= round(o.soft, 9))) / (1 + count(*)), 4) AS p, round(round(max(o.soft), 9) - round(max(n.soft), 9), 4) + 0.0 AS margin
  FROM st o JOIN nu n USING (clone, anchor, d, prefix, tape) GROUP BY ALL""", digits=4)
def q_combo_null(v: Views) -> DataFrame:
    out = scan.counted_accumulators(scan.clade_counts(v.prefixes, scan.with_rates(v.entries), B, SEED))
    return out.select(*scan.COMBO, "n_ge", "max_null", "mean_null", "p", "margin")


@query(_null_combos() + f""", tp AS (SELECT clone, anchor, d, prefix, tape, max(soft) AS top FROM nu WHERE perm > {HOLD} GROUP BY ALL),
  ma AS (SELECT stratum, source, v - top AS margin FROM (SELECT clone, anchor, d, prefix, tape, stratum, 0 AS source, soft AS v FROM st UNION ALL SELECT clone, anchor, d, prefix, tape, stratum, perm, soft FROM nu WHERE perm <= {HOLD}) JOIN tp USING (clone, anchor, d, prefix, tape)),
  gr AS (SELECT stratum, t_idx, (SELECT count(*) FROM ma WHERE ma.stratum = s.stratum AND source = 0 AND floor((margin + 1e-9) / 0.25) >= t_idx AND margin > -1e-9) AS observed, (SELECT count(*) FROM ma WHERE ma.stratum = s.stratum AND source > 0 AND floor((margin + 1e-9) / 0.25) >= t_idx AND margin > -1e-9) / {HOLD} AS expected
         FROM (SELECT DISTINCT stratum FROM ma) s CROSS JOIN range(0, 40) r(t_idx))
  SELECT CAST(stratum AS BIGINT) AS stratum, t_idx, observed, round(expected, 6) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY t_idx) AS k FROM gr WHERE expected <= 5.0) WHERE k = 1 AND observed > 0""")
def q_margin_thresholds(v: Views) -> DataFrame:
    held = scan.hold_out_margins(*_scored(v), "soft", HOLD).withColumn("margin", F.col("margin") + 1e-9)
    return scan.calibrated_thresholds(held, HOLD, 0.25, 40, 5.0)


@query(_null_combos() + f""", pe2 AS (SELECT stratum, t_idx, perm, (SELECT count(*) FROM nu WHERE nu.stratum = s.stratum AND nu.perm = r2.perm AND floor(soft / 0.5) >= t_idx) AS n FROM (SELECT DISTINCT stratum FROM nu) s CROSS JOIN range(0, 10) r(t_idx) CROSS JOIN range(1, {B + 1}) r2(perm))
  SELECT CAST(stratum AS BIGINT) AS stratum, t_idx, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, max(n) AS top FROM pe2 GROUP BY stratum, t_idx""")
def q_null_curve(v: Views) -> DataFrame:
    return scan.curve_over_permutations(_tallied(v)[1], "soft", 0.5, 10, B, "n")


@query(_null_combos() + f""", o AS (SELECT cut, count(*) FILTER (soft >= cut) AS observed FROM st CROSS JOIN (VALUES (0.5), (2.0), (4.0)) c(cut) GROUP BY cut), n AS (SELECT perm, cut, count(*) FILTER (soft >= cut) AS n FROM nu CROSS JOIN (VALUES (0.5), (2.0), (4.0)) c(cut) GROUP BY ALL)
  SELECT CAST(cut AS DOUBLE) AS cut, observed, round(sum(n) / {B}, 6) AS null_mean, round((1 + count(*) FILTER (n >= observed)) / (1 + {B}), 6) AS p FROM n JOIN o USING (cut) GROUP BY cut, observed""")
def q_global_p(v: Views) -> DataFrame:
    return scan.global_p(*_tallied(v), "soft", [0.5, 2.0, 4.0], B, "n")


SOFT2 = "CASE WHEN k = 0 THEN 0 ELSE k * ln(k / m) END + CASE WHEN m = k THEN 0 ELSE (m - k) * ln((m - k) / m) END - u"


@query(_null_combos(4) + f""", a AS (SELECT {SOFT2} AS s FROM co), b AS (SELECT perm, {SOFT2} AS s FROM nc),
  aa AS (SELECT avg(s) AS mean, stddev_pop(s) AS sd FROM a), bb AS (SELECT avg(m) AS null_mean, avg(v) AS null_sd FROM (SELECT avg(s) AS m, stddev_pop(s) AS v FROM b GROUP BY perm))
  SELECT CAST(t AS DOUBLE) AS tail, CAST((SELECT count(*) FROM a WHERE s >= t) AS DOUBLE) AS observed, round((SELECT count(*) FROM b WHERE s >= t) / 4, 6) AS null, round(aa.mean, 6) AS mean, round(aa.sd, 6) AS sd, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd,
  round((SELECT count(*) FROM a WHERE s >= t) / greatest((SELECT count(*) FROM b WHERE s >= t) / 4, 1e-9), 4) AS enrichment FROM (VALUES (1.0), (2.0), (3.0)) c(t) CROSS JOIN aa CROSS JOIN bb""".replace("AS null,", 'AS "null",'))
def q_soft_calibration(v: Views) -> DataFrame:
    seen, null = _counted(v, 4)
    out = scan.calibration(scan.soft_two_sided(seen), scan.soft_two_sided(null), "soft", [1.0, 2.0, 3.0])
    return out.withColumn("enrichment", F.round("enrichment", 4))


@query(_null_combos(1) + """ SELECT kind, CAST(least(floor(20 * k / m), 19) AS BIGINT) AS bin, count(*) AS n FROM (SELECT 'observed' AS kind, k, m FROM co UNION ALL SELECT 'permuted', k, m FROM nc) GROUP BY ALL""")
def q_share_histogram(v: Views) -> DataFrame:
    seen, null = _counted(v, 1)
    both = seen.select(F.lit("observed").alias("kind"), "k", "m").unionByName(null.select(F.lit("permuted").alias("kind"), "k", "m"))
    return both.groupBy("kind", F.least(F.floor(20 * F.col("k") / F.col("m")), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))


@query(COMBOS + """ SELECT eps, count(*) AS n, count(*) FILTER (k * ln(1 - eps) + (m - k) * ln(eps) - u >= 2) AS hits, round(avg(k * ln(1 - eps) + (m - k) * ln(eps) - u), 6) AS mean FROM co CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (0.05), (0.1)) c(eps) GROUP BY eps""")
def q_eps_sweep(v: Views) -> DataFrame:
    hard = scan.hard_at(scan.tape_combos(v.tapes, scan.with_rates(v.entries)), [0.01, 0.05, 0.1])
    return hard.groupBy("eps").agg(F.count("*").alias("n"), F.count_if(F.col("hard") >= 2).alias("hits"), F.avg("hard").alias("mean"))


@query(COMBOS + f""" SELECT {BIG('clone', 'anchor', 'd')}, prefix, CAST(tape AS BIGINT) AS tape, round(CASE WHEN k < m THEN ln(k / (m - k)) - ln(p / (1 - p)) END, 4) AS delta, round(CASE WHEN k < m THEN 2 * (k * ln(k / m) + (m - k) * ln((m - k) / m) - u) END, 4) AS lrt
  FROM st JOIN (SELECT tape, greatest(least(p, 1 - 1e-6), 1e-6) AS p FROM rt) USING (tape) WHERE z > 2""", digits=4)
def q_shifts(v: Views) -> DataFrame:
    e = scan.with_rates(v.entries)
    return scan.shifts(_seen(v).where("z > 2"), scan.clade_members(v.prefixes), e)


# Composition.


@query(f""", hv AS (SELECT tape, cell FROM reads WHERE site = 1), nn AS (SELECT tape, count(*) AS n_cells FROM hv GROUP BY tape HAVING count(*) >= 30), h2 AS (SELECT tape, cell FROM hv JOIN nn USING (tape)),
  ow AS (SELECT r.tape, sym, count(*) AS n, sum(CASE WHEN {chance(31, 'r.cell', 'r.tape', 'site')} < 0.5 THEN 1 ELSE 0 END) AS a FROM reads r JOIN h2 ON h2.tape = r.tape AND h2.cell = r.cell GROUP BY ALL),
  ic AS (SELECT cell, sym, count(*) AS c FROM reads GROUP BY ALL), ev AS (SELECT tape, sym, sum(c) AS c FROM h2 JOIN ic USING (cell) GROUP BY ALL),
  x AS (SELECT tape, sym, coalesce(n, 0) AS n, c - coalesce(n, 0) AS o, coalesce(a, 0) AS a, coalesce(n, 0) - coalesce(a, 0) AS b FROM ev LEFT JOIN ow USING (tape, sym)),
  y AS (SELECT *, sum(n) OVER t AS nt, greatest(sum(o) OVER t, 1) AS ot, greatest(sum(a) OVER t, 1) AS na, greatest(sum(b) OVER t, 1) AS nb FROM x WINDOW t AS (PARTITION BY tape)),
  z AS (SELECT tape, CAST(max(nt) AS BIGINT) AS n, sum(CASE WHEN n > 0 THEN 2 * n * ln(n / nt / greatest(o / ot, 1e-12)) ELSE 0 END) AS g2, sum(abs(n / nt - o / ot)) / 2 AS tv, sum(abs(a / na - b / nb)) / 2 AS fl FROM y GROUP BY tape)
  SELECT CAST(tape AS BIGINT) AS tape, n_cells, n, round(g2, 5) AS g2, round(tv, 6) AS tv, round(fl, 6) AS floor, round(tv - fl, 6) AS excess FROM z JOIN nn USING (tape)""")
def q_own_cell_distance(v: Views) -> DataFrame:
    return alphabet.own_cell_distance(v.reads, 30, 31).withColumn("g2", F.round("g2", 5))


@query(""", s AS (SELECT sym, count(*) / sum(count(*)) OVER () AS p FROM reads GROUP BY sym), g AS (SELECT unnest([1.0, 5.0, 20.0, 100.0]) AS m),
  e AS (SELECT m, sum(1 - pow(1 - p, m)) AS mean, sum(pow(1 - p, m) * (1 - pow(1 - p, m))) AS v FROM s CROSS JOIN g GROUP BY m),
  c AS (SELECT m, 2 * sum(pow(greatest(1 - a.p - b.p, 0), m) - pow((1 - a.p) * (1 - b.p), m)) AS c FROM s a JOIN s b ON a.sym < b.sym CROSS JOIN g GROUP BY m)
  SELECT CAST(m AS DOUBLE) AS m, round(e.mean, 6) AS mean, round(sqrt(greatest(v + c, 0)), 5) AS sd FROM e JOIN c USING (m)""")
def q_occupancy(v: Views) -> DataFrame:
    return alphabet.occupancy(alphabet.shares(v.reads, []), [1, 5, 20, 100]).withColumn("sd", F.round("sd", 5))


CONC = """, pr0 AS (SELECT r.tape, site, sym, array_to_string(list_slice(read, 1, site - 1), '>') AS prefix, count(*) AS n FROM reads r JOIN tapes t ON t.cell = r.cell AND t.tape = r.tape WHERE site >= 2 AND depth >= site - 1 GROUP BY ALL),
  pc0 AS (SELECT tape, site, sym, CAST(sum(n) AS BIGINT) AS n, max(n) / sum(n) AS top FROM pr0 GROUP BY ALL HAVING sum(n) >= 3)"""


@query(CONC + """ SELECT regexp_matches(sym, '^Brand#[1-4][0-9]$') AS good, CAST(CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 WHEN n < 25 THEN 2 ELSE 3 END AS BIGINT) AS band, count(*) AS n, round(quantile_cont(top, 0.5), 6) AS median FROM pc0 GROUP BY good, band""")
def q_junk_concordance(v: Views) -> DataFrame:
    own = alphabet.prefix_concordance(v.reads, v.tapes, fixture.DESIGN)
    return own.groupBy("good", reads.band(F.col("n"), [3, 5, 10, 25, 1 << 30]).alias("band")).agg(F.count("*").alias("n"), F.percentile("top", 0.5).alias("median"))


SIZES, REPS = [1, 3, 10, 30, 100], 20


@query(f""", cn AS (SELECT clone, n, sum(n) OVER (ORDER BY clone) AS upto FROM (SELECT clone, count(*) AS n FROM cells GROUP BY clone)), tt AS (SELECT count(*) AS n FROM cells),
  dr AS (SELECT size, rep, floor({chance(32, 'size', 'rep', 'draw')} * (SELECT n FROM tt)) AS pos FROM (SELECT unnest({SIZES}) AS size) CROSS JOIN range(1, {REPS + 1}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(1, size + 1)) AS draw)),
  cu AS (SELECT size AS n, quantile_cont(top, 0.5) AS top FROM (SELECT size, rep, max(k) / size AS top FROM (SELECT size, rep, clone, count(*) AS k FROM dr JOIN cn ON pos >= upto - n AND pos < upto GROUP BY ALL) GROUP BY size, rep) GROUP BY size),
  po AS (SELECT n AS x0, top AS y0, lead(n) OVER (ORDER BY n) AS x1, lead(top) OVER (ORDER BY n) AS y1 FROM cu),
  it AS (SELECT sym, CAST(sum(k) AS BIGINT) AS n, max(k) / sum(k) AS top FROM (SELECT tape, site, sym, clone, count(*) AS k FROM reads GROUP BY ALL) GROUP BY tape, site, sym HAVING sum(k) >= 3)
  SELECT regexp_matches(sym, '^Brand#[1-4][0-9]$') AS good, count(*) AS n, round(quantile_cont(top, 0.5), 6) AS median, round(quantile_cont(top - (y0 + coalesce((n - x0) / (x1 - x0) * (y1 - y0), 0)), 0.5), 6) AS excess FROM it JOIN po ON n >= x0 AND (x1 IS NULL OR n < x1) GROUP BY good""")
def q_top_share_excess(v: Views) -> DataFrame:
    per = v.reads.groupBy("tape", "site", "sym", "clone").agg(F.count("*").alias("n"))
    items = alphabet.top_share(per, ["tape", "site", "sym"]).where("total >= 3").select("sym", F.col("total").alias("n"), F.col("top_share").alias("top"))
    null = alphabet.null_top_shares(v.cells.groupBy("clone").agg(F.count("*").alias("n")), SIZES, REPS, 32)
    own = alphabet.excess_top_share(items, null)
    return own.groupBy(F.col("sym").rlike(fixture.DESIGN).alias("good")).agg(F.count("*").alias("n"), F.percentile("top", 0.5).alias("median"), F.percentile("excess", 0.5).alias("excess"))


@query(""", s AS (SELECT sym, count(*) / sum(count(*)) OVER () AS p FROM reads GROUP BY sym), dp AS (SELECT DISTINCT clone, tape, d, prefix FROM prefixes)
  SELECT CAST(clone AS BIGINT) AS clone, CAST(tape AS BIGINT) AS tape, CAST(d AS BIGINT) AS d, prefix, round(sum(ln(p)), 6) AS log_p FROM (SELECT *, unnest(string_split(prefix, '>')) AS sym FROM dp) JOIN s USING (sym) GROUP BY clone, tape, d, prefix""")
def q_prefix_log_p(v: Views) -> DataFrame:
    return alphabet.prefix_log_probability(v.prefixes, alphabet.shares(v.reads, []))


@query(NODES + """ SELECT clone, CAST(n_next AS BIGINT) AS n_next, round(row_number() OVER w / count(*) OVER (), 6) AS top_share, round(sum(n_next) OVER w / sum(n_next) OVER (), 6) AS value_share FROM (SELECT CAST(clone AS BIGINT) AS clone, sum(n_next) AS n_next FROM nodes GROUP BY clone) WINDOW w AS (ORDER BY n_next DESC, clone ROWS UNBOUNDED PRECEDING)""")
def q_concentration(v: Views) -> DataFrame:
    return alphabet.concentration(trie.nodes(v.tapes).groupBy("clone").agg(F.sum("n_next").alias("n_next")), "n_next", "clone")


# Compatibility.


@query(CHARS + f""", da AS (SELECT clone, a, b, count(*) AS n FROM pr JOIN (SELECT clone, id AS a, cell FROM cc) c USING (clone, a) JOIN tapes t ON t.cell = c.cell AND t.tape = tb AND (t.depth >= lb OR t.term IN (1, 3)) GROUP BY ALL),
  db AS (SELECT clone, a, b, count(*) AS n FROM pr JOIN (SELECT clone, id AS b, cell FROM cc) c USING (clone, b) JOIN tapes t ON t.cell = c.cell AND t.tape = ta AND (t.depth >= la OR t.term IN (1, 3)) GROUP BY ALL)
  SELECT {BIG('clone', 'a', 'b', 'n11')}, coalesce(da.n, 0) - n11 AS n10, coalesce(db.n, 0) - n11 AS n01 FROM pr LEFT JOIN da USING (clone, a, b) LEFT JOIN db USING (clone, a, b)""")
def q_crosstab(v: Views) -> DataFrame:
    return compat.crosstab(trie.labels(v.tapes, v.characters(), v.cells))


@query(CHARS + """, e AS (SELECT clone, a, b FROM pr WHERE ma > n11 AND mb > n11) SELECT CAST(clone AS BIGINT) AS clone, CAST(id AS BIGINT) AS id, array_to_string(list_sort(list(DISTINCT k)), ',') AS near FROM (SELECT clone, a AS id, b AS k FROM e UNION ALL SELECT clone, b, a FROM e) GROUP BY clone, id""")
def q_adjacency(v: Views) -> DataFrame:
    own = compat.adjacency(compat.as_absent(compat.co_occurring(v.characters())).where("conflict"))
    return own.withColumn("near", F.array_join(F.col("near").cast("array<string>"), ","))


@query(CHARS + """, ca AS (SELECT clone, id, list(cell) AS cells FROM cc GROUP BY ALL), e AS (SELECT clone, a, b FROM pr WHERE ma > n11 AND mb > n11)
  SELECT CAST(clone AS BIGINT) AS clone, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, array_to_string(list_sort(list_intersect(x.cells, y.cells)), ',') AS both, array_to_string(list_sort(list_filter(x.cells, lambda c: NOT list_contains(y.cells, c))), ',') AS only_a, array_to_string(list_sort(list_filter(y.cells, lambda c: NOT list_contains(x.cells, c))), ',') AS only_b
  FROM e JOIN ca x USING (clone) JOIN ca y USING (clone) WHERE x.id = a AND y.id = b""")
def q_witnesses(v: Views) -> DataFrame:
    c = v.characters()
    own = compat.witnesses(compat.as_absent(compat.co_occurring(c)).where("conflict"), c)
    return own.select("clone", "a", "b", *(F.array_join(F.col(k).cast("array<string>"), ",").alias(k) for k in ("both", "only_a", "only_b")))


@query(CHARS + """, s AS (SELECT clone, id, array_to_string(list_sort(list(cell)), ',') AS cells, count(*) AS size FROM cc GROUP BY ALL), w AS (SELECT clone, count(*) AS n FROM cells GROUP BY clone)
  SELECT CAST(clone AS BIGINT) AS clone, s.cells, count(*) AS copies, size FROM s JOIN w USING (clone) WHERE size >= 2 AND size < n GROUP BY clone, s.cells, size""")
def q_clade_multiset(v: Views) -> DataFrame:
    own = compat.proper_clades(compat.clades(v.characters()), v.cells)
    return own.select("clone", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells"), "copies", "size")


@query("SELECT CAST(clone AS BIGINT) AS clone, CAST(tape AS BIGINT) AS tape, CAST(d AS BIGINT) AS d, prefix, n AS inside, whole - n AS outside FROM (SELECT *, sum(n) OVER (PARTITION BY clone, tape, d) AS whole FROM (SELECT clone, tape, d, prefix, count(*) AS n FROM prefixes GROUP BY ALL)) WHERE n >= 4".replace("whole - n AS outside", "CAST(whole - n AS BIGINT) AS outside"))
def q_inside_outside(v: Views) -> DataFrame:
    return compat.inside_outside(v.prefixes)


# Writes.


@query(WR + " SELECT CAST(tape AS BIGINT) AS tape, count(*) AS writes, count(DISTINCT (clone, parent)) AS parents, round(count(*) / count(DISTINCT (clone, parent)), 6) AS bush FROM wr GROUP BY tape")
def q_bushiness(v: Views) -> DataFrame:
    return writes.bushiness(writes.independent_writes(v.tapes))


STRAT = """ct0 AS (SELECT {k}clone, tape, child, count(*) AS n FROM {t} GROUP BY ALL), ct1 AS (SELECT {k}clone, tape, sum(n) AS ct FROM ct0 GROUP BY ALL), ct2 AS (SELECT {k}clone, sum(n) AS c FROM ct0 GROUP BY ALL), ct3 AS (SELECT {k}clone, child, sum(n) AS cs FROM ct0 GROUP BY ALL), ct4 AS (SELECT {k}tape, sum(n) AS t FROM ct0 GROUP BY ALL),
  sd AS (SELECT {k}tape, child, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n, sum(coalesce(n, 0)) / max(t) - sum(ct / t * (cs - coalesce(n, 0)) / greatest(c - ct, 1)) AS difference FROM ct1 JOIN ct2 USING ({k}clone) JOIN ct3 USING ({k}clone) JOIN ct4 USING ({k}tape) LEFT JOIN ct0 USING ({k}clone, tape, child) GROUP BY ALL)"""


@query(WR + ", " + STRAT.format(k="", t="wr") + """ SELECT CAST(tape AS BIGINT) AS tape, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(difference)) / 2, 6) AS tv FROM sd GROUP BY tape""")
def q_tv_by_clone(v: Views) -> DataFrame:
    return writes.clone_stratified_distance(writes.clone_stratified(writes.independent_writes(v.tapes))).select("tape", "n", "tv")


RELABEL = f"""rl AS (SELECT h.perm, h.clone, h.site, t.tape, h.child FROM (SELECT perm, clone, site, child, row_number() OVER (PARTITION BY perm, clone, site ORDER BY tape, parent, child) AS i FROM wr CROSS JOIN range(1, 9) r(perm)) h
  JOIN (SELECT perm, clone, site, tape, row_number() OVER (PARTITION BY perm, clone, site ORDER BY {order(33, 'perm', 'clone', 'site', 'tape', 'parent', 'child')}, tape, parent, child) AS i FROM wr CROSS JOIN range(1, 9) r(perm)) t USING (perm, clone, site, i))"""


STANDARD = WR + ", " + STRAT.format(k="", t="wr").replace("ct0", "oc0").replace("ct1", "oc1").replace("ct2", "oc2").replace("ct3", "oc3").replace("ct4", "oc4").replace("sd AS", "od AS") + ", " + RELABEL + ", " + STRAT.format(k="perm, ", t="rl") + """,
  sp AS (SELECT tape, child, sum(difference) / 8 AS m, sum(difference * difference) / 8 AS q FROM sd GROUP BY ALL),
  zz AS (SELECT tape, child, CASE WHEN sqrt(greatest(coalesce(q, 0) - pow(coalesce(m, 0), 2), 0)) > 1e-9 THEN (coalesce(difference, 0) - coalesce(m, 0)) / sqrt(greatest(coalesce(q, 0) - pow(coalesce(m, 0), 2), 0)) ELSE 0 END AS z FROM od FULL JOIN sp USING (tape, child))"""


@query(STANDARD + " SELECT CAST(tape AS BIGINT) AS tape, child, round(z, 4) AS z FROM zz", digits=4)
def q_standardised_map(v: Views) -> DataFrame:
    own = writes.independent_writes(v.tapes)
    null = writes.clone_stratified(writes.relabelled(own, 8, 33), ("perm",))
    return writes.standardised_map(writes.clone_stratified(own), null, 8)


@query(STANDARD + """ SELECT CAST(tape AS BIGINT) AS tape, arg_max(child, z) AS top, round(max(z), 4) AS top_z, round(CASE WHEN sqrt(greatest(sum(z * z) - max(z) * max(z), 0) / 19) > 1e-9 THEN max(z) / sqrt(greatest(sum(z * z) - max(z) * max(z), 0) / 19) ELSE 0 END, 4) AS concentration FROM zz GROUP BY tape""", digits=4)
def q_map_concentration(v: Views) -> DataFrame:
    own = writes.independent_writes(v.tapes)
    z = writes.standardised_map(writes.clone_stratified(own), writes.clone_stratified(writes.relabelled(own, 8, 33), ("perm",)), 8)
    return writes.concentration_of_map(z, 20)


@query(WR + """, per AS (SELECT site, tape, child, count(*) AS a FROM wr GROUP BY ALL), t AS (SELECT tape, child, a, sum(a) OVER (PARTITION BY site, tape) - a AS b, sum(a) OVER (PARTITION BY site, child) - a AS c, sum(a) OVER (PARTITION BY site) - sum(a) OVER (PARTITION BY site, tape) - sum(a) OVER (PARTITION BY site, child) + a AS d FROM per),
  g AS (SELECT tape, child, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d, i, exp(i * 0.05 - 8) AS th FROM t CROSS JOIN range(0, 321) r(i)),
  q AS (SELECT *, th * (b + d) AS qa, (a + b) * th + (c + d) - (a + c) * (1 + th) AS qb FROM g),
  x AS (SELECT *, CASE WHEN qa <= 0 THEN NULL ELSE (-qb + sqrt(qb * qb + 4 * qa * (a + c))) / (2 * qa) END AS x FROM q),
  p AS (SELECT *, coalesce(x * th / (1 + x * th), 1.0) AS p1, coalesce(x / (1 + x), 1.0) AS p0 FROM x),
  l AS (SELECT tape, child, i, round(sum(CASE WHEN a = 0 THEN 0 ELSE a * ln(greatest(p1, 1e-15)) END + CASE WHEN b = 0 THEN 0 ELSE b * ln(greatest(1 - p1, 1e-15)) END + CASE WHEN c = 0 THEN 0 ELSE c * ln(greatest(p0, 1e-15)) END + CASE WHEN d = 0 THEN 0 ELSE d * ln(greatest(1 - p0, 1e-15)) END), 9) AS ll FROM p GROUP BY ALL),
  w AS (SELECT tape, child, first(i ORDER BY ll DESC, abs(i - 160), i DESC) AS i, max(ll) AS ll, max(ll) FILTER (i = 160) AS l0 FROM l GROUP BY tape, child)
  SELECT CAST(tape AS BIGINT) AS tape, child, round(i * 0.05 - 8, 6) AS theta, round(ll - l0, 5) AS gain FROM w""")
def q_common_log_odds(v: Views) -> DataFrame:
    return writes.common_log_odds(writes.symbol_tables(writes.independent_writes(v.tapes), "tape", "site"), ["tape", "child"]).withColumn("gain", F.round("gain", 5))


TOPS = """, t AS (SELECT sample, tape, first(sym ORDER BY n DESC, sym DESC) AS sym FROM (SELECT sample, tape, sym, count(*) AS n FROM reads GROUP BY ALL) GROUP BY ALL),
  bo AS (SELECT tape, a.sym AS a, b.sym AS b FROM t a JOIN t b USING (tape) WHERE a.sample = 'BUILDING' AND b.sample = 'MACHINERY')"""


def _tops(v: Views, sample: str) -> DataFrame:
    n = v.reads.groupBy("sample", "tape", "sym").agg(F.count("*").alias("n"))
    return n.groupBy("sample", "tape").agg(F.max_by("sym", F.struct("n", "sym")).alias("sym")).where(F.col("sample") == sample)


@query(TOPS + f""", nu AS (SELECT h.perm, count(*) FILTER (h.a = t.b) AS n FROM (SELECT perm, a, row_number() OVER (PARTITION BY perm ORDER BY tape) AS i FROM bo CROSS JOIN range(1, 51) r(perm)) h JOIN (SELECT perm, b, row_number() OVER (PARTITION BY perm ORDER BY {order(34, 'perm', 'tape')}, tape) AS i FROM bo CROSS JOIN range(1, 51) r(perm)) t USING (perm, i) GROUP BY h.perm),
  s AS (SELECT count(*) AS shared, count(*) FILTER (a = b) AS agree FROM bo) SELECT shared, agree, round(avg(n), 6) AS null_mean, max(n) AS null_max, round(agree / greatest(avg(n), 1e-9), 6) AS enrichment, round((1 + count(*) FILTER (n >= agree)) / 51, 6) AS p FROM nu CROSS JOIN s GROUP BY shared, agree""")
def q_concordance(v: Views) -> DataFrame:
    return writes.permuted_agreement(_tops(v, "BUILDING"), _tops(v, "MACHINERY"), "tape", "sym", 50, 34)


@query(TOPS + " SELECT count(*) AS called, count(DISTINCT sym) AS distinct, round(20 * (1 - pow(0.95, count(*))), 6) AS expected, round(count(DISTINCT sym) / (20 * (1 - pow(0.95, count(*)))), 6) AS ratio FROM t WHERE sample = 'BUILDING'".replace("AS distinct", 'AS "distinct"'))
def q_injectivity(v: Views) -> DataFrame:
    return writes.injectivity(_tops(v, "BUILDING"), "sym", 20)


# Relatedness.


@query(""", re AS (SELECT tape, (missing - p) / greatest(sqrt(p * (1 - p)), sqrt(0.05 * 0.95)) AS r FROM (SELECT tape, missing FROM entries) e JOIN (SELECT tape, greatest(least(p, 1 - 1e-6), 1e-6) AS p FROM rt) q USING (tape)) SELECT CAST(tape AS BIGINT) AS tape, round(avg(abs(r)), 6) AS size, round(var_pop(r), 6) AS variance FROM re GROUP BY tape""")
def q_floored_residuals(v: Views) -> DataFrame:
    return relate.floored_residuals(scan.with_rates(v.entries), 0.05).groupBy("tape").agg(F.avg(F.abs("r")).alias("size"), F.var_pop("r").alias("variance"))


RESID = """re AS (SELECT cell, e.tape, missing, (missing - p) / greatest(sqrt(p * (1 - p)), sqrt(0.05 * 0.95)) AS r FROM (SELECT cell, tape, missing FROM entries) e JOIN (SELECT tape, greatest(least(p, 1 - 1e-6), 1e-6) AS p FROM rt) q USING (tape))"""
PADDED = "pd AS (SELECT i, j, 20 // n + CASE WHEN rank <= 20 % n THEN 1 ELSE 0 END AS times FROM (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM near))"


@query(PAIRS + f", {PADDED}, {RESID}" + " SELECT i, CAST(tape AS BIGINT) AS tape, round(sum(times * r) / sum(times), 6) AS u, round(sum(times * missing) / sum(times), 6) AS f, CAST(sum(times) AS BIGINT) AS n FROM pd JOIN re ON re.cell = j GROUP BY i, tape")
def q_neighbour_mean(v: Views) -> DataFrame:
    near = relate.padded(relate.nearest_mates(v.prefixes, v.tapes, 5), 20)
    return relate.neighbour_mean(near, relate.floored_residuals(scan.with_rates(v.entries), 0.05))


MATES = f"""mt AS (SELECT clone, i, rank, j FROM (SELECT clone, cell AS i, rank, d + CASE WHEN d >= pos THEN 1 ELSE 0 END AS want FROM (SELECT r.clone, cell, pos, rank, CAST(floor({chance(35, 'cell', 'rank')} * (n - 1)) AS BIGINT) AS d FROM (SELECT clone, cell, row_number() OVER (PARTITION BY clone ORDER BY cell) - 1 AS pos FROM cells) r JOIN (SELECT clone, count(*) AS n FROM cells GROUP BY clone HAVING count(*) > 1) s USING (clone) CROSS JOIN range(1, 6) k(rank)))
  JOIN (SELECT clone, cell AS j, row_number() OVER (PARTITION BY clone ORDER BY cell) - 1 AS want FROM cells) USING (clone, want))"""


@query(f", {MATES} SELECT CAST(clone AS BIGINT) AS clone, i, j, rank FROM mt")
def q_independent_mates(v: Views) -> DataFrame:
    return relate.independent_mates(v.cells, 5, 35)


@query(f", {MATES}" + """, nm AS (SELECT i, e.tape, sum(missing) AS k FROM mt JOIN entries e ON e.cell = j GROUP BY ALL)
  SELECT CAST(k AS BIGINT) AS k, count(*) AS n_entries, CAST(sum(missing) AS BIGINT) AS n_missing FROM nm JOIN entries e ON e.cell = i AND e.tape = nm.tape GROUP BY k""")
def q_mate_counts(v: Views) -> DataFrame:
    return relate.hits_by_count(relate.neighbour_missing(relate.independent_mates(v.cells, 5, 35), v.entries), v.entries)


@query(f", {MATES}" + """, s AS (SELECT i, e.tape, min(missing) AS a, max(missing) AS b FROM mt JOIN entries e ON e.cell = j GROUP BY ALL)
  SELECT CAST(tape AS BIGINT) AS tape, count(*) AS sets, CAST(sum(a) AS BIGINT) AS all_missing, CAST(sum(1 - b) AS BIGINT) AS all_present FROM s GROUP BY tape""")
def q_mate_unanimity(v: Views) -> DataFrame:
    return relate.unanimity(relate.independent_mates(v.cells, 5, 35), v.entries)


@query(PAIRS + """, q AS (SELECT quantile_cont(joint, 0.25) AS a, quantile_cont(joint, 0.5) AS b, quantile_cont(joint, 0.75) AS c, corr(rel, joint) AS corr FROM pa)
  SELECT CAST(CASE WHEN joint < a THEN 0 WHEN joint < b THEN 1 WHEN joint < c THEN 2 ELSE 3 END AS BIGINT) AS quarter, round(any_value(q.corr), 6) AS corr, count(*) AS n, round(avg(pa.joint), 6) AS joint, round(avg(rel), 6) AS rel FROM pa CROSS JOIN q GROUP BY quarter""")
def q_relatedness_audit(v: Views) -> DataFrame:
    return relate.audit(relate.products_by_relatedness(v.prefixes, v.tapes, None))


SPLIT_PAIRS = f""", {HALVES}, sh2 AS (SELECT split, x.clone, x.cell AS i, y.cell AS j, count(*) AS shared FROM prefixes x JOIN prefixes y ON x.clone = y.clone AND x.tape = y.tape AND x.d = y.d AND x.prefix = y.prefix AND x.cell < y.cell JOIN halves h ON h.tape = x.tape AND half = 'A' GROUP BY ALL),
  jo2 AS (SELECT split, x.clone, x.cell AS i, y.cell AS j, count(*) AS joint FROM tapes x JOIN tapes y ON x.clone = y.clone AND x.tape = y.tape AND x.cell < y.cell JOIN halves h ON h.tape = x.tape AND half = 'A' WHERE x.depth > 0 AND y.depth > 0 GROUP BY ALL),
  pa2 AS (SELECT split, i, j, coalesce(shared, 0) / joint AS rel FROM jo2 LEFT JOIN sh2 USING (split, clone, i, j)), {RESID}, re2 AS (SELECT split, cell, tape, r FROM re JOIN halves USING (tape) WHERE half = 'B')"""


def _split_tables(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prefixes and tapes of the A tapes of each split, and residuals on its B tapes."""
    halves = splits.tape_halves(v.tapes, 2, 22)
    a, b = halves.where("half = 'A'").select("split", "tape"), halves.where("half = 'B'").select("split", "tape")
    residuals = relate.floored_residuals(scan.with_rates(v.entries), 0.05).join(F.broadcast(b), "tape").select("split", "cell", "tape", "r")
    return v.prefixes.join(F.broadcast(a), "tape"), v.tapes.join(F.broadcast(a), "tape"), residuals


@query(SPLIT_PAIRS + """, pr2 AS (SELECT split, i, j, any_value(rel) AS rel, avg(x.r * y.r) AS s FROM pa2 JOIN re2 x USING (split) JOIN re2 y USING (split, tape) WHERE x.cell = i AND y.cell = j GROUP BY split, i, j)
  SELECT split, CAST(CASE WHEN rel >= 0.5 THEN 3 WHEN rel >= 0.2 THEN 2 WHEN rel >= 0.05 THEN 1 ELSE 0 END AS BIGINT) AS bin, count(*) AS n_pairs, round(avg(rel), 6) AS mean_rel, round(avg(s), 6) AS product FROM pr2 GROUP BY split, bin""")
def q_split_variogram(v: Views) -> DataFrame:
    return relate.split_variogram(relate.products_by_relatedness(*_split_tables(v), ("split", "clone")), [0.0, 0.05, 0.2, 0.5])


BINS = "CASE WHEN rel >= 0.5 THEN 3 WHEN rel >= 0.2 THEN 2 WHEN rel >= 0.05 THEN 1 ELSE 0 END"


@query(SPLIT_PAIRS + f""", mv AS (SELECT h.cell, t.cell AS source FROM (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM cells) h JOIN (SELECT cell, row_number() OVER (ORDER BY {order(36, '1', 'cell')}, cell) AS i FROM cells) t USING (i)),
  ro AS (SELECT split, i, j, any_value(rel) AS rel, avg(x.r * y.r) AS s FROM pa2 JOIN re2 x USING (split) JOIN re2 y USING (split, tape) WHERE x.cell = i AND y.cell = j GROUP BY split, i, j),
  r3 AS (SELECT split, mv.cell, tape, r FROM re2 JOIN mv ON mv.source = re2.cell), rn AS (SELECT split, i, j, any_value(rel) AS rel, avg(x.r * y.r) AS s FROM pa2 JOIN r3 x USING (split) JOIN r3 y USING (split, tape) WHERE x.cell = i AND y.cell = j GROUP BY split, i, j),
  d AS (SELECT split, bin, a, b FROM (SELECT split, {BINS} AS bin, avg(s) AS a FROM ro GROUP BY ALL) JOIN (SELECT split, {BINS} AS bin, avg(s) AS b FROM rn GROUP BY ALL) USING (split, bin))
  SELECT CAST(bin AS BIGINT) AS bin, round(avg(a), 6) AS observed, round(avg(b), 6) AS null, round(avg(a - b), 6) AS difference, round(stddev_samp(a - b), 6) AS sd, round(CASE WHEN stddev_samp(a - b) > 0 THEN avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) END, 4) AS t FROM d GROUP BY bin""".replace("AS null,", 'AS "null",'))
def q_variogram_excess(v: Views) -> DataFrame:
    prefixes, tapes_, r = _split_tables(v)
    moves = splits.permuted_cells(v.cells, 1, 36, None).select("cell", "source")
    null = r.withColumnRenamed("cell", "source").join(moves, "source").drop("source")
    edges = [0.0, 0.05, 0.2, 0.5]
    of = lambda residuals: relate.split_variogram(relate.products_by_relatedness(prefixes, tapes_, residuals, ("split", "clone")), edges)
    return relate.over_splits(of(r), of(null)).withColumn("t", F.round("t", 4))


# Trees.


@query(KEYS + f""", pk AS (SELECT anc AS node, arg_min(node, {order(41, '0', 'node')} || lpad(CAST(node AS VARCHAR), 20, '0')) AS pick FROM up JOIN kt USING (node) WHERE tip GROUP BY anc),
  ch AS (SELECT parent, pick, row_number() OVER (PARTITION BY parent ORDER BY kt.node) AS k FROM kt JOIN pk USING (node) WHERE parent IS NOT NULL)
  SELECT CAST(0 AS BIGINT) AS tree, CAST(parent AS BIGINT) AS node, CAST(max(pick) FILTER (k = 1) AS BIGINT) AS i, CAST(max(pick) FILTER (k = 2) AS BIGINT) AS j FROM ch WHERE k <= 2 GROUP BY parent HAVING count(*) = 2""")
def q_tip_pairs(v: Views) -> DataFrame:
    return tree.tip_pairs(key_tree(v), 41)


@query(KEYS + """, sz AS (SELECT anc AS node, count(*) AS n FROM up GROUP BY anc), of AS (SELECT node, CASE WHEN parent IS NULL THEN 1 ELSE 1 + coalesce(sum(n) OVER (PARTITION BY parent ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS o FROM kt JOIN sz USING (node)),
  fi AS (SELECT up.node, CAST(sum(o) AS BIGINT) AS first FROM up JOIN of ON of.node = up.anc GROUP BY up.node) SELECT CAST(0 AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, first, first + n - 1 AS last FROM fi JOIN sz USING (node)""")
def q_preorder(v: Views) -> DataFrame:
    return tree.preorder(key_tree(v))


# Fits.


@query()
def q_within_clone_fit(v: Views) -> DataFrame:
    return fit.within(v.entries, ["clone"]).select("cell", "tape", "missing", "alpha", "beta", "p")


@query()
def q_gamma_shape(v: Views) -> DataFrame:
    seen = fit.centred_betas(fit.within(v.entries, ["clone"]))
    moves = splits.permuted_cells(v.cells, 1, 51, None)
    moved = v.entries.withColumnRenamed("cell", "source").drop("clone", "sample").join(moves, "source").join(v.cells, "cell").select("cell", "clone", "tape", "missing")
    null = fit.centred_betas(fit.within(moved, ["clone"]))
    one = lambda df, name: fit.shape(df, "gamma", -12.0, 12.0).withColumn("rows", F.lit(name))
    return one(seen, "observed").unionByName(one(null, "permuted"))


@query()
def q_held_out_ladder(v: Views) -> DataFrame:
    prefixes, tapes_, _ = _split_tables(v)
    near = relate.padded(relate.nearest_mates(prefixes, tapes_, 5, ("split", "clone")), 20, ("split",)).select("split", "i", "j", "times")
    mates = relate.independent_mates(v.cells, 20, 37).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("split"), "i", "j", F.lit(1).alias("times"))
    halves = splits.tape_halves(v.tapes, 2, 22).where("half = 'B'").select("split", "tape")
    entries = v.entries.join(F.broadcast(halves), "tape").select("split", "cell", "clone", "tape", "missing")
    return fit.held_out_ladder(entries, {"relatives": near, "mates": mates}, 0.5, 38)


@query()
def q_ridge(v: Views) -> DataFrame:
    """How tapes that a clone has lost more often than all cells move its symbols' log odds against the other clones."""
    rate = margins.tape_margin(v.entries).select("tape", "p")
    lost = v.entries.groupBy("clone", "tape").agg(F.avg("missing").alias("f")).join(rate, "tape").where("f > p").select(F.col("clone").alias("unit"), F.col("tape").alias("term"), F.lit(1.0).alias("x"))
    per = alphabet.shares(v.reads, ["clone"]).select("clone", "sym", "n")
    total, symbol, clone = per.agg(F.sum("n").alias("s")), per.groupBy("sym").agg(F.sum("n").alias("c")), per.groupBy("clone").agg(F.sum("n").alias("u"))
    cells = per.join(symbol, "sym").join(clone, "clone").join(F.broadcast(total))
    a, b, c, d = F.col("n") + 0.5, F.col("u") - F.col("n") + 0.5, F.col("c") - F.col("n") + 0.5, F.col("s") - F.col("u") - F.col("c") + F.col("n") + 0.5
    rows = cells.select(F.col("clone").alias("unit"), F.col("sym").alias("item"), F.log(a * d / (b * c)).alias("y"), (1 / (1 / a + 1 / b + 1 / c + 1 / d)).alias("weight"))
    return fit.ridge(rows, lost, 1.0)


# Validation.


CLONE_RESIDUAL = ", cr AS (SELECT cell, clone, tape, missing - avg(missing) OVER (PARTITION BY clone) AS r FROM entries)"


def _clone_residuals(v: Views) -> DataFrame:
    mean = v.entries.groupBy("clone").agg(F.avg("missing").alias("_m"))
    return v.entries.join(mean, "clone").withColumn("r", F.col("missing") - F.col("_m"))


@query(CLONE_RESIDUAL + " SELECT CAST(tape AS BIGINT) AS tape, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(avg(r) / (stddev_samp(r) / sqrt(count(*))), 4) AS z FROM cr GROUP BY tape HAVING count(*) >= 100", digits=6)
def q_residual_z(v: Views) -> DataFrame:
    return validate.residual_z(_clone_residuals(v), ["tape"], "r", 100).withColumn("z", F.round("z", 4))


@query(CLONE_RESIDUAL + f""", hf AS (SELECT tape, r, {chance(61, 'cell', 'tape')} < 0.5 AS h FROM cr),
  ag AS (SELECT tape, count(*) FILTER (h) AS a, count(*) FILTER (NOT h) AS b, avg(r) FILTER (h) AS ma, avg(r) FILTER (NOT h) AS mb, var_samp(r) FILTER (h) AS va, var_samp(r) FILTER (NOT h) AS vb FROM hf GROUP BY tape)
  SELECT CAST(tape AS BIGINT) AS tape, a + b AS n, round(ma - mb, 6) AS difference, round(CASE WHEN sqrt(va / a + vb / b) > 0 THEN (ma - mb) / sqrt(va / a + vb / b) END, 4) AS z FROM ag""")
def q_half_z(v: Views) -> DataFrame:
    return validate.half_z(_clone_residuals(v), ["tape"], "r", 61, "cell", "tape").withColumn("z", F.round("z", 4))


@query(f"""SELECT CAST(least(floor({chance(62, 'cell')} * 10), 9) AS BIGINT) AS bin, count(*) AS n, round((SELECT count(*) FROM cells) / 10, 6) AS expected, round((count(*) - (SELECT count(*) FROM cells) / 10) / sqrt((SELECT count(*) FROM cells) / 10 * 0.9), 4) AS z FROM cells GROUP BY bin""")
def q_occupancy_z(v: Views) -> DataFrame:
    """The hash that every permutation and split rests on, against an even spread."""
    return validate.occupancy_z(v.cells.withColumn("u", reads.uniform(62, "cell")), "u").withColumn("z", F.round("z", 4))


@query(KEYS + """, u AS (SELECT (1 - exp(-0.7 * h)) / (0.5 + 0.2 * exp(-0.7 * h)) / ((1 - exp(-2.8)) / (0.5 + 0.2 * exp(-2.8))) AS u FROM (SELECT 3.5 - t AS h FROM kt WHERE NOT tip))
  SELECT CAST(least(floor(u * 10), 9) AS BIGINT) AS bin, count(*) AS n, round((SELECT count(*) FROM u) / 10, 6) AS expected, round((count(*) - (SELECT count(*) FROM u) / 10) / sqrt((SELECT count(*) FROM u) / 10 * 0.9), 4) AS z FROM u GROUP BY bin""")
def q_height_deciles(v: Views) -> DataFrame:
    """Branching heights of the key tree, half a level below their founder, by their distribution under the prior."""
    h = key_tree(v).where("NOT tip").select((3.5 - F.col("t")).alias("h"))
    return validate.occupancy_z(h.select(validate.height_cdf(F.col("h"), 1.0, 0.3, 0.5, 4.0).alias("u")), "u").withColumn("z", F.round("z", 4))


@query(""", sh0 AS (SELECT sym, count(*) / sum(count(*)) OVER () AS p FROM reads GROUP BY sym), em AS (SELECT m, sum(1 - pow(1 - p, m)) AS e FROM sh0 CROSS JOIN range(1, 401) r(m) GROUP BY m)
  SELECT CAST(s AS BIGINT) AS s, coalesce(min(m) FILTER (e >= s - 1e-9), -1) AS m FROM em CROSS JOIN (VALUES (1), (5), (15), (24), (40)) t(s) GROUP BY s""")
def q_draws_for(v: Views) -> DataFrame:
    return alphabet.draws_for(alphabet.shares(v.reads, []), [1, 5, 15, 24, 40], 400).withColumn("m", F.coalesce("m", F.lit(-1)))


@query()
def q_attribution(v: Views) -> DataFrame:
    """Events kept one a clone, tape and set of cells: by the soft score and by the hard one."""
    hits = written(_seen(v).where("z > 2").withColumns({c: F.round(c, 9) for c in ("soft", "hard")}), "hits")
    members = written(scan.clade_examples(v.tapes), "members")
    return validate.same_events(scan.collapse(hits, members, "soft"), scan.collapse(hits, members, "hard"), scan.COMBO)


__all__ = ["QUERIES"]
