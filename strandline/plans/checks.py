"""Queries of estimator checks, depletion of events and likelihoods on trees with inner nodes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import alphabet, compat, fit, likelihood, margins, reads, relate, scan, splits, tree, trie, writes
from strandline.plans.catalogue import BIG, CHARS, COLLAPSED, COMBOS, KEYS, QUERIES, Views, _collapsed, _exact, key_tree, query
from strandline.plans.further import TAPE_NULL, _missing_family, chance, order
from strandline.sources import bit_library, fixture, tables
from strandline.sources.shared import shared_dir, written

# How many writes a node's symbols stand for.


def _designed(v: Views) -> DataFrame:
    return v.reads.where(F.col("sym").rlike(fixture.DESIGN))


#: al has the alphabet of each site with running counts, wa its shares as one list.
ALPHABETS = f""", al AS (SELECT site, sym, n, CAST(sum(n) OVER (PARTITION BY site ORDER BY sym) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY site) AS BIGINT) AS total, n / sum(n) OVER (PARTITION BY site) AS p FROM (SELECT site, sym, count(*) AS n FROM reads WHERE regexp_matches(sym, '{fixture.DESIGN}') GROUP BY ALL)),
  wa AS (SELECT site, list(p ORDER BY p) AS ps FROM al GROUP BY site)"""


def bisect(name: str, source: str, keys: str, below: str) -> str:
    """SQL of ``trie.bisected``: name has keys and m; below holds of ps and s or rest at m."""
    of = ", ".join(f"q.{k.strip()}" for k in keys.split(","))
    return f"""{name}_b({keys}, ps, goal, it, low, high) AS (SELECT {keys}, ps, CAST(goal AS DOUBLE), 0, CAST(0 AS DOUBLE), CAST(1e6 AS DOUBLE) FROM {source}
    UNION ALL SELECT {of}, ps, goal, it + 1, CASE WHEN {below} THEN (low + high) / 2 ELSE low END, CASE WHEN {below} THEN high ELSE (low + high) / 2 END FROM {name}_b q WHERE it < 60),
  {name} AS (SELECT {keys}, (low + high) / 2 AS m FROM {name}_b WHERE it = 60)"""


SCORE = "list_sum(list_transform(ps, lambda p: p / (exp(least((low + high) / 2 * p, 700)) - 1))) > goal"
SEEN = "len(ps) <= goal OR list_sum(list_transform(ps, lambda p: 1 - pow(1 - p, (low + high) / 2))) < goal"
PER_NODE = ALPHABETS + """, nb AS (SELECT clone, tape, d - 1 AS level, CASE WHEN d = 1 THEN '' ELSE substr(prefix, 1, length(prefix) - 9) END AS prefix, right(prefix, 8) AS sym, count(*) AS n FROM prefixes GROUP BY ALL),
  nt AS (SELECT clone, tape, level, prefix, CAST(sum(n) AS BIGINT) AS n_next FROM nb GROUP BY ALL),
  nn AS (SELECT nb.clone, nb.tape, nb.level, nb.prefix, level + 1 AS site, list(p ORDER BY p) AS ps, count(*) AS s, sum(p) AS mass, 1 - sum(p) AS goal FROM nb JOIN al ON al.site = level + 1 AND al.sym = nb.sym GROUP BY ALL),
  ns AS (SELECT DISTINCT nn.site, nn.s, nn.s AS goal, wa.ps FROM nn JOIN wa USING (site)),
  """ + bisect("mo", "ns", "site, s", SEEN) + ", " + bisect("ml", "nn", "clone, tape, level, prefix", SCORE) + """,
  pn AS (SELECT clone, tape, level, prefix, n_next, s, mass, least(greatest(mo.m, s), n_next) AS m_moment, least(greatest(CASE WHEN goal <= 1e-12 THEN 1e6 ELSE ml.m END, s), n_next) AS m_mle FROM nn JOIN nt USING (clone, tape, level, prefix) JOIN mo USING (site, s) JOIN ml USING (clone, tape, level, prefix))"""


@query(PER_NODE + f" SELECT {BIG('clone', 'tape', 'level')}, prefix, n_next, s, round(mass, 6) AS mass, round(m_moment, 5) AS m_moment, round(m_mle, 5) AS m_mle, round(m_moment - s, 5) AS rec_moment, round(m_mle - s, 5) AS rec_mle FROM pn")
def q_m_per_node(v: Views) -> DataFrame:
    own = trie.draws_per_node(trie.nodes(v.tapes), trie.alphabets(_designed(v), ["site"]))
    return own.withColumns({c: F.round(c, 5) for c in ("m_moment", "m_mle", "rec_moment", "rec_mle")})


def _drawn(sizes: list[int], reps: int, seed: int) -> str:
    return f""", dr AS (SELECT site, size, rep, CAST(floor({chance(seed, 'site', 'size', 'rep', 'draw')} * total) AS BIGINT) AS pos FROM (SELECT DISTINCT site, total FROM al) CROSS JOIN (SELECT unnest({sizes}) AS size) CROSS JOIN range(1, {reps + 1}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(1, size + 1)) AS draw)),
  se AS (SELECT site, size, rep, list(p ORDER BY p) AS ps, count(*) AS s, sum(p) AS mass, 1 - sum(p) AS goal FROM (SELECT DISTINCT dr.site, size, rep, sym, p FROM dr JOIN al ON al.site = dr.site AND pos >= upto - n AND pos < upto) GROUP BY ALL)"""


CHECK = ([3, 6, 12, 25, 50], 30, 71)


@query(ALPHABETS + _drawn(*CHECK) + ", ss AS (SELECT DISTINCT se.site, se.s, se.s AS goal, wa.ps FROM se JOIN wa USING (site)), " + bisect("mo", "ss", "site, s", SEEN) + ", " + bisect("ml", "se", "site, size, rep", SCORE) + """,
  x AS (SELECT site, size, s, mo.m AS moment, CASE WHEN goal <= 1e-12 THEN 1e6 ELSE ml.m END AS mle FROM se JOIN mo USING (site, s) JOIN ml USING (site, size, rep)),
  y AS (SELECT site, size, avg(s) AS mean_s, quantile_cont(mle, [0.25, 0.5, 0.75]) AS l, quantile_cont(moment, [0.25, 0.5, 0.75]) AS m FROM x GROUP BY ALL)
  SELECT CAST(site AS BIGINT) AS site, CAST(size AS BIGINT) AS size, round(mean_s, 6) AS mean_s, round(l[2], 5) AS mle_median, round(100 * (l[2] - size) / size, 5) AS mle_bias, round(100 * (l[3] - l[1]) / size, 5) AS mle_iqr, round(m[2], 5) AS moment_median, round(100 * (m[2] - size) / size, 5) AS moment_bias, round(100 * (m[3] - m[1]) / size, 5) AS moment_iqr FROM y""")
def q_estimator_check(v: Views) -> DataFrame:
    """Draws from each site's alphabet, and how near both estimates come to their number."""
    known = trie.alphabets(_designed(v), ["site"])
    out = trie.estimator_check(trie.drawn_sets(known, ["site"], *CHECK), known, ["site"])
    return out.withColumns({f"{e}_{c}": F.round(f"{e}_{c}", 5) for e in ("mle", "moment") for c in ("median", "bias", "iqr")})


MASS = ([1, 2, 3, 5, 8, 13, 21, 40], 30, 72)
S_BANDS = [1, 2, 4, 7, 13, 21]


@query(ALPHABETS + _drawn(*MASS) + """, nb AS (SELECT clone, tape, d - 1 AS level, CASE WHEN d = 1 THEN '' ELSE substr(prefix, 1, length(prefix) - 9) END AS prefix, right(prefix, 8) AS sym FROM prefixes GROUP BY ALL),
  nn AS (SELECT count(*) AS s, sum(p) AS mass FROM nb JOIN al ON al.site = level + 1 AND al.sym = nb.sym GROUP BY clone, tape, level, prefix),
  ob AS (SELECT {b} AS band, count(*) AS n, quantile_cont(mass, 0.5) AS mass FROM nn GROUP BY band), nu AS (SELECT {b} AS band, count(*) AS n_null, quantile_cont(mass, [0.05, 0.5, 0.95]) AS q FROM se GROUP BY band)
  SELECT CAST(band AS BIGINT) AS band, n, round(mass, 6) AS mass, coalesce(n_null, 0) AS n_null, round(CASE WHEN n_null >= 30 THEN q[1] END, 6) AS low, round(CASE WHEN n_null >= 30 THEN q[2] END, 6) AS middle, round(CASE WHEN n_null >= 30 THEN q[3] END, 6) AS high, CASE WHEN n_null >= 30 THEN mass >= q[1] AND mass <= q[3] END AS inside FROM ob LEFT JOIN nu USING (band)""".replace("{b}", "CASE WHEN s < 2 THEN 0 WHEN s < 4 THEN 1 WHEN s < 7 THEN 2 WHEN s < 13 THEN 3 ELSE 4 END"))
def q_mass_null(v: Views) -> DataFrame:
    known = trie.alphabets(_designed(v), ["site"])
    return trie.mass_null(trie.draws_per_node(trie.nodes(v.tapes), known), trie.drawn_sets(known, ["site"], *MASS), S_BANDS, 30)


# Which symbol an event's clade writes least.


TOP, DEPLETE = 4, 20
EVENT = "clone, anchor, d, prefix, tape"


@query(COLLAPSED + f""", ev AS (SELECT clone, anchor, d, prefix, tape, m FROM st JOIN kp USING (clone, anchor, d, prefix, tape) ORDER BY m DESC, clone, anchor, d, prefix, tape LIMIT {TOP}),
  rk AS (SELECT clone, perm, cell, row_number() OVER (PARTITION BY clone, perm ORDER BY {order(81, 'perm', 'cell')}, cell) AS k FROM cells CROSS JOIN range(1, {DEPLETE + 1}) r(perm) WHERE clone IN (SELECT clone FROM ev)),
  mb AS (SELECT {EVENT}, perm, cell, k <= m AS ins FROM ev JOIN rk USING (clone) UNION ALL SELECT ev.clone, ev.anchor, ev.d, ev.prefix, ev.tape, 0, c.cell, x.cell IS NOT NULL FROM ev JOIN cells c USING (clone) LEFT JOIN mem x ON x.clone = ev.clone AND x.anchor = ev.anchor AND x.d = ev.d AND x.prefix = ev.prefix AND x.cell = c.cell),
  sp AS (SELECT cell, tape AS wt, CASE WHEN d = 1 THEN '' ELSE substr(prefix, 1, length(prefix) - 9) END AS parent, right(prefix, 8) AS child, d AS site FROM prefixes),
  w0 AS (SELECT DISTINCT {EVENT}, perm, ins, wt, parent, child, site FROM mb JOIN sp USING (cell) WHERE wt <> anchor AND wt <> tape),
  w1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {EVENT}, perm, ins, wt, parent) AS nc FROM w0) WHERE nc >= 2),
  pc AS (SELECT {EVENT}, perm, site, child, count(*) FILTER (ins) AS a, count(*) FILTER (NOT ins) AS c FROM w1 GROUP BY ALL),
  tt AS (SELECT *, sum(a) OVER (PARTITION BY {EVENT}, perm) AS wi, sum(c) OVER (PARTITION BY {EVENT}, perm) AS wo, sum(a) OVER s - a AS b, sum(c) OVER s - c AS e FROM pc WINDOW s AS (PARTITION BY {EVENT}, perm, site)),
  g AS (SELECT {EVENT}, perm, child, CAST(wi AS BIGINT) AS wi, CAST(wo AS BIGINT) AS wo, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(e AS DOUBLE) AS e, i, exp(i * 0.05 - 8) AS th FROM tt CROSS JOIN range(0, 321) r(i) WHERE wi >= 10 AND wo >= 10),
  q AS (SELECT *, th * (b + e) AS qa, (a + b) * th + (c + e) - (a + c) * (1 + th) AS qb FROM g), x AS (SELECT *, CASE WHEN qa <= 0 THEN NULL ELSE (-qb + sqrt(qb * qb + 4 * qa * (a + c))) / (2 * qa) END AS x FROM q),
  p AS (SELECT *, coalesce(x * th / (1 + x * th), 1.0) AS p1, coalesce(x / (1 + x), 1.0) AS p0 FROM x),
  l AS (SELECT {EVENT}, perm, child, wi, wo, i, round(sum(CASE WHEN a = 0 THEN 0 ELSE a * ln(greatest(p1, 1e-15)) END + CASE WHEN b = 0 THEN 0 ELSE b * ln(greatest(1 - p1, 1e-15)) END + CASE WHEN c = 0 THEN 0 ELSE c * ln(greatest(p0, 1e-15)) END + CASE WHEN e = 0 THEN 0 ELSE e * ln(greatest(1 - p0, 1e-15)) END), 9) AS ll FROM p GROUP BY ALL),
  o AS (SELECT {EVENT}, perm, child, wi, wo, first(i ORDER BY ll DESC, abs(i - 160), i DESC) * 0.05 - 8 AS theta, max(ll) - max(ll) FILTER (i = 160) AS gain FROM l GROUP BY ALL),
  sg AS (SELECT *, round(CASE WHEN theta < -1e-9 THEN gain ELSE -gain END, 6) AS sg FROM o),
  be AS (SELECT {EVENT}, perm, wi, wo, first(child ORDER BY sg DESC, child) AS top, first(theta ORDER BY sg DESC, child) AS theta, max(sg) AS gain FROM sg GROUP BY ALL),
  nu AS (SELECT {EVENT}, gain AS ng FROM be WHERE perm > 0)
  SELECT {BIG('clone', 'anchor', 'd')}, prefix, CAST(tape AS BIGINT) AS tape, m AS cells_in, wi AS writes_in, wo AS writes_out, top, round(theta, 6) AS theta, round(gain, 5) + 0.0 AS gain, count(ng) AS n_used, round(avg(ng), 5) + 0.0 AS null_mean, round(max(ng), 5) + 0.0 AS null_max, round((1 + count(*) FILTER (ng >= gain)) / (1 + count(ng)), 6) AS p
  FROM be JOIN ev USING ({EVENT}) LEFT JOIN nu USING ({EVENT}) WHERE perm = 0 GROUP BY {EVENT}, m, wi, wo, top, theta, gain""")
def q_depletion(v: Views) -> DataFrame:
    """The largest events left by the collapse, with a null of whole cells that change places."""
    top = alphabet.top_k(_collapsed(v).select(*scan.COMBO, "m"), TOP, F.desc("m"), *scan.COMBO)
    out = writes.depletion(v.tapes, v.cells, top, scan.clade_members(v.prefixes), DEPLETE, 81, 10)
    return out.withColumns({c: F.round(c, 5) for c in ("gain", "null_mean", "null_max")})


# Likelihoods.


def likelihood_sql(rate: float, missed: float, levels: int, sites: int = 6) -> str:
    """SQL of ``likelihood.log_likelihoods`` on the key tree, whose branches are one long: each level is two tables.

    Values are logs; null is the log of 0. Without silence a branch only moves edits.
    """
    from math import factorial

    pmf = [rate**i * 2.718281828459045**-rate / factorial(i) for i in range(sites + 60)]
    tail = [sum(pmf[n:]) for n in range(sites + 1)]
    term = lambda k, j: repr(tail[j - k] if j == sites else pmf[j - k])
    cum = lambda k, j: f"exp(list_sum(list_transform(pre[{k + 1}:{j}], lambda x: lps[x])))" if j > k else "1"
    top = "greatest(" + ", ".join(f"v{k}" for k in range(sites + 1)) + ")"
    moved = lambda k: f"CASE WHEN pre IS NULL THEN v0 ELSE {top} + ln(nullif(" + " + ".join(f"coalesce({term(k, j)} * {cum(k, j)} * exp(v{j} - {top}), 0)" for j in range(k, sites + 1)) + f", 0)) END AS u{k}"
    lcp = "len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda n: lo[1:n] = hi[1:n]))"
    out = []
    for lv in range(levels, 0, -1):
        send = f"s{lv} AS (SELECT parent AS node, tape, pre, " + ", ".join(moved(k) for k in range(sites + 1)) + f" FROM n{lv} JOIN kt USING (node) CROSS JOIN sh)"
        total = ", ".join(f"CASE WHEN count(u{k}) = count(*) THEN sum(u{k}) END AS u{k}" for k in range(sites + 1))
        join = f"c{lv} AS (SELECT node, tape, lo, {lcp} AS n, " + ", ".join(f"u{k}" for k in range(sites + 1)) + f" FROM (SELECT node, tape, min(pre) AS lo, max(pre) AS hi, {total} FROM s{lv} GROUP BY node, tape))"
        here = f"n{lv - 1} AS (SELECT node, tape, lo[1:n] AS pre, " + ", ".join(f"CASE WHEN coalesce(n, 0) >= {k} THEN u{k} END AS v{k}" for k in range(sites + 1)) + f" FROM c{lv})"
        out += [send, join, here]
    tips = f"n{levels} AS (SELECT e.cell + 1000 AS node, e.tape, list_transform(t.read, lambda x: list_position(syms, x)) AS pre, " + ", ".join(f"CASE WHEN missing = 0 AND len(t.read) = {k} THEN ln({1 - missed})" + (f" WHEN missing = 1 THEN ln({missed})" if k == 0 else "") + f" END AS v{k}" for k in range(sites + 1)) + " FROM entries e LEFT JOIN tapes t ON t.cell = e.cell AND t.tape = e.tape CROSS JOIN sh)"
    alphabet_ = f"sh AS (SELECT list(sym ORDER BY sym) AS syms, list(ln(p) ORDER BY sym) AS lps FROM (SELECT sym, count(*) / sum(count(*)) OVER () AS p FROM reads WHERE regexp_matches(sym, '{fixture.DESIGN}') GROUP BY sym))"
    return ", ".join([alphabet_, tips, *out])


@query(", kt(node, parent) AS (SELECT r_regionkey + 1, 0 FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100 FROM customer), " + likelihood_sql(0.8, 0.2, 3) + " SELECT CAST(0 AS BIGINT) AS tree, CAST(tape AS BIGINT) AS tape, round(v0, 4) AS loglik FROM n0", digits=4)
def q_loglik_tree(v: Views) -> DataFrame:
    """Every tape on the tree of world, regions, nations and customers."""
    known = alphabet.shares(_designed(v), []).orderBy("sym").collect()  # an alphabet
    code = F.create_map(*(x for i, r in enumerate(known) for x in (F.lit(r["sym"]), F.lit(i))))
    tips = v.tapes.select(F.lit(0).cast("long").alias("tree"), (F.col("cell") + 1000).cast("long").alias("node"), "tape", F.transform("read", lambda x: code[x]).alias("read"), F.lit(True).alias("seen"))
    # Nations without customers and regions without nations tell nothing.
    t = key_tree(v)
    told = t.where("tip").select("node", "parent")
    nations = t.where("t = 2").join(told.select(F.col("parent").alias("node")), "node", "left_semi")
    regions = t.where("t = 1").join(nations.select(F.col("parent").alias("node")), "node", "left_semi")
    whole = t.where("t = 0 OR t = 3").unionByName(nations.select(*t.columns)).unionByName(regions.select(*t.columns))
    return likelihood.log_likelihoods(whole, tips, 0.8, [r["p"] for r in known], missed=0.2)


@query(PER_NODE + """ SELECT CAST(level AS BIGINT) AS level, count(*) AS nodes, round(quantile_cont(n_next, 0.5), 6) AS median_next, round(quantile_cont(s, 0.5), 6) AS median_s, round(quantile_cont(m_moment, 0.5), 5) AS median_m, round(avg(m_moment - s), 5) AS mean_recurrences, round(avg(CASE WHEN m_moment - s >= 1 THEN 1 ELSE 0 END), 5) AS with_recurrence,
  round(avg(CASE WHEN m_moment >= (SELECT sqrt(2 / sum(p * p)) FROM al WHERE site = 1) THEN 1 ELSE 0 END), 5) AS above_birthday FROM pn GROUP BY level""", digits=5)
def q_m_levels(v: Views) -> DataFrame:
    known = trie.alphabets(_designed(v), ["site"])
    return trie.recurrence_levels(trie.draws_per_node(trie.nodes(v.tapes), known), known)


# What absences, conventions and tests could tell.


@query(""", ce AS (SELECT clone, cell, avg(missing) AS p FROM entries GROUP BY ALL), sz AS (SELECT clone, count(*) AS m, sqrt(sum(p * (1 - p))) / count(*) AS sd FROM ce GROUP BY clone),
  ab AS (SELECT clone, count(*) FILTER (k >= 3 AND k <= m - 3) AS informative FROM (SELECT clone, tape, count(*) AS m, sum(missing) AS k FROM entries GROUP BY ALL) GROUP BY clone)
  SELECT CAST(CASE WHEN m < 10 THEN 0 WHEN m < 50 THEN 1 WHEN m < 100 THEN 2 ELSE 3 END AS BIGINT) AS band, count(*) AS clones, CAST(sum(m) AS BIGINT) AS cells, CAST(sum(informative) AS BIGINT) AS informative, round(avg(sd), 6) AS null_sd FROM sz JOIN ab USING (clone) GROUP BY band""")
def q_feasibility_bands(v: Views) -> DataFrame:
    return margins.feasibility_bands(v.entries, [0, 10, 50, 100, 1 << 30])


@query("SELECT count(*) AS clones, round(quantile_cont(top, 0.5), 6) AS median FROM (SELECT clone, max(n) / sum(n) AS top FROM (SELECT clone, sample, count(*) AS n FROM cells GROUP BY ALL) GROUP BY clone HAVING sum(n) >= 10)")
def q_sample_purity(v: Views) -> DataFrame:
    return margins.sample_purity(v.cells)


@query(CHARS + """, da AS (SELECT clone, a, b, count(*) AS n FROM pr JOIN (SELECT clone, id AS a, cell FROM cc) c USING (clone, a) JOIN tapes t ON t.cell = c.cell AND t.tape = tb AND (t.depth >= lb OR t.term IN (1, 3)) GROUP BY ALL),
  db AS (SELECT clone, a, b, count(*) AS n FROM pr JOIN (SELECT clone, id AS b, cell FROM cc) c USING (clone, b) JOIN tapes t ON t.cell = c.cell AND t.tape = ta AND (t.depth >= la OR t.term IN (1, 3)) GROUP BY ALL),
  cf AS (SELECT clone, count(*) FILTER (ma > n11 AND mb > n11) AS na, count(*) FILTER (coalesce(da.n, 0) > n11 AND coalesce(db.n, 0) > n11) AS ne FROM pr LEFT JOIN da USING (clone, a, b) LEFT JOIN db USING (clone, a, b) GROUP BY clone),
  tt AS (SELECT clone, CAST((sum(c) * sum(c) - sum(c * c)) / 2 AS BIGINT) AS n_pairs, coalesce(any_value(na), 0) AS na, coalesce(any_value(ne), 0) AS ne FROM (SELECT clone, tape, count(*) AS c FROM ch GROUP BY ALL) LEFT JOIN cf USING (clone) GROUP BY clone),
  uu AS (SELECT CAST(clone AS BIGINT) AS clone, n_pairs, na, ne FROM tt UNION ALL SELECT NULL, CAST(sum(n_pairs) AS BIGINT), sum(na), sum(ne) FROM tt)
  SELECT clone, n_pairs, round(CASE WHEN n_pairs > 0 THEN 100 * (n_pairs - na) / n_pairs END, 6) AS absent, round(CASE WHEN n_pairs > 0 THEN 100 * (n_pairs - ne) / n_pairs END, 6) AS excluded, round(CASE WHEN n_pairs > 0 THEN 100 * (n_pairs - ne) / n_pairs - 100 * (n_pairs - na) / n_pairs END, 6) AS spread FROM uu""")
def q_convention_spread(v: Views) -> DataFrame:
    c = written(v.characters(), "characters")
    excluded = written(compat.excluding(compat.co_occurring(c), c, v.tapes).select("clone", "ma", "mb", "n11", "conflict"), "pairs")
    return compat.convention_spread(compat.as_absent(excluded), excluded, compat.pair_totals(c))


@query(CHARS + """, cl AS (SELECT clone, id, array_to_string(list_sort(list(cell)), ',') AS k, any_value(level) AS level, count(*) AS size, list(cell) AS cells FROM cc GROUP BY clone, id), dc AS (SELECT clone, k, size, min(level) AS depth, any_value(cells) AS cells FROM cl GROUP BY clone, k, size),
  x AS (SELECT clone, k, size, depth, sample, count(*) AS n FROM (SELECT clone, k, size, depth, unnest(cells) AS cell FROM dc) z JOIN (SELECT cell, sample FROM cells) s USING (cell) GROUP BY ALL),
  w AS (SELECT sample, count(*) AS whole FROM cells GROUP BY sample), y AS (SELECT clone, k, size, depth, count(*) AS labels, count(*) FILTER (n < whole) AS broken, max(n) / sum(n) AS purity FROM x JOIN w USING (sample) GROUP BY clone, k, size, depth)
  SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n, round(avg(CASE WHEN labels > 1 AND broken > 0 THEN 1 ELSE 0 END), 6) AS straddling, round(avg(purity), 6) AS purity FROM y GROUP BY depth""")
def q_groundtruth_by_depth(v: Views) -> DataFrame:
    """The share of clades that can't be right, and how pure clades are, by depth."""
    own = compat.truth_class(compat.clades(v.characters()), v.cells.select("cell", F.col("sample").alias("label")), ("depth",))
    return own.groupBy("depth").agg(F.count("*").alias("n"), F.avg((F.col("kind") == "STRADDLE").cast("double")).alias("straddling"), F.avg("purity").alias("purity"))


@query(COMBOS + """, pop AS (SELECT clone, tape, count(*) AS n_pop, CAST(sum(missing) AS BIGINT) AS k_pop FROM entries GROUP BY ALL)
  SELECT CAST(d AS BIGINT) AS d, count(*) AS tests, count(*) FILTER (n_pop > m AND k_pop > 0 AND k_pop < n_pop) AS testable, count(*) FILTER (n_pop > m AND k_pop > 0 AND k_pop < n_pop AND k > m * k_pop / n_pop) AS above FROM st JOIN pop USING (clone, tape) GROUP BY d""")
def q_testable(v: Views) -> DataFrame:
    own = scan.testable(_exact(v))
    return own.groupBy("d").agg(F.count("*").alias("tests"), F.count_if("testable").alias("testable"), F.count_if(F.col("testable") & (F.col("k") > F.col("e_pop"))).alias("above"))


@query(TAPE_NULL + """, pv AS (SELECT tape, (1 + up) / (1 + b) AS p, row_number() OVER (ORDER BY (1 + up) / (1 + b), tape) AS rank, count(*) OVER () AS n FROM st)
  SELECT CAST(tape AS BIGINT) AS tape, round(p, 6) AS p, rank, rank <= coalesce(max(CASE WHEN p <= 0.55 * rank / n THEN rank END) OVER (), 0) AS passes FROM pv""")
def q_tape_null_passes(v: Views) -> DataFrame:
    """The step-up over the tapes' permutation p."""
    null = margins.tape_null(margins.with_tape_mean(_missing_family(v)), splits.permuted_cells(v.cells, 20, 27, "sample"))
    return scan.benjamini_hochberg(null.select("tape", F.col("p_up").alias("p")), "p", "tape", 0.55)


@query(""", rk AS (SELECT clone, cell, row_number() OVER (PARTITION BY clone ORDER BY r, cell) AS k, greatest(3, count(*) OVER (PARTITION BY clone) // 40) AS w FROM rc),
  nr AS (SELECT a.cell AS i, b.cell AS j, row_number() OVER (PARTITION BY a.cell ORDER BY md5(concat_ws('|', '9', a.cell, b.cell)), b.cell) AS rank FROM rk a JOIN rk b ON a.clone = b.clone AND a.cell <> b.cell AND abs(a.k - b.k) <= a.w),
  s AS (SELECT i, e.tape, min(missing) AS a, max(missing) AS b FROM nr JOIN entries e ON e.cell = j WHERE rank <= 5 GROUP BY ALL)
  SELECT CAST(tape AS BIGINT) AS tape, count(*) AS sets, CAST(sum(a) AS BIGINT) AS all_missing, CAST(sum(1 - b) AS BIGINT) AS all_present FROM s GROUP BY tape""")
def q_matched_unanimity(v: Views) -> DataFrame:
    """Unanimity among mates that have about as many tapes as the cell itself."""
    return relate.unanimity(relate.caliper_mates(margins.cell_margin(v.entries), "r", 5, 9), v.entries)


# Centrings, arms and histories.


GRAND = """, fa AS (SELECT cell, clone, sample, tape, CAST(missing AS DOUBLE) AS x FROM entries), fp AS (SELECT greatest(least(avg(x), 1 - 1e-6), 1e-6) AS p FROM fa), va AS (SELECT clone, sample, tape, x - p AS r, p * (1 - p) AS v FROM fa CROSS JOIN fp),
  c AS (SELECT tape, sum(n) AS n, sum(d) AS d FROM (SELECT tape, pow(sum(r), 2) - sum(r * r) AS n, pow(sum(sqrt(v)), 2) - sum(v) AS d FROM va GROUP BY tape, clone) GROUP BY tape),
  s AS (SELECT tape, sum(n) AS n, sum(d) AS d FROM (SELECT tape, pow(sum(r), 2) - sum(r * r) AS n, pow(sum(sqrt(v)), 2) - sum(v) AS d FROM va GROUP BY tape, sample) GROUP BY tape)
  SELECT CAST(tape AS BIGINT) AS tape, round(c.n / c.d, 6) AS rho_within, round((s.n - c.n) / (s.d - c.d), 6) AS rho_between FROM c JOIN s USING (tape) UNION ALL SELECT NULL, round(sum(c.n) / sum(c.d), 6), round((sum(s.n) - sum(c.n)) / (sum(s.d) - sum(c.d)), 6) FROM c JOIN s USING (tape)"""


def _with_pooled(values: DataFrame) -> DataFrame:
    pooled = margins.pooled_rho(values).select(F.lit(None).cast("int").alias("tape"), "rho_within", "rho_between")
    return margins.rho_in_clones_and_samples(values).unionByName(pooled)


@query(GRAND)
def q_rho_grand(v: Views) -> DataFrame:
    return _with_pooled(margins.with_grand_mean(_missing_family(v)))


@query()
def q_rho_two_way(v: Views) -> DataFrame:
    return _with_pooled(margins.with_two_way_mean(_missing_family(v)))


@query(""", m AS (SELECT sample AS arm, r, count(*) AS n, CASE WHEN sample = 'BUILDING' THEN max(clone) END AS top FROM rc GROUP BY sample, r) SELECT arm, r, n, CAST(top AS BIGINT) AS top FROM m""")
def q_merged_arms(v: Views) -> DataFrame:
    """Margins written one table a sample, one of which has a column more and narrower numbers, merged again."""
    own = written(margins.cell_margin(v.entries), "margins")
    folder = f"{shared_dir(v.spark)}/arms-{uuid.uuid4().hex}"
    arms = [r["sample"] for r in v.cells.select("sample").distinct().orderBy("sample").collect()]  # a design
    for arm in arms:
        one = own.where(F.col("sample") == arm).groupBy("r").agg(F.count("*").alias("n"), F.max("clone").alias("top"))
        (one.withColumn("r", F.col("r").cast("int")) if arm == "BUILDING" else one.drop("top")).write.parquet(f"{folder}/arm={arm}")
    return tables.merge_arms(v.spark, f"{folder}/arm=*", arms).select("arm", "r", "n", "top")


@query("SELECT sample AS part, CAST(tape AS BIGINT) AS tape, count(*) AS n, CAST(sum(missing) AS BIGINT) AS missing FROM entries WHERE sample IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def q_bit_library(v: Views) -> DataFrame:
    """Which tapes each cell lacks, written as packed bits by sample; two samples read back and counted by tape."""
    bits = F.transform(F.array_sort(F.collect_list(F.struct("tape", "missing"))), lambda x: x["missing"] == 1).alias("bits")
    path = f"{shared_dir(v.spark)}/bits-{uuid.uuid4().hex}"
    bit_library.write_bits(v.entries.groupBy(F.col("sample").alias("part"), F.col("cell").alias("unit")).agg(bits), path)
    tapes_ = v.entries.agg(F.array_sort(F.collect_set("tape")).alias("names"))  # a design
    back = bit_library.read_bits(v.spark, path, ["BUILDING", "MACHINERY"]).join(F.broadcast(tapes_))
    each = back.select("part", F.explode(F.arrays_zip("names", "bits")).alias("x"))
    return each.groupBy("part", F.col("x.names").alias("tape")).agg(F.count("*").alias("n"), F.count_if("x.bits").alias("missing"))


def _bits(*c: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(c)})), 1, 15) AS BIGINT)"


@query(KEYS + f""", nm AS (SELECT anc AS node, min(up.node) AS x FROM up JOIN kt ON kt.node = up.node WHERE tip GROUP BY anc), na AS (SELECT kt.node, parent, t, x FROM kt JOIN nm ON nm.node = kt.node),
  jo AS (SELECT parent AS node, bit_xor({_bits('x')}) AS st, count(*) AS n FROM na WHERE parent IS NOT NULL GROUP BY parent), ra AS (SELECT row_number() OVER (ORDER BY t DESC, x, n) AS k, st, n FROM na JOIN jo ON jo.node = na.node)
  SELECT CAST(0 AS BIGINT) AS tree, count(*) AS n_nodes, bit_xor({_bits('k', 'st', 'n')}) AS key FROM ra""")
def q_history(v: Views) -> DataFrame:
    return tree.history_keys(key_tree(v))


# Classes of values, codes, chunks and targets.


@query(f"SELECT class, n FROM (SELECT 'missing' AS class, (SELECT count(DISTINCT cell) FROM reads) * 120 - (SELECT count(*) FROM reads) AS n UNION ALL SELECT CASE WHEN regexp_matches(sym, '{fixture.DESIGN}') THEN 'good' ELSE 'bad' END, count(*) FROM reads GROUP BY ALL)")
def q_wide_value_classes(v: Views) -> DataFrame:
    """All values of the wide table, those without a symbol too."""
    return tables.unpivot_sites(fixture.wide(v.reads)).groupBy(reads.value_class(F.col("sym"), fixture.DESIGN).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT pattern, count(*) AS n FROM (SELECT e.cell, e.tape, CASE WHEN g.cell IS NULL THEN 'absent' WHEN last = n THEN 'prefix' ELSE 'gap' END AS pattern FROM entries e LEFT JOIN (SELECT cell, tape, max(site) AS last, count(*) AS n FROM reads WHERE site <> 2 OR cell % 5 <> 0 GROUP BY ALL) g ON g.cell = e.cell AND g.tape = e.tape) GROUP BY pattern""")
def q_missing_classes(v: Views) -> DataFrame:
    """With the second site of one cell in five taken out."""
    return reads.missing_classes(v.reads.where("site <> 2 OR cell % 5 <> 0"), v.entries).groupBy("pattern").agg(F.count("*").alias("n"))


@query(f""", c AS (SELECT sym, row_number() OVER (ORDER BY sym) - 1 AS code FROM (SELECT sym FROM reads WHERE regexp_matches(sym, '{fixture.DESIGN}') GROUP BY sym HAVING count(*) >= 20))
  SELECT CAST(tape AS BIGINT) AS tape, code, count(*) AS n FROM reads JOIN c USING (sym) GROUP BY tape, code""")
def q_dense_codes(v: Views) -> DataFrame:
    known = reads.frequent_symbols(v.reads, 20, fixture.DESIGN).where("NOT promoted")
    return reads.dense_codes(v.reads, known).groupBy("tape", "code").agg(F.count("*").alias("n"))


@query("SELECT CAST(clone AS BIGINT) AS clone, n, CAST(least(floor((sum(n) OVER (ORDER BY clone) - n / 2) / sum(n) OVER () * 4), 3) AS BIGINT) AS chunk FROM (SELECT clone, count(*) AS n FROM cells GROUP BY clone)")
def q_balanced_chunks(v: Views) -> DataFrame:
    return tables.balanced_chunks(v.cells.groupBy("clone").agg(F.count("*").alias("n")), "n", 4, "clone")


def _hermite(sd: float, points: int = 24) -> str:
    x, w = np.polynomial.hermite.hermgauss(points)
    return " + ".join(f"{float(b / np.sqrt(np.pi))!r} / (1 + exp(-((low + high) / 2 + {float(np.sqrt(2) * sd * a)!r})))" for a, b in zip(x, w, strict=True))


@query(f""", ml(tape, p, it, low, high) AS (SELECT tape, p, 0, CAST(-20 AS DOUBLE), CAST(20 AS DOUBLE) FROM rt UNION ALL SELECT tape, p, it + 1, CASE WHEN {_hermite(1.5)} < p THEN (low + high) / 2 ELSE low END, CASE WHEN {_hermite(1.5)} < p THEN high ELSE (low + high) / 2 END FROM ml WHERE it < 60)
  SELECT CAST(tape AS BIGINT) AS tape, round(p, 6) AS p, round((low + high) / 2, 5) AS mu FROM ml WHERE it = 60""")
def q_mean_logit(v: Views) -> DataFrame:
    """The mean of each tape's logits that gives its missing rate, if logits spread by 1.5."""
    return margins.tape_margin(v.entries).select("tape", "p", F.round(fit.mean_logit(F.col("p"), 1.5), 5).alias("mu"))


@query("SELECT CAST(tape AS BIGINT) AS tape, round(p, 6) AS p FROM rt ORDER BY p DESC, tape LIMIT 7")
def q_top_tapes(v: Views) -> DataFrame:
    """The tapes that are missing most."""
    return alphabet.top_k(margins.tape_margin(v.entries).select("tape", "p"), 7, F.desc("p"), "tape")


@query(COLLAPSED + f" SELECT {BIG('clone', 'anchor', 'd')}, prefix, {BIG('tape', 'm')} FROM st JOIN kp USING (clone, anchor, d, prefix, tape) ORDER BY m DESC, clone, anchor, d, prefix, tape LIMIT 25")
def q_top_events(v: Views) -> DataFrame:
    """The kept events of the largest clades."""
    return alphabet.top_k(_collapsed(v).select(*scan.COMBO, "m"), 25, F.desc("m"), *scan.COMBO)


__all__ = ["QUERIES"]
