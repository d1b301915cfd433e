"""Named queries and their DuckDB counterparts.

Each query runs operators over the recorder-shaped views of the tables. Doubles are
rounded after aggregation, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import alphabet, compat, fit, likelihood, margins, reads, relate, scan, simulate, tree, trie, writes
from strandline.sources import fixture, tables
from strandline.sources.shared import written
from strandline.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Views:
    """The views of a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.reads = fixture.reads(spark, sf_dir)
        self.cells = fixture.cells(spark, sf_dir)

    @cached_property
    def tapes(self) -> DataFrame:
        """Written, as prefixes and entries rest on it, and most queries ask for it several times."""
        return written(reads.tapes(self.reads, fixture.DESIGN), "tapes")

    @cached_property
    def prefixes(self) -> DataFrame:
        return reads.explode_prefixes(self.tapes)

    @cached_property
    def entries(self) -> DataFrame:
        return reads.entries(self.tapes, self.cells)

    def characters(self) -> DataFrame:
        return trie.character_ids(trie.characters(self.prefixes))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, decimals and small integers widened."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, digits) + F.lit(0.0)).alias(f.name) if kind == "double" else c.cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal") else c)
    return df.select(*out)


def query(sql: str | None = None, digits: int = 6):
    """Register a function of ``Views`` under its name, and its SQL over the views of ``fixture.SQL``."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Views(spark, sf_dir)), digits)
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {fixture.SQL.strip()}{sql}" if sql.lstrip().startswith(",") else f"WITH RECURSIVE {fixture.SQL.strip()} {sql}"
        return f

    return register


# Composition.


@query("""SELECT count(DISTINCT cell) AS cells, count(DISTINCT tape) AS tapes, count(sym) AS entries, count(*) FILTER (regexp_matches(sym, '^Brand#[1-4][0-9]$')) AS designed,
  count(*) FILTER (NOT regexp_matches(sym, '^Brand#[1-4][0-9]$')) AS other, count(DISTINCT sym) AS symbols,
  (SELECT sym FROM reads GROUP BY sym ORDER BY count(*) DESC, sym DESC LIMIT 1) AS top_symbol, (SELECT max(n) FROM (SELECT count(*) AS n FROM reads GROUP BY sym)) AS top_n,
  round((SELECT max(n) FROM (SELECT count(*) AS n FROM reads GROUP BY sym)) / count(sym), 6) AS top_share FROM reads""")
def q_profile(v: Views) -> DataFrame:
    return alphabet.profile(v.reads, fixture.DESIGN)


@query("SELECT sym, count(*) AS n, NOT regexp_matches(sym, '^Brand#[1-4][0-9]$') AS promoted FROM reads GROUP BY sym HAVING count(*) >= 20")
def q_alphabet(v: Views) -> DataFrame:
    return reads.frequent_symbols(v.reads, 20, fixture.DESIGN)


@query(""", s AS (SELECT sym, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM reads GROUP BY sym)
  SELECT round(sum(p * p), 6) AS q, count(*) AS m_obs, CAST(sum(n) AS BIGINT) AS edits, round(1 / sum(p * p), 6) AS effective, round(1 / count(*), 6) AS floor FROM s""")
def q_collision_mass(v: Views) -> DataFrame:
    return alphabet.collision_mass(alphabet.shares(v.reads, []), [])


@query(""", s AS (SELECT site, sym, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY site) AS p FROM reads GROUP BY site, sym)
  SELECT CAST(site AS BIGINT) AS site, round(sum(p * p), 6) AS q, count(*) AS m_obs, CAST(sum(n) AS BIGINT) AS edits, round(1 / sum(p * p), 6) AS effective, round(1 / count(*), 6) AS floor FROM s GROUP BY site""")
def q_per_site_q(v: Views) -> DataFrame:
    return alphabet.collision_mass(alphabet.shares(v.reads, ["site"]), ["site"])


@query(""", s AS (SELECT sym, count(*) / sum(count(*)) OVER () AS p FROM reads GROUP BY sym)
  SELECT sym, round(p, 6) AS p, row_number() OVER w AS rank, round(sum(p * p) OVER w / sum(p * p) OVER (), 6) AS q_share, round(row_number() OVER w / count(*) OVER (), 6) AS uniform_share
  FROM s WINDOW w AS (ORDER BY p DESC, sym ROWS UNBOUNDED PRECEDING)""")
def q_cumulative_q(v: Views) -> DataFrame:
    return alphabet.cumulative_q(alphabet.shares(v.reads, []))


@query(""", s AS (SELECT clone, sym, count(*) AS n FROM reads GROUP BY ALL HAVING count(*) >= 5)
  SELECT CAST(clone AS BIGINT) AS clone, sym, n, round(n / sum(n) OVER (PARTITION BY clone), 6) AS p FROM s""")
def q_trimmed_shares(v: Views) -> DataFrame:
    return alphabet.trimmed(alphabet.shares(v.reads, ["clone"]), ["clone"], 5)


@query("SELECT sym, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM reads GROUP BY sym")
def q_pooled_shares(v: Views) -> DataFrame:
    return alphabet.pooled_shares(alphabet.shares(v.reads, ["clone"]), "clone")


TO_REST = """ f AS (SELECT u.{k} AS unit, s.sym, coalesce(n, 0) AS n FROM (SELECT DISTINCT {k} FROM {t}) u CROSS JOIN (SELECT DISTINCT sym FROM {t}) s LEFT JOIN (SELECT {k}, sym, count(*) AS n FROM {t} GROUP BY ALL) c ON c.{k} = u.{k} AND c.sym = s.sym),
  g AS (SELECT unit, n, n / sum(n) OVER (PARTITION BY unit) AS p, (sum(n) OVER (PARTITION BY sym) - n) / (sum(n) OVER () - sum(n) OVER (PARTITION BY unit)) AS r FROM f)
  SELECT CAST(unit AS BIGINT) AS {k}, round(sum(abs(p - r)) / 2, 6) AS tv, round(sum(CASE WHEN n > 0 AND r > 0 THEN 2 * n * ln(p / r) ELSE 0 END), 6) AS g2 FROM g GROUP BY unit"""


@query("," + TO_REST.format(k="tape", t="reads"))
def q_tape_composition(v: Views) -> DataFrame:
    return alphabet.distance_to_rest(v.reads.groupBy("tape", "sym").agg(F.count("*").alias("n")), "tape")


@query("," + TO_REST.format(k="site", t="reads"))
def q_site_composition(v: Views) -> DataFrame:
    return alphabet.distance_to_rest(v.reads.groupBy("site", "sym").agg(F.count("*").alias("n")), "site")


@query("SELECT sym, count(*) AS n FROM reads GROUP BY sym ORDER BY n DESC, sym LIMIT 10")
def q_top_symbols(v: Views) -> DataFrame:
    return alphabet.top_k(v.reads.groupBy("sym").agg(F.count("*").alias("n")), 10, F.desc("n"), "sym")


@query("SELECT sym, count(*) AS total, round(max(n) / sum(n), 6) AS top_share FROM (SELECT sym, clone, count(*) AS n FROM reads GROUP BY ALL) GROUP BY sym".replace("count(*) AS total", "CAST(sum(n) AS BIGINT) AS total"))
def q_top_clone_share(v: Views) -> DataFrame:
    return alphabet.top_share(v.reads.groupBy("sym", "clone").agg(F.count("*").alias("n")), ["sym"])


@query("SELECT count(DISTINCT sym) AS symbols, count(*) AS drawn FROM (SELECT sym FROM reads ORDER BY md5(concat_ws('|', '3', cell, tape, site)), cell, tape, site LIMIT 100)")
def q_rarefaction(v: Views) -> DataFrame:
    return alphabet.rarefaction(v.reads, 100, 3, "cell", "tape", "site")


@query("SELECT cell, CAST(tape AS VARCHAR) AS tape, CAST(site AS BIGINT) AS site, sym FROM reads")
def q_wide_round_trip(v: Views) -> DataFrame:
    return tables.unpivot_sites(fixture.wide(v.reads)).where("sym IS NOT NULL")


# Reads and missing values.


@query("SELECT CASE WHEN regexp_matches(sym, '^Brand#[1-4][0-9]$') THEN 'good' ELSE 'bad' END AS class, count(*) AS n FROM reads GROUP BY ALL")
def q_value_classes(v: Views) -> DataFrame:
    return v.reads.groupBy(reads.value_class(F.col("sym"), fixture.DESIGN).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN max(site) = count(*) THEN 'prefix' ELSE 'gap' END AS pattern FROM reads GROUP BY cell, tape) GROUP BY pattern")
def q_missing_pattern(v: Views) -> DataFrame:
    return reads.pattern_class(v.reads).groupBy("pattern").agg(F.count("*").alias("n"))


@query("SELECT CAST(term AS BIGINT) AS term, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM tapes GROUP BY ALL")
def q_termination(v: Views) -> DataFrame:
    return v.tapes.groupBy("term", "depth").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (term = 1) AS unedited, count(*) FILTER (term = 2) AS junk, count(*) FILTER (term = 3) AS complete,
  (SELECT CAST(sum(missing) AS BIGINT) FROM entries) AS absent, CAST(sum(depth) AS BIGINT) AS edits FROM tapes""")
def q_entry_decomposition(v: Views) -> DataFrame:
    own = v.tapes.agg(F.count_if(F.col("term") == 1).alias("unedited"), F.count_if(F.col("term") == 2).alias("junk"), F.count_if(F.col("term") == 3).alias("complete"), F.sum("depth").alias("edits"))
    return own.join(F.broadcast(v.entries.agg(F.sum("missing").alias("absent"))))


@query("""SELECT level, round(avg(CASE WHEN depth >= level OR term IN (1, 3) THEN 1 ELSE 0 END), 6) AS determined, round(avg(CASE WHEN depth >= level THEN 1 ELSE 0 END), 6) AS reached
  FROM tapes CROSS JOIN range(1, 7) t(level) GROUP BY level""")
def q_determination_rates(v: Views) -> DataFrame:
    levels = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("level")
    t = v.tapes.select("depth", "term", levels)
    return t.groupBy("level").agg(F.avg(((F.col("depth") >= F.col("level")) | F.col("term").isin(1, 3)).cast("double")).alias("determined"), F.avg((F.col("depth") >= F.col("level")).cast("double")).alias("reached"))


@query("SELECT cell, CAST(clone AS BIGINT) AS clone, sample, r FROM rc WHERE r >= 12")
def q_qc_filter(v: Views) -> DataFrame:
    return reads.qc_cells(v.entries, 12)


@query("""SELECT b AS band, count(*) AS n FROM (SELECT CASE WHEN n < 6 THEN 0 WHEN n < 10 THEN 1 WHEN n < 20 THEN 2 WHEN n < 50 THEN 3 WHEN n < 200 THEN 4 ELSE 5 END AS b FROM (SELECT clone, count(*) AS n FROM cells GROUP BY clone)) GROUP BY b""")
def q_size_bands(v: Views) -> DataFrame:
    return v.cells.groupBy("clone").agg(F.count("*").alias("n")).groupBy(reads.size_stratum(F.col("n")).alias("band")).agg(F.count("*").alias("n"))


# Margins.


@query("SELECT cell, CAST(clone AS BIGINT) AS clone, sample, r FROM rc")
def q_margins_cell(v: Views) -> DataFrame:
    return margins.cell_margin(v.entries)


@query("SELECT CAST(tape AS BIGINT) AS tape, r, round(p, 6) AS p FROM rt")
def q_margins_tape(v: Views) -> DataFrame:
    return margins.tape_margin(v.entries)


@query("SELECT x AS r, coalesce(n, 0) AS n FROM range(0, 21) t(x) LEFT JOIN (SELECT r, count(*) AS n FROM rc GROUP BY r) h ON h.r = t.x")
def q_rc_histogram(v: Views) -> DataFrame:
    return margins.histogram(margins.cell_margin(v.entries), "r", 20)


@query(""", a AS (SELECT count(*) AS n, avg(r) AS mean_r, var_samp(r) AS var_r FROM rc), b AS (SELECT count(*) AS k, sum((1 - p) * p) AS s, avg(1 - p) AS p FROM rt)
  SELECT n, k, round(p, 6) AS p, round(mean_r, 6) AS mean_r, round(var_r, 6) AS var_r, round(var_r / s, 6) AS vif, round((var_r / s - 1) / (k - 1), 6) AS rho FROM a CROSS JOIN b""")
def q_vif_rho(v: Views) -> DataFrame:
    return margins.overdispersion(v.entries)


@query("SELECT CAST(cut AS BIGINT) AS cut, count(*) AS n, round(avg(r), 6) AS mean_r, round(var_samp(r), 6) AS var_r FROM rc JOIN (VALUES (0), (10), (15)) c(cut) ON r >= cut GROUP BY cut")
def q_cut_sweep(v: Views) -> DataFrame:
    return margins.cut_sweep(margins.cell_margin(v.entries), [0, 10, 15])


@query(""", g AS (SELECT sample, tape, avg(missing) AS p FROM entries GROUP BY ALL)
  SELECT x.sample AS a, y.sample AS b, round(corr(x.p, y.p), 6) AS corr FROM g x JOIN g y ON x.tape = y.tape AND x.sample < y.sample GROUP BY ALL""")
def q_tape_rate_corr(v: Views) -> DataFrame:
    return margins.correlation_matrix(v.entries, "sample")


DEPTHS = """, d AS (SELECT cell, count(*) AS n, avg(depth) AS mean_depth FROM tapes WHERE depth > 0 GROUP BY cell HAVING count(*) >= 5)"""


@query(DEPTHS + "SELECT cell, n, round(mean_depth, 6) AS mean_depth FROM d")
def q_mean_depths(v: Views) -> DataFrame:
    return margins.mean_depths(v.tapes, "cell")


INTERVAL = "round(rho, 6) AS rho, n, round(tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)), 6) AS high"


@query(DEPTHS + f""", k AS (SELECT row_number() OVER (ORDER BY n, cell) AS x, row_number() OVER (ORDER BY mean_depth, cell) AS y FROM d), r AS (SELECT corr(x, y) AS rho, count(*) AS n FROM k) SELECT {INTERVAL} FROM r""")
def q_depth_spearman_pos(v: Views) -> DataFrame:
    return margins.spearman(margins.mean_depths(v.tapes, "cell"), "n", "mean_depth", "cell")


@query(DEPTHS + f""", k AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS x, rank() OVER (ORDER BY mean_depth) + (count(*) OVER (PARTITION BY mean_depth) - 1) / 2.0 AS y FROM d), r AS (SELECT corr(x, y) AS rho, count(*) AS n FROM k) SELECT {INTERVAL} FROM r""")
def q_depth_spearman_avg(v: Views) -> DataFrame:
    return margins.spearman(margins.mean_depths(v.tapes, "cell"), "n", "mean_depth")


@query(""", g AS (SELECT tape, avg(missing) FILTER (sample = 'BUILDING') AS x, avg(missing) FILTER (sample = 'MACHINERY') AS y FROM entries GROUP BY tape)
  SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r, round(covar_samp(x, y), 6) AS covariance FROM g""")
def q_reliability(v: Views) -> DataFrame:
    of = lambda s: F.avg(F.when(F.col("sample") == s, F.col("missing")))
    return margins.replicate_fit(v.entries.groupBy("tape").agg(of("BUILDING").alias("x"), of("MACHINERY").alias("y")), "x", "y")


@query("SELECT CAST(clone AS BIGINT) AS clone, count(*) AS m, CAST(sum(r) AS DOUBLE) AS sum_x, CAST(sum(r) * sum(r) - sum(r * r) AS DOUBLE) AS pair_sum FROM rc GROUP BY clone")
def q_pair_sums(v: Views) -> DataFrame:
    x = margins.cell_margin(v.entries).withColumn("x", F.col("r").cast("double"))
    return margins.pair_moments(x, ["clone"])


WITHIN = """, x AS (SELECT clone, {f} AS f, {x} - avg({x}) OVER (PARTITION BY {f}) AS x FROM {t}),
  o AS (SELECT f, sum(s * s - q) AS i, sum(m * (m - 1)) AS n2 FROM (SELECT f, clone, sum(x) AS s, sum(x * x) AS q, count(*) AS m FROM x GROUP BY ALL) GROUP BY f),
  e AS (SELECT f, count(*) AS n, sum(x * x) AS ss, sum(x) * sum(x) - sum(x * x) AS a FROM x GROUP BY f)
  SELECT {k} n, round(i / n2 / (ss / n), 6) AS rho_within, round((a - i) / (n * (n - 1) - n2) / (ss / n), 6) AS rho_between FROM o JOIN e USING (f)"""


@query(WITHIN.format(f="1", x="r", t="rc", k=""))
def q_icc_clone(v: Views) -> DataFrame:
    return margins.within_correlation(margins.cell_margin(v.entries).withColumn("x", F.col("r").cast("double")), "clone")


@query(WITHIN.format(f="tape", x="missing", t="entries", k="CAST(f AS BIGINT) AS tape,"))
def q_rho_allpairs(v: Views) -> DataFrame:
    return margins.within_correlation(v.entries.withColumn("x", F.col("missing").cast("double")), "clone", "tape")


@query(""", g AS (SELECT clone, count(*) AS m, avg(r) AS mean, var_pop(r) AS v FROM rc GROUP BY clone), s AS (SELECT sum(m) AS n, count(*) AS g, sum(m * v) AS ssw, sum(m * mean) AS sx, sum(m * mean * mean) AS sm, sum(m * m) AS mm FROM g),
  t AS (SELECT n, g, (sm - sx * sx / n) / (g - 1) AS b, ssw / (n - g) AS w, (n - mm / n) / (g - 1) AS m0 FROM s)
  SELECT CAST(n AS BIGINT) AS n, g, round(b, 6) AS ms_between, round(w, 6) AS ms_within, round(((b - w) / m0) / ((b - w) / m0 + w), 6) AS share FROM t""")
def q_between_group(v: Views) -> DataFrame:
    return margins.noise_corrected_share(margins.cell_margin(v.entries), "clone", "r")


@query("""SELECT CAST(clone AS BIGINT) AS clone, CAST(tape AS BIGINT) AS tape, count(*) AS m, CAST(min(missing) AS BIGINT) AS all_missing, CAST(1 - max(missing) AS BIGINT) AS all_present, round(max(p), 6) AS p,
  round(pow(max(p), count(*)), 6) AS e_missing, round(pow(1 - max(p), count(*)), 6) AS e_present FROM entries JOIN rt USING (tape) GROUP BY clone, tape""")
def q_complete_loss(v: Views) -> DataFrame:
    return margins.complete_loss(v.entries)


PERMUTED = """, nh AS (SELECT perm, h.clone, t.x FROM (SELECT perm, sample, clone, row_number() OVER (PARTITION BY perm, sample ORDER BY cell) AS i FROM rc CROSS JOIN range(1, {b}) r(perm)) h
  JOIN (SELECT perm, sample, CAST(r AS DOUBLE) AS x, row_number() OVER (PARTITION BY perm, sample ORDER BY md5(concat_ws('|', '7', perm, cell)), cell) AS i FROM rc CROSS JOIN range(1, {b}) r2(perm)) t USING (perm, sample, i)),
  nx AS (SELECT perm, clone, x - avg(x) OVER (PARTITION BY perm) AS x FROM nh),
  no AS (SELECT perm, sum(s * s - q) AS i, sum(m * (m - 1)) AS n2 FROM (SELECT perm, clone, sum(x) AS s, sum(x * x) AS q, count(*) AS m FROM nx GROUP BY ALL) GROUP BY perm),
  np AS (SELECT perm, i / n2 / v AS rho_within FROM no JOIN (SELECT perm, avg(x * x) AS v FROM nx GROUP BY perm) USING (perm))"""


@query(PERMUTED.format(b=21) + " SELECT CAST(perm AS BIGINT) AS perm, round(rho_within, 6) AS rho_within FROM np")
def q_perm_within_clone(v: Views) -> DataFrame:
    x = margins.cell_margin(v.entries).withColumn("x", F.col("r").cast("double"))
    return margins.permutation_null(x, "clone", "sample", "cell", 20, 7)


@query(PERMUTED.format(b=51) + """, ox AS (SELECT clone, r - avg(r) OVER () AS x FROM rc), oo AS (SELECT sum(s * s - q) / sum(m * (m - 1)) AS i FROM (SELECT sum(x) AS s, sum(x * x) AS q, count(*) AS m FROM ox GROUP BY clone)), ob AS (SELECT round(i / (SELECT avg(x * x) FROM ox), 9) AS o FROM oo), nr AS (SELECT round(rho_within, 9) AS rho_within FROM np)
  SELECT round(avg(rho_within), 6) AS mean, round(stddev_samp(rho_within), 6) AS sd, round(quantile_cont(rho_within, 0.025), 6) AS q025, round(quantile_cont(rho_within, 0.975), 6) AS q975, count(*) AS b, round((any_value(o) - avg(rho_within)) / stddev_samp(rho_within), 6) AS z, round((1 + count(*) FILTER (rho_within >= o)) / (1 + count(*)), 6) AS p, round(any_value(o) - avg(rho_within), 6) AS excess FROM nr CROSS JOIN ob""")
def q_perm_null_summary(v: Views) -> DataFrame:
    x = margins.cell_margin(v.entries).withColumn("x", F.col("r").cast("double"))
    observed = margins.within_correlation(x, "clone")
    return margins.permutation_summary(margins.permutation_null(x, "clone", "sample", "cell", 50, 7), observed, "rho_within")


# Tries and characters.


NODES = """, nodes AS (SELECT clone, tape, d - 1 AS level, CASE WHEN d = 1 THEN '' ELSE substr(prefix, 1, length(prefix) - 9) END AS prefix, count(*) AS n_next, count(DISTINCT right(prefix, 8)) AS s FROM prefixes GROUP BY ALL)"""


@query(NODES + " SELECT CAST(clone AS BIGINT) AS clone, CAST(tape AS BIGINT) AS tape, CAST(level AS BIGINT) AS level, prefix, n_next, s FROM nodes")
def q_trie_nodes(v: Views) -> DataFrame:
    return trie.nodes(v.tapes).drop("symbols")


@query(NODES + """ SELECT CAST(level AS BIGINT) AS level, count(*) AS n_nodes, round(quantile_cont(s, 0.5), 6) AS median_s, round(avg(n_next), 6) AS mean_next, max(s) AS max_s, round(avg(CASE WHEN s >= 2 THEN 1 ELSE 0 END), 6) AS branching FROM nodes GROUP BY level""")
def q_trie_levels(v: Views) -> DataFrame:
    return trie.level_summary(trie.nodes(v.tapes))


@query("SELECT cell, CAST(tape AS BIGINT) AS tape, CAST(d AS BIGINT) AS d, dense_rank() OVER (PARTITION BY tape, d ORDER BY prefix) - 1 AS code FROM prefixes")
def q_prefix_codes(v: Views) -> DataFrame:
    return trie.prefix_codes(v.prefixes)


@query("SELECT CAST(clone AS BIGINT) AS clone, CAST(tape AS BIGINT) AS tape, CAST(d AS BIGINT) AS level, prefix, count(DISTINCT cell) AS m, array_to_string(list_sort(list(DISTINCT cell)), ',') AS cells FROM prefixes GROUP BY ALL HAVING count(DISTINCT cell) >= 2")
def q_characters(v: Views) -> DataFrame:
    return trie.characters(v.prefixes).withColumn("cells", F.array_join(F.col("cells").cast("array<string>"), ","))


@query()
def q_m_moment(v: Views) -> DataFrame:
    return trie.moment_estimates(trie.nodes(v.tapes).drop("symbols"), alphabet.shares(v.reads.where(F.col("sym").rlike(fixture.DESIGN)), []))


@query()
def q_m_mle(v: Views) -> DataFrame:
    return trie.likelihood_estimates(trie.nodes(v.tapes), alphabet.shares(v.reads.where(F.col("sym").rlike(fixture.DESIGN)), [])).drop("symbols")


CONSENSUS = """, pc AS (SELECT clone, tape, d, prefix, count(*) AS n FROM prefixes GROUP BY ALL), best AS (SELECT clone, tape, d, prefix, n FROM (SELECT *, sum(n) OVER (PARTITION BY clone, tape, d) AS a, row_number() OVER (PARTITION BY clone, tape, d ORDER BY n DESC, prefix) AS k FROM pc) WHERE k = 1 AND 20 * n >= a),
  cons AS (SELECT clone, tape, d, prefix, n FROM best WHERE d = 1 UNION ALL SELECT b.clone, b.tape, b.d, b.prefix, b.n FROM cons c JOIN best b ON b.clone = c.clone AND b.tape = c.tape AND b.d = c.d + 1 AND starts_with(b.prefix, c.prefix || '>'))"""


@query(CONSENSUS + " SELECT CAST(clone AS BIGINT) AS clone, CAST(tape AS BIGINT) AS tape, CAST(d AS BIGINT) AS d, prefix, n FROM cons")
def q_consensus(v: Views) -> DataFrame:
    return trie.consensus(v.prefixes, 20).select("clone", "tape", "d", "prefix", "n")


@query(CONSENSUS + """, j AS (SELECT x.clone AS a, y.clone AS b, count(*) AS tapes FROM cons x JOIN cons y ON x.tape = y.tape AND x.clone < y.clone WHERE x.d = 1 AND y.d = 1 GROUP BY ALL),
  s AS (SELECT x.clone AS a, y.clone AS b, count(*) AS n FROM cons x JOIN cons y ON x.tape = y.tape AND x.d = y.d AND x.prefix = y.prefix AND x.clone < y.clone GROUP BY ALL)
  SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, tapes, round(coalesce(n, 0) / tapes, 6) AS shared FROM j LEFT JOIN s USING (a, b)""")
def q_group_relatedness(v: Views) -> DataFrame:
    return relate.consensus_matrix(trie.consensus(v.prefixes, 20))


@query(CONSENSUS + """, m AS (SELECT p.cell, p.clone, c.clone AS rival, count(*) AS n FROM prefixes p JOIN cons c ON c.tape = p.tape AND c.d = p.d AND c.prefix = p.prefix GROUP BY ALL)
  SELECT cell, CAST(clone AS BIGINT) AS clone, coalesce(max(n) FILTER (rival = clone), 0) AS own, coalesce(max(n) FILTER (rival <> clone), 0) AS best,
  CAST(arg_min(rival, -n * 1000 + rival) FILTER (rival <> clone) AS BIGINT) AS rival FROM m GROUP BY cell, clone""")
def q_collision_flags(v: Views) -> DataFrame:
    return relate.collision_flags(v.prefixes, trie.consensus(v.prefixes, 20))


# Compatibility.


CHARS = """, ch AS (SELECT clone, tape, d AS level, prefix, count(DISTINCT cell) AS m, row_number() OVER (PARTITION BY clone ORDER BY tape, d, prefix) AS id FROM prefixes GROUP BY clone, tape, d, prefix HAVING count(DISTINCT cell) >= 2),
  cc AS (SELECT DISTINCT ch.clone, id, ch.tape, level, m, cell FROM ch JOIN prefixes p ON p.clone = ch.clone AND p.tape = ch.tape AND p.d = ch.level AND p.prefix = ch.prefix),
  pr AS (SELECT x.clone, x.id AS a, y.id AS b, x.tape AS ta, y.tape AS tb, x.level AS la, y.level AS lb, x.m AS ma, y.m AS mb, count(*) AS n11 FROM cc x JOIN cc y ON x.clone = y.clone AND x.cell = y.cell AND x.id < y.id AND x.tape <> y.tape GROUP BY ALL)"""
BIG = lambda *c: ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in c)


@query(CHARS + f" SELECT {BIG('clone', 'a', 'b', 'ta', 'tb', 'la', 'lb', 'ma', 'mb', 'n11')}, ma - n11 AS n10, mb - n11 AS n01, ma > n11 AND mb > n11 AS conflict FROM pr")
def q_pairs_as_absent(v: Views) -> DataFrame:
    return compat.as_absent(compat.co_occurring(v.characters()))


@query(CHARS + f""", da AS (SELECT clone, a, b, count(*) AS n FROM pr JOIN (SELECT clone, id AS a, cell FROM cc) c USING (clone, a) JOIN tapes t ON t.cell = c.cell AND t.tape = tb AND (t.depth >= lb OR t.term IN (1, 3)) GROUP BY ALL),
  db AS (SELECT clone, a, b, count(*) AS n FROM pr JOIN (SELECT clone, id AS b, cell FROM cc) c USING (clone, b) JOIN tapes t ON t.cell = c.cell AND t.tape = ta AND (t.depth >= la OR t.term IN (1, 3)) GROUP BY ALL)
  SELECT {BIG('clone', 'a', 'b', 'ta', 'tb', 'la', 'lb', 'ma', 'mb', 'n11')}, coalesce(da.n, 0) - n11 AS n10, coalesce(db.n, 0) - n11 AS n01, coalesce(da.n, 0) > n11 AND coalesce(db.n, 0) > n11 AS conflict FROM pr LEFT JOIN da USING (clone, a, b) LEFT JOIN db USING (clone, a, b)""")
def q_pairs_excluded(v: Views) -> DataFrame:
    c = written(v.characters(), "characters")
    return compat.excluding(compat.co_occurring(c), c, v.tapes)


@query(CHARS + """, e AS (SELECT clone, a, b FROM pr WHERE ma > n11 AND mb > n11), u AS (SELECT clone, a AS id FROM e UNION ALL SELECT clone, b FROM e)
  SELECT CAST(clone AS BIGINT) AS clone, CAST(id AS BIGINT) AS id, count(*) AS degree FROM u GROUP BY ALL""")
def q_conflict_degree(v: Views) -> DataFrame:
    return compat.degrees(compat.as_absent(compat.co_occurring(v.characters())).where("conflict"))


@query(CHARS + """, t AS (SELECT clone, CAST(sum(c) AS BIGINT) AS n_characters, CAST((sum(c) * sum(c) - sum(c * c)) / 2 AS BIGINT) AS n_pairs FROM (SELECT clone, tape, count(*) AS c FROM ch GROUP BY ALL) GROUP BY clone),
  e AS (SELECT clone, count(*) FILTER (ma > n11 AND mb > n11) AS n_conflicts FROM pr GROUP BY clone)
  SELECT CAST(clone AS BIGINT) AS clone, n_characters, n_pairs, coalesce(n_conflicts, 0) AS n_conflicts, round(CASE WHEN n_pairs > 0 THEN 1 - coalesce(n_conflicts, 0) / n_pairs END, 6) AS compatible FROM t LEFT JOIN e USING (clone)""")
def q_compat_rate(v: Views) -> DataFrame:
    c = v.characters()
    bad = compat.as_absent(compat.co_occurring(c)).groupBy("clone").agg(F.count_if("conflict").alias("_n"))
    out = compat.pair_totals(c).join(bad, "clone", "left").withColumn("n_conflicts", F.coalesce("_n", F.lit(0))).drop("_n")
    return out.withColumn("compatible", F.when(F.col("n_pairs") > 0, 1 - F.col("n_conflicts") / F.col("n_pairs")))


@query(CHARS + " SELECT CAST(clone AS BIGINT) AS clone, CAST(sum(k * (k - 1) / 2) AS BIGINT) AS pair_rows FROM (SELECT clone, cell, count(*) AS k FROM cc GROUP BY ALL) GROUP BY clone")
def q_pair_volume(v: Views) -> DataFrame:
    return compat.pair_volume(v.characters())


@query(CHARS + """, s AS (SELECT clone, id, tape, level, array_to_string(list_sort(list(cell)), ',') AS cells, count(*) AS size FROM cc GROUP BY ALL)
  SELECT CAST(clone AS BIGINT) AS clone, cells, count(*) AS copies, count(DISTINCT tape) AS support, CAST(min(level) AS BIGINT) AS depth, size FROM s GROUP BY clone, cells, size""")
def q_dedup_clades(v: Views) -> DataFrame:
    return compat.clades(v.characters()).withColumn("cells", F.array_join(F.col("cells").cast("array<string>"), ","))


def _skeleton(v: Views) -> DataFrame:
    return compat.laminar_skeleton(compat.proper_clades(compat.clades(v.characters()), v.cells))


#: SQL of the skeleton: a clade is accepted after the larger ones if it crosses none accepted before; nd has clone, node, parent, size, support, cells.
SKELETON = CHARS + """, s0 AS (SELECT clone, id, tape, list_sort(list(cell)) AS cells FROM cc GROUP BY ALL), w0 AS (SELECT clone, count(*) AS n FROM cells GROUP BY clone),
  s1 AS (SELECT clone, cells, len(cells) AS size, count(DISTINCT tape) AS support FROM s0 JOIN w0 USING (clone) WHERE len(cells) >= 2 AND len(cells) < n GROUP BY clone, cells),
  s2 AS (SELECT *, row_number() OVER (PARTITION BY clone ORDER BY size DESC, support DESC, cells) AS k FROM s1),
  ac(clone, k, acc, ok) AS (SELECT DISTINCT clone, CAST(0 AS BIGINT), CAST([] AS BIGINT[][]), false FROM s2
    UNION ALL SELECT a.clone, a.k + 1, CASE WHEN len(list_filter(acc, lambda y: list_has_any(y, cells) AND NOT list_has_all(y, cells))) = 0 THEN list_append(acc, cells) ELSE acc END,
      len(list_filter(acc, lambda y: list_has_any(y, cells) AND NOT list_has_all(y, cells))) = 0 FROM ac a JOIN s2 ON s2.clone = a.clone AND s2.k = a.k + 1),
  nd AS (SELECT clone, len(acc) - 1 AS node, list_max(list_filter(range(1, len(acc)), lambda i: list_has_all(acc[i], cells))) - 1 AS parent, size, support FROM ac JOIN s2 USING (clone, k) WHERE ok)"""


@query(SKELETON + f" SELECT {BIG('clone', 'node', 'parent', 'size', 'support')} FROM nd")
def q_skeleton(v: Views) -> DataFrame:
    return _skeleton(v)


@query(SKELETON + """, al AS (SELECT clone, node, size FROM nd UNION ALL SELECT clone, NULL, count(*) FROM cells WHERE clone IN (SELECT clone FROM cells) GROUP BY clone), inn AS (SELECT clone, coalesce(parent, -1) AS k, count(*) AS clades, sum(size) AS s FROM nd GROUP BY ALL)
  SELECT CAST(al.clone AS BIGINT) AS clone, CAST(node AS BIGINT) AS node, coalesce(clades, 0) AS clades, CAST(size - coalesce(s, 0) AS BIGINT) AS cells FROM al LEFT JOIN inn ON inn.clone = al.clone AND inn.k = coalesce(node, -1)""")
def q_polytomy(v: Views) -> DataFrame:
    return compat.children(_skeleton(v), v.cells)


@query()
def q_independent_set(v: Views) -> DataFrame:
    c = v.characters()
    return compat.independent_set(compat.as_absent(compat.co_occurring(c)).where("conflict"), c)


@query(CHARS + """, cl AS (SELECT clone, array_to_string(list_sort(list(cell)), ',') AS k, count(*) AS size, list(cell) AS cells FROM cc GROUP BY clone, id), dc AS (SELECT clone, k, size, any_value(cells) AS cells FROM cl GROUP BY ALL),
  x AS (SELECT clone, k, size, sample, count(*) AS n FROM (SELECT clone, k, size, unnest(cells) AS cell FROM dc) z JOIN (SELECT cell, sample FROM cells) s USING (cell) GROUP BY ALL),
  w AS (SELECT sample, count(*) AS whole FROM cells GROUP BY sample), y AS (SELECT clone, k, size, count(*) AS labels, count(*) FILTER (n < whole) AS broken FROM x JOIN w USING (sample) GROUP BY ALL)
  SELECT CASE WHEN labels = 1 THEN 'WITHIN' WHEN broken = 0 THEN 'UNION' ELSE 'STRADDLE' END AS kind, count(*) AS n FROM y GROUP BY kind""")
def q_groundtruth_class(v: Views) -> DataFrame:
    return compat.truth_class(compat.clades(v.characters()), v.cells.select("cell", F.col("sample").alias("label"))).groupBy("kind").agg(F.count("*").alias("n"))


# The event scan.


COMBOS = """, pe AS (SELECT cell, clone, e.tape, missing, greatest(least(p, 1 - 1e-6), 1e-6) AS p FROM entries e JOIN rt USING (tape)),
  mem AS (SELECT clone, tape AS anchor, d, prefix, cell, count(*) OVER (PARTITION BY clone, tape, d, prefix) AS cm FROM prefixes),
  co AS (SELECT m.clone, anchor, d, prefix, e.tape, count(*) AS m, CAST(sum(missing) AS BIGINT) AS k, sum(p) AS e, sum(p * (1 - p)) AS v,
         sum(CASE WHEN missing = 1 THEN ln(0.95) - ln(p) ELSE ln(0.05) - ln(1 - p) END) AS hard, sum(CASE WHEN missing = 1 THEN ln(p) ELSE ln(1 - p) END) AS u
         FROM mem m JOIN pe e ON e.cell = m.cell AND e.tape <> anchor WHERE cm >= 4 GROUP BY ALL),
  st AS (SELECT *, CASE WHEN k > e THEN CASE WHEN k = 0 THEN 0 ELSE k * ln(k / m) END + CASE WHEN m = k THEN 0 ELSE (m - k) * ln((m - k) / m) END - u ELSE 0 END AS soft, (k - e) / sqrt(v) AS z,
         CASE WHEN m < 6 THEN 0 WHEN m < 10 THEN 1 WHEN m < 20 THEN 2 WHEN m < 50 THEN 3 WHEN m < 200 THEN 4 ELSE 5 END AS stratum FROM co)"""


def _stats(v: Views) -> DataFrame:
    return scan.statistics(scan.tape_combos(v.tapes, scan.with_rates(v.entries)))


@query(COMBOS + f" SELECT {BIG('clone', 'anchor', 'd')}, prefix, {BIG('tape', 'm', 'k')}, round(e, 6) AS e, round(v, 6) AS v, round(hard, 6) AS hard, round(u, 6) AS u FROM co")
def q_scan_counts(v: Views) -> DataFrame:
    return scan.tape_combos(v.tapes, scan.with_rates(v.entries))


@query(COMBOS + f" SELECT {BIG('clone', 'anchor', 'd')}, prefix, {BIG('tape', 'stratum')}, round(hard, 5) AS hard, round(soft, 5) AS soft, round(z, 5) AS z FROM st", digits=5)
def q_score_z(v: Views) -> DataFrame:
    return _stats(v).select("clone", "anchor", "d", "prefix", "tape", "stratum", "hard", "soft", "z")


@query(COMBOS + """, h AS (SELECT stratum, CAST(least(floor((hard + 20) / 0.25), 599) AS BIGINT) AS t_idx, count(*) AS n FROM st WHERE hard >= -20 GROUP BY ALL)
  SELECT CAST(g.stratum AS BIGINT) AS stratum, g.t_idx, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.stratum ORDER BY g.t_idx DESC) AS BIGINT) AS n_above
  FROM (SELECT stratum, t_idx FROM (SELECT DISTINCT stratum FROM st) CROSS JOIN range(0, 600) r(t_idx)) g LEFT JOIN h ON h.stratum = g.stratum AND h.t_idx = g.t_idx""")
def q_stratum_counts(v: Views) -> DataFrame:
    return scan.counts_above(_stats(v), "hard", -20, 0.25, 600)


@query("""SELECT CAST(clone AS BIGINT) AS clone, CAST(e.tape AS BIGINT) AS tape, count(*) AS m, CAST(sum(missing) AS BIGINT) AS k, round(sum(greatest(least(p, 1 - 1e-6), 1e-6)), 6) AS e,
  round(sum(CASE WHEN missing = 1 THEN ln(0.95) - ln(greatest(least(p, 1 - 1e-6), 1e-6)) ELSE ln(0.05) - ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)) END), 6) AS hard
  FROM entries e JOIN rt USING (tape) GROUP BY clone, e.tape HAVING count(*) >= 5""")
def q_clone_wide(v: Views) -> DataFrame:
    return scan.clone_wide(scan.with_rates(v.entries))


#: Permutations of the null of the event scan.
PERMUTATIONS = 100


def _null_counts(v: Views, permutations: int = PERMUTATIONS) -> tuple[DataFrame, DataFrame]:
    """Counts over clades of every depth, and their means over permutations, made in one job. Scores are taken to nine digits."""
    all_ = scan.tallied_combos(scan.clade_counts(v.prefixes, scan.with_rates(v.entries), permutations, 101), together=True)
    near = scan.statistics(all_).withColumn("soft", F.round("soft", 9))
    seen = scan.counts_above(near.where("perm = 0"), "soft", 0, 0.25, 40, "n")
    null = scan.counts_above(near.where("perm = 1"), "soft", 0, 0.25, 40, "n")
    return seen, null.select("stratum", "t_idx", (F.col("n_above") / permutations).alias("expected"))


FDR = COMBOS + f""", pm AS (SELECT perm, h.cell, t.cell AS source FROM (SELECT perm, clone, cell, row_number() OVER (PARTITION BY perm, clone ORDER BY cell) AS i FROM cells CROSS JOIN range(1, {PERMUTATIONS + 1}) r(perm)) h
  JOIN (SELECT perm, clone, cell, row_number() OVER (PARTITION BY perm, clone ORDER BY md5(concat_ws('|', '101', perm, cell)), cell) AS i FROM cells CROSS JOIN range(1, {PERMUTATIONS + 1}) r(perm)) t USING (perm, clone, i)),
  nc AS (SELECT perm, m.clone, anchor, d, prefix, e.tape, count(*) AS m, CAST(sum(missing) AS BIGINT) AS k, sum(p) AS e, sum(CASE WHEN missing = 1 THEN ln(p) ELSE ln(1 - p) END) AS u
         FROM mem m JOIN pm ON pm.cell = m.cell JOIN pe e ON e.cell = pm.source AND e.tape <> anchor WHERE cm >= 4 GROUP BY ALL),
  sc AS (SELECT true AS seen, stratum, round(soft, 9) AS soft FROM st UNION ALL SELECT false, CASE WHEN m < 6 THEN 0 WHEN m < 10 THEN 1 WHEN m < 20 THEN 2 WHEN m < 50 THEN 3 WHEN m < 200 THEN 4 ELSE 5 END,
         round(CASE WHEN k > e THEN CASE WHEN k = 0 THEN 0 ELSE k * ln(k / m) END + CASE WHEN m = k THEN 0 ELSE (m - k) * ln((m - k) / m) END - u ELSE 0 END, 9) FROM nc),
  hi AS (SELECT seen, stratum, CAST(least(floor(soft / 0.25), 39) AS BIGINT) AS t_idx, count(*) AS n FROM sc WHERE soft >= 0 GROUP BY ALL),
  ab AS (SELECT g.seen, g.stratum, g.t_idx, sum(coalesce(n, 0)) OVER (PARTITION BY g.seen, g.stratum ORDER BY g.t_idx DESC) AS n FROM (SELECT seen, stratum, t_idx FROM (SELECT DISTINCT seen, stratum FROM sc) CROSS JOIN range(0, 40) r(t_idx)) g LEFT JOIN hi USING (seen, stratum, t_idx)),
  cv AS (SELECT o.stratum, o.t_idx, CAST(o.n AS BIGINT) AS n_above, x.n / {PERMUTATIONS} AS expected, min(least(1.0, x.n / {PERMUTATIONS} / greatest(o.n, 1))) OVER (PARTITION BY o.stratum ORDER BY o.t_idx) AS q FROM ab o JOIN ab x ON o.seen AND NOT x.seen AND x.stratum = o.stratum AND x.t_idx = o.t_idx)"""


@query(FDR + " SELECT CAST(stratum AS BIGINT) AS stratum, t_idx, n_above, round(expected, 6) AS expected, round(q, 6) AS q FROM cv")
def q_fdr_curve(v: Views) -> DataFrame:
    return scan.fdr_curve(*_null_counts(v))


@query(FDR + " SELECT CAST(stratum AS BIGINT) AS stratum, min(t_idx) FILTER (expected <= 1.0) AS t_idx, min(t_idx) FILTER (expected <= 1.0) IS NOT NULL AS reached FROM cv GROUP BY stratum")
def q_threshold_grid(v: Views) -> DataFrame:
    return scan.thresholds(scan.fdr_curve(*_null_counts(v)), budget=1.0)


@query(COMBOS + f""", pop AS (SELECT clone, tape, count(*) AS n_pop, CAST(sum(missing) AS BIGINT) AS k_pop FROM entries GROUP BY ALL)
  SELECT {BIG('clone', 'anchor', 'd')}, prefix, {BIG('tape', 'm', 'k', 'n_pop', 'k_pop')}, round(m * k_pop / n_pop, 6) AS e_pop, round(m * (n_pop - m) / (n_pop - 1) * (k_pop / n_pop) * (1 - k_pop / n_pop), 6) AS v_pop
  FROM co JOIN pop USING (clone, tape)""")
def q_exact_moments(v: Views) -> DataFrame:
    e = scan.with_rates(v.entries)
    return scan.exact_moments(scan.tape_combos(v.tapes, e), e).select("clone", "anchor", "d", "prefix", "tape", "m", "k", "n_pop", "k_pop", "e_pop", "v_pop")


def _exact(v: Views) -> DataFrame:
    e = scan.with_rates(v.entries)
    return scan.exact_moments(scan.statistics(scan.tape_combos(v.tapes, e)), e)


@query()
def q_exact_p(v: Views) -> DataFrame:
    return _exact(v).select("clone", "anchor", "d", "prefix", "tape", "p_normal", "p_hyper", "p_used")


@query(COMBOS + f""", pop AS (SELECT clone, tape, count(*) AS n_pop, CAST(sum(missing) AS BIGINT) AS k_pop FROM entries GROUP BY ALL),
  hy AS (SELECT clone, anchor, d, prefix, tape, m, k, n_pop, k_pop, unnest(range(greatest(k, m - (n_pop - k_pop), 0), least(k_pop, m) + 1)) AS i FROM co JOIN pop USING (clone, tape))
  SELECT {BIG('clone', 'anchor', 'd')}, prefix, CAST(tape AS BIGINT) AS tape, round(least(1.0, sum(exp(lgamma(k_pop + 1) - lgamma(i + 1) - lgamma(k_pop - i + 1) + lgamma(n_pop - k_pop + 1) - lgamma(m - i + 1) - lgamma(n_pop - k_pop - m + i + 1) - lgamma(n_pop + 1) + lgamma(m + 1) + lgamma(n_pop - m + 1)))), 6) AS p_hyper FROM hy GROUP BY clone, anchor, d, prefix, tape""")
def q_hyper_p(v: Views) -> DataFrame:
    return _exact(v).select("clone", "anchor", "d", "prefix", "tape", "p_hyper")


@query()
def q_bonferroni(v: Views) -> DataFrame:
    return scan.event_summary(scan.bonferroni(scan.testable(_exact(v)), "p_used", 1.0).where("passes AND k > e_pop"))


@query()
def q_survival_excess(v: Views) -> DataFrame:
    return scan.survival_excess(_exact(v), "p_used", [1, 2, 3, 4])


@query()
def q_detection_plane(v: Views) -> DataFrame:
    t = _exact(v)
    return scan.detection_plane(t.withColumns({"rate": F.col("k") / F.col("m"), "minus": -F.log10(F.greatest("p_used", F.lit(1e-12)))}), "rate", "minus", 10, 12, 12.0)


@query(""", r AS (SELECT tape, (avg(missing) FILTER (sample = 'BUILDING') - avg(missing)) AS diff FROM entries GROUP BY tape), k AS (SELECT tape, 1 / (1 + exp(diff * 50)) AS p FROM r),
  o AS (SELECT tape, p, row_number() OVER (ORDER BY p, tape) AS rank, count(*) OVER () AS n FROM k)
  SELECT CAST(tape AS BIGINT) AS tape, round(p, 6) AS p, rank, rank <= coalesce(max(CASE WHEN p <= 0.5 * rank / n THEN rank END) OVER (), 0) AS passes FROM o""")
def q_bh(v: Views) -> DataFrame:
    diff = F.avg(F.when(F.col("sample") == "BUILDING", F.col("missing"))) - F.avg("missing")
    p = v.entries.groupBy("tape").agg((1 / (1 + F.exp(diff * 50))).alias("p"))
    return scan.benjamini_hochberg(p, "p", "tape", 0.5)


#: SQL of the collapse of hits: greedy by the soft score, to nine digits; kp has the kept ones.
COLLAPSED = COMBOS + """, hi AS (SELECT *, round(soft, 9) AS sc FROM st WHERE z > 2), hc AS (SELECT hi.clone, hi.anchor, hi.d, hi.prefix, hi.tape, list(cell) AS cells, any_value(sc) AS sc FROM hi JOIN mem m ON m.clone = hi.clone AND m.anchor = hi.anchor AND m.d = hi.d AND m.prefix = hi.prefix GROUP BY ALL),
  hr AS (SELECT *, row_number() OVER (PARTITION BY clone, tape ORDER BY sc DESC, anchor, d, prefix) AS k FROM hc),
  gr(clone, tape, k, used, ok) AS (SELECT DISTINCT clone, tape, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false FROM hr
    UNION ALL SELECT g.clone, g.tape, g.k + 1, CASE WHEN list_has_any(used, cells) THEN used ELSE list_concat(used, cells) END, NOT list_has_any(used, cells) FROM gr g JOIN hr ON hr.clone = g.clone AND hr.tape = g.tape AND hr.k = g.k + 1),
  kp AS (SELECT hr.clone, hr.anchor, hr.d, hr.prefix, hr.tape FROM gr JOIN hr USING (clone, tape, k) WHERE ok)"""


def _collapsed(v: Views) -> DataFrame:
    hits = _stats(v).where("z > 2").withColumn("soft", F.round("soft", 9))
    return scan.collapse(hits, scan.clade_examples(v.tapes), "soft")


@query(COLLAPSED + f" SELECT {BIG('st.clone', 'st.anchor', 'st.d')}, st.prefix, {BIG('st.tape', 'stratum', 'm', 'k')}, round(e, 5) AS e, round(v, 5) AS v, round(hard, 5) AS hard, round(u, 5) AS u, round(soft, 5) AS soft, round(z, 5) AS z FROM st JOIN kp USING (clone, anchor, d, prefix, tape)".replace("AS st.", "AS "), digits=5)
def q_collapsed_events(v: Views) -> DataFrame:
    return _collapsed(v)


# Writes.


WR = """, wr0 AS (SELECT DISTINCT clone, tape, CASE WHEN d = 1 THEN '' ELSE substr(prefix, 1, length(prefix) - 9) END AS parent, right(prefix, 8) AS child, d AS site FROM prefixes),
  wr AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY clone, tape, parent) AS n FROM wr0) WHERE n >= 2)"""


@query(WR + f" SELECT {BIG('clone', 'tape')}, parent, child, {BIG('site')} FROM wr")
def q_writes(v: Views) -> DataFrame:
    return writes.independent_writes(v.tapes)


@query(WR + f" SELECT {BIG('tape', 'site')}, child, count(*) AS n FROM wr GROUP BY tape, site, child")
def q_contingency(v: Views) -> DataFrame:
    return writes.contingency(writes.independent_writes(v.tapes))


@query(WR + """, per AS (SELECT site, tape, child, count(*) AS n FROM wr GROUP BY ALL), f AS (SELECT a.site, a.tape, b.child, coalesce(n, 0) AS n FROM (SELECT DISTINCT site, tape FROM per) a JOIN (SELECT DISTINCT site, child FROM per) b USING (site) LEFT JOIN per USING (site, tape, child)),
  g AS (SELECT tape, child, n, sum(n) OVER (PARTITION BY site, tape) AS u, sum(n) OVER (PARTITION BY site, child) AS c, sum(n) OVER (PARTITION BY site) AS s FROM f),
  h AS (SELECT tape, child, sum(u * (n / u - (c - n) / (s - u))) / sum(u) AS diff FROM g WHERE s > u GROUP BY ALL)
  SELECT CAST(tape AS BIGINT) AS tape, round(sum(abs(diff)) / 2, 6) AS tv FROM h GROUP BY tape""")
def q_tv_stratified(v: Views) -> DataFrame:
    return writes.stratified_distance(writes.independent_writes(v.tapes), "site").drop("top_symbol")


MH = """, per AS (SELECT site, tape, child, count(*) AS a FROM wr GROUP BY ALL), t AS (SELECT tape, child, a, sum(a) OVER (PARTITION BY site, tape) - a AS b, sum(a) OVER (PARTITION BY site, child) - a AS c, sum(a) OVER (PARTITION BY site) - sum(a) OVER (PARTITION BY site, tape) - sum(a) OVER (PARTITION BY site, child) + a AS d FROM per),
  r AS (SELECT tape, child, a * d / n AS r, b * c / n AS s, (a + d) / n AS p, (b + c) / n AS q FROM (SELECT *, a + b + c + d AS n FROM t)),
  m AS (SELECT tape, child, sum(r) AS r, sum(s) AS s, sum(p * r) AS pr, sum(p * s + q * r) AS ps, sum(q * s) AS qs FROM r GROUP BY ALL),
  mh AS (SELECT tape, child, ln(r / s) AS log_or, pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s) AS variance FROM m WHERE r > 0 AND s > 0)"""


@query(WR + MH + " SELECT CAST(tape AS BIGINT) AS tape, child, round(log_or, 6) AS log_or, round(variance, 6) AS variance FROM mh")
def q_mantel_haenszel(v: Views) -> DataFrame:
    return writes.mantel_haenszel(writes.symbol_tables(writes.independent_writes(v.tapes), "tape", "site"), ["tape", "child"])


@query(WR + MH + """, z AS (SELECT tape, child AS item, log_or / sqrt(variance) AS z, row_number() OVER (PARTITION BY tape ORDER BY log_or / sqrt(variance), child) AS k FROM mh)
  SELECT CAST(tape AS BIGINT) AS tape, max(item) FILTER (k = 1) AS item, round(max(z) FILTER (k = 2) - max(z) FILTER (k = 1), 6) AS gap, coalesce(max(z) FILTER (k = 2) - max(z) FILTER (k = 1) >= 1.0, false) AS callable FROM z WHERE k <= 2 GROUP BY tape""")
def q_recovered_map(v: Views) -> DataFrame:
    z = writes.mantel_haenszel(writes.symbol_tables(writes.independent_writes(v.tapes), "tape", "site"), ["tape", "child"])
    return writes.call_map(z.select("tape", F.col("child").alias("item"), (F.col("log_or") / F.sqrt("variance")).alias("z")), "tape")


# Relatedness.


PAIRS = """, sh AS (SELECT x.clone, x.cell AS i, y.cell AS j, count(*) AS shared FROM prefixes x JOIN prefixes y ON x.clone = y.clone AND x.tape = y.tape AND x.d = y.d AND x.prefix = y.prefix AND x.cell < y.cell GROUP BY ALL),
  jo AS (SELECT x.clone, x.cell AS i, y.cell AS j, count(*) AS joint FROM tapes x JOIN tapes y ON x.clone = y.clone AND x.tape = y.tape AND x.cell < y.cell WHERE x.depth > 0 AND y.depth > 0 GROUP BY ALL),
  pa AS (SELECT clone, i, j, coalesce(shared, 0) AS shared, joint, coalesce(shared, 0) / joint AS rel FROM jo LEFT JOIN sh USING (clone, i, j)),
  near AS (SELECT clone, i, j, rank FROM (SELECT clone, i, j, row_number() OVER (PARTITION BY i ORDER BY rel DESC, j) AS rank FROM (SELECT clone, i, j, rel FROM pa UNION ALL SELECT clone, j, i, rel FROM pa)) WHERE rank <= 5)"""


@query(PAIRS + " SELECT CAST(clone AS BIGINT) AS clone, i, j, shared, joint, round(rel, 6) AS rel FROM pa")
def q_relatedness_pairs(v: Views) -> DataFrame:
    return relate.pairs(v.prefixes, v.tapes)


@query(PAIRS + " SELECT CAST(clone AS BIGINT) AS clone, i, j, rank FROM near")
def q_knn(v: Views) -> DataFrame:
    return relate.nearest_mates(v.prefixes, v.tapes, 5)


@query(PAIRS + """, nm AS (SELECT i, e.tape, sum(missing) AS k FROM near JOIN entries e ON e.cell = j GROUP BY ALL)
  SELECT CAST(k AS BIGINT) AS k, count(*) AS n_entries, CAST(sum(missing) AS BIGINT) AS n_missing FROM nm JOIN entries e ON e.cell = i AND e.tape = nm.tape GROUP BY k""")
def q_neighbour_counts(v: Views) -> DataFrame:
    near = relate.nearest_mates(v.prefixes, v.tapes, 5)
    return relate.hits_by_count(relate.neighbour_missing(near, v.entries), v.entries)


@query(PAIRS + """, s AS (SELECT i, e.tape, min(missing) AS a, max(missing) AS b FROM near JOIN entries e ON e.cell = j GROUP BY ALL)
  SELECT CAST(tape AS BIGINT) AS tape, count(*) AS sets, CAST(sum(a) AS BIGINT) AS all_missing, CAST(sum(1 - b) AS BIGINT) AS all_present FROM s GROUP BY tape""")
def q_unanimity(v: Views) -> DataFrame:
    return relate.unanimity(relate.nearest_mates(v.prefixes, v.tapes, 5), v.entries)


@query(PAIRS + """, ed AS (SELECT list_distinct([quantile_cont(rel, 0), quantile_cont(rel, 0.25), quantile_cont(rel, 0.5), quantile_cont(rel, 0.75)]) AS e FROM pa), lo AS (SELECT unnest(e) AS low FROM ed), bi AS (SELECT row_number() OVER (ORDER BY low) - 1 AS bin, low, lead(low) OVER (ORDER BY low) AS high FROM lo),
  re AS (SELECT cell, e.tape, (missing - p) / sqrt(p * (1 - p)) AS r FROM (SELECT cell, tape, missing FROM entries) e JOIN (SELECT tape, greatest(least(p, 1 - 1e-6), 1e-6) AS p FROM rt) q USING (tape))
  SELECT bin, count(DISTINCT (i, j)) AS n_pairs, round(avg(rel), 6) AS mean_rel, round(avg(x.r * y.r), 6) AS product FROM pa JOIN bi ON rel >= low AND (high IS NULL OR rel < high) JOIN re x ON x.cell = i JOIN re y ON y.cell = j AND y.tape = x.tape GROUP BY bin""")
def q_variogram_bins(v: Views) -> DataFrame:
    return relate.variogram(relate.products_by_relatedness(v.prefixes, v.tapes, relate.residuals(scan.with_rates(v.entries))), 4)


@query(""", rg AS (SELECT clone, cell, row_number() OVER (PARTITION BY clone ORDER BY md5(concat_ws('|', '9', cell)), cell) - 1 AS pos, count(*) OVER (PARTITION BY clone) AS n FROM cells)
  SELECT CAST(a.clone AS BIGINT) AS clone, a.cell AS i, b.cell AS j, k AS rank FROM rg a CROSS JOIN range(1, 6) r(k) JOIN rg b ON b.clone = a.clone AND b.pos = (a.pos + k) % a.n WHERE a.n > 1 AND k <= a.n - 1""")
def q_random_mates(v: Views) -> DataFrame:
    return relate.random_mates(v.cells.select("cell", "clone"), 5, 9)


@query(""", rk AS (SELECT clone, cell, row_number() OVER (PARTITION BY clone ORDER BY r, cell) AS k, greatest(3, count(*) OVER (PARTITION BY clone) // 40) AS w FROM rc),
  nr AS (SELECT a.clone, a.cell AS i, b.cell AS j, row_number() OVER (PARTITION BY a.cell ORDER BY md5(concat_ws('|', '9', a.cell, b.cell)), b.cell) AS rank FROM rk a JOIN rk b ON a.clone = b.clone AND a.cell <> b.cell AND abs(a.k - b.k) <= a.w)
  SELECT CAST(clone AS BIGINT) AS clone, i, j, rank FROM nr WHERE rank <= 5""")
def q_caliper_match(v: Views) -> DataFrame:
    return relate.caliper_mates(margins.cell_margin(v.entries), "r", 5, 9)


# Fits.


@query()
def q_twoway_fit(v: Views) -> DataFrame:
    return fit.two_way(v.entries).select("cell", "tape", "missing", "p")


@query()
def q_third_margin(v: Views) -> DataFrame:
    return fit.clone_margins(fit.two_way(v.entries))


def _nats(k: str, name: str) -> str:
    by = f"PARTITION BY {k}" if k else ""
    return f"SELECT '{name}' AS model, count(*) AS n, round(sum(CASE WHEN missing = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS nats FROM (SELECT missing, greatest(least((sum(missing) OVER ({by}) + 0.5) / (count(*) OVER ({by}) + 1), 1 - 1e-6), 1e-6) AS q FROM entries)"


@query(" UNION ALL ".join((_nats("", "M0"), _nats("clone", "M1"), _nats("cell", "M2"))))
def q_ladder_m0_m2(v: Views) -> DataFrame:
    return fit.ladder(v.entries)


# Trees.


def key_tree(v: Views) -> DataFrame:
    """The world, its regions, nations and customers as one tree; a node's time is its level."""
    t = lambda n: fixture.table(v.spark, v.dir, n)
    node = lambda df, key, parent, at, tip: df.select(F.lit(0).cast("long").alias("tree"), key.cast("long").alias("node"), parent.cast("long").alias("parent"), F.lit(float(at)).alias("t"), F.lit(tip).alias("tip"))
    out = node(v.spark.range(1), F.lit(0), F.lit(None), 0, False)
    out = out.unionByName(node(t("region"), F.col("r_regionkey") + 1, F.lit(0), 1, False))
    out = out.unionByName(node(t("nation"), F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, 2, False))
    return out.unionByName(node(t("customer"), F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, 3, True))


KEYS = """, kt(node, parent, t, tip) AS (SELECT 0, NULL, 0.0, false UNION ALL SELECT r_regionkey + 1, 0, 1.0, false FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, 2.0, false FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 3.0, true FROM customer),
  up(node, anc, steps) AS (SELECT node, node, 0 FROM kt UNION ALL SELECT up.node, kt.parent, steps + 1 FROM up JOIN kt ON kt.node = up.anc WHERE kt.parent IS NOT NULL)"""


@query(KEYS + " SELECT CAST(0 AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, CAST(anc AS BIGINT) AS anc, CAST(steps AS BIGINT) AS steps FROM up")
def q_tree_closure(v: Views) -> DataFrame:
    return tree.closure(key_tree(v))


@query(KEYS + " SELECT CAST(0 AS BIGINT) AS tree, CAST(anc AS BIGINT) AS node, count(*) AS n_tips FROM up JOIN kt USING (node) WHERE tip GROUP BY anc")
def q_clade_sizes(v: Views) -> DataFrame:
    return tree.clade_sizes(key_tree(v))


@query(KEYS + """, p AS (SELECT DISTINCT o_custkey % (SELECT max(c_custkey) FROM customer) + 1000 AS i, o_custkey + 1000 AS j FROM orders WHERE o_orderkey % 50 = 0 AND o_custkey % (SELECT max(c_custkey) FROM customer) <> o_custkey),
  m AS (SELECT i, j, arg_max(x.anc, 10 - x.steps) AS lca FROM p JOIN up x ON x.node = i JOIN up y ON y.node = j AND y.anc = x.anc GROUP BY i, j)
  SELECT CAST(0 AS BIGINT) AS tree, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(lca AS BIGINT) AS lca FROM m""".replace("""SELECT DISTINCT o_custkey % (SELECT max(c_custkey) FROM customer) + 1000 AS i, o_custkey + 1000 AS j FROM orders WHERE o_orderkey % 50 = 0 AND o_custkey % (SELECT max(c_custkey) FROM customer) <> o_custkey""", """SELECT DISTINCT a.c_custkey + 1000 AS i, b.c_custkey + 1000 AS j FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7"""))
def q_lca(v: Views) -> DataFrame:
    c = fixture.table(v.spark, v.dir, "customer").select("c_custkey")
    other = c.select((F.col("c_custkey") - 7).alias("c_custkey"))
    pairs = c.join(other, "c_custkey").select(F.lit(0).cast("long").alias("tree"), (F.col("c_custkey") + 1000).cast("long").alias("i"), (F.col("c_custkey") + 1007).cast("long").alias("j"))
    return tree.last_common_ancestor(key_tree(v), pairs)


@query(KEYS + """, l(node, key) AS (SELECT n_nationkey + 100, n_nationkey % 3 FROM nation WHERE n_nationkey % 4 = 0), h AS (SELECT DISTINCT node, key FROM up JOIN (SELECT node AS anc, key FROM l) USING (anc))
  SELECT CAST(0 AS BIGINT) AS tree, CAST(kt.node AS BIGINT) AS node, CAST(k.key AS BIGINT) AS key, h.node IS NOT NULL AS lost FROM kt CROSS JOIN (SELECT DISTINCT key FROM l) k LEFT JOIN h ON h.node = kt.node AND h.key = k.key""")
def q_dollo_propagate(v: Views) -> DataFrame:
    n = fixture.table(v.spark, v.dir, "nation").where("n_nationkey % 4 = 0")
    lost = n.select(F.lit(0).cast("long").alias("tree"), (F.col("n_nationkey") + 100).cast("long").alias("node"), (F.col("n_nationkey") % 3).alias("key"))
    return tree.propagate(key_tree(v), lost)


@query(KEYS + " SELECT CAST(0 AS BIGINT) AS tree, idx, count(*) AS n FROM (SELECT c.t, p.t AS t0 FROM kt c JOIN kt p ON p.node = c.parent) JOIN range(1, 7) r(idx) ON idx * 0.5 > t0 AND idx * 0.5 <= t GROUP BY idx")
def q_ltt(v: Views) -> DataFrame:
    return tree.lineages(key_tree(v), 6)


@query("""SELECT 'roots' AS fault, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'orphan', count(*) FROM customer WHERE c_custkey % 100 = 1 UNION ALL SELECT 'order', count(*) FROM customer WHERE c_custkey % 100 = 2
  UNION ALL SELECT 'tip', count(*) FROM customer WHERE c_custkey % 100 = 3 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)""")
def q_tree_faults(v: Views) -> DataFrame:
    """A second root, customers whose parent is missing, that come before their nation, or that hang from another customer."""
    at = F.col("node") - 1000
    t = key_tree(v)
    tip = F.col("tip")
    parent = F.when(tip & (at % 100 == 1), F.lit(-7)).when(tip & (at % 100 == 3) & (at < F.col("_n")), F.col("node") + 1).otherwise(F.col("parent"))
    last = t.agg((F.max("node") - 1000).alias("_n"))
    planted = t.join(F.broadcast(last)).select("tree", "node", parent.cast("long").alias("parent"), F.when(tip & (at % 100 == 2), 0.5).otherwise(F.col("t")).alias("t"), "tip")
    second = v.spark.createDataFrame([(0, 10**9, None, 0.0, False)], planted.schema)
    return tree.faults(planted.unionByName(second))


@query(KEYS + """, hi AS (SELECT anc AS node, max(steps) AS h FROM up JOIN kt USING (node) WHERE tip GROUP BY anc)
  SELECT CAST(0 AS BIGINT) AS tree, count(*) AS n_nodes, count(*) FILTER (c.tip) AS n_tips, round(sum(coalesce(c.t - p.t, 0)), 6) AS length, round(max(c.t), 6) AS height, (SELECT round(sum(1 / h), 6) FROM hi JOIN kt USING (node) WHERE h > 0 AND parent IS NOT NULL) AS b1 FROM kt c LEFT JOIN kt p ON p.node = c.parent""")
def q_tree_statistics(v: Views) -> DataFrame:
    t = key_tree(v)
    return tree.statistics(t).join(tree.balance(t), "tree")


@query("""SELECT CAST(0 AS BIGINT) AS tree, '(' || string_agg(CASE WHEN r IS NULL THEN CAST(r_regionkey + 1 AS VARCHAR) ELSE '(' || r || ')' END || ':1', ',' ORDER BY r_regionkey) || ');' AS text FROM region LEFT JOIN (
  SELECT n_regionkey, string_agg(CASE WHEN c IS NULL THEN CAST(n_nationkey + 100 AS VARCHAR) ELSE '(' || c || ')' END || ':1', ',' ORDER BY n_nationkey) AS r FROM nation LEFT JOIN (
  SELECT c_nationkey, string_agg(CAST(c_custkey + 1000 AS VARCHAR) || ':1', ',' ORDER BY c_custkey) AS c FROM customer GROUP BY c_nationkey) ON c_nationkey = n_nationkey GROUP BY n_regionkey) ON n_regionkey = r_regionkey""")
def q_newick(v: Views) -> DataFrame:
    return tree.newick(key_tree(v))


@query(f""", sy AS (SELECT sym, count(*) / sum(count(*)) OVER () AS p FROM reads WHERE regexp_matches(sym, '{fixture.DESIGN}') GROUP BY sym),
  ps AS (SELECT cell, tape, sum(ln(p)) AS lp FROM (SELECT cell, tape, unnest(read) AS sym FROM tapes) JOIN sy USING (sym) GROUP BY ALL),
  po AS (SELECT k, CASE WHEN k < 6 THEN exp(k * ln(2.5) - 2.5 - lgamma(k + 1)) ELSE 1 - (SELECT sum(exp(i * ln(2.5) - 2.5 - lgamma(i + 1))) FROM range(0, 6) r(i)) END AS p FROM range(0, 7) r(k))
  SELECT CAST(e.clone AS BIGINT) AS tree, CAST(e.tape AS BIGINT) AS tape, round(sum(CASE WHEN missing = 1 THEN ln(0.2) ELSE ln(0.8) + ln(po.p) + coalesce(lp, 0) END), 5) AS loglik
  FROM entries e LEFT JOIN tapes t ON t.cell = e.cell AND t.tape = e.tape LEFT JOIN po ON po.k = t.depth LEFT JOIN ps ON ps.cell = e.cell AND ps.tape = e.tape GROUP BY e.clone, e.tape""", digits=5)
def q_loglik(v: Views) -> DataFrame:
    """Each clone as a star of its cells, one unit of time below the founder: the likelihood has a closed form."""
    top = 10**12
    tips = v.cells.select(F.col("clone").cast("long").alias("tree"), F.col("cell").cast("long").alias("node"), (F.col("clone") + top).cast("long").alias("parent"), F.lit(1.0).alias("t"), F.lit(True).alias("tip"))
    roots = v.cells.select("clone").distinct().select(F.col("clone").cast("long").alias("tree"), (F.col("clone") + top).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("t"), F.lit(False).alias("tip"))
    known = alphabet.shares(v.reads.where(F.col("sym").rlike(fixture.DESIGN)), []).orderBy("sym").collect()  # an alphabet
    code = F.create_map(*(x for i, r in enumerate(known) for x in (F.lit(r["sym"]), F.lit(i))))
    shown = v.tapes.select(F.col("clone").cast("long").alias("tree"), F.col("cell").cast("long").alias("node"), "tape", F.transform("read", lambda x: code[x]).alias("read"), F.lit(True).alias("seen"))
    asked = roots.select("tree").join(F.broadcast(v.tapes.select("tape").distinct()))
    return likelihood.log_likelihoods(tips.unionByName(roots), shown, 2.5, [r["p"] for r in known], missed=0.2, tapes=asked)


@query(KEYS + """ SELECT CAST(0 AS BIGINT) AS tree, round(sum(ln(0.5 * 0.7 * 0.7 * exp(-0.7 * (4 - t)) / pow(0.5 + 0.2 * exp(-0.7 * (4 - t)), 2) / (0.5 * (1 - exp(-2.8)) / (0.5 + 0.2 * exp(-2.8))))), 5) AS log_prior FROM kt WHERE NOT tip""", digits=5)
def q_tree_prior(v: Views) -> DataFrame:
    return likelihood.tree_prior(key_tree(v), 1.0, 0.3, 0.5, 4.0)


@query(KEYS + """, hh AS (SELECT c.node, c.tip, 3.5 - c.t AS h, coalesce(3.5 - p.t, 4.0) AS hp FROM (SELECT node, parent, t, tip FROM kt) c LEFT JOIN kt p ON p.node = c.parent)
  SELECT CAST(0 AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, round(ln(h / hp / (1 - h / hp)), 6) AS x, round(4 - h, 6) AS t FROM hh WHERE NOT tip""")
def q_height_ratios(v: Views) -> DataFrame:
    """Nodes' times from a founder half a level above the root, as ratios and back again."""
    t = key_tree(v).withColumn("t", F.col("t") + 0.5)
    x = likelihood.height_ratios(t, 4.0)
    return x.join(likelihood.times_of_ratios(t, x, 4.0), ["tree", "node"])


@query(KEYS + """, hh AS (SELECT c.tip, 3.5 - c.t AS h, coalesce(3.5 - p.t, 4.0) AS hp FROM kt c LEFT JOIN kt p ON p.node = c.parent)
  SELECT CAST(0 AS BIGINT) AS tree, round(sum(ln(hp) + ln(h / hp) + ln(1 - h / hp)), 6) AS log_jacobian FROM hh WHERE NOT tip""")
def q_log_jacobian(v: Views) -> DataFrame:
    return likelihood.log_jacobian(key_tree(v).withColumn("t", F.col("t") + 0.5), 4.0)


# Events (the batch form of the streaming reads).


@query()
def q_event_reads_sites(v: Views) -> DataFrame:
    return ingest.from_events(fixture.table(v.spark, v.dir, "events")).groupBy("site", "sym").agg(F.count("*").alias("n"))


ORACLE["q_event_reads_sites"] = """WITH r AS (SELECT event_type AS sym, row_number() OVER (PARTITION BY user_id, day(ts) % 8 ORDER BY ts, event_id) AS site FROM events)
  SELECT site, sym, count(*) AS n FROM r WHERE site <= 6 GROUP BY ALL"""


# More margins, trees and summaries.


@query(CHARS + """ SELECT CAST(clone AS BIGINT) AS clone, CAST(tape AS BIGINT) AS tape, CAST(level AS BIGINT) AS level, label, count(*) AS n FROM (
  SELECT c.clone, k.tape, k.level, CASE WHEN cc.id IS NOT NULL THEN CAST(cc.id AS VARCHAR) WHEN t.depth >= k.level OR t.term IN (1, 3) THEN 'ABSENT' ELSE 'UNDET' END AS label
  FROM cells c JOIN (SELECT DISTINCT clone, tape, level FROM ch) k USING (clone) LEFT JOIN tapes t ON t.cell = c.cell AND t.tape = k.tape
  LEFT JOIN cc ON cc.cell = c.cell AND cc.clone = c.clone AND cc.tape = k.tape AND cc.level = k.level) GROUP BY clone, tape, level, label""")
def q_label_counts(v: Views) -> DataFrame:
    return trie.labels(v.tapes, v.characters(), v.cells).groupBy("clone", "tape", "level", "label").agg(F.count("*").alias("n"))


@query("""SELECT CAST(clone AS BIGINT) AS clone, CAST(max(m) AS BIGINT) AS m, count(*) AS n_tapes, count(*) FILTER (k >= 3 AND k <= m - 3) AS informative
  FROM (SELECT clone, tape, count(*) AS m, sum(missing) AS k FROM entries GROUP BY ALL) GROUP BY clone""")
def q_feasibility(v: Views) -> DataFrame:
    return margins.feasibility(v.entries)


@query(COMBOS + """, xx AS (SELECT cell, clone, tape, missing - p AS x FROM pe), wh AS (SELECT clone, tape, (sum(x) * sum(x) - sum(x * x)) / (count(*) * (count(*) - 1)) AS mean FROM xx GROUP BY ALL HAVING count(*) > 1),
  ow AS (SELECT m.clone, anchor, d, prefix, x.tape, count(*) * (count(*) - 1) AS pairs, sum(x) * sum(x) - sum(x * x) AS s FROM mem m JOIN xx x ON x.cell = m.cell AND x.tape <> anchor GROUP BY ALL HAVING count(*) > 1)
  SELECT CAST(d AS BIGINT) AS d, CAST(sum(pairs) AS BIGINT) AS pairs, round(sum(s) / sum(pairs), 6) AS observed, round(sum(pairs * mean) / sum(pairs), 6) AS null, round(sum(s) / sum(pairs) - sum(pairs * mean) / sum(pairs), 6) AS excess FROM ow JOIN wh USING (clone, tape) GROUP BY d""".replace("AS null", 'AS "null"'))
def q_lineage_depth(v: Views) -> DataFrame:
    return margins.lineage_excess(v.prefixes, scan.with_rates(v.entries))


@query(""", x AS (SELECT clone, r - avg(r) OVER () AS x FROM rc), g AS (SELECT clone, count(*) AS m, sum(x) * sum(x) - sum(x * x) AS s, count(*) * (count(*) - 1) AS n FROM x GROUP BY clone HAVING count(*) > 1),
  h AS (SELECT *, row_number() OVER (ORDER BY m DESC, clone) = 1 AS big FROM g), v AS (SELECT avg(x * x) AS v FROM x)
  SELECT round(sum(s) / sum(n) / any_value(v), 6) AS pooled, round(sum(s) FILTER (NOT big) / sum(n) FILTER (NOT big) / any_value(v), 6) AS without_largest, round(avg(s / n) / any_value(v), 6) AS equal_weight, round(avg(CASE WHEN s > 0 THEN 1 ELSE 0 END), 6) AS share_positive FROM h CROSS JOIN v""")
def q_clone_decomposition(v: Views) -> DataFrame:
    return margins.group_decomposition(margins.cell_margin(v.entries).withColumn("x", F.col("r").cast("double")), "clone")


@query("SELECT CAST(CASE WHEN r < 0 THEN 0 WHEN r >= 20 THEN 11 ELSE floor(r / 2) + 1 END AS BIGINT) AS bin, count(*) AS n FROM rc GROUP BY ALL")
def q_rate_histogram(v: Views) -> DataFrame:
    return margins.rate_histogram(margins.cell_margin(v.entries), "r", 0.0, 20.0, 10)


@query(COMBOS + """, cs AS (SELECT clone, count(*) AS size FROM cells GROUP BY clone)
  SELECT CASE WHEN size < 5 THEN 0 WHEN size < 50 THEN 1 ELSE 2 END AS band, count(*) AS tests, count(*) FILTER (z > 2) AS hits FROM st JOIN cs USING (clone) GROUP BY band""")
def q_events_by_band(v: Views) -> DataFrame:
    size = v.cells.groupBy("clone").agg(F.count("*").alias("size"))
    band = reads.band(F.col("size"), [0, 5, 50, 1 << 30]).alias("band")
    return _stats(v).join(size, "clone").groupBy(band).agg(F.count("*").alias("tests"), F.count_if(F.col("z") > 2).alias("hits"))


@query(PAIRS + """, f AS (SELECT i, e.tape, CAST(floor(least(sum(missing) / count(*), 0.99) * 4) AS BIGINT) AS fband FROM near JOIN entries e ON e.cell = j GROUP BY ALL), q AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.5) AS b, quantile_cont(p, 0.75) AS c FROM rt)
  SELECT CASE WHEN p < a THEN 0 WHEN p < b THEN 1 WHEN p < c THEN 2 ELSE 3 END AS pband, fband, count(*) AS n, round(avg(missing), 6) AS rate FROM entries e JOIN rt USING (tape) JOIN f ON f.i = e.cell AND f.tape = e.tape CROSS JOIN q GROUP BY ALL""")
def q_strata_table(v: Views) -> DataFrame:
    rt = margins.tape_margin(v.entries).select("tape", "p")
    edges = rt.agg(F.percentile("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    near = relate.neighbour_missing(relate.nearest_mates(v.prefixes, v.tapes, 5), v.entries).select(F.col("i").alias("cell"), "tape", F.floor(F.least(F.col("k") / F.col("n"), F.lit(0.99)) * 4).alias("fband"))
    rows = v.entries.join(rt, "tape").join(near, ["cell", "tape"]).join(F.broadcast(edges))
    pband = F.when(F.col("p") < F.col("q")[0], 0).when(F.col("p") < F.col("q")[1], 1).when(F.col("p") < F.col("q")[2], 2).otherwise(3)
    return rows.groupBy(pband.alias("pband"), "fband").agg(F.count("*").alias("n"), F.avg("missing").alias("rate"))


@query(""", t AS (SELECT sample, tape, first(sym ORDER BY n DESC, sym DESC) AS sym FROM (SELECT sample, tape, sym, count(*) AS n FROM reads GROUP BY ALL) GROUP BY ALL)
  SELECT count(*) AS shared, count(*) FILTER (a.sym = b.sym) AS agree FROM t a JOIN t b ON a.tape = b.tape WHERE a.sample = 'BUILDING' AND b.sample = 'MACHINERY'""")
def q_map_concordance(v: Views) -> DataFrame:
    n = v.reads.groupBy("sample", "tape", "sym").agg(F.count("*").alias("n"))
    top = n.groupBy("sample", "tape").agg(F.max_by("sym", F.struct("n", "sym")).alias("sym"))
    return writes.agreement(top.where("sample = 'BUILDING'"), top.where("sample = 'MACHINERY'"), "tape", "sym")


@query(KEYS + " SELECT CAST(0 AS BIGINT) AS tree, CAST(anc AS BIGINT) AS child, count(*) AS n_tips FROM up JOIN kt USING (node) WHERE tip AND anc IN (SELECT node FROM kt WHERE parent = 0) GROUP BY anc")
def q_root_split(v: Views) -> DataFrame:
    return tree.root_split(key_tree(v))


@query(KEYS + """ SELECT CAST(0 AS BIGINT) AS tree, epoch, round(sum(least(t, high) - greatest(t0, low)), 6) AS span FROM (SELECT c.node, c.t, p.t AS t0 FROM kt c JOIN kt p ON p.node = c.parent)
  JOIN (VALUES (0, 0.0, 0.7), (1, 0.7, 1.9), (2, 1.9, 9.0)) e(epoch, low, high) ON t0 < high AND t > low GROUP BY epoch""".replace("epoch, round", "CAST(epoch AS BIGINT) AS epoch, round"))
def q_epoch_overlap(v: Views) -> DataFrame:
    epochs = v.spark.createDataFrame([(0, 0.0, 0.7), (1, 0.7, 1.9), (2, 1.9, 9.0)], "epoch int, low double, high double")
    return tree.epoch_overlap(key_tree(v), epochs).groupBy("tree", "epoch").agg(F.sum("span").alias("span"))


@query(KEYS + " SELECT DISTINCT round(4 - t, 6) AS t, round(0.35 / (0.5 + (0.7 - 0.5) * exp(-0.7 * (4 - t))), 6) AS survival, round(exp(0.7 * (4 - t)), 6) AS size FROM kt")
def q_survival_curve(v: Views) -> DataFrame:
    """At the heights of the key tree's nodes below a top at 4."""
    t = key_tree(v).select((4 - F.col("t")).alias("t")).distinct()
    return t.select("t", simulate.survival(1.0, 0.3, 0.5, F.col("t")).alias("survival"), simulate.expected_size(1.0, 0.3, F.col("t")).alias("size"))


@query(""", h AS (SELECT user_id % 4 AS chain, value, ntile(2) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS h FROM events), p AS (SELECT chain, h, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM h GROUP BY ALL)
  SELECT round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS rhat FROM p""")
def q_split_rhat(v: Views) -> DataFrame:
    draws = fixture.table(v.spark, v.dir, "events").select((F.col("user_id") % 4).alias("chain"), "event_id", "value")
    return likelihood.split_rhat(draws, "chain", "event_id", "value")


@query(""", g AS (SELECT CAST(r AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM rc GROUP BY r), p AS (SELECT x, y, y / sum(y) OVER () AS p FROM g), c AS (SELECT x, y, p, sum(p) OVER (ORDER BY x) AS c, sum(p) OVER (ORDER BY p DESC, x) AS h FROM p)
  SELECT round(max(x) FILTER (y = (SELECT max(y) FROM g)), 6) AS mode, round(min(x) FILTER (c >= 0.5 - 1e-12), 6) AS median, round(min(x) FILTER (c >= 0.025 - 1e-12), 6) AS low, round(min(x) FILTER (c >= 0.975 - 1e-12), 6) AS high, round(min(x) FILTER (h - p < 0.95 - 1e-12), 6) AS hpd_low, round(max(x) FILTER (h - p < 0.95 - 1e-12), 6) AS hpd_high FROM c""")
def q_posterior_grid(v: Views) -> DataFrame:
    """Over the numbers of tapes that cells have."""
    grid = margins.cell_margin(v.entries).groupBy(F.col("r").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))
    return likelihood.grid_posterior(grid, "x", "y")


@query("""SELECT a.cell, CAST(a.tape AS BIGINT) AS tape, CAST(coalesce(max(x.d), 0) AS BIGINT) AS shared FROM tapes a JOIN tapes b ON b.cell = a.cell + 1 AND b.tape = a.tape
  LEFT JOIN prefixes x ON x.cell = a.cell AND x.tape = a.tape AND EXISTS (SELECT 1 FROM prefixes y WHERE y.cell = b.cell AND y.tape = b.tape AND y.d = x.d AND y.prefix = x.prefix) GROUP BY a.cell, a.tape""")
def q_lcp_match(v: Views) -> DataFrame:
    from strandline.functions.special import common_prefix

    other = v.tapes.select((F.col("cell") - 1).alias("cell"), "tape", F.col("read").alias("other"))
    return v.tapes.join(other, ["cell", "tape"]).select("cell", "tape", common_prefix(F.col("read"), F.col("other")).alias("shared"))


@query("SELECT CAST(clone AS BIGINT) AS clone, n, (row_number() OVER (ORDER BY n DESC, clone) - 1) % 4 AS task FROM (SELECT clone, count(*) AS n FROM cells GROUP BY clone)")
def q_job_assignment(v: Views) -> DataFrame:
    return tables.assign_jobs(v.cells.groupBy("clone").agg(F.count("*").alias("n")), "n", 4, "clone")


@query("SELECT sample, count(*) AS n_rows, round(avg(r), 6) AS r_mean, round(stddev_samp(r), 6) AS r_sd FROM rc GROUP BY sample")
def q_part_manifest(v: Views) -> DataFrame:
    return tables.manifest(margins.cell_margin(v.entries), ["sample"], ["r"])
