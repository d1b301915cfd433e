"""Sources and sinks: wide edit tables, clone maps, documents, parts with manifests, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_wide_csv(spark: SparkSession, path: str, cell_column: str = "CellID") -> DataFrame:
    """A wide edit table as text columns; ``None`` is a missing value."""
    return spark.read.option("header", True).option("nullValue", "None").csv(path).withColumnRenamed(cell_column, "cell")


def unpivot_sites(wide: DataFrame, id_column: str = "cell") -> DataFrame:
    """cell, tape, site, sym from columns ``{tape}.Site{j}``; rows with a missing symbol are kept as null."""
    sites = [c for c in wide.columns if c != id_column and ".Site" in c]
    if not sites:
        raise ValueError("no column is named {tape}.Site{j}")
    renamed = wide.select(F.col(f"`{id_column}`").alias("cell"), *(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(sites)))
    names = F.create_map(*(x for i, c in enumerate(sites) for x in (F.lit(f"c{i}"), F.lit(c))))
    long = renamed.unpivot("cell", [f"c{i}" for i in range(len(sites))], "_c", "sym").withColumn("_c", names[F.col("_c")])
    return long.select("cell", F.substring_index("_c", ".Site", 1).alias("tape"), F.substring_index("_c", ".Site", -1).cast("int").alias("site"), "sym")


def read_clones(spark: SparkSession, path: str) -> DataFrame:
    """cell, clone (null for blank or None), sample from a clone table in CSV."""
    raw = spark.read.option("header", True).csv(path)
    blank = F.trim(F.col("ClonalBC")).isin("", "None")
    return raw.select(F.col("CellID").alias("cell"), F.when(~blank, F.col("ClonalBC")).alias("clone"), F.col("Sample").alias("sample"))


def sample_of(cell: Column) -> Column:
    """What follows ``-1_`` in a cell id; ``?`` without it."""
    return F.when(F.instr(cell, "-1_") > 0, F.substring_index(cell, "-1_", -1)).otherwise(F.lit("?"))


def arm_of(sample: Column) -> Column:
    """The first token of a sample's name."""
    return F.split(sample, "_")[0]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON result documents, one a file, with the file's name."""
    return spark.read.option("multiLine", True).json(path).withColumn("file", F.substring_index(F.input_file_name(), "/", -1))


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A gzipped table with tabs."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """A Parquet table, built by ``build(spark)`` if it is not there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_parts(df: DataFrame, path: str, part_column: str) -> None:
    """A table in parts that can be read, checked and merged one by one."""
    df.write.mode("append").partitionBy(part_column).parquet(path)


def check_parts(parts: DataFrame, index_column: str, expected: DataFrame) -> DataFrame:
    """problem and the index: expected ones that are missing, and ones that are there twice."""
    seen = parts.groupBy(index_column).count()
    missing = expected.select(index_column).subtract(seen.select(index_column)).select(F.lit("missing").alias("problem"), index_column)
    twice = seen.where("count > 1").select(F.lit("duplicate").alias("problem"), index_column)
    return missing.unionByName(twice)


def manifest(parts: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Rows, mean and standard deviation of each value for each group of parts."""
    stats = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))]
    return parts.groupBy(*group).agg(F.count("*").alias("n_rows"), *stats)


def assign_jobs(jobs: DataFrame, cost_column: str, n: int, tie: str) -> DataFrame:
    """Add ``task``: heaviest first, dealt in turn."""
    return jobs.withColumn("task", ((F.row_number().over(W.orderBy(F.col(cost_column).desc(), tie)) - 1) % n).cast("int"))


def balanced_chunks(jobs: DataFrame, cost_column: str, n: int, *order: str) -> DataFrame:
    """Add ``chunk``: jobs in the given order cut into ``n`` runs of about equal cost; a job belongs where the middle of its cost lies. Jobs are a table of configurations."""
    upto = F.sum(cost_column).over(W.orderBy(*order))
    own = jobs.withColumns({"_upto": upto, "_all": F.sum(cost_column).over(W.partitionBy())})
    middle = (F.col("_upto") - F.col(cost_column) / 2) / F.col("_all")
    return own.withColumn("chunk", F.least(F.floor(middle * n), F.lit(n - 1)).cast("int")).drop("_upto", "_all")


def library_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the axes' values, numbered."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out.withColumn("job", F.row_number().over(W.orderBy(*axes)) - 1)


def arm_folders(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """(arm, path) of the tables that a glob finds; a table named ``arm=x`` or ``x.parquet`` is arm x."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = [f.getPath() for f in found or []]
    return sorted((p.getName().removeprefix("arm=").removesuffix(".parquet"), p.toString()) for p in names)


def merge_arms(spark: SparkSession, pattern: str, arms: list[str]) -> DataFrame:
    """The tables of all arms as one, by column names, with the arm as a column.

    Columns that an arm lacks are null, and numbers of different width take the wider one. An
    expected arm that no table has, a table of another arm, or two tables of one arm are an
    error that names them: a merged table is never short of an arm, and none counts twice.
    """
    found = arm_folders(spark, pattern)
    names = [a for a, _ in found]
    problems = {"missing": sorted(set(arms) - set(names)), "unexpected": sorted(set(names) - set(arms)), "doubled": sorted({a for a in names if names.count(a) > 1})}
    if any(problems.values()):
        raise ValueError("; ".join(f"{k}: {', '.join(v)}" for k, v in problems.items() if v))
    out = None
    for arm, path in found:
        one = spark.read.parquet(path).withColumn("arm", F.lit(arm))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no arms")
    return out
