"""Files that enter and leave the jobs: reviews, catalogues, vectors, manifests, requests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise import schemas
from shelfwise.sources.records import quoted_records
from shelfwise.vocab import DEFAULT_TOP_K, NULL_TOKENS

# Names of a column that numbers the rows, lower-cased; Spark calls an unnamed one _c0.
ROW_NUMBER_NAMES = ("src_row", "unnamed: 0", "_c0")

_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_reviews_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw reviews; null tokens become nulls and unparsable numbers too.

    Cells may hold line breaks; a large file is read by many tasks all the same
    (``records``). Turn ``multi_line`` off where no cell holds one, which saves
    a pass over the lines.

    Columns are found by name, in any order; others are left out. The row number
    is the unnamed first column; without one, rows get a number in file order.
    """
    rows = _by_header(spark, path, {**_CSV, "multiLine": str(multi_line).lower()})
    names = {name.strip().lower(): name for name in rows.columns}
    number = next((names[n] for n in ROW_NUMBER_NAMES if n in names), None)
    own = F.col("`own row`").cast("string") if number is None else F.col(f"`{number}`")
    _require(names, [f.name for f in schemas.RAW if f.name != "src_row"], path)
    columns = [F.col(f"`{names[f.name]}`").alias(f.name) for f in schemas.RAW if f.name != "src_row"]
    return typed(rows.select(own.alias("src_row"), *columns), schemas.RAW)


def _by_header(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """All cells as text under the names of the header line, which all files must share, and ``own row``, a row's number.

    A file with another header stops the job; without line breaks in cells, one
    with an unnamed column cannot be compared and does not.
    """
    header = spark.read.options(**options).csv(path).columns
    unnamed = any(name.startswith("_c") for name in header)
    if options["multiLine"] == "false":
        texts = T.StructType([T.StructField(name, T.StringType()) for name in header])
        rows = spark.read.schema(texts).options(**options, enforceSchema=str(unnamed).lower()).csv(path)
        return rows.withColumn("own row", F.monotonically_increasing_id())
    records = quoted_records(spark, path)
    headers = records.where("is_first").select("record").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"{path} has files with different headers")
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    given = {k: v for k, v in options.items() if k != "header"}
    parsed = records.where("NOT is_first").select("row", F.from_csv("record", cells.simpleString()[7:-1].replace(":", " "), given).alias("r"))
    # the header line took the first number
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(header)], (F.col("row") - 1).alias("own row"))


def _require(names, wanted, path: str) -> None:
    missing = [name for name in wanted if name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the declared types, with missing-value tokens as nulls."""

    def column(field: T.StructField) -> Column:
        text = F.when(~F.col(field.name).isin(*NULL_TOKENS), F.col(field.name))
        if isinstance(field.dataType, T.StringType):
            return text.alias(field.name)
        number = F.trim(text).try_cast("double")
        number = F.when(~F.isnan(number), number)
        if isinstance(field.dataType, T.LongType):
            number = F.trim(text).try_cast("long")
        return number.try_cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in schema])


def write_csv(df: DataFrame, path: str) -> None:
    """Cells as they are, in files under ``path``; missing and empty cells are written empty."""
    df.write.mode("overwrite").options(
        header="true", escape='"', quote='"', emptyValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _by_header(spark, path, _CSV)
    _require(rows.columns, schemas.CLEAN.names, path)
    return typed(rows.select(*schemas.CLEAN.names), schemas.CLEAN)


def write_catalogue(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """``item_id`` and a single-precision ``embedding``."""
    df.select("item_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode(
        "overwrite"
    ).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VECTORS).parquet(path)


def manifest(vectors: DataFrame, model_name: str) -> DataFrame:
    """One row: the model's name, the number of items and the vector length."""
    return vectors.agg(
        F.lit(model_name).alias("model_name"),
        F.count(F.lit(1)).alias("num_items"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("long").alias("embedding_dim"),
    )


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(path)


def request_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Each line as a request, with the ``line`` itself and its ``problem``, which is null for a good one.

    A line that is no JSON object of the right types is malformed; a request must have a query. Blank lines are none.
    """
    held = T.StructType([*schemas.REQUEST.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(column, held.simpleString(), {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim(column) != "").select(F.col(column).alias("line"), parsed.alias("r"))
    problem = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.trim("line").startswith("{"), "malformed")
        .when(F.col("r.query").isNull(), "no query")
    )
    return with_request_defaults(rows.select(*[F.col(f"r.{f.name}") for f in schemas.REQUEST], "line", problem.alias("problem")))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("problem IS NULL").drop("line", "problem")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("problem IS NOT NULL").select("line", "problem")


def read_requests(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """The good requests of a file of JSON lines; the others are added to the table ``rejects``, if one is named."""
    rows = request_lines(spark.read.text(path))
    if rejects is not None:
        rejected(rows).write.mode("append").parquet(rejects)
    return accepted(rows)


def with_request_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULT_TOP_K)))


def parse_requests_json(df: DataFrame, column: str) -> DataFrame:
    """The good requests among JSON texts in a column; see ``request_lines`` for the others."""
    return accepted(request_lines(df, column))


def write_results(df: DataFrame, path: str) -> None:
    """One JSON record per ranked row."""
    df.write.mode("overwrite").json(path)
