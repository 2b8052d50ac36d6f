"""Table descriptors (column roles) and descriptor-bound table loading."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.numeric import name, quoted

SPEC_SCHEMA = T.StructType(
    [
        T.StructField("categorical", T.ArrayType(T.StringType())),
        T.StructField("classification", T.BooleanType()),
        T.StructField("ignore", T.ArrayType(T.StringType())),
        T.StructField("numerical", T.ArrayType(T.StringType())),
        T.StructField("ordinal", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("path", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

# Descriptor fields that must be present.
REQUIRED = ("categorical", "ignore", "numerical", "ordinal", "path")

# Text read as a missing value in CSV files.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of one table."""

    numerical: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    ordinal: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()
    target: str | None = None
    classification: bool | None = None
    path: str = ""
    url: str | None = None

    @staticmethod
    def from_row(row) -> "TableSpec":
        d = row.asDict() if hasattr(row, "asDict") else dict(row)
        missing = [f for f in REQUIRED if d.get(f) is None]
        if missing:
            raise ValueError(f"descriptor lacks required fields {missing}")
        for f in ("categorical", "ignore", "numerical"):
            if not all(isinstance(c, str) for c in d[f]):
                raise TypeError(f"descriptor field {f!r} must be a list of strings")
        return TableSpec(
            numerical=tuple(d["numerical"]),
            categorical=tuple(d["categorical"]),
            ordinal={k: tuple(v) for k, v in d["ordinal"].items()},
            ignore=tuple(d["ignore"]),
            target=d.get("target"),
            classification=d.get("classification"),
            path=d["path"],
            url=d.get("url"),
        )

    @staticmethod
    def from_json(spark: SparkSession, path: str) -> "TableSpec":
        row = spark.read.schema(SPEC_SCHEMA).option("multiLine", True).json(path).first()
        if row is None:
            raise ValueError(f"no descriptor in {path}")
        return TableSpec.from_row(row)

    @staticmethod
    def all_numeric(df: DataFrame) -> "TableSpec":
        """Every column numerical, no target."""
        return TableSpec(numerical=tuple(df.columns))

    def to_json(self) -> str:
        d = asdict(self)
        d["ordinal"] = {k: list(v) for k, v in self.ordinal.items()}
        return json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in d.items()})

    def write_json(self, spark: SparkSession, folder: str) -> None:
        row = json.loads(self.to_json())
        (
            spark.createDataFrame([tuple(row[f.name] for f in SPEC_SCHEMA)], SPEC_SCHEMA)
            .coalesce(1)
            .write.mode("overwrite")
            .option("ignoreNullFields", False)
            .json(folder)
        )

    @property
    def declared(self) -> list[str]:
        cols = [*self.numerical, *self.categorical, *self.ordinal, *self.ignore]
        return cols + ([self.target] if self.target else [])

    def check(self, df: DataFrame) -> "TableSpec":
        """Every declared column must exist in the table."""
        lost = [c for c in self.declared if c not in df.columns]
        if lost:
            raise ValueError(f"declared columns absent from the table: {lost}")
        return self

    def without_target(self) -> "TableSpec":
        return replace(self, target=None)


CATALOG_SCHEMA = T.StructType([T.StructField("dataset", T.StringType()), *SPEC_SCHEMA.fields])


def spec_catalog(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """One row per ``*.json`` descriptor directly inside ``folder``.

    ``lines`` reads JSON-lines files that name their dataset; otherwise every file is one descriptor
    and its file name is the dataset's.
    """
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return (
        spark.read.schema(CATALOG_SCHEMA)
        .option("multiLine", not lines)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", "false")
        .json(folder)
        .withColumn("dataset", F.coalesce("dataset", file))
    )


def write_catalog(spark: SparkSession, specs: list[dict], folder: str) -> None:
    rows = [tuple(s.get(f.name) for f in CATALOG_SCHEMA) for s in specs]
    spark.createDataFrame(rows, CATALOG_SCHEMA).write.mode("overwrite").json(folder)


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Role counts per descriptor."""
    return catalog.select(
        "dataset",
        F.size("numerical").cast("long").alias("n_numerical"),
        F.size("categorical").cast("long").alias("n_categorical"),
        F.size(F.map_keys("ordinal")).cast("long").alias("n_ordinal"),
        F.size("ignore").cast("long").alias("n_ignored"),
        F.col("target").isNotNull().alias("has_target"),
        "path",
    )


def null_tokens(df: DataFrame) -> DataFrame:
    """Replace the missing-value spellings of text columns by null."""
    return df.select(
        *[
            F.when(~name(f.name).isin(*NA_TOKENS), name(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else name(f.name)
            for f in df.schema.fields
        ]
    )


def load_table(spark: SparkSession, spec: TableSpec, cache_path: str, schema=None) -> DataFrame:
    """Read the CSV or parquet file a descriptor points to.

    Parquet comes as it is stored. Of a CSV file without ``schema``, columns whose values all parse as numbers are
    numbers (one more pass), so their levels sort as numbers; the declared numerical columns are doubles in any case.
    The missing-value spellings become null before types are decided.
    """
    path = f"{cache_path.rstrip('/')}/{spec.path}"
    if spec.path.endswith(".parquet"):
        df = spark.read.parquet(path)
        spec.check(df)
        return df
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    spec.check(df)
    df = null_tokens(df)
    if schema is not None:
        return df
    numeric = set(spec.numerical)
    free = [c for c in df.columns if c not in numeric]
    return df.select(*[name(c).cast(t).alias(c) for c, t in {**{c: "double" for c in df.columns}, **_parsed_types(df, free)}.items()])


def _parsed_types(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """bigint, double or string per text column: the narrowest that parses every value; all-null columns stay text."""
    if not cols:
        return {}
    whole = [F.count(F.when(name(c).rlike(r"^\s*[+-]?\d{1,18}\s*$"), 1)).alias(f"w{i}") for i, c in enumerate(cols)]
    real = [F.count(F.expr(f"try_cast({quoted(c)} as double)")).alias(f"r{i}") for i, c in enumerate(cols)]
    have = [F.count(name(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    row = df.agg(*whole, *real, *have).first()
    return {
        c: "string" if not row[f"n{i}"] else "bigint" if row[f"w{i}"] == row[f"n{i}"] else "double" if row[f"r{i}"] == row[f"n{i}"] else "string"
        for i, c in enumerate(cols)
    }


def role_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Non-null count and distinct count per declared column, with its role."""
    role = {c: "numerical" for c in spec.numerical}
    role |= {c: "categorical" for c in spec.categorical}
    role |= {c: "ordinal" for c in spec.ordinal}
    role |= {c: "ignore" for c in spec.ignore}
    if spec.target:
        role[spec.target] = "target"
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), name(c).cast("string").alias("v"))
            for c, r in role.items()
        ]
    )
    long = df.select(F.explode(pairs).alias("kv")).select("kv.*")
    # Two-step distinct: hot values collapse map-side before the shuffle.
    counts = long.groupBy("column", "role", "v").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("column", "role").agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("n_present"),
        F.count("v").alias("n_distinct"),
    )
