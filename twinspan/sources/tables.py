"""Reading datasets and writing results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from twinspan.plans.spec import Dataset

from .csv_records import csv_records

#: Declared column types.
COLUMN_TYPES = {"VARCHAR": StringType(), "CHAR": StringType(), "TEXT": StringType(), "BOOLEAN": BooleanType(), "REAL": DoubleType(), "INTEGER": LongType()}
#: What a row has beyond its header's columns.
_EXTRA = "_beyond_header"


#: CSV as RFC 4180 has it: quotes are doubled inside quotes. White space after a delimiter is dropped, trailing white space
#: stays; short rows are filled with nulls.
_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}


def _csv(spark: SparkSession, multi_line: bool = True):
    """Spark's own reader of CSV with headers; with multi_line it takes each file in one task."""
    return spark.read.options(**_CSV, header=True, multiLine=multi_line)


def _inferred(spark: SparkSession, records: DataFrame, names: list[str]) -> StructType:
    """The types that Spark infers of records."""
    texts = getattr(records.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.options(**_CSV, inferSchema=True)._jreader
    found = DataFrame(reader.csv(texts), spark).schema.fields
    missing = len(names) - len(found)  # no record has so many fields
    return StructType([StructField(n, f.dataType) for n, f in zip(names, [*found, *[StructField("", StringType())] * missing], strict=False)])


def columns_of(spark: SparkSession, url: str, kind: str = "CSV") -> list[str]:
    """Column names of a file; raises FileNotFoundError if it cannot be read."""
    try:
        return (_csv(spark).csv(url) if kind == "CSV" else spark.read.format(kind.lower()).load(url)).columns
    except AnalysisException as error:
        raise FileNotFoundError(url) from error


def _typed(name: str, kind: str, na_values: tuple[str, ...]) -> Column:
    """A text column as the declared type; blank is null, and a value that is none of the type ends the job."""
    text = F.col(f"`{name}`")
    if na_values:
        text = F.when(~text.isin(*na_values), text)
    if isinstance(COLUMN_TYPES[kind], StringType):
        return text.alias(name)
    value = text.try_cast(COLUMN_TYPES[kind])
    blank = text.isNull() | (F.trim(text) == "")
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: not of type {kind}: "), text)).cast(COLUMN_TYPES[kind])
    return F.when(blank, F.lit(None)).when(value.isNotNull(), value).otherwise(wrong).alias(name)


def read_dataset(spark: SparkSession, dataset: Dataset, used: list[str], na_values: tuple[str, ...] = (), position: str | None = None, multi_line: bool = True) -> DataFrame:
    """The used columns of a dataset, in the file's order.

    Declared types are kept; without a declaration a CSV file's types are inferred. Fields that hold one of na_values
    become null; by default only empty ones are. A value that is not of its declared type, or a CSV row with more
    fields than the header, is an error. Formats but CSV are read by the Spark source of that name. position: a column
    of this name is added by which rows sort as they stand in their files, files by name. multi_line: CSV fields may hold
    line breaks (see csv_records); else each line is a record. Either way large files are read by many tasks.
    """
    if dataset.format != "CSV":
        df = spark.read.format(dataset.format.lower()).load(dataset.url)
        kept = [F.col(f"`{c}`") for c in df.columns if c in used]
    else:
        names = columns_of(spark, dataset.url)
        types = dataset.data_types
        records = csv_records(spark, dataset.url, position) if multi_line else None
        if types is None:
            schema = _inferred(spark, records, names) if multi_line else _csv(spark, False).option("inferSchema", True).csv(dataset.url).schema
        else:
            if unknown := {t for t in types.values() if t not in COLUMN_TYPES}:
                raise ValueError(f"unknown column type {', '.join(sorted(unknown))}")
            schema = StructType([StructField(n, StringType()) for n in names])
        wide = StructType([*schema, StructField(_EXTRA, StringType())])
        if records is not None:
            # by place, since names may repeat or differ in case only
            fields = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(wide)])
            parsed = F.from_csv("record", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields), _CSV)
            # a generator, so that each record is parsed once, whatever reads its fields
            df = records.select(*([position] if position else []), F.inline(F.array(parsed)))
            df = df.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(wide)], *([position] if position else []))
        else:
            df = _csv(spark, False).schema(wide).csv(dataset.url)
        df = df.where(F.col(_EXTRA).isNull() | F.raise_error(F.lit(f"{dataset.url}: a row has more fields than the header")).cast("boolean"))
        is_text = {f.name for f in schema if isinstance(f.dataType, StringType)}
        kept = [_typed(n, (types or {}).get(n, "TEXT"), na_values) if types is not None or n in is_text else F.col(f"`{n}`") for n in names if n in used]
    if position:
        kept.append(F.col(position) if position in df.columns else _place(df).alias(position))
    return df.select(*kept)


def _place(df: DataFrame) -> Column:
    """Sorts rows as their files hold them: by file, block and place in the block."""
    place = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:  # a source without files
        return F.struct(place.alias("row"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("row"))


def write_table(df: DataFrame, path: str, kind: str = "csv", order: list[str] | None = None, drop: str | None = None) -> str:
    """Write a result as a new folder of files of the given format, ordered if asked, without the column drop; returns its
    path. A folder that is there already is an error."""
    if order:
        df = df.orderBy(*[F.col(f"`{c}`") for c in order])
    if drop:
        df = df.drop(drop)
    writer = df.write
    if kind == "csv":
        writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(kind).save(path)
    return path
