"""The SQL surface: functions for spark.sql() over temporary views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.phonetic import jaro_winkler_udf, nysiis_sql
from twinspan.functions.text import folding
from twinspan.operators import blocking
from twinspan.operators.blocking import LEFT, READERS, RIGHT, meet
from twinspan.operators.components import connected_components
from twinspan.operators.storage import materialise


def register_functions(spark: SparkSession) -> None:
    """Make compare_lev(a, b, k), jaro_winkler(a, b, t), soundex_encode(a), nysiis_encode(a) and match_slice(a, b, s, e).

    Null in, null out; match_slice also accepts two nulls and else wants both texts to reach e. Codes are those of the
    encoders. All are SQL functions that Catalyst inlines; one needs Python, which takes whole batches:
    jaro_winkler_similarity(a, b), which jaro_winkler compares with t.
    """
    marked, plain = folding()
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION compare_lev(a STRING, b STRING, k INT) RETURNS BOOLEAN RETURN levenshtein(a, b) <= k")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION soundex_encode(a STRING) RETURNS STRING RETURN soundex(upper(translate(a, '{marked}', '{plain}')))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION match_slice(a STRING, b STRING, s INT, e INT) RETURNS BOOLEAN RETURN "
        "CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN false "
        "WHEN length(a) < e OR length(b) < e THEN false ELSE substring(a, s + 1, e - s) = substring(b, s + 1, e - s) END"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION nysiis_encode(a STRING) RETURNS STRING RETURN {nysiis_sql('a')}")
    spark.udf.register("jaro_winkler_similarity", jaro_winkler_udf())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jaro_winkler(a STRING, b STRING, t DOUBLE) RETURNS BOOLEAN RETURN jaro_winkler_similarity(a, b) >= t")


def _sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    a, b = (records.select(*[F.col(f"`{c}`").alias(side + c) for c in records.columns]) for side in (LEFT, RIGHT))
    return a, b


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of l and r that agree on all keys, dealt to tasks by their number."""
    met = meet(a, b, keys)
    return met.select(*[F.struct(*[F.col(f"`{c}`").alias(c.removeprefix(side)) for c in x.columns]).alias(name) for x, side, name in ((a, LEFT, "l"), (b, RIGHT, "r"))])


def self_match(spark: SparkSession, view: str, id: str, keys: list[str], comparison: str, compared: list[str] | None = None) -> DataFrame:
    """A blocking and linking step in SQL: left_id and right_id of a view's records that share encoded keys and pass a
    comparison, an expression of l and r.

    keys are expressions in which {t} stands for the side, as "soundex_encode({t}.name)". compared names the columns that the
    comparison reads, if it is all of them: where records repeat their values much, it is then made for each two values of
    a block once. A null id or key pairs with nothing; rows that share an id not with each other; an empty view gives no
    pairs."""
    named = [f"_k{i}" for i in range(len(keys))]
    records = spark.sql(f"SELECT t.*, {', '.join(f'{k.format(t="t")} AS {n}' for k, n in zip(keys, named, strict=True))} FROM {view} t").dropna(subset=[id, *named])
    smaller = F.col(f"l.{id}") < F.col(f"r.{id}")
    ends = [F.col(f"l.{id}").alias("left_id"), F.col(f"r.{id}").alias("right_id")]
    if compared:
        value = F.struct(*[F.col(f"`{c}`") for c in compared])
        values = records.groupBy(*named, value.alias("_val")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        seen = values.groupBy(*named).agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("of")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum(F.col("of") * F.col("of")).alias("values")).first()
        if (seen["pairs"] or 0) > blocking.FEW_PAIRS and seen["pairs"] >= blocking.REPEATED * seen["values"]:
            once = values.select(*named, "_val", *[F.col(f"_val.`{c}`").alias(c) for c in compared])
            met = _joined(*_sides(once), named).where(F.expr(comparison))
            accepted = materialise(met.select(*[F.col(f"l.{k}").alias(LEFT + k) for k in named], F.col("l._val").alias("_own"), F.col("r._val").alias(f"{LEFT}_val")), "values")
            a, b = _sides(records.select(id, *named, value.alias("_val")))
            a = a.withColumnRenamed(f"{LEFT}_val", "_own").repartition(READERS).join(accepted, [*[LEFT + k for k in named], "_own"]).drop("_own")
            return _joined(a, b, [*named, "_val"]).where(smaller).select(*ends)
    return _joined(*_sides(records), named).where(smaller).where(F.expr(comparison)).select(*ends)


def matched_table(spark: SparkSession, name: str, view: str, id: str, keys: list[str], comparison: str, persist: bool = False, compared: list[str] | None = None):
    """Keep the pairs of self_match() under a name: as a temporary view, or as a table of the warehouse."""
    pairs = self_match(spark, view, id, keys, comparison, compared)
    (pairs.write.mode("overwrite").saveAsTable(name) if persist else pairs.createOrReplaceTempView(name))
    return spark.table(name)


def entities(spark: SparkSession, pairs: str):
    """record_id and entity (its smallest record) of the records in a table of left_id and right_id; pairs with a null end
    join nothing, and an empty table has no entities.

    A recursive query would walk every path; contraction needs a few rounds of joins.
    """
    found = connected_components(spark.table(pairs), "left_id", "right_id")
    return found.withColumnsRenamed({"node": "record_id", "component": "entity"})
