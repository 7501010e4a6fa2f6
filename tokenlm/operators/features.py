"""Features of a position or candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.functions.scalars import bin_label, indicator
from tokenlm.operators.rewriting import RARE, flagged

#: Fixed values of the recency features.
LOOK_BACK, OWN_WEIGHT = 30, 10


def recency(tokens: DataFrame) -> DataFrame:
    """For each position its token's last occurrence in the document: distance, flag, and whether the token before it agrees."""
    doc = Window.partitionBy("corpus", "doc").orderBy("pos")
    with_before = tokens.withColumn("before", F.coalesce(F.lag("token", 1).over(doc), F.lit("")))
    same = Window.partitionBy("corpus", "doc", "token").orderBy("pos")
    out = with_before.withColumn("last_pos", F.lag("pos", 1).over(same)).withColumn("last_before", F.lag("before", 1).over(same))
    d = F.col("pos") - F.col("last_pos")
    return out.select(
        "corpus", "doc", "pos", "token", d.alias("distance"), F.when(d <= LOOK_BACK, "inLast30").when(d.isNotNull(), "inFile").alias("flag"),
        F.when(d.isNull(), "notInFile").when(d <= OWN_WEIGHT, F.concat(F.lit("last"), d.cast("string"))).otherwise("last.log").alias("feature"),
        F.when(d.isNull(), 1.0).when(d <= OWN_WEIGHT, 1.0).otherwise(F.log(d.cast("double"))).alias("value"), F.coalesce(F.col("before") == F.col("last_before"), F.lit(False)).alias("last_bigram"),
    )


def recency_with_token(tokens: DataFrame, common: DataFrame) -> DataFrame:
    """corpus, doc, pos and fname: the recency flag, and again with the token, where tokens outside of common are <rare>."""
    rows = flagged(recency(tokens).filter("flag IS NOT NULL"), common, 1)
    shown = F.when(F.col("r0"), RARE).otherwise(F.col("token"))
    names = F.explode(F.array(F.col("flag"), F.concat(F.lit("'"), shown, F.lit("',"), F.col("flag"))))
    return rows.select("corpus", "doc", "pos", names.alias("fname"))


def recency_histogram(tokens: DataFrame, longest: int = 499) -> DataFrame:
    return recency(tokens).filter(F.col("distance").between(1, longest)).groupBy("corpus", "distance").agg(F.count("*").alias("n"))


def count_features(rows: DataFrame, order: int) -> DataFrame:
    """count<n> features from columns c1 to c<order>: indicators of 0, 1 and 2, else the logarithm."""
    all_of = F.array(*[indicator(f"count{n}", F.col(f"c{n}")) for n in range(1, order + 1)])
    return rows.select("corpus", "doc", "pos", "cand", F.explode(all_of).alias("f")).select("corpus", "doc", "pos", "cand", "f.fname", "f.fval")


def num_features(rows: DataFrame, order: int) -> DataFrame:
    """num<n> features: indicators of 0, 1, 2 and 3 or more, and ln(c + 1)."""
    parts = []
    for n in range(1, order + 1):
        c = F.col(f"c{n}")
        name = F.when(c >= 3, F.lit(f"num{n}>=3")).otherwise(F.concat(F.lit(f"num{n}="), c.cast("string")))
        parts += [F.struct(name.alias("fname"), F.lit(1.0).alias("fval")), F.struct(F.lit(f"num{n}.log").alias("fname"), F.log(c + F.lit(1.0)).alias("fval"))]
    return rows.select("corpus", "doc", "pos", "cand", F.explode(F.array(*parts)).alias("f")).select("corpus", "doc", "pos", "cand", "f.fname", "f.fval")


def first_context_bin(rows: DataFrame, totals: DataFrame, order: int) -> DataFrame:
    """,total<k><=bin of the longest context that has been seen, ,empty without one. rows: grams; totals: contexts."""
    joined = rows.filter("n > 1").join(totals.select("corpus", "n", "ctx", "total"), ["corpus", "n", "ctx"])
    best = joined.groupBy("corpus", "doc", "pos").agg(F.max_by(F.struct("n", "total"), "n").alias("b"))
    label = F.concat(F.lit(",total"), (F.col("b.n") - 1).cast("string"), bin_label(F.col("b.total")))
    every = rows.filter("n = 1").select("corpus", "doc", "pos")
    return every.join(best, ["corpus", "doc", "pos"], "left").select("corpus", "doc", "pos", F.coalesce(label, F.lit(",empty")).alias("annotation"))


def context_columns(tokens: DataFrame) -> DataFrame:
    """prev, prev_two, prev_three and prev_prev of each position; empty near the start."""
    w = Window.partitionBy("corpus", "doc").orderBy("pos")
    p = [F.coalesce(F.lag("token", k).over(w), F.lit("")) for k in (1, 2, 3)]
    return tokens.select("corpus", "doc", "pos", "token", p[0].alias("prev"), F.concat_ws(" ", p[1], p[0]).alias("prev_two"), F.concat_ws(" ", p[2], p[1], p[0]).alias("prev_three"), p[1].alias("prev_prev"))
