"""Scans of files, and writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlm.functions import scalars as S


def source_files(spark: SparkSession, paths: list[str], exclude: tuple[str, ...] = (), languages: tuple[str, ...] = (), max_bytes: int = 2**31 - 1) -> DataFrame:
    """doc path, lang (extension) and text of text files below paths, without .git, excluded folders and large files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    path = F.regexp_replace("path", "^file:", "")
    keep = (F.col("length") <= max_bytes) & ~F.col("path").rlike(r"/\.git(/|$)") & ~F.col("path").endswith(".log")
    for e in exclude:
        keep &= ~S.path_within(path, e)
    if languages:
        keep &= S.extension(path).isin(*languages)
    return files.filter(keep).filter(~S.looks_binary(F.col("content"))).select(path.alias("path"), S.extension(path).alias("lang"), F.decode("content", "UTF-8").alias("text"))


def marked_paths(spark: SparkSession, train: list[str], test: list[str], test_count: list[str]) -> DataFrame:
    """Files of three path lists with the flags is_count and is_eval."""
    parts = [source_files(spark, paths).withColumns({"is_count": F.lit(c), "is_eval": F.lit(e)}) for paths, c, e in ((train, True, False), (test, False, True), (test_count, True, True)) if paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def line_documents(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """One document per line: tokens between blanks, then </s>. Lines without tokens are dropped."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("doc"), (F.lower(text) if lower else text).alias("line")).filter("line <> ''")
    return lines.select("doc", F.posexplode(F.concat(F.split("line", " "), F.array(F.lit("</s>")))).alias("at", "token")).select("doc", (F.col("at") + 1).cast("long").alias("pos"), "token")


def vocabulary(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """Distinct words of a file with one a line, without the sentinels, and </s>."""
    word = F.trim("value")
    words = spark.read.text(path).select((F.lower(word) if lower else word).alias("token")).filter(~F.col("token").isin("", "<oov>", "<s>", "</s>", "<nl>", "<ind>", "<ded>"))
    return words.union(spark.createDataFrame([("</s>",)], "token string")).distinct()


def weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="feature string, weight double")


def common_tokens(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The first fields of the first lines of a table that is sorted by count."""
    return spark.read.csv(path, sep="\t", schema="token string, c double, cumulative double", quote="").orderBy(F.desc("c"), "token").limit(size).select("token")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Entropies of an experiment; oov and offBeam become a state, and their entropy null."""
    raw = spark.read.csv(path, sep="\t", schema="path string, loc int, ident int, entropy string, reciprocal_rank double")
    number = F.col("entropy").try_cast("double")
    return raw.withColumn("state", F.when(number.isNull(), F.col("entropy")).otherwise("onBeam")).withColumn("entropy", number)


def trees(spark: SparkSession, path: str) -> DataFrame:
    """Words of bracketed parse trees, a sentence ending after a tag '.'."""
    from pyspark.sql.window import Window

    files = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("doc"), F.posexplode(F.regexp_extract_all("value", F.lit(r"\(([^\s()]+)\s+([^\s()]+)\)"), F.lit(0))).alias("pos", "leaf"))
    leaf = lambda k: F.regexp_extract("leaf", r"\(([^\s()]+)\s+([^\s()]+)\)", k)
    rows = files.select("doc", "pos", leaf(1).alias("tag"), leaf(2).alias("word")).filter("tag <> '-NONE-'")
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("sentence", F.coalesce(F.sum((F.col("tag") == ".").cast("int")).over(w), F.lit(0)))


def section_part(section) -> F.Column:
    """train for sections to 20, dev for 21 and 22, test after."""
    return F.when(section <= 20, "train").when(section <= 22, "dev").otherwise("test")


def write_tsv(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite").csv(path, sep="\t", emptyValue="", nullValue="NaN")


def write_params(params: DataFrame, path: str) -> None:
    """Weights by size, smallest first."""
    write_tsv(params.select("feature", "weight"), path, ["weight", "feature"])


def write_candidates(ranked: DataFrame, path: str, most: int = 5) -> None:
    """JSON lines: each position with its best candidates."""
    some = ranked.filter(F.col("rank") < most)
    some.groupBy("corpus", "doc", "pos", "truth").agg(F.sort_array(F.collect_list(F.struct("rank", "cand", "prob"))).alias("candidates")).write.mode("overwrite").json(path)


def token_json(states: DataFrame) -> DataFrame:
    """Per document a JSON array of [loc, ident, entropy or state, reciprocal rank]."""
    row = F.array(F.col("loc").cast("string"), F.col("ident").cast("string"), F.coalesce(F.col("entropy").cast("string"), F.col("state")), F.col("reciprocal_rank").cast("string"))
    return states.groupBy("doc").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("loc", row.alias("r")))), lambda x: x["r"])).alias("json"))


def annotated_html(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document the escaped text with a span around every token. tokens: doc, loc, token; docs: doc, text.

    Every token brings the gap before it, so the parts are joined once, whatever the text's length."""
    listed = tokens.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("loc", "token"))).alias("t"))
    start = lambda x: x["loc"] + F.length(x["token"])

    def part(x, i):
        at = F.when(i > 0, start(F.get("t", i - 1))).otherwise(0)
        return F.concat(S.html_escape(F.substr(F.col("text"), at + 1, x["loc"] - at)), F.lit("<span>"), S.html_escape(x["token"]), F.lit("</span>"))

    rest = S.html_escape(F.substr(F.col("text"), start(F.element_at("t", -1)) + 1, F.length("text")))
    return docs.join(listed, "doc").select("doc", F.concat(F.array_join(F.transform("t", part), ""), rest).alias("html"))


def write_predictions(states: DataFrame, path: str) -> None:
    """A line of name=value fields per position. states: path, ident, context, context_max_n, true, pred, rank, entropy."""
    fields = ["path", "ident", "context", "context_max_n", "true", "pred", "rank", "entropy"]
    line = F.concat_ws("\t", *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("NaN"))) for f in fields])
    states.select(line.alias("value")).write.mode("overwrite").text(path)


def write_entropies(states: DataFrame, path: str) -> None:
    """path, loc, ident, entropy or the state (oov, offBeam) of positions without one, and reciprocal rank; read back by results."""
    shown = F.coalesce(F.col("entropy").cast("string"), F.col("state"))
    write_tsv(states.select("path", "loc", F.col("ident").cast("int"), shown.alias("entropy"), "reciprocal_rank"), path)


def write_gradient(gradient: DataFrame, path: str) -> None:
    """Mean gradients, largest first."""
    gradient.select("feature", "gradient").orderBy(F.desc("gradient"), "feature").write.mode("overwrite").csv(path, sep="\t", emptyValue="")


def write_counts(stats: DataFrame, path: str) -> None:
    """Folders counts1, diversityCounts1 and diversityTotals1: tokens with their count, their distinct predecessors, and the sum of
    those of their followers, each in falling order with its running sum. stats: as kneser_ney.statistics gives them."""
    from tokenlm.operators.counts import cumulative_dump

    one = stats.filter("n = 1")
    totals = stats.filter("n = 2").groupBy("corpus", "ctx").agg(F.max("kn_total").alias("c"))
    for name, rows in (("counts1", one.select("corpus", "ngram", "c")), ("diversityCounts1", one.select("corpus", "ngram", F.col("kn").alias("c"))), ("diversityTotals1", totals.select("corpus", F.col("ctx").alias("ngram"), "c"))):
        cumulative_dump(rows).orderBy("corpus", "cumulative").write.mode("overwrite").csv(f"{path}/{name}", sep="\t", emptyValue="")


def prediction_summary(ranked: DataFrame, tokens: DataFrame, most: int = 5) -> DataFrame:
    """corpus, doc, pos, the ten tokens before, the token's first character, the best candidates, and the truth's place from 1 (-1: none).

    tokens bring p1 to p10."""
    best = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") < most, F.struct("rank", "cand")))), lambda x: x["cand"]), " ")
    by = ranked.groupBy("corpus", "doc", "pos").agg(best.alias("best"), F.coalesce(F.max(F.when(F.col("cand") == F.col("truth"), F.col("rank") + 1)), F.lit(-1)).cast("int").alias("place"))
    before = F.concat_ws(" ", *[f"p{k}" for k in range(10, 0, -1)])
    rows = tokens.select("corpus", "doc", "pos", before.alias("before"), F.substring("token", 1, 1).alias("first"))
    return rows.join(by, ["corpus", "doc", "pos"])


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash of a set of files (path, content): that of their own hashes and paths, in the order of paths.

    A row of some 100 bytes per file meets in one task."""
    lines = F.sort_array(F.collect_list(F.struct("path", F.sha1("content").alias("hash"))))
    return files.agg(F.sha1(F.array_join(F.transform(lines, lambda x: F.concat(x["hash"], F.lit("  "), x["path"])), "\n")).alias("fingerprint"))


def first_documents(docs: DataFrame, most: int, order: str = "path") -> DataFrame:
    """The first documents in order, up to a number."""
    return docs.orderBy(order).limit(most)


def pruned(params: DataFrame, least: float) -> DataFrame:
    """Weights whose size is at least so much."""
    return params.filter(F.abs("weight") >= least)
