"""Contexts, clusters, completion, edits, sinks and orders against hand-made results."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenlm.functions import scalars as S
from tokenlm.operators import candidates as K
from tokenlm.operators import completion, contexts, counts, edits, kneser_ney, latent, lexer, mixing, ordering, search, tokens
from tokenlm.sources import files


def corpus(spark, docs):
    rows = [("c", str(d), k, t) for d, text in enumerate(docs) for k, t in enumerate(text.split(), 1)]
    return spark.createDataFrame(rows, "corpus string, doc string, pos long, token string")


def test_neighbours_without_windows(spark):
    """Tokens that bring the ones before them give the n-grams that windows give."""
    docs = spark.createDataFrame([("c", 1, "a b a b c"), ("c", 2, ""), ("d", 3, "x"), ("d", 4, None)], "corpus string, doc long, text string")
    plain, brought = tokens.lex(docs), tokens.lex(docs, before=2)
    assert sorted(counts.grams(plain, 3).collect()) == sorted(counts.grams(brought, 3).collect())
    assert [(r.token, r.p1, r.p2) for r in brought.filter("doc = 1").orderBy("pos").collect()] == [("a", None, None), ("b", "a", None), ("a", "b", "a"), ("b", "a", "b"), ("c", "b", "a")]


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(20), i, r.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v long").repartition(5)
    got = {x.i: x.s for x in ordering.running_sums(df, ["g"], [-F.col("k"), "i"], "v", "s").collect()}
    want, total = {}, collections.Counter()
    for g, k, i, v in sorted(rows, key=lambda x: (x[0], -x[1], x[2])):
        total[g] += v
        want[i] = total[g]
    assert got == want


def test_manual_discounts_and_other_counts(spark):
    counted = counts.ngram_counts(counts.grams(corpus(spark, ["a b a c a b", "b a b"]), 3))
    by = lambda **kw: {r.ngram: r.p for r in kneser_ney.levels(counted, 3, **kw)[3].collect()}
    one = by(fixed=0.6)
    assert by(fixed=[0.6, 0.3, 0.6]) != pytest.approx(one) and by(fixed=[0.6]) == pytest.approx(one) and by(fixed=[0.6, 0.6, 0.6]) == pytest.approx(one)
    other = counts.ngram_counts(counts.grams(corpus(spark, ["a b a c a b", "b a b", "d e f g"]), 3))
    assert by(fixed=0.5, backoff=other) != by(fixed=0.5)  # another vocabulary size
    assert by(fixed=0.5, backoff=counted) == pytest.approx(by(fixed=0.5))


def test_log_factorials(spark):
    got = spark.range(0, 400).select("id", mixing.log_factorial(F.col("id").cast("double")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.id + 1), abs=1e-8) for r in got)


def test_contexts(spark):
    docs = spark.createDataFrame([(1, "if a:\n  b = 1\n\tc"), (2, None), (3, "")], "doc long, text string")
    rows = contexts.line_tokens(docs, "doc").orderBy("line_no", "loc").collect()
    assert [(r.line_no, r.token, r.loc, r.line_prefix) for r in rows] == [(0, "if", 0, ""), (0, "a", 3, "if "), (0, ":", 4, "if a"), (1, "b", 2, "  "), (1, "=", 4, "  b "), (1, "1", 6, "  b = "), (2, "c", 1, "\t")]
    some = spark.createDataFrame([("x/y.tar.gz", "b", "aB1", None, None, "  ")], "path string, token string, p1 string, p2 string, p3 string, line_prefix string")
    names = list(contexts.REGISTRY)
    got = contexts.with_contexts(some.withColumnRenamed("path", "path"), [n for n in names if n != "path"]).first()
    assert (got["simple"], got["filetype"], got["dirH"], got["prev"], got["prevTwo"], got["prevForm"], got["isLineStart"], got["indentLevel"], got["linePrefix"]) == ("", ".gz", "1", "aB1", " aB1", "aA0", "true", "  ", "  ")
    chain = spark.createDataFrame([("f.py", 3, [1, 4])], "path string, line int, s array<int>").select(contexts.scope_chain(F.col("path"), F.col("line"), F.col("s")).alias("c")).first().c
    assert chain == ["f.pyl3", "f.pyn4", "f.pyn1", "f.pyn0", ""]


def test_identifier_recency(spark):
    got = [(r.token, r.bucket) for r in contexts.identifier_recency(corpus(spark, ["a = b + a ; c a d e f b"])).orderBy("pos").collect()]
    assert got == [("a", -1), ("b", -1), ("a", 1), ("c", -1), ("a", 1), ("d", -1), ("e", -1), ("f", -1), ("b", 2)]


def test_chain_counts_are_those_of_one_pass(spark):
    docs = ["a b a b c", "b a b", "a"]
    t = corpus(spark, docs)
    w = counts.Window.partitionBy("doc").orderBy("pos")
    wide = t.withColumns({f"p{k}": F.lag("token", k).over(w) for k in (1, 2)})
    c, kn = collections.Counter(), collections.Counter()
    for text in docs:
        s = text.split()
        for i, x in enumerate(s):
            p = [s[i - k] if i >= k else "" for k in (2, 1)]
            fresh = False
            for level, ctx in ((2, " ".join(p)), (1, p[1]), (0, "")):
                if fresh:
                    kn[level, ctx, x] += 1
                c[level, ctx, x] += 1
                fresh = c[level, ctx, x] == 1
    got = {(r.level, r.ctx, r.token): (r.c, r.kn) for r in contexts.chain_counts(wide, contexts.ngram_chain(3)).collect()}
    assert got == {k: (v, kn[k]) for k, v in c.items()}


def test_clusters_by_hand_and_by_differences(spark):
    rows = [("c", "1", g, cand, truth, x, y) for g, truth in ((1, "a"), (2, "b"), (3, "z")) for cand, x, y in (("a", 1.0, 0.5), ("b", 0.2, 1.0), ("d", 0.0, 0.1))]
    df = spark.createDataFrame(rows, "corpus string, doc string, pos long, cand string, truth string, x double, y double")
    values = {"x": F.col("x"), "y": F.col("y")}
    w = {"x": 0.3, "y,cluster=0": -0.4, "y,cluster=1": 0.9}

    def by_hand(w, pos):
        e = {(c, z): math.exp(w["x"] * x + w[f"y,cluster={z}"] * y) for _, _, g, c, _, x, y in rows if g == pos for z in (0, 1)}
        return {k: v / sum(e.values()) for k, v in e.items()}

    ranked = latent.softmax(df, latent.scores(values, w, ["y"], 2))
    for r in ranked.collect():
        p = by_hand(w, r.pos)
        assert r.probs == pytest.approx([p[r.cand, 0], p[r.cand, 1]]) and r.prob == pytest.approx(p[r.cand, 0] + p[r.cand, 1])
    for r in latent.posterior(ranked).collect():
        p, truth = by_hand(w, r.pos), {1: "a", 2: "b"}[r.pos]
        assert r.posterior == pytest.approx(p[truth, r.cluster] / (p[truth, 0] + p[truth, 1]))
    loss = lambda w: sum(math.log(by_hand(w, g)[t, 0] + by_hand(w, g)[t, 1]) for g, t in ((1, "a"), (2, "b"))) / 2
    for r in latent.gradient(ranked, values, ["y"], 2).collect():
        up, down = w | {r.feature: w[r.feature] + 1e-5}, w | {r.feature: w[r.feature] - 1e-5}
        assert r.gradient == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-7)
    first = latent.initial_weights(spark.createDataFrame([("x",), ("y",)], "feature string"), 0.5, 0.1).collect()
    assert all(0.4 <= r.weight <= 0.6 for r in first) and first == latent.initial_weights(spark.createDataFrame([("x",), ("y",)], "feature string"), 0.5, 0.1).collect()
    parts = latent.contributions(df, values, {"x": 2.0, "y": -1.0}).filter("pos = 1 AND cand = 'a'").orderBy("place").collect()
    assert [(p.feature, p.part) for p in parts] == [("x", 2.0), ("y", -0.5)]


def test_completion_end_to_end(spark):
    docs = {"a.txt": "x = foo ( bar )", "b.txt": "y = foo ( baz )"}
    rows = [("c", p, k, t) for p, text in docs.items() for k, t in enumerate(text.split(), 1)]
    counted = counts.ngram_counts(counts.grams(spark.createDataFrame(rows, "corpus string, doc string, pos long, token string"), 2))
    got = completion.complete(counted, "c", "b.txt", "y = foo ( qux ) ;\nz = ", 22, old=docs["b.txt"]).orderBy("place").collect()
    # counted after the upsert: "=" is followed by foo twice, "foo" by "(" twice, "(" by bar and qux
    assert got[0].path.startswith("foo (") and {r.path for r in got} >= {"foo", "foo (", "foo ( bar", "foo ( qux"}
    by = {r.path: r for r in got}
    assert by["foo"].prob == pytest.approx(1.0) and by["foo ( bar"].prob == pytest.approx(0.5) and by["foo ( bar"].text == "foo(bar"
    assert by["foo"].exclusive_prob == pytest.approx(0.0) and "foo ( baz" not in by
    typed = completion.complete(counted, "c", "c.txt", "x = foo ( ", 10, base="B").orderBy("place").collect()
    assert {r.path.split()[0] for r in typed} == {"bar", "baz"} and sum(r.prob for r in typed if r.length == 1) == pytest.approx(1.0)
    answer = completion.sent(completion.complete(counted, "c", "c.txt", "x = foo ( ", 10)).first().answer
    assert answer.split(completion.SEPARATOR)[0] in {"bar)", "baz)"}
    said = [json.loads(r.json) for r in completion.report(completion.complete(counted, "c", "c.txt", "x = foo ( ", 10)).collect()]
    assert {tuple(x["pieces"]) for x in said} >= {("bar",), ("bar", ")")} and all(x["alternatives"] for x in said)
    assert completion.position([0, 2, 4], 4) == 2 and completion.parameters("path=a%2Fb&base=&loc=3") == {"path": "a/b", "base": "", "loc": "3"}


def test_tokens_right_of_the_cursor_stop_a_path(spark):
    following = spark.createDataFrame([("c", "", "a", 1.0), ("c", "a", "b", 0.9), ("c", "a", "d", 0.1), ("c", "b", "e", 1.0)], "corpus string, last string, token string, p double")
    starts = spark.createDataFrame([(1, "c", "")], "ctx_id int, corpus string, last string")
    stop = spark.createDataFrame([(1, "b")], "ctx_id int, token string")
    assert {r.path for r in search.paths(starts, following, stop, depth=3).collect()} == {"a", "a d"}


def test_edits(spark, tmp_path):
    r = random.Random(4)
    for _ in range(300):
        old, new = ("".join(r.choice("ab\n") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert edits.patched(old, edits.difference(old, new)) == new
    assert edits.difference("one two three", "one 2 three") == (4, "two", "2")
    with pytest.raises(ValueError):
        edits.patched("xyz", (0, "ab", "c"))
    pairs = spark.createDataFrame([(1, "abc", "abXc"), (2, None, "n"), (3, "same", "same")], "key long, old string, new string")
    assert sorted(map(tuple, edits.differences(pairs).collect())) == [(1, 2, "", "X"), (2, 0, "", "n"), (3, 4, "", "")]
    events = [("a", 1, "FILE_READ", "x"), ("a", 2, "BUF_LEAVE", "x"), ("a", 3, "BUF_WRITE", "x"), ("a", 4, "BUF_UNLOAD", "xy"), ("a", 5, "FILE_READ", "xy"), ("b", 1, "FILE_READ", "")]
    spark.createDataFrame(events, "path string, version long, event string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, version long, event string, text string").parquet(str(tmp_path / "in"))
    q = edits.tracked(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1, "FILE_READ", 0, "", "x"), ("a", 3, "BUF_WRITE", 1, "", ""), ("a", 4, "BUF_UNLOAD", 1, "", "y"), ("a", 5, "FILE_READ", 0, "", "xy")]


def test_small_functions(spark):
    one = spark.range(1)
    n = spark.createDataFrame([(3.0,), (0.0004,), (2.34567,), (-7.0,)], "x double").select(S.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in n] == ["3", "4.00e-04", "2.346", "-7"]
    q = F.lit("path=a%2Fb+c&base=&loc=3")
    assert tuple(one.select(S.query_parameter(q, "path"), S.query_parameter(q, "base"), S.query_parameter(q, "up")).first()) == ("a/b c", "", None)
    names = spark.createDataFrame([("count1=0",), ("count2.log,cluster=1",)], "f string")
    assert [r.f for r in names.filter(S.matches(F.col("f"), "count", "cluster")).collect()] == ["count2.log,cluster=1"]
    assert names.filter(S.matches(F.col("f"))).count() == 2 and names.filter(S.matches(F.col("f"), "count1=0", exact=True)).count() == 1
    assert names.select(S.decorated(F.col("f"), F.lit(2)).alias("d")).first().d == "count1=0,cluster=2"
    rows = spark.createDataFrame([("word", "x = ", True), ("word", "x // ", True), ("w", "", True), ("+", "", True), ("word", "", False)], "t string, p string, k boolean")
    assert [r.ok for r in rows.select(S.tests_position(F.col("t"), F.col("p"), F.col("k"), 2, True).alias("ok")).collect()] == [True, False, False, False, False]
    lexed = spark.createDataFrame(lexer.tokenize("a # b\n'c' 1", "x.js"), lexer.SCHEMA.replace("pos int, ", ""))
    assert [r.token for r in lexed.filter(S.is_identifier_position(F.col("token"), F.col("ttype"), F.col("tctx"))).collect()] == ["a", "1"]


def test_result_files(spark, tmp_path):
    states = spark.createDataFrame([("p", 1, 0, "x y", 2, "t", "u", 3, 0.5, "onBeam", 0.25), ("p", 0, 4, "y", 1, "v", "w", None, None, "oov", 0.0)], "path string, ident int, loc int, context string, context_max_n int, true string, pred string, rank int, entropy double, state string, reciprocal_rank double")
    files.write_predictions(states, str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect())[1] == "path=p\tident=1\tcontext=x y\tcontext_max_n=2\ttrue=t\tpred=u\trank=3\tentropy=0.5"
    files.write_entropies(states, str(tmp_path / "e"))
    back = {r.loc: r for r in files.results(spark, str(tmp_path / "e")).collect()}
    assert (back[0].entropy, back[0].state, back[0].reciprocal_rank) == (0.5, "onBeam", 0.25) and (back[4].entropy, back[4].state) == (None, "oov")
    files.write_gradient(spark.createDataFrame([("a", 0.1), ("b", 0.7)], "feature string, gradient double"), str(tmp_path / "g"))
    assert [r.value for r in spark.read.text(str(tmp_path / "g")).collect()] == ["b\t0.7", "a\t0.1"]
    stats = kneser_ney.statistics(counts.ngram_counts(counts.grams(corpus(spark, ["a b a b a b c", "a b"]), 2)))
    files.write_counts(stats, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c" / "counts1")).collect()] == ["c\ta\t4\t4", "c\tb\t4\t8"]
    content = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"1"))], "path string, content binary")
    one = files.fingerprint(content).first()[0]
    assert one == files.fingerprint(content.orderBy("path")).first()[0] != files.fingerprint(content.filter("path = 'a'")).first()[0]
    assert [r.path for r in files.first_documents(content, 1).collect()] == ["a"]
    assert [r.feature for r in files.pruned(spark.createDataFrame([("a", -2.0), ("b", 0.1)], "feature string, weight double"), 1.0).collect()] == ["a"]


def test_summary_of_predictions(spark):
    t = corpus(spark, ["a b c"])
    w = counts.Window.partitionBy("doc").orderBy("pos")
    wide = t.withColumns({f"p{k}": F.lag("token", k).over(w) for k in range(1, 11)})
    ranked = spark.createDataFrame([("c", "0", 3, "c", "b", 0), ("c", "0", 3, "c", "c", 1), ("c", "0", 2, "b", "x", 0)], "corpus string, doc string, pos long, truth string, cand string, rank int")
    assert sorted(map(tuple, files.prediction_summary(ranked, wide).select("pos", "before", "first", "best", "place").collect())) == [(2, "a", "b", "x", -1), (3, "a b", "c", "b c", 2)]


def test_beam_is_bounded_and_ordered(spark):
    docs = spark.createDataFrame([("c", 1, "a b a c a b a d")], "corpus string, doc long, text string")
    t = tokens.lex(docs, before=3)
    known = K.top_followers(counts.ngram_counts(counts.grams(t, 3)), 2)
    got = collections.defaultdict(list)
    for r in K.beam(t, known, 4, 3).orderBy("pos", "stage", "cand").collect():
        got[r.pos].append((r.cand, r.stage))
    assert got[1] == [] and got[2] == [("b", 1), ("c", 1), ("a", 2)] and got[8] == [("c", 0), ("d", 0), ("b", 1), ("a", 2)]
    assert max(map(len, got.values())) <= 4
