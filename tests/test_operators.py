"""Hand-made tables, a sequential oracle, properties, sources, sinks and streaming."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenlm.functions import scalars as S
from tokenlm.operators import counts as C
from tokenlm.operators import deltas, kneser_ney, learning, lexer, prequential, rewriting, search, tokens
from tokenlm.sources import files, synthetic
from tokenlm.streaming import online


def corpus(spark, docs):
    rows = [("c", d, k, t) for d, text in enumerate(docs) for k, t in enumerate(text.split(), 1)]
    return spark.createDataFrame(rows, "corpus string, doc long, pos long, token string")


def sequential(docs, order):
    """Statistics counted one position at a time, in the way they are defined."""
    c, total, followers, kn, knt = (collections.Counter() for _ in range(5))
    steps = []
    for text in docs:
        t = text.split()
        for i in range(len(t)):
            top = min(order, i + 1)
            grams = [tuple(t[i - n + 1 : i + 1]) for n in range(1, top + 1)]
            steps += [(n, " ".join(g), c[g], total[n, g[:-1]], followers[n, g[:-1]], kn[g], knt[n, g[:-1]]) for n, g in enumerate(grams, 1)]
            fresh = [c[g] == 0 for g in grams]
            for n, g in enumerate(grams, 1):
                kd = 1 if n == top else int(fresh[n])
                c[g] += 1
                total[n, g[:-1]] += 1
                followers[n, g[:-1]] += fresh[n - 1]
                kn[g] += kd
                knt[n, g[:-1]] += kd
    return c, total, followers, kn, knt, steps


def made(seed):
    r = random.Random(seed)
    return [" ".join(r.choice("aaabbcde") for _ in range(r.randint(0, 15))) for _ in range(12)]


@pytest.mark.parametrize("docs", [["a b a b a c"], ["x y", "x z"], made(1), made(2)])
def test_statistics(spark, docs):
    rows = C.grams(corpus(spark, docs), 3)
    counted = C.ngram_counts(rows)
    c, total, followers, kn, knt, steps = sequential(docs, 3)
    key = lambda n, ctx: (n, tuple(ctx.split()))
    assert {tuple(r.ngram.split()): r.c for r in counted.collect()} == dict(c)
    assert {key(r.n, r.ctx): (r.total, r.followers) for r in C.contexts(counted).collect()} == {k: (v, followers[k]) for k, v in total.items()}
    assert {tuple(r.ngram.split()): r.kn for r in C.continuations(counted).collect()} == {g: kn[g] for g in c}
    assert {key(r.n, r.ctx): r.kn_total for r in C.continuation_totals(C.continuations(counted)).collect()} == dict(knt)
    t = prequential.numbered(corpus(spark, docs))
    got = prequential.counts_before(C.grams(t, 3), t).orderBy("g", "n").select("n", "ngram", "c", "total", "followers", "kn", "kn_total").collect()
    assert [tuple(r) for r in got] == steps


def test_kneser_ney_sums_to_one(spark):
    docs = made(5)
    counted = C.ngram_counts(C.grams(corpus(spark, docs), 2))
    one = kneser_ney.levels(counted, 2, fixed=0.6)
    p1 = {r.ngram: r.p for r in one[1].collect()}
    assert sum(p1.values()) == pytest.approx(1)
    seen = collections.defaultdict(float)
    for r in one[2].select("ngram", "total", "followers", "p").collect():
        seen[r.ngram.split()[0]] += r.p - 0.6 * r.followers / r.total * p1[r.ngram.split()[1]]
    for ctx, mass in seen.items():
        r = one[2].filter(F.col("ngram").startswith(ctx + " ")).first()
        assert mass + 0.6 * r.followers / r.total == pytest.approx(1)


def test_no_pairs_seen_twice(spark):
    counted = C.ngram_counts(C.grams(corpus(spark, ["a a a b"]), 1))
    d = C.discounts(C.counts_of_counts(C.continuations(counted)))
    assert {r.discount for r in d.collect()} == {0.0}
    assert {r.d1 for r in kneser_ney.modified_discounts(counted).collect()} == {1.0}


def test_retraction(spark):
    old, new = made(7), made(8)
    counted = C.ngram_counts(C.grams(corpus(spark, old), 3))
    after = deltas.update(counted, corpus(spark, old), corpus(spark, new), 3)
    want = C.ngram_counts(C.grams(corpus(spark, new), 3))
    assert sorted(after.collect()) == sorted(want.collect())


def test_patterns(spark):
    t = corpus(spark, ["r k r q s r"])
    rare = spark.createDataFrame([("c", "r"), ("c", "q"), ("c", "s")], "corpus string, token string")
    got = [r.ngram for r in rewriting.pattern_grams(t, rare, 3).orderBy("pos").collect()]
    assert got == ["<0> k <0>", "k <0> <rare>", "<1> <0> <rare>", "<1> <0> <rare>"]


def test_empty_and_blank(spark):
    docs = spark.createDataFrame([(1, ""), (2, "\n\n"), (3, None), (4, "a.b 1.5")], "doc long, text string")
    assert [(r.doc, r.pos, r.token) for r in tokens.lex(docs).orderBy("doc", "pos").collect()] == [(4, 1, "a"), (4, 2, "."), (4, 3, "b"), (4, 4, "1.5")]
    assert [(r.token, r.loc) for r in tokens.offsets(docs, "doc").orderBy("loc").collect()] == [("a", 0), (".", 1), ("b", 2), ("1.5", 4)]
    assert lexer.tokenize("", "x.py") == [] and lexer.tokenize(None, None) == []


def test_scalars(spark):
    df = spark.createDataFrame([("a/b.c/file.tar.gz", "helloWorld42!"), (".git", "X"), ("x/.hid.d", "")], "p string, w string")
    got = [tuple(r) for r in df.select(S.extension(F.col("p")), S.base_name(F.col("p")), S.directory_depth(F.col("p")), S.word_shape(F.col("w"))).collect()]
    assert got == [("gz", "file", 2, "aAa0!"), ("", ".git", 0, "A"), ("d", ".hid.d", 1, "")]
    n = spark.createDataFrame([(0,), (1,), (7,), (2000,)], "c long").select(S.bin_label(F.col("c")), S.log10_bucket(F.col("c"))).collect()
    assert [tuple(r) for r in n] == [("<=0", -1), ("<=1", 0), ("<=10", 0), (">1000", 3)]
    b = spark.createDataFrame([(bytearray(b"plain text here"),), (bytearray(b"a\x00b"),), (bytearray(),), (bytearray(b"\n\n\n\n"),)], "b binary")
    assert [tuple(r) for r in b.select(S.looks_binary(F.col("b")), S.looks_binary(F.col("b"), True)).collect()] == [(False, False), (True, True), (False, False), (True, False)]


def test_lexer_states():
    t = lexer.tokenize("x = 'it\\'s' # c\ny /* // */ z", "a.js")
    assert [(a.token, a.tctx) for a in t if a.tctx != "NONE"][:3] == [("it", "STRING"), ("\\", "STRING"), ("'", "STRING")]
    assert ("c", "COMMENT") in [(a.token, a.tctx) for a in t] and t[-1].token == "z" and t[-1].tctx == "NONE"
    p = lexer.tokenize("if a:\n\tb(1,\n  2)\n\tc\nd", "x.py")
    assert [a.token for a in p] == ["<s>", "if", "a", ":", "<nl>", "<ind>", "b", "(", "1", ",", "2", ")", "<nl>", "c", "<nl>", "<ded>", "d", "<nl>"]
    assert lexer.scopes(p)[6][1] == (1,) and lexer.scopes(p)[-1][1] == ()


def test_search(spark):
    following = spark.createDataFrame([("c", "a", "b", 0.6), ("c", "a", "c", 0.4), ("c", "b", "a", 1.0)], "corpus string, last string, token string, p double")
    starts = spark.createDataFrame([(1, "c", "a")], "ctx_id int, corpus string, last string")
    got = {r.path: (round(r.prob, 6), round(r.exclusive_prob, 6)) for r in search.paths(starts, following, depth=3).collect()}
    assert got == {"b": (0.6, 0.0), "c": (0.4, 0.4), "b a": (0.6, 0.0), "b a b": (0.36, 0.36), "b a c": (0.24, 0.24)}


def test_learning_matches_numeric_gradient(spark):
    rows = [("c", 0, g, cand, truth, x, y) for g, truth in ((1, "a"), (2, "b")) for cand, x, y in (("a", 1.0, 0.5), ("b", 0.2, 1.0), ("d", 0.0, 0.1))]
    df = spark.createDataFrame(rows, "corpus string, doc long, pos long, cand string, truth string, x double, y double")
    from tokenlm.operators import candidates as K

    def loss(w):
        ranked = K.softmax(K.log_linear(df, w, {k: F.col(k) for k in w}))
        return ranked.filter("cand = truth").agg(F.avg(F.log("prob"))).first()[0]

    w = {"x": 0.3, "y": -0.2}
    g = {r.feature: r.gradient for r in learning.gradient(K.softmax(K.log_linear(df, w, {k: F.col(k) for k in w})), {k: F.col(k) for k in w}).collect()}
    for k in w:
        up, down = dict(w), dict(w)
        up[k] += 1e-4
        down[k] -= 1e-4
        assert g[k] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=1e-4)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a.py").write_text("x = 1")
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "in" / ".git" / "c.py").write_text("y")
    got = files.source_files(spark, [str(tmp_path / "in")]).collect()
    assert [(r.lang, r.text) for r in got] == [("py", "x = 1")]
    files.write_params(spark.createDataFrame([("b", 2.0), ("a", -1.0)], "feature string, weight double"), str(tmp_path / "p"))
    assert sorted(map(tuple, files.weights(spark, str(tmp_path / "p")).collect())) == [("a", -1.0), ("b", 2.0)]
    (tmp_path / "lines.txt").write_text("The cat\n\nsat\n")
    assert [r.token for r in files.line_documents(spark, str(tmp_path / "lines.txt"), lower=True).orderBy("doc", "pos").collect()] == ["the", "cat", "</s>", "sat", "</s>"]
    docs = spark.createDataFrame([(1, "a<b\nc")], "doc long, text string")
    assert files.annotated_html(tokens.offsets(docs, "doc"), docs).first().html == "<span>a</span><span>&lt;</span><span>b</span><br/><span>c</span>"
    s = spark.createDataFrame([(1, 0, 1, 0.5, "onBeam", 1.0), (1, 3, 0, None, "oov", 0.0)], "doc long, loc int, ident int, entropy double, state string, reciprocal_rank double")
    assert json.loads(files.token_json(s).first().json) == [["0", "1", "0.5", "1.0"], ["3", "0", "oov", "0.0"]]


def test_synthetic(spark):
    p = synthetic.shares(100, 2.0)
    assert sum(p) == pytest.approx(1)
    n = synthetic.power_law(spark, 2000).groupBy("token").count().collect()
    assert max(n, key=lambda r: r["count"]).token == "w0" and math.isclose(max(r["count"] for r in n) / 20000, p[0], abs_tol=0.03)


def test_streaming_versions(spark, tmp_path):
    events = [("a.py", 1, "x y x"), ("b.py", 1, "y"), ("a.py", 2, "x z"), ("a.py", 3, "x z")]
    for k, e in enumerate(events):
        spark.createDataFrame([e], "path string, version long, text string").write.parquet(str(tmp_path / "in" / f"d{k}"))
    stream = spark.readStream.schema("path string, version long, text string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = online.versions(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.n, r.ngram): (r.c, r.w) for r in online.merged(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = collections.Counter()
    for path, text in (("a.py", "x z"), ("b.py", "y")):
        for n, g, d, _ in online.deltas([t.token for t in lexer.tokenize(text, path, begins=0)], 2, 1):
            want[n, g] += d
    assert {k: v[0] for k, v in got.items()} == dict(want)


@pytest.mark.parametrize("method, batch", [("adagrad", 1), ("dual", 3), ("sgd", 2)])
def test_sequential_pass_in_chunks(spark, method, batch):
    """Chunks that hand their state on give the weights of one loop over all contexts."""
    r = random.Random(9)
    data = [(c, g, f"c{k}", f"c{r.randrange(5)}", r.random(), r.random()) for c in ("a", "b") for g in range(1, 41 if c == "a" else 12) for k in range(4)]
    data = [(c, g, k, next(x[3] for x in data if x[:2] == (c, g)), x, y) for c, g, k, _, x, y in data]
    df = spark.createDataFrame(data, "corpus string, g long, cand string, truth string, x double, y double").repartition(3)
    got = {(q.corpus, q.feature): q.weight for q in learning.sequential(df, ["x", "y"], batch=batch, method=method, decay=0.5, chunk=7).collect()}
    want = {}
    for c in ("a", "b"):
        w, sq, total, t, waiting = [0.0, 0.0], [0.0, 0.0], [0.0, 0.0], 0, []
        for g in range(1, 41):
            one = [q for q in data if q[:2] == (c, g)]
            if not any(q[2] == q[3] for q in one):
                continue
            e = [math.exp(w[0] * q[4] + w[1] * q[5]) for q in one]
            waiting.append([sum(((q[2] == q[3]) - v / sum(e)) * q[i] for q, v in zip(one, e)) for i in (4, 5)])
            if len(waiting) < batch:
                continue
            t += 1
            for i in (0, 1):
                m = sum(v[i] for v in waiting) / batch
                sq[i], total[i] = sq[i] + m * m, total[i] + m
                w[i] = {"adagrad": w[i] + m / sq[i] ** 0.5, "dual": total[i] / t**0.5, "sgd": w[i] + m / t**0.5}[method]
            waiting = []
        want |= {(c, "x"): w[0], (c, "y"): w[1]}
    assert got == pytest.approx(want)


def test_sgd_weights_use_every_context(spark, tmp_path, monkeypatch):
    """The registered query hands all contexts to the pass."""
    from tokenlm.plans import modelling

    monkeypatch.setattr(modelling, "clicks", lambda *_: spark.createDataFrame([("e", d, i, "ab"[i * d % 2]) for d in (1, 2) for i in range(1, 31)], "corpus string, doc long, pos long, token string"))
    seen = []
    monkeypatch.setattr(learning, "sequential", lambda rows, names: seen.append(rows.select("g").distinct().count()) or rows)
    modelling.sgd_weights(spark, str(tmp_path))
    assert seen == [60]


def test_prequential_queries_predict_words():
    """Words of documents are counted and predicted too, and five candidates are listed."""
    from tokenlm.plans import registry

    assert {"word_prequential_counts", "word_prequential_entropy", "top5_candidates"} <= set(registry.SQL)
