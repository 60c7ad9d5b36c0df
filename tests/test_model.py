"""Goldens that can be worked out by hand, and properties of models."""

import copy
import math

import pytest
from pyspark.sql import functions as F

from lexmill.functions.tokens import to_ids
from lexmill.operators import counts as C
from lexmill.operators import gradient as G
from lexmill.operators import model as M
from lexmill.operators import reestimate as R
from lexmill.operators import tables as T_
from lexmill.operators import vocab as V
from lexmill.plans import optimise as O
from lexmill.plans import train as T
from lexmill.session import cut
from lexmill.sources import arpa

KIND = "source string, doc long, line_no int, line string"


@pytest.fixture(scope="module")
def simple(spark):
    lines = spark.createDataFrame([("t", 0, 0, "a b c"), ("t", 0, 1, "a c")], KIND)
    vocab = V.vocabulary_of_list(spark, ["a", "b", "c"])
    counts = cut(C.int_counts(to_ids(lines, vocab), 3))
    return lines, vocab, counts, M.estimate(counts, 3, 6, 0.5).cut()


def table(model, digits):
    counts = {}
    for r in model.counts.collect():
        counts.setdefault(tuple(r.hist), {})[r.word] = round(r["count"], digits)
    return {tuple(r.hist): (round(r.total, digits), round(r.discount, digits), counts.get(tuple(r.hist), {})) for r in model.states.collect()}


def test_float_counts(simple):
    assert table(simple[3], 5) == {
        (): (2.04, 0, {2: 0.34875, 3: 0.595, 4: 0.39875, 5: 0.22875, 6: 0.46875}), (1,): (1, 0.6, {4: 0.4}), (4,): (0.8, 0.64, {5: 0.08, 6: 0.08}), (4, 1): (1, 0.8, {5: 0.1, 6: 0.1}),
        (5,): (0.4, 0.32, {6: 0.08}), (5, 4): (0.5, 0.4, {6: 0.1}), (6,): (0.8, 0.48, {2: 0.32}), (6, 4): (0.5, 0.4, {2: 0.1}), (6, 5): (0.5, 0.4, {2: 0.1}),
    }
    assert M.problems(simple[3]).isEmpty()


def test_statistics_em_and_pruning(simple):
    model = simple[3]
    stats = R.statistics(model, cut).cut()
    found = table(stats, 5)
    assert table(stats, 9)[()][2] == pytest.approx({2: 0.266691, 3: 0.595, 4: 0.281471, 5: 0.156985, 6: 0.248162}, abs=1e-6)
    assert found[()][:2] == (1.54831, 0)
    assert found[(4, 1)] == (1, 0.42118, {5: 0.25176, 6: 0.32706})
    assert found[(6, 4)] == (0.5, 0.19897, {2: 0.30103})
    value, words = R.stats_log_prob(model, stats)
    assert round(value, 5) == -1.35433 and round(words, 9) == 3.5
    moved = R.maximised(model, stats).counts.withColumnRenamed("count", "new").join(model.counts, ["hist", "word"])
    assert moved.agg(F.max(F.abs(F.col("new") - F.col("count")))).first()[0] < 1e-12  # a fixed point
    pruned, cost = R.pruned(model, 0.5, cut)
    assert pruned.counts.where("count = 0").count() == 6 and cost < 0
    assert round(R.stats_log_prob(pruned, stats)[0], 3) == -1.425
    small, small_stats = R.without_zeros(pruned, stats)
    assert abs(R.stats_log_prob(small, small_stats)[0] - R.stats_log_prob(pruned, stats)[0]) < 1e-9
    assert M.problems(small).isEmpty()


def test_probabilities_sum_to_one(spark, simple):
    model = simple[3]
    grams = model.states.select("hist", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("word")).withColumn("cnt", F.lit(1))
    for r in M.scored(model, grams).groupBy("hist").agg(F.sum("prob").alias("p")).collect():
        assert math.isclose(r.p, 1, abs_tol=1e-9)


def test_held_out_text_of_another_model(spark):
    lines = [[11, 12, 13], [11, 12, 13, 14]]
    sents = spark.createDataFrame([("t", 0, k, x) for k, x in enumerate(lines)], "source string, doc long, line_no int, ids array<int>")
    dev = spark.createDataFrame([("d", 0, 0, [10, 11, 12])], "source string, doc long, line_no int, ids array<int>")
    found = M.log_prob(M.estimate(C.int_counts(sents, 2), 2, 20, 1.0, {2: [0.8, 0.7, 0.6, 0.4]}), C.int_counts(dev, 2)).first()
    assert found.words == 4 and round(found.logprob, 6) == -10.006721


def test_int_counts_and_minimum_counts(spark):
    def sents(*lines):
        return spark.createDataFrame([("t", 0, k, x) for k, x in enumerate(lines)], "source string, doc long, line_no int, ids array<int>")

    found = {(tuple(r.hist), r.word): r.cnt for r in C.int_counts(sents([11, 12, 13], [11, 12, 13, 14]), 3).collect()}
    assert found == {((1,), 11): 2, ((11, 1), 12): 2, ((12, 11), 13): 2, ((13, 12), 2): 1, ((13, 12), 14): 1, ((14, 13), 2): 1}
    kept, lost = C.enforce_min_counts(C.int_counts(sents(*[[11, 12, 13]] * 4, [11, 12, 13, 14]), 3), 3, {3: {"t": 2.0}})
    found = {(tuple(r.hist), r.word): r.cnt for r in kept.collect()}
    assert found == {((1,), 11): 5, ((11, 1), 12): 5, ((12, 11), 13): 5, ((13,), 14): 1, ((13, 12), 2): 4, ((14,), 2): 1}
    assert {tuple(r.hist): r.discount for r in lost.collect()} == {(13, 12): 1}
    with pytest.raises(ValueError):
        C.parse_min_counts("x=2", 3, ["t"])
    assert C.parse_min_counts("t=2,3 default=1", 5, ["t", "u"]) == {3: {"t": 2, "u": 1}, 4: {"t": 3, "u": 1}, 5: {"t": 3, "u": 1}}


def test_gradient_by_differences(spark):
    lines = spark.createDataFrame([("t", 0, k, x) for k, x in enumerate(["a b c", "a c", "b c a b c"])] + [("u", 0, k, x) for k, x in enumerate(["c c b", "a b", "c b b a c c"])], KIND)
    vocab = V.vocabulary_of_list(spark, ["a", "b", "c"])
    counts = cut(C.int_counts(to_ids(lines, vocab), 2))
    dev = cut(C.int_counts(to_ids(spark.createDataFrame([("d", 0, 0, "a b c"), ("d", 0, 1, "c b x a")], KIND), vocab), 2))
    scales, d = {"t": 0.53, "u": 0.41}, {2: [0.81, 0.42, 0.23, 0.11]}
    _, found = G.derivatives(counts, dev, 2, 6, scales, d, cut)
    for name in ("scale_t", "order2_D1", "order2_D3"):
        ends = []
        for sign in (1, -1):
            s, e = dict(scales), copy.deepcopy(d)
            if name == "scale_t":
                s["t"] += sign * 1e-5
            else:
                e[2][int(name[-1]) - 1] += sign * 1e-5
            ends.append(G.objective(counts, dev, 2, 6, s, e, cut))
        assert abs((ends[0] - ends[1]) / 2e-5 - found[name]) < 1e-5
    assert abs(scales["t"] * found["scale_t"] + scales["u"] * found["scale_u"]) < 1e-2  # scaling all sources alike changes little


def test_bfgs_and_parameters():
    found = O.Bfgs(lambda x: (float((1 - x[0]) ** 2 + 5 * (x[1] - x[0] ** 2) ** 2), O.np.array([-2 * (1 - x[0]) - 20 * x[0] * (x[1] - x[0] ** 2), 10 * (x[1] - x[0] ** 2)])), O.np.array([-1.0, 1.0]), progress_tolerance=1e-14)
    assert O.np.allclose(found.x, [1, 1], atol=1e-3)
    params = O.initial(["a", "b"], 3)
    assert not O.problems(params, 3) and O.problems(params | {"order2_D2": 0.9}, 3)
    names, x = O.to_free(params, 3)
    assert all(math.isclose(v, params[k]) for k, v in O.from_free(names, x).items())


def test_size_model():
    size, threshold, at, steps = 1_200_000.0, 0.25, O.SizeModel(20_000, 150_000), 0
    total, pruned = size, 0.0
    at.record(int(size), None)
    for steps in range(20):
        threshold = at.next()
        pruned = max(pruned, threshold)
        total = 20_000 + 1_180_000 * (pruned + 1) ** -2.0
        at.record(int(total), threshold)
        if at.reached():
            break
        if at.overshot():
            at.back()
    assert 142_500 <= total <= 157_500


ARPA = r"""\data\
ngram 1=6
ngram 2=5
ngram 3=4

\1-grams:
-99	<s>	-0.221849
{u[2]}	</s>
{u[3]}	<unk>
{u[4]}	a	-0.09691
{u[5]}	b	-0.09691
{u[6]}	c	-0.221849

\2-grams:
{0}	<s> a	-0.09691
{1}	a b	-0.09691
{2}	a c	-0.09691
{3}	b c	-0.09691
{4}	c </s>

\3-grams:
"""


def test_arpa_file(spark, simple, tmp_path):
    _, vocab, _, model = simple
    to = str(tmp_path / "lm.arpa")
    arpa.write(model, vocab, to)
    text = (tmp_path / "lm.arpa").read_text()
    # probabilities by hand from the counts
    one = {2: 0.34875 / 2.04, 3: 0.595 / 2.04, 4: 0.39875 / 2.04, 5: 0.22875 / 2.04, 6: 0.46875 / 2.04}
    two = [0.4 + 0.6 * one[4], (0.08 + 0.64 * one[5]) / 0.8, (0.08 + 0.64 * one[6]) / 0.8, (0.08 + 0.32 * one[6]) / 0.4, (0.32 + 0.48 * one[2]) / 0.8]
    three = {"<s> a b": 0.1 + 0.8 * two[1], "<s> a c": 0.1 + 0.8 * two[2], "a b c": (0.1 + 0.4 * two[3]) / 0.5, "a c </s>": (0.1 + 0.4 * two[4]) / 0.5, "b c </s>": (0.1 + 0.4 * two[4]) / 0.5}
    wanted = ARPA.replace("ngram 3=4", "ngram 3=5").format(*(f"{math.log10(p):.6g}" for p in two), u={k: f"{math.log10(p):.6g}" for k, p in one.items()}) + "".join(f"{math.log10(p):.6g}\t{n}\n" for n, p in three.items()) + "\n\\end\\\n"
    assert text == wanted
    back = arpa.read(spark, to, vocab)
    both = back.join(M.probabilities(model).select("hist", "word", F.col("log10").alias("exact")), ["hist", "word"])
    assert both.count() == 15 and both.where("abs(prob - exact) > 1e-5").isEmpty()


def test_arpa_errors(spark, simple):
    _, vocab, _, model = simple
    with pytest.raises(Exception, match="no word has the id 5"):
        arpa.lines(model, vocab.where("id <> 5")).collect()
    lone = M.Model(model.counts.where("ord <> 2 or word <> 6 or hist[0] <> 5"), model.states.union(model.states.where("ord = 3").limit(1).selectExpr("ord", "array(3, 3)", "total", "discount")), 3, 6)
    with pytest.raises(Exception, match="without a probability"):
        arpa.lines(lone, vocab).collect()
    numbers = spark.createDataFrame([(-1.5e-5,), (-99.0,), (0.0,), (None,), (-12.3456789,), (-0.1,), (-9.9999999e-5,)], "x double").select(arpa.number(F.col("x")).alias("t")).collect()
    assert [r.t for r in numbers] == ["-1.5e-05", "-99", "0", None, "-12.3457", "-0.1", "-0.0001"] or numbers[-1].t == "-1e-04"


def test_printing_splitting_and_perturbing(spark, simple):
    _, _, counts, model = simple
    printed = {tuple(r.hist): r.line for r in T_.int_counts_text(counts).collect()}
    assert printed[(1,)] == " [ 1 ]: total=2 4->2 " and printed[(4, 1)] == " [ 4 1 ]: total=2 5->1 6->1 "
    lost = spark.createDataFrame([("t", [4, 1], 3)], "source string, hist array<int>, discount long")
    assert {r.line for r in T_.int_counts_text(counts, lost).collect()} >= {" [ 4 1 ]: total=5 discount=3 5->1 6->1 "}
    assert {tuple(r.hist): r.line for r in T_.model_text(model).collect()}[(5, 4)] == " [ 5 4 ]: total=0.5 discount=0.4 6->0.1 "
    assert " [ ]: 1 4 5 6 " in {r.line for r in T_.history_text(R.protected(model)).collect()}
    parts = T_.split_model(model, 2)
    assert parts.where("ord = 1").count() == 2 * model.counts.where("ord = 1").count() and T_.merge_problems(parts).isEmpty()
    assert table(T_.merge_model(parts, 3, 6), 9) == table(model, 9)
    assert not T_.merge_problems(parts.withColumn("count", F.expr("count + if(ord = 1 and split = 1 and word = 3, 1, 0)"))).isEmpty()
    assert M.problems(T_.perturbed(model)).isEmpty()
    assert T_.count_problems(counts, 3, 6).isEmpty() and T_.count_problems(counts, 4, 5).count() == 2
    assert not T_.derivative_problems({f"order2_D{k}": 0.0 for k in (1, 2, 3, 4)} | {"scale_a": 1.0}, ["a"], 2) and T_.derivative_problems({"scale_a": float("nan")}, ["b"], 2)
    said = spark.createDataFrame([("Well [laughter] I-, uh, don't <b_aside> know.",)], "x string").select(T_.normalised(F.col("x")).alias("t")).first().t
    assert said == "well i uh don't know"


def test_merged_in_two_steps(spark):
    from lexmill.functions import multiset

    rows = spark.range(500).select((F.col("id") % 3).cast("int").alias("word"), (F.col("id") % 7).alias("salt"), F.struct((F.col("id") / 10).alias("total"), (F.col("id") / 20).alias("top1"), (F.col("id") / 40).alias("top2"), F.lit(0.0).alias("top3")).cast(multiset.KIND).alias("cnt"))
    key = lambda df: sorted(str(r) for r in df.select("word", F.round("cnt.total", 6), "cnt.top1", "cnt.top2", "cnt.top3").collect())
    assert key(multiset.merge(rows, "word")) == key(multiset.merge(rows, "word", salt="salt"))


def test_ids_by_join_and_in_place(spark, monkeypatch):
    from lexmill.functions import tokens

    lines = spark.createDataFrame([("s", 0, 0, " a  b\tzz </s> "), ("s", 0, 1, ""), ("s", 1, 0, None)], KIND)
    vocab = V.vocabulary_of_list(spark, ["a", "b", "c"])
    key = lambda: sorted((r.doc, r.line_no, tuple(r.ids)) for r in to_ids(lines, vocab).collect())
    found = key()
    monkeypatch.setattr(tokens, "IN_PLACE", 2)
    assert found == key() == [(0, 0, (4, 5, 3, 3)), (0, 1, ()), (1, 0, ())]


def test_probability_zero_and_cleaning_up(spark, simple):
    from lexmill import session

    _, _, _, model = simple
    none = M.Model(model.counts.withColumn("count", F.expr("if(size(hist) = 0 and word = 3, 0, count)")), model.states, 3, 6)
    grams = spark.createDataFrame([([], 3, 2)], "hist array<int>, word int, cnt long")
    assert M.log_prob(none, grams).first().perplexity == math.inf
    with session.scratch(spark):
        kept = cut(grams)
        assert kept.count() == 1
    with pytest.raises(Exception):
        kept.count()


def test_pruning_to_a_size_there_already_or_never_met(simple):
    model = simple[3]
    assert T.prune_to(model, model.counts.count()) is model
    with pytest.raises(ValueError, match="n-grams"):
        T.prune_to(model, 7, most=0)


def test_save_and_load(spark, simple, tmp_path):
    M.save(simple[3], str(tmp_path / "m"))
    again = M.load(spark, str(tmp_path / "m"))
    assert (again.order, again.num_words) == (3, 6) and table(again, 9) == table(simple[3], 9)


def test_validation_and_vocabulary(spark):
    good = spark.createDataFrame([("train1", 0, 0, "there there"), ("dev", 0, 0, "hi now then"), ("train2", 0, 0, "hi lo")], KIND)
    assert V.text_problems(good).isEmpty()
    bad = spark.createDataFrame([("train1", 0, 0, "</S> x"), ("empty", 0, 0, " ")], KIND)
    assert {r.problem for r in V.text_problems(bad).collect()} == {"no held-out source", "no words in empty", "control symbol in train1"}
    with pytest.raises(ValueError):
        V.vocabulary_of_list(spark, ["a", "<s>"])
    vocab = V.vocabulary(V.word_counts(good), 6)
    assert [r.word for r in vocab.orderBy("id").collect()][4:] == ["hi", "there", "lo"]
    assert V.vocabulary_problems(vocab).isEmpty()
    ids = spark.createDataFrame([("u", 0, k, f"utt{k} word here") for k in range(3)], KIND)
    assert [tuple(r) for r in V.utterance_ids(ids).collect()] == [("u", "utt0")]


def test_train_and_prune(spark):
    lines = spark.createDataFrame([("x", 0, k, "a b c a b") for k in range(4)] + [("y", 0, k, "c a b c") for k in range(3)] + [("dev", 0, 0, "a b c")], KIND)
    found = T.train(lines, 2, word_list=["a", "b", "c"], params=O.initial(["x", "y"], 2), fold_dev_into="x")
    assert M.problems(found.model).isEmpty()
    pruned, cost = T.prune(found.model, 0.5, "prune*1.0 EM")
    assert pruned.counts.count() <= found.model.counts.count() and cost > -1e-9
    assert T.data_log_prob(found.model, found.vocab, lines.where("source = 'dev'")).first().words == 4
    with pytest.raises(ValueError):
        T.parse_steps("EM")


def test_sizes_sum_alike_in_any_order(spark):
    from lexmill.plans import queries as Q

    rows = [(0.1,)] * 7000 + [(1e6,), (1e-9,)] * 500
    sums = {spark.createDataFrame(x, "count double").repartition(n).agg(Q._exact("count").cast("string").alias("s")).first().s.rstrip("0") for n in (1, 3) for x in (rows, rows[::-1])}
    assert sums == {"500000700.0000005"}


def test_mixture_table_keeps_sources_apart(spark):
    from lexmill.operators import vocab

    counts = spark.createDataFrame([("a", f"w{k}", k + 1) for k in range(50)] + [("b", "w1", 3)], "source string, word string, cnt long")
    per, names, sizes = vocab.mixture_table(counts, spark.createDataFrame([("d", "w1", 2), ("d", "w3", 1), ("d", "none", 1)], "source string, word string, cnt long"))
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [source" not in plan and "BroadcastHashJoin [source" in plan
    assert names == ["a", "b"] and sizes == [1275, 3]
    assert {r.word: (r.n, *r.q) for r in per.collect()} == {"w1": (2, 2 / 1275, 1.0), "w3": (1, 4 / 1275, 0.0)}


def test_counted_ngrams_are_the_ngrams(spark):
    from lexmill.functions import tokens

    rows = [("a", [4, 5, 3, 4, 5]), ("b", []), ("a", [3, 3, 4]), (None, [4, 5]), ("a", [4, 5, 3, 4, 5]), ("b", None), ("b", [9, None, 4]), ("b", [2**31 - 1] * 4)]
    sents = spark.createDataFrame(rows, "source string, ids array<int>").repartition(2)
    for order in (2, 3, 5):
        for limit in (False, True):
            plain = tokens.ngrams(sents, order, limit).groupBy("source", "hist", "word").count()
            assert sorted(map(str, C.int_counts(sents, order, limit).select("source", "hist", "word", F.col("cnt").alias("count")).collect())) == sorted(map(str, plain.collect()))


def test_word_counts_of_odd_lines(spark):
    lines = spark.createDataFrame([("s", " a\x0bb  a\t"), ("s", None), ("t", ""), (None, "a\u00a0b   a"), ("t", "ä a\r\nä")], "source string, line string")
    assert {(r.source, r.word): r.cnt for r in V.word_counts(lines).collect()} == {("s", "a"): 2, ("s", "b"): 1, (None, "a\u00a0b"): 1, (None, " "): 1, (None, "a"): 1, ("t", "ä"): 2, ("t", "a"): 1}


def test_count_problems_look_once(spark, simple):
    counts = simple[2]
    found = T_.count_problems(counts.union(spark.createDataFrame([("u", 3, [4], 4, 0), ("u", 2, [4], 1, 2)], counts.schema)), 4, 6)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert {r.problem for r in found.collect()} == {"counts under 1 in u", "orders that aren't the histories' in u", "words out of range in u", "no n-grams of order 4"}
    assert {r.problem for r in T_.count_problems(counts.where("false"), 3, 6).collect()} == {"no n-grams of order 2", "no n-grams of order 3"}


def test_back_off_walk_makes_no_lists(spark, simple):
    model = simple[3]
    gap = M.Model(model.counts, model.states.where("hist <> array(4)"), 3, 6)  # a longer history, (5, 4) and (6, 4) too, without its shorter one
    counts = {(tuple(r.hist), r.word): r["count"] for r in gap.counts.collect()}
    states = {tuple(r.hist): r for r in gap.states.collect()}
    hists = [(), (1,), (4,), (5,), (4, 1), (5, 4), (6, 4), (4, 6), (5, 4, 1), (3, 3, 3, 3)]

    def plain(hist, word):
        p = counts[(), word] / states[()].total
        for k in (1, 2):
            if len(hist) >= k and hist[:k] in states:
                p = (counts.get((hist[:k], word), 0.0) + states[hist[:k]].discount * p) / states[hist[:k]].total
        return p

    grams = spark.createDataFrame([(list(h), w, 1) for h in hists for w in range(2, 7)], "hist array<int>, word int, cnt int")
    found = M.scored(gap, grams)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(tuple(r.hist), r.word): r.prob for r in found.collect()} == {(h, w): plain(h, w) for h in hists for w in range(2, 7)}
    stats = R.statistics(model, cut)
    for df in (stats.counts, M.probabilities(model), R.maximised(model, stats).counts, R.steps(model, model.counts)):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_arpa_rows_make_no_lists_and_numbers_once(spark, simple):
    _, vocab, _, model = simple
    said = arpa.rows(model, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in said and "Generate" not in said
    assert "array(format" not in spark.range(1).select(arpa.number(F.rand(1)))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("order", [2, 3])
def test_gradient_looks_up_without_lists(spark, simple, order):
    lines, vocab, _, _ = simple
    counts = cut(C.int_counts(to_ids(lines, vocab), order))
    seen = []

    def keep(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    G.derivatives(counts, cut(C.merge_int_counts(counts)), order, 6, {"t": 0.5}, {o: M.DISCOUNTS for o in range(2, order + 1)}, keep)
    assert not [x for x in seen if "collect_list(struct" in x]
