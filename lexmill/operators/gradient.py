"""The held-out log-probability of a model and its exact derivatives by source scales and discounts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import UNK, back_off
from .model import UNIGRAM, Model, estimate, log_prob, scale_of
from .reestimate import steps

Cut = Callable[[DataFrame], DataFrame]


def _claims(counts: DataFrame, scales: dict[str, float], above: DataFrame | None) -> DataFrame:
    """Which piece fills which of the three top slots of each (hist, word): from source ``source`` or place ``i`` of the longer history ``child``.

    Equal pieces are ordered by where they come from, so each slot is claimed exactly once, the same way every time.
    """
    no_child = F.lit(None).cast("array<int>")
    own = counts.select("hist", "word", scale_of(scales).alias("size"), "source", no_child.alias("child"), F.explode(F.sequence(F.lit(1), F.least("cnt", F.lit(3)).cast("int"))).alias("i"))
    if above is not None:
        pieces = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.col(f"d{k}").alias("size")) for k in (1, 2, 3)])).alias("x")
        handed = above.select(back_off().alias("b"), "word", F.col("hist").alias("child"), pieces).where("x.size > 0")
        own = own.unionByName(handed.select(F.col("b").alias("hist"), "word", F.col("x.size").alias("size"), F.lit(None).cast("string").alias("source"), "child", F.col("x.i").alias("i")))
    order = Window.partitionBy("hist", "word").orderBy(F.desc("size"), "source", "child", "i")
    return own.withColumn("slot", F.row_number().over(order)).where("slot <= 3").select("hist", "word", "source", "child", "i", "slot")


def objective(counts: DataFrame, dev: DataFrame, order: int, num_words: int, scales: dict[str, float], discounts: dict[int, Sequence[float]], cut: Cut) -> float:
    """Log-probability a word of the held-out n-grams."""
    model = estimate(counts, order, num_words, scales, discounts)
    return log_prob(model, dev).first().per_word


def derivatives(counts: DataFrame, dev: DataFrame, order: int, num_words: int, scales: dict[str, float], discounts: dict[int, Sequence[float]], cut: Cut) -> tuple[float, dict[str, float]]:
    """Log-probability a word, and its derivatives by each source's scale and each order's discounts ('order2_D1')."""
    # forward, keeping what the way back needs
    found: dict[int, DataFrame] = {}
    model = estimate(counts, order, num_words, scales, discounts, keep=cut, orders=found)
    model = Model(cut(model.counts), cut(model.states), order, num_words)
    # the held-out text's derivatives by counts, discounts and totals
    once = cut(dev.groupBy("hist", "word").agg(F.sum("cnt").alias("n")))
    chained = steps(model, once)

    def p_at(k):
        return F.aggregate(F.slice("chain", F.lit(1), k), F.lit(0.0), lambda p, s: (s["c"] + s["disc"] * p) / s["total"])

    def each(s, k):
        r = F.aggregate(F.slice("chain", k + 2, F.size("chain")), F.lit(1.0), lambda b, x: b * x["disc"] / x["total"])
        g = F.col("n") / F.col("p") * r / s["total"]
        return F.struct(F.slice("hist", F.lit(1), s["k"]).alias("h"), g.alias("dc"), (g * p_at(k)).alias("dd"), (-g * p_at(k + 1)).alias("dt"))

    chained = cut(chained.withColumn("p", p_at(F.size("chain"))))
    total = chained.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("p")).alias("l")).first()
    parts = cut(chained.select("word", F.explode(F.transform("chain", each)).alias("s")).select(F.col("s.h").alias("hist"), "word", "s.dc", "s.dd", "s.dt"))
    by_state = parts.groupBy("hist").agg(F.sum("dt").alias("dt"), (F.sum("dd") + F.sum("dt")).alias("ddisc"))
    by_count = parts.groupBy("hist", "word").agg(F.sum("dc").alias("dc"))
    df = model.counts.join(by_count, ["hist", "word"], "left").join(by_state, "hist", "left")
    df = cut(df.select("ord", "hist", "word", (F.coalesce("dc", F.lit(0.0)) + F.coalesce("dt", F.lit(0.0))).alias("df"), F.coalesce("ddisc", F.lit(0.0)).alias("ddisc")))
    # order 1
    one = df.where("ord = 1")
    t = one.agg(F.sum(F.when(F.col("word") == UNK, F.col("df") / 2).otherwise(F.col("df") / 2 / (num_words - 2)))).first()[0]
    above = one.select("hist", "word", F.col("df").alias("t_total"), *[(F.lit(UNIGRAM[k]) * (F.lit(t) - F.col("df"))).alias(f"t{k + 1}") for k in range(3)])
    slots = _claims(counts.where("false"), scales, found[2])
    out = {f"order{o}_D{k}": 0.0 for o in range(2, order + 1) for k in (1, 2, 3, 4)}
    by_scale = {s: 0.0 for s in scales}
    for o in range(2, order + 1):
        d = [float(x) for x in discounts[o]]
        top = F.when(F.col("slot") == 1, F.col("t1")).when(F.col("slot") == 2, F.col("t2")).otherwise(F.col("t3"))
        claimed = slots.where("child is not null").join(above, ["hist", "word"]).select(F.col("child").alias("hist"), "word", "i", top.alias("s"))
        claimed = claimed.groupBy("hist", "word").agg(*[F.coalesce(F.sum(F.when(F.col("i") == k, F.col("s"))), F.lit(0.0)).alias(f"s{k}") for k in (1, 2, 3)])
        lower = above.select(F.col("hist").alias("b_hist"), "word", F.col("t_total").alias("b"))
        here = found[o].withColumn("b_hist", back_off()).join(lower, ["b_hist", "word"]).join(claimed, ["hist", "word"], "left")
        here = here.join(df.where(F.col("ord") == o).select("hist", "word", "df", "ddisc"), ["hist", "word"])
        e = F.col("ddisc") - F.col("df")
        g = [F.coalesce(f"s{k}", F.lit(0.0)) + F.col("b") + e for k in (1, 2, 3)] + [F.col("b") + e]
        c = F.col("cnt")
        tops = [c["top1"], c["top2"], c["top3"], c["total"] - c["top1"] - c["top2"] - c["top3"]]
        here = cut(here.select("hist", "word", (F.col("df") + d[3] * g[3]).alias("t_total"), *[(d[k] * g[k] - d[3] * g[3]).alias(f"t{k + 1}") for k in range(3)], *[(tops[k] * g[k]).alias(f"D{k + 1}") for k in range(4)]))
        sums = here.agg(*[F.coalesce(F.sum(f"D{k}"), F.lit(0.0)) for k in (1, 2, 3, 4)]).first()
        out |= {f"order{o}_D{k + 1}": sums[k] for k in range(4)}
        own = counts.where(F.col("ord") == o)
        slots = cut(_claims(own, scales, found.get(o + 1)))
        above = here.select("hist", "word", "t_total", "t1", "t2", "t3")
        for part in (own.join(above, ["hist", "word"]).groupBy("source").agg(F.sum(F.col("cnt") * F.col("t_total")).alias("x")),
                     slots.where("source is not null").join(above, ["hist", "word"]).groupBy("source").agg(F.sum(top).alias("x"))):
            for r in part.collect():  # a row for each source
                by_scale[r.source] += r.x
    n = total.n
    return total.l / n, {f"scale_{s}": x / n for s, x in by_scale.items()} | {k: x / n for k, x in out.items()}
