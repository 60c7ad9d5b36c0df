"""Expected-count statistics, expectation maximisation, pruning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import back_off
from .model import Model, scored, walked

FLOOR = 1e-20
#: Statistics of n-grams whose own share of the count is below this are left out.
LEAST_SHARE = 1e-5


def steps(model: Model, grams: DataFrame, own: str | None = None, longest: int | None = None) -> DataFrame:
    """Different ``grams`` with chain: k, c, total and disc at every history along the back-off (the first k of hist), shortest first. own, longest: as in :func:`.model.walked`."""
    step = lambda k, c, total, disc: F.array(F.struct(F.lit(k).alias("k"), c.alias("c"), total.alias("total"), disc.alias("disc")))
    first = step(0, F.col("u"), F.col("all"), F.lit(0.0))
    found = walked(model, grams, first, lambda chain, k, c, total, disc: F.concat(chain, step(k, c, total, disc)), own, longest)
    return found.withColumnRenamed("acc", "chain")


def statistics(model: Model, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> Model:
    """What the model would have seen, were its discounted counts exact: disjoint counts (counts) and discounts (states).

    From the highest order down, an n-gram takes back from its shorter histories what backing off to them gives it. Each order depends only on
    higher ones.
    """
    moved = None  # what higher orders took from (hist, word), and gave to discounts
    freed = None
    rows, states = [], []
    for o in range(model.order, 0, -1):
        work = model.counts.where(F.col("ord") == o).select("hist", "word", F.col("count").alias("c"), F.col("count").alias("x"))
        if moved is not None:
            got = moved.where(F.size("hist") == o - 1).groupBy("hist", "word").agg(F.sum("x").alias("took"))
            work = work.join(got, ["hist", "word"], "left").select("hist", "word", "c", (F.col("x") - F.coalesce("took", F.lit(0.0))).alias("x"))
        if o > 1:
            ratio = F.col("x") / F.greatest("c", F.lit(FLOOR))
            share = steps(model, work if moved is None else cut(work), "c", o - 1)
            # walking down: what is left of the weight after each longer history, times the word's share there
            top = F.element_at("chain", -1)
            lower = F.reverse(F.slice("chain", F.lit(1), F.size("chain") - 1))
            none = F.array().cast("array<struct<k:int,x:double>>")
            down = F.aggregate(lower, F.struct((ratio * top["disc"]).alias("b"), none.alias("xs")),
                               lambda a, s: F.struct((a["b"] * s["disc"] / s["total"]).alias("b"), F.concat(a["xs"], F.array(F.struct(s["k"].alias("k"), (a["b"] * s["c"] / s["total"]).alias("x")))).alias("xs")))
            xs = F.when(ratio >= LEAST_SHARE, F.reverse(down["xs"])).otherwise(none)  # shortest first
            share = cut(share.select("hist", "word", "x", xs.alias("xs")))
            took = share.select("hist", "word", F.explode("xs").alias("s")).select(F.slice("hist", F.lit(1), F.col("s.k")).alias("hist"), "word", "s.x")
            upto = F.transform("xs", lambda x, k: F.aggregate(F.slice("xs", F.lit(1), k + 1), F.lit(0.0), lambda a, y: a + y["x"]))
            gave = share.select("hist", F.posexplode(upto).alias("k", "x")).select(F.slice("hist", F.lit(1), F.col("k") + 1).alias("hist"), "x")
            moved = took if moved is None else moved.unionByName(took)
            freed = gave if freed is None else freed.unionByName(gave)
            work = share.select("hist", "word", (F.col("x") + F.aggregate("xs", F.lit(0.0), lambda a, y: a + y["x"])).alias("x"))
        rows.append(work.select(F.lit(o).alias("ord"), "hist", "word", F.greatest("x", F.lit(0.0)).alias("count")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out = cut(out)
    base = model.states.select("ord", "hist", "discount")
    if freed is not None:
        base = base.join(freed.groupBy("hist").agg(F.sum("x").alias("x")), "hist", "left").select("ord", "hist", (F.col("discount") - F.coalesce("x", F.lit(0.0))).alias("discount"))
    sums = out.groupBy("hist").agg(F.sum("count").alias("s"))
    disc = F.greatest("discount", F.lit(0.0))
    states = base.join(sums, "hist", "left").select("ord", "hist", (disc + F.coalesce("s", F.lit(0.0))).alias("total"), disc.alias("discount"))
    return Model(out, states, model.order, model.num_words)


def maximised(model: Model, stats: Model) -> Model:
    """A step of expectation maximisation: the statistics spread over the histories that could have made them."""
    grams = stats.counts.where("count > 0").select("hist", "word", F.col("count").alias("x"))
    found = steps(model, grams)
    # contributions of each history to p: c/total times the back-off product of longer ones; as plain columns, for expressions on arrays are interpreted
    levels = range(model.order)
    found = found.select("hist", "word", "x", *[F.get("chain", F.lit(k)).alias(f"s{k}") for k in levels])
    b = F.lit(1.0)
    for k in reversed(levels):
        s, there = F.col(f"s{k}"), F.col(f"s{k}").isNotNull()
        found = found.select("*", F.when(there, b * s["c"] / s["total"]).otherwise(0.0).alias(f"q{k}"), F.when(there, b * s["disc"] / s["total"]).otherwise(b).alias(f"b{k}"))
        b = F.col(f"b{k}")
    found = found.select("*", F.lit(0.0).alias("p0"))
    for k in levels:
        found = found.select("*", (F.col(f"p{k}") + F.col(f"q{k}")).alias(f"p{k + 1}"))
    p = F.col(f"p{model.order}")
    shares = [F.when(F.col(f"s{k}").isNotNull(), F.struct(F.lit(k).alias("k"), (F.col("x") * F.col(f"q{k}") / p).alias("c"), (F.col("x") * F.col(f"p{k}") / p).alias("d"))) for k in levels]
    each = found.where(p > 0).select("hist", "word", F.explode(F.array(*shares)).alias("s")).where("s is not null")
    each = each.select(F.slice("hist", F.lit(1), F.col("s.k")).alias("hist"), "word", F.col("s.c").alias("c"), F.col("s.d").alias("d"))
    new = each.groupBy("hist", "word").agg(F.sum("c").alias("new"))
    counts = model.counts.select("ord", "hist", "word").join(new, ["hist", "word"], "left").select("ord", "hist", "word", F.coalesce("new", F.lit(0.0)).alias("count"))
    freed = each.groupBy("hist").agg(F.sum("d").alias("d"))
    sums = counts.groupBy("hist").agg(F.sum("count").alias("s"))
    disc = F.coalesce("d", F.lit(0.0)) + F.coalesce("sd", F.lit(0.0))
    states = model.states.select("ord", "hist").join(stats.states.select("hist", F.col("discount").alias("sd")), "hist", "left").join(freed, "hist", "left").join(sums, "hist", "left")
    states = states.select("ord", "hist", (disc + F.coalesce("s", F.lit(0.0))).alias("total"), disc.alias("discount"))
    return Model(counts, states, model.order, model.num_words, model.meta)


def stats_log_prob(model: Model, stats: Model) -> tuple[float, float]:
    """The log-probability a word and the words that the model gives its statistics."""
    direct = scored(model, stats.counts.where("count > 0").select("hist", "word", F.col("count").alias("cnt"))).agg(F.sum(F.col("cnt") * F.log("prob"))).first()[0] or 0.0
    off = stats.states.where("discount > 0").select("hist", F.col("discount").alias("x")).join(model.states.where("discount > 0"), "hist")
    backed = off.agg(F.sum(F.col("x") * F.log(F.col("discount") / F.col("total")))).first()[0] or 0.0
    words = stats.states.agg(F.sum(F.col("total") - F.col("discount"))).first()[0] or 0.0
    return ((direct + backed) / words if words else 0.0), words


def protected(model: Model) -> DataFrame:
    """hist and word of n-grams that the model needs: some history with a count goes through them."""
    live = model.counts.where((F.col("count") != 0) & (F.size("hist") > 0)).select("hist").distinct()
    return live.select(F.slice("hist", F.lit(2), F.size("hist")).alias("hist"), F.col("hist")[0].alias("word"))


def shadowed(model: Model) -> DataFrame:
    """hist and word of n-grams that a longer one with a count backs off to."""
    return model.counts.where("ord > 1 and count != 0").select(back_off().alias("hist"), "word").distinct()


def pruned(model: Model, threshold: float, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[Model, float]:
    """The model with n-grams' counts at zero that cost less than ``threshold`` in log-probability, and what that costs in all.

    N-grams that longer histories go through when pruning starts stay. Orders go from the highest down; within one, all decisions are from the model as it stood before that order.
    """
    counts, states, cost, guard = model.counts, model.states, 0.0, cut(protected(model))
    for o in range(model.order, 1, -1):
        now = Model(counts, states, model.order, model.num_words)
        here = counts.where((F.col("ord") == o) & (F.col("count") != 0)).select("hist", "word", F.col("count").alias("c"))
        here = here.join(guard, ["hist", "word"], "left_anti").join(shadowed(now), ["hist", "word"], "left_anti")
        here = here.join(states.select("hist", F.col("discount").alias("disc")), "hist").withColumn("b_hist", back_off())
        below = scored(now, here.select(F.col("b_hist").alias("hist"), "word").distinct()).select(F.col("hist").alias("b_hist"), "word", "prob")
        here = here.join(below, ["b_hist", "word"]).join(states.select(F.col("hist").alias("b_hist"), F.col("total").alias("B")), "b_hist")
        out = cut(here.withColumn("delta", prune_change()).where(F.col("delta") > -threshold).select("hist", "b_hist", "word", "c", "delta"))
        cost += out.agg(F.coalesce(F.sum("delta"), F.lit(0.0))).first()[0]
        given = out.groupBy(F.col("b_hist").alias("hist"), "word").agg(F.sum("c").alias("more"))
        gone = out.select("hist", "word", F.lit(True).alias("gone"))
        counts = counts.join(gone, ["hist", "word"], "left").join(given, ["hist", "word"], "left")
        counts = cut(counts.select("ord", "hist", "word", (F.when(F.col("gone"), 0.0).otherwise(F.col("count")) + F.coalesce("more", F.lit(0.0))).alias("count")))
        to_disc, to_total = out.groupBy("hist").agg(F.sum("c").alias("d")), out.groupBy(F.col("b_hist").alias("hist")).agg(F.sum("c").alias("t"))
        states = states.join(to_disc, "hist", "left").join(to_total, "hist", "left")
        states = cut(states.select("ord", "hist", (F.col("total") + F.coalesce("t", F.lit(0.0))).alias("total"), (F.col("discount") + F.coalesce("d", F.lit(0.0))).alias("discount")))
    return Model(counts, states, model.order, model.num_words, model.meta), cost


def prune_change():
    """What pruning an n-gram changes in log-probability (never more than 0): from c, disc, B (the shorter history's total) and prob after it."""
    c, disc, big = F.col("c"), F.col("disc"), F.col("B")
    b = big * F.col("prob")
    aug, bc, ao = c + disc * b / big, disc * (big - b) / big, b - disc * b / big
    cc = big - b - bc
    nb, nbig, ndisc = b + c, big + c, disc + c

    def part(x, y):
        return F.when(x > 0, x * F.log(y)).otherwise(0.0)

    return part(aug, ndisc * nb / nbig / aug) + part(ao, (nb / nbig) / (b / big)) + part(bc, (ndisc / nbig) / (disc / big)) + part(cc, big / nbig)


def without_zeros(model: Model, stats: Model | None = None) -> Model | tuple[Model, Model]:
    """The model without zero counts and histories left empty that nothing longer needs; of its statistics, what was at those n-grams goes to shorter histories."""
    counts = model.counts.where((F.col("count") != 0) | (F.col("ord") == 1))
    used = counts.select("hist").distinct()
    for _ in range(model.order - 1):
        used = used.union(used.where("size(hist) > 0").select(back_off().alias("hist"))).distinct()
    states = model.states.join(used, "hist", "left_semi").select("ord", "hist", "total", "discount")
    out = Model(counts, states, model.order, model.num_words, model.meta)
    if stats is None:
        return out
    rows, moved = [], None
    lost = None
    for o in range(model.order, 0, -1):
        now = stats.counts.where(F.col("ord") == o).select("hist", "word", "count")
        if moved is not None:
            now = now.unionByName(moved).groupBy("hist", "word").agg(F.sum("count").alias("count"))
        stay = now.join(counts.select("hist", "word"), ["hist", "word"], "left_semi")
        rows.append(stay.select(F.lit(o).alias("ord"), "hist", "word", "count"))
        if o > 1:
            go = now.join(counts.select("hist", "word"), ["hist", "word"], "left_anti")
            moved = go.select(back_off().alias("hist"), "word", "count")
            gone = go.groupBy("hist").agg(F.sum("count").alias("more"))
            lost = gone if lost is None else lost.unionByName(gone)
    kept = rows[0]
    for r in rows[1:]:
        kept = kept.unionByName(r)
    disc = stats.states.select("hist", "discount").join(lost, "hist", "left") if lost is not None else stats.states.select("hist", "discount").withColumn("more", F.lit(0.0))
    disc = disc.join(used, "hist", "left_semi").select("hist", (F.col("discount") + F.coalesce("more", F.lit(0.0))).alias("discount"))
    sums = kept.groupBy("hist").agg(F.sum("count").alias("s"))
    new = disc.join(sums, "hist", "left").select((F.size("hist") + 1).alias("ord"), "hist", (F.col("discount") + F.coalesce("s", F.lit(0.0))).alias("total"), "discount")
    return out, Model(kept, new, stats.order, stats.num_words)
