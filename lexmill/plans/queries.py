"""The engine's operators as queries over documents, and SQL that gives the same rows.

Training text is every document whose id isn't a multiple of 20, held-out text the rest; sources are languages; order 3.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import multiset
from ..functions.tokens import is_dev, sentences, shown, to_ids
from ..operators import counts as C
from ..operators import gradient
from ..operators import model as M
from ..operators import reestimate as R
from ..operators import vocab as V
from ..operators import tables as T
from ..session import cut, spread
from ..sources import arpa
from . import optimise, train

WORDS, ORDER = 1000, 3
SCALES = {"de": 0.35, "en": 0.5, "es": 0.2, "fr": 0.3}


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"))
    return sentences(docs.where(~is_dev())), sentences(docs.where(is_dev()))


class Corpus:
    """What most queries start from, lazily."""

    def __init__(self, spark: SparkSession, sf: str):
        self.train, self.dev = _lines(spark, sf)

    @property
    def words(self) -> DataFrame:
        return V.word_counts(self.train)

    @cached_property
    def vocab(self) -> DataFrame:
        return cut(V.vocabulary(self.words, WORDS))

    def counts(self, limit_unknown: bool = False) -> DataFrame:
        return C.int_counts(to_ids(self.train, self.vocab), ORDER, limit_unknown)

    def sentences(self) -> DataFrame:
        return to_ids(self.train, self.vocab)

    def dev_counts(self, by_source: bool = False) -> DataFrame:
        found = C.int_counts(to_ids(self.dev, self.vocab), ORDER)
        return found if by_source else C.merge_int_counts(found)

    def model(self) -> M.Model:
        return M.estimate(cut(self.counts()), ORDER, WORDS, SCALES)


def _e6(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("long")


def _exact(c: str) -> Column:
    """The sum of a column of doubles as decimals of 18 places: the same in any order of rows."""
    return F.sum(F.col(c).cast("decimal(38,18)"))


def _query(f: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(Corpus(spark, sf))


def _gram(df: DataFrame, *more) -> DataFrame:
    return df.select(*[c for c in ("source", "ord") if c in df.columns], shown().alias("history"), "word", *more)


def _general(c: Corpus, order: int) -> DataFrame:
    """Merged counts of an order, with what longer ones hand down."""
    pieces, handed = M.weighted(c.counts(), SCALES), None
    for o in range(ORDER, order - 1, -1):
        here = pieces.where(F.col("ord") == o).select("hist", "word", "cnt")
        merged = multiset.merge(here if handed is None else here.unionByName(handed), "hist", "word")
        handed = M.backed_off(M.discounted(merged, M.DISCOUNTS))
    return merged


def _tops(df: DataFrame) -> DataFrame:
    return _gram(df, _e6("cnt.total").alias("total_e6"), *[_e6(f"cnt.top{k}").alias(f"top{k}_e6") for k in (1, 2, 3)])


def _weights_step(c: Corpus) -> DataFrame:
    per, names, _ = V.mixture_table(c.words, V.word_counts(c.dev))
    per = cut(per)
    new = V.mixture_step(per, [1 / len(names)] * len(names))
    return per.sparkSession.createDataFrame([(n, round(x * 1e6)) for n, x in zip(names, new)], "source string, weight_e6 long")


def _table(c: Corpus, weights: dict[str, float]) -> DataFrame:
    return c.train.sparkSession.createDataFrame([(n, round(x * 1e6)) for n, x in weights.items()], "source string, weight_e6 long")


def _gradient(c: Corpus) -> DataFrame:
    counts, dev = cut(c.counts()), cut(c.dev_counts())
    value, found = gradient.derivatives(counts, dev, ORDER, WORDS, SCALES, {o: M.DISCOUNTS for o in (2, 3)}, cut)
    return counts.sparkSession.createDataFrame([("per_word", value), *sorted(found.items())], "name string, derivative double")


def _tuned(c: Corpus, order: int = 2, most: int = 1) -> DataFrame:
    """Bigram parameters after ``most`` steps from the usual start; train.optimise goes on until its tolerances are met."""
    counts, dev = cut(C.int_counts(to_ids(c.train, c.vocab), order)), cut(C.merge_int_counts(C.int_counts(to_ids(c.dev, c.vocab), order)))
    best, value, _ = train.optimise(counts, dev, order, WORDS, optimise.initial(sorted(SCALES), order, SCALES), most=most)
    return counts.sparkSession.createDataFrame([("per_word", value), *sorted(best.items())], "name string, value double")


def _pruned(c: Corpus, threshold: float = 0.5) -> M.Model:
    return R.pruned(c.model().cut(), threshold, cut)[0]


def _perplexity_by_source(c: Corpus) -> DataFrame:
    found = M.scored(c.model(), c.dev_counts(by_source=True)).groupBy("source").agg(F.sum("cnt").alias("words"), (F.sum(F.col("cnt") * F.log("prob")) / F.sum("cnt")).alias("per_word"))
    return found.select("source", "words", F.round(F.exp(-F.col("per_word")) * 1e3).cast("long").alias("perplexity_e3"))


def _em(c: Corpus) -> DataFrame:
    model = c.model().cut()
    return _gram(R.maximised(model, R.statistics(model, cut)).counts, _e6("count").alias("count_e6"))


def _min_counted(c: Corpus) -> DataFrame:
    found, _ = C.enforce_min_counts(cut(c.counts()), ORDER, {3: {s: 2.0 for s in SCALES}})
    return _gram(found, "cnt")


def _stats(c: Corpus) -> DataFrame:
    return _gram(R.statistics(c.model().cut(), cut).counts, _e6("count").alias("count_e6"))


def _folded(c: Corpus) -> DataFrame:
    model = M.estimate(cut(c.counts()), ORDER, WORDS, SCALES, fold=(cut(c.dev_counts()), SCALES["en"]))
    return model.states.select("ord", shown().alias("history"), _e6("total").alias("total_e6"), _e6("discount").alias("discount_e6"))


def _broken_vocabulary(c: Corpus) -> DataFrame:
    """A vocabulary with a gap, a repeated id, a repeated word, a word of two words and a control symbol missing."""
    v = c.vocab.where("word <> '<unk>'").select("word", F.when(F.col("id") == 10, 11).otherwise(F.col("id")).alias("id"))
    again = c.vocab.where("id = 20").select("word", F.lit(5000).alias("id"))
    return V.vocabulary_problems(v.union(again).union(again.select(F.lit("a b").alias("word"), F.lit(5001).alias("id"))))


def _broken_text(c: Corpus) -> DataFrame:
    """Training lines without a held-out source, some with control symbols, and a source of blank lines."""
    odd = F.col("doc") % 50
    lines = c.train.select(F.when(odd == 2, "blank").otherwise(F.col("source")).alias("source"), F.when(odd == 2, " ").when(odd == 1, F.concat(F.lit("</S> "), "line")).otherwise(F.col("line")).alias("line"))
    return V.text_problems(lines)


def _broken_model(c: Corpus) -> DataFrame:
    """A model of which some totals are too large, and some states are missing."""
    m = c.model()
    odd = F.col("hist")[0] % 7
    states = m.states.where((F.size("hist") != 1) | F.coalesce(odd != 3, F.lit(True)))
    states = states.withColumn("total", F.col("total") + F.when((F.size("hist") == 1) & (odd == 1), 1.0).otherwise(0.0))
    return M.problems(M.Model(m.counts, states, m.order, m.num_words))


def _with_utterances(c: Corpus) -> DataFrame:
    """The German lines begin with an id each."""
    name = F.concat(F.lit("utt"), F.col("doc").cast("string"), F.lit("-"), F.col("line_no").cast("string"), F.lit(" "))
    return V.utterance_ids(c.train.withColumn("line", F.when(F.col("source") == "de", F.concat(name, "line")).otherwise(F.col("line"))))


def _broken_sentences(c: Corpus) -> DataFrame:
    odd = F.col("doc") % 30 == 7
    return T.sentence_problems(c.sentences().select("source", F.when(odd, F.array_append("ids", F.lit(2))).otherwise(F.col("ids")).alias("ids")), WORDS)


def _broken_counts(c: Corpus) -> DataFrame:
    odd = (F.col("source") == "fr") & (F.col("word") == 5)
    return T.count_problems(c.counts().withColumn("cnt", F.when(odd, 0).otherwise(F.col("cnt"))), ORDER + 1, WORDS)


def _split_model(c: Corpus) -> DataFrame:
    found = T.split_model(c.model(), 3)
    return found.groupBy("split", "ord").agg(F.count("*").alias("ngrams"), F.countDistinct("hist").alias("states"), _e6(_exact("count")).alias("count_e6"))


def _merged_model(c: Corpus) -> DataFrame:
    m = T.merge_model(T.split_model(c.model(), 3), ORDER, WORDS)
    return m.counts.join(m.states.select("hist", "total"), "hist").groupBy("ord").agg(F.count("*").alias("ngrams"), _e6(_exact("count")).alias("count_e6"))


def _split_sizes(c: Corpus) -> DataFrame:
    return c.counts().groupBy("ord", C.split_of(4).alias("split")).agg(F.count("*").alias("ngrams"), F.sum("cnt").alias("total"))


QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {
    "word_counts_by_source": lambda c: c.words,
    "source_names": lambda c: V.source_names(c.train),
    "vocab_topk": lambda c: c.vocab,
    "vocab_problems": _broken_vocabulary,
    "oov_rate_by_source": lambda c: V.oov_rates(c.dev, c.vocab),
    "text_problems": _broken_text,
    "utterance_ids": _with_utterances,
    "sentence_problems": _broken_sentences,
    "count_problems": _broken_counts,
    "split_model_sizes": _split_model,
    "merged_model_sizes": _merged_model,
    "printed_int_counts": lambda c: T.int_counts_text(c.counts()).select("source", shown().alias("history"), "line"),
    "printed_histories": lambda c: T.history_text(R.protected(c.model())).select(shown().alias("history"), "line"),
    "unigram_weights": lambda c: _table(c, V.unigram_weights(cut(c.words), cut(V.word_counts(c.dev)))),
    "unigram_weights_step": _weights_step,
    "sentence_ids": lambda c: to_ids(c.dev, c.vocab).select("source", "doc", "line_no", F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string"))).alias("ids")),
    "ngram_counts": lambda c: _gram(c.counts(), "cnt"),
    "unk_truncated_counts": lambda c: _gram(c.counts(True), "cnt"),
    "ngram_tallies": lambda c: C.tallies(c.counts()),
    "bigram_counts_of_order": lambda c: _gram(C.of_order(c.counts(), 2), "cnt"),
    "history_split_sizes": _split_sizes,
    "subset_counts": lambda c: _gram(C.subset(c.counts(), 5), "cnt"),
    "merged_int_counts": lambda c: _gram(C.merge_int_counts(c.counts()), "cnt"),
    "min_count_ngrams": _min_counted,
    "merged_count_top3": lambda c: _tops(_general(c, 3)),
    "general_bigrams_top3": lambda c: _tops(_general(c, 2)),
    "trigram_discounted": lambda c: _gram(M.discounted(_general(c, 3), M.DISCOUNTS), _e6("count").alias("count_e6"), _e6("d").alias("d_e6")),
    "backoff_counts": lambda c: _tops(multiset.merge(M.backed_off(M.discounted(_general(c, 3), M.DISCOUNTS)), "hist", "word")),
    "unigram_model": lambda c: c.model().counts.where("ord = 1").select("word", _e6("count").alias("count_e6")),
    "model_counts": lambda c: _gram(c.model().counts, _e6("count").alias("count_e6")),
    "model_states": lambda c: c.model().states.select("ord", shown().alias("history"), _e6("total").alias("total_e6"), _e6("discount").alias("discount_e6")),
    "model_problems": _broken_model,
    "folded_states": _folded,
    "model_probs": lambda c: _gram(M.probabilities(c.model().cut()), _e6("prob").alias("prob_e6")),
    "backoff_weights": lambda c: M.back_off_weights(c.model()).select("ord", shown().alias("history"), _e6("log10").alias("log10_e6")),
    "dev_log_prob": lambda c: M.log_prob(c.model().cut(), c.dev_counts()).select("words", F.round(F.col("per_word") * 1e6).cast("long").alias("per_word_e6")),
    "perplexity_by_source": _perplexity_by_source,
    "protected_ngrams": lambda c: _gram(R.protected(c.model())),
    "shadowed_ngrams": lambda c: _gram(R.shadowed(c.model())),
    "vocab_common": lambda c: V.word_counts(c.dev).select("word").intersect(c.words.select("word")),
    "vocab_unseen": lambda c: V.word_counts(c.dev).select("word").subtract(c.words.select("word")),
    "float_stats": _stats,
    "em_step": _em,
    "pruned_counts": lambda c: _gram(_pruned(c).counts, _e6("count").alias("count_e6")),
    "pruned_without_zeros": lambda c: _gram(R.without_zeros(_pruned(c)).counts, _e6("count").alias("count_e6")),
    "gradient": _gradient,
    "tuned_parameters": _tuned,
    "arpa_lines": lambda c: arpa.lines(c.model().cut(), cut(c.vocab)),
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out log-probability and perplexity of a trigram model of all sources."""
    c = Corpus(spark, sf)
    return M.log_prob(c.model(), c.dev_counts())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(f) for name, f in QUERIES.items()}


_BASE = rf"""WITH l AS (SELECT lang AS source, doc_id AS doc, doc_id % 20 = 0 AS dev, i - 1 AS line_no, ll[i] AS line
    FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS ll FROM documents) q, unnest(range(1, len(ll) + 1)) AS r(i)),
t AS (SELECT source, doc, dev, line_no, [x FOR x IN string_split_regex(line, '\s+') IF x <> ''] AS tok FROM l),
w AS (SELECT source, doc, dev, line_no, i AS pos, tok[i] AS word FROM t, unnest(range(1, len(tok) + 1)) AS r(i)),
wc AS (SELECT source, word, count(*) AS cnt FROM w WHERE NOT dev GROUP BY ALL),
ranked AS (SELECT word, row_number() OVER (ORDER BY sum(cnt) DESC, word) AS r FROM wc WHERE word NOT IN ('<eps>', '<s>', '</s>', '<unk>') GROUP BY word),
vocab AS MATERIALIZED (SELECT word, CAST(r + 3 AS INTEGER) AS id FROM ranked WHERE r <= {WORDS + 1 - 4} UNION ALL VALUES ('<eps>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3)),
ids AS (SELECT t.source, t.doc, t.dev, t.line_no, coalesce(any_value(s), []) AS ids FROM t LEFT JOIN (
    SELECT w.doc, w.line_no, list(CASE WHEN coalesce(id, 3) <= 2 THEN 3 ELSE coalesce(id, 3) END ORDER BY pos) AS s FROM w LEFT JOIN vocab USING (word) GROUP BY ALL) x
    ON t.doc = x.doc AND t.line_no = x.line_no GROUP BY ALL),
g AS (SELECT source, dev, CASE WHEN i = 2 THEN 2 ELSE 3 END AS ord, s[i - 1] AS h1, CASE WHEN i > 2 THEN s[i - 2] END AS h2, s[i] AS word
    FROM (SELECT source, dev, list_concat(list_concat([1], ids), [2]) AS s FROM ids) q, unnest(range(2, len(s) + 1)) AS r(i)),
c AS MATERIALIZED (SELECT source, ord, h1, h2, word, count(*) AS cnt FROM g WHERE NOT dev GROUP BY ALL),
dc AS MATERIALIZED (SELECT ord, h1, h2, word, count(*) AS cnt FROM g WHERE dev GROUP BY ALL),
scale(source, s) AS (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SCALES.items())}),
p AS (SELECT ord, h1, h2, word, cnt * s AS total, list_slice([s, s, s], 1, least(cnt, 3)) AS tops FROM c JOIN scale USING (source)),
m3 AS (SELECT h1, h2, word, sum(total) AS total, list_slice(list_reverse_sort(flatten(list(tops))), 1, 3) AS tops FROM p WHERE ord = 3 GROUP BY ALL),
d3 AS MATERIALIZED (SELECT *, 0.8::DOUBLE * coalesce(tops[1], 0) AS x1, 0.4::DOUBLE * coalesce(tops[2], 0) AS x2, 0.2::DOUBLE * coalesce(tops[3], 0) AS x3,
    0.1::DOUBLE * (total - coalesce(tops[1], 0) - coalesce(tops[2], 0) - coalesce(tops[3], 0)) AS x4 FROM m3),
p2 AS (SELECT h1, word, total, tops FROM p WHERE ord = 2 UNION ALL SELECT h1, word, x1 + x2 + x3 + x4, [x1, x2, x3] FROM d3),
m2 AS (SELECT h1, word, sum(total) AS total, list_slice(list_reverse_sort(flatten(list(tops))), 1, 3) AS tops FROM p2 GROUP BY ALL),
d2 AS MATERIALIZED (SELECT *, 0.8::DOUBLE * coalesce(tops[1], 0) AS x1, 0.4::DOUBLE * coalesce(tops[2], 0) AS x2, 0.2::DOUBLE * coalesce(tops[3], 0) AS x3,
    0.1::DOUBLE * (total - coalesce(tops[1], 0) - coalesce(tops[2], 0) - coalesce(tops[3], 0)) AS x4 FROM m2),
m1 AS (SELECT word, sum(x1 + x2 + x3 + x4) AS total, list_slice(list_reverse_sort(flatten(list([x1, x2, x3]))), 1, 3) AS tops FROM d2 GROUP BY ALL),
d1 AS (SELECT word, total, 0.75::DOUBLE * coalesce(tops[1], 0) + 0.25::DOUBLE * coalesce(tops[2], 0) + 0.1::DOUBLE * coalesce(tops[3], 0) AS d FROM m1),
u AS MATERIALIZED (SELECT CAST(id AS INTEGER) AS word, coalesce(total - d, 0) + CASE WHEN id = 3 THEN x / 2 ELSE x / 2 / {WORDS - 2} END AS cnt
    FROM unnest(range(2, {WORDS + 1})) AS r(id) LEFT JOIN d1 ON d1.word = id, (SELECT sum(d) AS x FROM d1)),
mc AS MATERIALIZED (SELECT 3 AS ord, h1, h2, word, total - (x1 + x2 + x3 + x4) AS cnt FROM d3 UNION ALL SELECT 2, h1, NULL, word, total - (x1 + x2 + x3 + x4) FROM d2
    UNION ALL SELECT 1, NULL, NULL, word, cnt FROM u),
ms AS MATERIALIZED (SELECT 3 AS ord, h1, h2, sum(total) AS total, sum(x1 + x2 + x3 + x4) AS disc FROM d3 GROUP BY ALL
    UNION ALL SELECT 2, h1, NULL, sum(total), sum(x1 + x2 + x3 + x4) FROM d2 GROUP BY ALL UNION ALL SELECT 1, NULL, NULL, sum(cnt), 0 FROM u),
us AS (SELECT total AS t1 FROM ms WHERE ord = 1)
"""
_HIST = "concat_ws(' ', h1, h2) AS history"


def _e6_sql(x: str, name: str) -> str:
    return f"CAST(round(({x}) * 1000000) AS BIGINT) AS {name}"


_TOPS = ", ".join([_e6_sql("total", "total_e6"), *(_e6_sql(f"coalesce(tops[{k}], 0)", f"top{k}_e6") for k in (1, 2, 3))])


def _chain(grams: str) -> str:
    """Probabilities of n-grams (h1, h2, word) by the longest history there is."""
    return f"""SELECT x.*, CASE WHEN s3.total IS NOT NULL THEN (coalesce(c3.cnt, 0) + s3.disc * p2) / s3.total ELSE p2 END AS prob FROM (
        SELECT x.*, CASE WHEN s2.total IS NOT NULL THEN (coalesce(c2.cnt, 0) + s2.disc * u.cnt / t1) / s2.total ELSE u.cnt / t1 END AS p2
        FROM {grams} x CROSS JOIN us JOIN u ON u.word = x.word LEFT JOIN ms s2 ON s2.ord = 2 AND s2.h1 = x.h1 LEFT JOIN mc c2 ON c2.ord = 2 AND c2.h1 = x.h1 AND c2.word = x.word) x
        LEFT JOIN ms s3 ON s3.ord = 3 AND s3.h1 = x.h1 AND s3.h2 = x.h2 LEFT JOIN mc c3 ON c3.ord = 3 AND c3.h1 = x.h1 AND c3.h2 = x.h2 AND c3.word = x.word"""


#: Chains of counts (k3, k2), and the statistics of each n-gram (st).
_STATS = """, k2 AS MATERIALIZED (SELECT m.h1, m.word, m.cnt AS c2, s.total AS t2, s.disc AS d2, u.cnt AS u, t1 AS tu FROM mc m JOIN ms s ON s.ord = 2 AND s.h1 = m.h1 JOIN u ON u.word = m.word CROSS JOIN us WHERE m.ord = 2),
k3 AS MATERIALIZED (SELECT m.h1, m.h2, m.word, m.cnt AS c3, s.total AS t3, s.disc AS d3, coalesce(b.cnt, 0) AS c2, z.total AS t2, z.disc AS d2, u.cnt AS u, t1 AS tu FROM mc m JOIN ms s ON s.ord = 3 AND s.h1 = m.h1 AND s.h2 = m.h2
    JOIN ms z ON z.ord = 2 AND z.h1 = m.h1 LEFT JOIN mc b ON b.ord = 2 AND b.h1 = m.h1 AND b.word = m.word JOIN u ON u.word = m.word CROSS JOIN us WHERE m.ord = 3),
a3 AS MATERIALIZED (SELECT *, d3 * c2 / t2 AS x1, d3 * d2 / t2 * u / tu AS x0 FROM k3), k3s AS (SELECT h1, word, sum(x1) AS x1, sum(x0) AS x0 FROM a3 GROUP BY ALL),
b2 AS (SELECT k2.*, c2 - coalesce(x1, 0) AS x, coalesce(x0, 0) AS took FROM k2 LEFT JOIN k3s USING (h1, word)),
a2 AS MATERIALIZED (SELECT *, CASE WHEN x / greatest(c2, 1e-20) >= 1e-5 THEN x / greatest(c2, 1e-20) * d2 * u / tu ELSE 0 END AS x0 FROM b2),
t0 AS (SELECT word, sum(x) AS x FROM (SELECT word, x0 AS x FROM a3 UNION ALL SELECT word, x0 FROM a2) y GROUP BY word),
st AS MATERIALIZED (SELECT 3 AS ord, h1, h2, word, greatest(0, c3 + x1 + x0) AS x FROM a3 UNION ALL SELECT 2, h1, NULL, word, greatest(0, x + x0) FROM a2
    UNION ALL SELECT 1, NULL, NULL, u.word, greatest(0, u.cnt - coalesce(t0.x, 0)) FROM u LEFT JOIN t0 USING (word))"""


def _delta() -> str:
    """What pruning changes, from c, d, big and p."""
    b, nb, nbig, nd = "(big * p)", "(big * p + c)", "(big + c)", "(d + c)"
    aug, bc = f"(c + d * {b} / big)", f"(d * (big - {b}) / big)"
    ao = f"({b} - d * {b} / big)"
    cc = f"(big - {b} - {bc})"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * ln({y}) ELSE 0 END"
    return " + ".join([part(aug, f"{nd} * {nb} / {nbig} / {aug}"), part(ao, f"({nb} / {nbig}) / ({b} / big)"), part(bc, f"({nd} / {nbig}) / (d / big)"), part(cc, f"big / {nbig}")])


#: The counts after pruning by 0.5 (pruned).
_PRUNED = f""", w3 AS (SELECT m.h1, m.h2, m.word, m.cnt AS c, s.disc AS d, z.total AS big, (coalesce(b.cnt, 0) + z.disc * u.cnt / t1) / z.total AS p FROM mc m JOIN ms s ON s.ord = 3 AND s.h1 = m.h1 AND s.h2 = m.h2
    JOIN ms z ON z.ord = 2 AND z.h1 = m.h1 LEFT JOIN mc b ON b.ord = 2 AND b.h1 = m.h1 AND b.word = m.word JOIN u ON u.word = m.word CROSS JOIN us WHERE m.ord = 3 AND m.cnt <> 0),
o3 AS MATERIALIZED (SELECT h1, h2, word, c, ({_delta()}) > -0.5 AS out FROM w3),
g3 AS (SELECT h1, word, sum(c) AS c FROM o3 WHERE out GROUP BY ALL),
n2 AS MATERIALIZED (SELECT m.h1, m.word, m.cnt + coalesce(g3.c, 0) AS c FROM mc m LEFT JOIN g3 USING (h1, word) WHERE m.ord = 2),
w2 AS (SELECT n2.h1, n2.word, c, s.disc AS d, t1 AS big, u.cnt / t1 AS p FROM n2 JOIN ms s ON s.ord = 2 AND s.h1 = n2.h1 JOIN u ON u.word = n2.word CROSS JOIN us WHERE c <> 0
    AND NOT EXISTS (SELECT 1 FROM mc g WHERE g.ord = 3 AND g.cnt <> 0 AND g.h2 = n2.h1 AND g.h1 = n2.word) AND NOT EXISTS (SELECT 1 FROM o3 WHERE NOT out AND o3.h1 = n2.h1 AND o3.word = n2.word)),
o2 AS MATERIALIZED (SELECT h1, word, c FROM w2 WHERE ({_delta()}) > -0.5), g2 AS (SELECT word, sum(c) AS c FROM o2 GROUP BY word),
pruned AS (SELECT 3 AS ord, m.h1, m.h2, m.word, CASE WHEN out THEN 0 ELSE m.cnt END AS cnt FROM mc m LEFT JOIN o3 USING (h1, h2, word) WHERE m.ord = 3
    UNION ALL SELECT 2, n2.h1, NULL, n2.word, CASE WHEN o2.h1 IS NOT NULL THEN 0 ELSE n2.c END FROM n2 LEFT JOIN o2 ON o2.h1 = n2.h1 AND o2.word = n2.word
    UNION ALL SELECT 1, NULL, NULL, u.word, u.cnt + coalesce(g2.c, 0) FROM u LEFT JOIN g2 USING (word))"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "word_counts_by_source": "SELECT * FROM wc",
        "source_names": "SELECT CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS id, source AS name FROM (SELECT DISTINCT source FROM l WHERE NOT dev)",
        "vocab_topk": "SELECT word, id FROM vocab",
        "oov_rate_by_source": """SELECT source, count(*) AS tokens, CAST(sum(CASE WHEN coalesce(id, 3) <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS unknown,
            CAST(sum(CASE WHEN id <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS reserved FROM w LEFT JOIN vocab USING (word) WHERE dev GROUP BY source""",
        "unigram_weights_step": f""", q AS (SELECT word, source, cnt / sum(cnt) OVER (PARTITION BY source) AS q FROM wc),
            dv AS (SELECT word, count(*) AS n FROM w WHERE dev GROUP BY word), mix AS (SELECT word, n, sum(q) AS s FROM dv JOIN q USING (word) GROUP BY ALL)
            SELECT source, {_e6_sql("sum(n * q / s) / (SELECT sum(n) FROM mix)", "weight_e6")} FROM mix JOIN q USING (word) GROUP BY source""",
        "sentence_ids": "SELECT source, doc, CAST(line_no AS INTEGER) AS line_no, array_to_string(ids, ' ') AS ids FROM ids WHERE dev",
        "ngram_counts": f"SELECT source, ord, {_HIST}, word, cnt FROM c",
        "unk_truncated_counts": """SELECT source, CASE WHEN k IS NULL THEN 2 ELSE 3 END AS ord, concat_ws(' ', h1, k) AS history, word, count(*) AS cnt
            FROM (SELECT *, CASE WHEN h1 <> 3 THEN h2 END AS k FROM g WHERE NOT dev) GROUP BY ALL""",
        "ngram_tallies": "SELECT ord, count(*) AS ngrams, CAST(sum(cnt) AS BIGINT) AS total FROM c GROUP BY ord",
        "bigram_counts_of_order": f"SELECT source, ord, {_HIST}, word, cnt FROM c WHERE ord = 2",
        "history_split_sizes": "SELECT ord, CAST(h1 % 4 AS INTEGER) AS split, count(*) AS ngrams, CAST(sum(cnt) AS BIGINT) AS total FROM c GROUP BY ALL",
        "subset_counts": f"SELECT source, ord, {_HIST}, word, cnt FROM c WHERE h1 % 5 = 0",
        "merged_int_counts": f"SELECT ord, {_HIST}, word, CAST(sum(cnt) AS BIGINT) AS cnt FROM c GROUP BY ord, h1, h2, word",
        "min_count_ngrams": f""", a AS (SELECT h1, h2, word, sum(cnt) AS n FROM c WHERE ord = 3 GROUP BY ALL),
            k AS (SELECT source, h1, CASE WHEN ord = 3 AND n >= 2 THEN h2 END AS h2, c.word, c.cnt FROM c LEFT JOIN a USING (h1, h2, word))
            SELECT source, CASE WHEN h2 IS NULL THEN 2 ELSE 3 END AS ord, {_HIST}, word, CAST(sum(cnt) AS BIGINT) AS cnt FROM k GROUP BY source, h1, h2, word""",
        "merged_count_top3": f"SELECT {_HIST}, word, {_TOPS} FROM m3",
        "general_bigrams_top3": f"SELECT CAST(h1 AS VARCHAR) AS history, word, {_TOPS} FROM m2",
        "trigram_discounted": f"SELECT {_HIST}, word, {_e6_sql('total - (x1 + x2 + x3 + x4)', 'count_e6')}, {_e6_sql('x1 + x2 + x3 + x4', 'd_e6')} FROM d3",
        "backoff_counts": f"""SELECT CAST(h1 AS VARCHAR) AS history, word, {_TOPS} FROM (
            SELECT h1, word, sum(x1 + x2 + x3 + x4) AS total, list_slice(list_reverse_sort(flatten(list([x1, x2, x3]))), 1, 3) AS tops FROM d3 GROUP BY ALL)""",
        "unigram_model": f"SELECT word, {_e6_sql('cnt', 'count_e6')} FROM u",
        "model_counts": f"SELECT ord, {_HIST}, word, {_e6_sql('cnt', 'count_e6')} FROM mc",
        "model_states": f"SELECT ord, {_HIST}, {_e6_sql('total', 'total_e6')}, {_e6_sql('disc', 'discount_e6')} FROM ms",
        "model_probs": f"SELECT ord, {_HIST}, word, {_e6_sql('prob', 'prob_e6')} FROM ({_chain('mc')})",
        "backoff_weights": f"SELECT ord, {_HIST}, {_e6_sql('log10(disc / total)', 'log10_e6')} FROM ms WHERE ord > 1",
        "dev_log_prob": f"SELECT CAST(sum(cnt) AS BIGINT) AS words, {_e6_sql('sum(cnt * ln(prob)) / sum(cnt)', 'per_word_e6')} FROM ({_chain('dc')})",
        "perplexity_by_source": f"""SELECT source, CAST(sum(cnt) AS BIGINT) AS words, CAST(round(exp(-sum(cnt * ln(prob)) / sum(cnt)) * 1000) AS BIGINT) AS perplexity_e3
            FROM ({_chain('(SELECT source, ord, h1, h2, word, count(*) AS cnt FROM g WHERE dev GROUP BY ALL)')}) GROUP BY source""",
        "protected_ngrams": "SELECT DISTINCT CASE WHEN ord = 3 THEN CAST(h2 AS VARCHAR) ELSE '' END AS history, h1 AS word FROM mc WHERE ord > 1 AND cnt <> 0",
        "shadowed_ngrams": "SELECT DISTINCT CASE WHEN ord = 3 THEN CAST(h1 AS VARCHAR) ELSE '' END AS history, word FROM mc WHERE ord > 1 AND cnt <> 0",
        "vocab_common": "SELECT word FROM w WHERE dev INTERSECT SELECT word FROM w WHERE NOT dev",
        "vocab_unseen": "SELECT word FROM w WHERE dev EXCEPT SELECT word FROM w WHERE NOT dev",
        "utterance_ids": """, tt AS (SELECT source, dev, CASE WHEN source = 'de' THEN list_prepend(concat('utt', doc, '-', line_no), tok) ELSE tok END AS tok FROM t),
            f AS (SELECT source, tok[1] AS w, count(*) AS n FROM tt WHERE NOT dev AND len(tok) > 1 GROUP BY ALL),
            r AS (SELECT DISTINCT source, unnest(tok[2:]) AS w FROM tt WHERE NOT dev AND len(tok) > 1)
            SELECT source, min(w) AS first FROM (SELECT f.*, n > 1 OR r.w IS NOT NULL AS ordinary FROM f LEFT JOIN r ON f.source = r.source AND f.w = r.w) GROUP BY source HAVING sum(n) > 1 AND NOT bool_or(ordinary)""",
        "vocab_problems": """, b AS (SELECT word, CASE WHEN id = 10 THEN 11 ELSE id END AS id FROM vocab WHERE word <> '<unk>' UNION ALL SELECT word, 5000 FROM vocab WHERE id = 20 UNION ALL VALUES ('a b', 5001))
            SELECT 'ids have gaps or repeat' AS problem FROM b HAVING min(id) <> 0 OR max(id) <> count(*) - 1 OR count(DISTINCT id) <> count(*)
            UNION ALL SELECT concat('repeated word ', word) FROM b GROUP BY word HAVING count(*) > 1 UNION ALL SELECT concat('bad word ', chr(39), word, chr(39)) FROM b WHERE word = '' OR contains(word, ' ')
            UNION ALL SELECT concat('control symbol out of place: ', x) FROM (VALUES ('<eps>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3)) y(x, i) WHERE NOT EXISTS (SELECT 1 FROM b WHERE word = x AND id = i)""",
        "text_problems": """, b AS (SELECT CASE WHEN doc % 50 = 2 THEN 'blank' ELSE source END AS source, CASE WHEN doc % 50 = 2 THEN [] WHEN doc % 50 = 1 THEN list_prepend('</S>', tok) ELSE tok END AS tok FROM t WHERE NOT dev)
            SELECT 'no held-out source' AS problem UNION ALL SELECT concat('no words in ', source) FROM b GROUP BY source HAVING sum(len(tok)) = 0
            UNION ALL SELECT DISTINCT concat('control symbol in ', source) FROM b WHERE len([x FOR x IN tok IF lower(x) IN ('<s>', '</s>')]) > 0""",
        "model_problems": """, there AS (SELECT * FROM ms WHERE NOT (ord = 2 AND h1 % 7 = 3))
            SELECT concat('total isn''t discount and counts: [', h1, ']') AS problem FROM there WHERE ord = 2 AND h1 % 7 = 1
            UNION ALL SELECT DISTINCT concat('missing shorter history [', h1, ']') FROM ms WHERE ord = 3 AND h1 % 7 = 3
            UNION ALL SELECT concat('counts without a state: [', h1, ']') FROM ms WHERE ord = 2 AND h1 % 7 = 3""",
        "sentence_problems": """, b AS (SELECT source, CASE WHEN doc % 30 = 7 THEN list_append(ids, 2) ELSE ids END AS ids FROM ids WHERE NOT dev)
            SELECT concat('ids out of range in ', source, ': ', sum(len([x FOR x IN ids IF x <= 2]))) AS problem FROM b GROUP BY source HAVING sum(len([x FOR x IN ids IF x <= 2])) > 0
            UNION ALL SELECT concat('no words in ', source) FROM b GROUP BY source HAVING max(len(ids)) = 0""",
        "count_problems": """SELECT DISTINCT concat('counts under 1 in ', source) AS problem FROM c WHERE source = 'fr' AND word = 5 UNION ALL SELECT concat('no n-grams of order ', x) FROM (VALUES (2), (3), (4)) y(x) WHERE x NOT IN (SELECT ord FROM c)""",
        "split_model_sizes": f"""SELECT CAST(s AS INTEGER) AS split, ord, count(*) AS ngrams, count(DISTINCT concat(h1, ' ', h2)) AS states, {_e6_sql("sum(cnt)", "count_e6")} FROM mc, (VALUES (0), (1), (2)) y(s)
            WHERE ord = 1 OR h1 % 3 = s GROUP BY ALL""",
        "merged_model_sizes": f"SELECT ord, count(*) AS ngrams, {_e6_sql('sum(cnt)', 'count_e6')} FROM mc GROUP BY ord",
        "printed_int_counts": """SELECT source, concat_ws(' ', h1, h2) AS history, concat(' [ ', concat_ws(' ', h1, h2), ' ]: total=', sum(cnt), ' ', string_agg(concat(word, '->', cnt, ' '), '' ORDER BY word)) AS line FROM c GROUP BY source, h1, h2""",
        "printed_histories": """, ph AS (SELECT DISTINCT CASE WHEN ord = 3 THEN CAST(h2 AS VARCHAR) END AS h, h1 AS word FROM mc WHERE ord > 1 AND cnt <> 0)
            SELECT coalesce(h, '') AS history, concat(' [ ', CASE WHEN h IS NULL THEN '' ELSE h || ' ' END, ']: ', string_agg(concat(word, ' '), '' ORDER BY word)) AS line FROM ph GROUP BY h""",
        "float_stats": f"{_STATS} SELECT ord, {_HIST}, word, {_e6_sql('x', 'count_e6')} FROM st",
        "em_step": f"""{_STATS}, e3 AS (SELECT st.h1, st.h2, st.word, x, c3 / t3 AS q2, d3 / t3 * c2 / t2 AS q1, d3 / t3 * d2 / t2 * u / tu AS q0 FROM st JOIN k3 USING (h1, h2, word) WHERE st.ord = 3 AND x > 0),
            e2 AS (SELECT st.h1, st.word, x, c2 / t2 AS q1, d2 / t2 * u / tu AS q0 FROM st JOIN k2 USING (h1, word) WHERE st.ord = 2 AND x > 0),
            parts AS (SELECT 3 AS ord, h1, h2, word, x * q2 / (q0 + q1 + q2) AS y FROM e3 UNION ALL SELECT 2, h1, NULL, word, x * q1 / (q0 + q1 + q2) FROM e3 UNION ALL SELECT 1, NULL, NULL, word, x * q0 / (q0 + q1 + q2) FROM e3
                UNION ALL SELECT 2, h1, NULL, word, x * q1 / (q0 + q1) FROM e2 UNION ALL SELECT 1, NULL, NULL, word, x * q0 / (q0 + q1) FROM e2 UNION ALL SELECT 1, NULL, NULL, word, x FROM st WHERE ord = 1),
            new AS (SELECT ord, coalesce(h1, -1) AS a, coalesce(h2, -1) AS b, word, sum(y) AS y FROM parts GROUP BY ALL)
            SELECT mc.ord, {_HIST}, mc.word, {_e6_sql('coalesce(y, 0)', 'count_e6')} FROM mc LEFT JOIN new ON mc.ord = new.ord AND coalesce(mc.h1, -1) = a AND coalesce(mc.h2, -1) = b AND mc.word = new.word""",
        "pruned_counts": f"{_PRUNED} SELECT ord, {_HIST}, word, {_e6_sql('cnt', 'count_e6')} FROM pruned",
        "pruned_without_zeros": f"{_PRUNED} SELECT ord, {_HIST}, word, {_e6_sql('cnt', 'count_e6')} FROM pruned WHERE ord = 1 OR cnt <> 0",
        "arpa_lines": f""", pr AS MATERIALIZED (SELECT ord, h1, h2, word, log10(prob) AS prob FROM ({_chain('mc')}) UNION ALL SELECT 1, NULL, NULL, 1, -99),
            bo AS (SELECT ord - 1 AS ord, CASE WHEN ord = 3 THEN h2 END AS g1, h1 AS g2, log10(disc / total) AS w FROM ms WHERE ord > 1),
            r AS (SELECT pr.ord, concat_ws(' ', pr.h2, pr.h1, pr.word) AS ids, concat_ws(' ', v2.word, v1.word, v0.word) AS ng, prob, w FROM pr JOIN vocab v0 ON v0.id = pr.word LEFT JOIN vocab v1 ON v1.id = pr.h1 LEFT JOIN vocab v2 ON v2.id = pr.h2
                LEFT JOIN bo ON bo.ord = pr.ord AND pr.h2 IS NULL AND bo.g2 = pr.word AND coalesce(bo.g1, -1) = coalesce(pr.h1, -1))
            SELECT CAST(ord AS INTEGER) AS ord, concat('1', ids) AS key, concat(printf('%.6g', prob), chr(9), ng, CASE WHEN w IS NULL THEN '' ELSE chr(9) || printf('%.6g', w) END) AS line FROM r
            UNION ALL SELECT 0, concat('1', lpad(CAST(ord AS VARCHAR), 3, '0')), concat('ngram ', ord, '=', count(*)) FROM r GROUP BY ord
            UNION ALL SELECT DISTINCT CAST(ord AS INTEGER), '0', concat(chr(10), chr(92), ord, '-grams:') FROM r UNION ALL SELECT 0, '0', '\\data\\' UNION ALL SELECT 1000, '0', concat(chr(10), '\\end\\')""",
    }
    fold = f"p AS (SELECT ord, h1, h2, word, cnt * {SCALES['en']}::DOUBLE AS total, list_slice([{SCALES['en']}::DOUBLE, {SCALES['en']}, {SCALES['en']}], 1, least(cnt, 3)) AS tops FROM dc UNION ALL SELECT ord,"
    folded = _BASE.replace("p AS (SELECT ord,", fold) + f"SELECT ord, {_HIST}, {_e6_sql('total', 'total_e6')}, {_e6_sql('disc', 'discount_e6')} FROM ms"
    return {name: _BASE + q for name, q in sql.items()} | {"folded_states": folded}
