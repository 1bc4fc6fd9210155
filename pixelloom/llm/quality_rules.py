"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule compares one figure of a text with a cutoff. The cutoffs aren't set by hand:

* The labelled documents are split by a hash of their ids. On a quarter, the design part, each cutoff of each rule is
  judged by itself; those that reject more bad documents than the rule's last one make a path, the cutoffs that reject
  the fewest good documents first. Along the path the rules taken so far reject more and more.
* On the rest, the holdout, each stratum (here a language) goes along the path as far as is safe. A step is safe if the
  exact binomial test rejects "more than ``alpha`` of the stratum's good documents are rejected by any rule so far"; the
  test stops at the first step that isn't (fixed-sequence testing). The error level ``delta`` is divided by the number of
  strata (Bonferroni).

So with probability 1 - ``delta``, in no stratum do the rules together reject more than ``alpha`` of the good documents. A
stratum with too few labelled good documents rejects nothing.

Strata are as many as there are values, null included; the table of strata is broadcast if it has at most
``BROADCAST_STRATA`` rows and else joined, salted; the result is the same.

Defined results: null and empty texts have no words and fail the base rule; a document counts as labelled good if any
label row of its id says so, and each labelled document row counts once; without labels only the base rule acts; equal
rows get equal results; an empty table gives an empty table; all other columns pass through, and columns named as outputs
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pixelloom.llm.support import SPACE_CLASS, bind, fresh, once, word_array
from pixelloom.session import cut

WINDOW = 5
ALPHA, DELTA = 0.02, 0.05
BROADCAST_STRATA, SALTS = 10_000, 32
#: Ids whose MD5 (of the id as text, in hexadecimal) begins so are in the design part.
DESIGN = "0123"
#: Cutoffs of each rule, laxest first; a text is rejected if its figure is above the cutoff.
GRIDS: dict[str, list[float]] = {
    "symbol_share": [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05],
    "shout_share": [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "repeat_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "long_words": [60.0, 40.0, 30.0, 24.0, 20.0, 17.0, 15.0, 13.0, 12.0],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more. ``words`` must be a column, not an expression.

    Windows are compared by a 64-bit hash. Only where two are equal are hashes sorted with their
    positions, so the cost is n log n for texts of any length."""
    n = F.size(words)

    def joined(step: int, count: Column):
        """Hashes of pairs of elements that are ``step`` apart."""
        return lambda h: F.zip_with(F.slice(h, F.lit(1), count), F.slice(h, F.lit(step + 1), count), lambda a, b: F.xxhash64(a, b))

    def windows(w: Column) -> Column:
        """Hashes of runs of 1, 2, 4 ... words, put together to ``width``: few function calls for each word."""
        have, size = w, 1
        while size < width:
            step = min(size, width - size)
            have, size = bind(have, joined(step, n - size - step + 1)), size + step
        return have

    hashes = F.when(n >= width, windows(words)).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        sorted_pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(pairs) - 1)
            same = lambda j, k: F.get(pairs, j)["h"] == F.get(pairs, k)["h"]
            hit = F.filter(at, lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            return F.array_sort(F.transform(hit, lambda j: F.get(pairs, j)["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            bind(sorted_pairs, positions),
            start,
            lambda acc, x: F.struct(x.alias("last"), (acc["total"] + F.least(F.lit(width), x - acc["last"])).alias("total")),
            lambda acc: acc["total"],
        )

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))).cast("long")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of the base rule and the figure of each rule to every row."""
    df = df.drop(*COUNTS, *GRIDS, "base_failed")
    t, words, lines, n_lines, upper, shouts = fresh(df, "whole", "words", "lines", "n_lines", "upper", "shouts")
    body = F.col(t)
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = once(out, **{words: word_array(body), lines: F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}"))})
    out = once(
        out,
        n_words=F.size(words).cast("long"),
        word_chars=F.length(F.array_join(words, "")).cast("long"),
        n_symbols=_found(body, "[#*$%&|<>]"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        n_repeat_words=repeated_words(F.col(words)),
        **{
            n_lines: F.size(lines),
            upper: _found(body, "[A-Z]").cast("double"),
            shouts: (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("double"),
        },
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    out = out.withColumns(
        {
            "symbol_share": per_word("n_symbols"),
            "shout_share": per_word(shouts),
            "upper_share": F.col(upper) / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col(n_lines), F.lit(1)),
            "repeat_share": per_word("n_repeat_words"),
            "long_words": per_word("word_chars"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    return out.drop(t, words, lines, n_lines, upper, shouts)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of the binomial distribution, summed exactly from k down in logarithms of the largest term."""
    odds = (1.0 - p) / p
    log_choose = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0),
        lambda acc, i: acc + F.log((n - k + i).cast("double") / i.cast("double")),
    )
    log_top = log_choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(acc: Column, i: Column) -> Column:
        term = acc["term"] * i.cast("double") / (n - i + 1).cast("double") * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    downwards = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ratio = F.aggregate(downwards, start, down, lambda acc: acc["total"])
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top + F.log(ratio))))


def _marked(figures: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """(none, s, good, design, *rules) of the labelled rows: whether the stratum is null, the stratum, and whether the row is good."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("of")).agg((F.max("quality") == 1).alias("good"))
    own = F.col(stratum).cast("string")
    design = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(*DESIGN)
    rows = figures.select("doc_id", own.isNull().alias("none"), F.coalesce(own, F.lit("")).alias("s"), *GRIDS)
    return rows.join(marks, rows["doc_id"] == marks["of"]).select("none", "s", "good", design.alias("design"), *GRIDS)


def path_of(marked: DataFrame) -> list[tuple[str, float]]:
    """The steps (rule, cutoff) in the order in which strata go along them: a choice among a fixed list, from one row of counts."""
    steps = [(rule, i, float(c)) for rule, grid in GRIDS.items() for i, c in enumerate(grid)]
    over = lambda rule, c, good: F.sum((F.col(rule).__gt__(c) & (F.col("good") == good)).cast("long"))
    counts = marked.where("design").agg(*(over(r, c, good).alias(f"{r}:{i}:{int(good)}") for r, i, c in steps for good in (True, False))).first()
    order = list(GRIDS)
    found = []
    for rule, i, c in steps:
        bad, before = (counts[f"{rule}:{j}:0"] or 0 if j >= 0 else 0 for j in (i, i - 1))
        if bad > before:
            found.append((counts[f"{rule}:{i}:1"], i, order.index(rule), rule, c))
    return [(rule, c) for *_, rule, c in sorted(found)]


def first_step(path: list[tuple[str, float]]) -> Column:
    """The number, from 1, of the first step of the path that rejects a row; null if none does."""
    chains = []
    for rule in GRIDS:
        chain = None
        for n, (r, c) in enumerate(path, 1):
            if r == rule:
                chain = F.when(F.col(rule) > c, F.lit(n)) if chain is None else chain.when(F.col(rule) > c, F.lit(n))
        if chain is not None:
            chains.append(chain)
    return F.least(*chains) if len(chains) > 1 else chains[0] if chains else F.lit(None).cast("int")


def safe_steps(marked: DataFrame, path: list[tuple[str, float]], alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(none, s, n, steps) of every stratum of the holdout: its good documents, and how many steps of the path are safe."""
    good = marked.where("good and not design").select("none", "s", first_step(path).alias("at"))
    rejected = [F.sum((F.col("at") <= n).cast("long")) for n in range(1, len(path) + 1)]
    counts = good.groupBy("none", "s").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.coalesce(k, F.lit(0).cast("long")) for k in rejected)).cast("array<bigint>").alias("rejected"))
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(W.partitionBy()))
    tests = counts.select("none", "s", "n", "strata", F.posexplode_outer("rejected").alias("before", "k"))
    safe = tests.select("none", "s", "n", "before", (binomial_tail(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata")).alias("safe"))
    # The steps before the first that isn't safe.
    return safe.groupBy("none", "s", "n").agg(F.coalesce(F.min(F.when(~F.col("safe"), F.col("before"))), F.lit(len(path))).alias("steps"))


def _judged(rows: DataFrame, marked: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """Adds ``kept`` to rows with figures."""
    path = path_of(marked)
    at, steps, none, s, salt, place = fresh(rows, "at", "steps", "none", "s", "salt", "place")
    table = cut(safe_steps(marked, path, alpha, delta).where("steps > 0").select(F.col("none").alias(none), F.col("s").alias(s), F.col("steps").alias(steps)))
    own = F.col(stratum).cast("string")
    same = (own.isNull() == F.col(none)) & (F.coalesce(own, F.lit("")) == F.col(s))
    if table.count() <= BROADCAST_STRATA:
        joined = rows.join(F.broadcast(table), same, "left").drop(none, s)
    else:
        table = table.withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int"))
        joined = salted.join(table, same & (F.col(salt) == F.col(place)), "left").drop(none, s, salt, place)
    rejected = F.coalesce(first_step(path) <= F.col(steps), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(at, steps)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Adds counts, figures and ``kept`` to every row; the rest of the row stays. The figures of labelled rows are made first,
    so that the rows are neither stored with their texts nor shuffled."""
    labelled = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("of")).distinct()
    learned = docs.select("doc_id", text, stratum)
    learned = measured(learned.join(labelled, learned["doc_id"] == labelled["of"], "left_semi"), text)
    return _judged(measured(docs.drop("kept"), text), cut(_marked(learned, labels, stratum)), stratum, alpha, delta)


def quality_report(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The verdicts without the texts: a few numbers a row are checkpointed, so that no join carries texts."""
    figures = cut(measured(docs.select("doc_id", text, stratum), text).drop(text))
    return _judged(figures, cut(_marked(figures, labels, stratum)), stratum, alpha, delta).select("doc_id", *COUNTS, "base_failed", "kept")
