"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are pairs of neighbouring words, the ends of the text included, of weight w = 1 + ln(count). For each of ``SAMPLES``
samples every term draws, from hashes of itself and the sample's number, r and c from Gamma(2, 1) and beta from U(0, 1);
with t = floor(ln w / r + beta) its value is ln a = ln c - r (t - beta) - r. The term of least value, with its t, is the
text's sample.

The draws are made from three exponential variates e, f and q: c = e + f, r = ln(c / e) + q and beta = q / r, which have
just these distributions and are independent (for a given a = e and v = ln(c / e), the density of v is that of c - e,
Exp(1); so v and q are Exp(1) each, their sum is Gamma(2, 1) and beta uniform). Then a = e exp(-r t), so a term of weight
1, for which t is 0, has a = e: one hash, without a logarithm. Two texts have the same sample with a probability equal to the generalised Jaccard similarity of their
weights, the sum of minima over the sum of maxima, so the share of equal samples is an unbiased estimate of it, with a
standard error of sqrt(s (1 - s) / SAMPLES). A sample is kept as a number of 31 bits.

Counting a text's terms is done within its row. Then its distinct terms are exploded and each sample is a minimum over
them: an aggregation that keeps one row a text in each task, so terms are never shuffled.

The next document is found on narrow rows (id, hash of the text): they are ordered in ranges, which the session's number of
shuffle partitions makes as many as the cluster needs, and the first row of each range is the next of the last before it.
Of the next document's text only the part that is needed travels: texts are shuffled once, these parts once.

Defined results: null is the empty text, whose only term joins its two ends; equal texts have equal fingerprints; rows
of equal id are ordered by the hashes of their texts, null ids come last; of rows of equal id and text each but the last
is followed by its like; a single row is its own next; an empty table gives an empty table; other columns don't pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pixelloom.llm.support import bind, fresh, word_array
from pixelloom.session import cut, stored

SAMPLES = 48
#: A term's hash has 44 bits, its count 20: of terms that are found more often, the weight is that of ``MOST_COUNTED``.
COUNT_BITS, MOST_COUNTED = 20, (1 << 20) - 1
KEY = ["none", "id", "h"]
#: Copies of a row are made again in chunks of so many.
CHUNK = 1000
_LOW = 0xFFFFFFFF


def term_hashes(text: Column) -> Column:
    edge = F.array(F.lit("\n"))  # no word
    return bind(word_array(text), lambda w: F.zip_with(F.concat(edge, w), F.concat(w, edge), lambda a, b: F.xxhash64(a, b)))


def _repeated(extra: Column) -> Column:
    """The distinct terms, with their counts, of a sorted array that has each occurrence of a term but the first."""
    starts = F.filter(F.sequence(F.lit(0), F.size(extra) - 1), lambda i: (i == 0) | (F.get(extra, i) != F.get(extra, i - 1)))
    count = lambda at, p, j: F.least(F.coalesce(F.get(at, j + 1), F.size(extra)) - p + 1, F.lit(MOST_COUNTED))
    counted = bind(starts, lambda at: F.transform(at, lambda p, j: F.get(extra, p) + count(at, p, j)))
    return F.when(F.size(extra) > 0, counted).otherwise(F.array().cast("array<bigint>"))


def weighted_terms(text: Column) -> Column:
    """Every occurrence of a term as the upper bits of its hash, and each repeated term once more with its count in the lower bits."""
    packed = F.transform(term_hashes(text), lambda h: F.shiftleft(F.shiftright(h, COUNT_BITS), COUNT_BITS))

    def both(hashes: Column) -> Column:
        again = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.when(a == b, a))
        return F.concat(hashes, bind(F.filter(again, lambda x: x.isNotNull()), _repeated))

    return bind(F.sort_array(packed), both)


def _unit(bits: Column) -> Column:
    """32 bits as a number strictly between 0 and 1."""
    return (bits.cast("double") + 0.5) / float(1 << 32)


def _halves(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW).cast("long"))


def _draw(h: Column, count: Column, k: int) -> Column:
    """A term's draw for sample k: 1 - e ** -a as 31 bits above, for the minimum, and the term with its t in the lower 32."""
    # One hash serves two samples, each with one half of it.
    high = _halves(F.xxhash64(h, F.lit(k // 2)))[k % 2]
    e = -F.log(1.0 - _unit(high))
    two, three = (-F.log(_unit(x)) for x in _halves(F.xxhash64(h, F.lit(-1 - k))))
    r = F.log((e + two) / e) + three
    ln_w = F.log(1.0 + F.log(count.cast("double")))
    t = F.floor((ln_w + three) / r)
    value = F.floor(-F.expm1(-e * F.exp(-r * t)) * float(1 << 31)).cast("long")
    own = F.shiftrightunsigned(h, 12)
    sample = lambda moved: moved.bitwiseAND(F.lit(_LOW).cast("long"))
    once = F.shiftleft(F.shiftrightunsigned(high, 1), 32) + own
    return F.when(count == 0, once).otherwise(value * (1 << 32) + sample(own + t * 40503))


def fingerprints(df: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(*keys, samples): the samples of each text. Rows of equal ``keys`` must have equal texts."""
    term, = fresh(df, "term")
    terms = df.select(*keys, F.explode(weighted_terms(F.col(text))).alias(term))
    h, count = F.shiftrightunsigned(term, COUNT_BITS), F.col(term).bitwiseAND(F.lit(MOST_COUNTED).cast("long"))
    least = terms.groupBy(*keys).agg(*(F.min(_draw(h, count, k)).alias(f"_sample_{k}") for k in range(samples)))
    of_bits = lambda k: F.col(f"_sample_{k}").bitwiseAND(F.lit(_LOW >> 1).cast("long")).cast("int")
    return least.select(*keys, F.array(*(of_bits(k) for k in range(samples))).alias("samples"))


def as_string(samples: Column) -> Column:
    return F.array_join(F.transform(samples, F.hex), ".")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return equal / F.size(a)


def _keyed(docs: DataFrame) -> DataFrame:
    """(none, id, h, body, copies) of distinct rows: whether the id is null, the id, and the text's hash are the key."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))
    return rows.groupBy(*KEY).agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))


def following(docs: DataFrame) -> DataFrame:
    """(none, id, h, n_chars, copies, to_none, to_id, to_h): every distinct row with the key of the next by descending id."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(body).alias("h"), F.length(body).cast("long").alias("n_chars"))
    rows = cut(rows.groupBy(*KEY, "n_chars").agg(F.count(F.lit(1)).alias("copies")))
    order = [F.col("none"), F.col("id").desc(), F.col("h")]
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    place = F.struct(F.col("none"), (-F.col("id")).alias("back"), F.col("h"))
    # One row a range, which is one a shuffle partition.
    backwards = W.orderBy("range")
    firsts = ranged.groupBy("range").agg(F.min(place).alias("first"))
    wrap = F.first("first").over(backwards.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = cut(firsts.select(F.col("range").alias("of"), F.coalesce(F.lead("first").over(backwards), wrap).alias("after")))
    within = F.lead(place).over(W.partitionBy("range").orderBy(*order))
    found = ranged.withColumn("to", within).join(F.broadcast(firsts), F.col("range") == F.col("of")).withColumn("to", F.coalesce("to", "after"))
    return cut(found.select(*KEY, "n_chars", "copies", F.col("to.none").alias("to_none"), (-F.col("to.back")).alias("to_id"), F.col("to.h").alias("to_h")))


def _texts(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(none, id, h, role, digest, body): of each distinct row its text (role 0), the text edited with the next document
    (role 1) and, if the row has copies, with itself (role 2). digest: of edited texts."""
    base = _keyed(docs).where("copies > 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    asked = edges.select(*(F.col(c).alias(f"by_{c}") for c in KEY), *(F.col(f"to_{c}").alias(f"at_{c}") for c in KEY), half.alias("half"))
    met = base.join(asked, [F.col(c) == F.col(f"at_{c}") for c in KEY])
    parts = met.select(*(F.col(f"by_{c}") for c in KEY), F.substring("body", F.lit(1), F.col("half")).alias("part"))
    whole = base.join(parts, [F.col(c) == F.col(f"by_{c}") for c in KEY]).withColumn("n_chars", F.length("body"))
    first = F.substring("body", F.lit(1), F.col("n_chars") - half)
    texts = F.array(
        F.struct(F.lit(0).alias("role"), F.col("body").alias("body")),
        F.struct(F.lit(1).alias("role"), F.concat(first, F.col("part")).alias("body")),
        F.when(F.col("copies") > 1, F.struct(F.lit(2).alias("role"), F.concat(first, F.substring("body", F.lit(1), half)).alias("body"))),
    )
    each = whole.select(*KEY, F.explode(F.array_compact(texts)).alias("t")).select(*KEY, "t.role", "t.body")
    return each.withColumn("digest", F.when(F.col("role") > 0, F.sha2("body", 256)))


def fingerprint_report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they, and neighbours, are."""
    edges = following(docs)
    prints = stored(fingerprints(_texts(docs, edges), "body", [*KEY, "role", "digest"], samples), "fingerprints")
    own = prints.where("role = 0").select(*KEY, "samples")
    edited = prints.where("role > 0").select(*(F.col(c).alias(f"e_{c}") for c in KEY), "role", "digest", F.col("samples").alias("edited_samples"))
    rows = edges.join(own, KEY).join(edited, [F.col(c) == F.col(f"e_{c}") for c in KEY])
    after = own.select(*(F.col(c).alias(f"a_{c}") for c in KEY), F.col("samples").alias("next_samples"))
    rows = rows.join(after, [F.col(f"to_{c}") == F.col(f"a_{c}") for c in KEY])
    # Of equal rows the last is followed by the next key, the others by their like.
    again = F.when(F.col("role") == 1, F.lit(1).cast("long")).otherwise(F.col("copies") - 1)
    rows = rows.withColumn("again", again).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("again") - 1) / CHUNK))))
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(CHUNK), F.col("again") - F.col("chunk") * CHUNK).cast("int"))))
    return rows.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", F.col("digest").alias("edited_sha256"),
        as_string(F.col("samples")).alias("fingerprint"),
        as_string(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        F.when(F.col("role") == 1, likeness(F.col("samples"), F.col("next_samples"))).otherwise(1.0).alias("near_next"),
    )
