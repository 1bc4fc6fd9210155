"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are runs of five words. A shingle's weight is its count in the text times a damped inverse document
   frequency, 1 + ``DAMPING`` x min(1, log(N / df) / log(1 / ``FREQUENT``)): from 1, for a shingle of every document, up
   to 1 + ``DAMPING``, for those of a share below ``FREQUENT`` of all. Without damping a large group of near copies would
   devalue the very shingles that its members share. Document frequencies are exact: counts within chunks of the
   corpus leave a bounded number of candidates, which are counted over all documents. Frequent shingles are at most
   1 / ``FREQUENT`` times a document's mean number of shingles, however many documents there are, so their table can be
   sent to every task.
2. Improved consistent weighted sampling: for each of K samples a shingle draws r, c ~ Gamma(2, 1) and
   beta ~ U(0, 1); with t = floor(ln w / r + beta) its value is ln a = ln c - r (t - beta) - r, and the
   shingle of least value, with its t, is the sample. Two texts agree in a sample with a probability equal
   to their weighted Jaccard similarity. The variates come from a table indexed by a hash for each sample.
3. Banding: ``ROWS`` samples make a key, ``BANDS`` keys a text. Texts of equal key share a bucket.
4. In each bucket the most central texts lead, those whose buckets hold the most texts and, of these,
   whose shingles are the most frequent (one of each of ``LEADERS`` hash classes), and the others are
   compared with them by exact weighted Jaccard similarity. The original of a group of edited copies is in
   the largest bucket of every band, so it leads wherever it is. Texts that are like none of their leaders
   are compared again in finer buckets, of the keys of one more band each round, with texts that haven't
   led, ``REFINEMENTS`` rounds at most. A bucket of n texts costs n x LEADERS comparisons a round.
5. The rounds only save work; what they leave is settled exactly. Bucket mates of which neither led are
   known to be in one class or are left over. Those left over are joined on the shingles that a pair of
   ``SIMILARITY`` t must share: with shingles in one order, the rarest first, the first common one of a pair comes
   where at least t of either text's weight is left, and t / (1 + t) of both weights. Texts are compared if they
   meet at such a shingle and aren't in one class yet. That is without loss; n texts cost n squared comparisons
   only if they share their rare shingles too and still aren't alike. Members of a shingle's main class meet only
   the texts outside of it there.
6. Similar pairs are links; classes are the connected components of links and equal texts, found by
   passing on the least label along links, with checkpoints.

Any bucket, leader, text, class or hub may be that of a third of all rows. Joins on them go through ``spread_join``: keys of
more rows than a shuffle partition's half share are few, so what they look up is broadcast; a leader's text goes to as
many places as its members fill; a shingle's places meet in blocks.

Exact copies are one node throughout: nodes are hashes of texts (64 bits).

Defined results: null and empty texts are equal texts; a text of one to four words has one shingle, all
its words; repeated rows and rows without id are rows of their own; the class id is the least doc_id of the
class, null if it has none; an empty table gives an empty table; other columns pass through ``near_dedup``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.support import fresh, narrow, share_of_partition, small_batches, spread_join
from pixelloom.llm.text_arrays import bounded_batches, counted, mix, segments, shingles_of, text_bytes, words_of
from pixelloom.session import release, stored, stored_so_far

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS = 3, 14
LEADERS, REFINEMENTS, BLOCK = 4, 3, 500
DF_CELLS, FREQUENT, DAMPING, LEVELS = 1 << 19, 0.01, 0.25, 8
#: Shingles that are counted together in a worker, 32 MB.
CHUNK = 4_000_000
_VARIATES = 1 << 16


def document_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (document, element, count)."""
    raw, offsets = text_bytes(texts)
    return counted(*shingles_of(words_of(raw, offsets), len(texts), width))


def _locally_frequent(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(element, n, docs) of the shingles that are in at least half of ``FREQUENT`` of some chunk's documents, in how many
    of such chunks' documents they are; the row without an element has the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = rows = total = 0

        def frequent() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= FREQUENT / 2 * rows
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["element", "n"])

        for batch in bounded_batches(batches, text):
            _, element, _ = document_shingles(batch.column(text), width)
            held.append(element)
            size, rows, total = size + len(element), rows + batch.num_rows, total + batch.num_rows
            if size >= CHUNK and (rows >= 4 / FREQUENT or size >= 4 * CHUNK):
                yield frequent()
                held, size, rows = [], 0, 0
        if held:
            yield frequent()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["element", "n"])

    return docs.select(text).mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))


class Frequencies:
    """Levels 0 .. LEVELS - 1 of the damped inverse document frequency: of each frequent shingle; all others have the last."""

    def __init__(self, total: float, elements: np.ndarray, counts: np.ndarray):
        order = np.argsort(elements)
        self.elements = elements[order]
        rarity = np.minimum(1.0, np.log(np.maximum(1.0, total / counts[order])) / np.log(1.0 / FREQUENT))
        self.levels = np.round(rarity * (LEVELS - 1)).astype(np.uint8)
        self.cells = np.zeros(DF_CELLS, dtype=bool)
        self.cells[(elements & np.uint64(DF_CELLS - 1)).astype(np.int64)] = True

    def places(self, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the shingles are in the table, and where."""
        maybe = np.flatnonzero(self.cells[(element & np.uint64(DF_CELLS - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.elements, element[maybe]), len(self.elements) - 1)
        found = self.elements[at] == element[maybe]
        return maybe[found], at[found]

    def level(self, element: np.ndarray) -> np.ndarray:
        out = np.full(len(element), LEVELS - 1, dtype=np.uint8)
        which, at = self.places(element)
        out[which] = self.levels[at]
        return out

    def weight(self, element: np.ndarray, count: np.ndarray) -> np.ndarray:
        return count * _idf(self.level(element))


def frequencies(docs: DataFrame, text: str, width: int) -> Frequencies:
    """The document frequencies of all frequent shingles, counted exactly over all documents.

    A shingle of a share ``FREQUENT`` of all documents is in at least half of that share of all if only the chunks are
    counted in which it is in half of that share of the chunk's documents. So these counts leave a bounded number of
    candidates, and no frequent shingle out; candidates are counted once more, exactly."""
    local = narrow(_locally_frequent(docs, text, width))
    total = float(local.where("element is null").agg(F.sum("n")).first()[0] or 0)
    candidates = local.where(F.col("element").isNotNull() & (F.col("n") >= F.lit(FREQUENT / 2 * total))).select("element").toPandas()
    known = np.sort(candidates["element"].to_numpy(np.int64).view(np.uint64))
    if not len(known):
        return Frequencies(total, known, np.empty(0))
    shared = docs.sparkSession.sparkContext.broadcast(Frequencies(total, known, np.ones(len(known))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known), dtype=np.int64)
        for batch in bounded_batches(batches, text):
            _, element, _ = document_shingles(batch.column(text), width)
            counts += np.bincount(shared.value.places(element)[1], minlength=len(counts))
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["at", "n"])

    counts = docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = counts.where(F.col("n") >= max(2.0, FREQUENT * total)).toPandas()
    return Frequencies(total, known[table["at"].to_numpy(np.int64)], table["n"].to_numpy(np.float64))


def _idf(level: np.ndarray) -> np.ndarray:
    return 1.0 + DAMPING * level / (LEVELS - 1)


class Sampler:
    """Improved consistent weighted sampling with tabulated variates."""

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r, c, self.beta = rng.gamma(2.0, 1.0, _VARIATES), rng.gamma(2.0, 1.0, _VARIATES), rng.random(_VARIATES)
        self.ln_c = np.log(c)
        self.multipliers = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Almost all counts are 1: for these, values are looked up by level.
        self.once = np.concatenate([self.value(np.arange(_VARIATES), np.full(_VARIATES, _idf(np.array(level)))) for level in range(LEVELS)])

    def value(self, index: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """ln a, as an order-preserving 32-bit number in the upper half of 64 bits."""
        r, beta = self.r[index], self.beta[index]
        t = np.floor(np.log(weight) / r + beta)
        bits = (self.ln_c[index] - r * (t - beta) - r).astype(np.float32).view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        return ordered.astype(np.uint64) << np.uint64(32)

    def signatures(self, element: np.ndarray, count: np.ndarray, level: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One row per sample, one column per document."""
        spread = mix(element)
        low = spread & np.uint64(0xFFFFFFFF)
        offset = level.astype(np.int64) * _VARIATES
        many = np.flatnonzero(count > 1)
        weight = count[many] * _idf(level[many])
        out = np.empty((len(self.multipliers), len(begins)), dtype=np.uint64)
        for k, m in enumerate(self.multipliers):
            index = ((spread * m) >> np.uint64(48)).astype(np.int64)
            keys = self.once[offset + index]
            if len(many):
                keys[many] = self.value(index[many], weight)
            out[k] = np.minimum.reduceat(keys | low, begins)
        return out


@lru_cache(maxsize=2)
def _sampler(samples: int) -> Sampler:
    return Sampler(samples)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """Keys of all bands; one column per document."""
    bands = len(signatures) // rows
    keys = np.zeros((bands, signatures.shape[1]), dtype=np.uint64)
    for b in range(bands):
        keys[b] = np.uint64(b + 1)
        for i in range(rows):
            keys[b] = mix(keys[b] * np.uint64(0x9E3779B97F4A7C15) + signatures[b * rows + i])
    return keys


def _node(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _buckets(docs: DataFrame, text: str, levels, width: int, rows: int, bands: int) -> DataFrame:
    """(node, keys, common) of every row that has shingles; common: how frequent they are on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(rows * bands)
        table = levels.value
        for batch in bounded_batches(batches, text):
            doc, element, count = document_shingles(batch.column(text), width)
            if not len(doc):
                continue
            docs_in, begins = segments(doc)
            level = table.level(element)
            keys = band_keys(sampler.signatures(element, count, level, begins), rows).T.copy().view(np.int64)
            n, per = keys.shape
            common = -np.add.reduceat(level.astype(np.float64), begins) / np.diff(np.append(begins, len(doc)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * per + 1, per, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(docs_in)), lists, pa.array(common)], names=["node", "keys", "common"])

    return docs.select(_node(text).alias("node"), F.col(text)).mapInArrow(run, "node long, keys array<long>, common double")


def _similarities(pairs: DataFrame, texts: DataFrame, levels, width: int) -> DataFrame:
    """Adds the exact weighted Jaccard similarity to pairs (a, b, a_led, b_led) of nodes.

    The text of one side, the leader's if there is one, goes to as many places as its pairs fill."""
    pairs = narrow(pairs.withColumn("hub", F.when(F.col("a_led") | ~F.col("b_led"), F.col("a")).otherwise(F.col("b"))))
    pairs = pairs.withColumn("spoke", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    of_hub = narrow(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")))
    share, any_hot = share_of_partition(of_hub, "n")
    of_hub = of_hub.select("hub", F.ceil(F.col("n") / share).cast("int").alias("places"))
    placed = pairs.withColumn("place", F.lit(0))
    if any_hot:
        many = of_hub.where("places > 1").select(F.col("hub").alias("many"), F.col("places").alias("among"))
        placed = pairs.join(F.broadcast(many), F.col("hub") == F.col("many"), "left")
        placed = placed.withColumn("place", F.pmod(F.xxhash64("spoke"), F.coalesce("among", F.lit(1))).cast("int")).drop("many", "among")
    hubs = of_hub.join(texts, F.col("hub") == F.col("node")).select(F.col("hub").alias("of"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at"), F.col("text").alias("text_hub"))
    spokes = texts.select(F.col("node").alias("spoke"), F.col("text").alias("text_spoke"))
    both = placed.join(spokes, "spoke").join(hubs, (F.col("hub") == F.col("of")) & (F.col("place") == F.col("at")))
    both = both.select("a", "b", "a_led", "b_led", "hub", "text_hub", "text_spoke")
    names = ["a", "b", "a_led", "b_led"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        memory: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def weighted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            doc, element, count = document_shingles(texts, width)
            weight = table.weight(element, count)
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            return [(element[i:j], weight[i:j]) for i, j in zip(bounds, bounds[1:])]

        for outer in bounded_batches(batches, "text_hub"):
            for batch in bounded_batches([outer], "text_spoke"):
                nodes = batch.column("hub").to_pylist()
                new = {n: i for i, n in enumerate(nodes) if n not in memory}
                own = dict(zip(new, weighted(batch.column("text_hub").take(pa.array(list(new.values()), pa.int64())))))
                found = []
                for n, (e, w) in zip(nodes, weighted(batch.column("text_spoke"))):
                    e0, w0 = own[n] if n in own else memory[n]
                    _, i, j = np.intersect1d(e0, e, assume_unique=True, return_indices=True)
                    shared = float(np.minimum(w0[i], w[j]).sum())
                    found.append(shared / max(1e-12, float(w0.sum() + w.sum()) - shared))
                memory |= own
                while len(memory) > 64:
                    memory.popitem(last=False)
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, pa.float64())], names=[*names, "similarity"])

    return both.mapInArrow(run, "a long, b long, a_led boolean, b_led boolean, similarity double")


def _mixed_cells(rest: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash cell of shingles, in how many texts (node, label, text) its shingles are, and whether these have several labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(DF_CELLS, dtype=np.int64)
        least, most = np.full(DF_CELLS, _LAST, dtype=np.int64), np.full(DF_CELLS, -_LAST, dtype=np.int64)
        for batch in bounded_batches(batches, "text"):
            doc, element, _ = document_shingles(batch.column("text"), width)
            label = batch.column("label").to_numpy(zero_copy_only=False)[doc]
            cell = (element & np.uint64(DF_CELLS - 1)).astype(np.int64)
            n += np.bincount(cell, minlength=DF_CELLS)
            np.minimum.at(least, cell, label)
            np.maximum.at(most, cell, label)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(x[part]) for x in (n, least, most))], names=["cell", "n", "least", "most"])

    rows = rest.mapInArrow(run, "cell int, n long, least long, most long").groupBy("cell")
    table = rows.agg(F.sum("n").alias("n"), (F.min("least") < F.max("most")).alias("mixed")).toPandas()
    often, mixed = np.zeros(DF_CELLS, dtype=np.int64), np.zeros(DF_CELLS, dtype=bool)
    often[table["cell"].to_numpy()] = table["n"].to_numpy()
    mixed[table["cell"].to_numpy()] = table["mixed"].to_numpy()
    return often, mixed


_LAST = np.iinfo(np.int64).max


def _required(rest: DataFrame, levels, width: int, similarity: float) -> DataFrame:
    """(key, node, label, weight, left) for texts (node, label, text): the shingles at which a text can first meet a similar
    one of another label. left: the weight from this shingle on."""
    cells = rest.sparkSession.sparkContext.broadcast(_mixed_cells(rest, width))
    slack = 1e-9
    names = ["key", "node", "label", "weight", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (often, mixed) = levels.value, cells.value
        for batch in bounded_batches(batches, "text"):
            doc, element, count = document_shingles(batch.column("text"), width)
            if not len(doc):
                continue
            node, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label"))
            cell = (element & np.uint64(DF_CELLS - 1)).astype(np.int64)
            weight = table.weight(element, count)
            order = np.lexsort((element, often[cell], doc))
            doc, element, weight, cell = doc[order], element[order], weight[order], cell[order]
            whole = np.bincount(doc, weight, minlength=batch.num_rows)
            _, begins = segments(doc)
            before = np.cumsum(weight) - weight
            left = whole[doc] - (before - np.repeat(before[begins], np.diff(np.append(begins, len(doc)))))
            # A similar text weighs at least ``similarity`` times as much, so they have that share of this one in common.
            at = np.flatnonzero(mixed[cell] & (left >= similarity * whole[doc] * (1 - slack)))
            for i in range(0, len(at), 100_000):
                t = at[i : i + 100_000]
                columns = [element[t].view(np.int64), node[doc[t]], label[doc[t]], whole[doc[t]], left[t]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rest.mapInArrow(run, "key long, node long, label long, weight double, left double")


def _left_over(state: DataFrame, unled: DataFrame, texts: DataFrame, tested: DataFrame, levels, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b, a_led, b_led) that the rounds haven't compared, aren't known to be in one class and can be similar:
    without loss among ``unled`` (node, bucket), the texts that don't lead their first buckets."""
    known = components(tested.where(F.col("similarity") >= similarity)).withColumnRenamed("node", "k")
    labelled = narrow(state.select("node").join(known, F.col("node") == F.col("k"), "left").select("node", F.coalesce("label", "node").alias("label")))
    mates = unled.join(labelled, "node")
    mixed = mates.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most").select("bucket", "n")
    rest = spread_join(mates, mixed, "bucket").select("node", "label").distinct()
    rest = stored(rest.join(texts, "node"), "left-over")
    places = stored(_required(rest, levels, width, similarity), "places")
    # Of two texts of different labels one hasn't the label that most texts at the shingle have: those meet all others there.
    of_label = places.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    meet = of_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    meet = meet.select("key", "n", F.col("top.label").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("blocks"))
    # The fewer texts are dealt into blocks, each of which meets all: no task gets a whole hot shingle.
    places = narrow(spread_join(places, meet, "key"))
    of = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("key", "node", "label", "weight", "left")]
    x = places.where("label <> main").select(*of("x"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block_x"))
    y = places.select(*of("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_y"))
    common = F.lit(similarity / (1.0 + similarity) * (1 - 1e-9)) * (F.col("weight_x") + F.col("weight_y"))
    enough = F.least("left_x", "left_y") >= common
    met = x.join(y, (F.col("key_x") == F.col("key_y")) & (F.col("block_x") == F.col("block_y")) & (F.col("label_x") != F.col("label_y")) & enough)
    no = F.lit(False)
    pairs = met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", no.alias("a_led"), no.alias("b_led"))


def links(docs: DataFrame, text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(a, b, similarity): verified links between nodes of different texts, a < b; each class is connected by them."""
    spark = docs.sparkSession
    small_batches(spark)
    levels = spark.sparkContext.broadcast(frequencies(docs, text, width))
    nodes = stored(_buckets(docs, text, levels, width, rows, bands).dropDuplicates(["node"]), "signatures")
    shared = nodes.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    central = spread_join(nodes.select("node", F.explode("keys").alias("bucket")), shared, "bucket").groupBy("node").agg(F.sum("n").alias("central"))
    state = narrow(nodes.join(central, "node").select("node", "keys", "central", "common", F.lit(True).alias("open"), F.lit(False).alias("led")))
    # Of equal texts, one row is fetched.
    ids = docs.select(_node(text).alias("node"), "doc_id").groupBy("node").agg(F.min("doc_id").alias("first"))
    wanted = state.select("node").join(ids, "node").select(F.col("node").alias("w"), "first")
    texts = docs.select(_node(text).alias("node"), "doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = stored(
        texts.join(wanted, (F.col("node") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("node", "text").dropDuplicates(["node"]),
        "texts",
    )
    tested = unled = None
    for step in range(min(bands, REFINEMENTS)):
        finer = [F.xxhash64(F.lit(b), *(F.get("keys", F.lit((b + i) % bands)) for i in range(step + 1))) for b in range(bands)]
        members = state.select("node", "central", "common", "open", "led", F.explode(F.array(*finer)).alias("bucket"))
        top = F.struct((~F.col("led")).alias("fresh"), "central", "common", "node")
        of_class = [F.max(F.when(F.pmod("node", F.lit(LEADERS)) == c, top))["node"].alias(f"l{c}") for c in range(LEADERS)]
        lead = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open"), *of_class).where("n > 1 and any_open")
        lead = narrow(lead.select("bucket", "n", F.array_compact(F.array(*(f"l{c}" for c in range(LEADERS)))).alias("leaders")))
        compared = spread_join(members.where("open").select("node", "bucket"), lead, "bucket").select("node", F.explode("leaders").alias("leader")).where("node <> leader")
        if unled is None:
            unled = stored(spread_join(members, lead.where("n > 2"), "bucket").where(~F.array_contains("leaders", F.col("node"))).select("node", "bucket"), "unled")
        low = F.least("node", "leader")
        pairs = compared.groupBy(low.alias("a"), F.greatest("node", "leader").alias("b")).agg(F.max(F.col("leader") == low).alias("a_led"), F.max(F.col("leader") != low).alias("b_led"))
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        results = stored(_similarities(pairs, texts, levels, width), "similarities")
        tested = results if tested is None else tested.unionByName(results)
        if step == min(bands, REFINEMENTS) - 1 or results.isEmpty():
            break
        alike = F.col("similarity") >= similarity
        marks = results.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("a_led").alias("did"), alike.alias("linked")), F.struct(F.col("b").alias("k"), F.col("b_led").alias("did"), alike.alias("linked")))).alias("m"))
        marks = marks.groupBy("m.k").agg(F.max("m.did").alias("did"), F.max("m.linked").alias("linked"))
        state = state.join(marks, F.col("node") == F.col("k"), "left")
        state = narrow(state.select("node", "keys", "central", "common", (F.col("open") & ~F.coalesce("linked", F.lit(False))).alias("open"), (F.col("led") | F.coalesce("did", F.lit(False))).alias("led")))
    pairs = _left_over(state, unled, texts, tested, levels, width, similarity)
    tested = tested.unionByName(stored(_similarities(pairs, texts, levels, width), "similarities"))
    return tested.where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by passing on least labels and jumping to their labels."""
    both = narrow(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")))
    spark, since = edges.sparkSession, stored_so_far()
    # n: how many links ask for the label of a node.
    labels = narrow(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"), F.count(F.lit(1)).alias("n")).select("node", F.least("node", "near").alias("label"), "n"))
    while True:
        offered = spread_join(both, labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "label", F.lit(0).cast("long").alias("n"))
        near = narrow(labels.union(offered).groupBy("node").agg(F.min("label").alias("label"), F.max("n").alias("n")))
        asked = near.groupBy(F.col("label").alias("at")).agg(F.count(F.lit(1)).alias("asked"))
        jump = asked.join(near, F.col("at") == F.col("node")).select(F.col("at").alias("label"), F.col("label").alias("further"), F.col("asked"))
        new = narrow(spread_join(near, jump, "label", "asked").select("node", F.col("further").alias("label"), "n"))
        changed = new.join(labels.select(F.col("node").alias("o"), F.col("label").alias("old")), F.col("node") == F.col("o")).where("label <> old")
        if changed.isEmpty():
            return new.select("node", "label")
        release(spark, since)
        labels = new


def classes(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """(node, class_node, class_id, least, copies) of every distinct text."""
    label = components(links(docs, text, **options))
    nodes = docs.select(_node(text).alias("node"), "doc_id").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    labelled = narrow(nodes.join(label, "node", "left").withColumn("class_node", F.coalesce("label", "node")).drop("label"))
    ids = labelled.groupBy("class_node").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    return narrow(spread_join(labelled, ids, "class_node", "texts").select("node", "class_node", "class_id", "least", "copies"))


def near_classes(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id and class_id."""
    of_text = classes(docs, text, **options)
    rows = docs.select("doc_id", _node(text).alias("node"))
    return spread_join(rows, of_text.select("node", "class_id", "copies"), "node", "copies").select("doc_id", "class_id")


def near_dedup(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One document of each class: the one of least id, nulls last."""
    of_text = classes(docs, text, **options)
    best = of_text.groupBy("class_node").agg(F.min(F.struct(F.col("least").isNull(), F.col("least").alias("least"), F.col("node").alias("node"))).alias("best"))
    n, best_node, best_id = fresh(docs, "node", "best_node", "best_id")
    best = best.select(F.col("best.node").alias(best_node), F.col("best.least").alias(best_id))
    keyed = docs.withColumn(n, _node(text))
    kept = keyed.join(best, (F.col(n) == F.col(best_node)) & F.col("doc_id").eqNullSafe(F.col(best_id)), "left_semi")
    return kept.dropDuplicates(["doc_id", n]).select(*docs.columns)
