"""MinHash near-duplicate detection: one-permutation hashing, star candidates.

1. A text's set of five-word shingles is hashed once; the top bits of a hash name
   its bin, and each bin keeps its least hash. Empty bins borrow from a full one by
   a fixed random order of their own (optimal densification).
2. Equal sets fall into one class, whose first row stands for it.
3. Bands of a few bins make buckets. In a bucket only the star from one centre to the
   other members is a candidate. The centre is the member that meets most others in
   all its buckets, which in a group of edited copies is their source. Candidates
   are confirmed on the full sets, and confirmed links give components.
4. A star can miss a link between two members that both differ from the centre. So the
   members of buckets that still hold several components are joined once more, by an
   exact prefix filter: shingles are ordered by the number of these members that have
   them, and two sets as alike as asked for share one of their ``n - ceil(limit * n) + 1``
   rarest. Only members of different components that share such a shingle, whose sizes
   allow it and whose common shingle stands early enough, are pairs, and all are
   confirmed on the full sets. What many texts share, a template or a passage, comes last
   in that order and makes no pairs.

Bands have five bins from a limit of 0.85 on, four below: a pair at 0.85 meets in
no bucket of 25 with a probability of 4e-7, one at 0.8 in none of 32 with 5e-8 (for
sets that fill the bins; of sets of 5 to 40 shingles the tests measure the recall).
Copies, common bands and common components are collapsed before the next step; nothing
is capped.

Defined cases: null, empty and white-space texts have the empty set and link with
nothing; a text of one to four words has one shingle; rows that repeat an id are
rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.components import components

WORDS = 5
BINS = 128
LAST = (1 << 63) - 1
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: spreads 64-bit integers."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def chained(columns: list[np.ndarray], seed: int) -> np.ndarray:
    """An order-sensitive hash of some columns of hashes."""
    h = np.full(len(columns[0]), seed, U)
    for c in columns:
        h = mixed(h * U(0x9E3779B97F4A7C15) + c)
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in a row, and the bounds of each text's."""
    import xxhash

    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    coded = pc.dictionary_encode(flat)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], U)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    word = hashes[coded.indices.to_numpy()[full]] if len(flat) else np.zeros(0, U)
    return word, np.concatenate([[0], np.cumsum(full)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def _long_set(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The set of a single long text, part by part; a part begins with the last words
    of the one before."""
    tail, found = np.zeros(0, U), []
    for part in common.parts(texts):
        word = np.concatenate([tail, word_hashes(pc.ascii_lower(part))[0]])
        many = len(word) - WORDS + 1
        if many > 0:
            found.append(np.unique(chained([word[i : i + many] for i in range(WORDS)], WORDS)))
        tail = word[-(WORDS - 1) :]
    if not found and len(tail):  # fewer words than a shingle
        found = [chained([tail[i : i + 1] for i in range(len(tail))], len(tail))]
    h = np.unique(np.concatenate(found)) if found else np.zeros(0, U)
    return h, np.array([0, len(h)])


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, rising within each text,
    and the bounds of each text's."""
    if common.is_long(texts):
        return _long_set(texts)
    word, bounds = word_hashes(pc.ascii_lower(texts))
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    many = max(0, len(word) - WORDS + 1)
    inside = doc[:many] == doc[WORDS - 1 :]
    h = chained([word[i : i + many][inside] for i in range(WORDS)], WORDS)
    owner = doc[:many][inside]
    for size in range(1, WORDS):  # texts of fewer words
        short = np.flatnonzero(n == size)
        h = np.concatenate([h, chained([word[bounds[short] + i] for i in range(size)], size)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def _orders() -> np.ndarray:
    rng = np.random.default_rng(128)
    return np.array([rng.permutation(BINS) for _ in range(BINS)])


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One least hash a bin for each set, empty bins filled from the first full bin
    of their own order. Empty sets have all bins 0."""
    docs = len(bounds) - 1
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    slot = owner * BINS + (h >> U(64 - 7)).astype(np.int64)
    least = np.ones(len(slot), bool)
    least[1:] = slot[1:] != slot[:-1]
    sig, full = np.zeros(docs * BINS, U), np.zeros(docs * BINS, bool)
    sig[slot[least]], full[slot[least]] = h[least], True
    sig, full = sig.reshape(docs, BINS), full.reshape(docs, BINS)
    orders = _orders()
    doc, gap = np.nonzero(~full & full.any(1)[:, None])
    for turn in range(BINS):
        donor = orders[gap, turn]
        found = full[doc, donor]
        sig[doc[found], gap[found]] = sig[doc[found], donor[found]]
        doc, gap = doc[~found], gap[~found]
        if not len(doc):
            break
    return sig


def bins_per_band(percent: int) -> int:
    return 5 if percent >= 85 else 4


def band_keys(sig: np.ndarray, bins: int) -> np.ndarray:
    return np.column_stack([chained([sig[:, b * bins + i] for i in range(bins)], 1000 + b) for b in range(BINS // bins)]).view(np.int64)


def set_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, together 128 bits that stand for the set."""
    total = lambda x: np.diff(np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])[bounds]).view(np.int64)
    return total(h), total(mixed(h ^ U(0x5851F42D4C957F2D)))


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), common.text_or_empty().alias("text"))
    return rows.withColumn("tx", F.xxhash64("text"))


def _described(docs: DataFrame, bins: int) -> DataFrame:
    """A written table with one row for each of ``docs``: row (its number), doc, tx
    (hash of the text), n, s1, s2 (size and hash of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in common.by_bytes(batch):
                h, bounds = shingle_sets(common.strings(part.column("text")))
                sig, (s1, s2) = signatures(h, bounds), set_hashes(h, bounds)
                count = len(bounds) - 1
                keys = band_keys(sig, bins)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + count)), part.column("doc"), part.column("tx"), *map(pa.array, (np.diff(bounds), s1, s2)), bands],
                    names=["row", "doc", "tx", "n", "s1", "s2", "bands"],
                )
                row += count

    return common.staged(common.map_arrow(_texts(docs), run, "row long, doc long, tx long, n long, s1 long, s2 long, bands array<long>"), "minhash-rows")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A written table (row, set) of the shingle sets of ``wanted (row, doc, tx)``,
    hashed again from the texts. Rows that repeat id and text repeat the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch):
                h, bounds = shingle_sets(common.strings(part.column("text")))
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("row"), sets], names=["row", "set"])

    return common.staged(common.map_arrow(_texts(docs).join(wanted, ["doc", "tx"]), run, "row long, set array<long>"), "minhash-sets")


def _similar(a: str, b: str, percent: int) -> str:
    """SQL: the sets share ``percent`` of their union; sizes are looked at first."""
    both = f"size(array_intersect({a}, {b}))"
    return f"100 * least(size({a}), size({b})) >= {percent} * greatest(size({a}), size({b})) AND (100 + {percent}) * {both} >= {percent} * (size({a}) + size({b}))"


def _star_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    met = buckets.groupBy("row").agg(F.sum("c").alias("met"))
    centre = buckets.join(met, "row").groupBy("key").agg(F.max(F.struct("met", (-F.col("row")).alias("r"))).alias("top")).select("key", (-F.col("top.r")).alias("a"))
    star = buckets.join(centre, "key").filter("row != a").select("a", F.col("row").alias("b")).distinct()
    pairs = star.join(sets.select(F.col("row").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("sb")), "b")
    return common.staged(pairs.filter(_similar("sa", "sb", percent)).select("a", "b"), "minhash-links", small=True)


def _open_rows(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """A written table (row, label) of the members of buckets with several components."""
    members = buckets.select("key", "row").join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    open_keys = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    return common.staged(members.join(open_keys, "key").select("row", "label").distinct(), "minhash-open", small=True)


def _prefixes(sets: DataFrame, open_rows: DataFrame, percent: int) -> DataFrame:
    """A written table (token, row, label, n, left): of each open row the rarest shingles
    that a set as alike as asked for can't all lack, as far as another row has them too;
    ``left`` counts the shingles from this one on in the order of rarity."""
    own = sets.join(open_rows, "row")
    tokens = own.select("row", F.explode("set").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    ordered = tokens.join(shared, "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rows", "token"))).alias("shared"))
    sized = ordered.join(own.select("row", "label", F.size("set").alias("n")), "row")
    # Shingles of one row alone are the rarest; they fill the prefix first.
    alone = F.col("n") - F.size("shared")
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    first = F.slice("shared", 1, F.greatest(F.lit(0), prefix - alone))
    spots = sized.select("row", "label", "n", alone.alias("alone"), F.posexplode(first).alias("at", "t"))
    return common.staged(spots.select("t.token", "row", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left")), "minhash-prefixes")


def _prefix_links(sets: DataFrame, open_rows: DataFrame, percent: int) -> DataFrame:
    """Links between open rows of different components, all of them."""
    spots = _prefixes(sets, open_rows, percent)
    one, two = (spots.select("token", *[F.col(c).alias(c + x) for c in ("row", "label", "n", "left")]) for x in "ab")
    met = one.join(two, "token").filter(
        f"rowa < rowb AND labela != labelb AND 100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * least(lefta, leftb) >= {percent} * (na + nb)"
    )
    pairs = met.select(F.col("rowa").alias("a"), F.col("rowb").alias("b")).distinct()
    full = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("sb")), "b")
    return common.staged(full.filter(_similar("sa", "sb", percent)).select("a", "b"), "minhash-links", small=True)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row of ``docs (doc_id, text)``: doc_id, n_shingles, component_id (least
    id of those reachable over links, its own included) and kept (it is that id).

    Two documents are linked if their sets share ``percent`` of their union.
    """
    rows = _described(docs, bins_per_band(percent))
    classes = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("rep"))
    known = rows.join(classes, ["n", "s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "row"))
    is_rep = F.col("row") == F.col("rep")
    known = common.staged(known.withColumn("bands", F.when(is_rep, F.col("bands"))), "minhash-classes")
    reps = known.filter(is_rep & (F.col("n") > 0))

    banded = reps.select("row", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = common.staged(banded.join(shared, "key"), "minhash-buckets", small=True)
    wanted = reps.select("row", "doc", "tx").join(buckets.select("row").distinct(), "row")
    sets = _full_sets(docs, wanted)
    links = _star_links(buckets, sets, percent)
    labels = components(links)
    more = _prefix_links(sets, _open_rows(buckets, labels), percent)
    if not more.isEmpty():
        labels = components(links.unionAll(more))

    placed = known.select("row", "doc", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = placed.groupBy("label").agg(F.min("doc").alias("least"))
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return placed.join(least, "label").select(
        back("doc").alias("doc_id"), F.col("n").alias("n_shingles"), back("least").alias("component_id"), (F.col("doc") == F.col("least")).alias("kept")
    )
