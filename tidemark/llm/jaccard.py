"""N-gram Jaccard join by token-combination prefixes, and the groups it links.

A document's tokens are its distinct n-word shingles, as 64-bit hashes of their
words' hashes. Tokens are ordered rare first, frequent ones last. A set's prefix
is as short as can be so that another set similar enough can't miss all of its
keys, if at most ``missing`` tokens of the set are not in the other (missing =
size less the least possible overlap):

* a rare token is a key by itself, and one missing token takes it away;
* frequent tokens are dealt into classes by hash, and each two tokens of a class
  that are both in the prefix are a key. Of a class's m prefix tokens, m - 1 have
  to be missing before no two are left, so a class counts m - 1.

The prefix is extended until these counts exceed ``missing``. Then of the two
prefixes the one that ends first (in the common order) has a key whose tokens
are all in the other set, and so in its prefix. Rare tokens come first, then
classes one after the other. Classes are
counted for two neighbouring size ranges, half as many as the smallest set has
tokens, so that sets on either side of a border meet, and so that a whole set
always suffices for its prefix.

Which tokens count as frequent only decides the cost: any choice finds every
link. The filter that tells them has a bounded size; where the corpus has more
tokens than it can tell apart, more count as frequent, and keys become pairs of
tokens, which are no less selective.

Keys shared by sets give candidates. Histograms of their hashes bound what two
sets can have in common, and rule most false ones out; the similarity of the
others is computed on the tokens. A key may be shared by very many sets, so not every
pair of its sets is tried: first each against the smallest id, then in a few
rounds against a random one. Sets in different components that still share a key
with many others then meet by larger combinations instead: all tokens of each set
are dealt into classes, one more than two similar sets can differ in tokens, so that
one class at least is the same in both. After as many rounds, the pairs are tried whose two
sets still lie in different components, which alone can change the result, less
those whose parities differ in too many places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_join, scratch, stored
from .components import components
from .membership import Bits, filter_of, mixed

#: A token is frequent from so many documents on.
FREQUENT = 12
#: 64-bit words of the parities.
PARITY_WORDS = 16
#: Rounds that try each key's sets against one of them, and again after keys of many sets are refined.
ROUNDS = 3
#: Sets of one key up to which all of their pairs may be tried.
FEW = 32
#: Rows of one set from which on they are dealt to several tasks.
COPIES = 1000
#: Tokens that a task counts at a time, at least and at most.
COUNTED, COUNTED_AT_MOST = 3_000_000, 16_000_000
#: Words remembered by a Python worker before it starts afresh.
CACHE_WORDS = 400_000
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


class _WordIds(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_ids = _WordIds()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; of fewer words, the whole sequence as one; none without words."""
    words = (text or "").encode().lower().split()  # bytes: of ASCII letters and blanks only
    if len(_ids) > CACHE_WORDS:
        _ids.clear()
    ids = np.fromiter(map(_ids.__getitem__, words), np.uint64, len(words))
    if not len(ids):
        return ids
    width = min(n, len(ids))
    count = len(ids) - width + 1
    h = np.full(count, width, np.uint64)
    for i in range(width):
        h = (h ^ ids[i : i + count]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    h = mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def histogram(tokens: np.ndarray) -> np.ndarray:
    """Tokens by the leading bits of their hash, about four to a place."""
    log2 = max(3, (len(tokens) // 4).bit_length())
    return np.bincount((mixed(tokens) >> np.uint64(64 - log2)).astype(np.int64), minlength=1 << log2).astype(np.uint16)


def may_be_similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """False only where the histograms of two sets leave too little in common."""
    if len(p) > len(q):
        p, q = q, p
    q = q.reshape(len(p), -1).sum(axis=1)
    most = int(np.minimum(p, q).sum())
    return 100 * most >= percent * (int(p.sum()) + int(q.sum()) - most)


def most_apart(n: int, m: int, percent: int) -> int:
    """Largest symmetric difference of sets of n and m tokens whose similarity is percent / 100 or more."""
    return (100 - percent) * (n + m) // (100 + percent)


def size_range(n: int, percent: int) -> int:
    """Ranges of sizes, such that similar sets are in the same or in neighbouring ones."""
    return int(math.log(n) / -math.log(percent / 100) + 1e-9)


def _salt(r: int) -> np.uint64:
    return np.uint64((r + 3) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)


def combinations(tokens: np.ndarray, frequent: np.ndarray, r: int, percent: int) -> np.ndarray:
    """Keys of the frequent tokens in the prefix, when classes are counted for the size ranges r and r + 1."""
    missing = len(tokens) - -(-percent * len(tokens) // 100)
    common = tokens[frequent]
    rare = len(tokens) - len(common)
    least = int((percent / 100) ** -r + 1e-9)
    count = max(1, min(least // 2, -(-percent * least // 100) - 1))
    dealt = mixed(common ^ _salt(r))
    of = dealt % np.uint64(count)
    order = np.lexsort((dealt, of))
    of, dealt = of[order], dealt[order]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    # A class's first token adds nothing to the count, each further one adds one.
    enough = np.searchsorted(np.cumsum(~first), missing + 1 - rare) + 1
    of, dealt, first = of[:enough], dealt[:enough], first[:enough]
    keys, apart, starts = [], 1, np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    while True:
        later = np.flatnonzero(np.arange(len(of)) - starts >= apart)
        if not len(later):
            break
        keys.append(mixed(dealt[later - apart] + mixed(dealt[later] ^ _salt(r + 1))))
        apart += 1
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def keys_of(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set. frequent: which of its (sorted) tokens are. None of a single token, to which only an equal set is similar."""
    n = len(tokens)
    prefix = n - -(-percent * n // 100) + 1
    if n == 1:
        return np.empty(0, np.uint64)
    rare = tokens[~frequent]
    if len(rare) >= prefix:
        return rare[:prefix]
    own = size_range(n, percent)
    return np.unique(np.concatenate([rare, *(combinations(tokens, frequent, r, percent) for r in (own - 1, own))]))


def class_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of all classes of a set, one class more than two similar sets differ in tokens; classes are counted for two neighbouring size ranges."""
    own, keys = size_range(len(tokens), percent), []
    for r in (own - 1, own):
        top = math.ceil((percent / 100) ** -(r + 2)) + 1
        count, salt = most_apart(top, top, percent) + 1, _salt(r)
        dealt = mixed(tokens ^ salt)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, (dealt % np.uint64(count)).astype(np.int64), mixed(dealt + np.uint64(1)))
        keys.append(mixed(sums ^ mixed(np.arange(count, dtype=np.uint64) + salt)))
    return np.unique(np.concatenate(keys))


def _frequent_filter(docs: DataFrame, n: int) -> tuple[int, bytes, int]:
    """The tokens of FREQUENT documents or more, counted over all. Tasks deal their tokens out by range, as 32 bits each, so that counting takes one compact shuffle; the few that share these bits count together."""
    bytes_read = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = max(4, (bytes_read // (32 << 20)).bit_length())
    at_once = min(max(COUNTED, 64 << log2), COUNTED_AT_MOST)
    shift = np.uint64(64 - log2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            held.clear()
            part = (tokens >> shift).astype(np.int32)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            low = ((tokens << np.uint64(log2)) >> np.uint64(32)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([x.tobytes() for x in np.split(low, first[1:])], pa.binary())], names=["part", "tokens"])

        size = 0
        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py(), n))
                size += len(held[-1])
                if size >= at_once:
                    yield dealt()
                    size = 0
        if size:
            yield dealt()

    def often(rows: pa.Table) -> pa.Table:
        part = np.uint64(rows.column("part")[0].as_py())
        low, counts = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("tokens")]), return_counts=True)
        high = low[counts >= FREQUENT].astype(np.uint64)
        return pa.table({"token": ((part << np.uint64(32)) | high).view(np.int64)})

    counted = docs.select("text").mapInArrow(deal, "part int, tokens binary").groupBy("part").applyInArrow(often, "token long")
    return *filter_of(stored(counted), "token"), log2


def is_frequent(tokens: np.ndarray, bits: Bits, log2: int) -> np.ndarray:
    return bits.has(((tokens >> np.uint64(64 - log2)) << np.uint64(32)) | ((tokens << np.uint64(log2)) >> np.uint64(32)))


def parities(tokens: np.ndarray) -> np.ndarray:
    """PARITY_WORDS * 64 bits: by place, whether the number of tokens there is odd. Two sets' parities differ in no more places than their symmetric difference has tokens."""
    places = mixed(tokens ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(64 * PARITY_WORDS)
    odd = np.bincount(places.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _profiles(docs: DataFrame, n: int, percent: int, frequent: tuple[int, bytes, int]) -> DataFrame:
    """For each document: size, fingerprint, histogram and parities of its set, and index keys."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log2, data, token_log2 = shared.value
        bits = Bits(log2, data)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                sizes, prints, places, odd, keys, ends = [], [], [], [], [], [0]
                for t in piece.column(1):
                    s = shingles(t.as_py(), n)
                    sizes.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                    places.append(histogram(s).tobytes())
                    odd.append(parities(s))
                    k = keys_of(s, is_frequent(s, bits, token_log2), percent) if len(s) else s
                    keys.append(k)
                    ends.append(ends[-1] + len(k))
                flat = pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64))
                columns = [piece.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(places, pa.binary()), pa.array(odd, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print", "places", "odd", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, print binary, places binary, odd array<long>, keys array<long>")


def _shared_keys(profiles: DataFrame) -> DataFrame:
    """Keys of more than one row. Tasks deal their keys out by range, each at most twice, so that a range holds few whatever the keys' frequency."""
    total = profiles.agg(F.sum(F.size("keys"))).first()[0] or 0
    log2 = max(4, (total // 500_000).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            held.clear()
            twice = np.concatenate([[True, True], keys[2:] != keys[:-2]])[: len(keys)]
            keys = keys[twice]
            part = (keys >> np.uint64(64 - log2)).astype(np.int32)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([x.tobytes() for x in np.split(keys, first[1:])], pa.binary())], names=["part", "keys"])

        size = 0
        for b in batches:
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= COUNTED:
                yield dealt()
                size = 0
        if size:
            yield dealt()

    def meet(rows: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("keys")]))
        return pa.table({"key": np.unique(keys[1:][keys[1:] == keys[:-1]]).view(np.int64)})

    return profiles.select("keys").mapInArrow(deal, "part int, keys binary").groupBy("part").applyInArrow(meet, "key long")


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their histograms don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_be_similar(np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(y.as_buffer(), np.uint16).astype(np.int64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = sets.select("set_id", "places")
    both = pairs.join(own.select(F.col("set_id").alias("b"), F.col("places").alias("y")), "b").join(own.select(F.col("set_id").alias("a"), F.col("places").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _tokens(docs: DataFrame, ids: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """set_id and ``tokens`` of the sets in ``ids``, from the texts of their documents."""
    wanted = stored(sets.select("set_id", "doc_id", "print").join(ids.distinct(), "set_id", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(*shared.value)
        for batch in batches:
            batch = batch.filter(pa.array(known.has(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            for start in range(0, batch.num_rows, 100):
                piece = batch.slice(start, 100)
                made = [shingles(t.as_py(), n).tobytes() for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in made], pa.binary()), pa.array(made, pa.binary())], names=["doc_id", "print", "tokens"])

    made = docs.where("doc_id is not null").mapInArrow(run, "doc_id long, print binary, tokens binary")
    return stored(made.join(wanted, ["doc_id", "print"]).select("set_id", "tokens").dropDuplicates(["set_id"]))


def _verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    tokens = _tokens(docs, pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")), sets, n)
    both = pairs.join(tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("y")), "b").join(tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def _refined(docs: DataFrame, rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The index rows, with the keys of many sets replaced by the classes that such sets share."""
    many = stored(rows.groupBy("key").count().where(F.col("count") > FEW).select("key"))
    few = rows.join(many, "key", "left_anti")
    crowded = stored(rows.join(many, "key", "left_semi"))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [class_keys(np.frombuffer(x.as_buffer(), np.uint64), percent) for x in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["set_id", "parts"])

    parts = stored(_tokens(docs, crowded.select("set_id"), sets, n).mapInArrow(classes, "set_id long, parts array<long>").select("set_id", F.explode("parts").alias("part")))
    # Only classes that sets of two components share.
    placed = parts.join(crowded.groupBy("set_id").agg(F.min("component").alias("component")), "set_id")
    met = stored(placed.groupBy("part").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("part"))
    one = crowded.select("set_id", "n", "component").distinct()
    finer = parts.join(met, "part", "left_semi").join(one, "set_id").withColumnRenamed("part", "key")
    return few.select(*rows.columns).union(finer.select(*rows.columns))


def _remaining(rows: DataFrame, sets: DataFrame, near: Column, percent: int) -> DataFrame:
    """Pairs of sets that share a key, lie in different components, and whose parities allow them to be similar."""
    rows = stored(rows.join(sets.select("set_id", *[F.col("odd")[i].alias(f"x{i}") for i in range(PARITY_WORDS)]), "set_id"))
    other = rows.select("key", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(PARITY_WORDS)])
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    allowed = apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    return rows.join(other, "key").where(near & (F.col("set_id") < F.col("b")) & (F.col("component") != F.col("other")) & allowed).select(F.col("set_id").alias("a"), "b").distinct()


def _of_sets(docs: DataFrame, profiles: DataFrame, n: int, percent: int) -> DataFrame:
    """``print``, ``n_shingles``, ``copies`` and ``component_id`` of each distinct set."""
    spark, of = docs.sparkSession, ["print", "n_shingles"]
    real = profiles.where("doc_id is not null and n_shingles > 0")
    # Equal sets are one node, told by its place in this table, which is written once.
    nodes = stored(real.groupBy(*of).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("set_id", F.monotonically_increasing_id()))
    one = real.join(nodes.drop("copies"), ["doc_id", *of]).dropDuplicates(["set_id"])
    sets = stored(one.select("set_id", "doc_id", "print", F.col("n_shingles").cast("int").alias("n"), "places", "odd", "keys"))
    shared_keys = stored(_shared_keys(sets))
    bits = spark.sparkContext.broadcast(filter_of(shared_keys, "key"))
    drop(shared_keys)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(*bits.value)
        for batch in batches:
            keys = batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy(zero_copy_only=False))
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            keep = known.has(flat.view(np.uint64)) if len(flat) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[keep])), batch.column(1).take(pa.array(rows[keep])), pa.array(flat[keep])], names=["set_id", "n", "key"])

    rest = stored(sets.select("set_id", "n", "keys").mapInArrow(postings, "set_id long, n int, key long").withColumn("component", F.col("set_id")))
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent

    def stars(rows: DataFrame, turn: int) -> DataFrame:
        """Each key's sets against one of them: that with the smallest id, or in later rounds a random one (but not those of its component)."""
        pick = F.min(F.struct("set_id", "n", "component")) if turn == 0 else F.min_by(F.struct("set_id", "n", "component"), F.xxhash64("set_id", F.lit(turn)))
        centres = rows.groupBy("key").agg(pick.alias("c")).select("key", F.col("c.set_id").alias("centre"), F.col("c.n").alias("m"), F.col("c.component").alias("other"))
        pairs = rows.join(centres, "key").where(near & (F.col("component") != F.col("other")))
        return pairs.select(F.least("set_id", "centre").alias("a"), F.greatest("set_id", "centre").alias("b")).distinct()

    # Sets of one document id are linked, whatever they hold.
    ids = real.select("doc_id", *of).distinct()
    twice = stored(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    own = ids.join(twice, "doc_id", "left_semi").join(nodes.select("set_id", *of), of)
    first = own.groupBy("doc_id").agg(F.min("set_id").alias("a"))
    links = stored(own.join(first, "doc_id").where("a <> set_id").select("a", F.col("set_id").alias("b")).distinct())
    tried = None
    for turn in range(2 * ROUNDS + 1):
        if turn == ROUNDS:
            spent = rest
            with scratch(spark) as keep:
                rest = keep(_refined(docs, rest, sets, n, percent))
            drop(spent)
        with scratch(spark) as keep:
            pairs = stars(rest, turn % ROUNDS) if turn < 2 * ROUNDS else _remaining(rest, sets, near, percent)
            new = keep(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = new if tried is None else tried.union(new)
        plausible = stored(_plausible(new, sets, percent))
        if plausible.limit(1).count():
            spent = links
            with scratch(spark) as keep:
                links = keep(links.union(_verified(docs, plausible, sets, n, percent)))
            drop(spent)
        drop(plausible)
        if turn == 2 * ROUNDS:
            break
        labels = components(links)
        placed = rest.drop("component").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        # A key is done with once all its sets are in one component, or there were only two.
        left = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("key")
        spent, rest = rest, stored(placed.join(left, "key", "left_semi"))
        drop(spent)
        if not rest.limit(1).count():
            break
    labels = components(links)
    placed = nodes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "component").select(*of, "component_id", "copies")


def group(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``.

    Two documents link when 100 * intersection >= percent * union of their sets
    of n-word shingles; component_id is the smallest id that links reach, the
    document's own included. Without words a document links with nothing (but
    its id may be that of a row with words). A row with a null id has a null
    component; rows with the same id count as linked. ``percent`` is above 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of = ["print", "n_shingles"]
    with scratch(df.sparkSession) as keep:
        profiles = stored(_profiles(docs, n, percent, _frequent_filter(docs, n)))
        told = keep(profiles.select("doc_id", *of))
        of_set = keep(_of_sets(docs, profiles, n, percent))
    real = told.where("doc_id is not null and n_shingles > 0")
    rows = hot_join(real.select("doc_id", *of), of_set.drop("copies"), of, of_set.where(F.col("copies") >= COPIES).select(*of), ["doc_id"]).select("doc_id", "n_shingles", "component_id")
    alone = told.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles")
    # A row without words belongs with the other rows of its id, if any.
    of_id = stored(rows.join(alone.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    return rows.union(alone.join(of_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id")))
