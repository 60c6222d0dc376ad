"""Operator 8: near duplicates by SimHash fingerprints and multi-index hashing.

Two uses:

* ``fingerprint_components``: 64-bit fingerprints of k-word shingles, linked at ``radius`` (2) or fewer differing bits, and
  their connected components. Exact.
* ``near_duplicates``: groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts
  that the fingerprints link are grouped first, if their sets bear it out. Texts of that similarity may differ in far
  more than two bits, and no fingerprint of fixed width finds all of them, so an exact check of all texts follows, whose
  candidates come from the shingles themselves; it compares no two texts that are in one group by then. Exact.

The first cuts a fingerprint into segments, enumerates the Hamming ball of radius 1 within each, fetches what the table
of that segment holds there, and verifies the complete distance. Two values that differ in one bit are met from one side
only: the one that has the bit set looks for the other.

The second is a prefix filter: with all shingles in one fixed order, two sets of similarity s share one of the first
n - ceil(s n) + 1 shingles of each (n its size). Shingles that are frequent in a sample come last in that order, which
any order may: it only keeps boilerplate out of the prefixes. What meets is thinned by bounds that lose nothing: the
sizes, the places of the shingle in both orders (all before it is not shared), and sketches of the parity of shingles in
each bucket, which differ in no more bits than the sets in shingles.

Very common values (groups of near copies share them) would give all pairs of a group. They are handled apart: for
fingerprints by their own radius-1 balls, whose centres any two fingerprints within 2 bits share, which links a group of
n with at most 65 n rows; for shingles by dividing them by the sizes of both sides, and linking members to a few central
ones, in rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded, discard, id_and_text, materialize, pieces, rows_of, schema, text_sizes, tidy

SEED = 42
#: A segment value or shingle that more fingerprints or texts share than this is handled by the way for common values.
COMMON = 32


def _power(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _bit(name: str, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col(name), i).bitwiseAND(F.lit(1))


def word_shingles(text: bytes, k: int) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space, k joined by a space, repeats included; fewer words: all of them."""
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned 64-bit ``hashes``."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes), bitorder="little").tobytes(), "little")


def simhash64(text: bytes, k: int = 3) -> int:
    """Zero for a text without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    shingles = word_shingles(text, k)
    return majority_bits(np.array([digest(s, SEED) for s in shingles], dtype="<u8")) if shingles else 0


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a long (two's complement), a row for each row of ``docs``; null texts have no words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 8 << 20):
            found = np.array([simhash64(t, k) for t in rows_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, schema("doc_id long, fp long"))


def _links_within_two(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just what 2 or fewer differing bits connect. ``fps``: distinct longs ``fp``."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = materialize(fps.select("fp", F.posexplode(F.array(low, high)).alias("part", "value")), "simhash-halves")
    sizes = halves.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    common = sizes.where(F.col("n") > COMMON).select("part", "value")
    # the ball from the side that has the bit set: the value itself, and the value with each of its set bits cleared
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: _bit("value", i) == 1)
    ball = F.concat(F.array("value"), F.transform(bits, lambda i: F.col("value") - _power(i)))
    probes = halves.select(F.col("fp").alias("a"), "part", F.explode(ball).alias("value"))
    met = common.withColumn("many", F.lit(True))
    rare = halves.join(met, ["part", "value"], "left_anti").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = probes.join(rare, ["part", "value"]).where(near & (F.col("a") != F.col("b"))).select("a", "b")
    # whoever is in, or looks into, a common value is linked by the centres of its own ball in all 64 bits
    touched = probes.join(common, ["part", "value"], "left_semi").select(F.col("a").alias("fp")).distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_power(i)))
    centres = touched.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("centre"))
    first = centres.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("other")).where(F.col("b") != F.col("other"))
    stars = centres.join(first.select("centre", "b"), "centre").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(stars.distinct())


def fingerprint_components(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over 2 or fewer differing bits.

    Texts without words (null ones too) have fingerprint zero and are linked like any other. Repeated rows count each;
    rows whose doc_id is null have a component_id only if a row with one is reachable. An empty table gives no rows.
    """
    found = materialize(fingerprints(docs, k), "simhash-fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(nodes.select(F.col("fp").alias("node")), _links_within_two(nodes.select("fp")))
    members = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    whole = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(whole, "root").select("fp", "component_id")
    out = found.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates

#: Buckets of a parity sketch, and of the one folded from it that goes with every shared shingle.
SKETCH, FOLD = 1024, 256


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """The set of k-word shingles (words as in ``word_shingles``) as sorted 64-bit hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets with this Jaccard similarity, each shares one of its first so many elements with the other's."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def parity_bits(hashes: np.ndarray, buckets: int) -> list[int]:
    """Whether a bucket holds an odd number of the hashes, as longs."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _frequent(docs: DataFrame, k: int, sample_texts: int = 20_000, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most texts of a sample have, sorted, and in how many: ``most`` at the most. Only their order matters."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 2 << 20):
            found = np.concatenate([shingle_hashes(t, k) for t in rows_of(batch)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])

    share = -(-1_000_000 * sample_texts // max(1, docs.count()))
    drawn = _nodes_of(docs).where(F.pmod("node", F.lit(1_000_000)) < share).groupBy("node").agg(F.first("text").alias("text"))
    counts = drawn.select("text").mapInArrow(run, schema("key long")).groupBy("key").count().where("count > 2")
    top = counts.orderBy(F.col("count").desc(), "key").limit(most).collect()
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array([r["count"] for r in top], np.int64)[by]


def _first_shingles(h: np.ndarray, known: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set in the order of ``ranks``: shingles that aren't ``known`` come first, ties by hash."""
    rank = np.zeros(len(h), np.int64)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, ranks[at], 0)
    return h[np.lexsort((h, rank))][: prefix_length(len(h), similarity)]


def _order(docs: DataFrame, k: int, similarity: float, one_in: int = 8, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come late in the order, sorted, and their ranks.

    After the frequent ones of a sample of bounded size come those that still crowd the prefixes. Prefixes are made of one
    text in ``one_in`` to find them: of a share of the texts, so that as a table grows no more of its crowded shingles are
    missed. Only their order matters.
    """
    known, ranks = _frequent(docs, k)
    sent = docs.sparkSession.sparkContext.broadcast((known, ranks))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 4 << 20):
            keys = [_first_shingles(shingle_hashes(t, k), *sent.value, similarity).view(np.int64) for t in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    drawn = _nodes_of(docs).where(F.pmod("node", F.lit(one_in)) == 0).select("node", "text").mapInArrow(run, schema("node long, keys array<long>"))
    counts = drawn.groupBy("node").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key")).groupBy("key").count()
    top = counts.where(F.col("count") * one_in > COMMON // 2).orderBy(F.col("count").desc(), "key").limit(most).collect()
    late = {r["key"]: (1 << 32) + r["count"] for r in top}
    merged = dict(zip(known.view(np.int64).tolist(), ranks.tolist())) | late
    keys = np.array(list(merged), np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array(list(merged.values()), np.int64)[by]


def _prefixes(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, node, fp, size, keys, sketch, fold) of each row; node is a hash of the text, so equal texts are one node.

    fp: the fingerprint, as in ``fingerprints``; size: of the set of shingles; keys: its prefix, for a text without words one fixed value.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_order(docs, k, similarity))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 4 << 20):
            fps, sizes, keys, sketches, folds = [], [], [], [], []
            for t in rows_of(batch):
                fps.append(simhash64(t))
                h = shingle_hashes(t, k)
                sizes.append(len(h))
                sketches.append(parity_bits(h, SKETCH))
                folds.append(parity_bits(h, FOLD))
                keys.append(_first_shingles(h, *sent.value, similarity).view(np.int64) if len(h) else [0])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs), pa.array(folds, longs)],
                ["doc_id", "node", "fp", "size", "keys", "sketch", "fold"],
            )

    return _nodes_of(docs).mapInArrow(run, schema("doc_id long, node long, fp long, size long, keys array<long>, sketch array<long>, fold array<long>"))


def _nodes_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return id_and_text(docs).select("doc_id", F.xxhash64(text).alias("node"), text.alias("text"))


def _may_be_similar(bits: str, buckets: int, similarity: float) -> Column:
    """Whether sizes and sketches (columns ending in _a and _b) leave the similarity possible. Never false where it holds."""
    differ = sum((F.bit_count(F.col(f"{bits}_a")[i].bitwiseXOR(F.col(f"{bits}_b")[i])) for i in range(buckets // 64)), F.lit(0))
    a, b = F.col("size_a"), F.col("size_b")
    most = (a + b) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    return (F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - F.lit(1e-6)) & (differ <= most)


def _least_overlap(a: Column, b: Column, similarity: float) -> Column:
    """How many shingles two sets of these sizes share at least, if they have the similarity."""
    return F.ceil((a + b) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))


def _may_start_here(similarity: float) -> Column:
    """Whether the shingle a pair meets in can be the first one both have: what lies before it in either set is not shared."""
    least = _least_overlap(F.col("size_a"), F.col("size_b"), similarity)
    return (F.col("size_a") - F.col("pos_a") >= least) & (F.col("size_b") - F.col("pos_b") >= least) & _may_be_similar("fold", FOLD, similarity)


def _side(nodes: DataFrame, side: str, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    return nodes.select(*by, F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def _close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a < b) whose sizes and whole sketches leave the similarity possible."""
    once = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = once.join(_side(nodes, "a", "size", "sketch"), "a").join(_side(nodes, "b", "size", "sketch"), "b")
    return both.where(_may_be_similar("sketch", SKETCH, similarity)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of k-word shingles have at least this Jaccard similarity, written.

    Only texts in a pair are read again, one row of each; their hashed sets are sent, sorted, to where the pair is.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_sizes, 4 << 20):
            sets = [shingle_hashes(t, k).tobytes() for t in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):  # read in place
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "near-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least"), "node").select(F.col("node").alias("asked"), "least")
    asked = materialize(asked, "near-asked")
    rows = _nodes_of(docs)
    one = rows.join(bounded(asked), (rows["node"] == asked["asked"]) & rows["doc_id"].eqNullSafe(asked["least"]), "left_semi")
    sets = materialize(one.select("node", "text").mapInArrow(run, schema("node long, shingles binary")), "near-shingles")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    linked = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(judge, schema("a long, b long")), "near-links")
    discard(pairs, asked, sets)
    return linked


#: Where texts meet: the shingle, and for crowded ones the bands of the two sizes too (lowest band first).
_PLACE = ("key", "low", "high")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that connect what the fingerprints link: texts of one with its first, first texts of linked ones."""
    fps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    alike = nodes.select("node", "fp").join(fps, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    first = lambda side: fps.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
    linked = _links_within_two(fps.select("fp")).join(first("a"), "a").join(first("b"), "b")
    return alike.union(linked.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def _meetings(nodes: DataFrame) -> DataFrame:
    """(key, n, node, pos, size, fold, root): the prefix shingles that more than one text has, and where in each they stand."""
    flat = nodes.select("node", F.posexplode("keys").alias("pos", "key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return flat.join(shared, "key").join(nodes.select("node", "size", "fold", "root"), "node").select("key", "n", "node", "pos", "size", "fold", "root")


def _banded(crowd: DataFrame, similarity: float, ratio: float = 1.03) -> DataFrame:
    """Each member of a crowded shingle in a place for every band of sizes that a partner may have and that some member has.

    Against a partner of a given size a shingle counts only up to a certain position, so a text with many shingles of its
    own before a common one is in few places or none. Members of one band meet in that band's own place, so a place without
    any of the other band would add nothing.
    """
    size, log = F.col("size"), math.log(ratio)
    band_of = lambda n: F.floor(F.log(F.greatest(n, F.lit(1.0))) / F.lit(log)).cast("int")
    own = crowd.withColumn("band", band_of(size.cast("double")))
    present = materialize(own.groupBy("key").agg(F.collect_set("band").alias("bands")), "near-bands")
    partners = F.sequence(band_of(size * F.lit(similarity) - F.lit(1e-6)), band_of(size / F.lit(similarity)) + 1)
    smallest = lambda p: F.greatest(F.pow(F.lit(ratio), p.cast("double")) - F.lit(1e-6), size * F.lit(similarity))
    able = F.filter(F.array_intersect(partners, "bands"), lambda p: (size == 0) | (size - F.col("pos") >= _least_overlap(size, smallest(p), similarity)))
    spread = own.join(bounded(present), "key").withColumn("partner", F.explode(able))
    return spread.select("key", F.least("band", "partner").alias("low"), F.greatest("band", "partner").alias("high"), "node", "pos", "size", "fold", "root")


def _pivots(waiting: DataFrame, many: int) -> DataFrame:
    """For each place ``many`` texts with the fewest shingles of their own before the common one, as the b side of pairs.

    In a group of copies of one text, that text has none; an edited copy has some for every edit.
    """
    typical = Window.partitionBy(*_PLACE).orderBy(F.col("pos") / F.greatest("size", F.lit(1)), "node")
    first = waiting.withColumn("turn", F.row_number().over(typical)).where(F.col("turn") <= many)
    return _side(first, "b", "size", "pos", "fold", "root", by=_PLACE)


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, pivots: int = 8) -> DataFrame:
    """doc_id, group_id (smallest doc_id of the group), n_links (verified links of its text, exact copies aside; a lower bound).

    Equal texts (null is empty) are one node whatever their number. Texts without words form one group. Groups are those
    of all pairs with the similarity.

    The texts that SimHash links are compared and grouped first; the exact check goes on from their groups.

    A place (a shingle, for shingles of over ``COMMON`` prefixes with the sizes of both sides) with up to ``COMMON`` texts
    gives all its pairs. A fuller one is worked off in rounds: the ``pivots`` most typical texts are compared with all
    others; then, of the texts outside the place's largest group so far, eight times as many are compared with all that
    aren't in their own group, and so on. A text that was asked leaves the place, and a place is done when its texts are
    in one group. So no pair that could join two groups is left out. Pairs known to be in one group aren't compared, so
    ``n_links`` is a lower bound.
    """
    wide = materialize(_prefixes(docs, k, similarity), "near-prefixes")
    firsts = [F.first(c).alias(c) for c in ("fp", "size", "keys", "sketch", "fold")]
    nodes = materialize(wide.groupBy("node").agg(F.min("doc_id").alias("least"), *firsts), "near-nodes")
    links = _verified(_close(_fingerprint_pairs(nodes), nodes, similarity), docs, nodes, k, similarity)
    roots = _roots(links)
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = materialize(_meetings(grouped), "near-meetings")
    banded = materialize(_banded(met.where(F.col("n") > COMMON), similarity), "near-banded")
    places = materialize(banded.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-places")
    small, full = (banded.join(bounded(places.where(c).select(*_PLACE)), list(_PLACE)) for c in (F.col("n") <= COMMON, F.col("n") > COMMON))
    waiting = materialize(full, "near-waiting")

    def pairs(members: DataFrame, others: DataFrame, by: tuple[str, ...]) -> DataFrame:
        met = _side(members, "a", "size", "pos", "fold", "root", by=by).join(others, list(by))
        return met.where("root_a <> root_b").where(_may_start_here(similarity)).select("a", "b")

    asked = materialize(_pivots(waiting, pivots), "near-pivots")
    rare = met.where(F.col("n") <= COMMON)
    candidates = pairs(rare, _side(rare, "b", "size", "pos", "fold", "root", by=("key",)), ("key",)).where("a < b")
    candidates = candidates.union(pairs(small, _side(small, "b", "size", "pos", "fold", "root", by=_PLACE), _PLACE).where("a < b"))
    fresh = _verified(_close(candidates.union(pairs(waiting, bounded(asked), _PLACE)), nodes, similarity), docs, nodes, k, similarity)
    discard(met, banded, places)
    if not fresh.isEmpty():
        links = links.union(fresh)
        roots = _roots(links)
    while True:
        before, waiting = waiting, materialize(_open_places(waiting, asked, roots), "near-waiting")
        discard(before, asked)
        if waiting.isEmpty():
            break
        pivots *= 8
        asked = materialize(_pivots(waiting.where("root <> main"), pivots), "near-pivots")
        fresh = _verified(_close(pairs(waiting, bounded(asked), _PLACE), nodes, similarity), docs, nodes, k, similarity)
        if not fresh.isEmpty():
            links = links.union(fresh)
            roots = _roots(links)
    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    members = nodes.select("node", "least").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = members.groupBy("root").agg(F.min("least").alias("group_id"))
    named = members.join(whole, "root").select("node", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return wide.select("doc_id", "node").join(named, "node").select("doc_id", "group_id", "n_links")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    return materialize(connected_components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links), "near-roots")


def _open_places(waiting: DataFrame, asked: DataFrame, roots: DataFrame) -> DataFrame:
    """``waiting`` without the texts that were ``asked`` and without places whose texts are in one group; adds root and main.

    main: the group most texts of the place are in.
    """
    left = waiting.drop("root", "main").join(asked.select(*_PLACE, F.col("b").alias("node")), [*_PLACE, "node"], "left_anti")
    placed = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = placed.groupBy(*_PLACE, "root").agg(F.count(F.lit(1)).alias("n")).groupBy(*_PLACE)
    unlike = groups.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return placed.join(unlike.drop("groups"), list(_PLACE))
