"""N-gram Jaccard self-join of documents by a grouped prefix join (operator 7).

Sets of word n-grams are put in one global order, those of rare hash buckets first.  Two sets
that are similar enough share an element of their prefixes.  Documents with equal texts are one
node; nodes with equal prefixes and sizes are one group; groups that share a prefix element are
filtered by size and position, expanded to their members, filtered by bit maps, and verified on
their whole sets.

First every group is held against one leader of each of its buckets only, and every member against
its group's first.  What these links connect need not be compared again: only members of different
components remain, and a bucket of one component is done.  Leaders differ from bucket to bucket, so
that a large group of near copies, which share many buckets, is connected by few comparisons of
each.  A bucket of several components is compared member by member, a large one dealt out by bands
of sizes; of these pairs only those leave the join that sizes, places and maps let pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import words as W
from engram.llm.common import discard, free_name, key_filter, map_arrow, materialise, passes, pieces, table, utf8
from engram.llm.components import components

#: Elements are counted by the first COUNT_BITS bits of their hashes; a bit map has MAP_BITS bits.
#: A set of more than MAP_BITS elements has a wide one too, of at least as many bits as elements.
#: COARSE_BITS of them are tried before.
COUNT_BITS, MAP_BITS, COARSE_BITS = 18, 1024, 512
BATCH_BYTES = 1 << 21
#: A task that verifies pairs keeps sets of about this many bytes at hand.
SETS_BYTES = 32 << 20
#: Members of a bucket of several components beyond which it is dealt out by sizes.
HOT = 256
#: A table of at most this many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    for first, last, h, bounds, _, _ in W.batches(texts, W.NON_SPACE):
        for i in range(last - first):
            yield W.shingles(h[bounds[i] : bounds[i + 1]], n)


def bucket_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many n-grams of the whole corpus fall into each of 2**COUNT_BITS hash buckets.

    The counts have a fixed size, whatever the input; each task sends its own once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for first, last, h, bounds, _, _ in W.batches(texts, W.NON_SPACE):
                if len(h) >= n:
                    # n-grams across two texts change the order a little, and nothing else
                    counts += np.bincount((W.grams(h, n) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], names=["bucket", "n"])

    found = map_arrow(docs.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def prefix_length(size: int, percent: int) -> int:
    return size - (percent * size + 99) // 100 + 1


def bit_map(elements: np.ndarray, width: int = MAP_BITS) -> np.ndarray:
    """Parities of width classes of elements: two sets differ in at least as many elements as their maps in bits."""
    odd = np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def wide_map(elements: np.ndarray) -> np.ndarray | None:
    """A map as wide as the set is large, as MAP_BITS classes of a large set say nothing."""
    return bit_map(elements, 1 << (len(elements) - 1).bit_length()) if len(elements) > MAP_BITS else None


def describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, node, size, prefix, coarse, bits, wide) for every row; node is the MD5 of the text.

    A text that the same task has seen has no prefix and no maps again.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in pieces(batches, "text", BATCH_BYTES):
            texts = utf8(batch.column(1))
            nodes = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
            fresh = [i for i, x in enumerate(nodes) if x not in seen and not seen.update({x: -1})]
            prefixes: list = [None] * len(texts)
            coarse: list = [None] * len(texts)
            maps: list = [None] * len(texts)
            wide: list = [None] * len(texts)
            for i, elements in zip(fresh, _sets([texts[i] for i in fresh], n), strict=True):
                seen[nodes[i]] = len(elements)
                if len(elements):
                    rank = ranks.value[(elements >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                    order = np.lexsort((elements, rank))[: prefix_length(len(elements), percent)]
                    prefixes[i], coarse[i], maps[i], wide[i] = elements[order].view(np.int64), bit_map(elements, COARSE_BITS), bit_map(elements), wide_map(elements)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array([seen[x] for x in nodes], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, coarse, maps, wide))],
                names=["doc_id", "node", "size", "prefix", "coarse", "bits", "wide"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, node binary, size long, prefix array<bigint>, coarse array<bigint>, bits array<bigint>, wide array<bigint>")


def _fits(size_a: Column, size_b: Column, percent: int) -> Column:
    return (size_a * 100 >= size_b * percent) & (size_b * 100 >= size_a * percent)


def _reaches(overlap: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether an overlap is enough: 100 * overlap >= percent * (a + b - overlap)."""
    return overlap * (100 + percent) >= (size_a + size_b) * percent


def _by_position(a: str, b: str, percent: int) -> Column:
    """The most two sets can share, seen from a common element at these places of theirs."""
    x, y = F.col(f"{a}.pos"), F.col(f"{b}.pos")
    most = F.least(x, y) + 1 + F.least(F.col(f"{a}.size") - 1 - x, F.col(f"{b}.size") - 1 - y)
    return _reaches(most, F.col(f"{a}.size"), F.col(f"{b}.size"), percent)


def _near(differ: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether sets that differ in this many elements, or more, can be similar enough."""
    return ((size_a + size_b) - differ) * (100 + percent) >= (size_a + size_b) * 2 * percent


def _by_bits(a: Column, b: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether maps of one width let two sets link."""
    differ = F.aggregate(F.zip_with(a, b, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, n: total + n)
    return _near(differ, size_a, size_b, percent)


def _by_wide(a: Column, b: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """The same with wide maps; one of twice the other's width is folded, and any other pair passes."""

    def folded(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) == F.size(y) * 2, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda v, w: v.bitwiseXOR(w))).otherwise(x)

    return a.isNull() | b.isNull() | (F.size(folded(a, b)) != F.size(folded(b, a))) | _by_bits(folded(a, b), folded(b, a), size_a, size_b, percent)


def _pack(text: bytes, codec: pa.Codec) -> bytes:
    return len(text).to_bytes(8, "little") + codec.compress(text, asbytes=True)


def _unpack(packed: bytes, codec: pa.Codec) -> bytes:
    return codec.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def whole_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, packed) of the wanted (id, node): whole texts, compressed to a third of their sets' size.

    A filter of a fixed size (a bit for each hash of 23 bits) keeps most other texts from being
    shuffled; a join does the rest.  A task sends a text once, however many copies it holds.
    """
    at = F.conv(F.substring(F.hex("node"), 1, 6), 16, 10).cast("int").bitwiseAND((1 << 23) - 1)
    found = wanted.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, at % 64))").alias("bits")).toPandas()
    bits = np.zeros((1 << 23) // 64, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    bits = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        codec = pa.Codec("zstd", compression_level=3)
        for batch in pieces(batches, "text", BATCH_BYTES):
            nodes, texts = [], []
            for text in utf8(batch.column(0)):
                node = hashlib.md5(text, usedforsecurity=False).digest()
                at = int.from_bytes(node[:3], "big") & ((1 << 23) - 1)
                if int(bits.value[at >> 6]) >> (at & 63) & 1 and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    texts.append(_pack(text, codec))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(texts, pa.binary())], names=["node", "packed"])

    texts = map_arrow(docs.select("text"), run, "node binary, packed binary")
    return texts.join(wanted, "node").dropDuplicates(["node"]).select("id", "packed")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar enough, as a written table."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "node"), "id"), "wanted")
    texts = materialise(whole_texts(docs, wanted), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        known: dict[int, np.ndarray] = {}
        held = 0

        def elements(node: int, packed: pa.Scalar) -> np.ndarray:
            nonlocal held
            if node not in known:
                if held > SETS_BYTES:
                    known.clear()
                    held = 0
                [known[node]] = _sets([_unpack(packed.as_py(), codec)], n)
                held += known[node].nbytes
            return known[node]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p, q = elements(a, x), elements(b, y)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = materialise(map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long"), "links")
    discard(wanted, texts)
    return links


def _if_small(written: DataFrame, row_bytes: int = 32) -> DataFrame:
    """A written table, to be broadcast only if its rows, which are counted, are few."""
    return F.broadcast(written) if written.count() * row_bytes <= BROADCAST_BYTES else written


def similar_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, node, size, root) for every row: root names the component of the row's text.

    Documents link when 100 * shared >= percent * united distinct n-grams of their words (ASCII
    lower case); a text of fewer words has its whole sequence as its only element.  Without words
    a document links with nothing, not with its copies either: its root is null.  Rows with equal
    texts are one node; null and repeated ids make no difference.
    """
    docs = docs.select("doc_id", "text")
    described = materialise(describe(docs, n, percent), "described")
    nodes = described.where(F.col("size") > 0).groupBy("node").agg(F.max("size").alias("size"), *(F.first(c, ignorenulls=True).alias(c) for c in ("prefix", "coarse", "bits", "wide")))
    # the written table fixes the ids
    nodes = materialise(nodes.withColumns({"k1": F.xxhash64("prefix"), "k2": F.xxhash64(F.lit(1), "prefix"), "id": F.monotonically_increasing_id()}), "nodes")
    # groups of equal prefixes and sizes; the first member names the group, the others follow it
    groups = nodes.groupBy("size", "k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    followers = nodes.select("id", "size", "k1", "k2").join(groups, ["size", "k1", "k2"]).where(F.col("id") != F.col("first")).select("id", "first")
    followers = materialise(followers, "followers")
    few = _if_small(followers)
    # prefix elements that at least two groups have, each with one group as its leader; the others stay where they are
    prefixes = nodes.select("id", F.col("size").cast("int").alias("size"), "prefix").join(few, "id", "left_anti")
    counted = prefixes.select("id", F.explode("prefix").alias("element")).groupBy("element")
    shared = counted.agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("element", "id")).alias("leader")).where(F.col("n") > 1).select("element", "leader")
    shared = materialise(shared, "shared")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(shared, "element")[1])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            elements, lengths = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()
            here = np.flatnonzero(passes(elements, bits.value))
            row = np.repeat(np.arange(batch.num_rows), lengths)[here]
            pos = here - (np.cumsum(lengths) - lengths)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(elements[here])], names=["id", "size", "pos", "element"])

    postings = map_arrow(prefixes, likely, "id long, size int, pos int, element long").join(shared, "element")
    postings = materialise(postings, "postings")
    discard(shared)
    maps = nodes.select("id", "coarse")

    def sides(pairs: DataFrame, columns: list[str]) -> DataFrame:
        for name in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns)), name)
        return pairs

    def by(test: Callable[..., Column], column: str) -> Column:
        return test(F.col(f"{column}_a"), F.col(f"{column}_b"), F.col("size_a"), F.col("size_b"), percent)

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and bit maps let them link; the small maps are tried first, the wide ones last."""
        some = sides(pairs, ["size", "coarse"]).where(_fits(F.col("size_a"), F.col("size_b"), percent) & by(_by_bits, "coarse")).select("a", "b")
        return sides(some, ["size", "bits", "wide"]).where(by(_by_bits, "bits") & by(_by_wide, "wide")).select("a", "b")

    # 1. every group against its buckets' leaders, and every member against its group's first
    star = postings.where(F.col("id") != F.col("leader")).select("id", "leader").distinct()
    after = star.join(few.select(F.col("id").alias("follower"), F.col("first").alias("_first")), F.col("id") == F.col("_first")).select(F.col("follower").alias("id"), "leader")
    star = star.unionByName(after).unionByName(followers.select("id", F.col("first").alias("leader")))
    tried = materialise(filtered(star.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()), "star-pairs")
    links = verify(tried, nodes, docs, n, percent)
    found = components(links)
    roots = _if_small(found).withColumnRenamed("node", "id")
    # 2. what is left: members of different components that share a bucket
    members = postings.select("element", "id", "size", "pos")
    joined = members.withColumnRenamed("id", "_first").join(few, F.col("_first") == F.col("first")).select("element", "id", "size", "pos")
    members = members.unionByName(joined).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = materialise(members, "postings-roots")
    mixed = members.groupBy("element").agg(F.min("root").alias("least"), F.max("root").alias("most"), (F.count(F.lit(1)) > HOT).alias("hot")).where(F.col("least") != F.col("most")).select("element", "hot")
    # only sizes of the same band or the next one fit, so a large bucket is dealt out by them
    band = F.floor(F.log("size") / math.log(100 / percent + 1e-9)) if percent < 100 else F.col("size")
    open_ = members.join(mixed, "element").join(maps, "id").withColumn("band", F.when(F.col("hot"), band).otherwise(0).cast("long"))
    bands = F.when(F.col("hot"), F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array("band"))
    a, b = open_.withColumn("band", F.explode(bands)).alias("a"), open_.alias("b")

    def near(a: str, b: str) -> Column:
        fits = (F.col(f"{a}.id") < F.col(f"{b}.id")) & (F.col(f"{a}.root") != F.col(f"{b}.root")) & _fits(F.col(f"{a}.size"), F.col(f"{b}.size"), percent)
        return fits & _by_bits(F.col(f"{a}.coarse"), F.col(f"{b}.coarse"), F.col(f"{a}.size"), F.col(f"{b}.size"), percent)

    same = (F.col("a.element") == F.col("b.element")) & (F.col("a.band") == F.col("b.band"))
    rest = a.join(b, same & near("a", "b") & _by_position("a", "b", percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    # members of one group share all their prefix, but a bucket is listed only if groups share it
    alone = followers.unionByName(followers.select(F.col("first").alias("id"), "first").distinct()).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    alone = materialise(alone.join(nodes.select("id", "size"), "id").join(maps, "id"), "group-roots")
    x, y = alone.alias("x"), alone.alias("y")
    within = x.join(y, (F.col("x.first") == F.col("y.first")) & near("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    rest = materialise(filtered(rest.unionByName(within).distinct()).join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    more = verify(rest, nodes, docs, n, percent)

    # 3. links of step 2 join the components of step 1
    def root_of(name: str) -> DataFrame:
        return roots.select(F.col("id").alias(name), F.col("root").alias(f"root_{name}"))

    between = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(between)
    upper = joined.select(F.col("node").alias("root"), F.col("root").alias("upper"))
    named = nodes.select("id", "node").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = materialise(named.join(upper, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "named")
    discard(nodes, followers, postings, tried, links, found, members, alone, rest, more, joined)
    return described.select("doc_id", "node", "size").join(named, "node", "left").select("doc_id", "node", "size", "root")


def op7_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id: the least doc_id that links reach.

    Null ids are passed over in the choice of the least.
    """
    found = materialise(similar_components(table(spark, sf_dir, "documents")), "components")
    least = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "root", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs with one document of each component: the least doc_id, null ids last.

    Among equal ids the least text hash stays, and of equal rows one.  Documents without words all
    stay.  Returns the columns of docs.
    """
    found = materialise(similar_components(docs, n, percent).where(F.col("size") > 0), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "node")
    best = materialise(found.groupBy("root").agg(F.min(rank).alias("best")), "best")
    counted = found.join(best, "root").groupBy("doc_id", "node", (F.col("best") == rank).alias("stays")).agg(F.count(F.lit(1)).alias("rows"))
    counted = materialise(counted.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "stays"), "dropped")
    digest = free_name(docs, "_digest")
    keyed = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))))
    # a row of counted is 32 bytes; broadcast it only if that is little
    small = counted.count() * 32 <= BROADCAST_BYTES
    listed = F.broadcast(counted) if small else counted
    same = keyed["doc_id"].eqNullSafe(listed["_id"]) & (keyed[digest] == listed["_node"])
    once = keyed.join(listed, same, "left_anti").drop(digest)
    again = keyed.join(listed.where("stays"), same, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)
    return once.unionByName(again)
