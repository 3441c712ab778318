"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

A document's set holds its distinct word shingles. Every shingle draws a random permutation of the
signature's slots, so one shingle never fills a slot twice: this correlation lowers the variance.
Level j of all permutations is computed at once, and a document stops as soon as every slot holds a
value below the next level. Bands of slots propose buckets; links are confirmed on the full sets.

Copies of a set are one class from the start. In a bucket no pairs are listed: each member is held
against two hubs (the most central member and the smallest id). Clusters of buckets that this leaves
in several parts go through an exact join: of shingles ordered from rare to common, similar sets
share one among the first. Members of a cluster in different parts that do form crowds; of a crowd the members
outside its largest part are compared with everyone, in blocks. What loosely alike texts have in common (a
boilerplate) stands last in the order and brings nobody together.

Documents without words (null, empty or blank texts) have no shingles and link with nothing. Rows
with equal ids are one document of that id only in the class they share; ids are meant to be unique there.
Null ids get a row with a null component and are kept. ``keep_first`` tells rows apart by keys of its own. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import flat_chunks, free_name, mix64, salted_join, scratch, shingle_hashes
from gridloom.llm.components import components

BANDS, ROWS = 20, 5
#: Text bytes sketched at a time: permutations of short documents take a hundred bytes a shingle.
CHUNK_BYTES = 1 << 20
#: Members of one block in the exact comparison of what hubs left apart.
BLOCK = 128
#: Counters that order shingles by how common they are, as a power of two. Which order it is changes the work and not the result.
ORDER_BITS = 20
#: Bits of the candidates' bit map, as a power of two, at most: its size doesn't grow with the data beyond.
BITMAP_BITS = 26


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and offsets by document."""
    h, ends = shingle_hashes(words, at, k)
    cuts = ends.tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[ends]


def super_minhash(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m) of sets: level in the high bits, random value in the low ones."""
    n_docs = len(at) - 1
    sig = np.full(n_docs * m, np.iinfo(np.int64).max, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    perm = None
    for level in range(m):
        draw = mix64(h + np.uint64((level + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        slot = (level + ((draw >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32))).astype(np.int64)
        value = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) | (level << 32)
        if level == 0:
            chosen = slot
        else:
            row = np.arange(len(h))
            chosen, own = perm[row, slot].astype(np.int64), perm[row, level].copy()
            perm[row, slot], perm[row, level] = own, chosen
        np.minimum.at(sig, doc * m + chosen, value)
        open_docs = sig.reshape(n_docs, m).max(axis=1) >= (level + 1) << 32
        on = open_docs[doc]
        h, doc = h[on], doc[on]
        if not len(h):
            break
        if level == 0:
            first = slot[on]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
            perm[np.arange(len(h)), first], perm[:, 0] = 0, first
        else:
            perm = perm[on]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix64((key * np.uint64(0x9E3779B97F4A7C15)) ^ parts[:, :, r])
    return key.astype(np.int64)


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(at.astype(np.int32), flat)


def sketches(df: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), and the bands' keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat in flat_chunks(batch.column(1), lower=True, limit=CHUNK_BYTES):
                h, at = shingle_sets(*flat.word_hashes(), k)
                n = np.diff(at)
                sums = [np.where(n > 0, np.add.reduceat(np.append(mix64(h ^ np.uint64(s)), np.uint64(0)), np.minimum(at[:-1], len(h))), np.uint64(0)).astype(np.int64) for s in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                some = np.flatnonzero(n > 0)
                keys = np.zeros((0, bands), np.int64)
                if len(some):
                    keys = band_keys(super_minhash(h, np.append(at[some], at[-1]), bands * rows), bands, rows)
                width = np.where(n > 0, bands, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *map(pa.array, sums), _lists(keys.reshape(-1), np.concatenate([[0], np.cumsum(width)]))], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return _texts(df).mapInArrow(work, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _some_sets(df: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, s): the full sets of documents whose id is in ``ids``, and of a few others.

    The ids go round as a bit map of hashed ids. Its size is bounded; a join drops what it lets through.
    """
    n = ids.count()
    bits = min(BITMAP_BITS, max(10, int(n * 16).bit_length()))
    mask = (1 << bits) - 1
    word = F.shiftright(F.xxhash64("node").bitwiseAND(F.lit(mask)), 6)
    bit = F.expr(f"shiftleft(1L, cast(xxhash64(node) & {mask} & 63 as int))")
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    words = ids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((table[at >> 6] >> (at & 63)) & 1 == 1))
            for a, b, flat in flat_chunks(batch.column(1), lower=True, limit=CHUNK_BYTES):
                h, ends = shingle_sets(*flat.word_hashes(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(h.astype(np.int64), ends)], ["node", "s"])

    docs = _texts(df).where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(F.lit(mask)).alias("at"))
    return docs.mapInArrow(work, "node long, s array<long>").join(ids, "node", "left_semi").dropDuplicates(["node"])


def _block_links(num: int, den: int):
    """Links between parts within two blocks of sets, as a forest: enough for components."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, part, outside = (table.column(c).to_numpy() for c in ("node", "part", "outside"))
        sets = table.column("s").combine_chunks()
        flat, at = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
        n, size = len(node), np.diff(at)
        _, column = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((n, n), np.float32)
        width = 4096
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [c, c + width])
            dense = np.zeros((n, width), np.float32)
            dense[owner[a:b], column[a:b] - c] = 1
            both += dense @ dense.T
        inter = np.rint(both).astype(np.int64)
        union = size[:, None] + size[None, :] - inter
        ok = (inter * den >= num * union) & (part[:, None] != part[None, :]) & outside[:, None].astype(bool)
        x, y = np.nonzero(ok)
        root: dict[int, int] = {}

        def find(p: int) -> int:
            while (q := root.get(p, p)) != p:
                root[p] = root.get(q, q)
                p = q
            return p

        links = []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(int(part[i])), find(int(part[j]))
            if p != q:
                root[p] = q
                links.append((node[i], node[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return work


def _prefix_keys(members: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, part): the rarest shingles of each set, of which similar sets of a cluster share one. ``members``: node, part, cluster, s."""
    mask = (1 << ORDER_BITS) - 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot, count = np.unique(batch.column(0).flatten().to_numpy() & mask, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(count)], ["spot", "c"])

    counted = members.select("s").mapInArrow(tally, "spot long, c long").groupBy("spot").agg(F.sum("c").alias("c")).toArrow()
    common = np.zeros(mask + 1, np.int64)
    common[counted.column("spot").to_numpy()] = counted.column("c").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(common)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for cluster, one in zip(batch.column(2).to_numpy(), batch.column(3), strict=True):
                x = one.values.to_numpy()
                # similar sets have ceil(t n) in common, so one of the first n - ceil(t n) + 1
                take = len(x) - -(-num * len(x) // den) + 1
                rare = x[np.lexsort((x, shared.value[x & mask]))[:take]]
                lists.append((mix64(rare.view(np.uint64)) ^ np.uint64(cluster.astype(np.uint64))).view(np.int64))
            width = [len(x) for x in lists]
            pick = np.repeat(np.arange(len(lists)), width)
            node, part = (batch.column(i).take(pa.array(pick)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)), node, part], ["key", "node", "part"])

    return members.select("node", "part", "cluster", "s").mapInArrow(first, "key long, node long, part long")


def duplicates(df: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``df``; links have Jaccard >= ``threshold`` on k-word shingles."""
    exact = Fraction(str(threshold))
    num, den = exact.numerator, exact.denominator
    sketch = scratch(sketches(df, k, bands, rows), "near-sketch")
    # classes of equal sets: the smallest id stands for all
    classes = scratch(sketch.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "near-classes")
    posts = classes.select("node", F.explode("bands").alias("key"))
    sizes = scratch(posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1"), "near-sizes")
    n_posts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = scratch(salted_join(posts, sizes, "key", "node", sizes.select("key", "n"), n_posts), "near-buckets")
    degree = scratch(shared.groupBy("node").agg(F.sum("n").alias("degree")), "near-degrees")
    hubs = scratch(shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub")), "near-hubs")
    mates = salted_join(shared, hubs, "key", "node", sizes.select("key", "n"), n_posts).groupBy("node").agg(F.array_union(F.collect_set("hub"), F.collect_set("low")).alias("hubs"))
    pairs = mates.select(F.col("node").alias("x"), F.explode("hubs").alias("y")).where("x <> y")
    pairs = scratch(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "near-pairs")
    sets = scratch(_some_sets(df, degree.select("node"), k), "near-sets")
    n_pairs = pairs.count()
    with_x = salted_join(pairs, sets.toDF("x", "sx"), "x", "y", pairs.groupBy("x").agg(F.count("*").alias("n")), n_pairs)
    counted = salted_join(with_x, sets.toDF("y", "sy"), "y", "x", pairs.groupBy("y").agg(F.count("*").alias("n")), n_pairs)
    alike = lambda a, b: (F.least(F.size(a), F.size(b)) * den >= F.greatest(F.size(a), F.size(b)) * num)
    common = F.when(alike("sx", "sy"), F.size(F.array_intersect("sx", "sy"))).otherwise(0)
    linked = counted.select("x", "y", common.alias("i"), (F.size("sx") + F.size("sy")).alias("both")).where(F.col("i") * den >= (F.col("both") - F.col("i")) * num)
    links = scratch(linked.select("x", "y"), "near-links")
    parts = scratch(components(links), "near-parts")
    # what shares buckets but isn't in one part yet
    clusters = components(shared.where("node <> low").select("node", "low")).toDF("node", "cluster")
    placed = scratch(clusters.join(parts, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("part")), "near-clusters")
    undecided = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high and n > 2")
    undecided = scratch(undecided.select("cluster", "n"), "near-open")
    members = salted_join(placed, undecided.select("cluster"), "cluster", "node", undecided, placed.count()).select("node", "part", "cluster")
    members = scratch(members.join(sets, "node"), "near-members")
    keys = scratch(_prefix_keys(members, num, den), "near-keys")
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("node").alias("first")).where("low < high")
    groups = scratch(groups.select("key", "n", "first"), "near-groups")
    near = salted_join(keys, groups.select("key", "first"), "key", "node", groups.select("key", "n"), keys.count()).select("node", "first").where("node <> first")
    # what shares rare shingles across parts is a crowd; its members outside the largest part are compared with everyone, in blocks
    crowds = scratch(components(near).toDF("node", "crowd").join(members.select("node", "part"), "node"), "near-crowds")
    by_part = crowds.groupBy("crowd", "part").agg(F.count("*").alias("n"))
    main = by_part.groupBy("crowd").agg(F.max(F.struct("n", "part")).alias("largest"), F.sum("n").alias("n"))
    main = scratch(main.select("crowd", "n", F.col("n").alias("size"), F.col("largest.part").alias("main"), (F.col("n") - F.col("largest.n")).alias("n_out")), "near-main")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    joined = salted_join(crowds, main.drop("n"), "crowd", "node", main.select("crowd", "n"), crowds.count())
    joined = joined.withColumn("outside", F.col("part") != F.col("main")).withColumn("h", F.xxhash64("node"))
    out_block, any_block = F.pmod("h", blocks("n_out")).cast("int"), F.pmod("h", blocks("size")).cast("int")
    as_out = joined.where("outside").select("crowd", "node", "part", F.lit(1).alias("outside"), out_block.alias("i"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("j"))
    as_any = joined.select("crowd", "node", "part", F.lit(0).alias("outside"), F.explode(F.sequence(F.lit(0), blocks("n_out") - 1)).alias("i"), any_block.alias("j"))
    met = as_out.union(as_any).groupBy("crowd", "i", "j", "node").agg(F.first("part").alias("part"), F.max("outside").alias("outside"))
    found = met.join(sets, "node").groupBy("crowd", "i", "j").applyInArrow(_block_links(num, den), "a long, b long")
    found = scratch(found, "near-found")
    final = components(links.union(found)).toDF("node", "component")
    rooted = classes.join(final, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "node").alias("component"))
    joined = sketch.drop("bands").join(rooted, ["d1", "d2", "n_shingles"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(df: DataFrame, k: int = 5, threshold: float = 0.8, **options) -> DataFrame:
    """One row of each component of ``df``: the smallest id, null ids last. Texts without shingles stay.

    Every row has a key of its own, so repeated rows and null ids count like other copies.
    """
    key = free_name(df, "__row_key")
    keyed = scratch(df.withColumn(key, F.monotonically_increasing_id()), "near-keyed")
    found = duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), k, threshold, **options)
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id"))
    placed = ids.join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias(key))
    return keyed.join(first.select(key), key, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
