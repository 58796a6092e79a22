"""MinHash near-duplicates with tensored banding (operator 7).

A document's set is its distinct shingles of five words.  Two collections of
``BANDS`` keys, each of ``ROWS`` minhashes, are combined in pairs into
``BANDS`` squared table keys, so 2 * ROWS * BANDS minhashes do the work of
ROWS * 2 * BANDS squared.  A pair at similarity s meets in some table unless
none of the first or none of the second keys agree: at s = 0.75 it is missed
with probability 2 * (1 - s ** ROWS) ** BANDS = 0.0009, at 0.8 with 0.00007.

Documents of equal sets are one class and are represented by its smallest id.
Candidates are confirmed on the full sets, without making all pairs of a table
key: first every member is compared with the key's most connected member; then
what is still outside the key's largest component is compared with that whole
component and with each other, in blocks inside tasks that return links only.
So every pair that meets in a table is confirmed, refuted, or known to be in
one component.

Defined results: null and empty texts have no shingle and link with nothing; a
text with fewer than five words is one shingle; rows that share an id are one
document with several texts; a null id is never linked and its component is
null; other columns are ignored or kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postresp.llm.common import frugal, id_and_text, mix64, passing_tables, small_slices, stored, text_bytes
from postresp.llm.graph import components
from postresp.llm.spans import LOWER, Hashes, owners, word_spans

SHINGLE = 5
PERCENT = 75
BANDS = 14
ROWS = 3
MEMBERS = 2048          #: members of a component in one comparing unit
BLOCK = 256             #: documents of one side in a unit of a key's rest
SLICE = 1 << 20
BROADCAST_IDS = 500_000  #: ids of candidates are broadcast up to this many


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets of length n + 1)."""
    raw, offsets = text_bytes(texts)
    n = len(texts)
    starts, ends = word_spans(raw, offsets)
    own = owners(starts, offsets)
    words = Hashes.of_bytes(LOWER[raw])(starts, ends)
    windows = Hashes(words)
    at = np.flatnonzero(own[SHINGLE - 1:] == own[:1 - SHINGLE]) if len(own) >= SHINGLE else np.zeros(0, np.int64)
    count = np.bincount(own, minlength=n)
    first = np.searchsorted(own, np.arange(n))
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    hashes = np.concatenate([windows(at, at + SHINGLE), windows(first[few], first[few] + count[few])])
    doc = np.concatenate([own[at], few])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    return hashes, np.searchsorted(doc, np.arange(n + 1))


_SEEDS = mix64(np.arange(1, 4 * ROWS * BANDS + 1, dtype=np.uint64)).reshape(2, -1)


def minhash_keys(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two (sets, BANDS) arrays of keys, each of ROWS minhashes."""
    keys = np.zeros((2, len(begins), BANDS), np.uint64)
    for k in range(2 * BANDS * ROWS):
        low = np.minimum.reduceat((hashes ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1)), begins)
        side, band = divmod(k // ROWS, BANDS)
        keys[side, :, band] = mix64(keys[side, :, band] * np.uint64(31) + low + np.uint64(band))
    return keys[0], keys[1]


def _features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set1, set2, a (array<long>), b (array<int>)`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 1, SLICE):
            n = batch.num_rows
            hashes, offsets = shingle_sets(batch.column(1))
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            sums = np.zeros((2, n), np.uint64)
            a, b = np.zeros((n, BANDS), np.uint64), np.zeros((n, BANDS), np.uint64)
            if len(full):
                begins = offsets[:-1][full]
                a[full], b[full] = minhash_keys(hashes, begins)
                for k in range(2):
                    sums[k, full] = np.add.reduceat(mix64(hashes + np.uint64(k * 0x5851F42D4C957F2D)), begins)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), BANDS).cast(pa.list_(t)) for x, t in
                     ((a.view(np.int64), pa.int64()), ((b >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums], *lists],
                names=["doc_id", "n_shingles", "set1", "set2", "a", "b"])

    return docs.mapInArrow(frugal(run), "doc_id long, n_shingles long, set1 long, set2 long, a array<long>, b array<int>")


def _buckets(classes: DataFrame) -> DataFrame:
    """``bucket, doc``: table keys that hold two classes or more.

    The first collection is grouped alone; only documents that agree in one of
    its keys with another get the combined keys."""
    keys = classes.select("doc", F.explode("a").alias("akey"))
    shared = keys.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("akey")
    paired = keys.join(shared, "akey").join(classes.select("doc", "b"), "doc")
    combined = paired.select("doc", F.posexplode("b").alias("j", "bkey"), "akey").select("doc", F.xxhash64("akey", "j", "bkey").alias("bucket"))
    full = combined.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return combined.join(full, "bucket").select("bucket", "doc", "n")


def _compare(texts: DataFrame, units: DataFrame) -> DataFrame:
    """``a, b``: confirmed links between the sides of each unit.

    ``units`` has ``unit, side, doc, part``; documents with equal ``part`` are
    not compared.  Sets go to their units; a unit is compared inside one task."""
    wanted = units.groupBy("doc").agg(F.collect_list(F.struct("unit", "side", "part")).alias("places"))
    placed = texts.join(wanted, "doc").select("doc", "text", "places")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 1, SLICE):
            hashes, offsets = shingle_sets(batch.column(1))
            data = hashes.view(np.int64)
            docs, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, own in enumerate(places):
                value = data[offsets[i]:offsets[i + 1]].tobytes()
                for start in range(0, len(own), 64):
                    some = own[start:start + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p["unit"] for p in some], pa.int64()), pa.array([p["side"] for p in some], pa.int32()),
                         pa.array([docs[i]] * len(some), pa.int64()), pa.array([p["part"] for p in some], pa.int64()),
                         pa.array([value] * len(some), pa.binary())], names=["unit", "side", "doc", "part", "set"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != unit:
                    yield from _unit_links(rows)
                    unit, rows = row[0], []
                rows.append(row)
        yield from _unit_links(rows)

    spread = placed.mapInArrow(frugal(sets), "unit long, side int, doc long, part long, set binary")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (spread.repartition(n, "unit").sortWithinPartitions("unit", "side").mapInArrow(frugal(links), "a long, b long"))


def _unit_links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    left = [(d, p, np.frombuffer(s, np.uint64)) for _, side, d, p, s in rows if side == 0]
    right = [(d, p, np.frombuffer(s, np.uint64)) for _, side, d, p, s in rows if side == 1]
    if not left or not right:
        return
    sizes = np.array([len(r[2]) for r in right])
    doc, part = np.array([r[0] for r in right]), np.array([r[1] for r in right])
    values, at = np.unique(np.concatenate([r[2] for r in right]), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), sizes)
    found: list[tuple[int, int]] = []
    for d, p, own in left:
        if not len(own):
            continue
        place = np.minimum(np.searchsorted(values, own), len(values) - 1)
        hit = np.zeros(len(values), bool)
        hit[place[values[place] == own]] = True
        both = np.bincount(owner[hit[at]], minlength=len(right))
        near = (100 * both >= PERCENT * (sizes + len(own) - both)) & (part != p) & (doc != d)
        found += [(d, int(x)) for x in doc[near]]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                                         names=["a", "b"])


def _chunk(doc: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(doc), n)


def _stars(buckets: DataFrame) -> DataFrame:
    """Units that compare every member of a bucket with its most connected one
    (the hub: the largest sum of bucket sizes); a hub's members are cut into units."""
    degree = buckets.groupBy("doc").agg(F.sum("n").alias("degree"))
    ranked = buckets.join(degree, "doc")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc")).alias("neg"))).alias("top")).select("bucket", (-F.col("top.neg")).alias("hub"))
    edges = buckets.join(hubs, "bucket").where("doc <> hub").select("hub", "doc").distinct()
    parts = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("long").alias("parts"))
    members = edges.join(parts, "hub").select(F.xxhash64("hub", _chunk("doc", F.col("parts"))).alias("unit"), F.lit(1).alias("side"), "doc", F.col("doc").alias("part"))
    leads = (parts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select(F.xxhash64("hub", "k").alias("unit"), F.lit(0).alias("side"), F.col("hub").alias("doc"), F.col("hub").alias("part")))
    return members.union(leads)


def _rest(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Units for what is outside the largest component of its bucket: against
    all members of that component, and against the others outside it."""
    labelled = buckets.join(labels, "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("part"))
    mixed = labelled.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    rows = stored(labelled.join(mixed, "bucket"), "mixed-buckets")
    main = (rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("bucket").agg(F.max(F.struct("n", (-F.col("part")).alias("neg"))).alias("top")).select("bucket", (-F.col("top.neg")).alias("main")))
    outside = rows.join(main, "bucket").where("part <> main")
    # against the largest component: each of its members once, in units of bounded size
    asked = outside.select("main", "doc", "part").distinct()
    members = labels.join(asked.select(F.col("main").alias("component")).distinct(), "component").select("component", "doc")
    single = asked.select(F.col("main").alias("component")).distinct().join(labels, "component", "left_anti").select("component", F.col("component").alias("doc"))
    members = members.union(single)
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("long").alias("parts"))
    rights = members.join(sizes, "component").select(
        F.xxhash64(F.lit("c"), "component", _chunk("doc", F.col("parts"))).alias("unit"), F.lit(1).alias("side"), "doc", F.col("component").alias("part"))
    lefts = (asked.join(sizes, asked.main == sizes.component).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select(F.xxhash64(F.lit("c"), "component", "k").alias("unit"), F.lit(0).alias("side"), "doc", "part"))
    # against each other: blocks of the bucket's rest, every pair of blocks a unit
    blocks = outside.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    own = outside.join(blocks.select("bucket", "parts"), "bucket").withColumn("i", _chunk("doc", F.col("parts")))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = lambda x, y: F.xxhash64(F.lit("b"), "bucket", x, y)
    first = own.where("i <= j").select(pair("i", "j").alias("unit"), F.lit(0).alias("side"), "doc", "part")
    second = own.where("j <= i").select(pair("j", "i").alias("unit"), F.lit(1).alias("side"), "doc", "part")
    return lefts.union(rights).union(first).union(second).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row."""
    rows = id_and_text(docs, id_col, text_col)
    features = stored(_features(rows), "minhash")
    sets = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(sets.groupBy("n_shingles", "set1", "set2").agg(F.min("doc_id").alias("doc"), F.first("a").alias("a"), F.first("b").alias("b"))
                     .select("n_shingles", "set1", "set2", "doc", "a", "b"), "classes")
    buckets = stored(_buckets(classes.select("doc", "a", "b")), "buckets")
    candidates = buckets.select("doc").distinct()
    few = candidates.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = stored(rows.withColumnRenamed("doc_id", "doc").join(F.broadcast(candidates) if few else candidates, "doc", "left_semi"), "candidates")
    # an id with several texts is one document
    same = sets.join(classes.select("n_shingles", "set1", "set2", "doc"), ["n_shingles", "set1", "set2"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    first = stored(_compare(texts, _stars(buckets)), "star-links")
    labels = stored(components(first).select(F.col("node").alias("doc"), "component"), "star-components")
    second = stored(_compare(texts, _rest(buckets, labels)), "rest-links")
    links = first.union(second).union(same.where("a <> b").distinct())
    final = components(links)
    out = features.join(final, features.doc_id == final.node, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of near-duplicate rows.

    A row is a document of its own, whatever its id: rows that share an id and have
    unrelated texts all stay, copies without an id are found like others.  Of a
    group the smallest id stays (of equal ids the smallest hash of the text; rows
    without an id only where no row has one).  Texts without words are linked with
    nothing, so their rows all stay.
    """
    own_id = F.col(id_col).cast("long")
    repeated = docs.groupBy(own_id.alias("own_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR own_id IS NULL")
    if named := not repeated.limit(1).count():
        rows = docs.select(own_id.alias("node"), F.struct("*").alias("row"))
    else:                                       # a number per row, written with it
        rows = stored(docs.select(F.monotonically_increasing_id().alias("node"), F.struct("*").alias("row")), "numbered-documents")
    own = rows.select("node", F.col("row")[id_col].cast("long").alias("own_id"), F.col("row")[text_col].cast("string").alias("text"))
    with passing_tables(docs.sparkSession):     # the result reads the rows and the numbers of the copies
        found = near_duplicates(own, "node").where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id")
        if named:
            copies = found.where("node <> component_id").select("node")
        else:
            member = stored(found.join(own.select("node", "own_id", F.xxhash64("text").alias("content")), "node"), "near-duplicates")
            stays = member.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "content", "node"))["node"].alias("node"))
            copies = member.select("node").join(stays, "node", "left_anti")
        gone = stored(copies, "copies", stays=True)
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, "node", "left_anti").select("row.*")
