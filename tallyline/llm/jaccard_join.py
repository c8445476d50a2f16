"""N-gram Jaccard join: exact links between documents by PartEnum signatures.

Plan, each step a Spark job over whole tables:

1. One pass hashes each text to its set of 5-word shingles and keeps per
   document its size, a 128-bit digest and a parity sketch of about two bits a
   shingle. Documents of one digest form a class; its smallest id goes on.
2. A second pass emits PartEnum signatures of the classes. A window over each
   signature gives the buckets that hold two classes or more. Signatures that a
   sample shows to be hot are split into groups, so that no task holds a bucket
   whole; the sample decides on the split alone, all classes go on.
3. In each bucket, or each group of a split one, every class is tried against
   its predecessor in size order and the first one, not against all; the first
   ones of groups are tried in a row. Sketches refute most tries (a parity
   differs only where the sets differ, so they bound the difference from
   below); what is left is verified on the shingles. Links give components.
4. Only classes of one bucket that are still in different components are open.
   In small buckets these pairs are tried directly. A class of which so many
   signatures are hot that it might meet a partner in large buckets only goes
   through a rare-first prefix filter on document frequencies, which is exact
   too and separates texts that only share a common passage.

Hence no pair of a threshold or more is missed and no bucket is expanded to all
its pairs while one component covers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import forget, saved, small_or_not, thrifty
from tallyline.llm.components import components
from tallyline.llm.partenum import signatures
from tallyline.llm.vectext import U, mix, shingle_sets, words

#: Links need num/den of the union.
NUM, DEN = 4, 5
#: Larger buckets of several components are hot: not all of their open pairs are tried, see ``_scarce``.
SMALL_BUCKET = 32
#: Members of a bucket whose open pairs are tried without a look at sizes and ranks first.
DIRECT = 256
#: A signature met ``HOT`` times in the sample (one document of ``SAMPLED``) is split into groups of about ``GROUP`` members.
SAMPLED, HOT, GROUP = 64, 32, 2048
SKETCH_BITS_A_SHINGLE = 2
#: Bits of the sketch that a join condition compares.
MINI_BITS = 1024


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sketch_bits(size: int) -> int:
    return max(64, 1 << int(np.ceil(np.log2(max(1, size) * SKETCH_BITS_A_SHINGLE))))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, row, sizes) per chunk of a batch of (doc_id, text)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for w in words(batch.column(1)):
        h, d, sizes = shingle_sets(w, width)
        yield ids[w.lo : w.hi], h, d, sizes


def _summary(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, h, d, sizes in _sets(batch, width):
                first = np.cumsum(sizes) - sizes
                one, two = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                np.add.at(one, d, mix(h + U(11)))
                np.add.at(two, d, mix(h ^ U(0x94D049BB133111EB)))
                sketches, minis = [], []
                spread = mix(h ^ U(0x632BE59BD9B4E019))
                for lo, n in zip(first, sizes):
                    bits = sketch_bits(int(n))
                    hit = np.bincount((spread[lo : lo + n] & U(bits - 1)).astype(np.int64), minlength=bits) & 1
                    sketches.append(np.packbits(hit.astype(bool), bitorder="little").tobytes())
                    hit = np.bincount((spread[lo : lo + n] & U(MINI_BITS - 1)).astype(np.int64), minlength=MINI_BITS) & 1
                    minis.append(np.packbits(hit.astype(bool), bitorder="little").view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes.astype(np.int64)), _long(one), _long(two), pa.array(sketches, pa.binary()), pa.array(minis, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "sketch", "mini"])

    return run


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, h, d, sizes in _sets(batch, width):
                sig, row, band, room = signatures(h, d, sizes, NUM, DEN, k2=1, n2=2, slack=0.3)
                code = (sizes[row] << 24) | (np.clip(room, 0, 65535) << 8) | band
                yield pa.RecordBatch.from_arrays([_long(sig), pa.array(ids[row]), pa.array(code)], ["sig", "doc_id", "code"])

    return run


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, h, d, sizes in _sets(batch, width):
                first = np.cumsum(sizes) - sizes
                out = [h[lo : lo + n].tobytes() for lo, n in zip(first, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, pa.binary())], ["doc_id", "features"])

    return run


def differing_bits(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference; the longer sketch is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep (a, b) whose sketches leave the threshold open."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy() for i in (2, 3))
        most = (na + nb) * (DEN - NUM) // (DEN + NUM)
        sa, sb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        open_ = np.fromiter((differing_bits(x, y) for x, y in zip(sa, sb)), np.int64, len(sa)) <= most
        yield batch.select([0, 1]).filter(pa.array(open_))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(DEN * common >= NUM * (len(a) + len(b) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _narrow(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return df.join(small_or_not(keys), "doc_id", how)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those pairs (a, b) of class ids whose shingle sets reach the threshold."""
    left = classes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    seen = pairs.join(left, "a").join(right, "b").where(f"na * {NUM} <= nb * {DEN} and nb * {NUM} <= na * {DEN}")
    some = saved(seen.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(thrifty(_sketched), "a long, b long"), "tries")
    ids = saved(some.select(F.col("a").alias("doc_id")).union(some.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    features = saved(_narrow(docs, ids, "left_semi").mapInArrow(thrifty(_features(width)), "doc_id long, features binary"), "features")
    both = some.join(features.select(F.col("doc_id").alias("a"), F.col("features").alias("fa")), "a").join(features.select(F.col("doc_id").alias("b"), F.col("features").alias("fb")), "b")
    links = saved(both.select("a", "b", "fa", "fb").mapInArrow(thrifty(_verified), "a long, b long"), "links")
    forget(some, ids, features)
    return links


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        sizes = np.array([len(x) for x in sets], np.int64)
        if len(sets):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), _long(np.concatenate(sets)), pa.array(np.repeat(sizes, sizes).astype(np.int32))], ["doc_id", "feature", "n"])


def _open_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs of one bucket (key) in different components whose sizes allow a link.

    Members outside a bucket's largest component meet all others, so a large
    component costs its size times the rest, never its square. ``rank`` is the
    key's place among a member's features in the common order, 0 if unknown: the
    first feature that two sets share leaves what comes after it as the most
    that they can still have in common. Sizes and ranks decide that, so in a
    bucket of more than ``DIRECT`` members it is settled once for all members of
    one size and rank, and those without a partner leave: pages of a template,
    which share a key at one rank, are no candidates at all. The rest meet by
    bands of sizes. Parity sketches (``mini``) refute most pairs inside the join.
    """
    part = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = part.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("size")).where("parts > 1").select("key", F.col("m.component").alias("main"), (F.col("size") > DIRECT).alias("large"))
    mixed = saved(members.join(main, "key"), "mixed")
    sizes = f"na * {NUM} <= nb * {DEN} and nb * {NUM} <= na * {DEN}"
    enough = f"(1 + least(na - ra, nb - rb)) * {NUM + DEN} >= {NUM} * (na + nb)"
    band = lambda n: F.floor(F.log(n) / float(np.log(DEN / NUM))).cast("int")  # noqa: E731  sizes that may link are a band apart at most
    around = lambda n: F.sequence(band(n) - 1, band(n) + 1)
    if not (large := mixed.where("large")).isEmpty():
        ours = large.where("component <> main").select("key", F.col("n").alias("na"), F.col("rank").alias("ra")).distinct().withColumn("band", F.explode(around(F.col("na"))))
        theirs = large.select(F.col("key").alias("k"), F.col("n").alias("nb"), F.col("rank").alias("rb")).distinct().withColumn("b_band", band(F.col("nb")))
        fits = ours.join(theirs, F.expr(f"key = k and band = b_band and {sizes} and {enough}"))
        open_ = saved(fits.select("key", F.explode(F.array(F.struct(F.col("na").alias("n"), F.col("ra").alias("rank")), F.struct(F.col("nb").alias("n"), F.col("rb").alias("rank")))).alias("g")).select("key", "g.n", "g.rank").distinct(), "groups")
        mixed = mixed.where("not large").unionByName(large.join(small_or_not(open_), ["key", "n", "rank"], "left_semi"))
    of = F.col("large")
    left = mixed.where("component <> main").select("key", F.explode(F.when(of, around(F.col("n"))).otherwise(F.array(F.lit(0)))).alias("band"), F.col("mini").alias("ma"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("component").alias("ca"), "main")
    right = mixed.select(F.col("key").alias("k"), F.when(of, band(F.col("n"))).otherwise(0).alias("b_band"), F.col("mini").alias("mb"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col("component").alias("cb"))
    near = f"aggregate(zip_with(ma, mb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= (na + nb) * {DEN - NUM} div {DEN + NUM}"
    met = left.join(right, F.expr(f"key = k and band = b_band and (cb = main or ca < cb) and {sizes} and {enough} and {near}"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _scarce(hot: DataFrame) -> DataFrame:
    """Documents that may share nothing but hot signatures with a partner.

    A document shares at least its ``room`` signatures of a band with a partner
    of that band. If fewer of them are hot, the two also meet in a small bucket
    (or in one that a component covers, and then need no try).
    """
    return hot.groupBy("doc_id", (F.col("code") % 256).alias("band")).agg(F.count(F.lit(1)).alias("hot"), F.max(F.expr("shiftright(code, 8) & 65535")).alias("room")).where("hot >= room").select("doc_id").distinct()


def _grouped(rows: DataFrame, sampled: DataFrame) -> DataFrame:
    """``rows`` (sig, ..) with ``part``: the group of its bucket for members of hot signatures, null for others."""
    hot = sampled.groupBy("sig").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= HOT)
    hot = saved(hot.select(F.col("sig").alias("hot"), F.ceil(F.col("met") * SAMPLED / GROUP).alias("parts")), "hot")
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(None).cast("long"))
    part = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    return rows.join(small_or_not(hot), F.col("sig") == F.col("hot"), "left").withColumn("part", part).drop("hot", "parts")


def _tries(buckets: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket's group with the one before it and with the first, by size and id; and first ones of groups in a row."""
    by = Window.partitionBy("key", "part").orderBy("code", "doc_id")
    seen = buckets.withColumns({"before": F.lag("doc_id").over(by), "first": F.first("doc_id").over(by)}).where("before is not null")
    each = seen.select(F.col("doc_id").alias("d"), F.explode(F.array("before", "first")).alias("o"))
    firsts = buckets.where("part is not null").groupBy("key", "part").agg(F.min(F.struct("code", "doc_id")).alias("m")).select("key", "m.*")
    row = Window.partitionBy("key").orderBy("code", "doc_id")  # one a group: a two-thousandth of the bucket
    each = each.union(firsts.select(F.col("doc_id").alias("d"), F.lag("doc_id").over(row).alias("o")).where("o is not null"))
    return each.select(F.least("d", "o").alias("a"), F.greatest("d", "o").alias("b")).where("a <> b").distinct()


def jaccard_links(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, links, classes) of ``docs`` (doc_id, text).

    ``membership`` is (doc_id, n_shingles, class_id): a class holds the
    documents of one shingle set, named by its smallest id. ``links`` is
    (a, b) between class ids, enough for all components: no two classes that
    link are in different components. Null and empty texts have no shingles,
    are in no class (``class_id`` null) and link with nothing. Rows with a null
    ``doc_id`` take no part. Rows that repeat one id count as copies if their
    sets are the same; if not, they are joined under that id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    meta = saved(docs.mapInArrow(thrifty(_summary(width)), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary, mini array<long>"), "summary")
    full = meta.where("n_shingles > 0")
    classes = saved(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
    few = small_or_not(saved(classes.where("copies > 1").select("n_shingles", "h1", "h2", "class_id"), "few"))
    membership = meta.join(few, ["n_shingles", "h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "doc_id")).alias("class_id"))
    once = meta.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo = hi").select("doc_id")
    copies = full.join(few, ["n_shingles", "h1", "h2"]).where("doc_id <> class_id").select("doc_id")
    spare = saved(copies.join(once, "doc_id", "left_semi").distinct(), "spare")
    reps = saved(_narrow(full.select("doc_id", "n_shingles", "sketch", "mini"), spare, "left_anti"), "reps")
    left = _narrow(docs, spare, "left_anti")
    signed = lambda df: df.mapInArrow(thrifty(_signed(width)), "sig long, doc_id long, code long")
    rows = _grouped(signed(left), signed(left.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)))
    per = Window.partitionBy("sig", "part").orderBy("code", "doc_id")
    shared = rows.withColumns({"p": F.lag("doc_id").over(per), "q": F.lead("doc_id").over(per)}).where("p is not null or q is not null or part is not null")
    shared = saved(shared.select(F.col("sig").alias("key"), "part", "code", "doc_id"), "buckets")
    links = _links(_tries(shared), reps, docs, width)
    comp = small_or_not(components(links).withColumnRenamed("node", "doc_id"))
    placed = lambda df: df.join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    span = placed(shared).groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = saved(shared.join(saved(span.where("lo < hi").select("key", "size"), "spans"), "key"), "mixed")
    members = mixed.where(F.col("size") <= SMALL_BUCKET).select("key", F.expr("shiftright(code, 24)").alias("n"), F.lit(0).alias("rank"), "doc_id")
    scarce = saved(_scarce(mixed.where(F.col("size") > SMALL_BUCKET)), "scarce")
    if not scarce.isEmpty():
        members = members.union(_rare_prefixes(_narrow(docs, scarce, "left_semi"), width))
    members = saved(placed(members.join(reps.select("doc_id", "mini"), "doc_id")), "members")
    pairs = saved(_open_pairs(members), "open")
    more = _links(pairs, reps, docs, width)
    forget(shared, mixed, members, pairs)
    return membership, links.union(more), reps


def _rare_prefixes(docs: DataFrame, width: int) -> DataFrame:
    """(key, n, rank, doc_id): those of the ``n - ceil(n * NUM / DEN) + 1`` rarest shingles of each document that another has too.

    Two documents that link share one of them. A document whose shingles of its
    own alone fill its prefix is out before anything is joined.
    """
    features = docs.mapInArrow(thrifty(_features(width)), "doc_id long, features binary")
    flat = saved(features.mapInArrow(thrifty(_rare), "doc_id long, feature long, n int"), "flat")
    often = flat.groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("doc_id"))
    own = often.where("df = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    sizes = flat.groupBy("doc_id").agg(F.max("n").alias("n"))
    left = sizes.join(own, "doc_id", "left").select("doc_id", F.coalesce("own", F.lit(0)).alias("own"), F.expr(f"n - (n * {NUM} + {DEN - 1}) div {DEN} + 1").alias("prefix"))
    left = small_or_not(saved(left.where("own < prefix"), "left"))
    by = Window.partitionBy("doc_id").orderBy("df", "feature")
    ranked = flat.join(left, "doc_id").join(often.where("df > 1").select("feature", "df"), "feature").withColumn("rank", F.col("own") + F.row_number().over(by))
    return ranked.where("rank <= prefix").select(F.col("feature").alias("key"), F.col("n").cast("long").alias("n"), "rank", "doc_id")


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row: the smallest id reachable by links, itself included."""
    membership, links, _ = jaccard_links(docs, width)
    comp = components(links).select(F.col("node").alias("class_id"), "component")
    return membership.join(small_or_not(comp), "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents; four fifths of the union of 5-word shingle sets."""
    from tallyline.llm.common import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
