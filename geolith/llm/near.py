"""MinHash near-dedup: banded DartMinHash signatures, exact verification, connected components.

Documents with the same words in the same order are one representative before
any pair is formed. Documents that share a band meet one of them only, the hub, which
a hash draws anew for each band. Where the components found that way leave a
band's documents apart, its rows are dealt in blocks to tasks, which compare those
outside the band's largest component with all that they are apart from: by their
signatures first, then, where these leave doubt, by their whole sets. A task
returns the edges that join components, never the pairs that it looked at. A pair
is skipped only if its documents are in one component already or agree in fewer
coordinates than a pair at the similarity does but once in three million times, so
the components are those of all verified candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.bpe import slices
from geolith.llm.common import TEXTS, groups_of, let_go, small_batches, written
from geolith.llm.graph import components
from geolith.llm.minhash import Shingler, bands, mix, planes, signatures

#: Bands come from the first BANDS x ROWS coordinates; all are compared where a pair is in doubt.
SIZE, SIMILARITY, COORDINATES, BANDS, ROWS = 5, 0.8, 192, 25, 5
#: Bits of each coordinate that are compared, and standard deviations below the expected agreement that are still in doubt.
PLANES, DOUBT = 8, 5.0
#: Rows and shingles of a block, rows of a tile, bytes of text that are signed together.
BLOCK, GRAMS, TILE, SIGNED = 4096, 1 << 20, 256, 1 << 20


def texts_of(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of a bounded size, with the place of their first; null counts as empty."""
    column = pc.fill_null(column, "")
    for lo, hi in slices(np.asarray(pc.binary_length(column)).astype(np.int64) + 4096, SIGNED):
        yield lo, column.slice(lo, hi - lo)


def sign(docs: DataFrame, size: int, k: int, n_bands: int, rows: int, weighted: bool) -> DataFrame:
    """``uid, doc_id, md5, words, n, bands, planes`` of every row; ``words`` hashes the word sequence to 128 bits."""
    shape = "uid long, doc_id long, md5 binary, words binary, n int, bands array<bigint>, planes array<bigint>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        s = Shingler(size)
        for batch in batches:
            for lo, texts in texts_of(batch.column("text")):
                words = s.words(texts)
                found = [np.unique(s.shingles(w), return_counts=True) for w in words]
                n = np.array([len(g) for g, _ in found])
                flat = np.concatenate([np.empty(0, np.uint64), *(g for g, _ in found)])
                weight = np.concatenate([np.empty(0), *(c for _, c in found)]) if weighted else None
                sig = signatures(flat, weight, np.repeat(np.arange(len(n)), n), len(n), k)
                total = np.array([int(c.sum()) for _, c in found]) if weighted else n
                part = batch.slice(lo, len(texts))
                columns = [*(part.column(c) for c in ("uid", "doc_id", "md5")), pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary()), pa.array(total, pa.int32())]
                columns += [_lists(bands(sig[:, : n_bands * rows], rows)), _lists(planes(sig, PLANES))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in shape.split(", ")])
        let_go()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows_in = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("md5"), text.alias("text"))
    with small_batches(docs.sparkSession, TEXTS):
        return written(rows_in.mapInArrow(each, shape), "signatures")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, weighted: bool, repeats: bool) -> DataFrame:
    """``uid, grams``: the sorted shingle hashes of the ``wanted`` rows (``uid, doc_id, md5``); with ``weighted``, numbered repetitions."""

    def grams(words: np.ndarray, s: Shingler) -> np.ndarray:
        found, count = np.unique(s.shingles(words), return_counts=True)
        if weighted:
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = np.sort(mix(np.repeat(found, count) + nth.astype(np.uint64)))
        return found.view(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(size)
        for batch in batches:
            for lo, texts in texts_of(batch.column("text")):
                found = [grams(w, s) for w in s.words(texts)]
                ends = np.cumsum([0, *(len(g) for g in found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(lo, len(texts)), lists], names=["uid", "grams"])
        let_go()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.unhex(F.md5(text)).alias("_m"), text.alias("text"))
    found = texts.join(wanted, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_m") == F.col("md5"))).select("uid", "text")
    if repeats:  # of equal rows one is enough
        found = found.groupBy("uid").agg(F.min("text").alias("text"))
    with small_batches(docs.sparkSession, TEXTS):
        return written(found.mapInArrow(each, "uid long, grams array<bigint>"), "grams")


def least_agreement(similarity: float, k: int, doubt: float | None) -> float:
    """The number of coordinates in which a pair at the similarity agrees, less ``doubt`` standard deviations; without doubt every pair is looked at."""
    if doubt is None:
        return 0.0
    p = similarity + (1 - similarity) * 2.0**-PLANES
    return k * p - doubt * (k * p * (1 - p)) ** 0.5


def agreement(one: Column, two: Column, k: int) -> Column:
    """In how many coordinates the low bits of two signatures agree, from their bit planes."""
    differ = F.lit(0)
    for lane in range(-(-k // 64)):
        bits = F.lit(0).cast("long")
        for at in range(lane * PLANES, (lane + 1) * PLANES):
            bits = bits.bitwiseOR(F.get(one, F.lit(at)).bitwiseXOR(F.get(two, F.lit(at))))
        differ = differ + F.bit_count(bits)
    return F.lit(k) - differ


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a, b``) whose sets reach the similarity."""
    one = sets.select(F.col("uid").alias("_u"), F.col("grams").alias("_x"))
    two = sets.select(F.col("uid").alias("_v"), F.col("grams").alias("_y"))
    both = pairs.join(one, F.col("a") == F.col("_u")).join(two, F.col("b") == F.col("_v"))
    both = both.withColumn("_same", F.size(F.array_intersect("_x", "_y")))
    return both.where(F.col("_same") >= similarity * (F.size("_x") + F.size("_y") - F.col("_same"))).select("a", "b")


class _Group:
    """The rows of one pair of blocks of a band, as arrays."""

    def __init__(self, parts: list[pa.RecordBatch], i: int, j: int) -> None:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: whole.column(c).chunk(0)
        self.uid, self.root, self.n, self.own = (column(c).to_numpy() for c in ("uid", "root", "n", "own"))
        self.outside = column("outside").to_numpy(zero_copy_only=False)
        self.bands, self.planes = (np.asarray(column(c).flatten()).reshape(len(self.uid), -1) for c in ("bands", "planes"))
        self.band, self.across = column("pos")[0].as_py(), i != j
        if "grams" in whole.schema.names:
            grams = column("grams")
            self.at, self.grams = np.asarray(grams.offsets).astype(np.int64), np.asarray(grams.values).view(np.uint64)

    def doubtful(self, similarity: float, least: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``a, b, agreement`` of pairs in different components, with ``a`` outside the largest, that share no earlier band."""
        rows = np.flatnonzero(self.outside)
        for lo in range(0, len(rows), TILE):
            a = rows[lo : lo + TILE]
            for from_ in range(0, len(self.uid), BLOCK):
                b = np.arange(from_, min(from_ + BLOCK, len(self.uid)))
                ok = self.root[a][:, None] != self.root[b]
                ok &= ~self.outside[b] | (self.uid[b] > self.uid[a][:, None])
                na, nb = self.n[a][:, None], self.n[b]
                ok &= np.minimum(na, nb) >= similarity * np.maximum(na, nb)
                if self.across:
                    ok &= self.own[a][:, None] != self.own[b]
                p, q = np.nonzero(ok)
                for some in range(0, len(p), 1 << 15):
                    x, y = a[p[some : some + (1 << 15)]], b[q[some : some + (1 << 15)]]
                    alike = np.full(len(x), k, np.int64)
                    for lane in range(-(-k // 64)):
                        bits = np.zeros(len(x), np.int64)
                        for at in range(lane * PLANES, (lane + 1) * PLANES):
                            bits |= self.planes[x, at] ^ self.planes[y, at]
                        alike -= np.bitwise_count(bits.view(np.uint64))
                    on = np.flatnonzero(alike >= least)
                    on = on[np.argmax(self.bands[x[on]] == self.bands[y[on]], axis=1) == self.band] if len(on) else on
                    if len(on):
                        yield x[on], y[on], alike[on]

    def joined(self, similarity: float, least: float, k: int) -> list[tuple[int, int]]:
        """Edges that join the components of doubtful pairs which reach the similarity."""
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for a, b, alike in self.doubtful(similarity, least, k):
            order = np.lexsort((-alike, a))
            a, b = a[order], b[order]
            cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(a)]):
                one = int(a[lo])
                mine = self.grams[self.at[one] : self.at[one + 1]]
                for some in range(lo, hi, 64):
                    root = top(int(self.root[one]))
                    others = [x for x in b[some : min(hi, some + 64)].tolist() if top(int(self.root[x])) != root]
                    if not others:
                        continue
                    sets = [self.grams[self.at[x] : self.at[x + 1]] for x in others]
                    size = np.array([len(x) for x in sets])
                    flat = np.concatenate(sets)
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    same = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
                    for x in np.flatnonzero(same >= similarity * (size + len(mine) - same)).tolist():
                        p, q = top(int(self.root[one])), top(int(self.root[others[x]]))
                        if p != q:
                            up[max(p, q)] = min(p, q)
                            out.append((int(self.uid[one]), int(self.uid[others[x]])))
        return out


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row with every block of its band (``_i, _j``), in the order in which tasks take the groups."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    dealt = dealt.withColumns({"_i": F.least("own", "_other"), "_j": F.greatest("own", "_other")}).drop("_other")
    return dealt.repartition("band", "_i", "_j").sortWithinPartitions("band", "_i", "_j")


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``pos, band, uid, n, root, outside``: the rows of bands with several components; ``outside`` the largest."""
    labelled = members.select("pos", "band", "uid", "n").join(joined, F.col("uid") == F.col("node"), "left")
    labelled = written(labelled.select("pos", "band", "uid", "n", F.coalesce("root", "uid").alias("root")), "labelled")
    sizes = labelled.groupBy("band", "root").agg(F.count("*").alias("_c"))
    most = sizes.groupBy("band").agg(F.max_by("root", F.struct("_c", "root")).alias("_major"), F.count("*").alias("_parts")).where("_parts > 1")
    most = written(most.select(F.col("band").alias("_b"), "_major"), "majorities")
    return labelled.join(most, F.col("band") == F.col("_b")).withColumn("outside", F.col("root") != F.col("_major")).drop("_b", "_major")


def _edges(members: DataFrame, joined: DataFrame, signed: DataFrame, sets: DataFrame, similarity: float, k: int, doubt: float | None) -> DataFrame:
    """Edges (``a, b``) that join components which verified pairs of a band link."""
    least = least_agreement(similarity, k, doubt)
    rows = _open(members, joined)
    sketch = signed.select(F.col("uid").alias("_id"), "bands", "planes")
    rows = written(rows.join(sketch, F.col("uid") == F.col("_id")).drop("_id"), "open")

    def in_blocks(some: DataFrame, blocks: Column) -> DataFrame:
        sizes = written(some.groupBy(F.col("band").alias("_b")).agg(blocks.alias("_blocks")), "blocks")
        return _dealt(some.join(sizes, F.col("band") == F.col("_b")).drop("_b"), F.col("_blocks"))

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, i, j), parts in groups_of(batches, ["band", "_i", "_j"]):
            group = _Group(parts, i, j)
            on = np.zeros(len(group.uid), bool)
            for a, b, _ in group.doubtful(similarity, least, k):
                on[a] = on[b] = True
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), band, np.int64)), pa.array(group.uid[on])], names=["band", "uid"])
        let_go()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), parts in groups_of(batches, ["band", "_i", "_j"]):
            if found := _Group(parts, i, j).joined(similarity, least, k):
                yield pa.RecordBatch.from_arrays([pa.array([e[x] for e in found], pa.int64()) for x in (0, 1)], names=["a", "b"])
        let_go()

    count = F.ceil(F.count("*") / BLOCK)
    light = in_blocks(rows, count).mapInArrow(doubtful, "band long, uid long")
    light = written(light.distinct().select(F.col("band").alias("_c"), F.col("uid").alias("_u")), "doubtful")
    rows = rows.join(light, (F.col("band") == F.col("_c")) & (F.col("uid") == F.col("_u")), "left_semi")
    rows = rows.join(sets.select(F.col("uid").alias("_id"), "grams"), F.col("uid") == F.col("_id")).drop("_id")
    with small_batches(rows.sparkSession, TEXTS):
        return written(in_blocks(rows, F.greatest(count, F.ceil(F.sum("n") / GRAMS))).mapInArrow(join, "a long, b long"), "joined")


def near_duplicates(
    docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, k: int = COORDINATES, n_bands: int = BANDS, rows: int = ROWS, weighted: bool = False, doubt: float | None = DOUBT
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept, text_md5``.

    Similarity is the Jaccard similarity of the sets of ``size`` consecutive words
    (all words of a shorter text); with ``weighted``, of the multisets. Links are
    the pairs with at least ``similarity``; ``class_id`` is the least doc_id that
    links lead to and ``kept`` marks one row, that of the least doc_id, of those
    with the same doc_id the one with the least md5. Of ``k`` coordinates the first
    make ``n_bands`` bands of ``rows``: at 25 of 5, a pair at 0.8 is missed once in
    20,000 times. ``doubt=None`` verifies every pair of a band that is still apart,
    whatever its signatures say.

    Texts with the same words in the same order are in one class, among them all
    that have no words (null, empty, blank). Rows that repeat a doc_id are in one
    class if their texts are. A null doc_id is never a class_id unless the class
    has no other. An empty table gives an empty result. Columns besides doc_id and
    text are not read.
    """
    signed = sign(docs, size, k, n_bands, rows, weighted)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "md5", "uid")).alias("best")
    reps = written(signed.groupBy("words").agg(F.min("uid").alias("rep"), best, F.count("*").alias("copies")), "representatives")
    chosen = signed.join(reps.select("rep"), F.col("uid") == F.col("rep"), "left_semi").where("n > 0")

    in_bands = chosen.select("uid", "n", F.posexplode("bands").alias("pos", "band"))
    drawn = F.xxhash64("band", "uid")
    hubs = in_bands.groupBy("band").agg(F.min_by("uid", drawn).alias("hub"), F.min_by("n", drawn).alias("hub_n"), F.count("*").alias("_c")).where("_c > 1")
    hubs = written(hubs.select(F.col("band").alias("_b"), "hub", "hub_n"), "hubs")
    members = written(in_bands.join(hubs, F.col("band") == F.col("_b")).select("pos", "band", "uid", "n", "hub", "hub_n"), "members")

    alike = F.least("n", "m") >= similarity * F.greatest("n", "m")
    pairs = members.where("uid <> hub").select(F.least("hub", "uid").alias("a"), F.greatest("hub", "uid").alias("b"), "n", F.col("hub_n").alias("m"))
    pairs = written(pairs.where(alike).select("a", "b").distinct(), "pairs")
    sketches = [signed.select(F.col("uid").alias(f"_u{c}"), F.col("planes").alias(f"_p{c}")) for c in "ab"]
    likely = pairs.join(sketches[0], F.col("a") == F.col("_ua")).join(sketches[1], F.col("b") == F.col("_ub"))
    likely = written(likely.where(agreement(F.col("_pa"), F.col("_pb"), k) >= least_agreement(similarity, k, doubt)).select("a", "b"), "likely")

    wanted = signed.join(members.select(F.col("uid").alias("_u")).distinct(), F.col("uid") == F.col("_u"), "left_semi").select("uid", "doc_id", "md5")
    repeats = not signed.groupBy("doc_id", "md5").count().where("count > 1").isEmpty()
    sets = shingle_sets(docs, wanted, size, weighted, repeats)
    links = written(verified(likely, sets, similarity), "links")
    joined = components(links)
    edges = _edges(members, joined, signed, sets, similarity, k, doubt)
    if not edges.isEmpty():
        joined = components(links.unionByName(edges))

    labelled = reps.join(joined, F.col("rep") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "rep"))
    labelled = written(labelled.select("words", "best", "copies", "_root"), "labelled")
    classes = written(labelled.groupBy("_root").agg(F.min("best").alias("_best"), F.sum("copies").alias("class_size")).withColumnRenamed("_root", "_r"), "classes")
    by_words = written(labelled.join(classes, F.col("_root") == F.col("_r")).select(F.col("words").alias("_w"), "_best", "class_size"), "by_words")
    out = signed.select("uid", "doc_id", "words", "md5").join(by_words, F.col("words") == F.col("_w"))
    return out.select("doc_id", F.col("_best.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("_best.uid")).alias("kept"), F.lower(F.hex("md5")).alias("text_md5"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
