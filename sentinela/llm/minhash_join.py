"""Near-duplicate texts by an inverted join on the coordinates of MinHash signatures.

Texts with equal shingle sets form one class. Every class is posted under each of its K (coordinate, value) pairs. Two sets
with a Jaccard index of 0.75 agree in about 0.75 K coordinates; a candidate must agree in T of them. With K = 32 and T = 8
a pair of 0.75 is missed with probability 4e-10, closer pairs with less. Candidates are confirmed on whole shingle sets.

Only connected classes are asked for, so work follows components, not pairs:

1. In every posting list each class meets the list's pivot, its smallest class: linear in the postings.
2. Lists of more than LONG classes are skipped, as in skip merging: a class with fewer than T long lists shares a short list
   with each of its partners, and of its short lists it needs only a prefix. Classes of one short list that are not
   connected yet meet one another, at most LONG of them.
3. Classes with T or more long lists may share long lists only. A shingle that no other of these classes has cannot be
   common to two of them, so a class of n shingles, s of them shared, can only be like one of up to s * (100 + p) / p - n
   shingles. Classes that this leaves without a partner drop out: texts around one frequent line, and loose members of
   a large group of copies. The others, by families of classes that share long lists, are dealt to blocks, and each two
   blocks of a family are compared whole, by counting common shingles, in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm.common import passes, stored
from sentinela.llm.components import components
from sentinela.llm.tokens import LOWER, mix, stretch_hashes, window_hashes, word_bounds, word_hashes

SHINGLE = 5
COORDINATES = 32
MATCHES = 8
LONG = 64
PERCENT = 75
CLASSES_PER_FILE = 4000
BLOCK = 256
WORDS = 1 << 18

SIGNATURE = "doc_id bigint, text_hash bigint, n_shingles bigint, class bigint, signature binary"
SHINGLES = "class bigint, shingles binary"
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin (n + 1 values)."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, at)
    words = word_hashes(data, starts, ends)
    where, hashes = window_hashes(words, first, SHINGLE)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    of = np.concatenate([np.searchsorted(first, where, "right") - 1, few])
    short = stretch_hashes(words, first[few], first[few + 1]) + count[few].astype(np.uint64)
    hashes = np.concatenate([hashes, mix(short)])
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    of, hashes = of[new], hashes[new]
    return hashes, np.searchsorted(of, np.arange(len(at)))


def _class_ids(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One value per shingle set: a mix of the sums of two functions of its shingles and of its size."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    one, two = one[cut[1:]] - one[cut[:-1]], two[cut[1:]] - two[cut[:-1]]
    return mix(one ^ mix(two + np.diff(cut).astype(np.uint64))).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in passes(batch):
            hashes, cut = _shingle_sets(data, at)
            size = np.diff(cut)
            some = np.flatnonzero(size)
            signatures = np.zeros((rows.num_rows, COORDINATES), np.uint32)
            if len(some):
                for c, seed in enumerate(_SEEDS):
                    values = ((hashes ^ (hashes >> np.uint64(29))) * seed) >> np.uint64(32)
                    signatures[some, c] = np.minimum.reduceat(values.astype(np.uint32), cut[some])
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("text_hash"), pa.array(size, pa.int64()), pa.array(_class_ids(hashes, cut)),
                pa.array([s.tobytes() for s in signatures], pa.binary())], ["doc_id", "text_hash", "n_shingles", "class", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, at in passes(batch):
            hashes, cut = _shingle_sets(data, at)
            yield pa.RecordBatch.from_arrays([
                pa.array(_class_ids(hashes, cut)),
                pa.array([hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["class", "shingles"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for of, packed in zip(batch.column("class").to_pylist(), batch.column("shingles"), strict=True):
            values = np.frombuffer(packed.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), of, np.int64)), pa.array(values)], ["class", "shingle"])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and coordinate; a posting key holds the coordinate above the value."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.int64)
        keys = values + (np.arange(COORDINATES, dtype=np.int64) << 32)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("class").to_numpy(), COORDINATES))], ["list", "class"])


def _enough_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("sa", "sb"))
        keep = (one == two).sum(axis=1) >= MATCHES
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("xa"), batch.column("xb"), strict=True):
                one, two = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([one, two]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


class _Join:
    """The classes of a corpus and the ways to test pairs of them."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        self.docs = docs
        self.signed = stored(docs.mapInArrow(_signatures, SIGNATURE))
        some = self.signed.filter("n_shingles > 0")
        self.classes = stored(some.groupBy("class").agg(
            F.min_by(F.struct("doc_id", "text_hash"), F.xxhash64("doc_id", "text_hash")).alias("row"),
            F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
        self.parts = 1 + self.classes.count() // CLASSES_PER_FILE
        posted = self.classes.select("class", "signature").mapInArrow(_post, "list bigint, class bigint")
        lists = stored(posted.groupBy("list").agg(F.count("*").alias("size"), F.min("class").alias("pivot")).filter("size > 1"), self.parts)
        self.postings = stored(posted.join(lists, "list"), self.parts)

    def sets(self, classes: DataFrame) -> DataFrame:
        """(class, shingles) of `classes` (class), whole sets, made from the text of one row of each."""
        wanted = classes.distinct().join(self.classes, "class")
        wanted = wanted.select(F.col("row.doc_id").alias("i"), F.col("row.text_hash").alias("h"))
        wanted = stored(wanted, self.parts)
        # a bit per wanted row, in at most WORDS words whatever their number, keeps most other texts from being shuffled
        word, bit = _bit_of("i", "h")
        bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
        word, bit = _bit_of("doc_id", "text_hash")
        near = self.docs.withColumn("word", word).join(F.broadcast(bits), "word")
        # the key depends on both inputs of this join, so that the semi-join is not planned before it
        near = near.withColumn("key", F.when(F.call_function("getbit", F.col("bits"), bit) == 1, F.col("text_hash"))).filter("key is not null")
        docs = near.join(wanted, near.doc_id.eqNullSafe(wanted.i) & (near.key == wanted.h), "left_semi")
        return stored(docs.select("doc_id", "text").mapInArrow(_sets, SHINGLES).dropDuplicates(["class"]), self.parts)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b) that agree in enough coordinates, and of them those whose whole sets are alike."""
        one = self.classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
        two = self.classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
        near = pairs.join(one, "a").join(two, "b")
        near = near.filter((100 * F.least("na", "nb")) >= (self.percent * F.greatest("na", "nb")))
        near = stored(near.select("a", "b", "sa", "sb").mapInArrow(_enough_matches, "a bigint, b bigint"), self.parts)
        sets = self.sets(near.select(F.col("a").alias("class")).union(near.select("b")))
        joined = near.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("xb")), "b")
        joined = joined.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("xa")), "a")
        return stored(joined.select("a", "b", "xa", "xb").mapInArrow(_confirm(self.percent), "a bigint, b bigint"), self.parts)

    def labelled(self, links: DataFrame) -> DataFrame:
        """Postings with the component each class belongs to so far, of lists that hold more than one component."""
        labels = components(links, self.parts)
        rows = self.postings.join(labels.withColumnRenamed("node", "class"), "class", "left")
        rows = rows.withColumn("label", F.coalesce("label", "class"))
        n_long = F.count_if(F.col("size") > LONG).over(Window.partitionBy("class")).alias("n_long")
        rows = stored(rows.select("list", "size", "pivot", "class", "label", n_long), self.parts)
        mixed = rows.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        return stored(rows.join(stored(mixed.select("list"), self.parts), "list"), self.parts)

    def in_short_lists(self, rows: DataFrame) -> DataFrame:
        """Pairs not connected yet of the same short list, for a prefix of the short lists of each class. Pairs with the
        list's pivot have been tested."""
        from_last = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("list")))
        rows = rows.filter(F.col("size") <= LONG).withColumn("k", from_last).filter(f"k > {MATCHES - 1} - n_long")
        return _unconnected(rows.filter("class <> pivot"))

    def able(self, rows: DataFrame) -> DataFrame:
        """(class, n, shingles) of classes with enough long lists whose shared shingles allow a partner."""
        classes = stored(rows.filter((F.col("size") > LONG) & (F.col("n_long") >= MATCHES)).select("class").distinct(), self.parts)
        sets = self.sets(classes)
        shingles = sets.mapInArrow(_each_shingle, "class bigint, shingle bigint")
        alone = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.first("class").alias("class")).filter("n = 1")
        alone = alone.groupBy("class").agg(F.count("*").alias("alone"))
        sized = classes.join(self.classes.select("class", "n"), "class").join(alone, "class", "left")
        shared = F.col("n") - F.coalesce("alone", F.lit(0))
        most = F.floor(shared * (100 + self.percent) / self.percent) - F.col("n")
        some = stored(sized.filter(100 * most >= self.percent * F.col("n")).select("class", "n"), self.parts)
        return stored(some.join(sets, "class"), self.parts)

    def family_links(self, rows: DataFrame) -> DataFrame:
        """Links between classes of different components that share long lists only."""
        able = self.able(rows)
        rows = stored(rows.filter(F.col("size") > LONG).join(able.select("class"), "class").select("list", "class", "label"), self.parts)
        heads = stored(rows.groupBy("list").agg(F.min("class").alias("head")), self.parts)
        edges = rows.join(heads, "list").select(F.col("class").alias("a"), F.col("head").alias("b"))
        members = components(edges, self.parts).select(F.col("node").alias("class"), F.col("label").alias("family"))
        members = stored(members.join(rows.select("class", "label").distinct(), "class"), self.parts)
        blocks = members.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
        blocks = stored(blocks, self.parts)
        dealt = members.join(blocks, "family").join(able, "class")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), "blocks"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        dealt = dealt.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "class", "label", "n", "shingles")
        return stored(dealt.groupBy("family", "low", "high").applyInArrow(_block_links(self.percent), "a bigint, b bigint"), self.parts)


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links that join the components of two blocks, counted by products of class-by-shingle matrices."""
        ids, labels, n = (table.column(c).to_numpy() for c in ("class", "label", "n"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        every = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, which, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times[which] > 1
        of, column = of[shared], np.unique(which[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (first, first + width))
            part = np.zeros((len(sets), width), np.float32)
            part[of[a:b], column[a:b] - first] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        alike = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        one, two = np.nonzero(np.triu(alike & (labels[:, None] != labels[None, :]), 1))
        top = {int(x): int(x) for x in labels}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        found = []
        for i, j in zip(one.tolist(), two.tolist(), strict=True):
            x, y = root(int(labels[i])), root(int(labels[j]))
            if x != y:
                top[x] = y
                found.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _bit_of(doc_id: str, text_hash: str) -> tuple[Column, Column]:
    """The word, of WORDS, and the bit in it that stand for a row."""
    mixed = F.xxhash64(doc_id, text_hash)
    return F.pmod(mixed, F.lit(WORDS)), F.pmod(F.shiftright(mixed, 32), F.lit(64)).cast("int")


def _unconnected(rows: DataFrame) -> DataFrame:
    """Pairs of one list and of different components."""
    one = rows.select("list", "class", "label")
    two = rows.select("list", F.col("class").alias("other"), F.col("label").alias("label2"))
    return _ordered(one.join(two, "list").filter("label < label2").select("class", "other"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text; other columns are ignored).

    Rows are linked when 100 * |A and B| >= percent * |A or B| for their sets of five-word shingles (A to Z lower-cased; a
    text of one to four words is one shingle). component_id is the smallest doc_id reachable, kept is doc_id = component_id.
    Null and empty texts, and texts of white space, have no shingles: each is its own component and kept. Repeated rows are
    in one component, and all rows with its smallest id are kept. A null id is never smallest; such a row is kept only if
    no row of its component has an id. An empty table gives an empty one. For 75 percent and more, see the module text.
    """
    return decisions(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def decisions(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The columns of `near_duplicates` with text_hash and first, for every row of `docs`.

    first is true for one (doc_id, text_hash) of each component, the smallest with null ids last, and for rows without
    shingles. Unlike kept, it tells apart rows of one id and rows without id.
    """
    if percent < PERCENT:
        raise ValueError(f"the number of matching coordinates is set for {PERCENT} percent and more")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    join = _Join(docs.withColumn("text_hash", F.xxhash64("text")), percent)
    first = join.postings.filter("class <> pivot").select("class", F.col("pivot").alias("other"))
    found = join.links(_ordered(first))
    rows = join.labelled(found)
    found = found.unionByName(join.links(join.in_short_lists(rows))).unionByName(join.family_links(rows))
    labels = components(found, join.parts).withColumnRenamed("node", "class")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = join.signed.filter("n_shingles > 0").groupBy("class").agg(F.min(order).alias("least")).join(labels, "class", "left")
    least = stored(least.select("class", "least", F.coalesce("label", "class").alias("label")))
    smallest = stored(least.groupBy("label").agg(F.min("least").alias("smallest")))
    of_class = least.join(smallest, "label").select("class", F.col("smallest.doc_id").alias("component_id"), F.col("smallest.text_hash").alias("first_hash"))
    rows = join.signed.select("doc_id", "text_hash", "n_shingles", "class").join(stored(of_class), "class", "left")
    some = F.col("n_shingles") > 0
    component = F.when(some, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    first = ~some | (kept & (F.col("text_hash") == F.col("first_hash")))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"), first.alias("first"))
