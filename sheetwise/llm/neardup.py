"""Near-duplicate detection with bottom-k sketches of one hash function.

A document is the set of its distinct word shingles; two documents are linked
when the Jaccard similarity of their sets is at least 0.8, and a component is
what links connect.

1. One pass hashes every whole text: size of the set, a 128-bit signature of it,
   and its sketch, the ``k`` least hash values.  Documents with equal sets form a
   class; everything else works on one representative per class, so a group of
   exact copies of any size costs one partial aggregate.
2. Inverted lists over the retained values.  Of two sets with similarity 0.8 at
   least ``MIN_OVERLAP`` of the retained values are common (a binomial tail of
   about 1e-5 for two sets right at the threshold at k = 64, less above it; exact
   for sets that fit in the sketch).  With the values ordered from rare to
   frequent (exact document frequencies), they then share one of their first
   k - MIN_OVERLAP + 1, so only that many are indexed, and values of a single
   document are dropped.  Frequent values hardly ever get in.
3. Overlaps.  Short lists give candidate pairs; pairs whose sizes exclude 0.8 are
   dropped, then those whose union sketch (the k least values of both) estimates
   less than ``MIN_ESTIMATE``, five standard deviations below 0.8.
4. Long lists (large groups of near copies) are never paired off.  Documents that
   share long lists form families; a family is compared in blocks of
   ``BLOCK`` x ``BLOCK`` documents on their full sets inside a task, which gives
   only as many links as are needed to connect what belongs together in it.
5. All candidate pairs are verified on the full sets.  Links go to ``components``.

Shingles are compared by 64-bit hashes.  Defined results: null and blank texts
have an empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; a null doc_id cannot name a component, so such rows are
left alone (component_id null, kept true); repeated rows with one doc_id are one
document; empty tables give empty results; extra columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

K = 64
#: Of K retained values, for similarity 0.8: 34 of Binomial(64, 0.8).
MIN_OVERLAP = 34
MIN_ESTIMATE = 0.55
PERCENT = 80
SHORT_LIST = 32
BLOCK = 4096

SKETCH = "doc_id long, n long, s1 long, s2 long, sketch array<long>"


def document_sets(column: pa.Array, shingle: int):
    """(row, sorted distinct shingle hashes) of every text."""
    for first, texts in C.text_groups(column):
        data, offsets = C.joined(texts)
        starts, ends = C.split_words(data)
        words = C.word_hashes(data, starts, ends)
        edge = np.searchsorted(starts, offsets)
        hashes = C.chain(words, shingle)
        for i in range(len(texts)):
            a, b = int(edge[i]), int(edge[i + 1])
            if b - a >= shingle:
                yield first + i, np.unique(hashes[a:b - shingle + 1])
            else:
                yield first + i, C.chain(words[a:b], b - a) if b > a else words[:0]


def sketches(docs: DataFrame, shingle: int, k: int = K) -> DataFrame:
    def task(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, s in document_sets(batch.column("text"), shingle):
                rows.append((ids[i], len(s), int(s.sum().view(np.int64)) if len(s) else 0, int(C.mix64(s).sum().view(np.int64)) if len(s) else 0, s[:k].view(np.int64)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.list_(pa.int64())], strict=True)], names=["doc_id", "n", "s1", "s2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, SKETCH)


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set) of the documents in ``ids``, from their whole texts."""
    shared = C.key_filter(ids, "doc_id")

    def task(batches):
        for batch in batches:
            batch = batch.filter(pa.array(C.may_hold(shared.value, batch.column("doc_id").to_numpy())))
            column, of = batch.column("doc_id"), batch.column("text")
            rows = [(i, s.tobytes()) for i, s in document_sets(of, shingle)]
            yield pa.RecordBatch.from_arrays([column, pa.array([s for _, s in rows], pa.binary())], names=["doc_id", "set"])

    # no text is shuffled: the filter passes these documents and a few more
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return d.mapInArrow(task, "doc_id long, set binary").dropDuplicates(["doc_id"])


# ---- candidates ------------------------------------------------------------------

def index_rows(reps: DataFrame, k: int = K) -> DataFrame:
    """(value, doc_id, n): the values each representative is listed under, of
    lists with at least two documents."""
    e = reps.select("doc_id", "n", F.explode("sketch").alias("value"))
    shared = C.stored(e.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    rare = e.where(C.maybe(C.key_filter(shared, "value"), "value")).join(shared, "value").groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "value")).alias("v"))
    size = F.least(F.col("n"), F.lit(k))
    overlap = F.least(F.lit(MIN_OVERLAP), F.ceil(F.col("n") * PERCENT / 100))
    # values of one document only come first in the order and need no list
    listed = (size - overlap + 1) - (size - F.size("v"))
    i = rare.where(listed > 0).select("doc_id", "n", F.explode(F.slice(F.array_sort("v"), F.lit(1), listed.cast("int"))).alias("v"))
    return i.select("doc_id", "n", F.col("v.value").alias("value"))


def _near_in_size(a, b):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def short_list_pairs(lists: DataFrame) -> DataFrame:
    """(a, b), a > b, from lists of at most SHORT_LIST documents."""
    g = lists.where(F.col("size") <= SHORT_LIST).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n"))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(
        F.filter(F.slice(F.col("l"), F.lit(1), i), lambda y: _near_in_size(x["n"], y["n"])), lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))))
    return g.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()


def estimated(pairs: DataFrame, reps: DataFrame, k: int = K) -> DataFrame:
    """Pairs whose union sketch allows similarity 0.8."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    s = reps.select("doc_id", "sketch").where(C.maybe(C.key_filter(ids, "doc_id"), "doc_id"))
    d = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")

    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = set(x), set(y)
                # hashes were sorted as unsigned
                union = sorted(x | y, key=lambda v: v & 0xFFFFFFFFFFFFFFFF)[:k]
                both = x & y
                keep.append(sum(v in both for v in union) >= MIN_ESTIMATE * len(union))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return d.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    d = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")

    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return d.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def connect(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all similar documents of a block (side 0) or of two
    blocks (similar pairs across sides 0 and 1); pairs that are connected
    already are passed over."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(code, kind="stable")
    posting, starts = owner[order], np.searchsorted(code[order], np.arange(len(values) + 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    root, links = np.arange(n), []
    two = bool(side.any())
    for x in np.flatnonzero(side == 0) if two else range(n):
        mine = code[offsets[x]:offsets[x + 1]]
        length = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(posting[at], minlength=n)
        similar = 100 * common >= PERCENT * (sizes + sizes[x] - common)
        similar &= (side == 1) if two else (np.arange(n) < x)
        while True:
            left = np.flatnonzero(similar & (root != root[x]))
            if not len(left):
                break
            y = int(left[0])
            links.append((int(ids[x]), int(ids[y])))
            root[root == root[y]] = root[x]
    return links


def family_links(lists: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links inside the families of documents that share long lists."""
    spark = docs.sparkSession
    long_ = C.stored(lists.where(F.col("size") > SHORT_LIST).select("value", "doc_id"), "long")
    head = long_.groupBy("value").agg(F.min("doc_id").alias("head"))
    family = components(long_.join(head, "value").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    members = long_.select("doc_id").distinct().join(family.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("family"))
    size = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = C.stored(members.join(size, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "families")
    sets = full_sets(docs, members, shingle)
    # block i meets every block j: task (family, min, max)
    d = members.join(sets, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    d = d.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("own"), "doc_id", "set")

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        side = (table.column("own").to_numpy() != table.column("i").to_numpy()).astype(np.int8)
        links = connect(ids, sets, side)
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return d.groupBy("family", "i", "j").applyInArrow(task, "a long, b long")


# ---- the operator -----------------------------------------------------------------

def near_duplicates(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    all_ = C.stored(sketches(docs, shingle), "sketches")
    # stored, so that both sides of the join have shuffles of their own and Spark
    # can split a class that holds a large share of all rows
    classes = C.stored(all_.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "class-ids")
    known = C.stored(all_.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
                     .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes")
    reps = C.stored(all_.where("n > 0").join(known.where("rep = doc_id").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", "sketch").dropDuplicates(["doc_id"]), "reps")

    index = C.stored(index_rows(reps), "index")
    lists = C.stored(index.join(index.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"), "value"), "lists")
    pairs = C.stored(estimated(C.stored(short_list_pairs(lists), "candidates"), reps), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = C.stored(full_sets(docs, ids, shingle), "sets")
    links = verified(pairs, sets).unionByName(family_links(lists, docs, shingle))
    root = components(links)

    d = known.join(root, known.rep == root.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int) -> DataFrame:
    """One document of each component, with all its columns; of rows that repeat
    a doc_id one stays.  Only rows that may have to go are shuffled."""
    found = near_duplicates(docs, shingle).where("doc_id IS NOT NULL")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("kept").alias("kept"))
    touched = C.stored(rows.where("NOT kept OR rows > 1"), "touched")
    dropped, again = touched.where("NOT kept").select("doc_id"), touched.where("kept").select("doc_id")
    maybe = C.maybe(C.key_filter(touched, "doc_id"), "doc_id")

    def of(d: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return d.join(some, d["doc_id"] == some["doc_id"], how)

    rest = of(docs.where(maybe), dropped, "left_anti")
    single = of(rest, again, "left_anti")
    repeated = of(of(docs.where(maybe), again, "left_semi"), dropped, "left_anti").dropDuplicates(["doc_id"])
    return docs.where(~maybe).unionByName(single).unionByName(repeated)


QUERY_SHINGLE = 2


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return near_duplicates(C.table(spark, sf_dir, "documents"), QUERY_SHINGLE)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, min(root) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
