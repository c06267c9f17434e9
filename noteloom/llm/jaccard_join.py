"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's set holds the hashes of its distinct shingles (64 bits; an equal hash is taken for an equal shingle).
Two sets with Jaccard similarity of at least t share o >= ceil(t * n) shingles for either size n, so under any global
order of all shingles their prefixes of n - o + 1 share one. Under several unrelated orders they share one in each.

1. Equal sets become one class; its row with the least id stands for it.
2. Documents filter. In the prefix that is longer by m = n / 10 under ascending hashes, similar sets share m shingles,
   so a document needs about that many prefix shingles that any other document has in its prefix. Passages shared by
   many documents are too short a part of each to pass; what passes are near copies, for which alone whole sets are
   laid out. There, a document needs o shared shingles in all.
3. Candidates. The first order is by frequency among what is left, then hash: prefixes hold the rarest shared shingles.
   Documents that share one form a bucket. Not all pairs of a bucket are
   made: a hub (the document with the fewest shingles of its own, which is the likeliest origin) meets the others, the found links are contracted to components, and only buckets that still hold two
   components go on, with sixteen times as many hubs each round, until none is left. Every pair of a bucket has then
   been tested, or its documents are connected, so components are exact. No cap applies.
4. A candidate pair must also share prefix shingles under the second (descending hashes) and third order (hashes with
   halves swapped) before the exact intersection of the whole sets decides.
5. Links are contracted by label propagation with pointer jumping on tables, never on the driver.

Hot shingles, classes, hubs and components are only aggregated with partial sums or joined, and joins may be split.
Rounds end in written tables.
What is taken for equal by hash: a shingle's words by one 64-bit hash, a set by its size and two 64-bit hashes of its
shingles' hashes, a text (for repeated rows) by one 64-bit hash. Text null or without words has an empty set and is its own component. Repeated rows
are separate documents with equal sets. Equal or null doc_ids do no harm: rows have ids of their own. An empty table
gives none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, keep, let, split_words, unused


def shingles(text: Column, words: int = 5) -> Column:
    """Sorted array<long> of the distinct shingles' hashes; fewer words make one shingle of all."""

    def hashed(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(words)]))
        return F.when(F.size(w) >= words, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    return F.sort_array(F.array_distinct(let(split_words(F.coalesce(text, F.lit(""))), hashed)))


def _needed(n: Column, t: int) -> Column:
    """ceil(t * n / 100)"""
    return F.floor((n.cast("long") * t + 99) / 100).cast("int")


def _prefix(sets: Column, n: Column, t: int, more: Column | int = 1) -> Column:
    return F.slice(sets, F.lit(1), (n - _needed(n, t) + more).cast("int"))


def connected(edges: DataFrame, rows: int) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b), about `rows`: comp is the least node of each component."""
    both = keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges", rows)
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels", rows)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        new = keep(step.join(jump, "to").select("node", F.least("to", "far").alias("comp"), (F.least("to", "far") != F.col("comp")).alias("moved")), "labels", rows)
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels.select("node", "comp")


#: The documents filter demands this percentage of a set beyond the plain prefix.
MORE = 10


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80, broadcast_rows: int = 300_000):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.words, self.t, self.broadcast_rows = words, percent, broadcast_rows
        self.spark = docs.sparkSession

    def sets(self, docs: DataFrame) -> DataFrame:
        s = docs.select("doc_id", F.xxhash64("text").alias("h"), shingles(F.col("text"), self.words).alias("set"))
        return s.select("doc_id", "h", "set", F.coalesce(F.size("set"), F.lit(0)).alias("n"), F.xxhash64("set").alias("k1"), F.xxhash64(F.lit(1), "set").alias("k2"))

    def classes(self) -> DataFrame:
        """One row per document: rid, doc_id, h (a hash of its text), n, and node, the least rid with an equal set (null for an empty set)."""
        longer = F.greatest(F.lit(1), F.floor(F.col("n").cast("long") * MORE / 100).cast("int"))
        self.rows = keep(self.sets(self.docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "h", "n", "k1", "k2", _prefix(F.col("set"), F.col("n"), self.t, longer).alias("prefix")), "sets")
        filled = self.rows.where("n > 0").select("rid", "doc_id", "h", "n", "k1", "k2")
        least = filled.groupBy("n", "k1", "k2").agg(F.min("rid").alias("node"))
        members = filled.join(least, ["n", "k1", "k2"]).select("rid", "doc_id", "h", "n", "k1", "k2", "node")
        empty = self.rows.where("n = 0").select("rid", "doc_id", "h", "n", "k1", "k2", F.lit(None).cast("long").alias("node"))
        return keep(members.union(empty), "members", self.rows.count())

    def survivors(self, members: DataFrame) -> DataFrame:
        """Classes with enough prefix shingles in common with other classes: node, doc_id, n, k1, k2.

        Only a class's head lays out its prefix, so a shingle that is met twice belongs to two classes.
        """
        heads = members.where("rid = node").select("node", "doc_id", "n", "k1", "k2")
        n = heads.count()
        hint = F.broadcast if n <= self.broadcast_rows else lambda df: df
        e = self.rows.join(hint(heads.select(F.col("node").alias("rid"))), "rid", "left_semi").select("rid", F.explode("prefix").alias("token"))
        shared = e.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
        counts = e.join(shared, "token", "left_semi").groupBy("rid").agg(F.count(F.lit(1)).alias("c"))
        enough = F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("n").cast("long") * self.t * MORE / 10000))
        out = keep(heads.join(counts.withColumnRenamed("rid", "node"), "node").where(enough).drop("c"), "survivors")
        discard(self.rows)
        return out

    def whole_sets(self, heads: DataFrame) -> DataFrame:
        """node, n, set, swapped (the third order's prefix, as swapped hashes) of the surviving classes."""
        n = heads.count()
        hint = F.broadcast if n <= self.broadcast_rows else lambda df: df
        ids = heads.select(F.col("doc_id").alias("d")).distinct()
        some = self.docs.join(hint(ids), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        keys = heads.select("node", F.col("doc_id").alias("d"), "n", "k1", "k2")
        s = self.sets(some).join(hint(keys), ["n", "k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("d")))
        swapped = F.sort_array(F.transform("set", lambda x: F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))))
        out = keep(s.select("node", "n", "set", _prefix(swapped, F.col("n"), self.t).alias("swapped")), "whole")
        if out.count() != n:  # rows repeated with their doc_id
            once = keep(out.dropDuplicates(["node"]), "whole")
            discard(out)
            out = once
        return out

    def verified(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """The links (a, b) among pairs (a, b)."""
        x = whole.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("set").alias("s1"), F.col("swapped").alias("w1"))
        y = whole.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("set").alias("s2"), F.col("swapped").alias("w2"))
        top = lambda s, n: F.slice(s, _needed(n, self.t).cast("int"), n - _needed(n, self.t) + 1)
        c = F.col
        both = pairs.join(x, "a").join(y, "b")
        long_enough = F.least("n1", "n2").cast("long") * 100 >= F.greatest("n1", "n2").cast("long") * self.t
        second = F.arrays_overlap(top(c("s1"), c("n1")), top(c("s2"), c("n2")))
        third = F.arrays_overlap("w1", "w2")
        common = F.when(long_enough & second & third, F.size(F.array_intersect("s1", "s2"))).otherwise(0)
        return both.where(common.cast("long") * (100 + self.t) >= (c("n1") + c("n2")).cast("long") * self.t).select("a", "b")

    def buckets(self, whole: DataFrame) -> DataFrame:
        """node, n, s, rank, token: the prefixes under the first order of those that still have enough shared shingles.

        First order: documents that hold the shingle, then its hash. Shingles of one document lead and need no rows,
        so a set with s shared shingles has s - o + 1 rows, and they are its rarest. s: the shared shingles from this one
        on, which is what a pair can have in common if this is its first common shingle; each pair is met at its first.
        """
        need = _needed(F.col("n"), self.t)
        e = whole.select("node", F.explode("set").alias("token"))
        shared = keep(e.join(e.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "token"), "shared")
        sizes = whole.select("node", "n")
        alive = lambda df: df.groupBy("node").agg(F.count(F.lit(1)).alias("s")).join(sizes, "node").where(F.col("s") >= need)
        some = shared.join(alive(shared).select("node"), "node", "left_semi")
        still = some.groupBy("token").agg(F.count(F.lit(1)).alias("left")).where("left > 1").select("token")
        again = keep(some.join(still, "token", "left_semi"), "again")
        discard(shared)
        place = F.row_number().over(Window.partitionBy("node").orderBy("c", "token"))
        odd = F.floor((F.col("n") - F.col("s")) * 1000 / F.col("n")).cast("long")
        rank = F.shiftleft(odd, 32).bitwiseOR(F.xxhash64("node").bitwiseAND((1 << 32) - 1)).alias("rank")
        rows = again.withColumn("place", place).join(alive(again), "node").where(F.col("place") <= F.col("s") - need + 1)
        out = keep(rows.select("node", "n", (F.col("s") - F.col("place") + 1).cast("int").alias("s"), rank, "token"), "buckets")
        discard(again)
        return out

    def components(self, whole: DataFrame) -> DataFrame:
        """(node, comp) for all classes of whole."""
        buckets = self.buckets(whole)
        size = whole.count()
        labels = whole.select("node", F.col("node").alias("comp"))
        possible = lambda s, n, m: s.cast("long") * (100 + self.t) >= (n + m).cast("long") * self.t  # noqa: E731  no more than those from here on can be common
        hubs, tested, n_tested, round_, left = 1, None, 0, 0, None
        while True:
            at = buckets.join(labels, "node")
            open_ = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("lo_n")).where("lo <> hi").select("token", "lo_n")
            now = at.join(open_, "token").where(possible(F.col("s"), F.col("n"), F.col("lo_n"))).drop("lo_n")
            if round_:
                now = keep(now, "buckets", max(left, size))
                left = now.count()
                if not left:
                    return labels
            deal = F.pmod(F.xxhash64("node"), F.lit(hubs))
            least = now.groupBy("token", deal.alias("deal")).agg(F.min("rank").alias("rank")).select("token", "rank")
            hub = now.join(least, ["token", "rank"]).select("token", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("s").alias("hub_s"), F.col("comp").alias("hub_comp"))
            fit = (F.col("comp") != F.col("hub_comp")) & (F.least("n", "hub_n").cast("long") * 100 >= F.greatest("n", "hub_n").cast("long") * self.t) & possible(F.least("s", "hub_s"), F.col("n"), F.col("hub_n"))
            pairs = now.join(hub, "token").where(fit).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = keep(pairs, "pairs", left * min(hubs, 16) + n_tested if round_ else None)
            n_tested += pairs.count()
            links = keep(self.verified(pairs, whole), "links")  # reads whole sets: as many tasks as they need
            n_links = links.count()
            tested = pairs if tested is None else tested.unionByName(pairs)
            if n_links:
                comp = labels.select(F.col("node").alias("x"), "comp")
                moved = links.join(comp, F.col("a") == F.col("x")).select(F.col("comp").alias("ca"), "b").join(comp, F.col("b") == F.col("x")).select("ca", F.col("comp").alias("cb"))
                new = connected(moved.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), n_links)
                new = new.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
                labels = keep(labels.join(new, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components", size)
            rest = now.select("token", "node", "n", "s", "rank").join(hub.select("token", F.col("hub").alias("node")), ["token", "node"], "left_anti")
            left = buckets.count() if left is None else left
            buckets, hubs, round_ = keep(rest, "rest", left), hubs * 16, round_ + 1


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, h, n, comp (null for an empty set) for every row."""
    join = Join(docs, words, percent)
    members = join.classes()
    whole = join.whole_sets(join.survivors(members))
    labels = join.components(whole)
    return members.join(labels, "node", "left").select("doc_id", "h", "n", F.coalesce("comp", "node").alias("comp"))


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row of docs (doc_id, text)."""
    at = _labelled(docs, words, percent)
    least = at.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return at.join(least, "comp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with its columns and one document of each component: the one of least doc_id (null first), then of least text hash.

    Documents with an empty set all stay. Rows equal in doc_id and text are one document, of which one row stays.
    """
    at = _labelled(docs, words, percent)
    best = at.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    gone = at.join(best, "comp").where(~F.struct("doc_id", "h").eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct()
    own = unused(docs, "own")
    left = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    left = left.join(gone.toDF(*(theirs := [unused(docs, "d"), unused(docs, "h")])), F.col("doc_id").cast("long").eqNullSafe(F.col(theirs[0])) & (F.col(own) == F.col(theirs[1])), "left_anti")
    if at.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)


#: The same rows in DuckDB, by counting common shingles of all pairs.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), t AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM t a JOIN t b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common WHERE 100 * c >= 80 * (nx + ny - c)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x
)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
