"""Near-duplicate documents: Jaccard join of word shingles by grouped prefixes.

Every text becomes the set of its distinct word shingles, as 64-bit hashes. Texts with equal sets are one node. All sets
are put in one order: shingles by hash, those in many sets last. Two sets that are similar enough share a shingle
among their first p; nodes of equal size with the same p shingles form a group, and groups meet on shared shingles.

Large groups are not expanded into pairs. First each member is held against one centre of its group, and each group
against one centre of each shared shingle (at most as many pairs as there are prefix entries). Links found make
components. Then only pairs from different components remain, all of which are checked, so that the components are
exactly those of all links: a pair left out joins two nodes that are already in one component.

Pairs are filtered by size and by the place of what they share, then by the smallest hashes of both sets (a lower bound of
their difference), and last verified on the whole sets. None of these filters drops a similar pair.

Defined results: a NULL text or one without words has an empty set, no links, and is its own component. Repeated rows
and equal texts are linked. With fewer words than a shingle has, the whole sequence is the only shingle. Ids may repeat
or be NULL: the smallest id that is not NULL names the component. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.llm.common import all_written_alone, bound_arrow_batches, packed_rows, returning_memory, row_keys, salted_join, struct_type, written, written_alone
from cleanframe.llm.components import components

#: Rows of a list of keys that may be broadcast: at most some tens of MB.
BROADCAST_ROWS = 500_000
#: A shingle among the first hashes of more sets than this goes to the end of the order.
COMMON = 64
#: Odd 64-bit constants that mix the hashes of words.
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; words are runs without ASCII white space."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.int64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], np.uint64).view(np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    total = np.zeros(len(found) - words + 1, np.uint64)
    for i in range(words):
        total = (total ^ one[i : i + len(total)]) * np.uint64(MIX[0])
        total ^= total >> np.uint64(29)
    for k in (1, 2):
        total = (total ^ (total >> np.uint64(31))) * np.uint64(MIX[k])
    return np.unique((total ^ (total >> np.uint64(32))).view(np.int64))


def prefix_size(n: int, num: int, den: int) -> int:
    """Two sets with similarity num / den or more share an element among this many first ones."""
    return n - (num * n + den - 1) // den + 1


def _sets(words: int, num: int, den: int, whole: bool):
    """Rows (id, n, digest, hashes): all hashes of a text, or the smallest that its prefix may need."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, 512):
                own = [shingles(t.as_py(), words) for t in texts.slice(start, 512)]
                kept = own if whole else [h[: 3 * prefix_size(len(h), num, den) // 2 + 8] for h in own]
                offsets = np.cumsum([0] + [len(h) for h in kept])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, 512),
                        pa.array([len(h) for h in own], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in own], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(kept) if kept else [], pa.int64())),
                    ],
                    ["id", "n", "digest", "hashes"],
                )

    return returning_memory(run)


class GroupedPrefixJoin:
    """One run of the join; `link` below is its interface."""

    def __init__(self, texts: DataFrame, words: int, num: int, den: int):
        if not 0 < num <= den or words < 1:
            raise ValueError("the similarity is num / den in (0, 1], a shingle has a word at least")
        bound_arrow_batches(texts.sparkSession, 4 << 20)
        self.texts, self.words, self.num, self.den, self.spark = texts, words, num, den, texts.sparkSession
        self.shape = struct_type(id=texts.schema["id"].dataType, n=T.LongType(), digest=T.BinaryType(), hashes=T.ArrayType(T.LongType()))
        self.rows, self.nodes = all_written_alone(self.spark, self.rows_and_nodes, "ngram-rows", "ngram-nodes")

    def rows_and_nodes(self) -> list[DataFrame]:
        """(id, n, digest) of every row, and one node (node, digest, id, n, hashes) of all rows with equal sets: the hashes of
        the rows, about as many bytes as half the texts, end with the making of the nodes."""
        rows = written(self.texts.mapInArrow(_sets(self.words, self.num, self.den, False), self.shape), "ngram-hashed")
        nodes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
        return [rows.select("id", "n", "digest"), nodes.withColumn("node", F.monotonically_increasing_id())]

    def prefix_length(self) -> Column:
        return (F.col("n") - F.floor((F.col("n") * self.num + self.den - 1) / self.den) + 1).cast("int")

    def whole_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, n, hashes) with all hashes of the wanted nodes, from their texts."""
        keys = written(self.nodes.join(wanted.distinct(), "node").select("node", "digest", "id"), "ngram-wanted")
        ids = keys.select(F.col("id").alias("_id")).distinct()
        if keys.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        texts = self.texts.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        sets = texts.mapInArrow(_sets(self.words, self.num, self.den, True), self.shape).select("digest", "n", "hashes")
        return written(sets.join(keys.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "n", "hashes"), "ngram-sets")

    def ordered(self, nodes: DataFrame, common: DataFrame) -> DataFrame:
        """(node, n, known, rare, ordered) of the nodes (node, n, hashes) that hold common hashes: how many hashes are
        known, how many of them are rare, and the known ones in the common order."""
        held = nodes.select("node", F.explode("hashes").alias("h")).join(common, "h")
        often = held.groupBy("node").agg(F.sort_array(F.collect_list("h")).alias("often"))
        rare = F.array_except("hashes", "often")
        both = nodes.join(often, "node")
        return both.select("node", "n", F.size("hashes").alias("known"), F.size(rare).alias("rare"), F.concat(rare, "often").alias("ordered"))

    def prefixes(self) -> DataFrame:
        """(node, n, prefix) of every node.

        Common are the hashes that stand in many of the sets as far as these are known, and those in many of the sets
        that consist of common hashes mostly. The latter are read as a whole, both to find these hashes and their prefix.
        """
        p = self.prefix_length()
        enough = (F.col("rare") >= p) | (F.col("known") >= F.col("n"))
        known = self.nodes.select("node", "n", "hashes")
        often = lambda sets: sets.select(F.explode("hashes").alias("h")).groupBy("h").count().filter(F.col("count") > COMMON).select("h")
        common = written(often(known), "ngram-common")
        short = written(self.ordered(known, common).filter(~enough).select("node"), "ngram-short")
        whole = self.whole_sets(short)
        common = written(common.unionByName(often(whole)).distinct(), "ngram-common")
        rest = known.join(short, "node", "left_anti")
        first = written(self.ordered(rest, common), "ngram-ordered")
        more = self.whole_sets(first.filter(~enough).select("node"))
        wholes = whole.unionByName(more)
        second = written(self.ordered(wholes, common), "ngram-ordered")
        plain = [t.join(o.select("node"), "node", "left_anti") for t, o in ((rest, first), (wholes, second))]
        parts = [o.select("node", "n", F.slice("ordered", 1, p).alias("prefix")) for o in (first.filter(enough), second)]
        parts += [t.select("node", "n", F.slice("hashes", 1, p).alias("prefix")) for t in plain]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def similar_size(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that are similar enough."""
        sketch = self.nodes.select("node", "n", F.slice("hashes", 1, self.prefix_length() + 8).alias("hashes"))
        side = lambda x: sketch.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))
        both = salted_join(salted_join(pairs, side("a"), "a"), side("b"), "b")
        last = lambda x: F.when(F.size(f"h{x}") < F.col(f"n{x}"), F.element_at(f"h{x}", -1)).otherwise(F.lit(2**63 - 1))
        limit = F.least(last("a"), last("b"))
        shared = F.size(F.array_intersect("ha", "hb"))
        seen = lambda x: F.size(F.filter(f"h{x}", lambda h: h <= F.col("limit")))
        apart = seen("a") + seen("b") - 2 * shared
        near = both.filter(self.similar_size(F.col("na"), F.col("nb"))).withColumn("limit", limit)
        near = near.filter(apart * (self.num + self.den) <= (self.den - self.num) * (F.col("na") + F.col("nb")))
        near = written(near.select("a", "b"), "ngram-near")
        sets = self.whole_sets(near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))))
        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))
        both = salted_join(salted_join(near, side("a"), "a", 5_000), side("b"), "b", 5_000)
        same = F.size(F.array_intersect("ha", "hb"))
        return both.filter(same * self.den >= (F.col("na") + F.col("nb") - same) * self.num).select("a", "b")

    def labels(self) -> DataFrame:
        """(node, component) of the nodes that have links. What a step leaves besides its result is deleted."""
        alone = lambda make, label: written_alone(self.spark, make, label)
        prefixes = alone(self.prefixes, "ngram-prefixes")
        keyed = prefixes.select("node", "n", F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit(1), "prefix").alias("p2"))
        groups = keyed.groupBy("n", "p1", "p2").agg(F.min("node").alias("group"), F.count("*").alias("size"))
        groups = written(groups, "ngram-groups")
        members = written(keyed.join(groups, ["n", "p1", "p2"]).select("node", "group"), "ngram-members")
        heads = prefixes.join(groups.select(F.col("group").alias("node"), "size"), "node")
        entries = heads.select(F.col("node").alias("group"), "n", "size", F.posexplode("prefix").alias("pos", "h"))
        # The centre has the fewest rare hashes before the shared one: what many near copies have in common is most of it.
        shared = entries.groupBy("h").agg(F.min_by("group", "pos").alias("centre"), F.sum("size").alias("in_all")).filter("in_all > 1")
        shared = written(shared.select("h", "centre"), "ngram-shared")  # its shuffle ends before the entries are shuffled
        postings = written(entries.join(shared, "h"), "ngram-postings")
        inside = members.filter("group <> node").select(F.col("group").alias("a"), F.col("node").alias("b"))
        links = alone(lambda: self.verified(written(self.stars(postings).unionByName(inside), "ngram-pairs")), "ngram-links")
        found = alone(lambda: components(links), "ngram-components")
        rest = alone(lambda: self.verified(written(self.remaining(postings, members, found), "ngram-pairs")), "ngram-links")
        if rest.isEmpty():
            return found
        return alone(lambda: components(links.unionAll(rest)), "ngram-components")

    def shared_at_least(self, a: Column, b: Column) -> Column:
        """Prefix entries that similar sets of these sizes share: all they share but what can lie behind a prefix."""
        both = F.ceil((a + b) * self.num / (self.num + self.den))
        behind = F.ceil(F.greatest(a, b) * self.num / self.den) - 1
        return F.greatest(both - behind, F.lit(1))

    def stars(self, postings: DataFrame) -> DataFrame:
        """Pairs (centre, group) of similar size that meet on half as many shingles as similar sets must share. No
        link depends on this choice: what it leaves out remains for `remaining`."""
        met = postings.filter("centre <> group").groupBy(F.col("centre").alias("a"), F.col("group").alias("b")).agg(F.count("*").alias("met"), F.first("n").alias("nb"))
        sizes = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("na"))
        near = met.join(sizes, "a").filter(self.similar_size(F.col("na"), F.col("nb")))
        return near.filter(F.col("met") * 2 >= self.shared_at_least(F.col("na"), F.col("nb"))).select("a", "b")

    def remaining(self, postings: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs of nodes that share a prefix shingle but no component. In each shingle's list one side of a pair is
        outside the list's largest component, so that a list inside one component gives no pairs."""
        placed = members.join(found, "node", "left").select("node", "group", F.coalesce("component", "node").alias("component"))
        listed = postings.select("h", "group", "n", "pos").join(placed, "group")
        sizes = listed.groupBy("h", "component").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("h").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
        mixed = written(listed.join(largest.filter("parts > 1"), "h").select("h", "node", "n", "pos", "component", "main"), "ngram-mixed")
        a, b = mixed.filter("component <> main").alias("a"), mixed.alias("b")
        apart = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
        # At the first hash that two similar sets share, enough of both must still follow.
        left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
        enough = left * (self.num + self.den) >= (F.col("a.n") + F.col("b.n")) * self.num
        pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & apart & self.similar_size(F.col("a.n"), F.col("b.n")) & enough)
        return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()

    def links(self) -> DataFrame:
        """All pairs (a, b) of nodes that are similar enough, also inside a component: as many as a group has links."""
        prefixes = written_alone(self.spark, self.prefixes, "ngram-prefixes")
        entries = written(prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "h")), "ngram-entries")
        a, b = entries.alias("a"), entries.alias("b")
        left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
        enough = left * (self.num + self.den) >= (F.col("a.n") + F.col("b.n")) * self.num
        met = (F.col("a.h") == F.col("b.h")) & (F.col("a.node") < F.col("b.node")) & self.similar_size(F.col("a.n"), F.col("b.n")) & enough
        pairs = a.join(b, met).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
        return written(self.verified(written(pairs, "ngram-pairs")), "ngram-links")

    def link_counts(self) -> DataFrame:
        """(digest, n_links) of every node: rows linked directly with each of its rows, copies included."""
        links = self.links()
        copies = self.nodes.select("node", "digest").join(self.rows.filter("n > 0").groupBy("digest").agg(F.count("*").alias("copies")), "digest")
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        others = salted_join(ends, copies.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("n"))
        return copies.join(others, "node", "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    def classes(self, counted: bool = False) -> DataFrame:
        """(id, n_shingles, component_id) of every row of the texts; n_links too if counted."""
        labels = written_alone(self.spark, self.labels, "ngram-labels")
        placed = self.nodes.select("node", "digest", "id").join(labels, "node", "left")
        placed = placed.select("digest", "id", F.coalesce("component", "node").alias("component"))
        names = placed.groupBy("component").agg(F.min("id").alias("component_id"))
        named = salted_join(placed.select("digest", "component"), names, "component").select("digest", "component_id")
        if counted:
            named = named.join(self.link_counts(), "digest")
        named, more = written(named, "ngram-named"), ["n_links"] if counted else []
        rows = self.rows.select("id", F.col("n").alias("n_shingles"), "digest")
        linked = salted_join(rows.filter("n_shingles > 0"), named, "digest").select("id", "n_shingles", "component_id", *more)
        none = [F.lit(0).cast("long").alias(c) for c in more]
        return linked.unionByName(rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), *none))


def link(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100, counted: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id; if counted, also n_links (other rows linked directly),
    for which all pairs are verified. Two documents link when den * |both| >= num * |either|."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return GroupedPrefixJoin(texts, words, num, den).classes(counted).withColumnRenamed("id", id_column)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: the one with the smallest id. Rows without words all stay."""
    own, unpacked = packed_rows(docs, id=id_column, text=text)
    k1, _ = row_keys("id", "text")
    keyed = own.select(F.struct("id", k1).alias("_key"), "text", "row")
    classes = written_alone(docs.sparkSession, lambda: link(keyed.select("_key", "text"), "_key", "text", words, num, den), "ngram-classes")
    heads = classes.filter((F.col("n_shingles") > 0) & F.col("_key").eqNullSafe(F.col("component_id")))
    counted = heads.groupBy("_key").count()
    one = keyed.join(counted.filter("count = 1"), "_key", "left_semi")
    several = keyed.join(counted.filter("count > 1"), "_key", "left_semi").dropDuplicates(["_key"])
    empty = keyed.join(classes.filter("n_shingles = 0").select("_key").distinct(), "_key", "left_semi")
    return one.unionByName(several).unionByName(empty).select(unpacked())
