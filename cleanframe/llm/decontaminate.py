"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

The words of the training texts that occur in the benchmark are stored as postings (document, position, term).
A phrase is searched from its rarest term: its postings, moved back by the term's offset, are the possible starts;
they are intersected with the moved postings of the next rarest term, and what is left with those of all others.

Words are runs of ASCII digits, ASCII letters and non-ASCII characters, A-Z in lower case. A window is `size`
consecutive words of an item; an item with fewer words, but at least one, is one window.

Defined results: NULL and empty texts have no words, no hits and no windows. Repeated documents each get their row.
Items with equal ids count as one; items with a NULL id mark words but are not counted or listed. Documents are told
apart by id and text together, so ids may repeat or be NULL. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cleanframe.llm.common import fresh_names, lower_ascii, row_keys, salted_join, written

#: Everything in ASCII that is neither a letter nor a digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A list of more rows, or of more bytes as JSON, is joined by a shuffle instead of being broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: A list is written in one file for each so many rows, or in fewer where it has fewer partitions.
ROWS_PER_FILE = 200_000
KEYS = ["k1", "k2"]


def words(text: str | Column) -> Column:
    """The words of a text in their original case; an empty array for NULL."""
    column = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), SEPARATORS), "")


def folded(word: str) -> Column:
    """A-Z in lower case; pure ASCII words take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(lower_ascii(F.col(word)))


def small(table: DataFrame) -> bool:
    """Is a written table, lists in it included, small enough to be broadcast?"""
    if table.count() > BROADCAST_ROWS:
        return False
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    return table.agg(size.alias("size")).first()["size"] <= BROADCAST_BYTES


def sized(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(table) if small(table) else table


def joined(many: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Inner join with a list: broadcast if it is small, else by a shuffle that salts the keys `many` holds most often."""
    return many.join(F.broadcast(listed), on) if small(listed) else salted_join(many, listed, on)


def written_list(df: DataFrame, label: str, rows: int) -> DataFrame:
    """`df`, written. At most about `rows` rows enter its last stage, whose tasks are merged accordingly: with a file for each shuffle
    partition, short lists would be thousands of files, and for each file a local file system starts processes (chmod)."""
    return written(df.coalesce(min(max(1, -(-rows // ROWS_PER_FILE)), 1 << 30)), label)


def total(table: DataFrame, column: Column) -> int:
    return table.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("n")).first()["n"]


def windows(items: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """(item, phrase) for each window, phrase being an array of words; with repetitions."""
    own = items.select(F.col(id_column).alias("item"), F.transform(words(text), lower_ascii).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return own.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("phrase"))


class PositionalIndex:
    """Postings of the terms of `vocabulary` (term, word) in whole texts: (k1, k2, pos, term), kept as a written table."""

    def __init__(self, docs: DataFrame, id_column: str, text: str, vocabulary: DataFrame):
        entries = docs.select(*row_keys(id_column, text), F.posexplode(words(text)).alias("pos", "word"))
        known = joined(entries.select(*KEYS, "pos", folded("word").alias("word")), vocabulary, "word")
        self.vocabulary = vocabulary
        self.postings = written(known.select(*KEYS, "pos", "term"), "postings")

    def counts(self) -> DataFrame:
        n_partial = self.vocabulary.count() * len(self.postings.inputFiles())
        return written_list(self.postings.groupBy("term").count(), "term-counts", n_partial)

    def phrases(self, terms: DataFrame) -> DataFrame:
        """Exact matches (k1, k2, phrase, start, length) of phrases given as terms (phrase, off, term), written."""
        ranked = self._ranked(terms)
        first, second = (ranked.filter(F.col("rank") == r).select("phrase", "off", "term", "length") for r in (0, 1))
        starts = joined(self.postings, first, "term").select(*KEYS, "phrase", "length", (F.col("pos") - F.col("off")).alias("start"))
        starts = starts.filter("start >= 0")
        met = self._met(starts, second, self.postings)
        single = starts.filter("length = 1").distinct()
        n_starts = total(ranked.filter("rank = 0"), F.col("count"))
        left = written_list(met.distinct(), "phrase-starts", n_starts)  # a repeated document has its postings twice
        rest = ranked.filter("rank >= 2").select("phrase", "off", "term")
        where = written_list(left.select(*KEYS).distinct(), "phrase-documents", left.count())
        near = self.postings.join(sized(where), KEYS, "left_semi").distinct()
        wanted = joined(left, rest, "phrase").select(*left.columns, (F.col("start") + F.col("off")).alias("pos"), "term")
        full = wanted.join(near, [*KEYS, "pos", "term"]).groupBy(*left.columns).count().filter("count = length - 2").drop("count")
        found = full.unionByName(left.filter("length = 2")).unionByName(single)
        n_single = total(ranked.filter("length = 1"), F.col("count"))
        return written_list(found, "phrase-matches", total(left, F.col("length")) + n_single)

    def _ranked(self, terms: DataFrame) -> DataFrame:
        """terms with their count, the length of their phrase and their rank in it, rarest first; phrases with a term that no text holds go."""
        held = terms.join(self.counts(), "term", "left")
        grouped = held.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("count", "off", "term"))).alias("t"))
        grouped = grouped.filter(F.forall("t", lambda x: x["count"].isNotNull()))
        flat = grouped.select("phrase", F.size("t").alias("length"), F.posexplode("t").alias("rank", "x"))
        return written_list(flat.select("phrase", "length", "rank", "x.off", "x.term", "x.count"), "ranked-terms", terms.count())

    def _met(self, starts: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
        """Those starts at which the phrase's term of the next rank stands too."""
        only = postings.join(sized(terms.select("term").distinct()), "term", "left_semi")
        wanted = joined(starts, terms.drop("length"), "phrase").withColumn("pos", F.col("start") + F.col("off"))
        return wanted.join(only, [*KEYS, "pos", "term"], "left_semi").select(*starts.columns)

    def proximity(self, terms: DataFrame, width: int) -> DataFrame:
        """(k1, k2, phrase, at): places of a phrase's rarest term with all its other terms, in any order, fewer than
        `width` words away. Positions meet in blocks of `width` words, so no list is compared with a whole text."""
        ranked = self._ranked(terms.dropDuplicates(["phrase", "term"]))
        anchors = joined(self.postings, ranked.filter("rank = 0").select("phrase", "term", "length"), "term")
        anchors = anchors.select(*KEYS, "phrase", "length", F.col("pos").alias("at")).distinct()
        others = joined(anchors, ranked.filter("rank > 0").select("phrase", "term"), "phrase")
        block = F.floor(F.col("at") / width)
        spread = others.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
        placed = self.postings.withColumn("block", F.floor(F.col("pos") / width))
        near = spread.join(placed, [*KEYS, "term", "block"]).filter(F.abs(F.col("pos") - F.col("at")) < width)
        met = near.select(*KEYS, "phrase", "length", "at", "term").distinct().groupBy(*KEYS, "phrase", "length", "at").count()
        return met.filter("count = length - 1").unionByName(anchors.filter("length = 1").withColumn("count", F.lit(0))).select(*KEYS, "phrase", "at")


class Benchmark:
    """Windows of the items, their phrases as terms, and the vocabulary."""

    def __init__(self, items: DataFrame, id_column: str, text: str, size: int):
        own = windows(items, id_column, text, size)
        keyed = own.select("item", "phrase", F.array_join("phrase", " ").alias("joined"))
        one = keyed.groupBy("joined").agg(F.first("phrase").alias("words"))
        n_windows = keyed.count()
        self.named = written_list(one.withColumn("phrase", F.monotonically_increasing_id()), "benchmark-phrases", n_windows)
        number = self.named.select("joined", F.col("phrase").alias("number"))
        self.items = written_list(keyed.join(number, "joined").select(F.col("number").alias("phrase"), "item").distinct(), "benchmark-items", n_windows)
        flat = self.named.select("phrase", F.posexplode("words").alias("off", "word"))
        n_terms = total(self.named, F.size("words"))
        self.vocabulary = written_list(flat.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary", n_terms)
        self.terms = written_list(flat.join(self.vocabulary, "word").select("phrase", "off", "term"), "benchmark-terms", n_terms)


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document: id, k1, k2, n_words, n_hit (words inside a matched window), items (sorted ids as
    text of the items with matched windows), spans (matched runs of words as structs start, end; end exclusive)."""
    benchmark = Benchmark(items, item_id, item_text, size)
    index = PositionalIndex(docs, id_column, text, benchmark.vocabulary)
    found = index.phrases(benchmark.terms)
    # Runs: a matched window opens a run if no window that starts before it reaches it. Windows of a text are few.
    spots = found.groupBy(*KEYS, "start").agg(F.max("length").alias("length"))
    spans = spots.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("hits"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join_on(runs: Column, hit: Column) -> Column:
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], hit["end"]).alias("end"))))
        return F.when((F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["end"] >= hit["start"]), grown).otherwise(F.concat(runs, F.array(hit)))

    spans = spans.select(*KEYS, F.aggregate(F.transform("hits", lambda h: F.struct(h["start"].cast("int").alias("start"), h["end"].cast("int").alias("end"))), none, join_on).alias("spans"))
    named = found.join(sized(benchmark.items), "phrase").filter("item is not null").select(*KEYS, F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy(*KEYS).agg(F.sort_array(F.collect_set("item")).alias("items"))
    of_a_phrase = benchmark.items.groupBy("phrase").count().agg(F.max("count").alias("n")).first()["n"] or 0
    marked = written_list(spans.join(named, KEYS, "left"), "contaminated", found.count() * of_a_phrase)
    rows = docs.select(F.col(id_column), *row_keys(id_column, text), F.size(words(text)).cast("long").alias("n_words"))
    both = rows.join(sized(marked), KEYS, "left")
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return both.select(
        id_column,
        *KEYS,
        "n_words",
        F.coalesce(length, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", none).alias("spans"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 10, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without a word inside a matched window, all columns as they were."""
    one, two, hit_one, hit_two = fresh_names(docs, "key_a", "key_b", "hit_a", "hit_b")
    hit = contamination(docs, items, size, id_column, text).filter("n_hit > 0").select(F.col("k1").alias(hit_one), F.col("k2").alias(hit_two))
    k1, k2 = (k for k in row_keys(id_column, text))
    hit = written(hit.distinct(), "contaminated-keys")
    keyed = docs.withColumns({one: k1, two: k2})
    return keyed.join(sized(hit), (F.col(one) == F.col(hit_one)) & (F.col(two) == F.col(hit_two)), "left_anti").drop(one, two)
