"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting (document, position) for every document word that the benchmark
uses. For each window of benchmark words its two rarest terms in the corpus are looked up; every
posting of the rarest fixes where the item would have to lie in the document, and the postings of
the other, moved by their offsets, are intersected with those places. Few remain that are no
occurrences; there the words of the document and of the item are compared one by one, and runs of
equal words as long as a window are hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, bounded_broadcast, stored, text_of

# Fixed: what is no part of a word. Words are lower-cased afterwards, A-Z only.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
END = "\x00end"  # stands after the last word of every document, and is no word


def words_of(text: Column) -> Column:
    """The words of a text, not lower-cased; the first and the last may be empty strings."""
    return F.split(text, BETWEEN_WORDS, -1)


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are. Only words that aren't ASCII need the slow way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def item_words(items: DataFrame) -> DataFrame:
    """item_id (as text), item (a key of the row), n (words of the item), at, word. Equal rows count once; null texts have no words."""
    rows = items.select(items["item_id"].cast("string").alias("item_id"), text_of(items).alias("text")).distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), F.filter(words_of(F.col("text")), lambda w: w != "").alias("words"))
    rows = rows.select("item_id", "item", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    return rows.withColumn("word", lowered(F.col("word")))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of whole texts: doc_id, content, n_words, pos, term; only of words (word, term) in the vocabulary.

    Each document also has a posting of the end mark, if that is in the vocabulary.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("content"), words_of(F.col("text")).alias("words"))
    empty = (F.element_at("words", 1) == "").cast("int") + ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    rows = rows.select("doc_id", "content", (F.size("words") - empty).alias("n_words"), F.concat("words", F.array(F.lit(END))).alias("words"))
    rows = rows.select("doc_id", "content", "n_words", F.posexplode("words").alias("pos", "word"))
    rows = rows.withColumn("word", lowered(F.col("word")))
    return rows.join(vocabulary, "word").select("doc_id", "content", "n_words", "pos", "term")


def rarest_terms(items: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """item, at, term, next_at, next_term: the rarest and second rarest place of every window of an item.

    ``items`` has the words of all items with their terms. An item of fewer words than a
    window is one window; of a window of one word both places are the same.
    """
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    rows = items.join(frequency, "term", "left").withColumn("postings", F.coalesce("postings", F.lit(0)))
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(Window.currentRow, window - 1)
    rows = rows.withColumn("rarest", F.array_sort(F.collect_list(F.struct("postings", "at", "term")).over(ahead)))
    starts = rows.where(F.col("at") <= F.greatest(F.col("n") - window, F.lit(0)))
    one, other = F.col("rarest")[0], F.coalesce(F.get("rarest", F.lit(1)), F.col("rarest")[0])
    # A term without postings is in no document, and so is the window.
    starts = starts.select("item", one.alias("one"), other.alias("other")).where("one.postings > 0")
    return starts.select("item", "one.at", "one.term", F.col("other.at").alias("next_at"), F.col("other.term").alias("next_term")).distinct()


def _places(postings: DataFrame, rarest: DataFrame) -> DataFrame:
    """doc_id, content, item, shift: where an item's first word would lie, by both rare terms of a window."""
    terms = rarest.count()
    asked = postings.join(bounded_broadcast(rarest, terms, 64), "term")
    asked = asked.select(
        "doc_id",
        "content",
        "item",
        (F.col("pos") - F.col("at")).alias("shift"),
        (F.col("pos") - F.col("at") + F.col("next_at")).alias("pos"),
        F.col("next_term").alias("term"),
    )
    others = rarest.select(F.col("next_term").alias("term")).distinct()
    others = postings.join(bounded_broadcast(others, terms, 16), "term", "left_semi").select("doc_id", "content", "pos", "term")
    both = asked.join(others, _same(asked, others, "doc_id", "content", "pos", "term"))
    return both.select(*(asked[c] for c in ("doc_id", "content", "item", "shift"))).distinct()


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The postings of the ends of all documents, and all hits: doc_id, content, item_id, places.

    ``places`` are the positions of document words inside occurrences of ``window``
    consecutive item words, or of a whole shorter item. Positions count from the document's
    first word, or from 1 if something precedes it.
    """
    words = stored(item_words(items), "item-words")
    vocabulary = words.select("word").distinct().select("word", F.xxhash64("word").alias("term"))
    vocabulary = vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit(END), F.lit(0).cast("long")))
    sizes = words.agg(F.count_distinct("word"), F.max(F.octet_length("word")), F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
    vocabulary = bounded_broadcast(vocabulary, sizes[0] + 1, 64 + (sizes[1] or 0))
    index = stored(build_index(docs, vocabulary), "postings")
    postings = index.where("term <> 0")
    words = words.withColumn("term", F.xxhash64("word"))
    places = stored(_places(postings, stored(rarest_terms(words, postings, window), "rarest-terms")), "places")

    # The texts in question, split once each, then one row per place; the words stay where they are.
    chosen = places.select(F.col("doc_id").alias("id"), F.col("content").alias("hash")).distinct()
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    texts = texts.withColumn("content", F.xxhash64("text"))
    texts = texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["id"]) & (F.col("content") == F.col("hash")), "left_semi")
    texts = texts.select("doc_id", "content", F.transform(words_of(F.col("text")), lowered).alias("words"))
    of_item = words.groupBy("item", "item_id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "word")))["word"].alias("item_words"))
    of_item = bounded_broadcast(of_item, 1, 64 * (sizes[2] or 0) + (sizes[3] or 0))
    asked = places.join(of_item, "item").withColumnsRenamed({"doc_id": "id", "content": "hash"})
    both = asked.join(texts, texts["doc_id"].eqNullSafe(asked["id"]) & (F.col("content") == F.col("hash")))
    equal = F.transform("item_words", lambda word, at: F.get("words", F.col("shift") + at).eqNullSafe(word))
    size = F.least(F.col("n"), F.lit(window))
    both = both.select("doc_id", "content", "item_id", "n", "shift", size.alias("size"), equal.alias("equal"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda s: F.forall(F.slice("equal", s + 1, F.col("size")), lambda x: x))
    both = both.withColumn("starts", starts).where(F.size("starts") > 0)
    inside = F.transform("starts", lambda s: F.sequence(F.col("shift") + s, F.col("shift") + s + F.col("size") - 1))
    hits = both.select("doc_id", "content", "item_id", F.array_distinct(F.flatten(inside)).alias("places"))
    return index.where("term = 0"), hits


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out &= left[name].eqNullSafe(right[name])
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, content, n_words, n_hit, n_items, items_sha256, contaminated: one row per document.

    Null and empty texts have no words, on either side. ``content`` is a hash of the text;
    rows with the same doc_id and text have the same figures; a null doc_id is an id like
    others. An item_id that stands for several texts counts once; a null item_id is counted
    by no name, but its words are hit.
    """
    ends, hits = occurrences(docs, items, window)
    per_doc = hits.groupBy("doc_id", "content").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    rows = ends.join(per_doc, _same(ends, per_doc, "doc_id", "content"), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        ends["doc_id"],
        ends["content"],
        ends["n_words"].cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def near_phrases(docs: DataFrame, phrases: DataFrame, slop: int = 3) -> DataFrame:
    """doc_id, item_id, n_terms: documents that hold all words of an item in a stretch of n + ``slop`` words, in any order.

    Proximity matches around the postings of each item's rarest term. Null and empty items match nothing.
    """
    words = stored(item_words(phrases), "item-words")
    vocabulary = words.select("word").distinct().select("word", F.xxhash64("word").alias("term"))
    index = stored(build_index(docs, vocabulary), "postings")
    words = words.withColumn("term", F.xxhash64("word"))
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    first = words.join(frequency, "term").groupBy("item", "item_id", "n").agg(F.min(F.struct("postings", "term"))["term"].alias("term"))
    anchors = index.join(first, "term").select("doc_id", "content", "item", "item_id", "n", F.col("pos").alias("anchor"))
    wanted = words.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    totals = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("terms"))
    asked = anchors.join(wanted, "item").alias("a")
    near = asked.join(
        index.alias("i"),
        F.col("a.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("a.content") == F.col("i.content")) & (F.col("a.term") == F.col("i.term")),
    ).where(F.abs(F.col("i.pos") - F.col("a.anchor")) < F.col("a.n") + slop)
    near = near.select("a.doc_id", "a.content", "a.item", "a.item_id", "a.n", "a.anchor", "a.term", "a.times", "i.pos")
    # For each possible start of the stretch: all terms often enough.
    spots = near.select("*", F.explode(F.sequence(F.col("pos") - F.col("n") - slop + 1, F.col("pos"))).alias("start"))
    spots = spots.where((F.col("anchor") >= F.col("start")) & (F.col("anchor") < F.col("start") + F.col("n") + slop))
    per_term = spots.groupBy("doc_id", "content", "item", "item_id", "anchor", "start", "term", "times").agg(F.count_distinct("pos").alias("seen"))
    full = per_term.where("seen >= times").groupBy("doc_id", "content", "item", "item_id", "anchor", "start").agg(F.count(F.lit(1)).alias("terms"))
    return full.join(totals, ["item", "terms"]).select("doc_id", "item_id", F.col("terms").alias("n_terms")).distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without those that hold a window of an item."""
    _, hits = occurrences(docs, items, window)
    found = hits.select(F.col("doc_id").alias("hit_id"), F.col("content").alias("hit_content")).distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(found["hit_id"]) & (F.xxhash64(text_of(docs)) == found["hit_content"])
    return docs.join(found, on, "left_anti")
