"""Sentence-aware chunks: whole sentences packed greedily into a budget of words, with whole sentences as overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence: up to a mark of an end with closing quotes and brackets and the white space behind it, or up to a line feed and all
#: white space from there on, or to the end of the text.
SENTENCE = r"""(?s).*?(?:[.!?…]["'“”’)\]]{0,3}(?:\s++|\z)|\n\s*+|\z)"""
#: A word with the white space before it; the last one of a text has that behind it as well.
WORD = r"\s*\S+(?:\s+\z)?"


def sentences(text: Column) -> Column:
    """The sentences of a text with all its white space, so that joined they are the text; an empty text has none."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: s != "")


def _pieces(text: Column, size: int) -> Column:
    """array<struct<text, words>>: sentences, those of more than size words cut into runs of size words."""

    def one(words: Column, i: Column) -> Column:
        own = F.slice(words, i * size + 1, size)
        return F.struct(F.array_join(own, "").alias("text"), F.size(own).alias("words"))

    def runs(s: Column) -> Column:
        return _let(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: one(w, i)))

    def cut(s: Column) -> Column:
        return _let(F.regexp_count(s, F.lit(r"\S+")), lambda n: F.when(n > size, runs(s)).otherwise(F.array(F.struct(s.alias("text"), n.alias("words")))))

    return F.flatten(F.transform(sentences(text), cut))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentence_chunks(docs: DataFrame, size: int = 8096, overlap: int = 50) -> DataFrame:
    """(node_id, ref_doc_id, chunk, n_words, text) of docs (doc_id, text), as one fold over the sentences of each text.

    A chunk takes sentences while they have at most size words in all.  The next one begins with the last whole sentences of the
    one before that have at most overlap words and leave room for the sentence that did not fit.  A sentence of
    more than size words is cut into runs of size words, which count as sentences.  The text of a chunk is that of the
    document from its first sentence to its last, without white space at its ends.  A null, empty or blank text is one empty
    chunk.  Work on a text is in proportion to its length; other columns are ignored, repeated rows give repeated chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the size")
    none = F.array().cast("array<struct<first:int,last:int,words:int>>")
    # seen: words so far; begin: those before the chunk; tail: those before each of the last sentences, which may be the overlap
    zero = F.struct(none.alias("done"), F.lit(0).alias("i"), F.lit(0).alias("seen"), F.lit(0).alias("first"), F.lit(0).alias("begin"), F.array().cast("array<int>").alias("tail"))
    closed = lambda acc: F.array_append(acc["done"], F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last"), (acc["seen"] - acc["begin"]).alias("words")))

    def step(acc: Column, words: Column) -> Column:
        seen = acc["seen"]
        fits = (seen - acc["begin"] + words <= size) | (seen == acc["begin"])

        def state(tail: Column) -> Column:
            return F.struct(
                F.when(fits, acc["done"]).otherwise(closed(acc)).alias("done"),
                (acc["i"] + 1).alias("i"),
                (seen + words).alias("seen"),
                F.when(fits, acc["first"]).otherwise(acc["i"] - F.size(tail)).alias("first"),
                F.when(fits, acc["begin"]).otherwise(F.coalesce(F.get(tail, F.lit(0)), seen)).alias("begin"),
                F.filter(F.array_append(tail, seen), lambda before: seen + words - before <= overlap).alias("tail"),
            )

        return _let(F.when(fits, acc["tail"]).otherwise(F.filter(acc["tail"], lambda before: seen - before + words <= size)), state)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), _pieces(F.coalesce(F.col("text"), F.lit("")), size).alias("p"))
    rows = rows.select("doc_id", "p", F.aggregate(F.transform("p", lambda x: x["words"]), zero, step, closed).alias("c"))
    rows = rows.select("doc_id", "p", F.posexplode("c").alias("chunk", "c"))
    body = F.array_join(F.transform(F.slice("p", F.col("c.first") + 1, F.greatest(F.col("c.last") - F.col("c.first") + 1, F.lit(0))), lambda x: x["text"]), "")
    return rows.select(F.concat_ws("#", "doc_id", "chunk").alias("node_id"), F.col("doc_id").alias("ref_doc_id"), "chunk", F.col("c.words").alias("n_words"), F.regexp_replace(body, r"^\s+|\s+\z", "").alias("text"))
