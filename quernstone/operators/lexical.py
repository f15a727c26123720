"""Lexical retrieval and near-duplicates over long tables of (document, term, count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as tx
from quernstone.operators import bags
from quernstone.session import plan_bytes, settled, shuffle_partitions

K1, B = 1.5, 0.75
#: Size of the files of a written table up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes of text that one block of near-duplicates holds at most, but for the chance of a hash.
BLOCK_BYTES = 24 << 20


def _exploded(df: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, term) of the array t.

    For a plain explode the optimizer adds a filter on the array's size below
    it, and would make the terms of every text twice.
    """
    return df.select(*keep, F.explode_outer("t").alias("term")).where("term is not null")


def document_frequency(p: DataFrame) -> DataFrame:
    """(term, df) of postings. It reads tf, so that it can share the shuffle of the postings themselves."""
    return p.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def postings(df: DataFrame, doc: str, text: str, *keep: str) -> DataFrame:
    """(doc, kept columns, term, tf): one row per distinct term of a document.

    A document's terms come from one row, so counts combine before the shuffle.
    Null and empty texts have none.
    """
    return _exploded(df.select(doc, *keep, tx.terms(F.col(text)).alias("t")), doc, *keep).groupBy(doc, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, length in terms) of every document, empty ones included."""
    return df.select(doc, F.coalesce(F.size(tx.terms(F.col(text))), F.lit(0)).alias("length"))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """Distinct (query, term)."""
    return queries.select(query, F.explode(F.array_distinct(tx.terms(F.col(text)))).alias("term"))


def bm25(df: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str, *, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score) of every document that shares a term with a query.

    Only postings of terms that occur in some query are kept, and document
    frequencies are counted on them; corpus size and mean length are one
    aggregate over the lengths, kept beside every row as a one-row join. Where
    the queries' files are small, or else the written table of their terms, the
    terms and the frequencies, of which there are no more, go to the postings,
    so that no common term gathers its postings in one task.
    """
    asked = query_terms(queries, query, query_text)
    few = 0 < plan_bytes(queries) <= BROADCAST_BYTES
    if not few:
        asked = settled(asked)
        few = 0 < plan_bytes(asked) <= BROADCAST_BYTES
    wanted = asked.select("term").distinct()
    sized = df.select(doc, tx.terms(F.col(text)).alias("t")).select(doc, F.coalesce(F.size("t"), F.lit(0)).alias("length"), "t")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = _exploded(sized, doc, "length").join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy(doc, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = document_frequency(hits)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    # a one-row aggregate: always small enough to broadcast
    weighted = hits.join(F.broadcast(frequency) if few else frequency, "term").crossJoin(F.broadcast(stats)).select(doc, "term", part.alias("part"))
    return weighted.join(F.broadcast(asked) if few else asked, "term").groupBy(query, doc).agg(F.sum("part").alias("score"))


def _by_document(df: DataFrame, doc: str) -> DataFrame:
    """df placed by document: its terms then need no shuffle to be counted. The texts travel once, which is less than their terms."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), df.rdd.getNumPartitions()), doc)


def placed_postings(df: DataFrame, doc: str, text: str, *keep: str) -> DataFrame:
    """postings() of a table placed by document. Equal calls are equal plans, and share their shuffles."""
    return postings(_by_document(df.select(doc, text, *keep), doc), doc, text, *keep)


def tfidf(df: DataFrame, doc: str, text: str, *keep: str) -> DataFrame:
    """(doc, kept columns, term, weight): (1 + ln tf) * (ln((1+N)/(1+df)) + 1), each document's weights of norm 1."""
    p = placed_postings(df, doc, text, *keep)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    frequency = document_frequency(p)
    raw = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    w = p.join(frequency, "term").crossJoin(F.broadcast(total)).select(doc, *keep, "term", raw.alias("w"))
    # the terms of one document, so no group is large
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, *keep, "term", (F.col("w") / norm).alias("weight"))


def tfidf_search(vectors: DataFrame, doc: str, asked: DataFrame, query: str, frequency: DataFrame, total: int) -> DataFrame:
    """(query, doc, score): cosine of query terms against document vectors, idf from the corpus alone."""
    counted = asked.groupBy(query, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = (1 + F.log("tf")) * (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    q = counted.join(frequency, "term", "left").select(query, "term", raw.alias("w"))
    norm = q.groupBy(query).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = q.join(norm, query).select(query, "term", (F.col("w") / F.col("norm")).alias("qw"))
    return vectors.join(q, "term").groupBy(query, doc).agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def near_duplicates(df: DataFrame, doc: str, text: str, group: str, order: Sequence[str], *, threshold: float = 0.9) -> DataFrame:
    """(doc, match, similarity): the most similar earlier document of the same group, at or above the threshold.

    Exact. Texts travel to blocks of bounded size, and their terms never do: a
    block holds whole groups or, of a group above BLOCK_BYTES, two of its
    chunks, so that any two of its texts meet somewhere. First each block counts
    its terms, and gets back the frequency of those that more than one document
    holds; then it weighs its texts and looks for each one's nearest earlier one
    (operators.bags). Similarities are compared as rounded to nine places. Ties
    go to the earliest document. Null groups and texts without terms have no match.
    """
    spark = df.sparkSession
    known = df.where(F.col(group).isNotNull())
    sizes = settled(known.groupBy(group).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")))
    total = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    blocks = max(2 * shuffle_partitions(spark), 2 * total.bytes // BLOCK_BYTES)
    # each has more than BLOCK_BYTES, so they are few
    large = sizes.where(F.col("bytes") > BLOCK_BYTES).select(group, F.ceil(2 * F.col("bytes") / BLOCK_BYTES).cast("int").alias("chunks"))

    # the text as terms() reads it
    lower = F.replace(F.lower(text), F.lit("ß"), F.lit("ss")).alias("t")
    x = known.where(F.col(text).isNotNull()).select(doc, group, *[c for c in order if c not in (doc, group)], lower).join(F.broadcast(large), group, "left")
    chunk = F.pmod(F.xxhash64(doc, F.lit(1)), F.col("chunks")).cast("int")
    place = lambda block, home: F.struct(block.cast("bigint").alias("block"), home.alias("home"))
    # a document of a large group is in several blocks, and counted in one of them
    met = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: o != chunk),
        lambda o: place(F.xxhash64(group, F.least(chunk, o), F.greatest(chunk, o)), o == F.pmod(chunk + 1, F.col("chunks"))),
    )
    alone = F.array(place(F.pmod(F.xxhash64(group), F.lit(blocks)), F.lit(True)))
    x = x.withColumn("at", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(met))).select("at.block", "at.home", *[c for c in x.columns if c != "chunks"])

    n = total.docs
    counted = x.groupBy("block").applyInArrow(bags.count_block, "block bigint, term bigint, n bigint")
    frequency = counted.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).where("df > 1").select("block", "term", "df")
    types = dict(x.dtypes)
    found = x.groupBy("block").cogroup(frequency.groupBy("block")).applyInArrow(
        lambda texts, known: bags.match_block(texts, known, n, doc, group, order, threshold),
        f"`{doc}` {types[doc]}, similarity double, place struct<{', '.join(f'`o{i}`: {types[c]}' for i, c in enumerate(order))}, `match`: {types[doc]}>",
    )
    best = found.groupBy(doc).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "place")).alias("best"))
    return best.select(doc, F.col("best.place.match").alias("match"), (-F.col("best.s")).alias("similarity"))


def topic_hits(df: DataFrame, doc: str, text: str, topics: dict[str, Sequence[str]]) -> DataFrame:
    """(doc, topic, keyword, position): the first place of each topic's first keyword in a folded text, zero-based.

    A keyword in ASCII counts only where no letter a-z or digit touches it.
    """

    def found(t: Column) -> Column:
        hits = []
        for topic, keywords in topics.items():
            for k in keywords:
                at = F.instr(t, k)
                if k.isascii():
                    guarded = rf"(?<![a-z0-9])\Q{k}\E(?![a-z0-9])"
                    # what comes before the first match, counted in characters; only texts that hold the keyword are searched
                    at = F.when((at > 0) & t.rlike(guarded), F.length(F.split(t, guarded, 2)[0]) + 1).otherwise(0)
                hits.append(F.struct(F.lit(topic).alias("topic"), F.lit(k).alias("keyword"), (at - 1).alias("position")))
        return F.filter(F.array(*hits), lambda h: h["position"] >= 0)

    # as the variable of a lambda, a folded text is made once and not for every keyword
    all_ = F.flatten(F.transform(F.array(tx.fold(F.col(text))), found))
    one = df.select(doc, F.explode_outer(all_).alias("h")).where("h is not null").select(doc, "h.*")
    return one.groupBy(doc, "topic").agg(F.min(F.struct("position", "keyword")).alias("m")).select(doc, "topic", "m.keyword", "m.position")


def has_all(text: Column, qualifiers: Sequence[str]) -> Column:
    """Does a folded text hold every qualifier as a whole word?"""
    out = F.lit(True)
    for q in qualifiers:
        out = out & text.rlike(rf"(?<![a-z0-9]){q}(?![a-z0-9])")
    return out

