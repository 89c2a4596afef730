"""The token table: tokenising documents, sentence numbers, and a surrogate annotation for data without a tagger.

Columns: text_id, corpus, lang, tok_idx, text, word (lower case), lemma, pos, tag, dep, head, sent_idx,
is_punct. Operators take any table with the columns they use, so a real tagger's output fits as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters, digits and underscores, in any script: the same tokens in Java's and RE2's dialects.
WORD = r"[\p{L}\p{N}_]+"
TOKEN = WORD + r"|[^\p{L}\p{N}_\s]"

#: The usual English function words.
STOPWORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all each few more most other some such no nor not only own same so than too very s t can will just don
    should now d ll m o re ve y""".split()
)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, *keep, tok_idx, text) per token of every text, in place; null texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    return docs.select(F.col(id_col).alias("text_id"), *keep, F.posexplode(found).alias("tok_idx", "text"))


def corpus_tokens(docs: DataFrame, pattern: str = WORD) -> DataFrame:
    """Word tokens of a documents table with corpus = source, and lower-cased word."""
    t = tokenize(docs, pattern=pattern, keep=("source", "lang"))
    return t.withColumnRenamed("source", "corpus").withColumn("word", F.lower("text"))


def lemma_of(word: Column) -> Column:
    """Surrogate lemma: one common ending cut from words of more than four letters."""
    cut = lambda n: F.left(word, F.length(word) - n)
    long = F.length(word) > 4
    return F.when(long & word.endswith("ing"), cut(3)).when(long & (word.endswith("ed") | word.endswith("ly")), cut(2)).when(long & word.endswith("s"), cut(1)).otherwise(word)


def pos_of(word: Column, punct: Column) -> Column:
    """Surrogate part of speech by ending and length."""
    ends = lambda *e: [word.endswith(x) for x in e]
    verb, noun = ends("ed", "ing"), ends("ion", "er", "s")
    return (
        F.when(punct, "PUNCT")
        .when(word.rlike(r"^\p{N}+$"), "NUM")
        .when(word.isin("i", "he", "it", "we", "she", "you", "they"), "PRON")
        .when(word.isin("of", "for", "by", "with", "on", "in", "to"), "ADP")
        .when(word.endswith("ly"), "ADV")
        .when(verb[0] | verb[1], "VERB")
        .when(noun[0] | noun[1] | noun[2], "NOUN")
        .when(F.length(word) <= 3, "DET")
        .otherwise("ADJ")
    )


def annotate(docs: DataFrame, pieces: int = 1) -> DataFrame:
    """Surrogate annotation of a documents table; deterministic and plainly not linguistic.

    Texts are dealt out by id before they are exploded, so that the windows below need no second
    shuffle and no token crosses the network. `pieces` times as many tasks as the session's shuffles have
    share the texts, for operators whose sorts would not fit into a task's memory.
    """
    dealt = docs.repartition("doc_id") if pieces == 1 else docs.repartition(pieces * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    t = tokenize(dealt, keep=("source", "lang")).withColumnRenamed("source", "corpus")
    word = F.lower("text")
    punct = ~F.col("text").rlike(r"^[\p{L}\p{N}_]")
    t = t.select("*", word.alias("word"), punct.alias("is_punct"))
    t = t.select("*", lemma_of(F.col("word")).alias("lemma"), pos_of(F.col("word"), F.col("is_punct")).alias("pos"))
    text = Window.partitionBy("text_id").orderBy("tok_idx")
    before = text.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("sent_idx", F.coalesce(F.sum(F.when(F.col("text").isin(".", "!", "?"), 1).otherwise(0)).over(before), F.lit(0)).cast("int"))
    # the last verb before, if it is of the same sentence: the window above serves again, without another sort
    verb = F.last(F.when(F.col("pos") == "VERB", F.struct("tok_idx", "sent_idx")), ignorenulls=True).over(before)
    t = t.withColumn("verb", verb).withColumn("head", F.when(F.col("verb.sent_idx") == F.col("sent_idx"), F.col("verb.tok_idx")).otherwise(F.col("tok_idx"))).drop("verb")
    alone = F.col("head") == F.col("tok_idx")
    dep = (
        F.when(F.col("is_punct"), "punct")
        .when(F.col("pos") == "VERB", F.when(alone, "ROOT").otherwise("conj"))
        .when(F.col("pos").isin("NOUN", "PRON"), F.when(alone, "nsubj").otherwise("dobj"))
        .when(F.col("pos") == "ADP", F.when(alone, "case").when(F.col("word").isin("on", "in", "to"), "prt").otherwise("prep"))
        .when(F.col("pos") == "ADV", "advmod")
        .when(F.col("pos") == "ADJ", F.when(alone, "amod").otherwise("acomp"))
        .otherwise("det")
    )
    return t.withColumn("dep", dep).withColumn("tag", F.concat(F.left("pos", F.lit(2)), F.right("word", F.lit(1))))
