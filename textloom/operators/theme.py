"""Theme and rheme: where a clause's starting point ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dependencies of subjects, and parts of speech that can close a theme without one.
SUBJECTS = ("nsubj", "nsubjpass", "csubj", "expl")
NOMINAL = ("NOUN", "PROPN", "PRON", "NUM")
TEXTUAL_DEPS, TEXTUAL_POS = ("cc", "mark", "advmod"), ("CCONJ", "SCONJ", "ADV")
MODIFIERS = ("compound", "flat", "amod", "acomp", "det", "nummod", "poss", "case", "prep", "pobj")


def themes(tokens: DataFrame) -> DataFrame:
    """(text_id, sent_idx, boundary, theme, rheme, has_textual): per sentence the first subject or nominal closes the theme, or its root verb.

    Punctuation is skipped; textual markers in front belong to the theme. The theme's phrase runs on
    over modifiers that follow directly. Without any of these the first word is the theme. A rheme of
    one character or less is dropped.
    """
    t = tokens.withColumn("closes", F.col("dep").isin(*SUBJECTS) | F.col("pos").isin(*NOMINAL) | ((F.col("dep") == "ROOT") & (F.col("pos") == "VERB")))
    real = ~F.col("is_punct")
    s = t.groupBy("text_id", "sent_idx").agg(
        F.min(F.when(real & F.col("closes"), F.struct("tok_idx", "pos"))).alias("close"),
        F.min(F.when(real, F.col("tok_idx"))).alias("first"),
        F.max("tok_idx").alias("last"),
        F.sort_array(F.collect_list(F.struct("tok_idx", "text", "dep", "pos", "is_punct"))).alias("t"),
    )
    s = s.where("first is not null").withColumn("at", F.coalesce("close.tok_idx", "first"))
    behind = F.filter("t", lambda x: x["tok_idx"] > F.col("at"))
    stop = F.array_min(F.transform(F.filter(behind, lambda x: ~x["dep"].isin(*MODIFIERS)), lambda x: x["tok_idx"]))
    run_on = F.when(F.col("close.pos") != "VERB", F.coalesce(stop - 1, F.col("last"))).otherwise(F.col("at"))
    s = s.withColumn("boundary", F.coalesce(run_on, F.col("at")))
    text = lambda keep: F.array_join(F.transform(F.filter("t", keep), lambda x: x["text"]), " ")
    rheme = text(lambda x: x["tok_idx"] > F.col("boundary"))
    marks = F.exists("t", lambda x: (x["tok_idx"] < F.col("at")) & (x["dep"].isin(*TEXTUAL_DEPS) | x["pos"].isin(*TEXTUAL_POS)))
    return s.select("text_id", "sent_idx", "boundary", text(lambda x: x["tok_idx"] <= F.col("boundary")).alias("theme"), F.when(F.length(rheme) > 1, rheme).otherwise("").alias("rheme"), marks.alias("has_textual"))
