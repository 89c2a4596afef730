"""Inter-coder reliability over span annotations (doc_id, coder, start, end, label) and lengths (doc_id, n_chars).

A text is cut at every span's ends; inside a segment nobody's labels change, so a segment stands for
all its characters with its length as weight. Nothing is expanded to single characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize


def ratings(spans: DataFrame, lengths: DataFrame, coders: list[str]) -> DataFrame:
    """(doc_id, start, size, coder, category) per segment and coder; the category is the set of labels, as a bit string over all labels in order."""
    labels = sorted((r.label for r in materialize(spans.select("label").distinct(), "labels").collect()), key=lambda x: (x is not None, x))  # the framework's labels
    inside = spans.join(lengths, "doc_id").select("doc_id", "coder", "label", F.greatest(F.lit(0), "start").alias("start"), F.least("end", "n_chars").alias("end")).where("start < end")
    cuts = inside.select("doc_id", F.explode(F.array("start", "end")).alias("at")).unionByName(lengths.select("doc_id", F.explode(F.array(F.lit(0).cast(spans.schema["start"].dataType), F.col("n_chars").cast(spans.schema["start"].dataType))).alias("at")))
    by_doc = Window.partitionBy("doc_id").orderBy("at")
    segments = cuts.distinct().select("doc_id", F.col("at").alias("start"), (F.lead("at").over(by_doc) - F.col("at")).alias("size")).where("size > 0")
    each = segments.withColumn("coder", F.explode(F.array(*map(F.lit, coders))))
    # running counts of open spans per label, from the spans' ends; a segment's own row adds nothing
    one = lambda sign: [F.when(F.col("label") == x, sign).otherwise(0).alias(f"l{k}") for k, x in enumerate(labels)]
    opens = inside.select("doc_id", "coder", "start", F.lit(None).cast("int").alias("size"), *one(1))
    closes = inside.select("doc_id", "coder", F.col("end").alias("start"), F.lit(None).cast("int").alias("size"), *one(-1))
    rows = each.select("doc_id", "coder", "start", F.col("size").cast("int").alias("size"), *(F.lit(0).alias(f"l{k}") for k in range(len(labels))))
    so_far = Window.partitionBy("doc_id", "coder").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    bits = [F.when(F.sum(f"l{k}").over(so_far) > 0, "1").otherwise("0") for k in range(len(labels))]
    out = rows.unionByName(opens).unionByName(closes).select("doc_id", "start", "size", "coder", (F.concat(*bits) if bits else F.lit("")).alias("category"))
    return out.where("size is not null")


def units(r: DataFrame) -> DataFrame:
    """(ratings, size): how many characters have these ratings (coder, category), in order of the coders.

    All coefficients follow from this table, which has a row per combination in use, not per segment.
    """
    if "ratings" in r.columns:
        return r
    u = r.groupBy("doc_id", "start", "size").agg(F.sort_array(F.collect_list(F.struct("coder", "category"))).alias("ratings"))
    return u.groupBy("ratings").agg(F.sum("size").alias("size"))


def _pairs(r: DataFrame) -> DataFrame:
    """A row per combination in use and pair of its coders."""
    pairs = F.flatten(F.transform("ratings", lambda a: F.transform(F.filter("ratings", lambda b: a["coder"] < b["coder"]), lambda b: F.struct(a["coder"].alias("coder1"), b["coder"].alias("coder2"), a["category"].alias("c1"), b["category"].alias("c2")))))
    return units(r).select(F.inline(pairs), "size")


def percent_agreement(r: DataFrame) -> DataFrame:
    """(coder1, coder2, agreement): share of characters with the same labels, in per cent."""
    p = _pairs(r).groupBy("coder1", "coder2").agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("size")).otherwise(0)).alias("same"), F.sum("size").alias("n"))
    return p.select("coder1", "coder2", F.round(F.col("same") * 100.0 / F.col("n"), 4).alias("agreement"))


def band(value: Column) -> Column:
    return F.when(value >= 0.8, "almost perfect").when(value >= 0.6, "substantial").when(value >= 0.4, "moderate").when(value >= 0.2, "fair").when(value >= 0, "slight").otherwise("poor")


def f1_band(f1: Column) -> Column:
    return F.when(f1 >= 0.9, "excellent").when(f1 >= 0.8, "good").when(f1 >= 0.7, "fair").when(f1 >= 0.6, "moderate").when(f1 >= 0.5, "poor").otherwise("very poor")


def cohens_kappa(r: DataFrame) -> DataFrame:
    """(coder1, coder2, kappa, band) over label sets as categories."""
    n = _pairs(r).groupBy("coder1", "coder2", "c1", "c2").agg(F.sum("size").cast("double").alias("n"))
    total = n.groupBy("coder1", "coder2").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("n")).otherwise(0.0)).alias("same"))
    side = lambda c, m: n.groupBy("coder1", "coder2", F.col(c).alias("c")).agg(F.sum("n").alias(m))
    chance = side("c1", "m1").join(side("c2", "m2"), ["coder1", "coder2", "c"]).groupBy("coder1", "coder2").agg(F.sum(F.col("m1") * F.col("m2")).alias("both"))
    x = total.join(chance, ["coder1", "coder2"], "left").withColumn("pe", F.coalesce("both", F.lit(0.0)) / (F.col("total") * F.col("total"))).withColumn("po", F.col("same") / F.col("total"))
    k = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0)
    return x.select("coder1", "coder2", F.round(k, 4).alias("kappa"), band(k).alias("band"))


def fleiss_kappa(r: DataFrame) -> DataFrame:
    """(p, pe, kappa)."""
    u = units(r).withColumn("c", F.col("ratings.category")).withColumn("m", F.size("c").cast("double"))
    same = F.aggregate("c", F.lit(0.0), lambda s, a: s + F.size(F.filter("c", lambda b: a == b)) - 1)
    p = u.agg((F.sum(F.col("size") * same / (F.col("m") * (F.col("m") - 1))) / F.sum("size")).alias("p"))
    share = u.select(F.explode("c").alias("category"), "size").groupBy("category").agg(F.sum("size").cast("double").alias("n"))
    all_ = share.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    x = p.crossJoin(F.broadcast(all_)).withColumn("pe", F.col("squares") / (F.col("all") * F.col("all")))  # one row each
    k = F.when(F.col("pe") < 1, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0)
    return x.select(F.round("p", 4).alias("p"), F.round("pe", 4).alias("pe"), F.round(k, 4).alias("kappa"))


def coincidences(r: DataFrame) -> DataFrame:
    """(c, k, o): weighted pairs of ratings of one unit by different coders."""
    c = F.col("ratings.category")
    pairs = F.flatten(F.transform(c, lambda a, i: F.transform(F.filter(c, lambda _, j: j != i), lambda b: F.struct(a.alias("c"), b.alias("k")))))
    u = units(r).select("size", F.size("ratings").alias("m"), F.inline(pairs))
    return u.groupBy("c", "k").agg(F.sum(F.col("size") / (F.col("m") - 1)).alias("o")).where("o > 0")


def krippendorff_alpha(r: DataFrame, level: str = "nominal") -> DataFrame:
    """(level, alpha, observed, expected); other levels than nominal use the category's index in order."""
    o = coincidences(r)
    m = o.groupBy("c").agg(F.sum("o").alias("n"))
    order = Window.orderBy("c")  # one row per category in use
    m = m.select("c", "n", (F.row_number().over(order) - 1).alias("i"), (F.sum("n").over(order) - F.col("n")).alias("below"))
    total = m.agg(F.sum("n").alias("total"))
    side = lambda c, p: m.select(F.col("c").alias(c), *(F.col(x).alias(f"{p}{x}") for x in ("n", "i", "below")))
    grid = side("c", "c_").crossJoin(F.broadcast(side("k", "k_"))).join(o, ["c", "k"], "left")  # categories by categories
    ci, ki = F.col("c_i"), F.col("k_i")
    spread = F.abs(F.col("c_below") - F.col("k_below")) + F.when(ci > ki, F.col("c_n")).otherwise(F.col("k_n"))
    delta = {
        "nominal": F.when(ci == ki, 0.0).otherwise(1.0),
        "interval": ((ci - ki) * (ci - ki)).cast("double"),
        "ratio": F.when((ci == ki) | (ci + ki == 0), 0.0).otherwise(((ci - ki) / (ci + ki)) * ((ci - ki) / (ci + ki))),
        "ordinal": F.when(ci == ki, 0.0).otherwise((spread - (F.col("c_n") + F.col("k_n")) / 2) * (spread - (F.col("c_n") + F.col("k_n")) / 2)),
    }[level]
    s = grid.select(delta.alias("d"), F.coalesce("o", F.lit(0.0)).alias("o"), "c_n", "k_n").agg(F.sum(F.col("o") * F.col("d")).alias("do"), F.sum(F.col("c_n") * F.col("k_n") * F.col("d")).alias("de"))
    s = s.crossJoin(F.broadcast(total)).select((F.col("do") / F.col("total")).alias("do"), (F.col("de") / (F.col("total") * (F.col("total") - 1))).alias("de"))
    alpha = F.when(F.col("de") > 0, 1 - F.col("do") / F.col("de")).otherwise(F.when(F.col("do") == 0, 1.0).otherwise(0.0))
    return s.select(F.lit(level).alias("level"), F.round(alpha, 4).alias("alpha"), F.round("do", 4).alias("observed"), F.round("de", 4).alias("expected"))


def precision_recall(spans: DataFrame, gold: str) -> DataFrame:
    """(coder, label, tp, fp, fn, precision, recall, f1) against the gold coder, spans as (doc_id, start, end, label); label `*` over all."""
    key = ["doc_id", "start", "end", "label"]
    s = spans.groupBy(*key).agg(F.sort_array(F.collect_set("coder")).alias("by"))
    known = F.lit(True)
    for c in key:
        known &= F.col(c).isNotNull()
    # a row per label and set of coders, not per span
    s = materialize(s.groupBy("label", "by", known.alias("known")).agg(F.count("*").alias("n")), "marked")
    names = s.select(F.explode("by").alias("coder")).where(F.col("coder") != gold).distinct()
    h, g = F.array_contains("by", F.col("coder")), F.array_contains("by", gold)
    x = s.crossJoin(F.broadcast(names)).where(h | g)  # one row per coder
    ways = (("tp", h & g & F.col("known")), ("fp", h & ~(g & F.col("known"))), ("fn", g & ~(h & F.col("known"))))
    n = x.groupBy("coder", "label").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in ways))
    n = n.unionByName(n.groupBy("coder").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn"))).withColumn("label", F.lit("*")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("coder", "label", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def gold_summary(counts: DataFrame) -> DataFrame:
    """(kind, item, precision, recall, f1, band) of precision_recall(): per coder, per label over all coders, and the coders' means, whose band is that of the mean precision and recall."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = lambda t: t.withColumns({"p": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": ratio(F.col("tp"), F.col("tp") + F.col("fn"))}).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    coders = scored(counts.where("label = '*'")).select(F.lit("coder").alias("kind"), F.col("coder").alias("item"), "p", "r", "f")
    labels = scored(counts.where("label != '*'").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))).select(F.lit("label").alias("kind"), F.col("label").alias("item"), "p", "r", "f")
    mean = coders.agg(*(F.avg(c).alias(c) for c in ("p", "r", "f"))).select(F.lit("mean").alias("kind"), F.lit("*").alias("item"), "p", "r", "f")
    out = coders.unionByName(labels).unionByName(mean)
    return out.select("kind", "item", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f", 4).alias("f1"), f1_band(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))).alias("band"))


def report(spans: DataFrame, lengths: DataFrame, coders: list[str], gold: str | None = None) -> DataFrame:
    """(measure, item, value, band): every coefficient in one table, ready for a CSV or JSON writer.

    Items are pairs of coders, levels of measurement, coders or labels; `*` is the whole. The combinations of ratings are counted once and read by each measure.
    """
    r = materialize(units(ratings(spans, lengths, coders)), "units")
    pair, none = F.concat_ws("-", "coder1", "coder2").alias("item"), F.lit(None).cast("string").alias("band")
    named = lambda t, measure, item, value, band_: t.select(F.lit(measure).alias("measure"), item, F.col(value).alias("value"), band_)
    agreement, kappa, fleiss = percent_agreement(r), cohens_kappa(r), fleiss_kappa(r)
    rows = [named(agreement, "percent_agreement", pair, "agreement", none), named(kappa, "cohens_kappa", pair, "kappa", F.col("band")), named(fleiss, "fleiss_kappa", F.lit("*").alias("item"), "kappa", band(F.col("kappa")).alias("band"))]
    rows += [named(krippendorff_alpha(r, level), "krippendorff_alpha", F.col("level").alias("item"), "alpha", band(F.col("alpha")).alias("band")) for level in ("nominal", "ordinal", "interval", "ratio")]
    if gold is not None:
        g = gold_summary(precision_recall(spans, gold))
        item = F.concat_ws(":", "kind", "item").alias("item")
        rows += [named(g, m, item, m, F.col("band") if m == "f1" else none) for m in ("precision", "recall", "f1")]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


#: Sections of a page in order; other measures follow by name.
TITLES = {"percent_agreement": "Percent agreement", "cohens_kappa": "Cohen's kappa", "fleiss_kappa": "Fleiss' kappa", "krippendorff_alpha": "Krippendorff's alpha", "precision": "Precision", "recall": "Recall", "f1": "F1"}
_GUIDE = (("0.8 and more", "almost perfect"), ("0.6 to 0.8", "substantial"), ("0.4 to 0.6", "moderate"), ("0.2 to 0.4", "fair"), ("0 to 0.2", "slight"), ("below 0", "poor"))


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def report_page(rows: DataFrame, title: str = "Inter-coder reliability") -> DataFrame:
    """(nth, html): report() as one HTML page in parts, the head, a section per measure, and how to read the values.

    A section lists its items in order with value and band; measures of pairs of coders also have their mean,
    rounded half up in whole ten-thousandths. Names are escaped; null values and bands show as `-`. An
    empty report gives head and guide alone. A section holds a row per pair, level, coder or label.
    """
    order = F.coalesce(F.create_map(*(F.lit(x) for kv in zip(TITLES, range(1, len(TITLES) + 1)) for x in kv))[F.col("measure")], F.lit(len(TITLES) + 1))
    heading = F.coalesce(F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))[F.col("measure")], F.col("measure"))
    number = lambda v: F.coalesce(F.when(v.isNotNull(), F.format_string("%.4f", v)), F.lit("-"))
    line = lambda item, value, name: F.concat(F.lit("<tr><td>"), item, F.lit("</td><td>"), value, F.lit("</td><td>"), name, F.lit("</td></tr>"))
    each = line(_escaped(F.coalesce("item", F.lit("-"))), number(F.col("value")), _escaped(F.coalesce("band", F.lit("-"))))
    whole = F.round(F.col("value") * 10000).cast("bigint")
    s = rows.where("measure is not null").groupBy("measure").agg(F.sort_array(F.collect_list(F.struct("item", each.alias("x")))).alias("lines"), F.sum(whole).alias("s"), F.count("value").alias("n"))
    mean = F.floor((2 * F.col("s") + F.col("n")) / (2 * F.col("n"))) / 10000
    last = F.when(F.col("measure").isin("percent_agreement", "cohens_kappa") & (F.col("n") > 0), line(F.lit("mean"), number(mean), F.lit("-"))).otherwise("")
    section = F.concat(F.lit("<section><h2>"), _escaped(heading), F.lit("</h2><table><tr><th>Item</th><th>Value</th><th>Band</th></tr>"), F.array_join("lines.x", ""), last, F.lit("</table></section>"))
    # one row per measure
    body = s.select(F.row_number().over(Window.orderBy(order, "measure")).alias("nth"), section.alias("html"))
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(0).alias("nth"), F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), _escaped(F.lit(title)), F.lit("</title></head><body><h1>"), _escaped(F.lit(title)), F.lit("</h1>")).alias("html"))
    guide = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in _GUIDE)
    foot = spark.range(1).select(F.lit((1 << 31) - 1).alias("nth"), F.lit(f"<section><h2>Reading kappa and alpha</h2><table><tr><th>Value</th><th>Band</th></tr>{guide}</table></section></body></html>").alias("html"))
    return head.unionByName(body).unionByName(foot)


def unit_table(spans: DataFrame, n_coders: int) -> DataFrame:
    """(doc_id, start, end, label, coders, rate, agreed) per annotated position: the first coder's label, how many annotated it, and whether all labels are one."""
    n = spans.groupBy("doc_id", "start", "end").agg(F.min(F.struct("coder", "label")).alias("first"), F.count_distinct("coder").alias("coders"), F.count_distinct("label").alias("labels"))
    return n.select("doc_id", "start", "end", "first.label", "coders", F.round(F.col("coders") / n_coders, 4).alias("rate"), (F.col("labels") == 1).alias("agreed"))


def position_details(spans: DataFrame, coders: list[str]) -> DataFrame:
    """(doc_id, start, end, coder, annotated, label): every position for every coder."""
    units = spans.select("doc_id", "start", "end").distinct().withColumn("coder", F.explode(F.array(*map(F.lit, coders))))
    first = spans.groupBy("doc_id", "start", "end", "coder").agg(F.min("label").alias("label"))
    return units.join(first, ["doc_id", "start", "end", "coder"], "left").select("doc_id", "start", "end", "coder", F.col("label").isNotNull().alias("annotated"), F.coalesce("label", F.lit("")).alias("label"))


def confusion(spans: DataFrame, coder1: str, coder2: str) -> DataFrame:
    """(label1, label2, n) over positions that either annotated; an empty label stands for none."""
    p = position_details(spans, [coder1, coder2])
    return p.groupBy("doc_id", "start", "end").agg(*(F.max(F.when(F.col("coder") == c, F.col("label"))).alias(a) for c, a in ((coder1, "label1"), (coder2, "label2")))).groupBy("label1", "label2").agg(F.count("*").alias("n")).where("label1 != '' or label2 != ''")


def _even(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _alike(x: Column, y: Column, most: int | None = None) -> Column:
    edits = F.levenshtein(x, y) if most is None else F.levenshtein(x, y, most)  # -1 beyond `most`
    return F.when((F.length(x) == 0) | (F.length(y) == 0) | (edits < 0), 0.0).otherwise(1 - edits / F.greatest(F.length(x), F.length(y)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of lower-cased texts with white space evened out; empty gives 0."""
    return _alike(_even(a), _even(b))


def fuzzy_find(texts: DataFrame, needle: str, least: float = 0.8, near: str | None = None, step: int = 1024) -> DataFrame:
    """(text_id, start, end, similarity): every window of the needle's length that is as similar as `least`.

    A text without one gives every window from a third shorter to a third longer. With `near`, the name of a
    column with the expected start, windows lie within half the needle's length around that place. Texts are read
    whole, in pieces of `step` starts that overlap by a window, so that a place in a long text costs no more
    than one in a short text. Null texts, texts shorter than any window and an empty needle give nothing.
    """
    n = len(needle)
    if not n:
        return texts.select("text_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("similarity")).limit(0)
    even = " ".join(needle.lower().split())
    other = [m for m in range(n - -(-n // 3), n + n // 3 + 1) if m > 0]
    most = int((1 - least) * 2 * max(other)) + 1  # edits that no window within `least` reaches; lower-casing may lengthen a text
    low = F.greatest(F.lit(0), F.col(near) - n // 2) if near else F.lit(0)
    high = F.least(F.length("text"), F.col(near) + n + n // 2) if near else F.length("text")
    bases = F.when(high - low >= min(other), F.sequence(low, high - min(other), F.lit(step)))
    pieces = F.transform(bases, lambda i: F.struct(i.alias("at"), F.substring(F.col("text"), i + 1, F.least(F.lit(step + max(other) - 1), high - i)).alias("piece")))

    def windows(m: int) -> Column:
        def inside(x: Column) -> Column:
            starts = F.when(F.length(x["piece"]) >= m, F.sequence(F.lit(0), F.least(F.lit(step - 1), F.length(x["piece"]) - m)))
            read = F.transform(starts, lambda i: F.struct((x["at"] + i).alias("at"), _even(F.substring(x["piece"], i + 1, F.lit(m))).alias("text")))
            scored = F.transform(read, lambda w: F.struct(w["at"].alias("start"), (w["at"] + m).alias("end"), _alike(w["text"], F.lit(even), most).alias("similarity")))
            return F.coalesce(F.filter(scored, lambda y: y["similarity"] >= least), F.array().cast("array<struct<start:int,end:int,similarity:double>>"))

        return F.flatten(F.transform("pieces", inside))

    t = texts.where("text is not null").select("text_id", pieces.alias("pieces")).where("pieces is not null").withColumn("same", windows(n))
    found = F.when(F.size("same") > 0, F.col("same")).otherwise(F.concat(*map(windows, other)))
    return t.select("text_id", F.explode(found).alias("w")).select("text_id", "w.start", "w.end", F.round("w.similarity", 4).alias("similarity"))
