"""Texts that were cut off.

For each source, field and unit (code points, bytes) the discrete hazard of ending at a length, given that the text
is at least so long, is tested against the hazard of the neighbouring lengths; false discoveries are controlled over
all lengths of all sources. A text is cut if its end is incomplete and it either has a significant length, whatever
its end where most texts go no further, or is running text of which the end can be told: a mark of omission, an open sentence behind a closed one, or an opening
whose other texts close.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.sentences import BEFORE_NUMBER, OPEN
from pagewright.session import written

NEIGHBOURS = 25  # lengths on each side
FDR = 0.01
BINS = 3300  # tenths of a power of ten that a double can hold
LEAST_COUNT = 4  # texts of one length
RATIO = 8  # times the neighbours' hazard that a length's hazard must have
LIMIT = 0.5  # part of the texts so long or longer that end at a significant length, from which it is a limit of the source
FOOTER_SHARE = 0.02  # part of a field's texts that close with one paragraph, which then marks a whole text
FAMILY, CLOSED = 5, 0.6  # texts of one opening, and the part of them that closes
REPEATS, SAME_WORD = 3, 0.7  # texts that close with one line, and the part of them with one word before it, up to which it may be a page header

SPACE = r"[\s\p{Z}]"
MARK = rf"(?:…|\.\.\.|\x{{FFFD}}|\[(?:…|\.\.\.|gekürzt|cut|truncated)\]|\((?:…|\.\.\.|gekürzt)\))[\s\p{{Z}}*]*$"
TERMINAL = r"(?:(?<=[\u0370-\u03ff])[;\u037e]|[.!?。！？।॥؟۔](?:[\s\p{Z}]*[)\]\"'”“’‘»«›‹」』）])*|[.!?][*_]+)$"
PAGE_NO = r"[ \t]*(?:[-–—\[(]?[ \t]*\p{N}{1,4}[ \t]*[-–—\])]?|(?i:seite|blatt|page|s\.)[ \t]*\p{N}{1,4}(?:[ \t]*(?:von|/|of)[ \t]*\p{N}{1,4})?|\p{N}{1,4}[ \t]*/[ \t]*\p{N}{1,4})[ \t]*"
PAGE_LINE = rf"(?:\n{PAGE_NO})+$"
RUNNING = (r"[.!?。！？।؟](?:(?<=[。！？।؟])|(?<=(?:\p{L}{4}|\p{N}[“”»«)]|usw|etc|p\. ?a|\p{N}{2}|u\. Ä)[.!?])(?<!(?:einschl|entspr|insbes|zuzügl|Buchst|Absch)\.)"
           r"[.!?]*[“”»«)]*[\s\p{Z}]+[\p{Lu}\p{Lo}„»“«\p{N}])")  # begins with a mark, which the search can skip to


def _abbreviated() -> str:
    words = "|".join(sorted({w.replace(".", r"\.") for w in [*OPEN, *BEFORE_NUMBER] if w in OPEN or w[0].isupper()}, key=len, reverse=True))
    return (rf"(?:(?<![\p{{L}}\p{{N}}])(?:{words})|(?<![\p{{L}}\p{{N}}])(?:i\. ?[SV]|i\. ?S\. ?d|i\. ?V\. ?m|z\. ?B|d\. ?h|v\. ?H)"
            r"|(?:am|vom|zum|dem|ab dem|bis zum|den) \p{N}{1,2})\.$")


def _open_quotes(x: Column) -> Column:
    count = lambda s: F.length(x) - F.length(F.replace(x, F.lit(s), F.lit("")))
    return F.contains(x, F.lit("„")) & (count("„") > count("“") + count("”"))


def _body(x: Column) -> Column:
    return F.when(F.right(x, F.lit(1)).rlike(SPACE), F.regexp_replace(x, rf"{SPACE}+$", "")).otherwise(x)


def _without_page_numbers(x: Column) -> Column:
    last = F.substring_index(x, "\n", -1)
    return F.when(F.contains(x, F.lit("\n")) & last.rlike(f"^{PAGE_NO}$"), _body(F.regexp_replace(x, PAGE_LINE, ""))).otherwise(x)


def _with_flags(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with a struct of what the end of a text tells: mark of omission, full stop, running text, list item or heading,
    opening words. What several of them need is a projection of its own, so that it is computed once."""
    df = df.withColumn("_end", F.right(col, F.lit(80)))  # patterns of the end need no more
    df = df.withColumn("_y", F.when(F.endswith(F.col("_end"), F.lit("*")), _body(F.regexp_replace(col, r"[\s\p{Z}]+\*+$", ""))).otherwise(F.col(col)))
    df = df.withColumn("_last", F.substring_index("_y", "\n\n", -1)).withColumn("_tail", F.right("_y", F.lit(80)))
    df = df.withColumn("_item", F.when(F.col("_last").rlike(r"^[*#]"), F.regexp_replace("_last", r"^(?:\*\*[^*\n]{1,12}\*\*|#+)[\s]*", "")).otherwise(F.col("_last")))
    flags = F.struct(
        (F.col("_end").rlike(MARK) & ~F.col("_end").rlike(r"„…[“”]?$")).alias("mark"),
        (F.col("_tail").rlike(TERMINAL) & ~(F.endswith(F.col("_tail"), F.lit(".")) & F.right("_tail", F.lit(32)).rlike(_abbreviated())) & ~_open_quotes(F.col("_last"))).alias("terminal"),
        F.when(F.col("field").contains("_markdown"), F.col("_item")).otherwise(F.col("_y")).rlike(RUNNING).alias("prose"),
        F.col("_last").rlike(r"^(?:\*\*[^*\n]{1,12}\*\*\s*)?\p{Ll}|^#+\s").alias("list"),
        F.regexp_replace(F.lower(F.regexp_extract(F.substring("_item", 1, 200), r"^(\S+\s+\S+\s+\S+)\s", 1)), r"\p{N}+", "#").alias("opening"))
    return df.withColumn(name, F.when(F.col(col).isNotNull(), flags)).drop("_end", "_y", "_last", "_tail", "_item")


def ends(df: DataFrame) -> DataFrame:
    """(field, id, source, n_chars, n_bytes, comma, whole, mark, terminal, prose, list, opening) of df (field, id, source,
    text). The texts are read once, each end judged as it is and, in texts of several lines, without the last line; which
    of the two holds is decided by how many texts share that line."""
    t = F.col("t")
    d = df.withColumn("t", _body(F.col("text")))
    d = d.withColumn("t", _without_page_numbers(t))
    several = F.contains(t, F.lit("\n"))
    d = d.withColumn("lastp", F.when(F.contains(t, F.lit("\n\n")), F.substring_index("t", "\n\n", -1)))
    # a short last paragraph stands for itself, in a long one the last line may be a header
    d = d.withColumn("lastl", F.when(several & ~F.coalesce(F.length("lastp") <= 200, F.lit(False)), F.regexp_replace(F.lower(F.trim(F.substring_index("t", "\n", -1))), r"\p{N}+", "#")))
    without = F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, "\n", -1)) - 1)
    d = d.withColumn("above", F.when(F.col("lastl").isNotNull(), _body(without))).withColumn("above", _without_page_numbers(F.col("above")))
    # some headers are told by their look: signs and figures, capitals only
    look = F.substring_index("t", "\n", -1)
    signs = look.rlike(r"\||·|^UR-N[Rr]")
    dated = look.rlike(r"^(?=.*(?:\p{N}/\p{N}|\p{N}{4}$))[^.;,]{3,80}$|^[\p{Lu}\p{N}\s&|·./-]{6,80}$") & F.right("above", F.lit(80)).rlike(TERMINAL)
    d = d.select("field", "id", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"),
                 F.right("text", F.lit(20)).rlike(r"[;,:][\s\p{Z}]*$").alias("comma"), F.md5("lastp").alias("lastp"),
                 F.when(~F.col("lastl").rlike(TERMINAL) & (F.col("lastl") != "#"), F.md5("lastl")).alias("lastl"), F.substring_index(F.substring_index("above", "\n", -1), " ", -1).alias("before"),
                 (F.col("above").isNotNull() & (signs | dated)).alias("looks"), "t", "above")
    d = written(_with_flags(_with_flags(d, "t", "f0"), "above", "f1").drop("t", "above"))
    # a last paragraph that many texts of the field share closes whole texts
    sized = d.groupBy("field").agg(F.count("*").alias("rows"))
    foot = (d.where("lastp IS NOT NULL").groupBy("field", "lastp").agg(F.count("*").alias("k"))
             .join(F.broadcast(sized), "field").where(F.col("k") >= F.greatest(F.lit(LEAST_COUNT), FOOTER_SHARE * F.col("rows")))
             .select("field", "lastp", F.lit(True).alias("whole")))  # 1 / FOOTER_SHARE paragraphs of a field at most
    # a last line without a full stop that several texts share is a page header, if different words stand before it; the
    # last line of a clause that was cut in many copies has one
    lines = (d.where("lastl IS NOT NULL").groupBy("lastl", "before").agg(F.count("*").alias("k")).groupBy("lastl").agg(F.sum("k").alias("k"), F.max("k").alias("most"))
              .where((F.col("k") >= REPEATS) & (F.col("most") <= SAME_WORD * F.col("k"))).select("lastl", F.lit(True).alias("header")))
    plain = d.where("lastl IS NULL").withColumn("header", F.lit(None).cast("boolean"))
    lined = d.where("lastl IS NOT NULL").join(lines, "lastl", "left").select(*plain.columns)
    d = plain.unionByName(lined).join(F.broadcast(foot), ["field", "lastp"], "left")
    f = F.when(F.col("looks") | F.coalesce("header", F.lit(False)), F.coalesce("f1", "f0")).otherwise(F.col("f0"))
    return (d.withColumn("f", f).select("field", "id", "source", "n_chars", "n_bytes", "comma", F.coalesce("whole", F.lit(False)).alias("whole"), "f.*"))


def hazards(df: DataFrame, fdr: float = FDR) -> DataFrame:
    """(field, source, unit, len, n, at_risk, expected, p_bound, significant) for each length that LEAST_COUNT or more
    texts of a source have. p_bound bounds the chance of n or more texts where the neighbours' hazard expects so many
    (Chernoff bound of the Poisson law, so a test passed by it is passed); Benjamini-Hochberg over all lengths."""
    if "n_chars" not in df.columns:
        df = df.where("text IS NOT NULL AND text <> ''").select("field", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"))
    u = (df.groupBy("field", F.coalesce("source", F.lit("")).alias("source"), "n_chars", "n_bytes").agg(F.count("*").alias("c"))
           .select("field", "source", "c", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("len")),
                                                            F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("len")))).alias("u"))
           .groupBy("field", "source", "u.unit", "u.len").agg(F.sum("c").alias("n")))
    part = W.partitionBy("field", "source", "unit").orderBy("len")
    near = part.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    h = (u.withColumn("at_risk", F.sum("n").over(part.rangeBetween(0, W.unboundedFollowing)))
          .withColumn("near", F.sum("n").over(near) - F.col("n"))
          .withColumn("risk", F.sum("n").over(part.rangeBetween(-NEIGHBOURS, W.unboundedFollowing))))
    h = h.withColumn("expected", F.col("at_risk") * (F.col("near") + 1) / (2 * NEIGHBOURS * F.col("risk")))
    k, lam = F.col("n"), F.col("expected")
    h = h.withColumn("p_bound", F.when(k > lam, F.exp(-(k * F.log(k / lam) - k + lam))).otherwise(F.lit(1.0)))
    h = h.where(f"n >= {LEAST_COUNT}")
    # the largest p that is still below its rank's share, found over the distinct values of p: ranks inside bins of the
    # logarithm, of which there are BINS at most, and the numbers below each bin
    last = F.coalesce(F.least(F.floor(-F.log10("p_bound") * 10), F.lit(BINS - 1)), F.lit(BINS - 1))
    values = h.groupBy("p_bound").agg(F.count("*").alias("c")).withColumn("bin", last)
    sizes = values.groupBy("bin").agg(F.sum("c").alias("size"))
    below = sizes.withColumn("below", F.sum("size").over(W.orderBy(F.desc("bin"))) - F.col("size")).withColumn("all", F.sum("size").over(W.partitionBy()))
    ranked = values.join(F.broadcast(below), "bin").withColumn("rank", F.col("below") + F.sum("c").over(W.partitionBy("bin").orderBy("p_bound")))
    top = ranked.where(F.col("p_bound") <= fdr * F.col("rank") / F.col("all")).agg(F.max("p_bound").alias("limit"))
    return (h.crossJoin(F.broadcast(top)).withColumn("significant", (F.col("p_bound") <= F.coalesce("limit", F.lit(-1.0)))
                                                             & (F.col("n") >= RATIO * F.col("expected")))
             .select("field", "source", "unit", "len", "n", "at_risk", "expected", "p_bound", "significant"))


def truncated(df: DataFrame) -> DataFrame:
    """(field, id, source, cut BOOLEAN, fixed_length BOOLEAN) for each row of df (field, id, source, text).

    Null, empty and blank texts are whole; a null source is a source of its own; repeated rows are judged alike, and
    count as often as they occur in the statistics; ties have no bearing. Other columns of df are not read."""
    d = df.select("field", "id", "source", "text").where(F.col("text").rlike(r"\S"))
    e = written(ends(d))
    lengths = lambda unit, of: F.collect_set(F.when((F.col("unit") == unit) & of, F.col("len")))
    most = F.col("n") >= LIMIT * F.col("at_risk")
    sig = (hazards(e).where("significant").groupBy(F.col("field"), F.col("source").alias("src"))
            .agg(lengths("chars", F.lit(True)).alias("chars"), lengths("bytes", F.lit(True)).alias("bytes"),
                 lengths("chars", most).alias("most_chars"), lengths("bytes", most).alias("most_bytes")))
    at = lambda a, b: F.coalesce(F.array_contains(a, F.col("n_chars")) | F.array_contains(b, F.col("n_bytes")), F.lit(False))
    e = (e.withColumn("src", F.coalesce("source", F.lit(""))).join(sig, ["field", "src"], "left")
          .withColumn("fixed", at("chars", "bytes")).withColumn("limit", at("most_chars", "most_bytes")))
    # texts at a limit say nothing about how an opening closes
    family = (e.where("NOT limit").where("NOT mark AND NOT list AND NOT prose AND opening <> ''").groupBy("field", "opening")
               .agg(F.count("*").alias("k"), F.avg(F.col("terminal").cast("int")).alias("closing"))
               .where(f"k >= {FAMILY}").select("field", "opening", "closing"))
    e = e.join(family, ["field", "opening"], "left")
    closes = F.coalesce(F.col("closing") >= CLOSED, F.lit(False))
    limit = F.col("limit")
    fixed = limit | (F.col("fixed") & F.coalesce(F.col("closing") > 1 - CLOSED, F.lit(True)))
    cut = ~F.col("whole") & (F.col("mark") | (~F.col("terminal") & (
        limit | (fixed & ~F.col("comma") & ~F.col("list")) | F.col("prose") | (~F.col("list") & closes))))
    return e.select("field", "id", "source", cut.alias("cut"), fixed.alias("fixed_length"))
