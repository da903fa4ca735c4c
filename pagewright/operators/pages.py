"""Pages: inspection, furniture, chunks. Input page(doc_id, page_no, pos, text); pos orders the pages of a document.
Null and blank texts count as blank pages; repeated rows of a page are read as one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T


def clean(pages: DataFrame) -> DataFrame:
    return (pages.select("doc_id", "page_no", "pos", F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")).alias("text"))
                 .distinct())


def joined(items: Column, sep: str) -> Column:
    """Strings of an array of (order..., s) structs, in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["s"]), sep)


def inspect(pages: DataFrame, large: int = 100) -> DataFrame:
    """(doc_id, n_pages, has_text, needs_confirmation): a document without any text and over `large` pages is asked about first."""
    p = clean(pages).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.bool_or(~T.blank(F.col("text"))).alias("has_text"))
    return p.withColumn("needs_confirmation", ~F.col("has_text") & (F.col("n_pages") > large))


def content_pages(pages: DataFrame) -> DataFrame:
    return clean(pages).where(~T.blank(F.col("text")))


def lines(pages: DataFrame) -> DataFrame:
    return content_pages(pages).select("doc_id", "page_no", "pos", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def furniture_keys(pages: DataFrame) -> DataFrame:
    """(doc_id, key, pages): keys on at least half the document's pages, three at least; none for documents under three pages."""
    n = content_pages(pages).groupBy("doc_id").agg(F.count("*").alias("n"))
    keys = (lines(pages).select("doc_id", "pos", T.furniture_key(F.col("line")).alias("key")).where("key IS NOT NULL")
            .groupBy("doc_id", "key").agg(F.count_distinct("pos").alias("pages")))
    return keys.join(n, "doc_id").where("n >= 3 AND pages >= greatest(3, (n + 1) div 2)").select("doc_id", "key", "pages")


def strip_furniture(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, pos, text): of each furniture key only the first line in document order stays; pages that are
    blank then go."""
    n = content_pages(pages).groupBy("doc_id").agg(F.count("*").alias("n"))
    same = W.partitionBy("doc_id", "key")
    d = lines(pages).withColumn("key", T.furniture_key(F.col("line"))).join(n, "doc_id")
    d = d.withColumn("pages", F.when(F.col("key").isNotNull(), F.size(F.collect_set(F.when(F.col("key").isNotNull(), F.col("pos"))).over(same))))
    d = d.withColumn("rn", F.row_number().over(same.orderBy("pos", "line_no")))
    furniture = F.coalesce(F.expr("n >= 3 AND pages >= greatest(3, (n + 1) div 2)"), F.lit(False))
    kept = d.where(~furniture | (F.col("rn") == 1))
    return (kept.groupBy("doc_id", "page_no", "pos").agg(joined(F.collect_list(F.struct("line_no", F.col("line").alias("s"))), "\n").alias("text"))
                .where(~T.blank(F.col("text"))))


def is_furniture(values: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """values (doc_id, ...) with furniture BOOLEAN: after all keys of the document are cut out, the longest first, fewer
    than four letters remain. False without keys or text."""
    order = F.array_sort(F.collect_set("key"), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
                         .when(a < b, -1).when(a > b, 1).otherwise(0))
    k = keys.groupBy("doc_id").agg(order.alias("_keys"))
    norm = F.regexp_replace(F.regexp_replace(F.lower(T.trim(F.col(col))), r"\p{N}+", "#"), r"[\p{Zs}\t]+", " ")
    rest = F.aggregate("_keys", norm, lambda a, x: F.replace(a, x, F.lit(" ")))
    hit = F.col("_keys").isNotNull() & ~T.blank(F.col(col)) & (T.letters(rest) < 4)
    return values.join(k, "doc_id", "left").withColumn("furniture", F.coalesce(hit, F.lit(False))).drop("_keys")


def dump(pages: DataFrame) -> DataFrame:
    """(doc_id, text): all content pages behind a marker with their number and the document's page count."""
    total = clean(pages).groupBy("doc_id").agg(F.max("page_no").alias("total"))
    marked = content_pages(pages).join(total, "doc_id").withColumn(
        "s", F.concat(F.lit("--- Seite "), F.col("page_no").cast("string"), F.lit(" von "), F.col("total").cast("string"), F.lit(" ---\n"), F.col("text")))
    return marked.groupBy("doc_id").agg(joined(F.collect_list(F.struct("pos", "s")), "\n\n").alias("text"))


def marker_page(c: Column) -> Column:
    return F.regexp_extract(c, r"^--- Seite ([0-9]{1,9})", 1).try_cast("int")


def chunks(pages: DataFrame, most: int = 160_000) -> DataFrame:
    """(doc_id, pos, chunk_no): pages packed greedily into k = ceil(length / most) chunks of even size; a page opens a
    chunk if the running one has pages and would exceed length div k + 1, and it isn't the last. The pages of one
    document are folded in order; only their lengths travel."""
    p = content_pages(pages).select("doc_id", "pos", F.length("text").alias("len"))
    d = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("p"), (F.sum("len") + 2 * (F.count("*") - 1)).alias("total"))
    d = d.withColumn("k", F.expr(f"(total + {most} - 1) div {most}")).withColumn("target", F.expr("total div k + 1"))
    d = d.withColumn("one", (F.col("total") <= most) | (F.size("p") == 1))
    zero = F.expr("named_struct('no', 0L, 'cur', 0L, 'out', cast(array() as array<bigint>))")

    def step(a, x):
        opens = (a["cur"] > 0) & (a["cur"] + x["len"] > F.col("target")) & (a["no"] < F.col("k") - 1) & ~F.col("one")
        no = F.when(opens, a["no"] + 1).otherwise(a["no"])
        return F.struct(no.alias("no"), F.when(opens, F.lit(0).cast("bigint")).otherwise(a["cur"]).__add__(x["len"] + 2).alias("cur"),
                        F.concat(a["out"], F.array(no)).alias("out"))

    d = d.withColumn("c", F.aggregate("p", zero, step)["out"])
    return d.select("doc_id", F.explode(F.arrays_zip("p", "c")).alias("z")).select("doc_id", F.col("z.p.pos").alias("pos"), F.col("z.c").cast("int").alias("chunk_no"))
