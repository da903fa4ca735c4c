"""One consistent form of texts that look alike.

canonical(): compatibility normalisation (composed), full case folding, mapped white space, default-ignorable
characters removed, look-alike letters mapped to Latin; the form to compare by. visible(): the same without what
a reader sees differently: case and raised, lowered or otherwise restyled characters stay. Both are computed once
per distinct value, and only for values holding a character that either form could change; all others are their
own visible form.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import written

# Capital and small letters of other scripts with the shape of a Latin letter.
LOOKALIKE = dict(zip(
    "АВЕКМНОРСТУХЅІЈԌԚԜ" "авекморсухѕіјһԁԛԝ".replace("в", "").replace("к", "").replace("м", "")
    + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ο",
    "ABEKMHOPCTYXSIJGQW" "aeopcyxsijhdqw"
    + "ABEZHIKMNOPTYX" "o", strict=True))
# Default-ignorable code points: soft hyphen, joiners, direction and format marks, variation selectors, fillers.
IGNORABLE = ("\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e"
             "\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff0-\\ufff8")
SPACES = "\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000\\t"
# Latin text with the usual marks, in which nothing can change: its visible form is the text itself.
SETTLED = "^[\\x0a\\x20-\\x7e\\u00a1-\\u00a7\\u00a9\\u00ab\\u00ac\\u00b0-\\u00b3\\u00b6\\u00b7\\u00b9\\u00bb-\\u0131\\u0134-\\u02af" \
          "\\u2010-\\u2027\\u2030-\\u203a\\u20a0-\\u20bf]*$"
# Text of which the canonical form is its lower case with the sharp s spelt out.
PLAIN = "^[\\x0a\\x20-\\x7e\\u00a1-\\u00a7\\u00a9\\u00ab\\u00ac\\u00b0\\u00b6\\u00bb\\u00bf-\\u00ff\\u2013-\\u2015\\u2018-\\u201e\\u20ac]*$"
# Compatibility mappings of one character that a reader sees as the same form: width, spaces, ligatures.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")

_ignore = re.compile(f"[{IGNORABLE}]").sub
_space = re.compile(f"[{SPACES}]").sub
_table: dict[int, str] = {}


class _Visible(dict):
    """Code point to what a reader sees, filled on demand."""

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        got = LOOKALIKE.get(ch)
        if got is None:
            kind, _, _ = unicodedata.decomposition(ch).partition(" ")
            ligature = kind == "<compat>" and "LIGATURE" in unicodedata.name(ch, "")
            got = unicodedata.normalize("NFKC", ch) if kind in SAME_LOOK or ligature else ch
            got = LOOKALIKE.get(got, got)
        self[point] = got
        return got


_seen = _Visible()


def visible_form(text: str) -> str:
    out = _space(" ", _ignore("", text)).translate(_seen)
    return unicodedata.normalize("NFC", out)


def canonical_form(text: str) -> str:
    out = unicodedata.normalize("NFKC", visible_form(text)).casefold()
    return unicodedata.normalize("NFKC", out)


_FORMS = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("visible", T.StringType())])


@F.pandas_udf(_FORMS)
def _forms(values: pd.Series) -> pd.DataFrame:
    values = values.fillna("")
    one = {v: (canonical_form(v), visible_form(v)) for v in values.unique()}
    return pd.DataFrame([one[v] for v in values], columns=["canonical", "visible"])


def settled(col: Column) -> Column:
    return col.rlike(SETTLED)


def forms(df: DataFrame, text_col: str) -> DataFrame:
    """(text, canonical, visible), one row for each distinct text of df. Null is no text and has no row; the empty
    text is its own form. Other columns of df are not read."""
    d = df.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    f = _forms("text")
    simple = F.col("text").rlike(PLAIN)
    plain = d.where(simple).select("text", F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")).alias("canonical"),
                                   F.col("text").alias("visible"))
    odd = d.where(~simple).select("text", f["canonical"].alias("canonical"),
                                                  f["visible"].alias("visible"))
    return plain.unionByName(odd)


def same_look_pairs(df: DataFrame, id_col: str, text_col: str, salts: int = 8) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of all rows whose texts are different strings of one visible form.

    Rows with a null id or text have no pair, repeated rows count once. A form with more than one spelling has at
    least one spelling that isn't settled, so only the forms of unsettled values are looked up; exact copies make
    no pair, and a form that a large part of the rows shares is spread over salts.
    """
    rows = (df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
              .where("id IS NOT NULL AND text IS NOT NULL").distinct())
    f = _forms("text")
    odd = (rows.where(~settled(F.col("text")))
               .select("id", "text", f["canonical"].alias("c"), f["visible"].alias("v")))
    odd = written(odd.select("id", F.xxhash64("c").alias("ck"), F.xxhash64("v").alias("vk"), F.md5("v").alias("vm"),
                     F.md5("text").alias("tm")))  # three joins read it
    plain = (rows.where(settled(F.col("text")))
                 .select("id", F.xxhash64("text").alias("vk"), F.md5("text").alias("vm")))
    spread = odd.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    one = (spread.alias("o").join(plain.withColumn("salt", (F.col("id") % salts).cast("int")).alias("p"),
                                  ["vk", "vm", "salt"])
                 .select(F.col("o.id").alias("x"), F.col("p.id").alias("y")))
    other = odd.withColumn("salt", (F.col("id") % salts).cast("int"))
    two = (spread.alias("o").join(other.alias("p"), ["ck", "vk", "vm", "salt"])
                 .where("o.id < p.id AND o.tm <> p.tm").select(F.col("o.id").alias("x"), F.col("p.id").alias("y")))
    return (one.unionByName(two).where("x <> y")
               .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct())


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, n_rows, n_spellings): the rows of every visible form that has several spellings, with the md5 of the form as
    their class; one row for each id and spelling, where same_look_pairs() would have the square of them. Counts are made
    by spelling first, so that a form that a large part of the rows shares is a few rows where they meet."""
    rows = (df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
              .where("id IS NOT NULL AND text IS NOT NULL").distinct())
    f = _forms("text")
    plain = rows.where(settled(F.col("text"))).select("id", F.md5("text").alias("form"), F.md5("text").alias("spelling"))
    odd = rows.where(~settled(F.col("text"))).select("id", F.md5(f["visible"]).alias("form"), F.md5("text").alias("spelling"))
    keyed = written(plain.unionByName(odd))
    several = (keyed.groupBy("form", "spelling").agg(F.count("*").alias("n")).groupBy("form").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))
                    .where("n_spellings > 1"))
    return keyed.join(several, "form").select("id", "form", "n_rows", "n_spellings")
