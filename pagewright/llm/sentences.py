"""Sentence boundaries in SQL expressions.

Marks that end no sentence (in decimals, addresses on the net, initials, abbreviations, ordinals before a month,
speech inside a sentence) are replaced by private-use characters of the same length, a separator is put behind every
terminator of the script that is left, and the text is split there and restored. As placeholders keep lengths,
the lengths of the pieces give the positions in the original text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOT, QUESTION, BANG, CUT, IDEO, IQUESTION, IBANG = (chr(0xE000 + i) for i in range(7))
MASKS = {".": DOT, "?": QUESTION, "!": BANG, "。": IDEO, "？": IQUESTION, "！": IBANG}

# Abbreviations that the rest of their sentence always follows.
OPEN = ("Aufl Az bes betr bspw bzgl bzw ca Co Dipl Doc Dr einschl entspr etw evtl exkl Fa Fr geb gem gez ggf Hd Hr Hrn "
        "Hrsg Ing inkl insb insbes Jr jew lfd Mio Mlle Mme Mr Mrd Mrs Ms Mt Nr Nrn Prof Pkt rd resp sog St Str Tab Tel "
        "Tsd Univ urspr verb vgl Vgl vs zit zzgl zzt εκατ δηλ Αρ Hon Gen Capt Col Lt Rev").split()
# Abbreviations that a number follows.
BEFORE_NUMBER = ("Abb Abs Abschn al Alt Anh Anl Anm art Art Bd Bl Buchst cap Cap cf chap ch cl Fig fig Kap lit Lit no No "
                 "nos Nos núm ust pkt poz par Par para Para pp Reg Rn Rz sec Sec sect Sect Tz tzn Uff Vol vol Ziff Zi z.Z παρ αρ αριθ").split()
# Month names of dates with an ordinal day.
MONTHS = ("Januar|Jänner|Februar|Feber|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|"
          "Jan|Feb|Mär|Apr|Jun|Jul|Aug|Sept|Sep|Okt|Nov|Dez")
# Words before an ordinal number.
ARTICLES = "der|die|das|dem|den|des|zum|zur|im|am|vom|beim|ein|eine|einer|eines|einem|einen"
CLOSERS = r"[)\]\"'”“’‘»«›‹]"


def _abbreviations(x: Column) -> Column:
    # a mark between letters or digits with no space: decimals, times, addresses on the net, inner dots
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N}_%/@+-])\.(?=[\p{L}\p{N}_%/@+-])", DOT)
    # chains of single letters; the last dot of some of them may end a sentence
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}'’])(\p{L})\.(?=\s?\p{L}\.)", f"$1{DOT}")
    last = rf"(?<=(?<![\p{{L}}\p{{N}}])\p{{L}}{DOT}\s?)(\p{{L}})\."
    keep = rf"(?<!u{DOT}\s?[Ää]\.)(?<!p{DOT}\s?a\.)(?<![ap]{DOT}\s?m\.)(?<!i{DOT}\s?R\.)(?<!a{DOT}\s?D\.)"
    x = F.regexp_replace(x, last + keep, f"$1{DOT}")
    # initials, abbreviations, streets before a house number
    x = F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}{DOT}])(?<!{DOT}\s)(?<!(?:Buchst|lit)\.\s)(\p{{Lu}})\.(?=\s)", f"$1{DOT}")
    x = F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}])({'|'.join(sorted(OPEN, key=len, reverse=True))})\.", f"$1{DOT}")
    numbered = "|".join(sorted((w.replace(".", f"[.{DOT}]") for w in BEFORE_NUMBER), key=len, reverse=True))
    x = F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}])({numbered})\.(?=\s?(?:\p{{N}}|[§(]|[IVXLC]+\b|\p{{Ll}}\b))", f"$1{DOT}")
    x = F.regexp_replace(x, r"(\p{L}{2}(?:str|pl|[Nn]r)|-Nr)\.(?=\s[\p{N}\p{Lu}])", f"$1{DOT}")
    # ordinals: days before a month, numbers after an article, enumerators at the start of a line
    x = F.regexp_replace(x, rf"(?<![\p{{N}}.,{DOT}])(\p{{N}}{{1,2}})\.(?=\s(?:{MONTHS})(?!\p{{L}}))", f"$1{DOT}")
    x = F.regexp_replace(x, rf"(?<=(?<!\p{{L}})(?:{ARTICLES})\s)(\p{{N}}{{1,3}})\.(?=\s\p{{Lu}})", f"$1{DOT}")
    x = F.regexp_replace(x, r"(?m)^(\s*(?:\p{N}{1,3}|\p{L}{1,2}))\.(?=\s)", f"$1{DOT}")
    return x


def _held(x: Column, signs: str, close: str, keep: int, marks: str, holds) -> Column:
    """A text with the marks replaced that stand in front of a closing sign, no other of the signs between, but for those in
    the last `keep` characters; holds tells by what stands up to the sign, and by what stands behind it, whether it closes.
    The text is cut behind every sign, so that its length counts once."""
    parts = F.split(x, f"(?<=[{signs}])")

    def one(p, k):
        n = F.length(p)
        held = F.concat(F.translate(F.substring(p, F.lit(1), n - keep), marks, "".join(MASKS[m] for m in marks)), F.right(p, F.lit(keep)))
        return F.when(F.endswith(p, F.lit(close)) & holds(p, F.coalesce(F.get(parts, k + 1), F.lit(""))), held).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def masked(df: DataFrame, col: str) -> DataFrame:
    """df with the marks of a column replaced. Each step that reads the column twice is a projection of its own,
    as nested expressions would double with each."""
    df = df.withColumn(col, _abbreviations(F.col(col)))
    # speech inside a sentence: all its marks but the last, which may end the sentence too
    behind_word = lambda close: lambda p, _: p.rlike(rf"\S{close}$")
    apart = lambda p, after: p.rlike(r"\s»$") & after.rlike(r"^(?:[\s.,;:!?]|$)")
    for sign, signs, close, holds in (("„", "„“", "“", behind_word("“")), ("«", "»«", "«", behind_word("«")), ("»", "«»", "»", apart), ("”", "“”„", "”", behind_word("”"))):
        df = df.withColumn(col, F.when(F.contains(F.col(col), F.lit(sign)), _held(F.col(col), signs, close, 2, ".?!", holds)).otherwise(F.col(col)))
    always = lambda p, _: F.lit(True)
    for signs, close in (("“”", "”"), ("「」", "」"), ("『』", "』")):
        quoted = F.contains(F.col(col), F.lit(close)) & F.col(col).rlike("[。？！]")
        df = df.withColumn(col, F.when(quoted, _held(F.col(col), signs, close, 1, "。？！", always)).otherwise(F.col(col)))
    return df


def pieces(df: DataFrame, col: str) -> DataFrame:
    """A column of texts turned into the pieces of the masked text, terminators and what closes them at their ends,
    white space at their starts."""
    df = masked(df, col)
    x = F.col(col)
    end = rf"(?<![„\[])([.!?…]++(?:\s»(?=\s|$)|{CLOSERS})*+)(?=\s+(?!\p{{Ll}}|[–—-]\s)\S)"
    x = F.regexp_replace(x, end, f"$1{CUT}")
    # the Greek question mark is a semicolon
    x = F.regexp_replace(x, r"(?<=[\u0370-\u03ff]{2})([;\u037e])(?=\s+\p{Lu})", f"$1{CUT}")
    x = F.regexp_replace(x, r"([。！？｡]++[）)]*+)(?=\s*\S)", f"$1{CUT}")
    x = F.regexp_replace(x, r"([।॥؟۔።]++[”\"»]*+)(?=\s*\S)", f"$1{CUT}")
    # Thai sentences are set apart by a space
    thai = r"[\u0e00-\u0e7f]"
    x = F.regexp_replace(x, rf"(?<={thai}|{thai}\p{{N}}{{1,9}})(?=\s+{thai})", CUT)
    return df.withColumn(col, F.split(x, CUT)).withColumn(col, F.filter(col, lambda p: p.rlike(r"\S")))


def restored(col: Column) -> Column:
    return F.translate(col, "".join(MASKS.values()), "".join(MASKS))


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos INT, sentence, end_pos INT): the sentences of each text in order, from 0; end_pos is the number of
    code points of the text up to and including the sentence's last character, white space behind it not counted;
    the last sentence ends with the text. Null, empty and blank texts have no sentence; repeated rows are split
    once each; a text without a terminator is one sentence. Other columns of df are not read."""
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    d = pieces(d.where(F.col("text").rlike(r"\S")).withColumn("p", F.col("text")), "p")
    ends = F.aggregate("p", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.length(s))))
    d = d.withColumn("e", ends)
    return (d.select("id", "text", F.size("p").alias("n"), "e", F.posexplode_outer("p").alias("pos", "s"))  # outer: no filter on its size is derived and pushed down
             .select("id", "pos", F.trim(restored(F.col("s"))).alias("sentence"),
                     F.when(F.col("pos") == F.col("n") - 1, F.length("text"))
                      .otherwise(F.get("e", F.col("pos") + 1)).cast("int").alias("end_pos")))
