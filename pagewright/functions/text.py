"""Text functions, Column to Column. Lengths and positions are code points; alphanumerics are letters, marks and numbers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOC = "inhaltsverzeichnis"


def trim(c: Column) -> Column:
    """Without spaces of any kind and tabs at both ends; line breaks stay."""
    return F.regexp_replace(c, r"^[\p{Zs}\t]+|[\p{Zs}\t]+\z", "")


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"[^\s\p{Z}]")


def fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]", "")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{M}]", ""))


def fingerprint(c: Column, size: int, least: int) -> Column:
    """First characters of the fold, null if the fold is shorter than the least."""
    f = fold(c)
    return F.when(F.length(f) >= least, F.substring(f, 1, size))


def norm_id(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[ .]+|[ .]+$", "")


def comps(c: Column) -> Column:
    """Numeric components of a dotted id, null unless all that aren't empty are integers and there is one."""
    parts = F.filter(F.split(norm_id(c), r"\."), lambda x: x != "")
    ok = F.forall(parts, lambda x: x.rlike(r"^[+]?[0-9]{1,9}$")) & (F.size(parts) > 0)
    return F.when(ok, F.transform(parts, lambda x: x.cast("int")))


def clause_ids(c: Column) -> Column:
    """Distinct clause ids of a text: two to four components of 1 to 99 that no digit, dot or comma joins to more;
    a closing dot is none of the id."""
    runs = F.regexp_extract_all(c, F.lit("[0-9.,]+"), F.lit(0))
    ids = F.transform(runs, lambda r: F.regexp_extract(r, r"^([1-9][0-9]?(?:\.[1-9][0-9]?){1,3})(?:$|\.$|\.[.,])", 1))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def neighbours(c: Column) -> Column:
    """The sibling before (from 1), the sibling behind and, if it has two components or more, the parent of an id."""
    p = F.split(c, r"\.")
    n = F.size(p)
    last = F.element_at(p, -1).cast("int")
    stem = F.slice(p, 1, n - 1)
    sibling = lambda k: F.array_join(F.concat(stem, F.array(k.cast("string"))), ".")
    return F.array_compact(F.array(F.when(last > 1, sibling(last - 1)), sibling(last + 1), F.when(n > 2, F.array_join(stem, "."))))


def furniture_key(line: Column) -> Column:
    """Key under which a line repeats from page to page: folded, digit runs as #, one space. Null for lines that are
    empty, longer than 120 characters or with fewer than four letters, such as clause number columns."""
    t = trim(line)
    key = F.regexp_replace(F.regexp_replace(F.lower(t), r"\p{N}+", "#"), r"[\p{Zs}\t]+", " ")
    return F.when((F.length(t) > 0) & (F.length(t) <= 120) & (letters(t) >= 4), key)


def dehyphenate(c: Column) -> Column:
    """Broken words joined: a soft hyphen goes with all space behind it, a hyphen between small letters with the line break
    behind it if there is one; compounds go on with a capital or a space."""
    x = F.regexp_replace(c, r"\x{ad}[\s\p{Z}]*", "")
    x = F.regexp_replace(x, r"([a-zäöüß])-\s*\n\s*([a-zäöüß])", "$1$2")
    return F.regexp_replace(x, r"([a-zäöüß])-([a-zäöüß])", "$1$2")


def reflow(c: Column) -> Column:
    """Lines joined by a space, words broken in lower case joined without it."""
    x = F.regexp_replace(c, r"[\p{Zs}\t]*\n[\s\p{Zs}]*", "\n")
    x = F.regexp_replace(x, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    return trim(F.regexp_replace(x, r"\n+", " "))


def strip_leading_id(content: Column, ident: Column) -> Column:
    """Content without its id in front; kept if a digit follows the id's dot or the id is glued to text."""
    n = norm_id(ident)
    c = trim(content)
    rest = F.substring(c, F.length(n) + F.lit(1), F.length(c))
    dotted = F.regexp_replace(rest, r"^\.", "")
    ok = (n != "") & F.startswith(c, n) & ~dotted.rlike(r"^[0-9]") & ((rest == "") | rest.rlike(r"^\.?[\s\p{Z}]|^\.$"))
    return F.when(ok, trim(dotted)).otherwise(c)


def trim_all(c: Column) -> Column:
    """Without spaces, tabs and line breaks at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def bold_label(c: Column) -> Column:
    """A text that opens with a short label of one line and a colon, the label in bold."""
    return F.regexp_replace(trim_all(c), r"(?s)^(\p{Lu}[^:.\n]{1,39}):[\p{Zs}\t]*(.*)$", "**$1:** $2")


def undotted(ident: Column) -> Column:
    return F.regexp_replace(F.coalesce(ident, F.lit("")), r"\.+$", "")


def heading(ident: Column, title: Column) -> Column:
    """Heading of a section: the title if it begins with the id, else the id without closing dots and the title; a number
    in front loses its dot."""
    i, t = undotted(ident), F.coalesce(title, F.lit(""))
    h = F.when(F.startswith(norm_id(t), norm_id(i)), t).otherwise(F.concat(i, F.lit(" "), t))
    return trim(F.regexp_replace(h, r"^([0-9]+(?:\.[0-9]+)*)\.(\s)", "$1$2"))


def gap_pattern(key: Column, gap: str) -> Column:
    """Pattern of the characters of a key with a gap allowed between them."""
    return F.array_join(F.split(key, ""), gap)


def plural(n: Column, one: str, more: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(more))


def literal_pattern(c: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")


def bold_spans(line: Column) -> Column:
    """The parts of a line that `**` encloses; an odd number of marks is text."""
    parts = F.split(line, r"\*\*")
    inner = F.filter(parts, lambda x, k: k % 2 == 1)
    return F.when(F.size(parts) % 2 == 1, inner).otherwise(F.array().cast("array<string>"))


def slice_trim(c: Column) -> Column:
    """Without white space and the marks that join a heading to its text, at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z},;:–-]+|[\s\p{Z},;:–-]+\z", "")


def base64url(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), "=+$", "")
