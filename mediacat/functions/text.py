"""String rules of the catalog as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(x: str | Column) -> Column:
    """A-Z as a-z and nothing else, the comparison rule of the catalog's stored text."""
    return F.translate(x, UPPER, LOWER)


def parent_of(path: str | Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def name_of(path: str | Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(name: str | Column) -> Column:
    """Lower-case text after the last dot; empty without one."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def ancestors(path: str | Column) -> Column:
    """All folders above a path, itself included, from the top; the root's empty name is left out."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def prefixes(text: str | Column) -> Column:
    """All beginnings of a text, itself included: a prefix test without a path boundary becomes an equi-join on these."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: text.substr(F.lit(1), i))


def like_pattern(column: str, query: str) -> Column:
    """Substring search in which % and _ of the query are wildcards and nothing else is special, folding ASCII only."""
    folded = query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_fold(column).like(f"%{folded}%")


def tokens_of(query: str) -> list[str]:
    return query.split()


def tokens(x: str | Column) -> Column:
    """The parts of a text between ASCII white space."""
    return F.filter(F.split(x, r"[ \t\n\x0B\f\r]+"), lambda t: t != "")


def mime_of(name: str | Column) -> Column:
    """Media type by extension (fixed values)."""
    ext = extension_of(name)
    known = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "mp4": "video/mp4", "mkv": "video/x-matroska", "webm": "video/webm"}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[ext], F.lit("application/octet-stream"))


def html_escaped(x: str | Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def natural_key(x: str | Column) -> Column:
    """Lower-case text whose digit runs are padded to 20 places, so that plain order is natural order."""
    padded = F.transform(
        F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)")), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, F.greatest(F.lit(20), F.length(p)), F.lit("0"))).otherwise(p)
    )
    return F.array_join(padded, "")


def hidden(name: str) -> Column:
    """A file name with a dot before it; one that begins with a dot is hidden already and stays."""
    return F.when(F.startswith(F.col(name), F.lit(".")), F.col(name)).otherwise(F.concat(F.lit("."), name))


def unhidden(name: str) -> Column:
    """A hidden file name without its first character; others stay."""
    return F.when(F.startswith(F.col(name), F.lit(".")), F.expr(f"substring({name}, 2)")).otherwise(F.col(name))


def unaccented(x: str | Column) -> Column:
    """Lower-case, trimmed, without combining marks; Spark has no function for the decomposition."""
    import unicodedata

    def one(t):
        return "".join(c for c in unicodedata.normalize("NFD", t.lower().strip()) if unicodedata.category(c) != "Mn")

    @F.pandas_udf("string")
    def strip(texts):
        return texts.map(one, na_action="ignore")

    return strip(x)
