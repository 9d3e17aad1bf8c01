"""Identifiers, codes, cells and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(text: Column) -> Column:
    """text, or null if it holds blanks alone."""
    return F.nullif(F.trim(text), F.lit(""))


def doi(text: Column) -> Column:
    return filled(F.lower(text))


def pmid(text: Column) -> Column:
    return filled(text)


def pmcid(text: Column) -> Column:
    return filled(F.upper(text))


def work_id(url: Column, prefix: str = "https://openalex.org/") -> Column:
    return F.when(F.startswith(url, F.lit(prefix)), F.substring(url, len(prefix) + 1, 1 << 20)).otherwise(url)


def keyed(namespace: str, text: Column) -> Column:
    return F.concat(F.lit(f"{namespace}:"), text)


# The forms of classification codes.
IPCR = r"^([A-H])(\d{2})([A-Z])\s+(\d+)/(\d+)\s+(\d{8})([ACN])([FILS])([A-Z]?)"
CPC = r"^([A-HY])(\d{2})([A-Z])\s*(\d+)/(\d+)"
BLANKS = " \t\n\r\f\x0b"


def fields(text: Column, pattern: str, names: tuple[str, ...]) -> Column:
    """A struct of the pattern's groups, none of them empty; null where the text is not of that form. The text is worked out once."""

    def told(t: Column) -> Column:
        groups = F.split(F.regexp_replace(t, f"(?s){pattern}.*", "\x01".join(f"${i}" for i in range(1, len(names) + 1))), "\x01")
        return F.when(F.rlike(t, F.lit(pattern)), F.transform(F.array(groups), lambda g: F.struct(*[F.nullif(g[i], F.lit("")).alias(n) for i, n in enumerate(names)]))[0])

    return F.transform(F.array(F.btrim(text, F.lit(BLANKS))), told)[0]


def ipcr(text: Column) -> Column:
    """section, class, subclass, group, subgroup, version, level, position and value; null for a malformed code."""
    return fields(text, IPCR, ("section", "class", "subclass", "group", "subgroup", "version", "level", "position", "value"))


def cpc(symbol: Column) -> Column:
    """section, class, subclass, group and subgroup of a symbol; the section may be Y; null for a malformed symbol."""
    return fields(symbol, CPC, ("section", "class", "subclass", "group", "subgroup"))


def cpc_plain(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"\s", "")


def cpc_spaced(symbol: Column) -> Column:
    """As the query interface writes it: two blanks after a subclass that a group follows."""
    s = cpc_plain(symbol)
    return F.when(F.length(s) <= 4, s).otherwise(F.concat(F.substring(s, 1, 4), F.lit("  "), F.substr(s, F.lit(5))))


def cell(text: Column) -> Column:
    """As a cell of tab-separated text: tabs and line ends become blanks, null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "\t\n\r", "   ")


def chunk_text(title: Column, abstract: Column) -> Column:
    return cell(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))


def sentences(text: Column, least: int = 20, most: int = 5, else_chars: int = 2000) -> Column:
    """Up to ``most`` sentences of ``least`` characters or more, else one piece of the first ``else_chars``; none of a text under ``least``. Blanks around are no part."""
    text = F.btrim(text, F.lit(BLANKS))
    parts = F.transform(F.split(text, r'(?<=[.?!])\s+(?=[A-Z0-9"(\[])'), lambda x: F.btrim(x, F.lit(BLANKS)))
    parts = F.filter(parts, lambda x: F.length(x) >= least)
    whole = F.when(F.length(text) >= least, F.array(F.left(text, F.lit(else_chars)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(whole)


def resolved_text(abstracts: Column, titles: Column, english: str = "en") -> Column:
    """A struct of text and provenance from arrays of (lang, text): abstract in English, any abstract, title in English, any title."""

    def pick(parts: Column, own: bool) -> Column:
        full = F.filter(parts, lambda x: (filled(x["text"]).isNotNull()) & ((x["lang"] == english) if own else F.lit(True)))
        return F.get(full, F.lit(0))["text"]

    found = [(pick(abstracts, True), "abstract_en"), (pick(abstracts, False), "abstract_xx"), (pick(titles, True), "title_en"), (pick(titles, False), "title_xx")]
    text = F.coalesce(*[x for x, _ in found])
    tag = F.coalesce(*[F.when(x.isNotNull(), F.lit(name)) for x, name in found])
    return F.struct(text.alias("text"), tag.alias("provenance"))


def from_inverted(index: Column) -> Column:
    """The text of a map from words to their places."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " ")


def real(text: Column) -> Column:
    """A number, null for the tokens that stand for nothing and for what is none."""
    return F.when(~text.isin("", "NULL", "\\N", "None"), text).try_cast("double")


def whole(text: Column) -> Column:
    """A whole number, also of a text such as 125.0."""
    return real(text).try_cast("bigint")


def flag(text: Column) -> Column:
    return F.lower(text).isin("true", "t", "1", "yes")


def vector(text: Column) -> Column:
    """Components that blanks separate; brackets and commas are taken as blanks."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"[\[\],]", " ")), r"\s+"), lambda x: x.try_cast("float"))
