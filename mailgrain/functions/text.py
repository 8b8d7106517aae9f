"""String functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One blank, as a regular expression: Java's \s, all separators, and the byte order mark.
BLANK = r"[\s\p{Z}\x{FEFF}]"


def free_names(taken: list[str], *names: str) -> list[str]:
    """Column names for the time of a job that clash with none of those taken, upper and lower case being one."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        out.append(name)
        known.add(name.lower())
    return out


def let(value: Column, f) -> Column:
    """f(value) with the value computed once and named, where an expression needs it many times."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of blanks become one space, ends trimmed."""
    return trim(F.regexp_replace(c, rf"{BLANK}+", " "))


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match (regexp_extract gives an empty string)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _precomposed() -> tuple[str, str]:
    """Precomposed letters and what is left of them once their marks are taken off."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(x) <= 0x36F)
        if bare != chr(code) and len(bare) == 1:
            source.append(chr(code))
            target.append(bare)
    return "".join(source), "".join(target)


_FROM, _TO = _precomposed()


def normalize_for_match(c: Column) -> Column:
    """No accents, lower case, runs of blanks, hyphens, underscores and full stops as one space, trimmed."""
    bare = F.regexp_replace(F.translate(c, _FROM, _TO), r"[\x{0300}-\x{036F}]", "")
    return F.trim(F.regexp_replace(F.lower(bare), rf"(?:{BLANK}|[-_.])+", " "))


def normalized_token(token: str) -> str:
    """The same on the driver, for vocabularies."""
    bare = "".join(x for x in unicodedata.normalize("NFD", token) if not 0x300 <= ord(x) <= 0x36F).lower()
    return " ".join("".join(" " if x.isspace() or x in "-_." else x for x in bare).split())


@cache
def trie_pattern(words: tuple[str, ...]) -> str:
    """A regular expression for the longest of some words at a place: their trie, so that it costs as much as the longest, however many they are."""
    trie: dict = {}
    for word in words:
        node = trie
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [(rf"\x{{{ord(c):x}}}" if not c.isalnum() else c) + written(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return written(trie)


def match_token(c: Column, tokens) -> Column:
    """The first vocabulary entry, in list order, whose normal form is part of the text's; null without one.

    One pass finds the longest entry at every place of the text. The entries that begin there too are its beginnings, so the first of those in
    list order is known for each entry beforehand, and the first over all places is the answer.
    """
    norms = [normalized_token(t) for t in tokens]
    first_of = {n: min(i for i, m in enumerate(norms) if n.startswith(m)) for n in norms}
    known = list(dict.fromkeys(norms))
    table = F.split(F.lit("\n".join(f"{n}" for n in known)), "\n", -1)
    ranks = F.split(F.lit("\n".join(str(first_of[n]) for n in known)), "\n", -1)
    names = F.split(F.lit("\n".join(tokens)), "\n", -1)

    def found(text: Column) -> Column:
        places = F.regexp_extract_all(text, F.lit(f"(?=({trie_pattern(tuple(known))}))"), F.lit(1))
        best = F.array_min(F.transform(places, lambda m: F.get(ranks, (F.array_position(table, m) - 1).cast("int")).cast("int")))
        return F.when(text != "", F.get(names, best))

    return let(normalize_for_match(c), found)


def decode_entities(c: Column) -> Column:
    """Six entities, in this order, so that "&amp;lt;" ends as "<"."""
    for pattern, char in (("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&nbsp;", " ")):
        c = F.regexp_replace(c, pattern, char)
    return c
