"""Sender identities: addresses, list ids, normalised keys and registrable domains, as Column expressions."""

from __future__ import annotations

import zlib
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DEFAULT_RULES, Rules
from .text import extract, let, none_if_empty, trim

#: Kinds that resolve a sender, in order of priority; a DKIM domain is often a platform's and never resolves.
RESOLVING = ("list_id", "from_address", "normalized_key")
DELIMITER = r"[-+_.=]"


def split_address(address: Column) -> Column:
    """struct(local, domain), lower case; null for what is no address or has no dot in its domain."""
    at = r"(?s)^(.+)@([^@]+)\z"

    def parts(text: Column) -> Column:
        domain = F.regexp_extract(text, at, 2)
        return F.when(text.rlike(at) & domain.contains("."), F.struct(F.regexp_extract(text, at, 1).alias("local"), domain.alias("domain")))

    return let(F.lower(trim(address)), parts)


@cache
def suffix_table(suffixes: frozenset[str]) -> tuple[str, int]:
    """The rules as one text of lines, and their number: a rule stands in the line of its hash, with its mark (= plain, * wild, ! except) in front."""
    lines: list[str] = [""] * (1 << (4 * len(suffixes) + 1).bit_length())  # most are empty, which spares a look
    for rule in sorted(suffixes):
        mark, name = (rule[0], rule[2:] if rule[0] == "*" else rule[1:]) if rule[0] in "*!" else ("=", rule)
        lines[zlib.crc32(name.encode()) % len(lines)] += f" {mark}{name} "
    return "\n".join(lines), len(lines)


def registrable_domain(value: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """The suffix and one label of a host, address or URL; null for single labels, suffixes and IP addresses.

    The longest rule decides. "*.x" makes every label under x a suffix, and "!y.x" takes y out of that. The rules are a hashed table in one
    literal, in which each tail of the host is looked up once: the expression is as large for ten thousand rules as for ten, and as fast.
    """
    text, lines = suffix_table(rules.suffixes)
    most = max((s.count(".") + 1 for s in rules.suffixes), default=1)
    host = extract(F.lower(trim(value)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#]*@)?([^/:?#@]+)")

    def domain_of(x: Column) -> Column:
        host, table = x["host"], x["table"]
        n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
        tail = lambda k: F.call_function("substring_index", host, F.lit("."), -k)

        def found(k: Column) -> Column:
            """The number of labels that the rules make of the last k: k for a suffix, k + 1 for one under a wildcard, less for an exception (which wins)."""

            def looked_up(t: Column) -> Column:
                line = F.get(table, (F.crc32(t) % lines).cast("int"))
                has = lambda mark: F.contains(line, F.concat(F.lit(f" {mark}"), t, F.lit(" ")))
                return F.when(line == "", 1).when(has("!"), 1000 + k).when(has("*") & (n > k), k + 1).when(has("=") & (k > 1), k).otherwise(1)

            return let(tail(k), looked_up)

        longest = F.array_max(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), found))

        def cut(m: Column) -> Column:
            return F.when(m > 1000, tail(m - 1000)).when(n > m, tail(m + 1))

        named = host.rlike(r"^[^\s.]+(?:\.[^\s.]+)*\z") & ~host.rlike(r"^[0-9.]+\z") & ~host.startswith("[")
        return F.when(named, let(longest, cut))

    return let(F.struct(F.regexp_replace(host, r"\.\z", "").alias("host"), F.split(F.lit(text), "\n", -1).alias("table")), domain_of)


def is_variable_segment(s: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Counters, hashes and long mixed ids; all-digit segments are decided by their length alone."""
    by_shape = (s.rlike(r"^[0-9a-f]+\z") & (F.length(s) >= rules.hex)) | (s.rlike(r"^[0-9a-z]+\z") & s.rlike("[0-9]") & (F.length(s) >= rules.mixed))
    return F.when(s == "", False).when(s.rlike(r"^[0-9]+\z"), F.length(s) >= rules.digits).otherwise(by_shape)


def normalize_local_part(local: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """struct(normalized, collapsed): tag cut, variable segments and all that follows a bounce prefix as *."""

    def rewrite(x: Column) -> Column:
        tagged = F.instr(x, "+") > 1
        bare = F.when(tagged, F.substring_index(x, "+", 1)).otherwise(x)
        marks = F.regexp_extract_all(bare, F.lit(f"({DELIMITER})"), F.lit(1))
        return let(F.struct(tagged.alias("tagged"), F.split(bare, DELIMITER, -1).alias("parts"), marks.alias("marks")), rejoin)

    def rejoin(p: Column) -> Column:
        bounce = F.get(p["parts"], F.lit(0)).isin(*rules.bounce_prefixes)

        def star(s: Column, i: Column) -> Column:
            envelope = bounce & (i > 0)
            hidden = F.when(envelope, s != "").otherwise(is_variable_segment(s, rules))
            shown = F.when(envelope | is_variable_segment(s, rules), F.lit("*")).otherwise(s)
            return F.struct(F.concat(F.when(i > 0, F.get(p["marks"], i - 1)).otherwise(""), shown).alias("text"), hidden.alias("hidden"))

        def done(segments: Column) -> Column:
            joined = F.array_join(F.transform(segments, lambda s: s["text"]), "")
            normalized = F.regexp_replace(joined, rf"(?:{DELIMITER}\*){{2,}}\z", "-*")
            return F.struct(normalized.alias("normalized"), (p["tagged"] | F.exists(segments, lambda s: s["hidden"])).alias("collapsed"))

        return let(F.transform(p["parts"], star), done)

    return let(local, rewrite)


def normalize_list_id(value: Column) -> Column:
    """What the angle brackets hold, else the whole value; lower case, without quotes; null if empty."""
    inner = let(trim(value), lambda raw: F.coalesce(extract(raw, "<([^>]*)>"), raw))
    return let(trim(F.regexp_replace(F.lower(trim(inner)), r'^"(.*)"\z', "$1")), none_if_empty)


def normalized_key(list_id: Column, from_address: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """struct(key, tier): list:<id>, else addr:<normalised address>, but domain:<registrable> where nothing stable is left."""

    def entry(key: Column, tier: str) -> Column:
        return F.struct(key.alias("key"), F.lit(tier).alias("tier"))

    def by_address(x: Column) -> Column:
        def choose(local: Column) -> Column:
            empty = local["collapsed"] & (F.regexp_replace(local["normalized"], r"[-+_.=*]", "") == "")
            whole = entry(F.concat(F.lit("addr:"), local["normalized"], F.lit("@"), x["domain"]), "address")
            of_domain = let(registrable_domain(x["domain"], rules), lambda d: F.when(d.isNotNull(), entry(F.concat(F.lit("domain:"), d), "domain")))
            return F.coalesce(F.when(empty, of_domain), whole)

        return F.when(x.isNotNull(), let(normalize_local_part(x["local"], rules), choose))

    by_list = let(normalize_list_id(list_id), lambda v: F.when(v.isNotNull(), entry(F.concat(F.lit("list:"), v), "list_id")))
    return F.coalesce(by_list, let(split_address(from_address), by_address))


def candidate_identities(list_id: Column, from_address: Column, dkim: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Ordered array of (kind, value): list_id, from_address, normalized_key, then distinct registrable DKIM domains."""

    def one(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    whole = let(split_address(from_address), lambda x: F.when(x.isNotNull(), F.concat(x["local"], F.lit("@"), x["domain"])))
    own = F.array(one("list_id", normalize_list_id(list_id)), one("from_address", whole), one("normalized_key", normalized_key(list_id, from_address, rules)["key"]))
    domains = F.array_distinct(F.transform(F.coalesce(dkim, F.array().cast("array<string>")), lambda d: registrable_domain(d, rules)))
    return F.filter(F.concat(own, F.transform(domains, lambda d: one("dkim_domain", d))), lambda c: c["value"].isNotNull())


def is_resolving(kind: Column) -> Column:
    return kind.isin(*RESOLVING)
