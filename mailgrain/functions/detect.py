"""How mail can be stopped: header tiers, anchors of bodies, targets and their plausibility, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import registrable_domain
from .mime import header, header_all
from .rules import DEFAULT_RULES, PREFERENCE_TOKENS, UNSUBSCRIBE_TOKENS, URL_TOKENS, Rules
from .text import BLANK, decode_entities, extract, first, let, match_token, none_if_empty, squeeze, trim

METHODS = ("one_click", "http_link", "mailto", "body_link")
CONFIDENCE = {"one_click": 1.0, "http_link": 0.8, "mailto": 0.7, "body_link": 0.4}
PREFERENCE_CONFIDENCE = 0.3
#: Evidence sentences of the header tiers.
EVIDENCE = {
    "one_click": "List-Unsubscribe-Post: List-Unsubscribe=One-Click with an https URI (RFC 8058)",
    "http_link": "https URI in List-Unsubscribe (RFC 2369)",
    "mailto": "mailto URI in List-Unsubscribe",
}


def parse_list_unsubscribe(value: Column) -> Column:
    """URIs in angle brackets; without any, comma-separated items that are http(s) or mailto."""
    if_any = lambda found: F.when(F.size(found) > 0, found).otherwise(bare)
    bracketed = F.filter(F.transform(F.regexp_extract_all(value, F.lit("<([^>]+)>"), F.lit(1)), trim), lambda u: u != "")
    bare = F.filter(F.transform(F.split(value, ","), trim), lambda u: u.rlike("(?i)^(https?|mailto):"))
    return let(bracketed, if_any)


def has_one_click_post(headers: Column) -> Column:
    value = header(headers, "list-unsubscribe-post")
    return F.coalesce(F.lower(F.regexp_replace(value, f"{BLANK}+", "")) == "list-unsubscribe=one-click", F.lit(False))


def attribute(attributes: Column, name: str) -> Column:
    quoted = rf"""(?i)\b{name}{BLANK}*={BLANK}*["']([^"']*)["']"""
    bare = rf"(?i)\b{name}{BLANK}*={BLANK}*([^\s\p{{Z}}>]+)"
    return trim(F.coalesce(extract(attributes, quoted), extract(attributes, bare)))


def extract_anchors(html: Column) -> Column:
    """Array of (href, text, title, aria_label) of the anchors that have an href.

    One pass finds the anchors. What follows the last closing tag holds none and is cut off before, so that every opening tag
    finds an end and the pass stays linear, however many are never closed.
    """
    closed = F.regexp_extract(html, rf"(?is)\A.*</a{BLANK}*>", 0)
    opening, closing = r"(?is)\A<a\b([^>]*)>", rf"(?is)\A<a\b[^>]*>(.*)</a{BLANK}*>\z"
    anchors = F.transform(
        F.regexp_extract_all(closed, F.lit(rf"(?is)<a\b[^>]*>.*?</a{BLANK}*>"), F.lit(0)),
        lambda p: let(
            F.regexp_extract(p, opening, 1),
            lambda a: F.struct(
                decode_entities(attribute(a, "href")).alias("href"),
                squeeze(decode_entities(F.regexp_replace(F.regexp_extract(p, closing, 1), "<[^>]*>", " "))).alias("text"),
                attribute(a, "title").alias("title"),
                attribute(a, "aria-label").alias("aria_label"),
            ),
        ),
    )
    return F.filter(anchors, lambda a: a["href"].isNotNull() & (a["href"] != ""))


def match_unsubscribe_token(c: Column) -> Column:
    return match_token(c, UNSUBSCRIBE_TOKENS)


def match_preference_token(c: Column) -> Column:
    return match_token(c, PREFERENCE_TOKENS)


def match_url_token(url: Column) -> Column:
    """Tokens of the path and query alone; of the whole text where it is no absolute URL."""
    path = F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+"), F.regexp_replace(F.regexp_extract(url, r"(?is)^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"^(?=\?|\z)", "/")).otherwise(url)
    return match_token(path, URL_TOKENS)


def _surface(anchor: Column, tokens, wording: str) -> Column:
    """Evidence of the first of text, title and aria-label that holds a token."""
    out = []
    for field, name in (("text", "link text"), ("title", "title"), ("aria_label", "aria-label")):
        token = match_token(F.coalesce(anchor[field], F.lit("")), tokens)
        out.append(F.concat(F.lit(f'body anchor {name} {wording} "'), token, F.lit('"')))  # null without a token
    return F.coalesce(*out)


def score_anchor(anchor: Column) -> Column:
    """struct(uri, confidence, evidence) of one anchor; null without a token or an http(s) target."""
    strong = _surface(anchor, UNSUBSCRIBE_TOKENS, "matched")
    by_url = F.concat(F.lit('body anchor URL matched "'), match_url_token(anchor["href"]), F.lit('"'))
    weak = _surface(anchor, PREFERENCE_TOKENS, "matched preference phrase")

    def found(evidence: Column, confidence: float) -> Column:
        return F.struct(anchor["href"].alias("uri"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))

    def with_weak(evidence: Column) -> Column:
        return F.when(evidence.isNotNull(), found(evidence, CONFIDENCE["body_link"])).otherwise(let(weak, lambda w: F.when(w.isNotNull(), found(w, PREFERENCE_CONFIDENCE))))

    return F.when(anchor["href"].rlike("(?i)^https?:"), let(F.coalesce(strong, by_url), with_weak))


def best_anchor(anchors: Column) -> Column:
    """The most confident anchor, the first of equals."""
    scored = F.filter(F.transform(anchors, score_anchor), lambda s: s.isNotNull())
    return let(scored, lambda all_: F.coalesce(first(F.filter(all_, lambda s: s["confidence"] == CONFIDENCE["body_link"])), first(all_)))


def detect_body_link(html: Column) -> Column:
    return best_anchor(extract_anchors(html))


def target_domain(uri: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Registrable domain of a mailto address or a URL's host; null where it can't be read."""
    address = F.substring_index(F.substring(uri, F.lit(8), F.length(uri)), "?", 1)
    host = extract(uri, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)")
    return registrable_domain(F.when(uri.rlike("(?i)^mailto:"), address).otherwise(host), rules)


def is_suspicious(uri: Column, from_address: Column, dkim: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """The target is known, and is neither the sender's registrable domain nor that of any signature."""

    def unlike(target: Column) -> Column:
        own = F.coalesce(registrable_domain(from_address, rules) == target, F.lit(False))
        signed = F.exists(F.coalesce(dkim, F.array().cast("array<string>")), lambda d: F.coalesce(registrable_domain(d, rules) == target, F.lit(False)))
        return target.isNotNull() & ~own & ~signed

    return let(target_domain(uri, rules), unlike)


def parse_mailto(uri: Column) -> Column:
    """struct(to, subject, body); null if not mailto or without an address."""
    rest = F.substring(uri, F.lit(8), F.length(uri))
    to = F.try_url_decode(F.replace(trim(F.substring_index(rest, "?", 1)), F.lit("+"), F.lit("%2B")))
    query = F.when(rest.contains("?"), F.substring(rest, F.instr(rest, "?") + 1, F.length(rest))).otherwise("")

    def field(name: str) -> Column:
        return F.coalesce(F.try_url_decode(extract(query, rf"(?:^|&){name}=([^&]*)")), F.lit("unsubscribe"))

    good = uri.rlike("(?i)^mailto:") & F.coalesce(to.contains("@"), F.lit(False))
    return F.when(good, F.struct(to.alias("to"), field("subject").alias("subject"), field("body").alias("body")))


def header_tiers(uris: Column, one_click: Column) -> Column:
    """Tiers 1 to 3 as struct(method, uri, confidence, evidence); null means that only a body can tell."""

    def found(method: str, uri: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), uri.alias("uri"), F.lit(CONFIDENCE[method]).alias("confidence"), F.lit(EVIDENCE[method]).alias("evidence"))

    def tiers(uris: Column) -> Column:
        def scheme(pattern: str) -> Column:
            return first(F.filter(uris, lambda u: u.rlike(pattern)))

        https, http, mailto = scheme("(?i)^https:"), scheme("(?i)^https?:"), scheme("(?i)^mailto:")
        return F.when(https.isNotNull() & one_click, found("one_click", https)).when(http.isNotNull(), found("http_link", http)).when(mailto.isNotNull(), found("mailto", mailto))

    return F.when(F.size(uris) > 0, let(uris, tiers))


def detect_headers(headers: Column) -> Column:
    return header_tiers(parse_list_unsubscribe(F.array_join(header_all(headers, "list-unsubscribe"), ", ")), has_one_click_post(headers))


def headers_inconclusive(headers: Column) -> Column:
    return detect_headers(headers).isNull()


def message_key(message_id: Column, folder: Column, uidvalidity: Column, uid: Column) -> Column:
    """Trimmed Message-ID; folder:uidvalidity:uid where it is missing or empty."""
    return F.coalesce(none_if_empty(trim(message_id)), F.concat_ws(":", folder, uidvalidity, uid))
