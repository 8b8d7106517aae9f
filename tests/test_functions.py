"""Value tables of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailgrain.functions import dates, detect, identity, mime, text
from mailgrain.functions.rules import Rules, read_suffixes


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_split_address(spark):
    got = values(spark, ["", "no-at-sign", "@example.com", "user@", "user@localhost", " A@B.Example "], identity.split_address)
    assert got[:5] == [None] * 5 and tuple(got[5]) == ("a", "b.example")


def test_registrable_domain(spark):
    cases = {
        "shop.marksandspencer.co.uk": "marksandspencer.co.uk", "mail.university.sa.edu.au": "university.sa.edu.au", "newsletter@news.example.org": "example.org",
        "https://click.sendgrid.net/ls/click?upn=abc": "sendgrid.net", "localhost": None, "": None, "co.uk": None, "127.0.0.1": None, "user.github.io": "github.io",
    }
    assert values(spark, list(cases), identity.registrable_domain) == list(cases.values())


def test_suffix_list(spark):
    """Plain, wildcard and exception rules of a list's first section."""
    rules = Rules(suffixes=read_suffixes(["// ICANN", "com", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "// ===END ICANN", "github.io"]))
    cases = {"a.b.com": "b.com", "x.co.uk": "x.co.uk", "a.b.c.ck": "b.c.ck", "c.ck": None, "a.www.ck": "www.ck", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "c.kawasaki.jp": None, "x.city.kawasaki.jp": "city.kawasaki.jp", "u.github.io": "github.io"}
    assert values(spark, list(cases), lambda c: identity.registrable_domain(c, rules)) == list(cases.values())


def test_variable_segment(spark):
    yes, no = "12345 7f3a91c2 a1b2c3d4e5f6 000".split(), ["news", "bounce", "news2", "v2", "hello", "team", "", "q3"]
    assert values(spark, yes + no, identity.is_variable_segment) == [True] * len(yes) + [False] * len(no)


def test_local_part(spark):
    cases = {"you+shopping": "you", "bounce-12345-abc": "bounce-*", "msprvs1=abc=def": "msprvs1-*", "srs0=xyz=aa=example.com=news": "srs0-*", "news-weekly": "news-weekly", "patagonia-3f9a12bc-news": "patagonia-*-news"}
    assert [r.normalized for r in values(spark, list(cases), identity.normalize_local_part)] == list(cases.values())


def test_normalized_key(spark):
    f = lambda c: identity.normalized_key(F.lit(None).cast("string"), c)["key"]
    assert values(spark, ["3f9a12bcd4e5@mail.example.com", "notifications@github.com", "garbage"], f) == ["domain:example.com", "addr:notifications@github.com", None]
    f = lambda c: identity.normalized_key(c, F.lit("bounce-123-x@a.example"))["key"]
    assert values(spark, ['"Patagonia" <news.Patagonia.com>', "<>", ' "plain" '], f) == ["list:news.patagonia.com", "addr:bounce-*@a.example", "list:plain"]
    f = lambda c: identity.normalized_key(F.lit(None).cast("string"), c, Rules(digits=2))["key"]
    assert values(spark, ["news-12@x.example"], f) == ["addr:news-*@x.example"]


def test_candidate_identities(spark):
    f = lambda c: identity.candidate_identities(F.lit('"P" <news.patagonia.com>'), c, F.array(F.lit("mail.example.com"), F.lit("example.com"), F.lit("localhost")))
    got = values(spark, ["Newsletter@Patagonia.com", "garbage"], f)
    assert [tuple(x) for x in got[0]] == [("list_id", "news.patagonia.com"), ("from_address", "newsletter@patagonia.com"), ("normalized_key", "list:news.patagonia.com"), ("dkim_domain", "example.com")]
    assert [x.kind for x in got[1]] == ["list_id", "normalized_key", "dkim_domain"]


def test_list_unsubscribe(spark):
    cases = {"<https://a.example/u>, <mailto:b@a.example>": 2, "https://a.example/u": 1, "NO": 0, "<>": 0, "": 0}
    assert [len(x) for x in values(spark, list(cases), detect.parse_list_unsubscribe)] == list(cases.values())


def test_headers(spark):
    raw = "From: a\r\nX: 1\r\ngarbage\r\n\tfolded  \r\nx:2\r\n: none\r\n\r\nbody\r\n\r\nmore"
    got = values(spark, [raw, "no blank", "\nA: b\n\nc"], lambda c: F.struct(mime.split_message(c)["body"].alias("body"), mime.parse_headers(mime.split_message(c)["head"]).alias("h")))
    assert got[0].body == "body\n\nmore" and [tuple(h) for h in got[0].h] == [("from", "a"), ("x", "1 folded"), ("x", "2")]
    assert got[1].body == "" and got[1].h == [] and got[2].h == []


def test_addresses_and_words(spark):
    cases = ['"Patagonia" <news@p.example>', "=?UTF-8?B?TGlicmFpcmllIMOpdMOp?= <a@b.example>", "=?nope?Q?a_b=C3=A9?=", "x@y.example", None, "<only@z.example>"]
    got = [tuple(x) for x in values(spark, cases, mime.parse_address)]
    assert got == [("Patagonia", "news@p.example"), ("Librairie été", "a@b.example"), (None, "a bé"), (None, "x@y.example"), (None, ""), (None, "only@z.example")]


def test_parts(spark):
    nested = 'Content-Type: multipart/mixed; boundary="b"\n\nskip\n--b\nContent-Type: application/pdf\n\nxx\n--b\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\nPGI+w6k8L2I+\n--b\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\na=\nb=C3=A9=\n--b--\n'
    got = values(spark, [nested, "plain: x\n\nbody"], mime.decode_parts)
    assert [(p.content_type, p.text) for p in got[0]] == [("text/html", "<b>é</b>"), ("text/plain", "abé=")] and got[1][0].text == "body"


def test_sections():
    body = "pre\n--b\none\n\ntwo\n--b  \n--bx\n--b\n\nthree\n--b--\nafter\n--b\nlast\n"
    assert mime.sections(body, "b") == ["one\n\ntwo", "--bx", "\nthree", "last\n"]
    assert mime.sections("--b\n--b\nx", "b") == ["", "x"] and mime.sections("--b", "b") == [] and mime.sections("none", "b") == []
    deep = "x"
    for k in range(12):
        deep = f"Content-Type: multipart/mixed; boundary=b{k}\n\n--b{k}\n{deep}\n--b{k}--\n"
    assert mime.text_parts(deep) == []


def test_unclosed_anchors_stay_linear(spark):
    html = "<a href='/1'>one</a>" + "<a href='/x'>" * 30_000 + "</b>"
    assert [len(x) for x in values(spark, [html, "<a href='/x'>" * 30_000], detect.extract_anchors)] == [1, 0]


def test_anchors_and_links(spark):
    html = '<A HREF="/x">no</a> <a title=t>none</a><a href=\'https://a.example/p?x=1&amp;y=2\' title="Manage preferences">go</a><a href=https://b.example/c>Please  <b>un</b>subscribe</a><a href="https://c.example/optout">x</a>'
    got = values(spark, [html], detect.extract_anchors)[0]
    assert [(a.href, a.text) for a in got] == [("/x", "no"), ("https://a.example/p?x=1&y=2", "go"), ("https://b.example/c", "Please un subscribe"), ("https://c.example/optout", "x")]
    best = values(spark, [html, "<p>nothing</p>", '<a href="https://d.example/">Email  Preferences</a>'], detect.detect_body_link)
    assert tuple(best[0])[:2] == ("https://b.example/c", 0.4) and best[1] is None and best[2].confidence == 0.3


def test_tokens(spark):
    assert values(spark, ["Se DÉSABONNER", "opt_out", "", "zzz"], detect.match_unsubscribe_token) == ["désabonner", "opt out", None, None]
    assert values(spark, ["https://unsubscribe.example/x", "https://a.example/x?u=opt-out", "/leave"], detect.match_url_token) == [None, "opt-out", "/leave"]
    assert values(spark, ["&amp;lt;&nbsp;&#39;"], text.decode_entities) == ["< '"]


def test_mailto(spark):
    got = values(spark, ["mailto:a@b.example?subject=leave%20x&body=hi", "mailto:nobody", "https://x.example", "MAILTO:a@b.example"], detect.parse_mailto)
    assert tuple(got[0]) == ("a@b.example", "leave x", "hi") and got[1] is None and got[2] is None and got[3].subject == "unsubscribe"


@pytest.mark.parametrize(
    "tz,start,months,expected",
    [
        ("UTC", "2026-01-31T09:00:00Z", 3, "2026-04-30T09:00:00.000Z"), ("UTC", "2026-01-30T00:00:00Z", 1, "2026-02-28T00:00:00.000Z"), ("UTC", "2023-11-30T00:00:00Z", 3, "2024-02-29T00:00:00.000Z"),
        ("UTC", "2024-02-29T00:00:00Z", 12, "2025-02-28T00:00:00.000Z"), ("America/New_York", "2026-03-08T04:30:00Z", 3, "2026-06-08T03:30:00.000Z"), ("Australia/Sydney", "2026-09-30T12:00:00Z", 3, "2026-12-30T11:00:00.000Z"),
    ],
)
def test_add_months(spark, tz, start, months, expected):
    assert spark.range(1).select(dates.to_iso(dates.add_months(dates.instant(start), months, tz))).first()[0] == expected


def test_days_and_durations(spark):
    days = lambda a, b, tz: spark.range(1).select(dates.days_until(dates.instant(a), dates.instant(b), tz)).first()[0]
    assert days("2026-03-07T17:00:00Z", "2026-03-08T16:00:00Z", "America/New_York") == 1 and days("2026-08-17T09:00:00Z", "2026-11-17T09:00:00Z", "UTC") == 92
    good = ["3m", "6M", "6 months", "1mo", "45d", "10 days", "1y", "2 years", "forever", "never"]
    got = values(spark, good + ["", "soon", "3 fortnights", "-2m", "0m", "3"], dates.parse_duration)
    assert [(x.months, x.days, x.forever) for x in got[:10]] == [(3, None, False), (6, None, False), (6, None, False), (1, None, False), (None, 45, False), (None, 10, False), (12, None, False), (24, None, False), (None, None, True), (None, None, True)]
    assert got[10:] == [None] * 6
    with pytest.raises(ValueError):
        dates.read_duration("soon")
    assert dates.parse_since("2m", dt.datetime(2026, 3, 31)) == dt.datetime(2026, 1, 31) and dates.parse_since("1m", dt.datetime(2026, 3, 31)) == dt.datetime(2026, 2, 28)
    iso = values(spark, ["2026-01-02T03:04:05.678Z", "2026-01-02T03:04:05+02:00", "2026-01-02", "x"], lambda c: dates.to_iso(dates.parse_instant(c)))
    assert iso == ["2026-01-02T03:04:05.678Z", "2026-01-02T01:04:05.000Z", "2026-01-02T00:00:00.000Z", None]
