"""Secret scan with DataFrame functions only: three fixed patterns, and a randomness test battery for other tokens.

Positions come from split() and regexp_extract_all() on the same pattern: pieces and matches alternate, so running sums
of their lengths give code point offsets. Only lengths and candidate tokens are shuffled, never texts.

A candidate is a run of at least ``MIN_LENGTH`` encoding characters with letters and digits. Its encoding is inferred (hex, base32,
base36, alphanumeric, base64, base64url); a run that fits none is cut at its separators, and parts as long are candidates. The battery
has three tests of randomness over that alphabet: chi-squared uniformity, runs above and below the middle, and lag-1 serial correlation.
What one of them rejects at ``alpha`` / 3 is not random and is never reported. What is left may still be prose by chance, so each candidate
also gets a p-value against prose of its length and encoding: how even it is (agreeing pairs of characters, of which chi-squared is a
function) and how broken (runs of letters of one case, or of digits), both in deviations from prose, added. Within each encoding and
length band, Benjamini-Hochberg at level ``q`` over all candidates of the corpus chooses those that are reported as kind ``random``,
so the share of prose among them is what is bounded; short tokens can't reach a small p-value. The threshold is read from a
histogram of fixed bins (a sixteenth of an octave, p rounded up), so no ranking passes one task.

Defined results: null text counts as empty; a text without secrets has zero counts and empty spans; repeated rows are
reported alike; null doc_ids stay null; an empty table gives no rows; other columns are not read, and ``redact_secrets``
returns them as they are (n_chars, where there is one, follows the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, table, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
HEX_RUN = "[0-9a-f]{32}"
MIN_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}=*"
KINDS = ("assign", "access", "hex", "random")
#: Alphabet of each encoding, in the order in which they are tried, with the pattern that a token must match.
ENCODINGS = {
    "hex": ("0123456789abcdef", "^[0-9a-f]+$"),
    "HEX": ("0123456789ABCDEF", "^[0-9A-F]+$"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+=*$"),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    "BASE36": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[0-9A-Z]+$"),
    "alnum": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+=*$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[0-9A-Za-z+/]+=*$"),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[0-9A-Za-z_-]+=*$"),
}
#: What prose, names and numbers look like in an encoding: the chances that two characters, and three, agree, and that one
#: is of another class (small letter, capital, digit) than the one before it. On the even and broken side of what is common.
NUMBERS, ONE_CASE, TWO_CASES = (0.10, 0.0105, 0.25), (0.065, 0.0053, 0.20), (0.055, 0.0040, 0.40)
PROSE = {"hex": NUMBERS, "HEX": NUMBERS, "base32": ONE_CASE, "base36": ONE_CASE, "BASE36": ONE_CASE, "alnum": TWO_CASES, "base64": TWO_CASES, "base64url": TWO_CASES}
TOGETHER = 2**0.5  # deviation of the sum of two independent deviations
LEAST_P = 1e-6  # below, the tail's polynomial is not exact


def half_tail(z: Column, t: Column) -> Column:
    """P(Z > |z|) by the published polynomial (Abramowitz and Stegun 26.2.17), t being 1 / (1 + 0.2316419 |z|)."""
    # Fixed values of the published polynomial.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal."""
    q = half_tail(z, 1 / (1 + 0.2316419 * F.abs(z)))
    return F.when(z < 0, 1 - q).otherwise(q)


def with_tails(rows: DataFrame, deviations: dict[str, Column]) -> DataFrame:
    """Adds the upper tail of each deviation.

    Step by step as columns: as one expression a deviation would stand in it dozens of times, and the generated code would be too large to compile.
    """
    kept, names = rows.columns, list(deviations)
    rows = rows.select("*", *[z.alias(f"z_{n}") for n, z in deviations.items()])
    rows = rows.select("*", *[(1 / (1 + 0.2316419 * F.abs(f"z_{n}"))).alias(f"t_{n}") for n in names])
    rows = rows.select(*kept, *[F.col(f"z_{n}") for n in names], *[half_tail(F.col(f"z_{n}"), F.col(f"t_{n}")).alias(f"q_{n}") for n in names])
    return rows.select(*kept, *[F.when(F.col(f"z_{n}") < 0, 1 - F.col(f"q_{n}")).otherwise(F.col(f"q_{n}")).alias(n) for n in names])


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per match, and one at least per document: row key, doc_id, match. The texts end here."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id()).withColumn("fp", F.xxhash64("text"))

    def pieces(name: str, pattern: str, sure: Column):
        """Matches and the pieces between them, each found once a row."""
        return F.when(sure, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"{name}_m"), F.when(sure, F.split("text", pattern, -1)).alias(f"{name}_p")

    has = {"assign": F.col("text").rlike(ASSIGN_WORDS), "access": F.col("text").contains("AKIA"), "hex": F.col("text").rlike(HEX_RUN), "random": F.col("text").rlike(CANDIDATE)}
    # Shorter hex runs are dropped anyway, and maximal runs don't overlap: only long ones need be found.
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{32,}", "random": CANDIDATE}
    cols = [c for k in KINDS for c in pieces(k, patterns[k], has[k])]
    secret = F.when(has["assign"], F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("assign_g")
    found = src.select("rid", "fp", "doc_id", *cols, secret)

    def rows(k: int, name: str) -> Column:
        ok = {"assign": lambda m, i: F.length(F.col("assign_g")[i]) >= 8, "access": lambda m, i: F.length(m) >= 16}.get(name, lambda m, i: F.lit(True))
        token = (lambda m: m) if name == "random" else (lambda m: F.lit(None).cast("string"))
        return F.coalesce(
            F.transform(f"{name}_m", lambda m, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(F.col(f"{name}_p")[i]).alias("before"), F.length(m).alias("n"), ok(m, i).alias("ok"), token(m).alias("token"))),
            F.array().cast("array<struct<kind:int,i:int,before:int,n:int,ok:boolean,token:string>>"),
        )

    every = found.select("rid", "fp", "doc_id", F.concat(*[rows(k, name) for k, name in enumerate(KINDS)]).alias("all"))
    return every.select("rid", "fp", "doc_id", F.explode_outer("all").alias("m")).select("rid", "fp", "doc_id", "m.*")


def of_encoding(values: dict) -> Column:
    """The value that belongs to the row's encoding."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col("encoding") == name, value).otherwise(out)
    return out


def inferred(token: Column) -> Column:
    """The first encoding that fits a token of letters and digits; null without one."""
    encoding = F.lit(None).cast("string")
    for name, (_, pattern) in reversed(ENCODINGS.items()):
        encoding = F.when(token.rlike(pattern), name).otherwise(encoding)
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), encoding)


def with_encodings(rows: DataFrame) -> DataFrame:
    """Adds encoding; a run whose characters no encoding holds together gives a row for each long part between separators."""
    part = "[A-Za-z0-9]{%d,}=*" % MIN_LENGTH
    before = "aggregate(slice(p, 1, i + 1), 0, (a, y) -> a + length(y)) + aggregate(slice(m, 1, i), 0, (a, y) -> a + length(y))"
    fits = F.col("token").rlike("^(?:[0-9A-Za-z+/]+|[0-9A-Za-z_-]+)=*$")
    rows = rows.withColumns({"m": F.when(~fits, F.regexp_extract_all("token", F.lit(part), F.lit(0))), "p": F.when(~fits, F.split("token", part, -1))})
    cut = F.expr(f"transform(m, (x, i) -> named_struct('at', {before}, 'token', x))")
    rows = rows.withColumn("part", F.explode_outer(F.coalesce(cut, F.array(F.struct(F.lit(0).alias("at"), F.col("token").alias("token"))))))
    start = F.col("start") + F.coalesce("part.at", F.lit(0))
    rows = rows.select("rid", "fp", "doc_id", "kind", start.alias("start"), (start + F.length("part.token")).alias("end"), "ok", F.col("part.token").alias("token"))
    return rows.withColumn("encoding", inferred(F.col("token")))


def battery(rows: DataFrame, alpha: float = 0.003) -> DataFrame:
    """Adds encoding, band, the p-values of the three tests of randomness (p_chi, p_runs, p_serial) and p, against prose (1 for what is not random)."""
    rows = with_encodings(rows).withColumn("core", F.regexp_replace("token", "=+$", "")).withColumn("alphabet", of_encoding({k: v[0] for k, v in ENCODINGS.items()}))
    chars = F.expr("transform(filter(split(core, ''), c -> c != ''), c -> instr(alphabet, c) - 1)")
    rows = rows.withColumn("v", F.when(F.col("encoding").isNotNull(), chars)).withColumn("size", F.size("v").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    squares = F.expr("aggregate(array_distinct(v), 0D, (a, x) -> a + pow(size(filter(v, y -> y = x)), 2))")
    low = F.expr("cast(size(filter(v, x -> x < k / 2)) as double)")
    runs = F.expr("1D + aggregate(sequence(1, size(v) - 1), 0D, (a, i) -> a + if((v[i] < k / 2) = (v[i - 1] < k / 2), 0D, 1D))")
    mean = F.expr("aggregate(v, 0D, (a, x) -> a + x) / size")
    plain = F.regexp_replace("core", "[+/_-]", "")
    pieces = F.when(F.col("encoding").isNotNull(), F.size(F.regexp_extract_all(plain, F.lit("[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))).cast("double"))
    rows = rows.select("*", squares.alias("sq"), low.alias("n1"), runs.alias("runs"), mean.alias("mean"), pieces.alias("pieces"), F.length(plain).cast("double").alias("plain"))
    spread = F.expr("aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))")
    serial = F.expr("aggregate(sequence(1, size(v) - 1), 0D, (a, i) -> a + (v[i] - mean) * (v[i - 1] - mean))")
    rows = rows.select("*", spread.alias("spread"), serial.alias("serial"))
    n, k, n1 = F.col("size"), F.col("k"), F.col("n1")
    two, three, switch = (of_encoding({e: v[i] for e, v in PROSE.items()}) for i in range(3))
    n, k, n1 = F.col("size"), F.col("k"), F.col("n1")
    rows = rows.select("*", (2 * n1 * (n - n1)).alias("both"), two.alias("two"), three.alias("three"), switch.alias("switch"), F.greatest(F.col("plain") - 1, F.lit(1.0)).alias("steps"))
    # Tests of randomness: small where a random token would hardly be so uneven.
    df, x2 = k - 1, k / n * F.col("sq") - n
    z_chi = (F.pow(F.greatest(x2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    both = F.col("both")
    rows = rows.select("*", z_chi.alias("d_chi"), (both * (both - n) / (n * n * (n - 1))).alias("var"))
    z_runs = F.abs(F.col("runs") - both / n - 1) / F.sqrt(F.when(F.col("var") > 0, F.col("var")))
    z_serial = F.abs(F.col("serial") / F.when(F.col("spread") > 0, F.col("spread")) + 1 / n) * F.sqrt(n)
    # Against prose: small where prose would hardly be so even, or so broken.
    pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2)
    two, three, switch, steps = (F.col(c) for c in ("two", "three", "switch", "steps"))
    z_even = (pairs * two - (F.col("sq") - n) / 2) / F.sqrt(pairs * (two - two * two) + triples * (three - two * two))
    z_broken = (F.col("pieces") - 1 - 0.5 - steps * switch) / F.sqrt(steps * switch * (1 - switch))
    rows = with_tails(rows, {"u_chi": F.col("d_chi"), "u_runs": z_runs, "u_serial": z_serial, "u_prose": (z_even + z_broken) / TOGETHER})
    p_runs, p_serial = (F.coalesce(2 * F.col(c), F.lit(0.0)) for c in ("u_runs", "u_serial"))  # no spread: not random
    against = F.least(F.lit(1.0), F.greatest(F.lit(LEAST_P), F.col("u_prose")))
    known = F.col("encoding").isNotNull()
    band = F.when(n < 32, 0).when(n < 64, 1).otherwise(2)
    tests = rows.select("rid", "fp", "doc_id", "kind", "start", "end", "ok", "token", "encoding", band.alias("band"), *[F.when(known, p).alias(name) for name, p in (("p_chi", F.col("u_chi")), ("p_runs", p_runs), ("p_serial", p_serial), ("p_prose", against))])
    return tests.withColumn("p", F.when(3 * F.least("p_chi", "p_runs", "p_serial") < alpha, 1.0).otherwise(F.col("p_prose")))


def p_edge(p: Column) -> Column:
    """Upper edge of the bin of a p-value."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(p) * 16 - 1e-9) / 16)


def step_up(scored: DataFrame, q: float) -> DataFrame:
    """Benjamini-Hochberg threshold of each (encoding, band): the largest bin edge t with t <= q * share of candidates with p <= t. At most 24 x 320 rows."""
    hist = scored.filter("p IS NOT NULL").groupBy("encoding", "band", p_edge(F.col("p")).alias("edge")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("encoding", "band")
    cum = hist.select("*", F.sum("c").over(w.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w).alias("all"))
    passing = F.col("edge") <= q * F.col("upto") / F.col("all")
    return cum.groupBy("encoding", "band").agg(F.coalesce(F.max(F.when(passing, F.col("edge"))), F.lit(0.0)).alias("reported_to"))


def find_secrets(docs: DataFrame, q: float = 0.05, alpha: float = 0.003, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its doc_id, a fingerprint of its text, its base spans and all spans as sorted arrays of (start, kind, end)."""
    w = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("n")).over(w)
    placed = lengths(docs, id_col, text_col).select("rid", "fp", "doc_id", "kind", "ok", "token", (end - F.col("n")).alias("start"), end.alias("end"))
    rows = written(placed)
    base = rows.filter("kind IS NULL OR kind < 3").select("rid", "fp", "doc_id", "kind", "start", "end", "ok")
    scored = written(battery(rows.filter("kind = 3"), alpha).drop("token"))
    limits = step_up(scored, q)
    chosen = scored.join(F.broadcast(limits), ["encoding", "band"]).filter(p_edge(F.col("p")) <= F.col("reported_to")).select("rid", "fp", "doc_id", "kind", "start", "end", "ok")
    others = scored.select("rid", "fp", "doc_id", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("boolean").alias("ok")).distinct()
    span = F.struct("start", "kind", "end")
    per_doc = base.unionByName(chosen).unionByName(others).groupBy("rid").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.first("fp").alias("fp"), F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("found"))
    known = F.filter("found", lambda s: s["kind"] < 3)
    per_doc = per_doc.select("doc_id", "fp", known.alias("base"), "found")
    free = F.filter("found", lambda s: (s["kind"] < 3) | ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return per_doc.select("doc_id", "fp", "base", free.alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret's characters replaced by ``mask``, and n_chars, if there, brought up to date. All rows stay.

    Spans are applied from the last to the first, over overlaps merged before; only texts with spans are touched.
    """
    found = find_secrets(docs, id_col=id_col, text_col=text_col).filter("size(spans) > 0")
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) -> "
        "if(size(a) > 0 and element_at(a, -1).end >= s.start, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), "
        "concat(a, array(named_struct('start', s.start, 'end', s.end)))))"
    )
    known_id, known_fp, spans = free_names(docs, "known_id", "known_fp", "spans")
    found = found.select(F.col("doc_id").alias(known_id), F.col("fp").alias(known_fp), F.reverse(merged).alias(spans)).dropDuplicates([known_id, known_fp])
    same = F.col(id_col).cast("long").eqNullSafe(F.col(known_id)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(known_fp))
    masked = docs.join(found, same, "left")
    text = F.aggregate(F.col(spans), F.col(f"`{text_col}`").cast("string"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.lit(mask), F.substring(t, (s["end"] + 1).cast("int"), F.length(t))))
    out = masked.withColumn(text_col, F.when(F.col(spans).isNotNull(), text).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
