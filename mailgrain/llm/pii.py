"""Personal data: high-recall generators propose overlapping spans, boosted trees choose among them.

Base spans are exact patterns with checks (octets, Luhn, digit counts) and always stay. Generators also propose spans that the
patterns miss: spelled-out addresses ("name (at) host (dot) org", with local parts up to 64 characters and up to 7 labels), telephone numbers
without a plus, numbers split in unusual places. Each candidate gets format features (lengths, digit groups, separators, checks) and context
features (neighbouring characters and words). There are no labels: the trees learn as positives base spans rewritten, each several times, into
the kinds that the patterns miss (@ and dots spelled out, national and international layouts of other digits without a plus, cards with other
separators), each in its own place in the text, and as negatives candidates that touch no base span, that no word announces and that their own form
speaks against (a wrong check digit, plain digits, dates, amounts, parts of longer words), cards with a wrong digit, plain numbers, dates and amounts in the place of telephone numbers, and candidates that only overlap a rewritten span. Each kind's
positives weigh as much as its negatives. Isotonic calibration on a held-out fifth of the documents turns scores into probabilities for that mixture.

Each kind has a threshold of its own: the smallest probability from a half up at which at most ``false_share`` of the held-out negatives of
the kind would be added (``threshold`` where there are none). Spans are added best first, if they overlap nothing chosen before. A candidate that touches
a base span, such as an address with a port, is never added.

Training takes at most ``max_docs`` different rows, those with the smallest hashes of doc_id and text, however often a doc_id is repeated,
of each at most ``per_doc`` examples, and at most ``max_examples`` in all, those with the smallest hashes. One task fits them; the driver gets the
trees alone.

Defined results: null and empty texts have no spans; repeated rows are reported alike and train once; null doc_ids stay null and are
left out of training; without candidates nothing is added; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import doc_texts, table, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Generators: wider than the patterns above, and allowed to overlap each other.
GENERATORS = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}[ ]?(?:@|\(at\)|\[at\])[ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\.|\(dot\)|\[dot\])[ ]?[A-Za-z0-9-]{1,63}){1,6}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{1,5})?")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])(?:\+|00)?[(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9])")),
)
_HINT = re.compile(r"[0-9@]|\(at\)|\[at\]")
_CUES = re.compile(r"(?i)(mail|write|contact|@)|(ip|host|server|addr)|(card|visa|pay|account|konto|cuenta)|(tel|phone|call|fax|mobil)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: the run of local characters before each @, not before the end of the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    if not _HINT.search(text):
        return []
    return [(kind, *m.span()) for kind, pattern in GENERATORS for m in pattern.finditer(text)]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate, without its surroundings' base spans."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    cue = _CUES.findall(before)
    host = s.rsplit("@", 1)[-1]
    return [
        kind, len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), len(set(digits)),
        sum(c in " ()" for c in s), s.count("."), s.count("-"), ":" in s, s.count(". ") + s.count(" ."),
        float(luhn(digits)) if len(digits) > 11 else -1.0, max([int(g) for g in re.findall("[0-9]{1,9}", s)] or [0]) <= 255,
        groups[0] if groups else 0, groups[-1] if groups else 0, len(set(groups)), s[:1] == "0", s[:2] == "00", s[:1] == "(", len({c for c in s if c in " .-()"}),
        host.count("."), len(host.rsplit(".", 1)[-1]), before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in " \n(<:", after[:1] in " \n.,)>;",
        *[float(any(c[k] for c in cue)) for k in range(4)], sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), sum(c.isupper() for c in s),
    ]


def _key(doc_id: int, kind: int, start: int, end: int) -> int:
    return xxhash.xxh64_intdigest(f"{doc_id}:{kind}:{start}".encode()) >> 1


def _touches(start: int, end: int, spans) -> bool:
    return any(a < end and start < b for _, a, b in spans)


_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}(?: [0-9]{1,2})?|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}")
_AMOUNT = re.compile(r"[0-9]{1,3}(?:\.[0-9]{3})+")


def implausible(text: str, kind: int, start: int, end: int) -> bool:
    """A candidate that its own form or neighbours speak against, and no announcing word for it.

    Others that no pattern has found may well be real, and teach nothing: a corpus full of what the patterns miss must not teach the trees to miss it too.
    """
    s = text[start:end]
    if _CUES.search(text[max(0, start - 24) : start]):
        return False
    if kind == 0:
        return ". " in s
    if kind == 1:
        return any(int(p[-4:]) > 255 for p in s.split(":")[0].split("."))
    if kind == 2:
        return not luhn("".join(c for c in s if c.isdigit()))
    inside = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()
    return inside or s.isdigit() or bool(_DATE.fullmatch(s) or _AMOUNT.fullmatch(s))


#: Digit groups of telephone numbers after the area code, and of what is none.
LAYOUTS = ((3, 4), (3, 3, 4), (4, 4), (2, 3, 4), (3, 2, 2), (2, 4, 4), (3, 6), (2, 2, 2, 2), (3, 7))


def digits_of(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def rewrite(kind: int, s: str, r: random.Random) -> list[tuple[str, int]]:
    """A base span as the patterns miss it, with label 1, and what is like it but isn't, with label 0."""
    if kind == 0:
        local, host = s.rsplit("@", 1)
        return [(local + r.choice((" (at) ", "(at)", " [at] ", " @ ")) + host.replace(".", r.choice((" (dot) ", "(dot)", " [dot] ", "."))), 1)]
    digits = "".join(c for c in s if c.isdigit())
    if kind == 3:
        between, layout = r.choice((" ", " ", "-", ".")), r.choice(LAYOUTS)
        parts = [digits_of(r, n) for n in layout]
        area = str(r.randint(1, 9)) + digits_of(r, r.randint(1, 3))
        real = r.choice((f"0{area}{between}", f"0{area}{between}", f"(0{area}) ", f"({area}) ", f"00{r.randint(1, 9)}{digits_of(r, r.randint(0, 1))}{between}{area}{between}", f"{area}{between}")) + between.join(parts)
        if r.random() < 0.25:  # the number itself, without its plus
            real = r.choice(("", "00")) + s[1:]
        amount = ".".join([str(r.randint(1, 999)), *[digits_of(r, 3) for _ in range(r.randint(2, 3))]])
        other = r.choice((digits_of(r, r.randint(7, 14)), digits_of(r, r.randint(7, 10)), amount, f"20{digits_of(r, 2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"20{digits_of(r, 2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(10, 23)}"))
        return [(real, 1), (other, 0)]
    if kind == 2:
        cuts = (4, 8, 12) if r.random() < 0.5 else sorted(r.sample(range(2, len(digits) - 1), r.randint(2, 4)))
        between, at = r.choice((".", ".", " -", ". ", "  ", "--", " .")), r.randrange(len(digits))
        wrong = digits[:at] + str((int(digits[at]) + r.randint(1, 9)) % 10) + digits[at + 1 :]
        return [(between.join(d[a:b] for a, b in zip([0, *cuts], [*cuts, len(d)], strict=True)), y) for d, y in ((digits, 1), (wrong, 0))]
    return []


def examples(doc_id: int, text: str, variants: int = 6) -> list[tuple[int, int, list[float]]]:
    """(key, label, features) of what a document teaches."""
    out, base = [], base_spans(text)
    for c in candidates(text):
        if not _touches(c[1], c[2], base) and implausible(text, *c):
            out.append((_key(doc_id, *c), 0, features(text, *c)))
    for kind, a, b in base:
        for v in range(variants):
            key = _key(doc_id * 64 + v, kind, a, b)
            for new, y in rewrite(kind, text[a:b], random.Random(key)):
                left = text[max(0, a - 80) : a]
                near, start, end = left + new + text[b : b + 80], len(left), len(left) + len(new)
                kept = base_spans(near)
                for c in candidates(near):
                    if _touches(*c[1:], [(kind, start, end)]) and not _touches(*c[1:], kept):
                        out.append((key, y if c == (kind, start, end) else 0, features(near, *c)))
    return out


def sampled(texts: DataFrame, max_docs: int) -> DataFrame:
    """(doc_id, text) of at most ``max_docs`` different rows, those with the smallest hashes of both. Only hashes are sorted."""
    src = texts.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(_HINT.pattern)).withColumn("fp", F.xxhash64("text"))
    place = (F.xxhash64("doc_id", "fp"), F.col("doc_id"), F.col("fp"))
    chosen = src.select("doc_id", "fp").distinct().orderBy(*place).limit(max_docs)
    return src.join(F.broadcast(chosen), ["doc_id", "fp"]).groupBy("doc_id", "fp").agg(F.first("text").alias("text")).select("doc_id", "text")


def thresholds(kinds: np.ndarray, p: np.ndarray, y: np.ndarray, false_share: float, threshold: float) -> np.ndarray:
    """Of each kind the smallest probability, from a half up, that at most ``false_share`` of its negatives reach."""
    out = np.full(len(KINDS), threshold)
    for k in range(len(KINDS)):
        negative = np.sort(p[(kinds == k) & (y == 0)])[::-1]
        if len(negative):
            allowed = int(false_share * len(negative))
            out[k] = max(0.5, np.nextafter(negative[allowed], 2) if allowed < len(negative) else 0.5)
    return out


def train(docs: DataFrame, max_docs: int = 40_000, per_doc: int = 48, max_examples: int = 100_000, false_share: float = 0.01, threshold: float = 0.9, folds: int = 5) -> Boosted | None:
    """Boosted trees on a bounded sample of candidates, with a threshold for each kind in ``limits``; None where there is nothing to tell apart."""

    def sample(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for key, y, x in sorted(examples(doc_id, text))[:per_doc]:
                    for c, v in zip(out, (key, y, zlib.crc32(str(doc_id).encode()) % folds == 0, x), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.list_(pa.float64()))], names=["key", "y", "held", "x"])

    def learn(group: pa.Table) -> pa.Table:
        rows = group.to_pandas().sort_values("key", ignore_index=True)
        if rows["y"].nunique() < 2:
            return pa.table({"model": pa.array([], pa.binary())})
        x, y, held = np.array(rows["x"].tolist(), float), rows["y"].to_numpy(), rows["held"].to_numpy(bool)
        cell = x[:, 0].astype(int) * 2 + y
        model = fit(x, y, held, weight=1 / np.bincount(cell, minlength=2 * len(KINDS))[cell] * len(y) / len(np.unique(cell)))
        on = held if len(set(y[held])) > 1 else np.ones(len(y), bool)
        model.limits = thresholds(x[on, 0].astype(int), model.probability(x[on]), y[on], false_share, threshold)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sampled(doc_texts(docs), max_docs).mapInArrow(sample, "key long, y int, held boolean, x array<double>")
    rows = written(rows.orderBy("key", "y").limit(max_examples))
    found = rows.groupBy(F.lit("sample")).applyInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else None


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def span_finder(trees: Boosted | None):
    """Batches of (doc_id, text) → batches of what is found."""

    def joined(spans) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            bases = [base_spans(t) for t in texts]
            new = []  # (row, span) of candidates that touch no base span
            if trees is not None:
                new = [(i, c) for i, t in enumerate(texts) for c in candidates(t) if not _touches(c[1], c[2], bases[i])]
            p = trees.probability(np.array([features(texts[i], *c) for i, c in new], float)) if new else []
            added: dict[int, list] = {}
            for k in sorted(range(len(new)), key=lambda k: (-p[k], new[k])):
                i, (kind, start, end) = new[k]
                if p[k] >= trees.limits[kind] and not _touches(start, end, added.get(i, ())):
                    added.setdefault(i, []).append((kind, start, end))
            count = lambda k: pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64())
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases]
            spans = [joined(b + added.get(i, [])) for i, b in enumerate(bases)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[count(k) for k in range(4)], pa.array(digests), pa.array(spans), pa.array([len(added.get(i, ())) for i in range(len(texts))], pa.int64())], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def find_personal(docs: DataFrame, model: Boosted | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        yield from span_finder(shared.value)(batches)

    return doc_texts(docs, id_col, text_col).mapInArrow(run, FOUND)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal(docs, train(docs))
