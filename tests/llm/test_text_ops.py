"""Toxicity, personal data, secrets, media and language-model scoring."""

import base64
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailgrain.llm import boosting, lm_scoring, media, pii, secret_scan, toxicity
from mailgrain.llm.common import written
from .test_token_ops import edge_docs


def words(r, n):
    return " ".join("".join(r.choice("aeioulrst") for _ in range(r.randint(2, 6))) for _ in range(n))


# -- toxicity --------------------------------------------------------------------------------------------------------------------


def toxic_rows(n=500):
    r = random.Random(1)
    rows = [(i, words(r, 30) + (" Dreadful! " if i % 4 == 0 else " ") + words(r, 10), int(i % 4 == 0)) for i in range(n)]
    return rows


def test_toxicity_learns_and_keeps_folds(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, y) for i, t, y in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == y == int(got[i].score >= 0.5) for i, _, y in rows)
    lied = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    again = toxicity.train(docs, lied)
    assert (again[0] == model[0]).all() and (again[1] == model[1]).all()  # held-out labels teach nothing
    assert len(model[0]) < 2000
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, model).collect()) == [i for i, _, y in rows if not y]


def plain_ftrl(rows, labels, alpha=1.0, beta=1.0, l1=10.0, l2=0.5, epochs=5):
    """FTRL-proximal with a dictionary, coordinate by coordinate, over all coordinates."""
    n, z = Counter(), Counter()

    def weight(i):
        lazy = 0.0 if i == "bias" else l1
        if i == "bias":
            return -z[i] * alpha / (beta + math.sqrt(n[i]))
        return 0.0 if abs(z[i]) <= lazy else -(z[i] - math.copysign(lazy, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            w = {i: weight(i) for i in [*rows[k], "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i, v in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * v
                n[i] += g * g
    return {i: weight(i) for i in n if weight(i)}


def test_toxicity_weights_equal_plain_ftrl(spark):
    """Repeated rows, and rows of one doc_id with many texts, on the way through Spark."""
    rows = toxic_rows(260)
    rows += [rows[6]] * 50 + [(7, f"seven {i}", 0) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:260]], "doc_id long, toxic int")
    at, values, bias = toxicity.train(docs, labels)
    fp = {(r.doc_id, r.text): r.fp for r in docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).collect()}
    used = sorted({(i, fp[i, t], t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5})
    want = plain_ftrl([set(toxicity.feature_hashes(t).tolist()) for *_, t, _ in used], [y for *_, y in used])
    assert bias == pytest.approx(want.pop("bias")) and set(at.tolist()) == set(want) and len(want) > 1
    assert values.tolist() == pytest.approx([want[i] for i in at.tolist()])
    assert toxicity.training_rows(docs, labels, 20, 10**6).count() == 20
    sizes = [len(r.x) for r in toxicity.training_rows(docs, labels, 1000, 500).collect()]
    assert 0 < sum(sizes) <= 500


def test_toxicity_edges(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([(3, 1), (3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.limit(0))):
        rows = toxicity.score_documents(docs, model).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.drop_toxic(docs, None).count() == 8


# -- personal data ---------------------------------------------------------------------------------------------------------------


def plain_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    r, alphabet = random.Random(3), "ab.@-+()  0123456789,é٣"
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "mail: a.b@c.example, 1.2.3.256 1.2.3.25 +1 (555) 123-4567"]
    for t in cards + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(5000)]:
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("1" * 50_000 + "." + "a" * 50_000) == []


def test_pii_documents(spark):
    r, rows = random.Random(5), []
    for i in range(400):
        kind = i % 5
        extra = ["", f" write to u{i}@mail.example now ", f" call +1 (555) 01{i:03d}-77 now ", f" at 10.0.{i % 200}.7 now ", f" id {i:07d} now "][kind]
        rows.append((i, words(r, 10) + extra + words(r, 10)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    got = {x.doc_id: x for x in pii.find_personal(docs, model).collect()}
    for i, t in rows:
        base = plain_spans(t)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_added == 0 or i % 5 == 4 or base
    edges = edge_docs(spark)
    assert pii.train(edges) is None
    assert {x.spans for x in pii.find_personal(edges, None).collect()} == {""} and pii.find_personal(edges.limit(0), model).count() == 0


def test_pii_adds_what_the_patterns_miss(spark):
    r, rows = random.Random(7), []
    for i in range(1200):
        digits = "".join(r.choice("0123456789") for _ in range(15))
        card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        real = [f"write to user{i}@mail{i % 7}.example", f"call +49 30 {r.randint(100, 999)} {r.randint(1000, 9999)}", f"card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"id {r.randint(10**6, 10**7 - 1)}", f"order {r.randint(10**9, 10**10 - 1)}"][i % 5]
        rows.append((i, f"{words(r, 6)} {real} {words(r, 6)}"))
    missed = ["write to jane (at) mail3 (dot) example", "call 030 555 1234", "call 0049 30 555 1234", "card 41.11111.1111.11111"]
    clean = ["id 5550123", "order 4930555123", "id 7654321"]
    rows += [(2000 + i, f"{words(r, 6)} {t} {words(r, 6)}") for i, t in enumerate(missed)] + [(3000 + i, f"{words(r, 6)} {t} {words(r, 6)}") for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find_personal(docs, pii.train(docs)).collect()}
    assert [got[2000 + i].n_added for i in range(len(missed))] == [1] * len(missed)
    text = dict(rows)[2000]
    start = text.index("jane")
    assert got[2000].spans == f"email:{start}:{text.index('example') + 7}"
    assert all(got[3000 + i].n_added == 0 for i in range(len(clean)))
    assert sum(got[i].n_added for i in range(1200) if i % 5 > 2) == 0


def test_pii_planted_in_a_corpus(spark):
    """Unmarked numbers and addresses in a quarter of the given documents, which the trees are trained on too; the other documents stay clean."""
    r, rows, kind_of = random.Random(1), [(x.doc_id, x.text or "") for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()], {}
    rows.sort()

    def card():
        x = "".join(r.choice("0123456789") for _ in range(15))
        c = next(x + c for c in "0123456789" if pii.luhn(x + c))
        return ".".join(c[k : k + 4] for k in (0, 4, 8, 12))

    phone = lambda: f"0{r.randint(10, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
    make = {0: lambda: f"user{r.randint(1, 99)} (at) mail{r.randint(1, 9)} (dot) example", 2: card, 3: phone}
    for n, at in enumerate(r.sample(range(len(rows)), 250)):
        kind, (doc_id, text) = (0, 0, 2, 3, 3)[n % 5], rows[at]
        parts, kind_of[doc_id] = text.split(" "), kind
        place = r.randint(0, len(parts))
        rows[at] = (doc_id, " ".join([*parts[:place], ("call " if n % 10 == 3 else "") + make[kind](), *parts[place:]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_added for x in pii.find_personal(docs, pii.train(docs)).collect()}
    for kind in make:
        mine = [got[d] > 0 for d, k in kind_of.items() if k == kind]
        assert sum(mine) >= 0.9 * len(mine), pii.KINDS[kind]
    assert sum(n > 0 for d, n in got.items() if d not in kind_of) <= 0.02 * (len(rows) - 250)


def test_pii_sample_is_bounded(spark):
    """Many rows of one doc_id, different and equal ones."""
    rows = spark.createDataFrame([(1, f"call +49 30 {k:04d} now") for k in range(2000)] * 2, "doc_id long, text string")
    got = pii.sampled(rows, 100)
    assert got.count() == got.distinct().count() == 100


@pytest.mark.parametrize("seed", range(6))
def test_overlapping_candidates_are_taken_best_first(spark, seed):
    """The choice among overlapping spans against a plain search, with made-up probabilities."""
    r = random.Random(seed)
    texts = [" ".join(r.choice(["030 555 1234", "12.34.56.78", "4111 1111 1111 1111", "a (at) b (dot) c", "0049-30-1234-5678", "x"]) for _ in range(6)) for _ in range(40)]

    class Fixed:
        limits = [0.5, 0.6, 0.4, 0.3]

        def probability(self, x):
            return np.array([int(hashlib.sha256(v.tobytes()).hexdigest()[:6], 16) / 2**24 for v in x])

    model, docs = Fixed(), [(i, t) for i, t in enumerate(texts)]
    got = {}
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": texts})
    for out in pii.span_finder(model)([batch]):
        got |= dict(zip(out.column("doc_id").to_pylist(), out.column("spans").to_pylist(), strict=True))
    for i, t in docs:
        base, chosen = plain_spans(t), []
        scored = sorted((-model.probability([np.array(pii.features(t, *c), float)])[0], c) for c in pii.candidates(t))
        for p, (k, a, b) in scored:
            if -p >= model.limits[k] and all(b <= x or y <= a for _, x, y in [*base, *chosen]):
                chosen.append((k, a, b))
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted([*base, *chosen])), t


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    held = rng.random(3000) < 0.2
    model = boosting.fit(x, y, held)
    assert ((model.probability(x[held]) >= 0.5) == y[held]).mean() > 0.95
    steps, levels = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert levels.tolist() == [0, 0.5, 1] and steps.tolist() == [1, 2, 4]


# -- secrets ---------------------------------------------------------------------------------------------------------------------


def plain_secrets(t):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def secret_rows():
    r, parts = random.Random(6), ["token", "secret", "PASSWORD", "api_key", ":", "=", " ", "'", "abc", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "🙂", "\n", "longenough1", "-"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(1500)]
    for i in range(300):
        key = base64.b64encode(r.randbytes(30)).decode()
        rows.append((10_000 + i, f"{words(r, 20)} {key} {words(r, 5)}"))
        rows.append((20_000 + i, f"{words(r, 5)} {words(r, 9).replace(' ', '-')}-{i % 10} some/long/Path/to/File/Version2/{words(r, 3).replace(' ', '/')} {words(r, 5)}"))
    return rows


def test_secrets(spark):
    rows = secret_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert [(s.start, s.kind, s.end) for s in got[i].base] == plain_secrets(t), t
    found = lambda low: sum(any(s.kind == 3 for s in got[i].spans) for i, _ in rows if low <= i < low + 300)
    assert found(10_000) >= 255 and found(20_000) <= 6
    masked = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    assert all(not plain_secrets(masked[i]) or "[SECRET]" in masked[i] for i, _ in rows) and len(masked) == len(rows)
    assert all(masked[i] == t for i, t in rows if not got[i].spans)


def test_any_mask(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh12 and password: ijklmnop34"), (2, None)], "doc_id long, text string")
    for mask in ("[it's]", "\\", "$1 {x}", "", "'; DROP"):
        got = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs, mask).collect()}
        assert got == {1: f"{mask} and {mask}", 2: None}


def test_the_battery_compiles(spark):
    """No stage falls back to interpreted evaluation because its generated code is too large."""
    rows = spark.createDataFrame([(1, 1, 1, 3, 0, 30, True, "abcdefghij0123456789abcdef0123")], "rid long, fp long, doc_id long, kind int, start long, end long, ok boolean, token string")
    stages = secret_scan.battery(written(rows))._jdf.queryExecution().debug().codegenToSeq()
    assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() > 0 for i in range(stages.size()))


def plain_battery(token):
    """Encoding and the p-values of one token, with exact normal tails."""
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    name = next((n for n, (_, pattern) in secret_scan.ENCODINGS.items() if re.search(pattern, token)), None)
    core = token.rstrip("=")
    letters = secret_scan.ENCODINGS[name][0]
    v, k, n = [letters.index(c) for c in core], len(letters), len(core)
    count = Counter(v)
    x2, df = sum((count[i] - n / k) ** 2 / (n / k) for i in range(k)), k - 1
    chi = tail(((x2 / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    side = [x < k / 2 for x in v]
    n1 = sum(side)
    n2, runs = n - n1, 1 + sum(a != b for a, b in zip(side, side[1:]))
    var = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    p_runs = 2 * tail(abs(runs - 2 * n1 * n2 / n - 1) / math.sqrt(var)) if var > 0 else 0
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    p_serial = 2 * tail(abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n)) if spread else 0
    two, three, switch = secret_scan.PROSE[name]
    agree = sum(core[i] == core[j] for i in range(n) for j in range(i))
    even = (n * (n - 1) / 2 * two - agree) / math.sqrt(n * (n - 1) / 2 * (two - two**2) + n * (n - 1) * (n - 2) * (three - two**2))
    classes = ["a" if c.islower() else "A" if c.isupper() else "0" for c in core if c.isalnum()]
    steps, changes = len(classes) - 1, sum(a != b for a, b in zip(classes, classes[1:]))
    broken = (changes - 0.5 - steps * switch) / math.sqrt(steps * switch * (1 - switch))
    return name, chi, p_runs, p_serial, min(1, max(secret_scan.LEAST_P, tail((even + broken) / math.sqrt(2))))


def random_tokens(r, n):
    alphabets = [a for a, _ in secret_scan.ENCODINGS.values()]
    out = ["".join(r.choice(a) for _ in range(r.randint(20, 90))) for a in alphabets for _ in range(n)]
    out += ["-".join(words(r, 1) for _ in range(9)) + f"-{i}" for i in range(n)] + [f"Section{i}Of{words(r, 1).title()}And{words(r, 1).title()}Then{words(r, 1)}" for i in range(n)]
    out += ["abcdefghij0123456789" * 2, "a" * 30 + "1", "0" * 25 + "f"]
    return [t for t in out if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]


def test_battery_equals_plain_formulas(spark):
    tokens = random_tokens(random.Random(12), 12)
    rows = spark.createDataFrame([(i, 0, i, 3, 7, 7 + len(t), True, t) for i, t in enumerate(tokens)], "rid long, fp long, doc_id long, kind int, start long, end long, ok boolean, token string")
    got = {r.rid: r for r in secret_scan.battery(rows).collect()}
    for i, t in enumerate(tokens):
        name, *p = plain_battery(t)
        assert got[i].encoding == name and (got[i].start, got[i].end) == (7, 7 + len(t))
        assert [got[i].p_chi, got[i].p_runs, got[i].p_serial, got[i].p_prose] == pytest.approx(p, abs=1e-6)
        assert got[i].p == (1 if 3 * min(p[:3]) < 0.003 else got[i].p_prose)
    odd = rows.limit(1).withColumn("token", F.lit("v1-beta/" + "Ab3" * 8 + "/x_y-" + "q7" * 11))
    assert sorted((r.start, r.end, r.token) for r in secret_scan.battery(odd).collect()) == [(15, 39, "Ab3" * 8), (44, 66, "q7" * 11)]


def test_step_up_equals_ranking(spark):
    r = random.Random(13)
    p = [r.random() ** 4 for _ in range(400)]
    scored = spark.createDataFrame([("alnum", 0, x) for x in p] + [("hex", 1, 0.9)], "encoding string, band int, p double")
    got = {(x.encoding, x.band): x.reported_to for x in secret_scan.step_up(scored, 0.05).collect()}
    edges = sorted(2 ** (math.ceil(math.log2(x) * 16 - 1e-9) / 16) for x in p)
    want = max((e for i, e in enumerate(edges, 1) if e <= 0.05 * i / len(edges)), default=0)
    assert got["alnum", 0] == pytest.approx(want) and want > 0 and got["hex", 1] == 0


def test_reported_tokens_are_random(spark):
    """Of what is reported, no more than the level is prose, at every mixture; and most keys are found."""
    r, rows = random.Random(14), []
    for i in range(3000):
        key = i % 10 == 0
        token = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.choice([24, 32, 40, 64]))) if key else r.choice([f"{words(r, 4).title().replace(' ', '')}V{r.randint(1, 99)}{words(r, 3).title().replace(' ', '')}", "-".join(words(r, 6).split()) + f"-{r.randint(1, 99)}", "/".join(words(r, 5).split()) + "/index2"])
        rows.append((i, f"{words(r, 4)} {token} {words(r, 4)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hit = {x.doc_id for x in secret_scan.find_secrets(docs).collect() if any(s.kind == 3 for s in x.spans)}
    false = [i for i in hit if i % 10]
    assert len(false) <= 0.05 * len(hit) and len(hit) - len(false) >= 0.85 * 300


def test_secret_edges(spark):
    rows = secret_scan.find_secrets(edge_docs(spark)).collect()
    assert len(rows) == 8 and all(r.spans == [] for r in rows)
    assert secret_scan.find_secrets(edge_docs(spark).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "token=abcdefgh1", "q"), (1, "token=abcdefgh1", "q"), (1, "nothing", "q"), (None, "token=abcdefgh1", None)], "doc_id long, text string, Spans string").withColumns({"known_id": F.lit(1), "known_fp": F.lit("z"), "a.b": F.lit(2)})
    out = secret_scan.redact_secrets(twice)
    assert out.columns == twice.columns and sorted(r.text for r in out.collect()) == ["[SECRET]", "[SECRET]", "[SECRET]", "nothing"]


def test_upper_tail(spark):
    zs = [-3.0, -0.5, 0.0, 1.0, 2.5, 5.0]
    got = [r[0] for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").orderBy("i").select(secret_scan.upper_tail(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) / 2 for z in zs], abs=2e-7)


# -- media -----------------------------------------------------------------------------------------------------------------------


def test_decoders():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (5, 8), np.uint8), rng.integers(0, 256, (3, 5, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(b"P6 # note\n5 3\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3\n5 3 255\n" + " ".join(map(str, colour.ravel())).encode()) == colour).all()
    assert (media.decode(b"P5 2 1 1000\n" + struct.pack(">HH", 7, 1000)) == [[7, 1000]]).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n010") == [[0, 255, 0], [255, 0, 255]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    rows = b"".join(r[:, ::-1].tobytes().ljust(16, b"\0") for r in colour[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + 48, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, 48, 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == colour).all()
    for bad in (b"", b"P7", b"P5 4 4 255\nxx", b"BM" + b"\0" * 60):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize():
    image = np.random.default_rng(3).random((13, 7)) * 255
    up = np.repeat(np.repeat(image, 8, 0), 9, 1)  # 104 x 63, so that 8 x 9 targets cover whole cells
    want = up.reshape(8, 13, 9, 7).mean((1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)


def plain_reduced(image, height, width):
    """Means of the areas under the targets, from every source pixel's overlap with every target."""
    h, w = image.shape
    cover = lambda n, m: np.array([[max(0.0, min((i + 1) * n / m, k + 1) - max(i * n / m, k)) for k in range(n)] for i in range(m)]) / (n / m)
    return cover(h, height) @ image.astype(float) @ cover(w, width).T


def test_hash_and_tile_equal_brute_force(spark, sf):
    rng = np.random.default_rng(6)
    for shape in ((8, 9), (13, 7), (1, 64), (64, 64), (5, 200)):
        image = rng.integers(0, 256, shape, np.uint8)
        small = plain_reduced(image, 8, 9)
        bits = "".join("1" if small[i, j + 1] > small[i, j] + 1e-9 else "0" for i in range(8) for j in range(8))
        assert media.difference_hash(image) == f"{int(bits, 2):016x}"
        tile = np.load(io.BytesIO(media.npy_tile(image)))
        assert np.abs(tile - plain_reduced(image, 16, 16)).max() <= 0.5 + 1e-6
    row = media.op5_media(spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text or ""
    data = text.encode().ljust(max(64, -(-len(text.encode()) // 64) * 64), b"\0")
    image = np.frombuffer(data, np.uint8).reshape(-1, 64)
    assert row.feature == media.difference_hash(image) and row.tile_sha256 == hashlib.sha256(media.npy_tile(image)).hexdigest()


def test_tiles_keep_16_bits():
    image = np.arange(256, dtype=np.uint16).reshape(16, 16) * 257
    raw = b"P5 16 16 65535\n" + image.astype(">u2").tobytes()
    tile = np.load(io.BytesIO(media.npy_tile(media.decode(raw))))
    assert tile.dtype == np.uint16 and (tile == image).all()
    assert np.load(io.BytesIO(media.npy_tile(image.astype(np.uint8)))).dtype == np.uint8


@pytest.mark.parametrize(
    "raw",
    [
        b"P5\n99999999999 99999999999\n255\n", b"P2 2 1 15 / 15 300", b"P2 2 1 15\n15 300", b"P2 2 1 255\n-1 3", b"P3 1 1 255\n1 2", b"P1 2 1\n6 2", b"P1 2 1\n1", b"P4 99999999 99999999\n\0",
        b"P5 2 1 15\n\x0f\x10", b"P5 2 1 0\n\0\0", b"P5 2 1 70000\n\0\0\0\0", b"P5 2", b"P6 1 1 255\n\0\0", b"P7", b"", b"BM", b"BM" + b"\xff" * 60, b"P2 1 1 255\n" + b"9" * 50, b"P5 x 1 255\n\0",
    ],
)
def test_media_rejects_bad_files(spark, raw):
    with pytest.raises((ValueError, struct.error)):
        media.decode(raw)


def test_media_scales_the_largest_value(spark):
    assert media.decode(b"P2 3 1 15\n0 7 15").tolist() == [[0, 119, 255]] and media.decode(b"P5 2 1 1\n\0\1").tolist() == [[0, 255]]
    wide = media.decode(b"P2 2 1 1000\n1000 500")
    assert wide.dtype == np.uint16 and wide.tolist() == [[1000, 500]] and media.decode(b"P1 2 1\n10").tolist() == [[0, 255]]
    images = spark.createDataFrame([(1, bytearray(b"P5\n99999999999 99999999999\n255\n")), (2, bytearray(b"P2 2 1 15\n15 0"))], "id int, media binary")
    got = {r.id: r for r in media.decode_media(images).collect()}
    assert got[1].media_error and got[1].tile is None and got[2].media_error is None and got[2].width == 2


def test_media_documents(spark):
    docs = edge_docs(spark)
    got = media.read_stored(media.store_texts(docs)).collect()
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        data_ = data + b"\0" * (-len(data) % 64 if data else 64)
        want[(r.doc_id, len(data), len(data_), hashlib.sha256(data_).hexdigest(), zlib.crc32(data_[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert np.load(io.BytesIO(got[0].tile)).shape == (16, 16) and len({r.feature for r in got if r.n_bytes == 0}) == 1
    images = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.zeros((4, 4), np.uint8))), "x"), (2, None, "y"), (3, bytearray(b"junk"), "z")], "id int, media binary, Dhash string")
    rows = {r.id: r for r in media.decode_media(images).collect()}
    assert (rows[1].height, rows[1].media_error) == (4, None) and rows[2].tile is None and rows[3].media_error
    assert [rows[i].Dhash for i in (1, 2, 3)] == ["x", "y", "z"] and rows[1].dhash_ == "0" * 16
    assert media.read_stored(media.store_texts(docs.limit(0))).count() == 0


# -- language-model scoring ------------------------------------------------------------------------------------------------------


def test_scores_equal_brute_force(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["the", "of", "cat", "dog", "Sat.", f"rare{r.randint(0, 9)}"]) for _ in range(r.randint(0, 12)))) for i in range(120)]
    docs, size = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 16
    good = {i for i, _ in rows if i % 3 == 0}
    target = spark.createDataFrame([(i,) for i in good], "doc_id long")
    got = {x.doc_id: x for x in lm_scoring.cross_entropy_difference(docs, target, size=size).collect()}

    bare = {i: t.lower().split() for i, t in rows}
    counts = Counter(w for t in bare.values() for w in t)
    code = lambda w: zlib.crc32(w.encode())
    vocab = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: size - 2]}
    grams = {True: Counter(), False: Counter()}
    seq = {i: ["<s>"] + [w if w in vocab else "<unk>" for w in t] for i, t in bare.items()}
    for i, s in seq.items():
        for pair in zip(s, s[1:], strict=False):
            grams[False][pair] += 1
            grams[True][pair] += i in good

    def loss(model, v, w):
        c = grams[model]
        n = sum(c.values())
        p = (sum(k for (_, b), k in c.items() if b == w) + 1) / (n + size)
        return -math.log((c[v, w] + 1000 * p) / (sum(k for (a, _), k in c.items() if a == v) + 1000))

    for i, s in seq.items():
        n = len(s) - 1
        want = [sum(loss(m, *p) for p in zip(s, s[1:], strict=False)) / n if n else 0 for m in (True, False)]
        assert got[i].n_tokens == n and got[i].target_loss == pytest.approx(want[0], abs=1e-5) and got[i].background_loss == pytest.approx(want[1], abs=1e-5)
        assert got[i].score == pytest.approx(want[0] - want[1], abs=1e-5)


def test_scores_tell_rare_words_apart(spark):
    """More words than any fixed table would hold; every one of them counts, across chunks."""
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randint(0, 5999)}" for _ in range(40))) for i in range(300)] + [(300, None), (None, "w1 w2"), (301, "w5 rare1"), (302, "w5 rare2"), (303, "w5 rare1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = {i for i in range(300) if i % 3 == 0} | {303}
    target = spark.createDataFrame([(i,) for i in good], "doc_id long")
    got = {x.doc_id: x for x in lm_scoring.cross_entropy_difference(docs, target, chunk_words=500).collect()}
    seq = {i: ["<s>", *(t or "").split()] for i, t in rows}
    size = len({w for s in seq.values() for w in s[1:]}) + 2
    assert size > 4000 and len(got) == len(rows)
    want = {i: [] for i in seq}
    for keep in (good, set(seq)):
        pairs = Counter(p for i, s in seq.items() if i in keep for p in zip(s, s[1:], strict=False))
        before, word = Counter(), Counter()
        for (v, w), k in pairs.items():
            before[v] += k
            word[w] += k
        p = lambda w: (word[w] + 1) / (sum(word.values()) + size)
        for i, s in seq.items():
            want[i].append(sum(-math.log((pairs[v, w] + 1000 * p(w)) / (before[v] + 1000)) for v, w in zip(s, s[1:], strict=False)) / max(1, len(s) - 1))
    for i in seq:
        assert got[i].n_tokens == len(seq[i]) - 1
        assert [got[i].target_loss, got[i].background_loss] == pytest.approx(want[i], abs=1e-9)
    assert got[301].score < got[302].score and got[301].score == got[303].score


def test_scoring_edges(spark):
    docs, none = edge_docs(spark), spark.createDataFrame([], "doc_id long")
    rows = lm_scoring.cross_entropy_difference(docs, none, size=64).collect()
    assert len(rows) == 8 and all(r.score == 0 for r in rows if r.n_tokens == 0)
    assert lm_scoring.cross_entropy_difference(docs.limit(0), none, size=64).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (4, 0)], "doc_id long, quality int")
    assert [r.doc_id for r in lm_scoring.good_documents(labels).collect()] == ([1] if zlib.crc32(b"1") % 5 else [])
