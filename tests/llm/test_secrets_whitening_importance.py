"""Secret scans, whitening and importance resampling: odd inputs, and plain versions over whole tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrush.llm import importance, registry, secrets, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, kind int, _key string, at long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those that operators add."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijABC", k=rng.randrange(1, 9)))
    secret = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    same = " ".join(word() for _ in range(40))
    texts = [
        None, "", " \n\t", "x", same, same, "token:token:abcdefghij", "token=secret=abcdefgh12", "API_KEY = 'aaaaaaaa' apikey:\"bbbbbbb\" Password=cccccccc", "AKIAABCDEFGHIJKL AKIAABCD AKIA AKIAAKIAAKIAAKIA0",
        hexed(40) + "g" + hexed(31) + "-" + hexed(64), f"ä {secret(30)} ö {secret(24)}\n{secret(9000)}", secret(40) + "a" * 60 + secret(40), "deadbeef" * 8, "this-is-a-long_name/of-words_and/more-words-here", "123e4567-e89b-12d3-a456-426614174000",
        "EXAMPLE" + secret(30), "0123456789abcdef0123456789abcdef", "𝔘𝔫𝔦 " + hexed(33) + " 𝔘 token=" + secret(20), " ".join(word() for _ in range(40_000)), "token=a " * 3000, secret(23), secret(19) + "." + secret(25), "日本 9 ÀB-ç_d",
    ]
    rows = [(k, t, "en", "s", 1, "x", 2) for k, t in enumerate(texts)]
    rows += [rows[4], rows[11], (None, texts[11], "en", "s", 1, "x", 2), (None, texts[4], "en", "s", 1, "x", 2)]
    return spark.createDataFrame(rows, DOCS)


# -- secrets ---------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def entropy(window):
    n = len(window)
    return -sum(c / n * math.log2(c / n) for c in Counter(window).values())


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for k, c in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(f"[{c.chars}]+", text):
            own = m[0]
            if len(own) < c.window or not re.search(secrets.NO_WORDS, own) or any(re.search(p, own) for p in secrets.ALLOW):
                continue
            parts = []
            for i in range(len(own) - c.window + 1):
                if entropy(own[i : i + c.window]) >= c.bits:
                    if parts and i <= parts[-1][1]:
                        parts[-1][1] = i + c.window
                    else:
                        parts.append([i, i + c.window])
            out += [(m.start() + a, k, m.start() + b, c.kind) for a, b in parts]
    return sorted(out)


def joined(spans):
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)


def digest(text):
    p = plain_spans(text)
    n = Counter(k for _, k, *_ in p)
    return n[0], n[1], n[2], hashlib.sha256(joined(x for x in p if x[1] < 3).encode()).hexdigest(), joined(p)


def test_secrets_equal_plain_scan(spark, odd):
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = sorted((tuple(r) for r in secrets.secret_scan(odd).collect()), key=key)
    assert got == sorted(((r.doc_id, *digest(r.text)) for r in odd.collect()), key=key)
    names = {s.split(":")[0] for r in got for s in r[5].split(",") if s}
    assert names == {"assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64"}


def test_spans_over_the_bounds_of_pieces(spark, odd, monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 7)
    got = {r.doc_id: r.spans for r in secrets.secret_scan(odd.where("doc_id in (10, 11, 12, 18)").dropDuplicates(["doc_id"])).collect()}
    texts = dict(odd.where("doc_id in (10, 11, 12, 18)").select("doc_id", "text").collect())
    assert got == {k: joined(plain_spans(t)) for k, t in texts.items()} and len(got) == 4


def test_secrets_of_whole_table_and_of_none(spark, odd):
    assert secrets.secret_scan(odd.limit(0)).collect() == []
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in registry.op11_secrets(spark, SF).collect()}
    assert got == {i: digest(t) for i, t in docs.items()} and any(x[4] for x in got.values())


def test_secrets_main_path_is_native(spark, odd):
    plan = secrets.secret_scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# -- whitening -------------------------------------------------------------------------------------------------------


def plain_whitening(rows, most=4):
    x = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and None not in v and np.isfinite(np.array(v, float)).all():
            x[k] = [math.floor(256 * float(np.float32(c))) + 0 for c in v]
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), np.array(fit, object).sum(axis=0)
    c = (np.array(fit, object) * n - s).astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return {(k, j + 1): (n, sum((n * a - b) ** 2 for a, b in zip(v, s)), float((np.array(v) - s.astype(float) / n) @ u[:, j] / math.sqrt(e[j])), e[j] / e.sum()) for k, v in x.items() for j in range(min(most, len(e)))}


def held(got, want, keys):
    assert len(got) == len(want)
    signs = {}
    for r in got:
        n, deviation, white, share = want[keys[r.vec_id], r.component]
        assert (r.n, int(r.deviation)) == (n, deviation) and abs(r.explained - share) < 1e-9 * share and r.identity_error < 1e-9
        if abs(white) > 1e-3:
            signs.setdefault(r.component, set()).add(math.copysign(1, white * r.whitened))
        assert abs(abs(white) - abs(r.whitened)) < 1e-8 * max(1, abs(white))
    assert all(len(x) == 1 for x in signs.values())


def test_whitening_equals_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    held(registry.op12_whitening(spark, SF).collect(), plain_whitening(rows), {r.vec_id: k for k, r in enumerate(rows)})


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    # scales so far apart that the first pass can't make the rows orthogonal; a repeated and an odd row each
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=5) * [1e6, 1e3, 30, 1, 0.1]]) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(40)]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [1.0, float("nan"), 0.0, 0.0, 0.0]), (2003, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (2004, []), (2005, [1.0, 2.0])]
    make = lambda x: spark.createDataFrame([(*r, "z", 1) for r in x], "vec_id long, embedding array<float>, x string, component int")
    held(whitening.whiten(make(rows + bad)).collect(), plain_whitening(rows), {r[0]: k for k, r in enumerate(rows)})
    # less than full rank: as many components as there are dimensions with variance
    flat = [(k, [float(a), 2.0 * a, 5.0, float(b)]) for k, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)).tolist())]
    got = whitening.whiten(make(flat)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 120 and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([(1, None), (2, [])])).collect() == []
    far = whitening.whiten(make([(1, [1e38]), (2, [-1e38]), (None, [0.0]), (None, [0.0])]))
    assert {int(r.deviation) for r in far.collect()} == {0, (3 * 2**53) ** 2}
    assert far.select(whitening.fits_long(F.col("deviation")).alias("d")).where("d is null").count() == 2


def test_factors_at_bad_condition(spark):
    rng = np.random.default_rng(4)
    a = np.linalg.qr(rng.normal(size=(200, 6)))[0] @ np.diag([1e9, 1e7, 1e5, 1e4, 1e3, 50])
    x = np.floor(a @ np.linalg.qr(rng.normal(size=(6, 6)))[0].T * 1e4).astype(np.int64)
    mean = x.mean(axis=0)
    r = whitening.triangular(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>"), len(x), mean)
    s, t = np.linalg.svd(r)[1], np.linalg.svd(x - mean)[1]
    assert (np.abs(s - t) < 1e-7 * t).all()


# -- importance resampling -------------------------------------------------------------------------------------------


def plain_words(text):
    low = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, sizes=1):
    w = plain_words(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, sizes + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, sizes=1, buckets=10_000):
    own = [[v % buckets for v in plain_features(t, sizes)] for _, t in docs]
    s, t = Counter(v for f in own for v in f), Counter(v % buckets for x in target for v in plain_features(x, sizes))
    sa, ta = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets)))) for b in s}
    rows = []
    for (i, text), f in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = 10 * len(fit) // 100
    return rows, [r[:4] for r in fit[:drawn]]


def test_crc_of_spans():
    rng = random.Random(2)
    data = rng.randbytes(40_000)
    spans = [(a, a + rng.choice([1, 2, 7, 63, 64, 65, 127, 128, 129, 192, 193, 1000, 4096, 4097])) for a in (rng.randrange(35_000) for _ in range(500))]
    a, b = np.array([*spans, (0, 40_000)]).T
    assert importance.span_crc32(np.frombuffer(data, np.uint8), a, b).tolist() == [zlib.crc32(data[x:y]) for x, y in zip(a, b)]
    assert importance.span_crc32(np.frombuffer(data, np.uint8), a[:0], b[:0]).tolist() == []


@pytest.mark.parametrize("sizes", [1, 2, 3])
def test_features_over_cuts(monkeypatch, sizes):
    rng = random.Random(sizes)
    monkeypatch.setattr(importance, "SLICE_BYTES", 90)
    texts = [None, b"", b"--", "Ünï x9".encode()] + [b" ".join(rng.choice([b"alpha", b"B", b"c-d", b"y" * 150, b"..", "été".encode()]) for _ in range(rng.randrange(60))) for _ in range(50)]
    got = [[0, []] for _ in texts]
    for first, words, owner, value in importance.hashed_features(texts, sizes):
        for k, n in enumerate(words):
            got[first + k][0] += int(n)
        for k, v in zip(owner, value):
            got[first + k][1].append(int(v))
    for t, (n, v) in zip(texts, got):
        text = None if t is None else t.decode()
        assert n == len(plain_words(text)) and sorted(v) == sorted(plain_features(text, sizes))


def test_resampling_equals_plain_version(spark, odd):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    rows, drawn = plain_resample(docs, target)
    got = registry.op13_importance(spark, SF).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(r[:4] for r in rows)
    assert [tuple(r)[:4] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn and len(drawn) > 10
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


def test_resampling_of_odd_rows(spark, odd):
    wide = odd.unionByName(odd.where("doc_id = 4")).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    docs, target = [(r.doc_id, r.text) for r in wide.collect()], ["alpha beta abc", None, "", "a b"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for sizes in (1, 2):
        rows, drawn = plain_resample(docs, target, sizes)
        got = importance.resample(wide, goal, sizes=sizes).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[:4] for r in rows), key=key)
        assert [r[3] for r in sorted((tuple(r)[:5] for r in got if r.rank), key=lambda r: r[4])] == [r[3] for r in drawn] and drawn
    assert importance.resample(odd.limit(0), goal).collect() == []
    assert all(r.rank is None for r in importance.resample(odd.where("doc_id < 4"), goal.limit(0)).collect())
