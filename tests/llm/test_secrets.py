import hashlib
import time

import numpy as np
import pytest

from marginalia.llm import secrets

SCHEMA = "doc_id long, text string, spans string, score int"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def run_end(text, at, chars):
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def slow_spans(text):
    """The three rules, character by character."""
    out, i, low = [], 0, lower(text)
    while i < len(text):  # assign
        end = None
        for k in sorted(KEYWORDS, key=len):
            if low.startswith(k, i):
                j = i + len(k)
                j += text[j : j + 1] in ("'", '"')
                j = run_end(text, j, " ")
                if text[j : j + 1] in (":", "="):
                    j = run_end(text, j + 1, " ")
                    j += text[j : j + 1] in ("'", '"')
                    z = run_end(text, j, VALUE)
                    if z > j:
                        end = z
                        if z - j >= 8:
                            out.append(("assign", i, z))
                        break
        i = end or i + 1
    i = 0
    while i < len(text):  # access
        z = run_end(text, i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", i) else i
        if z > i + 4:
            if z - i >= 16:
                out.append(("access", i, z))
            i = z
        else:
            i += 1
    i = 0
    while i < len(text):  # hex
        z = run_end(text, i, set("0123456789abcdef"))
        if z - i >= 32:
            out.append(("hex", i, z))
        i = max(z, i + 1)
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


ODD = [
    None, "", "token=", 'TOKEN: "abcdefgh1"', "secret=token:abcdefgh", "api_key = 'short' apikey=longenough1", "paſſword=abcdefghij", "passwords=abcdefghij", "password  =  \"  abcdefgh",
    "AKIA" + "A1" * 6, "AKIA" + "A1" * 5 + "x", "AKIAAKIA" + "Z" * 10, "x" + "0f" * 16, "0f" * 15 + "0", "é token='" + "ab" * 20 + "' 🙂 " + "c0ffee" * 6, "A" * 40000, "token=" + "9a" * 30000, "secret==" + "b" * 8, "token = \n abcdefghi",
]


def check(row, text):
    base = slow_spans(text or "")
    n = [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
    assert [row.n_assign, row.n_access, row.n_hex] == n, text[:80]
    want = [f"{k}:{a}:{z}" for k, a, z in base]
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    got = row.spans.split(",") if row.spans else []
    assert [s for s in got if not s.startswith("model")] == want and len(got) == len(want) + row.n_model


def test_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = secrets.op3_char_cnn_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(ODD)] * 2, SCHEMA)
    rows = secrets.secret_digest(df).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        check(r, ODD[r.doc_id])
    assert secrets.secret_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(secrets.scan(df).where("size(findings) > 0").collect()) > 10


def test_held_out_accuracy():
    net = secrets.default_net()
    held = secrets.labelled_findings(2000, seed=77)
    p = np.array([net.prob(np.stack(secrets.windows(t, a, z))).max() for t, a, z, _ in held])
    y = np.array([f[3] for f in held])
    assert (p[y] >= net.threshold).mean() > 0.97 and (p[~y] >= net.threshold).mean() < 0.05
    for lo, hi in ((0.0, 0.2), (0.8, 1.01)):  # calibrated
        some = (p >= lo) & (p < hi)
        assert abs(p[some].mean() - y[some].mean()) < 0.1


def test_model_adds_what_the_rules_miss():
    net = secrets.default_net()
    key = "ghx_9fK2mQ7ZrT4vWb8Xc1LpN6sDj3HyGe5Ua0Q"
    text = "deploy with " + key + " today"
    at = text.index(key)
    assert [(k, a, z) for k, a, z, _ in secrets.find(text, net)] == [("model", at, at + len(key))]
    assert secrets.find("see some_long_function_name_here2 for more", net) == []
    late = "=" * 300 + key  # a candidate longer than the window is read to its end
    assert [s[0] for s in secrets.find(late, net)] == ["model"]


def test_gradients():
    rng = np.random.default_rng(0)
    net = secrets._new_net(rng)
    x, y = rng.integers(1, secrets.CLASSES, (6, secrets.WIDTH + 2 * secrets.CONTEXT)), np.array([0, 1, 0, 1, 1, 0.0])

    def loss():
        z = net.pooled(x) @ net.w + net.b
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    g = secrets._step(net, x, y)
    for p, d in ((net.conv[0], g[0]), (net.bias[1], g[3]), (net.w, g[6])):
        i = np.unravel_index(np.abs(d).argmax(), d.shape)
        old, e = p[i], 1e-5
        p[i] = old + e
        up = loss()
        p[i] = old - e
        assert (up - loss()) / (2 * e) == pytest.approx(d[i], rel=1e-3)
        p[i] = old


def test_uncovered_against_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        make = lambda n: sorted((int(a), int(a + w)) for a, w in zip(rng.integers(0, 60, n), rng.integers(1, 20, n)))
        spans, base = make(12), [("hex", a, z) for a, z in make(5)]
        assert secrets.uncovered(spans, base) == [(a, z) for a, z in spans if not any(s <= a and z <= e for _, s, e in base)]


def test_long_texts_take_linear_time():
    """Letters without a digit, many candidates, many rule spans: twice the text takes about twice the time."""
    net = secrets.default_net()
    for unit in ("abcdefghij", "x9" + "k" * 30 + " ", "token=abcdefgh1 ", "0123456789abcdef" * 2 + " ", "secret"):
        took = []
        for n in (500_000, 1_000_000):
            text = (unit * (n // len(unit) + 1))[: n if len(unit) < 20 else n // 20] + " 1"
            start = time.perf_counter()
            secrets.find(text, net)
            took.append(time.perf_counter() - start)
        assert took[1] < 3.2 * took[0] + 0.3, (unit, took)
