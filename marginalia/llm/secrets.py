"""Secret scans: rules plus a character convolutional network over candidates in their context.

Rules find assignments, access keys and long hexadecimal runs. Candidates of the network are all of these and every run of 20
or more key characters that holds a digit and a letter. The network sees two views of each: the candidate itself and the 32
characters on either side. Characters map to classes, pass a width-5 convolution and max pooling, and a logistic layer reads
both. A candidate longer than the input window is read in overlapping windows and scores its best one, so no part of it stays
unread. Scores are calibrated by Platt scaling on held-out findings; the threshold is the highest one that still recalls
`recall` of the held-out secrets. Rule spans always stay; the network adds spans of kind "model".

Training findings are labelled ones: (text, start, end, secret?). labelled_findings() writes a seeded, bounded set of them
(N_FINDINGS): key formats in code-like and prose contexts against look-alikes such as identifiers, version strings, paths,
dates and numbered words; other findings can be passed to train().

Offsets are code points. Nulls: a null text is an empty one. Empty tables give empty results, repeated rows repeated ones;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_str, map_docs, table

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as runs of any length cut to 32 and more
#: One of the letters that end each keyword, before a separator; spares most texts the full pattern.
HINT = re.compile(r"""(?:word|passwd|secret|token|key)["']?\x20*[:=]""", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # maximal, each looked at once
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
WIDTH, CONTEXT, KERNEL, FILTERS, N_FINDINGS, RECALL, SEED = 48, 32, 5, 24, 6000, 0.99, 3

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Rule spans by start, then kind as in KINDS."""
    out: list[Span] = []
    if HINT.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters that the network judges, apart from rule spans."""
    if not DIGIT.search(text):
        return []
    return [m.span() for m in RUN.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])]


def uncovered(spans: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int]]:
    """Those of spans that lie within none of base; both by start."""
    out, i, reach = [], 0, -1
    for a, z in spans:
        while i < len(base) and base[i][1] <= a:
            reach = max(reach, base[i][2])
            i += 1
        if reach < z:
            out.append((a, z))
    return out


# --- network ---

_CLASS = np.full(256, 12, np.int64)
for _chars, _c in (("abcdef", 1), ("ghijklmnopqrstuvwxyz", 2), ("ABCDEF", 3), ("GHIJKLMNOPQRSTUVWXYZ", 4), ("0123456789", 5), ("=:", 6), ("\"'`", 7), ("+/", 8), ("_-", 9), (" \t", 10), ("\n\r", 11)):
    for _x in _chars:
        _CLASS[ord(_x)] = _c
for _i, _x in enumerate("aeiou"):
    _CLASS[ord(_x)] = 13 + (_i > 1)
CLASSES = 15


def _codes(s: str, width: int) -> np.ndarray:
    raw = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)[:width]
    out = np.zeros(width, np.int64)
    out[: len(raw)] = _CLASS[raw]
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """The network's inputs for a candidate: candidate window, then left and right context. More than one if it is long."""
    left = _codes(text[max(0, start - CONTEXT) : start][::-1], CONTEXT)
    right = _codes(text[end : end + CONTEXT], CONTEXT)
    at = [*range(start, max(start + 1, end - WIDTH), WIDTH // 2), max(start, end - WIDTH)]
    return [np.concatenate([_codes(text[i : min(end, i + WIDTH)], WIDTH), left, right]) for i in dict.fromkeys(at)]


@dataclass
class Net:
    """Convolutions over one-hot classes for the candidate and for each side, max and mean pooled, then a logistic layer."""

    conv: list[np.ndarray]  # per view: (KERNEL, CLASSES, FILTERS)
    bias: list[np.ndarray]
    w: np.ndarray
    b: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    VIEWS = ((0, WIDTH), (WIDTH, WIDTH + CONTEXT), (WIDTH + CONTEXT, WIDTH + 2 * CONTEXT))

    def pooled(self, x: np.ndarray, keep: bool = False):
        out, memo = [], []
        for (a, z), conv, bias in zip(self.VIEWS, self.conv, self.bias):
            codes = x[:, a:z]
            n = z - a - KERNEL + 1
            pre = bias + sum(conv[k][codes[:, k : k + n]] for k in range(KERNEL))  # a one-hot product is a lookup
            act = np.maximum(pre, 0)
            top = act.argmax(1)
            out += [np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)]
            memo.append((codes, pre > 0, top, n))
        return (np.concatenate(out, 1), memo) if keep else np.concatenate(out, 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(x[i : i + 256]) @ self.w + self.b for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logit(x) + self.scale[1], -30, 30)))


def _new_net(rng: np.random.Generator) -> Net:
    conv = [rng.normal(0, 0.3, (KERNEL, CLASSES, FILTERS)) for _ in range(3)]
    for c in conv:
        c[:, 0] = 0
    return Net(conv, [np.zeros(FILTERS) for _ in range(3)], rng.normal(0, 0.1, 6 * FILTERS), 0.0)


def _step(net: Net, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss: conv and bias of each view, w, b."""
    h, memo = net.pooled(x, True)
    d = (1 / (1 + np.exp(-np.clip(h @ net.w + net.b, -30, 30))) - y) / len(y)
    dh, out = d[:, None] * net.w, []
    for v, (codes, live, top, n) in enumerate(memo):
        dact = np.repeat(dh[:, None, (2 * v + 1) * FILTERS : (2 * v + 2) * FILTERS] / n, n, 1)
        rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)
        dact[rows, top, cols] += dh[:, 2 * v * FILTERS : (2 * v + 1) * FILTERS]
        dact *= live
        g, flat = np.zeros_like(net.conv[v]), dact.reshape(-1, FILTERS)
        for k in range(KERNEL):
            one = np.eye(CLASSES)[codes[:, k : k + n].ravel()]
            g[k] = one.T @ flat
        g[:, 0] = 0
        out += [g, flat.sum(0)]
    return [*out, h.T @ d, np.array(d.sum())]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        s = np.linalg.solve(hess, g)
        a, b = a - s[0], b - s[1]
        if abs(s).max() < 1e-8:
            break
    return float(a), float(b)


def train(findings: list[tuple[str, int, int, bool]], recall: float = RECALL, epochs: int = 4, seed: int = SEED) -> Net:
    """Fits on 3/4 of the findings, calibrates and sets the threshold on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(findings))
    x = [windows(t, a, z) for t, a, z, _ in findings]
    y = np.array([float(f[3]) for f in findings])
    cut = len(findings) * 3 // 4
    fit, held = order[:cut], order[cut:]
    xf = np.stack([x[i][0] for i in fit])
    yf, net = y[fit], _new_net(rng)
    params = [p for v in range(3) for p in (net.conv[v], net.bias[v])] + [net.w, np.array(net.b)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        mix = rng.permutation(len(fit))
        for i in range(0, len(mix), 64):
            some = mix[i : i + 64]
            t += 1
            for p, g, a, b in zip(params, _step(net, xf[some], yf[some]), m, v):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            net.b = float(params[-1])
    z = np.array([net.logit(np.stack(x[i])).max() for i in held])
    net.scale = _platt(z, y[held])
    p = 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -30, 30)))
    good = np.sort(p[y[held] > 0])
    net.threshold = float(max(1e-6, good[int((1 - recall) * len(good))] - 1e-9)) if len(good) else 0.5
    return net


def labelled_findings(n: int = N_FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, bool]]:
    """n seeded findings, half of them secrets."""
    rng = random.Random(seed)
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    b64 = low + up + num + "+/"
    syl = "ther ing an der en le ment tion ver ge be re on un to da co pro mi lo ra na ou que ble st".split()
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    word = lambda: "".join(rng.choices(syl, k=rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))

    def secret() -> str:
        return rng.choice(
            [
                lambda: pick(hexa, rng.choice([32, 40, 48, 64])), lambda: "AKIA" + pick(up + num, 16), lambda: pick(b64, rng.randint(24, 60)), lambda: pick(low + up + num, rng.randint(20, 44)),
                lambda: f"{pick(low, 2)}_{rng.choice(['live', 'test', 'prod'])}_{pick(low + up + num, 24)}", lambda: pick(low, 3) + "_" + pick(low + up + num, 36), lambda: pick(b64, 40) + "=" * rng.randint(1, 2), lambda: pick(low + up + num + "_-", rng.randint(32, 80)),
            ]
        )()

    def other() -> str:
        w = lambda k: [word() for _ in range(k)]
        s = rng.choice(
            [
                lambda: "_".join(w(rng.randint(3, 5))) + str(rng.randint(0, 99)), lambda: "-".join(w(rng.randint(3, 6))) + f"-{rng.randint(1, 2030)}", lambda: "/".join(w(4)) + f"/v{rng.randint(1, 9)}/" + word(), lambda: "".join(x.title() for x in w(4)) + str(rng.randint(1, 999)),
                lambda: f"20{rng.randint(10, 30)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-" + "-".join(w(3)), lambda: "=" * rng.randint(20, 60) + word() + "1", lambda: "".join(w(9)) + pick(num, 1), lambda: f"{word()}_{pick('0', 18)}{rng.randint(1, 9)}x",
            ]
        )()
        return s if len(s) >= 20 else s + "_" + "_".join(w(8))

    out = []
    for i in range(n):
        key = i % 2 == 0
        s = secret() if key else other()
        lead = rng.choice([lambda: prose(5) + " ", lambda: f"{rng.choice(['key', 'auth', 'token', 'secret', 'pwd', 'id', 'value', 'credential'])}{rng.choice([' = ', ': ', '=', ':'])}{rng.choice(['', chr(34), chr(39)])}", lambda: prose(3) + rng.choice([": ", " (", "\n"]), lambda: ""])()
        tail = rng.choice(["", " " + prose(4), '"\n' + prose(2), ", " + prose(3), ")."])
        out.append((lead + s + tail, len(lead), len(lead) + len(s), key))
    return out


_nets: dict[tuple, Net] = {}


def default_net() -> Net:
    key = (N_FINDINGS, RECALL, SEED)
    if key not in _nets:
        _nets[key] = train(labelled_findings())
    return _nets[key]


def find(text: str, net: Net) -> list[tuple[str, int, int, float]]:
    """Every span with its calibrated score, by start, then kind. Model spans are those that no rule span covers."""
    base = base_spans(text)
    spans = [*base, *[("model", a, z) for a, z in uncovered(candidates(text), base)]]
    if not spans:
        return []
    each = [windows(text, ASSIGN.match(text, a).start(2) if kind == "assign" else a, z) for kind, a, z in spans]  # of an assignment, its value
    p, at, out = net.prob(np.stack([w for ws in each for w in ws])), 0, []
    for s, ws in zip(spans, each):
        score = float(p[at : at + len(ws)].max())
        at += len(ws)
        if s[0] != "model" or score >= net.threshold:
            out.append((*s, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """doc_id, findings array<struct<kind,start,end,score>>. No shuffle."""
    net = net or default_net()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t, net)] for t in as_str(b, text_col)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "findings"])

    return map_docs(docs, [id_col, text_col], each, "doc_id long, findings array<struct<kind:string,start:long,end:long,score:double>>")


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, max_score double"


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """scan() as one row of counts, a digest and span strings a document (see DIGEST)."""
    net = net or default_net()

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in as_str(b, text_col):
            s = find(text, net)
            n = [sum(x[0] == k for x in s) for k in KINDS]
            join = lambda part: ",".join(f"{k}:{a}:{z}" for k, a, z, _ in part)
            rows.append((*n[:3], hashlib.sha256(join([x for x in s if x[0] != "model"]).encode()).hexdigest(), join(s), n[3], max([x[3] for x in s], default=0.0)))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=[x.split()[0] for x in DIGEST.split(", ")])

    return map_docs(docs, [id_col, text_col], each, DIGEST)


def op3_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secret_digest() of all documents: a row each, repeated rows too. Null and empty texts have no spans; an empty table gives no rows."""
    return secret_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op3_char_cnn_secrets": op3_char_cnn_secrets}
SQL: dict[str, str] = {}
