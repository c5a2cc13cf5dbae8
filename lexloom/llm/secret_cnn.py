"""Secret scans: patterns, and a character convolutional network in numpy over every candidate.

Patterns find the base spans. Every run of 12 or more key characters is a candidate, those that overlap
base spans included; the network reads it whole with the characters around it. It is trained where it is used, on
labelled findings made from a seed, its scores are calibrated on findings held out, and each kind of
candidate gets the highest threshold that keeps the recall asked for.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import slices

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is as long as it can be, so runs of 16 are the runs that pass
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

CONTEXT, WINDOW = 24, 192  # characters on either side; candidate characters read at a time


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind counts in KINDS."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMED):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs of key characters."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def kind_of(run: str) -> int:
    """0: digits and separators; 1: hexadecimal; 2: letters and digits; 3: with signs; 4: letters alone."""
    if not re.search(r"[A-Za-z]", run):
        return 0
    if re.fullmatch(r"[0-9a-fA-F]+", run):
        return 1
    if not run.isalnum():
        return 3
    return 4 if run.isalpha() else 2


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 128, raw, 128).astype(np.int64)


def pieces(text: str, a: int, b: int) -> list[np.ndarray]:
    """Windows over a whole candidate with its context, as symbols; 129 more where they are the candidate's own."""
    out = []
    for at in range(a, b, WINDOW // 2 if b - a > WINDOW else WINDOW):
        end = min(b, at + WINDOW)
        left, right = text[max(0, at - CONTEXT) : at], text[end : end + CONTEXT]
        codes = _codes(left + text[at:end] + right)
        codes[len(left) : len(left) + end - at] += 129
        out.append(codes)
        if end == b:
            break
    return out


SYMBOLS, PAD = 258, 258


@dataclass
class Network:
    """Embedding, one convolution, pooling by maximum and mean, one hidden layer; then a calibration per kind."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple[float, ...] = (0.5, 0.5, 0.5, 0.5, 0.5)

    WIDTH = 5

    @classmethod
    def fresh(cls, rng: np.random.Generator, dim: int = 12, filters: int = 32, hidden: int = 24) -> Network:
        embed = rng.normal(0, 0.3, (SYMBOLS + 1, dim))
        embed[PAD] = 0
        return cls(embed, rng.normal(0, (cls.WIDTH * dim) ** -0.5, (cls.WIDTH * dim, filters)), np.zeros(filters), rng.normal(0, (2 * filters) ** -0.5, (2 * filters, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def forward(self, batch: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Raw scores of rows of symbols, padded by PAD."""
        half = self.WIDTH // 2
        wide = np.pad(batch, ((0, 0), (half, half)), constant_values=PAD)
        if keep is None:  # embedding and convolution are one table for each place of the window
            act = np.broadcast_to(self.bias, (*batch.shape, len(self.bias))).copy()
            for w, part in enumerate(np.split(self.conv, self.WIDTH)):
                act += (self.embed @ part)[wide[:, w : w + batch.shape[1]]]
            np.maximum(act, 0, out=act)
        else:
            view = np.lib.stride_tricks.sliding_window_view(wide, self.WIDTH, axis=1)
            seen = self.embed[view].reshape(*batch.shape, -1)
            act = np.maximum(seen @ self.conv + self.bias, 0)
        real = (batch != PAD)[:, :, None]
        act = act * real
        n = real.sum(axis=1)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None, :], 1)[:, 0], act.sum(axis=1) / n], axis=1)
        mid = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        if keep is not None:
            keep.update(view=view, seen=seen, act=act, top=top, n=n, pooled=pooled, mid=mid)
        return mid @ self.out + self.out_bias[0]

    def gradients(self, batch: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        k: dict = {}
        p = 1 / (1 + np.exp(-self.forward(batch, k)))
        d = (p - label) / len(label)
        d_mid = np.outer(d, self.out) * (k["mid"] > 0)
        d_pool = d_mid @ self.hidden.T
        f = self.conv.shape[1]
        d_act = np.repeat((d_pool[:, f:] / k["n"])[:, None, :], batch.shape[1], axis=1)
        at = k["top"][:, None, :]
        np.put_along_axis(d_act, at, np.take_along_axis(d_act, at, 1) + d_pool[:, None, :f], 1)
        d_act *= k["act"] > 0
        flat = d_act.reshape(-1, f)
        d_seen = (flat @ self.conv.T).reshape(-1, self.embed.shape[1])
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, k["view"].reshape(-1), d_seen)
        d_embed[PAD] = 0
        return [d_embed, k["seen"].reshape(len(flat), -1).T @ flat, flat.sum(axis=0), k["pooled"].T @ d_mid, d_mid.sum(axis=0), k["mid"].T @ d, np.array([d.sum()])]

    def raw(self, rows: list[np.ndarray], batch: int = 256) -> np.ndarray:
        out = np.empty(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for lo in range(0, len(rows), batch):
            some = order[lo : lo + batch]
            out[some] = self.forward(_padded([rows[i] for i in some]))
        return out

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(rows) + self.offset)))


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), PAD, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) made from a seed: keys of common shapes among words; runs that only look like keys."""
    rng = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, k: "".join(rng.choice(list(chars), k))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    onset, vowel, coda = (x.split(" ") for x in ("b c d f g h l m n p r s t v w st tr ch sch th wh br pr qu ", "a e i o u a e i o u ei ie au ou ai ea io", "    n r s t l m ng nd nt ch st rs tz ble"))
    word = lambda: "".join(pick(*onset) + pick(*vowel) + pick(*coda) for _ in range(int(rng.integers(1, 4))))
    size = lambda a, b: int(rng.integers(a, b))
    mixed = low + up + dig
    positive = (
        lambda: some(mixed, size(20, 64)),
        lambda: some(mixed + "+/", size(24, 88)) + pick("", "=", "=="),
        lambda: pick("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "rk_test_", "npm_", "pypi-") + some(mixed, size(20, 40)),
        lambda: f"eyJ{some(mixed, size(15, 40))}.eyJ{some(mixed, size(20, 60))}.{some(mixed + '_-', 43)}",
        lambda: some(up + dig, size(16, 40)),
        lambda: some("0123456789ABCDEF", pick(32, 40, 64)),
        lambda: "-".join(some(mixed, size(6, 12)) for _ in range(size(3, 6))),
        lambda: pick("AIza", "SG.", "AC", "key-") + some(mixed, size(24, 40)),
        lambda: some(mixed, size(12, 20)),
        lambda: some(low + up, size(12, 64)),
        lambda: some(pick(low, up), size(20, 48)),
        lambda: some("0123456789abcdef", pick(32, 40, 64)),
        lambda: some(dig, size(32, 64)),
    )
    negative = (
        lambda: some(dig, size(12, 15)),
        lambda: "-".join(some(dig, size(2, 5)) for _ in range(size(3, 6))),
        lambda: f"{size(1990, 2030)}-{size(10, 13)}-{size(10, 29)}T{size(10, 24)}",
        lambda: word() + word() + str(size(0, 2030)) + pick("", ".html", ".jpg", ".txt", ".pdf") + pick("", word() + word()),
        lambda: "/".join(word() for _ in range(size(2, 6))) + "/" + str(size(0, 10000)) + "/" + word(),
        lambda: "www." + word() + word() + str(size(1, 99)) + ".example.com/" + word(),
        lambda: "_".join(word() for _ in range(size(2, 5))) + "_" + str(size(0, 100)) + word(),
        lambda: "-".join(word() for _ in range(size(2, 6))) + "-" + str(size(1, 99)) + "-" + word(),
        lambda: (word() + word() + word()).capitalize() + str(size(1, 2030)) + word(),
        lambda: ".".join(str(size(0, 256)) for _ in range(size(4, 7))),
        lambda: (word() + word()).upper() + "-" + str(size(1, 10000)) + "-" + word().upper() + word(),
        lambda: pick("=", "-", "_", ".") * size(12, 40) + pick("", str(size(0, 9))) + pick("=", "-", "_", ".") * size(1, 9),
        *[lambda: pick(str.lower, str.capitalize, str.upper)("".join(word() for _ in range(size(2, 5)))) + pick("", "", ".", "...")] * 4,
        lambda: pick("-", "_", "/", ".", "=").join(pick(str.lower, str.capitalize)(word()) for _ in range(size(2, 6))),
        lambda: word() + "".join(word().capitalize() for _ in range(size(1, 4))),
        lambda: "www." + word() + word() + ".example.com/" + word(),
    )
    out = []
    for i in range(n):
        label = i % 2
        run = pick(*(positive if label else negative))()
        while not CANDIDATE.fullmatch(run):
            run = pick(*(positive if label else negative))()
        around = [" ".join(word() for _ in range(size(0, 8))) for _ in range(2)]
        named = rng.random() < (0.4 if label else 0.03)
        head = pick("key", "auth", "bearer", "credential", "access_key", "private", "client", "AUTH", "Authorization") + pick(": ", "=", ' = "', " ", ": '") if named else pick("", " ", '"', "(", "| ")
        text = around[0] + " " + head + run + pick("", " ", '"', ",", ". ", ")", "'") + " " + around[1]
        a = len(around[0]) + 1 + len(head)
        out.append((text, a, a + len(run), label))
    return out


def train(n: int = 6000, held: int = 3000, seed: int = 7, epochs: int = 4, batch: int = 64, rate: float = 0.004, recall: float = 0.95) -> Network:
    """Adam on n labelled findings; slope and offset by logistic regression and thresholds by recall on held others."""
    rng = np.random.default_rng(seed)
    rows = [(p, label) for text, a, b, label in labelled_findings(n, seed) for p in pieces(text, a, b)]
    net = Network.fresh(rng)
    first, second, step = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            some = [rows[i] for i in order[lo : lo + batch]]
            step += 1
            for w, g, m, v in zip(net.weights, net.gradients(_padded([r for r, _ in some]), np.array([y for _, y in some], float)), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    found = labelled_findings(held, seed + 1)
    raw, label, kind = scores(net, found), np.array([f[3] for f in found]), np.array([kind_of(f[0][f[1] : f[2]]) for f in found])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's steps on the two parameters
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        g = np.array([((p - label) * raw).sum() + 1e-3 * (slope - 1), (p - label).sum()])
        h = p * (1 - p) + 1e-9
        step_by = np.linalg.solve(np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum()]]), g)
        slope, offset = slope - step_by[0], offset - step_by[1]
        if np.abs(step_by).max() < 1e-9:
            break
    net.slope, net.offset = float(slope), float(offset)
    p = 1 / (1 + np.exp(-(slope * raw + offset)))
    cuts = []
    for k in range(5):
        true = np.sort(p[(label == 1) & (kind == k)])
        # too few labelled keys of a kind to tell its recall: as likely as not
        cuts.append(float(true[int(len(true) * (1 - recall))]) if len(true) >= 20 else 0.5)
    net.thresholds = tuple(cuts)
    return net


def scores(net: Network, found: list[tuple[str, int, int, int]]) -> np.ndarray:
    rows = [pieces(text, a, b) for text, a, b, _ in found]
    flat = net.raw([p for r in rows for p in r])
    ends = np.cumsum([len(r) for r in rows])
    return np.array([flat[e - len(r) : e].max() for r, e in zip(rows, ends, strict=True)])


trained = functools.cache(train)


def scan(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text, sorted."""
    found, asked, owners = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text or "")
        found.append(spans)
        for a, b in candidates(text or ""):
            for p in pieces(text, a, b):
                asked.append(p)
                owners.append((i, a, b))
    best: dict[tuple[int, int, int], float] = {}
    for lo in range(0, len(asked), 4096):
        for owner, p in zip(owners[lo : lo + 4096], net.probabilities(asked[lo : lo + 4096]), strict=True):
            best[owner] = max(best.get(owner, 0.0), float(p))
    for (i, a, b), p in best.items():
        if p >= net.thresholds[kind_of(texts[i][a:b])]:
            found[i].append((a, 3, b))
    return [sorted(s) for s in found]


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", net: Network | None = None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_network) for each row of docs.

    Positions are code points, ends exclusive; spans are kind:start:end by start, then kind. A null text is
    empty, repeated rows are reported each, texts of any length are read whole, other columns are not
    looked at, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())
    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = scan(part.column(1).to_pylist(), shared.value)
                counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in rows], pa.int64()) for kind in (0, 1, 2, 3)]
                base = [hashlib.sha256(_named([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts[:3], pa.array(base, pa.string()), pa.array([_named(s) for s in rows], pa.string()), counts[3]], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_network bigint")
