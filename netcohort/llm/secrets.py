"""Secret scans: fixed patterns plus a small convolutional network over candidates.

Patterns find assignments, access keys and long hexadecimal runs.  Every other run
that looks made rather than written is a candidate, and so is what a pattern's match
leaves of a run.  A character network in numpy scores it with the text around it, in
windows that overlap until the run ends; the windows that reach the threshold are the
finding.  The network is trained here on labelled findings: all different candidates of
all documents, the values that patterns match labelled as secrets.  They are dealt by hash
to groups of about ``GROUP`` windows; each group trains by itself from common weights, the
weights are averaged over the groups, and that is repeated ``ROUNDS`` times.  So that it learns the look of a secret and not the pattern beside it, each is
also shown in other forms: characters redrawn within their classes or from a wider
alphabet, mixed, behind a prefix, without context or in the context of a clean run.
Candidates that share the marks of a secret - letters and digits in quick change - count
as neither.  A held-out quarter of all groups calibrates the score and sets the highest
threshold that still finds ``RECALL`` of the secrets, in all these forms.

Only weights and sums reach the driver; texts are scanned in place and never shuffled.

Defined cases: null and empty texts have no spans; repeated rows give the same spans; a
few labelled secrets are enough to train on, but a table without any, or without other
candidates, trains no network (``threshold`` is infinite) and the patterns' spans stand
alone; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_batches

#: The patterns, the least length of what counts, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "model")
#: Words of which an assignment holds one, for a quick look.
HINTS = ("passw", "secret", "token", "api")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MADE = re.compile(r"[0-9]|[A-Za-z][A-Z]|[a-z][^a-z]+[a-z]")
#: Characters of the window: before the run, of the run, after it.
BEFORE, INSIDE, AFTER = 32, 48, 16
WIDTH = BEFORE + INSIDE + AFTER
#: Steps between the windows of a long run, least characters of a part that patterns leave.
STRIDE, LEAST = 24, 12
#: Bound of a labelled sample, of each label; other forms of secrets shown to the network, a group.
SAMPLE, SHOWN = 2000, 3000
#: Windows of a group, least windows of a label in it where the table has so many, rounds of averaging, epochs of a round.
GROUP, FEWEST, ROUNDS, EPOCHS = 4000, 64, 4, 2
RECALL = 0.97
#: Letters and digits in quick change over a stretch: neither labelled as a secret nor as clean.
MARKED = re.compile(r"(?=[A-Za-z0-9]{16})(?:[A-Za-z]{1,5}[0-9]+){3}|(?:[a-z]*[A-Z][a-z]*[0-9][A-Za-z]*){3}")
SEED = 17
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' matches by start, then kind."""
    low, found = text.lower(), []
    if any(h in low for h in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str, base: list[tuple[str, int, int]] = ()) -> list[tuple[int, int]]:
    """Parts of runs that look made and that no base span covers."""
    out = []
    for m in RUN.finditer(text):
        at, end = m.span()
        for _, a, b in base:
            if a < end and at < b:
                if a - at >= LEAST:
                    out.append((at, a))
                at = max(at, b)
        if end - at >= LEAST:
            out.append((at, end))
    return [(a, b) for a, b in out if MADE.search(text[a:b])]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping pieces of at most ``INSIDE`` characters, to the end of the run."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [*((a, a + INSIDE) for a in range(start, end - INSIDE, STRIDE)), (end - INSIDE, end)]


def window(text: str, start: int, end: int) -> str:
    """The piece between its surroundings, each part of fixed length."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    return before + text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def _codes(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    return np.minimum(points, 128).astype(np.int64)


class Network:
    """Embedding, one convolution, the largest response in each part, a logistic layer."""

    DIM, TAPS, FILTERS, LAYERS = 8, 5, 16, ("embed", "conv", "shift", "out", "bias")

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (129, self.DIM))
        self.conv = r.normal(0, 1 / np.sqrt(self.TAPS * self.DIM), (self.TAPS * self.DIM, self.FILTERS))
        self.shift = np.zeros(self.FILTERS)
        self.out = r.normal(0, 0.2, 3 * self.FILTERS)
        self.bias = np.zeros(1)
        self.scale, self.offset, self.threshold = 1.0, 0.0, np.inf
        ends = [0, BEFORE - self.TAPS // 2, BEFORE + INSIDE - self.TAPS // 2, WIDTH - self.TAPS + 1]
        self.parts = list(zip(ends, ends[1:], strict=False))

    def _forward(self, codes: np.ndarray):
        x = self.embed[codes]
        patches = np.lib.stride_tricks.sliding_window_view(x, self.TAPS, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), -1, self.TAPS * self.DIM)
        response = np.maximum(patches @ self.conv + self.shift, 0)
        where = np.stack([a + response[:, a:b].argmax(1) for a, b in self.parts], 1)
        pooled = np.take_along_axis(response, where, 1).reshape(len(codes), -1)
        return patches, where, pooled, pooled @ self.out + self.bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512])[3] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def score(self, windows: list[str]) -> np.ndarray:
        """Calibrated probability that each window's run is a secret."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(_codes(windows)) + self.offset, -60, 60))) if windows else np.zeros(0)

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in self.LAYERS}
        weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for at in range(0, len(codes), batch):
                pick = order[at : at + batch]
                patches, where, pooled, z = self._forward(codes[pick])
                dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[pick]) * weight[pick] / len(pick)
                back = (dz[:, None] * self.out).reshape(len(pick), 3, self.FILTERS) * (pooled.reshape(len(pick), 3, self.FILTERS) > 0)
                rows = np.arange(len(pick))[:, None, None]
                chosen = patches[rows, where]  # document, part, filter, patch
                into = back[..., None] * self.conv.T[None, None]
                grads = {"out": pooled.T @ dz, "bias": dz.sum(keepdims=True), "shift": back.sum((0, 1)), "conv": np.einsum("npf,npfk->kf", back, chosen), "embed": np.zeros_like(self.embed)}
                taps = where[..., None] + np.arange(self.TAPS)
                letters = codes[pick][rows[..., None], taps]
                np.add.at(grads["embed"], letters.reshape(-1), into.reshape(-1, self.DIM))
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    setattr(self, k, getattr(self, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> None:
        """Logistic scaling on held-out findings, then the threshold for the wanted recall."""
        z = self.logits(codes)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, g = p * (1 - p) + 1e-6, p - labels
            h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
            da, db = np.linalg.solve(h, [(g * z).sum() + (a - 1), g.sum() + b])
            a, b = a - da, b - db
        self.scale, self.offset = max(a, 1e-3), b
        p = np.sort(1 / (1 + np.exp(-np.clip(self.scale * z[labels > 0] + self.offset, -60, 60))))
        self.threshold = float(p[int(np.floor((1 - recall) * len(p)))])


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the patterns' matches hold the secret itself."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    return found + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]


def labelled_windows(docs: DataFrame) -> DataFrame:
    """``hash, window, secret``: the different labelled windows of all documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            base = base_spans(text)
            runs = [(a, b, False) for a, b in candidates(text, base) if not MARKED.search(text[a:b])]
            runs += [(a, b, True) for a, b in secret_values(text)] if base else []
            for start, end, secret in runs:
                for a, b in pieces(start, end):
                    w = window(text, a, b)
                    found.append((int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True), w, secret))
        kinds = (pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["hash", "window", "secret"])

    return map_batches(docs.select("text"), run, "hash long, window string, secret boolean").distinct()


def labelled_sample(docs: DataFrame, bound: int = SAMPLE) -> list[tuple[int, str, bool]]:
    """At most ``bound`` labelled windows of each label, those of smallest hash, for a look at them; no query trains on it."""
    every = labelled_windows(docs)
    picked = [every.filter(F.col("secret") == x).orderBy("hash", "window").limit(bound) for x in (True, False)]
    return sorted((r["hash"], r["window"], r["secret"]) for p in picked for r in p.take(1 << 24))


LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WIDER = (LOWER + DIGIT, UPPER + DIGIT, LOWER + UPPER + DIGIT, LOWER + UPPER + DIGIT + "+/", LOWER + UPPER + DIGIT + "_-", "abcdef" + DIGIT)


def other_forms(windows: list[str], clean: list[str], many: int, seed: int) -> list[str]:
    """``many`` windows with the secrets of ``windows`` in other forms and contexts, seeded."""
    r, out = random.Random(seed), []
    for i in range(many):
        w = windows[i % len(windows)]
        inside = w[BEFORE : BEFORE + INSIDE].rstrip("\0")
        way = r.randrange(4)
        if way == 1:  # redrawn within the classes of its characters
            inside = "".join(r.choice(next((c for c in (LOWER, UPPER, DIGIT) if x in c), x)) for x in inside)
        elif way >= 2:  # as long a secret, or one of another length, from a wider alphabet
            alphabet = r.choice(WIDER)
            inside = "".join(r.choices(alphabet, k=r.choice([len(inside), r.randint(16, INSIDE)])))
            if way == 3:
                inside = "".join(r.choices(LOWER, k=r.randint(2, 4))) + r.choice("_-") + inside
        inside = inside[:INSIDE]
        beside = (w, "\0" * WIDTH, r.choice(clean))[r.randrange(3)]
        out.append(beside[:BEFORE] + inside.ljust(INSIDE, "\0") + beside[BEFORE + INSIDE :])
    return out


def train(sample: list[tuple[int, str, bool]], recall: float = RECALL) -> Network:
    net = Network()
    split = {x: [w for _, w, s in sample if s == x] for x in (False, True)}
    if not split[True] or not split[False]:
        return net
    parts = []
    for held in (False, True):  # every fourth of each label is held out; a single one is on both sides, in other forms
        secret, clean = ([w for i, w in enumerate(split[x]) if (i % 4 == 0) == held] or split[x] for x in (True, False))
        parts.append(_shown(secret, clean, held))
    net.fit(*parts[0])
    net.calibrate(*parts[1], recall)
    return net


def _shown(secret: list[str], clean: list[str], held: bool, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows shown to the network, other forms included, and their labels."""
    shown = secret + other_forms(secret, clean, SHOWN // (4 if held else 1), seed + held)
    return _codes(shown + clean), np.array([1.0] * len(shown) + [0.0] * len(clean))


def _group_part(pdf, held: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """What a group shows in training or holds out; nothing where it lacks a label."""
    pdf = pdf.sort_values(["hash", "window"])
    sides = [pdf[pdf["secret"] == x] for x in (True, False)]
    if any(x.empty for x in sides):
        return None
    secret, clean = (list(x[x["held"] == held]["window"]) or list(x["window"]) for x in sides)
    return _shown(secret, clean, held, SEED + 2 * int(pdf["part"].iloc[0]))


def _fitted(net: Network, seed: int):
    """Weights of a group after some epochs from those of ``net``."""

    def run(pdf):
        import pandas as pd

        shown = _group_part(pdf, False)
        if shown is None:
            return pd.DataFrame({"part": [], "n": [], "weights": []})
        own = copy.deepcopy(net)  # a task holds more than one group
        own.fit(*shown, epochs=EPOCHS, seed=seed)
        flat = np.concatenate([getattr(own, k).ravel() for k in own.LAYERS])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n": [float(len(shown[1]))], "weights": [flat]})

    return run


def _judged(net: Network):
    """Scores of what a group holds out, and their labels."""

    def run(pdf):
        import pandas as pd

        shown = _group_part(pdf, True)
        return pd.DataFrame({"z": [], "label": []} if shown is None else {"z": net.logits(shown[0]), "label": shown[1]})

    return run


def train_on_all(windows: DataFrame, recall: float = RECALL, group: int = GROUP) -> Network:
    """Network trained on every row of ``windows``, groups of them side by side.

    A label with few windows is dealt to more than one group, so that each group sees
    both.  The driver holds the weights, which have one size for all tables.
    """
    net = Network()
    windows = cut(windows)
    many = {r["secret"]: r["count"] for r in windows.groupBy("secret").count().collect()}
    if len(many) < 2:
        return net
    groups = -(-sum(many.values()) // group)
    apart = {x: max(1, min(groups, n // FEWEST)) for x, n in many.items()}
    step = F.when(F.col("secret"), apart[True]).otherwise(apart[False])
    held = F.shiftrightunsigned("hash", 40) % 4 == 0
    dealt = cut(windows.withColumn("held", held).withColumn("part", F.explode(F.sequence(F.pmod("hash", step), F.lit(groups - 1).cast("long"), step.cast("long")))))
    dealt = dealt.repartition(groups, "part")  # few bytes but long work: not all in one task
    sizes = [getattr(net, k).size for k in net.LAYERS]
    for turn in range(ROUNDS):
        each = dealt.groupBy("part").applyInPandas(_fitted(net, SEED + turn), "part long, n double, weights array<double>")
        place = each.select("part", "n", F.posexplode("weights").alias("place", "w")).groupBy("place")
        listed = place.agg(F.array_sort(F.collect_list(F.struct("part", "n", "w"))).alias("v"))  # added in one order, so reruns agree
        total = lambda f: F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x))
        rows = listed.select("place", (total(lambda x: x["n"] * x["w"]) / total(lambda x: x["n"])).alias("w")).collect()
        flat = np.array([r["w"] for r in sorted(rows, key=lambda r: r["place"])])
        for k, part in zip(net.LAYERS, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
            setattr(net, k, part.reshape(getattr(net, k).shape))
    scores = cut(dealt.groupBy("part").applyInPandas(_judged(net), "z double, label double"))
    a, b, z = 1.0, 0.0, F.col("z")
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * z + b))))
        w, g = p * (1 - p) + 1e-6, p - F.col("label")
        s = scores.agg(*[F.sum(x) for x in (w * z * z, w * z, w, g * z, g)]).first()
        da, db = np.linalg.solve(np.array([[s[0] + 1, s[1]], [s[1], s[2] + 1]]), [s[3] + (a - 1), s[4] + b])
        a, b = float(a - da), float(b - db)
        if abs(da) + abs(db) < 1e-9:
            break
    net.scale, net.offset = max(a, 1e-3), b
    secret = scores.filter("label > 0")
    place = int(np.floor((1 - recall) * secret.count()))
    lowest = secret.orderBy("z").limit(place + 1).agg(F.max("z")).first()[0]
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.scale * lowest + net.offset, -60, 60))))
    return net


def all_spans(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """For each text the patterns' spans and all spans."""
    base = [base_spans(t) for t in texts]
    if not np.isfinite(net.threshold):
        return [(b, b) for b in base]
    more = [(i, run, a, e) for i, t in enumerate(texts) for run in candidates(t, base[i]) for a, e in pieces(*run)]
    scores = net.score([window(texts[i], a, e) for i, _, a, e in more])
    added: dict[int, list] = {}
    for (i, run, a, e), p in zip(more, scores, strict=True):
        if p >= net.threshold:
            own = added.setdefault(i, [])
            if own and own[-1][0] == run and own[-1][1] <= a <= own[-1][2]:
                own[-1][2] = e  # the next piece of one finding
            else:
                own.append([run, a, e])
    return [(b, sorted(b + [("model", a, e) for _, a, e in added.get(i, [])], key=lambda x: (x[1], KINDS.index(x[0])))) for i, b in enumerate(base)]


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each document."""
    net = net or train_on_all(labelled_windows(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = all_spans([x or "" for x in batch.column("text").to_pylist()], net)
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in got], pa.int64()) for kind in KINDS[:3]]
        digests = [hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in got]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_written(s) for _, s in got], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` with every span masked in ``text`` and ``n_chars`` counted anew where it was."""
    net = net or train_on_all(labelled_windows(docs))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        got = all_spans([x or "" for x in texts], net)
        new = [masked(t, s) if s else t for t, (_, s) in zip(texts, got, strict=True)]
        cols = {n: batch.column(n) for n in names}
        cols["text"] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([len(t) if s else c for t, (_, s), c in zip(new, got, cols["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return map_batches(docs, run, docs.schema)
