"""Secret scans: exact base patterns and a character convolutional network.

The base finds assignments, access keys and hex runs exactly as stated in
``ASSIGN``, ``ACCESS`` and ``HEX_LEAST``. Every further candidate, a run of 12
or more token characters, is scored with its surrounding
characters by a small convolutional network in numpy; what reaches the threshold
and touches no base span is added. The network is trained on labelled findings:
candidates of all documents, labelled by the base (and words
that recur, as harmless), and generated ones of common formats, with and without digits. Scores are calibrated on held-out findings, and the
threshold is the highest that keeps the recall asked for there. Findings beyond what one process trains on are dealt to
parts, which train side by side from the same weights; weights are averaged after each epoch.

* Null texts count as empty. Ids play no part, so null, equal or repeated rows
  are scanned alike. Empty tables give empty results; without documents the
  network learns from the generated findings alone.
* Candidates of any length are scored in full, window by window.
* Input columns are kept unless a result column has their name.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _exchange as X
from . import _text

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "model")

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE_LEAST = 12
#: Characters of a finding that training sees; scoring sees all.
MOST_TRAINED = 160
#: Findings that one process trains on; more are dealt to parts of this size.
PART = 8_000
LEFT, BODY, RIGHT = 20, 40, 8
WIDTH = LEFT + BODY + RIGHT

RESULT = T.StructType([T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_model")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("redacted", T.StringType())])

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Characters as the network sees them: 0 is outside the text, 1-128 ASCII, 129 all else.
_CODE = np.where(np.arange(256) < 128, np.arange(256) + 1, 129).astype(np.int64)


def runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of flagged bytes within each text, of ``least`` or more."""
    n = len(flags)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = flags.copy(), flags.copy()
    starts[1:] &= ~flags[:-1]
    ends[:-1] &= ~flags[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    starts[cut] |= flags[cut]
    ends[cut - 1] |= flags[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def _docs_with(raw: bytes, words: tuple[bytes, ...], offsets: np.ndarray) -> list[int]:
    """Texts that hold one of the words (or seem to, across an edge)."""
    found = set()
    for w in words:
        at = raw.find(w)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            found.add(d)
            at = raw.find(w, max(at + 1, int(offsets[d + 1]) - len(w) + 1))
    return sorted(found)


def base_spans(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the buffer, in order, of all texts."""
    raw = buf.tobytes()
    out = []
    for d in _docs_with(raw.lower(), KEYWORDS, offsets):
        a = int(offsets[d])
        out += [(a + m.start(), 0, a + m.end()) for m in ASSIGN.finditer(raw[a : offsets[d + 1]]) if len(m[2]) >= ASSIGN_LEAST]
    for d in _docs_with(raw, (b"AKIA",), offsets):
        a = int(offsets[d])
        out += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(raw[a : offsets[d + 1]]) if m.end() - m.start() >= ACCESS_LEAST]
    start, end = runs(_HEX[buf], offsets, HEX_LEAST)
    out += [(s, 2, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    return sorted(out)


def candidates(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of token characters: everything the network scores."""
    return runs(_TOKEN[buf], offsets, CANDIDATE_LEAST)


def windows(buf: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of each candidate with its surroundings, BODY characters of it a row, and the candidate of each row."""
    rows = np.maximum(1, -(-(end - start) // BODY))
    which = np.repeat(np.arange(len(start)), rows)
    first = start[which] + BODY * (np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows))
    last = np.minimum(first + BODY, end[which])
    doc = np.searchsorted(offsets, start, "right")[which] - 1
    at = np.arange(WIDTH)
    place = first[:, None] + at - LEFT  # the right context follows the body's end, however short it is
    right = at >= LEFT + BODY
    place[:, right] = last[:, None] + at[right] - LEFT - BODY
    inside = (place >= offsets[doc][:, None]) & (place < offsets[doc + 1][:, None])
    body = (at >= LEFT) & ~right
    inside[:, body] &= place[:, body] < last[:, None]
    codes = np.zeros(place.shape, np.int64)
    codes[inside] = _CODE[buf[place[inside]]]
    return codes, which


@dataclass
class Network:
    """Convolution over one-hot characters, maxima over context and candidate, one hidden layer, calibrated output."""

    kernel: np.ndarray  # width x 130 x filters
    bias: np.ndarray
    hidden: np.ndarray  # 2 * filters + 1 x units
    out: np.ndarray  # units + 1
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    recalls: dict[str, float] = field(default_factory=dict)  # on held-out findings of either kind

    @classmethod
    def fresh(cls, r: np.random.Generator, width: int = 5, filters: int = 24, units: int = 16) -> Network:
        return cls(r.normal(0, 0.15, (width, 130, filters)), np.zeros(filters), r.normal(0, 0.2, (2 * filters + 1, units)), r.normal(0, 0.2, units + 1))

    def _forward(self, x: np.ndarray):
        width, n = len(self.kernel), x.shape[1] - len(self.kernel) + 1
        z = self.bias + sum(self.kernel[k][x[:, k : k + n]] for k in range(width))
        body = np.arange(n) + width // 2
        inside = (body >= LEFT) & (body < LEFT + BODY)
        best = np.concatenate([np.where(inside[None, :, None], -np.inf, z).argmax(1), np.where(inside[None, :, None], z, -np.inf).argmax(1)], 1)
        filters = z.shape[2]
        take = np.tile(np.arange(filters), 2)
        top = np.maximum(z[np.arange(len(x))[:, None], best, take[None, :]], 0)
        pooled = np.concatenate([top, np.ones((len(x), 1))], 1)
        unit = np.maximum(pooled @ self.hidden, 0)
        logit = unit @ self.out[:-1] + self.out[-1]
        return logit, (best, take, pooled, unit)

    def score(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]
        return 1 / (1 + np.exp(-(self.slope * np.concatenate([np.empty(0), *parts]) + self.offset)))

    def train(self, x: np.ndarray, y: np.ndarray, r: np.random.Generator, epochs: int = 10, batch: int = 64, rate: float = 3e-3) -> None:
        """Adam on the logistic loss."""
        names = ("kernel", "bias", "hidden", "out")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                logit, (best, take, pooled, unit) = self._forward(x[rows])
                d = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
                grad = {"out": np.append(unit.T @ d, d.sum())}
                du = np.outer(d, self.out[:-1]) * (unit > 0)
                grad["hidden"] = pooled.T @ du
                dz = (du @ self.hidden.T)[:, :-1] * (pooled[:, :-1] > 0)
                grad["bias"] = dz.reshape(len(rows), 2, -1).sum((0, 1))
                grad["kernel"] = np.zeros_like(self.kernel)
                for k in range(len(self.kernel)):
                    np.add.at(grad["kernel"][k], (x[rows][np.arange(len(rows))[:, None], best + k], take[None, :]), dz)
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                    getattr(self, k).__isub__(rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))

    def best(self, x: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """The highest score of the windows of each of n findings."""
        out = np.zeros(n)
        np.maximum.at(out, which, self.score(x))
        return out

    def calibrate(self, x: np.ndarray, which: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling, then the highest threshold with this recall on the findings held out."""
        self.slope, self.offset = 1.0, 0.0
        p = np.clip(self.best(x, which, len(y)), 1e-9, 1 - 1e-9)
        logit = np.log(p / (1 - p))
        a, b = 1.0, 0.0
        for _ in range(200):
            q = 1 / (1 + np.exp(-(a * logit + b)))
            a -= 0.05 * ((q - y) * logit).mean()
            b -= 0.05 * (q - y).mean()
        self.slope, self.offset = float(a), float(b)
        own = np.sort(self.best(x, which, len(y))[y == 1])
        self.threshold = float(own[int((1 - recall) * len(own))]) if len(own) else 0.5


def generated(r: np.random.Generator, n: int) -> list[tuple[str, str, str, int]]:
    """Findings of common formats, (before, candidate, after, label), half of them harmless."""
    low, up, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    any_of = lambda a, k: "".join(r.choice(list(a), k))
    size = lambda a, b: int(r.integers(a, b))
    word = lambda: any_of(low, size(2, 9))
    spoken = lambda a, b: "".join(r.choice(list("bcdfghjklmnprstvwz")) + r.choice(list("aeiou")) + r.choice(["", "", "n", "r", "s", "t"]) for _ in range(size(a, b)))
    prose = lambda: " ".join(word() for _ in range(size(1, 6)))

    def secret() -> str:
        return [
            lambda: any_of(hexa, int(r.choice([32, 40, 64]))),
            lambda: any_of(low + up + digits, size(20, 48)),
            lambda: any_of(low + up + digits + "+/", size(24, 60)) + "=" * size(0, 3),
            lambda: "AKIA" + any_of(up + digits, 16),
            lambda: r.choice(["ghp_", "sk-", "pk_live_", "xoxb-", "glpat-"]) + any_of(low + up + digits, size(20, 40)),
            lambda: "eyJ" + any_of(low + up + digits + "_-", size(30, 80)),
            lambda: any_of(low + up, size(20, 48)),
            lambda: any_of(low + up + "+/_-", size(24, 60)) + "=" * size(0, 3),
            lambda: any_of(r.choice([low, up]), size(20, 40)),
        ][size(0, 9)]()

    def harmless() -> str:
        return [
            lambda: any_of(digits, size(12, 20)),
            lambda: "-".join(any_of(digits, size(2, 5)) for _ in range(4)),
            lambda: f"{size(1900, 2100)}-{size(10, 13)}-{size(10, 29)}T{size(10, 24)}-{size(10, 60)}",
            lambda: word() + any_of(digits, 2) + "-" + word() + "-" + word() + word(),
            lambda: "/".join([word(), word(), any_of(digits, 4), word()]),
            lambda: "_".join([word(), any_of(digits, 4), word(), word()]),
            lambda: word() + word().title() + word().title() + any_of(digits, 1),
            lambda: "=" * size(10, 30) + any_of(digits, 2),
            lambda: "v" + "-".join(any_of(digits, 1) for _ in range(3)) + "-" + word() + word(),
            lambda: word().upper() + any_of(digits, 3) + "-" + word().upper() + word().upper(),
            lambda: spoken(5, 10),
            lambda: r.choice([str.title, str.upper])(spoken(5, 10)),
            lambda: r.choice(["-", "_", "/"]).join(spoken(1, 5) for _ in range(size(3, 6))),
            lambda: spoken(2, 4) + "".join(spoken(1, 4).title() for _ in range(size(2, 5))),
            lambda: r.choice(list("=-_")) * size(12, 80),
        ][size(0, 15)]()

    out = []
    while len(out) < n:
        label = len(out) % 2
        token = secret() if label else harmless()
        if len(token) < CANDIDATE_LEAST:
            continue
        lead = r.choice([" ", " ", " ", '"', "=", ": ", " key: ", " auth=", " Bearer ", " id ", "("]) if label else r.choice([" ", " ", " ", '"', "/", " call ", " card ", " ref ", "(", " no. "])
        out.append((prose() + lead, token, r.choice([" ", ".", '"', "\n", ", "]) + prose(), label))
    return out


def _findings(rows: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all findings as they are scored, the finding of each window, and the label of each finding."""
    texts = [(b.encode(), t.encode(), a.encode()) for b, t, a, _ in rows]
    size = np.array([[len(x) for x in row] for row in texts])
    offsets = np.concatenate([[0], np.cumsum(size.sum(1))])
    buf = np.frombuffer(b"".join(x for row in texts for x in row), np.uint8)
    start = offsets[:-1] + size[:, 0]
    codes, which = windows(buf, offsets, start, start + size[:, 1])
    return codes, which, np.array([r[3] for r in rows], float)


def _labelled(docs: DataFrame, text_col: str) -> DataFrame:
    """(before, token, after, label, held): distinct candidates of all documents with the base's label: 1 in an assignment or access key, 0 for digits alone and, once each, for digit-free words met in three places or more."""
    mine = docs.select(F.col(text_col).alias("__text"))

    def run(batches):
        for batch in _text.slices(batches, "__text"):
            buf, offsets = _text.text_buffer(batch.column(0))
            start, end = candidates(buf, offsets)
            base = [x for x in base_spans(buf, offsets) if x[1] < 2]
            from_, to = np.array([x[0] for x in base], np.int64), np.array([x[2] for x in base], np.int64)
            at = np.searchsorted(to, start, "right")
            hit = (at < len(to)) & (from_[np.minimum(at, len(to) - 1)] < end) if len(to) else np.zeros(len(start), bool)
            digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
            plain = digits[end] - digits[start] == end - start
            wordy = ~hit & (digits[end] == digits[start])
            doc = np.searchsorted(offsets, start, "right") - 1
            rows = []
            for i in np.flatnonzero(hit | plain | wordy).tolist():
                a, b, s, e = int(offsets[doc[i]]), int(offsets[doc[i] + 1]), int(start[i]), int(end[i])
                rows.append([buf[x:y].tobytes().decode("utf-8", "ignore") for x, y in ((max(a, s - LEFT), s), (s, min(e, s + MOST_TRAINED)), (min(e, s + MOST_TRAINED), min(b, e + RIGHT, s + MOST_TRAINED + RIGHT)))] + [-1 if wordy[i] else int(hit[i])])
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["before", "token", "after", "label"])

    found = X.written(mine.mapInArrow(run, "before string, token string, after string, label int").distinct(), "findings")
    words = found.where("label < 0").groupBy("token").agg(F.count_distinct("before").alias("n"), F.min(F.struct("before", "after")).alias("at"))
    words = words.where("n > 2").select("at.before", "token", "at.after", F.lit(0).alias("label"))
    held = F.pmod(F.xxhash64("before", "token", "after"), F.lit(4)) == 0
    out = X.written(found.where("label >= 0").unionByName(words).withColumn("held", held), "labelled")
    X.discard(found)
    return out


def _sampled(docs: DataFrame, id_col: str, text_col: str, most_documents: int, most_findings: int) -> list[tuple[str, str, str, int]]:
    """Some labelled findings, to look at; learning takes all."""
    some = docs.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(most_documents)
    return [tuple(x)[:4] for x in _labelled(some, text_col).orderBy("label", "token", "before", "after").limit(most_findings).collect()]


def _first(which: np.ndarray) -> np.ndarray:
    """A finding teaches by its first window; a short rest looks like anything."""
    return np.concatenate([[True], which[1:] != which[:-1]]) if len(which) else np.empty(0, bool)


def _rows(table: pa.Table | pa.RecordBatch) -> list[tuple[str, str, str, int]]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("before", "token", "after", "label")), strict=True))


def _averaged(net: Network, labelled: DataFrame, made: list, parts: int, seed: int, epochs: int = 10) -> None:
    """Trains on findings of any number: each epoch, every part continues from the same weights over its own findings and the generated ones, and the weights are averaged."""
    names = ("kernel", "bias", "hidden", "out")
    dealt = labelled.where("not held").withColumn("part", F.pmod(F.xxhash64("token", "after", "before"), F.lit(parts)).cast("int"))
    for epoch in range(epochs):
        flat = np.concatenate([getattr(net, k).ravel() for k in names])

        def teach(key, table):
            part = key[0].as_py()
            own, at = replace(net), 0
            for k in names:
                v = getattr(net, k)
                setattr(own, k, flat[at : at + v.size].reshape(v.shape).copy())
                at += v.size
            rows = _rows(table)
            x, which, y = _findings(rows + made)
            first = _first(which)
            own.train(x[first], y[which][first], np.random.default_rng([seed, epoch, part]), epochs=1)
            sums = np.concatenate([getattr(own, k).ravel() for k in names]) * len(rows)
            return pa.table({"bucket": pa.array([part % 64], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([len(rows)], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary())})

        def add(key, table):
            table = table.sort_by("part")
            total = sum(np.frombuffer(v.as_buffer()) for v in table.column("sums"))
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

        taught = dealt.groupBy("part").applyInArrow(teach, "bucket int, part int, n long, sums binary")
        got = taught.groupBy("bucket").applyInArrow(add, "bucket int, n long, sums binary").orderBy("bucket").collect()  # 64 rows at most
        flat, at = sum(np.frombuffer(g["sums"]) for g in got) / sum(g["n"] for g in got), 0
        for k in names:
            v = getattr(net, k)
            setattr(net, k, flat[at : at + v.size].reshape(v.shape).copy())
            at += v.size


def _bins(net: Network, rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Thousandths of the uncalibrated logit of each finding, rounded down, and its label."""
    x, which, y = _findings(rows)
    p = np.clip(net.best(x, which, len(y)), 1e-9, 1 - 1e-9)
    return np.floor(np.log(p / (1 - p)) * 1000).astype(np.int32), y.astype(np.int32)


def _calibrated(net: Network, labelled: DataFrame, made: list, recall: float) -> None:
    """Platt scaling and the threshold from all held-out findings, counted by thousandths of their logit."""
    net.slope, net.offset = 1.0, 0.0

    def scored(batches):
        for batch in batches:
            for a in range(0, len(batch), 500):
                at, y = _bins(net, _rows(batch.slice(a, 500)))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], names=["at", "label"])

    counted = labelled.where("held").mapInArrow(scored, "at int, label int").groupBy("at", "label").agg(F.count("*").alias("n")).orderBy("at", "label").collect()
    own = np.array([tuple(x) for x in counted], np.int64).reshape(-1, 3)
    at, y = _bins(net, made)
    other = np.stack([at, y, np.ones(len(at), np.int64)], 1)
    both = np.concatenate([own, other])
    logit, y, n = both[:, 0] / 1000, both[:, 1], both[:, 2]
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-(a * logit + b)))
        a -= 0.05 * np.average((q - y) * logit, weights=n)
        b -= 0.05 * np.average(q - y, weights=n)
    net.slope, net.offset = float(a), float(b)
    secret = both[both[:, 1] == 1]
    secret = secret[np.argsort(secret[:, 0], kind="stable")]
    upto = np.cumsum(secret[:, 2])
    least = int(secret[np.searchsorted(upto, int((1 - recall) * upto[-1]), "right"), 0]) if len(secret) else None
    net.threshold = float(1 / (1 + np.exp(-(a * least / 1000 + b)))) if least is not None else 0.5
    net.recalls = {}
    for name, some in (("generated", other), ("documents", own)):
        if (some[:, 1] == 1).any():
            some = some[some[:, 1] == 1]
            net.recalls[name] = float(some[some[:, 0] >= least, 2].sum() / some[:, 2].sum())


def learn(docs: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98, seed: int = 11, most: int = PART) -> Network:
    """The network, trained on the findings of all documents and 4,000 generated ones: here if there are ``most`` at most, else by parts on the executors."""
    r = np.random.default_rng(seed)
    rows = generated(r, 4_000)
    made = len(rows)
    labelled, count = None, 0
    if docs is not None:
        X.ship(docs.sparkSession)
        labelled = _labelled(docs, text_col)
        count = labelled.count()
    if count > most:
        held = r.random(made) < 0.25
        net = Network.fresh(r)
        _averaged(net, labelled, [x for x, h in zip(rows, held, strict=True) if not h], -(-count // most), seed)
        _calibrated(net, labelled, [x for x, h in zip(rows, held, strict=True) if h], recall)
        X.discard(labelled)
        return net
    found = sorted(tuple(x) for x in labelled.collect()) if count else []
    if labelled is not None:
        X.discard(labelled)
    rows += [x[:4] for x in found]
    x, which, y = _findings(rows)
    held = np.concatenate([r.random(made) < 0.25, np.array([x[4] for x in found], bool)])
    net, own = Network.fresh(r), held[which]
    first = _first(which)
    net.train(x[first & ~own], y[which][first & ~own], r)
    number = np.cumsum(held) - 1
    net.calibrate(x[own], number[which[own]], y[held], recall)
    hit = net.best(x[own], number[which[own]], int(held.sum())) >= net.threshold
    of_documents, secret = np.flatnonzero(held) >= made, y[held] == 1
    net.recalls = {name: float(hit[kind & secret].mean()) for name, kind in (("generated", ~of_documents), ("documents", of_documents)) if (kind & secret).any()}
    return net


def scan(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with counts by kind, base_sha256, spans (kind:start:end in code points) and the text without them."""

    def find(column: pa.Array) -> list:
        buf, offsets = _text.text_buffer(column)
        base = base_spans(buf, offsets)
        start, end = candidates(buf, offsets)
        if len(start):
            taken = np.zeros(len(buf) + 1, np.int32)
            for s, _, e in base:
                taken[s] += 1
                taken[e] -= 1
            taken = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
            codes, which = windows(buf, offsets, start, end)
            best = np.zeros(len(start))
            _, one, again = np.unique(codes.astype(np.uint8).view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)  # equal windows are scored once
            np.maximum.at(best, which, net.score(codes[one])[again])
            new = (best >= net.threshold) & (taken[end] == taken[start])
            spans = sorted(base + [(s, 3, e) for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        else:
            spans = base
        points = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
        n = len(column)
        counts, named = np.zeros((4, n), np.int64), [[] for _ in range(n)]
        for s, k, e in spans:
            d = int(np.searchsorted(offsets, s, "right")) - 1
            counts[k, d] += 1
            named[d].append((s, k, e))
        digests, texts, redacted = [], [], []
        for d, own in enumerate(named):
            a, b = int(offsets[d]), int(offsets[d + 1])
            text = [(k, f"{KINDS[k]}:{points[s] - points[a]}:{points[e] - points[a]}") for s, k, e in own]
            digests.append(hashlib.sha256(",".join(t for k, t in text if k < 3).encode()).hexdigest())
            texts.append(",".join(t for _, t in text))
            parts, where = [], a
            for s, _, e in own:
                if s >= where:
                    parts += [buf[where:s].tobytes(), b"<secret>"]
                where = max(where, e)
            redacted.append(b"".join([*parts, buf[where:b].tobytes()]).decode() if own else None)
        return [*counts, digests, texts, redacted]

    rows = docs.withColumn("__text", F.col(text_col))
    out = X.by_text(rows, "__text", RESULT, lambda: find)  # a text without spans stays in the JVM
    return out.withColumn("redacted", F.coalesce("redacted", "__text", F.lit(""))).drop("__text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, learn(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model")
