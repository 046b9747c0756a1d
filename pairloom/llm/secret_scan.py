"""Secret scans: base patterns, and a character convolutional network over every candidate.

The patterns label findings. Each is also shown with drawn bodies of another look, in its own
place and amid prose, so that neither its cue nor its shape is what the network learns; each
candidate that no pattern supports is also shown as a name, date or path made of the text's words. A
bounded sample of both classes trains the network; half of the training rows hide their context.
Scores are calibrated on rows that the training didn't see; each shape of candidate gets the highest
threshold that keeps the wanted share of all labelled findings, drawn ones included. Every candidate
of every whole text is then scored.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import bounded_batches, sliced, stored

#: The base patterns and their order in results.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
DIGIT, MIXED = re.compile("[0-9]"), re.compile("[a-z][A-Z]")
HEX_SHAPE = re.compile(r"[0-9a-fA-F]+")
#: What drawn bodies are made of, and their lengths.
PLAIN = string.digits + string.ascii_letters
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", PLAIN, PLAIN + "+/", PLAIN + "_-")
SHORTEST, LONGEST = 12, 44
#: Bodies drawn for a finding in its own place, and as many amid prose.
BODIES = 4
NAME = re.compile("[A-Za-z]{3,10}")

BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
SYMBOLS = 98
#: A small sample is passed over more often, to take so many steps.
STEPS = 500
#: Log-odds are counted from -LIMIT to LIMIT in steps.
LIMIT, PER_UNIT = 30, 100
STEPS_OF_ODDS = 2 * LIMIT * PER_UNIT


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order; kind is a place in KINDS."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that might be secrets: 8 or more characters with a digit or with a capital after a small letter, or 20 or more of any kind."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if len(run) >= 20 or DIGIT.search(run) or MIXED.search(run):
            found.append(m.span())
    return found


def looks_drawn(run: str) -> bool:
    """Whether a run of 12 or more characters has a digit, a letter, and turns from one kind of them to another at every fourth place."""
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in run if c.isalnum()]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return len(run) >= SHORTEST and "0" in kinds and len(set(kinds)) > 1 and 4 * turns >= len(kinds)


def drawn_body(draw: Random) -> str:
    """Random characters of one alphabet."""
    while True:
        body = "".join(draw.choices(draw.choice(ALPHABETS), k=draw.randint(SHORTEST, LONGEST)))
        if looks_drawn(body):
            return body


def plain_run(draw: Random, words: list[str]) -> str:
    """A run that is no secret: a name, a path, a date or a number with a word, of a text's own words."""
    a, b, c = draw.choices(words, k=3)
    n = draw.randint(0, 9999)
    return draw.choice([
        a.lower() + b.title() + c.title(), a.title() + b.title() + str(n), f"{a}_{b}_{n}", f"{a}-{b}-{c}-{n % 100}", f"{a}/{b}/{c}.html",
        f"{a}{n}.{b}.com", f"{a[:3]}{n % 10}.{b}.{c}.org", f"{a.upper()}-{n:05}", f"{1900 + n % 200}-{1 + n % 12:02}-{1 + n % 28:02}", f"{a.upper()}_{b.upper()}_{n % 10}", f"v{n % 10}.{n % 7}.{n}-{a}",
    ])


def placed(text: str, start: int, end: int, run: str) -> bytes:
    """The network's view of ``run`` in place of a stretch of ``text``."""
    before, after = text[max(0, start - BEFORE): start], text[end: end + AFTER]
    return windows(before + run + after, len(before), len(before) + len(run))[0]


def made_views(text: str, start: int, end: int, truth: int) -> list[tuple[str, bytes]]:
    """(run, view) of what is shown beside a finding (its secret is the stretch) or another candidate.

    What is drawn depends on the view of the stretch only, so equal ones have equal drawn ones
    amid equal texts.
    """
    draw = Random(windows(text, start, end)[0])
    blank = text.find(" ", draw.randrange(len(text)))
    at, then = blank + 1, max(blank, 0)
    if truth:
        places = [(start, end), (at, then)] * BODIES
        return [(body, placed(text, *place, body)) for place, body in zip(places, [drawn_body(draw) for _ in places])]
    words = NAME.findall(text, at, at + 200) or NAME.findall(text, 0, 200)
    run = plain_run(draw, words) if words else ""
    return [(run, placed(text, at, then, run))] if candidates(run) == [(0, len(run))] else []


def codes(text: str) -> np.ndarray:
    """Printable ASCII as 2 to 96, white space as 1, all else as 97; 0 pads."""
    raw = np.frombuffer(text.encode("ascii", "replace").replace(b"\x00", b"?"), np.uint8).astype(np.int16)
    out = raw - 31
    return np.where(raw <= 32, 1, np.where(raw > 126, SYMBOLS - 1, out + 1)).astype(np.uint8)


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The network's views of one candidate: its context and, part by part, all of it."""
    before = codes(text[max(0, start - BEFORE): start])
    after = codes(text[end: end + AFTER])
    out = []
    for at in range(start, end, INSIDE):
        row = np.zeros(WIDTH, np.uint8)
        inside = codes(text[at: min(at + INSIDE, end)])
        row[BEFORE - len(before): BEFORE] = before
        row[BEFORE: BEFORE + len(inside)] = inside
        row[BEFORE + INSIDE: BEFORE + INSIDE + len(after)] = after
        out.append(row.tobytes())
    return out


@dataclass
class CharacterCNN:
    """Embedding, one convolution, maximum over places, logistic output; then Platt's calibration."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (2.0, 2.0)

    REACH = 5

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        view = np.lib.stride_tricks.sliding_window_view(rows, self.REACH, axis=1)
        seen = self.embedding[view].reshape(len(rows), view.shape[1], -1)
        flat = seen @ self.filters + self.bias
        at = flat.argmax(1)
        return seen, at, np.maximum(np.take_along_axis(flat, at[:, None], 1)[:, 0], 0)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        parts = [self.pooled(rows[i: i + 512])[2] @ self.weight + self.offset for i in range(0, len(rows), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(rows) + self.shift, -30, 30)))


def train_cnn(rows: np.ndarray, truth: np.ndarray, epochs: int = 12, seed: int = 5) -> CharacterCNN:
    """Fits the network with Adam on three quarters of the rows and calibrates it on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) // 4)
    held, fit = order[:cut], order[cut:]
    size, kept = 8, 24
    net = CharacterCNN(
        rng.normal(0, 0.3, (SYMBOLS, size)), rng.normal(0, 0.2, (CharacterCNN.REACH * size, kept)),
        np.zeros(kept), rng.normal(0, 0.2, kept), 0.0,
    )
    params = [net.embedding, net.filters, net.bias, net.weight, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    balance = {1: 0.5 / max(1, truth[fit].sum()), 0: 0.5 / max(1, (1 - truth[fit]).sum())}
    for _ in range(max(epochs, STEPS * 64 // max(1, len(fit)))):
        rng.shuffle(fit)
        for i in range(0, len(fit), 64):
            batch = fit[i: i + 64]
            x, y = rows[batch].copy(), truth[batch]
            hidden = rng.random(len(x)) < 0.5
            x[hidden, :BEFORE] = 0
            x[hidden, BEFORE + INSIDE:] = 0
            seen, at, pool = net.pooled(x)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.weight + params[4][0], -30, 30)))
            g = (p - y) * np.where(y == 1, balance[1], balance[0]) * len(fit) / len(x)
            gpool = g[:, None] * net.weight * (pool > 0)
            best = np.take_along_axis(seen, at[:, :, None], 1)
            gfilters = np.einsum("nk,nkd->dk", gpool, best)
            gseen = np.einsum("nk,dk->nkd", gpool, net.filters)
            gembedding = np.zeros_like(net.embedding)
            places = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(net.REACH)]
            np.add.at(gembedding, places.ravel(), gseen.reshape(-1, size))
            step += 1
            for p_, (m, v), grad in zip(params, moments, [gembedding, gfilters, gpool.sum(0), pool.T @ g, np.array([g.sum()])]):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p_ -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.offset = float(params[4][0])
    logit, y = net.logits(rows[held]), truth[held]
    for _ in range(200):
        p = net.probability(rows[held]) if len(held) else np.zeros(0)
        # Platt's smoothed targets keep a separable sample from an infinite slope.
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        error = p - goal
        scale = max(1.0, float(np.abs(logit).max(initial=1)))
        net.slope = float(max(1e-3, net.slope - 0.5 / scale**2 * (error * logit).mean()))
        net.shift -= 0.5 * float(error.mean())
    return net


def threshold(right: np.ndarray, wrong: np.ndarray, recall: float, false: float) -> float:
    """The cut that keeps ``recall`` of the findings, or one midway to a lower cut that still takes the share ``false`` of other candidates at most.

    ``right`` and ``wrong`` count findings and others by steps of log-odds; the cut is a
    probability, and an even chance where a shape has no labelled finding.
    """
    if not right.sum():
        return 0.5
    cut = int(np.searchsorted(np.cumsum(right), (1 - recall) * right.sum(), "right"))
    if wrong.sum():
        above = np.cumsum(wrong[::-1])[::-1]
        low = int(np.argmax(np.append(above, 0) <= false * wrong.sum()))
        cut = min(cut, (cut + low) // 2)
    return float(1 / (1 + np.exp(LIMIT - cut / PER_UNIT)))


def with_thresholds(net: CharacterCNN, views: DataFrame, recall: float, false: float) -> CharacterCNN:
    """``net`` with the thresholds of each shape, from all labelled ``views`` (truth, hex, view, n)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, STEPS_OF_ODDS), np.int64)
        for batch in batches:
            seen = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, WIDTH)
            p = np.clip(net.probability(seen), 1e-12, 1 - 1e-12)
            step = np.clip((np.log(p / (1 - p)) + LIMIT) * PER_UNIT, 0, STEPS_OF_ODDS - 1).astype(int)
            np.add.at(counts, (batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(int), step), batch.column(3).to_numpy())
        truth, shape, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (truth, shape, step, counts[truth, shape, step])], names=["truth", "hex", "step", "n"])

    # At most 4 * STEPS_OF_ODDS rows come to the driver.
    rows = views.select("truth", "hex", "view", "n").mapInArrow(of, "truth long, hex long, step long, n long")
    counts = np.zeros((2, 2, STEPS_OF_ODDS), np.int64)
    for r in rows.groupBy("truth", "hex", "step").agg(F.sum("n").alias("n")).collect():
        counts[r["truth"], r["hex"], r["step"]] = r["n"]
    net.thresholds = tuple(threshold(counts[1, shape], counts[0, shape], recall, false) for shape in (0, 1))
    return net


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of ``spans``, in order."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def overlaps(union: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether the stretch touches a part of the union."""
    at = bisect_right(union[1], start)
    return at < len(union[0]) and union[0][at] < end


def covers(union: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether one part of the union holds the whole stretch."""
    at = bisect_right(union[0], start) - 1
    return at >= 0 and union[1][at] >= end


def labelled(docs: DataFrame) -> DataFrame:
    """(order, truth, hex, view) of every finding and every unsupported candidate of ``docs``, and of what is made of each.

    Candidates that look drawn are left out: that no pattern supports them doesn't show that they are no secrets.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            orders, truths, shapes, views = [], [], [], []
            for text in batch.column(0).to_pylist():
                text = text or ""
                base = base_spans(text)
                union = merged(base)
                rows = [(s, e, 1) for s, _, e in base]
                rows += [(s, e, 0) for s, e in candidates(text) if not overlaps(union, s, e) and not looks_drawn(text[s:e])]
                for start, end, truth in rows:
                    if truth and (m := ASSIGN.match(text, start)):
                        start = m.start(2)
                    for run, view in [(text[start:end], windows(text, start, end)[0]), *made_views(text, start, end, truth)]:
                        orders.append(hashlib.blake2b(view, digest_size=8).hexdigest())
                        truths.append(truth)
                        shapes.append(bool(HEX_SHAPE.fullmatch(run)))
                        views.append(view)
            yield pa.RecordBatch.from_arrays(
                [pa.array(orders, pa.string()), pa.array(truths, pa.int32()), pa.array(shapes, pa.bool_()), pa.array(views, pa.binary())],
                ["order", "truth", "hex", "view"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInArrow(of, "order string, truth int, hex boolean, view binary")


def fit_secret_model(docs: DataFrame, sample: int = 3000, recall: float = 0.95, false: float = 0.002) -> CharacterCNN | None:
    """The network, or None where findings or other candidates are wanting.

    ``sample`` bounds the labelled rows of either class that are fetched: those of the
    smallest hash of what the network sees, once each, so the choice depends on no order
    of rows. ``recall`` is the share of all labelled findings that the thresholds keep at
    least; they are lower where the share ``false`` of other candidates leaves room.
    """
    same = labelled(docs).groupBy("order", "truth").agg(F.min("hex").alias("hex"), F.min("view").alias("view"), F.count("*").alias("n"))
    views = stored(same, "secret-views")
    fetched = [views.where(F.col("truth") == y).orderBy("order").limit(sample) for y in (0, 1)]
    rows = fetched[0].union(fetched[1]).collect()
    truth = np.array([r["truth"] for r in rows], float)
    if not len(truth) or truth.min() == truth.max():
        return None
    seen = np.frombuffer(b"".join(bytes(r["view"]) for r in rows), np.uint8).reshape(-1, WIDTH)
    return with_thresholds(train_cnn(seen, truth), views, recall, false)


def all_spans(texts: list[str], net: CharacterCNN | None) -> Iterator[tuple[list, list]]:
    """Of each text, the base spans and the spans that the network adds."""
    bases = [base_spans(text) for text in texts]
    if net is None:
        yield from ((base, []) for base in bases)
        return
    owner, places, shapes, views = [], [], [], []
    for n, text in enumerate(texts):
        union = merged(bases[n])
        for start, end in candidates(text):
            if not covers(union, start, end):
                for view in windows(text, start, end):
                    owner.append(n)
                    places.append((start, end))
                    shapes.append(bool(HEX_SHAPE.fullmatch(text, start, end)))
                    views.append(view)
    each = dict.fromkeys(views)
    seen = np.frombuffer(b"".join(each), np.uint8).reshape(-1, WIDTH)
    each = dict(zip(each, net.probability(seen).tolist()))
    taken = np.array([each[v] for v in views]) >= np.where(np.array(shapes, bool), net.thresholds[1], net.thresholds[0])
    added: list[set] = [set() for _ in texts]
    for i in np.flatnonzero(taken):
        added[owner[i]].add((places[i][0], 3, places[i][1]))
    yield from ((base, sorted(more)) for base, more in zip(bases, added))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])


def on_texts(docs: DataFrame, schema: str, of: Callable[[pa.RecordBatch], list]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            columns = of(part)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    bounded_batches(docs.sparkSession)
    # By number, as Spark can't look up names with a dot there.
    return docs.toDF(*[f"c{n}" for n in range(len(docs.columns))]).mapInArrow(run, schema)


def secret_spans(docs: DataFrame, net: CharacterCNN | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model) of each row.

    Spans are ``kind:start:end`` in code points, by start and then kind. A null text is
    empty and has none; a candidate that lies within base spans isn't added again, one that
    goes beyond them is scored as a whole. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """

    def of(part: pa.RecordBatch) -> dict[str, pa.Array]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model")}
        for base, more in all_spans([x or "" for x in part.column(1).to_pylist()], net):
            for n, kind in enumerate(("n_assign", "n_access", "n_hex")):
                out[kind].append(sum(k == n for _, k, _ in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + more)))
            out["n_model"].append(len(more))
        kinds = {k: pa.string() if k in ("base_sha256", "spans") else pa.int64() for k in out}
        return {"doc_id": part.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items()}

    return on_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long", of,
    )


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind.

    A span grows to the ends of the runs that it begins and ends in, so that no rest of a secret stays;
    spans that overlap or touch become one, of the first one's kind.
    """
    out, at = [], 0
    runs = [m.span() for m in RUN.finditer(text)] if spans else []
    begins = [b for b, _ in runs]

    def run_of(place: int) -> tuple[int, int]:
        n = bisect_right(begins, place) - 1
        return runs[n] if n >= 0 and place < runs[n][1] else (place, place + 1)

    for start, kind, end in spans:
        start, end = (start if KINDS[kind] == "assign" else run_of(start)[0]), max(end, run_of(end - 1)[1])
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, net: CharacterCNN | None) -> DataFrame:
    """``docs`` with every span of its texts, and what else its run has, replaced by ``[kind]``, and n_chars counted anew.

    A null text stays null and keeps its n_chars; every other column passes unchanged.
    """
    names = docs.columns

    def of(part: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = part.column(names.index("text")).to_pylist()
        new = [
            None if text is None else redacted(text, sorted(base + more))
            for text, (base, more) in zip(texts, all_spans([x or "" for x in texts], net))
        ]
        out = dict(zip(names, part.columns))
        if "n_chars" in out:
            old = out["n_chars"].to_pylist()
            out["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(new, old)], out["n_chars"].type)
        return out | {"text": pa.array(new, part.column(names.index("text")).type)}

    return on_texts(docs, docs.schema, of)
