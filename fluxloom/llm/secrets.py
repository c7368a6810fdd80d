"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

**Base.** Three kinds of patterns (below), leftmost and non-overlapping per kind. Their spans always stay.

**Candidates.** Runs of ``MIN_CANDIDATE`` or more key characters that hold a digit, wherever no base span lies. The
network reads the whole candidate with ``CONTEXT`` characters on both sides.

**Network.** Characters are embedded beside a mark for candidate or context, convolved, and pooled over places by
their maximum and (inside the candidate) their mean; a dense layer gives the log-odds. It is plain numpy, forward and
backward, with seeded weights.

**Training.** Labelled findings come from the corpus itself: base findings are secrets, other candidates are not, and every
distinct one is used. They are dealt into shards of about ``SHARD_ROWS`` by ranges of a hash of their window; a task trains on one
shard for an epoch, and the mean of the shards' weights, by their numbers of windows, begins the next. A label with
``FEW`` findings or fewer is given whole to every shard. A single shard trains through all epochs at once. The driver
sees a state (some 50 KB) and a few counts and sums a shard, never findings. A finding of kind ``assign`` is its value, with the keyword as left context, as a
candidate looks. Half of the positives have their left context blanked, so that the shape of a value
counts without its keyword. A quarter of each label's findings is held out: there the log-odds are calibrated by logistic
regression, secrets with their left context and without it. The threshold is the highest one that finds ``RECALL`` of those
bare values that have the form of a candidate (of all held-out values if none has), whatever it is; between it and the next lower
score of another candidate it takes the middle. ``Network.recall``, ``precision`` and ``n_held`` (secrets, others) tell what it
comes to there. Without both labels there is no model and the base spans are the result.

Defined cases: a null text is empty; long texts and candidates are read whole; repeated rows give equal rows; an empty
table gives an empty result; carried columns travel in one struct.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm.text import whole
from fluxloom.operators.order_stats import value_at_rank
from fluxloom.storage import store

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEXADECIMAL = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
MIN_VALUE = 6
MIN_ACCESS = 20
MIN_CANDIDATE = 12
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])[A-Za-z0-9+/_=.-]{12,}")
DIGIT = re.compile(r"[0-9]")
KINDS = ("assign", "access", "hex", "model")
RESULT = ("n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans")

CONTEXT = 20
SHARD_ROWS = 4096  # findings that a task trains on
FEW = 1000
RECALL = 0.98
SYMBOLS = 98  # 95 printable ASCII characters, white space, others, padding
EMBED, FILTERS, WIDTH = 8, 24, 5
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.01, 5
STEPS = 300  # at least, so that few findings are learnt too
LONG = 4096

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, in order of start, then of kinds."""
    spans: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEXADECIMAL.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def value_of(text: str, span: Span) -> tuple[int, int]:
    """Where the secret itself stands in a base span: the value of an assignment, else all of it."""
    start, end, kind = span
    return ASSIGN.match(text, start, end).span(1) if kind == "assign" else (start, end)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of key characters with a digit that touch no base span."""
    if not DIGIT.search(text):
        return []
    found, k, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach, k = max(reach, base[k][1]), k + 1
        if reach <= m.start():
            found.append((m.start(), m.end()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def _codes(window_: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol per character and 1 where the candidate is; the context is padded to its full width."""
    left, value, right = window_
    text = left.rjust(CONTEXT, "\0") + value + right.ljust(CONTEXT, "\0")
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    codes = np.where((points > 32) & (points < 127), points - 32, np.where((points <= 32) & (points > 0), 0, 96))
    codes[points == 0] = SYMBOLS - 1
    inside = np.zeros(len(codes))
    inside[CONTEXT : CONTEXT + len(value)] = 1
    return codes, inside


@dataclass
class Network:
    """Weights, calibration (slope, shift), threshold, and how it does on the held-out findings."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    recall: float = 0.0
    precision: float = 0.0
    n_held: tuple[int, int] = (0, 0)

    def _forward(self, codes: np.ndarray, inside: np.ndarray):
        w = self.weights
        x = np.concatenate([w["embed"][codes], inside[..., None]], axis=2)
        n, length, depth = x.shape
        patches = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, WIDTH * depth)
        active = np.maximum(patches @ w["filters"] + w["bias"], 0)
        middle = inside[:, WIDTH // 2 : length - WIDTH // 2, None]
        where = active.argmax(axis=1)
        pooled = np.concatenate([
            active.max(axis=1), (active * middle).sum(axis=1) / np.maximum(middle.sum(axis=1), 1)], axis=1)
        return pooled @ w["out"] + w["out_bias"], (codes, inside, patches, active, middle, where, pooled)

    def log_odds(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """Windows of one length go through together; a very long one alone."""
        out = np.zeros(len(windows))
        by_length: dict[int, list[int]] = {}
        coded = [_codes(x) for x in windows]
        for i, (codes, _) in enumerate(coded):
            by_length.setdefault(len(codes), []).append(i)
        for length, places in by_length.items():
            step = max(1, LONG // length)
            for at in range(0, len(places), step):
                some = places[at : at + step]
                out[some] = self._forward(np.stack([coded[i][0] for i in some]), np.stack([coded[i][1] for i in some]))[0]
        return out

    def probability(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(windows) + self.shift, -30, 30)))

    def gradients(self, codes, inside, labels):
        logit, (codes, inside, patches, active, middle, where, pooled) = self._forward(codes, inside)
        w, n = self.weights, len(labels)
        delta = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / n
        back = np.outer(delta, w["out"])
        d_active = back[:, None, FILTERS:] * middle / np.maximum(middle.sum(axis=1), 1)[:, None]
        rows, columns = np.indices(where.shape)
        d_active[rows, where, columns] += back[:, :FILTERS]
        d_active *= active > 0
        flat = d_active.reshape(-1, FILTERS)
        d_patches = (flat @ w["filters"].T).reshape(n, -1, WIDTH, EMBED + 1)
        d_embed = np.zeros_like(w["embed"])
        for k in range(WIDTH):
            at = codes[:, k : k + d_patches.shape[1]].ravel()
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(at, d_patches[:, :, k, e].ravel(), SYMBOLS)
        return {"embed": d_embed, "filters": patches.reshape(-1, patches.shape[2]).T @ flat, "bias": flat.sum(axis=0),
                "out": pooled.T @ delta, "out_bias": np.array(delta.sum())}


def _fresh(rng: np.random.Generator) -> Network:
    depth = WIDTH * (EMBED + 1)
    return Network({
        "embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "filters": rng.normal(0, depth**-0.5, (depth, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.2, 2 * FILTERS), "out_bias": np.array(0.0)})


Finding = tuple[int, str, str, str]


def _order(finding: Finding) -> int:
    return xxhash.xxh64_intdigest("\0".join(finding[1:]).encode(), 1)


def _parts(rows: list[Finding], number: dict[int, int], before: dict[int, int]) -> tuple[list[Finding], list[Finding]]:
    """(held out, used): every fourth finding of a label by hash, where ``before`` come earlier of the ``number`` of it."""
    place, held, used = dict(before), [], []
    for r in sorted(rows, key=lambda r: (_order(r), r)):
        (held if place[r[0]] % 4 == min(3, number[r[0]] - 1) else used).append(r)
        place[r[0]] += 1
    return held, used


@dataclass
class _State:
    """Weights, Adam's moments and steps, and the number of windows they come from."""

    weights: dict[str, np.ndarray]
    moment: dict[str, list[np.ndarray]]
    step: int = 0
    windows: int = 0


def _begin(seed: int) -> _State:
    weights = _fresh(np.random.default_rng(seed)).weights
    return _State(weights, {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in weights.items()})


def _mean(states: list[_State]) -> _State:
    """Mean by numbers of windows, added up in the given order."""
    if len(states) == 1:
        return states[0]
    total = sum(s.windows for s in states)
    share = [s.windows / total for s in states]
    names = states[0].weights
    return _State(
        {k: sum(f * s.weights[k] for f, s in zip(share, states)) for k in names},
        {k: [sum(f * s.moment[k][i] for f, s in zip(share, states)) for i in (0, 1)] for k in names},
        max(s.step for s in states), total)


def _learn(state: _State, used: list[Finding], shard: int = 0, turn: int | None = None, seed: int = SEED) -> _State:
    """The state after all epochs over ``used``, or after the one numbered ``turn``."""
    rng = np.random.default_rng((seed, shard) if shard else seed)
    network = _fresh(rng)
    network.weights = dict(state.weights)
    windows = [r[1:] for r in used] + [("", r[2], r[3]) for i, r in enumerate(used) if r[0] == 1 and i % 2]
    if not windows:
        return _State(state.weights, state.moment, state.step)
    labels = np.array([r[0] for r in used] + [1] * (len(windows) - len(used)), float)
    coded = [_codes(x) for x in windows]
    moment = {k: list(v) for k, v in state.moment.items()}
    step = state.step
    for epoch in range(max(EPOCHS, -(-STEPS * BATCH // len(windows))) if turn is None else turn + 1):
        order = rng.permutation(len(windows))
        if turn is not None and epoch < turn:
            continue
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            length = max(len(coded[i][0]) for i in some)
            codes = np.full((len(some), length), SYMBOLS - 1)
            inside = np.zeros((len(some), length))
            for row, i in enumerate(some):
                codes[row, : len(coded[i][0])], inside[row, : len(coded[i][1])] = coded[i]
            step += 1
            for k, g in network.gradients(codes, inside, labels[some]).items():
                m, v = moment[k]
                moment[k] = [0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g]
                network.weights[k] = network.weights[k] - RATE * (moment[k][0] / (1 - 0.9**step)) / (
                    np.sqrt(moment[k][1] / (1 - 0.999**step)) + 1e-8)
    return _State(network.weights, moment, step, len(windows))


def _held_scores(network: Network, held: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of held-out findings and of the bare values among them, and what each is: 0 another candidate, 1 a secret,
    2 a bare value, 3 one with the form of a candidate."""
    bare = [("", r[2], r[3]) for r in held if r[0] == 1]
    kinds = [r[0] for r in held] + [3 if CANDIDATE.fullmatch(w[1]) else 2 for w in bare]
    return network.log_odds([r[1:] for r in held] + bare), np.array(kinds, np.int64)


def _newton_sums(raw: np.ndarray, kinds: np.ndarray, a: float, b: float) -> tuple[float, ...]:
    """What a Newton step of the logistic regression needs of these scores."""
    labels = (kinds > 0).astype(float)
    p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    v = p * (1 - p) + 1e-6
    return tuple(float(x.sum()) for x in ((p - labels) * raw, p - labels, v * raw * raw, v * raw, v))


def _calibration(sums_at) -> tuple[float, float]:
    """Slope and shift by Newton steps of a lightly held-back logistic regression; ``sums_at(a, b)`` adds up all scores."""
    a, b = 1.0, 0.0
    for _ in range(30):
        ga, gb, aa, ab, bb = sums_at(a, b)
        step = np.linalg.solve(np.array([[aa + 1e-2, ab], [ab, bb + 1e-2]]), np.array([ga + 1e-2 * (a - 1), gb + 1e-2 * b]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-12:
            break
    return max(float(a), 1e-3), float(b)


def _chances(raw: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))


def train(rows: list[Finding], recall: float = RECALL, seed: int = SEED) -> Network | None:
    """A network from labelled windows (label, left, value, right); None without both labels in both parts."""
    rows = list(set(rows))
    number = {n: sum(r[0] == n for r in rows) for n in (0, 1)}
    if min(number.values()) < 2:
        return None
    held, used = _parts(rows, number, {0: 0, 1: 0})
    network = Network(_learn(_begin(seed), used, seed=seed).weights)
    raw, kinds = _held_scores(network, held)
    network.slope, network.shift = _calibration(lambda a, b: _newton_sums(raw, kinds, a, b))
    scores = _chances(raw, network.slope, network.shift)
    asked = np.sort(scores[kinds == 3] if (kinds == 3).any() else scores[kinds == 2])
    others = scores[kinds == 0]
    highest = float(asked[int((1 - recall) * len(asked))])
    network.threshold = (highest + float(others[others < highest].max(initial=0.0))) / 2
    found, wrong = int((asked >= network.threshold).sum()), int((others >= network.threshold).sum())
    network.recall, network.precision, network.n_held = found / len(asked), found / (found + wrong), (len(asked), len(others))
    return network


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(label, left, value, right, order) of every base finding and every other candidate."""
    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                found += [(1, *window(text, *value_of(text, span))) for span in base]
                found += [(0, *window(text, s, e)) for s, e in candidates(text, base)]
            order = [xxhash.xxh64_intdigest("\0".join(x[1:]).encode()) >> 1 for x in found]
            columns = list(zip(*found)) or [[], [], [], []]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)] + [pa.array(order, pa.int64())],
                names=["label", "left", "value", "right", "place"])

    return docs.select(whole(docs["text"]).alias("t")).mapInArrow(
        run, "label int, left string, value string, right string, place long")


def _dealt(found: DataFrame, number: dict[int, int], shards: int) -> DataFrame:
    """Findings with their shard, a range of their hash; a label of ``FEW`` goes to all shards, and is its ``own`` in one."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = _order(r) * shards >> 64
                rows += [(k, k == own, *r) for k in (range(shards) if number[r[0]] <= FEW else (own,))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["shard", "own", "label", "left", "value", "right"])

    dealt = found.select("label", "left", "value", "right").mapInArrow(
        run, "shard int, own boolean, label int, left string, value string, right string")
    return store(dealt, "secret-shards")


def fit(docs: DataFrame, per_label: int | None = None, recall: float = RECALL, shard_rows: int = SHARD_ROWS) -> Network | None:
    """Train on all distinct findings, shard by shard; one that is repeated counts once.

    With ``per_label`` only that many findings of each label are used, the first by hash.
    """
    found = store(labelled_findings(docs).distinct(), "secret-findings")
    if per_label is not None:
        first = [found.where(F.col("label") == n).orderBy("place", "left", "value", "right").limit(per_label) for n in (0, 1)]
        found = store(first[0].unionByName(first[1]), "secret-sample")
    number = {0: 0, 1: 0} | {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    if min(number.values()) < 2:
        return None
    shards = -(-sum(number.values()) // shard_rows)
    rows = _dealt(found, number, shards)
    sizes = rows.where("own").groupBy("label", "shard").count().collect()
    before = {k: {n: 0 if number[n] <= FEW else sum(r["count"] for r in sizes if r["label"] == n and r["shard"] < k) for n in number}
              for k in range(shards)}

    def parted(part: pa.Table) -> tuple[int, set[Finding], list[Finding], list[Finding]]:
        shard, lines = part.column("shard")[0].as_py(), list(zip(*(part.column(c).to_pylist() for c in ("label", "left", "value", "right"))))
        own = {r for r, mine in zip(lines, part.column("own").to_pylist()) if mine}
        held, used = _parts(lines, number, before[shard])
        return shard, own, held, used

    def learning(state: _State, turn: int | None):
        def run(part):
            shard, _, _, used = parted(part)
            return pa.table({"shard": pa.array([shard], pa.int32()), "state": pa.array([pickle.dumps(_learn(state, used, shard, turn))], pa.binary())})

        return run

    state, turns = _begin(SEED), [None] if shards == 1 else range(max(EPOCHS, -(-4 * STEPS * BATCH // (3 * shard_rows))))
    for turn in turns:
        made = rows.groupBy("shard").applyInArrow(learning(state, turn), "shard int, state binary").collect()
        state = _mean([pickle.loads(r["state"]) for r in sorted(made, key=lambda r: r["shard"])])
    network = Network(state.weights)

    def score(part):
        shard, own, held, _ = parted(part)
        raw, kinds = _held_scores(network, [r for r in held if r in own])
        return pa.table({"shard": pa.array([shard], pa.int32()), "raw": pa.array([raw], pa.list_(pa.float64())), "kind": pa.array([kinds], pa.list_(pa.int64()))})

    scores = store(rows.groupBy("shard").applyInArrow(score, "shard int, raw array<double>, kind array<long>"), "secret-scores")

    def shard_scores(batches):
        for batch in batches:
            for shard, raw, kinds in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield shard, np.array(raw, float), np.array(kinds, np.int64)

    def sums_at(a: float, b: float) -> list[float]:
        def run(batches):
            for shard, raw, kinds in shard_scores(batches):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "sums": pa.array([_newton_sums(raw, kinds, a, b)], pa.list_(pa.float64()))})

        parts = sorted(scores.mapInArrow(run, "shard int, sums array<double>").collect(), key=lambda r: r["shard"])
        return [sum(x) for x in zip(*(r["sums"] for r in parts))]

    slope, shift = _calibration(sums_at)
    network.slope, network.shift = slope, shift

    def chances(batches):
        for _, raw, kinds in shard_scores(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_chances(raw, slope, shift)), pa.array(kinds)], names=["v", "kind"])

    _cut(network, store(scores.mapInArrow(chances, "v double, kind long"), "secret-chances"), recall)
    return network


def _cut(network: Network, chances: DataFrame, recall: float) -> None:
    """Threshold and figures from the held-out probabilities (``v``, ``kind``)."""
    formed = chances.where("kind = 3").limit(1).count()
    asked = chances.where("kind = 3" if formed else "kind >= 2").select(F.lit(0).alias("all"), "v")
    found = value_at_rank(asked, ["all"], lambda n: F.array(F.floor(n * F.lit(1 - recall)).cast("long"))).first()
    highest, other = found["v"], F.col("kind") == 0
    lower = chances.where(other & (F.col("v") < highest)).agg(F.max("v")).first()[0]
    network.threshold = (highest + (lower or 0.0)) / 2
    hit, n = asked.agg(F.count_if(F.col("v") >= network.threshold), F.count(F.lit(1))).first()
    wrong, others = chances.where(other).agg(F.count_if(F.col("v") >= network.threshold), F.count(F.lit(1))).first()
    network.recall, network.precision, network.n_held = hit / n, hit / (hit + wrong), (n, others)


def spans_of(text: str, network: Network | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and model spans in order."""
    base = base_spans(text)
    places = candidates(text, base) if network else []
    if not places:
        return base, base
    scores = network.probability([window(text, s, e) for s, e in places])
    added = [(s, e, "model") for (s, e), p in zip(places, scores) if p >= network.threshold]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, carry: list[str], network: Network | None) -> DataFrame:
    """``row`` (the carried columns), counts per kind, the digest of the base spans, and all spans."""
    kept = T.StructField("row", T.StructType([T.StructField(c, docs.schema[c].dataType) for c in carry]))
    made = [T.StructField(c, T.LongType()) for c in RESULT[:4]]
    made += [T.StructField(c, T.StringType()) for c in RESULT[4:]]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = spans_of(text, network)
                n = [sum(s[2] == kind for s in spans) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) or [[]] * 6
            made_columns = [pa.array(list(c), pa.int64()) for c in columns[:4]] + [pa.array(list(c), pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made_columns], names=[f.name for f in [kept, *made]])

    chosen = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), whole(docs["text"]).alias("text"))
    return chosen.mapInArrow(run, T.StructType([kept, *made]))


def mask(text: str, spans: list[Span], by: str = "[secret]") -> str:
    """The text with every found stretch replaced; overlapping spans are one stretch."""
    out, at, open_until = [], 0, -1
    for start, end, _ in spans:
        if start >= max(open_until, at):
            out += [text[at:start], by]
            at = end
        at = max(at, end)
        open_until = max(open_until, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, network: Network | None) -> DataFrame:
    """The documents with their secrets masked; null texts stay null."""
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mask(t, spans_of(t, network)[1]) for t in texts.to_pylist()], pa.string())

    return docs.withColumn("text", run(docs["text"]))
