"""A gated recurrent language model in numpy, trained and run on executors.

Output is class-factored: P(token) = P(class | state) P(token | class, state).
The most frequent words (the head) are in classes of their own frequency band,
where a second softmax picks the word. All other tokens are in classes by their
last two characters; inside one, a token has its share of the class's training
count, with half a count for each type and for an unknown one, so every token has
a proper probability, however rare."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import release_shuffles, stored, text_batches

HEAD_CLASSES, CLASS_SIZE, TAIL_CLASSES = 16, 64, 24
HEAD, CLASSES, STATE, STEPS = HEAD_CLASSES * CLASS_SIZE, HEAD_CLASSES + TAIL_CLASSES, 24, 32
INPUTS = HEAD + TAIL_CLASSES + 1
END = b" "  # no word holds a blank
LN10 = math.log(10)


def tail_class(token: bytes) -> int:
    return zlib.crc32(token.decode()[-2:].encode()) % TAIL_CLASSES


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@dataclass
class Vocabulary:
    """What of the counts is broadcast, of fixed size: head words, counts of
    the most frequent types, totals by class."""

    head: list[bytes]  # most frequent first; at most HEAD
    counts: dict[bytes, int]  # of the most frequent types, head included
    total: int
    types: int
    class_count: np.ndarray  # training tokens in each tail class
    class_types: np.ndarray

    def cells(self) -> np.ndarray:
        """log of each head word's count, HEAD_CLASSES x CLASS_SIZE; -inf where
        there is none. Word i is in class i // CLASS_SIZE."""
        c = np.full(HEAD, -np.inf)
        c[: len(self.head)] = [math.log(self.counts[w] + 0.5) for w in self.head]
        return c.reshape(HEAD_CLASSES, CLASS_SIZE)

    def class_mass(self) -> np.ndarray:
        own = np.exp(self.cells()).sum(1)
        return np.concatenate([own, self.class_count + 0.5 * (self.class_types + 1)])


SHAPES = {  # gates: reset, update, candidate state; the last row of cw and of each ww is the bias
    "x": (3, INPUTS, STATE), "h": (3, STATE, STATE), "b": (3, STATE),
    "cw": (STATE + 1, CLASSES), "ww": (HEAD_CLASSES, STATE + 1, CLASS_SIZE),
}


def initial(vocab: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; output biases are the unigram distribution's."""
    rng = np.random.default_rng(seed)

    def drawn(*shape, by=0.2):
        return (rng.standard_normal(shape) * by).astype(np.float32)

    x, h = drawn(INPUTS, 3, STATE, by=0.3), drawn(STATE, 3, STATE)
    drawn(3 * STATE)
    p = {k: np.ascontiguousarray(v.transpose(1, 0, 2)) for k, v in (("x", x), ("h", h))} | {"b": np.zeros(SHAPES["b"], np.float32)}
    cw = drawn(STATE, CLASSES)
    drawn(CLASSES)
    ww = drawn(HEAD_CLASSES, STATE, CLASS_SIZE)
    mass, cells = vocab.class_mass(), vocab.cells()
    cb = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum()), -30)
    with np.errstate(invalid="ignore"):
        norm = cells - np.where(mass[:HEAD_CLASSES] > 0, np.log(np.maximum(mass[:HEAD_CLASSES], 1e-9)), 0)[:, None]
    wb = np.where(np.isfinite(cells), norm, -30)
    p["cw"] = np.concatenate([cw * 0.1, cb[None]]).astype(np.float32)
    p["ww"] = np.concatenate([ww * 0.1, wb[:, None]], 1).astype(np.float32)
    return p


def pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpack(v: np.ndarray) -> dict:
    """Views of v where it is float32 already."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = v[at : at + n].reshape(s).astype(np.float32, copy=False)
        at += n
    return out


def recur(p: dict, ids: np.ndarray, h: np.ndarray, keep: list | None = None):
    """States before each of the tokens ids (T, B), and after the last: two views
    of one array. Each gate's values lie together, so that no step of the loop goes
    through memory in strides."""
    t_len, kind = len(ids), p["h"].dtype
    states = np.empty((t_len + 1, *h.shape), kind)
    states[0] = h
    inputs = p["x"] + p["b"][:, None]
    np.negative(inputs[:2], out=inputs[:2])  # the gates are 1 / (1 + exp(-x))
    inputs, to_r, to_z, state = np.take(inputs, ids, axis=1), -p["h"][0], -p["h"][1], p["h"][2]
    n = 1 if keep is None else t_len
    over, reset, fresh = np.empty((n, 2, *h.shape), kind), np.empty((n, *h.shape), kind), np.empty((n, *h.shape), kind)
    places = zip(over, reset, fresh, strict=True) if keep is not None else repeat((over[0], reset[0], fresh[0]))
    for h, after, in_gates, in_state, (rz, rh, c) in zip(states, states[1:], inputs[:2].swapaxes(0, 1), inputs[2], places, strict=False):
        r, z = rz
        h.dot(to_r, r)
        h.dot(to_z, z)
        rz += in_gates
        np.exp(rz, out=rz)
        rz += 1
        np.divide(h, r, out=rh)
        rh.dot(state, c)
        c += in_state
        np.tanh(c, out=c)
        np.subtract(c, h, out=after)
        after /= z
        after += h
    if keep is not None:
        keep += np.reciprocal(over, out=over), reset, fresh
    return states[:-1], states[-1]


#: The class of each of the network's inputs.
CLASS_OF = np.concatenate([np.arange(HEAD) // CLASS_SIZE, np.arange(TAIL_CLASSES + 1) + HEAD_CLASSES]).astype(np.uint8)


def by_class(ids: np.ndarray):
    """An order of ids by class (few values: a radix sort), the ids and classes in
    that order, and where head classes with tokens begin and end."""
    k = CLASS_OF[ids]
    order = np.argsort(k, kind="stable")
    k = k[order]
    bounds = np.searchsorted(k, np.arange(HEAD_CLASSES + 1, dtype=np.uint8)).tolist()
    return order, ids[order], k, [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]


def with_one(states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows `at` of states, with a one behind each for the biases."""
    out = np.empty((len(at), STATE + 1), states.dtype)
    out[:, :STATE] = states[at]
    out[:, STATE] = 1
    return out


def outputs(p: dict, states: np.ndarray, ids: np.ndarray, k: np.ndarray, spans: list):
    """Of states and the ids after them, by class: logits over classes, and those
    over words for the tokens of head classes, as _exps gives them."""
    m = spans[-1][2] if spans else 0
    words = np.empty((m, CLASS_SIZE), states.dtype)
    for c, a, b in spans:
        np.matmul(states[a:b], p["ww"][c], out=words[a:b])
    return _exps(states @ p["cw"], k), _exps(words, ids[:m] % CLASS_SIZE)


def _exps(x: np.ndarray, k: np.ndarray):
    """exp of x in place, the sums of its rows, where its column k is in each row of
    x.ravel(), and what x was there. Rows are shifted by their maxima only where one
    might leave float32's range."""
    own = np.arange(0, x.size, x.shape[1]) + k
    at = x.ravel()[own]
    if len(k) and not (x.max() < 60 and at.min() > -60):
        top = x.max(-1, keepdims=True)
        x -= top
        at -= top[:, 0]
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), own, at


def token_logs(p: dict, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """ln P of each token (of its class alone for tail tokens), given flat
    states (N, STATE) and ids (N)."""
    order, ids, k, spans = by_class(ids)
    (_, total, _, at), (_, words, _, word) = outputs(p, with_one(states, order), ids, k, spans)
    logs = (at - np.log(total)).astype(np.float64)
    logs[: len(word)] += word - np.log(words)
    out = np.empty(len(ids))
    out[order] = logs
    return out


def gradients(p: dict, ids: np.ndarray, goal: np.ndarray, mask: np.ndarray, h0: np.ndarray, g: dict | None = None):
    """Of the mean negative log-likelihood over one window (truncated
    backpropagation), into g: ids (T, B) are inputs, goal (T, B) the tokens after them."""
    t_len, b = ids.shape
    s, kind, kept = STATE, p["h"].dtype, []
    g = {k: np.empty_like(x) for k, x in p.items()} if g is None else g
    before, last = recur(p, ids, h0, kept)
    live = np.flatnonzero(mask.ravel() > 0)
    n = max(1, len(live))
    order, want, k, spans = by_class(goal.ravel()[live])
    live = live[order]
    flat = with_one(before.base.reshape(-1, s), live + b)  # after a token: a row of lanes on
    (prob, total, own, _), (word, words, own_word, _) = outputs(p, flat, want, k, spans)
    prob *= (1 / (n * total))[:, None]
    prob.ravel()[own] -= 1 / n
    word *= (1 / (n * words))[:, None]
    word.ravel()[own_word] -= 1 / n
    np.matmul(flat.T, prob, out=g["cw"])
    d_flat = prob @ p["cw"][:s].T
    g["ww"][:] = 0
    for c, a, e in spans:
        np.matmul(flat[a:e].T, word[a:e], out=g["ww"][c])
        d_flat[a:e] += word[a:e] @ p["ww"][c, :s].T
    d_after = np.zeros((t_len * b, s), kind)
    d_after[live] = d_flat
    d_after = d_after.reshape(t_len, b, s)
    gated, reset, c = kept
    r, z = gated[:, 0], gated[:, 1]
    # what the loop multiplies by, for all steps at once
    still = 1 - z
    to_c, to_z, to_r = z * (1 - c * c), (c - before) * z * still, before * r * (1 - r)
    back_r, back_z, back_c = np.ascontiguousarray(p["h"].transpose(0, 2, 1))
    d_in, dh, part = np.empty((3, t_len, b, s), kind), np.zeros((b, s), kind), np.empty((b, s), kind)
    steps = zip(*(x[::-1] for x in (d_after, *d_in, to_r, to_z, to_c, r, still)), strict=True)
    for own, dr, dz, dc, by_r, by_z, by_c, reset_by, stay in steps:
        dh += own
        np.multiply(dh, by_z, out=dz)
        np.multiply(dh, by_c, out=dc)
        dh *= stay
        dc.dot(back_c, part)
        np.multiply(part, by_r, out=dr)
        part *= reset_by
        dh += part
        dh += dr.dot(back_r, part)
        dh += dz.dot(back_z, part)
    rows = d_in.reshape(3, -1, s)
    np.matmul(np.ones(t_len * b, kind), rows, out=g["b"])
    np.matmul(before.reshape(-1, s).T, rows[:2], out=g["h"][:2])
    np.matmul(reset.reshape(-1, s).T, rows[2], out=g["h"][2])
    flat_ids = ids.ravel()
    order = np.argsort(flat_ids.astype(np.int16), kind="stable")  # 16 bits: a radix sort
    kinds = flat_ids[order]
    first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    g["x"][:] = 0
    # two numbers at a time, as one complex number: the sums are the same
    pairs = np.take(rows, order, axis=1).view(f"c{2 * rows.itemsize}")
    g["x"][:, kinds[first]] = np.add.reduceat(pairs, first, axis=1).view(kind)
    return g, last


class Adam:
    """Over all parameters as one vector."""

    def __init__(self, size: int, rate: float):
        self.rate, self.t = rate, 0
        # decayed sums of gradients and of their squares: ten and a hundred times the usual means
        self.m, self.v = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def step(self, p: np.ndarray, g: np.ndarray, scale: float = 1.0) -> None:
        """Uses g up."""
        self.t += 1
        clip = min(1.0, 1.0 / max(math.sqrt(float(np.vdot(g, g))), 1e-12))
        rate = self.rate * scale * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        if clip < 1:
            g *= clip
        self.m *= 0.9
        self.m += g
        g *= g
        self.v *= 0.99
        self.v += g
        np.sqrt(self.v, out=g)
        g += 1e-6
        np.divide(self.m, g, out=g)
        g *= rate
        p -= g


def train_local(p: dict, runs: list[np.ndarray], *, lanes: int = 64, least_steps: int = 120, rate: float = 0.01) -> dict:
    """Adam over the token runs, `lanes` side by side, windows of STEPS tokens
    with the state carried on inside a run; runs are gone through again until
    there were least_steps updates."""
    runs = sorted((r for r in runs if len(r)), key=len, reverse=True)
    if not runs:
        return p
    own = pack(p).astype(np.float32)
    made = np.empty_like(own)
    p, g, opt = unpack(own), unpack(made), Adam(len(own), rate)
    groups = [runs[a : a + lanes] for a in range(0, len(runs), lanes)]
    windows = sum(-(-len(g[0]) // STEPS) for g in groups)
    laps = max(1, -(-least_steps // windows))
    rng, done = np.random.default_rng(len(runs)), 0
    for _ in range(laps):
        for gi in rng.permutation(len(groups)):
            group = groups[gi]
            n = len(group[0])
            goal, mask = np.zeros((n, len(group)), np.int32), np.zeros((n, len(group)), np.float32)
            for j, r in enumerate(group):
                goal[: len(r), j], mask[: len(r), j] = r, 1
            ids = np.concatenate([np.full((1, len(group)), INPUTS - 1, np.int32), goal[:-1]])
            h = np.zeros((len(group), STATE), np.float32)
            lens = np.array([len(r) for r in group])
            for a in range(0, n, STEPS):
                live = int((lens > a).sum())  # runs that have ended leave the group
                _, h = gradients(p, ids[a : a + STEPS, :live], goal[a : a + STEPS, :live], mask[a : a + STEPS, :live], h[:live], g)
                opt.step(own, made, 1 - 0.9 * done / (laps * windows))
                done += 1
    return p


def score_local(p: dict, texts: list[np.ndarray], lanes: int = 512) -> np.ndarray:
    """ln P of each token sequence (tail tokens: of their classes), the state
    carried from window to window; sequences of about a length go side by side, as
    many as stay in cache, and leave as they end."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out = np.zeros(len(texts))
    for first in range(0, len(order), lanes):
        some = order[first : first + lanes]
        lens = np.array([len(texts[i]) for i in some])
        h, last, total = np.zeros((len(some), STATE), np.float32), np.full(len(some), INPUTS - 1, np.int32), np.zeros(len(some))
        for a in range(0, int(lens[0]), STEPS):
            live, width = int((lens > a).sum()), min(STEPS, int(lens[0]) - a)
            goal = np.zeros((live, width), np.int32)
            for j, i in enumerate(some[:live]):
                part = texts[i][a : a + width]
                goal[j, : len(part)] = part
            goal = np.ascontiguousarray(goal.T)
            before, h = recur(p, np.concatenate([last[None, :live], goal[:-1]]), h[:live])
            at = np.flatnonzero(np.arange(a, a + width)[:, None] < lens[:live])
            states = before.base.reshape(-1, STATE)[at + live]  # those after each token
            logs = np.zeros(goal.size)
            logs[at] = token_logs(p, states, goal.ravel()[at])
            total[:live] += logs.reshape(goal.shape).sum(0)
            last = goal[-1]
        out[some] = total
    return out


class _Tokens:
    """Tokens -> codes: their rank among the known types, or -1."""

    def __init__(self, vocab: Vocabulary):
        rank = {w: i for i, w in enumerate(vocab.head)}
        rest = [w for w in vocab.counts if w not in rank]
        self.code = rank | {w: HEAD + i for i, w in enumerate(rest)}
        # by code: the network's input, and log10 of count + 1/2
        self.input = np.concatenate([np.arange(HEAD), [HEAD + tail_class(w) for w in rest]]).astype(np.int32)
        self.log = np.zeros(len(self.input))
        for w, i in self.code.items():
            self.log[i] = math.log10(vocab.counts[w] + 0.5)
        self.rare: dict[bytes, int] = {}

    def __call__(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(codes, inputs, the tokens without a code)."""
        codes = np.fromiter(map(self.code.get, tokens, repeat(-1)), np.int32, len(tokens))
        at = np.flatnonzero(codes < 0).tolist()
        ids, rare = self.input[codes], [tokens[i] for i in at]
        if at:
            known = self.rare
            if len(known) > 200_000:
                known.clear()
            for w in rare:
                if w not in known:
                    known[w] = HEAD + tail_class(w)
            ids[at] = [known[w] for w in rare]
        return codes, ids, rare


def tokens_of(text: str | None) -> list[bytes]:
    """Of the UTF-8 bytes, where lower() and split() know A-Z and the six ASCII
    blanks alone."""
    return [*(text or "").encode().lower().split(), END]


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts but their ends, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, lens = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not some.all():  # at blank edges of a text
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[some], minlength=len(lens))
        flat = flat.filter(pa.array(some))
    return flat, lens


def _added(parts: list) -> tuple[pa.Array, np.ndarray]:
    """Lists of (tokens, counts) as one, each token once."""
    d = pa.concat_arrays([t for t, _ in parts]).dictionary_encode()
    return d.dictionary, np.bincount(d.indices.to_numpy(), np.concatenate([n for _, n in parts]), len(d.dictionary)).astype(np.int64)


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n) over the training documents of rows(doc_id, text)."""

    def run(batches):
        seen, size = [], 0
        for b in batches:
            for part in text_batches(b, 1, 4 << 20):
                part = part.filter(pa.array([not held_out(doc) for doc in part.column(0).to_pylist()], pa.bool_()))
                if not part.num_rows:
                    continue
                d = split_tokens(part.column(1))[0].dictionary_encode()
                seen += (d.dictionary, np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary))), (pa.array([END.decode()]), np.array([part.num_rows]))
                size += len(d.dictionary)
                if size > 600_000:
                    seen = [_added(seen)]
                    size = len(seen[0][0])
                    if size > 300_000:
                        yield pa.RecordBatch.from_arrays([seen[0][0], pa.array(seen[0][1])], ["token", "n"])
                        seen, size = [], 0
        if seen:
            tokens, n = _added(seen)
            yield pa.RecordBatch.from_arrays([tokens, pa.array(n)], ["token", "n"])

    return rows.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


CODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, ids binary, tail array<struct<token:string,tf:long>>"


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Of rows(doc_id, text), once for training and scoring: the network's inputs as
    16-bit ids; by known types: tokens known, the sum of log10 of their counts + 1/2,
    and that of tail tokens' shares of their classes; and the tokens of unknown
    types, whose logs a join has to add."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        vocab = shared.value
        index, row = _Tokens(vocab), TaskContext.get().partitionId() << 40
        mass = np.zeros(INPUTS)
        mass[HEAD:-1] = np.log10(np.maximum(vocab.class_count + 0.5 * (vocab.class_types + 1), 1e-300))
        names = [f.split()[0] for f in CODED.split(", ")]
        for b in batches:
            for part in text_batches(b, 1, 4 << 20):
                flat, lens = split_tokens(part.column(1))
                d = flat.dictionary_encode()
                types = pa.concat_arrays([d.dictionary, pa.array([END.decode()], d.dictionary.type)])
                # by type
                codes, ids, _ = index(types.cast(pa.binary()).to_pylist())
                known = codes >= 0
                log = np.where(known, index.log[codes], 0.0)
                own = np.where(ids >= HEAD, log - mass[ids], 0.0)
                # by token, with the ends
                lens = lens + 1
                ends = np.cumsum(lens)
                first, at, word = ends - lens, np.full(ends[-1], len(types) - 1), np.ones(ends[-1], bool)
                word[ends - 1] = False
                at[word] = d.indices.to_numpy()
                left = np.flatnonzero(~known[at])
                pairs, tf = np.unique(np.repeat(np.arange(len(lens)), lens)[left] * len(types) + at[left], return_counts=True)
                tail = pa.StructArray.from_arrays([types.take(pa.array(pairs % len(types))), pa.array(tf)], ["token", "tf"])
                tail_at = np.searchsorted(pairs // len(types), np.arange(len(lens) + 1)).astype(np.int32)
                data, data_at = ids[at].astype("<i2"), np.concatenate([[0], 2 * ends]).astype(np.int32)
                docs = part.column(0)
                cols = [
                    pa.array(np.arange(row, row + len(lens))), docs, pa.array([held_out(i) for i in docs.to_pylist()], pa.bool_()), pa.array(lens),
                    *(pa.array(np.add.reduceat(x[at], first)) for x in (known.astype(np.int64), log, own)),
                    pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(data_at), pa.py_buffer(data)]), pa.ListArray.from_arrays(pa.array(tail_at), tail),
                ]
                row += len(lens)
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, CODED)


def vocabulary(counts: DataFrame, known_types: int = 100_000, longest: int = 40) -> Vocabulary:
    """Of a stored table of token counts. known_types and longest bound what is
    broadcast; all other types are looked up by a join."""
    short = counts.where(F.length("token") <= longest)
    # the largest counts that known_types types reach, by counts of steps of a 16th of a power of two
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r[0], r[1]) for r in short.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, held = None, 0
    for s, n in sizes:
        if held + n > known_types:
            break
        least, held = s, held + n
    top = sorted(short.where(step >= least).collect(), key=lambda r: (-r.n, r.token)) if least is not None else []
    known = {r.token.encode(): r.n for r in top}
    head = [r.token.encode() for r in top[:HEAD]]
    if END in known and END not in head:
        head = [END, *head[: HEAD - 1]]
    suffix = F.substring("token", -2, 2)
    body = counts.where(~F.col("token").isin([w.decode() for w in head])) if head else counts
    per = body.groupBy(F.pmod(F.crc32(F.encode(suffix, "UTF-8")), F.lit(TAIL_CLASSES)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect()
    n, t = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in per:
        n[r.k], t[r.k] = r.n, r.t
    total = counts.agg(F.sum("n"), F.count("*")).first()
    return Vocabulary(head, known, total[0] or 0, total[1], n, t)


def train(rows: DataFrame, vocab: Vocabulary, *, rounds: int = 2, **options) -> dict:
    """On rows(doc_id, text), or on what encoded() made of them and was stored.
    Every training document takes part with all of its tokens, in each round.
    Each task fits a model on its runs, from the common one; the models' mean,
    weighted by tokens, is the next common one. Sums are built in a tree, so that
    few blocks of parameters (0.4 MB each) reach the driver at any size."""
    spark = rows.sparkSession
    params = initial(vocab)
    coded = (rows if "ids" in rows.columns else encoded(rows, vocab)).where("not held_out").select("ids")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(params)

        def run(batches, shared=shared):
            runs = [np.frombuffer(x, "<i2") for b in batches for x in b.column(0).to_pylist()]
            weight = float(sum(map(len, runs)))
            if weight:
                made = pack(train_local(shared.value, runs, **options)).astype(np.float64) * weight
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([weight]), pa.array([made.astype("<f4").tobytes()], pa.binary())], ["task", "weight", "p"])

        def add(batches):
            total, weight = None, 0.0
            for b in batches:
                for w, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                    x = np.frombuffer(v.as_py(), "<f4").astype(np.float64)
                    total, weight = x if total is None else total + x, weight + w
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([weight]), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["task", "weight", "p"])

        kinds = "task int, weight double, p binary"
        parts = coded.mapInArrow(run, kinds)
        # one partial sum a core, then those are few; each is of fixed size
        got = parts.repartition(spark.sparkContext.defaultParallelism, "task").mapInArrow(add, kinds).collect()
        if got:
            total = sum(np.frombuffer(bytes(r.p), "<f4").astype(np.float64) for r in got)
            params = unpack(total / sum(r.weight for r in got))
    return params


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known_types: int = 100_000, batch: int = 4096, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10 probabilities of the whole text,
    its end counted as a token).

    Learns from the documents that are not held out: counts from all of their
    tokens, the network from all of them too. Null texts are empty (the end alone);
    a null id is a training document; repeated rows repeat; without training
    tokens every score is that of the half counts; an empty table gives an empty
    result; texts of any length are scored whole. Other columns are not read. score
    (base_score does not) depends on how the table is dealt to tasks, as each task
    fits a model on its documents and the models' mean goes on."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    counts = stored(token_counts(rows), "counts")
    vocab = vocabulary(counts, known_types)
    coded = stored(encoded(rows, vocab), "coded")
    params = train(coded, vocab, **options)
    release_shuffles(spark)
    shared = spark.sparkContext.broadcast(params)
    given = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "own"]

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                neural = score_local(shared.value, [np.frombuffer(x, "<i2") for x in part.column(len(given)).to_pylist()]) / LN10
                cols = part.columns[: len(given)]
                yield pa.RecordBatch.from_arrays([*cols[:-1], pa.array(cols[-1].to_numpy() + neural)], [*given[:-1], "neural"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, neural double"
    scored = stored(coded.select(*given, "ids").mapInArrow(run, schema), "scored")
    rare = coded.select("row", F.inline("tail"))
    found = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more")
    )
    bottom = math.log10(vocab.total + 0.5 * (vocab.types + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), (F.col("neural") + logs).alias("score"),
    )
