"""Secret scan: fixed patterns plus a linear-chain conditional random field decoded by Viterbi.

The field tags each token as secret begin, inside or outside. Its features are the token's shape, the
neighbouring words and separators, and features of the file. Every token of a text is an element of its chain.
Where a token's score as outside is so far above its others that no choice of its neighbours can make up for it, the
best labelling has it outside; such tokens cut a text's chain into short ones, so decoding the rest is exact for the
whole text. The field is trained here on weak labels: tokens in pattern matches of a bounded sample of documents,
the words around them and other passages, and lines made by a rule.

Defined results: null and empty texts have no spans; repeated rows repeat their result; an empty table
gives an empty result; further columns of the input pass by unread.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge.llm.common import Words, binary_column, runs, text_bytes, trimmed

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")

#: Documents, chosen by hash, from which training tokens come, in expectation; passages that each gives at most, and their tokens.
TRAINING_DOCUMENTS, PASSAGES, PASSAGE_TOKENS = 2048, 4, 16
O, B, I = 0, 1, 2  # noqa: E741
_HEX_BYTES, _DIGITS = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = _DIGITS[list(b"0123456789")] = True
_UPPER, _LOWER, _MARKS, _TOKEN = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = True
_MARKS[list(b"+/_-")] = True
_TOKEN[:] = _UPPER | _LOWER | _DIGITS | _MARKS
_TOKEN[0x80:] = True
_WORDS = 1024  # buckets of neighbouring words
#: Where each group of features begins; a token has one feature of each group.
_GROUPS = {"length": 12, "digits": 8, "case": 4, "hex": 2, "marks": 4, "changes": 8, "inner capitals": 4, "before": 256, "after": 256, "previous": _WORDS, "earlier": _WORDS, "next": _WORDS, "file digits": 8, "file names": 2, "file mean length": 6}
_BASE = np.concatenate([[0], np.cumsum(list(_GROUPS.values()))])


_NAMED = re.compile(rb"password|passwd|secret|token|api_?key|credential", re.IGNORECASE)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns' matches: leftmost, not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]


def _may_match(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts can hold a fixed pattern: a colon or equals sign, the access prefix or a long hexadecimal run."""
    at = [np.flatnonzero((data == 0x3A) | (data == 0x3D))]
    a = np.flatnonzero(data[:-3] == 0x41) if len(data) > 3 else np.zeros(0, np.int64)
    at.append(a[(data[a + 1] == 0x4B) & (data[a + 2] == 0x49) & (data[a + 3] == 0x41)])
    edge = np.diff(np.concatenate([[0], _HEX_BYTES[data].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at.append(start[end - start >= 32])
    may = np.zeros(len(offsets) - 1, bool)
    may[np.searchsorted(offsets, np.concatenate(at), side="right") - 1] = True
    # a run that crosses into the next text counts for it, too
    long = start[end - start >= 32], end[end - start >= 32]
    for s, e in zip(*long, strict=True):
        may[np.searchsorted(offsets, s, side="right") - 1 : np.searchsorted(offsets, e - 1, side="right")] = True
    return may


def chains(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of some texts: text, start, end, features (a row each), and whether a token begins its text's chain."""
    words = Words(data, offsets, _TOKEN)
    start, end, text = words.start, words.end, words.text
    if not len(start):
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, len(_GROUPS)), np.int32), np.zeros(0, bool))
    n = end - start

    def per(of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of, dtype=np.int32)])
        return sums[end] - sums[start]

    digit, upper, lower = _DIGITS[data], _UPPER[data], _LOWER[data]
    digits = per(digit)
    kind = (digit * 1 + (upper | lower) * 2).astype(np.int8)
    changes = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
    inner = np.concatenate([[0], np.cumsum(upper[1:] & lower[:-1], dtype=np.int32)])
    word = np.zeros(len(start) + 4, dtype=np.int64)
    word[2:-2] = 1 + (words.hashes()[0] % np.uint64(_WORDS - 1)).astype(np.int64)
    texts = np.arange(len(offsets) - 1)
    first = np.searchsorted(text, texts)
    count = np.searchsorted(text, texts, side="right") - first
    n_bytes = np.maximum(np.diff(offsets), 1)
    total = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
    share = (total[offsets[1:]] - total[offsets[:-1]]) / n_bytes
    named = np.array([_NAMED.search(data[a:b].tobytes()) is not None for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
    begins = np.append(True, text[1:] != text[:-1])
    at = np.arange(len(start)) - first[text]
    left, before, after = count[text] - 1 - at, start - 1, end
    columns = [
        np.minimum(n // 4, 11), np.minimum(digits * 8 // n, 7), (per(upper) > 0) * 2 + (per(lower) > 0), (per(_HEX_BYTES[data]) == n) * 1, np.minimum(per(_MARKS[data]), 3),
        np.minimum((changes[end - 1] - changes[start]) * 16 // n, 7), np.minimum(inner[end - 1] - inner[start], 3),
        np.where(before >= offsets[text], data[np.maximum(before, 0)], 0), np.where(after < offsets[text + 1], data[np.minimum(after, len(data) - 1)], 0),
        np.where(at >= 1, word[1:-3], 0), np.where(at >= 2, word[:-4], 0), np.where(left >= 1, word[3:-1], 0),
        np.minimum((share[text] * 50).astype(np.int64), 7), named[text], np.minimum(n_bytes[text] // np.maximum(count[text], 1) // 2, 5),
    ]
    features = np.empty((len(start), len(_GROUPS)), np.int32)
    for g, column in enumerate(columns):
        features[:, g] = column + _BASE[g]
    return text, start, end, features, begins


def made_lines(seed: int = 7) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Training lines made by a rule, with their secrets' places: assignments of random values, and the same names before plain words, numbers, dates and addresses."""
    r, out = random.Random(seed), []
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    vowels, others = "aeiou", "bcdfghklmnprstvw"
    plain_word = lambda: "".join(r.choice(others) + r.choice(vowels) + (r.choice(others) if r.random() < 0.4 else "") for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(plain_word().capitalize() if r.random() < 0.15 else plain_word() for _ in range(n))
    for _ in range(700):
        key = r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "credential", "credentials", "access key", "private key", "auth", "bearer"])
        value = r.choice([lambda: draw(letters[:6] + digits, r.choice([18, 24, 32, 40])), lambda: draw(letters + letters.upper() + digits, r.randint(8, 40)), lambda: draw(letters + letters.upper(), r.randint(10, 32))])()
        quote = r.choice(["", '"', "'"])
        line = f"{prose(r.randint(0, 6))} {key}{r.choice(['=', ': ', ' = ', ':'])}{quote}"
        out.append((f"{line}{value}{quote} {prose(r.randint(1, 8))}".encode(), [(len(line), len(line) + len(value))]))
        plain = [f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", draw(digits, r.choice([4, 8, 10, 13, 16])), f"+{draw(digits, 11)}", f"{plain_word()}{r.randint(1, 99)} at mail", f"order-{draw(digits, 6)}", f"www/{plain_word()}/{draw(digits, 4)}", plain_word().upper() + plain_word(), prose(2)]
        out.append((f"{prose(r.randint(1, 8))} {r.choice(plain)} {plain_word()} {r.choice(plain)} {prose(3)}".encode(), []))
        out.append((f"{prose(r.randint(0, 4))} {key}{r.choice([' ', ', ', ': ', ' = '])}{prose(r.randint(1, 5))}".encode(), []))
    return out


def weak_labels(texts: list[bytes], known: list[list[tuple[int, int]]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and chain starts of the tokens in some texts; tokens in a fixed pattern's match or a known place are secrets."""
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    text, start, end, features, begins = chains(data, offsets)
    labels = np.zeros(len(text), np.int8)
    for i, t in enumerate(texts):
        for a, b in secret_values(t) + (known[i] if known else []):
            lo, hi = np.searchsorted(end, offsets[i] + a, side="right"), np.searchsorted(start, offsets[i] + b)
            labels[lo:hi] = I
            labels[lo : min(hi, lo + 1)] = B
    return features, labels, begins


def secret_values(text: bytes) -> list[tuple[int, int]]:
    """Where the fixed patterns' matches have their secrets: without the names that are assigned to."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return found + [(a, b) for a, kind, b in base_spans(text) if kind]


def train(features: np.ndarray, labels: np.ndarray, begins: np.ndarray, rounds: int = 80, rate: float = 0.15, ridge: float = 1e-4, longest: int = 32) -> dict[str, np.ndarray]:
    """Weights of the field, by batch gradient steps (Adam) on the mean log-likelihood of the chains."""
    chain = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    at = np.arange(len(labels)) - first[chain]
    chain, at = np.unique(np.stack([chain, at // longest]), axis=1, return_inverse=True)[1].ravel(), at % longest
    m, t = int(chain.max(initial=-1)) + 1, int(at.max(initial=0)) + 1
    here = np.zeros((m, t), bool)
    here[chain, at] = True
    gold = np.zeros((m, t), np.int64)
    gold[chain, at] = labels
    size = here.sum(axis=1)
    w, move = np.zeros((int(_BASE[-1]), 3)), np.zeros((3, 3))
    forbidden = np.zeros((3, 3))
    forbidden[O, I] = -1e4
    state = [np.zeros_like(x) for x in (w, w, move, move)]
    n_bins = int(_BASE[-1])
    for step in range(1, rounds + 1):
        e = np.zeros((m, t, 3))
        e[chain, at] = w[features].sum(axis=1)
        a = move + forbidden
        forward, backward = np.zeros((m, t, 3)), np.zeros((m, t, 3))
        forward[:, 0] = e[:, 0] + a[O]
        for j in range(1, t):
            forward[:, j] = _lse(forward[:, j - 1][:, :, None] + a) + e[:, j]
        for j in range(t - 1, -1, -1):
            last = size == j + 1
            step_back = np.zeros((m, 3)) if j == t - 1 else _lse((a[None] + (e[:, j + 1] + backward[:, j + 1])[:, None, :]).transpose(0, 2, 1))
            backward[:, j] = np.where(last[:, None], a[:, O], step_back)
        z = _lse((forward[np.arange(m), size - 1] + a[:, O])[:, :, None])[:, 0]
        p = np.exp(np.minimum(forward + backward - z[:, None, None], 0)) * here[:, :, None]
        wrong = -p
        wrong[np.arange(m)[:, None], np.arange(t)[None], gold] += here
        g = wrong[chain, at]
        grad_w = np.stack([np.bincount(features.ravel(), weights=np.repeat(g[:, c], features.shape[1]), minlength=n_bins) for c in range(3)], axis=1) / m - ridge * w
        grad_a = np.zeros((3, 3))
        np.add.at(grad_a, (np.zeros(m, np.int64), gold[:, 0]), 1)
        grad_a[O] -= p[:, 0].sum(axis=0)
        np.add.at(grad_a, (gold[np.arange(m), size - 1], np.zeros(m, np.int64)), 1)
        grad_a[:, O] -= p[np.arange(m), size - 1].sum(axis=0)
        for j in range(1, t):
            on = here[:, j]
            pair = np.exp(np.minimum(forward[on, j - 1][:, :, None] + a + (e[on, j] + backward[on, j])[:, None, :] - z[on][:, None, None], 0))
            np.add.at(grad_a, (gold[on, j - 1], gold[on, j]), 1)
            grad_a -= pair.sum(axis=0)
        grad_a = grad_a / m - ridge * move
        for x, grad, one, two in ((w, grad_w, state[0], state[1]), (move, grad_a, state[2], state[3])):
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            x += rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return {"emit": w, "move": move + forbidden}


def _lse(x: np.ndarray) -> np.ndarray:
    """log-sum-exp over axis 1."""
    most = x.max(axis=1)
    return most + np.log(np.exp(x - most[:, None]).sum(axis=1))


def viterbi(emit: np.ndarray, begins: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of all chains, decoded side by side, longest first; a chain stands between outside tokens."""
    n = len(emit)
    first = np.flatnonzero(begins)
    size = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    score, back = emit[first] + move[O], np.zeros((n, 3), np.int8)
    best = score.copy()
    for j in range(1, int(size.max(initial=0))):
        k = int(np.searchsorted(-size, -j, side="left"))  # chains of more than j tokens
        all_ = best[:k, :, None] + move[None]
        back[first[:k] + j] = all_.argmax(axis=1)
        best[:k] = all_.max(axis=1) + emit[first[:k] + j]
    labels = np.zeros(n, np.int8)
    now = (best + move[:, O]).argmax(axis=1)
    for j in range(int(size.max(initial=0)) - 1, -1, -1):
        k = int(np.searchsorted(-size, -j, side="left"))
        labels[first[:k] + j] = now[:k]
        if j:
            now[:k] = back[first[:k] + j, now[:k]]
    return labels


def surely_outside(emit: np.ndarray, begins: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Tokens that are outside in the best labelling, whatever their neighbours are.

    If a token has another label, calling it outside instead is no worse for any labels around it: where an inside
    token follows, which may not follow an outside one, that one becomes a beginning.
    """
    o, sure = emit[:, O], np.ones(len(emit), bool)
    next_ = np.zeros_like(emit)
    next_[:-1] = emit[1:]
    last = np.append(begins[1:], True)
    for x in (B, I):
        entered = (move[:, x] - move[:, O]).max()  # what x may gain over outside by the label before
        left = max(move[x, c] - move[O, c] for c in (O, B))
        sure &= o - emit[:, x] > entered + left + 1e-9
        rest = (move[I] - move[B]).max()
        turned = move[x, I] - move[O, B] + next_[:, I] - next_[:, B] + rest
        sure &= last | (o - emit[:, x] > entered + turned + 1e-9)
    return sure


def decoded(emit: np.ndarray, begins: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of whole chains; sure tokens cut them, the rest is decoded."""
    labels = np.zeros(len(emit), np.int8)
    open_ = np.flatnonzero(~surely_outside(emit, begins, move))
    if len(open_):
        starts = begins[open_] | np.append(True, open_[1:] != open_[:-1] + 1)
        labels[open_] = viterbi(emit[open_], starts, move)
    return labels


def scores(features: np.ndarray, emit: np.ndarray) -> np.ndarray:
    out = np.zeros((len(features), 3))
    for g in range(features.shape[1]):
        out += emit[features[:, g]]
    return out


def field_spans(data: np.ndarray, offsets: np.ndarray, model: dict[str, np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """For texts that have any: (start, end) in bytes of the spans the field tags."""
    text, start, end, features, begins = chains(data, offsets)
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(text):
        return out
    labels = decoded(scores(features, model["emit"]), begins, model["move"])
    for j in np.flatnonzero(labels):
        own = out.setdefault(int(text[j]), [])
        s, e = int(start[j] - offsets[text[j]]), int(end[j] - offsets[text[j]])
        if labels[j] == I and own and not begins[j]:
            own[-1] = own[-1][0], e
        else:
            own.append((s, e))
    return out


def beside(span: tuple[int, int], taken: list[tuple[int, int]], text: bytes) -> list[tuple[int, int]]:
    """The parts of a span outside other ones, without separators at their ends."""
    parts, at = [], span[0]
    for a, b in sorted(taken):
        parts.append((at, min(a, span[1])))
        at = max(at, b)
    parts.append((at, span[1]))
    out = []
    for a, b in parts:
        own = np.flatnonzero(_TOKEN[np.frombuffer(text[a:b], np.uint8)]) if a < b else []
        if len(own):
            out.append((a + int(own[0]), a + int(own[-1]) + 1))
    return out


def passages(labels: np.ndarray, begins: np.ndarray, pick: random.Random) -> list[tuple[int, int]]:
    """Ranges of one text's tokens to learn from: around secrets first, then anywhere."""
    n, out = len(labels), []
    at = np.flatnonzero(labels == B)[:PASSAGES].tolist()
    at += [pick.randrange(n) for _ in range(PASSAGES - len(at))]
    for i in sorted(set(at)):
        lo = max(0, i - PASSAGE_TOKENS // 2, out[-1][1] if out else 0)
        if lo < min(n, i + PASSAGE_TOKENS // 2):
            out.append((lo, min(n, i + PASSAGE_TOKENS // 2)))
    return out


def sample_chains(documents: DataFrame, n_documents: int = TRAINING_DOCUMENTS) -> list[tuple[bytes, bytes, bytes]]:
    """Weakly labelled passages of about ``n_documents`` documents, chosen by a hash of doc_id: at most 64 tokens of each."""
    total = documents.count()
    part = min(1.0, n_documents / max(total, 1))
    chosen = documents.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("crf")), F.lit(1 << 20)) < int(part * (1 << 20)))

    @trimmed
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                features, labels, begins = weak_labels([text])
                for lo, hi in passages(labels, begins, random.Random(len(text))) if len(labels) else ():
                    own, first = labels[lo:hi].copy(), np.arange(hi - lo) == 0
                    if own[0] == I:
                        own[0] = B
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (features[lo:hi], own, first)], names=["f", "l", "b"])

    rows = chosen.select(text_bytes().alias("text")).mapInArrow(label, "f binary, l binary, b binary")
    return sorted((bytes(r.f), bytes(r.l), bytes(r.b)) for r in rows.collect())


def fit(documents: DataFrame, n_documents: int = TRAINING_DOCUMENTS) -> dict[str, np.ndarray]:
    """A field trained on the lines made by a rule and a bounded sample of ``documents``."""
    made = weak_labels(*map(list, zip(*made_lines(), strict=True)))
    rows = sample_chains(documents, n_documents)
    features = np.concatenate([made[0], *(np.frombuffer(f, np.int32).reshape(-1, len(_GROUPS)) for f, _, _ in rows)])
    labels = np.concatenate([made[1], *(np.frombuffer(x, np.int8) for _, x, _ in rows)])
    begins = np.concatenate([made[2], *(np.frombuffer(b, bool) for _, _, b in rows)])
    return train(features, labels, begins)


def scan(documents: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Of the field's spans, the parts within a fixed pattern's match are left out: the match reports them.
    """

    @trimmed
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column(1))
            spans: list[list[tuple[str, int, int]]] = []
            for lo, hi in runs(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                may = _may_match(own, at) if len(own) else np.zeros(hi - lo, bool)
                tagged = field_spans(own, at, model)
                for i in range(hi - lo):
                    whole = own[at[i] : at[i + 1]].tobytes() if may[i] or i in tagged else b""
                    found = base_spans(whole) if may[i] else []
                    taken = [(a, b) for a, _, b in found]
                    found += [(s, 3, e) for span in tagged.get(i, []) for s, e in beside(span, taken, whole)]
                    if found:
                        points = np.concatenate([[0], np.cumsum((own[at[i] : at[i + 1]] & 0xC0) != 0x80)])
                        spans.append([(KINDS[k], int(points[s]), int(points[e])) for s, k, e in sorted(found)])
                    else:
                        spans.append([])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], kind)], names=["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(tag, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")
