"""Corpus queries as they are registered, against plain loops; and runs, hard negatives and personal data on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from gauge.llm import hard_negatives, periodic_runs, personal_data, queries

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, number long, key string, base int, found int, row long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id: int | None, text: str | None) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    milli = best[1] and 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{i},{n},{q}\n" for i, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_small_alphabets():
    r = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 6)):
            v, w = r.choice([1, 2, 2, 3, 5]), []
            while len(w) < r.randint(0, 80):
                w += [r.randrange(v) for _ in range(r.randint(1, 6))] * r.choice([1, 1, 2, 4, 5, 7])
                if r.random() < 0.3 and len(w) > 8:
                    a = r.randrange(len(w))
                    w += w[a : a + r.randint(5, 40)]
            texts.append(np.array(w, np.int64))
        assert periodic_runs.runs_of(texts) == [plain_runs(t.tolist()) for t in texts]


def test_op11(spark, texts):
    found = {r[0]: tuple(r) for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert found == {i: plain_row(i, t) for i, t in texts.items()}
    assert any(r[1] for r in found.values())


def test_op11_odd_tables(spark):
    r = random.Random(1)
    long = " ".join(r.choice("abc") for _ in range(4000)) + " x y" * 500
    rows = [(1, None), (2, ""), (3, " \x0b\n"), (4, "a " * 40), (4, "a " * 40), (None, "b c " * 9), (20, long), (21, "é  é\té é\x1fé é é"), (10**12, "solo"), (-7, "no runs here at all")]
    df = spark.createDataFrame([(*x, 1, "k", 2, 3, 4) for x in rows], ODD)
    found = sorted((tuple(x) for x in periodic_runs.periodic_runs(df).collect()), key=repr)
    assert found == sorted((plain_row(*x) for x in rows), key=repr)
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


def plain_negatives(rows: list) -> list[tuple]:
    use = []
    for v, e, label in rows:
        if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            use.append((v, [math.floor(256 * x) for x in e], (label + 1) % 10 if v % 7 == 0 else label))
    out = []
    for k, (v, e, label) in enumerate(use):
        if v % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(e, f, strict=True)), w, m, i) for i, (w, f, m) in enumerate(use)]
        for p, pid in sorted((s, w) for s, w, m, i in scores if m == label and i != k)[:5]:
            ok = sorted((s, w) for s, w, m, _ in scores if m != label and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(v, pid, n, w, -p, -s) for n, (s, w) in enumerate(ok[:10], 1)]
    return sorted(out)


def test_op12(spark):
    found = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, SMALL).collect())
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert found and found == plain_negatives(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    assert found == sorted(con.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall())


@pytest.mark.parametrize("scale", [1.0, 2.0**17])
def test_op12_odd_tables(spark, monkeypatch, scale):
    """Ties, repeated anchors and vectors, several groups and blocks, what takes no part, and numbers beyond doubles."""
    r, rows = random.Random(3), []
    for i in range(700):
        e = r.choice(rows)[1] if rows and r.random() < 0.3 else [r.gauss(0, 1) * r.choice([scale, 0.1]) for _ in range(8)]
        rows.append((i, e, r.randrange(3)))
    rows += rows[95:105] + rows[200:201] * 3
    odd = [(1300, None, 1), (1100, [1.0] * 8, None), (None, [1.0] * 8, 1), (1200, [float("nan")] * 8, 1), (1400, [1.0] * 7 + [None], 1), (1500, [float("inf")] * 8, 1)]
    other = [(1600, [1.0] * 3, 1), (1700, [], 2), (1800, [1e30] * 8, 1)]
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 0)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    df = spark.createDataFrame([(*x, 1.0, 2, 3) for x in rows + odd + other], "vec_id long, embedding array<double>, label int, score double, list long, rank int").repartition(3)
    assert sorted(tuple(x) for x in hard_negatives.mine(df).collect()) == plain_negatives(rows)
    assert hard_negatives.mine(df.limit(0)).collect() == [] and hard_negatives.mine(df.where("vec_id = 3")).collect() == []


def test_op12_bounds_never_lose_a_pair():
    r = np.random.default_rng(2)
    a, b = np.floor(r.normal(size=(40, 16)) * 300), np.floor(r.normal(size=(90, 16)) * 300)
    turn = np.linalg.qr(r.normal(size=(16, 16)))[0]
    exact = (a @ b.T).astype(np.int64)
    low, high = exact[:, 3].astype(float), exact[:, 7].astype(float)
    i, j, score = hard_negatives.verified(hard_negatives.Side(a, turn), hard_negatives.Side(b, turn), low, high, np.ones(exact.shape, bool))
    assert (score == exact[i, j]).all()
    assert set(zip(*np.nonzero((exact >= low[:, None]) & (exact <= high[:, None])))) <= set(zip(i, j))
    assert len(i) < exact.size


PRIVATE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_private(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PRIVATE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }
            if good[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_op13(spark, texts):
    rows = queries.op13_personal_data(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_private(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == sha(joined) and r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in PRIVATE)


def test_op13_fixed_patterns_equal_python(spark):
    r = random.Random(2)
    parts = ["a", "@", ".", "b-", "_", "+", "1", "25", "255", "256", "0", "00", "4", "(", "-", " ", "%", "é", "😀", "x@y.z", "1.2.3.4", "4111111111111111", "+1 555 0199 22", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * 3000 + "@" + "b." * 3000 + "c", "1 " * 4000, "1." * 5000, "9" * 20000, "😀 x@y.zz 0255.0.00.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: [tuple(s) for s in x.base] for x in personal_data.with_base(df).collect()}
    assert found == {i: plain_private(t) for i, t in enumerate(texts)}


def test_op13_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call my phone +1 (692) 555-{7000 + i} soon") for i in range(30)]
    rows += [(100 + i, f"the year {1900 + i} was fine") for i in range(30)]
    rows += [(200, "please call my phone 555 4321 soon"), (201, "é please call my phone 0044-77-1234, or not"), (202, "we saw 12345 birds"), (None, "call my phone 98765"), (None, "call my phone 98765"), (203, None), (204, ""), (205, "phone 98765")]
    df = spark.createDataFrame([(*x, 1, "k", 2, 3, 4) for x in rows], ODD).repartition(3)
    found = sorted(((x.doc_id, [tuple(s) for s in x.base], [tuple(s) for s in x.more]) for x in personal_data.find(df).collect()), key=repr)
    wanted = {200: (21, 29), 201: (23, 35), None: (14, 19)}
    for doc_id, text in rows:
        more = [("context_phone", *wanted[doc_id])] if doc_id in wanted else []
        assert (doc_id, plain_private(text or ""), more) in found
    assert len(found) == len(rows)
    assert personal_data.find(df.limit(0)).collect() == []


def test_op13_confidence_spreads_over_rounds(spark):
    """Seeds teach one context; its unseen instances teach a second one, in which only they stand."""
    seeds = [(i, f"reach account holder a{i}@mail.com today") for i in range(40)]
    middle = [(100 + i, f"reach account holder id-{70000 + i} today") for i in range(10)]
    far = [(200 + i, f"badge number id-{70000 + i} printed") for i in range(10)] + [(300, "badge number qq-55555 printed")]
    df = spark.createDataFrame(seeds + middle + far, "doc_id long, text string")
    one, more = ({r.doc_id for r in personal_data.find(df, rounds=n).where("size(more) > 0").collect()} for n in (1, 3))
    assert one == {i for i, _ in middle} and more == {i for i, _ in middle + far}


def test_op13_is_native(spark):
    plan = queries.op13_personal_data(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def rows_of(spark, name):
    return queries.queries()[name](spark, SMALL).collect()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_op1_contract(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    rows = rows_of(spark, "op1_secret_crf")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        joined = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert r.base_sha256 == sha(",".join(joined)) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in found) for i in range(3))
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("crf")] == joined and len(spans) == len(joined) + r.n_crf


def test_op2_contract(spark, texts):
    rows = rows_of(spark, "op2_toxicity_ftrl")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_op3_contract(spark, texts):
    rows, source = rows_of(spark, "op3_source_mix"), {r.doc_id: r.source for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    size = {i: len(words_of(t)) for i, t in texts.items()}
    whole: dict = {}
    for i, s in source.items():
        whole[s] = whole.get(s, 0) + size[i]
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[k % 3]) for k, s in enumerate(order)}
    target, left, over = {}, Fraction(sum(whole.values())), dict(weight)
    while over:
        share = {s: left * w / sum(over.values()) for s, w in over.items()}
        full = [s for s in over if share[s] > 3 * whole[s]]
        for s in full or list(over):
            target[s] = Fraction(3 * whole[s]) if full else share[s]
            del over[s]
            left -= target[s]
    taken: dict = {}
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == whole[s] and abs(r.target - float(target[s])) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= max(70, 0.02 * target[s]) for s in target)
    assert rows_of(spark, "op3_source_mix") and sorted(rows) == sorted(rows_of(spark, "op3_source_mix"))


def test_op4_contract(spark, texts):
    groups: dict = {}
    for i, t in texts.items():
        groups.setdefault(lower(t), []).append(i)
    wanted = {(i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}
    assert {tuple(r)[:5] for r in rows_of(spark, "op4_lsm_dedup")} == wanted


def test_op5_contract(spark, texts):
    for r in rows_of(spark, "op5_jpeg_media"):
        data = texts[r.doc_id].encode()
        payload = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_op6_contract(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = lower(t).split(" ") and words_of(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows_of(spark, "op6_ngram_group_join")} == {(i, len(sets[i]), find(i)) for i in ids}


def test_op7_and_op8_contracts(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    import sys

    sys.path.insert(0, "/opt/tokenizers")
    public = pytest.importorskip("public_tokenizers")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    word, byte = (tokenizers.Tokenizer.from_file(str(public.path(f))) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    start = 0
    for r in sorted(rows_of(spark, "op8_content_store")):
        ids = byte.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    rows, pieces, filled = rows_of(spark, "op7_nnls_packing"), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        ids, at = word.encode(t, add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert all([o for o, _ in sorted(s)] == np.cumsum([0, *(n for _, n in sorted(s))])[:-1].tolist() and sum(n for _, n in s) <= 2048 for s in filled.values())


def test_op9_and_op10_contracts(spark, texts):
    rows = rows_of(spark, "op9_importance_resampling")
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.selected for r in rows)
    assert min(r.key for r in rows if r.selected) >= max(r.key for r in rows if not r.selected)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = rows_of(spark, "op10_wrapper_induction")
    assert {(r.page_id, r.url) for r in rows} == set(pages.items()) and all(r.n_chars == len(r.text) for r in rows)


def test_ftrl_equals_a_plain_loop():
    """The update by single coordinates in Python's own numbers."""
    from gauge.llm import toxicity_ftrl as model

    r = np.random.default_rng(5)
    rows = [(np.unique(r.integers(0, 40, 12)).astype(np.int32), int(r.random() < 0.4)) for _ in range(60)]
    passes = 3
    found = model.train_shard(rows, passes=passes)
    z, n, order = {}, {}, np.random.default_rng(11)

    def weight(i):
        if abs(z.get(i, 0.0)) <= model.L1:
            return 0.0
        return (math.copysign(model.L1, z[i]) - z[i]) / ((model.BETA + math.sqrt(n.get(i, 0.0))) / model.ALPHA + model.L2)

    for _ in range(passes):
        for k in order.permutation(len(rows)):
            x = [*rows[k][0].tolist(), model.PRIOR]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][1]
            for i in x:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / model.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    assert {int(i): pytest.approx(found[i], abs=1e-9) for i in np.flatnonzero(found)} == {i: weight(i) for i in z if weight(i)}
