import random
import zlib

import numpy as np

from tidemark.llm import language_id as L


def test_gradients():
    net = L.BiGRU(3, hidden=4, embed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, mask = L.padded([b"ab", b"xyz", b"q"])
    target = np.array([0, 2, 1])
    _, grad = net.gradients(codes, mask, target)
    r = np.random.default_rng(0)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        some = np.unique(codes)[:2] * 3 if k == "E" else r.choice(len(flat), min(4, len(flat)), replace=False)
        for i in some:
            old = flat[i]
            flat[i] = old + 1e-5
            up = net.gradients(codes, mask, target)[0]
            flat[i] = old - 1e-5
            down = net.gradients(codes, mask, target)[0]
            flat[i] = old
            assert abs((up - down) / 2e-5 - grad[k].reshape(-1)[i]) < 1e-4


def test_windows_read_like_the_whole_text():
    """Sums over windows equal those of the plain forward pass over each window with its context."""
    net = L.BiGRU(3, seed=4)
    texts = [b"ab cd", b"x" * 96, bytes(range(97, 123)) * 12, b"q " * 300, b"z"]
    want = []
    for t in texts:
        total = np.zeros(3)
        for s in range(0, len(t), L.STRIDE):
            window = (b" " * L.CONTEXT + t + b" " * 200)[s : s + L.STRIDE + 2 * L.CONTEXT]
            codes, mask = L.padded([window])
            total += net.forward(codes, mask)[0][L.CONTEXT : L.CONTEXT + min(L.STRIDE, len(t) - s), 0].sum(axis=0)
        want.append(total)
    assert np.allclose(L.Reader(net).totals(texts), want, rtol=1e-4)


def test_held_out_accuracy_and_cases(spark, empty_df):
    rng = random.Random(1)
    parts = {"aa": "ka lo mi nu".split(), "bb": "sch ung ver lich".split(), "cc": "ção ez ñe ou".split()}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(25)), lang))
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 -- !", "bb"), (1003, "schung " * 3, None), (None, "kalo mi", "aa"), (1004, "schlich" * 400, None)]
    df = spark.createDataFrame(rows + odd + rows[:1], "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as row")
    got = L.identify_language(df).collect()
    assert len(got) == len(rows) + len(odd) + 1
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == by[1004].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    assert L.identify_language(empty_df).count() == 0


def spoken(rng, parts):
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(12))


def test_sample_with_null_and_repeated_ids(spark):
    """All ids null, or all one id: both languages are learned, and of each about as many rows as the bound says."""
    rng = random.Random(3)
    parts = {"aa": "ka lo mi nu".split(), "bb": "sch ung ver lich".split()}
    for an_id in (None, 4):
        rows = [(an_id, spoken(rng, parts[k]), k) for k in parts for _ in range(4000)]
        got = L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        wrong = sum(("sch" in t or "ung" in t or "ver" in t or "lich" in t) != (r.lang_pred == "bb") for r, (_, t, _) in zip(got, rows))
        assert len(got) == 8000 and wrong < 80


def test_rare_language_is_learned(spark):
    rng = random.Random(5)
    common, rare = "ka lo mi nu".split(), "schx ungz verq lichw".split()
    rows = [(i, spoken(rng, common), "aa") for i in range(6000)] + [(i, spoken(rng, rare) * 3, "zz") for i in (6001, 6003, 6005, 6007)]
    rows += [(7000 + i, spoken(rng, rare), None) for i in range(20)]
    got = {r.doc_id: r.lang_pred for r in L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[7000 + i] == "zz" for i in range(20)) >= 18 and sum(got[i] == "aa" for i in range(6000)) > 5950


def test_scorer_takes_no_tanh(monkeypatch):
    """It costs twice as much as exp; gates that are all but open or shut, whose exp is infinite, give the forward pass's sums."""
    net = L.BiGRU(4, seed=8)
    for k in ("Wf", "Wb", "bf", "bb"):
        net.p[k] *= 200
    net.p["E"][97] *= 40
    text = bytes(np.random.default_rng(2).integers(97, 101, 500).tolist())
    windows = np.stack([np.frombuffer((b" " * L.CONTEXT + text + b" " * 200)[s : s + L.STRIDE + 2 * L.CONTEXT], np.uint8) for s in range(0, len(text), L.STRIDE)], axis=1)
    with np.errstate(over="ignore"):
        y = net.forward(windows, np.ones(windows.shape, np.float32))[0][L.CONTEXT : L.CONTEXT + L.STRIDE]
    want = y.transpose(1, 0, 2).reshape(-1, 4)[: len(text)].sum(axis=0)
    monkeypatch.setattr(np, "tanh", None)
    got = L.Reader(net).totals([text])[0]
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4)
