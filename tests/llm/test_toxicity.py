import random
import zlib

import numpy as np

from tidemark.llm import toxicity as T


def brute_kernel(s, t):
    """Sum over the subsequences of both strings, of lambda to the stretch in either, within the greatest stretch."""
    from itertools import combinations

    def vector(x):
        x, out, square = "^" + x + "$", {}, 0.0
        for i in combinations(range(len(x)), T.ORDER):
            if i[-1] - i[0] < T.STRETCH:
                w = T.LAMBDA ** (i[-1] - i[0] + 1)
                k = tuple(x[j] for j in i)
                out[k] = out.get(k, 0) + w
                square += w * w
        return {k: v / square**0.5 for k, v in out.items()}

    a, b = vector(s), vector(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_equals_brute_force():
    words = ["idiot", "idxiot", "scum", "abc", "mississippi", "anandananda"]
    got = T.kernel(words, words)
    want = [[brute_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-4)
    folded = T.decide(words, T.fold(words[:3], np.array([1.0, -2, 0.5])), 0.25)
    assert np.allclose(folded, got[:, :3] @ [1, -2, 0.5] + 0.25, atol=1e-4)


def labelled(spark):
    rng = random.Random(2)
    syllables = "ka lo mi nu ter san vo pel dra qui".split()
    bad = ["grobnik", "zorpfex", "blivvet"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 5)))
    docs, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    odd = [(5000, "ka lo grobxnik mi nu ter"), (5001, "ka lo g r o b n i k mi nu ter"), (5002, "Zor.pfex, nuter!"), (5003, None), (5004, ""), (None, "kalo minu"), (5005, "kalominu " * 3000)]
    return docs, odd, spark.createDataFrame(docs + odd + docs[:1], "doc_id long, text string").selectExpr("*", "0 as row", "'x' as toxic"), spark.createDataFrame(labels + [(5005, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_learns_and_tolerates_gaps(spark):
    docs, odd, df, labels = labelled(spark)
    got = T.toxicity(df, labels).collect()
    assert len(got) == len(docs) + len(odd) + 1
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out for i in held) and not any(by[i].held_out for i, _ in docs if i not in set(held))
    assert sum(by[i].predicted == (i % 9 == 0) for i in held) >= 0.97 * len(held)
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)
    assert [by[i].predicted for i in (5000, 5001, 5002, 5003, 5004, None, 5005)] == [1, 1, 1, 0, 0, 0, 0]


def test_nothing_to_learn(spark, empty_df):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.toxicity(empty_df, none).count() == 0
    got = T.toxicity(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), none).collect()
    assert got[0].predicted == 0


def test_windows_hold_every_short_part():
    for n in (0, 3, 20, 21, 27, 28, 61, 400):
        x = "".join(chr(0x4E00 + i) for i in range(n))
        cut = T.windows(x)
        assert all(len(w) <= 20 for w in cut) and all(any(x[i : i + 13] in w for w in cut) for i in range(max(1, n - 12)))


def test_insults_behind_the_twentieth_letter(spark):
    docs, _, df, labels = labelled(spark)
    late = [
        "lomikanu-tersanvo-peldraqui-kalomi-grobnik", "kalomi.nutersan.vopeldra.quikalo@zorpfex.lo", "lomi_nuter_sanvo_peldra_quika_blivvet",
        "k a l o m i n u t e r s a n v o p e l d r a g r o b n i k", "kalominutersanvopeldraquikagrobnik",
    ]
    fine = ["lomikanu-tersanvo-peldraqui-kalomi-nuter", "k a l o m i n u t e r s a n v o p e l d r a k a l o m i", "kalominutersanvopeldraquikalominu"]
    more = spark.createDataFrame([(7000 + i, f"ka lo {t} mi nu") for i, t in enumerate(late + fine)], "doc_id long, text string")
    by = {r.doc_id: r for r in T.toxicity(df.select("doc_id", "text").unionByName(more), labels).collect()}
    assert [by[7000 + i].predicted for i in range(len(late + fine))] == [1] * len(late) + [0] * len(fine), [round(by[7000 + i].score, 3) for i in range(len(late + fine))]
