import math

import numpy as np
import pyarrow as pa

from tessergrid.llm import language_mix as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.language_report(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_of_two(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs)
    text = {r.lang: r.text for r in docs.where("n_chars between 1500 and 3000").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(text["en"][:1400] + "\n" + text["de"][:700],), (text["en"][:1400],)], "text string")
    two, one = L.identify(mixed, model).collect()
    assert two.lang_pred == "en" and set(two.lang_mix) == {"en", "de"} and 0.5 < two.score < 0.8
    assert set(one.lang_mix) == {"en"} and one.score == 1


def test_em_raises_likelihood():
    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(5), 3).T)[rng.integers(0, 5, 400)].astype(np.float32)
    row, n = np.zeros(400, np.int64), np.ones(400, np.int64)
    theta, like = L._mixture(logp, row, n, 1, np.ones((1, 3), np.float32))
    flat = float(np.log((np.exp(logp) / 3).sum(1)).sum())
    assert math.isclose(theta.sum(), 1, rel_tol=1e-4) and like[0] >= flat - 1e-6


def test_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in L.language_report(odd).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and rows[0].score == 0
    assert L.language_report(odd).count() == odd.count()
    kept = L.keep_identified(odd)
    assert kept.columns == odd.columns and not {0, 1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert L.language_report(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", odd.lang.cast("string").substr(9, 0)).replace("", None, ["lang"])
    assert {r.lang_pred for r in L.language_report(unlabelled).collect()} == {"und"}


def test_letters():
    assert [L._has_letter(np.frombuffer(t.encode(), np.uint8)) for t in ("1 2", "a", "漢", "😀", "é")] == [False, True, True, False, True]
    assert L._grams(pa.array(["", "ab"]), 0, 2)[0].size == 0


def test_every_text_with_a_letter_has_a_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs)
    texts = ["Hi", "yes", "漢", "b", "É", "2024: b", "1 2 3 z", "a-b-c", "2024", "!", "", None]
    rows = L.identify(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), model).collect()
    assert [r.lang_pred in model[0] and 0 < r.score <= 1 for r in rows] == [True] * 8 + [False] * 4
    assert {(r.lang_pred, r.score) for r in rows[8:]} == {("und", 0.0)}
    # padding tells a word of one language: it is not the same language for all
    short = spark.createDataFrame([(0, "the", "en"), (1, "der", "de"), (2, "the", None), (3, "der", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in L.identify(short, L.train(short)).orderBy("doc_id").collect()] == ["en", "de"] * 2


def test_mixtures_of_many_languages_are_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    text = {r.lang: r.text for r in docs.where("n_chars between 1500 and 3000").orderBy("doc_id").collect()}
    assert len(text) >= 3
    mixed = "\n".join(t[:1000] for t in text.values())
    more = docs.unionByName(spark.createDataFrame([(-1, mixed, None), (-2, "Hi", None), (-3, "12 34", None)], docs.schema))
    assert L.identify(more.where("doc_id = -1"), L.train(docs)).first().score < 0.5
    assert {r.doc_id for r in L.keep_identified(more).where("doc_id < 0").collect()} == {-1, -2}


def by_hand(text, langs, table):
    """The mixture of one text in plain loops: n-grams by hand, EM by hand, languages admitted one at a time."""
    low = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
    found = {}

    def count(data):
        for i in range(len(data) - L.GRAM + 1):
            if data[i] != 32 or data[i + 1] != 32:
                code = np.array([int.from_bytes(data[i : i + L.GRAM], "big")], np.uint64)
                bucket = int(L.mix(code * L.MULT)[0] >> np.uint64(48))
                found[bucket] = found.get(bucket, 0) + 1

    count(low)
    if not found:
        count(b" " + low + b"  ")
    if not found or not any(c.isalpha() for c in text):
        return "und", {}
    grams = [(n, [float(x) - float(table[b].max()) for x in table[b]]) for b, n in sorted(found.items())]
    total = sum(n for n, _ in grams)

    def em(allowed):
        theta = {k: 1 / len(allowed) for k in allowed}
        for _ in range(L.ROUNDS):
            got = dict.fromkeys(allowed, 0.0)
            for n, logp in grams:
                p = {k: math.exp(logp[k]) * theta[k] for k in allowed}
                s = max(sum(p.values()), 1e-30)
                for k in allowed:
                    got[k] += n * p[k] / s
            theta = {k: v / total for k, v in got.items()}
        return theta, sum(n * math.log(max(sum(math.exp(logp[k]) * theta[k] for k in allowed), 1e-30)) for n, logp in grams)

    every, _ = em(range(len(langs)))
    alone = [sum(n * logp[k] for n, logp in grams) for k in range(len(langs))]
    chosen = [max(range(len(langs)), key=lambda k: alone[k])]
    share, like = {chosen[0]: 1.0}, alone[chosen[0]]
    for k in sorted((k for k in every if k not in chosen), key=lambda k: -every[k]):
        if every[k] * total <= 1:
            break
        theta, gained = em([*chosen, k])
        if gained - like <= L.PENALTY * math.log(max(total, 2)) / 2:
            break
        chosen, share, like = [*chosen, k], theta, gained
    return langs[max(share, key=lambda k: share[k])], {langs[k]: v for k, v in share.items() if v > 0}


def test_same_as_by_hand(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, table = model = L.train(docs)
    text = {r.lang: r.text for r in docs.where("n_chars between 1500 and 3000").orderBy("doc_id").collect()}
    texts = [t[a : a + 150] + " " + u[a : a + 90] for a in (0, 300, 600) for t in text.values() for u in text.values()]
    texts += [r.text for r in docs.where("n_chars < 600").orderBy("doc_id").limit(60).collect()] + [r.text for r in odd.where("length(text) < 2000").collect()] + ["Hi", "漢", "2024: b", "!"]
    rows = L.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(2), model).collect()
    mixed = 0
    for r in rows:
        pred, mix = by_hand(r.text, langs, table)
        mixed += len(mix) > 1
        assert r.lang_pred == pred and set(r.lang_mix) == set(mix), r.text
        assert all(abs(r.lang_mix[k] - v) < 5e-3 for k, v in mix.items())
    assert mixed > 10
