import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessergrid.llm import repeats as R
from tessergrid.llm import suffix_sort as S


def expected(rows, length=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        lost = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    lost[p : p + length] = b"\x01" * length
        kept = bytes(x for x, m in zip(b, lost) if not m)
        out.append((str(i), len(b), sum(lost), len([x for x in bytes(lost).split(b"\x00") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def test_brute_force(spark, odd):
    assert got(R.repeat_report(odd)) == expected([(r.doc_id, r.text) for r in odd.collect()])


def test_shifted_overlapping_and_edge_lengths(spark):
    base = "".join(chr(97 + (i * i * 7 + i // 5) % 26) for i in range(300))
    texts = [base, base[10:60], base[10:59], "é" + base[40:120] + "漢" + base[100:160], base[:50] + base[:50], "ab" * 100, "xab" * 3 + "ab" * 60, base[200:250] + base[200:250]]
    docs = spark.createDataFrame([(5 - i if i < 2 else i + 10, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(R.repeat_report(docs)) == expected(rows)
    assert got(R.repeat_report(docs, length=20)) == expected(rows, 20)
    kept = R.remove_repeats(docs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept.collect())


def test_empty(spark):
    assert R.repeat_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 4), st.integers(2, 60), st.sampled_from([40, 1 << 20]))
def test_induced_sorting(raw, spread, cap, memory):
    text = np.frombuffer(raw, np.uint8) % spread
    order, shared = S.suffix_array(text, spread, cap, memory)
    b = text.tobytes()
    assert sorted(order.tolist()) == list(range(len(b)))
    for k in range(1, len(order)):
        x, y = b[order[k - 1] :][:cap], b[order[k] :][:cap]
        same = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert x <= y and shared[k] == same


def test_queue_goes_to_disk():
    q = S.DiskQueue(3, np.int32, memory=100)
    for i in range(50):
        q.push(i % 3, np.arange(i, i + 4, dtype=np.int32), np.full(4, i, np.uint8))
    at, lcp = q.pop(1)
    assert q.spills > 1 and at[:8].tolist() == [1, 2, 3, 4, 4, 5, 6, 7] and lcp[4] == 4 and len(q.pop(1)[0]) == 0
    folder = q.folder
    q.close()
    assert not folder.exists()


def test_minimizers_depend_on_the_string_only():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 100, 400).astype(np.uint8)
    alone = [int(R.minimizers(raw[i : i + 50], 50, 12)[0]) for i in range(351)]
    assert R.minimizers(raw, 50, 12).tolist() == alone


def test_sort_moves_to_disk_when_a_shard_is_far_larger_than_its_memory(spark):
    rng = random.Random(6)
    sources = ["".join(rng.choices("abcd ", k=4000)) for _ in range(4)]

    def piece():
        at = rng.randrange(3700)
        return rng.choice(sources)[at : at + rng.randint(60, 300)]

    rows = [(i, "".join(piece() + rng.choice("xyz") * 3 for _ in range(20))) for i in range(120)]
    size, memory, spills = sum(len(t) for _, t in rows), 4000, spark.sparkContext.accumulator(0)
    assert size / 4 > 20 * memory  # of four shards, one for each shuffle partition
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert got(R.repeat_report(docs, memory=memory, spills=spills)) == expected(rows)
    assert spills.value > 0


def test_sql(same):
    same("op7_repeated_bytes")


def test_columns_with_the_operator_s_names_stay(odd):
    made = R.remove_repeats(odd)
    assert [c for c in made.columns if c in odd.columns] == [c for c in odd.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    assert {(r.gone_id, r.span_row, r._row, r.spans) for r in made.collect()} == {(0, 5, 10, "s")}
