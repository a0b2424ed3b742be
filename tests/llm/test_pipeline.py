import hashlib

import corpus_pipeline as P
from tessergrid.llm import tokenize_bpe
from tests.conftest import DATA
from tests.llm import test_decontaminate, test_line_dedup, test_near_duplicates


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for _, stage in P.STAGES[:-1]:
        made = stage(spark, frames[-1], DATA).cache()
        assert made.columns == columns
        frames.append(made)
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) >= 0.98 * len(rows[0])
    lean = {i: kept for i, _, _, kept in test_line_dedup.expected(list(rows[1].items()))}
    assert rows[2] == {i: t for i, t in lean.items() if t.strip() or not rows[1][i]}
    groups = test_near_duplicates.expected(rows[2].items())
    assert set(rows[3]) == {i for i, (c, _) in groups.items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _, _ in test_decontaminate.expected(list(rows[3].items()), items) if not hit}
    assert set(rows[4]) == clean


def test_run(spark):
    out = P.run(spark, DATA).collect()
    enc = tokenize_bpe.encoding(P.RANK_FILE, P.PATTERN)
    assert len(out) > 100
    assert all(hashlib.sha256(enc.decode_bytes(r.ids)).hexdigest() == r.decoded_sha256 for r in out)


def test_stages_keep_columns_of_any_name(spark, odd):
    kept = P.duplicate_stage(spark, P.line_stage(spark, odd, DATA), DATA)
    assert kept.columns == odd.columns and {(r.had, r.later, r.GONE_LINES) for r in kept.collect()} == {(6, 2, 1)}
