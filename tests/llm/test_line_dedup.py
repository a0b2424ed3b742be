import io
import random
from contextlib import redirect_stdout

import pytest

from tessergrid.llm import line_dedup as L
from tests.conftest import DATA
from tests.llm.conftest import words


def expected(rows, t=0.8):
    """Kept text and counts of each row: a line goes if an earlier line's word set reaches the threshold."""
    seen, out = [], []
    for i, text in sorted((r for r in set(rows) if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        kept = []
        for line in text.split("\n"):
            s = frozenset(words(line.lower()))
            if not s or not any(len(s & o) * (1 + t) >= (len(s) + len(o)) * t - 1e-9 for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out.append((i, len(text.split("\n")), len(text.split("\n")) - len(kept), "\n".join(kept)))
    every = {x[0]: x for x in out}
    return sorted((every[i] if i in every else (i, 0 if t is None else t.count("\n") + 1, 0, t) for i, t in rows), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in frame.collect()), key=str)


def test_brute_force(spark, odd):
    assert got(L.line_report(odd)) == expected([(r.doc_id, r.text) for r in odd.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_many_near_lines(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    bases = [rng.sample(vocab, rng.randint(3, 14)) for _ in range(12)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w + rng.choices(vocab, k=rng.randint(0, 2)))

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(L.line_report(docs)) == expected(rows)


def test_split_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "SPLIT_RANK", 4)  # every word of two lines or more
    rng = random.Random(9)
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*base[: rng.randint(9, 12)], f"x{rng.randint(0, 3)}"])) for i in range(60)]
    assert got(L.line_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))) == expected(rows)


def test_sample_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got(L.line_report(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_columns(spark, odd):
    assert L.line_report(odd.limit(0)).count() == 0
    assert L.drop_repeated_lines(odd).columns == odd.columns


def test_no_python_in_the_plan(spark, odd):
    with redirect_stdout(io.StringIO()) as out:
        L.line_report(odd).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


def test_sql(same):
    same("op9_line_dedup")
