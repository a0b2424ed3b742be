import random
import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


#: Columns besides, under names that operators use inside or return.
EXTRA = "n_words int, id int, body string, spans string, class_id int, label string, gone_id int, GONE_LINES int, later int, span_id int, found_spans int, span_row int, had int, lost_id int, _gone int, _later int, _row int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward row: nulls, blanks, a very long text, repeated rows, extra columns."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgéß", k=rng.randint(1, 6))) for _ in range(60)]
    said = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = said(40)
    texts = [None, "", "   ", "!!! ???", "one", "One two.", shared, shared, shared + " x", f"{said(30)}\n{shared}\n\n{said(20)}", said(60_000), "漢字 かな 漢字 かな 漢字 " * 9, "a" * 70_000, "\x00\x01 b", "😀 " * 60]
    texts += [said(rng.randint(3, 80)) for _ in range(20)]
    texts += [texts[6].upper(), texts[9].replace("\n", "\n\n")]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), 1, 2, "b", "s", 3, "l", *range(11)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[10], (None, shared, None, None, None, 1, 2, "b", "s", 3, "l", *range(11)), (None, None, None, None, None, 1, 2, "b", "s", 3, "l", *range(11))]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}").repartition(3).cache()
