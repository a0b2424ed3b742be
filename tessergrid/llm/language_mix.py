"""Language identification as mixture inference.

A document is a bag of hashed byte n-grams drawn from a mixture of languages.
Per-language n-gram models are counted in Spark over a bounded sample of
labelled documents. For every document, expectation-maximisation estimates the
proportions of all languages; the languages are then admitted one at a time, in
order of proportion, as long as the likelihood gains more than the penalty.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text
with a letter but without an n-gram of its own is read with blanks around it, so that
it has one; without any labelled text every document is ``und``; rows with a null label
never train; ties go to the language that sorts first; repeated rows count as
often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import MULT, append_columns, mix, slices, string_bytes

GRAM = 4
BUCKETS = 1 << 16
#: Labelled documents a language is fitted on, about: the bound of the sample.
SAMPLE_DOCS = 4000
ROUNDS = 8
#: Parameters that one more language counts for: one share, times the n-grams that each byte is part of.
PENALTY = 2.0 * GRAM
_SPACE = np.ones(256, bool)
_SPACE[97:123] = False
_SPACE[128:] = False


def _grams(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, n-gram bucket) of rows [a, b) and how often each occurs."""
    raw, offsets = string_bytes(pc.utf8_lower(column.slice(a, b - a).cast(pa.large_string())))
    if len(raw) < GRAM:
        return (np.zeros(0, np.int64),) * 3
    space = _SPACE[raw]
    low = np.where(space, np.uint8(32), raw)
    m = len(low) - GRAM + 1
    code = np.zeros(m, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | low[k : k + m]
    # not over the edge of a row, and not mostly blanks
    ok = ~(space[:m] & space[1 : m + 1])
    for edge in offsets[1:-1]:
        ok[max(edge - GRAM + 1, 0) : edge] = False
    at = np.flatnonzero(ok)
    bucket = (mix(code[at].astype(np.uint64) * MULT) >> np.uint64(48)).astype(np.int64)
    row = np.searchsorted(offsets, at, side="right") - 1
    key = np.sort(row * BUCKETS + bucket)
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // BUCKETS, key[first] % BUCKETS, np.diff(np.append(first, len(key)))


def _all_grams(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_grams``, and those with blanks around it of each text that has none: any letter then is part of one."""
    found = _grams(column, a, b)
    without = np.ones(b - a, bool)
    without[found[0]] = False
    at = np.flatnonzero(without)
    if not len(at):
        return found
    blank = lambda n: pa.scalar(" " * n, pa.large_string())
    texts = column.slice(a, b - a).take(pa.array(at)).cast(pa.large_string()).fill_null("")
    row, *rest = _grams(pc.binary_join_element_wise(blank(1), texts, blank(GRAM - 2), blank(0)), 0, len(at))
    if not len(row):
        return found
    both = [np.concatenate(x) for x in zip(found, (at[row], *rest), strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition of (lang, text)."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, column = batch.column(0).to_pylist(), batch.column(1)
        _, offsets = string_bytes(column)
        for a, b in slices(offsets):
            row, bucket, n = _all_grams(column, a, b)
            for lang in set(langs[a:b]):
                own = np.array([x == lang for x in langs[a:b]])[row]
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(bucket[own], n[own], BUCKETS).astype(np.int64)
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", spread: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability of each bucket in each (buckets x languages).

    Of a language with more than ``sample_docs`` documents a part is taken, by the hash ``spread``
    (default: of the text); its size is about ``sample_docs`` whatever the size of the table.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    per = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    langs = sorted(per)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / per[k]))])
    spread = F.xxhash64(text) if spread is None else spread
    taken = rows.where(F.pmod(spread, F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = taken.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(langs)), 0.5)
    place = {k: i for i, k in enumerate(langs)}
    at = np.array([place[k] for k in counts.column("lang").to_pylist()], np.int64)
    table[counts.column("bucket").to_numpy(), at] += counts.column("n").to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def _mixture(logp: np.ndarray, row: np.ndarray, n: np.ndarray, rows: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) within the allowed languages, and the log-likelihoods, by EM.

    ``logp`` has a row for each (document, n-gram), with the largest entry 0.
    """
    start = np.flatnonzero(np.diff(row, prepend=-1))
    at = row[start]
    p = np.exp(logp)
    weight = n.astype(np.float32)
    theta = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    total = np.add.reduceat(weight, start)[:, None]
    for _ in range(ROUNDS):
        part = p * theta[row]
        part *= (weight / np.maximum(part.sum(1), 1e-30))[:, None]
        theta[at] = np.add.reduceat(part, start, axis=0) / total
    like = np.zeros(rows)
    like[at] = np.add.reduceat(weight * np.log(np.maximum((p * theta[row]).sum(1), 1e-30)), start)
    return theta, like


def _infer(column: pa.Array, langs: list[str], table: np.ndarray) -> list[pa.Array]:
    raw, offsets = string_bytes(column)
    pred, score, mixes = [], [], []
    for a, b in slices(offsets, 1 << 20):
        size = b - a
        row, bucket, n = _all_grams(column, a, b)
        best = np.full(size, -1)
        share = np.zeros((size, len(langs)), np.float32)
        if len(row) and langs:
            logp = table[bucket]
            logp = logp - logp.max(1, keepdims=True)
            every, _ = _mixture(logp, row, n, size, np.ones((size, len(langs)), np.float32))
            start = np.flatnonzero(np.diff(row, prepend=-1))
            at = row[start]
            alone = np.full((size, len(langs)), -np.inf)
            alone[at] = np.add.reduceat(logp * n[:, None].astype(np.float32), start, axis=0)
            length = np.zeros(size)
            length[at] = np.add.reduceat(n, start)
            order = np.argsort(-every, axis=1, kind="stable")
            # the best single language is where the sets grow from
            top = alone.argmax(1)
            order = np.array([[t, *[x for x in o if x != t]] for t, o in zip(top.tolist(), order.tolist(), strict=True)]).reshape(size, len(langs))
            chosen = np.zeros((size, len(langs)), np.float32)
            chosen[at, top[at]] = 1
            share, like = chosen.copy(), np.where(np.isfinite(alone.max(1)), alone.max(1), 0)
            growing = np.zeros(size, bool)
            growing[at] = True
            for k in range(1, len(langs)):
                # a language that EM over all of them gives less than one n-gram cannot pay its penalty
                growing &= every[np.arange(size), order[:, k]] * length > 1
                if not growing.any():
                    break
                trial = chosen.copy()
                trial[growing, order[growing, k]] = 1
                some = growing[row]
                theta, gained = _mixture(logp[some], row[some], n[some], size, trial)
                growing &= gained - like > PENALTY * np.log(np.maximum(length, 2)) / 2
                chosen[growing], share[growing], like[growing] = trial[growing], theta[growing], gained[growing]
            best[at] = share[at].argmax(1)
        for r in range(size):
            k = int(best[r])
            if k < 0 or not _has_letter(raw[offsets[a + r] : offsets[a + r + 1]]):
                pred.append("und")
                score.append(0.0)
                mixes.append({})
            else:
                pred.append(langs[k])
                score.append(float(min(max(share[r, k], 0.0), 1.0)))
                mixes.append({langs[j]: float(share[r, j]) for j in np.flatnonzero(share[r] > 0).tolist()})
    return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([list(m.items()) for m in mixes], pa.map_(pa.string(), pa.float64()))]


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _has_letter(raw: np.ndarray) -> bool:
    if _ASCII_LETTER[raw].any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score (the share of that language) and lang_mix (shares of the chosen set)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, text, lambda column: _infer(column, *shared.value), "lang_pred string, score double, lang_mix map<string,double>")


def language_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_mix; documents with crc32(doc_id) mod 3 = 1 never train."""
    out = held_out(F.col(doc_id))
    model = train(docs.where(~out), text=text, lang=lang, spread=F.xxhash64(F.col(doc_id)))
    return identify(docs.select(doc_id, text), model, text=text).select(doc_id, F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_mix")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without texts of no language, ``und``; a mixture stays whatever the shares of its languages."""
    model = train(docs.where(~held_out(F.col(doc_id))), text=text, lang=lang, spread=F.xxhash64(F.col(doc_id)))
    names = {c: f"__{c}" for c in docs.columns}
    made = identify(docs.withColumnsRenamed(names), model, text=f"__{text}")
    return made.where(F.col("lang_pred") != "und").select(*[F.col(v).alias(k) for k, v in names.items()])


__all__ = ["held_out", "identify", "keep_identified", "language_report", "train"]
