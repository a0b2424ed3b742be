"""What Python workers take for packs and shards, and keep after them: measured in processes of their own."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
_TEXTS = """
import random, resource, sys
import numpy as np, pyarrow as pa
from pyspark import TaskContext
TaskContext.get = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())
rng = random.Random(5)
vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(100_000)]
said = [" ".join(rng.choices(vocab, k=200)) + "." for _ in range(SAID)]
held = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) >> 10
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
texts = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 2000), pa.int64()), pa.array(said[k : k + 2000]), pa.array(["en"] * 2000)], ["id", "text", "lang"]) for k in range(0, SAID, 2000)]
del said
"""
_PHRASES = """
from tessergrid.llm import phrases as P
base = held()
for r in P._first((b.select(["text", "lang"]) for b in texts), 2):
    del r
print(peak() - base, held() - base)
"""
_REPEATS = """
from tessergrid.llm import repeats as R
base = held()
rows = [r for r in R._pack((b.select(["id", "text"]) for b in texts), 10, 50, 12)]
kept = sum(r.nbytes for r in rows) >> 20
table = pa.Table.from_batches(rows)
R._shard(table.filter(pa.compute.equal(table["shard"], 3)), 50, R.MEMORY, None)
print(peak() - base, held() - base - kept)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads what the system says of a process")
@pytest.mark.parametrize("code, said, most, kept", [(_PHRASES, 20_000, 190, 60), (_REPEATS, 60_000, 400, 60)], ids=["phrases", "repeats"])
def test_packs_and_shards_give_memory_back(code, said, most, kept):
    got = subprocess.run([sys.executable, "-c", f"SAID = {said}\n" + _TEXTS + code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(got[0]) < most and int(got[1]) < kept, got
