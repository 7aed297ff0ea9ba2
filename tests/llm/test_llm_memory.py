import subprocess
import sys
from pathlib import Path

import pyarrow as pa

from cleanframe.llm import toxicity

ROOT = Path(__file__).resolve().parents[2]
HELD = """
import re
import pyarrow as pa
from cleanframe.llm.common import returning_memory

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

@returning_memory
def run(batches):
    # Blocks of the C library below a few that stay, as what a worker keeps lies above what its task needed.
    held = [bytes(700) for _ in range(200_000)]
    yield len(held), resident()
    kept.append(held[::20_000])

kept, before = [], resident()
(made, during), = run(iter([]))
print(made, before, during, resident())
"""


def test_memory_of_a_task_goes_back():
    out = subprocess.run([sys.executable, "-c", HELD], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    made, before, during, after = map(int, out.split())
    assert made == 200_000 and during > before + 100
    assert after < before + 40


def test_pieces_are_handed_on_before_they_are_many(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_PIECES", 500, raising=False)
    texts = [" ".join(f"word{i}x{k}" for k in range(40)) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(100)], pa.int32()), pa.array(texts)], ["toxic", "text"])
    parts = list(toxicity._pieces(3, 10)(iter([batch])))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 1_000
    sums = {}
    for p in parts:
        for r in p.to_pylist():
            sums[r["piece"], r["toxic"]] = sums.get((r["piece"], r["toxic"]), 0) + r["n"]
    assert sums["wor", 0] == sums["wor", 1] == 50 and sums["word7x3\n", 1] == 1
