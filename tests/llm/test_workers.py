import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from aptaforge.llm import simhash
from aptaforge.llm.common import lean, worker_cache

ROOT = Path(__file__).resolve().parents[2]

HOLDS = r"""
import re, sys
from collections import deque
from pathlib import Path
import numpy as np, pyarrow as pa
from aptaforge.llm.common import lean

def held():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

def copies(batches):
    for batch in batches:
        yield pa.array([t + "x" for t in batch.to_pylist()])

def batches():
    for k in range(12):
        yield pa.array([str(k) * 4000 for _ in range(2000)])

before = held()
deque((lean()(copies) if sys.argv[1] == "lean" else copies)(batches()), 0)
print(held() - before)
"""


def left_in_use(how):
    """MB that a process still holds after 24 Arrow arrays of 8 to 16 MB came and went."""
    return float(subprocess.run([sys.executable, "-c", HOLDS, how], cwd=ROOT, capture_output=True, text=True, check=True).stdout)


def test_a_worker_holds_little_once_idle():
    assert left_in_use("lean") < 50  # 27 here, 86 without


def test_what_a_worker_keeps_for_other_operators_goes_when_a_task_begins():
    kept = worker_cache()
    before = dict(kept)
    try:
        kept.update({("words", "a"): 1, ("transducer", "b"): 2})
        assert list(lean("words")(lambda xs: (x + 1 for x in xs))(iter([1, 2]))) == [2, 3]
        assert kept == {("words", "a"): 1}
        assert list(lean()(lambda xs: iter(xs))(iter([]))) == []
        assert kept == {}
    finally:
        kept.clear()
        kept.update(before)


def test_a_bucket_of_near_copies_takes_little_memory():
    """1,500 fingerprints within 28 bits of each other in one bucket: half have sketches alike, half have others, alike as well."""
    rng = np.random.default_rng(4)
    n = 1500
    fps = np.unique(rng.integers(0, 1 << 24, n, dtype=np.uint64))
    n = len(fps)
    marks = rng.integers(0, 256, (2, simhash.MINIMA), dtype=np.uint8)[np.arange(n) % 2]
    marks[:, :20] = rng.integers(0, 256, (n, 20), dtype=np.uint8)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, dtype=np.int64)), pa.array(np.arange(n)), pa.array(fps.view(np.int64)), pa.array([m.tobytes() for m in marks])], names=["bucket", "node", "fp", "sketch"]
    )
    tracemalloc.start()
    try:
        links = [pair for out in simhash.linker(28, simhash.CANDIDATE)(iter([batch])) for pair in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert sorted(links) == [(k, k % 2) for k in range(2, n)]
    assert peak < 100
