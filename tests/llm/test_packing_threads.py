"""The tokenizer runs on its task's own core."""

from __future__ import annotations

import os
import subprocess
import sys

import public_tokenizers
import pytest

SCRIPT = """
import os, sys
from tokenlm.llm import packing
e = packing.Encoder(sys.argv[1])
before = len(os.listdir("/proc/self/task"))
ids = e.encode([" ".join(f"w{i}x{i * 7919}" for i in range(k, k + 400)) for k in range(0, 40_000, 400)])
print(len(os.listdir("/proc/self/task")) - before, len(ids))
"""


@pytest.mark.skipif(not os.path.isdir("/proc/self/task"), reason="counts threads as Linux lists them")
def test_encoder_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, public_tokenizers.path("word_bpe_49k.json")], env=env, capture_output=True, text=True, check=True, timeout=120).stdout
    assert out.split()[-2:] == ["0", "100"]
