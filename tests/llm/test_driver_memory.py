"""What the driver keeps after it has fitted a model."""

import subprocess
import sys

CODE = """
import random, re
from skein.llm import toxicity
draw = random.Random(0)
rows = [(" ".join("".join(draw.choices("abcdefgh", k=7)) for _ in range(50)), k % 2) for k in range(4000)]
toxicity.training_rows = lambda *args: rows
anonymous = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
before = anonymous()
toxicity.STEPS = 3
model = toxicity.train(None, None)
print(anonymous() - before)
"""


def test_training_hands_its_memory_back():
    out = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 20
