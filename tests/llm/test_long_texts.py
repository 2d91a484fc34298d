import subprocess
import sys

import pytest

#: A worker has about 1,200 MB beside the heap of a 3,000 MB executor.
LIMIT_MB = 1200
CODE = """
import resource, sys
import numpy as np
from awardlens.llm import cnn, license_scan, lm, minhash, packing, simhash
from awardlens.llm.text import shingles
text = b"some words of one very long text, again and again " * (64 << 20 >> 6)
text = text + b"x" * ((64 << 20) - len(text))
what = sys.argv[1]
if what == "network":
    cnn.probabilities(cnn.Network.fresh(1).tabulate(), [text])
elif what == "shingle set":
    simhash.set_fingerprint(next(simhash.shingle_sets([text], 5)), 4)
elif what == "fingerprint":
    simhash.fingerprint(text)
elif what == "signature":
    minhash.signatures([text])
elif what == "tokens":
    lm.tokens_of([text])
elif what == "ids":
    packing.WordEncoder(packing.default_tokenizer()).encode(text)
elif what == "licenses":
    license_scan.read(text, {b"license": 1})
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("what", ["network", "shingle set", "fingerprint", "signature", "tokens", "ids", "licenses"])
def test_a_text_of_64_mb_fits_a_worker(what):
    out = subprocess.run([sys.executable, "-c", CODE, what], capture_output=True, text=True, check=True).stdout
    assert int(out.split()[-1]) < LIMIT_MB, out
