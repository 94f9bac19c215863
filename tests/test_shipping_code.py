"""Worker-side code must not need this package on the executors' path."""

import os
import subprocess
import sys
import tempfile

from pyspark import cloudpickle

from castplan.operators import blocks
from castplan.schemas import CapacityLimits


ROW = ("{'seq': [1], 'row_hash': [5], 'row_copy': [1], 'job_key': ['J'], 'is_floor': [False], 'molds': [8], 'lane_pos': [1], 'line_n': [1], 'floor_n': [0], "
       "'job_pos': [1], 'job_line_n': [1], 'job_floor_n': [0], 'job_line_last': [1], 'job_floor_last': [0], 'lane_end': [8]}")


def run_bare(fn, code):
    """Unpickle ``fn`` in an interpreter that can't import the package, and run ``code``."""
    with tempfile.NamedTemporaryFile(suffix=".pkl", delete=False) as fh:
        fh.write(cloudpickle.dumps(fn))
    code = ("import pickle, sys, pandas as pd\n"
            "assert not any('repo' in p for p in sys.path)\n"
            f"fn = pickle.load(open({fh.name!r}, 'rb'))\ndf = pd.DataFrame({ROW})\n" + code)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", code], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=120)
    assert res.returncode == 0, res.stderr
    return res.stdout.strip()


def test_grouped_map_functions_unpickle_without_package():
    block = blocks._block_fn(CapacityLimits())
    assert run_bare(block, "print(fn(('0', 0, 1), df).molds_for_ext.tolist())\n") == "[6, 2]"
    assert run_bare(block, "print(fn(('0', 0, 2), df).molds_for_ext.dropna().tolist())\n") == "[6, 2]"
    state = "'{\"reach\": [0, 0], \"rows\": [], \"sizes\": [1, 0]}'"
    metas = ("metas = [pd.DataFrame({'pool_key': ['0', '0'], 'block': [0, 1], 'meta': ['{\"own\": {}, \"after\": {}, \"end\": [1, ' + " + state
             + " + ']}', '{\"own\": {}, \"after\": {}, \"end\": null}']})]\n")
    stream = blocks._repair_stream(CapacityLimits())
    code = metas + "out = pd.concat(list(fn(iter([*metas, df.assign(pool_key='0', block=-1, meta=None)]))))\nprint(out.molds_for_ext.dropna().tolist())\n"
    assert run_bare(stream, code) == "[6, 2]"
