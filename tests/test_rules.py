"""Rules the library keeps: nothing whole on the driver, no local checkpoints."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent / "lamella"
FORBIDDEN = r"\.collect\(\)|toPandas|localCheckpoint|crossJoin|\.rdd\b|F\.udf|toLocalIterator|applyInPandas\("


def test_forbidden_calls():
    hits = [f"{p.name}: {m}" for p in ROOT.rglob("*.py") if p.parent.name != "llm" for m in re.findall(FORBIDDEN, p.read_text())]
    assert hits == []


def test_worker_functions_carry_their_code(tmp_path):
    """Python workers may run where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lamella.plans.detection_queries import load_peak_detector
    from lamella.plans.inference_queries import load_peaks
    from lamella.streaming.edits import EditReplay, _replay

    data = tmp_path / "functions"
    data.write_bytes(cloudpickle.dumps([load_peak_detector, load_peaks, _replay, EditReplay]))
    code = f"import pickle; fs = pickle.load(open({str(data)!r}, 'rb')); [f() for f in fs[:2]]; list(fs[2]([])); fs[3]()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin"})
