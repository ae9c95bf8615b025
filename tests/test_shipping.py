"""The package reaches workers that know neither its folder nor its path."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_runs_from_another_folder(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as entry
        from packetscope.session import local_session
        spark = local_session(2, "2g")
        for name in ("decode_frames", "pcap_scan"):
            print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if " " in line)
    assert int(counts["decode_frames"]) > 0 and int(counts["pcap_scan"]) > 0
