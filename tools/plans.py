"""Write the physical plans of the headline queries to PLANS.md.

Usage: python tools/plans.py [sf_dir]
"""
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from reviewlake.plans import catalog  # noqa: E402
from reviewlake.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
spark = get_session("local[8]", 8)
out = ["# Physical plans of the headline queries", "",
       f"Generated by `tools/plans.py` on `{sf}` (local[8], AQE on; plans before AQE re-optimisation).",
       "Long expressions are shortened with `...`.", ""]
for name in HEADLINE + ["batch_assign", "dedupe_latest"]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        catalog.QUERIES[name](spark, sf).explain()
    lines = []
    for ln in buf.getvalue().splitlines():
        ln = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: ...", ln)
        lines.append(ln if len(ln) <= 220 else ln[:217] + "...")
    out += [f"## {name}", "", "```", *lines, "```", ""]
with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
    f.write("\n".join(out))
print("wrote PLANS.md")
