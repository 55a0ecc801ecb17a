"""Time every registered query (noop sink) at a given scale: python tools/time_all.py [sf_dir]."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewlake.plans import catalog  # noqa: E402
from reviewlake.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
names = sys.argv[2:] or sorted(catalog.QUERIES)
spark = get_session("local[8]", 8)
for n in names:
    fn = catalog.QUERIES[n]
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    t = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    print(f"{n:28s} {time.perf_counter() - t:7.2f}s", flush=True)
