"""Plan figures per query: python tools/plans.py [name ...]. Streaming and model queries run jobs, so name them."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wattloom.session import local_session  # noqa: E402
from wattloom.workbench import catalog  # noqa: E402

spark = local_session("plans")
names = sys.argv[1:] or [n for n in catalog.queries() if not re.search("stream_|forest_|window_model|ensemble_findings|report_|action_", n)]
for n in names:
    plan = catalog.queries()[n](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    c = {k: len(re.findall(v, plan)) for k, v in {
        "shuffle": r"\bExchange (?!Single)", "single": r"Exchange SinglePartition", "smj": "SortMergeJoin", "bhj": "BroadcastHashJoin",
        "nested": "BroadcastNestedLoopJoin|CartesianProduct", "window": r"\bWindow \[", "python": "InPandas", "scan": "FileScan"}.items()}
    print(f"{n:30s} " + " ".join(f"{k}={v}" for k, v in c.items()), flush=True)
