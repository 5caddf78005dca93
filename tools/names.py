"""Names of the queries in one check module."""
import importlib, sys, pathlib
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
from wattloom.session import local_session
local_session("names")
print(" ".join(importlib.import_module("wattloom.workbench." + sys.argv[1]).QUERIES))
