"""What a configuration of store, roots and caps must satisfy, as a rule on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ----------------------------------------------------------------------------------------------
LINEAGE_TOTAL_BYTES = 64 << 20
BUSY_MS = 5000
STORE_BYTES, BUSY_DEFAULT_MS, TTL_SECONDS = 512 << 20, 250, 7 * 86400
# ----------------------------------------------------------------------------------------------------------------
CONFIG = "store_path string, roots map<string, string>, store_bytes long, lineage_bytes long, busy_ms long, ttl_seconds long"


def _plain(path: Column) -> Column:
    """Absolute, without "." and ".." and doubled slashes."""
    steps = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    return path.startswith("/") & ((path == "/") | ~F.exists(steps, lambda x: x.isin("", ".", "..")))


def _within(path: Column, folder: Column) -> Column:
    return (folder == "/") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def failure(config: Column) -> Column:
    """The code of the first rule that a configuration (struct of CONFIG) breaks: paths (unsafe_root), then caps
    (invalid_request); null if none. A missing path is unsafe; missing roots are none, missing caps their defaults."""
    store = F.coalesce(config["store_path"], F.lit(""))
    cut = F.regexp_extract(store, "^(.*)/[^/]*$", 1)
    home = F.when(cut == "", "/").otherwise(cut)
    roots = F.coalesce(F.map_values(config["roots"]), F.array().cast("array<string>"))
    unsafe = F.exists(roots, lambda root: F.coalesce(~_plain(root) | _within(home, root) | _within(root, home), F.lit(True)))
    cap = lambda c, default: F.coalesce(config[c], F.lit(default).cast("long"))
    lineage, busy = cap("lineage_bytes", LINEAGE_TOTAL_BYTES), cap("busy_ms", BUSY_DEFAULT_MS)
    fine = (cap("store_bytes", STORE_BYTES) > 0) & (lineage > 0) & (lineage <= LINEAGE_TOTAL_BYTES) & (busy > 0) & (busy <= BUSY_MS) & (cap("ttl_seconds", TTL_SECONDS) > 0)
    return F.when(~_plain(store) | (store == "/") | unsafe, "unsafe_root").when(~fine, "invalid_request")
