"""Written tables that cut lineage, in the folder that all executors share."""

from ledgerlark.sources.store import release, shared_dir, written

__all__ = ["release", "shared_dir", "written"]
