"""Version orders and frontiers as column expressions (``versions``), replay helpers (``replay``)."""
