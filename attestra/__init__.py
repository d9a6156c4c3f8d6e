"""Evidence-graph analytics on Spark: decision records, lineage, conflicts, splits and text preparation."""
