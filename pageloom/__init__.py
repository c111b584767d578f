"""pageloom: HTML accessibility analytics on DataFrames."""
