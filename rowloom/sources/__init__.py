"""Tables: delimited text and Parquet, their overlays, virtual columns, appends and sorted copies."""
