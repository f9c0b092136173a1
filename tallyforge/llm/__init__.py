"""Training-data operators: deduplication, decontamination, scans, archives and token work.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; intermediate
tables go to the folder that the session names in ``spark.checkpoint.dir`` (see ``staging``).
"""
