"""Training-data operators: near-dedup, token counts, PII, decontamination, licences, WARC, mixing, quality.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
