"""Training-data operators: token files, deduplication, filters, packing.

Nothing outside this folder imports it, apart from the guarded lookup in the
driver's entry module and the corpus pipeline script.
"""
