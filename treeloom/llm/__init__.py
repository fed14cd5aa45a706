"""Training-data operators: deduplication, decontamination, filtering, counting, packing.

Every module holds one operator with a general interface; ``queries`` holds the
thin benchmark queries ``op1_*`` .. ``op10_*``.  Nothing outside this subpackage
imports it.
"""
