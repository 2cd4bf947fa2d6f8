"""Training-data operators: dedup joins, decontamination, PII, packing, sharding and the like.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``catalogue`` registers one query per operator.
"""
