"""Operators for a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; each operator module states its method, its defined
results for edge cases and how it behaves at scale.
"""
