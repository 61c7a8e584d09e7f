"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
