"""Lectern: corpus preparation as Spark dataflow.

Documents become a line relation; detectors are DataFrame transformations that
emit facts; variants decide what is removed.  Everything is lazy and runs over
many documents at once.
"""

__version__ = "0.1.0"
