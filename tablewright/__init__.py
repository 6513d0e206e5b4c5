"""Table-level analyses as Spark DataFrame operators.

``operators`` holds the analyses, ``functions`` the column expressions they
are made of, ``plans`` the shuffle and lineage helpers, ``sources`` readers
and writers.
"""
