"""mailsift: Spark-native e-mail / text corpus preparation, classification and scoring.

Every public operator is either a ``Column -> Column`` expression (``mailsift.functions``)
or a ``DataFrame -> DataFrame`` transformation (``mailsift.operators``) so that jobs are
plain Catalyst plans: filters and projections reach the Parquet scan, aggregations run
partial/final, and Python runs only where the MIME grammar needs the standard library.
"""

__version__ = "0.1.0"
