"""Compute-usage analytics over batch-job records, written for Spark.

Every public function takes and returns a ``DataFrame`` (or a ``Column``) and
stays lazy: nothing is collected to the driver inside the library.
"""
