"""Reconcile purchase ledgers with their evidence documents on Apache Spark."""
