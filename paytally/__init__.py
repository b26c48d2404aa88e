"""Bulk payment files on Spark: read, reconcile, check, store and exchange."""

from paytally.tables import PaymentTables

__all__ = ["PaymentTables"]
