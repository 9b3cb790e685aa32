"""driftlens: observability analytics as composable PySpark DataFrame operators."""
