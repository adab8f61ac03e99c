"""Tessella: extraction, reconciliation and corpus analytics expressed as Spark plans."""
