"""Ticket analytics, evaluation, retrieval and operations policy as Spark DataFrame jobs."""
