"""Delivery-promise analytics as Spark DataFrame jobs."""
