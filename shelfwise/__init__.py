"""Inventory demand and replenishment analytics as Spark DataFrame operators."""
