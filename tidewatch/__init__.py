"""Tidewatch: user-behaviour analytics as Spark DataFrame and streaming jobs."""
