"""Workforce analytics and attrition risk on Spark."""
