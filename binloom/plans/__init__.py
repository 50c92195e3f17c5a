"""Registered queries: each family module adds Spark plans and the SQL that checks them."""
