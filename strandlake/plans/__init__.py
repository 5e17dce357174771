"""Registered queries over the driver tables, and the conversion dispatcher."""
