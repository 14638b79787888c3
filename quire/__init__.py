"""Quire: page layouts of many documents as Spark tables, and queries over them."""
